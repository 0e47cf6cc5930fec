"""Policy, scope, small cells, bands, differencing and the session."""

import random

import pytest

from marlstone.bands import merge_small_bands
from marlstone.differencing import DAY, Fingerprint, Store, conflicts
from marlstone.plans import policy, rewrite
from marlstone.scope import Scope, ScopeRefused, scoped_views, unknown_brands
from marlstone.session import GovernedSession, estimate, names, safe

REFUSED = [
    ("", "sql_syntax"), ("SELECT brand,, size FROM products", "sql_syntax"), ("SELECT 1 AS " + "x" * 9000, "sql_too_long"), ("SELECT 1; SELECT 2", "multiple_statements"),
    ("DELETE FROM users", "statement_not_allowed"), ("INSERT INTO users SELECT 1", "statement_not_allowed"), ("(SELECT 1)", "statement_not_allowed"),
    ("WITH RECURSIVE x AS (SELECT 1 AS a) SELECT a FROM x", "recursive_cte"), ("WITH users AS (SELECT 1 AS a) SELECT a FROM users", "cte_shadows_table"),
    ("WITH __p AS (SELECT 1 AS a) SELECT a FROM __p", "cte_shadows_table"), ("SELECT a FROM other.users", "source_not_allowed"), ("SELECT x FROM range(5)", "source_not_allowed"),
    ("SELECT a FROM unknown_table", "source_not_allowed"), ("SELECT brand FROM products TABLESAMPLE (5 ROWS)", "source_not_allowed"), ("SELECT * FROM products", "select_star"),
    ("SELECT p.* FROM products p", "select_star"), ("SELECT first_name FROM users", "pii_projection"), ("SELECT count(*) AS n FROM users WHERE email = 'x'", "pii_reference"),
    ("SELECT brand AS email FROM products", "pii_projection"), ("SELECT java_method('a', 'b') AS x", "function_denied"), ("SELECT explode(array(1)) AS x", "function_denied"),
    ("SELECT brand, count(*) AS n FROM products GROUP BY ROLLUP(brand)", "unsupported_syntax"), ("SELECT name FROM products JOIN order_items USING (id)", "unsupported_syntax"),
    ("SELECT p FROM products p", "unresolved_value"), ("SELECT nope FROM products", "unknown_column"), ("SELECT status FROM orders, order_items", "ambiguous_column"),
    ("SELECT id, country FROM users", "qi_at_id_grain"), ("SELECT DISTINCT country FROM users", "qi_at_id_grain"), ("SELECT max(country) AS m FROM users", "qi_position"),
    ("SELECT avg(balance) AS m FROM users", "qi_position"), ("SELECT country, row_number() OVER (ORDER BY country) AS r FROM users", "qi_position"),
    ("SELECT u.country, count(*) AS n FROM users u WHERE u.id = 5 GROUP BY u.country", "small_cell_unplaceable"),
    ("SELECT x.n FROM (SELECT state, count(*) AS n FROM users GROUP BY state) x JOIN (SELECT country, count(*) AS m FROM users GROUP BY country) y ON x.n = y.m", "qi_differencing"),
    ("SELECT prodуct FROM products", "non_ascii_identifier"), ("SELECT `a-b` FROM products", "identifier_not_allowed"),
]
ALLOWED = [
    "SELECT 1 AS x", "SELECT 1 AS x;", "SELECT country, count(*) AS n FROM users GROUP BY country", "SELECT count(DISTINCT country) AS n FROM users",
    "SELECT brand, round(sum(sale_price), 2) AS r FROM order_items JOIN products ON product_id = id GROUP BY brand ORDER BY r DESC LIMIT 5",
    "WITH x AS (SELECT brand, count(*) AS n FROM products GROUP BY brand) SELECT brand FROM x WHERE n > (SELECT avg(n) FROM x)",
    "SELECT brand FROM products UNION SELECT category FROM products", "SELECT id, rank() OVER (PARTITION BY brand ORDER BY size) AS r FROM products",
    "SELECT p.brand FROM shop.products p WHERE EXISTS (SELECT 1 FROM order_items i WHERE i.product_id = p.id)", "SELECT brand FROM products WHERE name LIKE 'a%' AND size BETWEEN 1 AND 3",
]


@pytest.fixture(scope="module")
def shadow(spark):
    return policy.shadow_session(spark)


@pytest.mark.parametrize(("sql", "code"), REFUSED)
def test_refused(spark, shadow, sql, code):
    assert policy.check_sql(spark, sql, shadow).reason == code


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, shadow, sql):
    assert policy.check_sql(spark, sql, shadow).reason == "ok"


def test_scope_keys_and_refusals():
    assert Scope(everything=True).key == "all" and Scope(("a", "b")).key == Scope(("b", "a")).key != Scope(("a",)).key
    assert Scope(everything=True).covers(Scope(("a",))) and Scope(("a", "b")).covers(Scope(("a",))) and not Scope(("a",)).covers(Scope(everything=True))
    for bad, code in ((dict(), "empty_scope"), (dict(brands=("a",), everything=True), "scope_invalid"), (dict(brands=(" ",)), "scope_invalid")):
        with pytest.raises(ScopeRefused) as e:
            Scope(**bad)
        assert e.value.code == code


def test_scoped_views_hold_only_the_scope(spark, sf_dir):
    views = scoped_views(spark, sf_dir, Scope(("Brand#1",)))
    assert {r.brand for r in views["products"].select("brand").distinct().collect()} == {"Brand#1"}
    outside = views["order_items"].join(views["products"], views["order_items"].product_id == views["products"].id, "left_anti")
    assert outside.count() == 0 and views["users"].count() > 0
    assert [r.brand for r in unknown_brands(spark, sf_dir, Scope(("Brand#1", "nope"))).collect()] == ["nope"]


def test_small_cells_are_hidden_inside_having_order_and_limit(spark):
    s = GovernedSession(spark, "/root/testdata/sf0.01", Scope(("Brand#1",)), k=5)
    sql = "SELECT u.country, u.traffic_source, count(*) AS n FROM users u WHERE u.balance > 7000 GROUP BY u.country, u.traffic_source HAVING count(*) > 1 ORDER BY n, country LIMIT 300"
    shown = s.frame(sql).collect()
    every = s.bound.sql(sql.replace("HAVING count(*) > 1", "")).collect()
    assert {tuple(r) for r in shown} == {tuple(r) for r in every if r.n >= 5} and len(shown) < len(every)
    assert [r.n for r in shown] == sorted(r.n for r in shown)
    with pytest.raises(policy.Refused):
        s.frame("SELECT count(*) AS n FROM users WHERE balance > 1e12 AND country IS NOT NULL")
    assert s.frame("SELECT count(*) AS n FROM users WHERE balance > 0 AND country IS NOT NULL").first().n > 5
    counted = rewrite.with_minimum(s.bound, "SELECT u.country, count(*) AS n FROM users u GROUP BY u.country", 5, counts=1)
    assert counted.columns == ["country", "n", rewrite.CELL_DIM + "0", rewrite.CELL_CUSTOMERS, rewrite.CELL_ROWS]
    assert all(r.n == r._cell_rows and r.country == r._cell_dim_0 for r in counted.collect())


def test_session_envelope_duplicates_budget_and_failures(spark, sf_dir):
    s = GovernedSession(spark, sf_dir, Scope(everything=True))
    sql = "SELECT category, round(sum(sale_price), 2) AS revenue FROM order_items JOIN products ON product_id = id GROUP BY category"
    first = s.run_sql(sql)
    assert first["ok"] and first["meta"]["rows"] == len(first["data"]) > 0 and not first["meta"]["truncated"]
    assert s.run_sql(f"{sql} -- again")["error"]["code"] == "DUPLICATE_QUERY"
    s.new_turn()
    assert s.run_sql(sql)["data"] == first["data"]
    assert s.run_sql("SELECT order_id FROM orders")["meta"]["truncated"]
    assert estimate(s.bound.sql("SELECT order_id FROM orders")) > 0
    s.budget.per_query = 1
    assert s.run_sql("SELECT status FROM orders")["error"]["code"] == "COST_CAP"
    assert s.run_sql("SELECT * FROM orders")["error"]["code"] == "select_star"
    assert s.run_sql("SELECT 1 / 0 AS x")["error"]["code"] == "GIVE_UP"


def test_session_refuses_a_difference_that_singles_out(spark):
    s = GovernedSession(spark, "/root/testdata/sf0.01", Scope(everything=True), k=5)
    assert s.run_sql("SELECT u.country, count(*) AS n FROM users u GROUP BY u.country")["ok"]
    assert s.run_sql("SELECT u.country, count(*) AS n FROM users u WHERE u.balance > -990 GROUP BY u.country")["error"]["code"] == "differencing"


def test_aggregate_only_sessions_list_no_customer(spark, sf_dir):
    s = GovernedSession(spark, sf_dir, Scope(everything=True), aggregate_only=True)
    assert s.run_sql("SELECT user_id, count(*) AS n FROM orders GROUP BY user_id")["error"]["code"] == "customer_grain"


BANDS = [
    ([("1000+", 4), ("500-999", 5), ("under 500", 40)], {"other bands": 9, "under 500": 40}), ([("a", 1), ("b", 1), ("c", 0)], {}), ([("a", 2), ("b", 2), ("c", 1)], {"other bands": 5}),
    ([("a", 12), ("b", 1), ("c", 9), ("d", 9)], {"a": 12, "other bands": 10, "d": 9}), ([("b", 9), ("a", 9), ("c", 1)], {"b": 9, "other bands": 10}),
    ([(x, 1) for x in "abcdefg"] + [("h", 9)], {"other bands": 7, "h": 9}), ([("a", 3), ("b", 10), ("c", 10), ("d", 2), ("e", 30)], {"other bands": 5, "b": 10, "c": 10, "e": 30}),
    ([("a", 6), ("b", 7)], {"a": 6, "b": 7}),
]


@pytest.mark.parametrize(("bands", "want"), BANDS)
def test_bands(spark, bands, want):
    shuffled = random.Random(1).sample(bands, len(bands))
    rows = spark.createDataFrame([(b, n, n * 2.0, 0.5) for b, n in shuffled], "band string, customers long, revenue double, share double")
    got = {r.band: r for r in merge_small_bands(rows, "band", "customers", ("revenue",), ("share",)).collect()}
    assert {b: r.customers for b, r in got.items()} == want
    assert all(r.revenue == 2.0 * r.customers for r in got.values())
    merged = any(n < 5 for _, n in bands)
    assert all((r.share is None) == merged for r in got.values())


def fp(dims, cells, filters=(), user="u", at=0.0, cut=False, rows=None):
    named = tuple((d, f"users.{d}") for d in dims)
    keyed = {tuple(zip(dims, key, strict=True)): n for key, n in cells.items()}
    sized = {tuple(zip(dims, key, strict=True)): n for key, n in (rows or cells).items()}
    return Fingerprint(user, "all", named, frozenset((frozenset({f"users.{c}"}), t) for c, t in filters), keyed, sized, cut, at)


def test_differencing_verdicts():
    base = fp(["state"], {("A",): 40, ("B",): 30})
    assert not conflicts(base, base)
    assert conflicts(fp(["state"], {("A",): 38, ("B",): 30}), base)  # a repeat that moved by two
    assert conflicts(fp(["state"], {("A",): 38, ("B",): 30}, [("age", "age>3")]), base)
    assert not conflicts(fp(["state"], {("A",): 20, ("B",): 11}, [("age", "age>3")]), base)
    assert conflicts(fp(["state"], {("A",): 20}, [("age", "age>3")], cut=True), base)
    assert conflicts(fp(["state"], {("A",): 40, ("B",): 22, ("C",): 8}, [("age", "x")]), base)  # a new small cell
    fine = fp(["state", "sex"], {("A", "f"): 20, ("A", "m"): 20, ("B", "f"): 15, ("B", "m"): 15})
    assert not conflicts(fine, base)
    assert conflicts(fp(["state", "sex"], {("A", "f"): 20, ("A", "m"): 17, ("B", "f"): 15, ("B", "m"): 15}), base)
    assert conflicts(fine, fp(["state"], {("A",): 40, ("B",): 30}, [("sex", "sex=f")]))
    assert conflicts(fp(["state"], {("A",): None}, [("age", "x")]), base)
    assert conflicts(fp(["state"], {("A",): 40, ("B",): 30}, [("age", "x")], rows={("A",): 43, ("B",): 30}), base)


def test_store_expires_isolates_and_erases():
    now = [0.0]
    store = Store(clock=lambda: now[0])
    assert store.check_and_record(fp(["state"], {("A",): 40}), 5)
    close = lambda user="u", at=0.0: fp(["state"], {("A",): 38}, [("age", "x")], user=user, at=at)
    assert not store.check_and_record(close(), 5) and store.check_and_record(close("other"), 5)
    now[0] = 31 * DAY
    assert store.check_and_record(close(at=now[0]), 5) and store.purge() == 2 and store.erase("u") == 1


def test_cells_and_names():
    assert names(["a", "a", "b", "a"]) == ["a", "a_2", "b", "a_3"]
    assert safe(float("nan")) is None and safe(b"x") == "[binary]" and safe({"a": ["mail a@b.co"]}) == {"a": ["mail <EMAIL>"]}


def leaks(spark, one, two):
    """Whether one session answers both statements."""
    s = GovernedSession(spark, "/root/testdata/sf0.01", Scope(everything=True))
    answers = [s.run_sql(one), s.run_sql(two)]
    assert answers[0]["ok"], answers[0]
    return answers[1]["ok"], answers[1].get("error", {}).get("code")


def test_totals_that_differ_by_a_customer_are_refused(spark):
    assert leaks(spark, "SELECT count(*) AS n FROM users WHERE balance > 4003.839", "SELECT count(*) AS n FROM users WHERE balance > 4003.841") == (False, "differencing")
    assert leaks(spark, "SELECT count(*) AS n FROM users WHERE balance > 0", "SELECT count(*) AS n FROM users WHERE balance > 4000") == (True, None)


def test_numeric_cells_that_differ_by_a_customer_are_refused(spark):
    by = "SELECT floor(u.balance / 2000) AS band, count(*) AS n FROM users u WHERE u.balance > {} GROUP BY floor(u.balance / 2000)"
    assert leaks(spark, by.format(4003.839), by.format(4003.841)) == (False, "differencing")
    ordinal = "SELECT floor(u.balance / 2000) AS band, count(*) AS n FROM users u WHERE u.balance > {} GROUP BY 1"
    assert leaks(spark, ordinal.format(4003.839), by.format(4003.841)) == (False, "differencing")
