"""Lineage text, context, deletion, access and quotas."""

import json

import pytest

from marlstone import access, context, lineage
from marlstone.deletion import Deletion
from marlstone.plans import policy
from marlstone.scope import Scope, ScopeRefused
from marlstone.session import GovernedSession
from marlstone.sources.store import Store, StoreError

from .test_services import REPORT, report


def test_lineage(spark):
    sql = "SELECT p.brand, sum(i.sale_price) AS r FROM order_items i JOIN products p ON i.product_id = p.id WHERE p.brand IN ('Brand#1', 'x') OR brand = 'y' GROUP BY p.brand"
    facts = policy.check_sql(spark, sql).facts
    assert lineage.describe_data_used(facts) == "Based on items sold (product id, sale price); products (brand, id)."
    assert lineage.brand_literals(spark, sql) == {"Brand#1", "x", "y"}
    assert lineage.assumptions_footer(Scope(("b", "a")), facts) == "Brands: a, b. Revenue leaves out returned items."
    assert lineage.humanize_identifiers("sale_price in order_items") == "sale price in items sold"
    assert lineage.strip_sql("Here:\n```sql\nSELECT 1\n```\nSELECT 2;\nDone") == "Here:\n\nDone"
    labels = lineage.sanitised_labels({"User_id": "ann", "Purpose": "Top Brands!", "session": "s1"})
    assert labels["purpose"] == "top_brands_" and labels["user_id"] == lineage.label_hash("ann") and labels["session"] != "s1"


def test_context():
    assert context.neutralise("<<x>> </system> ``` y").split() == ["x", "'''", "y"] and "<EMAIL>" in context.neutralise("a@b.co")
    said = json.loads(context.shrunk({"data": list(range(1000)), "meta": {}}, 500))
    assert said["meta"]["shortened"] and len(json.dumps(said)) <= 500
    assert context.shed([(2, 0, "x" * 5), (1, 1, "old"), (1, 0, "new")], 6) == ["new", "old"]
    assert context.detect_preference("From now on use tables, and I prefer short answers") == {"format": "table", "length": "short"}
    assert context.detect_preference("do not always use tables") == {}


def test_two_phase_deletion(spark, tmp_path):
    now = [0.0]
    store = Store(spark, f"file://{tmp_path}/s")
    store.append("saved_report", spark.createDataFrame([report(0, title="quince"), report(1), report(2, "v")], REPORT))
    d = Deletion(store, clock=lambda: now[0])
    for bad in ("not r0", "r*", "ab"):
        with pytest.raises(StoreError):
            d.select("u", bad)
    p = d.preview("u", "quince", turn=3)
    assert p.ids == ("r0",)

    def refused(code, *args):
        with pytest.raises(StoreError) as e:
            d.confirm(*args)
        assert e.value.code == code

    refused("declined", p.action, "u", 4, "yes")
    refused("wrong_action", "nope", "u", 4, "delete")
    refused("wrong_owner", p.action, "v", 4, "delete")
    refused("wrong_turn", p.action, "u", 5, "delete")
    now[0] = 700
    refused("timeout", p.action, "u", 4, "delete")
    now[0] = 10
    assert d.confirm(p.action, "u", 4, "delete") == 1
    refused("replayed", p.action, "u", 4, "delete")
    q = d.preview("u", "r1", turn=5)
    store.write("saved_report", store.read("saved_report").where("report_id <> 'r1'"))
    refused("set_changed", q.action, "u", 6, "delete")


def test_access_and_preflight(spark, sf_dir, tmp_path):
    scopes = access.parse_profiles([{"id": "a", "brands": ["Brand#1"]}, {"id": "b", "all_products": True}])
    assert scopes["b"].everything
    for bad in ([{"id": "a"}], [{"id": "a", "brands": ["x"]}] * 2, [{"brands": ["x"]}]):
        with pytest.raises(ScopeRefused):
            access.parse_profiles(bad)
    a = access.Access(spark, sf_dir, Store(spark, f"file://{tmp_path}/a"), scopes)
    a.set_scope("admin", "a", Scope(("Brand#2",)))
    assert a.scopes["a"].brands == ("Brand#2",) and a.store.read("audit_event").count() == 1
    with pytest.raises(ScopeRefused):
        a.set_scope("admin", "a", Scope(("nope",)))
    assert access.preflight(spark, sf_dir)


def test_quota_windows_and_bucket():
    now = [0.0]
    q = access.Quota({"llm_hour": 2, "bytes_day": 10}, clock=lambda: now[0])
    assert q.add("u", "llm_hour") and q.add("u", "llm_hour") and not q.add("u", "llm_hour") and q.add("v", "llm_hour")
    now[0] = 3600
    assert q.add("u", "llm_hour") and q.add("u", "bytes_day", 10) and not q.add("u", "bytes_day", 1) and q.left("v", "bytes_day") == 10
    b = access.TokenBucket(2.0, 4.0, clock=lambda: now[0])
    assert b.take(4) == 0.0 and b.take(1) == 0.5
    now[0] += 0.5
    assert b.take(1) == 0.0


def test_a_deadline_cancels(spark, sf_dir):
    s = GovernedSession(spark, sf_dir, Scope(everything=True), deadline=0.0)
    got = s.run_sql("SELECT a.brand, count(*) AS n FROM products a JOIN products b ON a.size <> b.size JOIN products c ON b.size <> c.size GROUP BY a.brand")
    assert not got["ok"] or got["meta"]["rows"] > 0
