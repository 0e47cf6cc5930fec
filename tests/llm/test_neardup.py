"""Near duplicates against all pairs compared by hand."""

import random

import numpy as np

from marlstone.llm import neardup as N

SCHEMA = "doc_id long, text string, node string, n string"


def brute(rows):
    def shingles(t):
        low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = low.encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), c := least.get(find(i)), d == c) for i, ((d, *_), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_classes_equal_all_pairs(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(25):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 8, 15, 40, 200]))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(999)}"
            rows.append((n, rng.choice([" ", "\n", " \t"]).join(words).upper() if rng.random() < 0.3 else " ".join(words), "a", "b"))
            n += 7
    rows += [(None, rows[0][1], "", ""), (None, None, "", ""), (1, None, "", ""), (2, " \n", "", ""), (3, "four words only here", "", ""), (4, "FOUR words only here", "", ""), (4, "four words only here", "", ""), (5, "w " * 5000, "", "")]
    rng.shuffle(rows)
    got = sorted(map(tuple, N.near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()), key=str)
    assert got == brute(rows)


def test_nothing(spark):
    assert N.near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_a_long_path(spark):
    ids = list(range(60))
    random.Random(5).shuffle(ids)
    links = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(ids, ids[1:], strict=False)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in N.components(links).collect()} == {i: 0 for i in range(60)} | {100: 100, 101: 100}


def test_signature_collides_as_often_as_sets_overlap():
    rng = np.random.default_rng(0)
    for size in (30, 2000):
        rates = []
        for _ in range(60):
            pool = np.unique(rng.integers(0, 1 << 63, size * 2, dtype=np.uint64) * np.uint64(2))
            a, b = pool[: int(size * 0.9)], pool[int(size * 0.1) : size]
            rates.append((N.signature(np.sort(N.mixed(a))) == N.signature(np.sort(N.mixed(b)))).mean())
        assert abs(np.mean(rates) - 0.8) < 0.05, (size, np.mean(rates))


def test_band_keys_are_the_same_for_equal_sets():
    a = N.shingles(b"one two three four five six seven")
    assert (N.band_keys(N.signature(a)) == N.band_keys(N.signature(N.shingles(b"ONE two  three\tfour five six seven")))).all()
    assert len(a) == 3 and len(N.shingles(b"a b")) == 1 and len(N.shingles(b"")) == 0


def template_family(texts):
    """Texts of one template with six words changed, and their classes: two are
    similar (0.851) if they share four of the places, else under 0.835; all share buckets."""
    rng = random.Random(8)
    base, places, least = [f"t{i}" for i in range(500)], [], list(range(texts))
    for n in range(texts):
        known = rng.sample(rng.choice(places), 4) if n % 40 == 39 else []
        places.append(sorted({*known, *rng.sample([i for i in range(5, 495, 5) if i not in known], 6 - len(known))}))
    while True:
        before = list(least)
        for i in range(texts):
            for j in range(i):
                if least[i] != least[j] and len(set(places[i]).intersection(places[j])) >= 4:
                    least[i] = least[j] = min(least[i], least[j])
        if least == before:
            break
    rows = [(n, " ".join(f"x{n}" if i in places[n] else w for i, w in enumerate(base)), "", "") for n in range(texts)]
    rng.shuffle(rows)
    return rows, sorted(((n, 496, c, n == c) for n, c in enumerate(least)), key=str)


def test_links_of_a_template_family_are_all_found(spark):
    rows, want = template_family(1200)
    assert 20 < sum(not kept for *_, kept in want) < 200
    assert sorted(map(tuple, N.near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()), key=str) == want


def test_template_family_equals_all_pairs(spark):
    rows, want = template_family(200)
    assert want == brute(rows)
    assert sorted(map(tuple, N.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == want


def test_one_row_of_each_class_comes_first(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (None, text), (3, text + " x"), (3, text + " x"), (None, "other words that stand alone here"), (None, "other words that stand alone here"), (9, None), (9, "")]
    numbered = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k long")
    found = {r.row: r["first"] for r in N.near_dedup(numbered, row=N.F.col("k")).collect()}
    assert [k for k in range(9) if found[k]] == [3, 5, 7, 8]


def test_links_apart_from_every_star_are_found(spark):
    """Two sub-families of one template, alike among themselves only, beside strays."""
    base = [f"t{i}" for i in range(300)]

    def text(tag, places):
        return " ".join(f"{tag}{i}" if i in places else w for i, w in enumerate(base))

    rows = [(0, text("stray", range(5, 300, 38)), "", "")]
    for family in range(6):
        own = range(10 + family * 6, 300, 45)
        rows += [(1 + family * 20 + k, text(f"f{family}", own) + f" end{family}{k}", "", "") for k in range(5)]
    assert sorted(map(tuple, N.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


def test_drawn_stars_pair_each_bucket_row_once(spark):
    """At most one pair a row and star, none within a component, more with more stars."""
    members = spark.createDataFrame([(k, n) for k in range(30) for n in range(40)] + [(99, 1), (99, 2)], "key long, node long")
    roots = spark.createDataFrame([(n, n % 2) for n in range(40) if n != 2] + [(2, 1)], "node long, root long")
    of = {r.node: r.root for r in roots.collect()}
    stars = [{(r.a, r.b) for r in N.drawn_stars(members, roots, turns).collect()} for turns in (1, 2)]
    for turns, pairs in enumerate(stars, 1):
        assert pairs and all(a < b and of[a] != of[b] and {a, b} != {1, 2} for a, b in pairs)
        assert len(pairs) <= turns * 30 * 21 and len({n for p in pairs for n in p}) == 40
    assert stars[0] < stars[1]


def test_stars_are_told_from_other_shapes(spark):
    def told(*edges):
        return N.all_stars(spark.createDataFrame(edges, "a long, b long"))

    assert told((0, 1), (0, 2), (5, 6))
    assert not told((0, 1), (1, 2)) and not told((0, 2), (1, 2)) and not told((0, 1), (0, 2), (1, 2))
    assert N.all_stars(spark.createDataFrame([], "a long, b long"))


def edited_family(texts):
    """Texts of one template of 120 words with one to nine words changed."""
    rng = random.Random(12)
    base = [f"t{i}" for i in range(120)]
    return [(n, " ".join(f"x{n}" if i in places else w for i, w in enumerate(base)), "", "") for n in range(texts) for places in [rng.sample(range(120), rng.randrange(1, 10))]]


def test_pairs_of_a_family_are_few_for_each_text(spark, monkeypatch):
    """Every text of a family meets a few centres, whatever bands it shares with them."""
    tested, confirmed = [], N.confirmed

    def counted(pairs, whole, similarity):
        tested.append(pairs.count())
        return confirmed(pairs, whole, similarity)

    monkeypatch.setattr(N, "confirmed", counted)
    rows = edited_family(300)
    assert sorted(map(tuple, N.near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()), key=str) == brute(rows)
    assert sum(tested) < 18 * 300


def test_centre_is_the_node_that_meets_most_others(spark):
    """Not the smallest one; of equals the smallest, and weight 0 where it is the centre."""
    rows = [("k", 1), ("k", 2), ("k", 3), ("l", 2), ("l", 3), ("l", 4), ("m", 3), ("m", 5), ("n", 6), ("o", 8), ("o", 7)]
    members = N.centred(N.crowded(spark.createDataFrame([(ord(k), n) for k, n in rows], "key long, node long")))
    found = {(chr(r.key), r.node): (r.a, r.weight) for r in members.collect()}
    assert found == {("k", 1): (3, 2), ("k", 2): (3, 4), ("k", 3): (3, 0), ("l", 2): (3, 4), ("l", 3): (3, 0), ("l", 4): (3, 2), ("m", 3): (3, 0), ("m", 5): (3, 1), ("o", 7): (7, 0), ("o", 8): (7, 1)}
    assert sorted(map(tuple, N.first_stars(members).collect())) == [(1, 3), (2, 3), (3, 4), (3, 5), (7, 8)]
