import random
import re

from tidewater.llm import near_dedup as N
from tidewater.llm.components import components

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, k):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randint(0, 999)}" for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(rng.choice([1, 2, 15])):
            words = [w if rng.random() > 0.02 else f"n{rng.randint(0, 99999)}" for w in base]
            rows.append((len(rows), " ".join(words).upper() if rng.random() < 0.2 else "\n".join(words)))
    chain = [f"c{i}" for i in range(100)]
    for step in range(0, 40, 4):  # neighbours are links, ends are not
        rows.append((len(rows), " ".join(chain[step:] + [f"d{i}" for i in range(step)])))
    return rows + [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n")]


def test_components_by_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: r for r in N.near_duplicates(docs, k=4).collect()}
        want, sizes = brute(rows, 4)
        assert {i: r["component_id"] for i, r in got.items()} == want and {i: r["n_shingles"] for i, r in got.items()} == sizes
        assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_every_pair_across_components_is_seen(spark):
    rows = [(i, t) for i, t in corpus(3) if t and t.strip()]
    from pyspark.sql import functions as F

    mixed = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.col("doc_id"))
    seen = {(r["u"], r["v"]) for r in N._pairs_across(mixed, 4, 80, 100).collect()}
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(FOLD))
        sets[i] = frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3)) or frozenset([tuple(w)])
    links = {(b, a) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert links <= seen


def test_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (5, 5), (None, 3), (200, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(spark, odd_docs):
    got = N.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["component_id"] == by_id[10]["component_id"] == 1 and by_id[8]["component_id"] == 7 and by_id[None]["kept"] and by_id[None]["component_id"] is None
    assert all(by_id[i]["kept"] and by_id[i]["n_shingles"] == 0 for i in (3, 4, 5))
    kept = N.keep_one_each(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 6, 7, 9]
    assert N.near_duplicates(odd_docs.limit(0)).count() == 0
