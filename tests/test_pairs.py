"""Pairs of similar titles by brute force, and the rollout's order."""

import random

import duckdb
from pyspark.sql import functions as F

from tidewater.operators import relational
from tidewater.operators.relational import title_classes, title_pairs
from tidewater.plans import catalog
from tidewater.sources.pages import rollout


def test_pairs_by_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    rows = [(rng.choice("ab"), i, [w for w in rng.choices(words, k=rng.choice([1, 2, 6, 8, 9, 10]))] if rng.random() < 0.8 else ["hot", *words[:8]]) for i in range(160)]
    rows += [("a", 900, []), ("a", 901, None), ("a", None, ["w1"]), (None, 902, ["w1"]), (None, 903, ["w1"]), ("b", 904, ["w1", None]), ("b", 904, ["w1"])]
    df = spark.createDataFrame(rows, "block string, id long, tokens array<string>").repartition(4)
    for least in (0.82, 0.5, 1.0):
        got = {(r["block"], r["a"], r["b"], round(r["similarity"], 9)) for r in title_pairs(df, ["block"], "id", "tokens", least).collect()}
        sets = [(b, i, frozenset(w for w in t if w)) for b, i, t in rows if t and b is not None and i is not None]
        want = {(b, min(i, j), max(i, j), round(len(x & y) / len(x | y), 9)) for b, i, x in sets for c, j, y in sets if b == c and i != j and x and len(x & y) / len(x | y) >= least}
        assert got == want


def test_classes_tell_the_same_pairs(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    rows = [(rng.choice("ab"), i, rng.choices(words, k=rng.choice([1, 2, 6, 9, 10]))) for i in range(120)] + [("a", 200 + i, ["hot", *words[i % 2 : 9]]) for i in range(60)]
    rows += [("a", 900, []), ("a", 901, None), ("a", None, ["w1"]), (None, 902, ["w1"]), (None, 903, ["w1"])]
    df = spark.createDataFrame(rows, "block string, id long, tokens array<string>").repartition(4)
    for least in (0.82, 0.5):
        got = title_classes(df, ["block"], "id", "tokens", least).collect()
        members, links = [[r for r in got if r["kind"] == kind] for kind in ("member", "link")]
        inside = {}
        for r in members:
            inside.setdefault((r["block"], r["a"]), []).append(r["b"])
        assert sorted(r["b"] for r in members) == sorted(i for b, i, t in rows if b and i is not None and t)
        pairs = {(b, x, y, 1.0) for (b, _), own in inside.items() for x in own for y in own if x < y}
        pairs |= {(r["block"], min(x, y), max(x, y), round(r["similarity"], 9)) for r in links for x in inside[r["block"], r["a"]] for y in inside[r["block"], r["b"]]}
        want = {(r["block"], r["a"], r["b"], round(r["similarity"], 9)) for r in title_pairs(df, ["block"], "id", "tokens", least).collect()}
        assert links and pairs == want


def test_copies_of_a_title_do_not_multiply(spark):
    df = spark.range(6000).selectExpr("'a' as block", "id", "array('x', if(id % 2 = 0, 'y', 'z')) as tokens")
    assert title_classes(df, ["block"], "id", "tokens").count() == 6000  # as pairs: 8,997,000


def test_query_gives_every_pair_of_copies(spark, tmp_path):
    names = ["red bolt", "Red  bolt!", "red bolt", "bolt red", "red bolts", "a b c d e f", "a b c d e g", "a b c d e f g", None, "", "--"]
    rows = [(i, name, "Brand#1") for i, name in enumerate(names)] + [(50, "red bolt", "Brand#2"), (51, "red bolt", None), (52, "red bolt", None), (None, "red bolt", "Brand#1"), (1, "red bolt", "Brand#1")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"file://{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as from '{tmp_path}/part.parquet/*.parquet'")
    plain = "select a.p_brand, a.p_partkey, b.p_partkey, 1.0 from part a join part b using (p_brand) where a.p_partkey < b.p_partkey and a.p_partkey < 4 and b.p_partkey < 4"
    got = [(r["p_brand"], r["a"], r["b"], r["similarity"]) for r in catalog.queries()["jn12_title_pairs"](spark, f"file://{tmp_path}").collect()]
    assert sorted(got) == sorted((b, x, y, float(s)) for b, x, y, s in con.execute(catalog.oracle_sql()["jn12_title_pairs"]).fetchall())
    assert sorted(r for r in got if r[2] < 4) == sorted((b, x, y, float(s)) for b, x, y, s in con.execute(plain).fetchall()) and len(got) > 6


def test_parts_of_a_set_are_paired_once(spark, monkeypatch):
    monkeypatch.setattr(relational, "MEMBERS", 7)
    df = spark.range(120).selectExpr("'a' as block", "id", "if(id % 3 = 0, array('v', 'w', 'x', 'y', 'z'), array('u', 'v', 'w', 'x', 'y', 'z')) as tokens")
    got = [(r["a"], r["b"]) for r in title_pairs(df, ["block"], "id", "tokens").collect()]
    assert len(got) == len(set(got)) == 120 * 119 // 2 and all(a < b for a, b in got)


def test_rollout(spark):
    rows = [("k.edu", "K", "Kenya"), ("k.edu", "K", "RU"), ("r.edu", "R", "RU"), ("x.edu", "X", None), ("a.edu", "A", "KE"), ("y.edu", "Y", "Nowhere"), (None, "N", "GB")]
    got = rollout(spark.createDataFrame(rows, "domain string, name string, country string"))
    assert {(r["domain"], r["countryCode"], r["priority"], r["turn"]) for r in got.collect()} == {("a.edu", "KE", 100, 1), ("k.edu", "KE", 100, 2), ("r.edu", "RU", 1, 1), (None, "GB", 99, 1)}
    two = rollout(spark.createDataFrame(rows, "domain string, name string, country string"), countries=2)
    assert {r["countryCode"] for r in two.select("countryCode").distinct().collect()} == {"KE", "GB"} and two.where(F.col("turn") == 2).count() == 1
