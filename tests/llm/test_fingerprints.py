import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewater.llm import fingerprints as P
from tidewater.llm import words


def test_bins_by_brute_force():
    texts = [" ".join(f"w{i * j % 91}" for i in range(1, 80)) for j in (1, 2, 3)] + ["one", "a b c d e f", ""]
    for a, _, hashes, at in words.text_shingles(pa.array(texts), P.SHINGLE):
        table = P.bins_of(hashes, at)
        for t in range(len(at) - 1):
            own = hashes[at[t] : at[t + 1]]
            bins = {}
            for h in own.tolist():
                b, v = h >> 55, h & ((1 << 55) - 1)
                bins[b] = min(v, bins.get(b, v))
            for i in range(P.BINS):
                want = int(P._EMPTY) if not bins else bins[i] if i in bins else bins[next(b for b in P._ORDER[i].tolist() if b in bins)]
                assert int(table[t, i]) == want
        assert a == 0


def test_likeness_estimates_similarity():
    base = [f"w{i}" for i in range(2000)]
    other = base[:1000] + [f"v{i}" for i in range(1000)]
    fp = P.fingerprints(pa.array([" ".join(base), " ".join(other), " ".join(base), "", None, "q r s"]))
    near = P.likeness([fp[0], fp[0], fp[3], fp[3], fp[0]], [fp[1], fp[2], fp[4], fp[0], fp[5]])
    assert abs(near[0] - 996 / (2 * 1996 - 996)) < 0.08 and near[1] == 1 and near[2] == 1 and near[3] == 0 and near[4] < 0.1


def test_edited_pairs_by_brute_force(spark):
    rows = [(i * 3, f"text {i} " * (i % 7), i) for i in range(50)] + [(1, None, 0), (2, "é😀x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(5)
    got = {r["doc_id"]: r for r in P.edited_pairs(docs, rows_per_range=7).collect()}
    ordered = sorted(((i, t or "") for i, t, _ in rows), reverse=True)
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(ordered):
        following = ordered[(n + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["fingerprint"] == P.fingerprints(pa.array([t]))[0] and got[i]["edited_fingerprint"] == P.fingerprints(pa.array([edited]))[0]


def test_ranks_of_cuts(spark):
    cuts = [(x // 3, x * 37 % 11 - 5 + 100 * (x % 3)) for x in range(-50, 900, 7)]
    got = spark.range(-60, 950, 1).select("id", (F.col("id") % 100).alias("h"), P._count_not_above(sorted(cuts), F.col("id"), F.col("id") % 100).alias("n")).collect()
    assert all(r["n"] == sum(c <= (r["id"], r["h"]) for c in cuts) for r in got)


def test_rows_of_one_doc_id_take_several_ranges(spark):
    rows = [(7, f"text {i} " * 3) for i in range(90)] + [(None, f"none {i}") for i in range(90)] + [(3, "same")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = P.edited_pairs(docs, rows_per_range=5).withColumn("task", F.spark_partition_id()).collect()
    ordered = [(r["doc_id"], r["text"]) for r in docs.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()).collect()]
    want = []
    for n, (i, t) in enumerate(ordered):
        following = ordered[(n + 1) % len(ordered)][1]
        a, e, b = P.fingerprints(pa.array([t, P._edit(t, following), following]))
        want.append((i or 0, hashlib.sha256(P._edit(t, following).encode()).hexdigest(), round(P.likeness([a], [e])[0], 9), round(P.likeness([a], [b])[0], 9)))
    assert sorted((r["doc_id"] or 0, r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == sorted(want)
    assert len({r["task"] for r in got if r["doc_id"] == 7}) > 1 < len({r["task"] for r in got if r["doc_id"] is None})


def test_odd_rows(spark, odd_docs):
    got = P.edited_pairs(odd_docs, rows_per_range=3).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert P.edited_pairs(odd_docs.limit(0)).count() == 0
    single = P.edited_pairs(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0
    assert np.isfinite(single[0]["near_edited"])


def test_likeness_of_short_texts():
    """Unrelated texts of few words are unlike, equal ones alike; others come near their true similarity."""
    texts = [f"u{i} v{i} w{i}" for i in range(300)]
    fp = P.fingerprints(pa.array(texts))
    assert max(P.likeness(fp[:-1], fp[1:])) < 0.3 and P.likeness(fp, fp).min() == 1
    worst = []
    for n in (1, 2, 3, 5, 6, 7, 8, 10, 15, 30, 100, 500, 2000):
        for kept in (0.0, 0.5, 0.9, 1.0):
            for seed in range(10):
                base = [f"a{seed}x{i}" for i in range(n)]
                other = base[: int(n * kept)] + [f"b{seed}x{i}" for i in range(n - int(n * kept))]
                sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (base, other)]
                true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
                one, two = P.fingerprints(pa.array([" ".join(base), " ".join(other)]))
                worst.append(abs(P.likeness([one], [two])[0] - true))
    assert max(worst) < 0.35 and sum(worst) / len(worst) < 0.03
