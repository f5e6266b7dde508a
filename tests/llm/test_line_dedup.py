import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import line_dedup as L

BLANK = " \t\n\x0b\x0c\r"
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(stored, asked, least):
    keys = [[line.strip(BLANK).translate(FOLD) for line in (t or "").split("\n")] for t in stored]
    common = {k for k, n in Counter(k for own in keys for k in set(own)).items() if n >= least and k}
    out = []
    for text in asked:
        lines = (text or "").split("\n")
        kept = [x for x in lines if x.strip(BLANK).translate(FOLD) not in common]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    shared = [f"Shared line {i} é" for i in range(40)] + ["", " ", " ", "ÀB", "àb"]
    rows = []
    for i in range(n):
        lines = [rng.choice(["", " ", "\t"]) + (rng.choice(shared) if rng.random() < 0.6 else f"own {i} {j}") + rng.choice(["", "\r", " "]) for j in range(rng.randint(0, 12))]
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in lines)))
    return rows


def answers(store, docs):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in store.apply(docs).collect()}


def test_a_filter_holds_what_is_in_it():
    keys = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    made = L.Cuckoo.of(keys)
    assert made.holds(keys).all() and (made.slots != 0).sum() == len(keys)
    others = keys ^ np.uint64(1 << 62)
    assert made.holds(others).sum() == 0
    made.delete(keys[:15_000])
    assert made.holds(keys[15_000:]).all() and not made.holds(keys[:15_000]).any()
    assert made.insert(others[:10_000]) and made.holds(others[:10_000]).all() and made.holds(keys[15_000:]).all()
    same = np.repeat(keys[:1], 3)  # equal fingerprints are held as often as inserted
    few = L.Cuckoo.of(same)
    few.delete(same[:2])
    assert few.holds(same[:1]).all()
    few.delete(same[:1])
    assert not few.slots.any()
    with pytest.raises(ValueError):
        few.delete(same[:1])


def test_a_full_filter_says_so():
    keys = np.arange(64, dtype=np.uint64) << np.uint64(32) | np.arange(64, dtype=np.uint64)
    assert not L.Cuckoo(8).insert(keys)
    assert L.Cuckoo.of(keys).holds(keys).all()


def test_inserts_and_deletes_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 64)  # several shards
    monkeypatch.setattr(L, "LEAST_SHARDS", 2)
    first, second = corpus(1, 120), [(i + 1000, t) for i, t in corpus(2, 120)]
    one, two = (spark.createDataFrame(rows, "doc_id long, text string") for rows in (first, second))
    a = L.LineStore.empty(spark).insert(one)
    assert a.shards > 1 and answers(a, one) == dict(zip([i for i, _ in first], brute([t for _, t in first], [t for _, t in first], 10), strict=True))
    both = a.insert(two)
    stored = [t for _, t in first + second]
    assert answers(both, one.union(two)) == dict(zip([i for i, _ in first + second], brute(stored, stored, 10), strict=True))
    back = both.delete(two)
    assert answers(back, one) == answers(a, one)
    assert {tuple(r) for r in back.refs.collect()} == {tuple(r) for r in a.refs.collect()}
    members = lambda s: {r["shard"]: sorted(x for x in np.frombuffer(r["slots"], np.uint32) if x) for r in s.filters.collect()}
    assert both.shards != a.shards or members(back) == members(a)
    with pytest.raises(ValueError):
        back.delete(two)


def test_a_filter_is_updated_in_place(spark):
    docs = spark.createDataFrame([(i, f"same\nown {i}") for i in range(12)], "doc_id long, text string")
    more = spark.createDataFrame([(50 + i, "other") for i in range(10)], "doc_id long, text string")
    a = L.LineStore.empty(spark).insert(docs)
    b = a.insert(more)
    slots = lambda s: sum((np.frombuffer(r["slots"], np.uint32) != 0).sum() for r in s.filters.collect())
    assert (slots(a), slots(b), slots(b.delete(docs)), slots(b.delete(docs).delete(more))) == (1, 2, 1, 0)
    assert b.delete(docs).delete(more).refs.count() == 0


def test_filters_dealt_by_shard_answer_alike(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 50)
    monkeypatch.setattr(L, "LEAST_SHARDS", 1)
    docs = spark.createDataFrame(corpus(3, 150) + [(None, None), (7, "x"), (7, "x")], "doc_id long, text string").repartition(3)
    store = L.LineStore.empty(spark).insert(docs)
    whole = sorted(map(tuple, store.apply(docs).collect()), key=str)
    monkeypatch.setattr(L, "FILTER_BYTES", 0)
    assert sorted(map(tuple, store.apply(docs).collect()), key=str) == whole and any(r[2] for r in whole)


def test_exceptions_make_the_filter_exact(spark, monkeypatch):
    """With fingerprints of one value every key of a bucket looks like a member."""
    monkeypatch.setattr(L.Cuckoo, "_homes", lambda self, keys: (np.ones(len(keys), np.uint32), np.zeros(len(keys), np.int64)))
    keys = np.arange(5, dtype=np.uint64)
    made = L.Cuckoo.of(keys[:2])
    assert made.holds(keys).all()
    rows = [{"shard": 0, "slots": np.array([[7, 0, 0, 0]], np.uint32).tobytes(), "exceptions": np.array([1, 7 << 32], np.int64).tobytes()}]
    held = L.Filters.of(rows, 1)
    digests = [np.array([h1, 7 << 32], np.int64).tobytes() for h1 in (1, 2)]
    assert held.common([*digests, b""]).tolist() == [False, True, False]


def test_saved_and_opened(spark, tmp_path):
    docs = spark.createDataFrame(corpus(4, 60), "doc_id long, text string")
    store = L.LineStore.empty(spark, 3).insert(docs)
    store.save(f"file://{tmp_path}/s")
    assert answers(L.LineStore.open(spark, f"file://{tmp_path}/s"), docs) == answers(store, docs)
    assert L.LineStore.open(spark, f"file://{tmp_path}/s").delete(docs).refs.count() == 0


def test_odd_rows(spark, odd_docs):
    store = L.LineStore.empty(spark, 2).insert(odd_docs)
    got = L.digest_columns(store.apply(odd_docs)).collect()
    assert len(got) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in got}
    empty = hashlib.sha256(b"").hexdigest()
    assert (by_id[3]["n_lines"], by_id[3]["n_dropped"], by_id[3]["kept_sha256"]) == (1, 0, empty) == (by_id[4]["n_lines"], by_id[4]["n_dropped"], by_id[4]["kept_sha256"])
    assert by_id[5]["n_lines"] == 2 and by_id[5]["n_dropped"] == 0  # blank lines are never common
    assert all(by_id[i]["n_dropped"] == 1 and by_id[i]["kept_sha256"] == empty for i in (1, 6, 7, 8, 10, None)) and by_id[9]["n_dropped"] == 0
    kept = store.without_common_lines(odd_docs)
    assert kept.columns == odd_docs.columns and kept.schema["text"].dataType == odd_docs.schema["text"].dataType
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert rows[3]["text"] is None and rows[1]["text"] == "" and rows[9]["text"] == "x" * 70_000 and rows[9]["token"] == "t"
    none = odd_docs.limit(0)
    assert L.LineStore.empty(spark).insert(none).apply(none).count() == 0 and L.LineStore.empty(spark).apply(odd_docs).count() == len(got)
    assert store.insert(none).apply(odd_docs).count() == len(got)
