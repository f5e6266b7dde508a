import random
import time
import tracemalloc

import numpy as np

from tidewater.llm import decontamination as D


def naive_tiles(item, text, least):
    """Greedy string tiling as defined: always the longest free common run, then the next."""
    free_i, free_t, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for d in range(len(text)):
                k = 0
                while p + k < len(item) and d + k < len(text) and item[p + k] == text[d + k] and free_i[p + k] and free_t[d + k]:
                    k += 1
                best = max(best, (k, -p, -d))
        k, p, d = best[0], -best[1], -best[2]
        if k < least:
            return out
        for i in range(k):
            free_i[p + i] = free_t[d + i] = False
        out.append(k)


def test_tiles_against_the_definition():
    random.seed(8)
    for _ in range(150):
        item, text = ([random.randint(0, 5) for _ in range(random.randint(0, n))] for n in (25, 40))
        tiles = D.tile(np.array(item, np.uint64), np.array(text, np.uint64))
        used_i, used_t = [], []
        for p, d, k in tiles:
            assert item[p : p + k] == text[d : d + k]
            used_i += range(p, p + k)
            used_t += range(d, d + k)
        assert len(set(used_i)) == len(used_i) and len(set(used_t)) == len(used_t)
        want = naive_tiles(item, text, min(3, len(item)) or 1)
        assert sum(k for *_, k in tiles) == sum(want) and (max((k for *_, k in tiles), default=0) == max(want, default=0))


def test_repetitive_texts_take_little_memory():
    tracemalloc.start()
    began = time.perf_counter()
    tiles = D.tile(np.full(60, 7, np.uint64), np.full(1_000_000, 7, np.uint64))
    assert [k for *_, k in tiles] == [60] and time.perf_counter() - began < 60
    period = np.arange(1_000_000, dtype=np.uint64) % np.uint64(9)
    assert sum(k for *_, k in D.tile(period[:300], period)) == 300
    assert tracemalloc.get_traced_memory()[1] < 900e6
    tracemalloc.stop()


def test_tables_by_brute_force(spark):
    """Every document against every item, without seeds: at least 0.6 of the item's tokens are covered."""
    random.seed(12)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: random.choices(vocabulary, k=n)
    items = [(i, text(random.choice([1, 2, 3, 4, 5, 6, 12, 30]))) for i in range(25)]
    docs = []
    for i in range(120):
        parts = [text(random.randint(0, 40))]
        for _ in range(random.randint(0, 2)):
            own = items[random.randrange(25)][1]
            cut = random.randint(0, len(own))
            parts += [own[cut:], text(random.randint(0, 3)), own[:cut], text(random.randint(0, 20))]
            runs = [own[a : a + 4] for a in range(0, len(own), 4)]  # runs of 4 tokens in another order share no run of 5
            for run in random.sample(runs, len(runs)):
                parts += [run, text(1)]
        docs.append((i, [w for p in parts for w in p]))
    want = set()
    for i, doc in docs:
        for j, item in items:
            if 5 * sum(naive_tiles(item, doc, 3)) >= 3 * len(item) or item == doc:
                want.add((i, j))
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    found = D.contaminations(table, spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and len(want) > 20


def test_the_least_number_of_shared_positions():
    """No tiling that covers 0.6 of an item has fewer positions; some tiling has no more (or than one)."""
    for n in range(3, 60):
        need = -(-3 * n // 5)
        fewest = {0: 0}  # by covered tokens, the fewest positions of tiles
        for covered in range(3, n + 1):
            fewest[covered] = min((fewest[covered - k] + k - 2 for k in range(3, covered + 1) if covered - k in fewest), default=n)
        want = min(fewest[c] for c in fewest if c >= need)
        assert max(1, want - 1) <= D.least_shared(np.int64(n)) <= want


def test_short_and_scattered_items(spark):
    item = [f"t{i}" for i in range(12)]
    runs = [item[8:], item[4:8], item[:4]]
    docs = [(1, " ".join(" ".join([*r, "and", "so"]) for r in runs)), (2, "quiz what is bread made today"), (3, "what, is bread"), (4, "bread is what made"), (5, "Two words"), (6, "two words more")]
    items = [(None, " ".join(item)), (8, "what is bread made"), (9, "two words"), (9, "two words")]
    got = D.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["coverage"]) for r in got.collect()} == {(1, None, 1.0), (2, 8, 1.0), (3, 8, 0.75), (5, 9, 1.0)} and got.count() == 4


def test_common_seeds_do_not_hide_items(spark):
    """Items that share their opening with all documents are still found by what is left, and documents with the opening alone stay."""
    opening = "which of the following is true about"
    items = [(i, f"{opening} {' '.join(f'i{i}w{j}' for j in range(14))}") for i in range(40)]
    docs = [(i, f"{opening} {' '.join(f'd{i}w{j}' for j in range(30))}") for i in range(200)] + [(1000 + i, f"so {t} end") for i, t in items]
    got = D.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1000 + i, i) for i in range(40)}


def test_whole_reordered_and_clean(spark, odd_docs):
    item = [f"q{i}" for i in range(30)]
    filler = " ".join(f"f{i}" for i in range(200))
    whole, swapped = " ".join(item), " ".join(item[20:] + ["x"] + item[10:20] + ["y"] + item[:10])
    rows = [(1, f"{filler} {whole.upper()}!! {filler}"), (2, f"{filler} {swapped}"), (3, filler), (4, " ".join(item[:12]) + filler), (None, whole), (5, None), (1, whole)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, whole), (8, None), (9, ""), (10, "f1 f2"), (11, whole)], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["coverage"]) for r in D.contaminations(docs, items).collect())
    assert got == sorted((i, j, 1.0) for i in (0, 1, 1, 2) for j in (7, 11))
    more = docs.unionByName(spark.createDataFrame([(1, filler), (None, filler), (None, None)], docs.schema))
    kept = D.without_contamination(more.selectExpr("doc_id", "text", "0 as digest", "1 as found_id"), items).collect()
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in kept) == sorted([(0, len(filler)), (0, 0), (1, len(filler)), (3, len(filler)), (4, len(rows[3][1])), (5, 0)])
    small = D.contaminations(docs, items, filter_bits=8)  # a crowded filter lets more through to the join, not more to the result
    assert small.count() == len(got)
    assert D.contaminations(odd_docs, items).count() == 0 and D.contaminations(docs.limit(0), items).count() == 0 and D.contaminations(docs, items.limit(0)).count() == 0
