"""Sharding, mixing and URL rules."""

import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import mixing as M
from tidewater.llm import sharding as S
from tidewater.llm import storage
from tidewater.llm import url_rules as U


def shard_by_hand(key, weights):
    draw = lambda i: (int(hashlib.md5(f"{key}#{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return min((-math.log(draw(i)) / w, i) for i, w in enumerate(weights) if w > 0)[1]


def test_rendezvous(spark):
    weights = [1.0, 2.0, 0.0, 1.0]
    got = [r["s"] for r in spark.range(3000).select(S.rendezvous(F.col("id"), weights).alias("s")).collect()]
    assert got == [shard_by_hand(i, weights) for i in range(3000)]
    n = Counter(got)
    assert n[2] == 0 and abs(n[1] - 1500) < 150
    grown = [r["s"] for r in spark.range(3000).select(S.rendezvous(F.col("id"), [*weights, 1.0]).alias("s")).collect()]
    assert {b for a, b in zip(got, grown, strict=True) if a != b} == {4}


def test_manifest(spark, odd_docs):
    got = S.manifest(odd_docs, [1.0] * 3, rows_per_block=2).collect()
    assert len(got) == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for shard in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key"
    assert S.manifest(odd_docs.limit(0), [1.0]).count() == 0 and S.shard_rows(odd_docs, [1.0]).columns == [*odd_docs.columns, "shard_id"]


def test_targets_fill_up_to_three_times(spark):
    sizes = spark.createDataFrame([("a", 1, 1), ("b", 1000, 1), ("c", 10, 1), (None, 500, 1), ("z", 0, 1)], "source string, source_size long, n_rows long")
    got = {r["source"]: r["target"] for r in M.targets(sizes).collect()}
    assert abs(sum(got.values()) - 1511) < 1e-6 and got["a"] == 3 and got["c"] == 30 and got["z"] == 0
    # a 1, b 2, c 3, z 1, null 2: what b and null get is in the ratio of their weights, as neither is full
    assert abs(got["b"] - got[None]) < 1e-6 and got[None] <= 1500


def test_taken_is_near_its_target(spark):
    rows = [(i, " ".join(["w"] * (i % 23 + 1)), f"s{i % 7}") for i in range(4000)] + [(5000 + i, None, None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.taken(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by_id = {i: s for i, _, s in rows}
    taken, target = Counter(), {}
    for r in got:
        taken[by_id[r["doc_id"]]] += r["taken"]
        target[by_id[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - t) <= 25 for s, t in target.items())
    again = M.taken(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    copies = Counter(r["doc_id"] for r in M.repeated(docs).collect())
    words = {i: len((t or "").split()) for i, t, _ in rows}
    assert {i: n * words[i] for i, n in copies.items() if words[i]} == {r["doc_id"]: r["taken"] for r in got if r["taken"]}


def test_shards_of_a_mix(spark):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 3}") for i in range(6000)], "doc_id long, text string, source string")
    mix = M.Mix(rows_per_block=20, shards=5)
    got = M.assigned(docs, mix).collect()
    copies = Counter(r["doc_id"] for r in M.repeated(docs, mix).collect())
    assert Counter(r["doc_id"] for r in got) == copies and len({(r["doc_id"], r["copy"]) for r in got}) == len(got)
    share = Counter(r["mix_shard"] for r in got)
    assert set(share) == set(range(5)) and max(share.values()) < 1.3 * min(share.values())
    quotas = M.split_quotas({"a": 10, "b": 0, "c": 91}, 4, 3)
    assert {k: sum(v) for k, v in quotas.items()} == {"a": 10, "b": 0, "c": 91} and all(abs(sum(q[i] for q in quotas.values()) - 25) <= 1 for i in range(4))


def test_taken_and_the_pipeline_read_the_shards(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 3}") for i in range(6000)], "doc_id long, text string, source string")
    stage = corpus_pipeline.mix_sources(spark, docs, "")
    got = storage.materialise(stage, "stage").collect()
    order = [(r["mix_shard"], r["mix_order"]) for r in got]
    assert order == sorted(order) and {s for s, _ in order} == set(range(M.SHARDS))
    assert {(r["doc_id"], r["copy"], *at) for r, at in zip(got, order)} == {(r["doc_id"], r["copy"], r["mix_shard"], r["mix_order"]) for r in M.assigned(docs).collect()}
    assert sum(a["doc_id"] == b["doc_id"] for a, b in zip(got, got[1:])) < 20  # copies of a row are not side by side
    kept = []
    monkeypatch.setattr(M, "materialise", lambda df, name: kept.append((name, storage.materialise(df, name))) or kept[-1][1])
    taken = {r["doc_id"]: r["taken"] for r in M.taken(docs).collect()}
    words = Counter()
    for r in dict(kept)["mixed"].collect():
        words[r["doc_id"]] += r["size"]
    assert taken == {i: words[i] for i in range(6000)}
    assert dict(kept)["mixed"].select("mix_shard").distinct().count() == M.SHARDS


def test_the_quotas_decide_what_is_read(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    mix = M.Mix(rows_per_block=20, shards=4)
    want, blocks = {}, {}
    split = M.split_quotas
    monkeypatch.setattr(M, "split_quotas", lambda read, *a: want.update(split(read, *a)) or want)
    got = M.assigned(docs, mix).collect()
    for r in got:
        key = int(hashlib.md5(f"1|{r['doc_id']}".encode()).hexdigest()[:15], 16)
        blocks.setdefault((r["source"], r["mix_shard"]), set()).add((r["copy"], key % (1000 // 20)))
    assert {s: [len(blocks.get((s, i), ())) for i in range(4)] for s in want} == want  # each shard reads just its quota of blocks
    monkeypatch.setattr(M, "split_quotas", lambda read, shards, seed: {s: [0] * shards for s in read})
    assert M.assigned(docs, mix).count() == 0 and M.repeated(docs, mix).count() == 0
    assert {r["taken"] for r in M.taken(docs, mix).collect()} == {0}
    monkeypatch.setattr(M, "split_quotas", lambda read, shards, seed: {s: [n] + [0] * (shards - 1) for s, n in read.items()})
    assert {r["mix_shard"] for r in M.assigned(docs, mix).collect()} == {0}


def test_columns_of_the_same_names_are_replaced(spark):
    docs = spark.createDataFrame([(i, "a b", "s", 7, "x", 1.0, "old") for i in range(50)], "doc_id long, text string, source string, Copy int, mix_shard string, mix_order double, shard_id string")
    rows = S.shard_rows(storage.materialise(M.in_shards(M.assigned(docs)), "clash"), [1.0] * 4)
    assert sorted(rows.columns) == sorted(["doc_id", "text", "source", "shard_id", "copy", "mix_shard", "mix_order"])
    assert all(isinstance(r["shard_id"], int) and r["copy"] >= 0 for r in rows.collect())


def test_mix_of_odd_rows(spark, odd_docs):
    got = M.taken(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert M.repeated(odd_docs).columns == odd_docs.columns
    assert M.taken(odd_docs.limit(0)).count() == 0 and M.repeated(odd_docs.limit(0)).count() == 0


URLS = [
    "http://a.net/x", "https://example.net/en/1", "https://www.Example.NET/en/1?q", "https://example.net/de/1", "http://x.example.com/de/", "http://example.com/de", "http://q.org/fr/#a", "http://q.org/en",
    "http://org/fr/", "http://notnet/x", "http://a.net", "http://a.net?x", "no scheme", None, "", "x://cheap-pills.shop/", "http://www.spam-farm.com/", "http://spammer.com/", "http://a.network/", "http://example.network/en/",
]


def by_hand(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if re.search(r"(^|[^a-z0-9])(spam|cheap-pills)($|[^a-z0-9])", host) else "allow"


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(pages).collect()}
    assert got == {i: by_hand(u) for i, u in enumerate(URLS + URLS)}
    assert U.judge(pages.limit(0)).count() == 0


def test_rules_without_tokens_are_tried_everywhere(spark):
    rule = U.Rule("dots", r"\.\.", (), "block", 1)
    pages = spark.createDataFrame([(1, "http://a..b/"), (2, "http://a.b/")], "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in U.judge(pages, rules=[rule], patterns=[]).collect()} == {1: "dots", 2: None}


def test_manifest_by_hand(spark):
    """Every column of the manifest against plain Python: shard, grown shard, sizes, CRCs and slots."""
    import hashlib
    import math
    import zlib

    from tidewater.llm import sharding

    rows = [(i * 7 % 400 if i % 50 else None, None if i % 9 == 0 else "é" * (i % 5) + f"t{i % 30}") for i in range(600)]
    weights = [1.0, 1.0, 2.5, 0.0, 1.0]

    def drawn(key, weights):
        costs = []
        for i, w in enumerate(weights):
            if w > 0:
                u = (int(hashlib.md5(f"{key}#{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                costs.append((-math.log(u) / w, i))
        return min(costs)[1]

    got = sharding.manifest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), weights, rows_per_block=40).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == drawn(key, weights) and r["grown_shard"] in (r["shard"], len(weights)) and r["grown_shard"] == drawn(key, [*weights, 1.0])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and 3 not in slots
    told = sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got)
    assert told == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
