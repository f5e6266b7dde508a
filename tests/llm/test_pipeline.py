import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import decontamination, language, mixing, near_dedup

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = corpus_pipeline.run(spark, DATA).collect()
    kept = {r["doc_id"] for r in rows}
    model = language.fit(docs)
    known = {r["doc_id"] for r in language.predict(docs, model).where("not rejected").collect()}
    lang = docs.where(docs.doc_id.isin(list(known)))
    unique = {r["doc_id"] for r in near_dedup.near_duplicates(lang, 5).where("kept").collect()}
    leaks = {r["doc_id"] for r in decontamination.contaminations(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    clean = docs.where(docs.doc_id.isin(list(unique - leaks)))
    taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.taken(clean).collect()}
    assert kept == {i for i, n in taken.items() if n}
    assert set(docs.columns) < set(rows[0].asDict()) and all(0 <= r["shard_id"] < corpus_pipeline.SHARDS for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontamination", "mixing", "sharding"]


def test_stages_on_odd_rows(spark, odd_docs, tmp_path):
    """Each stage on nulls, empty and long texts, repeats, clashing columns and an empty table, against plain rules."""
    folder = str(tmp_path)
    long = " ".join(f"q{i}" for i in range(40))
    spark.createDataFrame([(1, long)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    more = spark.createDataFrame([(20, long.upper(), "en", "s1"), (20, "quite another text", "en", "s1"), (None, long, "en", "s1"), (None, None, None, "s1")], "doc_id long, text string, lang string, source string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    stages = dict(corpus_pipeline.STAGES)
    empty = docs.limit(0)
    texts = lambda df: sorted(((r["doc_id"] or -1, r["text"] or "") for r in df.collect()))
    every = texts(docs)

    kept = stages["language"](spark, docs, folder)
    assert kept.columns == docs.columns and all(any(c.isalpha() for c in t) for _, t in texts(kept)) and set(texts(kept)) <= set(every)
    assert stages["language"](spark, empty, folder).count() == 0

    kept = stages["near_dedup"](spark, docs, folder)
    ids = [i for i, _ in texts(kept)]
    assert kept.columns == docs.columns and ids == [i for i, _ in every if i not in (2, 8, 10)]
    assert stages["near_dedup"](spark, empty, folder).count() == 0

    kept = stages["decontamination"](spark, docs, folder)
    assert kept.columns == docs.columns and texts(kept) == [(i, t) for i, t in every if t.lower() != long]
    assert stages["decontamination"](spark, empty, folder).count() == 0

    mixed = stages["mixing"](spark, docs.withColumn("copy", F.lit("x")), folder)
    assert set(docs.columns) | {"copy", "mix_shard", "mix_order"} == set(mixed.columns) and set(texts(mixed)) <= set(every)
    assert stages["mixing"](spark, empty, folder).count() == 0

    dealt = stages["sharding"](spark, docs.withColumn("shard_id", F.lit("x")), folder)
    by_id = {}
    for r in dealt.collect():
        by_id.setdefault(r["doc_id"], set()).add(r["shard_id"])
    assert texts(dealt) == every and all(len(s) == 1 and s <= set(range(8)) for s in by_id.values())
    assert stages["sharding"](spark, empty, folder).count() == 0
