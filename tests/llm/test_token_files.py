import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import token_files as T
from tidewater.llm import words
from tidewater.llm.secrets import VOCABULARY, encoding
from tidewater.llm.storage import materialise

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def test_ids_equal_the_vocabularys():
    random.seed(7)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "\u00a0", "1", ".", "\u2003", "x y", "\r\n", "日本", "😀", " word", "\n\n"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(3000)] + ["x" * 70_000 + " y"]
    for turn in range(2):  # from the vocabulary, then from the cache
        ids, counts = T.tokenizer(VOCABULARY).encode(*words.utf8(pa.array(texts)))
        at = np.concatenate([[0], np.cumsum(counts)])
        assert all(ids[at[i] : at[i + 1]].tolist() == encoding(VOCABULARY).encode_ordinary(t) for i, t in enumerate(texts))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 256, 1000])
def test_permutation(n):
    assert sorted(T.permute(np.arange(n), n).tolist()) == list(range(n))
    assert n < 100 or (T.permute(np.arange(n), n, 1) != T.permute(np.arange(n), n, 2)).any()


def test_round_trip_and_resumed_reads(spark, odd_docs, tmp_path):
    docs = materialise(odd_docs.repartition(3), "docs")
    got = T.write_shards(docs, f"file://{tmp_path}", length=64, slots=50).collect()
    n = len(got)
    assert sorted(r["slot"] for r in got) == list(range(n)) and all(r["start"] == (r["slot"] % 50) * 128 for r in got)
    folder = got[0]["file"].rsplit("/", 1)[0]
    whole = T.read_slots(folder, 0, n + 10, 64, 50)
    assert len(whole) == n and (T.read_slots(folder, 47, 8, 64, 50) == whole[47:55]).all()
    lengths = {r["slot"]: r["n_tokens"] for r in got}
    order = T.permute(np.arange(n), n)
    line = np.concatenate([whole[s][: lengths[s]] for s in order.tolist()])
    texts = np.split(line, np.flatnonzero(line == encoding(VOCABULARY).n_vocab) + 1)[:-1]
    decoded = sorted(encoding(VOCABULARY).decode(t[:-1].tolist()) for t in texts)
    assert decoded == sorted(r["text"] or "" for r in odd_docs.collect())


def test_tasks_write_ranges(spark, tmp_path):
    docs = materialise(spark.range(3000).selectExpr("id as doc_id", "repeat('a b c ', 20) as text"), "docs")
    got = T.write_shards(docs, f"file://{tmp_path}", length=64, slots=100).withColumn("task", F.spark_partition_id()).collect()
    tasks = {}
    for r in got:
        tasks.setdefault(r["task"], []).append(r["slot"])
    assert len({r["shard"] for r in got}) > 20 and len(tasks) == spark.sparkContext.defaultParallelism
    assert all(sorted(s) == s == list(range(s[0], s[-1] + 1)) and s[0] % 100 == 0 for s in tasks.values())
    sizes = sorted(len(s) for s in tasks.values())
    assert sizes[-1] - sizes[0] <= 200


def test_empty_table(spark, odd_docs, tmp_path):
    assert T.write_shards(odd_docs.limit(0), f"file://{tmp_path}").count() == 0
