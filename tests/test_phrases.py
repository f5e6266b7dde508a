import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions.patterns import any_word
from tidewater.functions.phrases import Vocabularies


def test_one_pass_equals_a_pattern_for_each_list(spark):
    """Random texts out of the phrases' own words, with ends, cases, spaces and signs that break or keep a phrase."""
    random.seed(5)
    lists = {
        "a": ("grant", "grants", "grant scheme", "fee waiver", "fee waivers"), "b": ("scheme", "award", "award value", "to apply", "how to apply"),
        "c": ("apply now", "grant", "now open until late", "open", "value of the award"), "d": ("x1", "a b c d", "b c", "c d e"),
    }
    v = Vocabularies(**lists)
    pieces = sorted({w for own in lists.values() for p in own for w in p.split()}) + ["zebra", "regrant", "café", ""]
    rows = [(0, None), (1, ""), (2, "Grant  \n SCHEME"), (3, "grant_scheme"), (4, "égrant"), (5, "how to apply now open until lately")]
    for i in range(6, 1500):
        words = random.choices(pieces, k=random.randint(1, 8))
        rows.append((i, "".join(random.choice([w, w.upper(), w.title(), w + "s"]) + random.choice([" ", " ", " ", "  ", "\n", "-", "_", ".", ""]) for w in words)))
    docs = spark.createDataFrame(rows, "i int, text string").withColumn("found", v.found(F.col("text")))
    got = docs.select("i", *[v.has(F.col("found"), name).alias(name) for name in lists], *[F.col("text").rlike(any_word(own)).alias(f"{name}_want") for name, own in lists.items()]).collect()
    assert all(r[name] == r[f"{name}_want"] for r in got for name in lists)
    assert all(100 < sum(bool(r[name]) for r in got) < 1400 for name in lists)


def test_lists_that_cannot_match(spark):
    with pytest.raises(ValueError, match="plain words"):
        Vocabularies(a=("fine", "not-fine"))
    none, some = Vocabularies(a=()), Vocabularies(a=(), b=("word",))
    text = spark.createDataFrame([("a word",), ("",)], "text string")
    r = text.select(none.has(none.found(F.col("text")), "a").alias("x"), some.has(some.found(F.col("text")), "a").alias("y"), some.has(some.found(F.col("text")), "b").alias("z")).collect()
    assert [tuple(x) for x in r] == [(False, False, True), (False, False, False)]
