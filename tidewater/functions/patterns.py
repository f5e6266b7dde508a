"""Regular expressions with ASCII word boundaries, which Java's engine lacks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_W = "[A-Za-z0-9_]"
#: Between an ASCII word character and anything else.
EDGE = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def ascii_edges(pattern: str) -> str:
    """The pattern with every \\b read as an ASCII word boundary."""
    return pattern.replace(r"\b", EDGE)


def any_word(words: list[str] | tuple[str, ...], ignore_case: bool = True) -> str:
    """A pattern for any of the phrases as whole words; a phrase's spaces match any white space."""
    phrases = "|".join(w.replace(" ", r"\s+") for w in words)
    return ("(?i)" if ignore_case else "") + rf"(?<!{_W})(?:{phrases})(?!{_W})"


def whole_words(pattern: str) -> str:
    """A pattern for any of alternatives that all begin with a word character, between ASCII word boundaries, whatever the case; what comes before is one look back."""
    return rf"(?i)(?<!{_W})(?:{ascii_edges(pattern)}){EDGE}"


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns in a projection of their own; what follows reads them by name and does not repeat what they are made of."""
    return df.withColumns(columns)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that is heavy for each row; tables of more partitions stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """df in turn over four tasks a core, for rows that each take long, however few or small they are."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f reads it."""
    return F.transform(F.array(value), f)[0]


def once_for_copies(df: DataFrame, inputs: Sequence[str], add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that add() makes out of the columns inputs (texts, or arrays of them) alone; rows of equal inputs are worked on once.

    Distinct inputs are dealt over all tasks and joined back by their SHA-256, so heavy work
    grows with the different inputs. df is read twice. Streams are worked on row by row.
    """
    if df.isStreaming:
        return add(df)
    keyed = df.withColumn("_once", F.sha2(F.to_json(F.struct(*inputs)), 256))
    made = add(keyed.select("_once", *inputs).distinct())
    return keyed.join(made.select("_once", *[n for n in made.columns if n not in keyed.columns]), "_once").drop("_once")
