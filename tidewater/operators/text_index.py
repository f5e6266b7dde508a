"""Full-text search by an inverted index: stems to postings with positions, in segments sorted by term.

The index is a table with a row for each word of a slice of neighbouring texts (stem, word, the
texts' ids, the word's positions in each). Each task writes the slices of its part of the input
as a segment sorted by (stem, word), so nothing is shuffled, a very common term is spread over all
segments, and a query's terms are found by the files' and pages' statistics, so that only their
postings are read. What a Python worker holds at once are the postings of one slice. Words are
runs of letters, digits and apostrophes in lower case; positions count words over all of a row's
columns, with a gap between columns. scan() answers the same queries by reading every text and is
the index's yardstick.

Queries: any of the words, whatever their endings (stop words do not count); every "quoted
phrase", as whole words in a row without stemming; and none of the -words. A query of phrases
only needs all of them; one of -words or stop words only finds nothing. Where a query tells the
forms of a word, those spellings count in place of all that have its stem.

Odd cases: null columns are empty; rows with a null id cannot be found; rows that repeat an id
are one text for each, and the id is found once if any of them fits in all parts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.stemming import stem
from tidewater.operators.filters import SEARCH_STOPWORDS

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
#: Rows of a file of the index at most, bytes of its row groups, and characters of a slice, about.
ROWS, GROUP_BYTES, SLICE = 250_000, 8 << 20, 2_000_000
_GAP = 1 << 10


@dataclass(frozen=True)
class Query:
    stems: frozenset[str]
    phrases: tuple[tuple[str, ...], ...]
    banned: frozenset[str]
    #: Spellings that count as they are, of words whose forms are told.
    words: frozenset[str] = frozenset()
    banned_words: frozenset[str] = frozenset()

    @classmethod
    def of(cls, text: str, forms: Mapping[str, Sequence[str]] | None = None) -> Query:
        forms = forms or {}
        quoted = tuple(p for p in (tuple(words_of(q)) for q in re.findall(r'(?<!-)"([^"]*)"', text)) if p)
        rest = re.sub(r'"[^"]*"', " ", text).lower().split()
        some = lambda banned: [w for t in rest if t.startswith("-") == banned for w in words_of(t) if w not in SEARCH_STOPWORDS]
        stems = lambda asked: frozenset(stem(w) for w in asked if w not in forms)
        words = lambda asked: frozenset(f for w in asked for f in forms.get(w, ()))
        return cls(stems(some(False)), quoted, stems(some(True)), words(some(False)), words(some(True)))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _rows(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    texts = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), texts.alias("texts"))


def _numbering() -> defaultdict[str, int]:
    """Words to numbers, in order of their first mention (a counter, since a bound __len__ would be a cycle that lives until a collection)."""
    return defaultdict(count().__next__)


def _packed(batch: pa.RecordBatch, begin: int, vocabulary: Sequence[str], texts: Sequence[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A row for each word of a slice: the words' numbers and positions in each of its texts, which are a batch's rows from begin, grouped by word."""
    numbers, positions = (np.concatenate(parts) for parts in zip(*texts, strict=True))
    order = np.argsort(numbers, kind="stable")  # texts and positions of a word stay in order
    numbers, positions, at = numbers[order], positions[order], np.repeat(np.arange(len(texts), dtype=np.int32), [len(n) for n, _ in texts])[order]
    first = np.flatnonzero(np.diff(numbers, prepend=-1) | np.diff(at, prepend=-1))  # of a word in a text
    words = np.flatnonzero(np.diff(numbers[first], prepend=-1))
    ends = np.append(first[1:], len(numbers)) - np.repeat(first[words], np.diff(words, append=len(first)))
    lists = lambda begins, size, values: pa.ListArray.from_arrays(pa.array(np.append(begins, size), pa.int32()), values)
    by_text = lambda values: lists(words, len(first), values)
    columns = {
        "stem": pa.array(map(stem, vocabulary), pa.string()), "word": pa.array(vocabulary, pa.string()), "row": pa.array([batch.column("row")[begin].as_py()] * len(words), pa.int64()), "at": by_text(pa.array(at[first])),
        "ids": by_text(batch.column("id").take(pa.array(at[first] + begin))), "ends": by_text(pa.array(ends, pa.int32())), "positions": lists(first[words], len(positions), pa.array(positions)),
    }
    return pa.RecordBatch.from_pydict(columns)


def postings(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(stem, word, row, at, ids, ends, positions): where each word is in each slice of neighbouring rows.

    row + at[k] is the row that the word is in, which tells rows of one id apart, ids[k] its id;
    the positions up to ends[k], from the end before, are the word's positions there.
    """
    rows = _rows(df, key, columns).withColumn("row", F.monotonically_increasing_id())
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size, numbers, texts = 0, 0, _numbering(), []
            for i, own in enumerate(batch.column("texts")):
                words, starts, at = [], [], 0
                for text in own.as_py():
                    found = words_of(text)
                    words += found
                    starts.append(np.arange(at, at + len(found), dtype=np.int32))
                    at += len(found) + _GAP
                    size += len(text)
                texts.append((np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)), np.concatenate(starts)))
                if size >= SLICE or i + 1 == batch.num_rows:
                    if numbers:
                        yield _packed(batch, begin, list(numbers), texts)
                    begin, size, numbers, texts = i + 1, 0, _numbering(), []

    return rows.mapInArrow(run, f"stem string, word string, row long, at array<int>, ids array<{kind}>, ends array<int>, positions array<int>")


class TextIndex:
    """A written index; search() reads the postings of a query's words only."""

    def __init__(self, table: DataFrame):
        self.table = table

    @classmethod
    def write(cls, df: DataFrame, key: str, columns: Sequence[str], path: str, per_range: int = ROWS) -> TextIndex:
        """Build the index of a table's columns under path; per_range: rows of a file, each of which is a range of a segment's terms."""
        made = postings(df, key, columns).sortWithinPartitions("stem", "word", "row")
        made.write.options(maxRecordsPerFile=per_range, compression="zstd", **{"parquet.block.size": GROUP_BYTES}).parquet(f"{path}/index")
        return cls.open(df.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TextIndex:
        return cls(spark.read.parquet(f"{path}/index"))

    def _of(self, stems, words=()) -> DataFrame:
        """The postings of stems, and those of words as they are spelled."""
        whole = F.col("stem").isin(sorted(stems))
        spelled = F.col("stem").isin(sorted({stem(w) for w in words})) & F.col("word").isin(sorted(words))
        return self.table.where((whole | spelled if stems else spelled) if words else whole)

    def _rows(self, stems, words=()) -> DataFrame:
        """(id, row) of the rows with any of stems or words."""
        own = self._of(stems, words).select("row", F.explode(F.arrays_zip("ids", "at")).alias("own"))
        return own.select(F.col("own.ids").alias("id"), (F.col("row") + F.col("own.at")).alias("row")).distinct()

    def _with_phrase(self, phrase: tuple[str, ...]) -> DataFrame:
        """(row) of the rows that hold the words in a row: each word of a slice tells where the phrase would begin, and all have to agree."""
        at = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(i).alias("i")) for i, w in enumerate(phrase)))
        told = self._of((), set(phrase)).withColumn("p", F.explode(F.filter(at, lambda x: x["word"] == F.col("word"))))
        end = lambda k: F.coalesce(F.get("ends", k), F.lit(0))
        begins = lambda a, k: F.transform(F.slice("positions", end(k - 1) + 1, end(k) - end(k - 1)), lambda x: F.shiftleft(a.cast("long"), 32) + x - F.col("p.i"))
        slices = told.select("row", F.flatten(F.transform("at", begins)).alias("begins")).groupBy("row").agg(F.collect_list("begins").alias("b"))
        agreed = reduce(F.array_intersect, [F.get("b", F.lit(i)) for i in range(len(phrase))])
        found = slices.where(F.size("b") == len(phrase)).select("row", F.explode(F.array_distinct(F.transform(agreed, lambda x: F.shiftright(x, 32)))).alias("at"))
        return found.select((F.col("row") + F.col("at")).alias("row"))

    def search(self, text: str, forms: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
        """(id) of what a query finds; forms: the spellings that count for a word of the query."""
        q = Query.of(text, forms)
        if q.stems or q.words:
            found = self._rows(q.stems, q.words)
        elif q.phrases:
            found = self._rows((), q.phrases[0][:1])
        else:
            return self.table.where(F.lit(False)).select(F.explode("ids").alias("id"))
        for phrase in q.phrases:
            found = found.join(self._with_phrase(phrase), "row", "left_semi")
        if q.banned or q.banned_words:
            found = found.join(self._rows(q.banned, q.banned_words), "row", "left_anti")
        return found.select("id").distinct()


def scan(df: DataFrame, key: str, columns: Sequence[str], text: str, forms: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(id) of what a query finds, by reading every text."""
    q = Query.of(text, forms)
    asked = bool(q.stems or q.words)

    @F.pandas_udf("boolean")
    def fits(texts: pd.Series) -> pd.Series:
        def one(own) -> bool:
            words = [words_of(t) for t in own]
            spelled = {w for ws in words for w in ws}
            stems = {stem(w) for w in spelled}
            phrased = all(any(tuple(ws[i : i + len(p)]) == p for ws in words for i in range(len(ws) - len(p) + 1)) for p in q.phrases)
            fitting = not asked or bool(stems & q.stems or spelled & q.words)
            return (asked or bool(q.phrases)) and fitting and phrased and not stems & q.banned and not spelled & q.banned_words

        return pd.Series([one(t) for t in texts])

    found: Column = fits("texts")
    return _rows(df, key, columns).where(found).select("id").distinct()
