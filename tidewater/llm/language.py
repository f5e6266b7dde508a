"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is lower-cased, everything but letters becomes a space, runs of spaces become
one, and every 1- to 4-byte window (windows with a space inside are left out) is hashed
into one of BUCKETS embeddings. The text's vector is their mean; a linear softmax over
it gives the language. Embeddings and softmax are trained together by stochastic
gradient descent in numpy, on a bounded sample.

A part of the sample that is not trained on calibrates the model. It sets the softmax
temperature, so the score is the probability of being right, and two bounds below which
a text is rejected as none of the languages:

- the score that all but REJECTED_SHARE of held-back texts reach, texts that mix two or
  three of the languages among them;
- the share of a text's 3- and 4-byte windows that were met in training. A softmax is as
  sure of a foreign text as of a known one, so this share tells them apart: the bound lies halfway
  between what all but REJECTED_SHARE of the held-back texts reach and the median of
  negatives, which are the same texts with the letters of each word in another order.
  A short text gets the further allowance that chance needs (SIGMAS).

As the mean, the softmax and the share are all linear, prediction adds up one row of
numbers for each window: buckets x (languages + 1) numbers are all that executors need.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import words
from tidewater.llm.storage import place_of

BUCKETS, DIM = 1 << 16, 16
ORDERS = (1, 2, 3, 4)
#: Windows from this length on tell known texts from foreign ones; shorter ones occur in all.
TELLING = 3
#: The training sample's bounds: documents per language, characters of one of them, characters of a language, and languages. In all
#: it has at most TOTAL_CHARS, as the languages share them.
SAMPLE, SAMPLE_CHARS, LANGUAGE_CHARS, LANGUAGES, TOTAL_CHARS = 600, 200_000, 8_000_000, 200, 120_000_000
#: At most this share of held-back texts is rejected.
REJECTED_SHARE = 0.001
#: Standard deviations that chance may take from a short text's share of known windows.
SIGMAS = 3.0
#: Texts made of two or three languages for the calibration.
MIXTURES = 1000

_LETTER = np.zeros(256, np.uint8)
_LETTER[:] = 32
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_TABLE = _LETTER.tobytes()
_GAPS = re.compile(rb" {2,}")
_MAYBE_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIER = np.uint32(2654435761)


def has_letter(text: str) -> bool:
    """Whether a text has a letter; signs as ½, ① or Ⅷ are none."""
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def normalise(text: str) -> bytes:
    """Lower-case letters with single spaces between and around words."""
    return b" " + _GAPS.sub(b" ", text.lower().encode("utf-8", "surrogatepass").translate(_TABLE)).strip() + b" "


def _windows(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-byte window at each position, and whether it counts (no space inside)."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    code = np.zeros(size, np.uint32)
    for j in range(n):
        code = (code << np.uint32(8)) | data[j : j + size]
    with np.errstate(over="ignore"):
        bucket = ((code ^ (code >> np.uint32(15))) * _MULTIPLIER + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * _MULTIPLIER
    space = data == 32
    inside = np.zeros(size, bool) if n > 1 else space[:size].copy()
    for j in range(1, n - 1):
        inside |= space[j : j + size]
    return bucket >> np.uint32(32 - 16), ~inside


def features(text: bytes, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a normalised text and the share of its windows in each."""
    data = np.frombuffer(text, np.uint8)
    found = [b[ok] for b, ok in (_windows(data, n) for n in orders)]
    buckets, counts = np.unique(np.concatenate(found), return_counts=True)
    return buckets, (counts / max(1, counts.sum())).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """languages: in code point order. table: for each bucket its class scores, and 1 if training met it, else 0.

    floor: the least score, and known: the least share of known windows, that are not
    rejected. errors: the share of the calibration's texts that these reject, and the
    share of its negatives that they let pass.
    """

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    floor: float = 0.0
    known: float = 0.0
    errors: tuple[float, float] = (0.0, 1.0)

    def sums(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums of the table's rows over the windows of each normalised text, numbers of windows, numbers of telling ones); the last column sums telling windows only."""
        lengths = np.array([len(t) for t in texts], np.int64)
        total = np.zeros((len(texts), self.table.shape[1]))
        weight, telling = np.zeros(len(texts)), np.zeros(len(texts))
        for a, b in words.spans(lengths, words.SLICE // 4):
            data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
            at = np.concatenate([[0], np.cumsum(lengths[a:b])])
            for lo in range(0, len(data), words.SLICE):  # more than one turn for a very long text only
                part = data[lo : lo + words.SLICE + max(ORDERS) - 1]
                for n in ORDERS:
                    bucket, ok = _windows(part, n)
                    bucket, ok = bucket[: words.SLICE], ok[: words.SLICE]
                    # windows that reach into the next text do not count
                    text = np.searchsorted(at, np.arange(lo, lo + len(bucket)), "right") - 1 if b - a > 1 else None
                    if text is not None:
                        ok &= np.arange(lo, lo + len(bucket)) + n <= at[text + 1]
                        owner = text[ok]
                    else:
                        owner = np.zeros(int(ok.sum()), np.int64)
                    rows = self.table[bucket[ok]]
                    for c in range(rows.shape[1] - (n < TELLING)):
                        total[a:b, c] += np.bincount(owner, rows[:, c], b - a)
                    windows = np.bincount(owner, minlength=b - a)
                    weight[a:b] += windows
                    telling[a:b] += windows if n >= TELLING else 0
        return total, weight, telling

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Class scores of normalised texts (not calibrated)."""
        return self._logits(*self.sums(texts)[:2])

    def _logits(self, total: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return total[:, : len(self.bias)] / np.maximum(weight, 1)[:, None] + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)

    def judged(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(scores of normalised texts, whether each is rejected)."""
        total, weight, telling = self.sums(texts)
        scores = softmax(self._logits(total, weight) / self.temperature)
        return scores, (scores.max(axis=1) < self.floor) | (_most_known(total[:, -1], telling) < self.known)


def _most_known(met: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The share of known windows with what chance may have taken from it added; 1 for a text without windows."""
    n = np.maximum(windows, 1)
    share = np.where(windows > 0, met / n, 1.0)
    return share + SIGMAS * np.sqrt(np.maximum(share * (1 - share), 1 / n) / n)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 5, epochs: int = 8, rate: float = 1.0) -> Model:
    """Fit a model; a fifth of the texts calibrates it. One language or no text: a constant model that rejects nothing."""
    languages = tuple(sorted(set(labels)))
    k = len(languages)
    rng = np.random.Generator(np.random.PCG64(seed))
    if k < 2:
        return Model(languages, np.zeros((BUCKETS, max(k, 1) + 1), np.float32), np.zeros(max(k, 1)))
    cleaned = [normalise(t) for t in texts]
    order = rng.permutation(len(texts))
    held = set(order[: len(order) // 5].tolist()) if len(order) >= 20 else set()
    target = [languages.index(y) for y in labels]
    examples = []
    met = np.zeros(BUCKETS, bool)
    for i in order.tolist():
        if i not in held:
            examples.append((*features(cleaned[i]), target[i]))
            met[features(cleaned[i], ORDERS[TELLING - 1 :])[0]] = True
            if len(cleaned[i]) > 120:  # a short piece too, for the model meets short texts
                at = int(rng.integers(0, len(cleaned[i]) - 60))
                examples.append((*features(cleaned[i][at : at + int(rng.integers(20, 60))]), target[i]))
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    softmax_rows, intercept = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    steps, step = epochs * len(examples), 0
    for _ in range(epochs):
        for e in rng.permutation(len(examples)).tolist():
            buckets, share, y = examples[e]
            own = vectors[buckets]
            mean = share @ own
            wrong = softmax(mean @ softmax_rows + intercept)
            wrong[y] -= 1
            pace = rate * (1 - step / steps)
            back = softmax_rows @ wrong
            softmax_rows -= pace * np.outer(mean, wrong)
            intercept -= pace * 0.1 * wrong
            # all windows of a text pull with the weight of the text, as in averaged embeddings
            vectors[buckets] = own - (pace * 20) * np.outer(share, back)
            step += 1
    table = np.column_stack([vectors @ softmax_rows, met]).astype(np.float32)
    return _calibrate(Model(languages, table, intercept.astype(float)), cleaned, target, sorted(held) or list(range(len(texts))), rng)


def _piece(text: bytes, longest: int, rng: np.random.Generator) -> bytes:
    at = int(rng.integers(0, max(1, len(text) - longest // 3)))
    return text[at : at + int(rng.integers(longest // 6 + 1, longest + 1))].strip()


def _mixtures(texts: list[bytes], truth: list[int], n: int, rng: np.random.Generator) -> list[bytes]:
    """Texts put together of pieces from two or three of the languages."""
    by_language = [[t for t, y in zip(texts, truth, strict=True) if y == language] for language in sorted(set(truth))]
    out = []
    for _ in range(n if len(by_language) > 1 else 0):
        chosen = rng.permutation(len(by_language))[: int(rng.integers(2, 4))]
        parts = [_piece(by_language[c][int(rng.integers(len(by_language[c])))], 1200, rng) for c in chosen]
        out.append(b" " + b" ".join(p for p in parts if p) + b" ")
    return out


def _scrambled(text: bytes, rng: np.random.Generator) -> bytes:
    """A text with the letters of each word in another order."""
    return b" " + b" ".join(rng.permutation(np.frombuffer(w, np.uint8)).tobytes() for w in text.split()) + b" "


def _calibrate(model: Model, cleaned: list[bytes], target: list[int], held: list[int], rng: np.random.Generator) -> Model:
    """Choose the temperature by likelihood, and the bounds of rejection by quantiles over texts that are to stay and negatives."""
    texts, truth = [cleaned[i] for i in held], [target[i] for i in held]
    whole = texts[:]
    for i in held:  # scores have to be right for texts of a few words as well
        for _ in range(3):
            piece = _piece(cleaned[i], 39, rng)
            if piece:
                texts.append(b" " + piece + b" ")
                truth.append(target[i])
    mixtures = _mixtures(whole, truth[: len(whole)], MIXTURES, rng)
    truth = np.array(truth)
    logits = model.logits(texts)
    doubt = 1 / (len(truth) + 2)  # all right in the sample does not mean never wrong
    rest = doubt / len(model.languages)

    def loss(t: float) -> float:
        p = np.log(np.maximum(softmax(logits / t), 1e-300))
        return -((1 - doubt) * p[np.arange(len(truth)), truth] + rest * p.sum(axis=1)).mean()

    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 60))
    temperature = float(min(grid, key=loss))
    stay = texts + mixtures
    low = lambda values: float(np.sort(values)[int(REJECTED_SHARE * len(values))])
    total, weight, telling = model.sums(stay)
    floor = low(softmax(model._logits(total, weight) / temperature).max(axis=1))
    kept = low(_most_known(total[:, -1], telling))
    negatives = [_scrambled(t, rng) for t in whole]
    met, _, size = model.sums(negatives)
    other = float(np.median(_most_known(met[:, -1], size)))
    known = (kept + other) / 2 if other < kept else kept
    done = Model(model.languages, model.table, model.bias, temperature, floor, known)
    return replace(done, errors=(float(done.judged(stay)[1].mean()), float(1 - done.judged(negatives)[1].mean())))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = SAMPLE) -> tuple[list[str], list[str]]:
    """At most per_language labelled texts of each language from the rows that are not held out, as lists on the driver.

    Rows are taken by a hash of doc_id and text, the least first, so every part of the table
    can give some and the same table gives the same rows, and texts with copies come once
    before any copy fills up; rows without doc_id or letters are not in the sample, nor are
    texts of over SAMPLE_CHARS characters. A language's texts end
    at LANGUAGE_CHARS in all (less where many languages share TOTAL_CHARS). Languages beyond
    LANGUAGES raise an error.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return [], []
    size = F.length("text")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30)).alias("draw")
    # about twice as many as needed, so that the sort below has few rows however large the table is
    share = {r["lang"]: min(1 << 30, int((1 << 30) * 2.0 * (per_language + 50) / r["count"])) for r in sizes}
    limit = F.element_at(F.create_map(*[x for lang, s in share.items() for x in (F.lit(lang), F.lit(s))]), F.col("lang"))
    chosen = known.where((size <= SAMPLE_CHARS) & F.col("text").rlike(r"\p{L}")).select("lang", "text", draw).where(F.col("draw") < limit)
    chosen = chosen.withColumn("copy", F.row_number().over(Window.partitionBy("lang", "text").orderBy("draw")))
    of_language = Window.partitionBy("lang").orderBy("copy", "draw", "text")
    chosen = chosen.withColumn("place", F.row_number().over(of_language)).where(F.col("place") <= per_language)
    chosen = chosen.withColumn("upto", F.sum(size).over(of_language.rowsBetween(Window.unboundedPreceding, 0)))
    rows = chosen.where(F.col("upto") <= min(LANGUAGE_CHARS, TOTAL_CHARS // len(sizes))).select("lang", "text", "place").collect()
    rows.sort(key=lambda r: (r["lang"], r["place"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def fit(docs: DataFrame, per_language: int = SAMPLE) -> Model:
    return train(*training_sample(docs, per_language))


def _judged(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    plain = texts.fill_null("").to_pylist()
    langs, score, rejected = np.full(len(plain), "und", object), np.zeros(len(plain)), np.ones(len(plain), bool)
    at = np.flatnonzero(np.array([has_letter(t) for t in plain], bool))
    if len(at) and model.languages:
        odds, out = model.judged([normalise(plain[i]) for i in at])
        best = odds.argmax(axis=1)
        langs[at] = np.array(model.languages, object)[best]
        score[at], rejected[at] = odds[np.arange(len(at)), best], out
    return langs.tolist(), score, rejected


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row; lang_pred is `und` for null texts and texts without letters.

    score is the calibrated probability of lang_pred (0 for `und`); rejected tells texts
    that fit none of the languages, `und` among them. Very long texts are read whole, in
    slices. Repeated rows repeat; an empty table gives none; other columns are ignored.
    A model without languages (an empty table) gives `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x (languages + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, rejected = _judged(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is one of the learned ones, unchanged, with all columns.

    Null, empty and letterless texts go; repeated rows stay or go together; an empty table
    stays empty. The column is found as Spark finds it, so it may be called Text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = place_of(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, rejected = _judged(shared.value, batch.column(place))
            yield batch.filter(pc.invert(pa.array(rejected)))

    return docs.mapInArrow(run, docs.schema)
