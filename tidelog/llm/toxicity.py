"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic text and one on ordinary text; a window (one word, lower
case, with a closing marker that both dictionaries know, so that a match inside the window shows at once in
the length) is compressed with both, and the difference of the lengths is the window's toxicity.  A document's
score is a logistic function, calibrated on labelled documents that the dictionaries have not seen, of how
many of its windows lie beyond each of several thresholds.

The toxic dictionary's samples are the words of toxic documents that carry the class: words with a prefix
whose document frequency in the two classes differs by a likelihood ratio of ``least_g2``.  All else of a
toxic document is ordinary text.  A word under 4 bytes counts as a whole.  Without this choice of samples the
method does not separate the classes (README, with figures); words are judged by their first 10 bytes, and
phrases of words that are harmless alone are not seen.

Learning uses a bounded sample of labelled rows (``most_toxic``, ``most_ordinary`` documents of at most
``most_chars`` characters, by hash of the id, one row an id: 180 million characters at the very most) on the
driver; scoring runs over whole texts where they lie.

Defined results: a null or empty text is scored like a text with one plain window; rows without an id are
scored and never learned from; label rows without an id or label are ignored, an id with both labels counts
as toxic; repeated rows are scored each; without both classes in the sample every score is 0; other columns
of the input pass through :func:`reject`.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, workers

MARK = b" \x01window of the text\x02"
_LIMITS = (2, 3, 4, 5)
_FIT_ROUNDS = 60


def split_rest(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows where this is 1 are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _prefixes(word: bytes) -> list[bytes]:
    return [word[:n] for n in range(4, min(len(word), 10) + 1)] or [word + b" "]


def _g2(a: int, b: int, n1: int, n0: int) -> float:
    """Likelihood ratio of document frequencies a of n1 and b of n0."""

    def ll(k: int, n: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    p = (a + b) / (n1 + n0)
    return 2 * (ll(a, n1, a / n1) + ll(b, n0, b / n0) - ll(a, n1, p) - ll(b, n0, p))


@dataclass(frozen=True)
class Model:
    """Two dictionaries, how to read them, and the calibration."""

    toxic: bytes
    ordinary: bytes
    level: int
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    low: tuple[float, ...] = (-3.0,) * 8
    high: tuple[float, ...] = (3.0,) * 8
    known: bool = True


class _Windows:
    """Length differences of windows; those of short words are remembered, up to ``most`` of them."""

    def __init__(self, model: Model, most: int = 200_000):
        import zstandard

        def compressor(data: bytes):
            kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            return zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.toxic, self.ordinary, self.known, self.most = compressor(model.toxic), compressor(model.ordinary), {}, most

    def differences(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        long = {}
        for w in set(words).difference(self.known):
            window = b" " + w + MARK
            (self.known if len(w) <= 64 else long)[w] = max(-100, min(100, len(self.ordinary(window)) - len(self.toxic(window))))
        if long:
            return np.array([self.known[w] if w in self.known else long[w] for w in words], np.int8)
        return np.fromiter(map(self.known.__getitem__, words), np.int8, len(words))


def _features(windows: _Windows, text: str | None) -> list[float]:
    d = windows.differences(_words(text))
    counts = [int((d >= t).sum()) for t in _LIMITS]
    return [math.log((k + 0.3) / (len(d) + 60)) for k in counts] + [math.log1p(k) for k in counts]


def _design(features: np.ndarray, model: Model) -> np.ndarray:
    """Scaled features and their squares, held within what calibration has seen, so that nothing is extrapolated."""
    z = np.clip((features - np.array(model.mean)) / np.array(model.scale), model.low, model.high)
    return np.hstack([z, z * z, np.ones((len(z), 1))])


def _probability(features: np.ndarray, model: Model) -> np.ndarray:
    if not model.known:
        return np.zeros(len(features))
    return 1 / (1 + np.exp(-np.clip(_design(features, model) @ np.array(model.weights), -40, 40)))


def _dictionary(samples: list[bytes], size: int, level: int) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6, level=level).as_bytes() + MARK
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] + MARK


def train(toxic: list[str], ordinary: list[str], *, size: int = 4096, level: int = 3, least_g2: float = 14.0) -> Model:
    """A model from two lists of texts; half of each trains the dictionaries, the other half calibrates."""
    none = Model(MARK, MARK, level, (0.0,) * 8, (1.0,) * 8, (0.0,) * 17, known=False)
    if len(toxic) < 2 or len(ordinary) < 2:
        return none
    one: dict[bytes, bytes] = {}  # equal words are one object
    p, n = ([[one.setdefault(w, w) for w in _words(t)] for t in texts[0::2]] for texts in (toxic, ordinary))
    in_p, in_n = Counter(), Counter()
    for texts, counts in ((p, in_p), (n, in_n)):
        for words in texts:
            counts.update({x for w in set(words) for x in _prefixes(w)})
    telling = {x for x, a in in_p.items() if a >= 3 and a / len(p) > 2.5 * (in_n[x] + 0.5) / len(n) and _g2(a, in_n[x], len(p), len(n)) > least_g2}
    carries = lambda w: any(x in telling for x in _prefixes(w))
    bad = [x for words in p if len(x := b" " + b"  ".join(w for w in words if carries(w)) + b" ") > 8]
    good = [b" " + b"  ".join(w for w in words if not carries(w)) + b" " for words in n]
    model = Model(_dictionary(bad, size, level), _dictionary(good, size, level), level, none.mean, none.scale, none.weights)
    windows, rest = _Windows(model), [*((t, 1.0) for t in toxic[1::2]), *((t, 0.0) for t in ordinary[1::2])]
    x, y = np.array([_features(windows, t) for t, _ in rest]), np.array([v for _, v in rest])
    model = Model(model.toxic, model.ordinary, level, tuple(x.mean(0)), tuple(x.std(0) + 1e-9), none.weights)
    ends = np.clip((x - x.mean(0)) / np.array(model.scale), -3, 3)
    model = replace(model, low=tuple(ends.min(0)), high=tuple(ends.max(0)))
    z, w = _design(x, model), np.zeros(17)
    for _ in range(_FIT_ROUNDS):  # ridge-penalised logistic regression by Newton's method
        q = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        w = w + np.linalg.solve(z.T @ (z * (q * (1 - q))[:, None]) + np.eye(17), z.T @ (y - q) - w)
    return replace(model, weights=tuple(w))


def fit(docs: DataFrame, labels: DataFrame, *, most_toxic: int = 3000, most_ordinary: int = 6000, most_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> Model:
    """Learn from labelled rows that are not held out; only the bounded sample comes to the driver."""
    workers.small_batches(docs.sparkSession)
    marks = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id IS NOT NULL AND __y IS NOT NULL").where(split_rest(F.col("__id")) != 1).groupBy("__id").agg(F.max("__y").alias("__y"))
    chosen = [marks.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(n) for y, n in ((1, most_toxic), (0, most_ordinary))]
    ids = F.broadcast(chosen[0].union(chosen[1]))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("t")).where(F.length(F.coalesce("t", F.lit(""))) <= most_chars).join(ids, "__id").groupBy("__id", "__y").agg(F.max("t").alias("t")).collect()
    rows = sorted((zlib.crc32(str(r[0]).encode()), r[0], r["t"] or "", r["__y"]) for r in rows)
    try:
        return train([t for *_, t, y in rows if y == 1][:most_toxic], [t for *_, t, y in rows if y == 0][:most_ordinary], **options)
    finally:  # the sample was the driver's largest holding, in Python and in the JVM that gathered it
        del rows
        store.let_go(docs.sparkSession)
        workers.give_back()


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Per row: doc_id, held_out, score from 0 to 1 (higher: toxic is likelier), predicted (1 if score >= threshold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(model)
        for batch in batches:
            found = np.array([_features(windows, t) for t in batch.column(1).to_pylist()]).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_probability(found, model))], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(workers.tidy(run), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(split_rest(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they were."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(model)
        for batch in batches:
            found = np.array([_features(windows, t) for t in batch.column(place).to_pylist()]).reshape(-1, 8)
            yield batch.filter(pa.array(_probability(found, model) < threshold))

    return docs.mapInArrow(workers.tidy(run), docs.schema)
