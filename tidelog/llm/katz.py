"""A word-bigram language model with Katz backoff, counted from the corpus it scores.

Seen bigrams get Good-Turing discounted counts (counts above :data:`K` are taken as they are); what the
discounts free goes to the words not seen after a context, in proportion to their own discounted unigram
probability, with a backoff weight that makes every context's probabilities add up to exactly one::

    P(w|h) = d2(c(h,w)) c(h,w) / c(h)              if c(h,w) > 0
           = alpha(h) P(w)                          otherwise; alpha(h) = 1 for a context never seen
    alpha(h) = (1 - sum of seen P(w|h)) / (1 - sum of P(w) over words seen after h)
    P(w) = d1(c(w)) c(w) / N, and P(unknown) = what the discounts of unigrams leave

All unknown words are one outcome, as in the base score.  A text's tokens are its words and one end; the first
token's context is a begin mark.  From the first count on whose Good-Turing discount leaves (0, 1), counts of
counts are taken from a log-linear fit (Simple Good-Turing); the counts below it keep their own.  Only where the
fit does not fall faster than 1/c, so that no Good-Turing discount exists, absolute discounting (at most 0.75)
stands in; where no count is K or below, one count is added to the total and freed.

Nothing of the corpus is gathered in one place.  Blocks of documents ask buckets of words, then buckets of
bigrams, with sorted key lists (see ``exchange``); buckets add up the counts, keep them as a table partitioned
by kind and bucket, and answer with counts and with what backoff weights are made of.  A context that is
counted very often is spread over several buckets; its sums, at most :data:`HOT` of them, meet on the driver.

Defined results: a null or empty text is the end token alone; rows without an id are learned from; repeated
rows are learned from each time; without any training text every probability is 1 (all words are unknown);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, workers
from .exchange import gaps, pack, slices, sums, unpack
from .words import mix, pieces, word_hashes

K = 5
#: Contexts that may be spread over buckets, at most.
HOT = 100_000
WORDS_A_BUCKET = 1 << 20
TOKENS_A_BUCKET = 1 << 21
_END = np.uint64(0x0D0C5E7D0C5E7D01)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _slope(n: list[int]) -> float:
    """Slope of log n[c] over log c, with n[c] averaged over the empty counts around it; 0 if it can't be fitted."""
    c = np.flatnonzero(np.array(n[: K + 2]) * (np.arange(K + 2) > 0))
    if len(c) < 2:
        return 0.0
    before, after = np.concatenate(([0], c[:-1])), np.append(c[1:], 2 * c[-1] - c[-2])
    x, y = np.log(c), np.log(2 * np.array(n, float)[c] / (after - before))
    x = x - x.mean()
    return float((x * y).sum() / (x * x).sum())


def discounts(n: list[int], total: int) -> tuple[np.ndarray, float]:
    """(d, left): d[c] for counts 0 to K + 1 (the last for all above K) from counts of counts n[1..K+1].

    1 - d[c] is in proportion to 1 - c*/c, where c* is the Good-Turing count, and all discounts free n[1] counts.
    As many of the lowest counts as possible take c* from their own n, the others from the log-linear fit.
    ``left`` is the share of ``total`` that the discounts free; 1 if total is 0.
    """
    d, c, slope = np.ones(K + 2), np.arange(1, K + 1), _slope(n)
    own = np.array([(i + 1) * n[i + 1] / (i * n[i]) if n[i] and n[i + 1] else np.inf for i in range(1, K + 1)])
    fitted = ((c + 1) / c) ** (slope + 1)
    for first in range(K, -1, -1):  # counts above ``first`` are fitted
        rest = 1 - np.where(c <= first, own, fitted)
        freed = float((rest * c * np.array(n[1 : K + 1])).sum()) if np.isfinite(rest).all() else 0.0
        if freed > 0:
            d[1 : K + 1] = 1 - n[1] / freed * rest
            if ((d[1 : K + 1] > 0) & (d[1 : K + 1] < 1)).all():
                break
    else:
        common = float(K + 1) ** (slope + 1)
        if slope < -1:
            d[1 : K + 1] = (fitted - common) / (1 - common)
        else:
            cut = min(0.75, max(0.05, n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5))
            d[1 : K + 1] = 1 - cut / c
    return d, float(sum((1 - d[c]) * c * n[c] for c in range(1, K + 1)) / total) if total else 1.0


def _discounted(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return d[np.minimum(counts, K + 1).astype(np.int64)] * counts


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, K + 2).astype(np.int64), minlength=K + 3)[: K + 2]


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def _build(keys: list[int | None], texts: list[bytes]) -> tuple:
    parts = [word_hashes(texts[s:e]) for s, e in pieces([len(t) for t in texts], 1 << 20)]
    words, sizes = np.concatenate([w for w, _ in parts]), np.concatenate([np.diff(at) for _, at in parts]) + 1
    ends = np.cumsum(sizes)
    tokens = np.full(int(ends[-1]), _END, np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[ends - 1] = False
    tokens[inner] = words
    vocabulary, local = np.unique(tokens, return_inverse=True)
    train = np.array([not held_out(k) for k in keys])
    counts = np.bincount(local[np.repeat(train, sizes)], minlength=len(vocabulary))
    ids = np.array([k or 0 for k in keys], np.int64).view(np.uint64)
    docs = pack(ids, np.array([k is None for k in keys], np.uint8), sizes, train.astype(np.uint8))
    return len(tokens), len(vocabulary), int(train.sum()), pack(gaps(vocabulary), counts), pack(local), docs


def _by_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets 0 to n - 1, non-decreasing with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class _Words:
    """A block's tokens as global word ids with counts, from its state and the word buckets' answers."""

    def __init__(self, tokens: bytes, docs: bytes, answers: list[dict], first: np.ndarray):
        parts = [(r["bucket"], unpack(r["payload"])) for r in sorted(answers, key=lambda r: r["bucket"])]
        ids = np.concatenate([sums(x[0]).astype(np.int64) + first[b] for b, x in parts])
        counts = np.concatenate([x[1].astype(np.int64) for _, x in parts])
        local = unpack(tokens)[0].astype(np.int64)
        self.doc_ids, self.null, sizes, self.train = unpack(docs)
        self.sizes = sizes.astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.count = counts[local]
        context = np.concatenate(([0], local[:-1]))
        begin = len(ids)  # the begin mark, only ever a context
        context[self.starts] = begin
        keys = context * (begin + 1) + local
        keys, self.pair = np.unique(keys, return_inverse=True)
        h, w = keys // (begin + 1), keys % (begin + 1)
        self.h, self.w = np.append(ids, first[-1])[h], ids[w]
        self.h_count, self.w_count = np.append(counts, -1)[h], counts[w]

    def in_buckets(self, n: int, spread: int, begin_count: int) -> np.ndarray:
        """Sorts pairs by bucket, context and word; returns the buckets."""
        self.h_count = np.where(self.h_count < 0, begin_count, self.h_count)
        parts = (1 + self.h_count // spread).astype(np.uint64)
        bucket = (mix(mix(self.h.astype(np.uint64) + np.uint64(1)) + self.w.astype(np.uint64) % parts) % np.uint64(n)).astype(np.int64)
        order = np.lexsort((self.w, self.h, bucket))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        self.pair = back[self.pair]
        self.h, self.w, self.h_count, self.w_count = (x[order] for x in (self.h, self.w, self.h_count, self.w_count))
        return bucket[order]


def _joined(table: DataFrame, *columns: DataFrame) -> DataFrame:
    for c in columns:
        table = table.join(c, "block")
    return table


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs`` the columns of :data:`SCHEMA`; the model is learned from the rows not held out."""
    plain = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    state = exchange.blocks(plain, _build, "n_tokens long, n_words long, n_train long, words binary, tokens binary, docs binary", "katz")
    n_tokens, n_words, n_begin = state.agg(F.sum("n_tokens"), F.sum("n_words"), F.sum("n_train")).first()
    if not n_tokens:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    buckets, pair_buckets = -(-n_words // WORDS_A_BUCKET), -(-n_tokens // TOKENS_A_BUCKET)
    spread = max(TOKENS_A_BUCKET // 8, n_tokens // HOT + 1)

    def ask_words(block: int, words: bytes) -> list[tuple]:
        differences, counts = unpack(words)
        hashes = sums(differences)
        return [(b, block, None, pack(gaps(hashes[s:e]), counts[s:e])) for b, s, e in slices(_by_hash(hashes, buckets))]

    def add_words(bucket: int, requests: list[tuple[int, bytes]]) -> list[tuple]:
        parts = [unpack(p) for _, p in requests]
        words, where = np.unique(np.concatenate([sums(x[0]) for x in parts]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([x[1] for x in parts]).astype(float)).astype(np.int64)
        hot = np.flatnonzero(counts >= spread)
        out = [(bucket, None, "words", pack(gaps(words), counts)), (bucket, None, "totals", pack(np.append(_counts_of_counts(counts), [counts.sum(), (counts > 0).sum(), len(words)]), hot))]
        at = 0
        for (block, _), x in zip(requests, parts, strict=True):
            mine = where[at : at + len(x[0])]
            out.append((bucket, block, "answer", pack(gaps(mine.astype(np.uint64)), counts[mine])))
            at += len(x[0])
        return out

    unigrams = exchange.ask(state.select("block", "words"), ask_words, add_words, "katz-words")
    totals = {r["bucket"]: unpack(r["payload"]) for r in unigrams.where("kind = 'totals'").select("bucket", "payload").collect()}
    first, hot, n1, n_train, known = np.zeros(buckets + 1, np.int64), [], np.zeros(K + 2, np.int64), 0, 0
    for b in range(buckets):
        t, own = (x.astype(np.int64) for x in totals.get(b, (np.zeros(K + 5), np.zeros(0))))
        first[b + 1] = first[b] + t[K + 4]
        n1, n_train, known = n1 + t[: K + 2], n_train + int(t[K + 2]), known + int(t[K + 3])
        hot.append(own + first[b])
    if n_begin >= spread:
        hot.append(first[-1:])
    hot = np.concatenate(hot)
    d1, unknown = discounts([int(x) for x in n1], n_train)
    if not unknown:
        d1, unknown = d1 * (n_train / (n_train + 1)), 1 / (n_train + 1)

    def unigram(counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, _discounted(d1, counts) / max(1, n_train), unknown)

    def ask_pairs(block: int, tokens: bytes, docs: bytes, answers: list[dict]) -> list[tuple]:
        own = _Words(tokens, docs, answers, first)
        bucket = own.in_buckets(pair_buckets, spread, n_begin)
        counts = np.bincount(own.pair[np.repeat(own.train.astype(bool), own.sizes)], minlength=len(own.h))
        return [(b, block, None, pack(gaps(own.h[s:e].astype(np.uint64)), own.w[s:e], counts[s:e], own.w_count[s:e])) for b, s, e in slices(bucket)]

    def add_pairs(bucket: int, requests: list[tuple[int, bytes]]) -> list[tuple]:
        parts = [unpack(p) for _, p in requests]
        h, w = np.concatenate([sums(x[0]) for x in parts]), np.concatenate([x[1] for x in parts]).astype(np.uint64)
        keys, some, where = np.unique(h << np.uint64(32) | w, return_index=True, return_inverse=True)
        counts = np.bincount(where, np.concatenate([x[2] for x in parts]).astype(float)).astype(np.int64)
        p = unigram(np.concatenate([x[3] for x in parts]).astype(np.int64)[some])
        contexts, of = np.unique(keys >> np.uint64(32), return_inverse=True)
        by_count = np.bincount(of * (K + 2) + np.minimum(counts, K + 1), minlength=len(contexts) * (K + 2)).reshape(-1, K + 2)[:, 1 : K + 1]
        seen = np.bincount(of, np.where(counts > 0, p, 0), minlength=len(contexts))
        heavy = np.flatnonzero(np.isin(contexts, hot.astype(np.uint64)))
        out = [(bucket, None, "pairs", pack(gaps(keys[counts > 0]), counts[counts > 0])), (bucket, None, "totals", pack(_counts_of_counts(counts), contexts[heavy], by_count[heavy].ravel(), seen[heavy]))]
        at = 0
        for (block, _), x in zip(requests, parts, strict=True):
            mine = where[at : at + len(x[1])]
            at += len(x[1])
            c, o = counts[mine], of[mine]
            all_ = np.unique(o)
            missed = np.unique(o[c == 0])
            out.append((bucket, block, "answer", pack(c, (by_count[all_].sum(1) == 0).astype(np.uint8), by_count[missed].ravel(), seen[missed])))
        return out

    named = exchange.by_block(unigrams, "word_answers")
    bigrams = exchange.ask(_joined(state.select("block", "tokens", "docs"), named), ask_pairs, add_pairs, "katz-pairs")
    n2, heavy = np.zeros(K + 2, np.int64), {}
    for r in bigrams.where("kind = 'totals'").select("payload").collect():
        n, contexts, by_count, seen = unpack(r[0])
        n2 += n.astype(np.int64)
        for i, c in enumerate(contexts.tolist()):
            b, s = heavy.get(c, (np.zeros(K, np.int64), 0.0))
            heavy[c] = b + by_count[K * i : K * i + K].astype(np.int64), s + float(seen[i])
    d2, _ = discounts([int(x) for x in n2], n_train)

    def result(block: int, tokens: bytes, docs: bytes, word_answers: list[dict], pair_answers: list[dict]) -> pa.RecordBatch:
        own = _Words(tokens, docs, word_answers, first)
        bucket = own.in_buckets(pair_buckets, spread, n_begin)
        got = {r["bucket"]: unpack(r["payload"]) for r in pair_answers}
        logs = np.empty(len(bucket))
        for b, s, e in slices(bucket):
            counts, full, by_count, seen = got[b]
            counts, h, h_count = counts.astype(np.int64), own.h[s:e], own.h_count[s:e]
            contexts, of = np.unique(h, return_inverse=True)
            full = full.astype(bool)
            table, sums_ = np.zeros((len(contexts), K)), np.zeros(len(contexts))
            missed = np.unique(of[counts == 0])
            table[missed], sums_[missed] = by_count.reshape(-1, K), seen
            for i in np.flatnonzero(np.isin(contexts, hot)).tolist():
                table[i], sums_[i] = heavy[int(contexts[i])]
                full[i] = not table[i].any()
            total = np.zeros(len(contexts))
            total[of] = h_count
            free = (table * ((1 - d2[1 : K + 1]) * np.arange(1, K + 1))).sum(1)
            free, total = np.where(full, 1, free), np.where(full, total + 1, total)
            alpha = np.where(total > full, free / np.maximum(total, 1) / np.maximum(1 - sums_, 1e-300), 1.0)
            p = np.where(counts > 0, _discounted(d2, counts) / np.maximum(total[of], 1), alpha[of] * unigram(own.w_count[s:e]))
            logs[s:e] = np.log10(p)
        base = np.log10((own.count + 0.1) / (n_train + 0.1 * (known + 1)))
        at = own.starts
        ids, null = own.doc_ids.astype(np.uint64).view(np.int64), own.null.astype(bool)
        columns = [
            pa.array(ids, mask=null), pa.array(own.train == 0), pa.array(own.sizes), pa.array(np.add.reduceat((own.count > 0).astype(np.int64), at)),
            pa.array(np.full(len(at), n_train)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(logs[own.pair], at)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield result(*(c[i].as_py() for c in batch.columns))

    return _joined(state.select("block", "tokens", "docs"), named, exchange.by_block(bigrams, "pair_answers")).mapInArrow(workers.tidy(results), SCHEMA)
