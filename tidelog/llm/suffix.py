"""Exact removal of repeated byte strings with sampled suffix arrays in a logarithmic family of indexes.

A string counts as repeated if ``least`` bytes of it start anywhere else too, in the same text or another.  Of
all suffixes those are indexed that start at a minimizer: the least hash of :data:`GRAM` bytes within a window
of ``least`` bytes.  Equal windows choose the same place, so two equal windows always meet in the index; about
one suffix in 84 is indexed and owns the windows that chose it (its context, at most ``2 * least`` bytes).

1. Each block of documents is a batch and gets a suffix array: its sampled suffixes in the order of (hash of
   the first :data:`GRAM` bytes, hash of the context).  The order is one of hashes and not of bytes, which is
   all that equality of long prefixes needs.
2. A bucket of suffixes takes the batches one by one.  Each is merge-scanned against the existing levels;
   what is new becomes a level, and levels of about equal size merge, so there are log(n) of them
   (:class:`Family`).  A suffix whose whole context comes again is repeated in full.
3. Suffixes that share the first bytes with another but not the whole context lie at the edge of a match.
   Only they send their bytes, and all windows of such contexts are compared.
4. Blocks mark the windows found and cut what they cover.

A suffix that very many different contexts begin with (a license line) is dealt out over all buckets by its
context, and its edges are compared window by window, dealt out by window; no group is gathered whole.
Comparisons are of hashes of 128 bits in all (96 in the last case).

Defined results: a null text is empty and stays without bytes; rows without an id and repeated rows are
documents of their own; texts are judged as UTF-8 bytes, so what is kept may begin or end within a character;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, workers
from .exchange import gaps, pack, slices, sums, unpack
from .words import mix, pieces

GRAM = 32
SAMPLES_A_BUCKET = 1 << 19
CONTEXT_BYTES_A_BUCKET = 16 << 20
#: Contexts of one first gram that may meet in one task (all in a bucket, or in one block).
MOST_CONTEXTS, MOST_IN_BLOCK = 20_000, 512
_U = np.uint64
_BASE = 0xD1342543DE82EF95
_MARK = 0xFFFFFFFF
_CHUNK = 1 << 20
SCHEMA = "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _prefix(b: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; see :func:`_span`."""
    if len(_powers[0]) <= len(b):
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(len(b) + len(b) // 4 + 1024, base, _U)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=_U)
    h = np.zeros(len(b) + 1, _U)
    np.cumsum((b.astype(_U) + _U(1)) * _powers[0][: len(b)], dtype=_U, out=h[1:])
    return h


def _span(h: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
    return (h[stop] - h[start]) * _powers[1][start]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    padded = np.full(-(-len(x) // width) * width, ~_U(0))
    padded[: len(x)] = x
    table = padded.reshape(-1, width)
    left, right = np.minimum.accumulate(table, 1).ravel(), np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: len(x) - width + 1], left[width - 1 : len(x)])


def sample(b: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, minimizer, gram hash, context hash) of each sampled suffix.

    ``b`` holds texts one after another that end at ``ends``; windows don't cross them.
    """
    out = []
    room = np.zeros(len(b), np.uint8)
    starts = np.concatenate(([0], ends[:-1]))
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        room[s : max(s, e - least + 1)] = 1
    for at in range(0, max(0, len(b) - least + 1), _CHUNK):
        part = b[at : at + _CHUNK + least - 1]
        good = room[at : at + len(part) - least + 1].astype(bool)
        if not good.any():
            continue
        h = _prefix(part)
        n = len(part) - GRAM + 1
        gram = mix(_span(h, slice(0, n), slice(GRAM, GRAM + n)))
        place = (_sliding_min((gram & ~_U(0xFFFFFF)) | np.arange(n, dtype=_U), least - GRAM + 1) & _U(0xFFFFFF)).astype(np.int64)
        windows = np.flatnonzero(good)
        edge = np.flatnonzero((np.diff(place[windows]) != 0) | (np.diff(windows) != 1)) + 1
        first = windows[np.concatenate(([0], edge))]
        last = windows[np.concatenate((edge - 1, [len(windows) - 1]))]
        p = place[first]
        shape = ((p - first) * 4096 + (last - first)).astype(_U)
        context = mix(_span(h, first, last + least) + shape * _U(0xD6E8FEB86659FD93))
        out.append((first + at, last + at, p + at, gram[p], context))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def window_hashes(data: np.ndarray, windows: np.ndarray, least: int) -> np.ndarray:
    """Hashes of all windows of contexts that lie one after another, with so many windows each."""
    h = _prefix(data)
    sizes = windows + least - 1
    start = np.repeat(np.cumsum(sizes) - sizes, windows) + _counting(windows)
    return mix(_span(h, start, start + least))


def _counting(n: np.ndarray) -> np.ndarray:
    """0 to n[i] - 1 for each i, one after another."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


class Family:
    """Levels of sorted suffixes (gram, context), each level about twice as large as the next or larger."""

    def __init__(self, room: int):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.gram, self.owner = np.zeros(room, _U), np.zeros(room, np.int64)
        self.again, self.shared = np.zeros(room, bool), np.zeros(room, bool)
        self.n = 0

    def _scan(self, level: tuple, gram: np.ndarray, context: np.ndarray, ids: np.ndarray, shared: np.ndarray) -> None:
        own_gram, own_context, own_ids = level
        low, high = np.searchsorted(own_gram, gram, "left"), np.searchsorted(own_gram, gram, "right")
        some = np.flatnonzero(high > low)
        a, b = low[some], high[some]
        while (open_ := b - a > 1).any():
            mid = (a + b) // 2
            up = open_ & (own_context[np.minimum(mid, len(own_context) - 1)] <= context[some])
            a, b = np.where(up, mid, a), np.where(open_ & ~up, mid, b)
        equal = own_context[a] == context[some]
        ids[some[equal]] = own_ids[a[equal]]
        other = some[~equal | (high[some] - low[some] > 1)]
        shared[other] = True
        step = np.zeros(len(own_gram) + 1, np.int64)
        np.add.at(step, low[other], 1)
        np.add.at(step, high[other], -1)
        self.shared[own_ids[np.cumsum(step[:-1]) > 0]] = True

    def add(self, gram: np.ndarray, context: np.ndarray, owner: int) -> np.ndarray:
        """Ids of a batch's distinct suffixes, sorted by (gram, context); ``again``, ``shared`` are kept by id."""
        ids, shared = np.full(len(gram), -1), np.zeros(len(gram), bool)
        same = gram[1:] == gram[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        for level in self.levels:
            self._scan(level, gram, context, ids, shared)
        self.again[ids[ids >= 0]] = True
        new = np.flatnonzero(ids < 0)
        ids[new] = self.n + np.arange(len(new))
        self.gram[ids[new]], self.owner[ids[new]] = gram[new], owner
        self.shared[ids[shared]] = True
        self.n += len(new)
        if len(new):
            self.levels.append((gram[new], context[new], ids[new]))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            x, y = self.levels.pop(), self.levels.pop()
            both = [np.concatenate(p) for p in zip(x, y, strict=True)]
            order = np.lexsort((both[1], both[0]))
            self.levels.append(tuple(p[order] for p in both))
        return ids


def _by_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets 0 to n - 1; minimizers are small, so their hashes are to be mixed before."""
    return ((hashes >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def _scan_batches(bucket: int, requests: list[tuple[int, bytes]]) -> list[tuple]:
    """Step 2.  Codes of suffixes: 1 repeated in full; 2 at an edge; 3 as 1, and what edges compare with; + 4: by window."""
    runs = [(block, *unpack(p)) for block, p in requests]
    family, held, hot = Family(sum(len(r[2]) for r in runs)), [], []
    for number, (block, gram, context, place, dealt) in enumerate(runs):
        gram, place = sums(gram), place.astype(np.int64)
        real = place != _MARK
        hot.append(gram[~real])
        gram, context, place, dealt = gram[real], context[real].astype(_U), place[real], dealt[real].astype(bool)
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
        ids = family.add(gram[new], context[new], number)
        of = np.cumsum(new) - 1
        family.again[ids[np.bincount(of, minlength=len(ids)) > 1]] = True
        family.shared[ids[of[dealt]]] = True
        hot.append(np.unique(gram[dealt]))
        held.append((block, place, ids[of], new))
    grams, n = np.unique(family.gram[: family.n], return_counts=True)
    hot = np.unique(np.concatenate([grams[n > MOST_CONTEXTS], *hot]))
    is_hot = np.isin(family.gram, hot)
    family.shared |= is_hot  # other buckets may hold other contexts of a marked gram
    out, edges, windows = [], 0, 0
    for number, (block, place, ids, new) in enumerate(held):
        again, shared = family.again[ids], family.shared[ids]
        code = np.where(again, 1, 0) + np.where(shared & ~again, 2, 0) + np.where(shared & again & new & (family.owner[ids] == number), 2, 0)
        code = np.where((code > 1) & is_hot[ids], code + 4, code)
        some = np.flatnonzero(code)
        some = some[np.argsort(place[some])]
        edges, windows = edges + int(((code == 2) | (code == 3)).sum()), windows + int((code > 4).sum())
        if len(some):
            out.append((bucket, block, "answer", pack(gaps(place[some].astype(_U)), code[some].astype(np.uint8))))
    out.append((bucket, None, "totals", pack(np.array([edges, windows]))))
    return out


def _repeated(keys: tuple[np.ndarray, ...], weight: np.ndarray) -> np.ndarray:
    """Whether the weights of equal keys add up to 2 or more, for each item."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    of = np.cumsum(new)
    found = np.empty(len(order), bool)
    found[order] = (np.bincount(of, weight[order]) >= 2)[of]
    return found


def _compare(bucket: int, requests: list[tuple[int, bytes]], edge_buckets: int, least: int) -> list[tuple]:
    """Step 3: which windows are repeated, as place * 4096 + window."""
    parts = [unpack(p) for _, p in requests]
    owner = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
    if bucket >= edge_buckets:
        key, code = np.concatenate([sums(p[0]) for p in parts]), np.concatenate([p[1] for p in parts]).astype(_U)
        found = _repeated((np.concatenate([p[2] for p in parts]), key), np.concatenate([p[3] for p in parts]).astype(float))
        return [(bucket, block, "answer", pack(gaps(np.sort(code[found & (owner == i)])))) for i, (block, _) in enumerate(requests)]
    gram = np.concatenate([sums(p[0]) for p in parts])
    place, windows, edge = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 2, 3))
    data = np.concatenate([p[4] for p in parts])
    sizes = windows + least - 1
    at = np.cumsum(sizes) - sizes
    order = np.argsort(gram, kind="stable")
    groups = np.concatenate(([0], np.flatnonzero(np.diff(gram[order])) + 1, [len(order)]))
    each = np.add.reduceat(windows[order], groups[:-1])
    found = [[] for _ in parts]
    for s, e in pieces(each.tolist(), 1 << 19):
        some = order[groups[s] : groups[e]]
        raw = data[np.repeat(at[some], sizes[some]) + _counting(sizes[some])]
        n = windows[some]
        again = _repeated((window_hashes(raw, n, least), np.repeat(gram[some], n)), np.repeat(2.0 - edge[some], n))
        again &= np.repeat(edge[some], n).astype(bool)
        code, by = (np.repeat(place[some], n) * 4096 + _counting(n))[again], np.repeat(owner[some], n)[again]
        for i in np.unique(by).tolist():
            found[i].append(code[by == i])
    return [(bucket, block, "answer", pack(gaps(np.sort(np.concatenate(found[i])).astype(_U)))) for i, (block, _) in enumerate(requests) if found[i]]


def remove_repeats(docs: DataFrame, *, least: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, the maximal removed spans in bytes, and the bytes kept."""
    if not GRAM < least <= 2048:
        raise ValueError(f"least must lie between {GRAM + 1} and 2048")
    plain = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))

    def build(keys: list[int | None], texts: list[bytes]) -> tuple:
        import zstandard

        raw, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
        first, last, p, gram, context = sample(np.frombuffer(raw, np.uint8), ends, least)
        ids = np.array([k or 0 for k in keys], np.int64).view(_U)
        order = np.lexsort((context, gram))
        return len(first), zstandard.ZstdCompressor(level=3).compress(raw), pack(ids, np.array([k is None for k in keys], np.uint8), np.diff(ends, prepend=0)), pack(gaps(first.astype(_U)), last - first, p - first), pack(gaps(gram[order]), context[order], order)

    state = exchange.blocks(plain, build, "n_samples long, texts binary, docs binary, samples binary, suffixes binary", "suffix")
    total = state.agg(F.sum("n_samples")).first()[0] or 0
    buckets = max(1, -(-total // SAMPLES_A_BUCKET))

    def ask_suffixes(block: int, suffixes: bytes) -> list[tuple]:
        gram, context, place = unpack(suffixes)
        gram, context, place = sums(gram), context.astype(_U), place.astype(np.int64)
        if not len(gram):
            return []
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        distinct = new.copy()
        distinct[1:] |= context[1:] != context[:-1]
        of = np.cumsum(new) - 1
        dealt = (np.bincount(of, distinct) > MOST_IN_BLOCK)[of]
        marks = gram[new & dealt]
        bucket = np.concatenate((np.where(dealt, _by_hash(mix(context), buckets), _by_hash(mix(gram), buckets)), _by_hash(mix(marks), buckets)))
        none = np.zeros(len(marks), np.int64)
        gram, context, place, dealt = np.concatenate((gram, marks)), np.concatenate((context, none.astype(_U))), np.concatenate((place, none + _MARK)), np.concatenate((dealt, none)).astype(np.uint8)
        order = np.lexsort((context, gram, bucket))
        gram, context, place, dealt = gram[order], context[order], place[order], dealt[order]
        return [(b, block, None, pack(gaps(gram[s:e]), context[s:e], place[s:e], dealt[s:e])) for b, s, e in slices(bucket[order])]

    scanned = exchange.ask(state.select("block", "suffixes"), ask_suffixes, _scan_batches, "suffix-scan")
    totals = [unpack(r[0])[0] for r in scanned.where("kind = 'totals'").select("payload").collect()]
    edges, by_window = (sum(int(t[i]) for t in totals) for i in (0, 1))
    edge_buckets = max(1, -(-edges * (least + 84) // CONTEXT_BYTES_A_BUCKET))
    window_buckets = max(1, -(-by_window * 84 // (2 * SAMPLES_A_BUCKET)))

    def codes(answers: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
        parts = [unpack(r["payload"]) for r in answers or []]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return np.concatenate([sums(p[0]) for p in parts]).astype(np.int64), np.concatenate([p[1] for p in parts])

    def ask_edges(block: int, texts: bytes, samples: bytes, answers: list[dict]) -> list[tuple]:
        import zstandard

        b = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8)
        first, windows, p = (x.astype(np.int64) for x in unpack(samples))
        first, windows = np.cumsum(first), windows + 1
        place, code = codes(answers)
        out = []
        for low, high in ((2, 3), (6, 7)):
            some = place[(code == low) | (code == high)]
            if not len(some):
                continue
            edge = (code[(code == low) | (code == high)] == low).astype(np.uint8)
            sizes = windows[some] + least - 1
            data = b[np.repeat(first[some], sizes) + _counting(sizes)]
            h = _prefix(data)
            at = np.cumsum(sizes) - sizes
            gram = mix(_span(h, at + p[some], at + p[some] + GRAM))
            if low == 2:
                bucket = _by_hash(mix(gram), edge_buckets)
                order = np.lexsort((some, gram, bucket))
                for k, s, e in slices(bucket[order]):
                    o = order[s:e]
                    raw = data[np.repeat(at[o], sizes[o]) + _counting(sizes[o])]
                    out.append((k, block, None, pack(gaps(gram[o]), some[o], windows[some[o]], edge[o], raw)))
            else:
                n = windows[some]
                w = window_hashes(data, n, least)
                check = (mix(w ^ np.repeat(gram, n)) >> _U(32)).astype(np.uint32)
                key, of = mix(w + np.repeat(gram, n) * _U(0x9FB21C651E98DF25)), np.repeat(some, n) * 4096 + _counting(n)
                weight = np.repeat(2 - edge, n)
                order = np.argsort(key, kind="stable")
                for k, s, e in slices(_by_hash(key[order], window_buckets)):
                    o = order[s:e]
                    out.append((edge_buckets + k, block, None, pack(gaps(key[o]), of[o], check[o], weight[o])))
        return out

    asked = exchange.by_block(scanned, "codes")
    compared = exchange.ask(state.select("block", "texts", "samples").join(asked, "block"), ask_edges, lambda bucket, requests: _compare(bucket, requests, edge_buckets, least), "suffix-edges")

    def cut(texts: bytes, docs: bytes, samples: bytes, answers: list[dict] | None, found: list[dict] | None) -> Iterator[pa.RecordBatch]:
        import zstandard

        b = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8)
        first, windows, _ = (x.astype(np.int64) for x in unpack(samples))
        first, windows = np.cumsum(first), windows + 1
        place, code = codes(answers)
        whole = place[(code & 1) == 1]
        step = np.zeros(len(b) + least + 1, np.int32)
        np.add.at(step, first[whole], 1)
        np.add.at(step, first[whole] + windows[whole] - 1 + least, -1)
        for r in found or []:
            code = sums(unpack(r["payload"])[0]).astype(np.int64)
            start = first[code // 4096] + code % 4096
            np.add.at(step, start, 1)
            np.add.at(step, start + least, -1)
        gone = np.cumsum(step[: len(b)], dtype=np.int32) > 0
        ids, null, sizes = unpack(docs)
        ids, sizes = ids.astype(_U).view(np.int64), sizes.astype(np.int64)
        ends = np.cumsum(sizes)
        for s, e in pieces(sizes.tolist(), 4 << 20):
            spans, kept = [], []
            for i in range(s, e):
                start = int(ends[i] - sizes[i])
                own = gone[start : ends[i]]
                if not own.any():
                    spans.append([])
                    kept.append(b[start : ends[i]].tobytes())
                    continue
                edge = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist()
                spans.append([{"start": x, "stop": y} for x, y in zip(edge[0::2], edge[1::2], strict=True)])
                kept.append(b[start : ends[i]][~own].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[s:e], mask=null[s:e].astype(bool)), pa.array(sizes[s:e]), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from cut(*(c[i].as_py() for c in batch.columns))

    marked = state.select("block", "texts", "docs", "samples").join(asked, "block", "left").join(exchange.by_block(compared, "found"), "block", "left")
    return marked.select("texts", "docs", "samples", "codes", "found").mapInArrow(workers.tidy(run), SCHEMA)
