"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries.

A file is a folder of Parquet rows, each row one self-contained binary block (so that writing goes through
Spark's commit protocol on any store, and a lost executor costs one task).  A block holds whole documents::

    magic "TLEF", version u16, low-bit width u16, documents u64, ids u64, bytes of the four parts u64 x 4
    document ids  int64 x documents, then one null bit per document
    low bits      the low ``l`` bits of each boundary, packed
    high bits     unary: bit (boundary >> l) + i is set for document i
    samples       u32: position of every 64th set bit, the select structure
    ids           u32 x ids, little-endian

Boundary i is the end of document i, so a block of n documents and u ids needs about n * (2 + log2(u / n))
bits and no 64-bit table.  ``select(i)`` reads one sample and at most a few machine words.

Defined results: a null or empty text is the end id alone; rows with a null id come first (nulls first), rows
with equal ids are ordered by text hash and then by place in the input; other columns are ignored; an empty
table gives a file without blocks.  One document must fit in one task (4 bytes an id); documents do not
straddle blocks.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress, islice, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, workers

END_ID = 0
_HEAD = struct.Struct("<4sHHQQQQQQ")
_EVERY = 64
#: Characters that are encoded at once, unless one text has more.
PIECE = 8 << 20
BLOCK_SCHEMA = "shard int, seq int, first_token long, n_docs long, n_tokens long, payload binary"
TOKEN_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence below ``universe + 1`` with constant-time-like ``select``."""

    def __init__(self, n: int, low_width: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_width, self.low, self.high, self.samples = n, low_width, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        bits = np.arange(width, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> bits) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, width, low, np.packbits(high, bitorder="little").tobytes(), ones[::_EVERY].astype(np.uint32))

    def decode(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n] - np.arange(self.n)
        out = high.astype(np.uint64) << np.uint64(self.low_width)
        if self.low_width:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_width]
            out |= (bits.reshape(self.n, self.low_width).astype(np.uint64) << np.arange(self.low_width, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out

    def select(self, i: int) -> int:
        """Value ``i`` without decoding the rest."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // _EVERY]), i % _EVERY
        byte, word = at >> 3, self.high[at >> 3] >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        first = i * self.low_width
        low = int.from_bytes(self.low[first >> 3 : (first + self.low_width + 7) >> 3], "little") >> (first & 7)
        return high << self.low_width | low & ((1 << self.low_width) - 1)


def pack_block(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One block from document ids and each document's ids as little-endian unsigned 32-bit integers."""
    ef = EliasFano.encode(np.cumsum([len(x) // 4 for x in ids], dtype=np.uint64))
    keys = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.packbits([x is None for x in doc_ids], bitorder="little").tobytes()
    samples = ef.samples.astype("<u4").tobytes()
    head = _HEAD.pack(b"TLEF", 1, ef.low_width, len(ids), sum(map(len, ids)) // 4, len(keys), len(ef.low), len(ef.high), len(samples))
    return b"".join([head, keys, ef.low, ef.high, samples, *ids])


def open_block(payload: bytes) -> tuple[list[int | None], EliasFano, memoryview]:
    """(document ids, boundaries, the id array as bytes) of a block; nothing of the id array is copied."""
    magic, version, width, n, _, a, b, c, d = _HEAD.unpack_from(payload)
    if magic != b"TLEF" or version != 1:
        raise ValueError("not a token block")
    view, at = memoryview(payload), _HEAD.size
    keys = np.frombuffer(payload, "<i8", n, at)
    null = np.unpackbits(np.frombuffer(payload, np.uint8, a - 8 * n, at + 8 * n), bitorder="little")[:n]
    low, high = bytes(view[at + a : at + a + b]), bytes(view[at + a + b : at + a + b + c])
    samples = np.frombuffer(payload, "<u4", d // 4, at + a + b + c)
    return [None if x else int(k) for k, x in zip(keys, null, strict=True)], EliasFano(n, width, low, high, samples), view[at + a + b + c + d :]


_encoders: dict[str, Encoder] = {}


def _byte_letters() -> np.ndarray:
    """The code of the letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return np.array([b if b in printable else 256 + others.index(b) for b in range(256)], "<u4")


def _pre_tokens() -> re.Pattern:
    """What the tokenizer cuts a text into, for characters up to U+0530."""
    kinds = {"L": "", "N": "", "Z": "\t\n\v\f\r \x85\xa0"}
    for x in map(chr, range(0x531)):
        if unicodedata.category(x)[0] in "LN":
            kinds[unicodedata.category(x)[0]] += x
    letters, digits, spaces = kinds.values()
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^{letters}{digits}{spaces}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


class Encoder:
    """The tokenizer's ids of whole texts, with the ids of runs between single spaces remembered.

    Byte-level BPE first cuts a text into pre-tokens and a space always starts one when a non-space follows
    it, so runs can be encoded apart; a text in which a space meets other white space is encoded whole, and so
    is every text if the tokenizer is of another kind.  New runs are cut into pre-tokens here, which are
    remembered too, as many runs differ in punctuation alone.  New pre-tokens go many to a text straight
    through the merges, with the letter of a byte between them that is in no UTF-8 and in no merge, so nothing
    merges across.  Runs with characters whose kind may depend on the library, or with special tokens, go
    through the whole tokenizer, where they are told apart by the ids that begin with a space, of which each
    run has one, its first.

    What is remembered is held in two generations of ``most_bytes`` at the most: when the younger is full the
    older goes, and what is met again moves up.
    """

    def __init__(self, path: str, most_bytes: int = 72 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most_bytes = Tokenizer.from_file(path), most_bytes
        self.merges, self.letters = Tokenizer(self.tokenizer.model), _byte_letters()
        kind = json.loads(self.tokenizer.to_str())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        for x, i in vocabulary.items():
            self.spaced[i] = x.startswith("\u0120")
        own, special = kind["pre_tokenizer"] or {}, [x["content"] for x in kind["added_tokens"]]
        self.cuts = kind["normalizer"] is None and own.get("type") == "ByteLevel" and own["use_regex"] and not own["add_prefix_space"] and kind["model"]["type"] == "BPE" and not any(x.isalpha() or re.search(r"\s", x) for x in special)
        self.meets = re.compile(r" \s").search
        self.unsettled = re.compile("[^\x00-\u0530]").search  # beyond, which characters are letters may depend on the library
        self.odd = re.compile("|".join(["[^\x00-\u0530]", *map(re.escape, special)])).search
        self.pre_tokens = _pre_tokens().findall
        plain = self.merges.get_vocab()
        held_by = Counter(x for y in plain for x in set(y))
        gaps = [b for b in (0xC0, 0xC1, *range(0xF5, 0x100)) if (x := chr(self.letters[b])) in plain and held_by[x] == 1]
        self.apart = self.cuts and bool(gaps) and not any(kind["model"].get(x) for x in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        self.gap = bytes(gaps[:1])
        self.gap_id = plain[chr(self.letters[gaps[0]])] if gaps else -1
        self.known, self.older, self.held = {}, {}, 0

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, run: str) -> bool:
        """Whether a run is letters alone, which the tokenizer takes as one pre-token."""
        return self.apart and run.isalpha() and (run.isascii() or not self.unsettled(run))

    def _first(self, runs: list[str]) -> list[bytes]:
        """Ids of runs with no space before them."""
        words = [self._word(x) for x in runs]
        ways = iter(self._merged([" " + x for x, w in zip(runs, words, strict=True) if w])), iter(self._encoded([x for x, w in zip(runs, words, strict=True) if not w]))
        return [next(ways[0] if w else ways[1]) for w in words]

    def _merged(self, names: list[str]) -> list[bytes]:
        """Ids of pre-tokens, named as in ``known``; 32 at once, as merging longer texts costs more."""
        out = []
        for at in range(0, len(names), 512):
            some = [(x[1:] if x[:1] == " " else " " + x).encode() for x in names[at : at + 512]]
            raw = [self.gap.join([*some[i : i + 32], b""]) for i in range(0, len(some), 32)]
            texts = [self.letters[np.frombuffer(x, np.uint8)].tobytes().decode("utf-32-le") for x in raw]
            ids = np.array(list(chain.from_iterable(e.ids for e in self.merges.encode_batch_fast(texts, add_special_tokens=False))), "<u4")
            gaps = ids == self.gap_id
            out += _sliced(ids[~gaps], np.flatnonzero(gaps) - np.arange(len(some)))
        return out

    def _joined(self, runs: list[str]) -> list[bytes]:
        """Ids of any runs with a space before each."""
        ids = np.frombuffer(self._encoded([" " + " ".join(runs)])[0], "<u4")
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) == len(runs):
            return _sliced(ids, np.append(starts[1:], len(ids)))
        return self._encoded([" " + x for x in runs])

    def _remember(self, names: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(names, ids, strict=True))
        self.held += sum(map(len, names)) + sum(map(len, ids)) + 180 * len(names)

    def _learn(self, runs: list[str]) -> list[bytes]:
        """Ids of distinct runs that are not in ``known``; they are put there, with the pre-tokens of the new ones."""
        ids = list(map(self.older.get, runs))
        words, odd, composed, sizes, parts = [], [], [], [], []
        for i in compress(range(len(ids)), map(is_, ids, repeat(None))):
            run = runs[i]
            if self._word(run):
                words.append(i)
            elif not self.apart or self.odd(run):
                odd.append(i)
            elif len(some := self.pre_tokens(" " + run)) == 1:
                words.append(i)
            else:
                composed.append(i)
                sizes.append(len(some))
                parts.append(some[0][1:])
                parts += [" " + x for x in some[1:]]
        for at in range(0, len(odd), 512):
            some = odd[at : at + 512]
            for i, x in zip(some, self._joined([runs[i] for i in some]), strict=True):
                ids[i] = x
        names = [runs[i] for i in words]
        own = dict(zip(names, self._merged(names), strict=True))
        for i, x in zip(words, own.values(), strict=True):
            ids[i] = x
        rest = list(set(parts).difference(own))
        held = list(map(self.known.get, rest))
        missed = list(compress(range(len(rest)), map(is_, held, repeat(None))))
        again = [rest[i] for i in missed]
        found = list(map(self.older.get, again))
        new = list(compress(range(len(again)), map(is_, found, repeat(None))))
        for i, x in zip(new, self._merged([again[i] for i in new]), strict=True):
            found[i] = x
        for i, x in zip(missed, found, strict=True):
            held[i] = x
        own.update(zip(rest, held, strict=True))
        each = map(own.__getitem__, parts)
        for i, n in zip(composed, sizes, strict=True):
            ids[i] = b"".join(islice(each, n))
        self._remember(runs, ids)
        self._remember(again, found)
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids.  ``known`` is keyed by the run without the space before it, a pre-token that has none by itself after a space.

        All texts' runs become numbers of their distinct runs, so each of those is looked up once, and the ids
        are gathered by number.
        """
        if self.held > self.most_bytes:
            self.known, self.older, self.held = {}, self.known, 0
        whole = [not self.cuts or self.meets(x) is not None for x in texts]
        cut = pc.split_pattern(pa.array([None if w else x for x, w in zip(texts, whole, strict=True)], pa.large_string()), " ")
        offsets, coded = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        firsts = offsets[:-1][~np.array(whole, bool)]
        apart = iter(cut.values.take(pa.array(firsts)).to_numpy(zero_copy_only=False).tolist())
        first = self._first([x if w else next(apart) for x, w in zip(texts, whole, strict=True)])
        later = np.ones(len(cut.values), bool)
        later[firsts] = False
        codes = coded.indices.to_numpy()[later]
        used = np.bincount(codes, minlength=len(coded.dictionary)) > 0
        names = coded.dictionary.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, names))
        missed = list(compress(range(len(ids)), map(is_, ids, repeat(None))))
        for i, x in zip(missed, self._learn([names[i] for i in missed]), strict=True):
            ids[i] = x
        codes = (np.cumsum(used) - 1)[codes]
        held = pa.array(ids, pa.large_binary())
        bounds = np.frombuffer(held.buffers()[1], np.int64, len(ids) + 1) // 4
        starts, lengths = bounds[codes], np.diff(bounds)[codes]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        pool = np.frombuffer(held.buffers()[2] or b"", "<u4", bounds[-1])
        gathered = pool[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)]
        words = np.concatenate(([0], np.cumsum(later)))[offsets[1:]] if len(later) else np.zeros(len(texts), np.int64)
        return [x + y for x, y in zip(first, _sliced(gathered, ends[words]), strict=True)]


def _sliced(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
    return [raw[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) of consecutive rows with about :data:`PIECE` characters, whatever the batches."""
    keys, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            if keys and held + len(text) > PIECE:
                yield keys, texts
                keys, texts, held = [], [], 0
            keys.append(key)
            texts.append(text)
            held += len(text)
    if keys:
        yield keys, texts


def write_token_file(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, block_tokens: int = 1 << 20) -> None:
    """Encode every text, append :data:`END_ID`, and write blocks in ascending id order to ``path``.

    Range partitioning on (id, text hash, place) gives ordered shards of even size even if one id is very
    frequent; within a shard blocks are numbered by ``seq`` and know the shard's tokens before them.
    """
    spark = docs.sparkSession
    workers.small_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([END_ID], "<u4").tobytes()
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumns({"__hash": F.xxhash64("text"), "__place": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(shards, F.asc_nulls_first("doc_id"), "__hash", "__place").sortWithinPartitions(F.asc_nulls_first("doc_id"), "__hash", "__place").select("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, seq, before, held = TaskContext.get().partitionId(), 0, 0, 0
        keys, ids = [], []

        def flush():
            nonlocal seq, before, held, keys, ids
            row = [[shard], [seq], [before], [len(keys)], [held], [pack_block(keys, ids)]]
            seq, before, held, keys, ids = seq + 1, before + held, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "seq", "first_token", "n_docs", "n_tokens", "payload"])

        own = encoder(tokenizer)
        for names, texts in _gathered(batches):
            for key, coded in zip(names, own.encode(texts), strict=True):
                keys.append(key)
                ids.append(coded + end)
                held += len(coded) // 4 + 1
                if held >= block_tokens:
                    yield flush()
        if keys:
            yield flush()

    ordered.mapInArrow(workers.tidy(blocks), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read from the file: its id, the ids of all documents before it, its own ids' number and crc32.

    Only one total a shard comes to the driver, where they are added up.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    base, at = {}, 0
    for shard, n in sorted(blocks.groupBy("shard").agg(F.sum("n_tokens")).collect()):
        base[shard], at = at, at + n
    bases = spark.createDataFrame(list(base.items()), "shard int, base long")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, boundaries, ids = open_block(payload.as_py())
                ends = boundaries.decode().astype(np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + first), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(F.broadcast(bases), "shard").select((F.col("base") + F.col("first_token")).alias("first"), "payload").mapInArrow(workers.tidy(documents), TOKEN_SCHEMA)


def token_file(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write a token file to the shared folder and read it back."""
    path = store.scratch(docs.sparkSession, "tokens")
    write_token_file(docs, path, tokenizer, **options)
    return read_token_file(docs.sparkSession, path)
