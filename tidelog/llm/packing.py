"""Packing documents into training sequences of several permitted lengths by variable-capacity best fit.

A sequence of capacity c costs ``c + overhead``.  Within a shard items go in by falling length: each goes to
the open bin that it leaves the least room in; if none has room, the bin size is opened whose cost per token
that it can be filled with (the item and what is still to come) is least.  This is done once for each permitted
size as the largest that may be opened, and the cheapest outcome stands: the sizes are optimised jointly.  In
the end every bin is downsized to the smallest permitted length that holds its contents.

What is packed are token ids of ``width`` bytes each: any binary column, such as the ids of a token file
(``width=4``).  By default a token is a byte of the UTF-8 text, and each document ends with :data:`END`, a byte
that UTF-8 never uses.  The result is the sequences themselves, with the documents and pieces that each holds.

Documents longer than the largest length are cut into pieces of that length and a rest before anything moves.
Shards of about ``shard_bytes`` of ids are made by a hash of the row's place in the input and the piece, so no
task gets an unbounded group, whatever ids repeat; what is lost against one global packing is a bin or two a
shard.  Ids are shuffled once.  The input must be read in the same order again if a task is repeated, as
files are.

Defined results: a document with a null or empty text is its end mark alone (with ids of one's own, none: it
is in no sequence); rows without an id and repeated rows are packed like others, each; ties are broken by id, piece and ids; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import workers

#: Permitted lengths in bytes, which stand for about 512 to 8,192 tokens of a subword vocabulary.
CAPACITIES = (2048, 4096, 8192, 16384, 32768)
END = b"\xff"
SCHEMA = "bin_id long, capacity long, n_tokens long, doc_ids array<long>, pieces array<long>, starts array<long>, lengths array<long>, tokens binary"


def byte_tokens(text: Column) -> Column:
    """The UTF-8 bytes of a text and the end mark."""
    return F.concat(F.encode(F.coalesce(text, F.lit("")), "utf-8"), F.lit(END))


def _pack_once(lengths: list[int], sizes: list[int], overhead: int) -> tuple[int, list[tuple[int, int]], list[int]]:
    """(cost, (bin, offset) of each length, bin capacities) with the given sizes; ``lengths`` fall."""
    rooms: list[int] = []  # rooms of open bins, sorted and distinct
    at_room: dict[int, list[int]] = {}
    filled: list[int] = []
    placed, rest = [], sum(lengths)
    for n in lengths:
        rest -= n
        i = bisect.bisect_left(rooms, n)
        if i < len(rooms):
            room = rooms[i]
            b = at_room[room].pop()
            if not at_room[room]:
                del at_room[room]
                rooms.pop(i)
        else:
            room = min((c for c in sizes if c >= n), key=lambda c: ((c + overhead) / min(c, n + rest), c))
            b = len(filled)
            filled.append(0)
        placed.append((b, filled[b]))
        filled[b] += n
        if room > n:
            if room - n not in at_room:
                at_room[room - n] = []
                bisect.insort(rooms, room - n)
            at_room[room - n].append(b)
    down = [sizes[bisect.bisect_left(sizes, x)] for x in filled]
    return sum(down) + overhead * len(down), placed, down


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = 64) -> tuple[list[tuple[int, int]], list[int]]:
    """((bin, offset) of each length, capacity of each bin); no length exceeds the largest capacity."""
    sizes = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    falling = [lengths[i] for i in order]
    if not falling:
        return [], []
    runs = [_pack_once(falling, sizes[: i + 1], overhead) for i in range(len(sizes)) if sizes[i] >= falling[0]]
    _, placed, down = min(runs, key=lambda r: r[0])
    out = [(0, 0)] * len(lengths)
    for i, p in zip(order, placed, strict=True):
        out[i] = p
    return out, down


def pack(docs: DataFrame, *, ids: Column | str | None = None, width: int = 1, capacities: tuple[int, ...] = CAPACITIES, overhead: int = 64, shard_bytes: int = 12 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sequence: its capacity, its tokens, and which document's which piece starts where in it.

    ``starts`` are places in the sequence, ``lengths`` the pieces' tokens; piece p of a document begins at its
    token ``p * max(capacities)``.
    """
    workers.small_batches(docs.sparkSession)
    most = max(capacities)
    own = byte_tokens(F.col(text_col).cast("string")) if ids is None else F.col(ids) if isinstance(ids, str) else ids
    size = F.octet_length(F.col(text_col).cast("string")) if ids is None else F.octet_length(own)
    total = docs.select(F.coalesce(size, F.lit(0)).cast("long").alias("n")).agg(F.sum("n"), F.count("*")).first()
    shards = max(1, -(-((total[0] or 0) + 64 * total[1]) // shard_bytes))
    coded = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(own, F.lit(b"")).alias("ids"), F.monotonically_increasing_id().alias("row"))
    step = most * width
    count = F.ceil(F.octet_length("ids") / F.lit(step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.struct(i.cast("long").alias("piece"), F.substring("ids", i * step + 1, F.lit(step)).alias("ids")))
    pieces = coded.select("doc_id", "row", F.explode(cut).alias("x")).select("doc_id", "x.piece", "x.ids", F.pmod(F.xxhash64("row", "x.piece"), F.lit(shards)).alias("shard")).where("octet_length(ids) > 0")

    def run(group: pa.Table) -> pa.Table:
        first = group["shard"][0].as_py() << 32
        rows = sorted(zip(group["doc_id"].to_pylist(), group["piece"].to_pylist(), group["ids"].to_pylist(), strict=True), key=lambda r: (-len(r[2]), r[0] is None, r[0] or 0, r[1], r[2]))
        placed, caps = best_fit([len(r[2]) // width for r in rows], capacities, overhead)
        bins = [[] for _ in caps]
        for (b, at), r in zip(placed, rows, strict=True):
            bins[b].append((at, *r))
        for x in bins:
            x.sort(key=lambda r: r[0])
        longs = pa.list_(pa.int64())
        return pa.table(
            {
                "bin_id": pa.array(range(first, first + len(bins)), pa.int64()), "capacity": pa.array(caps, pa.int64()), "n_tokens": pa.array([sum(len(r[3]) for r in x) // width for x in bins], pa.int64()),
                "doc_ids": pa.array([[r[1] for r in x] for x in bins], longs), "pieces": pa.array([[r[2] for r in x] for x in bins], longs), "starts": pa.array([[r[0] for r in x] for x in bins], longs),
                "lengths": pa.array([[len(r[3]) // width for r in x] for x in bins], longs), "tokens": pa.array([b"".join(r[3] for r in x) for x in bins], pa.binary()),
            }
        )

    return pieces.groupBy("shard").applyInArrow(workers.tidy_group(run), SCHEMA)
