"""Collections: bags of rows that change over logical time, as nodes of a plan over DataFrames.

A node describes its changes (row columns, ``__t0``.., ``__diff``) and can be evaluated in two ways:

``changes()``
    all changes, coalesced: what an output gives.
``at(moments)``
    the bag as of some times: the batch operator over its inputs as of those times.  ``moments`` is either one
    literal time, which becomes a filter at the inputs, or a DataFrame (``__at``, ``__b0``..) of many times, which
    become a key that all operators carry, so one job evaluates them all.

Both agree: for every operator and time, the changes up to that time add up to the bag as of it.  Joins, maps
and unions are linear and work on changes directly.  For distinct and reduce a key's value is found at each
point of the grid of its own times, and is inserted there and retracted at the next point of each coordinate;
in one dimension, sums are running sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from functools import reduce as fold_left

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.times import Order, Time, at_or_before, bound_columns, causal, coordinates
from ..functions.values import row_order

DIFF = "__diff"
AT = "__at"


class PlanError(ValueError):
    """The plan breaks a rule."""


class Moments:
    """Times at which a bag is wanted: one literal time, or a DataFrame of them."""

    def __init__(self, time: Time | None = None, frame: DataFrame | None = None):
        self.time, self.frame = time, frame

    @property
    def keys(self) -> list[str]:
        return [] if self.frame is None else [AT]

    def restrict(self, changes: DataFrame, depth: int) -> DataFrame:
        """Changes at or before each moment; loop coordinates beyond the moment's own are not bounded."""
        if self.frame is None:
            n = min(depth, len(self.time))
            return changes.where(at_or_before(n, self.time[:n]))
        bounds = coordinates(depth, "__b")
        own = [b for b in bounds if b in self.frame.columns]
        return changes.join(F.broadcast(self.frame), at_or_before(len(own), [F.col(b) for b in own]))


def summed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(DIFF).alias(DIFF)).where(F.col(DIFF) != 0)


#: What a table's files may hold for its rows to be broadcast where every task needs them.
SMALL = 16 << 20


def scanned(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, from the plan alone; what isn't known counts as more than any table has."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


#: Bytes of scanned files for each task of a step whose memory grows faster than its rows.
SHARE = 4 << 20


def shares(*frames: DataFrame) -> int:
    """Into how many parts such a step is dealt, so that a part stays as large on larger tables; 1 if that isn't known."""
    size = sum(map(scanned, frames))
    return max(1, -(-size // SHARE)) if size < 1 << 50 else 1


def tasks(df: DataFrame) -> int:
    """Over how many tasks rows are dealt that each meet many others."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


class Collection:
    """A node.  ``columns`` are its rows' columns, ``depth`` its number of time coordinates."""

    columns: list[str]
    depth: int
    inputs: tuple[Collection, ...] = ()
    #: Whether there is at most one change per row and time, in all.
    coalesced = False
    indexed = False
    #: Whether changes at a time can only be known when the time is closed.
    stateful = False
    #: Whether it is only known while its loop runs (variables, and what leaves a loop within a loop).
    unfinished = False
    #: The loop that the node belongs to; None at the top.
    scope: object | None = None

    @property
    def times(self) -> list[str]:
        return coordinates(self.depth)

    @cached_property
    def schema(self) -> StructType:
        """The rows' columns and types, from the plan's description alone: nothing runs for it."""
        return self._described()

    def _described(self) -> StructType:
        own = self.inputs[0].schema
        return StructType([StructField(c, f.dataType) for c, f in zip(self.columns, own.fields, strict=True)])

    def _session(self) -> SparkSession:
        return self.inputs[0]._session()

    def _like(self, schema: StructType | None = None) -> DataFrame:
        """An empty DataFrame with the schema (of the rows)."""
        return self._session().createDataFrame([], schema or self.schema)

    def _changes(self) -> DataFrame:
        raise NotImplementedError

    def _bag(self, moments: Moments) -> DataFrame:
        """(columns, [__at], __diff) as of ``moments``; a row may come in several parts, as linear consumers allow."""
        raise NotImplementedError

    #: Whether ``_bag`` has each row once.
    bag_coalesced = False

    @property
    def paired(self) -> bool:
        """Whether coalesced inputs give a coalesced bag though they are joined: nothing is added up over the pairs then."""
        return False

    def at(self, moments: Moments) -> DataFrame:
        """(columns, [__at], __diff), coalesced."""
        bag = self._bag(moments).select(*self.columns, *moments.keys, DIFF)
        return bag if self.bag_coalesced else summed(bag, [*self.columns, *moments.keys])

    def changes(self) -> DataFrame:
        """All changes, one per row and time, none of them zero."""
        df = self._changes()
        return df if self.coalesced else summed(df, [*self.columns, *self.times])

    def as_of(self, *time: int) -> DataFrame:
        """The bag as of a time: rows with their multiplicity ``__diff``."""
        return self.at(Moments(time))

    def rows_as_of(self, *time: int) -> DataFrame:
        """The bag as of a time as plain rows; raises on negative multiplicities."""
        n = F.when(F.col(DIFF) > 0, F.col(DIFF)).otherwise(F.raise_error(F.lit("a row has a negative multiplicity")).cast("long"))
        return self.as_of(*time).select(*self.columns, F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*self.columns)

    def to_df(self) -> DataFrame:
        """Changes with plain names: ``t`` (or ``t0``..) and ``diff``."""
        names = ["t"] if self.depth == 1 else [f"t{i}" for i in range(self.depth)]
        return self.changes().select(*self.columns, *[F.col(c).alias(n) for c, n in zip(self.times, names, strict=True)], F.col(DIFF).alias("diff"))

    # Operators.

    def map(self, *expressions: Column | str) -> Collection:
        """One row to one row, by column expressions with names."""
        return Map(self, expressions)

    def map_rows(self, function: Callable[[tuple], tuple], schema: str) -> Collection:
        """One row to one row, by a Python function over tuples (in Arrow batches)."""
        return MapRows(self, lambda row: (function(row),), schema)

    def flat_map_rows(self, function: Callable[[tuple], Iterator[tuple]], schema: str) -> Collection:
        return MapRows(self, function, schema)

    def project(self, *columns: int | str) -> Collection:
        """Columns by place or name, in any order and as often as wanted."""
        picked = [self.columns[c] if isinstance(c, int) else c for c in columns]
        names = [c if picked.count(c) == 1 else f"{c}_{picked[:i].count(c)}" for i, c in enumerate(picked)]
        return Map(self, [F.col(c).alias(n) for c, n in zip(picked, names, strict=True)])

    def rename(self, *names: str) -> Collection:
        return Map(self, [F.col(c).alias(n) for c, n in zip(self.columns, names, strict=True)], injective=True)

    def filter(self, condition: Column | str) -> Collection:
        return Filter(self, F.expr(condition) if isinstance(condition, str) else condition)

    def explode(self, *expressions: Column) -> Collection:
        """One row to as many rows as an array expression (the last) has elements."""
        return Map(self, expressions)

    def union(self, other: Collection) -> Collection:
        return Union(self, other)

    def negate(self) -> Collection:
        return Negate(self)

    def index(self, *, keep: bool = True) -> Collection:
        return Index(self, keep)

    def join(self, other: Collection, key_columns: int | list[str] = 1, *, null_safe: bool = False) -> Collection:
        return Join(self, other, key_columns, null_safe)

    def distinct(self) -> Collection:
        return Distinct(self)

    def reduce(self, key_columns: int | list[str], *aggregates: Aggregate, empty_groups: str = "init") -> Collection:
        return Reduce(self, key_columns, aggregates, empty_groups)

    # Compositions.

    def semi_join(self, other: Collection, key_columns: int | list[str] = 1) -> Collection:
        """Rows with a partner (however many)."""
        keys, _ = _keys(other, key_columns)
        return Join(self, Map(other, [F.col(c) for c in keys]).distinct(), key_columns, False)

    def anti_join(self, other: Collection, key_columns: int | list[str] = 1) -> Collection:
        """Rows without a partner."""
        return Union(self, Negate(self.semi_join(other, key_columns)))

    def intersect(self, other: Collection) -> Collection:
        return Join(self.distinct(), other.rename(*self.columns).distinct(), list(self.columns), True)

    def difference(self, other: Collection) -> Collection:
        """Rows of ``self`` that ``other`` lacks, once each."""
        own = self.distinct()
        return Union(own, Negate(Join(own, other.rename(*self.columns).distinct(), list(self.columns), True)))

    def outer_join(self, other: Collection, key_columns: int | list[str] = 1, *, how: str = "left") -> Collection:
        """:meth:`join`, and rows without a partner with nulls in the other side's place (``how``: left, right or full)."""
        if how not in ("left", "right", "full"):
            raise PlanError(f"how is left, right or full, not {how}")
        both = self.join(other, key_columns)
        out = both
        if how != "right":
            lone = [F.lit(None).cast(f.dataType).alias(c) for c, f in zip(both.columns[len(self.columns) :], both.schema.fields[len(self.columns) :], strict=True)]
            out = out.union(self.anti_join(other, key_columns).map(*self.columns, *lone))
        if how != "left":
            keys, rest = _keys(other, key_columns)
            names = dict(zip(both.left_keys, keys, strict=True))
            own = [F.col(names[c]).alias(c) if c in names else F.lit(None).cast(f.dataType).alias(c) for c, f in zip(self.columns, self.schema.fields, strict=True)]
            right_keys = keys if isinstance(key_columns, list) else key_columns
            out = out.union(other.anti_join(self, right_keys).map(*own, *[F.col(c).alias(n) for c, n in zip(rest, both.columns[len(self.columns) :], strict=True)]))
        return out

    def range_join(self, other: Collection, point: str, low: str, high: str, width: int, key_columns: int | list[str] = 0) -> Collection:
        """Pairs with ``low <= point <= high`` (and equal keys), found by buckets of ``width``.

        A range is in as many buckets as it touches, so ``width`` should be about the usual length of a range.
        """
        left_keys, right_keys = _keys(self, key_columns)[0], _keys(other, key_columns)[0]
        number = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
        left = Map(self, [number(point).alias("bucket_"), *self.columns], injective=True).filter("bucket_ IS NOT NULL")
        touched = F.sequence(number(low), number(high))
        renamed = {c: f"right_{c}" if c in self.columns and c not in right_keys else c for c in other.columns}
        right = Map(other.filter(F.col(low) <= F.col(high)), [F.explode(touched).alias("bucket_"), *[F.col(c).alias(n) for c, n in renamed.items()]], injective=True)
        met = Join(left, right, ["bucket_", *left_keys], False, dealt=not left_keys)
        inside = met.filter((F.col(renamed[low]) <= F.col(point)) & (F.col(point) <= F.col(renamed[high])))
        return Map(inside, [c for c in inside.columns if c != "bucket_"], injective=True)  # the point has one bucket

    def as_of_join(self, other: Collection, key_columns: int | list[str], on: str, other_on: str) -> Collection:
        """Each distinct row with the latest row of ``other`` of its keys whose ``other_on`` is not after ``on``."""
        met = self.distinct().join(other.distinct(), key_columns)
        later = met.columns[len(self.columns) :]
        keys, rest = _keys(other, key_columns)
        place = dict(zip(rest, later, strict=True))[other_on]
        return met.filter(F.col(place) <= F.col(on)).top(len(self.columns), 1, F.desc(place))

    def windows(self, ts: str, width: int, step: int | None = None, name: str = "window") -> Collection:
        """Rows with the start of each window [start, start + width) that holds ``ts``: tumbling, or sliding by ``step``."""
        step = step or width
        first = F.floor((F.col(ts) - width) / F.lit(step)) * step + step
        starts = F.sequence(first.cast("long"), (F.floor(F.col(ts) / F.lit(step)) * step).cast("long"), F.lit(step).cast("long"))
        return Map(self, [*self.columns, F.explode(starts).alias(name)])

    def sessions(self, key_columns: int | list[str], ts: str, gap: int) -> Collection:
        """(keys, start, end, n): a key's rows whose ``ts`` follow one another within ``gap``, at each time."""
        keys, _ = _keys(self, key_columns)

        def of(bags: DataFrame, groups: list[str]) -> DataFrame:
            w = Window.partitionBy(*groups).orderBy(ts)
            begins = F.when(F.col(ts) - F.lag(ts).over(w) <= gap, 0).otherwise(1)
            counted = bags.withColumn("__begins", begins).withColumn("__session", F.sum("__begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            return counted.groupBy(*groups, "__session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.sum(DIFF).alias("n")).drop("__session")

        spans = self.map(*keys, ts).filter(F.col(ts).isNotNull())
        kind = spans.schema[ts].dataType
        return Grouped(spans, len(keys), of, StructType([*spans.schema.fields[: len(keys)], StructField("start", kind), StructField("end", kind), StructField("n", LongType())]))

    def rollup(self, key_columns: int | list[str], *aggregates: Aggregate, sets: list[tuple[int, ...]] | None = None) -> Collection:
        """Reduces by each prefix of the keys, keys that are summed over as null; ``level`` has their number.

        ``sets`` gives other grouping sets by the keys' places (all subsets: a cube).  Groups without rows go.
        """
        keys, _ = _keys(self, key_columns)
        out = None
        for own in sets if sets is not None else [tuple(range(n)) for n in range(len(keys), -1, -1)]:
            names = [keys[i] for i in own]
            part = self.reduce(names, *aggregates, empty_groups="drop")
            columns = [F.col(k) if k in names else F.lit(None).cast(self.schema[k].dataType).alias(k) for k in keys]
            part = part.map(*columns, F.lit(len(keys) - len(names)).alias("level"), *[a.name for a in aggregates])
            out = part if out is None else out.union(part)
        return out

    def limit(self, n: int, *order: Column) -> Collection:
        """The ``n`` first distinct rows of all in an order."""
        return Top(self, 0, n, order)

    def changes_for_key(self, *key) -> DataFrame:
        """All changes of the rows whose first columns are ``key``; a filter that reaches the inputs."""
        on = fold_left(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(self.columns, key, strict=False)])
        return self.filter(on).changes()

    def lower_bound(self) -> list[Time]:
        """The least times (an antichain) at which there are changes; distinct times come to the driver."""
        found = [tuple(r) for r in self.changes().select(*self.times).distinct().collect()]
        return sorted(t for t in found if not any(causal(x, t) is Order.LT for x in found))

    def top(self, key_columns: int | list[str], n: int, *order: Column) -> Collection:
        """The ``n`` first rows of each key in an order (ties: all columns); rows count once."""
        return Top(self, key_columns, n, order)

    def compact(self, *frontier: int) -> Collection:
        """History before ``frontier`` moved up to it; reads at or after it stay the same."""
        return Compact(self, frontier)

    def walk(self) -> Iterator[Collection]:
        yield self
        for x in self.inputs:
            yield from x.walk()


def _keys(node: Collection, key_columns: int | list[str]) -> tuple[list[str], list[str]]:
    keys = node.columns[:key_columns] if isinstance(key_columns, int) else list(key_columns)
    if isinstance(key_columns, int) and not 0 <= key_columns <= len(node.columns):
        raise PlanError(f"{key_columns} key columns of {len(node.columns)}")
    if missing := set(keys) - set(node.columns):
        raise PlanError(f"no such key columns: {sorted(missing)}")
    return keys, [c for c in node.columns if c not in keys]


def _same_depth(*nodes: Collection) -> int:
    if len({n.depth for n in nodes}) != 1 or len({id(n.scope) for n in nodes if n.scope is not None} | {0}) > 2:
        raise PlanError("inputs lie in different loops")
    return nodes[0].depth


class Input(Collection):
    """A change log: row columns, ``__t0``.., ``__diff``."""

    def __init__(self, log: DataFrame, depth: int = 1):
        self.log, self.depth = log, depth
        self.columns = [c for c in log.columns if c not in {*coordinates(depth), DIFF}]

    def _described(self):
        return self.log.select(*self.columns).schema

    def _session(self):
        return self.log.sparkSession

    def _changes(self) -> DataFrame:
        return self.log

    def _bag(self, moments: Moments) -> DataFrame:
        return moments.restrict(self.log, self.depth)


class _Linear(Collection):
    """An operator that works on changes one by one."""

    def _each(self, df: DataFrame, carried: list[str]) -> DataFrame:
        raise NotImplementedError

    def _changes(self) -> DataFrame:
        return self._each(self.inputs[0]._changes(), [*self.times, DIFF])

    def _bag(self, moments: Moments) -> DataFrame:
        return self._each(self.inputs[0]._bag(moments), [*moments.keys, DIFF])

    keeps_rows_apart = False

    @property
    def paired(self):
        return self.keeps_rows_apart and self.inputs[0].paired

    def at(self, moments):
        if self.paired:
            return self._each(self.inputs[0].at(moments), [*moments.keys, DIFF]).select(*self.columns, *moments.keys, DIFF)
        return super().at(moments)

    def _from(self, input_: Collection) -> None:
        self.inputs, self.depth, self.scope = (input_,), input_.depth, input_.scope
        self.coalesced = input_.coalesced and self.keeps_rows_apart
        self.bag_coalesced = input_.bag_coalesced and self.keeps_rows_apart


class Map(_Linear):
    """Column expressions over rows."""

    def __init__(self, input_: Collection, expressions, injective: bool = False):
        self.expressions = [F.col(e) if isinstance(e, str) else e for e in expressions]
        self.keeps_rows_apart = injective
        self._from(input_)
        self.schema = input_._like().select(*self.expressions).schema
        self.columns = self.schema.names
        if any(c.startswith("__") for c in self.columns):
            raise PlanError("names that begin with __ are the engine's")

    def _each(self, df, carried):
        return df.select(*self.expressions, *carried)


class MapRows(_Linear):
    """A Python function from a row to rows, in Arrow batches."""

    def __init__(self, input_: Collection, function: Callable, out: str):
        self.function, self.out = function, out
        self._from(input_)
        self.schema = self._session().createDataFrame([], out).schema
        self.columns = self.schema.names

    def _each(self, df, carried):
        function, n = self.function, len(self.inputs[0].columns)
        schema = StructType([*self.schema.fields, *[StructField(c, LongType()) for c in carried]])

        def run(batches):
            for batch in batches:
                found = [(*new, *row[n:]) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for new in function(row[:n])]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in found], _arrow(schema))

        return df.select(*self.inputs[0].columns, *carried).mapInArrow(run, schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class Filter(_Linear):
    keeps_rows_apart = True

    def __init__(self, input_: Collection, condition: Column):
        self.condition = condition
        self._from(input_)
        self.columns = input_.columns

    def _each(self, df, carried):
        return df.where(self.condition).select(*self.columns, *carried)


class Negate(_Linear):
    keeps_rows_apart = True

    def __init__(self, input_: Collection):
        self._from(input_)
        self.columns = input_.columns

    def _each(self, df, carried):
        return df.withColumn(DIFF, -F.col(DIFF)).select(*self.columns, *carried)


class Compact(_Linear):
    """Times moved up to a frontier: t := max(t, frontier)."""

    def __init__(self, input_: Collection, frontier: Time):
        self.frontier = frontier
        self._from(input_)
        self.columns = input_.columns

    def _changes(self):
        moved = {c: F.greatest(F.col(c), F.lit(f)) for c, f in zip(self.times, self.frontier, strict=False)}
        return summed(self.inputs[0]._changes().withColumns(moved), [*self.columns, *self.times])

    def _bag(self, moments):
        return moments.restrict(self._changes(), self.depth)


class Union(Collection):
    """Bag union: multiplicities add up.  Columns go by place."""

    def __init__(self, left: Collection, right: Collection):
        if len(left.columns) != len(right.columns):
            raise PlanError("a union needs rows of one width")
        self.inputs, self.depth, self.columns = (left, right), _same_depth(left, right), left.columns
        self.scope = left.scope or right.scope

    def _both(self, left: DataFrame, right: DataFrame, carried: list[str]) -> DataFrame:
        return left.select(*self.columns, *carried).union(right.select(*self.inputs[1].columns, *carried))

    def _changes(self):
        return self._both(self.inputs[0]._changes(), self.inputs[1]._changes(), [*self.times, DIFF])

    def _bag(self, moments):
        return self._both(self.inputs[0]._bag(moments), self.inputs[1]._bag(moments), [*moments.keys, DIFF])


class Index(Collection):
    """The coalesced changes, kept so that several consumers share them (not within loops, where they change)."""

    coalesced = indexed = stateful = True

    def __init__(self, input_: Collection, keep: bool = True):
        self.inputs, self.depth, self.columns, self.scope = (input_,), input_.depth, input_.columns, input_.scope
        self.keep, self._kept, self._version = keep and input_.scope is None, None, ()

    def _current(self) -> DataFrame | None:
        """What is kept, unless an input's log has grown since."""
        version = tuple(len(n.flushed) for n in self.walk() if hasattr(n, "flushed"))
        if version != self._version:
            self.release()
            self._version = version
        return self._kept

    def _changes(self):
        if (kept := self._current()) is not None:
            return kept
        df = self.inputs[0].changes()
        if self.keep:
            df = self._kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        return df

    def _bag(self, moments):
        if (kept := self._current()) is None:
            return self.inputs[0]._bag(moments)
        return moments.restrict(kept, self.depth)

    def release(self) -> None:
        """Let go of what is kept."""
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None


class Join(Collection):
    """Inner join on keys: rows left ++ the rest of right, at the least upper bound, diffs multiplied.

    Zero key columns give the cross product, as the operator's definition says.  Null keys join with nothing
    unless ``null_safe``.  ``dealt``: keys are few and each has many rows on both sides, so left rows are dealt over
    all tasks, and a small right side is broadcast to them.
    """

    def __init__(self, left: Collection, right: Collection, key_columns: int | list[str], null_safe: bool, dealt: bool = False):
        self.inputs, self.depth, self.null_safe, self.dealt = (left, right), _same_depth(left, right), null_safe, dealt
        self.scope = left.scope or right.scope
        self.left_keys, _ = _keys(left, key_columns)
        self.right_keys, rest = _keys(right, key_columns)
        names = []
        for c in rest:
            while c in left.columns or c in names:
                c += "_r"
            names.append(c)
        self.rest, self.columns = rest, [*left.columns, *names]

    def _described(self):
        left, right = (x.schema for x in self.inputs)
        kinds = [*left.fields, *[right[c] for c in self.rest]]
        return StructType([StructField(c, f.dataType) for c, f in zip(self.columns, kinds, strict=True)])

    def _joined(self, left: DataFrame, right: DataFrame, carried: list[str]) -> DataFrame:
        """Left columns as they are but for ``carried`` and the diff, which get a prefix on either side."""
        own = left.select(*self.inputs[0].columns, *[F.col(c).alias(f"__l{c}") for c in [*carried, DIFF]])
        names = self.columns[len(self.inputs[0].columns) :]
        other = right.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(self.right_keys)], *[F.col(c).alias(n) for c, n in zip(self.rest, names, strict=True)], *[F.col(c).alias(f"__r{c}") for c in [*carried, DIFF]])
        if self.dealt and scanned(right) <= SMALL:
            own, other = own.repartition(tasks(own)), F.broadcast(other)
        on = [own[c].eqNullSafe(other[f"__k{i}"]) if self.null_safe else own[c] == other[f"__k{i}"] for i, c in enumerate(self.left_keys)]
        if AT in carried:
            on.append(own[f"__l{AT}"] == other[f"__r{AT}"])
        out = own.join(other, fold_left(lambda a, b: a & b, on)) if on else own.crossJoin(other)
        return out.withColumn(DIFF, F.col(f"__l{DIFF}") * F.col(f"__r{DIFF}"))

    def _changes(self):
        left, right = (x._changes() for x in self.inputs)
        if self.left_keys and not self.null_safe and min(scanned(left), scanned(right)) > SMALL and (n := shares(left, right)) > 1:
            # Pairs are added up where they are found, so a task's groups grow with its keys: keys are dealt over parts by size.
            left, right = left.repartition(n, *self.left_keys), right.repartition(n, *self.right_keys)
        df = self._joined(left, right, self.times)
        return df.select(*self.columns, *bound_columns(self.depth, "__l", "__r"), DIFF)

    @property
    def paired(self):
        left, right = (x.schema for x in self.inputs)
        return all(left[a].dataType == right[b].dataType for a, b in zip(self.left_keys, self.right_keys, strict=True))

    def at(self, moments):
        return self._pairs(*(x.at(moments) for x in self.inputs), moments) if self.paired else super().at(moments)

    def _bag(self, moments):
        return self._pairs(*(x._bag(moments) for x in self.inputs), moments)

    def _pairs(self, left, right, moments):
        df = self._joined(left, right, moments.keys)
        return df.select(*self.columns, *[F.col(f"__l{AT}").alias(AT)] * len(moments.keys), DIFF)


def grid(changes: DataFrame, keys: list[str], times: list[str]) -> DataFrame:
    """(keys, times, __next per coordinate): each key's points, all combinations of its times per coordinate."""
    out = None
    for t in times:
        own = changes.select(*keys, t).distinct()
        own = own.withColumn(f"__next{t}", F.lead(t).over(Window.partitionBy(*keys).orderBy(t)))
        if out is None:
            out = own
        else:
            renamed = own.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)], t, f"__next{t}")
            on = [F.col(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)]
            out = (out.join(renamed, fold_left(lambda a, b: a & b, on)) if on else out.crossJoin(renamed)).drop(*[f"__g{i}" for i in range(len(keys))])
    return out


def differences(values: DataFrame, columns: list[str], times: list[str], ending: list[str] | None = None) -> DataFrame:
    """Changes from bags at grid points: each count comes in at its point and goes at the next of each coordinate.

    ``ending`` are the coordinates that have a next, if not all.
    """
    for t in times if ending is None else ending:
        step = F.array(F.struct(F.col(t).alias("t"), F.lit(1).cast("long").alias("s")), F.struct(F.col(f"__next{t}").alias("t"), F.lit(-1).cast("long").alias("s")))
        values = values.withColumn("__step", F.explode(step)).where("__step.t IS NOT NULL").withColumns({t: F.col("__step.t"), DIFF: F.col(DIFF) * F.col("__step.s")}).drop("__step")
    return summed(values, [*columns, *times])


def _upto_points(changes: DataFrame, points: DataFrame, keys: list[str], rest: list[str], times: list[str], how: str) -> DataFrame:
    own = changes.select(*[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)], *rest, *[F.col(t).alias(f"__c{t}") for t in times], DIFF)
    on = fold_left(lambda a, b: a & b, [*[F.col(k).eqNullSafe(F.col(f"__c{i}")) for i, k in enumerate(keys)], *[F.col(f"__c{t}") <= F.col(t) for t in times]])
    return points.join(own, on, how)


def as_of_grid(changes: DataFrame, points: DataFrame, keys: list[str], rows: list[str], times: list[str]) -> DataFrame:
    """(rows, times, __next.., __diff): the bag of each key as of each of its points."""
    rest = [c for c in rows if c not in keys]
    return summed(_upto_points(changes, points, keys, rest, times, "inner"), [*keys, *rest, *times, *[f"__next{t}" for t in times]])


def _reached(changes: DataFrame, points: DataFrame, keys: list[str], times: list[str]) -> DataFrame:
    """The points at or before which their key has a change; in one dimension, all."""
    return points if len(times) == 1 else _upto_points(changes, points, keys, [], times, "left_semi")


class Distinct(Collection):
    """Each row once if its count is not zero (a negative count is a row too)."""

    coalesced = indexed = stateful = bag_coalesced = True

    def __init__(self, input_: Collection):
        self.inputs, self.depth, self.columns, self.scope = (input_,), input_.depth, input_.columns, input_.scope

    def _changes(self):
        df = self.inputs[0].changes()
        if self.depth == 1:
            w = Window.partitionBy(*self.columns).orderBy("__t0")
            n = df.withColumn("__n", F.when(F.sum(DIFF).over(w.rowsBetween(Window.unboundedPreceding, 0)) != 0, 1).otherwise(0))
            step = n.withColumn(DIFF, (F.col("__n") - F.lag("__n", 1, 0).over(w)).cast("long"))
            return step.where(F.col(DIFF) != 0).select(*self.columns, *self.times, DIFF)
        points = grid(df, self.columns, self.times)
        bags = as_of_grid(df, points, self.columns, self.columns, self.times).withColumn(DIFF, F.lit(1).cast("long"))
        return differences(bags, self.columns, self.times).select(*self.columns, *self.times, DIFF)

    def _bag(self, moments):
        return self.inputs[0].at(moments).withColumn(DIFF, F.lit(1).cast("long"))


class Aggregate:
    """How a group becomes one value.  ``init`` is the value of a group that has lost all its rows."""

    linear = False

    def __init__(self, name: str, init=None):
        self.name, self.init = name, init

    def over(self, columns: list[str], schema: StructType) -> Column:
        """The value over (row, multiplicity) rows of a group, as an aggregate expression."""
        raise NotImplementedError


class Linear(Aggregate):
    """A function of sums of ``expression * multiplicity``, so a combiner works and changes are running sums."""

    linear = True

    def __init__(self, name: str, parts: list[Column], finish: Callable[..., Column], init=None):
        super().__init__(name, init)
        self.parts, self.finish = parts, finish

    def over(self, columns, schema):
        return self.finish(*[F.sum(p * F.col(DIFF)) for p in self.parts])


def total(expression: Column | str, name: str = "sum") -> Aggregate:
    e = F.col(expression) if isinstance(expression, str) else expression
    return Linear(name, [F.coalesce(e, F.lit(0))], lambda s: s, 0)


def count(name: str = "count") -> Aggregate:
    return Linear(name, [F.lit(1).cast("long")], lambda n: n, 0)


def average(expression: Column | str, name: str = "avg") -> Aggregate:
    e = F.col(expression) if isinstance(expression, str) else expression
    there = F.when(e.isNull(), 0).otherwise(1).cast("long")
    return Linear(name, [F.coalesce(e, F.lit(0)), there], lambda s, n: F.try_divide(s, n))


class _Plain(Aggregate):
    def __init__(self, name: str, aggregate: Callable[[Column], Column], expression: Column | str, init=None):
        super().__init__(name, init)
        self.aggregate, self.expression = aggregate, F.col(expression) if isinstance(expression, str) else expression

    def over(self, columns, schema):
        return self.aggregate(F.when(F.col(DIFF) != 0, self.expression))


def minimum(expression: Column | str, name: str = "min", init=None) -> Aggregate:
    return _Plain(name, F.min, expression, init)


def maximum(expression: Column | str, name: str = "max", init=None) -> Aggregate:
    return _Plain(name, F.max, expression, init)


class Fold(Aggregate):
    """``step(acc, row, count)`` over a group's rows in order (short strings first, then by bytes), from ``init``.

    ``row`` is a struct of the row's columns.  The fold is sequential by definition, so a group is one value
    of memory; sums, minima and the like scale and should be preferred.  Negative counts raise.
    """

    def __init__(self, name: str, init: Column, step: Callable[[Column, Column, Column], Column]):
        super().__init__(name, init)
        self.step = step

    def over(self, columns, schema):
        n = F.when(F.col(DIFF) > 0, F.col(DIFF)).otherwise(F.raise_error(F.lit("a fold met a negative multiplicity")).cast("long"))
        item = F.struct(row_order(columns, schema).alias("o"), F.struct(*columns).alias("r"), n.alias("n"))
        return F.aggregate(F.array_sort(F.collect_list(item)), self.init, lambda acc, x: self.step(acc, x["r"], x["n"]))


def concatenation(column: str, name: str = "concat", separator: str = "") -> Aggregate:
    """Strings joined in fold order, each as often as it occurs."""
    one = lambda r: F.concat(F.lit(separator), r[column])
    joined = lambda acc, r, n: F.concat(acc, F.repeat(one(r), n.cast("int")))
    return Fold(name, F.lit(""), joined)


class PythonFold(Aggregate):
    """``step(acc, row, count)`` in Python over a group's rows in fold order, from ``init``; ``kind`` is the result's type.

    With ``merge(a, b)`` (associative, ``init`` neutral) rows may be folded in parts of ``part`` rows each, whose
    results are merged in order; without, a group is folded in one go.  Negative counts raise.
    """

    def __init__(self, name: str, kind: str, init, step: Callable, merge: Callable | None = None, part: int = 4096):
        super().__init__(name, init)
        self.kind, self.step, self.merge, self.part = kind, step, merge, part

    def over(self, columns, schema):
        init, step, merge, part = self.init, self.step, self.merge, self.part

        def run(items):
            if merge is None:
                return fold_left(lambda acc, x: step(acc, tuple(x["r"]), x["n"]), items, init)
            parts = [fold_left(lambda acc, x: step(acc, tuple(x["r"]), x["n"]), items[at : at + part], init) for at in range(0, len(items), part)]
            return fold_left(merge, parts, init)

        n = F.when(F.col(DIFF) > 0, F.col(DIFF)).otherwise(F.raise_error(F.lit("a fold met a negative multiplicity")).cast("long"))
        item = F.struct(row_order(columns, schema).alias("o"), F.struct(*columns).alias("r"), n.alias("n"))
        ordered = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["r"].alias("r"), x["n"].alias("n")))
        return F.udf(run, self.kind)(ordered)


class Reduce(Collection):
    """One row per key and time: key ++ values.

    ``empty_groups="init"``: a key once seen keeps a row, with the aggregates' ``init`` when it has no rows.
    ``"drop"``: a key without rows has none, as in SQL (for linear aggregates: with a total count of zero).
    """

    indexed = stateful = bag_coalesced = True

    def __init__(self, input_: Collection, key_columns: int | list[str], aggregates: tuple[Aggregate, ...], empty_groups: str):
        if empty_groups not in ("init", "drop"):
            raise PlanError(f"empty_groups is init or drop, not {empty_groups}")
        if not aggregates:
            raise PlanError("a reduce needs an aggregate")
        self.inputs, self.depth, self.scope = (input_,), input_.depth, input_.scope
        self.keys, _ = _keys(input_, key_columns)
        self.aggregates, self.drop = aggregates, empty_groups == "drop"
        self.columns = [*self.keys, *[a.name for a in aggregates]]
        if len(set(self.columns)) < len(self.columns):
            raise PlanError("a key and a value have one name")
        self.coalesced = self._sums

    def _described(self):
        source = self.inputs[0]
        rows = source._like(StructType([*source.schema.fields, StructField(DIFF, LongType())]))
        return self._values(rows, self.keys).select(*self.columns).schema

    @property
    def _sums(self) -> bool:
        return all(a.linear for a in self.aggregates) and self.depth == 1

    def _values(self, bags: DataFrame, keys: list[str]) -> DataFrame:
        """Values of groups that have rows."""
        schema = self.inputs[0].schema
        return bags.groupBy(*keys).agg(*[a.over(self.inputs[0].columns, schema).alias(a.name) for a in self.aggregates], F.sum(DIFF).alias("__n"))

    def _with_empty(self, values: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
        """As :meth:`_values`, with the init values at points (keys and maybe more) that have no rows."""
        if self.drop:
            return values
        other = values.select(*[F.col(k).alias(f"__v{i}") for i, k in enumerate(keys)], *[a.name for a in self.aggregates], F.lit(True).alias("__some"))
        on = [F.col(k).eqNullSafe(F.col(f"__v{i}")) for i, k in enumerate(keys)]
        out = points.join(other, fold_left(lambda a, b: a & b, on), "left") if on else points.join(other, F.lit(True), "left")
        kinds = values.schema
        inits = {a.name: F.when(F.col("__some"), F.col(a.name)).otherwise((a.init if isinstance(a.init, Column) else F.lit(a.init)).cast(kinds[a.name].dataType)) for a in self.aggregates}
        return out.withColumns(inits)

    def _changes(self):
        if self._sums:
            return self._running(self.inputs[0]._changes() if self.drop else self.inputs[0].changes())
        df = self.inputs[0].changes()
        points = grid(df, self.keys, self.times)
        nexts = [f"__next{t}" for t in self.times]
        bags = as_of_grid(df, points, self.keys, self.inputs[0].columns, self.times)
        keys = [*self.keys, *self.times]
        values = self._values(bags, [*keys, *nexts])
        if not self.drop:
            values = self._with_empty(values.drop(*nexts), _reached(df, points, self.keys, self.times), keys)
        elif all(a.linear for a in self.aggregates):
            values = values.where("__n <> 0")
        return differences(values.withColumn(DIFF, F.lit(1).cast("long")), self.columns, self.times).select(*self.columns, *self.times, DIFF)

    def _running(self, df: DataFrame) -> DataFrame:
        """Running sums per key: summed by (key, time) before they meet in a key's window."""
        parts = [p for a in self.aggregates for p in a.parts]
        w = Window.partitionBy(*self.keys).orderBy("__t0")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        steps = df.groupBy(*self.keys, "__t0").agg(*[F.sum(p * F.col(DIFF)).alias(f"__p{i}") for i, p in enumerate(parts)], F.sum(DIFF).alias("__n"))
        sums = steps.select(*self.keys, "__t0", *[F.sum(f"__p{i}").over(upto).alias(f"__p{i}") for i in range(len(parts))], F.sum("__n").over(upto).alias("__n"))
        values, at = [], 0
        for a in self.aggregates:
            values.append(a.finish(*[F.col(f"__p{at + i}") for i in range(len(a.parts))]).alias(a.name))
            at += len(a.parts)
        now = sums.select(*self.keys, "__t0", F.struct(*values).alias("__now"), (F.col("__n") != 0).alias("__some") if self.drop else F.lit(True).alias("__some"))
        step = now.select(*self.keys, "__t0", "__now", "__some", F.lag("__now").over(w).alias("__before"), F.lag("__some", 1, False).over(w).alias("__had"))
        changed = step.where(~(F.col("__some") & F.col("__had") & F.col("__now").eqNullSafe(F.col("__before"))))
        both = F.array(F.when(F.col("__some"), F.struct(F.lit(1).cast("long").alias("d"), F.col("__now").alias("v"))), F.when(F.col("__had"), F.struct(F.lit(-1).cast("long").alias("d"), F.col("__before").alias("v"))))
        out = changed.select(*self.keys, "__t0", F.explode(both).alias("__x")).where("__x IS NOT NULL")
        return out.select(*self.keys, *[F.col(f"__x.v.{a.name}").alias(a.name) for a in self.aggregates], "__t0", F.col("__x.d").alias(DIFF))

    def _bag(self, moments):
        source, keys = self.inputs[0], [*self.keys, *moments.keys]
        linear = all(a.linear for a in self.aggregates)
        bag = source._bag(moments) if linear and self.drop else source.at(moments)
        values = self._values(bag, keys)
        if self.drop:
            values = values.where("__n <> 0" if linear else "__n IS NOT NULL")
        else:
            seen = moments.restrict(source.changes(), self.depth) if _has_history(source) else bag
            values = self._with_empty(values, seen.select(*keys).distinct(), keys)
        return values.select(*self.columns, *moments.keys, F.lit(1).cast("long").alias(DIFF))


def _has_history(node: Collection) -> bool:
    """Whether past changes of a node can be read: unless it is what a loop is still computing."""
    return node.scope is None or not any(x.unfinished for x in node.walk())


class Top(Collection):
    """The first rows of each key; evaluated on the bag as of each point.

    In one dimension a row's live spans are put to its key's times within a task.  Rows of a large table are dealt
    over parts, and the changes of the parts' first rows, which are few, then compete: keys may be few and large.
    """

    indexed = stateful = bag_coalesced = True

    def __init__(self, input_: Collection, key_columns: int | list[str], n: int, order: tuple[Column, ...]):
        self.inputs, self.depth, self.columns, self.scope = (input_,), input_.depth, input_.columns, input_.scope
        self.keys, _ = _keys(input_, key_columns)
        self.n, self.order = n, order

    def _first(self, bags: DataFrame, keys: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*self.order, *self.columns))
        return bags.withColumn("__r", rank).where(F.col("__r") <= self.n).drop("__r").withColumn(DIFF, F.lit(1).cast("long"))

    def _changes(self):
        df = self.inputs[0].changes()
        if self.depth == 1:
            if (n := shares(df)) > 1:
                part = F.pmod(F.xxhash64(*self.columns), F.lit(16 * n)).alias("__part")  # many, so that hashing them loads tasks evenly
                df = self._along(df.select("*", part).repartition(n, "__part"), ["__part"])
            return self._along(df, [])
        bags = as_of_grid(df, grid(df, self.keys, self.times), self.keys, self.columns, self.times)
        return differences(self._first(bags, [*self.keys, *self.times]), self.columns, self.times).select(*self.columns, *self.times, DIFF)

    def _along(self, df: DataFrame, part: list[str]) -> DataFrame:
        """The changes of the first rows of each key (and part)."""
        keys = [*part, *self.keys]
        own = Window.partitionBy(*part, *self.columns).orderBy("__t0")
        every = Window.partitionBy(*keys)
        count = F.sum(DIFF).over(own.rowsBetween(Window.unboundedPreceding, 0))
        spans = df.select(*part, *self.columns, "__t0", count.alias("__n"), F.lead("__t0").over(own).alias("__until"))
        timed = spans.withColumn("__times", F.array_sort(F.collect_set("__t0").over(every))).where("__n <> 0")
        points = F.transform("__times", lambda t, i: F.struct(t.alias("t"), F.get(F.col("__times"), i + 1).alias("next")))
        inside = F.filter(points, lambda p: (p["t"] >= F.col("__t0")) & (F.col("__until").isNull() | (p["t"] < F.col("__until"))))
        bags = timed.select(*part, *self.columns, F.explode(inside).alias("__p")).select(*part, *self.columns, F.col("__p.t").alias("__t0"), F.col("__p.next").alias("__next__t0"))
        return differences(self._first(bags, [*keys, "__t0"]), [*self.columns], self.times).select(*self.columns, "__t0", DIFF)

    def _bag(self, moments):
        return self._first(self.inputs[0].at(moments), [*self.keys, *moments.keys]).select(*self.columns, *moments.keys, DIFF)


class Grouped(Collection):
    """Any function of the bags of keys, each evaluated as of each of the key's times.

    ``function(bags, groups)`` gets (rows, groups, ``__diff``) and returns (groups, values), set-valued.
    """

    indexed = stateful = bag_coalesced = True

    def __init__(self, input_: Collection, key_columns: int | list[str], function: Callable[[DataFrame, list[str]], DataFrame], schema: StructType):
        self.inputs, self.depth, self.scope = (input_,), input_.depth, input_.scope
        self.keys, _ = _keys(input_, key_columns)
        self.function, self.schema, self.columns = function, schema, schema.names

    def _changes(self):
        df = self.inputs[0].changes()
        nexts = [f"__next{t}" for t in self.times]
        bags = as_of_grid(df, grid(df, self.keys, self.times), self.keys, self.inputs[0].columns, self.times)
        values = self.function(bags, [*self.keys, *self.times, *nexts]).withColumn(DIFF, F.lit(1).cast("long"))
        return differences(values, self.columns, self.times).select(*self.columns, *self.times, DIFF)

    def _bag(self, moments):
        values = self.function(self.inputs[0].at(moments), [*self.keys, *moments.keys])
        return values.select(*self.columns, *moments.keys, F.lit(1).cast("long").alias(DIFF))
