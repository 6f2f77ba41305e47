"""Running a dataflow: inputs are pushed to, flushed and advanced; outputs are popped.

An output that waits for closed times (anything but maps, filters and unions of inputs) gives the changes at
times that its inputs' frontiers have passed, each once; other outputs give what has been flushed.  As batches
carry no meaning, only their sum does, both are ordinary DataFrames of changes.
"""

from __future__ import annotations

from collections import deque
from functools import reduce as fold_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import Frontier, Order, Time, causal, coordinates, least
from ..operators import nodes
from ..operators.loops import Loop
from ..operators.nodes import DIFF, Collection, Join, PlanError
from .graph import Graph, Output, log_like
from .graph import Input as InputSpec


class LateData(ValueError):
    """A change lies before its input's frontier."""


class Trace:
    """Events of a run, oldest first, if switched on."""

    def __init__(self):
        self.on, self.events = False, []

    def add(self, kind: str, **what) -> None:
        if self.on:
            self.events.append({"kind": kind, **what})


class FlowInput(nodes.Input):
    """An input whose log grows."""

    def __init__(self, log: DataFrame, depth: int, trace: Trace, late: str = "error"):
        super().__init__(log, depth)
        self._base, self.flushed, self._buffer, self.trace, self.late = log, [], [], trace, late
        self.frontier = Frontier([least(depth)])
        self.only: int | None = None

    @property
    def log(self) -> DataFrame:
        parts = self.flushed if self.only is None else self.flushed[self.only :]
        return fold_left(DataFrame.union, parts, self._base)

    @log.setter
    def log(self, value: DataFrame) -> None:
        self._schema_source = value

    def _described(self):
        return self._base.select(*self.columns).schema

    def _session(self):
        return self._base.sparkSession

    def push(self, row: tuple, time: Time = (0,), diff: int = 1) -> None:
        """Buffer a change.  Late data is an error, or is moved up to the frontier with ``late="reassign"``."""
        if not any(causal(t, time) in (Order.LT, Order.EQ) for t in self.frontier.times):
            if self.late != "reassign":
                raise LateData(f"{time} is before the frontier {sorted(self.frontier.times)}")
            time = tuple(map(max, time, min(self.frontier.times)))
        self._buffer.append((row, time, diff))
        self.trace.add("push", row=row, time=time, diff=diff)

    def push_frame(self, df: DataFrame) -> None:
        """Flush a DataFrame of changes in the log's form (columns, ``__t0``.., ``__diff``)."""
        df = df.select(*self._base.columns)
        past = lambda f: fold_left(lambda a, b: a & b, [F.col(t) >= x for t, x in zip(self.times, f, strict=True)])
        in_time = fold_left(lambda a, b: a | b, [past(f) for f in self.frontier.times], F.lit(False))
        late = df.where(~in_time).select(*self.times).first()
        if late is not None:
            if self.late != "reassign":
                raise LateData(f"{tuple(late)} is before the frontier {sorted(self.frontier.times)}")
            moved = min(self.frontier.times)
            df = df.withColumns({t: F.when(in_time, F.col(t)).otherwise(F.greatest(F.col(t), F.lit(x))) for t, x in zip(self.times, moved, strict=True)})
        self.flush()
        self.flushed.append(df)
        self.trace.add("flush")

    def flush(self) -> None:
        if self._buffer:
            self.flushed.append(log_like(self._form(), self._buffer))
            self.trace.add("flush", n=len(self._buffer))
            self._buffer = []

    def _form(self) -> nodes.Input:
        return nodes.Input(self._base, self.depth)

    def advance(self, *time: int) -> None:
        """Flush, and promise that nothing earlier than ``time`` comes; going back does nothing."""
        self.flush()
        changes = self.frontier.move_later(tuple(time))
        self.trace.add("advance", frontier=sorted(self.frontier.times), changes=changes)


class FlowOutput:
    """A sink: what has been found and not popped yet."""

    def __init__(self, node: Collection, inputs: list[FlowInput]):
        self.node, self.queue = node, deque()
        self.inputs = [x for x in inputs if any(y is x for y in node.walk()) or self._through_loops(node, x)]
        self.waits = any(n.stateful or isinstance(n, Join) for n in node.walk())
        self.seen = {id(x): 0 for x in self.inputs}
        self.closed: int | None = None

    @staticmethod
    def _through_loops(node: Collection, x: FlowInput) -> bool:
        seen, open_ = set(), [node]
        while open_:
            n = open_.pop()
            if id(n) in seen:
                continue
            seen.add(id(n))
            if n is x:
                return True
            open_ += n.inputs
            if isinstance(n.scope, Loop):
                open_ += [v.body for v in n.scope.variables if v.body is not None]
        return False

    def has_work(self) -> bool:
        if self.waits:
            return self._upto() > (self.closed or 0)
        return any(len(x.flushed) > self.seen[id(x)] for x in self.inputs)

    def _upto(self) -> int:
        return min((min(t[0] for t in x.frontier.times) for x in self.inputs), default=0)

    def work(self) -> DataFrame | None:
        if not self.has_work():
            return None
        if self.waits:
            if len({x.depth for x in self.inputs}) != 1 or self.inputs[0].depth != 1:
                raise PlanError("outputs that wait need inputs at the top level")
            new = self._changes().where((F.col("__t0") >= (self.closed or 0)) & (F.col("__t0") < self._upto()))
            self.closed = self._upto()
            return new
        for x in self.inputs:
            x.only, self.seen[id(x)] = self.seen[id(x)], len(x.flushed)
        try:
            return self.node.changes()
        finally:
            for x in self.inputs:
                x.only = None

    def _changes(self) -> DataFrame:
        if isinstance(self.node.scope, Loop):
            return self.node.scope.trace(self.node)
        return self.node.changes()

    def pop(self) -> DataFrame | None:
        """The next batch (columns, ``__t0``.., ``__diff``), or None."""
        return self.queue.popleft() if self.queue else None


class Flow:
    """A dataflow built with operator methods on its inputs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.inputs, self.outputs, self.trace, self._built = spark, [], [], Trace(), False

    def input(self, schema: str, *, late: str = "error") -> FlowInput:
        self._building()
        self.inputs.append(FlowInput(self.spark.createDataFrame([], f"{schema}, __t0 long, {DIFF} long"), 1, self.trace, late))
        return self.inputs[-1]

    def loop(self, **options) -> Loop:
        self._building()
        return Loop(self.spark, **options)

    def output(self, node: Collection) -> FlowOutput:
        self._building()
        self.outputs.append(FlowOutput(node, self.inputs))
        return self.outputs[-1]

    def _building(self) -> None:
        if self._built:
            raise PlanError("the flow is already built")

    def build(self) -> Flow:
        for out in self.outputs:
            for node in out.node.walk():
                if isinstance(node.scope, Loop) and any(v.body is None for v in node.scope.variables):
                    raise PlanError("a loop variable has no body")
        self._built = True
        return self

    def has_work(self) -> bool:
        return any(o.has_work() for o in self.outputs)

    def do_work(self) -> None:
        """One step: the first output with work gets a batch."""
        for o in self.outputs:
            if o.has_work():
                batch = o.work()
                self.trace.add("output", output=self.outputs.index(o))
                if batch is not None:
                    o.queue.append(batch)
                return

    def do_all_work(self) -> None:
        while self.has_work():
            self.do_work()


class Shard:
    """A validated graph, running."""

    def __init__(self, spark: SparkSession, graph: Graph):
        self.flow = Flow(spark)
        self._nodes = graph.collections(spark)
        for n, spec in enumerate(graph.specs):
            if isinstance(spec, InputSpec):
                own = FlowInput(self._nodes[n]._base if isinstance(self._nodes[n], FlowInput) else self._nodes[n].log, self._nodes[n].depth, self.flow.trace)
                own.scope = self._nodes[n].scope
                self._replace(self._nodes[n], own)
                self._nodes[n] = own
                self.flow.inputs.append(own)
        self._outputs = {n: self.flow.output(self._nodes[n]) for n, spec in enumerate(graph.specs) if isinstance(spec, Output)}
        self.flow.build()

    def _replace(self, old: Collection, new: Collection) -> None:
        for node in self._nodes:
            node.inputs = tuple(new if x is old else x for x in node.inputs)

    def push_input(self, node: int, row: tuple, time: Time, diff: int = 1) -> None:
        self._nodes[node].push(row, time, diff)

    def flush_input(self, node: int) -> None:
        self._nodes[node].flush()

    def advance_input(self, node: int, time: Time) -> None:
        self._nodes[node].advance(*time)

    def has_work(self) -> bool:
        return self.flow.has_work()

    def do_work(self) -> None:
        self.flow.do_work()

    def pop_output(self, node: int) -> DataFrame | None:
        return self._outputs[node].pop()


def batch_of(df: DataFrame | None, depth: int = 1) -> list[tuple]:
    """A batch as (row, time, diff), sorted: for tests and small results."""
    if df is None:
        return []
    times = coordinates(depth)
    rows = [c for c in df.columns if c not in {*times, DIFF}]
    return sorted((tuple(r[c] for c in rows), tuple(r[t] for t in times), r[DIFF]) for r in df.collect())

