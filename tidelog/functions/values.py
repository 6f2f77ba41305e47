"""Orders and keys of row values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType, StructType


def fold_order(column: Column, kind: DataType) -> Column:
    """Sort key of a value in folds: shorter strings before longer ones, then by bytes; others as they are."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.struct(F.octet_length(column).alias("n"), column.alias("v"))
    return column


def row_order(columns: list[str], schema: StructType) -> Column:
    return F.struct(*[fold_order(F.col(c), schema[c].dataType).alias(f"o{i}") for i, c in enumerate(columns)])


def day_number(ts: Column, start: str) -> Column:
    """Days since ``start`` as a logical time."""
    return F.datediff(ts.cast("date"), F.lit(start).cast("date")).cast("long")


def bucket(ts: Column, unit: str) -> Column:
    """A timestamp cut to ``unit`` (hour, day, ...), for tumbling windows by map and reduce."""
    return F.date_trunc(unit, ts)
