"""Table functions: rows of a table argument in, rows out, a partition a key.

A call names how its table is dealt and ordered, ``f(TABLE(t) PARTITION BY k ORDER BY o)``; Spark shuffles and sorts, and the
function sees one partition's rows in order and keeps a few numbers between them. Their result types follow from the
table that they are called with.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _extended(table: AnalyzeArgument, *more: tuple[str, T.DataType]) -> T.StructType:
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(name) PARTITION BY key ORDER BY order")
    taken = set(table.dataType.names) & {n for n, _ in more}
    if taken:
        raise ValueError(f"the table has columns {sorted(taken)} already")
    return T.StructType([*table.dataType.fields, *[T.StructField(n, kind) for n, kind in more]])


class Batches:
    """``batches(TABLE(t) PARTITION BY k ORDER BY (o), size)``: rows and ``batch``, ``size`` consecutive rows of a partition a batch."""

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        if size.value is None or size.value < 1:
            raise ValueError("a batch has one row at least")
        return AnalyzeResult(schema=_extended(table, ("batch", T.LongType())))

    def __init__(self) -> None:
        self.seen = 0

    def eval(self, table: Row, size: int) -> Iterator[tuple]:
        yield (*table, self.seen // size)
        self.seen += 1


class TrajectoryEvents:
    """``trajectory_events(TABLE(t) PARTITION BY k ORDER BY step)``: rows with ``acc`` and ``learned`` and ``forgot``, whether the row
    goes from wrong to right or from right to wrong; before the first row the example is wrong."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        schema = _extended(table, ("learned", T.BooleanType()), ("forgot", T.BooleanType()))
        if "acc" not in schema.names or schema["acc"].dataType != T.BooleanType():
            raise ValueError("the table has no boolean column acc")
        return AnalyzeResult(schema=schema)

    def __init__(self) -> None:
        self.before = False

    def eval(self, table: Row) -> Iterator[tuple]:
        acc = table["acc"]
        yield (*table, not self.before and acc, self.before and not acc)
        self.before = acc


TABLES = {"batches": Batches, "trajectory_events": TrajectoryEvents}


def register_tables(spark: SparkSession) -> list[str]:
    """Puts the table functions into the session and returns their names."""
    from pyspark.sql.functions import udtf

    for name, function in TABLES.items():
        spark.udtf.register(name, udtf(function))
    return sorted(TABLES)
