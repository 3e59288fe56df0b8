"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learntrace.session import cut, stored

#: ASCII white space, as a character class body for Java regular expressions.
WS = r"\x20\x09-\x0D"

#: Rows up to which a side may be broadcast (a row is an id or a hash, under 100 bytes).
BROADCAST_ROWS = 200_000

#: The number of a row, where keys may be null or repeated.
ROW = "_lt_row"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def columns(df: DataFrame, *without: str) -> list[Column]:
    """The columns of ``df`` but the named ones, whatever characters their names have."""
    return [F.col(f"`{c}`") for c in df.columns if c not in without]


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted size is within the bound, else joined by shuffle.

    ``df`` must be cheap to count: a checkpoint or a small table."""
    few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df.hint("merge")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` checkpointed with a number of its own for each row."""
    return cut(df.withColumn(ROW, F.monotonically_increasing_id()))


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is not in ``ids``; a null key matches a null key."""
    gone = small_side(stored(ids.select(F.col(key).alias("_lt_gone")).distinct()))
    return docs.join(gone, F.col(key).eqNullSafe(F.col("_lt_gone")), "left_anti")
