"""Rows through an Arrow function: the row of a table as one struct, so that no column name can clash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def named(column: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def as_row(df: DataFrame) -> Column:
    """All columns of a table as one struct ``row``."""
    return F.struct(*[named(c) for c in df.columns]).alias("row")


def attach(df: DataFrame, text_col: str, results: str, fn: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``(row, *results)``: ``fn`` gives the result columns (named and typed by ``results``) of an array of texts."""
    base = df.select(as_row(df), named(text_col).cast("string").alias("text"))
    fields = StructType.fromDDL(results).fields
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *fn(batch.column(1))], ["row", *names])

    return base.mapInArrow(run, StructType([StructField("row", base.schema["row"].dataType), *fields]))


def restored(found: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The original columns of ``attach``'s input, some of them replaced."""
    row = found["row"]
    return found.select(*[(replaced[c] if c in replaced else row.getField(c)).alias(c) for c in columns])
