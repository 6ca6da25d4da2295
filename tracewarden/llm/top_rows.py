"""The first rows of each key under an order, without gathering a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: Sequence[str], rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key with their ``rank`` from 1.

    Every key is first cut into ``SALTS`` parts by a hash of the columns ``spread``; only the first rows of the parts
    meet.  Spark limits each part below its shuffle too.
    """
    part = F.pmod(F.xxhash64(*spread), F.lit(SALTS))
    for by in ([*keys, "_part"], list(keys)):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        df = df.withColumn("_part", part).withColumn(rank, place).where(F.col(rank) <= n).drop("_part")
    return df
