"""Dense numbers over a global order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomcat.session import settled

_IN_PARTITION = (1 << 33) - 1


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """df with a dense number by the given order, from `start` on.

    Rows are range-partitioned and sorted; each partition counts its own rows and begins behind those before it. Only
    one number per partition reaches the driver. The order must be total for the numbers to be reproducible.
    """
    df = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted((r[0], r[1]) for r in df.groupBy(part.alias("p")).count().collect())
    if not counts:
        return df.withColumn(name, F.lit(None).cast("long")).drop("_at")
    before, offsets = start, []
    for p, n in counts:
        offsets += [F.lit(p), F.lit(before)]
        before += n
    offset = F.try_element_at(F.create_map(*offsets), part)
    return df.withColumn(name, (offset + F.col("_at").bitwiseAND(F.lit(_IN_PARTITION))).cast("long")).drop("_at")
