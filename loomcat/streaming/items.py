"""Items as a stream: cleaned and tokenised row by row, late and repeated records dropped, family sizes kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomcat.functions import text, tokens
from loomcat.operators.families import family_key

SCHEMA = "row_id long, part_number string, description string, part_manuf string, feed string, listed_at timestamp_ntz, received_at timestamp_ntz"


def read(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Item files of a folder as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def cleaned(stream: DataFrame) -> DataFrame:
    """Stateless: clean cells, skeleton and family key of each record."""
    toks = tokens.tokens(text.clean(F.col("description")))
    told = stream.withColumn("skeleton", tokens.skeleton(toks))
    return told.withColumn("part_manuf", text.clean(F.col("part_manuf"))).withColumn("family", family_key())


def once(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Each row_id once, for as long as it may be sent again; a record without time of receipt is timed by its listing."""
    timed = stream.withColumn("at", F.coalesce("received_at", "listed_at").cast("timestamp"))
    return timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["row_id"])


def family_sizes(stream: DataFrame) -> DataFrame:
    """family, size, over all records so far; update mode."""
    return stream.where("family is not null").groupBy("family").agg(F.count("*").alias("size"))


def received(stream: DataFrame, window: str = "7 days", late: str = "14 days") -> DataFrame:
    """feed, from, records received per window; windows close behind the watermark."""
    timed = stream.where("received_at is not null").withColumn("at", F.col("received_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), "feed").agg(F.count("*").alias("records")).select(F.col("w.start").alias("from"), "feed", "records")
