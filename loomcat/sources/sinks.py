"""Deliveries and reports as files, and what reading them back shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomcat import vocabulary as V
from loomcat.sources.workbook import read_sheets, write_sheet

BOM = "﻿"


def write_delivery(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """The delivery as parquet, or as csv with a header and empty cells kept; one file per task."""
    rows = df.select(*V.DELIVERY)
    if kind == "csv":
        rows.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="", quoteAll=True, escape='"')
    else:
        rows.write.mode("overwrite").parquet(path)


def write_csv_file(df: DataFrame, path: str) -> int:
    """A small delivery as one csv file with a byte-order mark; rows stream through the driver, some at a time."""
    import csv

    n = 0
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(BOM)
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def write_workbook(df: DataFrame, path: str) -> int:
    """A small delivery as a workbook with a frozen header and a filter; rows stream through the driver. Gives their number."""
    n = 0

    def rows():
        nonlocal n
        for row in df.toLocalIterator():
            n += 1
            yield row

    write_sheet(path, df.columns, rows())
    return n


def workbook_cells(path: str) -> tuple[int, int]:
    """Rows and populated cells of a written workbook, read again, its header left out."""
    rows = next(iter(read_sheets(path).values()))[1:]
    return len(rows), sum(bool(c.strip()) for r in rows for c in r)


def append_decisions(rows: DataFrame, path: str) -> None:
    """Decisions, added to the log in a folder; nothing that stands there is changed."""
    rows.write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """A table as lines of JSON."""
    df.write.mode("overwrite").json(path)


def read_back(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A written delivery, all cells as strings."""
    return spark.read.csv(path, header=True, inferSchema=False, escape='"').fillna("") if kind == "csv" else spark.read.parquet(path)


def schema_problems(df: DataFrame) -> list[str]:
    """How the columns of a written delivery differ from the contract; empty if they do not."""
    out = [f"missing {c}" for c in V.DELIVERY if c not in df.columns] + [f"unexpected {c}" for c in df.columns if c not in V.DELIVERY]
    return out or ([] if df.columns == V.DELIVERY else ["columns in another order"])


def contents(df: DataFrame, key: str = "SKU") -> DataFrame:
    """One row: rows, populated cells, first and last key."""
    cells = sum(((F.trim(F.coalesce(F.col(c), F.lit(""))) != "").cast("long") for c in df.columns), F.lit(0))
    return df.agg(F.count("*").alias("n_rows"), F.sum(cells).alias("n_populated"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
