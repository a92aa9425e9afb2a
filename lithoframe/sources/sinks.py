"""Writers: spreadsheet CSV, dossiers, logs and event lines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def _flat(df: DataFrame) -> DataFrame:
    """Array columns as text."""
    lists = {f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType)}
    return df.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), "; ").alias(c) if c in lists else F.col(c) for c in df.columns])


def spreadsheet_csv(df: DataFrame, path: str) -> None:
    """Semicolons, CRLF and a byte-order mark before the first header, as spreadsheets expect."""
    flat = _flat(df)
    flat.withColumnRenamed(flat.columns[0], "﻿" + flat.columns[0]).write.mode("overwrite").option("header", True).option("sep", ";").option("lineSep", "\r\n").option("quoteAll", False).csv(path)


def dossier_files(df: DataFrame, path: str) -> None:
    """The dossier as JSON and CSV, and its sections as Markdown lines."""
    df.write.mode("overwrite").json(f"{path}/json")
    _flat(df).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    head = df.groupBy("section").agg(F.count("*").alias("n"))
    head.select(F.format_string("## %s\n\n%d decisions\n", "section", "n").alias("value")).write.mode("overwrite").text(f"{path}/markdown")


def append_log(events: DataFrame, path: str) -> None:
    """Append-only JSON log."""
    events.write.mode("append").json(path)


def event_lines(df: DataFrame) -> Iterator[str]:
    """Rows as JSON lines, fetched partition by partition."""
    for row in df.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator():
        yield row.line
