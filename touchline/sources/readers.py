"""Reading and writing: tables with declared schemas, fallback tiers, quarantine of broken rows, a file-backed data source."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import conform, schema_of


def read_csv(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV file that fit the table's schema, and those that don't, as text, for quarantine. Columns are matched by name."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    wide = T.StructType([T.StructField(c, T.StringType()) for c in raw.columns] + [T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(wide).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)
    bad = rows.where("_corrupt_record is not null").select("_corrupt_record")
    return conform(rows.where("_corrupt_record is null").drop("_corrupt_record"), schema_of(table)), bad


def append(df: DataFrame, path: str) -> None:
    """Append-only sink; nothing is ever deduplicated here."""
    df.write.mode("append").parquet(path)


@dataclass(frozen=True)
class Tier:
    label: str
    load: Callable[[], DataFrame | None]


def first_with_rows(tiers: list[Tier], empty: DataFrame) -> DataFrame:
    """The first tier that has a row, with its label in source_label and, if it isn't the first, a warning; a tier that fails is skipped."""
    failed: list[str] = []
    for tier in tiers:
        try:
            df = tier.load()
        except Exception as e:  # a source that is down must not stop the others
            failed.append(f"{tier.label}: {type(e).__name__}")
            continue
        if df is not None and not df.isEmpty():
            return df.withColumns({"source_label": F.lit(tier.label), "warning": F.lit("; ".join(failed))})
        failed.append(f"{tier.label}: empty")
    return empty.withColumns({"source_label": F.lit("none"), "warning": F.lit("; ".join(failed))})


def fresh(df: DataFrame, at: str, now, hours: float) -> DataFrame:
    """Rows that were updated within ``hours`` before ``now``."""
    return df.where(F.col(at) >= F.lit(now).cast("timestamp") - F.expr(f"make_dt_interval(0, {int(hours)}, {int(hours * 60) % 60}, 0)"))


def date_chunks(start: date, end: date, days: int) -> list[tuple[date, date]]:
    """Both ends inclusive, ``days`` a chunk at most."""
    out = []
    while start <= end:
        to = min(end, start + timedelta(days - 1))
        out.append((start, to))
        start = to + timedelta(1)
    return out


class Chunk(InputPartition):
    def __init__(self, start: date, end: date):
        self.start, self.end = start, end


class MatchFiles(DataSource):
    """`spark.read.format("match_files")`: JSON-lines files of fixtures, one partition for each chunk of dates.

    Options: path (a folder with one file a day, YYYY-MM-DD.jsonl, that all executors see), start, end, days (of a chunk).
    """

    @classmethod
    def name(cls) -> str:
        return "match_files"

    def schema(self) -> T.StructType:
        return schema_of("fixtures")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MatchFilesReader(self.options, schema)


class MatchFilesReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = dict(options), schema

    def partitions(self) -> list[InputPartition]:
        o = self.options
        return [Chunk(a, b) for a, b in date_chunks(date.fromisoformat(o["start"]), date.fromisoformat(o["end"]), int(o.get("days", 7)))]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        import os

        day = partition.start
        while day <= partition.end:
            path = os.path.join(self.options["path"], f"{day.isoformat()}.jsonl")
            if os.path.exists(path):
                with open(path, encoding="utf-8") as f:
                    for line in f:
                        row = json.loads(line)
                        yield tuple(date.fromisoformat(row[x.name]) if isinstance(x.dataType, T.DateType) and row.get(x.name) else row.get(x.name) for x in self.schema.fields)
            day += timedelta(1)


#: labels of a text report and the columns that their numbers go to
REPORT_FIELDS = {"home_win": r"home win\s*:?\s*([0-9.]+)\s*%", "draw": r"draw\s*:?\s*([0-9.]+)\s*%", "away_win": r"away win\s*:?\s*([0-9.]+)\s*%"}


def parse_report(df: DataFrame, text: str = "text") -> DataFrame:
    """Probabilities from a report's text, the last mention of each; and whether they can be imported (they sum to about 1)."""
    last = lambda p: F.element_at(F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(1)), -1).try_cast("double") / 100
    has = lambda p: F.when(F.lower(text).rlike(p), last(p))
    out = df.withColumns({k: has(p) for k, p in REPORT_FIELDS.items()})
    total = F.col("home_win") + F.col("draw") + F.col("away_win")
    return out.withColumn("status", F.when(total.isNull(), "missing_probabilities").when(~total.between(0.98, 1.02), "probabilities_do_not_sum").otherwise("importable"))
