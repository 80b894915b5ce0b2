"""Writers: parquet, versioned tables that are whole at every moment, CSV tables, JSON and text reports."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: In a table's folder: that of the marks of its committed versions, and how folders of rows begin (hidden from a plain read).
MARKS, DATA = "_versions", "_rows"


def write_parquet(df: DataFrame, path: str, rows_per_file: int | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """A result table of a few rows as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _plain(x):
    if isinstance(x, float) and (math.isnan(x) or math.isinf(x)):
        return None
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [_plain(v) for v in x]
    return x if isinstance(x, str | int | float | bool | None) else str(x)


def json_report(tables: Mapping[str, DataFrame], most: int = 10_000) -> str:
    """Result tables as one JSON text; raises if one has over ``most`` rows."""
    out = {}
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} is not a result table: over {most} rows")
        out[name] = [_plain(r.asDict(recursive=True)) for r in rows]
    return json.dumps(out, indent=2, ensure_ascii=False)


def text_report(tables: Mapping[str, DataFrame], most: int = 10_000) -> str:
    """Result tables in columns of fixed width."""
    parts = []
    for name, rows in json.loads(json_report(tables, most)).items():
        parts += ["=" * 72, name, "=" * 72]
        columns = list(rows[0]) if rows else []
        cells = [columns, *[["" if r[c] is None else f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in columns] for r in rows]]
        widths = [max(len(r[i]) for r in cells) for i in range(len(columns))]
        parts += ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in cells if columns] + [""]
    return "\n".join(parts)


def _versions(spark: SparkSession, path: str):
    """The table's file system and the numbers of its versions that are committed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = [f.getPath().getName() for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path, MARKS))] if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, MARKS)) else []
    return fs, sorted(int(m) for m in marks if m.isdigit())


def write_version(df: DataFrame, path: str, rows_per_file: int | None = None) -> int:
    """A new version of the table, whole or not at all; gives its number.

    The rows go to a folder of a name that no one else has, and count from the one rename that puts a mark with the
    version's number and that name in place. Two writers of one number can't both do that: the second one's rename finds
    the mark there and raises. What a stopped writer left is never read.
    """
    spark = df.sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs, known = _versions(spark, path)
    number, folder = (known[-1] + 1 if known else 0), f"{DATA}-{uuid.uuid4().hex}"
    writer = df.write.option("maxRecordsPerFile", rows_per_file) if rows_per_file else df.write
    writer.parquet(f"{path}/{folder}")
    draft, mark = path_of(f"{path}/{folder}.mark"), path_of(f"{path}/{MARKS}/{number:012d}")
    out = fs.create(draft, True)
    out.write(bytearray(folder.encode()))
    out.close()
    fs.mkdirs(path_of(path, MARKS))
    if fs.exists(mark) or not fs.rename(draft, mark):
        raise RuntimeError(f"version {number} of {path} was written by another")
    return number


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table as of a version, the last committed one if none is given."""
    fs, known = _versions(spark, path)
    if not known or (number is not None and number not in known):
        raise FileNotFoundError(f"{path} has no version {'' if number is None else number}")
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MARKS}/{known[-1] if number is None else number:012d}")
    file = fs.open(mark)
    folder = bytes(file.readAllBytes()).decode()
    file.close()
    return spark.read.parquet(f"{path}/{folder}")


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove all but the last ``keep`` versions, marks first, then folders without a mark; only while no one writes."""
    fs, known = _versions(spark, path)
    path_of, gone = spark._jvm.org.apache.hadoop.fs.Path, known[: max(0, len(known) - keep)]
    for n in gone:
        fs.delete(path_of(f"{path}/{MARKS}/{n:012d}"), False)
    kept = set()
    for n in known[len(gone) :]:
        file = fs.open(path_of(f"{path}/{MARKS}/{n:012d}"))
        kept.add(bytes(file.readAllBytes()).decode())
        file.close()
    for f in fs.listStatus(path_of(path)):
        name = f.getPath().getName()
        if name.startswith(f"{DATA}-") and name not in kept:
            fs.delete(f.getPath(), True)
    return len(gone)


def append_column(path: str, spark: SparkSession, column: str, value: Column, needs: list[str]) -> bool:
    """A new version of the table with one more column, unless it is there or its inputs are missing.

    A plain folder of Parquet files (without marks) is taken as it stands and becomes a table of versions beside it.
    """
    _, known = _versions(spark, path)
    df = read_version(spark, path) if known else spark.read.parquet(path)
    if column in df.columns or not set(needs) <= set(df.columns):
        return False
    write_version(df.withColumn(column, value), path)
    return True


def adjudication_sheet(flagged: DataFrame, dims: list[str]) -> DataFrame:
    """Rows to adjudicate with an empty adj_ column for each dimension and the style."""
    blanks = [F.lit("").alias(f"adj_{d}") for d in [*dims, "intervention_style"]]
    return flagged.select("*", *blanks, F.lit("").alias("adjudicator_notes"))
