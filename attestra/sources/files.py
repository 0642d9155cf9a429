"""Sources and sinks: binary uploads, archives of images, run logs, ragged tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from attestra.functions.text import file_type


def uploads(spark: SparkSession, path: str, most_bytes: int = 20 << 20) -> DataFrame:
    """Files with their sniffed type; ``error`` names oversized ones instead of dropping them. (Spark's reader skips files without any byte.)"""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    error = F.when(F.col("length") > most_bytes, "too large")
    return f.select("path", "length", "modificationTime", file_type(F.col("content")).alias("extension"), error.alias("error"), F.when(error.isNull(), F.col("content")).alias("content"))


_ENTRY = "archive string, entry string, parent string, name string, size long, error string, content binary"


def archive_entries(files: DataFrame, most_bytes: int = 20 << 20, most_total: int = 200 << 20, most_files: int = 100) -> DataFrame:
    """Entries of ZIP archives in (path, content). Folders and system files go; unsafe, encrypted and oversized entries carry an error."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _ENTRY.split(", ")]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    rows.append((path, None, None, None, None, "not an archive", None))
                    continue
                total, kept = 0, 0
                for e in z.infolist():
                    parts = e.filename.replace("\\", "/").split("/")
                    if e.is_dir() or "__MACOSX" in parts or parts[-1] in (".DS_Store", "Thumbs.db"):
                        continue
                    total, kept = total + e.file_size, kept + 1
                    unsafe = e.filename.startswith(("/", "\\")) or ".." in parts
                    error = "unsafe path" if unsafe else "encrypted" if e.flag_bits & 1 else "too large" if e.file_size > most_bytes or total > most_total else "too many files" if kept > 2 * most_files else None
                    rows.append((path, e.filename, "/".join(parts[:-1]), parts[-1], e.file_size, error, None if error else z.read(e)))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(expand, _ENTRY)


def run_log(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines of all files under a folder; broken lines are kept in ``_corrupt_record``, blank ones skipped."""
    r = spark.read.option("recursiveFileLookup", "true").option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema else r).json(path).withColumn("file", F.col("_metadata.file_path"))


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def gpu_samples(lines: DataFrame) -> DataFrame:
    """Rows of (used MB, total MB, load %) from comma-separated monitor output; short rows go, bad numbers are null."""
    p = F.split("value", ",")
    n = lambda i: F.trim(F.regexp_replace(F.get(p, F.lit(i)), r"[^0-9.\-]", "")).try_cast("double")
    return lines.where(F.size(p) >= 3).select(n(0).alias("used_mb"), n(1).alias("total_mb"), n(2).alias("load"))


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, for writers of flat files."""
    nested = (ST.StructType, ST.ArrayType, ST.MapType)
    return df.select(*(F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields))


def write_csv(frames: list[DataFrame], path: str) -> None:
    """One table with the sorted union of all columns; what a frame lacks is empty."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(flat, frames))
    df.select(*sorted(df.columns)).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    df = df.select(*sorted(df.columns))
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A report table; a report is small, so the limit is the feature."""
    rows = [df.columns, ["---"] * len(df.columns), *([("" if v is None else str(v)) for v in r] for r in df.limit(most).collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
