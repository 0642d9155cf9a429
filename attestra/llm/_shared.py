"""Written tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; where none is set and all runs on one machine, a new temporary one is. A cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_made: list[str] = []  # folders and, without a slash, catalog tables that this process wrote


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/attestra-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def new_table(name: str) -> str:
    _made.append(f"attestra_{name}_{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How many intermediate tables this process has so far."""
    return len(_made)


def clean_up(spark: SparkSession, keep: DataFrame | None = None, since: int = 0) -> None:
    """Removes the intermediate tables that this process wrote (after the first ``since``), but those that ``keep`` reads. Results of operators that read them and are not written yet are lost."""
    files = set(keep.inputFiles()) if keep is not None else set()
    some = _made[since:]
    kept = [p for p in some if "/" in p and any(f"/{p.rsplit('/', 1)[1]}/" in f for f in files)]
    for place in some:
        if "/" not in place:
            spark.sql(f"drop table if exists {place}")
        elif place not in kept:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made[since:] = kept


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """Bytes of text in a table: one scan of one column, one row back."""
    return docs.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0


def numbered(docs: DataFrame) -> Column:
    """doc_id, or for rows without one a number from 2**62 on made of the text: they sort after ids below it, and equal texts share it. It never leaves an operator: ``made_up`` tells such rows from real ids of that size."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(1 << 61)))


def made_up() -> Column:
    """Whether a row's number is made up."""
    return F.col("doc_id").cast("long").isNull()


def free_names(docs: DataFrame, n: int) -> list[str]:
    """Column names that the table does not have."""
    taken = {c.lower() for c in docs.columns}
    return [c for c in (f"attestra_{i}" for i in range(n + len(taken))) if c not in taken][:n]


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Partitioned by keys for a grouping: in at least ``parts`` parts, where the session's own number is smaller."""
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(parts, *keys)
    return df
