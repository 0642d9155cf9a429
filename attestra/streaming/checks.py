"""Field checks of arriving documents: each micro-batch runs the batch matcher.

A document's lines and expected fields arrive together in one row, so no state
spans batches and there is nothing to window or to wait for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestra.operators import matcher

REQUEST = "doc_id string, document_type string, lines array<struct<text:string,confidence:double,side:string,bbox:struct<x1:double,y1:double,x2:double,y2:double>>>, fields array<struct<field:string,expected:string>>"


def check_batch(requests: DataFrame) -> DataFrame:
    lines = requests.select("doc_id", F.posexplode("lines").alias("line_pos", "l")).select("doc_id", "line_pos", "l.*")
    fields = requests.select("doc_id", F.posexplode("fields").alias("field_pos", "f")).select("doc_id", "field_pos", "f.*")
    return matcher.verify(lines, fields, requests.select("doc_id", "document_type"))


def checks(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the results of a stream of REQUEST rows; a batch that is replayed overwrites its own folder."""

    def write(batch: DataFrame, n: int) -> None:
        check_batch(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
