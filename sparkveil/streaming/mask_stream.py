"""Masking streams. A plan works row by row, so that a stream of documents runs the very projections that a batch runs:
no state, no watermark, nothing shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.mask import mapping_rows
from ..plans.pipeline import Plan, mask


def read(spark: SparkSession, path: str, schema: str = "doc_id long, text string", kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(path)


def mask_stream(docs: DataFrame, plan: Plan, text: str = "text") -> DataFrame:
    """A stream of documents with spans, masked_text, mapping and report."""
    return mask(docs, plan, text)


def write(masked: DataFrame, texts: str, mappings: str, checkpoint: str, *keys: str, available_now: bool = True) -> StreamingQuery:
    """Masked texts to one folder, mappings to another one. A batch that runs again after a failure replaces its own
    folder, so that each document comes out once."""
    keys = keys or ("doc_id",)

    def both(batch: DataFrame, n: int) -> None:
        held = batch.persist()
        try:
            held.select(*keys, "masked_text").write.mode("overwrite").parquet(f"{texts}/batch={n}")
            mapping_rows(held, *keys).write.mode("overwrite").parquet(f"{mappings}/batch={n}")
        finally:
            held.unpersist()

    w = masked.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
