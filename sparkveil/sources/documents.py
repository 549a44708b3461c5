"""Documents and masked texts: sources and sinks."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row for each file, bytes as they are, line ends too."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.decode("content", "UTF-8").alias("text"))


def read_input(spark: SparkSession, path: str | None) -> DataFrame:
    """(text): a file, or standard input for None or -."""
    if path in (None, "-"):
        return spark.createDataFrame([(sys.stdin.buffer.read().decode("utf-8"),)], "text string")
    return read_texts(spark, path if ":" in path else "file://" + os.path.abspath(path)).select("text")


def write_output(text: str, path: str | None) -> None:
    """A result of the driver: a file holds it as it is, standard output ends it with a line end."""
    if path in (None, "-"):
        sys.stdout.write(text if not text or text.endswith("\n") else text + "\n")
        return
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def write_masked(masked: DataFrame, path: str, *keys: str) -> None:
    """Masked texts as Parquet, without anything that holds originals."""
    masked.select(*(keys or ("doc_id",)), "masked_text").write.mode("overwrite").parquet(path)
