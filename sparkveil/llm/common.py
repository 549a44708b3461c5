"""Shared parts of the corpus operators: scratch tables, row identity, verdicts on rows, words."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: A word is a run of bytes other than these.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

#: Bits of a membership bitmap of ids: its table has BITMAP_BITS / 64 rows at most, whatever the input.
BITMAP_BITS = 1 << 22
#: Words of 64 rows whose verdicts are broadcast at once: some 50 MB.
WORDS = 1 << 20
#: Bytes of rows that go to a Python worker at once, unless a single row has more.
BATCH_BYTES = 4 << 20
#: The same in a stage of the pipeline, where a process that served earlier stages has grown already.
STAGE_BYTES = 1 << 20
#: Rows of a file of a kept table whose size is known beforehand: short ones, and such as are made from whole texts.
FILE_ROWS, DOC_ROWS = 1 << 18, 1 << 13
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
ROW = "struct<f:long,i:long>"


def bounded(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds the batches that this session hands to Python workers by bytes too: texts may be long, and by rows alone a
    batch would be as large as ten thousand of them."""
    own = spark.conf.get("spark.sparkveil.batches", None)
    if own is None or spark.conf.get(_BATCH) == own:  # a bound that a caller sets later stays
        spark.conf.set("spark.sparkveil.batches", str(most))
        spark.conf.set(_BATCH, str(most))


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a
    temporary folder, which goes when the process ends; on a cluster that is an error, as executors wouldn't see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = "file://" + own
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/(?!/)", "file:///", full).rstrip("/")


def store(uri: str):
    """(file system, path) of a URI, for Python on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs whose results are written, which it does when their plans are
    collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def packed(df: DataFrame, rows: int, per_file: int | None = None) -> DataFrame:
    """df in a partition for each per_file (DOC_ROWS) of its rows, or for each core, where it has more: so that a table has
    no file for each partition of a shuffle, however empty. Nothing is shuffled for it."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // (per_file or DOC_ROWS))))


#: On a local disk a scratch table has no checksum files: without native code Hadoop starts a process (chmod) for each file
#: it makes, for whose first moment the executor's memory counts twice.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


class Scratch:
    """Tables written once to the shared folder, so that a lost executor costs a re-read and not a recomputation."""

    def __init__(self, spark: SparkSession, what: str, batch: int = BATCH_BYTES):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.n = 0
        bounded(spark, batch)
        if not _MADE:
            atexit.register(release)
        _MADE.append(self)

    def keep(self, df: DataFrame, name: str = "t", rows: int | None = None, per_file: int = FILE_ROWS) -> DataFrame:
        """Writes a table and reads it again. rows: about how many rows it has, if that is known; see packed()."""
        if rows is not None:
            df = packed(df, rows, per_file)
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        df.write.options(**PLAIN).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def free(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            delete(self.spark, t._scratch_path)


#: Scratch folders of this process that are still there.
_MADE: list[Scratch] = []


def made() -> int:
    return len(_MADE)


def release(since: int = 0) -> None:
    """Deletes the scratch folders that were made after the first `since`: what was read from them is written, or isn't
    wanted any more. What is left when the process ends goes then, if the session can still be reached."""
    for made in _MADE[since:]:
        try:
            delete(made.spark, made.path)
        except Exception:  # noqa: BLE001  # nobody is there any more to delete for
            if since:
                raise
    del _MADE[since:]


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def with_row_id(df: DataFrame, scratch: Scratch, name: str = "_row") -> DataFrame:
    """Adds a struct of two numbers (ROW) that names each row of a file table: a hash of its file and the position there.
    It is the same in every scan; doc ids may be null or repeat. Files whose hashes agree get another seed. A frame that
    isn't a plain file scan is written first."""
    path = F.col("_metadata.file_path")
    try:
        files = df.select(path.alias("p")).distinct()
    except AnalysisException:
        return with_row_id(scratch.keep(df, "rows"), scratch, name)
    for seed in count():
        f = F.xxhash64(F.lit(seed), path)
        there = files.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.xxhash64(F.lit(seed), "p")).alias("d")).collect()[0]
        if there.n == there.d:
            return df.select("*", F.struct(f.alias("f"), F.col("_metadata.row_index").alias("i")).alias(name))


def boxed(docs: DataFrame, *more: str) -> DataFrame:
    """(_doc, doc_id, text, more): each row whole in a struct, so that its other columns may have any names."""
    return docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text", *more)


def _bit(col: Column) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(col), F.lit(BITMAP_BITS))
    return F.call_function("shiftright", at, F.lit(6)), (at % 64).cast("int")


def bitmap(keys: DataFrame, col: str) -> DataFrame:
    """Membership bitmap of a column as a table (_word, _bits) of BITMAP_BITS / 64 rows at most: safe to broadcast at
    any size of the input. When full it lets everything pass; it never rejects a member."""
    word, bit = _bit(F.col(col))
    return keys.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_b")).groupBy("_word").agg(F.bit_or("_b").alias("_bits"))


def maybe_in(df: DataFrame, bits: DataFrame, col: str, name: str = "_maybe") -> DataFrame:
    """Adds a boolean: false only where the value of `col` is surely not among the bitmap's keys."""
    word, bit = _bit(F.col(col))
    d = df.withColumn("_word", word).join(F.broadcast(bits), "_word", "left").drop("_word")
    hit = F.call_function("getbit", F.coalesce("_bits", F.lit(0).cast("long")), bit) == 1
    return d.withColumn(name, hit).drop("_bits")


def split_rows(df: DataFrame, named: DataFrame, scratch: Scratch, most: int = WORDS, row: str = "_row", rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of df that the table `named` names, and the others. No row leaves the task that scans it: 64 neighbours of a
    file share a word of bits, and words are broadcast, `most` of them at a time at about, each part with the files that
    it speaks of. A part reads its own files only, as its filter is on the file. rows: a bound on those of `named`."""
    at = F.col(f"{row}.i")
    bits = named.select(F.col(f"{row}.f").alias("_f"), F.shiftright(at, 6).alias("_w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("_b"))
    words = scratch.keep(bits.groupBy("_f", "_w").agg(F.bit_or("_b").alias("_bits")), "verdicts", rows)
    parts = max(1, -(-words.count() // most))
    inside, outside = [], []
    for k in range(parts):
        some, those = df, words
        if parts > 1:
            some, those = (d.filter(F.pmod(F.col(c), F.lit(parts)) == k) for d, c in ((df, f"{row}.f"), (words, "_f")))
        d = some.withColumn("_f", F.col(f"{row}.f")).withColumn("_w", F.shiftright(at, 6)).join(F.broadcast(those), ["_f", "_w"], "left")
        hit = F.call_function("getbit", F.coalesce("_bits", F.lit(0).cast("long")), (at % 64).cast("int")) == 1
        inside.append(d.filter(hit).select(*df.columns))
        outside.append(d.filter(~hit).select(*df.columns))
    return reduce(DataFrame.unionByName, inside), reduce(DataFrame.unionByName, outside)


#: Parts of a group of equal keys that are read by tasks of their own.
SALTS = 64


def salted(df: DataFrame, by: str) -> DataFrame:
    """df with _salt, by which a group of any size is dealt to SALTS tasks."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def with_least(df: DataFrame, key: str, col: str, name: str, by: str) -> DataFrame:
    """df with the least `col` of all rows of the same key: by salt first, and joined back by salt, so that a key that
    holds a third of all rows is no task's alone. by: a column that tells rows of a key apart."""
    d = salted(df, by)
    part = d.groupBy(key, "_salt").agg(F.min(col).alias("_least"))
    whole = part.groupBy(key).agg(F.min("_least").alias(name))
    return d.join(part.select(key, "_salt").join(whole, key), [key, "_salt"]).drop("_salt")


# ---- what a Python worker remembers ----------------------------------------------------------------------------


_REMEMBERED: dict[str, Callable[[], None]] = {}


def worker_for(what: str, forget: Callable[[], None]) -> None:
    """Called as an operator begins in a worker, which serves one after another: what others remember there goes."""
    for other in [k for k in _REMEMBERED if k != what]:
        _REMEMBERED.pop(other)()
    _REMEMBERED[what] = forget


# ---- words of Arrow text columns -------------------------------------------------------------------------------


def text_bytes(column) -> list[bytes]:
    """UTF-8 of a string column of a record batch; null gives empty."""
    import pyarrow as pa

    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def slices(batch, most: int = 4 << 20):
    """Cuts a record batch so that each piece holds about `most` bytes: texts may be very long."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if str(c.type) in ("string", "large_string", "binary", "large_binary"):
            size += np.asarray(pc.fill_null(pc.binary_length(c), 0), dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def word_bounds(buf: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte buffer; between: which bytes belong to none."""
    word = np.empty(len(buf) + 2, np.int8)
    word[0] = word[-1] = 0
    np.logical_not(between[buf], out=word[1:-1].view(bool))
    edge = np.flatnonzero(np.diff(word))
    return edge[0::2], edge[1::2]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place."""
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each word, by sums of the buffer weighed with powers of an odd base."""
    with np.errstate(over="ignore"):
        n = len(buf)
        power = _powers(base, n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        h = (total[ends] - total[starts]) * _powers(pow(base, -1, 1 << 64), n)[starts] if n else total[:0]
        h ^= (ends - starts).astype(np.uint64) << np.uint64(48)
    return mix64(h)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << max(0, n - 1).bit_length())
        have = np.ones(size, np.uint64)
        with np.errstate(over="ignore"):
            done = 1
            while done < size:
                have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
        _POWERS[base] = have
    return have
