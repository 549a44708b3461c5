"""Exact deduplication by composable polynomial fingerprints.

The bytes b of a normalised text give the polynomial sum(b[i] * r**i) modulo a prime, for two bases r. A chunk that
begins at offset o is hashed alone and shifted by r**o; the sum of its shifted chunks is the fingerprint of a text. So
chunks of a huge document can be hashed anywhere and combined in any order. Texts of equal length and fingerprint are
then compared chunk by chunk, place by place; no text is ever held with another whole one.

Defined results: a null text counts as empty; texts are equal when identical after lower-casing A-Z only; of equal texts
the row with the largest doc_id stays, of rows that repeat this id one row; a null doc_id is smaller than any other.
An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of a chunk. 255 * PRIME * CHUNK is below 2**63, so a chunk's sum needs no reduction before its end.
CHUNK = 1 << 16
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_566_083_941)
#: Rows of one class that share a task while they are counted or compared.
SALTS = 64


@cache
def _powers(base: int, prime: int) -> np.ndarray:
    out = np.ones(CHUNK, np.int64)
    done = 1
    while done < CHUNK:
        out[done : 2 * done] = out[:done] * pow(base, done, prime) % prime
        done *= 2
    return out


def chunk_term(chunk: bytes, offset: int, base: int, prime: int = PRIME) -> int:
    """The share of a chunk at this offset in its text's fingerprint."""
    h = int(np.dot(np.frombuffer(chunk, np.uint8).astype(np.int64), _powers(base, prime)[: len(chunk)])) % prime
    return h * pow(base, offset, prime) % prime


def _chunk_rows(prime: int):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.worker_for("exact_dedup", lambda: None)
        for whole in batches:
            for batch in C.slices(whole):
                out = {k: [] for k in ("place", "n_bytes", "t1", "t2", "text_sha256")}
                for place, raw in enumerate(C.text_bytes(batch["text"])):
                    raw = raw.lower()  # of bytes: A-Z only
                    digest = hashlib.sha256(raw).hexdigest()
                    for at in range(0, max(1, len(raw)), CHUNK):
                        chunk = raw[at : at + CHUNK]
                        for k, v in zip(out, (place, len(raw), *(chunk_term(chunk, at, b, prime) for b in BASES), None if at else digest), strict=True):
                            out[k].append(v)
                place = pa.array(out.pop("place"), pa.int32())
                yield pa.RecordBatch.from_arrays([batch["_row"].take(place), batch["doc_id"].take(place), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "t1", "t2")), pa.array(out["text_sha256"], pa.string())], names=["_row", "doc_id", *out])

    return run


def fingerprints(docs: DataFrame, prime: int = PRIME) -> DataFrame:
    """(_row, doc_id, n_bytes, f1, f2, text_sha256): one row per row of docs (_row, doc_id, text)."""
    chunks = docs.select("_row", F.col("doc_id").cast("long"), "text").mapInArrow(_chunk_rows(prime), f"_row {C.ROW}, doc_id long, n_bytes long, t1 long, t2 long, text_sha256 string")
    return chunks.groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_bytes").alias("n_bytes"),
        (F.sum("t1") % prime).alias("f1"),
        (F.sum("t2") % prime).alias("f2"),
        F.max("text_sha256").alias("text_sha256"),
    )


def _class_chunks(prime: int):
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            for batch in C.slices(whole):
                out = {k: [] for k in ("n_bytes", "f1", "f2", "_chunk", "_bytes")}
                for raw in C.text_bytes(batch["text"]):
                    raw = raw.lower()
                    starts = range(0, max(1, len(raw)), CHUNK)
                    f1, f2 = (sum(chunk_term(raw[at : at + CHUNK], at, b, prime) for at in starts) % prime for b in BASES)
                    for at in starts:
                        for k, v in zip(out, (len(raw), f1, f2, at // CHUNK, raw[at : at + CHUNK]), strict=True):
                            out[k].append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(out[k], pa.int64()) for k in list(out)[:4]), pa.array(out["_bytes"], pa.binary())], names=list(out))

    return run


def _best(keys: list[str], prints: DataFrame) -> DataFrame:
    """(keys, _salt, keep, group_size): for each class the row that stays; counted by salt first, so that a class of any
    size is read by SALTS tasks at least and joined back by as many."""
    part = prints.groupBy(*keys, "_salt").agg(F.max(F.struct("doc_id", "_row")).alias("keep"), F.count(F.lit(1)).alias("n"))
    whole = part.groupBy(*keys).agg(F.max("keep").alias("keep"), F.sum("n").alias("group_size"))
    return part.select(*keys, "_salt").join(whole, keys)


def unequal(docs: DataFrame, members: DataFrame, prime: int, scratch: C.Scratch, rows: int) -> DataFrame:
    """Fingerprints (n_bytes, f1, f2) that different texts share: the chunks at one place of all texts of a fingerprint
    are equal if the least is the greatest. These are found as the chunks stream by, in each task and then over tasks,
    so that a task sends one pair of chunks for each place, however many copies it has read."""
    near, _ = C.split_rows(docs.select("_row", "text"), members, scratch, rows=rows)
    chunks = near.select("text").mapInArrow(_class_chunks(prime), "n_bytes long, f1 long, f2 long, _chunk long, _bytes binary")
    ends = chunks.groupBy("n_bytes", "f1", "f2", "_chunk").agg(F.min("_bytes").alias("least"), F.max("_bytes").alias("most"))
    return ends.filter("least <> most").select("n_bytes", "f1", "f2").distinct()


def exact_duplicates(docs: DataFrame, scratch: C.Scratch, prime: int = PRIME) -> DataFrame:
    """(_row, doc_id, keep_id, keep_row, group_size, kept, text_sha256) for each row of docs (doc_id, text and _row, see
    common.with_row_id). `prime` may be lowered in tests to make different texts collide."""
    n = docs.count()
    prints = scratch.keep(fingerprints(docs, prime).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS))), "prints", n)
    keys = ["n_bytes", "f1", "f2"]
    classes = scratch.keep(_best(keys, prints).filter("group_size > 1"), "classes", n)
    members = prints.select("_row", *keys, "_salt").join(classes.select(*keys, "_salt"), [*keys, "_salt"]).select("_row")
    wrong = scratch.keep(unequal(docs, members, prime, scratch, n), "wrong", n)
    if not wrong.isEmpty():  # equal fingerprints of different texts: these classes are told apart by their digests too
        keys = [*keys, "_split"]
        prints = prints.join(wrong.withColumn("_bad", F.lit(True)), keys[:3], "left").withColumn("_split", F.when(F.col("_bad"), F.col("text_sha256")).otherwise(F.lit("")))
        classes = _best(keys, prints).filter("group_size > 1")
    out = prints.join(classes, [*keys, "_salt"], "left")
    return out.select(
        "_row",
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("keep._row", "_row").alias("keep_row"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep._row", "_row") == F.col("_row")).alias("kept"),
        "text_sha256",
    )


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    scratch = C.Scratch(spark, "op7")
    docs = C.with_row_id(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), scratch)
    return exact_duplicates(docs, scratch).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
     g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
FROM t JOIN g ON t.x = g.x
"""


def stage_exact_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts one document stays."""
    scratch = C.Scratch(spark, "stage-exact", C.STAGE_BYTES)
    rows = C.with_row_id(C.boxed(docs), scratch)
    found = exact_duplicates(rows, scratch)
    n = rows.count()
    dropped = scratch.keep(found.filter(~F.col("kept")).select("_row"), "dropped", n)
    return C.packed(C.split_rows(rows.select("_doc", "_row"), dropped, scratch, rows=n)[1].select("_doc.*"), n)
