"""Shuffled sharding by a Feistel permutation of global row numbers; DataFrame operations only.

Rows are numbered 0 to n-1 in the order of their key. A permutation of 0..n-1 takes a row's number to its position;
shard and slot are position mod and div the number of shards. So shards differ by one row at most, a rerun gives the same
places, and the place of any row number can be computed without touching another row.

The permutation: numbers are split into two digits of base s, the least with s * s >= n, and go through ROUNDS rounds
(left, right) -> (right, (left + h(right, key)) mod s), where h is the first HASH_DIGITS hexadecimal digits of the MD5 of
"right:key". A result of n or more goes through again until it is below n
(cycle walking). At most s * s - n numbers lie above, so that the walk ends.

Defined results: a null text has size 1 and the checksum of an empty text; null and repeated ids are numbered like any
others; rows that agree in id, checksum and size may swap places. An empty table gives an empty result. The law is
`rows`; equal texts aren't kept together, for a group may hold a third of all rows, more than a shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

ROUNDS, HASH_DIGITS = 6, 13
SEED = 20_240_229
#: Walks within one expression; further ones, for the few rows that need them, are steps of the plan.
WALKS = 8


def whole(x: Column, by: int) -> Column:
    """x div by for non-negative x, exact for any long."""
    return F.try_divide((x - x % by).cast("decimal(20,0)"), F.lit(by).cast("decimal(20,0)")).cast("long")


def numbered(rows: DataFrame, order: list[str], scratch: C.Scratch) -> DataFrame:
    """Adds _n, the rank of each row by `order`, from 0. Rows are dealt by ranges of the order and sorted there; a
    partition's first number is the count of rows before it. No task reads more than its range."""
    tie = F.monotonically_increasing_id()  # splits ranges of equal rows; doesn't change which rank equal rows get as a set
    dealt = rows.withColumn("_tie", tie).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    kept = scratch.keep(dealt.withColumn("_at", F.monotonically_increasing_id()), "dealt")
    kept = kept.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.withColumn("_before", F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).drop("_rows")
    # one row for each partition of the table: its size doesn't follow the rows
    return kept.join(F.broadcast(before), "_part").withColumn("_n", F.col("_before") + F.col("_in")).drop("_part", "_in", "_at", "_before")


def _round(right: Column, key: Column) -> Column:
    digest = F.md5(F.concat(right.cast("string"), F.lit(":"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long")


def feistel(x: Column, side: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """One pass of the permutation of 0 .. side * side - 1."""
    s = F.lit(side).cast("long")
    keys = F.array(*[F.lit(seed + i).cast("long") for i in range(rounds)])
    start = F.struct(whole(x, side).alias("l"), (x % s).alias("r"))
    return F.aggregate(
        keys,
        start,
        lambda a, k: F.struct(a["r"].alias("l"), ((a["l"] + _round(a["r"], k) % s) % s).alias("r")),
        lambda a: a["l"] * s + a["r"],
    )


def permuted(rows: DataFrame, n: int, number: str = "_n", seed: int = SEED) -> DataFrame:
    """Adds _p, the position of each row number below n."""
    side = max(1, math.isqrt(max(0, n - 1)) + 1)
    walk = lambda x: F.when(x < n, x).otherwise(feistel(x, side, seed))
    steps = F.sequence(F.lit(1), F.lit(WALKS))
    out = rows.withColumn("_p", F.aggregate(steps, feistel(F.col(number), side, seed), lambda x, _: walk(x)))
    while not out.filter(F.col("_p") >= n).isEmpty():
        out = out.withColumn("_p", F.aggregate(steps, F.col("_p"), lambda x, _: walk(x)))
    return out


def shard_rows(docs: DataFrame, shards: int, scratch: C.Scratch, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row of docs (doc_id, text)."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    kept = numbered(scratch.keep(rows, "rows"), ["doc_id", "text_crc32", "size"], scratch)
    placed = permuted(kept, kept.count(), seed=seed)
    return placed.select("doc_id", "size", "text_crc32", (F.col("_p") % shards).cast("int").alias("shard"), whole(F.col("_p"), shards).alias("slot"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shard_rows(docs, 16, C.Scratch(spark, "op5"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP5_SQL = f"""
WITH RECURSIVE
 t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc_of),
 d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) + 1 AS size,
              list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
 c AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crc_of[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM d, t),
 m AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS x, count(*) OVER () AS n FROM c),
 s AS (SELECT *, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS side FROM m),
 w AS (SELECT x, n, side, x // side AS l, x % side AS r, 0 AS k FROM s
       UNION ALL
       SELECT x, n, side, r, (l + CAST('0x' || substr(md5(CAST(r AS VARCHAR) || ':' || CAST({SEED} + k % {ROUNDS} AS VARCHAR)), 1, {HASH_DIGITS}) AS BIGINT) % side) % side, k + 1
       FROM w WHERE k = 0 OR k % {ROUNDS} <> 0 OR l * side + r >= n)
SELECT s.doc_id, s.size, s.crc AS text_crc32, 'rows' AS law, CAST((w.l * w.side + w.r) % 16 AS INT) AS shard, (w.l * w.side + w.r) // 16 AS slot, CAST(NULL AS INT) AS grown_shard
FROM s JOIN w ON s.x = w.x WHERE w.k > 0 AND w.k % {ROUNDS} = 0 AND w.l * w.side + w.r < w.n
"""
