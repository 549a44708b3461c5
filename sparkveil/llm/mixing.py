"""Mixing sources to target weights by hash-threshold histograms; DataFrame operations only.

Each source gets a target number of words. A source is repeated whole as often as it fits into its target; of the rest,
a document is taken once more if its hash lies below its source's threshold. The threshold is found without sorting:
words are summed by source and leading digits of the hash, the bucket in which the running sum passes the budget is cut
by further digits, and only its rows are read again, until one hash is left. A larger budget gives a larger threshold,
so that mixes are nested.

Defined results: null sources form one source, the last; a null text has size 0; an empty table gives an empty result;
rows that agree in id and text have the same hash and are taken alike. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Hexadecimal digits of the hash by which one histogram refines the one before; 4096 buckets.
DIGITS = 3
HASH_DIGITS = 32


def hashed(docs: DataFrame) -> DataFrame:
    """Adds _hash, which depends on the id and the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.concat_ws(":", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary")))
    return docs.withColumn("_hash", F.md5(key.cast("binary")))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, _hash) of each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return hashed(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.regexp_count(text, F.lit(C.WORD)).cast("long").alias("size"), "_hash")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the total is shared by weight; what exceeds `most` times
    a source's size is shared anew among the others. One row for each source, so that one task may number them.

    Sources that stop at their limit are those of the least limit for their weight. With sources in that order, the share
    of a unit of weight after all earlier ones have stopped is greatest at the first that doesn't stop."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("_w", weight).withColumn("_limit", F.col("source_size") * most).withColumn("_rank", F.row_number().over(by_name))
    every = Window.partitionBy(F.lit(0))
    filled = every.orderBy(F.col("_limit") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.sum("source_size").over(every) - (F.sum("_limit").over(filled) - F.col("_limit"))
    weights_left = F.sum("_w").over(every) - (F.sum("_w").over(filled) - F.col("_w"))
    s = s.withColumn("_share", left.cast("double") / weights_left.cast("double")).withColumn("_level", F.max("_share").over(every))
    return s.select("source", "source_size", F.least(F.col("_limit").cast("double"), F.col("_w") * F.col("_level")).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(source, _cut, _with): take hashes below _cut, and _cut itself if _with. rows: (source, size, _hash); budgets:
    (source, _budget), each below its source's size unless that is 0."""
    state = scratch.keep(budgets.filter("_budget > 0").select("source", "_budget", F.lit("").alias("_prefix"), F.lit(0).cast("long").alias("_before")), "budgets")
    done = None
    for digits in range(DIGITS, HASH_DIGITS + DIGITS, DIGITS):
        inside = rows.alias("r").join(state.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & F.col("r._hash").startswith(F.col("s._prefix")))
        sums = inside.groupBy(F.col("r.source").alias("source"), F.substring("_hash", 1, digits).alias("_prefix")).agg(
            F.sum("size").alias("_sum"), F.min("_hash").alias("_least"), F.max("_hash").alias("_most"), F.first("_budget").alias("_budget"), F.first("_before").alias("_base")
        )
        running = Window.partitionBy("source").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("_after", F.col("_base") + F.sum("_sum").over(running)).withColumn("_before", F.col("_after") - F.col("_sum"))
        at = scratch.keep(sums.filter((F.col("_before") <= F.col("_budget")) & (F.col("_after") > F.col("_budget"))), "boundary")
        found = at.filter("_least = _most").select("source", F.col("_least").alias("_cut"), (F.col("_before") + F.col("_sum") / 2 <= F.col("_budget")).alias("_with"))
        done = found if done is None else done.unionByName(found)
        state = at.filter("_least < _most").select("source", "_budget", "_prefix", "_before")
        if state.isEmpty():
            break
    return done


def mix_plan(rows: DataFrame, scratch: C.Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target, _whole, _cut, _with): one row per source. rows: see sized()."""
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = scratch.keep(sources.withColumn("_whole", whole).withColumn("_budget", F.col("target") - F.col("_whole") * F.col("source_size")), "plan")
    cuts = thresholds(rows, plan, scratch)
    plan = plan.alias("p").join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select("p.*", "_cut", "_with")
    return scratch.keep(plan, "cuts")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and copies, how often the mix takes each row. rows: source, _hash and any others."""
    once_more = F.coalesce((F.col("_hash") < F.col("_cut")) | ((F.col("_hash") == F.col("_cut")) & F.col("_with")), F.lit(False)).cast("long")
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    return joined.select("r.*", "p.source_size", "p.target", (F.col("_whole") + once_more).alias("copies"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    scratch = C.Scratch(spark, "op3")
    rows = scratch.keep(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sized")
    out = with_copies(rows, mix_plan(rows, scratch))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
     w AS (SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS r,
                  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
     l AS (SELECT *, CAST(sum(source_size) OVER () - (sum(cap) OVER o - cap) AS DOUBLE) / CAST(sum(w) OVER () - (sum(w) OVER o - w) AS DOUBLE) AS share
           FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), r ROWS UNBOUNDED PRECEDING)),
     t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), w * max(share) OVER ()) AS target FROM l),
     b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
     q AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
                  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto,
                  sum(d.size) OVER (PARTITION BY d.source, h) AS here
           FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN upto - here + here / 2.0 <= budget AND upto - here <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM q
"""


def stage_mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: a document comes as often as the mix takes it; one that isn't taken goes. Texts aren't shuffled:
    the plan has one row per source."""
    scratch = C.Scratch(spark, "stage-mix", C.STAGE_BYTES)
    plan = mix_plan(scratch.keep(sized(docs), "sized"), scratch)
    taken = with_copies(hashed(C.boxed(docs, "source")).drop("text"), plan).filter("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")
