"""Near-duplicates among embeddings by tiles of int8 products with rigorous error bounds.

A vector u of length 1 is s * q + e, with whole numbers q from -127 to 127 and a scale s of its own. The product of two
vectors differs from s * s' * (q . q') by |s q| |e'| + |e| |s' q'| + |e| |e'| at most, and these lengths are known. So
a pair whose approximate product plus bound lies below the threshold is no link, and only the other pairs are computed
in double precision. q . q' is a whole number that float32 holds exactly for up to 1024 components at a time, which lets
a matrix product give a tile of them.

Vectors of a label are dealt to blocks by a hash, and each pair of blocks is one tile, whatever the size of the label.
Equal vectors are one class that is compared once; it links its own members. A tile hands out, for each vector, how many
others it links, and links that span its groups: in proportion to its side, not to its area.

Defined results: a vector that is null, zero, empty or has null or non-finite components, or whose label is null, links
with nothing and is a component of its own; so do vectors of different lengths. A null id never is the least of a
component. Rows that repeat an id are vectors of their own. An empty table gives an empty result. Only the id, the
vector and the label are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

THRESHOLD = 0.98
#: Components of all vectors of a block together, and its least and greatest expected number of vectors.
BLOCK_VALUES, LEAST_BLOCK, MOST_BLOCK = 1 << 17, 64, 2048
#: Rows of a file of vectors.
SIDE_ROWS = 1 << 14
#: Rows of a tile that are multiplied at once.
STRIP = 512
#: Share of a strip from which its candidates are computed by one product of all rows and columns that have any.
DENSE = 0.02
#: Rounding of sums in double precision and of the bound itself.
SLACK = 1e-9


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """q, scale, |s q| and |e| of unit vectors."""
    s = np.abs(u).max(1) / 127
    q = np.rint(u / s[:, None])
    back = q * s[:, None]
    return q.astype(np.int8), s, np.linalg.norm(back, axis=1), np.linalg.norm(u - back, axis=1)


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of all rows of two int8 matrices."""
    out = None
    for at in range(0, a.shape[1], 1024):  # 127 * 127 * 1024 is below 2 ** 24
        part = a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
        out = part.astype(np.float64) if out is None else out + part
    return out


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """Which rows of x and y (double) have a cosine of the threshold or more, and how many pairs were computed in full."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    ux, uy = x / nx[:, None], y / ny[:, None]
    qx, sx, lx, ex = quantised(ux)
    qy, sy, ly, ey = quantised(uy)
    linked, full = np.zeros((len(x), len(y)), bool), 0
    for at in range(0, len(x), STRIP):
        r = slice(at, at + STRIP)
        most = int8_product(qx[r], qy) * np.outer(sx[r], sy) + np.outer(lx[r] + ex[r], ey) + np.outer(ex[r], ly)
        maybe = most >= threshold - SLACK
        i, j = np.nonzero(maybe)
        full += len(i)
        if not len(i):
            continue
        if len(i) > DENSE * maybe.size:
            ri, cj = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
            cos = (x[r][ri] @ y[cj].T) / np.outer(nx[r][ri], ny[cj])
            linked[np.ix_(ri + at, cj)] = (cos >= threshold) & maybe[np.ix_(ri, cj)]
        else:
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)] + at, j[k : k + (1 << 16)]
                linked[a, b] = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
    return linked, full


def spanning(linked: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links (row, column) that span the groups of a tile; of a block with itself, rows and columns are the same."""
    if same:
        fresh = np.ones(len(linked), bool)
        out = []
        for first in np.flatnonzero(linked.any(1)).tolist():
            if not fresh[first]:
                continue
            fresh[first] = False
            stack = [first]
            while stack:
                i = stack.pop()
                new = np.flatnonzero(linked[i] & fresh).tolist()
                fresh[new] = False
                out += [(i, j) for j in new]
                stack += new
        return out
    rows, cols = np.ones(linked.shape[0], bool), np.ones(linked.shape[1], bool)
    turned = np.ascontiguousarray(linked.T)
    out = []
    for first in np.flatnonzero(linked.any(1)).tolist():
        if not rows[first]:
            continue
        rows[first] = False
        stack = [(first, True)]
        while stack:
            i, is_row = stack.pop()
            new = np.flatnonzero(linked[i] & cols if is_row else turned[i] & rows).tolist()
            (cols if is_row else rows)[new] = False
            out += [(i, j) if is_row else (j, i) for j in new]
            stack += [(j, not is_row) for j in new]
    return out


def _usable(batches):
    """Vectors that can link, as bytes in double precision."""
    import pyarrow as pa

    C.worker_for("embedding_dedup", lambda: None)
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            rows, raws, dims = [], [], []
            for k, v in enumerate(batch["embedding"].to_pylist()):
                if not v or None in v:
                    continue
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    rows.append(k)
                    raws.append((x / 2.0 ** np.floor(np.log2(top))).tobytes() if not 1e-100 < top < 1e100 else x.tobytes())  # lengths neither overflow nor vanish
                    dims.append(len(v))
            keep = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch["_row"].take(keep), batch["vec_id"].take(keep), batch["label"].take(keep), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=["_row", "vec_id", "label", "dim", "vec"])


def _tile(threshold: float):
    import pyarrow as pa

    def block(table, k):
        rows = table["rows"].chunk(0)[k].as_py() if table["rows"].num_chunks == 1 else table["rows"][k].as_py()
        ids = np.array([r["cid"] for r in rows], np.int64)
        counts = np.array([r["n"] for r in rows], np.int64)
        return ids, counts, np.frombuffer(b"".join(r["vec"] for r in rows), np.float64).reshape(len(rows), -1)

    def run(table):
        ids, counts, x = block(table, 0)
        same = table.num_rows == 1
        ids2, counts2, y = (ids, counts, x) if same else block(table, 1)
        linked, _ = tile_links(x, y, threshold)
        if same:
            np.fill_diagonal(linked, False)
            linked |= linked.T
        out = [(int(i), None, int(n)) for i, n in zip(ids, linked @ counts2, strict=True) if n]
        if not same:
            out += [(int(i), None, int(n)) for i, n in zip(ids2, counts @ linked, strict=True) if n]
        out += [(int(ids[i]), int(ids2[j]), None) for i, j in spanning(linked, same)]
        return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, scratch: C.Scratch, threshold: float = THRESHOLD, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id long, embedding array, label int)."""
    if not 0 < threshold <= 1 - SLACK:
        raise ValueError("the threshold must lie between 0 and 1")
    rows = C.with_row_id(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label")), scratch)
    made = rows.filter(F.col("label").isNotNull()).mapInArrow(_usable, f"_row {C.ROW}, vec_id long, label long, dim int, vec binary")
    usable = scratch.keep(C.salted(made, "_row").withColumn("_vec", F.sha2("vec", 256)), "usable")
    key = ["label", "_vec"]  # the digest stands for a vector where no product is taken
    n = usable.count()
    parts = scratch.keep(usable.groupBy(*key, "_salt").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"), F.first("vec").alias("vec")), "parts", n, SIDE_ROWS)
    whole = parts.groupBy(*key).agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    classes = scratch.keep(whole.withColumn("cid", F.monotonically_increasing_id()), "classes", n, SIDE_ROWS)
    per_block = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.lit(block_values) / F.col("dim")))
    blocks = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size")).select("label", "dim", F.ceil(F.col("size") / per_block).cast("int").alias("blocks"))
    dealt = classes.join(blocks, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    held = dealt.groupBy("label", "dim", "blocks", "block").agg(F.collect_list(F.struct("cid", "n", "vec")).alias("rows"))  # about MOST_BLOCK rows
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sides = held.select("label", "dim", "block", "rows", other).select("label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rows")
    found = scratch.keep(sides.groupBy("label", "dim", "i", "j").applyInArrow(_tile(threshold), "a long, b long, n long"), "found")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b"), scratch, found.count())
    rooted = classes.select("cid", *key, "n", "least").join(roots, classes.cid == roots.node, "left").withColumn("root", F.coalesce("root", "cid"))
    done = C.with_least(rooted, "root", "least", "component_id", "cid").join(counts, "cid", "left")
    done = scratch.keep(done.select(*key, (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "done", n)
    of_part = parts.select(*key, "_salt").join(done, key)  # a vector with many copies is joined part by part
    linked = usable.select("_row", *key, "_salt").join(of_part, [*key, "_salt"]).select("_row", "n_links", "component_id")
    out = rows.select("_row", "vec_id").join(linked, "_row", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return near_duplicates(vectors, C.Scratch(spark, "op4"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
       WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
 r AS (SELECT a AS x, a AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
 c AS (SELECT x, min(y) AS least FROM r GROUP BY x),
 n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.least, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.least, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.x = e.vec_id
"""
