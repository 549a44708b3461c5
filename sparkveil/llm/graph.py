"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Links that one task may hold: some 100 MB with what it needs to number them.
SMALL = 1 << 20


def components(edges: DataFrame, scratch: C.Scratch, rows: int | None = None, small: int = SMALL) -> DataFrame:
    """(node, root) for each node of edges (a, b, both long) that has a link to another one; root is the least node that
    can be reached. rows: a bound on the links, if the caller knows one.

    Up to `small` links are joined in one task, whose memory this bounds. Beyond it, alternating stars: each node hangs
    its larger neighbours on the least of its neighbourhood, then its smaller ones, until every component is a star around
    its least node. Each round is written to the shared folder, and takes space in proportion to the links; rounds grow
    with the logarithm of a component's diameter."""
    cur = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", rows)
    n = cur.count()
    if n <= small:
        return scratch.keep(cur.coalesce(1).mapInArrow(_joined, "node long, root long"), "roots", n)
    was = _sign(cur)
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # (v, m) for each neighbour v above u; links point from the larger to the smaller end
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        nxt = scratch.keep(hung, "links", 2 * n)
        now = _sign(nxt)
        scratch.free(cur)
        cur = nxt
        if now == was:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        was = now


def _sign(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and the least node that each can reach: trees are hung on the least root that they are linked
    to and flattened, until no link joins two trees."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(node))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return node, node[parent]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not (flat := parent[parent] == parent).all():
            parent[~flat] = parent[parent[~flat]]


def _joined(batches):
    import pyarrow as pa

    held = [(np.asarray(b["u"]), np.asarray(b["v"])) for b in batches]
    if held:
        node, root = roots_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for at in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(node[at : at + (1 << 16)]), pa.array(root[at : at + (1 << 16)])], names=["node", "root"])
