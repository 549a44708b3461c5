"""SimHash near-duplicates by pigeonring filtering.

A fingerprint's 64 bits are cut into SEGMENTS segments on a ring. If two fingerprints differ in MOST bits or fewer, then
from some segment on every chain of l consecutive segments differs in l * MOST / SEGMENTS bits at the most (the strong
form of the pigeonhole principle on a ring). With 7 segments and 2 bits such a chain begins with three equal segments,
27 or 28 bits, and has one differing bit at the most among the first six. So fingerprints meet in seven tables, by three
segments each; within a bucket a pair's chain is followed before its full distance is taken. A bucket of more than
SMALL_BUCKET fingerprints is dealt out anew by its first six segments with each single bit left out: these buckets hold
2**11 fingerprints at most, as no more than 11 bits of 64 are open. A bucket hands out links that span its groups, not
all its pairs, so that what it hands out is at most its size.

Only distinct fingerprints are compared; copies are counted once.

Defined results: a null text has no words; a text without words has fingerprint zero, and links like any other; one or
two words are one shingle. Of rows that repeat an id each gets a row. A null id is larger than any other when the least
of a group is taken. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import jaccard
from .graph import components

SEGMENTS = 7
MOST = 2
SHINGLE = 3
SEED = 42
#: Fingerprints of a bucket that are compared at once.
SMALL_BUCKET = 1024
#: Shingles whose bits are summed at once.
BLOCK = 1 << 15

_cuts = [round(i * 64 / SEGMENTS) for i in range(SEGMENTS + 1)]
SEGMENT_MASKS = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(_cuts, _cuts[1:], strict=False)]
#: Segments at the start of a chain that must be equal, and those within which one bit may differ.
EQUAL = -(-SEGMENTS // MOST) - 1
ONE = -(-2 * SEGMENTS // MOST) - 1


def ring(start: int, n: int) -> int:
    """The bits of n consecutive segments."""
    return sum(SEGMENT_MASKS[(start + i) % SEGMENTS] for i in range(n))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text in UTF-8."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and the same white space as common.WORD
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(words) - SHINGLE + 1)
    starts, ends = start[:n].tolist(), (end[SHINGLE - 1 :] if len(words) >= SHINGLE else end[-1:]).tolist()
    return majority((np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], "<u8") for at in range(0, n, BLOCK)), n)


def majority(hashes, n: int) -> int:
    """The fingerprint of n hashes, given in blocks: a bit is 1 if it is set in over half of them."""
    total = np.zeros(64, np.int64)
    for h in hashes:
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def of_set(found: np.ndarray) -> int:
    """The fingerprint of a set of shingles' hashes (jaccard.shingles), each of which counts once."""
    return majority((found[at : at + BLOCK].astype("<u8", copy=False) for at in range(0, len(found), BLOCK)), len(found))


def _fingerprints(batches):
    import pyarrow as pa

    C.worker_for("simhash", lambda: None)
    for whole in batches:
        for batch in C.slices(whole):
            made = [signed(fingerprint(t)) for t in C.text_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["_row"], batch["doc_id"], pa.array(made, pa.int64())], names=["_row", "doc_id", "fp"])


def spanning(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that span the groups of a bucket: pairs whose chain from `start` keeps within its budgets, and whose full
    distance is MOST or less."""
    one = np.uint64(ring(start, ONE))
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(len(fps) - 1):
        x = fps[i + 1 :] ^ fps[i]
        near = np.flatnonzero(np.bitwise_count(x & one) <= 1)
        near = near[np.bitwise_count(x[near]) <= MOST]
        for j in (near + i + 1).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                out.append((i, j))
    return out


def _bucket_links(small: int | None):
    """Over rows (start, key, fp) sorted by these, the chain's first segment being start modulo SEGMENTS: links of each bucket as (a, b, null), and, if `small` is given, the
    members of larger buckets as (fp, null, start)."""
    import pyarrow as pa

    def run(batches):
        bucket, members, large = None, [], False
        out: list[tuple] = []

        def close():
            if large or len(members) < 2:
                return
            fps = np.array(members, np.int64)
            out.extend((members[i], members[j], None) for i, j in spanning(fps.view(np.uint64), bucket[0] % SEGMENTS))

        for batch in batches:
            start, key, fp = (np.asarray(batch[i]) for i in range(3))
            cut = np.flatnonzero((np.diff(start) != 0) | (np.diff(key) != 0)) + 1
            bounds = [0, *cut.tolist(), len(start)]
            # buckets of one row, which neither touch the batch's ends nor need a look, are skipped
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a == 1 and a > 0 and b < len(start):
                    if members and not large:
                        close()
                    bucket, members, large = None, [], False
                    continue
                here = (int(start[a]), int(key[a]))
                if here != bucket:
                    close()
                    bucket, members, large = here, [], False
                more = fp[a:b].tolist()
                if large:
                    out.extend((x, None, bucket[0]) for x in more)
                else:
                    members += more
                    if small is not None and len(members) > small:
                        out.extend((x, None, bucket[0]) for x in members)
                        members, large = [], True
                if len(out) > 50_000:
                    yield pack(out)
                    out = []
        close()
        if out:
            yield pack(out)

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "start"])

    return run


def links(distinct: DataFrame, scratch: C.Scratch, small: int = SMALL_BUCKET) -> DataFrame:
    """(a, b): links that span the groups of distinct fingerprints (fp)."""
    schema = "a long, b long, start int"
    first = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(signed(ring(i, EQUAL)))).alias("key")) for i in range(SEGMENTS)]))
    keyed = distinct.select("fp", first.alias("k")).select("k.start", "k.key", "fp").repartition("start", "key").sortWithinPartitions("start", "key", "fp")
    found = scratch.keep(keyed.mapInArrow(_bucket_links(small), schema), "links")
    direct, large = found.filter("start IS NULL").select("a", "b"), found.filter("start IS NOT NULL")
    if large.isEmpty():
        return direct
    kept = scratch.keep(large.select(F.col("a").alias("fp"), "start").distinct(), "large")
    again = None
    for i in range(SEGMENTS):
        six, three = ring(i, ONE), ring(i, EQUAL)
        open_bits = [b for b in range(64) if (six & ~three) >> b & 1]
        keys = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.col("fp").bitwiseAND(F.lit(signed(six & ~(1 << b)))).alias("key")) for b in open_bits]))
        rows = kept.filter(F.col("start") == i).select("start", "fp", keys.alias("k")).select((F.col("k.bit") * SEGMENTS + F.col("start")).alias("start"), "k.key", "fp")
        again = rows if again is None else again.unionByName(rows)
    dealt = again.repartition("start", "key").sortWithinPartitions("start", "key", "fp")
    return direct.unionByName(dealt.mapInArrow(_bucket_links(None), schema).select("a", "b"))


def near_duplicates(docs: DataFrame, scratch: C.Scratch, small: int = SMALL_BUCKET) -> DataFrame:
    """(_row, doc_id, fp, component_id, keep_row) of each row of docs (_row, doc_id, text); keep_row is the row with the
    least id of its group."""
    made = docs.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, f"_row {C.ROW}, doc_id long, fp long")
    prints = scratch.keep(C.salted(made, "_row"), "prints", docs.count(), C.DOC_ROWS)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row"))
    parts = scratch.keep(prints.groupBy("fp", "_salt").agg(first.alias("least")), "parts", prints.count())
    distinct = scratch.keep(parts.groupBy("fp").agg(F.min("least").alias("least")), "distinct", parts.count())
    n = distinct.count()
    roots = components(links(distinct.select("fp"), scratch, small), scratch, SEGMENTS * 64 * n)
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = scratch.keep(C.with_least(rooted, "root", "least", "first", "fp").select("fp", "first"), "groups", n)
    of_part = parts.select("fp", "_salt").join(groups, "fp")  # a common fingerprint is joined part by part
    return prints.join(of_part, ["fp", "_salt"]).select("_row", "doc_id", "fp", F.col("first.doc_id").alias("component_id"), F.col("first._row").alias("keep_row"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    scratch = C.Scratch(spark, "op8")
    docs = C.with_row_id(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), scratch)
    return near_duplicates(docs, scratch).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def alike(prints: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(a, b): pairs of nodes (node, fp) that span the groups of fingerprints MOST bits or less apart: those of one
    fingerprint with the least of them, and the least ones of fingerprints that are linked."""
    same = scratch.keep(C.with_least(prints, "fp", "node", "least", "node"), "alike", prints.count())
    of = same.filter("node = least").select("fp", "node")
    side = lambda k: of.select(F.col("fp").alias(f"f{k}"), F.col("node").alias(k))
    found = links(of.select("fp"), scratch).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    return found.join(side("a"), "fa").join(side("b"), "fb").select("a", "b").union(same.filter("node <> least").select("least", "node"))


def stage_simhash(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates stays. Texts are linked by SimHash over five words,
    found by pigeonring filtering; a link holds if the sets of shingles have a Jaccard similarity of 0.8 or more. As 64
    bits differ in about ten at that similarity, links that fingerprints don't show are found exactly by jaccard, which
    compares only what SimHash has left in different groups."""
    scratch = C.Scratch(spark, "stage-simhash", C.STAGE_BYTES)
    rows = C.with_row_id(C.boxed(docs), scratch)
    found = jaccard.near_duplicates(rows, scratch, first=(of_set, alike))
    n = rows.count()
    dropped = scratch.keep(found.filter("_row <> keep_row").select("_row"), "dropped", n)
    return C.packed(C.split_rows(rows.select("_doc", "_row"), dropped, scratch, rows=n)[1].select("_doc.*"), n)
