"""Pairs of texts whose sets of shingles have a Jaccard similarity of LEAST or more, all of them, by prefix filtering.

A text's set holds the hashes of its runs of `shingle` words; fewer words are one shingle. Sets are put in one order, in
which shingles that are common in a sample come last; the order decides only how much work there is. If two sets have
similarity t or more, the first n - ceil(t n) + 1 shingles of the one and of the other have a shingle in common, so texts
meet in a bucket for each shingle of their prefixes. A pair passes if its sizes allow t, and if what is left of both sets
from the common shingle on allows the overlap that t asks for; then the two sets are compared.

So that a large group of near copies doesn't hand out all its pairs, there are two rounds: the first compares each text
with the REACH next ones of its buckets, by size, which is all there is to compare in buckets of REACH + 1 texts; the
second compares the pairs of larger buckets that the first left in different groups. No bucket is one task's: in the
first round a shingle that is common in the sample is dealt to parts by its count there, each of which is a large bucket
to the second; there, buckets of one group alone go before anything is shuffled for them, and others are dealt to blocks
of about BLOCK texts, of which each two are a tile of their own. Before whole sets are fetched for a pair, it is asked how many shingles are in one set only: as many at least as bits differ between two bitmaps that hold
the parity of shingles by place. A small bitmap of BITS words goes with each text into its buckets; one with a bit for
each shingle at least, which tells unlike texts of any length apart, is compared before the sets are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: Next texts of a bucket with which one is compared first.
REACH = 8
#: About how many texts of a common shingle are one part of the first round, and of a bucket one block of the second.
PART, BLOCK = 1 << 13, 1 << 9
#: Texts from which common shingles are counted, and how many of these are told apart.
SAMPLE, COMMON = 4000, 1 << 16
#: Rows of a file of sets, which may be as large as texts.
SET_ROWS = 1 << 14
#: 64-bit words of a bitmap.
BITS = 8


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; words and letter case as in simhash.fingerprint."""
    buf = np.frombuffer(text.lower(), np.uint8)  # of bytes: A-Z only
    word = C.word_hashes(buf, *C.word_bounds(buf))
    h = np.zeros(max(1, len(word) - shingle + 1) if len(word) else 0, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(shingle, len(word))):
            h = h * np.uint64(0xD6E8FEB86659FD93) + word[j : j + len(h)]
    return np.unique(C.mix64(h))


def node(found: np.ndarray) -> int:
    """A set's name."""
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def parity(found: np.ndarray, places: int) -> np.ndarray:
    """For each of `places` places, a power of two, whether an odd number of shingles falls on it, packed."""
    odd = np.bincount((found >> np.uint64(40)).astype(np.int64) & (places - 1), minlength=places) & 1
    return np.packbits(odd.astype(bool))


def wide(found: np.ndarray) -> bytes:
    """A parity bitmap with a place for each shingle at least."""
    return parity(found, max(64, 1 << max(0, len(found) - 1).bit_length())).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ. The halves of the longer one are folded first."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return least[1] * both >= least[0] * (len(a) + len(b) - both)


def _fit(n, m, left, least):
    """Whether sets of n and m shingles, of which at most `left` are common, can be similar."""
    return (least[1] * np.minimum(n, m) >= least[0] * np.maximum(n, m)) & ((least[0] + least[1]) * left >= least[0] * (n + m))


def _nodes(shingle, print_of=None):
    import pyarrow as pa

    def run(batches):
        C.worker_for("jaccard", lambda: None)
        for whole in batches:
            for batch in C.slices(whole):
                made = [(node(x), len(x), wide(x), print_of(x) if print_of else 0, parity(x, 64 * BITS)) for x in (shingles(t, shingle) for t in C.text_bytes(batch["text"]))]
                maps = np.stack([m[4].view(np.int64) for m in made])
                fps = np.array([m[3] for m in made], np.uint64).view(np.int64)
                kinds = (pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch["_row"], batch["doc_id"], *(pa.array([m[i] for m in made], t) for i, t in enumerate(kinds)), pa.array(fps), *map(pa.array, maps.T.copy())], names=["_row", "doc_id", "node", "size", "wide", "fp", *MAPS])

    return run


MAPS = [f"bits{i}" for i in range(BITS)]


def _exploded(shingle):
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            for batch in C.slices(whole):
                for t in C.text_bytes(batch["text"]):
                    yield pa.RecordBatch.from_arrays([pa.array(shingles(t, shingle).view(np.int64))], names=["sh"])

    return run


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    n = len(found)
    keep = n + (-least[0] * n // least[1]) + 1 if n else 0
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        found = found[np.lexsort((found, np.where(common[at] == found, counts[at], 0)))]
    return found[:keep]


def dealt(first: np.ndarray, name: int, common: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each shingle of a prefix the key of the part of its bucket that the text is dealt to by its name, and whether
    the bucket has more parts than one."""
    many = np.ones(len(first), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, first), len(common) - 1)
        many = np.where(common[at] == first, parts[at], 1)
    split = many > 1
    with np.errstate(over="ignore"):
        key = C.mix64(first + (np.uint64(name % (1 << 64)) % many.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    return np.where(split, key, first).view(np.int64), split


def _entries(shingle, common, counts, parts, least):
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            for batch in C.slices(whole):
                out = []
                for t in C.text_bytes(batch["text"]):
                    found = shingles(t, shingle)
                    first = prefix(found, common, counts, least)
                    k, name = len(first), node(found)
                    out.append((*dealt(first, name, common, parts), first.view(np.int64), np.full(k, len(found), np.int32), np.full(k, name, np.int64), np.arange(k, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=ENTRY)

    return run


def _grouped(batches):
    """Batches of numpy columns, the first being the key they are sorted by, cut so that no key is in two of them."""
    held = None
    for batch in batches:
        got = [np.asarray(c) for c in batch.columns]
        if not len(got[0]):
            continue
        if held is not None:
            got = [np.concatenate(x) for x in zip(held, got, strict=True)]
        last = int(np.searchsorted(got[0], got[0][-1], "left"))
        if last:
            yield [c[:last] for c in got]
        held = [c[last:] for c in got]
    if held is not None:
        yield held


ENTRY = ["part", "split", "sh", "n", "node", "pos"]
PAIRS = "sh long, n int, node long, pos int, other long"


def _neighbours(least):
    """Over ENTRY sorted by part, sh, n, node: pairs of neighbours as (null, null, node, null, other), and the members of
    buckets of more than REACH + 1 or of several parts as they are."""
    import pyarrow as pa

    def run(batches):
        for part, split, sh, n, node, pos in _grouped(batches):
            new = np.append(True, (part[1:] != part[:-1]) | (sh[1:] != sh[:-1]) | (node[1:] != node[:-1]))  # copies of a text count once
            split, sh, n, node, pos = (x[new] for x in (split, sh, n, node, pos))
            wide, left, pairs = n.astype(np.int64), n - pos, []
            for d in range(1, REACH + 1):
                a = np.flatnonzero(sh[d:] == sh[:-d])
                a = a[_fit(wide[a + d], wide[a], np.minimum(left[a + d], left[a]), least)]
                pairs.append(np.sort(np.stack([node[a], node[a + d]], 1), 1))
            pair = np.unique(np.concatenate(pairs), axis=0)
            _, group, size = np.unique(sh, return_inverse=True, return_counts=True)
            more = split | (size[group] > REACH + 1)
            void = lambda t: pa.nulls(len(pair), t)
            yield pa.RecordBatch.from_arrays([void(pa.int64()), void(pa.int32()), pa.array(pair[:, 0]), void(pa.int32()), pa.array(pair[:, 1])], names=["sh", "n", "node", "pos", "other"])
            yield pa.RecordBatch.from_arrays([pa.array(x[more]) for x in (sh, n, node, pos)] + [pa.nulls(int(more.sum()), pa.int64())], names=["sh", "n", "node", "pos", "other"])

    return run


def _across(least):
    """Over (tile, n, node, pos, root, block, bits) sorted by tile: pairs (a, b) of a tile that are of different groups, and
    of different blocks, where it has two."""
    import pyarrow as pa

    def pack(found):
        pair = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    def run(batches):
        out, held = [], 0
        for tile, n, node, pos, root, block, *bits in _grouped(batches):
            n, bounds = n.astype(np.int64), np.append(np.flatnonzero(np.append(True, tile[1:] != tile[:-1])), len(tile))
            maps = np.stack(bits, 1).view(np.uint64)
            mixed = np.minimum.reduceat(root, bounds[:-1]) != np.maximum.reduceat(root, bounds[:-1])
            for lo, hi in zip(bounds[:-1][mixed].tolist(), bounds[1:][mixed].tolist(), strict=True):
                one = (block[lo:hi] == block[lo]).all()
                for i in range(lo, hi - 1):
                    at = np.flatnonzero((root[i + 1 : hi] != root[i]) & (one | (block[i + 1 : hi] != block[i])) & _fit(n[i + 1 : hi], n[i], np.minimum(n[i + 1 : hi] - pos[i + 1 : hi], n[i] - pos[i]), least)) + i + 1
                    apart = np.bitwise_count(maps[at] ^ maps[i]).sum(1, dtype=np.int64)
                    at = at[sum(least) * apart <= (least[1] - least[0]) * (n[at] + n[i])]
                    if len(at):
                        out.append(np.sort(np.stack([node[at], np.full(len(at), node[i])], 1), 1))
                        held += len(at)
                        if held > 50_000:
                            yield pack(out)
                            out, held = [], 0
        if out:
            yield pack(out)

    return run


def _sets(shingle):
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            for batch in C.slices(whole):
                made = [shingles(t, shingle).tobytes() for t in C.text_bytes(batch["text"])]
                yield pa.RecordBatch.from_arrays([batch["node"], pa.array(made, pa.binary())], names=["node", "set"])

    return run


def _maybe_similar(least):
    """Pairs (a, b) whose wide bitmaps (wa, wb) don't rule out that they are similar."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            most = ((least[1] - least[0]) * (np.asarray(batch["na"], np.int64) + np.asarray(batch["nb"], np.int64))).tolist()
            good = [sum(least) * apart(x, y) <= m for x, y, m in zip(batch["wa"].to_pylist(), batch["wb"].to_pylist(), most, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _compared(least):
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            for batch in C.slices(whole):
                of = lambda name: (np.frombuffer(x, np.uint64) for x in batch[name].to_pylist())  # noqa: B023, E731
                good = [similar(x, y, least) for x, y in zip(of("sa"), of("sb"), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def tiles(members: DataFrame, scratch: C.Scratch, rows: int, block: int = BLOCK) -> DataFrame:
    """(tile, n, node, pos, root, block) of those members (sh, n, node, pos, root) whose bucket has more groups than one:
    each goes to a tile for each block of its bucket. Tiles whose hashes agree are compared as one, which only adds pairs."""
    held = scratch.keep(C.salted(members, "node"), "members", rows)
    part = held.groupBy("sh", "_salt").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"))
    mixed = part.groupBy("sh").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("size").alias("size")).filter("lo <> hi")
    blocks = mixed.select("sh", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    d = held.join(part.select("sh", "_salt").join(blocks, "sh"), ["sh", "_salt"])  # salted, so that a large bucket is joined part by part
    d = d.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return d.select(F.xxhash64("sh", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "n", "node", "pos", "root", "block")


def near_duplicates(docs: DataFrame, scratch: C.Scratch, shingle: int = SHINGLE, least: tuple[int, int] = LEAST, part: int = PART, block: int = BLOCK, first: tuple[Callable, Callable] | None = None) -> DataFrame:
    """(_row, doc_id, node, keep_row) of each row of docs (_row, doc_id, text); keep_row is the row with the least id of
    its group, a null id being larger than any other. Groups are what links of similar texts connect. first: a function
    that makes a fingerprint (64 bits) of a set, and one that makes pairs (a, b) of (node, fp); these are compared before
    all others, and what they link is one group already to the rounds that follow."""
    texts = docs.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = texts.mapInArrow(_nodes(shingle, first and first[0]), f"_row {C.ROW}, doc_id long, node long, size int, wide binary, fp long, {', '.join(f'{m} long' for m in MAPS)}")
    n = texts.count()
    prints = scratch.keep(C.salted(made, "_row"), "prints", n, C.DOC_ROWS)
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row"))
    same = [F.first(c).alias(c) for c in ("size", "wide", "fp", *MAPS)]
    parts = scratch.keep(prints.groupBy("node", "_salt").agg(lowest.alias("least"), *same), "parts", n)
    distinct = scratch.keep(parts.groupBy("node").agg(F.min("least").alias("least"), *same), "distinct", n)

    share = int(min(1.0, SAMPLE / max(1, n)) * (1 << 20))
    sample = texts.filter(F.pmod(F.xxhash64("_row"), F.lit(1 << 20)) < share).select("text")
    seen = sample.mapInArrow(_exploded(shingle), "sh long").groupBy("sh").count().filter("count > 2")
    held = seen.orderBy(F.desc("count"), "sh").limit(COMMON).collect()
    common = np.array([r.sh for r in held], np.int64).view(np.uint64)
    counts, order = np.array([r["count"] for r in held], np.int64), np.argsort(common)
    common, counts = common[order], counts[order]
    parts_of = -(-counts * max(n, SAMPLE) // (SAMPLE * part))  # copies of a text go to one part

    entries = texts.select("text").mapInArrow(_entries(shingle, common, counts, parts_of, least), "part long, split boolean, sh long, n int, node long, pos int")
    met = scratch.keep(entries.repartition("part").sortWithinPartitions("part", "sh", "n", "node").mapInArrow(_neighbours(least), PAIRS), "met", 128 * n)

    def compared(pairs: DataFrame, most: int) -> DataFrame:
        side = lambda k: distinct.select(F.col("node").alias(k), F.col("size").alias(f"n{k}"), F.col("wide").alias(f"w{k}"))
        both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
        pairs = scratch.keep(both.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(_maybe_similar(least), "a long, b long"), "pairs", most)
        m = pairs.count()
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        needed = scratch.keep(nodes.join(distinct, "node").select("node", F.col("least._row").alias("_row")), "needed", min(n, 2 * m))
        some = C.split_rows(texts.select("_row", "text"), needed, scratch, rows=n)[0].join(needed, "_row")
        sets = scratch.keep(some.select("node", "text").mapInArrow(_sets(shingle), "node long, set binary"), "sets", min(n, 2 * m), SET_ROWS)
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
        out = scratch.keep(both.select("a", "b", "sa", "sb").mapInArrow(_compared(least), "a long, b long"), "links", m, SET_ROWS)
        scratch.free(sets)
        return out

    pairs, done = met.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), None
    if first:
        done = compared(first[1](distinct.select("node", "fp"), scratch), n)
        known = components(done, scratch, done.count())
        side = lambda k: known.select(F.col("node").alias(k), F.col("root").alias(f"r{k}"))
        pairs = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter("ra IS NULL OR rb IS NULL OR ra <> rb").select("a", "b")
    links = compared(pairs, met.count())
    links = links if done is None else links.union(done)
    roots = components(links, scratch, links.count())
    many = met.count()
    members = met.filter("other IS NULL").join(roots, "node", "left").select("sh", "n", "node", "pos", F.coalesce("root", "node").alias("root"))
    apart = tiles(members, scratch, many, block).join(distinct.select("node", *MAPS), "node").select("tile", "n", "node", "pos", "root", "block", *MAPS)
    links = links.union(compared(apart.repartition("tile").sortWithinPartitions("tile", "n", "node").mapInArrow(_across(least), "a long, b long"), many))
    roots = components(links, scratch, links.count())
    rooted = distinct.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    groups = scratch.keep(C.with_least(rooted, "root", "least", "first", "node").select("node", "first"), "groups", n)
    of_part = parts.select("node", "_salt").join(groups, "node")  # a text with many copies is joined part by part
    return prints.join(of_part, ["node", "_salt"]).select("_row", "doc_id", "node", F.col("first._row").alias("keep_row"))
