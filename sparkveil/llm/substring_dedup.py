"""Removal of repeated passages with a log-structured index of window hashes.

Documents come in batches, in the order of their ids. A window is WINDOW consecutive words. The index is a list of runs:
immutable files, one for each bucket of hashes, of sorted window hashes with the first document of each. The windows of a
batch are dealt to the buckets, sorted, and merge-joined with each run's file, which is read as a stream, so that history
is never shuffled nor held; windows that no run has become the next run, with their smallest document. When there are more
than MOST_RUNS runs, the two smallest are merged into one, bucket by bucket, as streams. A manifest names the runs and
their files, so that a later call can open the index and go on with new documents.

A hit is then verified on the texts: the document that had the window first is read again, and the window counts as
repeated only if a second hash, with other multipliers for letters and words, agrees too; 128 bits in all. Two different
windows that share the first hash could hide one another. Every document in which that may have happened is found, as it
lacks a window that was to be removed or has two windows for one hash, and decided anew by comparing all windows that
share a hash with one of its own, by both hashes: so no repeat is lost.

Before the shuffle a task keeps, of the texts it holds at once (SLICE bytes), the smallest document for each window; the
others of the slice are hits already, and are dealt out evenly. So a passage that a third of all documents share meets
its bucket once for each slice, not once for each document. Hashes travel as packed arrays, one for each slice and bucket;
there are MOST_BUCKETS buckets at most and then more batches, so that arrays stay long and a bucket of a batch fits into
a task at any size of the corpus. Files carry a name of their own for each attempt at a task; the table of hits, which
Spark commits, names those that count.

Defined results: words are judged on the input, not on what is left; a null text has no words; a document of fewer words
than a window loses none; documents with equal ids don't remove one another's words; a null id is larger than all others
and equal to other null ones. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 13
#: Bytes of a text that are hashed at once, and bytes of texts within which a task looks for repeats before the shuffle.
PIECE, SLICE = 1 << 18, 6 << 20
MOST_RUNS = 2
#: Batches of one call, at least; and bytes of input for each bucket of the index, as long as there are fewer than the most.
BATCHES, BUCKET_BYTES, MOST_BUCKETS = 4, 16 << 20, 1 << 15
#: Bytes of input of one batch for each bucket, at most: what a task holds and sorts; more bytes make more batches.
BATCH_BUCKET_BYTES = 16 << 20
#: Windows of a row group of a run's file: what is read of it at once.
GROUP = 1 << 17
NO_ID = (1 << 63) - 1
_BASES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))


# ---- windows of one text ----------------------------------------------------------------------------------------


def pieces(raw: bytes):
    """Cuts a text of any length between words."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and raw[end] not in C.SPACES:
            end += 1
        yield raw[at:end]
        at = end


def window_hashes(raw: bytes, which: int, size: int = WINDOW, mask: int = ~0):
    """(number of the first window, hashes), piece by piece. `mask` may shorten hashes in tests."""
    letter, step = _BASES[which]
    carry, first = np.zeros(0, np.uint64), 0
    for piece in pieces(raw):
        buf = np.frombuffer(piece, np.uint8)
        words = np.concatenate([carry, C.word_hashes(buf, *C.word_bounds(buf), letter)])
        n = len(words) - size + 1
        if n > 0:
            h = np.zeros(n, np.uint64)
            with np.errstate(over="ignore"):
                for j in range(size):
                    h *= np.uint64(step)
                    h += words[j : j + n]
            yield first, C.mix64(h) & np.uint64(mask & (2**64 - 1))
            first += n
        carry = words[max(0, n) :]


def all_hashes(raw: bytes, which: int, size: int = WINDOW, mask: int = ~0) -> np.ndarray:
    got = [h for _, h in window_hashes(raw, which, size, mask)]
    return np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64)


def _pack(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(raw: bytes, kind=np.int64) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _slice_windows(size: int, mask: int, buckets: int):
    """(b, h, doc, ref): for each slice and bucket the windows with the smallest document of each, and the slice's hits,
    which also have that document as ref, dealt evenly."""
    import pyarrow as pa

    names, kinds = ["b", "h", "doc", "ref"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        turn = 0
        C.worker_for("substring_dedup", lambda: None)
        for whole in batches:
            for batch in C.slices(whole, SLICE):
                rows = []
                texts = sorted(zip(batch["_doc"].to_pylist(), C.text_bytes(batch["text"]), strict=True), key=lambda x: x[0])
                hashes = [all_hashes(raw, 0, size, mask) for _, raw in texts]
                h = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
                if not len(h):
                    continue
                docs = np.array([d for d, _ in texts], np.int64)
                owner = np.repeat(np.arange(len(docs), dtype=np.int32), [len(x) for x in hashes])
                order = np.argsort(h, kind="stable")  # documents come in order, so that it is by document too
                h, owner = h[order], owner[order]
                first = np.concatenate([[True], h[1:] != h[:-1]])
                smallest = owner[np.flatnonzero(first)[np.cumsum(first) - 1]]
                fresh = first | (owner != np.concatenate([[-1], owner[:-1]]))
                hit = fresh & (docs[owner] > docs[smallest])
                if hit.any():
                    turn += 1
                    rows.append((int((h[0].view(np.uint64) + np.uint64(turn)) % np.uint64(buckets)), h[hit].tobytes(), _pack(docs[owner[hit]]), _pack(docs[smallest[hit]])))
                h, owner = h[first], owner[first]
                b = (h.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(b, kind="stable")
                cuts = np.flatnonzero(np.diff(b[order])) + 1
                for part in np.split(order, cuts):
                    rows.append((int(b[part[0]]), h[part].tobytes(), _pack(docs[owner[part]]), None))
                for at in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + 256]], k) for i, k in enumerate(kinds)], names=names)

    return run


# ---- the index ---------------------------------------------------------------------------------------------------


class _Writer:
    """A file of a run, sorted by hash, written part by part under a name that no other attempt uses."""

    def __init__(self, folder: str, bucket: int):
        self.files, base = C.store(folder)
        self.files.create_dir(base, recursive=True)
        self.name, self.n, self.writer = f"bucket-{bucket:06d}-{uuid.uuid4().hex}.parquet", 0, None
        self.path = f"{base}/{self.name}"

    def write(self, h: np.ndarray, doc: np.ndarray) -> None:
        import pyarrow as pa
        import pyarrow.parquet as pq

        if not len(h):
            return
        if self.writer is None:
            self.out = self.files.open_output_stream(self.path, compression=None)
            encoding = {"h": "DELTA_BINARY_PACKED", "doc": "PLAIN"}
            self.writer = pq.ParquetWriter(self.out, pa.schema([("h", pa.int64()), ("doc", pa.int64())]), compression="zstd", use_dictionary=False, column_encoding=encoding, write_statistics=False)
        self.writer.write_table(pa.table({"h": h, "doc": doc}), row_group_size=GROUP)
        self.n += len(h)

    def close(self) -> None:
        if self.writer is not None:
            self.writer.close()
            self.out.close()


def _stored(folder: str, name: str | None):
    """The windows of a file, group by group."""
    import pyarrow.parquet as pq

    if name is None:  # the run has no window in this bucket
        return
    files, base = C.store(folder)
    with files.open_input_file(f"{base}/{name}") as f:
        file = pq.ParquetFile(f)
        for k in range(file.num_row_groups):
            t = file.read_row_group(k, use_threads=False)
            yield t["h"].to_numpy(), t["doc"].to_numpy()


#: Hits, and a row for each file that was written: its bucket as h, its windows as doc.
FOUND = "h long, doc long, ref long, file string"


def _merge_batch(runs, keep: str | None):
    """The hits of a batch's buckets, over rows sorted by bucket. What is new goes to files of the run `keep`. runs: a
    broadcast list of (folder, file of each bucket)."""
    import pyarrow as pa

    def out(h, doc, ref):
        for at in range(0, len(h), 1 << 16):
            s = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(h[s]), pa.array(doc[s]), pa.array(ref[s]), pa.nulls(len(h[s]), pa.string())], names=["h", "doc", "ref", "file"])

    def close(b, parts):
        h, doc = np.frombuffer(b"".join(p[0] for p in parts), np.int64), np.concatenate([_unpack(p[1]) for p in parts])
        parts.clear()
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        only, least = h[first], doc[first].copy()
        had = np.zeros(len(only), bool)
        for folder, files in runs.value:
            for old, owner in _stored(folder, files.get(b)):
                lo, hi = np.searchsorted(only, old[0], "left"), np.searchsorted(only, old[-1], "right")
                at = np.minimum(np.searchsorted(old, only[lo:hi]), len(old) - 1)
                here = old[at] == only[lo:hi]
                least[lo:hi] = np.where(here, owner[at], least[lo:hi])
                had[lo:hi] |= here
        ref = np.repeat(least, np.diff(np.append(first, len(h))))
        hit = (doc > ref) & (np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
        yield from out(h[hit], doc[hit], ref[hit])
        if keep is not None:
            new = ~had & (least != NO_ID)  # a document without an id is larger than those to come
            file = _Writer(keep, b)
            file.write(only[new], least[new])
            file.close()
            if file.n:
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([file.n], pa.int64()), pa.nulls(1, pa.int64()), pa.array([file.name])], names=["h", "doc", "ref", "file"])

    def run(batches):
        bucket, parts = None, []
        for batch in batches:
            for b, h, doc, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ref is not None:
                    yield from out(np.frombuffer(h, np.int64), _unpack(doc), _unpack(ref))
                    continue
                if b != bucket and parts:
                    yield from close(bucket, parts)
                bucket = b
                parts.append((h, doc))
        if parts:
            yield from close(bucket, parts)

    return run


def _merged(one, two):
    """Two streams of sorted windows as one."""
    held = [None, None]
    streams = [iter(one), iter(two)]
    while True:
        for k in (0, 1):
            while streams[k] is not None and (held[k] is None or not len(held[k][0])):
                held[k] = next(streams[k], None)
                if held[k] is None:
                    streams[k] = None
        live = [k for k in (0, 1) if held[k] is not None and len(held[k][0])]
        if len(live) < 2:
            for k in live:
                yield held[k]
                yield from streams[k] or ()
            return
        end = min(held[0][0][-1], held[1][0][-1])
        cut = [np.searchsorted(held[k][0], end, "right") for k in (0, 1)]
        h, doc = (np.concatenate([held[k][i][: cut[k]] for k in (0, 1)]) for i in (0, 1))
        held = [(held[k][0][cut[k] :], held[k][1][cut[k] :]) for k in (0, 1)]
        order = np.argsort(h, kind="stable")  # of two sorted parts: one merge
        yield h[order], doc[order]


def _merge_runs(pair, into: str):
    """Merges the files of two runs (folder, files), bucket by bucket."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            made = []
            for bucket in batch["id"].to_pylist():
                file = _Writer(into, bucket)
                for h, doc in _merged(*(_stored(folder, files.get(bucket)) for folder, files in pair.value)):
                    file.write(h, doc)
                file.close()
                if file.n:
                    made.append((bucket, file.n, file.name))
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["bucket", "n", "file"])

    return run


class WindowIndex:
    """Runs of window hashes below a folder that all executors share. add() takes the next documents; they must not be
    smaller than those of earlier batches. Opened on a folder that holds an index, it goes on with that one, whose number
    of buckets and size of windows stay."""

    def __init__(self, spark, folder: str, buckets: int = 1024, size: int = WINDOW, mask: int = ~0):
        self.spark, self.folder = spark, folder.rstrip("/")
        #: Each (folder, windows, file of each bucket); the number of the last manifest; the greatest document.
        self.state = {"buckets": max(1, min(buckets, MOST_BUCKETS)), "size": size, "mask": mask, "last": None, "runs": []}
        files, base = C.store(self.folder)
        files.create_dir(base, recursive=True)
        from pyarrow import fs

        there = sorted(f.path for f in files.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("manifest-"))
        self.version = len(there) and int(there[-1].rpartition("-")[2].removesuffix(".json"))
        if there:
            with files.open_input_stream(there[-1]) as f:
                self.state = json.loads(f.read())
            if self.state["size"] != size:
                raise ValueError(f"the index holds windows of {self.state['size']} words")
        self.buckets, self.size, self.mask = self.state["buckets"], self.state["size"], self.state["mask"]

    def _commit(self, **changes) -> None:
        """Writes the next manifest; runs that it no longer names go after that."""
        old = {r[0] for r in self.state["runs"]}
        self.state |= changes
        self.version += 1
        files, base = C.store(self.folder)
        with files.open_output_stream(f"{base}/manifest-{self.version:08d}.json", compression=None) as f:
            f.write(json.dumps(self.state).encode())
        for gone in old - {r[0] for r in self.state["runs"]}:
            C.delete(self.spark, gone)

    def _shared(self, runs):
        return self.spark.sparkContext.broadcast([(folder, {int(b): f for b, f in files.items()}) for folder, _, files in runs])

    def add(self, docs: DataFrame, scratch: C.Scratch, keep: bool = True) -> DataFrame:
        """(h, doc, ref): windows of docs (_doc, text) that earlier documents have. keep: the batch becomes a run."""
        ends = docs.filter(F.col("_doc") != NO_ID).agg(F.min("_doc").alias("lo"), F.max("_doc").alias("hi")).collect()[0]
        if ends.lo is not None and self.state["last"] is not None and ends.lo < self.state["last"]:
            raise ValueError("documents must be added in the order of their ids")
        folder = f"{self.folder}/run-{uuid.uuid4().hex}" if keep else None
        windows = docs.select("_doc", "text").mapInArrow(_slice_windows(self.size, self.mask, self.buckets), "b int, h binary, doc binary, ref binary")
        dealt = windows.repartition(self.buckets, "b").sortWithinPartitions("b")
        found = scratch.keep(dealt.mapInArrow(_merge_batch(self._shared(self.state["runs"]), folder), FOUND), "hits")
        if keep:
            made = found.filter("file IS NOT NULL").collect()  # a row for each bucket at most
            last = max((x for x in (self.state["last"], ends.hi) if x is not None), default=None)
            self._commit(last=last, runs=[*self.state["runs"], [folder, sum(r.doc for r in made), {str(r.h): r.file for r in made}]])
            while len(self.state["runs"]) > MOST_RUNS:
                self._compact()
        C.free_shuffles(self.spark)
        out = found.filter("file IS NULL").select("h", "doc", "ref")
        out._scratch_path = found._scratch_path
        return out

    def _compact(self) -> None:
        """Merges the two smallest runs. Their hashes differ, as a batch's run holds none that an earlier run has."""
        pair = sorted(self.state["runs"], key=lambda r: r[1])[:2]
        into = f"{self.folder}/run-{uuid.uuid4().hex}"
        made = self.spark.range(0, self.buckets, 1, self.buckets).mapInArrow(_merge_runs(self._shared(pair), into), "bucket long, n long, file string").collect()
        new = [into, sum(r.n for r in made), {str(r.bucket): r.file for r in made}]
        self._commit(runs=[*(r for r in self.state["runs"] if r not in pair), new])

    def close(self) -> None:
        """Deletes the index."""
        C.delete(self.spark, self.folder)


# ---- verification and removal ------------------------------------------------------------------------------------


def sealed(h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """One number for both hashes of windows."""
    with np.errstate(over="ignore"):
        return C.mix64(h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ C.mix64(check.view(np.uint64).copy())).view(np.int64)


def _second_hashes(size: int, mask: int):
    """(ref, h, seal) of the wanted windows of documents (_doc, text, wanted)."""
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            for batch in C.slices(whole):
                for doc, raw, wanted in zip(batch["_doc"].to_pylist(), C.text_bytes(batch["text"]), batch["wanted"], strict=True):
                    h = all_hashes(raw, 0, size, mask)
                    at = np.flatnonzero(np.isin(h, np.asarray(wanted.values)))
                    if not len(at):
                        continue
                    h, seal = h[at], sealed(h[at], all_hashes(raw, 1, size)[at])
                    _, once = np.unique(seal, return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(once), doc, np.int64)), pa.array(h[once]), pa.array(seal[once])], names=["ref", "h", "seal"])

    return run


def kept_words(raw: bytes, repeated: np.ndarray | None, size: int, mask: int) -> tuple[int, int, str, bool]:
    """Number of words, number removed, digest of those kept, and whether a hash may stand for two windows here: one that
    was to be removed isn't there, or a window has the hash of a removed one but isn't it. repeated: seals of the windows
    to remove."""
    words = raw.split()  # of bytes: the white space of common.WORD
    if repeated is None or not len(repeated) or len(words) < size:
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), repeated is not None and len(repeated) > 0
    h = all_hashes(raw, 0, size, mask)
    seals = sealed(h, all_hashes(raw, 1, size))
    hit = np.isin(seals, repeated)
    doubtful = len(np.unique(seals[hit])) < len(repeated) or bool(np.isin(h[~hit], h[hit]).any())
    at = np.flatnonzero(hit)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    gone = np.cumsum(cover[:-1]) > 0
    left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
    return len(words), int(gone.sum()), hashlib.sha256(left).hexdigest(), doubtful


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, doubtful boolean"


def _results(size: int, mask: int):
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())

    def run(batches):
        for whole in batches:
            for batch in C.slices(whole):
                seals = batch["seals"] if "seals" in batch.schema.names else [None] * batch.num_rows
                rows = []
                for doc, raw, seal in zip(batch["doc_id"].to_pylist(), C.text_bytes(batch["text"]), seals, strict=True):
                    repeated = np.asarray(seal.values) if seal is not None and seal.is_valid else None
                    rows.append((doc, *kept_words(raw, repeated, size, mask)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "doubtful"])

    return run


def _windows_of(size: int, mask: int, some=None):
    """(doc, h, seal): the distinct windows of documents (_doc, text); `some`: a broadcast bitmap that lets hashes pass."""
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            for batch in C.slices(whole):
                for doc, raw in zip(batch["_doc"].to_pylist(), C.text_bytes(batch["text"]), strict=True):
                    h = all_hashes(raw, 0, size, mask)
                    seal = sealed(h, all_hashes(raw, 1, size))
                    if some is not None:
                        at = (h.view(np.uint64) % np.uint64(len(some.value))).astype(np.int64)
                        h, seal = h[some.value[at]], seal[some.value[at]]
                    _, once = np.unique(seal, return_index=True)
                    for k in range(0, len(once), 1 << 16):
                        cut = once[k : k + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), doc, np.int64)), pa.array(h[cut]), pa.array(seal[cut])], names=["doc", "h", "seal"])

    return run


def _decided_anew(docs: DataFrame, every: DataFrame, doubtful: DataFrame, scratch: C.Scratch, size: int, mask: int) -> DataFrame:
    """RESULT for the documents (doc) of `doubtful`: their windows against all windows of the same hash, by both hashes."""
    spark = docs.sparkSession
    schema = "doc long, h long, seal long"
    own = docs.join(doubtful, F.col("_doc") == F.col("doc"))
    theirs = scratch.keep(own.select("_doc", "text").mapInArrow(_windows_of(size, mask), schema), "doubtful")
    places = theirs.select(F.expr(f"CAST(CASE WHEN h >= 0 THEN h % {C.BITMAP_BITS} ELSE (h % {C.BITMAP_BITS} + {C.BITMAP_BITS}) % {C.BITMAP_BITS} END AS int)").alias("p"))  # a power of two: as of the unsigned hash
    bits = np.zeros(C.BITMAP_BITS, bool)
    for r in places.select((F.col("p") / 64).cast("int").alias("w"), (F.col("p") % 64).alias("b")).groupBy("w").agg(F.collect_set("b").alias("b")).toLocalIterator():
        bits[[64 * r.w + b for b in r.b]] = True
    there = every.select("_doc", "text").mapInArrow(_windows_of(size, mask, spark.sparkContext.broadcast(bits)), schema)
    least = there.groupBy("h", "seal").agg(F.min("doc").alias("first"))
    gone = theirs.join(least, ["h", "seal"]).filter("first < doc").groupBy("doc").agg(F.collect_set("seal").alias("seals"))
    return own.join(gone.withColumnRenamed("doc", "_of"), F.col("_doc") == F.col("_of"), "left").select("doc_id", "text", "seals").mapInArrow(_results(size, mask), RESULT)


def _input_bytes(docs: DataFrame) -> int:
    return int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _with_doc(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_doc", F.coalesce("doc_id", F.lit(NO_ID)))


def remove_repeats(
    docs: DataFrame, scratch: C.Scratch, size: int = WINDOW, batches: int = BATCHES, buckets: int | None = None, mask: int = ~0, index: WindowIndex | None = None, history: DataFrame | None = None
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of docs (doc_id, text).

    index: an index of earlier documents, to which these are added, and `history`, a table that holds the texts of those;
    without it an index is made for this call alone. `mask` may shorten hashes in tests."""
    spark, docs = docs.sparkSession, _with_doc(docs)
    every = docs if history is None else docs.unionByName(_with_doc(history))
    n_bytes = _input_bytes(docs)
    own = index is None
    if own:
        index = WindowIndex(spark, f"{scratch.path}/index", buckets or max(12, math.ceil(n_bytes / BUCKET_BYTES)), size, mask)
    batches = max(batches, math.ceil(n_bytes / (index.buckets * BATCH_BUCKET_BYTES)))
    size, mask = index.size, index.mask
    cuts = docs.select(F.percentile_approx("_doc", [i / batches for i in range(1, batches)], 10000)).collect()[0][0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    found = []
    for i, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = docs
        if lo is not None:
            part = part.filter((F.col("doc_id") > lo) | F.col("doc_id").isNull())
        if hi is not None:
            part = part.filter(F.col("doc_id") <= hi)
        found.append(index.add(part, scratch, keep=i < len(cuts) or not own))
    if own:
        index.close()
    hits = reduce(DataFrame.unionByName, found)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = scratch.keep(df, name)
        C.free_shuffles(spark)
        return out

    wanted = keep(hits.groupBy("ref").agg(F.collect_set("h").alias("wanted")), "wanted")  # at most the windows of a text
    near = C.maybe_in(every, C.bitmap(wanted, "ref"), "_doc").filter("_maybe").select("_doc", "text")
    seconds = keep(near.join(wanted, near._doc == wanted.ref).select("_doc", "text", "wanted").mapInArrow(_second_hashes(size, mask), "ref long, h long, seal long"), "seconds")
    scratch.free(wanted)
    # written as it comes, so that Spark may split what a frequent window of one document meets
    checked = keep(hits.join(seconds, ["ref", "h"]).select("doc", "seal"), "checked")
    scratch.free(seconds, *found)
    of_doc = keep(checked.groupBy("doc").agg(F.collect_set("seal").alias("seals")), "seals")
    scratch.free(checked)

    marked = C.maybe_in(docs, C.bitmap(of_doc, "doc"), "_doc")
    plain = marked.filter(~F.col("_maybe")).select("doc_id", "text").mapInArrow(_results(size, mask), RESULT)
    other = marked.filter("_maybe").join(of_doc, F.col("_doc") == F.col("doc"), "left").select("doc_id", "text", "seals").mapInArrow(_results(size, mask), RESULT)
    done = keep(plain.unionByName(other), "results")
    scratch.free(of_doc)
    sure = done.filter("NOT doubtful")
    doubtful = scratch.keep(done.filter("doubtful").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc")).distinct(), "doubtful")
    if not doubtful.isEmpty():
        anew = scratch.keep(_decided_anew(docs, every, doubtful, scratch, size, mask), "anew")
        sure = done.join(doubtful, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("doc"), "left_anti").unionByName(anew)
    return sure.drop("doubtful")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, C.Scratch(spark, "op2"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
     g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS s FROM p),
     f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
     h AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS i FROM g JOIN f ON g.s = f.s WHERE f.first < g.doc_id),
     r AS (SELECT doc_id, list(i) AS gone FROM h GROUP BY doc_id),
     k AS (SELECT d.doc_id, d.w, coalesce(r.gone, []) AS gone FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
     x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM k),
     y AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS t FROM x LEFT JOIN h ON x.doc_id = h.doc_id AND x.i = h.i WHERE h.i IS NULL GROUP BY x.doc_id)
SELECT k.doc_id, CAST(len(k.w) AS BIGINT) AS n_words, CAST(len(k.gone) AS BIGINT) AS n_removed, sha256(coalesce(y.t, '')) AS kept_sha256
FROM k LEFT JOIN y ON k.doc_id = y.doc_id
"""
