"""WARC archives compressed record by record with a dictionary of their own.

An archive (.warc.zst) begins with a skippable frame, magic 0x184D2A5D, that holds a Zstandard dictionary built from the
archive's own records, itself compressed; after it each record is a frame. So a record can be read at its offset alone.

Writers fill a buffer with records of up to ARCHIVE_BYTES, build the dictionary from records spread evenly over the
buffer, and write one archive under a name that no other attempt uses. The table of archives that the job returns names
those that count; files of lost attempts are in no table. Writing and reading go through the file system that the URI of
the shared folder names.

Equal payloads (same length, SHA-1 and SHA-256) of LEAST_REVISIT bytes or more are stored once, by the page with the
largest id; the others become revisit records, whose block is the HTTP header alone.

Defined results: a null payload is empty; empty and short payloads are always responses; a page without an id is never
a revisit and no other refers to it; of rows that repeat the largest id each is a response; a null address gives no
target address. An empty table gives no archive and no record. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MAGIC = 0x184D2A5D
LEAST_REVISIT = 1000
#: Payload bytes after which a writer closes its archive: what it holds in memory.
ARCHIVE_BYTES = 32 << 20
DICT_BYTES = 64 << 10
#: A dictionary is built from records of up to this many bytes, evenly spread over the archive; a longer record gives its head.
DICT_SAMPLE = 64 * DICT_BYTES
SAMPLE_HEAD = 32 << 10
LEVEL = 3
#: Fixed, as the archives carry no clock: equal tables give equal archives.
DATE = "2024-01-01T00:00:00Z"
SALTS = 64


# ---- records ---------------------------------------------------------------------------------------------------


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def _address(url: str) -> str:
    return urllib.parse.quote(url, safe="".join(map(chr, range(33, 127))))


def build_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int | None = None) -> bytes:
    """One record. A revisit (refers_to given) leaves the payload out; size is then that of the payload, which needn't be
    there."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if size is None else size)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {_address(url)}")
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Header fields in lower case, and the payload (empty in a revisit). Raises ValueError if lengths or the digest of
    a response don't agree."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    n = int(fields["content-length"])
    if not first.startswith("WARC/1.") or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record is cut short or malformed")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    fields["payload-length"] = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    if fields["warc-type"] == "response" and (len(payload) != fields["payload-length"] or "sha1:" + hashlib.sha1(payload).hexdigest() != fields["warc-payload-digest"]):
        raise ValueError("a payload doesn't agree with its digest")
    return fields | {"payload": payload}


# ---- archives --------------------------------------------------------------------------------------------------


def build_dictionary(records: list[bytes]):
    """A dictionary of records spread over the list, or None where there is too little to learn from."""
    import zstandard

    step = max(1, -(-sum(min(len(r), SAMPLE_HEAD) for r in records) // DICT_SAMPLE))
    sample = [r[:SAMPLE_HEAD] for r in records[::step]]
    total = sum(map(len, sample))
    if len(sample) < 8 or total < 8 << 10:
        return None
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1 << 10, total // 8)), sample, d=8, k=256, steps=1)
    except zstandard.ZstdError:  # e.g. records too alike to fill a dictionary; the archive goes without one
        return None


def write_archive(out, records: list[bytes]) -> list[int]:
    """Writes an archive to a binary file; the offset of each record."""
    import zstandard

    trained = build_dictionary(records)
    at, offsets = 0, []
    if trained is not None:
        frame = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
        out.write(struct.pack("<II", MAGIC, len(frame)) + frame)
        at = 8 + len(frame)
    one = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True) if trained is not None else zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
    for r in records:
        frame = one.compress(r)
        offsets.append(at)
        out.write(frame)
        at += len(frame)
    return offsets


def read_archive(source) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zstandard

    head = source.read(8)
    trained, rest = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == MAGIC:
        raw = source.read(struct.unpack("<I", head[4:])[0])
        trained, rest = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw)), b""
    opener = zstandard.ZstdDecompressor(dict_data=trained) if trained is not None else zstandard.ZstdDecompressor()
    while True:
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            data = rest or source.read(1 << 18)
            if not data:
                if parts or rest:
                    raise ValueError("an archive ends within a record")
                return
            parts.append(frame.decompress(data))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def _write_partition(folder: str):
    import pyarrow as pa

    def run(batches):
        C.worker_for("warc", lambda: None)
        store, base = C.store(folder)
        store.create_dir(base, recursive=True)

        def close(records):
            name = f"{uuid.uuid4().hex}.warc.zst"
            held = io.BytesIO()
            write_archive(held, records)
            with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(held.getbuffer())
            return name, len(records), held.tell()

        done, records, size = [], [], 0
        for whole in batches:
            for batch in C.slices(whole):
                urls, sizes, digests, refs = (batch[k].to_pylist() for k in ("url", "_n", "payload_digest", "refers_to"))
                for page, url, raw, n, digest, ref in zip(batch["page_id"].to_pylist(), urls, C.text_bytes(batch["html"]), sizes, digests, refs, strict=True):
                    records.append(build_record(page, url, raw, digest, ref, n))
                    size += len(records[-1])
                    if size >= ARCHIVE_BYTES:
                        done.append(close(records))
                        records, size = [], 0
        if records:
            done.append(close(records))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "n_records", "n_bytes"])

    return run


def archive_pages(pages: DataFrame, folder: str, scratch: C.Scratch) -> DataFrame:
    """Writes the archives of pages (page_id, url, html) below a folder URI; (archive, n_records, n_bytes) of each."""
    p = C.with_row_id(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), scratch)
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    signs = p.select("_row", "page_id", F.octet_length(raw).cast("long").alias("_n"), F.sha1(raw).alias("_sha1"), F.sha2(raw, 256).alias("_sha256"))
    keys = ["_n", "_sha1", "_sha256"]
    signs = scratch.keep(signs.filter((F.col("_n") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS))), "signs")
    part = signs.groupBy(*keys, "_salt").agg(F.max("page_id").alias("_of"), F.count(F.lit(1)).alias("_c"))
    classes = part.groupBy(*keys).agg(F.max("_of").alias("_of"), F.sum("_c").alias("_c")).filter("_c > 1")
    wide = scratch.keep(part.select(*keys, "_salt").join(classes.select(*keys, "_of"), keys), "classes")
    revisits = scratch.keep(signs.join(wide, [*keys, "_salt"]).filter("page_id < _of").select("_row", F.col("_of").alias("refers_to")), "revisits")
    # of pages that are revisits, all but the payload is shuffled; no payload is
    p = p.withColumn("_n", F.octet_length(raw).cast("long")).withColumn("payload_digest", F.sha1(raw))
    again, first = C.split_rows(p, revisits, scratch)
    cols = ["page_id", "url", "html", "_n", "payload_digest", "refers_to"]
    other = again.select("_row", "page_id", "url", "_n", "payload_digest").join(revisits, "_row").withColumn("html", F.lit(None).cast("string"))
    both = first.withColumn("refers_to", F.lit(None).cast("long")).select(*cols).unionByName(other.select(*cols))
    return scratch.keep(both.mapInArrow(_write_partition(folder), "archive string, n_records long, n_bytes long"), "archives")


def _read_partition(folder: str):
    import pyarrow as pa

    def run(batches):
        store, base = C.store(folder)
        for batch in batches:
            for name in batch["archive"].to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for x in map(parse_record, read_archive(f)):
                        page, ref = x.get("x-page-id"), x.get("x-refers-to-page-id")
                        rows.append((page and int(page), x["payload-length"], x["warc-payload-digest"].removeprefix("sha1:"), x["warc-type"], ref and int(ref), x.get("warc-target-uri"), x["payload"] if x["warc-type"] == "response" else None))
                        held += len(x["payload"])
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    def pack(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload"])

    return run


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, payload) of each record of the
    archives that the table names; the payload of a revisit is null. Each payload is held against its digest. Tasks are
    as many as the archives' bytes ask for, at least as many as there are cores, if there are that many archives."""
    there = archives.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("size")).collect()[0]
    tasks = min(there.n, max(archives.sparkSession.sparkContext.defaultParallelism, -(-there.size // ARCHIVE_BYTES)))
    dealt = archives.select("archive").repartition(max(1, tasks))
    return dealt.mapInArrow(_read_partition(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    scratch = C.Scratch(spark, "op1")
    folder = f"{scratch.path}/warc"
    archives = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder, scratch)
    return read_archives(archives, folder).drop("target_uri", "payload")


OP1_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, coalesce(html, '') AS h FROM pages),
     g AS (SELECT h, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""
