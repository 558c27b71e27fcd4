"""WARC archives: a writer with payload deduplication and a splittable reader.

Writing.  Each page becomes one WARC record in a gzip member of its own.  Of
records with equal payloads of at least `MIN_REVISIT` bytes, the one with the
smallest id is a response; the others are revisits that name it and carry no
payload.  Files go through Spark's own writer, so any store that Spark can write
holds them.  That writer puts a separator after every row; a zero byte serves,
since a gzip member of less than 16 MB ends with one: the member is written
without its last byte and the separator completes it.  (Larger members are
followed by one byte of zero padding, which gzip readers skip.)  The files are then
renamed to *.warc.gz.

Reading.  Spark splits a file into byte ranges, whatever its name (`UNDECODED`).  Inside its range a task scans for
the gzip magic and owns the members that start there, reading past the range's end
to finish the last one.  Compressed data can hold the magic by chance, so a
candidate counts only if its header decodes and its first inflated bytes open a WARC
record; otherwise its bytes belong to the member before it.  If chance puts such a
false start at the edge of a range, the pieces meet in a second step that joins
the few fragments by file and order.

Defined results: a null payload is an empty one; null urls are left out; rows of
one id with equal payloads are all responses if that id is the smallest; a null id
revisits the smallest known id, or is a response if there is none; an empty
table writes an empty archive, which reads as no records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findspar.llm._frames import narrow, shared_path, written

MIN_REVISIT = 100
MAGIC = b"\x1f\x8b\x08"
LEVEL = 4
#: Keeps Spark's text source from decompressing *.gz, which it could not split.  Hadoop looks for the codec under the
#: greatest registered suffix, read backwards, that sorts before the file's name: for "x.gz" that is now ".!.gz", which
#: doesn't fit, so no codec is used.  The option has two names, since Spark's Hadoop is shaded.
UNDECODED = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec"} | {f"{x}io.compress.passthrough.extension": ".!.gz" for x in ("", "org.apache.hadoop.shaded.")}
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length bigint, payload binary, valid boolean"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record's bytes, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def compress(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def inflate(member: bytes, limit: int = 0) -> tuple[bytes, bool] | None:
    """(what the member holds, whether it's complete), or None if it isn't gzip; at most `limit` bytes if given."""
    reader = zlib.decompressobj(31)
    try:
        out = reader.decompress(member, limit) if limit else reader.decompress(member)
    except zlib.error:
        return None
    return out, reader.eof


def opens_record(member: bytes) -> bool:
    """Whether the bytes start a gzip member whose contents start a WARC record."""
    if len(member) > 3 and member[3] & 0xE0:  # reserved flags
        return False
    got = inflate(member[:4096], 8)
    return got is not None and got[0].startswith(b"WARC/")


def undecided(member: bytes) -> bool:
    """Whether the bytes are too few to tell if they start a record: chance can put a magic among a member's first bytes."""
    if len(member) >= 4096 or (len(member) > 3 and member[3] & 0xE0):
        return False
    got = inflate(member, 8)
    return got is not None and not got[1] and len(got[0]) < 5 and b"WARC/".startswith(got[0])


def sorted_out(held: list[bytes], piece: bytes) -> list[tuple[bytes, bool]]:
    """What is known with one more piece, in order: (bytes, whether they start a record); `held` keeps the pieces that aren't decided."""
    held.append(piece)
    for i in range(len(held)):
        start = b"".join(held[i:])
        if opens_record(start):
            out = [*((x, False) for x in held[:i]), (start, True)]
            held.clear()
            return out
    out = []
    while held and not undecided(b"".join(held)):
        out.append((held.pop(0), False))
    return out


def parse(data: bytes) -> tuple:
    """The fields of RECORD from a record's bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    size = int(fields.get("content-length", 0))
    block = rest[:size]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x[15:]) for x in http.decode("latin-1").lower().split("\r\n") if x.startswith("content-length:")), len(payload))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    kind = fields.get("warc-type")
    whole = len(block) == size and rest[size:] == b"\r\n\r\n"
    if kind == "response":
        whole &= len(payload) == length and hashlib.sha256(payload).hexdigest() == digest
    return fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, length, None if kind == "revisit" else payload, whole


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Archive files (one per task, *.warc.gz) below `path`."""
    rows = narrow(pages, page_id=page_id, url=url, html=html).withColumn("html", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    first = rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first")
    # one row per repeated payload; if a payload is very common, adaptive execution splits the pages' side
    marked = rows.join(first, F.col("digest") == F.col("of"), "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                page, address, payload, digest, refers = (batch.column(k)[i].as_py() for k in range(5))
                member = compress(record(page, address, payload, digest, refers))
                out.append(member[:-1] if member[-1] == 0 else member)
                size += len(member)
                if size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    packed = marked.select(F.col("page_id").cast("string"), "url", "html", "digest", F.col("refers_to").cast("string")).mapInArrow(pack, "member binary")
    packed.select(F.col("member").cast("string")).write.option("lineSep", "\0").text(path)
    spark = pages.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-") and not store.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, f"{name.removesuffix('.txt')}.warc.gz")):
            raise OSError(f"cannot rename {name} in {path}")


SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary()), ("valid", pa.bool_())])
FRAGMENT = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("fragment", pa.binary())])


def _table(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SCHEMA)]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Whole records (RECORD), and rows with the fragments of those that a false start cut at a range's edge."""
    # lines between magics: Spark's text source scans byte ranges for the separator and finishes a range's last line beyond it
    lines = spark.read.options(**UNDECODED).option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    lines = lines.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, member, seq, held = None, None, 0, 0
        short: list[bytes] = []
        rows: list[tuple] = []
        loose: list[tuple] = []

        def close() -> None:
            nonlocal member, held
            if member is not None:
                got = inflate(member)
                held += len(got[0]) if got else len(member)
                if got and got[1]:
                    rows.append(parse(got[0]))
                else:
                    loose.append((*where, seq, member))
                member = None

        def leave() -> None:
            """The end of a range; what isn't decided there is for the second step, as is a member that it might belong to."""
            nonlocal seq
            close()
            for x in short:
                seq += 1
                loose.append((*where, seq, x))
            short.clear()

        def emit() -> pa.RecordBatch:
            nonlocal held
            held = 0
            made = pa.RecordBatch.from_arrays([*[pa.concat_arrays([a, pa.nulls(len(loose), a.type)]) for a in _table(rows)], *[pa.concat_arrays([pa.nulls(len(rows), f.type), pa.array([x[i] for x in loose], f.type)]) for i, f in enumerate(FRAGMENT)]], names=[*SCHEMA.names, *FRAGMENT.names])
            rows.clear()
            loose.clear()
            return made

        for batch in batches:
            for i in range(batch.num_rows):
                at = (batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                piece = batch.column(0)[i].as_py()
                opening = at != where
                if opening:
                    leave()
                    where, seq = at, 0
                    if at[1] == 0:  # what stands before a file's first magic isn't a member
                        if piece.startswith(b"WARC/") and at[0].lower().endswith(".gz"):
                            raise ValueError(f"{at[0]} was decompressed before it got here")
                        continue
                for part, opens in sorted_out(short, MAGIC + piece):
                    if opens:
                        close()
                        member = part
                        seq += 1
                    elif member is not None:
                        member += part
                    else:  # the member that this continues starts in an earlier range
                        seq += 1
                        loose.append((*where, seq, part))
                if held > 16 << 20:
                    yield emit()
        leave()
        yield emit()

    names = ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'binary' if f.type == pa.binary() else 'string'}" for f in FRAGMENT)
    return lines.mapInArrow(run, f"{RECORD}, {names}")


def rejoined(fragments: DataFrame) -> DataFrame:
    """The records of fragments (FRAGMENT): very few rows, since chance makes some false starts in every 100 MB, and few of them at an edge."""

    def run(group: pa.Table) -> pa.Table:
        found, member, short = [], None, []
        parts = sorted((r["block"], r["seq"], r["fragment"]) for r in group.to_pylist())
        known = [x for _, _, part in parts for x in sorted_out(short, part)]
        for part, opens in [*known, *((x, False) for x in short), (None, True)]:
            if opens:
                if member is not None:
                    got = inflate(member)
                    found.append(parse(got[0]) if got and got[1] else (None, None, None, None, None, None, None, False))
                member = part
            elif member is not None:
                member += part
        return pa.Table.from_arrays(_table(found), schema=SCHEMA)

    return fragments.select(*FRAGMENT.names).groupBy("file").applyInArrow(run, RECORD)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records (RECORD) of all gzip-compressed archives below `path`."""
    scanned = scan(spark, path)  # runs twice: that costs less than keeping all payloads
    return scanned.where("fragment is null").select(*SCHEMA.names).unionByName(rejoined(scanned.where("fragment is not null")))


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from archives in the shared folder."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path, page_id, url, html)
    kind = dict(pages.dtypes)[page_id]

    def page(column: str) -> F.Column:
        return F.nullif(F.regexp_extract(column, "^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)

    def digested(records: DataFrame) -> DataFrame:
        whole = F.col("payload").isNotNull()
        return records.select(
            page("record_id").alias("page_id"), F.when(whole, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("bigint").alias("payload_bytes"),
            F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"),
            *[c for c in FRAGMENT.names if c in records.columns],
        )

    scanned = written(digested(scan(pages.sparkSession, path)), "warc-read")  # narrow: payloads have become digests
    records, fragments = scanned.where("fragment is null").drop(*FRAGMENT.names), scanned.where("fragment is not null")
    return records if fragments.isEmpty() else records.unionByName(digested(rejoined(fragments)))


SQL = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
