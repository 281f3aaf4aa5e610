"""WARC archives: writing, and reading with reassembly of segmented records.

A page is a response record with its HTTP message (chunked transfer coding), or a revisit record where a
response with an equal payload stands elsewhere. A block of more than SEGMENT bytes is cut: the record has
segment number 1, continuation records name it as their origin, and the last one has the total length.
Files are written by Spark as texts whose lines end as records do, FILE_RECORDS records at most each, the first a
warcinfo; gzipped, a file is one member, as Spark's writer makes it. A page's number is in a header of its own
(X-Page-ID). The reader takes any archive in one pass; record identifiers are texts to it. Only segments are then grouped
by their origin (that of a first segment is its own identifier), put in order, checked against the total length and
joined; chunks are decoded. What is broken is a row with an error.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, lookup_join, map_batches, shared_dir, small_batches, spread_join, text_bytes, written

SEGMENT, CHUNK, FILE_RECORDS, MIN_REVISIT = 16_384, 4_096, 2_000, 1_000
#: The reader's batches hold about so many bytes of blocks, or one longer record.
BATCH_BYTES = 16 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2020-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The chunked transfer coding of a payload."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join([*(b"%x\r\n%b\r\n" % (len(p), p) for p in parts), b"0\r\n\r\n"])


def _chunks_joined(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n < 0:
            raise ValueError("a chunk of a negative length")
        if not n:
            return b"".join(out)
        if len(body) < end + 4 + n:
            raise ValueError("a chunk is cut short")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def _inflated_whole(body: bytes, wbits: int) -> bytes:
    d = zlib.decompressobj(wbits)
    try:
        out = d.decompress(body)
    except zlib.error as e:
        raise ValueError(str(e)) from None
    if not d.eof:
        raise ValueError("a compressed body is cut short")
    return out


#: Transfer codings, and how each is undone.
_CODINGS = {b"chunked": _chunks_joined, b"identity": bytes, b"gzip": lambda x: _inflated_whole(x, 31), b"x-gzip": lambda x: _inflated_whole(x, 31), b"deflate": lambda x: _inflated_whole(x, 15)}


def dechunked(message: bytes) -> bytes:
    """The payload of an HTTP message, without the transfer codings that its header names, the last one undone first. ValueError if it is cut short or of an unknown coding.

    Header fields are compared by their whole names; one like X-Crawl-Transfer-Encoding says nothing about the body.
    """
    head, gap, body = message.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("an HTTP message without an end of its header")
    fields = [line.partition(b":") for line in head.split(b"\r\n") if not line.startswith(b"HTTP/")]
    codings = [c.strip().lower() for name, _, v in fields if name.strip().lower() == b"transfer-encoding" for c in v.split(b",") if c.strip()]
    for coding in reversed(codings):
        undone = _CODINGS.get(coding.split(b";")[0].strip())
        if undone is None:
            raise ValueError(f"an unknown transfer coding {coding.decode('latin-1')}")
        body = undone(body)
    return body


def _name(page: int, sha1: str, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{sha1}:{segment}')}>"


def _record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}WARC-Date: {_DATE}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block


def info(name: str) -> bytes:
    """A file's first record."""
    return _record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")


def records_of(page: int, url: str, payload: bytes, refers_to: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """A page's record, in segments if it is long, each without the two line ends after it."""
    url = "".join(url.split()) or "about:blank"
    sha1 = hashlib.sha1(payload).hexdigest()
    fields: dict[str, object] = {"WARC-Record-ID": _name(page, sha1), "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{sha1}", "X-Page-ID": page}
    if refers_to is not None:
        yield _record("revisit", fields | {"WARC-Profile": _PROFILE, "WARC-Refers-To": _name(refers_to, sha1), "X-Refers-To-Page-ID": refers_to}, b"")
        return
    fields["Content-Type"] = "application/http; msgtype=response"
    block = _HTTP + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for k, part in enumerate(parts, 1):
        if len(parts) > 1:
            fields["WARC-Segment-Number"] = k
        if k > 1:
            fields |= {"WARC-Record-ID": _name(page, sha1, k), "WARC-Segment-Origin-ID": _name(page, sha1)}
            fields.pop("Content-Type", None)
            fields.pop("WARC-Payload-Digest", None)
            if k == len(parts):
                fields["WARC-Segment-Total-Length"] = len(block)
        yield _record("response" if k == 1 else "continuation", fields, part)


def plan(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, revisits (digest -> refers_to) of the pages (page_id, html) to be revisits: the largest page_id with an equal payload. A written table.

    Payloads are digested once. A page_id has more than one digest only if rows repeat it.
    """
    payload = F.coalesce("html", F.lit(""))
    slim = written(pages.filter(F.octet_length(payload) >= min_revisit).select("page_id", F.sha2(payload, 256).alias("digest")))
    often = written(slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("pages")).filter("pages > 1").select("digest", "refers_to"))
    again = spread_join(slim, often, ["digest"]).filter("refers_to <> page_id").distinct()
    return written(again.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("digest", "refers_to"))).alias("revisits")))


def write(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, segment: int = SEGMENT, compression: str = "gzip") -> None:
    """Writes pages (page_id, url, html) as WARC files, a record for each row.

    A null html is an empty payload, a null url about:blank; an html of any length is cut into segments. A null page_id counts as one below all
    others. Rows with equal page_id and different html are pages of their own; equal rows give equal records. Other
    columns are left out. No pages: no records.
    """
    small_batches(pages.sparkSession)
    pages = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"), "url", "html")
    # the few revisits go to the pages, not all pages to them
    rows = lookup_join(pages, plan(pages, min_revisit), "page_id", "left", F.size("revisits"))
    other = F.when(F.col("revisits").isNotNull(), F.try_element_at("revisits", F.sha2(F.coalesce("html", F.lit("")), 256)))
    rows = rows.select("page_id", "url", "html", other.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            out = []
            for i, url, html, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                for record in records_of(i, url or "", html, other, segment):
                    if n % FILE_RECORDS == 0:  # where Spark's writer begins a file
                        out.append(info(f"{i}:{n}"))
                        n += 1
                    out.append(record)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def unzipped(archive: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes without gzip (of one member or many), in blocks of at most `most` bytes. ValueError where it can't be read on."""
    at = 0
    if archive[:2] != b"\x1f\x8b":
        while at < len(archive):
            yield archive[at : at + most]
            at += most
        return
    view = memoryview(archive)
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        while not d.eof:
            given = d.unconsumed_tail or bytes(view[at : at + most])
            at += 0 if d.unconsumed_tail else len(given)
            if not given:
                raise ValueError("a gzip member is cut short")
            try:
                out = d.decompress(given, most)
            except zlib.error as e:
                raise ValueError(f"gzip: {e}") from None
            if out:
                yield out
        at -= len(d.unused_data)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """The header fields (names in lower case) and block of each record of a WARC file, gzipped or not; a last one with an error where it can't be read on.

    Besides the file, as it is stored, one record and one block of it are held.
    """
    held, blocks, at, broken = bytearray(), unzipped(archive), 0, None

    def more() -> bool:
        """Whether another block came."""
        nonlocal broken
        try:
            held.extend(next(blocks))
        except StopIteration:
            return False
        except ValueError as e:
            broken = str(e)
            return False
        return True

    def dropped(n: int) -> None:
        nonlocal at
        at += n
        del held[:n]

    while held or more():
        end, sought = -1, 0
        while (end := held.find(b"\r\n\r\n", sought)) < 0 and held[:5] == b"WARC/"[: len(held)]:
            sought = max(0, len(held) - 3)
            if not more():
                break
        first, *lines = bytes(held[: max(0, end)]).decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        if end < 0 or not first.startswith("WARC/"):
            yield {}, b"", broken or f"no WARC record at byte {at}"
            return
        if not fields.get("content-length", "").isdecimal():
            yield fields, b"", "a record without a length"
            return
        n = int(fields["content-length"])
        while len(held) < end + 4 + n and more():
            pass
        if len(held) < end + 4 + n:
            yield fields, b"", broken or "a record is cut short"
            return
        yield fields, bytes(held[end + 4 : end + 4 + n]), None
        while len(held) < end + 8 + n and more():
            pass
        dropped(min(len(held), end + 8 + n))
    if broken:
        yield {}, b"", broken


_TYPES = ("response", "resource", "revisit", "continuation")
_RECORDS = "file string, record_id string, record_type string, url string, page_id long, refers_to_id string, refers_to long, digest string, http boolean, origin string, segment int, total long, block binary, error string"
_KINDS = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string())


def _number(x: str | None) -> int | None:
    try:
        return None if x is None else int(x)
    except ValueError:
        return None


def _payload(block: bytes, http: bool) -> tuple[bytes | None, str | None]:
    """A block's payload, or what is wrong with it."""
    try:
        return dechunked(block) if http else block, None
    except ValueError as e:
        return None, f"HTTP: {e}"


def _rows_of(file: str, archive: bytes) -> Iterator[tuple]:
    for f, block, error in parse(archive):
        kind = f.get("warc-type")
        if error is None and kind not in _TYPES:
            continue
        segment, total, record = (f.get(f"warc-{x}") for x in ("segment-number", "segment-total-length", "record-id"))
        http = kind in ("response", "continuation") and f.get("content-type", "application/http").lower().startswith("application/http")
        if error is None and segment is None and kind == "response":
            block, error = _payload(block, http)
        if error is None and segment is not None and _number(segment) is None:
            error = "a segment without a number"
        origin = None if segment is None else f.get("warc-segment-origin-id", record)
        yield file, record, kind, f.get("warc-target-uri"), _number(f.get("x-page-id")), f.get("warc-refers-to"), _number(f.get("x-refers-to-page-id")), f.get("warc-payload-digest"), http, origin, _number(segment), _number(total), None if error else block, error


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    for batch in batches:
        for file, archive in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out, size = [], 0
            for row in _rows_of(file, archive.as_py()):
                out.append(row)
                size += len(row[-2] or b"")
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names)


def _join_segments(batch: pa.RecordBatch) -> pa.RecordBatch:
    payloads, errors = [], []
    for parts, total, http in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
        block = b"".join(p["block"] for p in parts)
        whole = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and len(block) == total
        payload, error = _payload(block, http) if whole else (None, f"{len(parts)} segments don't make up {total} bytes")
        payloads.append(payload)
        errors.append(error)
    return pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(payloads, pa.binary()), pa.array(errors, pa.string())], [*batch.schema.names[3:], "payload", "error"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, url, page_id, refers_to_id, refers_to, digest, payload (binary; null for a revisit), error of the records below path.

    Any WARC files, gzipped or not, with records of any identifiers; page_id and refers_to (a page's number) are
    null in those of others. Records of other types than response, resource, revisit and continuation are passed
    over. A record that can't be read (cut short, segments missing or of another total length, bad chunks) is a row with an error and
    without a payload; nothing after it in its file can be read if its own end is unknown. Records in segments are of the type of the
    first one (continuation if that is lost). A worker holds a file as it is stored and one record of it, not what it inflates to. A page_id that was null
    when written is null again. Equal segments of equal rows are counted, and each row comes back. No records: empty.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    records = written(files.mapInArrow(_records, _RECORDS))
    columns = ["record_id", "record_type", "url", "page_id", "refers_to_id", "refers_to", "digest", "payload", "error"]
    alone = F.col("origin").isNull() | F.col("error").isNotNull()
    whole = records.filter(alone).withColumn("payload", F.when(F.col("record_type") != "revisit", F.col("block"))).select(*columns)
    # equal segments count as one first, so that a group holds one record's segments
    segments = records.filter(~alone).groupBy("origin", "segment", "block").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("total", "http", "url", "page_id", "digest", "record_type")])
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c)))
    groups = segments.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"), F.coalesce(first("http"), F.lit(False)).alias("http"), *[first(c).alias(c) for c in ("record_type", "url", "page_id", "digest", "n")])
    schema = "record_id string, record_type string, url string, page_id long, digest string, n long, payload binary, error string"
    joined = map_batches(groups.select("parts", "total", "http", F.col("origin").alias("record_id"), F.coalesce("record_type", F.lit("continuation")).alias("record_type"), "url", "page_id", "digest", F.coalesce("n", F.lit(1)).alias("n")), _join_segments, schema)
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    none = lambda kind: F.lit(None).cast(kind)
    joined = joined.select("record_id", "record_type", "url", "page_id", none("string").alias("refers_to_id"), none("long").alias("refers_to"), "digest", "payload", "error")
    return whole.union(joined).withColumn("page_id", F.when(F.col("page_id") != NO_ID, F.col("page_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_warc: all pages, written to archives and read back; a revisit's payload is its response's."""
    path = shared_dir(spark)
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    measured = read(spark, path).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("payload").isNotNull(), F.sha1("payload")).alias("payload_digest"), "record_type", "refers_to", "digest", "error")
    rows = written(measured)
    bad = rows.filter("error IS NOT NULL OR (record_type = 'response' AND digest <> concat('sha1:', payload_digest))").limit(1).collect()
    if bad:
        raise ValueError(f"a record can't be read, or its payload hasn't its digest: {bad[0]}")
    out = rows.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    again = rows.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to", F.substring("digest", 6, 40).alias("payload_digest"))
    # the responses that are visited again, one for each payload
    origin = out.select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").join(again.select("refers_to", "payload_digest").distinct(), ["refers_to", "payload_digest"], "left_semi")
    again = spread_join(again, written(origin.distinct()), ["refers_to", "payload_digest"])
    return out.unionByName(again.select(*out.columns))


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, html, strlen(html)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND last <> page_id THEN last END AS refers_to
FROM r
"""
