"""WARC archives (operator 1): writing captures as gzip members, reading records, assembling transactions.

A capture is a request, a response (or a revisit of an earlier response with the same payload) and a metadata record.
The three are separate records; concurrent-to identifiers say which belong together.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import filesystem, shared_dir, stored

#: Payloads of fewer bytes are always stored, as a revisit would be no shorter.
REVISIT_BYTES = 100
#: Compressed bytes of an archive after which the writer begins a new one.
ARCHIVE_BYTES = 1 << 26
#: Equal rows of which one task writes at most so many.
EQUAL_ROWS = 1 << 12
#: Pages have no time of capture; records need one.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIRST_COPY = "0"
NAMESPACE = uuid.UUID("5d0f7b0e-6c7f-4f0e-9a51-3f6d6f1f2a10")

RECORD = "record_id string, type string, concurrent_to array<string>, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def roles(pages: DataFrame) -> DataFrame:
    """page_id, digest, rows (pages of both), first: the smallest page_id of the payload, null if it is too short to be
    shared.

    Rows without page_id come after all others: they revisit if any page with an id has their payload.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    narrow = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))
    firsts = narrow.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    return narrow.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("rows")).join(firsts, "digest", "left")


def _record(kind: str, record_id: str, uri: str, headers: list[tuple[str, str]], content_type: str, block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), *headers, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in lines), b"\r\n", block, b"\r\n\r\n"])


def _id(page_id: int | None, digest: str, copy: str, kind: str) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}|{digest}|{copy}|{kind}')}"


def capture_records(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, copy: str) -> list[bytes]:
    """The three records of a page. `copy` tells rows of one page and payload apart, FIRST_COPY is the one that revisits
    name; `first` is the page whose payload this one repeats."""
    # Header lines cannot hold control characters or blanks.
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or f"urn:page:{page_id}")
    kind = "response" if first is None or first == page_id else "revisit"
    main = _id(page_id, digest, copy, "main")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Payload-Digest", f"sha256:{digest}")]
    if kind == "revisit":
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_id(first, digest, FIRST_COPY, 'main')}>")]
    concurrent = [("WARC-Concurrent-To", f"<{main}>")]
    scheme, _, rest = uri.partition("://")
    host, slash, path = rest.partition("/")
    request = f"GET {slash}{path or '/' * (not slash)} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    fields = (f"page-id: {page_id}\r\n" if page_id is not None else "").encode()
    return [
        _record("request", _id(page_id, digest, copy, "request"), uri, concurrent, "application/http; msgtype=request", request),
        _record(kind, main, uri, headers, "application/http; msgtype=response", http + (payload if kind == "response" else b"")),
        _record("metadata", _id(page_id, digest, copy, "metadata"), uri, concurrent, "application/warc-fields", fields),
    ]


def _numbered(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows of pages whose page_id and payload occur in several rows, equal ones once with their number `times` and a
    `label` for the copies: FIRST_COPY for one group of each page and payload, else the digest of the url.

    A page that a third of all rows repeat is counted where its rows are, then written in groups of EQUAL_ROWS.
    """
    r = repeated.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "first")
    # Written before it is grouped: the join can then split a hot page, and equal rows are added up in each task.
    found = stored(pages.join(r, pages.page_id.eqNullSafe(r.r_page) & (pages.digest == r.r_digest)).select("page_id", "url", "html", "digest", "first"), "warc-repeated")
    once = found.groupBy("page_id", "digest", "first", "url").agg(F.count(F.lit(1)).alias("rows"), F.max("html").alias("html"))
    least = once.groupBy(F.col("page_id").alias("l_page"), F.col("digest").alias("l_digest")).agg(F.min(F.struct("url")).alias("least"))
    joined = once.join(least, once.page_id.eqNullSafe(least.l_page) & (once.digest == least.l_digest))
    label = F.when(F.col("url").eqNullSafe(F.col("least.url")), F.lit(FIRST_COPY)).otherwise(F.sha2(F.coalesce(F.concat(F.lit("="), "url"), F.lit("")).cast("binary"), 256))
    group = F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / EQUAL_ROWS)))
    dealt = joined.withColumn("label", label).select("page_id", "url", "html", "digest", "first", "label", "rows", group.alias("group")).repartition("page_id", "digest", "url", "group")
    return dealt.select("page_id", "url", "html", "digest", "first", "label", (F.col("group") * EQUAL_ROWS).alias("from"), F.least(F.lit(EQUAL_ROWS), F.col("rows") - F.col("group") * EQUAL_ROWS).alias("times"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every page (page_id, url, html) as records and returns the archives: path, n_records.

    A null html is an empty payload. Equal rows are each written, with records of their own. Only the archives of the
    attempt that succeeded are in the returned table, so a retried task leaves no doubled record. Other columns are not
    read.
    """
    digest = F.sha2(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary"), 256)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    role = stored(roles(own), "warc-roles")
    wide = own.withColumn("digest", digest)
    # By page and payload: a payload that a third of all pages share is spread over all tasks.
    single = role.where("rows = 1").select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "first")
    joined = wide.join(single, wide.page_id.eqNullSafe(single.r_page) & (wide.digest == single.r_digest)).select("page_id", "url", "html", "digest", "first", F.lit(FIRST_COPY).alias("label"), F.lit(0).cast("long").alias("from"), F.lit(1).cast("long").alias("times"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, path, n = None, "", 0
        for batch in batches:
            for page_id, url, html, digest, first, label, begin, times in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first", "label", "from", "times"))):
                for k in range(begin, begin + times):
                    if out is None:
                        path, n = f"{root}/pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(path)
                    for record in capture_records(page_id, url, (html or "").encode(), digest, first, f"{label}.{k}" if k else label):
                        gz = zlib.compressobj(4, zlib.DEFLATED, 31)
                        out.write(gz.compress(record) + gz.flush())
                        n += 1
                    if out.tell() >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_records"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_records"])

    schema = "path string, n_records long"
    written = stored(joined.mapInArrow(write, schema), "warc-archives")
    repeated = role.where("rows > 1")
    if repeated.isEmpty():
        return written
    return written.union(stored(_numbered(wide, repeated).mapInArrow(write, schema), "warc-archives"))


def members(file, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Decompressed gzip members of a file, one after another; one record is held at a time."""
    rest, parts, gz = b"", [], None
    while True:
        data = rest or file.read(chunk)
        rest = b""
        if not data:
            if gz is not None:
                raise ValueError("the archive ends inside a record")
            return
        gz = gz or zlib.decompressobj(31)
        parts.append(gz.decompress(data))
        if gz.eof:
            rest = gz.unused_data
            yield b"".join(parts)
            parts, gz = [], None


def parse(record: bytes, with_payload: bool) -> dict:
    """A record as a row. The payload's digest and length are of the bytes read, for a revisit those its headers give."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers: dict[str, list[str]] = {}
    for line in lines:
        k, _, v = line.partition(":")
        headers.setdefault(k.lower(), []).append(v.strip())
    get = lambda k: headers.get(k, [None])[0]
    bare = lambda v: v and v.strip("<>")
    block = rest[: int(get("content-length") or 0)]
    kind = get("warc-type")
    row = dict(record_id=bare(get("warc-record-id")), type=kind, concurrent_to=[bare(v) for v in headers.get("warc-concurrent-to", [])], target_uri=get("warc-target-uri"), date=get("warc-date"), refers_to=bare(get("warc-refers-to")), payload_digest=None, payload_bytes=None, fields=None, payload=None)
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            row |= dict(payload_digest=hashlib.sha256(payload).hexdigest(), payload_bytes=len(payload), payload=payload if with_payload else None)
        else:
            said = [line.partition(":")[2] for line in http.decode("latin-1").split("\r\n") if line.lower().startswith("content-length:")]
            row |= dict(payload_digest=(get("warc-payload-digest") or "").rpartition(":")[2] or None, payload_bytes=int(said[0]) if said else None)
    elif kind == "metadata":
        pairs = (line.partition(":")[::2] for line in block.decode("utf-8", "replace").split("\r\n") if ":" in line)
        row["fields"] = [(k.strip(), v.strip()) for k, v in pairs]
    return row


def read_records(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives; each archive is one task's, each record is held alone."""
    arrow = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, inside = filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(inside) as file:
                    for record in members(file):
                        rows.append(parse(record, with_payload))
                        held += len(record) if with_payload else 512
                        if held >= 1 << 23:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return archives.select("path").repartition(max(1, min(archives.count(), 1 << 16)), "path").mapInArrow(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, target_uri, date, main (response or revisit), requests, metadata.

    A request or metadata record belongs to the capture that its concurrent-to names, or that names it, directly or
    through one other record of the capture. Records that lead to no response are captures of their own with a null
    main. Records of one identifier count once, the least of them by content.
    """
    side = F.col("type").isin("request", "metadata")
    mains = records.where(F.col("type").isin("response", "revisit"))
    links = records.select("record_id", "type", F.explode("concurrent_to").alias("to"))
    ids = mains.select(F.col("record_id").alias("capture")).distinct()
    direct = links.where(side).join(ids, F.col("to") == F.col("capture")).select("record_id", "capture")
    reverse = links.where(~side).join(ids, F.col("record_id") == F.col("capture")).select(F.col("to").alias("record_id"), "capture")
    known = direct.union(reverse).distinct()
    over = known.select(F.col("record_id").alias("to"), "capture")
    hop = links.where(side).join(over, "to").select("record_id", "capture")
    place = known.union(hop).groupBy("record_id").agg(F.min("capture").alias("capture"))
    sides = records.where(side).select("record_id", "type", "target_uri", "date", "fields").join(place, "record_id", "left").withColumn("capture", F.coalesce("capture", "record_id"))
    request = F.when(F.col("type") == "request", F.struct("record_id", "target_uri", "date"))
    metadata = F.when(F.col("type") == "metadata", F.struct("record_id", F.map_entries("fields").alias("fields")))
    # A capture has few records; the collected sets drop repeated ones.
    around = sides.groupBy(F.col("capture").alias("s_id")).agg(F.array_sort(F.collect_set(request)).alias("requests"), F.array_sort(F.collect_set(metadata)).alias("metadata"), F.min("target_uri").alias("s_uri"), F.min("date").alias("s_date"))
    one = mains.groupBy("record_id").agg(F.min(F.struct("type", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload")).alias("main"))
    joined = one.join(around, F.col("record_id") == F.col("s_id"), "full_outer")
    return joined.select(F.coalesce("record_id", "s_id").alias("capture_id"), F.coalesce("main.target_uri", "s_uri").alias("target_uri"), F.coalesce("main.date", "s_date").alias("date"), "main", "requests", "metadata")


def page_transactions(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes all pages, reads the archives back and gives one row per page: page_id, payload_bytes, payload_digest,
    record_type, refers_to (page_id of the response that a revisit repeats)."""
    archives = write_archives(pages, folder or shared_dir(pages.sparkSession, "warc"))
    # Several joins read the records: they are parsed once, and joins see their true size.
    captures = assemble(stored(read_records(archives, with_payload=False), "warc-records"))
    field = F.get(F.filter(F.get("metadata", F.lit(0))["fields"], lambda f: f["key"] == "page-id"), F.lit(0))["value"].cast("long")
    rows = stored(captures.where("main is not null").select("capture_id", field.alias("page_id"), "main.payload_bytes", "main.payload_digest", F.col("main.type").alias("record_type"), F.col("main.refers_to").alias("to")), "warc-captures")
    # Revisited responses only: the aggregate leaves one row for each, however many revisit it.
    targets = rows.where("record_type = 'revisit'").select("to").distinct().join(rows.where("record_type = 'response'").select(F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to")), "to")
    return rows.join(targets, "to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
