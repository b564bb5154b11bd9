"""WARC archives of web pages: writing with segmented and chunked records, and reading them back.

Writing turns each page into one WARC record whose block is an HTTP response with its body in chunked transfer framing;
a block longer than ``SEGMENT_BYTES`` is split into a first record and continuation records, which carry the segment
number and the first record's id as their origin; the last also carries the total length. Each record is a gzip member
of its own, and archives of about ``ARCHIVE_BYTES`` are rows (name, content) of a table in the shared folder, so any
store that Spark can write holds them. A segment is dealt to an archive apart from its record's other segments.

Reading parses every archive, groups continuations with the record they name, orders them by segment number, checks that
none is missing and that their length is the total, and only then decodes the chunked body, whose SHA-1 must be the one
in the header. Whole records need no grouping; only segments are shuffled, by their record's id. What is broken stops the
job, or, with ``quarantine``, is kept as a row with an error and no content.

Payloads of ``MIN_REVISIT`` bytes or more that are equal are kept once: the largest page_id has the response, the others
are revisits without a body that name it. The reader finds a revisit's length and digest through the record it names.

A null html is an empty payload. Rows that repeat a page_id and html are records of their own with the same role; rows
with a null page_id are written, and are never a response that others refer to unless no other page has the payload.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terradelta.llm.shared import cut, salted_join, shared_folder

MIN_REVISIT = 1000
SEGMENT_BYTES = 8 << 10
CHUNK_BYTES = 1 << 10
ARCHIVE_BYTES = 4 << 20
#: Up to so many pages' roles (about 100 bytes each) are sent to tasks; more are joined by a shuffle.
SENT_ROLES = 100_000

_HEAD = "record_id string, page_id long, url string, kind string, refers_to string, digest string, segment int, origin string, total long, block binary"


def roles(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, record_id, refers_to): refers_to is null for responses.

    Payloads are compared by SHA-256 and length; only digests are grouped, with counts combined before the shuffle.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", F.sha2(body, 256).alias("sha"), F.length(body).alias("size"))
    ids = cut(own.select("page_id", "sha", "size"))
    first = ids.where(F.col("size") >= min_revisit).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    first = cut(first)
    # a payload that many pages share is one key
    shared = salted_join(ids, first.select("sha", "keeper"), "sha", "page_id", first.select("sha", "n")).select("page_id", "sha", "keeper").dropDuplicates(["page_id", "sha"])
    repeats = cut(ids.groupBy("page_id", "sha").agg(F.count("*").alias("n")).where("n > 1"))
    listed = shared.unionByName(repeats, allowMissingColumns=True)
    special = cut(listed.groupBy("page_id", "sha").agg(F.max("keeper").alias("keeper"), F.max("n").alias("n")))
    # Pages that share their payload or repeat a row; few are sent to the tasks, so that no html is shuffled.
    known = special.select(F.col("page_id").alias("k_page"), F.col("sha").alias("k_sha"), "keeper", "n")
    known = F.broadcast(known) if special.count() <= SENT_ROLES else known
    named = own.join(known, F.col("page_id").eqNullSafe(F.col("k_page")) & (F.col("sha") == F.col("k_sha")), "left")

    def record(page, copy):
        return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.substring("sha", 1, 16), F.lit(":"), copy.cast("string"))

    if repeats.isEmpty():
        numbered = named.withColumn("copy", F.lit(1))
    else:
        nth = F.row_number().over(Window.partitionBy("page_id", "sha").orderBy("url"))  # a page's repeats only
        numbered = named.where("n IS NULL").withColumn("copy", F.lit(1)).unionByName(named.where("n IS NOT NULL").withColumn("copy", nth))
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), record(F.col("keeper"), F.lit(1)))
    return numbered.select("page_id", "url", "html", record(F.col("page_id"), F.col("copy")).alias("record_id"), refers.alias("refers_to"))


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A body in HTTP's chunked transfer framing."""
    out = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(raw: bytes) -> bytes:
    """The body that chunked framing holds; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = raw.index(b"\r\n", at)
        size = int(raw[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if raw[at + size : at + size + 2] != b"\r\n":
            raise ValueError(f"chunk of {size} bytes at {at} does not end there")
        out.append(raw[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def records_of(page_id: int | None, url: str | None, html: str | None, record_id: str, refers_to: str | None, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The record of a page, and its continuations if it is long."""
    body = (html or "").encode("utf-8")
    digest = hashlib.sha1(body).hexdigest()
    base = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", " ".join((url or "").split())), ("X-Page-Id", "" if page_id is None else str(page_id)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to:
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *base], http)]
    block = http + chunked(body)
    if len(block) <= segment:
        return [record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), *base], block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Segment-Number", "1"), *base], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{k}>"), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(k)), *total], part))
    return out


def archives(named: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(name, content): gzip-compressed WARC files of the rows of ``roles``; two open files a task take turns with the
    segments, so that those of one record are parted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [io.BytesIO(), io.BytesIO()]

        def close(f: io.BytesIO) -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([f"pages-{uuid.uuid4().hex}.warc.gz"]), pa.array([f.getvalue()], pa.binary())], ["name", "content"])
            f.seek(0)
            f.truncate()
            return done

        for b in batches:
            for i in range(b.num_rows):
                row = [b.column(k)[i].as_py() for k in range(5)]
                for k, raw in enumerate(records_of(*row)):
                    f = files[k % 2]
                    f.write(gzip.compress(raw, 1, mtime=0))
                    if f.tell() >= archive_bytes:
                        yield close(f)
        for f in files:
            if f.tell():
                yield close(f)

    return named.select("page_id", "url", "html", "record_id", "refers_to").mapInArrow(run, "name string, content binary")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = f.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError("an archive ends inside a record")
        yield headers, block


def read_records(files: DataFrame) -> DataFrame:
    """All records of the archives, segments apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _HEAD.split(", ")]
        kinds = {"segment": pa.int32(), "page_id": pa.int64(), "total": pa.int64(), "block": pa.binary()}

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names)

        number = lambda x: int(x) if x else None
        bare = lambda x: x.strip("<>") if x else None
        for b in batches:
            for raw in b.column("content"):
                rows = []
                for h, block in parse(raw.as_py()):
                    rows.append((bare(h["warc-record-id"]), number(h.get("x-page-id")), h.get("warc-target-uri"), h["warc-type"], bare(h.get("warc-refers-to")), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, number(h.get("warc-segment-number")), bare(h.get("warc-segment-origin-id")), number(h.get("warc-segment-total-length")), block))
                    if len(rows) == 256:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    return files.select("content").mapInArrow(run, _HEAD)


def reassemble(records: DataFrame, quarantine: bool = False) -> DataFrame:
    """Records whole again: (record_id, page_id, url, kind, refers_to, digest, block[, error]).

    Segments are grouped by origin and ordered by number. A record whose segments are not 1 to n, or whose length is not
    the total in its last segment, raises an error; with ``quarantine`` its row has an error and a null block instead.
    """
    keep = ["record_id", "page_id", "url", "kind", "refers_to", "digest"]
    whole = records.where(F.col("segment").isNull()).select(*keep, "block", *([F.lit(None).cast("string").alias("error")] if quarantine else []))
    parts = records.where(F.col("segment").isNotNull()).withColumn("origin", F.coalesce("origin", "record_id"))
    names, schema = whole.columns, whole.schema
    first = F.col("segment") == 1
    grouped = parts.groupBy("origin").agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in keep],
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a record at a time
                row = b.slice(i, 1)
                own = row.column("parts").flatten()
                numbers, pieces = own.field("segment").to_pylist(), own.field("block").to_pylist()
                total, size = row.column("total")[0].as_py(), sum(map(len, pieces))
                error = None
                if numbers != list(range(1, len(numbers) + 1)) or size != total:
                    error = f"segments missing or too short in record {row.column('origin')[0]}: {len(numbers)} segments of {size} bytes, {total} expected"
                    if not quarantine:
                        raise ValueError(error)
                block = [None if error else b"".join(pieces)]
                named = pa.array([row.column("origin")[0].as_py()], pa.string()) if error else row.column("record_id")
                yield pa.RecordBatch.from_arrays([named, *(row.column(c) for c in keep[1:]), pa.array(block, pa.binary()), *([pa.array([error], pa.string())] if quarantine else [])], names)

    return whole.unionByName(grouped.select("origin", *keep, "total", "parts").mapInArrow(run, schema))


def payloads(records: DataFrame, with_payload: bool = True, quarantine: bool = False) -> DataFrame:
    """(record_id, page_id, url, kind, refers_to, digest, payload_bytes[, payload][, error]) of whole records.

    A response's body is decoded from its framing and must have the digest of its header. A revisit has no body. With
    ``quarantine``, a record that cannot be decoded, or that came with an error, has that error and no payload.
    """
    out = "record_id string, page_id long, url string, kind string, refers_to string, digest string, payload_bytes long"
    out += ", payload binary" * with_payload + ", error string" * quarantine

    def body_of(digest: str | None, raw: bytes) -> bytes:
        head, _, body = raw.partition(b"\r\n\r\n")
        if b"transfer-encoding: chunked" in head.lower():
            body = unchunked(body)
        if hashlib.sha1(body).hexdigest() != digest:
            raise ValueError("a payload does not have its header's digest")
        return body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, bodies, errors = [], [], []
            known = b.column("error").to_pylist() if "error" in b.schema.names else [None] * b.num_rows
            for kind, digest, raw, error in zip(b.column("kind").to_pylist(), b.column("digest").to_pylist(), b.column("block"), known, strict=True):
                body = None
                if kind != "revisit" and not error:
                    try:
                        body = body_of(digest, raw.as_py())
                    except ValueError as e:
                        if not quarantine:
                            raise
                        error = str(e)
                sizes.append(None if body is None else len(body))
                bodies.append(body if with_payload else None)
                errors.append(error)
            columns = [b.column(c) for c in ("record_id", "page_id", "url", "kind", "refers_to", "digest")] + [pa.array(sizes, pa.int64())]
            columns += [pa.array(bodies, pa.binary())] * with_payload + [pa.array(errors, pa.string())] * quarantine
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in out.split(", ")])

    return records.mapInArrow(run, out)


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages' archives as a table in a shared folder and gives that table."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    archives(roles(pages)).write.parquet(folder)
    return spark.read.parquet(folder)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes and reads back: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id) of each page."""
    read = cut(payloads(reassemble(read_records(write_archives(pages))), with_payload=False))
    responses = read.where("kind = 'response'")
    revisits = read.where("kind = 'revisit'").select("page_id", "refers_to")
    counts = cut(revisits.groupBy("refers_to").agg(F.count("*").alias("n")))
    asked = counts.select(F.col("refers_to").alias("record_id"))
    named = responses.join(asked, "record_id", "left_semi").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("origin"), "payload_bytes", "digest")
    # every record that is asked for once, also one that no archive holds
    answers = counts.select("refers_to").join(named, "refers_to", "left")
    resolved = salted_join(revisits, answers, "refers_to", "page_id", counts).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("origin").alias("refers_to"))
    own = responses.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(resolved)
