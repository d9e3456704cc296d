"""WARC archives of pages as a chunked record table.

A payload is a run of rows (record, chunk number, text of bounded length): Spark cuts it up, a task sees one chunk at a time, and the
SHA-1 of the whole is carried from chunk to chunk. In the archive the first chunk is the record itself and each further one a
continuation record (segment number, identifier of the origin), so that every row of the table is one complete record. The text
sink writes them, with the end of a record as its line separator: on any file system, under Spark's commit protocol.

Reading turns archives back into such rows. Compressed archives are read as one stream each by the text source, and a small state
machine follows headers and lengths, handing on payloads in chunks and digests with the last of them. Only the chunks of records in
several segments are shuffled, to put them in order.

Of records with equal payloads one is a response; the others are revisits that refer to it and hold no payload.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cityflux.plans.scratch import fresh_path, materialize, measured_side

# Characters of a chunk; payloads of fewer bytes than LEAST are responses, each with its own copy.
CHUNK, LEAST = 1_000_000, 0
DATE = "2024-01-01T00:00:00Z"
# --- fixed values: the format ---------------------------------------------------------------
VERSION, END, LINE = "WARC/1.1", "\r\n\r\n", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
# Bytes of the longest header.
MOST_HEAD = 1 << 20
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# ---------------------------------------------------------------------------------------------


def _base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


# --- writing --------------------------------------------------------------------------------


def chunk_table(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(record, page_id, url, chunk, chunks, text, payload_bytes, payload_digest); the last two on the last chunk of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, size, sha1 = (TaskContext.get().partitionId() << 33) - 1, 0, hashlib.sha1()
        for batch in batches:
            records, sizes, digests = [], [], []
            for k, last, text in zip(batch.column("chunk").to_pylist(), batch.column("chunks").to_pylist(), batch.column("text").cast(pa.binary())):
                data = text.as_buffer() or b""
                if k == 0:
                    record, size, sha1 = record + 1, 0, hashlib.sha1()
                sha1.update(data)
                size += len(data)
                records.append(record)
                sizes.append(size if k + 1 == last else None)
                digests.append(_base32(sha1) if k + 1 == last else None)
            more = [pa.array(records, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([more[0], *batch.columns, *more[1:]], names=["record", *batch.schema.names, "payload_bytes", "payload_digest"])

    html = F.coalesce("html", F.lit(""))
    many = F.greatest(F.lit(1), F.ceil(F.length("html") / chunk).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.col("html").substr(k * chunk + 1, F.lit(chunk)))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html")).withColumn("chunks", many)
    rows = rows.select("page_id", "url", "chunks", F.posexplode(F.when(F.col("chunks") == 1, F.array("html")).otherwise(cut)).alias("chunk", "text"))
    rows = rows.select("page_id", "url", "chunk", "chunks", "text")
    return rows.mapInArrow(run, "record long, page_id long, url string, chunk int, chunks int, text string, payload_bytes long, payload_digest string")


def revisits(records: DataFrame, least: int = LEAST) -> DataFrame:
    """Of whole records (record, page_id, url, payload_bytes, payload_digest) those that repeat another's payload, and which (``origin``, ``origin_page``)."""
    order = F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "record")
    groups = records.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    shared = measured_side(groups.filter("n > 1").select("payload_digest", "payload_bytes", F.col("first.record").alias("origin"), F.col("first.page_id").alias("origin_page")), "payloads")
    return records.join(shared, ["payload_digest", "payload_bytes"]).filter("record != origin")


def _identifier(record: Column, page: Column, segment: Column | int) -> Column:
    h = F.md5(F.concat_ws("/", record, page, F.lit(segment) if isinstance(segment, int) else segment))
    cuts = [h.substr(a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(fields: dict[str, Column], block: Column) -> Column:
    """The text of a record but for its end; fields that are null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in fields.items()]
    head = F.concat_ws(LINE, F.lit(VERSION), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(END), block)


def write_archives(pages: DataFrame, path: str, least: int = LEAST, chunk: int = CHUNK, date: str = DATE) -> None:
    """Write a record for every row of pages (page_id, url, html) as compressed archives in the folder ``path``.

    A null html is an empty payload, a null url or page_id has no header. Line ends within a url are escaped.
    """
    table = materialize(chunk_table(pages, chunk), "chunks")
    whole = table.filter(F.col("payload_digest").isNotNull()).select("record", "page_id", "url", "payload_bytes", "payload_digest")
    again = measured_side(revisits(whole, least), "revisits")
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    common = {"WARC-Date": F.lit(date), "WARC-Target-URI": uri, "Page-ID": F.col("page_id")}
    digest = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    number, several = F.col("chunk") + 1, F.col("chunks") > 1
    own = _identifier(F.col("record"), F.col("page_id"), 1)
    first = _record(
        {"WARC-Type": F.lit("response"), "WARC-Record-ID": own, **common, "WARC-Payload-Digest": digest, "WARC-Segment-Number": F.when(several, number), "Content-Type": F.lit(HTTP)},
        F.concat(F.lit(HTTP_HEAD), F.col("text")),
    )
    total = F.when(number == F.col("chunks"), F.col("payload_bytes") + len(HTTP_HEAD))
    further = _record(
        {
            "WARC-Type": F.lit("continuation"), "WARC-Record-ID": _identifier(F.col("record"), F.col("page_id"), number), **common, "WARC-Payload-Digest": digest,
            "WARC-Segment-Number": number, "WARC-Segment-Origin-ID": own, "WARC-Segment-Total-Length": total,
        },
        F.col("text"),
    )
    repeat = _record(
        {
            "WARC-Type": F.lit("revisit"), "WARC-Record-ID": own, **common, "WARC-Payload-Digest": digest, "WARC-Profile": F.lit(PROFILE),
            "WARC-Refers-To": _identifier(F.col("origin"), F.col("origin_page"), 1),
        },
        F.lit(""),
    )
    responses = table.join(again.select("record"), "record", "left_anti").select(F.when(F.col("chunk") == 0, first).otherwise(further).alias("value"))
    responses.unionByName(again.select(repeat.alias("value"))).write.option("lineSep", END).option("compression", "gzip").text(path)


# --- reading --------------------------------------------------------------------------------


class Stream:
    """Records out of the bytes of an archive, fed piece by piece; nothing longer than a header or a chunk is kept.

    Rows: (record, page_id, type, refers_to, segment, chunk, data, payload_bytes, payload_digest). The last two count what
    was seen so far; the digest stands on the last chunk of a record in one segment. ``data`` is left out (and so are all
    chunks but the last) where it is not wanted; it always is for records in several segments.
    """

    def __init__(self, payloads: bool, most: int):
        self.payloads, self.most = payloads, most
        self.held, self.state, self.left = b"", "head", 0

    def feed(self, piece: bytes) -> Iterator[tuple]:
        at = 0
        while True:
            if self.state == "body":
                if self.left and at == len(piece):
                    return
                data = piece[at : at + min(self.left, self.most)]
                at += len(data)
                self.left -= len(data)
                yield from self._payload(data)
                continue
            head, at = self._until_end(piece, at)
            if head is None:
                return
            if self.state == "head":
                self._begin(head.decode("utf-8", "replace"))
            elif self.state == "http":
                self.left -= len(head) + len(END)
                if self.left < 0:
                    raise ValueError("a response without the end of its HTTP header")
                self.state = "body"
            elif head:
                raise ValueError(f"no record ends here: {head[:60]!r}")
            else:
                self.state = "head"

    def _until_end(self, piece: bytes, at: int) -> tuple[bytes | None, int]:
        """What comes before the next two line ends, and the place after them; None if they are not in this piece."""
        seam = self.held[-3:]
        over = (seam + piece[at : at + 3]).find(b"\r\n\r\n")
        if over >= 0:
            before, after = self.held[: len(self.held) - len(seam) + over], at + over + len(END) - len(seam)
        else:
            found = piece.find(b"\r\n\r\n", at)
            if found < 0:
                self.held += piece[at:]
                if len(self.held) > MOST_HEAD:
                    raise ValueError(f"no end of a header after {len(self.held)} bytes: {self.held[:60]!r}")
                return None, len(piece)
            before, after = self.held + piece[at:found], found + len(END)
        self.held = b""
        return before, after

    def _begin(self, head: str) -> None:
        version, *lines = head.split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record begins here: {version[:60]!r}")
        fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        self.type, self.left = fields["warc-type"], int(fields["content-length"])
        self.record = fields.get("warc-segment-origin-id", fields["warc-record-id"])
        self.page = int(fields["page-id"]) if "page-id" in fields else None
        self.refers = fields.get("warc-refers-to")
        self.segment = int(fields["warc-segment-number"]) if "warc-segment-number" in fields else None
        self.chunk, self.size, self.sha1 = 0, 0, hashlib.sha1()
        http = self.type == "response" and fields.get("content-type", "").startswith("application/http")
        self.state = "http" if http else "body"

    def _payload(self, data: bytes) -> Iterator[tuple]:
        self.sha1.update(data)
        self.size += len(data)
        last, whole = self.left == 0, self.segment is None
        if self.payloads or not whole or last:
            digest = _base32(self.sha1) if last and whole and self.type != "revisit" else None
            yield self.record, self.page, self.type, self.refers, self.segment, self.chunk, data if self.payloads or not whole else None, self.size, digest
        self.chunk += 1
        if last:
            self.state = "tail"


_ROWS = "record string, page_id long, type string, refers_to string, segment int, chunk int, data binary, payload_bytes long, payload_digest string"
_ARROW = pa.schema([("record", pa.string()), ("page_id", pa.int64()), ("type", pa.string()), ("refers_to", pa.string()), ("segment", pa.int32()), ("chunk", pa.int32()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def read_archives(spark: SparkSession, path: str, payloads: bool = True, most: int = CHUNK) -> DataFrame:
    """The records of compressed archives as rows of chunks (see ``Stream``), each archive read as one stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(payloads, most)
        for batch in batches:
            rows, held = [], 0
            for row in stream.feed(b"\n".join([*batch.column("value").to_pylist(), b""])):
                rows.append(row)
                held += len(row[6] or b"") + 200
                if held > 8 * most:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
        if stream.state != "head" or stream.held:
            raise ValueError("an archive ends within a record")

    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, _ROWS)


def whole_records(rows: DataFrame) -> DataFrame:
    """(record, page_id, type, payload_bytes, payload_digest) of every record with a payload, from the rows of ``read_archives``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Chunks come in order; what is carried from one to the next is a digest and a length.
        now, page, size, sha1 = None, None, 0, hashlib.sha1()
        for batch in batches:
            done = []
            for record, own, data in zip(*(batch.column(c).to_pylist() for c in ("record", "page_id", "data"))):
                if record != now:
                    if now is not None:
                        done.append((now, page, size, _base32(sha1)))
                    now, page, size, sha1 = record, own, 0, hashlib.sha1()
                sha1.update(data)
                size += len(data)
            yield _told(done)
        if now is not None:
            yield _told([(now, page, size, _base32(sha1))])

    single = rows.filter(F.col("payload_digest").isNotNull())
    cut = rows.filter(F.col("segment").isNotNull()).select("record", "page_id", "segment", "chunk", "data")
    ordered = cut.repartition("record").sortWithinPartitions("record", "segment", "chunk")
    joined = ordered.mapInArrow(run, "record string, page_id long, payload_bytes long, payload_digest string")
    return single.select("record", "page_id", "type", "payload_bytes", "payload_digest").unionByName(joined.withColumn("type", F.lit("response")))


def _told(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done)) or [[]] * 4
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["record", "page_id", "payload_bytes", "payload_digest"])


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every response and revisit in the archives, from the bytes read."""
    rows = materialize(read_archives(spark, path, payloads=False), "records")
    held = materialize(whole_records(rows).filter("type = 'response'").drop("type"), "responses")
    again = rows.filter("type = 'revisit'").select("page_id", "refers_to")
    asked = again.select(F.col("refers_to").alias("record")).distinct()
    origins = measured_side(held.join(asked, "record", "left_semi").withColumnRenamed("page_id", "origin"), "origins")
    repeats = again.join(origins, again["refers_to"] == origins["record"], "left")
    return held.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        repeats.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("origin").alias("refers_to"))
    )


def archive(pages: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """Write every row of pages as a record, read the archives back and tell what they hold (see ``inventory``).

    Null html: an empty payload. Rows of one page_id are records each. Of equal payloads the record with the smallest page_id is the
    response, null page_ids last, of rows with one page_id any. Empty table: no rows. Other columns are left out.
    """
    path = fresh_path(pages.sparkSession, "archives")
    write_archives(pages, path, least, chunk)
    return inventory(pages.sparkSession, path)
