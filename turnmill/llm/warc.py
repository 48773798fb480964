"""WARC archives: writing with segmentation and revisits, reading with segment reassembly.

Writing. Each page is an HTTP response with chunked transfer framing. A block longer than `SEGMENT` bytes is cut into a first record and
continuation records. Of equal payloads of at least `REVISIT_FROM` bytes the one with the least id is stored; the others are revisit
records that refer to it. Records go through Spark's text sink, whose line separator is the blank line that ends a WARC record, so
archives can lie in any store that Spark writes to, and a task that is repeated replaces its files whole. A row of the sink is a run of
records of about `RUN` bytes, a file has `RUNS` of them.

Reading. Files come through the binaryFile source. Whole records are decoded where they are read; segments are grouped by origin,
ordered by segment number, checked against the total length, and decoded. Only segmented records are shuffled; a group is one page.

Defined results: a null payload is empty; a missing segment, a wrong total or broken framing gives intact = false and a null payload; rows with the same least id are all
responses; repeated rows are records of their own, and so are rows with one id and different payloads (a revisit is found by the id and the digest that it
refers to); null ids and urls stay null; ids may be any strings (written percent-encoded), blanks and control characters of urls are percent-encoded; an
empty table gives no archive and no rows; extra columns are ignored. A page's block must fit into a task (2 GB at most, as any value of Spark's).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.llm.common import BROADCAST_ROWS, adopt, arrow_map, compact, cut, table
from turnmill.session import new_path

SEGMENT = 32 << 10
CHUNK = 8 << 10
RUN = 2 << 20
RUNS = 8
REVISIT_FROM = 100
END = "\r\n\r\n"
STATUS = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for k in range(0, len(payload), size):
        part = payload[k : k + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, or None where the framing is broken. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out) if body.endswith(b"\r\n\r\n", end) or body[end:] == b"\r\n\r\n" else None
        part = body[end + 2 : end + 2 + n]
        at = end + 2 + n + 2
        if n < 0 or len(part) < n or body[at - 2 : at] != b"\r\n":
            return None
        out.append(part)


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        return None
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def record_id(page_id: object, digest: str) -> str:
    """The id of a stored payload's record, which its revisits name."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{digest} {page_id}')}>"


def records_of(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, named: bool, segment: int = SEGMENT) -> list[bytes]:
    """A page's records, without the blank lines that end them. named: its payload, or that of the page it refers to, is stored in one record only, whose id follows from it."""
    own = record_id(page_id, digest) if named and refers_to is None else f"<urn:uuid:{uuid.uuid4()}>"
    date = "2000-01-01T00:00:00Z"  # pages have no date of their own
    target = None if url is None else "".join(c if c > " " and c != "\x7f" else quote(c) for c in url)
    common = [("WARC-Date", date), ("WARC-Target-URI", target), ("X-Page-Id", None if page_id is None else quote(str(page_id), safe="")), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        more = [("WARC-Record-ID", own), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ("WARC-Refers-To", record_id(refers_to, digest) if named else None), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page", quote(str(refers_to), safe=""))]
        return [record("revisit", more + common, STATUS)]
    block = STATUS + chunked(payload)
    if len(block) <= segment:
        return [record("response", [("WARC-Record-ID", own), *common], block)]
    cuts = range(0, len(block), segment)
    out = []
    for n, at in enumerate(cuts, 1):
        fields = [("WARC-Record-ID", own if n == 1 else f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Segment-Number", n)]
        if n > 1:
            fields += [("WARC-Segment-Origin-ID", own), ("WARC-Date", date)]
        if n == len(cuts):
            fields.append(("WARC-Segment-Total-Length", len(block)))
        out.append(record("response" if n == 1 else "continuation", fields + common * (n == 1), block[at : at + segment]))
    return out


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", segment: int = SEGMENT, revisit_from: int = REVISIT_FROM, broadcast_rows: int = BROADCAST_ROWS) -> None:
    """Write pages (payload: string, taken as UTF-8, or binary) as WARC files into the folder `path`."""
    pages = adopt(pages)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"), body.alias("_body"), F.sha2(body, 256).alias("_digest"))
    keys = cut(compact(rows.select("_id", "_digest", F.length("_body").alias("n"))), "payloads")
    twice = keys.where(F.col("n") >= revisit_from).groupBy("_digest", "_id").agg(F.count("*").alias("c")).groupBy("_digest").agg(F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "c"))).alias("f"), F.sum("c").alias("c")).where("c > 1")
    twice = cut(twice.select(F.col("_digest").alias("_d"), F.col("f._id").alias("_first"), F.coalesce(F.col("f.c") == 1, F.lit(False)).alias("_one")), "revisits")
    few = twice.count() <= broadcast_rows
    rows = rows.join(F.broadcast(twice) if few else twice.hint("merge"), F.col("_digest") == F.col("_d"), "left")
    rows = rows.select("_id", "_url", "_body", "_digest", F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("_refers"),
                       ((F.length("_body") >= revisit_from) & F.coalesce("_one", F.lit(True))).alias("_named"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for r in records_of(*row, segment=segment):
                    held.append(r)
                    size += len(r)
                    if size >= RUN:
                        yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)], pa.binary())], names=["value"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)], pa.binary())], names=["value"])

    # a payload may be any bytes, and a cut may fall into a character: the cast keeps bytes as they are
    text = arrow_map(rows, run, "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", END).option("maxRecordsPerFile", RUNS).text(path)


RECORD = "type string, record_id string, page_id string, url string, refers_to string, digest string, origin string, segment int, total bigint, block binary"
_FIELDS = {"warc-type": "type", "warc-record-id": "record_id", "x-page-id": "page_id", "warc-target-uri": "url", "x-refers-to-page": "refers_to", "warc-payload-digest": "digest", "warc-segment-origin-id": "origin", "warc-segment-number": "segment", "warc-segment-total-length": "total"}
_KINDS = [pa.string()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
_NAMES = [*_FIELDS.values(), "block"]


def parse(content: bytes) -> Iterator[dict]:
    """The records of an archive file, in order."""
    at = 0
    while (at := content.find(b"WARC/1.", at)) >= 0:
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        found: dict = dict.fromkeys(_NAMES)
        length = 0
        for line in content[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            k, v = k.strip().lower().decode("latin-1"), v.strip().decode("utf-8", "replace")
            if k == "content-length":
                length = int(v)
            elif k in _FIELDS:
                found[_FIELDS[k]] = int(v) if k in ("warc-segment-number", "warc-segment-total-length") else unquote(v) if k in ("x-page-id", "x-refers-to-page") else v
        found["block"] = content[end + 4 : end + 4 + length]
        yield found
        at = end + 4 + length


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                held, size = [], 0
                for r in parse(content.as_py()):
                    held.append(r)
                    size += len(r["block"])
                    if size > RUN:
                        yield _batch(held)
                        held, size = [], 0
                yield _batch(held)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return arrow_map(files, run, RECORD)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)


def reassemble(records: DataFrame) -> DataFrame:
    """(type, record_id, page_id, url, refers_to, digest, intact, payload) of each response and revisit; a revisit has no payload of its own."""
    names = ["type", "record_id", "page_id", "url", "refers_to", "digest"]
    piece = F.struct(F.lit(1).alias("segment"), "block")
    whole = records.where("segment IS NULL AND type IN ('response', 'revisit')").select(*names, F.lit(None).cast("bigint").alias("total"), F.array(piece).alias("parts"))
    first = F.max(F.when(F.col("segment") == 1, F.struct(*names)))
    parts = F.array_sort(F.collect_list(F.struct("segment", "block")))
    joined = records.where("segment IS NOT NULL").groupBy(F.when(F.col("segment") == 1, F.col("record_id")).otherwise(F.col("origin")).alias("o")).agg(first.alias("f"), parts.alias("parts"), F.coalesce(F.max("total"), F.lit(-1)).alias("total"))
    rows = whole.unionByName(joined.where("f IS NOT NULL").select("f.*", "total", "parts"))
    schema = rows.drop("total", "parts").schema.add("intact", "boolean").add("payload", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size, at = [], 0, 0
            for k, (kind, total) in enumerate(zip(b.column("type").to_pylist(), b.column("total").to_pylist(), strict=True)):
                got = b.column("parts")[k].as_py()
                sound = [x["segment"] for x in got] == list(range(1, len(got) + 1))
                block = b"".join(x["block"] for x in got) if sound else b""
                sound = sound and (total is None or total == len(block))
                payload = payload_of(block) if sound and kind == "response" else None
                held.append((sound and (kind == "revisit" or payload is not None), payload))
                size += len(payload or b"")
                if size > RUN or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(b.column(n).slice(at, len(held)) for n in names), pa.array([x for x, _ in held], pa.bool_()), pa.array([x for _, x in held], pa.binary())], names=schema.names)
                    held, size, at = [], 0, k + 1

    return arrow_map(rows, run, schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    pages = table(spark, sf_dir, "pages")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    back = reassemble(read_records(pages.sparkSession, path)).select(F.col("page_id").cast(kind).alias("page_id"), F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"), F.col("digest").alias("_named"),
                                                                     F.length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    back = cut(compact(back), "read-back")
    again = back.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "_named")
    # what a revisit stands for is read from the response that it refers to: that with the id and the digest
    named = back.where("record_type = 'response'").select(F.col("page_id").alias("_of"), "payload_bytes", "payload_digest", F.concat(F.lit("sha256:"), "payload_digest").alias("_d"))
    wanted = again.select(F.col("refers_to").alias("_of"), F.col("_named").alias("_d")).distinct()
    named = cut(named.join(wanted, ["_of", "_d"], "left_semi").dropDuplicates(["_of", "_d"]), "referred")
    again = again.join(named, (F.col("refers_to") == F.col("_of")) & (F.col("_named") == F.col("_d")))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return back.where("record_type = 'response'").select(*columns).unionByName(again.select(*columns))


OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first FROM p GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.d = f.d
"""

