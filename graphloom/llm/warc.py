"""WARC archives: writing captures and assembling them again.

A capture is a transaction of three records: request, response (or revisit) and
metadata. Request and metadata name the response's record id in
WARC-Concurrent-To; by it they are joined into one nested row per capture.

Archives are written by Spark's text writer with the record terminator as line
separator, so any file system, its commit protocol and lost executors are
Spark's business. They are read as whole files and cut by Content-Length;
captures are written by classes of size, so that a file stays within FILE_BYTES,
or holds a single capture.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_batches, materialize, scratch_path

CRLF, DATE = "\r\n", "2024-01-01T00:00:00Z"
#: Bounds a file's size, and so what a reading task holds; and the sizes up to which captures are written together.
FILE_BYTES, CLASSES = 128 << 20, (1 << 15, 1 << 19, 1 << 23, 1 << 31)
#: What the heads of a capture's three records take beside its payload and addresses.
HEADS = 2048
#: Smallest payload for which a revisit is written.
LEAST_REVISIT = 0


def base32(hexadecimal: Column) -> Column:
    """Bare upper-case base32 of 40 hexadecimal digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    fives = [F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    return F.concat(*[F.substr(letters, F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for n in fives for s in (15, 10, 5, 0)])


def captures(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, record_type, refers_to, refers_url) for each row of ``pages``.

    Of rows with equal payloads of at least ``least`` bytes, those with the
    smallest page_id are responses and the others revisit it; a group whose ids
    are all null is all responses. Null html is an empty payload.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    size = F.octet_length("html")
    groups = rows.where(size >= least).groupBy(digest.alias("sha1")).agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("least"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1 and least is not null").select("sha1", F.col("least.page_id").alias("first"), F.col("least.url").alias("first_url")), "payloads")
    told = rows.withColumn("sha1", digest).join(groups, "sha1", "left")
    again = (size >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return told.select("page_id", "url", "html", base32(F.col("sha1")).alias("digest"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"))


def _uri(page: Column, digest: Column, role: str, url: Column | None = None) -> Column:
    """By page and payload; of captures the address tells them apart, too."""
    parts = [F.lit("<urn:capture:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), digest]
    own = [] if url is None else [F.lit(":"), F.lower(F.hex(F.xxhash64(url)))]
    return F.concat(*parts, *own, F.lit(f":{role}>"))


def _headers(*pairs: tuple[str, Column | str]) -> Column:
    """Lines of a WARC head; a null value leaves its line out."""
    lines = [F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v), F.lit(CRLF)) for k, v in pairs]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(CRLF))


def write(captured: DataFrame, path: str) -> list[str]:
    """Write the three records of each capture into uncompressed WARC files under ``path``; returns the folders."""
    page, url, digest, html = (F.col(c) for c in ("page_id", "url", "digest", "html"))
    target = F.regexp_replace(url, r"[\x00-\x20]", "%20")
    place = F.coalesce(F.nullif(F.regexp_replace(target, r"^[^/?#]*//[^/?#]*|#.*$", ""), F.lit("")), F.lit("/"))
    ask = F.concat(F.lit("GET "), place, F.lit(f" HTTP/1.1{CRLF}Host: "), F.coalesce(F.regexp_extract(target, r"^[^/?#]*//([^/?#]*)", 1), F.lit("")), F.lit(CRLF * 2))
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF * 2))
    first = F.col("record_type") == "response"
    body = F.when(first, F.concat(answer, html)).otherwise(answer)
    notes = F.concat(F.lit("page_id: "), F.coalesce(page.cast("string"), F.lit("null")), F.lit(CRLF))
    own = _uri(page, digest, "response", url)

    def record(kind: Column | str, role: str, block: Column, content: str, *more: tuple[str, Column]) -> Column:
        return F.concat(_headers(("WARC-Type", kind), ("WARC-Record-ID", _uri(page, digest, role, url)), ("WARC-Date", DATE), ("WARC-Target-URI", target), *more, ("Content-Type", content), ("Content-Length", F.octet_length(block).cast("string"))), block)

    refers = F.when(~first, _uri(F.col("refers_to"), digest, "response", F.col("refers_url")))
    profile = F.when(~first, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    records = F.array(
        record("request", "request", F.coalesce(ask, F.lit(f"GET / HTTP/1.1{CRLF * 2}")), "application/http; msgtype=request", ("WARC-Concurrent-To", own)),
        record(F.col("record_type"), "response", body, "application/http; msgtype=response", ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), ("WARC-Refers-To", refers), ("WARC-Profile", profile)),
        record("metadata", "metadata", notes, "application/warc-fields", ("WARC-Concurrent-To", own)),
    )
    # what a capture takes: its payload, and its address in three heads and the request
    size = F.octet_length("html") + 6 * F.coalesce(F.octet_length("url"), F.lit(0)) + HEADS
    longest = captured.agg(F.max(size)).collect()[0][0] or 0
    folders, least = [], 0
    for most in CLASSES:
        if longest <= least and folders:
            break
        chosen = captured.where(size <= most) if not folders else captured.where((size > least) & (size <= most)) if most < CLASSES[-1] else captured.where(size > least)
        lines = chosen.select(F.explode(records).alias("value"))
        folders.append(f"{path}/to-{most}")
        lines.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", 3 * max(1, FILE_BYTES // most)).text(folders[-1])
        least = most
    return folders


FIELDS = [("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("block", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string())]


def parse(data: bytes, with_payload: bool) -> Iterator[tuple]:
    """The records of an archive, in the order of ``FIELDS``."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split(CRLF)
        if stop < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, size = stop + 4, int(head["content-length"])
        kind = head["warc-type"]
        length = digest = payload = block = None
        if kind in ("response", "revisit"):
            cut = data.find(b"\r\n\r\n", start, start + size) + 4
            block = data[start:cut].decode("utf-8", "replace")
            if kind == "response":
                body = data[cut : start + size]
                length, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                if "sha1:" + digest != head.get("warc-payload-digest", "sha1:" + digest):
                    raise ValueError(f"payload digest of {head['warc-record-id']}")
                payload = body.decode("utf-8", "replace") if with_payload else None
            else:
                length = next((int(x.partition(":")[2]) for x in block.split(CRLF) if x.lower().startswith("content-length:")), None)
                digest = head["warc-payload-digest"].partition(":")[2]
        else:
            block = data[start : start + size].decode("utf-8", "replace")
        yield kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), block, length, digest, payload
        at = start + size + 4


def read(spark: SparkSession, path: str | list[str], with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``, one folder or several; see ``FIELDS``."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows: list[tuple] = []
                held = 0
                for row in parse(batch.column(0)[k].as_buffer().to_pybytes(), with_payload):
                    rows.append(row)
                    held += len(row[5] or "") + len(row[8] or "")
                    if len(rows) >= 2000 or held > 4 << 20:
                        yield told(rows)
                        rows, held = [], 0
                if rows:
                    yield told(rows)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), FIELDS, strict=True)], [n for n, _ in FIELDS])

    files = spark.read.format("binaryFile").load(path).select("content")
    return map_batches(files, records, ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in FIELDS))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, request, response, metadata.

    Requests and metadata meet the record that they name in WARC-Concurrent-To
    in one shuffle. Repeated captures (same page, address and payload) keep their
    rows and share the other records. A capture without a request or metadata
    record has null there; those without a response are none.
    """
    kind, shown = F.col("type"), F.struct("record_id", "target_uri", "block")
    answers = kind.isin("response", "revisit")
    response = F.struct("record_id", "type", "refers_to", "target_uri", "payload_bytes", "payload_digest", "payload")
    joined = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("transaction")).agg(
        F.max(F.when(kind == "request", shown)).alias("request"), F.max(F.when(answers, response)).alias("response"), F.max(F.when(kind == "metadata", shown)).alias("metadata"), F.count_if(answers).cast("int").alias("n")
    )
    page = F.nullif(F.regexp_extract("metadata.block", r"page_id: (-?\d+)", 1), F.lit("")).cast("long")
    # equal ids are equal captures: partial sums hold one of them and their number
    return joined.withColumn("response", F.explode(F.array_repeat("response", F.col("n")))).select(page.alias("page_id"), "request", "response", "metadata")


def archive(pages: DataFrame, path: str | None = None, with_payload: bool = True) -> DataFrame:
    """Write ``pages`` into archives, read these again and assemble the captures."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    return assemble(read(spark, write(captures(pages), path), with_payload))


def op3(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row of ``pages``.

    Null html is an empty payload; null ids and addresses, very long pages,
    repeated rows and clashing other columns (not read) do no harm; an empty
    table stays empty.
    """
    found = archive(pages, with_payload=False)
    refers = F.regexp_extract("response.refers_to", r"^<urn:capture:(-?\d+):", 1)
    return found.select("page_id", "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), F.nullif(refers, F.lit("")).cast("long").alias("refers_to"))
