"""WARC archives with revisit resolution.

Writing: payload digests and lengths are shuffled (headers only) to find the
response that stands for each repeated payload; every page becomes one record
with fresh headers, a full ``response`` or a payload-free ``revisit`` that
names its original. Spark's text writer puts the records down, with the
record separator as the line separator, gzip-compressed. Reading: the archives
come in as binary files and are walked record by record by Content-Length, so
payloads may hold any characters. Revisits are then joined to the responses
they refer to. The archives lie in the shared folder.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import work_path

CRLF = "\r\n"
RECORDS_PER_FILE = 5000
#: Fixed value: the profile of a revisit with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def resolve(pages: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type and refers_to."""
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary")
    p = (pages.withColumn("payload_bytes", F.octet_length(payload).cast("long"))
         .withColumn("payload_digest", F.sha1(payload)))
    origin = (p.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
              .agg(F.max(F.col(f"`{id_col}`")).alias("__origin")))
    out = p.join(origin, ["payload_digest", "payload_bytes"], "left")
    again = F.col("__origin").isNotNull() & ~F.col(f"`{id_col}`").eqNullSafe(F.col("__origin"))
    return (out.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(again, F.col("__origin"))).drop("__origin"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", least: int = 1000) -> None:
    """One record per row under ``path``. Of rows with equal payloads of at
    least ``least`` bytes the one with the largest id is the response (all of
    them, if rows repeat that id), the others revisit it; shorter payloads are
    all responses. A null payload is empty, a null id is written as ``none``
    (its row is a response unless its payload has a response with an id), a
    null url leaves the target out; white space and control characters in a
    url are percent-encoded."""
    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"),
                       F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("html"))
    r = resolve(src, "id", "html", least)
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    again = F.col("record_type") == "revisit"
    block = F.when(again, F.concat(F.lit(HTTP + CRLF))).otherwise(
        F.concat(F.lit(HTTP + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF), "html"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(again, F.lit("WARC-Profile: " + PROFILE)),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")))
    (r.withColumn("block", block).select(F.concat(head, F.lit(CRLF + CRLF), "block").alias("value"))
     .write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of one archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record here")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        yield head, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to,
    stated_digest, payload_bytes and payload_digest as found in the block
    (null for revisits) and, if asked, the payload."""
    import pyarrow as pa

    schema = ("page_id long, url string, record_type string, refers_to long, stated_digest string, "
              "payload_bytes long, payload_digest string" + (", payload string" if payloads else ""))

    def number(x: str | None) -> int | None:
        x = (x or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(x) if x and x != "none" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            for cell in b.column(0):
                rows = []
                for head, block in records(zlib.decompress(cell.as_buffer(), wbits=47)):
                    again = head["warc-type"] == "revisit"
                    body = b"" if again else block[block.index(b"\r\n\r\n") + 4:]
                    row = [number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"],
                           number(head.get("warc-refers-to")), head["warc-payload-digest"].removeprefix("sha1:"),
                           None if again else len(body), None if again else hashlib.sha1(body).hexdigest()]
                    rows.append(row + [None if again else body.decode("utf-8")] * payloads)
                cols = list(zip(*rows)) or [[]] * len(names)
                kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, cols)],
                                                 names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def resolved_records(found: DataFrame) -> DataFrame:
    """Records with the payload facts of revisits taken from the responses
    they refer to."""
    origin = (found.filter("record_type = 'response'").groupBy("page_id", "payload_digest")
              .agg(F.max("payload_bytes").alias("b"))
              .select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest"), "b"))
    again = found.filter("record_type = 'revisit'").join(origin, ["refers_to", "stated_digest"], "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.filter("record_type = 'response'").select(cols).unionByName(
        again.select("page_id", F.col("b").alias("payload_bytes"),
                     F.when(F.col("b").isNotNull(), F.col("stated_digest")).alias("payload_digest"),
                     "record_type", "refers_to"))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                       least: int = 1000) -> DataFrame:
    """Writes the archives to a new shared folder, reads them back and
    resolves the revisits: page_id, payload_bytes, payload_digest,
    record_type, refers_to. An empty table gives an empty result."""
    spark = pages.sparkSession
    path = work_path(spark, "llm", "warc")
    write_archives(pages, path, id_col, url_col, payload_col, least)
    return resolved_records(read_archives(spark, path, payloads=False))
