"""WARC records of web pages in ZIP-packaged archives, and their reader.

Each page becomes a WARC/1.1 record (a response with its HTTP head and payload,
or a revisit that refers to the response with the same payload), gzipped by
itself.  An archive is a ZIP file with two stored members: the records, and an
index of one JSON line per record with its offset and length.  A reader finds
both through the central directory and range-reads records without extraction.

Which of equal payloads is the response is decided on (id, size, digest) rows;
only groups that recur take part in the join, and pages are then dealt by their
own id and digest, so a payload that a third of the pages share goes to no
single task.

Defined results: a null html is an empty payload, a null url an empty target; payloads
below min_bytes are always responses; of equal payloads the largest id is the
response (nulls are smallest), and rows that repeat that id are responses too.
An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.shards import write_file
from statuta.llm.store import materialise, scratch, table
from statuta.llm.zip_archive import ZipReader, pack

RECORDS, INDEX = "archive/pages.warc.gz", "indexes/pages.cdxj"
#: Payloads below this size are never deduplicated.
MIN_BYTES = 1000
#: Compressed bytes of records after which a task begins another archive.
ARCHIVE_BYTES = 32 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has no payload."""
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c for c in url or "" if c >= " ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC fields, HTTP head, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    return fields, http, payload


def decide(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, digest, refers_to of the pages that revisit another one."""
    keys = materialise(pages.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest"), "warc-keys")
    groups = keys.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("response")).where("n > 1").select("digest", "response")
    return keys.distinct().join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("response")))


MANIFEST = "path string, records long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each page; returns the manifest of archives."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    again = decide(rows, min_bytes).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "response")
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    revisit = F.col("d").isNotNull()
    chosen = joined.select("page_id", "url", "digest", "payload", F.col("response"), revisit.alias("revisit"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index = bytearray(), []

        def flush() -> pa.RecordBatch:
            lines = "".join(json.dumps(x) + "\n" for x in index).encode()
            row = pa.RecordBatch.from_pydict({"path": [write_file(folder, ".wacz", pack([(RECORDS, bytes(data)), (INDEX, lines)]))], "records": pa.array([len(index)], pa.int64())})
            data.clear()
            index.clear()
            return row

        for batch in batches:
            ids, urls, digests, payloads, responses, revisits = batch.columns
            for k in range(batch.num_rows):
                raw = build_record(ids[k].as_py(), urls[k].as_py(), payloads[k].as_py(), digests[k].as_py(), responses[k].as_py(), revisits[k].as_py())
                member = gzip.compress(raw, 1, mtime=0)
                index.append({"page": ids[k].as_py(), "offset": len(data), "length": len(member)})
                data += member
                if len(data) >= archive_bytes:
                    yield flush()
        if index:
            yield flush()

    return chosen.mapInArrow(task, MANIFEST)


def read_archive(uri: str) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """The records that the index of an archive lists."""
    with ZipReader(uri) as archive:
        index = [json.loads(x) for x in archive.read(INDEX).splitlines()]
        for raw in archive.ranges(RECORDS, [(x["offset"], x["length"]) for x in index]):
            yield parse_record(gzip.decompress(raw))


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives; payloads are checked against their digests."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out: dict[str, list] = {x.split()[0]: [] for x in READ.split(", ")}
                for fields, http, payload in read_archive(path):
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if fields["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError("a payload that doesn't fit its digest")
                    size = int(http.decode().rpartition("Content-Length: ")[2])
                    out["page_id"].append(int(fields["x-page"]) if "x-page" in fields else None)
                    out["payload_bytes"].append(size)
                    out["payload_digest"].append(digest)
                    out["record_type"].append(fields["warc-type"])
                    to = fields.get("x-refers-to-page", "None")
                    out["refers_to"].append(None if to == "None" else int(to))
                    out["url"].append(fields["warc-target-uri"])
                kinds = {"long": pa.int64(), "string": pa.string()}
                yield pa.RecordBatch.from_arrays([pa.array(out[x.split()[0]], kinds[x.split()[1]]) for x in READ.split(", ")], names=list(out))

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, or the small rows would be put together in one task
    return manifest.select("path").repartition(tasks, "path").mapInArrow(task, READ)


def warc_output(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder and read them back."""
    manifest = write_archives(pages, scratch(pages.sparkSession, "warc"))
    return read_archives(materialise(manifest, "warc-manifest"))


def op7_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_output(table(spark, sf_dir, "pages")).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM k)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM g
"""

QUERIES = {"op7_zip_warc": op7_zip_warc}
ORACLES = {"op7_zip_warc": ORACLE}
