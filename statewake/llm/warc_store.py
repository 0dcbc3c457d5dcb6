"""Content-addressed WARC archive.

Two tables stand for the archive: ``headers`` has the exact WARC and HTTP header bytes of every
record, ``payloads`` has each payload once, compressed, under its SHA-256. A record is put together again by a
join on the digest, parsed as WARC and checked: lengths and digest must hold, else the read fails.

Of records with equal payloads of at least ``min_revisit`` bytes that with the smallest page id is
a response and the others are revisits of it; smaller payloads are always responses.

Defined results: null html counts as empty; a null url leaves the target header out; control
characters and spaces of a url are percent-encoded in the header, each by its own code; repeated rows give repeated
records of one type; null page ids count as larger than all others; an empty table gives an empty
result; only the three columns named are read. Page ids are integers.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statewake.llm.common import Scratch, salted_join, spread_join

MIN_REVISIT = 100
#: The tables carry no fetch time; the date of all records is a parameter.
DATE = "1970-01-01T00:00:00Z"
EOL = "\r\n"
REVISIT = f"WARC/1.1{EOL}WARC-Type: revisit{EOL}".encode()


def digests(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    payload = F.encode(F.coalesce(html_col, F.lit("")), "UTF-8")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})


def write_archive(pages: DataFrame, scratch: Scratch, *, min_revisit=MIN_REVISIT, date=DATE, **cols) -> tuple[DataFrame, DataFrame]:
    """headers(page_id, digest, header) and payloads(digest, packed, copies: pages that have it), as written and read again."""
    d = digests(pages, **cols)
    known = scratch.write(d.select("page_id", "url", "digest", "n"), "digests")
    first = known.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    # one row of each digest; the group limit drops copies before the shuffle
    order = Window.partitionBy("digest").orderBy(F.col("page_id").asc_nulls_last())
    packed = d.select("digest", "page_id", "payload").mapInArrow(_pack, "digest string, page_id long, packed binary")
    payloads = packed.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("digest", "packed").join(first.select("digest", "copies"), "digest")
    escaped = F.expr(r"array_join(transform(split(url, ''), c -> if(c rlike '[\\x00-\\x20\\x7F]', concat('%', lpad(hex(ascii(c)), 2, '0')), c)), '')")
    url = F.when(F.col("url").rlike(r"[\x00-\x20\x7F]"), escaped).otherwise(F.col("url"))
    rid = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    revisit = (F.col("n") >= min_revisit) & (F.col("page_id") != F.col("first_id")) | (F.col("n") >= min_revisit) & F.col("page_id").isNull() & F.col("first_id").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("n"), F.lit(EOL + EOL))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    rows = spread_join(known, first, ["digest"], "copies", known.count()).withColumns({"revisit": F.coalesce(revisit, F.lit(False)), "http": http})
    block = F.octet_length("http") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n"))
    warc = F.concat_ws(
        EOL, F.lit("WARC/1.1"), line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", rid("page_id")), F.lit(f"WARC-Date: {date}"), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{EOL}WARC-Refers-To: "), rid("first_id"))),
        F.lit("Content-Type: application/http; msgtype=response"), line("Content-Length", block.cast("string")), F.lit(EOL),
    )
    headers = rows.select("page_id", "digest", F.encode(F.concat(warc, F.col("http")), "UTF-8").alias("header"))
    return scratch.write(headers, "headers"), scratch.write(payloads, "payloads")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Named WARC fields, HTTP header bytes and body of one record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split(EOL)
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} has a wrong length")
    http, sep, body = block.partition(b"\r\n\r\n")
    return fields, http + sep, body


def _pack(batches):
    """Payloads as they are kept and moved: compressed."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([zlib.compress(x, 6) for x in b.column(2).to_pylist()], pa.binary())], names=["digest", "page_id", "packed"])


def _unpack(batches, end=(EOL + EOL).encode()):
    """page_id, the record's bytes and its full payload."""
    for b in batches:
        records, payloads = [], []
        for header, packed in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            payloads.append(zlib.decompress(packed))
            # a revisit's block is its HTTP header alone
            records.append(header + end if header.startswith(REVISIT) else header + payloads[-1] + end)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(records, pa.binary()), pa.array(payloads, pa.binary())], names=["page_id", "record", "payload"])


def _joined(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Headers with their payloads; those of a payload that many pages share are spread over tasks."""
    return salted_join(headers, payloads, ["digest"], "copies", ["header"], headers.count()).select("page_id", "header", "packed")


def records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """page_id, the record's bytes, and the full payload (also of revisits)."""
    return _joined(headers, payloads).mapInArrow(_unpack, "page_id long, record binary, payload binary")


def read_archive(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, parsed from the records."""
    number = lambda rid: None if rid == "<urn:x-page:null>" else int(rid[len("<urn:x-page:") : -1])

    def run(batches):
        for b in _unpack(batches):
            out = []
            for record, payload in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                f, _, body = parse_record(record)
                digest = hashlib.sha256(payload).hexdigest()
                if f["warc-payload-digest"] != f"sha256:{digest}" or f["warc-type"] == "response" and body != payload:
                    raise ValueError(f"payload of {f['warc-record-id']} does not have its digest")
                out.append((number(f["warc-record-id"]), len(payload), digest, f["warc-type"], number(f["warc-refers-to"]) if "warc-refers-to" in f else None))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return _joined(headers, payloads).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    return read_archive(*write_archive(pages, Scratch(pages.sparkSession, "warc"), **options))


def export_warc(headers: DataFrame, payloads: DataFrame, path: str) -> int:
    """Write all records into one plain WARC file on the driver, one at a time; returns their number."""
    n = 0
    with open(path, "wb") as f:
        for r in records(headers, payloads).select("record").toLocalIterator():
            f.write(r.record)
            n += 1
    return n


SQL = """
WITH d AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS m FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> m THEN m END AS refers_to FROM f
"""
