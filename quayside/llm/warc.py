"""WARC archives: captures written as records, and transactions assembled from them again.

Writing. Every row of a pages table is one capture: a request record, a metadata record and a
``response`` record with the payload, or a ``revisit`` record if another capture of the same
payload is the response. Who is the response is decided on narrow rows (digest, key); the
payloads themselves are shuffled once, already reduced to one per digest inside every
task. Records are plain columns up to the text writer, which ends each one with the blank
lines that the format asks for.

Reading. A gzip archive is read by one task as a stream of pieces between blank lines, which
a small reader joins to records by their declared lengths, so memory is bounded by one record, not
by one archive. Records then meet through their ``WARC-Concurrent-To`` and
``WARC-Refers-To`` identifiers in joins, and every capture becomes one nested row.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quayside.session import scratch_dir, stage

_EOL = "\r\n"
# The profile of a revisit with the same payload, and the name space of record ids.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD_ID = "<urn:capture:%s:%s>"

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("concurrent_to", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("declared_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("fields", T.StringType()),
    T.StructField("payload", T.BinaryType())])


def sha1_base32(col):
    """Bare upper-case base32 of the SHA-1 of a binary column: 160 bits in eight groups of 20."""
    hex_ = F.sha1(col)
    groups = [F.lpad(F.conv(F.substring(hex_, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def safe_uri(col):
    """A URI fit for a header line: blanks and control characters are percent-encoded."""
    out = F.coalesce(col.cast("string"), F.lit(""))
    for code in (*range(33), 127):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(F.translate(col, "".join(map(chr, (*range(33), 127))), "") == col, col).otherwise(out)


def _lines(*parts):
    """Header lines joined by CRLF; a null part is left out."""
    return F.concat_ws(_EOL, *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _record(kind, record_id, uri, date: str, content: str, block, *extra):
    """One record as text: header, blank line, block. The writer adds the closing CRLF CRLF."""
    size = F.octet_length(block).cast("string")
    head = _lines("WARC/1.1", f"WARC-Type: {kind}", F.concat(F.lit("WARC-Record-ID: "), record_id),
                  F.when(uri != "", F.concat(F.lit("WARC-Target-URI: "), uri)), f"WARC-Date: {date}", *extra,
                  f"Content-Type: {content}", F.concat(F.lit("Content-Length: "), size))
    return F.concat(head, F.lit(_EOL * 2), block)


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url_col: str = "url", payload_col: str = "html",
               date: str = "2000-01-01T00:00:00Z", least: int = 0, records_per_archive: int = 50_000) -> None:
    """Write a request, a metadata and a response or revisit record per row to gzip archives
    below ``path`` (``records/*.txt.gz``, at most ``records_per_archive`` records each).

    Payload: the column's bytes (a string's UTF-8); null is the empty payload. Of the rows
    with equal payloads of ``least`` bytes or more, the one with the largest key is the
    response and the others revisit it; smaller payloads are all responses. A null key is
    the smallest. Rows that tie on the key, repeated rows included, are captures of their
    own, of which one is the response. A null or empty URL gives records without target;
    blanks and control characters in a URL are percent-encoded. The key is kept in the
    metadata record (``capture-key``; a null key has no such line). Other columns are ignored.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    src = pages.select(F.col(key).cast("long").alias("k"), safe_uri(F.col(url_col)).alias("uri"), payload.alias("payload"))
    # equal payloads are told by SHA-256; SHA-1 is only what the format writes down
    src = src.withColumn("sha", F.sha2("payload", 256))
    seen = stage(src.select("k", F.coalesce("uri", F.lit("")).alias("uri"), "sha", F.octet_length("payload").alias("size"),
                            sha1_base32(F.col("payload")).alias("digest"), F.monotonically_increasing_id().alias("c")), "captures")
    # the largest key and, of the rows that tie on it, the smallest capture number
    best = seen.groupBy(F.col("sha").alias("b_sha")).agg(F.max(F.struct("k", (-F.col("c")).alias("c"))).alias("best"))
    first = -F.col("best.c")
    small = F.col("size") < F.lit(least)
    cap = stage(seen.join(best, seen.sha == best.b_sha).select("k", "uri", "sha", "size", "digest", "c", first.alias("f_c"), (small | (F.col("c") == first)).alias("is_response")), "roles")

    name = lambda kind, c: F.format_string(_RECORD_ID, F.lit(kind), c.cast("string"))
    main = name("response", F.col("c"))
    request = _record("request", name("request", F.col("c")), F.col("uri"), date, "application/http; msgtype=request",
                      F.concat(F.lit("GET "), F.when(F.col("uri") == "", F.lit("/")).otherwise(F.col("uri")), F.lit(" HTTP/1.1" + _EOL * 2)),
                      F.concat(F.lit("WARC-Concurrent-To: "), main))
    # the metadata record points to the request, the request to the response
    metadata = _record("metadata", name("metadata", F.col("c")), F.col("uri"), date, "application/warc-fields",
                       F.concat(F.coalesce(F.concat(F.lit("capture-key: "), F.col("k").cast("string"), F.lit(_EOL)), F.lit("")), F.lit("via: pages" + _EOL)),
                       F.concat(F.lit("WARC-Concurrent-To: "), name("request", F.col("c"))))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("size").cast("string"), F.lit(_EOL * 2))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    revisit = _record("revisit", main, F.col("uri"), date, "application/http; msgtype=response", http, digest,
                      f"WARC-Profile: {_PROFILE}", F.concat(F.lit("WARC-Refers-To: "), name("response", F.col("f_c"))))
    response = _record("response", main, F.col("uri"), date, "application/http; msgtype=response",
                       F.concat(http, F.col("payload").cast("string")), digest)

    narrow = cap.select(F.explode(F.array_compact(F.array(request, metadata, F.when(~F.col("is_response"), revisit)))).alias("value"))
    # one copy of each payload leaves a task; rows of equal payloads need no more than that
    stored = src.groupBy("sha").agg(F.first("payload").alias("payload"))
    heads = cap.where("is_response").select("sha", "c", "uri", "size", "digest")
    whole = heads.join(stored, "sha").select(response.alias("value"))
    out = narrow.unionByName(whole)
    (out.write.option("lineSep", _EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_archive)
     .text(f"{path}/records"))


# -- reading ---------------------------------------------------------------------------------


def _parse(head: list[bytes], block: bytes, keep: bool) -> tuple:
    fields = {}
    for line in head[1:]:
        name, _, value = line.partition(b":")
        fields.setdefault(name.strip().lower(), value.strip().decode("utf-8", "replace"))
    kind = fields.get(b"warc-type", "")
    payload, text = None, None
    if kind == "response":
        cut = block.find(b"\r\n\r\n")
        payload = block[cut + 4:] if cut >= 0 else b""
    elif kind in ("metadata", "warcinfo"):
        text = block.decode("utf-8", "replace")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if payload is not None else None
    return (fields.get(b"warc-record-id"), kind, fields.get(b"warc-concurrent-to"), fields.get(b"warc-refers-to"), fields.get(b"warc-target-uri"),
            fields.get(b"warc-date"), fields.get(b"warc-payload-digest"), None if payload is None else len(payload), digest, text,
            payload if keep else None)


def _records(pieces: Iterator[tuple[int, bytes]], keep: bool) -> Iterator[tuple]:
    """Records of a stream of (archive, bytes up to the next CRLF CRLF). A record that its
    archive ends before its declared length is left out, as is what stands between records."""
    archive, buf, head, want = None, bytearray(), [], -1
    for name, piece in pieces:
        if name != archive:
            archive, buf, want = name, bytearray(piece), -1
        else:
            buf += _EOL.encode() * 2
            buf += piece
        while True:
            if want < 0:  # between records; a header is whole when something follows it
                at, end = 0, buf.find(b"\r\n\r\n")
                if not buf.startswith(b"WARC/1."):
                    at = buf.find(b"WARC/1.")
                    if at < 0:
                        del buf[:max(0, len(buf) - 7)]
                        break
                    end = buf.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                head = bytes(buf[at:end]).split(b"\r\n")
                length = [x.partition(b":")[2].strip() for x in head if x[:15].lower() == b"content-length:"]
                want = int(length[0]) if length and length[0].isdigit() else 0
                del buf[:end + 4]
            if len(buf) < want:
                break
            yield _parse(head, bytes(buf[:want]), keep)
            del buf[:want]
            want = -1


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every record of the gzip archives at ``path``, per record or per file compressed.

    A task streams its archives piece by piece, cut at blank lines; a gzip file is never
    split, so records are whole. ``payload_bytes`` and ``payload_digest`` (bare base32 SHA-1) are counted on the
    payload read; ``declared_digest`` is the header's. With ``payload=False`` the payload
    column is null and stays in the worker. A record cut off by the end of its archive is
    left out, and so is anything that is not a record.
    """
    lines = (spark.read.option("lineSep", _EOL * 2).text(path)
             .select(F.xxhash64(F.input_file_name()).alias("f"), F.col("value").cast("binary").alias("v")))
    schema = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in RECORD])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feed = ((f, v) for b in batches for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        rows, size = [], 0
        for r in _records(feed, payload):
            rows.append(r)
            size += 200 + len(r[-1] or b"")
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return lines.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture`` (the response or revisit record), ``request``
    and ``metadata`` (the record of the smallest id that belongs to it, or null),
    ``n_requests`` and ``n_metadata``.

    A request belongs to the capture that its concurrent-to names. A metadata record may
    name the capture or one of its requests. Records that name nothing known belong to no
    capture and are left out, so is a record without an id. Of records with one id each is
    a row of its own. Many records may name one capture: they are reduced inside the tasks
    before they meet it.
    """
    known = records.where("record_id is not null")
    narrow = lambda kind: known.where(F.col("record_type") == kind).select(
        F.col("concurrent_to").alias("anchor"), F.struct("record_id", "target_uri", "date", "fields").alias("r"))
    heads = known.where(F.col("record_type").isin("response", "revisit"))
    requests = narrow("request")
    via = known.where("record_type = 'request'").groupBy(F.col("record_id").alias("q_id")).agg(F.min("concurrent_to").alias("q_anchor"))
    metadata = narrow("metadata").join(via, F.col("anchor") == F.col("q_id"), "left").select(F.coalesce("q_anchor", "anchor").alias("anchor"), "r")

    def best(df: DataFrame, name: str, count: str) -> DataFrame:
        return df.where("anchor is not null").groupBy(F.col("anchor").alias(f"{name}_anchor")).agg(F.min("r").alias(name), F.count("*").alias(count))

    out = heads.select(F.struct(*heads.columns).alias("capture"))
    for part, name, count in ((requests, "request", "n_requests"), (metadata, "metadata", "n_metadata")):
        side = best(part, name, count)
        out = out.join(side, F.col("capture.record_id") == F.col(f"{name}_anchor"), "left").drop(f"{name}_anchor").fillna(0, [count])
    return out


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Captures with ``of``: the response whose payload they have (their own record for a
    response; for a revisit the record it refers to, null if that is not there): record_id,
    key, payload_bytes, payload_digest. Many revisits of one response are a skewed join on
    narrow rows, which adaptive execution splits."""
    key = F.regexp_extract(F.coalesce("metadata.fields", F.lit("")), r"(?m)^capture-key: (-?[0-9]+)\r?$", 1)
    keyed = captures.withColumn("key", F.when(key != "", key.cast("long")))
    own = F.struct(F.col("capture.record_id").alias("record_id"), F.col("key").alias("key"), F.col("capture.payload_bytes").alias("payload_bytes"),
                   F.col("capture.payload_digest").alias("payload_digest"))
    responses = keyed.where("capture.record_type = 'response'").select(F.col("capture.record_id").alias("o_id"), own.alias("o"))
    revisits = keyed.where("capture.record_type = 'revisit'")
    found = revisits.join(responses, F.col("capture.refers_to") == F.col("o_id"), "left").drop("o_id").withColumnRenamed("o", "of")
    return keyed.where("capture.record_type = 'response'").withColumn("of", own).unionByName(found)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives on the shared scratch folder, read back and
    assembled: one row per page."""
    path = scratch_dir(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = stage(read_records(spark, f"{path}/records", payload=False), "records")  # the archives are read once
    captures = resolve_revisits(stage(assemble(records), "transactions"))
    return captures.select(F.col("key").alias("page_id"), F.col("of.payload_bytes").alias("payload_bytes"), F.col("of.payload_digest").alias("payload_digest"),
                           F.col("capture.record_type").alias("record_type"),
                           F.when(F.col("capture.record_type") == "revisit", F.col("of.key")).alias("refers_to"))


_BASE32 = " || ".join(
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {0}, 5))::BIGINT >> {1}) & 31)::INT, 1)".format(5 * k + 1, 15 - 5 * j)
    for k in range(8) for j in range(4))

SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS top FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""
