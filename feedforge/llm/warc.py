"""WARC derivatives (operator 8): metadata and plain-text conversion records made from response records."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedforge.llm.exchange import record_batch

FIELDS = ("warc_type", "record_id", "refers_to", "target_uri", "content_type", "source_digest", "source_headers")
RECORD = "page_id long, " + ", ".join(f"{n} string" for n in FIELDS) + ", block string"
#: Records per file, so that a reader's task holds few.
RECORDS_PER_FILE = 5000

#: From HTML to plain text, in a syntax that Java and RE2 read alike.
REWRITES = (
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<(script|style|nav|template|noscript)\b[^>]*>.*?</(script|style|nav|template|noscript)\s*>", " "),
    (r"(?is)<head\b[^>]*>.*?</head\s*>", " "),
    (r"(?i)<(/?(p|div|h[1-6]|li|ul|ol|tr|table|article|section|blockquote)|br)\b[^>]*>", "\n"),
    (r"<[^>]*>", " "),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"&amp;", "&"),
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
)


#: The form of a rewrite with the same results that leaves single line ends alone.
SPARING = {r" ?\n[ \n]*": r" \n[ \n]*|\n[ \n]+"}
BLANKS = r"[ \t\r\f]+"


def plain_text(html: Column) -> Column:
    """``REWRITES``, with plain replacements where these do the same, since a regular expression tries every character."""
    out = html
    for pattern, by in REWRITES:
        if pattern.startswith("&"):
            out = F.replace(out, F.lit(pattern), F.lit(by))
        elif pattern == BLANKS:
            for blank in "\t\r\f":
                out = F.replace(out, F.lit(blank), F.lit(" "))
            out = F.regexp_replace(out, "  +", " ")
        else:
            out = F.regexp_replace(out, SPARING.get(pattern, pattern), by)
    return F.btrim(out, F.lit(" \n"))  # by now no two of these stand together


def record_id(kind: str, *parts: Column) -> Column:
    """A name that the same source always gets again."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of pages (page_id, url, html): each block is an HTTP header and the payload."""
    html = F.coalesce("html", F.lit(""))
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string")
    )
    url = F.regexp_replace("url", r"[\r\n]+", " ")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.lit("response").alias("warc_type"),
        record_id("response", F.col("page_id"), url).alias("record_id"),
        F.lit(None).cast("string").alias("refers_to"),
        url.alias("target_uri"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        digest(html).alias("source_digest"),
        headers.alias("source_headers"),
        F.concat(headers, F.lit("\r\n\r\n"), html).alias("block"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record; other types give none.

    Both refer to the response's record id and keep its target, payload digest and HTTP headers. The metadata block has
    title, number of links and text length as fields, and the id of the conversion. Null payloads give empty text.
    """
    payload = F.expr("substring(block, instr(block, '\r\n\r\n') + 4)")
    own = records.filter("warc_type = 'response'").withColumn("html", F.when(F.col("block").contains("\r\n\r\n"), payload).otherwise(""))
    own = own.withColumn("text", plain_text(F.col("html")))
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1), r"\s+", " "))
    links = F.size(F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*\bhref="), F.lit(0)))
    conversion_id = record_id("conversion", F.col("record_id"))
    fields = F.concat(
        F.lit("title: "), title, F.lit("\r\nlinks: "), links.cast("string"), F.lit("\r\ntext-length: "),
        F.length("text").cast("string"), F.lit("\r\nconversion: "), conversion_id, F.lit("\r\n"),
    )
    kinds = (
        ("metadata", record_id("metadata", F.col("record_id")), "application/warc-fields", fields),
        ("conversion", conversion_id, "text/plain; charset=utf-8", F.col("text")),
    )
    made = F.explode(
        F.array(*(F.struct(F.lit(k).alias("warc_type"), i.alias("record_id"), F.lit(c).alias("content_type"), b.alias("block")) for k, i, c, b in kinds))
    )
    return own.select("page_id", made.alias("m"), F.col("record_id").alias("refers_to"), "target_uri", "source_digest", "source_headers").select(
        "page_id", "m.warc_type", "m.record_id", "refers_to", "target_uri", "m.content_type", "source_digest", "source_headers", "m.block"
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as gzipped WARC/1.1 files of at most ``RECORDS_PER_FILE`` records each."""
    block = F.coalesce("block", F.lit(""))
    header = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "warc_type"),
        F.concat(F.lit("WARC-Record-ID: "), "record_id"),
        F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.concat(F.lit("WARC-Target-URI: "), "target_uri"),
        F.concat(F.lit("WARC-Block-Digest: "), digest(block)),
        F.concat(F.lit("WARC-Payload-Digest: "), "source_digest"),
        F.concat(F.lit("X-Source-Page: "), F.col("page_id").cast("string")),
        F.concat(F.lit("X-Source-Headers: "), F.regexp_replace("source_headers", "\r\n", " | ")),
        F.concat(F.lit("Content-Type: "), "content_type"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *header), F.lit("\r\n\r\n"), block)
    (
        records.select(record.alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, gzipped or not, with ``block_digest`` as stated there; one task reads one file at a time."""
    names = [*(f.split()[0] for f in RECORD.split(", ")), "block_digest"]
    schema = pa.schema([(n, pa.int64() if n == "page_id" else pa.string()) for n in names])
    keys = {
        "warc-type": 1, "warc-record-id": 2, "warc-refers-to": 3, "warc-target-uri": 4, "content-type": 5,
        "warc-payload-digest": 6, "x-source-headers": 7, "warc-block-digest": 9,
    }

    def records(data: bytes) -> Iterator[list]:
        at = 0
        while (begin := data.find(b"WARC/", at)) >= 0:
            end = data.index(b"\r\n\r\n", begin)
            row: list = [None] * len(names)
            length = 0
            for line in data[begin:end].decode().split("\r\n")[1:]:
                key, _, value = line.partition(": ")
                key = key.lower()
                if key in keys:
                    row[keys[key]] = value.replace(" | ", "\r\n") if key == "x-source-headers" else value
                elif key == "x-source-page":
                    row[0] = int(value)
                elif key == "content-length":
                    length = int(value)
            row[8] = data[end + 4 : end + 4 + length].decode()
            at = end + 4 + length
            yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                rows = list(records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
                for a in range(0, len(rows), 1000):
                    yield record_batch(schema, zip(*rows[a : a + 1000], strict=True))

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD + ", block_digest string")


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Derivatives of pages written to ``path`` and read back: one row per record, its block as length and digests."""
    write_warc(derivatives(responses(pages)), path)
    block = F.col("block")
    return read_warc(pages.sparkSession, path).select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", "source_digest", "source_headers",
        F.octet_length(block).cast("long").alias("content_length"), "block_digest", (digest(block) == F.col("block_digest")).alias("intact"),
    )


def _sql_text(html: str) -> str:
    out = html
    for pattern, by in (*REWRITES, (r"^[ \n]+|[ \n]+$", "")):
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by.replace(chr(39), chr(39) * 2)}', 'g')"
    return out


def _sql_id(kind: str, of: str) -> str:
    h = f"md5('{kind}|' || {of})"
    parts = " || '-' || ".join(f"substring({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {parts} || '>'"


_CRLF = "chr(13) || chr(10)"
ORACLE_SQL = f"""
with r as (
  select page_id, url as target_uri, coalesce(html, '') as html,
         {_sql_id("response", "coalesce(page_id::varchar, '') || '|' || coalesce(url, '')")} as response_id
  from pages),
d as (
  select *, {_sql_text("html")} as t, {_sql_id("conversion", "response_id")} as conversion_id,
         trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '\\s+', ' ', 'g')) as title,
         len(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref=')) as links
  from r),
b as (
  select *, 'metadata' as warc_type, {_sql_id("metadata", "response_id")} as record_id, 'application/warc-fields' as content_type,
         'title: ' || title || {_CRLF} || 'links: ' || links || {_CRLF} || 'text-length: ' || length(t) || {_CRLF}
         || 'conversion: ' || conversion_id || {_CRLF} as block from d
  union all
  select *, 'conversion', conversion_id, 'text/plain; charset=utf-8', t from d)
select page_id, warc_type, record_id, response_id as refers_to, target_uri, content_type, 'sha256:' || sha256(html) as source_digest,
       'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || strlen(html)
       as source_headers, strlen(block)::bigint as content_length, 'sha256:' || sha256(block) as block_digest, true as intact
from b
"""
