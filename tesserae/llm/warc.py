"""Content-addressed WARC archive: payloads once by strong digest, exact record headers apart, records rebuilt by joins.

An archive is two tables in one folder.  payloads has (address, payload), each
payload once, under its SHA-256; headers has one row per record: its exact
header block, the address of its payload and its type.  Of the records with
equal payloads the one with the largest page_id is the response and carries the
payload; the others are revisits and refer to it.  read_records rebuilds the
exact bytes of each record, after every stored payload has been hashed anew and
compared with its address.

Nulls and odd cases: a null html is an empty payload, a null url an empty target
URI; a null page_id is written as 'null', is read as null and loses against any
number.  Rows that are repeated in full are one record that is returned as often
as it came; rows that share page_id and payload but not the url are all of the
same type.  Payloads below the size limit are all responses.  A URL of any
characters is read back as it was.  Columns beyond page_id, url and html are not
archived, whatever their names.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.storage import NO_ID, restricted, stored, table_path

CRLF = "\r\n"
#: Payloads of at least this many bytes are told apart by digest; smaller ones are always written out.
LEAST_REVISIT = 0


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four pieces of 40 bits, each eight digits to the base 32."""
    hexed = F.sha1(payload)
    pieces = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*pieces)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _payload() -> Column:
    return F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")


def addressed(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, sha1, address) for each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), _payload().alias("payload"))
    return rows.select("page_id", "url", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("sha1"), F.sha2("payload", 256).alias("address"))


#: In a URI with a line break, '%' and the line breaks are percent-encoded, which this field tells the reader.
ENCODED = "X-Target-URI-Encoding: percent"


def _uri_lines(url: Column) -> Column:
    broken = url.contains("\r") | url.contains("\n")
    safe = F.replace(F.replace(F.replace(url, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit("WARC-Target-URI: "), F.when(broken, F.concat(safe, F.lit(CRLF + ENCODED))).otherwise(url))


def write_archive(pages: DataFrame, path: str, least: int = LEAST_REVISIT, date: str | None = None) -> str:
    """Writes headers and payloads of pages (page_id, url, html) under path and returns path.

    date is the WARC-Date of all records (the time of the call, in UTC, if not
    given).  Pages are hashed once and their digests stored.  Which page is the
    response follows from an aggregation by address, done within partitions
    first; headers are shuffled without payloads.  Of the pages, only those
    that carry a payload are read again; their ids are broadcast when few
    (restricted), else joined by a shuffle.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    light = stored(addressed(pages), "digests")
    responses = stored(light.groupBy("address").agg(F.max("page_id").alias("response")), "responses")
    typed = light.join(responses, "address")
    revisit = (F.col("payload_bytes") >= least) & F.coalesce(F.col("page_id") != F.col("response"), F.col("response").isNotNull())
    typed = typed.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    lines = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        _uri_lines(F.col("url")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("response")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes")).cast("string")),
    )
    header = F.encode(F.concat(lines, F.lit(CRLF * 2)), "UTF-8")
    typed.select("page_id", "record_type", "address", header.alias("header")).write.parquet(f"{path}/headers")
    keys = responses.select(F.coalesce("response", F.lit(NO_ID)).alias("_id"))
    named = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("_id"), _payload().alias("payload"))
    carriers = restricted(named, keys, ["_id"]).select(F.sha2("payload", 256).alias("address"), "payload")
    n = light.agg(F.count("*").alias("rows"), F.count_distinct(F.coalesce("page_id", F.lit(NO_ID))).alias("ids")).first()
    if n["rows"] > n["ids"]:  # of rows that share an id, several may carry one payload
        carriers = carriers.dropDuplicates(["address"])
    carriers.write.parquet(f"{path}/payloads")
    return path


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(address, record_type, record): the exact bytes of each record of an archive.

    A revisit's record is its header.  A stored payload whose SHA-256 is not its
    address stops the job.
    """
    headers = spark.read.schema("page_id long, record_type string, address string, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")
    checked = payloads.select(
        "address",
        F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its address "), F.col("address"))).cast("binary")).alias("payload"),
    )
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    responses = headers.filter("record_type = 'response'").join(checked, "address").select("address", "record_type", F.concat("header", "payload", end).alias("record"))
    revisits = headers.filter("record_type = 'revisit'").select("address", "record_type", F.concat("header", end).alias("record"))
    return responses.unionByName(revisits)


def parsed(records: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, digest, date, payload_bytes, payload_sha1) read from record bytes.

    The header ends at the first empty line and is cut at CR LF alone, so no
    other line end and no byte of a URI is taken for one; a field is the first
    line that begins with its name.  What follows up to Content-Length is the
    payload, whose digest is taken anew.
    """
    # Latin-1 keeps byte places; the header is text in UTF-8
    head = F.substring_index(F.decode("record", "ISO-8859-1"), CRLF * 2, 1)
    rows = records.select("record", head.alias("head")).select("record", F.length("head").alias("head_bytes"), F.split(F.decode(F.encode("head", "ISO-8859-1"), "UTF-8"), CRLF).alias("lines"))

    def field(name: str) -> Column:
        line = F.get(F.filter("lines", lambda x: F.startswith(x, F.lit(f"{name}: "))), F.lit(0))
        return F.coalesce(F.substring(line, len(name) + 3, 2**31 - 1), F.lit(""))

    url = field("WARC-Target-URI")
    plain = F.replace(F.replace(F.replace(url, F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))
    body = F.substring("record", F.col("head_bytes") + 5, field("Content-Length").cast("int"))
    page = lambda x: F.expr(f"try_cast(regexp_extract({x}, '<urn:page:(.*)>', 1) as bigint)")
    rows = rows.select(
        F.when(F.array_contains("lines", ENCODED), plain).otherwise(url).alias("url"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Record-ID").alias("own_id"),
        field("WARC-Refers-To").alias("refers"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        field("WARC-Date").alias("date"),
        F.when(field("WARC-Type") == "response", body).alias("payload"),
    )
    return rows.select(
        page("own_id").alias("page_id"),
        "url",
        "record_type",
        page("refers").alias("refers_to"),
        "digest",
        "date",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("payload").isNotNull(), base32_sha1(F.col("payload"))).alias("payload_sha1"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes an archive of pages into the shared folder and returns what its records say.

    Sizes and digests are those of the payloads as read back; a revisit has
    those of the response that carries its digest.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = write_archive(pages, table_path(spark, "warc"))
    # the records are put together and parsed once; what they say is small
    read = stored(parsed(read_records(spark, path)), "records")
    responses = read.filter("record_type = 'response'").select("page_id", "record_type", F.col("payload_sha1").alias("payload_digest"), "payload_bytes", F.lit(None).cast("long").alias("refers_to"))
    carried = read.filter("record_type = 'response'").groupBy(F.col("payload_sha1").alias("carried_sha1")).agg(F.max("payload_bytes").alias("carried_bytes"))
    revisits = (
        read.filter("record_type = 'revisit'")
        .join(carried, F.col("digest") == F.col("carried_sha1"))
        .select("page_id", "record_type", F.col("digest").alias("payload_digest"), F.col("carried_bytes").alias("payload_bytes"), "refers_to")
    )
    return responses.unionByName(revisits)


ORACLE = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, unhex(sha1(b)) AS h, sha256(b) AS a FROM p),
-- base32 of 20 bytes, five bits at a time
bits AS (SELECT page_id, n, a, string_agg(lpad(bin(CAST(('0x' || substr(hex(h), 2 * i + 1, 2)) AS INTEGER)), 8, '0'), '' ORDER BY i) AS s FROM (SELECT *, unnest(range(0, 20)) AS i FROM d) GROUP BY page_id, n, a),
dig AS (SELECT page_id, n, a, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_sum(list_transform(range(0, 5), lambda k: CAST(substr(s, 5 * j + k + 1, 1) AS INTEGER) * CAST(pow(2, 4 - k) AS INTEGER)))::INTEGER + 1, 1), '' ORDER BY j) AS digest
  FROM (SELECT *, unnest(range(0, 32)) AS j FROM bits) GROUP BY page_id, n, a),
r AS (SELECT *, max(page_id) OVER (PARTITION BY a) AS top FROM dig)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM r"""
