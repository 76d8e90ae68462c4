"""A content-addressed WARC archive.

The archive keeps every payload once, under its SHA-256, and the exact header of every
record in a table of its own.  Reading joins the two back into the original records.

    <path>/headers    id, strong (SHA-256), header (all bytes of the record before its payload), has_payload
    <path>/payloads   strong, payload, bytes, uses (records that hold the payload itself)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geocurate.llm.common import join_lookup
from geocurate.runtime import stage

# Fixed values of the format, WARC/1.1.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEW_LINE = "\r\n"
BLANK_LINE = "\r\n\r\n"
ID_FORM = "urn:page:"
#: Pages name no time of capture; a parameter of `write_archive` replaces this one.
NO_DATE = "1970-01-01T00:00:00Z"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(NEW_LINE))


def _one_line(text: Column) -> Column:
    """Text that fits on a header line: control characters percent-encoded, as line ends are in a URL."""
    text = F.replace(F.replace(text, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", "%20")


def _record_id(id_value: Column) -> Column:
    return F.concat(F.lit(f"<{ID_FORM}"), F.coalesce(id_value.cast("string"), F.lit("")), F.lit(">"))


def _header(page: Column, url: Column, bytes_: Column, sha1: Column, refers_to: Column, date: str) -> Column:
    """Record header and HTTP header, up to the payload."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{NEW_LINE}Content-Type: text/html; charset=utf-8{NEW_LINE}Content-Length: "),
        bytes_.cast("string"), F.lit(BLANK_LINE),
    )
    block_bytes = F.length(F.encode(http, "UTF-8")) + F.when(refers_to.isNull(), bytes_).otherwise(F.lit(0))
    revisit = F.concat(
        _line("WARC-Type", F.lit("revisit")),
        _line("WARC-Profile", F.lit(REVISIT_PROFILE)),
        _line("WARC-Refers-To", _record_id(refers_to)),
    )
    return F.concat(
        F.lit(f"WARC/1.1{NEW_LINE}"),
        F.when(refers_to.isNull(), _line("WARC-Type", F.lit("response"))).otherwise(revisit),
        _line("WARC-Record-ID", _record_id(page)),
        F.coalesce(_line("WARC-Target-URI", _one_line(url)), F.lit("")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block_bytes.cast("string")),
        F.lit(NEW_LINE),
        http,
    )


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_bytes: int = 1000, date: str = NO_DATE,
) -> None:
    """Write one record per row of *pages* to a new archive at *path*.

    Of rows with equal payloads of at least ``min_bytes`` bytes, that with the largest id is
    a response and the others are revisits that refer to it; all other rows are responses.

    A null payload counts as empty, a null URL leaves out its line.  A row with a null id is
    a revisit where its payload has a response with an id, else a response.  Rows that
    repeat id and payload of a response are responses too.  Empty tables give an empty
    archive.  Payloads with equal SHA-256 are compared by length and a second hash; a
    difference fails the write.  Payloads cross the network once, summed up per task
    first, so a payload that a third of all pages share costs as little as any other.
    """
    body = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("payload")).withColumns(
        {"strong": F.unhex(F.sha2("payload", 256)), "bytes": F.length("payload").cast("long")}
    )
    narrow = stage(
        rows.select("id", "url", "strong", "bytes", F.sha1("payload").alias("sha1"), F.xxhash64("payload").alias("second")),
        "warc_rows",
    ).df
    groups = stage(
        narrow.groupBy("strong").agg(
            F.max("id").alias("holder"), F.count(F.lit(1)).alias("copies"), F.max("bytes").alias("bytes"),
            ((F.min("bytes") == F.max("bytes")) & (F.min("second") == F.max("second"))).alias("same"),
        ),
        "warc_groups",
    ).df
    if not groups.filter("NOT same").isEmpty():
        raise ValueError("payloads differ although their SHA-256 digests are equal")
    joined = join_lookup(narrow.drop("bytes"), groups, "strong", "copies")
    revisits = (F.col("bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("holder"))
    refers_to = F.when(revisits, F.col("holder"))
    joined.select(
        "id", "strong", refers_to.isNull().alias("has_payload"),
        _header(F.col("id"), F.col("url"), F.col("bytes"), F.col("sha1"), refers_to, date).alias("header"),
    ).write.parquet(f"{path}/headers")
    once = rows.groupBy("strong").agg(F.any_value("payload").alias("payload"), F.count(F.lit(1)).alias("uses"))
    once.select(
        "strong", "payload", F.length("payload").cast("long").alias("bytes"),
        F.when(F.length("payload") >= min_bytes, F.lit(1)).otherwise(F.col("uses")).cast("long").alias("uses"),
    ).write.parquet(f"{path}/payloads")


def read_records(spark: SparkSession, path: str, min_bytes: int = 1000) -> DataFrame:
    """The original records, byte for byte: (id, record BINARY).

    Payloads of fewer than ``min_bytes`` bytes may serve any number of records; those that
    serve a thousandth of all are at most a thousand, so at most a megabyte is broadcast.
    Every other payload goes to few records, by a shuffle.  Each payload is checked
    against its digest once; damage fails the read.
    """
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    whole = F.unhex(F.sha2("payload", 256)) == F.col("strong")
    damaged = F.raise_error(F.lit("a stored payload doesn't match its digest")).cast("binary")
    payloads = payloads.withColumn("payload", F.when(whole, F.col("payload")).otherwise(damaged))
    end = F.lit(BLANK_LINE).cast("binary")
    first = F.encode("header", "UTF-8")
    small, large = payloads.filter(F.col("bytes") < min_bytes), payloads.filter(F.col("bytes") >= min_bytes)
    with_payload = headers.filter("has_payload").select("id", "strong", "header")
    full = join_lookup(with_payload, small, "strong", "uses").unionByName(with_payload.join(large.hint("merge"), "strong"))
    return full.select("id", F.concat(first, F.col("payload"), end).alias("record")).unionByName(
        headers.filter("NOT has_payload").select("id", F.concat(first, end).alias("record"))
    )


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?im)^{name}: *(.*?)\r?$", 1), F.lit(""))


def parse_records(records: DataFrame) -> DataFrame:
    """Parse record bytes: (page_id, record_type, uri, refers_to, payload_digest, payload BINARY).

    Bytes are read as Latin-1, so that positions are byte positions.  A length or digest
    that doesn't fit the bytes fails the read.  ``payload`` is null for revisits;
    ``payload_digest`` is the header's, which for responses is that of the payload.
    """
    text = records.select(F.decode("record", "ISO-8859-1").alias("t"))
    text = text.withColumn("head", F.substring_index("t", BLANK_LINE, 1))
    text = text.withColumn("block", F.expr("substring(t, length(head) + 5)")).withColumn(
        "stated", _field("Content-Length").cast("long")
    )
    fits = (F.length("block") == F.col("stated") + 4) & F.endswith("block", F.lit(BLANK_LINE))
    is_response = _field("WARC-Type") == "response"
    http = F.substring_index("block", BLANK_LINE, 1)
    payload = F.encode(F.substring(F.col("block"), F.length(http) + 5, F.col("stated").cast("int") - F.length(http) - 4), "ISO-8859-1")
    page = F.regexp_extract(_field("WARC-Record-ID"), rf"<{ID_FORM}(-?\d*)>", 1)
    target = F.regexp_extract(_field("WARC-Refers-To"), rf"<{ID_FORM}(-?\d*)>", 1)
    parsed = text.select(
        F.nullif(page, F.lit("")).cast("long").alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        F.decode(F.encode(_field("WARC-Target-URI"), "ISO-8859-1"), "UTF-8").alias("uri"),
        F.nullif(target, F.lit("")).cast("long").alias("refers_to"),
        F.regexp_extract(_field("WARC-Payload-Digest"), r"sha1:(\w+)", 1).alias("payload_digest"),
        F.when(is_response, F.when(fits, payload).otherwise(F.raise_error(F.lit("a record's length is wrong")).cast("binary")))
        .alias("payload"),
    )
    good = F.col("payload").isNull() | (F.sha1("payload") == F.col("payload_digest"))
    return parsed.withColumn(
        "payload_digest", F.when(good, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload's digest is wrong")))
    )


def describe(parsed: DataFrame) -> DataFrame:
    """One row per record with the length and digest of the full payload, for revisits that of the response."""
    columns = ["page_id", "record_type", "refers_to", "payload_digest"]
    told = stage(parsed.select(*columns, F.length("payload").cast("long").alias("payload_bytes")), "warc_told").df
    revisits = told.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    uses = revisits.groupBy("refers_to").agg(F.count(F.lit(1)).alias("uses"))
    originals = (
        told.filter("record_type = 'response'")
        .select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
        .join(uses, "refers_to")
    )
    found = join_lookup(revisits, stage(originals, "warc_originals").df, "refers_to", "uses").drop("uses")
    return told.filter("record_type = 'response'").unionByName(found)
