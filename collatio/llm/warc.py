"""Content-addressed web archive: payload bytes once by verified digest, exact record headers apart, records by a join."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_among, salted, scratch_path, table, written

REVISIT_FROM = 1000
#: Fixed value: the profile of records whose payload is that of another.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))


def _record_id(page: str, url: str, copy: Column) -> Column:
    """A name-based UUID of a row; ``copy`` numbers rows that are equal."""
    h = F.md5(F.concat_ws("\u0001", F.coalesce(F.col(page).cast("string"), F.lit("none")), "sha256", copy.cast("string"), F.coalesce(F.col(url), F.lit("\u0002"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4))], F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)), F.lit(">"))


def _target(page: str, url: str) -> Column:
    """The url without blanks and control characters, which a header line cannot hold; a page without a url is named by its id."""
    clean = F.regexp_replace(F.regexp_replace(F.col(url), "[\r\n]", "%0A"), r"[\x00-\x20\x7F]", "%20")
    return F.when(F.coalesce(clean, F.lit("")) != "", clean).otherwise(F.concat(F.lit("urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("none"))))


def write_archive(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM, date: str | None = None) -> None:
    """Writes ``path/payloads`` (sha256, payload) and ``path/headers`` (page_id, sha256, header).

    A header is all of a WARC/1.1 record before the payload: its own lines, with an id of its own, and those of the HTTP response that carries the payload.
    ``date`` (ISO 8601, UTC) is when the pages were fetched, by default now.

    A payload is the html in UTF-8, null as empty. Payloads of one SHA-256 must agree in length, SHA-1 and
    MD5 too, else the write fails: a digest stands for its bytes only where that is verified. Of the records of one
    payload of at least ``revisit_from`` bytes the one with the largest page_id is the response and the others
    revisit it; rows that repeat that largest page_id are responses all. Null page_ids rank lowest, and if a payload has no other,
    all its records are responses. A null or empty url is replaced by the page's id; other columns are ignored; an empty table gives an empty archive.
    Rows of a payload that very many pages share are dealt over several tasks.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    hashed = rows.select("*", F.sha2("payload", 256).alias("sha256"))
    narrow = hashed.select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"), F.md5("payload").alias("md5"), F.octet_length("payload").alias("size"))
    groups = narrow.groupBy("sha256").agg(
        F.max("page_id").alias("owner"), F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("c"),
        F.min("sha1").alias("s0"), F.max("sha1").alias("s1"), F.min("md5").alias("m0"), F.max("md5").alias("m1"), F.min("size").alias("z0"), F.max("size").alias("z1"),
    )
    same = (F.col("s0") == F.col("s1")) & (F.col("m0") == F.col("m1")) & (F.col("z0") == F.col("z1"))
    groups = groups.select("sha256", "c", F.when(same, F.col("owner")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256"))).alias("owner"), F.col("first.url").alias("owner_url"))
    groups = written(groups, "groups")
    hashed.groupBy("sha256").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    equal = narrow.groupBy("page_id", "url", "sha256", "sha1", "size").agg(F.count("*").alias("copies"))
    hot = hot_among(groups, "c", groups.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    rows = salted(equal, groups.drop("c"), ["sha256"], hot, ["page_id", "url"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    revisit = (F.col("size") >= revisit_from) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    page = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _line("Content-Type", "text/html; charset=utf-8"), _line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    again = F.concat(
        _line("WARC-Profile", PROFILE), _line("WARC-Refers-To", _record_id("owner", "owner_url", F.lit(0))), _line("WARC-Refers-To-Target-URI", _target("owner", "owner_url")),
        _line("WARC-Refers-To-Date", date), _line("Refers-To-Page-ID", page("owner")),
    )
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id("page_id", "url", F.col("copy"))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", _target("page_id", "url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("Page-ID", page("page_id")),
        F.when(revisit, again).otherwise(F.lit("")),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")),
        F.lit("\r\n"), http,
    )
    rows.select("page_id", "sha256", F.encode(header, "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records: page_id, record_type, payload_bytes, payload_digest, refers_to, header, record (header, payload unless it is a revisit, end), payload.

    The stored bytes are hashed again; bytes that differ from their digest fail the read. Digest and length come from the bytes that were read.
    Records one after the other are a WARC file.
    """
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("sha256")).otherwise(F.raise_error(F.lit("a stored payload differs from its digest")))
    stored = stored.select(sound.alias("sha256"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    heads = spark.read.schema("page_id long, sha256 string, header binary").parquet(f"{path}/headers")
    often = hot_among(heads.groupBy("sha256").agg(F.count("*").alias("c")), "c", heads.count())
    said = F.decode("header", "UTF-8")
    refers = F.regexp_extract(said, r"\r\nRefers-To-Page-ID: (-?\d+)\r\n", 1)
    heads = heads.select("page_id", "sha256", "header", F.regexp_extract(said, r"^WARC/1\.1\r\nWARC-Type: (\w+)", 1).alias("record_type"), F.when(refers != "", refers.cast("long")).alias("refers_to"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return salted(heads, stored, ["sha256"], often, ["page_id"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "header", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"), "payload"
    )


def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to an archive in the shared folder and reads every record back."""
    path = scratch_path(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ARCHIVED_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS owner FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM q
"""
