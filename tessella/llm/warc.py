"""Content-addressed web archive.

The archive has two tables. `payloads` holds the bytes of each distinct payload once, under their SHA-256; `records`
holds the exact header of every record (WARC header and HTTP head) and the digest of its payload. Reading joins the
two, recomputes the digests of the stored bytes and fails if one differs, and puts the original records together.

Of equal payloads of at least `least` bytes, the record of the largest id is a response and the others revisit it.

Line ends in a URL are percent-encoded in the header, each as itself. The date of a record is that of a column, or DATE.
`export_warc` writes the records as files that other tools read.

Defined results: a null payload is empty; payloads of any length are kept whole; rows that tie on the largest id are all
responses (their payload is dealt over several tasks if they are many); a null id is smaller than any other, and a group
of null ids only is all responses; repeated rows are records of their own; null URLs are empty; extra columns are ignored;
an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import HOT_SHARE, as_bytes, join_groups, materialise
from tessella.storage import write_bytes

#: Payloads of fewer bytes are never revisited.
LEAST = 1000
#: Date of records where no column gives one; responses of one payload that are put together in one task.
DATE, SPREAD = "1970-01-01T00:00:00Z", 4096
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(c: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))


def _header() -> Column:
    """WARC header and HTTP head of a record, from id, url, date, sha1, size and refers_to."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n")
    )
    revisit = F.col("revisits")
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        _urn(F.col("id")),
        F.lit("\r\nWARC-Target-URI: "),
        F.replace(F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")),
        F.lit("\r\nWARC-Date: "),
        F.col("date"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("sha1"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("last_id")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        block.cast("string"),
        F.lit("\r\n\r\n"),
        http,
    ).cast("binary")


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date_col: str | None = None
) -> None:
    date = F.coalesce(F.date_format(date_col, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(DATE)) if date_col else F.lit(DATE)
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), date.alias("date"), as_bytes(payload_col).alias("payload"))
    sha256 = F.unhex(F.sha2("payload", 256))
    rows = materialise(
        source.select("id", "url", "date", sha256.alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    )
    groups = rows.groupBy("sha256").agg(F.max("id").alias("last_id"), F.count("*").alias("copies"))
    headers = join_groups(rows, groups, "sha256", "copies", rows.count()).withColumn(
        "revisits", (F.col("size") >= least) & F.col("last_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("last_id"))
    )
    headers.select("sha256", "revisits", _header().alias("header")).write.mode("overwrite").parquet(f"{path}/records")
    # Combined in each task before the shuffle, so that a payload of many rows travels once a task.
    source.select(sha256.alias("sha256"), "payload").groupBy("sha256").agg(F.first("payload").alias("payload"), F.count("*").alias("copies")).write.mode(
        "overwrite"
    ).parquet(f"{path}/payloads")


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha256, payload, copies, with the size and SHA-1 of the bytes read; fails where the bytes have another digest."""
    stored = spark.read.parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload differs from its digest "), F.hex("sha256"))).cast("binary")
    checked = stored.select(
        "sha256", F.when(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.col("payload")).otherwise(wrong).alias("payload"), "copies"
    )
    return checked.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})


def _field(name: str) -> Column:
    found = F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def _page(c: Column) -> Column:
    return F.regexp_extract(c, "^<urn:page:(.*)>$", 1)


def _with_bodies(responses: DataFrame, bodies: DataFrame, total: int, spread: int) -> DataFrame:
    """Responses with their payload; a payload of very many responses is sent to several tasks, each of which has some of them."""
    many = responses.groupBy("sha256").agg(F.ceil(F.count("*") / spread).cast("int").alias("tasks")).where(F.col("tasks") > max(1, int(total * HOT_SHARE) // spread))
    hot = materialise(many)  # 1 / HOT_SHARE rows at most
    plain = responses.join(F.broadcast(hot.select("sha256")), "sha256", "left_anti").join(bodies, "sha256")
    dealt = responses.join(F.broadcast(hot), "sha256").withColumn("task", F.pmod(F.xxhash64("header"), F.col("tasks")).cast("int")).drop("tasks")
    sent = bodies.join(F.broadcast(hot), "sha256").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    return plain.unionByName(dealt.join(sent, ["sha256", "task"]).drop("task"))


def read_archive(spark: SparkSession, path: str, least: int = LEAST, spread: int = SPREAD) -> DataFrame:
    """Every record put together again: id, record_type, refers_to (ids as text), url, payload_bytes, payload_digest, record.

    record holds the bytes of the WARC record: a response has its payload, a revisit has none. Size and digest of a
    response are those of the payload inside its record, of a revisit those of the stored payload; a header that names
    another digest fails.
    """
    records = spark.read.parquet(f"{path}/records")
    payloads = verified_payloads(spark, path)
    total = records.count()
    # Below `least` bytes every record has the payload itself; keys broadcast there are few and short. From there on
    # one record has it, and the many that revisit it need its size and digest only.
    short = payloads.where(F.col("payload_bytes") < least).select("sha256", "copies", "payload")
    bodies = payloads.where(F.col("payload_bytes") >= least).select("sha256", "payload")
    facts = payloads.where(F.col("payload_bytes") >= least).select("sha256", "copies", "payload_bytes", "payload_digest")
    whole = join_groups(records.where(~F.col("revisits")), short, "sha256", "copies", total).drop("copies")
    whole = whole.unionByName(_with_bodies(records.where(~F.col("revisits")), bodies, total, spread))
    end = F.lit(b"\r\n\r\n")
    inside = F.expr("substring(record, octet_length(header) + 1, octet_length(record) - octet_length(header) - 4)")
    whole = (
        whole.withColumn("record", F.concat("header", "payload", end))
        .withColumn("payload", inside)
        .select("header", "record", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    )
    again = join_groups(records.where("revisits"), facts, "sha256", "copies", total)
    again = again.select("header", F.concat("header", end).alias("record"), "payload_bytes", "payload_digest")
    agrees = _field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))
    return whole.unionByName(again).select(
        _page(_field("WARC-Record-ID")).alias("id"),
        _field("WARC-Type").alias("record_type"),
        _page(_field("WARC-Refers-To")).alias("refers_to"),
        _field("WARC-Target-URI").alias("url"),
        "payload_bytes",
        F.when(agrees, F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload have different digests"))).alias("payload_digest"),
        "record",
    )


def export_warc(spark: SparkSession, path: str, out: str, files: int = 1) -> None:
    """The archive as `files` files out/NNNNN.warc of whole records; records pass through the driver a partition at a time."""
    records = read_archive(spark, path).select("record", F.pmod(F.xxhash64("id", "record_type"), F.lit(files)).alias("file"))
    for k in range(files):
        write_bytes(spark, f"{out}/{k:05d}.warc", (bytes(r["record"]) for r in records.where(F.col("file") == k).toLocalIterator()))
