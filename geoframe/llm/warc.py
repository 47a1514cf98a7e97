"""A content-addressed archive of web captures.

An archive is a folder of two tables.  ``payloads`` holds the bytes of each different payload
once, under its SHA-256.  ``heads`` holds the exact bytes that come before the payload in each
WARC record: the record's named fields, the empty line and the HTTP header.  A join of the two
gives back the original records.  A digest is verified on both ways: rows that meet under one
SHA-256 must agree in SHA-1 and length when they are stored, and what is read is hashed again
and held against its key and the head's digest and length; anything else is an error.

Of the records that share a payload of at least ``min_bytes`` bytes the one with the largest
page_id is a response, the others are revisits of it.  Records with smaller payloads are all
responses.

Plan: the payload crosses the network once, towards its digest, after each task has dropped its
own copies.  Heads are narrow.  A payload that many records share is a hot key of the joins, so
its records are dealt over parts by a hash of page_id, and its row is repeated once a part; the
keys with more than one part are at most ``HOT_KEYS`` and are broadcast.

Defined results: a null html is an empty payload; repeated rows are records of their own, and
one of those that tie for the largest page_id is the response; null ids come before all others.
CR and LF in a url are written as %0D and %0A, a null url as nothing.  An empty table gives an
empty archive and no rows.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, shared_folder

#: A key is split if it has more records than this, or than a share of 1 / HOT_KEYS of all.
PART_ROWS = 10_000
HOT_KEYS = 10_000
#: The tables of pages hold no time of capture.
DATE = "2000-01-01T00:00:00Z"
#: Fixed values of the format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four times forty bits, as eight digits of five bits."""
    digest = F.sha1(payload)
    digits = F.concat(*(F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)))
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _captures(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    named = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    return named.withColumns({"key": F.unhex(F.sha2("payload", 256)), "digest": base32_sha1(F.col("payload")), "n_bytes": F.octet_length("payload").cast("long")})


def _parted(known: DataFrame) -> DataFrame:
    """Adds ``parts``, into how many a key's records are dealt; ``known`` has key and n."""
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return known.withColumn("parts", F.ceil(F.col("n") / max(PART_ROWS, -(-total // HOT_KEYS))).cast("int"))


def _for_each_part(known: DataFrame) -> DataFrame:
    return known.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def _head(min_bytes: int, date: str) -> Column:
    """The bytes of a record before its payload."""
    revisit = F.col("record_type") == "revisit"
    page = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # a response's name follows from its payload, so that revisits can tell it
    name_of = lambda c, mark: F.concat(F.lit("<urn:page:"), page(c), F.lit(":"), mark, F.lit(">"))
    first = F.lower(F.hex("key"))
    own = F.lower(F.hex(F.xxhash64("page_id", "url", "key", "_row")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    return F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", name_of("page_id", F.when(revisit | (F.col("n_bytes") < min_bytes), own).otherwise(first))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name_of("keeper", first)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(END),
        http,
    ).cast("binary")


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = DATE, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes the two tables of an archive."""
    spark, captures = pages.sparkSession, _captures(pages, page_id, url, html)
    witness = F.struct("digest", "n_bytes")
    stored = captures.groupBy("key").agg(F.any_value("payload").alias("payload"), F.max("page_id").alias("keeper"), F.count("*").alias("n"), F.min(witness).alias("low"), F.max(witness).alias("high"))
    stored = stored.select("key", F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.lit("different payloads have one SHA-256"))).alias("payload"), "keeper", "n")
    stored.write.mode("errorifexists").parquet(f"{folder}/payloads")
    known = _parted(spark.read.parquet(f"{folder}/payloads").select("key", "keeper", "n"))
    hot = F.broadcast(known.filter("parts > 1").select("key", F.col("parts").alias("_parts")))
    dealt = captures.drop("payload").join(hot, "key", "left").withColumns({"part": F.pmod(F.xxhash64("page_id"), F.coalesce("_parts", F.lit(1))).cast("int"), "_row": F.monotonically_increasing_id()}).drop("_parts")
    # rows of one page_id are in one part, so a tie for the largest is settled there
    tie = F.row_number().over(Window.partitionBy("key", "part", "page_id").orderBy("url", "_row"))
    first = F.col("page_id").eqNullSafe(F.col("keeper")) & (tie == 1)
    typed = dealt.join(_for_each_part(known), ["key", "part"]).withColumn("record_type", F.when(first | (F.col("n_bytes") < min_bytes), "response").otherwise("revisit"))
    typed.select("key", "part", _head(min_bytes, date).alias("head")).write.mode("errorifexists").parquet(f"{folder}/heads")


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def _page_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, "^<urn:page:(-?[0-9]*):", 1), F.lit("")).cast("long")


def _sound(payload: Column, key: Column) -> Column:
    return F.when(F.unhex(F.sha2(payload, 256)) == key, payload).otherwise(F.raise_error(F.lit("a stored payload doesn't have its digest")))


def _parsed(heads: DataFrame) -> DataFrame:
    text = F.decode("head", "UTF-8")
    return heads.select(
        "key",
        "part",
        "head",
        _page_of(_field(text, "WARC-Record-ID")).alias("page_id"),
        _field(text, "WARC-Target-URI").alias("url"),
        _field(text, "WARC-Type").alias("record_type"),
        _page_of(_field(text, "WARC-Refers-To")).alias("refers_to"),
        _field(text, "WARC-Payload-Digest").alias("_digest"),
        _field(text, "Content-Length").cast("long").alias("_block"),
        F.octet_length(F.substring_index(F.substring(text, F.locate(END, text) + 4, 1 << 30), END, 1)).alias("_http"),
    )


def _checked(rows: DataFrame) -> DataFrame:
    """Rows of heads with facts of their payloads; a head that doesn't fit its payload is an error."""
    body = F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes"))
    fits = (F.col("_digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (F.col("_block") == F.col("_http") + 4 + body)
    return rows.withColumn("payload_digest", F.when(fits, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a head doesn't fit its payload"))))


def _archive(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    payloads = spark.read.parquet(f"{folder}/payloads").select("key", "n", _sound(F.col("payload"), F.col("key")).alias("payload"))
    return _parsed(spark.read.parquet(f"{folder}/heads")), _parted(payloads)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of each record.
    A payload is read and hashed once, however many records share it."""
    heads, payloads = _archive(spark, folder)
    facts = _for_each_part(payloads.select("key", "parts", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")))
    return _checked(heads.join(facts, ["key", "part"])).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The original records: page_id, url, record_type, refers_to, payload (in full for revisits,
    too) and record, the exact bytes, without the two line ends that close a record."""
    heads, payloads = _archive(spark, folder)
    facts = _for_each_part(payloads.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))}))
    joined = _checked(heads.join(facts, ["key", "part"]))
    whole = F.when(F.col("record_type") == "revisit", F.col("head")).otherwise(F.concat("head", "payload"))
    return joined.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", whole.alias("record"))


def export(spark: SparkSession, folder: str, out: str) -> None:
    """Writes an archive's records as plain WARC files, as many as the join has tasks.  Payloads
    are UTF-8, so the writer of texts takes a record as a line that ends as records do."""
    records(spark, folder).select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).text(out)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes an archive into the shared folder, digests what it holds and removes it."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/geoframe-warc-{uuid.uuid4().hex}"
    write_archive(pages, folder)
    out = cut(digests(spark, folder).drop("url"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out
