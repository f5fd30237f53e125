"""WARC files: written by Spark's text writer, read back by boundary chains.

A record's bytes are a row of text and its end mark is the line separator, so
the writer's commit protocol covers the archives.  The reader takes byte
ranges of them, parted at the record mark wherever it stands, also inside
payloads: each piece that begins like a header claims the place of its
successor.  Claims of the place where the very next piece begins join pieces
into runs; pointer jumping over the other claims, from the start of each file,
keeps the runs that the chain reaches and where it enters them, so a mark
inside a payload is never taken for a record.  A task holds one piece at a
time, and rounds grow with the logarithm of the marks inside payloads, not with
the number of records.  Columns and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspan.llm.common import broadcast_small, discard, materialize, scratch_path

MARK, END = "WARC/1.0\r\n", "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
MIN_BYTES = 0
#: Bytes of a file, about; a larger task writes several.
FILE_BYTES = 256 << 20
#: Without it Spark cuts files by the number of cores that it has just then.
SPLITS = "spark.sql.files.minPartitionNum"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest_of(payload: Column) -> Column:
    """SHA-1 in base 32: each five digits of the hexadecimal form are four."""

    def four(digits: Column, i: int) -> Column:
        group = F.conv(F.substr(digits, F.lit(5 * i + 1), F.lit(5)), 16, 10).cast("int")
        return F.transform(F.array(group), lambda g: F.concat(*[F.substr(F.lit(BASE32), F.call_function("shiftright", g, F.lit(x)).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for x in (15, 10, 5, 0)]))[0]

    # a name bound by a function of an array is worked out once, and not for every digit
    return F.transform(F.array(F.sha1(payload)), lambda d: F.concat(*[four(d, i) for i in range(8)]))[0]


def _uri(url: Column) -> Column:
    """The url with control characters and spaces escaped."""
    escaped = reduce(lambda x, i: F.replace(x, F.lit(chr(i)), F.lit(f"%{i:02X}")), [*range(33), 127], url)
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), escaped).when(url != "", url)


def record(page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """A response record, or a revisit record without payload."""
    revisit, line = refers_to.isNotNull(), lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x], F.lit("\r\n"))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP), payload))
    return F.concat(
        F.lit(MARK),
        line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID: <urn:page:", F.coalesce(page_id.cast("string"), F.lit("null")), ">"),
        line(f"WARC-Date: {DATE}"),
        F.coalesce(line("WARC-Target-URI: ", _uri(url)), F.lit("")),
        line("WARC-Payload-Digest: sha1:", digest),
        F.coalesce(line("WARC-Refers-To: <urn:page:", refers_to.cast("string"), f">\r\nWARC-Profile: {PROFILE}"), F.lit("")),
        line("X-Payload-Length: ", F.octet_length(payload).cast("string")),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write(pages: DataFrame, out: str, *, min_bytes: int = MIN_BYTES, records_per_file: int | None = None) -> None:
    """Archives of (page_id, url, html) at ``out``.  Of equal payloads of at
    least ``min_bytes`` the one with the largest page_id is stored.  A task
    writes files of ``records_per_file`` (one file if 0); None means as many as
    make about FILE_BYTES at the table's mean."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    src = src.withColumn("digest", digest_of(F.col("html").cast("binary")))
    seen = Observation()
    measured = src.observe(seen, F.count("*").alias("n"), F.sum(F.octet_length("html").cast("long")).alias("bytes"))
    kept = measured.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("digest", "keeper")
    kept = materialize(kept, "repeated")
    if records_per_file is None and src.isEmpty():
        records_per_file = 0
    elif records_per_file is None:
        records_per_file = max(1, FILE_BYTES * (seen.get["n"] or 0) // max(1, (seen.get["bytes"] or 0) + 500 * (seen.get["n"] or 0)))
    rows = src.join(broadcast_small(kept, F.lit(100)), "digest", "left")
    refers = F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper"))
    rows.select(record(F.col("page_id"), F.col("url"), F.col("html"), F.col("digest"), refers).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(out)
    discard(kept)


@contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """Two scans of the same files inside cut them at the same places, whatever
    executors come or go meanwhile, so that their rows have the same numbers."""
    before = spark.conf.get(SPLITS, None)
    spark.conf.set(SPLITS, before or str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SPLITS)
        else:
            spark.conf.set(SPLITS, before)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between record marks, in byte ranges of the archives:
    (file, split, row, value); split and row give the order in a file."""
    text = spark.read.option("lineSep", MARK).option("pathGlobFilter", "part-*").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")


def _field(header: Column, name: str, value: str = "([^\r\n]*)") -> Column:
    found = F.regexp_extract(header, f"(?:^|\r\n){name}: {value}(?:\r\n|$)", 1)
    return F.when(found != "", found)


def _bytes(value: Column, start: Column, length: Column | int) -> Column:
    """``length`` bytes after the first ``start``."""
    return F.substring(value.cast("binary"), (start + 1).cast("int"), length if isinstance(length, Column) else F.lit(length))


def _payload(value: Column, head: Column, length: Column, kind: Column) -> Column:
    """What follows the inner header of a response's block."""
    block = _bytes(value, head + 4, length.cast("int")).cast("string")
    inner = F.octet_length(F.substring_index(block, END, 1))
    return F.when((kind == "response") & F.contains(block, F.lit(END)), _bytes(block, inner + 4, F.lit(2**31 - 1)))


def places(pieces: DataFrame) -> DataFrame:
    """A row for each piece after a mark: (file, at, next, run, linked and what
    the piece says).  ``at`` is the place of its mark, ``next`` where its
    successor would start (NULL if it is no header); pieces of a run each claim
    the one after.  Of records that lie in one piece the payload is hashed."""
    value, mark = F.col("value"), len(MARK)
    head = F.substring_index(value, END, 1)
    rows = pieces.withColumns({"size": F.octet_length("value").cast("long"), "head": F.octet_length(head).cast("long"), "length": F.when(F.contains(value, F.lit(END)), _field(head, "Content-Length", "([0-9]{1,10})").try_cast("int"))})
    ends = F.col("head") + 4 + F.col("length") + 4
    kind = _field(head, "WARC-Type")
    good = (ends > F.col("size")) | (_bytes(value, ends - 4, 4) == F.lit(END).cast("binary"))
    rows = rows.withColumns({"ends": F.when(good, ends), "record_type": kind, "body": F.when(ends <= F.col("size"), _payload(value, F.col("head"), F.col("length"), kind))})
    page = lambda name: _field(head, name, "<urn:page:(-?[0-9]{1,19})>").try_cast("long")
    rows = rows.select(
        "file", "split", "row", "size", "head", "length", "ends", "record_type", page("WARC-Record-ID").alias("page_id"), page("WARC-Refers-To").alias("refers_to"), _field(head, "X-Payload-Length", "([0-9]{1,18})").try_cast("long").alias("stated_bytes"),
        _field(head, "WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("stated_digest"), F.octet_length("body").cast("long").alias("payload_bytes"), F.when(F.col("body").isNotNull(), digest_of(F.col("body"))).alias("payload_digest"),
    )
    order = W.partitionBy("file").orderBy("split", "row")
    rows = rows.withColumn("at", F.coalesce(F.sum(F.col("size") + mark).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - mark)
    rows = rows.withColumn("next", F.col("at") + mark + F.col("ends")).withColumn("linked", F.coalesce(F.col("next") == F.col("at") + mark + F.col("size"), F.lit(False)))
    fresh = (~F.lag("linked", 1, False).over(order)).cast("long")
    return rows.withColumn("run", F.sum(fresh).over(order)).where("at >= 0").drop("split")


def reachable(chain: DataFrame) -> DataFrame:
    """(file, run, entry) of the runs that the chain from each file's start
    reaches, and the place at which it enters them.  ``chain`` holds file, at,
    next, size and run.  Pointers double their reach each round, until none is
    left; a pointer to a place where no mark stands ends there."""
    last = chain.groupBy("file", "run").agg(F.max_by("next", "at").alias("next"))
    jump = last.where("next is not null").join(chain.select("file", F.col("at").alias("next"), F.col("run").alias("to")), ["file", "next"]).select("file", "run", "to", F.col("next").alias("entry"))
    jump = materialize(jump, "jumps")
    known = materialize(chain.where("at = 0").select("file", "run", F.col("at").alias("entry")), "reached")
    while not jump.isEmpty():
        known_ = materialize(known.union(known.select("file", "run").join(jump, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")), "reached")
        over = jump.select("file", F.col("run").alias("to"), F.col("to").alias("over"), F.col("entry").alias("far"))
        jump_ = materialize(jump.join(over, ["file", "to"]).select("file", "run", F.col("over").alias("to"), F.col("far").alias("entry")), "jumps")
        discard(known)
        discard(jump)
        known, jump = known_, jump_
    return known


def _spanning(pieces: DataFrame, found: DataFrame, real: DataFrame) -> DataFrame:
    """(file, at, found, whole_bytes, whole_digest) of records whose payload holds
    marks: their pieces are read again and put together.  The rows of a scan of
    the same files keep their numbers; a piece of another size is an error."""
    own = real.where("ends > size").select("file", "at", F.struct(F.col("at").alias("owner"), F.col("next").alias("until"), "head", "length", "record_type").alias("own"))
    # an owner's pieces lie between its mark and the place that it claims
    last = F.last("own", ignorenulls=True).over(W.partitionBy("file").orderBy("at"))
    both = found.select("file", "at", "row", "size").join(own, ["file", "at"], "left").withColumn("own", last).where("at < own.until")
    wanted = materialize(both.select("file", "at", "row", "size", "own.*").drop("until"), "parts")
    same = F.when(F.octet_length("value") == F.col("size"), F.col("value")).otherwise(F.raise_error(F.lit("an archive changed while it was read")))
    parts = pieces.select("file", "row", "value").join(broadcast_small(wanted, F.lit(200)), ["file", "row"]).select("file", "owner", "head", "length", "record_type", F.struct("at", same.alias("value")).alias("part"))
    whole = parts.groupBy("file", "owner", "head", "length", "record_type").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    body = _payload(F.array_join(F.col("parts.value"), MARK), F.col("head"), F.col("length"), F.col("record_type"))
    whole = whole.select("file", F.col("owner").alias("at"), body.alias("body"))
    out = whole.select("file", "at", F.lit(True).alias("found"), F.octet_length("body").cast("long").alias("whole_bytes"), F.when(F.col("body").isNotNull(), digest_of(F.col("body"))).alias("whole_digest"))
    return materialize(out, "spanning")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives written here: page_id, payload_bytes,
    payload_digest, record_type and refers_to.

    A response's length and digest are those of the payload read; a revisit's
    are those that its header states of the full payload.  A file may hold any
    number of records; after a damaged record its chain ends.
    """
    with same_splits(spark):
        pieces = _pieces(spark, path)
        found = materialize(places(pieces), "places")
        reached = materialize(reachable(found), "runs")
        real = found.join(broadcast_small(reached, F.lit(200)), ["file", "run"]).where("at >= entry and next is not null")
        spanning = _spanning(pieces, found, real) if real.where("ends > size").limit(1).count() else None
    if spanning is not None:
        lost = F.when((F.col("ends") > F.col("size")) & (F.col("record_type") == "response") & F.col("found").isNull(), F.raise_error(F.lit("a record's payload was not found again")))
        real = real.join(spanning, ["file", "at"], "left").withColumns({"payload_bytes": F.coalesce(lost.cast("long"), "whole_bytes", "payload_bytes"), "payload_digest": F.coalesce("whole_digest", "payload_digest")})
    return real.select("page_id", F.coalesce("payload_bytes", "stated_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "stated_digest").alias("payload_digest"), "record_type", "refers_to")


def roundtrip(pages: DataFrame, *, min_bytes: int = MIN_BYTES, records_per_file: int | None = None) -> DataFrame:
    """write() to the shared folder, then read().

    NULL html is an empty payload; a NULL or odd url is left out or escaped; a
    NULL page_id stays NULL and is no revisit's target; rows that repeat the
    largest page_id of a payload are all responses; payloads may hold record
    marks, any length and any line ends; an empty table gives no row; other
    columns are not read.
    """
    out = scratch_path(pages.sparkSession, "warc")
    write(pages, out, min_bytes=min_bytes, records_per_file=records_per_file)
    return read(pages.sparkSession, out)
