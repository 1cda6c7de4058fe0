r"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing uses the text sink with ``\r\n\r\n`` as the line end, so each row becomes one record in a plain, splittable
archive on any file system that Spark can write.

Reading splits archives at every ``WARC/1.``, wherever it stands: each task emits the candidates of its split (those that go
on as versions 1.0 or 1.1 do) with the offset of the record that would follow (from Content-Length). Pieces are known by
their absolute byte offset in the file, so it does not matter how a scan is cut into tasks. A candidate counts only if the chain of successors
from the start of its file reaches it, so text inside a payload that looks like a record is never one. Candidates whose
successor is the next candidate are folded into runs, and pointer jumping over the runs finds the reachable ones in as
many rounds as the logarithm of the runs of a file.

Scale: payloads are hashed where they are read and not exchanged; what is exchanged is about 100 bytes a record. Only
records that hold the magic are put together from pieces; for that, the files that have such records are copied once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modengine.llm.scratch import kept, saved, scratch_path, temporary_tables

MAGIC = "WARC/1."
VERSIONS = ("0\r\n", "1\r\n")
BREAK = "\r\n\r\n"
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Groups of equal payloads (about 60 bytes each) up to which their table is broadcast.
BROADCAST_GROUPS = 100_000


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_groups: int = BROADCAST_GROUPS) -> None:
    """A record for each row: of rows with equal payloads of ``REVISIT_BYTES`` or more, all but the largest id revisit it.

    Null html is an empty payload, a null url an empty one; rows that share the largest id of a group are all responses.
    A null id is a record like others, but none revisits it. Other columns of ``pages`` are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload")})
    groups = rows.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes").agg(F.max("id").alias("origin"), F.count("*").alias("n"))
    groups = saved(groups.filter("n > 1 and origin is not null").drop("n"), "warc-groups")
    groups = F.broadcast(groups) if groups.count() <= broadcast_groups else groups
    rows = rows.join(groups, ["digest", "bytes"], "left")
    revisit = F.col("origin").isNotNull() & ~F.coalesce(F.col("id") == F.col("origin"), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = [
        F.lit(MAGIC + VERSIONS[0] + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name("id"),
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " "),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nWARC-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name("origin"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(BREAK),
    ]
    rows.select(F.concat(*head, block).alias("value")).write.option("lineSep", BREAK).text(path)


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?:^|\r\n)(?i:{name}): *([^\r\n]*)", 1)


def _read_record(value: Column) -> dict[str, Column]:
    """Fields of what stands behind a magic; ``size`` is null where no record head is there."""
    head = F.substring_index(value, BREAK, 1)
    length = F.regexp_extract(head, r"(?:^|\r\n)(?i:Content-Length): *(\d{1,15})(?:\r\n|$)", 1)
    told = F.substring(value, 1, 3).isin(*VERSIONS)
    size = F.when(told & (F.octet_length(head) < F.octet_length(value)) & (length != ""), length.cast("long"))
    return {"head_bytes": F.octet_length(head).cast("long"), "size": size, "record_type": _field(head, "WARC-Type"), "record_id": _field(head, "WARC-Record-ID"), "refers": _field(head, "WARC-Refers-To"), "told_digest": _field(head, "WARC-Payload-Digest"), "told_bytes": _field(head, "WARC-Payload-Length").try_cast("long")}


def _payload(value: Column, head_bytes: Column, size: Column) -> tuple[Column, Column]:
    """Length and SHA-1 of the payload (behind the HTTP head) of a whole record."""
    block = F.substring(value.cast("binary"), head_bytes + 5, size)
    http = F.octet_length(F.substring_index(block.cast("string"), BREAK, 1))
    body = F.substring(block, http + 5, size)
    return F.octet_length(body).cast("long"), F.sha1(body)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, nth, value): what stands between magics, in file order."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"), "value")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each piece: its place, its record fields, and the digest of its payload if it is a record by itself."""
    rows = _pieces(spark, path)
    fields = _read_record(F.col("value"))
    rows = rows.withColumns(fields).withColumn("bytes", F.octet_length("value").cast("long"))
    alone = F.col("bytes") == F.col("head_bytes") + F.col("size") + 8
    n, digest = _payload(F.col("value"), F.col("head_bytes").cast("int"), F.col("size").cast("int"))
    rows = rows.select("file", "split", "nth", "bytes", *fields, F.when(alone, n).alias("payload_bytes"), F.when(alone, digest).alias("payload_digest"))
    found = _placed(saved(rows, "warc-candidates")).drop("split", "nth")
    return found.withColumn("next", F.when(F.col("at").isNotNull(), F.col("at") + len(MAGIC) + F.col("head_bytes") + F.col("size") + 8))


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` (of one written scan: file, split, nth, bytes) with ``at``, the offset of the magic before the piece.

    Null is what stands before the first magic. Sums go by split, then over the splits of a file, then within a split.
    """
    step = len(MAGIC)
    by_split = rows.groupBy("file", "split").agg(F.sum(F.col("bytes") + step).alias("length"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_split.select("file", "split", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("file", "split").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum(F.col("bytes") + step).over(within), F.lit(0))).join(bases, ["file", "split"])
    begin = F.col("base") + F.col("inside")
    return placed.withColumn("at", F.when(begin > 0, begin - step)).drop("base", "inside")


def verified(found: DataFrame, rounds: int = 64) -> DataFrame:
    """The candidates that the chain from the start of their file reaches."""
    order = Window.partitionBy("file").orderBy("at")
    rows = found.filter("at is not null").withColumn("follower", F.lead("at").over(order))
    broken = F.coalesce(F.lag(F.coalesce((F.col("next") == F.col("follower")).cast("int"), F.lit(0))).over(order), F.lit(0)) == 0
    rows = rows.withColumn("run", F.sum(broken.cast("int")).over(order))
    run = Window.partitionBy("file", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = saved(rows.withColumn("exit", F.last("next").over(run)).drop("follower"), "warc-runs")
    spans = rows.groupBy("file", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.first("exit").alias("exit"))
    # only places where another run leads, and file starts, can enter a run
    entries = rows.select("file", "at", "run", "exit")
    entered = spans.select("file", F.col("exit").alias("at")).union(spans.select("file", F.lit(0).cast("long"))).distinct()
    jumps = saved(entries.join(entered, ["file", "at"]).select("file", "at", F.col("exit").alias("to")), "warc-jumps")
    reached = saved(jumps.filter("at = 0").select("file", "at"), "warc-reached")
    size = reached.count()
    for _ in range(rounds):
        on = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at")).join(jumps.select("file", "at"), ["file", "at"])
        reached = saved(reached.union(on).distinct(), "warc-reached")
        now = reached.count()
        if now == size:
            break
        size = now
        further = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = saved(jumps.join(further, ["file", "to"], "left").select("file", "at", F.coalesce("beyond", "to").alias("to")), "warc-jumps")
    entry = reached.join(entries, ["file", "at"]).groupBy("file", "run").agg(F.min("at").alias("entry"))
    return rows.join(entry, ["file", "run"]).filter("at >= entry and next is not null").drop("run", "exit", "entry")


def _joined(spark: SparkSession, path: str, split: DataFrame) -> DataFrame:
    """(file, at, payload_bytes, payload_digest) of the records in ``split``, put together from their pieces."""
    raw = _pieces(spark, path).join(split.select("file").distinct(), "file", "left_semi")
    raw = saved(raw.withColumn("bytes", F.octet_length("value").cast("long")), "warc-pieces")
    # spans of a file do not overlap, so the last one that starts before a piece is the only one that can hold it
    places = _placed(raw.select("file", "split", "nth", "bytes")).filter("at is not null")
    places = places.select("file", "split", "nth", "at", F.lit(None).cast("struct<from:long,to:long,h:long,s:long>").alias("span"))
    spans = split.select("file", F.lit(None).cast("long").alias("split"), F.lit(None).cast("long").alias("nth"), "at", F.struct(F.col("at").alias("from"), F.col("next").alias("to"), F.col("head_bytes").alias("h"), F.col("size").alias("s")).alias("span"))
    order = Window.partitionBy("file").orderBy("at", F.col("span").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    within = places.union(spans).withColumn("span", F.last("span", ignorenulls=True).over(order))
    parts = within.filter("nth is not null and at < span.to").select("file", "split", "nth", "at", "span.from", "span.h", "span.s")
    whole = raw.join(parts, ["file", "split", "nth"]).groupBy("file", "from", "h", "s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
    n, digest = _payload(F.col("value"), F.col("h").cast("int"), F.col("s").cast("int"))
    return whole.select("file", F.col("from").alias("at"), n.alias("joined_bytes"), digest.alias("joined_digest"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record that the chain reaches.

    Versions 1.0 and 1.1 are read. A file that does not begin with a record has none; where the chain breaks, the records
    behind are left out; of a last record that is cut off, what is there counts as its payload. An empty folder gives no
    rows. Records of other writers have a null page_id.
    """
    with temporary_tables(spark):
        found = saved(candidates(spark, path), "warc-places")
        records = saved(verified(found), "warc-records")
        split = records.filter("payload_digest is null")
        if split.isEmpty():
            records = records.withColumns({"joined_bytes": F.lit(None).cast("long"), "joined_digest": F.lit(None).cast("string")})
        else:
            records = records.join(_joined(spark, path, split), ["file", "at"], "left")
        revisit = F.col("record_type") == "revisit"
        number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
        digest = F.when(revisit, F.regexp_replace("told_digest", "^sha1:", "")).otherwise(F.coalesce("joined_digest", "payload_digest"))
        read = records.select(number("record_id").alias("page_id"), F.when(revisit, F.col("told_bytes")).otherwise(F.coalesce("joined_bytes", "payload_bytes")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.when(revisit, number("refers")).alias("refers_to"))
        return kept(read, "warc-read")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read these back."""
    spark = pages.sparkSession
    with temporary_tables(spark):
        path = scratch_path(spark, "warc")
        write_warc(pages, path)
        return kept(read_warc(spark, path), "warc-pages")
