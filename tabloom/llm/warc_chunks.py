"""WARC archives by way of a chunk table: an oversized payload is rows of record identifier and chunk number.

Each chunk carries the SHA-256 of the payload up to its end, computed as the chunks stream by, and becomes a WARC record:
the first of a payload is the ``response``, the others are its ``continuation`` segments.  Readers group chunks by record,
sort them and stream them through a digest; no reading task holds more than a batch of chunks of a payload.  On the writing side
the whole payload is hashed and cut in its row.  Archives are written
and read by Spark's own text source, so they can be in any store, and a lost task is simply run again.

The line separator of the reader is the end of a record with the start of the next.  A payload that holds the version mark of
a record is cut inside the mark, so that the separator occurs between records only.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import Scratch, bounded, small_batches

# Fixed values of the format.
VERSION = "WARC/1.1"
LINE, BLANK_LINE = "\r\n", "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK_CHARS = 65_536
LEAST_REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"


def records(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, payload, digest, bytes, record_id, and first_id, the page that a revisit refers to.

    Only digests that occur more than once are looked up, by a broadcast while they are few.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    facts = rows.select("page_id", F.sha2("payload", 256).alias("of_digest")).where(F.octet_length("payload") >= LEAST_REVISIT_BYTES)
    shared = facts.groupBy("of_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("pages")).where("pages > 1")
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    with Scratch(pages.sparkSession, "warc") as scratch:
        shared = bounded(scratch.write(shared.drop("pages"), keep=True))
    rows = rows.join(shared, rows["digest"] == shared["of_digest"], "left")
    return rows.select("page_id", "url", "payload", "digest", "bytes", _record_id(F.col("page_id"), F.col("digest")).alias("record_id"),
                       F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("first_id"))


def _record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:sha256:"), F.sha2(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest), 256), F.lit(">"))


def chunked(rows: DataFrame, chars: int = CHUNK_CHARS) -> DataFrame:
    """The chunk table: the columns of ``records`` but the payload, with write_id, chunk_no from 0, n_chunks and chunk.

    A revisit has one empty chunk.  ``write_id`` tells repeated pages apart.  A payload is cut in one pass over it.
    """
    run = F.lit(f"(?s).{{1,{chars}}}+")
    sized = lambda piece: F.when(piece == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(piece, run, F.lit(0)))
    cut = F.flatten(F.transform(F.split("payload", "(?<=WARC/)(?=1\\.1)"), sized))
    whole = (F.length("payload") <= chars) & ~F.contains(F.col("payload"), F.lit(VERSION))
    chunks = F.when(F.col("first_id").isNotNull(), F.array(F.lit(""))).when(whole, F.array("payload")).otherwise(cut)
    rows = rows.withColumn("write_id", F.uuid()).withColumn("chunks", chunks)
    columns = ["page_id", "url", "digest", "bytes", "record_id", "first_id", "write_id"]
    return rows.select(*columns, F.size("chunks").alias("n_chunks"), F.posexplode("chunks").alias("chunk_no", "chunk"))


def with_running_digest(chunks: DataFrame) -> DataFrame:
    """Adds ``running``: SHA-256 of the payload up to the end of each chunk.  Chunks of a record follow each other in their
    partition; the digest's state goes from chunk to chunk and from batch to batch."""

    def of_partition(batches):
        record, digest = None, None
        for batch in batches:
            running = []
            for write_id, chunk in zip(batch["write_id"], batch["chunk"]):
                if write_id != record:
                    record, digest = write_id, hashlib.sha256()
                digest.update(chunk.encode("utf-8"))
                running.append(digest.hexdigest())
            yield batch.assign(running=running)

    return chunks.mapInPandas(of_partition, T.StructType([*chunks.schema.fields, T.StructField("running", T.StringType())]))


def _header(name: str, value: Column) -> Column:
    """A header line, absent if the value is NULL."""
    return F.concat(F.lit(f"{name}: "), value)


def record_text(chunks: DataFrame) -> Column:
    """One archive record for a chunk: headers, an empty line, the block."""
    first, many = F.col("chunk_no") == 0, F.col("n_chunks") > 1
    revisit = F.col("first_id").isNotNull()
    part_id = F.concat(F.lit("<urn:sha256:"), F.sha2(F.concat_ws("|", "record_id", F.col("chunk_no").cast("string")), 256), F.lit(">"))
    address = F.replace(F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20"), F.lit(VERSION), F.lit("WARC%2F1.1"))
    block = F.concat(F.when(first, HTTP).otherwise(""), "chunk")
    kind = F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")
    lines = [
        F.lit(VERSION),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", F.when(first, F.col("record_id")).otherwise(part_id)),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", address),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _header("WARC-Refers-To", F.when(revisit, _record_id(F.col("first_id"), F.col("digest")))),
        _header("WARC-Profile", F.when(revisit, SAME_PAYLOAD)),
        _header("WARC-Segment-Number", F.when(many, (F.col("chunk_no") + 1).cast("string"))),
        _header("WARC-Segment-Origin-ID", F.when(~first, F.col("record_id"))),
        _header("WARC-Segment-Total-Length", F.when(many & (F.col("chunk_no") + 1 == F.col("n_chunks")), F.col("bytes").cast("string"))),
        _header("X-Page-Id", F.col("page_id").cast("string")),
        _header("X-Write-Id", F.col("write_id")),
        _header("X-Running-Digest", F.when(~revisit, F.concat(F.lit("sha256:"), "running"))),
        _header("Content-Type", F.lit("application/http;msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(LINE, *lines), F.lit(BLANK_LINE), block)


def write_archives(pages: DataFrame, path: str, chars: int = CHUNK_CHARS) -> None:
    """One compressed archive file per task, at ``path``."""
    with small_batches(pages.sparkSession):
        texts = {c: F.col(c).cast("string") for c in ("page_id", "first_id")}  # pandas has no whole numbers with NULL
        chunks = with_running_digest(chunked(records(pages), chars).withColumns(texts))
        out = chunks.select(record_text(chunks).alias("value"))
        out.write.option("lineSep", BLANK_LINE).option("compression", "gzip").text(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row per archive record: its headers as a map, and the payload part of its block.  A block of another length than
    its header says is an error."""
    rows = spark.read.option("lineSep", BLANK_LINE + VERSION + LINE).text(path).where("value <> ''")
    head = F.substring_index("value", BLANK_LINE, 1)
    headers = F.str_to_map(head, F.lit(LINE), F.lit(": "))
    rows = rows.select(headers.alias("h"), F.substring(F.col("value"), F.length(head) + 5, F.length("value")).alias("block"))
    length = F.col("h")["Content-Length"].cast("long")
    rest = F.octet_length("block") - length
    rows = rows.withColumn(
        "block",
        F.when(rest == 0, F.col("block"))
        .when((rest == 4) & F.endswith(F.col("block"), F.lit(BLANK_LINE)), F.substring(F.col("block"), F.lit(1), F.length("block") - 4))
        .otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("h")["WARC-Record-ID"]))),
    )
    first = F.col("h")["WARC-Type"] != "continuation"
    return rows.select("h", F.when(first, F.substring(F.col("block"), F.instr("block", BLANK_LINE) + 4, F.length("block")))
                       .otherwise(F.col("block")).alias("chunk"))


def _streamed(chunks: DataFrame) -> DataFrame:
    """(write_id, bytes, digest) of payloads in several segments, each checked against its running digests."""

    def of_partition(batches):
        record, digest, size, out = None, None, 0, []

        def finished():
            return [] if record is None else [(record, size, digest.hexdigest())]

        for batch in batches:
            for write_id, running, chunk in zip(batch["write_id"], batch["running"], batch["chunk"]):
                if write_id != record:
                    out += finished()
                    record, digest, size = write_id, hashlib.sha256(), 0
                data = chunk.encode("utf-8")
                digest.update(data)
                size += len(data)
                if running != f"sha256:{digest.hexdigest()}":
                    raise ValueError(f"segments of {write_id} are not in order or not whole")
            yield pd.DataFrame(out, columns=["write_id", "bytes", "payload_digest"])
            out = []
        yield pd.DataFrame(finished(), columns=["write_id", "bytes", "payload_digest"])

    ordered = chunks.repartition("write_id").sortWithinPartitions("write_id", "part")
    return ordered.mapInPandas(of_partition, "write_id string, bytes long, payload_digest string")


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Digests and lengths of responses are computed from the payloads read; a revisit takes them from the response that it
    refers to.  A payload that does not have the digest its header states is an error.
    """
    rows = read_segments(spark, path)
    h = lambda name: F.col("h")[name]
    whole = rows.where(h("WARC-Type") != "continuation")
    one = ["page_id", "url", "record_id", "record_type", "stated", "target", "write_id"]
    whole = whole.select(
        h("X-Page-Id").cast(id_type).alias("page_id"), h("WARC-Target-URI").alias("url"), h("WARC-Record-ID").alias("record_id"),
        h("WARC-Type").alias("record_type"), F.substring_index(h("WARC-Payload-Digest"), ":", -1).alias("stated"),
        h("WARC-Refers-To").alias("target"), h("X-Write-Id").alias("write_id"), h("WARC-Segment-Number").alias("part"), "chunk",
    )
    single = whole.where("part is null").select(
        *one, F.octet_length("chunk").cast("long").alias("bytes"), F.sha2("chunk", 256).alias("payload_digest")
    )
    segments = rows.where(h("WARC-Segment-Number").isNotNull()).select(
        h("X-Write-Id").alias("write_id"), h("WARC-Segment-Number").cast("long").alias("part"), h("X-Running-Digest").alias("running"), "chunk"
    )
    several = whole.where("part is not null").select(*one).join(_streamed(segments), "write_id").select(*one, "bytes", "payload_digest")
    with Scratch(spark, "warc") as scratch, small_batches(spark):
        found = scratch.write(single.unionByName(several), keep=True)
    answers = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("to_id")).agg(
        F.first("page_id").alias("refers_to"), F.first("bytes").alias("to_bytes"), F.first("payload_digest").alias("to_digest")
    )
    revisit = F.col("record_type") == "revisit"
    nothing = [F.lit(None).cast(answers.schema[c].dataType).alias(c) for c in answers.columns]
    # responses refer to nothing and are not shuffled for it
    joined = found.where(~revisit).select("*", *nothing).unionByName(
        found.where(revisit).join(answers, F.col("target") == F.col("to_id"), "left")
    )
    digest = F.when(revisit, F.col("to_digest")).otherwise(F.col("payload_digest"))
    checked = F.when(digest.eqNullSafe(F.col("stated")), digest).otherwise(
        F.raise_error(F.concat(F.lit("payload and digest differ: "), F.col("record_id")))
    )
    return joined.select(
        "page_id", F.when(revisit, F.col("to_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"), checked.alias("payload_digest"),
        "record_type", F.when(revisit, F.col("refers_to")).alias("refers_to"), "url",
    )


def round_trip(pages: DataFrame, chars: int = CHUNK_CHARS) -> DataFrame:
    """Write the archives of all pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    NULL and empty pages have an empty payload.  Among equal payloads the smallest page_id responds; rows that share it all
    do, and payloads that no page with an id has are all responses.  No pages, no rows.
    """
    spark = pages.sparkSession
    with Scratch(spark, "archives") as scratch:
        path = scratch.path()
        write_archives(pages, path, chars)
        found = read_archives(spark, path, pages.schema["page_id"].dataType.simpleString())
        return scratch.write(found.drop("url"), keep=True)
