"""WARC archives with a Zstandard dictionary: records compressed one by one, the dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.folds import sample_by_hash
from tallyloom.session import fresh_path, materialize, ship_package

#: Of the WARC-Zstandard convention: magic number of the skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: The dictionary is trained on so many records at most, chosen by hash, none longer than SAMPLE_RECORD_BYTES.
SAMPLE_RECORDS = 500
SAMPLE_RECORD_BYTES = 32 << 10
REVISIT_MIN_BYTES = 1000
#: A task begins a new archive behind so many bytes.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 20
ARCHIVE_DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = "page_id bigint, record_id string, type string, refers_page bigint, payload binary, payload_digest string"


def payloads(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))


def with_record_plan(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to): which records are stored whole and which revisit another.

    Of equal payloads of REVISIT_MIN_BYTES or more, the record with the largest page_id (null below all) is the response;
    rows that share that id are all responses. The plan is made on ids and digests alone; payloads meet it by page and
    digest, so the copies of one page are dealt over all tasks.
    """
    base = payloads(pages)
    slim = materialize(base.where(F.octet_length("payload") >= REVISIT_MIN_BYTES).select("page_id", "digest").distinct(), "warc-long")
    owners = slim.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    owners = materialize(owners.select(F.col("digest").alias("owned"), "owner"), "warc-owners")
    revisits = slim.join(owners, F.col("digest") == F.col("owned")).where(~F.col("owner").eqNullSafe(F.col("page_id")))
    revisits = revisits.select(F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest"), "owner")
    joined = base.join(revisits, F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("digest") == F.col("of_digest")), "left")
    revisit = F.col("of_digest").isNotNull()
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("owner")).alias("refers_to"))


def record_bytes(name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; the block is an HTTP response, without its body in a revisit.

    ``name`` is unique among records, and the record's id is made of it. A revisit names its response by payload digest, as
    its profile does, and by page.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(hashlib.md5(name.encode()).hexdigest())}>"), ("WARC-Date", ARCHIVE_DATE)]
    if url:
        fields.append(("WARC-Target-URI", re.sub(r"\s", "%20", url)))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def train_dictionary(base: DataFrame) -> bytes:
    """A Zstandard dictionary of a bounded sample of records, chosen by hash from the whole table of payloads."""
    rows = sample_by_hash(base.where(F.octet_length("payload") <= SAMPLE_RECORD_BYTES), ["page_id", "digest"], SAMPLE_RECORDS).collect()
    samples = [record_bytes(f"sample {i}", r.page_id, r.url, bytes(r.payload), r.digest, "response", None) for i, r in enumerate(rows)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to train on: the records themselves are the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n"


def open_folder(url: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")
    return fs, path


def write_archives(plan: DataFrame, folder: str, dictionary: bytes, level: int = 3) -> DataFrame:
    """Write the records of ``plan`` into archives in ``folder``; returns (name, n), the archives and their numbers of records.

    Each task writes archives of about ARCHIVE_BYTES (more only by a last record) and renames them when they are complete, to
    names of its own attempt. The list is written as well, by the tasks that succeeded: what a lost or repeated attempt left
    behind isn't in it. Rows flow through; only the open record is in memory.
    """
    ship_package(plan.sparkSession)
    schema_order = ["page_id", "url", "payload", "digest", "record_type", "refers_to"]
    url = folder if re.match(r"[a-z0-9]+:", folder) else f"file://{folder}"
    url = re.sub(r"^file:/(?!/)", "file:///", url)
    most = ARCHIVE_BYTES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, n, sink, size = TaskContext.get(), 0, None, 0
        names, counts = [], []
        fs, root = open_folder(url)
        part, temp = f"{context.partitionId():06d}", f"{root}/_open-{context.partitionId():06d}-{context.taskAttemptId()}"
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)

        def end() -> None:
            sink.close()
            names.append(f"part-{part}-{context.taskAttemptId()}-{len(names):06d}.warc.zst")
            counts.append(n - sum(counts))
            fs.move(temp, f"{root}/{names[-1]}")

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in schema_order]
            for i in range(batch.num_rows):
                if sink is not None and size >= most:
                    end()
                    sink = None
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    sink, size = fs.open_output_stream(temp), 0
                    sink.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                frame = packer.compress(record_bytes(f"{root} {part} {n}", *(c[i].as_py() for c in columns)))
                sink.write(frame)
                size += len(frame)
                n += 1
        if sink is not None:
            end()
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "n": pa.array(counts, pa.int64())})

    return materialize(plan.select(*schema_order).mapInArrow(write, "name string, n bigint"), "warc-written")


def parse_record(raw: bytes) -> tuple:
    """(page_id, record_id, type, refers_page, payload, digest) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
    payload = None if fields["WARC-Type"] == "revisit" else block.partition(b"\r\n\r\n")[2]
    return int(page) if page is not None else None, fields["WARC-Record-ID"], fields["WARC-Type"], int(refers) if refers is not None else None, payload, fields["WARC-Payload-Digest"].removeprefix("sha1:")


def archive_records(source: BinaryIO) -> Iterator[bytes]:
    """The records of one archive, one after another; frames after the dictionary are independent and read one by one."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(size)))
    ahead = source.read(READ_BYTES)
    while ahead:
        one, parts = unpacker.decompressobj(), []
        while not one.eof:
            if not ahead:
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(ahead))
            ahead = one.unused_data if one.eof else source.read(READ_BYTES)
        yield b"".join(parts)
        ahead = ahead or source.read(READ_BYTES)


def read_archives(spark: SparkSession, folder: str, written: DataFrame | None = None) -> DataFrame:
    """One row a record of the archives in ``folder``, of those that ``written`` (name) lists if it is given; payload is null in
    revisits.

    Spark lists the archives and deals them to tasks; a task streams through each, with one record in memory at a time.
    """
    ship_package(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("refers_page", pa.int64()), ("payload", pa.binary()), ("payload_digest", pa.string())])
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                fs, name = open_folder(re.sub(r"^file:/(?!/)", "file:///", path))
                with fs.open_input_stream(name, compression=None) as source:
                    for raw in archive_records(source):
                        rows.append(parse_record(raw))
                        held += len(raw)
                        if held > 4 << 20:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")
    if written is not None:
        found = found.join(written.select("name"), F.substring_index("path", "/", -1) == F.col("name"), "left_semi")
    return found.mapInArrow(read, _READ)


def resolved_records(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to; revisits take them from their response.

    Sizes and digests are computed from the payload that was read; a stored digest that differs makes a null digest. The
    archives are read once; what is joined is written before, without payloads.
    """
    true = F.when(F.sha1("payload") == F.col("payload_digest"), F.col("payload_digest"))
    facts = records.select("page_id", "type", "refers_page", "payload_digest", F.octet_length("payload").cast("long").alias("size"), F.when(F.col("type") == "response", true).alias("checked"))
    facts = materialize(facts, "warc-facts")
    whole = facts.where("type = 'response'").groupBy(F.col("payload_digest").alias("of"), F.col("page_id").alias("of_page")).agg(F.max("size").alias("of_size"), F.max("checked").alias("of_checked"))
    whole = materialize(whole, "warc-responses")
    joined = facts.where("type = 'revisit'").join(whole, (F.col("payload_digest") == F.col("of")) & (F.col("refers_page") == F.col("of_page")), "left")
    revisits = joined.select("page_id", F.col("of_size").alias("payload_bytes"), F.col("of_checked").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("of_page").alias("refers_to"))
    responses = facts.where("type = 'response'").select("page_id", F.col("size").alias("payload_bytes"), F.col("checked").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(revisits)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html), read the archives back and resolve revisits.

    Other columns, whatever their names, aren't read. Cases: a null html is an empty payload; null urls have no target; null
    page ids have no id and come back null; equal rows make a record each, with ids of their own; a page of any length is
    one record, which a task holds in memory; an empty table makes no archive and gives no rows.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "archives")
    plan = with_record_plan(pages)
    written = write_archives(plan, folder, train_dictionary(payloads(pages)))
    if written.isEmpty():
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    return resolved_records(read_archives(spark, folder, written))
