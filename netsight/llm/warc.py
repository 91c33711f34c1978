"""Web archives compressed with a dictionary, and their reader.

An archive starts with a skippable frame that holds a Zstandard dictionary, built from the archive's own
records; every record follows as a frame of its own, so that one record can be read alone. A payload that
equals another one is not stored again: its record revisits the first one.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsight.llm.common import rows_of, type_of
from netsight.session import cut_lineage, ship_package

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed once its records have so many bytes.
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
#: The dictionary is built from records evenly spread over the archive, of so many bytes together.
SAMPLE_BYTES = 2 << 20
SALTS = 16


def marked(pages: DataFrame, key: str, url: str, html: str, least_bytes: int = 100) -> DataFrame:
    """(key, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every page.

    Of equal payloads of at least `least_bytes`, the page with the smallest key is the response and the
    others revisit it; a null key is larger than any, and payloads that only pages with null keys have
    are all responses, as nothing can be referred to. Rows that agree in key and payload are alike.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    large = rows.where(F.col("payload_bytes") >= least_bytes)
    first = large.groupBy("payload_digest").agg(F.min("key").alias("origin"), F.count("*").alias("n")).where("n > 1")
    # A page may have any number of copies: each salt has the row to join.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    first = first.select("payload_digest", "origin", salts.alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    joined = salted.join(first, ["payload_digest", "salt"], "left")
    again = F.col("origin").isNotNull() & ~F.col("key").eqNullSafe(F.col("origin"))
    return joined.select(
        "key", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("origin")).alias("refers_to"),
    )


def _record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(key, url: str | None, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One record; a revisit has the headers of the response only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    fields = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(f'page:{key}')}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}", f"Netsight-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if key is not None:
        fields.append(f"Netsight-Key: {quote(str(key))}")
    if url is not None:
        uri = quote(url, safe=":/?#[]@!$&()*+,;=%~'")
        fields.append(f"WARC-Target-URI: {uri}")
        if uri != url:  # what the page's table has, to the letter
            fields.append(f"Netsight-URL: {quote(url, safe='')}")
    if kind == "revisit":
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(f'page:{refers_to}')}"]
        fields.append(f"Netsight-Refers-To-Key: {quote(str(refers_to))}")
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> Iterator[bytes]:
    """The frames of an archive: the dictionary's, then one for each record."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, records[::step], k=512, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few records to learn from: plain frames
        trained = b""
    if trained:
        yield struct.pack("<II", SKIPPABLE, len(trained)) + trained
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    yield from map(packer.compress, records)


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pyarrow.fs.LocalFileSystem(), path) if path.startswith("/") else pyarrow.fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, folder: str, date: str) -> DataFrame:
    """Write marked pages below the folder, which all executors share; (path, records) of each archive.

    A file's name has the task attempt in it: what a lost attempt has written is in no list.
    """
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, root = _file_system(folder)
        files.create_dir(root, recursive=True)
        held, size, made = [], 0, []

        def close() -> None:
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(made):05d}.warc.zst"
            with files.open_output_stream(f"{root}/{name}", compression=None) as out:
                for frame in archive(held):
                    out.write(frame)
            made.append((f"{folder.rstrip('/')}/{name}", len(held)))

        for row in rows_of(batches, "key", "url", "payload", "payload_digest", "record_type", "refers_to"):
            held.append(record(*row, date))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                close()
                held, size = [], 0
        if held:
            close()
        paths, counts = zip(*made, strict=True) if made else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    columns = ["key", "url", "payload", "payload_digest", "record_type", "refers_to"]
    return cut_lineage(pages.select(*columns).mapInArrow(run, "path string, records bigint"))


def records_in(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an open archive."""
    head = stream.read(8)
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", head[4:])[0])))
    else:
        unpacker = zstandard.ZstdDecompressor()
        stream.seek(0)
    plain = unpacker.stream_reader(stream, read_across_frames=True, read_size=1 << 20)
    rest = b""

    def more() -> bool:
        nonlocal rest
        got = plain.read(1 << 20)
        rest += got
        return bool(got)

    while rest or more():
        while (end := rest.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("the archive ends inside a record")
        fields = dict(line.split(": ", 1) for line in rest[:end].decode().split("\r\n")[1:])
        size = end + 4 + int(fields["Content-Length"]) + 4
        while len(rest) < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield fields, rest[end + 4 : size - 4]
        rest = rest[size:]


def _text(fields: dict[str, str], name: str) -> str | None:
    return unquote(fields[name]) if name in fields else None


def read_archives(spark: SparkSession, archives: DataFrame, key_type: str) -> DataFrame:
    """(key, url, payload_bytes, payload_digest, record_type, refers_to, intact) of every record.

    intact: a response's payload has the length and the digest that its fields give. An archive that
    ends early, or has not the number of records it was written with, is an error.
    """
    ship_package(spark)
    fields_of = {
        "key": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
        "record_type": pa.string(), "refers_to": pa.string(), "intact": pa.bool_(),
    }
    schema = "key string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, intact boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, records in rows_of(batches, "path", "records"):
            files, at = _file_system(path)
            rows = []
            with files.open_input_file(at) as stream:
                for fields, block in records_in(stream):
                    payload = block.partition(b"\r\n\r\n")[2]
                    size, digest = int(fields["Netsight-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    whole = len(payload) == size and hashlib.sha256(payload).hexdigest() == digest
                    kind = fields["WARC-Type"]
                    rows.append(
                        (_text(fields, "Netsight-Key"), _text(fields, "Netsight-URL") or fields.get("WARC-Target-URI"), size, digest, kind,
                         _text(fields, "Netsight-Refers-To-Key"), whole if kind == "response" else None)
                    )
            if len(rows) != records:
                raise ValueError(f"{path} has {len(rows)} of {records} records")
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields_of.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, list(fields_of))

    # The list is short and would be one task: deal the archives out.
    read = archives.select("path", "records").repartition(F.col("path")).mapInArrow(run, schema)
    return read.withColumns({c: F.col(c).cast(key_type) for c in ("key", "refers_to")})
