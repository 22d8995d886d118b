"""WARC archives of one Zstandard frame per record.

An archive begins with a skippable frame that holds its dictionary; every
record is a frame of its own, compressed with it. Archives are written by the
tasks that hold the records, through ``pyarrow.fs`` into the shared folder, and
read back with Spark's ``binaryFile`` source. A manifest of what committed tasks
wrote decides which files count, so files of lost or repeated tasks don't.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import materialise, new_path, ship

#: Fixed values of the format: magic numbers, the profile of revisits, line ends.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n"

RECORD = "page_id {kind}, url string, record_type string, refers_to {kind}, payload_bytes long, payload_digest string, payload binary, archive string, error string"


class ArchiveError(ValueError):
    """An archive or record that breaks the format."""


def record_bytes(page_id, url: str | None, kind: str, refers_to, size: int, digest: str, payload: bytes, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A WARC/1.1 record; a revisit carries no block."""
    block = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + 2 * BREAK + block + 2 * BREAK


def parse_record(data: bytes) -> dict:
    """The record of one frame; raises ArchiveError unless headers, length and digest hold."""
    head, gap, rest = data.partition(2 * BREAK)
    lines = head.split(BREAK)
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ArchiveError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ArchiveError(f"header line without a colon: {name[:40]}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ArchiveError(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != 2 * BREAK:
        raise ArchiveError("the block's length differs from Content-Length")
    block, kind = rest[:-4], fields["warc-type"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "revisit":
        if block or "warc-refers-to" not in fields or not fields.get("payload-length", "").isdigit():
            raise ArchiveError("a revisit needs an original, a payload length and no block")
    elif kind != "response":
        raise ArchiveError(f"unexpected record type {kind[:40]}")
    elif hashlib.sha256(block).hexdigest() != digest:
        raise ArchiveError("the payload's digest differs")
    size = int(fields["payload-length"]) if kind == "revisit" else len(block)
    name = lambda key: m[1] if (m := re.fullmatch(r"<urn:page:(.+)>", fields.get(key, ""))) else None
    return {"page_id": name("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": name("warc-refers-to"), "payload_bytes": size, "payload_digest": digest, "payload": None if kind == "revisit" else block}


def train_dictionary(records: list[bytes], size: int = 16_384, sample_bytes: int = 1 << 20) -> zstandard.ZstdCompressionDict:
    """A dictionary from records spread evenly over the archive; raw content where too few can train one."""
    step = max(1, sum(map(len, records)) // sample_bytes)
    sample = records[::step] or [b" "]
    try:
        return zstandard.train_dictionary(size, sample, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict((b"".join(sample)[:size] or b" ") + b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes]) -> bytes:
    dictionary = train_dictionary(records)
    body = dictionary.as_bytes()
    compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(body)), body, *map(compressor.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, found from its blocks' headers."""
    if len(data) - at < 9 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ArchiveError(f"no frame at byte {at}")
    checked = bool(data[at + 4] & 4)
    try:
        at += zstandard.frame_header_size(data[at : at + 18])
    except zstandard.ZstdError as e:
        raise ArchiveError(f"no frame header at byte {at}: {e}") from e
    while True:
        if at + 3 > len(data):
            raise ArchiveError("a frame is cut short")
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            at += 4 * checked
            if at > len(data):
                raise ArchiveError("a frame is cut short")
            return at


def read_records(data: bytes, strict: bool = True) -> Iterator[dict]:
    """Records of an archive's bytes, of any length.

    Unless ``strict``, a bad record comes as a row with ``error``. Where no frame can be told any more, as in an
    archive that is cut short or has other bytes behind it, one such row stands for all the rest, and
    for the whole archive if its dictionary is cut short or of no use.
    """
    view, at = memoryview(data), 0
    try:
        dictionary = None
        if len(view) >= 8 and (start := struct.unpack_from("<II", view))[0] == DICTIONARY_MAGIC:
            at = 8 + start[1]
            if at > len(view):
                raise ArchiveError("the dictionary is cut short")
            dictionary = zstandard.ZstdCompressionDict(bytes(view[8:at]))
        reader = zstandard.ZstdDecompressor(dict_data=dictionary)
        while at < len(view):
            end = frame_end(view, at)
            try:
                known = zstandard.frame_content_size(view[at:end]) >= 0
                yield parse_record(reader.decompress(view[at:end]) if known else reader.decompressobj().decompress(view[at:end]))
            except (ArchiveError, zstandard.ZstdError) as e:
                if strict:
                    raise ArchiveError(f"record at byte {at}: {e}") from e
                yield {"error": f"record at byte {at}: {e}"}
            at = end
    except (ArchiveError, zstandard.ZstdError) as e:
        if strict:
            raise e if isinstance(e, ArchiveError) else ArchiveError(str(e)) from e
        yield {"error": f"the rest from byte {min(at, len(view))}: {e}"}
def with_record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """``(page_id, url, payload, payload_bytes, payload_digest, refers_to)``: the response that a page revisits, or null.

    Only digests and ids are grouped; payloads shuffle once, against the repeated
    digests, in a join whose hot digest adaptive execution splits.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    firsts = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1 AND first IS NOT NULL").select("payload_digest", "first")
    return rows.join(firsts, "payload_digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def write_archives(records: DataFrame, folder: str, archive_bytes_limit: int = 16 << 20) -> DataFrame:
    """Write rows of ``with_record_types`` as archives; the manifest ``(archive, records, bytes)``."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        task = TaskContext.get()
        held, size, wrote = [], 0, []

        def flush() -> None:
            nonlocal size
            data = archive_bytes(held)
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(wrote):04d}.warc.zst"
            with target.open_output_stream(f"{root}/{name}.open") as out:
                out.write(data)
            target.move(f"{root}/{name}.open", f"{root}/{name}")
            wrote.append((name, len(held), len(data)))
            held.clear()
            size = 0

        for batch in batches:
            for r in batch.to_pylist():
                held.append(record_bytes(r["page_id"], r["url"], "response" if r["refers_to"] is None else "revisit", r["refers_to"], r["payload_bytes"], r["payload_digest"], r["payload"]))
                size += len(held[-1])
                if size >= archive_bytes_limit:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([w[i] for w in wrote], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    chosen = records.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")
    return materialise(chosen.mapInArrow(run, "archive string, records long, bytes long"), "manifest")


def read_archives(files: DataFrame, kind: str = "bigint", strict: bool = True) -> DataFrame:
    """Records of archives given as ``(path, content)`` rows, as of the ``binaryFile`` source."""
    ship(files.sparkSession)
    schema = RECORD.format(kind=kind)
    names = [c.split()[0] for c in schema.split(", ")]
    bits = {"bigint": 63, "int": 31, "smallint": 15, "tinyint": 7}.get(kind, 0)
    whole = bits > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for r in read_records(content.as_py(), strict):
                    ids = {k: r.get(k) for k in ("page_id", "refers_to")}
                    if whole and (odd := [v for v in ids.values() if v is not None and not (re.fullmatch(r"-?[0-9]{1,19}", v) and -(1 << bits) <= int(v) < 1 << bits)]):
                        if strict:
                            raise ArchiveError(f"{os.path.basename(path)}: no number: {odd[0][:40]}")
                        r, ids = {"error": f"no number: {odd[0][:40]}"}, {}
                    ids = {k: int(v) if whole and v is not None else v for k, v in ids.items()}
                    rows.append({n: None for n in names} | r | ids | {"archive": os.path.basename(path)})
                    if len(rows) >= 1000:
                        yield from batch_of(rows)
                        rows = []
                if rows:
                    yield from batch_of(rows)

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.string())
    arrow = {"page_id": id_type, "refers_to": id_type, "payload_bytes": pa.int64(), "payload": pa.binary()}

    def batch_of(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], arrow.get(n, pa.string())) for n in names], names=names)

    return files.select("path", "content").mapInArrow(run, schema)


def broken_revisits(records: DataFrame) -> DataFrame:
    """Revisit records whose response is missing or has another digest or length; only headers shuffle."""
    heads = records.select("page_id", "record_type", "refers_to", "payload_digest", "payload_bytes")
    named = heads.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes"))
    joined = heads.where("record_type = 'revisit'").join(named, "refers_to", "left")
    return joined.where("NOT (digest <=> payload_digest AND bytes <=> payload_bytes)").select("page_id", "refers_to")


def with_checked_revisits(heads: DataFrame) -> DataFrame:
    """Records without payloads; reading a revisit whose response is missing or differs fails."""
    held = materialise(heads, "heads")
    broken = broken_revisits(held).select(F.col("page_id").alias("__broken")).distinct()
    told = F.raise_error(F.concat(F.lit("revisit without its response: "), F.col("page_id").cast("string"))).cast("string")
    joined = held.join(broken, (F.col("record_type") == "revisit") & (F.col("page_id") == F.col("__broken")), "left")
    return joined.withColumn("record_type", F.when(F.col("__broken").isNotNull(), told).otherwise(F.col("record_type"))).drop("__broken")


def archive_files(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """The archives in ``folder`` as ``binaryFile`` rows, those of the manifest if one is given."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    if manifest is None:
        return files
    named = files.withColumn("archive", F.element_at(F.split("path", "/"), -1))
    return named.join(manifest.select("archive"), "archive", "left_semi")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """Write ``pages`` as archives and read them back: one row per record, see ``RECORD``.

    Of equal payloads of ``least`` bytes or more the smallest id is the response
    and others revisit it; rows that repeat the smallest id are responses too,
    and so are equal payloads that have no id at all. Null html is an empty
    payload, a null url an empty one. Very long payloads are one record each.
    Other columns are ignored, whatever their names. No rows give no archives and no
    records.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    folder = new_path(spark, "archives")
    manifest = write_archives(with_record_types(pages, id_col, url_col, html_col, least), folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD.format(kind=kind))
    return read_archives(archive_files(spark, folder, manifest), kind)
