"""WARC archives: a deterministic sharded writer, and a reader.

Pages become WARC/1.1 records. Of records with equal payloads of at least ``LEAST`` bytes that with
the largest ``page_id`` is a ``response``, the others are ``revisit`` records that name it and leave
the payload out; all smaller ones are responses. Every header is made anew: record ids from page id
and address, digests from the bytes, lengths, one fixed date.

Records are sorted by range of ``page_id``. The bounds come from a sample by hash of the id, so they, and
with them all files, depend on the rows alone and not on how these were dealt out. A task streams its
ranges, one record in memory at a time, into gzip members, and begins a new file when the present one has
reached ``file_bytes`` compressed. Files are written under a temporary name of the attempt's own; the
rows of the attempts that count are collected in a manifest table; a second job moves just these files to
their final names (moving again is harmless), and the manifest is written last. What a lost
executor left behind is in no manifest and goes with the temporary folder. Readers start from the manifest.

Edge cases: null html is an empty payload; a null ``url`` leaves the address out, control characters,
spaces and bytes beyond ASCII in it are percent-encoded; a null ``page_id`` is always a response, sorted first;
rows that repeat the largest ``page_id`` of a payload are all responses, and other repeated rows are revisits each;
an empty table gives an empty manifest and no records. Columns other than ``page_id``, ``url`` and ``html`` are
ignored, whatever their names. A damaged or truncated file gives the records before the damage and
a row with ``error``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_left, shared_path

#: Payloads of fewer bytes are always written whole.
LEAST = 1000
#: Payload bytes of a range (one task's share), compressed bytes at which a file ends, sampled ids a range.
RANGE_BYTES, FILE_BYTES, SAMPLE = 32_000_000, 8_000_000, 20
DATE = "2024-01-01T00:00:00Z"

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "shard long, part long, name string, written string, records long, bytes long, sha256 string"
_RECORDS = "name string, record_type string, page_id long, uri string, payload binary, payload_bytes long, payload_digest string, refers_to long, error string"
_BATCH = 4_000_000


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address that all executors can reach, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


# writing


def record_id(page_id: int | None, url: str | None, again: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}\n{url}\n{again}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _address(url: str) -> str:
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "surrogatepass")).decode()


def _record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    fields = {"WARC-Type": kind, **fields, "WARC-Block-Digest": _sha1(block), "Content-Length": len(block)}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def info_record(name: str) -> bytes:
    """The first record of a file."""
    return _record("warcinfo", {"WARC-Record-ID": record_id(None, name), "WARC-Date": DATE, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")


def page_record(row: dict, again: int) -> bytes:
    """A response or revisit record; the HTTP header of a revisit still tells the length of the payload."""
    page_id, url, refers_to = row["page_id"], row["url"], row["refers_to"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    fields = {
        "WARC-Record-ID": record_id(page_id, url, again), "WARC-Date": DATE, "WARC-Target-URI": None if url is None else _address(url), "X-Page-Id": page_id,
        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode(),
    }
    if refers_to is None:
        return _record("response", fields, http + row["payload"])
    told = row["refers_url"]
    fields |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": record_id(refers_to, told), "WARC-Refers-To-Target-URI": None if told is None else _address(told), "WARC-Refers-To-Date": DATE, "X-Refers-To-Page-Id": refers_to}
    return _record("revisit", fields, http)


class _File:
    """A file under a temporary name, one gzip member a record."""

    def __init__(self, out: str, shard: int, part: int, attempt: str):
        self.fs, at = filesystem(out)
        self.name, self.written = f"pages-{shard:08d}-{part:05d}.warc.gz", f"_temporary/{attempt}-{shard:08d}-{part:05d}"
        self.fs.create_dir(f"{at}/_temporary", recursive=True)
        self.to = self.fs.open_output_stream(f"{at}/{self.written}", compression=None)
        self.key, self.records, self.bytes, self.sha = (shard, part), 0, 0, hashlib.sha256()
        self.add(info_record(self.name))

    def add(self, record: bytes) -> None:
        packed = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = packed.compress(record) + packed.flush()
        self.to.write(data)
        self.sha.update(data)
        self.bytes += len(data)
        self.records += 1

    def close(self) -> tuple:
        self.to.close()
        return (*self.key, self.name, self.written, self.records, self.bytes, self.sha.hexdigest())


def kinds(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows ``(page_id, url, payload, payload_bytes, digest, refers_to, refers_url)``; ``refers_to`` and
    ``refers_url`` are null for responses, ``payload`` for revisits. Copies are counted before they meet; payloads that very many
    rows share are matched by a bounded broadcast."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("same"))
    meant = rows.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    shared = cut(meant.groupBy("same").agg(F.count("*").alias("copies"), F.max(F.struct("page_id", "url")).alias("kept")).where("copies > 1"))
    known = join_left(rows, shared, "same", "copies", F.xxhash64("page_id", "url", "same"), meant=(F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    other = F.col("kept.page_id") > F.col("page_id")
    return known.select(
        "page_id", "url", F.when(~F.coalesce(other, F.lit(False)), F.col("payload")).alias("payload"), "payload_bytes", "digest",
        F.when(other, F.col("kept.page_id")).alias("refers_to"), F.when(other, F.col("kept.url")).alias("refers_url"),
    )


def bounds(pages: DataFrame, range_bytes: int = RANGE_BYTES, sample: int = SAMPLE) -> np.ndarray:
    """First ids of the ranges but the first: every ``sample``-th or so of ids chosen by hash. The driver gets about
    ``sample`` ids for each ``range_bytes`` of payload."""
    size, n = pages.agg(F.sum(F.octet_length(F.col("html").cast("string"))), F.count("page_id")).first()
    ranges = -(-(size or 0) // range_bytes)
    if ranges <= 1:
        return np.zeros(0, np.int64)
    rate = max(1, n // (sample * ranges))
    ids = pages.select(F.col("page_id").cast("long").alias("page_id")).where(F.pmod(F.xxhash64("page_id"), F.lit(rate)) == 0)
    ids = np.unique(ids.where("page_id is not null").toPandas()["page_id"].to_numpy(np.int64))
    return np.unique(ids[len(ids) * np.arange(1, ranges) // ranges]) if len(ids) else ids


def write(pages: DataFrame, out: str | None = None, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES, least: int = LEAST) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives under ``out`` (a new path in the shared folder if not given);
    returns the manifest, a row per file, which is also kept at ``out/_manifest``."""
    spark = pages.sparkSession
    out = (out or shared_path(spark)).rstrip("/")
    firsts = bounds(pages, range_bytes)
    told = spark.sparkContext.broadcast(firsts)

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(told.value, page_id.to_numpy(np.int64), "right"), dtype="int32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, file, done, last, again = uuid.uuid4().hex, None, [], None, 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if file and (file.key[0] != row["shard"] or file.bytes >= file_bytes):
                    done.append(file.close())
                    file = _File(out, row["shard"], file.key[1] + 1 if file.key[0] == row["shard"] else 0, attempt)
                file = file or _File(out, row["shard"], 0, attempt)
                again = again + 1 if (row["page_id"], row["url"]) == last else 0
                last = row["page_id"], row["url"]
                file.add(page_record(row, again))
        if file:
            done.append(file.close())
            names = [c.split()[0] for c in _MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names)

    # a null id sorts before all others
    rows = kinds(pages, least).withColumn("shard", shard_of(F.coalesce("page_id", F.lit(-(1 << 63)))))
    dealt = rows.repartitionById(len(firsts) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "url", "digest")
    files = cut(dealt.mapInArrow(run, _MANIFEST))
    files.mapInArrow(lambda batches: _publish(batches, out), "name string").count()
    # the manifest comes last: without it there is no archive
    files.drop("written").coalesce(1).sortWithinPartitions("name").write.parquet(f"{out}/_manifest")
    fs, at = filesystem(out)
    if fs.get_file_info(f"{at}/_temporary").type == pafs.FileType.Directory:
        fs.delete_dir(f"{at}/_temporary")
    return manifest(spark, out)


def _publish(batches: Iterator[pa.RecordBatch], out: str) -> Iterator[pa.RecordBatch]:
    """Move written files to their final names. A task that is run again finds some moved."""
    fs, at = filesystem(out)
    for batch in batches:
        for name, written, size in zip(*(batch.column(c).to_pylist() for c in ("name", "written", "bytes")), strict=True):
            if fs.get_file_info(f"{at}/{written}").type == pafs.FileType.File:
                fs.move(f"{at}/{written}", f"{at}/{name}")
            if fs.get_file_info(f"{at}/{name}").size != size:
                raise OSError(f"{out}/{name}: not all of it is there")
        yield pa.RecordBatch.from_arrays([batch.column("name")], ["name"])


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """The files of an archive: ``(path, shard, part, name, records, bytes, sha256)``."""
    rows = spark.read.schema(", ".join(c for c in _MANIFEST.split(", ") if not c.startswith("written"))).parquet(f"{out}/_manifest")
    return rows.select(F.concat(F.lit(f"{out}/"), "name").alias("path"), "*")


# reading


def _head(lines: Iterator[bytes]) -> dict[str, str]:
    """Named fields up to the empty line; a line that begins with white space goes on with the one before."""
    found: dict[str, str] = {}
    last = None
    for line in lines:
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if not text:
            return found
        if text[0] in " \t" and last:
            found[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise ValueError(f"a header line without a colon: {text[:40]!r}")
        last = name.strip().lower()
        found[last] = value.strip()
    raise EOFError("the header ends early")


def parse(stream) -> Iterator[dict]:
    """The records of an open, decompressed archive, as dicts of header fields and ``block``."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        head = _head(iter(stream.readline, b""))
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise EOFError("the block ends early")
        yield head | {"block": block}


def _row(name: str, record: dict) -> dict:
    """A row of ``_RECORDS``: digests of responses from the payload itself, and held against the header's."""
    block, kind = record["block"], record.get("warc-type")
    whole = lambda field: int(record[field]) if field in record else None
    row = {"name": name, "record_type": kind, "page_id": whole("x-page-id"), "uri": record.get("warc-target-uri"), "refers_to": whole("x-refers-to-page-id")}
    told = record.get("warc-payload-digest")
    if record.get("warc-block-digest", _sha1(block)) != _sha1(block):
        row["error"] = "block digest differs"
    if kind == "response":
        head, _, payload = block.partition(b"\r\n\r\n")
        row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
        if told and told != _sha1(payload):
            row.setdefault("error", "payload digest differs")
    elif kind == "revisit":
        fields = _head(iter(block.split(b"\n")[1:] + [b""]))
        row |= {"payload_bytes": int(fields["content-length"]) if "content-length" in fields else None}
        row |= {"payload_digest": base64.b32decode(told.removeprefix("sha1:")).hex() if told else None}
    return row


def read(files: DataFrame) -> DataFrame:
    """Rows of all records of ``files(path)``: type, ids, address, payload (null but for responses), its length and
    SHA-1, the page a revisit names, and ``error``. Tasks take files, and hold one record at a time."""
    names = [c.split()[0] for c in _RECORDS.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            name = path.rpartition("/")[2]
            try:
                fs, at = filesystem(path)
                with fs.open_input_file(at) as raw:
                    packed = raw.read(2) == b"\x1f\x8b"
                    raw.seek(0)
                    for record in parse(gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw)):
                        rows.append(_row(name, record))
                        size += len(record["block"])
                        if size >= _BATCH or len(rows) >= 10_000:
                            yield batch_of(rows)
                            rows, size = [], 0
            except (EOFError, OSError, ValueError, KeyError, zlib.error) as e:
                rows.append({"name": name, "error": f"{type(e).__name__}: {e}"})
        if rows:
            yield batch_of(rows)

    tasks = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path").repartition(tasks, "path").mapInArrow(run, _RECORDS)


def digests(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of response and revisit records; a damaged file is an error."""
    whole = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "name", "error"))).otherwise(F.col("record_type"))
    return records.select("page_id", "payload_bytes", "payload_digest", whole.alias("record_type"), "refers_to").where("record_type in ('response', 'revisit')")


SQL = """
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN octet_length(payload) >= 1000 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       (CASE WHEN octet_length(payload) >= 1000 AND page_id < kept THEN kept END)::DOUBLE AS refers_to
FROM (SELECT page_id, payload, max(page_id) OVER (PARTITION BY payload) AS kept FROM (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages))
"""
