"""A deterministic, sharded writer of WARC archives, and their reader.

Rows are range-sorted by id into shards whose bounds follow from the data alone, so the same table gives the same files
with any number of tasks. Each task writes its shards record by record, every record its own gzip member, and rolls to a new
file by compressed size. Files are written under temporary names; a manifest of what the successful tasks wrote is
committed by Spark, then the files are renamed and a second manifest tells readers which files count. A task that is run
again writes other temporary files, and renaming can be repeated.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm.common import join_back, materialize, scratch_dir
from shoebox.llm.sharding import split_by_bits

#: Payload bytes of a shard, about; a shard is what one task sorts and writes.
SHARD_BYTES = 64 << 20
#: Compressed size after which a file is closed.
ROLL_BYTES = 256 << 20
#: Shards of a larger table grow instead, up to twice as many are made.
MOST_SHARDS = 1 << 17
#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("8f6f5e64-0d5b-5c39-9a3e-5b0f3a7c1d20")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(id, url, payload, payload_bytes, digest, record_type, refers_to): what ``write_warc`` writes for each row."""
    payload = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("full"))
    rows = rows.withColumn("full", F.when(F.col("payload_bytes") >= revisit_bytes, F.col("full")))
    heads = rows.where("full IS NOT NULL").groupBy("full").agg(F.max("id").alias("head"), F.count("*").alias("n")).where("n > 1")
    joined = join_back(rows, heads, "full")
    again = F.coalesce(F.col("head") != F.col("id"), F.lit(False))
    return joined.select("id", "url", "payload", "payload_bytes", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("head")).alias("refers_to"))


def _with_shards(rows: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """(rows with the column shard, number of shards): ranges of ids that hold at most ``shard_bytes``, in order.

    The range of all ids is halved, and halves are halved again, as long as they are too large; a digest divides the rows of
    one id. So bounds follow from the rows alone, and one far id does not matter. Their number is bounded: from
    ``MOST_SHARDS`` shards on, shards grow. Sorted bounds are sent to the tasks.
    """
    low, high, total = rows.agg(F.min("id"), F.max("id"), F.sum(F.col("payload_bytes") + 1024)).first()
    shard_bytes = max(shard_bytes, (total or 0) // MOST_SHARDS)
    if (total or 0) <= shard_bytes:
        return rows.withColumn("shard", F.lit(0)), 1
    low, high = (0, 0) if low is None else (low, high)
    width = max(1, (high - low).bit_length())
    offset = F.coalesce(F.conv((F.col("id").cast("decimal(20)") - F.lit(low)).cast("string"), 10, 2), F.lit("0"))
    tie = F.conv(F.substring(F.sha1(F.concat_ws(" ", "digest", "url")), 1, 12), 16, 2)
    bits = F.concat(F.when(F.col("id").isNull(), "0").otherwise("1"), F.lpad(offset, width, "0"), F.lpad(tie, 48, "0"))  # null ids come first
    width += 49
    sizes = materialize(rows.select(bits.alias("bits"), (F.col("payload_bytes") + 1024).alias("bytes")), "sizes")
    starts = np.array([r[0] for r in split_by_bits(sizes, shard_bytes, width).select(F.rpad("prefix", width, "0").alias("start")).orderBy("start").collect()], f"S{width}")

    @F.pandas_udf("int")
    def shard_of(bits: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, bits.to_numpy().astype(f"S{width}"), "right") - 1)

    return rows.withColumn("shard", shard_of(bits)), len(starts)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _fields(kind: str, record: uuid.UUID, block: bytes, content: str, more: list[tuple[str, str]]) -> bytes:
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record.urn.join("<>")), ("WARC-Date", DATE), *more, ("WARC-Block-Digest", f"sha1:{digest}"), ("Content-Type", content), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in lines), "\r\n"]).encode() + block + b"\r\n\r\n"


def record_id(page: int | None, digest: str) -> uuid.UUID:
    return uuid.uuid5(_SPACE, f"{page} {digest}")


def _record(page: int | None, url: str, payload: bytes, digest: str, kind: str, refers: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    more = [("WARC-Target-URI", "".join(url.splitlines())), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if page is not None:
        more.append(("Page-Id", str(page)))
    if kind == "revisit":
        more += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers, digest).urn.join("<>")), ("Refers-To-Page-Id", str(refers))]
    return _fields(kind, record_id(page, digest), head if kind == "revisit" else head + payload, "application/http; msgtype=response", more)


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


class _Roller:
    """Files of one task, under temporary names."""

    def __init__(self, root: str, roll_bytes: int):
        self.fs, self.root = _open(root)
        self.roll_bytes, self.out, self.shard, self.number, self.done = roll_bytes, None, None, 0, []

    def write(self, shard: int, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        elif self.out is not None and self.size >= self.roll_bytes:
            self.close()
            self.number += 1
        if self.out is None:
            self.name = f"part-{shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"_temporary/{uuid.uuid4().hex}-{self.name}"
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None), 0, 0, hashlib.sha256()
            info = f"software: shoebox\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
            self._put(_member(_fields("warcinfo", uuid.uuid5(_SPACE, self.name), info, "application/warc-fields", [("WARC-Filename", self.name)])))
        self._put(_member(record))
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.temporary, self.name, self.size, self.records, self.sha.hexdigest()))
            self.out = None


_MANIFEST = "temporary string, name string, bytes bigint, records bigint, sha256 string"


def write_warc(rows: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``records`` as archives below ``root`` (a folder all executors reach) and return the committed manifest.

    Records are ordered by id, then digest and url; null ids come first; rows of one id that are too large for a shard are
    dealt to several by a digest first. A file begins with a warcinfo record. Dates are fixed and record ids follow from the
    page and its digest, so equal tables give equal bytes. Identical rows are never divided; files still roll by size. What
    tasks left under temporary names is removed after the commit.
    """
    spark = rows.sparkSession
    rows, shards = _with_shards(rows, shard_bytes)
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "id", "digest", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = _Roller(root, roll_bytes)
        for whole in batches:
            for shard, page, url, payload, digest, kind, refers in zip(*(c for c in whole.columns), strict=True):
                roller.write(shard.as_py(), _record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), kind.as_py(), refers.as_py()))
        roller.close()
        if roller.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*roller.done, strict=True)], [x.split()[0] for x in _MANIFEST.split(", ")])

    written = dealt.select("shard", "id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(write, _MANIFEST)
    written.write.parquet(f"{root}/_written")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        for whole in batches:
            for row in whole.to_pylist():
                final = f"{base}/{row['name']}"
                if fs.get_file_info(final).type == pafs.FileType.NotFound:
                    fs.move(f"{base}/{row['temporary']}", final)
                if fs.get_file_info(final).size != row["bytes"]:
                    raise OSError(f"{final} is not what was written")
            yield whole

    moved = spark.read.schema(_MANIFEST).parquet(f"{root}/_written").mapInArrow(rename, _MANIFEST)
    moved.drop("temporary").write.parquet(f"{root}/_committed")
    fs, base = _open(root)
    if fs.get_file_info(f"{base}/_temporary").type == pafs.FileType.Directory:
        fs.delete_dir(f"{base}/_temporary")
    return manifest(spark, root)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(name, bytes, records, sha256) of the committed files below ``root``."""
    return spark.read.schema("name string, bytes bigint, records bigint, sha256 string").parquet(f"{root}/_committed")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    data, unpacker, parts = b"", zlib.decompressobj(31), []
    while data := data or stream.read(1 << 20):
        parts.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("a record is cut off")


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is damaged")
    return fields, block


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload, file) of every archived page.

    Digests of blocks and payloads are verified. A revisit has a null payload; its length and digest are those of the
    payload it stands for. Files are spread over tasks and read record by record.
    """
    files = manifest(spark, root)
    n = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        for whole in batches:
            for name in whole.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        fields, block = _parse(member)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(_page(fields, block, name))
                        held += len(member)
                        if held > 1 << 22:
                            yield _page_batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _page_batch(rows)

    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary, file string"
    return files.select("name").repartition(n, "name").mapInArrow(read, schema)


_PAGE = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("file", pa.string())]
)


def _page(fields: dict[str, str], block: bytes, name: str) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(head.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda key: int(fields[key]) if key in fields else None
    return {"page_id": number("Page-Id"), "url": fields["WARC-Target-URI"], "record_type": kind, "payload_bytes": length, "payload_digest": digest, "refers_to": number("Refers-To-Page-Id"), "payload": payload if kind == "response" else None, "file": name}


def _page_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_PAGE)


def archive(pages: DataFrame, root: str | None = None, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, **columns) -> DataFrame:
    """Write ``pages`` as archives and read them back: the rows of ``read_warc``.

    Null bodies are empty payloads and null urls empty ones; a null id has no Page-Id. Of rows with equal payloads of at
    least ``REVISIT_BYTES`` bytes, those with the largest id are responses and the others revisit it; repeated rows are
    written each. Line breaks in a url are dropped in its header. Ids are integers. Other columns are not carried; an empty table
    gives no file.
    """
    spark = pages.sparkSession
    root = root or f"{scratch_dir(spark)}/warc"
    write_warc(records(pages, **columns), root, shard_bytes, roll_bytes)
    return read_warc(spark, root)
