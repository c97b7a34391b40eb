"""Deterministic sharded WARC writer and reader.

Records are sorted by page id into shards. Shard borders are quantiles of a sample taken by a hash of the id, so the
same pages always give the same files. A task streams each of its shards into gzip members, one a record, and starts
a new file where the compressed size reaches ``roll_bytes``. Files are written under names of the attempt; the rows
of a successful attempt name them. ``commit`` renames them and writes the manifest last; readers open only files
of the manifest, so what a lost executor left behind is never seen. Both steps can be repeated.

Records of equal payloads (of at least ``revisit_bytes`` bytes) are one response, that with the smallest page id, and
revisits of it. Only possibly equal payloads are shuffled for that.

Defined cases: null html is an empty payload; a null url is written as ``about:blank``; white space and control
characters of a url are percent-encoded; a page without id is never referred to while another has one, and sorts
last; of rows repeated whole one is the response; an empty table gives an empty manifest. Other columns are not written.
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
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxframe.llm import exact_dedup
from rxframe.llm.common import column
from rxframe.session import settle

SHARD_BYTES = 64 << 20
ROLL_BYTES = 16 << 20
SAMPLE_PER_SHARD = 50
MAX_SAMPLE = 2_000_000
#: About what headers add to a payload.
RECORD_BYTES = 600
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
WRITTEN = "shard long, part int, name string, temp string, bytes long, records long, sha256 string"
READ = (
    "page_id long, url string, date string, record_type string, record_id string, payload_digest string, "
    "payload_bytes long, refers_to long, refers_to_record string"
)


def filesystem(uri: str):
    """The file system and path of ``uri``; tasks and driver must both reach it."""
    fs, path = afs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return fs, path


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}/{digest}/{kind}')}>"


def _clean(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + pack.flush()


def page_record(page, url: str | None, payload: bytes, refers_to, revisit: bool, date: str) -> bytes:
    digest = base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    kind = "revisit" if revisit else "response"
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page, digest, kind)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page is not None:
        headers.append(("Page-Id", str(page)))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, "response"))]
        if refers_to is not None:
            headers.append(("Refers-To-Page-Id", str(refers_to)))
    return member(headers, block)


def records(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``revisit`` and ``refers_to`` of each page."""
    payload = F.coalesce(column(pages, "html", "string"), F.lit("")).cast("binary")
    rows = pages.select(
        column(pages, "page_id", "long").alias("page_id"), column(pages, "url", "string").alias("url"), payload.alias("payload")
    )
    # Smaller payloads get a digest of their own, so they equal nothing.
    same = F.when(F.length("payload") >= revisit_bytes, F.sha2("payload", 256)).otherwise(F.uuid())
    rows = rows.withColumn("digest", same if revisit_bytes else F.sha2("payload", 256)).withColumn("length", F.lit(0).cast("long"))
    marked = exact_dedup.mark(rows, digest="digest", length="length", ident="page_id")
    return marked.select(
        "page_id", "url", "payload", (~F.col("kept")).alias("revisit"), F.when(~F.col("kept"), F.col("keep_id")).alias("refers_to")
    )


def borders(rows: DataFrame, shard_bytes: int) -> np.ndarray:
    """Page ids at which a new shard begins: quantiles by bytes of a sample that depends on the ids alone."""
    n, total = rows.agg(F.count(F.lit(1)), F.sum(F.length("payload").cast("long"))).first()
    shards = max(1, -(-(total or 0) // shard_bytes))
    if shards == 1:
        return np.array([], dtype="i8")
    share = min(1.0, min(MAX_SAMPLE, shards * SAMPLE_PER_SHARD) / n)
    chosen = rows.filter(F.col("page_id").isNotNull()).filter(
        F.shiftrightunsigned(F.xxhash64("page_id"), 32) < int(share * 2**32)
    )
    found = np.array([tuple(r) for r in chosen.select("page_id", F.length("payload") + RECORD_BYTES).collect()], dtype="i8").reshape(-1, 2)
    found = found[np.argsort(found[:, 0], kind="stable")]
    before = np.cumsum(found[:, 1]) - found[:, 1]
    parts = np.arange(1, shards) * (found[:, 1].sum() / shards)
    return np.unique(found[np.searchsorted(before, parts, "right") - 1, 0]) if len(found) else found[:, 0]


def write(
    pages: DataFrame,
    root: str,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
    revisit_bytes: int = 0,
    date: str = DATE,
    prefix: str = "pages",
) -> DataFrame:
    """Write ``pages`` below ``root`` and return the manifest."""
    rows = records(pages, revisit_bytes)
    slim = pages.select(column(pages, "page_id", "long").alias("page_id"), F.coalesce(column(pages, "html", "string"), F.lit("")).cast("binary").alias("payload"))
    at = borders(slim, shard_bytes)

    @F.pandas_udf("long")
    def shard_of(page: pd.Series) -> pd.Series:
        known = page.notna().to_numpy()
        found = np.searchsorted(at, page.fillna(0).astype("int64").to_numpy(), "right")
        return pd.Series(np.where(known, found, len(at)))

    # Ids beyond 2**53 would be rounded where a batch holds a null, so nulls never reach the function.
    shard = F.when(F.col("page_id").isNull(), F.lit(len(at)).cast("long")).otherwise(shard_of(F.coalesce("page_id", F.lit(0))))

    job = uuid.uuid4().hex

    def store(batches):
        fs, path = filesystem(root)
        attempt = f"{job}-{uuid.uuid4().hex}"
        fs.create_dir(f"{path}/_temporary", recursive=True)
        done: list[tuple] = []
        state: dict = {"shard": None}

        def close():
            if state.get("file"):
                state["file"].close()
                done.append((state["shard"], state["part"], state["name"], state["temp"], state["bytes"], state["records"], state["sum"].hexdigest()))
                state["file"] = None

        def put(data: bytes):
            state["file"].write(data)
            state["sum"].update(data)
            state["bytes"] += len(data)

        def begin(shard: int, part: int):
            close()
            name = f"{prefix}-{shard:06d}-{part:04d}.warc.gz"
            state.update(shard=shard, part=part, name=name, temp=f"_temporary/{attempt}-{name}", bytes=0, records=0, sum=hashlib.sha256())
            state["file"] = fs.open_output_stream(f"{path}/{state['temp']}", compression=None)
            info = f"format: WARC File Format 1.1\r\nisPartOf: {prefix}\r\n".encode()
            put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, "", "warcinfo")), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("shard", "page_id", "url", "payload", "revisit", "refers_to")), strict=True):
                if row[0] != state["shard"]:
                    begin(row[0], 0)
                elif state["bytes"] >= roll_bytes:
                    begin(row[0], state["part"] + 1)
                put(page_record(row[1], row[2], row[3], row[5], row[4], date))
                state["records"] += 1
        close()
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*done, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "part", "name", "temp", "bytes", "records", "sha256"]
        )

    sorted_rows = (
        rows.withColumn("shard", shard)
        .repartitionById(len(at) + 1, F.col("shard").cast("int"))
        .sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "url", "revisit", "payload")
    )
    return commit(settle(sorted_rows.mapInArrow(store, WRITTEN), "written"), root, job)


def commit(written: DataFrame, root: str, job: str | None = None) -> DataFrame:
    """Give the files their names, then write the manifest that makes them count, then remove what ``job`` left."""

    def rename(batches):
        fs, path = filesystem(root)
        for batch in batches:
            for temp, name in zip(batch.column("temp").to_pylist(), batch.column("name").to_pylist(), strict=True):
                # An earlier attempt may have moved it.
                if fs.get_file_info(f"{path}/{temp}").type == afs.FileType.File:
                    fs.move(f"{path}/{temp}", f"{path}/{name}")
                elif fs.get_file_info(f"{path}/{name}").type != afs.FileType.File:
                    raise FileNotFoundError(f"{path}/{name}")
            yield batch

    spark = written.sparkSession
    written.mapInArrow(rename, WRITTEN).drop("temp").write.mode("overwrite").parquet(f"{root}/manifest")
    fs, path = filesystem(root)
    if job and fs.get_file_info(f"{path}/_temporary").type == afs.FileType.Directory:
        # Lost attempts of this job; files of other writers stay.
        left = fs.get_file_info(afs.FileSelector(f"{path}/_temporary"))
        own = [f for f in left if f.base_name.startswith(job)]
        for f in own:
            fs.delete_file(f.path)
        if len(own) == len(left):
            fs.delete_dir(f"{path}/_temporary")
    return spark.read.schema(WRITTEN).parquet(f"{root}/manifest").drop("temp")


class Summed:
    """A stream that counts and hashes what is read."""

    def __init__(self, stream):
        self.stream, self.bytes, self.sum = stream, 0, hashlib.sha256()

    def read(self, size: int) -> bytes:
        data = self.stream.read(size)
        self.bytes += len(data)
        self.sum.update(data)
        return data


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    data, unpack, out = b"", zlib.decompressobj(31), []
    while True:
        data = data or stream.read(size)
        if not data:
            if out:
                raise ValueError("a record is cut short")
            return
        out.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(out)
            unpack, out = zlib.decompressobj(31), []


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a {VERSION} record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def read(spark: SparkSession, root: str, with_payload: bool = False) -> DataFrame:
    """The page records of all files of the manifest; files, blocks and payloads are checked against their digests, sizes and digests are of whole payloads."""
    manifest = spark.read.schema(WRITTEN).parquet(f"{root}/manifest").select("name", "bytes", "sha256")
    n = manifest.count()

    def load(batches):
        fs, path = filesystem(root)
        kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [*(c.split()[0] for c in READ.split(", ")), "payload"]

        def out(rows):
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays[: 9 + with_payload], names[: 9 + with_payload])

        for batch in batches:
            for name, size, digest_ in zip(*(batch.column(c).to_pylist() for c in ("name", "bytes", "sha256")), strict=True):
                rows, held = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    summed = Summed(stream)
                    for raw in members(summed):
                        h, block = parse(raw)
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        if h["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
                            raise ValueError(f"{name}: a block differs from its digest")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        length = int(http.rsplit(b"Content-Length: ", 1)[1])
                        if h["WARC-Type"] == "response" and (len(payload), base32(hashlib.sha1(payload).digest())) != (length, digest):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        page, to = h.get("Page-Id"), h.get("Refers-To-Page-Id")
                        rows.append((page and int(page), h["WARC-Target-URI"], h["WARC-Date"], h["WARC-Type"], h["WARC-Record-ID"], digest, length, to and int(to), h.get("WARC-Refers-To"), payload if with_payload and h["WARC-Type"] == "response" else None))
                        held += len(block) if with_payload else 300
                        if held > 8 << 20:
                            yield out(rows)
                            rows, held = [], 0
                if (summed.bytes, summed.sum.hexdigest()) != (size, digest_):
                    raise ValueError(f"{name}: the file differs from its manifest")
                yield out(rows)

    schema = READ + ", payload binary" * with_payload
    return manifest.repartition(max(1, min(n, 4096))).mapInArrow(load, schema)
