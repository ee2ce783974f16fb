"""Deterministic sharded WARC archives.

Records are range-sorted by page. The ranges follow from the sizes of all records, counted by range and
refined where one is large, never from a sample, so that equal tables give equal files. Each range is
written to files that roll over at a compressed size; every record is one gzip member. Headers and digests
are made anew from the payload. A file is written under a temporary name and renamed when complete; its
manifest row is committed with the task, and only files of the manifest are read. A task that runs again
writes the same bytes to the same names; what lost attempts leave is deleted with the temporary folder.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.storage import materialize, release, release_table

MANIFEST = "file string, records long, bytes long, sha1 string, first_page long, last_page long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A record counts so many bytes beside its payload. A range holds a RANGES-th of all, within these bounds.
RECORD_BYTES, RANGES, LEAST_RANGE, MOST_RANGE = 512, 64, 8 << 20, 512 << 20
#: So many parts of a range are counted at once.
PARTS = 4096
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def filesystem(uri: str):
    """pyarrow's file system for a URI, and the path there; works on executors without a session."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def plan_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to, refers_to_url for pages
    of page_id, url, html.

    Null html is an empty payload. Of equal payloads of at least least_bytes the one with the largest
    page_id is the response and the others revisit it; rows that repeat that page_id are responses too.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    named = F.struct("page_id", "url")
    copies = rows.where(F.octet_length("payload") >= least_bytes).groupBy("payload_digest").agg(F.max(named).alias("newest"), F.count("*").alias("n")).where("n > 1").select("payload_digest", F.col("newest.page_id").alias("last"), F.col("newest.url").alias("last_url"))
    joined = rows.join(materialize(copies, "copies"), "payload_digest", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"), F.when(revisit, F.col("last_url")).alias("refers_to_url"))


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}/{digest}'.encode()).digest())}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _b32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None, page_id: int | None) -> str:
    return (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A").strip()


def page_record(row: dict, date: str) -> bytes:
    url = _uri(row["url"], row["page_id"])
    payload = row["payload"] if row["record_type"] == "response" else None
    block = HTTP % row["payload_bytes"] + (payload or b"")
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    headers = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", _urn(row["page_id"], row["payload_digest"])), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", _b32(block)), ("Content-Type", "application/http;msgtype=response"), ("X-Page-ID", "" if row["page_id"] is None else str(row["page_id"])), ("X-URL-Given", str(int(row["url"] is not None)))]
    if payload is None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(row["refers_to"], row["payload_digest"])), ("WARC-Refers-To-Target-URI", _uri(row["refers_to_url"], row["refers_to"])), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page", str(row["refers_to"]))]
    return _record(headers, block)


class _File:
    """One archive under its temporary name."""

    def __init__(self, fs, folder: str, temporary: str, name: str, date: str):
        self.fs, self.folder, self.name = fs, folder, name
        self.temporary = f"{folder}/{temporary}/{name}.{uuid.uuid4().hex}"
        self.stream = fs.open_output_stream(self.temporary, compression=None)
        self.records, self.bytes, self.sha1, self.first, self.last = 0, 0, hashlib.sha1(), None, None
        info = f"software: lamella\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
        self.write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(None, name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))

    def write(self, record: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = packer.compress(record) + packer.flush()
        self.stream.write(data)
        self.sha1.update(data)
        self.bytes += len(data)

    def add(self, row: dict, date: str) -> None:
        self.write(page_record(row, date))
        self.first = row["page_id"] if self.records == 0 else self.first
        self.last = row["page_id"]
        self.records += 1

    def commit(self) -> tuple:
        from pyarrow.fs import FileType

        self.stream.close()
        final = f"{self.folder}/{self.name}"
        there = self.fs.get_file_info(final)
        if there.type == FileType.NotFound:
            self.fs.move(self.temporary, final)
        elif there.size == self.bytes:  # another attempt has written the same
            self.fs.delete_file(self.temporary)
        else:  # of a run that failed; some stores don't rename over it
            self.fs.delete_file(final)
            self.fs.move(self.temporary, final)
        return self.name, self.records, self.bytes, self.sha1.hexdigest(), self.first, self.last


FIRST_ID = -(1 << 63)


def _parts_of(low: int, high: int, size: int, target: int) -> int:
    """The width of the parts in which a range is counted."""
    parts = min(PARTS, max(2, -(-4 * size // target)))
    return -(-(high - low + 1) // parts)


def ranges(sizes: DataFrame) -> tuple[list[int], list[int]]:
    """First ids of consecutive ranges of about equal bytes, and into how many parts each is cut by digest (1,
    unless one id has too much). sizes has id and bytes. The lists grow with the bytes over MOST_RANGE.
    """
    total, low, high = sizes.agg(F.sum("bytes"), F.min("id"), F.max("id")).first()
    if total is None:
        return [FIRST_ID], [1]
    target = max(LEAST_RANGE, min(MOST_RANGE, total // RANGES))
    leaves, open_ = [], [(low, high, total)]
    while open_:
        large = [x for x in open_ if x[2] > target and x[0] < x[1]]
        leaves += [x for x in open_ if x[2] <= target or x[0] == x[1]]
        if not large:
            break
        large.sort()
        lows = np.array([x[0] for x in large], np.int64)
        highs = np.array([x[1] for x in large], np.int64)
        widths = np.array([_parts_of(*x, target) for x in large], np.uint64)

        def count(batches: Iterable[pa.RecordBatch], lows=lows, highs=highs, widths=widths) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                at = np.searchsorted(lows, ids, "right") - 1
                inside = (at >= 0) & (ids <= highs[at])
                ids, size, at = ids[inside], size[inside], at[inside]
                part = (ids.view(np.uint64) - lows[at].view(np.uint64)) // widths[at]
                keys, place = np.unique(np.stack([at.astype(np.int64), part.astype(np.int64)], 1), axis=0, return_inverse=True)
                sums = np.bincount(place.ravel(), size, len(keys)).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sums)], names=["at", "part", "bytes"])

        counted = sizes.select("id", "bytes").mapInArrow(count, "at long, part long, bytes long").groupBy("at", "part").agg(F.sum("bytes")).collect()
        open_ = []
        for at, part, size in counted:
            first = int(lows[at]) + part * int(widths[at])
            open_.append((first, min(first + int(widths[at]) - 1, int(highs[at])), size))
    starts, cuts, held = [], [], 0
    for first, last, size in sorted(leaves):
        if not starts or held + size > target or cuts[-1] > 1:
            starts.append(first)
            cuts.append(max(1, -(-size // target)) if first == last else 1)
            held = 0
        held += size
    return starts, cuts


def write_warc(records: DataFrame, folder_uri: str, roll_bytes: int = 256 << 20, prefix: str = "pages", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes records as plan_records() gives them to folder_uri; returns the committed manifest.

    Files begin anew with each range and when one has reached roll_bytes compressed. An empty table gives
    no files and an empty manifest.
    """
    spark, temporary = records.sparkSession, f"_temporary-{uuid.uuid4().hex}"
    id_ = F.coalesce("page_id", F.lit(FIRST_ID))
    bytes_ = (F.coalesce(F.octet_length("payload"), F.lit(0)) + RECORD_BYTES).cast("long")
    sizes = materialize(records.select(id_.alias("id"), bytes_.alias("bytes")), "sizes")
    starts, cuts = ranges(sizes)
    release_table(sizes)
    lows, parts = np.array(starts, np.int64), np.array(cuts, np.int64)
    numbers = np.concatenate([[0], np.cumsum(parts)])

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, heads: pd.Series) -> pd.Series:
        at = np.searchsorted(lows, ids.to_numpy(), "right") - 1
        head = heads.map(lambda x: int(x, 16)).to_numpy(np.int64)
        return pd.Series(numbers[at] + head * parts[at] // 65536, dtype="int32")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(folder_uri)
        fs.create_dir(f"{folder}/{temporary}", recursive=True)
        now, rolled, file, done = None, 0, None, []
        for batch in batches:
            for i, number in enumerate(batch.column("range").to_pylist()):
                if number != now:
                    if file:
                        done.append(file.commit())
                    now, rolled, file = number, 0, None
                if file is None:
                    file = _File(fs, folder, temporary, f"{prefix}-{number:06d}-{rolled:04d}.warc.gz", date)
                    rolled += 1
                file.add({k: batch.column(k)[i].as_py() for k in batch.schema.names}, date)
                if file.bytes >= roll_bytes:
                    done.append(file.commit())
                    file = None
        if file:
            done.append(file.commit())
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*done, strict=True)) or [[]] * 6, kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    # in a range cut by digest the digest comes right after the id
    order = ["range", "page_id", "payload_digest", "url", "payload"]
    placed = records.withColumn("range", range_of(id_, F.substring("payload_digest", 1, 4)))
    manifest = placed.repartitionById(int(numbers[-1]), F.col("range")).sortWithinPartitions(*order).mapInArrow(write, MANIFEST)
    manifest.write.mode("errorifexists").parquet(f"{folder_uri}/_manifest")
    release(spark, f"{folder_uri}/{temporary}")
    return spark.read.schema(MANIFEST).parquet(f"{folder_uri}/_manifest")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    reader = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    while line := reader.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins here: {line[:40]!r}")
        headers = {}
        while (line := reader.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = reader.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("a record ends early")
        yield headers, block


def read_warc(spark: SparkSession, folder_uri: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest (hex), record_type, refers_to and payload of all page
    records of the manifest's files; digests of blocks and payloads are checked. payload is null for
    revisits and where payloads is false.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(folder_uri)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        rows, held = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for headers, block in read_records(stream):
                        if headers["warc-type"] == "warcinfo":
                            continue
                        if _b32(block) != headers["warc-block-digest"]:
                            raise ValueError(f"{name}: a block's digest differs")
                        head, _, payload = block.partition(b"\r\n\r\n")
                        response = headers["warc-type"] == "response"
                        if response and _b32(payload) != headers["warc-payload-digest"]:
                            raise ValueError(f"{name}: a payload's digest differs")
                        size = len(payload) if response else int(head.rpartition(b"Content-Length:")[2])
                        digest = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
                        page, refers = headers["x-page-id"], headers.get("x-refers-to-page")
                        rows.append((int(page) if page else None, headers["warc-target-uri"] if headers["x-url-given"] == "1" else None, size, digest, headers["warc-type"], int(refers) if refers else None, payload if response and payloads else None))
                        held += len(block) if payloads else 200
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)], names=names)

    files = spark.read.schema(MANIFEST).parquet(f"{folder_uri}/_manifest").select("file")
    # a number of partitions that is stated stays; small rows of names would else meet in one task
    return files.repartition(max(1, files.count())).mapInArrow(read, RECORDS)
