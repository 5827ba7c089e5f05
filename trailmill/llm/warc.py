"""WARC archives of pages, and a two-level capture index over them.

Archives are written by Spark's text writer with CR LF CR LF as line separator, which is just how WARC
records end, so any store that Spark can write will do. The index sorts captures by reversed host, packs
them into compressed blocks and keeps a directory of each block's first key; a lookup bisects the
directory, then a block, and then reads ranges of archives. Many keys are looked up at once as Spark jobs,
by parts of the index, and ranges are read in the order of archives and offsets.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.functions.shared import scratch_path, written
from trailmill.llm import textkit as tk

END = "\r\n\r\n"
BLOCK_LINES = 256
#: Bytes of payloads that an archive holds at most (one larger payload is an archive of its own), and records.
ARCHIVE_BYTES, RECORDS_PER_FILE = 1 << 28, 4000
SALTS = 32
#: Repeated payloads (under 100 bytes a row) are broadcast up to so many, so that payloads needn't be shuffled.
BROADCAST_ROWS = 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, offset long, length long"
BLOCK = "part int, block int, first_key string, last_key string, lines int, data binary"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a 40-digit hex SHA-1: each five hex digits are four letters."""
    five = lambda i: F.conv(F.substring(digest, 5 * (i // 4) + 1, 5), 16, 10).cast("int")
    letter = lambda i: F.substring(F.lit(BASE32), F.shiftright(five(i), 15 - 5 * (i % 4)).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[letter(i) for i in range(32)])


def surt(url: Column) -> Column:
    """Reversed-host key of a URL: com,example)/path?query; a URL without host keeps its own text."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.coalesce(F.when(host == "", url).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)), F.lit(""))


def _target(url: Column) -> Column:
    """A URL as records hold it: without line ends."""
    return F.replace(F.replace(url.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """`pages` with size, digest, record_type and refers_to.

    The largest page_id of each payload of at least `min_bytes` bytes is the response. Repeated payloads are
    counted: few are broadcast; many are joined by salted keys, as one payload may be hot.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"),
        F.octet_length(body).cast("long").alias("size"), F.sha1(F.encode(body, "UTF-8")).alias("sha1"))
    keys = rows.filter((F.col("size") >= min_bytes) & F.col("page_id").isNotNull())
    kept = keys.groupBy("sha1").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").select("sha1", "kept")
    kept = written(kept, "warc-repeats")
    if kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = rows.join(F.broadcast(kept), "sha1", "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        found = salted.join(kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["sha1", "salt"], "left")
    refers = F.when(F.col("kept") > F.col("page_id"), F.col("kept"))
    return found.select("page_id", "url", "html", "size", base32_of_hex(F.col("sha1")).alias("digest"), refers.alias("refers_to"),
                        F.when(refers.isNull(), "response").otherwise("revisit").alias("record_type"))


def _urn(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0) -> None:
    """A WARC/1.1 response or revisit record for every row of pages(page_id, url, html).

    A null html is an empty payload; a null page_id is always a response; rows equal in page_id and
    payload are written alike. CR and LF in a URL are percent-encoded. Payloads of any length are written whole.
    """
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    rows = records(pages, min_bytes)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(F.col("record_type") == "response", F.concat(http, "html")).otherwise(http)
    url = _target(F.col("url"))
    is_revisit = F.col("refers_to").isNotNull()
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("refers_to"))),
                                    line("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        line("X-Page", F.col("page_id").cast("string")), F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)
    # sizes by powers of two, so that records and bytes of an archive are both bounded without moving a payload
    kind = F.greatest(F.ceil(F.log2(F.greatest("size", F.lit(1)))), F.lit((ARCHIVE_BYTES // RECORDS_PER_FILE).bit_length() - 1)).cast("int")
    sizes = [r.kind for r in pages.select(F.coalesce(F.octet_length("html"), F.lit(0)).alias("size")).select(kind.alias("kind")).distinct().collect()]  # 32 at most
    for k in sorted(sizes) or [0]:
        part = rows.filter(kind == k) if len(sizes) > 1 else rows
        part.select(record.alias("value")).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", max(1, min(RECORDS_PER_FILE, ARCHIVE_BYTES >> k))).text(path)


def _opened(path: str) -> pa.NativeFile:
    """An archive for reading at any place; stores are those that pyarrow knows (file, hdfs, s3, gs, abfs)."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    store, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if scheme == "s3a" else path)
    return store.open_input_file(name)


def _heads(archive: pa.NativeFile, at: int) -> tuple[dict[str, str], int, int, int]:
    """(fields, place of the payload, bytes that its head says, length) of the record at `at`; payloads are not read."""
    size, seen = 1 << 13, b""
    while True:
        seen = archive.read_at(size, at)
        head = seen.find(b"\r\n\r\n")
        inner = seen.find(b"\r\n\r\n", head + 4) if head >= 0 else -1
        if inner >= 0:
            break
        if len(seen) < size:
            raise ValueError(f"no record at {at}")
        size *= 4
    fields = dict(x.split(": ", 1) for x in seen[:head].decode().split("\r\n")[1:])
    said = int(seen[head + 4 : inner].split(b"Content-Length: ")[1].split(b"\r")[0])
    return fields, at + inner + 4, said, head + 8 + int(fields["Content-Length"])


def _capture(fields: dict[str, str], size: int, digest: str, file: str, at: int, length: int) -> tuple:
    page, refers = fields.get("X-Page"), fields.get("X-Refers-To-Page")
    return int(page) if page else None, size, digest, fields["WARC-Type"], int(refers) if refers else None, fields.get("WARC-Target-URI"), file, at, length


NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Captures in batches."""
    while mine := list(itertools.islice(rows, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*mine, strict=True), KINDS, strict=True)], NAMES)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A capture for each record below `path`, from the heads of records: payloads are passed over, and archives may be of any size."""

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for file, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                with _opened(file) as archive:
                    at = 0
                    while at < size:
                        fields, _, said, length = _heads(archive, at)
                        if archive.read_at(4, at + length - 4) != b"\r\n\r\n":
                            raise ValueError(f"{file}: record at {at} doesn't end where its length says")
                        yield _capture(fields, said, fields["WARC-Payload-Digest"].removeprefix("sha1:"), file, at, length)
                        at += length

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length")  # no content
    return found.mapInArrow(tk.lean(lambda batches: _batches(captures(batches))), CAPTURE)


def read_ranges(captures: DataFrame) -> DataFrame:
    """`captures` with sizes, digests, types and references as their records have them, each read by its own range.

    Ranges are read in the order of archives and offsets, one record in memory at a time. The digest is that of the payload
    read; a revisit, which holds none, keeps what it names. A record that contradicts its head or its capture is an error.
    """
    ordered = captures.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        file, archive = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != file:
                    if archive is not None:
                        archive.close()
                    file, archive = row["file"], _opened(row["file"])
                at, length = row["offset"], row["length"]
                record = pa.BufferReader(archive.read_at(length, at))
                fields, start, size, known = _heads(record, 0)
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if known != length or record.size() != length:
                    raise ValueError(f"{file}: the record at {at} is not of {length} bytes")
                if fields["WARC-Type"] == "response":
                    payload = record.read_at(length - 4 - start, start)
                    size = len(payload)
                    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{file}: payload at {at} doesn't have its digest")
                found = _capture(fields, size, digest, file, at, length)
                if found[0] != row["page_id"] or digest != row["payload_digest"]:
                    raise ValueError(f"{file}: the record at {at} is another one than its capture")
                yield found
        if archive is not None:
            archive.close()

    return ordered.mapInArrow(tk.lean(lambda batches: _batches(read(batches))), CAPTURE)


def write_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> None:
    """Blocks of captures in the order of (reversed-host key, page_id), and a directory of the blocks."""
    keyed = captures.withColumn("key", surt(F.col("url")))
    ordered = keyed.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, lines = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            data = zlib.compress("\n".join(map(json.dumps, lines)).encode())  # JSON escapes line ends
            row = ([part], [block], [lines[0][0]], [lines[-1][0]], [len(lines)], [data])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.binary()), strict=True)], [x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                lines.append((row.pop("key"), row))
                if len(lines) == block_lines:
                    yield flush()
                    block, lines = block + 1, []
        if lines:
            yield flush()

    ordered.mapInArrow(tk.lean(run), BLOCK).write.parquet(f"{path}/blocks")
    blocks = captures.sparkSession.read.parquet(f"{path}/blocks")
    blocks.select("part", "block", "first_key", "last_key").write.parquet(f"{path}/directory")


def _lines(data: bytes) -> list[tuple[str, dict]]:
    return [tuple(json.loads(x)) for x in zlib.decompress(data).decode().split("\n")]


def _runs(firsts: list[str], lasts: list[str], key: str) -> range:
    """Which of the ranges firsts[i] to lasts[i], both ascending, hold `key`: by bisection."""
    return range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))


def lookups(spark: SparkSession, index: str, keys: DataFrame) -> DataFrame:
    """Captures of all of `keys` (key), each of them once.

    A key goes to the parts of the index that can hold it (a part is a range of keys; there are as many as the index was
    written in, so their bounds are few). There it is bisected for in the part's directory, a row for each BLOCK_LINES
    captures, and then in the blocks found, each of which is opened once. Blocks that no key asks for are not decompressed.
    """
    directory = spark.read.parquet(f"{index}/directory")
    ends = sorted(tuple(r) for r in directory.groupBy("part").agg(F.min("first_key"), F.max("last_key")).collect())
    parts, firsts, lasts = [r[0] for r in ends], [r[1] for r in ends], [r[2] for r in ends]

    def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(parts[i], k) for k in batch.column("key").to_pylist() for i in _runs(firsts, lasts, k)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.string())], ["part", "key"])

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks, low, high = None, [], [], []
        for batch in batches:
            found = []
            for p, block, key, last in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "key", "last")), strict=True):
                if p != part:
                    part, blocks, low, high = p, [], [], []
                if last is not None:
                    blocks.append(block), low.append(key), high.append(last)
                else:
                    found += [(p, blocks[i], key) for i in _runs(low, high, key)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))], ["part", "block", "key"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for data, wanted in zip(batch.column("data"), batch.column("keys").to_pylist(), strict=True):
                lines = _lines(data.as_py())
                held = [k for k, _ in lines]
                for key in wanted:
                    for _, row in lines[bisect.bisect_left(held, key) : bisect.bisect_right(held, key)]:
                        yield tuple(row[n] for n in NAMES)

    asked = keys.select("key").filter("key is not null").distinct().mapInArrow(tk.lean(to_parts), "part int, key string")
    both = directory.select("part", "block", F.col("first_key").alias("key"), F.col("last_key").alias("last")).unionAll(asked.select("part", F.lit(None).cast("int").alias("block"), "key", F.lit(None).cast("string").alias("last")))
    searched = both.repartition("part").sortWithinPartitions("part", F.col("block").asc_nulls_last()).mapInArrow(tk.lean(to_blocks), "part int, block int, key string")
    wanted = searched.groupBy("part", "block").agg(F.collect_list("key").alias("keys"))  # a block has BLOCK_LINES keys at most
    hits = spark.read.schema(BLOCK).parquet(f"{index}/blocks").select("part", "block", "data").join(wanted, ["part", "block"])
    return hits.select("data", "keys").mapInArrow(tk.lean(lambda batches: _batches(opened(batches))), CAPTURE)


def lookup(spark: SparkSession, index: str, url: str) -> list[dict]:
    """Captures of one URL: the directory is filtered for the blocks that can hold its key; those alone are asked for and searched by bisection."""
    key = spark.range(1).select(surt(F.lit(url))).first()[0]
    near = spark.read.parquet(f"{index}/directory").filter((F.col("first_key") <= key) & (F.col("last_key") >= key)).groupBy("part").agg(F.min("block").alias("a"), F.max("block").alias("b")).collect()
    found, mine = [], F.lit(False)
    for r in near:  # blocks of a part are in key order: those of one key are a run
        mine = mine | (F.col("part") == r["part"]) & F.col("block").between(r["a"], r["b"])
    for row in spark.read.schema(BLOCK).parquet(f"{index}/blocks").filter(mine).select("data").toLocalIterator():
        lines = _lines(bytes(row[0]))
        keys = [k for k, _ in lines]
        found += [v for _, v in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
    return sorted(found, key=lambda r: (r["page_id"] is None, r["page_id"]))


def read_range(spark: SparkSession, capture: dict) -> bytes:
    """The record of a capture: one range of one archive, read from its offset on by the driver's JVM."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(capture["file"])
    stream = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(at)
    try:
        stream.seek(capture["offset"])
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, capture["length"]))
    finally:
        stream.close()


def archive_round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write archives and index of `pages` below `path`, look every URL of `pages` up in the index, and read the records found.

    An empty table gives an empty table; every row of `pages` gives one capture, rows equal in all columns too. Null urls
    share the empty key; a null html is an empty payload, a null page_id always a response. Payloads and urls of any length
    are whole. Other columns than page_id, url and html are ignored.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, f"{path}/archives", min_bytes=min_bytes)
    write_index(read_archives(spark, f"{path}/archives"), f"{path}/index")
    captures = lookups(spark, f"{path}/index", pages.select(surt(_target(F.col("url"))).alias("key")))
    return read_ranges(written(captures, "warc-captures"))
