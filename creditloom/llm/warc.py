"""Web archives (WARC 1.1) with one gzip member per record, and their capture index by external merge.

Every task sorts its captures by URL key, time and id and writes them to archive files in that order; what it notes of them, a line per record, is one sorted run.
Runs are cut at the same bounds of that order, and a task merges its cut of all runs with a loser tree: the capture histories of all URLs,
in one global order, each line with the place of its record. A payload that several records share is stored once; the others are revisit records
that name it and keep its length in their HTTP head. Archives are written under a temporary name first, where every executor can read them.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.shared import Steps, arrow_map
from creditloom.llm.words import pieces

BYTES_PER_FILE = 256 << 20
CAPTURES_PER_SHARD = 200_000
LEVEL = 6
LAST_SECOND = 253402300799  # of the year 9999; capture times are held within 0 and this
READ = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space for URLs
CAPTURE = "run long, place long, url_key string, captured long, page_id long, file string, offset long, size long"
RECORD = "file string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: Column) -> Column:
    """Host read from the right, then path and query: example.org/a?b becomes org,example)/a?b. A text that is no URL is its own key, null is empty."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    query = F.try_parse_url(url, F.lit("QUERY"))
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    turned = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path, F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    return F.coalesce(turned, url, F.lit(""))


def record_name(page_id: int | None, digest: str, more: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id} {digest} {more}'.strip())}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _zipped(record: bytes) -> bytes:
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # a gzip member without a time
    return press.compress(record) + press.flush()


def _moment(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def capture_record(page_id: int | None, url: str | None, captured: int, payload: bytes, refers_to: int | None, place: str) -> bytes:
    """A response record, or a revisit of the page `refers_to`. Control characters, blanks and letters beyond ASCII of the URL are percent-encoded."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Date", _moment(captured)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers_to is None:
        return _record([("WARC-Type", "response"), ("WARC-Record-ID", record_name(page_id, digest)), *fields], head + payload)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_name(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    return _record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_name(page_id, digest, place)), *fields], head)


def members(stream, size: int = READ) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of an open file, one held at a time."""
    at, rest = 0, b""
    while rest := rest or stream.read(size):
        press, content, taken = zlib.decompressobj(31), [], 0
        while True:
            content.append(press.decompress(rest))
            taken += len(rest) - len(press.unused_data)
            if press.eof:
                break
            rest = stream.read(size)
            if not rest:
                raise ValueError("an archive ends inside a record")
        yield at, b"".join(content)
        at, rest = at + taken, press.unused_data


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, body = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    length = int(fields["Content-Length"])
    if not first.startswith("WARC/1.") or len(body) != length + 4:
        raise ValueError("not a whole record")
    return fields, body[:length]


class LoserTree:
    """k-way merge of sorted lists: an inner node keeps the loser of its match, so the next smallest item costs one path of matches from leaf to root."""

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        for leaf in range(len(runs) - 1, -1, -1):
            self._play(leaf, filling=True)

    def _before(self, a: int, b: int) -> bool:
        """Whether the head of run a comes before that of run b; ended runs come last."""
        if self.at[a] == len(self.runs[a]) or self.at[b] == len(self.runs[b]):
            return self.at[a] < len(self.runs[a])
        return (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def _play(self, leaf: int, filling: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0 and filling:
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.runs and self.at[win := self.losers[0]] < len(self.runs[win]):
            yield self.runs[win][self.at[win]]
            self.at[win] += 1
            self._play(win)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return store, path.rstrip("/")


def _captures(rows: DataFrame, folder: str, bytes_per_file: int) -> DataFrame:
    """Writes sorted rows (url_key, captured, id, url, payload, refers_to) to archives; a row per record: its run, place in the run, key and place in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(f"{folder}/archives")
        store.create_dir(path, recursive=True)
        number, chunk, place, out, lines = TaskContext.get().partitionId(), 0, 0, None, []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out, chunk, lines
            if out is not None:
                out.close()
                store.move(unfinished, f"{path}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*lines, strict=True), KINDS, strict=True)], COLUMNS)
                out, lines, chunk = None, [], chunk + 1

        for batch in pieces(batches, "payload"):
            for row in batch.to_pylist():
                if out is None:
                    name = f"{number:06d}-{chunk:06d}.warc.gz"
                    unfinished = f"{path}/.{name}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(unfinished, compression=None)
                    info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_name(None, name)), ("WARC-Date", _moment(0)), ("WARC-Filename", name),
                                    ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(_zipped(info))
                offset = out.tell()
                record = capture_record(row["id"], row["url"], row["captured"], row["payload"].encode(), row["refers_to"], f"{name} {offset}")
                out.write(_zipped(record))
                lines.append((number, place, row["url_key"], row["captured"], row["id"], name, offset, out.tell() - offset))
                place += 1
                if out.tell() >= bytes_per_file:
                    yield from close()
        yield from close()

    return arrow_map(rows, run, CAPTURE)


COLUMNS = [f.split()[0] for f in CAPTURE.split(", ")]
KINDS = [pa.string() if f.endswith("string") else pa.int64() for f in CAPTURE.split(", ")]


def merge_runs(runs: DataFrame, captures_per_shard: int = CAPTURES_PER_SHARD) -> DataFrame:
    """The captures of all runs in one order by URL key, time, id (null first) and place of the record: shard (a stretch of that order), nth (place in it) and the run's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]  # a shard, bounded by its share of the order; rows come by run and place
        cuts = [k for k in range(len(rows)) if not k or rows[k]["run"] != rows[k - 1]["run"]]
        keyed = [((r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0, r["file"], r["offset"]), k) for k, r in enumerate(rows)]
        merged = [rows[k] for _, k in LoserTree([keyed[a:b] for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True)])]
        if merged:
            schema = pa.schema([("shard", pa.int64()), ("nth", pa.int64()), *zip(COLUMNS, KINDS, strict=True)])
            shard = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([r | {"shard": shard, "nth": n} for n, r in enumerate(merged)], schema=schema)

    shards = max(1, -(-runs.count() // captures_per_shard))
    order = [F.col("url_key"), F.col("captured"), F.col("page_id").asc_nulls_first(), F.col("file"), F.col("offset")]
    cut = runs.repartitionByRange(shards, *order).sortWithinPartitions("run", "place")
    return arrow_map(cut, run, f"shard long, nth long, {CAPTURE}")


def write_archives(
    pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", captured: Column | None = None, min_bytes: int = 0,
    bytes_per_file: int = BYTES_PER_FILE, captures_per_shard: int = CAPTURES_PER_SHARD,
) -> DataFrame:
    """Writes a record per row of `pages` to `folder`/archives and the merged index to `folder`/captures, and returns the index.

    Of rows with equal payloads of at least `min_bytes` bytes, the one with the largest id is the response and the others revisit it; a repeated row of that id is a response too. A null
    payload is an empty one. A null id is below all others; where no row of the group has an id, all are responses. A null or odd URL is kept as it is (url_key). `captured` is the
    capture time in seconds since 1970, 0 where it is null or not given. Further columns are neither read nor written. `folder` must be one that every executor can write to.
    """
    steps = Steps(pages.sparkSession, "warc")
    seconds = F.lit(0) if captured is None else F.least(F.greatest(F.coalesce(captured, F.lit(0)), F.lit(0)), F.lit(LAST_SECOND))
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), F.coalesce(F.col(payload_column), F.lit("")).alias("payload"), seconds.cast("long").alias("captured"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    shared = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL")
    shared = steps.write("shared", shared.select("digest", "last"))
    marked = rows.join(shared, "digest", "left").withColumn("refers_to", F.when(~F.col("last").eqNullSafe(F.col("id")), F.col("last")))
    marked = marked.select(url_key(F.col("url")).alias("url_key"), "captured", "id", "url", "payload", "refers_to")
    runs = steps.write("runs", _captures(marked.sortWithinPartitions("url_key", "captured", "id"), folder, bytes_per_file))
    index = merge_runs(runs, captures_per_shard)
    index.write.mode("overwrite").parquet(f"{folder}/captures")
    steps.drop("shared", "runs")
    return pages.sparkSession.read.parquet(f"{folder}/captures")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per capture record of the archives alone: file, offset, page_id, payload_bytes, payload_digest, record_type, refers_to. A payload that doesn't match its digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(f"{folder}/archives")
        schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in RECORD.split(", ")])
        for name in (n for batch in batches for n in batch.column("file").to_pylist()):
            held = []
            with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                for offset, content in members(stream):
                    fields, block = parse_record(content)
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{name} at {offset}: the payload is not the one that was written")
                    own, other = (int(fields[x]) if x in fields else None for x in ("X-Page-Id", "X-Refers-To-Page-Id"))
                    held.append((name, offset, own, size, digest, fields["WARC-Type"], other))
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema=schema)
                        held = []
            if held:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema=schema)

    files = spark.read.parquet(f"{folder}/captures").select("file").distinct()
    return arrow_map(files.repartition(max(1, files.count()), "file"), run, RECORD)


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """The merged index beside what the archives hold at each of its places."""
    index = spark.read.parquet(f"{folder}/captures").select("shard", "nth", "url_key", "captured", "size", "file", "offset")
    return index.join(read_archives(spark, folder).hint("merge"), ["file", "offset"])  # sizes after a Python step can't be told, so never by broadcast
