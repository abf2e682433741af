"""Token-id files: frequency-ranked ids in byte-aligned codes of 1 to 4 bytes, with the lengths in separate control bytes.

A file holds the documents of one stretch of the ascending order: a table of the ids it uses, the most frequent first, the number of ids
per document, two bits per id that say how many bytes its rank takes, and the bytes of the ranks. A reader looks each control byte up in a
table of four lengths and gathers the ranks with numpy. Files are written where every executor can read them, under a temporary name
first, so a task that is lost and run again leaves the same file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from creditloom.llm.shared import arrow_map
from creditloom.llm.words import NOT_BLANK, lower, pieces, span_hashes, text_bytes, word_bounds

MAGIC = b"FRQ1"
IDS_PER_FILE = 1 << 21
BYTES_PER_SHARD = 32 << 20
KEPT_CHUNKS = 800_000
LEARNT_TOGETHER = 4096
_KIND = np.zeros(256, np.int8)  # 1 ASCII letters, 2 digits, 3 ASCII marks, 0 blanks and all else
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
#: Lengths of the four codes that a control byte describes, lowest two bits first.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def encode_file(shard: int, chunk: int, doc_ids: np.ndarray, no_id: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: header, document ids, null marks, counts, id table, control bytes, code bytes."""
    often = np.bincount(ids)  # as long as the vocabulary at most
    used = np.flatnonzero(often)
    used = used[np.argsort(-often[used], kind="stable")]
    rank_of = np.zeros(len(often), np.uint32)
    rank_of[used] = np.arange(len(used))
    ranks = rank_of[ids]
    sizes = (1 + (ranks >= 1 << 8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)).astype(np.uint8)
    quads = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    quads[: len(ids)] = sizes - 1
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    codes = np.zeros(int(sizes.sum(dtype=np.int64)), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        longer = sizes > k
        codes[at[longer] + k] = (ranks[longer] >> (8 * k)) & 255
    head = np.array([shard, chunk, len(doc_ids), len(ids), len(used)], "<i8")
    return b"".join([MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), no_id.astype(np.uint8).tobytes(), counts.astype("<i8").tobytes(),
                     used.astype("<u4").tobytes(), control.tobytes(), codes.tobytes()])


def decode_file(content: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shard, chunk, document ids, null marks, counts and ids of a file."""
    if content[:4] != MAGIC:
        raise ValueError("not a token-id file")
    shard, chunk, n_docs, n_ids, n_used = (int(x) for x in np.frombuffer(content, "<i8", 5, 4))
    at = 44

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, kind, n, at)
        at += out.nbytes
        return out

    doc_ids, no_id, counts, used, control = take("<i8", n_docs), take("u1", n_docs), take("<i8", n_docs), take("<u4", n_used), take("u1", -(-n_ids // 4))
    sizes = LENGTHS[control].ravel()[:n_ids]
    codes = np.frombuffer(content, np.uint8, int(sizes.sum()), at)
    starts = np.cumsum(sizes) - sizes
    ranks = codes[starts].astype(np.int64)
    for k in range(1, int(sizes.max(initial=1))):
        longer = np.flatnonzero(sizes > k)
        ranks[longer] |= codes[starts[longer] + k].astype(np.int64) << (8 * k)
    return shard, chunk, doc_ids, no_id, counts, used[ranks]


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row positions of chunks that the vocabulary's pattern never joins.

    The pattern separates at the blanks 9 to 13 and 32, and between letters, digits and marks; the latter is used where both sides are
    ASCII or a letter of the block that UTF-8 starts with C3. Stretches with an apostrophe (contractions) or "<" (special tokens) stay whole.
    """
    starts, ends, bounds = word_bounds(data, offsets, NOT_BLANK)
    kind = _KIND[data]
    letter = np.zeros(len(data) + 1, bool)  # second bytes of C3 letters
    letter[1:-1] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    sure = np.where(letter[:-1] | letter[1:], 1, kind)
    cuts = np.flatnonzero((sure[1:] != sure[:-1]) & (sure[1:] > 0) & (sure[:-1] > 0)) + 1
    whole = np.cumsum(np.concatenate([[0], (data == 0x27) | (data == 0x3C)]))
    at = np.searchsorted(starts, cuts, side="right") - 1
    cuts = cuts[(whole[ends[at]] == whole[starts[at]]) & (cuts > starts[at]) & (cuts < ends[at])]
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


class ChunkEncoder:
    """Ids of whole texts from the ids of their chunks, each distinct chunk of a piece encoded once.

    Chunks are told apart by a 64-bit hash of their bytes in lower case, as the vocabulary reads them; the ids of the chunks that were
    seen most are kept, up to a fixed number.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.uses = np.zeros(0, np.int64)
        self.bounds = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        """Adds chunks with ascending hashes that are not known yet."""
        found = []
        for at in range(0, len(chunks), LEARNT_TOGETHER):  # the library's results are large beside their ids
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(chunks[at : at + LEARNT_TOGETHER], add_special_tokens=False)]
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            found.append((sizes, np.fromiter(chain.from_iterable(encoded), np.uint32, int(sizes.sum()))))
        sizes, flat = (np.concatenate(x) for x in zip(*found, strict=True))
        places = np.searchsorted(self.hashes, hashes)
        starts = np.insert(self.bounds[:-1], places, len(self.ids) + np.cumsum(sizes) - sizes)
        sizes = np.insert(np.diff(self.bounds), places, sizes)
        pool = np.concatenate([self.ids, flat])
        self.hashes, self.uses = np.insert(self.hashes, places, hashes), np.insert(self.uses, places, 0)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.ids = pool[_spread(starts, sizes)]

    def forget(self) -> None:
        """Keeps the chunks that were seen most, half as many as may be kept."""
        kept = np.sort(np.argpartition(-self.uses, KEPT_CHUNKS // 2)[: KEPT_CHUNKS // 2])
        sizes = np.diff(self.bounds)[kept]
        self.ids = self.ids[_spread(self.bounds[kept], sizes)]
        self.hashes, self.uses = self.hashes[kept], self.uses[kept] // 2
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, the end id after each, and the number of ids per row."""
        data, offsets = text_bytes(column)
        if not (data == 0x3C).any():  # special tokens are told apart by case
            data = lower(data)
        starts, ends, bounds = chunk_bounds(data, offsets)
        hashes = span_hashes(data, starts, ends)
        if len(self.hashes) > KEPT_CHUNKS:
            self.forget()
        distinct, first, which, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        slot = np.searchsorted(self.hashes, distinct)
        known = np.append(self.hashes, np.uint64(0))[slot] == distinct
        known &= slot < len(self.hashes)
        if not known.all():
            raw = data.tobytes()
            at = first[~known]
            self.learn(distinct[~known], [raw[a:b].decode("utf-8") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            slot = np.searchsorted(self.hashes, distinct)
        self.uses[slot] += often
        slot = slot[which]
        sizes = np.diff(self.bounds)[slot]
        flat = self.ids[_spread(self.bounds[slot], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        return np.insert(flat, upto[1:], np.uint32(end_id)), np.diff(upto) + 1


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) if total else np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_column: str = "doc_id", text_column: str = "text",
    bytes_per_shard: int = BYTES_PER_SHARD, ids_per_file: int = IDS_PER_FILE,
) -> None:
    """Writes the ids of every text, in ascending id order, as files below `folder`/ids and their sizes as a table in `folder`/sizes.

    The order is by id, null first, then by the text's hash, so repeated ids have a fixed order too. Null and empty texts give the end id
    alone. Shards are ranges of that order of about `bytes_per_shard` bytes of text; a shard is cut into files of about `ids_per_file` ids.
    `folder` must be one that every executor can write to and `vocabulary` a path that every executor can open.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    order = [F.col("id"), F.xxhash64("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        path, shard, chunk = f"{path.rstrip('/')}/ids", TaskContext.get().partitionId(), 0
        store.create_dir(path, recursive=True)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        coder = encoder(vocabulary)

        def flush() -> pa.RecordBatch:
            names = pa.concat_arrays([h[0] for h in held])
            counts, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            no_id = names.is_null().to_numpy(zero_copy_only=False)
            content = encode_file(shard, chunk, names.fill_null(0).to_numpy(zero_copy_only=False), no_id, counts, ids)
            unfinished = f"{path}/.{shard:06d}-{chunk:06d}-{uuid.uuid4().hex}"
            with store.open_output_stream(unfinished) as f:
                f.write(content)
            store.move(unfinished, f"{path}/{shard:06d}-{chunk:06d}.ids")
            return pa.RecordBatch.from_pydict({"shard": [shard], "chunk": [chunk], "n_docs": [len(counts)], "n_ids": [len(ids)], "n_bytes": [len(content)]})

        for part in pieces(batches):
            ids, counts = coder.encode(part.column("text"), end_id)
            held.append((part.column("id"), counts, ids))
            if sum(len(h[2]) for h in held) >= ids_per_file:
                yield flush()
                held.clear()
                chunk += 1
        if held:
            yield flush()

    shards = max(1, -(-total // bytes_per_shard))
    spread = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    arrow_map(spread, run, "shard long, chunk long, n_docs long, n_ids long, n_bytes long").write.parquet(f"{folder}/sizes")


def file_starts(spark: SparkSession, folder: str, block: int = 1024) -> DataFrame:
    """Ids before each file: sums within a shard, within a block of shards and over blocks, so no window holds all files."""
    sizes = spark.read.parquet(f"{folder}/sizes").withColumn("block", F.floor(F.col("shard") / block))
    shards = sizes.groupBy("block", "shard").agg(F.sum("n_ids").alias("in_shard"))
    blocks = shards.groupBy("block").agg(F.sum("in_shard").alias("in_block"))

    def before(column: str, window) -> F.Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    blocks = blocks.withColumn("b0", before("in_block", Window.orderBy("block"))).select(F.col("block").alias("of_block"), "b0")
    shards = shards.withColumn("s0", before("in_shard", Window.partitionBy("block").orderBy("shard"))).select(F.col("shard").alias("of_shard"), "s0")
    files = sizes.withColumn("f0", before("n_ids", Window.partitionBy("shard").orderBy("chunk")))
    files = files.join(shards, F.col("shard") == F.col("of_shard")).join(blocks, F.col("block") == F.col("of_block"))
    return files.select("shard", "chunk", (F.col("b0") + F.col("s0") + F.col("f0")).alias("file_start"))


def read_token_files(spark: SparkSession, folder: str, id_column: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document from the files alone: id, start (ids of all documents before it), n_tokens, ids_crc32, and ids where asked for."""
    fields = "shard long, chunk long, id long, local_start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                shard, chunk, doc_ids, no_id, counts, ids = decode_file(content.as_buffer().to_pybytes())
                ends = np.cumsum(counts)
                starts, raw, n = ends - counts, ids.astype("<u4").tobytes(), len(counts)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(np.full(n, shard)), pa.array(np.full(n, chunk)), pa.array(doc_ids, mask=no_id.astype(bool)), pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in fields.split(", ")])

    if spark.read.parquet(f"{folder}/sizes").isEmpty():
        rows = spark.createDataFrame([], fields)
    else:
        rows = arrow_map(spark.read.format("binaryFile").load(f"{folder}/ids").select("content"), run, fields)
    rows = rows.join(file_starts(spark, folder), ["shard", "chunk"])
    start = (F.col("file_start") + F.col("local_start")).alias("start")
    return rows.select(F.col("id").alias(id_column), start, "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
