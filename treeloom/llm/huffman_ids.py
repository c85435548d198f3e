"""Token ids in canonical length-limited Huffman code, written and read back by Spark.

File format (one row of the table is one segment; integers little-endian): the segment's `payload` is
  magic b"TLH1" | ids in the segment, uint32 | ids in a block, uint32 | bit offset of each block, uint64 | code bits, padded
and the code itself is the table `lengths`: the code length of each id, 0 where it never occurs. Canonical codes follow from
the lengths alone. A block is decoded from its bit offset without any other block, so blocks decode side by side.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, gone_at_exit, shared_dir, slices, texts_of, staged, trimmed, width
from .fast_tokens import fast_tokens

MAGIC = b"TLH1"
LIMIT = 18
BLOCK = 512
SEGMENT_IDS = 1 << 20
SEGMENTS = "part int, segment long, inside long, docs array<long>, sizes array<long>, payload binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The code lengths of at most `limit` bits that take the fewest bits in all, by package-merge; 0 for what never occurs.

    From the deepest level up, the symbols, sorted by count, are merged with pairs of what the level below holds. Of the top level the first
    2 n - 2 items are taken; each symbol among them gains a bit, each pair takes its two items from the level below.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    pairs, leaf = np.zeros(0), []
    for _ in range(limit):
        items = np.concatenate([leaves, pairs])
        at = np.argsort(items, kind="stable")
        leaf.append(at < n)
        pairs = items[at][: len(at) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2
    for level in reversed(leaf):
        own = int(level[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then by id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for i in order.tolist():
        n = int(lengths[i])
        code <<= n - last
        codes[i], last = code, n
        code += 1
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> bytes:
    """One segment's payload."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ids) else 0
    at = ends - n
    out = np.zeros((total + 63) // 64 + 2, np.uint64)
    if len(ids):
        word, low = at >> 6, (at & 63).astype(np.uint64)
        bits = codes[ids]
        room = np.uint64(64) - low
        width_ = n.astype(np.uint64)
        whole = width_ <= room
        high = np.where(whole, bits << np.where(whole, room - width_, np.uint64(0)), bits >> np.where(whole, np.uint64(0), width_ - room))
        firsts = np.flatnonzero(np.append(True, np.diff(word) > 0))
        out[word[firsts]] = np.bitwise_or.reduceat(high, firsts)
        over = np.flatnonzero(~whole)
        out[word[over] + 1] |= bits[over] << (np.uint64(64) - (width_[over] - room[over]))
    heads = at[::block].astype("<u8") if len(ids) else np.zeros(0, "<u8")
    return MAGIC + np.array([len(ids), block], "<u4").tobytes() + heads.tobytes() + out.astype(">u8").tobytes()


def decoding_table(lengths: np.ndarray, codes: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For every `limit` bits ahead: id << 5 | code length."""
    table = np.zeros(1 << limit, np.uint32)
    for i in np.flatnonzero(lengths).tolist():
        n = int(lengths[i])
        a = int(codes[i]) << (limit - n)
        table[a : a + (1 << (limit - n))] = i << 5 | n
    return table


def decode(payload: bytes, table: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The ids of a segment: step k decodes the k-th id of all blocks at once."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment")
    total, block = np.frombuffer(payload, "<u4", 2, 4).tolist()
    blocks = -(-total // block)
    at = np.frombuffer(payload, "<u8", blocks, 12).astype(np.int64)
    data = np.frombuffer(payload, np.uint8, -1, 12 + 8 * blocks)
    data = np.append(data, np.zeros(8, np.uint8))
    # 32 bits from every byte on
    wide = np.zeros(len(data) - 3, np.uint32)
    for k in range(4):
        wide |= data[k : len(data) - 3 + k].astype(np.uint32) << np.uint32(24 - 8 * k)
    out = np.zeros((block, blocks), np.uint32)
    down, mask, last = 32 - limit, np.uint32((1 << limit) - 1), len(wide) - 1
    for k in range(min(block, total)):
        if (blocks - 1) * block + k >= total:  # the last block may be short
            at = at[: blocks - 1]
        found = table[(wide[np.minimum(at >> 3, last)] >> (down - (at & 7)).astype(np.uint32)) & mask]
        out[k, : len(at)] = found >> 5
        at = at + (found & np.uint32(31))
    return out.T.reshape(-1)[:total]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian uint16 where the vocabulary allows, else uint32) of whole texts with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = fast_tokens(tokenizer)
        kind = "<u2" if max(tok.size, end_id + 1) <= 1 << 16 else "<u4"
        tail = np.array([end_id], kind).tobytes()
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for a, b in slices(texts):
                raw = [np.frombuffer(x, "<u4").astype(kind).tobytes() + tail for x in tok.ids([t or "" for t in texts.slice(a, b - a).to_pylist()])]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(raw, pa.binary()), pa.array([len(x) // int(kind[2]) for x in raw], pa.int64())], ["doc_id", "ids", "n"])

    return texts_of(docs).select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, ids binary, n long")


def histogram(ids: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in the whole corpus; one vector of the vocabulary's size, summed in two levels."""
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            for x in column(batch, "ids"):
                found += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=size)
        keep = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(found[keep], pa.int64())], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in ids.select("ids").mapInArrow(trimmed(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().itertuples():
        counts[r.id] = r.n
    return counts


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> str:
    """Write the ids of whole texts in ascending doc_id order (null first, equal ids by their bytes); the path of the files.
    Files without a path of their own go with the session."""
    spark = docs.sparkSession
    path = path or gone_at_exit(spark, f"{shared_dir(spark)}/treeloom-ids-{uuid.uuid4().hex}")
    ids = staged(tokenized(docs, tokenizer, end_id), "ids")
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    lengths = code_lengths(histogram(ids, size))
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths.tolist())], "id int, bits int").coalesce(1).write.parquet(f"{path}/lengths")
    book = spark.sparkContext.broadcast((lengths, canonical(lengths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = book.value
        part, number = TaskContext.get().partitionId(), 0
        names, sizes, held, much, inside = [], [], [], 0, 0

        def segment() -> pa.RecordBatch:
            payload = encode(np.concatenate([np.frombuffer(x, kind) for x in held]), lengths, codes)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([inside], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([payload], pa.binary())], ["part", "segment", "inside", "docs", "sizes", "payload"])

        for batch in batches:
            for doc, raw in zip(column(batch, "doc_id").to_pylist(), column(batch, "ids").to_pylist(), strict=True):
                names.append(doc)
                sizes.append(len(raw) // int(kind[2]))
                held.append(raw)
                much += sizes[-1]
                if much >= SEGMENT_IDS:
                    yield segment()
                    number, inside, names, sizes, held, much = number + 1, inside + much, [], [], [], 0
        if names:
            yield segment()

    ordered = ids.repartitionByRange(width(spark), "doc_id", F.hash("ids")).sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(trimmed(run), SEGMENTS).write.parquet(f"{path}/segments")
    return path


def read_ids(spark, path: str) -> DataFrame:
    """Decode the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    bits = spark.read.schema("id int, bits int").parquet(f"{path}/lengths").toPandas()  # one row an id of the vocabulary
    lengths = np.zeros(len(bits), np.uint8)
    lengths[bits["id"]] = bits["bits"]
    book = spark.sparkContext.broadcast(lengths)
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    # a segment knows what precedes it in its part; the parts are as many as the writer had tasks
    ahead, total = [], 0
    for r in segments.groupBy("part").agg(F.max(F.col("inside") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect():
        ahead.append((r["part"], total))
        total += r["n"]
    firsts = F.broadcast(spark.createDataFrame(ahead, "part int, ahead long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = book.value
        table = decoding_table(lengths, canonical(lengths))
        for batch in batches:
            for i in range(len(batch)):
                names, sizes = column(batch, "docs")[i].values, column(batch, "sizes")[i].values.to_numpy()
                raw = decode(column(batch, "payload")[i].as_py(), table).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                begin = column(batch, "begin")[i].as_py()
                yield pa.RecordBatch.from_arrays([names, pa.array(begin + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.join(firsts, "part").select("docs", "sizes", "payload", (F.col("inside") + F.col("ahead")).alias("begin")).mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the ids of docs and read them back: doc_id, start, n_tokens, ids_crc32, one row per row of docs.

    A null or empty text is the end id alone; null ids come first and stay null; repeated ids follow each other; an empty
    table gives no rows; other columns are not read.
    """
    return read_ids(docs.sparkSession, write_ids(docs, tokenizer, end_id))
