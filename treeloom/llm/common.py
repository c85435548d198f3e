"""What the operators share: shared-folder staging, text batches, word hashing, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- staging


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local"):
            found = "file://" + (own := tempfile.mkdtemp(prefix="treeloom-"))
            atexit.register(shutil.rmtree, own, True)
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_treeloom"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_OPEN: list[list[DataFrame]] = []


def gone_at_exit(spark: SparkSession, path: str) -> str:
    """The path, which will be deleted with the session."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, files go with the session."""
    spark = df.sparkSession
    path = gone_at_exit(spark, f"{shared_dir(spark)}/treeloom-{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    for tables in _OPEN:
        tables.append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Collects the tables staged inside; what is still in the list at the end is deleted."""
    tables: list[DataFrame] = []
    _OPEN.append(tables)
    try:
        yield tables
    finally:
        _OPEN.remove(tables)
        release(*tables)


def release(*frames: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in frames:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no operator may learn from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def with_heavy(rows: DataFrame, table: DataFrame, keys: list[str], many: str, share: int = 1000) -> DataFrame:
    """rows with the columns of `table`, null where it lacks the key; a left join whatever the skew.

    table: one row a key, `many` telling how many rows have it. Keys with more than 1/share of all rows are fewer than `share`, so
    their part of the table is broadcast; the other keys' rows are shuffled, and none of those is hot.
    """
    total = table.agg(F.sum(many)).first()[0] or 0
    heavy, light = table.where(F.col(many) * share > total), table.where(F.col(many) * share <= total)
    hot = F.broadcast(heavy)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(light.hint("merge"), keys, "left"))


# ---------------------------------------------------------------- memory of Python workers

_RESIDENT: dict[tuple, object] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
BATCH_ROWS = 1000


def resident(key: tuple, build: Callable[[], object]) -> object:
    """What a worker keeps from task to task: the one large object it used last."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def trimmed(run: Callable) -> Callable:
    """The task function, giving freed memory back to the system at its end."""

    def wrapped(*args: object) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(*args)
        finally:
            give_back()

    return wrapped


def texts_of(df: DataFrame) -> DataFrame:
    """df, to be sent to Python in batches of at most BATCH_ROWS rows, as texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


# ---------------------------------------------------------------- text batches


def slices(texts: pa.Array, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text; one longer text is a range of its own."""
    ends = np.cumsum([0, *pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)])
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, stop
        at = stop


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in a row, and the offsets of the texts in them."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = np.ones(1 << 16, np.uint64)
with np.errstate(over="ignore"):
    np.multiply.accumulate(np.full((1 << 16) - 1, 0x9E3779B97F4A7C15 | 1, np.uint64), out=_POWERS[1:])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(codes: np.ndarray, offsets: np.ndarray, space: np.ndarray = _ASCII_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, 64-bit hash) of each word of the concatenated texts, and each text's first word.

    codes: bytes or code points; space: which of them part words. A text's end parts words, too.
    """
    n = len(codes)
    if not n:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    blank = space[codes] if codes.dtype == np.uint8 else space[np.minimum(codes, len(space) - 1)]
    first = np.ones(n, bool)
    first[1:] = blank[:-1]
    first[offsets[:-1][offsets[:-1] < n]] = True
    first &= ~blank
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    spans = np.diff(np.append(starts, n))
    spot = np.arange(starts[0], n) - np.repeat(starts, spans)
    value = codes[starts[0] :].astype(np.uint64) + np.uint64(1)
    value *= _POWERS[spot & 0xFFFF]
    value[blank[starts[0] :]] = 0
    hashes = np.add.reduceat(value, starts - starts[0])
    lengths = np.add.reduceat((~blank[starts[0] :]).astype(np.int64), starts - starts[0])
    return starts, lengths, mix(hashes + lengths.astype(np.uint64)), np.searchsorted(starts, offsets)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column (null: empty) and the offsets of its rows, without a copy per row."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


# ---------------------------------------------------------------- distinct-chunk tables

#: A single space between two characters that are no white space: no pre-tokenizer used here joins what it parts.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class ChunkTable:
    """Encodes each distinct chunk once and keeps what it gave; beyond `limit` chunks only those of the batch at hand stay."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 500_000) -> None:
        self.encode, self.limit, self.known = encode, limit, {}

    def add(self, rows: list[list[str]]) -> dict:
        used = set().union(*rows)
        if len(self.known) > self.limit:
            self.known = {c: x for c in used if (x := self.known.get(c)) is not None}
        if new := list(used.difference(self.known)):
            self.known.update(zip(new, self.encode(new), strict=True))
        return self.known


# ---------------------------------------------------------------- components


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(id, component): the least id reachable from each id of the edges; alternating large and small stars.

    Edges (long, long) may repeat, point either way or loop. Each round is staged in the shared folder. Per node only a
    minimum is aggregated (combined before the shuffle) and joined back, so a node with very many edges is no group.
    The rounds grow with the logarithm of a component's length; beyond `most` of them, which no graph of fewer than 2^30 nodes needs, it raises.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v").distinct()
    now, seen = staged(pairs, "edges"), None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = staged(small.where("u > v").distinct(), "edges")
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(now)
        now, same, seen = after, sums == seen, sums
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
