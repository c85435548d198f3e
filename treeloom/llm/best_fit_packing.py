"""Best-fit packing of token documents into sequences, in bulk-synchronous sweeps.

Lengths are 1 to `size`, so documents sorted by length form at most `size` runs of equal length, and gaps sorted by size as
many. A sweep takes the runs of documents from long to short. For each it finds the successor run of gaps (the smallest gap
that holds the length), matches documents to gaps by their rank within both runs, so that no two documents want one gap, turns the
filled gaps into runs of smaller gaps, and repeats until none is left. The runs are what is decided on, never single rows:
the plan depends on the `size` counts of documents alone and has the same bound for any corpus. Every document then finds
its own place by its length and its rank among the documents of that length, in a join spread over all executors.
The places are exactly those of best-fit decreasing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import column, release, slices, texts_of, staged, trimmed
from .fast_tokens import fast_tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, spot long"
PLAN = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "low", "high", "per_bin", "first_bin", "base")])


def sweep(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The plan for so many documents of each length: (length, low, high, per_bin, first_bin, base), and the number of bins.

    Documents of that length with ranks low to high-1 go, per_bin by per_bin, into the bins from first_bin on, the first of
    each bin at offset base.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    plan, bins = [], 0
    for length in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        rank, left = 0, counts[length]
        sizes = sorted(g for g in gaps if g >= length)
        while left:
            if sizes:
                gap = sizes[0]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(0)
            else:
                gap, first, n = size, bins, -(-left // (size // length))
                bins += n
            each = gap // length
            full, rest = min(n, left // each), 0
            if full < n:
                rest = left - full * each
            if full:
                plan.append((length, rank, rank + full * each, each, first, size - gap))
            if rest:
                plan.append((length, rank + full * each, rank + full * each + rest, rest, first + full, size - gap))
            used = full + (rest > 0)
            # what is left of the bins is smaller than the length, but for the last bin of the run's last documents
            for new, at, many in ((gap - each * length, first, full), (gap - rest * length, first + full, int(rest > 0)), (gap, first + used, n - used)):
                if many and new:
                    gaps.setdefault(new, []).append((at, many))
            rank += full * each + rest
            left -= full * each + rest
    return plan, bins


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one if they fit, else pieces of `size` with the shorter one first."""
    head = n % size if n > size else n
    return ([(0, head)] if head else []) + [(s, size) for s in range(head, n, size)]


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """Tokenize whole texts and cut them; task and spot rank each piece among those of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task, seen = fast_tokens(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for a, b in slices(texts):
                rows = []
                for doc, raw in zip(ids.slice(a, b - a).to_pylist(), tok.ids([t or "" for t in texts.slice(a, b - a).to_pylist()]), strict=True):
                    raw += tail
                    for k, (start, n) in enumerate(cut(len(raw) // 4, size)):
                        rows.append((doc, k, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), task, int(seen[n])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], [f.split()[0] for f in PIECES.split(", ")])

    return texts_of(docs).select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), PIECES)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed each; equal lengths keep
    the order of the scan; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    done = staged(pieces(docs, tokenizer, size, end_id), "pieces")
    per_task = done.groupBy("length", "task").count()
    # at most `size` rows, whatever the input
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan, _ = sweep(counts, size)
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "task", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
    ranked = done.join(before, ["length", "task"]).withColumn("rank", F.col("ahead") + F.col("spot"))
    table = F.broadcast(spark.createDataFrame(plan, PLAN))  # a few runs for each of at most `size` lengths
    here = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    nth = F.col("rank") - F.col("low")
    return ranked.join(table, "length").where(here).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(nth, F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


__all__ = ["cut", "pack", "pieces", "release", "sweep"]
