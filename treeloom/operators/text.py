"""Line search, containment, token budgets, snapshot diffs and greedy packs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import scalars as S

WINDOW = 24  # bytes


def line_table(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, line (from 1), text of every line."""
    return files.select(key, F.posexplode(S.lines(F.coalesce(text, F.lit(""))))).select(key, (F.col("pos") + 1).cast("long").alias("line"), F.col("col").alias("text"))


def search(lines: DataFrame, query: str, per_file: int = 5, key: str = "path") -> DataFrame:
    """The first lines of each file that hold the query, and how many there are in all."""
    hits = lines.where(F.col("text").contains(query))
    own = Window.partitionBy(key)
    return hits.withColumn("total", F.count("*").over(own)).withColumn("n", F.row_number().over(own.orderBy("line"))).where(F.col("n") <= per_file).select(key, "line", "text", "total")


def histogram(files: DataFrame, key: str = "lang") -> DataFrame:
    """key, files, is_primary: the key of most files, of equal ones the first."""
    per = files.groupBy(key).agg(F.count("*").alias("files"))
    first = per.agg(F.min_by(key, F.struct(-F.col("files"), F.col(key))).alias("first"))
    return per.crossJoin(F.broadcast(first)).select(key, "files", F.col(key).eqNullSafe(F.col("first")).alias("is_primary"))  # first is one row


def important(facts: DataFrame, top: int = 20) -> DataFrame:
    """The paths most depended on, then with most symbols, then shortest."""
    return facts.orderBy(F.desc("dependents"), F.desc("symbols"), "lines", "path").limit(top)


def largest(facts: DataFrame, top: int = 10) -> DataFrame:
    """The paths of most raw tokens, then most depended on, then with most symbols."""
    return facts.orderBy(F.desc("raw_tokens"), F.desc("dependents"), F.desc("symbols"), "path").limit(max(1, top))


def first_of_each(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key with their place (from 1) and the key's number of rows; only first rows are windowed."""
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)
    return top.join(rows.groupBy(key).agg(F.count("*").alias("total")), key)


def window_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the WINDOW bytes from each place on that has as many."""
    n = max(0, len(data) - WINDOW + 1)
    if not n:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    out = np.zeros(n, np.uint64)
    for k, odd in enumerate((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)):
        out += eight[8 * k : 8 * k + n]
        out *= np.uint64(odd)
        out ^= out >> np.uint64(31)
    return out


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: empty) and the offsets of its rows."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def places(texts: pa.Array, known: np.ndarray, rough: np.ndarray, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), each once and in order, of the windows of texts whose hash is in known (sorted); rough tells by a hash's first bits."""
    data, offsets = utf8(texts)
    spots, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a in range(0, len(data), step):
        own = window_hashes(data[a : a + step + WINDOW - 1])
        at = np.flatnonzero(rough[(own >> np.uint64(42)).astype(np.int64)])
        own = own[at]
        same = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
        spots.append(at[same] + a)
        hashes.append(own[same])
    spot, value = np.concatenate(spots), np.concatenate(hashes)
    row = np.searchsorted(offsets, spot, "right") - 1
    inside = spot + WINDOW <= offsets[row + 1]
    row, value = row[inside], value[inside]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    once = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))[: len(row)]
    return row[once], value[once]


def holding(docs: DataFrame, parts: DataFrame, text: str = "text", part: str = "part", block: int = 1_000_000) -> DataFrame:
    """Each row of docs with each row of parts whose `part` stands in `text`; the two share no column name.

    Windows of the texts are looked up by hash among the parts' first WINDOW bytes, joined with the parts and then tested as a whole.
    The hashes are sent out in blocks of about `block`, one pass over docs each, so there may be any number of parts.
    Parts shorter than a window are tested with every text.
    """
    head = T.StructType([*parts.schema.fields, T.StructField("head_", T.LongType())])
    heads = T.StructType([*docs.schema.fields, T.StructField("heads_", T.ArrayType(T.LongType()))])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index(part)))
            starts = np.concatenate([data[a : a + WINDOW] for a in offsets[:-1].tolist()]) if len(batch) else data
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(window_hashes(starts)[::WINDOW].view(np.int64))], [*batch.schema.names, "head_"])

    def found(hashes: np.ndarray) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(hashes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, rough = sent.value, np.zeros(1 << 22, bool)
            rough[(known >> np.uint64(42)).astype(np.int64)] = True
            for batch in batches:
                row, value = places(batch.column(batch.schema.get_field_index(text)), known, rough)
                own, starts = np.unique(row, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own)) for c in batch.columns), lists], [*batch.schema.names, "heads_"])

        return docs.mapInArrow(run, heads).withColumn("head_", F.explode("heads_")).drop("heads_")

    long = parts.where(F.octet_length(part) >= WINDOW).mapInArrow(first, head)
    short = parts.where(F.octet_length(part) < WINDOW)
    holds = F.col(text).contains(F.col(part))
    many = long.agg(F.count_distinct("head_")).first()[0]
    blocks = -(-many // block)
    out = [] if many and short.isEmpty() else [docs.join(F.broadcast(short), holds)]
    for k in range(blocks):
        own = long.where(F.pmod("head_", F.lit(blocks)) == k)
        hashes = np.sort(own.select("head_").distinct().toArrow().column(0).to_numpy().view(np.uint64))
        out.append(found(hashes).join(own, "head_").where(holds).drop("head_"))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and status (added, removed, changed) of what differs; the keys are unique on both sides."""
    a, b = old.select(*keys, F.col(value).alias("old"), F.lit(1).alias("in_old")), new.select(*keys, F.col(value).alias("new"), F.lit(1).alias("in_new"))
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return a.join(b, keys, "full_outer").withColumn("status", status).where("status is not null").select(*keys, "status", "old", "new")


def greedy(rows: DataFrame, group: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Rows in order, each taken if it fits the budget or is the first taken; one that does not fit is skipped.

    A fold over sorted rows that keeps the running cost alone, so a group of any size streams through its task.
    """
    schema = rows.schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, any_taken = object(), 0, False
        for part in parts:
            keep = []
            for g, c in zip(part[group].astype(object).where(part[group].notna(), None), part[cost], strict=True):
                if g != now:
                    now, used, any_taken = g, 0, False
                ok = not any_taken or used + c <= budget
                used, any_taken = (used + c, True) if ok else (used, any_taken)
                keep.append(ok)
            yield part[keep]

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, schema)
