"""Incremental maintenance of a stored corpus from a stream of file events."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import graph
from ..plans.corpus import TABLES, Corpus
from ..sources.tree import Settings, read_tree, stale

EVENT = "ts timestamp, path string, kind string, text string, moved_to string"


def steps(events: DataFrame) -> DataFrame:
    """Events with each move (kind move, moved_to) as the old path's deletion and the new one's upsert."""
    if "moved_to" not in events.columns:
        return events
    moved = F.col("kind") == "move"
    two = F.array(F.struct(F.col("path"), F.lit("delete").alias("kind"), F.lit(None).cast("string").alias("text")), F.struct(F.col("moved_to").alias("path"), F.lit("upsert").alias("kind"), F.col("text")))
    one = F.array(F.struct("path", "kind", "text"))
    return events.select("ts", F.explode(F.when(moved, two).otherwise(one)).alias("e")).select("ts", "e.*")


def polled(spark: SparkSession, root: str, path: str, settings: Settings = Settings()) -> DataFrame:
    """Events (ts, path, kind, text) that bring the stored corpus to the state of the source tree: what differs in size or time, either
    way, and what is gone."""
    files = read_tree(spark, root, settings)
    known = Corpus.load(spark, current(spark, path)).files
    found = stale(known.select("path", "size", "mtime"), files.select("path", "size", "mtime"))
    kind = F.when(F.col("state") == "deleted", "delete").otherwise("upsert")
    return found.join(files, "path", "left").select(F.current_timestamp().alias("ts"), "path", kind.alias("kind"), "text", "size", "mtime")


def relevant(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Events on code files outside ignored and dot directories."""
    ends = "|".join(e.replace(".", r"\.") for e in C.CODE_EXTENSIONS)
    ignored = F.exists(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), lambda x: x.startswith(".") | x.isin(*C.IGNORED_DIRS, *settings.ignore_dirs))
    return events.where(F.col("path").rlike(f"({ends})$") & ~ignored)


def debounced(events: DataFrame, *by: str, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of events (ts, path), of each `by`: began, ended (the gap after the last event), last, events, paths; a burst ends when
    nothing happens for the gap."""
    bursts = events.withWatermark("ts", late).groupBy(*by, F.session_window("ts", gap).alias("w"))
    found = bursts.agg(F.max("ts").alias("last"), F.count("*").alias("events"), F.array_sort(F.collect_set("path")).alias("paths"))
    return found.select(*by, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "last", "events", "paths")


def apply(spark: SparkSession, events: DataFrame, path: str, settings: Settings = Settings(), keep: int = 2) -> None:
    """Merge events (ts, path, kind upsert or delete, text) into the stored corpus, as a new version of it.

    Only changed files are parsed; edges are resolved anew, since a file that comes or goes can change where others' imports lead.
    A version counts from the moment its marker stands, written last; the newest `keep` stay, so that readers of the one before can end.
    """
    extra = [c for c in ("size", "mtime") if c in events.columns]
    last = events.groupBy("path").agg(F.max_by(F.struct("kind", "text", *extra), "ts").alias("e")).select("path", "e.*").persist()
    old = Corpus.load(spark, current(spark, path))
    fresh = Corpus.of(last.where("kind <> 'delete'").select("path", "text", *extra), settings)
    merged = {name: old.tables[name].join(last.select("path"), "path", "left_anti").unionByName(fresh.tables[name], allowMissingColumns=True) for name in TABLES if name != "deps"}
    merged["deps"] = graph.resolve(merged["raw_imports"], merged["files"])
    version = f"{path}/v{time.time_ns():020d}"
    Corpus(merged).save(version)
    fs, at = file_system(spark, path)
    fs.create(at(f"{version}/{DONE}"), True).close()
    last.unpersist()
    for gone in versions(spark, path)[:-keep]:
        fs.delete(at(gone), True)


DONE = "_MERGED"


def file_system(spark: SparkSession, path: str):
    """The file system of a path, whatever it is, and the maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def versions(spark: SparkSession, path: str) -> list[str]:
    """The merged versions under a path, oldest first."""
    fs, at = file_system(spark, path)
    found = fs.globStatus(at(f"{path}/v*/{DONE}"))
    return sorted(str(x.getPath().getParent().toString()) for x in found or [])


def current(spark: SparkSession, path: str) -> str:
    """Where the newest version of a stored corpus is: the corpus as saved, until something is merged."""
    return (versions(spark, path) or [path])[-1]


def watch(spark: SparkSession, landing: str, path: str, checkpoint: str, settings: Settings = Settings(), on_error: Callable[[Exception], None] | None = None, every: str | None = None):
    """Start a query that merges event files as they land; a batch that fails is reported and the stream goes on if on_error is given.
    It goes on for ever, a batch at a time, if `every` names an interval; else it ends with what has landed."""

    def batch(df: DataFrame, _: int) -> None:
        try:
            own = relevant(steps(df), settings)
            if not own.isEmpty():
                apply(spark, own, path, settings)
        except Exception as e:
            if on_error is None:
                raise
            on_error(e)

    stream = spark.readStream.schema(EVENT).json(landing)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
