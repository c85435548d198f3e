"""Version-control history as tables. The log is a data source read in slices; the rest runs git once a question on the driver."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPANS = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks", "y": "years"}
LOG = "commit string, commit_ord long, ts long, author string, path string"


def git_bytes(root: str, *args: str, given: bytes | None = None, timeout: float = 60) -> bytes | None:
    """Its output; None on any failure."""
    try:
        run = subprocess.run(["git", "-C", root, *args], input=given, capture_output=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return run.stdout if run.returncode == 0 else None


def git(root: str, *args: str) -> str:
    """Its output as text; empty on any failure."""
    return (git_bytes(root, *args) or b"").decode("utf-8", "replace")


def since_argument(since: str | None) -> list[str]:
    """90d, 12w and so on as real spans; None: all history."""
    if not since:
        return []
    m = re.fullmatch(r"(\d+)([mhdwy])", since)
    return [f"--since={m[1]} {SPANS[m[2]]} ago" if m else f"--since={since}"]


class Slice(InputPartition):
    def __init__(self, skip: int, many: int) -> None:
        self.skip, self.many = skip, many


class LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.since = options["path"], options.get("since") or None
        self.most, self.each = int(options.get("most", "2000")), int(options.get("commitsPerPartition", "500"))

    def partitions(self) -> list[Slice]:
        """Slices of the newest commits; only their number is asked here."""
        many = min(self.most, int(git(self.root, "rev-list", "--count", *since_argument(self.since), "HEAD") or 0))
        return [Slice(i, min(self.each, many - i)) for i in range(0, many, self.each)] or [Slice(0, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        if not partition.many:
            return
        said = git(self.root, "log", *since_argument(self.since), "--name-only", "--no-renames", "-z", f"--skip={partition.skip}", f"-n{partition.many}", "--format=%x01%H%x02%ct%x02%an")
        for i, block in enumerate(said.split("\x01")[1:]):
            head, *paths = block.replace("\n", "\0").split("\0")
            sha, ts, author = head.split("\x02")
            for path in filter(None, paths):
                yield sha, partition.skip + i, int(ts), author, path


class LogSource(DataSource):
    """spark.read.format("git_log").load(root); options since, most, commitsPerPartition. Executors must see the repository."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)


def commit_files(spark: SparkSession, root: str, since: str | None = None, most: int = 2000) -> DataFrame:
    """commit, commit_ord (0: newest), ts, author, path of the newest commits; those without files have no row."""
    spark.dataSource.register(LogSource)
    return spark.read.format("git_log").option("since", since or "").option("most", str(most)).load(root)


def blame(spark: SparkSession, root: str, path: str, first: int = 1, last: int | None = None) -> DataFrame:
    """path, line_no, sha, author, ts, summary of a range of lines of one file."""
    rows, now = [], {}
    for line in git(root, "blame", f"-L{first},{last or ''}", "--line-porcelain", "--", path).split("\n"):
        if m := re.match(r"([0-9a-f]{40}) \d+ (\d+)", line):
            now = {"sha": m[1][:8], "line": int(m[2])}
        elif line.startswith("\t"):
            rows.append((path, now["line"], now["sha"], now.get("author", ""), int(now.get("committer-time", 0)), now.get("summary", "")))
        elif " " in line:
            key, value = line.split(" ", 1)
            now[key] = value
    return spark.createDataFrame(rows, "path string, line_no long, sha string, author string, ts long, summary string")


def changed(spark: SparkSession, root: str, base: str | None = None, indexed: DataFrame | None = None) -> DataFrame:
    """Distinct paths that differ from the base (the work tree's index without one), and untracked ones. A path that is gone from the tree
    counts only if `indexed` (path), the files of a corpus, has it."""
    out = git(root, "diff", *([base] if base else []), "--name-only", "-z") + "\0" + git(root, "ls-files", "--others", "--exclude-standard", "-z")
    found = spark.createDataFrame([(p, os.path.exists(os.path.join(root, p))) for p in sorted({p for p in out.split("\0") if p})], "path string, there boolean")
    here = found.where("there").select("path")
    return here if indexed is None else here.unionByName(found.where("not there").join(indexed.select("path"), "path", "left_semi").select("path"))


def show(spark: SparkSession, root: str, ref: str, paths: list[str]) -> DataFrame:
    """path, text at a ref, by one process; an empty file has an empty text, a path that the ref lacks no row."""
    said, rows = git_bytes(root, "cat-file", "--batch", given="".join(f"{ref}:{p}\n" for p in paths).encode()) or b"", []
    for path in paths:
        head, _, said = said.partition(b"\n")
        if m := re.fullmatch(rb"[0-9a-f]+ (\w+) (\d+)", head):
            size = int(m[2])
            if m[1] == b"blob":
                rows.append((path, said[:size].decode("utf-8", "replace")))
            said = said[size + 1 :]
    return spark.createDataFrame(rows, "path string, text string")


def status(spark: SparkSession, root: str) -> DataFrame:
    """state (first two characters stripped, ? where empty), path."""
    rows = [(line[:2].strip() or "?", line[3:]) for line in git(root, "status", "--short").split("\n") if line]
    return spark.createDataFrame(rows, "state string, path string")


def status_counts(states: DataFrame) -> DataFrame:
    """How many paths are in each state."""
    return states.groupBy("state").agg(F.count("*").alias("files"))


def diff_stat(root: str) -> str:
    return git(root, "diff", "--stat")
