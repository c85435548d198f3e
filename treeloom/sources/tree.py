"""Source trees, their manifests and repository settings."""

from __future__ import annotations

import fnmatch
import os
import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import constants as C

SCHEMA = "path string, size long, mtime double, text string"


@dataclass(frozen=True)
class Settings:
    ignore_dirs: tuple[str, ...] = ()
    test_dirs: tuple[str, ...] = ()
    test_patterns: tuple[str, ...] = ()
    side_effects: tuple[tuple[str, str], ...] = ()
    problems: tuple[str, ...] = field(default=())


def load_settings(path: str) -> Settings:
    """From a TOML file's [index] and [side_effects]; what can't be used is named in `problems` and left out."""
    try:
        data = tomllib.loads(Path(path).read_text())
    except FileNotFoundError:
        return Settings()
    except (OSError, ValueError) as e:
        return Settings(problems=(f"{path}: {e}",))
    problems: list[str] = []

    def strings(key: str) -> list[str]:
        value = data.get("index", {}).get(key, [])
        if isinstance(value, list) and all(isinstance(x, str) for x in value):
            return value
        problems.append(f"index.{key} is no list of strings")
        return []

    rules = []
    for rule in data.get("side_effects", {}).get("custom_rules", []):
        try:
            re.compile(rule["pattern"])
            rules.append((rule["pattern"], str(rule["label"])))
        except (re.error, KeyError, TypeError) as e:
            problems.append(f"side_effects rule {rule}: {e}")
    return Settings(tuple(strings("ignore_dirs")), tuple(x.lower() for x in strings("extra_test_dirs")), tuple(strings("extra_test_patterns")), tuple(rules), tuple(problems))


class Directories(InputPartition):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.ignored = {*C.IGNORED_DIRS, *filter(None, options.get("ignore", "").split(","))}
        self.patterns = (*C.TEST_PATTERNS, *filter(None, options.get("testPatterns", "").split(",")))
        self.each = int(options.get("filesPerPartition", "500"))

    def partitions(self) -> list[Directories]:
        """Ignored directories are not descended into."""
        found: list[str] = []
        for at, dirs, names in os.walk(self.root):
            dirs[:] = sorted(d for d in dirs if d not in self.ignored and not d.startswith("."))
            found += [os.path.relpath(os.path.join(at, n), self.root) for n in sorted(names) if os.path.splitext(n)[1] in C.CODE_EXTENSIONS or any(fnmatch.fnmatch(n, p) for p in self.patterns)]
        return [Directories(found[i : i + self.each]) for i in range(0, len(found), self.each)] or [Directories([])]

    def read(self, partition: Directories) -> Iterator[tuple]:
        for path in partition.files:
            whole = os.path.join(self.root, path)
            try:
                stat = os.stat(whole)
                if stat.st_size <= C.MAX_BYTES:
                    with open(whole, "rb") as f:
                        yield path.replace(os.sep, "/"), stat.st_size, stat.st_mtime, f.read().decode("utf-8", "replace")
            except OSError:  # unreadable files are no part of the corpus
                continue


class TreeSource(DataSource):
    """spark.read.format("source_tree").load(root); options ignore, testPatterns (comma-separated), filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").option("ignore", ",".join(settings.ignore_dirs)).option("testPatterns", ",".join(settings.test_patterns)).load(root)


def stale(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, state (new, changed, deleted) of what a stored manifest (path, size, mtime) gets wrong."""
    a, b = manifest.select("path", F.col("size").alias("s"), F.col("mtime").alias("m")), files.select("path", "size", "mtime")
    state = F.when(F.col("s").isNull(), "new").when(F.col("size").isNull(), "deleted").when((F.col("s") != F.col("size")) | (F.col("m") != F.col("mtime")), "changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state")).where("state is not null")
