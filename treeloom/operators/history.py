"""Churn, hotspots, co-change and ownership over commits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C

TASK_ROWS = 1_000_000  # rows or pairs that one task counts
MOST_TASKS = 20_000  # beyond, tasks grow and spill


def latest(commits: DataFrame, n: int = 2000) -> DataFrame:
    """The n newest of (commit, ts), ties by commit; a top-k, never a full sort."""
    return commits.orderBy(F.col("ts").desc(), F.col("commit")).limit(n)


def churn(commit_files: DataFrame) -> DataFrame:
    """commits that hold each path; a path counts once a commit."""
    return commit_files.select("commit", "path").distinct().groupBy("path").agg(F.count("*").alias("commits"))


def hot_threshold(churned: DataFrame) -> DataFrame:
    """One row: max(3, the n/10-th highest count, or the highest where there are fewer than ten).

    Counts are first grouped, so what is ordered is one row per distinct count.
    """
    counts = churned.groupBy("commits").agg(F.count("*").alias("paths"))
    total = churned.agg(F.count("*").alias("n"))
    above = F.sum("paths").over(Window.orderBy(F.col("commits").desc()).rowsBetween(Window.unboundedPreceding, 0))
    at = F.when(F.col("n") >= 10, F.floor(F.col("n") / 10)).otherwise(0)
    reached = counts.withColumn("above", above).crossJoin(F.broadcast(total)).where(F.col("above") > at)  # total is one row
    return reached.agg(F.greatest(F.lit(3), F.coalesce(F.max("commits"), F.lit(0))).cast("long").alias("threshold"))


def hotspot_flags(churned: DataFrame) -> DataFrame:
    return churned.crossJoin(F.broadcast(hot_threshold(churned))).withColumn("hotspot", F.col("commits") >= F.col("threshold"))


def hotspots(churned: DataFrame, dependents: DataFrame, top: int = 10) -> DataFrame:
    """score = commits * (1 + dependents); ties by commits, dependents, path."""
    joined = churned.join(dependents.select("path", "dependents"), "path", "left").fillna(0, ["dependents"])
    return joined.withColumn("score", F.col("commits") * (1 + F.col("dependents"))).orderBy(F.desc("score"), F.desc("commits"), F.desc("dependents"), "path").limit(top)


def neighbors(commit_files: DataFrame, target: object, top: int = 10) -> DataFrame:
    """Paths that change together with the target; the filter is pushed below the join."""
    rows = commit_files.select("commit", "path").distinct()
    own = rows.where(F.col("path") == F.lit(target)).select("commit")
    return rows.where(F.col("path") != F.lit(target)).join(own, "commit", "left_semi").groupBy("path").agg(F.count("*").alias("co_changes")).orderBy(F.desc("co_changes"), "path").limit(top)


def _tasks(df: DataFrame, rows: float) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, math.ceil(rows / TASK_ROWS)))


def cochange(commit_files: DataFrame, top: int, block: int = 500) -> DataFrame:
    """The top pairs (a < b) over all commits. All pairs of a commit are what the operator counts; a commit of more than `block`
    paths is dealt to blocks, and each two blocks meet under a key of their own.

    Rows and pairs are counted first (two jobs), so that each task gets about TASK_ROWS of them, whatever partitions the session would choose."""
    given = commit_files.select("commit", "path")
    shares = _tasks(given, given.count())
    rows = given.where(F.col("commit").isNotNull() & F.col("path").isNotNull()).repartition(shares, "commit", "path").distinct()
    per = rows.repartition(shares, "commit").groupBy("commit").agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    most, paths, pairs = per.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum(n), F.lit(0.0)), F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))).first()
    if most > block:  # only large commits are copied, as often as they have blocks; in the rest all paths share block 0
        large = per.where(F.col("n") > block).select("commit", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
        rows = rows.join(large, "commit", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("commit", "path", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    else:
        rows = rows.select("commit", "path", *(F.lit(0).alias(c) for c in ("own", "i", "j")))
    tasks = _tasks(given, paths + pairs)
    # many more keys than tasks, so that tasks are alike; counting by them first sends a frequent pair a few times a task only
    dealt = rows.withColumn("key", F.pmod(F.xxhash64("commit", "i", "j"), F.lit(64 * tasks)).cast("int")).repartition(tasks, "key")
    later = Window.partitionBy("key", "commit", "i", "j").orderBy("path").rowsBetween(1, Window.unboundedFollowing)
    met = dealt.withColumn("later", F.collect_list(F.struct("path", "own")).over(later)).withColumn("with", F.explode("later")).where((F.col("i") == F.col("j")) | (F.col("own") != F.col("with.own")))
    counted = met.groupBy("key", F.col("path").alias("a"), F.col("with.path").alias("b")).agg(F.count("*").alias("n"))
    return counted.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("co_changes")).orderBy(F.desc("co_changes"), "a", "b").limit(top)


def ownership(blame: DataFrame) -> DataFrame:
    """lines and per-mille by (path, author)."""
    per = blame.groupBy("path", "author").agg(F.count("*").alias("lines"))
    return per.withColumn("per_mille", F.floor(1000 * F.col("lines") / F.sum("lines").over(Window.partitionBy("path"))).cast("long"))


def indexed(commit_files: DataFrame, files: DataFrame) -> DataFrame:
    """The rows whose path the corpus has."""
    return commit_files.join(files.select("path"), "path", "left_semi")


def last_touch(blame: DataFrame) -> DataFrame:
    """By path: the commit of the last line, and the newest commit."""
    return blame.groupBy("path").agg(F.max_by("sha", "line_no").alias("last_line_commit"), F.max_by("sha", "ts").alias("newest_commit"))


def _words(path: Column, words: tuple[str, ...]) -> Column:
    return F.lower(path).rlike("|".join(words))


def impact_risk(path: Column, dependents: Column, hotspot: Column) -> Column:
    return F.when(hotspot | (dependents > 3) | _words(path, C.IMPACT_WORDS), "HIGH").when(dependents > 0, "MEDIUM").otherwise("LOW")


def blast_radius(path: Column, dependents: Column, hotspot: Column) -> Column:
    return F.when(hotspot | (dependents > 5) | _words(path, C.PREFLIGHT_WORDS), "HIGH").when(dependents > 0, "MEDIUM").otherwise("LOW")


def risk_points(hotspot: Column, effects: Column, findings: Column, dependents: Column, changed: Column, tests: Column) -> Column:
    return (3 * hotspot.cast("long") + 2 * effects + 2 * findings + F.least(F.lit(3), dependents) + changed + (tests == 0).cast("long")).cast("long")


def risk_level(points: Column) -> Column:
    return F.when(points >= 5, "HIGH").when(points >= 2, "MEDIUM").otherwise("LOW")
