"""The token ledger: what commands would have cost raw, and what they did."""

from __future__ import annotations

import re
import shlex
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S

SCHEMA = "ts double, command string, raw_tokens long, output_tokens long, saved_tokens long, repo string"


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON lines; malformed ones are dropped. src_rank: the place of the path among the arguments."""
    each = [spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(p).withColumn("src_rank", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, each)


def append(rows: DataFrame, path: str, everywhere: str | None = None) -> None:
    """Add rows to a repository's ledger and, where given, to the one of all repositories, which tells them by `repo`."""
    rows.drop("repo").write.mode("append").json(path)
    if everywhere:
        rows.write.mode("append").json(everywhere)


def sink(path: str, everywhere: str | None = None):
    """For writeStream.foreachBatch: appends each batch."""
    return lambda rows, _: append(rows, path, everywhere)


def once(rows: DataFrame, *order: str) -> DataFrame:
    """One row for each (ts, command): the first source's, then the least by `order`."""
    columns = [c for c in rows.columns if c not in ("ts", "command")]
    return rows.groupBy("ts", "command").agg(F.min_by(F.struct(*columns), F.struct("src_rank", *order)).alias("r")).select("ts", "command", "r.*")


def gain(spark: SparkSession, scope: str, repo: str, everywhere: str) -> DataFrame:
    """The ledger's rows in a scope: `repo`, `global`, or `all` (both, a row that both have once, the repository's first)."""
    return {"repo": lambda: read(spark, repo), "global": lambda: read(spark, everywhere), "all": lambda: once(read(spark, repo, everywhere))}[scope]()


def shown(rows: DataFrame) -> DataFrame:
    """The totals with a bar of the share saved."""
    return totals(rows).withColumn("bar", S.meter(F.col("saved_per_mille")))


def totals(rows: DataFrame, *by: str) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("raw_tokens", "output_tokens", "saved_tokens")]
    return rows.groupBy(*by).agg(F.count("*").alias("commands"), *sums).withColumn("saved_per_mille", S.per_mille(F.col("saved_tokens"), F.col("raw_tokens")))


def top(rows: DataFrame, n: int = 8) -> DataFrame:
    return rows.orderBy(F.desc("saved_tokens"), "ts", "command").limit(n)


def parsed(command: Column) -> Column:
    """struct of kind, original, rewritten of `kind: original -> rewritten`."""
    e = lambda g: F.regexp_extract(command, r"^(hook|savings): (.*?) -> (.*)$", g)
    direct = command.startswith("direct: ")
    rest = F.trim(F.substring(command, 9, 1 << 20))
    return F.when(e(1) != "", F.struct(e(1).alias("kind"), F.trim(e(2)).alias("original"), F.trim(e(3)).alias("rewritten"))).when(direct, F.struct(F.lit("direct").alias("kind"), raw_analogue(rest).alias("original"), rest.alias("rewritten"))).otherwise(F.struct(F.lit("").alias("kind"), command.alias("original"), command.alias("rewritten")))


def raw_analogue(command: Column) -> Column:
    """The shell command that would have been run for one of ours."""
    sub, rest = F.regexp_extract(command, r"^\S+\s+(\S+)", 1), F.regexp_extract(command, r"^\S+\s+\S+\s*(.*)$", 1)
    return F.when(sub == "read", F.concat(F.lit("cat "), rest)).when(sub == "slice", F.concat(F.lit("sed -n ... "), rest)).when(sub == "search", F.concat(F.lit("grep -rn "), rest, F.lit(" ."))).when(sub == "map", "find . -maxdepth 3 -type f").when(sub.isin(*C.NO_ANALOGUE), C.NO_ANALOGUE_TEXT).when(sub == "", command).otherwise(F.concat(F.lit("(equivalent of) "), command))


def rewrite(command: str, tool: str = "treeloom") -> str | None:
    """What a shell command becomes under the policy, None where it stays: single-file reads, plain searches, listings,
    git diff and status, test runs. Nothing with shell metacharacters; `!raw ` in front passes the rest through."""
    line = command.strip()
    if line.startswith("!raw "):
        return line[5:]
    if re.search(r"&&|\|\||;|\||`|\$\(|>|<|\n", line):
        return None
    try:
        words = shlex.split(line)
    except ValueError:
        return None
    match words:
        case ["cat" | "head" | "tail" as verb, _, *_]:
            names = [w for w in words[1:] if not w.startswith("-")]
            follows = verb == "tail" and any(w in ("-f", "-F") or w.startswith("--follow") for w in words[1:])
            if not follows and len(names) == 1 and names[0].endswith(C.CODE_EXTENSIONS):
                return f"{tool} read {shlex.quote(names[0])}"
        case ["rg" | "grep", pattern] if pattern and not pattern.startswith("-"):
            return f"{tool} search {shlex.quote(pattern)}"
        case ["find" | "tree", *_]:
            return f"{tool} map"
        case ["git", "diff" | "status" as verb]:
            return f"{tool} {verb}"
        case ["pytest", *_]:
            return f"{tool} test {shlex.join(words)}"
        case ["npm" | "pnpm" | "yarn" | "cargo" | "go", *rest] if "test" in rest:
            return f"{tool} test {shlex.join(words)}"
    return None


def rewritten(commands: DataFrame, column: str = "command", tool: str = "treeloom") -> DataFrame:
    """commands with a column `rewritten`; quoting rules need Python, batches go by Arrow, but for those with metacharacters."""

    @F.pandas_udf("string")
    def policy(c: pd.Series) -> pd.Series:
        return c.map(lambda x: rewrite(x, tool) if x is not None else None)

    known = F.col(column)
    return commands.withColumn("rewritten", F.when(~S.metacharacters(known) | F.ltrim(known).startswith("!raw "), policy(known)))


def savings(outputs: DataFrame) -> DataFrame:
    """command, raw_tokens, output_tokens, saved_tokens of stored outputs (command, raw, compact)."""
    raw, out = S.tokens(F.col("raw")), S.tokens(F.col("compact"))
    return outputs.select("command", raw.alias("raw_tokens"), out.alias("output_tokens"), F.greatest(raw - out, F.lit(0)).alias("saved_tokens"))


def test_report(lines: DataFrame, passed: bool, most: int = 80) -> DataFrame:
    """Of a test run's lines (line, text): the last summary line, or the first failure lines."""
    if passed:
        return lines.where(S.summary_line(F.col("text"))).orderBy(F.desc("line")).limit(1)
    return lines.where(S.failure_line(F.col("text"))).orderBy("line").limit(most)
