"""Answers as JSON or text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(answer: DataFrame, command: str) -> DataFrame:
    """One JSON object a row of the answer, with the command that gave it; missing values are written as null."""
    return answer.select(F.to_json(F.struct(F.lit(command).alias("command"), *answer.columns), {"ignoreNullFields": "false"}).alias("value"))


def document(answer: DataFrame, command: str, **facts: object) -> DataFrame:
    """One JSON document: the command, further facts and the answer's rows in order; for answers that a reader can take in whole."""
    whole = answer.agg(F.collect_list(F.struct(*answer.columns)).alias("rows"))
    return whole.select(F.to_json(F.struct(F.lit(command).alias("command"), *(F.lit(v).alias(k) for k, v in facts.items()), "rows"), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))


def write(answer: DataFrame, command: str, path: str) -> None:
    """The rows of an answer as files of JSON lines, each partition by its own task."""
    json_rows(answer, command).write.mode("overwrite").text(path)


def text_lines(answer: DataFrame, title: str) -> DataFrame:
    """The answer as text: a title, then `- name: value, …` for each row."""
    rows = answer.select(F.concat(F.lit("- "), F.concat_ws(", ", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in answer.columns))).alias("value"))
    return answer.sparkSession.createDataFrame([(f"# {title}",)], "value string").unionByName(rows)
