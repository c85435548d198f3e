"""Quality rules of documents, and verdicts on their hosts: failure rates by rule, shrunk by empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, mix, slices, staged, texts_of, trimmed, utf8, with_heavy, words

# The symbols and the white space of the rules.
SYMBOLS = b"#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
COUNTS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_SYMBOL, _BLANK, _INNER = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[list(SYMBOLS)] = True
_BLANK[[ord(c) for c in SPACE]] = True
_INNER[0x80:0xC0] = True  # bytes that continue a code point


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(flags, dtype=np.int64))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated_words(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text, the words that stand in a window of three that its words hold twice or more."""
    n, out = len(hashes), np.zeros(len(bounds) - 1, np.int64)
    if n < 3:
        return out
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(owner[2:] == owner[:-2])
    with np.errstate(over="ignore"):
        windows = mix(hashes[inside] * np.uint64(3) ^ mix(hashes[inside + 1] * np.uint64(5) ^ mix(hashes[inside + 2] + owner[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(len(inside), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[inside[twice] + k] = True
    return np.bincount(owner[marked], minlength=len(out)).astype(np.int64)


def lines_of(text: str | None) -> tuple[int, int]:
    """The lines with a word, and how many of them are equal to an earlier one."""
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    return len(lines), len(lines) - len(set(lines))


def measure(texts: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each text (null: no words)."""
    data, offsets = utf8(texts)
    _, _, hashes, bounds = words(data, offsets)
    return [
        np.diff(bounds), per_text(~(_BLANK[data] | _INNER[data]), offsets), per_text(_SYMBOL[data], offsets),
        *np.array([lines_of(t) for t in texts.to_pylist()], np.int64).reshape(-1, 2).T, repeated_words(hashes, bounds),
    ]


def counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hosts, texts = column(batch, "doc_id"), column(batch, "host"), column(batch, "text")
            for a, b in slices(texts):
                found = measure(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), hosts.slice(a, b - a), *[pa.array(x, pa.int64()) for x in found]], [c.split()[0] for c in COUNTS.split(", ")])

    return texts_of(docs).select(docs["doc_id"].cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), "text").mapInArrow(trimmed(run), COUNTS)


def failed(least_words: int = 50, most_repeat: int = 50):
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))


def rule_failures() -> dict[str, Column]:
    """Of a document, by rule: the two base rules, symbols beyond a tenth of the words, equal lines beyond 30 % of the lines with a word."""
    return {
        "few_words": F.col("n_words") < 50, "repeated_words": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"), "equal_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }


def strength_of(docs: int, bad: int, hosts: int, squares: float, rates: float) -> tuple[float, float]:
    """(mean, strength) of the beta prior of a rule's rates, fitted to all hosts by moments. docs, bad: sums over hosts; squares: of
    docs^2; rates: of bad^2 / docs. The mean is the pooled rate; the strength comes from the spread of the hosts' rates beyond
    what their sizes explain, and lies between 1 and 10,000 documents."""
    if not docs:
        return 0.0, 1.0
    mean = bad / docs
    scale = docs - squares / docs
    spread = (rates - docs * mean * mean - (hosts - 1) * mean * (1 - mean)) / scale if scale > 0 else 0.0
    return mean, min(10_000.0, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 10_000.0


def judge_hosts(measured: DataFrame, most_rate: float) -> DataFrame:
    """(host, docs, host_rate, host_rules): the highest of the host's failure rates, each rule's shrunk to its own beta prior, and the
    rules, in order, whose rate is above `most_rate`."""
    rules_ = rule_failures()
    hosts = staged(measured.where("host is not null").groupBy("host").agg(F.count("*").alias("docs"), *(F.sum(c.cast("long")).alias(r) for r, c in rules_.items())), "hosts")
    n = F.col("docs")
    sums = hosts.agg(F.sum(n).alias("docs"), F.count("*").alias("hosts"), F.sum(n.cast("double") * n).alias("squares"), *(x for r in rules_ for x in (F.sum(r).alias(f"b_{r}"), F.sum(F.col(r).cast("double") * F.col(r) / n).alias(f"r_{r}")))).first()
    rates = {}
    for r in rules_:
        mean, strength = strength_of(sums["docs"] or 0, sums[f"b_{r}"] or 0, sums["hosts"], sums["squares"] or 0.0, sums[f"r_{r}"] or 0.0)
        rates[r] = (F.col(r) + mean * strength) / (n + strength)
    broken = F.array_compact(F.array(*(F.when(rate > most_rate, F.lit(r)) for r, rate in rates.items())))
    return hosts.select("host", "docs", F.greatest(*rates.values()).alias("host_rate"), F.array_join(broken, ",").alias("host_rules"))


def rules(docs: DataFrame, most_rate: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate, host_rules.

    A document is kept if it passes the base rules and no rule's shrunken failure rate at its host (the source) is above `most_rate`.
    A document without a source has no host: it is judged by itself, and host_rate is null. Null or empty text has no words and fails; repeated
    rows each count; an empty table gives no rows; other columns are not read.
    """
    measured = staged(counts(docs), "quality").withColumn("base_failed", failed())
    return with_heavy(measured, judge_hosts(measured, most_rate), ["host"], "docs").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("host_rules", F.lit("")) == "")).alias("kept"), "host_rate", F.coalesce("host_rules", F.lit("")).alias("host_rules"),
    )
