"""Secret scans through a trigram inverted index.

Each rule's regex is parsed once and turned into a Boolean query over trigrams that every match must hold. A batch of
documents is an index shard: postings are built for the trigrams the queries name, the query is worked out on posting lists,
and only the documents that remain are searched with the regex. A rule without a mandatory trigram searches every document.
A shard never leaves its task, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, slices, texts_of, trimmed, utf8

Query = tuple  # ("all",) | ("tri", bytes) | ("and", *queries) | ("or", *queries)
ALL: Query = ("all",)
MOST_TEXTS = 64  # alternatives of a part of a regex that are spelled out
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


@dataclass(frozen=True)
class Rule:
    """kind: its name in the spans; pattern: a regex; group, least: a match counts if that group has so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules.
BASE = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What the method adds: published token shapes.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)


def both(op: str, *parts: Query) -> Query:
    """And or or of queries, without what changes nothing."""
    flat = [q for p in parts for q in (p[1:] if p[0] == op else (p,))]
    if op == "or" and ALL in flat:
        return ALL
    kept = tuple(dict.fromkeys(q for q in flat if q != ALL))
    return ALL if not kept else kept[0] if len(kept) == 1 else (op, *kept)


def of_text(text: str) -> Query:
    raw = text.encode()
    return both("and", *(("tri", raw[i : i + 3]) for i in range(len(raw) - 2)))


def of_texts(texts: set[str]) -> Query:
    return both("or", *(of_text(t) for t in sorted(texts))) if texts else ALL


def trigram_query(pattern: str) -> Query:
    """What every match of the regex holds once ASCII letters are in lower case. Runs of parts with few alternatives are spelled out together."""

    def chars(op, arg, fold: bool) -> set[str] | None:
        if op is sre.LITERAL:
            c = chr(arg)
            return {c.lower() if c.isascii() else c} if c.isascii() or not fold else None
        if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            each = [chars(o, a, fold) for o, a in arg]
            return set().union(*each) if None not in each else None
        return None

    def walk(parsed, fold: bool) -> tuple[set[str] | None, Query]:
        """(all texts of this part if few, query)"""
        runs: set[str] = {""}
        query, whole = ALL, True

        def close() -> None:
            nonlocal runs, query, whole
            query, runs, whole = both("and", query, of_texts(runs)), {""}, False

        for op, arg in parsed:
            part: set[str] | None
            inner = ALL
            if op is sre.SUBPATTERN:
                _, add, drop, sub = arg
                part, inner = walk(sub, (fold or bool(add & re.I)) and not drop & re.I)
            elif op is sre.BRANCH:
                each = [walk(b, fold) for b in arg[1]]
                part = set().union(*(t for t, _ in each)) if all(t is not None for t, _ in each) else None
                inner = both("or", *(q for _, q in each))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) or getattr(sre, "POSSESSIVE_REPEAT", None) is op:
                low, high, sub = arg
                one, q = walk(sub, fold)
                part = {"", *one} if one is not None and (low, high) == (0, 1) else None
                inner = q if low else ALL
            elif op is sre.AT:
                part = {""}
            else:
                part = chars(op, arg, fold)
            joined = {a + b for a in runs for b in part} if part is not None and len(runs) * len(part) <= MOST_TEXTS else None
            if joined is not None:
                runs = joined
            else:
                close()
                query = both("and", query, inner)
                if part is not None and len(part) <= MOST_TEXTS:
                    runs = set(part)
        if not whole:
            query = both("and", query, of_texts(runs))
            return None, query
        return runs, of_texts(runs)

    return walk(sre_parser.parse(pattern), bool(re.compile(pattern).flags & re.I))[1]


def named(query: Query) -> set[bytes]:
    return {query[1]} if query[0] == "tri" else set().union(*(named(q) for q in query[1:])) if len(query) > 1 else set()


class Index:
    """Postings of one shard for the trigrams that some rule names; ASCII letters count in lower case."""

    def __init__(self, texts: pa.Array, trigrams: list[bytes]) -> None:
        data, offsets = utf8(texts)
        data = _LOWER[data]
        self.size, self.known = len(texts), {}
        if not trigrams:
            return
        codes = np.array([int.from_bytes(t, "big") for t in trigrams])
        if len(data) >= 3:
            # a small table of the last two bytes' hash first, since few places match
            wanted = np.zeros(1 << 16, bool)
            wanted[codes & 0xFFFF] = True
            low = data[1:-1].astype(np.uint16) << np.uint16(8) | data[2:]
            at = np.flatnonzero(wanted[low])
            code = data[at].astype(np.int64) << 16 | low[at]
            order = np.sort(codes)
            spot = np.minimum(np.searchsorted(order, code), len(order) - 1)
            ok = order[spot] == code
            at, spot = at[ok], spot[ok]
            doc = np.searchsorted(offsets, at, "right") - 1
            ok = at + 3 <= offsets[doc + 1]
            pair = np.unique(spot[ok] * np.int64(self.size) + doc[ok])
            which, doc = pair // self.size, pair % self.size
            cuts = np.searchsorted(which, np.arange(len(order) + 1))
            self.known = {int(c).to_bytes(3, "big"): doc[cuts[i] : cuts[i + 1]] for i, c in enumerate(order)}

    def find(self, query: Query) -> np.ndarray:
        if query[0] == "all":
            return np.arange(self.size)
        if query[0] == "tri":
            return self.known.get(query[1], np.zeros(0, np.int64))
        parts = [self.find(q) for q in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.trigrams = sorted(set().union(*(named(q) for _, _, q in self.rules)))

    def spans(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of each text in code points, by start, then rule."""
        index, out, own = Index(texts, self.trigrams), [[] for _ in range(len(texts))], {}
        for k, (rule, regex, query) in enumerate(self.rules):
            for i in index.find(query).tolist():
                if i not in own:
                    own[i] = texts[i].as_py() or ""
                for m in regex.finditer(own[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        for row in out:
            row.sort()
        return out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, base: int = len(BASE)) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex (n_<kind> for the first `base` rules), base_sha256, spans.

    Null or empty text has no spans; repeated rows are scanned alike; spans of different kinds may overlap; an empty table
    gives no rows; other columns are not read.
    """
    kinds = [r.kind for r in rules]
    schema = ", ".join(["doc_id long", *(f"n_{k} long" for k in kinds[:base]), "base_sha256 string", "spans string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for a, b in slices(texts):
                found = scanner.spans(texts.slice(a, b - a))
                counts = [pa.array([sum(x[1] == k for x in row) for row in found], pa.int64()) for k in range(base)]
                said = [[",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in row if k < most) for row in found] for most in (base, len(rules))]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in said[0]]), pa.array(said[1])], [c.split()[0] for c in schema.split(", ")])

    return texts_of(docs).select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), schema)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """docs with every span replaced by [kind]; overlapping spans become one, named by the first. n_chars follows, where it is a column."""
    schema = docs.schema

    def clean(text: str, row: list[tuple[int, int, int]]) -> str:
        out, at, stop = [], 0, 0
        for s, k, e in row:
            if s >= stop:
                out += [text[at:s], f"[{rules[k].kind}]"]
            at = stop = max(stop, e)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for a, b in slices(column(batch, "text")):
                part = batch.slice(a, b - a)
                texts = column(part, "text")
                found = scanner.spans(texts)
                if any(found):
                    new = texts.to_pylist()
                    spot = batch.schema.get_field_index("n_chars")
                    sizes = part.column(spot).to_pylist() if spot >= 0 else []
                    for i, row in enumerate(found):
                        if row:
                            new[i] = clean(new[i], row)
                            if sizes:
                                sizes[i] = len(new[i])
                    columns = {batch.schema.get_field_index("text"): pa.array(new, texts.type)} | ({spot: pa.array(sizes, part.column(spot).type)} if sizes else {})
                    part = pa.RecordBatch.from_arrays([columns.get(i, part.column(i)) for i in range(part.num_columns)], schema=part.schema)
                yield part

    return texts_of(docs).mapInArrow(trimmed(run), schema)
