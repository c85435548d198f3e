"""Language ID by cross-parsing entropy over suffix automata of labelled text.

For each language a suffix automaton is built over a bounded sample of its labelled text. A text is parsed greedily into the
longest phrases that occur in that sample; phrases * log2(sample length) / characters is the cross-parsing estimate of
the text's entropy under the language, and the least wins. The automaton is flattened to a table state x letter whose entries already
restart at the root where a phrase ends, so many blocks of text are parsed in step, one table look-up per letter. A phrase
never crosses a block of `BLOCK` letters, for every language alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import code_points, column, held_out, resident, slices, texts_of, trimmed

BLOCK = 128
BREAK = 1 << 30
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def automaton(symbols: list[int], size: int) -> np.ndarray:
    """Suffix automaton of a sequence of symbols below `size`, flat: entry = next state * size, plus BREAK where a phrase ends."""
    link, longest, moves = [-1], [0], [{}]
    last = 0
    for c in symbols:
        now = len(moves)
        longest.append(longest[last] + 1)
        moves.append({})
        link.append(0)
        at = last
        while at != -1 and c not in moves[at]:
            moves[at][c] = now
            at = link[at]
        if at != -1:
            to = moves[at][c]
            if longest[at] + 1 == longest[to]:
                link[now] = to
            else:
                copy = len(moves)
                longest.append(longest[at] + 1)
                moves.append(dict(moves[to]))
                link.append(link[to])
                while at != -1 and moves[at].get(c) == to:
                    moves[at][c] = copy
                    at = link[at]
                link[to] = link[now] = copy
        last = now
    root = np.full(size, BREAK, np.int32)  # a letter the sample lacks is a phrase of its own
    for c, to in moves[0].items():
        root[c] = to * size | BREAK
    table = np.tile(root, (len(moves), 1))
    for s, out in enumerate(moves):
        for c, to in out.items():
            table[s, c] = to * size
    table[:, 0] = np.arange(len(moves)) * size  # padding
    return table.reshape(-1)


def parsers(samples: dict[str, str]) -> tuple[list[str], np.ndarray, int, list[np.ndarray], np.ndarray]:
    """(languages, symbol of each code point, number of symbols, tables, log2 of sample lengths); symbol 0 pads, 1 is
    anything but a letter, 2 a letter that no sample has."""
    names = sorted(samples)
    seen = sorted({c for t in samples.values() for c in t.lower() if c.isalpha()})
    symbol = np.where(letters(), np.uint16(2), np.uint16(1))
    for k, c in enumerate(seen):
        for form in {c, c.upper(), c.lower()}:
            if len(form) == 1:
                symbol[ord(form)] = k + 3
    size = len(seen) + 3
    tables, logs = [], []
    for n in names:
        own = symbol[code_points([samples[n]])[0]]
        own = own[np.append(True, (own[1:] != 1) | (own[:-1] != 1))] if len(own) else own
        own = own[own != 2]
        tables.append(automaton(own.tolist(), size))
        logs.append(math.log2(max(2, len(own))))
    return names, symbol, size, tables, np.array(logs)


def classify(texts: list[str], parser: tuple) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language of each text, how far the runner-up is behind (0: und, else from 0.5, a tie, to 1), and the phrases a symbol that the
    language needs, times the logarithm of its sample's length: bits a symbol."""
    names, symbol, _, tables, logs = parser
    codes, offsets = code_points(texts)
    out, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not len(codes) or not names:
        return out, scores, scores
    has = np.add.reduceat(np.append(letters()[codes], False), offsets[:-1]) > 0 if len(codes) else np.zeros(len(texts), bool)
    has &= np.diff(offsets) > 0
    got = symbol[codes]
    # runs of other characters count as one, also across the end of a text, where the next text's first one is dropped
    keep = np.ones(len(got), bool)
    keep[1:] = (got[1:] != 1) | (got[:-1] != 1)
    got, ends = got[keep], np.append(0, np.cumsum(keep))[offsets]
    sizes = np.diff(ends)
    n = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.repeat(ends[:-1], n) + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * BLOCK
    long = np.minimum(BLOCK, np.repeat(ends[1:], n) - first)
    phrases = np.zeros((len(names), len(texts)))
    for a in range(0, len(owner), 65536):
        part = slice(a, a + 65536)
        order = np.argsort(-long[part], kind="stable")
        start, many = first[part][order], long[part][order]
        live = np.searchsorted(-many, -np.arange(1, BLOCK + 1), "right")  # blocks that have a letter at each step
        rows = [got[start[: live[k]] + k].astype(np.int32) for k in range(int(many[0]) if len(many) else 0)]
        for k, table in enumerate(tables):
            state, count = np.zeros(len(start), np.int32), np.ones(len(start), np.int32)
            for row in rows:
                m = len(row)
                row = table.take(row + state[:m])
                count[:m] += row >> 30
                np.bitwise_and(row, BREAK - 1, out=state[:m])
            phrases[k] += np.bincount(owner[part][order], count, len(texts))
    cost = phrases * logs[:, None] / np.maximum(sizes, 1)
    best = np.argmin(cost, axis=0)  # ties: the first by name
    least = cost[best, np.arange(len(texts))]
    if len(names) > 1:
        second = np.partition(cost, 1, axis=0)[1]
        share = second / np.maximum(least + second, 1e-12)
    else:
        share = np.ones(len(texts))
    for i in np.flatnonzero(has).tolist():
        out[i], scores[i] = names[best[i]], share[i]
    return out, scores, least


def samples(docs: DataFrame, chars: int = 16_000, per_doc: int = 4_000, docs_each: int = 32) -> dict[str, str]:
    """A bounded sample of labelled training text for each language: of the `docs_each` distinct texts (by their first `per_doc`
    characters) with the least hash, `chars` characters in all. Held-out rows and rows without a language are never read."""
    pool = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), "doc_id", F.substring("text", 1, per_doc).alias("text"))
    hashed = pool.select("lang", "doc_id", F.xxhash64("text").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    # the copies of a text are one row before any is ranked; its least id leads back to the text
    chosen = hashed.groupBy("lang", "h").agg(F.min("doc_id").alias("id")).withColumn("rank", rank).where(F.col("rank") <= docs_each).select(F.col("lang").alias("l"), "h", "id")
    same = (F.col("lang") == F.col("l")) & (F.xxhash64("text") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id"))
    once = pool.join(F.broadcast(chosen), same).select("lang", "h", "text").distinct()
    found: dict[str, dict] = {}
    for r in sorted(once.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        found.setdefault(r["lang"], {})[r["text"]] = 1
    return {k: " ".join(v)[:chars] for k, v in found.items()}


def parser_of(model: Broadcast) -> tuple:
    """The tables of a broadcast sample, built once a process."""
    return resident(("parser", *sorted(model.value.items())), lambda: parsers(model.value))


def predict(docs: DataFrame, model: dict[str, str]) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    `und` with score 0: null text, text without a letter, or no training text at all. Repeated rows get equal answers; a null
    doc_id counts as not held out; an empty table gives no rows; lang and source are not read here.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(sent)
        for batch in batches:
            ids, held, texts = column(batch, "doc_id"), column(batch, "held_out"), column(batch, "text")
            for a, b in slices(texts):
                lang, score, _ = classify([t or "" for t in texts.slice(a, b - a).to_pylist()], parser)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), held.slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return texts_of(docs).select(docs["doc_id"].cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(trimmed(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: dict[str, str], most: float = 1.25, symbols: int = 200) -> DataFrame:
    """The rows of docs whose text is in a learned language; a null `lang` becomes the language found, all other columns stay.

    A text goes if it is null or has no letter, or if it has at least `symbols` characters and even its best language needs more than `most` times
    the bits that naming each of them by itself would take: then it is in no language learned. Shorter ones are too short to tell.
    Where no language was learned, any text with a letter stays. Repeated rows fare alike; an empty table gives no rows.
    """
    if not model:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(sent)
        single = math.log2(parser[2])  # bits of one symbol of the alphabet
        for batch in batches:
            texts = column(batch, "text")
            for a, b in slices(texts):
                part = batch.slice(a, b - a)
                own = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                lang, _, bits = classify(own, parser)
                stays = np.array([x != UNKNOWN for x in lang], bool) & ((bits <= most * single) | (np.array([len(t) for t in own]) < symbols))
                if "lang" in part.schema.names and pa.types.is_string(column(part, "lang").type):
                    at = part.schema.get_field_index("lang")
                    part = part.set_column(at, part.schema.field(at), pc.coalesce(part.column(at), pa.array(lang, pa.string())))
                yield part.filter(pa.array(stays, pa.bool_()))

    return texts_of(docs).mapInArrow(trimmed(run), docs.schema)
