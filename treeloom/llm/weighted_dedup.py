"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five words; their weight is tf * idf. Document frequencies are counted over the whole corpus, exactly for all frequent
shingles. `SAMPLES` consistent samples a document make `BANDS` keys; documents that share a key
are candidates if their samples agree often enough, and links if their weighted Jaccard similarity is at least 0.8.

No group is ever compared pair by pair at first: each member is compared with one leader (a join, so a group may span
any number of tasks). Only members that do not match their leader are compared with the others, in blocks of bounded size, and there a
pair is skipped once both are connected. Connectivity is the same as with all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, components, mix, release, slices, staged, texts_of, trimmed, utf8, with_heavy, words

WORDS = 5
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
DAMPED = 0.2  # what a rare shingle weighs more than one in all documents: see README for what other values lose
SHARE = 1 / 200  # shingles in at most this share of the documents count as equally rare
AGREE = 17  # of 30: at similarity 0.8 the number is binomial with mean 24 and deviation 2.2, below 17 in 0.1 % of pairs
TABLE = 1 << 18
BLOCKS = 64
ROOM = 14  # bits for a text's number in a slice
MASK = np.uint64((1 << 64 - ROOM) - 1)


def gamma_table(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma distribution with shape 2, by Newton steps."""
    p = (np.arange(n) + 0.5) / n
    x = np.sqrt(2 * p) + p
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
    return x


_GAMMA = gamma_table().astype(np.float32)
_LOG_GAMMA = np.log(_GAMMA)
_SEEDS = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, offsets by text): the distinct shingles of each text in order of hash.

    Words are parted by ASCII white space. A text of fewer than five words is one shingle, one without a word has none.
    """
    data, offsets = utf8(texts)
    _, _, hashes, bounds = words(data, offsets)
    many = np.diff(bounds)
    n = np.where(many >= WORDS, many - WORDS + 1, np.minimum(many, 1))
    owner = np.repeat(np.arange(len(n)), n)
    first = np.repeat(bounds[:-1], n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    left = np.repeat(bounds[1:], n) - first
    value = np.zeros(len(owner), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            part = hashes[np.minimum(first + k, len(hashes) - 1)] if len(hashes) else value
            value = value * np.uint64(0xD6E8FEB86659FD93) + np.where(left > k, part, np.uint64(k + 1))
        joint = owner.astype(np.uint64) << np.uint64(64 - ROOM) | mix(value) >> np.uint64(ROOM)
    joint.sort()
    at = np.flatnonzero(np.append(True, joint[1:] != joint[:-1])) if len(joint) else np.zeros(0, np.int64)
    counts = np.diff(np.append(at, len(joint)))
    joint = joint[at]
    return joint & MASK, counts, np.searchsorted(joint >> np.uint64(64 - ROOM), np.arange(len(texts) + 1, dtype=np.uint64))


def small(texts: pa.Array) -> Iterator[tuple[int, int]]:
    for a, b in slices(texts):
        for c in range(a, b, 1 << ROOM):
            yield c, min(b, c + (1 << ROOM))


@dataclass
class Weights:
    """The weight of a shingle: 1 + DAMPED * ln(n / max(df, SHARE * n)) / ln(1 / SHARE), n and df being numbers of documents. keys: the shingles in
    more than SHARE of the documents, with their weights; all others weigh `rare`. maybe: which places keys fall into.

    There are fewer keys than a document has shingles on average, divided by SHARE, whatever the number of documents.
    """

    maybe: np.ndarray
    keys: np.ndarray
    weights: np.ndarray
    rare: float

    @classmethod
    def of(cls, n: int, keys: np.ndarray, df: np.ndarray) -> Weights:
        weigh = lambda x: (1 + DAMPED * np.log(max(1, n) / np.maximum(x, max(1.0, SHARE * n))) / np.log(1 / SHARE)).astype(np.float32)
        order = np.argsort(keys)
        maybe = np.zeros(TABLE, bool)
        maybe[place(keys, 0)] = True
        return cls(maybe, keys[order], weigh(df[order]), float(weigh(np.ones(1))[0]))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.rare, np.float32)
        at = np.flatnonzero(self.maybe[place(hashes, 0)])
        if len(at):
            spot = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            same = self.keys[spot] == hashes[at]
            out[at[same]] = self.weights[spot[same]]
        return out


def place(hashes: np.ndarray, table: int) -> np.ndarray:
    """Where a shingle counts in a table: other bits of its hash for each."""
    return ((hashes >> np.uint64(18 * table)) & np.uint64(TABLE - 1)).astype(np.int64)


def frequencies(docs: DataFrame) -> Weights:
    """Document frequencies over the whole corpus, exact for every shingle in more than SHARE of the documents.

    First pass: two tables of places count shingles by hash, so a place holds at least what each of its shingles has. Second pass: the shingles
    both of whose places hold enough are counted one by one, summed by task before the shuffle.
    """
    per = 2 * TABLE // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(2 * TABLE, np.int64), 0
        for batch in batches:
            texts = column(batch, "text")
            for a, b in small(texts):
                hashes, _, offsets = shingles(texts.slice(a, b - a))
                for k in (0, 1):
                    df[k * TABLE : (k + 1) * TABLE] += np.bincount(place(hashes, k), minlength=TABLE)
                n += int((np.diff(offsets) > 0).sum())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, BLOCKS), pa.int32()), pa.array([np.array([n], "<i8").tobytes(), *(df[i * per : (i + 1) * per].astype("<i8").tobytes() for i in range(BLOCKS))], pa.binary())], ["block", "df"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in column(batch, "df"):
                own = np.frombuffer(x.as_buffer(), "<i8")
                total = own if total is None else total + own
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "df"])

    schema = "block int, df binary"
    found = {r["block"]: np.frombuffer(r["df"], "<i8") for r in texts_of(docs).select("text").mapInArrow(trimmed(run), schema).groupBy("block").applyInArrow(add, schema).collect()}
    if -1 not in found:
        return Weights.of(0, np.zeros(0, np.uint64), np.zeros(0))
    n = int(found[-1][0])
    enough = np.concatenate([found[i] for i in range(BLOCKS)]) > SHARE * n
    sent = docs.sparkSession.sparkContext.broadcast(enough)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = sent.value[:TABLE], sent.value[TABLE:]
        keys, sums, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            each, back, many = np.unique(np.concatenate([keys, *held]), return_inverse=True, return_counts=True)
            total = np.bincount(back[: len(keys)], sums, len(each)).astype(np.int64)
            total += many - np.bincount(back[: len(keys)], minlength=len(each))
            return each, total

        for batch in batches:
            texts = column(batch, "text")
            for a, b in small(texts):
                hashes = shingles(texts.slice(a, b - a))[0]
                hashes = hashes[first[place(hashes, 0)]]
                held.append(hashes[second[place(hashes, 1)]])
                if sum(map(len, held)) > 1 << 20:
                    keys, sums = merged()
                    held.clear()
        keys, sums = merged()
        for a in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000].view(np.int64)), pa.array(sums[a : a + 100_000])], ["key", "df"])

    many = texts_of(docs).select("text").mapInArrow(trimmed(count), "key long, df long").groupBy("key").agg(F.sum("df").alias("df")).where(F.col("df") > SHARE * n).toArrow()
    return Weights.of(n, many.column("key").to_numpy().astype(np.int64).view(np.uint64), many.column("df").to_numpy().astype(np.float64))


def sample(hashes: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Consistent weighted samples: SAMPLES 32-bit marks for each text that has shingles (in a row; others are left out)."""
    firsts = offsets[:-1][np.diff(offsets) > 0]
    h, log_w = mix(hashes), np.log(weights).astype(np.float32)
    out = np.zeros((len(firsts), SAMPLES), np.uint32)
    cuts = [0]
    while cuts[-1] < len(firsts):  # pieces that stay in the cache
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(firsts, firsts[cuts[-1]] + 40_000))))
    with np.errstate(over="ignore"):
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            a, b = firsts[i], firsts[j] if j < len(firsts) else len(h)
            own, lw, at = h[a:b], log_w[a:b], firsts[i:j] - a
            for k in range(SAMPLES):
                x = own * _SEEDS[2 * k] + _SEEDS[2 * k + 1]
                r = _GAMMA[x >> np.uint64(48)]
                beta = ((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
                t = np.floor(lw / r + beta)
                log_a = _LOG_GAMMA[(x >> np.uint64(32)) & np.uint64(0xFFFF)] - r * (t - beta) - r
                bits = log_a.view(np.int32)
                rank = (bits ^ ((bits >> 31) | np.int32(-0x80000000))).view(np.uint32).astype(np.uint64)
                mark = ((x ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
                out[i:j, k] = (np.minimum.reduceat(rank << np.uint64(32) | mark, at) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def sketches(docs: DataFrame, weight: Broadcast) -> DataFrame:
    """id, h1, h2 (hashes of the text), sketch, keys (one per band); sketch and keys are null without a word."""
    schema = "id long, h1 long, h2 long, sketch binary, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weight.value
        for batch in batches:
            texts = column(batch, "text")
            for a, b in small(texts):
                hashes, counts, offsets = shingles(texts.slice(a, b - a))
                marks = sample(hashes, counts * table(hashes), offsets)
                has = np.diff(offsets) > 0
                with np.errstate(over="ignore"):
                    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(marks), 1))
                    for r in range(ROWS):
                        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + marks[:, r::ROWS].astype(np.uint64))
                rows, lists = iter(marks.astype("<u4")), iter(keys.view(np.int64))
                sketch = pa.array([next(rows).tobytes() if x else None for x in has.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(column(batch, c).slice(a, b - a) for c in ("id", "h1", "h2")), sketch, pa.array([next(lists) if x else None for x in has.tolist()], pa.list_(pa.int64()))], ["id", "h1", "h2", "sketch", "keys"])

    own = texts_of(docs).select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), F.reverse("text")).alias("h2"), "text")
    return own.mapInArrow(trimmed(run), schema)


def marks_of(array: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(array.to_pylist()), "<u4").reshape(-1, SAMPLES)


class Texts:
    """The shingles and weights of many texts."""

    def __init__(self, texts: pa.Array, table: Weights) -> None:
        self.rows: list[tuple[np.ndarray, np.ndarray, float]] = []
        for a, b in small(texts):
            hashes, counts, offsets = shingles(texts.slice(a, b - a))
            w = counts * table(hashes).astype(np.float64)
            self.rows += [(hashes[x:y], w[x:y], float(w[x:y].sum())) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]

    def similarity(self, i: int, other: Texts, j: int) -> float:
        """Weighted Jaccard."""
        (a, v, s), (b, w, t) = self.rows[i], other.rows[j]
        if not len(a) or not len(b):
            return 0.0
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        same = b[at] == a
        shared = float(np.minimum(v[same], w[at[same]]).sum())
        return shared / (s + t - shared)


def block_links(ids: np.ndarray, marks: np.ndarray, tied: np.ndarray, odd: np.ndarray, exact=None) -> list[tuple[int, int]]:
    """Links of the odd rows with any other row that are not connected yet; tied rows are connected through their leader."""
    parent = np.arange(len(ids))
    if tied.any():
        parent[tied] = np.flatnonzero(tied)[0]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for r in np.flatnonzero(odd).tolist():
        agree = (marks == marks[r]).sum(axis=1)
        near = np.flatnonzero(agree >= AGREE)
        for m in near[np.argsort(-agree[near], kind="stable")].tolist():
            a, b = root(r), root(m)
            if a != b and (exact is None or exact(r, m)):
                parent[max(a, b)] = min(a, b)
                out.append((int(ids[r]), int(ids[m])))
    return out


def links(groups: DataFrame, nodes: DataFrame, table: Broadcast | None, least: float, block: int) -> DataFrame:
    """(a, b): links that connect within each group what all its pairs would connect.

    groups: k, id; nodes: id, sketch, text (null where the samples decide, as then table is null).
    """
    # a leader with many members is joined, not grouped: the skewed side is split
    leaders = groups.groupBy("k").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    mates = with_heavy(groups, staged(leaders, "leaders"), ["k"], "n").where("leader is not null").select("k", "id", "leader", "n")
    pairs = mates.where("id <> leader").select("id", "leader").distinct()
    first = nodes.select(F.col("id").alias("leader"), F.col("sketch").alias("sketch2"), F.col("text").alias("text2"))
    compared = pairs.join(nodes, "id").join(first, "leader").select("id", "leader", "sketch", "sketch2", "text", "text2")

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ok = (marks_of(column(batch, "sketch")) == marks_of(column(batch, "sketch2"))).sum(axis=1) >= AGREE
            if table is not None:
                lead = column(batch, "text2").dictionary_encode()
                own, other, which = Texts(column(batch, "text"), table.value), Texts(lead.dictionary, table.value), lead.indices.to_numpy()
                ok = np.array([bool(x) and own.similarity(i, other, which[i]) >= least for i, x in enumerate(ok)], bool)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "leader"), pa.array(ok, pa.bool_())], ["id", "leader", "ok"])

    done = staged(compared.mapInArrow(trimmed(star), "id long, leader long, ok boolean"), "star")
    found = done.where("ok").select(F.col("id").alias("a"), F.col("leader").alias("b"))
    odd = staged(mates.where("id <> leader").join(done.where("not ok"), ["id", "leader"]).select("k", "id").distinct(), "odd")
    if odd.isEmpty():
        return found
    # blocks of bounded size on both sides
    parts = F.ceil(F.col("n") / block).cast("int")
    spot = F.pmod(F.xxhash64("id"), parts).cast("int")
    far = odd.groupBy("k").count().select("k", F.ceil(F.col("count") / block).cast("int").alias("q"))
    flagged = mates.join(far, "k").join(done.where("ok").select("id", "leader", F.lit(True).alias("tied")), ["id", "leader"], "left")
    members = flagged.select("k", "id", spot.alias("m"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("o"), (F.coalesce("tied", F.lit(False)) | (F.col("id") == F.col("leader"))).alias("tied"), F.lit(False).alias("odd"))
    sizes = leaders.select("k", parts.alias("p"))
    odds = odd.join(far, "k").join(sizes, "k").select("k", "id", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("m"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("q")).cast("int").alias("o"), F.lit(False).alias("tied"), F.lit(True).alias("odd"))
    rows = members.unionByName(odds).groupBy("k", "m", "o", "id").agg(F.max("tied").alias("tied"), F.max("odd").alias("odd")).join(nodes, "id")

    def inner(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("id").combine_chunks()
        get = lambda c: rows.column(c).combine_chunks()
        exact = None
        if table is not None:
            texts = Texts(get("text"), table.value)
            exact = lambda i, j: texts.similarity(i, texts, j) >= least
        got = block_links(get("id").to_numpy(), marks_of(get("sketch")), get("tied").to_numpy(zero_copy_only=False), get("odd").to_numpy(zero_copy_only=False), exact)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], ["a", "b"])

    return found.unionByName(rows.groupBy("k", "m", "o").applyInArrow(inner, "a long, b long"))


def classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least doc_id of its group), kept (doc_id = class_id).

    Equal texts are one node, and so are rows that share a doc_id. Null texts and texts without a word are no copies of
    anything, and rows with a null doc_id are kept with a null class. Ties go to the least id; an empty table gives no
    rows; other columns are not read.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequencies(docs))
    seen = staged(sketches(docs, table), "sketches")
    known = seen.where("id is not null and sketch is not null")
    # equal texts have equal sketches: what stands for them is aggregated before the shuffle, and no copy is joined to find it
    same = staged(known.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")), "same")
    nodes = staged(same.select(F.col("rep").alias("id"), "sketch", "keys").dropDuplicates(["id"]), "nodes")
    buckets = nodes.select(F.explode("keys").alias("k"), "id")
    bare = nodes.select("id", "sketch", F.lit(None).cast("string").alias("text"))
    near = staged(components(links(buckets, bare, None, least, 4096)), "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(near.select("id"), "id", "left_semi").dropDuplicates(["id"])
    full = staged(nodes.select("id", "sketch").join(texts, "id"), "texts")
    groups = near.select(F.col("component").alias("k"), "id")
    final = components(links(groups, full, table, least, 512))
    classed = same.select("h1", "h2", "rep", "n").join(final.select(F.col("id").alias("rep"), "component"), "rep", "left")
    ids = staged(classed.select("h1", "h2", "n", F.coalesce("component", "rep").alias("class_id")), "named")
    own = seen.select(F.col("id").alias("doc_id"), F.when(F.col("id").isNotNull() & F.col("sketch").isNotNull(), F.col("h1")).alias("h1"), "h2")
    out = with_heavy(own, ids, ["h1", "h2"], "n").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of docs that are the least of their group, all columns as they are; of rows that share a doc_id one stays."""
    found = staged(classes(docs, least), "classes")
    ids = found.where("kept and doc_id is not null").select("doc_id").distinct()
    twice = ids.join(found.groupBy("doc_id").count().where("count > 1"), "doc_id").select("doc_id")
    once = ids.join(twice, "doc_id", "left_anti")
    kind = docs.schema["doc_id"].dataType
    cast = lambda df: df.select(F.col("doc_id").cast(kind).alias("doc_id"))
    # the ids kept grow with the corpus, so this is a sort-merge join at every size
    kept = docs.where(F.col("doc_id").isNull()).unionByName(docs.join(cast(once).hint("merge"), "doc_id", "left_semi"))
    if not twice.isEmpty():
        kept = kept.unionByName(docs.join(cast(twice), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(docs.columns)


__all__ = ["classes", "frequencies", "keep_first", "links", "release", "sample", "shingles", "sketches"]
