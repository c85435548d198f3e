"""Near-duplicate embeddings through navigable small-world graphs, one per shard.

Equal vectors are one node. Nodes are dealt to shards by hash; each shard builds a hierarchical graph by inserting batches of nodes
and linking them to diverse near ones. Every node is then searched in every shard, many queries in step. A beam that is full
of links is widened until it ends below the threshold; besides, sampled queries and planted ones, which have links for certain, are compared with brute force in each
pair of shards; the beam doubles until the mean recall of their links passes, and where no beam passes all are compared. Cosines are checked in double precision. A pair of shards
returns link counts and a forest of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, components, mix, staged, trimmed, width, with_heavy

LINKS = 16  # per node and layer; twice as many may point back
LEVEL = 16  # one node in so many stands a layer higher
STEP = 256  # queries searched in step


class Graph:
    """A hierarchical graph over unit vectors."""

    def __init__(self, unit: np.ndarray, breadth: int = 48) -> None:
        self.unit, self.breadth = unit, breadth
        self.stamp, self.turn = np.zeros((0, 0), np.uint16), 0
        n = len(unit)
        draw = mix(np.arange(1, n + 1, dtype=np.uint64)).astype(np.float64) / 2.0**64
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-18)) / np.log(LEVEL)).astype(np.int64), 6)
        order = np.argsort(-self.level, kind="stable")
        self.entry = int(order[0]) if n else -1
        self.near = [np.full((n, 2 * LINKS), -1, np.int32) for _ in range(int(self.level.max(initial=0)) + 1)]
        at = 0
        while at < n:  # higher nodes first; a batch is at most as large as what stands already
            size = min(max(at, 1), 512, n - at)
            self.insert(order[at : at + size], at > 0)
            at += size

    def insert(self, nodes: np.ndarray, any_before: bool) -> None:
        query = self.unit[nodes]
        start = np.full((len(nodes), 1), self.entry)
        for layer in range(len(self.near) - 1, -1, -1):
            own = np.flatnonzero(self.level[nodes] >= layer)
            wide = self.breadth if len(own) else 1
            if any_before:
                ids, sims = self.search_layer(query, start, layer, wide)
            else:
                ids, sims = np.full((len(nodes), 1), -1), np.full((len(nodes), 1), -2.0, np.float32)
            if len(own):
                inner = query[own] @ query[own].T
                np.fill_diagonal(inner, -2)
                both = np.hstack([ids[own], np.broadcast_to(nodes[own], inner.shape)])
                worth = np.hstack([np.where(ids[own] < 0, -2, sims[own]), inner]).astype(np.float32)
                top = np.argsort(-worth, axis=1, kind="stable")[:, : self.breadth]
                self.connect(nodes[own], np.take_along_axis(both, top, 1), np.take_along_axis(worth, top, 1), layer)
            if any_before:
                start = np.where(ids[:, :1] < 0, self.entry, ids[:, :1])

    def pick(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates in order of similarity, those nearer to the node than to any picked before; then the nearest others."""
        vectors = self.unit[np.maximum(ids, 0)]
        between = vectors @ vectors.transpose(0, 2, 1)
        chosen = np.zeros(ids.shape, bool)
        count = np.zeros(len(ids), np.int64)
        for c in range(ids.shape[1]):
            blocked = (chosen & (between[:, c] > sims[:, c, None])).any(axis=1)
            take = ~blocked & (count < most) & (sims[:, c] > -1.5)
            chosen[:, c] = take
            count += take
        rank = np.where(sims > -1.5, np.where(chosen, 0, 1), 2) * ids.shape[1] + np.arange(ids.shape[1])
        best = np.argsort(rank, axis=1)[:, :most]
        out = np.take_along_axis(ids, best, 1)
        return np.where(np.take_along_axis(sims, best, 1) > -1.5, out, -1)

    def connect(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, layer: int) -> None:
        chosen = self.pick(ids, sims, LINKS)
        table = self.near[layer]
        table[nodes, : chosen.shape[1]] = chosen
        source, target = np.repeat(nodes, chosen.shape[1]), chosen.reshape(-1)
        ok = target >= 0
        source, target = source[ok], target[ok]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        if not len(target):
            return
        hit, first, many = np.unique(target, return_index=True, return_counts=True)
        extra = np.full((len(hit), int(many.max())), -1)
        extra[np.repeat(np.arange(len(hit)), many), np.arange(len(target)) - np.repeat(first, many)] = source
        for a in range(0, len(hit), 512):
            own = hit[a : a + 512]
            joined = np.hstack([table[own], extra[a : a + 512]])
            joined.sort(axis=1)
            joined[:, 1:][joined[:, 1:] == joined[:, :-1]] = -1
            worth = np.where(joined < 0, -2, np.einsum("nd,nkd->nk", self.unit[own], self.unit[np.maximum(joined, 0)]))
            top = np.argsort(-worth, axis=1, kind="stable")[:, : 4 * LINKS]
            table[own] = np.pad(kept := self.pick(np.take_along_axis(joined, top, 1), np.take_along_axis(worth, top, 1), 2 * LINKS), ((0, 0), (0, 2 * LINKS - kept.shape[1])), constant_values=-1)

    def visits(self, n: int) -> tuple[np.ndarray, int]:
        """A table of queries and nodes, and the number that marks a visit in this search; older numbers are older searches, so
        nothing is cleared until the numbers run out."""
        if len(self.stamp) < n:
            self.stamp, self.turn = np.zeros((max(n, STEP), len(self.unit)), np.uint16), 0
        elif self.turn == 0xFFFF:
            self.stamp[:], self.turn = 0, 0
        self.turn += 1
        return self.stamp, self.turn

    def search_layer(self, query: np.ndarray, start: np.ndarray, layer: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step: (ids, similarities), best first, -1 where there are fewer."""
        n, table = len(query), self.near[layer]
        seen, turn = self.visits(n)
        rows = np.arange(n)
        ids = np.full((n, wide), -1)
        sims = np.full((n, wide), -2, np.float32)
        ids[:, 0] = start[:, 0]
        sims[:, 0] = np.einsum("nd,nd->n", query, self.unit[start[:, 0]])
        seen[rows, start[:, 0]] = turn
        fresh = ids >= 0
        while True:
            live = np.flatnonzero(fresh.any(axis=1))
            if not len(live):
                return ids, sims
            each = min(4 if wide >= 16 else 1, wide)
            spot = np.argsort(np.where(fresh[live], -sims[live], 9), axis=1, kind="stable")[:, :each]
            open_ = np.take_along_axis(fresh[live], spot, 1)
            fresh[live[:, None], spot] = False
            from_ = np.where(open_, np.take_along_axis(ids[live], spot, 1), -1)
            new = np.where((from_ >= 0)[:, :, None], table[np.maximum(from_, 0)], -1).reshape(len(live), -1)
            if each > 1:
                new.sort(axis=1)
                new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[live[:, None], np.maximum(new, 0)] == turn] = -1
            r, c = np.nonzero(new >= 0)
            seen[live[r], new[r, c]] = turn
            worth = np.full(new.shape, -2, np.float32)
            worth[r, c] = np.einsum("nd,nd->n", query[live[r]], self.unit[new[r, c]])
            both, value = np.hstack([ids[live], new]), np.hstack([sims[live], worth])
            flags = np.hstack([fresh[live], worth > -1.5])
            top = np.argsort(-value, axis=1, kind="stable")[:, :wide]
            ids[live], sims[live], fresh[live] = np.take_along_axis(both, top, 1), np.take_along_axis(value, top, 1), np.take_along_axis(flags, top, 1)

    def search(self, query: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full((len(query), 1), self.entry)
        for layer in range(len(self.near) - 1, 0, -1):
            start = self.search_layer(query, start, layer, 1)[0]
        return self.search_layer(query, start, 0, min(wide, len(self.unit)))

    def above(self, query: np.ndarray, least: float, wide: int) -> list[np.ndarray]:
        """Of each query, the nodes found with a similarity of at least `least`; full beams are widened."""
        out: list = [None] * len(query)
        todo = np.arange(len(query))
        while len(todo):
            step = max(8, min(STEP, STEP * 256 // max(wide, 1)))
            again = []
            for a in range(0, len(todo), step):
                part = todo[a : a + step]
                ids, sims = self.search(query[part], wide)
                full = (sims[:, -1] >= least) & (ids.shape[1] < len(self.unit))
                for i, q in enumerate(part.tolist()):
                    if full[i]:
                        again.append(q)
                    else:
                        out[q] = ids[i][(sims[i] >= least) & (ids[i] >= 0)]
            todo, wide = np.array(again, np.int64), wide * 4
        return out


def pack(ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray, graph: Graph | None) -> bytes:
    head = np.array([*vectors.shape, vectors.itemsize, len(graph.near) if graph else 0, graph.entry if graph else -1], "<i8")
    return b"".join([head.tobytes(), ids.astype("<i8").tobytes(), weights.astype("<i8").tobytes(), np.ascontiguousarray(vectors).tobytes(), *(x.tobytes() for x in (graph.near if graph else []))])


def unit_of(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.linalg.norm(v / np.abs(v).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(v).max(axis=1, keepdims=True)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph | None]:
    n, dim, size, layers, entry = np.frombuffer(raw, "<i8", 5).tolist()
    at = 40
    ids, weights = np.frombuffer(raw, "<i8", n, at), np.frombuffer(raw, "<i8", n, at + 8 * n)
    at += 16 * n
    unit = unit_of(np.frombuffer(raw, f"<f{size}", n * dim, at).reshape(n, dim))
    at += n * dim * size
    graph = None
    if layers:
        graph = Graph.__new__(Graph)
        graph.unit, graph.entry, graph.breadth = unit.astype(np.float32), entry, 48
        graph.stamp, graph.turn = np.zeros((0, 0), np.uint16), 0
        graph.near = [np.frombuffer(raw, "<i4", n * 2 * LINKS, at + k * n * 8 * LINKS).reshape(n, 2 * LINKS) for k in range(layers)]
    return ids, weights, unit, graph


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links that connect something new, in order."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (p := parent.get(i, i)) != i:
            parent[i] = i = parent.get(p, p)
        return i

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


def planted(unit: np.ndarray, least: float, many: int) -> np.ndarray:
    """Perturbed copies of nodes, half-way between the threshold and the node: queries that have a link for certain."""
    own = unit[np.argsort(mix(np.arange(1, len(unit) + 1, dtype=np.uint64)))[:many]]
    noise = mix(np.arange(1, own.size + 1, dtype=np.uint64)).astype(np.float64).reshape(own.shape) / 2.0**63 - 1
    noise -= own * np.einsum("nd,nd->n", noise, own)[:, None]
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    cos = (1 + least) / 2
    return (cos * own + np.sqrt(1 - cos * cos) * noise).astype(np.float32)


def audited_beam(graph: Graph, query: np.ndarray, own: np.ndarray, other: np.ndarray, loose: float, wide: int, recall: float) -> tuple[int, int, int]:
    """(beam, true links, found ones): the beam, doubled until the mean recall of the queries that have links passes; 0 if no beam does,
    so that only comparing all is good enough. own, other: ids of queries (-1: planted) and nodes; a query's link to itself does not count."""
    true = (query @ graph.unit.T >= loose) & (own[:, None] != other[None])
    each = true.sum(axis=1)
    if not each.any():
        return wide, 0, 0
    while True:
        found = np.array([true[i, x].sum() for i, x in enumerate(graph.above(query, loose, wide))])
        if (found[each > 0] / each[each > 0]).mean() >= recall:
            return wide, int(each.sum()), int(found.sum())
        if wide >= len(other):
            return 0, int(each.sum()), int(each.sum())
        wide *= 2


def search_shard(left: bytes, right: tuple, least: float, wide: int, audited: int, recall: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(ids, link weights, forest ends, audited links, those found) of the nodes on the left searched in the graph on the right."""
    ids, _, unit, _ = unpack(left)
    other, weights, theirs, graph = right
    query, loose = unit.astype(np.float32), least - 1e-4
    check = np.argsort(mix(ids.view(np.uint64)))[:audited]
    probes = planted(theirs, least, audited)
    wide, truth, got = audited_beam(graph, np.vstack([query[check], probes]), np.append(ids[check], np.full(len(probes), -1)), other, loose, wide, recall)
    degree, ends = np.zeros(len(ids), np.int64), [(np.zeros(0, np.int64),) * 2]
    step = 4096 if wide else 256
    for a in range(0, len(ids), step):
        part = query[a : a + step]
        found = graph.above(part, loose, wide) if wide else [np.flatnonzero(x) for x in part @ graph.unit.T >= loose]
        q = np.repeat(np.arange(a, a + len(found)), [len(x) for x in found])
        t = np.concatenate(found) if found else np.zeros(0, np.int64)
        for i in range(0, len(q), 100_000):
            x, y = q[i : i + 100_000], t[i : i + 100_000]
            ok = (np.einsum("nd,nd->n", unit[x], theirs[y]) >= least) & (ids[x] != other[y])
            x, y = x[ok], y[ok]
            np.add.at(degree, x, weights[y])
            ends.append(forest(ids[x], other[y]))
    a, b = forest(*(np.concatenate([e[i] for e in ends]) for i in (0, 1)))
    return ids, degree, a, b, truth, got


def link(vectors: DataFrame, least: float = 0.9, shards: int = 4, most_rows: int = 50_000, most_bytes: int = 1 << 26, wide: int = 48, audited: int = 64, recall: float = 0.99) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    A shard holds at most about `most_rows` vectors and `most_bytes` of them. Each shard's graph is sent to a few tasks, and past it stream all shards' vectors.
    Equal vectors are linked without a search. Null or zero vectors and those with null or non-finite components have no
    links and are their own component; vectors of different lengths never link; repeated rows are vectors of their own with
    one id; rows without an id have no links and a null component; an empty table gives no rows; labels are not read.
    The audits of the result are its `_audits`: by pair of shards the links that sampled and planted queries have, and those found.
    """
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.elementType == T.FloatType()
    size, kind = (4, "array<float>") if single else (8, "array<double>")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    hashed = own.select("vec_id", good.alias("good"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), F.reverse("v")).alias("h2"), "v")
    same = staged(hashed.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("v").alias("v")), "classes")
    about = same.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dim")).first()
    count = max(shards, -(-about["n"] // max(1, min(most_rows, most_bytes // (size * about["dim"])))))
    dealt = same.select("rep", "w", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("rep", "h1"), F.lit(count)).cast("int").alias("shard"))

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("rep")
        dim = key[0].as_py()
        raw = rows.column("v").combine_chunks().values.to_numpy().astype(f"<f{size}").reshape(-1, dim)
        graph = Graph(unit_of(raw).astype(np.float32))
        ids, weights = rows.column("rep").to_numpy(), rows.column("w").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([pack(ids, weights, raw, None)], pa.binary()), pa.array([pack(ids, weights, raw, graph)], pa.binary())], ["dim", "shard", "queries", "graph"])

    graphs = staged(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, queries binary, graph binary"), "graphs")
    lanes = max(1, min(count, -(-width(spark) // count)))  # tasks that share a graph
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    built = graphs.select("dim", F.col("shard").alias("at"), each(lanes).alias("lane"), F.lit(-1).alias("source"), F.col("graph").alias("raw"))
    asked = graphs.select("dim", each(count).alias("at"), F.pmod("shard", F.lit(lanes)).cast("int").alias("lane"), F.col("shard").alias("source"), F.col("queries").alias("raw"))
    # in each partition a graph comes before the vectors that are searched in it
    pairs = built.unionByName(asked).repartition(count * lanes, "dim", "at", "lane").sortWithinPartitions("dim", "at", "lane", "source")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, of = None, None
        for batch in batches:
            for i in range(len(batch)):
                where, raw = tuple(column(batch, c)[i].as_py() for c in ("dim", "at", "lane")), column(batch, "raw")[i].as_py()
                if column(batch, "source")[i].as_py() < 0:
                    graph, of = unpack(raw), where
                elif of == where:
                    ids, degree, a, b, truth, got = search_shard(raw, graph, least, wide, audited, recall)
                    none = lambda n: pa.nulls(n, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(ids), none(len(ids)), pa.array(degree)], ["a", "b", "n"])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none(len(a))], ["a", "b", "n"])
                    yield pa.RecordBatch.from_arrays([none(1), pa.array([truth], pa.int64()), pa.array([got], pa.int64())], ["a", "b", "n"])

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))
    found = staged(pairs.mapInArrow(trimmed(search), "a long, b long, n long"), "links")
    degrees = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = components(found.where("n is null"))
    linked = same.select("h1", "h2", "rep", "w").join(degrees, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    classes = staged(linked.select("h1", "h2", "w", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "rep").alias("c")), "named")
    keyed = hashed.select("vec_id", "good", F.when(F.col("good"), F.col("h1")).alias("h1"), "h2")
    out = with_heavy(keyed, classes, ["h1", "h2"], "w")
    component = F.when(F.col("good"), F.col("c")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.when(F.col("good"), F.col("n")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
    out._audits = found.where("a is null").select(F.col("b").alias("links"), F.col("n").alias("found"))
    return out
