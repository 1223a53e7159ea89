"""Embedding near-dedup on a robust-pruned flat graph (operator 2).

1. Equal vectors of a label become one class with its number of copies.
2. Classes are assigned to their nearest cluster centres, to ``OVERLAP`` of them and to any nearly as near, so that clusters overlap.
3. Each (label, cluster) shard is dealt into blocks of about ``PART_ROWS`` members.  A block builds a robust-pruned graph; a node's adjacency lists of
   all its shards are united.
4. The blocks of a shard meet two by two: each member of one is searched in the united graph of the other, greedily from its medoid, then expanding every
   node within the range until no new one is found.  Candidates are verified by cosine in double precision, and a pair that either side finds counts
   for both, in the first shard where it meets.  However large a shard or a dense cluster is, no task holds more than two blocks.
5. Shards return link counts and one link of each member to its local component; ``components`` joins them.
6. Recall is audited by brute force over ``AUDIT_ROWS`` vectors, over more of them where these have few links.  Below ``RECALL`` the run is repeated with a wider
   overlap, beam, pool and degree; if that does not reach it, the blocks of each label are compared in full.  The figures are columns of the result.

Centres come from a bounded sample (``SAMPLE_ROWS`` classes with the least hash); every vector is indexed.

Contract: vectors compare only when labels are equal and not null and lengths are equal.  Vectors that are null, empty,
zero or hold null or non-finite components link with nothing.  Each row is a vector of its own, repeated ids included; a
row without id counts as a link of others but its component is the smallest id reachable, if any.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.components import components
from eventlake.llm.rows import materialize, release

SHARD_ROWS = 1024
MAX_CENTRES = 4096
SAMPLE_ROWS = 16384
MARGIN = 0.05
PART_ROWS = 4096
ALPHA, WIDTH, SLACK = 1.2, 8, 0.1
#: Products that a slice of vectors has with the centres at once.
HELD_PRODUCTS = 4 << 20
AUDIT_ROWS, AUDIT_LINKS, AUDIT_MOST, RECALL = 512, 64, 4096, 0.99


@dataclass(frozen=True)
class Effort:
    """How many clusters a vector joins, nodes the walk keeps, and candidates and neighbours a node has."""

    overlap: int = 2
    beam: int = 48
    pool: int = 64
    degree: int = 32


EFFORTS = (Effort(), Effort(4, 128, 128, 64))


# --- one shard -------------------------------------------------------------------------------------------------------


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def robust_prune(point: np.ndarray, pool: np.ndarray, vectors: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of a pool (nearest first), the neighbours that no kept neighbour is ``alpha`` times nearer to."""
    near = vectors[pool]
    to_point = 1 - near @ point
    between = 1 - near @ near.T
    alive = np.ones(len(pool), bool)
    kept = []
    for _ in range(min(degree, len(pool))):
        first = int(alive.argmax())
        if not alive[first]:
            break
        kept.append(first)
        alive &= alpha * between[first] > to_point
        alive[first] = False
    return pool[kept]


def build_graph(vectors: np.ndarray, pool: int = Effort.pool, degree: int = Effort.degree, alpha: float = ALPHA) -> list[np.ndarray]:
    """Adjacency lists of a block: each point's nearest and some far points, pruned, and the reverse edges."""
    n = len(vectors)
    if n == 1:
        return [np.empty(0, np.int64)]
    rng = np.random.default_rng(n)
    size = min(pool, n - 1)
    lists: list[np.ndarray] = []
    for start in range(0, n, 256):
        block = vectors[start : start + 256] @ vectors.T
        block[np.arange(len(block)), np.arange(start, start + len(block))] = -np.inf
        best = np.argpartition(-block, size - 1, axis=1)[:, :size] if size < n - 1 else np.argsort(-block, axis=1)[:, :size]
        for i, row in enumerate(best):
            far = rng.integers(0, n, 8)
            every = np.unique(np.concatenate([row, far[far != start + i]]))
            every = every[np.argsort(-block[i, every], kind="stable")]
            lists.append(robust_prune(vectors[start + i], every, vectors, degree, alpha))
    source = np.repeat(np.arange(n), [len(x) for x in lists])
    target = np.concatenate(lists)
    pairs = np.unique(np.concatenate([source * n + target, target * n + source]))
    cuts = np.searchsorted(pairs // n, np.arange(1, n))
    return np.split(pairs % n, cuts)


class BlockSearch:
    """Range search over a block's graph."""

    def __init__(self, vectors: np.ndarray, graph: list[np.ndarray], beam: int = Effort.beam):
        self.vectors, self.graph, self.beam = vectors, graph, beam
        self.medoid = int((vectors @ vectors.mean(axis=0)).argmax())

    def near(self, query: np.ndarray, least: float) -> np.ndarray:
        """Members with a product of about ``least`` or more that the walk meets."""
        n = len(self.vectors)
        value = np.full(n, -np.inf, np.float32)
        expanded = np.zeros(n, bool)
        value[self.medoid] = query @ self.vectors[self.medoid]
        met = np.array([self.medoid])
        while True:  # greedy: the beam's best unexpanded nodes
            if len(met) > self.beam:
                met = met[np.argpartition(-value[met], self.beam - 1)[: self.beam]]
            todo = met[~expanded[met]]
            if not len(todo):
                break
            if len(todo) > WIDTH:
                todo = todo[np.argpartition(-value[todo], WIDTH - 1)[:WIDTH]]
            new = self._expand(todo, value, expanded, query)
            met = np.concatenate([met, new])
        todo = np.flatnonzero((value >= least - SLACK) & ~expanded)
        while len(todo):  # range: everything near enough is expanded
            new = self._expand(todo, value, expanded, query)
            todo = new[value[new] >= least - SLACK]
        return np.flatnonzero(value >= least - 1e-4)

    def _expand(self, nodes: np.ndarray, value: np.ndarray, expanded: np.ndarray, query: np.ndarray) -> np.ndarray:
        expanded[nodes] = True
        new = np.unique(np.concatenate([self.graph[i] for i in nodes]))
        new = new[value[new] == -np.inf]
        if len(new):
            value[new] = self.vectors[new] @ query
        return new


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


@dataclass
class Block:
    """Members of a shard: ids, copies of each, the shards each is in, unit vectors and the graph (not needed to compare in full)."""

    ids: np.ndarray
    copies: np.ndarray
    shards: list[list[int]]
    unit: np.ndarray
    graph: list[np.ndarray] | None = None

    def members(self) -> np.ndarray:
        out = np.full((len(self.ids), max(map(len, self.shards))), -1, np.int64)
        for i, own in enumerate(self.shards):
            out[i, : len(own)] = own
        return out


def near_pairs(a: Block, b: Block, least: float, beam: int) -> np.ndarray:
    """Matrix of the pairs at ``least`` or more that a search of either side finds; all of them without graphs."""
    found = np.zeros((len(a.ids), len(b.ids)), bool)
    if a.graph is None:
        for start in range(0, len(a.ids), 512):
            found[start : start + 512] = a.unit[start : start + 512] @ b.unit.T >= least
    else:
        for asked, searched, view in [(a, b, found)] if a is b else [(a, b, found), (b, a, found.T)]:
            search = BlockSearch(searched.unit.astype(np.float32), searched.graph, beam)
            for q, vector in enumerate(asked.unit.astype(np.float32)):
                hits = search.near(vector, least)
                view[q, hits[searched.unit[hits] @ asked.unit[q] >= least]] = True
    if a is b:
        found |= found.T
        np.fill_diagonal(found, False)
    return found


def link_blocks(shard: int, a: Block, b: Block, least: float, beam: int = Effort.beam) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the members, the links of each that count in this shard, and the smallest id of each one's local component."""
    found = near_pairs(a, b, least, beam)
    member, same = b.members(), a is b
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    label, shift = np.arange(len(ids)), 0 if same else len(a.ids)
    counted = np.zeros_like(found)
    for q in np.flatnonzero(found.any(axis=1)).tolist():
        hits = np.flatnonzero(found[q])
        both = np.where(np.isin(member[hits], a.shards[q]) & (member[hits] >= 0), member[hits], np.iinfo(np.int64).max).min(axis=1)
        counted[q, hits] = both == shard
        joint = np.unique(label[np.append(hits + shift, q)])
        if len(joint) > 1:
            label[np.isin(label, joint)] = joint[0]
    links = counted @ b.copies
    if not same:
        links = np.concatenate([links, counted.T @ a.copies])
    least_id = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least_id, label, ids)
    return ids, links, least_id[label]


# --- the operator ----------------------------------------------------------------------------------------------------


def _centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    rng = np.random.default_rng(count)
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        full = np.linalg.norm(sums, axis=1) > 1e-9
        centres[full] = sums[full] / np.linalg.norm(sums[full], axis=1, keepdims=True)
    return centres.astype(np.float32)


def _placed(classes: DataFrame, overlap: int) -> DataFrame:
    """The classes with the clusters that each joins (``shards``): its ``overlap`` nearest centres and any nearly as near as the first."""
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    count = min(MAX_CENTRES, -(-largest // SHARD_ROWS))
    centres: dict[int, np.ndarray] = {}
    if count > 1 and overlap:
        sample = classes.orderBy(F.xxhash64("cid")).select("dim", "vec").limit(SAMPLE_ROWS).collect()  # bounded
        for dim in {r.dim for r in sample}:
            centres[dim] = _centres(unit_rows(np.array([r.vec for r in sample if r.dim == dim], np.float64)), count)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, HELD_PRODUCTS // max(1, count))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                dims = batch.column("dim").to_numpy(zero_copy_only=False)
                near: list[list[int]] = [[0]] * len(dims)
                for dim in np.unique(dims).tolist():
                    if dim in centres:
                        rows = np.flatnonzero(dims == dim)
                        products = unit_rows(_matrix(pa.chunked_array([batch.column("vec").take(pa.array(rows))]))).astype(np.float32) @ centres[dim].T
                        places = min(overlap, products.shape[1])
                        bound = np.minimum(-np.partition(-products, places - 1, axis=1)[:, places - 1], products.max(axis=1) - MARGIN * overlap / Effort.overlap)
                        for row, own in zip(rows.tolist(), products >= bound[:, None]):
                            near[row] = np.flatnonzero(own).tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int64()))], names=[*batch.schema.names, "shards"])

    kinds = dict(classes.dtypes)
    return classes.mapInArrow(assign, f"cid long, label {kinds['label']}, dim int, copies long, vec array<double>, shards array<long>")


def _link(classes: DataFrame, least: float, effort: Effort | None) -> DataFrame:
    """``classes``: cid, label, dim, copies, vec.  Returns cid, links (to other classes' vectors), root (smallest cid of a local component).

    Without ``effort`` all blocks of a label are compared in full.
    """
    rows = _placed(classes, effort.overlap if effort else 0).withColumn("shard", F.explode("shards"))
    rows = materialize(rows, "vector-rows")
    key = ["label", "dim", "shard"]
    sizes = rows.groupBy(*key).count().select(*key, F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts"))
    placed = materialize(rows.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")), "vector-shards")
    release(rows)
    if effort:
        pool, degree = effort.pool, effort.degree

        def build(table: pa.Table) -> pa.Table:
            ids = table.column("cid").to_numpy()
            graph = build_graph(unit_rows(_matrix(table.column("vec"))).astype(np.float32), pool, degree)
            return pa.table({"cid": ids, "near": pa.array([ids[g] for g in graph], pa.list_(pa.int64()))})

        graphs = placed.groupBy(*key, "part").applyInArrow(build, "cid long, near array<long>")
        placed = placed.join(graphs.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "cid")
    else:
        placed = placed.withColumn("near", F.lit(None).cast("array<long>"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("cid")
        low, high, part = table.column("low")[0].as_py(), table.column("high")[0].as_py(), table.column("part").to_numpy()

        def block(which: int) -> Block:
            own = table.filter(pa.array(part == which))
            ids, graph = own.column("cid").to_numpy(), None
            if effort:
                graph = []
                for near in own.column("near").to_pylist():
                    at = np.searchsorted(ids, near)
                    at = at[at < len(ids)]
                    graph.append(at[np.isin(ids[at], near)])
            return Block(ids, own.column("copies").to_numpy(), own.column("shards").to_pylist(), unit_rows(_matrix(own.column("vec"))) if len(ids) else np.empty((0, 1)), graph)

        first = block(low)
        second = first if low == high else block(high)
        if not len(first.ids) or not len(second.ids):
            return pa.table({"cid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        ids, links, roots = link_blocks(table.column("shard")[0].as_py(), first, second, least, effort.beam if effort else 0)
        return pa.table({"cid": ids, "links": links, "root": roots})

    return materialize(met.groupBy(*key, "low", "high").applyInArrow(search, "cid long, links long, root long"), "vector-links")


def audit(classes: DataFrame, found: DataFrame, least: float, rows: int) -> tuple[int, int]:
    """True links of the classes with the least hash (a bounded sample), by brute force over all rows, and how many of them were found."""
    sample = classes.orderBy(F.xxhash64("cid", F.lit(1))).select("cid", "label", "dim", "vec").limit(rows).collect()
    groups: dict = {}
    for r in sample:
        groups.setdefault((r.label, r.dim), []).append(r)
    asked = {k: (np.array([r.cid for r in v]), unit_rows(np.array([r.vec for r in v], np.float64))) for k, v in groups.items()}

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist()))
            ids, copies = batch.column("cid").to_numpy(), batch.column("copies").to_numpy()
            for key in set(keys) & set(asked):
                rows = np.array([i for i, k in enumerate(keys) if k == key])
                unit = unit_rows(_matrix(pa.chunked_array([batch.column("vec").take(pa.array(rows))])))
                cids, queries = asked[key]
                near = (queries @ unit.T >= least) & (cids[:, None] != ids[rows][None, :])
                for cid, n in zip(cids.tolist(), (near * copies[rows]).sum(axis=1).tolist()):
                    total[cid] = total.get(cid, 0) + n
        yield pa.RecordBatch.from_pydict({"cid": list(total), "n": list(total.values())}, schema=pa.schema([("cid", pa.int64()), ("n", pa.int64())]))

    if not sample:
        return 0, 0
    true = classes.mapInArrow(brute, "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n"))
    got = found.where(F.col("cid").isin([r.cid for r in sample])).groupBy("cid").agg(F.sum("links").alias("links"))
    row = true.join(got, "cid", "left").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("links", F.lit(0)))).alias("found")).first()
    return row.n or 0, row.found or 0


def audited_links(classes: DataFrame, least: float) -> tuple[DataFrame, int, int]:
    """The links of the first effort that reaches ``RECALL``, or of the full comparison, with the audit's figures."""
    for effort in EFFORTS:
        found = _link(classes, least, effort)
        true, seen = audit(classes, found, least, AUDIT_ROWS)
        if true < AUDIT_LINKS:
            true, seen = audit(classes, found, least, AUDIT_MOST)
        if seen >= RECALL * true:
            return found, true, seen
        release(found)
    found = _link(classes, least, None)
    return found, *audit(classes, found, least, AUDIT_MOST)


def near_duplicate_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, least: float = 0.93) -> DataFrame:
    """id, n_links, component_id, kept, audit_links (true links of the audited vectors) and audit_found (those of them that the search found)."""
    v = F.col("vec")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vec"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))) | ~F.exists(v, lambda x: x != 0) | (F.size(v) == 0)
    rows = rows.withColumn("usable", F.col("label").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    usable = rows.where("usable").withColumns({"h1": F.xxhash64(v), "h2": F.xxhash64(F.lit(7), v)})
    # Equal vectors, by 128 bits, are one class; its number is its place, not a hash.
    classes = usable.groupBy("label", "h1", "h2").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.first("vec").alias("vec"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "label", "h1", "h2", F.size("vec").cast("int").alias("dim"), "copies", "first_id", "vec"), "vector-classes")
    found, true, seen = audited_links(classes.select("cid", "label", "dim", "copies", "vec"), least)

    linked = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joint = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    placed = classes.select("cid", "label", "h1", "h2", "copies", "first_id").join(joint.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    per_class = placed.join(smallest, "component").join(linked, "cid", "left").select("label", "h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    with_links = usable.select("id", "label", "h1", "h2").join(per_class, ["label", "h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return with_links.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
        F.lit(true).cast("long").alias("audit_links"), F.lit(seen).cast("long").alias("audit_found"),
    )
