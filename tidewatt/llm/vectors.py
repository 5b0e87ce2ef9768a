"""Embedding near-duplicates by a robust-pruned flat graph.

Distinct vectors go to their nearest clusters, two each, so the shards overlap; clusters are split so that no shard is
large. In a shard every vector gets a pruned list of neighbours: of two candidates in about one direction the nearer
one stays. The lists of one vector from all its shards are united. Every vector then searches the shards of the
clusters nearest to it: greedy from the shard's medoid with a beam, then on from every vector in range until no new
one appears. What it meets is verified by cosine in double precision. A brute-force audit of some vectors measures
recall; while that is too low, the search is run again over twice as many clusters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatt.llm.common import materialize, slices
from tidewatt.llm.components import connected_components
from tidewatt.llm.simhash import forest

SAMPLE = 20_000  # vectors that the cluster centres are fitted on
MOST_CENTRES = 2_000
SHARD, ASKED = 2_048, 8_192  # members of a shard, queries at once against it
OVERLAP, DEGREE, POOL, ALPHA = 2, 24, 64, 1.2
BEAM, AT_ONCE = 32, 512


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def points_of(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(vec_id, bytes) of every row and the greatest number of components. `bytes`: the vector as doubles, null if it
    can't have a cosine. Shorter vectors are compared as if they ended in zeros."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.zeros(max(width, 1))
                if v and None not in v:
                    x[: len(v)] = v
                    top = np.abs(x).max()
                    x = x / top if np.isfinite(top) and top else x * np.nan
                out.append((x + 0.0).tobytes() if v and None not in v and np.isfinite(x).all() else None)
            yield pa.record_batch({"vec_id": batch.column(0), "bytes": pa.array(out, pa.binary())})

    return rows.mapInArrow(packed, "vec_id long, bytes binary"), width


def fit_centres(points: DataFrame, n: int, width: int) -> np.ndarray:
    """Unit cluster centres from a bounded sample by hash: about SHARD / 2 vectors each, MOST_CENTRES at most."""
    sample = points.orderBy(F.xxhash64("bytes")).limit(SAMPLE).select("bytes").collect()
    x = unit(np.frombuffer(b"".join(r[0] for r in sample), "f8").reshape(-1, width))
    k = int(min(MOST_CENTRES, max(1, 2 * OVERLAP * n // SHARD), len(x)))
    centres = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(6):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norm = np.linalg.norm(sums, axis=1)
        centres[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centres


def prune(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbour lists of a shard's unit vectors, every vector reachable from the medoid (place 0 of the
    last list, which holds it alone)."""
    n = len(x)
    medoid = int((x @ x.sum(axis=0)).argmax())
    if n == 1:
        return [np.zeros(0, "i8"), np.array([medoid])]
    sims = (x @ x.T).astype("f4")
    np.fill_diagonal(sims, -2)
    pool = min(POOL, n - 1)
    near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
    far = np.random.default_rng(n).integers(0, n, (n, min(16, n)))
    cand = np.concatenate([near, far, np.full((n, 1), medoid)], axis=1)
    own = np.take_along_axis(sims, cand, axis=1)
    own[cand == np.arange(n)[:, None]] = -3
    lists, rows = np.full((n, DEGREE), -1), np.arange(n)
    for r in range(DEGREE):
        best = own.argmax(axis=1)
        open_ = own[rows, best] > -3
        pick = cand[rows, best]
        lists[open_, r] = pick[open_]
        # A candidate goes if it lies nearer to the pick, by the factor, than to the vector itself.
        between = sims[pick[:, None], cand]
        gone = (ALPHA * np.sqrt(np.maximum(2 - 2 * between, 0)) <= np.sqrt(np.maximum(2 - 2 * own, 0))) | (cand == pick[:, None])
        own[gone] = -3
        if not (own > -3).any():
            break
    out = [set(row[row >= 0].tolist()) for row in lists]
    for a in range(n):  # both directions: who is near must be reachable
        for b in lists[a][lists[a] >= 0][:8].tolist():
            out[b].add(a)
    seen, front = np.zeros(n, bool), [medoid]
    seen[medoid] = True
    while True:
        while front:
            front = list({b for a in front for b in out[a] if not seen[b]})
            seen[front] = True
        lost = np.flatnonzero(~seen)
        if not len(lost):
            break
        reached = np.flatnonzero(seen)
        a = int(lost[sims[np.ix_(lost, reached)].max(axis=1).argmax()])
        out[int(reached[sims[a, reached].argmax()])].add(a)
        seen[a], front = True, [a]
    return [np.array(sorted(s), "i8") for s in out] + [np.array([medoid])]


def search(x: np.ndarray, lists: list[np.ndarray], medoid: int, asked: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, member) pairs with cosine >= least that greedy, then range-expanding search meets.

    `x`, `asked`: unit vectors in double precision. Pairs are verified in double precision.
    """
    width = max(map(len, lists), default=0)
    table = np.full((len(x), max(width, 1)), -1)
    for i, own in enumerate(lists):
        table[i, : len(own)] = own
    small = x.astype("f4")
    for start in range(0, len(asked), AT_ONCE):
        q = asked[start : start + AT_ONCE]
        q4, n = q.astype("f4"), len(q)
        sims = np.full((n, len(x)), -np.inf, "f4")
        seen, done = np.zeros((n, len(x)), bool), np.zeros((n, len(x)), bool)
        beam = np.full((n, BEAM), -np.inf, "f4")
        sims[:, medoid], seen[:, medoid] = q4 @ small[medoid], True
        beam[:, 0] = sims[:, medoid]
        while True:
            waiting = np.where(done, -np.inf, sims)
            best = waiting.argmax(axis=1)
            value = waiting[np.arange(n), best]
            rows = np.flatnonzero((value >= beam.min(axis=1)) & (value > -np.inf))
            # In range every vector is expanded, at once, however many there are.
            wide = np.nonzero(waiting >= least - 1e-3)
            rows, nodes = np.concatenate([rows, wide[0]]), np.concatenate([best[rows], wide[1]])
            if not len(rows):
                break
            done[rows, nodes] = True
            for lot in range(0, len(rows), 4096):
                r = np.repeat(rows[lot : lot + 4096], table.shape[1])
                m = table[nodes[lot : lot + 4096]].reshape(-1)
                fresh = m >= 0
                r, m = r[fresh], m[fresh]
                fresh = ~seen[r, m]
                key = np.unique(r[fresh] * len(x) + m[fresh])
                r, m = key // len(x), key % len(x)
                seen[r, m] = True
                sims[r, m] = np.einsum("ij,ij->i", q4[r], small[m])
                if len(r):
                    at = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1, [len(r)]])
                    for a, b in zip(at[:-1], at[1:]):
                        own = np.concatenate([beam[r[a]], sims[r[a], m[a:b]]])
                        beam[r[a]] = np.partition(own, len(own) - BEAM)[-BEAM:]
        a, b = np.nonzero(sims >= least - 1e-3)
        for lot in range(0, len(a), 100_000):
            r, m = a[lot : lot + 100_000], b[lot : lot + 100_000]
            true = np.einsum("ij,ij->i", q[r], x[m]) >= least
            yield r[true] + start, m[true]


@dataclass(frozen=True)
class VectorLinks:
    points: DataFrame  # pid, bytes, first_id, copies
    links: DataFrame  # pid, others: vectors of other points linked to it, copies counted
    stars: DataFrame  # a, b: links that connect what all links connect
    recall: float
    probes: int


def _assigned(points: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(pid, bytes, copies, clusters): the nearest clusters, nearest first."""
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in slices(batches, 2048):
            x = unit(np.frombuffer(b"".join(batch.column(1).to_pylist()), "f8").reshape(-1, c.shape[1]))
            nearest = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
            yield pa.record_batch({"pid": batch.column(0), "bytes": batch.column(1), "copies": batch.column(2), "clusters": pa.array(nearest.tolist(), pa.list_(pa.int32()))})

    return points.select("pid", "bytes", "copies").mapInArrow(near, "pid long, bytes binary, copies long, clusters array<int>")


def link_vectors(df: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", probes: int = 4, enough: float = 0.97) -> tuple[DataFrame, VectorLinks]:
    """(rows with their bytes, links between distinct vectors). Copies are one point with a count."""
    spark = df.sparkSession
    rows, width = points_of(df, id_col, vec_col)
    rows = materialize(rows, "rows")
    points = rows.where("bytes is not null").groupBy("bytes").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    points = materialize(points.withColumn("pid", F.monotonically_increasing_id()), "points")
    n = points.count()
    if not n:
        nothing = spark.createDataFrame([], "pid long, others long")
        return rows, VectorLinks(points, nothing, spark.createDataFrame([], "a long, b long"), 1.0, 0)
    centres = fit_centres(points, n, width)
    probes = min(max(probes, OVERLAP), len(centres))
    while True:
        found = _linked(points, centres, probes, least, width)
        links = found.where("b is null").groupBy(F.col("a").alias("pid")).agg(F.sum("others").alias("others"))
        recall = audit_recall(points, links, least, width)
        if recall >= enough or probes == len(centres):
            return rows, VectorLinks(points, links, found.where("b is not null").select("a", "b"), recall, probes)
        probes = min(2 * probes, len(centres))


def _linked(points: DataFrame, centres: np.ndarray, probes: int, least: float, width: int) -> DataFrame:
    """(a, b, others): stars with b, counts of links without."""
    spark = points.sparkSession
    assigned = materialize(_assigned(points, centres, probes), "assigned")
    members = assigned.select("pid", "bytes", "copies", F.posexplode(F.slice("clusters", 1, min(OVERLAP, probes))).alias("nth", "cluster"))
    asked = assigned.select("pid", "bytes", "copies", F.explode("clusters").alias("cluster"))
    # How many shards a cluster has, and how many lots its queries come in: one row a cluster, MOST_CENTRES at most.
    sizes = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    lots = asked.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("lots"))
    shape = F.broadcast(materialize(sizes.join(lots, "cluster"), "shape"))
    spread = F.xxhash64("pid")
    members = members.join(shape, "cluster").withColumn("shard", F.pmod(spread, F.col("shards")).cast("int"))

    def build(pdf):
        import pandas as pd

        *lists, (medoid,) = prune(unit(np.frombuffer(b"".join(pdf["bytes"]), "f8").reshape(-1, width)))
        pid = pdf["pid"].to_numpy()
        return pd.DataFrame({"pid": pid, "near": [pid[x].tolist() for x in lists], "medoid": [pid[medoid]] * len(pid), "cluster": pdf["cluster"], "shard": pdf["shard"]})

    built = members.select("pid", "bytes", "cluster", "shard").groupBy("cluster", "shard").applyInPandas(build, "pid long, near array<long>, medoid long, cluster int, shard int")
    built = materialize(built, "graph")
    united = built.groupBy("pid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # OVERLAP lists at most
    medoids = built.select("cluster", "shard", "pid", (F.col("pid") == F.col("medoid")).alias("is_medoid"))
    graph = members.join(medoids, ["cluster", "shard", "pid"]).join(united, "pid")
    side = graph.select("cluster", "shard", F.explode(F.expr("sequence(0, lots - 1)")).alias("lot"), F.lit(False).alias("asks"), "pid", "bytes", "copies", (F.col("nth") == 0).alias("home"), "is_medoid", "near")
    no_list = F.array().cast("array<long>")
    asks = asked.join(shape, "cluster").select("cluster", F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"), F.pmod(F.xxhash64("pid", F.lit(1)), F.col("lots")).cast("int").alias("lot"), F.lit(True).alias("asks"), "pid", "bytes", "copies", F.lit(False).alias("home"), F.lit(False).alias("is_medoid"), no_list.alias("near"))

    def searched(pdf):
        import pandas as pd

        own, q = pdf[~pdf["asks"]].reset_index(drop=True), pdf[pdf["asks"]].reset_index(drop=True)
        if own.empty or q.empty:
            return pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="Int64"), "others": pd.Series([], dtype="Int64")})
        x, y = (unit(np.frombuffer(b"".join(p["bytes"]), "f8").reshape(-1, width)) for p in (own, q))
        place = {p: i for i, p in enumerate(own["pid"])}
        lists = [np.array([place[p] for p in near if p in place], "i8") for near in own["near"]]
        mid = np.flatnonzero(own["is_medoid"])
        home, copies = own["home"].to_numpy(), own["copies"].to_numpy()
        own_pid, q_pid = own["pid"].to_numpy(), q["pid"].to_numpy()
        every = np.unique(np.concatenate([own_pid, q_pid]))
        to_own, to_q = np.searchsorted(every, own_pid), np.searchsorted(every, q_pid)
        others = np.zeros(len(q), "i8")

        def links():
            for r, m in search(x, lists, int(mid[0]), y, least):
                apart = q_pid[r] != own_pid[m]
                r, m = r[apart], m[apart]
                np.add.at(others, r, np.where(home[m], copies[m], 0))
                yield to_q[r], to_own[m]

        member, root = forest(len(every), links())
        some = np.flatnonzero(others)
        return pd.DataFrame({"a": np.concatenate([every[member], q_pid[some]]), "b": pd.array([*every[root].tolist(), *[None] * len(some)], dtype="Int64"), "others": pd.array([*[None] * len(member), *others[some].tolist()], dtype="Int64")})

    met = side.union(asks).groupBy("cluster", "shard", "lot").applyInPandas(searched, "a long, b long, others long")
    return materialize(met, "met")


def audit_recall(points: DataFrame, links: DataFrame, least: float, width: int, audited: int = 200) -> float:
    """Share of the links of `audited` vectors, picked by hash, that the search has found. Brute force, in blocks."""
    own = points.orderBy(F.xxhash64("bytes", F.lit(2))).limit(audited).select("pid", "bytes").collect()
    q = unit(np.frombuffer(b"".join(r["bytes"] for r in own), "f8").reshape(-1, width))
    pids = np.array([r["pid"] for r in own])
    shared = points.sparkSession.sparkContext.broadcast((q, pids))

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, pids = shared.value
        total = np.zeros(len(q), "i8")
        for batch in slices(batches, 4096):
            x = unit(np.frombuffer(b"".join(batch.column(1).to_pylist()), "f8").reshape(-1, width))
            hit = (q @ x.T >= least) & (pids[:, None] != batch.column(0).to_numpy()[None, :])
            total += hit @ batch.column(2).to_numpy()
        yield pa.record_batch({"pid": pa.array(pids), "true_others": pa.array(total)})

    true = points.select("pid", "bytes", "copies").mapInArrow(counted, "pid long, true_others long").groupBy("pid").agg(F.sum("true_others").alias("true_others"))
    both = true.join(links, "pid", "left").agg(F.sum("true_others"), F.sum(F.least("true_others", F.coalesce("others", F.lit(0))))).first()
    return 1.0 if not both[0] else both[1] / both[0]


def near_duplicates(df: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept. Rows
    without an id take part; a component without any id has a null component_id. Repeated rows are copies: linked.
    An empty table gives no row. Only the two named columns are read.
    """
    rows, found = link_vectors(df, least, id_col, vec_col)
    roots = connected_components(found.stars)
    labelled = found.points.join(roots, found.points.pid == roots.node, "left").withColumn("root", F.coalesce("root", "pid")).drop("node")
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(smallest, "root").join(found.links, "pid", "left").select("bytes", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id")
    out = rows.where("bytes is not null").join(named, "bytes").select("vec_id", F.col("n").alias("n_links"), "component_id")
    alone = rows.where("bytes is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
