"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from the Gray-ordered SimHash index over several fingerprints a text, of two-word shingles, at a wide
radius; they are then compared by their whole shingle sets. An edited copy is near its original but not always near
another edited copy, so within a group of candidates the one nearest to the group's majority fingerprint is compared
with all others; then the same is done with those that it leaves, against the nearest of their own and the nearest of
those linked before, as long as a round links a fair share.

What fingerprints and rounds miss is found exactly, among texts that they did not connect: two sets of that similarity
share one of the first fifth of their shingles, in any order that is the same for all. The order is by hash, with
shingles that many texts hold at the end. Texts that share an early rare shingle are compared pair by pair. Texts that
reach their frequent shingles within the fifth are compared lot by lot; lots are skipped that lie too far apart, by
their distances to one text of the group, or that are connected already. No group is ever expanded to its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatt.llm.common import materialize, slices, whole_text
from tidewatt.llm.components import connected_components
from tidewatt.llm.repeats import text_key
from tidewatt.llm.simhash import BITS, forest, link_stars

WORDS, LIKENESS = 5, 0.8
#: Candidates: words of their shingles, fingerprints a text, and bits that may differ. A pair at the limit of 0.8 by
#: scattered edits differs in a tenth of the bits: it agrees on one of the 24 blocks with a probability of 0.99. Of
#: unrelated pairs that agree on a block, one in 30,000 is within the radius.
PAIR, SEEDS, RADIUS = 2, 6, 10
#: Rounds go on while one links at least this share of what is unlinked.
FAIR = 0.05
#: Frequent shingles: those of at least OFTEN texts of one in EVERY, MOST of them. They only decide an order, no result.
EVERY, OFTEN, MOST = 16, 3, 200_000
#: Shingles in a lot, but for the rest of its last text, and what a text counts for at least.
LOT, LEAST, SLAB = 1 << 16, 256, 8192
EPS = 1e-9
STEP, MIX1, MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words_each: int) -> np.ndarray:
    """64-bit hashes of the text's shingles of lower-case words, repeats included; fewer words are one shingle."""
    import xxhash

    words = text.encode().lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    n = max(len(h) - words_each + 1, min(len(h), 1))
    out = np.zeros(n, "u8")
    for i in range(min(words_each, len(h))):
        out = mixed(out * STEP + h[i : i + n])
    return out


def fingerprint_words(text: str) -> np.ndarray:
    """SEEDS fingerprints of 64 bits: a bit is 1 if it is set in over half of the shingles' hashes. No word: zeros."""
    h, out = shingles(text, PAIR), np.zeros(SEEDS, "u8")
    for seed in range(SEEDS):
        h = mixed(h + STEP)
        counts = np.zeros(BITS, "i8")
        for start in range(0, len(h), 65_536):
            counts += np.unpackbits(h[start : start + 65_536].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
        out[seed] = np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct numbers; of two empty ones 1."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0


def nodes_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, node, doc_id, fps) of each distinct text that has a row to itself: `node` is its smallest id.

    Of rows that repeat an id with other texts, the smallest hash of a text counts. A text that no row with an id has
    gets a number from its hash.
    """

    def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint_words(t).view("i8").tolist() for t in batch.column(3).to_pylist()]
            yield pa.record_batch([*batch.columns[:3], pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "k1", "k2", "fps"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).select("doc_id", *text_key(), "text")
    rows = materialize(rows.mapInArrow(marked, "doc_id long, k1 long, k2 long, fps array<long>"), "marks")
    own = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("k")).select("doc_id", "k.*")
    firsts = own.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"))
    texts = rows.groupBy("k1", "k2").agg(F.first("fps").alias("fps"), F.max(F.col("doc_id").isNull()).alias("nameless"))
    met = texts.join(firsts, ["k1", "k2"], "left").where("doc_id is not null or nameless")
    return materialize(met.select("k1", "k2", F.coalesce("doc_id", "k1").alias("node"), "doc_id", "fps"), "nodes")


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes whose fingerprints of one seed are near, as stars of each group; no group is expanded to pairs."""
    points = materialize(nodes.select("node", F.posexplode("fps").alias("seed", "fp")), "points")
    first = materialize(points.groupBy("seed", "fp").agg(F.min("node").alias("first")), "first")
    stars = link_stars(first.select("seed", "fp"), RADIUS)
    end = lambda c: first.select("seed", F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    near = stars.join(end("a"), ["seed", "a"]).join(end("b"), ["seed", "b"]).select("a_node", "b_node")
    same = points.join(first, ["seed", "fp"]).where("node <> first").select("node", "first")
    return near.union(same).toDF("a", "b").distinct()


def shingle_sets(docs: DataFrame, members: DataFrame, text_col: str) -> DataFrame:
    """(node, shingles): the sorted distinct shingle hashes of each member's text."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            sets = [np.unique(shingles(t, WORDS)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch({"node": batch.column(0), "shingles": pa.array(sets, pa.binary())})

    texts = docs.select(whole_text(text_col).alias("text")).select(*text_key(), "text")
    met = texts.join(members.select("k1", "k2", "node"), ["k1", "k2"]).select("node", "text")
    return materialize(met.mapInArrow(cut, "node long, shingles binary").dropDuplicates(["node"]), "shingles")


def likened(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, like): the edges (a, b) with the similarity of their shingle sets."""

    def alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            like = [likeness(np.frombuffer(x, "u8"), np.frombuffer(y, "u8")) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.record_batch([*batch.columns[:2], pa.array(like, pa.float64())], names=["a", "b", "like"])

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return edges.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(alike, "a long, b long, like double")


def verified(edges: DataFrame, sets: DataFrame, at_least: float) -> DataFrame:
    """The edges (a, b) whose shingle sets are alike."""
    return likened(edges, sets).where(F.col("like") >= at_least).select("a", "b")


def majority(live: DataFrame) -> DataFrame:
    """(root, centre): the bits that over half of a group's live members set."""
    bit = lambda i: F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))
    counts = live.groupBy("root").agg(F.count(F.lit(1)).alias("n"), *[F.sum(bit(i)).alias(f"b{i}") for i in range(BITS)])
    value = F.lit(0).cast("long")
    for i in range(BITS):
        value = value.bitwiseOR(F.when(F.col(f"b{i}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return counts.select("root", value.alias("centre"))


def near_copy_links(docs: DataFrame, nodes: DataFrame, text_col: str, at_least: float) -> DataFrame:
    """(a, b): links between nodes of `at_least` that likeness; their components are the groups of near copies."""
    roots = connected_components(candidates(nodes))
    grouped = roots.union(roots.select("root", "root").distinct()).select("node", F.col("root"))
    members = materialize(nodes.join(grouped, "node").select("k1", "k2", "node", "root", F.col("fps")[0].alias("fp"), "fps"), "members")
    sets = shingle_sets(docs, members, text_col)
    live, linked_before = members.select("node", "root", "fp"), members.select("node", "root", "fp").where("false")
    found = None
    while True:
        middle = materialize(majority(live), "middle")
        far = F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))).alias("far"), F.col("node").alias("node"))
        nearest = lambda some: some.join(middle, "root").groupBy("root").agg(F.min(far)["node"].alias("b"))
        own = materialize(nearest(live), "centres")
        centres = own.union(materialize(nearest(linked_before), "centres"))
        edges = live.join(centres, "root").where("node <> b").select(F.col("node").alias("a"), "b")
        linked = materialize(verified(edges, sets, at_least), "linked")
        found = linked if found is None else found.union(linked)
        linked_before = linked_before.union(live.join(linked.select(F.col("a").alias("node")), "node", "left_semi"))
        linked_before = materialize(linked_before.join(centres.select(F.col("b").alias("node")), "node", "left_anti"), "linked-before")
        done = linked.select("a").union(own.select("b")).distinct()
        before, more = live.count(), linked.count()
        live = materialize(live.join(done, F.col("node") == F.col("a"), "left_anti"), "live")
        if more < FAIR * before or live.isEmpty():
            break
    found = materialize(found, "found")
    return materialize(found.union(missed_links(docs, nodes, found, text_col, at_least)), "near-links")


def frequent(docs: DataFrame, text_col: str, every: int, often: int) -> np.ndarray:
    """Shingles that at least `often` of one in `every` distinct texts hold, ascending: MOST of them at most."""

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            sets = [np.unique(shingles(t, WORDS)) for t in batch.column(0).to_pylist()]
            yield pa.record_batch({"h": pa.array(np.concatenate(sets).view("i8"), pa.int64())})

    texts = docs.select(whole_text(text_col).alias("text")).select(*text_key(), "text")
    some = texts.where(F.pmod("k1", F.lit(every)) == 0).dropDuplicates(["k1", "k2"]).select("text")
    counts = some.mapInArrow(held, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)
    return np.sort(np.array([r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(MOST).collect()], "i8"))


def early(h: np.ndarray, late: np.ndarray, at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending distinct shingles, those among the first that a set of that similarity must share one of: the rare
    ones, and the frequent ones (`late`), which come after all rare ones."""
    first = len(h) - int(np.ceil(at_least * len(h) - EPS)) + 1
    is_late = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h if len(late) else np.zeros(len(h), bool)
    rare = h[~is_late][:first]
    return rare, h[is_late][: max(first - len(rare), 0)]


def prefixes(docs: DataFrame, nodes: DataFrame, text_col: str, at_least: float, late: np.ndarray) -> DataFrame:
    """(node, n, rare, hot, last) of each node: its number of distinct shingles, the early rare and frequent ones, and
    the last rare one up to which the early ones are all that the text has (the largest number if that is all)."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            sets = [np.unique(shingles(t, WORDS).view("i8")) for t in batch.column(2).to_pylist()]
            parts = [early(h, late, at_least) for h in sets]
            last = [(1 << 63) - 1 if len(hot) or not len(rare) else int(rare[-1]) for rare, hot in parts]
            cells = [pa.array([x.tolist() for x in p], pa.list_(pa.int64())) for p in zip(*parts)]
            yield pa.record_batch([*batch.columns[:2], pa.array([len(h) for h in sets], pa.int32()), *cells, pa.array(last, pa.int64())], names=["k1", "k2", "n", "rare", "hot", "last"])

    texts = docs.select(whole_text(text_col).alias("text")).select(*text_key(), "text")
    own = texts.mapInArrow(cut, "k1 long, k2 long, n int, rare array<long>, hot array<long>, last long").dropDuplicates(["k1", "k2"])
    return own.join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).drop("k1", "k2")


def rare_pairs(firsts: DataFrame, at_least: float) -> DataFrame:
    """(a, b): pairs of different components that share enough early rare shingles to be alike.

    Up to the smaller `last` of two texts all shared shingles are early ones of both, so the text with that `last` can
    share, besides them, its other shingles at most.
    """
    held = firsts.select("node", "comp", F.explode("rare").alias("h"))
    end = lambda c: held.select("h", F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    shared = end("a").join(end("b"), "h").where("a_comp < b_comp").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    of = lambda c: firsts.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), (F.col("n") - F.size("rare")).alias(f"{c}_rest"), F.col("last").alias(f"{c}_last"))
    met = shared.join(of("a"), "a").join(of("b"), "b")
    most = F.col("c") + F.when(F.col("a_last") < F.col("b_last"), F.col("a_rest")).when(F.col("a_last") > F.col("b_last"), F.col("b_rest")).otherwise(F.least("a_rest", "b_rest"))
    return met.where(F.least(most, "a_n", "b_n") * (1 + at_least) >= at_least * (F.col("a_n") + F.col("b_n")) - EPS).select("a", "b")


def hot_groups(firsts: DataFrame) -> DataFrame:
    """(node, grp): texts connected by early frequent shingles that texts of several components share."""
    held = firsts.select("node", "comp", F.explode("hot").alias("h"))
    open_ = held.groupBy("h").agg(F.min("node").alias("first"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("h", "first")
    roots = connected_components(held.join(open_, "h").select(F.col("node").alias("a"), F.col("first").alias("b")))
    return roots.union(roots.select("root", "root").distinct()).toDF("node", "grp")


def near_pairs(one: list[np.ndarray], two: list[np.ndarray], at_least: float) -> np.ndarray:
    """Matrix of which sets of the two lists are alike: products of their shingle incidences, a slab of shingles at a time."""
    sizes = [np.array([len(x) for x in some], "i8") for some in (one, two)]
    flat = [np.concatenate(some) for some in (one, two)]
    known = np.intersect1d(*flat)
    shared = np.zeros((len(one), len(two)), "f8")
    rows, places = [], []
    for some, n in zip(flat, sizes):
        at = np.searchsorted(known, some)
        hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == some) if len(known) else np.zeros(0, "i8")
        rows.append(np.repeat(np.arange(len(n)), n)[hit])
        places.append(at[hit])
    for start in range(0, len(known), SLAB):
        x, y = (np.zeros((len(n), min(SLAB, len(known) - start)), "f4") for n in sizes)
        for m, r, p in zip((x, y), rows, places):
            inside = (p >= start) & (p < start + SLAB)
            m[r[inside], p[inside] - start] = 1
        shared += x @ y.T
    return shared >= at_least * (sizes[0][:, None] + sizes[1][None, :] - shared) - EPS


def links_across(grouped: DataFrame, sets: DataFrame, found: DataFrame, at_least: float) -> DataFrame:
    """(a, b): links that connect what texts of a group connect that are alike and of different components.

    `grouped`: (node, grp, comp, n). A text's distance (1 - similarity) to the group's most linked text differs from
    that of a text like it by 1 - `at_least` at most, as these distances are a metric.
    """
    degrees = found.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("links"))
    rank = F.struct(F.coalesce("links", F.lit(0)).alias("links"), F.col("node").alias("node"))
    pivots = materialize(grouped.join(degrees, "node", "left").groupBy("grp").agg(F.max(rank)["node"].alias("b")), "pivots")
    like = likened(grouped.join(pivots, "grp").select(F.col("node").alias("a"), "b"), sets).select(F.col("a").alias("node"), (1 - F.col("like")).alias("far"))
    crowd = F.count(F.lit(1)).over(Window.partitionBy("grp", "comp"))
    placed = grouped.join(like, "node").withColumn("crowd", crowd)
    order = Window.partitionBy("grp").orderBy(F.col("crowd") == 1, F.when(F.col("crowd") > 1, F.col("comp")), "far", "node")
    weight = F.greatest(F.col("n"), F.lit(LEAST)).cast("long")
    before = F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)) - weight
    placed = materialize(placed.withColumn("lot", F.floor(before / LOT)).select("grp", "lot", "node", "comp", "far", "n"), "placed")
    span = [f(c).alias(f"{c}_{f.__name__}") for c in ("comp", "far", "n") for f in (F.min, F.max)]
    spans = placed.groupBy("grp", "lot").agg(*span)
    left, right = spans.alias("l"), spans.alias("r")
    reach = 1 - at_least + EPS
    close = f"l.far_min - r.far_max <= {reach} and r.far_min - l.far_max <= {reach}"
    sized = f"l.n_max >= {at_least} * r.n_min - {EPS} and r.n_max >= {at_least} * l.n_min - {EPS}"
    several = "least(l.comp_min, r.comp_min) < greatest(l.comp_max, r.comp_max)"
    pairs = left.join(right, F.expr(f"l.grp = r.grp and l.lot <= r.lot and {close} and {sized} and {several}")).select("l.grp", F.col("l.lot").alias("x"), F.col("r.lot").alias("y"))
    texts = placed.join(sets, "node").groupBy("grp", "lot").agg(F.collect_list(F.struct("node", "comp", "shingles")).alias("texts"))
    texts = materialize(texts, "lots")

    def across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            one, two = (column[0].as_py() for column in batch.columns)
            comps = [np.array([t["comp"] for t in some], "i8") for some in (one, two)]
            near = near_pairs(*([np.frombuffer(t["shingles"], "u8") for t in some] for some in (one, two)), at_least)
            i, j = np.nonzero(near & (comps[0][:, None] != comps[1][None, :]))
            ids = np.array([t["node"] for t in one + two], "i8")
            member, root = forest(len(ids), [(i, j + len(one))])
            yield pa.record_batch({"a": pa.array(ids[member], pa.int64()), "b": pa.array(ids[root], pa.int64())})

    side = lambda c: texts.select("grp", F.col("lot").alias(c), F.col("texts").alias(f"{c}_texts"))
    met = pairs.join(side("x"), ["grp", "x"]).join(side("y"), ["grp", "y"]).select("x_texts", "y_texts")
    return met.mapInArrow(across, "a long, b long").where("a <> b")


def missed_links(docs: DataFrame, nodes: DataFrame, found: DataFrame, text_col: str, at_least: float, every: int = EVERY, often: int = OFTEN) -> DataFrame:
    """(a, b): links of `at_least` that likeness which, with the links `found`, connect all that such links connect."""
    late = frequent(docs, text_col, every, often)
    comps = connected_components(found).select("node", F.col("root").alias("comp"))
    firsts = prefixes(docs, nodes, text_col, at_least, late).join(comps, "node", "left")
    firsts = materialize(firsts.withColumn("comp", F.coalesce("comp", "node")), "prefixes")
    pairs = materialize(rare_pairs(firsts, at_least), "rare-pairs")
    groups = materialize(hot_groups(firsts).join(firsts.select("node", "comp", "n"), "node"), "hot-groups")
    met = pairs.select("a").union(pairs.select("b")).union(groups.select("node")).toDF("node").distinct()
    sets = shingle_sets(docs, nodes.join(met, "node", "left_semi"), text_col)
    wordless = firsts.where("n = 0").select(F.col("node").alias("a"))
    wordless = wordless.crossJoin(wordless.agg(F.min("a").alias("b"))).where("a <> b")
    return verified(pairs, sets, at_least).union(links_across(groups, sets, found, at_least)).union(wordless)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = LIKENESS) -> DataFrame:
    """`docs` with one row of each group of near copies, the one with the smallest id; all columns stay.

    Groups are chains of links. Null and empty texts are one text. Rows that repeat an id count once; a group without
    any id keeps one row. Extra columns may have any name. An empty table gives no row. Texts travel twice: those of
    candidates to be compared, those that stay to the result. Each step's shuffle files go once its table is written.
    """
    docs.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    nodes = nodes_of(docs, id_col, text_col)
    gone = connected_components(near_copy_links(docs, nodes, text_col, at_least)).select("node")
    kept = nodes.join(gone, "node", "left_anti").select("doc_id", "k1", "k2").toDF("_id", "_k1", "_k2")
    k1, k2 = text_key()
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].cast("long").alias("_i"), whole_text(text_col).alias("text"))
    row = row.select("_row", "_i", k1.alias("_1"), k2.alias("_2"))
    met = row.join(kept, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_1") == F.col("_k1")) & (F.col("_2") == F.col("_k2")), "left_semi")
    return met.dropDuplicates(["_i", "_1", "_2"]).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
