"""Mixing sources to target weights by a low-discrepancy schedule.

Slots 0, 1, 2, ... take golden-ratio points, which fall evenly into the sources' shares of the unit interval at any
length of the schedule. The k-th slot of a source takes the k-th block of its shuffled documents, cut into blocks of
equal numbers of words; after its last block a source starts over. A slot past a source's target takes nothing, the
one at the target takes the rest of it. Points are whole numbers in 2^30, so every engine gets the same schedule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatt.llm.common import WORD, materialize, whole_text

#: The odd number next to 2^30 / golden ratio: k * STEP mod 2^30 visits every point once in 2^30 slots.
STEP, POINTS = 663_608_941, 1 << 30
CELLS = 4096


@dataclass(frozen=True)
class Mix:
    """Tables of a mix, all keyed by `source_key` ('s' and the source, or 'n' for null)."""

    sources: DataFrame  # source_key, source, source_size, weight, target, need, blocks
    documents: DataFrame  # source_key, doc_id, size, start: where its words lie in the shuffled source
    slots: DataFrame  # slot, source_key, epoch, block, words
    block_words: int


def source_key(name: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(name).cast("string")), F.lit("n"))


def share_out(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds weight and target to (source_key, source, source_size): `share` times all words, dealt by weight, none above
    `cap` times its source, the excess dealt again. One row a source: the windows over all of them are small.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn("weight", F.element_at(pattern, (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int")))
    # Sources fill up in the order of limit / weight; before each, what the full ones leave to the others.
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "source_key")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    limit = F.col("source_size") * F.lit(float(cap))
    levels = weighed.select(
        "*",
        limit.alias("limit"),
        F.row_number().over(by_ratio).alias("nth"),
        ((F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
    ).withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    last = F.min(F.when(~F.col("full"), F.struct("nth", "level"))).over(everything)["level"]
    return levels.select("source_key", "source", "source_size", "weight", F.when(F.col("full"), F.col("limit")).otherwise(F.least(F.col("limit"), last * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = 1024, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> Mix:
    """Sizes, targets and the schedule. A null text has 0 words; a null source is a source, the last; documents are
    shuffled by a hash of their id (a null id: of nothing), equal ids lie together in order of size. An empty table or
    one without words gives targets and a schedule of nothing.

    Hot sources are split: running totals go through 4096 hash ranges of each source, slot ranks through runs of
    4096 slots, and blocks are joined on (source, block).
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("h"),
    ).withColumn("source_key", source_key())
    sized = materialize(sized.withColumn("bucket", F.substring("h", 1, 3)), "sizes")
    sources = share_out(sized.groupBy("source_key", "source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    blocks, rest = F.ceil(F.col("source_size") / block_words), F.col("need") % F.greatest("source_size", F.lit(1))
    sources = sources.withColumn("need", F.floor("target").cast("long")).withColumn("blocks", blocks.cast("long"))
    sources = sources.withColumn("n", F.expr("need div greatest(source_size, 1)") * F.col("blocks") + F.ceil(rest / block_words))
    sources = materialize(sources.withColumn("block_words", F.lit(block_words)), "sources")

    totals = sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("in_bucket"))
    bases = totals.select("source_key", "bucket", (F.sum("in_bucket").over(Window.partitionBy("source_key").orderBy("bucket")) - F.col("in_bucket")).alias("base"))
    running = F.sum("size").over(Window.partitionBy("source_key", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    within = sized.select("source_key", "bucket", "doc_id", "size", (running - F.col("size")).alias("within"))
    documents = within.join(bases, ["source_key", "bucket"]).select("source_key", "doc_id", "size", (F.col("base") + F.col("within")).alias("start"))
    return Mix(sources, documents, schedule(sources), block_words)


def edge(cum: Column, total: int) -> Column:
    """The place among the POINTS of `cum` slots out of `total`; in decimals, as the product passes 64 bits."""
    scaled = cum.cast("decimal(19,0)") * F.lit(POINTS).cast("decimal(11,0)")
    return F.floor(scaled / F.lit(max(total, 1)).cast("decimal(19,0)")).cast("long")


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, source_key, epoch, block, words) of the slots that take words."""
    spark = sources.sparkSession
    wanted, kinds = sources.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # Room for the points' unevenness: a source gets at least its share less this many slots.
    slack = 8 + int(2.1 * (wanted + 1).bit_length())
    total = int(wanted) + kinds * slack
    upto = F.sum(F.col("n") + slack).over(Window.orderBy("source_key"))
    shares = sources.withColumn("lo", edge(upto - F.col("n") - slack, total)).withColumn("hi", edge(upto, total))
    width = POINTS // CELLS
    cells = shares.where("hi > lo").select("*", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("cell"))

    points = spark.range(total if wanted else 0).select(F.col("id").alias("slot"), (F.col("id") % POINTS * STEP % POINTS).alias("point"))
    placed = points.withColumn("cell", F.expr(f"point div {width}")).join(cells, "cell").where("lo <= point and point < hi")
    placed = placed.withColumn("run", F.expr("slot div 4096"))
    counts = placed.groupBy("source_key", "run").agg(F.count(F.lit(1)).alias("in_run"))
    bases = counts.select("source_key", "run", (F.sum("in_run").over(Window.partitionBy("source_key").orderBy("run")) - F.col("in_run")).alias("base"))
    nth = F.row_number().over(Window.partitionBy("source_key", "run").orderBy("slot")) - 1
    ranked = placed.withColumn("nth", nth).join(bases, ["source_key", "run"]).withColumn("rank", F.col("base") + F.col("nth")).where("rank < n")
    taken = ranked.withColumn("epoch", F.expr("rank div blocks")).withColumn("block", F.col("rank") % F.col("blocks"))
    whole = F.least(F.lit(1) * F.col("block_words"), F.col("source_size") - F.col("block") * F.col("block_words"))
    words = F.least(whole, F.col("need") - F.col("epoch") * F.col("source_size") - F.col("block") * F.col("block_words"))
    return taken.select("slot", "source_key", "epoch", "block", words.alias("words")).where("words > 0")


def taken(mixed: Mix) -> DataFrame:
    """(source_key, doc_id, size, start, epoch, taken) of every document and epoch in which the mix takes words of it;
    a document without any has one row with epoch null and taken 0.
    """
    step = mixed.block_words
    span = F.when(F.col("size") > 0, F.expr(f"sequence(start div {step}, (start + size - 1) div {step})"))
    pieces = mixed.documents.select("*", F.explode_outer(span).alias("block"))
    met = pieces.join(mixed.slots, ["source_key", "block"], "left")
    begin, end = F.greatest("start", F.col("block") * step), F.least(F.col("start") + F.col("size"), F.col("block") * step + F.coalesce("words", F.lit(0)))
    amount = F.coalesce(F.greatest(end - begin, F.lit(0)), F.lit(0))
    return met.groupBy("source_key", "doc_id", "size", "start", "epoch").agg(F.sum(amount).cast("long").alias("taken"))


def mixed_documents(mixed: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; repeated rows lie one behind the other and stay."""
    parts = taken(mixed).groupBy("source_key", "doc_id", "size", "start").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("parts"))
    # Empty documents share their start: one row each, as many as there were.
    empties = mixed.documents.where("size = 0").select("source_key", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    rows = parts.where("size > 0").select("source_key", "doc_id", "size", "taken").union(empties)
    return rows.join(mixed.sources.select("source_key", "source_size", "target"), "source_key").select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, mixed: Mix, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: rows of `docs` with all their columns, once for each epoch that takes words of them.

    A document taken in part keeps its first words, joined by single spaces. A document without a word has nothing to
    weigh and stays once. Rows are matched by (id, source, number of words): rows alike in all three count as one.
    """
    epochs = taken(mixed).groupBy("source_key", "doc_id", "size", "epoch").agg(F.max("taken").alias("_taken")).where("_taken > 0 or size = 0")
    keyed = docs.withColumns({"_key": source_key(source_col), "_words": F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")})
    on = keyed["_key"].eqNullSafe(epochs["source_key"]) & keyed[id_col].cast("long").eqNullSafe(epochs["doc_id"]) & (keyed["_words"] == epochs["size"])
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.col("_taken").cast("int")), " ")
    text = F.when(F.col("_taken") < F.col("_words"), part).otherwise(F.col(text_col))
    names = [keyed[c] for c in docs.columns if c != text_col]
    return keyed.join(epochs, on).select(*names, text.alias(text_col)).select(*docs.columns)
