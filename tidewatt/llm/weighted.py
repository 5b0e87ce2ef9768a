"""Document fingerprints by consistent weighted sampling, in DataFrame operations alone.

A text is its words with their counts as weights. For slot k every word draws, from a hash of word and slot, two
Gamma(2, 1) numbers r, c and a uniform b; with weight w it scores ln c - r (floor(ln w / r + b) - b + 1), and the lowest
score of the text is the slot's sample. Two texts agree in a slot with the probability of their generalised Jaccard
similarity, sum of min(w) over sum of max(w); the share of slots that agree estimates it.

The draws come from the bits of two 64-bit hashes a word and slot: a gamma is -ln(u1 u2) of two uniforms, so its tails,
where the lowest score of a long text lies, are as fine as its middle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatt.llm.common import materialize, whole_text

SLOTS = 64
SPACE = "[\\x20\\x09-\\x0D]+"
BUCKETS = 256
LOWEST = -(1 << 63)


def uniform(h: Column, shift: int, bits: int) -> Column:
    """A number within (0, 1), never 0 or 1, from `bits` bits of a hash."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) * F.lit(0.5**bits)


def slot_minimum(k: int) -> Column:
    """The lowest score of slot k."""
    rate, shape = F.xxhash64("h", F.lit(2 * k)), F.xxhash64("h", F.lit(2 * k + 1))
    r = -F.ln(uniform(rate, 0, 21) * uniform(rate, 21, 21))
    ln_c = F.ln(-F.ln(uniform(shape, 0, 32) * uniform(shape, 32, 32)))
    b = uniform(rate, 42, 22)
    return F.min(ln_c - r * (F.floor(F.col("ln_w") / r + b) - b + 1)).alias(f"m{k}")


def signatures(words: DataFrame, keys: list[str], weights: list[str], slots: int = SLOTS) -> DataFrame:
    """keys, s0, s1: an array of `slots` ints for each of two weight columns, -1 everywhere where a side has no word.

    `words`: (keys, h, weights), one row a word of a text, weight 0 where the text lacks it; a word's rows are summed.
    A word counts in part 0 if both sides have it with one weight, else in part 1, part 2 or both; each part is scored
    once, and a side's sample is the lower one of part 0 and its own. Partitioned by `keys`, nothing is shuffled.
    """
    counted = words.groupBy(*keys, "h").agg(*[F.sum(w).alias(w) for w in weights])
    o, e = (F.col(w) for w in weights)
    share = lambda part, w: F.struct(F.lit(part).alias("part"), w.alias("w"))
    parts = F.when(o == e, F.array(share(0, o))).when(e == 0, F.array(share(1, o))).when(o == 0, F.array(share(2, e)))
    rows = counted.select(*keys, "h", F.explode(parts.otherwise(F.array(share(1, o), share(2, e)))).alias("s"))
    logs = rows.select(*keys, "h", F.col("s.part").alias("part"), F.ln("s.w").alias("ln_w"))
    lowest = logs.groupBy(*keys, "part").agg(*[slot_minimum(k) for k in range(slots)])
    packed = lowest.select(*keys, "part", F.array(*[f"m{k}" for k in range(slots)]).alias("m"))
    side = [F.max(F.when(F.col("part") == i, F.col("m"))).alias(f"m{i}") for i in range(3)]
    met = packed.groupBy(*keys).agg(*side)
    # `least` skips nulls: a part that a text lacks leaves the other.
    both = lambda i: F.when(F.col("m0").isNull(), F.col(f"m{i}")).when(F.col(f"m{i}").isNull(), F.col("m0")).otherwise(F.zip_with("m0", f"m{i}", lambda x, y: F.least(x, y)))
    sample = lambda m, k: F.xxhash64(k.cast("int"), m).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    none = F.array(*[F.lit(-1)] * slots)
    return met.select(*keys, *[F.coalesce(F.transform(both(i), sample), none).alias(f"s{i - 1}") for i in (1, 2)])


def likeness(a: Column, b: Column) -> Column:
    """Share of the slots in which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def next_documents(order: DataFrame) -> DataFrame:
    """(id, key) with `next`, the (id, key) after it in descending order of id, the first after the last.

    Ids are dealt into ranges by quantiles; a window orders each range, and a table of one row a range (BUCKETS + 1 at
    most, so it is broadcast) links the last row of a range to the first of the next.
    """
    cuts = order.agg(F.percentile_approx("id", [i / BUCKETS for i in range(1, BUCKETS)], 10_000)).first()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>"), lambda c: c < F.col("id")))
    placed = order.withColumn("bucket", bucket)
    within = Window.partitionBy("bucket").orderBy(F.desc("id"), F.desc("key"))
    me = F.struct("id", "key")
    ranked = placed.select("*", F.lead(me).over(within).alias("after"), F.row_number().over(within).alias("nth"))
    heads = placed.groupBy("bucket").agg(F.max(me).alias("head"))
    down = Window.orderBy(F.desc("bucket"))
    follow = heads.select("bucket", F.coalesce(F.lead("head").over(down), F.first("head").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("wrapped"))
    return ranked.join(F.broadcast(follow), "bucket").select("id", "key", F.coalesce("after", "wrapped").alias("next"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A text's edit has its last floor(n_chars / 2) characters replaced by the first as many (or all) of the next
    document's, in descending order of id; equal ids go by a hash of the text, null ids come last, and rows alike in id
    and text are one document in that order. A null text is the empty text; texts without a word have one fingerprint
    of their own. A document alone is its own next. An empty table gives no row. Only the two named columns are read.
    """
    read = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("id"), whole_text(text_col).alias("text"))
    read = read.withColumn("key", F.xxhash64("text"))
    order = materialize(read.groupBy("id", "key").agg(F.max(F.char_length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("rows")), "order")
    follow = materialize(order.join(next_documents(order.select("id", "key")), ["id", "key"]), "next")

    texts = read.groupBy("id", "key").agg(F.max("text").alias("text"))  # one of each row that repeats
    half = F.expr("n_chars div 2").cast("int")
    given = follow.select(F.col("id").alias("to_id"), F.col("key").alias("to_key"), half.alias("half"), F.col("next.id").alias("id"), F.col("next.key").alias("key"))
    tails = texts.join(given, ["id", "key"]).select(F.col("to_id").alias("id"), F.col("to_key").alias("key"), F.expr("substring(text, 1, half)").alias("tail"))
    front = F.expr("substring(text, 1, char_length(text) - char_length(text) div 2)")
    met = texts.join(tails, ["id", "key"]).select("id", "key", "text", F.concat(front, "tail").alias("edited"), front.alias("front"))
    # Up to the last white space in front of the edit both texts have the same words: those are split once.
    same = F.char_length(F.regexp_extract("front", "(?s)^.*[\\x20\\x09-\\x0D]", 0))
    cut = met.select("id", "key", "text", "edited", same.alias("same"))
    split = lambda part: F.split(F.expr(part), SPACE)
    parts = F.array(
        F.struct(F.lit(1).alias("o"), F.lit(1).alias("e"), split("substring(text, 1, same)").alias("words")),
        F.struct(F.lit(1).alias("o"), F.lit(0).alias("e"), split("substring(text, same + 1)").alias("words")),
        F.struct(F.lit(0).alias("o"), F.lit(1).alias("e"), split("substring(edited, same + 1)").alias("words")),
    )
    words = cut.select("id", "key", F.explode(parts).alias("p")).select("id", "key", "p.o", "p.e", F.explode("p.words").alias("word")).where("word <> ''")
    signed = signatures(words.select("id", "key", F.xxhash64("word").alias("h"), "o", "e"), ["id", "key"], ["o", "e"], slots)
    edits = met.select("id", "key", F.sha2("edited", 256).alias("edited_sha256"))
    wordless = F.array(*[F.lit(-1)] * slots)
    both = edits.join(signed, ["id", "key"], "left").select("id", "key", "edited_sha256", *[F.coalesce(s, wordless).alias(s) for s in ("s0", "s1")])
    both = materialize(both, "signatures")

    after = both.select(F.col("id").alias("next_id"), F.col("key").alias("next_key"), F.col("s0").alias("s_next"))
    linked = both.join(follow.select("id", "key", "n_chars", "rows", F.col("next.id").alias("next_id"), F.col("next.key").alias("next_key")), ["id", "key"]).join(after, ["next_id", "next_key"])
    doc_id = F.when(F.col("id") != LOWEST, F.col("id"))
    out = linked.select(doc_id.alias("doc_id"), "n_chars", "rows", "edited_sha256", as_text(F.col("s0")).alias("fingerprint"), as_text(F.col("s1")).alias("edited_fingerprint"), likeness(F.col("s0"), F.col("s1")).alias("near_edited"), likeness(F.col("s0"), F.col("s_next")).alias("near_next"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("_copy", "rows")
