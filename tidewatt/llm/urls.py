"""URL filter: listed rules first, then a path-template tree for each host.

The tree is grown level by level over distinct (host, path) pairs. A segment that is a number, a code or rare among
its siblings becomes a wildcard of its kind. The other branches are compared with all branches of their parent: what
follows (end, number, code, word) and how their urls are labelled; a branch that chi-square can't tell from them is
merged into one. A template is rejected if its labels, smoothed towards the share of all, are mostly blocks and cover
enough of it. Labels are the urls that the rules decide.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatt.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KINDS = ("{end}", "{num}", "{code}", "{word}")


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: str) -> tuple[Column, Column]:
    """Both empty for a null url or one without `://`."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def ruled(rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as (rule, verdict), or null. Of equally long ones the first listed wins."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    fits = lambda r: ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(ordered):
        found = F.when(fits(r), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def kind(segment: Column) -> Column:
    """What a segment looks like: its end, a number (an extension aside), a code with digits, or a word."""
    bare = F.regexp_replace(segment, "[.][A-Za-z]{1,5}$", "")
    return F.when(segment.isNull(), KINDS[0]).when(bare.rlike("^[0-9]+$"), KINDS[1]).when(bare.rlike("[0-9]"), KINDS[2]).otherwise(KINDS[3])


def templates(paths: DataFrame, depth: int, rare: int, share: float, critical: float) -> DataFrame:
    """`paths` (host, path, segments, n, bad, good) with `template`; segments past `depth` become one `{rest}`."""
    grown = paths.withColumn("template", F.lit(""))
    for d in range(depth):
        here, after = F.get("segments", F.lit(d)), F.get("segments", F.lit(d + 1))
        level = grown.select("*", here.alias("seg"), kind(here).alias("kind"), kind(after).alias("follows"))
        level = level.withColumn("child", F.when(F.col("kind") == KINDS[3], F.col("seg")).otherwise(F.col("kind")))
        cells = [F.sum(F.when(F.col("follows") == k, F.col("n")).otherwise(0)).alias(f"f{i}") for i, k in enumerate(KINDS)]
        labelled = [F.sum("bad").alias("l0"), F.sum("good").alias("l1"), F.sum(F.col("n") - F.col("bad") - F.col("good")).alias("l2")]
        branches = level.where("seg is not null").groupBy("host", "template", "child").agg(F.sum("n").alias("m"), *cells, *labelled)
        names = [*(f"f{i}" for i in range(4)), *(f"l{i}" for i in range(3))]
        parents = branches.groupBy("host", "template").agg(F.sum("m").alias("p_m"), *[F.sum(c).alias(f"p_{c}") for c in names])
        both = branches.join(parents, ["host", "template"])
        expected = lambda c: F.col(f"p_{c}") * F.col("m") / F.col("p_m")
        chi = reduce(lambda a, b: a + b, [F.when(F.col(f"p_{c}") > 0, (F.col(c) - expected(c)) ** 2 / expected(c)).otherwise(0.0) for c in names])
        word = ~F.col("child").isin(*KINDS)
        scarce = (F.col("m") < rare) | (F.col("m") < share * F.col("p_m"))
        as_part = F.when(~word, F.col("child")).when(scarce, F.lit("{rare}")).when(chi < critical, F.lit("{same}")).otherwise(F.col("child"))
        parts = both.select("host", "template", "child", as_part.alias("part"))
        joined = level.join(parts, ["host", "template", "child"], "left")
        grown = joined.withColumn("template", F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "part")))
        grown = materialize(grown.select(*paths.columns, "template"), "templates")
    deep = F.size("segments") > depth
    return grown.withColumn("template", F.when(deep, F.concat("template", F.lit("/{rest}"))).otherwise(F.col("template")))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", most_depth: int = 6, rare: int = 3, share: float = 0.01, critical: float = 12.59, weight: float = 4.0, reject: float = 0.5, cover: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row.

    `critical`: chi-square over the 7 cells at 5 percent. Null urls and urls without `://` have an empty host and path,
    no rule and the verdict of that template. Rows that repeat stay; an empty table gives no row. Only the two named
    columns are read; distinct paths are counted before anything is dealt out by host, so a hot host is split by path.
    """
    host, path = host_and_path(url_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = materialize(rows.withColumn("found", ruled(rules)), "urls")
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    labels = [F.sum((F.col("found.verdict") == v).cast("int")) for v in ("block", "allow")]
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.coalesce(labels[0], F.lit(0)).alias("bad"), F.coalesce(labels[1], F.lit(0)).alias("good"))
    paths = materialize(paths.withColumn("segments", segments), "paths")
    deepest, bad, total = paths.agg(F.coalesce(F.max(F.size("segments")), F.lit(0)), F.sum("bad"), F.sum("n")).first()
    prior = (bad or 0) / max(total or 0, 1)
    grown = templates(paths, min(most_depth, deepest), rare, share, critical)
    seen = grown.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("bad") + F.col("good")).alias("labelled"))
    purity = (F.col("bad") + weight * prior) / (F.col("labelled") + weight)
    own = F.when((purity >= reject) & (F.col("labelled") >= cover * F.col("n")), "block").otherwise("allow")
    judged = grown.select("host", "path", "template").join(seen.select("host", "template", purity.alias("purity"), own.alias("own")), ["host", "template"])
    out = rows.join(judged, ["host", "path"])
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "own").alias("verdict"), "template", "purity")
