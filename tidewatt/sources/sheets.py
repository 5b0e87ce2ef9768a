"""Workbook sheets, given as rows of cells, to hourly load.

Input columns: workbook, sheet, row_idx (0-based), cells (array of text); also sheet_no (place in its workbook) and
workbook_no (place among the links) where they are known: ties and merges then go by place, else by name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatt import constants as K
from tidewatt.functions import scalar as S
from tidewatt.operators.ordered import join_small, pick_one, top_rows
from tidewatt.operators.reconcile import coalesce_parts

SHEET = ["workbook", "sheet"]


def find_header(cells: DataFrame) -> DataFrame:
    """Header row of each sheet: the first of its first rows that names both a date and an hour.

    Only the leading rows of a sheet are looked at, so the filter runs before
    anything moves.
    """
    names = F.transform("cells", S.canonical_header)
    return (
        cells.where(F.col("row_idx") < K.HEADER_SCAN_ROWS)
        .withColumn("names", names)
        .where(F.array_contains("names", "date") & F.array_contains("names", "hr"))
        .groupBy(*SHEET)
        .agg(
            F.min("row_idx").alias("header_row"),
            F.min_by("cells", "row_idx").alias("header"),
            F.min_by("names", "row_idx").alias("names"),
        )
    )


def header_names(cells: DataFrame) -> DataFrame:
    """Each header cell with its position, its text and its canonical name."""
    return find_header(cells).select(
        *SHEET, F.posexplode(F.arrays_zip(F.col("header").alias("raw"), F.col("names").alias("canonical")))
    ).select(*SHEET, F.col("pos").alias("position"), F.col("col.raw").alias("raw"), F.col("col.canonical").alias("canonical"))


def _position(name: str) -> Column:
    """1-based place of a canonical name in the header, null when it has none."""
    at = F.array_position("names", name)
    return F.when(at > 0, at.cast("int"))


def sheet_rows(cells: DataFrame, regions: Sequence[str] = tuple(K.REGIONS)) -> DataFrame:
    """Body rows with a readable date and hour, their UTC hour and load columns.

    Positions are settled once per sheet; a body row only picks its cells.
    """
    named = find_header(cells)
    layout = named.select(
        *SHEET,
        "header_row",
        _load_columns(regions).alias("load_cols"),
        *[_position(c).alias(f"at_{c}") for c in ("date", "hr", *regions)],
    )
    body = join_small(cells, layout, SHEET).where("row_idx > header_row")
    cell = lambda c: F.try_element_at("cells", F.col(f"at_{c}"))
    read = body.select(
        *SHEET,
        "row_idx",
        "load_cols",
        S.coerce_date(cell("date")).alias("day"),
        S.coerce_numeric(cell("hr")).cast("int").alias("hr"),
        *[S.coerce_numeric(cell(r)).alias(r) for r in regions],
    ).where("day is not null and hr is not null")
    return read.withColumn("time_utc", S.hour_ending_to_utc(F.col("day"), F.col("hr")))


def _load_columns(regions: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.lit(r) for r in regions]), lambda r: F.array_contains("names", r))


def parse_sheets(cells: DataFrame, regions: Sequence[str] = tuple(K.REGIONS)) -> DataFrame:
    """Hourly load of each sheet that names load columns; the first row of an hour stays."""
    rows = sheet_rows(cells, regions).where(F.size("load_cols") > 0)
    return pick_one(rows, [*SHEET, "time_utc"], [F.col("row_idx")]).select(
        *SHEET, "time_utc", F.size("load_cols").alias("n_load_cols"), *regions
    )


def places(cells: DataFrame) -> DataFrame:
    """Place of each sheet and its workbook, null where the cells don't say."""
    known = [F.min(c).alias(c) if c in cells.columns else F.lit(None).cast("int").alias(c) for c in ("workbook_no", "sheet_no")]
    return cells.groupBy(*SHEET).agg(*known) if {"workbook_no", "sheet_no"} & set(cells.columns) else cells.select(*SHEET).distinct().select(*SHEET, *known)


def best_sheets(parsed: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """The richest sheet of each workbook: most load columns, then most rows, then sheet order."""
    size = parsed.groupBy(*SHEET).agg(F.max("n_load_cols").alias("n_load_cols"), F.count("*").alias("sheet_rows"))
    order = [F.col("n_load_cols").desc(), F.col("sheet_rows").desc()]
    if placed is not None:
        size, order = size.join(placed.select(*SHEET, "sheet_no"), SHEET), [*order, F.col("sheet_no")]
    return pick_one(size, ["workbook"], [*order, F.col("sheet")])


def merge_workbooks(cells: DataFrame, regions: Sequence[str] = tuple(K.REGIONS), prefer: str = "first") -> DataFrame:
    """Load by hour over all workbooks: the best sheet of each, first non-null in workbook order."""
    parsed = parse_sheets(cells, regions)
    if not {"workbook_no", "sheet_no"} & set(cells.columns):
        best = best_sheets(parsed).select(*SHEET)
        return coalesce_parts(join_small(parsed, best, SHEET), regions, "workbook", ["time_utc"], prefer)
    placed = places(cells)
    best = best_sheets(parsed, placed).select(*SHEET).join(placed, SHEET)
    order = F.struct(F.coalesce("workbook_no", F.lit(-1)), F.col("workbook"))
    return coalesce_parts(join_small(parsed, best, SHEET).withColumn("__order", order), regions, "__order", ["time_utc"], prefer)


def sheet_audit(cells: DataFrame, regions: Sequence[str] = tuple(K.REGIONS)) -> DataFrame:
    """Status and reason of each sheet, with its usable rows, load columns and UTC span."""
    sheets = cells.groupBy(*SHEET).agg(F.count("*").alias("__rows"))
    headers = find_header(cells).select(*SHEET, F.array_join(_load_columns(regions), ",").alias("load_cols"))
    usable = sheet_rows(cells, regions).groupBy(*SHEET).agg(
        F.count("*").alias("n"), F.min("time_utc").alias("t0"), F.max("time_utc").alias("t1")
    )
    joined = sheets.join(headers, SHEET, "left").join(usable, SHEET, "left")
    reason = (
        F.when(F.col("load_cols").isNull(), "no_header_row_found")
        .when(F.col("n").isNull(), "empty_after_date_hr_cleaning")
        .when(F.col("load_cols") == "", "no_recognized_load_columns")
        .otherwise("ok")
    )
    ok = F.col("reason") == "ok"
    return joined.withColumn("reason", reason).select(
        *SHEET,
        F.when(ok, "parsed").otherwise("skipped").alias("status"),
        "reason",
        F.when(ok, F.col("n")).otherwise(F.lit(0)).alias("rows"),
        F.when(ok, F.col("load_cols")).otherwise(F.lit("")).alias("load_cols"),
        F.when(ok, F.col("t0")).alias("min_time_utc"),
        F.when(ok, F.col("t1")).alias("max_time_utc"),
    )


def workbook_audit(audit: DataFrame) -> DataFrame:
    """Per workbook: sheets, parsed sheets, and the best one."""
    parsed = F.col("status") == "parsed"
    totals = audit.groupBy("workbook").agg(F.count("*").alias("num_sheets"), F.count_if(parsed).alias("num_parsed_sheets"))
    width = F.size(F.split("load_cols", ","))
    best = top_rows(audit.where(parsed), 1, ["workbook"], [width.desc(), F.col("rows").desc(), F.col("sheet")])
    return totals.join(
        best.select(
            "workbook",
            F.col("sheet").alias("best_sheet"),
            F.col("load_cols").alias("best_load_cols"),
            F.col("rows").alias("best_rows"),
            F.col("min_time_utc").alias("best_min_time_utc"),
            F.col("max_time_utc").alias("best_max_time_utc"),
        ),
        "workbook",
        "left",
    ).withColumns(
        {"best_load_cols": F.coalesce("best_load_cols", F.lit("")), "best_rows": F.coalesce("best_rows", F.lit(0))}
    )


def month_coverage(spans: DataFrame, months: DataFrame) -> DataFrame:
    """Months with every span that overlaps them; a month no span covers has a null file.

    Each span is exploded to the months it touches, so the overlap becomes an
    equi-join on the month and not a comparison of every pair. Months are
    bounded by the calendar, so they are the side that is broadcast, and the
    spans never move.
    """
    touched = (
        spans.where("span_start is not null and span_end is not null and span_start <= span_end")
        .withColumn(
            "month_start",
            F.explode(
                F.expr("sequence(date_trunc('month', span_start), date_trunc('month', span_end), interval 1 month)")
            ),
        )
        # A month ends with its last hour: a span that starts after it does not touch it.
        .where(F.col("span_start") <= F.expr("month_start + interval 1 month - interval 1 hour"))
    )
    covered = touched.join(F.broadcast(months.select("month_start")), "month_start", "left_semi")
    bare = months.join(F.broadcast(touched.select("month_start").distinct()), "month_start", "left_anti")
    return covered.unionByName(bare, allowMissingColumns=True)


def month_starts(spans: DataFrame) -> DataFrame:
    """Every month between the first and the last day of the spans."""
    ends = spans.agg(F.min("span_start").alias("a"), F.max("span_end").alias("b")).where("a is not null")
    return ends.select(
        F.explode(F.expr("sequence(date_trunc('month', a), date_trunc('month', b), interval 1 month)")).alias("month_start")
    )
