"""Links in page markup, and which of them a date range may need."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def absolute(href: Column, base: Column) -> Column:
    """`href` against a site root such as https://host."""
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(base, href))
        .otherwise(F.concat(base, F.lit("/"), href))
    )


def site_root(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]+)", 1)


def extract_links(pages: DataFrame, extension: str = ".xlsx", html: str = "html", base: Column | None = None) -> DataFrame:
    """Distinct absolute links per page: double-quoted ones first, then single-quoted, in page order.

    Everything happens inside the row, so no page is ever shuffled.
    """
    root = F.coalesce(site_root(F.col("url")), F.lit("")) if base is None else base
    tail = re.escape(extension)
    found = F.concat(
        F.regexp_extract_all(html, F.lit(f'(?i)href\\s*=\\s*"([^"]+{tail})"'), F.lit(1)),
        F.regexp_extract_all(html, F.lit(f"(?i)href\\s*=\\s*'([^']+{tail})'"), F.lit(1)),
    )
    links = F.array_distinct(F.transform(found, lambda h: absolute(h, root)))
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, F.posexplode(links).alias("link_no", "link"))


def link_relevant(link: Column, first_year: int, last_year: int) -> Column:
    """True for a link that names a year in the range, or none at all."""
    years = F.regexp_extract_all(link, F.lit(r"((?:19|20)\d{2})"), F.lit(1))
    return (F.size(years) == 0) | F.exists(
        years, lambda y: y.cast("int").between(first_year, last_year)
    )
