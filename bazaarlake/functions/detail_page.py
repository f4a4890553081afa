"""Fields of a listing's detail page, and the links of result and menu pages: columns only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlake.functions import normalise as nrm

#: Class names of the pages' parts, and how many entries of the brand menu are brands.
DESCRIPTION, HEADING, PRICES, STAMP, RESULT, MENU, MENU_LINKS = "popisdetail", "nadpisdetail", "listadvlevo", "inzeratydetnadpis", "inzeraty", "barvaleva", 24
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
HREF = r"""(?is)<a\s(?:[^>]*\s)?href\s*=\s*["']?([^"'\s>]+)"""


def opening(tag: str, name: str) -> str:
    """Pattern of a start tag with a class, quoted or not, alone or among others."""
    return rf"""<{tag}\b[^>]*\bclass\s*=\s*(?:["'][^"']*(?<![\w-]){name}(?![\w-])[^"']*["']|{name}(?![\w-]))[^>]*>"""


def part(html: Column, pattern: str) -> Column:
    """The pattern's group, null where it doesn't match; an empty one is kept."""
    return F.get(F.regexp_extract_all(html, F.lit(f"(?is){pattern}"), F.lit(1)), F.lit(0))


def plain(markup: Column) -> Column:
    """Text of markup, without outer white space."""
    text = F.regexp_replace(markup, r"(?s)<!--.*?-->|<[^>]*>", "")
    for name, value in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once a row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fields(html: Column) -> Column:
    """Struct (description, heading, price, listing_date, view_count); null if description, heading or price table is missing.

    The price has the digits of the last row of the table in the price cell; it is null if there are none.
    """
    parts = F.struct(
        plain(part(html, opening("div", DESCRIPTION) + r"(.*?)</div\s*>")).alias("description"),
        plain(part(html, opening(r"\w+", HEADING) + r"(.*?)</(?:h\d|div|span|td|p|b|a)\s*>")).alias("heading"),
        part(html, opening("td", PRICES) + r"(.*)").alias("cell"),
        plain(part(html, opening("div", STAMP) + r"(.*?)</div\s*>")).alias("stamp"),
    )

    def made(p: Column) -> Column:
        row = part(part(p.cell, r"<table\b[^>]*>(.*?)</table\s*>"), r".*<tr\b[^>]*>(.*)")
        return let(row, lambda row: F.when(p.description.isNotNull() & p.heading.isNotNull() & row.isNotNull(), F.struct(
            p.description.alias("description"),
            p.heading.alias("heading"),
            nrm.price(plain(row)).alias("price"),
            nrm.listing_date(p.stamp).alias("listing_date"),
            nrm.view_count(plain(p.cell)).alias("view_count"),
        )))

    return let(parts, made)


def with_fields(pages: DataFrame, html: Column) -> DataFrame:
    """pages with the columns of fields(html), and parsed: whether the page has the parts. Each page is parsed once.

    Made into a row of their own (inline), so that the optimiser can't repeat the parse for each column that is used.
    """
    made = pages.select("*", F.inline_outer(F.array(fields(html))))
    return made.withColumn("parsed", F.col("description").isNotNull())


def absolute(links: Column, base: str) -> Column:
    return F.transform(links, lambda x: F.when(x.startswith("http"), x).otherwise(F.concat(F.lit(base), x)))


def result_links(html: Column, base: str) -> Column:
    """Absolute addresses in the listing blocks of a results page: all links of each block, in order, repeats left out."""
    blocks = F.slice(F.split(html, f"(?is){opening('div', RESULT)}"), 2, 1_000_000)
    inside = F.transform(blocks, lambda b: F.regexp_extract_all(F.regexp_replace(b, r"(?is)</div\s*>.*", ""), F.lit(HREF), F.lit(1)))
    return absolute(F.array_distinct(F.flatten(inside)), base)


def menu_brands(html: Column, base: str) -> Column:
    """Array of structs (brand, url) from the first entries of the brand menu; empty without a menu."""
    links = F.regexp_extract_all(F.coalesce(part(html, opening(r"\w+", MENU) + "(.*)"), F.lit("")), F.lit(HREF), F.lit(1))
    return F.transform(F.slice(links, 1, MENU_LINKS), lambda x: F.struct(F.substring(x, F.lit(2), F.length(x) - 2).alias("brand"), F.concat(F.lit(base), x).alias("url")))
