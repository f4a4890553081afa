"""Predicates over listings: parameters of requests, sanity bounds, validators, and the test whether an offer is a car."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds, clamps and whitelists of the service whose answers these queries match.
MIN_PRICE, MAX_PRICE = 10_000, 5_000_000
CAR_PRICES = (5_000, 50_000_000)
BUCKETS = (10_000, 500_000)
PAGE_SIZES = {"admin": 100, "suspicious": 200, "deals": 200, "cars": 1000}
SORTABLE = ("id", "price", "year_manufacture", "mileage", "power", "scraped_at", "listing_date", "view_count")
MISSABLE = ("year_manufacture", "mileage", "power", "fuel", "price")
VALID = {"year_manufacture": (1900, None), "mileage": (1, 1_500_000), "power": (1, 1_500), "price": (1, 50_000_000)}


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def matches(column: str, value, collation: str | None = None) -> Column:
    """Equality, exact or under a collation; None: no filter; 'null': is null."""
    if value is None:
        return F.lit(True)
    if value == "null":
        return F.col(column).isNull()
    if collation:
        return F.collate(F.col(column), collation) == F.collate(F.lit(value), collation)
    return F.col(column) == value


def in_range(column: str, low=None, high=None) -> Column:
    """Closed bounds; None: open. Zero is a bound."""
    bounds = ([F.col(column) >= low] if low is not None else []) + ([F.col(column) <= high] if high is not None else [])
    return reduce(and_, bounds, F.lit(True))


def near(year: int | None = None, years: int = 2, mileage: int | None = None, percent: int = 20) -> Column:
    """Within years of a year, and within percent of a mileage; bounds are cut to whole numbers."""
    found = F.lit(True)
    if year is not None:
        found &= F.col("year_manufacture").between(year - years, year + years)
    if mileage is not None:
        found &= F.col("mileage").between(int(mileage * (1 - percent / 100)), int(mileage * (1 + percent / 100)))
    return found


def all_missing(columns: list[str]) -> Column:
    """All of the columns, of those that may be asked for, are null."""
    return reduce(and_, (F.col(c).isNull() for c in columns if c in MISSABLE), F.lit(True))


def plausible_price() -> Column:
    return (F.col("price") > MIN_PRICE) & (F.col("price") < MAX_PRICE)


def validated(column: str, as_of_year: int) -> Column:
    """The value if it is possible, else null."""
    low, high = VALID[column]
    return F.when(F.col(column).between(low, as_of_year if high is None else high), F.col(column))


def richness(has: list[Column]) -> Column:
    """How many of the fields are there."""
    return reduce(lambda a, b: a + b, (h.cast("int") for h in has))


#: Families of patterns that tell parts, wanted notices and other vehicles from cars, with where they are sought.
FAMILIES = {
    "not selling": ("heading", r"\b(?:koup[ií]m|hled[aá]m|sh[aá]n[ií]m|popt[aá]v[aá]m|pronaj[ií]m[aá]m|pron[aá]jem|p[uů]j[čc]ovna)\b"),
    "parts phrase": (
        "heading",
        r"na\s+d[ií]ly|n[aá]hradn[ií]\s+d[ií]ly|auto\s*d[ií]ly|[čc]eln[ií]\s+sklo|hlava\s+motoru|stře[sš]n[ií]\s+nosi[čc]|stře[sš]n[ií]\s+box"
        r"|ta[zž]n[eé]\s+za[rř][ií]zen[ií]|zimn[ií]\s+pneu|letn[ií]\s+pneu|sada\s+kol|sada\s+disk[uů]|sada\s+pneu|na\s+rozborku|rozborka",
    ),
    "wheel": ("heading", r"\d+[,.]?\d*\s*j\s*x\s*\d+|(?:^|\s)\d+x\d{2,3}(?:\s|$)|\bR\d{2}\b|\br?\d{2}\""),
    "starts with a part": ("heading", r"^\s*(?:motor|převodovka|p[rř]evodovka|turbo|kompresor)\s"),
    "part": (
        "heading",
        r"\b(?:n[aá]razn[ií]k[y]?|blatn[ií]k[y]?|sv[eě]tl[ao]|n[aá]prava|lo[zž]isk[oa]|brzd[oy]|desti[čc]k[yi]|kotou[čc][e]?|tlumi[čc][e]?|pru[zž]in[ya]"
        r"|p[ií]st[y]?|v[aá]lce|turbodmychadlo|v[yý]fuk|katalyz[aá]tor|dpf|egr|[šs]asi|korb[auye]|nosn[yý]\s+r[aá]m|seda[čc]k[yi]|tapec[eiy]|interi[eé]r"
        r"|potah[y]?|body\s*kit|autovestavb[ay]|obytn[aá]\s+vestavb[ay]|pneumatik[yi]|pneu|disk[yi]|alu\s*kol[ao]?|motocykl|motorka|motorky|sk[uú]tr"
        r"|moped|autobus|traktor[y]?|bagr[y]?|naklada[čc][e]?|rolba|vysokozdvi[zž]n[yý]|karavan[y]?|obytn[yý]|obyt[nň][aá]k|p[rř][ií]v[eě]s[y]?"
        r"|p[rř][ií]v[eě]sn[yý]|[čc]ty[rř]kolk[ay]|t[rř][ií]kolk[ay]|golfov[yý]\s+voz[ií]k|autosed[aá][čc]k[au]|kobe[rř]e[čc]k[yi]|kol[ay]\s*\+\s*gum[yi]"
        r"|autodíly|autodily|d[ií]ly)\b",
    ),
    "description of parts": (
        "description",
        r"na\s+d[ií]ly|na\s+opravu|nem[aá]\s+papíry|bez\s+papír[uů]|bez\s+TP|nem[aá]\s+TP|bez\s+(?:technick[eé]ho\s+)?pr[uů]kazu|nosn[yý]\s+r[aá]m|[šs]asi",
    ),
    "installments": ("both", r"na\s+spl[aá]tky|akontace|bez\s+nahl[ií][zž]en[ií]|spl[aá]tk[yi]\s+(?:dle|od|bez)"),
}


def reject_reason(heading: str = "heading", description: str = "description", price: str = "price") -> Column:
    """Why an offer is no car for sale; null if it is one. Without a price or heading it is none."""
    head, text = F.col(heading), F.coalesce(F.col(description), F.lit(""))
    places = {"heading": [head], "description": [text], "both": [head, text]}
    reason = F.when(~F.coalesce(F.col(price).between(*CAR_PRICES), F.lit(False)), "price").when(F.coalesce(F.trim(head), F.lit("")) == "", "no heading")
    for name, (place, pattern) in FAMILIES.items():
        reason = reason.when(reduce(or_, (c.rlike(f"(?iU){pattern}") for c in places[place])), name)
    return reason


def cars_only(rows: DataFrame) -> DataFrame:
    return rows.where(reject_reason().isNull())


#: The words of the older, simpler test.
NO_CAR_WORDS = (
    "ALU kola kol motor sada díly sklo převodovka pneu pneumatiky disky sedadla baterie náhradní zrcátka motocykl motorky moto kolo skútr"
    " motorové karavany choppery endura autobus autodíly zimní letní"
).split()


def is_car_by_keywords(model: Column, heading: Column, price: Column) -> Column:
    """The older test: a known model, a price from 5000 on, and none of the words in the heading."""
    words = r"(?iU)\b(?:" + "|".join(NO_CAR_WORDS) + r")\b"
    return F.coalesce(model.isNotNull() & (price >= CAR_PRICES[0]) & ~heading.rlike(words), F.lit(False))


def page_size(kind: str, wanted: int) -> int:
    """Rows of a page as asked for, within what a kind of listing allows."""
    return clamp(wanted, 1, PAGE_SIZES[kind])
