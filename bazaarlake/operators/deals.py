"""Deals: offers far under the median price of like ones. Like means same segment, and about the same year if enough are."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlake.operators.filters import MIN_PRICE, matches, plausible_price

SEGMENT = ["brand", "model", "fuel"]
#: Least peers, year bands with their confidence, share of the median below which a price is an error.
MIN_PEERS, BANDS, FLOOR = 5, ((3, "high"), (5, "medium")), 0.10
ORDER = {"high": 3, "medium": 2, "low": 1}


def quartiles(prices: Column) -> Column:
    """Struct q1, median, q3, iqr, count of an array of numbers: the exclusive method; least and most under four; null if empty."""
    x, n = F.sort_array(prices), F.size(prices)

    def quartile(i: int) -> Column:
        # Place i * (n + 1) / 4 among the sorted values, counted from 1 and kept within them, by linear interpolation.
        j = F.greatest(F.least(F.floor(F.lit(i) * (n + 1) / 4), n - 1), F.lit(1)).cast("int")
        d = F.lit(i) * (n + 1) - 4 * j
        return (F.element_at(x, j) * (4 - d) + F.element_at(x, j + 1) * d) / 4

    middle = (F.element_at(x, F.floor((n + 1) / 2).cast("int")) + F.element_at(x, (F.floor(n / 2) + 1).cast("int"))) / 2
    q1 = F.when(n >= 4, quartile(1)).otherwise(F.element_at(x, 1).cast("double"))
    q3 = F.when(n >= 4, quartile(3)).otherwise(F.element_at(x, -1).cast("double"))
    made = F.struct(q1.alias("q1"), middle.alias("median"), q3.alias("q3"), (q3 - q1).alias("iqr"), n.cast("long").alias("count"))
    return F.when(n > 0, made)


#: Bins to a doubling of the value: selection looks at exact values within one bin of a group only.
BINS = 4


def bin_of(value: Column) -> Column:
    """The number of a value's bin; larger values are in the same or a later one."""
    return (F.signum(value) * F.floor(F.log2(F.abs(value) + 1) * BINS)).cast("int")


def values_at(counts: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], groups: list[str] | None = None, deal: Column | None = None, member: Column | None = None) -> DataFrame:
    """(*keys, *groups, count, and the value at each rank) of each group of counted values, by selection in two passes.

    counts: keys, value, n and perhaps more. ranks: name to rank, from 1, by a group's count. A row is in one group of its
    keys, or, with deal (an array of structs of the columns groups), in several; member then tells whether a row of counts is in the
    group of columns _<group>. The first pass adds counts by bin of value, and finds the bins that hold the ranks. The second
    fetches the exact values in those bins alone. So a group is never held or sorted whole, however many values it has.
    """
    groups = groups or []
    binned = counts.withColumn("_bin", bin_of(F.col(value)))
    dealt = binned if deal is None else binned.select("*", F.explode(deal).alias("_g")).select(*keys, "_bin", "n", "_g.*")
    group = [*keys, *groups]
    sums = dealt.groupBy(*group, "_bin").agg(F.sum("n").alias("_n"))
    own = Window.partitionBy(*group)
    upto = F.sum("_n").over(own.orderBy("_bin"))
    sums = sums.withColumn("count", F.sum("_n").over(own)).withColumn("_before", upto - F.col("_n"))
    inside = {k: (rank(F.col("count")) > F.col("_before")) & (rank(F.col("count")) <= F.col("_before") + F.col("_n")) for k, rank in ranks.items()}
    wanted = sums.where(reduce(or_, inside.values())).select(
        *(F.col(g).alias(f"_{g}") for g in group), F.col("_bin").alias("_b"), "count", *(F.when(inside[k], rank(F.col("count")) - F.col("_before")).alias(f"_at_{k}") for k, rank in ranks.items())
    )
    on = F.col("_bin") == F.col("_b")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    near = binned.join(wanted, on if member is None else on & member)
    named = [*(F.col(f"_{g}").alias(g) for g in group)]
    exact = near.select(*named, "_b", value, "n", "count", *(f"_at_{k}" for k in ranks))
    exact = exact.withColumn("_to", F.sum("n").over(Window.partitionBy(*group, "_b").orderBy(value)))  # equal values together
    return exact.groupBy(*group).agg(F.max("count").alias("count"), *(F.min(F.when(F.col("_to") >= F.col(f"_at_{k}"), F.col(value))).alias(k) for k in ranks))


#: The two ranks whose mean is the median.
MEDIAN = {"_low": lambda n: F.floor((n + 1) / 2), "_high": lambda n: F.floor(n / 2) + 1}


def quartiles_of(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, and q1, median, q3, iqr and count of each group's values, as quartiles() has them; groups without a value are left out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    place = {i: (lambda n, i=i: F.greatest(F.least(F.floor(F.lit(i) * (n + 1) / 4), n - 1), F.lit(1))) for i in (1, 3)}
    ranks = {**MEDIAN, "_first": lambda n: F.lit(1), "_last": lambda n: n}
    for i in (1, 3):
        ranks |= {f"_a{i}": place[i], f"_b{i}": lambda n, i=i: F.least(place[i](n) + 1, n)}
    found = values_at(counts, keys, value, ranks)
    n = F.col("count")

    def quartile(i: int) -> Column:
        d = F.lit(i) * (n + 1) - 4 * place[i](n)
        return (F.col(f"_a{i}") * (4 - d) + F.col(f"_b{i}") * d) / 4

    q1 = F.when(n >= 4, quartile(1)).otherwise(F.col("_first").cast("double"))
    q3 = F.when(n >= 4, quartile(3)).otherwise(F.col("_last").cast("double"))
    return found.select(*keys, q1.alias("q1"), ((F.col("_low") + F.col("_high")) / 2).alias("median"), q3.alias("q3"), (q3 - q1).alias("iqr"), n.alias("count"))


def score(price: Column, median: Column) -> Column:
    """Percent under the median; null for a median of 0."""
    return F.when(median != 0, (median - price) / median * 100)


def joined_by(rows: DataFrame, stats: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows with the other columns of stats; null keys are equal."""
    named = stats.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in stats.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(named, on, how).drop(*(f"_{k}" for k in keys))


def banded(rows: DataFrame) -> DataFrame:
    """Plausible offers of segments with enough peers, with segment_median, median, peers and confidence.

    Prices are counted by segment and year before they move. The medians of the overlapping bands of years are found by
    selection (values_at): bins of prices, not prices, go to each year whose band they are in. Offers meet their segment's and
    year's medians in equality joins, which Spark splits where a segment is hot. An offer without a year has the whole
    segment for peers.
    """
    out = rows.where(plausible_price() & F.col("brand").isNotNull() & F.col("model").isNotNull())
    year = "year_manufacture"
    counts = out.groupBy(*SEGMENT, year, "price").agg(F.count(F.lit(1)).alias("n"))
    band = lambda center, width: F.struct(center.cast("int").alias("center"), F.lit(width).alias("width"))
    whole = F.array(band(F.lit(None), 0))
    near = lambda w: F.transform(F.sequence(F.col(year) - w, F.col(year) + w), lambda c: band(c, w))
    deal = F.concat(whole, *(near(w) for w, _ in BANDS))
    member = (F.col("_width") == 0) | (F.abs(F.col(year) - F.col("_center")) <= F.col("_width"))
    found = values_at(counts, SEGMENT, "price", MEDIAN, ["center", "width"], F.when(F.col(year).isNull(), whole).otherwise(deal), member)
    found = found.where(F.col("count") >= MIN_PEERS).withColumn("m", (F.col("_low") + F.col("_high")) / 2)
    segments = found.where("width = 0").select(*SEGMENT, F.col("count").alias("segment_size"), F.col("m").alias("segment_median"))
    best = F.min_by(F.struct("m", "count", "width"), "width").alias("best")  # the narrowest band with enough peers
    bands = found.where("width > 0").groupBy(*SEGMENT, F.col("center").alias(year)).agg(best)
    out = joined_by(joined_by(out, segments, SEGMENT, "inner"), bands, [*SEGMENT, year], "left")
    names = reduce(lambda c, b: c.when(F.col("best.width") == b[0], b[1]), BANDS, F.when(F.lit(False), "")).otherwise("low")
    return out.withColumns({"median": F.coalesce("best.m", "segment_median"), "peers": F.coalesce("best.count", "segment_size"), "confidence": names}).drop("best")


def find_deals(
    rows: DataFrame, brand: str | None = None, model: str | None = None, fuel: str | None = None, min_score: float = 15, min_confidence: str | None = None
) -> DataFrame:
    """Offers with a score of at least min_score. Filters hold before segments are made, so they bound the peers too.

    An offer must be cheap for its whole segment as well as for its years.
    """
    out = banded(rows.where(matches("brand", brand) & matches("model", model) & matches("fuel", fuel)))
    out = out.where((F.col("segment_median") != 0) & (F.col("price") < F.col("segment_median") * (1 - min_score / 100)))
    out = out.where(F.col("price") > F.greatest(F.lit(float(MIN_PRICE)), F.col("median") * FLOOR))
    out = out.withColumn("score", score(F.col("price"), F.col("median"))).where(F.col("score") >= min_score)
    return out.where(rank_of("confidence") >= ORDER.get(min_confidence, 0)) if min_confidence else out


def rank_of(confidence: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in ORDER.items() for x in p)), F.col(confidence)), F.lit(0))


def page(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """The best deals first; ties by id."""
    return rows.orderBy(F.desc("score"), "id").offset(offset).limit(limit)


#: What makes a deal suspicious.
SUSPICIONS = {
    "no year": "year_manufacture is null",
    "no mileage": "mileage is null",
    "no fuel": "fuel is null",
    "no power": "power is null",
    "mileage over 500000": "mileage > 500000",
    "mileage under 100": "mileage < 100",
    "year before 1995": "year_manufacture < 1995",
    "score over 70": "score > 70",
    "fewer than 8 peers": "peers < 8",
}


def suspicious(rows: DataFrame, min_score: float = 25, hide_reviewed: bool = True) -> DataFrame:
    """Deals with at least one reason for suspicion, in reasons; most reasons first, then the score. Reviewed ones are left out."""
    reasons = F.filter(F.array(*(F.when(F.expr(rule), name) for name, rule in SUSPICIONS.items())), lambda r: r.isNotNull())
    found = find_deals(rows, min_score=min_score).withColumn("reasons", reasons).where(F.size("reasons") > 0)
    return found.where(F.col("review_status").isNull()) if hide_reviewed else found


def score_offers(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, score, count and quartiles) of target offers in their segment with fuel, or without where that is too small."""
    peers = rows.where(plausible_price())

    def stats(keys: list[str], name: str) -> DataFrame:
        made = quartiles_of(peers, keys, "price").where(F.col("count") >= MIN_PEERS)
        return made.select(*keys, F.struct("q1", "median", "q3", "iqr", "count").alias(name))

    found = joined_by(targets, stats(SEGMENT, "a"), SEGMENT, "left")
    found = joined_by(found, stats(SEGMENT[:2], "b"), SEGMENT[:2], "left")
    best = F.coalesce("a", "b")
    return found.withColumn("stats", best).where("stats is not null").select("id", score(F.col("price"), F.col("stats.median")).alias("score"), "stats.*")
