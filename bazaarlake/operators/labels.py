"""Labelled spans: validity, overlaps, their resolution, statistics, and how predictions differ from them.

A labelled text has entities, an array of structs (start, end, label); end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels, the more important first.
LABELS = ("MILEAGE", "YEAR", "POWER", "FUEL")
ISSUES = ("DUPLICATE", "INVALID_SPAN_ORDER", "NEGATIVE_SPAN", "OUT_OF_BOUNDS", "OVERLAP", "SAME_SPAN_DIFFERENT_LABELS")


def is_valid(e: Column, size: Column) -> Column:
    return (e.start >= 0) & (e.start < e.end) & (e.end <= size)


def valid_only(entities: Column, text: Column) -> Column:
    return F.filter(entities, lambda e: is_valid(e, F.length(text)))


#: A token is a run of these characters, or any other character that isn't white space.
WORD = r"[\p{L}\p{M}\p{N}_]"
TOKEN = rf"{WORD}+|[^\s\p{{L}}\p{{M}}\p{{N}}_]"


def is_aligned(e: Column, text: Column) -> Column:
    """Whether a span starts where a token starts and ends where one ends: both edges are told by the characters beside them.

    So a text of any length costs a span the same, and no tokens are made. A span that isn't valid isn't aligned.
    """
    def cuts_word(at: Column) -> Column:
        return (at > 0) & F.substring(text, at, 2).rlike(f"^{WORD}{WORD}")

    def blank(at: Column) -> Column:
        return F.substring(text, at, 1).rlike(r"(?U)^\s")

    return is_valid(e, F.length(text)) & ~(cuts_word(e.start) | cuts_word(e.end) | blank(e.start + 1) | blank(e.end))


def aligned_only(entities: Column, text: Column) -> Column:
    """The spans on token boundaries, in their order; null entities give null, null text none."""
    return F.filter(entities, lambda e: F.coalesce(is_aligned(e, text), F.lit(False)))


def overlap(a: Column, b: Column) -> Column:
    return (a.start < b.end) & (b.start < a.end)


def without_overlaps(entities: Column) -> Column:
    """Longer spans win, then the more important label, then the left one; the rest are dropped. Sorted by place."""
    def key(e: Column) -> Column:
        important = F.array_position(F.array(*(F.lit(x) for x in LABELS)), e.label)
        return F.struct((e.start - e.end).alias("size"), important.alias("rank"), e.start.alias("at"), e.alias("e"))

    ordered = F.array_sort(F.transform(entities, key))
    none = F.filter(entities, lambda e: F.lit(False))

    def keep(kept: Column, k: Column) -> Column:
        return F.when(F.exists(kept, lambda x: overlap(x, k.e)), kept).otherwise(F.concat(kept, F.array(k.e)))

    return F.array_sort(F.aggregate(ordered, none, keep))


def pairs(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, i, j, a, b): each pair of spans of one text; a row is never larger than its own spans squared."""
    first = rows.select(id_col, "entities", F.posexplode("entities").alias("i", "a"))
    return first.select(id_col, "i", "a", F.posexplode("entities").alias("j", "b")).where("i < j")


def overlapping(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, i, j, a, b): each pair of spans of one text that overlap, by a sweep over starts and ends in order.

    At a span's end, the starts so far tell how many spans begin before it; those that begin after the span itself follow
    it directly in order of start. So the rows made are as many as the overlaps, not the pairs. (Spans that end where or before
    they start are tested once more, as their start alone doesn't tell.)
    """
    spans = rows.select(F.col(id_col).alias("_id"), F.posexplode("entities").alias("i", "e"))
    text = Window.partitionBy("_id")
    placed = spans.withColumn("place", F.row_number().over(text.orderBy("e.start", "i")))
    edges = F.explode(F.array(F.struct(F.col("e.start").alias("at"), F.lit(1).alias("starts")), F.struct(F.col("e.end").alias("at"), F.lit(0).alias("starts"))))
    swept = placed.select("*", edges.alias("edge")).select("*", "edge.*")
    # An end stands before the starts at the same place: they don't overlap.
    begun = F.sum("starts").over(text.orderBy("at", "starts", "place").rowsBetween(Window.unboundedPreceding, 0))
    ends = swept.withColumn("begun", begun).where("starts = 0 and begun > place")
    nexts = F.explode(F.sequence(F.col("place") + 1, F.col("begun").cast("int"))).alias("place")
    first = ends.select("_id", F.col("i").alias("i1"), F.col("e").alias("e1"), nexts)
    met = first.join(placed.select("_id", "place", F.col("i").alias("i2"), F.col("e").alias("e2")), ["_id", "place"]).where(overlap(F.col("e1"), F.col("e2")))
    ahead = F.col("i1") < F.col("i2")
    ordered = [F.least("i1", "i2").alias("i"), F.greatest("i1", "i2").alias("j"), F.when(ahead, F.col("e1")).otherwise(F.col("e2")).alias("a"), F.when(ahead, F.col("e2")).otherwise(F.col("e1")).alias("b")]
    return met.select(F.col("_id").alias(id_col), *ordered)


def issues(rows: DataFrame, id_col: str = "id", size: Column | None = None) -> DataFrame:
    """(issue, n): how many spans and pairs of spans have each kind of fault."""
    size = F.length("text") if size is None else size
    each = rows.select(F.col(id_col).alias("_id"), size.alias("size"), F.explode("entities").alias("e"))
    single = F.array(
        F.when(F.col("e.start") < 0, "NEGATIVE_SPAN"), F.when(F.col("e.start") >= F.col("e.end"), "INVALID_SPAN_ORDER"), F.when(F.col("e.end") > F.col("size"), "OUT_OF_BOUNDS")
    )
    pairs_of = lambda n: F.expr(f"{n} * ({n} - 1) div 2")
    # Equal spans are counted, not paired.
    labels = each.groupBy("_id", "e.start", "e.end", "e.label").agg(F.count(F.lit(1)).alias("k"))
    places = labels.groupBy("_id", "start", "end").agg(F.sum("k").alias("n"), F.sum(pairs_of("k")).alias("same"))
    equal = places.agg(F.sum("same").alias("DUPLICATE"), F.sum(pairs_of("n") - F.col("same")).alias("SAME_SPAN_DIFFERENT_LABELS"))
    equal = equal.select(F.explode(F.array(*(F.struct(F.lit(c).alias("issue"), F.col(c).alias("n")) for c in equal.columns))).alias("x")).select("x.*")
    a, b = F.col("a"), F.col("b")
    unlike = overlapping(rows, id_col).where((a.start != b.start) | (a.end != b.end)).select(F.lit("OVERLAP").alias("issue"))
    found = each.select(F.explode(single).alias("issue")).union(unlike).where("issue is not null")
    return found.groupBy("issue").agg(F.count(F.lit(1)).alias("n")).union(equal.where("n > 0"))


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("entities").alias("e")).groupBy(F.col("e.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def dataset_statistics(rows: DataFrame) -> DataFrame:
    n = F.size("entities")
    complete = F.size(F.array_distinct(F.transform("entities", lambda e: e.label))) == len(LABELS)
    return rows.agg(
        F.count(F.lit(1)).alias("examples"),
        F.sum(n).alias("entities"),
        F.avg(n).alias("entities_each"),
        F.avg((n > 0).cast("double") * 100).alias("percent_with_entities"),
        F.count_if(complete).alias("complete"),
        F.count_if(n == 0).alias("empty"),
    )


def precision_recall(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1, over exact spans with labels."""
    tp = F.sum(F.size(F.array_intersect(gold, predicted)))
    counted = rows.agg(tp.alias("tp"), F.sum(F.size(F.array_except(predicted, gold))).alias("fp"), F.sum(F.size(F.array_except(gold, predicted))).alias("fn"))
    p = F.try_divide("tp", F.col("tp") + F.col("fp"))
    r = F.try_divide("tp", F.col("tp") + F.col("fn"))
    return counted.select("*", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def errors(rows: DataFrame, gold: str = "gold", predicted: str = "predicted", id_col: str = "id") -> DataFrame:
    """(id, error, label, start): predictions that are wrong, by the first gold span that they overlap, and gold spans missed.

    boundary: that has the label; label_confusion: it has another; false_positive: there is none. A gold span that no prediction
    overlaps is a false_negative.
    """
    wrong = rows.select(id_col, gold, F.explode(F.array_except(predicted, gold)).alias("e"))
    touched = F.array_sort(F.filter(gold, lambda g: overlap(g, F.col("e"))))
    kind = F.when(F.size(touched) == 0, "false_positive").when(F.get(touched, F.lit(0)).label == F.col("e.label"), "boundary").otherwise("label_confusion")
    missed = rows.select(id_col, F.explode(F.filter(gold, lambda g: ~F.exists(predicted, lambda p: overlap(g, p)))).alias("e"))
    found = wrong.select(id_col, kind.alias("error"), "e").union(missed.select(id_col, F.lit("false_negative"), "e"))
    return found.select(id_col, "error", "e.label", "e.start")
