"""Quality rules: each rule votes good or bad or abstains; expectation-maximisation estimates how often each rule
votes which way on good and on bad documents; a document's posterior probability of being good decides.

DataFrame functions only. The one pass over the texts is stored as numbers a row; the estimation then works on counts of
distinct vote patterns (3 to the number of rules at most, whatever the corpus holds).

Null and empty texts have no words; they fail the base rules. Repeated rows are judged alike, each on its own. An empty
table gives an empty result. Of other columns only those asked for are carried; a column that is named like one of
the statistics is not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm.common import let, read, stored, words_of

#: Frequent words of four languages.
STOP_WORDS = """the of and to in is that it for was on with as be at this are by an or from
der die das und ist nicht mit ein eine den von zu sich auf für im dem des auch
le la les de des et un une est que en du dans pour par sur pas qui au avec
el los las y que en un una por con para se del su al lo no""".split()
#: Rounds of estimation; each adds one job over the patterns.
ROUNDS = 12


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text holds twice or more.

    Windows are told apart by a 64-bit hash within their text. Where a hash occurs twice, they are sorted with their
    places, so that equal ones are neighbours: n log n steps for any text.
    """
    size = F.size(words)

    def covered(ranked: Column) -> Column:
        again = F.transform(ranked, lambda w, i: F.when((w.h == F.get(ranked, i - 1).h) | (w.h == F.get(ranked, i + 1).h), w.at))
        starts = F.filter(again, lambda p: p.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

    def count(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == size - 2, 0).otherwise(let(ranked, covered))

    def window(i: Column) -> Column:
        return F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1))

    hashes = F.transform(F.sequence(F.lit(1), size - 2), window)
    return F.when(size < 3, 0).otherwise(let(hashes, count)).cast("long")


def statistics(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns carry, and a struct stats of numbers about each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of_lines(lines: Column) -> dict[str, Column]:
        return {"n_lines": F.size(lines).cast("long"), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")}

    def of_words(words: Column) -> Column:
        stop = F.size(F.filter(words, lambda w: w.isin(STOP_WORDS)))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
            stop.cast("long").alias("n_stop_words"),
        )

    def of_marks(marks: Column) -> Column:
        symbols = F.length(F.regexp_replace(marks, r"[^#*$%&|<>]+", ""))
        shouts = F.length(F.regexp_replace(marks, r"[^!]+", ""))
        return F.struct(
            symbols.cast("long").alias("n_symbols"),
            shouts.cast("long").alias("n_shouts"),
            (F.length(marks) - symbols - shouts).cast("long").alias("n_capitals"),
        )

    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x09-\x0D ]"))
    parts = docs.select(
        *(carry or []),
        let(words_of(text), of_words).alias("_words"),
        let(F.regexp_replace(text, r"[^#*$%&|<>!\p{Lu}]+", ""), of_marks).alias("_marks"),
        let(lines, lambda x: F.struct(*(c.alias(n) for n, c in of_lines(x).items()))).alias("_lines"),
    )
    return parts.select(*(carry or []), F.struct("_words.*", "_marks.*", "_lines.*").alias("stats"))


def base_failed(s: Column) -> Column:
    """Fixed by contract: too few words, or too many repeated ones."""
    return (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)


def votes(s: Column) -> list[Column]:
    """Each rule's vote from the statistics: 1 good, -1 bad, 0 none."""
    words = F.greatest(s.n_words, F.lit(1)).cast("double")
    chars = F.greatest(s.word_chars, F.lit(1)).cast("double")
    lines = F.greatest(s.n_lines, F.lit(1)).cast("double")

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    def low(share: Column, good: float, bad: float) -> Column:
        return rule(share > bad, share <= good)

    length = s.word_chars / words
    return [
        rule(s.n_words < 50, s.n_words >= 80),
        low(s.n_symbols / words, 0.05, 0.15),
        low(s.n_repeat_words / words, 0.15, 0.3),
        low(s.n_dup_lines / lines, 0.1, 0.3),
        low(s.n_capitals / chars, 0.12, 0.3),
        low(s.n_shouts / words, 0.05, 0.2),
        rule((length < 2.5) | (length > 14), length.between(3, 10)),
        rule(s.n_stop_words / words < 0.005, s.n_stop_words / words >= 0.06),
    ]


def posterior(pattern: list[Column], evidence: list[float]) -> Column:
    """Probability of good given votes. evidence: log odds before any vote, then of each rule's votes -1, 0, 1.

    One array literal holds the evidence, so that the code Spark generates is the same in every round.
    """
    weights = F.lit(evidence)
    said = [F.get(weights, vote + (2 + 3 * k)) for k, vote in enumerate(pattern)]
    return 1 / (1 + F.exp(-reduce(Column.__add__, said, F.get(weights, F.lit(0)))))


def estimate(voted: DataFrame, n_rules: int, rounds: int = ROUNDS) -> list[float]:
    """The evidence of each rule's votes, by expectation-maximisation over the vote patterns.

    It starts from documents with no vote for bad being good, the others bad, nine times of ten each; and keeps the
    weight of two pseudo-votes for rules being right, so that the classes stay what the rules mean by them.
    """
    rules = [f"v{k}" for k in range(n_rules)]
    cols = [F.col(r) for r in rules]
    patterns = voted.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")).cache()
    believed = {-1: (0.01, 0.4), 0: (0.1, 0.2), 1: (0.89, 0.4)}
    share = F.when(F.least(*cols) == -1, 0.1).otherwise(0.9)
    for _ in range(rounds):
        cast = F.posexplode(F.array(*cols)).alias("rule", "vote")
        sums = patterns.select("n", (F.col("n") * share).alias("g"), cast).groupBy("rule", "vote").agg(F.sum("n"), F.sum("g"))
        got = {(r, v): (float(n), float(g)) for r, v, n, g in sums.collect()}
        n, g = (sum(x[i] for (r, _), x in got.items() if r == 0) for i in (0, 1))
        evidence = [math.log((g + 1) / (max(0.0, n - g) + 1))]
        for r in range(n_rules):
            for v, (good, bad) in believed.items():
                nv, gv = got.get((r, v), (0.0, 0.0))
                p, q = (gv + 2 * good) / (g + 2), (max(0.0, nv - gv) + 2 * bad) / (max(0.0, n - g) + 2)
                evidence.append(math.log(p / q))
        share = posterior(cols, evidence)
    patterns.unpersist()
    return evidence


def judged(docs: DataFrame, *, text_col: str = "text", carry: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """The columns carry, stats, base_failed, p_good (the posterior) and kept of each row."""
    stats = stored(statistics(docs, text_col, carry), "quality-rules")
    rules = votes(F.col("stats"))
    voted = stats.select(*(v.alias(f"v{k}") for k, v in enumerate(rules)))
    evidence = estimate(voted, len(rules))
    failed = base_failed(F.col("stats"))
    p = posterior(rules, evidence)
    return stats.select(*(carry or []), "stats", failed.alias("base_failed"), p.alias("p_good"), (~failed & (p >= threshold)).alias("kept"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document, whether it fails the base rules, and whether it is kept."""
    return judged(read(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "doc_id",
        *(F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        "base_failed",
        "kept",
        "p_good",
    )


def keep_good(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows that are kept, with docs' own columns."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    kept = judged(docs.select(row), text_col=f"row.`{text_col}`", carry=["row"]).where("kept")
    return kept.select("row.*")
