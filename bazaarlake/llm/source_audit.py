"""Source divergence audit: how the sources of each language differ in their use of common terms.

Two passes over the texts. The first counts, exactly, in how many documents of its language each term stands; terms in
enough documents are kept. The second counts occurrences of kept terms with an Aho-Corasick automaton: terms are padded with
a delimiter on both sides, texts are brought to terms with one delimiter between, and a match is a whole term. Counts of
(language, source, term) are sparse postings; a term that a source lacks has the source's value for count 0.
  pair    every two sources of a language, by the sum of absolute differences over all kept terms, all ranks;
  term    a source's terms that are more frequent there than in the language as a whole, the first ranks only.
The relative frequency is a whole number of billionths with additive smoothing, so all arithmetic is exact.

Bounds. The kept terms are read in blocks of TERMS at most, each with a pass of its own over the texts, so no automaton or
broadcast grows with the corpus. Counts leave a task before they are more than HELD. Pairs are summed for TERMS_AT_ONCE
terms and two blocks of SOURCES_AT_ONCE sources a task; only sums, not terms, are then shuffled for each pair.

Null text, lang and source are the empty string. Repeated rows each count. A language without kept terms gives its pairs
value 0 and no term rows; groups without terms take part. An empty table gives none. Very long texts are whole strings in a
task, no more. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.llm.common import read, stored

#: All ASCII characters but letters end a term; a-z stand for A-Z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MIN_DOCS = 30
FIRST_RANKS = 50
SHARE = 1_000_000_000
SMOOTH = 5
TERMS = 200_000
HELD = 400_000
#: (language, source) groups up to this many are broadcast; more are joined by shuffles.
FEW_GROUPS = 100_000
TERMS_AT_ONCE = 4096
SOURCES_AT_ONCE = 256

TEXTS = "lang string, source string, text string"
POSTINGS = "lang string, source string, term string, n long"


def terms_of(text: str) -> list[bytes]:
    """The text's terms in order, as UTF-8: runs of letters a-z and characters beyond ASCII, only A-Z lower-cased."""
    return text.encode().translate(FOLD).split()


def texts_of(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))))


def columns_of(batch: pa.RecordBatch) -> zip:
    return zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True)


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): documents of the task with the term, perhaps in several rows."""
    held: dict[str, Counter] = defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            made = [pa.array([lang]).take(pa.array(np.zeros(len(counts), int))), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(made, ["lang", "term", "n"])
        held.clear()

    for batch in batches:
        for lang, _, text in columns_of(batch):
            held[lang].update(set(terms_of(text)))
        if sum(map(len, held.values())) > HELD:
            yield from rows()
    yield from rows()


def automata(terms: list[tuple[str, str]]) -> dict[str, ahocorasick.Automaton]:
    """An automaton for each language, of its terms between delimiters; a match's value is the term's place in the list."""
    made: dict[str, ahocorasick.Automaton] = defaultdict(ahocorasick.Automaton)
    for k, (lang, term) in enumerate(terms):
        made[lang].add_word(f" {term} ", k)
    for one in made.values():
        one.make_automaton()
    return dict(made)


def occurrences(batches: Iterator[pa.RecordBatch], terms: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """POSTINGS of the task for the terms (lang, term), perhaps in several rows."""
    found, names, place = automata(terms), pa.array([t for _, t in terms], pa.string()), itemgetter(1)
    held: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for group, counts in held.items():
            made = [pa.array([c]).take(pa.array(np.zeros(len(counts), int))) for c in group]
            made += [names.take(pa.array(list(counts), pa.int64())), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(made, ["lang", "source", "term", "n"])
        held.clear()

    for batch in batches:
        for lang, source, text in columns_of(batch):
            if lang in found and (words := terms_of(text)):
                held[lang, source].update(map(place, found[lang].iter(f" {b' '.join(words).decode()} ")))
        if sum(map(len, held.values())) > HELD:
            yield from rows()
    yield from rows()


def kept_terms(texts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term) of terms in at least min_docs documents of the language."""
    counted = texts.mapInArrow(document_counts, "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")


def postings(texts: DataFrame, kept: DataFrame) -> DataFrame:
    """POSTINGS: how often each kept term occurs in each source of its language, where it does."""
    blocks = max(1, -(-kept.count() // (TERMS // 2)))  # twice the room that evenly dealt terms need
    kept = kept.withColumn("block", F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)))
    made = None
    for b in range(blocks):
        terms = [(r["lang"], r["term"]) for r in kept.where(F.col("block") == b).select("lang", "term").toLocalIterator()]
        found = texts.mapInArrow(lambda batches, terms=terms: occurrences(batches, terms), POSTINGS)
        made = found if made is None else made.union(found)
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SHARE * (count + SMOOTH) / (total + SMOOTH * terms)), exact for any long; 1 without terms."""
    whole = F.lit(SHARE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    part = (total.cast("decimal(20,0)") + terms.cast("decimal(19,0)") * SMOOTH).cast("decimal(24,0)")
    return F.when(terms > 0, 1 + F.call_function("div", whole, part)).otherwise(1)


def small(groups: DataFrame) -> DataFrame:
    """groups, to be broadcast if they are few."""
    return F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups


def with_blocks(groups: DataFrame) -> DataFrame:
    """groups with the number of blocks that the sources and the terms of their language are dealt to."""
    sizes = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.ceil(F.count("*") / SOURCES_AT_ONCE).alias("source_blocks"), F.greatest(F.ceil(F.max("terms") / TERMS_AT_ONCE), F.lit(1)).alias("term_blocks"))
    return groups.join(sizes, "lang")


def summed_differences(groups: DataFrame, valued: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources. groups: (lang, source, terms, none), valued: (lang, source, term, p)."""
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    meets = F.struct(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def dealt(rows: DataFrame, part: Column) -> DataFrame:  # to every task in which the source's block meets another
        rows = rows.withColumn("part", part).withColumn("own", F.pmod(F.xxhash64("source"), F.col("source_blocks")))
        return rows.withColumn("other", each("source_blocks")).withColumn("m", meets)

    heads = dealt(groups.withColumns({"term": F.lit(None).cast("string"), "p": F.lit(None).cast("long")}), each("term_blocks"))
    body = dealt(valued.withColumn("none", F.lit(None).cast("long")), F.pmod(F.xxhash64("term"), F.col("term_blocks")))
    columns = ["lang", "part", F.col("m.a").alias("a"), F.col("m.b").alias("b"), "own", "source", "none", "term", "p"]

    def differences(table: pa.Table) -> pa.Table:
        lang, a, b = (table[c][0].as_py() for c in ("lang", "a", "b"))
        source, term = table["source"].to_pylist(), table["term"].to_pylist()
        heads = {s: (own, none) for s, own, none in zip(source, table["own"].to_pylist(), table["none"].to_pylist(), strict=True) if none is not None}
        row = {s: k for k, s in enumerate(heads)}
        column: dict[str, int] = {}
        for t in term:
            if t is not None:
                column.setdefault(t, len(column))
        p = np.repeat(np.array([[none] for _, none in heads.values()], np.int64), len(column), axis=1)
        for s, t, v in zip(source, term, table["p"].to_pylist(), strict=True):
            if t is not None:
                p[row[s], column[t]] = v
        names, owns = list(heads), np.array([own for own, _ in heads.values()])
        left, right = np.flatnonzero(owns == a), np.flatnonzero(owns == b)
        out: list[list] = [[], [], [], []]
        for i in left:
            sums = np.abs(p[right] - p[i]).sum(axis=1)
            gaps = [abs(heads[names[i]][1] - heads[names[j]][1]) for j in right]
            for j, v, gap in zip(right.tolist(), sums.tolist(), gaps, strict=True):
                if i != j:
                    for s, t in [(i, j), (j, i)][: 1 + (a != b)]:
                        for col, value in zip(out, (names[s], names[t], v, gap), strict=True):
                            col.append(value)
        n = len(out[0])
        made = [[lang] * n, *out, [len(column)] * n]
        types = [pa.string()] * 3 + [pa.int64()] * 3
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("lang", "source", "item", "value", "gap", "met"), made, types, strict=True)})

    found = "lang string, source string, item string, value long, gap long, met long"
    parts = heads.select(*columns).union(body.select(*columns)).groupBy("lang", "part", "a", "b").applyInArrow(differences, found)
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.max("gap").alias("gap"), F.sum("met").alias("met"))
    # Terms that neither source's block has differ by the values for count 0.
    terms = groups.groupBy("lang").agg(F.max("terms").alias("terms"))
    rest = (F.col("terms") - F.col("met")) * F.col("gap")
    return summed.join(terms, "lang").select("lang", "source", "item", (F.col("value") + rest).alias("value"))


def audit(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, first_ranks: int = FIRST_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank); see above. Ranks go by value, largest first, then by item."""
    texts = texts_of(docs, lang_col, source_col, text_col)
    kept = stored(kept_terms(texts, min_docs), "kept-terms")
    found = stored(postings(texts, kept), "postings")
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"))
    groups = stored(with_blocks(groups.withColumn("none", share(zero, F.col("total"), F.col("terms")))), "groups")
    valued = found.join(small(groups.drop("none")), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    pairs = summed_differences(groups, valued)
    whole = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    ahead = valued.join(whole, ["lang", "term"]).withColumn("value", F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
    ahead = ahead.where(F.col("value") > 0).select("lang", "source", F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    made = [("pair", pairs.withColumn("rank", rank)), ("term", ahead.withColumn("rank", rank).where(F.col("rank") <= first_ranks))]
    return made[0][1].withColumn("part", F.lit("pair")).unionByName(made[1][1].withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(read(spark, sf_dir, "documents"))


SQL = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
o as (select lang, source, doc, unnest(terms) as term from d),
k as (select lang, term from o group by lang, term having count(distinct doc) >= 30),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*)::hugeint as n from o join k using (lang, term) group by all),
v as (select lang, count(*)::hugeint as v from k group by lang),
gt as (select lang, source, coalesce(sum(n), 0)::hugeint as total from g left join c using (lang, source) group by all),
gp as (select k.lang, gt.source, k.term, coalesce(n, 0) as n, 1 + (1000000000 * (coalesce(n, 0) + 5)) // (total + 5 * v) as p
  from k join v using (lang) join gt using (lang) left join c on c.lang = k.lang and c.source = gt.source and c.term = k.term),
lt as (select lang, sum(total)::hugeint as total from gt group by lang),
lp as (select lang, term, 1 + (1000000000 * (ln + 5)) // (total + 5 * v) as q
  from (select lang, term, sum(n)::hugeint as ln from gp group by all) join lt using (lang) join v using (lang)),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from gp x join gp y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
    on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, term as item, (p - q)::bigint as value from gp join lp using (lang, term) where n > 0 and p > q),
r as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
  union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::int from terms)
select * from r where part = 'pair' or rank <= 50
"""
