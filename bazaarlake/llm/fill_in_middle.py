"""Fill-in-the-middle: texts cut into prefix, middle and suffix at unit boundaries, and put together in another order.

The cuts are found by relational operators. A unit is a match of a pattern whose matches tile the text (a code point; or
words with the white space after them). The texts are dealt once by row number; everything else stays where they are:
  pages   matches of up to PAGE units, one row each (posexplode); windows give the units and code points before each page;
  cuts    a row for each cut request, with the ordinal of the last unit before the cut, joined to the page that holds it;
  units   the matches within those pages only, one row each; a window's running sum of their lengths gives the offset;
  offsets aggregated per document, joined to the text, which substring cuts.
So rows grow with the texts' length over PAGE and with the number of cuts, not with every code point.

Null text is empty: no units, form plain, empty output. Very long texts are many pages of one row number, in one task's
sorted run. Repeated rows keep row numbers of their own and give equal results; they depend on the id and the text alone.
A null id hashes as the text `1:`. An empty table gives none. Extra columns are kept; columns with the names that this adds
are replaced. docs should come from a table: row numbers are those of Spark's scan, kept by the one shuffle of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.llm.common import read

#: Units in a page: about the square root of a text's usual length, so that pages and units of hit pages are alike in number.
PAGE = 64
CODE_POINTS = "(?s)."
#: The markers that stand before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


def draws(key: Column) -> list[Column]:
    """Four numbers from the sha256 of `1:` and the key: its first four groups of 8 hex digits."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def pages_of(texts: DataFrame, unit: str) -> DataFrame:
    """(_row, page, piece, units, chars): matches of up to PAGE units; all but a text's last page hold PAGE."""
    found = texts.select("_row", F.regexp_extract_all("text", F.lit(f"(?:{unit}){{1,{PAGE}}}+"), F.lit(0)).alias("pieces"))
    # Outer, so that Spark doesn't match a second time to filter texts without pages before the shuffle.
    pages = found.select("_row", (F.size("pieces") - 1).alias("last_page"), F.posexplode_outer("pieces").alias("page", "piece")).where("page is not null")
    units = F.when(F.col("page") == F.col("last_page"), F.regexp_count("piece", F.lit(unit))).otherwise(PAGE).cast("long")
    return pages.select("_row", "page", "piece", units.alias("units"), F.length("piece").cast("long").alias("chars"))


def cut_offsets(texts: DataFrame, cuts: dict[str, Column], unit: str) -> DataFrame:
    """(_row, n, and for each cut its offset in code points; null: 0), but for texts without units.

    cuts: how many units stand before it, from n and texts' columns.
    """
    none = F.lit(0).cast("long")
    pages = pages_of(texts, unit)
    totals = pages.groupBy("_row").agg(F.sum("units").alias("n"))
    counted = texts.drop("text").join(totals, "_row", "left").withColumn("n", F.coalesce("n", none))
    asked = counted.select("_row", F.explode(F.array(*(F.struct(F.lit(k).alias("cut"), (c - 1).alias("last")) for k, c in cuts.items()))).alias("c"))
    asked = asked.select("_row", "c.*").where(F.col("last") >= 0)  # a cut before the first unit has offset 0
    before = Window.partitionBy("_row").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    placed = pages.withColumns({c + "_before": F.coalesce(F.sum(c).over(before), none) for c in ("units", "chars")})
    holds = (F.col("last") >= F.col("units_before")) & (F.col("last") < F.col("units_before") + F.col("units"))
    hit = placed.join(asked, "_row").where(holds)
    each = F.posexplode(F.regexp_extract_all("piece", F.lit(unit), F.lit(0))).alias("ordinal", "unit")
    units = hit.select("_row", "cut", "chars_before", (F.col("last") - F.col("units_before")).alias("within"), each)
    running = Window.partitionBy("_row", "cut").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    ends = units.withColumn("end", F.col("chars_before") + F.sum(F.length("unit")).over(running)).where(F.col("ordinal") == F.col("within"))
    offsets = ends.groupBy("_row").agg(*(F.max(F.when(F.col("cut") == k, F.col("end"))).alias(k) for k in cuts))
    return totals.join(offsets, "_row", "left")


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINTS, plain_of_100: int = 10, spm_of_100: int = 20) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), and output.

    psm is prefix, suffix, middle; spm suffix, prefix, middle; each behind its marker. A text that holds a marker stays
    plain, so that outputs can be taken apart again (see restored).
    """
    kept = docs.drop(*(c for c in docs.columns if c.lower() in ADDED))
    # A row's columns move as one value, so that every use below reads the same shuffle of the texts.
    dealt = kept.select(F.monotonically_increasing_id().alias("_row"), F.array(F.struct(*kept.columns)).alias("_all")).repartition("_row")
    d = F.element_at("_all", 1)
    key, whole = d[id_col], F.coalesce(d[text_col], F.lit(""))
    h = draws(key)
    narrow = dealt.select("_row", whole.alias("text"), h[0].alias("h1"), h[1].alias("h2"))
    at = [F.col(f"h{k}") % (F.col("n") + 1) for k in (1, 2)]
    offsets = cut_offsets(narrow, {"_first": F.least(*at), "_second": F.greatest(*at)}, unit)
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "_first", "_second")]
    cut = dealt.join(offsets.hint("shuffle_hash"), "_row", "left").select(*numbers, key.alias("_id"), whole.alias("_text"), d.alias("_kept"))
    text, h = F.col("_text"), draws(F.col("_id"))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (h[2] % 100 >= 100 - plain_of_100), "plain").when(h[3] % 100 < spm_of_100, "spm").otherwise("psm")
    cut = cut.withColumn("form", form)
    first, second = F.col("_first").cast("int"), F.col("_second").cast("int")
    prefix = F.concat(F.lit(PREFIX), F.substring(text, F.lit(1), first))
    middle = F.concat(F.lit(MIDDLE), F.substring(text, first + 1, second - first))
    suffix = F.concat(F.lit(SUFFIX), F.substring(text, second + 1, F.length(text)))
    output = F.when(F.col("form") == "psm", F.concat(prefix, suffix, middle)).when(F.col("form") == "spm", F.concat(suffix, prefix, middle)).otherwise(text)
    lengths = [F.when(F.col("form") != "plain", c) for c in (F.col("_first"), F.col("_second") - F.col("_first"))]
    made = cut.select("_kept", "n", "form", lengths[0].alias("prefix_chars"), lengths[1].alias("middle_chars"), output.alias("output"))
    return made.select("_kept.*", *ADDED)


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle made output from; by the markers alone."""
    place = lambda marker: F.instr(output, marker)
    p, s, m = (place(x) for x in (PREFIX, SUFFIX, MIDDLE))
    length = F.length(output)
    until = lambda start, stop: F.substring(output, start + 3, stop - start - 3)
    psm = F.concat(until(p, s), until(m, length + 1), until(s, m))
    spm = F.concat(until(p, m), until(m, length + 1), until(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form and cuts, and digests of its output and of the text restored from that."""
    made = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = """
with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id) as d from documents),
h as (
  select doc_id, text, length(text) as n, ('0x' || substr(d, 1, 8))::bigint as h1, ('0x' || substr(d, 9, 8))::bigint as h2,
    ('0x' || substr(d, 17, 8))::bigint as h3, ('0x' || substr(d, 25, 8))::bigint as h4 from t
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form from h
), o as (
  select *, '<P>' || substr(text, 1, a) as p, '<M>' || substr(text, a + 1, b - a) as m, '<S>' || substr(text, b + 1) as s from c
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'psm' then p || s || m when 'spm' then s || p || m else text end) as output_sha256,
  sha256(text) as restored_sha256 from o
"""
