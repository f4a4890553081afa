"""Top-k search, fill-in-the-middle and the source audit against plain versions, and against SQL on the smallest tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from fixtures import clashing, documents, empty, rows
from oracle import connect, difference
from pyspark.sql import functions as F

from bazaarlake.llm import catalog, fill_in_middle, source_audit, topk_search

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(spark, name):
    assert difference(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF, connect(SF)) == ""


# Top-k search


def plain_top(vectors, is_query, k, scale=256):
    """(query_id, rank, vec_id, score) by all products, in Python's integers."""
    held = [(i, v[0], [math.floor(scale * c) for c in v[1]]) for i, v in enumerate(vectors) if v[1] is not None and all(c is not None and math.isfinite(c) for c in v[1])]
    out = []
    for i, key, q in held:
        if is_query(key):
            found = [(-min(max(sum(a * b for a, b in zip(q, x, strict=True)), -(2**63)), 2**63 - 1), other is None, other or 0, other) for j, other, x in held if j != i and len(x) == len(q)]
            out += [(key, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def vectors(seed, n, dim):
    rng = random.Random(seed)
    found = [(i, [rng.gauss(0, 1) * (1 + 9 * (j == 0)) for j in range(dim)]) for i in range(n)]
    found += [(n + i, [float(rng.randrange(-1, 2)) for _ in range(dim)]) for i in range(60)]  # ties
    found += [(2 * n, None), (2 * n + 1, [None] * dim), (2 * n + 2, [math.nan] * dim), (2 * n + 3, [math.inf] + [0.0] * (dim - 1)), (None, [3.0] * dim), (0, [0.0] * dim), found[0], found[5], found[5]]
    return found + [(2 * n + 10, []), (2 * n + 20, []), (2 * n + 30, [1.0]), (2 * n + 40, [0.0] * dim)]


@pytest.mark.parametrize("cells", [1 << 20, 200])
def test_top_k_is_that_of_all_products(spark, monkeypatch, cells):
    monkeypatch.setattr(topk_search, "CELLS", cells)
    found = vectors(1, 150, 4)
    df = spark.createDataFrame(found, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("x", "dim", "part", "place", "score", "rank")})
    got = topk_search.top_k(df.repartition(3), F.col("vec_id") % 10 == 0, 5)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == plain_top(found, lambda i: i is not None and i % 10 == 0, 5)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 10 == 0, 5).collect() == []


def test_large_components_are_exact(spark):
    found = [(i, [float(2**40 + i), float(-(2**39) * i)]) for i in range(12)]
    df = spark.createDataFrame(found, "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, F.col("vec_id") % 3 == 0, 4).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == plain_top(found, lambda i: i % 3 == 0, 4)


def test_walk_stops_early_where_a_dimension_rules():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 1, (5000, 4)) * [4000, 20, 20, 20])
    lists = np.argsort(x, axis=0, kind="stable").T.astype("<i4")
    for q in (np.array([100.0, 5, -5, 0]), np.array([-100.0, 0, 0, 1])):
        best, scored = topk_search.threshold_best(x, lists, q, 5)
        assert best == sorted(((int(s), i) for i, s in enumerate(x @ q)), key=lambda b: (-b[0], b[1]))[:5]
        assert scored < 2500


# Fill-in-the-middle


def plain_cut(key, text, unit=r"(?s)."):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(unit, text)
    n = len(units)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (key, n, "plain", None, None, text)
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return (key, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (key, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


ODD = [(200 + k, t, "en", "a", 1) for k, t in enumerate(["a<P>b", "x <S>", "<M>", "<", "<P", "😀é" * 70, "\n\r\n\t " * 30, "z" * 64, "z" * 128, "😀" * 129, "a\u0000b", "ab" * 50_000])]


@pytest.mark.parametrize(("unit", "plain_unit"), [(fill_in_middle.CODE_POINTS, r"(?s)."), (r"\S+\s*|\s+", r"\S+\s*|\s+")])
def test_cuts_are_those_of_python(spark, unit, plain_unit):
    found = [*rows(), *ODD]
    docs = spark.createDataFrame(found, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = fill_in_middle.fill_in_middle(clashing(docs).withColumn("output", F.lit(1)).withColumn("FORM", F.lit(2)), unit=unit)
    assert got.columns.count("output") == 1 and {"lang", "row", "_id", "n_chars"} < set(got.columns)
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    if unit == fill_in_middle.CODE_POINTS:
        want = [plain_cut(r[0], r[1], plain_unit) for r in found]
    else:  # the space of Java's \s
        want = [plain_cut(r[0], r[1], r"(?a:\S+\s*|\s+)") for r in found]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want, key=repr)
    back = got.select(F.coalesce("text", F.lit("")).alias("t"), fill_in_middle.restored(F.col("output"), F.col("form")).alias("b"))
    assert back.where("t <> b or b is null").count() == 0
    assert {r["form"] for r in got.select("form").collect()} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(empty(spark)).collect() == []


# Source audit


def plain_audit(found, min_docs, ranks=50):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))) for _, text, lang, source, _ in found]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= min_docs]
        counts = {s: collections.Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}
        counts[None] = collections.Counter(t for d in own for t in d[2])
        total = {s: sum(c[t] for t in kept) for s, c in counts.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s, c in counts.items()}
        for s in counts:
            if s is not None:
                pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o not in (s, None)]
                terms = [(p[None][t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
                out += [(lang, s, "pair", x[2], -x[0], r + 1) for r, x in enumerate(sorted(pairs))]
                out += [(lang, s, "term", x[2], -x[0], r + 1) for r, x in enumerate(sorted(terms)[:ranks])]
    return sorted(out)


AUDITED = [*rows(), *((300 + k, f"Ärger ärger über{k % 3} the_The x1y ŻÓŁĆ żółć {'mill ' * k}", ["en", None, "pl"][k % 3], [None, "q", "r", "s"][k % 4], 1) for k in range(40)), (400, "", "en", "no terms", 0), (401, "...", "xx", "y", 0), (402, None, "xx", "z", 0)]


@pytest.mark.parametrize(("terms", "sources", "block"), [(4096, 256, 200_000), (3, 2, 20)])
def test_audit_is_that_of_python(spark, monkeypatch, terms, sources, block):
    for name, value in (("TERMS_AT_ONCE", terms), ("SOURCES_AT_ONCE", sources), ("TERMS", block), ("HELD", 20), ("FEW_GROUPS", 3 * terms)):
        monkeypatch.setattr(source_audit, name, value)
    docs = spark.createDataFrame(AUDITED, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = source_audit.audit(clashing(docs), min_docs=5, first_ranks=7)
    want = plain_audit(AUDITED, 5, 7)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len({w[1] for w in want if w[0] == "en"}) > 4 and any(w[4] for w in want if w[2] == "pair")


def test_audit_of_nothing(spark):
    assert source_audit.audit(empty(spark)).collect() == []
    assert [tuple(r)[3:] for r in source_audit.audit(documents(spark, 2), min_docs=1).collect()] == []


def test_automaton_counts_whole_terms_only():
    found = source_audit.automata([("en", "art"), ("en", "part"), ("en", "a")])["en"]
    assert collections.Counter(t for _, t in found.iter(" a a part art parts a ")) == {0: 1, 1: 1, 2: 3}
    assert list(found.iter("art")) == []
