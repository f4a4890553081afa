"""Each query opN_ over tables in a folder: columns, types, and values against plain versions."""

import collections
import math
import os
import subprocess
import sys
import zlib

import numpy as np
import pytest
from fixtures import prose, rows
from test_duplicates import plain_classes, plain_fingerprint, plain_removal
from test_filters_and_counts import plain_statistics

from bazaarlake.llm import catalog, quality_rules, tokens

TYPES = {
    "op1_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op2_suffix_array_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op3_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op4_benchmark_decontamination": "doc_id bigint, item_id bigint",
    "op5_url_filters": "page_id bigint, host string, path string, rule string, verdict string",
    "op6_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op7_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op8_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op10_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op11_topk_search": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op12_fill_in_middle": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
    "op13_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
}
DOCS = [*rows(), (60, "²½Ⅻ 12 !!", "en", "a", 9), (61, "x", "en", "a", 1)]
ITEMS = [(1, prose(1, 40)), (2, None), (None, prose(777, 30)), (3, "")]
PAGES = [(1, "https://a.example.net/en/1", "<body><nav>menu</nav><article><p>One &amp; two<p>three</article></body>"), (2, None, None), (3, "http://casino-bonus.example.org/x", ""), (1, "https://a.example.net/en/1", "<p>again")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = DOCS + [(70, prose(1, 40) + " " + prose(778, 60), "de", "a", 1), (71, prose(777, 30) + " " + prose(779, 60), "de", "a", 1)]
    tables = {"documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"), "benchmark": (ITEMS, "item_id long, text string"), "pages": (PAGES, "page_id long, url string, html string")}
    for name, (found, schema) in tables.items():
        spark.createDataFrame(found, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path, docs


@pytest.fixture(scope="module")
def found(spark, folder):
    made = {}

    def run(name):
        if name not in made:
            df = catalog.QUERIES[name](spark, folder[0])
            types = dict(df.dtypes)
            want = dict(x.split(" ") for x in TYPES[name].split(", "))
            assert {k: types.get(k) for k in want} == want
            made[name] = df.collect()
        return made[name]

    return run


def by_doc(found, *columns):
    return sorted((tuple(r[c] for c in columns) for r in found), key=repr)


def held_out(key, remainder):
    return key is None or zlib.crc32(str(key).encode()) % 5 == remainder


def test_op1(found, folder):
    got = found("op1_quality_rules")
    want = []
    for r in folder[1]:
        s = plain_statistics(r[1])
        want.append((r[0], *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert by_doc(got, *names) == sorted(want, key=repr)
    assert all(r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5) for r in got)


def plain_em(votes, rounds):
    """Posterior of good for each row of votes, by expectation-maximisation in numpy."""
    believed = {-1: (0.01, 0.4), 0: (0.1, 0.2), 1: (0.89, 0.4)}
    share = np.where(votes.min(axis=1) == -1, 0.1, 0.9)
    for _ in range(rounds):
        good, bad = share.sum(), (1 - share).sum()
        odds = np.full(len(votes), math.log((good + 1) / (bad + 1)))
        for k in range(votes.shape[1]):
            for v, (p, q) in believed.items():
                hit = votes[:, k] == v
                odds += hit * math.log(((share * hit).sum() + 2 * p) / (good + 2) / ((((1 - share) * hit).sum() + 2 * q) / (bad + 2)))
        share = 1 / (1 + np.exp(-odds))
    return share


def test_estimated_accuracies_are_those_of_numpy(spark):
    rng = np.random.default_rng(2)
    truth = rng.random(600) < 0.7
    votes = np.array([np.where(rng.random(600) < 0.2, 0, np.where((rng.random(600) < right) == truth, 1, -1)) for right in (0.95, 0.8, 0.7, 0.9)]).T
    df = spark.createDataFrame([tuple(map(int, x)) for x in votes], "v0 int, v1 int, v2 int, v3 int")
    evidence = quality_rules.estimate(df, 4)
    p = quality_rules.posterior([df[c] for c in df.columns], evidence)
    got = [r["p"] for r in df.select("*", p.alias("p")).collect()]
    assert got == pytest.approx(plain_em(votes, quality_rules.ROUNDS), rel=1e-6)
    assert ((np.array(got) > 0.5) == truth).mean() > 0.93


def test_op2(found, folder):
    want = plain_removal(folder[1])
    got = found("op2_suffix_array_dedup")
    assert len(got) == len(folder[1])
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


def library_ids(text):
    return tokens.coder(tokens.tokenizer_path()).whole.encode(text or "", add_special_tokens=False).ids


def test_op3(found, folder):
    want = [(r[0], len((r[1] or "").encode()), len(library_ids(r[1])), len(library_ids(r[1])) > 2048) for r in folder[1]]
    assert by_doc(found("op3_token_counts"), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert {x[3] for x in want} == {True, False}


def test_op4(found):
    assert by_doc(found("op4_benchmark_decontamination"), "doc_id", "item_id") == sorted([(7, 1), (8, 1), (70, 1), (71, None)], key=repr)


def test_op5(found):
    got = by_doc(found("op5_url_filters"), "page_id", "host", "path", "rule")
    want = [(1, "a.example.net", "/en/1", "example.net/en/")] * 2 + [(2, "", "", None), (3, "casino-bonus.example.org", "/x", None)]
    assert got == sorted(want, key=repr)
    assert {(r["page_id"], r["verdict"]) for r in found("op5_url_filters")} >= {(1, "allow"), (3, "block")}


def test_op6(found, folder):
    split = [(r[0], [w.decode() for w in (r[1] or "").encode().lower().split()]) for r in folder[1]]
    counts = collections.Counter(w for k, words in split if not held_out(k, 1) for w in [*words, None])
    total, distinct = sum(counts.values()), len(counts)
    want = [(k, held_out(k, 1), len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), total) for k, w in split]
    got = found("op6_lm_scoring")
    assert by_doc(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens") == sorted(want, key=repr)
    base = collections.defaultdict(list)
    for k, w in split:
        base[k].append(sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in [*w, None]))
    assert all(any(r["base_score"] == pytest.approx(x) for x in base[r["doc_id"]]) and r["score"] < 0 for r in got)
    assert {r["score"] for r in got if r["doc_id"] == 5} == {r["score"] for r in got if r["doc_id"] == 4}


def test_op7(found):
    want = [(1, "https://a.example.net/en/1", "One & two three", 15), (1, "https://a.example.net/en/1", "again", 5), (2, None, "", 0), (3, "http://casino-bonus.example.org/x", "", 0)]
    assert by_doc(found("op7_html_extraction"), "page_id", "url", "text", "n_chars") == sorted(want, key=repr)


def test_op8(found, folder):
    got = found("op8_language_id")
    assert by_doc(got, "doc_id", "held_out") == sorted(((r[0], None if r[0] is None else held_out(r[0], 0)) for r in folder[1]), key=repr)
    languages = {r[2] for r in folder[1] if r[2]}
    no_letters = {0, 1, 2, 3, 60}
    for r in got:
        assert r["lang_pred"] == "und" if r["doc_id"] in no_letters else r["lang_pred"] in languages
        assert 0 <= r["score"] <= 1


def test_op9(found, folder):
    got = found("op9_packing")
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for key, same in collections.Counter((r[0], r[1]) for r in folder[1]).items():
        ids = np.array([*library_ids(key[1]), 1], "<u4")
        own = sorted((r for r in pieces[key[0]] if r["doc_tokens"] == len(ids)), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids) * same or key[0] in (0, 1, 2)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own) or key[0] is None
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1 + sum(r["length"] for r in got) / 2048 * 1.1


def test_op10(found, folder):
    pairs = [(r[0], plain_fingerprint(r[1])) for r in folder[1]]
    classes = plain_classes(pairs)
    want = [(k, f"{f:016x}", classes[f]) for k, f in pairs]
    assert by_doc(found("op10_simhash_near_dedup"), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


@pytest.mark.parametrize("cpus", [4])
def test_packing_returns_in_a_fresh_process(cpus):
    """With the process's default threads: a threaded linear algebra library once blocked the driver here."""
    code = f"""
from bazaarlake.session import local_session
from bazaarlake.llm.packing import op9_packing
print("sequences", op9_packing(local_session({cpus}), "/root/testdata/sf0.01").select("sequence_id").distinct().count())
"""
    threads = ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")
    env = {k: v for k, v in os.environ.items() if k not in threads} | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    assert 442 <= int(done.stdout.split("sequences")[1]) <= 445  # 442 is the least possible
