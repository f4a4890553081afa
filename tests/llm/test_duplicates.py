"""SimHash classes and removed passages against brute force."""

import hashlib
import itertools

import numpy as np
import pytest
import xxhash
from fixtures import clashing, documents, empty, prose, rows

from bazaarlake.llm import near_copies, simhash, suffix_dedup


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(pairs, radius=4):
    """Smallest id reachable from each fingerprint; pairs of (id, fingerprint)."""
    fps = sorted({f for _, f in pairs})
    group = {f: f for f in fps}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            group[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for key, f in pairs:
        if key is not None:
            least[root(f)] = min(key, least.get(root(f), key))
    return {f: least.get(root(f)) for f in fps}


@pytest.mark.parametrize("change", [lambda d: d, clashing])
def test_classes(spark, change):
    pairs = [(r[0], plain_fingerprint(r[1])) for r in rows()]
    classes = plain_classes(pairs)
    found = simhash.near_duplicates(change(documents(spark))).collect()
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found), key=repr) == sorted(((k, f, classes[f]) for k, f in pairs), key=repr)


def test_one_of_each_class_stays(spark):
    docs = clashing(documents(spark))
    kept = simhash.keep_first(docs)
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert kept.columns == docs.columns and 4 in ids and 5 not in ids and len(ids) == len(set(ids))
    assert simhash.keep_first(empty(spark)).count() == 0


def test_rows_without_id_and_ids_of_two_texts_stay(spark):
    """Several texts without an id, one of them a copy of a kept one, and one id with two texts."""
    a, b, c, d = (prose(50 + k, 80) for k in range(4))
    docs = clashing(spark.createDataFrame([(None, a), (None, b), (None, b), (None, c), (1, c), (2, c), (7, d), (7, a + b), (7, d)], "doc_id long, text string"))
    kept = simhash.keep_first(docs).collect()
    want = [(None, a), (None, b), (1, c), (7, d), (7, a + b)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("group", [1024, 8])
def test_texts_of_similar_shingles_are_copies(spark, monkeypatch, group):
    """Against all pairs; also with so small a bound for classes that they are dealt to several tasks."""
    monkeypatch.setattr(near_copies.exact_links, "__defaults__", (group,))
    rng = np.random.default_rng(4)
    texts = []
    for k in range(4):
        words = prose(70 + k, 200).split()
        for _ in range(25):
            other = list(words)
            for at in rng.integers(0, 200, rng.integers(0, 7)):
                other[int(at)] = f"new{rng.integers(1000)}"
            texts.append(" ".join(other))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    group_of = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((group_of[a], group_of[b]))
            group_of = [low if g == high else g for g in group_of]
    kept = simhash.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(group_of)) and 4 <= len(set(group_of)) < 50


def test_fingerprints_name_candidates_and_similarity_decides(spark, monkeypatch):
    """Without a key of MinHash; two texts that mostly say one thing over and over are near by fingerprint only."""
    monkeypatch.setattr(near_copies, "band_keys", lambda found: [])
    often = " ".join(prose(90, 5).split() * 60)
    text = prose(95, 400)
    texts = [text, f"{often} {prose(91, 12)}", f"{often} {prose(92, 12)}", text.rsplit(" ", 1)[0], prose(96, 200), f"{text} x"]
    fps = [simhash.fingerprint(t) for t in texts]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in ((0, 3), (0, 5), (1, 2)))
    kept = simhash.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 1, 2, 4]


@pytest.mark.parametrize("bucket", [8192, 8])
def test_links_join_all_within_the_radius(spark, bucket):
    """Also with so small a bound for buckets that midpoints take over."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    fps = {centre} | {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 8), replace=False)) for _ in range(60)}
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)}
    signed = [int(np.array(f, np.uint64).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    classes = plain_classes([(k, f) for k, f in enumerate(sorted(fps))])
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash.components(simhash.near_links(df, 4, bucket)).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(classes[f], set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_links_across_the_sign_bit():
    """Three and more values of one bucket that differ in bit 63 and one to three other bits."""
    signed = np.array([0, 1 << 63 | 1, 1 << 63 | 1 << 20 | 1 << 40, 1 << 63 | 0b111 << 30], np.uint64).view(np.int64)
    for values in (signed[[0, 1, 3]], signed[[0, 2, 3]], signed):
        links = simhash.spanning(values, 4)
        assert len(links) == len(values) - 1 and {x for link in links for x in link} == set(values.tolist())
        assert all(((x ^ y) % 2**64).bit_count() <= 4 for x, y in links)


def test_masks_cover_every_pattern():
    masks = [m % 2**64 for m in simhash.masks(4)]
    rng = np.random.default_rng(1)
    for _ in range(3000):
        pattern = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not m & pattern for m in masks)


def plain_removal(found):
    """By document: bytes, removed, spans, digest of the rest; rows of one document count once."""
    seen, out = set(), {}
    for key, text in sorted({(r[0], r[1] or "") for r in found}, key=lambda x: (x[0] is not None, x[0] or 0)):
        data = text.encode()
        covered = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                covered[s : s + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for i, c in enumerate(covered) if c and (not i or not covered[i - 1]))
        kept = bytes(b for b, c in zip(data, covered, strict=True) if not c)
        out[key] = (len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("cap", "block"), [(64, 1 << 20), (1, 1 << 20), (64, 700)])
def test_removal(spark, monkeypatch, cap, block):
    """With parts compared in a task, cut down to single windows, and with texts that fill several blocks."""
    monkeypatch.setattr(suffix_dedup, "CAP", cap)
    sizes = [len((r[1] or "").encode()) for r in rows()]
    if block < 1 << 20:
        found = list(suffix_dedup_blocks(sizes, block, monkeypatch))
        assert all(sum(p[2] for p in b) <= block for b in found)
    docs = clashing(documents(spark))
    done = suffix_dedup.without_repeats(docs).selectExpr("row.doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) as digest").collect()
    want = plain_removal(rows())
    assert len(done) == len(rows())
    for r in done:
        assert tuple(r)[1:] == want[r["doc_id"]], r["doc_id"]


def suffix_dedup_blocks(sizes, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    found = list(suffix_dedup.blocks(sizes))
    monkeypatch.undo()
    return found


def test_texts_without_repeats(spark):
    docs = documents(spark)
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows())
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    assert {r["doc_id"]: r["text"] for r in out.collect()}[4] == rows()[4][1]


def test_repeated_rows_count_once(spark):
    """Rows that repeat a document in several partitions, alone and with parts that stand elsewhere too."""
    a, b, c = prose(91, 120), prose(92, 120), prose(93, 120)
    found = [(1, a), (2, b), (1, a), (3, c), (2, b), (1, a), (4, c[:300] + b[:300]), (4, c[:300] + b[:300])]
    for parts in (1, 4, 8):
        docs = spark.createDataFrame(found, "doc_id long, text string").repartition(parts)
        done = suffix_dedup.without_repeats(docs).selectExpr("row.doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) as digest").collect()
        want = plain_removal(found)
        assert len(done) == len(found) and all(tuple(r)[1:] == want[r["doc_id"]] for r in done)


@pytest.mark.parametrize(("cap", "tasks"), [(64, 6), (2, 6), (64, 1), (2, 1)])
def test_passage_of_very_many_documents(spark, monkeypatch, cap, tasks):
    """The ends of a passage with different surroundings share some windows each; one task may hold over CAP of them."""
    monkeypatch.setattr(suffix_dedup, "CAP", cap)
    passage = prose(94, 50)
    found = [(k, prose(200 + k, 30 + k % 7) + passage[k % 5 :] + prose(500 + k, 25)) for k in range(150)]
    docs = spark.createDataFrame(found, "doc_id long, text string").repartition(tasks)
    done = suffix_dedup.without_repeats(docs).selectExpr("row.doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) as digest").collect()
    want = plain_removal(found)
    assert all(tuple(r)[1:] == want[r["doc_id"]] for r in done)


def test_equal_hashes_of_different_strings_remove_nothing(monkeypatch):
    monkeypatch.setattr(suffix_dedup.Side, "hash", lambda self, i, j: 0)
    one, other = (bytes(rng) for rng in (range(100, 234), range(50, 184)))
    rows = [{"doc": k, "h": 0, "loc": 34, "part": x} for k, x in enumerate((one, other))]
    assert not list(suffix_dedup.repeats(rows))
    rows.append({"doc": 2, "h": 0, "loc": 34, "part": one})
    assert (2, 0, 0, 35) in list(suffix_dedup.repeats(rows))


def test_random_texts_of_few_letters(spark):
    rng = np.random.default_rng(3)
    pool = ["".join(rng.choice(list("ab"), 130)) for _ in range(4)] + ["".join(rng.choice(list("abcdef"), 90)) for _ in range(4)]
    found = [(k, "".join(pool[int(i)][int(rng.integers(0, 30)) :] for i in rng.integers(0, 8, 5))) for k in range(40)]
    docs = spark.createDataFrame(found, "doc_id long, text string")
    done = suffix_dedup.without_repeats(docs).selectExpr("row.doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) as digest").collect()
    want = plain_removal(found)
    assert all(tuple(r)[1:] == want[r["doc_id"]] for r in done)


def test_stored_tables_can_be_forgotten(spark, tmp_path):
    from bazaarlake.llm import common

    (a, one), (b, other) = (common.stored_at(spark.range(k + 1), "x") for k in range(2))
    assert (a.count(), b.count()) == (1, 2) and {one, other} <= set(common.STORED)
    common.forget(spark, [other])
    assert a.count() == 1 and other not in common.STORED
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        b.collect()
    common.forget(spark, [one])
