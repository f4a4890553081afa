"""Decontamination, LM scoring, HTML extraction, language identification, packing and the pipeline."""

import collections
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from fixtures import WORDS, clashing, documents, empty, prose, rows

from bazaarlake.llm import attention_lm, decontaminate, html_text, language_id, packing, tokens, word_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_leaks(spark):
    items = [(k, prose(500 + k, 30)) for k in range(12)] + [(90, None), (91, "")]
    changed = items[3][1].split()
    changed[4], changed[17] = "ocean", "towers"
    docs = [(k, prose(700 + k, 200)) for k in range(60)]
    docs[5] = (5, docs[5][1] + " " + items[0][1] + " " + prose(1, 50))
    docs[6] = (6, items[1][1])
    docs[7] = (7, prose(2, 25) + " " + " ".join(changed))
    docs += [(5, docs[5][1]), (None, items[2][1] + " tail"), (99, None), (98, "")]
    table = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table, benchmark).collect()), key=repr)
    assert found == sorted([(5, 0), (6, 1), (7, 3), (None, 2)], key=repr)
    kept = decontaminate.without_leaks(table, benchmark)
    assert kept.columns == table.columns and kept.count() == len(docs) - 5
    assert decontaminate.leaks(table, benchmark.limit(0)).count() == 0
    assert decontaminate.leaks(table.limit(0), benchmark).count() == 0


def test_recall_of_reworded_items(spark):
    """Items of 12 to 60 words with words left out, changed and put in, at any place; against all places of all texts."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(3000)]

    def text(n):
        return [vocabulary[int(len(vocabulary) * rng.random() ** 3)] for _ in range(n)]

    items = [(k, text(rng.randrange(12, 60))) for k in range(40)]
    docs = []
    for k in range(240):
        words = text(rng.randrange(60, 400))
        if k % 2:
            item, share = list(items[rng.randrange(40)][1]), rng.choice([0, 0.05, 0.1, 0.2])
            for _ in range(int(share * len(item))):
                at = rng.randrange(len(item))
                item[at : at + rng.randrange(2)] = text(rng.randrange(2))
            at = rng.randrange(len(words))
            words[at:at] = item
        docs.append((k, words))

    def holds(words, item):
        least, wanted = decontaminate.ORDER * len(item), set(item)
        for at in range(0, len(words), 4):
            part = words[at : at + len(item) + 12]
            if len(wanted.intersection(part)) >= 0.5 * len(wanted) and decontaminate.common_order(item, part) >= least:
                return True
        return False

    want = {(d, i) for d, words in docs for i, item in items if holds(words, item)}
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame, benchmark).where("in_order >= 0.75").collect()}
    assert len(want) > 80 and len(found & want) >= 0.95 * len(want) and len(found - want) <= 0.05 * len(want)


def test_singular_vectors_span_those_of_numpy(spark):
    """Of passages about 12 subjects, the 12 largest vectors hold nearly as much as the 12 best ones."""
    rng = random.Random(9)
    topics = [[f"w{k}x{j}" for j in range(40)] for k in range(12)]
    docs = [(k, " ".join(rng.choice(topics[k % 12]) for _ in range(60))) for k in range(200)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "doc_id as h", "text")
    weight, basis = decontaminate.latent_space(rows.mapInArrow(decontaminate.list_hashes, "doc_id long, h long, words binary"))
    cells = decontaminate.passages([decontaminate.word_hashes(t) for _, t in docs])[0]
    values = decontaminate.weigh(cells, weight)
    plain = np.zeros((len(cells), decontaminate.FEATURES + 1))
    np.add.at(plain, (np.arange(len(cells))[:, None], cells), values)
    best = (np.linalg.svd(plain[:, :-1], compute_uv=False)[:12] ** 2).sum()
    assert ((plain @ basis[:, :12]) ** 2).sum() >= 0.95 * best and np.allclose(basis.T @ basis, np.eye(decontaminate.RANK), atol=1e-4)


def test_common_order():
    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        assert decontaminate.common_order(a, b) == plain(a, b)


def held_out(key):
    return key is None or zlib.crc32(str(key).encode()) % 5 == 1


def test_base_scores(spark):
    found = attention_lm.score_texts(clashing(documents(spark))).collect()
    split = [(r[0], [w.decode() for w in (r[1] or "").encode().lower().split()]) for r in rows()]
    counts = collections.Counter(w for k, words in split if not held_out(k) for w in [*words, None])
    total, distinct = sum(counts.values()), len(counts)
    want = collections.defaultdict(list)
    for k, words in split:
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in [*words, None])
        want[k].append((held_out(k), len(words) + 1, sum(counts[w] > 0 for w in [*words, None]), total, base))
    assert len(found) == len(rows())
    for r in found:
        w = want[r["doc_id"]][0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4]) and r["score"] < 0
    assert attention_lm.score_texts(empty(spark)).count() == 0


def small_model(steps=60):
    """Of 51 ids, the last one the end; each third text has only small ids."""
    rng = np.random.default_rng(0)
    sample = [np.append(rng.integers(0, 40, 90) // (1 + k % 3), 50) for k in range(30)]
    near = np.zeros((51, 2 * attention_lm.NEAR))
    for x in sample:
        before = np.append(50, x[:-1])
        np.add.at(near, (x, attention_lm.mixed(before)), 1)
        np.add.at(near, (before, attention_lm.NEAR + attention_lm.mixed(x)), 1)
    model = attention_lm.prepared(near, np.arange(51) % 2 == 0)
    adam = attention_lm.Adam(model.weights)
    for turn in range(steps // 6):
        attention_lm.learn(model, adam, sample, turn, 1, 1)
    return model, sample


def test_every_text_is_learned_from():
    """Over the rounds: one in SHARE / ROUNDS windows of a text, each once; of a text with fewer windows one."""
    rng = np.random.default_rng(4)
    texts = [np.append(rng.integers(0, 50, n), 50) for n in (0, 1, 15, 16, 100, 230, 240, 255, 300, 5000, *range(3, 200, 7))]
    stream = attention_lm.Stream(texts, 50)
    picks = [attention_lm.chosen(stream, texts, turn).tolist() for turn in range(attention_lm.ROUNDS)]
    picked = [k for p in picks for k in p]
    assert len(set(picked)) == len(picked) and all(stream.nth[k] > 0 for k in picked)
    step = attention_lm.SHARE // attention_lm.ROUNDS
    for t, text in enumerate(texts):
        windows = -(-len(text) // attention_lm.STEP)
        own = sorted(int(stream.nth[k]) for k in picked if stream.text[k] == t)
        assert len(own) == 1 if windows < step else own == [k for k in range(1, windows + 1) if k % step == own[0] % step]


def test_every_window_is_learned_from_once():
    rng = np.random.default_rng(5)
    texts = [np.append(rng.integers(0, 50, n), 50) for n in (0, 15, 16, 255, 256, 300, 5000)]
    stream = attention_lm.Stream(texts, 50)
    picked = np.concatenate([attention_lm.chosen(stream, texts, turn) for turn in range(attention_lm.ROUNDS)])
    assert sorted(picked.tolist()) == np.flatnonzero(stream.nth).tolist()
    assert len(picked) == sum(-(-len(x) // attention_lm.STEP) for x in texts)


def plain_score(model, text):
    """log10 probability of ids, token by token, from formulas."""
    w, total = {k: x.astype(float) for k, x in model.weights.items()}, 0.0
    before = [model.end] * (attention_lm.WIDTH + 1)
    for k, token in enumerate(text):
        seen = (before + list(text))[k + 1 : k + len(before)]
        seen = seen[attention_lm.STEP - 1 - k % attention_lm.STEP :]  # a window starts at a multiple of STEP
        x = w["embed"][model.row[seen]]
        q = x[-1] @ w["query"] / math.sqrt(attention_lm.SIZE)
        bends = np.exp(np.clip(x @ w["key"] @ q, -30, 30) + w["distance"][np.arange(len(seen))[::-1]])
        y = x[-1] + bends / bends.sum() @ (x @ w["value"])
        logits = np.append(y, np.maximum(y @ w["up"] + w["up0"], 0)) @ w["head"]
        cell, last = model.cell[token], model.cell[seen[-1]]
        group = cell // attention_lm.BINS
        for part, at in ((logits[: attention_lm.GROUPS] + model.by_group[last], group), (logits[attention_lm.GROUPS :] + model.by_bin[last, group], cell % attention_lm.BINS)):
            part = np.clip(part, attention_lm.NEVER, 30)
            total += (part[at] - np.log(np.exp(part).sum())) / math.log(10)
        total += model.share[token]
    return total


def test_scores_are_those_of_each_token():
    model, sample = small_model()
    texts = [sample[0][:n] for n in (1, 15, 16, 17, 31, 32, 33, 90)] + sample[:5]
    want = [plain_score(model, x) for x in texts]
    assert attention_lm.scores(model, texts) == pytest.approx(want, rel=1e-4)
    assert attention_lm.scores(model, texts, 2) == pytest.approx(want, rel=1e-4)


def test_model_comes_from_all_training_documents(spark, monkeypatch):
    """Counts over all texts, in tasks; windows of all texts; and what is learned makes other texts more likely."""
    path = tokens.tokenizer_path()
    end = tokens.coder(path).whole.get_vocab_size()
    texts = [prose(k, 300) for k in range(60)]
    ids = [np.append(np.frombuffer(tokens.coder(path).ids(t), "<u4"), end).astype("<u2") for t in texts]
    df = spark.createDataFrame([(x.tobytes(),) for x in ids[10:]], "ids binary").repartition(3)
    near = attention_lm.neighbours(df, end)
    assert near[:, : attention_lm.NEAR].sum(axis=1).tolist() == np.bincount(np.concatenate(ids[10:]), minlength=end + 1).tolist()
    model = attention_lm.prepared(near, np.zeros(end + 1, bool))
    send = spark.sparkContext.broadcast
    after = attention_lm.ordered(df, send(model), "<u2")
    want = collections.Counter((int(model.cell[a]), int(model.cell[b])) for x in ids[10:] for a, b in zip([end, *x.tolist()], x.tolist()))
    cells = after.reshape(after.shape[0], -1)
    assert {(a, b): cells[a, b] for a, b in zip(*np.nonzero(cells))} == want
    mass = np.bincount(model.cell, near[:, : attention_lm.NEAR].sum(axis=1) + 0.5, after.shape[0])
    known = attention_lm.with_order(model, mass, after)
    n, weights = attention_lm.learned(df, send(known), "<u2", 0, 1, 1)
    assert n == sum(-(-len(x) // attention_lm.STEP) for x in ids[10:])
    each = [attention_lm.learned(df, send(known), "<u2", turn, 4, 4)[0] for turn in range(4)]
    assert sum(each) == n and min(each) > n / 5
    first, second, third = (attention_lm.scores(m, ids[:10]).sum() for m in (model, known, attention_lm.replace(known, weights=weights)))
    assert first < second < third


def test_gradients_are_the_slopes():
    model, sample = small_model(12)
    model.weights["head"] += 0.05
    model = attention_lm.replace(model, weights={k: v.astype(np.float64) for k, v in model.weights.items()})
    stream = attention_lm.Stream(sample[:3], 50)
    args = stream.windows(np.flatnonzero(stream.nth))
    _, g = attention_lm.gradients(model, *args)
    for name, w in model.weights.items():
        at = np.unravel_index(int(np.abs(g[name]).argmax()), w.shape)
        moved = []
        for step in (1e-4, -1e-4):
            w[at] += step
            moved.append(attention_lm.gradients(model, *args)[0])
            w[at] -= step
        assert g[name][at] == pytest.approx((moved[0] - moved[1]) / 2e-4, rel=0.02, abs=1e-5), name


def test_gradients_are_worked_out_in_parts(monkeypatch):
    """Sums over parts of the windows are those over all, and what is held is of a part's size, not of all windows."""
    model, sample = small_model(6)
    stream = attention_lm.Stream(sample, 50)
    args = stream.windows(np.flatnonzero(stream.nth)[: attention_lm.BATCH])
    tracemalloc.start()
    loss, g = attention_lm.gradients(model, *args)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 << 20
    for part in (1, 7, 1000):
        monkeypatch.setattr(attention_lm, "PART", part)
        other, found = attention_lm.gradients(model, *args)
        assert other == pytest.approx(loss, rel=1e-5) and found.keys() == g.keys() == model.weights.keys()
        assert all(np.allclose(found[k], g[k], rtol=1e-3, atol=1e-6) for k in g)


def listed_rows(docs, kind=pa.string()):
    block = word_model.Block(tokens.tokenizer_path())
    for k in range(0, len(docs), 3):
        part = docs[k : k + 3]
        block.add(pa.RecordBatch.from_arrays([pa.array(range(k, k + len(part))), pa.array(part, kind), pa.array([True] * len(part))], ["doc_id", "text", "train"]))
    return [r for batch in block.rows(5) for r in batch.to_pylist()]


def test_listed_words_and_ids():
    """Words are split and lower-cased as bytes are, and ids are the library's, also of texts without words and of unusual characters."""
    rng = random.Random(3)
    odd = "aB \t\n\x0b\x0c\r\x1c\x1f\xa0\x85é.,'1<|>İΣ"
    docs = ["", " ", "\t\x0b ", "Tiend, tiend. TIEND", "<|endoftext|> x", "日本語 テスト", *("".join(rng.choices(odd, k=rng.randrange(40))) for _ in range(90))]
    bpe = tokens.coder(tokens.tokenizer_path())
    end = bpe.whole.get_vocab_size()
    for texts, kind in ((docs, pa.string()), (docs[:3], pa.string()), (docs, pa.large_string())):
        rows = listed_rows(texts, kind)
        by_place = {r["i"]: (r["word"], r["n"]) for r in rows if r["word"] is not None}
        words = [[*x.encode().lower().split(), word_model.END] for x in texts]
        counts = collections.Counter(xxhash.xxh3_64_intdigest(w) for x in words for w in x)
        assert {h % (1 << 64): n for h, n in by_place.values()} == counts and len(by_place) == len(counts)
        found = {r["doc_id"]: r for r in rows if r["ids"] is not None}
        assert len(found) == len(texts)
        for k, (text, own) in enumerate(zip(texts, words, strict=True)):
            assert np.frombuffer(found[k]["ids"], "<u2").tolist() == [*bpe.whole.encode(text, add_special_tokens=False).ids, end]
            listed = [by_place[int(i)][0] % (1 << 64) for i in word_model.unbag(found[k]["bag"])]
            assert sorted(listed) == sorted(map(xxhash.xxh3_64_intdigest, own))


def test_a_block_merges_each_pretoken_once(monkeypatch):
    bpe = tokens.coder(tokens.tokenizer_path())
    met, merge = collections.Counter(), bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda x: met.update([x]) or merge(x))
    listed_rows(["qzwxthree qzwxthree, Qzwxthree. (qzwxthree)", "QZWXTHREE! qzwxthree's qzwxother"])
    assert met == {"qzwxthree": 1, "qzwxother": 1}


def test_probabilities_add_up_and_each_token_counts_once():
    model, _ = small_model()
    for before in ([], [3, 7], list(range(40))):
        rest = attention_lm.scores(model, [np.array(before)])[0] if before else 0.0
        total = sum(10 ** (attention_lm.scores(model, [np.array([*before, k])])[0] - rest) for k in range(51))
        assert total == pytest.approx(1, rel=1e-3)
    for size in (1, 15, 16, 17, 31, 32, 33, 200):
        stream = attention_lm.Stream([np.arange(size) % 50, np.arange(3)], 50)
        inputs, targets, counts = stream.windows(np.flatnonzero(stream.nth))
        assert set(inputs[0, : attention_lm.STEP + 1].tolist()) == {50}
        assert targets[counts].tolist() == [k % 50 for k in range(size)] + [0, 1, 2]


def test_no_token_sees_later_ones():
    model, _ = small_model()
    text = np.arange(40) % 7
    other = np.append(text[:20], (text[20:] + 3) % 7)
    parts = [[attention_lm.scores(model, [x[: k + 1]])[0] for k in range(len(x))] for x in (text, other)]
    assert np.allclose(parts[0][:20], parts[1][:20], rtol=1e-5) and not np.allclose(parts[0][21:], parts[1][21:])


def test_very_long_texts(spark):
    """One text of two million characters, and one word as long as a window of texts."""
    item = prose(900, 40)
    long = prose(901, 150_000) + " " + item + " " + prose(902, 150_000)
    docs = spark.createDataFrame([(1, long, "en"), (2, "x" * 300_000, "en"), (3, prose(903, 50), "en"), (4, item, "de")], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(7, item), (8, prose(904, 200))], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()} == {(1, 7), (4, 7)}
    scored = {r["doc_id"]: r for r in attention_lm.score_texts(docs).collect()}
    assert scored[1]["n_tokens"] == len(long.split()) + 1 and scored[1]["score"] < scored[3]["score"] < 0
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, docs).collect()}.keys() == {1, 2, 3, 4}


PAGE = """<!DOCTYPE html><html><head><title>Not <p>this</title><style>p{}</style><script>var t="</p>";</script></head><body class=x>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies</div>
<div id="wrap-7"><div class="post p12"><h2>A &amp; B&nbsp;title</h2><p>First <b>bold</b>er line<br>second &eacute;&#33; line.<p>Unclosed one,
 with   space.<form><input value="a>b"><button>Go</button></form><div class="ad-3">Buy</div><script>x</script><p>Last words of the article.</div>
<div class="comments"><p>Nice post, I liked it very much, really very much indeed, thanks for all of this text.</div></div>
<aside><p>Other</p></aside><footer>&copy; 2020</footer></body></html>"""
TEXT = "A & B title First bolder line second é! line. Unclosed one, with space. Last words of the article."


def test_main_text(spark):
    pages = [(k, f"http://a.org/{k}", PAGE) for k in range(5)]
    pages += [(5, "http://a.org/5", None), (6, None, ""), (7, "x", "plain & simple"), (8, "http://b.org/", "<p>only<p>paragraphs"), (8, "http://b.org/", "<p>only<p>paragraphs")]
    pages.append((9, "http://a.org/9", "<div><div><p>Another shape of page, without the path.</div>"))
    df = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))
    found = collections.defaultdict(list)
    for r in html_text.main_texts(df).collect():
        found[r["page_id"]].append(r["text"])
    assert found[0] == [TEXT] and found[4] == [TEXT] and found[5] == [""] and found[6] == [""]
    assert found[7] == ["plain & simple"] and found[8] == ["only paragraphs"] * 2 and found[9] == ["Another shape of page, without the path."]
    assert html_text.main_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ('<body><div class="x>Hello "there" world</div><p>after', "after"),
        ('<body><p>before</p><div class="x>inside</div>and <b>more</b>', "before inside and more"),
        ("<p>1 < 2 and 3 > 2 &lt;b&gt; <3 </p>", "1 < 2 and 3 > 2 <b> <3"),
        ("<p>a</p><div data-x='>' title=\"a > b\" \"x>b</div>", "a b"),
        ("<p>kept</p><!-- never closed <p>gone", "kept"),
        ("<p>kept</p><a href", "kept"),
        ("<p>kept</p></ x><?php x ?><!doctype y><p>too</p><script>var a='<p>no</p>'", "kept too"),
        ("<p>before<svg><text>no</text></svg></p><svg><p>open svg</p>", "before open svg"),
        ("<P CLASS=a>Upper</P\n><UL><LI>one<LI>two</UL>", "Upper one two"),
        ("<div class='related-work'><h2>Related work</h2><p>The whole article stands here, and it is long.</p></div><p>x</p>", "Related work The whole article stands here, and it is long."),
        ("<div class='related posts-0'><p>No</p></div><article class='header-page'><p>The article, much longer.</p></article>", "The article, much longer."),
        ("<div class='notice'><p>The whole article stands in a notice, and it is long.</p></div><p>x</p>", "The whole article stands in a notice, and it is long."),
    ],
)
def test_broken_and_odd_pages(source, want):
    page = html_text.Page(source)
    assert page.within(page.best()[0]) == want


@pytest.mark.parametrize("names", ["modal-logic", "menu-planning content", "post-comments-policy", "login-systems", "cookie-recipes"])
def test_no_article_is_lost_by_its_name(names):
    long = prose(5, 60)
    for source in (f'<body><div class="{names}"><p>{long}</p></div><div><p>short</p></div></body>', f'<body><div id="{names.split()[0]}"><p>{long}</p></div></body>'):
        page = html_text.Page(source)
        assert page.within(page.best()[0]) == long


def test_names_that_say_nothing_else_tell():
    for names in ("comments", "comment-list", "site-footer", "main-nav", "cookie-consent", "user-comments", "ad-slot-2", "content menu"):
        page = html_text.Page(f'<body><div class="{names}"><p>{prose(5, 60)}</p></div><div class=text><p>short</p></div></body>')
        assert page.within(page.best()[0]) == "short"
    small = html_text.Page(f'<body><div class="modal-offers"><p>buy it</p></div><div class=text><p>{prose(5, 60)}</p></div></body>')
    assert small.within("/body") == prose(5, 60)  # a doubtful name and little text


def test_heading_of_an_article_stays():
    page = html_text.Page("<body><header><h1>Site</h1></header><article><header><h1>Title</h1><nav>menu</nav></header><p>Text of it.</p></article></body>")
    assert page.within(page.best()[0]) == "Title Text of it."


@pytest.mark.parametrize("part", ['<a "', "<a b='", '<div class="', "<", "</", "<!--", "<script>", "<a b=", "<p title=\"x' ", "<svg ", "<a  "])
def test_reading_takes_time_in_proportion(part):
    took = []
    for n in (20_000, 80_000):
        begin = time.process_time()
        html_text.Page("<p>x</p>" + part * n)
        took.append(time.process_time() - begin)
    assert took[1] < 10 * max(took[0], 0.05)


def test_hosts_agree_on_a_path(spark):
    """On one page a long text stands elsewhere; the host's other pages outvote it."""
    usual = "<body><div class=main><p>{}</div><div class=extra><p>{}</div></body>"
    pages = [(k, f"http://h.org/{k}", usual.format(prose(k, 60), prose(99, 10))) for k in range(6)]
    pages.append((6, "http://h.org/6", usual.format("Short story here.", prose(7, 80))))
    found = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found[6] == "Short story here." and found[0] == prose(0, 60)


def test_languages(spark):
    rng = random.Random(1)
    words = {"en": WORDS, "de": "der fluss und die alten felder wurden ruhig unter grauem himmel durch brücken".split(), "fr": "le fleuve et les champs étaient calmes sous un ciel gris près des ponts".split()}
    train = [(k, " ".join(rng.choices(words[lang], k=30)), lang) for k, lang in enumerate(list(words) * 20)]
    docs = [(k, " ".join(rng.choices(words[lang], k=12)), lang) for k, lang in enumerate(list(words) * 5)]
    docs += [(90, None, "en"), (91, "", "en"), (92, "123 !?", "de"), (93, "x" * 500, None), (94, "Der Fluß", None), (94, "Der Fluß", None)]
    a, b = (clashing(spark.createDataFrame(x, "doc_id long, text string, lang string")) for x in (docs, train + [(500, "foo", None), (501, None, "en")]))
    found = {r["doc_id"]: r for r in language_id.identify(a, b).collect()}
    assert all(found[k]["lang_pred"] == lang for k, _, lang in docs[:15]) and all(0 < found[k]["score"] <= 1 for k in range(15))
    assert all(found[k]["lang_pred"] == "und" and found[k]["score"] == 0 for k in (90, 91, 92))
    assert found[93]["lang_pred"] in words and found[94]["lang_pred"] == "de"
    assert {r["lang_pred"] for r in language_id.identify(a, b.limit(0)).collect()} == {"und"}
    assert language_id.identify(a.limit(0), b).count() == 0


def test_forward_sums_all_segmentations():
    pieces = language_id.pieces_of(language_id.vocabulary_path())
    rng = np.random.default_rng(0)
    p = np.append(rng.random(pieces.n), 0)[:, None]
    names = {}
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=language_id.vocabulary_path())
    kept = sorted(x for x in {model.id_to_piece(k) for k in range(model.vocab_size())} if language_id.WORD.fullmatch(x.removeprefix("▁")) and x == x.lower())
    names = {x: k for k, x in enumerate(kept)}

    def plain(word):
        sums = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                one = p[names[word[start:end]], 0] if word[start:end] in names else 0.0
                sums[end] += sums[start] * (max(one, language_id.FLOOR) if end - start == 1 else one)
        return sums[-1]

    words = ["the", "mills", "größe", "żółć", "unbelievable"]
    sizes, cells = pieces.lattice(words)
    alpha = pieces.forward(sizes, cells, p)[:, :, 0]
    for k, w in enumerate(words):
        assert alpha[sizes[k], k] == pytest.approx(plain("▁" + w), rel=1e-9)


def test_packing(spark):
    found = packing.pack(clashing(documents(spark))).toPandas()
    whole = tokens.coder(tokens.tokenizer_path()).whole
    ids = collections.defaultdict(list)
    for r in rows():
        ids[r[0] if r[0] is not None else -1].append(whole.encode(r[1] or "", add_special_tokens=False).ids + [1])
    found["doc_id"] = found["doc_id"].fillna(-1)
    for x in found.itertuples():
        own = ids[x.doc_id][0]
        part = np.array(own[x.start : x.start + x.length], "<u4").tobytes()
        assert zlib.crc32(part) == x.ids_crc32 and x.doc_tokens == len(own)
    for key, group in found.groupby("doc_id"):
        assert group["length"].sum() == sum(map(len, ids[key]))
    for _, group in found.sort_values("offset").groupby("sequence_id"):
        assert group["offset"].tolist() == [0, *np.cumsum(group["length"])[:-1]] and group["length"].sum() <= 2048
    assert packing.pack(empty(spark)).count() == 0


def test_patterns_take_the_demand_exactly():
    rng = random.Random(4)
    for n in (1, 7, 300, 5000):
        demand = collections.Counter(rng.randrange(1, 257) for _ in range(n))
        taken = collections.Counter()
        used = packing.patterns_by_columns(dict(demand), 256)
        for pattern, times in used:
            assert sum(c * k for c, k in pattern.items()) <= 256
            for c, k in pattern.items():
                taken[c] += k * times
        assert taken == demand
        least = sum(c * k for c, k in demand.items()) / 256
        assert sum(times for _, times in used) <= 1.03 * least + 2


def test_pipeline(spark, tmp_path):
    """Every stage keeps the columns and only what it should."""
    import corpus_pipeline

    docs = [r for r in rows() if r[0] != 11]
    item = prose(800, 25)
    docs.append((60, prose(801, 100) + " " + item, "en", "a", 1))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "packing"]
    found = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    ids = set(found["doc_id"].dropna())
    assert 4 in ids and 20 in ids and not ids & {0, 1, 2, 3, 5, 12, 60}
