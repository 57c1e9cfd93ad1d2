"""The other operators against brute force, round trips and held-out labels, and on odd and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.conftest import LONG, frame
from textloom.llm import bpe, html_extract, katz, minhash, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = WORD.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(docs, percent=85):
    sets, label = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_groups(spark):
    """Groups around a base, a chain of small steps, and texts that share less than the threshold."""
    rng = random.Random(1)
    docs, words = [], [f"w{i}" for i in range(3000)]
    for g in range(4):
        base = [rng.choice(words) for _ in range(150)]
        for k in range(25):
            own = list(base)
            for _ in range(k % 5):
                own[rng.randrange(150)] = rng.choice(words)
            docs.append((len(docs), " ".join(own)))
    step = [rng.choice(words) for _ in range(200)]
    for _ in range(40):
        step = [*step[3:], *(rng.choice(words) for _ in range(3))]
        docs.append((len(docs), " ".join(step).upper()))
    rng.shuffle(docs)
    table = frame(spark, [(d, t, None) for d, t in docs])
    want = components(docs)
    for limits in ({}, {"most_nodes": 2}):  # in one task, and round by round: the same links
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_dedup(table, **limits).collect()}
        assert got == want


def test_near_odd_and_empty(spark, odd, empty):
    rows = minhash.near_dedup(odd).collect()
    assert len(rows) == 10
    assert {(r["doc_id"], r["component_id"]) for r in rows if r["n_shingles"] == 2} == {(1, 1), (2, 1), (None, 1)}
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0)
    assert minhash.near_dedup(empty).count() == 0
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] for r in kept.collect())) == [1, 3, 4, 5, 6, 6, 7]


def test_near_keeps_one_of_equal_rows(spark):
    rows = [(8, "some words that repeat in every row here", "a")] * 3 + [(None, "of a null identifier there are two rows", None)] * 2 + [(9, "", "a")] * 2
    assert sorted((r["doc_id"] or 0 for r in minhash.keep_one(frame(spark, rows)).collect())) == [0, 8, 9, 9]


def test_both_searches_find_the_same(spark):
    """Random texts of many small similarities around the threshold: one task or round by round."""
    for seed in (1, 2):
        rng = random.Random(seed)
        docs, words = [], [f"w{i}" for i in range(500)]
        for _ in range(12):
            base = [rng.choice(words) for _ in range(60)]
            for _ in range(10):
                own = list(base)
                for _ in range(rng.randint(0, 4)):
                    own[rng.randrange(60)] = rng.choice(words)
                docs.append((len(docs), " ".join(own), None))
        table = frame(spark, docs)
        one, two = ({r["doc_id"]: r["component_id"] for r in minhash.near_dedup(table, most_nodes=k).collect()} for k in (1000, 2))
        assert one == two


def test_neighbourhoods_hand_on_few_links(spark, monkeypatch):
    """Near copies share many buckets: the links between them are fewer than they are, and the result is that of all pairs."""
    rng, handed, inner = random.Random(5), [], minhash.components
    monkeypatch.setattr(minhash, "components", lambda links: handed.append(links.count()) or inner(links))
    words = [f"w{i}" for i in range(3000)]
    base, docs = [rng.choice(words) for _ in range(150)], []
    for k in range(120):
        own = list(base)
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(150)] = rng.choice(words)
        docs.append((k, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_dedup(frame(spark, [(d, t, None) for d, t in docs])).collect()}
    assert got == components(docs) and len(handed) == 1 and handed[0] < len(docs)


def test_rounds_join_links_only_if_there_are_new_ones(spark, monkeypatch):
    rng, handed, inner = random.Random(5), [], minhash.components
    monkeypatch.setattr(minhash, "components", lambda links: handed.append(links.count()) or inner(links))
    words = [f"w{i}" for i in range(3000)]
    base, docs = [rng.choice(words) for _ in range(150)], []
    for k in range(120):
        own = list(base)
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(150)] = rng.choice(words)
        docs.append((k, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_dedup(frame(spark, [(d, t, None) for d, t in docs]), most_nodes=20).collect()}
    by_rounds = handed[1:]
    assert got == components(docs) and by_rounds and by_rounds == sorted(set(by_rounds))


def test_neighbourhoods_of_random_buckets(spark):
    """Sparse and dense buckets, and a chain of them, against the least node that can be reached."""
    rng = random.Random(6)
    for nodes, keys in ((200, 150), (200, 60)):
        met = {(rng.randrange(nodes), rng.randrange(keys)) for _ in range(260)} | {(1000 + i * 7919 % 101, 1000 + i + j) for i in range(100) for j in (0, 1)}
        label = {n: n for n, _ in met}
        while True:
            least = {}
            for n, k in met:
                least[k] = min(least.get(k, n), label[n])
            new = {n: min(least[k] for m, k in met if m == n) for n in label}
            if new == label:
                break
            label = new
        table = spark.createDataFrame(sorted(met), "node bigint, key bigint")
        assert {r["node"]: r["label"] for r in minhash.neighbourhoods(table).collect()} == label


def test_keep_one_takes_a_threshold(spark):
    """A Jaccard similarity between 0.80 and 0.85 is near at 80 per cent, and not for op4_minhash."""
    words = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(words), None), (2, " ".join([*words[:94], *(f"v{i}" for i in range(10))]), None), (3, " ".join(f"u{i}" for i in range(50)), None)]
    same = len(shingles(rows[0][1]) & shingles(rows[1][1])) / len(shingles(rows[0][1]) | shingles(rows[1][1]))
    assert 0.80 <= same < 0.85
    docs = frame(spark, rows)
    assert sorted(r["doc_id"] for r in minhash.keep_one(docs, percent=80).collect()) == [1, 3]
    assert sorted(r["doc_id"] for r in minhash.keep_one(docs).collect()) == [1, 2, 3]
    assert minhash.bands_for(85) == minhash.BANDS and (1 - 0.8**minhash.ROWS) ** minhash.bands_for(80) <= 1e-6


def test_sketch_tells_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    for share in (0.3, 0.95):
        a = rng.integers(0, 1 << 60, (200, minhash._K), dtype=np.uint64)
        b = np.where(rng.random(a.shape) < share, a, rng.integers(0, 1 << 60, a.shape, dtype=np.uint64))
        bits = []
        for x, y in zip(a, b, strict=True):
            maps = [np.bincount((minhash.mix(v ^ minhash._B) % np.uint64(512)).astype(int), minlength=512) & 1 for v in (x, y)]
            bits.append((maps[0] ^ maps[1]).sum())
        assert (max(bits) <= minhash.widest_xor()) if share > 0.9 else (np.mean(np.array(bits) > minhash.widest_xor()) > 0.9)


PAGE = """<html><head><title>T</title><script>var x="</p>";</script></head><body><nav><a href=/a>Menu</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; more</h1><p>One  <b>bold</b>&nbsp;word<p>Two<br>lines<div class="ad">Buy</div><form>f</form><section id="comments"><p>nice</p></section></article><footer>&copy; x</footer>"""


def test_blocks_and_text(spark):
    pages = spark.createDataFrame([(1, "http://h/x", PAGE), (1, None, PAGE), (2, "bad", None), (None, "http://h/y", ""), (3, "http://h/z", "plain <b>text</b>")], "page_id long, url string, html string")
    got = [(r["page_id"], r["url"], r["text"]) for r in html_extract.extract(pages.withColumn("text", F.lit("clash")).withColumn("open", F.lit(1))).collect()]
    main = "Head & more\nOne bold word\nTwo lines"
    assert sorted(got, key=str) == sorted([(1, "http://h/x", main), (1, None, main), (2, "bad", ""), (None, "http://h/y", ""), (3, "http://h/z", "plain text")], key=str)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_boilerplate_of_a_host_goes(spark):
    line = "this long line stands on every page of the host and says nothing"
    rows = [(i, f"http://h/{i}", f"<div>{line}</div><div>page {i} has its own words number {i * 7}</div>") for i in range(5)]
    rows.append((9, "http://other/", f"<div>{line}</div>"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"page {i} has its own words number {i * 7}" for i in range(5)}, 9: line}


def test_boilerplate_of_articles_goes_and_open_text_stays(spark):
    """Unmarked promos within <main> of most pages go, main text in <div>s beside a teaser stays; so do a headline named in menus, and
    what few articles of a host have in common."""
    promo, teaser = "sign up today and get all of our best offers by mail every single week", "read our story of the year"
    own = lambda i, k: f"text {i} part {k} tells of things that number {i * 7 + k} alone has"
    nav = "<nav><a>text 0 part 0 tells of things that number 0 alone has</a></nav>"
    rows = [(i, f"http://h/{i}", f"{nav}<main><p>{own(i, 0)}</p><p>{promo}</p><p>{own(i, 1)}</p></main>") for i in range(4)]
    rows += [(10 + i, f"http://t/{i}", f"<article>{teaser}</article><div>{own(i, 2)}</div>") for i in range(4)]
    rows += [(20 + i, f"http://copy/{i}", f"<nav>{i}</nav><article>{own(9, 3)}</article>") for i in range(4)]
    rows += [(30 + i, f"http://few/{i}", f"<article><p>{own(30 + i, 0)}</p>{f'<p>{promo}</p>' * (i < 4)}</article>") for i in range(9)]
    got = {r["page_id"]: (r["text"], r["n_removed"]) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {**{i: (own(i, 0) + "\n" + own(i, 1), 15) for i in range(4)}, **{10 + i: (own(i, 2), 6) for i in range(4)}, **{20 + i: (own(9, 3), 0) for i in range(4)}}
    assert got == {**want, **{30 + i: (own(30 + i, 0) + ("\n" + promo) * (i < 4), 0) for i in range(9)}}


def test_names_that_tell_of_articles_mark_nothing():
    page = """<article><section class="related-work">A</section><div class="social-history">B</div><math>C</math><div class="has-sidebar">D</div><svg>E</svg>
    <fieldset>F</fieldset><div class="ad-slot">x</div><div class="related-articles widget">x</div><p id="comments-2">x</p><dialog>x</dialog></article>"""
    assert "".join(t for z, t in html_extract.blocks(page) if z == html_extract.ARTICLE).replace(" ", "") == "ABCDEF"


def test_extraction_by_brute_force(spark, monkeypatch):
    """Random pages of few words: every substring counted over all pages of the host, with parts of one page or many."""
    for part in (500, 2):
        monkeypatch.setattr(html_extract, "PART", part)
        rng = random.Random(part)
        rows, told = [], {}
        lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 24))) for _ in range(60)]
        for i in range(60):
            host = f"h{i % 3}"
            zones = [(rng.choice((html_extract.OPEN, html_extract.ARTICLE)), rng.choice(lines[: 12 + 20 * (i % 3)])) for _ in range(rng.randint(0, 5))]
            page = "".join(f"<article>{t}</article>" if z else f"<div>{t}</div>" for z, t in zones)
            rows.append((i, f"http://{host}/{i}", page + "<nav>menu</nav>"))
            told[i] = (host, zones)
        pages = collections.defaultdict(set)
        distinct = collections.defaultdict(set)
        for host, zones in told.values():
            key = tuple(zones)
            distinct[host].add(key)
            for _, t in zones:
                w = t.split()
                for run in [tuple(w[k : k + 8]) for k in range(len(w) - 7)] or [tuple(w)]:
                    pages[host, run, len(w) < 8].add(key)
        want = {}
        for i, (host, zones) in told.items():
            text = []
            for z, t in zones:
                w, gone = t.split(), set()
                for k in range(max(1, len(w) - 7)):
                    n = len(pages[host, tuple(w[k : k + 8]), len(w) < 8])
                    if n >= 3 and (z == html_extract.OPEN or 2 * n >= len(distinct[host])):
                        gone.update(range(k, min(k + 8, len(w))))
                text.append(" ".join(x for k, x in enumerate(w) if k not in gone))
            want[i] = "\n".join(x for x in text if x)
        got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == want and sum(t != "\n".join(x for _, x in told[i][1]) for i, t in got.items()) > 10


def test_extraction_of_a_long_page(spark):
    long = "".join(f"<p>{' '.join(f'w{i}x{k}' for k in range(50))}</p>" for i in range(4000))
    rows = [(1, "http://h/1", f"<article>{long}</article>"), (1, "http://h/1", f"<article>{long}</article>"), (None, None, "<div>x")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(len(r["text"].split()) for r in got) == [1, 200_000, 200_000]


def test_suffix_array_counts_pages():
    rng = random.Random(0)
    for _ in range(200):
        pages = [[[rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(0, 5))]
        want = collections.Counter()
        for p in pages:
            want.update({k for b in p for k, _, _ in html_extract.keys_of(b, 4)})
        assert html_extract.repeated(pages, 4) == dict(want)


def test_toxicity_held_out(spark):
    from tests.conftest import DATA

    big = str(DATA / "sf0.01")
    docs, labels = toxicity.documents(spark, big), toxicity.labels(spark, big)
    found = toxicity.scored(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    right = sum((r["toxic_score"] >= 0.5) == (r["toxic"] == 1) for r in found)
    assert right / len(found) >= 0.93
    caught = [r for r in found if r["toxic"] == 1 and r["toxic_score"] >= 0.5]
    assert caught and all(r["toxic_spans"] for r in caught)


def test_toxicity_chain_is_forward_backward():
    """Powers over plain words give the marginals of a pass over every word."""
    import numpy as np

    rng = np.random.default_rng(3)
    tagger = toxicity.Tagger(["bad", "worse"])
    tagger.weights = rng.normal(size=9)
    words = ["ok"] * 40
    for i in (0, 3, 4, 20, 39):
        words[i] = ("bad", "worse")[i % 2]
    n, at, got = tagger.hits(" ".join(words))
    places, scores = tagger.emissions(n, at, got)
    fast = tagger.marginals(n, places, scores)
    e = np.full(n, tagger.weights[0])
    e[places] = scores
    step = np.exp(tagger.weights[3:7].reshape(2, 2))
    emit = np.stack([np.ones(n), np.exp(e)], axis=1)
    fore, back = np.zeros((n, 2)), np.ones((n, 2))
    fore[0] = emit[0] * [1, np.exp(tagger.weights[2])]
    for i in range(1, n):
        fore[i] = fore[i - 1] @ step * emit[i]
    for i in range(n - 2, -1, -1):
        back[i] = step @ (emit[i + 1] * back[i + 1])
    p = fore * back
    assert np.allclose(fast, (p[:, 1] / p.sum(axis=1))[places])


def test_toxicity_windows_cover_whole_texts():
    """Every word of a labelled text is in one window, however many hits it has."""
    tagger = toxicity.Tagger(["bad"])
    for text in ("ok " * 500, "bad " * 90, "ok " * 40 + "bad " + "ok " * 40, "bad", "", "ok " * 16 + "bad " * 3 + "ok"):
        found = toxicity._windows(tagger, [text], True)
        assert sum(len(labels) * k for (_, _, labels), k in found.items()) == len(text.split())
        assert sum(sum(labels) * k for (_, _, labels), k in found.items()) == text.split().count("bad")


def test_toxicity_sample_is_bounded(spark):
    """Whole rows up to the bounds of rows and characters; a repeated identifier is one row."""
    rows = [(i, f"{'bad' if i % 2 else 'fine'} word number {i} " * 10, None) for i in range(1, 60)] * 2
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    seen = []
    before, toxicity.choose = toxicity.choose, lambda toxic, clean: seen.append((toxic, clean)) or ["bad"]
    try:
        toxicity.train(frame(spark, rows), labels, most=10)
        toxicity.train(frame(spark, rows), labels, most_chars=1000)
    finally:
        toxicity.choose = before
    assert [len(x) for x in seen[0]] == [10, 10] and all(0 < sum(map(len, x)) <= 1000 for x in seen[1])


def test_toxicity_odd_and_empty(spark, odd, empty, sf):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    tagger = toxicity.train(odd, labels)
    assert toxicity.keep_clean(odd, sf).columns == odd.columns and toxicity.keep_clean(odd, sf).count() == 10
    rows = toxicity.scored(odd, tagger, carry=tuple(odd.columns)).collect()
    assert len(rows) == 10 and all(0 <= r["toxic_score"] <= 1 for r in rows)
    assert toxicity.scored(empty, toxicity.train(empty, labels.limit(0))).count() == 0


def test_quality_counts(spark, texts):
    repeats = " ".join(["one two three four five six seven eight nine"] * 3)
    docs = [*texts, (10_001, repeats + "\n#$\n#$\nx"), (10_002, "a\n \na\nA")]
    got = {r["doc_id"]: r for r in quality.quality(frame(spark, [(d, t, "s") for d, t in docs])).collect()}
    for d, t in docs:
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        times, cover, seen, again = collections.Counter(grams), set(), set(), 0
        for i, g in enumerate(grams):
            if times[g] > 1:
                cover.update(range(i, i + 8))
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(cover))


def test_quality_lines(spark):
    """A line in most documents of a host goes; a document of nothing else is rejected; copies count once."""
    line = " ".join(f"boiler{i}" for i in range(25))
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(30))
    rows = [(i, f"{line}\n{own(i)}", "a") for i in range(30)] + [(100, f"{line}\nshort", "a")] + [(200 + i, own(999), "b") for i in range(50)]
    got = {r["doc_id"]: r for r in quality.quality(frame(spark, rows)).collect()}
    assert all(got[i]["kept"] and got[i]["n_removed"] == 25 for i in range(30))
    assert got[100]["depleted"] and not got[100]["kept"]
    assert all(got[200 + i]["kept"] and got[200 + i]["n_removed"] == 0 for i in range(50))


def test_quality_counts_documents_with_several_shared_lines(spark):
    """Lines that come together count every distinct document, whichever of them has the least hash."""
    shared = [" ".join(f"shared{k}x{j}" for j in range(5)) for k in range(6)]
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(40))
    rows = [(100 * h + i, "\n".join([*shared, own(100 * h + i)]), f"host{h}") for h in range(4) for i in range(30)]
    got = quality.quality(frame(spark, rows)).collect()
    assert len(got) == 120 and all(r["n_removed"] == 30 and r["kept"] for r in got)


def test_quality_odd_and_empty(spark, odd, empty):
    rows = quality.quality(odd).collect()
    assert len(rows) == 10 and sum(r["kept"] for r in rows) == 1
    assert quality.quality(empty).count() == 0


def test_katz_by_brute_force(spark, texts):
    docs = [*texts, (10_001, None), (10_002, ""), (10_003, "unheard of")]
    tokens = {d: [*WORD.findall(low(t)), "\0end"] for d, t in docs}
    train = [d for d, _ in docs if zlib.crc32(str(d).encode()) % 10]
    one, two = collections.Counter(), collections.Counter()
    for d in train:
        one.update(tokens[d])
        two.update(zip(["\0start", *tokens[d][:-1]], tokens[d], strict=True))
    by1, by2 = (katz.discounts([sum(v == r for v in c.values()) for r in range(1, katz.K + 2)]) for c in (one, two))
    n, v = sum(one.values()), len(one)
    left = lambda c, by: c * by[c] if c <= katz.K else c - katz.TAIL
    unknown = 1 - sum(left(c, by1) for c in one.values()) / n
    p1 = lambda w: left(one[w], by1) / n if w in one else unknown
    of = collections.Counter(one)
    of["\0start"] = len(train)
    s1, s2 = collections.Counter(), collections.Counter()
    for (a, b), c in two.items():
        s1[a] += left(c, by2) / of[a]
        s2[a] += p1(b)

    def p(a, b):
        if two[a, b]:
            return left(two[a, b], by2) / of[a]
        return (1 - s1[a]) / (1 - s2[a]) * p1(b) if of[a] else p1(b)

    for a in ("the", "\0start"):
        assert abs(sum(p(a, b) for b in one) + p(a, "\0never") - 1) < 1e-9
    got = {r["doc_id"]: r for r in katz.katz_scores(frame(spark, [(d, t, None) for d, t in docs])).collect()}
    for d, _ in docs:
        t = tokens[d]
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (d not in train, len(t), sum(one[w] > 0 for w in t), n)
        assert math.isclose(r["score"], sum(math.log10(p(a, b)) for a, b in zip(["\0start", *t[:-1]], t, strict=True)), rel_tol=1e-9)
        assert math.isclose(r["base_score"], sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)


def test_katz_model_is_stored(spark, texts, tmp_path):
    """Texts scored from the stored tables have the scores that they have when held out from training."""
    store = f"file://{tmp_path}/model"
    docs = frame(spark, [(d, t, None) for d, t in texts])
    got = {r["doc_id"]: r for r in katz.katz_scores(docs, store=store).collect()}
    again = katz.score_with(store, docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)).collect()
    assert len(again) > 10 and all(r["held_out"] for r in again)
    for r in again:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == tuple(got[r["doc_id"]][c] for c in ("n_tokens", "n_known", "train_tokens"))
        assert math.isclose(r["score"], got[r["doc_id"]]["score"], rel_tol=1e-9) and math.isclose(r["base_score"], got[r["doc_id"]]["base_score"], rel_tol=1e-9)
    rows = spark.read.parquet(f"{store}/ngrams").collect()
    assert rows and all(r["chunk"] == katz.TABLE and r["keys"] for r in rows)


def test_katz_odd_and_empty(spark, odd, empty):
    rows = katz.katz_scores(odd).collect()
    assert len(rows) == 10 and all(math.isfinite(r["score"]) for r in rows)
    assert katz.katz_scores(empty).count() == 0
    assert all(math.isfinite(r["score"]) for r in katz.katz_scores(odd, held=F.lit(True)).collect())  # nothing to learn from


@pytest.fixture(scope="module")
def codec():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.Codec(bpe.Vocabulary(ranks), public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_the_library(codec, texts):
    import numpy as np

    own, library = codec
    rng = random.Random(7)
    pool = [chr(x) for x in range(0x300)] + [chr(x) for x in (0x1680, 0x180E, 0x200B, 0x2028, 0x3000, 0xFEFF, 0x1F600, 0x301)]
    tried = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    tried += ["".join(chr(rng.choice((rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)))) for _ in range(8)) for _ in range(500)]
    for t in [*tried, "a" * 5000, " " * 999, "", *(t for _, t in texts)]:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_perfect_hash(codec):
    table = codec[0].piece.__self__.vocabulary
    assert sorted(table.hash.slots) == list(range(len(table.keys)))
    assert all(table.keys[table.hash.slot(k)] == k for k in table.keys)


def test_bpe_odd_and_empty(spark, odd, empty):
    how = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = bpe.encoded(odd, *how, outputs=("ids", "n_tokens", "decoded", "decoded_sha256")).collect()
    want = [r["text"] or "" for r in odd.collect()]
    assert sorted(r["decoded"] for r in rows) == sorted(want) and LONG in want
    assert all(r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest() and len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    assert bpe.encoded(empty, *how).count() == 0
