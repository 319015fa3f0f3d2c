"""The operators against plain restatements of what they compute."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import balltree, components, content, content_labels, mixing, ngram_join, packing, permutation, pii, quality, repeats, suffix_array, wordpiece
from plumbline.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n, vocabulary=3000):
    return [f"w{r.randint(0, vocabulary)}" for _ in range(n)]


def near_copies(seed=1, groups=6, most=40):
    """Texts in groups of near copies of all degrees, and single ones."""
    r, texts = random.Random(seed), []
    for _ in range(groups):
        base = words(r, r.randint(30, 200))
        for _ in range(r.randint(2, most)):
            t = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 8])):
                t[r.randrange(len(t))] = f"x{r.randint(0, 99)}"
            texts.append(" ".join(t))
    texts += [" ".join(words(r, r.randint(1, 80))) for _ in range(40)] + ["a b", "a b", "a c", ""]
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], DOCS)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("block", "grams", "bits"), [(512, 1 << 21, 64), (7, 1 << 21, 64), (512, 300, 5)])
def test_near_duplicates(spark, monkeypatch, block, grams, bits):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", grams)
    monkeypatch.setattr(ngram_join, "IDENTITY_BITS", bits)  # 5: texts share their first hash
    texts = near_copies()
    unique = sorted(set(texts), key=texts.index)
    sets = {t: shingles(t) for t in unique}
    links = defaultdict(set)
    for i, a in enumerate(unique):
        for b in unique[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    group = {t: {t} for t in unique}
    for a in unique:
        todo = [a]
        while todo:
            for b in links[todo.pop()] - group[a]:
                group[a].add(b)
                todo.append(b)
    got = ngram_join.near_duplicates(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        assert r["n_links"] == len(links[t]) and r["class_id"] == min(texts.index(x) for x in group[t]) and r["n_copies"] == texts.count(t) - 1


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.choose_bands(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= 128


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(50)] + [(100 + r.randint(0, 60), 100 + r.randint(0, 60)) for _ in range(40)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: m for x, m in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want


@pytest.mark.parametrize("block", [2048, 2])
def test_repeated_strings(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    r = random.Random(3)
    part = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared = [part(230), part(199), part(600)]
    texts = [part(r.randint(0, 300)) + r.choice(shared) + part(r.randint(0, 300)) for _ in range(25)]
    line = part(60)
    long = part(4000)  # pieces of several segments, and of parts of them
    texts += [long, part(70) + long[:2500] + part(80), part(60) + long[1200:] + part(50), long[300:3000] + long[300:900]]
    texts += [line * 9, part(40) + line * 12 + part(300), line * 5 + part(9)]  # runs of segments that are alike
    texts += [part(500), "ab" * 400, "loop " * 100, shared[2], shared[2], "", "x" * 199, part(90) + "x" * 260]
    raw = [t.encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    for row in repeats.without_repeats(frame(spark, texts), with_kept=True).collect():
        b = raw[row["doc_id"]]
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"], bytes(row["kept"])) == (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept)


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(1)
    pieces = [bytes(r.integers(97, 100, r.integers(1, 60), dtype=np.uint8)) for _ in range(30)] + [b"a" * 50, b"ab" * 20]
    text = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces])
    edge = np.cumsum(size)
    ends = np.repeat(edge, size)
    sa = suffix_array.suffix_array(text, ends, 64)
    suffix = lambda i: bytes(text[i : ends[i]])
    assert sorted(sa.tolist()) == list(range(len(text))) and [suffix(i) for i in sa] == sorted(suffix(i) for i in range(len(text)))
    lcp = suffix_array.common_prefixes(text, edge - size, ends, sa, 40)
    for k in range(1, len(sa)):
        a, b = suffix(sa[k - 1]), suffix(sa[k])
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(n, 40)
    from_ten = suffix_array.common_prefixes(text, edge - size, ends, sa, 40, 10)
    assert from_ten.tolist() == np.where(ends[sa] - sa >= 10, lcp, 0).tolist()
    other = np.frombuffer(b"abababababababab" + b"zzzzzzzz" + pieces[3][:8].ljust(8, b"q"), np.uint8)
    at = np.arange(len(other) - 15)
    want = [any(suffix(i).startswith(bytes(other[a : a + 8])) for i in range(len(text))) for a in at]
    assert suffix_array.found_in(text, ends, sa, other, at, 8).tolist() == want


@pytest.mark.parametrize("ends_with", [b"", b"\0"])
def test_long_common_prefixes_mark_nothing_else(ends_with):
    """Segments that share more than 256 bytes and then part, among others."""
    r = random.Random(10)
    for _ in range(60):
        passage = lambda n: bytes(r.choice(b"abcd") for _ in range(n))
        segs = []
        for _ in range(6):
            p = passage(r.randint(257, 350))
            segs += [p + passage(r.randint(1, 10)) for _ in range(2)]
            segs += [passage(360) for _ in range(4)]
            p = passage(r.randint(210, 350))
            segs += [p[: 205 + r.randint(0, 5)] + ends_with * r.randint(0, 9) for _ in range(3)]
        r.shuffle(segs)
        pdf = pd.DataFrame({"anchor": 1, "content": range(len(segs)), "copy": 0, "kinds": [np.array([1, k, len(s)]).tobytes() for k, s in enumerate(segs)], "seg": segs, "blk": 0, "i": 0, "j": 0})
        seen = Counter(s[i : i + 200] for s in segs for i in range(len(s) - 199))
        want = {(k, i) for k, s in enumerate(segs) for i in range(len(s) - 199) if seen[s[i : i + 200]] > 1}
        got = {(x.content, x.at + i) for x in repeats.repeated_windows(pdf).itertuples() for i in range(x.marked - 199)}
        assert got == want


def test_top_k_is_exact(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(700, 8)).round(1)
    rows = [(i, base[i % 350 if i > 600 else i].tolist()) for i in range(700)]
    ints = np.array([[math.floor(256 * x) for x in v] for _, v in rows])
    got = defaultdict(list)
    for x in balltree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    for q in range(0, 700, 50):
        scores = sorted(((-int(s), i) for i, s in enumerate(ints @ ints[q]) if i != q))[:5]
        assert got[q] == [(i, -s) for s, i in scores]


def test_neighbours_are_found(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    got = defaultdict(set)
    for r in permutation.nearest(df).collect():
        got[r["query_id"]].add((r["vec_id"], round(r["score"], 9)))
    hits = total = 0
    for q in (i for i in data if i % 100 == 0):
        want = sorted((float(np.sqrt(((v - data[q]) ** 2).sum())), i) for i, v in data.items() if i != q)[:10]
        hits += sum((i, round(d, 9)) in got[q] for d, i in want)
        total += 10
    assert hits / total >= 0.9


@pytest.mark.parametrize("crowd", ["none", "copies", "near copies"])
def test_neighbours_are_found_beside_a_crowd(spark, crowd):
    r = np.random.default_rng(12)
    base = np.array([x["embedding"] for x in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()], float)
    n = 8400
    data = (base[r.integers(0, len(base), n)] + base[r.integers(0, len(base), n)]) / 2 + r.normal(size=(n, base.shape[1])) * base.std() / 2
    inside = np.zeros(n, bool)
    if crowd != "none":
        inside[r.permutation(n)[: n // 3]] = True
        data[inside] = data[0] + (r.normal(size=(inside.sum(), base.shape[1])) * base.std() / 1000 if crowd == "near copies" else 0)
    data = data.astype(np.float32).astype(float)
    got = defaultdict(list)
    for x in permutation.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append(x["vec_id"])
    right = {True: [], False: []}
    for q in range(0, n, 100):
        d = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(n), d)).tolist() if i != q][:10]
        right[bool(inside[q])].append(len(set(want) & set(got[q])) / 10)
    assert len(got) == n // 100 and all(np.mean(x) >= 0.9 for x in right.values() if x), right
    if crowd == "copies":
        assert min(right[True]) == 1.0


def test_footrule():
    r = np.random.default_rng(5)
    near = np.array([r.permutation(20)[:6] for _ in range(50)], np.int32)
    got = permutation.footrule(permutation.inverted_files(near, 20), near[7], 50)
    place = lambda row, p: int(np.flatnonzero(row == p)[0]) if p in row else 6
    assert got.tolist() == [sum(abs(place(x, p) - place(near[7], p)) for p in set(x) | set(near[7])) for x in near]


def test_pages_give_back_their_articles():
    """Held-out layouts, of which the labelled pages have no copy."""
    text = "Some words of an article that go on for a while, so that it is long enough."
    page = f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home page</a></li></ul></nav><div class='page-sidebar'><p>Ten more stories to read today.</p></div><main><div class='post-content'><h1>A &amp; B</h1><p>{text} <a href=y>link</a></p><div class='ad-box'>Buy this now.</div><p>Two<br>lines  here</p></div></main><div id='comments'><p>I do not agree with any of this.</p></div><footer>All rights.</footer>"
    assert content.main_text(page) == f"A & B\n{text} link\nTwo lines here"


NAV, FOOT = "<nav><ul><li><a href=x>Home page</a></li></ul></nav>", "<footer>All rights.</footer>"
ARTICLE = "<h1>A title</h1><p>Some words of an article that go on for a while.</p><p>So that it is long enough.</p>"


@pytest.mark.parametrize("page", [
    f'<body class="has-sidebar">{NAV}{ARTICLE}{FOOT}</body>', f'<body class="sidebar menu">{NAV}<div>{ARTICLE}</div>{FOOT}</body>', f'<body><div class="layout with-footer">{NAV}{ARTICLE}{FOOT}</div></body>',
    f'<body>{NAV}<div class="top-story">{ARTICLE}</div>{FOOT}</body>', f'<body><form action=x><a href="#c"></a>{NAV}<div>{ARTICLE}</div>{FOOT}</form></body>', f'<body>{NAV}<div class="sidebar layout"><main>{ARTICLE}</main></div>{FOOT}</body>',
    f'<body>{NAV}<div class="banner"><article>{ARTICLE}</article><div class="related">{NAV}</div></div>{FOOT}</body>', f'<body><div class="footer bottom">{NAV}<div>{ARTICLE}</div></div></body>',
])
def test_wrappers_do_not_hide_the_article(page):
    assert content.main_text(f"<html>{page}</html>") == "A title\nSome words of an article that go on for a while.\nSo that it is long enough."


def test_what_stands_beside_the_article_stays_out():
    long = "<p>I do not agree with any of this, as I said before.</p>" * 9
    for beside in (f'<section class="comments">{long}</section>', f"<aside><article>{long}</article></aside>", f'<div class="related">{NAV}<ul><li>Ten more</li></ul></div>', "<form><p>Your letter</p></form>"):
        assert content.main_text(f"<body>{NAV}<div>{ARTICLE}</div>{beside}{FOOT}</body>").endswith("long enough.")
    assert content.main_text(f"<body>{NAV}{FOOT}</body>") == ""


PROSE = "Three days of rain had filled the mill pond before anyone thought to open the gate, and by then it was late."
HELD_OUT_LAYOUTS = {
    "more": ('<article><h1>Head</h1><div class="more"><p>{0} a</p><p>{0} b</p></div></article>', "Head\n{0} a\n{0} b"),
    "tags": ('<nav><a href="x">Home</a></nav><section class="story-tags body"><p>{0} a</p><p>{0} b</p></section>', "{0} a\n{0} b"),
    "aside": ('<article><p>{0} a</p><aside><p>{0}{0}{0}{0}{0}{0}{0}{0}</p></aside><p>{0} b</p></article>', "{0} a\n{0} b"),
    "topbar": ('<div class="topbar">Login Register</div><article><p>{0} a</p></article><div class="reader-responses"><p>{0} c</p></div>', "{0} a"),
    "plain": ('<div id="menu"><ul><li><a href="a">One</a></li><li><a href="b">Two</a></li></ul></div><div><p>{0} a</p></div><div class="comments"><p>{0} c</p></div><div class="more"><ul><li><a href="c">Next</a></li></ul></div>', "{0} a"),
    "deep": ("<div>" * 300 + "<article><p>{0} a</p></article>" + "</div>" * 300 + "<footer>All rights reserved by all of us here.</footer>", "{0} a"),
}


@pytest.mark.parametrize("layout", HELD_OUT_LAYOUTS)
def test_layouts_that_were_not_labelled(layout):
    page, want = HELD_OUT_LAYOUTS[layout]
    assert content.main_text(page.format(PROSE)) == want.format(PROSE)


def test_scan_finds_the_best_range():
    r = random.Random(2)
    for _ in range(300):
        values = [r.choice([-0.3, -0.05, 1.0, 2.0, -1.5, r.uniform(-2, 2)]) for _ in range(r.randint(0, 25))]
        a, b = content.best_region(values)
        best = max([0.0] + [sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)])
        assert sum(values[a:b]) == pytest.approx(best) and (b > a or best <= 0)


def test_depth_costs_no_more_than_length():
    page = "".join(f"<div class='c{i % 7}'>word{i} " for i in range(20_000))
    assert len(content.main_text(page).split()) == 20_000


def test_labelled_pages_are_learned():
    good = words_right = 0
    for page in content_labels.labelled_pages():
        want = set(re.sub(r"<[^>]*>", " ", " ".join(re.findall(f"{content_labels.OPEN}(.*?){content_labels.CLOSE}", page, re.S))).split())
        got = set(content.main_text(re.sub(f"[{content_labels.OPEN}{content_labels.CLOSE}]", "", page)).split())
        good += len(want | got)
        words_right += len(want & got)
    assert words_right / good > 0.95


def plain_kneser_ney(texts, order):
    """Probability of a symbol after a context, restated with dictionaries."""
    raw = Counter()
    for t in texts:
        a = tuple(quality.symbols([t], order)[0].tolist())
        for i in range(order - 1, len(a)):
            raw[a[i - order + 1 : i + 1]] += 1
    levels = {order: raw}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discounts = {}
    for n, c in levels.items():
        k = Counter(c.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + 2 * k[2] else 0
        discounts[n] = [0] + [max(0.05, min(i - 0.05, i - (i + 1) * y * k[i + 1] / k[i])) if k[i] and k[i + 1] else i / 2 for i in (1, 2, 3)]
    total, taken = Counter(), Counter()
    for n, c in levels.items():
        for g, x in c.items():
            total[n, g[:-1]] += x
            taken[n, g[:-1]] += discounts[n][min(x, 3)]

    def p(g):
        n = len(g)
        if not n:
            return 1 / quality.ALPHABET
        ctx = (n, g[:-1])
        if not total[ctx]:
            return p(g[1:])
        x = levels[n][g]
        return (x - discounts[n][min(x, 3)] if x else 0) / total[ctx] + taken[ctx] / total[ctx] * p(g[1:])

    return p


@pytest.mark.parametrize(("rows", "block"), [(2_000_000, 1 << 24), (3, 100)])
def test_losses_are_those_of_kneser_ney(spark, monkeypatch, rows, block):
    monkeypatch.setattr(quality, "MODEL_ROWS", rows)  # 3: hundreds of shards
    monkeypatch.setattr(quality, "BLOCK_BYTES", block)
    monkeypatch.setattr(quality, "CHUNK_BYTES", block)
    monkeypatch.setattr(quality, "BLOCK_GROUP", 2)
    r = random.Random(6)
    texts = [" ".join(r.choice(["the", "cat", "sat", "on", "a", "mat", "é", "\0"]) for _ in range(r.randint(1, 30))) for _ in range(60)]
    df = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    model = quality.kneser_ney(quality.ngram_counts(df))
    assert model.count() > 300 * rows or rows > 1000
    tests = ["the cat sat", "zebra!!", "", "cat cat cat cat cat", "é", "ab\0cd words", "\0", "the \0\0 cat\n\nsat"] + texts[:10]
    got = quality.with_loss(spark.createDataFrame([(t, x, 7) for t in tests for x in ("en", "fr", None)], "text string, q_key string, block int"), model).collect()
    assert len(got) == 3 * len(tests)
    p = plain_kneser_ney([t.encode() for t in texts], quality.ORDER)
    for row in got:
        if row["q_key"] != "en":
            assert row["q_loss"] is None and row["q_symbols"] is None
            continue
        a = tuple(quality.symbols([row["text"].encode()])[0].tolist())
        want = -sum(math.log(p(a[i - 4 : i + 1])) for i in range(4, len(a)))
        assert row["q_symbols"] == len(a) - 4 and row["q_loss"] == pytest.approx(want, rel=1e-4)


def test_runs_of_words_are_one_symbol():
    pad, end, rep = [quality.PAD] * 4, [quality.END], quality.REPEAT
    a, start = quality.symbols([b"x y y z", b"q q q r", b"a\0b"])
    assert a.tolist() == pad + [*b"x y ", rep, *b" z"] + end + pad + [*b"q q ", rep, *b" r"] + end + pad + [*b"a\0b"] + end
    assert start.tolist() == [0, 12, 24]
    assert bytes(x for x in quality.symbols([b"In. In. In. In. In. cat"])[0].tolist() if x < 256).count(b"In.") == 2


def test_thresholds_are_quantiles(spark):
    r = np.random.default_rng(3)
    rows = [(k, float(n * (m + s * r.standard_normal())), int(n)) for k, m, s in (("=a", 1.0, 0.02), ("=b", 2.0, 0.05)) for n in r.integers(500, 5000, 400)]
    rows.append(("=c", 5.0, 1))
    got = {x["q_key"]: x["q_limit"] for x in quality.limits(spark.createDataFrame(rows, "q_key string, q_loss double, q_symbols long")).collect()}
    x = {k: np.sort([a / n - quality.SHORT / n**0.5 for key, a, n in rows if key == k]) for k in ("=a", "=b")}
    at = lambda v, q: v[int(np.ceil(q * len(v))) - 1]
    mid, way = {k: at(v, 0.5) for k, v in x.items()}, {k: at(v, 0.85) - at(v, 0.5) for k, v in x.items()}
    others = sum(way.values()) / 2
    way = {k: (400 * w + 20 * others) / 420 for k, w in way.items()}
    far = at(np.sort(np.concatenate([(x[k] - mid[k]) / way[k] for k in x])), quality.TAIL)
    assert got == pytest.approx({k: mid[k] + far * way[k] for k in x}, rel=1e-9)


def test_small_languages_share_a_model(spark):
    r = random.Random(8)
    text = lambda: " ".join(r.choice("river stone bridge market winter morning people water street house".split()) for _ in range(80))
    junk = lambda: "".join(r.choice("#$%&*QXZ0123456789") for _ in range(400))
    rows = [(i, text(), "en") for i in range(100)] + [(100 + i, text(), "xx") for i in range(4)] + [(200, junk(), "xx"), (201, text(), "xx"), (202, junk(), "en"), (203, junk(), "zz"), (204, text(), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(104)], "doc_id long, quality int, toxic int")
    kept = {x["doc_id"]: x["q_keep"] for x in quality.judged(docs, labels).select("q_row.doc_id", "q_keep").collect()}
    assert not kept[200] and not kept[202] and kept[201] and kept[203] and kept[204]


def test_quality_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rate = {r["quality"]: r["k"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1] > 0.99 and rate[0] < 0.05


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = near_copies(7)[:60] + ["hello <|endoftext|> world", " two  spaces \n\n and\ttabs ", "漢字 and 🙂", "word " * 3000]
    rows = packing.pack(frame(spark, texts), with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for i, text in enumerate(texts):
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        ids = np.frombuffer(b"".join(bytes(p["ids"]) for p in parts), "<u4").tolist()
        assert ids == t.encode(text, add_special_tokens=False).ids + [2]
        assert [p["start"] for p in parts] == [sum(x["length"] for x in parts[:k]) for k in range(len(parts))] and all(p["length"] == 1024 for p in parts[1:])
    for parts in by_seq.values():
        parts.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in parts] == [sum(x["length"] for x in parts[:k]) for k in range(len(parts))] and sum(p["length"] for p in parts) <= 1024


@pytest.mark.parametrize("seed", range(3))
def test_plans_use_few_bins(seed):
    r = np.random.default_rng(seed)
    x = np.clip(r.lognormal(5, 1.3, 3000).astype(int), 1, 1024)
    counts = dict(zip(*(a.tolist() for a in np.unique(x, return_counts=True))))
    plan, used = packing.plan_bins(counts), Counter()
    for lengths, n in plan:
        assert sum(lengths) <= 1024
        for length in lengths:
            used[length] += n
    assert used == Counter(counts) and sum(n for _, n in plan) <= -(-int(x.sum()) // 1024) + 2


def test_the_best_two_of_what_is_left():
    r = random.Random(12)
    for _ in range(300):
        left = np.zeros(41, np.int64)
        for _ in range(r.randint(0, 12)):
            left[r.randint(1, 40)] += 1
        room = r.randint(1, 40)
        pieces = [n for n in range(41) for _ in range(left[n])]
        best = max([0] + [x + y for i, x in enumerate(pieces) for y in pieces[i + 1 :] if x + y <= room])
        a, b = packing._best_two(left, room)
        assert a + b == best and (not best or (left[a] >= 1 and left[b] >= (2 if a == b else 1)))


def test_ids_are_those_of_the_tokenizer():
    enc, r = packing.encoder(), random.Random(13)
    marks = ["a", "b", "the", "Zoë", " ", "  ", "\n", "\t", ".", ",", "'s", "don't", "12", "3.5", "é", "日本語", "\u00a0", "\u2028", "🙂", "-", "/", "\0", "x" * 70]
    for _ in range(2000):
        text = "".join(r.choice(marks) for _ in range(r.randint(0, 14)))
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == enc._ids_of(text), repr(text)


def test_mix_comes_near_its_targets(spark):
    df = mixing.op8_mix_sources(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source"), "doc_id")
    rows = df.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("n"), F.max("size").alias("most"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 2 * r["most"] and r["over"] <= 0 and r["target"] <= 2 * r["n"] + 1e-6 for r in rows)
    assert sum(r["target"] for r in rows) == pytest.approx(1.5 * sum(r["n"] for r in rows))


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 500)], "mx_source string, mx_size long")
    got = {r["mx_source"]: r["mx_target"] for r in mixing.source_targets(sizes).collect()}
    total, weight = 1.5 * 1520, {"a": 3, "b": 1, "c": 2, None: 3}
    size = {"a": 10, "b": 1000, "c": 10, None: 500}
    target, left = {}, set(size)
    while left:
        share = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if share * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: share * weight[s] for s in left}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= over
    assert got == pytest.approx(target)


def test_token_counts_are_greedy():
    m = wordpiece.LongestMatch([b"ab", b"abcd", b"bc", b"c", "é".encode(), b"bcdx", b"aaaa"])
    pieces = {b"ab", b"abcd", b"bc", b"c", "é".encode(), b"bcdx", b"aaaa"} | {bytes([b]) for b in range(256)}
    r = random.Random(8)
    tests = ["".join(r.choice("abcdxé") for _ in range(r.randint(0, 25))) for _ in range(500)]

    def greedy(word):
        b, n, i = (wordpiece.MARK + word).encode(), 0, 0
        while i < len(b):
            i = next(j for j in range(min(len(b), i + 4), i, -1) if b[i:j] in pieces)
            n += 1
        return n

    assert m.lengths(tests).tolist() == [greedy(w) for w in tests]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(9)
    for _ in range(4000):
        text = "".join(r.choice([*"0123456789.@+-() a%_é\n", "4111111111111111", "1.2.3.4", "x@y.z"]) for _ in range(r.randint(0, 50)))
        want = []
        for k, (name, p) in enumerate(PATTERNS.items()):
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m[0])
                if name == "email" or name == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or name == "card" and 16 <= len(d) <= 19 and pii.luhn(d) or name == "phone" and 8 <= len(d) <= 15:
                    want.append((k, m.start(), m.end()))
        assert pii.base_spans(text) == want


def test_field_finds_more_of_what_it_knows():
    texts = ["call +1 (974) 555-3436 now or later 9745553436 again", "the year 2024 and 17 of 300 items, v1.2.3", "no digits here"]
    (_, added), (_, none), (_, nothing) = pii.all_spans(texts)
    assert [texts[0][a:b] for _, a, b in added] == ["9745553436"] and not none and not nothing
    right = wrong = missed = 0
    for words_, labels in pii.examples(200, seed=77):
        text = " ".join(words_)
        ((base, added),) = pii.all_spans([text])
        at = 0
        for w, label in zip(words_, labels):
            hit = {k + 1 for k, a, b in base + added if a < at + len(w) and b > at}
            right += label in hit
            wrong += not label and any(a < at + len(w) and b > at for _, a, b in added)
            missed += bool(label) and label not in hit
            at += len(w) + 1
    assert right / (right + wrong) > 0.98 and right / (right + missed) > 0.9


@pytest.mark.parametrize("at", [0, 30, 60])
def test_field_is_consistent_across_a_document(at):
    parts = ["take 9745553436 and then"] * 60
    parts.insert(at, "or call +1 (974) 555-3436 now")
    texts = [" ".join(parts), "the year 2024 and 17 of 300 items", "x " * 30]
    (_, added), (_, none), _ = pii.all_spans(texts)
    assert [texts[0][a:b] for _, a, b in added] == ["9745553436"] * 60 and not none
    assert pii.all_spans(texts[:1]) == pii.all_spans(texts)[:1]
    assert "9745553436" not in pii.redact(texts[0], [x for part in pii.all_spans(texts)[0] for x in part])


def test_evidence_stands_however_many_are_linked_to_it():
    text = "+1 (974) 555-3436 y " + "9745553436 x " * 20_000
    ((_, added),) = pii.all_spans([text])
    assert len(added) == 20_000


def test_beliefs_of_a_tree_are_exact():
    """A chain of 40 nodes with a branch: evidence comes through from end to end."""
    r = np.random.default_rng(11)
    node, near, skip = r.normal(size=(41, 2)), np.array([[2.5, -2.5], [-2.5, 2.5]]), np.array([[1.0, 0.0], [0.0, 1.0]])
    node[0] = [-1e3, 1e3]
    edges = np.array([(i, i + 1, 0) for i in range(39)] + [(3, 40, 1)])
    to = np.zeros((41, 2))
    for i in [40, *range(39, 0, -1)]:  # to the root
        a, pair = (3, skip) if i == 40 else (i - 1, near)
        to[a] += np.logaddexp.reduce(pair + (node[i] + to[i])[None], axis=1)
    down = np.zeros((41, 2))
    for i in [*range(1, 40), 40]:
        a, pair = (3, skip) if i == 40 else (i - 1, near)
        up = np.logaddexp.reduce(pair + (node[i] + to[i])[None], axis=1)
        down[i] = np.logaddexp.reduce(pair + (node[a] + to[a] + down[a] - up)[:, None], axis=0)
    want = node + to + down
    want = np.exp(want - np.logaddexp.reduce(want, axis=1)[:, None])
    assert np.abs(pii.marginals(node, edges, near, skip) - want).max() < 1e-3


def test_redaction():
    text = "mail a@b.com or 1.2.3.4."
    assert pii.redact(text, pii.base_spans(text)) == "mail [EMAIL] or [IP]."


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = seen.count()
        seen = stage(spark, seen, SF).persist()
        assert seen.columns == docs.columns
        assert seen.count() <= (2 * before if name == "mixing" else before)
        if name == "near_duplicates":
            near = ngram_join.near_duplicates(seen)
            assert near.where("n_links > 0 OR n_copies > 0").count() == 0
        if name == "personal_data":
            assert pii.found(seen).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    packed = corpus_pipeline.run(spark, SF)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert packed.where("piece = 0").count() == seen.count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = lambda df: sorted(map(repr, df.astype(object).values.tolist()))
    assert key(got.astype(str)) == key(want.astype(str))
