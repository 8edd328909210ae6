"""Spelling variants, the filter audit and exact top-k search against brute force, and on odd tables; crafted words, odd and hostile markup."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewell.llm import filter_audit, html_text, spelling, vector_file
from sievewell.llm.embedding_near_dup import near_duplicates as near_duplicate_vectors
from sievewell.llm.token_group_join import jaccard_components

SF = "/root/testdata/sf0.001"
_EXTRA = ["cast(1 as int) as word", "'x' as part", "0.5D as n", "'y' as ends", "7L as length", "array(1) as vector", "'q' as digest", "'u' as mask", "1 as members"]


def _sql(text, folder=SF):
    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return sorted(con.sql(text).fetchall(), key=repr)


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :]


def _variants(n):
    near = {w: [v for v in n if _near(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return out


def _counts(rows):
    total = Counter()
    for doc, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


@pytest.mark.parametrize("most_letters", [30, spelling.MOST_LETTERS])
def test_variants_are_those_of_all_pairs(spark, most_letters):
    """A dense vocabulary of few letters, repeated ones among them, so that positions give the same word; also with every group dealt again."""
    rng = random.Random(5)
    n = {}
    for _ in range(700):
        n["".join(rng.choice("aabàÿ") for _ in range(rng.choice([6, 6, 7, 8])))] = rng.choice([5, 6, 30, 200, 1100, 6000])
    n |= {"aaaaaa": 5, "aaaaaaa": 26, "aaaaaaaa": 131, "q" * 3000: 9, "q" * 3001: 50, "q" * 1500 + "r" + "q" * 1500: 7}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = [tuple(r) for r in spelling.variants(words, most_letters).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(n) and set(got) == _variants(n)


def test_wavelet_tree():
    rng = np.random.default_rng(2)
    for size in (1, 2, 3, 64, 100):
        values = rng.permutation(size)
        ends = np.sort(rng.integers(0, size + 1, (200, 2)), axis=1), np.sort(rng.integers(0, size + 1, (200, 2)), axis=1)
        query, value = spelling.WaveletTree(values).report(ends[0][:, 0], ends[0][:, 1], ends[1][:, 0], ends[1][:, 1])
        want = {(i, int(v)) for i in range(200) for v in values[ends[0][i, 0] : ends[0][i, 1]] if ends[1][i, 0] <= v < ends[1][i, 1]}
        assert set(zip(query.tolist(), value.tolist(), strict=True)) == want and len(query) == len(want)


def test_spelling_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = _counts([(r.doc_id, r.text) for r in docs.collect()])
    got = {tuple(r) for r in spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert len(n) > 300 and got == _variants(n)


def test_spelling_on_edges(spark, monkeypatch):
    rows = [(1, "Straße strasse STRASSE " * 9), (1, "Straße strasse STRASSE " * 9), (2, None), (3, ""), (None, "ÄRGERLICH ärgerlich Ärgerlich×÷ " * 12), (4, "x" * 5000 + " " + "lengthy " * 7 + "9éèêëēabcdef " * 5), (4, " ".join(["y" * 700] * 6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *_EXTRA)
    want = _variants(_counts(rows))
    for part in (spelling.PART_CHARS, 100):
        monkeypatch.setattr(spelling, "PART_CHARS", part)
        held = spelling._runs(rows[5][1], 6)
        assert held["x" * 5000] == 1 and held["lengthy"] == 7
    assert {tuple(r) for r in spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()} == want
    assert {r.word for r in spelling.spelling_variants(docs).collect()} >= {"straße", "strasse", "Ärgerlich×÷", "abcdef", "y" * 700} and spelling.spelling_variants(docs.where("false")).count() == 0


def test_audit_against_sql(spark):
    got = filter_audit.audit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    columns = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == _sql(f"SELECT {', '.join(columns)} FROM ({filter_audit.oracle()})")


def test_audit_walks_every_order(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "", "seldom " * 150, "A" * 9, "A" * 200, "x # y", " ".join(words), " ".join(words[:99]), " ".join(words) + "\x0b\x1c &"]
    rows = [(i, t, "en", None) for i, t in enumerate(texts)] + [(50 + i, rng.choice(texts), rng.choice(["de", None, ""]), None) for i in range(60)] + [(None, "", "en", None), (None, " ".join(words), "en", None), (7, " ".join(words), "en", None), (55, texts[3], "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", *_EXTRA)
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (5, 1, None), (None, 1, 1), (7, None, 1), (60, 1, 1), (61, 1, 0)], "doc_id long, quality int, toxic int").withColumn("part", F.lit("z"))

    def fails(row):
        doc, text, _, _ = row
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        firsts = [r[0] for r in rows if (r[1] or "") == t and r[0] is not None]
        return {f for f, on in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), doc is not None and min(firsts) < doc), strict=True) if on}

    judged = [(r[2] or "", fails(r), r[0] in (0, 5, 60, 61), r[0] in (0, 7, 60)) for r in rows]
    want = {}
    for part in {j[0] for j in judged}:
        of = [j for j in judged if j[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = of
            for step, f in enumerate(order, 1):
                out = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                want[part, order, step] = [len(left), len(out), sum(f in j[1] for j in of) - len(out), sum(j[1] == {f} for j in of), sum(j[2] for j in out), sum(j[3] for j in out)]
    for (part, order, step), row in want.items():
        f = order[step - 1]
        row.append(sum(w[1] for (p, o, s), w in want.items() if p == part and o[s - 1] == f))
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in filter_audit.audit(docs, labels).collect()}
    assert got == want
    assert filter_audit.audit(docs.where("false"), labels).count() == 0 and filter_audit.audit(docs, labels.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def _top(rows, k, every):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, a in whole.items():
        if q % every == 0:
            ranked = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole.items() if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("dimensions", [1, 7, 16])
def test_top_products_are_exact(spark, monkeypatch, dimensions):
    """Many small blocks, copies, ties and zero vectors; a first reading of a few rows, so that bounds decide the rest."""
    for name, value in (("BLOCK_ROWS", 64), ("TASK_BLOCKS", 3), ("READ_ROWS", 4), ("QUERY_ROWS", 8)):
        monkeypatch.setattr(vector_file, name, value)
    rng = np.random.default_rng(dimensions)
    base = rng.normal(size=(60, dimensions)).round(2)
    rows = [(i, [float(x) for x in (base[rng.integers(60)] if i % 3 else base[0]) + (rng.normal(size=dimensions) * 0.05 if i % 4 else 0)]) for i in range(900)]
    rows[20], rows[50] = (20, [0.0] * dimensions), (50, [0.0] * dimensions)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_file.top_products(df, df.where("vec_id % 10 = 0"), k=5)
    assert {tuple(r) for r in got.collect()} == _top(rows, 5, 10)


def test_top_products_on_edges(spark):
    good = [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [-0.001, 0.0]), (50, [0.0, 0.0]), (4, [1e30, 2.0])]
    odd = [(5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (8, []), (None, [1.0, 1.0]), (9, [1.0])]
    df = spark.createDataFrame(good[:4] + odd + good[:1], "vec_id long, embedding array<double>").selectExpr("*", *[e for e in _EXTRA if "vector" not in e], "array('v') as vector")
    got = vector_file.top_products(df, df.where("vec_id % 50 = 0"))
    assert {tuple(r) for r in got.collect()} == _top(good[:4], 5, 50)
    assert vector_file.top_products(df.where("false"), df).count() == 0 and vector_file.top_products(df, df.where("false")).count() == 0
    large = spark.createDataFrame(good, "vec_id long, embedding array<double>")
    held = {(r.query_id, r.vec_id): r.score for r in vector_file.top_products(large, large).collect()}
    assert held[0, 4] == 2**63 - 1 and held[0, 1] == 128 * 128 + 64 * 64


def test_top_products_against_sql(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = vector_file.top_products(df, df.where("vec_id % 50 = 0"))
    assert sorted(map(tuple, got.collect()), key=repr) == _sql(vector_file.oracle())


_ARTICLE = "<p>" + " ".join(f"word{i}" for i in range(60)) + "</p>"


@pytest.mark.parametrize("page, want, gone", [
    (f'<body><article><div class="article-header"><h1>Title</h1></div>{_ARTICLE}</article></body>', ["Title", "word59"], []),
    (f"<body><header>Site</header><article><header><h1>Title</h1><nav>menu</nav></header>{_ARTICLE}</article></body>", ["Title", "word59"], ["Site", "menu"]),
    (f'<body><article>{_ARTICLE}<div class="related-work"><p>Others did this before.</p></div></article></body>', ["Others did"], []),
    (f'<body><article>{_ARTICLE}<section id="social"><h2>Social life</h2><p>{"They met often and wrote letters. " * 6}</p></section><div class="social-links">Share it</div></article></body>', ["Social life", "wrote letters"], ["Share it"]),
    (f'<body><article class="teaser"><h2>Other news</h2></article><article>{_ARTICLE}<article class="c1">I, a reader, disagree.</article></article><article>Second comment</article></body>', ["word0"], ["Other news", "disagree", "Second"]),
    (f'<body><article>{_ARTICLE}<div class="related-posts"><a href="/x">More of it</a></div><div class="comments-list">{"A reader writes at length. " * 30}</div></article></body>', ["word59"], ["More of it", "reader writes"]),
], ids=["header-class", "header-element", "related-work", "social", "articles", "boxes"])
def test_article_parts_stay_and_boxes_go(page, want, gone):
    text = html_text.main_text(page, html_text.parse(page))
    assert all(w in text for w in want) and not any(g in text for g in gone)


@pytest.mark.parametrize("page", ["<a " * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<article>" + '<div class="related">' * 30_000 + "word " * 30, "<p>" * 100_000 + "x", '<a href="x>' * 50_000], ids=["unclosed", "unmatched", "nested", "paragraphs", "quotes"])
def test_hostile_pages_end(spark, page):
    began = time.time()
    html_text.subtree_hashes(page, html_text.parse(page))
    html_text.main_text(page, html_text.parse(page))
    assert time.time() - began < 15
    rows = html_text.extract(spark.createDataFrame([(1, "http://a.example/1", page)], "page_id long, url string, html string")).collect()
    assert len(rows) == 1


def test_crafted_words_are_told_apart(spark):
    """Thue-Morse words and their complements collide under every polynomial modulo a power of two."""
    import corpus_pipeline

    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, morse), (2, other), (3, f"x {morse} y z u v"), (4, f"x {other} y z u v"), (5, morse.upper())], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    full = docs.selectExpr("*", "'en' as lang", "'s' as source", "cast(0 as long) as n_chars")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, full, "").collect()) == [1, 2, 3, 4]


def test_equal_vectors_are_one_class(spark):
    """Copies, near copies and scaled ones over many blocks and several classes of one vector, against brute force; a large group ends in seconds."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 12))
    rows = []
    for i in range(700):
        v = base[rng.integers(6)] if i % 3 else base[0]
        v = v + (0.05 * rng.normal(size=12) if i % 5 == 0 else 0)
        rows.append((int(i * 7 % 701), (v * (2 if i % 4 == 0 else 1)).tolist(), int(i % 11 == 0)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df, block_rows=16, class_members=9).collect()}
    ids, x, label = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(ids), dtype=bool)
    root = ids.copy()
    for _ in range(len(ids)):
        newer = np.minimum(root, np.where(links, root, 1 << 40).min(axis=1))
        if (newer == root).all():
            break
        root = newer
    assert got == {int(v): (int(n), int(c), bool(v == c)) for v, n, c in zip(ids, links.sum(axis=1), root)}

    many = spark.range(100_000).selectExpr("id as vec_id", "array(1d, 2d, if(id = 77, 2.1d, 3d)) as embedding", "1L as label")
    row = near_duplicate_vectors(many).agg(F.min("n_links"), F.max("n_links"), F.max("component_id"), F.count("*")).first()
    assert tuple(row) == (99_999, 99_999, 0, 100_000)
