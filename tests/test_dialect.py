"""Whole words, held literals and requirement sections against plain Python."""

from __future__ import annotations

import random
import re

from sievewell.functions import lexicon as L
from sievewell.functions.dialect import SPARK, WORDED, literal_of
from sievewell.operators import candidate

_WORDS = ("visa", "c++", "on call", "node.js", "n_1", "日本語", "non-profit", "x1")
_PIECES = [*_WORDS, "visas", "avisa", "visa_", "é", "_", "\n", ".", "-", "N2", "", "call", "x", "x12"]


def _said(x: str, word: str) -> bool:
    if any(c in word for c in " -/") or not word.isascii():
        return word in x
    return re.search(rf"(?a)\b{re.escape(word)}\b", x) is not None


def test_whole_words_as_by_boundaries(spark):
    rng = random.Random(5)
    texts = ["", " ", *("".join(rng.choice(["", " "]) + rng.choice(_PIECES) for _ in range(rng.randint(1, 6))) for _ in range(400))]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "txt string").selectExpr("txt", f"{WORDED.padded('txt')} as txt_words")
    rows = df.selectExpr("txt", *_columns(SPARK), *_columns(WORDED)).collect()
    for r in rows:
        if r.txt is None:
            assert not r.Worded_any and not r.Spark_any
            continue
        expected = [w for w in _WORDS if _said(r.txt, w)]
        assert r.Worded_any == r.Spark_any == bool(expected), r
        assert r.Worded_hits == r.Spark_hits == len(expected), r


def _columns(d):
    name = type(d).__name__
    return [f"{d.any_of('txt', _WORDS)} as {name}_any", f"{d.hits('txt', _WORDS)} as {name}_hits"]


def test_literals_are_in_every_match(spark):
    assert [literal_of(p) for p in (r"ab{2,3}cd", r"[]x]foo", r"[^\]a]bar", "foo|bar", r"abc?", r"(?i)abc", r"\bjapanese\b.{0,9}(a|b)", r"(ab)?cd*e")] == ["cd", "foo", "bar", "", "ab", "", "japanese", "c"]
    patterns = [p for k, v in vars(L).items() if k.isupper() and "PATTERN" in k for p in ([v] if isinstance(v, str) else v)]
    pieces = ["japanese ", "must ", "required for this role ", "jlpt n2 ", "n1 or above ", "position: dev ", "mid-level ", "junior ", "5+ years of experience ", "average overtime: 12 h / month ", "core time 10:00-15:00 ", "日本語必須 ", "all internal documents ", "12.5 million ", "no japanese required "]
    rng = random.Random(7)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "txt string")
    for r in df.selectExpr("txt", *[f"{SPARK.matches('txt', p)} as p{i}" for i, p in enumerate(patterns)]).collect():
        for i, p in enumerate(patterns):
            assert r[f"p{i}"] == (re.search(p, r.txt, re.ASCII) is not None), (p, r.txt)


def test_required_lines_by_section(spark):
    """A line counts below a heading of requirements, never below another heading, and before any if it hints."""
    d = SPARK
    must, other, hint = (next(w for w in words if w.isascii()) for words in (L.CANDIDATE_REQUIREMENT_SECTION_KEYWORDS, L.CANDIDATE_NON_REQUIREMENT_SECTION_KEYWORDS, L.CANDIDATE_REQUIREMENT_LINE_HINTS))
    rng = random.Random(9)
    made = ["\n".join(rng.choice([must, other, f"{hint} java", "java", "", "  ", "\x1e2 go"]) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    df = spark.createDataFrame([(t, t.lower()) for t in made], "description string, txt string").selectExpr("*", "'' as n_title")
    for stage in candidate.stages(d, candidate.CANDIDATE)[:3]:
        df = df.selectExpr("*", *[f"{e} as {n}" for n, e in stage.items()])
    said = lambda x, words: any(_said(x, w) for w in words)
    for r in df.collect():
        state, expected = 0, []
        for x in r.c_lines:
            state = 2 if said(x, L.CANDIDATE_REQUIREMENT_SECTION_KEYWORDS) else 1 if said(x, L.CANDIDATE_NON_REQUIREMENT_SECTION_KEYWORDS) else state
            if state == 2 or state == 0 and said(x, L.CANDIDATE_REQUIREMENT_LINE_HINTS):
                expected.append(x)
        assert r.c_required == expected, r
