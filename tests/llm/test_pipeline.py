"""The pipeline's stages on a small table."""

import random

import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") * 2 + str(rng.randrange(900))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = [text(80) for _ in range(120)]
    passage = text(120)
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(200, clean[0]), (201, "start " + clean[1]), (202, text(60) + passage), (203, passage + text(60)), (204, "password=abcdefgh " + text(70))]
    rows += [(300 + i, " ".join(w + "###" for w in text(60).split(" "))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert set(out.columns) == set(corpus_pipeline.COLUMNS)
            kept[name] = {r.doc_id: r.text for r in out.collect()}
    assert set(kept["quality"]) == {i for i, _ in rows if i < 300}
    assert set(kept["near_duplicates"]) == set(kept["quality"]) - {200, 201}
    assert set(kept["repeats"]) == set(kept["near_duplicates"]) and passage[50:300] not in kept["repeats"][202]
    assert "abcdefgh" not in kept["secrets"][204] and kept["secrets"][5] == clean[5]
    assert {r.doc_id for r in out.collect()} == set(kept["secrets"])


def test_repeats_catch_51_short_words(spark):
    rng = random.Random(2)
    text = lambda n, size: " ".join("".join(rng.choice("abcdefghij") for _ in range(size)) for _ in range(n))
    passage, short = text(51, 4), text(30, 9)
    assert len(passage) < 300 < 400 and 220 < len(short) < 400
    parts = [(text(70, 6) + "\n", "\n" + text(70, 6)) for _ in range(4)]
    rows = [(i, a + (passage if i < 2 else short) + b) for i, (a, b) in enumerate(parts)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, docs, "").collect()}
    assert all(kept[i] == parts[i][0][:-1] + parts[i][1][1:] for i in (0, 1))
    assert all(kept[i] == rows[i][1] for i in (2, 3))
