"""The pipeline's stages against plain rules on a small corpus."""

from __future__ import annotations

import random

import corpus_pipeline


def corpus():
    rng = random.Random(11)
    tongues = {"en": ["the", "ing", "tion", "er", "an", "of", "st"], "de": ["sch", "ung", "ein", "ver", "keit", "und", "ö"]}

    def prose(lang, n):
        return ["".join(rng.choices(tongues[lang], k=rng.randint(1, 3))) for _ in range(n)]

    rows = []
    for i in range(240):
        lang = "en" if i % 3 else "de"
        rows.append([i, " ".join(prose(lang, rng.randint(60, 160))), lang])
    passage = " ".join(prose("en", 60))
    for i in (10, 11, 13):
        rows[i][1] += " " + passage + " " + " ".join(prose("en", 90))
    base = prose("en", 200)
    for k in range(5):
        words = list(base)
        words[40 * k] = f"edit{k}"
        rows.append([300 + k, " ".join(words), "en"])
    rows += [[400, None, "en"], [401, "too short", "en"], [402, "same old line " * 60, "en"], [403, "ЖЖ щщ " + "юяы эфъ " * 3, "en"]]
    rows += [[404, "".join(rng.choices("юяыэфъжщцч", k=6)) + " ", "en"]]
    rng.shuffle(rows)
    return [(d, t, lang, "s", len(t or "")) for d, t, lang in rows], passage


def test_stages(spark, tmp_path):
    rows, passage = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "MinHash near-dedup", "substring dedup", "best-fit packing"]
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "unused")
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean = set(range(240))
    assert ids[0] == clean | set(range(300, 305)) == ids[1]
    assert ids[2] == clean | {300} == ids[3] == ids[4]
    texts = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    before = {d: t for d, t, *_ in rows}
    for i in ids[3]:
        if i in (10, 11, 13):
            assert texts[i].text == " ".join(before[i].replace(passage, "").split()) and texts[i].n_chars == len(texts[i].text)
        else:
            assert texts[i].text == before[i]
    words = sum(len(t.text.split()) for t in texts.values())
    assert sum(r.piece_words for r in docs.collect()) == words


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
