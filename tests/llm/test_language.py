"""Language identification: equal texts get equal scores wherever they stand, rare languages are learnt, odd rows are defined."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from wingbeat.llm import language

LETTERS = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwx"}


def text(rng, lang, n=30):
    return " ".join("".join(rng.choice(LETTERS[lang] + "yz") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def rows():
    rng = random.Random(3)
    return [(i, text(rng, lang), lang) for i in range(600) for lang in ["cc" if i % 40 == 0 else "aa" if i % 2 else "bb"]]


def test_held_out_and_odd_rows(spark):
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", "bb"), (None, "abc abd", None), (903, "ABC abd abe " * 40000, "aa"), (5, "dup", None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows() + odd], "doc_id long, text string, lang string, score double")
    model = language.train(df)
    out = {r.doc_id: r for r in language.predicted(df, model).withColumn("h", language.C.held_out("doc_id", 3, 1)).collect()}
    assert len(language.predicted(df, model).collect()) == df.count()
    hit = [out[i].lang_pred == lang for i, _, lang in rows() if out[i].h and i != 5]
    assert sum(hit) >= 0.95 * len(hit) and {lang for i, _, lang in rows() if out[i].lang_pred == lang} == {"aa", "bb", "cc"}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902)) and out[903].lang_pred == "aa"
    nothing = language.predicted(df, language.train(df.where("lang is null"))).agg(F.collect_set("lang_pred")).first()[0]
    assert nothing == ["und"] and language.predicted(df.limit(0), model).count() == 0


def test_equal_texts_equal_scores(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = language.train(df)
    some = ["abc def", "ijk lmn op", "a", "é ü", "abc def", "abc def"]
    first = model.predict(pa.array(some))[1].to_pylist()
    assert first[0] == first[4] == first[5]
    for size in (1, 2, 5):
        for order in (some, some[::-1], some * 3):
            got = [x for i in range(0, len(order), size) for x in model.predict(pa.array(order[i : i + size]))[1].to_pylist()]
            assert got == [first[some.index(t)] for t in order]
