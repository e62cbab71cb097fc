"""Quality classifier and language identification: bounds, folds and held-out accuracy; awkward rows."""

import inspect
import random
import re
import timeit
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmap.llm import language, quality, queries
from veilmap.llm.common import fold

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def quality_scores(spark):
    return queries.op5_quality_scores(spark, SF).cache()


def test_quality_held_out(spark, quality_scores):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert quality_scores.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    got = quality_scores.join(labels, "doc_id").where("held_out").groupBy("quality").agg(F.avg("predicted").alias("p"), F.count("*").alias("n")).collect()
    rate = {r.quality: r.p for r in got}
    assert rate[1] > 0.95 and rate[0] < 0.35
    assert quality_scores.where("score < 0 or score > 1 or score is null or predicted <> cast(score >= 0.7 as int)").count() == 0


def test_quality_of_awkward_rows(awkward):
    docs, rows = awkward
    model = (np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32), 0.3)
    got = quality.score_column(docs, model)
    assert got.columns == [*[c for c in docs.columns if c != "score"], "score"] and got.count() == len(rows)
    by_text = {}
    for r in got.collect():
        assert 0 <= r.score <= 1 and by_text.setdefault(r.text or "", r.score) == r.score
        idx, share = quality.bag(r.text or "", quality.BUCKETS)
        z = 0.3 + float(share @ model[0][idx]) if len(idx) else 0.3
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)
    assert quality.score_column(docs.limit(0), model).count() == 0


def test_up_to_6000_labelled_rows_are_all_learned_from(spark):
    labels = spark.range(6_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.labelled_sample(labels, id_col="doc_id", label_col="quality", rows=quality.SAMPLE_ROWS).count() == 6_000
    assert inspect.signature(quality.fit).parameters["epochs"].default == 8


def test_quality_without_labels(spark, awkward):
    docs, rows = awkward
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    table, bias = quality.train(docs, none)
    assert not table.any() and bias == 0.0
    assert quality.keep_good(docs, none, threshold=0.5).columns == docs.columns


def test_the_sample_is_bounded_and_repeats(spark):
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    a = quality.labelled_sample(labels, id_col="doc_id", label_col="quality", rows=500)
    b = quality.labelled_sample(labels.repartition(7), id_col="doc_id", label_col="quality", rows=500)
    assert 400 < a.count() < 600 and {r[0] for r in a.collect()} == {r[0] for r in b.collect()}


def test_training_separates_and_repeats():
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma"] if i % 2 else ["alpha!!", "BETA##", "zzz"]) for _ in range(20)) for i in range(80)]
    one, bias = quality.fit(texts, [i % 2 for i in range(80)], epochs=5)
    two, _ = quality.fit(texts, [i % 2 for i in range(80)], epochs=5)
    assert (one == two).all()
    z = [bias + float(s @ one[i]) for t in ("alpha beta gamma", "BETA## zzz") for i, s in [quality.bag(t, quality.BUCKETS)]]
    assert z[0] > 1 and z[1] < -1


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op8_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").cache()
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_of_awkward_rows(awkward):
    docs, rows = awkward
    got = language.predict(docs, language.train(docs))
    assert set(got.columns) == {*docs.columns, "lang_pred", "score"} and got.count() == len(rows)
    for r in got.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and r.lang_pred in ("und", "en", "de") and 0 <= r.score <= 1
    assert language.predict(docs.limit(0), language.train(docs.limit(0))).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.train(docs.limit(0))).collect()} == {"und"}


def test_unseen_words_fall_back_to_shorter_grams():
    model = language.build([("the", "en", 5), ("der", "de", 5)], [("<sch", "de", 9), ("ing>", "en", 9), ("sh", "en", 2), ("qu", "de", 5), ("z", "de", 3)])
    best = lambda w: model["langs"][int(language.word_vector(model, w).argmax())]
    assert [best(w) for w in ("the", "der", "schxx", "xxing", "xshx")] == ["en", "de", "de", "en", "en"]
    assert not language.word_vector(model, "qqq").any()


def test_folds_are_never_learned_from(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lied = docs.withColumn("lang", F.when(fold("doc_id", 5, 0), "xx").otherwise(F.col("lang")))
    model = language.train(lied.where(~fold("doc_id", 5, 0)))
    assert "xx" not in model["langs"] and Counter(model["langs"])["en"] == 1


def test_letter_like_numbers_are_no_letters(spark):
    rows = [(1, "½"), (2, "² ①"), (3, "Ⅷ 12 _"), (4, "½a"), (5, "日"), (6, "́")]
    model = language.build([("a", "en", 5), ("b", "de", 5)], [("a", "en", 5), ("日", "de", 5)])
    got = {r.doc_id: r.lang_pred for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "en", 5: "de", 6: "und"}


def test_language_against_brute_force(spark):
    rng = random.Random(8)
    alphabets = {"aa": "abcdeé", "bb": "bcdfgñ", "cc": "cdghüß"}
    docs = [(i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(1, 6))) + rng.choice(["", ",", "½", "7", "'"]) for _ in range(rng.randint(1, 40))), lang) for i, lang in enumerate(sorted(alphabets) * 30)]
    docs += [(900, None, "aa"), (901, "abc", None), (902, "", "bb")]
    split = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    words, grams = Counter(), Counter()
    for _, text, lang in docs:
        if text is not None and lang is not None:
            words.update((w, lang) for w in split(text))
    for (w, lang), n in words.items():
        m = f"<{w}>"
        grams.update({(m[i : i + k], lang): 0 for k in range(1, 5) for i in range(len(m) - k + 1)})
        for k in range(1, 5):
            for i in range(len(m) - k + 1):
                grams[m[i : i + k], lang] += n
    words, grams = ({k: n for k, n in c.items() if n >= 2} for c in (words, grams))
    langs = sorted(alphabets)

    def table(counts):
        total = {x: sum(n for (_, y), n in counts.items() if y == x) + 0.1 * len({t for t, _ in counts}) for x in langs}
        return {t: np.log([(counts.get((t, x), 0) + 0.1) / total[x] for x in langs]) for t, _ in counts}

    known, by_length = table(words), {k: table({g: n for g, n in grams.items() if len(g[0]) == k}) for k in range(1, 5)}

    def vector(word):
        if word in known:
            return known[word]
        m = f"<{word}>"
        for k in (4, 3, 2, 1):
            hits = [by_length[k][m[i : i + k]] for i in range(len(m) - k + 1) if m[i : i + k] in by_length[k]]
            if hits and (k > 1 or len(hits) > 2):
                return np.mean(hits, axis=0)
        return np.zeros(len(langs))

    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(990, "abüß zzz"), (991, "qq ñ")], "doc_id long, text string")
    for r in language.predict(asked, language.train(frame)).collect():
        z = sum((vector(w) for w in split(r.text)), np.zeros(len(langs)))
        if not split(r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == langs[int(np.argmax(z))] and r.score == pytest.approx(1 / np.exp(z - z.max()).sum(), abs=1e-4)


def test_features_of_many_words_are_those_of_each():
    rng = random.Random(4)
    words = [bytes(rng.choice(b"abc\xc3\xa9") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    found, owner = quality.features(words, 1 << 20)
    for i, w in enumerate(words):
        alone, _ = quality.features([w], 1 << 20)
        assert sorted(found[owner == i]) == sorted(alone)
        size = len(w) + 2
        assert len(alone) == 1 + sum(size - n + 1 for n in range(3, min(5, size - 1) + 1))
    same, _ = quality.features([b"xabcx", b"yabcy"], 1 << 40)
    assert len(np.unique(same)) == len(same) - 1  # the gram they share


def test_words_without_numbers_in_the_pattern():
    """Every character alone and between letters; and splitting long texts takes a small part of what the wide pattern takes."""
    wide = re.compile(rf"[^\W\d_{re.escape(language.NUMBERS)}]+")
    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(marks), 50_000):
        text = "a".join(marks[at : at + 50_000])
        assert language.words_of(text) == wide.findall(text)
    assert language.words_of("") == [] == language.words_of("½² Ⅷ 12_") and language.words_of("ab½cd é") == ["ab", "cd", "é"]
    text = "ein schönes Wort und noch eines, été à Paris " * 4000
    clock = lambda f: min(timeit.repeat(lambda: f(text), number=1, repeat=3))
    assert clock(language.words_of) < 0.5 * clock(wide.findall)
