"""License scans against a look at every block, and against SQL."""

import random
import re

import duckdb
import pytest

from veilmap.llm import licenses, queries
from veilmap.llm.licenses import Template

SF = "/root/testdata/sf0.001"
COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(SMALL))


def brute(text, templates, threshold):
    words = split(text)
    places, base, labels, score, blocks = [], set(), set(), 0.0, 0
    for t in templates:
        own = split(t.text)
        if not own:
            continue
        n = min(len(own), len(words))
        for s in range(len(words) - n + 1) if words else ():
            block = words[s : s + n]
            share = len(set(own) & set(block)) / len(set(own))
            if block == own if t.ordered else share >= threshold - 1e-12:
                score = max(score, share)
                labels.add(t.label)
                if t.ordered:
                    places.append(s)
                    base.add(t.label)
                else:
                    blocks += 1
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, blocks)


def test_awkward_texts(spark, awkward):
    notice = {t.name: t.text for t in licenses.TEMPLATES}
    texts = [r[1] for r in awkward[1]] + [
        "MIT License", "mit-license, MIT  LICENSE\nmit license", "permit license", "mit éa license", "license mit", "MIT LİCENSE",
        notice["mit-permission"], notice["apache-notice"].replace("compliance", "agreement"), notice["gpl-line"][5:], notice["cc-by-nc-line"], notice["bsd-notice"] * 3,
        ("word " * 2000) + notice["apache-line"] + (" tail" * 2000), " ".join(reversed(notice["mpl-notice"].split())), "general public license general public license version",
    ]
    rng = random.Random(9)
    pool = split(" ".join(notice.values()))
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 400))) for _ in range(30)]
    rows = [(i, t, 5, "x") for i, t in enumerate(texts)] + [(None, "the MIT License", 5, "x"), (3, "the MIT License", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, hits string").repartition(3)
    for templates, threshold in ((licenses.TEMPLATES, licenses.THRESHOLD), (licenses.TEMPLATES, 0.5), ((Template("e", "e", "... !"), Template("r", "r", "a b a w1 a"), Template("o", "o", "again again", True)), 0.6)):
        got = licenses.digests(docs, templates=templates, threshold=threshold)
        want = [(r[0], *brute(r[1], templates, threshold)) for r in rows]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert licenses.scan(docs).columns == ["doc_id", "text", "n_words", "hits"]
    assert licenses.digests(docs.limit(0)).count() == 0
    assert licenses.scan(docs, ()).selectExpr("sum(size(hits))").first()[0] == 0


def test_oracle_and_brute_force_over_a_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES["op11_license_scan"])
    names, want = [d[0] for d in want.description], want.fetchall()
    got = queries.op11_license_scan(spark, SF)
    assert names == got.columns == ["doc_id", *COLUMNS]
    got = sorted(map(tuple, got.collect()))
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    assert got == sorted((i, *brute(t, licenses.TEMPLATES, licenses.THRESHOLD)) for i, t in texts.items())
    assert got == sorted(want)
    assert sum(r[2] > 0 for r in got) > 0


def test_too_many_template_words(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        licenses.scan(docs, (Template("t", "t", "a " * (licenses.MOST_WORDS + 1)),))
