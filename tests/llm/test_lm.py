"""The backoff automaton against a plain n-gram model."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmap.llm import lm
from veilmap.llm.common import fold


def plain(rows, train, order, strength):
    counts = [Counter() for _ in range(order)]
    tokens = [[b" ", *(r[1] or "").encode().lower().split(), b" "] for r in rows]
    for t, use in zip(tokens, train):
        for k in range(1, len(t)):
            for n in range(order):
                if use and k - n >= 0:
                    counts[n][tuple(t[k - n : k + 1])] += 1
    total, types = sum(counts[0].values()), len(counts[0])
    out = []
    for t in tokens:
        score = base = known = 0
        for k in range(1, len(t)):
            c = counts[0][(t[k],)]
            known += c > 0
            p = (c + 1) / (total + types + 1)
            base += math.log10(p)
            for n in range(1, order):
                if k - n >= 0:
                    p = (counts[n][tuple(t[k - n : k + 1])] + strength * p) / (counts[n - 1][tuple(t[k - n : k])] + strength)
            score += math.log10(p)
        out.append((len(t) - 1, known, total, base, score))
    return out


@pytest.mark.parametrize("order,strength", [(1, 1.0), (2, 300.0), (3, 0.5)])
def test_scores(awkward, order, strength):
    docs, rows = awkward
    got = defaultdict(list)
    for r in lm.score(docs, F.col("doc_id") % 3 != 1, order=order, strength=strength, block_bytes=900).collect():
        got[r.id].append(tuple(r)[1:])
    want = defaultdict(list)
    for r, v in zip(rows, plain(rows, [r[0] is not None and r[0] % 3 != 1 for r in rows], order, strength)):
        want[r[0]].append(v)
    assert set(got) == set(want)
    for k in want:
        for a, b in zip(sorted(got[k]), sorted(want[k]), strict=True):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)


def test_nothing_to_learn_from(awkward):
    docs, _ = awkward
    rows = lm.score(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.score == r.base_score == 0 for r in rows) and len(rows) == docs.count()
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0


def test_model_probabilities_sum_to_one():
    words = ["a", "b", "c"]
    texts = ["a b a c", "b b a", *words, *[f"{x} {y}" for x in words for y in words]]
    grams = lm.Grams(texts, 2)
    train = np.arange(len(texts)) < 2
    counts = [grams.counts(k, train) for k in range(2)]
    tokens, types = int(counts[0].sum()), int((counts[0] > 0).sum())
    machine = lm.Automaton(grams, counts, tokens, types, 3.0)
    ends = 1 + np.cumsum(grams.lengths)
    second = {t: 10 ** list(machine.walk(int(e - n), int(e)))[1] for t, e, n in zip(texts, ends, grams.lengths)}
    for x, c in zip(words, (3, 3, 1)):
        mass = second[x] + sum(second[f"{x} {y}"] for y in words)  # the end, or a word
        assert mass + 3.0 / (c + 3.0) / (tokens + types + 1) == pytest.approx(1)


def test_fold_of_null_id(spark):
    df = spark.createDataFrame([(None,), (7,)], "doc_id long")
    assert df.where(fold("doc_id", 1, 0)).count() == 1
