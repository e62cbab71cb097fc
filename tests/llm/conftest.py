"""Small tables with every awkward row: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, block int, score double"


def awkward_rows(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["été", "Straße", "日本", "🙂"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    texts = [*base, base[0], base[0].upper(), base[1] + " tail", "\n".join(base[2:5]), base[2] + "\t" + base[3], None, "", "  \n ", "x" * 700, "ab" * 600, " ".join(["again"] * 300), " ".join(base) * 2]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s10", "s2", None]), len(t or ""), "mine", 7, 0.5) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (rows[6][0], base[9], "en", "s1", 3, "x", 0, None), (None, base[8], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    rows = awkward_rows()
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache(), rows
