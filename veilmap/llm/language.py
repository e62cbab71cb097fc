"""Language identification, words first.

A known word adds its log frequency in every language. An unseen word falls back to its character n-grams, from the
longest length down to single characters, and takes the first length of which at least one n-gram is known. The
frequencies come from a bounded sample of the labelled documents of each language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

LONGEST = 4
#: About so many documents of each language at most are learned from, chosen by hash.
ROWS_PER_LANGUAGE = 800
#: Characters that Python's \w takes though they are numbers and no letters, as fractions, superscripts, Roman numerals.
NUMBERS = "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
NOT_LETTERS, BLANKED = frozenset(NUMBERS), dict.fromkeys(map(ord, NUMBERS), " ")
#: Runs of letters and of such numbers.
LETTERS = re.compile(r"[^\W\d_]+")
WORDS_REMEMBERED = 100_000


def words_of(text: str) -> list[str]:
    """Runs of letters, the same as Java's \\p{L} by which the training side splits.

    The numbers are blanked out first, in the few texts that have any: as part of the pattern they cost more than all the rest.
    """
    if not text.isascii() and not NOT_LETTERS.isdisjoint(text):
        text = text.translate(BLANKED)
    return LETTERS.findall(text)


def training_counts(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, rows: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(word, lang, n) and (gram, lang, n) over the sample; a word counts as known from ``min_count`` uses on."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = known.groupBy(F.col(lang_col).alias("__lang")).count()
    at = F.pmod(F.xxhash64(F.col(id_col), F.col(lang_col)), F.lit(1 << 30))
    share = F.broadcast(sizes.select("__lang", (F.lit(float(rows)) / F.col("count") * (1 << 30)).alias("__most")))  # one row per language
    sample = known.join(share, F.col(lang_col) == F.col("__lang")).where(at < F.col("__most"))
    words = sample.select("__lang", F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    words = words.groupBy(F.col("__lang").alias("lang"), "word").agg(F.count(F.lit(1)).alias("n"))
    marked = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    grams = None
    for k in range(1, LONGEST + 1):
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - k + 1, F.lit(1)))
        part = words.select("lang", "n", marked.alias("m"), F.explode(starts).alias("i")).select("lang", F.substring(F.col("m"), F.col("i"), F.lit(k)).alias("gram"), "n").where(F.length("gram") == k)
        grams = part if grams is None else grams.unionByName(part)
    grams = grams.groupBy("gram", "lang").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return words.where(F.col("n") >= min_count), grams


def token_table(rows: list[tuple], at: dict[str, int]) -> tuple[dict[str, int], np.ndarray]:
    """Token -> row, and per row the log frequency of the token in each language."""
    index: dict[str, int] = {}
    for token, _, _ in rows:
        index.setdefault(token, len(index))
    counts = np.full((len(index), len(at)), 0.1, np.float32)
    for token, lang, n in rows:
        counts[index[token], at[lang]] += n
    return index, np.log(counts / counts.sum(axis=0, keepdims=True)) if len(index) else counts


def build(words: list[tuple], grams: list[tuple]) -> dict:
    """The model as plain tables: langs in code point order, words, and n-grams by length."""
    langs = sorted({lang for _, lang, _ in [*words, *grams]})
    at = {lang: i for i, lang in enumerate(langs)}
    by_length = [token_table([g for g in grams if len(g[0]) == k], at) for k in range(1, LONGEST + 1)]
    return {"langs": langs, "words": token_table(words, at), "grams": by_length}


def word_vector(model: dict, word: str) -> np.ndarray:
    index, logs = model["words"]
    if (i := index.get(word)) is not None:
        return logs[i]
    marked = f"<{word}>"
    for k in range(LONGEST, 0, -1):
        index, logs = model["grams"][k - 1]
        hits = [j for s in range(len(marked) - k + 1) if (j := index.get(marked[s : s + k])) is not None]
        if hits and (k > 1 or len(hits) > 2):  # the two marks alone say nothing
            return logs[hits].mean(axis=0)
    return np.zeros(len(model["langs"]), np.float32)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE, min_count: int = 2) -> dict:
    """Counts in Spark over at most about ``rows`` documents per language; the tables that come back are bounded by them."""
    words, grams = training_counts(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, rows=rows, min_count=min_count)
    take = lambda df, c: sorted((r[c], r["lang"], r["n"]) for r in df.toLocalIterator())
    return build(take(words, "word"), take(grams, "gram"))


def predict(docs: DataFrame, model: dict, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score, the share of the best language in the softmax over the document's sums.

    ``und`` with score 0 where the text is null, has no letter, or no language was learned. Ties go to the first
    language in code point order.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    remembered = WORDS_REMEMBERED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        langs_known = model["langs"]
        known: dict[str, int] = {}
        table = np.zeros((2 * remembered, len(langs_known)), np.float32)
        for batch in batches:
            langs, scores = [], np.zeros(batch.num_rows)
            for r, text in enumerate(batch.column(batch.num_columns - 1)):
                words = words_of((text.as_py() or "").lower())
                if not words or not langs_known:
                    langs.append("und")
                    continue
                if len(known) > remembered:
                    known.clear()
                new = set(words).difference(known)
                if len(known) + len(new) > len(table):
                    table = np.resize(table, (len(known) + len(new), len(langs_known)))
                for w in new:
                    at = known[w] = len(known)
                    table[at] = word_vector(model, w)
                at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                z = table[at].sum(axis=0, dtype=np.float64)
                best = int(z.argmax())
                langs.append(langs_known[best])
                scores[r] = 1 / np.exp(z - z[best]).sum()
            own = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(langs, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])
        known.clear()
        tidy()

    extra = T.StructType.fromDDL("lang_pred string, score double").fields
    return source.mapInArrow(run, T.StructType([*source.drop("__text").schema.fields, *extra]))
