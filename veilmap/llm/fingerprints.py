"""Threshold-scaled sketches of documents, by DataFrame operations only.

A document's sketch holds every hash of its word shingles that falls below a fixed fraction of the hash range. The same
hashes survive in every document, so that sketches can be united, and resemblance and containment of documents of very
different length are ratios of plain set sizes. A short text would keep few hashes or none; ``with_edits`` keeps all
hashes of a short text and compares two short texts exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.scale import row_numbers
from .common import BLANKS, stored

SHINGLE = 5
FRACTION = 0.5
#: Texts of at most this many distinct shingles keep every hash.
SHORT = 256


def words(text: Column) -> Column:
    """Lower-case words; null and empty texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANKS), lambda w: w != "")


def below(hashes: Column, fraction: float) -> Column:
    """The hashes in the lowest ``fraction`` of the range."""
    limit = F.lit(min((1 << 63) - 1, -(1 << 63) + round(fraction * (1 << 64))))
    return hashes if fraction >= 1 else F.filter(hashes, lambda h: h < limit)


def sketch(text: Column, *, shingle: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """Sorted distinct shingle hashes below the threshold. A text of fewer words than a shingle is one shingle."""
    parts = words(text)

    def hashes(w: Column) -> Column:
        last = F.greatest(F.size(w) - shingle, F.lit(0))
        each = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(*[F.try_element_at(w, i + k) for k in range(shingle)]))
        return F.when(F.size(w) > 0, each).otherwise(F.array().cast("array<bigint>"))

    # One-element transform: the words are split once and used by name below.
    kept = below(F.flatten(F.transform(F.array(parts), hashes)), fraction)
    return F.array_sort(F.array_distinct(kept))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; null where neither sketch holds a hash."""
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null where a's sketch is empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0))


def merged(sketches: DataFrame, keys: list[str], col: str) -> DataFrame:
    """The sketch of all documents of a key together."""
    one = sketches.select(*keys, F.explode(col).alias("__h")).distinct()
    return one.groupBy(*keys).agg(F.array_sort(F.collect_list("__h")).alias(col))


def printed(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def alike(near: Column, same_text: Column) -> Column:
    return F.when(same_text, 1.0).otherwise(F.coalesce(near, F.lit(0.0)))


def likeness(a: str, b: str, same_text: Column, short: int) -> Column:
    """Of two texts with columns ``x_all`` (every hash) and ``x_kept`` (those below the fixed fraction)."""
    few = (F.size(f"{a}_all") <= short) & (F.size(f"{b}_all") <= short)
    return alike(F.when(few, resemblance(F.col(f"{a}_all"), F.col(f"{b}_all"))).otherwise(resemblance(F.col(f"{a}_kept"), F.col(f"{b}_kept"))), same_text)


def followers(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, next_id): every distinct id with the next one in ascending order, the last with the first.

    Works on ids only: they are range-partitioned and numbered, and each is joined with the number after its own.
    A null id comes last.
    """
    ids = docs.select(F.col(id_col).alias("id")).distinct()
    ids = ids.withColumn("last", F.col("id").isNull().cast("int"))
    numbered = stored(row_numbers(ids, [], ["last", "id"], "rn", group_rows=0, at_most=1).drop("last"), "fp-order")
    n = numbered.count()
    after = numbered.select(F.when(F.col("rn") == 1, F.lit(n)).otherwise(F.col("rn") - 1).alias("rn"), F.col("id").alias("next_id"))
    return numbered.join(after, "rn").select("id", "next_id")


def with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, fraction: float = FRACTION, short: int = SHORT) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is replaced by the next document's start.

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A fingerprint holds the
    hashes below ``fraction``, or every hash of a text of at most ``short`` distinct shingles, so only a text without
    words has an empty one. Likeness is the Jaccard similarity, exact for two such short texts and else estimated from
    the hashes below ``fraction``; it is 1 for equal texts, 0 where neither has words. A null text is empty. Rows
    with one id have the same next document: of the next id, the row with the least text hash. In a table of one id a
    document is its own next one. An empty table gives an empty result.
    """
    order = followers(docs, id_col)
    # Ids are compared as one-field structs, in which null equals null, so that joins and window share one partitioning.
    # Both joins read the same two columns, so that the texts are shuffled once.
    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(F.col(id_col).alias("id")).alias("key"))
    before = order.select(F.struct(F.col("next_id").alias("id")).alias("next"), F.struct("id").alias("to"))
    # Each document goes to its predecessor as text: whatever the fraction, that is less to shuffle than start and hashes.
    placed = own.join(before, F.col("key") == F.col("next")).withColumn("hash", F.xxhash64("text"))
    first = placed.withColumn("rn", F.row_number().over(W.partitionBy("key").orderBy("hash"))).where("rn = 1")
    sent = first.select(F.col("to"), F.col("text").alias("next_text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    both = own.join(sent, F.col("key") == F.col("to")).withColumn("n_chars", n.cast("bigint"))
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    texts = {"own": "text", "edited": "edited", "next": "next_text"}
    both = both.withColumns({f"{k}_all": sketch(F.col(c), shingle=shingle, fraction=1.0) for k, c in texts.items()})
    both = both.withColumns({f"{k}_kept": below(F.col(f"{k}_all"), fraction) for k in texts})

    def shown(k: str) -> Column:
        return printed(F.when(F.size(f"{k}_all") <= short, F.col(f"{k}_all")).otherwise(F.col(f"{k}_kept")))

    return both.select(
        F.col("key.id").alias("id"), "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        shown("own").alias("fingerprint"), shown("edited").alias("edited_fingerprint"),
        likeness("own", "edited", F.col("text") == F.col("edited"), short).alias("near_edited"),
        likeness("own", "next", F.col("text") == F.col("next_text"), short).alias("near_next"),
    )
