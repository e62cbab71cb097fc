"""The training-text pipeline: raw documents to encoded ones, five stages over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilmap.llm import bpe, mixing, near, quality, spans
from veilmap.llm.blocks import text_bytes
from veilmap.llm.common import stored, table

#: Text bytes of a task, where a table lies in smaller splits.
TASK_BYTES = 8 << 20


def in_tasks(docs: DataFrame) -> DataFrame:
    """Fewer, larger tasks where the table lies in many small splits: a task writes files of its own, which may cost more than
    its rows. There are three tasks a core at least."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.coalesce(max(3 * cores, -(-text_bytes(docs, "text") // TASK_BYTES)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(in_tasks(docs), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near.one_of_each(in_tasks(docs))


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that an earlier text holds; n_chars follows the text."""
    return spans.without_repeats(docs, length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(in_tasks(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of them and of the text that they decode to."""
    return bpe.encode_column(in_tasks(docs), bpe.read_spec(), keep=["doc_id", "source"], outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_spans", drop_repeated_spans),
    ("mixing", mix_sources),
    ("encoding", encode),
]
#: SQL can express neither the trained classifier nor the stages after it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
