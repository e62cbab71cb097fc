"""Structured Streaming over rating streams.

Sums of log weights do not depend on the order of arrival, so the final
posterior is a plain streaming aggregation: it combines on the map side, which
keeps a subject with a third of all evidence from filling one task, and late
rows still converge. Per-evidence output continues the batch operator from
stored log sums, one micro-batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.columns import readable_rating, support_weight
from ..operators.beliefs import softmax
from ..operators.scale import BROADCAST_ROWS, row_numbers
from ..operators.updating import belief_events, sequential_posterior, step_facts
from ..sources.key_index import KeyIndex
from ..sources.sinks import read_if_there


def run_available(writer: DataStreamWriter) -> None:
    """Process what is there, then stop; errors of the query are raised."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


class Generations:
    """The latest row of each key over micro-batches, in folders.

    A batch writes the rows it changed; every ``every`` batches a snapshot of all keys is written too. So a read takes
    one snapshot and the few changes after it, however long the stream has run, and a repeated batch overwrites its own
    folders. Folders older than the last snapshot can be removed at any time.
    """

    def __init__(self, path: str, keys: list[str], every: int = 10):
        self.path, self.keys, self.every = path, keys, every

    def before(self, spark: SparkSession, batch: int | None = None) -> DataFrame | None:
        """The state before a batch, or now."""
        until = F.lit(True) if batch is None else F.col("batch") < batch
        snapshots, changes = (read_if_there(spark, f"{self.path}/{kind}") for kind in ("snapshot", "changes"))
        base, rows = -1, None if changes is None else changes.where(until)
        if snapshots is not None:
            base = snapshots.where(until).agg(F.max("batch")).first()[0]  # from folder names
            base = -1 if base is None else base
        if rows is None:
            return None
        rows = rows.where(F.col("batch") > base)
        if base >= 0:
            rows = rows.unionByName(snapshots.where(F.col("batch") == base))
        values = [c for c in rows.columns if c not in (*self.keys, "batch")]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch").alias("__v"))
        return newest.select(*self.keys, "__v.*")

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")
        if batch % self.every == self.every - 1:
            self.before(rows.sparkSession, batch + 1).write.mode("overwrite").parquet(f"{self.path}/snapshot/batch={batch}")


def log_sums(stream: DataFrame) -> DataFrame:
    """Running evidence per hypothesis; works on a stream and on a table. Ratings that cannot be read are left out
    (``operators.updating.split_ratings`` gives them as a stream of their own)."""
    return stream.where(readable_rating("c", "alpha")).groupBy("subject_id", "level", "ord", "label").agg(
        F.sum(F.log(support_weight("c", "alpha"))).alias("log_w"), F.count(F.lit(1)).alias("n_evidence")
    )


def posterior_of(sums: DataFrame, priors: DataFrame) -> DataFrame:
    """Posterior from prior and log sums; hypotheses without evidence keep weight 1."""
    keys = ["subject_id", "level"]
    touched = sums.select(*keys).distinct()
    base = priors.join(touched, keys, "left_semi").select(*keys, "ord", "label", F.col("p").alias("__p0"))
    both = base.join(sums.select(*keys, "label", "log_w", "n_evidence"), [*keys, "label"], "left")
    log_p = F.when(F.col("__p0") > 0, F.log("__p0")).otherwise(F.lit(float("-inf"))) + F.coalesce("log_w", F.lit(0.0))
    out = softmax(both.withColumn("__l", log_p), "__l", keys=keys)
    return out.select(*keys, "ord", "label", "p", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def stream_posterior(stream: DataFrame, priors: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Keeps log sums and the posterior of every subject and level; read it with ``latest_posterior``.

    A micro-batch brings only the hypotheses it touched; they are put beside the stored sums of the others before the
    posterior is normalised.
    """
    totals, posterior = _sums(path), _posterior(path)

    def write(sums: DataFrame, batch: int) -> None:
        totals.write(sums, batch)
        spark = sums.sparkSession
        touched = read_if_there(spark, f"{path}/sums/changes/batch={batch}").select("subject_id", "level").distinct()
        now = totals.before(spark, batch + 1).join(touched, ["subject_id", "level"], "left_semi")
        posterior.write(posterior_of(now, priors), batch)

    return log_sums(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def _sums(path: str) -> Generations:
    return Generations(f"{path}/sums", ["subject_id", "level", "ord", "label"])


def _posterior(path: str) -> Generations:
    return Generations(f"{path}/posterior", ["subject_id", "level", "ord", "label"])


def latest_posterior(spark: SparkSession, path: str) -> DataFrame:
    """The posterior as of the last finished micro-batch."""
    return _posterior(path).before(spark)


def stream_trajectory(
    events: DataFrame, rate: Callable[[DataFrame], DataFrame], priors: DataFrame, path: str, checkpoint: str
) -> DataStreamWriter:
    """Posterior after every piece of evidence, with the belief events of each batch.

    ``events(user_id, ts, event_id, level)`` arrive as a stream; ``rate`` turns
    numbered events into ratings. Each batch orders its own rows, continues the
    stored step numbers and log sums, and writes trajectory, state and events to
    its own folders, so a repeated batch overwrites itself. Of the past only the
    current state is read, not the history.
    """
    keys = ["subject_id", "level"]
    held = Generations(f"{path}/state", [*keys, "label"])
    crossed = Generations(f"{path}/crossed", ["subject_id", "type"])

    def step(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        numbered = row_numbers(rows, ["user_id"], ["ts", "event_id"], "step")
        state = held.before(spark, batch)
        start = priors.select(*keys, "ord", "label", "p")
        start = start.withColumn("log_p", F.when(F.col("p") > 0, F.log("p")).otherwise(F.lit(float("-inf"))))
        if state is not None:
            offset = state.groupBy(F.col("subject_id").alias("user_id")).agg(F.max("step").alias("__o"))
            numbered = numbered.join(offset, "user_id", "left").withColumn("step", F.col("step") + F.coalesce("__o", F.lit(0))).drop("__o")
            known = state.select(*keys, "label", F.struct("p", "log_p").alias("__s"))
            start = start.join(known, [*keys, "label"], "left").select(
                *keys, "ord", "label", F.coalesce("__s.p", "p").alias("p"), F.coalesce("__s.log_p", "log_p").alias("log_p")
            )
        rated = rate(numbered)
        touched = rated.select(*keys).distinct()
        out = sequential_posterior(start.join(touched, keys, "left_semi"), rated)
        out.write.mode("overwrite").parquet(f"{path}/trajectory/batch={batch}")
        done = spark.read.parquet(f"{path}/trajectory/batch={batch}")
        ends = done.groupBy(*keys, "label").agg(F.max_by(F.struct("step", "p", "log_p"), "step").alias("e")).select(*keys, "label", "e.*")
        held.write(ends, batch)
        found = belief_events(step_facts(done))
        earlier = crossed.before(spark, batch)
        if earlier is not None:
            found = found.join(earlier.select("subject_id", "type"), ["subject_id", "type"], "left_anti")
        once = found.where(F.col("type") == "threshold_crossed")
        crossed.write(once.groupBy("subject_id", "type").agg(F.min("step").alias("step")), batch)
        found.select("subject_id", "level", "step", "type").write.mode("overwrite").parquet(f"{path}/events/batch={batch}")

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)


def window_evidence(stream: DataFrame, size: str, watermark: str, slide: str | None = None) -> DataFrame:
    """Log weight per window and hypothesis; rows later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = stream.withWatermark("ts", watermark).groupBy(w.alias("w"), "ord").agg(
        F.sum(F.log(support_weight("c", "alpha"))).alias("log_w"), F.count(F.lit(1)).alias("n")
    )
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ord", "log_w", "n")


def session_evidence(stream: DataFrame, gap: str, watermark: str) -> DataFrame:
    """Evidence of one subject until it pauses for ``gap``.

    With spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition, which the session sets, sessions are
    merged within each map task first, so that a busy subject sends few rows.
    """
    out = stream.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), "subject_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("subject_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def join_static(stream: DataFrame, static: DataFrame, keys: list[str], *, spread_by: list[str], salts: int = 16, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of a stream with a table: the table is broadcast if it has at most ``max_rows`` rows.

    Beyond that both sides are shuffled by key and salt, so that a busy key of the stream is dealt to ``salts`` tasks by
    its columns ``spread_by``; the table is repeated as often. The repeated table looks as small as the table to the optimizer,
    so that the hint keeps it from being broadcast.
    """
    if static.limit(max_rows + 1).count() <= max_rows:
        return stream.join(F.broadcast(static), keys)
    salted = stream.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    repeated = static.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [*keys, "__salt"]).drop("__salt")


def distinct_evidence(stream: DataFrame, keys: list[str], watermark: str) -> DataFrame:
    """The same evidence counts once while it is within the watermark."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def append_once(stream: DataFrame, path: str, checkpoint: str, on: list[str], *, index: KeyIndex | None = None) -> DataStreamWriter:
    """Incremental sink: one folder per batch, keys of earlier batches are left out.

    Earlier keys are looked up in ``index`` (by default beside ``path``), which opens only the parts that may hold a key of
    the batch. A table that was written without an index is indexed once.
    """
    index = index or KeyIndex(f"{path.rstrip('/')}_keys", on)

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        fresh = rows.dropDuplicates(on)
        if not index.generations(spark, batch):
            stored = read_if_there(spark, path)
            if stored is not None:
                index.add(stored.where(F.col("batch") < batch), batch - 1)
        index.unseen(fresh, batch).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        index.add(spark.read.parquet(f"{path}/batch={batch}"), batch)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
