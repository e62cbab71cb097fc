"""One large JSON array of objects, read by many tasks.

A multi-line JSON reader gives a file to one task. Here the text reader cuts the file at every ``}``, which it can do from
any byte on, so a file has as many tasks as it has splits, and any storage that Spark reads will do. Whether a ``}`` ends
a record depends on all the text before it: on being inside a string (quote parity) and on the nesting depth. A ``}``
cannot follow a backslash in valid JSON, so no escape reaches from one fragment into the next.

1. Every split says what it does to the state: its quote parity, and its change of depth if it starts outside or inside a
   string. One row a split.
2. Running sums over these rows give the state at the start of each split: parity first, then depth.
3. Each split puts together the records that lie in it. Records that cross a border leave a piece in each split, and only
   these pieces are shuffled.

The text is scanned three times (states, whole records, pieces) and never shuffled but for the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import running_sums
from ..session import checkpointed

#: Splits whose states are broadcast (some 40 bytes each); more are joined by a shuffle of the fragments.
BROADCAST_SPLITS = 200_000
SPLIT = ("file", "block")
STATES = "file long, block long, parity long, out_delta long, in_delta long, out_least long, in_least long"
PIECES = "file long, block long, record long, value string"
#: Change of depth by a byte outside strings.
STEP = np.zeros(256, np.int64)
STEP[[ord("{"), ord("[")]], STEP[[ord("}"), ord("]")]] = 1, -1


def _fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Fragments in file order within a split."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_path").alias("path"), "value"
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, np.ndarray]]:
    """(split, first row, bytes) of each run of rows of one split; every fragment has its brace again."""
    file, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in SPLIT)
    value = batch.column("value").cast(pa.large_string())
    _, offsets, data = value.buffers()
    bounds = np.frombuffer(offsets, np.int64)[value.offset:value.offset + len(value) + 1]
    text = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.empty(0, np.uint8)
    bounds = bounds - bounds[0] + np.arange(len(bounds))
    brace = np.zeros(int(bounds[-1]), bool)
    brace[bounds[1:] - 1] = True
    stream = np.full(len(brace), ord("}"), np.uint8)
    stream[~brace] = text
    starts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(file)]
    for lo, hi in zip(starts[:-1], starts[1:]):
        yield (int(file[lo]), int(block[lo])), lo, stream[bounds[lo]:bounds[hi]]


def _quotes(stream: np.ndarray) -> np.ndarray:
    """Positions of quotes that no backslash escapes."""
    at = np.flatnonzero(stream == ord('"'))
    escaped = np.zeros(len(at), bool)
    some, back = np.arange(len(at)), at - 1
    while len(some):
        more = (back >= 0) & (stream[back] == ord("\\"))
        some, back = some[more], back[more] - 1
        escaped[some] ^= True
    return at[~escaped]


def _brackets(stream: np.ndarray, quotes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of brackets, parity of the quotes before each, which of them are closing braces)."""
    at = np.flatnonzero(STEP[stream])
    return at, np.searchsorted(quotes, at) % 2, stream[at] == ord("}")


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, row = None, None
    done: list[list] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        for split, _, stream in _runs(batch):
            if split != key:
                key, row = split, [*split, 0, 0, 0, None, None]
                done.append(row)
            quotes = _quotes(stream)
            at, odd, brace = _brackets(stream, quotes)
            for start in (0, 1):
                free = odd == (start + row[2]) % 2
                depth = row[3 + start] + np.cumsum(np.where(free, STEP[stream[at]], 0))
                if (free & brace).any():
                    least = int(depth[free & brace].min())
                    row[5 + start] = least if row[5 + start] is None else min(row[5 + start], least)
                row[3 + start] = int(depth[-1])
            row[2] = (row[2] + len(quotes)) % 2
    names = [part.split()[0] for part in STATES.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], pa.int64()) for i in range(len(names))], names=names)


def _carries(states: DataFrame) -> DataFrame:
    """State at the start of each split: inside a string or not, depth, records ended in earlier splits or not (a number)."""
    before = lambda df, name, value: running_sums(df, ["file"], ["block"], {f"__{name}": value}).withColumn(name, F.col(f"__{name}") - value).drop(f"__{name}")
    quoted = before(states, "quotes", F.col("parity")).withColumn("inside", F.col("quotes") % 2)
    quoted = quoted.withColumns({
        "delta": F.when(F.col("inside") == 1, F.col("in_delta")).otherwise(F.col("out_delta")),
        "least": F.when(F.col("inside") == 1, F.col("in_least")).otherwise(F.col("out_least")),
    })
    deep = before(quoted, "depth", F.col("delta"))
    closing = F.coalesce((F.col("depth") + F.col("least") <= 1).cast("long"), F.lit(0).cast("long"))
    return before(deep.withColumn("closing", closing), "record", F.col("closing"))


def _cut(border: bool):
    """Kernel over fragments with the state of their split: whole records, or the pieces at the borders of splits."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        rows: list[tuple] = []
        parts: list[bytes] = []  # of the record that is open
        state = depth = record = 0
        partial = ended = False

        def leave():
            if border and parts:
                rows.append((*key, record + ended, b"".join(parts).decode()))
            parts.clear()

        def batch_of():
            columns = list(zip(*rows)) or [[], [], [], []]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()])], names=["file", "block", "record", "value"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column("inside").null_count:
                raise ValueError("the splits of the files changed between two scans; read again")
            for split, row, stream in _runs(batch):
                if split != key:
                    leave()
                    key = split
                    state, depth, record = (batch.column(c)[row].as_py() for c in ("inside", "depth", "record"))
                    # A record begins here unless an earlier split left one open.
                    partial, ended = state == 1 or depth > 1, False
                quotes = _quotes(stream)
                at, odd, brace = _brackets(stream, quotes)
                free = odd == state
                after = depth + np.cumsum(np.where(free, STEP[stream[at]], 0))
                closing = free & brace
                # The text after the last brace, "]", has a brace too many and ends at -1.
                if (after[closing] == 0).any():
                    raise ValueError("not an array of objects")
                start = 0
                for end in (at[closing & (after == 1)] + 1).tolist():
                    if partial == border:
                        rows.append((*key, record, (b"".join(parts) + stream[start:end].tobytes()).decode()))
                    parts.clear()
                    partial, ended, start = False, True, end
                parts.append(stream[start:].tobytes())
                state, depth = (state + len(quotes)) % 2, int(after[-1])
            yield batch_of()
        leave()
        yield batch_of()

    return cut


def read_array(spark: SparkSession, path: str | list[str], schema: str, *, broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """Rows of files that each hold one JSON array of objects, whatever the number and length of lines.

    Elements that are numbers, strings, booleans or null give no row, arrays within the array are not supported. An empty
    file or array gives no rows; a record that does not fit the schema gives nulls, as Spark's JSON reader does. A file that
    ends within a string or a record, or that is no array, is an error.
    """
    parts = _fragments(spark, path)
    states = checkpointed(parts.drop("path").mapInArrow(_states, STATES))
    carries = checkpointed(_carries(states))
    last = carries.groupBy("file").agg(F.max_by(F.struct((F.col("depth") + F.col("delta")).alias("depth"), ((F.col("quotes") + F.col("parity")) % 2).alias("inside")), "block").alias("l"))
    # The text after the last brace, "]", has no brace of its own but is counted as if it had.
    broken = last.where((F.col("l.depth") != -1) | (F.col("l.inside") != 0)).first()
    if broken is not None:
        name = parts.where(F.col("file") == broken["file"]).select("path").first()
        raise ValueError(f"not a complete array of objects: {name['path']}")
    start = carries.select(*SPLIT, "inside", "depth", "record")
    if start.limit(broadcast_splits + 1).count() <= broadcast_splits:
        cut = parts.drop("path").join(F.broadcast(start), list(SPLIT), "left")
    else:
        numbered = parts.drop("path").withColumn("__row", F.monotonically_increasing_id())
        cut = numbered.join(start, list(SPLIT), "left").repartition(*SPLIT).sortWithinPartitions(*SPLIT, "__row").drop("__row")
    whole = cut.mapInArrow(_cut(False), PIECES).select("value")
    pieces = cut.mapInArrow(_cut(True), PIECES)
    joined = pieces.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("p"))
    joined = joined.select(F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value"))
    # Before a record there are only the bracket, commas, blanks and elements that are no objects; after the last one, no record.
    leading = r'\A(?:"(?:[^"\\]++|\\.)*+"|[^"{]++)*+'
    record = whole.unionByName(joined).select(F.regexp_replace("value", leading, "").alias("value")).where(F.col("value").startswith("{"))
    return record.select(F.from_json("value", schema).alias("r")).select("r.*")
