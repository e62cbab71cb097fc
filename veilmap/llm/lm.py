"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model over all training documents, smoothed towards the shorter context in proportion to a
strength: p(w|h) = (c(hw) + s p(w|h')) / (c(h) + s), and add-one at the root. As an automaton, every context seen in
training is a state; every n-gram seen is an arc from its context with the weight log10 p(w|h); the failure arc of a
state costs log10(s / (c(h) + s)) and leads to the state of the shorter context. A text is scored in one traversal from
left to right, which carries the state and adds up the weights of the arcs it takes.

The whole model is never in one place: a block of documents gets the counts of its own n-grams from the corpus-wide
exchange of ``blocks`` and builds the part of the automaton that its documents can reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import slices, tidy

ORDER = 2
STRENGTH = 300.0
#: Distinct tokens whose counts a task holds before it sends them.
HELD_KEYS = 500_000
#: The symbol that ends a text and starts the next; no word holds a blank.
END = b" "


def symbols(texts: list[str | None]) -> tuple[B.Index, np.ndarray, np.ndarray]:
    """END, then each text's words with lower-case A-Z and its END, all in one array; and the number of tokens of each."""
    index = B.Index()
    seqs, lengths = [index.numbers([END])], []
    for t in texts:
        own = (t or "").encode().lower().split()
        own.append(END)
        seqs.append(index.numbers(own))
        lengths.append(len(own))
    return index, np.concatenate(seqs), np.array(lengths, np.int64)


class Grams:
    """The distinct 1- to n-grams of a block: sorted keys, and for each place of the array its gram (-1: none ends there)."""

    def __init__(self, texts: list[str | None], order: int):
        index, self.words, self.lengths = symbols(texts)
        hashes = index.hashes()
        n = len(self.words)
        ends = np.cumsum(self.lengths)
        depth = np.arange(n) - np.r_[0, np.repeat(ends - self.lengths, self.lengths)]  # how many tokens of its text end here
        self.keys, self.of, self.first = [], [], []
        key = hashes[self.words]
        for k in range(1, order + 1):
            if k > 1:
                key = np.r_[np.zeros(1, np.uint64), B.mixed(key[:-1] * B.ODD + hashes[self.words[1:]] + np.uint64(k))]
            # The end before a text counts as its first context, nothing before that does.
            there = np.flatnonzero(depth >= k - 1) if k > 1 else np.arange(n)
            unique, first, of = np.unique(key[there], return_index=True, return_inverse=True)
            place = np.full(n, -1, np.int64)
            place[there] = of
            self.keys.append(unique)
            self.of.append(place)
            self.first.append(there[first])

    def counts(self, level: int, train: np.ndarray) -> np.ndarray:
        """Uses of each gram in the block's training texts."""
        used = np.r_[False, np.repeat(train, self.lengths)] & (self.of[level] >= 0)
        return np.bincount(self.of[level][used], minlength=len(self.keys[level]))


class Automaton:
    """States, arcs and failure arcs for the grams of a block, from their corpus-wide counts.

    State 0 is the root; the others are the seen grams shorter than the order. Arcs are numbered in line over the
    levels; ``arc_at[k][i]`` is the arc that leaves the context of k words before place i with the word at i (-1: none).
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, types: int, strength: float):
        order = len(counts)
        state_of, n_states, n_arcs, p_before = [], 1, 0, None
        fail, cost, length, weight, target, self.arc_at = [np.zeros(1, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)], [], [], []
        for k in range(order):
            at, c = grams.first[k], counts[k]
            seen = c > 0
            shorter = state_of[k - 1][grams.of[k - 1][at]] if k else np.zeros(len(c), np.int64)
            if k < order - 1:
                state_of.append(np.where(seen, n_states + np.cumsum(seen) - 1, 0))
                n_states += int(seen.sum())
                fail.append(shorter[seen])
                cost.append(np.log10(strength / (c[seen] + strength)))
                length.append(np.full(int(seen.sum()), k + 1))
            if k == 0:
                p, arc = (c + 1) / (tokens + types + 1), np.ones(len(c), bool)  # the root has an arc for every word
            else:
                context, suffix = grams.of[k - 1][at - 1], grams.of[k - 1][at]
                p, arc = (c + strength * p_before[suffix]) / (counts[k - 1][context] + strength), seen
            weight.append(np.log10(p[arc]))
            target.append((state_of[k] if k < order - 1 else shorter)[arc])
            number = np.where(arc, n_arcs + np.cumsum(arc) - 1, -1)
            n_arcs += int(arc.sum())
            self.arc_at.append(np.where(grams.of[k] >= 0, number[grams.of[k]], -1) if len(number) else grams.of[k])
            p_before = p
        self.start = int(state_of[0][grams.of[0][0]]) if order > 1 else 0
        self.fail, self.cost, self.length, self.weight, self.target = (np.concatenate(x).tolist() for x in (fail, cost, length, weight, target))

    def walk(self, first: int, last: int) -> Iterator[float]:
        """log10 probability of each token of a text, whose words stand at the places from first to last."""
        fail, cost, length, weight, target = self.fail, self.cost, self.length, self.weight, self.target
        arc_at = [a[first:last].tolist() for a in self.arc_at]
        state = self.start
        for i in range(last - first):
            total = 0.0
            arc = arc_at[length[state]][i]
            while arc < 0:
                total += cost[state]
                state = fail[state]
                arc = arc_at[length[state]][i]
            yield total + weight[arc]
            state = target[arc]


def totals(docs: DataFrame, text_col: str, bits: int) -> tuple[int, int]:
    """Tokens and distinct tokens of the training documents, ends included."""

    most = HELD_KEYS

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for start, n in slices(batch, 0):
                grams = Grams(batch.column(0).slice(start, n).to_pylist(), 1)
                keys, of = np.unique(np.concatenate([keys, grams.keys[0]]), return_inverse=True)
                counts = np.bincount(of, np.concatenate([counts, grams.counts(0, np.ones(n, bool))])).astype(np.int64)
                if len(keys) > most:
                    yield from B.rows(B.PACKED_SCHEMA, B.packed(0, 0, keys, bits, counts)).to_batches()
                    keys, counts = keys[:0], counts[:0]
        used = counts > 0
        yield from B.rows(B.PACKED_SCHEMA, B.packed(0, 0, keys[used], bits, counts[used])).to_batches()

    def add(key: tuple, group: pa.Table) -> pa.Table:
        _, _, keys, counts = B.unpack(group)
        return pa.table({"tokens": [int(counts.sum())], "types": [len(np.unique(keys[counts > 0]))]})

    sent = docs.select(F.col(text_col)).mapInArrow(send, B.PACKED)
    got = sent.groupBy("bucket").applyInArrow(add, "tokens bigint, types bigint").agg(F.sum("tokens"), F.sum("types")).first()
    return got[0] or 0, got[1] or 0


def score(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, strength: float = STRENGTH, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Scores every document by the model of the documents for which ``train`` holds.

    Columns: id, n_tokens (words and the end), n_known (tokens seen in training), train_tokens, base_score (add-one
    unigrams), score; both are log10 probabilities of the whole text. A null text is empty, that is one end token. With
    no training documents every token is unknown. Repeated rows count as often as they occur. An empty table gives an
    empty result. Counts cover all training documents; keys are 64-bit hashes of the words.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = B.text_bytes(own, "text")
    n_blocks = B.plan_blocks(docs, size, block_bytes)
    bits = B.bucket_bits(docs, size * (order * 5) // 6)
    tokens, types = totals(own.where("train"), "text", bits)
    blocked = own.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("int"))

    def send(key: tuple, group: pa.Table) -> pa.Table:
        grams = Grams(group.column("text").to_pylist(), order)
        train = group.column("train").to_numpy(zero_copy_only=False)
        return B.rows(B.PACKED_SCHEMA, (r for k in range(order) for r in B.packed(key[0].as_py(), k, grams.keys[k], bits, grams.counts(k, train))))

    def add(key: tuple, group: pa.Table) -> pa.Table:
        blocks, sizes, keys, counts = B.unpack(group)
        _, of = np.unique(keys, return_inverse=True)
        return B.answers(key[0].as_py(), key[1].as_py(), blocks, sizes, np.bincount(of, counts).astype(np.int64)[of])

    def traverse(key: tuple, group: pa.Table, back: pa.Table) -> pa.Table:
        grams = Grams(group.column("text").to_pylist(), order)
        counts = [B.answered(back, k) for k in range(order)]
        machine = Automaton(grams, counts, tokens, types, strength)
        uses = counts[0][grams.of[0]][1:]
        starts = np.cumsum(grams.lengths) - grams.lengths
        scores = [sum(machine.walk(1 + s, 1 + s + n)) for s, n in zip(starts.tolist(), grams.lengths.tolist(), strict=True)]
        base = np.add.reduceat(np.log10(uses + 1.0), starts) - grams.lengths * np.log10(tokens + types + 1.0)
        known = np.add.reduceat((uses > 0).astype(np.int64), starts)
        tidy()
        return pa.table({"id": group.column("id"), "n_tokens": grams.lengths, "n_known": known, "train_tokens": np.full(len(starts), tokens), "base_score": base, "score": np.array(scores)})

    sent = blocked.groupBy("block").applyInArrow(send, B.PACKED)
    back = sent.groupBy("bucket", "kind").applyInArrow(add, B.ANSWER)
    out = f"id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocked.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(traverse, out)
