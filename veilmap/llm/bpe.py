"""Byte-level BPE encoding and decoding of whole texts, long ones by tree concatenation.

Short texts go to the tokenizers library in batches, or to tiktoken where the tokenizer is one of ranks, which it encodes
alike. A long text is halved again and again, at a blank between words where there is one near the middle, until the
pieces are short; the pieces are encoded together. Going back up, the two
halves of each join are put together: the tokens around the join are encoded again in a window that grows on both sides
until its first token is one of the left half's own and its last token one of the right half's, at the same place. From
there on outwards both halves stand as they are.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

LEAF = 20_000
REACH = 400
BATCH_CHARS = 200_000


def byte_table(vocabulary: dict[str, int], added: dict[int, str]) -> list[bytes]:
    """The bytes each id stands for; byte-level vocabularies write a byte as one printable character."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    char_to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    out = [b""] * (max([*vocabulary.values(), *added], default=-1) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(char_to_byte.get(c, 63) for c in token)
    for i, token in added.items():
        out[i] = token.encode()
    return out


# Fixed value: how byte-level BPE parts a text before merging.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks_of(spec: str) -> dict[bytes, int] | None:
    """Bytes -> id of a plain byte-level BPE whose ids follow the order of its merges; None for any other tokenizer.

    Such a tokenizer is one of ranks, which a faster library encodes alike.
    """
    held = json.loads(spec)
    model, parts = held["model"], held.get("pre_tokenizer") or {}
    options = (parts.get("add_prefix_space"), parts.get("use_regex", True), model.get("ignore_merges", False), model.get("dropout"))
    if model.get("type") != "BPE" or parts.get("type") != "ByteLevel" or held.get("normalizer") or options != (False, True, False, None):
        return None
    vocabulary, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocabulary["".join(m)] for m in merges]
    ranks = {data: i for i, data in enumerate(byte_table(vocabulary, {})) if data}
    special = {t["id"] for t in held.get("added_tokens") or []}
    whole = set(made) | {i for t, i in vocabulary.items() if len(t) == 1} == set(vocabulary.values()) - special
    if not whole or made != sorted(set(made)) or len({bytes([b]) for b in range(256)} & ranks.keys()) < 256:
        return None
    return {data: i for data, i in ranks.items() if i not in special}


class Codec:
    """A tokenizer as the library loads it, with tree concatenation for long texts."""

    def __init__(self, spec: str, leaf: int = LEAF, reach: int = REACH):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = set(added)
        self.bytes_of = byte_table(self.tokenizer.get_vocab(with_added_tokens=False), added)
        self.longest_added = max([len(t) for t in added.values()], default=0)
        self.leaf, self.reach = leaf, max(reach, 4 * self.longest_added)
        self.fast = self.by_ranks(spec)

    def by_ranks(self, spec: str):
        """A faster library's encoder with equal ids; None unless the tokenizer is one of ranks whose added tokens are found just
        where their strings stand and never begin one another."""
        added = self.tokenizer.get_added_tokens_decoder()
        names = sorted(t.content for t in added.values())
        apart = all(names) and not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
        if not apart or any(t.single_word or t.lstrip or t.rstrip for t in added.values()) or (ranks := ranks_of(spec)) is None:
            return None
        import tiktoken

        return tiktoken.Encoding("bpe", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={t.content: i for i, t in added.items()})

    def batch(self, texts: list[str]) -> list[list[int]]:
        if self.fast is not None:
            return [self.fast.encode(t, allowed_special="all") for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, text: str, lo: int, hi: int) -> int:
        """Near the middle: before a lone blank between two words, or else just the middle."""
        mid = (lo + hi) // 2
        span = min(self.reach, (hi - lo) // 4)
        at = mid
        while (at := text.find(" ", at, mid + span)) > 0:
            if at + 1 < hi and not text[at - 1].isspace() and not text[at + 1].isspace():
                return at
            at += 1
        return mid

    def pieces(self, text: str, lo: int, hi: int) -> list:
        """A tree of (lo, hi) leaves: a leaf, or [left, right]."""
        if hi - lo <= self.leaf:
            return (lo, hi)
        at = self.cut(text, lo, hi)
        return [self.pieces(text, lo, at), self.pieces(text, at, hi)]

    def join(self, text: str, lo: int, at: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The encoding of text[lo:hi] from those of its two parts."""
        size = self.bytes_of
        reach = self.reach
        while True:
            a, b = max(lo, at - reach), min(hi, at + reach)
            # Whole tokens of the left part from about a on, of the right part up to about b.
            want, i, got = len(text[a:at].encode()), len(left), 0
            while i and (got < want or not self.starts_char(left[i])):
                i -= 1
                got += len(size[left[i]])
            tail = b"".join(size[t] for t in left[i:])
            want, j, head_len = len(text[at:b].encode()), 0, 0
            while j < len(right) and (head_len < want or not self.starts_char(right[j])):
                head_len += len(size[right[j]])
                j += 1
            head = b"".join(size[t] for t in right[:j])
            window = self.batch([(tail + head).decode()])[0]
            # Tokens that both have, from either end; tokens of the other side don't count.
            same_left = same_right = 0
            while same_left < min(len(window), len(left) - i) and window[same_left] == left[i + same_left]:
                same_left += 1
            while same_right < min(len(window), j) and window[-1 - same_right] == right[j - 1 - same_right]:
                same_right += 1
            if (i == 0 or same_left > 1) and (j == len(right) or same_right > 1):
                return left[:i] + window + right[j:]
            if a == lo and b == hi:
                return self.batch([text[lo:hi]])[0]
            reach *= 2

    def starts_char(self, token: int) -> bool:
        first = self.bytes_of[token][:1]
        return not first or first[0] & 0xC0 != 0x80

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; the leaves of long texts are encoded in the same batches as short texts."""
        trees = [self.pieces(t, 0, len(t)) for t in texts]
        leaves: list[str] = []

        def gather(text: str, tree) -> None:
            if isinstance(tree, tuple):
                leaves.append(text[tree[0] : tree[1]])
            else:
                for part in tree:
                    gather(text, part)

        for t, tree in zip(texts, trees, strict=True):
            gather(t, tree)
        encoded = iter(self.batch(leaves))

        def build(text: str, tree) -> tuple[int, int, list[int]]:
            if isinstance(tree, tuple):
                return (*tree, next(encoded))
            (lo, at, left), (_, hi, right) = build(text, tree[0]), build(text, tree[1])
            return lo, hi, self.join(text, lo, at, hi, left, right)

        return [build(t, tree)[2] for t, tree in zip(texts, trees, strict=True)]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes with special tokens kept; ids outside the vocabulary give nothing."""
        table = self.bytes_of
        return b"".join(table[i] for i in ids if 0 <= i < len(table)).decode("utf-8", "replace")


class Coder:
    """A codec that each Python worker makes once, however many tasks it runs."""

    def __init__(self, spec: str, leaf: int):
        self.spec, self.leaf, self.codec = spec, leaf, None

    def __getstate__(self):
        return {"spec": self.spec, "leaf": self.leaf, "codec": None}

    def get(self) -> Codec:
        if self.codec is None:
            self.codec = Codec(self.spec, self.leaf)
        return self.codec


def encode_column(docs: DataFrame, spec: str, *, text_col: str = "text", keep: list[str] | None = None, outputs: tuple[str, ...] = ("ids",), leaf: int = LEAF) -> DataFrame:
    """Adds to the kept columns any of: ids (array<int>), decoded, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty and has no ids. Rows are independent, so nothing is shuffled; a batch is bounded by
    characters. ``spec`` is the tokenizer's own JSON, a fixed file that does not grow with the data.
    """
    kinds = {"ids": "array<int>", "decoded": "string", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    keep = docs.columns if keep is None else keep
    keep = [c for c in keep if c not in outputs]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    held = docs.sparkSession.sparkContext.broadcast(Coder(spec, leaf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        codec = held.value.get()
        for batch in batches:
            start = 0
            texts = batch.column(batch.num_columns - 1)
            while start < batch.num_rows:
                group, size = [], 0
                while start + len(group) < batch.num_rows and size < BATCH_CHARS:
                    group.append(texts[start + len(group)].as_py())
                    size += len(group[-1])
                ids = codec.encode_all(group)
                made = {}
                if "ids" in outputs:
                    made["ids"] = pa.array(ids, pa.list_(pa.int32()))
                if "n_tokens" in outputs:
                    made["n_tokens"] = pa.array([len(x) for x in ids], pa.int64())
                if "ids_sha256" in outputs:
                    made["ids_sha256"] = pa.array([hashlib.sha256(np.asarray(x, "<u4").tobytes()).hexdigest() for x in ids])
                if "decoded" in outputs or "decoded_sha256" in outputs:
                    decoded = [codec.decode(x) for x in ids]
                    if "decoded" in outputs:
                        made["decoded"] = pa.array(decoded)
                    if "decoded_sha256" in outputs:
                        made["decoded_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])
                own = [batch.column(k).slice(start, len(group)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, *[made[k] for k in outputs]], names=[*keep, *outputs])
                start += len(group)
            tidy()

    made_fields = T.StructType.fromDDL(", ".join(f"{k} {kinds[k]}" for k in outputs)).fields
    return source.mapInArrow(run, T.StructType(source.drop("__text").schema.fields + made_fields))


def read_spec(path: str | None = None) -> str:
    """The tokenizer file, read on the driver; by default the public byte-level vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()
