"""License scans by an exact set-similarity join of templates and text blocks.

A template of n words meets every block of n consecutive words of every text (a shorter text is one block). A block
matches if it holds at least the threshold's share of the template's distinct tokens. The join is exact:

* all template tokens are ordered by their frequency over all documents, rarest first;
* prefix filter: a matching block holds one of the template's first m - a + 1 tokens, where a of its m are needed;
* length filter: it holds at least a places of template tokens;
* positional filter: if the rarest common token is the template's i-th, a - 1 of the places around it are of later tokens.

Blocks that are left are counted exactly. A phrase is a template of threshold 1 whose matching blocks are then checked
word by word. The templates are a parameter and go to every task; documents stay where they are, and only the counts of
template tokens are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

THRESHOLD = 0.85
#: Template words in all that may go to every task.
MOST_WORDS = 200_000
#: Digits, lower-case letters and all bytes beyond ASCII stay, capitals turn small, the rest parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Template:
    """A text to look for; with ``ordered`` its words must stand consecutively, all of them."""

    name: str
    label: str
    text: str
    ordered: bool = False


# Three phrases, and notices as the licenses' publishers word them.
PHRASES = (
    Template("mit license", "mit", "mit license", True),
    Template("apache license", "apache", "apache license", True),
    Template("general public license", "gpl", "general public license", True),
)
NOTICES = (
    Template("mit-line", "mit", "Released under the MIT License."),
    Template("mit-permission", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("apache-line", "apache", "Licensed under the Apache License, Version 2.0."),
    Template("apache-notice", "apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("gpl-line", "gpl", "This work is licensed under the GNU General Public License, version 3."),
    Template("gpl-notice", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("bsd-notice", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc-notice", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mpl-notice", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("cc-by-line", "cc-by", "Licensed under CC BY 4.0."),
    Template("cc-by-sa-line", "cc-by-sa", "Licensed under CC BY-SA 4.0."),
    Template("cc-by-nc-line", "cc-by-nc", "Licensed under CC BY-NC 4.0."),
    Template("cc-notice", "cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)
TEMPLATES = PHRASES + NOTICES


def words(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(WORD_BYTES).split()


class Pattern:
    """A template in terms of token ranks: which it holds, its prefix, and how many distinct ones a block needs."""

    def __init__(self, template: Template, rank: dict[bytes, int], threshold: float):
        self.words = np.array([rank[w] for w in words(template.text.encode())], np.int64)
        self.ordered, self.n = template.ordered, len(self.words)
        own = np.unique(self.words)  # ranks ascend, so this is the global order
        self.m = len(own)
        self.need = self.m if template.ordered else math.ceil(threshold * self.m - 1e-9)
        self.prefix = own[: self.m - self.need + 1]
        self.order = np.full(len(rank) + 1, -1, np.int64)  # the last entry stands for all other words
        self.order[own] = np.arange(self.m)

    def blocks(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the matching blocks of a text, in order, and how many distinct tokens each holds."""
        n, none = min(self.n, len(ranks)), (np.empty(0, np.int64), np.empty(0, np.int64))
        order = self.order[ranks]
        at = np.flatnonzero(order >= 0)
        order = order[at]
        if len(at) < self.need or not (at[self.need - 1 :] - at[: len(at) - self.need + 1] < n).any():
            return none  # length filter
        last = len(ranks) - n
        possible = np.zeros(last + 2, np.int64)
        for i in range(len(self.prefix)):
            places, later = at[order == i], at[order > i]
            around = np.searchsorted(later, places + n) - np.searchsorted(later, places - n + 1)
            places = places[around >= self.need - 1]  # positional filter
            np.add.at(possible, np.minimum(np.maximum(places - n + 1, 0), last + 1), 1)
            np.add.at(possible, np.minimum(places, last) + 1, -1)
        if not possible.any():
            return none
        # A place counts for the blocks that hold it and not the same token's place before.
        by = np.lexsort((at, order))
        before = np.full(len(at), -1, np.int64)
        same = np.r_[False, order[by][1:] == order[by][:-1]]
        before[by[same]] = at[by[np.flatnonzero(same) - 1]]
        lo, hi = np.maximum(np.maximum(before + 1, at - n + 1), 0), np.minimum(at, last)
        real = lo <= hi
        held = np.zeros(last + 2, np.int64)
        np.add.at(held, lo[real], 1)
        np.add.at(held, hi[real] + 1, -1)
        held = np.cumsum(held)[: last + 1]
        starts = np.flatnonzero((np.cumsum(possible)[: last + 1] > 0) & (held >= self.need))
        if self.ordered and len(starts):
            if len(ranks) < self.n:
                return none
            same = np.ones(len(starts), bool)
            for j, w in enumerate(self.words):
                same &= ranks[starts + j] == w
            starts = starts[same]
        return starts, held[starts]


def ranked(data: bytes | None, rank: dict[bytes, int]) -> np.ndarray:
    own = words(data)
    return np.fromiter(map(rank.get, own, repeat(len(rank))), np.int64, len(own))


def token_order(docs: DataFrame, templates: tuple[Template, ...], text_col: str) -> dict[bytes, int]:
    """Rank of each template token by its frequency over all documents, rarest first, ties by the token."""
    vocabulary = sorted({w for t in templates for w in words(t.text.encode())})
    at = {w: i for i, w in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(at) + 1, np.int64)
        for batch in batches:
            for data in pc.cast(batch.column(0), pa.binary()):
                total += np.bincount(ranked(data.as_py(), at), minlength=len(total))
        used = np.flatnonzero(total[:-1])
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["token", "n"])

    counted = docs.select(F.col(f"`{text_col}`")).mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    n = {r.token: r.n for r in counted.collect()}  # the templates' own tokens at most
    order = sorted(range(len(vocabulary)), key=lambda i: (n.get(i, 0), vocabulary[i]))
    return {vocabulary[i]: r for r, i in enumerate(order)}


HITS = "array<struct<template:string,label:string,ordered:boolean,blocks:bigint,first:bigint,last:bigint,containment:double>>"


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, *, text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds n_words and ``hits``: per matching template its blocks, their first and last start (words from 0), the best containment.

    Words are runs of letters, digits and characters beyond ASCII, with A-Z in lower case. A null or empty text has no
    words and no hits, and so has a template without words. Rows are independent: repeated rows each get the same hits. Kept columns named
    ``n_words`` or ``hits`` give way to the new ones. Templates of more than 200,000 words in all are an error.
    """
    templates = tuple(t for t in templates if words(t.text.encode()))
    if sum(len(words(t.text.encode())) for t in templates) > MOST_WORDS:
        raise ValueError(f"templates of at most {MOST_WORDS} words in all go to every task")
    rank = token_order(docs, templates, text_col)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "hits")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__scanned"))
    patterns = [Pattern(t, rank, threshold) for t in templates]
    named = [(t.name, t.label, t.ordered) for t in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Inverted index of the prefixes: which templates a token can start a match of.
        holders = [[] for _ in range(len(rank) + 1)]
        for p, pattern in enumerate(patterns):
            for r in pattern.prefix.tolist():
                holders[r].append(p)
        rare = np.array([bool(h) for h in holders])
        kinds = pa.struct([("template", pa.string()), ("label", pa.string()), ("ordered", pa.bool_()), ("blocks", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())])
        for batch in batches:
            sizes, hits = [], []
            for data in pc.cast(batch.column(batch.num_columns - 1), pa.binary()):
                ranks = ranked(data.as_py(), rank)
                sizes.append(len(ranks))
                own = []
                for p in sorted({p for r in np.unique(ranks[rare[ranks]]).tolist() for p in holders[r]}):
                    starts, held = patterns[p].blocks(ranks)
                    if len(starts):
                        own.append((*named[p], len(starts), int(starts[0]), int(starts[-1]), int(held.max()) / patterns[p].m))
                hits.append([dict(zip(kinds.names, h, strict=True)) for h in own])
            tidy()
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(sizes, pa.int64()), pa.array(hits, pa.list_(kinds))], names=[*keep, "n_words", "hits"])

    extra = T.StructType.fromDDL(f"n_words bigint, hits {HITS}").fields
    return source.mapInArrow(run, T.StructType([*source.drop("__scanned").schema.fields, *extra]))


def digests(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    Base columns speak of the ordered phrases: all places, the smallest and largest start (null without a place), their
    labels. ``labels`` has those of all templates that match, ``score`` the best containment (0 without a match), and
    ``n_blocks`` counts the matching blocks of the templates that are no phrases.
    """
    found = scan(docs, keep=[id_col], **options)
    base, other = F.filter("hits", lambda h: h["ordered"]), F.filter("hits", lambda h: ~h["ordered"])
    of = lambda hits, field: F.transform(hits, lambda h: h[field])
    total = lambda hits: F.aggregate(of(hits, "blocks"), F.lit(0).cast("bigint"), lambda a, b: a + b)
    joined = lambda hits: F.array_join(F.array_sort(F.array_distinct(of(hits, "label"))), ",")
    return found.select(
        F.col(f"`{id_col}`").alias("id"), "n_words", total(base).alias("n_base"), F.array_min(of(base, "first")).alias("first_word"), F.array_max(of(base, "last")).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("hits")).alias("labels"), F.coalesce(F.array_max(of(F.col("hits"), "containment")), F.lit(0.0)).alias("score"), total(other).alias("n_blocks"),
    )


def oracle(templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``digests`` with these templates: every block's distinct template tokens by interval sums."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows, tokens = [], []
    for t in templates:
        own = [w.decode() for w in words(t.text.encode())]
        m = len(set(own))
        need = m if t.ordered else math.ceil(threshold * m - 1e-9)
        rows.append(f"({quoted(t.name)}, {quoted(t.label)}, {str(t.ordered).lower()}, {len(own)}, {m}, {need}, [{', '.join(map(quoted, own))}])")
        tokens += [f"({quoted(t.name)}, {quoted(w)})" for w in sorted(set(own))]
    return f"""
WITH templates(name, label, ordered, n, m, need, ws) AS (VALUES {', '.join(rows)}),
tokens(name, w) AS (VALUES {', '.join(tokens)}),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
places AS MATERIALIZED (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM docs),
held AS (SELECT d.r, t.name, t.need, least(t.n, len(d.ws)) AS n, len(d.ws) - least(t.n, len(d.ws)) AS last, p.p,
    coalesce(lag(p.p) OVER (PARTITION BY p.r, k.name, p.w ORDER BY p.p), -1) AS before
    FROM places p JOIN tokens k ON p.w = k.w JOIN templates t ON t.name = k.name JOIN docs d ON d.r = p.r),
spans AS (SELECT r, name, need, last, greatest(before + 1, p - n + 1, 0) AS lo, least(p, last) AS hi FROM held),
steps AS (SELECT r, name, need, last, s, sum(d) AS d FROM (
    SELECT r, name, need, last, lo AS s, 1 AS d FROM spans WHERE lo <= hi UNION ALL
    SELECT r, name, need, last, hi + 1 AS s, -1 AS d FROM spans WHERE lo <= hi) GROUP BY ALL),
runs AS (SELECT r, name, need, s, sum(d) OVER (PARTITION BY r, name ORDER BY s) AS held,
    coalesce(lead(s) OVER (PARTITION BY r, name ORDER BY s), last + 1) - s AS width FROM steps),
matched AS (SELECT r, name, CAST(sum(width) AS BIGINT) AS blocks, max(held) AS best FROM runs WHERE held >= need AND width > 0 GROUP BY ALL),
exact AS (SELECT d.r, t.label, p.p FROM templates t JOIN places p ON p.w = t.ws[1] AND t.ordered JOIN docs d ON d.r = p.r
    WHERE list_slice(d.ws, CAST(p.p + 1 AS BIGINT), CAST(p.p + t.n AS BIGINT)) = t.ws),
base AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM exact GROUP BY r),
other AS (SELECT m.r, sum(m.blocks) AS n_blocks, max(CAST(m.best AS DOUBLE) / t.m) AS score FROM matched m JOIN templates t USING (name) WHERE NOT t.ordered GROUP BY m.r),
all_labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
    SELECT r, label FROM exact UNION SELECT m.r, t.label FROM matched m JOIN templates t USING (name) WHERE NOT t.ordered) GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base, CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
    coalesce(b.base_labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
    CASE WHEN b.r IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(o.score, 0.0::DOUBLE) END AS score, CAST(coalesce(o.n_blocks, 0) AS BIGINT) AS n_blocks
FROM docs d LEFT JOIN base b USING (r) LEFT JOIN other o USING (r) LEFT JOIN all_labels l USING (r)
"""
