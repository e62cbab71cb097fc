"""Token alignment against a plain walk over the bytes of both sides."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veilmap.llm import alignment, bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b, bpe.byte_table(a.get_vocab(with_added_tokens=False), {})


def brute(texts, sides):
    a, b, a_bytes = sides
    docs, counts = [], Counter()
    for t in texts:
        t = t or ""
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        pieces = [b.id_to_piece(i) for i in ib]
        ba = [a_bytes[i] for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ib, pieces)]
        want = (" " + t).encode()
        if not t or b"".join(ba) != want or b"".join(bb) != want:
            docs.append(None)
            continue
        own_a = [i for i, x in enumerate(ba) for _ in x]
        own_b = [i for i, x in enumerate(bb) for _ in x]
        links = set(zip(own_a, own_b))
        ends_a = {i: n for n, i in enumerate(own_a, 1)}
        ends_b = {i: n for n, i in enumerate(own_b, 1)}
        cuts = sorted(set(ends_a.values()) & set(ends_b.values()))
        groups, last = [], 0
        for c in cuts:
            groups.append(",".join(str(ia[i]) for i in sorted({*own_a[last:c]})) + "|" + ",".join(str(ib[i]) for i in sorted({*own_b[last:c]})))
            last = c
        pairs = [(ia[i], ib[j]) for i, j in links]
        counts.update(pairs)
        docs.append((len(ia), len(ib), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((*d[:3], len(d[3]), sum(counts[p] == most[p[1]] for p in d[3]), sum(counts[p] for p in d[3]), d[4]))
    return out


ORDER = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_on_whole_texts(spark, sides):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute([r.text for r in rows], sides))}
    got = queries.op13_token_alignment(spark, SF)
    assert got.columns == ["doc_id", *ORDER]
    assert {r.doc_id: tuple(r[1:]) for r in got.collect()} == want


@pytest.mark.parametrize("chunk_bytes", [1, 700, alignment.CHUNK_BYTES])
def test_awkward_texts_in_chunks(spark, sides, awkward, chunk_bytes):
    rng = random.Random(5)
    odd = ["<|endoftext|> and <s> </s> <unk> <0x41>", "a" * 5000, "  two  blanks ", "\n\n\t tab", "ﬁ ligature Ⅷ ½", "🙂🙃 日本語 né", "▁ mark", " ", "\x00 nul", "".join(rng.choice("abc \n é日") for _ in range(3000))]
    rows = [(r[0], r[1], 4, 1) for r in awkward[1]] + [(9000 + i, t, 4, 1) for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, key int").repartition(3)
    got = alignment.align(docs, bpe.read_spec(), alignment.read_model(), chunk_bytes=chunk_bytes)
    assert got.columns == ["doc_id", "text", "key", *ORDER]
    want = [(r[0], r[1], 1, *w) for r, w in zip(rows, brute([r[1] for r in rows], sides))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_no_rows_and_no_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    args = bpe.read_spec(), alignment.read_model()
    got = alignment.align(docs, *args, keep=["doc_id"]).collect()
    assert sorted(got, key=repr) == sorted([(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")], key=repr)
    assert alignment.align(docs.limit(0), *args).count() == 0


def test_places_tell_documents_apart():
    # Two documents, bytes 0 to 6 and 8 to 12: the last token of the first one covers nothing of the second.
    start_a, end_a = np.array([0, 4, 8, 9]), np.array([4, 6, 9, 12])
    start_b, end_b = np.array([0, 1, 8]), np.array([1, 6, 12])
    at_a, at_b = alignment.overlaps(start_a, end_a, start_b, end_b)
    assert list(zip(at_a.tolist(), at_b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 2), (3, 2)]
