"""Tree concatenation against the library's own encoding of the whole text."""

import hashlib
import json
import random
import timeit

import numpy as np
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from veilmap.llm import bpe

SPEC = bpe.read_spec()
DIRECT = Tokenizer.from_str(SPEC)


def texts():
    rng = random.Random(5)
    words = ["the", "ouer", "été", "naïve", "日本語", "🙂🙂", "it's", "''s", "12345", "--", "<|endoftext|>", "I'll", "x" * 40, "\t", "\n\n", "   ", "ß", "a'b", "!!'re"]
    out = ["", " ", "a", "a" * 3000, "ab" * 2000, "é" * 1500, "🙂" * 700, " " * 900, "\n" * 700 + "x", "'" * 500 + "s" * 500, "<|endoftext|>" * 90, "0123456789" * 200]
    for _ in range(60):
        sep = rng.choice(["", " ", "  ", "\n"])
        out.append(sep.join(rng.choice(words) for _ in range(rng.randint(50, 900))))
    return out


@pytest.mark.parametrize("leaf", [24, 150, 1000])
def test_tree_concatenation_is_the_whole_encoding(leaf):
    codec = bpe.Codec(SPEC, leaf=leaf, reach=60)
    many = texts()
    for text, ids in zip(many, codec.encode_all(many), strict=True):
        want = DIRECT.encode(text, add_special_tokens=False).ids
        assert ids == want, text[:80]
        assert codec.decode(ids) == DIRECT.decode(want, skip_special_tokens=False) == text


def test_columns_nulls_and_clashing_names(spark):
    long = "ouer the naïve " * 4000
    rows = [Row(doc_id=1, text="hello world", ids="mine"), Row(doc_id=2, text=None, ids="x"), Row(doc_id=2, text="", ids=None), Row(doc_id=None, text=long, ids="y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_column(docs, SPEC, outputs=("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == 4 and set(got[0].asDict()) == {"doc_id", "text", "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"}
    for r in got:
        want = DIRECT.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == (r.text or "") and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert bpe.encode_column(docs.limit(0), SPEC).count() == 0


def test_faster_library_gives_the_same_ids():
    codec, rng = bpe.Codec(SPEC), random.Random(2)
    marks = [" ", "  ", "\n", " ", "　", "a", "É", "'s", "'LL", "7", "½", "_", "<|endoftext|>", "<|endoftext|", "endoftext|>", "🙂", "́", "‍", "\x00", "ſ", "İ"]
    many = ["".join(rng.choice(marks) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    many += [chr(c) + "a " + chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c % 7 == 0]
    many += [" " * 20_000, " " * 19_999 + "x", "\n \t" * 6000, "x" * 20_000, "!" * 20_000, "<|endoftext|>" * 1500]
    want = [e.ids for e in DIRECT.encode_batch(many, add_special_tokens=False)]
    assert codec.batch(many) == want
    text = "ouer the naïve and quite ordinary words of some 12 texts, once more. " * 3000
    clock = lambda f: min(timeit.repeat(f, number=1, repeat=3))
    assert clock(lambda: codec.encode_all([text])) < 0.6 * clock(lambda: DIRECT.encode(text, add_special_tokens=False))


def test_other_tokenizers_keep_their_library():
    held = json.loads(SPEC)
    for change in ({"lstrip": True}, {"rstrip": True}, {"single_word": True}):
        spec = json.dumps(held | {"added_tokens": [held["added_tokens"][0] | change]})
        direct = Tokenizer.from_str(spec)
        texts = ["a <|endoftext|> b", "a<|endoftext|>b", " <|endoftext|>"]
        codec = bpe.Codec(spec)
        assert codec.fast is None and codec.batch(texts) == [direct.encode(t, add_special_tokens=False).ids for t in texts]
    two = [held["added_tokens"][0], held["added_tokens"][0] | {"id": 50257, "content": "<|endoftext|>>"}]
    codec = bpe.Codec(json.dumps(held | {"added_tokens": two}))
    assert codec.fast is None and codec.batch(["<|endoftext|>>"]) == [[50257]]
