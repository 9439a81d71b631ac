import hashlib
import random

import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from barwise.llm.bpe import Encoder, Vocabulary, encode_decode, op8_bpe
from conftest import SF_SMALL
from llm_helpers import docs_of

PATH = public.path("byte_bpe_50k.json")
WANT = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary(PATH, public.PATTERN))


def ids(text):
    return WANT.encode(text, add_special_tokens=False).ids


def test_every_low_code_point(encoder):
    for lo in range(0, 0x11000, 64):
        text = "".join(f"a{chr(c)}{chr(c)}b 1{chr(c)} " for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000)
        assert encoder.encode(text).tolist() == ids(text), hex(lo)


def test_random_and_long_words(encoder):
    rng = random.Random(5)
    for n in [0, 1, 2, 3, 10, 255, 256, 257, 300, 3000]:
        for alphabet in ["a", "ab", "the", "aeinrst", "é€x", " \n\t", "'s'll x", "0123"]:
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert encoder.encode(text).tolist() == ids(text)
    assert len(encoder.encode("x" * 200_000)) == len(ids("x" * 200_000))


def test_special_token(encoder):
    for text in ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>\n", "<|endoftext", "x <|endoftext|>"]:
        assert encoder.encode(text).tolist() == ids(text)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (2, " \n\n x"), (None, "<|endoftext|>é"), (3, "word " * 30000), (3, "word " * 30000)]
    got = encode_decode(docs_of(spark, [(i, t, 5, "d") for i, t in rows], "doc_id long, text string, ids int, decoded string")).collect()
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=str) == sorted(
        ((i, ids(t or ""), t or "") for i, t in rows), key=str)
    assert encode_decode(docs_of(spark, [])).count() == 0


def test_query_matches_library(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in op8_bpe(spark, SF_SMALL).collect()}
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        want = ids(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (
            len(want), sha(",".join(map(str, want))), sha(WANT.decode(want, skip_special_tokens=False)))
