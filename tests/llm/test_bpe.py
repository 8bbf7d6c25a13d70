import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assayer.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS, OURS = Tokenizer.from_file(PATH), bpe.Tokenizer(bpe.read_tokenizer(PATH))
ODD = [None, "", " ", "\n\n\t x", "a" * 20000, "aaaa bbb" * 50, "it's we'll I'D", "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endo", "naïve 日本語 😀 é", "1234567 3.14\r\n", "\u0000\u0001\x1c\x85 "]


def check(texts):
    for text, ids in zip(texts, bpe.encode_texts(OURS, texts), strict=True):
        want = THEIRS.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want
        assert OURS.decode(ids).decode() == THEIRS.decode(want, skip_special_tokens=False)


def test_odd_texts():
    check(ODD)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aab eth'sn 1\n"), st.characters(exclude_categories=["Cs"]))), max_size=6))
def test_like_the_library(texts):
    check(texts)


def test_malformed_bytes_decode_to_replacement():
    ids = OURS.of_byte[np.array([0xC3, 0x28, 0xE2, 0x82], np.uint8)]
    assert OURS.decode(ids).decode() == THEIRS.decode(ids.tolist(), skip_special_tokens=False)


def test_operator_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(ODD + ODD)], "doc_id long, text string, n_tokens int, source string")
    rows = bpe.digested(df, "text", PATH).collect()
    assert len(rows) == 2 * len(ODD) and rows[0].source == "x"
    for r in rows:
        want = THEIRS.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.digested(df.limit(0), "text", PATH).count() == 0
    assert [(r.ids, r.decoded) for r in bpe.encoded(df.filter("doc_id = 7"), "text", PATH).collect()] == [([50256], "<|endoftext|>")]


def test_chunks_cut_at_any_size(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 30, "c", ""]})
    got = [t.column("text").to_pylist() for t in bpe.chunks(iter([batch, batch]), "text", 25)]
    assert sum(got, []) == batch.column("text").to_pylist() * 2 and len(got) == 3


def test_a_large_tokenizer_file_is_refused(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_TOKENIZER_BYTES", 1000)
    with pytest.raises(ValueError):
        bpe.read_tokenizer(PATH)
