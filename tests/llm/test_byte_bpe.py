"""Byte-level BPE against the library that the contract names, and exact round trips."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logsentinel.llm import byte_bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATHS = [P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.tiktoken")]


@pytest.fixture(scope="module")
def coders():
    out = []
    for path in PATHS:
        v = byte_bpe.Vocabulary(byte_bpe.read_ranks(path))
        out.append((byte_bpe.Encoder(v, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ids, special_tokens={})))
    return out


def same(coders, text):
    for own, library in coders:
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text), text[:80]
        assert own.vocabulary.decode(packed) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("abetinorsx '", max_size=80) | st.text("éèßñ漢字ا😀\n\t ", max_size=60))
def test_any_text(coders, text):
    same(coders, text)


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_joined_tokens(coders, data):
    """Pieces made of whole tokens: the longest one is often wrong."""
    tokens = list(coders[0][0].vocabulary.ids)
    picked = data.draw(st.lists(st.integers(0, len(tokens) - 1), max_size=6))
    same(coders, b"".join(tokens[i] for i in picked).decode(errors="ignore"))


@pytest.mark.parametrize("text", ["", " ", "a" * 20_001, "ab" * 9_000, " " * 5_000 + "x", "\x00" * 300, "漢" * 4_000, "<|endoftext|>"])
def test_long_pieces(coders, text):
    same(coders, text)


def test_a_million_letters_in_one_piece(coders):
    own = coders[0][0]
    assert own.vocabulary.decode(own.encode("ab" * 500_000)) == b"ab" * 500_000


def test_tables(spark):
    rows = [(1, "Hello there, hello.", 5), (1, "Hello there, hello.", 6), (2, None, 7), (None, "", 8), (3, "naïve ‘quotes’ 漢字 " * 40_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = byte_bpe.encode(docs, PATHS[0], P.PATTERN)
    got = {(r.doc_id, len(r.ids)): bytes(r.ids) for r in encoded.collect()}
    assert len(got) == 4 and got[2, 0] == got[None, 0] == b""
    back = byte_bpe.decode(encoded, PATHS[0]).collect()
    assert sorted(bytes(r.bytes).decode() for r in back) == sorted(t or "" for _, t, _ in rows)
    both = byte_bpe.round_trip(docs, PATHS[0], P.PATTERN).collect()
    assert sorted(hashlib.sha256(r.ids).hexdigest() for r in both) == sorted(hashlib.sha256(r.ids).hexdigest() for r in encoded.collect())
    assert byte_bpe.round_trip(docs.limit(0), PATHS[0], P.PATTERN).count() == 0


def test_bad_vocabularies(tmp_path, monkeypatch):
    (tmp_path / "few").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="single bytes"):
        byte_bpe.Vocabulary(byte_bpe.read_ranks(str(tmp_path / "few")))
    monkeypatch.setattr(byte_bpe, "MOST_BYTES", 3)
    with pytest.raises(ValueError, match="larger"):
        byte_bpe.read_ranks(str(tmp_path / "few"))


def test_unknown_id():
    v = byte_bpe.Vocabulary(byte_bpe.read_ranks(PATHS[0]))
    with pytest.raises(ValueError, match="an id"):
        v.decode(np.array([10**9], "<u4").tobytes())


def test_query(spark):
    """The registered query on whole texts of the smallest tables against the library."""
    from logsentinel.llm.queries import queries
    from tests.llm.test_queries import SF

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.Vocabulary(byte_bpe.read_ranks(PATHS[0])).ids, special_tokens={})
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries()["op12_byte_bpe"](spark, SF).collect()
    assert len(got) == len(text)
    for r in got:
        ids = library.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
