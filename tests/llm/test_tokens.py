import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tlake.llm import byte_bpe, queries, token_counts

RANKS = byte_bpe.load_ranks(queries.BYTE_RANKS)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_rank_file():
    first = open(queries.BYTE_RANKS, "rb").readline().split()
    assert RANKS[base64.b64decode(first[0])] == int(first[1])


def test_merge_equals_library(tik):
    draw = random.Random(3)
    for _ in range(300):
        piece = "".join(draw.choice("aebthiné ") for _ in range(draw.randint(1, 120)))
        assert byte_bpe.merge(piece.encode(), RANKS) == tik._encode_single_piece(piece)


def test_stitching(tik, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 37)
    monkeypatch.setattr(byte_bpe, "OVERLAP", 11)
    encoder, draw = byte_bpe.Encoder(RANKS, P.PATTERN), random.Random(5)
    texts = ["".join(draw.choice("a b'lsre  \n\t7 é.!") for _ in range(draw.randint(0, 400))) for _ in range(1500)]
    for text in [*texts, "a" * 900, " " * 300, "a" * 500 + " x"]:
        chunks = [dict(zip(("ids", "at", "first"), encoder.encode_chunk(c)), text=c) for c in byte_bpe.cut(text)]
        assert list(byte_bpe.stitch(chunks, encoder)) == tik.encode_ordinary(text)


def test_op9_on_odd_rows(spark, odd_docs, tik):
    given = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    got = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(odd_docs, queries.BYTE_RANKS), queries.BYTE_RANKS)).collect()
    want = []
    for doc_id, text in given:
        ids = tik.encode_ordinary(text)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((doc_id, len(ids), digest, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert byte_bpe.encode(odd_docs.limit(0), queries.BYTE_RANKS).count() == 0


def test_op9_query(spark, rows, tik):
    want = {i: len(tik.encode_ordinary(t or "")) for i, t in rows("documents", "doc_id, text")}
    got = queries.op9_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_tokens for r in got} == want


def library_counts(texts):
    t = Tokenizer.from_file(queries.WORD_TOKENIZER)
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_op5_on_odd_rows(spark, odd_docs):
    given = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    got = token_counts.count_tokens(odd_docs, queries.WORD_TOKENIZER).collect()
    want = [(i, len(t.encode()), n) for (i, t), n in zip(given, library_counts([t for _, t in given]))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.count_tokens(odd_docs.limit(0), queries.WORD_TOKENIZER).count() == 0


def test_op5_rare_pre_tokens_are_joined(spark, rows, monkeypatch):
    monkeypatch.setattr(token_counts, "HOT_SHARE", 500)  # most pre-tokens take the shuffled way
    given = rows("documents", "doc_id, text")
    got = queries.op5_token_counts(spark, "/root/testdata/sf0.001").collect()
    want = dict(zip([i for i, _ in given], library_counts([t or "" for _, t in given])))
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("x", "a b"), (None, "c")], "doc_id string, text string")
    assert byte_bpe.encode(docs, queries.BYTE_RANKS).filter(F.col("doc_id") == "x").first().ids == RANKS_OF_AB()
    assert token_counts.count_tokens(docs, queries.WORD_TOKENIZER).count() == 2


def RANKS_OF_AB():
    return [RANKS[b"a"], RANKS[b" b"]]
