import base64
import hashlib

import numpy as np
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kinsieve.llm import bpe

C = bpe.Codec(*bpe.vocabulary())


def library():
    path, pattern = bpe.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


T = library()


def ids(text):
    return np.frombuffer(C.encode(text), "<u4").tolist()


def test_every_piece_as_a_text():
    for piece in C.bytes_of:
        text = piece.decode("utf-8", "replace")
        assert ids(text) == T.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sétheaAB019.,<|endoftext|>")), max_size=200))
def test_any_text(text):
    assert ids(text) == T.encode_ordinary(text)
    assert C.decode(C.encode(text)) == text.encode()


def test_rows(spark):
    long = "the thing, été! " * 5000
    rows = [(1, "x y", 0), (2, None, 0), (3, "", 0), (4, long, 0), (1, "x y", 0), (None, "z", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = sorted(bpe.encode_documents(docs, *bpe.vocabulary()).collect(), key=str)
    assert len(out) == 6
    for row in out:
        text = {1: "x y", 2: "", 3: "", 4: long, None: "z"}[row.doc_id]
        want = T.encode_ordinary(text)
        assert row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), *bpe.vocabulary()).count() == 0
    assert bpe.encode_documents(docs.where("doc_id = 2"), *bpe.vocabulary(), keep_ids=True).first().ids == []
