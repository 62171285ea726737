import hashlib
import random

import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kgloom.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.Vocabulary.load(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", " ", "'", "'s", " 's", "''s", "it's's", "'sun", "we'll've", "'S", "a\n\n b", " \n", "\n a", "a  b ", "x" * 3000, " " * 500, "　a\xa0b\x85c\x1cd", "½ Ⅷ ١٢", "é ​!", "<|endoftext|>", "日本語 text 😀😀"]


@given(st.lists(st.text(alphabet="'strevldmSA1 \n\té½!😀　", max_size=30), max_size=8))
@settings(max_examples=300, deadline=None)
def test_pieces_are_the_patterns(texts):
    assert list(bpe.split_texts(texts)) == [regex.findall(P.PATTERN, t) for t in texts]


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_round_trips(text):
    v = bpe.Vocabulary(RANKS)
    ids = [i for p in next(bpe.split_texts([text])) for i in v.lookup(p)[0]]
    assert ids == LIBRARY.encode_ordinary(text) and v.decode(ids) == text.encode()


def test_blocks_of_any_size_agree():
    rng = random.Random(4)
    text = "".join(rng.choice("ab' \n1s") for _ in range(500))
    points = bpe.np.frombuffer(text.encode("utf-32-le"), bpe.np.uint32)
    want = bpe.boundaries(points, bpe.np.array([0]), 512).tolist()
    assert all(bpe.boundaries(points, bpe.np.array([0]), b).tolist() == want for b in (1, 2, 7, 64))


@pytest.mark.parametrize("chars", [1, 1_000_000])
def test_operator(spark, chars):
    rows = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(None, None, None, None), (3, ODD[3], "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids_sha256 int")
    out = bpe.encode_documents(df, PATH, ("n_tokens", "ids", "ends", "ids_sha256", "decoded_sha256"), chars=chars)
    assert out.columns == ["doc_id", "n_tokens", "ids", "ends", "ids_sha256", "decoded_sha256"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        text = ODD[r.doc_id] if r.doc_id is not None else ""
        ids = LIBRARY.encode_ordinary(text)
        assert (r.ids, r.n_tokens) == (ids, len(ids)) and (r.ends[-1] if ids else 0) == len(text.encode())
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode_documents(out, PATH)
    assert all(bytes(r.text).decode() == (ODD[r.doc_id] if r.doc_id is not None else "") for r in back.collect())


def test_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@given(st.lists(st.text(alphabet="abcdeéAB \n1'", max_size=40), max_size=12))
@settings(max_examples=200, deadline=None)
def test_blocks_of_texts_are_the_librarys(texts):
    ids, first = bpe.encode_texts(SMALL, texts)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [LIBRARY.encode_ordinary(t) for t in texts]


#: Its cache is full from the start, so it begins anew at each block.
SMALL = bpe.Vocabulary(RANKS, room=10)


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(bpe, "mix", lambda x: x & bpe.np.uint64(3))
    v, texts = bpe.Vocabulary(RANKS), ["some unusualish wordses", "zqxv zqxw some zqxv", "unusualish zqxw"]
    for _ in range(2):
        ids, first = bpe.encode_texts(v, texts)
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_classes_are_the_patterns():
    points = [*range(0, 0xD800, 7), *range(0xE000, 0x110000, 97)]
    named = [bpe.BLANK if regex.match(r"\s", c) else bpe.LETTER if regex.match(r"\p{L}", c) else bpe.NUMBER if regex.match(r"\p{N}", c) else bpe.OTHER for c in map(chr, points)]
    assert bpe.classes()[points].tolist() == named
