import random

import pytest
from tokenizers import Tokenizer

from kgloom.llm import token_transducer
from kgloom.llm.queries import QUERIES, vocabulary_path

PATH = vocabulary_path("byte_bpe_50k.json")
ALPHABETS = ["ab", "aab ", "0123456789abcdef", "aA1 \n'strevml", "éßü漢字かな 😀 \xa0 a", "-=_*. ", "\x00\x1c\x85​ a", "<|endoftext|> "]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def machine():
    return token_transducer.Machine.load(PATH)


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_random_texts(machine, library, alphabet):
    rnd = random.Random(alphabet)
    texts = ["".join(rnd.choices(alphabet, k=rnd.choice([0, 1, 3, 20, 200, 900]))) for _ in range(200)]
    assert token_transducer.Transducer(machine).counts(texts).tolist() == library(texts)


def test_long_pieces_special_strings_and_small_tables(machine, library):
    texts = ["a" * 30000, " " * 3001 + "x", "ab" * 9000, "-" * 700 + "=" * 77, "x<|endoftext|>y  <|endoftext|>", "<|endoftext|><|endoftext|> ", "<|endoftext|", "I'll don't I'LL", "é" * 4000]
    want = library(texts)
    small = token_transducer.Transducer(machine, room=10)
    for _ in range(2):  # the second time from a table that starts again
        assert small.counts(texts).tolist() == want
    assert [int(small.counts([t])[0]) for t in texts] == want


def test_maps_meet_whatever_the_chunk(machine):
    import numpy as np

    data = np.frombuffer(("internationalisation " * 30 + "zzzz" * 200).encode(), np.uint8)
    opens = np.zeros(len(data), bool)
    opens[[0, 20, 41, 300]] = True
    transducer = token_transducer.Transducer(machine)
    whole = transducer.emitted(data, opens, chunk=len(data))
    for chunk in (1, 2, 7, 64):
        assert (transducer.emitted(data, opens, chunk) == whole).all()


def test_small_vocabulary_with_a_token_that_never_comes_out():
    letters = token_transducer.byte_letters()
    merges = [("a", "b"), ("b", "c"), ("a", "bc"), ("ab", "ab")]  # abc encodes to ab c, since ab is merged first
    machine = token_transducer.Machine.of(letters | {a + b: 256 + i for i, (a, b) in enumerate(merges)}, merges)
    texts = ["abc", "abab", "ababab", "bcabc", "aabbcc", "cab"]

    def plain(text):
        parts = list(text)
        while True:
            found = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
            if not found:
                return len(parts)
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    assert token_transducer.Transducer(machine).counts(texts).tolist() == [plain(t) for t in texts]


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        token_transducer.Machine.load(vocabulary_path("word_bpe_49k.json"))


def test_operator(spark, library):
    rows = [(1, None, 5, "r"), (2, "", None, "r"), (3, "twice é", 1, None), (3, "twice é", 1, None), (None, "word " * 600, 2, "x"), (4, "long" * 100_000, 3, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, _row string")
    out = token_transducer.count_tokens(df, PATH)
    assert out.columns == ["doc_id", "_row", "n_bytes", "n_tokens", "over_limit"]
    counts = library([r[1] for r in rows])
    want = [(r[0], r[3], len((r[1] or "").encode()), n, n > 512) for r, n in zip(rows, counts)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert token_transducer.count_tokens(df.limit(0), PATH).collect() == []


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.n_tokens for r in QUERIES["op11_token_counts"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == dict(zip([d.doc_id for d in docs], library([d.text for d in docs])))
