import random

from kgloom.functions.search import Finder


def test_against_plain_containment():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab é") for _ in range(rng.randrange(4)))
    for _ in range(200):
        sets = [[None if rng.random() < 0.03 else word() for _ in range(rng.randrange(4))] for _ in range(12)]
        text = "".join(rng.choice("ab é") for _ in range(rng.randrange(20)))
        want = [i for i, s in enumerate(sets) if None not in s and all(k in text for k in s)]
        assert Finder(sets).find(text) == want
    assert Finder([["a"]]).find(None) == [] and Finder([]).find("a") == []
