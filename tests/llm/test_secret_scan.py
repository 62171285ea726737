import hashlib
import random
import re
import string

import numpy as np

from kgloom.llm import secret_scan as S
from kgloom.llm.queries import QUERIES

PATTERNS = {
    "assign": re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LEAST = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}


def plain(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in p.finditer(text or "") if LEAST[k](m)]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def written(text):
    return [f"{k}:{a}:{b}" for a, k, b in sorted(S.base_spans(text or ""), key=lambda x: (x[0], S.KINDS.index(x[1])))]


def test_base_spans_against_the_patterns():
    rng = random.Random(5)
    parts = ["password", "PassWd", "token", "api_key", "APIKEY", "secret", "=", ": ", "'", '"', " ", "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "é", "\n", "x.y/z-", "ſecret", "toKen", "short"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert written(text) == plain(text), text
    assert written("token=token:abcdefghijkl") == plain("token=token:abcdefghijkl") == []


def test_battery_tells_random_from_ordered():
    rng = np.random.default_rng(6)
    alphabet = S.ENCODINGS["base62"]
    p = [S.battery("".join(alphabet[i] for i in rng.integers(62, size=40)), "base62") for _ in range(400)]
    assert 0.6 < np.mean(np.array(p) > 0.2) <= 1 and np.mean(np.array(p) < 0.01) < 0.06
    for ordered in ("a1" * 20, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "abcdefghijklmnopqrstuvwxyz0123456789"):
        assert S.battery(ordered, "base62") < 1e-3
    assert S.infer_encoding("0123abcd" * 3) == "hex" and S.infer_encoding("plainwordsonlyinletters") is None


def _hist(p):
    return np.bincount(np.minimum(S.BINS - 1, (np.asarray(p) * S.BINS).astype(int)), minlength=S.BINS).astype(float)


def _tail(p):
    return (1 + np.cumsum(_hist(p)[::-1])[::-1]) / (len(p) + 1)


def test_threshold_keeps_false_discoveries_within_bounds():
    rng = np.random.default_rng(7)
    law = lambda n: rng.beta(0.1, 8, n)  # noqa: E731  what ordinary tokens give
    ordinary, secret, tail = _hist(law(50_000)), _hist(rng.random(5_000)), _tail(law(50_000))
    cut = S.thresholds({("hex", 1): ordinary + secret}, {("hex", 1): tail}, 0.05)[("hex", 1)]
    assert ordinary[cut:].sum() / (ordinary + secret)[cut:].sum() < 0.08 and secret[cut:].sum() > 2_000
    assert sum(bool(S.thresholds({("hex", 0): _hist(law(1000))}, {("hex", 0): tail}, 0.05)) for _ in range(100)) <= 12
    one = S.thresholds({("hex", 0): _hist([0.8])}, {("hex", 0): tail}, 0.05)
    assert one and one["hex", 0] <= 0.8 * S.BINS  # a single token that few ordinary ones reach
    assert S.thresholds({}, {}, 0.05) == {}


def test_operator(spark):
    rng = random.Random(8)
    token = lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(36))
    texts = [None, "", "nothing here", "password: abcdefghijklmno", f"é AKIA{'A1B2' * 5} end", "x" * 200_000 + " token='0123456789abcdef'"] + [f"key {token()} end" for _ in range(60)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (None, texts[3], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets string")
    got = S.scan_secrets(df).collect()
    assert len(got) == len(rows)
    flagged = 0
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else texts[3]
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.secrets if s.kind != "random"] == plain(text)
        flagged += any(s.kind == "random" for s in r.secrets)
    assert flagged >= 54  # of 60 random ones
    assert S.scan_secrets(df.limit(0)).collect() == []


def test_query(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    for r in QUERIES["op1_secret_scan"](spark, sf).collect():
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        assert set(want) <= set(r.spans.split(",")) if want else True


def test_tokens_without_digits_and_of_rare_lengths():
    assert S.infer_encoding("kQzRtWvXbNmLpYsDfGhJ") == "base62" and S.infer_encoding("kQzRtWvX/NmLpYsDfGh+") == "base64"
    assert S.infer_encoding("some-long-kebab-case-words") is None and S.infer_encoding("ONLYCAPITALSINTHISWORD") is None
    tail = np.linspace(1, 0.001, S.BINS)
    common, alone = _hist(np.linspace(0, 0.999, 2000)), _hist([0.98])
    counts = {("base62", 1): common, ("base62", 6): alone, ("base32", 0): alone}
    cut = S.thresholds(counts, dict.fromkeys(counts, tail), 0.05)
    assert ("base62", 6) in cut and ("base32", 0) in cut  # each by its own law, none by another stratum's


def test_p_of_random_tokens_is_uniform():
    rng = np.random.default_rng(10)
    for encoding, n in (("hex", 32), ("base62", 21), ("base64", 24), ("base32", 500)):
        alphabet = S.ENCODINGS[encoding]
        p = np.array([S.battery("".join(alphabet[i] for i in rng.integers(len(alphabet), size=n)), encoding) for _ in range(1500)])
        assert all(abs((p > t).mean() - (1 - t)) < 0.05 for t in (0.1, 0.5, 0.9)), (encoding, n)


def _corpus(rng, random_tokens, ordinary_tokens):
    """Histograms of tokens drawn through the battery: random ones, and words with numbers, version strings and paths."""
    words = ["user", "final", "report", "config", "backup", "Image", "Version", "build", "index", "Data", "release", "Model", "thumb", "Session", "cache"]
    hists = {False: {}, True: {}}
    for k in range(random_tokens + ordinary_tokens):
        secret = k < random_tokens
        if secret:
            alphabet = S.ENCODINGS[("hex", "base62", "base64")[k % 3]]
            token = "".join(alphabet[i] for i in rng.integers(len(alphabet), size=(32, 40, 44)[k % 3]))
        else:
            token = "".join(f"{words[rng.integers(15)]}{('', '_', rng.integers(100), 2000 + rng.integers(30))[rng.integers(4)]}" for _ in range(rng.integers(4, 8)))
        encoding = S.infer_encoding(token)
        if encoding and len(token) >= 20:
            hist = hists[secret].setdefault((encoding, S.length_class(len(token))), np.zeros(S.BINS))
            hist[min(S.BINS - 1, int(S.battery(token, encoding) * S.BINS))] += 1
    return hists[True], hists[False]


def _english():
    return S.letter_pairs("the user wrote a final report on the configuration of this backup image and built an index of all released data for the session of the model in its cache version " * 20).astype(float)


def test_recall_and_false_share_over_corpora():
    """With no, one, few and many random tokens, among ordinary ones that the model doesn't know: how many are found, and the mean share of ordinary ones among those reported."""
    rng, pairs, tails = np.random.default_rng(11), _english(), {}
    for secrets, times in ((0, 60), (1, 60), (10, 20), (100, 6), (10_000, 1)):
        shares, recall = [], []
        for _ in range(times):
            yes, no = _corpus(rng, secrets, 300)
            counts = {k: yes.get(k, 0) + no.get(k, np.zeros(S.BINS)) for k in {*yes, *no}}
            for key in counts:
                if key not in tails:
                    tails[key] = S.ordinary_tail(*key, pairs)
            cut = S.thresholds(counts, tails, 0.05, S.ordinary_shares(pairs))
            true, false = (sum(h[cut[k] :].sum() for k, h in part.items() if k in cut) for part in (yes, no))
            shares.append(false / max(1, true + false))
            recall.append(true / max(1, secrets))
        assert np.mean(shares) <= 0.05, (secrets, np.mean(shares))
        assert np.mean(recall) >= {0: 0, 1: 0.7}.get(secrets, 0.9), (secrets, np.mean(recall))


def test_ordinary_tokens_have_the_form_asked_for():
    pairs = _english()
    for encoding in S.ENCODINGS:
        for style in S.STYLES:
            tokens = S.ordinary_tokens(encoding, 28, pairs, style, 50)
            assert all(len(t) == 28 and S.infer_encoding(t) == encoding for t in tokens), encoding
            assert tokens == S.ordinary_tokens(encoding, 28, pairs, style, 50) and (len(tokens) == 50 or style == "words")
    shares = S.ordinary_shares(pairs)
    assert shares["hex"] < 0.001 < min(shares["decimal"], shares["base62"]) and 0.99 < sum(shares.values()) < 1.01
    tail = S.ordinary_tail("hex", 2, pairs)
    assert (np.diff(tail) <= 0).all() and 0 < tail[-1] <= tail[0] <= 1


def test_nothing_random_is_not_reported(spark):
    """Words and identifiers alone, with one token of each that looks odd."""
    texts = ["userFinalReport2021configBackup", "release-2020-01-02-final_v2-index", "deadbeef0000000000000000cafe", "20240101120000000000000", "plain text and words only"] * 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert not [s for r in S.scan_secrets(df).collect() for s in r.secrets if s.kind == "random"]


def test_few_random_tokens_in_small_tables(spark, sf):
    """The 40-digit hex tokens of the table, which no other token is near, are reported."""
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want = {(i, m.start(), m.end()) for i, t in texts.items() for m in S.TOKEN.finditer(t or "") if S.infer_encoding(m[0]) == "hex"}
    got = {(r.doc_id, *map(int, x.split(":")[1:])) for r in QUERIES["op1_secret_scan"](spark, sf).collect() for x in r.spans.split(",") if x.startswith("random")}
    assert want and len(got & want) >= 0.9 * len(want)
