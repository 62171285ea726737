"""Language-model scoring: Pitman-Yor restaurants of words after a word, over one of words, over restaurants of bytes that spell them, seated by Gibbs sampling, its predictive probabilities averaged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import discard, release, stored, stored_by
from kgloom.llm.hashing import lower, word_hashes
from kgloom.llm.pitman_yor import code_counts, discount_of, sample_spelling, seat, word_codes

#: The token that ends a text, and that its first word follows: no word holds a blank. Its hash is as arbitrary as a word's.
STOP, STOP_HASH = b" ", np.uint64(0x5BD1E995C2B2AE35)


def _table(**columns: str) -> tuple[str, pa.Schema]:
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    return ", ".join(f"{k} {v}" for k, v in columns.items()), pa.schema([(k, types[v]) for k, v in columns.items()])


#: A block of texts numbers its distinct words by hash; a shard owns a range of hashes and numbers its learnt words likewise, from 0.
#: DOC: a text as numbers of the block. ASK: words of the block that a shard owns, with their counts in learnt texts.
DOC, ASK = 0, 1
ROWS, _ROWS = _table(kind="int", block="long", shard="int", id="long", held_out="boolean", places="binary", words="binary", counts="binary")
#: WORD: a shard's learnt words, with counts, customers and tables. RANK: for a block's ask the words' numbers, 1 more, or 0 where not learnt, and the spellings of these.
WORD, RANK = 0, 1
#: REPLY: to a shard of pairs, probabilities of words that it called for.
REPLY = 2
_BLOBS, _SUMS = ("words", "ranks", "n", "c", "t", "samples"), ("total", "kinds", "once", "twice", "customers", "tables")
WORDS, _WORDS = _table(kind="int", shard="int", block="long", **dict.fromkeys(_BLOBS, "binary"), **dict.fromkeys(_SUMS, "long"), spelt="double")
#: What a block asks about pairs whose first word a shard owns: which of its words are learnt, the others' spellings, the learnt ones' numbers, how many words follow each, these (shard << 32 | number) and their counts in learnt texts.
ASKED, _ASKED = _table(block="long", shard="int", learnt="binary", words="binary", ranks="binary", runs="binary", follow="binary", counts="binary")
#: PAIR: for each learnt word of a shard, how many words follow it, which of met these are, and their customers and tables. PLACE: for each block the places of its pairs among them.
PAIR, PLACE = 0, 1
PAIRS, _PAIRS = _table(kind="int", shard="int", block="long", learnt="binary", words="binary", ranks="binary", runs="binary", places="binary", met="binary", follow="binary", c="binary", t="binary", samples="binary", seats="binary", **dict.fromkeys(_SUMS, "long"))
CALLS, _CALLS = _table(shard="int", source="int", ranks="binary", t="binary")
ANSWERS, _ANSWERS = _table(block="long", shard="int", learnt="binary", n="binary", p="binary", new="binary", whole="binary", seats="binary", c="binary", t="binary")
SCORES, _SCORES = _table(id="long", held_out="boolean", n_tokens="long", n_known="long", train_tokens="long", base_score="double", score="double", open_score="double")


def planes(x: np.ndarray) -> bytes:
    """Whole numbers as byte planes, as many as the greatest needs, which the first byte tells."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplaned(blob: bytes) -> np.ndarray:
    width = blob[0]
    out = np.zeros(((len(blob) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<i8").ravel()


def steps(x: np.ndarray) -> bytes:
    """Rising numbers, as their differences."""
    return planes(np.diff(x, prepend=0))


def unstepped(blob: bytes) -> np.ndarray:
    return np.cumsum(unplaned(blob))


def floats(x: np.ndarray) -> bytes:
    """Byte planes of 4-byte floats."""
    return np.ascontiguousarray(x, "<f4").ravel().view(np.uint8).reshape(-1, 4).T.tobytes()


def unfloated(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<f4").ravel()


def parts(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each run of equal numbers."""
    cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)] if len(x) else [0]
    return [(int(x[a]), a, b) for a, b in zip(cuts, cuts[1:])]


def _tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """The block's distinct words and the end, by hash, their hashes, and each text's words as numbers, the end the last."""
    joined = lower(b" ".join(texts))
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    hashes, start, end = word_hashes(joined)
    known, first, place = np.unique(np.append(hashes, STOP_HASH), return_index=True, return_inverse=True)
    words = [joined[start[i] : end[i]] if i < len(start) else STOP for i in first.tolist()]
    cuts = np.searchsorted(start, at)
    return words, known, [np.append(place[a:b], place[-1]) for a, b in zip(cuts, cuts[1:])]


def _neighbours(places: list[np.ndarray], size: int) -> np.ndarray:
    """All texts' pairs of neighbours, first * size + second; a text's first word follows an end."""
    line = np.concatenate(places).astype(np.int64)
    first = np.empty_like(line)
    first[0], first[1:] = line[-1], line[:-1]
    return first * size + line


def _blocks(chars: int, shards: int):
    """mapInArrow function: a block's documents as numbers of its words, and these, by shard, with their counts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                part, hi, total = [], lo, 0
                while hi < batch.num_rows and (not part or total < chars):
                    part.append((batch.column(2)[hi].as_py() or "").encode("utf-8", "surrogatepass"))
                    total += len(part[-1])
                    hi += 1
                block += 1
                words, hashes, places = _tokens(part)
                held = batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                counts = np.bincount(np.concatenate([np.zeros(0, np.int64), *(p for p, h in zip(places, held) if not h)]), minlength=len(words))
                ids = batch.column(0)
                rows = [{"kind": DOC, "block": block, "id": ids[lo + k].as_py(), "held_out": bool(h), "places": planes(p)} for k, (p, h) in enumerate(zip(places, held))]
                shard = ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
                rows += [{"kind": ASK, "block": block, "shard": k, "words": b"\n".join(words[a:b]), "counts": planes(counts[a:b])} for k, a, b in parts(shard)]
                yield pa.RecordBatch.from_pylist(rows, _ROWS)
                lo = hi
        release()

    return emit


def _row(kind: int, shard: int, c: np.ndarray, t: np.ndarray, samples: bytes, total: int, **others) -> dict:
    """A shard's state, with the sums that the next sweep needs; a dish without customers isn't one."""
    return {"kind": kind, "shard": shard, "c": planes(c), "t": planes(t), "samples": samples, **others, "total": total, "kinds": int((c > 0).sum()), "once": int((c == 1).sum()), "twice": int((c == 2).sum()), "customers": int(c.sum()), "tables": int(t.sum())}


def _hashed(words: list[bytes]) -> np.ndarray:
    out = np.full(len(words), STOP_HASH)
    plain = np.array([w != STOP for w in words], bool)
    if plain.any():
        out[plain] = word_hashes(b"\n".join(w for w in words if w != STOP))[0]
    return out


def _count(table: pa.Table) -> pa.Table:
    """The learnt words of a shard, and for each block their numbers."""
    asks = [(r["block"], r["words"].split(b"\n"), unplaned(r["counts"])) for r in table.select(["block", "words", "counts"]).to_pylist()]
    shard = table.column("shard")[0].as_py()
    names = [w for _, words, _ in asks for w in words]
    hashes = np.concatenate([_hashed(words) for _, words, _ in asks])
    _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    n = np.bincount(place, np.concatenate([c for *_, c in asks])).astype(np.int64)
    learnt = n > 0
    number = np.where(learnt, np.cumsum(learnt), 0)[place]
    one = np.ones(int(learnt.sum()), np.int64)
    rows = [_row(WORD, shard, one, one, b"", int(n.sum()), words=b"\n".join([names[i] for i in first[learnt]]), n=planes(n[learnt]))] if learnt.any() else []
    at = 0
    for block, words, _ in asks:
        own = number[at : at + len(words)]
        rows.append({"kind": RANK, "shard": shard, "block": block, "ranks": planes(own), "words": b"\n".join([w for w, k in zip(words, own) if not k])})
        at += len(words)
    return pa.Table.from_pylist(rows, _WORDS)


def _by_shard(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: r["shard"])


def _learnt_pairs(texts: list[np.ndarray], learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(every token's pair, the distinct pairs of learnt words, each token's place among them, or their number)."""
    every = _neighbours(texts, len(learnt))
    pairs, place = np.unique(every, return_inverse=True)
    known = learnt[pairs // len(learnt)] & learnt[pairs % len(learnt)]
    return every, pairs[known], np.where(known, np.cumsum(known) - 1, int(known.sum()))[place]


def _ask_pairs(docs: pa.Table, ranks: pa.Table) -> pa.Table:
    """Cogrouped function: a block's documents, and its words' numbers; its pairs of learnt words, by the first one's shard."""
    own, docs = _by_shard(ranks), docs.select(["held_out", "places"]).to_pylist()
    numbers = [unplaned(r["ranks"]) for r in own]
    shard, number = np.repeat([r["shard"] for r in own], list(map(len, numbers))), np.concatenate(numbers)
    texts = [unplaned(d["places"]) for d in docs]
    _, pairs, place = _learnt_pairs(texts, number > 0)
    taught = np.repeat([not d["held_out"] for d in docs], list(map(len, texts)))
    counts = np.bincount(place, taught, len(pairs) + 1).astype(np.int64)
    first, second = pairs // len(number), pairs % len(number)
    follow = shard[second] << 32 | number[second] - 1
    runs = np.bincount(first, minlength=len(number))
    cuts, at, rows = np.append(0, np.cumsum(runs)), 0, []
    for r, numbered in zip(own, numbers):
        end, learnt = at + len(numbered), numbered > 0
        lo, hi = cuts[at], cuts[end]
        rows.append({"block": r["block"], "shard": r["shard"], "learnt": planes(learnt), "words": r["words"], "ranks": steps(numbered[learnt] - 1), "runs": planes(runs[at:end][learnt]), "follow": planes(follow[lo:hi]), "counts": planes(counts[lo:hi])})
        at = end
    return pa.Table.from_pylist(rows, _ASKED)


def _gather(table: pa.Table) -> pa.Table:
    """The pairs whose first word a shard owns, and for each block the places of its own."""
    asks = table.to_pylist()
    shard = asks[0]["shard"]
    ranks, runs, follow = ([f(r[k]) for r in asks] for f, k in ((unstepped, "ranks"), (unplaned, "runs"), (unplaned, "follow")))
    met, which = np.unique(np.concatenate(follow), return_inverse=True)
    context = np.concatenate([np.repeat(a, n) for a, n in zip(ranks, runs)])
    keys, place = np.unique(context * max(1, len(met)) + which, return_inverse=True)
    c = np.bincount(place, np.concatenate([unplaned(r["counts"]) for r in asks]), len(keys)).astype(np.int64)
    words = max((int(a[-1]) + 1 for a in ranks if len(a)), default=0)
    own = np.bincount(keys // max(1, len(met)), minlength=words)
    rows = [_row(PAIR, shard, c, (c > 0).astype(np.int64), planes(np.zeros(len(c))), int(c.sum()), runs=planes(own), met=steps(met), follow=planes(keys % max(1, len(met))), seats=planes(np.zeros(0)))]
    at = 0
    for r, f in zip(asks, follow):
        rows.append({"kind": PLACE, "shard": shard, "block": r["block"], "learnt": r["learnt"], "words": r["words"], "ranks": r["ranks"], "places": steps(place[at : at + len(f)])})
        at += len(f)
    return pa.Table.from_pylist(rows, _PAIRS)


def _spelled(words: bytes) -> list[bytes]:
    return [b"" if w == STOP else w for w in words.split(b"\n")]


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of three-byte codes in the spellings of all tables, summed within the task."""
    codes, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for words, t in zip(batch.column(0), batch.column(1)):
            own, starts = word_codes(_spelled(words.as_py()))
            own, n = code_counts(own, np.repeat(unplaned(t.as_py()), np.diff(np.append(starts, len(own)))))
            codes, place = np.unique(np.concatenate([codes, own]), return_inverse=True)
            sums = np.bincount(place, np.concatenate([sums, n])).astype(np.int64)
    if len(codes):
        yield pa.RecordBatch.from_pydict({"code": pa.array(codes, pa.int64()), "n": pa.array(sums, pa.int64())})


def _call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables that a shard of pairs has of each word, to the shards of the words."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            met = unstepped(r["met"])
            t = np.bincount(unplaned(r["follow"]), unplaned(r["t"]), len(met)).astype(np.int64)
            rows += [{"shard": k, "source": r["shard"], "ranks": steps(met[a:b] & 0xFFFFFFFF), "t": planes(t[a:b])} for k, a, b in parts(met >> 32)]
        yield pa.RecordBatch.from_pylist(rows, _CALLS)
    release()


def _seat_words(shared, discount: float, concentration: float, tables: int, customers: int, counted: bool, seed: int):
    """Cogrouped function: the tables that words have in all contexts are seated anew in the restaurant of words, and who called is told their probabilities.

    tables: of the whole restaurant, as the last sweep left it; shards sweep side by side, so each sees the others' as
    they were then.
    """

    def sweep(calls: pa.Table, words: pa.Table) -> pa.Table:
        rows, calls = [], calls.to_pylist()
        for r in words.to_pylist():
            old = unplaned(r["t"])
            at, c = [unstepped(x["ranks"]) for x in calls], np.zeros(len(old), np.int64)
            for k, x in zip(at, calls):
                c[k] += unplaned(x["t"])
            codes, starts = word_codes(_spelled(r["words"]))
            spelt = 10.0 ** np.add.reduceat(shared.value.log10(codes), starts, dtype=float)
            t = seat(c, discount, (concentration + discount * np.maximum(0, tables - old)) * spelt, np.random.default_rng([seed, r["shard"]]), discount * spelt)
            rest = c - discount * t
            samples = r["samples"] + (floats(rest) + floats(spelt) if counted else b"")
            rows.append(_row(WORD, r["shard"], c, t, samples, r["total"], words=r["words"], n=r["n"], spelt=float(spelt.sum())))
            p = (rest + (concentration + discount * tables) * spelt) / (concentration + customers)
            rows += [{"kind": REPLY, "shard": x["source"], "block": r["shard"], "c": floats(p[k])} for k, x in zip(at, calls)]
        return pa.Table.from_pylist(rows, _WORDS)

    return sweep


def _seat_pairs(discount: float, concentration: float, counted: bool, seed: int):
    """Cogrouped function: in each context its words' customers are seated anew below the restaurant of words."""

    def sweep(pairs: pa.Table, replies: pa.Table) -> pa.Table:
        rows, told = [], sorted(replies.select(["block", "c"]).to_pylist(), key=lambda x: x["block"])
        p = np.concatenate([np.zeros(0, np.float32), *(unfloated(x["c"]) for x in told)])
        for r in pairs.to_pylist():
            place, runs, c, old = unplaned(r["follow"]), unplaned(r["runs"]), unplaned(r["c"]), unplaned(r["t"])
            context, parent = np.repeat(np.arange(len(runs)), runs), p[place].astype(float)
            whole = np.bincount(context, old, len(runs))
            t = seat(c, discount, (concentration + discount * (whole[context] - old)) * parent, np.random.default_rng([seed, r["shard"], 1]), discount * parent)
            samples, seats = (planes(unplaned(r["samples"]) + old), planes(np.append(unplaned(r["seats"]), whole))) if counted else (r["samples"], r["seats"])
            rows.append(_row(PAIR, r["shard"], c, t, samples, r["total"], runs=r["runs"], met=r["met"], follow=r["follow"], seats=seats))
        return pa.Table.from_pylist(rows, _PAIRS)

    return sweep


def _answer(spellings: list, levels: list[tuple[float, float, float]]):
    """Cogrouped function: to each block that asked a shard, what its words and their contexts and pairs are worth.

    levels: for each sample the mass that the restaurant of words gives to spelling, its customers with the
    concentration, and the share of spellings that no learnt word has. Of a learnt word each sample has log10 p, of
    another that of its spelling (new); of a context the customers (whole) and each sample's tables (seats); of a pair
    the customers and the tables of all samples.
    """

    def answer(pairs: pa.Table, words: pa.Table) -> pa.Table:
        size, n, logs = len(levels), np.zeros(0, np.int64), np.zeros((len(levels), 0))
        whole, seats, c, t = np.zeros(0, np.int64), np.zeros((size, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r in words.to_pylist():
            n = unplaned(r["n"])
            blobs = [unfloated(r["samples"][i : i + 4 * len(n)]).astype(float) for i in range(0, len(r["samples"]), 4 * len(n))]
            logs = np.log10(np.stack([(rest + mass * s) / customers for rest, s, (mass, customers, _) in zip(blobs[::2], blobs[1::2], levels)]))
        kinds = np.asarray(pairs.column("kind"))
        for r in pairs.filter(pa.array(kinds == PAIR)).to_pylist():
            runs, c, t = unplaned(r["runs"]), unplaned(r["c"]), unplaned(r["samples"])
            whole = np.bincount(np.repeat(np.arange(len(runs)), runs), c, len(runs)).astype(np.int64)
            seats = unplaned(r["seats"]).reshape(size, -1)
        rows = []
        for x in pairs.filter(pa.array(kinds == PLACE)).to_pylist():
            at, place = unstepped(x["ranks"]), unstepped(x["places"])
            new = _spelled(x["words"]) if x["words"] or not unplaned(x["learnt"]).all() else []
            codes, starts = word_codes(new) if new else (None, None)
            spelt = np.array([np.log10(mass / customers) + np.add.reduceat(s.value.log10(codes), starts, dtype=float) for s, (mass, customers, _) in zip(spellings, levels)] if new else [])
            rows.append({"block": x["block"], "shard": x["shard"], "learnt": x["learnt"], "n": planes(n[at]), "p": floats(logs[:, at]), "new": floats(spelt), "whole": planes(whole[at]), "seats": planes(seats[:, at].ravel()), "c": planes(c[place]), "t": planes(t[place])})
        return pa.Table.from_pylist(rows, _ANSWERS)

    return answer


def _score_block(n: int, v: int, levels: list[tuple[float, float, float]], discount: float, concentration: float):
    """Cogrouped function: documents of a block, and what became of its words and pairs."""
    size = len(levels)

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        told, docs = _by_shard(answers), docs.select(["id", "held_out", "places"]).to_pylist()
        learnt = np.concatenate([unplaned(a["learnt"]) for a in told]) > 0

        def spread(key: str, read, where: np.ndarray, out: np.ndarray) -> np.ndarray:
            out[:, where] = np.concatenate([read(a[key]).reshape(len(out), -1) for a in told], axis=1)
            return out

        c = spread("n", unplaned, learnt, np.zeros((1, len(learnt)), np.int64))[0]
        others = np.array([[np.log10(mass / customers * rest)] for mass, customers, rest in levels])
        p = spread("p", unfloated, learnt, np.repeat(others, len(learnt), axis=1))
        spelt = spread("new", unfloated, ~learnt, p.copy())
        whole = spread("whole", unplaned, learnt, np.zeros((1, len(learnt))))[0]
        share = np.log10((concentration + discount * spread("seats", unplaned, learnt, np.zeros((size, len(learnt))))) / (concentration + whole))
        texts = [unplaned(d["places"]) for d in docs]
        every, pairs, place = _learnt_pairs(texts, learnt)
        many, seats = (np.concatenate([unplaned(a[k]) for a in told]) for k in ("c", "t"))
        own = np.append((many - discount * seats / size) / (concentration + whole[pairs // len(learnt)]), 0.0)[place]
        first, second = every // len(learnt), every % len(learnt)

        def mixed(p: np.ndarray) -> np.ndarray:
            back = share[:, first] + p[:, second]
            top = back.max(0)
            back = top + np.log10((10.0 ** (back - top)).mean(0))
            return np.where(own > 0, np.log10(own + 10.0**back), back)

        lens = np.array(list(map(len, texts)))
        starts = np.cumsum(lens) - lens
        base = np.log10((c + 1) / (n + 1 * (v + 1)))[second]
        sums = [np.add.reduceat(x, starts) for x in ((c[second] > 0).astype(np.int64), base, mixed(p), mixed(spelt))]
        return pa.Table.from_pydict({"id": [d["id"] for d in docs], "held_out": [d["held_out"] for d in docs], "n_tokens": lens, "n_known": sums[0], "train_tokens": np.full(len(docs), n), "base_score": sums[1], "score": sums[2], "open_score": sums[3]}, _SCORES)

    return score


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", burn_in: int = 1, samples: int = 2, concentration: float = 10.0, context_concentration: float = 1.0, block_chars: int = 8_000_000, shard_bytes: int = 8 << 20) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity, open_score for each row of docs.

    Learns from the rows whose held_out is false. Tokens are runs of characters other than ASCII blanks, with A-Z
    lower-cased, and one end for each text. score is the log10 probability of a text's tokens: the mean, over samples
    seatings after burn_in sweeps, of predictive probabilities. A word follows the word before it (the first one an
    end) in that word's restaurant; the parent of all these is the restaurant of words, whose customers are their
    tables; its parent spells a word by bytes in shared contexts. In score words that were not learnt are one token, as
    in the base, of what the parent gives to all of them; in open_score each has the probability of its own spelling.
    perplexity is 10 ** (-score / n_tokens). base_score adds one to the counts: log10((c + 1) / (N + 1 * (V + 1))).

    Null and empty texts are one end token; a null held_out counts as false; repeated rows are scored, and learnt
    from, as often as they are there; an empty table gives an empty result; other columns are ignored. Ids that are not
    numbers are null.

    A block of texts numbers its distinct words; shards, as many as the corpus asks for, own ranges of hashes, count
    the words and tell each block their numbers. With these a block counts its pairs before they are shuffled, so each
    costs at most an entry a block however often it occurs; the shard of a pair's first word sums them and remembers
    where each block's are. In a sweep shards tell each other tables and probabilities of the words that they share.
    At last each block gets back what its words and pairs are worth. Only sums of byte contexts, at most 2**24 whatever
    the corpus, reach the driver, and the spelling model they give is as bounded.
    """
    spark = docs.sparkSession
    slim = docs.select(F.expr(f"try_cast(`{id_col}` as long)").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    shards = max(8, -(-(slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    rows = stored_by(slim.mapInArrow(_blocks(block_chars, shards), ROWS), "kind", (DOC, ASK), "lm-blocks", "zstd")
    texts = rows[DOC].select("block", "id", "held_out", "places")
    counted = stored_by(rows[ASK].select("shard", "block", "words", "counts").groupBy("shard").applyInArrow(_count, WORDS), "kind", (WORD, RANK), "lm-words", "zstd")
    discard(rows[ASK])
    ranks = counted[RANK].select("block", "shard", "ranks", "words")
    asked = stored(texts.groupBy("block").cogroup(ranks.groupBy("block")).applyInArrow(_ask_pairs, ASKED), "lm-asked", "zstd")
    discard(counted[RANK])
    gathered = stored_by(asked.groupBy("shard").applyInArrow(_gather, PAIRS), "kind", (PAIR, PLACE), "lm-pairs", "zstd")
    discard(asked)
    words, pairs = counted[WORD], gathered[PAIR]
    sums = lambda state, *more: state.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in (*_SUMS, *more)]).first()
    one, two = sums(words), sums(pairs)
    n, v, tables = one.total, one.kinds, one.tables
    below = discount_of(np.array([1, 2]), np.array([two.once, two.twice], float))
    discount, spellings, levels = below, [], []
    for k in range(burn_in + samples):
        letters = words.select("words", "t").mapInArrow(_letters, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
        spelling = spark.sparkContext.broadcast(sample_spelling(letters.code.to_numpy(np.int64), letters.n.to_numpy(np.int64), seed=k + 1))
        keep = k >= burn_in
        calls = pairs.select("shard", "met", "follow", "t").mapInArrow(_call, CALLS)
        told = stored_by(calls.groupBy("shard").cogroup(words.groupBy("shard")).applyInArrow(_seat_words(spelling, discount, concentration, tables, two.tables, keep, k + 1), WORDS), "kind", (WORD, REPLY), "lm-words", "zstd")
        discard(words)
        words = told[WORD]
        one = sums(words, "spelt")
        tables = one.tables
        seated = stored(pairs.groupBy("shard").cogroup(told[REPLY].groupBy("shard")).applyInArrow(_seat_pairs(below, context_concentration, keep, k + 1), PAIRS), "lm-pairs", "zstd")
        discard(told[REPLY])
        discard(pairs)
        pairs = seated
        two = sums(pairs)
        if keep:
            spellings.append(spelling)
            levels.append((concentration + discount * tables, concentration + one.customers, max(1e-12, 1 - one.spelt)))
        else:
            discount = discount_of(np.array([1, 2]), np.array([one.once, one.twice], float))
    whole = pairs.drop("kind").withColumn("kind", F.lit(PAIR)).unionByName(gathered[PLACE].withColumn("kind", F.lit(PLACE)))
    answers = stored(whole.groupBy("shard").cogroup(words.groupBy("shard")).applyInArrow(_answer(spellings, levels), ANSWERS), "lm-answers", "zstd")
    for table in (words, pairs, gathered[PLACE]):
        discard(table)
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score_block(n, v, levels, below, context_concentration), SCORES)
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"), "open_score")
