"""Language identification: a bidirectional gated recurrent network over bytes labels every position and pools them for the document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgloom.llm.common import fresh, release

A_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: A dirty column may name any number of languages; this many, the most frequent, are learnt.
MAX_LANGUAGES = 200


def windows(data: bytes, length: int) -> np.ndarray:
    """Rows of so many bytes, the last padded with zeros."""
    n = -(-len(data) // length)
    out = np.zeros(n * length, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, length)


def gate(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """A sigmoid in three straight pieces."""
    out = np.multiply(x, 0.25, out=out)
    out += 0.5
    return np.clip(out, 0.0, 1.0, out=out)


@dataclass
class Network:
    """Parameters; the leading axis of the recurrent ones is the direction (forward, backward).

    inputs: what a byte adds to the update gate, the reset gate and the candidate; gates: from the state to both gates;
    candidate: from the reset state to the candidate; labels: from both states to the languages' logits.
    """

    languages: list[str]
    inputs: np.ndarray
    gates: np.ndarray
    candidate: np.ndarray
    labels: np.ndarray
    bias: np.ndarray
    length: int = 128
    names: tuple[str, ...] = field(default=("inputs", "gates", "candidate", "labels", "bias"), repr=False)

    @classmethod
    def initial(cls, languages: list[str], hidden: int, length: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            languages, draw(2, 256, 3 * hidden, scale=0.3), draw(2, hidden, 2 * hidden, scale=hidden**-0.5), draw(2, hidden, hidden, scale=hidden**-0.5),
            draw(2 * hidden, len(languages), scale=hidden**-0.5), np.zeros(len(languages), np.float32), length,
        )

    @property
    def hidden(self) -> int:
        return self.candidate.shape[1]

    def states(self, rows: np.ndarray, keep: bool = False):
        """States (time, direction, row, hidden) of windows of bytes; with keep also what backpropagation needs.

        Both directions run in one loop: step t reads byte t forward and byte length - 1 - t backward, so at time t of
        the result the second direction has seen bytes from the end down to length - 1 - t.
        """
        n, length, h = len(rows), rows.shape[1], self.hidden
        state = np.zeros((2, n, h), np.float32)
        out, trace = np.empty((length, 2, n, h), np.float32), []
        x = np.empty((2, n, 3 * h), np.float32)
        for t in range(length):
            np.take(self.inputs[0], rows[:, t], axis=0, out=x[0])
            np.take(self.inputs[1], rows[:, length - 1 - t], axis=0, out=x[1])
            gates = gate(x[..., : 2 * h] + np.matmul(state, self.gates))
            z, r = gates[..., :h], gates[..., h:]
            rs = r * state
            cand = np.tanh(x[..., 2 * h :] + np.matmul(rs, self.candidate))
            if keep:
                trace.append((state, gates, rs, cand))
            state = state + z * (cand - state)
            out[t] = state
        return (out, trace) if keep else out

    def logits(self, states: np.ndarray) -> np.ndarray:
        """(position, row, language)."""
        h = self.hidden
        return np.matmul(states[:, 0], self.labels[:h]) + np.matmul(states[::-1, 1], self.labels[h:]) + self.bias

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Of each language at each position: (position, row, language)."""
        x = self.logits(self.states(rows))
        x -= x.max(-1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(-1, keepdims=True)
        return x

    def gradients(self, rows: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the labelled positions (bytes other than padding), and its gradients through time."""
        h, (length, n) = self.hidden, (rows.shape[1], len(rows))
        states, trace = self.states(rows, keep=True)
        x = self.logits(states)
        x -= x.max(-1, keepdims=True)
        p = np.exp(x)
        p /= p.sum(-1, keepdims=True)
        there = (rows.T != 0).astype(np.float32)
        total = max(1.0, float(there.sum()))
        loss = -float((np.log(p[:, np.arange(n), target] + 1e-9) * there).sum()) / total
        d = p
        d[:, np.arange(n), target] -= 1
        d *= there[..., None] / total
        flat = d.reshape(-1, d.shape[-1])
        fore, back = states[:, 0].reshape(-1, h), states[::-1, 1].reshape(-1, h)
        grads = {"labels": np.concatenate([fore.T @ flat, back.T @ flat]), "bias": flat.sum(0), "inputs": np.zeros_like(self.inputs), "gates": np.zeros_like(self.gates), "candidate": np.zeros_like(self.candidate)}
        d_out = np.stack([d @ self.labels[:h].T, (d @ self.labels[h:].T)[::-1]], axis=1)
        carry = np.zeros((2, n, h), np.float32)
        for t in range(length - 1, -1, -1):
            state, gates, rs, cand = trace[t]
            z, r = gates[..., :h], gates[..., h:]
            carry = carry + d_out[t]
            d_cand = carry * z * (1 - cand * cand)
            d_rs = np.matmul(d_cand, self.candidate.transpose(0, 2, 1))
            open_ = (gates > 0) & (gates < 1)
            d_gates = np.concatenate([carry * (cand - state), d_rs * state], axis=-1) * open_ * 0.25
            grads["candidate"] += np.matmul(rs.transpose(0, 2, 1), d_cand)
            grads["gates"] += np.matmul(state.transpose(0, 2, 1), d_gates)
            d_x = np.concatenate([d_gates, d_cand], axis=-1)
            for side, column in ((0, rows[:, t]), (1, rows[:, length - 1 - t])):
                np.add.at(grads["inputs"][side], column, d_x[side])
            carry = carry * (1 - z) + d_rs * r + np.matmul(d_gates, self.gates.transpose(0, 2, 1))
        return loss, grads

    def pooled(self, texts: list[str], group: int = 1024) -> np.ndarray:
        """Mean probabilities over all bytes of each text, which run in windows: (text, language)."""
        sums = np.zeros((len(texts), len(self.languages)))
        rows, owner = [], []
        datas = [t.encode("utf-8", "surrogatepass") for t in texts]
        for i, data in enumerate(datas):
            own = windows(data, self.length)
            rows.append(own)
            owner.append(np.full(len(own), i))
        rows, owner = np.concatenate(rows), np.concatenate(owner)
        for lo in range(0, len(rows), group):
            part = rows[lo : lo + group]
            p = self.probabilities(part)
            p *= (part.T != 0)[..., None]
            np.add.at(sums, owner[lo : lo + group], p.sum(0))
        return sums / np.maximum(sums.sum(-1, keepdims=True), 1e-12)


def train(samples: list[tuple[str, str]], hidden: int = 12, length: int = 64, steps: int = 260, batch: int = 96, rate: float = 0.012, seed: int = 7) -> Network:
    """Backpropagation through time with Adam on windows drawn evenly over languages; samples: (language, text)."""
    languages = sorted({lang for lang, _ in samples})
    rng = np.random.default_rng(seed)
    pools = [np.concatenate([windows(t.encode("utf-8", "surrogatepass"), length) for lang, t in samples if lang == name and t] or [np.zeros((1, length), np.uint8)]) for name in languages]
    net = Network.initial(languages, hidden, length, seed)
    first = {k: np.zeros_like(getattr(net, k)) for k in net.names}
    second = {k: np.zeros_like(getattr(net, k)) for k in net.names}
    for step in range(1, steps + 1 if len(languages) > 1 else 1):
        target = rng.integers(len(languages), size=batch)
        rows = np.stack([pools[k][rng.integers(len(pools[k]))] for k in target])
        _, grads = net.gradients(rows, target)
        norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
        lr = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            value = getattr(net, k)
            value -= (lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def labelled_sample(docs: DataFrame, per_language: int, chars: int, languages: int = MAX_LANGUAGES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most per_language texts of each of the most frequent languages, chosen by hash, cut to chars at a place chosen by hash.

    The languages are counted first, so that only about the rows needed are ranked.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.length(text_col)), 11).alias("h"))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(float(1 << 53) * min(1.0, (3 * per_language + 30) / n)))])
    few = usable.where(F.col("h") < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    start = F.lit(1) + (F.col("h") % F.greatest(F.lit(1), F.length("text") - chars)).cast("int")
    ranked = few.select("lang", "h", F.col("text").substr(start, F.lit(chars)).alias("text")).withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "text")))
    return [(r[0], r[1]) for r in ranked.where(f"n <= {per_language}").select("lang", "text").orderBy("lang", "n").collect()]


def _labeller(shared, chars: int):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network | None = shared.value
        for batch in batches:
            column, n = batch.column(batch.num_columns - 1), batch.num_rows
            names, scores = [UNKNOWN] * n, [0.0] * n
            group: list[tuple[int, str]] = []
            size = 0

            def settle():
                if group:
                    for (i, _), p in zip(group, net.pooled([t for _, t in group])):
                        best = int(p.argmax())
                        names[i], scores[i] = net.languages[best], float(p[best])
                    group.clear()

            for i in range(n):
                text = column[i].as_py()
                if net is not None and text and A_LETTER.search(text):
                    group.append((i, text))
                    size += len(text)
                    if size >= chars:
                        settle()
                        size = 0
            settle()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])
        release()

    return label


def fit(labelled: DataFrame, per_language: int = 250, chars: int = 400, **options) -> Network | None:
    """A network from at most per_language excerpts of chars characters of each of the MAX_LANGUAGES most frequent languages; None without labelled rows."""
    samples = labelled_sample(labelled, per_language, chars)
    return train(samples, **options) if samples else None


def label_documents(docs: DataFrame, net: Network | None, text_col: str = "text", chars: int = 250_000, keep_text: bool = True) -> DataFrame:
    """Adds lang_pred and score (the pooled probability of that language, 0 to 1) to each row.

    Every byte of a text is labelled and counts alike; texts run in windows, so a long one takes no more memory. Null
    texts and texts without a letter are und with score 0, as all are where nothing could be learnt. Repeated rows get
    the same labels; an empty table gives an empty result. Other columns stay (those named as outputs are replaced), the
    text only with keep_text.
    """
    (row, text) = fresh(docs, "_row", "_text")
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kept = [c for c in others if c != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(net)
    slim = docs.select(F.struct(*kept).alias(row) if kept else F.struct(F.lit(0).alias("_")).alias(row), F.col(text_col).alias(text))
    done = slim.mapInArrow(_labeller(shared, chars), f"{row} {slim.schema[row].dataType.simpleString()}, {text} string, lang_pred string, score double")
    columns = [F.col(text).alias(c) if c == text_col else F.col(f"{row}.`{c}`").alias(c) for c in others if keep_text or c != text_col]
    return done.select(*columns, "lang_pred", "score")
