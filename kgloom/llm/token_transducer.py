"""Token counts by a compiled transducer: transitions carry emitted-token counts, chunks run side by side, their state maps compose in a scan.

Two machines in cascade. The first splits a text into pieces; its state maps of eight states compose in a prefix scan
(`bpe.boundaries`). The second reads the bytes of pieces. After each prefix of a piece, byte-pair encoding has a last
token, and the next prefix's last token is the one whose left neighbour, the last token of what is before it, it can
stand beside without a merge across. So a state need only hold, for each place that an unfinished token may have started
at, (node of the token trie, last token before it, tokens up to it against tokens up to here): finitely many states, each
transition labelled with the change of the token count. States are made when a text first needs them, all of a column of
chunks at once, and kept in a table of bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm import bpe
from kgloom.llm.common import fresh, release
from kgloom.llm.hashing import mix

#: No such merge, or no such event.
NEVER = np.int64(1 << 40)
#: Bytes of a chunk; all chunks of a block of texts advance by a byte at a time.
CHUNK = 64


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where it is printable Latin-1, else the next one from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Machine:
    """A vocabulary compiled to arrays: merges, the token trie, and strings that are a token each wherever they stand."""

    byte: np.ndarray  # token of each byte
    pairs: np.ndarray  # sorted, left << 32 | right
    pair_rank: np.ndarray
    rank: np.ndarray  # of the merge that makes a token, -1 for bytes
    left: np.ndarray
    right: np.ndarray
    edges: np.ndarray  # sorted, node << 8 | byte
    child: np.ndarray
    token: np.ndarray  # of each node, -1 where the path is none
    inner: np.ndarray  # whether a node has children
    special: tuple[str, ...]
    kinds: np.ndarray  # classes of code points

    @classmethod
    def of(cls, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: tuple[str, ...] = ()) -> Machine:
        letters = byte_letters()
        size = max(vocabulary.values()) + 1
        rank, left, right = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        keys = []
        for r, (a, b) in enumerate(merges):
            t, x, y = vocabulary[a + b], vocabulary[a], vocabulary[b]
            if rank[t] >= 0:
                raise ValueError(f"two merges make the token {a + b!r}")
            rank[t], left[t], right[t] = r, x, y
            keys.append((x << 32 | y, r))
        pairs, pair_rank = np.array(sorted(keys), np.int64).reshape(-1, 2).T
        machine = cls(np.array([vocabulary[c] for c, _ in sorted(letters.items(), key=lambda e: e[1])], np.int64), np.ascontiguousarray(pairs), np.ascontiguousarray(pair_rank), rank, left, right, *[np.zeros(0, np.int64)] * 4, special, bpe.classes())
        machine._build_trie({t: bytes(letters[c] for c in s) for s, t in vocabulary.items() if rank[t] >= 0 or len(s) == 1 and s in letters})
        return machine

    @classmethod
    def load(cls, path: str) -> Machine:
        """From a tokenizer file of the byte-level kind without normalizer, prefix space or other options."""
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, split, odd = whole["model"], whole["pre_tokenizer"] or {}, []
        odd += [k for k in ("normalizer", "truncation", "padding") if whole.get(k)]
        odd += [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for t in whole["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if t[k]]
        if odd or model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level vocabulary {odd}")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return cls.of(model["vocab"], merges, tuple(t["content"] for t in whole["added_tokens"]))

    def _build_trie(self, spelt: dict[int, bytes]) -> None:
        """The trie of all tokens that encode to themselves."""
        ids = np.array(sorted(spelt), np.int64)
        made = ids[self.rank[ids] >= 0]
        good = dict.fromkeys(ids[self.rank[ids] < 0].tolist(), True)
        apart = self.beside(self.left[made], self.right[made], self.rank[made])
        for t, fine in sorted(zip(made.tolist(), apart.tolist()), key=lambda e: self.rank[e[0]]):
            good[t] = fine and good[int(self.left[t])] and good[int(self.right[t])]
        edges: dict[int, int] = {}
        token = [-1]
        for t, spelling in spelt.items():
            if good[t]:
                node = 0
                for b in spelling:
                    node = edges.setdefault(node << 8 | b, len(token))
                    if node == len(token):
                        token.append(-1)
                token[node] = t
        self.edges = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.edges.tolist()], np.int64)
        self.token = np.array(token, np.int64)
        self.inner = np.zeros(len(token), bool)
        self.inner[self.edges >> 8] = True

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        if not len(self.pairs):
            return np.full(len(key), NEVER)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NEVER)

    def beside(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a and b stay side by side when their bytes are encoded together (up to the merge number `before`).

        Followed backwards: of the two tokens at the seam the one that was made later is undone. A merge across the seam
        happens if it comes before the left one's next merge, and not after the right one's (of equal merges the left
        goes first). A left token of -1, the start of a piece, stands beside all.
        """
        ok, at = np.ones(len(a), bool), np.flatnonzero(a >= 0)
        a, b = a[at], b[at]
        ends_left = ends_right = np.full(len(at), NEVER) if before is None else before[at]
        whole = before is not None  # the merge of a and b themselves is what before allows
        while len(at):
            crossing = self.merge_rank(a, b)
            crosses = (crossing < ends_left) & (crossing <= ends_right) & (crossing < NEVER)
            if whole:
                crosses &= crossing < before[at]
            ra, rb = self.rank[a], self.rank[b]
            ok[at[crosses]] = False
            go = ~crosses & ((ra >= 0) | (rb >= 0))
            undo_right = rb >= ra
            ends_left, ends_right = np.where(undo_right, ends_left, ra)[go], np.where(undo_right, rb, ends_right)[go]
            a, b = np.where(undo_right, a, self.right[a])[go], np.where(undo_right, self.left[b], b)[go]
            at = at[go]
        return ok


class Transitions:
    """Next state and emitted count by state << 8 | byte: an open table of arrays, at most half full."""

    def __init__(self, slots: int = 1 << 16):
        self.used, self.keys = 0, np.full(slots, -1, np.int64)
        self.after, self.emit = np.zeros(slots, np.int32), np.zeros(slots, np.int16)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(np.uint64)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots, indexes of the keys that it lacks)."""
        slot = self._slot(key)
        look = np.flatnonzero(self.keys[slot] != key)
        lacking = []
        while len(look):
            free = self.keys[slot[look]] < 0
            lacking.append(look[free])
            look = look[~free]
            slot[look] = (slot[look] + 1) & (len(self.keys) - 1)
            look = look[self.keys[slot[look]] != key[look]]
        return slot, np.concatenate(lacking) if lacking else look

    def insert(self, key: np.ndarray, after: np.ndarray, emit: np.ndarray) -> None:
        """Distinct keys that it lacks."""
        self.used += len(key)
        if self.used * 2 > len(self.keys):
            full, old = self.keys >= 0, (self.keys, self.after, self.emit)
            grown = Transitions(len(self.keys) << 1 + int(self.used // len(self.keys)))
            grown.insert(*(x[full] for x in old))
            self.keys, self.after, self.emit = grown.keys, grown.after, grown.emit
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            at = slot[left]
            free = self.keys[at] < 0
            self.keys[at[free]] = key[left[free]]  # of two keys for one slot one stays
            done = self.keys[at] == key[left]
            self.after[at[done]], self.emit[at[done]] = after[left[done]], emit[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)


class Transducer:
    """States that texts have needed so far: frames (trie node, last token before it, tokens up to it less tokens up to here), and their transitions. Of more than room states none is kept for the next block."""

    def __init__(self, machine: Machine, room: int = 250_000):
        self.machine, self.room = machine, room
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.frames = np.zeros((1024, 3), np.int32)
        self.first = np.zeros(1025, np.int64)  # where the frames of each state start
        self.transitions = Transitions()
        self._add([np.array([[0, -1, 0]], np.int32)])

    def _add(self, made: list[np.ndarray]) -> list[int]:
        """The numbers of states, new ones numbered next."""
        out, new, n = [], [], len(self.known)
        for frames in made:
            key = frames.tobytes()
            number = self.known.setdefault(key, n)
            if number == n:
                new.append(frames)
                n += 1
            out.append(number)
        if new:
            start = n - len(new)
            used, rows = int(self.first[start]), np.concatenate(new)
            while used + len(rows) > len(self.frames):
                self.frames = np.concatenate([self.frames, np.zeros_like(self.frames)])
            self.frames[used : used + len(rows)] = rows
            while n + 1 > len(self.first):
                self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.first[start + 1 : n + 1] = used + np.cumsum([len(x) for x in new])
        return out

    def expand(self, key: np.ndarray) -> None:
        """Makes the transitions state << 8 | byte, which are distinct and not yet known."""
        m, state, byte = self.machine, key >> 8, key & 255
        count = self.first[state + 1] - self.first[state]
        owner = np.repeat(np.arange(len(key)), count)
        frame = self.frames[np.repeat(self.first[state] - np.cumsum(count) + count, count) + np.arange(len(owner))].astype(np.int64)
        edge = frame[:, 0] << 8 | byte[owner]
        at = np.minimum(np.searchsorted(m.edges, edge), len(m.edges) - 1)
        on = m.edges[at] == edge
        owner, frame, node = owner[on], frame[on], m.child[at[on]]
        token = m.token[node]
        ends = np.flatnonzero(token >= 0)
        ends = ends[m.beside(frame[ends, 1], token[ends])]
        who, which = np.unique(owner[ends], return_index=True)
        assert len(who) == len(key) == len(ends), "one last token for each prefix"
        last, emitted = token[ends[which]], frame[ends[which], 2] + 1
        keep = m.inner[node]
        owner = np.concatenate([owner[keep], who])
        rows = np.column_stack([np.append(node[keep], np.zeros(len(who), np.int64)), np.append(frame[keep, 1], last), np.append(frame[keep, 2] - emitted[owner[: keep.sum()]], np.zeros(len(who), np.int64))])
        order = np.argsort(owner, kind="stable")
        rows = np.ascontiguousarray(rows[order].astype(np.int32))
        cuts = np.append(0, np.cumsum(np.bincount(owner, minlength=len(key))))
        numbers = self._add([rows[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())])
        self.transitions.insert(key, np.array(numbers, np.int32), emitted)

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, emitted counts)."""
        key = state.astype(np.int64) << 8 | byte
        slot, lacking = self.transitions.find(key)
        if len(lacking):
            self.expand(np.unique(key[lacking]))
            slot, _ = self.transitions.find(key)
        return self.transitions.after[slot], self.transitions.emit[slot]

    def emitted(self, data: np.ndarray, opens: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """The change of the token count at each byte; opens: whether a byte starts a piece, as the first one must.

        All chunks run side by side from the start state, which gives each one's path. A chunk's state map leads any entry
        state to the path's end as soon as the two meet, at the latest where a piece starts. The scan composes the maps: a
        chunk whose true entry state differs from the one it ran from is run anew until it meets its path, and its
        successor is looked at again where its end has changed.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.int16)
        if len(self.known) > self.room:
            self.clear()
        rows = -(-n // chunk)
        pad = rows * chunk - n
        bytes_by = np.ascontiguousarray(np.append(data, np.zeros(pad, np.uint8)).reshape(rows, chunk).T)
        opens_by = np.ascontiguousarray(np.append(opens, np.ones(pad, bool)).reshape(rows, chunk).T)
        path, out = np.empty((chunk, rows), np.int32), np.empty((chunk, rows), np.int16)
        state = np.zeros(rows, np.int32)
        for j in range(chunk):
            state, out[j] = self.step(np.where(opens_by[j], np.int32(0), state), bytes_by[j])
            path[j] = state
        ran_from = np.zeros(rows, np.int32)
        which = np.arange(1, rows)
        while len(which):
            entry = path[-1, which - 1]
            which, entry = which[entry != ran_from[which]], entry[entry != ran_from[which]]
            ran_from[which] = entry
            going, state = which, entry
            for j in range(chunk):
                inside = ~opens_by[j, going]
                going, state = going[inside], state[inside]
                if not len(going):
                    break
                state, out[j, going] = self.step(state, bytes_by[j, going])
                apart = state != path[j, going]
                going, state = going[apart], state[apart]
                path[j, going] = state
            which = going + 1  # chunks whose end has changed have successors to look at
            which = which[which < rows]
        return out.T.ravel()[:n]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        special, parts, of, extra = self.machine.special, [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            pieces = cut_out(text, special)
            extra[i] = len(pieces) - 1
            parts += pieces
            of += [i] * len(pieces)
        joined = "".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = bpe.boundaries(points, (np.cumsum(sizes) - sizes)[sizes > 0])
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        ends = np.append(0, np.cumsum(sizes))
        if len(data) != len(points):
            offset = np.append(0, np.cumsum(1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64))
            at, ends = offset[at], offset[ends]
        opens = np.zeros(len(data), bool)
        opens[at] = True
        running = np.append(0, np.cumsum(self.emitted(data, opens), dtype=np.int64))
        return extra + np.bincount(of, running[ends[1:]] - running[ends[:-1]], len(texts)).astype(np.int64)


def cut_out(text: str, special: tuple[str, ...]) -> list[str]:
    """What is between the special strings, of which the longest of the leftmost ones counts."""
    out, at = [], 0
    while special:
        found = [(i, -len(s)) for s in special if (i := text.find(s, at)) >= 0]
        if not found:
            break
        start, length = min(found)
        out.append(text[at:start])
        at = start - length
    return [*out, text[at:]]


_transducers: dict[str, Transducer] = {}


def _counter(shared, key: str, chars: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducers.get(key)
        if transducer is None:
            machine = shared.value
            if not bpe._classes:
                bpe._classes.append(machine.kinds)
            _transducers.clear()
            transducer = _transducers.setdefault(key, Transducer(machine))
        for batch in batches:
            source, numbers, texts, size = batch.column(batch.num_columns - 1), [], [], 0
            for i in range(batch.num_rows):
                texts.append(source[i].as_py() or "")
                size += len(texts[-1])
                if size >= chars or i == batch.num_rows - 1:
                    numbers.append(transducer.counts(texts))
                    texts, size = [], 0
            if numbers:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(numbers))], names=[*batch.schema.names[:-1], "n_tokens"])
        release()

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, text_col: str = "text", chars: int = 1_000_000) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens (long) and over_limit (n_tokens > limit) to each row; docs keeps its columns, text_col left out, and columns named as outputs are replaced.

    Counts are those of a byte-level tokenizer file without begin, end or padding; the file's special strings count as
    one token each where a text has them. Null and empty texts have no bytes and no tokens; repeated rows count alike; an
    empty table gives an empty result. The driver compiles the file, whose size is fixed, and broadcasts the arrays; texts
    are worked on in groups of about chars characters, a longer text alone, in time linear in their bytes. Nothing is
    shuffled. A worker's states and transitions hold about 120 MB at most beside that.
    """
    outputs = ("n_bytes", "n_tokens", "over_limit")
    text, row = fresh(docs, "_text", "_row")
    kept = [c for c in docs.columns if c not in outputs and c != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(Machine.load(tokenizer_path))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    slim = docs.select(F.struct(*kept).alias(row) if kept else F.lit(0).alias(row), size.alias("n_bytes"), F.col(text_col).alias(text))
    schema = f"{row} {slim.schema[row].dataType.simpleString()}, n_bytes long, n_tokens long"
    out = slim.mapInArrow(_counter(shared, tokenizer_path, chars), schema)
    return out.select(*([f"{row}.*"] if kept else []), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
