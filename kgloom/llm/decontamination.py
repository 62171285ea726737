"""Benchmark decontamination: pigeonhole pieces of each test item are found exactly, and Myers' bit-parallel distance verifies around them."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import release

HIT = "array<struct<item_id:long,errors:int,end:int>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("errors", pa.int32()), ("end", pa.int32())]))


def budget(length: int, error_rate: float) -> int:
    """Edits that an item of this length may take."""
    return int(length * error_rate)


def pieces(text: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of near equal length. So many edits leave one of them untouched."""
    n, parts = len(text), errors + 1
    cuts = [i * n // parts for i in range(parts + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]


def myers(masks: dict[str, int], m: int, window: str) -> list[int]:
    """Least edits between a pattern and a substring of the window that ends at each of its characters.

    masks: by character, the pattern's positions that hold it, as bits; m: the pattern's length. Python's integers are
    the bit vectors, of any length.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, out = full, 0, m, []
    for c in window:
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (~(horizontal | plus) & full), plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full  # a match may start anywhere, so nothing enters below
        plus, minus = down | (~(vertical | up) & full), up & vertical
        out.append(score)
    return out


def normal(text: str) -> str:
    """Lower case and plain spaces, character by character, so that offsets stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for c in "\n\t\r\f\v":
        low = low.replace(c, " ")
    return low


class Matcher:
    """Finds items within their error budget in texts."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float):
        self.items, by_piece = [], {}
        for k, (item_id, text) in enumerate(items):
            text, masks = normal(text), {}
            errors = budget(len(text), error_rate)
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            self.items.append((item_id, text, errors, masks))
            for offset, piece in pieces(text, errors):
                by_piece.setdefault(piece, []).append((k, offset))
        self.finder = ahocorasick.Automaton()
        for piece, places in by_piece.items():
            self.finder.add_word(piece, (len(piece), places))
        if by_piece:
            self.finder.make_automaton()
        self.empty = not by_piece

    def find(self, text: str) -> list[dict]:
        """For each item that occurs: the fewest errors, and the end of the first substring that has so few."""
        if self.empty or not text:
            return []
        text = normal(text)
        windows: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.finder.iter(text):
            for k, offset in places:
                _, item, errors, _ = self.items[k]
                start = last - size + 1 - offset
                lo, hi = max(0, start - errors), min(len(text), start + len(item) + errors)
                own = windows.setdefault(k, [])
                if own and lo <= own[-1][1]:
                    own[-1] = [min(lo, own[-1][0]), max(hi, own[-1][1])]
                else:
                    own.append([lo, hi])
        best: dict[int | None, tuple[int, int]] = {}
        for k, spans in windows.items():
            item_id, item, errors, masks = self.items[k]
            for lo, hi in spans:
                d, end = min((d, lo + i + 1) for i, d in enumerate(myers(masks, len(item), text[lo:hi])))
                if d <= errors and (d, end) < best.get(item_id, (d, end + 1)):
                    best[item_id] = d, end
        return [{"item_id": i, "errors": d, "end": e} for i, (d, e) in sorted(best.items(), key=lambda x: (x[0] is not None, x[0] or 0))]


def _finder(shared, error_rate: float, keep_text: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, error_rate)
        for batch in batches:
            rows, texts = batch.columns
            found = pa.array([matcher.find(t.as_py() or "") for t in texts], _HIT)
            yield pa.RecordBatch.from_arrays([rows, *([texts] if keep_text else []), found], names=["row", *(["text"] if keep_text else []), "leaks"])
        release()

    return find


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, streamed to the driver a partition at a time."""
    block, size = [], 0
    clean = benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).where(f"`{text_col}` <> ''").distinct().repartition(32)
    for item_id, text in clean.toLocalIterator():
        block.append((item_id, text))
        size += len(text)
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", keep_text: bool = True, block_chars: int = 2_000_000) -> DataFrame:
    """Adds leaks to each row: array<struct<item_id, errors, end>>, the items of which the text has a substring within floor(error_rate * length) edits.

    Case and the kind of white space don't matter (normal). errors is the fewest edits, end where the first such
    substring ends, in code points; items are sorted by id. Null and empty texts hold nothing; items without text are in
    no text; those without id are reported under a null item_id, which is an id like others and the first; rows that repeat an item count once, and of different texts under one id the nearest counts.
    Repeated documents are searched alike; empty tables give no leaks. Other columns stay (one named leaks is replaced),
    the text only with keep_text.

    Items are the query set: they are broadcast in blocks of about block_chars characters, each block against all
    documents where they are read, so memory is bounded however many items there are, and nothing is shuffled. With
    several blocks a text is read once for each, and an id that two blocks hold is reported by its nearest text.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in (text_col, "leaks")]
    none = F.expr(f"cast(array() as {HIT})")
    out = docs.select(F.struct(*others).alias("row") if others else F.struct(F.lit(0).alias("_")).alias("row"), F.col(text_col).alias("text"), none.alias("leaks"))
    for block in _item_blocks(benchmark, item_id_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast(block)
        slim = out.select(F.struct("row", "leaks").alias("row"), "text")
        found = slim.mapInArrow(_finder(shared, error_rate, True), f"row {slim.schema['row'].dataType.simpleString()}, text string, leaks {HIT}")
        out = found.select("row.row", "text", F.concat("row.leaks", "leaks").alias("leaks"))
    nearest = F.filter("leaks", lambda x: ~F.exists("leaks", lambda y: y["item_id"].eqNullSafe(x["item_id"]) & ((y["errors"] < x["errors"]) | ((y["errors"] == x["errors"]) & (y["end"] < x["end"])))))
    done = out.withColumn("leaks", F.array_sort(F.array_distinct(nearest)))
    columns = [F.col("text").alias(text_col) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "leaks" and (keep_text or c != text_col)]
    return done.select(*columns, "leaks")
