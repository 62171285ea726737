"""Scalar text functions as Column expressions: cleaning, verdicts, chunking, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Answers that count as agreement, wherever they stand in the answer.
AGREEING = ("true", "yes", "correct", "right", "equivalent")
#: Fixed value: the mark that ends the prompt in a model's output.
PROMPT_END = "[/INST]"


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def clean_symbols(x: Column) -> Column:
    """Without line feeds, quotes and brackets; underscores and commas as spaces; white space squeezed."""
    return squeeze(F.translate(x, "_,\n'\"<>[]()", "  "))


def clean_entity(x: Column) -> Column:
    """Underscores as spaces, braces deleted, white space squeezed."""
    return squeeze(F.translate(x, "_{}", " "))


#: Relations are cleaned as entities are.
clean_relation = clean_entity


def strip_prompt(x: Column) -> Column:
    """What follows the last prompt mark, stripped; the text itself where there is none."""
    return F.when(F.contains(x, F.lit(PROMPT_END)), strip(F.substring_index(x, PROMPT_END, -1))).otherwise(x)


def verdict(answer: Column, strict: bool = False) -> Column:
    """Whether an answer agrees; null answers don't. As the substring rule has it "incorrect" agrees; strict asks for a leading "true"."""
    found = answer.rlike(r"(?i)^\s*['\"]?true\b") if strict else F.lower(answer).rlike("|".join(AGREEING))
    return F.coalesce(found, F.lit(False))


def keyword_line(line: Column) -> Column:
    """Keywords of a line, parted by tabs or by comma and space."""
    return F.split(F.replace(line, F.lit("\t"), F.lit(", ")), ", ")


def keyword_query(keywords: Column) -> Column:
    return F.array_join(keywords, ", ")


def body(abstract: Column, alternative: Column | None = None) -> Column:
    """The first of abstract and alternative that isn't empty, else the empty text."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(abstract), *([] if alternative is None else [blank(alternative)]), F.lit(""))


def sentences(text: Column) -> Column:
    """Pieces between full stops, stripped; empty pieces go before stripping, so blank ones stay as empty texts."""
    return F.transform(F.filter(F.split(text, r"\."), lambda x: x != ""), strip)


def windows(text: Column, size: int, overlap: int) -> Column:
    """Character windows of size that start every size - overlap characters."""
    step = size - overlap
    if step <= 0:
        raise ValueError("the window must be larger than the overlap")
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(0), F.length(text) - size, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))


def triple_text(head: Column, relation: Column, tail: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", head, relation, tail), F.lit(")"))


def triple_line(head: Column, relation: Column, tail: Column) -> Column:
    return F.concat_ws(", ", head, relation, tail)


def any_keyword_in(keywords: Column, text: Column) -> Column:
    """Whether a keyword is part of the text, case aside."""
    return F.exists(keywords, lambda k: F.contains(F.lower(text), F.lower(k)))


def all_keywords_in(keywords: Column, text: Column) -> Column:
    return F.forall(keywords, lambda k: F.contains(text, k))


def triple_sentence(head: Column, relation: Column, tail: Column) -> Column:
    """A triple as text to embed."""
    return F.concat_ws(" ", head, relation, tail)


def article_record(terms: Column, title: Column, abstract: Column, keywords: Column) -> Column:
    """The four fields kept of a MEDLINE record: its terms (OT) joined, title (TI), abstract (AB), and whether a keyword is among the terms; what lacks is empty."""
    listed = F.coalesce(F.array_join(terms, ", "), F.lit(""))
    return F.struct(listed.alias("keywords"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(abstract, F.lit("")).alias("abstract"), any_keyword_in(keywords, listed).alias("keywords_match"))
