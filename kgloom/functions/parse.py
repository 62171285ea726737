"""Triples and keywords out of semi-structured text, as Column expressions over built-in regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgloom.functions.text import clean_entity, clean_symbols, strip

# The forms in which triples and keywords are written. (?s) lets a dot pass line ends.
FILE_TRIPLE = r"(?s)[\[\(<]\s*'([^']+?)'\s*,\s*'([^']+?)'\s*,\s*'([^']+?)'\s*[\]\)>]"
QUOTED_TRIPLE = r"""(?s)[\[\(<"']\s*'([^']+?)'\s*[,，]\s*'([^']+?)'\s*[,，]\s*'([^']+?)'\s*[\]\)>"'|\n]"""
LOOSE_TRIPLE = r"""(?s)[\[\(<"']\s*([^,，]+?)\s*[,，]\s*([^,，]+?)\s*[,，]\s*(.*?)\s*[\]\)>|\n]"""
QUOTED_KEYWORD = r"""(?s)[\[\(<"']\s*'([^']+?)'\s*[\]\)>"'\n,]*"""
LOOSE_KEYWORD = r"""(?s)[\[\(<"']?\s*([^,，\]\)>]+?)\s*[,，\]\)>]"""
NO_CONFLICT, NO_REMOVAL = ("no conflicting triples", "conflicting triples: none"), ("no triples to remove", "removal triples: none")


def _groups(text: Column, pattern: str) -> Column:
    """array<struct<head, relation, tail>> of a pattern's matches, in order."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(("head", "relation", "tail"), 1)]
    return F.transform(F.arrays_zip(*parts), lambda t: F.struct(t["head"].alias("head"), t["relation"].alias("relation"), t["tail"].alias("tail")))


def _each(triples: Column, f) -> Column:
    return F.transform(triples, lambda t: F.struct(*[f(t[n]).alias(n) for n in ("head", "relation", "tail")]))


def file_triples(line: Column) -> Column:
    """Every quoted triple of a line of a graph file."""
    return _each(_groups(line, FILE_TRIPLE), strip)


def model_triples(text: Column, max_length: int = 80) -> Column:
    """Triples of a model's answer: quoted ones, then loosely written ones; cleaned, without parts over max_length characters, first occurrences only."""
    cleaned = _each(F.concat(_groups(text, QUOTED_TRIPLE), _groups(text, LOOSE_TRIPLE)), clean_symbols)
    return F.array_distinct(F.filter(cleaned, lambda t: F.greatest(F.length(t["head"]), F.length(t["relation"]), F.length(t["tail"])) <= max_length))


def model_keywords(text: Column) -> Column:
    """Keywords of a model's answer, cleaned, distinct and sorted."""
    found = F.concat(F.regexp_extract_all(text, F.lit(QUOTED_KEYWORD), F.lit(1)), F.regexp_extract_all(text, F.lit(LOOSE_KEYWORD), F.lit(1)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, clean_entity), lambda k: k != "")))


def _before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def conflicts(text: Column) -> tuple[Column, Column]:
    """(conflicting, to remove) of an answer, in lower case; what is to be removed is among what conflicts."""
    low = F.lower(strip(text))
    says = lambda phrases: F.contains(low, F.lit(phrases[0])) | F.contains(low, F.lit(phrases[1]))
    none = F.expr("cast(array() as array<struct<head:string,relation:string,tail:string>>)")
    first = strip(F.replace(_before(low, "removal triples:"), F.lit("conflicting triples:"), F.lit("")))
    last = strip(F.substring_index(low, "removal triples:", -1))
    found = F.when(says(NO_CONFLICT), none).otherwise(model_triples(strip(_before(first, "explanation:"))))
    removal = F.when(says(NO_REMOVAL), none).otherwise(F.array_intersect(model_triples(strip(_before(last, "explanation:"))), found))
    return found, removal


def tuple_key(key: Column, names: list[str]) -> Column:
    """A struct of a key that was saved as a tuple's text, each part quoted either way; null where it isn't one. It is matched, never evaluated."""
    part = r"""(?:'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)")"""
    pattern = r"(?s)^\(" + ", ".join([part] * len(names)) + r"\)$"
    plain = lambda i: F.regexp_replace(F.concat(F.regexp_extract(key, pattern, 2 * i + 1), F.regexp_extract(key, pattern, 2 * i + 2)), r"\\(['\"\\])", "$1")
    return F.when(F.regexp_like(key, F.lit(pattern)), F.struct(*[plain(i).alias(n) for i, n in enumerate(names)]))
