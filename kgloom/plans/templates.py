"""Prompt templates: values are put in after the JSON is parsed, so line ends in values can't break it."""

from __future__ import annotations

import json

#: The sections whose texts take values, and the values that each takes.
SECTIONS = {
    "Generate_kg": ("purposes", "an_example", "more_examples", "entity_types", "entity_list", "relation_list"),
    "Filter_entity": ("entity_types",),
    "Deduplicate_and_Prune_kg": ("purposes",),
    "Evaluate_kg": (),
}


def family(model: str) -> str:
    """The family of an expander's name, such as mistral of mistral-7b; none and base have no texts of their own."""
    name = model.split("-")[0]
    if name not in ("none", "base", "llama", "mistral"):
        raise ValueError(f"no expander {model!r}")
    return "" if name in ("none", "base") else f"_{name}"


def fill(node, values: dict[str, str]):
    """A JSON value with {{ name }} and {{ name | safe }} replaced by values, whose double quotes are deleted."""
    if isinstance(node, dict):
        return {k: fill(v, values) for k, v in node.items()}
    if isinstance(node, list):
        return [fill(v, values) for v in node]
    if not isinstance(node, str):
        return node
    out, rest = [], node
    while "{{" in rest:
        before, _, rest = rest.partition("{{")
        inside, closed, rest = rest.partition("}}")
        name = inside.strip().replace("|", ".").split(".")[0].strip()
        out += [before, values[name].replace('"', "") if closed and name in values else "{{" + inside + closed]
    return "".join(out) + rest


def criteria(document: str, values: dict[str, str]) -> dict:
    """All sections, rendered; a missing section or an empty value is an error."""
    parsed = json.loads(document)
    out = {}
    for section, names in SECTIONS.items():
        if section not in parsed:
            raise KeyError(f"no section {section}")
        empty = [n for n in names if not values.get(n)]
        if empty:
            raise ValueError(f"{section} needs {', '.join(empty)}")
        out[section] = fill(parsed[section], {n: values[n] for n in names})
    return out
