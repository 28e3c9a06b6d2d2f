"""Question templates of a depth.

A question is a chain: it starts with one of three heads, goes over relations, and ends at a name or
at an attribute's value. The grammar's depth limit means that a token that stands ``level`` levels
down is there only below the depth, and levels number the placeholders and variables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

#: The placeholders.
RELATION, PLURAL, NAME, ATTRIBUTE, VALUE = "<relation>", "<relation_plural>", "<name>", "<attribute_name>", "<attribute_value>"


@dataclass(frozen=True)
class Template:
    question: tuple[str, ...]
    goals: tuple[str, ...]
    answer: str


def _people(level: int, depth: int) -> Iterator[Template]:
    """Ways to name one person by a phrase at this level: a relation of somebody, or an attribute's value."""
    var, inner = f"Y_{level + 1}", level + 2
    if inner >= depth:  # the phrase's placeholders would lie too deep
        return
    relation = f"{RELATION}_{inner}"
    for tokens, goals, who in _ends(level + 2, depth):
        yield Template(("the", relation, "of", *tokens), (f"{relation}({who}, {var})", *goals), var)
    name, value = f"{ATTRIBUTE}_{inner}", f"{VALUE}_{inner}"
    yield Template(("the person whose", name, "is", value), (f"{name}({var}, {value})",), var)


def _ends(level: int, depth: int) -> Iterator[tuple[tuple[str, ...], tuple[str, ...], str]]:
    """What a relation is of: another phrase, or a name."""
    for p in _people(level, depth):
        yield p.question, p.goals, p.answer
    if level + 1 < depth:
        name = f"{NAME}_{level + 1}"
        yield (name,), (), name


def templates(depth: int = 4) -> list[Template]:
    """All templates of a depth: six more for every two levels, from 8 at depth 6 to 50 at depth 20."""
    out = [Template(("Who is", *p.question, "?"), p.goals, p.answer) for p in _people(1, depth)]
    attribute = f"{ATTRIBUTE}_3"
    if depth > 3:
        out += [Template(("What is", "the", attribute, "of", *p.question, "?"), (f"{attribute}({p.answer}, Y_2)", *p.goals), "Y_2") for p in _people(2, depth)]
    plural = f"{PLURAL}_2"
    out += [Template(("How many", plural, "does", *tokens, "have", "?"), (f"aggregate_all(count, distinct({plural}({who}, Y_1)), Count_1)", *goals), "Count_1") for tokens, goals, who in _ends(2, depth)]
    return out


def is_aggregation_question(question: str) -> bool:
    return question.strip().startswith("How many")
