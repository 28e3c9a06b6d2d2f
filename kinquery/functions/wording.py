"""Words for relations and attributes in questions."""

from __future__ import annotations

#: attributes' names in questions, and plurals that don't just take an s.
ATTRIBUTE_ALIAS = {"dob": "date of birth", "job": "occupation", "hobby": "hobby", "gender": "gender"}
IRREGULAR = {"child": "children", "wife": "wives"}


def alias(relation: str) -> str:
    """great_aunt: great-aunt; mother_in_law: mother-in-law; other underscores are spaces."""
    if relation.endswith("_in_law"):
        return relation.replace("_", "-")
    return relation.replace("great_", "great-", 1).replace("_", " ") if relation.startswith("great_") else relation.replace("_", " ")


def plural(relation: str) -> str:
    """The plural of the word that names the person."""
    text = alias(relation)
    for tail in ("-in-law", " once removed"):
        if text.endswith(tail):
            return text.removesuffix(tail) + "s" + tail
    for one, more in IRREGULAR.items():
        if text.endswith(one):
            return text.removesuffix(one) + more
    return text + "s"


def question_words() -> dict[str, str]:
    from kinquery.plans.relations import ASKABLE

    return {r: alias(r) for r in ASKABLE}


def plural_words() -> dict[str, str]:
    from kinquery.plans.relations import ASKABLE

    return {r: plural(r) for r in ASKABLE}
