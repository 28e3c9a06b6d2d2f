"""Articles from facts: one plan for all people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinquery.plans.facts import FactBase

#: The sentences of an article, for one target and for several.
SENTENCES = {
    "sister": ("The sister of <subject> is", "The sisters of <subject> are"),
    "brother": ("The brother of <subject> is", "The brothers of <subject> are"),
    "mother": ("The mother of <subject> is", None),
    "father": ("The father of <subject> is", None),
    "son": ("The son of <subject> is", "The sons of <subject> are"),
    "daughter": ("The daughter of <subject> is", "The daughters of <subject> are"),
    "wife": ("The wife of <subject> is", None),
    "husband": ("The husband of <subject> is", None),
    "friend": ("The friend of <subject> is", "The friends of <subject> are"),
    "dob": ("The date of birth of <subject> is", None),
    "job": ("The occupation of <subject> is", None),
    "hobby": ("The hobby of <subject> is", None),
    "gender": ("The gender of <subject> is", None),
}
FAMILY = ("sister", "brother", "mother", "father", "son", "daughter", "wife", "husband")
ATTRIBUTE = ("dob", "job", "hobby", "gender")
GENDERED = {"sibling": ("sister", "brother"), "parent": ("mother", "father"), "child": ("daughter", "son"), "married": ("wife", "husband")}
SECTIONS = {**dict.fromkeys(FAMILY, 1), "friend": 2, **dict.fromkeys(ATTRIBUTE, 3)}


def sentences(facts: FactBase) -> DataFrame:
    """name, section, place, sentence, facts: one row a person and predicate that has targets.

    Targets stand in clause order, relations' once each, attributes' as often as they were stated.
    A predicate without a plural sentence keeps the singular one.
    """
    place = {name: i for i, name in enumerate(SENTENCES)}
    gender = facts.frame("gender").select(F.col("x").alias("y"), F.col("y").alias("g")).distinct()
    parts = []
    for base, (female, male) in GENDERED.items():  # one plan for both genders of a relation
        rows = facts.plans.get(base, "ordered").join(gender, "y")
        pred = F.when(F.col("g") == "female", female).when(F.col("g") == "male", male)
        parts.append(rows.select("x", "y", "key", pred.alias("pred")).where("pred is not null"))
    parts.append(facts.plans.get("friend", "ordered").select("x", "y", "key", F.lit("friend").alias("pred")))
    stated = facts.facts.where(F.col("pred").isin(*ATTRIBUTE))
    parts.append(stated.select("x", "y", F.array("ord").alias("key"), "pred"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    grouped = every.groupBy("x", "pred").agg(F.array_sort(F.collect_list(F.struct("key", "y"))).alias("targets"))
    names = F.transform("targets", lambda t: t["y"])
    word = lambda values: F.element_at(F.create_map(*(F.lit(v) for kv in values.items() for v in kv)), F.col("pred"))
    one, more = word({p: o for p, (o, _) in SENTENCES.items()}), word({p: m or o for p, (o, m) in SENTENCES.items()})
    head = F.replace(F.when(F.size("targets") > 1, more).otherwise(one), F.lit("<subject>"), F.col("x"))
    clauses = F.transform(names, lambda y: F.concat("pred", F.lit('("'), "x", F.lit('", "'), y, F.lit('").')))
    return grouped.select(F.col("x").alias("name"), word(SECTIONS).alias("section"), word(place).alias("place"), F.concat(head, F.lit(" "), F.array_join(names, ", "), F.lit(".")).alias("sentence"), clauses.alias("facts"))


def articles(facts: FactBase, names: DataFrame | None = None) -> DataFrame:
    """title, article, facts of every person (or of ``names(name)``), in four parts."""
    people = names if names is not None else facts.person_names()
    per = sentences(facts).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("section", "place", "sentence", "facts"))).alias("s"))
    have = people.select("name").join(per, "name", "left")
    rows = F.coalesce(F.col("s"), F.array().cast(per.schema["s"].dataType))

    def part(k: int):
        return F.array_join(F.transform(F.filter(rows, lambda r: r["section"] == k), lambda r: r["sentence"]), "\n")

    text = F.concat(F.lit("# "), F.col("name"), F.lit("\n\n## Family\n"), part(1), F.lit("\n\n## Friends\n"), part(2), F.lit("\n\n## Attributes\n"), part(3), F.lit("\n"))
    return have.select(F.col("name").alias("title"), text.alias("article"), F.flatten(F.transform(rows, lambda r: r["facts"])).alias("facts"))
