"""Kinship relations as a small algebra over edge tables, compiled to joins.

A relation is written in a line: names joined by ``.`` are walked one after the other, ``~name`` is
walked backwards, ``/f`` and ``/m`` keep targets of a gender, ``!`` keeps pairs of two different
people, and ``a + b`` takes both. Rules don't recur, so every relation unfolds to base edges.

Relations are evaluated in one of three modes. ``counted``: (x, y, mult), with the number of
derivations; joins multiply it, and projection adds it up (the bag semiring), so a second cousin
costs a row a pair and not a row a derivation. ``set``: (x, y) distinct after each step. ``ordered``:
(x, y, key), with the array of the base rows' places of the first derivation, for texts that list
targets in clause order.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Each relation, with the weight it has in a question's difficulty.
RELATIONS: dict[str, tuple[str, int | None]] = {
    "sibling": ("parent.~parent!", 1),
    "married": ("~parent.parent!", None),
    "sister": ("sibling/f", 1),
    "brother": ("sibling/m", 1),
    "mother": ("parent/f", 1),
    "father": ("parent/m", 1),
    "child": ("~parent", 1),
    "son": ("child/m", 1),
    "daughter": ("child/f", 1),
    "wife": ("married/f", 1),
    "husband": ("married/m", 1),
    "niece": ("sibling.daughter", 2),
    "nephew": ("sibling.son", 2),
    "grandparent": ("parent.parent", 2),
    "grandmother": ("grandparent/f", 2),
    "grandfather": ("grandparent/m", 2),
    "great_aunt": ("grandparent.sister", 3),
    "great_uncle": ("grandparent.brother", 3),
    "grandchild": ("~grandparent", 2),
    "granddaughter": ("grandchild/f", 2),
    "grandson": ("grandchild/m", 2),
    "great_grandparent": ("grandparent.parent", 3),
    "great_grandmother": ("great_grandparent/f", 3),
    "great_grandfather": ("great_grandparent/m", 3),
    "great_grandchild": ("~great_grandparent", 3),
    "great_granddaughter": ("great_grandchild/f", 3),
    "great_grandson": ("great_grandchild/m", 3),
    "second_aunt": ("great_grandparent.sister", 4),
    "second_uncle": ("great_grandparent.brother", 4),
    "aunt": ("parent.sister", 2),
    "uncle": ("parent.brother", 2),
    "cousin": ("parent.sibling.~parent!", 3),
    "female_cousin": ("cousin/f", 3),
    "male_cousin": ("cousin/m", 3),
    "female_second_cousin": ("parent.cousin.~parent!/f", 5),
    "male_second_cousin": ("parent.cousin.~parent!/m", 5),
    "female_first_cousin_once_removed": ("cousin.daughter!", 4),
    "male_first_cousin_once_removed": ("cousin.son!", 4),
    "mother_in_law": ("married.mother", 2),
    "father_in_law": ("married.father", 2),
    "son_in_law": ("child.husband", 2),
    "daughter_in_law": ("child.wife", 2),
    "sister_in_law": ("married.sister", 2),
    "brother_in_law": ("married.brother", 2),
    "friend": ("friend_+~friend_", 1),
}
PARENT_WEIGHT = 1
ATTRIBUTES = ("dob", "job", "hobby")
#: What a sampled question may ask for.
ASKABLE = ("parent", *(r for r, (_, w) in RELATIONS.items() if w is not None))
EASY = ("parent", *(r for r, (_, w) in RELATIONS.items() if w == 1 and r != "friend"), "friend")
GENDERS = {"f": "female", "m": "male"}
MODES = ("counted", "set", "ordered")


def program() -> str:
    """The relations as clauses of rules."""
    clauses = []
    for name, (line, _) in RELATIONS.items():
        for path in line.split("+"):
            path, _, gender = path.partition("/")
            steps = path.rstrip("!").split(".")
            at = ["X", *(f"V{i}" for i in range(1, len(steps))), "Y"]
            goals = [f"{s[1:]}({at[i + 1]}, {at[i]})" if s.startswith("~") else f"{s}({at[i]}, {at[i + 1]})" for i, s in enumerate(steps)]
            goals += ["X \\= Y"] * path.endswith("!") + ([f"{GENDERS[gender]}(Y)"] if gender else [])
            clauses.append(f"{name}(X, Y) :-\n    " + ",\n    ".join(goals) + ".\n")
    return "\n".join(clauses)


def weight(predicate: str) -> int:
    """A predicate's part of a question's difficulty."""
    if predicate in ("parent", *ATTRIBUTES, "aggregate_all"):
        return 1
    return RELATIONS.get(predicate, ("", 0))[1] or 0


def _alike(rows: DataFrame, bag: bool) -> DataFrame:
    if not bag:
        return rows.distinct()
    return rows.groupBy(*(c for c in rows.columns if c != "__mult")).agg(F.sum("__mult").alias("__mult"))


class RelationPlans:
    """Plans of all relations over ``base`` edges (x, y, ord) and ``gender`` (x, y)."""

    def __init__(self, base: dict[str, DataFrame], gender: DataFrame | None = None):
        self.base, self.gender = base, gender
        self._done: dict[tuple[str, str], DataFrame] = {}
        self._names = itertools.count()

    def get(self, name: str, mode: str = "set") -> DataFrame:
        if mode not in MODES:
            raise ValueError(f"no mode {mode}")
        if (name, mode) not in self._done:
            if name in self.base:
                self._done[name, mode] = self._edges(self.base[name], mode)
            elif name in RELATIONS:
                self._done[name, mode] = self._compile(RELATIONS[name][0], mode)
            else:
                raise KeyError(f"unknown predicate {name}")
        return self._done[name, mode]

    def pin(self, *names: str, mode: str = "set") -> RelationPlans:
        """Keep relations that many others unfold to in memory, spilling to disk."""
        from pyspark import StorageLevel

        for name in names:
            self._done[name, mode] = self.get(name, mode).persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def extend(self, state: DataFrame, at: str, name: str, out: str, bag: bool = False, back: bool = False) -> DataFrame:
        """Each row of ``state`` with every target of ``name`` from its column ``at`` as ``out``.

        ``back``: every source that has ``at`` for its target. Relations unfold to their base edges, one
        join a step, so rows are those reached from the state; rows alike become one after each step,
        or add up their ``__mult`` if ``bag``.
        """
        if name in self.base:
            edges = self.get(name, "counted" if bag else "set")
            near, far = ("y", "x") if back else ("x", "y")
            pairs = edges.select(F.col(near).alias("__near"), F.col(far).alias(out), *([F.col("mult").alias("__m")] if bag else []))
            found = state.join(pairs, F.col(at) == F.col("__near")).drop("__near")
            return found.withColumn("__mult", F.col("__mult") * F.col("__m")).drop("__m") if bag else found
        if name not in RELATIONS:
            raise KeyError(f"unknown predicate {name}")
        clauses = [self._extend_path(state, at, line, out, bag, back) for line in RELATIONS[name][0].split("+")]
        found = clauses[0]
        for c in clauses[1:]:
            found = found.unionByName(c)
        return _alike(found, bag) if len(clauses) > 1 else found

    def _extend_path(self, state: DataFrame, at: str, line: str, out: str, bag: bool, back: bool) -> DataFrame:
        path, _, gender = line.partition("/")
        apart, steps = path.endswith("!"), path.rstrip("!").split(".")
        if back:
            steps = [s[1:] if s.startswith("~") else f"~{s}" for s in reversed(steps)]
        if gender and back:
            state = state.join(self._people(gender, at), at, "left_semi").select(state.columns)
        here = at
        for i, step in enumerate(steps):
            to = out if i == len(steps) - 1 else f"__step{next(self._names)}"
            state = self.extend(state, here, step.lstrip("~"), to, bag, step.startswith("~"))
            if here != at:
                state = _alike(state.drop(here), bag)
            here = to
        if apart:
            state = state.where(F.col(at) != F.col(out))
        if gender and not back:
            state = state.join(self._people(gender, out), out, "left_semi").select(state.columns)
        return state

    def _people(self, gender: str, name: str) -> DataFrame:
        if self.gender is None:
            raise ValueError("a relation needs genders, and there are none")
        return self.gender.where(F.col("y") == GENDERS[gender]).select(F.col("x").alias(name)).distinct()

    def seeded(self, name: str, seeds: DataFrame, mode: str = "set") -> DataFrame:
        """x, y (and mult when counted) of the pairs whose x is in ``seeds(x)``."""
        start = seeds.select("x").where("x is not null").distinct()
        if mode == "counted":
            return self.extend(start.withColumn("__mult", F.lit(1).cast("long")), "x", name, "y", True).withColumnRenamed("__mult", "mult")
        return self.extend(start, "x", name, "y")

    def pinned_from(self, seeds: DataFrame, mode: str = "set"):
        """``seeded`` for many relations of the same people: what other relations begin with is written once.

        The first step of a path is read from there, and only the rest is walked.
        """
        from kinquery.runtime import stored

        first = [RELATIONS[n][0].partition("/")[0].rstrip("!").split(".")[0] for n in RELATIONS]
        shared = [n for n in RELATIONS if first.count(n) > 1]
        done: dict[str, DataFrame] = {}

        def get(name: str) -> DataFrame:
            if name in done:
                return done[name]
            path, _, gender = RELATIONS[name][0].partition("/") if name in RELATIONS else ("", "", "")
            head, _, rest = path.partition(".")
            begin = head.rstrip("!")
            if begin in shared and "+" not in path:
                found, bag = get(begin), mode == "counted"
                if rest or gender:
                    found = found.withColumnRenamed("mult", "__mult") if bag else found
                    if rest:
                        found = found.withColumnRenamed("y", "__mid")
                        found = _alike(self._extend_path(found, "__mid", rest.rstrip("!"), "y", bag, False).drop("__mid"), bag)
                    if path.endswith("!"):
                        found = found.where("x <> y")
                    if gender:
                        found = found.join(self._people(gender, "y"), "y", "left_semi").select(found.columns)
                    found = found.withColumnRenamed("__mult", "mult") if bag else found
            else:
                found = self.seeded(name, seeds, mode)
            if name in shared:
                done[name] = found = stored(found, f"from-{name}")
            return found

        return get

    def _edges(self, edges: DataFrame, mode: str) -> DataFrame:
        if mode == "counted":
            return edges.groupBy("x", "y").agg(F.count(F.lit(1)).alias("mult"))
        if mode == "set":
            return edges.select("x", "y").distinct()
        return edges.groupBy("x", "y").agg(F.array(F.min("ord")).alias("key"))

    def _reduce(self, pairs: DataFrame, mode: str) -> DataFrame:
        if mode == "counted":
            return pairs.groupBy("x", "y").agg(F.sum("mult").alias("mult"))
        if mode == "set":
            return pairs.select("x", "y").distinct()
        return pairs.groupBy("x", "y").agg(F.min("key").alias("key"))

    def _compile(self, line: str, mode: str) -> DataFrame:
        if "+" in line:
            clauses = [self._compile(part, mode) for part in line.split("+")]
            if mode == "ordered":  # the clause's number comes first
                clauses = [c.withColumn("key", F.concat(F.array(F.lit(i).cast("long")), "key")) for i, c in enumerate(clauses)]
            out = clauses[0]
            for c in clauses[1:]:
                out = out.unionByName(c)
            return self._reduce(out, mode)
        path, _, gender = line.partition("/")
        apart = path.endswith("!")
        steps = path.rstrip("!").split(".")
        out = self._step(steps[0], mode)
        for i, s in enumerate(steps[1:], 2):
            last = i == len(steps)
            out = self._walk(out, self._step(s, mode), mode, apart=apart and last)
        return self._of_gender(out, gender) if gender else out

    def _step(self, step: str, mode: str) -> DataFrame:
        found = self.get(step.lstrip("~"), mode)
        if step.startswith("~"):
            found = found.select(F.col("y").alias("x"), F.col("x").alias("y"), *(c for c in found.columns if c not in ("x", "y")))
        return found

    def _walk(self, left: DataFrame, right: DataFrame, mode: str, apart: bool) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        on = F.col("a.y") == F.col("b.x")
        if apart:
            on = on & (F.col("a.x") != F.col("b.y"))
        more = {"counted": [(F.col("a.mult") * F.col("b.mult")).alias("mult")], "set": [], "ordered": [F.concat("a.key", "b.key").alias("key")]}[mode]
        return self._reduce(a.join(b, on).select(F.col("a.x").alias("x"), F.col("b.y").alias("y"), *more), mode)

    def _of_gender(self, pairs: DataFrame, gender: str) -> DataFrame:
        return pairs.join(self._people(gender, "y"), "y", "left_semi").select(pairs.columns)
