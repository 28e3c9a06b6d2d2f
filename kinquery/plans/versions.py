"""A fact base with its history: appended facts and retractions, read as of any change.

Changes are kept as they come, each with a number: an append is a run of rows, a retraction a
pattern. Reading merges them: a row is there at a version if it was appended by then and no later
pattern up to then fits it. All appended rows are one relation and all patterns another, small enough to be
broadcast (changes are a program's text), so a read is one union and one anti-join however many
changes there were. ``compact`` writes the facts of a version as the new base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinquery.functions.clauses import is_fact, parse_clause
from kinquery.functions.goals import Atom, Const, Var, parse_goal
from kinquery.plans.facts import SCHEMA, FactBase
from kinquery.runtime import stored

#: Changes that are kept beside the base; more are an error that asks for compact().
MOST_CHANGES = 100_000


class FactLog:
    def __init__(self, spark: SparkSession, base: DataFrame | None = None, rules: list | None = None):
        self.spark, self.rules = spark, list(rules or [])
        self.base = base if base is not None else spark.createDataFrame([], SCHEMA)
        self.first, self.version = 0, 0
        self._next = self.base.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] + 1  # once; later places follow
        self._rows: list[tuple] = []
        self._patterns: list[tuple] = []

    def _change(self) -> int:
        if len(self._rows) + len(self._patterns) >= MOST_CHANGES:
            raise ValueError("too many changes beside the base: compact() first")
        self.version += 1
        return self.version

    def add(self, *facts: str) -> int:
        """Append ground facts; the number of the change."""
        found = []
        for text in facts:
            rules = parse_clause(text.strip().removesuffix("."))
            if not isinstance(rules, list) or len(rules) != 1 or not is_fact(rules[0]) or len(rules[0].head.args) not in (1, 2):
                raise ValueError(f"not a ground fact: {text}")
            found.append(rules[0].head)
        at = self._change()
        for head in found:
            values = [a.value for a in head.args]
            self._rows.append((head.predicate, values[0], values[1] if len(values) == 2 else None, self._next, at))
            self._next += 1
        return at

    def remove(self, *patterns: str) -> int:
        """Retract every fact that fits a pattern: variables stand for anything, one twice for the same."""
        found = []
        for text in patterns:
            atom = parse_goal(text)
            if not isinstance(atom, Atom) or len(atom.args) not in (1, 2):
                raise ValueError(f"not a pattern: {text}")
            x, y = (a.value if isinstance(a, Const) else None for a in (*atom.args, *[Var("_")][: 2 - len(atom.args)]))
            names = [a.name for a in atom.args if isinstance(a, Var)]
            found.append((atom.predicate, x, y, len(atom.args) == 2, len(names) == 2 and names[0] == names[1] != "_"))
        at = self._change()
        self._patterns += [(*p, at) for p in found]
        return at

    def frame(self, version: int | None = None) -> DataFrame:
        """pred, x, y, ord of the facts as of a change (the last, if not given)."""
        version = self.version if version is None else version
        if not self.first <= version <= self.version:
            raise ValueError(f"versions {self.first} to {self.version} are there")
        added = self.spark.createDataFrame([r for r in self._rows if r[4] <= version], f"{SCHEMA}, at long")
        every = self.base.select("pred", "x", "y", "ord", F.lit(self.first).cast("long").alias("at")).unionByName(added)
        gone = self.spark.createDataFrame([p for p in self._patterns if p[5] <= version], "p string, px string, py string, two boolean, same boolean, until long")
        fits = (F.col("pred") == F.col("p")) & (F.col("until") > F.col("at")) & (F.col("y").isNotNull() == F.col("two"))
        fits = fits & (F.col("px").isNull() | (F.col("px") == F.col("x"))) & (F.col("py").isNull() | (F.col("py") == F.col("y"))) & (~F.col("same") | (F.col("x") == F.col("y")))
        return every.join(F.broadcast(gone), fits, "left_anti").select("pred", "x", "y", "ord")  # at most MOST_CHANGES patterns

    def at(self, version: int | None = None) -> FactBase:
        """The fact base as of a change."""
        return FactBase(self.spark, self.frame(version), {r[0]: 1 if r[2] is None else 2 for r in self._rows}, self.rules)

    def compact(self) -> FactLog:
        """Write the facts as they are now as the base; earlier versions can't be read any more."""
        self.base = stored(self.frame(), "facts")
        self.first, self._rows, self._patterns = self.version, [], []
        return self
