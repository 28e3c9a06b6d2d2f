"""A fact base: ground facts in one table (pred, x, y, ord), rules on top.

``ord`` is the order facts were added in. Facts are a bag: a fact added twice is there twice.
Facts of one argument have a null ``y``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinquery.functions.clauses import Directive, Rule, cut, is_fact, parse_clause, rule_text
from kinquery.functions.goals import Atom, Const, Var, parse_goal
from kinquery.plans.compiler import answers, evaluate
from kinquery.plans.relations import RELATIONS, RelationPlans
from kinquery.plans.rules import RulePlans

SCHEMA = "pred string, x string, y string, ord long"
#: Unary rules, each a gender.
UNARY = ("female", "male", "nonbinary")
#: Rows of a parameter frame whose goals are walked from the people asked about.
FEW = 10_000


class FactBase:
    def __init__(self, spark: SparkSession, facts: DataFrame | None = None, arities: dict[str, int] | None = None, rules: list[tuple[int, Rule]] | None = None):
        self.spark, self.rules = spark, list(rules or [])
        self.facts = facts if facts is not None else spark.createDataFrame([], SCHEMA)
        self.arities = dict(arities or {})
        self._plans: RelationPlans | None = None
        self._rules: RulePlans | None = None
        self._known_kinds: set[tuple[str, int]] | None = None

    @classmethod
    def of_frames(cls, spark: SparkSession, frames: dict[str, DataFrame]) -> FactBase:
        """From (x, y) or (x, y, ord) frames by predicate; without ord, rows count as in no order."""
        parts = []
        for name, df in frames.items():
            order = F.col("ord").cast("long") if "ord" in df.columns else F.lit(0).cast("long")
            y = F.col("y").cast("string") if "y" in df.columns else F.lit(None).cast("string")
            parts.append(df.select(F.lit(name).alias("pred"), F.col("x").cast("string").alias("x"), y.alias("y"), order.alias("ord")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return cls(spark, out, {n: 2 if "y" in d.columns else 1 for n, d in frames.items()})

    # changes: each gives a fact base of its own, the old one stays as it is

    def _with(self, facts: DataFrame, arities: dict[str, int] | None = None) -> FactBase:
        return FactBase(self.spark, facts, {**self.arities, **(arities or {})}, self.rules)

    def add(self, *facts: str) -> FactBase:
        """Append ground facts, duplicates kept."""
        rows, arities = [], {}
        for i, text in enumerate(facts):
            atom = parse_goal(text)
            if not isinstance(atom, Atom) or not all(isinstance(a, Const) for a in atom.args) or len(atom.args) not in (1, 2):
                raise ValueError(f"not a ground fact: {text}")
            rows.append((atom.predicate, atom.args[0].value, atom.args[1].value if len(atom.args) == 2 else None, i))
            arities[atom.predicate] = len(atom.args)
        last = self.facts.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
        new = self.spark.createDataFrame(rows, SCHEMA).crossJoin(F.broadcast(last)).select("pred", "x", "y", (F.col("ord") + F.col("last") + 1).alias("ord"))
        return self._with(self.facts.unionByName(new), arities)

    def add_frame(self, pred: str, rows: DataFrame) -> FactBase:
        """Append rows (x, y, ord) as facts of one predicate."""
        more = rows.select(F.lit(pred).alias("pred"), F.col("x").cast("string").alias("x"), F.col("y").cast("string").alias("y"), F.col("ord").cast("long").alias("ord"))
        return self._with(self.facts.unionByName(more), {pred: 2})

    def remove(self, *patterns: str) -> FactBase:
        """Retract every fact that unifies with a pattern; a variable stands for anything, twice for the same."""
        out = self.facts
        for text in patterns:
            atom = parse_goal(text)
            hit = F.col("pred") == atom.predicate
            hit = hit & (F.col("y").isNotNull() if len(atom.args) == 2 else F.col("y").isNull())
            for col, arg in zip(("x", "y"), atom.args, strict=False):
                if isinstance(arg, Const):
                    hit = hit & (F.col(col) == arg.value)
            names = [a.name for a in atom.args if isinstance(a, Var)]
            if len(names) == 2 and names[0] == names[1] != "_":
                hit = hit & (F.col("x") == F.col("y"))
            out = out.where(~F.coalesce(hit, F.lit(False)))
        return self._with(out)

    def define(self, *signatures: str) -> FactBase:
        """Declare predicates ('p/2') without facts."""
        return self._with(self.facts, {s.rpartition("/")[0]: int(s.rpartition("/")[2]) for s in signatures})

    def consult(self, *paths: str, strict: bool = True) -> FactBase:
        """Append the facts and rules of text files, in their order.

        Rules for a name replace the built-in relation of that name. Clauses that can't be read are an
        error that names them; without ``strict`` they are left out, and ``read_clauses`` lists them.
        """
        from kinquery.sources.fact_files import read_clauses

        found = read_clauses(self.spark, *paths)
        if strict and (bad := found.problems.orderBy("ord").limit(5).collect()):
            raise ValueError("; ".join(f"{r['error']}: {r['clause'][:200]}" for r in bad))
        last = max(self.facts.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0], max((o for o, _ in self.rules), default=-1))
        more = found.facts.select("pred", "x", "y", (F.col("ord") + F.lit(last + 1)).alias("ord"))
        rules = [*self.rules, *((o + last + 1, r) for o, r in found.rules)]
        return FactBase(self.spark, self.facts.unionByName(more), self.arities, rules)

    def with_rules(self, text: str) -> FactBase:
        """Append the rules of a program's text; clauses that aren't rules are an error."""
        clauses, is_open = cut(text)
        found = [r for c in clauses if not isinstance(rs := parse_clause(c), Directive) for r in rs]
        if is_open or any(is_fact(r) for r in found):
            raise ValueError("not a text of rules")
        last = max((o for o, _ in self.rules), default=-1)
        return FactBase(self.spark, self.facts, self.arities, [*self.rules, *((last + 1 + i, r) for i, r in enumerate(found))])

    @classmethod
    def from_disk(cls, spark: SparkSession, path: str) -> FactBase:
        return cls(spark).consult(path)

    def save(self, path: str, text: bool = True) -> None:
        """Facts, and with ``text`` rules among them, in order."""
        from kinquery.sources.fact_files import write_facts

        rules = self.spark.createDataFrame([(o, rule_text(r)) for o, r in self.rules], "ord long, clause string") if self.rules else None
        write_facts(self.facts, path, text, rules)

    def cache(self) -> FactBase:
        self.facts = self.facts.persist()
        self._plans = self._rules = None
        return self

    # reading

    def frame(self, pred: str) -> DataFrame:
        """The facts of one predicate as they are: x, y, ord."""
        return self.facts.where(F.col("pred") == pred).select("x", "y", "ord")

    def person_names(self) -> DataFrame:
        return self.frame("type").where("y = 'person'").orderBy("ord").select(F.col("x").alias("name"))

    def attribute_values(self) -> DataFrame:
        """A row a fact, duplicates kept; none where no attribute was ever declared."""
        return self.frame("attribute").orderBy("ord").select(F.col("x").alias("value"))

    @property
    def plans(self) -> RelationPlans:
        if self._plans is None:
            base = {p: self.frame(p) for p in ("parent", "friend_")}
            self._plans = RelationPlans(base, self.frame("gender"))
        return self._plans

    def relation(self, name: str, arity: int = 2, mode: str = "set") -> DataFrame:
        """Rows of a fact or rule: x, y (or x), and mult when counted."""
        return self.rule_plans.get(name, arity, mode) if self.rules else self._stated(name, arity, mode)

    @property
    def rule_plans(self) -> RulePlans:
        """Plans of the consulted rules, over the facts and the built-in relations."""
        if self._rules is None:
            self._rules = RulePlans([r for _, r in self.rules], self._stated, self._facts_beside)
        return self._rules

    def _facts_beside(self, name: str, arity: int) -> DataFrame | None:
        """Facts of a predicate that has rules as well; None where there are none."""
        if (name, arity) not in self._kinds():
            return None
        rows = self.frame(name).where("y is null" if arity == 1 else "y is not null")
        return rows.select(*["x", "y"][:arity]) if arity in (1, 2) else None

    def _kinds(self) -> set[tuple[str, int]]:
        """Predicates and arities of the facts, found once."""
        if self._known_kinds is None:
            found = self.facts.select("pred", F.when(F.col("y").isNull(), 1).otherwise(2).alias("n")).distinct()
            self._known_kinds = {(r["pred"], r["n"]) for r in found.collect()}  # a row a predicate
        return self._known_kinds

    def can_extend(self, name: str) -> bool:
        return name in RELATIONS or name in ("parent", "friend_") if not any(r.key[0] == name for _, r in self.rules) else False

    def extend(self, state: DataFrame, at: str, name: str, out: str, bag: bool = False, back: bool = False) -> DataFrame:
        return self.plans.extend(state, at, name, out, bag, back)

    def _stated(self, name: str, arity: int = 2, mode: str = "set") -> DataFrame:
        if name in UNARY and arity == 1:
            rows = self.frame("gender").where(F.col("y") == name).select("x")
        elif name in RELATIONS or name in ("parent", "friend_"):
            return self.plans.get(name, mode)
        elif arity == 1:
            self._known(name)
            rows = self.frame(name).where("y is null").select("x")
        else:
            self._known(name)
            rows = self.frame(name).where("y is not null").select("x", "y")
        if mode == "counted":
            return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("mult"))
        return rows.distinct()

    def _known(self, name: str) -> None:
        if name in self.arities or name in ("gender", "type", "dob", "job", "hobby", "attribute"):
            return
        if not self.facts.where(F.col("pred") == name).limit(1).count():
            raise KeyError(f"unknown predicate {name}")

    def nodes(self) -> DataFrame:
        """name, colour: people for a graph, coloured by gender."""
        gender = self.frame("gender").groupBy("x").agg(F.min_by("y", "ord").alias("g"))
        colour = F.when(F.col("g") == "female", "pink").when(F.col("g") == "male", "lightblue").otherwise("grey")
        return self.person_names().join(gender.withColumnRenamed("x", "name"), "name", "left").select("name", colour.alias("colour"))

    def edges(self, pred: str = "parent") -> DataFrame:
        """source, target: parents to children, or friends as they were stated."""
        rows = self.frame(pred)
        return rows.select(F.col("y").alias("source"), F.col("x").alias("target")) if pred == "parent" else rows.select(F.col("x").alias("source"), F.col("y").alias("target"))

    def query(self, goals: list[str] | str, bag: bool = False) -> DataFrame:
        return evaluate(self, goals, bag=bag)

    def answer(self, goals: list[str], answer: str, params: DataFrame | None = None, by: list[str] | None = None, few: bool | None = None) -> DataFrame:
        """Sorted answers of a question whose goals are given outermost first, as templates have them.

        The goals run from the last to the first, so that counts come after what they count for.
        With a parameter frame every row of it (its ``by`` columns) is a question of the same shape.
        ``few``: whether goals are walked from the people asked about, or whole relations are derived;
        by itself, frames of up to ``FEW`` rows are walked. The answers are the same.
        """
        if params is None:
            params, by, few = self.spark.range(1).select(F.lit(0).alias("__q")), ["__q"], True
        if few is None:
            few = params.limit(FEW + 1).count() <= FEW
        bound = evaluate(self, list(reversed(goals)), params, keep={*by, answer}, few=few)
        found = answers(bound, answer, by)
        return found.drop("__q")
