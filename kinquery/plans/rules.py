"""Rules given as clauses, compiled to joins.

A predicate's rows are its facts and what its rules derive. Rules that don't come back to their own
predicate unfold to joins of their goals; variables no later goal and not the head needs are
projected away after each join, which adds their derivations up (``counted``) or makes rows
distinct (``set``). Predicates that several rules stand on can be ``tabled``: written once, read by all.

Predicates that come back to themselves, directly or through each other, are derived in rounds
(semi-naive): a round joins only what the last one found new, takes off what is known, and is
written, so the plan of a round doesn't grow with the rounds. Known rows are put together in one
table every ``MERGE`` rounds. Rounds end when nothing new is found. A predicate whose only rule that
comes back is p(X, Y) :- p(X, Z), p(Z, Y) is the closure of its other rows: new rows are then joined with
those only, as all splits of a path give the same row, for ``CLOSURE_ROWS`` first rows at once, since
rows of different X never meet. Such predicates have no counts,
as their derivations may be endless. ``\\+`` and counts must not lead back to their own predicate.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinquery.functions.clauses import Compare, Not, Rule
from kinquery.functions.goals import Atom, Const, CountDistinct, Var
from kinquery.plans.compiler import MULT, evaluate
from kinquery.runtime import drop_scratch, scratch_mark, stored

Key = tuple[str, int]
MERGE = 8
CLOSURE_ROWS = 2_000_000


def columns(arity: int) -> list[str]:
    return ["x", "y"][:arity] + [f"a{i}" for i in range(3, arity + 1)]


def _atoms(rule: Rule) -> list[tuple[Atom, bool]]:
    """The atoms a rule stands on, and whether through a negation or count."""
    return [(g.atom, True) if isinstance(g, Not | CountDistinct) else (g, False) for g in rule.body if not isinstance(g, Compare)]


def _variables(goal) -> set[str]:
    if isinstance(goal, Compare):
        args: tuple = (goal.left, goal.right)
    else:
        args = goal.atom.args if isinstance(goal, Not | CountDistinct) else goal.args
    found = {a.name for a in args if isinstance(a, Var) and a.name != "_"}
    return found | {goal.out.name} if isinstance(goal, CountDistinct) else found


def ordered(body: tuple, first: int | None = None) -> list[int]:
    """Places of the goals, ``first`` to begin with and then one that shares a variable where there is one.

    Comparisons and negations stand as soon as their variables are bound; with a count, goals stay as they are.
    """
    if any(isinstance(g, CountDistinct) for g in body):
        return list(range(len(body)))
    left, order, bound = list(range(len(body))), [], set()
    private = {v for v in set().union(*map(_variables, body), set()) if sum(v in _variables(g) for g in body) == 1}

    def take(i: int) -> None:
        left.remove(i)
        order.append(i)
        if isinstance(body[i], Atom) or (isinstance(body[i], Compare) and body[i].same):
            bound.update(_variables(body[i]))

    if first is not None:
        take(first)
    while left:
        tests = [i for i in left if not isinstance(body[i], Atom) and _variables(body[i]) - (private if isinstance(body[i], Not) else set()) <= bound]
        joins = [i for i in left if isinstance(body[i], Atom)]
        near = [i for i in joins if _variables(body[i]) & bound or not order]
        take((tests or near or joins or left)[0])
    return order


class RulePlans:
    """Plans of the predicates of ``rules``; ``base(name, arity, mode)`` gives what isn't derived, or raises KeyError."""

    def __init__(self, rules: list[Rule], base: Callable[[str, int, str], DataFrame], facts: Callable[[str, int], DataFrame | None]):
        self.rules: dict[Key, list[Rule]] = {}
        for r in rules:
            self.rules.setdefault(r.key, []).append(r)
        self.base, self.facts = base, facts
        self._done: dict[tuple[Key, str], DataFrame] = {}
        self._groups = self._components()

    def _components(self) -> dict[Key, frozenset[Key]]:
        """By predicate, those it leads to that lead back to it; empty if it doesn't come back."""
        to = {k: {(a.predicate, len(a.args)) for r in rs for a, _ in _atoms(r)} & set(self.rules) for k, rs in self.rules.items()}
        reach = {}
        for k in to:
            seen, todo = set(), list(to[k])
            while todo:
                n = todo.pop()
                if n not in seen:
                    seen.add(n)
                    todo += to[n]
            reach[k] = seen
        groups = {k: frozenset(n for n in reach[k] if k in reach[n]) for k in to}
        for k, rs in self.rules.items():
            for r in rs:
                for a, strict in _atoms(r):
                    if strict and (a.predicate, len(a.args)) in groups[k]:
                        raise ValueError(f"{k[0]} stands on the negation or count of what it derives")
        return groups

    def shared(self, least: int = 2) -> list[Key]:
        """Derived predicates that ``least`` other predicates stand on directly, those they stand on first."""
        users: dict[Key, set[Key]] = {}
        for k, rs in self.rules.items():
            for r in rs:
                for a, _ in _atoms(r):
                    users.setdefault((a.predicate, len(a.args)), set()).add(k)
        found, order = {k for k in self.rules if len(users.get(k, set()) - {k}) >= least}, []

        def visit(k: Key, seen: tuple[Key, ...] = ()) -> None:
            if k in seen or k not in self.rules:
                return
            for r in self.rules[k]:
                for a, _ in _atoms(r):
                    visit((a.predicate, len(a.args)), (*seen, k))
            if k in found and k not in order:
                order.append(k)

        for k in self.rules:
            visit(k)
        return order

    def table(self, mode: str = "set", least: int = 2) -> RulePlans:
        """Write the rows of predicates that several others stand on, once."""
        for k in self.shared(least):
            if mode == "set" or not self._groups[k]:
                self._done[k, mode] = stored(self.get(*k, mode), f"table-{k[0]}")
        return self

    def get(self, name: str, arity: int, mode: str = "set") -> DataFrame:
        key = (name, arity)
        if key not in self.rules:
            return self.base(name, arity, mode)
        if mode not in ("set", "counted"):
            raise ValueError(f"rules of clauses have no mode {mode}")
        if (key, mode) not in self._done:
            if self._groups[key]:
                if mode == "counted":
                    raise ValueError(f"{name}/{arity} comes back to itself: its derivations aren't counted")
                self._done.update({(k, mode): df for k, df in self._rounds(self._groups[key] | {key}).items()})
            else:
                parts = [self._rule(r, mode) for r in self.rules[key]]
                every = [*self._stated(key, mode), *parts]
                self._done[key, mode] = every[0] if every == parts and len(parts) == 1 else _merged(every, arity, mode)  # bindings differ already
        return self._done[key, mode]

    def _stated(self, key: Key, mode: str) -> list[DataFrame]:
        """Facts of a predicate that has rules as well."""
        rows = self.facts(*key)
        if rows is None:
            return []
        return [rows.select(*columns(key[1]), *([F.lit(1).cast("long").alias("mult")] if mode == "counted" else []))]

    def _rule(self, rule: Rule, mode: str, first: int | None = None, given: dict[int, DataFrame] | None = None) -> DataFrame:
        """Rows of the head; ``given``: rows of goals by place, instead of their predicates' whole ones."""
        bag = mode == "counted"
        names = columns(len(rule.head.args))
        wanted = [a.name for a in rule.head.args if isinstance(a, Var)]
        if not rule.body:
            if wanted:
                raise ValueError(f"{rule.head.predicate} holds for anything: its variables stand in no goal")
            raise ValueError(f"{rule.head.predicate}: a fact is not a rule")
        order = ordered(rule.body, first)
        if loose := set(wanted) - set().union(*(_variables(g) for g in rule.body if not isinstance(g, Not))):
            raise ValueError(f"{rule.head.predicate}: {', '.join(sorted(loose))} stands in no goal")
        rows = {order.index(i): df for i, df in (given or {}).items()}
        bound = evaluate(self, [rule.body[i] for i in order], bag=bag, keep=set(wanted), rows=rows)
        cols = [F.lit(a.value).alias(n) if isinstance(a, Const) else F.col(a.name).cast("string").alias(n) for n, a in zip(names, rule.head.args, strict=True)]
        found = bound.select(*cols, *([F.col(MULT).alias("mult")] if bag else []))
        return found if names else found.limit(1)

    def relation(self, name: str, arity: int, mode: str) -> DataFrame:
        return self.get(name, arity, mode)

    def _rounds(self, group: frozenset[Key] | set[Key]) -> dict[Key, DataFrame]:
        """All rows of predicates that lead to each other."""
        inside = lambda a: isinstance(a, Atom) and (a.predicate, len(a.args)) in group
        first: dict[Key, list[DataFrame]] = {k: self._stated(k, "set") for k in group}
        again: list[tuple[Rule, list[int]]] = []
        for k in group:
            for r in self.rules[k]:
                places = [i for i, g in enumerate(r.body) if inside(g)]
                if places:
                    again.append((r, places))
                else:
                    first[k].append(self._rule(r, "set"))
        news = {k: stored(_merged(parts, k[1], "set"), f"delta-{k[0]}") for k, parts in first.items() if parts}
        if len(group) == 1 and news and len(again) == 1 and _is_transitive(again[0][0]):
            return {k: self._closure(again[0][0], base) for k, base in news.items()}
        known: dict[Key, list[DataFrame]] = {k: [df] for k, df in news.items()}
        news = {k: df for k, df in news.items() if not df.isEmpty()}
        rounds = 0
        while news:
            rounds += 1
            total = {k: reduce(DataFrame.unionByName, parts) for k, parts in known.items()}
            parts: dict[Key, list[DataFrame]] = {}
            for r, places in again:
                for i in places:
                    new = news.get((r.body[i].predicate, len(r.body[i].args)))
                    others = {j: total.get((r.body[j].predicate, len(r.body[j].args))) for j in places if j != i}
                    if new is not None and all(o is not None for o in others.values()):
                        parts.setdefault(r.key, []).append(self._rule(r, "set", i, {i: new, **others}))
            news = {}
            for k, found in parts.items():
                rows = _merged(found, k[1], "set")
                if k in total:
                    rows = rows.join(total[k], columns(k[1]), "left_anti")
                rows = stored(rows, f"delta-{k[0]}")
                if not rows.isEmpty():
                    news[k] = rows
            for k, rows in news.items():
                known.setdefault(k, []).append(rows)
                if len(known[k]) > MERGE:
                    known[k] = [stored(reduce(DataFrame.unionByName, known[k]), f"known-{k[0]}")]
        empty = lambda k: self.base_schema(k[1])
        return {k: reduce(DataFrame.unionByName, known[k]) if k in known else empty(k) for k in group}

    def _closure(self, rule: Rule, base: DataFrame) -> DataFrame:
        """All rows of the transitive ``rule`` over ``base(x, y)``; only a chunk's known rows are shuffled at once."""
        spark, name = base.sparkSession, rule.head.predicate
        chunks = max(1, -(-base.count() // CLOSURE_ROWS))
        done: list[DataFrame] = []
        mark = scratch_mark()
        for c in range(chunks):
            mine = base if chunks == 1 else base.where(F.pmod(F.xxhash64("x"), F.lit(chunks)) == c)
            known, new = [mine], mine
            while True:
                total = reduce(DataFrame.unionByName, known)
                found = _merged([self._rule(rule, "set", 0, {0: new, 1: base})], 2, "set")
                new = stored(found.join(total, ["x", "y"], "left_anti"), f"delta-{name}")
                if new.isEmpty():
                    break
                known.append(new)
                if len(known) > MERGE:
                    known = [stored(reduce(DataFrame.unionByName, known), f"known-{name}")]
                    drop_scratch(spark, mark, (*done, *known, new))
            done += known
            drop_scratch(spark, mark, tuple(done))
        return reduce(DataFrame.unionByName, done)

    def base_schema(self, arity: int) -> DataFrame:
        from pyspark.sql import SparkSession

        return SparkSession.active().createDataFrame([], ", ".join(f"{c} string" for c in columns(arity)))


def _is_transitive(rule: Rule) -> bool:
    """Whether a rule is p(X, Y) :- p(X, Z), p(Z, Y)."""
    if len(rule.body) != 2 or not all(isinstance(g, Atom) and (g.predicate, len(g.args)) == rule.key for g in rule.body):
        return False
    args = [*rule.head.args, *rule.body[0].args, *rule.body[1].args]
    if len(args) != 6 or not all(isinstance(a, Var) and a.name != "_" for a in args):
        return False
    x, y, x2, z, z2, y2 = (a.name for a in args)
    return x == x2 and y == y2 and z == z2 and len({x, y, z}) == 3


def _merged(parts: list[DataFrame], arity: int, mode: str) -> DataFrame:
    """All parts' rows: distinct, or with their derivations added up."""
    names = columns(arity)
    every = reduce(DataFrame.unionByName, parts)
    if mode == "counted":
        return every.groupBy(*names).agg(F.sum("mult").alias("mult"))
    return every.select(*names).distinct()
