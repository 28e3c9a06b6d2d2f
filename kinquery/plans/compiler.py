"""Conjunctive queries to DataFrame plans.

Goals are taken from left to right. An atom joins the bindings on the variables they share; its
constants become filters below the join. A count stands where it stands: what is bound before it is
kept, one count a binding, zeros included. Many instances of one query shape run as one plan: their
constants are columns of a parameter frame, which is where the bindings start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinquery.functions.clauses import Compare, Not
from kinquery.functions.columns import last_line
from kinquery.functions.goals import Atom, Const, CountDistinct, Var, parse_query, split_top, target_variable

MULT = "__mult"


def _rows(facts, atom: Atom, bag: bool, given: DataFrame | None = None) -> DataFrame:
    """One column a variable of the atom (and its multiplicity), constants and repeats filtered."""
    rel = given if given is not None else facts.relation(atom.predicate, len(atom.args), "counted" if bag else "set")
    names = [c for c in rel.columns if c != "mult"]
    if len(names) != len(atom.args):
        raise ValueError(f"{atom.predicate} has {len(names)} arguments")
    taken: dict[str, Column] = {}
    for name, arg in zip(names, atom.args, strict=True):
        if isinstance(arg, Const):
            rel = rel.where(F.col(name) == F.lit(arg.value))
        elif arg.name in taken:
            rel = rel.where(F.col(name) == taken[arg.name])
        elif arg.name != "_":
            taken[arg.name] = F.col(name)
    found = rel.select(*(c.alias(v) for v, c in taken.items()), *([F.col("mult").alias(MULT)] if bag else []))
    if len(taken) == len(names):  # rows of a relation differ already
        return found
    if bag:
        return found.groupBy(*taken).agg(F.sum(MULT).alias(MULT)).where(F.col(MULT) > 0)
    return found.distinct() if taken else found.limit(1).select(F.lit(1).alias("__any"))


def evaluate(facts, goals, params: DataFrame | None = None, bag: bool = False, keep: set[str] | None = None, rows: dict[int, DataFrame] | None = None, few: bool = False) -> DataFrame:
    """Bindings: one column a variable, and the columns of ``params``; with ``bag`` also __mult.

    ``facts`` gives relation(name, arity, mode). Parameter columns are variables that are bound
    from the start. A query of ground goals alone gives one row, without columns of its own, if it holds.
    ``keep``: variables and columns wanted in the end; others go after the last goal that has them.
    ``rows``: rows of goals by place, instead of their predicates' whole ones. Goals with a constant
    are walked from it, and with ``few`` all goals from what is bound, where ``facts`` can ``extend``
    bindings: the rows of a step are then those that can be reached, and no whole relation is derived.
    """
    state = params.withColumn(MULT, F.lit(1).cast("long")) if params is not None and bag else params
    parsed = [g if not isinstance(g, str) else parse_query([g])[0] for g in (parse_query(goals) if isinstance(goals, str) else goals)]
    for i, goal in enumerate(parsed):
        if isinstance(goal, CountDistinct):
            state = _count(facts, goal, state, bag)
        elif isinstance(goal, Compare):
            state = _compare(goal, state)
        elif isinstance(goal, Not):
            state = _without(facts, goal.atom, state)
        elif rows and i in rows:
            state = _join(facts, goal, state, bag, rows[i])
        else:
            walked = _walk(facts, goal, state, bag, few)
            state = walked if walked is not None else _join(facts, goal, state, bag)
        if keep is not None:
            state = _needed(state, keep.union(*map(names_in, parsed[i + 1 :])), bag)
    if state is None:
        raise ValueError("an empty query")
    return state.drop("__any")


def names_in(goal) -> set[str]:
    """The variables of a goal."""
    if isinstance(goal, Compare):
        return {a.name for a in (goal.left, goal.right) if isinstance(a, Var)}
    if isinstance(goal, CountDistinct):
        return names_in(goal.atom) | {goal.out.name}
    return {a.name for a in (goal.atom if isinstance(goal, Not) else goal).args if isinstance(a, Var)}


def _needed(state: DataFrame, names: set[str], bag: bool) -> DataFrame:
    """Bindings without the columns that nothing needs any more; rows that are alike then become one."""
    kept = [c for c in state.columns if c in names or c in (MULT, "__any")]
    if len(kept) == len(state.columns):
        return state
    if bag:
        by = [c for c in kept if c != MULT]
        return state.groupBy(*by).agg(F.sum(MULT).alias(MULT)).where(F.col(MULT) > 0)
    return state.select(*kept).distinct() if kept else state.limit(1).select(F.lit(1).alias("__any"))


def _compare(goal: Compare, state: DataFrame | None) -> DataFrame:
    if state is None:
        raise ValueError("a comparison before anything is bound")
    sides = [F.lit(a.value) if isinstance(a, Const) else F.col(a.name) if a.name in state.columns else a for a in (goal.left, goal.right)]
    free = [s for s in sides if isinstance(s, Var)]
    if not free:
        return state.where(sides[0] == sides[1] if goal.same else sides[0] != sides[1])
    if len(free) == 2 or not goal.same:
        raise ValueError(f"{free[0].name} is compared before it is bound")
    return state.withColumn(free[0].name, next(s for s in sides if not isinstance(s, Var)))


def _without(facts, atom: Atom, state: DataFrame | None) -> DataFrame:
    if state is None:
        raise ValueError("a negation before anything is bound")
    rows, shared = _rows(facts, atom, False), _bound(state, atom)
    if shared:
        return state.join(rows.select(*shared).distinct(), shared, "left_anti")
    none = rows.agg((F.count(F.lit(1)) == 0).alias("__none"))  # one row
    return state.crossJoin(F.broadcast(none)).where("__none").drop("__none")


def _walk(facts, atom: Atom, state: DataFrame | None, bag: bool, few: bool) -> DataFrame | None:
    """Bindings carried along a goal of two arguments from the one that is known; None where it can't be."""
    if len(atom.args) != 2 or not hasattr(facts, "extend"):
        return None
    first, second = atom.args
    have = set(state.columns) if state is not None else set()
    constant = [isinstance(a, Const) for a in atom.args]
    known = [c or (few and a.name in have) for a, c in zip(atom.args, constant, strict=True)]
    if not any(known) or not facts.can_extend(atom.predicate) or any(a.name == "_" for a in atom.args if isinstance(a, Var)):
        return None
    if state is not None and any(constant) and not few and any(a.name in have for a in atom.args if isinstance(a, Var)):
        return None  # joined to bindings on the other argument, the constant is a filter below that join
    back = not known[0]
    start, end = (second, first) if back else (first, second)
    if state is None:
        state = facts.spark.range(1).select(F.lit(1).alias("__any"), *([F.lit(1).cast("long").alias(MULT)] if bag else []))
    at = start.name if isinstance(start, Var) else "__from"
    if isinstance(start, Const):
        state = state.withColumn(at, F.lit(start.value))
    bound_end = isinstance(end, Const) or end.name in have or end == start
    out = "__to" if bound_end else end.name
    found = facts.extend(state, at, atom.predicate, out, bag, back)
    if bound_end:
        found = found.where(F.col(out) == (F.lit(end.value) if isinstance(end, Const) else F.col(end.name))).drop(out)
    return found.drop("__from") if isinstance(start, Const) else found


def _bound(state: DataFrame | None, atom: Atom) -> list[str]:
    have = set(state.columns) if state is not None else set()
    return list(dict.fromkeys(a.name for a in atom.args if isinstance(a, Var) and a.name in have))


def _join(facts, atom: Atom, state: DataFrame | None, bag: bool, given: DataFrame | None = None) -> DataFrame:
    rows = _rows(facts, atom, bag, given)
    if state is None:
        return rows
    shared = _bound(state, atom)
    if bag:
        rows = rows.withColumnRenamed(MULT, "__m")
    if "__any" in rows.columns:
        rows = rows.drop("__any") if not shared else rows
    # without a shared variable the goal is a separate condition: a product, which the query asks for
    out = state.join(rows, shared) if shared else state.crossJoin(rows)
    return out.withColumn(MULT, F.col(MULT) * F.col("__m")).drop("__m") if bag else out


def _count(facts, goal: CountDistinct, state: DataFrame | None, bag: bool) -> DataFrame:
    rows = _rows(facts, goal.atom, False)  # distinct already, so counting them is enough
    shared, out = _bound(state, goal.atom), goal.out.name
    if not shared:
        one = rows.agg(F.count(F.lit(1)).alias(out))
        if state is None:
            return one.withColumn(MULT, F.lit(1).cast("long")) if bag else one
        return state.crossJoin(F.broadcast(one))
    counts = rows.groupBy(*shared).agg(F.count(F.lit(1)).alias("__n"))
    return state.join(counts, shared, "left").withColumn(out, F.coalesce("__n", F.lit(0)).cast("long")).drop("__n")


def values_of(answer: str) -> Column:
    return F.array_sort(F.collect_set(F.col(answer).cast("string")))


def traces_of(names: list[str]) -> Column:
    return F.array_sort(F.collect_set(F.to_json(F.struct(*names))))


def answers(bindings: DataFrame, answer: str, by: list[str]) -> DataFrame:
    """by, answer: the distinct values of a variable as text, in the order of their text."""
    return bindings.groupBy(*by).agg(values_of(answer).alias("answer"))


def traces(bindings: DataFrame, by: list[str]) -> DataFrame:
    """by, traces: the distinct bindings as JSON objects, in the order of their text."""
    names = [c for c in bindings.columns if c not in by and not c.startswith("__")]
    return bindings.groupBy(*by).agg(traces_of(names).alias("traces"))


def run_prefixes(facts, goals: list[str]) -> list[tuple[str, list[dict] | None, str | None]]:
    """Every prefix of a written query: (goals, its bindings, None) until one fails: (goals, None, error)."""
    out = []
    for n in range(1, len(goals) + 1):
        text = ", ".join(goals[:n])
        try:
            out.append((text, [r.asDict() for r in evaluate(facts, goals[:n]).collect()], None))
        except (ValueError, KeyError) as e:
            out.append((text, None, str(e)))
            break
    return out


def _shape(goals: list[str]) -> tuple[tuple[str, ...], list[str]]:
    """The goals with their constants as variables, and the constants."""
    given: list[str] = []
    if not goals:
        raise ValueError("an empty query")

    def text(goal: Atom | CountDistinct) -> str:
        if isinstance(goal, CountDistinct):
            return f"aggregate_all(count, distinct({text(goal.atom)}), {goal.out.name})"
        names = []
        for a in goal.args:
            if isinstance(a, Const):
                given.append(a.value)
            names.append(a.name if isinstance(a, Var) else f"Given__{len(given)}")
        return f"{goal.predicate}({', '.join(names)})"

    return tuple(map(text, parse_query(goals))), given


def run_predicted(facts, preds: DataFrame, id: str = "id", query: str = "prolog_query", debug: bool = False) -> DataFrame:
    """id, pred, error, steps: written queries run against the facts.

    The query is the last line of the text; its answer is the distinct values of its target variable,
    in the order of their text, joined by commas. What can't be parsed or isn't known gives an error
    and no answer. Queries that differ in constants only run as one plan, whose bindings stay in the
    cluster; the driver has the distinct texts. With ``debug`` steps has each prefix's bindings as
    JSON, up to the first that fails, for each query by itself.
    """
    import json

    rows = preds.select(F.col(id), last_line(F.coalesce(F.col(query), F.lit(""))).alias("__query"))
    failed: list[tuple[str, str]] = []
    shapes: dict[tuple[tuple[str, ...], str | None], list[tuple[str, list[str]]]] = {}
    steps: list[tuple[str, str]] = []
    for (text,) in rows.select("__query").distinct().collect():
        try:
            goals = split_top(text)
            texts, given = _shape(goals)
            shapes.setdefault((texts, target_variable(goals)), []).append((text, given))
        except ValueError as e:
            failed.append((text, str(e)))
        if debug:
            try:
                steps.append((text, json.dumps(run_prefixes(facts, split_top(text)))))
            except ValueError as e:
                steps.append((text, json.dumps([[text, None, str(e)]])))
    done = None
    for (texts, target), asked in shapes.items():
        width = len(asked[0][1])
        params = facts.spark.createDataFrame([(t, *c) for t, c in asked], ", ".join(["`__query` string", *(f"`Given__{i + 1}` string" for i in range(width))]))
        try:
            bound = evaluate(facts, list(texts), params)
            found = answers(bound, target, ["__query"]) if target else bound.select("__query").distinct().withColumn("answer", F.array(F.lit("true")))
        except (ValueError, KeyError) as e:
            failed += [(t, str(e)) for t, _ in asked]
            continue
        none = "" if target else "false"
        part = params.select("__query").join(found, "__query", "left").select("__query", F.coalesce(F.array_join("answer", ","), F.lit(none)).alias("pred"), F.lit(None).cast("string").alias("error"))
        done = part if done is None else done.unionByName(part)
    wrong = facts.spark.createDataFrame([(t, None, e) for t, e in failed], "`__query` string, pred string, error string")
    done = wrong if done is None else done.unionByName(wrong)
    done = done.join(facts.spark.createDataFrame(steps, "`__query` string, steps string"), "__query", "left")
    return rows.join(done, "__query", "left").select(id, "pred", "error", "steps")
