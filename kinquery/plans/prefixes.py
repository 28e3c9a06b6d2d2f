"""Every prefix of many written queries, run together.

Texts are parsed in the cluster, row by row, into their shape (goals with constants as parameters)
and their constants. Only shapes come to the driver. They form a trie: a node is a prefix that one
or more shapes begin with, and its bindings are its parent's, carried on by one goal for all queries
that pass it, and written. So a goal that a million queries begin with runs once, and a step's plan
is one goal long. A goal that can't be parsed, or whose predicate isn't known, ends its queries there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinquery.functions.columns import last_line
from kinquery.functions.goals import Atom, Const, Var, parse_goal, split_top
from kinquery.plans.compiler import evaluate
from kinquery.runtime import stored

PARSED = "id string, shape array<string>, given array<string>, error string"
#: Shapes that are planned at most; more are an error.
MOST_SHAPES = 10_000


def shape_of(text: str) -> tuple[list[str], list[str], str | None]:
    """Goals with constants as Given__i up to the first that can't be parsed, the constants, and why it can't."""
    shape: list[str] = []
    given: list[str] = []
    try:
        goals = split_top(text)
        if not goals:
            raise ValueError("an empty query")
        for goal in goals:
            found, consts = parse_goal(goal), list(given)
            atom = found if isinstance(found, Atom) else found.atom
            names = []
            for a in atom.args:
                if isinstance(a, Const):
                    consts.append(a.value)
                names.append(a.name if isinstance(a, Var) else f"Given__{len(consts)}")
            said = f"{atom.predicate}({', '.join(names)})"
            shape.append(said if isinstance(found, Atom) else f"aggregate_all(count, distinct({said}), {found.out.name})")
            given = consts
    except ValueError as e:
        return shape, given, str(e)
    return shape, given, None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shape_of(t) for t in batch.column("text").to_pylist()]
        lists = [pa.array([f[i] for f in found], pa.list_(pa.string())) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *lists, pa.array([f[2] for f in found], pa.string())], ["id", "shape", "given", "error"])


def prefix_counts(facts, preds: DataFrame, id: str = "id", query: str = "prolog_query") -> DataFrame:
    """id, n, bindings, error: for each prefix of n goals how many different bindings it has, up to the first that fails.

    A failed prefix has no bindings and an error. Ids must differ; null texts fail at once, and rows
    without an id are left out. The query is the last line of the text.
    """
    texts = preds.where(F.col(id).isNotNull()).select(F.col(id).cast("string").alias("id"), last_line(F.coalesce(F.col(query), F.lit(""))).alias("text"))
    rows = stored(texts.mapInArrow(_parse, PARSED), "shapes")
    shapes = [tuple(r["shape"]) for r in rows.select("shape").distinct().limit(MOST_SHAPES + 1).collect()]
    if len(shapes) > MOST_SHAPES:
        raise ValueError(f"more than {MOST_SHAPES} shapes of queries")
    out = [rows.where(F.col("error").isNotNull()).select("id", (F.size("shape") + 1).alias("n"), F.lit(None).cast("long").alias("bindings"), "error")]
    nodes = sorted({s[:k] for s in shapes for k in range(1, len(s) + 1)}, key=len)
    known: dict[tuple[str, ...], DataFrame] = {}
    for node in nodes:
        if node[:-1] and node[:-1] not in known:
            continue  # its parent failed
        k = len(node)
        at = rows.where(F.slice("shape", 1, k) == F.array(*map(F.lit, node)))
        width = max((int(name.removeprefix("Given__")) for g in node for name in _names(g) if name.startswith("Given__")), default=0)
        if k == 1:
            start = at.select("id", *(F.get("given", F.lit(i)).alias(f"Given__{i + 1}") for i in range(width)))
        else:
            old = known[node[:-1]].columns
            more = [F.get("given", F.lit(i)).alias(f"Given__{i + 1}") for i in range(width) if f"Given__{i + 1}" not in old]
            start = known[node[:-1]].join(at.select("id", *more), "id")
        try:
            bound = evaluate(facts, [node[-1]], start, few=True)
        except (ValueError, KeyError) as e:
            out.append(at.select("id", F.lit(k).alias("n"), F.lit(None).cast("long").alias("bindings"), F.lit(str(e)).alias("error")))
            continue
        known[node] = bound = stored(bound.distinct(), "prefix")
        counts = bound.groupBy("id").agg(F.count(F.lit(1)).alias("bindings"))
        out.append(at.select("id").join(counts, "id", "left").select("id", F.lit(k).alias("n"), F.coalesce("bindings", F.lit(0)).alias("bindings"), F.lit(None).cast("string").alias("error")))
    return reduce(DataFrame.unionByName, out)


def _names(goal: str) -> list[str]:
    found = parse_goal(goal)
    return [a.name for a in (found if isinstance(found, Atom) else found.atom).args if isinstance(a, Var)]
