"""Consulted rules, recursion, and relations of the people asked about only, with SQL for each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinquery.plans.facts import FactBase
from kinquery.plans.relations import RELATIONS, program
from kinquery.runtime import scratch_path, stored, table
from kinquery.suite.files import put
from kinquery.suite.kin import facts, with_rules

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str):
    def add(run):
        QUERIES[name], ORACLES[name] = run, sql
        return run

    return add


_ALL = ("parent", *RELATIONS)


def _written(spark: SparkSession, sf_dir: str) -> FactBase:
    """The facts as a table, which each of many relations reads."""
    return FactBase(spark, stored(facts(spark, sf_dir).facts, "facts"))


@_query("rules_consulted", with_rules(*RELATIONS) + "\n" + " UNION ALL ".join(f"SELECT '{n}' AS rel, x, y, CAST(count(*) AS BIGINT) AS mult FROM {n} GROUP BY x, y" for n in RELATIONS))
def rules_consulted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relations from a file of rules, over several lines each, consulted after the facts."""
    path = put(spark, scratch_path(spark, "rules") + ".pl", "% relations\n:- dynamic parent/2.\n" + program())
    kin = _written(spark, sf_dir).consult(path)
    kin.rule_plans.table("counted", 2)
    parts = [kin.relation(n, 2, "counted").select(F.lit(n).alias("rel"), "x", "y", F.col("mult").cast("long").alias("mult")) for n in RELATIONS]
    return reduce(DataFrame.unionByName, parts)


_REACHED = "ancestor AS (SELECT x, y FROM parent UNION SELECT a.x, p.y FROM ancestor a JOIN parent p ON p.x = a.y)"


@_query("rules_recursive", with_rules().replace("WITH ", "WITH RECURSIVE ", 1) + f", {_REACHED} SELECT x, y FROM ancestor")
def rules_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors at any distance, a rule that comes back to itself twice."""
    kin = facts(spark, sf_dir).with_rules("ancestor(X, Y) :- parent(X, Y). ancestor(X, Y) :- ancestor(X, Z), ancestor(Z, Y).")
    return kin.relation("ancestor")


@_query("rules_negated", with_rules("sibling").replace("WITH ", "WITH RECURSIVE ", 1) + f", {_REACHED}, eldest AS (SELECT DISTINCT a.x, a.y FROM ancestor a WHERE NOT EXISTS (SELECT 1 FROM parent p WHERE p.x = a.y)) SELECT e.x, e.y, CAST((SELECT count(DISTINCT s.y) FROM sibling s WHERE s.x = e.x) AS VARCHAR) AS siblings FROM eldest e")
def rules_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule with a negation and one with a count, on top of a recursive one."""
    kin = facts(spark, sf_dir).with_rules(
        r"""ancestor(X, Y) :- parent(X, Y). ancestor(X, Y) :- ancestor(X, Z), parent(Z, Y).
        eldest(X, Y) :- ancestor(X, Y), \+ parent(Y, _).
        near(X, Y) :- parent(X, P), parent(Y, P), X \= Y.
        line(X, Y, N) :- eldest(X, Y), aggregate_all(count, distinct(near(X, S)), N)."""
    )
    return kin.relation("line", 3).withColumnRenamed("a3", "siblings")


@_query("asked_few", with_rules(*RELATIONS) + "\n" + " UNION ALL ".join(f"SELECT '{n}' AS rel, x, y, CAST(count(*) AS BIGINT) AS mult FROM {n} WHERE CAST(x AS BIGINT) % 100 = 0 GROUP BY x, y" for n in _ALL))
def asked_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relations of every hundredth person, walked from these people; no whole relation is derived."""
    kin = _written(spark, sf_dir)
    seeds = stored(table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").cast("string").alias("x")), "asked")
    plans = kin.plans.pinned_from(seeds, "counted")
    return reduce(DataFrame.unionByName, [plans(n).select(F.lit(n).alias("rel"), "x", "y", F.col("mult").cast("long").alias("mult")) for n in _ALL])


def _changed(upto: int) -> str:
    """Parents after the first ``upto`` of fifty changes, by rules of the change's number."""
    added = f"SELECT 'new' || i AS x, CAST(i AS VARCHAR) AS y, i AS since FROM range(1, 51) t(i) WHERE i % 5 <> 0 AND i <= {upto}"
    gone = f"(i % 5 = 0 AND i <= {upto} AND i > since AND ((i % 10 = 0 AND x = CAST(16 + i AS VARCHAR)) OR (i % 10 = 5 AND y = CAST(i AS VARCHAR))))"
    return f"SELECT CAST({upto} AS BIGINT) AS version, x, y FROM (SELECT x, y, 0 AS since FROM parent UNION ALL {added}) f WHERE NOT EXISTS (SELECT 1 FROM range(1, 51) t(i) WHERE {gone})"


@_query("facts_versions", with_rules() + "\n" + " UNION ALL ".join(_changed(v) for v in (0, 23, 50)))
def facts_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty changes to the parents, every fifth a retraction; read before them, in between and after them."""
    from kinquery.plans.versions import FactLog

    log = FactLog(spark, facts(spark, sf_dir).facts.where("pred = 'parent'"))
    for i in range(1, 51):
        if i % 5:
            log.add(f'parent(new{i}, "{i}")')
        else:
            log.remove(f'parent("{16 + i}", _)' if i % 10 == 0 else f'parent(X, "{i}")')
    return reduce(DataFrame.unionByName, [log.frame(v).select(F.lit(v).cast("long").alias("version"), "x", "y") for v in (0, 23, 50)])


@_query("prefixes_of_all", with_rules("sister", "child", "friend", "mother") + """, c AS (SELECT CAST(c_custkey AS VARCHAR) AS x, c_custkey AS k FROM customer),
  a AS (SELECT x, k, 1 AS n, (SELECT count(DISTINCT s.y) FROM sister s WHERE s.x = c.x) AS bindings FROM c WHERE k % 3 <> 2
    UNION ALL SELECT x, k, 2, (SELECT count(*) FROM (SELECT DISTINCT s.y, h.y AS z FROM sister s JOIN child h ON h.x = s.y WHERE s.x = c.x)) FROM c WHERE k % 3 = 0
    UNION ALL SELECT x, k, 3, NULL FROM c WHERE k % 3 = 0
    UNION ALL SELECT x, k, 2, NULL FROM c WHERE k % 3 = 1
    UNION ALL SELECT x, k, 1, (SELECT count(DISTINCT f.y) FROM friend f WHERE f.x = c.x) FROM c WHERE k % 3 = 2
    UNION ALL SELECT x, k, 2, (SELECT count(*) FROM (SELECT DISTINCT f.y, m.y AS z FROM friend f JOIN mother m ON m.x = f.y WHERE f.x = c.x)) FROM c WHERE k % 3 = 2)
  SELECT x AS id, CAST(n AS INTEGER) AS n, CAST(bindings AS BIGINT) AS bindings, bindings IS NULL AS failed FROM a""")
def prefixes_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicted query a customer, of three shapes: one whose third goal isn't known, one whose second can't be parsed, one that runs."""
    from kinquery.plans.prefixes import prefix_counts

    k = F.col("c_custkey")
    name = F.concat(F.lit('"'), k, F.lit('"'))
    text = F.when(k % 3 == 0, F.concat(F.lit("so:\nsister("), name, F.lit(", A), child(A, B), aunties(B, C), child(C, D)")))
    text = text.when(k % 3 == 1, F.concat(F.lit("sister("), name, F.lit(", A), Child(A"), F.lit(", B)"))).otherwise(F.concat(F.lit("friend("), name, F.lit(", Y), mother(Y, M)")))
    preds = table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), text.alias("prolog_query"))
    found = prefix_counts(_written(spark, sf_dir), preds)
    return found.select("id", "n", "bindings", F.col("error").isNotNull().alias("failed"))
