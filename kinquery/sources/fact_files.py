"""Clause files: facts and rules, as a listing or a person writes them.

Text is cut where a clause ends at the end of a line, which Spark's reader does for files of any
size. Pieces that are one ground fact are parsed by Column expressions; what else there is (rules,
several clauses on a line, comments, directives) goes through a small parser. A file in which a
comment or quoted value goes on over such a cut is read whole instead. Nothing is dropped: what
can't be parsed, and facts of other than one or two arguments, are listed as problems.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinquery.functions.clauses import Directive, Rule, cut, is_fact, parse_clause

_TERM = r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[a-z][A-Za-z0-9_]*|-?[0-9]+(?:\.[0-9]+)?)"""
FACT = rf"^\s*([a-z][A-Za-z0-9_]*)\(\s*{_TERM}\s*(?:,\s*{_TERM}\s*)?\)\s*\.?\s*$"
PARSED = "ord long, at long, kind string, pred string, x string, y string, clause string, error string"
#: Rules are a program's text and are planned on the driver.
MOST_RULES = 100_000


def _unquoted(term: Column) -> Column:
    quoted = term.rlike("""^["']""")
    return F.when(quoted, F.regexp_replace(F.substring(term, F.lit(2), F.length(term) - 2), r"\\(.)", "$1")).otherwise(term)


def _clause_row(clause: str) -> tuple:
    """kind, pred, x, y, clause, error."""
    try:
        found = parse_clause(clause)
    except ValueError as e:
        return "problem", None, None, None, clause, str(e)
    if isinstance(found, Directive):
        return "directive", None, None, None, clause, None
    if len(found) == 1 and is_fact(found[0]):
        args = [a.value for a in found[0].head.args]
        if len(args) not in (1, 2):
            return "problem", found[0].head.predicate, None, None, clause, "facts have one or two arguments"
        return "fact", found[0].head.predicate, args[0], args[1] if len(args) == 2 else None, None, None
    return "rule", found[0].head.predicate, None, None, clause, None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PARSED.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 6]
    for batch in batches:
        rows = []
        for place, text in zip(batch.column("ord").to_pylist(), batch.column("l").to_pylist(), strict=True):
            clauses, is_open = cut(text)
            rows += [(place, i, *_clause_row(c)) for i, c in enumerate(clauses)]
            if is_open:
                rows.append((place, len(clauses), "open", None, None, None, text, "a comment or quoted value doesn't end"))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)], names)


def _parsed(lines: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Ground facts by expressions, and all other clauses by the parser, of numbered pieces of text."""
    numbered = lines.select(F.col(text).alias("l"), F.monotonically_increasing_id().alias("ord")).where(F.col("l").rlike(r"\S"))
    simple = F.coalesce(F.col("l").rlike(FACT), F.lit(False))
    part = [F.regexp_extract("l", FACT, i) for i in (1, 2, 3)]
    facts = numbered.where(simple).select("ord", part[0].alias("pred"), _unquoted(part[1]).alias("x"), F.when(part[2] != "", _unquoted(part[2])).alias("y"))
    return facts, numbered.where(~simple).select("ord", "l").mapInArrow(_parse, PARSED)


@dataclass
class Clauses:
    """facts(pred, x, y, ord); rules with their places; problems(ord, clause, error); directives are left out."""

    facts: DataFrame
    rules: list[tuple[int, Rule]]
    problems: DataFrame


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """pred, x, y, ord of the ground facts of one or two arguments in lines of whole clauses.

    Both quotes and bare atoms are values of one kind. ``ord`` follows the lines' order. Null and
    blank lines have no facts. Rules and problems are ``read_lines``' to tell.
    """
    return read_lines(lines, line).facts


def read_lines(lines: DataFrame, line: str = "value") -> Clauses:
    """The clauses of lines (or longer pieces) of text, each of which ends outside of any clause."""
    facts, others = _parsed(lines, line)
    most = others.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0] + 1  # clauses of one piece; one job over what is no simple fact
    found = others.where("kind = 'rule'").select("ord", "at", "clause").orderBy("ord", "at").limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    place = (F.col("ord") * most + F.col("at")).alias("ord")
    every = facts.select("pred", "x", "y", (F.col("ord") * most).alias("ord")).unionByName(others.where("kind = 'fact'").select("pred", "x", "y", place))
    rules = [(r["ord"] * most + r["at"], rule) for r in found for rule in parse_clause(r["clause"])]
    return Clauses(every, rules, others.where("kind in ('problem', 'open')").select(place, "clause", "error"))


def read_clauses(spark: SparkSession, *paths: str) -> Clauses:
    """The clauses of text files, in the order of the paths."""
    parts = []
    for path in paths:
        cuts = spark.read.option("lineSep", ".\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
        odd = cuts.where(~F.col("value").rlike(FACT)).select("file", "value").mapInArrow(_open_files, "file string").distinct()
        whole = [r["file"] for r in odd.collect()]  # a row a file
        if whole:
            split = cuts.where(~F.col("file").isin(whole)).select("value")
            parts.append(split.unionByName(spark.read.text(path, wholetext=True).where(F.col("_metadata.file_path").isin(whole)).select("value")))
        else:
            parts.append(cuts.select("value"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return read_lines(every)


def _open_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [f for f, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True) if cut(text)[1]]
        yield pa.RecordBatch.from_arrays([pa.array(sorted(set(found)), pa.string())], ["file"])


def legacy_facts(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines without their last two characters."""
    return lines.select(F.substring(F.col(line), F.lit(1), F.length(line) - 2).alias("fact"))


def clauses(facts: DataFrame) -> DataFrame:
    """(ord, clause): each fact as a line of a listing."""

    def quoted(c: str) -> Column:
        return F.concat(F.lit('"'), F.regexp_replace(F.col(c), r'(["\\])', r"\\$1"), F.lit('"'))

    args = F.when(F.col("y").isNull(), quoted("x")).otherwise(F.concat(quoted("x"), F.lit(", "), quoted("y")))
    return facts.select("ord", F.concat("pred", F.lit("("), args, F.lit(").")).alias("clause"))


def write_facts(facts: DataFrame, path: str, text: bool = True, rules: DataFrame | None = None) -> None:
    """As text in order, ``rules(ord, clause)`` among the facts; or the facts as Parquet by predicate."""
    if text:
        every = clauses(facts) if rules is None else clauses(facts).unionByName(rules)
        every.orderBy("ord").select("clause").write.text(path)
    else:
        facts.write.partitionBy("pred").parquet(path)
