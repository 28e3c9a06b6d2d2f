"""Scalar functions as Column expressions: text, sets of answers, scores, parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what is white space at a text's ends (as Unicode and Python have it).
_WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"
_SPLIT_NAME = r"^depth_(\d+)_size_(\d+)_seed_(\d+)"


def strip(text: Column | str) -> Column:
    """Without white space at either end (trim() takes spaces only)."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, rf"^{_WHITE}+|{_WHITE}+$", "")


def answer_set(text: Column | str, sep: str = ",") -> Column:
    """The distinct answers of a text: cut at ``sep``, stripped, lower-cased. An empty text has one, the empty one."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.transform(F.split(text, re.escape(sep), -1), lambda v: F.lower(strip(v))))


def exact_match(pred: Column, true: Column) -> Column:
    """Whether two answer sets are equal."""
    return F.array_sort(pred) == F.array_sort(true)


def precision(pred: Column, true: Column) -> Column:
    return F.size(F.array_intersect(pred, true)).cast("double") / F.size(pred)


def recall(pred: Column, true: Column) -> Column:
    return F.size(F.array_intersect(pred, true)).cast("double") / F.size(true)


def f1(pred: Column, true: Column) -> Column:
    """0 where precision and recall are both 0."""
    p, r = precision(pred, true), recall(pred, true)
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / F.when(p + r == 0, F.lit(1.0)).otherwise(p + r))


def is_aggregation(question: Column | str) -> Column:
    """Whether the question starts with 'How many', after white space, in just that case."""
    return F.startswith(strip(question), F.lit("How many"))


def split_part(split: Column | str, part: str) -> Column:
    """depth, size or seed of a split's name; null where the name has another form."""
    text = F.regexp_extract(split, _SPLIT_NAME, ("depth", "size", "seed").index(part) + 1)
    return F.when(text != "", text).cast("int")


def answer_tag(text: Column | str) -> Column:
    """What stands in the last <answer> element on one line; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(r"<answer>(.*?)</answer>"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def after_think(text: Column | str) -> Column:
    """What follows </think> on its line, else the whole text."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract(text, r"</think>\s*(.+)", 1)
    return F.when(found != "", found).otherwise(text)


def last_line(text: Column | str) -> Column:
    """The last line of the stripped text, without backticks."""
    return strip(F.translate(F.element_at(F.split(strip(text), "\n", -1), -1), "`", ""))


def action(text: Column | str) -> Column:
    """struct(name, argument) of the first name[argument], the argument lower-cased; null if there is none."""
    pattern = r"(\w+)\[(.*?)\]"
    name = F.regexp_extract(text, pattern, 1)
    return F.when(name != "", F.struct(name.alias("name"), F.lower(F.regexp_extract(text, pattern, 2)).alias("argument")))


def one_line(text: Column | str) -> Column:
    """Line feeds at the ends dropped, white space stripped, other line feeds turned into spaces."""
    text = F.col(text) if isinstance(text, str) else text
    return F.replace(strip(F.regexp_replace(text, r"^\n+|\n+$", "")), F.lit("\n"), F.lit(" "))


def title_of(contents: Column | str) -> Column:
    """The first line, without quotes at its ends, lower-cased."""
    return F.lower(F.regexp_replace(F.substring_index(contents, "\n", 1), r'^"+|"+$', ""))


def body_of(contents: Column | str) -> Column:
    """What follows the first line."""
    text = F.col(contents) if isinstance(contents, str) else contents
    return F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.length(text))).otherwise(F.lit(""))


def sentences(text: Column | str) -> Column:
    """Sentences by end marks followed by white space, white space inside turned into one space."""
    flat = strip(F.regexp_replace(text, r"\s+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, r"(?<=[.!?])\s+(?=\S)", -1))


def retrieved_titles(message: Column | str, before: str, after: str, separator: str) -> Column:
    """Titles ('# title' before an empty line) of the articles between two marks."""
    evidence = F.regexp_extract(message, rf"(?s){re.escape(before)}(.*?){re.escape(after)}", 1)
    parts = F.split(evidence, re.escape(separator), -1)
    return F.filter(F.transform(parts, lambda a: F.regexp_extract(a, r"# (.*)\n\n", 1)), lambda t: t != "")


def number_of_hops(query: Column | str) -> Column:
    return F.size(query).cast("long")


def counts_something(query: Column | str) -> Column:
    """Whether a goal list has an aggregate."""
    return F.contains(F.array_join(query, " "), F.lit("aggregate_all"))


def goals_difficulty(query: Column | str) -> Column:
    """The sum of the weights of a goal list's predicates."""
    from kinquery.plans.relations import ASKABLE, ATTRIBUTES, weight

    known = F.create_map(*(F.lit(v) for p in (*ASKABLE, *ATTRIBUTES, "aggregate_all") for v in (p, weight(p))))
    names = F.transform(F.col(query) if isinstance(query, str) else query, lambda g: F.substring_index(g, "(", 1))
    return F.aggregate(names, F.lit(0), lambda s, n: s + F.coalesce(F.try_element_at(known, n), F.lit(0))).cast("long")


def fill_placeholders(tokens: Column | str, values: Column | str) -> Column:
    """Tokens with each placeholder replaced by its value from a map; whole tokens, so _3 can't hit _31."""
    return F.transform(F.col(tokens) if isinstance(tokens, str) else tokens, lambda t: F.coalesce(F.try_element_at(F.col(values) if isinstance(values, str) else values, t), t))


def question_text(tokens: Column | str) -> Column:
    """Tokens joined by spaces, the last one (the question mark) without."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.concat(F.array_join(F.slice(tokens, F.lit(1), F.size(tokens) - 1), " "), F.element_at(tokens, -1))


def alias_of(name: Column | str, aliases: dict[str, str]) -> Column:
    """A name's alias, or the name itself."""
    name = F.col(name) if isinstance(name, str) else name
    if not aliases:
        return name
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in aliases.items() for v in kv)), name), name)


def bracketed(text: Column | str) -> Column:
    """All parts in angle brackets."""
    return F.regexp_extract_all(text, F.lit(r"<([^<>]*)>"), F.lit(1))


def arrow_parts(text: Column | str) -> Column:
    """A rule's two sides around '->', stripped; null where there is none."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(text, "->", 2)
    return F.when(F.size(parts) == 2, F.transform(parts, strip))


def joined_lines(text: Column | str) -> Column:
    """Lines joined by single spaces, each stripped, empty ones dropped."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_join(F.filter(F.transform(F.split(text, "\n", -1), strip), lambda t: t != ""), " ")


def listed_questions(text: Column | str) -> Column:
    """Questions of a numbered or dashed list, a line each, without their marks."""
    text = F.col(text) if isinstance(text, str) else text
    lines = F.transform(F.split(text, "\n", -1), lambda t: strip(F.regexp_replace(t, r"^\s*(?:\d+[.)]|[-*])\s*", "")))
    return F.filter(lines, lambda t: F.endswith(t, F.lit("?")))


def names_in(text: Column | str, names: list[str]) -> Column:
    """Those of a short list of names that stand in the text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(text, n))


def fenced(text: Column | str) -> Column:
    """What stands between the first two triple quotes; null without."""
    found = F.regexp_extract(text, '(?s)"""(.*?)"""', 1)
    return F.when(found != "", found)


def result_hash(values: Column | str) -> Column:
    """A hash of a result set that doesn't depend on its order."""
    return F.sha2(F.to_json(F.array_sort(F.array_distinct(values))), 256)


def stable_id(*parts: Column | str) -> Column:
    """An id that is the same in every run, in the form of a UUID."""
    h = F.md5(F.concat_ws("\x1f", *parts).cast("binary"))
    cut = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *cut)


def valid_pattern(pattern: str) -> bool:
    """Whether Java takes the pattern; asked once on the driver, as a bad one would end the job."""
    from pyspark.errors import IllegalArgumentException
    from pyspark.sql import SparkSession

    try:
        SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except IllegalArgumentException:  # a bad pattern's exception is one of these
        return False
