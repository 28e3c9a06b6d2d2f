"""Universes: family trees, friendships, attributes, and questions by random walks.

Every draw comes from a hash or a generator of (seed, key), so a universe is the same however it
is partitioned. Trees are independent: names are unique because each tree has surnames of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinquery.functions import columns as C
from kinquery.functions.templates import Template, templates
from kinquery.functions.wording import ATTRIBUTE_ALIAS, plural_words, question_words
from kinquery.operators.walks import Adjacency, below, beside, permuted, ranked
from kinquery.plans.compiler import evaluate, traces_of, values_of
from kinquery.plans.facts import FactBase
from kinquery.plans.relations import ASKABLE, ATTRIBUTES, EASY
from kinquery.runtime import stored

SYLLABLES = ("ba", "co", "da", "el", "fi", "go", "ha", "in", "jo", "ka", "lu", "mi", "no", "or", "pa", "ri")
PEOPLE = "tree int, idx int, name string, surname string, female boolean, level int, dob string, mother int, father int"


def spelled(n: int, parts: int = 3) -> str:
    """A pronounceable name for a number, one to one."""
    digits = []
    while n or len(digits) < parts:
        digits.append(n % len(SYLLABLES))
        n //= len(SYLLABLES)
    return "".join(SYLLABLES[d] for d in reversed(digits)).capitalize()


@dataclass
class Rules:
    """How families grow; ages in years."""

    max_depth: int = 5
    max_children: int = 5
    max_size: int = 25
    stop_prob: float = 0.0
    min_parent_age: int = 18
    mean_parent_age: int = 27
    max_parent_age: int = 45
    parent_age_deviation: float = 3.0
    max_couple_gap: int = 10
    twin_prob: float = 0.05
    sibling_days: int = 300
    names: tuple[tuple[str, ...], tuple[str, ...]] = field(default=((), ()))  # female, male; empty: by rule


class _Tree:
    """One growing tree; people are kept by index."""

    def __init__(self, tree: int, seed: int, rules: Rules):
        self.rng, self.rules, self.tree = np.random.default_rng([seed, tree]), rules, tree
        self.female: list[bool] = []
        self.level: list[int] = []
        self.born: list[date] = []
        self.line: list[int] = []  # which of the tree's surnames
        self.parents: dict[int, tuple[int, int]] = {}  # mother, father
        self.partner: dict[int, int] = {}
        self.children: dict[int, list[int]] = {}
        self.lines = 0

    def person(self, level: int, born: date, female: bool, line: int | None = None) -> int:
        if line is None:
            line, self.lines = self.lines, self.lines + 1
        self.female.append(female)
        self.level.append(level)
        self.born.append(born)
        self.line.append(line)
        return len(self.female) - 1

    def day_in(self, year: int) -> date:
        return date(max(1, year), int(self.rng.integers(1, 13)), int(self.rng.integers(1, 29)))

    def grow(self) -> None:
        r, rng = self.rules, self.rng
        base = 300 + r.max_depth * (r.max_parent_age + 1)
        self.person(r.max_depth, self.day_in(base), bool(rng.random() < 0.5))
        for _ in range(10 * r.max_size):
            if len(self.female) >= r.max_size:
                break
            at = int(rng.integers(len(self.female)))
            low, high = min(self.level), max(self.level)
            room = high - low < r.max_depth
            up = at not in self.parents and (self.level[at] > low or room)
            down = len(self.children.get(at, ())) < r.max_children and (self.level[at] < high or room)
            if up and down:
                up = bool(rng.random() < 0.5)
            if up:
                self.add_parents(at)
            elif down:
                self.add_child(at)
            if r.stop_prob and rng.random() < r.stop_prob:
                break

    def add_parents(self, child: int) -> None:
        r = self.rules
        year = self.born[child].year
        ages = np.clip(self.rng.normal(r.mean_parent_age, r.parent_age_deviation, 2).round(), r.min_parent_age + 1, r.max_parent_age - 1)
        mom = self.person(self.level[child] - 1, self.day_in(year - int(ages[0])), True, self.line[child])
        dad = self.person(self.level[child] - 1, self.day_in(year - int(ages[1])), False, self.line[child])
        self.partner[mom], self.partner[dad] = dad, mom
        self.parents[child] = (mom, dad)
        self.children.setdefault(mom, []).append(child)
        self.children.setdefault(dad, []).append(child)

    def add_child(self, at: int) -> None:
        r = self.rules
        if at not in self.partner:
            gap = int(np.clip(self.rng.normal(0, r.parent_age_deviation), -r.max_couple_gap, r.max_couple_gap))
            other = self.person(self.level[at], self.day_in(self.born[at].year + gap), not self.female[at], self.line[at])
            self.partner[at], self.partner[other] = other, at
        other = self.partner[at]
        mom, dad = (at, other) if self.female[at] else (other, at)
        born = self.birth(mom, dad)
        if born is None:
            return  # no day is left for another child
        child = self.person(self.level[at] + 1, born, bool(self.rng.random() < 0.5), self.line[dad])
        self.parents[child] = (mom, dad)
        for p in (mom, dad):
            self.children.setdefault(p, []).append(child)

    def birth(self, mom: int, dad: int) -> date | None:
        """A day when both are of age and no sibling was born within some months; or a twin's."""
        r, rng = self.rules, self.rng
        kids = [self.born[c] for c in self.children.get(mom, ())]
        if kids and rng.random() < r.twin_prob:
            return kids[int(rng.integers(len(kids)))]
        young, old = max(self.born[mom], self.born[dad]), min(self.born[mom], self.born[dad])
        first, last = young + timedelta(days=366 * r.min_parent_age), old + timedelta(days=365 * r.max_parent_age)
        mean = young + timedelta(days=365 * r.mean_parent_age)
        for _ in range(100):
            day = mean + timedelta(days=int(rng.normal(0, 365 * r.parent_age_deviation)))
            if first <= day <= last and all(abs((day - k).days) > r.sibling_days for k in kids):
                return day
        return None

    def rows(self) -> Iterator[tuple]:
        used: dict[tuple[int, bool], int] = {}
        for i, female in enumerate(self.female):
            pool = self.rules.names[0 if female else 1]
            n = used[self.line[i], female] = used.get((self.line[i], female), -1) + 1
            first = pool[n % len(pool)] + ("" if n < len(pool) else f" {n // len(pool) + 1}") if pool else spelled(2 * n + female, 2)
            surname = spelled(self.tree * 4096 + self.line[i], 4)
            mom, dad = self.parents.get(i, (None, None))
            yield self.tree, i, f"{first} {surname}", surname, female, self.level[i], self.born[i].isoformat(), mom, dad


def family_trees(spark: SparkSession, trees: int, seed: int = 1, rules: Rules | None = None) -> DataFrame:
    """People of ``trees`` independent trees, each grown in one task."""
    rules = rules or Rules()

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree in batch["id"]:
                t = _Tree(int(tree), seed, rules)
                t.grow()
                rows = list(t.rows())
                out = pd.DataFrame(rows, columns=["tree", "idx", "name", "surname", "female", "level", "dob", "mother", "father"])
                yield out.astype({"mother": "Int32", "father": "Int32"})

    return spark.range(trees).mapInPandas(grow, PEOPLE)


def assigned_names(people: DataFrame, firsts: DataFrame, lasts: DataFrame, seed: int = 1, duplicate_names: bool = False) -> DataFrame:
    """people(i, numbered from 0) with first and last names of finite pools (name); no pair twice.

    Person i gets the pair a keyed permutation of all pairs sends i to, so tasks need not agree on
    what is taken. Fewer pairs than people are an error, unless ``duplicate_names``: pairs are then
    drawn, and may come twice. Repeated names of a pool count once; null and empty ones don't.
    """
    pool = lambda names: stored(ranked(names.select("name").where("name <> ''").distinct(), ["name"], "pool", "__at"), "pool")
    first, last = pool(firsts), pool(lasts)
    n, pairs = people.count(), first.count() * (width := max(1, last.count()))
    if not pairs or (n > pairs and not duplicate_names):
        raise ValueError(f"{n} people and {pairs} names")
    at = below(F.lit(pairs), "name", F.lit(seed), F.col("i")) if duplicate_names else permuted(F.col("i"), pairs, seed)
    placed = people.withColumn("__p", at).withColumn("__f", F.floor(F.col("__p") / width)).withColumn("__l", F.col("__p") % width)
    named = placed.join(first.select(F.col("__at").alias("__f"), F.col("name").alias("first")), "__f").join(last.select(F.col("__at").alias("__l"), F.col("name").alias("last")), "__l")
    return named.select(*people.columns, "first", "last")


def family_facts(people: DataFrame) -> DataFrame:
    """(pred, x, y, ord): types, genders, parents and birth dates, sorted inside each tree and kind."""
    edges = people.select("tree", F.col("name").alias("x"), F.explode(F.array("mother", "father")).alias("idx")).where("idx is not null")
    parents = edges.join(people.select("tree", "idx", F.col("name").alias("y")), ["tree", "idx"]).select("tree", F.lit(2).alias("k"), F.lit("parent").alias("pred"), "x", "y")
    own = lambda k, pred, y: people.select("tree", F.lit(k).alias("k"), F.lit(pred).alias("pred"), F.col("name").alias("x"), y.alias("y"))
    every = own(0, "type", F.lit("person")).unionByName(own(1, "gender", F.when(F.col("female"), "female").otherwise("male"))).unionByName(parents).unionByName(own(3, "dob", F.col("dob")))
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("tree").orderBy("k", "x", "y"))
    return every.select("pred", "x", "y", (F.col("tree").cast("long") * (1 << 24) + place).alias("ord"))


def friendships(people: DataFrame, n: int, k: float = 3.0, seed: int = 1) -> DataFrame:
    """people(i, name), i from 0 to n-1: (x, y, ord) of each unordered pair with probability k/n.

    Each person draws the gaps to the next friend among later people (geometric steps), so the work
    is one row a friendship and not one a pair.
    """
    p = min(1.0, k / max(1, n))
    if p <= 0 or n < 2:
        return people.select(F.col("name").alias("x"), F.col("name").alias("y"), F.lit(0).cast("long").alias("ord")).limit(0)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = [], []
            for i in batch["i"]:
                rng = np.random.default_rng([seed, int(i)])
                at = int(i)
                while True:
                    at += int(rng.geometric(p))
                    if at >= n:
                        break
                    a.append(int(i))
                    b.append(at)
            yield pd.DataFrame({"a": a, "b": b}, dtype="int64")

    pairs = people.select("i").mapInPandas(draw, "a long, b long")
    first = people.select(F.col("i").alias("a"), F.col("name").alias("x"))
    second = people.select(F.col("i").alias("b"), F.col("name").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("x", "y", (F.col("a") * n + F.col("b")).alias("ord"))


def attributes(people: DataFrame, jobs: list[str], hobbies: dict[str, list[str]], seed: int = 1) -> DataFrame:
    """name, job, hobby: a job at random; a category at random and a hobby of it. The pools are parameters."""

    def pick(values: Column, what: str) -> Column:
        return F.element_at(values, (F.pmod(F.xxhash64("name", F.lit(what), F.lit(seed)), F.size(values).cast("long")) + 1).cast("int"))

    groups = F.array(*(F.array(*map(F.lit, hobbies[c])) for c in sorted(hobbies)))
    return people.select("name", pick(F.array(*map(F.lit, jobs)), "job").alias("job"), pick(pick(groups, "category"), "hobby").alias("hobby"))


def attribute_facts(chosen: DataFrame, first: int = 0) -> DataFrame:
    """(pred, x, y, ord) of jobs, hobbies and the bag of attribute values."""
    place = F.monotonically_increasing_id() * 4 + first
    kinds = F.array(*(F.struct(F.lit(p).alias("pred"), x.alias("x"), y.alias("y"), (place + i).alias("ord")) for i, (p, x, y) in enumerate((("job", F.col("name"), F.col("job")), ("hobby", F.col("name"), F.col("hobby")), ("attribute", F.col("job"), F.lit(None).cast("string")), ("attribute", F.col("hobby"), F.lit(None).cast("string"))))))
    return chosen.select(F.explode(kinds).alias("f")).select("f.*")


def walk_edges(facts: FactBase, relations: tuple[str, ...] = ASKABLE) -> DataFrame:
    """(x, rel, y, mult): every step a walk can take."""
    out = None
    for r in relations:
        part = facts.relation(r, 2, "counted").select("x", F.lit(r).alias("rel"), "y", "mult")
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Walks:
    """What walks are drawn from: people numbered from 0 in the order of a hash, their relations, their attributes."""

    people: DataFrame
    many: int
    edges: Adjacency
    attributes: Adjacency

    @classmethod
    def of(cls, facts: FactBase, relations: tuple[str, ...] = ASKABLE, seed: int = 1, edges: DataFrame | None = None) -> Walks:
        names = facts.person_names().select("name", F.xxhash64("name", F.lit(seed)).alias("h"))
        people = stored(ranked(names, ["h", "name"], "people").select("name", "i"), "people")
        have = None
        for a in ATTRIBUTES:
            part = facts.frame(a).select("x", F.lit(a).alias("rel"), "y").distinct().withColumn("mult", F.lit(1))
            have = part if have is None else have.unionByName(part)
        edges = edges if edges is not None else walk_edges(facts, relations)
        return cls(people, people.count(), Adjacency.of(edges, "walk-edges"), Adjacency.of(have, "walk-attributes"))

    @property
    def lookup(self) -> DataFrame:
        """People as the small side of a join: with many of them they don't pass the driver."""
        return beside(self.people, self.many)

    def start(self, state: DataFrame, *what: Column | str) -> DataFrame:
        """Each row with a person ``at``, all alike likely."""
        drawn = state.withColumn("__i", below(F.lit(self.many), "start", *what))
        return drawn.join(self.lookup.select(F.col("i").alias("__i"), F.col("name").alias("at")), "__i").drop("__i")


def sample_questions(facts: FactBase, template: Template, n: int, kind: int = 0, seed: int = 1, attempts: int = 100, easy: bool = False, edges: DataFrame | None = None, at_once: int = 10, walks: Walks | None = None) -> DataFrame:
    """qid, type, question, query, answer of up to ``n`` questions of one template.

    The goals are walked from the last to the first: a person at random, then steps weighted by
    their derivations. All questions and ``at_once`` attempts of each walk together, two lookups a goal;
    each question keeps its first attempt that didn't end, and those without one start again until
    ``attempts`` are used up. Questions that never succeed are left out.
    """
    walks = walks or Walks.of(facts, EASY if easy else ASKABLE, seed, edges)
    spark = facts.spark
    if not walks.many:
        raise ValueError("nobody to ask about")
    done = None
    for first in range(0, attempts, at_once):
        todo = spark.range(n).select(F.col("id").cast("int").alias("q")) if done is None else spark.range(n).select(F.col("id").cast("int").alias("q")).join(done.select("q"), "q", "left_anti")
        state = todo.select("q", F.explode(F.sequence(F.lit(first), F.lit(min(attempts, first + at_once) - 1))).alias("a"))
        state = walks.start(state, F.col("q"), F.col("a"), F.lit(kind), F.lit(seed)).select("q", "a", "at")
        state = state.withColumn("values", F.create_map().cast("map<string,string>")).withColumn("words", F.create_map().cast("map<string,string>"))
        for step, goal in enumerate(reversed(template.goals)):
            state = _take(state, goal, walks, kind, seed, step)
        best = state.groupBy("q").agg(F.min_by(F.struct("values", "words"), "a").alias("m")).select("q", "m.values", "m.words")
        found = stored(best, "walked")
        done = found if done is None else done.unionByName(found)
        if first + at_once >= attempts or done.count() == n:
            break
    tokens = F.array(*map(F.lit, template.question))
    goals = F.array(*map(F.lit, template.goals))
    filled = F.transform(goals, lambda g: F.aggregate(F.map_entries("values"), g, lambda t, e: F.replace(t, F.concat(e["key"], F.lit("(")), F.concat(e["value"], F.lit("(")))))
    filled = F.transform(filled, lambda g: F.aggregate(F.map_entries("values"), g, lambda t, e: F.regexp_replace(t, F.concat(e["key"], F.lit(r"(?=[,)])")), F.concat(F.lit('"'), F.regexp_replace(e["value"], r"([\\$])", r"\\$1"), F.lit('"')))))
    text = C.question_text(C.fill_placeholders(tokens, "words"))
    return done.select(C.stable_id(F.lit(seed), F.lit(kind), "q").alias("qid"), F.lit(kind).cast("long").alias("type"), text.alias("question"), filled.alias("query"), F.lit(template.answer).alias("answer"), C.goals_difficulty(filled).alias("difficulty"))


def _take(state: DataFrame, goal: str, walks: Walks, kind: int, seed: int, step: int) -> DataFrame:
    """One goal of the walk: choose an edge (or an attribute) of the person where each walk is."""
    key = re.search(r"<(?:relation|relation_plural|attribute_name)>_\d+", goal)[0]
    name, value = re.search(r"<name>_\d+", goal), re.search(r"<attribute_value>_\d+", goal)
    words = plural_words() if key.startswith("<relation_plural>") else question_words() | ATTRIBUTE_ALIAS
    have = walks.attributes if key.startswith("<attribute_name>") else walks.edges
    chosen = have.choose(state, "at", below(F.col("__total"), F.lit(seed), F.lit(kind), F.lit(step), F.col("q"), F.col("a")))
    put = [F.lit(key), F.col("rel")]
    say = [F.lit(key), C.alias_of(F.col("rel"), words)]
    if name:
        put += [F.lit(name[0]), F.col("at")]
        say += [F.lit(name[0]), F.col("at")]
    if value:
        put += [F.lit(value[0]), F.col("y")]
        say += [F.lit(value[0]), F.col("y")]
    # an attribute's value names the person, the walk stays with them; else it goes on to the target
    onward = F.col("at") if value else F.col("y")
    return chosen.select("q", "a", onward.alias("at"), F.map_concat("values", F.create_map(*put)).alias("values"), F.map_concat("words", F.create_map(*say)).alias("words"))


def answered(facts: FactBase, questions: DataFrame, template: Template, traced: bool = False) -> DataFrame:
    """The questions of one template with their sorted answers: solutions, an array.

    With ``traced`` also traces: a JSON array of the distinct bindings. The constants of all instances
    are read back from their goals; instances of the same relation names share a plan, which binds each
    question's answers and traces at once.
    """
    rows = questions.select("qid", "query").collect()  # at most what one template was asked for
    quoted = re.compile(r'"((?:[^"\\]|\\.)*)"')
    shapes: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for r in rows:
        consts: list[str] = []
        shape = tuple(quoted.sub(lambda m: (consts.append(m[1]), f"P_{len(consts)}")[1], g) for g in r["query"])
        shapes.setdefault(shape, []).append((r["qid"], *consts))
    none = {"solutions": F.array().cast("array<string>"), **({"traces": F.lit("[]")} if traced else {})}
    out = None
    for shape, asked in shapes.items():
        params = facts.spark.createDataFrame(asked, ", ".join(["qid string", *(f"P_{i} string" for i in range(1, len(asked[0])))]))
        bound = evaluate(facts, list(reversed(shape)), params)
        found = [values_of(template.answer).alias("solutions")]
        if traced:
            names = [c for c in bound.columns if c not in params.columns]
            found.append(F.concat(F.lit("["), F.array_join(traces_of(names), ", "), F.lit("]")).alias("traces"))
        part = bound.groupBy("qid").agg(*found)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return questions.withColumns(none)
    return questions.join(out, "qid", "left").withColumns({c: F.coalesce(c, empty) for c, empty in none.items()})


def generate(spark: SparkSession, trees: int = 1, seed: int = 1, friend_seed: int = 1, friends: float = 3.0, rules: Rules | None = None, jobs: list[str] | None = None, hobbies: dict[str, list[str]] | None = None) -> FactBase:
    """A universe's facts: families, friendships, jobs and hobbies."""
    jobs = jobs or [f"{spelled(i, 2).lower()}er" for i in range(64)]
    hobbies = hobbies or {f"kind {k}": [f"{spelled(16 * k + i, 2).lower()}ing" for i in range(16)] for k in range(8)}
    people = family_trees(spark, trees, seed, rules).persist()
    family = family_facts(people)
    n = people.count()
    from pyspark.sql import Window as W

    starts = people.groupBy("tree").agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.sum("m").over(W.orderBy("tree")) - F.col("m"))
    numbered = people.join(starts, "tree").select("name", (F.col("before") + F.col("idx")).alias("i"))
    edges = friendships(numbered, n, friends, friend_seed).select(F.lit("friend_").alias("pred"), "x", "y", F.col("ord").cast("long").alias("ord"))
    chosen = attribute_facts(attributes(people, jobs, hobbies, seed))
    return FactBase(spark, family.unionByName(edges).unionByName(chosen), {"attribute": 1, "friend_": 2})


def question_templates(depth: int = 6) -> list[Template]:
    return templates(depth)
