"""Kin facts over the driver's tables, and the relations' queries with SQL written rule by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinquery.plans.facts import FactBase
from kinquery.plans.relations import RELATIONS
from kinquery.runtime import stored, table


def facts(spark: SparkSession, sf_dir: str) -> FactBase:
    """People are customers: even keys male, odd ones female; 2m and 2m+1 are a couple."""
    k = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").select(k.alias("id"), "c_mktsegment")
    gender = people.select(F.col("id").alias("x"), F.when(F.col("id") % 2 == 0, "male").otherwise("female").alias("y"), F.col("id").alias("ord"))
    born = people.where("id >= 16 and id % 5 <> 3").select("id", F.col("id") % 2, ((F.col("id") - F.col("id") % 2) / 4).cast("long").alias("h"))
    couple = F.when(F.col("id") % 2 == 0, F.col("h")).when(F.col("h") % 4 < 2, F.col("h") + 2).otherwise(F.col("h") - 2)
    pairs = born.select("id", couple.alias("pc"))
    parent = pairs.select(F.col("id").alias("x"), F.explode(F.array(F.col("pc") * 2, F.col("pc") * 2 + 1)).alias("y")).select("x", "y", (F.col("x") * 2 + F.col("y") % 2).alias("ord"))
    last = people.agg(F.max("id").alias("last"))
    offsets = F.array(k * 0 + k + 1 + k % 7, k + 11 + k % 5)
    friend = table(spark, sf_dir, "customer").select(k.alias("x"), F.posexplode(offsets).alias("p", "y")).crossJoin(F.broadcast(last)).where("y <= last").select("x", "y", (F.col("x") * 2 + F.col("p")).alias("ord"))
    job = people.select(F.col("id").alias("x"), F.col("c_mktsegment").alias("y"), F.col("id").alias("ord"))
    dob = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("x")).agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("y")).withColumn("ord", F.col("x"))
    person = people.select(F.col("id").alias("x"), F.lit("person").alias("y"), F.col("id").alias("ord"))
    attribute = people.select(F.col("c_mktsegment").alias("x"), F.col("id").alias("ord"))
    return FactBase.of_frames(spark, {"type": person, "gender": gender, "parent": parent, "friend_": friend, "job": job, "dob": dob, "attribute": attribute})


BASE_SQL = """
    gender AS (SELECT CAST(c_custkey AS VARCHAR) AS x, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS y FROM customer),
    born AS (SELECT c_custkey AS id, c_custkey % 2 AS sex, (c_custkey - c_custkey % 2) // 4 AS h FROM customer WHERE c_custkey >= 16 AND c_custkey % 5 <> 3),
    couple AS (SELECT id, CASE WHEN sex = 0 THEN h WHEN h % 4 < 2 THEN h + 2 ELSE h - 2 END AS pc FROM born),
    parent AS (SELECT CAST(id AS VARCHAR) AS x, CAST(pc * 2 AS VARCHAR) AS y FROM couple UNION ALL SELECT CAST(id AS VARCHAR), CAST(pc * 2 + 1 AS VARCHAR) FROM couple),
    friend_ AS (
        SELECT CAST(x AS VARCHAR) AS x, CAST(y AS VARCHAR) AS y FROM (
            SELECT c_custkey AS x, c_custkey + 1 + c_custkey % 7 AS y FROM customer UNION ALL SELECT c_custkey, c_custkey + 11 + c_custkey % 5 FROM customer)
        WHERE y <= (SELECT max(c_custkey) FROM customer)),
    job AS (SELECT CAST(c_custkey AS VARCHAR) AS x, c_mktsegment AS y FROM customer),
    dob AS (SELECT CAST(o_custkey AS VARCHAR) AS x, strftime(min(o_orderdate), '%Y-%m-%d') AS y FROM orders GROUP BY o_custkey)"""

#: name: (names it stands on, SQL of its derivations).
_G = "SELECT r.x, r.y FROM {0} r JOIN gender g ON g.x = r.y AND g.y = '{1}'"
_C = "SELECT a.x, b.y FROM {0} a JOIN {1} b ON b.x = a.y"
_COUSIN = "SELECT a.x, b.x AS y FROM parent a JOIN {0} s ON s.x = a.y JOIN parent b ON b.y = s.y{1} WHERE a.x <> b.x"
RULES: dict[str, tuple[tuple[str, ...], str]] = {
    "sibling": ((), "SELECT a.x, b.x AS y FROM parent a JOIN parent b ON a.y = b.y WHERE a.x <> b.x"),
    "married": ((), "SELECT a.y AS x, b.y AS y FROM parent a JOIN parent b ON a.x = b.x WHERE a.y <> b.y"),
    "child": ((), "SELECT y AS x, x AS y FROM parent"),
    "grandparent": ((), _C.format("parent", "parent")),
    "friend": ((), "SELECT x, y FROM friend_ UNION ALL SELECT y, x FROM friend_"),
    **{n: ((b,), _G.format(b, g)) for n, b, g in (
        ("sister", "sibling", "female"), ("brother", "sibling", "male"), ("mother", "parent", "female"), ("father", "parent", "male"),
        ("son", "child", "male"), ("daughter", "child", "female"), ("wife", "married", "female"), ("husband", "married", "male"),
        ("grandmother", "grandparent", "female"), ("grandfather", "grandparent", "male"), ("granddaughter", "grandchild", "female"), ("grandson", "grandchild", "male"),
        ("great_grandmother", "great_grandparent", "female"), ("great_grandfather", "great_grandparent", "male"),
        ("great_granddaughter", "great_grandchild", "female"), ("great_grandson", "great_grandchild", "male"),
        ("female_cousin", "cousin", "female"), ("male_cousin", "cousin", "male"))},
    "grandchild": (("grandparent",), "SELECT y AS x, x AS y FROM grandparent"),
    "great_grandparent": (("grandparent",), _C.format("grandparent", "parent")),
    "great_grandchild": (("great_grandparent",), "SELECT y AS x, x AS y FROM great_grandparent"),
    "cousin": (("sibling",), _COUSIN.format("sibling", "")),
    **{n: ((a, b), _C.format(a, b)) for n, a, b in (
        ("niece", "sibling", "daughter"), ("nephew", "sibling", "son"), ("great_aunt", "grandparent", "sister"), ("great_uncle", "grandparent", "brother"),
        ("second_aunt", "great_grandparent", "sister"), ("second_uncle", "great_grandparent", "brother"), ("aunt", "parent", "sister"), ("uncle", "parent", "brother"),
        ("mother_in_law", "married", "mother"), ("father_in_law", "married", "father"), ("son_in_law", "child", "husband"), ("daughter_in_law", "child", "wife"),
        ("sister_in_law", "married", "sister"), ("brother_in_law", "married", "brother"))},
    **{f"{s}_second_cousin": (("cousin",), _COUSIN.format("cousin", f" JOIN gender g ON g.x = b.x AND g.y = '{s}'")) for s in ("female", "male")},
    **{f"{s}_first_cousin_once_removed": (("cousin", c), _C.format("cousin", c) + " WHERE a.x <> b.y") for s, c in (("female", "daughter"), ("male", "son"))},
}


def with_rules(*names: str) -> str:
    """WITH clause that has the base facts and the rules the names stand on."""
    need: list[str] = []

    def add(name: str) -> None:
        if name in RULES and name not in need:
            for other in RULES[name][0]:
                add(other)
            need.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join([BASE_SQL.strip(), *(f"{n} AS ({RULES[n][1]})" for n in need)])


def _relation(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return facts(spark, sf_dir).relation(name, 2, "counted").select("x", "y", F.col("mult").cast("long").alias("mult"))

    return query


QUERIES = {f"rel_{n}": _relation(n) for n in ("parent", *RELATIONS)}
ORACLES = {f"rel_{n}": f"{with_rules(n)}\nSELECT x, y, CAST(count(*) AS BIGINT) AS mult FROM {n} GROUP BY x, y" for n in ("parent", *RELATIONS)}


def _query(name: str, sql: str):
    def add(run):
        QUERIES[name], ORACLES[name] = run, sql
        return run

    return add


def _rows_only(name: str):
    def add(run):
        QUERIES[name] = run
        return run

    return add


def _joined(c: str = "answer"):
    return F.array_join(F.col(c), "|").alias("answer")


def _asked(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    """(qid, P_1): every person is asked about, as a question set."""
    return table(spark, sf_dir, "customer").select(F.concat(F.lit(shape), F.col("c_custkey").cast("string")).alias("qid"), F.col("c_custkey").cast("string").alias("P_1"))


_ASKED = "asked AS (SELECT CAST(c_custkey AS VARCHAR) AS p FROM customer)"
_LIST = "string_agg(DISTINCT {0}, '|' ORDER BY {0})"


@_query("q_relation_const", f"{with_rules('grandchild')} SELECT coalesce({_LIST.format('y')}, '') AS answer FROM grandchild WHERE x = '8'")
def q_relation_const(spark, sf_dir):
    return facts(spark, sf_dir).answer(['grandchild("8", Y_2)'], "Y_2").select(_joined())


@_query("q_chain_2", f"{with_rules('daughter', 'sibling')}, {_ASKED} SELECT 'a' || p AS qid, {_LIST.format('d.y')} AS answer FROM asked JOIN sibling s ON s.x = p JOIN daughter d ON d.x = s.y GROUP BY p")
def q_chain_2(spark, sf_dir):
    return facts(spark, sf_dir).answer(["daughter(Y_4, Y_2)", "sibling(P_1, Y_4)"], "Y_2", _asked(spark, sf_dir, "a"), ["qid"]).select("qid", _joined())


@_query("q_chain_4", f"{with_rules('friend', 'mother', 'child')}, {_ASKED} SELECT 'c' || p AS qid, {_LIST.format('j.y')} AS answer FROM asked JOIN friend f ON f.x = p JOIN mother m ON m.x = f.y JOIN child c ON c.x = m.y JOIN job j ON j.x = c.y GROUP BY p")
def q_chain_4(spark, sf_dir):
    goals = ["job(Y_6, Y_2)", "child(Y_8, Y_6)", "mother(Y_10, Y_8)", "friend(P_1, Y_10)"]
    return facts(spark, sf_dir).answer(goals, "Y_2", _asked(spark, sf_dir, "c"), ["qid"]).select("qid", _joined())


@_query("q_attr_value", f"{with_rules('sister')} SELECT {_LIST.format('s.y')} AS answer FROM job j JOIN sister s ON s.x = j.x WHERE j.y = 'BUILDING'")
def q_attr_value(spark, sf_dir):
    return facts(spark, sf_dir).answer(["sister(Y_4, Y_2)", 'job(Y_4, "BUILDING")'], "Y_2").select(_joined())


@_query("q_attr_of_relation", f"{with_rules('father')}, {_ASKED} SELECT 'd' || p AS qid, {_LIST.format('d.y')} AS answer FROM asked JOIN father f ON f.x = p JOIN dob d ON d.x = f.y GROUP BY p")
def q_attr_of_relation(spark, sf_dir):
    return facts(spark, sf_dir).answer(["dob(Y_3, Y_2)", "father(P_1, Y_3)"], "Y_2", _asked(spark, sf_dir, "d"), ["qid"]).select("qid", _joined())


@_query("q_ground", f"{with_rules('sibling')} SELECT CAST(count(*) AS BIGINT) AS holds FROM (SELECT 1 FROM sibling WHERE x = '20' AND y = '21' LIMIT 1)")
def q_ground(spark, sf_dir):
    return facts(spark, sf_dir).query(['sibling("20", "21")']).agg(F.count(F.lit(1)).alias("holds"))


@_query("q_count_const", f"{with_rules('nephew')} SELECT CAST(count(DISTINCT y) AS VARCHAR) AS answer FROM nephew WHERE x = '24'")
def q_count_const(spark, sf_dir):
    return facts(spark, sf_dir).answer(['aggregate_all(count, distinct(nephew("24", Y_1)), Count_1)'], "Count_1").select(_joined())


@_query("q_count_per_binding", f"{with_rules('daughter', 'sibling')}, {_ASKED}, n AS (SELECT p, s.y AS b, count(DISTINCT d.y) AS c FROM asked JOIN sibling s ON s.x = p LEFT JOIN daughter d ON d.x = s.y GROUP BY p, s.y) SELECT 'e' || p AS qid, {_LIST.format('CAST(c AS VARCHAR)')} AS answer FROM n GROUP BY p")
def q_count_per_binding(spark, sf_dir):
    goals = ["aggregate_all(count, distinct(daughter(Y_3, Y_1)), Count_1)", "sibling(P_1, Y_3)"]
    return facts(spark, sf_dir).answer(goals, "Count_1", _asked(spark, sf_dir, "e"), ["qid"]).select("qid", _joined())


@_query("q_count_unbound", f"{with_rules('cousin')} SELECT CAST(count(*) AS BIGINT) AS c FROM (SELECT DISTINCT x, y FROM cousin)")
def q_count_unbound(spark, sf_dir):
    return facts(spark, sf_dir).query("aggregate_all(count, distinct(cousin(X, Y)), C)").select(F.col("C").cast("long").alias("c"))


@_query("q_bag", f"{with_rules('sibling', 'cousin')} SELECT s.x AS X, c.y AS Y, CAST(count(*) AS BIGINT) AS mult FROM sibling s JOIN cousin c ON c.x = s.y WHERE s.x = '40' GROUP BY ALL")
def q_bag(spark, sf_dir):
    rows = facts(spark, sf_dir).query(['sibling("40", B)', "cousin(B, Y)"], bag=True)
    return rows.groupBy(F.lit("40").alias("X"), "Y").agg(F.sum("__mult").cast("long").alias("mult"))


@_query("trace_set", f"{with_rules('child', 'parent')}, {_ASKED} SELECT 'f' || p AS qid, CAST(count(*) AS BIGINT) AS n, max(t) AS last FROM (SELECT DISTINCT p, '{{\"Y_4\":\"' || q.y || '\",\"Y_2\":\"' || c.y || '\"}}' AS t FROM asked JOIN parent q ON q.x = p JOIN child c ON c.x = q.y) GROUP BY p")
def trace_set(spark, sf_dir):
    from kinquery.plans.compiler import evaluate, traces

    kin = facts(spark, sf_dir)
    bound = evaluate(kin, ["parent(P_1, Y_4)", "child(Y_4, Y_2)"], _asked(spark, sf_dir, "f")).select("qid", "Y_4", "Y_2")
    return traces(bound, ["qid"]).select("qid", F.size("traces").cast("long").alias("n"), F.element_at("traces", -1).alias("last"))


@_query("person_scan", "SELECT CAST(c_custkey AS VARCHAR) AS name FROM customer")
def person_scan(spark, sf_dir):
    return facts(spark, sf_dir).person_names()


@_query("attribute_scan", "SELECT c_mktsegment AS value FROM customer")
def attribute_scan(spark, sf_dir):
    return facts(spark, sf_dir).attribute_values()


@_query("gender_unary", "SELECT CAST(c_custkey AS VARCHAR) AS X FROM customer WHERE c_custkey % 2 = 1")
def gender_unary(spark, sf_dir):
    return facts(spark, sf_dir).query("female(X)")


@_query("fact_retract", f"{with_rules()} SELECT x, y FROM parent WHERE x <> '20' AND NOT (y = '8')")
def fact_retract(spark, sf_dir):
    return facts(spark, sf_dir).remove('parent("20", X)', 'parent(_, "8")').frame("parent").select("x", "y")


@_query("fact_add", f"{with_rules()} SELECT x, y, CAST(count(*) AS BIGINT) AS n FROM (SELECT x, y FROM job UNION ALL SELECT '1', 'BUILDING' UNION ALL SELECT '1', 'BUILDING' UNION ALL SELECT 'new', 'cook') GROUP BY x, y")
def fact_add(spark, sf_dir):
    kin = facts(spark, sf_dir).add('job("1", "BUILDING").', "job('1', 'BUILDING')", "job(new, cook)")
    return kin.frame("job").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@_query("fact_define", "SELECT CAST(0 AS BIGINT) AS n")
def fact_define(spark, sf_dir):
    return facts(spark, sf_dir).define("nickname/2").query("nickname(X, Y)").agg(F.count(F.lit(1)).alias("n"))


@_query("fact_roundtrip", f"{with_rules()} SELECT 'parent' AS pred, x, y FROM parent UNION ALL SELECT 'job', x, y FROM job UNION ALL SELECT 'attribute', y, NULL FROM job")
def fact_roundtrip(spark, sf_dir):
    from kinquery.sources.fact_files import clauses, parse_lines

    lines = clauses(facts(spark, sf_dir).facts.where("pred in ('parent', 'job', 'attribute')")).select(F.col("clause").alias("value"))
    return parse_lines(lines).select("pred", "x", "y")


@_query("legacy_facts", f"{with_rules()} SELECT 'job(\"' || x || '\", \"' || y || '\"' AS fact FROM job")
def legacy_fact_lines(spark, sf_dir):
    from kinquery.sources.fact_files import clauses, legacy_facts

    return legacy_facts(clauses(facts(spark, sf_dir).facts.where("pred = 'job'")), "clause")


def _sentence_sql() -> str:
    from kinquery.operators.documents import SENTENCES

    parts = []
    for name, (one, more) in SENTENCES.items():
        if name in ("dob", "job", "gender"):
            src = f"SELECT x, y FROM {name}"
        elif name == "hobby":
            continue
        else:
            src = f"SELECT DISTINCT x, y FROM {name}"
        parts.append(f"SELECT x, '{name}' AS pred, count(*) AS n, string_agg(y, ', ' ORDER BY CAST(regexp_extract(y, '^[0-9]+') AS VARCHAR), y) AS ys, '{one}' AS one, '{more or one}' AS more FROM ({src}) GROUP BY x")
    return f"{with_rules(*(s for s in SENTENCES if s in RULES))} SELECT x AS name, pred, CAST(n AS BIGINT) AS n, replace(CASE WHEN n > 1 THEN more ELSE one END, '<subject>', x) AS head, CAST(list_sort(string_split(ys, ', ')) AS VARCHAR) AS targets FROM ({' UNION ALL '.join(parts)})"


@_query("article_sentences", _sentence_sql())
def article_sentences(spark, sf_dir):
    from kinquery.operators.documents import SENTENCES, sentences

    rows = sentences(facts(spark, sf_dir))
    pred = F.get(F.array(*map(F.lit, SENTENCES)), F.col("place"))
    head = F.regexp_extract("sentence", r"^(.*? (?:is|are)) ", 1)
    said = F.array_sort(F.split(F.regexp_replace("sentence", r"^.*? (?:is|are) |\.$", ""), ", "))
    return rows.select("name", pred.alias("pred"), F.size("facts").cast("long").alias("n"), head.alias("head"), F.concat(F.lit("["), F.array_join(said, ", "), F.lit("]")).alias("targets"))


@_query("article_full", f"""{with_rules('brother', 'friend')}, o AS (
    SELECT x, y, min(k) AS k FROM (SELECT x, y, x || '' AS s, CAST(x AS BIGINT) * 2 + (CAST(y AS BIGINT) - CAST(x AS BIGINT) >= 11)::INT AS k, 0 AS c FROM friend_) GROUP BY x, y),
  f AS (SELECT x, y, 0 AS c, k FROM o UNION ALL SELECT y, x, 1, k FROM o),
  first AS (SELECT x, y, min(c * 100000000000 + k) AS k FROM f GROUP BY x, y)
  SELECT x AS title, CASE WHEN count(*) > 1 THEN 'The friends of ' || x || ' are ' ELSE 'The friend of ' || x || ' is ' END || string_agg(y, ', ' ORDER BY k) || '.' AS friends FROM first GROUP BY x""")
def article_full(spark, sf_dir):
    """Articles of all people; the friends' section shows that targets stand in clause order."""
    from kinquery.operators.documents import articles

    part = F.regexp_extract("article", r"(?s)## Friends\n(.*?)\n\n## Attributes", 1)
    return articles(facts(spark, sf_dir)).select("title", part.alias("friends")).where("friends <> ''")


@_query("difficulty", "SELECT c_custkey AS k, CAST([4, 2, 2, 5][c_custkey % 4 + 1] AS BIGINT) AS difficulty FROM customer")
def difficulty(spark, sf_dir):
    """Goal lists of four shapes about the customers."""
    from kinquery.functions.columns import goals_difficulty

    name = F.concat(F.lit('"'), "c_name", F.lit('"'))
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    lists = F.array(
        F.array(F.lit("cousin(Y_4, Y_2)"), said("job(Y_4, ", name, ")")), F.array(F.lit("aggregate_all(count, distinct(cousin(Y_3, Y_1)), Count_1)"), said("friend(", name, ", Y_3)")),
        F.array(said("niece(", name, ", Z)")), F.array(said("female_second_cousin(X, ", name, ")")),
    )
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), goals_difficulty(F.get(lists, (F.col("c_custkey") % 4).cast("int"))).alias("difficulty"))


for _depth in (6, 8, 10, 20):

    @_query(f"templates_d{_depth}", f"SELECT 'Who is' AS head, 'Y_2' AS answer, CAST({_depth} - 3 AS BIGINT) AS n UNION ALL SELECT 'What is', 'Y_2', {_depth} - 4 UNION ALL SELECT 'How many', 'Count_1', {_depth} - 3")
    def _templates(spark, sf_dir, depth=_depth):
        from kinquery.functions.templates import templates

        rows = [(" ".join(t.question), t.answer) for t in templates(depth)]
        found = spark.createDataFrame(rows, "question string, answer string")
        return found.groupBy(F.substring_index("question", " ", 2).alias("head"), "answer").agg(F.count(F.lit(1)).alias("n"))


@_query("predicted_prefixes", f"{with_rules('sister', 'child')} SELECT CAST(1 AS BIGINT) AS n, CAST(count(DISTINCT y) AS BIGINT) AS bindings FROM sister WHERE x = '20' UNION ALL SELECT 2, count(*) FROM (SELECT DISTINCT s.y, c.y FROM sister s JOIN child c ON c.x = s.y WHERE s.x = '20') UNION ALL SELECT 3, -1")
def predicted_prefixes(spark, sf_dir):
    from kinquery.plans.compiler import run_prefixes

    found = run_prefixes(facts(spark, sf_dir), ['sister("20", A)', "child(A, B)", "aunties(B, C)", "child(C, D)"])
    rows = [(i + 1, len(r) if e is None else -1) for i, (_, r, e) in enumerate(found)]
    return spark.createDataFrame(rows, "n long, bindings long")


@_query("predicted_answers", f"{with_rules('sister', 'child')} SELECT 'a' AS id, string_agg(DISTINCT y, ',' ORDER BY y) AS pred, FALSE AS failed FROM sister WHERE x = '20' UNION ALL SELECT 'b', CAST(count(DISTINCT y) AS VARCHAR), FALSE FROM child WHERE x = '8' UNION ALL SELECT 'c', NULL, TRUE UNION ALL SELECT 'd', NULL, TRUE")
def predicted_answers(spark, sf_dir):
    from kinquery.plans.compiler import run_predicted

    rows = [("a", 'thinking...\n`sister("20", A).`'), ("b", 'aggregate_all(count, distinct(child("8", Y)), C)'), ("c", "sister(20"), ("d", "nosuch(A, B)")]
    found = run_predicted(facts(spark, sf_dir), spark.createDataFrame(rows, "id string, prolog_query string"))
    return found.select("id", "pred", F.col("error").isNotNull().alias("failed"))


@_query("graph_frames", f"{with_rules()} SELECT y AS source, x AS target, CASE WHEN CAST(x AS BIGINT) % 2 = 0 THEN 'lightblue' ELSE 'pink' END AS colour FROM parent")
def graph_frames(spark, sf_dir):
    kin = facts(spark, sf_dir)
    return kin.edges().join(kin.nodes().withColumnRenamed("name", "target"), "target").select("source", "target", "colour")


@_rows_only("gen_tree")
def gen_tree(spark, sf_dir):
    from kinquery.operators.generation import family_trees

    return family_trees(spark, 20, seed=1)


@_rows_only("gen_friends")
def gen_friends(spark, sf_dir):
    from kinquery.operators.generation import friendships

    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.col("c_name").alias("name"))
    return friendships(people, people.count(), 3.0)


@_rows_only("gen_attributes")
def gen_attributes(spark, sf_dir):
    from kinquery.operators.generation import attributes

    return attributes(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), ["cook", "nurse", "clerk"], {"out": ["hiking", "rowing"], "in": ["chess"]})


@_rows_only("walk_questions")
def walk_questions(spark, sf_dir):
    from kinquery.functions.templates import templates
    from kinquery.operators.generation import answered, sample_questions, walk_edges
    from kinquery.plans.relations import EASY

    kin = facts(spark, sf_dir)
    edges = stored(walk_edges(kin, EASY), "edges")
    t = templates(6)[0]
    asked = stored(sample_questions(kin, t, 5, 0, edges=edges, at_once=5, attempts=20), "asked")
    return answered(kin, asked, t)
