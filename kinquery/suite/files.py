"""Sources and sinks, written and read again, and the rules that generated universes keep, with SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinquery.runtime import scratch_path, table
from kinquery.sources import records as S
from kinquery.suite.kin import facts, with_rules

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str):
    def add(run):
        QUERIES[name], ORACLES[name] = run, sql
        return run

    return add


def put(spark: SparkSession, path: str, text: str) -> str:
    """Write one file into whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    return path


def _nation_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_name").alias("title"), F.concat(F.lit("# "), "n_name", F.lit('\n\n"ä\\'), "n_name").alias("article"), F.array(F.concat(F.lit('region("'), "n_name", F.lit('", '), "n_regionkey", F.lit(").")), F.lit("x")).alias("facts"))


@_query("articles_json", "SELECT n_name AS title, '# ' || n_name || chr(10) || chr(10) || '\"ä\\' || n_name AS article, 'region(\"' || n_name || '\", ' || n_regionkey || ').|x' AS facts FROM nation")
def articles_json(spark, sf_dir):
    path = scratch_path(spark, "articles")
    S.write_articles(_nation_articles(spark, sf_dir), path)
    return S.read_corpus(spark, path, lines=True).select("title", "article", F.array_join("facts", "|").alias("facts"))


@_query("articles_text", "SELECT n_name AS title, '# ' || n_name || chr(10) || chr(10) || '\"ä\\' || n_name || chr(10) AS article FROM nation")
def articles_text(spark, sf_dir):
    """An article a file in a folder of its title."""
    path = scratch_path(spark, "articles")
    S.write_articles(_nation_articles(spark, sf_dir), path, "text")
    texts = spark.read.text(f"{path}/articles", wholetext=True)
    return texts.select("title", F.col("value").alias("article"))


@_query("questions_by_type", "SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_custkey % 3 AS BIGINT) AS type, c_name || '?' AS question, c_mktsegment AS answer FROM customer")
def questions_by_type(spark, sf_dir):
    """Question files of a folder a type; the traces under their older name."""
    c = table(spark, sf_dir, "customer")
    asked = c.select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") % 3).alias("type"), F.concat("c_name", F.lit("?")).alias("question"), F.lit("[]").alias("intermediate_answers"), F.array("c_mktsegment").alias("answer"))
    path = scratch_path(spark, "questions")
    S.write_questions(asked, path)
    back = spark.read.option("basePath", path).json(path).select("id", F.col("type").cast("long").alias("type"))
    read = S.read_questions(spark, f"{path}/type=*", lines=True).where("solution_traces = '[]'").drop("type")
    return read.join(back, "id").select("id", "type", "question", F.array_join("answer", "|").alias("answer"))


@_query("retriever_files", "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(doc_id AS VARCHAR) AS title, md5(text) AS body FROM documents")
def retriever_files(spark, sf_dir):
    """Passages as JSON lines, and read as an external retriever's corpus."""
    path = scratch_path(spark, "passages")
    S.export_passages(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("title"), F.col("text").alias("article")), path)
    return S.read_passages(spark, path).select("id", "title", F.md5("body").alias("body"))


@_query("retriever_questions", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS question, n_name AS golden_answers FROM nation")
def retriever_question_file(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("question"), F.array("n_name").alias("answer"))
    path = scratch_path(spark, "questions")
    S.export_questions(n, path)
    return spark.read.schema("id string, question string, golden_answers array<string>").json(path).withColumn("golden_answers", F.array_join("golden_answers", "|"))


@_query("predictions_kept", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN step = 'kept' THEN 'first' ELSE 'second' END AS pred, step FROM customer, (VALUES ('kept'), ('forced')) t(step)")
def predictions_kept(spark, sf_dir):
    """A file that is there is left as it is, unless forced."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    kept, forced = scratch_path(spark, "kept"), scratch_path(spark, "forced")
    for path, again in ((kept, False), (forced, True)):
        S.write_predictions(c.withColumn("pred", F.lit("first")), path)
        S.write_predictions(c.withColumn("pred", F.lit("second")), path, force=again)
    read = lambda path, step: spark.read.schema("id string, pred string").json(path).withColumn("step", F.lit(step))
    return read(kept, "kept").unionByName(read(forced, "forced"))


@_query("prediction_files", "SELECT CAST(r_regionkey AS VARCHAR) AS id, CAST(r_regionkey AS INTEGER) AS batch_in_name, r_name AS pred, 'hi ' || r_name AS said FROM region")
def prediction_files(spark, sf_dir):
    """A file a batch, whose number stands in its name, with the talk inside."""
    root = scratch_path(spark, "preds")
    for key, name in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():  # five rows
        talk = f'{{"messages":[{{"role":"user","content":[{{"type":"text","text":"hi {name}"}}]}}],"uid":"u"}}'
        put(spark, f"{root}/split=a__model_name=m__bs=10__bn={key}__seed=1.json", f'{{"{key}": {{"true": ["a"], "pred": "{name}", "interaction": {talk}, "metadata": {{"model": "m", "batch_number": {key}}}}}}}')
    return S.read_predictions(spark, f"{root}/*.json").select("id", "batch_in_name", "pred", F.col("interaction.messages")[0]["content"][0]["text"].alias("said"))


@_query("conversation_files", "SELECT 'u' || r_regionkey AS uid, CAST(2 AS BIGINT) AS n, r_name AS last FROM region")
def conversation_files(spark, sf_dir):
    root = scratch_path(spark, "talks")
    for key, name in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():  # five rows
        said = ",\n".join(f'{{"role": "{r}", "content": [{{"type": "text", "text": "{t}"}}]}}' for r, t in (("user", "q"), ("assistant", name)))
        put(spark, f"{root}/{key}.json", f'{{"messages": [\n{said}\n], "uid": "u{key}"}}')
    return S.read_conversations(spark, f"{root}/*.json").select("uid", F.size("messages").cast("long").alias("n"), F.element_at("messages", -1)["content"][0]["text"].alias("last"))


@_query("action_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS id, '[{\"name\":\"Search\",\"argument\":\"' || n_name || '\"}]' AS actions FROM nation")
def action_csv(spark, sf_dir):
    """Action lists as JSON texts of a CSV; other nested columns are left out."""
    act = F.array(F.struct(F.lit("Search").alias("name"), F.col("n_name").alias("argument")))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), act.alias("actions"), F.array("n_name").alias("nested"))
    path = scratch_path(spark, "actions")
    S.write_actions(rows, path)
    return spark.read.csv(path, header=True, escape="\\").select("id", "actions")


@_query("timings_csv", "SELECT n_name AS stage FROM nation UNION ALL SELECT 'total'")
def timings_csv(spark, sf_dir):
    took, path = S.Timings(), scratch_path(spark, "timings")
    stages = [r["n_name"] for r in table(spark, sf_dir, "nation").select("n_name").collect()]  # 25 rows
    for stage in (*stages, *stages[:3]):
        with took.stage(stage):
            pass
    took.write(spark, path)
    row = spark.read.csv(path, header=True, inferSchema=True)
    return row.unpivot([], row.columns, "stage", "seconds").where("seconds >= 0").select("stage")


@_query("text_report", "SELECT '| ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation UNION ALL SELECT '| n_name | n_regionkey |' UNION ALL SELECT '|---|---|'")
def text_report(spark, sf_dir):
    from kinquery.operators.shapes import text_table

    lines = text_table(table(spark, sf_dir, "nation").select("n_name", "n_regionkey")).split("\n")
    return spark.createDataFrame([(x,) for x in lines], "line string")


@_query("hobby_csv", "SELECT p_type AS category, count(*) AS n, min(lower(p_name)) AS first FROM part GROUP BY 1")
def hobby_csv(spark, sf_dir):
    path = scratch_path(spark, "hobbies")
    table(spark, sf_dir, "part").select(F.col("p_name").alias("Hobby-name"), F.col("p_type").alias("Type")).write.csv(path, header=True)
    return S.read_hobbies(spark, path).select("category", F.size("hobbies").cast("long").alias("n"), F.get("hobbies", F.lit(0)).alias("first"))


@_query("pool_file", "SELECT n_name AS name FROM nation")
def pool_file(spark, sf_dir):
    names = [r.n_name for r in table(spark, sf_dir, "nation").select("n_name").collect()]  # 25 rows
    path = put(spark, scratch_path(spark, "pool"), "# a pool\n\n" + "\n".join(f" {n}  # a name" for n in names) + "\n")
    return spark.createDataFrame([(n,) for n in S.read_pool(spark, path)], "name string")


@_query("limits_file", "SELECT r_name AS server, n_name AS model, CAST(n_nationkey % 3 AS INTEGER) AS tier, CAST(n_nationkey * 1000 + 1 AS INTEGER) AS rpm, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 7 END AS INTEGER) AS tpm FROM nation JOIN region ON r_regionkey = n_regionkey")
def limits_file(spark, sf_dir):
    """A file of limits with a server a region and a model a nation; every other one has no limit of tokens."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("r_name", "n_name").collect()  # 25 rows
    lines: list[str] = []
    for n in nations:
        if f"{n['r_name']}:" not in lines:
            lines.append(f"{n['r_name']}:")
        lines += [f'  "{n["n_name"]}":  # a model', f"    usage_tier={n['n_nationkey'] % 3}:", f"      RPM: {n['n_nationkey'] * 1000 + 1:_}", *([] if n["n_nationkey"] % 2 else ["      TPM: 7"])]
    found = S.read_limits(spark, put(spark, scratch_path(spark, "limits"), "\n".join(lines) + "\n"))
    return found.select("server", "model", F.col("tier").cast("int").alias("tier"), F.col("rpm").cast("int").alias("rpm"), F.col("tpm").cast("int").alias("tpm"))


@_query("facts_from_disk", f"{with_rules()} SELECT 'parent' AS pred, x, y FROM parent UNION ALL SELECT 'job', x, y FROM job")
def facts_from_disk(spark, sf_dir):
    """Facts saved as clauses and consulted again, in two files."""
    from kinquery.plans.facts import FactBase
    from kinquery.sources.fact_files import write_facts

    kin, paths = facts(spark, sf_dir), [scratch_path(spark, "parents"), scratch_path(spark, "jobs")]
    for path, pred in zip(paths, ("parent", "job"), strict=True):
        write_facts(kin.facts.where(F.col("pred") == pred), path)
    again = FactBase.from_disk(spark, paths[0]).consult(paths[1])
    return again.frame("parent").select(F.lit("parent").alias("pred"), "x", "y").unionByName(again.frame("job").select(F.lit("job").alias("pred"), "x", "y"))


@_query("split_of_less_depth", "SELECT 'corpus' AS part, n_name AS value FROM nation UNION ALL SELECT 'database', 'parent(\"a\", \"b\").' UNION ALL SELECT 'questions', CAST(8 AS VARCHAR) UNION ALL SELECT 'without counts', CAST(5 AS VARCHAR) UNION ALL SELECT 'folders', 'depth_10_size_25_seed_1,depth_10_size_50_seed_1'")
def split_of_less_depth(spark, sf_dir):
    """A split that isn't there, taken from one of greater depth: only templates of the lesser one stay."""
    import json

    from kinquery.functions.templates import is_aggregation_question, templates

    root = scratch_path(spark, "splits")
    names = [r.n_name for r in table(spark, sf_dir, "nation").select("n_name").collect()]  # 25 rows
    asked = [{"id": str(i), "question": " ".join(t.question), "template": list(t.question), "answer": [], "is_aggregation_question": is_aggregation_question(" ".join(t.question))} for i, t in enumerate(templates(10))]
    for size in (25, 50):
        base = f"{root}/depth_10_size_{size}_seed_1"
        put(spark, f"{base}/articles.json", json.dumps([{"title": n, "article": n, "facts": []} for n in names]))
        for k in (0, 1):
            put(spark, f"{base}/questions_{k}.json", json.dumps(asked[k::2]))
        put(spark, f"{base}/facts.pl", 'parent("a", "b").')
    found = S.load_split(spark, root, "depth_6_size_25_seed_1")
    fewer = S.load_split(spark, root, "depth_6_size_25_seed_1", exclude_aggregation_questions=True)
    count = lambda df, part: df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(part).alias("part"), "value")
    folders = ",".join(n for n, _ in S.splits_below(spark, root))
    out = found["text_corpus"].where("split = 'depth_10_size_25_seed_1'").select(F.lit("corpus").alias("part"), F.col("title").alias("value"))
    out = out.unionByName(found["database"].select(F.lit("database").alias("part"), F.col("content").alias("value")))
    out = out.unionByName(count(found["qa_pairs"], "questions")).unionByName(count(fewer["qa_pairs"], "without counts"))
    return out.unionByName(spark.createDataFrame([("folders", folders)], "part string, value string"))


@_query("method_families", "SELECT CAST(l_linenumber AS BIGINT) AS k, CASE WHEN l_linenumber % 3 = 0 THEN 'Retrieval' WHEN l_linenumber % 3 = 1 THEN 'Simple' ELSE 'other' END AS family, '_a,_b,k,z' AS columns FROM lineitem")
def method_families(spark, sf_dir):
    from kinquery.operators import evaluation as E

    k = F.col("l_linenumber")
    method = F.when(k % 3 == 0, "rag").when(k % 3 == 1, "cot").otherwise("other")
    rows = table(spark, sf_dir, "lineitem").select(k.cast("long").alias("k"), F.lit(1).alias("_a"), method.alias("z"), F.lit(2).alias("_b"))
    rows = E.by_prefix(rows)
    return rows.select("k", E.method_family("z", {"rag": "Retrieval", "cot": "Simple"}).alias("family"), F.lit(",".join(rows.columns)).alias("columns"))


@_query("word_forms", "SELECT * FROM (VALUES ('great_aunt', 'great-aunt', 'great-aunts'), ('mother_in_law', 'mother-in-law', 'mothers-in-law'), ('male_first_cousin_once_removed', 'male first cousin once removed', 'male first cousins once removed'), ('grandchild', 'grandchild', 'grandchildren'), ('wife', 'wife', 'wives'), ('female_second_cousin', 'female second cousin', 'female second cousins')) t(relation, one, more)")
def word_forms(spark, sf_dir):
    from kinquery.functions.wording import alias, plural

    names = ("great_aunt", "mother_in_law", "male_first_cousin_once_removed", "grandchild", "wife", "female_second_cousin")
    return spark.createDataFrame([(n, alias(n), plural(n)) for n in names], "relation string, one string, more string")


@_query("text_helpers", "SELECT n_nationkey AS k, '<' || n_name AS brackets, n_name || '/b' AS arrow, 'x ' || n_name AS lines, n_name || '?' AS asked, n_name AS named, n_name AS fence FROM nation")
def text_helpers(spark, sf_dir):
    from kinquery.functions import columns as C

    n = F.col("n_name")
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("k"),
        F.concat(F.lit("<"), F.array_join(C.bracketed(F.concat(F.lit("a <"), n, F.lit("> b"))), "|")).alias("brackets"),
        F.array_join(C.arrow_parts(F.concat(F.lit(" "), n, F.lit(" -> b "))), "/").alias("arrow"),
        C.joined_lines(F.concat(F.lit(" x \n\n "), n, F.lit("\n"))).alias("lines"),
        F.array_join(C.listed_questions(F.concat(F.lit("1. "), n, F.lit("?\n- no\n"))), "|").alias("asked"),
        F.array_join(C.names_in(F.concat(F.lit("of "), n), ["FRANCE", "nobody"]), "").alias("found"),
        C.fenced(F.concat(F.lit('"""'), n, F.lit('""" """x"""'))).alias("fence"),
    ).withColumn("named", F.when(F.col("found") == "FRANCE", F.col("found")).otherwise(F.col("fence"))).drop("found")


@_query("stable_ids", "SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM (SELECT md5(c_name || chr(31) || c_custkey) AS h FROM customer)")
def stable_ids(spark, sf_dir):
    from kinquery.functions.columns import stable_id

    return table(spark, sf_dir, "customer").select(stable_id("c_name", F.col("c_custkey").cast("string")).alias("id"))


def _bm25_sql(asked: str) -> str:
    words = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
    return f"""WITH d AS (SELECT doc_id, {words.format('text')} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
      q AS (SELECT DISTINCT item_id, unnest({words.format('text')}) AS t FROM benchmark WHERE {asked}), tf AS (SELECT doc_id, len(w) AS l, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) GROUP BY doc_id, l, t),
      df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
      r AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))) AS score FROM q JOIN tf USING (t) JOIN df USING (t), s GROUP BY item_id, doc_id)
      SELECT item_id, doc_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r) WHERE rank <= 4"""


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))


@_query("bm25_reused", _bm25_sql("TRUE"))
def bm25_reused(spark, sf_dir):
    """An index kept for two searches, each of half of the items."""
    from kinquery.operators.bm25 import Bm25Index

    asked, index = _benchmark(spark, sf_dir), Bm25Index(table(spark, sf_dir, "documents"))
    parts = [index.search(asked.where(f"item_id % 2 = {k}"), 4, "item_id") for k in (0, 1)]
    return parts[0].unionByName(parts[1]).withColumn("score", F.round("score", 5))


@_query("bm25_index_grown", _bm25_sql("TRUE"))
def bm25_index_grown(spark, sf_dir):
    """A stored index of half of the documents to which the others are appended, opened by another session."""
    from kinquery.operators.bm25 import Bm25Index

    docs, path = table(spark, sf_dir, "documents"), scratch_path(spark, "bm25")
    Bm25Index.write(docs.where("doc_id % 2 = 0"), path, buckets=8).add(docs.where("doc_id % 2 = 1"))
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return Bm25Index.open(other, path).search(_benchmark(other, sf_dir), 4, "item_id").withColumn("score", F.round("score", 5))


def _broken(rules: dict[str, DataFrame]) -> DataFrame:
    """rule, n: how many rows break each rule."""
    out = None
    for name, rows in rules.items():
        part = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def _none_of(*rules: str) -> str:
    return " UNION ALL ".join(f"SELECT '{r}' AS rule, CAST(0 AS BIGINT) AS n" for r in rules)


@_query("gen_tree_rules", _none_of("trees", "names", "levels", "parents", "ages", "siblings", "depth", "children", "facts"))
def gen_tree_rules(spark, sf_dir):
    """Grown trees: both parents or none, a mother and a father of the level above, of age, siblings apart or twins."""
    from kinquery.operators.generation import Rules, family_facts, family_trees

    r, trees = Rules(), 60
    people = family_trees(spark, trees, seed=3).persist()
    side = lambda role: people.select("tree", F.col("idx").alias(role), *(F.col(c).alias(f"{role}_{c}") for c in ("female", "level", "dob")))
    both = people.where("mother is not null and father is not null").join(side("mother"), ["tree", "mother"]).join(side("father"), ["tree", "father"])
    years = lambda p: F.months_between(F.col("dob").cast("date"), F.col(f"{p}_dob").cast("date")) / 12
    aged = lambda p: years(p).between(r.min_parent_age - 0.01, r.max_parent_age + 0.01)
    child = people.where("mother is not null").select("tree", "mother", "idx", F.col("dob").cast("date").alias("d"))
    pairs = child.alias("a").join(child.alias("b"), (F.col("a.tree") == F.col("b.tree")) & (F.col("a.mother") == F.col("b.mother")) & (F.col("a.idx") < F.col("b.idx")))
    gap = F.abs(F.datediff("a.d", "b.d"))
    stated = family_facts(people).where("pred = 'parent'").select("x", "y")
    named = both.select("tree", F.col("name").alias("x"), F.explode(F.array("mother", "father")).alias("idx")).join(people.select("tree", "idx", F.col("name").alias("y")), ["tree", "idx"]).select("x", "y")
    size = people.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), (F.max("level") - F.min("level")).alias("depth"))
    return _broken({
        "trees": size.where(F.col("n") > r.max_size + 2).select("n").unionByName(people.select(F.countDistinct("tree").alias("n")).where(F.col("n") != trees)),
        "names": people.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "levels": both.where("level <> mother_level + 1 or level <> father_level + 1"),
        "parents": people.where("(mother is null) <> (father is null)").select("name").unionByName(both.where("not mother_female or father_female").select("name")),
        "ages": both.where(~aged("mother") | ~aged("father")),
        "siblings": pairs.where((gap != 0) & (gap <= r.sibling_days)),
        "depth": size.where(F.col("depth") > r.max_depth),
        "children": child.groupBy("tree", "mother").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > r.max_children),
        "facts": stated.exceptAll(named).unionByName(named.exceptAll(stated)),
    })


@_query("gen_friend_rules", _none_of("people", "self", "twice", "both ways", "mean degree"))
def gen_friend_rules(spark, sf_dir):
    """Friendships: pairs of known people, none with oneself, none twice, and about as many as asked for."""
    from kinquery.operators.generation import friendships

    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.col("c_name").alias("name"))
    n = people.count()
    found = friendships(people, n, 3.0).persist()
    off = found.agg(F.count(F.lit(1)).alias("m")).where(F.abs(F.col("m") - 1.5 * n) > 6 * (1.5 * n) ** 0.5)
    names = people.select("name")
    return _broken({
        "people": found.select(F.explode(F.array("x", "y")).alias("name")).join(names, "name", "left_anti"),
        "self": found.where("x = y"),
        "twice": found.groupBy("x", "y").count().where("count > 1"),
        "both ways": found.alias("a").join(found.alias("b"), (F.col("a.x") == F.col("b.y")) & (F.col("a.y") == F.col("b.x"))),
        "mean degree": off,
    })


@_query("gen_attribute_rules", _none_of("people", "jobs", "hobbies", "facts"))
def gen_attribute_rules(spark, sf_dir):
    from kinquery.operators.generation import attribute_facts, attributes

    jobs, hobbies = ["cook", "nurse", "clerk"], {"out": ["hiking", "rowing"], "in": ["chess"]}
    people = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    chosen = attributes(people, jobs, hobbies).persist()
    stated = attribute_facts(chosen).groupBy("pred").agg(F.count(F.lit(1)).alias("n"))
    n = people.count()
    want = spark.createDataFrame([("job", n), ("hobby", n), ("attribute", 2 * n)], "pred string, n long")
    return _broken({"people": people.exceptAll(chosen.select("name")), "jobs": chosen.where(~F.col("job").isin(jobs)), "hobbies": chosen.where(~F.col("hobby").isin([h for hs in hobbies.values() for h in hs])), "facts": stated.exceptAll(want).unionByName(want.exceptAll(stated))})


@_query("walk_rules", _none_of("answers", "goals", "placeholders", "plan"))
def walk_rules(spark, sf_dir):
    """Walked questions: each has an answer, as the walk had one, and its answers are its own plan's."""
    from kinquery.functions.templates import templates
    from kinquery.operators.generation import Walks, answered, sample_questions
    from kinquery.plans.relations import EASY
    from kinquery.runtime import stored

    kin, t = facts(spark, sf_dir), templates(6)[1]
    asked = stored(sample_questions(kin, t, 12, 1, walks=Walks.of(kin, EASY), at_once=10, attempts=40), "asked")
    found = stored(answered(kin, asked, t), "answered")
    alone = [kin.answer(r["query"], r["answer"]).select(F.lit(r["qid"]).alias("qid"), F.col("answer").alias("alone")) for r in found.collect()]  # twelve questions
    differ = found.join(reduce(DataFrame.unionByName, alone), "qid", "left").where(~F.array_sort("solutions").eqNullSafe(F.array_sort("alone")))
    return _broken({"answers": found.where("size(solutions) = 0"), "goals": found.where(F.size("query") != len(t.goals)), "placeholders": found.where("question rlike '<|>' or array_join(query, ' ') rlike '<|>'"), "plan": differ})


@_query("walk_steps", _none_of("edges", "people", "starts", "relations"))
def walk_steps(spark, sf_dir):
    """Twenty steps a person from people drawn at random: edges exist, and people and relations come as often as they should.

    Bounds: each person within 36 of the 20 starts expected (8 standard deviations), each relation within
    6 standard deviations of what the weights of the drawn people's edges give.
    """
    from kinquery.operators.generation import Walks, walk_edges
    from kinquery.operators.walks import below
    from kinquery.plans.relations import EASY
    from kinquery.runtime import stored

    kin = facts(spark, sf_dir)
    edges = stored(walk_edges(kin, EASY), "edges")
    walks = Walks.of(kin, edges=edges)
    state = walks.people.select(F.col("i").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("a"))
    starts = stored(walks.start(state, F.col("q"), F.col("a")), "starts")
    drawn = stored(walks.edges.choose(starts, "at", below(F.col("__total"), "step", F.col("q"), F.col("a"))), "steps")
    often = walks.people.join(starts.groupBy(F.col("at").alias("name")).agg(F.count(F.lit(1)).alias("n")), "name", "left")
    total = edges.groupBy("x").agg(F.sum("mult").alias("total"))
    share = edges.groupBy("x", "rel").agg(F.sum("mult").alias("mult")).join(total, "x").select("x", "rel", (F.col("mult") / F.col("total")).alias("p"))
    mean = starts.groupBy(F.col("at").alias("x")).agg(F.count(F.lit(1)).alias("c")).join(share, "x").groupBy("rel").agg(F.sum(F.col("c") * F.col("p")).alias("m"), F.sum(F.col("c") * F.col("p") * (1 - F.col("p"))).alias("v"))
    by_rel = mean.join(drawn.groupBy("rel").agg(F.count(F.lit(1)).alias("n")), "rel", "left")
    return _broken({
        "edges": drawn.join(edges.select(F.col("x").alias("at"), "rel", "y"), ["at", "rel", "y"], "left_anti"),
        "people": starts.join(walks.lookup.select(F.col("name").alias("at")), "at", "left_anti"),
        "starts": often.where(F.abs(F.coalesce("n", F.lit(0)) - 20) > 36),
        "relations": by_rel.where(F.abs(F.coalesce("n", F.lit(0)) - F.col("m")) > 6 * F.sqrt("v") + 1),
    })


_CHAIN = ("friend", "parent", "sibling", "child")


@_query("bindings_sampled", f"""{with_rules(*_CHAIN)}, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT x, y FROM friend) a JOIN (SELECT DISTINCT x, y FROM parent) b ON b.x = a.y JOIN (SELECT DISTINCT x, y FROM sibling) c ON c.x = b.y JOIN (SELECT DISTINCT x, y FROM child) d ON d.x = c.y)
    SELECT CAST(n AS BIGINT) AS bindings, CAST(least(n, 1000) AS BIGINT) AS drawn, CAST(least(n, 1000) AS BIGINT) AS different, CAST(least(n, 1000) AS BIGINT) AS hold FROM n""")
def bindings_sampled(spark, sf_dir):
    """A thousand bindings of four goals at random without any twice: how many there are, and that each drawn one holds."""
    from kinquery.operators.walks import chain_draws
    from kinquery.runtime import stored

    kin = facts(spark, sf_dir)
    total, drawn = chain_draws([kin.relation(r) for r in _CHAIN], 1000)
    drawn = stored(drawn, "drawn")
    held = drawn
    for k, r in enumerate(_CHAIN):
        held = held.join(kin.relation(r).select(F.col("x").alias(f"p{k}"), F.col("y").alias(f"p{k + 1}")), [f"p{k}", f"p{k + 1}"], "left_semi")
    names = [f"p{k}" for k in range(len(_CHAIN) + 1)]
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    return spark.range(1).select(F.lit(total).cast("long").alias("bindings")).crossJoin(count(drawn, "drawn")).crossJoin(count(drawn.select(*names).distinct(), "different")).crossJoin(count(held, "hold"))


@_query("names_assigned", f"{_none_of('people', 'twice', 'first', 'last', 'too few')} UNION ALL SELECT 'named', (SELECT count(*) FROM customer)")
def names_assigned(spark, sf_dir):
    """Customers get pairs of part and supplier names, each pair once; a pool that is too small is an error."""
    from kinquery.operators.generation import assigned_names
    from kinquery.operators.walks import ranked
    from kinquery.runtime import stored

    people = ranked(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], "people")
    firsts, lasts = table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1).alias("name")), table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    enough = firsts.select("name").unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))).unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).where("c_custkey % 10 = 0"))
    named = stored(assigned_names(people, enough, lasts), "named")
    try:
        assigned_names(people, firsts.limit(1), lasts.limit(1))
        refused = spark.range(1)
    except ValueError:
        refused = spark.range(0)
    rules = _broken({
        "people": people.join(named, "c_custkey", "left_anti"),
        "twice": named.groupBy("first", "last").count().where("count > 1"),
        "first": named.join(enough.select(F.col("name").alias("first")), "first", "left_anti"),
        "last": named.join(lasts.select(F.col("name").alias("last")), "last", "left_anti"),
        "too few": refused,
    })
    return rules.unionByName(named.agg(F.count(F.lit(1)).alias("n")).select(F.lit("named").alias("rule"), "n"))
