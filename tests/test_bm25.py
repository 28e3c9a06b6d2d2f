"""Pruned BM25 against scores of all pairs; the stored index; walks and draws by prefix sums."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinquery.operators.bm25 import Bm25Index, bm25
from kinquery.operators.walks import Adjacency, chain_draws, last_at_most, permuted, ranked


def by_hand(docs, queries, k, k1=1.5, b=0.75):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    bags = {d: Counter(words(t)) for d, t in docs}
    mean = sum(sum(c.values()) for c in bags.values()) / len(bags) or 1.0
    df = Counter(w for c in bags.values() for w in c)
    out = []
    for q, text in queries:
        scores = {}
        for d, c in bags.items():
            hit = [w for w in set(words(text)) if w in c]
            if hit:
                scores[d] = sum(math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * sum(c.values()) / mean)) for w in hit)
        best = sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:k]
        out += [(q, d, round(scores[d], 6), i) for i, d in enumerate(best, 1)]
    return sorted(out)


def corpus(seed, n):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    text = lambda size: " ".join(rnd.choices(vocab, weights, k=size))
    docs = [(i, text(rnd.choice([1, 5, 40, 200, 900]))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "the the"), (n + 3, "w1 " * 3000)]
    docs += [(n + 10 + i, docs[3][1]) for i in range(6)]  # ties
    queries = [(i, text(rnd.choice([1, 3, 30]))) for i in range(25)] + [(50, None), (51, "nothing here"), (52, docs[3][1]), (53, "w0")]
    return docs, queries


def got(df):
    return sorted((r[0], r[1], round(r.score, 6), r["rank"]) for r in df.collect())


def test_bounds_lose_nothing(spark):
    docs, queries = corpus(1, 220)
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(queries, "query_id long, query string")
    for k in (1, 4):
        assert got(bm25(d, q, k)) == by_hand(docs, queries, k)
    index = Bm25Index(d)
    left = index.scored(q, 1).groupBy("q").count().agg(F.sum("count")).first()[0]
    assert left < sum(len([1 for _, t in docs if t and set(t.split()) & set((x or "").split())]) for _, x in queries) / 2
    assert bm25(d.limit(0), q, 2).count() == 0 and bm25(d, q.limit(0), 2).count() == 0


def test_a_stored_index_grows_and_is_opened_again(spark, tmp_path):
    docs, queries = corpus(2, 90)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string")
    Bm25Index.write(d.where("doc_id % 3 = 0"), str(tmp_path / "i"), buckets=4).add(d.where("doc_id % 3 = 1"))
    again = Bm25Index.open(spark.newSession(), str(tmp_path / "i")).add(d.where("doc_id % 3 = 2"))
    other = again.spark.createDataFrame(queries, "query_id long, query string")
    assert got(again.search(other, 3)) == by_hand(docs, queries, 3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        index = Bm25Index.open(spark, str(tmp_path / "i"))
        asked = q.select(F.explode(F.split("query", " ")).alias("t")).distinct().crossJoin(spark.range(16).select(F.col("id").cast("int").alias("part")))
        for keys in (["t", "part"], ["t", "part", "d"]):
            rows = asked if len(keys) == 2 else asked.withColumn("d", F.lit(3).cast("long"))
            plan = rows.repartition(4, "t", "part").join(index.postings, keys)._jdf.queryExecution().executedPlan().toString()
            scan = plan[: plan.index("FileScan")].rsplit("FileScan", 1)[-1]
            assert "Bucketed: true" in plan and "Exchange" not in scan.splitlines()[-3:][0] + scan.splitlines()[-2] + scan.splitlines()[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


def test_a_stored_index_is_written_by_many_tasks_and_read_once(spark, tmp_path):
    docs, queries = corpus(3, 60)
    docs += [(5, docs[5][1]), (8, docs[8][1])]  # each row counts among all documents, as in the SQL
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    try:
        index = Bm25Index.write(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"), buckets=3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(list((tmp_path / "i" / "postings").glob("*.parquet"))) > 3
    q = spark.createDataFrame(queries, "query_id long, query string")
    words = {w for _, t in queries for w in re.split(r"[\W_]+", (t or "").lower()) if w}
    asked = index.asked(spark.createDataFrame([(w,) for w in words], "t string"))
    assert {r.t for r in asked.postings.select("t").distinct().collect()} == {w for _, t in docs for w in (t or "").split()} & words
    assert not [f for f in asked.postings.inputFiles() if str(tmp_path / "i") in f]
    bags = {}
    for d, t in docs:
        bags.setdefault(d, []).append(Counter((t or "").split()))
    n, mean = len(docs), sum(sum(c.values()) for b in bags.values() for c in b) / len(docs)
    size = {d: sum(b[0].values()) for d, b in bags.items()}
    bags = {d: sum(b, Counter()) for d, b in bags.items()}
    df = Counter(w for b in bags.values() for w in b)
    gives = lambda d, w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * bags[d][w] * 2.5 / (bags[d][w] + 1.5 * (0.25 + 0.75 * size[d] / mean))
    want = []
    for i, text in queries:
        scores = {d: sum(gives(d, w) for w in set((text or "").split()) & set(bags[d])) for d in bags if set((text or "").split()) & set(bags[d])}
        want += [(i, d, round(scores[d], 6), k) for k, d in enumerate(sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:3], 1)]
    assert got(index.search(q, 3)) == sorted(want)


def test_words_of_a_row_are_counted_in_it(spark):
    from kinquery.operators.bm25 import _counted, _counted_rows

    docs = spark.createDataFrame([(1, "b A, b_c B"), (2, None), (3, ""), (4, "x"), (5, "é É ß2 2 " * 500), (None, "n n")], "doc_id long, text string")
    rows = lambda df: sorted(map(str, df.select("t", "d", "len", "band", "part", "tf").collect()))
    found = _counted_rows(docs, "doc_id", "text", 16)
    assert rows(found) == rows(_counted(docs, "doc_id", "text", None, 16))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_places_and_binary_search(spark):
    rows = [(i * 7 % 50, f"n{i % 3}", i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "a long, b string, w long").repartition(6)
    order = sorted(rows)
    found = ranked(df, ["a", "b", "w"], "t", "i", "w").orderBy("i").collect()
    assert [(r.a, r.b, r.w) for r in found] == order and [r.before for r in found] == [sum(x[2] for x in order[:i]) for i in range(200)]
    starts = [0, 3, 3, 10, 11]
    for n in range(6):
        row = spark.range(1).select(*(last_at_most(F.array(*map(F.lit, starts[:n])).cast("array<long>"), F.lit(v)).alias(f"v{v + 1}") for v in range(-1, 13))).first()
        assert list(row) == [max((i for i, s in enumerate(starts[:n]) if s <= v), default=-1) for v in range(-1, 13)]


def test_permutations(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        for seed in (1, 2):
            assert sorted(r[0] for r in spark.range(n).select(permuted(F.col("id"), n, seed)).collect()) == list(range(n))
    a, b = (tuple(r[0] for r in spark.range(50).select(permuted(F.col("id"), 50, s)).collect()) for s in (1, 2))
    assert a != b != tuple(range(50))


def test_each_edge_is_chosen_by_its_weight(spark):
    edges = [("hub", "r", f"y{i:05d}", 1 + i % 3) for i in range(1500)] + [("a", "r", "b", 2), ("a", "s", "b", 1), ("z", "r", "q", 0)]
    adjacency = Adjacency.of(spark.createDataFrame(edges, "x string, rel string, y string, mult long").repartition(4))
    total = sum(e[3] for e in edges if e[0] == "hub")
    every = spark.range(total).select(F.lit("hub").alias("at"), "id").unionByName(spark.range(3).select(F.lit("a").alias("at"), "id")).unionByName(spark.range(1).select(F.lit("z").alias("at"), "id"))
    hit = Counter((r.at, r.rel, r.y) for r in adjacency.choose(every, "at", F.col("id")).collect())
    assert hit == {(x, rel, y): m for x, rel, y, m in edges if m}


def test_draws_of_joins_are_bindings(spark):
    one, two = [("a", "b"), ("a", "c"), ("d", "b"), ("e", "f")], [("b", "x"), ("b", "y"), ("c", "x")]
    steps = [spark.createDataFrame(p, "x string, y string") for p in (one, two, [("x", "1"), ("x", "2"), ("y", "1")])]
    total, drawn = chain_draws(steps, 100, seed=3)
    want = sorted((a, b, c, e) for (a, b), (b2, c), (c2, e) in itertools.product(one, two, [("x", "1"), ("x", "2"), ("y", "1")]) if b == b2 and c == c2)
    assert total == len(want) and sorted(tuple(r)[1:] for r in drawn.collect()) == want
    seen = Counter(tuple(r)[1:] for s in range(12) for r in chain_draws(steps, 2, seed=s)[1].collect())
    assert set(seen) <= set(want) and len(seen) >= 5
    assert chain_draws([steps[0].limit(0), steps[1]], 5)[0] == 0


def test_names_from_pools(spark):
    from kinquery.operators.generation import assigned_names

    people = spark.range(12).withColumnRenamed("id", "i")
    pool = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    rows = assigned_names(people, pool("a", "b", "c", "a", None), pool("x", "y", "z", "w")).collect()
    assert len({(r.first, r.last) for r in rows}) == 12 and {r.first for r in rows} == {"a", "b", "c"} and len({r.last for r in rows}) == 4
    with pytest.raises(ValueError):
        assigned_names(people, pool("a", "b"), pool("x"))
    assert assigned_names(people, pool("a", "b"), pool("x"), duplicate_names=True).count() == 12
