"""op13 against filters applied one after the other."""

import random
import re
from itertools import permutations

import numpy as np

from kinquery.llm.filter_audit import FIRST, ORDERS, audit, failures

DOCS = "doc_id long, source string, text string"
LABELS = "doc_id long, quality int, toxic int"


def fails_of(rows):
    out = []
    for i, _, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        out.append(f + "E" * any(j is not None and i is not None and j < i and (t or "") == text for j, _, t in rows))
    return out


def by_hand(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    fails, out = fails_of(rows), {}
    for part in {s or "" for _, s, _ in rows}:
        mine = [(i, f) for (i, s, _), f in zip(rows, fails, strict=True) if (s or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, c in enumerate(order, 1):
                gone = [d for d in left if c in d[1]]
                left = [d for d in left if c not in d[1]]
                removed_by[c] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(c in f and any(x in f for x in order[: step - 1]) for _, f in mine), sum(f == c for _, f in mine), sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def same(spark, rows, labels, docs=None):
    df = docs if docs is not None else spark.createDataFrame(rows, DOCS).repartition(7)
    got = audit(df, spark.createDataFrame(labels, LABELS)).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}
    assert len(got) == len(found) and found == by_hand(rows, labels)


def corpus(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 4)))
    texts = [None, "", " \t", "#", "HELLO " * 300, "same text\x0b" * 220, " ".join(map(str, range(250))), "é" * 100 + "A" * 2, "é" * 99 + "AA"]
    texts += [rnd.choice([" ", "\n", "  "]).join(word() + rnd.choice(["", "", "$", "Q"]) * (rnd.random() < 0.1) for _ in range(rnd.choice([5, 150, 199, 200, 300]))) for _ in range(25)]
    rows = [(rnd.choice([i, i, i // 2, None]), rnd.choice(["hot", "hot", "", None, "b", "é"]), rnd.choice(texts)) for i in range(n)]
    labels = [(rnd.choice([i, None]), rnd.choice([0, 1, None, 2]), rnd.choice([0, 1, None])) for i in range(n)] + [(1, 1, 0), (1, 0, 1), (10**9, 1, 1)]
    return rows + rows[:9], labels


def test_audit(spark):
    same(spark, *corpus(250, 1))


def test_a_text_that_is_everywhere(spark):
    rows = [(i, f"s{i % 3}", "one text for all" if i % 3 else f"own {i}") for i in range(200)]
    same(spark, rows, [(i, i % 2, int(i % 5 == 0)) for i in range(0, 200, 3)])


def test_long_texts_no_labels_clashing_columns(spark):
    rows = [(1, "a", "word " * 200_000), (2, "a", " ".join(f"w{i}" for i in range(100_000))), (3, None, "x" * 1_000_000), (4, None, "x" * 1_000_000)]
    same(spark, rows, [])
    clash = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as part", "2 as n", "3 as good", "4 as fails", "5 as quality", "6 as digest")
    same(spark, rows, [(1, 1, 1)], clash)


def test_empty_tables(spark):
    assert audit(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 1)], LABELS)).count() == 0


def test_table_of_first_failures():
    assert FIRST.shape == (32, 120)
    for order, row in zip(ORDERS, FIRST.T, strict=True):
        for fails in range(32):
            at = [k for k, c in enumerate(order, 1) if fails >> "ABCDE".index(c) & 1]
            assert row[fails] == (at[0] if at else 0)
    assert np.count_nonzero(FIRST == 0) == 120


def test_boundaries(spark):
    rows = [("w " * 200,), ("w " * 199,), (" ".join(map(str, range(100))) + " 1" * 100,), (" ".join(map(str, range(99))) + " 1" * 101,), ("A" + "b" * 49,), ("A" + "b" * 48,)]
    got = [r[0] for r in spark.createDataFrame(rows, "text string").select(failures(__import__("pyspark").sql.functions.col("text"))).collect()]
    assert [g & 1 for g in got] == [0, 1, 0, 0, 1, 1] and [g >> 1 & 1 for g in got][2:4] == [0, 1] and [g >> 2 & 1 for g in got][4:] == [0, 1]
