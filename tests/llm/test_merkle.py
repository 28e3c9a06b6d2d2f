"""op12 against trees built by plain loops."""

import hashlib
import random
import zlib

import pytest

from kinquery.llm.merkle import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def climb(digests, width):
    """Root, and each node's siblings before and after, level by level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // width * width : (k // width + 1) * width]
            paths[i].append(("".join(run[: k % width]), "".join(run[k % width + 1 :])))
        level = [sha("".join(level[k : k + width])) for k in range(0, len(level), width)]
        at = [k // width for k in at]
    return level[0], paths


def by_hand(rows, width):
    leaf = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    low = lambda r: (*r[:4], r[4] and r[4].translate({c: c + 32 for c in range(65, 91)}))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: climb([leaf(r) for r in groups[s]], width) for s in order}
    root, over = climb([trees[s][0] for s in order], width)
    out = []
    for k, s in enumerate(order):
        for r, path in zip(groups[s], trees[s][1], strict=True):
            whole = path + over[k]
            forged = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            d = leaf(low(r)) if forged else leaf(r)
            for a, b in whole:
                d = sha(a + d + b)
            out.append((r[0], leaf(r), trees[s][0], root, sha("".join(a + b for a, b in whole)), d, d == root))
    return sorted(map(str, out))


def rows_of(n, sources, seed):
    rnd = random.Random(seed)
    text = lambda: rnd.choice([None, "", "Upper Case", "lower", "É ß 😀 X", "a:b-1:2", "Z" * 5000, "ﬀ\n\t"])
    pick = lambda: None if rnd.random() < 0.05 else (sources[0] if rnd.random() < 0.4 else rnd.choice(sources))
    rows = [(i, pick(), rnd.choice(["en", None, ""]), rnd.choice([None, 0, 17]), text()) for i in range(n)]
    return [*rows, *rows[:5], (None, "b", None, None, None), (None, None, "x", 1, "N"), (-7, "", "en", 2, "Empty source")]


@pytest.mark.parametrize(("n", "width", "sources"), [(700, 16, ["hot", "b", "é", "Z", "a"]), (300, 4, [f"s{i}" for i in range(90)]), (90, 2, ["x", "y"]), (16, 16, ["x"]), (17, 16, ["x"])])
def test_manifest(spark, n, width, sources):
    rows = rows_of(n, sources, n)
    got = manifest(spark.createDataFrame(rows, SCHEMA).repartition(6), width=width).collect()
    assert sorted(str(tuple(r)[:7]) for r in got) == by_hand(rows, width)


def test_a_source_over_many_partitions(spark):
    rows = rows_of(600, ["hot", "b"], 5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = manifest(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(str(tuple(r)[:7]) for r in got) == by_hand(rows, 16)


def test_lone_leaves_empty_tables_and_clashing_columns(spark):
    one = [(10, "a", "en", 1, "Lone")]
    clash = spark.createDataFrame(one, SCHEMA).selectExpr("*", "1 as grp", "2 as place", "3 as digest", "4 as run", "5 as path", "6 as leaf", "7 as __row")
    got = manifest(clash).collect()
    assert sorted(str(tuple(r)[:7]) for r in got) == by_hand(one, 16) and got[0].leaf == got[0].subroot == got[0].root and got[0].proof_sha256 == sha("")
    lone = [(i, f"s{i}", None, None, "T") for i in range(40)]
    assert sorted(str(tuple(r)[:7]) for r in manifest(spark.createDataFrame(lone, SCHEMA)).collect()) == by_hand(lone, 16)
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0
