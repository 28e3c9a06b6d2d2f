"""Facts at every change against a list of tuples; texts joined in parts."""

import hashlib
import random

import pytest

from kinquery.operators.long_texts import digests, joined_parts, whole_texts
from kinquery.plans.facts import FactBase
from kinquery.plans.versions import FactLog


def test_every_version_against_a_list(spark):
    base = FactBase(spark).add("p(a, b)", "p(b, b)", "q(a)", "p(a, b)")
    log, rows, versions = FactLog(spark, base.facts), [("p", "a", "b"), ("p", "b", "b"), ("q", "a", None), ("p", "a", "b")], []
    rnd = random.Random(1)
    versions.append(list(rows))
    for _ in range(14):
        if rnd.random() < 0.5:
            x, y = rnd.choice("abc"), rnd.choice("abc")
            log.add(f"p({x}, '{y}').", f"q({y})")
            rows += [("p", x, y), ("q", y, None)]
        else:
            pattern = rnd.choice(["p(a, _)", "p(X, X)", "q(b)", "p(_, _)", "p(X, c)", "q(X)"])
            log.remove(pattern)
            fits = {"p(a, _)": lambda r: r[:2] == ("p", "a"), "p(X, X)": lambda r: r[0] == "p" and r[1] == r[2], "q(b)": lambda r: r[:2] == ("q", "b"), "p(_, _)": lambda r: r[0] == "p", "p(X, c)": lambda r: r[0] == "p" and r[2] == "c", "q(X)": lambda r: r[0] == "q"}[pattern]
            rows = [r for r in rows if not fits(r)]
        versions.append(list(rows))
    read = lambda v: [tuple(r)[:3] for r in log.frame(v).orderBy("ord").collect()]
    for v in (0, 5, 9, 14):
        assert read(v) == versions[v]
    short, long = (len(log.frame(v)._jdf.queryExecution().optimizedPlan().toString().splitlines()) for v in (1, 14))
    assert long <= short + 4
    log.compact()
    assert read(None) == versions[-1] and log.add("p(z, z)") == 15 and read(15) == [*versions[-1], ("p", "z", "z")]
    assert log.at().relation("p").count() == len({r for r in versions[-1] if r[0] == "p"}) + 1
    for wrong in (lambda: log.frame(3), lambda: log.add("p(X, b)"), lambda: log.remove("p(a, b, c)")):
        with pytest.raises(ValueError):
            wrong()


def test_texts_are_joined_in_parts(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["hot", "hot", "b", None, ""]), rnd.choice([None, "", "x" * 3000, "é😀", "a\nb"]) if i % 3 else f"text {i}") for i in range(400)] + [(7, "hot", "same id")] * 3
    want = {}
    for _, g, t in sorted(((i, g, t) for i, g, t in rows if t is not None), key=lambda r: (r[0], r[2])):
        want.setdefault(g, []).append(t)
    df = spark.createDataFrame(rows, "i long, g string, t string").repartition(6)
    for most, sep in ((10, "\n"), (5000, "--"), (1 << 20, "")):
        parts = joined_parts(df, "g", "i", "t", sep, most)
        for r in parts.collect():
            assert sep.join(want[r.g])[r.start : r.start + r.n_chars] == r.part and (len(r.part) <= most or r.n_texts == 1)
        assert {r.g: (r.n_chars, r.md5) for r in digests(parts, "g", sep).collect()} == {g: (len(sep.join(t)), hashlib.md5(sep.join(t).encode()).hexdigest()) for g, t in want.items()}
    assert {r.g: r.text for r in whole_texts(joined_parts(df, "g", "i", "t", "\n", 100), "g").collect()} == {g: "\n".join(t) for g, t in want.items()}
    assert joined_parts(df.limit(0), "g", "i", "t").count() == 0
