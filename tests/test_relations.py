"""Relations against a brute-force enumeration of derivations over small random families."""

import random
from collections import Counter

import pytest

from kinquery.plans.facts import FactBase
from kinquery.plans.relations import ASKABLE, EASY, RELATIONS, weight


def family(seed, n=14):
    rnd = random.Random(seed)
    gender = {f"p{i}": rnd.choice(["male", "female"]) for i in range(n)}
    parent = []
    for i in range(4, n):
        for p in rnd.sample(range(i), 2):
            parent.append((f"p{i}", f"p{p}"))
    return gender, parent


def derive(name, gender, parent, friend):
    """A bag of pairs, rule by rule."""
    get = lambda n: derive(n, gender, parent, friend)
    flip = lambda b: Counter({(y, x): c for (x, y), c in b.items()})

    def join(*bags):
        out = bags[0]
        for b in bags[1:]:
            nxt = Counter()
            for (x, a), c in out.items():
                for (a2, y), d in b.items():
                    if a == a2:
                        nxt[x, y] += c * d
            out = nxt
        return out

    apart = lambda b: Counter({p: c for p, c in b.items() if p[0] != p[1]})
    only = lambda b, g: Counter({p: c for p, c in b.items() if gender.get(p[1]) == g})
    if name == "parent":
        return Counter(parent)
    if name == "friend":
        return Counter(friend) + flip(Counter(friend))
    if name == "sibling":
        return apart(join(get("parent"), flip(get("parent"))))
    if name == "married":
        return apart(join(flip(get("parent")), get("parent")))
    if name == "child":
        return flip(get("parent"))
    if name == "grandparent":
        return join(get("parent"), get("parent"))
    if name == "cousin":
        return apart(join(get("parent"), get("sibling"), flip(get("parent"))))
    if name == "female_second_cousin":
        return only(apart(join(get("parent"), get("cousin"), flip(get("parent")))), "female")
    if name == "male_first_cousin_once_removed":
        return apart(join(get("cousin"), only(get("child"), "male")))
    if name == "sister_in_law":
        return join(get("married"), only(get("sibling"), "female"))
    if name == "second_uncle":
        return join(get("grandparent"), get("parent"), only(get("sibling"), "male"))
    raise KeyError(name)


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_are_those_of_derivations(spark, seed):
    gender, parent = family(seed)
    friend = [("p1", "p2"), ("p1", "p2"), ("p3", "p1")]
    facts = FactBase.of_frames(spark, {"gender": spark.createDataFrame(list(gender.items()), "x string, y string"), "parent": spark.createDataFrame(parent, "x string, y string"), "friend_": spark.createDataFrame(friend, "x string, y string")})
    for name in ("sibling", "married", "child", "grandparent", "cousin", "female_second_cousin", "male_first_cousin_once_removed", "sister_in_law", "second_uncle", "friend"):
        want = derive(name, gender, parent, friend)
        got = {(r.x, r.y): r.mult for r in facts.relation(name, 2, "counted").collect()}
        assert got == dict(want), name
        assert {(r.x, r.y) for r in facts.relation(name).collect()} == set(want), name


def test_catalogue():
    assert len(RELATIONS) == 45 and len(ASKABLE) == 45
    assert "married" not in ASKABLE and "friend" in EASY and "aunt" not in EASY
    assert (weight("parent"), weight("female_second_cousin"), weight("aggregate_all"), weight("hobby"), weight("nothing")) == (1, 5, 1, 1, 0)


def test_facts_are_a_bag_in_order(spark):
    facts = FactBase(spark).add('job("a", "cook").', "job(b, 'clerk').", 'job("a", "cook").').define("nickname/2")
    rows = facts.frame("job").orderBy("ord").collect()
    assert [(r.x, r.y) for r in rows] == [("a", "cook"), ("b", "clerk"), ("a", "cook")]
    assert facts.relation("nickname").count() == 0
    with pytest.raises(KeyError):
        facts.query("unheard(X, Y)")
    assert facts.remove("job(a, X)").frame("job").count() == 1
    assert facts.remove("job(X, X)").frame("job").count() == 3
    with pytest.raises(ValueError):
        facts.add("job(X, cook)")


def test_fact_files_skip_what_is_no_fact(spark, tmp_path):
    path = tmp_path / "facts.pl"
    path.write_text(':- dynamic parent/2.\n\nparent("a \\"x\\"", \'b c\').\nattribute(cook).\nattribute("cook").\nsister(X, Y) :-\n    sibling(X, Y).\nage("a", 7).\nfriend(alina, anna).\n')
    facts = FactBase.from_disk(spark, str(path))
    assert [(r.pred, r.x, r.y) for r in facts.facts.orderBy("ord").collect()] == [("parent", 'a "x"', "b c"), ("attribute", "cook", None), ("attribute", "cook", None), ("age", "a", "7"), ("friend", "alina", "anna")]
    facts.save(str(tmp_path / "out"))
    again = FactBase.from_disk(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.facts.select("pred", "x").collect())) == sorted(map(tuple, facts.facts.select("pred", "x").collect()))
    assert [r.value for r in facts.attribute_values().collect()] == ["cook", "cook"]
