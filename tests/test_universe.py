"""A universe from end to end, as the command line makes it."""

import json

from kinquery.__main__ import main
from kinquery.plans.facts import FactBase
from kinquery.sources.records import read_questions


def test_generate_and_read_back(spark, tmp_path):
    out = str(tmp_path / "u")
    (tmp_path / "female").write_text("Ada\nBea # first\n")
    (tmp_path / "jobs").write_text("cook\nclerk\n")
    (tmp_path / "hobbies.csv").write_text("Hobby-name,Type\nChess,in\nRowing,out\n")
    pools = ["--female-names", str(tmp_path / "female"), "--jobs", str(tmp_path / "jobs"), "--hobbies", str(tmp_path / "hobbies.csv")]
    main(["generate", out, *pools, "--max-family-tree-size", "12", "--num-questions-per-type", "2", "--question-depth", "5", "--easy-mode"])
    facts = FactBase.from_disk(spark, f"{out}/facts").cache()
    people = {r.name for r in facts.person_names().collect()}
    assert 10 <= len(people) <= 14 and facts.attribute_values().count() == 2 * len(people)
    assert {r.y for r in facts.frame("job").collect()} <= {"cook", "clerk"} and {r.y for r in facts.frame("hobby").collect()} <= {"chess", "rowing"}
    women = {r.x for r in facts.frame("gender").where("y = 'female'").collect()}
    assert women and all(w.split()[0] in ("Ada", "Bea") for w in women)
    art = spark.read.json(f"{out}/articles")
    assert {r.title for r in art.collect()} == people and all(r.article.startswith(f"# {r.title}\n\n## Family\n") for r in art.collect())
    rows = read_questions(spark, f"{out}/questions/type=*", lines=True).collect()
    assert len(rows) > 8 and all(r.difficulty >= 1 and r.answer and "<" not in r.question for r in rows)
    for r in rows:
        found = json.loads(r.solution_traces)
        assert found and sorted({str(b[r.prolog.answer]) for b in found}) == r.answer
        assert r.is_aggregation_question == r.question.startswith("How many")
        assert [a for a in facts.answer(r.prolog.query, r.prolog.answer).collect()[0].answer] == r.answer
    assert spark.read.csv(f"{out}/timings.csv", header=True).columns[-1] == "total"
