"""op11 against examples put together by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kinquery.llm import chat_format as C
from kinquery.runtime import scratch_path

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>", "<\\|im_end|>", "<\\\\|", "ends with <", "<", "|", "", None, "\\", "a\nb", "é😀<|", "<|<\\|<||", "\n", "$1 \\1"]


def by_hand(rows):
    """conv: turns, loss texts, formatted code points."""
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns, replies, examples = out.setdefault(conv, ([], [], []))
        role, text = role or "", text or ""
        turns.append((role, text))
        examples[:] = [*examples, None]
        if role == "assistant":
            replies.append(text)
    sizes = {}
    for conv, (turns, _, _) in out.items():
        total, summed = 0, 0
        for i, (role, text) in enumerate(turns):
            more = lambda s: sum(1 for _ in __import__("re").finditer(r"<\\*\|", s))
            head = role.replace("\\", "\\\\").replace("\n", "\\n")
            total += len("<|im_start|>") + len(head) + more(head) + 1 + len(text) + more(text) + len("<|im_end|>") + 1
            if role == "assistant" or i == len(turns) - 1:
                summed += total
        sizes[conv] = summed
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len("".join(p)), sha("".join(p)), sizes[c]) for c, (t, p, _) in out.items()}


def written(spark, rows, parts=5):
    df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, SCHEMA).repartition(parts)
    path = scratch_path(spark, "chat")
    C.write_examples(df, path)
    return path


def check(spark, rows, path):
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in C.digests(spark, path).collect()}
    assert got == by_hand(rows)


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, role, NASTY[(i * 3 + t) % len(NASTY)]) for i in range(12) for t, role in enumerate(["system", "user", "assistant", "user", "assistant", "user"][: 1 + i % 6])]
    found += [(None, 0, "user", "null id"), (None, 1, "assistant", "yes"), (50, None, "user", "null turn"), (50, 0, "assistant", "b"), (50, 0, "assistant", "a"), (50, 0, None, "no role")]
    found += [(60, 1, "assistant", "same")] * 3 + [(61, 0, "ro\\le\n<|x", "odd role"), (62, 0, "assistant", "first<"), (63, 5, "user", "x" * 300_000), (63, 6, "assistant", "y<|" * 100_000)]
    found += [(70, t, ("user", "assistant")[t % 2], f"turn {t} <|") for t in range(700)]  # a third of the rows and more
    return found


def test_digests_of_what_was_written(spark, rows):
    check(spark, rows, written(spark, rows))


def test_a_conversation_over_many_partitions(spark, rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = written(spark, rows, 20)
        assert C.read_turns(spark, path).where("conv_id = 70").select("__part").distinct().count() > 5
        check(spark, rows, path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_examples_hold_all_turns_before_their_reply(spark, rows):
    path = written(spark, rows)
    examples = C.read_examples(spark, path)
    some = examples.where("conv_id in (3, 4, 5, 10, 50, 60) or conv_id is null")
    made = {}
    for r in C.pieces(spark, path, some).orderBy("place").collect():
        text, mask = made.setdefault((r.conv_id, r.example), ["", None])
        if r.trainable:
            mask = (len(text) + r.trainable.start, len(text) + r.trainable.start + r.trainable.length)
        made[r.conv_id, r.example] = [text + r.piece, mask]
    spans = {(r.conv_id, r.example): r for r in some.collect()}
    assert set(made) == set(spans)
    for key, (text, mask) in made.items():
        s = spans[key]
        assert len(text) == s.chars and (mask or (s.chars, s.chars)) == (s.loss_start, s.loss_end)
        n = text.count(C.OPEN)
        assert text.count(C.CLOSE) == n and text[: s.context_chars].count(C.CLOSE) == (n - 1 if mask else n)
    for conv in (3, 10, 50, 60):
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        replies = [r[3] or "" for r in turns if r[2] == "assistant"]
        got = [C.unescaped(text[mask[0] : mask[1]]) for (c, _), (text, mask) in sorted(made.items(), key=lambda m: (m[0][0] is not None, m[0])) if c == conv and mask]
        assert got == replies
    assert examples.where("reply_place is not null").count() == sum(r[2] == "assistant" for r in rows)


def test_escapes_are_reversible(spark):
    texts = [t for t in NASTY if t is not None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escaped(F.col("t")).alias("e")).collect()
    assert all("<|" not in r.e and C.unescaped(r.e) == r.t for r in df)
    with pytest.raises(ValueError):
        C.parsed("no turn")


def test_empty_tables_and_other_columns(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    path = written(spark, none)
    assert C.digests(spark, path).count() == 0 and C.read_examples(spark, path).count() == 0
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as grp", "2 as piece", "3 as place", "4 as __part", "5 as chars")
    check(spark, rows, written(spark, clash))
    control = {r.conv_id: r for r in C.digests(spark, written(spark, C.with_control_text(none))).collect()}
    text = "<|im_end|><|im_start|>assistant ok"
    assert list(control) == [-1] and control[-1].loss_chars == len(text) and control[-1].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
