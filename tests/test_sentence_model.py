"""Learned sentence boundaries against loops over words."""

import math
import random
import re
from collections import Counter

from kinquery.operators.sentence_model import learned_sentences, statistics


def core(w):
    return re.sub(r"^[^\w]+|[^\w.!?]+$", "", w)


def kind(w):
    return re.sub(r"[.!?]+$", "", core(w)).lower()


def by_hand(docs):
    seen = []
    for _, t in docs:
        ws = (t or "").split()
        seen += [(w, ws[i - 1] if i else None) for i, w in enumerate(ws)]
    ends = lambda w: bool(re.search(r"[.!?]$", core(w)))
    stats = {}
    for w, before in seen:
        if kind(w):
            s = stats.setdefault(kind(w), Counter())
            stop = bool(re.search(r"[^.]\.$", core(w)))
            s["stopped"] += stop
            s["plain"] += not stop
            s["small"] += core(w)[0].islower()
            s["inside"] += core(w)[0].isupper() and before is not None and not ends(before)
    total = sum(s["stopped"] + s["plain"] for s in stats.values())
    p = min(max(sum(s["stopped"] for s in stats.values()) / total, 1e-9), 1 - 1e-9)
    scores = {}
    for word, s in stats.items():
        k, n = s["stopped"], s["stopped"] + s["plain"]
        if k and re.search(r"[^\W\d_]", word):
            size = len(word.replace(".", ""))
            scores[word] = 2 * (k * math.log(0.99) + (n - k) * math.log(0.01) - k * math.log(p) - (n - k) * math.log(1 - p)) * math.exp(-size) * (len(word) - size + 1) * max(size, 1) ** -s["plain"]
    out = {}
    for d, t in docs:
        ws, cut, now = (t or "").split(), [], []
        for i, w in enumerate(ws):
            now.append(w)
            after = ws[i + 1] if i + 1 < len(ws) else None
            short = re.search(r"[^.]\.$", core(w)) and scores.get(kind(w), 0) >= 0.3
            fresh = after is not None and core(after)[:1].isupper() and (s := stats.get(kind(after))) and s["small"] > 0 and s["inside"] == 0
            if ends(w) and (not short or fresh):
                cut.append(" ".join(now))
                now = []
        out[d] = [*cut, *([" ".join(now)] if now else [])]
    return stats, scores, out


def test_boundaries(spark):
    rnd = random.Random(3)
    plain = ["the", "dog", "runs", "home", "Anna", "Berlin", "sees", "cat", "(quietly)", '"well"', "3", "u.s", "and"]
    docs = []
    for i in range(120):
        words = []
        for _ in range(rnd.randint(0, 12)):
            part = [rnd.choice(plain) for _ in range(rnd.randint(2, 8))]
            part.insert(rnd.randint(0, len(part) - 1), rnd.choice(["Dr.", "e.g.", "etc.", "Dr.", "mr."]))
            part[0] = part[0][0].upper() + part[0][1:]
            words += [*part[:-1], part[-1].rstrip(".") + rnd.choice([".", ".", "!", "?", '."', "..."])]
        docs.append((i, rnd.choice([" ", "\n", "  "]).join(words)))
    docs += [(900, None), (901, ""), (902, "no end"), (903, "One. " * 3000), (904, "...")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    stats, scores, cuts = by_hand(docs)
    got = {r.word: r for r in statistics(df).collect()}
    assert set(got) == set(stats)
    for word, s in stats.items():
        r = got[word]
        assert (r.stopped, r.plain, r.small, r.capital_inside) == (s["stopped"], s["plain"], s["small"], s["inside"]), word
        assert (r.score is None) == (word not in scores) and (r.score is None or math.isclose(r.score, scores[word], rel_tol=1e-9, abs_tol=1e-12))
    assert scores["dr"] >= 0.3 and scores["home"] < 0.3
    found = {}
    for r in learned_sentences(df, statistics(df)).orderBy("doc_id", "n").collect():
        found.setdefault(r.doc_id, []).append(r.sentence)
    assert found == {d: c for d, c in cuts.items() if c}
    assert learned_sentences(df.limit(0), statistics(df)).count() == 0 and statistics(df.limit(0)).count() == 0
