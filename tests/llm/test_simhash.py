"""op8: fingerprints, BK-trees and groups against brute force."""

import random
import re

import numpy as np
import xxhash

from kinquery.llm.components import components
from kinquery.llm.shingle_sets import SetLinks, fits, must_share, prefix_length, similar_documents
from kinquery.llm.simhash import BKTree, BucketTree, fingerprint_hashes, link_classes, majority, near_duplicates, one_of_each


def slow_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Component by index, by comparing all pairs."""
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    v = np.array(prints, dtype=np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 2) + i + 1:
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(v))]


def corpus():
    rnd = random.Random(1)
    words = ["alpha", "Beta", "é", "of", "the", "x-y", "9"]
    base = [" ".join(rnd.choice(words) + str(rnd.randint(0, 50)) for _ in range(rnd.randint(100, 500))) for _ in range(25)]
    out = [None, "", "  \t\n", "one", "One", "two words", "a b c"]
    for b in base:
        out += [b, b.upper(), b]
        w = b.split(" ")
        for _ in range(4):
            k = rnd.randrange(len(w))
            out.append(" ".join([*w[:k], "changed", *w[k + 1 :]]))
    return out


def test_prints():
    texts = corpus()
    each = [fingerprint_hashes(t, 3, 42) for t in texts]
    got = majority(np.concatenate(each), np.concatenate([[0], np.cumsum([len(e) for e in each])]))
    assert got.tolist() == [slow_print(t) for t in texts]


def test_long_texts_are_whole():
    text = " ".join(f"w{i}" for i in range(200_000))
    h = fingerprint_hashes(text, 3, 42)
    assert len(h) == 199_998
    bits = [int((h >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(h) for b in range(64)]
    assert int(majority(h, np.array([0, len(h)]))[0]) == sum(1 << b for b, on in enumerate(bits) if on)


def test_tree_finds_all():
    rnd = random.Random(2)
    values = list({rnd.getrandbits(16) for _ in range(800)})
    tree = BKTree()
    for v in values:
        tree.add(v)
    for q in values[:100]:
        assert {tree.values[i] for i in tree.within(q, 2)} == {v for v in values if (v ^ q).bit_count() <= 2}
    assert BKTree().within(3, 2) == BucketTree().within(3, 2) == []
    for leaf in (3, 50, 5000):
        tree = BucketTree(leaf)
        for v in values:
            tree.add(v)
        for q in values[:100]:
            for radius in (2, 6):
                assert sorted(tree.within(q, radius)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= radius]


def test_links_with_small_and_hot_shards(spark):
    rnd = np.random.default_rng(3)
    values = set(rnd.integers(0, 2**63, 300, dtype=np.uint64).tolist())
    for c in rnd.integers(0, 2**63, 8, dtype=np.uint64).tolist():
        for _ in range(40):
            v = c
            for b in rnd.integers(0, 64, 3).tolist():
                v ^= 1 << b
            values.add(v)
    prints = sorted(values)
    classes = spark.createDataFrame([(int(np.uint64(v).view(np.int64)), i) for i, v in enumerate(prints)], "fp long, rep long")
    want = groups(prints)
    for hot in (2, 1000):
        got = {r.id: r.component for r in components(link_classes(classes, 2, hot)).collect()}
        assert [got.get(i, i) for i in range(len(prints))] == want


def test_documents(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i * 7 + 3, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    want = groups([slow_print(t) for t in texts])
    got = {r.doc_id: (r.fp, r.component_id) for r in near_duplicates(docs).collect()}
    assert {k: (f & 2**64 - 1, c) for k, (f, c) in got.items()} == {i * 7 + 3: (slow_print(t), want[i] * 7 + 3) for i, t in enumerate(texts)}
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({w * 7 + 3 for w in want})


def test_repeats_nulls_and_nothing(spark):
    docs = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (9, "something else here"), (None, None)], "doc_id long, text string")
    rows = near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 5), (5, 5), (5, 5), (9, 9)]
    assert sorted((r.doc_id or 0) for r in one_of_each(docs).collect()) == [0, 0, 5, 9]
    assert near_duplicates(docs.limit(0)).count() == 0 and one_of_each(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(3, 3), (900, 800)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys([7, *range(200, 260)], 7), 800: 800, 900: 800}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_sets_against_brute_force(spark):
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    shared = " ".join(rnd.choice(vocab) for _ in range(12))
    texts = [None, "", "one two", "ONE two", "a b c d e", "a b c d e a b c d e"]
    for _ in range(40):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(60, 110))]
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 6, 12):
            w = list(words)
            for _ in range(edits):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append(" ".join(w))
        texts.append(shared + " " + " ".join(rnd.choice(vocab) for _ in range(80)))
    texts += [texts[10], texts[10].upper()]

    def grams(t):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall("[^\x20\x09-\x0d]+", t or "")]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [grams(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both >= 0.8 * all_:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int").repartition(3)
    for how in ({}, {"cold": 3, "hot": 8}, {"cold": 2, "hot": 3, "ordered": 0}, {"cold": 64, "ordered": 3}):
        got = {r.doc_id: r.component_id for r in similar_documents(docs, **how).collect()}
        assert [i for i in range(len(texts)) if got[i] != root(i)] == [], how
    kept = one_of_each(docs, similarity=0.8)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {root(i) for i in range(len(texts))}
    assert similar_documents(docs.limit(0)).count() == 0 and one_of_each(docs.limit(0), similarity=0.8).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "a b"), (4, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in similar_documents(nulls).collect()) == [(0, 4), (0, 4), (4, 4), (4, 4)]
    assert sorted(r.doc_id or 0 for r in one_of_each(nulls, similarity=0.8).collect()) == [0, 0, 4]


def wrong_groups(spark, texts, **how):
    """How many texts fall in another group than by comparing all pairs of five-word sets."""
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), **how).collect()}
    return sum(got[i] != root(i) for i in range(len(texts)))


def test_long_texts_near_the_limit_are_decided_on_whole_sets(spark):
    rnd = random.Random(11)
    texts = []
    for _ in range(40):
        base = [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(400, 900))]
        for cut in (0.205, 0.195):  # the head alone, of a similarity a little below or above 0.8
            keep = round((len(base) - 4) * (1 - cut)) + 4
            texts.append(" ".join(base[:keep]))
            texts.append(" ".join(base))
            base = [f"v{x}" for x in base]
    assert wrong_groups(spark, texts) == 0


def test_texts_that_repeat_a_line_are_linked_by_their_sets(spark):
    rnd = random.Random(12)
    line = lambda: " " + " ".join(f"x{rnd.randint(0, 10**6)}" for _ in range(8))
    texts = []
    for times in (5, 10, 20, 40):
        for _ in range(6):
            base = " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(250))
            texts += [base + line() * times, base + line() * times]
    assert wrong_groups(spark, texts) == 0


def test_hot_shards_lose_no_pair(spark):
    rnd = random.Random(13)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = []
    for n in (15, 20, 30, 60, 100, 160) * 4:
        base = [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
        texts += [passage + " " + " ".join(base), passage + " " + " ".join(base[: n * 9 // 10]), passage + " " + " ".join([*base[: n // 2], "other", *base[n // 2 + 1 :]])]
    for how in ({"cold": 2, "hot": 2, "ordered": 0}, {"cold": 4, "hot": 8}, {"cold": 8, "hot": 8, "ordered": 20}):
        assert wrong_groups(spark, texts, **how) == 0


def test_pairs_of_one_common_key_that_is_hot_are_linked(spark):
    rnd = random.Random(14)
    least = lambda t: set(np.unique(fingerprint_hashes(t, 5, 42) >> np.uint64(32))[:6].tolist())
    texts = []
    while len(texts) < 4:
        w = [f"w{rnd.randint(0, 10**6)}" for _ in range(49)]
        pair = [" ".join(w[:40]), " ".join(w)]
        texts += pair if len(least(pair[0]) & least(pair[1])) == 1 else []
    assert wrong_groups(spark, texts, cold=1, hot=1) == 0


def test_bounds_lose_no_pair():
    """Prefixes, places and counts in buckets against all pairs of small sets."""
    rnd = np.random.default_rng(15)
    pool = rnd.integers(0, 2**63, 40, dtype=np.uint64)
    sets = [np.sort(rnd.choice(pool, rnd.integers(1, 30), replace=False)) for _ in range(200)]
    for s in (0.5, 0.8, 0.9):
        for x in sets[:60]:
            for y in sets:
                both = len(np.intersect1d(x, y))
                assert (both >= must_share(len(x), len(y), s)) == (both >= s * (len(x) + len(y) - both) - 1e-9)
                if both >= must_share(len(x), len(y), s):
                    first = np.intersect1d(x, y)[0]
                    i, j = int(np.searchsorted(x, first)), int(np.searchsorted(y, first))
                    assert i < prefix_length(len(x), s) and j < prefix_length(len(y), s) and fits(len(x), i, len(y), j, s)
        links = SetLinks(sets, [0] * len(sets), list(range(len(sets))), s).links()
        assert all(a > b for a, b in links)


def test_pipeline_links_null_ids_to_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (2, "x"), (2, "y"), (7, None), (8, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in one_of_each(docs, similarity=0.8).collect())[:1] == [(0, "a b c d e f")]
    assert sorted(r.doc_id or 0 for r in one_of_each(docs, similarity=0.8).collect()) == [0, 2, 7]


def test_pairs_get_texts_and_no_table_of_sets_is_written(spark, monkeypatch):
    from kinquery.llm import shingle_sets as S

    written = []
    real = S.stored

    def noted(df, what, rows=None):
        written.append((what, df.columns))
        return real(df, what, rows)

    monkeypatch.setattr(S, "stored", noted)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:100], "new", *words[101:]]), " ".join(reversed(words))]
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    assert "texts" in dict(written) and not any("hashes" in columns for _, columns in written)
