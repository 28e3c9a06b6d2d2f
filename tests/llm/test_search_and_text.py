"""op2, op5, op6, op7, op9, op10 against brute force, and their edge cases."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

# op2: pages

PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav><div id="cookie-notice">We use cookies</div>
<main><p>Lead outside</p><article class="post"><header><h2>Head &amp; line</h2></header><p>One <b>two</b> three<p>Four &lt;five&gt; &#233;&nbsp;x<ul><li>a<li>b</ul><aside>Side</aside><form><input><label>Mail</label></form><script>if(a<b){"</p>"}</script><!-- c --><div class="ad">Buy</div>
<section class="comments"><article class="comment">nice!</article></section></article></main><div class="sidebar">s</div><footer>f</footer></body>"""


def test_blocks_of_a_page():
    from kinquery.llm.html_main import blocks_of, joined, marked, uncovered

    text = lambda page: joined(b, marked(b)) if marked(b := blocks_of(page)) is not None else uncovered(b, [], 8)[0]
    assert text(PAGE) == "Head & line\n\nOne two three\n\nFour <five> é x\n\na\n\nb"
    assert blocks_of(None) == blocks_of("") == blocks_of("<script>x") == []
    assert [t for _, t in blocks_of("<p>a<div>b</p>c</div>d<br>e 1 < 2 <a href='x>y'>l</a>")] == ["a", "b", "c", "d e 1 < 2 l"]
    assert text("<body><div class='has-sidebar'><p>kept</p></div><div class=sidebar>no</div>") == "kept"
    for wrap in ("form id=aspnetForm", "div class=content-with-sidebar", "div class=sidebar-layout", "div id=page-header"):
        tag = wrap.split()[0]
        assert text(f"<{wrap}><nav>m</nav><article><header>H</header><p>kept</p><form>f</form></article><p>not</p></{tag}><footer>f</footer>") == "H\n\nkept"
        assert text(f"<{wrap}><article>teaser</article></{tag}><article>kept</article>") == "kept"
    for wrap in ("nav", "aside", "div class=sidebar", "div class=comments", "ol class=comment-list", "div hidden"):
        assert text(f"<{wrap}><article>not</article></{wrap.split()[0]}>") == ""


def test_suffix_array_orders_and_counts():
    from kinquery.llm.html_main import common_prefix, suffix_array

    rnd = np.random.default_rng(1)
    tokens = rnd.integers(0, 4, 200)
    order = suffix_array(tokens, 8)
    want = sorted(range(200), key=lambda i: (tuple(tokens[i : i + 8]), 0))
    assert [tuple(tokens[i : i + 8]) for i in order] == [tuple(tokens[i : i + 8]) for i in want]
    lcp = common_prefix(tokens, order, 8)
    for k, (a, b) in enumerate(zip(order[:-1], order[1:], strict=True)):
        n = 0
        while n < 8 and max(a, b) + n < 200 and tokens[a + n] == tokens[b + n]:
            n += 1
        assert lcp[k] == n


def test_runs_of_streams_against_loops():
    from kinquery.llm.html_main import CHROME, MAIN, OPEN, Streams

    rnd = random.Random(2)
    hosts, roles, texts = [], [], []
    for _ in range(30):
        hosts.append(rnd.choice("ab"))
        roles.append([rnd.choice((OPEN, CHROME, MAIN)) for _ in range(rnd.randint(0, 5))])
        texts.append([" ".join(rnd.choice("xyz") for _ in range(rnd.randint(1, 12))) for _ in roles[-1]])
    span, keys = 4, np.arange(100, 130)
    streams = Streams(hosts, roles, texts, span)
    want = {}
    for key, host, rs, ts in zip(keys.tolist(), hosts, roles, texts, strict=True):
        for r, t in zip(rs, ts, strict=True):
            words = t.split(" ")
            if r != MAIN:
                for i in range(max(1, len(words) - span + 1)):
                    want.setdefault((host, *words[i : i + span]), set()).add(key)
    run, least, most = streams.runs(keys)
    assert len(set(run.tolist())) == len(run) and sorted(zip(least.tolist(), most.tolist(), strict=True)) == sorted((min(v), max(v)) for v in want.values())
    at = np.flatnonzero(streams.whole & (streams.block >= 0))
    again = dict(zip(run.tolist(), zip(least.tolist(), most.tolist(), strict=True), strict=True))
    for place, h in zip(at.tolist(), streams.hashed(at).tolist(), strict=True):
        page, block, i = int(streams.page[place]), int(streams.block[place]), int(streams.at[place])
        words = texts[page][block].split(" ")[i : i + span]
        assert roles[page][block] == OPEN and again[h] == (min(want[hosts[page], *words]), max(want[hosts[page], *words]))
    none = Streams([], [], [], span)
    assert len(none.runs(np.zeros(0, np.int64))[0]) == 0


def test_pages_in_slices():
    from kinquery.llm.html_main import page_slices

    batch = pa.RecordBatch.from_arrays([pa.array([["a" * 3_000_000], [], ["b" * 2_000_000, "c"], ["d"], ["e" * 9_000_000], ["f"]])], ["texts"])
    assert [p.num_rows for p in page_slices(batch)] == [2, 2, 1, 1] and [p.num_rows for p in page_slices(batch.slice(1, 3))] == [3]


def test_boilerplate_by_repetition(spark):
    from kinquery.llm.html_main import main_text

    note = "please read our terms of use before you post anything"
    rows = [(i, f"http://h{i % 2}.org/{i}", f"<body><p>story number {i} tells of item {i * 7}</p><p>{note}</p><p>all rights</p></body>") for i in range(8)]
    rows += [(90, "http://other.org/a", f"<p>{note}</p>"), (91, None, None), (92, "http://h0.org/x", ""), (93, "http://h0.org/y", PAGE), (None, "u", "<p>lone</p>"), (94, "http://one.org", "<p>same page twice</p>"), (94, "http://one.org", "<p>same page twice</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(4)
    got = main_text(pages).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(text[i] == f"story number {i} tells of item {i * 7}" for i in range(8))
    assert text[90] == note and text[91] == text[92] == "" and text[93].startswith("Head & line") and text[None] == "lone" and text[94] == "same page twice"
    assert all(r.n_chars == len(r.text) for r in got)
    assert main_text(pages.limit(0)).count() == 0


def test_pages_that_mark_their_article_go_through_the_array(spark):
    from kinquery.llm.html_main import main_text

    note, once = "please read our terms of use before you post anything", "this advert was only set on a single page of the host"
    rows = [(i, "http://h.org/x", f"<body><nav>Home</nav><p>{note} {i}</p><article><p>{note}</p><p>story {i}</p></article><p>{once if i == 2 else ''}</p><footer>{note}</footer></body>") for i in range(4)]
    rows += [(9, "http://other.org/x", rows[0][2]), (10, None, f"<article>{note}</article>")]
    got = {r.page_id: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    # the check after the array keeps what articles repeat, and drops what stands outside them once
    assert all(got[i].text == f"{note}\n\nstory {i}" and got[i].n_chars == len(got[i].text) for i in range(4))
    # a menu of one token, the note's ten and the footer's ten repeat on the host; the number and the advert do not
    assert [got[i].boilerplate_tokens for i in range(4)] == [21] * 4
    assert (got[9].text, got[9].boilerplate_tokens) == (f"{note}\n\nstory 0", 0) and (got[10].text, got[10].boilerplate_tokens) == (note, 0)


# op5: decontamination


def leaks_by_hand(texts, items, threshold=0.5, overlap=0.8, k1=1.2, b=0.75):
    """(doc, item): score, with plain dictionaries and sets of word tuples."""
    word = lambda t: re.findall(r"[^\W_]+", t.lower())
    bags, parts = {}, {}
    for i, text in items:
        lines = [w for w in map(word, text.split("\n")) if w]
        if lines:
            question, answer = lines[0], sum(lines[1:], [])
            parts[i] = [question, answer] if min(len(question), len(answer)) >= 5 else [question + answer]
            bags[i] = question + answer
    mean, longest = sum(map(len, bags.values())) / len(bags), max(map(len, bags.values()))
    df = {}
    for bag in bags.values():
        for w in set(bag):
            df[w] = df.get(w, 0) + 1
    weights = {}
    for i, bag in bags.items():
        w = {x: math.log(1 + (len(bags) - df[x] + 0.5) / (df[x] + 0.5)) * bag.count(x) * (k1 + 1) / (bag.count(x) + k1 * (1 - b + b * len(bag) / mean)) for x in set(bag)}
        weights[i] = {x: v / sum(w.values()) for x, v in w.items()}
    out = {}
    for d, text in texts:
        words = word(text)
        passages = [set(words[i : i + 2 * longest]) for i in range(0, max(1, len(words)), longest)]
        for i, w in weights.items():
            score = max(sum(v for x, v in w.items() if x in p) for p in passages)
            if score >= threshold:
                runs = lambda ws, n: {tuple(ws[j : j + n]) for j in range(len(ws) - n + 1)}
                n = min(5, len(parts[i][0]))
                if all(len(runs(p, n) & runs(words, n)) >= overlap * len(runs(p, n)) for p in parts[i]):
                    out[d, i] = score
    return out


def test_leaks(spark):
    from kinquery.llm.decontaminate import find_leaks, without_leaks

    rnd = random.Random(3)
    vocab = ["the", "of", "and"] * 6 + ["".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    line = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, line(rnd.randint(8, 40)) + ("\n" + line(rnd.randint(5, 12)) if i % 3 == 0 else "")) for i in range(40)] + [(77, "tiny one"), (78, ""), (79, "the of and the of and")]
    docs = []
    for d in range(120):
        body = [line(rnd.randint(0, 300)), line(rnd.randint(0, 200))]
        if d % 4 == 0:
            words = items[d % 40][1].split(" ")
            if d % 8 == 0 and len(words) > 20:
                words[5] = "altered"
            body.insert(1, " ".join(words).upper() if d % 12 == 0 else " ".join(words))
        docs.append((d, " ".join(body)))
    docs += [(500, ""), (501, items[3][1]), (502, "x" * 50_000 + " " + items[4][1])]
    frame = spark.createDataFrame([*docs, (600, None), (None, items[5][1])], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([*items, (None, "no id here at all"), (80, None)], "item_id long, text string")
    want = leaks_by_hand(docs, items)
    got = find_leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id): round(r.score, 9) for r in got} == {k: round(v, 9) for k, v in want.items()} and len(got) == len(want) > 15
    for chunk in (4000, 700, 200):
        assert sorted(map(tuple, find_leaks(frame, bench, index_bytes=chunk).collect())) == sorted(map(tuple, got))
    # partial copies about the threshold, however items are dealt
    partial = []
    for d in range(150):
        words = items[d % 40][1].split()
        partial.append((d, " ".join(words[: max(1, len(words) * rnd.randint(70, 100) // 100)])))
    some = spark.createDataFrame(partial, "doc_id long, text string")
    by_hand = leaks_by_hand(partial, items, threshold=0.85)
    for chunk in (1 << 20, 700):
        rows = find_leaks(some, bench, threshold=0.85, index_bytes=chunk).collect()
        assert {(r.doc_id, r.item_id): round(r.score, 9) for r in rows} == {k: round(v, 9) for k, v in by_hand.items()}
    left = without_leaks(frame, bench)
    dirty = {d for d, _ in want}
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted(d for d, _ in [*docs, (600, None)] if d not in dirty) and left.columns == frame.columns
    assert find_leaks(frame.limit(0), bench).count() == 0 and find_leaks(frame, bench.limit(0)).count() == 0


# op6: language


def sample_languages(n, seed):
    rnd = random.Random(seed)
    parts = {"en": ["the", "of", "and", "tion", "ing", "is", "with"], "de": ["der", "und", "sch", "ung", "nicht", "ein", "ü"], "fr": ["le", "que", "eau", "les", "è", "pour", "ç"]}
    out = []
    for i in range(n):
        k = rnd.choice(sorted(parts))
        out.append((i, " ".join(rnd.choice(parts[k]) + rnd.choice(parts[k]) for _ in range(rnd.randint(5, 60))), k))
    return out


def test_language_is_held_out_and_right(spark):
    from kinquery.llm.language import held_out, learn, predict

    rows = sample_languages(400, 1) + [(1000, None, "en"), (1001, "", "de"), (1002, "123 !?", "fr"), (1003, "the of and tion", None), (None, "der und sch", "de"), (1004, "le que " * 30_000, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = learn(docs, ~held_out(F.col("doc_id")))
    assert model.langs == ["de", "en", "fr"]
    got = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("out"), "text", "lang"), model).collect()
    by = {r.doc_id: r for r in got}
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002)) and by[1004].lang_pred == "fr" and by[None].lang_pred == "de"
    real = [r for r in got if r.lang and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.lang == r.lang_pred for r in real if r.out) / max(1, sum(r.out for r in real)) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    # what isn't learned from can't matter
    other = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert np.array_equal(learn(other, ~held_out(F.col("doc_id"))).log_prob, model.log_prob)
    none = learn(docs.where("lang is null"), F.lit(True))
    assert {r.lang_pred for r in predict(docs.drop("score"), none).collect()} == {"und"}
    assert predict(docs.limit(0).drop("score"), model).count() == 0


def test_naive_bayes_against_dictionaries(spark):
    """The learned model and its scores against sums over dictionaries of n-grams, their buckets aside."""
    from kinquery.llm.language import features, learn, predict

    rows = sample_languages(150, 2) + [(900, "The  OF--and", "en"), (901, "é è", "fr"), (902, "x", "xx"), (903, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    buckets, alpha = 1 << 12, 0.5

    def grams(text):
        cleaned = " " + re.sub(r"[^a-zà-ÿ]+", " ", text.lower())
        cleaned = " " + cleaned.lstrip(" ") if cleaned.strip() else " "
        return [cleaned[max(0, i - n + 1) : i + 1] for i in range(len(cleaned)) for n in (1, 2, 3)]

    def hashed(text):
        found, bounds = features([text], buckets)
        return np.concatenate([g[: bounds[1]] for g in found]).tolist()

    # as many distinct n-grams by hand as buckets, where the hash is wide
    wide = [g[: b[1]] for g, b in (features([rows[3][1]], 1 << 23),) for g in g]
    by_order = [{x[-n:].rjust(n) for x in grams(rows[3][1])} for n in (1, 2, 3)]
    assert len(set(wide[0].tolist())) == len({x for x in by_order[0]})
    counts, docs_of = {}, {}
    for _, text, lang in rows:
        if text is not None:
            docs_of[lang] = docs_of.get(lang, 0) + 1
            for b in hashed(text):
                counts.setdefault(lang, {})[b] = counts.setdefault(lang, {}).get(b, 0) + 1
    total = sum(docs_of.values())

    def by_hand(text):
        scores = {}
        for lang, n in docs_of.items():
            whole = sum(counts[lang].values()) + alpha * buckets
            scores[lang] = math.log(n / total) + sum(math.log((counts[lang].get(b, 0) + alpha) / whole) for b in hashed(text))
        best = min(scores, key=lambda k: (-scores[k], k))
        return best, 1 / sum(math.exp(v - scores[best]) for v in scores.values())

    for r in predict(docs.drop("lang"), learn(docs, F.lit(True), buckets)).collect():
        if r.text:
            lang, score = by_hand(r.text)
            assert r.lang_pred == lang and abs(r.score - score) < 1e-3
    many = spark.createDataFrame([(i, f"word{i} ab", f"l{i:04d}") for i in range(600)], "doc_id long, text string, lang string")
    model = learn(many, F.lit(True), 1 << 10, most_cells=1 << 20)
    assert len(model.langs) == 600 and model.buckets == 1 << 10 and predict(many, model).count() == 600
    with pytest.raises(ValueError, match="600 languages"):
        learn(many, F.lit(True), most_cells=1 << 20)


def test_windows_have_the_features_of_the_whole_text():
    from kinquery.llm.language import features, windows

    rnd = random.Random(4)
    for n in (1, 2, 3, 7, 8, 9, 40, 500):
        text = "".join(rnd.choice("abcé ,.Zß😀  \n") for _ in range(n))
        grams, bounds = features([text], 1 << 12)
        for size in (1, 2, 3, 8, 64):
            parts = list(windows(text, 1 << 12, size))
            for k in range(3):
                assert np.concatenate([p[k] for p in parts]).tolist() == grams[k][: bounds[1]].tolist(), (text, size)


def test_long_texts_are_read_in_windows(spark, monkeypatch):
    from kinquery.llm import language

    rows = sample_languages(60, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, F.lit(True))
    for text in (rows[0][1], None, "", "é " * 40, rows[1][1] * 30):
        whole = model.scores([text])[0]
        monkeypatch.setattr(language, "LONG", 3)
        assert np.allclose(model.scores([text])[0], whole, rtol=1e-6)
        monkeypatch.undo()
    batch = pa.RecordBatch.from_arrays([pa.array([None, "a" * 600_000, "", "b" * 600_000, *["c" * 400] * 3000])], ["text"])
    parts = list(language._together(batch))
    assert [len(t or "") for p in parts for t in p.column("text").to_pylist()] == [0, 600_000, 0, 600_000, *[400] * 3000]
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) < 1_100_000 for p in parts) and max(p.num_rows for p in parts) <= 250


def test_features_by_hand():
    from kinquery.llm.language import features

    texts = ["Ab, c!", None, "", "é", "--", "xAb"]
    grams, bounds = features(texts, 1 << 16)
    apart = [features([t], 1 << 16) for t in texts]
    assert np.diff(bounds).tolist() == [6, 1, 1, 2, 1, 4]
    again, b2 = features(texts[::-1], 1 << 16)
    for i, t in enumerate(texts):
        j = len(texts) - 1 - i
        for k in range(3):
            if t:
                assert grams[k][bounds[i] : bounds[i + 1]].tolist() == again[k][b2[j] : b2[j + 1]].tolist() == apart[i][0][k][: apart[i][1][1]].tolist()


# op7: shards


def test_shards_are_even_and_keep_groups(spark):
    from kinquery.llm.sharding import balanced_shards

    rnd = random.Random(4)
    rows = [(i, f"text {rnd.randint(0, 10**9)}") for i in range(700)]
    for g in range(40):
        rows += [(1000 + 100 * g + k, f"copy {g}") for k in range(rnd.randint(2, 12))]
    rows += [(20_000 + k, "everywhere") for k in range(500)] + [(None, "n"), (None, None), (7, "text again"), (8, ""), (9, "ü" * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).repartition(6)
    got = balanced_shards(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    out = balanced_shards(docs).collect()
    assert len(out) == len(rows) and {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    sizes = [sum(r.shard == s for r in out) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    text = dict(rows)
    for r in out:
        if r.doc_id is not None and r.doc_id not in (7, 8, 9):
            assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    where: dict = {}
    for r in got:
        where.setdefault(r.text, set()).add(r.shard)
    assert sum(len(v) > 1 for k, v in where.items() if k and k.startswith("copy")) == 0
    assert balanced_shards(docs.limit(0)).count() == 0
    few = balanced_shards(docs.limit(3)).collect()
    assert len({r.shard for r in few}) == 3
    # the result is a frame like any other
    result = balanced_shards(docs)
    want = sorted(map(str, result.collect()))
    assert sorted(map(str, result.coalesce(1).collect())) == sorted(map(str, result.repartition(5).collect())) == want
    both = result.limit(0).unionByName(result.where("shard = 3")).unionByName(result.where("shard <> 3"))
    assert sorted(map(str, both.collect())) == want and result.count() == len(want)
    assert result.join(result.select("shard", "slot"), ["shard", "slot"]).count() == len(want)


def shards_of(spark, texts):
    from kinquery.llm.sharding import balanced_shards, cut_links

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    result = balanced_shards(docs)
    out = {r.doc_id: r.shard for r in result.collect()}
    sizes = [list(out.values()).count(s) for s in range(8)]
    assert len(out) == len(texts) and max(sizes) - min(sizes) <= 1
    return out, cut_links(result).first()


def test_shards_full_of_pairs_swap_them(spark):
    texts = [f"pair {i // 2}" for i in range(4000)]
    _, (linked, cut) = shards_of(spark, texts)
    assert linked == 4000 and cut <= 80  # a random start cuts 1750


def test_shards_keep_what_fits_and_cut_the_rest_into_few(spark):
    texts = [f"alone {i}" for i in range(3000)] + ["nearly a shard"] * 550 + ["a third"] * 1600 + [f"three {i // 3}" for i in range(300)]
    out, (linked, cut) = shards_of(spark, texts)
    assert len({out[i] for i in range(3000, 3550)}) == 1 and len({out[i] for i in range(3550, 5150)}) <= 4
    assert linked == 2450 and cut <= 1200  # the third needs three shards


def test_grants_keep_quotas():
    from kinquery.llm.sharding import grant

    rnd = random.Random(6)
    for _ in range(200):
        room = [rnd.randint(-5, 20) for _ in range(4)]
        asked = [(rnd.random() < 0.2, rnd.randint(0, 9), rnd.randrange(4), rnd.randrange(4), rnd.randint(1, 30)) for _ in range(40)]
        net = list(room)
        granted = set(grant(asked, room))
        for evicted, bucket, to, start, rows in asked:
            if (to, bucket, evicted) in granted and to != start:
                net[to] -= rows
                net[start] += rows
        assert all(n >= min(0, r) for n, r in zip(net, room, strict=True))


# op9: licences


def scan_by_hand(text):
    from kinquery.llm.licenses import BASE

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    starts, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licences(spark):
    from kinquery.llm.licenses import scan

    rnd = random.Random(6)
    bits = ["GNU General Public License", "gnu general", "public license", "Apache License", "MIT License", "mit", "CC BY", "cc-by", "cc  by-NC", "word", "é", "Ünder", "Kword", "license mit license", "\n", "..", "lıcense", "MİT License"]
    texts = [" ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(150)]
    texts += [None, "", " ", "...", "mit license", "Licensed under the Apache License, Version 2.0.", "Released under CC BY-NC 4.0", "filler " * 30_000 + "MIT License", "permission is hereby granted, free of charge, to any person obtaining a copy", "Mozilla Public License", "K mit license"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "MIT License")], "doc_id long, text string").withColumn("words", F.lit("clash"))
    out = scan(docs).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        if r.doc_id is not None:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == scan_by_hand(texts[r.doc_id]), texts[r.doc_id]
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    by = {texts[r.doc_id]: r for r in out if r.doc_id is not None}
    assert by["Licensed under the Apache License, Version 2.0."].labels == "apache,apache-2.0" and by["Licensed under the Apache License, Version 2.0."].score == 1.0
    assert by["permission is hereby granted, free of charge, to any person obtaining a copy"].labels == "mit-text"
    assert by["Mozilla Public License"].labels == "" and by["mit license"].score == 0.5
    assert scan(docs.limit(0)).count() == 0
    assert "Python" not in docs.sparkSession._jvm.PythonSQLUtils.explainString(scan(docs)._jdf.queryExecution(), "simple")


# op10: vectors


def test_top_k_by_brute_force(spark):
    from kinquery.llm.vector_topk import exact_top_k

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(0, 0.2, (1200, 24)), 2)
    x[100:130] = x[7]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(5000, None), (5050, [float("nan")] * 24), (5100, [None] * 24), (5150, []), (None, [0.1] * 24), (5200, [float("inf")] + [0.0] * 23), (5250, [0.3] * 7), (5300, [0.2] * 7)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(5)
    q = np.floor(256 * x).astype(np.int64)
    want = {}
    for i in range(0, 1200, 50):
        s = q @ q[i]
        best = sorted((-int(s[j]), j) for j in range(1200) if j != i)[:5]
        want[i] = [(k + 1, j, -v) for k, (v, j) in enumerate(best)]
    want[5250], want[5300] = [(1, 5300, 7 * 76 * 51)], [(1, 5250, 7 * 76 * 51)]
    for block in (16 << 20, 2000):
        got: dict = {}
        for r in exact_top_k(df, F.col("vec_id") % 50 == 0, block_bytes=block).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert {k: sorted(v) for k, v in got.items()} == want
    assert exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_prune(spark):
    from kinquery.llm.vector_topk import BlockSearch

    rng = np.random.default_rng(6)
    base = np.repeat(rng.normal(0, 40, (40, 1, 16)), 60, axis=1).reshape(2400, 16).repeat(4, axis=1) + rng.normal(0, 2, (2400, 64))
    x = np.floor(base).astype(np.int64)
    s = BlockSearch(np.arange(50), x[:50], 5, 1)
    s.feed(np.arange(2400), x)
    assert s.pairs_exact < 0.25 * 50 * 2400
    score = x[:50] @ x.T
    for i in range(50):
        assert [(-a, b) for a, b in s.best[i]] == [(v, j) for v, j in sorted(((int(score[i, j]), j) for j in range(2400) if j != i), key=lambda p: (-p[0], p[1]))[:5]]


def test_top_k_is_exact_in_integers_of_any_size(spark):
    from kinquery.llm.vector_topk import exact_top_k

    rnd = np.random.default_rng(9)
    for size in (2.0**21, 2.0**26, 2.0**29, 3e7 * 1e6, 1e40, 1e300):
        x = rnd.normal(size=(60, 3)) * size
        x[7] = x[3]
        x[11] = -x[3]
        x[20:30] = rnd.normal(size=(10, 3))
        rows = [(i, v) for i, v in enumerate(x.tolist())]
        whole = [[(n * 256) // d for n, d in map(float.as_integer_ratio, v)] for _, v in rows]
        got = {}
        for r in exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 10 == 0).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for q in range(0, 60, 10):
            best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in range(60) if c != q)[:5]
            assert sorted(got[q]) == [(k + 1, c, max(-(2**63 - 1), min(2**63 - 1, -s))) for k, (s, c) in enumerate(best)], (size, q)


def test_top_k_over_many_blocks(spark):
    from kinquery.llm.vector_topk import exact_top_k

    rnd = np.random.default_rng(10)
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(rnd.normal(size=(200, 8)).tolist())], "vec_id long, embedding array<double>")
    one, many = (sorted(map(tuple, exact_top_k(docs, F.col("vec_id") % 4 == 0, block_bytes=n).collect())) for n in (1 << 20, 160))
    assert one == many and len(one) == 250
