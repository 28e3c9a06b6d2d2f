"""Queries of this subpackage over the driver's tables, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinquery.runtime import scratch_path, spread, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids as Simple-8b segments, read them back and digest them."""
    from kinquery.llm.token_store import token_digests, write_tokens

    path = scratch_path(spark, "token-ids")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_digests(spark, path)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    from kinquery.llm.html_main import main_text

    return main_text(spread(table(spark, sf_dir, "pages"))).select("page_id", "url", "text", "n_chars")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents into pieces, decode the ids again, and digest both."""
    from kinquery.llm.piece_codec import encode_documents

    both = encode_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer_path("piece_bpe_32k.model"), decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, quantiles and truncated totals of all documents for every context limit."""
    from kinquery.llm.token_counts import context_limits, length_histogram, token_lengths
    from kinquery.runtime import stored

    lengths = token_lengths(spread(table(spark, sf_dir, "documents")), tokenizer_path("byte_bpe_50k.json"))
    return context_limits(stored(length_histogram(lengths), "length-histogram"))


def op5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that stand in documents, as pairs of ids."""
    from kinquery.llm.decontaminate import find_leaks

    return find_leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that aren't held out."""
    from kinquery.llm.language import held_out, learn, predict

    docs = spread(table(spark, sf_dir, "documents"))
    out = held_out(F.col("doc_id"))
    model = learn(docs, ~out)
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal counts, equal texts together where quotas allow."""
    from kinquery.llm.sharding import balanced_shards

    return balanced_shards(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents, linked at two or fewer differing bits."""
    from kinquery.llm.simhash import near_duplicates

    found = near_duplicates(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in all documents."""
    from kinquery.llm.licenses import scan

    return scan(spread(table(spark, sf_dir, "documents")))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    from kinquery.llm.vector_topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn as an example, all turns before it as context, written and read again."""
    from kinquery.llm.chat_format import digests, with_control_text, write_examples

    path = scratch_path(spark, "chat")
    write_examples(with_control_text(table(spark, sf_dir, "conversations")), path)
    return digests(spark, path)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents, with a proof each and some leaves tampered with."""
    from kinquery.llm.merkle import manifest

    found = manifest(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source in every order."""
    from kinquery.llm.filter_audit import audit

    return audit(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


QUERIES = {"op1_token_ids": op1_token_ids, "op2_main_text": op2_main_text, "op3_pieces": op3_pieces, "op4_token_counts": op4_token_counts, "op5_leaks": op5_leaks, "op6_language": op6_language, "op7_shards": op7_shards, "op8_simhash": op8_simhash, "op9_licenses": op9_licenses, "op10_vectors": op10_vectors, "op11_chat": op11_chat, "op12_manifest": op12_manifest, "op13_filters": op13_filters}


def _licence_sql() -> str:
    """The scan in SQL: phrases at every place, and the share of a line's IDF that stands around one."""
    from kinquery.llm.licenses import BASE, TEMPLATES

    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"
    rows = [(label, "TRUE", p, p) for p, label in BASE] + [(label, "FALSE", k, line) for label, k, line in TEMPLATES]
    place = lambda k, line: next(i for i in range(len(line.split())) if line.split()[i : i + len(k.split())] == k.split())
    values = ", ".join(f"({i}, '{label}', {base}, {quoted(k)}, {quoted(line)}, {place(k, line)})" for i, (label, base, k, line) in enumerate(rows))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        t(t, label, base, phrase, line, place) AS (VALUES {values}),
        vocabulary AS (SELECT DISTINCT unnest(line) AS word FROM t),
        total AS (SELECT count(*) AS n FROM d),
        df AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT r, unnest(w) AS word FROM d) SEMI JOIN vocabulary USING (word) GROUP BY word),
        idf AS (SELECT word, round(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)), 6) AS idf FROM vocabulary LEFT JOIN df USING (word), total),
        weights AS (SELECT t, list(idf ORDER BY j) AS idfs FROM (SELECT t, unnest(line) AS word, generate_subscripts(line, 1) AS j FROM t) JOIN idf USING (word) GROUP BY t),
        hits AS (
            SELECT r, t.t, label, base, w, line, place, idfs, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(phrase)] = phrase)) AS s
            FROM d JOIN t ON list_has_all(w, phrase) JOIN weights USING (t)),
        graded AS (
            SELECT r, label, base, s, CASE WHEN NOT base THEN
                list_sum(list_transform(range(len(line)), lambda j: CASE WHEN s - place + j >= 0 AND w[s - place + j + 1] = line[j + 1] THEN idfs[j + 1] ELSE 0 END)) / list_sum(idfs) END AS g FROM hits),
        found AS (
            SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR g >= 0.6) AS labels, max(g) FILTER (g >= 0.6) AS g
            FROM graded GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
            coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
            CAST(least(1.0, round(CASE WHEN g IS NOT NULL THEN g WHEN n_base > 0 THEN 0.5 ELSE 0 END, 6)) AS DOUBLE) AS score
        FROM d LEFT JOIN found USING (r)
    """


def _chat_sql() -> str:
    """Pieces' lengths by formula, digests of joined texts, and a cumulative length an example."""
    control = "'<|im_end|><|im_start|>assistant ok'"
    return rf"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', {control}), (-1, 1, 'assistant', {control})),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, role = 'assistant' AS reply,
                     length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 12 + 1 + 10 + 1 AS chars FROM c),
        s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS until, place = max(place) OVER (PARTITION BY conv_id) AS is_last FROM n)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (reply), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (reply), '')) AS loss_sha256,
            CAST(sum(until) FILTER (reply OR is_last) AS BIGINT) AS formatted_chars, count(*) FILTER (reply OR is_last) AS n_examples
        FROM s GROUP BY conv_id
    """


def _manifest_sql(levels: int = 5, top_levels: int = 3, width: int = 16) -> str:
    """The tree level by level for up to width ** levels leaves a source; crc32 from its polynomial."""

    def climb(name: str, depth: int) -> list[str]:
        """n<k>: grp, place, d, run, size of the group; up to one node a group. p<k> below: paths from level k on."""
        steps = []
        for k in range(depth):
            steps.append(f"{name}r{k} AS (SELECT *, list(d) OVER (PARTITION BY grp, place // {width} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run, count(*) OVER (PARTITION BY grp) AS size FROM {name}{k})")
            steps.append(f"{name}{k + 1} AS (SELECT grp, place // {width} AS place, CASE WHEN size = 1 THEN d ELSE sha256(array_to_string(run, '')) END AS d FROM {name}r{k} WHERE place % {width} = 0)")
        return steps

    def descend(name: str, depth: int) -> str:
        """Siblings before and after at every level, null where the group has one node only."""
        cols, joins = [], []
        for k in range(depth):
            r = f"r{k}"
            joins.append(f"JOIN {name}r{k} {r} ON {r}.grp = l.grp AND {r}.place = l.place // {width**k}")
            alone = f"{r}.size = 1"
            cols.append(f"CASE WHEN {alone} THEN '' ELSE array_to_string({r}.run[1 : {r}.place % {width}], '') END AS {name}a{k}, CASE WHEN {alone} THEN '' ELSE array_to_string({r}.run[{r}.place % {width} + 2 :], '') END AS {name}b{k}, {alone} AS {name}s{k}")
        return f"SELECT l.grp, l.place, {', '.join(cols)} FROM {name}0 l {' '.join(joins)}"

    field = lambda f: f"coalesce(CAST(strlen(CAST({f} AS VARCHAR)) AS VARCHAR) || ':' || CAST({f} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = "list_reduce(list_prepend(i, list_transform(range(8), lambda z: CAST(z AS BIGINT))), lambda c, z: xor(c // 2, (c % 2) * 3988292384))"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda c, b: xor(c // 256, crc.t[xor(c % 256, b) + 1])), 4294967295)"
    steps, at = [], "coalesce(forged, leaf)"
    for name, depth in (("n", levels), ("m", top_levels)):
        for k in range(depth):
            steps.append(f"CASE WHEN {name}s{k} THEN {at} ELSE sha256({name}a{k} || {at} || {name}b{k}) END AS f{len(steps)}")
            at = f"f{len(steps) - 1}"
    chain, source = [], "every"
    for i, step in enumerate(steps):
        chain.append(f"fold{i} AS (SELECT *, {step} FROM {source})")
        source = f"fold{i}"
    proof = " || ".join(f"{name}a{k} || {name}b{k}" for name, depth in (("n", levels), ("m", top_levels)) for k in range(depth))
    return f"""
        WITH crc AS (SELECT list_transform(range(256), lambda i: {bits}) AS t),
        h AS (SELECT doc_id, coalesce('=' || source, '') AS grp, {leaf('text')} AS leaf, {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low, {crc} % 5 = 0 AS is_forged FROM documents, crc),
        leaves AS (SELECT doc_id, grp, leaf, CASE WHEN is_forged THEN low END AS forged, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM h),
        n0 AS (SELECT grp, place, leaf AS d FROM leaves),
        {", ".join(climb("n", levels))},
        m0 AS (SELECT 0 AS grp, row_number() OVER (ORDER BY grp) - 1 AS place, grp AS of, d FROM n{levels}),
        {", ".join(climb("m", top_levels))},
        np AS ({descend("n", levels)}), mp AS ({descend("m", top_levels)}),
        every AS (
            SELECT doc_id, leaf, forged, m0.d AS subroot, (SELECT d FROM m{top_levels}) AS root, np.* EXCLUDE (grp, place), mp.* EXCLUDE (grp, place)
            FROM leaves JOIN np USING (grp, place) JOIN m0 ON m0.of = leaves.grp JOIN mp ON mp.place = m0.place),
        {", ".join(chain)}
        SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, {at} AS folded_root, {at} = root AS verified FROM {source}
    """


#: From counts of each set of failed filters, a removal by the smallest place of a failed filter in the order.
_FILTERS_SQL = r"""
    WITH d AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
            doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS e FROM documents),
    l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
    f AS (
        SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
            regexp_matches(text, '[#$%&*|]') AS d, coalesce(e, FALSE) AS e, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM d LEFT JOIN l USING (doc_id)),
    g AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS fails,
            count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
    o AS (SELECT p.v || q.v || r.v || s.v || t.v AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.v, q.v, r.v, s.v, t.v])) = 5),
    w AS (
        SELECT part, filter_order, step, n, good, bad, fails, contains(fails, filter_order[step]) AS fails_here,
            list_max(list_transform(range(1, step), lambda k: CASE WHEN contains(fails, filter_order[k]) THEN 1 ELSE 0 END)) AS gone
        FROM g, o, (SELECT unnest(range(1, 6)) AS step)),
    z AS (
        SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT fails_here AND coalesce(gone, 0) = 0), 0) AS kept, coalesce(sum(n) FILTER (fails_here AND coalesce(gone, 0) = 0), 0) AS removed,
            coalesce(sum(n) FILTER (fails_here AND gone = 1), 0) AS redundant, coalesce(sum(n) FILTER (fails_here AND len(fails) = 1), 0) AS unique_fails,
            coalesce(sum(good) FILTER (fails_here AND coalesce(gone, 0) = 0), 0) AS good_lost, coalesce(sum(bad) FILTER (fails_here AND coalesce(gone, 0) = 0), 0) AS toxic_lost
        FROM w GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
        CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM z
"""


ORACLES: dict[str, str] = {
    # for pages with an article of paragraphs and headings, as the tables have them
    "op2_main_text": r"""
        WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages),
        b AS (
            SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(
                replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', chr(34)), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),
                '\s+', ' ', 'g'))) AS parts FROM a),
        c AS (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM b)
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
    """,
    "op9_licenses": _licence_sql(),
    "op11_chat": _chat_sql(),
    "op12_manifest": _manifest_sql(),
    "op13_filters": _FILTERS_SQL,
    "op10_vectors": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
        WHERE rank <= 5
    """,
}
