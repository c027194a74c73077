"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontaminate, exactdup, htmltext, merkle, mixing, neardup, quality, simhash, substrings, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_groups(_table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(_table(spark, sf_dir, "documents"), percent=85, width=3)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.recover(_table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", "role", "recovered", F.sha2("rendered", 256).alias("rendered_sha256"), "trained")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(_table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(_table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"), radius=4, width=4)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_mixing, op3_decontamination, op4_url_filter, op5_quality, op6_repeated_substrings, op7_exact_dedup, op8_near_dedup, op9_chat_format, op10_html_text,
        op11_collocations, op12_merkle, op13_simhash,
    )
}

ORACLE_SQL = {
    "op2_mixing": r"""
        WITH docs AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h
            FROM documents),
        sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
        weighed AS (
            SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                   CAST(2 * source_size AS DOUBLE) AS cap, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget
            FROM sums),
        levels AS (
            SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS own_level
            FROM weighed),
        goals AS (
            SELECT source, source_size, round(least(cap, coalesce(max(CASE WHEN own_level * weight <= cap THEN own_level END) OVER () * weight, cap)), 6) AS target
            FROM levels),
        parts AS (
            SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM goals),
        ordered AS (
            SELECT d.doc_id, d.size, d.h, p.source_size, p.target, p.times, p.target - p.times * p.source_size AS rest,
                   CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
                   CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS BIGINT) AS own
            FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target,
               size * (times + CASE WHEN upto <= rest THEN 1 WHEN upto - own <= rest AND upto - rest < rest - (upto - own) THEN 1 ELSE 0 END) AS taken
        FROM ordered
    """,
    "op3_decontamination": r"""
        WITH doc_words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        item_words AS (
            SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        item_windows AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT n FROM item_windows),
        doc_windows AS (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths WHERE len(w) >= n)),
        hits AS (SELECT doc_id, i, d.n, item_id FROM doc_windows d JOIN item_windows USING (s, n)),
        words_hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
        items_hit AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc_words LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
    """,
    "op4_url_filter": r"""
        WITH rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
        parts AS (
            SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        fits AS (
            SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
            FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
    """,
    "op7_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, coalesce(length(text), 0) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
        w AS (
            SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
                   CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM w
    """,
    "op8_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
        steps AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(id, other) AS (SELECT a, b FROM steps UNION SELECT r.id, s.b FROM reach r JOIN steps s ON s.a = r.other),
        least_of AS (SELECT id, min(other) AS other FROM reach GROUP BY id)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(other, doc_id)) AS kept
        FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON id = doc_id
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(CAST(lang AS VARCHAR), 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
        grams AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
        counted AS (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
        cuts AS (
            SELECT lang, phrase, f AS a, unnest(range(1, k)) AS c, string_split(phrase, ' ') AS w FROM counted WHERE k > 1),
        parts AS (
            SELECT x.lang, x.phrase, a, c, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f::HUGEINT + r.f) AS BIGINT) AS score
            FROM cuts x JOIN counted l ON l.lang = x.lang AND l.phrase = array_to_string(w[1:c], ' ') JOIN counted r ON r.lang = x.lang AND r.phrase = array_to_string(w[c + 1:], ' ')),
        worst AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
        inside AS (
            SELECT lang, f, array_to_string(w[i:i + n - 1], ' ') AS phrase
            FROM (SELECT lang, f, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM (SELECT lang, f, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS n FROM counted WHERE k > 2))),
        longer AS (SELECT lang, phrase, max(f) AS within FROM inside GROUP BY lang, phrase),
        kept AS (
            SELECT w.* FROM worst w LEFT JOIN longer s ON s.lang = w.lang AND s.phrase = w.phrase
            WHERE coalesce(100::HUGEINT * within < 80::HUGEINT * a, true))
        SELECT k.lang, CAST(row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score
        FROM kept k JOIN total t ON t.lang = k.lang
        QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) <= 2000
    """,
    "op12_merkle": r"""
        WITH RECURSIVE bits AS (
            SELECT b, 0 AS step, CAST(b AS BIGINT) AS c FROM range(256) t(b)
            UNION ALL SELECT b, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
        crc_table AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE step = 8),
        docs AS (
            SELECT doc_id, lang,
                   [coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-'),
                    coalesce(strlen(text) || ':' || text, '-')] AS ends,
                   coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n0, coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS n1,
                   xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
                                   lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1])), 4294967295) % 7 = 0 AS tampered
            FROM documents, crc_table),
        leaves AS (
            SELECT *, sha256(ends[1] || n0 || ends[2]) AS leaf, CASE WHEN tampered THEN sha256(ends[1] || n1 || ends[2]) ELSE sha256(ends[1] || n0 || ends[2]) END AS start FROM docs),
        numbered AS (
            SELECT doc_id, lang, leaf, start, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
        nodes AS (
            SELECT lang, 0 AS level, i, n, leaf AS h FROM numbered
            UNION ALL SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, n, i // 2),
        subroots AS (
            SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS n FROM nodes WHERE n = 1),
        tops AS (
            SELECT 0 AS level, tree AS i, n, subroot AS h FROM subroots
            UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, n, i // 2),
        steps AS (
            SELECT d.lang, d.i, s.level, s.i < (d.i >> s.level) AS is_left, s.h FROM numbered d JOIN nodes s ON s.lang IS NOT DISTINCT FROM d.lang AND s.i = xor(d.i >> s.level, 1)
            UNION ALL
            SELECT d.lang, d.i, 1000 + s.level, s.i < (t.tree >> s.level), s.h
            FROM numbered d JOIN subroots t ON t.lang IS NOT DISTINCT FROM d.lang JOIN tops s ON s.i = xor(t.tree >> s.level, 1)),
        -- Levels without a sibling count too: their node is hashed alone.
        heights AS (SELECT lang, i, unnest(range(0, CAST(ceil(log2(n)) AS BIGINT))) AS level FROM numbered
                    UNION ALL SELECT d.lang, d.i, 1000 + unnest(range(0, CAST(ceil(log2((SELECT count(*) FROM subroots))) AS BIGINT))) FROM numbered d),
        paths AS (
            SELECT x.lang, x.i, list(struct_pack(b := CASE WHEN is_left THEN h ELSE '' END, a := CASE WHEN NOT is_left THEN h ELSE '' END) ORDER BY x.level) AS path, string_agg(coalesce(h, ''), '' ORDER BY x.level) AS proof
            FROM heights x LEFT JOIN steps s ON s.lang IS NOT DISTINCT FROM x.lang AND s.i = x.i AND s.level = x.level GROUP BY x.lang, x.i),
        folded AS (
            SELECT doc_id, leaf, d.lang, sha256(coalesce(proof, '')) AS proof_sha256,
                   list_reduce(list_prepend(struct_pack(b := start, a := ''), coalesce(path, [])), lambda h, x: struct_pack(b := sha256(coalesce(x.b, '') || h.b || coalesce(x.a, '')), a := '')).b AS folded_root
            FROM numbered d LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM d.lang AND p.i = d.i)
        SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root, proof_sha256, folded_root, folded_root = (SELECT h FROM tops WHERE n = 1) AS verified
        FROM folded f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang
    """,
}
