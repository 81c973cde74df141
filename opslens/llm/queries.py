"""One query per operator, over whole tables, with production parameters; and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from opslens.llm import (
    exact_dedup,
    lm_score,
    mil_quality,
    mixing,
    near_dedup,
    packing,
    prefix_trie,
    quality_rules,
    secret_scan,
    spelling,
    substring_dedup,
    url_filter,
    warc,
)
from opslens.llm.store import table

Query = Callable[[SparkSession, str], DataFrame]


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__reps")).cast("long").alias("taken"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


PIECE = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents")).select(*PIECE)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.deduplicated_archives(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no rule fits, mirrors are blocked: URLs of pages whose HTML an earlier page has."""
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.url_filter(pages, rules, url_filter.mirrored_urls(pages))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_lm_score,
        op2_substring_dedup,
        op3_best_fit_packing,
        op4_exact_dedup,
        op5_mil_quality,
        op6_secret_scan,
        op7_mixing,
        op8_warc,
        op9_quality_rules,
        op10_near_dedup,
        op11_url_filter,
        op12_prefix_trie,
        op13_spelling_variants,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES: dict[str, str] = {
    "op4_exact_dedup": """
        WITH texts AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        )
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM texts
    """,
    "op8_warc": """
        WITH payloads AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), firsts AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM payloads
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM firsts
    """,
}
RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
ORACLES["op11_url_filter"] = rf"""
    WITH parts AS (
        SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) END AS rest
        FROM pages
    ), parsed AS (
        SELECT *, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
               list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
                   lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|\z)'))) AS params
        FROM parts
    ), urls AS (
        SELECT page_id, html, host, path, CASE WHEN rest IS NOT NULL THEN
               regexp_replace(regexp_replace(host, ':(80|443)\z', ''), '\.\z', '') || regexp_replace(path, '/+\z', '')
               || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical
        FROM parsed
    ), rules(rule_host, rule_path, rule_verdict) AS (VALUES {RULE_ROWS}),
    mirrors AS (
        SELECT DISTINCT canonical
        FROM (SELECT canonical, page_id > min(page_id) OVER (PARTITION BY html) AS later FROM urls WHERE html <> '')
        WHERE later AND canonical IS NOT NULL
    ), ruled AS (
        SELECT page_id, rule_host || rule_path AS rule, rule_verdict
        FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) = 1
    )
    SELECT u.page_id, host, path, rule,
           coalesce(rule_verdict, CASE WHEN m.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
           m.canonical IS NOT NULL AS listed
    FROM urls u LEFT JOIN ruled r ON r.page_id = u.page_id LEFT JOIN mirrors m ON m.canonical = u.canonical
"""
#: CRC-32 bit by bit; DuckDB has no function for it.
CRC32 = """
    xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, byte: list_reduce(
            list_prepend(xor(crc, byte), list_transform(range(8), lambda bit: bit)),
            lambda r, bit: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)
    ), 4294967295::BIGINT)
"""
ORACLES["op12_prefix_trie"] = f"""
    WITH turns AS (
        SELECT conv_id, role, text, digest,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos
        FROM (SELECT *, sha256(length(role) || ':' || role || text) AS digest
              FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
                    FROM conversations WHERE conv_id IS NOT NULL))
    ), convs AS (
        SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC32.format("conv_id::VARCHAR")} % 6 AS h
        FROM (SELECT DISTINCT conv_id FROM turns)
    ), rebuilt AS (
        SELECT c.conv_id, 0 AS own, pos, text, digest FROM convs c JOIN turns t ON t.conv_id = c.base AND pos < h
        UNION ALL
        SELECT c.conv_id, 1, pos, text, digest FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos >= h
    ), steps AS (
        SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars,
               sha256(string_agg(digest, ',') OVER w) AS node
        FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)
        UNION ALL
        SELECT conv_id, 0, 0, 'root' FROM convs
    ), nodes AS (
        SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(chars) AS chars
        FROM steps GROUP BY node
    ), linked AS (
        SELECT n.*, p.node AS parent, q.conv_id AS parent_conv_id
        FROM nodes n
        LEFT JOIN steps p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
        LEFT JOIN nodes q ON q.node = p.node
    ), counted AS (
        SELECT l.*, coalesce(k.n, 0) AS n_children
        FROM linked l LEFT JOIN (SELECT parent, count(*) AS n FROM linked GROUP BY parent) k ON k.parent = l.node
    ), sums AS (
        SELECT s.node, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves,
               sum((c.n_convs - 1) * c.chars)::BIGINT AS saved_tokens
        FROM counted c JOIN steps s ON s.conv_id = c.conv_id AND s.depth <= c.depth
        GROUP BY s.node
    ), ends AS (
        SELECT s.node, sha256(string_agg(s.conv_id::VARCHAR, ',' ORDER BY s.conv_id)) AS ends_sha256
        FROM steps s JOIN (SELECT conv_id, max(depth) AS depth FROM steps GROUP BY conv_id) m USING (conv_id, depth)
        GROUP BY s.node
    )
    SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
           coalesce(ends_sha256, sha256('')) AS ends_sha256
    FROM counted JOIN sums USING (node) LEFT JOIN ends USING (node)
"""
ORACLES["op13_spelling_variants"] = """
    WITH RECURSIVE crc AS (
        SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, list_transform(range(8), lambda bit: bit)),
            lambda r, bit: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)) AS steps
    ), runs AS (
        SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)
        WHERE length(run) >= 5 GROUP BY 1, 2
    ), hashed AS (
        SELECT run, n, xor(list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(
                string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: unicode(c)::BIGINT)),
            lambda r, c: CASE WHEN c < 128 THEN xor(steps[(xor(r, c) & 255) + 1], r >> 8)
                ELSE xor(steps[(xor(xor(steps[(xor(r, 195) & 255) + 1], r >> 8), c - 64) & 255) + 1],
                         xor(steps[(xor(r, 195) & 255) + 1], r >> 8) >> 8) END
        ), 4294967295::BIGINT) AS h
        FROM runs, crc
    ), slipped AS (
        SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
        FROM hashed
    ), words AS (
        SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
    ), gaps AS (
        SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
    ), near AS (
        SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT g.word, w.word FROM gaps g JOIN words w ON w.word = g.rest
        UNION SELECT w.word, g.word FROM gaps g JOIN words w ON w.word = g.rest
    ), best AS (
        SELECT r.word, count(*) AS n_near, first(r.other ORDER BY o.n DESC, r.other) AS other, max(o.n) AS other_n
        FROM near r JOIN words o ON o.word = r.other GROUP BY r.word
    ), forms AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
               CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
        FROM words w LEFT JOIN best b ON b.word = w.word
    ), paths AS (
        SELECT word, word AS root, form AS next FROM forms
        UNION ALL
        SELECT p.word, f.word, f.form FROM paths p JOIN forms f ON f.word = p.next
    )
    SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n
    FROM forms f JOIN paths p ON p.word = f.word AND p.next IS NULL
"""
ORACLES["op2_substring_dedup"] = r"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), windows AS (
        SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS h
        FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs)
    ), starts AS (
        SELECT r, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
    ), words AS (
        SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM docs
    ), marked AS (
        SELECT t.r, j, word, coalesce(max(i) OVER (PARTITION BY t.r ORDER BY j) >= j - 34, false) AS gone
        FROM words t LEFT JOIN starts s ON s.r = t.r AND s.i = t.j
    ), stripped AS (
        SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept
        FROM marked GROUP BY r
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM docs LEFT JOIN stripped USING (r)
"""
ORACLES["op10_near_dedup"] = r"""
    WITH RECURSIVE docs AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), shingles AS (
        SELECT DISTINCT r, hash(array_to_string(w[i : i + 1], ' ')) AS s
        FROM (SELECT r, w, unnest(range(1, greatest(len(w), 2))) AS i FROM docs WHERE len(w) > 0)
    ), sizes AS (
        SELECT r, count(*) AS n FROM shingles GROUP BY r
    ), shared AS (
        SELECT a.r AS a, b.r AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2
    ), links AS (
        SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b
        WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
    ), both_ways AS (
        SELECT a, b FROM links UNION SELECT b, a FROM links
    ), reach AS (
        SELECT a, b FROM both_ways UNION SELECT reach.a, l.b FROM reach JOIN both_ways l ON l.a = reach.b
    ), firsts AS (
        SELECT a AS r, min(d.doc_id) AS first_id FROM reach JOIN docs d ON d.r = reach.b GROUP BY a
    )
    SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(first_id, doc_id)) AS component_id,
           doc_id = least(doc_id, coalesce(first_id, doc_id)) AS kept
    FROM docs LEFT JOIN sizes USING (r) LEFT JOIN firsts USING (r)
"""
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
