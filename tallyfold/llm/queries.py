"""The corpus operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import common
from tallyfold.llm.bpe import encode_digest
from tallyfold.llm.chat_format import conversations_of, preference_format, swapped_pairs
from tallyfold.llm.divergence import source_divergence
from tallyfold.llm.exact_dedup import exact_dedup
from tallyfold.llm.importance import classify
from tallyfold.llm.jaccard_join import jaccard_components
from tallyfold.llm.max_score import top_products
from tallyfold.llm.multi_index import neighbours
from tallyfold.llm.packing import packed_documents
from tallyfold.llm.prefix_trie import prefix_trie, rebuilt
from tallyfold.llm.secret_scan import secret_digest
from tallyfold.llm.suffix_dedup import suffix_dedup
from tallyfold.llm.url_filter import filter_urls, host_of


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(common.read(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(common.read(spark, sf_dir, "documents"))


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(common.read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_format(swapped_pairs(conversations_of(common.read(spark, sf_dir, "conversations"))))


def op8_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no fetch times and no list, so both follow from rules: a page is fetched
    page_id days (modulo a year) into 2024; a site (the host's last three labels) whose MD5 starts
    with 0 to 3 is listed on day 16 * (second digit) and, if its third digit is below 8, freed 60
    days later."""
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.expr("date_add(date'2024-01-01', cast(page_id % 365 as int))"))
    labels = F.split(host_of(F.col("url")), r"\.")
    site = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 2), 3), ".")
    sites = captures.select(site.alias("host")).where("host is not null").distinct().withColumn("m", F.md5("host"))
    digit = lambda k: F.expr(f"instr('0123456789abcdef', substr(m, {k}, 1)) - 1")
    listed = sites.where(digit(1) < 4).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), 16 * digit(2)))
    added = listed.select("host", F.col("day").alias("listed_at"), F.lit(True).alias("active"))
    freed = listed.where(digit(3) < 8).select("host", F.date_add("day", 60).alias("listed_at"), F.lit(False).alias("active"))
    return filter_urls(captures, added.unionByName(freed))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.read(spark, sf_dir, "documents"))


def op10_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(common.read(spark, sf_dir, "documents"))


def op12_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(common.read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(common.read(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_multi_index": op5_multi_index,
    "op6_importance_resampling": op6_importance_resampling,
    "op7_preference_format": op7_preference_format,
    "op8_temporal_url_filter": op8_temporal_url_filter,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_prefix_bpe": op10_prefix_bpe,
    "op11_source_divergence": op11_source_divergence,
    "op12_max_score": op12_max_score,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
            FROM documents)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
            SELECT doc_id, text_sha256,
                   first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY body) AS group_size
            FROM d)
    """,
    "op7_preference_format": r"""
        WITH rows_ AS (
            SELECT conv_id, turn, min(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))) AS t
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1, 2),
        numbered AS (
            SELECT conv_id, t.role AS role, t.text AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k
            FROM rows_),
        replied AS (SELECT conv_id, max(k) AS pos FROM numbered WHERE role = 'assistant' GROUP BY 1),
        replies AS (SELECT n.conv_id, n.text FROM numbered n JOIN replied r ON r.conv_id = n.conv_id AND n.k = r.pos),
        pairs AS (
            SELECT r.conv_id, r.pos, p.conv_id AS rejected_id, p.text AS reply, n.text AS own,
                   CASE WHEN p.text = n.text THEN r.pos ELSE r.pos - 1 END AS shared
            FROM replied r JOIN replies n USING (conv_id) LEFT JOIN replies p ON p.conv_id = xor(r.conv_id, 1)),
        drawn AS (
            SELECT conv_id, k, role, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' || chr(10) AS body FROM numbered),
        parts AS (
            SELECT p.conv_id, 'p' AS side, k, role, head, body FROM pairs p JOIN drawn d ON d.conv_id = p.conv_id AND d.k <= p.shared
            UNION ALL SELECT p.conv_id, 'c', k, role, head, body FROM pairs p JOIN drawn d ON d.conv_id = p.conv_id AND d.k > p.shared
            UNION ALL SELECT conv_id, 'r', pos, 'assistant', '<|im_start|>assistant' || chr(10), reply || '<|im_end|>' || chr(10)
            FROM pairs WHERE reply IS NOT NULL AND shared < pos),
        placed AS (
            SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, side ORDER BY k) AS upto FROM parts),
        texts AS (
            SELECT conv_id, side, string_agg(head || body, '' ORDER BY k) AS text,
                   string_agg(CASE WHEN role = 'assistant' THEN (upto - length(body))::BIGINT::VARCHAR || ':' || upto::BIGINT::VARCHAR END, ',' ORDER BY k) AS mask
            FROM placed GROUP BY 1, 2)
        SELECT p.conv_id AS chosen_id, p.rejected_id, p.shared::INTEGER AS n_shared, coalesce(a.text, '') AS prompt,
               coalesce(c.text, '') AS chosen, coalesce(r.text, '') AS rejected, coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
        FROM pairs p LEFT JOIN texts a ON a.conv_id = p.conv_id AND a.side = 'p'
        LEFT JOIN texts c ON c.conv_id = p.conv_id AND c.side = 'c' LEFT JOIN texts r ON r.conv_id = p.conv_id AND r.side = 'r'
    """,
    "op8_temporal_url_filter": r"""
        WITH captures AS (
            SELECT page_id, DATE '2024-01-01' + (page_id % 365)::INTEGER AS pos,
                   nullif(rtrim(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.'), '') AS host
            FROM pages),
        sites AS (
            SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) - 2), len(string_split(host, '.'))), '.') AS host
            FROM captures WHERE host IS NOT NULL),
        digits AS (SELECT host, [instr('0123456789abcdef', substr(md5(host), k, 1)) - 1 FOR k IN [1, 2, 3]] AS d FROM sites),
        entries AS (
            SELECT host, DATE '2024-01-01' + (16 * d[2])::INTEGER AS since, true AS active FROM digits WHERE d[1] < 4
            UNION ALL SELECT host, DATE '2024-01-01' + (16 * d[2] + 60)::INTEGER, false FROM digits WHERE d[1] < 4 AND d[3] < 8),
        names AS (
            SELECT DISTINCT host, pos, k, array_to_string(list_slice(string_split(host, '.'), k, len(string_split(host, '.'))), '.') AS name
            FROM captures, unnest(range(1, len(string_split(host, '.')) + 1)) AS u(k) WHERE host IS NOT NULL),
        hits AS (
            SELECT n.host, n.pos, n.k, n.name, e.since, e.active
            FROM names n ASOF JOIN entries e ON n.name = e.host AND n.pos >= e.since),
        best AS (SELECT host, pos, arg_min(name, k) AS matched, arg_min(since, k) AS listed_since, arg_min(active, k) AS blocked FROM hits GROUP BY 1, 2)
        SELECT c.page_id, c.host, b.matched, b.listed_since, coalesce(b.blocked, false) AS blocked
        FROM captures c LEFT JOIN best b ON b.host = c.host AND b.pos = c.pos
    """,
    "op9_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(list_slice(w, i, i + 4), ' ') FOR i IN range(1, len(w) - 3)])
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
        shingles AS (SELECT doc_id, unnest(s) AS x FROM sets),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
        SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
        FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
    """,
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents),
        t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
        langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY 1),
        groups_ AS (SELECT DISTINCT lang, source FROM d),
        used AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
        sizes AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups_ g LEFT JOIN used USING (lang, source) GROUP BY 1, 2),
        p AS (
            SELECT s.lang, s.source, k.term, coalesce(u.n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 2)) // (s.total + 2 * l.v) AS p,
                   1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
            FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN used u ON u.lang = s.lang AND u.source = s.source AND u.term = k.term),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
            FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS o, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
                       FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) f
                   ON f.lang = a.lang AND f.s = a.source AND f.o = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
            FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
    "op12_max_score": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS (SELECT vec_id AS query_id, min(e) AS e FROM v WHERE vec_id % 100 = 0 GROUP BY 1),
        scored AS (
            SELECT query_id, vec_id, coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])), 0)::BIGINT AS score
            FROM q JOIN v ON vec_id <> query_id)
        SELECT query_id, rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
        WHERE rank <= 10
    """,
    "op13_prefix_trie": r"""
        WITH own AS (
            SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS x, length(coalesce(text, '')) AS n,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
            FROM conversations WHERE conv_id IS NOT NULL),
        listed AS (SELECT conv_id, list({'x': x, 'n': n} ORDER BY k) AS t FROM own GROUP BY 1),
        bits AS (
            SELECT conv_id, t, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
                   lambda s, c: list_reduce(list_prepend(xor(s, c), range(8)::UBIGINT[]), lambda y, i: xor(y // 2, (y % 2) * 3988292384::UBIGINT))) AS crc
            FROM listed),
        mixed AS (
            SELECT b.conv_id, list_concat(coalesce(o.t[1:xor(b.crc, 4294967295::UBIGINT) % 6], []), b.t[xor(b.crc, 4294967295::UBIGINT) % 6 + 1:]) AS t
            FROM bits b LEFT JOIN listed o ON o.conv_id = b.conv_id - b.conv_id % 100),
        rows_ AS (
            SELECT conv_id, d, len(t) AS l, CASE WHEN d = 0 THEN '' ELSE array_to_string(list_transform(t[1:d], lambda z: z.x), '') END AS prefix,
                   CASE WHEN d = 0 THEN NULL WHEN d = 1 THEN '' ELSE array_to_string(list_transform(t[1:d - 1], lambda z: z.x), '') END AS above,
                   CASE WHEN d = 0 THEN 0 ELSE t[d].n END AS n
            FROM mixed, unnest(range(len(t) + 1)) AS u(d)),
        nodes AS (
            SELECT prefix, any_value(above) AS above, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
                   string_agg(CASE WHEN d = l THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends
            FROM rows_ GROUP BY 1),
        kids AS (SELECT above AS prefix, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY 1),
        whole AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (prefix)),
        below AS (
            SELECT r.prefix, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((w.n_convs - 1) * w.n) AS saved
            FROM whole w JOIN rows_ x ON x.conv_id = w.conv_id AND x.d = w.d JOIN rows_ r ON r.conv_id = x.conv_id AND r.d <= x.d GROUP BY 1)
        SELECT w.conv_id, w.d::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
               b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
        FROM whole w JOIN below b USING (prefix) LEFT JOIN whole p ON p.prefix = w.above
    """,
}
