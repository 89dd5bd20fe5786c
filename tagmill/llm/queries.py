"""The operators over their whole tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm import exactdedup, imatch, lengths, mixture, negatives, packing, partenum, phrases, pii, toolcalls, toxicity, urls, vectors
from tagmill.llm.common import table

#: The key of the surrogates; a deployment passes its own.
SECRET = "change-me"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents"), SECRET)


def op2_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op3_int8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link_calls(*toolcalls.tool_traffic(table(spark, sf_dir, "conversations")))


def op5_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.3)


def op6_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(table(spark, sf_dir, "documents"), 4, 85, 100)


def op7_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.count_tokens(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))


def op10_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th row is an anchor; every 7th label is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_pii_surrogates, op2_url_vocabulary, op3_int8_near_vectors, op4_tool_call_linking, op5_kneser_ney_toxicity,
        op6_partenum_join, op7_token_histogram, op8_exact_dedup, op9_mixing, op10_length_buckets, op11_hard_negatives, op12_imatch_fingerprints,
        op13_phrase_collocations,
    )
    return {f.__name__: f for f in ops}


def _op2_sql() -> str:
    def hit(term: str) -> str:
        return f"regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}]){term}($|[^\\p{{L}}\\p{{N}}])')::INT"

    strict = " + ".join(hit(t) for t in urls.STRICT)
    soft = " + ".join(hit(t) for t in urls.SOFT)
    weight = "round(" + " + ".join(f"{w}::DOUBLE * {hit(t)}" for t, w in urls.SOFT.items()) + ", 6)"
    return f"""
    WITH p AS (
      SELECT page_id, lower(coalesce(url, '')) AS low,
             CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    s AS (
      SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM p),
    r AS (
      SELECT *, '.' || host AS h, {strict} AS strict_hits, {soft} AS soft_hits, {weight} AS soft_weight FROM s),
    j AS (
      SELECT *, CASE WHEN ends_with(h, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                     WHEN ends_with(h, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN ends_with(h, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                     WHEN ends_with(h, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
      FROM r)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                WHEN strict_hits > 0 OR (soft_hits > 1 AND soft_weight >= 1) THEN 'block' ELSE 'allow' END AS verdict,
           strict_hits::INT AS strict_hits, soft_hits::INT AS soft_hits, soft_weight
    FROM j"""


_OP3_SQL = """
    WITH RECURSIVE v AS (
      SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    pairs AS (
      SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
        ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
    reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
    low AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
    n AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
    SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(low.c, vec_id) AS component_id, vec_id = coalesce(low.c, vec_id) AS kept
    FROM embeddings LEFT JOIN low ON vec_id = low.x LEFT JOIN n ON vec_id = n.x"""

_OP4_SQL = """
    WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
    called AS (
      SELECT *, 'call-' || conv_id || '-' || turn AS call_id, row_number() OVER w - 1 AS level,
             'call-' || conv_id || '-' || lag(turn) OVER w AS follows
      FROM turns WHERE role IN ('user', 'system') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    calls AS (
      SELECT conv_id, call_id, level, CASE role WHEN 'user' THEN 'ask' ELSE 'configure' END AS name,
             CASE WHEN role = 'user' THEN '{' || coalesce('"follows":"' || follows || '",', '') || '"n_chars":' || length(text) || ',"text":' || to_json(text) || '}'
                  ELSE '{"text":' || to_json(text) || '}' END AS args,
             CASE WHEN follows IS NULL THEN '[]' ELSE '["' || follows || '"]' END AS deps
      FROM called),
    results AS (
      SELECT conv_id, 'call-' || conv_id || '-' || (turn - 1) AS call_id, min(text) AS content FROM turns WHERE role = 'assistant' GROUP BY 1, 2)
    SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, name,
           CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status, level,
           CASE WHEN c.call_id IS NULL THEN ['no call'] ELSE []::VARCHAR[] END AS errors,
           CASE WHEN c.call_id IS NULL THEN '{"call_id":"' || r.call_id || '","result":' || to_json(content) || '}'
                ELSE '{"arguments":' || args || ',"call_id":"' || c.call_id || '","depends_on":' || deps || ',"level":' || level || ',"name":"' || name || '"'
                     || coalesce(',"result":' || to_json(content), '') || '}' END AS json
    FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id"""

_OP8_SQL = r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
    g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)"""


_OP11_SQL = """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
             list_sum(list_transform(list_zip(a.c, b.c), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.c) = len(b.c) WHERE a.vec_id % 50 = 0),
    pos AS (SELECT anchor_id, id, score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER w)::INT AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM pos p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
    WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
    QUALIFY row_number() OVER w <= 3"""


_OP13_SQL = r"""
    WITH w AS (
      SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w
      FROM (SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents)),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
    g AS (
      SELECT lang, gram, count(*) AS f
      FROM (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS gram
            FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)
      GROUP BY ALL HAVING count(*) >= 100),
    gone AS (
      SELECT DISTINCT s.lang, s.gram
      FROM (SELECT lang, f, unnest([gram[1 : len(gram) - 1], gram[2 :]]) AS gram FROM g WHERE len(gram) > 2) b JOIN g s ON s.lang = b.lang AND s.gram = b.gram AND 100 * b.f >= 100 * s.f),
    cuts AS (
      SELECT c.lang, c.gram, c.f AS a, k, x.f AS l, y.f AS r, n, (1000 * c.f::HUGEINT * n // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM (SELECT lang, gram, f, unnest(range(1, len(gram))) AS k FROM g WHERE len(gram) > 1) c
      JOIN g x ON x.lang = c.lang AND x.gram = c.gram[1 : k] JOIN g y ON y.lang = c.lang AND y.gram = c.gram[k + 1 :] JOIN totals t ON t.lang = c.lang
      ANTI JOIN gone d ON d.lang = c.lang AND d.gram = c.gram),
    s AS (SELECT *, array_to_string(gram, ' ') AS phrase FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER v AS rank, phrase, a, l, r, n, score FROM s
    WINDOW v AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) QUALIFY row_number() OVER v <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": _OP11_SQL, "op13_phrase_collocations": _OP13_SQL, "op2_url_vocabulary": _op2_sql(), "op3_int8_near_vectors": _OP3_SQL, "op4_tool_call_linking": _OP4_SQL, "op8_exact_dedup": _OP8_SQL}
