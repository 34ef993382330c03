"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm import chat, decontamination, language, lines, neardup, search, secrets, substrings, toxicity
from cadence.llm._shared import table
from cadence.llm.packing import pack


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(spark, table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(spark, table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(spark, table(spark, sf_dir, "documents"), how=lines.Passages())


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(spark, table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(spark, table(spark, sf_dir, "conversations"))


def op9_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_minhash_neardup": op7_minhash_neardup,
    "op8_chat_format": op8_chat_format,
    "op9_top_k_search": op9_top_k_search,
    "op10_toxicity": op10_toxicity,
}

OP9_SQL = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: Every string of 50 bytes, as hexadecimal digits, and the smallest document it starts in.
OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM n WHERE n >= 50)),
o AS (SELECT s, min(doc_id) AS owner FROM s GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
c AS (SELECT s.doc_id, i FROM s JOIN o USING (s) WHERE owner < s.doc_id),
e AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS opens FROM c),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e) GROUP BY 1, 2),
k AS (SELECT doc_id, b AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), n) AS b FROM (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, -1, 0 FROM n) JOIN n USING (doc_id)),
w AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM k JOIN n USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM n JOIN w USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM r GROUP BY 1) USING (doc_id)
"""

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP4_WORDS = "regexp_extract_all(" + _ASCII_LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = f"""
WITH i AS (SELECT item_id::VARCHAR AS item, {_OP4_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item, array_to_string(w[p + 1 : p + 8], ' ') AS g, least(8, len(w)) AS size FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 7))) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_OP4_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM g),
x AS (SELECT doc_id, size, p, array_to_string(w[p + 1 : p + size], ' ') AS g FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS p FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, p, size, item FROM x JOIN g USING (g, size)),
h AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM (SELECT doc_id, p, unnest(range(size)) AS o FROM m) GROUP BY 1),
n AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(len(w) - 2), lambda p: w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3])) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op3_suffix_dedup": OP3_SQL,
    "op4_decontamination": OP4_SQL,
    "op7_minhash_neardup": OP7_SQL,
    "op9_top_k_search": OP9_SQL,
}
