"""The registered queries of the operators here, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, likelihood, ngram_join, packing, perspectives, quality, substrings, topk, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules that the registered query applies.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.deduplicate(_table(spark, sf_dir, "documents"), length=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def crc_of_id() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn_from=crc_of_id() % 5 != 0)
    return scored.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(_table(spark, sf_dir, "conversations"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scored = likelihood.score(_table(spark, sf_dir, "documents"), crc_of_id() % 10 != 0, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.withColumn("held_out", crc_of_id() % 10 == 0)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), n=5, percent=75)


def tokenizer_path() -> str:
    """Where the tokenizer file of the registered packing query lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), size=4096, end_id=2)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


SQL_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

SQL_URL_FILTER = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, t, rule, verdict) AS (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'), ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
m AS (SELECT p.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.t) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""

SQL_PERSPECTIVES = """
WITH t AS (SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS said FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.*, p.perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name FROM t JOIN p USING (conv_id))
SELECT conv_id, perspective, turn, role, name,
  '<|' || replace(role, '<|', '<\\|') || coalesce(' name=' || replace(name, '<|', '<\\|'), '') || '|>' || chr(10) || replace(said, '<|', '<\\|') || '<|end|>' || chr(10) AS rendered,
  role = 'assistant' AS learn, length(said) AS n_chars, CASE WHEN role = 'assistant' THEN length(said) ELSE 0 END AS n_learn
FROM r
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED, _ALNUM = r"'[^\x20\x09-\x0D]+'", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

# Words and windows as texts, by the rules of the queries above.
SQL_SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
k AS (SELECT doc_id, CAST(unnest(range(len(w) - 49)) AS BIGINT) AS s, w FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + 50], ' ')) AS h FROM k),
low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM win JOIN low USING (h) WHERE low < doc_id),
left_ AS (SELECT t.doc_id, sha256(string_agg(t.word, ' ' ORDER BY t.i)) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d) t ANTI JOIN gone g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, coalesce(left_.kept, sha256('')) AS kept_sha256 FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN left_ ON left_.doc_id = d.doc_id
"""

SQL_DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
p AS (SELECT DISTINCT item, m, array_to_string(w[s + 1 : s + m], ' ') AS h FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(len(w) - least(10, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
k AS (SELECT doc_id, w, m, unnest(range(len(w) - m + 1)) AS s FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m),
hit AS (SELECT k.doc_id, k.s, k.m, p.item FROM k JOIN p ON p.m = k.m AND p.h = array_to_string(k.w[k.s + 1 : k.s + k.m], ' ')),
n AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS i FROM (SELECT DISTINCT doc_id, s, m FROM hit)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""

SQL_NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[s + 1 : s + 5], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""

QUERIES = {"op1_url_filter": op1_url_filter, "op2_substring_dedup": op2_substring_dedup, "op3_quality": op3_quality, "op4_chat_perspectives": op4_chat_perspectives, "op5_decontamination": op5_decontamination, "op6_likelihood": op6_likelihood, "op7_licenses": op7_licenses, "op8_ngram_join": op8_ngram_join, "op9_packing": op9_packing, "op10_topk": op10_topk}
ORACLES = {"op1_url_filter": SQL_URL_FILTER, "op2_substring_dedup": SQL_SUBSTRINGS, "op4_chat_perspectives": SQL_PERSPECTIVES, "op5_decontamination": SQL_DECONTAMINATION, "op8_ngram_join": SQL_NGRAM_JOIN, "op10_topk": SQL_TOPK}
