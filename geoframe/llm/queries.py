"""The operators bound to the tables of a data folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, extract, hnsw, jaccard, mixing, packing, quality, topk, toxicity, url_filter, warc, wavelet, whitening


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer() -> str:
    """Path of the vocabulary that the token queries name."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, folder, "documents"))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return wavelet.round_trip(_table(spark, folder, "documents"), tokenizer())


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn documents; targets are the tempered marginals of the corpus."""
    drawn = mixing.sample(_table(spark, folder, "documents"))
    return drawn.select("doc_id", "source", "lang", drawn["_topic"].alias("topic"), drawn["_tokens"].alias("tokens"), drawn["_probability"].alias("probability"))


def op5_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return hnsw.near_duplicates(_table(spark, folder, "embeddings"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"), k=10, every=100)


#: The rules of the query on pages.
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract.main_text(_table(spark, folder, "pages"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), tokenizer())


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.damaged_and_repaired(_table(spark, folder, "conversations"))


def op12_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_table(spark, folder, "pages"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_token_files": op3_token_files,
    "op4_mixing": op4_mixing,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_url_filter": op8_url_filter,
    "op9_main_text": op9_main_text,
    "op10_packing": op10_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_warc_archive": op12_warc_archive,
    "op13_whitening": op13_whitening,
}

_SQL_URL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*(/[^?#]*)?', 1, 's'), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
fits AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC) AS k
  FROM (SELECT DISTINCT * FROM parts) p JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN (SELECT * FROM fits WHERE k = 1) f ON f.page_id IS NOT DISTINCT FROM p.page_id AND f.host = p.host AND f.path = p.path
"""

_SQL_TOP_K = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""

_SQL_NEAR_VECTORS = """
WITH RECURSIVE unit AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM unit UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT u.vec_id, (SELECT count(*) FROM links l WHERE l.a = u.vec_id) AS n_links, component_id, u.vec_id = component_id AS kept
FROM unit u JOIN least USING (vec_id)
"""

#: Links are counted by joins on shingles; components settle in a few rounds, as groups are dense.
_SQL_JACCARD = (
    r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * k >= 75 * (i.n + j.n - k)),
e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
c0 AS (SELECT DISTINCT x, x AS c FROM e)"""
    + "".join(f",\nc{i} AS MATERIALIZED (SELECT a.x, least(any_value(a.c), min(b.c)) AS c FROM c{i - 1} a JOIN e ON e.x = a.x JOIN c{i - 1} b ON b.x = e.y GROUP BY a.x)" for i in range(1, 17))
    + """
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c16.c, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c16 ON c16.x = d.doc_id
"""
)

_SQL_REPAIR = r"""
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(b AS BIGINT))) AS t),
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 20 AS kind
  FROM conversations, crc_table),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, range(2) copies(k) WHERE kind <> 0 AND (k = 0 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, substr(role, 1, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM rows),
told AS (
  SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS duplicate,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM placed),
turns AS MATERIALIZED (SELECT *, blank OR duplicate AS deleted, NOT blank AND NOT duplicate AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM told),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM turns GROUP BY conv_id),
-- n s u a: nothing yet, after system, after user, after assistant; the letters carry initials
moves(f, t, ins, r) AS (VALUES ('n', 's', '', 's'), ('n', 'u', '', 'u'), ('s', 'u', '', 'u'), ('a', 'u', '', 'u'), ('u', 'a', '', 'a'), ('u', 'u', 'Ia', 'u'), ('n', 'a', 'Iu', 'a'), ('s', 'a', 'Iu', 'a'), ('a', 'a', 'Iu', 'a')),
best(conv_id, place, state, b) AS (
  SELECT conv_id, 0, 'n', {'c': 0, 't': ''} FROM facts
  UNION ALL
  SELECT conv_id, place, state, min(b) FROM (
    SELECT d.conv_id, r.place, d.state, {'c': d.b.c + 3, 't': d.b.t || 'D-'} AS b FROM best d JOIN turns r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.place = d.place + 1
    UNION ALL
    SELECT d.conv_id, r.place, m.t, {'c': d.b.c + CASE WHEN m.ins = '' THEN 0 ELSE 2 END + CASE WHEN r.initial = m.r THEN 0 ELSE 2 END + CASE WHEN r.truncated THEN 1 ELSE 0 END,
      't': d.b.t || m.ins || CASE WHEN r.initial = m.r THEN 'K' ELSE 'R' END || m.r}
    FROM best d JOIN turns r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.place = d.place + 1 JOIN moves m ON m.f = d.state
    WHERE NOT r.deleted AND (m.r <> 's' OR r.initial = 's'))
  GROUP BY ALL),
ends AS (
  SELECT f.conv_id, min(CASE WHEN d.state = 'u' THEN {'c': d.b.c + 2, 't': d.b.t || 'Ia'} ELSE d.b END) AS b
  FROM facts f JOIN best d ON d.conv_id IS NOT DISTINCT FROM f.conv_id AND d.place = f.n WHERE d.state <> 's' GROUP BY f.conv_id),
edits AS (
  SELECT conv_id, i, t[2 * i - 1] AS letter, t[2 * i] AS initial, count(*) FILTER (t[2 * i - 1] <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS place
  FROM (SELECT conv_id, b.t AS t, unnest(range(1, length(b.t) // 2 + 1)) AS i FROM ends)),
lines AS (
  SELECT e.conv_id, i, CASE WHEN letter = 'K' THEN r.role WHEN e.initial = 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE r.text END AS line
  FROM edits e LEFT JOIN turns r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.place = e.place WHERE letter <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS text FROM lines GROUP BY conv_id)
SELECT c.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
  CAST(coalesce(e.b.c, 0) AS BIGINT) AS cost, coalesce(translate(e.b.t, 'sua-', ''), '') AS audit, sha256(coalesce(x.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
"""
_SQL_WARC = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
d AS (
  SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS keeper,
    row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, url) AS k FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  translate(array_to_string(list_transform(range(4), lambda i: to_base(CAST('0x' || substr(h, CAST(1 + 10 * i AS BIGINT), 10) AS BIGINT), 32, 8)), ''), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN keeper END AS refers_to
FROM d
"""

ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard_join": _SQL_JACCARD, "op5_embedding_near_dedup": _SQL_NEAR_VECTORS, "op7_exact_top_k": _SQL_TOP_K, "op8_url_filter": _SQL_URL, "op11_conversation_repair": _SQL_REPAIR, "op12_warc_archive": _SQL_WARC}
