"""Queries over the standard tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id as lang
from .chat_quotes import link_quotes
from .decontaminate import contamination
from .embedding_dedup import embedding_dedup
from .minhash_dedup import minhash_dedup
from .packing import pack
from .pii import KINDS, find_pii
from .suffix_dedup import suffix_dedup
from .toxicity import held_out, toxicity, train_toxicity
from .url_filter import filter_urls

# Host, path and verdict (fixed values).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash_dedup(table(spark, sf_dir, "documents"), words_per_shingle=4, per_cent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lang.language_id(docs.select("doc_id", "text"), lang.train_language_id(docs))
    return out.select("doc_id", lang.held_out().alias("held_out"), "lang_pred", "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_columns(found: DataFrame) -> DataFrame:
    """Counts and a digest of the plain spans, and all spans as text."""
    plain = F.filter("pii", lambda s: ~s["disguised"])
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    of = lambda kind: F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(plain), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_columns(find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    out = toxicity(docs.select("doc_id", "text"), model, threshold=0.7)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)


def op9_columns(linked: DataFrame) -> DataFrame:
    """parent_turn is -1 where a message has no parent, position where it has no conversation."""
    return linked.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("parent_turn", "position")})


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_columns(link_quotes(table(spark, sf_dir, "conversations")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_minhash_dedup,
        op3_embedding_dedup,
        op4_language_id,
        op5_url_filter,
        op6_pii,
        op7_toxicity,
        op8_decontamination,
        op9_quotation_linking,
        op10_best_fit_packing,
    )
}

_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_BY_LENGTH = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
windows AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS w FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 199))) AS i FROM d)),
again AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows JOIN again USING (w)),
numbered AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs),
cut AS (SELECT g.doc_id, count(*) AS n, sum(b - a) AS gone, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head, max(b) AS last FROM gaps g JOIN d ON g.doc_id = d.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
""",
    "op2_minhash_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM w
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reached.doc_id, y FROM reached JOIN both_ways ON r = x),
least AS (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, l.doc_id = component_id AS kept
FROM least l LEFT JOIN sizes s ON s.doc_id = l.doc_id
""",
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reached(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reached.vec_id, y FROM reached JOIN links ON r = x),
least AS (SELECT vec_id, min(r) AS component_id FROM reached GROUP BY vec_id),
degrees AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT l.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, l.vec_id = component_id AS kept
FROM least l LEFT JOIN degrees d ON d.vec_id = l.vec_id
""",
    "op9_quotation_linking": r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, text, coalesce(regexp_matches(text, '(?m)^[ \t]{0,3}>'), false) AS quoted FROM conversations),
split AS (SELECT id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM m WHERE quoted),
lines AS (SELECT id, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM split),
levels AS (SELECT id, k, line, len(regexp_replace(regexp_extract(line, '^[ \t]{0,3}((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '^[ \t]{0,3}((?:>[ \t]?)+)', '') AS body FROM lines),
near AS (SELECT *, lag(level) OVER w AS before, lead(level) OVER w AS after FROM levels WINDOW w AS (PARTITION BY id ORDER BY k)),
own AS (
  SELECT id, string_agg(line, chr(10) ORDER BY k) AS body FROM near
  WHERE level = 0 AND NOT (coalesce(after, 0) > 0 AND regexp_matches(line, '(?i)^\s*(?:on .+ wrote|am .+ schrieb.*|le .+ a écrit|el .+ escribió|.{1,80} (?:wrote|said|writes))\s*:\s*$'))
  GROUP BY id
),
cleaned AS (SELECT m.id, conv_id, turn, role, CASE WHEN quoted THEN regexp_replace(regexp_replace(coalesce(body, ''), '^\s+|\s+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') ELSE text END AS content FROM m LEFT JOIN own ON own.id = m.id),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> level THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS run FROM near),
passages AS (SELECT id, run, min(level) AS level, string_agg(body, chr(10) ORDER BY k) AS passage FROM numbered WHERE level > 0 GROUP BY id, run),
pieces AS (
  SELECT id, run, level, unnest(string_split(regexp_replace(regexp_replace(passage, '\s+', ' ', 'g'), '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) AS x FROM passages
  UNION ALL
  SELECT id, NULL, NULL, unnest(string_split(regexp_replace(regexp_replace(content, '\s+', ' ', 'g'), '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) FROM cleaned
),
sentences AS (SELECT DISTINCT conv_id, turn, run, level, trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')) AS s FROM pieces JOIN m USING (id) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
firsts AS (SELECT conv_id, s, min(turn) AS source FROM sentences WHERE run IS NULL AND s <> '' GROUP BY conv_id, s),
votes AS (SELECT q.conv_id, q.turn, run, level, source, count(*) AS n FROM sentences q JOIN firsts f ON f.conv_id = q.conv_id AND f.s = q.s WHERE run IS NOT NULL AND source < q.turn GROUP BY q.conv_id, q.turn, run, level, source),
best AS (SELECT conv_id, turn, run, level, max({'n': n, 'source': source}) AS b FROM votes GROUP BY conv_id, turn, run, level),
linked AS (SELECT conv_id, turn, count(*) AS n_linked, (max(b) FILTER (WHERE level = 1)).source AS parent_turn FROM best GROUP BY conv_id, turn),
steps(conv_id, turn, thread, depth) AS (
  SELECT conv_id, turn, parent_turn, 1 FROM linked WHERE parent_turn IS NOT NULL
  UNION ALL
  SELECT p.conv_id, p.turn, l.parent_turn, p.depth + 1 FROM steps p JOIN linked l ON l.conv_id = p.conv_id AND l.turn = p.thread WHERE l.parent_turn IS NOT NULL
),
roots AS (SELECT conv_id, turn, min(thread) AS thread, max(depth) AS depth FROM steps GROUP BY conv_id, turn),
counts AS (SELECT id, count(*) AS n FROM passages GROUP BY id)
SELECT c.conv_id, c.turn, role, content, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(content, '') AS formatted,
       CAST(coalesce(n, 0) AS BIGINT) AS n_quotes, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, CAST(coalesce(parent_turn, -1) AS BIGINT) AS parent_turn,
       coalesce(thread, c.turn) AS thread, CAST(coalesce(depth, 0) AS BIGINT) AS depth,
       CASE WHEN c.conv_id IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY c.conv_id ORDER BY coalesce(thread, c.turn) NULLS LAST, c.turn NULLS LAST) - 1 END AS position
FROM cleaned c LEFT JOIN counts k ON k.id = c.id LEFT JOIN linked l ON l.conv_id = c.conv_id AND l.turn = c.turn LEFT JOIN roots r ON r.conv_id = c.conv_id AND r.turn = c.turn
""",
    "op5_url_filter": f"""
WITH rests AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests
)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{h}{p}'" for h, p, _ in _BY_LENGTH)} ELSE NULL END AS rule,
       CASE {" ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{v}'" for h, p, v in _BY_LENGTH)} ELSE 'allow' END AS verdict
FROM parts
""",
}
