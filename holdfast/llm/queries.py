"""The operators applied to the given tables, with production parameters, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.session import shared_folder

from . import centroids, chat, decontaminate, lines, lm, mixing, near_dup, pii, shards, spelling, topk, toxicity, url_rules
from .common import remainder, table

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return add


WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


@_register("op1_lm_scores")
def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 5) == 1).alias("held_out"))
    return lm.lm_scores(docs, "held_out")


TOPK_SQL = """
WITH fine AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@_register("op2_topk", TOPK_SQL)
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised("embedding").alias("vector"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


@_register("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("digest").distinct().withColumn("contaminated", F.lit(True))


@_register("op4_mixing")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@_register("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    return scored.select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.3).cast("int").alias("predicted"),
        "toxic_sentences",
    )


MIN_SITES, SHORT_SITES = 5, 10

LINES_SQL = rf"""
WITH docs AS (SELECT *, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
found AS (
  SELECT doc_id, md5(coalesce(text, '')) AS digest, coalesce(source, '') AS site, i - 1 AS place,
         regexp_replace(parts[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM docs)
),
wide AS (
  SELECT line, min({{'doc_id': doc_id, 'digest': digest, 'place': place}}) AS first
  FROM found WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= CASE WHEN length(line) >= {lines.LONG} THEN {MIN_SITES} ELSE {SHORT_SITES} END
),
kept AS (
  SELECT d.doc_id, d.source, d.lang, d.text, len(d.parts) AS n_lines, i, d.parts[i] AS part,
         w.line IS NOT NULL AND NOT (w.first.doc_id = d.doc_id AND w.first.digest = md5(coalesce(d.text, '')) AND w.first.place = i - 1) AS gone,
         d.rn
  FROM (SELECT *, row_number() OVER () AS rn, unnest(range(1, len(parts) + 1)) AS i FROM docs) d
  LEFT JOIN wide w ON w.line = regexp_replace(d.parts[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')
)
SELECT doc_id, n_lines, count(*) FILTER (gone) AS n_removed,
       CASE WHEN count(*) FILTER (gone) = 0 THEN text ELSE coalesce(string_agg(part, chr(10) ORDER BY i) FILTER (NOT gone), '') END AS text
FROM kept GROUP BY rn, doc_id, n_lines, text
"""


@_register("op6_line_dedup", LINES_SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"), MIN_SITES, short_sites=SHORT_SITES).select("doc_id", "n_lines", "n_removed", "text")


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_FITS = " ".join(
    f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}|{v}'"
    for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
)
URL_SQL = rf"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), judged AS (SELECT *, CASE {_FITS} END AS fit FROM parts)
SELECT page_id, host, path, split_part(fit, '|', 1) AS rule, coalesce(split_part(fit, '|', 2), 'allow') AS verdict FROM judged
"""


@_register("op7_url_rules", URL_SQL)
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


@_register("op8_near_dup")
def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size")


BUDGET, HISTORY, OVERHEAD = 2048, 512, 4

CHAT_SQL = rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), counted AS (
  SELECT *, {WORDS_SQL} + {OVERHEAD} AS tokens,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM given
), summed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) AS upto, pos = 1 AND role = 'system' AS is_system,
         max(CASE WHEN pos = 1 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS system_tokens FROM counted
), stepped AS (
  SELECT *, greatest(1, floor(({BUDGET - HISTORY} - system_tokens) / 2))::BIGINT AS step FROM summed
), flagged AS (
  SELECT *, tokens > step AND NOT is_system AS alone FROM stepped
), runs AS (
  SELECT *, sum(alone::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS runs FROM flagged
), cells AS (
  SELECT *, 2 * runs - alone::INT AS run,
         CASE WHEN alone OR is_system THEN 0 ELSE floor((upto - tokens - system_tokens) / step) END AS place FROM runs
), windows AS (
  SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY run, place) - 1 AS w FROM cells
), ends AS (
  SELECT *, max(w) OVER (PARTITION BY conv_id) + 1 AS windows, max(upto) OVER (PARTITION BY conv_id, w) AS window_end FROM windows
), written AS (
  SELECT *, length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t'))
            + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c')) + {len(chat.MARK) + 2 + len(chat.END) + 1} AS chars,
         CASE WHEN is_system THEN windows
              WHEN window_end - (upto - tokens) <= {HISTORY} AND w + 1 < windows THEN 2 ELSE 1 END AS times
  FROM ends
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars * times)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""


@_register("op9_chat", CHAT_SQL)
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.conversation_digest(chat.chat_windows(turns, BUDGET, HISTORY, OVERHEAD))


@_register("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, pii.fit_pii(docs)).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["base"])

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"))


SHARDS, SHUFFLE_SEED = 8, 20


@_register("op11_sharding")
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/holdfast-shards-{uuid.uuid4().hex}"
    written = shards.write_shards(table(spark, sf_dir, "documents"), path, SHARDS, SHUFFLE_SEED)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return written.select("doc_id", shards.text_size().alias("size"), crc, law, "shard", "slot", grown)


COMPONENTS, SCALE, CENTROIDS, ROUNDS, CENTROID_SEED = 64, 1024, 8, 10, 3


def _round_sql(i: int) -> str:
    return f"""
near{i} AS MATERIALIZED (
  SELECT row_no, arg_min(number, (d, number)) AS number, min(d) AS d FROM (
    SELECT row_no, number, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v, c)])::BIGINT AS d FROM kept CROSS JOIN centroids{i}
  ) GROUP BY row_no
), means{i} AS (
  SELECT number, list(mean ORDER BY place) AS c FROM (
    SELECT number, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS mean
    FROM (SELECT number, unnest(v) AS x, unnest(range({COMPONENTS})) AS place FROM kept JOIN near{i} USING (row_no)) GROUP BY number, place
  ) GROUP BY number
), centroids{i + 1} AS MATERIALIZED (
  SELECT number, coalesce(means{i}.c, centroids{i}.c) AS c FROM centroids{i} LEFT JOIN means{i} USING (number)
),"""


CENTROIDS_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), centroids0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS number, v AS c FROM (SELECT v, sha256('{CENTROID_SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM kept)
  QUALIFY number < {CENTROIDS}
), {"".join(_round_sql(i) for i in range(ROUNDS))}
last AS MATERIALIZED (
  SELECT row_no, arg_min(number, (d, number)) AS number, min(d) AS d FROM (
    SELECT row_no, number, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v, c)])::BIGINT AS d FROM kept CROSS JOIN centroids{ROUNDS}
  ) GROUP BY row_no
)
SELECT vec_id, number::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY number))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN last USING (row_no) JOIN centroids{ROUNDS} USING (number)
"""


@_register("op12_centroids", CENTROIDS_SQL)
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", centroids.integer_vector("embedding", SCALE, COMPONENTS).alias("vector"))
    found = centroids.centroid_clusters(vectors, "vec_id", COMPONENTS, CENTROIDS, ROUNDS, CENTROID_SEED)
    written = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(written.cast("binary"), 256).alias("centroid_sha256"))


RUN, DROP_EVERY, LEAST_LENGTH, LEAST_COUNT = "[A-Za-z\u00C0-\u00FF]+", 97, 5, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# crc32 by half bytes, low half first; its 16 table entries follow from four halvings of each index.
SPELLING_SQL = rf"""
WITH RECURSIVE bit0 AS (SELECT i, i::BIGINT AS c FROM range(16) r(i)),
bit1 AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM bit0),
bit2 AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM bit1),
bit3 AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM bit2),
bit4 AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM bit3),
halves AS (SELECT list(c ORDER BY i) AS t FROM bit4),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{RUN}')) AS run FROM documents
  ) WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL
),
coded AS (SELECT doc_id, run, times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM runs),
hashed AS (
  SELECT run, times, xor(list_reduce(
    [4294967295] || flatten([[('0x' || code[2 * b])::BIGINT, ('0x' || code[2 * b - 1])::BIGINT] FOR b IN range(1, length(code) // 2 + 1)]),
    lambda c, half: xor(c >> 4, t[1 + (xor(c, half) & 15)])), 4294967295) AS h
  FROM coded, halves
),
words AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % {DROP_EVERY} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}
),
cuts AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word
),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS best_n, arg_min(near, (-near_n, near)) AS best FROM pairs GROUP BY word),
known AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
  FROM words LEFT JOIN best USING (word)
),
walk AS (
  SELECT word, form AS at FROM known WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, known.form FROM walk JOIN known ON known.word = walk.at WHERE known.form IS NOT NULL
),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN known ON known.word = walk.at WHERE known.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM known LEFT JOIN ends USING (word)
"""


def spelled_words(docs: DataFrame) -> DataFrame:
    """Letter runs of the texts, one row per occurrence; of every 97th (by the hash of document and run) one letter is lost."""
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("owner"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    hashed = runs.where(F.length("run") >= LEAST_LENGTH).withColumn("h", F.crc32(F.concat_ws(":", "owner", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % DROP_EVERY == 0, lost).otherwise(F.col("run")).alias("word"))


@_register("op13_spelling", SPELLING_SQL)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(spelled_words(table(spark, sf_dir, "documents")), LEAST_LENGTH, LEAST_COUNT)
    return spelling.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict[str, Plan]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
