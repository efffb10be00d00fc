"""Shared table expressions of the SQL twins."""

from __future__ import annotations

import re

from ..functions.constants import COVERAGE, SEEDS, SOLO_PREFIX, T_975, TRAIN_FRACTION, VALID_FRACTION, Z_975

CTES: dict[str, str] = {}


def grid(expression: str) -> str:
    return f"(round(log2({expression}) * 1048576.0::DOUBLE) / 1048576.0::DOUBLE)"


def hash_int(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def hash_long(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def t_975(degrees: str) -> str:
    z = Z_975
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    table = "[" + ", ".join(f"{t!r}::DOUBLE" for t in T_975) + "]"
    v = f"({degrees})::DOUBLE"
    tail = f"{z!r}::DOUBLE + {g1!r}::DOUBLE/{v} + {g2!r}::DOUBLE/({v}*{v}) + {g3!r}::DOUBLE/({v}*{v}*{v}) + {g4!r}::DOUBLE/({v}*{v}*{v}*{v})"
    return f"(CASE WHEN {degrees} < 1 THEN NULL WHEN {degrees} <= {len(T_975)} THEN {table}[({degrees})::INT] ELSE {tail} END)"


def average_rank(partition: str, value: str) -> str:
    return (
        f"(rank() OVER (PARTITION BY {partition} ORDER BY {value}) "
        f"+ (count(*) OVER (PARTITION BY {partition}, {value}) - 1) / 2.0::DOUBLE)"
    )


def spearman(source: str, keys: str, x: str, y: str, out: str = "spearman") -> str:
    """Sub-select (keys, out) over rows with both sides present."""
    return (
        f"(SELECT {keys}, CASE WHEN count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1 THEN corr(rx, ry) END AS {out} "
        f"FROM (SELECT {keys}, {average_rank(keys, x)} AS rx, {average_rank(keys, y)} AS ry FROM {source} "
        f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {keys})"
    )


def t_stats(source: str, keys: str, value: str, extra: str = "") -> str:
    """Select (keys, n, mean, sd, extra, ci_low, ci_high)."""
    half = f"CASE WHEN n > 1 THEN {t_975('n - 1')} * sd / sqrt(n::DOUBLE) END"
    return (
        f"SELECT *, mean - {half} AS ci_low, mean + {half} AS ci_high FROM "
        f"(SELECT {keys}, count({value}) AS n, avg({value}) AS mean, stddev_samp({value}) AS sd{extra} "
        f"FROM {source} WHERE {value} IS NOT NULL GROUP BY {keys})"
    )


CTES["records"] = """
SELECT l_partkey AS entity, n_name AS context, r_name AS class, n_nationkey AS context_id, l_extendedprice AS value,
       l_returnflag AS unit, l_linestatus AS relation, l_orderkey AS document, l_suppkey AS strain, l_linenumber AS line,
       l_quantity AS quantity, l_discount AS discount, year(l_shipdate)::BIGINT AS year
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""

CTES["pairs"] = f"""
SELECT entity, context, class, context_id, count(*) AS n_records,
       quantile_cont(value, 0.5::DOUBLE) AS median_value,
       quantile_cont({grid('value')}, 0.5::DOUBLE) AS target,
       quantile_cont({grid('value')}, 0.25::DOUBLE) AS target_q25,
       quantile_cont({grid('value')}, 0.75::DOUBLE) AS target_q75,
       quantile_cont({grid('value')}, 0.75::DOUBLE) - quantile_cont({grid('value')}, 0.25::DOUBLE) AS target_iqr,
       count(DISTINCT document) AS n_documents, count(DISTINCT strain) AS n_strains, count(DISTINCT unit) AS n_units
FROM records GROUP BY entity, context, class, context_id"""

CTES["entities"] = f"""
SELECT p_partkey AS entity, p_type AS kind, p_brand AS brand,
       CASE WHEN p_size = 1 THEN '' ELSE p_brand || '|' || p_type END AS group_key,
       CASE WHEN p_size = 1 THEN '{SOLO_PREFIX}' || p_partkey ELSE p_brand || '|' || p_type END AS assigned,
       p_size = 1 AS is_solo, p_name || ' ' || p_brand || ' ' || p_type AS words
FROM part"""

_SEEDS = ", ".join(str(s) for s in SEEDS)
CTES["groups"] = f"""
SELECT seed, assigned, size, sum(size) OVER (PARTITION BY seed) AS total,
       coalesce(sum(size) OVER (PARTITION BY seed ORDER BY md5(seed || ':' || assigned)
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
FROM (SELECT assigned, count(*) AS size FROM entities GROUP BY assigned), (SELECT unnest([{_SEEDS}]) AS seed)"""

CTES["placed"] = f"""
SELECT g.seed, assigned,
       CASE WHEN prior < round_even({TRAIN_FRACTION}::DOUBLE * total, 0) THEN 'train'
            WHEN prior - train_size < round_even({VALID_FRACTION}::DOUBLE * total, 0) THEN 'valid' ELSE 'test' END AS split
FROM groups g JOIN (SELECT seed, sum(size) AS train_size FROM groups
                    WHERE prior < round_even({TRAIN_FRACTION}::DOUBLE * total, 0) GROUP BY seed) t ON g.seed = t.seed"""

CTES["parted"] = "SELECT seed, split, e.* FROM entities e JOIN placed p ON e.assigned = p.assigned"

CTES["labelled"] = """
SELECT seed, split, e.entity, kind, group_key, e.assigned, is_solo, context, class, target, n_records, target_iqr
FROM pairs JOIN parted e ON pairs.entity = e.entity"""

CTES["guesses"] = """
WITH train AS (SELECT * FROM labelled WHERE split = 'train'),
     c AS (SELECT seed, context, quantile_cont(target, 0.5::DOUBLE) AS m FROM train GROUP BY ALL),
     k AS (SELECT seed, context, kind, quantile_cont(target, 0.5::DOUBLE) AS m FROM train GROUP BY ALL),
     e AS (SELECT seed, kind, quantile_cont(target, 0.5::DOUBLE) AS m FROM train GROUP BY ALL),
     o AS (SELECT seed, quantile_cont(target, 0.5::DOUBLE) AS m FROM train GROUP BY ALL),
     r AS (SELECT l.*, c.m AS by_context, coalesce(k.m, c.m) AS by_kind, coalesce(e.m, o.m) AS kind_only, o.m AS overall
           FROM labelled l LEFT JOIN c ON l.seed = c.seed AND l.context = c.context
           LEFT JOIN k ON l.seed = k.seed AND l.context = k.context AND l.kind = k.kind
           LEFT JOIN e ON l.seed = e.seed AND l.kind = e.kind LEFT JOIN o ON l.seed = o.seed WHERE split <> 'train')
SELECT 'context_median' AS model, *, by_context AS y_pred FROM r
UNION ALL SELECT 'kind_median' AS model, *, by_kind AS y_pred FROM r
UNION ALL SELECT 'kind_entity_only' AS model, *, kind_only AS y_pred FROM r
UNION ALL SELECT 'overall_entity_only' AS model, *, overall AS y_pred FROM r"""

_RANK = f"least(n, ceil((n + 1)::DOUBLE * {COVERAGE}::DOUBLE))"
CTES["residuals"] = "SELECT model, seed, context, abs(target - y_pred) AS r FROM guesses WHERE split = 'valid' AND y_pred IS NOT NULL"
CTES["q_pooled"] = f"""
SELECT model, seed, r AS q_pooled FROM (SELECT *, row_number() OVER (PARTITION BY model, seed ORDER BY r) AS rn,
  count(*) OVER (PARTITION BY model, seed) AS n FROM residuals) WHERE rn = {_RANK}"""
CTES["q_context"] = f"""
SELECT model, seed, context, r AS q_context FROM (SELECT *, row_number() OVER (PARTITION BY model, seed, context ORDER BY r) AS rn,
  count(*) OVER (PARTITION BY model, seed, context) AS n FROM residuals) WHERE rn = {_RANK}"""

CTES["predictions"] = """
SELECT g.model, g.seed, g.entity, g.context, g.class, g.kind, g.group_key, g.assigned, g.is_solo, g.n_records, g.target_iqr,
       g.target AS y_true, g.y_pred, q_pooled, q_context, y_pred - q_pooled AS lower, y_pred + q_pooled AS upper,
       y_pred - q_context AS lower_context, y_pred + q_context AS upper_context, abs(y_pred - g.target) AS absolute_error,
       (CASE WHEN g.target BETWEEN y_pred - q_pooled AND y_pred + q_pooled THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit,
       (CASE WHEN g.target BETWEEN y_pred - q_context AND y_pred + q_context THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit_context
FROM guesses g JOIN q_pooled p ON g.model = p.model AND g.seed = p.seed
LEFT JOIN q_context c ON g.model = c.model AND g.seed = c.seed AND g.context = c.context WHERE g.split = 'test'"""


def metric_select(keys: str, source: str = "predictions") -> str:
    return f"""
SELECT a.*, b.spearman FROM (
 SELECT {keys}, count(*) AS n, avg(absolute_error) AS mae, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse,
        avg((absolute_error <= 1)::INT::DOUBLE) AS within_one, avg((absolute_error <= 2)::INT::DOUBLE) AS within_two,
        avg(hit) AS coverage, avg(upper - lower) AS width, avg(hit_context) AS coverage_context,
        avg(upper_context - lower_context) AS width_context
 FROM {source} GROUP BY {keys}) a LEFT JOIN {spearman(source, keys, 'y_true', 'y_pred')} b USING ({keys})"""


CTES["context_metrics"] = metric_select("model, seed, context")
_MEANS = ", ".join(
    f"avg({c}) AS {c}" for c in ("mae", "rmse", "spearman", "within_one", "within_two", "coverage", "width", "coverage_context", "width_context")
)
CTES["macro_metrics"] = f"SELECT model, seed, sum(n)::BIGINT AS n, {_MEANS} FROM context_metrics GROUP BY model, seed"
CTES["pooled_metrics"] = metric_select("model, seed")

CTES["diversity"] = f"""
WITH m AS (SELECT DISTINCT context, pairs.entity, group_key, assigned FROM pairs JOIN entities e ON pairs.entity = e.entity),
 long AS (SELECT context, 'with_fallback' AS mode, assigned AS g FROM m
          UNION ALL SELECT context, 'grouped_only', group_key FROM m WHERE group_key <> ''),
 s AS (SELECT context, mode, g, count(*) AS size FROM long GROUP BY ALL),
 t AS (SELECT context, mode, size, sum(size) OVER (PARTITION BY context, mode) AS n FROM s)
SELECT context, mode, max(n)::BIGINT AS entities, count(*) AS groups, count(*)::DOUBLE / max(n) AS group_fraction,
       -sum((size::DOUBLE / n) * ln(size::DOUBLE / n)) AS entropy,
       CASE WHEN count(*) > 1 THEN -sum((size::DOUBLE / n) * ln(size::DOUBLE / n)) / ln(count(*)::DOUBLE) ELSE 0.0 END AS normalised_entropy,
       max(size)::DOUBLE / max(n) AS top_share FROM t GROUP BY context, mode"""

# Text scoring tables: labelled documents are the external screen, the unlabelled ones the training corpus.
CTES["corpus"] = "SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
CTES["screen"] = f"""
SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, l.quality::INT AS quality, l.toxic::INT AS toxic, d.n_chars::DOUBLE AS score_length,
       {hash_int("'score:' || d.doc_id")} / 4294967296.0::DOUBLE AS score_hash
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

_NORMAL = "regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')"
CTES["screen_flags"] = f"""
SELECT s.*, s.text IN (SELECT text FROM corpus) AS exact_overlap,
       {_NORMAL.replace('text', 's.text')} IN (SELECT {_NORMAL} FROM corpus) AS parent_identity
FROM screen s"""


def bits_select(source: str, key: str, text: str, k: int, n_bits: int, unit: str = "word") -> str:
    words = (
        f"string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+')" if unit == "word" else f"string_split(lower({text}), '')"
    )
    return f"""
SELECT {key}, list_sort(list_distinct(list_transform(range(1, len(w) - {k} + 2),
       lambda i: {hash_int(f"array_to_string(w[i:i + {k - 1}], ' ')")} % {n_bits}))) AS bits
FROM (SELECT {key}, list_filter({words}, lambda x: x <> '') AS w FROM {source})"""


def nearest_select(query: str, reference: str, qid: str, rid: str, by: str = "") -> str:
    """Nearest reference row by shared positions; no shared position gives 0 and the smallest id."""
    on = f"a.{by} = b.{by} AND " if by else ""
    keys = f"a.{by}, " if by else ""
    low = f"(SELECT min({rid}) FROM {reference} z WHERE z.{by} = q.{by})" if by else f"(SELECT min({rid}) FROM {reference})"
    own = f"q.{by}, " if by else ""
    match = f"q.{by} = m.{by} AND " if by else ""
    first = f"{by}, " if by else ""
    return f"""
WITH a AS (SELECT {first}{qid}, len(bits) AS qs, unnest(bits) AS bit FROM {query}),
 b AS (SELECT {first}{rid}, len(bits) AS rs, unnest(bits) AS bit FROM {reference}),
 s AS (SELECT {keys}a.{qid}, b.{rid}, count(*)::DOUBLE / (qs + rs - count(*)) AS sim FROM a JOIN b ON {on}a.bit = b.bit
       GROUP BY {keys}a.{qid}, b.{rid}, qs, rs),
 m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {first}{qid} ORDER BY sim DESC, {rid}) AS rn FROM s) WHERE rn = 1)
SELECT {own}q.{qid}, coalesce(m.{rid}, {low}) AS nearest_id, coalesce(m.sim, 0.0)::DOUBLE AS similarity
FROM {query} q LEFT JOIN m ON {match}q.{qid} = m.{qid}"""


def ranking_select(source: str, keys: str, label: str, score: str) -> str:
    """AUROC by rank sums and average precision by distinct scores, without weights."""
    return f"""
SELECT r.*, CASE WHEN positives > 0 AND positives < n THEN
         (rank_sum - positives * (positives + 1) / 2.0::DOUBLE) / (positives::DOUBLE * (n - positives)) END AS auroc,
       CASE WHEN positives > 0 AND positives < n THEN ap END AS average_precision,
       CASE WHEN positives > 0 AND positives < n THEN 'estimable' ELSE 'one_class' END AS status
FROM (SELECT {keys}, count(*) AS n, sum({label})::BIGINT AS positives, avg({label}::DOUBLE) AS prevalence,
             sum(CASE WHEN {label} = 1 THEN rk ELSE 0 END) AS rank_sum
      FROM (SELECT *, {average_rank(keys, score)} AS rk FROM {source}) GROUP BY {keys}) r
JOIN (SELECT {keys}, sum(CASE WHEN p > 0 THEN (tp / cnt) * p / total_p ELSE 0 END) AS ap
      FROM (SELECT *, sum(p) OVER (PARTITION BY {keys} ORDER BY {score} DESC) AS tp, sum(c) OVER (PARTITION BY {keys} ORDER BY {score} DESC) AS cnt,
                   sum(p) OVER (PARTITION BY {keys}) AS total_p
            FROM (SELECT {keys}, {score}, sum({label})::DOUBLE AS p, count(*)::DOUBLE AS c FROM {source} GROUP BY {keys}, {score}))
      GROUP BY {keys}) a USING ({keys})"""


def with_ctes(body: str) -> str:
    """Prefix the table expressions a body uses, and those they use, in order."""
    found: list[str] = []
    open_names: set[str] = set()

    def visit(text: str) -> None:
        for name, definition in CTES.items():
            if name not in found and name not in open_names and re.search(rf"\b{name}\b", text):
                open_names.add(name)
                visit(definition)
                found.append(name)

    visit(body)
    if not found:
        return body
    if body.lstrip().upper().startswith("WITH"):
        body = f"SELECT * FROM ({body}) AS result_rows"
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in found)
    return f"WITH {parts}\n{body}"
