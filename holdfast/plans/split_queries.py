"""Partitions, samples, folds, cohorts and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import SEEDS
from ..functions.seeding import seeded_key
from ..operators import contracts, curation, joins, reshape, splits
from ..session import materialize
from ..sources.io import table
from .bindings import PAIR_KEYS, corpus, entities, normal_text, parted, predictions, records, screen, targets
from .curation_queries import WINDOWS, cohort_pairs, dated
from .registry import query

# --- partitions ---------------------------------------------------------------------------


@query("grouped_partition", "SELECT seed, split, entity FROM parted WHERE seed = 42")
def grouped_partition(spark, d):
    """Train / valid / test with whole groups, one seed."""
    return parted(spark, d, [42]).select("seed", "split", "entity")


@query("repeated_partition", "SELECT seed, split, entity, assigned FROM parted")
def repeated_partition(spark, d):
    """The partition under all seeds."""
    return parted(spark, d).select("seed", "split", "entity", "assigned")


_TT = """
SELECT entity, g AS group_key, CASE WHEN prior < round_even(0.2::DOUBLE * total, 0) THEN 'test' ELSE 'train' END AS split FROM (
 SELECT entity, group_key AS g FROM entities) e JOIN (SELECT group_key, sum(size) OVER () AS total,
  coalesce(sum(size) OVER (ORDER BY md5('7:' || group_key) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM (SELECT group_key, count(*) AS size FROM entities GROUP BY group_key)) s ON e.g = s.group_key"""


def _train_test(spark, d):
    base = entities(spark, d).select("entity", "group_key")
    return splits.grouped_train_test(base, "group_key", 7, 0.2)


@query("grouped_train_test", _TT)
def grouped_train_test(spark, d):
    """Two-way split, test first, entities without a group forming one group."""
    return _train_test(spark, d).select("entity", "group_key", "split")


@query(
    "stratified_split",
    """
SELECT doc_id, quality, CASE WHEN rn - 1 < round_even(0.2::DOUBLE * n, 0) THEN 'test' ELSE 'train' END AS split FROM (
 SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('11:' || doc_id)) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels)""",
)
def stratified_split(spark, d):
    """Random split with the label shares kept."""
    return splits.stratified_split(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", 11, 0.2)


@query(
    "split_report",
    "SELECT seed, split, count(DISTINCT entity) AS entities, count(DISTINCT assigned) AS groups FROM parted GROUP BY ALL",
)
def split_report(spark, d):
    """Entities and groups on each side."""
    return splits.split_report(parted(spark, d), "entity", "assigned")


@query(
    "split_label_counts",
    f"SELECT 7 AS seed, split, brand, count(*) AS rows FROM ({_TT}) t JOIN (SELECT entity AS e2, brand FROM entities) x ON t.entity = x.e2 GROUP BY ALL",
)
def split_label_counts(spark, d):
    """Entities of each label on each side of the split."""
    base = entities(spark, d).select("entity", "group_key", "brand")
    return splits.split_label_counts(splits.grouped_train_test(base, "group_key", 7, 0.2), "brand")


@query(
    "split_leakage_report",
    f"""
SELECT 7 AS seed, count(*) FILTER (a > 0) AS train_groups, count(*) FILTER (b > 0) AS test_groups, count(*) FILTER (a > 0 AND b > 0) AS overlap_groups,
 sum(CASE WHEN a > 0 AND b > 0 THEN b ELSE 0 END) / sum(b)::DOUBLE AS overlap_fraction_of_test
FROM (SELECT brand, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM ({_TT}) t JOIN (SELECT entity AS e2, brand FROM entities) x ON t.entity = x.e2 GROUP BY brand)""",
    ["overlap_fraction_of_test"],
)
def split_leakage_report(spark, d):
    """How far a coarser group key is shared by both sides of the split."""
    base = entities(spark, d).select("entity", "group_key", "brand")
    return splits.split_group_report(splits.grouped_train_test(base, "group_key", 7, 0.2), "brand")


@query(
    "partition_overlap",
    """
SELECT seed, unit, part_a, part_b, (SELECT count(*) FROM (SELECT v FROM u WHERE u.seed = k.seed AND u.unit = k.unit AND u.split = part_a
   INTERSECT SELECT v FROM u WHERE u.seed = k.seed AND u.unit = k.unit AND u.split = part_b)) AS shared
FROM (SELECT DISTINCT seed, unit FROM u) k, (VALUES ('train', 'valid'), ('train', 'test'), ('valid', 'test')) t(part_a, part_b)""".replace(
        " u ", " (SELECT seed, split, 'entity' AS unit, entity::VARCHAR AS v FROM parted UNION SELECT seed, split, 'assigned', assigned FROM parted UNION SELECT seed, split, 'brand', brand FROM parted) u "
    ).replace("FROM u)", "FROM (SELECT seed, unit FROM (SELECT seed, 'entity' AS unit FROM parted UNION SELECT seed, 'assigned' FROM parted UNION SELECT seed, 'brand' FROM parted)))"),
)
def partition_overlap(spark, d):
    """Entities, group keys and brands shared by each pair of splits."""
    p = parted(spark, d)
    return splits.partition_overlap(p, "split", ["train", "valid", "test"], ["entity", "assigned", "brand"], ["seed"])


@query(
    "partition_set_difference",
    """
SELECT seed, count(DISTINCT entity) FILTER (e) AS expected_entities, count(DISTINCT entity) FILTER (o) AS observed_entities,
 count(DISTINCT entity) FILTER (ee AND NOT oe) AS missing_entities, count(DISTINCT entity) FILTER (oe AND NOT ee) AS unexpected_entities,
 count(*) FILTER (e) AS expected_pairs, count(*) FILTER (o) AS observed_pairs, count(*) FILTER (e AND NOT o) AS missing_pairs, count(*) FILTER (o AND NOT e) AS unexpected_pairs,
 count(*) FILTER (e <> o) = 0 AS split_match
FROM (SELECT *, bool_or(e) OVER (PARTITION BY seed, entity) AS ee, bool_or(o) OVER (PARTITION BY seed, entity) AS oe FROM (
 SELECT coalesce(a.seed, b.seed) AS seed, coalesce(a.entity, b.entity) AS entity, a.entity IS NOT NULL AS e, b.entity IS NOT NULL AS o
 FROM (SELECT seed, entity, context FROM labelled WHERE split = 'test') a
 FULL JOIN (SELECT seed, entity, context FROM labelled WHERE (split = 'test' AND n_records > 1) OR (split = 'valid' AND n_records > 4)) b
 ON a.seed = b.seed AND a.entity = b.entity AND a.context = b.context)) GROUP BY seed""",
)
def partition_set_difference(spark, d):
    """Expected against observed test pairs of every seed."""
    from .bindings import labelled

    rows = labelled(spark, d, keep=("n_records",))
    observed = rows.where("(split = 'test' AND n_records > 1) OR (split = 'valid' AND n_records > 4)")
    return splits.set_difference_audit(rows.where("split = 'test'"), observed, ["seed"], "entity", "context")


# --- samples ------------------------------------------------------------------------------


@query("first_entities", "SELECT entity, context, value, unit FROM records WHERE entity IN (SELECT DISTINCT entity FROM records ORDER BY entity LIMIT 50)", ["value"])
def first_entities(spark, d):
    """Records of the first 50 entities (the limit is the feature)."""
    return splits.limit_entities(records(spark, d).select("entity", "context", "value", "unit"), "entity", 50)


@query(
    "sample_per_context",
    """
SELECT entity, context FROM (SELECT entity, context, row_number() OVER (PARTITION BY context ORDER BY md5('5:' || entity || ':' || context)) AS rn
FROM (SELECT DISTINCT entity, context FROM records)) WHERE rn <= 40""",
)
def sample_per_context(spark, d):
    """At most 40 pairs of each context in seeded order."""
    p = records(spark, d).select("entity", "context").distinct()
    return splits.sample_per_group(p, ["context"], ["entity", "context"], 40, 5)


@query(
    "stratified_subsample",
    """
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY k) AS place FROM (
 SELECT doc_id, lang, md5('3:' || doc_id) AS k, row_number() OVER (PARTITION BY lang ORDER BY md5('3:' || doc_id)) AS rn, count(*) OVER (PARTITION BY lang) AS n, count(*) OVER () AS total FROM documents)
 WHERE rn - 1 < greatest(round_even(150.0::DOUBLE * n / total, 0), 1.0)) WHERE place <= 150""",
)
def stratified_subsample(spark, d):
    """150 documents with the language shares kept."""
    return splits.stratified_subsample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 150, 3)


@query(
    "quota_sample",
    """
SELECT entity, split FROM (SELECT entity, split, row_number() OVER (PARTITION BY split ORDER BY md5('9:' || entity)) AS rn FROM parted WHERE seed = 42)
WHERE rn <= CASE split WHEN 'train' THEN 84 WHEN 'valid' THEN 18 ELSE 18 END""",
)
def quota_sample(spark, d):
    """120 entities in the shares of the partition."""
    p = parted(spark, d, [42]).select("entity", "split")
    return splits.quota_sample(p, "entity", 120, 9, {"train": 0.70, "valid": 0.15, "test": 0.15})


# --- temporal contract -----------------------------------------------------------------------


@query(
    "temporal_contract",
    """
WITH p AS (SELECT k.*, c_nationkey AS grp, c_mktsegment AS parent FROM cohort_pairs k LEFT JOIN customer ON entity = c_custkey),
 c AS (SELECT context, max((cohort = 'train')::INT) AS t, max((cohort = 'valid')::INT) AS v, max((cohort = 'test')::INT) AS s FROM p GROUP BY context),
 k AS (SELECT 'entities_shared_train_valid' AS "check", (SELECT count(*) FROM (SELECT entity FROM p WHERE cohort = 'train' INTERSECT SELECT entity FROM p WHERE cohort = 'valid')) AS violations
 UNION ALL SELECT 'entities_shared_train_test', (SELECT count(*) FROM (SELECT entity FROM p WHERE cohort = 'train' INTERSECT SELECT entity FROM p WHERE cohort = 'test'))
 UNION ALL SELECT 'entities_shared_valid_test', (SELECT count(*) FROM (SELECT entity FROM p WHERE cohort = 'valid' INTERSECT SELECT entity FROM p WHERE cohort = 'test'))
 UNION ALL SELECT 'groups_shared_train_valid', (SELECT count(*) FROM (SELECT grp FROM p WHERE cohort = 'train' AND grp IS NOT NULL INTERSECT SELECT grp FROM p WHERE cohort = 'valid'))
 UNION ALL SELECT 'groups_shared_train_test', (SELECT count(*) FROM (SELECT grp FROM p WHERE cohort = 'train' AND grp IS NOT NULL INTERSECT SELECT grp FROM p WHERE cohort = 'test'))
 UNION ALL SELECT 'groups_shared_valid_test', (SELECT count(*) FROM (SELECT grp FROM p WHERE cohort = 'valid' AND grp IS NOT NULL INTERSECT SELECT grp FROM p WHERE cohort = 'test'))
 UNION ALL SELECT 'parents_shared_train_valid', (SELECT count(*) FROM (SELECT parent FROM p WHERE cohort = 'train' AND parent IS NOT NULL INTERSECT SELECT parent FROM p WHERE cohort = 'valid'))
 UNION ALL SELECT 'parents_shared_train_test', (SELECT count(*) FROM (SELECT parent FROM p WHERE cohort = 'train' AND parent IS NOT NULL INTERSECT SELECT parent FROM p WHERE cohort = 'test'))
 UNION ALL SELECT 'parents_shared_valid_test', (SELECT count(*) FROM (SELECT parent FROM p WHERE cohort = 'valid' AND parent IS NOT NULL INTERSECT SELECT parent FROM p WHERE cohort = 'test'))
 UNION ALL SELECT 'train_first_year_outside_window', (SELECT count(*) FROM p WHERE cohort = 'train' AND first_year > 1995)
 UNION ALL SELECT 'train_records_outside_window', (SELECT count(*) FROM p WHERE cohort = 'train' AND year_max > 1995)
 UNION ALL SELECT 'valid_first_year_outside_window', (SELECT count(*) FROM p WHERE cohort = 'valid' AND first_year <> 1996)
 UNION ALL SELECT 'valid_records_outside_window', (SELECT count(*) FROM p WHERE cohort = 'valid' AND (year_min < 1996 OR year_max > 1996))
 UNION ALL SELECT 'test_first_year_outside_window', (SELECT count(*) FROM p WHERE cohort = 'test' AND first_year < 1997)
 UNION ALL SELECT 'test_records_outside_window', (SELECT count(*) FROM p WHERE cohort = 'test' AND year_min < 1997)
 UNION ALL SELECT 'valid_contexts_absent_from_train', (SELECT count(*) FROM c WHERE v = 1 AND t = 0)
 UNION ALL SELECT 'test_contexts_absent_from_train', (SELECT count(*) FROM c WHERE s = 1 AND t = 0))
SELECT *, violations = 0 AS passed, bool_and(violations = 0) OVER () AS all_passed FROM k""",
)
def temporal_contract(spark, d):
    """Every check of the temporal split."""
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("group"), F.col("c_mktsegment").alias("parent"))
    pairs = materialize(cohort_pairs(spark, d).join(keys, "entity", "left"))
    return splits.temporal_contract(pairs, {"entity": "entities", "group": "groups", "parent": "parents"}, "context", WINDOWS)


@query(
    "cohort_context_sets",
    """
SELECT context, max((cohort = 'train')::INT) AS in_train, max((cohort = 'valid')::INT) AS in_valid, max((cohort = 'test')::INT) AS in_test,
 count(*) FILTER (cohort = 'train') AS train_pairs, count(*) FILTER (cohort = 'valid') AS valid_pairs, count(*) FILTER (cohort = 'test') AS test_pairs FROM cohort_pairs GROUP BY context""",
)
def cohort_context_sets(spark, d):
    """Support of every context by cohort."""
    p = dated(spark, d).where("in_own_window").select("cohort", "entity", "context").distinct()
    return splits.cohort_context_sets(p, "context", list(WINDOWS))


@query(
    "cohort_support",
    "SELECT cohort, count(*) AS pairs, count(DISTINCT entity) AS entities, count(DISTINCT context) AS contexts FROM cohort_pairs GROUP BY cohort",
)
def cohort_support(spark, d):
    """Pairs, entities and contexts with support per cohort."""
    p = dated(spark, d).where("in_own_window").select("cohort", "entity", "context").distinct()
    return p.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("pairs"), F.countDistinct("entity").alias("entities"), F.countDistinct("context").alias("contexts")
    )


# --- leave one context out ----------------------------------------------------------------------


@query(
    "leave_one_out_audit",
    """
WITH p AS (SELECT DISTINCT entity, context, class FROM records), s AS (SELECT *, count(*) OVER (PARTITION BY entity) > 1 AS seen FROM p),
 c AS (SELECT class, count(DISTINCT context) AS members FROM p GROUP BY class)
SELECT context, s.class, (SELECT count(*) FROM p) - count(*) AS train_pairs, count(*) AS test_pairs,
 (SELECT count(DISTINCT entity) FROM p) - count(*) FILTER (NOT seen) AS train_entities, count(DISTINCT entity) AS test_entities,
 count(*) FILTER (seen) AS seen_in_other_contexts, count(*) FILTER (NOT seen) AS not_seen_elsewhere, members > 1 AS class_known_from_train
FROM s JOIN c ON s.class = c.class GROUP BY context, s.class, members""",
)
def leave_one_out_audit(spark, d):
    """Fold sizes and overlaps of every held-out context."""
    p = records(spark, d).select("entity", "context", "class").distinct()
    return splits.leave_one_out_audit(p, "entity", "context", "class")


@query(
    "unknown_class_folds",
    """
WITH p AS (SELECT DISTINCT context, CASE WHEN context_id < 3 THEN class || context ELSE class END AS class FROM records)
SELECT min(context) AS context, class FROM p GROUP BY class HAVING count(*) = 1""",
)
def unknown_class_folds(spark, d):
    """Contexts whose class no other context has."""
    klass = F.when(F.col("context_id") < 3, F.concat("class", "context")).otherwise(F.col("class"))
    return splits.unknown_class_folds(records(spark, d).withColumn("class", klass), "context", "class")


LOO_COHORTS = ["all_pairs", "seen_elsewhere", "not_seen_elsewhere"]


LOO_SQL = """
WITH p AS (SELECT entity, context, target, count(*) OVER (PARTITION BY entity) > 1 AS seen FROM pairs),
 h AS (SELECT p.entity, p.context, p.target AS y_true, m.y_pred, seen FROM p JOIN (
   SELECT a.context, quantile_cont(b.target, 0.5::DOUBLE) AS y_pred FROM (SELECT DISTINCT context FROM p) a JOIN p b ON a.context <> b.context GROUP BY a.context) m ON p.context = m.context),
 l AS (SELECT 'all_pairs' AS cohort, * FROM h UNION ALL SELECT 'seen_elsewhere', * FROM h WHERE seen UNION ALL SELECT 'not_seen_elsewhere', * FROM h WHERE NOT seen)
SELECT g.context, g.cohort, coalesce(n, 0) AS n, coalesce(entities, 0) AS entities, mae, rmse, within_one, within_two FROM (SELECT context, cohort FROM (SELECT DISTINCT context FROM p), (SELECT unnest(['all_pairs', 'seen_elsewhere', 'not_seen_elsewhere']) AS cohort)) g
LEFT JOIN (SELECT context, cohort, count(*) AS n, count(DISTINCT entity) AS entities, avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse,
  avg((abs(y_pred - y_true) <= 1)::INT::DOUBLE) AS within_one, avg((abs(y_pred - y_true) <= 2)::INT::DOUBLE) AS within_two FROM l GROUP BY ALL) m ON g.context = m.context AND g.cohort = m.cohort"""


@query(
    "leave_one_out_metrics",
    LOO_SQL,
    ["mae", "rmse", "within_one", "within_two"],
)
def leave_one_out_metrics(spark, d):
    """Errors of the held-out median on each cohort of each fold; an empty cohort keeps its row with n = 0."""
    return loo_metrics(loo_predictions(spark, d))


def loo_predictions(spark, d):
    """Every pair with the median target of all other contexts as its prediction."""
    p = materialize(targets(spark, d, False).select("entity", "context", "target"))
    flagged = splits.flag_seen_elsewhere(p, "entity", "context").withColumnRenamed("target", "y_true")
    return flagged.join(splits.held_out_medians(p, "context", "target"), "context")


def loo_metrics(pred):
    from ..operators.metrics import regression_metrics

    long = splits.explode_cohorts(
        pred, {"all_pairs": F.lit(True), "seen_elsewhere": F.col("seen_elsewhere"), "not_seen_elsewhere": ~F.col("seen_elsewhere")}
    )
    own = regression_metrics(long, ["context", "cohort"], extra=[F.countDistinct("entity").alias("entities")]).drop("spearman")
    return joins.complete_grid(pred.select("context").distinct(), "cohort", LOO_COHORTS, own, ["context"], ["n", "entities"])


# --- cohorts ----------------------------------------------------------------------------------


def screen_flags(spark, d):
    """Screen with its exact and normalised-text identity flags against the corpus. Texts are compared by their hash."""
    keys = {"exact_key": F.sha2("text", 256), "parent_key": F.sha2(normal_text("text"), 256)}
    base = corpus(spark, d).select(*[c.alias(n) for n, c in keys.items()])
    rows = screen(spark, d).withColumns(keys).drop("text")
    out = joins.flag_membership(rows, "exact_key", base, "exact_key", "exact_overlap")
    return joins.flag_membership(out, "parent_key", base, "parent_key", "parent_identity").drop(*keys)


@query(
    "exclusion_cohorts",
    """
SELECT 'primary' AS cohort, doc_id FROM screen_flags WHERE NOT exact_overlap
UNION ALL SELECT 'parent_nonidentity', doc_id FROM screen_flags WHERE NOT exact_overlap AND NOT parent_identity
UNION ALL SELECT 'overlap', doc_id FROM screen_flags WHERE exact_overlap""",
)
def exclusion_cohorts(spark, d):
    """Screen rows of every exclusion cohort."""
    return explode_screen(screen_flags(spark, d)).select("cohort", "doc_id")


def explode_screen(df):
    return splits.explode_cohorts(
        df,
        {
            "primary": ~F.col("exact_overlap"),
            "parent_nonidentity": ~F.col("exact_overlap") & ~F.col("parent_identity"),
            "overlap": F.col("exact_overlap"),
        },
    )


@query(
    "cohort_flow",
    """
SELECT cohort, endpoint, count(*) AS n, sum(label)::BIGINT AS positives, avg(label::DOUBLE) AS prevalence FROM (
 SELECT cohort, unnest(['quality', 'toxic', 'any']) AS endpoint, unnest([quality, toxic, greatest(quality, toxic)]) AS label FROM (
  SELECT *, 'primary' AS cohort FROM screen_flags WHERE NOT exact_overlap UNION ALL SELECT *, 'parent_nonidentity' FROM screen_flags WHERE NOT exact_overlap AND NOT parent_identity
  UNION ALL SELECT *, 'overlap' FROM screen_flags WHERE exact_overlap)) GROUP BY ALL""",
    ["prevalence"],
)
def cohort_flow(spark, d):
    """Rows, positives and prevalence per cohort and endpoint."""
    from ..functions.scalar import any_active
    from ..operators.ranking import melt_labels

    long = melt_labels(
        explode_screen(screen_flags(spark, d)), ["cohort"],
        {"quality": F.col("quality"), "toxic": F.col("toxic"), "any": any_active(["quality", "toxic"])},
    )
    return splits.cohort_flow(long, ["cohort", "endpoint"], "label")


@query(
    "cohort_counts",
    """
SELECT count(*) AS rows, count(*) FILTER (exact_overlap) AS exact_overlap, count(*) FILTER (parent_identity) AS parent_identity,
 count(*) FILTER (NOT exact_overlap) AS primary_rows, count(*) FILTER (NOT exact_overlap AND NOT parent_identity) AS parent_nonidentity FROM screen_flags""",
)
def cohort_counts(spark, d):
    """Size of every cohort in one row."""
    e, p = F.col("exact_overlap"), F.col("parent_identity")
    return splits.cohort_counts(
        screen_flags(spark, d), {"exact_overlap": e, "parent_identity": p, "primary_rows": ~e, "parent_nonidentity": ~e & ~p}
    )


@query(
    "overlap_status",
    """
SELECT query_keys, reference_keys, shared_keys, CASE WHEN shared_keys = 0 THEN 'clean' ELSE 'requires_exclusion' END AS status FROM (
 SELECT (SELECT count(DISTINCT text) FROM screen) AS query_keys, (SELECT count(DISTINCT text) FROM corpus) AS reference_keys,
 (SELECT count(*) FROM (SELECT text FROM screen INTERSECT SELECT text FROM corpus)) AS shared_keys)""",
)
def overlap_status(spark, d):
    """Whether screen and corpus share texts."""
    a = screen(spark, d).select(F.sha2("text", 256).alias("key"))
    b = corpus(spark, d).select(F.sha2("text", 256).alias("key"))
    return splits.overlap_status(a, b, "key")


# --- contracts ----------------------------------------------------------------------------------


@query(
    "duplicate_keys",
    "SELECT 'order line' AS \"check\", (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::BIGINT AS violations FROM lineitem",
)
def duplicate_keys(spark, d):
    """Rows beyond the first of each (order, line)."""
    return contracts.check_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "order line")


@query(
    "functional_dependencies",
    """
SELECT 'brand has one kind' AS "check", count(*) AS violations FROM (SELECT p_brand FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1)
UNION ALL SELECT 'context has one class', count(*) FROM (SELECT context FROM records GROUP BY context HAVING count(DISTINCT class) > 1)
UNION ALL SELECT 'size has one flag', count(*) FROM (SELECT p_size FROM part GROUP BY p_size HAVING count(DISTINCT CASE WHEN p_retailprice > 900.5 THEN 1 END) + max((p_retailprice <= 900.5)::INT) > 1)""",
)
def functional_dependencies(spark, d):
    """Keys that map to several values, missing values counted in the last check."""
    part = table(spark, d, "part").withColumn("flag", F.when(F.col("p_retailprice") > 900.5, 1))
    return reshape.union_all(
        [
            contracts.check_function(part, "p_brand", "p_type", "brand has one kind"),
            contracts.check_function(records(spark, d), "context", "class", "context has one class"),
            contracts.check_function(part, "p_size", "flag", "size has one flag", count_null=True),
        ]
    )


@query(
    "coverage_of_lookup",
    "SELECT 'source in lookup' AS \"check\", count(DISTINCT source) AS violations FROM documents WHERE source NOT IN (SELECT source FROM screen WHERE lang = 'fr')",
)
def coverage_of_lookup(spark, d):
    """Keys without an entry in the lookup."""
    return contracts.check_covered(
        table(spark, d, "documents"), "source", screen(spark, d).where("lang = 'fr'"), check="source in lookup"
    )


@query(
    "finite_cells",
    """
SELECT 'event values' AS "check", (count(*) FILTER (v IS NULL OR isnan(v) OR isinf(v)) + count(*) FILTER (value IS NULL))::BIGINT AS violations
FROM (SELECT value, CASE event_type WHEN 'error' THEN 'nan'::DOUBLE WHEN 'view' THEN NULL ELSE value END AS v FROM events)""",
)
def finite_cells(spark, d):
    """Missing, NaN and infinite cells."""
    kind = F.col("event_type")
    v = F.when(kind == "error", F.lit(float("nan"))).when(kind == "view", F.lit(None)).otherwise(F.col("value"))
    return contracts.check_finite(table(spark, d, "events").withColumn("v", v), ["v", "value"], "event values")


@query(
    "replay_gate",
    """
SELECT "column", (count(*) FILTER (a IS NULL OR b IS NULL))::BIGINT AS unmatched, max(abs(a - b)) AS max_difference,
 count(*) FILTER (a IS NULL OR b IS NULL) = 0 AND max(abs(a - b)) <= 0.05 AS passed FROM (
 SELECT unnest(['balance', 'nation']) AS "column", unnest([c_acctbal, c_nationkey::DOUBLE]) AS a, unnest([c_acctbal + c_custkey % 7 / 50.0::DOUBLE, c_nationkey::DOUBLE]) AS b FROM customer) GROUP BY "column\"""",
    ["max_difference"],
)
def replay_gate(spark, d):
    """A changed copy fails on the changed column and passes on the other."""
    new = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    old = new.withColumn("balance", F.col("balance") + (F.col("c_custkey") % 7) / F.lit(50.0))
    return contracts.check_replay(new, old, ["c_custkey"], ["balance", "nation"], 0.05)


@query(
    "partition_fingerprint",
    """
SELECT seed, count(*) AS rows, sha256(concat_ws(':', count(*)::VARCHAR, sum(('0x' || substr(h, 1, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 9, 8))::BIGINT)::VARCHAR,
 sum(('0x' || substr(h, 17, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 25, 8))::BIGINT)::VARCHAR)) AS fingerprint
FROM (SELECT seed, md5(entity || ':' || split) AS h FROM parted) GROUP BY seed""",
)
def partition_fingerprint(spark, d):
    """Order-independent fingerprint of every seed's partition."""
    return contracts.fingerprint(parted(spark, d), "entity", "split", "seed")


@query(
    "expected_counts",
    """
SELECT 'nations' AS "check", (SELECT count(*) FROM nation) AS observed, 25::BIGINT AS expected, ((SELECT count(*) FROM nation) <> 25)::BIGINT AS violations
UNION ALL SELECT 'regions_used', (SELECT count(DISTINCT n_regionkey) FROM nation), 5, ((SELECT count(DISTINCT n_regionkey) FROM nation) <> 5)::BIGINT
UNION ALL SELECT 'nations_of_region_0', (SELECT count(*) FROM nation WHERE n_regionkey = 0), 4, ((SELECT count(*) FROM nation WHERE n_regionkey = 0) <> 4)::BIGINT""",
)
def expected_counts(spark, d):
    """Counts against what is expected."""
    return contracts.check_counts(
        table(spark, d, "nation"),
        {
            "nations": (F.count(F.lit(1)), 25),
            "regions_used": (F.countDistinct("n_regionkey"), 5),
            "nations_of_region_0": (F.count_if(F.col("n_regionkey") == 0), 4),
        },
    )


@query(
    "aligned_tables",
    """
SELECT 'order lines' AS "check", count(*) AS violations FROM (SELECT o_orderkey AS k, 4 AS n FROM orders) a
FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
)
def aligned_tables(spark, d):
    """Keys whose row counts differ between the prepared and the other table."""
    prepared = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("line"))
    return contracts.check_aligned(prepared, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"], "order lines")


@query(
    "label_domain",
    "SELECT 'binary labels' AS \"check\", (count(*) FILTER (quality IS NULL OR quality NOT IN (0, 1)) + count(*) FILTER (t IS NULL OR t NOT IN (0, 1)))::BIGINT AS violations FROM (SELECT quality, CASE WHEN doc_id < 100 THEN NULL ELSE toxic + quality END AS t FROM labels)",
)
def label_domain(spark, d):
    """Label cells that are missing or not 0 / 1."""
    t = F.when(F.col("doc_id") >= 100, F.col("toxic") + F.col("quality"))
    return contracts.check_domain(table(spark, d, "labels").withColumn("t", t), ["quality", "t"], [0, 1], "binary labels")


@query(
    "constant_per_group",
    "SELECT 'one priority per status' AS \"check\", count(*) AS violations FROM (SELECT o_custkey, o_orderstatus FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderpriority) <> 1)",
)
def constant_per_group(spark, d):
    """Groups in which a column is not constant."""
    return contracts.check_constant(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "o_orderpriority", "one priority per status")
