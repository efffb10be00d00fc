"""Extraction, row expressions, joins, curation aggregates and exclusion records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar as x
from ..operators import contracts, curation, joins, reshape, splits
from ..session import shared_folder
from ..sources.io import TABLES, file_hashes, lookup_vectors, read_mapping, read_table, table, union_runs, write_table
from .bindings import PAIR_KEYS, corpus, entities, pairs, records, screen, targets
from .registry import query
from .sql import grid

LEAST_ENTITIES = 1000  # eligibility threshold of a context in these tables

# --- sources ---------------------------------------------------------------------------


@query(
    "exact_extraction",
    """
SELECT l_orderkey, l_linenumber, l_partkey, s_name, p_name, l_extendedprice FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F' AND l_returnflag = 'R' AND l_extendedprice > 0
  AND p_name IS NOT NULL AND l_discount IS NOT NULL""",
    ["l_extendedprice"],
)
def exact_extraction(spark, d):
    """Facts with assay and structure under one predicate."""
    facts = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus", "l_returnflag", "l_discount"
    )
    out = curation.extract_measurements(
        facts,
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"),
        table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"),
        "l_suppkey",
        "l_partkey",
        (F.col("l_linestatus") == "F")
        & (F.col("l_returnflag") == "R")
        & (F.col("l_extendedprice") > 0)
        & F.col("p_name").isNotNull()
        & F.col("l_discount").isNotNull(),
    )
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "s_name", "p_name", "l_extendedprice")


@query(
    "extraction_with_year",
    """
SELECT year(o_orderdate)::BIGINT AS document_year, count(*) AS rows FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey
WHERE l_linestatus = 'F' AND l_extendedprice > 0 GROUP BY 1""",
)
def extraction_with_year(spark, d):
    """The same with the document year by a left join, counted per year."""
    docs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").cast("bigint").alias("document_year")
    )
    out = curation.extract_measurements(
        table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus"),
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey")),
        table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey")),
        "l_suppkey",
        "l_partkey",
        (F.col("l_linestatus") == "F") & (F.col("l_extendedprice") > 0),
        docs,
        "l_orderkey",
    )
    return curation.value_counts(out, "document_year")


@query(
    "lineage_extraction",
    """
SELECT l_orderkey IS NOT NULL AND o_orderkey IS NOT NULL AS joined_order, s.s_suppkey IS NOT NULL AS joined_supplier,
       e.vec_id IS NOT NULL AS joined_vector, count(*) AS rows, count(DISTINCT l_partkey) AS entities
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) s ON l_suppkey = s.s_suppkey
LEFT JOIN embeddings e ON l_partkey = e.vec_id GROUP BY 1, 2, 3""",
)
def lineage_extraction(spark, d):
    """All facts with markers of what they joined to."""
    facts = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    out = curation.extract_lineage(
        facts,
        {
            "joined_order": (table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey"),
            "joined_supplier": (
                table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey")),
                "l_suppkey",
            ),
            "joined_vector": (table(spark, d, "embeddings").select(F.col("vec_id").alias("l_partkey")), "l_partkey"),
        },
    )
    return out.groupBy("joined_order", "joined_supplier", "joined_vector").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("l_partkey").alias("entities")
    )


@query(
    "vector_lookup",
    "SELECT p_partkey AS entity, label, len(embedding)::INT AS size, embedding[1]::DOUBLE AS first_value FROM part JOIN embeddings ON p_partkey = vec_id",
    ["first_value"],
)
def vector_lookup(spark, d):
    """Entities with their vectors."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("entity"), F.struct("embedding", "label").alias("vector"))
    found, _ = lookup_vectors(entities(spark, d).select("entity"), vectors, "entity", "vector")
    v = F.col("vector.embedding")
    return found.select("entity", "vector.label", F.size(v).alias("size"), v[0].cast("double").alias("first_value"))


@query(
    "missing_vectors",
    "SELECT 'entities without vector' AS \"check\", count(*) AS violations FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)",
)
def missing_vectors(spark, d):
    """How many entities have no vector."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("entity"), "embedding")
    return lookup_vectors(entities(spark, d).select("entity"), vectors, "entity", "embedding")[1]


@query(
    "union_of_runs",
    """
SELECT 'orders' AS run_tag, o_orderstatus AS status, NULL AS flag, count(*) AS rows FROM orders GROUP BY 2
UNION ALL SELECT 'lines', NULL, l_returnflag, count(*) FROM lineitem GROUP BY 3""",
)
def union_of_runs(spark, d):
    """Results of two runs in one tagged table."""
    a = curation.value_counts(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")), "status")
    b = curation.value_counts(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag")), "flag")
    return union_runs({"orders": a, "lines": b}).select("run_tag", "status", "flag", "rows")


def _new_path(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders", ["o_totalprice"])
def csv_round_trip(spark, d):
    """Orders written as gzip CSV and read back with a fixed schema and a column subset."""
    path = _new_path(spark, "orders-csv")
    write_table(table(spark, d, "orders").drop("o_orderdate"), path, "csv.gz", sep="\t")
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return read_table(spark, path, schema, "\t", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])


@query("partitioned_parquet_round_trip", "SELECT l_returnflag, count(*) AS rows, sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_returnflag", ["quantity"])
def partitioned_parquet_round_trip(spark, d):
    """Lines written by return flag; the filter reads one partition only."""
    path = _new_path(spark, "lines-parquet")
    write_table(table(spark, d, "lineitem").select("l_returnflag", "l_quantity"), path, partition_by=["l_returnflag"])
    back = spark.read.parquet(path).where("l_returnflag = 'R'")
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"))


@query("json_mapping", "SELECT n_name AS key, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_mapping(spark, d):
    """Nation to region dictionary written as one JSON object and read as rows."""
    path = _new_path(spark, "mapping-json")
    named = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entries = F.map_from_entries(F.collect_list(F.struct("n_name", "r_name")))
    named.agg(F.to_json(entries).alias("value")).write.text(path)
    return read_mapping(spark, path)


@query("lookup_file_hashes")
def lookup_file_hashes(spark, d):
    """SHA-256 of all given files, and the root over the hashes of their ranges."""
    return file_hashes(spark, d, [f"{n}.parquet" for n in TABLES]).drop("range_hashes")


# --- row expressions ----------------------------------------------------------------------


@query(
    "coerced_positive_values",
    """
SELECT event_type, count(*) AS rows, sum(v) AS total FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events)
WHERE v IS NOT NULL AND NOT isnan(v) AND v > 0 AND v < 'inf'::DOUBLE GROUP BY event_type""",
    ["total"],
)
def coerced_positive_values(spark, d):
    """Text numbers of the event properties, kept when finite and positive."""
    events = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").alias("v"))
    return x.coerce_positive(events, "v").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("v").alias("total"))


@query("log2_of_values", "SELECT o_orderkey, log2(o_totalprice) AS log2_price FROM orders WHERE o_totalprice > 0", ["log2_price"])
def log2_of_values(spark, d):
    return x.with_log2(table(spark, d, "orders").where("o_totalprice > 0"), "o_totalprice", "log2_price").select("o_orderkey", "log2_price")


@query(
    "binomial_names",
    r"""
SELECT p_partkey, p_name, (contains(t, ' ') AND NOT contains(lower(t), ' sp.') AND NOT contains(lower(t), ' spp.') AND NOT contains(t, '/')
  AND regexp_matches(w[1], '^\p{L}') AND coalesce(regexp_matches(w[2], '^\p{L}'), false)) AS binomial
FROM (SELECT p_partkey, p_name, trim(p_name) AS t, string_split_regex(trim(p_name), '\s+') AS w FROM part)""",
)
def binomial_names(spark, d):
    """Two-word names."""
    return table(spark, d, "part").select("p_partkey", "p_name", x.is_binomial("p_name").alias("binomial"))


@query(
    "mapped_with_fallback",
    """
SELECT coalesce(r.r_name, c.c_mktsegment) AS label, count(*) AS rows, sum(c_acctbal) AS balance
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_nationkey % 2 = 0 LEFT JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1""",
    ["balance"],
    4,
)
def mapped_with_fallback(spark, d):
    """Dictionary lookup with fallback to another column."""
    mapping = table(spark, d, "nation").where("n_nationkey % 2 = 0").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    out = joins.map_column(table(spark, d, "customer"), "c_nationkey", mapping, "n_nationkey", "r_name", "label", "c_mktsegment")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum("c_acctbal").alias("balance"))


@query("allowed_domain", "SELECT lang, source, count(*) AS rows FROM documents WHERE lang IN ('en', 'fr') GROUP BY ALL")
def allowed_domain(spark, d):
    """Rows of the allowed label values."""
    return curation.value_counts(table(spark, d, "documents").where(F.col("lang").isin("en", "fr")), "lang", "source")


@query(
    "ordered_classification",
    """
SELECT label, count(*) AS rows FROM (SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_orderpriority LIKE '1%' THEN 'urgent'
  WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'other' END AS label FROM orders) GROUP BY label""",
)
def ordered_classification(spark, d):
    """First rule that holds."""
    label = x.classify(
        [
            (F.col("o_totalprice") < 50000, "small"),
            (F.col("o_orderpriority").startswith("1"), "urgent"),
            (F.col("o_orderstatus") == "F", "finished"),
        ],
        "other",
    )
    return curation.value_counts(table(spark, d, "orders").select(label.alias("label")), "label")


@query(
    "left_closed_bins",
    """
SELECT bin, count(*) AS rows FROM (SELECT CASE WHEN v < 0.30 THEN '<0.30' WHEN v < 0.50 THEN '0.30-0.50' WHEN v < 0.70 THEN '0.50-0.70' ELSE '>=0.70' END AS bin
FROM (SELECT l_quantity / 50.0::DOUBLE AS v FROM lineitem)) GROUP BY bin""",
)
def left_closed_bins(spark, d):
    """Bins closed on the left."""
    v = table(spark, d, "lineitem").select((F.col("l_quantity") / F.lit(50.0)).alias("v"))
    labels = ["<0.30", "0.30-0.50", "0.50-0.70", ">=0.70"]
    return curation.value_counts(v.select(x.bin_left("v", [0.30, 0.50, 0.70], labels).alias("bin")), "bin")


@query(
    "right_closed_bins",
    """
SELECT bin, count(*) AS rows FROM (SELECT CASE WHEN v < -1e-12 THEN NULL WHEN v <= 0.25 THEN '[0,0.25]' WHEN v <= 0.50 THEN '(0.25,0.50]' WHEN v <= 0.75 THEN '(0.50,0.75]'
  WHEN v <= 0.90 THEN '(0.75,0.90]' WHEN v <= 1 + 1e-12 THEN '(0.90,1.00]' END AS bin FROM (SELECT l_quantity / 50.0::DOUBLE AS v FROM lineitem)) GROUP BY bin""",
)
def right_closed_bins(spark, d):
    """Bins closed on the right, the first also on the left."""
    from ..operators.diversity import SIMILARITY_EDGES, SIMILARITY_LABELS

    v = table(spark, d, "lineitem").select((F.col("l_quantity") / F.lit(50.0)).alias("v"))
    return curation.value_counts(v.select(x.bin_right("v", SIMILARITY_EDGES, SIMILARITY_LABELS).alias("bin")), "bin")


@query("any_label_active", "SELECT doc_id, greatest(quality, toxic)::INT AS any_active FROM labels")
def any_label_active(spark, d):
    """Row maximum over label columns."""
    return table(spark, d, "labels").select("doc_id", x.any_active(["quality", "toxic"]).cast("int").alias("any_active"))


_P_COLUMNS = {"p_a": 0, "p_b": 5, "p_c": 8}
_P_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0 THEN l_discount END AS p_a,
 CASE WHEN l_returnflag <> 'N' THEN l_tax END AS p_b, l_quantity / 50.0::DOUBLE AS p_c FROM lineitem"""


def _p_values(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("p_a"),
        F.when(F.col("l_returnflag") != "N", F.col("l_tax")).alias("p_b"),
        (F.col("l_quantity") / F.lit(50.0)).alias("p_c"),
    )


@query(
    "pooled_label_three_valued",
    f"""
SELECT label, count(*) AS rows FROM (SELECT CASE WHEN coalesce(p_a <= 0.05, false) OR coalesce(p_b <= 0.05, false) OR coalesce(p_c <= 0.05, false) THEN 1
  WHEN p_a IS NOT NULL AND p_b IS NOT NULL AND p_c IS NOT NULL THEN 0 END AS label FROM ({_P_SQL})) GROUP BY label""",
)
def pooled_label_three_valued(spark, d):
    """Active, inactive or undetermined from several p-values."""
    return curation.value_counts(_p_values(spark, d).select(x.pooled_label(list(_P_COLUMNS), 0.05).alias("label")), "label")


@query(
    "label_export_status",
    f"""
SELECT l_partkey, l_orderkey, l_linenumber, label, CASE WHEN label IS NULL THEN 'ambiguous_missing' ELSE 'valid' END AS status
FROM (SELECT *, CASE WHEN coalesce(p_a <= 0.05, false) OR coalesce(p_b <= 0.05, false) OR coalesce(p_c <= 0.05, false) THEN 1
  WHEN p_a IS NOT NULL AND p_b IS NOT NULL AND p_c IS NOT NULL THEN 0 END AS label FROM ({_P_SQL}))""",
)
def label_export_status(spark, d):
    """Pooled labels with their validity status."""
    labelled = _p_values(spark, d).withColumn("label", x.pooled_label(list(_P_COLUMNS), 0.05))
    status = x.classify([(F.col("label").isNull(), "ambiguous_missing")], "valid")
    return labelled.select("l_partkey", "l_orderkey", "l_linenumber", "label", status.alias("status"))


@query(
    "ambiguity_summary",
    f"""
SELECT count(*) AS rows, (sum((p_a IS NULL)::INT) + sum((p_b IS NULL)::INT) + sum((p_c IS NULL)::INT))::BIGINT AS missing_cells,
 sum((p_a IS NULL OR p_b IS NULL OR p_c IS NULL)::INT)::BIGINT AS rows_with_missing,
 sum((NOT (coalesce(p_a <= 0.05, false) OR coalesce(p_b <= 0.05, false) OR coalesce(p_c <= 0.05, false)) AND (p_a IS NULL OR p_b IS NULL OR p_c IS NULL))::INT)::BIGINT AS ambiguous_rows
FROM ({_P_SQL})""",
)
def ambiguity_summary(spark, d):
    """Missing cells, rows with missing cells and rows whose pooled label stays open."""
    p = _p_values(spark, d)
    cols = list(_P_COLUMNS)
    missing = [F.count_if(F.col(c).isNull()) for c in cols]
    any_missing = F.col(cols[0]).isNull() | F.col(cols[1]).isNull() | F.col(cols[2]).isNull()
    return p.agg(
        F.count(F.lit(1)).alias("rows"),
        (missing[0] + missing[1] + missing[2]).alias("missing_cells"),
        F.count_if(any_missing).alias("rows_with_missing"),
        F.count_if(x.pooled_label(cols, 0.05).isNull()).alias("ambiguous_rows"),
    )


@query(
    "margin_scores",
    "SELECT p_partkey, log2(0.02::DOUBLE * p_retailprice) - p_size / 10.0::DOUBLE AS margin, log2(0.02::DOUBLE * p_retailprice) AS control FROM part",
    ["margin", "control"],
)
def margin_scores(spark, d):
    """Margin of a mass-scaled score over a prediction, and the control without it."""
    part = table(spark, d, "part").withColumn("guess", F.col("p_size") / F.lit(10.0))
    return part.select(
        "p_partkey", x.margin_score("p_retailprice", "guess").alias("margin"), x.margin_score("p_retailprice").alias("control")
    )


@query(
    "unit_audit",
    r"""
SELECT normal_unit, convertible, mismatch, count(*) AS rows, sum(converted) AS converted_sum FROM (
 SELECT *, converted IS NOT NULL AS convertible, coalesce(NOT abs(converted - standard) <= 1e-6::DOUBLE * abs(standard), false) AS mismatch FROM (
  SELECT *, v * CASE normal_unit WHEN 'ro' THEN 1.0::DOUBLE WHEN 'ao' THEN 1000.0::DOUBLE WHEN 'nf' THEN 0.001::DOUBLE END AS converted FROM (
   SELECT l_quantity AS v, regexp_replace(lower(trim(l_returnflag || ' . ' || l_linestatus)), '[\s.]', '', 'g') AS normal_unit,
          CASE WHEN l_linenumber = 1 THEN l_quantity ELSE l_quantity * CASE l_returnflag WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN 1000.0::DOUBLE ELSE 0.001::DOUBLE END END AS standard
   FROM lineitem))) GROUP BY 1, 2, 3""",
    ["converted_sum"],
    4,
)
def unit_audit(spark, d):
    """Unit texts normalised, converted and compared with the stored value."""
    lines = table(spark, d, "lineitem")
    factor = F.when(F.col("l_returnflag") == "R", 1.0).when(F.col("l_returnflag") == "A", 1000.0).otherwise(0.001)
    base = lines.select(
        F.col("l_quantity").alias("v"),
        F.concat("l_returnflag", F.lit(" . "), "l_linestatus").alias("unit"),
        F.when(F.col("l_linenumber") == 1, F.col("l_quantity")).otherwise(F.col("l_quantity") * factor).alias("standard"),
    )
    out = curation.audit_units(base, "v", "unit", "standard", {"ro": 1.0, "ao": 1000.0, "nf": 0.001})
    return out.groupBy("normal_unit", "convertible", "mismatch").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("converted").alias("converted_sum")
    )


_RULES = {
    "light": [("p_size", "<=", 20), ("p_retailprice", "<", 1000.0)],
    "heavy": [("p_size", ">", 40), ("p_retailprice", ">=", 950.0)],
}


@query(
    "rule_flags",
    """
SELECT light, heavy, count(*) AS rows FROM (SELECT
 CASE WHEN s IS NOT NULL AND p_retailprice IS NOT NULL THEN (s <= 20 AND p_retailprice < 1000)::INT END AS light,
 CASE WHEN s IS NOT NULL AND p_retailprice IS NOT NULL THEN (s > 40 AND p_retailprice >= 950)::INT END AS heavy
FROM (SELECT nullif(p_size, 7) AS s, p_retailprice FROM part)) GROUP BY light, heavy""",
)
def rule_flags(spark, d):
    """All-of rules over descriptor columns; a missing input leaves the flag missing."""
    part = table(spark, d, "part").withColumn("p_size", F.nullif(F.col("p_size"), F.lit(7)))
    return curation.value_counts(part.select(*[x.rule_flag(r).alias(n) for n, r in _RULES.items()]), *_RULES)


@query(
    "clean_feature_block",
    """
SELECT user_id, sum(CASE WHEN f IS NULL OR isnan(f) OR isinf(f) THEN 0.0 ELSE f END) AS total, count(*) AS rows
FROM (SELECT user_id, CASE event_type WHEN 'error' THEN 'nan'::DOUBLE WHEN 'view' THEN '-inf'::DOUBLE WHEN 'click' THEN NULL ELSE value END AS f FROM events) GROUP BY user_id""",
    ["total"],
)
def clean_feature_block(spark, d):
    """Non-finite feature values set to 0."""
    kind = F.col("event_type")
    f = (
        F.when(kind == "error", F.lit(float("nan"))).when(kind == "view", F.lit(float("-inf"))).when(kind == "click", F.lit(None))
        .otherwise(F.col("value"))
    )
    return table(spark, d, "events").select("user_id", x.clean_feature(f).alias("f")).groupBy("user_id").agg(
        F.sum("f").alias("total"), F.count(F.lit(1)).alias("rows")
    )


@query("group_key_fallback", "SELECT entity, assigned, is_solo FROM entities")
def group_key_fallback(spark, d):
    """Per-entity key for entities without a group."""
    return entities(spark, d).select("entity", "assigned", "is_solo")


@query(
    "derived_labels",
    """
SELECT model, NOT ends_with(model, '_entity_only') AS uses_context, CASE WHEN starts_with(model, 'kind') THEN 'Kind median' ELSE 'Median' END AS label, count(*) AS rows
FROM (SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'kind_entity_only' WHEN l_linenumber % 3 = 1 THEN 'kind_median' ELSE 'context_median' END AS model FROM lineitem) GROUP BY 1, 2, 3""",
)
def derived_labels(spark, d):
    """Display label and context flag from a model name."""
    m = F.col("l_linenumber") % 3
    named = table(spark, d, "lineitem").select(
        F.when(m == 0, "kind_entity_only").when(m == 1, "kind_median").otherwise("context_median").alias("model")
    )
    return curation.value_counts(
        named.select(
            "model", (~F.col("model").endswith("_entity_only")).alias("uses_context"),
            x.classify([(F.col("model").startswith("kind"), "Kind median")], "Median").alias("label"),
        ),
        "model", "uses_context", "label",
    )


# --- joins ------------------------------------------------------------------------------


@query(
    "validated_join",
    "SELECT l_orderkey, l_linenumber, l_quantity, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    ["l_quantity"],
)
def validated_join(spark, d):
    """Many-to-one join whose key is checked first."""
    right = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    left = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return joins.validated_join(left, right, ["l_orderkey"], "inner", "n:1")


@query(
    "exact_membership",
    "SELECT doc_id, exact_overlap FROM screen_flags",
)
def exact_membership(spark, d):
    """Screen texts that also occur in the corpus."""
    rows = screen(spark, d).select("doc_id", F.sha2("text", 256).alias("key"))
    known = corpus(spark, d).select(F.sha2("text", 256).alias("key"))
    return joins.flag_membership(rows, "key", known, "key", "exact_overlap").select("doc_id", "exact_overlap")


@query(
    "restrict_and_exclude",
    f"""
SELECT 'kept' AS side, context, count(*) AS pairs FROM pairs WHERE context IN (SELECT context FROM pairs GROUP BY context HAVING count(DISTINCT entity) >= {LEAST_ENTITIES}) GROUP BY context
UNION ALL SELECT 'left_out', context, count(*) FROM pairs WHERE context NOT IN (SELECT context FROM pairs GROUP BY context HAVING count(DISTINCT entity) >= {LEAST_ENTITIES}) GROUP BY context""",
)
def restrict_and_exclude(spark, d):
    """Pairs of eligible contexts and the rest, by semi and anti join."""
    p = records(spark, d).select("entity", "context").distinct()
    keep = curation.eligible_contexts(curation.context_support(p, "context", "entity"), "context", LEAST_ENTITIES)
    a = curation.value_counts(joins.restrict(p, keep, "context"), "context", out="pairs").withColumn("side", F.lit("kept"))
    b = curation.value_counts(joins.exclude(p, keep, "context"), "context", out="pairs").withColumn("side", F.lit("left_out"))
    return reshape.union_all([a, b]).select("side", "context", "pairs")


@query(
    "presence_audit",
    "SELECT 'unmatched rows' AS \"check\", count(*) AS violations FROM lineitem WHERE l_partkey NOT IN (SELECT vec_id FROM embeddings)",
)
def presence_audit(spark, d):
    """Left join whose unmatched rows are counted."""
    left = table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity"))
    right = table(spark, d, "embeddings").select(F.col("vec_id").alias("entity"), "label")
    return joins.join_all_matched(left, right, ["entity"])[1]


@query(
    "label_crosswalk",
    """
SELECT c.c_custkey, n_name AS context, coalesce(k.pairs, 0) AS pairs, coalesce(k.entities, 0) AS entities,
 CASE WHEN k.pairs IS NULL THEN 'absent' WHEN k.entities < 1500 THEN 'small' ELSE 'in_benchmark' END AS status
FROM customer c LEFT JOIN nation ON c.c_nationkey = n_nationkey
LEFT JOIN (SELECT context, count(*) AS pairs, count(DISTINCT entity) AS entities FROM pairs WHERE class <> (SELECT min(class) FROM pairs) GROUP BY context) k ON k.context = n_name""",
)
def label_crosswalk(spark, d):
    """External labels mapped to contexts, with the context's support and membership status."""
    p = records(spark, d).select("entity", "context", "class").distinct()
    lowest = p.agg(F.min("class").alias("v")).scalar()
    support = curation.context_support(p.where(F.col("class") != lowest), "context", "entity")
    known = support.withColumn("known", F.lit(True))
    out = joins.crosswalk(
        table(spark, d, "customer").select("c_custkey", "c_nationkey"),
        table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("context")),
        known, "c_nationkey", "context", {"pairs": 0, "entities": 0, "known": False},
        [(~F.col("known"), "absent"), (F.col("entities") < 1500, "small")], "in_benchmark", "status",
    )
    return out.select("c_custkey", "context", "pairs", "entities", "status")


WINDOWS = {"train": (None, 1995), "valid": (1996, 1996), "test": (1997, None)}

# Temporal cohorts: entity = customer, record = order, context = priority.
_DATED = """SELECT o_custkey AS entity, o_orderpriority AS context, o_totalprice AS value, o_orderkey AS document, o_orderstatus AS strain,
 year(o_orderdate)::BIGINT AS year FROM orders"""
_COHORT = lambda c: f"CASE WHEN {c} <= 1995 THEN 'train' WHEN {c} = 1996 THEN 'valid' WHEN {c} >= 1997 THEN 'test' ELSE 'outside_window' END"
from .sql import CTES  # noqa: E402

CTES["dated"] = f"""
SELECT *, {_COHORT('first_year')} AS cohort, {_COHORT('first_year')} = {_COHORT('year')} AS in_own_window
FROM (SELECT *, min(year) OVER (PARTITION BY entity) AS first_year FROM ({_DATED}))"""
CTES["cohort_pairs"] = f"""
SELECT cohort, entity, context, quantile_cont({grid('value')}, 0.5::DOUBLE) AS target,
 quantile_cont({grid('value')}, 0.75::DOUBLE) - quantile_cont({grid('value')}, 0.25::DOUBLE) AS target_iqr,
 count(*) AS n_records, count(DISTINCT document) AS n_documents, min(year) AS year_min, max(year) AS year_max, min(first_year) AS first_year
FROM dated WHERE in_own_window GROUP BY cohort, entity, context"""


def dated(spark, d):
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("context"), F.col("o_totalprice").alias("value"),
        F.col("o_orderkey").alias("document"), F.col("o_orderstatus").alias("strain"), F.year("o_orderdate").cast("bigint").alias("year"),
    )
    return curation.temporal_cohorts(orders, "entity", "year", WINDOWS)


def cohort_pairs(spark, d):
    own = dated(spark, d).where("in_own_window")
    out = curation.aggregate_pairs(
        own, ["cohort", "entity", "context"], "value", "target", {"n_documents": "document"},
        extra=[F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.min("first_year").alias("first_year")],
        log=x.log2_grid,
    )
    return out.select("cohort", "entity", "context", "target", "target_iqr", "n_records", "n_documents", "year_min", "year_max", "first_year")


@query(
    "complete_grid",
    """
SELECT level AS cohort, c.context, coalesce(k.pairs, 0) AS pairs, coalesce(k.entities, 0) AS entities
FROM (SELECT DISTINCT context FROM cohort_pairs) c CROSS JOIN (SELECT unnest(['train', 'valid', 'test', 'later']) AS level)
LEFT JOIN (SELECT cohort, context, count(*) AS pairs, count(DISTINCT entity) AS entities FROM cohort_pairs GROUP BY ALL) k ON k.cohort = level AND k.context = c.context""",
)
def complete_grid(spark, d):
    """Every context at every cohort, absent counts 0."""
    p = dated(spark, d).where("in_own_window").select("cohort", "entity", "context").distinct()
    counts = curation.context_support(p, "context", "entity", ["cohort"])
    return joins.complete_grid(p.select("context").distinct(), "cohort", ["train", "valid", "test", "later"], counts, ["context"], ["pairs", "entities"])


@query(
    "lineage_enrichment",
    """
SELECT o_orderpriority, l_returnflag, count(*) AS rows, sum(l_quantity) AS quantity FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
WHERE l_linestatus = 'F' GROUP BY ALL""",
    ["quantity"],
)
def lineage_enrichment(spark, d):
    """Retained records with the fields of their document."""
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    kept = table(spark, d, "lineitem").where("l_linestatus = 'F'").select("l_orderkey", "l_returnflag", "l_quantity")
    return joins.validated_join(kept, docs, ["l_orderkey"], "left", "n:1").groupBy("o_orderpriority", "l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity")
    )


@query(
    "attached_flags",
    """
SELECT is_premium, count(*) AS rows FROM (SELECT coalesce(f.flag, false) AS is_premium FROM orders
LEFT JOIN (SELECT c_custkey, true AS flag FROM customer WHERE c_acctbal > 5000) f ON o_custkey = f.c_custkey) GROUP BY 1""",
)
def attached_flags(spark, d):
    """Entity flags on records, absent entities false."""
    flags = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("is_premium"))
    out = joins.attach_flags(table(spark, d, "orders").select("o_custkey"), flags, ["o_custkey"], ["is_premium"])
    return curation.value_counts(out, "is_premium")


# --- aggregation of repeated records -------------------------------------------------------


@query(
    "pair_table",
    "SELECT * FROM pairs",
    ["median_value", "target", "target_q25", "target_q75", "target_iqr"],
)
def pair_table(spark, d):
    """One row per entity and context: medians, quartiles, record and distinct source counts."""
    return pairs(spark, d).select(
        *PAIR_KEYS, "n_records", "median_value", "target", "target_q25", "target_q75", "target_iqr", "n_documents", "n_strains", "n_units"
    )


@query("pair_quartiles", "SELECT entity, context, target_q25, target_q75, target_iqr FROM pairs", ["target_q25", "target_q75", "target_iqr"])
def pair_quartiles(spark, d):
    """Quartiles and spread of each pair."""
    from ..operators.ordered import group_quantiles

    q = group_quantiles(
        records(spark, d).select("entity", "context", "value"), ["entity", "context"], "value",
        {"target_q25": (0.25, x.log2_grid), "target_q75": (0.75, x.log2_grid)},
    )
    return q.withColumn("target_iqr", F.col("target_q75") - F.col("target_q25"))


@query("cohort_pair_table", "SELECT * FROM cohort_pairs", ["target", "target_iqr"])
def cohort_pair_table(spark, d):
    """Pairs per temporal cohort, built from the records of the cohort's own window only."""
    return cohort_pairs(spark, d)


@query(
    "context_support",
    f"""
SELECT context, class, pairs, entities, entities >= {LEAST_ENTITIES} AS eligible FROM (
 SELECT context, class, count(*) AS pairs, count(DISTINCT entity) AS entities FROM pairs GROUP BY ALL)""",
)
def context_support(spark, d):
    """Support of each context and the eligibility gate."""
    p = records(spark, d).select(*PAIR_KEYS).distinct()
    support = curation.context_support(p, "context", "entity", ["class"])
    return support.withColumn("eligible", F.col("entities") >= LEAST_ENTITIES)


@query(
    "train_era_support",
    "SELECT context, entities, entities >= 200 AS eligible FROM (SELECT context, count(DISTINCT entity) AS entities FROM cohort_pairs WHERE cohort = 'train' GROUP BY context)",
)
def train_era_support(spark, d):
    """Eligibility judged on the training cohort alone."""
    p = dated(spark, d).where("in_own_window AND cohort = 'train'").select("entity", "context").distinct()
    return curation.context_support(p, "context", "entity").select("context", "entities", (F.col("entities") >= 200).alias("eligible"))


@query(
    "distinct_source_labels",
    "SELECT context, string_agg(DISTINCT unit, '; ' ORDER BY unit) AS units FROM records GROUP BY context",
)
def distinct_source_labels(spark, d):
    """Sorted distinct source labels of each context as one text."""
    return curation.distinct_labels(records(spark, d), ["context"], "unit", "units")


@query("value_counts", "SELECT class, unit, count(*) AS rows FROM records GROUP BY ALL")
def value_counts(spark, d):
    return curation.value_counts(records(spark, d), "class", "unit")


@query(
    "field_distributions",
    """
SELECT field, value, count(*) AS records, (SELECT count(*) FROM lineitem) AS denominator FROM (
 SELECT 'returnflag' AS field, coalesce(nullif(l_returnflag, 'N'), '<missing>') AS value FROM lineitem
 UNION ALL SELECT 'linestatus', l_linestatus FROM lineitem UNION ALL SELECT 'line', l_linenumber::VARCHAR FROM lineitem) GROUP BY ALL""",
)
def field_distributions(spark, d):
    """Value counts of several fields in one table, missing values shown."""
    lines = table(spark, d, "lineitem").select(
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("returnflag"), F.col("l_linestatus").alias("linestatus"),
        F.col("l_linenumber").alias("line"),
    )
    return curation.field_distributions(lines, ["returnflag", "linestatus", "line"])


@query(
    "relation_profile",
    """
SELECT context, count(*) FILTER (relation = 'F') AS exact, count(*) FILTER (relation = 'O' ) AS censored, count(*) FILTER (relation IS NULL) AS other,
 count(*) AS total, count(*) FILTER (relation = 'O') / count(*)::DOUBLE AS censored_fraction
FROM (SELECT context, CASE WHEN unit = 'N' THEN NULL ELSE relation END AS relation FROM records) GROUP BY context""",
    ["censored_fraction"],
)
def relation_profile(spark, d):
    """Exact and censored relations per context."""
    r = records(spark, d).withColumn("relation", F.when(F.col("unit") != "N", F.col("relation")))
    return curation.relation_profile(r, ["context"], "relation", ["F"], ["O"])


@query(
    "source_support",
    """
SELECT context, count(*) AS records, count(DISTINCT document) AS documents, count(DISTINCT strain) AS strains, count(DISTINCT line) AS assays,
 count(DISTINCT unit) AS labels, count(*) FILTER (unit IS NULL) AS missing_labels
FROM (SELECT context, document, strain, line, nullif(unit, 'A') AS unit FROM records) GROUP BY context""",
)
def source_support(spark, d):
    """Records and distinct sources of each context."""
    r = records(spark, d).withColumn("unit", F.nullif(F.col("unit"), F.lit("A")))
    return curation.source_support(
        r, ["context"], {"documents": "document", "strains": "strain", "assays": "line", "labels": "unit"}, {"missing_labels": "unit"}
    )


@query(
    "replicate_audit",
    """
SELECT count(*) AS pairs, count(*) FILTER (n_records >= 2) AS repeated_pairs, avg((n_records >= 2)::INT::DOUBLE) AS repeated_fraction,
 max(target_iqr) FILTER (n_records >= 2) AS repeated_spread_max, quantile_cont(n_records, 0.5::DOUBLE) AS records_median, quantile_cont(n_records, 0.9::DOUBLE) AS records_p90,
 (SELECT quantile_cont(target_iqr, 0.5::DOUBLE) FROM pairs WHERE n_records >= 2) AS repeated_spread_median,
 (SELECT quantile_cont(target_iqr, 0.75::DOUBLE) FROM pairs WHERE n_records >= 2) AS repeated_spread_q75 FROM pairs""",
    ["repeated_fraction", "repeated_spread_max", "records_median", "records_p90", "repeated_spread_median", "repeated_spread_q75"],
)
def replicate_audit(spark, d):
    """How many pairs rest on repeated records and how far those spread."""
    from ..operators.metrics import replicate_audit as audit
    from ..session import materialize

    return audit(materialize(targets(spark, d)))


@query(
    "dispersion_audit",
    """
SELECT r.entity, r.context, target_iqr, count(*) AS records, count(DISTINCT document) AS documents, count(DISTINCT strain) AS strains,
 max(value) / min(value) AS ratio_of_extremes FROM records r JOIN (SELECT entity, context, target_iqr FROM pairs WHERE target_iqr >= 2) p
ON r.entity = p.entity AND r.context = p.context GROUP BY r.entity, r.context, target_iqr""",
    ["target_iqr", "ratio_of_extremes"],
)
def dispersion_audit(spark, d):
    """Evidence behind pairs of extreme spread."""
    return curation.dispersion_audit(
        targets(spark, d), records(spark, d), ["entity", "context"], "target_iqr", 2.0,
        [F.countDistinct("document").alias("documents"), F.countDistinct("strain").alias("strains"),
         (F.max("value") / F.min("value")).alias("ratio_of_extremes")],
    )


@query(
    "context_detail",
    """
SELECT context, context_id, class, pairs, entities, units FROM (SELECT context, context_id, class, count(*) AS pairs, count(DISTINCT entity) AS entities FROM pairs GROUP BY ALL)
JOIN (SELECT context, string_agg(DISTINCT unit, '; ' ORDER BY unit) AS units FROM records GROUP BY context) USING (context)""",
)
def context_detail(spark, d):
    """Support of each context with its source labels."""
    r = records(spark, d)
    support = curation.context_support(r.select(*PAIR_KEYS).distinct(), "context", "entity", ["context_id", "class"])
    return joins.validated_join(support, curation.distinct_labels(r, ["context"], "unit", "units"), ["context"], "inner", "1:1")


# --- exclusions ----------------------------------------------------------------------------


def _criteria():
    return [
        ("not exact", F.col("relation") == "F"),
        ("wrong unit", F.col("unit").isin("R", "A")),
        ("value out of range", x.is_finite("value") & (F.col("value") > 2000)),
        ("no line", F.nullif(F.col("line"), F.lit(7)).isNotNull()),
        ("flagged", F.col("discount") < 0.09),
    ]


_REASON = """CASE WHEN NOT coalesce(relation = 'F', false) THEN 'not exact' WHEN NOT coalesce(unit IN ('R', 'A'), false) THEN 'wrong unit'
 WHEN NOT coalesce(value > 2000, false) THEN 'value out of range' WHEN nullif(line, 7) IS NULL THEN 'no line'
 WHEN NOT coalesce(discount < 0.09, false) THEN 'flagged' ELSE 'retained' END"""


WATERFALL_SQL = f"""
WITH t AS (SELECT {_REASON} AS step, count(*) AS n FROM records GROUP BY 1),
 s AS (SELECT unnest(['input', 'not exact', 'wrong unit', 'value out of range', 'no line', 'flagged', 'retained']) AS step, unnest(range(0, 7))::INT AS step_order),
 f AS (SELECT step_order, s.step, coalesce(n, 0) AS rows_excluded FROM s LEFT JOIN t ON s.step = t.step)
SELECT * FROM (SELECT step_order, step, coalesce(sum(rows_excluded) OVER (ORDER BY step_order DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rows_retained,
 rows_excluded FROM f) WHERE step <> 'retained'"""


@query("curation_waterfall", WATERFALL_SQL)
def curation_waterfall(spark, d):
    """Rows retained and excluded at each ordered step."""
    return curation.waterfall(records(spark, d), _criteria())


def _curated(spark, d):
    gates = {
        "value not finite": ~x.is_finite("value"),
        "quantity above 40": F.col("quantity") > 40,
        "unknown unit": ~F.col("unit").isin("R", "A"),
    }
    return curation.curate(records(spark, d), _criteria(), gates)


@query("waterfall_of_write", WATERFALL_SQL)
def waterfall_of_write(spark, d):
    """The same counted while the retained records are written."""
    return _curated(spark, d)[1]


@query(
    "gates_of_write",
    f"""SELECT * FROM (SELECT unnest(['value not finite', 'quantity above 40', 'unknown unit']) AS "check",
 unnest([count(*) FILTER (value IS NULL), count(*) FILTER (quantity > 40), count(*) FILTER (unit NOT IN ('R', 'A'))]) AS violations FROM (SELECT *, {_REASON} AS reason FROM records) WHERE reason = 'retained')""",
)
def gates_of_write(spark, d):
    """Row contracts of the retained records, counted by the write."""
    return _curated(spark, d)[2]


@query(
    "curated_records",
    f"SELECT context, unit, count(*) AS rows, sum(value) AS value FROM (SELECT *, {_REASON} AS reason FROM records) WHERE reason = 'retained' GROUP BY context, unit",
    ["value"],
    3,
)
def curated_records(spark, d):
    """The records as written, summed per context and unit."""
    return _curated(spark, d)[0].groupBy("context", "unit").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("value"))


@query("exclusion_reasons", f"SELECT context, {_REASON} AS reason, count(*) AS rows, sum(value) AS value FROM records GROUP BY 1, 2", ["value"], 3)
def exclusion_reasons(spark, d):
    """First failed criterion of every record, summed per context."""
    return curation.tag_exclusion(records(spark, d), _criteria()).groupBy("context", "reason").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("value").alias("value")
    )


@query(
    "temporal_cohort_rows",
    "SELECT cohort, in_own_window, count(*) AS rows, count(DISTINCT entity) AS entities FROM dated GROUP BY ALL",
)
def temporal_cohort_rows(spark, d):
    """Records of each temporal cohort inside and outside the cohort's own window."""
    return dated(spark, d).groupBy("cohort", "in_own_window").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("entity").alias("entities")
    )


@query("first_seen_year", "SELECT entity, min(year) AS first_year FROM dated GROUP BY entity")
def first_seen_year(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("bigint").alias("year"))
    return curation.first_seen(orders, "entity", "year")


@query(
    "missing_time_side_output",
    """
SELECT side, count(*) AS rows, sum(l_quantity) AS quantity FROM (SELECT l_quantity,
 CASE WHEN nullif(year(l_shipdate), 2001) IS NULL THEN 'missing' ELSE 'known' END AS side FROM lineitem) GROUP BY side""",
    ["quantity"],
)
def missing_time_side_output(spark, d):
    """Records with and without a year, as two outputs of one read."""
    lines = table(spark, d, "lineitem").select("l_quantity", F.nullif(F.year("l_shipdate"), F.lit(2001)).alias("year"))
    known, missing = curation.split_missing(lines, "year")
    both = union_runs({"known": known, "missing": missing}, "side")
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"))


@query("excluded_missing_rows", "SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
def excluded_missing_rows(spark, d):
    """Ids of the rows left out because a field is missing."""
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return curation.excluded_missing(docs, "quality", ["doc_id", "source"])


@query(
    "replayed_pairs",
    f"""
SELECT "column", (count(*) FILTER (a IS NULL OR b IS NULL))::BIGINT AS unmatched, max(abs(a - b)) AS max_difference,
 count(*) FILTER (a IS NULL OR b IS NULL) = 0 AND max(abs(a - b)) <= 1e-12 AS passed FROM (
 SELECT unnest(['target', 'target_iqr']) AS "column", unnest([p.target, p.target_iqr]) AS a, unnest([r.m, r.q]) AS b
 FROM pairs p FULL JOIN (SELECT entity, context, quantile_cont(v, 0.5::DOUBLE) AS m, quantile_cont(v, 0.75::DOUBLE) - quantile_cont(v, 0.25::DOUBLE) AS q
  FROM (SELECT entity, context, {grid('value')} AS v FROM records) GROUP BY ALL) r ON p.entity = r.entity AND p.context = r.context) GROUP BY "column\"""",
    ["max_difference"],
)
def replayed_pairs(spark, d):
    """Pair table against a replay with the plain quantile aggregate: same keys, differences within 1e-12."""
    from ..session import materialize

    new = targets(spark, d)
    logs = records(spark, d).select("entity", "context", x.log2_grid("value").alias("v"))
    old = logs.groupBy("entity", "context").agg(
        F.percentile("v", F.lit(0.5)).alias("target"),
        (F.percentile("v", F.lit(0.75)) - F.percentile("v", F.lit(0.25))).alias("target_iqr"),
    )
    return contracts.check_replay(new, old, ["entity", "context"], ["target", "target_iqr"], 1e-12)


@query(
    "keep_first_per_text",
    """
SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def keep_first_per_text(spark, d):
    """First document of each distinct text."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("text_key"))
    return curation.dedup_first(docs, ["text_key"], ["doc_id"]).select("doc_id", "source", "lang")


@query(
    "dedup_quality_counts",
    """
SELECT sum(n)::BIGINT AS input_rows, sum(n - v)::BIGINT AS invalid_rows, sum(v)::BIGINT AS valid_rows, count(*) FILTER (v > 0) AS deduplicated_rows,
 sum(greatest(v - 1, 0))::BIGINT AS dropped_duplicates FROM (SELECT text, count(*) AS n, count(*) FILTER (n_chars >= 200) AS v FROM documents GROUP BY text)""",
)
def dedup_quality_counts(spark, d):
    """Input, invalid, valid, kept and dropped rows of the de-duplication."""
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("text_key"), "doc_id", "n_chars")
    return curation.dedup_qc(docs, ["text_key"], F.col("n_chars") >= 200)


@query(
    "dedup_kept_counts",
    """
WITH kept AS (SELECT lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents WHERE n_chars >= 200) WHERE rn = 1)
SELECT 'lang' AS field, lang AS value, count(*) AS kept_rows FROM kept GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM kept GROUP BY source""",
)
def dedup_kept_counts(spark, d):
    """Kept documents of the de-duplication by language and by source."""
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("text_key"), "doc_id", "n_chars", "lang", "source")
    return curation.dedup_kept_counts(docs, ["text_key"], F.col("n_chars") >= 200, ["doc_id"], ["lang", "source"])


@query("largest_contexts", "SELECT context, class, count(*) AS pairs FROM pairs GROUP BY ALL ORDER BY pairs DESC, context LIMIT 10")
def largest_contexts(spark, d):
    """The ten contexts with most pairs."""
    p = records(spark, d).select(*PAIR_KEYS).distinct()
    return reshape.largest(curation.value_counts(p, "context", "class", out="pairs"), "pairs", 10, "context")


@query(
    "frozen_display_order",
    """
SELECT l_returnflag, count(*) AS rows, CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END::INT AS display_order FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY l_returnflag ORDER BY display_order""",
)
def frozen_display_order(spark, d):
    """Rows in the order of a fixed list."""
    counts = curation.value_counts(table(spark, d, "lineitem"), "l_returnflag")
    return reshape.order_by_list(counts, "l_returnflag", ["R", "A"]).orderBy("display_order")


@query(
    "union_by_name",
    "SELECT c_custkey AS id, c_nationkey AS nation, 'customer' AS side FROM customer UNION ALL SELECT s_suppkey, s_nationkey, 'supplier' FROM supplier",
)
def union_by_name(spark, d):
    """Frames with the same columns in another order."""
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.lit("customer").alias("side"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("side"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    return reshape.union_all([a, b])


@query("fallback_audit", "SELECT count(*) AS entities, count(*) FILTER (is_solo) AS without_group, count(*) FILTER (is_solo) / count(*)::DOUBLE AS fraction_without_group FROM entities", ["fraction_without_group"])
def fallback_audit(spark, d):
    """Entities without a group key."""
    return splits.fallback_audit(entities(spark, d), "group_key")
