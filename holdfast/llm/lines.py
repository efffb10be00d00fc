"""Line deduplication by distinct-site spread: a line found on many sites is boilerplate. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LG_K = 12  # size of the sketches: standard error 1.04 / sqrt(2^12) = 1.6 %
LONG = 40  # code points from which a line is hardly found twice by chance
MARGIN = 0.1  # estimates this near the threshold, six standard errors, are counted exactly


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _bare(line: Column) -> Column:
    """A line without surrounding blanks."""
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def _key(line: Column) -> Column:
    """A line's identity without surrounding blanks: 128 bits; missing for a blank line."""
    return F.when(_bare(line) != "", F.unhex(F.md5(_bare(line).cast("binary"))))


def _row_key() -> Column:
    return F.struct(F.col("doc_id"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("digest"))


def line_sites(docs: DataFrame, site: str = "source") -> DataFrame:
    """Every line that is not blank: row (its text's key), place (from 0), site (missing: empty), line (hash), long. Stored; both steps read it."""
    found = docs.select(_row_key().alias("row"), F.coalesce(F.col(site), F.lit("")).alias("site"), F.posexplode(_lines()).alias("place", "text"))
    return stored(found.select(
        "row", "place", "site", _key(F.col("text")).alias("line"), (F.length(_bare(F.col("text"))) >= LONG).alias("long")
    ).where("line is not null"))


def spread_lines(found: DataFrame, min_sites: int = 10, margin: float = MARGIN, short_sites: int | None = None) -> DataFrame:
    """Lines on at least ``min_sites`` distinct sites (below ``LONG`` code points: ``short_sites``): line (hash), sites, owner (the row that keeps it), place (where in it).

    Every line hash gets a HyperLogLog sketch of its sites, merged by aggregation: partial sketches are
    built before the shuffle, so a line with a third of all rows arrives as one sketch per task. Lines
    whose estimate is within ``margin`` of the threshold are counted exactly: their (line, site) pairs
    are made distinct first, which again is partial before the shuffle. A missing site is one site.
    """
    sketched = found.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate"), F.min(F.struct("row", "place")).alias("first"), F.max("long").alias("long")
    )
    least = F.when(F.col("long"), F.lit(min_sites)).otherwise(F.lit(min_sites if short_sites is None else short_sites))
    sketched = stored(sketched.withColumn("least", least).where(F.col("estimate") >= F.col("least") * (1 - margin)))
    near = sketched.where(F.col("estimate") <= F.col("least") * (1 + margin))
    exact = found.join(near.select("line"), "line", "left_semi").select("line", "site").distinct().groupBy("line").agg(F.count("*").alias("exact"))
    lines = sketched.join(exact, "line", "left").withColumn("sites", F.coalesce("exact", "estimate")).where(F.col("sites") >= F.col("least"))
    return stored(lines.select("line", "sites", F.col("first.row").alias("owner"), "first.place"))


def dedup_lines(docs: DataFrame, min_sites: int = 10, site: str = "source", margin: float = MARGIN, short_sites: int | None = None) -> DataFrame:
    """``docs`` without cross-site boilerplate, plus ``n_lines`` and ``n_removed``; columns of these names are replaced.

    A line (surrounding blanks aside) on at least ``min_sites`` sites (``short_sites``, if given, for one
    below ``LONG`` code points) stays once, at its first place in the row with the least doc_id, and goes everywhere else. Blank lines stay. No row goes: a text all
    of whose lines went becomes empty. ``n_chars`` is set anew where there is such a column.

    A missing text is treated as empty and stays missing; it has one line, as the empty text. A missing
    doc_id comes first. Rows equal in doc_id and text are treated alike. An empty table gives an empty
    result.
    """
    found = line_sites(docs, site)
    lines = spread_lines(found, min_sites, margin, short_sites)
    gone = found.drop("site", "long").join(lines.select("line", "owner", F.col("place").alias("kept")), "line")
    gone = gone.where(~(F.col("row").eqNullSafe(F.col("owner")) & (F.col("place") == F.col("kept")))).select("row", "place").distinct()
    cuts = gone.groupBy(F.col("row.doc_id").alias("_id"), F.col("row.digest").alias("_digest")).agg(F.array_sort(F.collect_list("place")).alias("at"))
    # Flags up to the last line that goes, so that dropping lines takes one pass over them.
    previous = F.concat(F.array(F.lit(-1)), F.slice("at", F.lit(1), F.size("at") - 1))
    flags = F.flatten(F.zip_with("at", previous, lambda c, p: F.concat(F.array_repeat(F.lit(False), c - p - 1), F.array(F.lit(True)))))
    cuts = stored(cuts.select(F.col("_id").alias("_cut_id"), "_digest", flags.alias("_cut"), F.size("at").cast("long").alias("_gone")))
    base = docs.drop("n_lines", "n_removed", "_cut", "_gone", "_digest").withColumn("_digest", _row_key()["digest"])
    out = base.join(cuts, base["doc_id"].eqNullSafe(cuts["_cut_id"]) & (base["_digest"] == cuts["_digest"]), "left").drop("_digest", "_cut_id")
    kept = F.array_join(F.filter(_lines(), lambda _, i: ~F.coalesce(F.get("_cut", i), F.lit(False))), "\n")
    text = F.when(F.col("_cut").isNotNull(), kept).otherwise(F.col("text"))
    out = out.withColumns(
        {"n_lines": F.size(_lines()).cast("long"), "n_removed": F.coalesce("_gone", F.lit(0)), "text": text}
    ).drop("_cut", "_gone")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
