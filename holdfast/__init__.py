"""holdfast: leakage-audited evaluation data sets and reports as Spark DataFrame jobs."""
