"""Captions among lines of any length."""

import re

import duckdb
from pyspark.sql import functions as F

from tessera.operators import planning


def test_long_lines_need_no_stack(spark):
    """Failed before: the executor was lost by a stack overflow."""
    lines = ["Ab " * 50_000, "Ab " * 50_000 + "(#12)", "A.b,\t" * 50_000 + "x (12),", "Ab 1 (12)", "Smith Jones (#12) ,", "Smith  Jones(12)", "Smith (1234567)", "Smith-(12)", "Smith\n(1)", "smith (12):", "1 Smith (12)", "Acme Holdings LLC,", "a b c d e f g LLC", ""]
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, t string").repartition(2)
    found = [r[0] for r in rows.orderBy("k").select(planning.caption_noise(F.col("t"))).collect()]
    clean = [" ".join(re.sub(r":$", "", re.sub(r"^#+\s*", "", t)).split()) for t in lines]
    want = [c != "" and any(duckdb.execute("SELECT regexp_matches(?, ?)", [c, p]).fetchall()[0][0] for p in planning.CAPTIONS) for c in clean]
    assert found == want and any(want) and not all(want)
    assert sum(planning._steady(p) != p for p in planning.CAPTIONS) == 1
