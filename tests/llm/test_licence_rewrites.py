"""The rewrites as Java runs them give what the plain patterns give."""

import random

from pyspark.sql import functions as F

from feedforge.llm import licenses

BITS = [
    "non-", "Non", "nonnon-", "v", "vv", "V.", "ver", "version", " 2", "3", "&", "  ", " ", "\n", "\n\n", "\t", "-", "_", "\u00e9", "\u03a3", "sub-",
    "licence", "licences", "sub-licens", "all rights reserved", ".", " Copyright", " (c) 2020", "(C)", "\u00a9", "copyright notice",
    "copyright 1999 permission is hereby granted ", "a", "zz", "MIT License", "\U0001f600",
]


def test_canonical_form_is_that_of_the_plain_patterns(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice(BITS) for _ in range(rng.randrange(1, 14))),) for _ in range(4000)] + [(None,), ("",)]
    plain = F.lower("text")
    for pattern, by in licenses.REWRITES:
        plain = F.regexp_replace(plain, pattern, by)
    df = spark.createDataFrame(rows, "text string")
    assert df.where(~F.trim(plain).eqNullSafe(licenses.canonical(F.col("text")))).isEmpty()


def test_no_pattern_begins_with_a_boundary(spark):
    """A boundary in front is tried at every character of every unit."""
    df = spark.createDataFrame([(1, "MIT License")], "doc_id long, text string")
    plan = licenses.licensed(df, df.select(F.lit("x").alias("license_id"), "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(" in plan and ", \\bnon-" not in plan and ", \\bv(" not in plan
