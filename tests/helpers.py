"""Small helpers of the tests; under a name of their own, as every folder of tests has a ``conftest``."""

from __future__ import annotations


def one(spark, **columns):
    """Evaluate named expressions over one row."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
