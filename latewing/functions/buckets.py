"""Reproducible pseudo-random choices: md5 of a stable key, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def key_text(*cols) -> Column:
    """One text for a compound key; NULL parts count as empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def md5_bucket(text: Column, seed: int = 42, buckets: int = 100) -> Column:
    """Bucket 0..buckets-1 from the first 32 bits of the md5."""
    digest = F.md5(F.concat(text, F.lit(f"#{seed}")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def md5_rank_text(text: Column, seed: int = 42) -> Column:
    """Sortable digest; the order of a seeded shuffle."""
    return F.md5(F.concat(text, F.lit(f"#{seed}")))
