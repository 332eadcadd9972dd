"""Row-keyed pseudo-randomness: the same row always lands in the same place,
whatever the partitioning, the cluster or the number of retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_hash(key: Column, seed: int | str, digits: int = 8) -> Column:
    """Leading ``digits`` hex digits of md5(seed:key) as a whole number (at most 15)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def keyed_bucket(key: Column, seed: int | str, buckets: int) -> Column:
    return keyed_hash(key, seed) % F.lit(buckets)
