"""Joins with keys that may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Groups up to which a join sends them to every task (a few MB); salts over which a larger join deals a key's rows.
MOST_SENT, SALTS = 50_000, 64


def dealt_join(rows: DataFrame, groups: DataFrame, on: str, by: str) -> DataFrame:
    """Inner join of ``rows`` with the table ``groups``, which has a row per key.

    Few groups go to every task. Otherwise a key's rows are dealt over salts by the hash of their column ``by``, and its group
    is copied to those salts that have rows.
    """
    if groups.count() <= MOST_SENT:
        return rows.join(F.broadcast(groups), on)
    (salt,) = fresh(rows, "sg_salt")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)))
    return salted.join(salted.select(on, salt).distinct().join(groups, on), [on, salt]).drop(salt)
