"""Join many rows per key to the one row of facts per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Session setting: over how many join keys the rows of one group are spread.
SALTS = "keelson.join.salts"


def with_group_facts(rows: DataFrame, facts: DataFrame, key: str, spread_by: str, how: str = "inner",
                     salts: int | None = None) -> DataFrame:
    """Join ``facts`` (one row per ``key``) to ``rows`` without gathering a hot key.

    The rows of a key are spread over ``salts`` join keys (of the session setting
    ``keelson.join.salts``, by default 8; set it to the number of tasks a third of the rows should
    fill) by a hash of ``spread_by`` and the facts repeated as often.  AQE may split those further, and because the result is
    not partitioned by ``key`` a following rank filter or aggregation still shrinks every
    key on the map side before its own shuffle.
    """
    salts = salts or int(rows.sparkSession.conf.get(SALTS, "8"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
