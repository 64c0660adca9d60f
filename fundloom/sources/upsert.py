"""Upserts on natural keys, and replacing parts of a table, with plain Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new laid over it: new values win where they aren't null. outcome tells created, updated and kept rows apart.

    new must have one row a key; old keeps all its rows. A null key equals no other.
    """
    added = F.lit(True)
    a = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in old.columns if c not in keys], added.alias("_was"))
    b = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys], added.alias("_is"))
    both = a.join(b, keys, "full")
    names = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    pick = [F.coalesce(*[F.col(f"{p}{c}") for p, df in (("_new_", new), ("_old_", old)) if c in df.columns]).alias(c) for c in names]
    outcome = F.when(F.col("_was").isNull(), "created").when(F.col("_is").isNull(), "kept").otherwise("updated")
    return both.select(*keys, *pick, outcome.alias("outcome"))


def replace_parts(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes df; of a table there already, only the parts that df has rows of are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
