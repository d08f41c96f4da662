"""Set-based merges and referential operations on keyed frames. Every function returns the new table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenora.operators.keys import append_small_keys


def distinct_members(
    source: DataFrame, keys: Mapping[str, str], attributes: Mapping[str, str] | None = None
) -> DataFrame:
    """One row per natural key of ``source``, renamed to the target's columns.

    Attributes that vary within a key get their minimum, so a key never appears twice. Rows with a null
    key are left out: they could never be looked up again.
    """
    rows = source.select(
        *[F.col(s).alias(t) for t, s in keys.items()],
        *[F.col(s).alias(t) for t, s in (attributes or {}).items()],
    )
    rows = rows.na.drop(subset=list(keys))
    if not attributes:
        return rows.distinct()
    return rows.groupBy(*keys).agg(*[F.min(a).alias(a) for a in attributes])


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """Insert-only merge: members of ``source`` whose key is not in ``target`` get the next ids."""
    fresh = source.join(target.select(*keys), list(keys), "left_anti")
    return append_small_keys(target, fresh, keys, id_column)


def _one_a_key(source: DataFrame, keys: Sequence[str], names: Sequence[str], what: str) -> DataFrame:
    """(keys, names) of a source whose keys must be unique: a repeated key raises while the query runs."""
    message = F.concat_ws(" ", F.lit(f"{what} has several rows for"), *[F.col(k).cast("string") for k in keys])
    seen = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(F.lit(1).alias("_"), *names)).alias("_row"))
    row = F.when(F.col("_n") > 1, F.raise_error(message).cast(seen.schema["_row"].dataType)).otherwise(F.col("_row"))
    return seen.select(*keys, row.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in names])


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched keys take every other column from ``source`` (nulls included); new keys are inserted.

    Two source rows for one key raise while the query runs, as a merge must not choose between them. A null in the key
    matches nothing, so such source rows are always inserted.
    """
    names = [c for c in target.columns if c not in keys]
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    news = _one_a_key(source.filter(whole), keys, names, "the source").select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in names], F.lit(True).alias("_hit"))
    both = target.join(news, list(keys), "full_outer").select(
        *keys,
        *[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in names],
    )
    return both.unionByName(source.filter(~whole).select(*keys, *names))


def update_by_key(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``target`` with a match take the changed columns; others stay, and no row is ever added.

    Of several changes for one key the least counts, comparing the changed columns in their order (null first).
    """
    names = [c for c in changes.columns if c not in keys]
    least = F.min(F.struct(*names)) if names else F.lit(None)
    single = changes.groupBy(*keys).agg(least.alias("_least"))
    news = single.select(*keys, *[F.col(f"_least.{c}").alias(f"_new_{c}") for c in names], F.lit(True).alias("_hit"))
    both = target.join(news, list(keys), "left")
    return both.select(*[
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c)
        for c in target.columns
    ])


def append_rows(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows)


def lookup(
    facts: DataFrame,
    dimension: DataFrame,
    on: Mapping[str, str],
    take: Sequence[str],
    how: str = "left",
) -> DataFrame:
    """Fetch dimension columns by natural key; ``on`` maps fact column to dimension column.

    No broadcast hint: the engine measures the dimension and broadcasts it only under its size limit,
    otherwise it shuffles and splits skewed keys.
    """
    dim = dimension.select(*[F.col(d).alias(f"_dim_{d}") for d in on.values()], *take)
    condition = None
    for f, d in on.items():
        match = facts[f] == dim[f"_dim_{d}"]
        condition = match if condition is None else condition & match
    return facts.join(dim, condition, how).drop(*[f"_dim_{d}" for d in on.values()])


def orphans(facts: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    keys = parents.select(F.col(parent_key).alias(key))
    return facts.filter(F.col(key).isNotNull()).join(keys, key, "left_anti")


def cascade_delete(children: DataFrame, key: str, deleted: DataFrame, deleted_key: str) -> DataFrame:
    """Children left after their parents were deleted; rows without a reference stay."""
    return children.join(deleted.select(F.col(deleted_key).alias(key)), key, "left_anti")


def cascade_update(children: DataFrame, key: str, renamed: DataFrame, old: str, new: str) -> DataFrame:
    """Children follow a changed parent key; an old key that ``renamed`` lists twice raises."""
    moves = renamed.select(F.col(old).alias(key), F.col(new).alias("_moved")).filter(F.col(key).isNotNull())
    moves = _one_a_key(moves, [key], ["_moved"], "the list of changes")
    return children.join(moves, key, "left").select(*[
        F.coalesce("_moved", key).alias(key) if c == key else F.col(c) for c in children.columns
    ])


def exists_in(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_semi")
