"""Rows of tables with any columns: free names, hashes of whole rows, bounded samples, and joins that hot keys don't hold up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key that more than one in so many rows holds is joined by a broadcast; there are at most so many of these keys.
HOT_SHARE = 4096
_STEPS = 1 << 30


def free(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df does not have yet."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return all(_hashable(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else True


def row_hash(df: DataFrame) -> Column:
    """64 bits of all columns, so that rows with one hash can stand for each other; maps are hashed by their JSON."""
    names = [(F.col(f"`{f.name}`"), f) for f in df.schema.fields]
    return F.xxhash64(*[c if _hashable(f.dataType) else F.to_json(F.struct(c)) for c, f in names])


def sampled(df: DataFrame, key: Column, total: int, most: int) -> DataFrame:
    """About `most` rows by hashes of their keys; all of a table that is no larger."""
    if total <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(key), F.lit(_STEPS)) < int(_STEPS * (most / total)))


def attach(rows: DataFrame, named: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined to the row of `named` that has their key, as an inner join; column n of `named` counts the rows of a key.

    Keys of more than total / HOT_SHARE rows are fewer than HOT_SHARE, so they are broadcast; each other key is a small part
    of the rows and is shuffled. Keys must not be null.
    """
    hot = F.col(n) * F.lit(HOT_SHARE) > F.lit(total)
    often, seldom = named.filter(hot), named.filter(~hot)
    mark = free(rows, "__hot")[0]
    marked = rows.join(F.broadcast(often.select(F.col(key), F.lit(True).alias(mark))), key, "left")
    many = rows.join(F.broadcast(often), key)
    few = marked.filter(F.col(mark).isNull()).drop(mark).join(seldom, key)
    return many.unionByName(few)
