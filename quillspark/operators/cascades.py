"""Deletes that follow declared foreign keys, and tokens that are matched and revoked."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.store import stored


@dataclass(frozen=True)
class Key:
    """A foreign key: ``child.column`` refers to ``parent.of``; ``then`` is what a delete of the parent's row does."""

    child: str
    column: str
    parent: str
    of: str = "id"
    then: str = "cascade"  # or "set null"


#: The library's foreign keys.
LIBRARY_KEYS = (
    Key("pages", "book_id", "books"),
    Key("chunks", "book_id", "books"),
    Key("summaries", "book_id", "books"),
    Key("issues", "page_id", "pages"),
    Key("events", "page_id", "pages"),
    Key("tokens", "user_id", "users"),
    Key("usage", "user_id", "users"),
    Key("evaluations", "user_id", "users", then="set null"),
    Key("contacts", "user_id", "users", then="set null"),
)


def without(tables: dict[str, DataFrame], roots: dict[str, DataFrame], keys: tuple[Key, ...] = LIBRARY_KEYS) -> dict[str, DataFrame]:
    """``tables`` after a delete of the rows that ``roots`` name (by table, distinct values of ``id``).

    Cascades go on from round to round, each from the rows that the round before it added, until one adds none; so cycles
    of keys end. Afterwards a column of a ``set null`` key is null where its parent's row is gone. Keys of tables that
    are not given are left out; null references refer to nothing. Tables keep their columns, and those that nothing
    reaches are given back as they are. Every table that loses rows has a column ``id``, or is no parent.
    """
    keys = tuple(k for k in keys if k.child in tables and k.parent in tables)
    if odd := {k.then for k in keys} - {"cascade", "set null"}:
        raise ValueError(f"unknown actions: {sorted(odd)}")
    named = {name: tables[name].join(ids.select(F.col("id").alias("__root")).distinct(), F.col("id") == F.col("__root"), "left_semi") for name, ids in roots.items()}
    # Rows that are gone, by the value that each key refers to.
    parents = {(k.parent, k.of) for k in keys}
    gone: dict[tuple[str, str], DataFrame] = {}
    lost: dict[str, list[tuple[str, DataFrame]]] = {name: [("id", ids.select(F.col("id").alias("__v")).distinct())] for name, ids in roots.items()}
    fresh = {at: _values(named[at[0]], at[1]) for at in parents if at[0] in named}
    while fresh:
        news: dict[tuple[str, str], list[DataFrame]] = {}
        for at, rows in fresh.items():
            gone[at] = gone[at].unionByName(rows) if at in gone else rows
            for k in keys:
                if (k.parent, k.of) == at and k.then == "cascade":
                    lost.setdefault(k.child, []).append((k.column, rows))
                    hit = tables[k.child].join(rows, F.col(k.column) == F.col("__v"), "left_semi")
                    for own in parents:
                        if own[0] == k.child:
                            news.setdefault(own, []).append(_values(hit, own[1]))
        fresh = {}
        for at, rows in news.items():
            new = reduce(DataFrame.unionByName, rows).distinct()
            new = stored(new.join(gone[at], "__v", "left_anti") if at in gone else new)
            if new.limit(1).count():
                fresh[at] = new
    out = {}
    for name, table in tables.items():
        left = table
        for column, rows in lost.get(name, []):
            left = left.join(rows, F.col(column) == F.col("__v"), "left_anti")
        for k in keys:
            if k.child == name and k.then == "set null" and (k.parent, k.of) in gone:
                hit = gone[k.parent, k.of].distinct()
                left = left.join(hit, F.col(k.column) == F.col("__v"), "left").withColumn(k.column, F.when(F.col("__v").isNull(), F.col(k.column))).drop("__v")
        out[name] = left
    return out


def _values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).alias("__v")).where("__v IS NOT NULL").distinct()


def tokens_presented(tokens: DataFrame, presented: DataFrame, now: Column) -> DataFrame:
    """Valid tokens that ``presented`` (jti, token) match by id and by the digest of the token itself."""
    of = presented.select(F.col("jti").alias("__jti"), F.md5(F.col("token").cast("string")).alias("__hash")).distinct()
    valid = tokens.where(~F.col("revoked") & (F.col("expires_at") > now))
    return valid.join(of, (F.col("jti") == F.col("__jti")) & (F.col("token_hash") == F.col("__hash")), "left_semi")


def tokens_revoked(tokens: DataFrame, jti: DataFrame | None = None, users: DataFrame | None = None) -> DataFrame:
    """Tokens after those of ``jti`` (jti), and all of ``users`` (user_id), are revoked."""
    hit = F.lit(False)
    out = tokens
    for k, (ids, column) in enumerate(((jti, "jti"), (users, "user_id"))):
        if ids is not None:
            out = out.join(ids.select(F.col(column).alias(f"__of{k}")).distinct(), F.col(column) == F.col(f"__of{k}"), "left")
            hit = hit | F.col(f"__of{k}").isNotNull()
    return out.withColumn("revoked", F.col("revoked") | hit).select(*tokens.columns)
