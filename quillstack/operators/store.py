"""Users and conversations as tables: lookups, upserts, retention, clean-up and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import unused


def lookup(table: DataFrame, most: int | None = None, **equal) -> DataFrame:
    """Rows equal in all given columns; the filter reaches the Parquet scan."""
    for name, value in equal.items():
        table = table.filter(F.col(name) == value)
    return table if most is None else table.limit(most)


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Last writer wins: given (not null) fields of ``changes`` replace those of the row with the key; new keys are added."""
    other = [c for c in table.columns if c != key]
    own, fields = unused(table, "given"), [(F.col(c) if c in changes.columns else F.lit(None).cast(table.schema[c].dataType)).alias(c) for c in other]
    given = changes.select(key, F.struct(F.col(key), *fields).alias(own))
    return table.join(given, key, "full_outer").select(key, *[F.coalesce(F.col(own)[c], F.col(c)).alias(c) for c in other])


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def owned(table: DataFrame, owners: DataFrame, *key: str) -> DataFrame:
    """Rows whose (id, owner) is among the owner's; the others don't exist for them."""
    return table.join(owners.select(*key).distinct(), list(key), "left_semi")


def insert_unique(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Adds the new rows whose key isn't taken; of equal new keys the first by order."""
    n, rank = unused(new, "n"), F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in new.columns if c != key]))
    first = new.withColumn(n, rank).filter(F.col(n) == 1).drop(n)
    return table.unionByName(first.join(table.select(key).distinct(), key, "left_anti"))


def soft_delete(users: DataFrame, ids: DataFrame, key: str, now: Column) -> DataFrame:
    mark = unused(users, "gone")
    gone = ids.select(key).distinct().withColumn(mark, F.lit(True))
    return users.join(gone, key, "left").withColumns({"is_active": F.when(F.col(mark), False).otherwise(F.col("is_active")), "deleted_at": F.when(F.col(mark), now).otherwise(F.col("deleted_at"))}).drop(mark)


def retention(conversations: DataFrame, user: str, at: Column, tie: str, limit: int = 20) -> DataFrame:
    """A user with ``limit`` or more conversations keeps the newest limit - 1 by time.

    Counts are summed before the shuffle; only users over the limit are ranked, and the rank stops at the limit.
    """
    over = conversations.groupBy(user).agg(F.count("*").alias("_n")).filter(F.col("_n") >= limit).select(user)
    rank = F.row_number().over(Window.partitionBy(user).orderBy(F.desc(at), F.desc(tie)))
    r = unused(conversations, "rank")
    full = conversations.join(over, user, "left_semi").withColumn(r, rank).filter(F.col(r) <= limit - 1).drop(r)
    return conversations.join(over, user, "left_anti").unionByName(full)


def create_conversations(conversations: DataFrame, new: DataFrame, user: str, at: Column, tie: str, now: Column, limit: int = 20) -> DataFrame:
    """Adds conversations (``new``: id, user and title), with ``messages`` empty and both times ``now`` where the table has these columns.

    A user's retention runs before each insert, so who had ``limit`` or more keeps limit - 1 and the new one. Users
    without a new conversation keep all. ``now`` isn't before any time of the table; of more than ``limit`` new ones the
    last by ``tie`` stay.
    """
    stamp = {"created_at": now, "updated_at": now, "messages": F.array()}
    fields = {f.name: f.dataType for f in conversations.schema}
    rows = new.select(*[(F.col(c) if c in new.columns else stamp.get(c, F.lit(None))).cast(t).alias(c) for c, t in fields.items()])
    who = new.select(user).distinct()
    theirs = conversations.join(who, user, "left_semi").unionByName(rows)
    return conversations.join(who, user, "left_anti").unionByName(retention(theirs, user, at, tie, limit + 1))


def update_conversations(conversations: DataFrame, changes: DataFrame, key: str, user: str, at: Column, now: Column, limit: int = 20) -> DataFrame:
    """Sets the given (not null) fields of ``changes`` and ``updated_at``, then runs the retention of the users of changed rows.

    Unknown keys change nothing; rows of one key in ``changes`` are distinct. The batch counts as one update.
    """
    known = changes.join(conversations.select(key), key, "left_semi")
    who = conversations.join(known.select(key), key, "left_semi").select(user).distinct()
    done = upsert(conversations, known.withColumn("updated_at", now), key).select(conversations.columns)
    return done.join(who, user, "left_anti").unionByName(retention(done.join(who, user, "left_semi"), user, at, key, limit))


def drop_empty(conversations: DataFrame, messages: DataFrame, key: str) -> DataFrame:
    """Conversations that have a message."""
    return conversations.join(messages.select(key).distinct(), key, "left_semi")


def memory(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", pairs: int = 5) -> DataFrame:
    """The last 2 * pairs messages of each conversation."""
    w = Window.partitionBy(conversation).orderBy(F.desc(turn))
    r = unused(messages, "rank")
    return messages.withColumn(r, F.row_number().over(w)).filter(F.col(r) <= 2 * pairs).drop(r)


def titles(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """First message cut at 50 characters, with dots."""
    first = messages.groupBy(conversation).agg(F.min(F.struct(turn, "text")).alias("m"))
    return first.select(conversation, F.concat(F.substring("m.text", 1, 50), F.lit("...")).alias("title"))


def timestamp(value: Column, now: Column) -> Column:
    """A time from ISO text or epoch seconds; ``now`` for anything else."""
    return F.coalesce(F.try_to_timestamp(value), F.timestamp_seconds(value.try_cast("double")), now)


def newest_first(conversations: DataFrame, user: str, at: str, tie: str) -> DataFrame:
    w = Window.partitionBy(user).orderBy(F.desc(at), F.desc(tie))
    return conversations.withColumn("position", F.row_number().over(w).cast("long"))
