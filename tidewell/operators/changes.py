"""Changes to tables as new snapshots: upserts, first inserts, reviews, deletions that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` in place of its rows of the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def inserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` and those ``rows`` whose key it lacks; deleted rows keep their key, so they don't come back."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def reviewed(samples: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """``samples`` (status, split, new_split, has_answer) after ``actions`` (approve, reject, reset, delete).

    An approval needs an answer and gives a split once; all others take it away. Deleted samples don't change.
    """
    rows = samples.join(actions, key, "left")
    open_ = F.col("status") != "deleted"
    approve = (F.col("action") == "approve") & F.col("has_answer") & open_
    other = F.when(F.col("action") == "reject", "rejected").when(F.col("action") == "reset", "pending").when(F.col("action") == "delete", "deleted")
    status = F.when(approve, "approved").when(open_ & other.isNotNull(), other).otherwise(F.col("status"))
    split = F.when(approve, F.coalesce("split", "new_split")).when(open_ & other.isNotNull(), None).otherwise(F.col("split"))
    return rows.withColumns({"split": split, "status": status}).drop("action")


def filled(rows: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` whose empty or null ``columns`` take the value of the row of ``other`` with the same key."""
    joined = rows.alias("a").join(other.select(key, *(F.col(c).alias(f"_{c}") for c in columns)), key, "left")
    return joined.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) for c in columns}).drop(*(f"_{c}" for c in columns))


def merged(requests: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``requests`` (source, status, split, answer, origin_id) after ``incoming`` (source, answer, origin_id), one row per key.

    An incoming row takes over source, answer and origin; a reviewed request whose answer changes waits for review again,
    without a split. Deleted requests stay as they are, and incoming rows without an open request become new, pending ones.
    """
    new = incoming.select(key, *(F.col(c).alias(f"_{c}") for c in ("source", "answer", "origin_id")), F.lit(True).alias("_in"))
    rows = requests.join(new, key, "full")
    open_ = F.col("_in") & F.col("status").isNotNull() & (F.col("status") != "deleted")
    fresh = F.col("_in") & F.col("status").isNull()
    again = open_ & ~F.col("answer").eqNullSafe(F.col("_answer")) & (F.col("status") != "pending")
    take = F.coalesce(open_ | fresh, F.lit(False))
    out = {c: F.when(take, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("source", "answer", "origin_id")}
    out["split"] = F.when(again, None).otherwise(F.col("split"))
    out["status"] = F.when(again | fresh, "pending").otherwise(F.col("status"))
    return rows.withColumns(out).drop("_source", "_answer", "_origin_id", "_in")


def bulk_outcomes(ids: DataFrame, samples: DataFrame, key: str, action: str) -> DataFrame:
    """``key, outcome`` of a review of many: done, or why a row is skipped (missing, deleted, no_answer)."""
    rows = ids.join(samples.select(key, "status", "has_answer"), key, "left")
    reason = F.when(F.col("status").isNull(), "missing").when(F.col("status") == "deleted", "deleted").when(F.lit(action == "approve") & ~F.col("has_answer"), "no_answer").otherwise("done")
    return rows.select(key, reason.alias("outcome"))


def buried(samples: DataFrame, gone: DataFrame, key: str, content: list[str]) -> DataFrame:
    """``samples`` with those of ``gone`` deleted: the row stays, so that it isn't made again, but its ``content`` is null."""
    rows = samples.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    out = {c: F.when(F.col("_gone"), None).otherwise(F.col(c)) for c in content}
    return rows.withColumns(out | {"status": F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))}).drop("_gone")


def without_user(owned: DataFrame, linked: DataFrame, users: DataFrame, user: str) -> tuple[DataFrame, DataFrame]:
    """What is left once ``users`` go: ``owned`` rows without theirs, ``linked`` rows all, theirs with a null user."""
    gone = users.select(user).distinct()
    marked = linked.join(gone.withColumn("_gone", F.lit(True)), user, "left")
    return owned.join(gone, user, "left_anti"), marked.withColumn(user, F.when(F.col("_gone").isNull(), F.col(user))).drop("_gone")


def replaced_active(codes: DataFrame, new: DataFrame, by: list[str], used: str, at) -> DataFrame:
    """``codes`` and ``new`` ones: an open code (null ``used``) of the same ``by`` ends at ``at`` first."""
    rows = codes.join(new.select(*by).distinct().withColumn("_new", F.lit(True)), by, "left")
    ended = F.when(F.col("_new") & F.col(used).isNull(), at).otherwise(F.col(used))
    return rows.withColumn(used, ended).drop("_new").unionByName(new, allowMissingColumns=True)


def unpathed(rows: DataFrame, names: DataFrame, path: str, name: str) -> DataFrame:
    """``rows`` whose ``path`` is null where its last part is one of ``names``."""
    last = F.element_at(F.split(F.col(path), "/"), -1)
    marked = rows.withColumn("_last", last).join(names.select(F.col(name).alias("_last")).distinct().withColumn("_gone", F.lit(True)), "_last", "left")
    return marked.withColumn(path, F.when(F.col("_gone").isNull(), F.col(path))).drop("_last", "_gone")
