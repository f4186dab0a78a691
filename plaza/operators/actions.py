"""Platform actions as validated changes of state.

Every action names an actor and a target.  It is accepted if its target exists,
if it is not aimed at the actor's own record where that is forbidden, and if it
is the first of its kind by this actor on this target where repeating it
changes nothing; otherwise it is rejected with the first reason that holds.

Defined cases: an action without target is ``missing``; undated actions come
after dated ones, ties go by id; repeated rows of one action are one action; an
empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.lineage import cut
from plaza.operators.skew import collect_hot, lookup_join

LOG = ["action", "id", "actor", "kind", "target", "at", "forbid_own", "once"]


def outcomes(log: DataFrame, known: DataFrame) -> DataFrame:
    """``log`` (LOG) with ``outcome``: ``accepted``, ``missing``, ``own`` or ``repeated``.

    ``known`` is (kind, target, owner), one row per existing target.
    """
    log = cut(log.select(*LOG).dropDuplicates(["action", "id"]), "actions")
    found = lookup_join(log, known.withColumn("found", F.lit(True)), ["kind", "target"], collect_hot(log, ["kind", "target"]), ["action", "id"])
    keys = ["action", "actor", "target"]
    turn = F.struct(F.col("at").isNull().alias("late"), "at", "id")
    first = log.filter("once AND target IS NOT NULL").groupBy(*keys).agg(F.min(turn).alias("first")).select(*keys, F.col("first.id").alias("first_id"))
    found = cut(found, "found")
    both = lookup_join(found, first, keys, collect_hot(found.filter("once"), keys), ["id"])
    reason = (
        F.when(F.col("found").isNull(), "missing").when(F.col("forbid_own") & (F.col("owner") == F.col("actor")), "own").when(F.col("once") & (F.col("first_id") != F.col("id")), "repeated").otherwise("accepted")
    )
    return both.select("action", "id", "actor", "kind", "target", "at", reason.alias("outcome"))


def counters(done: DataFrame, kind: str) -> DataFrame:
    """(target, action, n): accepted actions on each target of one kind."""
    own = done.filter((F.col("kind") == kind) & (F.col("outcome") == "accepted"))
    return own.groupBy("target", "action").agg(F.count(F.lit(1)).alias("n"))
