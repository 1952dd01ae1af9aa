"""Mailboxes as a whole: what became of each one's name, and a cycle's plan with all that follows for mailboxes and folders."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import orphans
from tidemark.operators.reconcile import PHASES, Policy, Sides

SHORT = ("phase", "kind", "email_id", "maildir_id", "source", "target")


def decisions(mailboxes: DataFrame, winner: str = "server") -> DataFrame:
    """mailboxes (mailbox_id, cached, server, disk, ruled, decomposes) with decision.

    cached, server and disk are the folder's name there; disk null: no folder's sentinel names the mailbox. ruled: a rename rule made the
    name, so that it can't be read backwards; decomposes: the disk's name has a known parent. What differs on disk alone is the user's
    rename; where the server's differs as well, the policy decides.
    """
    c, s = F.col("cached"), F.col("server")
    d = F.coalesce("disk", "cached")
    decision = (
        F.when(c.isNull(), "first_cycle").when((d == c) & (c == s), "unchanged").when(d == c, "server_rename").when((c != s) & (d == s), "cache_stale")
        .when((c != s) & F.lit(winner == "server"), "conflict_server_wins").when(F.coalesce("ruled", F.lit(False)) | ~F.coalesce("decomposes", F.lit(True)), "unchanged").when(c == s, "local_rename").otherwise("conflict_local_wins")
    )
    return mailboxes.withColumn("decision", decision)


def folder_actions(decided: DataFrame) -> DataFrame:
    """(phase, kind, mailbox_id, source, target, cached) of decisions (and present, sentinel_fits where known): a folder to make, to rename here or
    there. cached is the name that the cache's rows are under. An unchanged mailbox whose folder has no fitting sentinel is made again."""
    fits = F.coalesce("sentinel_fits", F.lit(True)) if "sentinel_fits" in decided.columns else F.lit(True)
    present = F.coalesce("present", F.lit(False)) if "present" in decided.columns else F.lit(False)
    is_ = lambda *names: F.col("decision").isin(*names)
    kind = F.when(is_("first_cycle") | is_("unchanged") & present & ~fits, "create_local_mailbox").when(is_("server_rename", "conflict_server_wins"), "rename_local_mailbox").when(is_("local_rename", "conflict_local_wins"), "rename_remote_mailbox")
    source = F.when(is_("server_rename"), F.col("cached")).when(is_("conflict_server_wins"), F.col("disk")).when(is_("local_rename", "conflict_local_wins"), F.col("cached"))
    target = F.when(is_("local_rename", "conflict_local_wins"), F.col("disk")).otherwise(F.col("server"))
    phase = F.coalesce(*[F.when(kind == k, PHASES[k]) for k in ("create_local_mailbox", "rename_local_mailbox", "rename_remote_mailbox")])
    return decided.select(phase.alias("phase"), kind.alias("kind"), "mailbox_id", source.alias("source"), target.alias("target"), "cached").filter("kind IS NOT NULL")


def slots(decided: DataFrame) -> DataFrame:
    """(mailbox_id, slot): whether a mailbox is made (new), renamed here (pull) or there (push), or only has its cache row brought up to date (metadata); unchanged ones have none."""
    d = F.col("decision")
    slot = F.when(d == "first_cycle", "new").when(d.isin("server_rename", "conflict_server_wins"), "pull").when(d.isin("local_rename", "conflict_local_wins"), "push").when(d == "cache_stale", "metadata").otherwise("none")
    return decided.select("mailbox_id", slot.alias("slot"))


def _alive(sides: Sides, orphans_: DataFrame) -> DataFrame:
    """Mailboxes that take part in a cycle: those that sides has, without the ones that the server deleted."""
    known = sides.live
    if known is None:
        known = sides.remote.select("mailbox_id").union(sides.cached.select("mailbox_id")).union(sides.local.select("mailbox_id")).distinct()
    return known.join(orphans_.select("mailbox_id"), "mailbox_id", "left_anti")


def cycle_plan(sides: Sides, decided: DataFrame, local_orphans: DataFrame, remote_orphans: DataFrame, policy: Policy, whole: DataFrame | None = None) -> DataFrame:
    """The plan of a cycle (SHORT): folders to make and rename; messages; mailboxes that the server deleted (local_orphans: their folders are
    left) and folders that were deleted here (remote_orphans), settled or brought back as the policy says.

    What is in a mailbox that the server deleted is neither moved nor deleted one by one: its folder goes as a whole, or comes back with all files within the size limit.
    whole (email_id, mailbox_id): all that the server has, for a cycle of changes alone; if the server wins, mailboxes of deleted folders in which it changed something come back with it.
    """
    folders = folder_actions(decided).select("phase", "kind", F.lit(None).cast("string").alias("email_id"), F.lit(None).cast("string").alias("maildir_id"), "source", "target")
    sides = dataclasses.replace(sides, policy=policy, live=_alive(sides, local_orphans))
    plan = sides.plan()
    null = F.lit(None).cast("string")
    if policy.deletes in ("local", "both"):
        plan = orphans.settle_local(plan, sides.cached, local_orphans, policy.winner, sides.local, policy.largest)
    else:
        lost = local_orphans.select(F.col("mailbox_id").alias("l_box"))
        again = sides.local.join(lost, F.col("mailbox_id") == F.col("l_box"), "left_semi").select("maildir_id", F.lit("upload").alias("kind"))
        back = orphans.resurrected(local_orphans, sides.local, policy.largest)
        phase = F.when(F.col("kind") == "upload", PHASES["upload"]).otherwise(PHASES["create_remote_mailbox"])
        plan = plan.join(again, ["maildir_id", "kind"], "left_anti").select(*SHORT).union(back.select(phase, "kind", null, "maildir_id", null, "mailbox_id"))
    if policy.deletes in ("remote", "both"):
        if whole is not None and policy.winner == "server":
            plan, remote_orphans = orphans.hoist(plan, sides.cached, remote_orphans, sides.remote, whole)
        plan = orphans.settle_remote(plan, remote_orphans)
    return folders.union(plan.select(*SHORT))
