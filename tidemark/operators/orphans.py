"""Mailboxes that one side deleted: what a plan says about them, and whether they are destroyed or come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.reconcile import COLUMNS, PHASES


def roles(plan: DataFrame, cached: DataFrame, orphans: DataFrame) -> DataFrame:
    """plan with orphan and role: blocker if the action brings something into a mailbox of orphans (mailbox_id) or changes what is in it, moot if
    the mailbox's end makes it needless. Of adoptions only those of moved files bring something. An action that goes from one orphan into another counts for the one it goes into."""
    where = cached.select("email_id", F.col("mailbox_id").alias("_home")).dropDuplicates(["email_id"])
    rows = plan.join(where, "email_id", "left")
    o = orphans.select("mailbox_id").distinct()
    rows = rows.join(o.withColumnRenamed("mailbox_id", "_to"), F.col("target") == F.col("_to"), "left").join(o.withColumnRenamed("mailbox_id", "_at"), F.col("_home") == F.col("_at"), "left")
    into = F.col("_to").isNotNull() & (F.col("kind").isin("upload", "move_remote") | (F.col("phase") == PHASES["adopt_moved"]))
    changed = F.col("_at").isNotNull() & (F.col("kind") == "update_remote_flags")
    needless = F.col("_at").isNotNull() & F.col("kind").isin("move_remote", "destroy_remote")
    role = F.when(into | changed, "blocker").when(needless, "moot")
    return rows.select(*COLUMNS, F.when(into, F.col("_to")).when(changed | needless, F.col("_at")).alias("orphan"), role.alias("role"))


def _of(kind: str) -> tuple[Column, Column]:
    return F.lit(PHASES[kind]), F.lit(kind)


def settle_local(plan: DataFrame, cached: DataFrame, orphans: DataFrame, winner: str, files: DataFrame | None = None, largest: int = 0) -> DataFrame:
    """(phase, kind, email_id, maildir_id, source, target) after the mailboxes of orphans, which the server deleted, are settled.

    Without a blocker the folder goes, with its moot actions. With one, if the server wins, its blockers go as well and files moved
    in go back to where they came from, if that is no orphan too; if the local side wins, the mailbox is made anew, and gets the files (as in resurrected) that are in its folder.
    """
    tagged = roles(plan, cached, orphans)
    blocked = tagged.filter("role = 'blocker'").select(F.col("orphan").alias("mailbox_id")).distinct()
    short = ["phase", "kind", "email_id", "maildir_id", "source", "target"]
    null = F.lit(None).cast("string")
    kept = tagged.filter("role IS NULL").select(*short)
    gone = orphans.select("mailbox_id").distinct()
    if winner == "server":
        back = tagged.filter("role = 'blocker' AND kind = 'move_remote'").join(gone.withColumnRenamed("mailbox_id", "source"), "source", "left_anti").select(*_of("move_local"), "email_id", "maildir_id", F.col("target"), F.col("source"))
        return kept.union(back).union(gone.select(*_of("delete_local_folder"), null, null, "mailbox_id", null))
    made = blocked.select(*_of("create_remote_mailbox"), null, null, null, "mailbox_id")
    if files is not None:
        made = made.union(resurrected(blocked, files, largest).filter("kind = 'upload'").select(*_of("upload"), null, "maildir_id", null, "mailbox_id"))
    return kept.union(gone.join(blocked, "mailbox_id", "left_anti").select(*_of("delete_local_folder"), null, null, "mailbox_id", null)).union(made)


def settle_remote(plan: DataFrame, orphans: DataFrame) -> DataFrame:
    """(phase, kind, email_id, maildir_id, source, target) after mailboxes whose folders were deleted here are settled: mails that the server
    moved in from a mailbox that isn't an orphan go back, other actions into them go, and the mailboxes are destroyed."""
    o = orphans.select(F.col("mailbox_id").alias("target"), F.lit(True).alias("_o")).distinct()
    short = ["phase", "kind", "email_id", "maildir_id", "source", "target"]
    rows = plan.select(*short).join(o, "target", "left").select(*short, "_o")
    live = rows.filter("_o AND kind = 'move_local'").join(orphans.select(F.col("mailbox_id").alias("source")), "source", "left_anti")
    back = live.select(*_of("move_remote"), "email_id", "maildir_id", F.col("target"), F.col("source"))
    null = F.lit(None).cast("string")
    return rows.filter("_o IS NULL").select(*short).union(back).union(orphans.select(*_of("destroy_remote_mailbox"), null, null, "mailbox_id", null).distinct())


def resurrected(orphans: DataFrame, files: DataFrame, largest: int) -> DataFrame:
    """(kind, mailbox_id, maildir_id): a mailbox to create for each orphan, and an upload for each of its files within the size limit."""
    o = orphans.select("mailbox_id").distinct()
    uploads = files.filter(F.col("size") <= largest).join(o, "mailbox_id", "left_semi").select(F.lit("upload"), "mailbox_id", "maildir_id")
    return o.select(F.lit("create_remote_mailbox").alias("kind"), "mailbox_id", F.lit(None).cast("string").alias("maildir_id")).union(uploads)


def hoisted(orphans: DataFrame, remote: DataFrame) -> DataFrame:
    """(mailbox_id, live): orphans that hold a mail of the server in this cycle are live again."""
    held = remote.select("mailbox_id", F.lit(True).alias("live")).distinct()
    return orphans.select("mailbox_id").distinct().join(held, "mailbox_id", "left").select("mailbox_id", F.coalesce("live", F.lit(False)).alias("live"))


def hoist(plan: DataFrame, cached: DataFrame, orphans: DataFrame, changed: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan, and the orphans that are left, when mailboxes whose folders were deleted here are live again because the server changed something in them.

    changed: what the server said of this cycle; whole: all that it has (email_id, mailbox_id). A live orphan gets its folder and all its mails again; what
    would be destroyed of it isn't.
    """
    verdicts = hoisted(orphans, changed)
    live = verdicts.filter("live").select("mailbox_id")
    kept = cached.join(live, "mailbox_id", "left_semi").select("email_id", F.lit("destroy_remote").alias("kind")).distinct()
    short = ["phase", "kind", "email_id", "maildir_id", "source", "target"]
    null = F.lit(None).cast("string")
    mails = whole.join(live, "mailbox_id", "left_semi")
    twice = mails.select("email_id", F.lit("download").alias("kind")).distinct()
    out = plan.select(*short).join(kept, ["email_id", "kind"], "left_anti").join(twice, ["email_id", "kind"], "left_anti").select(*short)
    back = live.select(*_of("create_local_mailbox"), null, null, null, "mailbox_id").union(mails.select(*_of("download"), "email_id", null, null, "mailbox_id"))
    return out.union(back), verdicts.filter("NOT live").select("mailbox_id")
