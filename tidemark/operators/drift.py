"""Differences between folders on disk, in the cache and in the configuration, and what to do about them; rebinding of folders that lost their owner."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import leaves


def drift(disk: DataFrame, known: DataFrame, selected: DataFrame) -> DataFrame:
    """(folder, class) of disk (folder, sentinel) against known (folder, mailbox_id) and selected (mailbox_id).

    rename_in_flight: a folder only on disk whose sentinel names the mailbox of one only in the cache, the smallest such on each
    side; config_dropped: known but no longer selected; disk_only; db_only. A folder has one class; folders in order have none.
    """
    new = disk.join(known, "folder", "left_anti")
    gone = known.join(disk, "folder", "left_anti")
    a = new.filter("sentinel IS NOT NULL").groupBy(F.col("sentinel").alias("mailbox_id")).agg(F.min("folder").alias("to"))
    b = gone.groupBy("mailbox_id").agg(F.min("folder").alias("from"))
    pairs = a.join(b, "mailbox_id")
    flying = pairs.select(F.col("to").alias("folder")).union(pairs.select(F.col("from").alias("folder")))
    dropped = known.join(selected, "mailbox_id", "left_anti").join(flying, "folder", "left_anti").select("folder")
    parts = {
        "rename_in_flight": flying, "config_dropped": dropped, "disk_only": new.join(flying, "folder", "left_anti").select("folder"),
        "db_only": gone.join(flying, "folder", "left_anti").join(dropped, "folder", "left_anti").select("folder"),
    }
    out = None
    for name, df in parts.items():
        df = df.select("folder", F.lit(name).alias("class"))
        out = df if out is None else out.union(df)
    return out


def prune_plan(drifted: DataFrame, files: DataFrame, selected: DataFrame) -> DataFrame:
    """(folder, files, label) of folders to remove: safe, or in need of force because files are left or the configuration names it."""
    n = files.groupBy("folder").agg(F.count("*").alias("files"))
    rows = drifted.select("folder").join(n, "folder", "left").join(selected.select("folder", F.lit(True).alias("_named")), "folder", "left")
    label = F.when(F.coalesce(F.col("_named"), F.lit(False)), "needs force: configured").when(F.coalesce("files", F.lit(0)) > 0, "needs force: not empty").otherwise("safe")
    return rows.select("folder", F.coalesce("files", F.lit(0)).alias("files"), label.alias("label"))


def consensus(samples: DataFrame, memberships: DataFrame) -> DataFrame:
    """(folder, group, boxes) of samples (folder, group, sample, message_id) against memberships (message_id, mailbox_id): mailboxes that every
    matched sample of a group is in. Samples without a match abstain."""
    hits = samples.join(memberships, "message_id").select("folder", "group", "sample", "mailbox_id").distinct()
    votes = hits.groupBy("folder", "group").agg(F.countDistinct("sample").alias("_n"))
    per = hits.groupBy("folder", "group", "mailbox_id").agg(F.countDistinct("sample").alias("_k"))
    return per.join(votes, ["folder", "group"]).filter("_k = _n").groupBy("folder", "group").agg(F.array_sort(F.collect_set("mailbox_id")).alias("boxes"))


def decided(groups: DataFrame) -> DataFrame:
    """(folder, mailbox_id) where all groups of a folder narrow to the same single mailbox; null where they don't."""
    g = groups.groupBy("folder").agg(F.min(F.size("boxes")).alias("a"), F.max(F.size("boxes")).alias("b"), F.min(F.col("boxes")[0]).alias("lo"), F.max(F.col("boxes")[0]).alias("hi"))
    return g.select("folder", F.when((F.col("a") == 1) & (F.col("b") == 1) & (F.col("lo") == F.col("hi")), F.col("lo")).alias("mailbox_id"))


def verdicts(accounts: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, verdict) of accounts (key, root: whether their root is there) against known (key): why an account's folders can't be compared, null if they can."""
    has = known.select(key, F.lit(True).alias("_known")).distinct()
    verdict = F.when(~F.col("root"), "maildir_root_missing").when(F.col("_known").isNull(), "no_mailbox_map")
    return accounts.join(has, key, "left").select(key, verdict.alias("verdict"))


def drift_report(disk: DataFrame, known: DataFrame, selected: DataFrame, root_exists: bool = True) -> DataFrame:
    """drift, or one row (null, class) that says why there is none: the root is missing, or nothing is known of any mailbox."""
    verdict = None if root_exists else "maildir_root_missing"
    if verdict is None and known.isEmpty():
        verdict = "no_mailbox_map"
    if verdict:
        return known.sparkSession.range(1).select(F.lit(None).cast("string").alias("folder"), F.lit(verdict).alias("class"))
    return drift(disk, known, selected)


def narrowed(plan: DataFrame, folder: str | None = None, disk_only: bool | None = None) -> DataFrame:
    """plan (folder, class) for one folder, or one side. A folder that the plan doesn't have is an error."""
    out = plan if folder is None else plan.filter(F.col("folder") == folder)
    if folder is not None and out.isEmpty():
        raise ValueError(f"no such folder in the plan: {folder}")
    return out if disk_only is None else out.filter((F.col("class") == "disk_only") == F.lit(disk_only))


def prune_outcome(plan: DataFrame, known: DataFrame, blocked: DataFrame, force_non_empty: bool = False, force_configured: bool = False) -> DataFrame:
    """(folder, outcome, unmapped) of prune_plan's rows, deepest folders first: removed; skipped, if its label needs a force that isn't given; deferred, if it couldn't
    be removed (blocked: folder). unmapped: a mailbox of known (folder, mailbox_id) went with it."""
    label = F.col("label")
    allowed = (label == "safe") | F.lit(force_non_empty) & (label == "needs force: not empty") | F.lit(force_configured) & (label == "needs force: configured")
    rows = plan.join(blocked.select("folder", F.lit(True).alias("_b")).distinct(), "folder", "left").join(known.select("folder", F.lit(True).alias("_k")).distinct(), "folder", "left")
    outcome = F.when(~allowed, "skipped").when(F.col("_b"), "deferred").otherwise("removed")
    return rows.select("folder", outcome.alias("outcome"), ((outcome == "removed") & F.col("_k").isNotNull()).alias("unmapped")).orderBy(F.col("folder").desc())


def clears_cursor(outcome: DataFrame) -> DataFrame:
    """(clear): whether the cursor of mailboxes must be emptied, as one of them went."""
    return outcome.agg(F.coalesce(F.bool_or("unmapped"), F.lit(False)).alias("clear"))


def cross_mapping(groups: DataFrame, skipped: DataFrame, mailboxes: DataFrame, claimed: DataFrame, folders_on_disk: DataFrame) -> DataFrame:
    """(account, folder, mailbox_id) of folders that their samples leave open, but that can be given out in only one way.

    groups (account, folder, group, boxes); skipped (account, folder, ambiguous); mailboxes, claimed (account, mailbox_id); folders_on_disk (account, folder). An account takes
    part if it has as many mailboxes as folders, all its skipped folders are ambiguous, and as many of them as mailboxes that nobody has. A
    folder can have what all its groups that matched anything agree on and nobody has.
    """
    count = lambda df, name: df.groupBy("account").agg(F.count("*").alias(name))
    free = mailboxes.join(claimed, ["account", "mailbox_id"], "left_anti")
    open_ = skipped.groupBy("account").agg(F.count("*").alias("n_open"), F.bool_and("ambiguous").alias("_all"))
    fit = open_.join(count(mailboxes, "n_boxes"), "account").join(count(folders_on_disk, "n_disk"), "account").join(count(free, "n_free"), "account")
    fit = fit.filter("_all AND n_boxes = n_disk AND n_open = n_free").select("account", "n_open")
    some = groups.filter(F.size("boxes") > 0)
    votes = some.groupBy("account", "folder").agg(F.count("*").alias("_n"))
    each = some.select("account", "folder", "group", F.explode(F.array_distinct("boxes")).alias("mailbox_id")).groupBy("account", "folder", "mailbox_id").agg(F.count("*").alias("_k"))
    feasible = each.join(votes, ["account", "folder"]).filter("_k = _n").join(free, ["account", "mailbox_id"], "left_semi").join(skipped.select("account", "folder"), ["account", "folder"], "left_semi")
    whole = feasible.groupBy("account").agg(F.countDistinct("folder").alias("_f")).join(fit, "account").filter("_f = n_open").select("account")
    return unique_matchings(feasible.join(whole, "account", "left_semi").select("account", "folder", "mailbox_id"))


def _unique(feasible: dict[str, list[str]]) -> dict[str, str] | None:
    """The only way to give each folder a mailbox of its own, or None if there is none or another one.

    One way is found along augmenting paths. There is another if a folder may have a mailbox that is left, or if folders can pass
    their mailboxes on in a ring; without a ring, taking away folders that can take nobody's mailbox leaves none.
    """
    owner: dict[str, str] = {}
    held: dict[str, str] = {}

    def placed(folder: str) -> bool:
        came: dict[str, str] = {}
        waiting = [folder]
        seen = {folder}
        while waiting:
            f = waiting.pop()
            for b in feasible[f]:
                if b in came:
                    continue
                came[b] = f
                if b not in owner:
                    while True:
                        f = came[b]
                        had = held.get(f)
                        owner[b], held[f] = f, b
                        if had is None:
                            return True
                        b = had
                elif owner[b] not in seen:
                    seen.add(owner[b])
                    waiting.append(owner[b])
        return False

    if not all(placed(f) for f in feasible):
        return None
    has = held
    takes = {f: {owner.get(b) for b in feasible[f] if b != has[f]} for f in feasible}
    if any(None in t for t in takes.values()):
        return None
    wanted = {f: set() for f in feasible}
    for f, others in takes.items():
        for g in others:
            wanted[g].add(f)
    ready, left = [f for f, t in takes.items() if not t], len(feasible)
    while ready:
        f = ready.pop()
        left -= 1
        for g in wanted[f]:
            takes[g].discard(f)
            if not takes[g]:
                ready.append(g)
    return has if left == 0 else None


def refused_binds(binds: DataFrame, on_disk: DataFrame, server: DataFrame, claimed: DataFrame) -> DataFrame:
    """(folder, remote_path, mailbox_id, refusal) of explicit binds (folder, remote_path), for the first thing that is wrong with each, null if nothing is.

    'no folder': it isn't on disk (on_disk: folder); 'outside': it leaves the root; 'no mailbox': the server has none at that path (server: mailbox_id, remote_path); 'claimed': the
    mailbox has a folder already in the cache or by a sentinel (claimed: mailbox_id), or another bind names it as well. One refusal refuses the run.
    """
    rows = binds.join(on_disk.select("folder", F.lit(True).alias("_disk")).distinct(), "folder", "left").join(server.select("remote_path", "mailbox_id"), "remote_path", "left")
    rows = rows.join(claimed.select("mailbox_id", F.lit(True).alias("_claimed")).distinct(), "mailbox_id", "left")
    twice = rows.filter("mailbox_id IS NOT NULL").groupBy("mailbox_id").agg((F.count("*") > 1).alias("_twice"))
    rows = rows.join(twice, "mailbox_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    refusal = F.when(leaves(F.col("folder")), "outside").when(~yes("_disk"), "no folder").when(F.col("mailbox_id").isNull(), "no mailbox").when(yes("_claimed") | yes("_twice"), "claimed")
    return rows.select("folder", "remote_path", "mailbox_id", refusal.alias("refusal"))


def unique_matchings(feasible: DataFrame) -> DataFrame:
    """(account, folder, mailbox_id) for accounts of feasible (account, folder, mailbox_id) that have exactly one perfect matching.

    An account's pairs, as many as its mailboxes allow, come together in one row; accounts are dealt over tasks.
    """

    def match(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in groups:
            out = []
            for account, edges in zip(pdf["account"], pdf["edges"], strict=True):
                by: dict[str, list[str]] = {}
                for e in edges:
                    by.setdefault(e["folder"], []).append(e["mailbox_id"])
                out += [(account, f, b) for f, b in sorted((_unique({f: sorted(set(b)) for f, b in by.items()}) or {}).items())]
            yield pd.DataFrame(out, columns=["account", "folder", "mailbox_id"])

    lists = feasible.groupBy("account").agg(F.collect_set(F.struct("folder", "mailbox_id")).alias("edges"))
    return lists.mapInPandas(match, feasible.select("account", "folder", "mailbox_id").schema)
