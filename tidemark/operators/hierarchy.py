"""Folder trees: paths over parents, encodings into folder names, selections, renames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import is_private, name_fault, segment_fault
from tidemark.sources.shared import written

#: Fixed value: a path has this many parents at most; what lies beyond is left out.
MAX_DEPTH = 64


def paths(tree: DataFrame) -> DataFrame:
    """(id, path, depth, ids) of each node of (id, name, parent_id): names and ids from the root on, depth 0 at a root.

    Each round doubles the stretch of parents that is known, so that a tree of depth n takes log2 n joins. A chain
    ends at a parent that is missing, and at MAX_DEPTH, where cycles end too. Each round is written, so that none is done again.
    """
    cur = tree.select("id", F.array("name").alias("names"), F.array("id").alias("ids"), F.col("parent_id").alias("up"))
    open_ = F.col("up").isNotNull() & (F.size("names") < MAX_DEPTH)
    while not (cur := written(cur, "paths")).filter(open_).isEmpty():
        above = cur.select(F.col("id").alias("up"), F.col("names").alias("n2"), F.col("ids").alias("i2"), F.col("up").alias("u2"))
        cur = cur.join(above, "up", "left").select(
            "id",
            F.when(F.col("n2").isNull(), F.col("names")).otherwise(F.concat("n2", "names")).alias("names"),
            F.when(F.col("i2").isNull(), F.col("ids")).otherwise(F.concat("i2", "ids")).alias("ids"),
            F.col("u2").alias("up"),
        )
    last = lambda c: F.slice(c, -F.least(F.size(c), F.lit(MAX_DEPTH)), MAX_DEPTH)
    return cur.select("id", F.array_join(last("names"), "/").alias("path"), (F.size(last("names")) - 1).alias("depth"), last("ids").alias("ids"))


def encoded(path: Column, layout: str, separator: str = ".") -> Column:
    """The folder of a path: 'fs' keeps it, 'flat' joins with the separator, 'maildir++' also begins with a dot; INBOX is the root ('.' in maildir++)."""
    if layout == "fs":
        return path
    joined = F.replace(path, F.lit("/"), F.lit(separator))
    if layout == "flat":
        return joined
    inner = F.when(path.startswith("INBOX/"), F.substring(joined, F.lit(len("INBOX") + 1), F.length(joined))).otherwise(F.concat(F.lit("."), joined))
    return F.when(path == "INBOX", F.lit(".")).otherwise(inner)


def folder_fault(path: Column, layout: str, separator: str = ".", cap: int = 255) -> Column:
    """Why a path has no folder in a layout: the fault of its first faulty segment, or a folder of more than cap bytes (in fs: a segment); null if it has."""
    faults = F.filter(F.transform(F.split(path, "/"), lambda x: F.coalesce(name_fault(x), segment_fault(x, layout, separator))), lambda x: x.isNotNull())
    length = F.array_max(F.transform(F.split(path, "/"), F.octet_length)) if layout == "fs" else F.octet_length(encoded(path, layout, separator))
    return F.coalesce(F.get(faults, F.lit(0)), F.when(length > cap, "too long"))


def decoded(folder: Column, separator: str = ".", layout: str = "flat") -> tuple[Column, Column]:
    """(leaf, parent) of a folder; the parent is null at the top. In maildir++ a leading dot is no segment, and parents have it again; fs is split at slashes."""
    separator = "/" if layout == "fs" else separator
    name = F.regexp_replace(folder, r"^\.", "") if layout == "maildir++" else folder
    parts = F.split(name, "\\Q" + separator + "\\E")
    above = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), separator)
    parent = F.when(F.size(parts) > 1, F.concat(F.lit("."), above) if layout == "maildir++" else above)
    return F.element_at(parts, -1), parent


def with_parents(folders: DataFrame, known: DataFrame, layout: str, separator: str = ".") -> DataFrame:
    """folders (folder) with leaf, parent, parent_id and fault: the id of the parent among known (folder, mailbox_id); a parent that isn't known is a fault."""
    leaf, parent = decoded(F.col("folder"), separator, layout)
    ids = known.select(F.col("folder").alias("parent"), F.col("mailbox_id").alias("parent_id"))
    rows = folders.withColumn("leaf", leaf).withColumn("parent", parent).join(ids, "parent", "left")
    return rows.withColumn("fault", F.when(F.col("parent").isNotNull() & F.col("parent_id").isNull(), "unknown parent"))


def eligible(folder: Column, layout: str) -> Column:
    """Whether a folder below the root can be a mailbox's: one name in flat, one with a leading dot in maildir++, any depth in fs; never a private one."""
    if layout == "fs":
        return (folder != "") & ~F.exists(F.split(folder, "/"), lambda x: is_private(x))
    plain = (folder != "") & ~F.contains(folder, F.lit("/")) & ~is_private(folder)
    return plain & folder.startswith(".") if layout == "maildir++" else plain


def unbound(folders: DataFrame, bound: DataFrame, layout: str) -> DataFrame:
    """Folders (folder) that the layout allows and that no mailbox has, each once."""
    return folders.select("folder").distinct().filter(eligible(F.col("folder"), layout)).join(bound.select("folder"), "folder", "left_anti")


def select_subtrees(rows: DataFrame, path: str, ancestors: Sequence[str]) -> DataFrame:
    """Rows at one of the paths or below it. Each row's own ancestors meet the selection in an equi-join, so that no row is compared with all of it."""
    chosen = F.broadcast(rows.sparkSession.createDataFrame([(a,) for a in sorted(set(ancestors))], "_a string"))
    parts = F.split(path, "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hit = rows.select(F.col(path).alias("_p"), F.explode(ups).alias("_a")).join(chosen, "_a").select("_p").distinct()
    return rows.join(hit, rows[path] == hit["_p"], "left_semi")


def renamed(path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The path after the first rule that fits, null if none does. A rule is ('exact', from, to) or ('regex', pattern, replacement with $1)."""
    out = [F.when(path == a, F.lit(b)) if kind == "exact" else F.when(path.rlike(a), F.regexp_replace(path, a, b)) for kind, a, b in rules]
    return F.coalesce(*out, F.lit(None).cast("string"))


def creation_chain(folders: DataFrame, bound: DataFrame, separator: str = "/") -> DataFrame:
    """(folder, depth) to be created so that each folder has its parents: those of its ancestors and itself that aren't bound, each once."""
    parts = F.split("folder", "\\Q" + separator + "\\E")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), separator).alias("folder"), n.alias("depth")))
    return folders.select(F.explode(ups).alias("u")).select("u.folder", "u.depth").distinct().join(bound.select("folder"), "folder", "left_anti")


def listed_or_reused(accounts: DataFrame, pages: DataFrame, server: DataFrame, cached: DataFrame, key: str = "account") -> DataFrame:
    """Mailboxes (key, mailbox_id, folder, parent_id, total, unread, reused) of accounts (key, cursor): the cache's, without counts, where nothing but counts changed since the cursor; else the server's.

    pages (key, n, structural, failed): change pages after the cursor in order, up to the last. An account without a cursor, with a structural page, or whose server can't say what changed, is listed anew.
    """
    changed = pages.groupBy(key).agg(F.bool_or(F.col("structural") | F.col("failed")).alias("_changed"))
    choice = accounts.join(changed, key, "left").select(key, (F.col("cursor").isNotNull() & ~F.coalesce("_changed", F.lit(False))).alias("reused"))
    columns = (key, "mailbox_id", "folder", "parent_id")
    old = cached.join(choice.filter("reused"), key).select(*columns, F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("unread"), "reused")
    return old.unionByName(server.join(choice.filter("NOT reused"), key).select(*columns, "total", "unread", "reused"))


def named(mailboxes: DataFrame, names: DataFrame) -> DataFrame:
    """mailboxes (id, path, role) that names (name, any_case) choose: by their whole path, A to Z in any case where that is asked for; INBOX also chooses the one with that role. Without names all are chosen."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    if names.isEmpty():
        return mailboxes
    keys = names.select(F.when(F.col("any_case"), fold("name")).otherwise(F.col("name")).alias("_name"), F.col("any_case").alias("_any")).distinct()
    inbox = names.filter(F.when(F.col("any_case"), F.upper("name")).otherwise(F.col("name")) == "INBOX").select(F.lit("inbox").alias("role")).distinct()
    plain = mailboxes.join(keys.filter("NOT _any"), F.col("path") == F.col("_name"), "left_semi")
    loose = mailboxes.join(keys.filter("_any"), fold("path") == F.col("_name"), "left_semi")
    return plain.union(loose).union(mailboxes.join(inbox, "role", "left_semi").select(*mailboxes.columns)).distinct()
