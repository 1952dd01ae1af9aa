"""The store's tables: sentinels, changes by key, validation, references to what is still to be made, state chains, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import first_fault
from tidemark.sources.shared import written

#: Ranges of the order in which rows are numbered on their own.
RANGES = 256


def toml_value(content: Column, key: str) -> Column:
    """The string that a key has in a TOML text of plain lines, its escapes undone; null if there is none."""
    raw = F.regexp_extract(content, rf'(?m)^[ \t]*{key}[ \t]*=[ \t]*"((?:[^"\\\n]|\\.)*)"[ \t]*(?:#.*)?\r?$', 1)
    has = content.rlike(rf'(?m)^[ \t]*{key}[ \t]*=[ \t]*"(?:[^"\\\n]|\\.)*"[ \t]*(?:#.*)?\r?$')
    return F.when(has, F.regexp_replace(raw, r'\\(["\\])', "$1"))


def sentinels(files: DataFrame, content: str = "content") -> DataFrame:
    """(folder, mailbox_id, name, parent_id) of files (folder, content as bytes) that can be trusted: UTF-8, with an id and a name that aren't blank."""
    text = F.try_validate_utf8(F.col(content))
    rows = files.withColumn("_t", text).select("folder", *[toml_value(F.col("_t"), k).alias(k) for k in ("mailbox_id", "name", "parent_id")])
    return rows.filter(first_fault(id=F.col("mailbox_id"), name=F.col("name")).isNull())


def sentinel_map(files: DataFrame, content: str = "content") -> DataFrame:
    """(mailbox_id, folder): where each mailbox's folder is. Of several folders with one id the last in order has it."""
    return sentinels(files, content).groupBy("mailbox_id").agg(F.max("folder").alias("folder"))


def update_by_key(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with the columns that changes (key, some of the columns) has for their key, where those aren't null."""
    columns = [c for c in changes.columns if c != key]
    both = rows.join(changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns]), key, "left")
    return both.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def renamed_folder(rows: DataFrame, old: str, new: str, column: str = "folder") -> DataFrame:
    """rows with one folder's name changed, and its part of the names below it."""
    c = F.col(column)
    return rows.withColumn(column, F.when(c == old, F.lit(new)).when(c.startswith(old + "/"), F.concat(F.lit(new), F.substring(c, F.lit(len(old) + 1), F.length(c)))).otherwise(c))


def without_folders(folders: DataFrame, messages: DataFrame, states: DataFrame, checkpoints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """messages (maildir_id), states (maildir_id, folder) and checkpoints (folder) without what belongs to folders (folder): the three tables of one transaction."""
    gone = folders.select("folder").distinct()
    files = states.join(gone, "folder", "left_semi").select("maildir_id").distinct()
    return messages.join(files, "maildir_id", "left_anti"), states.join(gone, "folder", "left_anti"), checkpoints.join(gone, "folder", "left_anti")


def appended(profile: DataFrame, folder: str) -> DataFrame:
    """Adds the rows of profile to a folder of JSON lines, and returns all that it then has."""
    profile.write.mode("append").json(folder)
    return profile.sparkSession.read.schema(profile.schema).json(folder)


def validated(rows: DataFrame, position: str, *required: str, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """rows with fault (the first required column that is blank; null: valid), and (by, valid, dropped, first_fault): how many of each group, and the fault of its first dropped row."""
    judged = rows.withColumn("fault", first_fault(**{c: F.col(c) for c in required}))
    bad = F.col("fault").isNotNull()
    return judged, judged.groupBy(*by).agg(F.count_if(~bad).alias("valid"), F.count_if(bad).alias("dropped"), F.min_by(F.when(bad, F.col("fault")), F.when(bad, F.col(position))).alias("first_fault"))


def members(values: Column) -> Column:
    """A list's members without the blanks around them, and without empty ones; null stays null."""
    return F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))


def resolved(rows: DataFrame, made: DataFrame, ref: str = "ref") -> DataFrame:
    """rows with target: the id that the creation of their reference (made: ref, id) gave. Rows whose reference wasn't made are left out."""
    return rows.join(made.select(F.col("ref").alias(ref), F.col("id").alias("target")), ref)


def resolved_tree(creations: DataFrame, known: DataFrame) -> DataFrame:
    """(ref, parent_ref, depth) of creations (ref, parent_ref) that can be made, those of depth 0 first: the parent is none, is known (ref), or is made at
    the depth before. What hangs below something that is never made is left out, cycles too."""
    top = creations.join(known.select(F.col("ref").alias("parent_ref"), F.lit(True).alias("_known")), "parent_ref", "left")
    done = written(top.filter(F.col("parent_ref").isNull() | F.col("_known")).select("ref", "parent_ref", F.lit(0).alias("depth")), "made")
    last = done
    while not last.isEmpty():
        below = last.select(F.col("ref").alias("parent_ref"), (F.col("depth") + 1).alias("depth"))
        last = written(creations.join(done.select("ref"), "ref", "left_anti").join(below, "parent_ref").select("ref", "parent_ref", "depth"), "made")
        done = done.union(last)
    return done


def found_by_header(messages: DataFrame, wanted: DataFrame, header: str = "header") -> DataFrame:
    """(message_id, id) of messages (id, header) with a wanted message_id. A server's search by substring finds too much; so each id in a header is taken out and compared whole, in an equi-join."""
    ids = F.regexp_extract_all(F.col(header), F.lit("<([^<>]*)>"), F.lit(1))
    each = messages.filter(F.contains(F.col(header), F.lit("<"))).select("id", F.explode(F.array_distinct(F.transform(ids, lambda x: F.trim(x)))).alias("message_id"))
    return each.join(wanted.select("message_id").distinct(), "message_id").select("message_id", "id")


def walked(cursors: DataFrame, edges: DataFrame, key: str = "account") -> DataFrame:
    """(key, cursor, advanced) of cursors (key, cursor, intact, incomplete) over edges (key, old, new, seq) from state to state.

    incomplete: the pull left something out, and the cursor is held (null). Not intact: a half of the chain is missing, and it stays. Else it goes
    along the edges, the last of those from one state, to where no edge leads on, if that uses every edge once; with cycles, loops and
    edges elsewhere it stays. Each round doubles the steps known from each state, so that n edges take log2 n joins.
    """
    one = edges.groupBy(key, "old").agg(F.max_by("new", "seq").alias("to")).withColumn("n", F.lit(1).cast("long"))
    one = written(one, "steps")
    total = one.groupBy(key).agg(F.count("*").alias("edges"))
    most = total.agg(F.max("edges")).first()[0] or 0
    jump = one
    for _ in range(most.bit_length()):
        then = jump.select(key, F.col("old").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"))
        jump = written(jump.join(then, [key, "to"], "left").select(key, "old", F.coalesce("_to", "to").alias("to"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")), "steps")
    ends = jump.select(key, F.col("old").alias("cursor"), "to", "n")
    rows = cursors.join(ends, [key, "cursor"], "left").join(total, key, "left")
    advanced = F.when(F.col("incomplete"), F.lit(None).cast("string")).when(F.col("intact") & (F.col("n") == F.col("edges")), F.col("to")).otherwise(F.col("cursor"))
    return rows.select(key, "cursor", advanced.alias("advanced"))


def numbered(df: DataFrame, group: str, order: str, value: Column | None = None, name: str = "before") -> DataFrame:
    """df with name: how many rows of the group (or how much of value) come before each in the order of a numeric column.

    The order is cut into RANGES; each range of a group is numbered on its own and the sums of the ranges before it are added, so that no group has
    to go through one task. Rows that share the order's value are numbered one after another in any order.
    """
    value = F.lit(1) if value is None else value
    cuts = sorted(set(df.approxQuantile(order, [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))))
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    df = df.withColumn("_v", value.cast("long")).withColumn("_at", at)
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(F.col(group).alias("_g"), F.col("_at").alias("_k")).agg(F.sum("_v").alias("_s"))
    sums = sums.select("_g", "_k", F.coalesce(F.sum("_s").over(before("_g").orderBy("_k")), F.lit(0)).alias("_s"))
    own = F.coalesce(F.sum("_v").over(before(group, "_at").orderBy(order)), F.lit(0))
    rows = df.withColumn("_own", own)
    return rows.join(sums, rows[group].eqNullSafe(sums["_g"]) & (rows["_at"] == sums["_k"])).withColumn(name, F.col("_own") + F.col("_s")).drop("_v", "_at", "_own", "_g", "_k", "_s")


def scanned(named: DataFrame, files: DataFrame, known: DataFrame) -> DataFrame:
    """(folder, id, kind, subdir, flags) of the messages that events name (folder, id): new, flags or same by the file (folder, id, subdir, flags) that is there, one
    in cur before one in new; deleted if none is and the cache has the message in just this folder (known: folder, id, flags). Other ids say nothing."""
    best = files.groupBy("folder", "id").agg(F.min(F.struct(F.when(F.col("subdir") == "cur", 0).otherwise(1).alias("r"), "subdir", F.col("flags").alias("now"))).alias("f"))
    rows = named.select("folder", "id").distinct().join(best, ["folder", "id"], "left").join(known.select("folder", "id", F.col("flags").alias("old"), F.lit(True).alias("_known")), ["folder", "id"], "left")
    has, was = F.col("f").isNotNull(), F.col("_known").isNotNull()
    kind = F.when(has & ~was, "new").when(has & (F.col("f.now") != F.col("old")), "flags").when(has, "same").when(was, "deleted")
    return rows.select("folder", "id", kind.alias("kind"), F.col("f.subdir").alias("subdir"), F.col("f.now").alias("flags")).filter("kind IS NOT NULL")


def scan_set(bindings: DataFrame, orphans: DataFrame, destructive: bool) -> DataFrame:
    """Folders to scan: those of live mailboxes, and of orphans too where their folders may be deleted."""
    out = bindings.select("folder")
    return out.union(orphans.select("folder")).distinct() if destructive else out.distinct()


def rebuilt(known: DataFrame) -> DataFrame:
    """Mailboxes (mailbox_id, folder, parent_id, total, unread) as the cache alone knows them: without counts."""
    return known.select("mailbox_id", "folder", "parent_id", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("unread"))
