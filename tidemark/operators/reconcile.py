"""Three-way reconciliation of a remote, a cached and a local view of messages into a plan of actions.

The three views meet once, in two full outer joins; what was found of each message is a table, from which every stage is a filter.
Only what changed is matched by message id. Where several rows would do, the smallest id wins. Rows:
remote (email_id, message_id, mailbox_id, flags, size), cached (email_id, message_id, mailbox_id, maildir_id, flags),
local (maildir_id, message_id, mailbox_id, flags, size). A plan has (phase, kind, email_id, maildir_id, source, target, flags).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import keywords_of
from tidemark.sources.shared import written

#: The order in which kinds of actions are carried out; adoptions of moved files wait for the server's answer.
PHASES = {
    "create_local_mailbox": 1, "rename_local_mailbox": 2, "adopt": 3, "download": 4, "update_local_flags": 5, "move_local": 6, "delete_local": 7, "delete_local_folder": 8,
    "create_remote_mailbox": 9, "rename_remote_mailbox": 10, "upload": 11, "update_remote_flags": 12, "move_remote": 13, "destroy_remote": 14, "destroy_remote_mailbox": 15, "adopt_moved": 16,
}
COLUMNS = ("phase", "kind", "email_id", "maildir_id", "source", "target", "flags")


@dataclass(frozen=True)
class Policy:
    """Who wins a conflict ('server' or 'local'), whether remote has all messages, the largest upload, and which deleted
    mailboxes the other side deletes as well ('none', 'local', 'remote' or 'both': folders here, mailboxes there)."""

    winner: str = "server"
    full: bool = True
    largest: int = 100 * 1024 * 1024
    deletes: str = "none"


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def act(kind: str, email: str | Column | None = None, maildir: str | Column | None = None, source: str | Column | None = None, target: str | Column | None = None, flags: str | Column | None = None) -> Column:
    """An action as a struct of COLUMNS. Kind adopt_moved is an adoption in a later phase."""
    of = lambda c: _null() if c is None else F.col(c) if isinstance(c, str) else c
    return F.struct(F.lit(PHASES[kind]).alias("phase"), F.lit("adopt" if kind == "adopt_moved" else kind).alias("kind"), *[of(c).alias(n) for n, c in zip(COLUMNS[2:], (email, maildir, source, target, flags), strict=True)])


def acts(df: DataFrame, *actions: tuple[Column, Column]) -> DataFrame:
    """A plan of the actions (condition, action) that hold for each row of df, in one pass."""
    found = F.array_compact(F.array(*[F.when(when, action) for when, action in actions]))
    return df.select(F.explode(found).alias("_a")).select("_a.*")


def first_of(df: DataFrame, keys: list[str], by: str, *columns: str) -> DataFrame:
    """(keys, x) with the struct x of columns of the row with the smallest by: an aggregate, so that no group is in one place."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), by).alias("x"))


def local_changes(local: DataFrame, cached: DataFrame) -> DataFrame:
    """(kind, maildir_id, message_id, mailbox_id, old_flags, new_flags, size): new, flags or deleted; equal files say nothing.

    A file that is known from another mailbox is new where it is; files without a message id have no anchor and are left out as new ones.
    """
    known = cached.filter("maildir_id IS NOT NULL").select("maildir_id", F.col("message_id").alias("_mid"), F.col("mailbox_id").alias("_box"), F.col("flags").alias("old_flags"), F.lit(True).alias("_known"))
    here = local.select("maildir_id", "message_id", "mailbox_id", F.col("flags").alias("new_flags"), "size", F.lit(True).alias("_here"))
    both = here.join(known, "maildir_id", "full")
    same = F.coalesce(F.col("_box") == F.col("mailbox_id"), F.lit(False))
    kind = F.when(F.col("_here").isNull(), "deleted").when(~same & F.col("message_id").isNotNull(), "new").when(same & (F.col("old_flags") != F.col("new_flags")), "flags")
    gone = kind == "deleted"
    return both.select(
        kind.alias("kind"), "maildir_id", F.when(gone, F.col("_mid")).otherwise(F.col("message_id")).alias("message_id"), F.when(gone, F.col("_box")).otherwise(F.col("mailbox_id")).alias("mailbox_id"),
        F.when(kind != "new", F.col("old_flags")).alias("old_flags"), "new_flags", "size",
    ).filter("kind IS NOT NULL")


@dataclass
class Sides:
    """The three views, and what follows from them for all stages.

    live (mailbox_id): mailboxes that take part; None: all. destroyed_ids (email_id): what the server said is gone, where remote hasn't all messages.
    """

    remote: DataFrame
    cached: DataFrame
    local: DataFrame
    policy: Policy
    live: DataFrame | None = None
    destroyed_ids: DataFrame | None = None

    @functools.cached_property
    def messages(self) -> DataFrame:
        """A row for each message or file, with what each view has of it (r_, c_, l_) and what that means.

        dead: destroyed on the server; file_gone: its file is; reflagged: its file's flags changed; fresh: a file that is new where it is.
        """
        pick = lambda df, p, *names: df.select(F.lit(True).alias(p), *[F.col(a).alias(b) for a, b in names])
        r = pick(self.remote, "r", ("email_id", "email_id"), ("message_id", "r_mid"), ("mailbox_id", "r_box"), ("flags", "r_flags"))
        c = pick(self.cached, "c", ("email_id", "email_id"), ("message_id", "c_mid"), ("mailbox_id", "c_box"), ("maildir_id", "maildir_id"), ("flags", "c_flags"))
        f = pick(self.local, "l", ("maildir_id", "maildir_id"), ("message_id", "l_mid"), ("mailbox_id", "l_box"), ("flags", "l_flags"), ("size", "size"))
        rows = c.join(r, "email_id", "full")
        if self.policy.full:
            rows = rows.withColumn("dead", F.col("c").isNotNull() & F.col("r").isNull())
        elif self.destroyed_ids is not None:
            rows = rows.join(self.destroyed_ids.select("email_id", F.lit(True).alias("_d")).distinct(), "email_id", "left").withColumn("dead", F.col("c").isNotNull() & F.col("_d").isNotNull()).drop("_d")
        else:
            rows = rows.withColumn("dead", F.lit(False))
        rows = rows.join(f, "maildir_id", "full")
        for p in ("r", "c"):
            if self.live is None:
                rows = rows.withColumn(f"{p}_live", F.lit(True))
            else:
                rows = rows.join(self.live.select(F.col("mailbox_id").alias(f"{p}_box"), F.lit(True).alias(f"{p}_live")).distinct(), f"{p}_box", "left")
        has = {p: F.coalesce(p, F.lit(False)) for p in ("r", "c", "l", "r_live", "c_live", "dead")}
        rows = rows.select("email_id", "maildir_id", "r_mid", "r_box", "r_flags", "c_mid", "c_box", "c_flags", "l_mid", "l_box", "l_flags", "size", *[v.alias(k) for k, v in has.items()])
        same = F.coalesce(F.col("c_box") == F.col("l_box"), F.lit(False))
        rows = rows.withColumn("file_gone", F.col("c") & ~F.col("l") & F.col("maildir_id").isNotNull())
        rows = rows.withColumn("reflagged", F.col("l") & same & F.coalesce(F.col("c_flags") != F.col("l_flags"), F.lit(False)))
        return written(rows.withColumn("fresh", F.col("l") & ~same & F.col("l_mid").isNotNull()), "messages")

    @property
    def changes(self) -> DataFrame:
        return local_changes(self.local, self.cached)

    def _known(self) -> DataFrame:
        return self.messages.filter("r AND c AND r_live")

    @property
    def known(self) -> DataFrame:
        """Messages of the server that the cache has: its row, and old_box, maildir_id and old_flags of the cache's."""
        return self._known().select("email_id", F.col("r_mid").alias("message_id"), F.col("r_box").alias("mailbox_id"), F.col("r_flags").alias("flags"), F.col("c_box").alias("old_box"), "maildir_id", F.col("c_flags").alias("old_flags"))

    @property
    def unknown(self) -> DataFrame:
        return self.messages.filter("r AND NOT c").select("email_id", F.col("r_mid").alias("message_id"), F.col("r_box").alias("mailbox_id"), F.col("r_flags").alias("flags"))

    @property
    def destroyed(self) -> DataFrame:
        return self.messages.filter("dead").select("email_id", F.col("c_mid").alias("message_id"), F.col("c_box").alias("mailbox_id"), "maildir_id", F.col("c_flags").alias("flags"))

    @property
    def flagged(self) -> DataFrame:
        return self.messages.filter("reflagged").select("email_id", "maildir_id", F.col("l_flags").alias("new_flags"))

    @property
    def server_flags(self) -> DataFrame:
        return self.known.filter("flags <> old_flags")

    @functools.cached_property
    def _moves(self) -> DataFrame:
        new = first_of(self.messages.filter("fresh"), ["l_mid"], "maildir_id", "maildir_id", "l_box", "l_flags").withColumnRenamed("x", "n")
        gone = first_of(self.messages.filter("file_gone AND NOT dead AND c_mid IS NOT NULL"), ["c_mid"], "email_id", "email_id", "c_box", "c_flags").withColumnRenamed("x", "g")
        both = gone.join(new, F.col("c_mid") == F.col("l_mid")).filter("g.c_box <> n.l_box")
        return written(both.select("g.email_id", "n.maildir_id", F.col("g.c_box").alias("from_box"), F.col("n.l_box").alias("to_box"), F.col("g.c_flags").alias("old_flags"), F.col("n.l_flags").alias("flags")), "moves")

    def moves(self) -> DataFrame:
        """(email_id, maildir_id, from_box, to_box, old_flags, flags): a gone file whose message is new in another mailbox. Each side takes part once."""
        return self._moves

    def _new_files(self) -> DataFrame:
        return self.messages.filter("fresh").select("maildir_id", "l_mid", "l_box", "l_flags", "size").join(self.moves().select("maildir_id"), "maildir_id", "left_anti")

    @functools.cached_property
    def _arrivals(self) -> DataFrame:
        mails = self.messages.filter("r AND NOT c AND r_live AND r_mid IS NOT NULL").select("email_id", F.col("r_mid").alias("mid"), F.col("r_box").alias("box"), F.col("r_flags").alias("flags"))
        file_flags = F.coalesce("l_flags", "c_flags").alias("had")
        bound = self.messages.filter("c AND maildir_id IS NOT NULL").select(F.col("c_mid").alias("mid"), F.col("c_box").alias("box"), F.col("email_id").alias("old"), F.col("maildir_id").alias("file"), file_flags, "dead")
        bound = first_of(bound, ["mid", "box"], "old", "old", "file", "had", "dead").withColumnRenamed("x", "b")
        files = first_of(self._new_files().select(F.col("l_mid").alias("mid"), F.col("l_box").alias("box"), "maildir_id", "l_flags"), ["mid", "box"], "maildir_id", "maildir_id", "l_flags").withColumnRenamed("x", "f")
        first = mails.groupBy("mid", "box").agg(F.min("email_id").alias("first"))
        rows = mails.join(first, ["mid", "box"]).join(bound, ["mid", "box"], "left").join(files, ["mid", "box"], "left")
        b, f = F.col("b").isNotNull(), F.col("f").isNotNull()
        fate = F.when(b & ~F.col("b.dead"), "alive").when((b | f) & (F.col("email_id") != F.col("first")), "claimed").when(b, "rebind").when(f, "adopt").otherwise("download")
        took = fate.isin("rebind", "adopt")
        return written(rows.select(
            "email_id", F.col("mid").alias("message_id"), F.col("box").alias("mailbox_id"), "flags", fate.alias("fate"),
            F.when(took, F.coalesce("b.file", "f.maildir_id")).alias("maildir_id"), F.when(took, F.when(b, F.col("b.had")).otherwise(F.col("f.l_flags"))).alias("file_flags"), F.when(fate == "rebind", F.col("b.old")).alias("old_email"),
        ), "arrivals")

    def arrivals(self) -> DataFrame:
        """(email_id, message_id, mailbox_id, flags, fate, maildir_id, file_flags, old_email) of messages that the cache doesn't know.

        rebind: the cache has the message in that mailbox under an id that is destroyed, and its file goes to the new id; alive: that id
        is alive or may be, so that this is a duplicate; adopt: a new file there has the message; claimed: another id got that file;
        download: nothing of it is here. Messages without a message id have no anchor and no row.
        """
        return self._arrivals

    def adoptions(self) -> DataFrame:
        """(email_id, maildir_id, mailbox_id, flags, file_flags): new messages of the server whose file is here, one to one by smallest ids."""
        return self.arrivals().filter("fate IN ('adopt', 'rebind')").select("email_id", "maildir_id", "mailbox_id", "flags", "file_flags")

    @functools.cached_property
    def _new(self) -> DataFrame:
        files = self._new_files().join(self.arrivals().filter("fate = 'adopt'").select("maildir_id"), "maildir_id", "left_anti").withColumnsRenamed({"l_mid": "mid", "l_box": "box"})
        rows = self.messages.filter("c").select(F.col("c_mid").alias("mid"), F.col("c_box").alias("box"), "email_id", "c_flags", "maildir_id")
        known = first_of(rows, ["mid", "box"], "email_id", "email_id", "c_flags").withColumnRenamed("x", "k")
        other = rows.filter("maildir_id IS NOT NULL").groupBy("mid").agg(F.min("email_id").alias("other"))
        first = files.groupBy("mid", "box").agg(F.min("maildir_id").alias("first"))
        both = files.join(first, ["mid", "box"]).join(known, ["mid", "box"], "left").join(other, "mid", "left")
        k = F.col("k").isNotNull()
        fate = F.when(k & (F.col("maildir_id") == F.col("first")), "adopt").when(k, "claimed").when(F.col("other").isNotNull(), "elsewhere").when(F.col("size") > self.policy.largest, "too large").otherwise("upload")
        return written(both.select("maildir_id", F.col("mid").alias("message_id"), F.col("box").alias("mailbox_id"), F.col("l_flags").alias("file_flags"), fate.alias("fate"), F.when(fate == "adopt", F.col("k.email_id")).alias("email_id"), F.col("k.c_flags").alias("flags")), "new-files")

    def new_files(self) -> DataFrame:
        """(maildir_id, message_id, mailbox_id, file_flags, fate, email_id, flags) of new files that are no moves and no arrival's.

        adopt: the cache has the message in that mailbox, and the file becomes its; claimed: another file became that; elsewhere: a
        message of another mailbox has a file with that id; too large; upload.
        """
        return self._new

    def _left(self) -> DataFrame:
        """Messages whose files were deleted here, but for moves and files that came again."""
        gone = self.messages.filter("file_gone AND NOT dead").join(self.moves().select("email_id"), "email_id", "left_anti")
        return gone.join(self.new_files().filter("fate = 'adopt'").select("email_id"), "email_id", "left_anti")

    #: Whether the server changed a message that both have.
    _CHANGED = "r AND r_live AND (r_flags <> c_flags OR r_box <> c_box)"

    def delete_conflicts(self) -> DataFrame:
        """Files deleted here whose message the server changed (flags or mailbox)."""
        rows = self._left().filter(self._CHANGED)
        return rows.select("email_id", F.col("r_mid").alias("message_id"), F.col("r_box").alias("mailbox_id"), F.col("r_flags").alias("flags"), F.col("c_box").alias("old_box"), "maildir_id", F.col("c_flags").alias("old_flags"))

    def _server_wins(self) -> Column:
        return F.lit(self.policy.winner == "server")

    def _adopted_flags(self, rows: DataFrame) -> DataFrame:
        """What brings the flags of an adopted file and of its message together."""
        differ = F.coalesce(F.col("flags") != F.col("file_flags"), F.lit(False))
        return acts(rows, (differ & self._server_wins(), act("update_local_flags", "email_id", "maildir_id", flags="flags")), (differ & ~self._server_wins(), act("update_remote_flags", "email_id", "maildir_id", flags="file_flags")))

    def _settled(self) -> DataFrame:
        """Actions that follow from a message's row alone."""
        server = F.col("r") & F.col("c") & F.col("r_live")
        moved, flags = server & (F.col("r_box") != F.col("c_box")), server & (F.col("r_flags") != F.col("c_flags"))
        file = F.col("maildir_id").isNotNull() & ~F.col("file_gone")
        here = F.col("reflagged") & ~F.col("dead")
        pull = flags & file if self.policy.winner == "server" else flags & file & ~F.col("reflagged")
        push = here & ~F.coalesce(flags, F.lit(False)) if self.policy.winner == "server" else here
        return acts(
            self.messages.filter("c"), (moved & file & F.col("c_live"), act("move_local", "email_id", "maildir_id", "c_box", "r_box")), (pull, act("update_local_flags", "email_id", "maildir_id", flags="r_flags")),
            (push, act("update_remote_flags", "email_id", "maildir_id", flags="l_flags")),
        )

    def _deletes(self) -> DataFrame:
        """Files of messages that the server destroyed, unless they are gone or were given to another id."""
        rows = self.messages.filter("dead AND maildir_id IS NOT NULL AND NOT file_gone AND c_live")
        rows = rows.join(self.arrivals().filter("fate = 'rebind'").select(F.col("old_email").alias("email_id")), "email_id", "left_anti")
        return acts(rows, (F.lit(True), act("delete_local", "email_id", "maildir_id", "c_box")))

    def _departures(self) -> DataFrame:
        restored = F.expr(self._CHANGED) & self._server_wins()
        return acts(self._left(), (restored, act("download", "email_id", target="r_box", flags="r_flags")), (~F.coalesce(restored, F.lit(False)), act("destroy_remote", "email_id", "maildir_id", "c_box")))

    def _arrived(self) -> DataFrame:
        taken = F.col("fate").isin("adopt", "rebind")
        rows = self.arrivals()
        out = acts(rows, (F.col("fate") == "download", act("download", "email_id", target="mailbox_id", flags="flags")), (taken, act("adopt", "email_id", "maildir_id", "old_email", "mailbox_id")))
        return out.union(self._adopted_flags(rows.filter(taken)))

    def _uploaded(self) -> DataFrame:
        rows = self.new_files()
        out = acts(rows, (F.col("fate") == "upload", act("upload", maildir="maildir_id", target="mailbox_id", flags="file_flags")), (F.col("fate") == "adopt", act("adopt", "email_id", "maildir_id", target="mailbox_id")))
        return out.union(self._adopted_flags(rows.filter("fate = 'adopt'")))

    def _moved(self) -> DataFrame:
        return acts(
            self.moves(), (F.lit(True), act("move_remote", "email_id", "maildir_id", "from_box", "to_box")), (F.lit(True), act("adopt_moved", "email_id", "maildir_id", target="to_box")),
            (F.col("flags") != F.col("old_flags"), act("update_remote_flags", "email_id", "maildir_id", flags="flags")),
        )

    #: The stages, and the kinds of actions that each gives.
    _STAGES = {
        "_settled": {"move_local", "update_local_flags", "update_remote_flags"}, "_deletes": {"delete_local"}, "_departures": {"download", "destroy_remote"},
        "_arrived": {"download", "adopt", "update_local_flags", "update_remote_flags"}, "_uploaded": {"upload", "adopt", "update_local_flags", "update_remote_flags"}, "_moved": {"move_remote", "adopt", "update_remote_flags"},
    }

    def plan(self, *kinds: str) -> DataFrame:
        """All actions, or those of some kinds: only the stages that give them are run."""
        parts = [getattr(self, name)() for name, gives in self._STAGES.items() if not kinds or gives & set(kinds)]
        out = functools.reduce(DataFrame.union, parts)
        return out.filter(F.col("kind").isin(*kinds)) if kinds else out

    def of_kind(self, kind: str) -> DataFrame:
        return self.plan(kind)

    def downloads(self) -> DataFrame:
        return self.of_kind("download")

    def local_moves(self) -> DataFrame:
        return self.of_kind("move_local")

    def local_flag_updates(self) -> DataFrame:
        """Server's flags that go to files; where the file's changed as well, only if the server wins."""
        return self.of_kind("update_local_flags")

    def remote_flag_updates(self) -> DataFrame:
        return self.of_kind("update_remote_flags")

    def local_deletes(self) -> DataFrame:
        return self.of_kind("delete_local")

    def uploads(self) -> DataFrame:
        return self.of_kind("upload")

    def remote_destroys(self) -> DataFrame:
        return self.of_kind("destroy_remote")

    def skips(self) -> DataFrame:
        """(email_id, maildir_id, reason) of messages and files that the plan leaves alone though they are new."""
        mails = self.messages.filter("r AND NOT (c AND r_live)").filter("NOT r_live OR r_mid IS NULL")
        out = mails.select("email_id", _null().alias("maildir_id"), F.when(~F.col("r_live"), "not synced").otherwise("no message id").alias("reason"))
        out = out.union(self.arrivals().filter("fate IN ('alive', 'claimed')").select("email_id", _null(), F.concat(F.lit("duplicate: "), "fate")))
        return out.union(self.new_files().filter("fate IN ('claimed', 'elsewhere', 'too large')").select(_null(), "maildir_id", F.when(F.col("fate") == "too large", "too large").otherwise(F.concat(F.lit("duplicate: "), "fate"))))


#: Kinds that change the server, and kinds that change the tree of mailboxes.
REMOTE_KINDS = ("move_remote", "upload", "update_remote_flags", "destroy_remote", "create_remote_mailbox", "rename_remote_mailbox", "destroy_remote_mailbox")
STRUCTURAL_KINDS = ("create_local_mailbox", "rename_local_mailbox", "delete_local_folder", "create_remote_mailbox", "rename_remote_mailbox", "destroy_remote_mailbox")


#: What a plan's summary counts, and the kinds that each count has.
COUNTERS = {
    "downloads": ("download",), "uploads": ("upload",), "adoptions": ("adopt",), "flag_updates": ("update_local_flags", "update_remote_flags"), "deletes": ("delete_local", "destroy_remote"),
    "local_folder_creates": ("create_local_mailbox",), "remote_folder_creates": ("create_remote_mailbox",), "local_folder_renames": ("rename_local_mailbox",), "remote_folder_renames": ("rename_remote_mailbox",),
}


def summary(plan: DataFrame) -> DataFrame:
    """One row with COUNTERS, and empty: whether there is nothing to do at all."""
    counts = [F.count_if(F.col("kind").isin(*kinds)).alias(name) for name, kinds in COUNTERS.items()]
    return plan.agg(*counts, (F.count("*") == 0).alias("empty"))


def described(plan: DataFrame) -> DataFrame:
    """(phase, email_id, maildir_id, line): each action as a line of text, with the side that it changes, what it does it to, and from where to where."""
    side = F.when(F.col("kind").isin(*REMOTE_KINDS), "push").otherwise("pull")
    what = F.coalesce("email_id", "maildir_id", F.lit("folder"))
    line = F.concat_ws(" ", side, F.replace("kind", F.lit("_"), F.lit(" ")), what, F.concat(F.lit("from "), "source"), F.concat(F.lit("to "), "target"))
    return plan.select("phase", "email_id", "maildir_id", line.alias("line"))


def adopted_flags(rows: DataFrame, winner: str) -> DataFrame:
    """(email_id, action, flags, patch) of adopted files (email_id, blob_id, thread_id, server_flags, file_flags) whose flags aren't the server's.

    If the server wins its flags go to the file, where both its ids are known; else a patch of all six keywords goes to the server.
    """
    rows = rows.filter(~F.col("server_flags").eqNullSafe(F.col("file_flags")))
    if winner == "server":
        known = rows.filter(F.col("blob_id").isNotNull() & F.col("thread_id").isNotNull())
        return known.select("email_id", F.lit("update_local_flags").alias("action"), F.col("server_flags").alias("flags"), _null().alias("patch"))
    return rows.select("email_id", F.lit("update_remote_flags").alias("action"), F.col("file_flags").alias("flags"), F.to_json(keywords_of(F.col("file_flags"))).alias("patch"))


def with_direction(plan: DataFrame, direction: str) -> DataFrame:
    """plan with kept: whether a one-way run carries the action out. 'pull' changes the disk, 'push' the server; adoptions are kept in both."""
    remote = F.col("kind").isin(*REMOTE_KINDS)
    return plan.withColumn("kept", (F.col("kind") == "adopt") | (remote if direction == "push" else ~remote))


def keep_direction(plan: DataFrame, direction: str) -> DataFrame:
    """The actions of a one-way run."""
    return with_direction(plan, direction).filter("kept").drop("kept")


def one_way(plan: DataFrame, direction: str) -> DataFrame:
    """keep_direction of a plan without structural actions; with any it is an error, as a one-way run can't settle the tree of mailboxes."""
    if not plan.filter(F.col("kind").isin(*STRUCTURAL_KINDS)).isEmpty():
        raise ValueError("the plan changes mailboxes; run it both ways first")
    return keep_direction(plan, direction)


def applied(cached: DataFrame, plan: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The cache after a plan: rows of destroyed messages and of ids that lost their file to another go, moved, reflagged and adopted ones are changed, new ones come.

    failed (email_id): messages whose action failed; their rows stay as they are. Uploads get their ids from the server and appear with
    the next remote state; they are left out.
    """
    k = F.col("kind")
    done = plan.filter("email_id IS NOT NULL")
    if failed is not None:
        done = done.join(failed.select("email_id"), "email_id", "left_anti")
    lost = done.filter("kind = 'adopt' AND source IS NOT NULL").select(F.col("source").alias("email_id"), F.lit("delete_local").alias("kind"), *[_null().alias(c) for c in ("maildir_id", "target", "flags")])
    done = done.select("email_id", "kind", "maildir_id", "target", "flags").union(lost)
    of = lambda c, *kinds: F.max(F.when(k.isin(*kinds), F.col(c)))
    each = done.groupBy("email_id").agg(
        F.bool_or(k.isin("delete_local", "destroy_remote")).alias("_gone"), F.bool_or(k.isin("download", "adopt")).alias("_new"),
        of("target", "move_local", "move_remote", "adopt", "download").alias("_box"), of("maildir_id", "adopt").alias("_file"), of("flags", "update_local_flags", "update_remote_flags", "download").alias("_flags"),
    )
    rows = cached.select("email_id", "mailbox_id", "maildir_id", "flags", F.lit(True).alias("_had")).join(each, "email_id", "full")
    rows = rows.filter(~F.coalesce("_gone", F.lit(False)) & F.coalesce("_had", "_new", F.lit(False)))
    return rows.select("email_id", F.coalesce("_box", "mailbox_id").alias("mailbox_id"), F.coalesce("_file", "maildir_id").alias("maildir_id"), F.coalesce("_flags", "flags").alias("flags"))


def rebind_verdicts(fresh: DataFrame, cached: DataFrame, destroyed: DataFrame) -> DataFrame:
    """(email_id, maildir_id, verdict) of mails with ids that the cache doesn't know, whose message it knows in the same mailbox with a file:
    the file goes to the new id if the old one is destroyed, and stays where it is if that is alive."""
    rows = cached.filter("maildir_id IS NOT NULL").select("message_id", "mailbox_id", "maildir_id", F.col("email_id").alias("_old"))
    dead = destroyed.select(F.col("email_id").alias("_old"), F.lit(True).alias("_dead")).distinct()
    both = fresh.join(rows, ["message_id", "mailbox_id"]).join(dead, "_old", "left")
    return both.select("email_id", "maildir_id", F.when(F.col("_dead"), "rebind").otherwise("skip: still alive").alias("verdict"))


def claims(fresh: DataFrame, local: DataFrame) -> DataFrame:
    """(email_id, maildir_id, refused) of mails whose message is in a file of the same mailbox: a file goes to the smallest id, others are refused."""
    both = fresh.select("email_id", "message_id", "mailbox_id").join(local.select("message_id", "mailbox_id", "maildir_id"), ["message_id", "mailbox_id"])
    first = both.groupBy("maildir_id").agg(F.min("email_id").alias("_first"))
    return both.join(first, "maildir_id").select("email_id", "maildir_id", (F.col("email_id") != F.col("_first")).alias("refused"))
