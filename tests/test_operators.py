"""Operators on literal rows, and every query with SQL against DuckDB on the smallest tables."""

import datetime as dt
import itertools
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import dedupe, drift, folders, hierarchy, ordered, orphans, reconcile, store
from tidemark.registry import ORACLE, QUERIES
from tidemark.streaming import operators as S

DATA = "/root/testdata/sf0.001"


def value(spark, column, **cols):
    kinds = {k: ("string" if isinstance(v, str) or v is None else "bigint") for k, v in cols.items()}
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("<a@x>", "a@x"), (" <a> b <c> ", "a> b <c"), ("plain ", "plain"), ("< >", None), ("", None), (None, None), ("x <a", "x <a")])
def test_message_id(spark, raw, want):
    assert value(spark, T.message_id(F.col("r")), r=raw) == want


@pytest.mark.parametrize(("path", "want"), [("a/cur/1:2,FS", ("a", "cur", "1", "FS")), ("a/cur/new/2", ("a/cur", "new", "2", "")), ("a/new/1", ("a", "new", "1", "")), ("a/tmp/1", None), ("a/cur/:2,S", None)])
def test_event_path(spark, path, want):
    got = value(spark, T.event_path(F.col("p")), p=path)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("s", "want"), [(-5, "0s ago"), (59, "59s ago"), (60, "1m ago"), (7199, "1h ago"), (86400, "1d ago")])
def test_ago(spark, s, want):
    assert value(spark, T.ago(F.col("s")), s=s) == want


@pytest.mark.parametrize(("n", "limit", "want"), [("abc", 3, "abc"), ("abcd", 3, "ab…"), ("abcd", 1, "a"), ("abcd", 0, "")])
def test_ellipsis(spark, n, limit, want):
    assert value(spark, T.ellipsis(F.col("n"), limit), n=n) == want


def test_flags_round_trip(spark):
    for k in range(7):
        for letters in itertools.combinations("DFPRST", k):
            assert value(spark, T.flags_of(T.keywords_of(F.col("f"))), f="".join(letters)) == "".join(letters)


def test_dedupe_keeps_the_oldest_and_spares_moving_messages(spark):
    files = spark.createDataFrame(
        [("a", "m", 3, "x", "cur"), ("a", "m", 1, "z", "cur"), ("a", "m", 1, "y", "cur"), ("b", "m", 1, "q", "cur"), ("a", None, 1, "n1", "cur"), ("a", None, 1, "n2", "cur"), ("a", "k", 1, "k1", "new"), ("a", "k", 2, "k1,S=3", "cur"), ("a", "j", 1, "j1", "new"), ("a", "j", 2, "j12", "cur")],
        "folder string, message_id string, mtime int, maildir_id string, subdir string",
    )
    assert {tuple(r) for r in dedupe.dedupe_plan(files).collect()} == {("a", "m", "x", "y"), ("a", "m", "z", "y"), ("a", "j", "j12", "j1")}
    assert dedupe.dedupe_plan(files, exempt=False).count() == 4
    assert dedupe.dedupe_plan(files.filter("false")).count() == 0


def test_paths_end_in_cycles_and_at_missing_parents(spark):
    tree = spark.createDataFrame([("a", "A", None), ("b", "B", "a"), ("c", "C", "b"), ("x", "X", "gone"), ("p", "P", "q"), ("q", "Q", "p")], "id string, name string, parent_id string")
    got = {r["id"]: r for r in hierarchy.paths(tree).collect()}
    assert got["c"]["path"] == "A/B/C" and got["c"]["depth"] == 2 and got["x"]["path"] == "X"
    assert got["p"]["depth"] == hierarchy.MAX_DEPTH - 1


def test_layouts(spark):
    for path, layout, want in [("INBOX", "maildir++", "."), ("INBOX/x", "maildir++", ".x"), ("A/B", "maildir++", ".A.B"), ("A/B", "flat", "A.B"), ("A/B", "fs", "A/B")]:
        assert value(spark, hierarchy.encoded(F.col("p"), layout), p=path) == want


def sides(spark, remote, cached, local, **policy):
    return reconcile.Sides(
        spark.createDataFrame(remote, "email_id string, message_id string, mailbox_id string, flags string, size long"),
        spark.createDataFrame(cached, "email_id string, message_id string, mailbox_id string, maildir_id string, flags string"),
        spark.createDataFrame(local, "maildir_id string, message_id string, mailbox_id string, flags string, size long"),
        reconcile.Policy(**policy),
    )


def plan(s):
    return {(r["kind"], r["email_id"], r["maildir_id"], r["source"], r["target"], r["flags"]) for r in s.plan().collect()}


def test_nothing_to_do(spark):
    assert plan(sides(spark, [("e", "m", "A", "S", 1)], [("e", "m", "A", "f", "S")], [("f", "m", "A", "S", 1)])) == set()
    assert plan(sides(spark, [], [], [])) == set()


def test_adoption_and_second_claimant(spark):
    s = sides(spark, [("e1", "m", "A", "S", 1), ("e2", "m", "A", "S", 1)], [], [("f", "m", "A", "", 1)])
    assert plan(s) == {("adopt", "e1", "f", None, "A", None), ("update_local_flags", "e1", "f", None, None, "S")}  # e2 is a double of e1: its download would be one as well
    assert [tuple(r) for r in s.skips().collect()] == [("e2", None, "duplicate: claimed")]
    s = sides(spark, [("e1", "m", "A", "S", 1)], [], [("f", "m", "A", "", 1)], winner="local")
    assert ("update_remote_flags", "e1", "f", None, None, "") in plan(s)


def test_conflicts_follow_the_policy(spark):
    args = [("e", "m", "A", "F", 1)], [("e", "m", "A", "f", "")]
    both = [("f", "m", "A", "S", 1)]
    assert plan(sides(spark, *args, both)) == {("update_local_flags", "e", "f", None, None, "F")}
    assert plan(sides(spark, *args, both, winner="local")) == {("update_remote_flags", "e", "f", None, None, "S")}
    assert plan(sides(spark, *args, [])) == {("download", "e", None, None, "A", "F")}
    assert plan(sides(spark, *args, [], winner="local")) == {("destroy_remote", "e", "f", "A", None, None)}


def test_moves_and_limits(spark):
    s = sides(spark, [("e", "m", "A", "", 1)], [("e", "m", "A", "f", "")], [("g", "m", "B", "S", 1), ("h", "big", "B", "", 10**9), ("i", None, "B", "", 1)])
    assert plan(s) == {("move_remote", "e", "g", "A", "B", None), ("adopt", "e", "g", None, "B", None), ("update_remote_flags", "e", "g", None, None, "S")}
    assert plan(sides(spark, [], [("e", "m", "A", "f", "")], [("f", "m", "A", "", 1)], full=False)) == set()


def test_plan_applied_twice_changes_nothing(spark):
    remote = [("e1", "m1", "A", "S", 1), ("e2", "m2", "B", "", 1), ("e3", "m3", "A", "", 1)]
    s = sides(spark, remote, [("e1", "m1", "A", "f1", ""), ("e2", "m2", "A", "f2", ""), ("e4", "m4", "A", "f4", "")], [("f1", "m1", "A", "", 1), ("f2", "m2", "A", "", 1), ("f4", "m4", "A", "", 1)])
    after = {r["email_id"]: tuple(r)[1:] for r in reconcile.applied(s.cached, s.plan()).collect()}
    assert after == {"e1": ("A", "f1", "S"), "e2": ("B", "f2", ""), "e3": ("A", None, "")}
    cached = [(e, "m" + e[1], b, f or "f3", g) for e, (b, f, g) in after.items()]
    assert plan(sides(spark, remote, cached, [(f, m, b, g, 1) for _, m, b, f, g in cached])) == set()


def test_drift_classes_are_disjoint(spark):
    disk = spark.createDataFrame([("new", "M1"), ("new2", "M1"), ("both", "M2"), ("odd", None)], "folder string, sentinel string")
    known = spark.createDataFrame([("old", "M1"), ("both", "M2"), ("gone", "M3"), ("left", "M4")], "folder string, mailbox_id string")
    got = drift.drift(disk, known, spark.createDataFrame([("M1",), ("M2",), ("M3",)], "mailbox_id string")).collect()
    assert {tuple(r) for r in got} == {("new", "rename_in_flight"), ("old", "rename_in_flight"), ("new2", "disk_only"), ("odd", "disk_only"), ("gone", "db_only"), ("left", "config_dropped")}


def test_unique_matchings_against_permutations(spark):
    import random

    r = random.Random(5)
    edges = {(a, f"f{f}", f"m{r.randrange(4)}") for a in range(30) for f in range(3) for _ in range(r.randrange(1, 3))}
    got = {(x["account"], x["folder"], x["mailbox_id"]) for x in drift.unique_matchings(spark.createDataFrame(sorted(edges), "account int, folder string, mailbox_id string")).collect()}
    want = set()
    for a in range(30):
        ways = [p for p in itertools.permutations([f"m{i}" for i in range(4)], 3) if all((a, f"f{i}", b) in edges for i, b in enumerate(p))]
        if len(ways) == 1:
            want |= {(a, f"f{i}", b) for i, b in enumerate(ways[0])}
    assert got == want and want


def test_hook_runs_against_a_simulation(spark):
    import random

    r = random.Random(8)
    data = sorted({(k, r.randrange(500)) for k in range(6) for _ in range(40)})
    df = spark.createDataFrame([(k, dt.datetime(2020, 1, 1) + dt.timedelta(seconds=t)) for k, t in data], "k long, ts timestamp")
    zero = int(dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    want = set()
    for k in range(6):
        free, waiting, runs = -1, 0, []
        for t in [t for j, t in data if j == k] + [10**9]:
            while waiting and t >= free:
                runs.append((free, waiting))
                free, waiting = free + 30, 0
            if t == 10**9:
                break
            if t >= free:
                runs.append((t, 1))
                free = t + 30
            else:
                waiting += 1
        want |= {(k, s, n) for s, n in runs}
    assert {(x["k"], x["start"] - zero, x["triggers"]) for x in S.hook_runs(df, "k", 30).collect()} == want


@pytest.mark.parametrize(("n", "want"), [(1023, "1023 B"), (1024, "1.0 KB"), (1049 * 1049, "1.0 MB"), (1203 * 1203, "1.4 MB"), (1331, "1.3 KB"), (1280, "1.2 KB"), (1_152_921, "1.1 MB"), (5 * 1024**3 + 54_000_000, "5.1 GB"), (2**60, "1073741824.0 GB")])
def test_human_bytes(spark, n, want):
    assert value(spark, T.human_bytes(F.col("n")), n=n) == want


def test_human_bytes_rounds_as_print_does(spark):
    sizes = [k * k for k in range(32, 4000, 7)] + [1024 * k + 51 for k in range(1, 400)] + [1024 * k // 20 for k in range(21, 900)]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select(T.human_bytes(F.col("n")).alias("x")).collect()
    assert [r["x"] for r in got] == [f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1024**2 else f"{n / 1024**2:.1f} MB" for n in sizes]


@pytest.mark.parametrize(("headers", "want"), [("Subject: =?utf-8?q?caf=C3=A9?=\r\n", "café"), ("Subject: x =?utf-8?b?w6k=?= y\n", "x é y"), ("subject:  a\r\n b \r\n", "a b"), ("Subject: =?nope?q?a?=\n", "=?nope?q?a?="), ("Subject:   \r\nTo: x\r\n", None), ("To: x\n", None), (None, None)])
def test_subject(spark, headers, want):
    assert value(spark, T.subject(F.col("h")), h=headers) == want


@pytest.mark.parametrize(("content", "want"), [("a: b\n\nbody", "a: b\n\n"), ("a: b\r\n\r\nx\n\n", "a: b\r\n\r\n"), ("a: b", "a: b"), ("a" * 30, None), ("a" * 17 + "\n\nx", "a" * 17 + "\n\n"), ("a" * 25 + "\n\n", None), ("", "")])
def test_header_section(spark, content, want):
    assert value(spark, T.header_section(F.col("c"), 8, 20), c=content) == want


@pytest.mark.parametrize(("base", "at", "want"), [("http://h/a/b", "c", "http://h/a/c"), ("http://h/a/b", "/c/../d", "http://h/d"), ("http://h/a/b", "?q", "http://h/a/b?q"), ("http://h", "//k/x", "http://k/x"), ("http://h", "http://k/x", "http://k/x"), ("http://h", None, None)])
def test_resolved_url(spark, base, at, want):
    assert value(spark, T.resolved_url(F.col("b"), F.col("a")), b=base, a=at) == want


def test_private_names_and_structural_paths(spark):
    names = {".tidemark.x": True, ".tidemark-x": True, ".tidemarkx": False, "a": False}
    assert {n: value(spark, T.is_private(F.col("n")), n=n) for n in names} == names
    paths = {"a": True, "a/cur": True, "a/cur/x": False, "": False, "a/.tidemark.x": False, "cur": True}
    assert {p: value(spark, T.is_structural_path(F.col("p")), p=p) for p in paths} == paths


def test_name_faults(spark):
    faults = {"": "empty", "a\0b": "NUL", "a/b": "separator", "..": "dots", "é" * 128: "too long", "ok": None}
    assert {n: value(spark, T.name_fault(F.col("n")), n=n) for n in faults} == faults


def test_decoding_and_eligible_folders(spark):
    for folder, layout, want in [("a.b.c", "flat", ("c", "a.b")), (".a.b", "maildir++", ("b", ".a")), (".a", "maildir++", ("a", None)), ("a/b", "fs", ("b", "a")), ("a", "fs", ("a", None))]:
        leaf, parent = hierarchy.decoded(F.col("f"), layout=layout)
        assert (value(spark, leaf, f=folder), value(spark, parent, f=folder)) == want
    for folder, layout, want in [("a", "flat", True), ("a/b", "flat", False), ("a", "maildir++", False), (".a", "maildir++", True), (".tidemark.a", "maildir++", False), ("a/b", "fs", True), ("a/.tidemark-x", "fs", False), ("", "fs", False)]:
        assert value(spark, hierarchy.eligible(F.col("f"), layout), f=folder) == want


def test_rebinding_and_doubles(spark):
    s = sides(spark, [("n", "m", "A", "S", 1), ("n2", "m", "A", "S", 1)], [("o", "m", "A", "f", "")], [("f", "m", "A", "", 1)])
    assert plan(s) == {("adopt", "n", "f", "o", "A", None), ("update_local_flags", "n", "f", None, None, "S")}
    assert [tuple(r) for r in reconcile.applied(s.cached, s.plan()).collect()] == [("n", "A", "f", "S")]
    s = sides(spark, [("o", "m", "A", "", 1), ("n", "m", "A", "", 1)], [("o", "m", "A", "f", "")], [("f", "m", "A", "", 1)])
    assert plan(s) == set() and [tuple(r) for r in s.skips().collect()] == [("n", None, "duplicate: alive")]


def test_changes_only(spark):
    """A delta has what changed: what it doesn't have is alive unless it says otherwise."""
    args = [("n", "m", "A", "", 1)], [("o", "m", "A", "f", ""), ("p", "q", "A", "g", "")], [("f", "m", "A", "", 1), ("g", "q", "A", "", 1)]
    s = sides(spark, *args, full=False)
    assert plan(s) == set() and s.skips().count() == 1
    s.destroyed_ids = spark.createDataFrame([("o",)], "email_id string")
    del s.messages, s._moves, s._arrivals, s._new
    assert plan(s) == {("adopt", "n", "f", "o", "A", None)}


def test_files_that_come_again_and_copies_elsewhere(spark):
    s = sides(spark, [("e", "m", "A", "", 1)], [("e", "m", "A", "f", "")], [("g", "m", "A", "S", 1)])
    assert plan(s) == {("adopt", "e", "g", None, "A", None), ("update_local_flags", "e", "g", None, None, "")}
    s = sides(spark, [("e", "m", "A", "", 1)], [("e", "m", "A", "f", "")], [("f", "m", "A", "", 1), ("g", "m", "B", "", 1), ("h", "k", "B", "", 9)], largest=5)
    assert plan(s) == set() and sorted(tuple(r) for r in s.skips().collect()) == [(None, "g", "duplicate: elsewhere"), (None, "h", "too large")]


def test_mailboxes_that_take_no_part(spark):
    s = sides(spark, [("e", "m", "X", "S", 1), ("n", "k", "X", "", 1), ("o", None, "A", "", 1)], [("e", "m", "A", "f", ""), ("d", "z", "X", "g", "")], [("f", "m", "A", "", 1), ("g", "z", "X", "", 1)])
    s.live = spark.createDataFrame([("A",)], "mailbox_id string")
    assert plan(s) == set()
    assert sorted(tuple(r) for r in s.skips().collect()) == [("e", None, "not synced"), ("n", None, "not synced"), ("o", None, "no message id")]


def test_failed_actions_leave_rows(spark):
    s = sides(spark, [("a", "m", "B", "S", 1), ("b", "n", "A", "", 1)], [("a", "m", "A", "f", ""), ("b", "n", "A", "g", "")], [("f", "m", "A", "", 1)])
    failed = spark.createDataFrame([("a",)], "email_id string")
    assert {tuple(r) for r in reconcile.applied(s.cached, s.plan(), failed).collect()} == {("a", "A", "f", "")}


def test_one_way_runs_refuse_structural_plans(spark):
    s = sides(spark, [("a", "m", "A", "", 1)], [], [])
    assert reconcile.one_way(s.plan(), "push").count() == 0 and reconcile.one_way(s.plan(), "pull").count() == 1
    made = reconcile.acts(spark.range(1), (F.lit(True), reconcile.act("create_local_mailbox")))
    with pytest.raises(ValueError, match="mailboxes"):
        reconcile.one_way(s.plan().union(made), "pull")


def test_seven_decisions(spark):
    rows = [("1", None, "s", None), ("2", "a", "a", "a"), ("3", "a", "b", None), ("4", "a", "b", "b"), ("5", "a", "a", "c"), ("6", "a", "b", "c")]
    df = spark.createDataFrame([(*r, False, True) for r in rows] + [("7", "a", "a", "c", True, True), ("8", "a", "a", "c", False, False)], "mailbox_id string, cached string, server string, disk string, ruled boolean, decomposes boolean")
    want = {"1": "first_cycle", "2": "unchanged", "3": "server_rename", "4": "cache_stale", "5": "local_rename", "6": "conflict_server_wins", "7": "unchanged", "8": "unchanged"}
    assert {r["mailbox_id"]: r["decision"] for r in folders.decisions(df).collect()} == want
    assert {r["mailbox_id"]: r["decision"] for r in folders.decisions(df, "local").collect()} == want | {"6": "conflict_local_wins"}
    assert {tuple(r)[1:5] for r in folders.folder_actions(folders.decisions(df)).collect()} == {("create_local_mailbox", "1", None, "s"), ("rename_local_mailbox", "3", "a", "b"), ("rename_remote_mailbox", "5", "a", "c"), ("rename_local_mailbox", "6", "c", "b")}


def test_chains_of_states(spark):
    edges = {"line": "ab bc cd", "ring": "ab bc ca", "loop": "ab bb", "self": "aa", "apart": "ab xy", "side": "ab bc xx", "rho": "ab bc cb", "none": "", "long": " ".join(f"{i}_{i + 1}" for i in range(40))}
    rows = [(k, *(e.split("_") if "_" in e else (e[0], e[1])), n) for k, v in edges.items() for n, e in enumerate(v.split())] + [("again", "a", "x", 0), ("again", "a", "b", 1)]
    cursors = [(k, "0" if k == "long" else "a", True, False) for k in [*edges, "again"]] + [("held", "a", True, True), ("broken", "a", False, False)]
    got = {r["account"]: r["advanced"] for r in store.walked(spark.createDataFrame(cursors, "account string, cursor string, intact boolean, incomplete boolean"), spark.createDataFrame(rows + [("held", "a", "b", 0), ("broken", "a", "b", 0)], "account string, old string, new string, seq int")).collect()}
    assert got == {"line": "d", "ring": "a", "loop": "a", "self": "a", "apart": "a", "side": "a", "rho": "a", "none": "a", "long": "40", "again": "b", "held": None, "broken": "a"}


def test_creations_by_depth(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("e", "d"), ("p", "q"), ("q", "p"), ("k", "known")]
    got = store.resolved_tree(spark.createDataFrame(rows, "ref string, parent_ref string"), spark.createDataFrame([("known",)], "ref string")).collect()
    assert {(r["ref"], r["depth"]) for r in got} == {("a", 0), ("b", 1), ("c", 2), ("k", 0)}


def test_numbers_in_ranges(spark, monkeypatch):
    import random

    monkeypatch.setattr(store, "RANGES", 7)
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.randrange(50), r.randrange(9)) for _ in range(300)]
    got = store.numbered(spark.createDataFrame(rows, "g string, k int, v int"), "g", "k", F.col("v")).collect()
    assert len(got) == 300
    for g in ("a", "b", None):
        mine = sorted((x["before"], x["k"], x["v"]) for x in got if x["g"] == g)
        order = sorted(mine, key=lambda x: (x[1], x[0], x[2]))
        assert all(y[0] == x[0] + x[2] for x, y in zip(order, order[1:])) and order[0][0] == 0


def test_rows_that_contain_offsets(spark):
    starts = [("a", i, s) for i, s in enumerate([0, 5, 9, 400, 401, 900])] + [("b", 7, 100)]
    probes = [("a", p, p) for p in (0, 4, 5, 8, 9, 399, 400, 401, 899, 5000)] + [("b", 99, 99), ("b", 100, 100), ("c", 1, 1)]
    got = {(r["g"], r["probe"]): r["doc_id"] for r in ordered.containing(spark.createDataFrame(starts, "g string, doc_id int, start long"), spark.createDataFrame(probes, "g string, probe long, pos long"), "g").collect()}
    for g, p, pos in probes:
        assert got[g, p] == max(((s, i) for h, i, s in starts if h == g and s <= pos), default=(0, None))[1]


def test_long_chains_and_rings_of_folders(spark):
    edges = [("chain", f"f{i}", f"m{j}") for i in range(40) for j in (i, min(i + 1, 39))] + [("ring", f"f{i}", f"m{j}") for i in range(40) for j in (i, (i + 1) % 40)] + [("spare", "f", "m"), ("spare", "f", "n"), ("short", "f", "m"), ("short", "g", "m")]
    got = drift.unique_matchings(spark.createDataFrame(edges, "account string, folder string, mailbox_id string").distinct()).collect()
    assert {tuple(r) for r in got} == {("chain", f"f{i}", f"m{i}") for i in range(40)}


def test_narrowed_sides_are_the_whole_plan(spark):
    d = "/root/testdata/sf0.001"
    sides, plan = (QUERIES[n](spark, d).collect() for n in ("prune_narrow", "prune_plan"))
    assert sorted((r["folder"], r["files"], r["label"]) for r in sides) == sorted(tuple(r) for r in plan) and len({r["disk_only"] for r in sides}) == 2
    assert [r["folder"] for r in sides] == sorted((r["folder"] for r in sides), reverse=True)


def test_narrow_needs_a_known_folder(spark):
    p = spark.createDataFrame([("a", "disk_only"), ("b", "db_only")], "folder string, class string")
    assert drift.narrowed(p, "a").count() == 1 and drift.narrowed(p, disk_only=False).first()["folder"] == "b"
    with pytest.raises(ValueError, match="c"):
        drift.narrowed(p, "c")


def test_own_batches_use_writes_up(spark):
    import random

    r = random.Random(4)
    at = lambda s: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=s)
    times = r.sample(range(1, 4000), 900)
    writes = [(r.randrange(2), r.choice("abcd"), t) for t in times[:500]]
    batches = [(r.randrange(2), n, sorted(r.sample("abcd", r.randrange(1, 3))), t) for n, t in enumerate(times[500:])]
    want = {}
    for k in (0, 1):
        held = {}
        for t, what in sorted([(t, p) for j, p, t in writes if j == k] + [(t, (n, ps)) for j, n, ps, t in batches if j == k], key=lambda x: x[0]):
            if isinstance(what, str):
                held[what] = t
            else:
                n, ps = what
                want[n] = all(p in held and t - held[p] < 60 for p in ps)
                if want[n]:
                    for p in ps:
                        del held[p]
    b = spark.createDataFrame([(k, n, p, at(t)) for k, n, ps, t in batches for p in ps], "k long, batch long, path string, ts timestamp")
    w = spark.createDataFrame([(k, p, at(t)) for k, p, t in writes], "k long, path string, ts timestamp")
    assert {x["batch"]: x["own"] for x in S.own_batches(b, w, "k", 60).collect()} == want and {True, False} == set(want.values())


def test_hook_retries_against_a_simulation(spark):
    import random

    r = random.Random(9)
    data = sorted((k, t, r.randrange(5)) for k in range(5) for t in r.sample(range(600), 40))
    df = spark.createDataFrame([(k, dt.datetime(2020, 1, 1) + dt.timedelta(seconds=t), f) for k, t, f in data], "k long, ts timestamp, f int")
    zero = int(dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    want = set()
    for k in range(5):
        end, waiting = -1, []
        runs = []

        def run(t, n, f):
            runs.append((k, t, n, min(f, 2) + 1, f <= 2))
            return t + 10 * (min(f, 2) + 1)

        for t, f in [(t, f) for j, t, f in data if j == k] + [(10**9, None)]:
            if waiting and t >= end:
                end, waiting = run(end, len(waiting), waiting[0]), []
            if f is None:
                break
            if t >= end:
                end = run(t, 1, f)
            else:
                waiting.append(f)
        want |= set(runs)
    assert {(x["k"], x["start"] - zero, x["triggers"], x["attempts"], x["ok"]) for x in S.hook_runs(df, "k", 10, fails="f", retries=2).collect()} == want


def test_scans_of_named_messages(spark):
    named = spark.createDataFrame([("a", i) for i in "12345"] + [("b", "1"), ("a", "1")], "folder string, id string")
    files = spark.createDataFrame([("a", "1", "new", "F"), ("a", "1", "cur", "S"), ("a", "2", "cur", ""), ("a", "3", "new", "")], "folder string, id string, subdir string, flags string")
    known = spark.createDataFrame([("a", "1", ""), ("a", "2", ""), ("a", "4", "")], "folder string, id string, flags string")
    assert {tuple(r)[:4] for r in store.scanned(named, files, known).collect()} == {("a", "1", "flags", "cur"), ("a", "2", "same", "cur"), ("a", "3", "new", "new"), ("a", "4", "deleted", None)}


def test_empty_batches_don_t_reach_the_handler(spark):
    seen = []
    call = S.on_changes(lambda df, n: seen.append(n))
    call(spark.range(0), 1)
    call(spark.range(1), 2)
    assert seen == [2]


def test_sessions_on_a_stream(spark, tmp_path):
    rows = [(1, "LocalChange", 0), (1, "Manual", 20), (1, "LocalChange", 200), (2, "Structural", 10)]
    at = lambda s: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(u, k, at(s)) for u, k, s in [*rows, (9, "Initial", 100000)]], "user_id long, kind string, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = S.sessions(stream, "60 seconds", ["user_id"], "10 seconds").writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["user_id"], r["n"], r["kind"]) for r in spark.table("found").collect()}
    batch = {(r["user_id"], r["n"], r["kind"]) for r in S.sessions(df.filter("user_id < 9"), "60 seconds", ["user_id"]).collect()}
    assert got == batch == {(1, 2, "Manual"), (1, 1, "LocalChange"), (2, 1, "Structural")}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    import math

    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") and not isinstance(v, str) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    rel = duck.sql(ORACLE[name])
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize(("winner", "deletes", "want"), [
    ("local", "local", {("create_remote_mailbox", None, "MB1"), ("upload", "f1", "MB1"), ("upload", "f2", "MB1"), ("upload", "f3", "MB1")}),
    ("server", "local", {("delete_local_folder", None, None)}),
    ("server", "none", {("create_remote_mailbox", None, "MB1"), ("upload", "f1", "MB1"), ("upload", "f2", "MB1"), ("upload", "f3", "MB1")}),
])
def test_cycle_with_a_lost_mailbox(spark, winner, deletes, want):
    """The server deleted MB1, in which f3 is new here; f1 and f2 were known."""
    remote = spark.createDataFrame([("E9", "<m9>", "MB2", "", 1)], "email_id string, message_id string, mailbox_id string, flags string, size long")
    cached = spark.createDataFrame([("E1", "<m1>", "MB1", "f1", ""), ("E2", "<m2>", "MB1", "f2", ""), ("E9", "<m9>", "MB2", "f9", "")], "email_id string, message_id string, mailbox_id string, maildir_id string, flags string")
    local = spark.createDataFrame([(f"f{k}", f"<m{k}>", "MB2" if k == 9 else "MB1", "", 1) for k in (1, 2, 3, 9)], "maildir_id string, message_id string, mailbox_id string, flags string, size long")
    boxes = spark.createDataFrame([("MB1",)], "mailbox_id string")
    decided = folders.decisions(spark.createDataFrame([], "mailbox_id string, cached string, server string, disk string, ruled boolean, decomposes boolean"))
    policy = reconcile.Policy(winner, deletes=deletes)
    plan = folders.cycle_plan(reconcile.Sides(remote, cached, local, policy), decided, boxes, boxes.filter("false"), policy).collect()
    assert {(r["kind"], r["maildir_id"], r["target"]) for r in plan} == want and len(plan) == len(want)


def test_cycle_without_blockers_deletes_the_folder_alone(spark):
    remote = spark.createDataFrame([], "email_id string, message_id string, mailbox_id string, flags string, size long")
    cached = spark.createDataFrame([("E1", "<m1>", "MB1", "f1", "")], "email_id string, message_id string, mailbox_id string, maildir_id string, flags string")
    local = spark.createDataFrame([("f1", "<m1>", "MB1", "", 1)], "maildir_id string, message_id string, mailbox_id string, flags string, size long")
    boxes = spark.createDataFrame([("MB1",)], "mailbox_id string")
    decided = folders.decisions(spark.createDataFrame([], "mailbox_id string, cached string, server string, disk string, ruled boolean, decomposes boolean"))
    policy = reconcile.Policy("local", deletes="local")
    plan = folders.cycle_plan(reconcile.Sides(remote, cached, local, policy), decided, boxes, boxes.filter("false"), policy).collect()
    assert [(r["kind"], r["source"]) for r in plan] == [("delete_local_folder", "MB1")]


def test_refused_binds(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    binds = rows([("a", "A"), ("b", "B"), ("c", "B"), ("d", "D"), ("../e", "E"), ("gone", "A2"), ("f", "nowhere"), ("s", "S")], "folder string, remote_path string")
    disk = rows([(x,) for x in ("a", "b", "c", "d", "../e", "f", "s")], "folder string")
    server = rows([("mA", "A"), ("mB", "B"), ("mD", "D"), ("mE", "E"), ("mA2", "A2"), ("mS", "S")], "mailbox_id string, remote_path string")
    got = {r["folder"]: r["refusal"] for r in drift.refused_binds(binds, disk, server, rows([("mD",), ("mD",), ("mS",)], "mailbox_id string")).collect()}
    assert got == {"a": None, "b": "claimed", "c": "claimed", "d": "claimed", "../e": "outside", "gone": "no folder", "f": "no mailbox", "s": "claimed"}


@pytest.mark.parametrize(("path", "want"), [("a/b", False), ("a/../b", False), ("a/../../b", True), ("..", True), ("/a", True), ("a/..b/c", False), ("./a/./..", False), ("", False), ("a//../..", True)])
def test_paths_that_leave(spark, path, want):
    assert value(spark, T.leaves(F.col("p")), p=path) is want


@pytest.mark.parametrize(("r", "want"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (3 * 1024**2, "3.0 MB"), (5 * 1024**3, "5120.0 MB")])
def test_rates(spark, r, want):
    assert value(spark, T.human_rate(F.col("r")), r=r) == want
    assert value(spark, T.human_rate(F.lit(2.5)), r=r) == "2 B" and value(spark, T.human_rate(F.lit(3.5)), r=r) == "4 B"
    assert value(spark, T.signed_bytes(F.col("r")), r=-2048) == "-2.0 KB" and value(spark, T.signed_bytes(F.col("r")), r=0) == "+0 B"


def test_states_of_an_event(spark):
    got = value(spark, T.state_map(F.col("d")), d='{"changed":{"a":{"Email":"J1","Mailbox":"M"},"b":{}}}')
    assert got == {"a": {"Email": "J1", "Mailbox": "M"}, "b": {}}
    assert value(spark, T.state_map(F.col("d")), d="no json") is None and value(spark, T.state_map(F.col("d")), d="{}") is None


def test_mailboxes_are_listed_anew_or_reused(spark):
    accounts = spark.createDataFrame([(1, "s"), (2, None), (3, "s"), (4, "s"), (5, "s")], "account int, cursor string")
    pages = spark.createDataFrame([(1, 0, False, False), (3, 0, False, False), (3, 1, True, False), (4, 0, False, True)], "account int, n int, structural boolean, failed boolean")
    server = spark.createDataFrame([(k, f"m{k}", "f", None, 9, 4) for k in range(1, 6)], "account int, mailbox_id string, folder string, parent_id string, total long, unread long")
    got = {r["account"]: (r["reused"], r["total"], r["unread"]) for r in hierarchy.listed_or_reused(accounts, pages, server, server.drop("total", "unread")).collect()}
    assert got == {1: (True, 0, 0), 2: (False, 9, 4), 3: (False, 9, 4), 4: (False, 9, 4), 5: (True, 0, 0)}


def test_mailboxes_by_name(spark):
    rows = spark.createDataFrame([("1", "INBOX/x", None), ("2", "Work", None), ("3", "work", None), ("4", "Posteingang", "inbox"), ("5", "WÖRK", None)], "id string, path string, role string")
    names = lambda *n: spark.createDataFrame(list(n), "name string, any_case boolean")
    chosen = lambda *n: sorted(r["id"] for r in hierarchy.named(rows, names(*n)).collect())
    assert chosen() == ["1", "2", "3", "4", "5"] and chosen(("work", False)) == ["3"] and chosen(("WORK", True), ("work", False)) == ["2", "3"]
    assert chosen(("INBOX", False)) == ["4"] and chosen(("inbox", False)) == [] and chosen(("inbox", True)) == ["4"] and chosen(("wörk", True)) == []


def test_live_orphans_are_hoisted(spark):
    plan = spark.createDataFrame([(14, "destroy_remote", "E1", "f1", "MB1", None), (14, "destroy_remote", "E3", "f3", "MB3", None), (4, "download", "E2", None, None, "MB1")], "phase int, kind string, email_id string, maildir_id string, source string, target string")
    cached = spark.createDataFrame([("E1", "MB1"), ("E3", "MB3")], "email_id string, mailbox_id string")
    orphans_ = spark.createDataFrame([("MB1",), ("MB3",)], "mailbox_id string")
    whole = spark.createDataFrame([("E1", "MB1"), ("E2", "MB1"), ("E3", "MB3")], "email_id string, mailbox_id string")
    out, rest = orphans.hoist(plan, cached, orphans_, whole.filter("email_id = 'E2'"), whole)
    assert sorted((r["kind"], r["email_id"] or "", r["target"] or "") for r in out.collect()) == [("create_local_mailbox", "", "MB1"), ("destroy_remote", "E3", ""), ("download", "E1", "MB1"), ("download", "E2", "MB1")]
    assert [r["mailbox_id"] for r in rest.collect()] == ["MB3"]


def test_plan_in_numbers_and_words(spark):
    plan = spark.createDataFrame([(4, "download", "E2", None, None, "MB1"), (13, "move_remote", "E3", "f3", "MB1", "MB2"), (9, "create_remote_mailbox", None, None, None, "MB9"), (14, "destroy_remote", "E1", "f1", "MB1", None)], "phase int, kind string, email_id string, maildir_id string, source string, target string")
    s = reconcile.summary(plan).first()
    assert (s["downloads"], s["deletes"], s["remote_folder_creates"], s["uploads"], s["empty"]) == (1, 1, 1, 0, False) and reconcile.summary(plan.filter("false")).first()["empty"]
    assert [r["line"] for r in reconcile.described(plan).orderBy("phase").collect()] == ["pull download E2 to MB1", "push create remote mailbox folder to MB9", "push move remote E3 from MB1 to MB2", "push destroy remote E1 from MB1"]


def test_members_and_faults_by_group(spark):
    df = spark.createDataFrame([("a", 1, "x", [" p ", "", None]), ("a", 2, " ", None), ("b", 3, None, ["  "])], "g string, n int, e string, m array<string>")
    _, totals = store.validated(df, "n", "e", by=("g",))
    assert {tuple(r) for r in totals.collect()} == {("a", 1, 1, "e"), ("b", 0, 1, "e")}
    assert [r["m"] for r in df.orderBy("n").select(store.members(F.col("m")).alias("m")).collect()] == [["p"], None, []]
