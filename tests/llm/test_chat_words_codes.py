"""Chat formatting, spelling variants, vector codes and archives in several splits against brute force, with nulls, empties, ties, repeats and clashing columns."""

import base64
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import chat, codes, spelling, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")

# chat

ODD = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\/s> [\\INST] <s", "<|endoftext|> <\\|endoftext|>", "<<SYS>> <<s>> <</SYS>> [ROLE] [/ROLE] [END] [OUT]", "", None, "é 日本 \U0001f600 \x00 \n\n  x", "\\", "[", "<s>" * 50]


def conversations() -> list[tuple]:
    out = [(1, k, ["user", "assistant"][k % 2], t) for k, t in enumerate(ODD)]
    out += [(2, k, r, f"said {k}") for k, r in enumerate(["system", "user", "user", "assistant", "assistant", "tool", None, "", "[/ROLE]"])]
    out += [(3, 5, "user", "late"), (3, None, "system", "first"), (3, 5, "user", "late"), (3, 5, "assistant", "tie"), (None, 0, "user", "no id"), (None, 1, "assistant", None), (4, 0, None, None)]
    r = random.Random(1)
    out += [(9, k, ["user", "assistant"][k % 2], " ".join(r.choice(["la", "</s>", "queéch", "ou."]) for _ in range(40))) for k in range(60)]
    return out


def said(rows: list[tuple]) -> dict:
    """By conversation: its turns in order, and its formatted text."""
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        control = chat.template(PATH)
        body = "<s>"
        for _, _, role, text in turns:
            text = control.escape(text)
            body += {"user": f"[INST]{text}[/INST]", "system": f"<<SYS>>{text}<</SYS>>", "assistant": f"[OUT]{text}</s>"}.get(role, f"[ROLE]{control.escape(role)}[/ROLE]{text}[END]")
        out[c] = [(role, text) for _, _, role, text in turns], body
    return out


@pytest.mark.parametrize("held", [1, 300, chat.HELD])
def test_chat_is_read_back_whole(spark, held):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, chunk string, k int").repartition(5)
    made = chat.formatted(df, PATH, held)
    got = {r["conv_id"]: r for r in chat.read_back(made, PATH).collect()}
    want = said(rows)
    assert set(got) == set(want)
    for c, (turns, body) in want.items():
        learnt = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        assert tuple(got[c])[1:] == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(body))


def test_chat_ids_and_mask(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    made, t, plain = chat.formatted(df, PATH, 200).collect(), chat.template(PATH), Tokenizer.from_file(PATH)
    assert {r["chunk"] for r in made if r["conv_id"] == 9} == set(range(len([r for r in made if r["conv_id"] == 9])))
    for c, (turns, body) in said(rows).items():
        parts = sorted((r for r in made if r["conv_id"] == c), key=lambda r: r["chunk"])
        ids, mask = [i for r in parts for i in r["input_ids"]], [m for r in parts for m in r["loss_mask"]]
        assert [r["start"] for r in parts] == list(itertools.accumulate([0, *(len(r["input_ids"]) for r in parts)]))[:-1]
        want, loss = [t.mark["<s>"]], [False]
        for role, text in turns:
            opens, closes = chat.FRAMES.get(role, chat.OTHER)
            named = [] if role in chat.FRAMES else [*plain.encode(t.escape(role), add_special_tokens=False).ids, t.mark["[/ROLE]"]]
            own = plain.encode(t.escape(text), add_special_tokens=False).ids
            want += [t.mark[opens], *named, *own, t.mark[closes]]
            loss += [False] * (1 + len(named)) + [role == "assistant"] * len(own) + [False]
        assert (ids, mask) == (want, loss)
        assert "".join(chat.MARKS[i - t.base] if i >= t.base else "" for i in ids).startswith("<s>")
        marks = "".join(chat.MARKS[i - t.base] if i >= t.base else "\0" for i in ids)
        assert marks.count("<s>") == 1 and body.startswith("<s>")


def test_chat_escapes():
    t, r = chat.template(PATH), random.Random(3)
    pieces = ["<", "/", "s", ">", "\\", "[", "INST]", "/INST]", "<SYS>>", "</s>", "|endoftext|>", "x"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(12)))
        safe = t.escape(text)
        assert t.unescape(safe) == text
        assert not any(m in safe for m in (*chat.MARKS, *t.bpe.special))
        assert t.decode(np.frombuffer(t.encode(text), "<u4")) == safe


def test_chat_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(df, PATH), PATH).count() == 0


# spelling


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words: dict[str, int]) -> set[tuple]:
    found = {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= 10 * n else None
        found[w] = (form, n, len(others), words[form] if form else None)
    out = set()
    for w, (form, *rest) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.add((w, form, root, *rest))
    return out


def vocabulary(seed: int) -> dict[str, int]:
    r = random.Random(seed)
    words = {"".join(p) for p in itertools.islice(itertools.permutations("abcdefg"), 0, 1500, 11)}
    words |= {"a" * k for k in (7, 8, 15, 16, 17, 18, 40, 41, 254, 255, 256, 257, 300)} | {"a" * 20 + "b", "a" * 19 + "q", "q" * 20 + "b", "aab" * 6, "aaab" * 5, "éàüßöäç", "éàüßöä", "éàüßöäçÿ", "÷×÷×÷×÷"}
    for w in list(words)[:150]:
        for _ in range(2):
            k = r.randrange(len(w))
            words.add(r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abqé") + w[k:], w[:k] + r.choice("abqé") + w[k + 1 :]]))
    return {w: r.choice([2, 2, 3, 9, 20, 30, 200, 3000, 30000]) for w in words}


@pytest.mark.parametrize("shard", [1, 20, spelling.SHARD])
def test_spelling_forms_and_roots(spark, shard):
    words = vocabulary(5)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(df, shard=shard).collect()}
    assert got == brute(words)


def test_spelling_large_leaf():
    """Words of one vector, more than are compared with each other."""
    words = sorted({"".join(p) for p in itertools.permutations("aaabbcd")} | {"".join(p) for p in itertools.permutations("aaaqbcd")})
    letters = spelling.Letters(pa.array(words))
    trie = spelling.Trie(np.zeros(len(words), np.int64), letters)
    assert max(np.diff(trie.leaf)) > spelling.LEAF
    q, e = spelling._pairs(trie, np.zeros(len(words), np.int64), np.zeros(len(words), bool), letters)
    assert sorted(tuple(sorted((words[a], words[b]))) for a, b in zip(q, e, strict=True)) == sorted((a, b) for a, b in itertools.combinations(words, 2) if near(a, b))


def test_spelling_of_texts(spark):
    r = random.Random(7)
    some = ["Zeitungen", "ZEITUNGEN", "zeitunge", "élanément", "short", "letter-box", "windowsill", "windowsil", "wimdowsill", "Ünlängst"]
    texts = [(k, " ".join(r.choice(some) for _ in range(60))) for k in range(40)] + [(None, "windowsill windowsill"), (3, "windowsill, " * 3), (3, "windowsill, " * 3), (99, None), (98, ""), (97, "a" * 5000 + " " + "a" * 5001)]
    counts: dict[str, int] = {}
    for i, t in texts:
        run = ""
        for c in (t or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x7f" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 7:
                    counts[run] = counts.get(run, 0) + 1
            run = ""
    want = brute({w: n for w, n in counts.items() if n >= 2})
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, word string, n int")
    got = spelling.grouped(df)
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got.collect()} == want
    assert spelling.grouped(df.filter("false")).count() == 0 and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


# codes


def coded(vectors: list[tuple], parts: int = 4) -> tuple[dict, str]:
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda t: (t[0] is None, t[0] or 0, t[1]))[:256]
    step = len(first[0][1]) // parts
    part = lambda v, p: v[p * step : (p + 1) * step]
    books = [[part(v, p) for _, v, _ in first] for p in range(parts)]

    def best(v: list[int], p: int) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), c, strict=True)), k) for k, c in enumerate(books[p]))

    for _ in range(4):
        hit: dict[tuple, list] = {}
        for _, v, _ in kept:
            for p in range(parts):
                hit.setdefault((p, best(v, p)[1]), []).append(part(v, p))
        for (p, k), rows in hit.items():
            books[p][k] = [sum(c) // len(rows) for c in zip(*rows, strict=True)]
    rows = [(i, "".join(f"{best(v, p)[1]:02x}" for p in range(parts)), sum(best(v, p)[0] for p in range(parts)), label) for i, v, label in kept]
    total: dict = {}
    for _, _, e, label in rows:
        total[label] = total.get(label, 0) + e
    return sorted(((i is not None, i or 0), c, e, total[label]) for i, c, e, label in rows), hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


@pytest.mark.parametrize("n", [3, 700])
def test_codes(spark, n):
    r = random.Random(n)
    vectors = [(k * 3 % n, [r.choice([r.gauss(0, 1), -0.25, 0.5, 20000.0 * r.random()]) if k % 9 == 0 else r.gauss(0, 0.3) for _ in range(8)], r.choice([None, 1, 2])) for k in range(n)]
    vectors += [(1, vectors[0][1], 1), (1, vectors[0][1], 1), (None, [0.1] * 8, None), (5, None, 1), (0, [None] * 8, 1), (0, [float("nan")] * 8, 1), (0, [float("inf")] + [0.0] * 7, 1), (0, [-math.inf] * 8, 2)]
    df = spark.createDataFrame([(i, v, label, "c", 1) for i, v, label in vectors], "vec_id long, embedding array<double>, label int, code string, error int").repartition(4)
    rows = codes.compressed(df).collect()
    want, digest = coded(vectors)
    assert sorted(((r["vec_id"] is not None, r["vec_id"] or 0), r["code"], r["error"], r["label_error"]) for r in rows) == want
    assert {r["codebooks_sha256"] for r in rows} == {digest}


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert codes.compressed(spark.createDataFrame([], schema)).count() == 0
    assert codes.compressed(spark.createDataFrame([(1, None, "a"), (2, [float("nan")], "b")], schema)).count() == 0
    assert [tuple(r)[:4] for r in codes.compressed(spark.createDataFrame([(1, [], "a"), (2, [], None)], schema)).orderBy("vec_id").collect()] == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]
    for odd in ([(1, [0.0] * 6, "a")], [(1, [0.0] * 4, "a"), (2, [0.0] * 8, "a")], [(1, [1e30] * 4, "a")]):
        with pytest.raises(Exception, match="components"):
            codes.compressed(spark.createDataFrame(odd, schema)).count()


# archives


def test_warc_chunks_over_several_splits(spark):
    """A page's chunks lie in row groups that different tasks read."""
    text = base64.b64encode(random.Random(1).randbytes(9_000_000)).decode()
    data = [(1, "u", text), (2, "u", "short"), (3, "v", text[:5_000_000]), (4, "v", text[:5_000_000]), (5, None, None)]
    conf, before = spark._jsc.hadoopConfiguration(), spark.conf.get("spark.sql.files.maxPartitionBytes")
    conf.set("parquet.block.row.count.limit", "3")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        rows = warc.round_trip(spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1)).collect()
    finally:
        conf.unset("parquet.block.row.count.limit")
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted(map(tuple, rows)) == [(i, len(t or ""), sha(t), "revisit" if i == 3 else "response", 4 if i == 3 else None) for i, _, t in data]
