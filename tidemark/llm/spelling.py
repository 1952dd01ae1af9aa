"""Spelling variants: words at an edit distance of one, found in tries of letter counts.

A word's vector says how many of its letters are in each of GROUPS groups; words are arranged in a trie by successive counts.
A search goes down the trie with the counts of a word and may once take a count one less (a deficit) and once one more (a surplus): a letter deleted,
inserted or replaced changes no more than that. Words at the leaf are then compared letter by letter.

The trie is too large for one task, so its upper levels are the shuffle's keys: a word is an entry of the task of its first counts, and goes as
a query to those of the counts that the upper levels of its search reach. How many levels those are is measured: as few as leave
no key over SHARD words. Nearness is symmetric, so that a search need find the shorter word of two, and of two words of one length either, once: a
surplus is only spent after a deficit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import BROADCAST_IDS, text_of, written

#: A letter's group is its code point modulo GROUPS. In keys counts stop at 15, in tries at 255; a search then finds more, never less.
GROUPS, CLIP, DEEP = 16, 15, 255
#: Words of one key, words of a leaf that are all compared, and rows that are searched for, and held on one level, at a time.
SHARD, LEAF, BATCH, FRAME = 1 << 12, 64, 1 << 15, 1 << 16
#: Letters that are compared at a time.
COMPARED = 1 << 22
LETTERS = "a-zÀ-ÿ"
LEAST, OCCURRENCES, RATIO, THINNED = 7, 2, 10, 31

ROUTED = "key long, query boolean, word string, n long"
NEAR = "word string, n_near long, best_n long, best string"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word) of each run of at least LEAST letters in texts, A to Z lower-cased. A run that goes on isn't cut."""
    lower = F.translate(text_of(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(f"[{LETTERS}]{{{LEAST},}}"), F.lit(0))).alias("word"))


def thinned(id_col: Column, word: Column, every: int = THINNED) -> Column:
    """word without one letter if the checksum of `<id>:<word>` is divisible by every, at that checksum modulo the length. A null id is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def counted(words: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of words (word) of at least so many letters and occurrences. Each task sends a word once."""
    return words.filter(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences)


class Letters:
    """Words of code points below 256, one byte each, in one long string."""

    def __init__(self, words: pa.Array):
        self.words = words
        raw = [w.encode("latin-1") for w in words.to_pylist()]
        self.length = np.fromiter(map(len, raw), np.int64, len(raw))
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def __len__(self) -> int:
        return len(self.length)

    def counts(self) -> np.ndarray:
        """Each word's letters by group."""
        owner = np.repeat(np.arange(len(self)), self.length)
        return np.bincount(owner * GROUPS + self.bytes % GROUPS, minlength=len(self) * GROUPS).reshape(-1, GROUPS)

    def half(self, i: int, shorter: int) -> tuple[bytes, bytes]:
        """The first half, and what is behind it in a word of shorter letters, which are the same letters of word i counted from its end."""
        raw, h = self.bytes[self.start[i] : self.start[i] + self.length[i]].tobytes(), shorter // 2
        return raw[:h], raw[len(raw) - (shorter - h) :]

    def matrix(self, at: np.ndarray, width: int) -> np.ndarray:
        """Words as rows of width letters; what is behind a word's end is zero."""
        k = np.arange(width)
        inside = k < self.length[at][:, None]
        return np.where(inside, self.bytes[np.where(inside, self.start[at][:, None] + k, 0)], 0)


def one_edit(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray) -> np.ndarray:
    """Whether words i of a become words j of b by one letter replaced or deleted. They have the same length, or those of a one letter more."""
    out = np.zeros(len(i), bool)
    order = np.argsort(a.length[i], kind="stable")
    at = 0
    while at < len(order):
        rows = max(1, COMPARED // max(int(a.length[i[order[at]]]), 1))
        part = order[at : at + rows]
        width = int(a.length[i[part]].max())
        part = part[: max(1, COMPARED // max(width, 1))]
        x, y = a.matrix(i[part], width), b.matrix(j[part], width)
        n = b.length[j[part]]
        inside = np.arange(width) < n[:, None]
        differ = (x != y) & inside
        shifted = np.zeros_like(differ)
        shifted[:, :-1] = (x[:, 1:] != y[:, :-1]) & inside[:, :-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), n)
        last = np.where(shifted.any(axis=1), width - 1 - shifted[:, ::-1].argmax(axis=1), -1)
        out[part] = np.where(a.length[i[part]] == n, differ.sum(axis=1) == 1, last < first)
        at += len(part)
    return out


class Trie:
    """Words by key and successive counts. Level by level it has the places of its nodes' children, as parent * (DEEP + 1) + count in order."""

    def __init__(self, keys: np.ndarray, letters: Letters):
        self.letters = letters
        counts = np.minimum(letters.counts(), DEEP)
        columns = [keys, *counts.T]
        self.order = np.lexsort(columns[::-1])
        new = np.zeros(len(keys), bool)
        new[:1] = True
        parent = np.zeros(len(keys), np.int64)
        self.levels: list[np.ndarray] = []
        for c in columns:
            c = c[self.order]
            new[1:] |= c[1:] != c[:-1]
            if not self.levels:
                self.keys = c[new]
                self.levels.append(self.keys)
            else:
                self.levels.append((parent * (DEEP + 1) + c)[new])
            parent = np.cumsum(new) - 1
        self.leaf = np.append(np.flatnonzero(new), len(keys))
        self.halves: dict[int, dict[tuple[int, bytes], list[int]]] = {}

    def search(self, keys: np.ndarray, queries: Letters) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, leaf, whether nothing was spent) of each leaf that a search for queries reaches, in parts; deepest first, so that few are held."""
        counts = np.minimum(queries.counts(), DEEP)
        at = np.searchsorted(self.keys, keys)
        q = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(0, np.int64)
        stack = [(1, q, at[q], np.zeros(len(q), np.int8))]
        while stack:
            level, q, node, spent = stack.pop()
            if len(q) > FRAME:
                h = len(q) // 2
                stack += [(level, q[h:], node[h:], spent[h:]), (level, q[:h], node[:h], spent[:h])]
                continue
            if level > GROUPS:
                yield q, node, spent == 0
                continue
            c = counts[q, level - 1]
            less, more = np.flatnonzero((spent == 0) & (c > 0)), np.flatnonzero(spent == 1)
            row = np.concatenate([np.arange(len(q)), less, more])
            want = node[row] * (DEEP + 1) + np.concatenate([c, c[less] - 1, c[more] + 1])
            then = np.concatenate([spent, np.ones(len(less), np.int8), np.full(len(more), 2, np.int8)])
            places = self.levels[level]
            child = np.minimum(np.searchsorted(places, want), len(places) - 1)
            there = np.flatnonzero((places[child] == want) & (np.concatenate([c, c[less] - 1, np.minimum(c[more] + 1, DEEP)]) == want % (DEEP + 1)))
            if len(there):
                stack.append((level + 1, q[row[there]], child[there], then[there]))

    def candidates(self, q: np.ndarray, leaf: np.ndarray, queries: Letters) -> tuple[np.ndarray, np.ndarray]:
        """(place in q, entry): words of small leaves, and of large ones those that share the first or the second half with the query, as two words one edit apart do."""
        size = self.leaf[leaf + 1] - self.leaf[leaf]
        small = np.flatnonzero(size <= LEAF)
        n = size[small]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, entry = [np.repeat(small, n)], [self.order[np.repeat(self.leaf[leaf[small]], n) + inside]]
        for k in np.flatnonzero(size > LEAF):
            halves = self._halves(int(leaf[k]))
            for shorter in (int(queries.length[q[k]]), int(queries.length[q[k]]) - 1):
                found = {e for side, h in enumerate(queries.half(q[k], shorter)) for e in halves.get((side, shorter, h), ())}
                at.append(np.full(len(found), k))
                entry.append(np.fromiter(found, np.int64, len(found)))
        return np.concatenate(at), np.concatenate(entry)

    def _halves(self, leaf: int) -> dict[tuple[int, int, bytes], list[int]]:
        if leaf not in self.halves:
            of: dict[tuple[int, int, bytes], list[int]] = {}
            for e in self.order[self.leaf[leaf] : self.leaf[leaf + 1]].tolist():
                n = int(self.letters.length[e])
                for side, h in enumerate(self.letters.half(e, n)):
                    of.setdefault((side, n, h), []).append(e)
            self.halves[leaf] = of
        return self.halves[leaf]


def _keys(counts: np.ndarray, depth: int) -> np.ndarray:
    """The first depth counts as one number, four bits each."""
    clipped = np.minimum(counts[:, :depth], CLIP).astype(np.uint64)
    return (clipped << (np.arange(depth, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _reached(counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, key) of the keys other than its own that a search for each word reaches: one count less, and perhaps a later one more."""
    out = []
    rows = np.arange(len(counts))
    for i in range(depth):
        less = rows[counts[:, i] > 0]
        down = counts[less].copy()
        down[:, i] -= 1
        out.append((less, _keys(down, depth)))
        for j in range(i + 1, depth):
            up = down.copy()
            up[:, j] += 1
            out.append((less, _keys(up, depth)))
    word, key = (np.concatenate([o[k] for o in out]) for k in range(2)) if out else (rows[:0], rows[:0])
    other = key != _keys(counts, depth)[word]
    if counts.size and counts.max() >= CLIP:  # counts that stop make some keys equal
        word, key = np.unique(np.stack([word[other], key[other]]), axis=1)
        return word, key
    return word[other], key[other]


def depth_of(words: DataFrame, shard: int) -> tuple[int, DataFrame, int]:
    """How many levels go into the key, so that no key has over shard words, or all of them; (key, n) of all levels; how many words the largest key then has."""
    def keyed(depth: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_keys(Letters(b["word"]).counts(), depth))], ["key"])

        return words.select("word").mapInArrow(run, "key long").groupBy("key").count()

    whole = written(keyed(GROUPS).withColumnRenamed("count", "n"), "vectors")
    for depth in range(2, GROUPS + 1):
        mask = F.lit(-1 if depth == GROUPS else (1 << 4 * depth) - 1)
        most = whole.groupBy(F.col("key").bitwiseAND(mask).alias("k")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= shard:
            break
    return depth, whole, most


def routed(words: DataFrame, depth: int) -> DataFrame:
    """ROUTED rows (key, query, word, n) of words (word, n): each as entry of its key, and as a query of the other keys that its search reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                counts = Letters(b["word"]).counts()
                word, key = _reached(counts, depth)
                word = np.concatenate([np.arange(b.num_rows), word])
                key = np.concatenate([_keys(counts, depth), key])
                query = np.arange(len(word)) >= b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(query), b["word"].take(pa.array(word)), b["n"].take(pa.array(word))], ["key", "query", "word", "n"])

    return words.mapInArrow(run, ROUTED)


def _rank(words: pa.Array) -> np.ndarray:
    """Places of words in code-point order."""
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    return rank


def _pairs(trie: Trie, keys: np.ndarray, second: np.ndarray, queries: Letters) -> tuple[np.ndarray, np.ndarray]:
    """(query, entry) of near words, each two words once. second: queries whose key is one of second halves; near words that share the first half too are left to that key."""
    entries, out = trie.letters, []
    for q, leaf, unspent in trie.search(keys, queries):
        at, e = trie.candidates(q, leaf, queries)
        more = queries.length[q[at]] - entries.length[e]
        keep = (more == 0) | (more == 1)
        at, e, more = at[keep], e[keep], more[keep]
        near = one_edit(queries, q[at], entries, e)
        at, e, more = at[near], e[near], more[near]
        keep = np.ones(len(at), bool)
        both = np.flatnonzero(unspent[at] & (more == 0))  # either word's search finds the other: the larger one's counts
        keep[both] = pc.greater(queries.words.take(pa.array(q[at[both]])), entries.words.take(pa.array(e[both]))).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(second[q[at]] & keep):
            n = int(entries.length[e[k]])
            keep[k] = queries.half(int(q[at[k]]), n)[0] != entries.half(int(e[k]), n)[0]
        out.append((q[at[keep]], e[keep]))
    return tuple(np.concatenate([p[k] for p in out]) if out else np.zeros(0, np.int64) for k in range(2))


def _best(of: Letters, own: np.ndarray, names: Letters, other: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """NEAR rows: for each word of `of` in own, how many others it has beside it, and which has the largest n."""
    order = np.lexsort((_rank(names.words)[other], -n[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    size = np.diff(np.append(first, len(own)))
    best = pa.array(other[first])
    return pa.RecordBatch.from_arrays([of.words.take(pa.array(own[first])), pa.array(size), pa.array(n).take(best), names.words.take(best)], ["word", "n_near", "best_n", "best"])


def searched(rows: DataFrame) -> DataFrame:
    """NEAR rows of ROUTED rows, those of a key following each other, entries first.

    Keys are taken together up to BATCH rows; of a larger one the entries are held and its queries searched for in parts.
    """

    def search(t: pa.Table, done: int) -> Iterator[pa.RecordBatch]:
        """All but the first done rows, against the entries."""
        t = t.combine_chunks()
        key, half = t["key"].to_numpy(), t["half"].to_numpy()
        shard = np.cumsum((np.diff(key, prepend=key[:1]) != 0) | (np.diff(half, prepend=half[:1]) != 0))
        n, words = t["n"].to_numpy(), t["word"].combine_chunks()
        entry, ask = np.flatnonzero(~t["query"].to_numpy()), np.arange(done, len(key))
        if not len(entry) or not len(ask):
            return
        trie, queries = Trie(shard[entry], Letters(words.take(pa.array(entry)))), Letters(words.take(pa.array(ask)))
        q, e = _pairs(trie, shard[ask], half[ask] & 3 == 2, queries)
        if len(q):
            yield _best(queries, q, trie.letters, e, n[entry])
            yield _best(trie.letters, e, queries, q, n[ask])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, 0  # rows whose turn is to come, and before them the entries of their first key that had theirs
        for b in batches:
            new = pa.Table.from_batches([b])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows - done < BATCH:
                continue
            key, half = held["key"].to_numpy(), held["half"].to_numpy()
            others = np.flatnonzero((key != key[-1]) | (half != half[-1]))
            if len(others):
                cut = int(others[-1]) + 1
                yield from search(held.slice(0, cut), done)
                held, done = held.slice(cut), 0
            elif held["query"][-1].as_py():
                yield from search(held, done)
                held = held.filter(pc.invert(held["query"]))
                done = held.num_rows
        if held is not None and held.num_rows > done:
            yield from search(held, done)

    return rows.mapInArrow(run, NEAR)


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n_near, best_n, best) of words (word, n; each once, of code points below 256) that have another word at an edit distance of one: how many, and the one of the largest n, of several the smallest."""
    depth, vectors, most = depth_of(words, shard)
    rows = routed(words, depth).withColumn("half", F.lit(0).cast("long"))
    if most > shard:  # so many words of one vector: they meet by halves
        hot = vectors.filter(F.col("n") > shard).select("key", F.lit(True).alias("hot"))
        split = lambda shorter: (half_key(1, F.substring("word", F.lit(1), (shorter / 2).cast("int")), shorter), half_key(2, F.right("word", shorter - (shorter / 2).cast("int")), shorter))
        n = F.char_length("word")
        own, all_of = F.array(*split(n)), F.array(*split(n), *split(n - 1))
        entry = rows.join(F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot, "key", "left")
        halves = F.when(F.col("hot").isNull(), F.array(F.struct("half", "query"))).when(F.col("query"), F.transform(all_of, lambda h: F.struct(h.alias("half"), F.lit(True).alias("query"))))
        halves = halves.otherwise(F.concat(F.transform(own, lambda h: F.struct(h.alias("half"), F.lit(False).alias("query"))), F.transform(F.slice(all_of, 3, 2), lambda h: F.struct(h.alias("half"), F.lit(True).alias("query")))))
        rows = entry.withColumn("to", F.explode(halves)).select("key", F.col("to.half").alias("half"), F.col("to.query").alias("query"), "word", "n")
    rows = rows.select("key", "half", "query", "word", "n").repartition("key", "half").sortWithinPartitions("key", "half", "query")
    best = F.min(F.struct((-F.col("best_n")).alias("least"), "best")).alias("m")
    near = searched(rows).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return near.select("word", "n_near", (-F.col("m.least")).alias("best_n"), F.col("m.best").alias("best"))


def half_key(side: int, letters: Column, n: Column) -> Column:
    return F.shiftleft(F.xxhash64(letters, n), 2).bitwiseOR(F.lit(side).cast("long"))


def rooted(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of forms (word, form), which go on for so many steps at most: the last form of each. A round doubles the known stretch."""
    links = written(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(max(steps - 1, 0).bit_length()):
        on = links.toDF("root", "then")
        links = written(links.join(on, "root", "left").select("word", F.coalesce("then", "root").alias("root")), "roots")
    return links


def variants(words: DataFrame, ratio: int = RATIO, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n; each once, of code points below 256): form is the near word of the largest n, the smallest of several, if that is at least ratio
    times n; root what forms lead to, the word itself without one. Without words there are no rows."""
    words = written(words, "words")
    near = near_words(words, shard)
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    found = written(found, "variants")
    span = words.agg(F.min("n"), F.max("n")).first()
    steps, n = 0, span[0]
    while n is not None and n * ratio <= span[1]:
        steps, n = steps + 1, n * ratio
    roots = rooted(found.filter("form IS NOT NULL"), steps)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """variants of the words of texts: runs of letters, thinned by their checksum. A null text has no words; repeated rows count each; other columns don't."""
    rows = runs(docs, id_col, text_col)
    return variants(counted(rows.select(thinned(F.col("id"), F.col("word")).alias("word"))))
