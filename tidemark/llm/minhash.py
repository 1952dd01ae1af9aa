"""Near duplicates by HyperMinHash: compressed registers in bands, then verification on full sets.

A document's set has its distinct shingles of five words. For each of REGISTERS hash functions the
least value over the set is kept as its count of leading zeros and the MANTISSA bits after them,
16 bits in all. Four registers make a band; documents that agree in a band are candidates, their
likeness is estimated from the share of equal registers less the share expected by chance, and
those near the threshold or above it are compared on their whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import first_of_repeats, only, small_batches, text_of, without, written

WORDS = 5
SHARE = 75
ROWS, BANDS = 4, 36
REGISTERS = ROWS * BANDS
MANTISSA = 10
#: A pair is compared on its sets from this estimated likeness on: five standard deviations below SHARE.
LEAST_ESTIMATE = 0.75 - 5 * (0.75 * 0.25 / REGISTERS) ** 0.5
#: Hash functions there are; a signature takes the first REGISTERS of them.
FINE = 1024
#: Documents and shingles in a block of a cloud, about: two blocks of 64-bit hashes are in a task's memory at once.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 19
#: Columns of the matrices by whose product common shingles are counted.
COLUMNS = 4096
_rng = np.random.default_rng(7)
_MIX = _rng.integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)
_FLIP = _rng.integers(0, 2**32, FINE, dtype=np.uint32)
_ODD = _rng.integers(0, 2**32, FINE, dtype=np.uint32) | np.uint32(1)
#: Shingles that are hashed together: as many as the processor's cache holds.
BLOCK = 1 << 15
#: Different words whose hashes a task remembers.
REMEMBERED = 300_000


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[5]
    h = (h ^ (h >> np.uint64(29))) * _MIX[6]
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. Words: runs of anything but ASCII blanks, A-Z lower-cased.

    With fewer than WORDS words the whole sequence is one shingle; without words there is none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h += w[j : len(w) - k + 1 + j] * _MIX[j]
    return np.unique(mix(h))


def registers(sets: list[np.ndarray], count: int = REGISTERS) -> np.ndarray:
    """One row of count 16-bit registers for each set; those of an empty set mean nothing."""
    least = np.full((count, len(sets)), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        end, n = at, 0
        while end < len(full) and (n == 0 or n + len(sets[full[end]]) <= BLOCK):
            n += len(sets[full[end]])
            end += 1
        own = full[at:end]
        h = np.concatenate([sets[i] for i in own]) if len(own) > 1 else sets[own[0]]
        for lo in range(0, len(h), BLOCK):  # more than one step only for a single long set
            part = (h[lo : lo + BLOCK] >> np.uint64(32)).astype(np.uint32)
            starts = np.cumsum([0] + [len(sets[i]) for i in own[:-1]]) if len(own) > 1 else np.array([0])
            for r in range(count):
                m = np.minimum.reduceat((part ^ _FLIP[r]) * _ODD[r], starts)
                least[r, own] = np.minimum(least[r, own], m)
        at = end
    return compress(least.T)


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and the MANTISSA bits after the first one bit."""
    x = least.astype(np.uint64)
    length = np.frexp(x.astype(np.float64))[1]
    shifted = np.where(length > 0, x << (32 - length).clip(0).astype(np.uint64), 0)
    mantissa = (shifted >> np.uint64(31 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return (((32 - length).astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard likeness from equal registers, corrected for those that two unrelated sets of these sizes share by chance.

    Two least values are about exponential with rates n_a and n_b, and a register's cell is on average
    1 / (2 ln 2) x 2**-MANTISSA of the value wide: so n_a n_b / (n_a + n_b)**2 times that width agree.
    """
    same = (a == b).mean(axis=-1)
    chance = 0.7213 * 2.0**-MANTISSA * (n_a * n_b) / np.maximum((n_a + n_b).astype(float) ** 2, 1)
    return (same - chance) / (1 - chance)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingles(t, hashes) for t in batch["t"].to_pylist()]
        regs = registers(sets)
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())], ["id", "n", "digest", "regs"])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n shingles, digest of the whole set, registers) of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(_signed, "id long, n long, digest binary, regs binary")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingles(t, hashes).tobytes() for t in batch["t"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sets, pa.binary())], ["id", "set"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, na, nb, ra, rb) whose estimate reaches LEAST_ESTIMATE."""
    for batch in batches:
        if batch.num_rows:
            ra, rb = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("ra", "rb"))
            keep = estimate(ra, rb, batch["na"].to_numpy(), batch["nb"].to_numpy()) >= LEAST_ESTIMATE
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, sa, sb) whose sets reach SHARE percent."""
    for batch in batches:
        keep = []
        for x, y in zip(batch["sa"], batch["sb"], strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= SHARE * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of left has in common with each of right (none: of left; a set with itself counts what others have too)."""
    values = [np.concatenate(side) for side in (left, right or left)]
    owners = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right or left)]
    if right:
        shared = np.intersect1d(*values)
    else:
        shared, times = np.unique(values[0], return_counts=True)
        shared = shared[times > 1]
    places = [np.searchsorted(shared, v) for v in values]
    hits = [np.flatnonzero(shared[np.minimum(p, len(shared) - 1)] == v) if len(shared) else p[:0] for p, v in zip(places, values, strict=True)]
    owners, places = ([x[h] for x, h in zip(xs, hits, strict=True)] for xs in (owners, places))
    counts = np.zeros((len(left), len(right or left)))
    for lo in range(0, len(shared), COLUMNS):
        sides = []
        for owner, place, side in zip(owners, places, (left, right or left), strict=True):
            here = (place >= lo) & (place < lo + COLUMNS)
            m = np.zeros((len(side), COLUMNS), np.float32)
            m[owner[here], place[here] - lo] = 1
            sides.append(m)
        counts += sides[0] @ sides[1].T
    return counts.astype(np.int64)


def spanning_links(left: list[tuple], right: list[tuple]) -> list[tuple[int, int]]:
    """Of the links of (id, label, set) of left with those of right (none: among left), as many as join different labels, and no more."""
    nodes = left + right
    label = np.unique([x[1] for x in nodes], return_inverse=True)[1]
    if label.max() == 0:
        return []
    sets = [x[2] for x in nodes]
    n = np.array([len(s) for s in sets])
    both = common(sets[: len(left)], sets[len(left) :])
    linked = 100 * both >= SHARE * (n[: len(left), None] + (n[None, len(left) :] if right else n[None, :]) - both)
    mates = [np.flatnonzero(label == k) for k in range(label.max() + 1)]
    seen, out = np.zeros(len(mates), bool), []
    for root in range(len(mates)):
        if seen[root]:
            continue
        seen[root] = True
        waiting = mates[root].tolist()
        while waiting:
            i = waiting.pop()
            near = np.flatnonzero(linked[i]) + len(left) * bool(right) if i < len(left) else np.flatnonzero(linked[:, i - len(left)])
            for j in near[~seen[label[near]]].tolist():
                if not seen[label[j]]:
                    seen[label[j]] = True
                    waiting += mates[label[j]].tolist()
                    out.append((nodes[i][0], nodes[j][0]))
    return out


def _links_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b), the spanning links of each two blocks, from rows (cloud, x, y, right, id, label, set) in the order of the first four."""
    key, left, right = None, [], []

    def found() -> pa.RecordBatch:
        links = spanning_links(left, right) if left and (right or key[1] == key[2]) else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("cloud", "x", "y", "right", "id", "label")]
        for cloud, x, y, is_right, i, label, hashes in zip(*columns, batch["set"], strict=True):
            if key != (cloud, x, y):
                if key:
                    yield found()
                key, left, right = (cloud, x, y), [], []
            (right if is_right else left).append((i, label, np.frombuffer(hashes.as_buffer(), np.uint64).copy()))
    if key:
        yield found()


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links. A pair moves with a's set; b's, often the same for many, stays where it is."""
    half = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    whole = half.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    return whole.select("a", "b", "sa", "sb").mapInArrow(_verified, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links), kept.

    Null, empty or blank texts have an empty set and link with nothing. Equal sets are one class from the start and
    only the class with the smallest id goes on. Within a band's group every class is compared with the group's smallest
    one, so that large groups cost as many pairs as they have members. What these links leave in different components
    of one group is compared by whole sets in blocks; see _rest.
    A null id takes no part in links and is a component of its own; rows repeated with one id fall together.
    """
    small_batches(docs.sparkSession)
    sigs = written(signatures(docs, id_col, text_col), "signatures")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    full = sigs.filter("n > 0 AND id IS NOT NULL")
    several = full.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("size")).filter("size > 1")
    several = written(several.select("digest", "rep"), "equal-sets")  # a table of its own, so that Spark splits the members of a large class
    first = F.col("id") == F.coalesce("rep", "id")
    reps = written(full.join(several, "digest", "left").filter(first).dropDuplicates(["id", "digest"]).select("id", "n", "regs"), "classes")
    band = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.substring("regs", 2 * ROWS * b + 1, 2 * ROWS).alias("key")) for b in range(BANDS)]))
    bands = reps.select("id", band.alias("x")).select("id", "x.band", "x.key")
    groups = written(bands.groupBy("band", "key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).filter("size > 1"), "groups")
    member = written(bands.join(groups, ["band", "key"]), "members")
    stars = member.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    near = written(_near(stars, reps), "candidates")
    links = written(_verify(near, _sets_of(near, texts)), "links")
    done = components(links)
    more = _rest(member, done, texts)
    if not more.isEmpty():
        done = components(links.union(more))
    named = sigs.select("id", "n", "digest").join(several, "digest", "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "id")))
    named = named.join(done.select(F.col("id").alias("rep"), "component"), "rep", "left")
    own = F.coalesce("component", "rep", "id")
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def _near(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    a = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    b = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimated, "a long, b long")


def _sets_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    return written(only(texts, ids).mapInArrow(_sets, "id long, set binary").dropDuplicates(["id"]), "sets")


def _rest(member: DataFrame, done: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between documents that share a group while they are in different components.

    Documents of such groups that are joined by a chain of groups are a cloud. Its most common component's documents needn't meet each
    other; all others meet every document of the cloud, block by block, where their whole sets are compared. Two blocks give out only
    what joins components: fewer links than they have components.
    """
    label = F.coalesce("component", "id").alias("label")
    open_ = member.join(done, "id", "left").select("id", "hub", "band", "key", label)
    mixed = open_.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    here = written(open_.join(mixed.select("band", "key"), ["band", "key"]).select("id", "hub", "label").distinct(), "mixed")
    if here.isEmpty():
        return here.select(F.col("id").alias("a"), F.col("hub").alias("b"))
    clouds = components(here.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("component", "cloud")
    sets = only(texts, here.select("id").distinct()).mapInArrow(_sets, "id long, set binary").dropDuplicates(["id"])
    rows = written(sets.join(here.select("id", "label").distinct(), "id").join(clouds, "id"), "clouds")
    size = F.octet_length("set") / 8
    sizes = rows.groupBy("cloud", "label").agg(F.count("*").alias("n"), F.sum(size).alias("shingles"))
    most = sizes.groupBy("cloud").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    blocks = lambda kind: F.ceil(F.greatest(F.sum(F.when(kind, F.col("n"))) / BLOCK_ROWS, F.sum(F.when(kind, F.col("shingles"))) / BLOCK_SHINGLES))
    main = F.col("label") == F.col("main")
    sizes = written(sizes.join(most, "cloud").groupBy("cloud", "main").agg(blocks(~main).alias("others"), blocks(main).alias("mains")), "cloud-sizes")
    rows = rows.join(sizes, "cloud")
    own = F.when(main, F.col("others") + F.pmod(F.xxhash64("id"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("id"), F.col("others")))
    last = F.when(main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    rows = rows.select("cloud", "id", "label", "set", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    rows = rows.select("cloud", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("right"), "id", "label", "set")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = rows.repartition(parts, "cloud", "x", "y").sortWithinPartitions("cloud", "x", "y", "right")
    return written(pairs.mapInArrow(_links_of_blocks, "a long, b long"), "links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id. Of repeated rows with that id, one stays.

    Rows without an id, and those whose id has several texts, take no part and all stay.
    """
    text = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    several = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__tidemark_several")).agg(F.min(text).alias("lo"), F.max(text).alias("hi"))
    several = written(several.filter("lo <> hi").select("__tidemark_several"), "several")
    if not several.isEmpty():
        same = docs[id_col] == several["__tidemark_several"]
        apart = docs.join(several, same, "left_semi")
        return drop_near_duplicates(docs.join(several, same, "left_anti"), id_col, text_col).unionByName(apart)
    near = near_duplicates(docs, id_col, text_col)
    dropped = near.filter("NOT kept").select(F.col(id_col).alias("id")).distinct()
    return first_of_repeats(without(docs, dropped, id_col), id_col)
