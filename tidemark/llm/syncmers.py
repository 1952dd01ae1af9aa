"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text's tokens are its words; where a script has no blanks, each ideograph is a token. Of all runs
of K tokens those are chosen whose least inner run of S tokens (by hash) stands first or last: a
choice that depends on nothing outside the run, so that equal passages choose equal anchors anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import text_of

K, S = 5, 2
#: Hashes in a fingerprint: the least ones of all anchors of the whole text.
SKETCH = 64
TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]+"
#: A class that has all characters of these scripts, and quickly shows that a text has none.
UNSPACED = r"[\u0E00-\u0E7F\u2E80-\uD7FF\uF900-\uFAFF\uFE30-\uFFFF\x{10000}-\x{10FFFF}]"
#: Ranges of the key in which documents are put in order: so many, or as many as the session has shuffle partitions.
BUCKETS = 256


def tokens(text: Column) -> Column:
    """The words of a text, and each character of a script without blanks. Texts without such characters are just split, which gives the same in a third of the time."""
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(UNSPACED)
    return F.when(plain, F.filter(F.split(text, r"\s+"), lambda w: w != "")).otherwise(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def with_anchors(df: DataFrame, text: Column, out: str) -> DataFrame:
    """df with the array out of (pos, hash): the text's closed syncmers, pos counted in tokens from 0.

    A text of fewer than K tokens has each token as an anchor; an empty one has none.
    """
    inner = K - S + 1
    df = df.withColumn("_h", F.transform(tokens(text), lambda w: F.xxhash64(w)))
    df = df.withColumn("_s", F.expr(f"CASE WHEN size(_h) >= {K} THEN transform(sequence(0, size(_h) - {S}), i -> xxhash64(_h[i], _h[i + 1])) END"))
    mid = ", ".join(f"_s[i + {j}]" for j in range(1, inner - 1))
    df = df.withColumn("_p", F.expr(f"CASE WHEN size(_h) >= {K} THEN filter(sequence(0, size(_h) - {K}), i -> least(_s[i], _s[i + {inner - 1}]) <= least({mid})) WHEN size(_h) > 0 THEN sequence(0, size(_h) - 1) ELSE array() END"))
    run = ", ".join(f"_h[i + {j}]" for j in range(K))
    df = df.withColumn(out, F.expr(f"transform(_p, i -> struct(i AS pos, CASE WHEN size(_h) >= {K} THEN xxhash64({run}) ELSE _h[i] END AS hash))"))
    return df.drop("_h", "_s", "_p")


def with_chain(df: DataFrame, text: Column, out: str) -> DataFrame:
    """df with the struct out of the text's anchors in order: h, their hashes, and g, how many tokens each stands before the next one."""
    df = with_anchors(df, text, "_anchors")
    gaps = F.expr("transform(sequence(0, greatest(size(_anchors) - 2, 0)), i -> CAST(least(coalesce(get(_anchors, i + 1).pos - _anchors[i].pos, 0), 127) AS TINYINT))")
    chain = F.struct(F.col("_anchors.hash").alias("h"), F.when(F.size("_anchors") > 1, gaps).otherwise(F.array().cast("array<tinyint>")).alias("g"))
    return df.withColumn(out, chain).drop("_anchors")


def hashes(chain: str) -> Column:
    """Each hash of a chain's anchors once."""
    return F.expr(f"array_distinct({chain}.h)")


def places(chain: str) -> Column:
    """What two texts share where the same anchors follow each other at the same distance: a hash of each anchor, the next one and the gap. A lone anchor stands for itself."""
    return F.expr(f"CASE WHEN size({chain}.h) > 1 THEN array_distinct(transform(sequence(0, size({chain}.h) - 2), i -> xxhash64({chain}.h[i], {chain}.h[i + 1], {chain}.g[i]))) ELSE {chain}.h END")


def sketch_of(hashes: Column) -> Column:
    """The SKETCH least 32-bit hashes, in order."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(hashes, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))))), 1, SKETCH)


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two texts by all their anchors (arrays of different hashes); 1 if neither has an anchor."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / F.greatest(union, F.lit(1)))


def bucket(key: Column, cuts: list[int]) -> Column:
    """How many of the rising cuts are below key: first by every wth one, then among the w from there on."""
    if not cuts:
        return F.lit(0)
    w = int(len(cuts) ** 0.5) + 1
    whole, coarse = (F.array(*[F.lit(c) for c in x]) for x in (cuts, cuts[::w]))
    below = lambda x: F.size(F.filter(x, lambda c: c < key))
    first = F.greatest(below(coarse) - 1, F.lit(0)) * w
    return first + below(F.slice(whole, first + 1, F.lit(w)))


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """df with next_text, of the row that follows by descending key (after the last: of the first).

    Rows are dealt into ranges of the key, followed inside a range by a window, and across ranges by
    the first row of the next range; what the driver sees is a key for each range. Equal keys follow by text.
    """
    n = max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted({int(c) for c in df.approxQuantile(key, [i / n for i in range(1, n)], 1 / (4 * n))})
    df = df.withColumn("_b", bucket(F.col(key), cuts))
    ends = {r["_b"]: r["hi"] for r in df.groupBy("_b").agg(F.max(key).alias("hi")).collect()}
    order = sorted(ends, reverse=True)
    follows = [(b, order[(i + 1) % len(order)]) for i, b in enumerate(order)]
    w = Window.partitionBy("_b").orderBy(F.col(key).desc(), F.col(text))
    df = df.withColumn("_lead", F.lead(text).over(w))
    firsts = df.sparkSession.createDataFrame([(b, ends[n]) for b, n in follows], "_b int, _first bigint")
    starts = df.select(F.col(key).alias("_first"), F.col(text).alias("_start")).filter(F.col("_first").isin([ends[n] for _, n in follows]))
    starts = starts.groupBy("_first").agg(F.min("_start").alias("_start"))
    jump = F.broadcast(firsts).join(starts, "_first").select("_b", "_start")
    df = df.join(jump, "_b", "left")
    return df.withColumn("next_text", F.coalesce("_lead", "_start")).drop("_b", "_lead", "_start")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, sketch, anchors (pos, hash) of the whole text. A null text is empty."""
    rows = docs.select(F.col(id_col), text_of(text_col).alias("_t"))
    rows = with_anchors(rows, F.col("_t"), "anchors")
    return rows.select(id_col, F.char_length("_t").cast("long").alias("n_chars"), sketch_of(F.col("anchors.hash")).alias("sketch"), "anchors")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likeness of all its anchors to the edited text's and to the next document's.

    near_ counts anchors wherever they stand; placed_ counts only those that the same anchor follows at the same distance in both texts, so that
    common phrases in another order don't count. Edited: the last third of the code points, rounded down, gives way to as many (or all) of the next
    document's first ones. A null id stands last in descending order; a null text is empty.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_k"), text_of(text_col).alias("_t"))
    rows = with_next(rows, "_k", "_t")
    n = F.char_length("_t")
    rows = rows.withColumn("_m", F.floor(n / 3).cast("int"))
    edited = F.concat(F.substring("_t", F.lit(1), n - F.col("_m")), F.substring("next_text", F.lit(1), F.col("_m")))
    rows = rows.select(id_col, n.cast("long").alias("n_chars"), "_t", edited.alias("_e"), F.col("next_text").alias("_x"))
    for text, chain in (("_t", "_a"), ("_e", "_b"), ("_x", "_n")):
        rows = with_chain(rows, F.col(text), chain)
    rows = rows.select(id_col, "n_chars", "_e", *[f(f"_{c}").alias(f"_{c}{k}") for c in "abn" for k, f in (("h", hashes), ("p", places))])
    return rows.select(
        id_col, "n_chars", F.sha2("_e", 256).alias("edited_sha256"), as_text(sketch_of(F.col("_ah"))).alias("fingerprint"), as_text(sketch_of(F.col("_bh"))).alias("edited_fingerprint"),
        likeness(F.col("_ah"), F.col("_bh")).alias("near_edited"), likeness(F.col("_ah"), F.col("_nh")).alias("near_next"),
        likeness(F.col("_ap"), F.col("_bp")).alias("placed_edited"), likeness(F.col("_ap"), F.col("_np")).alias("placed_next"),
    )
