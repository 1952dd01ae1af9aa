"""URL filter: host and path rules, then a ratio of two character language models, in DataFrame operations only.

The models are Markov models of variable order: for accepted and for rejected URLs, the chance of a
character after the up to four before it, each order smoothed towards the one below by the number
of different characters that were seen after the context (Witten and Bell), so that an unseen
context leaves the choice to the shorter one. A URL's score is the difference of its log-likelihoods
divided by its length; the threshold is cross-validated: each labelled URL is scored by models that
didn't see it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

ORDER = 5
#: Characters that the lowest order shares its mass over.
ALPHABET = 128
START, END = "\u0002", "\u0003"
#: Labelled URLs are dealt into so many folds by their hash; a model leaves one of them out, and scores it for the threshold.
HELD_OUT = 5
#: The score table is broadcast up to so many rows of less than 100 bytes each; beyond that the join shuffles.
BROADCAST_ROWS = 200_000
#: The scores are counted in steps of 0.01 between these when the threshold is chosen.
SPAN = 1000

#: Words whose presence in a host marks a URL as an example of the rejected kind.
SEEDS = (
    "casino", "spam", "porn", "viagra", "poker", "lottery", "payday", "replica", "adult",
    "cialis", "onlinepharm", "cheappills", "betting", "gambl", "sportsbook", "freebets", "adserver", "adtrack", "doubleclick", "popunder",
)
#: Words that do the same where they stand alone, between characters that are no letters: inside others they may mean nothing (roads, alphabet).
PIECES = ("pill", "pills", "pharma", "pharmacy", "meds", "bet", "bets", "slots", "jackpot", "ad", "ads", "advert", "adverts", "banner", "banners", "sex", "xxx")
#: Words that stand alone in hosts of both kinds: without one of the above such a URL is an example of neither. Every other URL is one of the accepted kind.
DOUBTS = ("cheap", "free", "win", "winner", "bonus", "deals", "promo", "offer", "offers", "click", "clicks", "track", "tracker", "tracking", "traffic", "loan", "loans", "cash", "dating")
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or end, A-Z in lower case; path: then up to ?, # or end. Null or no ://: empty."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def query_and_fragment(url: Column) -> Column:
    """What follows the path, from the first ? or # on. Null or no ://: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does. A rule fits its host and all subdomains below its path."""
    found, verdict = [], []
    for kind, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        cut = rule.index("/")
        fits = ((host == rule[:cut]) | host.endswith("." + rule[:cut])) & path.startswith(rule[cut:])
        found.append(F.when(fits, F.lit(rule)))
        verdict.append(F.when(fits, F.lit(kind)))
    none = F.lit(None).cast("string")
    return F.coalesce(*found, none), F.coalesce(*verdict, none)


def grams(urls: DataFrame, url: str) -> DataFrame:
    """urls with a row for each character of url and its end: gram is the character after ORDER - 1 before it."""
    padded = F.concat(F.lit(START * (ORDER - 1)), F.col(url), F.lit(END))
    return urls.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), F.length(url) + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))))


@dataclass
class UrlModel:
    scores: DataFrame
    rows: int
    threshold: float

    def score(self, urls: DataFrame, url: str) -> DataFrame:
        """(url, score) for each different url: log-likelihood if rejected less that if accepted, per character."""
        scores = F.broadcast(self.scores) if self.rows <= BROADCAST_ROWS else self.scores
        each = grams(urls.select(url).distinct(), url).join(scores, "gram", "left")
        return each.groupBy(url).agg(F.round(F.sum(F.coalesce("ratio", F.lit(0.0))) / F.count("*"), 6).alias("score"))


def _order(counts: DataFrame, k: int) -> DataFrame:
    """Counts of the last k characters of each gram, with the sum and the number of different characters by context."""
    c = counts.groupBy("left_out", F.expr(f"right(gram, {k})").alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    w = Window.partitionBy("left_out", F.expr(f"left(gram, {k - 1})"))
    for x in "ar":
        c = c.withColumn(f"n{x}", F.sum(x).over(w)).withColumn(f"t{x}", F.sum((F.col(x) > 0).cast("long")).over(w))
    return c


def _scores(known: DataFrame) -> DataFrame:
    """(left_out, gram, ratio) of the models without each of the folds of known (u, bad, fold, count)."""
    counts = grams(known, "u").groupBy("fold", "gram").agg(F.sum(F.when(F.col("bad"), 0).otherwise(F.col("count"))).alias("a"), F.sum(F.when(F.col("bad"), F.col("count")).otherwise(0)).alias("r"))
    counts = written(counts, "url-grams")
    used = lambda x: F.sum(F.when(F.col("fold") == F.col("left_out"), 0).otherwise(F.col(x))).alias(x)
    counts = counts.withColumn("left_out", F.explode(F.array(*[F.lit(i) for i in range(HELD_OUT)]))).groupBy("left_out", "gram").agg(used("a"), used("r"))
    counts = written(counts, "url-counts")
    below = None
    for k in range(1, ORDER + 1):
        now = _order(counts, k)
        if below is None:
            now = now.withColumn("pa0", F.lit(1 / ALPHABET)).withColumn("pr0", F.lit(1 / ALPHABET))
        else:
            now = now.withColumn("low", F.expr(f"right(gram, {k - 1})")).join(below, ["left_out", "low"])
        for x in "ar":
            n, t = F.col(f"n{x}"), F.col(f"t{x}")
            p = F.when(n + t > 0, (F.col(x) + t * F.col(f"p{x}0")) / (n + t)).otherwise(F.col(f"p{x}0"))
            now = now.withColumn(f"p{x}", p)
        below = now.select("left_out", F.col("gram").alias("low"), F.col("pa").alias("pa0"), F.col("pr").alias("pr0"))
    return written(below.select("left_out", F.col("low").alias("gram"), (F.ln("pr0") - F.ln("pa0")).alias("ratio")), "url-scores")


def _bins(model: UrlModel, known: DataFrame) -> list[tuple[int, int, int]]:
    """(step, accepted, rejected): the rows of known by their score under model."""
    rows = known.join(model.score(known, "u"), "u")
    step = F.greatest(F.least(F.floor(F.col("score") * 100), F.lit(SPAN)), F.lit(-SPAN)).cast("int")
    return [tuple(r) for r in rows.groupBy(step.alias("step")).agg(F.sum(F.when(F.col("bad"), 0).otherwise(F.col("count"))), F.sum(F.when(F.col("bad"), F.col("count")).otherwise(0))).collect()]


def fit(urls: DataFrame, url: str, rejected: str) -> UrlModel:
    """The models of all rows of urls (string url, boolean rejected; null: an example of neither kind) but one fold.

    The score table has each gram that occurs, of either kind. The threshold is calibrated on the scores of each fold under the models
    without it; if rejected URLs are in one fold only, on those of the model returned, which then has that fold. Empty urls say
    nothing and are left out. With one kind only, or no rows, the threshold is infinite: nothing is rejected.
    """
    known = urls.filter((F.length(url) > 0) & F.col(rejected).isNotNull()).select(F.col(url).alias("u"), F.col(rejected).alias("bad")).groupBy("u", "bad").count()
    known = known.withColumn("fold", F.pmod(F.conv(F.substring(F.md5("u"), 1, 8), 16, 10).cast("long"), F.lit(HELD_OUT)).cast("int"))
    known = written(known, "url-examples")
    scores = _scores(known)
    rows = dict(scores.groupBy("left_out").count().collect())
    models = {i: UrlModel(scores.filter(F.col("left_out") == i).select("gram", "ratio"), rows.get(i, 0), float("inf")) for i in range(HELD_OUT)}
    kinds = {(r["fold"], r["bad"]) for r in known.select("fold", "bad").distinct().collect()}
    whole = [i for i in models if {bad for fold, bad in kinds if fold != i} == {True, False}]
    if not whole:
        return models[0]
    model = models[whole[0]]
    bins = [b for i in whole for b in _bins(models[i], known.filter(F.col("fold") == i))]
    if not any(b[1] for b in bins) or not any(b[2] for b in bins):
        bins = _bins(model, known)
    model.threshold = calibrate(bins)
    return model


def calibrate(bins: Sequence[tuple[int, int, int]]) -> float:
    """The score with the largest difference of the two kinds' shares at or above it; in the middle, if a stretch of scores does equally well."""
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not good or not bad:
        return float("inf")
    by_step: dict[int, tuple[int, int]] = {}
    for s, g, b in bins:
        by_step[s] = (by_step.get(s, (0, 0))[0] + g, by_step.get(s, (0, 0))[1] + b)
    g = b = 0
    best: list[tuple[float, int]] = []
    for step in range(max(by_step), min(by_step) - 1, -1):
        g, b = g + by_step.get(step, (0, 0))[0], b + by_step.get(step, (0, 0))[1]
        best.append((b / bad - g / good, step))
    top = max(x for x, _ in best)
    steps = [s for x, s in best if x == top]
    return round((max(steps) + min(steps)) / 200, 4)


def seeded(host: Column, seeds: Sequence[str] = SEEDS) -> Column:
    return F.exists(F.array(*[F.lit(s) for s in seeds]), lambda s: F.contains(host, s))


def example(host: Column, seeds: Sequence[str] = SEEDS) -> Column:
    """Whether URLs of this host are examples of the rejected kind; null where it is in doubt."""
    pieces = F.split(host, "[^a-z]+")
    has = lambda words: F.arrays_overlap(pieces, F.array(*[F.lit(x) for x in words]))
    return F.when(seeded(host, seeds) | has(PIECES), F.lit(True)).when(~has(DOUBTS), F.lit(False))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """One row per page: id, host, path, rule, verdict (the rule's, else block from the calibrated score on), score, threshold.

    The score is of host, path, query and fragment in lower case; an empty one has none and is allowed. Every row whose kind isn't
    in doubt is an example, those that a rule decides too. Null urls have an empty host and path.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), F.lower(F.concat(host, path, query_and_fragment(F.col(url_col)))).alias("u"))
    model = fit(rows.select("u", example(F.col("host"), seeds).alias("bad")), "u", "bad")
    scored = model.score(rows.filter("u <> ''"), "u")
    rule, said = match_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= F.lit(model.threshold), "block").otherwise("allow")
    return rows.join(scored, "u", "left").select(id_col, "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), "score", F.lit(model.threshold).alias("threshold"))
