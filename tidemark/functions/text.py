"""Scalar functions over message headers, paths, flags and sizes, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from email.errors import HeaderParseError
from email.header import decode_header
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The letters of file-name flags and the keywords of the server.
KEYWORDS = {"D": "$draft", "F": "$flagged", "P": "$forwarded", "R": "$answered", "S": "$seen", "T": "$deleted"}


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def unfolded_header(headers: Column, name: str) -> Column:
    """Value of a header, its folded lines joined; null if there is none."""
    lines = F.regexp_replace(headers, r"\r?\n[ \t]+", " ")
    return F.nullif(F.regexp_extract(lines, rf"(?im)^{name}:[ \t]*(.*?)\r?$", 1), F.lit(""))


def _decoded(value: str) -> str:
    parts = []
    try:
        for piece, charset in decode_header(value):
            parts.append(piece if isinstance(piece, str) else piece.decode(charset or "ascii", "replace"))
    except (HeaderParseError, LookupError):
        return value
    return "".join(parts)


@F.pandas_udf(StringType())
def _decoded_words(values: pd.Series) -> pd.Series:
    return values.map(_decoded, na_action="ignore")


def subject(headers: Column) -> Column:
    """The subject with its encoded words (RFC 2047) decoded, trimmed; null if empty. Only values with such words go through Python."""
    raw = unfolded_header(headers, "Subject")
    return blank_to_null(F.coalesce(_decoded_words(F.when(F.contains(raw, F.lit("=?")), raw)), raw))


def header_section(content: Column, soft: int = 65_536, hard: int = 1_048_576) -> Column:
    """A message's headers up to and with the blank line after them, looked for in the first hard bytes; content within soft bytes that has none is headers all over; else null."""
    head = F.substring(content, 1, hard)
    ends = [F.when(F.locate(mark, head) > 0, F.locate(mark, head) + len(mark) - 1) for mark in ("\r\n\r\n", "\n\n")]
    end = F.least(*ends)
    return F.when(end.isNotNull(), F.substring(head, F.lit(1), end)).when(F.length(content) < soft, content)


def message_id(raw: Column) -> Column:
    """What stands between the first < and the last >, else the whole; trimmed, null if empty."""
    inner = F.regexp_extract(raw, r"(?s)<(.*)>", 1)
    return F.when(raw.rlike(r"(?s)<.*>"), blank_to_null(inner)).otherwise(blank_to_null(raw))


def flags_of(keywords: Column) -> Column:
    """Flag letters, in order, of a map of keywords."""
    return F.concat(*[F.when(F.coalesce(keywords[k], F.lit(False)), F.lit(f)).otherwise(F.lit("")) for f, k in KEYWORDS.items()])


def keywords_of(flags: Column) -> Column:
    """All six keywords as a map, true where the letter is in flags."""
    return F.create_map(*[x for f, k in KEYWORDS.items() for x in (F.lit(k), F.contains(flags, F.lit(f)))])


def patched(base: Column, patch: Column) -> Column:
    """A map of keywords after a patch: true sets, false removes, others stay; a null base is empty."""
    empty = F.create_map().cast("map<string,boolean>")
    both = F.map_zip_with(F.coalesce(base, empty), F.coalesce(patch, empty), lambda k, old, new: F.coalesce(new, old))
    return F.map_filter(both, lambda k, v: v)


def same_or_extended(a: Column, b: Column) -> Column:
    """Whether one file name is the other, or goes on with a comma after it."""
    return (a == b) | b.startswith(F.concat(a, F.lit(","))) | a.startswith(F.concat(b, F.lit(",")))


def event_path(path: Column) -> Column:
    """struct(folder, subdir, id, flags) of a message's path; null if it isn't one."""
    def part(sub: str, n: int) -> Column:
        return F.regexp_extract(path, rf"^(.*)/{sub}/([^/]*)$", n)
    def of(sub: str) -> Column:
        name = part(sub, 2)
        cut = F.instr(name, ":2,")
        own = F.when(cut > 0, F.substring(name, F.lit(1), cut - 1)).otherwise(name)
        flags = F.when(cut > 0, F.substring(name, cut + 3, F.length(name))).otherwise(F.lit(""))
        return F.when((part(sub, 1) != "") & (own != ""), F.struct(part(sub, 1).alias("folder"), F.lit(sub).alias("subdir"), own.alias("id"), flags.alias("flags")))
    return F.coalesce(of("cur"), of("new"))


def crlf(text: Column) -> Column:
    """Text whose line ends are all CR LF."""
    return F.regexp_replace(text, r"(?<!\r)\n", "\r\n")


def email_domain(email: Column) -> Column:
    return F.when(F.contains(email, F.lit("@")), F.nullif(F.substring_index(email, "@", -1), F.lit("")))


def expanded(template: Column, values: dict[str, Column]) -> Column:
    """A URL template with {name} replaced; one without braces gets the values as its query."""
    out = template
    for k, v in values.items():
        out = F.replace(out, F.lit(f"{{{k}}}"), v)
    query = F.concat(template, F.lit("?"), F.concat_ws("&", *[F.concat(F.lit(f"{k}="), v) for k, v in values.items()]))
    return F.when(F.contains(template, F.lit("{")), out).otherwise(query)


def ellipsis(text: Column, limit: int) -> Column:
    """text in at most limit characters, the last one … if something is missing; with a limit of 1 without it."""
    if limit <= 0:
        return F.lit("")
    return F.when(F.length(text) <= limit, text).otherwise(F.left(text, F.lit(1)) if limit == 1 else F.concat(F.left(text, F.lit(limit - 1)), F.lit("…")))


def human_bytes(n: Column) -> Column:
    """Bytes in B, or KB, MB and GB of 1,024 with one decimal, rounded by the exact value of the quotient as a double."""
    step = lambda k, unit: F.concat(one_decimal(n / F.lit(float(1024**k))), F.lit(f" {unit}"))
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, step(1, "KB")).when(n < 1024**3, step(2, "MB")).otherwise(step(3, "GB"))


def signed_bytes(n: Column) -> Column:
    """human_bytes with a sign before it: a change of size."""
    return F.concat(F.when(n < 0, "-").otherwise("+"), human_bytes(F.abs(n)))


def human_rate(per_second: Column) -> Column:
    """Bytes a second as whole B, halves to the even one, or KB and MB with one decimal."""
    r = per_second.cast("double")
    step = lambda k, unit: F.concat(one_decimal(r / F.lit(float(1024**k))), F.lit(f" {unit}"))
    return F.when(r >= 1024**2, step(2, "MB")).when(r >= 1024, step(1, "KB")).otherwise(F.concat(F.rint(r).cast("long").cast("string"), F.lit(" B")))


def state_map(data: Column) -> Column:
    """The changed states of an event's data, account by account and type by type; null if it isn't JSON or has none."""
    return F.from_json(data, "changed map<string, map<string, string>>").getField("changed")


def leaves(path: Column) -> Column:
    """Whether a path that is taken below a folder goes out of it: absolute ones, and those that at some place have gone up further than down."""
    step = lambda p: F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)
    low = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, p: F.struct((a["at"] + step(p)).alias("at"), F.least(a["low"], a["at"] + step(p)).alias("low")), lambda a: a["low"])
    return path.startswith("/") | (low < 0)


def ago(seconds: Column) -> Column:
    """A duration in whole seconds, minutes, hours or days; the future is 0s."""
    s = F.greatest(seconds, F.lit(0)).cast("long")
    whole = lambda unit, n: F.concat(F.floor(s / n).cast("string"), F.lit(unit + " ago"))
    return F.when(s < 60, whole("s", 1)).when(s < 3600, whole("m", 60)).when(s < 86400, whole("h", 3600)).otherwise(whole("d", 86400))


def one_decimal(x: Column) -> Column:
    """A double of at least 1 with one decimal, rounded by its exact binary value, half to even."""
    bits = ((x - F.floor(x)) * F.lit(float(2**52))).cast("long") * 10
    tenth, rest = F.shiftright(bits, 52), bits.bitwiseAND(F.lit(2**52 - 1))
    up = (rest > 2**51) | ((rest == 2**51) & (tenth % 2 == 1))
    n = F.floor(x) * 10 + tenth + up.cast("int")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def eta(seconds: Column) -> Column:
    """~Ns below 90 s (1 at least), minutes rounded up below 5,400 s, else hours with one decimal."""
    return F.when(seconds < 90, F.concat(F.lit("~"), F.greatest(F.ceil(seconds), F.lit(1)).cast("string"), F.lit("s"))).when(
        seconds < 5400, F.concat(F.lit("~"), F.ceil(seconds / 60).cast("string"), F.lit("m"))
    ).otherwise(F.concat(F.lit("~"), one_decimal(seconds / 3600), F.lit("h")))


def clamp(configured: Column, server: Column) -> Column:
    """The smaller of two limits, at least 1; a missing server limit doesn't count."""
    return F.greatest(F.least(configured, F.coalesce(server, configured)), F.lit(1))


def percent(done: Column, total: Column) -> Column:
    """Whole percent; 0 of nothing is 0."""
    return F.when(total > 0, F.floor(done * 100 / total)).otherwise(F.lit(0)).cast("long")


def name_fault(name: Column, cap: int = 255) -> Column:
    """Why a mailbox can't have a name; null if it can."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "empty").when(F.octet_length(name) > cap, "too long").when(F.contains(name, F.lit("\0")), "NUL")
        .when(F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")), "separator").when(name.isin(".", ".."), "dots")
    )


def segment_fault(name: Column, layout: str, separator: str = ".") -> Column:
    """Why a name can't be a segment of a folder's path in a layout ('flat', 'maildir++', 'fs'); null if it can."""
    if layout == "fs":
        return F.when(name.isin("cur", "new", "tmp"), "reserved").when(name.startswith("."), "leading dot")
    fault = F.when(F.contains(name, F.lit(separator)), "separator")
    return fault.when(name.startswith("."), "leading dot") if layout == "maildir++" else fault


#: What this library's own files and folders begin with, after a dot and before a dot or a hyphen.
PRIVATE = "tidemark"


def is_private(name: Column, prefix: str = PRIVATE) -> Column:
    return name.startswith(f".{prefix}.") | name.startswith(f".{prefix}-")


def is_message_path(path: Column) -> Column:
    """A file in cur or new whose name begins with an ASCII digit."""
    return (F.contains(path, F.lit("/cur/")) | F.contains(path, F.lit("/new/"))) & F.substring_index(path, "/", -1).rlike("^[0-9]")


def is_structural_path(relative: Column, prefix: str = PRIVATE) -> Column:
    """A path below the root, without private parts, that isn't inside cur, new or tmp."""
    parts = F.split(relative, "/")
    inside = F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.isin("cur", "new", "tmp"))
    return (F.coalesce(relative, F.lit("")) != "") & ~F.exists(parts, lambda x: is_private(x, prefix)) & ~inside


def fires(relative: Column, exists: Column, parent_has_sentinel: Column, is_maildir: Column) -> Column:
    """Whether a structural path means a change: cur, new or tmp itself if it is missing or its folder has no sentinel; anything else if it is a maildir."""
    trio = F.substring_index(relative, "/", -1).isin("cur", "new", "tmp")
    return (relative != "") & F.when(trio, ~exists | ~parent_has_sentinel).otherwise(is_maildir)


#: What the text of a passing failure contains, kinds of a connection that died, and errors of methods and of single changes that pass.
PASSING = ("Request failed: Limit", "status 429", "status 502", "status 503", "status 504", "rateLimit", "timed out", "connection reset", "connection closed")
DEAD = ("ConnectionReset", "ConnectionAborted", "BrokenPipe", "UnexpectedEof", "Timeout", "Connect")
METHOD_ERRORS, CHANGE_ERRORS = ("serverUnavailable", "serverFail", "serverPartialFail"), ("rateLimit", "overQuota")


def is_transient(status: Column, message: Column, kind: Column | None = None, error: Column | None = None) -> Column:
    """Whether a failed request is worth another try. kind says where it failed: transport (error: how the connection ended), problem (by
    status), server (by the number that the message begins with), method and set (by the error's name). Else, and without a kind, status and message decide."""
    status_ok = lambda c: F.coalesce((c == 429) | ((c >= 500) & (c < 600)), F.lit(False))
    low = F.lower(F.coalesce(message, F.lit("")))
    said = F.exists(F.array(*[F.lit(x.lower()) for x in (*PASSING, "broken pipe")]), lambda x: F.contains(low, x))
    plain = status_ok(status) | said
    if kind is None:
        return plain
    one_of = lambda names: F.coalesce(error.isin(*names), F.lit(False))
    first = F.split(F.trim(message), r"\s+")[0].try_cast("int")
    return F.when(kind == "transport", one_of(DEAD)).when(kind == "problem", status_ok(status)).when(kind == "server", status_ok(first)).when(kind == "method", one_of(METHOD_ERRORS)).when(kind == "set", one_of(CHANGE_ERRORS)).otherwise(plain)


#: Roles that a mailbox can have.
ROLES = ("inbox", "sent", "drafts", "trash", "junk", "archive")


def role_of(raw: Column) -> Column:
    """A role in lower case; null for an unknown one."""
    return F.when(F.lower(raw).isin(*ROLES), F.lower(raw))


def toml_string(s: Column) -> Column:
    """A basic string of TOML: in quotes, quotes and backslashes escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def epoch_nanos(time: Column) -> Column:
    """Nanoseconds since 1970; 0 before, and the largest long where they don't fit."""
    micros = F.greatest(F.unix_micros(time.cast("timestamp")), F.lit(0))
    most = 2**63 - 1
    return F.when(micros > most // 1000, F.lit(most)).otherwise(F.least(micros, F.lit(most // 1000)) * 1000)


def write_ttl(debounce_seconds: Column, window_ms: Column) -> Column:
    """Seconds that an own write is remembered: twice debounce and window, rounded half up, at least 1."""
    return F.greatest(F.floor(((debounce_seconds * 1000 + window_ms) * 2 + 500) / 1000), F.lit(1)).cast("long")


def jittered(backoff: Column, seed: int | None = None) -> Column:
    """A wait drawn evenly from 0 up to the backoff."""
    return (F.rand() if seed is None else F.rand(seed)) * backoff


def resolved_url(base: Column, location: Column) -> Column:
    """location as seen from base. One with a scheme of its own, and one that is a path on the same host, need no Python."""
    @F.pandas_udf(StringType())
    def joined(b: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else urljoin(x, y) for x, y in zip(b, at, strict=True)], dtype=object)

    whole = location.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    rooted = location.rlike("^/(?!/)") & ~location.rlike(r"(^|/)\.\.?(/|$|[?#])")
    host = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    easy = F.when(whole, location).when(rooted & (host != ""), F.concat(host, location))
    return F.coalesce(easy, joined(F.when(easy.isNull(), base), F.when(easy.isNull(), location)))


def schema_verdict(exists: Column, version: Column, has_tables: Column, current: int) -> Column:
    """ok for no store, one of the current version or an empty one without a version; else stale."""
    return F.when(~exists | (version == current) | ((version == 0) & ~has_tables), "ok").otherwise("stale")


def first_fault(**required: Column) -> Column:
    """The name of the first column that is null or blank; null if none is."""
    blank: Callable[[Column], Column] = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.coalesce(*[F.when(blank(c), F.lit(n)) for n, c in required.items()])
