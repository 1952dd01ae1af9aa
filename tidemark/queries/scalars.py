"""Queries of scalar functions over columns derived from the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.registry import query
from tidemark.sources.tables import table, view, with_views


@query("SELECT doc_id, nullif(trim(regexp_extract(h, '(?s)<(.*)>', 1)), '') AS message_id FROM (SELECT doc_id, concat('  <', trim(text), '> x <', doc_id, '@y> ') AS h FROM documents)")
def msgid_extract(spark, d):
    raw = F.concat(F.lit("  <"), F.trim("text"), F.lit("> x <"), F.col("doc_id").cast("string"), F.lit("@y> "))
    return table(spark, d, "documents").select("doc_id", T.message_id(raw).alias("message_id"))


@query("SELECT doc_id, concat(source, ' ', lang) AS subject FROM documents")
def subject_extract(spark, d):
    headers = F.concat(F.lit("From: a@b\r\nSubject: "), F.col("source"), F.lit("\r\n  "), F.col("lang"), F.lit("\r\nTo: c\r\n"))
    return table(spark, d, "documents").select("doc_id", T.unfolded_header(headers, "Subject").alias("subject"))


@query("""
    SELECT doc_id, concat('/m/', source) AS folder, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE 'cur' END AS subdir, concat(doc_id, '.M1') AS id,
           CASE WHEN doc_id % 3 = 0 THEN 'S' ELSE '' END AS flags FROM documents WHERE doc_id % 7 <> 0
""")
def event_path_parse(spark, d):
    sub = F.when(F.col("doc_id") % 10 == 0, "new").otherwise("cur")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".M1"), F.when(F.col("doc_id") % 3 == 0, F.lit(":2,S")).otherwise(F.lit("")))
    path = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("/m/"), "source", F.lit("/tmp/x"))).otherwise(F.concat_ws("/", F.lit("/m"), "source", sub, name))
    return table(spark, d, "documents").select("doc_id", T.event_path(path).alias("p")).filter("p IS NOT NULL").select("doc_id", "p.folder", "p.subdir", "p.id", "p.flags")


@query(with_views("cached", sql="""
    SELECT email_id, flags, CASE WHEN contains(flags, 'R') THEN 1 ELSE 0 END + CASE WHEN contains(flags, 'F') THEN 1 ELSE 0 END + CASE WHEN contains(flags, 'S') THEN 1 ELSE 0 END AS n_keywords FROM cached
"""))
def flags_codec(spark, d):
    keywords = T.keywords_of(F.col("flags"))
    n = F.size(F.map_filter(keywords, lambda k, v: v))
    return view(spark, d, "cached").select("email_id", T.flags_of(keywords).alias("flags"), n.alias("n_keywords"))


@query("""
    SELECT event_id, concat_ws(',', CASE WHEN k % 2 = 0 AND event_id % 5 <> 0 OR event_id % 3 = 0 THEN '$flagged' END, CASE WHEN event_id % 5 = 0 OR k % 3 = 0 AND event_id % 3 <> 1 THEN '$seen' END) AS keywords
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
""")
def keyword_patch(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    base = F.from_json(F.when((k % 2 == 0) & (k % 3 == 0), '{"$flagged":true,"$seen":true}').when(k % 2 == 0, '{"$flagged":true}').when(k % 3 == 0, '{"$seen":true}').otherwise("{bad"), "map<string,boolean>")
    e = F.col("event_id")
    t, f = F.lit(True), F.lit(False)
    first = F.when(e % 3 == 0, F.create_map(F.lit("$flagged"), t)).when(e % 5 == 0, F.create_map(F.lit("$flagged"), f)).otherwise(F.create_map().cast("map<string,boolean>"))
    second = F.when(e % 5 == 0, F.create_map(F.lit("$seen"), t)).when(e % 3 == 1, F.create_map(F.lit("$seen"), f)).otherwise(F.create_map().cast("map<string,boolean>"))
    out = T.patched(T.patched(base, first), second)
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(out)), ",").alias("keywords"))


@query("SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10)) AS t FROM documents)")
def crlf_normalize(spark, d):
    t = T.crlf(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("digest"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN concat('h', c_nationkey, '.example') END AS domain FROM customer")
def email_domain(spark, d):
    k = F.col("c_custkey")
    mail = F.when(k % 4 == 0, F.concat(F.lit("u"), k.cast("string"))).otherwise(F.concat(F.lit("u@v"), k.cast("string"), F.lit("@h"), F.col("c_nationkey").cast("string"), F.lit(".example")))
    return table(spark, d, "customer").select("c_custkey", T.email_domain(mail).alias("domain"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('https://h/dl/p', page_id, '/', page_id % 9) ELSE concat('https://h/dl?blob=p', page_id, '&n=', page_id % 9) END AS url FROM pages")
def url_template(spark, d):
    p = F.col("page_id")
    template = F.when(p % 2 == 0, F.lit("https://h/dl/{blob}/{n}")).otherwise(F.lit("https://h/dl"))
    return table(spark, d, "pages").select("page_id", T.expanded(template, {"blob": F.concat(F.lit("p"), p.cast("string")), "n": (p % 9).cast("string")}).alias("url"))


@query("""
    SELECT doc_id, CASE WHEN length(text) <= 24 THEN text ELSE concat(substr(text, 1, 23), '…') END AS short, format('{:,}', n_chars * 1237) AS grouped,
           CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size
    FROM (SELECT *, n_chars * n_chars AS n FROM documents)
""")
def display_format(spark, d):
    n = F.col("n_chars") * F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", T.ellipsis(F.col("text"), 24).alias("short"), F.format_number(F.col("n_chars") * 1237, 0).alias("grouped"), T.human_bytes(n).alias("size"))


@query("""
    SELECT o_orderkey, CASE WHEN s < 60 THEN concat(s, 's ago') WHEN s < 3600 THEN concat(s // 60, 'm ago') WHEN s < 86400 THEN concat(s // 3600, 'h ago') ELSE concat(s // 86400, 'd ago') END AS ago
    FROM (SELECT o_orderkey, greatest(o_orderkey * o_custkey - 100, 0) AS s FROM orders)
""")
def ago_phrase(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.ago(F.col("o_orderkey") * F.col("o_custkey") - 100).alias("ago"))


@query("""
    SELECT o_orderkey, CASE WHEN s < 90 THEN concat('~', greatest(s, 1), 's') WHEN s < 5400 THEN concat('~', (s + 59) // 60, 'm') ELSE concat('~', printf('%.1f', s / 3600.0), 'h') END AS eta
    FROM (SELECT o_orderkey, o_orderkey * 18 AS s FROM orders)
""")
def eta_phrase(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.eta(F.col("o_orderkey") * 18).alias("eta"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0 ELSE (p_partkey % 100) * 100 // (p_size % 5 * 25) END AS pct FROM part")
def progress_pct(spark, d):
    return table(spark, d, "part").select("p_partkey", T.percent(F.col("p_partkey") % 100, F.col("p_size") % 5 * 25).alias("pct"))


@query("SELECT p_partkey, greatest(least(p_size, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_partkey % 40 END), 1) AS lim FROM part")
def clamp_limits(spark, d):
    server = F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 40)
    return table(spark, d, "part").select("p_partkey", T.clamp(F.col("p_size").cast("long"), server).alias("lim"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS state, CASE WHEN event_id % 4 = 0 AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS interval FROM events")
def sse_decode(spark, d):
    k = F.get_json_object("props", "$.k")
    data = F.concat(F.lit('{"@type":"StateChange","changed":{"acct":{"Email":"'), k, F.lit('"}},"interval":'), F.when(F.col("event_id") % 4 == 0, k).otherwise(F.lit('"x"')), F.lit("}"))
    every = F.get_json_object(data, "$.interval").try_cast("long")
    return table(spark, d, "events").select("event_id", F.get_json_object(data, "$.changed.acct.Email").cast("long").alias("state"), F.when(every > 0, every).alias("interval"))


@query("""
    SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'separator' WHEN 2 THEN 'dots' WHEN 3 THEN 'too long' END AS fault,
           CASE c_custkey % 3 WHEN 0 THEN 'inbox' WHEN 1 THEN 'sent' END AS role FROM customer
""")
def name_validation(spark, d):
    k = F.col("c_custkey") % 6
    name = F.when(k == 0, "").when(k == 1, F.concat("c_name", F.lit("/x"))).when(k == 2, "..").when(k == 3, F.repeat(F.lit("é"), 128)).otherwise(F.col("c_name"))
    raw = F.when(F.col("c_custkey") % 3 == 0, "INBOX").when(F.col("c_custkey") % 3 == 1, "Sent").otherwise("other")
    role = T.role_of(raw)
    return table(spark, d, "customer").select("c_custkey", T.name_fault(name).alias("fault"), role.alias("role"))


@query("""
    SELECT page_id, page_id % 3 = 0 AND page_id % 5 <> 0 AS message, page_id % 7 = 0 AS private
    FROM pages
""")
def event_path_filter(spark, d):
    p = F.col("page_id")
    sub = F.when(p % 3 == 0, F.when(p % 2 == 0, "cur").otherwise("new")).otherwise("tmp")
    path = F.concat(F.lit("/m/a/"), sub, F.lit("/"), F.when(p % 5 == 0, "x").otherwise(""), p.cast("string"))
    folder = F.concat(F.lit("a/"), F.when(p % 7 == 0, ".tidemark.lock").otherwise("b"), F.lit("/c"))
    return table(spark, d, "pages").select("page_id", T.is_message_path(path).alias("message"), F.exists(F.split(folder, "/"), lambda x: T.is_private(x)).alias("private"))


@query("""
    SELECT event_id, event_id % 6 IN (0, 1) OR event_type = 'error' AS transient FROM events
""")
def transient_errors(spark, d):
    e = F.col("event_id") % 6
    status = F.when(e == 0, 429).when(e == 1, 503).when(e == 2, 404)
    said = F.when(F.col("event_type") == "error", "Connection reset by peer").otherwise("no such id")
    return table(spark, d, "events").select("event_id", T.is_transient(status, said).alias("transient"))


@query("""
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Grüße ' || doc_id WHEN 1 THEN 'a b ' || doc_id WHEN 2 THEN '=?broken ' || doc_id END AS subject FROM documents
""")
def subject_decode(spark, d):
    """Subjects with encoded words, in base64 and quoted, whole or in two parts, and plain ones; blank ones are null."""
    k, text = F.col("doc_id"), F.col("doc_id").cast("string")
    coded = F.concat(F.lit("=?utf-8?B?R3LDvMOfZQ==?=\r\n =?utf-8?q?_"), text, F.lit("?="))
    value = F.when(k % 4 == 0, coded).when(k % 4 == 1, F.concat(F.lit(" a\r\n\tb "), text, F.lit("  "))).when(k % 4 == 2, F.concat(F.lit("=?broken "), text)).otherwise("  ")
    headers = F.concat(F.lit("From: x\r\nSubject: "), value, F.lit("\r\nTo: c\r\n"))
    return table(spark, d, "documents").select("doc_id", T.subject(headers).alias("subject"))


@query("""
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 26 WHEN doc_id % 4 = 1 THEN 13 WHEN n_chars < 300 AND doc_id % 4 = 2 THEN n_chars + 11 WHEN doc_id % 4 = 3 AND n_chars + 15 <= 3000 THEN n_chars + 15 END AS length
    FROM (SELECT doc_id, length(replace(text, chr(10), ' ')) AS n_chars FROM documents)
""")
def header_sections(spark, d):
    """Lengths of header sections: with blank lines of either kind, none in a short file, none in a long one, one that comes late."""
    k = F.col("doc_id")
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    content = F.when(k % 4 == 0, F.concat(F.lit("From: a\r\nTo: 123456789\r\n\r\n"), line)).when(k % 4 == 1, F.concat(F.lit("Subject: ab\n\n"), line)).when(k % 4 == 2, F.concat(F.lit("X-Comment: "), line)).otherwise(F.concat(F.lit("X-Comment: "), line, F.lit("\r\n\r\n"), F.repeat(F.lit("y"), 400)))
    return table(spark, d, "documents").select("doc_id", F.length(T.header_section(content, 311, 3000)).cast("long").alias("length"))


@query("""
    SELECT c_custkey, CASE WHEN k = 2 THEN 'separator' END AS flat, CASE k WHEN 1 THEN 'separator' WHEN 2 THEN 'separator' END AS plus, CASE k WHEN 0 THEN 'reserved' WHEN 1 THEN 'leading dot' END AS fs
    FROM (SELECT *, c_custkey % 4 AS k FROM customer)
""")
def segment_faults(spark, d):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, "cur").when(k == 1, F.concat(F.lit(".x"), "c_custkey")).when(k == 2, F.concat(F.lit("a."), "c_custkey")).otherwise(F.col("c_name"))
    flat = F.when(k == 1, "x").otherwise(name)
    return table(spark, d, "customer").select("c_custkey", T.segment_fault(flat, "flat").alias("flat"), T.segment_fault(name, "maildir++").alias("plus"), T.segment_fault(name, "fs").alias("fs"))


@query("""
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id % 3 <> 1 WHEN 1 THEN event_id % 3 <> 1 WHEN 2 THEN event_id % 3 = 2 WHEN 3 THEN event_id % 3 <> 2 ELSE event_id % 3 = 0 END AS transient FROM events
""")
def transient_kinds(spark, d):
    """Failures by where they happened: transport, problem, a server's text, a method's error, a single change's."""
    e, r = F.col("event_id") % 5, F.col("event_id") % 3
    kind = F.element_at(F.array(*[F.lit(x) for x in ("transport", "problem", "server", "method", "set")]), (e + 1).cast("int"))
    pick = lambda a, b, c: F.when(r == 0, a).when(r == 1, b).otherwise(c)
    status = F.when(e == 1, pick(F.lit(429), F.lit(404), F.lit(599)))
    message = F.when(e == 2, pick(F.lit("400 Bad Request"), F.lit("request 503"), F.lit(" 503 Service Unavailable")))
    error = F.when(e == 0, pick(F.lit("ConnectionReset"), F.lit("InvalidData"), F.lit("Timeout"))).when(e == 3, pick(F.lit("serverFail"), F.lit("serverUnavailable"), F.lit("forbidden"))).when(e == 4, pick(F.lit("rateLimit"), F.lit("notFound"), F.lit("invalidPatch")))
    return table(spark, d, "events").select("event_id", T.is_transient(status, message, kind, error).alias("transient"))


@query(r"""
    SELECT page_id, concat('"a', chr(92), chr(92), 'b', chr(92), '"', page_id, '"') AS toml, greatest(CAST(round((page_id % 7 * 1000 + page_id % 1000) * 2 / 1000.0) AS BIGINT), 1) AS ttl,
           CASE WHEN page_id % 3 = 0 THEN 0 ELSE page_id * 1000000000 END AS nanos, CASE WHEN page_id % 4 IN (0, 3) OR page_id % 5 = 0 THEN 'ok' ELSE 'stale' END AS verdict
    FROM pages
""")
def small_scalars(spark, d):
    p = F.col("page_id")
    time = F.timestamp_seconds(F.when(p % 3 == 0, -p).otherwise(p))
    version = F.when(p % 4 == 3, 7).when(p % 4 == 0, 0).otherwise(p % 4)
    return table(spark, d, "pages").select(
        "page_id", T.toml_string(F.concat(F.lit('a\\b"'), p.cast("string"))).alias("toml"), T.write_ttl(p % 7, p % 1000).alias("ttl"), T.epoch_nanos(time).alias("nanos"),
        T.schema_verdict(p % 5 != 0, version, p % 2 == 1, 7).alias("verdict"),
    )


@query("""
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://o.example/' || page_id WHEN 1 THEN 'https://h.example/x/' || page_id WHEN 2 THEN 'https://h.example/a/y' || page_id WHEN 3 THEN 'https://h.example/z' || page_id ELSE 'https://c.example/w' || page_id END AS url FROM pages
""")
def redirects(spark, d):
    """Where a redirect leads: absolute, from the root, beside the page, above it, and without a scheme."""
    p = F.col("page_id")
    at = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("https://o.example/", "/x/", "y", "../z", "//c.example/w")]), (p % 5 + 1).cast("int")), p.cast("string"))
    return table(spark, d, "pages").select("page_id", T.resolved_url(F.lit("https://h.example/a/b?q=1"), at).alias("url"))


@query("SELECT count(*) AS n, bool_and(TRUE) AS within FROM events WHERE event_type = 'error'")
def jitter_bounds(spark, d):
    """Drawn waits lie between 0 and the backoff."""
    e = table(spark, d, "events").filter("event_type = 'error'").select(F.pow(F.lit(2.0), F.col("event_id") % 6).alias("b")).withColumn("w", T.jittered(F.col("b"), 7))
    return e.agg(F.count("*").alias("n"), F.bool_and((F.col("w") >= 0) & (F.col("w") <= F.col("b"))).alias("within"))


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN r >= 1048576 THEN printf('%.1f MB', r / 1048576) WHEN r >= 1024 THEN printf('%.1f KB', r / 1024) ELSE printf('%d B', CAST(round_even(r, 0) AS BIGINT)) END AS rate,
           concat(CASE WHEN n < 0 THEN '-' ELSE '+' END, CASE WHEN abs(n) < 1024 THEN concat(abs(n), ' B') WHEN abs(n) < 1048576 THEN printf('%.1f KB', abs(n) / 1024.0) ELSE printf('%.1f MB', abs(n) / 1048576.0) END) AS change
    FROM (SELECT l_orderkey, l_linenumber, l_extendedprice * l_quantity / 4 AS r, CAST(floor(l_extendedprice * 100) AS BIGINT) * (l_linenumber - 3) AS n FROM lineitem)
""")
def rate_format(spark, d):
    """Rates and signed changes of size for people."""
    n = F.floor(F.col("l_extendedprice") * 100).cast("long") * (F.col("l_linenumber") - 3)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.human_rate(F.col("l_extendedprice") * F.col("l_quantity") / 4).alias("rate"), T.signed_bytes(n).alias("change"))


@query("""
    WITH e AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    r AS (SELECT event_id, concat('a', user_id % 4) AS account, 'Email' AS type, concat('e', k) AS state FROM e WHERE event_id % 9 <> 0 UNION ALL SELECT event_id, concat('a', user_id % 4), 'Mailbox', concat('m', k // 10) FROM e WHERE event_id % 3 = 0 AND event_id % 9 <> 0
        UNION ALL SELECT event_id, 'other', 'Email', 'x' FROM e WHERE event_id % 2 = 0 AND event_id % 9 <> 0)
    SELECT event_id, account, type, state FROM r
""")
def sse_states(spark, d):
    """The states that each event brings, of all its accounts and types; one that isn't JSON has none."""
    k = F.get_json_object("props", "$.k")
    mine = F.concat(F.lit('"a'), (F.col("user_id") % 4).cast("string"), F.lit('":{"Email":"e'), k, F.lit('"'), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(',"Mailbox":"m'), F.floor(k.cast("long") / 10).cast("string"), F.lit('"'))).otherwise(""), F.lit("}"))
    other = F.when(F.col("event_id") % 2 == 0, ',"other":{"Email":"x"}').otherwise("")
    data = F.when(F.col("event_id") % 9 == 0, "ping").otherwise(F.concat(F.lit('{"@type":"StateChange","changed":{'), mine, other, F.lit("}}")))
    rows = table(spark, d, "events").select("event_id", F.explode(T.state_map(data)).alias("account", "types"))
    return rows.select("event_id", "account", F.explode("types").alias("type", "state"))
