"""DuckDB SQL for the rows of those queries that SQL can express; it knows nothing of chunks, archives, suffixes or registers."""

from __future__ import annotations

OP2 = """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

#: Every 50-byte string of every text, in hexadecimal, with the smallest document in which it starts; then the maximal runs of covered bytes.
OP5 = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM d, unnest(range(0, len(h) // 2 - 49)) t(i)),
    owner AS (SELECT w, min(doc_id) AS lo FROM s GROUP BY w),
    r AS (SELECT doc_id, i FROM s JOIN owner USING (w) WHERE doc_id > lo),
    o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM r),
    n AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o),
    span AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY doc_id, k),
    gap AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b, a AS pos FROM span
            UNION ALL SELECT doc_id, 0, min(a), -1 FROM span GROUP BY doc_id),
    kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' ORDER BY pos) AS x FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
    total AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
    SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(x, h))) AS kept_sha256
    FROM d LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: A digest of 160 bits is 32 letters of 5 bits each.
OP8 = """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS target FROM pages),
    letters AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST(concat('0x', substr(concat(h, '00'), 1 + 5 * k // 4, 2)) AS INTEGER) >> (3 - (5 * k) % 4)) & 31), 1), '' ORDER BY k) AS payload_digest
                FROM (SELECT DISTINCT h FROM p), unnest(range(32)) t(k) GROUP BY h)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < target THEN target END AS refers_to
    FROM p JOIN letters USING (h)
"""

#: Distinct shingles meet by their text; components by the least label over links until nothing changes.
OP9 = r"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g FROM d, unnest(range(1, len(w) - least(5, len(w)) + 2)) t(i) WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
    reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""

#: A turn's marks and blanks by role, and one more letter for each control string inside a text.
OP11 = r"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    n AS (SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]|<\\*</?SYS>>|\[\\*(OUT|/?ROLE|END)\]|<\\*\|endoftext\|>'))
              + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 9 ELSE 18 + length(role) END AS chars FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
    FROM n GROUP BY conv_id
"""

#: The checksum is table-driven over a word's bytes. Words are near if they are equal with one letter masked in each, or if one without a letter is the other.
OP12 = r"""
    WITH RECURSIVE steps AS MATERIALIZED (SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
    run AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
    many AS (SELECT doc_id, w, count(*) AS n, hex(encode(concat(doc_id, ':', w))) AS x FROM run WHERE length(w) >= 7 GROUP BY ALL),
    summed AS (SELECT w, n, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(x) // 2), lambda k: CAST(concat('0x', substr(x, 2 * k + 1, 2)) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM many, steps),
    word AS MATERIALIZED (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS word, CAST(sum(n) AS BIGINT) AS n FROM summed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
    cut AS (SELECT word, i, concat(substr(word, 1, i - 1), chr(1), substr(word, i + 1)) AS masked, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS without FROM word, unnest(range(1, length(word) + 1)) t(i)),
    half AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b USING (masked) WHERE a.word <> b.word UNION SELECT cut.word, word.word FROM cut JOIN word ON cut.without = word.word),
    near AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
    best AS (SELECT a, count(*) AS n_near, max(n) AS most, arg_min(b, (-n, b)) AS b FROM near JOIN word ON b = word GROUP BY a),
    found AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN b END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n FROM word LEFT JOIN best ON a = word),
    chain AS (SELECT word, word AS root, form AS next FROM found UNION ALL SELECT chain.word, found.word, found.form FROM chain JOIN found ON chain.next = found.word)
    SELECT found.word, form, root, n, n_near, form_n FROM found JOIN chain ON chain.word = found.word AND next IS NULL
"""


def _op13(rounds: int = 4) -> str:
    """Codebooks c0, c1 and so on as rows (part, entry, place, value), each from the nearest entries of the one before. Values are integers, held as doubles where they are summed."""
    near = """
        d{k} AS (SELECT vec_id, v.part, entry, sum((v.x - c{k}.x) * (v.x - c{k}.x)) AS dist FROM v JOIN c{k} ON v.part = c{k}.part AND v.place = c{k}.place GROUP BY ALL),
        a{k} AS MATERIALIZED (SELECT vec_id, part, min_by(entry, (dist, entry)) AS entry, min(dist) AS dist FROM d{k} GROUP BY ALL)"""
    move = """,
        c{n} AS MATERIALIZED (SELECT c{k}.part, c{k}.entry, c{k}.place, coalesce(m.x, c{k}.x) AS x FROM c{k} LEFT JOIN
            (SELECT part, entry, place, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM v JOIN a{k} USING (vec_id, part) GROUP BY ALL) m ON m.part = c{k}.part AND m.entry = c{k}.entry AND m.place = c{k}.place),"""
    steps = "".join(near.format(k=k) + (move.format(k=k, n=k + 1) if k < rounds else "") for k in range(rounds + 1))
    return f"""
        WITH kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(embedding) // 4) AS part, (i - 1) % (len(embedding) // 4) AS place, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, unnest(range(1, len(embedding) + 1)) t(i)),
        c0 AS MATERIALIZED (SELECT part, k AS entry, place, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept) USING (vec_id) WHERE k < 256),
        {steps},
        e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM c{rounds}) AS codebooks_sha256
        FROM e JOIN kept USING (vec_id)
    """


ORACLE = {"op2_exact_dedup": OP2, "op5_suffix_dedup": OP5, "op8_warc": OP8, "op9_minhash": OP9, "op11_chat": OP11, "op12_spelling": OP12, "op13_codes": _op13()}
