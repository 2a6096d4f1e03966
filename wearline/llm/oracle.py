"""DuckDB SQL of the queries that SQL can express, written apart from the operators: windows
as joined words, sets as rows, quantiles by row numbers, every seat of an apportionment.

Scoring by a trained model (2, 3), page parsing (4), fingerprints (7) and a vocabulary's
merges (9, 10) are beyond SQL; tests/llm holds those against brute force."""

from __future__ import annotations

W = r"'[^\x20\x09-\x0D]+'"
WORDS = f"regexp_extract_all(coalesce(text, ''), {W})"


def _left(pattern: str) -> str:
    return f"length(regexp_replace(t, '{pattern}', '', 'g'))"


_MEASURES = "symbols marks capitals length same_lines repeated doubled".split()
_FLOOR = dict(zip(_MEASURES, (40, 15, 10, 20, 400, 285, 10), strict=True))


def _share(part: str, whole: str, scale: int = 1000) -> str:
    return f"CASE WHEN {whole} > 0 THEN {scale} * {part} // {whole} ELSE 0 END"


def _bin_floor(v: str) -> str:
    """Smallest integer of the value's bin: the first six binary digits, zeros after."""
    return (f"CASE WHEN {v} < 64 THEN {v} ELSE ({v} >> (length(bin({v})) - 6)::INT) << (length(bin({v})) - 6)::INT END")


def _rules() -> str:
    values = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, '{m}' AS measure, {m} AS v FROM m WHERE NOT base_failed" for m in _MEASURES)
    floor = "CASE measure " + " ".join(f"WHEN '{m}' THEN {s}" for m, s in _FLOOR.items()) + " END"

    def level(name: str, keys: str) -> str:
        part = f"{keys + ', ' if keys else ''}measure"
        return f"""
        {name}_r AS (SELECT {part}, f, row_number() OVER (PARTITION BY {part} ORDER BY f) AS rn,
                     count(*) OVER (PARTITION BY {part}) AS n FROM binned),
        {name} AS (SELECT {part}, any_value(n) AS n, min(f) FILTER (5 * rn >= n) AS lo,
                   min(f) FILTER (5 * rn >= 4 * n) AS hi FROM {name}_r GROUP BY {part})"""

    def blend(q: str) -> str:
        parent = f"((l.n * l.{q} + 100 * e.{q}) / (l.n + 100)::DOUBLE)"
        return f"(o.n * o.{q} + 100 * {parent}) / (o.n + 100)::DOUBLE AS {q}"

    return rf"""
    WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
    win AS (SELECT doc_id, s, array_to_string(ws[s:s + 7], ' ') AS k
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS s FROM d WHERE len(ws) >= 8)),
    again AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
    cover AS (SELECT doc_id, count(DISTINCT s + i) AS n FROM again, range(0, 8) r(i) GROUP BY doc_id),
    b AS (SELECT d.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
            {_left(r"[^#*$%&|<>]+")}::BIGINT AS n_symbols, {_left(r"[^!-/:-@\[-`{-~]+")}::BIGINT AS n_marks,
            {_left(r"\P{Lu}+")}::BIGINT AS n_capitals,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {W})) AS lines,
            len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_doubled,
            coalesce(cover.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cover USING (doc_id)),
    c AS (SELECT *, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
            n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
    m AS (SELECT *, {_share("n_symbols", "word_chars")} AS symbols, {_share("n_marks", "word_chars")} AS marks,
            {_share("n_capitals", "word_chars")} AS capitals, {_share("word_chars", "n_words", 100)} AS length,
            {_share("n_dup_lines", "n_lines")} AS same_lines, {_share("n_repeat_words", "n_words")} AS repeated,
            {_share("n_doubled", "n_words")} AS doubled FROM c),
    vals AS ({values}),
    binned AS (SELECT *, {_bin_floor("v")} AS f FROM vals),
    {level("own", "lang, source")}, {level("by_lang", "lang")}, {level("everything", "")},
    fence AS (SELECT o.lang, o.source, o.measure, {blend("lo")}, {blend("hi")}
        FROM own o JOIN by_lang l ON l.measure = o.measure AND l.lang IS NOT DISTINCT FROM o.lang
        JOIN everything e ON e.measure = o.measure),
    lim AS (SELECT lang, source, measure, lo - greatest(6 * (hi - lo), {floor}) AS lo,
        hi + greatest(6 * (hi - lo), {floor}) AS hi FROM fence),
    bad AS (SELECT DISTINCT v.doc_id FROM vals v JOIN lim ON lim.measure = v.measure
        AND lim.lang IS NOT DISTINCT FROM v.lang AND lim.source IS NOT DISTINCT FROM v.source
        WHERE v.v > hi OR (v.measure = 'length' AND v.v < lo))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m"""


_NEAR = f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {W}) AS ws FROM documents),
    sh AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 4], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS s FROM d WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id
        GROUP BY 1, 2),
    link AS MATERIALIZED (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
        WHERE 100 * c >= 85 * (na.n + nb.n - c)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id, r.component_id = d.doc_id AS kept
    FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id"""


def _draw(seed: int, *columns: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"coalesce({c}::VARCHAR, '')" for c in columns]])
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


_MIX = f"""
    WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5(coalesce(text, '')) AS h FROM documents),
    src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    wt AS (SELECT *, (1 + pos % 3)::DOUBLE AS weight, source_size::DOUBLE * 3 AS cap,
        least(4096, greatest(1, ceil(source_size / 200000.0)))::INT AS shards
        FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM src)),
    lower AS (SELECT a.pos, coalesce(sum(b.cap), 0) AS cap, coalesce(sum(b.weight), 0) AS weight
        FROM wt a LEFT JOIN wt b ON (b.cap / b.weight, b.pos) < (a.cap / a.weight, a.pos) GROUP BY a.pos),
    lv AS (SELECT wt.*, ((SELECT sum(source_size)::DOUBLE FROM wt) - lower.cap)
            / ((SELECT sum(weight) FROM wt) - lower.weight) AS level FROM wt JOIN lower USING (pos)),
    t AS (SELECT source, source_size, pos, shards, coalesce(least(cap, weight *
        (SELECT level FROM lv WHERE level * weight <= cap ORDER BY cap / weight, pos LIMIT 1)), cap) AS target FROM lv),
    fine AS (SELECT greatest(1, least(64, floor(min(target) FILTER (target > 0) / 50)))::BIGINT AS b FROM t),
    blocks AS (SELECT round(sum(target) / any_value(b))::BIGINT AS n FROM t, fine),
    seat AS (SELECT pos FROM (SELECT pos, row_number() OVER (ORDER BY target / (2 * a + 1) DESC, pos, a) AS rn
        FROM t, blocks, range(0, n + 1) s(a) WHERE target > 0), blocks WHERE rn <= n),
    quota AS (SELECT t.pos, count(seat.pos) AS q FROM t LEFT JOIN seat USING (pos) GROUP BY t.pos),
    dealt AS (SELECT d.*, pos, source_size, target, ({_draw(7, 'doc_id')} % shards)::INT AS shard
        FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
    sh AS (SELECT pos, shard, sum(size)::BIGINT AS shard_size FROM dealt GROUP BY pos, shard),
    sseat AS (SELECT pos, shard FROM (SELECT sh.pos, shard, q, row_number() OVER (
            PARTITION BY sh.pos ORDER BY shard_size / (2 * a + 1) DESC, shard, a) AS rn
        FROM sh JOIN quota USING (pos), range(0, q) s(a) WHERE shard_size > 0) WHERE rn <= q),
    won AS (SELECT pos, shard, count(*) AS n FROM sseat GROUP BY pos, shard),
    plan AS (SELECT sh.*, least(coalesce(n, 0) * b, shard_size * 3) AS words, b FROM sh LEFT JOIN won USING (pos, shard), fine),
    ring AS (SELECT *, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS rounds,
        CASE WHEN shard_size > 0 THEN words % shard_size ELSE 0 END AS rest,
        {_draw(8, 'pos', 'shard')} % greatest(1, ceil(shard_size / b::DOUBLE)::BIGINT) * b AS start FROM plan),
    placed AS (SELECT *, sum(size) OVER (PARTITION BY pos, shard ORDER BY {_draw(9, 'doc_id')}, doc_id NULLS FIRST, h, size
        ROWS UNBOUNDED PRECEDING) AS stop FROM dealt)
    SELECT doc_id, size, source_size, target, (rounds * size
        + greatest(0, least(stop, start + rest, shard_size) - greatest(stop - size, start))
        + greatest(0, least(stop, start + rest - shard_size) - greatest(stop - size, 0)))::BIGINT AS taken, source
    FROM placed JOIN ring USING (pos, shard)"""

_REPEATS = f"""
    WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
    win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d WHERE len(ws) >= 20)),
    later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn
        FROM win) WHERE rn > 1),
    gone AS (SELECT DISTINCT doc_id, s + i AS p FROM later, range(0, 20) r(i)),
    word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
    kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS k, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p)
        GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
        sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

# The crc32 of a list of bytes, from the polynomial: a table of 256 values, then byte by byte.
_CRC_TABLE = """crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def _crc(octets: str) -> str:
    return (f"xor(list_reduce([4294967295::BIGINT] || {octets}, "
            "lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)")


_CODES = "list_transform(string_split({}, ''), lambda x: unicode(x)::BIGINT)"

_REPAIR = f"""
    WITH RECURSIVE {_CRC_TABLE},
    ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
    raw AS (SELECT ids.c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {_crc(_CODES.format("coalesce(v.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))} % 20 AS f
        FROM conversations v JOIN ids ON ids.conv_id IS NOT DISTINCT FROM v.conv_id, crc),
    hurt AS (SELECT c, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
            CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM raw, range(1, 3) r(copy) WHERE f <> 0 AND (copy = 1 OR f = 3)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
    known AS (SELECT *, substr(role, 1, 1) AS r, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS seen,
            regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS held FROM placed),
    judged AS (SELECT *, CASE WHEN held = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(held, '[.!?]$') THEN 'truncated' ELSE '' END AS fault,
            lag(r) OVER (PARTITION BY c ORDER BY i) AS r0 FROM known),
    facts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (i > 1 AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY c),
    ins(q, p, k) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
    step(e, p, r, q, w) AS (VALUES ('D', 0, '', 0, 3), ('D', 1, '', 1, 3), ('D', 2, '', 2, 3), ('D', 3, '', 3, 3),
        ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 2, 'a', 3, 0), ('K', 3, 'u', 2, 0),
        ('R', 0, '', 2, 2), ('R', 1, '', 2, 2), ('R', 2, '', 3, 2), ('R', 3, '', 2, 2)),
    walk AS (SELECT c, 0::BIGINT AS i, 0 AS q, {{'cost': 0, 'audit': ''}} AS best FROM facts
        UNION ALL
        SELECT w.c, w.i + 1, step.q, min({{'cost': w.best.cost + 2 * ins.k + step.w
                + CASE WHEN j.fault = 'truncated' AND step.e <> 'D' THEN 1 ELSE 0 END,
            'audit': w.best.audit || repeat('I', ins.k) || step.e}})
        FROM walk w JOIN judged j ON j.c = w.c AND j.i = w.i + 1 JOIN ins ON ins.q = w.q JOIN step ON step.p = ins.p
        WHERE step.e = 'D' OR (j.fault IN ('', 'truncated') AND (step.e = 'R' OR step.r = j.r))
        GROUP BY w.c, w.i, step.q),
    done AS (SELECT c, min({{'cost': best.cost + 2 * ins.k, 'audit': best.audit || repeat('I', ins.k)}}) AS best
        FROM walk JOIN facts USING (c) JOIN ins USING (q) WHERE i = n AND ins.p IN (0, 3) GROUP BY c),
    edit AS (SELECT c, pos, e, length(replace(best.audit, 'D', '')) % 2 AS system,
            count(*) FILTER (e <> 'I') OVER (PARTITION BY c ORDER BY pos) AS i, count(*) FILTER (e <> 'D') OVER (PARTITION BY c ORDER BY pos) AS k
        FROM (SELECT c, best, unnest(range(1, length(best.audit) + 1)) AS pos, unnest(string_split(best.audit, '')) AS e
            FROM done WHERE best.audit <> '')),
    said AS (SELECT c, string_agg(CASE e WHEN 'K' THEN j.role ELSE wanted END || ':'
            || CASE e WHEN 'I' THEN '' ELSE j.text END, chr(10) ORDER BY pos) AS t
        FROM (SELECT *, CASE WHEN (k - system) % 2 = 1 THEN 'user' ELSE 'assistant' END AS wanted FROM edit WHERE e <> 'D') x
        LEFT JOIN judged j USING (c, i) GROUP BY c)
    SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
        coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
        coalesce(best.audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
    FROM ids LEFT JOIN facts USING (c) LEFT JOIN done USING (c) LEFT JOIN said USING (c)"""

_OCTETS = ("flatten(list_transform(string_split({}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] "
           "ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))")

_SPELLING = f"""
    WITH RECURSIVE {_CRC_TABLE},
    run AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
    own AS (SELECT doc_id, w, count(*) AS n FROM run WHERE length(w) >= 6 GROUP BY doc_id, w),
    hashed AS (SELECT w, n, {_crc(_OCTETS.format("coalesce(doc_id::VARCHAR, '') || ':' || w"))} AS h FROM own, crc),
    cut AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2)
        ELSE w END AS w FROM hashed),
    v AS MATERIALIZED (SELECT w, sum(n)::BIGINT AS n FROM cut WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
    less AS MATERIALIZED (SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS d
        FROM (SELECT w, n, unnest(range(1, length(w) + 1))::INT AS i FROM v)),
    pair AS (SELECT a.w AS a, b.w AS b, b.n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.w <> b.w
        UNION SELECT a.w, v.w, v.n FROM less a JOIN v ON v.w = a.d
        UNION SELECT v.w, a.w, a.n FROM less a JOIN v ON v.w = a.d),
    best AS (SELECT a, count(*) AS n_near, min({{'m': -n, 'w': b}}) AS f FROM pair GROUP BY a),
    form AS (SELECT v.w, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -f.m >= 5 * v.n THEN f.w END AS form,
        CASE WHEN -f.m >= 5 * v.n THEN -f.m END::BIGINT AS form_n FROM v LEFT JOIN best ON best.a = v.w),
    chain AS (SELECT w, w AS at, 0 AS k FROM form UNION ALL
        SELECT chain.w, form.form, k + 1 FROM chain JOIN form ON form.w = chain.at WHERE form.form IS NOT NULL)
    SELECT w AS word, form, (SELECT arg_max(chain.at, k) FROM chain WHERE chain.w = form.w) AS root, n, n_near, form_n FROM form"""

ORACLE: dict[str, str] = {
    "op1_quality_rules": _rules(),
    "op5_near_dedup": _NEAR,
    "op6_source_mix": _MIX,
    "op8_substring_dedup": _REPEATS,
    "op11_conversation_repair": _REPAIR,
    "op12_spelling_variants": _SPELLING,
}
