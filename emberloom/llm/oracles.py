"""SQL of the rows of those queries that SQL can express, for DuckDB."""

from __future__ import annotations

from .cover_tree import COSINE
from .line_dedup import LEAST_CHARS, LEAST_DOCS, LOWER, UPPER
from .mixing import MOST_PASSES, SHARE, WEIGHTS
from .quality_rules import MIN_WORDS, MOST_REPEATED, RULES, STOP_WORDS, SYMBOLS, WINDOW

SPACE = "[\\x20\\x09-\\x0D]"
quoted = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))
#: What each metric divides by what; nothing divided by nothing is 0.
METRIC = {
    "n_words": ("n_words", "1"),
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_ratio": ("n_stop", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "distinct_word_ratio": ("n_distinct", "n_words"),
}


def value(metric: str) -> str:
    over, under = METRIC[metric]
    return f"coalesce(CAST({over} AS DOUBLE) / nullif({under}, 0), 0)"


LIMITS = [(r.metric, sign, limit) for r in RULES for sign, limit in ((">=", r.least), ("<=", r.most)) if limit is not None]
VERDICT = " AND ".join(f"{value(m)} {sign} {limit}" for m, sign, limit in LIMITS)
COUNTS = (
    f"t AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t FROM documents), w AS (SELECT *, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') AS w, "
    "list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t), "
    f"g AS (SELECT k, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)), "
    "r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1), "
    f"p AS (SELECT k, count(DISTINCT i + j) AS n FROM r, range(0, {WINDOW}) o(j) GROUP BY k), "
    f"c AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^{SYMBOLS.replace('$', chr(92) + '$').replace('|', chr(92) + '|')}]', '', 'g')) AS n_symbols, "
    "len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(p.n, 0) AS n_repeat_words, "
    f"len(list_filter(w, lambda x: list_contains([{quoted}], lower(rtrim(x, '.,;:!?'))))) AS n_stop, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_upper, len(list_distinct(w)) AS n_distinct FROM w LEFT JOIN p ON w.k = p.k)"
)
DOT = "list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))"



def crc32_sql(text: str) -> str:
    """The checksum of an ASCII string, byte by byte and bit by bit."""
    turned = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: {turned}), 4294967295)"


def repair_sql() -> str:
    """Forward over the rows of all conversations at once: the least (cost, audit, text) of each state, inserts after every row."""
    way = lambda s, cost, letter, line: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {s}.t || CASE WHEN {s}.t = '' THEN '' ELSE chr(10) END || {line}}} END"
    gone = lambda s: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + 4, 'a': {s}.a || 'D', 't': {s}.t}} END"
    least = lambda ways: f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"
    kept = lambda s, initial: f"CASE WHEN NOT forced AND starts_with(role, '{initial}') THEN {way(s, 'more', 'K', chr(39) * 2 + ' || role || ' + chr(39) + ':' + chr(39) + ' || text')} END"
    given = lambda s, name: f"CASE WHEN NOT forced THEN {way(s, '3 + more', 'R', chr(39) + name + ':' + chr(39) + ' || text')} END"
    put = lambda s, name: way(s, "3", "I", f"'{name}:'")
    before_user = ("s0", "s1", "s3")
    return (
        "WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, "
        f"{crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations), "
        "d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM k, range(2) z(z) WHERE k <> 0 AND (z = 0 OR k = 3)), "
        "n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS above, "
        f"NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, regexp_replace(text, '{SPACE}+$', '') AS bare FROM d), "
        "f AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM n), "
        "o AS (SELECT *, blank OR again AS forced, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS short FROM f), "
        "w(conv_id, i, s0, s1, s2, s3) AS (SELECT conv_id, CAST(0 AS BIGINT), {'c': CAST(0 AS BIGINT), 'a': '', 't': ''}, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)), "
        "{'c': CAST(3 AS BIGINT), 'a': 'I', 't': 'user:'}, {'c': CAST(6 AS BIGINT), 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'} FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL "
        f"SELECT conv_id, i, s0, s1, s2, {least(('s3', put('s2', 'assistant')))} FROM (SELECT conv_id, i, s0, s1, {least(('s2', *[put(s, 'user') for s in before_user]))} AS s2, s3 FROM ("
        f"SELECT w.conv_id, o.i, {gone('s0')} AS s0, {least((gone('s1'), kept('s0', 's')))} AS s1, "
        f"{least((gone('s2'), *[x for s in before_user for x in (kept(s, 'u'), given(s, 'user'))]))} AS s2, {least((gone('s3'), kept('s2', 'a'), given('s2', 'assistant')))} AS s3 "
        "FROM w JOIN (SELECT *, CASE WHEN short THEN 3 ELSE 0 END AS more FROM o) o ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND o.i = w.i + 1))), "
        "e AS (SELECT conv_id, arg_max(list_min(list_filter([s0, s3], lambda x: x IS NOT NULL)), i) AS best FROM w GROUP BY conv_id), "
        "q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate, count(*) FILTER (WHERE short) AS truncated, "
        "count(*) FILTER (WHERE left(above, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY conv_id) "
        "SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, "
        "best.c AS cost, best.a AS audit, sha256(best.t) AS repaired_sha256 FROM e LEFT JOIN q ON e.conv_id IS NOT DISTINCT FROM q.conv_id"
    )


ORACLES: dict[str, str] = {
    "op3_quality_rules": (
        f"WITH {COUNTS}, b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM c) "
        f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {VERDICT} AS kept FROM b"
    ),
    "op5_cover_tree": (
        "WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), "
        f"l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE {DOT} >= {COSINE}), "
        "reach(r, n) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.r, l.b FROM reach JOIN l ON reach.n = l.a), m AS (SELECT r, min(n) AS c FROM reach GROUP BY r), d AS (SELECT a, count(*) AS n FROM l GROUP BY a) "
        "SELECT v.vec_id, coalesce(d.n, 0) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept FROM v JOIN m ON v.vec_id = m.r LEFT JOIN d ON v.vec_id = d.a"
    ),
    "op12_conversation_repair": repair_sql(),
    "op13_line_dedup": (
        "WITH l AS (SELECT k, doc_id, unnest(range(len(s))) AS pos, unnest(s) AS line FROM (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)), "
        f"y AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l), "
        f"h AS (SELECT key, max(doc_id) AS last FROM y WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= {LEAST_DOCS}), "
        "g AS (SELECT y.*, h.key IS NOT NULL AND y.doc_id IS DISTINCT FROM h.last AS gone FROM y LEFT JOIN h ON y.key = h.key) "
        "SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM g GROUP BY k"
    ),
    "mixing_targets": (
        "WITH s AS (SELECT source, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '" + SPACE + "+'), lambda x: x <> ''))) AS BIGINT) AS source_size FROM documents GROUP BY source), "
        f"w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(WEIGHTS))} END AS DOUBLE) AS w FROM s), "
        # every level at which some sources are full; the right one hands out all
        f"l AS (SELECT (SELECT sum(source_size) * {SHARE} - coalesce(sum(CASE WHEN x.source_size / x.w <= a.source_size / a.w THEN {MOST_PASSES} * x.source_size END), 0) FROM w x) / nullif((SELECT sum(w) FROM w x WHERE x.source_size / x.w > a.source_size / a.w), 0) AS level FROM w a "
        f"UNION ALL SELECT sum(source_size) * {SHARE} / sum(w) FROM w), "
        f"g AS (SELECT level, (SELECT sum(least({MOST_PASSES} * source_size, level * w)) FROM w) AS given FROM l WHERE level IS NOT NULL), "
        f"b AS (SELECT arg_min(level, abs(given - (SELECT sum(source_size) * {SHARE} FROM w))) AS level FROM g) SELECT source, source_size, round(CAST(least({MOST_PASSES} * source_size, level * w) AS DOUBLE), 6) AS target FROM w, b"
    ),
    "shard_sizes": (
        "WITH r AS (SELECT CAST((r * 16) // n AS INT) AS shard FROM (SELECT count(*) AS n FROM documents), LATERAL (SELECT unnest(range(n)) AS r)) "
        "SELECT shard, count(*) AS n, count(*) AS slots, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last FROM r GROUP BY shard"
    ),
}
