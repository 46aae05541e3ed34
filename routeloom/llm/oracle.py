"""SQL (DuckDB) for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from .chat_format import END, SPECIMEN, START
from .quality_rules import CUTOFFS, MAX_REJECTION, PATH, RISK, SYMBOLS

WORD = r"[^\x20\x09-\x0D]+"

CHAT = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{SPECIMEN}'
    UNION ALL SELECT -1, 1, 'assistant', '{SPECIMEN}'
),
measured AS (
    SELECT *,
        length(role) + 2 * len(regexp_extract_all(role, '[%<\n]')) AS role_chars,
        length(text) + len(regexp_extract_all(text, '<\\*\|')) AS text_chars
    FROM turns
),
talks AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum({len(START)} + role_chars + 1 + text_chars + {len(END)} + 1) AS formatted_chars
    FROM measured GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
    formatted_chars::BIGINT AS formatted_chars
FROM talks
"""


def quality() -> str:
    """Counts, settings by the exact binomial tail, verdicts."""
    over = [" OR ".join(f"{name} > {cutoff!r}" for name, cutoff in setting.items()) for setting in PATH]
    steps = " UNION ALL ".join(f"SELECT {t} AS t, stratum, count(*) AS n, count_if({x}) AS k FROM held GROUP BY stratum" for t, x in enumerate(over))
    limits = " UNION ALL ".join("SELECT {} AS setting, {}".format(t, ", ".join(f"{setting.get(name, 'inf')!r}::DOUBLE AS max_{name}" for name in CUTOFFS)) for t, setting in enumerate(PATH))
    return rf"""
WITH whole AS (SELECT doc_id, lang, coalesce(text, '') AS text, text AS original FROM documents),
placed AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos
    FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS words FROM whole)
),
windows AS (
    SELECT doc_id, pos, word, lead(word, 1) OVER w AS second, lead(word, 2) OVER w AS third FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
),
again AS (
    SELECT doc_id, pos, third IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, second, third) > 1 AS twice FROM windows
),
covered AS (
    SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS is_covered FROM again
),
repeats AS (SELECT doc_id, count(*) AS n_words, count_if(is_covered) AS n_repeat_words FROM covered GROUP BY doc_id),
counted AS (
    SELECT doc_id, lang, original, coalesce(n_words, 0) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM whole LEFT JOIN repeats USING (doc_id)
),
judged AS (
    SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
        CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
        CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS chars_per_word,
        CASE WHEN len(lines) > 0 THEN (len(lines) - len(list_distinct(lines))) / len(lines) ELSE 0 END AS dup_line_share
    FROM counted
),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
held AS (
    SELECT DISTINCT lang AS stratum, original, symbols_per_word, chars_per_word, dup_line_share FROM judged JOIN good USING (doc_id) WHERE NOT base_failed
),
steps AS ({steps}),
strata AS (
    SELECT stratum, count(*) AS n, {RISK} / (SELECT count(DISTINCT coalesce(stratum, chr(0))) FROM held) AS level FROM held GROUP BY stratum
),
pools AS (SELECT stratum, level, n * ln(1 - {MAX_REJECTION}) > ln(level) AS pooled FROM strata),
tested AS (
    SELECT pooled, CASE WHEN NOT pooled THEN s.stratum END AS alone, t, sum(n) AS n, sum(k) AS k, any_value(level) AS level
    FROM steps s JOIN pools p ON s.stratum IS NOT DISTINCT FROM p.stratum GROUP BY ALL
),
tails AS (
    SELECT pooled, alone, t, level,
        list_sum(list_transform(generate_series(0, k::BIGINT), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({MAX_REJECTION}) + (n - i) * ln(1 - {MAX_REJECTION})))) AS p
    FROM tested
),
chosen AS (SELECT pooled, alone, coalesce(min(t) FILTER (p > level), {len(PATH)}) - 1 AS setting FROM tails GROUP BY pooled, alone),
limits AS ({limits}),
cutoffs AS (
    SELECT p.stratum, l.* FROM pools p
    JOIN chosen c ON c.pooled = p.pooled AND c.alone IS NOT DISTINCT FROM CASE WHEN NOT p.pooled THEN p.stratum END
    JOIN limits l USING (setting)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT (base_failed OR {" OR ".join(f"coalesce({name} > max_{name}, false)" for name in CUTOFFS)}) AS kept
FROM judged LEFT JOIN cutoffs ON lang IS NOT DISTINCT FROM stratum
"""


JACCARD = rf"""
WITH RECURSIVE cut AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(words) >= 5 THEN list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i + 4], ' '))
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] END) AS shingle
    FROM cut
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM shared o JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o.n >= 75 * (x.n + y.n - o.n)
),
reached(a, b) AS (
    SELECT a, b FROM links
    UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b
),
least AS (SELECT a AS doc_id, min(b) AS first FROM reached GROUP BY a),
counts AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(first, d.doc_id)) AS component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

WARC = """
WITH hashed AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS digest FROM pages
),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM hashed)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
    list_aggregate(list_transform(generate_series(0, 7), lambda i: list_aggregate(list_transform([32768, 1024, 32, 1],
        lambda place: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(digest, 1 + 5 * i, 5))::BIGINT // place) % 32)::INTEGER, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""

SUBSTRINGS = rf"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
windows AS (
    SELECT doc_id, unnest(generate_series(1, len(words) - 34)) AS pos, unnest(list_transform(generate_series(1, len(words) - 34), lambda i: array_to_string(words[i:i + 34], ' '))) AS body
    FROM cut WHERE len(words) >= 35
),
again AS (SELECT doc_id, pos FROM windows WHERE body IN (SELECT body FROM windows GROUP BY body HAVING count(*) > 1)),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM cut),
marked AS (
    SELECT p.doc_id, p.word, p.pos,
        coalesce(p.pos - max(a.pos) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS UNBOUNDED PRECEDING) < 35, false) AS gone
    FROM placed p LEFT JOIN again a ON a.doc_id = p.doc_id AND a.pos = p.pos
),
sums AS (
    SELECT doc_id, count(*) AS n_words, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN sums USING (doc_id)
"""

SUFFIXES = """
WITH whole AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents),
blocks AS (
    SELECT doc_id, block, substr(digits, 400 * block + 1, 498) AS part, least(200, len(digits) // 2 - 200 * block) AS own
    FROM (SELECT doc_id, digits, unnest(generate_series(0, (len(digits) - 1) // 400)) AS block FROM whole WHERE digits <> '')
),
places AS MATERIALIZED (
    SELECT doc_id, 200 * block + i AS pos, substr(part, 2 * i - 1, 100) AS body FROM (SELECT *, unnest(generate_series(1, own)) AS i FROM blocks)
),
strings AS (SELECT * FROM places WHERE len(body) = 100),
firsts AS (SELECT body, min(doc_id) AS first_id FROM strings GROUP BY body HAVING min(doc_id) < max(doc_id)),
again AS (SELECT s.doc_id, s.pos FROM strings s JOIN firsts f USING (body) WHERE f.first_id < s.doc_id),
marked AS (
    SELECT p.doc_id, p.pos, substr(p.body, 1, 2) AS byte,
        coalesce(p.pos - max(a.pos) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS UNBOUNDED PRECEDING) < 50, false) AS gone
    FROM places p LEFT JOIN again a ON a.doc_id = p.doc_id AND a.pos = p.pos
),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM marked),
sums AS (
    SELECT doc_id, count(*) AS n_bytes, count_if(gone) AS n_removed, count_if(opens) AS n_spans, string_agg(byte, '' ORDER BY pos) FILTER (NOT gone) AS kept
    FROM edges GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents d LEFT JOIN sums USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": CHAT,
    "op2_quality_rules": quality(),
    "op5_ngram_jaccard_join": JACCARD,
    "op6_warc_archive": WARC,
    "op9_substring_dedup": SUBSTRINGS,
    "op10_suffix_array_dedup": SUFFIXES,
}
