"""The same queries as SQL for an independent engine."""

from __future__ import annotations

from ..functions import rules as R
from ..functions import sheet_columns as C
from ..sources import adapter as A
from .queries import LABELS, SIZES, TARGET


def texts(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def tok(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: t <> ''))"


def has(x: str, words) -> str:
    return f"list_has_any({x}, {texts(words)})"


def norm(x: str) -> str:
    p = f"trim(split_part({x}, '?', 1))"
    p = f"CASE WHEN {p} = '' THEN '/' ELSE {p} END"
    for pattern in (r"<(?:[^:<>]+:)?[^<>]+>", r"\{[^}/]+\}", r":([A-Za-z_][A-Za-z0-9_]*)", r"\([^/]+\)"):
        p = f"regexp_replace({p}, '{pattern}', '{{var}}', 'g')"
    p = f"regexp_replace({p}, '/+', '/', 'g')"
    return f"(CASE WHEN length({p}) > 1 THEN regexp_replace({p}, '/+$', '') ELSE {p} END)"


def canon(x: str) -> str:
    p = f"regexp_replace(trim({x}), '/+$', '')"
    return f"(CASE WHEN {p} = '' THEN '/' WHEN starts_with({p}, '/') THEN {p} ELSE '/' || {p} END)"


def segs(x: str) -> str:
    return f"list_filter(string_split({x}, '/'), lambda s: s <> '')"


def target(x: str) -> str:
    s = segs(canon(x))
    acts = f"len(list_filter({tok(f'({s})[-1]')}, lambda t: regexp_matches(t, '^(cancel|abort|stop|terminate|kill)'))) > 0"
    return f"(CASE WHEN len({s}) > 0 AND {acts} THEN '/' || array_to_string(({s})[1:len({s})-1], '/') ELSE {canon(x)} END)"


def pattern(codes: str) -> str:
    return f"""CASE
 WHEN concept = '{R.CANCELLATION}' AND method = 'POST' AND regexp_matches(lower(normalized_path), '/(cancel|abort|stop|terminate|kill)$') THEN 'post-subresource-cancel'
 WHEN concept = '{R.CANCELLATION}' AND method = 'PUT' AND {has('combined', R.CANCEL_WORDS)} THEN 'put-action-cancel'
 WHEN concept = '{R.CANCELLATION}' AND method = 'GET' AND {has('path_words', R.CANCEL_WORDS)} THEN 'get-cancel-link'
 WHEN concept = '{R.CANCELLATION}' AND method = 'POST' AND {has('combined', R.CANCEL_WORDS)} THEN 'post-action-cancel'
 WHEN concept = '{R.CANCELLATION}' AND method = 'DELETE' AND {has('combined', R.CANCEL_WORDS)} THEN 'delete-action-cancel'
 WHEN concept = '{R.CANCELLATION}' AND method = 'DELETE' AND {has('combined', R.ASYNC_NOUNS)} THEN 'delete-operation-resource'
 WHEN concept = '{R.CANCELLATION}' AND method = 'PATCH' AND {has('combined', R.CANCEL_WORDS)} THEN 'patch-state-cancelled'
 WHEN concept = '{R.CANCELLATION}' THEN 'other-cancellation-route'
 WHEN method = 'POST' AND list_contains({codes}, 202) THEN 'post-202-accepted'
 WHEN method = 'POST' AND {has('combined', R.ASYNC_NOUNS)} THEN 'post-job-resource'
 WHEN method = 'GET' AND {has('combined', R.STATUS_WORDS)} THEN 'get-status-resource'
 WHEN method = 'GET' AND {has('combined', R.ASYNC_NOUNS)} THEN 'get-operation-resource'
 WHEN method IN ('PUT', 'PATCH', 'DELETE') AND list_contains({codes}, 202) THEN 'mutation-202-accepted'
 ELSE 'other-async-route' END"""


WORDS = f"{tok('normalized_path || chr(32) || path || chr(32) || symbol')} AS combined, {tok('normalized_path || chr(32) || path')} AS path_words"
WRITES = "method IN ('POST', 'PUT', 'PATCH', 'DELETE')"
ROUTES = f"""r AS (SELECT event_id AS ord, 'org' || (user_id % 7) || '/svc' || user_id AS repository,
 CASE event_type WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'PUT' WHEN 'error' THEN 'DELETE' ELSE 'GET' END AS method,
 '/' || ({texts(A.NOUNS)})[(event_id % 8 + 1)::INT] || ({texts(A.PARAMS)})[((event_id // 8) % 4 + 1)::INT] || ({texts(A.SUFFIXES)})[((event_id // 32) % 7 + 1)::INT] AS path,
 [CASE WHEN value > 120 THEN 202 ELSE 200 END] AS codes, CASE WHEN event_id % 3 = 0 THEN 'openapi' ELSE 'source' END AS source_kind,
 'src/f' || (event_id % 13) || '.py' AS file, (event_id % 400 + 1)::INT AS line, ({texts(A.SYMBOLS)})[((event_id // 5) % 4 + 1)::INT] AS symbol,
 CASE WHEN event_id % 3 = 0 THEN ({texts(A.SYMBOLS)})[((event_id // 5) % 4 + 1)::INT] END AS summary, CASE WHEN event_id % 6 = 0 THEN 'described' END AS description FROM events)"""
CLASSIFIED = f"""{ROUTES}, w AS (SELECT *, {norm('path')} AS normalized_path, {tok("lower(path) || ' ' || lower(symbol)")} AS every, {tok('lower(path)')} AS in_path, {tok('symbol')} AS in_name FROM r),
m AS (SELECT *, {WORDS},
 CASE WHEN {has('in_path', R.CANCEL_WORDS)} AND {has('every', R.ASYNC_NOUNS)} THEN CASE WHEN method IN ('POST', 'DELETE', 'PATCH') THEN 'cancel-word-with-async-resource 0.96' ELSE 'cancel-word-with-async-resource 0.82' END
  WHEN {has('in_path', R.CANCEL_WORDS)} THEN 'cancel-word 0.78'
  WHEN {has('in_name', R.CANCEL_WORDS)} AND {has('in_path', R.ASYNC_NOUNS)} AND {WRITES} THEN 'operation-name-cancel-on-async-resource 0.70'
  WHEN method = 'DELETE' AND {has('in_path', R.CANCELABLE)} THEN 'delete-async-resource 0.64' END AS c,
 CASE WHEN list_contains(codes, 202) AND {WRITES} THEN 'accepted-response 0.92'
  WHEN {has('every', R.ASYNC_NOUNS)} AND method = 'POST' AND NOT {has('in_path', R.QUERY_ACTIONS)} AND ({has('in_path', R.ASYNC_NOUNS)} OR {has('in_name', R.ASYNC_NOUNS)} OR list_contains(codes, 202)) THEN 'post-async-resource 0.78'
  WHEN method = 'GET' AND {has('in_path', R.ASYNC_NOUNS)} AND ({has('every', R.STATUS_WORDS)} OR {has('in_path', R.STATUS_WORDS)}) THEN 'status-resource 0.86'
  WHEN method = 'GET' AND {has('in_path', R.ASYNC_NOUNS)} THEN 'get-async-resource 0.68' END AS a FROM w),
k AS (SELECT *, '{R.CANCELLATION}' AS concept, c AS why FROM m WHERE c IS NOT NULL UNION ALL SELECT *, '{R.ASYNC}', a FROM m WHERE a IS NOT NULL),
cl AS (SELECT *, split_part(why, ' ', 1) AS reason, split_part(why, ' ', 2)::DOUBLE AS confidence, {pattern('codes')} AS pattern FROM k)"""
KEY = "repository, concept, method, normalized_path, source_kind"
Q = "row(list_contains({0}.codes, 202)::INT, len({0}.codes), {0}.confidence, (coalesce({0}.symbol, '') <> '')::INT, -coalesce({0}.line, 1000000))"
EVIDENCE = f"""{CLASSIFIED}, g AS (SELECT {KEY}, list({{'ord': ord, 'codes': codes, 'confidence': confidence, 'symbol': symbol, 'line': line, 'file': file, 'path': path, 'summary': summary, 'description': description}} ORDER BY ord) AS l FROM cl GROUP BY {KEY}),
fold AS (SELECT {KEY}, len(l) AS n_rows, list_reduce(l, lambda a, x: {{'ord': CASE WHEN {Q.format('x')} > {Q.format('a')} THEN x.ord ELSE a.ord END,
 'codes': list_sort(list_distinct(list_concat(a.codes, x.codes))), 'confidence': CASE WHEN {Q.format('x')} > {Q.format('a')} THEN x.confidence ELSE a.confidence END,
 'symbol': CASE WHEN {Q.format('x')} > {Q.format('a')} THEN x.symbol ELSE a.symbol END, 'line': CASE WHEN {Q.format('x')} > {Q.format('a')} THEN x.line ELSE a.line END,
 'file': CASE WHEN {Q.format('x')} > {Q.format('a')} THEN x.file ELSE a.file END, 'path': CASE WHEN {Q.format('x')} > {Q.format('a')} THEN x.path ELSE a.path END,
 'summary': CASE WHEN {Q.format('x')} > {Q.format('a')} THEN x.summary ELSE a.summary END, 'description': CASE WHEN {Q.format('x')} > {Q.format('a')} THEN x.description ELSE a.description END}}) AS z FROM g),
fw AS (SELECT {KEY}, n_rows, z.ord AS ord, z.codes AS codes, z.confidence AS confidence, z.symbol AS symbol, z.line AS line, z.path AS path, z.file AS file, z.summary AS summary, z.description AS description FROM fold),
ev AS (SELECT *, {pattern('codes')} AS pattern FROM (SELECT *, {WORDS} FROM fw)),
sig AS (SELECT repository, substr(sha256(array_to_string(list_sort(list(DISTINCT concept || '|' || pattern || '|' || method || '|' || normalized_path)), chr(10))), 1, 16) AS signature FROM ev GROUP BY repository)"""
FAMILIES = f"""{EVIDENCE}, u AS (SELECT DISTINCT user_id FROM events),
repos AS (SELECT 'org' || (user_id % 7) || '/svc' || user_id AS repo_id, user_id, 'org' || (user_id % 7) AS owner, 'svc' || user_id || CASE WHEN user_id % 11 = 3 THEN '-demo' ELSE '' END AS name,
 (['python', 'go', 'java', ''])[(user_id % 4 + 1)::INT] AS language, CASE WHEN user_id % 9 = 1 THEN 'up/r' || (user_id % 3) END AS fork_parent, CASE WHEN user_id % 10 = 2 THEN 'orig' || (user_id % 4) END AS probable_origin,
 CASE WHEN user_id % 13 = 5 THEN 'tutorial' ELSE 'service' END AS category, (['express', 'flask', '', NULL, 'gin'])[(user_id % 5 + 1)::INT] AS framework FROM u),
dup AS (SELECT signature, count(*) AS n FROM sig GROUP BY signature HAVING count(*) > 1),
fam AS (SELECT repo_id, language, CASE WHEN fork_parent IS NOT NULL THEN 'github:' || fork_parent WHEN probable_origin IS NOT NULL THEN 'origin:' || probable_origin WHEN n IS NOT NULL THEN 'api-signature:' || s.signature ELSE repo_id END AS family_id,
 CASE WHEN fork_parent IS NOT NULL THEN 'exact' WHEN probable_origin IS NOT NULL OR n IS NOT NULL THEN 'probable' ELSE 'unknown' END AS basis,
 CASE WHEN category = 'tutorial' THEN 'tutorial' WHEN name LIKE '%demo%' THEN 'template-or-demo' END AS reason FROM repos LEFT JOIN sig s ON repo_id = repository LEFT JOIN dup USING (signature)),
rw AS (SELECT ev.*, coalesce(family_id, repository) AS family_id FROM ev LEFT JOIN fam ON repository = repo_id WHERE reason IS NULL)"""
PM = "pm AS (SELECT concept, pattern, count(DISTINCT family_id) AS families, count(DISTINCT repository) AS repositories, count(*) AS evidence FROM {0} GROUP BY ALL)"


def concepts(source: str, entropy: str = "round(h, 4)") -> str:
    return f"""{PM.format(source)}, tot AS (SELECT concept, sum(families) AS s, count(*) AS k, max(families) AS mx, count(*) FILTER (families = 1) AS one FROM pm GROUP BY concept),
ent AS (SELECT concept, CASE WHEN any_value(k) > 1 THEN -sum(families / s * ln(families / s)) / ln(any_value(k)) ELSE 0 END AS h FROM pm JOIN tot USING (concept) GROUP BY concept),
pr AS (SELECT concept, repository, count(*) AS n FROM {source} GROUP BY ALL), cap AS (SELECT concept, sum(least(n, 50))::BIGINT AS capped, max(n) AS top, sum(n)::BIGINT AS evidence, count(*) AS repositories FROM pr GROUP BY concept),
fc AS (SELECT concept, count(DISTINCT family_id) AS families FROM {source} GROUP BY concept),
cm AS (SELECT concept, families, repositories, k AS patterns, evidence, capped, {entropy} AS entropy, round(mx / s, 4) AS dominant_ratio, round(one / k, 4) AS long_tail_ratio, round(top / evidence, 4) AS top_repository_share
 FROM fc JOIN tot USING (concept) JOIN ent USING (concept) JOIN cap USING (concept))"""


NP = canon("normalized_path")
LINK = f"""{FAMILIES}, ap AS (SELECT DISTINCT repository, unnest(list_filter([{NP}, CASE WHEN len({segs(NP)}) > 0 AND {has(tok(f'({segs(NP)})[-1]'), R.STATUS_WORDS)} THEN '/' || array_to_string(({segs(NP)})[1:len({segs(NP)})-1], '/') END,
 CASE WHEN method = 'POST' AND {has(tok(NP), R.ASYNC_NOUNS)} AND NOT ends_with({NP}, '/{{var}}') THEN {NP} || '/{{var}}' END], lambda p: p IS NOT NULL)) AS target_path FROM rw WHERE concept = '{R.ASYNC}'),
ct AS (SELECT *, {target('normalized_path')} AS target_path FROM rw WHERE concept = '{R.CANCELLATION}'),
c1 AS (SELECT ct.*, ap.target_path IS NOT NULL AS linked, {has(tok('ct.target_path'), R.ASYNC_NOUNS)} AS operation_target, pattern IN ({', '.join(f"'{p}'" for p in R.STRICT_PATTERNS)}) AS strict FROM ct LEFT JOIN ap ON ct.repository = ap.repository AND ct.target_path = ap.target_path),
c2 AS (SELECT *, strict AND NOT (linked OR operation_target) AS risk FROM c1),
lk AS (SELECT *, CASE WHEN linked THEN 'same-resource-linked' WHEN operation_target THEN 'operation-like-target' WHEN risk THEN 'domain-transition-risk' ELSE 'other' END AS bucket FROM c2)"""
TOTALS = ", ".join(
    f"count(*) FILTER ({t}) AS {n}_evidence, count(DISTINCT CASE WHEN {t} THEN repository END) AS {n}_repositories, count(DISTINCT CASE WHEN {t} THEN family_id END) AS {n}_families"
    for n, t in (("all", "true"), ("linked", "linked"), ("target", "operation_target"), ("risk", "risk"))
)
STRICT = ", ".join(f"'{p}'" for p in R.STRICT_PATTERNS)
FRAME = f"""{LINK}, rk AS (SELECT *, list_position({texts(R.PRIMARY_ORDER)}, pattern) AS nth_pattern FROM lk WHERE pattern IN ({', '.join(f"'{p}'" for p in R.PRIMARY_ORDER)})),
fr AS (SELECT * EXCLUDE (nth_pattern, best) FROM (SELECT *, min(nth_pattern) OVER (PARTITION BY repository, method, normalized_path) AS best FROM rk) WHERE nth_pattern = best)"""
CELLS = f"""{FRAME}, ce AS (SELECT pattern, family_id, count(*) AS size, bool_or(linked) AS l, bool_or(operation_target) AS t, bool_or(risk) AS k FROM fr GROUP BY ALL),
cells AS (SELECT pattern, family_id, size, CASE WHEN l AND k THEN 'mixed-same-resource-and-risk' WHEN l THEN 'same-resource-linked' WHEN t AND k THEN 'mixed-operation-target-and-risk' WHEN t THEN 'operation-like-target' WHEN k THEN 'domain-transition-risk' ELSE 'other' END AS bucket FROM ce)"""
def literal(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def standard_values() -> str:
    """ord, id, concept, entry's coverage, gap, conflict, evidence, confidence, then the standard's coverage, gap, confidence."""
    out = []
    for k, (name, found, sure, coverage, gap, entries) in enumerate(A.STANDARDS):
        for concept in found:
            own = entries.get(concept, (None, None, None, None, None))
            said = "[" + ", ".join(literal(x) for x in own[3] or []) + "]::VARCHAR[]"
            out.append(f"({k}, {literal(name)}, {literal(concept)}, {literal(own[0])}, {literal(own[1])}, {literal(own[2])}, {said}, {literal(own[4])}::DOUBLE, {literal(coverage)}, {literal(gap)}, {literal(sure)}::DOUBLE)")
    return ", ".join(out)


NAMED = f"""st AS (SELECT ord, id, concept, coalesce(nullif(c, ''), nullif(dc, ''), 'unknown') AS coverage, coalesce(nullif(g, ''), nullif(dg, ''), '') AS gap, coalesce(nullif(x, ''), 'none') AS conflict, e AS evidence, coalesce(s, ds, 0.7) AS confidence
 FROM (VALUES {standard_values()}) t(ord, id, concept, c, g, x, e, s, dc, dg, ds))"""
STANDARDS = f"""{NAMED},
cmp AS (SELECT concept, coalesce(arg_max(coverage, list_position({texts(R.COVERAGE_ORDER)}, coverage) * 100 - ord), 'unknown') AS coverage, coalesce(bool_or(lower(coalesce(conflict, '')) NOT IN ('', 'none', 'unknown')), false) AS conflict, count(id) AS standards FROM cm LEFT JOIN st USING (concept) GROUP BY concept)"""


def scores(source: str, name: str) -> str:
    return f"""{name} AS (SELECT concept, round_even(least(1.0, families / total) * 20, 0)::INT AS prevalence, round_even(least(1.0, families / 20) * 20, 0)::INT AS independence, round_even(entropy * 20, 0)::INT AS divergence,
 CASE concept WHEN '{R.ASYNC}' THEN 13 WHEN '{R.CANCELLATION}' THEN 12 ELSE 10 END AS interoperability, CASE coverage WHEN 'full' THEN 1 WHEN 'partial' THEN 8 WHEN 'adjacent' THEN 12 WHEN 'none' THEN 15 ELSE 10 END AS gap,
 CASE WHEN conflict THEN 2 ELSE 4 END AS correctness, CASE concept WHEN '{R.ASYNC}' THEN 4 WHEN '{R.CANCELLATION}' THEN 5 ELSE 3 END AS tractability,
 prevalence + independence + divergence + interoperability + gap + correctness + tractability AS score FROM {source} JOIN cmp USING (concept), tf)"""


def renamed(cte: str) -> str:
    """The concept metrics' steps under other names, so that they can stand beside those of all rows."""
    for x in ("pm", "tot", "ent", "pr", "cap", "fc", "cm"):
        cte = cte.replace(f"{x} AS (", f"s_{x} AS (").replace(f"FROM {x} ", f"FROM s_{x} ").replace(f"JOIN {x} ", f"JOIN s_{x} ")
    return cte


STRICT_ROWS = f"sr AS (SELECT * FROM rw WHERE pattern IN ({STRICT})), {renamed(concepts('sr', 'h'))}, kc AS (SELECT unnest({texts(R.CONCEPTS)}) AS concept)"
STRICT_METRICS = "sm AS (SELECT concept, coalesce(families, 0) AS families, coalesce(repositories, 0) AS repositories, coalesce(patterns, 0) AS patterns, coalesce(evidence, 0) AS evidence, coalesce(entropy, 0) AS entropy FROM kc FULL JOIN s_cm USING (concept))"
SCORE = f"""WITH {FAMILIES}, {concepts('rw')}, {STANDARDS}, tf AS (SELECT count(DISTINCT family_id) AS total FROM fam WHERE reason IS NULL), {scores('cm', 'sc')}, {STRICT_ROWS}, {STRICT_METRICS}, {scores('sm', 'ss')}"""
FRAMEWORK = " ".join(f"WHEN contains(x, '{m}') THEN '{m}'" for m in R.FRAMEWORK_MARKERS)
URL_PATH = canon("regexp_replace(url, '^https?://[^/]*', '')")
CODES = r"""list_concat(list_concat(CASE WHEN regexp_matches(html, '\b(?:HTTP_)?202(?:_ACCEPTED)?\b|Status202Accepted|StatusAccepted|http\.StatusAccepted') THEN [202] ELSE [] END,
 list_transform(regexp_extract_all(html, '\b(?:status|code|writeHead|sendStatus)\s*\(?\s*([1-5][0-9]{2})\b', 1), lambda c: c::INT)),
 list_filter(list_transform(regexp_extract_all(html, '\b([1-5][0-9]{2})\b', 1), lambda c: c::INT), lambda c: c IN (200, 201, 202, 204, 400, 404, 409, 422, 429, 500, 503)))"""
REST = f" pushed:>=2024-01-01 size:<{R.MAX_REPOSITORY_KB} archived:false fork:false"
AS_FILES = CLASSIFIED.replace(f"({texts(A.SYMBOLS)})[((event_id // 5) % 4 + 1)::INT] AS symbol", "'' AS symbol")
TOTAL = LINK + f", sco AS (SELECT *, unnest(CASE WHEN strict THEN [pattern, '(all)', '(strict)'] ELSE [pattern, '(all)'] END) AS scope FROM lk), tt AS (SELECT scope AS pattern, {TOTALS} FROM sco GROUP BY scope)"


def any_of(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in markers) + ")"


def at(values, step: int) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{listed}])[((event_id // {step}) % {len(values)} + 1)::INT]"


ITEM = f"""it AS (SELECT event_id, {at(A.ITEM_NAMES, 1)} || '-' || event_id AS long_name, {at(A.ITEM_TEXTS, 8)} AS description, {at(A.ITEM_TOPICS, 56)} AS topic FROM events),
nm AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN {at(A.ITEM_NAMES, 1)} ELSE long_name END AS name FROM it),
hs AS (SELECT *, lower(name || ' org/' || long_name || ' ' || coalesce(description, '') || ' ' || topic) AS x, lower(name || ' ' || coalesce(description, '') || ' ' || topic) AS y, name || ' org/' || long_name AS z FROM nm),
ok AS (SELECT * FROM hs WHERE event_id % 19 > 0 AND event_id % 23 > 0 AND event_id % 17 > 0 AND event_id % 260000 < {R.MAX_REPOSITORY_KB} AND NOT {any_of('z', R.NAME_MARKERS)} AND NOT {any_of('y', R.CONTENT_MARKERS + R.TOY_MARKERS)}
 AND NOT {any_of('x', R.ACTION_MARKERS + R.SDK_MARKERS)} AND NOT regexp_matches(name, '^setup-|^cli$|[-_]cli$|[-_](sdk|client)$') AND NOT contains(' ' || x || ' ', ' command line ') AND {any_of('x', R.SERVER_MARKERS + R.DOMAIN_MARKERS)})"""
CATEGORY = " ".join(f"WHEN contains(x, '{m}') THEN '{c}'" for m, c in R.CATEGORY_MARKERS.items())
DELETES = f"""{FRAME}, sl AS (SELECT DISTINCT family_id, target_path FROM fr WHERE strict AND linked),
dr AS (SELECT family_id, linked, linked AND (family_id, target_path) IN (SELECT (family_id, target_path) FROM sl) AS same, family_id IN (SELECT family_id FROM sl) AS f FROM fr WHERE pattern = '{R.DELETE_PATTERN}')"""
SAID = f"""list_concat(['## ' || concept, '- Score: ' || score, '- Families: ' || families, '- Repositories: ' || repositories, '- Patterns: ' || patterns, '- Evidence: ' || evidence, '- Evidence with at most 50 a repository: ' || capped,
 printf('- Entropy: %.4f', entropy), printf('- Dominant pattern: %.4f', dominant_ratio), printf('- Patterns of one family: %.4f', long_tail_ratio), printf('- Share of the largest repository: %.4f', top_repository_share), '- Coverage by standards: ' || coverage],
 list_filter([CASE WHEN families >= 5 THEN '- For: {R.FOR_FAMILIES}' END, CASE WHEN patterns >= 3 THEN '- For: {R.FOR_PATTERNS}' END, CASE WHEN coverage IN ('none', 'adjacent', 'unknown') THEN '- For: {R.FOR_GAP}' END,
 CASE concept WHEN '{R.CANCELLATION}' THEN '- For: {R.FOR_CONCEPT[R.CANCELLATION]}' ELSE '- For: {R.FOR_CONCEPT[R.ASYNC]}' END,
 CASE WHEN families < 5 THEN '- Low: {R.LOW_FAMILIES}' END, CASE WHEN patterns <= 1 THEN '- Low: {R.LOW_PATTERNS}' END, CASE WHEN coverage IN ('full', 'partial') THEN '- Low: {R.LOW_COVERED}' END, CASE WHEN conflict THEN '- Low: {R.LOW_CONFLICT}' END,
 '- Against: {R.AGAINST_ALWAYS[0]}', '- Against: {R.AGAINST_ALWAYS[1]}', CASE WHEN coverage = 'partial' THEN '- Against: {R.AGAINST_PARTIAL}' END, CASE WHEN vendors <= 2 THEN '- Against: {R.AGAINST_VENDORS}' END,
 CASE WHEN concept = '{R.CANCELLATION}' THEN '- Against: {R.AGAINST_CANCELLATION}' END], lambda v: v IS NOT NULL))"""
TENTHS = "({0}_families * 1000 // all_families + CASE WHEN ({0}_families * 1000 % all_families) * 2 > all_families OR ({0}_families * 1000 % all_families) * 2 = all_families AND ({0}_families * 1000 // all_families) % 2 = 1 THEN 1 ELSE 0 END)"
SHARES = " || ' | ' || ".join(f"{k}_families || ' (' || {TENTHS.format(k)} // 10 || '.' || {TENTHS.format(k)} % 10 || '%)'" for k in ("linked", "target", "risk"))

RATIO = "CASE WHEN {1} > 0 THEN printf('%.6f', {0} / {1}) ELSE '' END"
IDENTIFIED = """sha256(repository || chr(31) || method || chr(31) || normalized_path) AS route_id,
 sha256(sha256(repository || chr(31) || method || chr(31) || normalized_path) || chr(31) || chr(31) || pattern || chr(31) || source_kind || chr(31) || path || chr(31) || file || chr(31) || line || chr(31) || coalesce(symbol, '')) AS evidence_id"""
STRATUM = "pattern || ':' || CASE WHEN pattern = 'post-subresource-cancel' THEN CASE WHEN linked THEN 'linked' ELSE 'unlinked' END ELSE 'any' END"
ROUTE_BUCKET = "CASE WHEN linked THEN 'same-resource-linked' WHEN operation_target THEN 'operation-like-target' WHEN risk THEN 'domain-transition-risk' ELSE 'other' END"
POPULATION = f"CASE WHEN pattern = '{R.DELETE_PATTERN}' THEN 'delete-operation-resource-audit' ELSE 'strict-cancellation' END"
TAXONOMY = f"CASE WHEN pattern = '{R.DELETE_PATTERN}' THEN '{C.DELETE_TAXONOMY}' ELSE '{C.OTHER_TAXONOMY}' END"
SIZE_ROWS = ", ".join(f"('{p}', {n})" for p, n in SIZES.items())
STRATUM_ROWS = ", ".join(f"('{p}', {'NULL' if n is None else n})" for p, n in R.ROUTE_SAMPLE_SIZES["full"].items())
WEIGHTS = f"""{CELLS}, dw AS (SELECT pattern, count(*) AS population_size, least(count(*), any_value(n)) AS sample_size FROM cells JOIN (VALUES {SIZE_ROWS}) z(pattern, n) USING (pattern) GROUP BY pattern)"""
NEAR = f"""ne AS (SELECT repository, pattern, file, line, method, normalized_path, source_kind, unnest(list_distinct(list_filter([{NP}, CASE WHEN len({segs(NP)}) > 0 AND {has(tok(f'({segs(NP)})[-1]'), R.STATUS_WORDS)} THEN '/' || array_to_string(({segs(NP)})[1:len({segs(NP)})-1], '/') END,
 CASE WHEN method = 'POST' AND {has(tok(NP), R.ASYNC_NOUNS)} AND NOT ends_with({NP}, '/{{var}}') THEN {NP} || '/{{var}}' END], lambda p: p IS NOT NULL))) AS target_path FROM rw WHERE concept = '{R.ASYNC}')"""


def three(name: str, test: str) -> str:
    return f"""{name} AS (SELECT repository, target_path, string_agg(said, ' | ' ORDER BY nth) AS {name} FROM (SELECT repository, target_path, method || ' ' || normalized_path || ' ' || pattern || ' ' || file || ':' || line AS said,
 row_number() OVER (PARTITION BY repository, target_path ORDER BY pattern, file, line, method, normalized_path, source_kind) AS nth FROM ne WHERE {test}) WHERE nth <= 3 GROUP BY ALL)"""


SHEET = f"""WITH {FRAME}, {NEAR}, {three('every_said', 'true')}, {three('status_said', "pattern = 'get-status-resource'")},
cx AS (SELECT evidence_id, arg_max(struct_pack(s := coalesce(summary, ''), d := coalesce(description, '')), ord) AS x FROM (SELECT *, {IDENTIFIED} FROM ev) GROUP BY evidence_id),
sh AS (SELECT fr.*, {IDENTIFIED.replace('repository', 'fr.repository')}, coalesce(every_said, '') AS every_said, coalesce(status_said, '') AS status_said, array_to_string(codes, ',') AS codes_text FROM fr LEFT JOIN every_said USING (repository, target_path) LEFT JOIN status_said USING (repository, target_path))"""
MEMBERS = f"ms AS (SELECT family_id, array_to_string(list_filter({texts([p for p in R.PRIMARY_ORDER if p != R.DELETE_PATTERN])}, lambda p: list_contains(found, p)), ',') AS memberships FROM (SELECT family_id, list(DISTINCT pattern) AS found FROM fr WHERE pattern <> '{R.DELETE_PATTERN}' GROUP BY family_id))"


def counter(name: str, source: str, key: str) -> str:
    return f"SELECT '{name}' AS counter, {key} AS key, count(*) AS n FROM {source} GROUP BY ALL"


FAILED = "fl AS (SELECT DISTINCT 'org' || (user_id % 7) || '/svc' || user_id AS repo, user_id % 2 = 0 AS retryable, 'exit code ' || (user_id % 4) AS error FROM events WHERE user_id % 5 = 0)"
ITEMS = f"""{ITEM}, fo AS (SELECT event_id % 36 AS query_order, event_id // 36 AS item_order, 'q' || (event_id % 36) AS query, 'https://github.com/org/' || long_name AS repository_url FROM ok),
kn AS (SELECT DISTINCT repository_url FROM fo WHERE query_order < 2), pe AS (SELECT * FROM fo WHERE query_order >= 2),
fs AS (SELECT * FROM pe WHERE repository_url NOT IN (SELECT repository_url FROM kn) QUALIFY row_number() OVER (PARTITION BY repository_url ORDER BY query_order, item_order) = 1),
nw AS (SELECT * FROM fs QUALIFY row_number() OVER (ORDER BY query_order, item_order) <= greatest(0, {TARGET} - (SELECT count(*) FROM kn)))"""
SEEDS = """sd AS (SELECT event_id, event_id // 50 AS doc, event_id % 50 + 1 AS ordinal, 'https://github.com/o' || (event_id % 5) || '/n' || event_id || CASE event_id % 3 WHEN 1 THEN '.git' WHEN 2 THEN '/' ELSE '' END AS repository_url,
 CASE WHEN event_id % 3 = 2 THEN 'x' ELSE 'o' || (event_id % 5) END AS owner, CASE WHEN event_id % 3 = 2 THEN 'y' || event_id ELSE 'n' || event_id END AS name, CASE WHEN event_id % 3 = 1 THEN 'Go' END AS language,
 CASE WHEN event_id % 3 = 1 AND event_id % 2 = 1 THEN event_id % 9 END AS stars, event_id % 3 = 1 AS carried FROM events)"""
TEXTS = "tx AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN regexp_extract(props, '\\d+') || '.5' WHEN event_id % 7 = 0 THEN 'x' ELSE regexp_extract(props, '\\d+') END AS t FROM events)"

ORACLE_SQL = {
    "extracted_evidence": f"""WITH {AS_FILES}, ln AS (SELECT ord, (2 * row_number() OVER (PARTITION BY repository, ord // 500 ORDER BY ord) - 1)::INT AS line FROM r)
SELECT repository, repository || '/src/part' || (ord // 500) || '.ts' AS rel_path, ln.line AS line, method, path, concept, reason, pattern, round(confidence - 0.08, 4) AS confidence, array_to_string(codes, ',') AS codes FROM cl JOIN ln USING (ord)""",
    "discovery_seeds": f"""WITH {ITEM} SELECT 'https://github.com/org/' || long_name AS repository_url, 'org' AS owner, long_name AS name, CASE WHEN event_id % 4 > 0 THEN 'Go' END AS language, CASE {FRAMEWORK} WHEN event_id % 4 > 0 THEN 'Go' END AS framework, event_id % 900 AS stars,
 CASE {CATEGORY} ELSE 'api-candidate' END AS project_category, CASE WHEN {any_of('x', R.TEMPLATE_MARKERS)} THEN 'metadata-indicator' WHEN {any_of('x', R.SDK_MARKERS)} THEN 'generated-sdk-suspect' END AS probable_template, CASE WHEN event_id % 2 = 0 THEN 'vendor' ELSE 'org' END AS vendor, event_id % 260000 AS size_kb FROM ok""",
    "delete_buckets": f"WITH {DELETES} SELECT family_id, CASE WHEN NOT bool_or(linked) THEN 'delete-unlinked' WHEN NOT bool_or(f) THEN 'delete-only-linked' WHEN bool_or(same) THEN 'delete-and-strict-same-resource' ELSE 'delete-and-strict-different-resource' END AS bucket FROM dr GROUP BY family_id",
    "concept_report": f"{SCORE}, said AS (SELECT concept, {SAID} AS l FROM cm JOIN cmp USING (concept) JOIN (SELECT concept, count(DISTINCT split_part(repository, '/', 1)) AS vendors FROM rw GROUP BY concept) USING (concept) JOIN (SELECT concept, score FROM sc) USING (concept)) SELECT concept, unnest(range(len(l))) AS nth, unnest(l) AS line FROM said",
    "linkage_report": f"WITH {TOTAL} SELECT pattern, '| ' || pattern || ' | ' || all_families || ' | ' || {SHARES} || ' |' AS line FROM tt",
    "concept_metrics": f"WITH {FAMILIES}, {concepts('rw')} SELECT * FROM cm",
    "normalize_path": f"WITH {ROUTES} SELECT ord, {norm('path')} AS normalized_path FROM r",
    "tokenize": f"WITH {ROUTES} SELECT ord, array_to_string(list_sort({tok('path || chr(32) || symbol')}), ' ') AS tokens FROM r",
    "classify_route": f"WITH {CLASSIFIED} SELECT ord, concept, confidence, reason FROM cl",
    "assign_pattern": f"WITH {CLASSIFIED} SELECT ord, concept, pattern FROM cl",
    "response_codes": f"SELECT page_id, array_to_string(list_sort(list_distinct({CODES})), ',') AS codes FROM pages",
    "canonical_segments": f"SELECT page_id, {URL_PATH} AS path, len({segs(URL_PATH)}) AS n_segments FROM pages",
    "cancel_target_path": f"WITH {ROUTES}, n AS (SELECT ord, {norm('path')} AS p FROM r) SELECT ord, {target('p')} AS target_path FROM n",
    "api_signature": f"WITH {EVIDENCE} SELECT * FROM sig",
    "stable_ids": f"WITH {CLASSIFIED} SELECT ord, concept, sha256(repository || chr(31) || method || chr(31) || normalized_path) AS route_id FROM cl",
    "dedupe_fold": f"WITH {EVIDENCE} SELECT {KEY}, n_rows, ord, array_to_string(codes, ',') AS codes, confidence, line, pattern FROM ev",
    "family_mapping": f"WITH {FAMILIES} SELECT repo_id, family_id, basis, reason IS NOT NULL AS excluded, reason FROM fam",
    "duplicate_signatures": f"WITH {EVIDENCE} SELECT signature, count(*) AS repositories FROM sig GROUP BY signature HAVING count(*) > 1",
    "pattern_metrics": f"WITH {FAMILIES}, {PM.format('rw')} SELECT * FROM pm",
    "pattern_examples_top5": f"WITH {FAMILIES}, e AS (SELECT *, row_number() OVER (PARTITION BY concept, pattern ORDER BY ord) AS nth FROM rw) SELECT concept, pattern, nth, repository, file, line, method, path, normalized_path, confidence, source_kind AS extractor FROM e WHERE nth <= 5",
    "top_evidence_repositories": f"WITH {FAMILIES}, e AS (SELECT concept, repository, count(*) AS evidence, min(ord) AS f FROM rw GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY evidence DESC, f) AS nth, round(evidence / sum(evidence) OVER (PARTITION BY concept), 4) AS share FROM e) SELECT concept, nth, repository, evidence, share FROM o WHERE nth <= 10",
    "distribution_language": f"WITH {FAMILIES}, d AS (SELECT DISTINCT concept, repository FROM rw) SELECT concept, coalesce(nullif(language, ''), 'unknown') AS language, count(*) AS repositories FROM d JOIN repos ON repository = repo_id GROUP BY ALL",
    "linkage_records": f"WITH {LINK} SELECT repository, family_id, method, normalized_path, source_kind, target_path, linked, strict, risk, bucket FROM lk",
    "linkage_totals": f"WITH {TOTAL} SELECT * FROM tt",
    "linkage_envelope": f"WITH {LINK}, f AS (SELECT family_id, bool_or(strict) AS s, bool_or(pattern = 'delete-operation-resource') AS d FROM lk WHERE linked GROUP BY family_id) SELECT count(*) FILTER (s) AS strict, count(*) FILTER (d) AS deletes, count(*) FILTER (s AND d) AS overlap, count(*) FILTER (s OR d) AS either FROM f",
    "strict_metrics": f"WITH {FAMILIES}, {STRICT_ROWS}, {STRICT_METRICS} SELECT * FROM sm",
    "standards_rows": f"WITH {NAMED}, co AS (SELECT unnest({texts([*R.CONCEPTS, 'http-other'])}) AS concept) SELECT concept, coalesce(id, '') AS id, coalesce(coverage, 'unknown') AS coverage, coalesce(gap, '{R.NO_STANDARD}') AS gap, coalesce(conflict, 'unknown') AS conflict, coalesce(array_to_string(evidence, ';'), '') AS evidence, coalesce(confidence, 0) AS confidence FROM co LEFT JOIN st USING (concept)",
    "standards_comparison": f"WITH {FAMILIES}, {concepts('rw')}, {STANDARDS} SELECT * FROM cmp",
    "opportunity_scores": f"{SCORE} SELECT sc.*, ss.score AS strict_score, sm.families AS strict_families, sm.repositories AS strict_repositories, sm.evidence AS strict_evidence, sm.patterns AS strict_patterns FROM sc LEFT JOIN ss USING (concept) LEFT JOIN sm USING (concept)",
    "primary_pattern": f"WITH {FRAME} SELECT pattern, count(*) AS rows, count(DISTINCT family_id) AS families FROM fr GROUP BY pattern",
    "family_pattern_cells": f"WITH {CELLS} SELECT * FROM cells",
    "family_inclusion_probability": f"WITH {WEIGHTS}, p AS (SELECT family_id, 1 - product(1 - sample_size / population_size) AS p FROM (SELECT DISTINCT family_id, pattern FROM cells WHERE pattern <> '{R.DELETE_PATTERN}') JOIN dw USING (pattern) GROUP BY family_id) SELECT family_id, printf('%.6f', p) AS probability, printf('%.6f', CASE WHEN p > 0 THEN 1 / p ELSE 0 END) AS weight FROM p",
    "resume_antijoin": "SELECT DISTINCT 'org' || (user_id % 7) || '/svc' || user_id AS repo_id FROM events WHERE user_id % 3 <> 0",
    "retry_prune": f"WITH {ROUTES}, {FAILED}, ag AS (SELECT repo FROM fl WHERE retryable), us AS (SELECT DISTINCT repository FROM r) SELECT 'repositories' AS \"table\", repository AS repo_id, count(*) AS rows FROM us WHERE repository NOT IN (FROM ag) GROUP BY ALL UNION ALL SELECT 'evidence', repository, count(*) FROM r WHERE repository NOT IN (FROM ag) GROUP BY ALL UNION ALL SELECT 'errors', repo, count(*) FROM fl WHERE repo NOT IN (FROM ag) GROUP BY ALL",
    "first_seen": f"WITH {ROUTES} SELECT repository, ord, path FROM r QUALIFY row_number() OVER (PARTITION BY repository ORDER BY ord) = 1",
    "discovery_queries": f"WITH t AS (SELECT unnest({texts(R.SEARCH_TERMS)}) AS term, unnest(range({len(R.SEARCH_TERMS)})) AS i), g AS (SELECT unnest({texts(R.SEARCH_LANGUAGES)}) AS l, unnest(range({len(R.SEARCH_LANGUAGES)})) AS j) SELECT i * {len(R.SEARCH_LANGUAGES)} + j AS ord, term || ' language:' || l || ' stars:>=20{REST}' AS query FROM t, g UNION ALL SELECT i + {len(R.SEARCH_TERMS) * len(R.SEARCH_LANGUAGES)}, term || ' stars:>=100{REST}' FROM t",
    "framework_inference": f"SELECT page_id, CASE {FRAMEWORK} ELSE 'none' END AS framework FROM (SELECT page_id, lower(concat_ws(' ', url, html)) AS x FROM pages)",
    "href_links": "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages",
    "stream_dedupe": f"WITH {ROUTES} SELECT DISTINCT repository FROM r",
    "report_ratios": f"WITH {LINK} SELECT pattern, printf('%.4f', count(*) FILTER (linked) / count(*)) AS linked_ratio, printf('%.4f', count(*) FILTER (risk) / count(*)) AS risk_ratio FROM lk GROUP BY pattern",
    "manual_review_top100": f"WITH {EVIDENCE}, {FAILED}, o AS (SELECT *, row_number() OVER (ORDER BY concept, repository, file, line, method, normalized_path, source_kind) AS nth FROM ev), f AS (SELECT *, row_number() OVER (ORDER BY repo, error) AS nth FROM fl) SELECT 'evidence' AS section, nth, '- [ ] TP  [ ] FP  [ ] Unclassified — `' || concept || '` `' || pattern || '` `' || repository || '` `' || method || ' ' || path || '` `' || file || ':' || line || '` confidence=' || confidence AS line FROM o WHERE nth <= 100 UNION ALL SELECT 'error', nth, '- [ ] Review — `' || repo || '` `collect` `git_clone_failed` retryable=' || CASE WHEN retryable THEN 'True' ELSE 'False' END || ': ' || error FROM f WHERE nth <= 100",
    "adjacent_evidence": f"WITH {LINK}, ad AS (SELECT repository, target_path, count(*) AS adjacent FROM (SELECT repository, unnest(list_distinct(list_filter([{NP}, CASE WHEN len({segs(NP)}) > 0 AND {has(tok(f'({segs(NP)})[-1]'), R.STATUS_WORDS)} THEN '/' || array_to_string(({segs(NP)})[1:len({segs(NP)})-1], '/') END, CASE WHEN method = 'POST' AND {has(tok(NP), R.ASYNC_NOUNS)} AND NOT ends_with({NP}, '/{{var}}') THEN {NP} || '/{{var}}' END], lambda p: p IS NOT NULL))) AS target_path FROM rw WHERE concept = '{R.ASYNC}') GROUP BY ALL) SELECT lk.repository, lk.method, lk.normalized_path, lk.source_kind, coalesce(adjacent, 0) AS adjacent FROM lk LEFT JOIN ad USING (repository, target_path)",
    "blind_view": f"{SHEET} SELECT evidence_id, method AS httpMethod, path, line::VARCHAR AS lineStart, codes_text AS responseCodes, x.s AS operationSummary, x.d AS operationDescription, CASE WHEN codes_text = '' THEN '' ELSE 'cancel response codes: ' || codes_text END AS responseSemanticsEvidence, {TAXONOMY} AS label_taxonomy, CASE WHEN pattern = '{R.DELETE_PATTERN}' THEN '{C.DELETE_LABELS}' ELSE '{C.OTHER_LABELS}' END AS allowed_final_labels, '' AS final_label FROM sh LEFT JOIN cx USING (evidence_id)",
    "machine_view": f"{SHEET} SELECT evidence_id, route_id, family_id, pattern, bucket AS linkageBucket, {POPULATION} AS estimationPopulation, target_path AS cancelTargetPath, linked::VARCHAR AS routeLevelOperationLinked, operation_target::VARCHAR AS operationTarget, risk::VARCHAR AS domainTransitionRisk, every_said AS adjacentOperationEvidence, status_said AS terminalStateEvidence, confidence::VARCHAR AS confidence, '' AS primaryLabel FROM sh",
    "evidence_ids": f"WITH {EVIDENCE} SELECT {KEY}, {IDENTIFIED} FROM ev",
    "cell_evidence": f"WITH {FRAME}, ii AS (SELECT *, {IDENTIFIED} FROM fr), o AS (SELECT *, row_number() OVER (PARTITION BY pattern, family_id ORDER BY repository, method, normalized_path, path, source_kind, line, file, evidence_id) AS nth FROM ii) SELECT pattern, family_id, count(*) AS n_routes, bool_or(linked) AS any_linked, bool_or(operation_target) AS any_target, bool_or(risk) AS any_risk, string_agg(method || ' ' || normalized_path || ' ' || {ROUTE_BUCKET} || ' ' || file || ':' || line, ' | ' ORDER BY nth) FILTER (nth <= 5) || CASE WHEN count(*) > 5 THEN ' | ... +' || (count(*) - 5) || ' more' ELSE '' END AS cell_text FROM o GROUP BY pattern, family_id",
    "design_weights": f"WITH {WEIGHTS} SELECT *, {RATIO.format('sample_size', 'population_size')} AS fraction, {RATIO.format('population_size', 'sample_size')} AS weight FROM dw",
    "strict_memberships": f"WITH {FRAME}, {MEMBERS} SELECT * FROM ms",
    "sheet_summary": f"WITH {CELLS}, {MEMBERS} "
    + " UNION ALL ".join([
        counter("byPattern", "fr", "pattern"), counter("byLinkageBucket", "fr", ROUTE_BUCKET), counter("byEstimationPopulation", "fr", POPULATION), counter("bySourceKind", "fr", "source_kind"),
        counter("bySourceKindByPattern", "fr", "source_kind || '/' || pattern"), counter("byTaxonomy", "fr", TAXONOMY), counter("byStratum", "fr", STRATUM), counter("byLinked", "fr", "CASE WHEN linked THEN 'linked' ELSE 'unlinked' END"),
        counter("cellSizes", "cells", "size::VARCHAR"), counter("byMembershipCount", "ms", "len(string_split(memberships, ','))::VARCHAR"),
        "SELECT 'cellRouteCounts', 'selectedCells', count(*) FROM cells", "SELECT 'cellRouteCounts', 'selectedRouteRecords', coalesce(sum(size), 0)::BIGINT FROM cells", "SELECT 'cellRouteCounts', 'extraRouteLabelsIfClusterCensus', (coalesce(sum(size), 0) - count(*))::BIGINT FROM cells",
    ]),
    "label_agreement": "WITH p AS (SELECT quality::VARCHAR AS a, toxic::VARCHAR AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), t AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS agreed FROM p), c AS (SELECT coalesce(sum(x.n * y.n), 0) AS products FROM (SELECT a AS label, count(*)::DOUBLE AS n FROM p GROUP BY a) x JOIN (SELECT b AS label, count(*) AS n FROM p GROUP BY b) y USING (label)) SELECT n, agreed, round(CASE WHEN products / (n::DOUBLE * n) < 1 THEN (agreed / n - products / (n::DOUBLE * n)) / (1 - products / (n::DOUBLE * n)) ELSE 1 END, 6) AS kappa FROM t, c WHERE n > 0",
    "stratified_bounds": f"WITH {FRAME}, sa AS (SELECT *, {STRATUM} AS stratum, ({texts(LABELS)})[line % 3 + 1] AS label FROM fr), q AS (SELECT stratum, count(*) AS size, count(*) FILTER (line % 2 = 0) AS n, count(*) FILTER (line % 2 = 0 AND label = '{LABELS[0]}') AS yes, count(*) FILTER (line % 2 = 0 AND label = 'ambiguous') AS open_n FROM sa GROUP BY stratum) SELECT sum(n)::BIGINT AS labelled, round(sum(size * yes / n) / sum(size), 6) AS low, round(sum(size * (yes + open_n) / n) / sum(size), 6) AS high FROM q WHERE n > 0",
    "distributions": f"WITH {FAMILIES}, d AS (SELECT DISTINCT concept, repository FROM rw), j AS (SELECT concept, unnest(['language', 'framework', 'vendor']) AS field, unnest([coalesce(nullif(repos.language, ''), 'unknown'), coalesce(nullif(framework, ''), 'unknown'), owner]) AS value FROM d JOIN repos ON repository = repo_id) SELECT concept, field, value, count(*) AS repositories FROM j GROUP BY ALL",
    "linkage_ratios": f"WITH {TOTAL}, {PM.format('rw')}, z AS (SELECT coalesce(max(all_families), 0) AS al, coalesce(max(linked_families), 0) AS li, coalesce(max(target_families), 0) AS ta, coalesce(max(risk_families), 0) AS ri FROM tt WHERE pattern = '(strict)'), n AS (SELECT count(DISTINCT family_id) AS near FROM rw WHERE concept = '{R.ASYNC}'), f AS (SELECT family_id, bool_or(strict) AS s, bool_or(pattern = 'delete-operation-resource') AS d FROM lk WHERE linked GROUP BY family_id), e AS (SELECT count(*) FILTER (s) AS strict, count(*) FILTER (d) AS deletes, count(*) FILTER (s AND d) AS overlap, count(*) FILTER (s OR d) AS either FROM f), y AS ("
    + " UNION ALL ".join(
        [f"SELECT {i} AS nth, '{claim}' AS claim, {n[:2]} AS numerator, '{of}' AS population, {'near' if of.startswith('async') else 'al'} AS denominator, '{use}' AS use FROM z, n, e" for i, (claim, n, of, use) in enumerate(R.RATIO_CLAIMS)]
        + [f"SELECT {i + len(R.RATIO_CLAIMS)}, '{claim}', {n}, 'async-operation families', near, '{use}' FROM z, n, e" for i, (claim, n, use) in enumerate(R.ENVELOPE_PARTS)]
    )
    + f"), tn AS (SELECT *, {TENTHS.replace('{0}_families', 'numerator').replace('all_families', 'denominator')} AS tenths FROM y) SELECT nth, claim, numerator, population, denominator, use, CASE WHEN denominator > 0 THEN (tenths // 10) || '.' || (tenths % 10) || '%' ELSE 'n/a' END AS share FROM tn",
    "seed_rows": f"WITH {SEEDS} SELECT doc, ordinal, repository_url, owner, name, language, stars, carried FROM sd",
    "repository_rows": f"WITH {SEEDS} SELECT owner || '/' || name AS repo_id, repository_url, coalesce(language, CASE WHEN event_id % 4 = 0 THEN 'Rust' END) AS language, coalesce(stars, CASE WHEN event_id % 4 = 0 THEN event_id % 7 END) AS stars, CASE WHEN event_id % 4 = 0 THEN event_id % 11 END AS forks, CASE WHEN event_id % 8 = 0 THEN 'MIT' WHEN event_id % 4 = 0 THEN 'apache' END AS license, CASE WHEN event_id % 4 = 0 THEN '2025-02-03' END AS last_activity, CASE WHEN event_id % 4 = 0 THEN 'trunk' END AS default_branch, CASE WHEN event_id % 12 = 0 THEN 'up/stream' END AS fork_parent, CASE WHEN event_id % 12 = 0 THEN 'up/stream' END AS probable_origin, owner AS vendor FROM sd",
    "discovery_run": f"WITH {ITEMS} SELECT query, query_order, item_order, repository_url FROM nw",
    "discovery_log": f"WITH {ITEMS}, g AS (SELECT greatest(0, {TARGET} - (SELECT count(*) FROM kn)) AS need, (SELECT count(*) FROM nw) AS taken, (SELECT max(query_order) FROM nw) AS last), qs AS (SELECT DISTINCT query, query_order FROM pe) SELECT query, query_order, true AS completed, (SELECT count(*) FROM nw WHERE nw.query = qs.query) AS new_repositories FROM qs, g WHERE need > 0 AND (taken < need OR query_order <= last)",
    "ordered_outputs": f"WITH {CLASSIFIED} SELECT coalesce(CASE WHEN substr(repository, strpos(repository, '/svc') + 4)::BIGINT % 3 > 0 THEN substr(repository, strpos(repository, '/svc') + 4)::BIGINT END, 1000000000000) AS seed_order, repository, file, line, method, path, concept, ord FROM cl",
    "safe_casts": f"WITH {TEXTS}, v AS (SELECT *, CASE WHEN regexp_full_match(t, '\\d+') THEN t::INT END AS i, coalesce(try_cast(t AS DOUBLE), 0) AS f FROM tx) SELECT event_id, coalesce(i, 1000000) AS as_int, f AS as_float, array_to_string(list_sort(list_distinct(list_filter([202, i], lambda c: c IS NOT NULL))), ',') AS codes, CASE WHEN event_id % 4 > 0 THEN printf('%.6f', f / (event_id % 4)) ELSE '' END AS ratio, (['openapi', 'source', 'other', ''])[(event_id % 4 + 1)::INT] AS kind FROM v",
    "evidence_records": f"WITH {ROUTES} SELECT ord, method, array_to_string(list_sort(list_distinct([codes[1], 404, 202])), ',') AS codes, line AS line_end, round((ord % 97) / 97, 4) AS confidence, '0.1.0' AS extractor_version FROM r",
    "excluded_repositories": f"WITH {FAMILIES} SELECT reason, count(*) AS repositories FROM fam WHERE reason IS NOT NULL GROUP BY reason",
    "route_weights": f"WITH {FRAME}, q AS (SELECT {STRATUM} AS stratum, count(*) AS stratum_size FROM fr GROUP BY ALL), t AS (SELECT stratum, stratum_size, least(stratum_size, coalesce(n, stratum_size)) AS sampled FROM q LEFT JOIN (VALUES {STRATUM_ROWS}) z(stratum, n) USING (stratum)) SELECT *, {RATIO.format('sampled', 'stratum_size')} AS fraction, {RATIO.format('stratum_size', 'sampled')} AS weight FROM t",
}
