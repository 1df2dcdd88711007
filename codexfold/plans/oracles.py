"""Independent SQL for the queries, run by the checking database.

The dialect's regular expressions are RE2. Written from the rules, not from the
DataFrame code: whole windows where Spark uses blocks, joins where Spark unions.
"""

from __future__ import annotations

import re

from codexfold import constants as K
from codexfold.functions.text import WHITESPACE
from codexfold.plans.bindings import BINDINGS, check_sql


def lit(text: str) -> str:
    pieces = [f"chr({ord(p)})" if p == "\n" else "'" + p.replace("'", "''") + "'" for p in re.split(r"(\n)", text) if p]
    return "(" + " || ".join(pieces or ["''"]) + ")"


WS = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"
FENCE = r"(?s)```(\w+)?(?::([^\n]+))?\n(.*?)```"


def strip(text: str) -> str:
    return f"trim({text}, {WS})"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def case_map(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


SUFFIX = r"lower(regexp_extract(string_split({0}, '/')[-1], '(?s)^.+(\.[^.]+)$', 1))"
HEADER = len(K.FRAME_HEAD) + len(K.FRAME_TAIL)


def marker(word: str) -> str:
    return rf"(?i)<!--\s*SECTION:\s*{word}\s*-->"


def _spot(tag: str, word: str) -> str:
    found = f"regexp_matches(text, '{marker(word)}')"
    start = f"length(regexp_extract(text, '(?s)^(.*?){marker(word)}', 1))"
    return (
        f"CASE WHEN {found} THEN {start} END AS {tag}0, "
        f"CASE WHEN {found} THEN {start} + length(regexp_extract(text, '{marker(word)}')) END AS {tag}1"
    )


def between(start: str, end: str) -> str:
    return strip(f"substring(text, {start} + 1, greatest({end} - {start}, 0))")


TYPES = r"(?m)^public class (\w+) extends (\w+)(?:<.*>)? implements (\w+), (\w+) \{"

# Common tables: bindings by their name, plus these.
SHARED = {
    "kept": f"""SELECT *, length(path) + length(content) + {HEADER} AS chars FROM files
WHERE {SUFFIX.format('path')} IN ({quoted(K.SOURCE_SUFFIXES)}) AND NOT list_has_any(string_split(path, '/'), [{quoted(K.VENDORED_DIRS)}])""",
    "packed": f"""SELECT * FROM (SELECT *, CAST(sum(chars) OVER (PARTITION BY repo_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_chars FROM kept)
WHERE running_chars <= {K.PACK_BUDGET}""",
    "digests": f"""SELECT repo_id, string_agg({lit(K.FRAME_HEAD)} || path || {lit(K.FRAME_TAIL)} || content, '' ORDER BY ord) AS digest, count(*) AS files_packed FROM packed GROUP BY repo_id""",
    "gen": f"""SELECT doc_id, repo_id, pattern, ord, {strip("coalesce(p, 'output.' || coalesce(l, target_lang))")} AS path, {strip('c')} AS content, coalesce(l, target_lang) AS language
FROM (SELECT doc_id, repo_id, pattern, target_lang, nullif(l, '') AS l, nullif(p, '') AS p, c, i - 1 AS ord FROM (
  SELECT *, unnest(regexp_extract_all(text, '{FENCE}', 1)) AS l, unnest(regexp_extract_all(text, '{FENCE}', 2)) AS p, unnest(regexp_extract_all(text, '{FENCE}', 3)) AS c,
    generate_subscripts(regexp_extract_all(text, '{FENCE}', 0), 1) AS i FROM fenced_docs))
UNION ALL SELECT doc_id, repo_id, pattern, 0, 'output.' || target_lang, {strip('text')}, target_lang FROM fenced_docs WHERE NOT regexp_matches(text, '{FENCE}')""",
    "state": "SELECT s.session_id, "
    + ", ".join(
        f"coalesce(arg_max(d.value, d.seq) FILTER (WHERE d.key = '{k}'), {'any_value(s.' + k + ')' if v is None else lit(v)}) AS {k}"
        for k, v in K.SESSION_DEFAULTS.items()
    )
    + " FROM sessions s LEFT JOIN deltas d ON d.session_id = s.session_id GROUP BY s.session_id",
    "texts": f"""SELECT session_id, seq, name, lower('.' || string_split(name, '.')[-1]) AS suffix,
  CASE lower('.' || string_split(name, '.')[-1]) WHEN '.pdf' THEN 'needs_decoder' WHEN '.json' THEN CASE WHEN json_valid(content) THEN 'extracted' ELSE 'failed' END ELSE 'extracted' END AS status,
  CASE lower('.' || string_split(name, '.')[-1]) WHEN '.pdf' THEN NULL WHEN '.json' THEN
    CASE WHEN json_valid(content) THEN '{{' || chr(10) || '  "k": ' || json_extract_string(content, '$.k') || chr(10) || '}}'
    ELSE '[Could not extract text from ' || name || ': Expecting '','' delimiter: line 1 column ' || CAST(length(content) + 1 AS VARCHAR) || ' (char ' || CAST(length(content) AS VARCHAR) || ')]' END
  ELSE content END AS text
FROM context_files""",
    "spots": f"""SELECT doc_id, text, {_spot('a', 'ANALYSIS')}, {_spot('b', 'BRD')}, {_spot('t', 'TECHNICAL_SPECIFICATION')}, {_spot('e', 'END')} FROM section_docs""",
    "sections": f"""SELECT doc_id, 'analysis' AS section, CASE WHEN a0 IS NOT NULL AND b0 IS NOT NULL THEN {between('a1', 'b0')} ELSE text END AS text,
  CASE WHEN a0 IS NOT NULL AND b0 IS NOT NULL THEN 'between' ELSE 'whole' END AS rule FROM spots
UNION ALL SELECT doc_id, 'brd', CASE WHEN brd = '' THEN text ELSE brd END, CASE WHEN b0 IS NULL THEN 'whole' WHEN brd = '' THEN 'blank_whole' WHEN t0 IS NOT NULL THEN 'between' ELSE 'to_end' END
FROM (SELECT *, CASE WHEN b0 IS NULL THEN text ELSE {between('b1', 'coalesce(t0, length(text))')} END AS brd FROM spots)
UNION ALL SELECT doc_id, 'technical_spec', CASE WHEN t0 IS NULL THEN '' ELSE {between('t1', 'coalesce(e0, length(text))')} END,
  CASE WHEN t0 IS NULL THEN 'absent' WHEN e0 IS NOT NULL THEN 'between' ELSE 'to_end' END FROM spots""",
    "diagrams": rf"""SELECT doc_id, repo_id, ord, regexp_extract(body, '^\s*(\w+)', 1) AS kind, body FROM (
  SELECT doc_id, repo_id, i - 1 AS ord, l, p, regexp_replace(c, '\n$', '') AS body FROM (
    SELECT *, unnest(regexp_extract_all(text, '{FENCE}', 1)) AS l, unnest(regexp_extract_all(text, '{FENCE}', 2)) AS p, unnest(regexp_extract_all(text, '{FENCE}', 3)) AS c,
      generate_subscripts(regexp_extract_all(text, '{FENCE}', 0), 1) AS i FROM fenced_docs))
WHERE l = 'mermaid' AND coalesce(p, '') = ''""",
    "drawn": r"""SELECT doc_id, repo_id, regexp_extract(e, '^\s*(\w+)', 1) AS source, regexp_extract(e, '--> (\w+)', 1) AS target
FROM (SELECT doc_id, repo_id, unnest(regexp_extract_all(body, '(?m)^.*-->.*$')) AS e FROM diagrams)""",
    "ends": "SELECT session_id, min(seq) AS last FROM event_log WHERE type IN ('workflow-complete', 'error') GROUP BY session_id",
    "live": "SELECT l.* FROM event_log l LEFT JOIN ends e ON e.session_id = l.session_id WHERE e.last IS NULL OR l.seq < e.last",
    "status": f"""SELECT s.session_id, CASE WHEN any_value(t.type) IS NOT NULL THEN any_value({case_map('t.type', K.TERMINAL_STEP)}) ELSE coalesce(arg_max(v.new_step, v.seq) FILTER (WHERE v.new_step IS NOT NULL), 'upload') END AS step,
  CASE WHEN any_value(t.type) = 'error' THEN coalesce(any_value(t.message), '{K.DEFAULT_ERROR}') END AS error
FROM (SELECT DISTINCT session_id FROM event_log) s
LEFT JOIN (SELECT session_id, seq, CASE WHEN type = 'step-change' THEN nullif(step, '') ELSE {case_map('type', K.READY_STEP)} END AS new_step FROM live) v ON v.session_id = s.session_id
LEFT JOIN (SELECT l.* FROM event_log l JOIN ends e ON e.session_id = l.session_id AND e.last = l.seq) t ON t.session_id = s.session_id
GROUP BY s.session_id""",
    "steps": "SELECT step, idx FROM (VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate(K.STEP_ORDER)) + ") v(step, idx)",
    "flags": """SELECT s.session_id, d.step, CAST(d.idx AS BIGINT) AS idx, d.idx < c.at OR (d.idx = c.at AND d.idx = 6) AS is_complete, d.idx = c.at AND d.idx <> 6 AS is_current, d.idx > c.at AS is_pending
FROM status s JOIN (SELECT session_id, coalesce(d.idx, -1) AS at FROM status LEFT JOIN steps d ON d.step = status.step) c ON c.session_id = s.session_id CROSS JOIN steps d""",
    "imports": r"""SELECT repo_id, source, regexp_extract(i, '^import (.*)\.\w+;$', 1) AS target FROM (
  SELECT repo_id, regexp_extract(content, '(?m)^package ([\w.]+);', 1) AS source, unnest(regexp_extract_all(content, '(?m)^import [\w.]+;')) AS i FROM java_files)""",
    "edges": """SELECT e.repo_id, e.source, e.target, e.weight, d.package IS NOT NULL AS internal
FROM (SELECT repo_id, source, target, count(*) AS weight FROM imports WHERE source <> target GROUP BY ALL) e
LEFT JOIN (SELECT DISTINCT repo_id, source AS package FROM imports) d ON d.repo_id = e.repo_id AND d.package = e.target""",
    "types": rf"""SELECT repo_id, regexp_extract(content, '{TYPES}', 1) AS type, regexp_extract(content, '{TYPES}', 2) AS parent FROM java_files""",
    "routes": r"""SELECT repo_id, path, CASE WHEN m LIKE '@Get%' THEN 'GET' ELSE 'POST' END AS verb,
  regexp_extract(content, '@RequestMapping\("([^"]*)"', 1) || regexp_extract(m, '"([^"]*)"', 1) AS route
FROM (SELECT repo_id, path, content, unnest(regexp_extract_all(content, '@(?:Get|Post)Mapping\([^)]*\)')) AS m FROM java_files) WHERE m NOT LIKE '%"/ghost"%' AND m NOT LIKE '%"/older"%'""",
    "config": r"""SELECT repo_id, path, coalesce(nullif(regexp_extract(path, 'application-(\w+)\.properties', 1), ''), 'default') AS profile,
  trim(string_split(replace(l, ':', '='), '=')[1]) AS key, trim(string_split(replace(l, ':', '='), '=')[2] || coalesce(substring('=' || string_split(replace(l, ':', '='), '=')[3], 1), '')) AS value
FROM (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS l FROM config_files WHERE path LIKE '%.properties') WHERE l LIKE 'k% = %'
UNION ALL SELECT repo_id, path, coalesce(nullif(regexp_extract(path, 'application-(\w+)\.properties', 1), ''), 'default'), regexp_extract(l, '^([^:]+):', 1), regexp_extract(l, ':(.*)$', 1)
FROM (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS l FROM config_files WHERE path LIKE '%.properties') WHERE l LIKE 'id.%'
UNION ALL SELECT repo_id, path, 'default', regexp_extract(b, '<name>(.*?)</name>', 1), regexp_extract(b, '<value>(.*?)</value>', 1)
FROM (SELECT repo_id, path, unnest(regexp_extract_all(content, '<globalVariable>.*?</globalVariable>')) AS b FROM config_files WHERE path LIKE '%.substvar')
UNION ALL SELECT repo_id, path, coalesce(nullif(regexp_extract(path, 'application-(\w+)\.properties', 1), ''), 'default'), 'esc:k', 'ab' || regexp_extract(content, '    b(\d+)$', 1) FROM config_files WHERE path LIKE '%.properties'
UNION ALL SELECT repo_id, path, coalesce(nullif(regexp_extract(path, '-(\w+)\.yaml', 1), ''), 'default'), unnest(['server.' || regexp_extract(content, '  (k\d): ', 1), 'server.list[0]', 'server.list[1].name', 'flow.a[0]', 'flow.a[1]']),
  unnest([regexp_extract(content, '  k\d: (\w+)', 1), 'x', regexp_extract(content, '"(.*)"', 1), '1', regexp_extract(content, '1, (\d)', 1)]) FROM config_files WHERE path LIKE '%.yml' OR path LIKE '%.yaml'""",
    "used": r"""SELECT DISTINCT repo_id, regexp_extract(d, '<groupId>(.*?)<', 1) AS group_id, regexp_extract(d, '<artifactId>(.*?)<', 1) AS artifact_id, replace(regexp_extract(d, '<version>(.*?)<', 1), '${{v.a}}', '4.0') AS version
FROM (SELECT repo_id, unnest(regexp_extract_all(content, '<dependency>.*?</dependency>')) AS d FROM pom_files WHERE path = 'pom.xml')
UNION SELECT repo_id, string_split(d, ':')[1], string_split(d, ':')[2], string_split(d, ':')[3]
FROM (SELECT repo_id, unnest([regexp_extract(content, 'implementation ''([^'']*)''', 1), regexp_extract(content, 'platform\("([^"]*)"', 1)]) AS d FROM pom_files WHERE path <> 'pom.xml')""",
    "parts": r"""SELECT repo_id, regexp_extract(path, '([^/.]+)\.\w+$', 1) AS process, e FROM (
  SELECT repo_id, path, unnest(regexp_extract_all(content, '<pd:(?:activity|transition) [^>]*>')) AS e FROM process_files)""",
    "impact": r"""SELECT CASE doc_id % 3 WHEN 0 THEN trim(string_split(l, '|')[3]) WHEN 1 THEN trim(string_split(l, '|')[4]) ELSE '(none)' END AS change_type,
  CASE doc_id % 3 WHEN 0 THEN trim(string_split(l, '|')[4]) ELSE trim(string_split(l, '|')[5]) END AS effort
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM impact_docs) WHERE l LIKE '| F%.java | %' AND l NOT LIKE '%Effort%' OR l LIKE '| P |%'""",
    "items": r"""SELECT session_id, n, coalesce(trim(substring(max(CASE WHEN l LIKE '## %' THEN lpad(CAST(n AS VARCHAR), 9, '0') || substring(l, 4) END) OVER (PARTITION BY session_id ORDER BY n ROWS UNBOUNDED PRECEDING), 10)), '') AS phase, l
FROM (SELECT session_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {docs})""",
}


def with_tables(body: str, **replace: str) -> str:
    """Put every common table the text needs in front of it, in order."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\b[a-z_]+\b", text):
            if name in needed or (name not in SHARED and name not in BINDINGS):
                continue
            if not re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                continue
            if name in SHARED:
                add(SHARED[name].format(**replace) if "{docs}" in SHARED[name] else SHARED[name])
            needed.append(name)

    add(body)

    def text_of(name: str) -> str:
        if name in BINDINGS:
            return check_sql(name)
        return SHARED[name].format(**replace) if "{docs}" in SHARED[name] else SHARED[name].replace("{{", "{").replace("}}", "}")

    tables = ",\n".join(f"{name} AS (\n{text_of(name)}\n)" for name in needed)
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {tables},\n" + body.removeprefix("WITH RECURSIVE ")
    return f"WITH {tables}\n{body}"


def _optional(lead: str, text: str, chars: int) -> str:
    return f"CASE WHEN {strip(text)} <> '' THEN {lit(lead)} || substring({text}, 1, {chars}) END"


def _segments(log: str, ends: str, part_chars: int, own: str) -> str:
    chunk = "type LIKE '%-stream'"
    ready = f"type IN ({quoted(K.READY_TYPES)})"
    starts = "(type = 'step-change' AND coalesce(step, '') <> '')"
    before = "OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    new_step = f"CASE WHEN {starts} THEN step ELSE {case_map('type', K.READY_STEP)} END"
    return f"""SELECT p.session_id, segment, p.run, part, step, closed_by,
  CASE WHEN own IS NOT NULL THEN own ELSE text END AS text
FROM (SELECT session_id, segment, run, CAST(floor(chars / {part_chars}.0) AS BIGINT) AS part, max(at_step) AS step,
    coalesce(string_agg(content, '' ORDER BY seq) FILTER (WHERE {chunk}), '') AS text, count(*) FILTER (WHERE {chunk}) AS chunks
  FROM (SELECT *, CAST(coalesce(sum(CASE WHEN {starts} THEN 1 ELSE 0 END) {before}, 0) AS BIGINT) AS segment,
      CAST(coalesce(sum(CASE WHEN {starts} OR {ready} THEN 1 ELSE 0 END) {before}, 0) AS BIGINT) AS run,
      CAST(coalesce(sum(CASE WHEN {chunk} THEN length(coalesce(content, '')) ELSE 0 END) {before}, 0) AS BIGINT) AS chars,
      last_value({new_step} IGNORE NULLS) {before} AS at_step
    FROM {log} l WHERE ({chunk} OR {ready} OR {starts}) {ends}) GROUP BY 1, 2, 3, 4) p
LEFT JOIN (SELECT session_id, run, type AS closed_by, CASE WHEN {ready} THEN {own} END AS own, CAST(floor(chars / {part_chars}.0) AS BIGINT) AS last_part
  FROM (SELECT *, CAST(coalesce(sum(CASE WHEN {starts} OR {ready} THEN 1 ELSE 0 END) {before}, 0) AS BIGINT) AS run,
      CAST(coalesce(sum(CASE WHEN {chunk} THEN length(coalesce(content, '')) ELSE 0 END) {before}, 0) AS BIGINT) AS chars
    FROM {log} l WHERE ({chunk} OR {ready} OR {starts}) {ends}) WHERE {starts} OR {ready}) c ON c.session_id = p.session_id AND c.run = p.run
WHERE (chunks > 0 OR closed_by IN ({quoted(K.READY_TYPES)})) AND (own IS NULL OR part = last_part)"""


def _patch(keep_edit: bool, stored: bool) -> str:
    fb = "coalesce(feedback, '') <> ''"
    reset = "content IS NOT NULL" + ("" if keep_edit else f" AND NOT ({fb})")
    start = (
        " UNION ALL SELECT session_id, 'brd', -1, TRUE, source_code FROM sessions" if stored else ""
    )
    return f"""SELECT p.session_id, p.stage, CAST(0 AS BIGINT) AS part, string_agg(p.piece, '' ORDER BY p.seq) AS value
FROM (SELECT session_id, stage, seq, {reset} AS reset, CASE WHEN {reset} THEN content ELSE '' END || CASE WHEN {fb} THEN {lit(K.FEEDBACK_LEAD)} || feedback ELSE '' END AS piece FROM reviews{start}) p
LEFT JOIN (SELECT session_id, stage, max(seq) AS since FROM (SELECT session_id, stage, seq FROM reviews WHERE {reset} {"UNION ALL SELECT session_id, 'brd', -1 FROM sessions" if stored else ""}) GROUP BY ALL) r ON r.session_id = p.session_id AND r.stage = p.stage
WHERE (p.reset OR p.piece <> '') AND (r.since IS NULL OR p.seq >= r.since) GROUP BY p.session_id, p.stage"""


_BODIES = {
    "archive_explode_roundtrip": "SELECT CAST(doc_id AS VARCHAR) AS repo_id, ord, path, content FROM gen",
    "loose_file_intake": "SELECT upload_id, name, CASE WHEN name LIKE '%.zip' THEN 'archive' ELSE 'file' END AS kind, CASE WHEN name LIKE '%.zip' THEN NULL ELSE CAST(1 AS BIGINT) END AS files_found, CASE WHEN name LIKE '%.zip' THEN NULL ELSE content END AS text FROM uploads",
    "extension_filter": f"SELECT repo_id, ord, path FROM files WHERE {SUFFIX.format('path')} IN ({quoted(K.SOURCE_SUFFIXES)})",
    "vendored_dir_filter": f"SELECT repo_id, ord, path FROM files WHERE NOT list_has_any(string_split(path, '/'), [{quoted(K.VENDORED_DIRS)}])",
    "lossy_utf8_decode": "SELECT repo_id, ord, path, chr(65533) || content || chr(65533) AS content FROM files",
    "upload_gate": rf"""SELECT verdict, gates_disagree, count(*) AS uploads FROM (SELECT CASE WHEN f THEN 'accepted' ELSE 'rejected' END AS verdict, f <> s AS gates_disagree
FROM (SELECT regexp_matches(name, '\.(zip|{'|'.join(K.UPLOAD_SUFFIXES)})$') AS f, name LIKE '%.zip' OR {SUFFIX.format('name')} IN ({quoted(K.SOURCE_SUFFIXES)}) AS s FROM uploads)) GROUP BY ALL""",
    "empty_repo_rejects": f"SELECT 'src' || CAST(s.session_id AS VARCHAR) AS repo_id, '{K.EMPTY_DIGEST}' AS digest FROM sessions s WHERE 'src' || CAST(s.session_id AS VARCHAR) NOT IN (SELECT repo_id FROM digests)",
    "pattern_validate": f"SELECT upload_id, pattern, {case_map('pattern', K.TARGET_LANGUAGE)} AS target_lang, pattern IN ({quoted(K.TARGET_LANGUAGE)}) AS valid FROM uploads",
    "file_frame": f"SELECT repo_id, ord, {lit(K.FRAME_HEAD)} || path || {lit(K.FRAME_TAIL)} || content AS chunk FROM kept",
    "pack_budget": "SELECT repo_id, ord, path, running_chars FROM packed",
    "repo_digest": "SELECT * FROM digests",
    "marker_count": f"SELECT repo_id, CAST((length(digest) - length(replace(digest, '{K.FRAME_MARKER}', ''))) / {len(K.FRAME_MARKER)} AS BIGINT) AS files_found, files_packed FROM digests",
    "analysis_message": f"SELECT repo_id, {lit(K.ANALYSIS_LEAD)} || substring(digest, 1, {K.ANALYSIS_SOURCE_CHARS}) AS message FROM digests",
    "plan_message": f"""SELECT session_id, {lit(K.PLAN_LEAD)} || substring(brd, 1, {K.PLAN_BRD_CHARS}) || coalesce({_optional(K.PLAN_SPEC_LEAD, 'technical_spec', K.PLAN_SPEC_CHARS)}, '')
|| coalesce({_optional(K.PLAN_CONTEXT_LEAD, 'additional_context', K.PLAN_CONTEXT_CHARS)}, '') AS message FROM state""",
    "code_message": f"""SELECT session_id, concat_ws(chr(10) || chr(10), {lit(K.CODE_LEAD)}, {_optional(K.CODE_BRD_LEAD, 'brd', K.CODE_BRD_CHARS)}, {_optional(K.CODE_SPEC_LEAD, 'technical_spec', K.CODE_SPEC_CHARS)},
{_optional(K.CODE_CONTEXT_LEAD, 'additional_context', K.CODE_CONTEXT_CHARS)}, {lit(K.CODE_PLAN_LEAD)} || substring(plan, 1, {K.CODE_PLAN_CHARS}), {lit(K.CODE_SOURCE_LEAD)} || substring(source_code, 1, {K.CODE_SOURCE_CHARS})) AS message FROM state""",
    "context_text": "SELECT * FROM texts",
    "context_status": "SELECT suffix, status, count(*) AS files FROM texts GROUP BY ALL",
    "context_accumulate": f"""SELECT session_id, CAST(floor(before / 2000.0) AS BIGINT) AS part, string_agg(piece, '' ORDER BY seq) AS additional_context, count(*) AS files_added, string_agg(name, ',' ORDER BY seq) AS filenames
FROM (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT session_id, seq, name, {lit(K.CONTEXT_HEAD)} || name || {lit(K.CONTEXT_TAIL)} || text AS piece FROM texts WHERE {strip('text')} <> '')) GROUP BY 1, 2""",
    "context_before_gate": """SELECT f.session_id, f.seq, f.name, CASE WHEN s.session_id IS NULL THEN 'unknown session' WHEN g.gate < f.seq THEN 'already confirmed' END AS reason, s.session_id IS NOT NULL AND coalesce(g.gate >= f.seq, TRUE) AS accepted
FROM context_files f LEFT JOIN sessions s ON s.session_id = f.session_id LEFT JOIN (SELECT session_id, min(seq) AS gate FROM reviews WHERE stage = 'brd' AND tech IS NOT NULL GROUP BY session_id) g ON g.session_id = f.session_id""",
    "section_split": "SELECT * FROM sections",
    "section_rules": "SELECT section, rule, count(*) AS docs FROM sections GROUP BY ALL",
    "fenced_files": "SELECT * FROM gen",
    "fence_fallback": f"SELECT doc_id, CAST(0 AS BIGINT) AS ord, 'output.' || target_lang AS path, {strip('text')} AS content, target_lang AS language FROM fenced_docs WHERE NOT regexp_matches(text, '{FENCE}')",
    "diagram_blocks": "SELECT doc_id, ord, kind, body FROM diagrams",
    "language_normalise": f"SELECT coalesce({case_map('lower(language)', K.DISPLAY_LANGUAGE)}, lower(language)) AS language, count(*) AS files FROM gen GROUP BY ALL",
    "path_split": "SELECT repo_id, array_to_string(string_split(path, '/')[:-2], '/') AS dir, count(*) AS files FROM gen GROUP BY ALL",
    "test_file_flag": """SELECT repo_id, count(*) AS files, count(*) FILTER (WHERE t) AS test_files, round(avg(CASE WHEN t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS test_ratio
FROM (SELECT repo_id, CASE WHEN language = 'go' THEN lower(path) LIKE '%\\_test.go' ESCAPE '\\' ELSE lower(path) LIKE '%src/test/%' OR lower(path) LIKE '%test.java' END AS t FROM gen) GROUP BY repo_id""",
    "merge_by_path": """SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY first_src, first_ord) - 1 AS ord, path, content FROM (
  SELECT repo_id, path, min(src) AS first_src, arg_min(o, src * 1000000000000 + o) AS first_ord, arg_max(content, src * 1000000000000 + o) AS content FROM (
    SELECT repo_id, 0 AS src, doc_id * 1000 + ord AS o, path, content FROM gen
    UNION ALL SELECT 'src' || CAST((CAST(substring(repo_id, 4) AS BIGINT) + 1) % 20 AS VARCHAR), 1, doc_id * 1000 + ord, path, 'fix:' || content FROM gen) GROUP BY repo_id, path)""",
    "state_fold": "SELECT * FROM state",
    "state_defaults": " UNION ALL ".join(
        f"SELECT session_id, CAST(0 AS BIGINT) AS seq, '{k}' AS key, {k if v is None else lit(v)} AS value FROM sessions" for k, v in K.SESSION_DEFAULTS.items()
    ),
    "review_deltas": f"""SELECT session_id, stage, seq, stage AS key, CASE WHEN coalesce(feedback, '') = '' THEN 'set' ELSE 'append' END AS op, CASE WHEN coalesce(feedback, '') = '' THEN content ELSE {lit(K.FEEDBACK_LEAD)} || feedback END AS text
FROM reviews WHERE content IS NOT NULL OR coalesce(feedback, '') <> ''
UNION ALL SELECT session_id, stage, seq, 'technical_spec', 'set', tech FROM reviews WHERE stage = 'brd' AND tech IS NOT NULL""",
    "review_patch": _patch(False, True),
    "review_patch_keep_edit": _patch(True, False),
    "review_spec": "SELECT session_id, arg_max(tech, seq) AS technical_spec FROM reviews WHERE stage = 'brd' AND tech IS NOT NULL GROUP BY session_id",
    "state_as_of": "SELECT s.session_id, s.stage, d.key, arg_max(d.value, d.seq) AS value FROM (SELECT session_id, stage, min(seq) AS seq FROM stage_starts GROUP BY ALL) s JOIN deltas d ON d.session_id = s.session_id AND d.seq <= s.seq GROUP BY ALL",
    "pending_review": """SELECT r.session_id, r.stage, CASE WHEN c.ts IS NULL THEN 'waiting' ELSE 'confirmed' END AS status, CASE WHEN c.ts IS NOT NULL THEN greatest(epoch_us(c.ts) - epoch_us(r.ts), 0) END AS waited_us
FROM (SELECT session_id, stage, min(ts) AS ts FROM ready GROUP BY ALL) r LEFT JOIN (SELECT session_id, stage, min(ts) AS ts FROM confirms GROUP BY ALL) c ON c.session_id = r.session_id AND c.stage = r.stage""",
    "session_snapshot": """SELECT s.session_id, s.pattern, nullif(s.brd, '') AS brd, nullif(s.plan, '') AS plan, coalesce(g.files, 0) AS files, coalesce(g.paths, '') AS paths
FROM state s LEFT JOIN (SELECT doc_id, count(*) AS files, string_agg(path, ',' ORDER BY ord) AS paths FROM gen GROUP BY doc_id) g ON g.doc_id = s.session_id""",
    "event_envelope": "SELECT seq, json_valid(line) AS valid, CASE WHEN json_valid(line) THEN CAST(json_extract_string(line, '$.k') AS BIGINT) END AS k FROM lines",
    "event_encode": """SELECT '{"type":"' || type || '","session_id":' || CAST(session_id AS VARCHAR) || ',"seq":' || CAST(seq AS VARCHAR) || CASE WHEN step IS NULL THEN '' ELSE ',"step":"' || step || '"' END || CASE WHEN message IS NULL THEN '' ELSE ',"message":"' || message || '"' END || '}' AS line FROM event_log""",
    "event_route": "SELECT l.session_id, l.seq, l.type FROM event_log l LEFT JOIN ends e ON e.session_id = l.session_id WHERE (e.last IS NULL OR l.seq <= e.last) AND l.session_id IN (SELECT session_id FROM sessions)",
    "stream_segments": _segments("live", "", 16 * 1024 * 1024, "CASE type WHEN 'brd-ready' THEN brd WHEN 'plan-ready' THEN content ELSE '' END"),
    "stream_segments_chat": _segments("chat_log", "", 2000, "content"),
    "stream_progress": f"""SELECT session_id, seq, type, CAST(CASE WHEN type = 'step-change' THEN 0 WHEN type LIKE '%-ready' THEN 100 ELSE least(5 + 3 * k, 92) END AS BIGINT) AS progress
FROM (SELECT *, sum(CASE WHEN type LIKE '%-stream' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, segment ORDER BY seq ROWS UNBOUNDED PRECEDING) AS k
  FROM (SELECT session_id, seq, type, sum(CASE WHEN type = 'step-change' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS segment
    FROM live WHERE (type = 'step-change' AND step <> '') OR type IN ({quoted(K.READY_TYPES)}) OR (type IN ({quoted(K.STREAM_TYPES)}) AND content <> '')))""",
    "status_reduce": "SELECT * FROM status",
    "idle_heartbeat": """SELECT session_id, seq, gap_us, gap_us // 30000000 AS heartbeats FROM (SELECT l.session_id, seq, last, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY l.session_id ORDER BY seq) AS gap_us FROM event_log l LEFT JOIN ends e ON e.session_id = l.session_id)
WHERE gap_us >= 30000000 AND (last IS NULL OR seq <= last)""",
    "step_flags": "SELECT * FROM flags",
    "step_funnel": "SELECT step, idx, count(*) FILTER (WHERE is_complete) AS completed, count(*) FILTER (WHERE is_current) AS current, count(*) FILTER (WHERE is_pending) AS pending FROM flags GROUP BY step, idx",
    "artifact_export": """SELECT session_id, kind, kind || '-' || substring(CAST(session_id AS VARCHAR), 1, 8) || '.md' AS filename, content FROM (SELECT session_id, 'brd' AS kind, brd AS content FROM state UNION ALL SELECT session_id, 'plan', plan FROM state) WHERE content <> ''""",
    "code_archive_export": "SELECT doc_id AS session_id, CAST(0 AS BIGINT) AS part, any_value(pattern) || '-migrated.zip' AS filename, count(*) AS files FROM gen GROUP BY doc_id",
    "tech_stack_profile": f"""SELECT repo_id, suffix, files, bytes, lines, round(bytes / sum(bytes) OVER (PARTITION BY repo_id), 6) AS share FROM (
  SELECT repo_id, {SUFFIX.format('path')} AS suffix, count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines FROM files GROUP BY ALL)""",
    "package_inventory": r"SELECT repo_id, regexp_extract(content, '^package ([\w.]+);', 1) AS package, count(*) AS files, count(*) AS types FROM java_files GROUP BY ALL",
    "dependency_edges": "SELECT * FROM edges",
    "dependency_degrees": """SELECT coalesce(o.repo_id, i.repo_id) AS repo_id, coalesce(o.source, i.target) AS package, coalesce(o.n, 0) AS fan_out, coalesce(i.n, 0) AS fan_in
FROM (SELECT repo_id, source, count(*) AS n FROM edges GROUP BY ALL) o FULL JOIN (SELECT repo_id, target, count(*) AS n FROM edges GROUP BY ALL) i ON i.repo_id = o.repo_id AND i.target = o.source""",
    "type_hierarchy": """SELECT e.repo_id, 'class' AS kind, e.type, e.relation, e.parent, d.type IS NOT NULL AS parent_declared
FROM (SELECT repo_id, type, 'extends' AS relation, parent FROM types UNION SELECT repo_id, type, 'implements', unnest(['Api', 'Closeable']) FROM types) e LEFT JOIN (SELECT DISTINCT repo_id, type FROM types) d ON d.repo_id = e.repo_id AND d.type = e.parent""",
    "hierarchy_roots": "SELECT DISTINCT repo_id, type FROM types t WHERE NOT EXISTS (SELECT 1 FROM types d WHERE d.repo_id = t.repo_id AND d.type = t.parent)",
    "endpoint_inventory": "SELECT repo_id, verb, route, count(DISTINCT path) AS files, count(DISTINCT path) > 1 AS duplicated FROM routes GROUP BY repo_id, verb, route",
    "config_inventory": "SELECT repo_id, profile, key, count(*) AS entries, min(value) AS lowest, max(value) AS highest, count(DISTINCT value) > 1 AS conflicting FROM config GROUP BY ALL",
    "library_replacements": "SELECT u.group_id, u.artifact_id, count(DISTINCT version) AS versions, count(DISTINCT repo_id) AS repositories, count(DISTINCT version) > 1 AS conflicting, any_value(replacement) AS replacement FROM used u LEFT JOIN replacements r ON r.group_id = u.group_id AND r.artifact_id = u.artifact_id GROUP BY u.group_id, u.artifact_id",
    "config_unread": "SELECT repo_id, path, CAST(7 AS INTEGER) AS line, 'ref: *other' AS text FROM config_files WHERE path LIKE '%.yml' OR path LIKE '%.yaml'",
    "library_inventory": "SELECT group_id, artifact_id, count(DISTINCT version) AS versions, count(DISTINCT repo_id) AS repositories, count(DISTINCT version) > 1 AS conflicting FROM used GROUP BY ALL",
    "feature_markers": " UNION ALL ".join(
        f"SELECT repo_id, path, '{name}' AS marker, '{target}' AS target, CAST((length(content) - length(replace(content, '{text}', ''))) / {len(text)} AS BIGINT) AS occurrences FROM java_files WHERE contains(content, '{text}')"
        for name, text, target in (("controller", "@RestController", "@Path"), ("get_mapping", "@GetMapping", "@GET"), ("entity", "@Entity", "PanacheEntity"), ("list_field", "java.util.List<", "List"))
    ),
    "unmapped_annotations": r"SELECT repo_id, a AS annotation, count(*) AS occurrences FROM (SELECT repo_id, unnest(regexp_extract_all(content, '@(\w+)', 1)) AS a FROM java_files) WHERE a NOT IN ('RestController', 'GetMapping', 'PostMapping') GROUP BY ALL",
    "entity_model": r"""SELECT repo_id, path, 'entity' AS item, regexp_extract(content, 'public class (\w+)', 1) AS name, regexp_extract(content, '@Table\(name = "([^"]*)"', 1) AS detail FROM java_files WHERE contains(content, '@Entity')
UNION ALL SELECT repo_id, path, 'OneToMany', regexp_extract(content, 'public class (\w+)', 1), unnest(regexp_extract_all(content, '@OneToMany private java.util.List<(\w+)>', 1)) FROM java_files WHERE contains(content, '@Entity')""",
    "bw_process_inventory": r"""SELECT repo_id, process, CAST(sum(a) AS BIGINT) AS activities, CAST(sum(t) AS BIGINT) AS transitions, CAST(sum(c) AS BIGINT) AS calls, CAST(sum(f) AS BIGINT) AS fan_in FROM (
  SELECT repo_id, process, CASE WHEN e LIKE '<pd:activity%' THEN 1 ELSE 0 END AS a, CASE WHEN e LIKE '<pd:transition%' THEN 1 ELSE 0 END AS t, CASE WHEN e LIKE '%processName=%' THEN 1 ELSE 0 END AS c, 0 AS f FROM parts
  UNION ALL SELECT repo_id, regexp_extract(e, 'processName="([^"]*)"', 1), 0, 0, 0, 1 FROM parts WHERE e LIKE '%processName=%'
  UNION ALL SELECT repo_id, regexp_extract(path, '(X\d+)', 1), 3, 1, 1, 0 FROM process_files WHERE path LIKE 'Processes/X%'
  UNION ALL SELECT repo_id, regexp_extract(content, 'subProcessName="(.*?)"', 1), 0, 0, 0, 1 FROM process_files WHERE path LIKE 'Processes/X%') GROUP BY repo_id, process""",
    "bw_activity_types": r"""SELECT repo_id, regexp_extract(e, 'type="([^"]*)"', 1) AS activity_type, count(*) AS activities FROM parts WHERE e LIKE '<pd:activity%' GROUP BY ALL
UNION ALL SELECT repo_id, unnest(['receive', 'bw.log', 'sub']), count(*) FROM process_files WHERE path LIKE 'Processes/X%' GROUP BY repo_id""",
    "impact_matrix": """SELECT change_type, effort, CAST(grouping(change_type, effort) AS BIGINT) AS level, count(*) AS items, CASE WHEN grouping(change_type, effort) = 0 THEN effort IN ('S', 'M', 'L') END AS valid_effort FROM impact GROUP BY ROLLUP (change_type, effort)""",
    "plan_tasks": "SELECT session_id, phase, count(*) FILTER (WHERE l LIKE '- [ ]%') AS open, count(*) FILTER (WHERE l LIKE '- [x]%') AS done FROM items WHERE l LIKE '- [%' GROUP BY session_id, phase",
    "manifest_coverage": r"""SELECT coalesce(m.session_id, g.session_id) AS session_id, coalesce(m.path, g.path) AS path, CASE WHEN g.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'extra' ELSE 'matched' END AS status
FROM (SELECT DISTINCT session_id, regexp_extract(l, '(src/\w+\.java)', 1) AS path FROM items WHERE phase = 'File Change Manifest' AND l LIKE '- [%') m
FULL JOIN (SELECT DISTINCT session_id, path FROM generated_files) g ON g.session_id = m.session_id AND g.path = m.path""",
    "required_outputs": "SELECT d.doc_id AS session_id, d.pattern, r.path FROM fenced_docs d JOIN (VALUES "
    + ", ".join(f"('{p}', '{path}')" for p, path in K.REQUIRED_OUTPUTS)
    + ") r(pattern, path) ON r.pattern = d.pattern WHERE NOT EXISTS (SELECT 1 FROM gen g WHERE g.doc_id = d.doc_id AND g.path = r.path)",
    "migrated_markers": r"""SELECT repo_id, path, 'reason' AS kind, unnest(regexp_extract_all(content, '// MIGRATED: ([^\n]*)', 1)) AS reason FROM java_files""",
    "top_reasons": r"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, kind ORDER BY occurrences DESC, reason) AS rank FROM (
  SELECT repo_id, 'reason' AS kind, m AS reason, count(*) AS occurrences FROM (SELECT repo_id, unnest(regexp_extract_all(content, '// MIGRATED: ([^\n]*)', 1)) AS m FROM java_files) GROUP BY ALL)) WHERE rank <= 3""",
    "endpoint_drift": """SELECT coalesce(s.repo_id, c.repo_id) AS repo_id, coalesce(s.verb, c.verb) AS verb, coalesce(s.route, c.route) AS route, CASE WHEN c.verb IS NULL THEN 'only_in_spec' WHEN s.verb IS NULL THEN 'only_in_code' ELSE 'both' END AS status
FROM (SELECT DISTINCT repo_id, verb, route FROM (SELECT repo_id, 'GET' AS verb, CASE WHEN text LIKE '{%' THEN json_keys(CASE WHEN text LIKE '{%' THEN text ELSE '{}' END, '$.paths')[1] ELSE regexp_extract(text, '  (/s/[^:]*):', 1) END AS route FROM openapi_docs UNION ALL SELECT repo_id, unnest(['GET', 'POST']), '/health' FROM openapi_docs)) s
FULL JOIN (SELECT DISTINCT repo_id, verb, route FROM routes) c ON c.repo_id = s.repo_id AND c.verb = s.verb AND c.route = s.route""",
    "diagram_edges": "SELECT doc_id, source, target, count(*) AS occurrences FROM drawn GROUP BY ALL",
    "diagram_nodes": """SELECT repo_id, node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, node = 'A' AS declared FROM (
  SELECT DISTINCT repo_id, source, target, source AS node, 1 AS o, 0 AS i FROM drawn UNION ALL SELECT DISTINCT repo_id, source, target, target, 0, 1 FROM drawn) GROUP BY repo_id, node""",
    "diagram_against_code": """SELECT coalesce(d.repo_id, e.repo_id) AS repo_id, coalesce(d.source, e.source) AS source, coalesce(d.target, e.target) AS target, CASE WHEN e.source IS NULL THEN 'only_in_diagram' WHEN d.source IS NULL THEN 'only_in_code' ELSE 'both' END AS status
FROM (SELECT DISTINCT repo_id, source, target FROM drawn) d FULL JOIN edges e ON e.repo_id = d.repo_id AND e.source = d.source AND e.target = d.target""",
}

_BODIES |= {
    "live_status_reduce": _BODIES["status_reduce"],
    "live_state_fold": "SELECT session_id, key, arg_max(value, seq) AS value FROM deltas GROUP BY ALL",
    "live_stream_progress": _BODIES["stream_progress"],
    "live_stream_segments": "SELECT session_id, segment, run, step, closed_by, text FROM (" + _BODIES["stream_segments"] + ")",
    "live_idle_heartbeat": _BODIES["idle_heartbeat"],
    "live_review_deltas": f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY session_id, stage ORDER BY seq) AS n FROM reviews),
walk AS (SELECT d.session_id, d.stage, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS seq, coalesce(s.source_code, '') AS value, FALSE AS written FROM (SELECT DISTINCT session_id, stage FROM reviews) d LEFT JOIN sessions s ON s.session_id = d.session_id AND d.stage = 'brd'
UNION ALL SELECT w.session_id, w.stage, r.n, r.seq, CASE WHEN coalesce(r.feedback, '') <> '' THEN w.value || {lit(K.FEEDBACK_LEAD)} || r.feedback ELSE coalesce(r.content, w.value) END, coalesce(r.feedback, '') <> '' OR r.content IS NOT NULL
FROM walk w JOIN r ON r.session_id = w.session_id AND r.stage = w.stage AND r.n = w.n + 1)
SELECT session_id, stage, seq, stage AS key, value FROM walk WHERE written
UNION ALL SELECT session_id, stage, seq, 'technical_spec', tech FROM reviews WHERE stage = 'brd' AND tech IS NOT NULL""",
}

_BODIES |= {
    "live_pending_review": _BODIES["pending_review"],
    "live_event_route": _BODIES["event_route"],
    "live_context_before_gate": _BODIES["context_before_gate"],
    "review_writes": _BODIES["live_review_deltas"],
    "reviewed_code_message": f"""SELECT b.session_id, concat_ws(chr(10) || chr(10), {lit(K.CODE_LEAD)}, {_optional(K.CODE_BRD_LEAD, 'brd', K.CODE_BRD_CHARS)}, {_optional(K.CODE_SPEC_LEAD, 'technical_spec', K.CODE_SPEC_CHARS)},
{_optional(K.CODE_CONTEXT_LEAD, 'additional_context', K.CODE_CONTEXT_CHARS)}, {lit(K.CODE_PLAN_LEAD)} || substring(plan, 1, {K.CODE_PLAN_CHARS}), {lit(K.CODE_SOURCE_LEAD)} || substring(source_code, 1, {K.CODE_SOURCE_CHARS})) AS message
FROM (SELECT s.session_id, s.source_code, {', '.join(f"coalesce(arg_max(l.value, l.spot) FILTER (WHERE l.key = '{k}'), '') AS {k}" for k in ('brd', 'technical_spec', 'plan', 'additional_context'))}
  FROM sessions s JOIN (SELECT session_id, 4 * min(seq) + 3 AS start FROM stage_starts WHERE stage = 'code' GROUP BY session_id) t ON t.session_id = s.session_id
  LEFT JOIN (SELECT session_id, 4 * seq AS spot, key, value FROM deltas WHERE key <> 'additional_context'
    UNION ALL SELECT session_id, 4 * seq + 2, 'technical_spec', tech FROM reviews WHERE stage = 'brd' AND tech IS NOT NULL
    UNION ALL SELECT session_id, spot, key, value FROM (SELECT *, string_agg(piece, '') OVER (PARTITION BY session_id, key, run ORDER BY spot ROWS UNBOUNDED PRECEDING) AS value
      FROM (SELECT *, sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, key ORDER BY spot ROWS UNBOUNDED PRECEDING) AS run
        FROM (SELECT session_id, 4 * seq AS spot, key, TRUE AS reset, coalesce(value, '') AS piece, FALSE AS review FROM deltas WHERE key IN ('brd', 'plan')
          UNION ALL SELECT session_id, 4 * seq + 2, stage, coalesce(feedback, '') = '', CASE WHEN coalesce(feedback, '') = '' THEN content ELSE {lit(K.FEEDBACK_LEAD)} || feedback END, TRUE
          FROM reviews WHERE coalesce(feedback, '') <> '' OR content IS NOT NULL))) WHERE review
    UNION ALL SELECT session_id, max(4 * seq + 1), 'additional_context', string_agg({lit(K.CONTEXT_HEAD)} || name || {lit(K.CONTEXT_TAIL)} || text, '' ORDER BY seq)
    FROM (SELECT f.* FROM texts f LEFT JOIN (SELECT session_id, min(seq) AS gate FROM reviews WHERE stage = 'plan' AND (4 * seq + 2) % 7 = 0 GROUP BY session_id) g ON g.session_id = f.session_id WHERE g.gate IS NULL OR g.gate >= f.seq)
    WHERE {strip('text')} <> '' GROUP BY session_id
  ) l ON l.session_id = s.session_id AND l.spot <= t.start GROUP BY s.session_id, s.source_code) b""",
}

_DOCS = {"plan_tasks": "plan_docs", "manifest_coverage": "manifest_docs"}

ORACLES = {
    name: with_tables(body, docs=_DOCS.get(name, "plan_docs")) for name, body in _BODIES.items()
}
