"""Canonical inputs derived from the given tables.

Each binding is one SQL text used on Spark and, unchanged but for two tokens,
on the checking database: ``$table`` is the parquet table and
``$join(text; order)`` concatenates lines in order. Lines are only gathered in
groups whose size is fixed by the text itself (blocks of 64 parts, for instance).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from codexfold.constants import SECTION_MARKER
from codexfold.streaming.sources import read_table_stream

ID = "CAST({} AS VARCHAR(20))"


def _id(expression: str) -> str:
    return ID.format(expression)


def _marker(word: str) -> str:
    return "'" + SECTION_MARKER.format(word) + "'"


NL, FENCE3 = "chr(10)", "'```'"

FILES = f"""
SELECT 'src' || {_id('doc_id % 4')} AS repo_id, doc_id AS ord,
  CASE CAST(floor(doc_id / 20.0) AS BIGINT) % 7 WHEN 0 THEN 'src/main/java/' WHEN 1 THEN 'src/test/java/' WHEN 2 THEN 'target/' WHEN 3 THEN 'lib/build/' WHEN 4 THEN '' WHEN 5 THEN 'docs/' ELSE '.git/' END
  || 'F' || {_id('doc_id')} ||
  CASE CAST(floor(doc_id / 20.0) AS BIGINT) % 5 WHEN 0 THEN '.java' WHEN 1 THEN '.XML' WHEN 2 THEN '.txt' WHEN 3 THEN '.go' ELSE '' END AS path,
  text AS content, n_chars
FROM $documents"""

SECTION_DOCS = f"""
SELECT doc_id, CASE CAST(floor(doc_id / 20.0) AS BIGINT) % 6
  WHEN 0 THEN 'pre' || {_marker('ANALYSIS')} || ' a ' || {_marker('BRD')} || ' b ' || {_marker('TECHNICAL_SPECIFICATION')} || text || {_marker('END')} || 'post'
  WHEN 1 THEN {_marker('analysis')} || text || {_marker('brd')} || 'b' || {_marker('technical_specification')} || 't'
  WHEN 2 THEN 'x' || {_marker('BRD')} || text || {_marker('END')}
  WHEN 3 THEN text
  WHEN 4 THEN {_marker('TECHNICAL_SPECIFICATION')} || 't' || {_marker('BRD')} || text || {_marker('ANALYSIS')}
  ELSE {_marker('ANALYSIS')} || 'a' || {_marker('BRD')} || ' ' || {_marker('TECHNICAL_SPECIFICATION')} || text END AS text
FROM $documents"""

FENCED_DOCS = f"""
SELECT doc_id, source AS repo_id,
  CASE doc_id % 4 WHEN 0 THEN 'java17-to-java25' WHEN 1 THEN 'java-to-go' WHEN 2 THEN 'java-to-quarkus' ELSE 'tibco-to-springboot' END AS pattern,
  CASE doc_id % 4 WHEN 1 THEN 'go' ELSE 'java' END AS target_lang,
  CASE CAST(floor(doc_id / 20.0) AS BIGINT) % 6
  WHEN 0 THEN text
  WHEN 1 THEN {FENCE3} || 'java:src/A' || {_id('doc_id')} || '.java' || {NL} || text || {NL} || {FENCE3}
  WHEN 2 THEN 'i' || {NL} || {FENCE3} || {NL} || text || {NL} || {FENCE3}
  WHEN 3 THEN {FENCE3} || 'c++' || {NL} || 'A' || {NL} || {FENCE3} || {NL} || 'mid' || {NL} || {FENCE3} || 'java:x/Y.java' || {NL} || text || {NL} || {FENCE3}
  WHEN 4 THEN {FENCE3} || 'go:go.mod' || {NL} || 'module m' || {NL} || {FENCE3} || {NL} || {FENCE3} || 'go:a_test.go' || {NL} || text || {NL} || {FENCE3}
  ELSE {FENCE3} || 'mermaid' || {NL} || 'graph LR' || {NL} || '  A[a] --> B' || {NL} || '  B --> N' || {_id('doc_id % 9')} || {NL} || {FENCE3} || {NL} || {FENCE3} || 'XML:pom.xml' || {NL} || text || {NL} || {FENCE3} END AS text
FROM $documents"""

SESSIONS = f"""
SELECT c_custkey + 3 AS session_id,
  CASE c_nationkey % 4 WHEN 0 THEN 'java17-to-java25' WHEN 1 THEN 'java-to-go' WHEN 2 THEN 'java-to-quarkus' ELSE 'tibco-to-springboot' END AS pattern,
  c_name AS source_code
FROM $customer"""

DELTAS = """
SELECT user_id AS session_id, event_id AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'brd' WHEN 'view' THEN 'technical_spec' WHEN 'click' THEN 'additional_context' WHEN 'purchase' THEN 'plan' ELSE 'generated_code_raw' END AS key,
  props AS value
FROM $events"""

STAGE_STARTS = """
SELECT user_id AS session_id, event_id AS seq, CASE WHEN event_type IN ('signup', 'view') THEN 'plan' ELSE 'code' END AS stage
FROM $events"""

REVIEWS = f"""
SELECT user_id AS session_id, event_id AS seq, ts,
  CASE WHEN event_type IN ('purchase', 'view') THEN 'plan' ELSE 'brd' END AS stage,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'edit ' || {_id('event_id')} END AS content,
  CASE WHEN event_id % 4 = 0 THEN 'spec ' || {_id('event_id')} END AS tech,
  CASE event_id % 5 WHEN 0 THEN 'fb ' || {_id('event_id')} WHEN 1 THEN '' WHEN 2 THEN 'more ' || {_id('event_id')} END AS feedback
FROM $events"""

EVENT_LOG = f"""
SELECT user_id AS session_id, event_id AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'step-change' WHEN 'view' THEN 'code-stream' WHEN 'click' THEN 'plan-stream' WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'brd-ready' WHEN 1 THEN 'plan-ready' ELSE 'code-ready' END
    ELSE CASE event_id % 50 WHEN 0 THEN 'error' WHEN 1 THEN 'workflow-complete' ELSE 'step-start' END END AS type,
  CASE WHEN event_type = 'signup' THEN CASE event_id % 5 WHEN 0 THEN 'reverse-engineering' WHEN 1 THEN 'plan-generation' WHEN 2 THEN 'code-generation' WHEN 3 THEN 'brd-generation' ELSE '' END END AS step,
  CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE props END AS content,
  CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'brd ' || {_id('event_id')} END AS brd,
  CASE WHEN event_type = 'error' AND event_id % 100 = 0 THEN 'm' || {_id('event_id')} END AS message
FROM $events"""

CHAT_LOG = """
SELECT conv_id AS session_id, turn AS seq,
  CASE WHEN turn % 4 = 0 THEN 'step-change' WHEN role = 'user' AND turn % 6 = 2 THEN 'plan-ready' ELSE 're-stream' END AS type,
  CASE WHEN turn % 4 = 0 THEN 'plan-generation' END AS step,
  CASE WHEN role = 'user' AND turn % 6 = 2 THEN NULL ELSE text END AS content
FROM $conversations"""

LINES = """
SELECT event_id AS seq, CASE WHEN event_id % 9 = 0 THEN substring(props, 1, length(props) - 1) ELSE props END AS line
FROM $events"""

UPLOADS = f"""
SELECT page_id AS upload_id,
  'u' || {_id('page_id')} || CASE page_id % 8 WHEN 0 THEN '.zip' WHEN 1 THEN '.ZIP' WHEN 2 THEN '.java' WHEN 3 THEN '.kts' WHEN 4 THEN '.json' WHEN 5 THEN '.md' WHEN 6 THEN '.XML' ELSE '.yaml' END AS name,
  CASE page_id % 5 WHEN 0 THEN 'java17-to-java25' WHEN 1 THEN 'java-to-go' WHEN 2 THEN 'java-to-quarkus' WHEN 3 THEN 'tibco-to-springboot' ELSE 'cobol-to-java' END AS pattern,
  html AS content
FROM $pages"""

CONTEXT_FILES = f"""
SELECT user_id AS session_id, event_id AS seq, ts,
  'c' || {_id('event_id')} || CASE event_type WHEN 'signup' THEN '.json' WHEN 'view' THEN '.txt' WHEN 'click' THEN '.PDF' WHEN 'purchase' THEN '.md' ELSE '.JSON' END AS name,
  CASE event_type WHEN 'view' THEN props || ' ' || chr(233) WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN ' ' || chr(10) ELSE props END
    WHEN 'error' THEN substring(props, 1, length(props) - 1) ELSE props END AS content
FROM $events"""

JAVA_FILES = f"""
SELECT 'r' || {_id('v.s_nationkey % 5')} AS repo_id, t.s * 100000 + t.c AS ord,
  CASE t.s % 3 WHEN 0 THEN 'src/test/java/' ELSE 'src/main/java/' END || 'S' || {_id('t.s')} || '_' || {_id('t.c')} || '.java' AS path,
  'package com.n' || {_id('v.s_nationkey')} || ';' || chr(10) || t.imports || chr(10) ||
  '/* class Ghost extends Nothing {{' || chr(10) || ' @GetMapping("/ghost") }} */' || chr(10) || '// @PostMapping("/older")' || chr(10) ||
  '@RestController' || chr(10) || '@RequestMapping("/s/' || {_id('t.s % 40')} || '")' || chr(10) ||
  CASE WHEN t.s % 2 = 0 THEN '@Entity' || chr(10) || '@Table(name = "t' || {_id('t.s')} || '")' || chr(10) ELSE '' END ||
  'public class S' || {_id('t.s')} || '_' || {_id('t.c')} || ' extends ' ||
  CASE WHEN t.c % 3 = 1 THEN 'S' || {_id('t.s')} || '_' || {_id('t.c - 1')} ELSE 'Base' || {_id('t.s % 7')} || CASE WHEN t.s % 2 = 0 THEN '<Map<String, List<X>>, Y>' ELSE '' END END ||
  ' implements Api, Closeable {{' || chr(10) || t.body || chr(10) || '}}' AS content
FROM (
  SELECT s, c, $join(import_line; n) AS imports, $join(body_line; n) AS body FROM (
    SELECT l.s, CAST(floor(l.n / 64.0) AS BIGINT) AS c, l.n,
      'import com.n' || {_id('l.n % 25')} || '.P' || {_id('l.n')} || ';' AS import_line,
      CASE p.p_size % 4 WHEN 0 THEN '  @GetMapping("/p/' || {_id('l.n % 64')} || '") public String g' || {_id('l.n')} || '() {{ return ""; }}'
        WHEN 1 THEN '  @PostMapping(value = "/p/' || {_id('l.n % 64')} || '") public void h' || {_id('l.n')} || '() {{}}'
        WHEN 2 THEN '  @OneToMany private java.util.List<P' || {_id('l.n')} || '> r' || {_id('l.n')} || ';'
        ELSE '  // MIGRATED: ' || p.p_type END AS body_line
    FROM (SELECT DISTINCT l_suppkey AS s, l_partkey AS n FROM $lineitem) l JOIN $part p ON p.p_partkey = l.n
  ) x GROUP BY s, c
) t JOIN $supplier v ON v.s_suppkey = t.s"""

CONFIG_FILES = f"""
SELECT 'n' || {_id('c_nationkey')} AS repo_id,
  CASE WHEN c_custkey % 3 = 2 THEN 'defaultVars/c' || {_id('c_custkey')} || '.substvar' ELSE 'conf/application' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '-' || lower(c_mktsegment) END || '.properties' END AS path,
  CASE WHEN c_custkey % 3 = 2 THEN '<repository><globalVariables><globalVariable><name>k' || {_id('c_custkey % 10')} || '</name><value>' || c_mktsegment || '</value></globalVariable><globalVariable><name>only' || {_id('c_custkey')} || '</name><value></value></globalVariable></globalVariables></repository>'
  ELSE '# ' || c_name || chr(10) || 'k' || {_id('c_custkey % 10')} || ' = ' || c_mktsegment || chr(10) || chr(10) || 'id.' || {_id('c_custkey')} || ':a=b' || chr(10) || 'esc' || chr(92) || ':k = a' || chr(92) || chr(10) || '    b' || {_id('c_custkey')} END AS content
FROM $customer
UNION ALL
SELECT 'y' || {_id('c_nationkey')}, 'conf/app' || {_id('c_custkey')} || CASE WHEN c_custkey % 2 = 0 THEN '.yml' ELSE '-' || lower(c_mktsegment) || '.yaml' END,
  'server: # main' || chr(10) || '  k' || {_id('c_custkey % 10')} || ': ' || c_mktsegment || chr(10) || '  list:' || chr(10) || '  - x' || chr(10) || '  - name: "n' || {_id('c_custkey')} || '"' || chr(10) || 'flow: {{a: [1, ' || {_id('c_custkey % 3')} || ']}}'
FROM $customer"""

POM_FILES = f"""
SELECT 'p' || {_id('c')} AS repo_id, 'pom.xml' AS path,
  '<project><properties><v.a>4$' || '{{v.b}}</v.a><v.b>.0</v.b></properties><dependencies>' || chr(10) || body || chr(10) || '</dependencies></project>' AS content
FROM (SELECT CAST(floor(p_partkey / 16.0) AS BIGINT) AS c, $join(line; n) AS body FROM (
  SELECT p_partkey, p_partkey AS n, '<dependency><groupId>org.' || lower(replace(p_brand, '#', '')) || '</groupId><artifactId>' || lower(p_type) || '</artifactId><version>' || CASE WHEN p_size % 5 = 4 THEN '$' || '{{v.a}}' ELSE {_id('p_size % 5')} || '.0' END || '</version></dependency>' AS line
  FROM $part) x GROUP BY CAST(floor(p_partkey / 16.0) AS BIGINT)) t
UNION ALL
SELECT 'g' || {_id('p_partkey % 50')}, 'm' || {_id('p_partkey')} || '/build.gradle',
  'dependencies {{' || chr(10) || '    implementation ''org.' || lower(replace(p_brand, '#', '')) || ':' || lower(p_type) || ':' || {_id('p_size % 5')} || '.0''' || chr(10) || '    api platform("org.bom:all:' || {_id('p_size % 2')} || '")' || chr(10) || '}}'
FROM $part"""

PROCESS_FILES = f"""
SELECT 'b' || {_id('s % 10')} AS repo_id, 'Processes/P' || {_id('s')} || '_' || {_id('c')} || CASE WHEN c % 2 = 0 THEN '.bwp' ELSE '.process' END AS path,
  '<pd:process xmlns:pd="urn:pd">' || chr(10) || body || chr(10) || '</pd:process>' AS content
FROM (SELECT s, c, $join(line; n) AS body FROM (
  SELECT s, CAST(floor(n / 64.0) AS BIGINT) AS c, n,
    CASE WHEN n % 5 = 0 THEN '<pd:activity name="call' || {_id('n')} || '" type="CallProcess" processName="P' || {_id('s')} || '_' || {_id('n % 7')} || '"/>'
    ELSE '<pd:activity name="a' || {_id('n')} || '" type="' || CASE n % 3 WHEN 0 THEN 'JDBC' WHEN 1 THEN 'HTTP' ELSE 'JMS' END || '"/><pd:transition from="a' || {_id('n')} || '" to="End"/>' END AS line
  FROM (SELECT DISTINCT l_suppkey AS s, l_partkey AS n FROM $lineitem) l) x GROUP BY s, c) t
UNION ALL
SELECT 'x' || {_id('s_nationkey % 5')}, 'Processes/X' || {_id('s_suppkey')} || '.bwp',
  '<bpws:process xmlns:bpws="b"><bpws:flow><bpws:receive name="Start" createInstance="yes"><bpws:sources><bpws:source linkName="l"/></bpws:sources></bpws:receive><bpws:scope name="g"><bpws:extensionActivity><t:activityExtension name="Log" activityTypeID="bw.log"><bpws:targets><bpws:target linkName="l"/></bpws:targets></t:activityExtension></bpws:extensionActivity></bpws:scope>' ||
  '<t:extActivity name="Sub" type="sub"><t:CallProcess subProcessName="X' || {_id('s_suppkey % 3')} || '"/></t:extActivity></bpws:flow></bpws:process>'
FROM $supplier"""

PLAN_DOCS = f"""
SELECT session_id, 'Intro' || chr(10) || '- [ ] before' || chr(10) || $join(line; n) AS text FROM (
  SELECT o_custkey * 1000 + CAST(floor(o_orderkey / 4096.0) AS BIGINT) AS session_id, o_orderpriority || '~' || {_id('1000000000000 + o_orderkey')} AS n,
    '## ' || o_orderpriority || ' ' || chr(10) || 'text' || chr(10) || '- [' || CASE WHEN o_orderstatus = 'F' THEN 'x' ELSE ' ' END || '] order ' || {_id('o_orderkey')} AS line
  FROM $orders) x GROUP BY session_id"""

MANIFEST_DOCS = f"""
SELECT session_id, '## Phase 1' || chr(10) || '- [ ] src/Other.java' || chr(10) || '## File Change Manifest' || chr(10) || $join(line; n) AS text FROM (
  SELECT l_orderkey * 100 + CAST(floor(l_linenumber / 50.0) AS BIGINT) AS session_id, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS n, CASE l_partkey % 3 WHEN 0 THEN '- [ ] src/F' || {_id('l_partkey')} || '.java changes' WHEN 1 THEN '- [ ] Create `src/F' || {_id('l_partkey')} || '.java` anew' ELSE '- [x] Order.process → src/F' || {_id('l_partkey')} || '.java' END AS line
  FROM $lineitem) x GROUP BY session_id"""

GENERATED_FILES = f"""
SELECT l_orderkey * 100 + CAST(floor(l_linenumber / 50.0) AS BIGINT) AS session_id, 'src/F' || {_id("l_partkey + CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END")} || '.java' AS path
FROM $lineitem"""

IMPACT_DOCS = f"""
SELECT doc_id, 'Spec' || chr(10) ||
  CASE doc_id % 3 WHEN 0 THEN '| File Path | Change Type | Effort (S/M/L) | Notes |' WHEN 1 THEN '| Java File | Go Target File | Change Type | Effort (S/M/L) |' ELSE '| BW Process | Spring Boot Class(es) | Pattern Used | Effort (S/M/L) |' END
  || chr(10) || '|---|---|---|---|' || chr(10) || body || chr(10) || chr(10) || '| Other | Table |' || chr(10) || '|---|---|' || chr(10) || '| x | y |' AS text
FROM (SELECT doc_id, $join(line; n) AS body FROM (
  SELECT CAST(floor(p_partkey / 32.0) AS BIGINT) AS doc_id, p_partkey AS n,
    CASE CAST(floor(p_partkey / 32.0) AS BIGINT) % 3 WHEN 0 THEN '| F' || {_id('p_partkey')} || '.java | ' || p_type || ' | ' || CASE p_size % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'M' WHEN 2 THEN 'L' ELSE 'XL' END || ' | n |'
      WHEN 1 THEN '| F.java | f.go | ' || p_type || ' | ' || CASE p_size % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'M' WHEN 2 THEN 'L' ELSE 'XL' END || ' |'
      ELSE '| P | C | ' || p_brand || ' | ' || CASE p_size % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'M' WHEN 2 THEN 'L' ELSE 'XL' END || ' |' END AS line
  FROM $part) x GROUP BY doc_id) t"""

OPENAPI_DOCS = f"""
SELECT 'r' || {_id('s_nationkey % 5')} AS repo_id,
  CASE WHEN s_suppkey % 2 = 0 THEN 'openapi: 3.0.0' || chr(10) || 'paths:' || chr(10) || '  /s/' || {_id('s_suppkey % 40')} || '/p/' || {_id('s_suppkey % 64')} || ':' || chr(10) || '    get:' || chr(10) || '      summary: x' || chr(10) || '    parameters: []' || chr(10) || '  "/health":' || chr(10) || '    get: {{}}' || chr(10) || '    post: {{}}' || chr(10) ELSE
  '{{"openapi": "3.0.0", "paths": {{"/s/' || {_id('s_suppkey % 40')} || '/p/' || {_id('s_suppkey % 64')} || '": {{"get": {{"summary": "x"}}, "parameters": []}}, "/health": {{"get": {{}}, "post": {{}}}}}}}}' END AS text
FROM $supplier"""

REPLACEMENTS = """
SELECT DISTINCT 'org.' || lower(replace(p_brand, '#', '')) AS group_id, lower(p_type) AS artifact_id, 'new:' || lower(p_type) AS replacement
FROM $part WHERE p_type LIKE '%STEEL%' OR p_type LIKE '%e%'"""

BINDINGS = {
    "replacements": REPLACEMENTS,
    "files": FILES,
    "section_docs": SECTION_DOCS,
    "fenced_docs": FENCED_DOCS,
    "sessions": SESSIONS,
    "deltas": DELTAS,
    "stage_starts": STAGE_STARTS,
    "reviews": REVIEWS,
    "event_log": EVENT_LOG,
    "chat_log": CHAT_LOG,
    "lines": LINES,
    "uploads": UPLOADS,
    "context_files": CONTEXT_FILES,
    "java_files": JAVA_FILES,
    "config_files": CONFIG_FILES,
    "pom_files": POM_FILES,
    "process_files": PROCESS_FILES,
    "plan_docs": PLAN_DOCS,
    "manifest_docs": MANIFEST_DOCS,
    "generated_files": GENERATED_FILES,
    "impact_docs": IMPACT_DOCS,
    "openapi_docs": OPENAPI_DOCS,
    "ready": "SELECT o_orderkey AS session_id, 'brd' AS stage, o_orderdate AS ts FROM $orders",
    "confirms": "SELECT l_orderkey + CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1000000000 END AS session_id, 'brd' AS stage, l_shipdate AS ts FROM $lineitem",
}

_JOIN = re.compile(r"\$join\((\w+); (\w+)\)")
_TABLE = re.compile(r"\$(\w+)")


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The binding as a DataFrame over the parquet tables in ``sf_dir``."""
    text = _JOIN.sub(r"listagg(\1, chr(10)) WITHIN GROUP (ORDER BY \2)", BINDINGS[name])
    return spark.sql(_TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", text))


def check_sql(name: str) -> str:
    """The binding for the checking database, where tables are views."""
    text = _JOIN.sub(r"string_agg(\1, chr(10) ORDER BY \2)", BINDINGS[name])
    return _TABLE.sub(r"\1", text)


def bind_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A single-table binding over the table read as a stream of files."""
    tables = set(_TABLE.findall(_JOIN.sub("", BINDINGS[name])))
    (table,) = tables
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    view = f"codexfold_{table}_stream"
    stream = read_table_stream(spark, sf_dir, schema, f"{table}.parquet")
    stream.createOrReplaceTempView(view)
    return spark.sql(_TABLE.sub(view, BINDINGS[name]))
