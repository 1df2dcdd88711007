from codexfold.operators import corpus as C
from codexfold.operators import specs as P

FILES = "repo_id string, path string, content string"


def files(spark, *items):
    return spark.createDataFrame([("r", p, c) for p, c in items], FILES)


SPRING = """package com.x.api;
import com.x.core.Order;
import static java.util.List.of;
@RestController
@RequestMapping("/orders")
public class OrderApi extends Base<Order, Long> implements Api, Closeable {
  @GetMapping("/{id}") public Order one() { return null; }
  @PostMapping
  public void add() {}
  // MIGRATED: record
  // MIGRATED FROM: JdbcActivity
}
interface Api extends Closeable, Marker {}
record Pair(int a, Map<String, Integer> b) implements Marker {}
enum Kind { A }
"""
JAXRS = """package com.x.core;
@Path("/orders")
@ApplicationScoped
public class Orders {
  @GET @Path("/{id}") public Order one() { return null; }
  @DELETE
  public void drop() {}
}
"""


def test_dependencies_and_degrees(spark):
    df = files(spark, ("A.java", SPRING), ("B.java", JAXRS), ("C.txt", SPRING))
    edges = C.dependency_edges(df)
    assert {(r.source, r.target, r.weight, r.internal) for r in edges.collect()} == {
        ("com.x.api", "com.x.core", 1, True), ("com.x.api", "java.util", 1, False)
    }
    degrees = {r.package: (r.fan_out, r.fan_in) for r in C.dependency_degrees(edges).collect()}
    assert degrees == {"com.x.api": (2, 0), "com.x.core": (0, 1), "java.util": (0, 1)}
    packages = {r.package: (r.files, r.types) for r in C.package_inventory(df).collect()}
    assert packages == {"com.x.api": (1, 4), "com.x.core": (1, 1)}


def test_hierarchy(spark):
    df = files(spark, ("A.java", SPRING))
    got = {(r.kind, r.type, r.relation, r.parent, r.parent_declared) for r in C.type_hierarchy(df).collect()}
    assert got == {
        ("class", "OrderApi", "extends", "Base", False), ("class", "OrderApi", "implements", "Api", True),
        ("class", "OrderApi", "implements", "Closeable", False), ("interface", "Api", "extends", "Closeable", False),
        ("interface", "Api", "extends", "Marker", False), ("record", "Pair", "implements", "Marker", False),
    }
    assert {r.type for r in C.hierarchy_roots(df).collect()} == {"Api", "Pair", "Kind"}


def test_endpoints(spark):
    df = files(spark, ("A.java", SPRING), ("B.java", JAXRS))
    got = {(r.verb, r.route, r.files, r.duplicated) for r in C.endpoint_inventory(df).collect()}
    assert got == {("GET", "/orders/{id}", 2, True), ("POST", "/orders", 1, False), ("DELETE", "/orders", 1, False)}
    spec = spark.createDataFrame([("r", '{"paths": {"/orders/{id}": {"get": {"a": [1]}, "summary": "s"}, "/new": {"put": {}}}}'), ("r", "{bad")], "repo_id string, text string")
    drift = {(r.verb, r.route, r.status) for r in P.endpoint_drift(spec, C.endpoint_inventory(df)).collect()}
    assert drift == {
        ("GET", "/orders/{id}", "both"), ("PUT", "/new", "only_in_spec"),
        ("POST", "/orders", "only_in_code"), ("DELETE", "/orders", "only_in_code"),
    }


def test_config_of_properties_and_variables(spark):
    variables = (
        '<r xmlns="u"><globalVariables><globalVariable><name>a</name><value/></globalVariable>'
        "<globalVariable><name>b</name><value>1 &amp; 2</value></globalVariable></globalVariables></r>"
    )
    df = files(
        spark, ("application.properties", "a = 1\n#c=2\n! d=3\nb.c:x=y\n\nnovalue\n=v"), ("application-dev.properties", "a=2"),
        ("x/application.properties", "a=9"), ("d.substvar", variables), ("e.substvar", "<globalVariable><name>z</nam></globalVariable>"),
    )
    got = {(r.profile, r.key): (r.entries, r.lowest, r.highest, r.conflicting) for r in C.config_inventory(df).collect()}
    assert got == {
        ("default", "a"): (3, "", "9", True), ("default", "b.c"): (1, "x=y", "x=y", False), ("dev", "a"): (1, "2", "2", False),
        ("default", "b"): (1, "1 & 2", "1 & 2", False), ("default", "z"): (1, "", "", False), ("default", "novalue"): (1, "", "", False),
    }


def test_properties_lines(spark):
    text = "k=a\\\n   b\\\n#c\nx y\na\\:b=c\np = C:\\\\dir\n# no \\\nu=\\u00e9\\n!\nlast=\\"
    df = files(spark, ("a.properties", text))
    assert {(r.key, r.value) for r in C.config_entries(df).collect()} == {
        ("k", "ab#c"), ("x", "y"), ("a:b", "c"), ("p", "C:\\dir"), ("u", "é\n!"), ("last", "")
    }
    assert C.config_unread(df).count() == 0 and C.config_unread(files(spark, ("b.properties", "=v"))).first().line == 1


YAML = """# c
server:
  port: 8080   # note
  hosts:
  - a
  - b # x
  nested:
    - name: n1
      url: "http://x/#y"
      tags: [p, 'q r', "s,t"]
    - empty:
spring: {datasource: {url: jdbc:x}, list: []}
text: |
  one
    two
fold: >-
  a
  b
plain: this goes
  on here
'quoted key': 'it''s'
ref: *A
matrix:
  - - 1
    - 2
---
spring.config.activate.on-profile: dev
server:
  port: 9
"""


def test_yaml(spark):
    df = files(spark, ("conf/app.yml", YAML), ("app-prod.yaml", "server:\n  port: 1\n"), ("bad.yml", "a: [1\n\tb: 2\nc: 3"), ("none.yml", ""))
    got = {(r.path, r.profile, r.key, r.value) for r in C.config_entries(df).collect()}
    own = {(k, v) for p, profile, k, v in got if p == "conf/app.yml" and profile == "default"}
    assert own == {
        ("server.port", "8080"), ("server.hosts[0]", "a"), ("server.hosts[1]", "b"), ("server.nested[0].name", "n1"), ("server.nested[0].url", "http://x/#y"),
        ("server.nested[0].tags[0]", "p"), ("server.nested[0].tags[1]", "q r"), ("server.nested[0].tags[2]", "s,t"), ("server.nested[1].empty", ""),
        ("spring.datasource.url", "jdbc:x"), ("spring.list", ""), ("text", "one\n  two"), ("fold", "a b"), ("plain", "this goes on here"),
        ("quoted key", "it's"), ("matrix[0][0]", "1"), ("matrix[0][1]", "2"),
    }
    assert {x for x in got if x[1] != "default"} == {
        ("conf/app.yml", "dev", "spring.config.activate.on-profile", "dev"), ("conf/app.yml", "dev", "server.port", "9"), ("app-prod.yaml", "prod", "server.port", "1")
    }
    assert {x for x in got if x[0] == "bad.yml"} == {("bad.yml", "default", "c", "3")}
    unread = {(r.path, r.line, r.text) for r in C.config_unread(df).collect()}
    assert unread == {("conf/app.yml", 22, "ref: *A"), ("bad.yml", 1, "a: [1"), ("bad.yml", 2, "\tb: 2")}


def test_yaml_contracts(spark):
    text = 'openapi: 3.0.0\npaths:\n  /o/{id}:\n    get:\n      summary: x\n    post: {}\n    parameters: []\n  "/h.x":\n    put:\ninfo:\n  get: no\n'
    docs = spark.createDataFrame([("r", text), ("r", '{"paths": {"/j": {"get": {}}}}'), ("r", "plain"), ("r", None)], "repo_id string, text string")
    assert {(r.verb, r.route) for r in P.openapi_endpoints(docs).collect()} == {("GET", "/o/{id}"), ("POST", "/o/{id}"), ("PUT", "/h.x"), ("GET", "/j")}


def test_versions_by_name(spark):
    root = "<project><version>9</version><properties><a>1${b}</a><b>.5</b><loop>${loop2}</loop><loop2>${loop}</loop2></properties><!-- <dependency><groupId>no</groupId></dependency> --></project>"
    def dep(g, v):
        return f"<dependency><groupId>{g}</groupId><artifactId>x</artifactId><version>{v}</version></dependency>"
    child = "<project><parent><version>9</version></parent><properties><b>.7</b></properties>" + dep("near", "${a}") + dep("own", "${project.version}") + dep("loop", "${loop}") + dep("unknown", "${zz}") + "</project>"
    gradle = 'def v = "2.0"\next.w = "3"\ndependencies {\n  implementation "g:a:$v"\n  annotationProcessor "g:c:${w}"\n  api platform("g:b:1")\n  testImplementation("g:d")\n' \
        '  // implementation "no:no:1"\n  runtimeOnly group: "g", name: "e", version: "${p}"\n  kapt(\'g:f:1:cls@jar\')\n}\n'
    df = files(spark, ("pom.xml", root), ("m/pom.xml", child), ("s/build.gradle", gradle), ("gradle.properties", "p=4"), ("other/pom.xml", dep("far", "${b}")))
    got = {(r.path, r.group_id, r.artifact_id): r.version for r in C.libraries(df).collect()}
    assert got == {
        ("m/pom.xml", "near", "x"): "1.7", ("m/pom.xml", "own", "x"): "9", ("m/pom.xml", "loop", "x"): "${loop}", ("m/pom.xml", "unknown", "x"): "${zz}",
        ("s/build.gradle", "g", "a"): "2.0", ("s/build.gradle", "g", "c"): "3", ("s/build.gradle", "g", "b"): "1", ("s/build.gradle", "g", "d"): "",
        ("s/build.gradle", "g", "e"): "4", ("s/build.gradle", "g", "f"): "1", ("other/pom.xml", "far", "x"): ".5",
    }


def test_processes_of_the_executable_form(spark):
    text = '''<bpws:process xmlns:bpws="b" xmlns:tibex="t"><bpws:links><bpws:link name="l1"/><bpws:link name="l2"/></bpws:links><bpws:flow>
<bpws:receive name="Start" createInstance="yes"><bpws:sources><bpws:source linkName="l1"/></bpws:sources></bpws:receive>
<bpws:scope name="Group"><bpws:extensionActivity><tibex:activityExtension name="Log" activityTypeID="bw.log"><bpws:targets><bpws:target linkName="l1"/></bpws:targets>
<bpws:sources><bpws:source linkName="l2"/></bpws:sources></tibex:activityExtension></bpws:extensionActivity></bpws:scope>
<bpws:extensionActivity><tibex:extActivity name="Sub" type="bw.internal.subprocess"><bpws:targets><bpws:target linkName="l2"/></bpws:targets><tibex:CallProcess subProcessName="in.Child"/></tibex:extActivity></bpws:extensionActivity>
<bpws:invoke name="Ask" operation="o"/><!-- <bpws:invoke name="No"/> --></bpws:flow></bpws:process>'''
    classic = '''<pd:process xmlns:pd="u"><pd:starter name="In"><pd:type>com.HTTP</pd:type></pd:starter><pd:group name="g"><pd:activity name="A"><pd:type>X</pd:type></pd:activity></pd:group>
<pd:transition><pd:from>In</pd:from><pd:to>A</pd:to></pd:transition></pd:process>'''
    rows = C.process_parts(files(spark, ("M.bwp", text), ("C.process", classic), ("bad.bwp", "<bpws:process><bpws:receive name=\"R\"><x"), ("e.bwp", "")))
    got = {p: {(r.item, r.name, r.detail) for r in rows.collect() if r.process == p} for p in ("M", "C", "bad")}
    assert got["M"] == {
        ("starter", "Start", "receive"), ("activity", "Log", "bw.log"), ("activity", "Sub", "bw.internal.subprocess"), ("activity", "Ask", "invoke"),
        ("call", "in.Child", ""), ("transition", "Start", "Log"), ("transition", "Log", "Sub"),
    }
    assert got["C"] == {("starter", "In", "com.HTTP"), ("activity", "A", "X"), ("transition", "In", "A")}
    assert got["bad"] == {("starter", "R", "receive")}


def test_libraries(spark):
    pom = "<dependency>\n <groupId> g </groupId><artifactId>a</artifactId>\n</dependency><dependency><groupId>g</groupId><artifactId>a</artifactId><version>2</version></dependency>"
    gradle = "dependencies {\n  implementation 'g:a:2'\n  testImplementation(\"h:b:1\")\n}"
    df = files(spark, ("pom.xml", pom), ("m/build.gradle", gradle), ("k/build.gradle.kts", gradle), ("x.xml", pom))
    mapping = spark.createDataFrame([("g", "a", "new:a")], "group_id string, artifact_id string, replacement string")
    got = {(r.group_id, r.artifact_id): (r.versions, r.repositories, r.conflicting, r.replacement) for r in C.library_inventory(df, mapping).collect()}
    assert got == {("g", "a"): (2, 1, True, "new:a"), ("h", "b"): (1, 1, False, None)}


def test_markers_and_annotations(spark):
    df = files(spark, ("A.java", SPRING), ("B.java", JAXRS))
    got = {(r.path, r.marker, r.occurrences) for r in C.feature_markers(df, [("get", r"@GetMapping\b|@GET\b", "x"), ("no", "zzz", "y")]).collect()}
    assert got == {("A.java", "get", 1), ("B.java", "get", 1)}
    left = {r.annotation: r.occurrences for r in C.unmapped_annotations(df, ["Path", "GET", "RestController"]).collect()}
    assert left == {"RequestMapping": 1, "GetMapping": 1, "PostMapping": 1, "ApplicationScoped": 1, "DELETE": 1}


def test_entities_and_schemas(spark):
    entity = '@Entity\n@Table(name = "orders")\nclass Order {\n @OneToMany(mappedBy = "o") private List<Line> lines;\n @ManyToOne private Customer c;\n}'
    xsd = '<xs:schema xmlns:xs="u"><xs:element name="e1"/><xs:complexType name="t1"><xs:element name="e2"/></xs:complexType></xs:schema>'
    df = files(spark, ("O.java", entity), ("P.java", "class P {}"), ("a.xsd", xsd), ("bad.xsd", "<xs:schema"))
    got = {(r.item, r.name, r.detail) for r in C.entity_model(df).collect()}
    assert got == {
        ("entity", "Order", "orders"), ("OneToMany", "Order", "Line"), ("ManyToOne", "Order", "Customer"),
        ("element", "e1", ""), ("element", "e2", ""), ("complexType", "t1", ""),
    }


def test_processes(spark):
    main = '<p:process xmlns:p="u"><p:activity name="a" type="HTTP"/><p:activity name="c" type="Call" processName="Sub"/><p:transition from="a" to="c"/></p:process>'
    df = files(spark, ("Main.bwp", main), ("x/Sub.process", "<process><activity name='q' type='JDBC'/></process>"), ("Bad.bwp", "<process>"))
    got = {r.process: (r.activities, r.transitions, r.calls, r.fan_in) for r in C.bw_process_inventory(df).collect()}
    assert got == {"Main": (2, 1, 1, 0), "Sub": (1, 0, 0, 1)}
    assert {r.activity_type: r.activities for r in C.activity_types(df).collect()} == {"HTTP": 1, "Call": 1, "JDBC": 1}


def test_profile_counts_lines(spark):
    got = {r.suffix: (r.files, r.bytes, r.lines, r.share) for r in C.tech_stack_profile(files(spark, ("a.go", "é\n"), ("b.go", ""), ("c", "x"))).collect()}
    assert got == {".go": (2, 3, 3, 0.75), "": (1, 1, 1, 0.25)}


def test_impact_tables(spark):
    text = "| a | b |\n|---|---|\n| 1 | 2 |\n\n| BW Process | Effort (S/M/L) |\n| :-- | --: |\n| p | S |\n| q | huge |\n| r |\n\nx\n| File | Change Type | Effort |\n|-|-|-|\n| f | Edit | L |"
    rows = P.impact_rows(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert {(r.subject, r.change_type, r.effort) for r in rows} == {("p", None, "S"), ("q", None, "huge"), ("r", None, None), ("f", "Edit", "L")}


def test_plan_tasks_and_manifest(spark):
    text = "- [ ] zero\n# Plan\n## Phase 1: x\n - [x] one\n* [X] two\n### sub\n- [ ] three\n## File Change Manifest (all)\n- [ ] `a/B.java` edit\n- [ ] c.go\n- plain"
    plan = spark.createDataFrame([(1, text)], "session_id int, text string")
    got = {r.phase: (r.open, r.done) for r in P.plan_tasks(plan).collect()}
    assert got == {"": (1, 0), "Phase 1: x": (1, 2), "File Change Manifest (all)": (2, 0)}
    generated = spark.createDataFrame([(1, "c.go"), (1, "c.go"), (1, "d.go")], "session_id int, path string")
    status = {r.path: r.status for r in P.manifest_coverage(plan, generated).collect()}
    assert status == {"a/B.java": "missing", "c.go": "matched", "d.go": "extra"}


def test_required_outputs(spark):
    sessions = spark.createDataFrame([(1, "java-to-go"), (2, "java-to-quarkus"), (3, "java17-to-java25")], "session_id int, pattern string")
    made = spark.createDataFrame([(1, "main.go"), (2, "pom.xml"), (4, "go.mod")], "session_id int, path string")
    got = {(r.session_id, r.path) for r in P.required_outputs(sessions, made).collect()}
    assert got == {(1, "go.mod"), (2, "src/main/resources/application.properties")}


def test_migrated_markers(spark):
    got = {(r.kind, r.reason) for r in P.migrated_markers(files(spark, ("A.java", SPRING))).collect()}
    assert got == {("reason", "record"), ("from", "JdbcActivity")}


def test_diagrams(spark):
    text = "```mermaid\ngraph LR\n  A[x y] --> B --> C\n  A -->|label| C\n  D(d)\n```\n```mermaid\nsequenceDiagram\n A --> Z\n```"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    edges = {(r.source, r.target, r.occurrences) for r in P.diagram_edges(docs).collect()}
    assert edges == {("A", "B", 1), ("B", "C", 1), ("A", "C", 1)}
    nodes = {r.node: (r.out_degree, r.in_degree, r.declared) for r in P.diagram_nodes(docs).collect()}
    assert nodes == {"A": (2, 0, True), "B": (1, 1, False), "C": (0, 2, False), "D": (0, 0, True)}


def test_annotations_of_any_shape(spark):
    text = '''package p;
@RequestMapping(produces = "x/y", value = {"/o", "/alt"})
@RestController
public class A {
  @GetMapping(produces = "a;b", value = "/x/{id}") A one(@PathVariable("id") int i) { return null; }
  @PostMapping({"/p", "/q"}) void two() {}
  @RequestMapping(path = "/r", method = {RequestMethod.PUT, RequestMethod.GET}) void three() {}
  @RequestMapping("/any") void four() {}
  @Deprecated void five() {}
}
'''
    jaxrs = '''@Path("/j") @Singleton class B { @Path("/x") @GET void a() {} @GET @Produces("t") @Path("/y") void b() {} @DELETE void c() {} }'''
    got = {(r.path, r.verb, r.route) for r in C.endpoints(files(spark, ("A.java", text), ("B.java", jaxrs))).collect()}
    both = lambda verb, *ends: {("A.java", verb, p + e) for p in ("/o", "/alt") for e in ends}
    assert got == both("GET", "/x/{id}", "/r") | both("POST", "/p", "/q") | both("PUT", "/r") | both("ANY", "/any") | {
        ("B.java", "GET", "/j/x"), ("B.java", "GET", "/j/y"), ("B.java", "DELETE", "/j")
    }


def test_entities_in_one_file_and_nested_annotations(spark):
    text = '''@Table(indexes = {@Index(name = "i", columnList = "a")}, schema = "s", name = "t")
@Entity
public class A { @OneToMany(mappedBy = "a") List<B> bs; }
@Entity @Table(name = "u", indexes = {@Index(name = "k")}) class B { @ManyToOne A a; }
@Entity class D {}
'''
    got = [(r.item, r.name, r.detail) for r in C.entity_model(files(spark, ("A.java", text))).collect()]
    assert sorted(got) == [("ManyToOne", "B", "A"), ("OneToMany", "A", "B"), ("entity", "A", "t"), ("entity", "B", "u"), ("entity", "D", "")]


def test_annotated_and_rare_types(spark):
    text = "@Data public class A extends B {}\n@Foo(1) non-sealed class D extends B {}\nstrictfp class E {}\n// class No {}\n * class No {}\nreturn X.class;\n"
    assert {r.type for r in C.type_declarations(files(spark, ("A.java", text))).collect()} == {"A", "D", "E"}


def test_processes_as_the_tool_writes_them(spark):
    text = '''<pd:process xmlns:pd="u"><pd:activity name="Read"><pd:type>com.JDBC</pd:type><config/></pd:activity>
<pd:activity name="Sub"><pd:type>CallProcess</pd:type><config><processName>/Processes/In/Child.process</processName></config></pd:activity>
<pd:activity name="Plain"/><pd:transition><pd:from>Read</pd:from><pd:to>Sub</pd:to></pd:transition></pd:process>'''
    got = {(r.item, r.name, r.detail) for r in C.process_parts(files(spark, ("P/Main.process", text))).collect()}
    assert got == {("activity", "Read", "com.JDBC"), ("activity", "Sub", "CallProcess"), ("activity", "Plain", ""), ("call", "Child", ""), ("transition", "Read", "Sub")}


NESTED = '''package p; // @GetMapping("/old") class No {}
/* class No2 { @GetMapping("/older") } */
@RequestMapping("/a") @RestController
public class A<T extends Comparable<T>> extends Base<Map<String, List<X>>> implements I<T>, q.J {
  @GetMapping(Routes.LIST) A one(@PathVariable("id") int i) { int[] x = {1, 2}; if (a < b) { } return null; }
  @PostMapping({"/p", "/q" + V.x}) void two() { class Local extends Z {} }
  @OneToMany(mappedBy = "o") private java.util.List<Line<T>> lines = new ArrayList<>();
  @interface Ann { String value() default "class Fake {"; }
  static class In { @GetMapping("/in") void q() {} }
  @DeleteMapping(value = "/d", produces = {"a", "b"}) void z();
}
@RequestMapping(path = "/b") class B { @GetMapping void g() {} @RequestMapping(method = GET, value = "/h") void h() {} }
class X { Object o = X.class; char c = '"'; record R2(int a) {} }
class Box<T extends Comparable<T>> extends Base<T> {}
'''


def test_type_arguments_comments_and_strings(spark):
    got = {(r.type, p.relation, p.parent) for r in C.type_declarations(files(spark, ("A.java", NESTED))).collect() for p in r.parents or [None] if p}
    assert got == {("A", "extends", "Base"), ("A", "implements", "I"), ("A", "implements", "q.J"), ("Local", "extends", "Z"), ("Box", "extends", "Base")}
    assert {r.type for r in C.type_declarations(files(spark, ("A.java", NESTED))).collect()} == {"A", "Local", "In", "B", "X", "R2", "Box"}


def test_routes_of_every_type_and_unresolved_paths(spark):
    got = {(r.verb, r.route) for r in C.endpoints(files(spark, ("A.java", NESTED))).collect()}
    assert got == {
        ("GET", "/a/${Routes.LIST}"), ("POST", "/a/p"), ("POST", "/a/q${V.x}"), ("GET", "/in"), ("DELETE", "/a/d"), ("GET", "/b"), ("GET", "/b/h")
    }
    many = "class M { @GetMapping({" + ", ".join(f'"/m{k}"' for k in range(600)) + "}) void m() {} }"
    assert C.endpoints(files(spark, ("M.java", many))).count() == 600


def test_relations_of_every_shape(spark):
    members = """@OneToMany List<Line<T>> a = new X<>(); @ManyToMany Map<K, ? extends q.Role> b; @OneToOne q.Addr getC() { return null; }
 @ManyToOne(targetEntity = Z.class, cascade = {A, B}) @JoinColumn(name = ";{") private final Customer d; @Column int e;"""
    text = '@Entity @Table(name = "' + "n" * 5_000 + '") ' + "@Meta(\"x\") " * 2_000 + "class E { " + members + "}"
    got = {(r.item, r.name, r.detail) for r in C.entity_model(files(spark, ("E.java", text))).collect()}
    assert got == {
        ("entity", "E", "n" * 5_000), ("OneToMany", "E", "Line"), ("ManyToMany", "E", "Role"), ("OneToOne", "E", "Addr"), ("ManyToOne", "E", "Customer")
    }


def test_hostile_texts_take_seconds(spark):
    import time

    blank, notes = "\n" * 100_000, "@A(\"x\")\n" * 100_000
    df = files(spark, ("A.java", blank + "package p;\nclass X {}"), ("B.java", notes + "class Y {}"), ("C.java", "@A " * 50_000 + "class Z {}"), ("build.gradle", blank),
               *((f"D{k}.java", t) for k, t in enumerate(["class A extends " + "<" * 100_000, "@A(" * 100_000, "{" * 100_000, '"' * 99_999, "/*" * 99_999])))
    start = time.time()
    assert {r.type for r in C.type_declarations(df).collect()} >= {"X", "Y"}
    df = df.unionByName(files(spark, *((f"h{k}.{x}", t) for k, t in enumerate(["- " * 20_000, "[" * 50_000, "a:\n" * 50_000, "{a: " * 20_000, "<activity " * 50_000, "<a>" * 50_000, "\\" * 99_999]) for x in ("yml", "bwp", "properties"))))
    for operator in (C.package_inventory, C.dependency_edges, C.endpoints, C.entity_model, C.libraries, C.config_entries, C.process_parts):
        operator(df).collect()
    assert time.time() - start < 60


def test_imports_are_read_once(spark):
    """Both sides of the lookup share the exchange behind the one scan of the text."""
    made = spark.createDataFrame([("r", "A.java", "package a;\nimport b.B;\n"), (None, "B.java", "package b;\nimport b.c.C;\nimport a.A;\n"), (None, "C.java", "package a;\n")], FILES)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        edges = C.dependency_edges(made)
        plan = edges._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum("regexp_extract_all" in line for line in plan.splitlines()) == 1
    got = sorted((r.repo_id or "", r.source, r.target, r.weight, r.internal) for r in edges.collect())
    assert got == [("", "b", "a", 1, False), ("", "b", "b.c", 1, False), ("r", "a", "b", 1, False)]


def test_readers_return_arrow(spark):
    """No reader goes through pandas, which converts nested rows once more in Python."""
    from codexfold.functions import java, processes, settings

    text = spark.createDataFrame([("class A extends B {}",), (None,)], "content string")
    for reader in (java.java_types, java.java_declarations, processes.process_items, settings.properties_entries, settings.yaml_entries):
        plan = text.select(reader(text["content"]).alias("x"))._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "], 250" in plan, plan
    rows = text.select(java.java_declarations(text["content"]).alias("x")).collect()
    assert rows[0].x[0].parents[0].parent == "B" and rows[1].x == []


def test_leads_and_plain_annotations_read_as_before():
    """The short ways of the Java reader give what the long ones give."""
    from codexfold.functions.java import tokens_of, types_of

    assert tokens_of("/* a */ package a.b;\nimport static c.D.*;\n// x\nclass") == ["class"]
    assert tokens_of("import static class A { }") == ["import", "static", "class", "A", "{", "}"]
    assert [t["type"] for t in types_of("import a.record;\nclass A { } // class B { }")] == ["A"]
    assert types_of('@T(name = "x") @U("y") @V class A {}')[0]["annotations"] == [
        {"name": "T", "arguments": [{"key": "name", "values": ["x"]}]},
        {"name": "U", "arguments": [{"key": "", "values": ["y"]}]},
        {"name": "V", "arguments": []},
    ]


def _plan(spark, made):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return made()._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_hierarchy_reads_once_and_answers_hot_parents_in_place(spark):
    """Sources are read once; edges are not dealt for counting, nor by salts; all thresholds agree."""
    texts = [f"class T{k} extends {'Base' if k % 3 else 'T' + str(k + 2)} implements Api, Gone<T{k}>, Api {{}}" for k in range(40)]
    rows = [(f"r{k % 2}" if k < 38 else None, f"T{k}.java", t) for k, t in enumerate(texts)] + [("r0", "A.java", "interface Api {}\nclass T1 implements Gone {}")]
    df = spark.createDataFrame(rows + rows[:5], FILES)
    expected, declared = set(), {("r0", "Api")} | {(r, p[:-5]) for r, p, _ in rows if r and p[0] == "T"}
    for k, (repo, _, _) in enumerate(rows[:38]):
        expected |= {(repo, f"T{k}", rel, parent, (repo, parent) in declared) for rel, parent in (("extends", "Base" if k % 3 else f"T{k + 2}"), ("implements", "Api"), ("implements", "Gone"))}
    expected.add(("r0", "T1", "implements", "Gone", False))
    for hot_rows in (1, 8, 100_000):
        got = [(r.repo_id, r.type, r.relation, r.parent, r.parent_declared) for r in C.type_hierarchy(df, hot_rows).collect()]
        assert sorted(got) == sorted(expected)
        roots = {(r.repo_id, r.type) for r in C.hierarchy_roots(df, hot_rows).collect()}
        assert roots == (declared | {("r0", "T1")}) - {e[:2] for e in expected if e[4]}
    for operator, most in ((C.type_hierarchy, 3), (C.hierarchy_roots, 4)):
        plan = _plan(spark, lambda operator=operator: operator(df))
        assert sum("ArrowEvalPython" in line for line in plan) == 1
        assert sum("Exchange hashpartitioning" in line and "Reused" not in line for line in plan) <= most
        assert not any("_salt" in line for line in plan)


def test_declarations_end_with_the_last_header(monkeypatch):
    """Bodies behind the last header are not read; what is declared is what the whole text says."""
    from codexfold.functions import java

    read, tokens_of = [], java.tokens_of
    monkeypatch.setattr(java, "tokens_of", lambda text: read.append(len(text)) or tokens_of(text))
    body = "  int x() { return y.getClass().classes + Foo.class; }\n" * 1_000
    assert [(t["type"], t["parents"]) for t in java.declarations_of("package a;\nclass A extends B {\n" + body + "}")] == [("A", [{"relation": "extends", "parent": "B"}])]
    assert sum(read) < 100
    for text in (
        None, "", "class", "class A", "class A {", "class A { /* class B {\n */ }\nclass C\n /* { */ extends D\n {\n}", "// class A {\nclass B<T extends X {",
        '"""\nclass A {\n""" class B { "\n', "@A(class B {\n) class C {\n}", "class A(\n) { }", "@interface A { class B {\n", "class A { x = Foo.class; } record R(int a) implements I {\n} subclass X {}",
    ):
        assert java.declarations_of(text) == [{**t, "annotations": [], "members": []} for t in java.types_of(text)], text


def test_routes_are_made_by_the_reader(spark):
    """Only verbs and routes leave the reader, not all types with their members."""
    text = """@RequestMapping({"/a/", "b"}) class A {
      @RequestMapping(path = "/x//y/", method = {RequestMethod.GET, PUT, "ü"}) void f();
      @GET @Path("/p") @Path(value = "q") void g();
      @DELETE void h();
      @RequestMapping @PatchMapping(C.D) void i();
      @GetMapping("/") void j();
    }
    class B { @GetMapping("/") void k(); @HEAD() void l(); }"""
    df = files(spark, ("A.java", text), ("A.java", text), ("B.txt", text), (None, text), ("C.java", None))
    got = [(r.verb, r.route) for r in C.endpoints(df).collect()]
    expected = {(v, f"{p}{at}") for p in ("/a", "/b") for v, at in (
        ("GET", "/x/y"), ("PUT", "/x/y"), ("", "/x/y"), ("GET", "/p"), ("GET", "/q"), ("DELETE", ""), ("ANY", ""), ("PATCH", "/${C.D}"), ("GET", ""))}
    assert sorted(got) == sorted(expected | {("GET", "/"), ("HEAD", "/")})
    assert not any("transform(" in line or "members" in line for line in _plan(spark, lambda: C.endpoints(df)))
