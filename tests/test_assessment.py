"""Project quality by hand-made values."""

from corpusloom.operators import assessment as A

SCHEMA = "project string, id long, name string, type string, framework string, content string, dependencies array<string>, patterns array<string>, annotations array<string>, importance double, complexity int, extra string"


def parts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ROWS = [
    # a complete layered project with documented, handled, modern parts
    ("a", 1, "orderController", "controller", "spring-boot", "/** doc */ try { run(); } catch (e) { null check } const x", [], ["mvc"], ["RestController"], 0.9, 3, "x"),
    ("a", 2, "orderService", "service", "spring-boot", "/** doc */ @Override void f() { throw e; } optional", ["lib"], ["mvc"], ["Service"], 0.8, 4, "x"),
    ("a", 3, "orderRepository", "repository", "spring-boot", "/** doc */ lambda raise Optional", ["lib"], ["mvc"], [], 0.7, 5, "x"),
    # a poor one: unbalanced, deprecated, leaking, insecure, of two frameworks, all lower-case names
    ("b", 4, "x", "block", "spring-boot", 'Vector v = new Vector(; password = "1"', ["undefined"], ["p"], [], 0.1, 9, "x"),
    ("b", 5, "main", "block", "react", "var a = sql + b { [", [], ["q"], [], 0.1, 9, "x"),
    # nothing but nulls
    (None, 6, None, None, None, None, None, None, None, None, None, None),
]


def scored(spark, rows, issues=()):
    p = parts(spark, rows)
    i = spark.createDataFrame(list(issues), "project string, severity string")
    return {r["project"]: r for r in A.dimensions(A.measures(p, "project"), i, "project").collect()}


def test_dimensions(spark):
    got = scored(spark, ROWS)
    a = [got["a"][k] for k in A.WEIGHTS]
    assert a == [85.0, 80.0, 90.0, 85.0, 80.0, 95.0, 85.0] and got["a"]["overall"] == 85.25 and got["a"]["level"] == "good"
    b = got["b"]
    # an open parenthesis, an open brace and an open bracket; names x and main are camel and snake
    assert b["accuracy"] == 70.0
    # no controller, service or repository; one undefined dependency; no documentation
    assert b["completeness"] == 30.0
    # low importance; the second part has no dependencies
    assert b["relevance"] == 68.0
    assert (b["consistency"], b["clarity"]) == (60.0, 45.0)
    # vector and var; nothing modern
    assert b["timeliness"] == 75.0
    # nothing handled; a leak
    assert b["reliability"] == 67.0
    assert b["level"] == "poor"


def test_missing_values_are_empty(spark):
    r = scored(spark, ROWS)[None]
    # no framework, pattern or annotation at all; no documentation, no importance and no dependencies
    assert [r[k] for k in A.WEIGHTS] == [0.0, 65.0, 68.0, 85.0, 80.0, 85.0, 70.0]


def test_issues_cost_points(spark):
    issues = [("a", "critical"), ("a", "high"), ("a", "medium"), ("a", "low"), ("a", None), ("z", "critical"), (None, "medium")]
    got = scored(spark, ROWS, issues)
    assert got["a"]["overall"] == 60.25 and got["a"]["level"] == "fair" and set(got) == {"a", "b", None}
    plain = scored(spark, ROWS)
    assert round(plain[None]["overall"] - got[None]["overall"], 4) == 3.0 and got["b"] == plain["b"]


def test_repeated_parts_count_each_time(spark):
    once, twice = scored(spark, ROWS), scored(spark, ROWS + [ROWS[3]])
    assert twice["b"]["accuracy"] == once["b"]["accuracy"] - 5 and twice["b"]["reliability"] == once["b"]["reliability"] - 3


def test_validators_and_their_issues(spark):
    from pyspark.sql import functions as F

    v = A.validations(A.measures(parts(spark, ROWS), "project"), "project", F.when(F.col("project") == "a", 6000).otherwise(5000))
    got = {(r["project"], r["validator"]): (r["score"], r["passed"]) for r in v.collect()}
    assert got["a", "syntax"] == (100.0, True) and got["b", "syntax"] == (80.0, True)
    assert got["a", "structure"] == (90.0, True) and got["b", "structure"] == (70.0, True)
    assert got["a", "consistency"] == (85.0, True) and got[None, "consistency"] == (85.0, True)
    assert got["b", "completeness"] == (75.0, True)
    # credentials in one part, pasted SQL in the other
    assert got["b", "security"] == (65.0, False)
    issues = {(r["project"], r["validator"], r["type"]) for r in A.processing_issues(v, "project").collect()}
    assert issues == {("b", "security", "validation_failure")} | {("a", k, "performance_degradation") for k in A.VALIDATORS}


def test_framework_rules(spark):
    row = lambda i, framework, content: ("p", i, "n", "t", framework, content, [], [], [], 0.5, 1, None)
    rows = [
        row(1, "spring-boot", "@Autowired Repo r; r.save(x)"),
        row(2, "spring-boot", "@Autowired final Repo r; @Transactional r.save(x)"),
        row(3, "react", "useEffect(f)"),
        row(4, "react", "useEffect(f, [a], [b])"),
        row(5, "angular", "@Component class A"),
        row(6, "angular", "@Component class A implements OnDestroy"),
        row(7, "python", "def f(x):\n  pass"),
        row(8, "python", "def f(x: int): ..."),
        row(9, None, "@Autowired"),
        row(10, "react", None),
    ]
    got = {(r["id"], r["rule"], r["severity"]) for r in A.broken_rules(parts(spark, rows), "project").collect()}
    assert got == {(1, "spring-constructor-injection", "medium"), (1, "spring-transaction-management", "high"), (3, "react-hooks-dependencies", "medium"), (5, "angular-component-lifecycle", "low"), (7, "python-type-hints", "low")}


def test_no_parts(spark):
    m = A.measures(parts(spark, []), "project")
    assert m.isEmpty() and A.validations(m, "project").isEmpty() and A.broken_rules(parts(spark, []), "project").isEmpty()
