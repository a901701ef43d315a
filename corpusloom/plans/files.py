"""What extractors, classifiers and measures say about source files.

Patterns, labels and weights are fixed values; each rule becomes a column
expression, so a file is read once for all rules of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources import code
from .both import X, chained, col, derived, first_of, greatest, labels, least, lit, log, rounded, weighed

CONTENT, PATH, KIND = col("content"), col("file_path"), col("kind")
NAME = PATH.first(r"[^/]+$")
LOWER_NAME, LOWER_PATH = NAME.lower(), PATH.lower()
EXTENSION = LOWER_NAME.first(r"\.[^.]*$")


def _files(name: str, doc: str, columns: dict[str, X], where: X | None = None) -> None:
    derived(name, doc, code.files, code.SQL, "files", {"file_id": col("file_id"), **columns}, where)


# ---------------------------------------------------------------- extractors
ES_IMPORT = r"""import\s+.*?\s+from\s+['"]([^'"]+)['"]"""
JAVA_IMPORT = r"import\s+([a-zA-Z0-9_.]+);"
PYTHON_IMPORT = r"(?m)^(?:from\s+([\w.]+)\s+import|import\s+[\w.]+)"
EXPORT = r"export\s+(?:default\s+)?(?:class|function|const|let|var)\s+(\w+)"

_files(
    "import_sources",
    "Sources of ES, Java and Python imports and exported names; all of them as the dependencies of a file.",
    {
        "es_imports": CONTENT.all(ES_IMPORT, 1).joined(),
        "exports": CONTENT.all(EXPORT, 1).joined(),
        "dependencies": chained(CONTENT.all(ES_IMPORT, 1), CONTENT.all(JAVA_IMPORT, 1)).distinct(),
        "imports": chained(CONTENT.all(JAVA_IMPORT, 1), CONTENT.all(ES_IMPORT, 1), CONTENT.all(PYTHON_IMPORT, 1).where(lambda x: x.length() > 0)).distinct(),
        "markers": chained(CONTENT.all(r"@\w+", 0), CONTENT.all(r"use[A-Z]\w+", 0)).distinct(),
    },
)

MAPPINGS = ("Request", "Get", "Post", "Put", "Delete")
_files(
    "file_annotations",
    "Java annotations, Python decorators, JSX props, Vue directives; Spring routes, injected types and transactions.",
    {
        "annotations": CONTENT.all(r"@(\w+)", 1).joined(),
        "decorators": CONTENT.all(r"@([\w.]+)", 1).joined(),
        "jsx": CONTENT.all(r"(\w+)\s*=\s*\{", 1).distinct(),
        "directives": CONTENT.all(r"v-\w+", 0).distinct(),
        "routes": chained(*[CONTENT.all(rf'@{m}Mapping\s*\(\s*"([^"]+)"', 1) for m in MAPPINGS]).joined(),
        "injected": CONTENT.all(r"(?s)@Autowired.*?private\s+(\w+)", 1).joined(),
        "transactions": CONTENT.all(r"@Transactional\w*", 0).joined(),
    },
)

LIFECYCLE = ("componentDidMount", "componentDidUpdate", "componentWillUnmount", "useEffect", "useLayoutEffect")
_files(
    "react_metadata",
    "Hooks, props, state initialisers and lifecycle methods.",
    {
        "hooks": CONTENT.all(r"use[A-Z]\w+", 0).joined(),
        "props": CONTENT.all(r"props\.(\w+)", 1).distinct(),
        "states": CONTENT.all(r"useState\s*\(\s*([^)]+)\)", 1).joined(),
        "lifecycle": labels([(m, CONTENT.contains(m)) for m in LIFECYCLE]),
    },
)

_files(
    "angular_metadata",
    "Injectable services, components and directives.",
    {
        "services": CONTENT.all(r"@Injectable\s*\(\s*\)\s*export\s+class\s+(\w+)", 1).joined(),
        "components": CONTENT.all(r"(?s)@Component\s*\(\s*\{.*?\}\s*\)\s*export\s+class\s+(\w+)", 1).joined(),
        "directives": CONTENT.all(r"(?s)@Directive\s*\(\s*\{.*?\}\s*\)\s*export\s+class\s+(\w+)", 1).joined(),
    },
)

_files(
    "python_web_metadata",
    "Routes of both decorator forms, models, serializers and middleware.",
    {
        "routes": chained(CONTENT.all(r'@app\.route\s*\(\s*"([^"]+)"', 1), CONTENT.all(r'@app\.(?:get|post|put|delete)\s*\(\s*"([^"]+)"', 1)).joined(),
        "models": CONTENT.all(r"class\s+(\w+)\s*\(\s*(?:db\.Model|BaseModel)", 1).joined(),
        "serializers": CONTENT.all(r"class\s+(\w+)\s*\(\s*.*Serializer", 1).joined(),
        "middleware": CONTENT.all(r"class\s+(\w+)\s*\(\s*.*Middleware", 1).joined(),
    },
)

_files(
    "streamlit_metadata",
    "Widgets, layouts, caching decorators and session state keys.",
    {
        "widgets": CONTENT.all(r"st\.(?:button|selectbox|slider|text_input|number_input|checkbox|radio|multiselect)", 0).joined(),
        "layouts": CONTENT.all(r"st\.(?:sidebar|columns|container|expander|tabs)", 0).joined(),
        "caching": CONTENT.all(r"@st\.(?:cache_data|cache_resource|cache)", 0).joined(),
        "sessions": CONTENT.all(r"st\.session_state\.(\w+)", 1).distinct(),
    },
)

METHOD = r"(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?(\w+(?:<[^>]+>)?)\s+(\w+)\s*\(([^)]*)\)"
_files(
    "method_signatures",
    "Return types, names and parameters of methods; fields and classes with what they extend and implement.",
    {
        "return_types": CONTENT.all(METHOD, 1).joined(),
        "methods": CONTENT.all(METHOD, 2).joined(),
        "parameters": CONTENT.all(METHOD, 3).joined(),
        "parameter_names": CONTENT.all(r"[(,]\s*(?:\w+(?:\[\])?)\s+(\w+)\s*(?:=[^,)]*)?[,)]", 1).joined(),
        "fields": CONTENT.all(r"(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?\w+(?:<[^>]+>)?\s+(\w+)\s*(?:=|;)", 1).joined(),
        "classes": CONTENT.all(r"\bclass\s+(\w+)", 1).joined(),
        "extends": CONTENT.all(r"\bextends\s+(\w+)", 1).joined(),
        "implements": CONTENT.all(r"\bimplements\s+(\w+)", 1).joined(),
        "handler": CONTENT.first(r"(?:def|function)\s+(\w+)|(?:const|let)\s+\w+\s*=", 1),
    },
)

# ---------------------------------------------------------------- patterns and tags
DESIGN = [
    ("Singleton", r"private\s+static\s+.*instance.*|getInstance\s*\("),
    ("Factory", r"create[A-Z][a-zA-Z]*\s*\(|Factory\s*\{|\.factory\s*\("),
    ("Observer", r"addObserver|removeObserver|notifyObservers|addEventListener|subscribe|unsubscribe"),
    ("Strategy", r"Strategy\s*\{|algorithm\s*\(|executeStrategy"),
    ("Repository", r"Repository\s*\{|findBy|save|delete|find.*All"),
    ("MVC", r"@Controller|@RestController|Model|View|Controller"),
]
#: Patterns that are looked for in files of a kind.
KIND_PATTERNS = {
    "java": [r"@\w+", r"public\s+class", r"private\s+\w+", r"protected\s+\w+"],
    "react": ["useState", "useEffect", "jsx", "tsx"],
    "flask": [r"def\s+\w+", r"class\s+\w+", r"@\w+"],
    "streamlit": [r"st\.", r"import\s+streamlit", r"@st\.cache", r"st\.sidebar", r"st\.columns"],
    "vue": [r"v-\w+", r"\{\{\s*\w+\s*\}\}", r"<\w+"],
}
_files(
    "code_patterns",
    "Patterns of a file's kind that it matches, and the design patterns that it shows.",
    {
        "patterns": labels([(p, (KIND == k) & CONTENT.rlike(p)) for k, ps in KIND_PATTERNS.items() for p in ps]),
        "design_patterns": labels([(name, CONTENT.rlike(p)) for name, p in DESIGN]),
    },
)

TAGS = [
    ("component", ("@Component",)), ("service", ("@Service",)), ("repository", ("@Repository",)), ("controller", ("@Controller",)), ("react-hook", ("useState",)), ("react-hook", ("useEffect",)),
    ("flask-route", ("@app.route",)), ("fastapi-endpoint", ("@app.get",)),
]
STREAMLIT_TAGS = [
    ("sidebar", ("st.sidebar",)), ("columns", ("st.columns",)), ("tabs", ("st.tabs",)), ("form", ("st.form",)), ("container", ("st.container",)), ("expander", ("st.expander",)), ("session-state", ("st.session_state",)),
    ("cached", ("@st.cache",)), ("file-upload", ("st.file_uploader",)), ("visualization", ("plotly", "pyplot", "chart")), ("data-display", ("dataframe", "table")),
]
CONFIG_TAGS = [("database", ("database", "datasource")), ("security", ("security", "auth")), ("server", ("server", "port")), ("logging", ("logging", "log"))]
TEMPLATE_TAGS = [("form", ("form",)), ("table", ("table",)), ("navigation", ("nav",)), ("interactive", ("button",))]
DOC_TAGS = [
    ("setup", ("install", "setup")), ("api", ("api", "endpoint")), ("configuration", ("config", "configuration")), ("example", ("example", "usage")), ("troubleshooting", ("troubleshoot", "error")),
]
_tagged = lambda text, table: labels([(t, text.contains(*words)) for t, words in table])
_files(
    "content_tags",
    "Tags of code, Streamlit apps, configurations, templates and documentation titles.",
    {
        "code_tags": _tagged(CONTENT, TAGS),
        "streamlit_tags": _tagged(CONTENT, STREAMLIT_TAGS),
        "config_tags": _tagged(CONTENT, CONFIG_TAGS),
        "template_tags": _tagged(CONTENT, TEMPLATE_TAGS),
        "doc_tags": _tagged(LOWER_NAME, DOC_TAGS),
    },
)

# ---------------------------------------------------------------- measures
PRESENCE = [(1, r"if\s*\("), (2, r"for\s*\("), (2, r"while\s*\("), (3, r"switch\s*\("), (2, r"try\s*\{"), (2, r"catch\s*\("), (1, r"async\s+"), (1, r"await\s+")]
LOC = CONTENT.lines(r"^\s*(?:[^\s/*]|/[^/])")
BLOCK = lit(1) + CONTENT.count(r"\bif\b") + CONTENT.count(r"\b(?:for|while)\b") * 2 + CONTENT.count(r"\bswitch\b") * 2
CYCLOMATIC = lit(1) + CONTENT.count(r"\b(?:if|for|while|case|catch|elif|except)\b") + CONTENT.count(r"&&|\|\|")
N_IMPORTS = chained(CONTENT.all(JAVA_IMPORT, 1), CONTENT.all(ES_IMPORT, 1)).size()
N_CLASSES, N_ABSTRACT = CONTENT.count(r"\b(?:class|interface)\s+\w+"), CONTENT.count(r"\babstract\s+class\s+\w+|\binterface\s+\w+")
ABSTRACT = first_of([(0.0, N_CLASSES == 0)], N_ABSTRACT / greatest(N_CLASSES, 1))
INSTABLE = N_IMPORTS / greatest(N_IMPORTS, 1)
_abs = lambda x: greatest(x, lit(0) - x)
_files(
    "complexity_estimates",
    "Weighted presence of control words, block and cyclomatic complexity, lines of code, maintainability, coupling.",
    {
        "complexity": weighed(1, [(w, CONTENT.rlike(p)) for w, p in PRESENCE], 10),
        "block_complexity": BLOCK,
        "cyclomatic": CYCLOMATIC,
        "lines_of_code": LOC,
        "maintainability": rounded(greatest(0, lit(171) - log(greatest(1, CYCLOMATIC)) * 5.2 - log(greatest(1, LOC)) * 0.23)),
        "efferent": N_IMPORTS,
        "instability": rounded(INSTABLE),
        "abstractness": rounded(ABSTRACT),
        "distance": rounded(_abs(ABSTRACT + INSTABLE - 1)),
    },
)

TYPE_BASE = [(0.8, "java"), (0.8, "react"), (0.9, "flask"), (0.7, "streamlit")]
IMPORTANT_KEYS = ("database", "security", "server", "application", "spring", "datasource")
N_FUNCTIONS = CONTENT.count(r"\b(?:function|def)\s+\w+")
N_LINES = CONTENT.lines()
_files(
    "importance_estimates",
    "Importance of a file by its kind and markers, by its structure, and of its path as a configuration key.",
    {
        "importance": rounded(least(1, first_of([(v, KIND == k) for v, k in TYPE_BASE], 0.5) + first_of([(0.2, CONTENT.contains("@RestController", "@Controller"))], 0.0) + first_of([(0.3, CONTENT.contains("main", "Main"))], 0.0) + first_of([(0.2, CONTENT.contains("export default", "public static void main"))], 0.0))),
        "file_importance": rounded(least(1, N_CLASSES * 0.3 + N_FUNCTIONS * 0.2 + N_IMPORTS * 0.1)),
        "class_importance": weighed(0.5, [(0.2, CONTENT.rlike(r"\binterface\s+\w+")), (0.1, CONTENT.rlike(r"\babstract\s+class")), (0.1, CONTENT.rlike(r"@\w+")), (0.1, N_FUNCTIONS > 5)], 1),
        "function_importance": weighed(0.4, [(0.3, CYCLOMATIC > 10), (0.1, CONTENT.rlike(r"@\w+")), (0.05, CONTENT.rlike(r"\basync\s"))], 1),
        "key_importance": first_of([(0.9, LOWER_PATH.contains(*IMPORTANT_KEYS)), (0.8, LOWER_PATH.contains("port", "host", "url"))], 0.6),
        "config_complexity": rounded(least(5, greatest(1, N_LINES / 10))),
    },
)

SECTIONS = [(0.8, "header"), (0.7, "nav"), (0.9, "main"), (0.6, "section"), (0.7, "article"), (0.4, "aside"), (0.3, "footer")]
_files(
    "content_signals",
    "Structure, documentation, error, practice and test signals of a file's text, and its most important HTML section.",
    {
        "structure": weighed(0.5, [(0.2, CONTENT.contains("class ", "interface ")), (0.15, CONTENT.contains("function ", "def ")), (0.1, CONTENT.contains("import ", "require(")), (0.1, CONTENT.contains("{") & CONTENT.contains("}")), (0.1, CONTENT.lines(r"^\s+") / N_LINES > 0.3)], 1),
        "documentation": weighed(0, [(0.4, CONTENT.contains("/**", '"""')), (0.2, CONTENT.contains("//", "#")), (0.2, CONTENT.contains("@param", "@return")), (0.1, CONTENT.contains("TODO", "FIXME")), (0.2, CONTENT.lines(r"^\s*(?://|#|\*)") / N_LINES > 0.1)], 1),
        "errors": weighed(0, [(0.1, CONTENT.contains("TODO")), (0.2, CONTENT.contains("FIXME")), (0.15, CONTENT.contains("HACK")), (0.1, CONTENT.contains("XXX")), (0.05, CONTENT.contains("console.log", "print(")), (0.1, CONTENT.lines(r"^.{121}") > 3)], 1),
        "practices": weighed(0.5, [(0.1, CONTENT.contains("const ", "final ")), (0.1, CONTENT.contains("try") & CONTENT.contains("catch")), (0.05, CONTENT.contains("async", "await")), (0.1, CONTENT.contains("interface", "abstract")), (0.1, CONTENT.rlike(r"\b[a-z][a-zA-Z0-9]*\b"))], 1),
        "tests": first_of([(0.8, CONTENT.lower().contains("test", "spec")), (0.6, CONTENT.lower().contains("mock", "stub")), (0.7, CONTENT.lower().contains("assert", "expect")), (0.4, LOWER_PATH.contains("util", "helper"))], 0.3),
        "section": greatest(*[first_of([(v, CONTENT.contains(f"<{s}"))], 0.0) for v, s in SECTIONS]),
    },
)

# ---------------------------------------------------------------- domains
DOMAINS = ("user", "product", "order", "payment", "inventory", "auth", "admin")
PATH_WORDS = ("src", "main", "java", "com", "org", "components", "services")
CAPITALS = CONTENT.all(r"[A-Z][a-z]+", 0).where(lambda x: (x.length() > 2) & ~((x == "String") | (x == "Object") | (x == "Array") | (x == "Number")))
_files(
    "domain_concepts",
    "Concepts named by path and code, the domain that the path names, and the capability of the file's role.",
    {
        "path_concepts": PATH.all(r"[^/]+", 0).where(lambda x: ~(first_of([(True, x == w) for w in PATH_WORDS], False))).distinct(),
        "concepts": CAPITALS.distinct(),
        "domain": first_of([(d.capitalize(), LOWER_PATH.contains(d)) for d in DOMAINS], "General"),
        "capability": first_of([("Request Processing", LOWER_NAME.contains("controller")), ("Business Logic", LOWER_NAME.contains("service")), ("Data Management", LOWER_NAME.contains("repository")), ("User Interface", LOWER_PATH.contains("component")), ("Cross-cutting Concerns", LOWER_NAME.contains("middleware"))], "General Functionality"),
        "rule_words": CONTENT.all(r"(?i)validate|require|must|should|cannot|forbidden", 0).size(),
    },
)

# ---------------------------------------------------------------- classification
FRAMEWORK_DIRS = {
    "spring-boot": ("src/main/java", "controller", "service", "repository", "entity"),
    "react": ("src", "components", "hooks", "pages", "utils"),
    "angular": ("src/app", "components", "services", "modules"),
    "flask": ("templates", "static", "models", "views"),
    "fastapi": ("routers", "models", "dependencies", "schemas"),
    "streamlit": ("pages", "components", "utils", "data", ".streamlit"),
}
_segments = LOWER_PATH.all(r"[^/]+", 0)


def _hinted(words: tuple[str, ...]) -> X:
    """Whether a path segment holds one of the words or is part of one."""
    either = lambda x: x.contains(*words) | first_of([(True, X(lambda w=w: _contains_col(w, x), f"contains({code.quoted(w)}, {x.sql})")) for w in words], False)
    return _segments.where(either).size() > 0


def _contains_col(word: str, x: X):
    from pyspark.sql import functions as F

    return F.contains(F.lit(word), x.col)


HINTS = {name: _hinted(words) for name, words in FRAMEWORK_DIRS.items()}
PRIMARY = first_of([*HINTS.items(), ("spring-boot", EXTENSION == ".java"), ("react", EXTENSION.ends(".jsx", ".tsx")), ("flask", EXTENSION == ".py")], "generic")
_one_of = lambda x, *values: first_of([(True, x == v) for v in values], False)
SECONDARY = first_of(
    [
        ("test", LOWER_NAME.contains("test", "spec") | LOWER_PATH.contains("/test/")),
        ("configuration", _one_of(EXTENSION, ".json", ".yml", ".yaml", ".properties", ".xml", ".env")),
        ("documentation", _one_of(EXTENSION, ".md", ".txt", ".rst", ".adoc")),
        ("template", _one_of(EXTENSION, ".html", ".htm", ".jinja2", ".j2", ".mustache", ".handlebars")),
        ("static", _one_of(EXTENSION, ".css", ".scss", ".sass", ".less", ".js", ".ts", ".png", ".jpg", ".gif", ".svg") & LOWER_PATH.contains("static", "assets", "public")),
        ("build", LOWER_NAME.contains("build", "dist", "target")),
        ("code", _one_of(EXTENSION, ".java", ".py", ".js", ".ts", ".jsx", ".tsx", ".vue", ".php", ".rb", ".go", ".rs")),
    ],
    "static",
)
#: (framework, category, role, pattern in the file's name or text)
ROLE_RULES = [
    ("spring-boot", "code", "controller", "@Controller|@RestController"),
    ("spring-boot", "code", "service", "@Service"),
    ("spring-boot", "code", "repository", "@Repository"),
    ("spring-boot", "code", "entity", "@Entity|@Table"),
    ("spring-boot", "configuration", "application", r"application\.properties|application\.yml"),
]
NAME_ROLES = [
    ("controller", ("controller",)), ("service", ("service",)), ("repository", ("repository", "dao")), ("model", ("model", "entity")), ("component", ("component",)), ("utility", ("util", "helper")), ("interface", ("interface",)),
    ("enum", ("enum",)),
]
_primary, _secondary = col("primary_class"), col("secondary_class")
TERTIARY = first_of(
    [
        *[(role, (_primary == f) & (_secondary == c) & (LOWER_NAME.rlike(p) | CONTENT.rlike(p))) for f, c, role, p in ROLE_RULES],
        *[(role, (_secondary == "code") & LOWER_NAME.contains(*words)) for role, words in NAME_ROLES],
        ("integration", (_secondary == "test") & LOWER_NAME.contains("e2e", "integration")),
        ("unit", (_secondary == "test") & LOWER_NAME.contains("unit")),
        ("application", (_secondary == "configuration") & LOWER_NAME.contains("application", "main")),
        ("database", (_secondary == "configuration") & LOWER_NAME.contains("database", "db")),
        ("security", (_secondary == "configuration") & LOWER_NAME.contains("security")),
    ],
    "unknown",
)


def classified(rows: DataFrame) -> DataFrame:
    """``rows`` (file_path, content) with primary_class, secondary_class and tertiary_class, each worked out once."""
    rows = rows.withColumns({"primary_class": PRIMARY.col, "secondary_class": SECONDARY.col})
    return rows.withColumn("tertiary_class", TERTIARY.col)


CLASSIFIED_SQL = f"{code.SQL}, staged AS (SELECT *, {PRIMARY.sql} AS primary_class, {SECONDARY.sql} AS secondary_class FROM files), classified AS (SELECT *, {TERTIARY.sql} AS tertiary_class FROM staged)"


def _classified(name: str, doc: str, columns: dict[str, X]) -> None:
    derived(name, doc, lambda spark, sf_dir: classified(code.files(spark, sf_dir)), CLASSIFIED_SQL, "classified", {"file_id": col("file_id"), **columns})


_classified(
    "file_classification",
    "Framework, category and role of each file, the frameworks that its folders hint at, and its depth.",
    {
        "primary_class": col("primary_class"),
        "secondary_class": col("secondary_class"),
        "tertiary_class": col("tertiary_class"),
        "hints": labels(list(HINTS.items())),
        "depth": _segments.size(),
    },
)

_files(
    "file_kinds",
    "Which frameworks' files these are by name and text, and whether a file is to be indexed.",
    {
        "is_react": EXTENSION.ends(".jsx", ".tsx") | CONTENT.contains("import React", "from 'react'"),
        "is_vue": EXTENSION == ".vue",
        "is_flask": (EXTENSION == ".py") & CONTENT.contains("from flask import", "@app.route"),
        "is_streamlit": (EXTENSION == ".py") & CONTENT.contains("import streamlit"),
        "is_spring": (EXTENSION == ".java") & CONTENT.contains("@RestController", "@Controller", "@Service", "@Repository", "@Entity"),
        "is_controller": CONTENT.contains("@Controller", "@RestController"),
        "is_indexed": (CONTENT.length() < 1048576) & _one_of(EXTENSION, ".java", ".py", ".ts", ".tsx", ".js", ".vue", ".md", ".json") & ~LOWER_PATH.contains("node_modules", "/dist/", "/build/", ".git/"),
    },
)

# ---------------------------------------------------------------- findings
LOW = CONTENT.lower()
#: (finding, severity, condition)
FINDINGS = [
    ("hardcoded password", "high", CONTENT.rlike(r"""(?i)password\s*=\s*["'][^"']*["']""")),
    ("concatenated query", "high", CONTENT.contains("createQuery(") & CONTENT.contains("+")),
    ("mapping without authorisation", "medium", CONTENT.contains("@RequestMapping") & ~CONTENT.contains("@PreAuthorize")),
    ("eager fetching", "medium", CONTENT.contains("@OneToMany") & ~CONTENT.contains("LAZY")),
    ("save outside a transaction", "low", CONTENT.contains("save(") & ~CONTENT.contains("@Transactional")),
    ("field injection", "low", CONTENT.contains("@Autowired") & CONTENT.contains("private") & ~CONTENT.contains("final")),
    ("raw inner HTML", "high", CONTENT.contains("dangerouslySetInnerHTML")),
    ("eval", "critical", CONTENT.contains("eval(")),
    ("component without memo", "low", CONTENT.contains("function") & CONTENT.contains("props") & ~CONTENT.contains("React.memo")),
    ("effect without dependencies", "low", CONTENT.contains("useEffect") & ~CONTENT.contains("], [")),
]
_files(
    "framework_findings",
    "Security, performance and practice findings of each file, and how many of them are urgent.",
    {
        "findings": labels([(f, c) for f, _, c in FINDINGS]),
        "severities": labels([(s, c) for _, s, c in FINDINGS]),
        "n_urgent": weighed(0, [(1, c) for _, s, c in FINDINGS if s in ("critical", "high")]),
    },
)

DEPRECATED = [
    ("Vector", LOW.contains("vector") & ~LOW.contains("arraylist")),
    ("Hashtable", LOW.contains("hashtable") & ~LOW.contains("hashmap")),
    ("var", LOW.contains("var ") & ~LOW.contains("let ") & ~LOW.contains("const ")),
]
_files(
    "code_health",
    "Unclosed brackets, deprecated constructs, modern ones, security patterns and weak spots.",
    {
        "n_syntax_errors": weighed(0, [(1, CONTENT.contains(a) & ~CONTENT.contains(z)) for a, z in ("{}", "()", "[]")]),
        "deprecated": labels(DEPRECATED),
        "is_modern": LOW.contains("@override", "lambda", "stream"),
        "security_patterns": labels([("Method-level authorization", CONTENT.contains("@PreAuthorize")), ("Role-based security", CONTENT.contains("@Secured")), ("Security configuration", CONTENT.contains("SecurityConfig"))]),
        "weak_spots": labels([("Potential hardcoded credentials", CONTENT.contains("password") & CONTENT.contains("=")), ("Potential SQL injection", CONTENT.contains("sql") & CONTENT.contains("+"))]),
        "is_auth": LOW.contains("authentication", "authorization"),
    },
)

#: role: (layer, responsibility, concerns)
LAYERS = {
    "controller": ("presentation", "Handle HTTP requests and responses", "Input validation|Response formatting|Error handling"),
    "service": ("business", "Implement business logic and workflows", "Business rules|Transaction management|Orchestration"),
    "repository": ("data", "Data access and persistence", "Data consistency|Query optimization|Schema management"),
    "model": ("data", "Data access and persistence", "Data consistency|Query optimization|Schema management"),
    "entity": ("data", "Data access and persistence", "Data consistency|Query optimization|Schema management"),
    "middleware": ("cross-cutting", "Cross-cutting concerns", "Security|Logging|Monitoring"),
    "component": ("presentation", "User interface and interaction", "User experience|Accessibility|Responsive design"),
}
_role = col("tertiary_class")
_classified(
    "architectural_roles",
    "Layer, responsibility and concerns of a file by its role.",
    {
        "layer": first_of([(v[0], _role == k) for k, v in LAYERS.items()], "business"),
        "responsibility": first_of([(v[1], _role == k) for k, v in LAYERS.items()], "General business logic"),
        "concerns": first_of([(v[2], _role == k) for k, v in LAYERS.items()], ""),
    },
)

NAMING = weighed(1, [(-0.2, (_primary == "spring-boot") & (_role == "controller") & ~CONTENT.contains("Controller")), (-0.2, (_primary == "react") & (_role == "component") & ~NAME.rlike("^[A-Z]"))])
STRUCTURE = weighed(1, [(-0.1, CONTENT.contains("TODO", "FIXME")), (-0.2, CONTENT.contains("catch") & ~CONTENT.contains("log"))])
DOCUMENTATION = weighed(1, [(-0.3, ~CONTENT.contains("/**") & CONTENT.contains("function ", "def ")), (-0.2, CONTENT.count(r"(?:^|[^A-Za-z0-9_])[a-z]{1,2}(?:[^A-Za-z0-9_]|$)") > 3)])
_classified(
    "convention_scores",
    "How well a file keeps conventions of naming, structure and documentation, and the mean.",
    {"naming": NAMING, "structure": STRUCTURE, "documentation": DOCUMENTATION, "overall": rounded((NAMING + STRUCTURE + DOCUMENTATION) / 3)},
)

REST = [r"""@app\.route\(["']([^"']+)["']""", r"""app\.(?:get|post|put|delete)\(["']([^"']+)["']""", r"""@(?:Get|Post|Put|Delete)Mapping\(.*?["']([^"']+)["']""", r"""router\.(?:get|post|put|delete)\(["']([^"']+)["']"""]
_files(
    "service_apis",
    "APIs that a file exposes and calls, and what kind of service it looks like.",
    {
        "exposed": chained(*[CONTENT.all(p, 1) for p in REST]).joined(),
        "consumed": chained(CONTENT.all(r"fetch[A-Z]\w*", 0), CONTENT.all(r"(?:axios|requests)\.(?:get|post|put|delete)", 0)).joined(),
        "kind_of_service": first_of([("web", CONTENT.contains("@RestController", "Flask(")), ("dashboard", CONTENT.contains("import streamlit")), ("frontend", CONTENT.contains("useState", "<template>"))], "library"),
        "confidence": weighed(0.5, [(0.2, CONTENT.contains("@RestController", "Flask(")), (0.2, chained(*[CONTENT.all(p, 1) for p in REST]).size() > 0), (0.1, CONTENT.contains("Repository", "db.Model"))], 1),
    },
)

DIRECTORIES = {"source": ("src", "app", "lib"), "tests": ("test", "spec"), "configuration": ("config", "conf"), "documentation": ("docs", "doc"), "assets": ("assets", "static", "public"), "services": ("services", "dashboards")}
_files(
    "directory_classes",
    "Classes of the folders on a file's path.",
    {"classes": labels([(name, _segments.where(lambda x, words=words: first_of([(True, x == w) for w in words], False)).size() > 0) for name, words in DIRECTORIES.items()])},
)
