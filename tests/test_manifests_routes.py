"""Version ranges, frameworks and routes by hand."""

from pyspark.sql import functions as F

from corpusloom.functions import versions as V
from corpusloom.operators import manifests as M
from corpusloom.operators import routes as R
from corpusloom.sources import texts as S

RANGES = [
    ("^1.2.3", "1.2.3", "2"), ("^0.2.3", "0.2.3", "0.3"), ("^0.0.3", "0.0.3", "0.0.4"), ("^0", "0", "1"), ("~1.2.3", "1.2.3", "1.3"), ("~1", "1", "2"), ("~=1.4.2", "1.4.2", "1.5"), ("~> 2.2", "2.2", "3"), (">=1.0,<2", "1.0", "2"), (">= 1.0 < 2.0", "1.0", "2"),
    ("1.x", "1", "2"), ("==2.1.*", "2.1", "2.2"), ("v3.1", "3.1", "3.1.0.1"), ("1.0 - 2.0", "1.0", "2.0.0.1"), (">2", "2.0.0.1", None), ("<=3", "0", "3.0.0.1"), ("*", "0", None), ("latest", "0", None), ("", "0", None), (None, "0", None), ("1.2.3-beta.1", "1.2.3", "1.2.3.1"), (">=1,!=1.5,<2", "1", "2"),
]


def number(v):
    return [2_000_000_000] * 4 if v is None else ([int(x) for x in v.split(".")] + [0] * 4)[:4]


def test_ranges(spark):
    df = spark.createDataFrame([(i, c) for i, (c, *_) in enumerate(RANGES)], "i int, c string")
    got = {r["i"]: [(list(x["low"]), list(x["high"])) for x in r["r"]] for r in df.select("i", V.ranges(F.col("c")).alias("r")).collect()}
    assert got == {i: [(number(a), number(b))] for i, (_, a, b) in enumerate(RANGES)}
    two = spark.createDataFrame([("^1.2 || >=3 <4",), (">2 <1",), ("git+ssh://x",), ("^2 || file:a",)], "c string").select(F.size(V.ranges(F.col("c")))).collect()
    assert [r[0] for r in two] == [2, 0, 0, 1]
    keys = spark.createDataFrame([("v1.10",), ("1.9.9",), ("x",), (None,)], "v string").select(V.key(F.col("v"))).collect()
    assert [r[0] for r in keys] == [[1, 10, 0, 0], [1, 9, 9, 0], None, None] and keys[0][0] > keys[1][0]


def test_frameworks(spark):
    rows = [
        ("npm", "a", "@angular/core", "^15.0.1"), ("npm", "a", "rxjs", None), ("npm", "b", "angular", "1.8.2"), ("npm", "b", "vue", ">=2.6 <3"), ("npm", "c", "angular", "^2.0"), ("npm", "c", "vue", "^2.7 || ^3"), ("npm", "c", "react-dom", "18"), ("npm", "d", "react", "*"),
        ("pip", "e", "Flask", "2.0"), ("pip", "e", "Django", None), ("pip", "e", "flask-login", None), ("maven", "f", "spring-boot-starter-web", None), ("maven", "f", "spring-core", None), ("gradle", "g", "spring-boot-starter", None), ("poetry", "h", "fastapi", "^0.100"), ("npm", "i", None, "1"),
    ]
    got = {(r["path"], r["framework"]) for r in M.frameworks(spark.createDataFrame(rows, "kind string, path string, dependency string, version string")).collect()}
    assert got == {
        ("a", "Angular"), ("b", "AngularJS"), ("b", "Vue.js"), ("b", "Vue 2"), ("c", "Vue.js"), ("c", "Vue 2"), ("c", "Vue 3"), ("d", "React"), ("e", "Flask"), ("e", "Django"), ("f", "Spring Boot"), ("f", "Spring Framework"), ("g", "Spring Boot (Gradle)"), ("h", "FastAPI (Poetry)"),
    }


def test_manifest_texts(spark):
    files = [("p", "package.json", '{"dependencies": {"@angular/core": "^2.1"}, "devDependencies": {"angular": "1.5"}}'), ("r", "requirements.txt", "# c\nflask>=2\nstreamlit\n"), ("m", "pom.xml", "<dependency><groupId>g</groupId><artifactId>spring-core</artifactId></dependency>"), ("x", "package.json", "{broken")]
    found = M.frameworks(S.manifest_dependencies(spark.createDataFrame(files, "path string, name string, content string")))
    assert {(r["path"], r["framework"]) for r in found.collect()} == {("p", "Angular"), ("p", "AngularJS"), ("r", "Flask"), ("r", "Streamlit"), ("m", "Spring Framework")}


def test_angular_generation(spark):
    files = [("new", "src/main.ts"), ("old", "lib/angular.min.js"), ("points", "a.controller.js"), ("points", "b.filter.js"), ("points", "c.directive.js"), ("both", "tsconfig.json"), ("both", "angular.js"), ("both", "x.component.ts"), ("few", "a.controller.js"), ("pack", "index.html"), ("typed", "x.d.ts"), (None, "main.ts"), ("null", None)]
    deps = [("pack", "angular"), ("both", "angular"), ("both", "@angular/core"), ("few", None), ("absent", "rxjs")]
    got = {r["project"]: r["generation"] for r in M.angular_generation(spark.createDataFrame(files, "project string, file_path string"), spark.createDataFrame(deps, "project string, dependency string")).collect()}
    assert got == {"new": "angular", "old": "angularjs", "points": "angularjs", "both": "angular", "few": None, "pack": "angularjs", "typed": None, None: "angular"}


def test_included_routes(spark):
    files = [
        ("site/urls.py", "urlpatterns = [\n  path('admin/', admin.site),\n  path('api/', include('shop.urls')),\n  # path('gone/', views.gone),\n  re_path(r'^old/$', views.old, name='old'),\n]"),
        ("shop/urls.py", 'urlpatterns = [path("", views.home), path("items/<int:id>/", include(("items.urls", "items"))), path("self/", include("shop.urls"))]'),
        ("items/urls.py", "urlpatterns = [path('edit', views.edit), path('back/', include('shop.urls')), path('none/', include('absent.urls'))]"),
        ("x/urls.py", "urlpatterns = [path('y/', include('y.urls')), path('x', a)]"), ("y/urls.py", "urlpatterns = [path('x/', include('x.urls')), path('y', b)]"), ("views.py", "path('no', no)"), ("n.py", None),
    ]
    got = sorted((r["root"], r["path"], r["handler"], len(r["modules"])) for r in R.included_routes(R.url_entries(spark.createDataFrame(files, "file_path string, content string"))).collect())
    assert got == [
        ("site.urls", "/admin", "admin.site", 1), ("site.urls", "/api", "views.home", 2), ("site.urls", "/api/items/<int:id>/edit", "views.edit", 3), ("site.urls", "/old", "views.old", 1), ("x.urls", "/x", "a", 1), ("x.urls", "/y/y", "b", 2),
    ]
    assert R.included_routes(R.url_entries(spark.createDataFrame([], "file_path string, content string"))).collect() == []


def test_resource_routes(spark):
    text = "Rails.application.routes.draw do\n  root 'x#y'\n  get '/health', to: 'status#up'\n  namespace :admin do\n    resources :users do\n      resource :avatar\n      post 'ban'\n    end\n    resources :logs\n  end\n  # resources :hidden\n  resources :posts\nend"
    got = sorted((r["path"], r["method"], r["handler"]) for r in R.resource_routes(spark.createDataFrame([("r.rb", text), ("n", None), ("e", "")], "file_path string, content string")).collect())
    five = lambda base, name: [(base, "GET", f"{name}#index"), (base, "POST", f"{name}#create"), (base + "/:id", "GET", f"{name}#show"), (base + "/:id", "PUT", f"{name}#update"), (base + "/:id", "DELETE", f"{name}#destroy")]
    four = [("/admin/users/:user_id/avatar", m, f"avatar#{a}") for m, a in (("GET", "show"), ("POST", "create"), ("PUT", "update"), ("DELETE", "destroy"))]
    assert got == sorted([("/health", "GET", "status#up"), *five("/admin/users", "users"), *four, ("/admin/users/:user_id/ban", "POST", "unknown"), *five("/admin/logs", "logs"), *five("/posts", "posts")])


def test_topmost(spark):
    rows = ["a", "a/b/c/d/e/f/g", "ab", "x/y", "x/yz", "x/y/z/1/2/3/4/5", "q/r", "q"]
    got = sorted(r[0] for r in M.topmost(spark.createDataFrame([(r,) for r in rows], "folder string")).collect())
    assert got == ["a", "ab", "q", "x/y", "x/yz"]
