"""Frameworks of projects by their manifests and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import versions as V

#: Framework, kind of manifest, dependency (a pattern of the whole name), least version, version behind the last, confidence.
RULES = [
    ("Spring Boot", "maven", "spring-boot-(starter|parent).*", None, None, 0.95),
    ("Spring Framework", "maven", "spring-(context|core)", None, None, 0.9),
    ("Spring Security", "maven", ".*spring-security.*", None, None, 0.9),
    ("Spring Data JPA", "maven", ".*spring-data-jpa.*", None, None, 0.9),
    ("Spring Boot (Gradle)", "gradle", "spring-boot-starter.*", None, None, 0.95),
    ("React", "npm", "react", None, None, 0.95),
    ("Next.js", "npm", "next", None, None, 0.95),
    ("Angular", "npm", "@angular/core", "2", None, 0.95),
    ("AngularJS", "npm", "angular", None, "2", 0.95),
    ("Vue.js", "npm", "vue", None, None, 0.95),
    ("Vue 2", "npm", "vue", "2", "3", 0.9),
    ("Vue 3", "npm", "vue", "3", "4", 0.9),
    ("Express.js", "npm", "express", None, None, 0.95),
    ("NestJS", "npm", "@nestjs/core", None, None, 0.95),
    ("Flask", "pip", "(?i)flask", None, None, 0.95),
    ("FastAPI", "pip", "(?i)fastapi", None, None, 0.95),
    ("Django", "pip", "(?i)django", None, None, 0.95),
    ("Streamlit", "pip", "(?i)streamlit", None, None, 0.95),
    ("FastAPI (Poetry)", "poetry", "(?i)fastapi", None, None, 0.95),
]

#: Parts of file names, and dependencies, that speak for either generation of Angular, with their points.
NEW_FILES = ["angular.json", "angular-cli.json", ".angular-cli.json", "tsconfig.json", "main.ts", "polyfills.ts"]
OLD_FILES = ["angular.js", "angular.min.js"]
NEW_PARTS = [(".component.", 5), (".service.", 3), (".module.", 2)]
OLD_PARTS = [(".controller.", 5), (".directive.", 2), (".filter.", 5)]
TYPESCRIPT_POINTS = 10
NEW_PACKAGES = [("@angular/core", 20), ("@angular/cli", 15), ("typescript", 10), ("rxjs", 10)]
OLD_PACKAGES = [("angular-route", 10), ("angular-resource", 10)]
OLD_CORE_POINTS = 20
LEAST_POINTS = 10


def frameworks(dependencies: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """(path, framework, dependency, version, confidence): for each manifest, rules of its kind whose dependency it has in a version that they allow.

    ``dependencies`` has kind, path, dependency and version, a constraint such as
    ``^1.2``.  A rule applies if the constraint and the rule's versions have one
    in common; without a version every rule of the dependency does.  Of several
    dependencies by which a rule applies the first in order is told.
    """
    spark = dependencies.sparkSession
    table = spark.createDataFrame(rules, "framework string, kind string, pattern string, least string, below string, confidence double")
    table = F.broadcast(table)  # a row for each rule
    met = dependencies.join(table, "kind").where(F.expr("dependency rlike concat('^(?:', pattern, ')$')"))
    met = met.where(V.allows(F.col("version"), V.key(F.col("least")), V.key(F.col("below"))))
    first = F.min(F.struct("dependency", "version"))
    return met.groupBy("path", "framework").agg(first.alias("first"), F.max("confidence").alias("confidence")).select("path", "framework", "first.dependency", "first.version", "confidence")


def angular_generation(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(project, generation) of projects by their files (project, file_path) and dependencies (project, dependency): angular, angularjs, or null.

    Files that only one generation has decide; with those of both or none, the
    points of file names and packages do, if one side has more and over ten.
    """
    path = F.col("file_path")
    any_of = lambda names: F.max(F.greatest(*[F.contains(path, F.lit(n)).cast("int") for n in names]) if len(names) > 1 else F.contains(path, F.lit(names[0])).cast("int"))
    points = lambda parts: sum((F.count_if(F.contains(path, F.lit(p))) * n for p, n in parts[1:]), F.count_if(F.contains(path, F.lit(parts[0][0]))) * parts[0][1])
    typed = F.max((path.endswith(".ts") & ~path.endswith(".d.ts")).cast("int")) * TYPESCRIPT_POINTS
    seen = files.where("file_path IS NOT NULL").groupBy("project").agg(any_of(NEW_FILES).alias("new_file"), any_of(OLD_FILES).alias("old_file"), (typed + points(NEW_PARTS)).alias("new_points"), points(OLD_PARTS).alias("old_points"))
    has = lambda name: F.max((F.col("dependency") == name).cast("int"))
    of_packages = lambda packages: sum((has(p) * n for p, n in packages[1:]), has(packages[0][0]) * packages[0][1])
    named = dependencies.where("dependency IS NOT NULL").groupBy("project").agg(of_packages(NEW_PACKAGES).alias("new_packages"), (of_packages(OLD_PACKAGES) + has("angular") * (1 - has("@angular/core")) * OLD_CORE_POINTS).alias("old_packages"))
    both = seen.join(named, "project", "left").fillna(0, ["new_packages", "old_packages"])
    new, old = F.col("new_points") + F.col("new_packages"), F.col("old_points") + F.col("old_packages")
    by_points = F.when((new > old) & (new > LEAST_POINTS), "angular").when((old > new) & (old > LEAST_POINTS), "angularjs")
    return both.select("project", F.when((F.col("new_file") == 1) & (F.col("old_file") == 0), "angular").when((F.col("old_file") == 1) & (F.col("new_file") == 0), "angularjs").otherwise(by_points).alias("generation"))


def topmost(folders: DataFrame) -> DataFrame:
    """Rows of ``folders`` (folder, ...) of which no other row's folder is above, at any depth."""
    parts = F.split("folder", "/")
    above = folders.select("folder", F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("above"))
    below = above.join(folders.select(F.col("folder").alias("above")).distinct(), "above", "left_semi").select("folder").distinct()
    return folders.join(below, "folder", "left_anti")
