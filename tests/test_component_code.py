"""The code of single-file components is that of their scripts."""

import os

import pytest

from corpusloom.functions import lexer as L
from corpusloom.operators import declarations as D
from corpusloom.queries import QUERIES

SF = "/root/testdata/sf0.001"
VUE = """<template>
  <p v-if="a">it's {{ b }} // no comment</p> <!-- class Not { } <script> -->
</template>
<script lang="ts">
import C from './c.vue'; // class Never { }
export class A extends B {
  go() { if (a) { run("</p>"); } }
}
</script>
<style>.a { color: red } /* class Nor { } */</style>
<!-- it's class Neither { -->"""


def test_scripts_of_components(spark):
    df = spark.createDataFrame([("a", VUE, "vue"), ("s", VUE, "svelte")], "f string, t string, lang string")
    rows = sorted((r["f"], r["kind"], r["name"], r["parent"], r["start_line"], r["end_line"], r["complexity"], tuple(r["calls"])) for r in D.declarations(df, "f", "t", "lang").collect())
    want = [("class", "A", None, 6, 8, 2, ("run",)), ("method", "go", "A", 7, 7, 2, ("run",))]
    assert rows == [(f, *w) for f in "as" for w in want]
    assert {(r["f"], r["module"]) for r in D.imports(df, "f", "t", "lang").collect()} == {("a", "./c.vue"), ("s", "./c.vue")}
    cleaned = L.without_comments(VUE, "vue")
    assert "it's {{ b }} // no comment</p>\n</template>" in cleaned and "import C from './c.vue';\n" in cleaned and cleaned.endswith("{ color: red } </style>")


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_every_kind_of_file_is_read(spark):
    """Each component declares three classes; its last comment is none of its code."""
    rows = QUERIES["code_declarations"](spark, SF).where("file_id % 5 = 4").groupBy("file_id", "kind").count().collect()
    assert len(rows) == 40 and {(r["kind"], r["count"]) for r in rows} == {("class", 3)}
    assert QUERIES["halstead_measures"](spark, SF).count() == 200
