"""Source files derived from the documents, for the operators that read code.

Each document becomes one file.  Its first words name packages, classes, routes
and fields of a skeleton in one of five kinds (Java, React, Flask, Streamlit,
Vue), and its whole text follows as a comment, so that work on these files grows
with the texts.  A skeleton is a template with ``{1}`` for the first word and
``{C1}`` for the same word with a capital; ``SQL`` is the same derivation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

WORD = "[a-z]{3,12}"
#: Words that a skeleton takes, and the characters at a text's begin in which they are looked for first.
WORDS, BEGIN = 5, 400

#: kind: (path, skeleton, begin of the comment, end of the comment, what a new line of it begins with)
KINDS: dict[str, tuple[str, str, str, str, str]] = {
    "java": (
        "src/main/java/com/{1}/{2}/{C1}Controller.java",
        """package com.{1}.{2};
import java.util.List;
import com.{3}.model.{C3};
@RestController
@RequestMapping("/{1}")
public class {C1}Controller extends {C2}Base implements {C3}Api {
  private static {C1}Controller instance;
  @Autowired
  private {C3}Service {3}Service;
  @Autowired
  private {C4}Repository {4}Repository;
  @GetMapping("/{2}/{id}")
  public List<String> find{C4}(String {4}, int limit) {
    try {
      if (limit > 10) { return null; }
      for (String s : {3}Service.all()) { {4}Repository.save(s); }
    } catch (Exception e) { System.out.println(e); }
    return {4}Repository.findBy{C5}({4});
  }
  @PostMapping("/{5}")
  @Transactional
  public void create{C5}({C3} {3}) { {3}Service.notifyObservers({3}); }
  public static void main(String[] args) { while (args.length > 0) { getInstance(); } }
}
""",
        "/** ", " */", " * ",
    ),
    "react": (
        "src/components/{1}/{C1}{C2}.tsx",
        """import React from 'react';
import { {2} } from '@{3}/{2}';
import {C4} from './{C4}';
export default function {C1}{C2}(props) {
  const [{3}, set{C3}] = useState({4});
  useEffect(() => { fetch{C4}(props.{4}); });
  if (props.{5}) { return null; }
  const handle{C5} = async () => { await props.{5}({3}); };
  return <div className="{1}" onClick={handle{C5}}>{props.{4}}</div>;
}
export const {2}Limit = 20;
export class {C3}Store { subscribe() { switch ({2}Limit) { default: } } }
""",
        "/* ", " */", "",
    ),
    "flask": (
        "services/{1}/app_{2}.py",
        """import os
from flask import Flask
from {1}.{2} import {C3}
app = Flask(__name__)
class {C4}(db.Model):
    pass
class {C4}Serializer(serializers.Serializer):
    pass
class {C5}Middleware(BaseMiddleware):
    pass
@app.route("/{1}/{2}")
def list_{2}({3}, {4}=None):
    if {3}:
        for x in {3}:
            print(x)
    elif {4}:
        raise ValueError({4})
    return {3}
@app.get("/{5}")
async def get_{5}(user):
    while user:
        break
""",
        "# ", "", "# ",
    ),
    "streamlit": (
        "dashboards/{1}_{2}.py",
        """import streamlit as st
import pandas as pd
from {3} import load_{4}
@st.cache_data
def load_{2}({1}):
    return pd.read_csv({1})
st.sidebar.selectbox("{1}", ["{2}", "{3}"])
left, right = st.columns(2)
st.session_state.{4} = st.slider("{5}")
if st.button("{5}"):
    st.dataframe(load_{2}(st.session_state.{4}))
st.session_state.{1} = st.text_input("{1}")
""",
        "# ", "", "# ",
    ),
    "vue": (
        "src/views/{C1}View.vue",
        """<template>
  <section v-if="{1}"><form><button v-on:click="{2}">{{ {3} }}</button></form>
  <table v-for="{4}"></table><nav></nav></section>
</template>
<script>
import {C4} from './{C4}.vue';
export default { name: '{C1}View', methods: { {2}() { if (this.{3}) { this.{5}(); } } } };
@Injectable() export class {C2}Service {}
@Component({ selector: '{1}' }) export class {C3}Component {}
@Directive({ selector: '{4}' }) export class {C4}Directive {}
</script>
<style>.{5} { color: red } #{1} { } @media print { }</style>
""",
        "<!-- ", " -->", "",
    ),
}

_PLACE = re.compile(r"\{(C?)([1-5])\}")


def _parts(template: str) -> list[tuple[str, str, int]]:
    """(text before, 'C' or '', number of the word) of each place, and the rest with number 0."""
    out, at = [], 0
    for m in _PLACE.finditer(template):
        out.append((template[at : m.start()], m[1], int(m[2])))
        at = m.end()
    return [*out, (template[at:], "", 0)]


def _filled(template: str) -> Column:
    """The template with the columns w1 to w5 and, with a capital, cap1 to cap5."""
    return F.concat(*[c for text, kind, n in _parts(template) for c in (F.lit(text), *([F.col(f"cap{n}" if kind else f"w{n}")] if n else []))])


def _filled_sql(template: str) -> str:
    word = lambda n: f"coalesce(w[{n}], 'item')"
    capital = lambda n: f"upper(substr({word(n)}, 1, 1)) || substr({word(n)}, 2)"
    return " || ".join(c for text, kind, n in _parts(template) for c in (quoted(text), *([capital(n) if kind else word(n)] if n else [])))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def first_words(text: Column) -> Column:
    """The first ``WORDS`` words of a text, or all if it has fewer, and maybe some after them.

    If the begin of the text has more words than that, the first ones end before
    the cut and are the text's; only other texts are searched as a whole.
    """
    begin = F.regexp_extract_all(F.left(text, F.lit(BEGIN)), F.lit(WORD), F.lit(0))
    return F.when(F.size(begin) > WORDS, begin).otherwise(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, kind, file_path, content of each document; a null text is an empty comment, a null id has no kind.

    Kinds are put together from tables of their own, whose skeletons are small
    enough to be compiled, and of which a query on one kind makes no other.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.lit(None).cast("string")
    out = docs.where("file_id IS NULL").select("file_id", none.alias("kind"), none.alias("file_path"), none.alias("content"))
    for k, (name, (where, skeleton, begin, end, line)) in enumerate(KINDS.items()):
        own = docs.where(F.pmod("file_id", F.lit(len(KINDS))) == k).withColumn("words", first_words(F.col("text")))
        own = own.withColumns({f"w{n}": F.coalesce(F.get("words", F.lit(n - 1)), F.lit("item")) for n in range(1, WORDS + 1)})
        own = own.withColumns({f"cap{n}": F.concat(F.upper(F.substring(f"w{n}", 1, 1)), F.substring(f"w{n}", 2, 20)) for n in range(1, WORDS + 1)})
        body = F.concat(_filled(skeleton), F.lit(begin), F.replace("text", F.lit("\n"), F.lit("\n" + line)), F.lit(end))
        out = out.unionByName(own.select("file_id", F.lit(name).alias("kind"), _filled(where).alias("file_path"), body.alias("content")))
    return out


def _files_sql() -> str:
    when = lambda value: "CASE " + " ".join(f"WHEN doc_id % {len(KINDS)} = {k} THEN {value(n, v)}" for k, (n, v) in enumerate(KINDS.items())) + " END"
    body = lambda n, v: f"{_filled_sql(v[1])} || {quoted(v[2])} || replace(t, chr(10), chr(10) || {quoted(v[4])}) || {quoted(v[3])}"
    return (
        f"files AS (SELECT doc_id AS file_id, {when(lambda n, v: quoted(n))} AS kind, {when(lambda n, v: _filled_sql(v[0]))} AS file_path, {when(body)} AS content "
        f"FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents))"
    )


SQL = _files_sql()
