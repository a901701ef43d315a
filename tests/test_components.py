"""Sections of components and parts of Streamlit pages, by hand."""

from corpusloom.operators import chunking as C

VUE = '<template>\n  <div><template v-if="a">x</template></div>\n</template>\n<script lang="ts" setup>\nconst a = 1\n</script>\n<style scoped>.a { }</style>\n<style lang=scss>\n.b { }</style>'
SVELTE = "<script>let a</script>\n<h1>{a}</h1>\n<style>h1 { }</style>"
PAGE = "import streamlit as st\n@st.cache_data(ttl=3)\ndef load(a):\n  pass\ndef main_page(x):\n  st.button('a'); st.button('b')\n  st.columns(2)\n  st.map(load(1))\n@st.cache\ndef old(): pass\n"


def test_component_sections(spark):
    df = spark.createDataFrame([("v", VUE), ("s", SVELTE), ("t", "plain text"), ("n", None), ("e", "<script></script>")], "f string, t string")
    got = sorted(tuple(r) for r in C.component_sections(df, "f", "t").collect() if r["start_line"]) + [tuple(r) for r in C.component_sections(df, "f", "t").collect() if not r["start_line"]]
    assert got == [
        ("e", "script", "javascript", "", 1, 1, 0.9), ("s", "script", "javascript", "let a", 1, 1, 0.9), ("s", "style", "css", "h1 { }", 3, 3, 0.5),
        ("v", "script", "ts", "\nconst a = 1\n", 4, 6, 0.9), ("v", "style", "css", ".a { }", 7, 7, 0.5), ("v", "style", "scss", "\n.b { }", 8, 9, 0.5), ("v", "template", "html", '\n  <div><template v-if="a">x</template></div>\n', 1, 3, 0.8),
        ("s", "template", "html", "<h1>{a}</h1>".join(["\n", "\n"]), None, None, 0.8),
    ]


def test_streamlit_chunks(spark):
    df = spark.createDataFrame([("p", PAGE), ("n", None), ("e", "x = 1")], "f string, t string")
    got = sorted((r["start_line"], r["chunk"], r["name"], r["content"]) for r in C.streamlit_chunks(df, "f", "t").collect())
    assert [x[:3] for x in got] == [(2, "cached", "load"), (5, "page", "main_page"), (6, "widget", "button"), (6, "widget", "button"), (7, "layout", "columns"), (8, "display", "map"), (9, "cached", "old")]
    assert [x[3] for x in got if x[1] == "widget"] == ["st.button('a')", "st.button('b')"]
