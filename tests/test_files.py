"""Rules about files on hand-made sources, with values worked out by hand."""

import pytest

from corpusloom import queries  # noqa: F401  registers the rules
from corpusloom.operators import graph, retrieval
from corpusloom.plans.both import applied
from corpusloom.plans.files import classified

JAVA = """package com.shop.order;
import java.util.List;
import com.shop.model.Order;
@RestController
public class OrderController extends BaseController implements OrderApi {
  @Autowired
  private OrderService orderService;
  private static OrderController instance;
  @GetMapping("/orders/{id}")
  public Order find(String id, int limit) {
    if (limit > 3) { return null; }
    for (int i = 0; i < limit; i++) { log(i); }
    return orderService.findById(id);
  }
}
"""
PYTHON = """import streamlit as st
from flask import Flask
class Item(db.Model):
    pass
@app.route("/items")
def items(st):
    st.button("go")
    st.session_state.cart = 1
    st.session_state.cart = 2
    return st.columns(2)
@app.get("/one")
def one(): pass
"""
REACT = """import React from 'react';
import { a } from '@x/a';
export default function Cart(props) {
  const [n, setN] = useState(0);
  useEffect(() => { load(props.id, props.id, props.name); });
}
"""
FILES = [
    (1, "java", "src/main/java/com/shop/OrderController.java", JAVA),
    (2, "flask", "services/app_test.py", PYTHON),
    (3, "react", "src/components/Cart.tsx", REACT),
    (4, "vue", "config/application.yml", ""),
]


@pytest.fixture(scope="module")
def rules(spark):
    df = spark.createDataFrame(FILES, "file_id long, kind string, file_path string, content string")
    df = classified(df)
    return lambda name: {r["file_id"]: r.asDict() for r in applied(name, df).collect()}


def test_extractors(rules):
    r = rules("import_sources")
    assert r[1]["dependencies"] == "com.shop.model.Order|java.util.List" and r[3]["es_imports"] == "react|@x/a" and r[3]["exports"] == "Cart" and r[2]["imports"] == "flask"
    r = rules("file_annotations")
    assert r[1]["annotations"] == "RestController|Autowired|GetMapping" and r[1]["routes"] == "/orders/{id}" and r[1]["injected"] == "OrderService" and r[2]["decorators"] == "app.route|app.get"
    r = rules("react_metadata")
    assert (r[3]["hooks"], r[3]["props"], r[3]["states"], r[3]["lifecycle"]) == ("useState|useEffect", "id|name", "0", "useEffect")
    r = rules("python_web_metadata")
    assert (r[2]["routes"], r[2]["models"], r[2]["serializers"]) == ("/items|/one", "Item", "")
    r = rules("streamlit_metadata")
    assert (r[2]["widgets"], r[2]["layouts"], r[2]["sessions"]) == ("st.button", "st.columns", "cart")
    r = rules("method_signatures")
    assert (r[1]["methods"], r[1]["return_types"], r[1]["parameters"], r[1]["extends"]) == ("find", "Order", "String id, int limit", "BaseController")


def test_measures(rules):
    r = rules("complexity_estimates")
    assert r[1]["complexity"] == 1 + 1 + 2 and r[1]["block_complexity"] == 1 + 1 + 2 and r[4]["complexity"] == 1
    assert r[1]["lines_of_code"] == len([x for x in JAVA.split("\n") if x.strip()]) and r[1]["efferent"] == 2 and r[1]["abstractness"] == 0
    r = rules("importance_estimates")
    assert r[1]["importance"] == 1.0 and r[4]["importance"] == 0.5 and r[4]["key_importance"] == 0.9 and r[3]["importance"] == 1.0
    r = rules("content_signals")
    assert r[4]["structure"] == 0.5 and r[2]["tests"] == 0.3 and r[1]["structure"] == 1.0


def test_classes(rules):
    r = rules("file_classification")
    assert (r[1]["primary_class"], r[1]["secondary_class"], r[1]["tertiary_class"]) == ("spring-boot", "code", "controller")
    assert r[2]["secondary_class"] == "test" and (r[4]["secondary_class"], r[4]["tertiary_class"]) == ("configuration", "application")
    r = rules("code_patterns")
    assert r[1]["design_patterns"] == "Singleton|Repository|MVC" and r[3]["patterns"] == "useState|useEffect"
    r = rules("file_kinds")
    assert r[1]["is_spring"] and r[3]["is_react"] and r[2]["is_flask"] and not r[4]["is_indexed"]


def test_cohesion_of_a_single_node(spark):
    members = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "cluster string, node int")
    edges = spark.createDataFrame([(2, 3), (1, 2)], "source int, target int")
    got = {r["cluster"]: (r["cohesion"], r["coupling"]) for r in graph.cluster_metrics(members, edges).collect()}
    assert got == {"a": (1.0, 0.5), "b": (1.0, 0.5)}


def test_sparse_and_phrase_scores(spark):
    """Three short documents, scored by hand."""
    docs = spark.createDataFrame([(1, "red fox"), (2, "fox red red"), (3, "")], "id long, text string")
    from pyspark.sql import functions as F

    index = retrieval.term_index(docs, F.filter(F.split("text", " "), lambda x: F.length(x) > 0), "hand-made")
    assert index.size.first().asDict() == {"n": 3, "avgdl": 5 / 3}
    q = spark.createDataFrame([(0, "red"), (0, "fox")], "qid int, term string")
    pairs = spark.createDataFrame([(0, 0, "red", "fox")], "qid int, at int, left string, right string")
    got = {r["id"]: round(r["score"], 6) for r in retrieval.keyword_scores(q, pairs, index).collect()}
    assert got == {1: round(0.5 * (1 + 0.2) + 0.5 * (1 + 0.2 * 0.5) + 0.1, 6), 2: round(2 / 3 * (1 + 0.2 * 0.5) + 1 / 3 * (1 + 0.2), 6)}
    same = retrieval.sparse_cosine(q.withColumn("n", F.lit(1)), index, retrieval.sparse_vectors(index, "hand-made"))
    got = {r["id"]: r["score"] for r in same.collect()}
    assert abs(got[1] - 1) < 1e-9 and 0.9 < got[2] < 1
