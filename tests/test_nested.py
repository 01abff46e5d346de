import json

import pytest
from hypothesis import given, settings, strategies as st
from loomwright.operators import nested as N
from loomwright.plans import catalog

ROOT = ["a.b"]
SCHEMA = "report_id bigint, body string, field string, object_path string"


def found(spark, *bodies, schema=SCHEMA):
    df = spark.createDataFrame([(i, b, "x", "y") for i, b in enumerate(bodies)], schema)
    return {(r[0], r[1], r[2]) for r in N.objects(N.record_triples(df, "report_id", "body", ROOT), "report_id").collect()}


def test_positions_parents_and_odd_containers(spark):
    body = json.dumps({"a": {"b": [None, {"x": 1, "c": {"y": 2}}, "no", {"c": [{}, 3, {"d": "[{\"e\": 1}]"}]}]}})
    assert found(spark, body) == {
        (0, "a.b[1]", ""), (0, "a.b[1].c[0]", "a.b[1]"), (0, "a.b[3]", ""), (0, "a.b[3].c[0]", "a.b[3]"), (0, "a.b[3].c[2]", "a.b[3]"), (0, "a.b[3].c[2].d[0]", "a.b[3].c[2]"),
    }
    assert found(spark, json.dumps({"a": {"b": {"x": 1}}})) == {(0, "a.b[0]", "")}
    assert found(spark, json.dumps({"a": {"b": json.dumps([{"x": 1}, {"z": "[low sample]"}])}})) == {(0, "a.b[0]", ""), (0, "a.b[1]", "")}


def test_null_empty_broken_and_other_records_give_nothing(spark):
    assert found(spark, None, "", "  ", "{", '{"a": {"b": [1, "x", null]}}', '{"a": {"b": NaN}}', "[1]", '"x"', '{"a": null}', '{"a": {"b": [{"x": 1}]}} trailing') == set()
    assert spark.createDataFrame([], SCHEMA).transform(lambda d: N.record_triples(d, "report_id", "body", ROOT)).count() == 0


def test_deep_record_is_read_without_recursion(spark):
    n = 30_000
    body = '{"a": {"b": ' + '{"c": [' * n + "{}" + "]}" * n + "}}"
    df = spark.createDataFrame([(1, body)], "report_id bigint, body string")
    assert N.parse_json('{"k": ' + "[" * n + "]" * n + "}") is not None
    assert N._deep('{"a": [1, {"b": "x"}], "c": null}') == {"a": ["1", {"b": "x"}], "c": None}
    for bad in ("{", "[1,]", '{"a":}', "[1 2]", "{} {}", '{"a" 1}', "]"):
        with pytest.raises(ValueError):
            N._deep(bad)
    short = '{"a": {"b": ' + '{"c": [' * 300 + "{}" + "]}" * 300 + "}}"
    assert N.record_triples(spark.createDataFrame([(1, short)], df.schema), "report_id", "body", ROOT).count() == 301


def test_pivot_keeps_fields_and_repeated_rows(spark):
    body = json.dumps({"a": {"b": [{"m": "x", "v": 1.50, "z": True}, {"m": None}]}})
    df = spark.createDataFrame([(1, body), (1, body)], "report_id bigint, body string")
    rows = N.pivot_group(N.record_triples(df, "report_id", "body", ROOT), "report_id", "a.b", ["m", "v"]).orderBy("row_path").collect()
    assert [(r.f_m, r.f_v, [(e.field, e.value) for e in r.extra]) for r in rows] == [("x", "1.50" if rows[0].f_v == "1.50" else "1.5", [("z", "true")]), (None, None, [])]


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("pqr"), x, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(values)
def test_objects_equal_a_plain_recursion(v):
    want = []

    def walk(x, path, parent, one):
        if isinstance(x, list):
            for i, y in enumerate(x):
                walk(y, f"{path}[{i}]", parent, False)
        elif isinstance(x, dict):
            at = path + "[0]" if one else path
            want.append((at, parent))
            for k, y in x.items():
                if isinstance(y, (list, dict)):
                    walk(y, f"{at}.{k}", at, True)

    walk(v, "r", "", True)
    got = [(t[1], t[0]) for t in N.triples(json.loads(json.dumps(v), parse_int=N._Number), "r") if t[6] == "object"]
    assert sorted(got) == sorted(want)
    assert N._deep(json.dumps(v)) == json.loads(json.dumps(v), parse_int=str)


def test_every_object_has_a_row_in_one_flat_table(spark, data):
    tables = {k: f(spark, data) for k, f in catalog.QUERIES.items() if k.startswith("p1_") and k != "p1_found"}
    rows = [(r.report_id, r.row_path, r.parent_path) for t in tables.values() for r in t.select("report_id", "row_path", "parent_path").collect()]
    assert sorted(rows) == sorted((r.report_id, r.child_path, r.parent_path) for r in catalog.QUERIES["p1_found"](spark, data).collect())
    assert len(tables) == 10


def test_flat_table_keeps_values_and_parents(spark, tmp_path):
    body = json.dumps({"scores": {"seo": {"technical": [{"group": "g", "checks": [{"check": "c", "status": "ok", "evidence": [{"selector": "s", "found": 3, "hints": [{"text": "t", "weight": 2}]}]}]}]}}})
    spark.createDataFrame([(7, body)], "report_id bigint, body string").write.parquet(f"{tmp_path}/report_records.parquet")
    r = catalog.QUERIES["p1_technical"](spark, str(tmp_path)).first()
    assert (r.report_id, r.row_path, r.f_group, r.f_check) == (7, "scores.seo.technical[0]", "g", None)
    e = catalog.QUERIES["p1_technical_checks_evidence"](spark, str(tmp_path)).first()
    assert (e.parent_path, e.f_selector, e.f_found) == ("scores.seo.technical[0].checks[0]", "s", "3")
    h = catalog.QUERIES["p1_technical_checks_evidence_hints"](spark, str(tmp_path)).first()
    assert (h.parent_path, h.f_text, h.f_weight) == (e.row_path, "t", "2")
