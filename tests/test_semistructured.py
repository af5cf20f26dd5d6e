"""JSON columns: the schema found, values, and bad records."""

import json

import pytest

from plumbline.sources import semistructured as J

GOOD = ['{"a": 1, "b": "x"}', '{"a": "q", "c": null}', "{}", '{"VOID": 1.5, "OBJECT<x": 2, "d e": {"f": [1, 2], "g": {}}}', '{"a": [], "b": "y"}']
BAD = ['{"a":', "", "[1]", "5", '"text"', "null", '{"a": 1, "a": 2}', "{'a': 1}"]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, props string")


def test_found_schema(spark):
    rows = table(spark, [*GOOD, *BAD, None])
    got = J.parsed(rows, "props")
    types = dict(f.split(":", 1) for f in got.select("props_fields.*").schema.simpleString()[7:-1].split(",") if ":" in f)
    assert (types["a"], types["b"], types["c"]) == ("variant", "string", "string")
    assert set(got.select("props_fields.*").columns) == {"a", "b", "c", "VOID", "OBJECT<x", "d e"}
    found = {r.id: r for r in got.selectExpr("id", "props", "props_bad", "props_fields IS NOT NULL AS good", "CAST(props_fields.b AS STRING) AS b", "props_fields.`d e`.f AS f", "to_json(props_fields.a) AS a").collect()}
    for i, text in enumerate([*GOOD, *BAD, None]):
        assert found[i].good == (text in GOOD), text
        assert found[i].props_bad == (text if text in BAD else None)
        if text in GOOD:
            want = json.loads(text)
            assert found[i].b == want.get("b")
            assert found[i].f == want.get("d e", {}).get("f")
            assert (None if found[i].a is None else json.loads(found[i].a)) == want.get("a")


def test_given_schema(spark):
    got = J.parsed(table(spark, ['{"a": "12", "x": 1}', '{"a": "q"}', "{}"]), "props", "struct<a bigint>", prefix="p_").orderBy("id").selectExpr("p_fields.a", "p_bad", "p_fields IS NULL AS none").collect()
    assert [(r.a, r.p_bad, r.none) for r in got] == [(12, None, False), (None, None, False), (None, None, False)]


def test_nothing_found(spark):
    for texts in ([], [None], BAD, ["{}"]):
        rows = table(spark, texts)
        assert J.found_schema(rows, "props") is None
        assert sorted(r.props_bad for r in J.parsed(rows, "props").where("props_bad IS NOT NULL").collect()) == sorted(BAD if texts == BAD else [])
    with pytest.raises(ValueError, match="props_bad"):
        J.parsed(table(spark, []).withColumnRenamed("id", "props_bad"), "props")
