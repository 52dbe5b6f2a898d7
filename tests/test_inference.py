import pytest
from pyspark.sql import functions as F

from jobledger.operators import inference
from jobledger.operators.quality import validate
from jobledger.sources.reports import read_reports

TEXTS = [
    '{"a": 1, "b": ["x"], "m": {"k1": 1, "k2": 2.5}, "c": {"d": null}, "odd name": true}',
    '{"a": 2.5, "b": [], "m": {"k3": 3, "k4": null}, "c": {"d": "t"}, "l": [{"x": 1}, {"y": [1, 2]}]}',
    '{"a": null, "m": {"k5": 1}, "c": {}, "l": [], "z": {"only": {}}, "both": [1]}',
    '{"both": {"x": 1}}', "no json", None, "{}",
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(t,) for t in TEXTS], "doc string")


def test_types_of_all_documents(docs):
    found = {r.path: (r.type, r.n, r.nulls) for r in inference.type_rows(docs, most_keys=4).collect()}
    assert found == {
        "$": ("struct", 5, 0), "$.a": ("double", 3, 1), "$.b": ("array", 2, 0), "$.b[]": ("string", 1, 0), "$.c": ("struct", 3, 0),
        "$.c.d": ("string", 2, 1), "$.m": ("map", 3, 0), "$.m{}": ("double", 5, 1), "$.odd name": ("boolean", 1, 0), "$.l": ("array", 2, 0),
        "$.l[]": ("struct", 2, 0), "$.l[].x": ("bigint", 1, 0), "$.l[].y": ("array", 1, 0), "$.l[].y[]": ("bigint", 2, 0),
        "$.z": ("struct", 1, 0), "$.z.only": ("struct", 1, 0), "$.both": ("string", 2, 0)}


def test_keys_below_the_limit_are_fields(docs):
    found = {r.path: r.type for r in inference.type_rows(docs, most_keys=5).collect()}
    assert found["$.m"] == "struct" and found["$.m.k2"] == "double" and "$.m{}" not in found


def test_ddl_reads_the_documents(spark, docs, tmp_path):
    tree = inference.infer(docs, most_keys=4)
    docs.where("doc is not null").write.text(str(tmp_path / "d"))
    rows = read_reports(spark, str(tmp_path / "d"), inference.ddl(tree), "json").collect()
    assert sum(r._corrupt is not None for r in rows) == 1
    assert sorted(r.a for r in rows if r.a is not None) == [1.0, 2.5]
    assert {r.both for r in rows} >= {"[1]", '{"x": 1}'} and any(r.m == {"k1": 1.0, "k2": 2.5} for r in rows)


def test_documents_fit_what_was_inferred_from_them(docs):
    schema = inference.validation_schema(inference.infer(docs, most_keys=4))
    fields = {f["name"]: f["type"] for f in schema["fields"]}
    assert fields["m"] == {"type": "map", "values": ["double", "null"]} and fields["b"] == {"type": "array", "items": ["string", "null"]}
    wrong = {r.doc: [e.path for e in r.errors] for r in validate(docs, schema).collect() if r.errors}
    # What is no document; objects in place of text; parts of objects and lists that are missing as a whole.
    assert wrong.pop("no json") == ["/"] and wrong.pop(None) == ["/"]
    assert {p for paths in wrong.values() for p in paths} <= {"/b", "/both", "/l", "/m", "/l/x", "/l/y"}


def test_no_documents(docs):
    assert [tuple(r) for r in inference.type_rows(docs.where("doc = 'no json'")).collect()] == [("$", "null", 0, 0)]


AWKWARD = [
    r'{"a:\"1": "x\"y: 5, false", "b" : "\\\\", "c": [true, false, null, "", 0, -1, 12.5, 1e5, -2E-3, 1.5e+7]}', '"only: 5"', "-7", "2.0", "false", "[]",
    '{"big": 9223372036854775807, "bigger": 9223372036854775808, "at": 999999999999999999, "long": 123456789012345678901234567890123456789012}',
    '{"false": false, "f": "false", "1": 1, "1.5": -0, "n": {"-3": [[1], [2.5, "z"], {}]}}', '{"a": 1, "a": 2}', '{"a": 01}', '{"a": tru}', '{"k": "\u00e9\u20ac"}', "x",
]


def test_a_shape_has_the_kinds_of_its_text(spark):
    """Equal to the kinds of the texts themselves, for marks inside texts and keys, and numbers of any length."""
    rows = spark.createDataFrame([(t,) for t in AWKWARD], "doc string")
    kinds = lambda c: F.schema_of_variant(F.try_parse_json(c))
    for r in rows.select("doc", kinds("doc").alias("own"), kinds(inference.shape(F.col("doc"))).alias("shaped")).collect():
        loose = lambda t: t and t.replace("FLOAT", "DOUBLE").split("DECIMAL")
        if r.own is not None and "DECIMAL" not in r.own and "DECIMAL" not in r.shaped:
            assert loose(r.own) == loose(r.shaped), r.doc
    found = {(r.path, r.kind): r.n for r in inference.value_kinds(rows).collect()}
    assert found["$", "string"] == 1 and found["$", "bigint"] == 1 and found["$", "double"] == 1 and found["$", "struct"] == 4
    assert found["$.c[]", "bigint"] == 2 and found["$.c[]", "double"] == 4 and found["$.c[]", "boolean"] == 2 and found["$.c[]", "string"] == 1
    assert found["$.big", "bigint"] == 1 and found["$.bigger", "double"] == 1 and found["$.at", "bigint"] == 1 and ("$.a", "bigint") not in found


def test_levels_are_read_from_shapes(spark):
    """Many documents of few shapes: what is kept for the levels is a row per shape, not per document."""
    docs = spark.range(3000).select(F.concat(F.lit('{"a": '), "id", F.lit(', "b": ["'), "id", F.lit('", '), F.col("id") / 7, F.lit("]}")).alias("doc"))
    assert docs.select(inference.shape(F.col("doc"))).distinct().count() <= 2
    assert {(r.path, r.type, r.n) for r in inference.type_rows(docs).collect()} >= {("$.a", "bigint", 3000), ("$.b[]", "string", 6000)}
