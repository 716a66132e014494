import re

import pytest
from pyspark.sql import functions as F

from sparkweft.functions import attributes as A


@pytest.mark.parametrize(("metadata", "key", "value"), [
    ('{"a.b":"x","a":{"b":1}}', "a.b", "x"),  # the exact key comes first
    ('{"a":{"b":1}}', "a.b", "1"),
    ('{"a.b":{"c":1},"a":{"b":2}}', "a.b", None),  # an exact key without a value hides the path
    ('{"a":[1]}', "a", None),
    ('{"a":{"b":1}}', "a", None),
    ('{"a":{"b":1}}', "a.", None), ('{"a":{"b":1}}', ".a", None), ('{"a":{"b":1}}', "a..b", None), ('{"a":1}', "", None),
    ('{"a":true}', "a", "true"), ('{"a":1.5}', "a", "1.5"), ('{"a":null}', "a", None), ("not json", "a", None), (None, "a", None),
    ('{"it\'s":"y"}', "it's", "y"),
])
def test_json_attribute(spark, metadata, key, value):
    df = spark.createDataFrame([(metadata,)], "m string")
    assert df.select(A.json_attribute(F.col("m"), key)).first()[0] == value


def test_types_and_names(spark):
    df = spark.createDataFrame([("db:query", "a.b.c", "x/y/z.js"), ("FUNCTION", "f", "z.js")], "t string, n string, f string")
    rows = df.select(A.namespace(F.col("t")), A.base_name(F.col("t")), A.receiver(F.col("n")), A.method(F.col("n")), A.parent_dir(F.col("f")), A.is_endpoint(F.col("t")), A.has_side_effect(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [("db", "query", "a.b", "c", "x/y", True, True), (None, "FUNCTION", None, "f", "", False, False)]


@pytest.mark.parametrize(("glob", "path", "hit"), [("src/**/*.js", "src/a/b.js", True), ("src/**/*.js", "src/b.js", True), ("src/*.js", "src/a/b.js", False), ("*.{ts,js}", "a.ts", True), ("a?.js", "ab.js", True), ("a+b.js", "aab.js", False)])
def test_glob(glob, path, hit):
    assert bool(re.search(A.glob_pattern(glob), path)) is hit


def test_semantic_ids(spark):
    from sparkweft.functions import identity as I
    from sparkweft.operators.guarantees import issues_of

    def fnv(text):
        h = 2166136261
        for b in text.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    texts = ["", "a", "foobar", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(I.fnv1a(F.col("t"))).collect()] == [fnv(t) for t in texts]
    rows = [("f.js", "CALL", "x", None, "a", 1, 0), ("f.js", "CALL", "x", None, "a", 2, 0), ("f.js", "CALL", "x", None, "b", 3, 0), ("f.js", "CALL", "y", "g", "a", 1, 0)]
    nodes = spark.createDataFrame(rows, "file string, node_type string, name string, parent string, hints string, line int, column int")
    a, b = f"{fnv('a') % 65536:04x}", f"{fnv('b') % 65536:04x}"
    ids = [r["semantic_id"] for r in I.semantic_ids(nodes).orderBy("name", "line").collect()]
    assert ids == [f"f.js->CALL->x[h:{a}]", f"f.js->CALL->x[h:{a}]#1", f"f.js->CALL->x[h:{b}]", "f.js->CALL->y[in:g]"]
    parsed = spark.createDataFrame([(i,) for i in [*ids, "plain"]], "id string").select(I.parse_semantic_id(F.col("id")).alias("p")).collect()
    assert tuple(parsed[1]["p"]) == ("f.js", "CALL", "x", None, a, 1) and tuple(parsed[3]["p"]) == ("f.js", "CALL", "y", "g", None, None) and parsed[4]["p"] is None
    assert [r["discriminator"] for r in I.discriminators(nodes, ["file"]).orderBy("name", "line").collect()] == [0, 1, 2, 0]
    assert issues_of(spark.createDataFrame([("ERR_UNRESOLVED_CALL",), ("X",)], "code string"), "calls").count() == 1
