"""JSON paths over VARIANT."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions.jsonpath import compiled, json_path

TEXT = '{"a": {"b c": [10, 20, {"k": 1}, {"k": null}, {"z": 5}, [7]]}, "n": null, "s": "x", "l": [[1, 2], [3]]}'


@pytest.mark.parametrize("path, value, error", [
    ("$.a['b c'][0]", "10", None), ('$.a["b c"][-1][0]', "7", None), ("$.a['b c'][-7]", None, "Index -7 out of bounds"), ("$.a['b c'][6]", None, "Index 6 out of bounds"),
    ("$.a['b c'][*].k", "[1,null]", None), ("$.l[*]", "[[1,2],[3]]", None), ("$.l[*][1]", "[3]", None), ("$.l[*].q", "[]", None), ("$.n", "null", None), ("$.s", '"x"', None), ("$.s.t", None, "Can't read .t from non-object"),
    ("$.m", None, 'Key "m" not found'), ("$.a[0]", None, "[0] requires array"), ("$.a[*]", None, "[*] requires array"), ("$.l[*].q[0]", None, "Index 0 out of bounds"), ("a", None, "JSONPath must start with $"), ("$a", None, "Couldn't parse JSONPath"), ("$.a[x]", None, "Couldn't parse JSONPath"), ("$.a[", None, "Couldn't parse JSONPath"), (" $.l[1][0] ", "3", None),
])
def test_paths(spark, path, value, error):
    r = spark.createDataFrame([(TEXT,)], "t string").select(json_path(F.col("t"), path).alias("r")).first().r
    assert (r.value, r.error) == (value, error)


def test_texts(spark):
    rows = spark.createDataFrame([("[1]",), ("{",), (None,), ("",), ("3",)], "t string").select(json_path(F.col("t"), "$").alias("r")).collect()
    assert [(r.r.value, r.r.error) for r in rows] == [("[1]", None), (None, "not JSON"), (None, "not JSON"), (None, "not JSON"), ("3", None)]


def test_compiled():
    assert compiled("$.a[0][-1][*]['k.x'].b") == ["a", 0, -1, None, "k.x", "b"] and compiled("$") == [] and compiled("") == [] and compiled("$..a") is None
