import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

SENTENCE = "The quick brown fox jumps over the lazy dog near the old river bank while seven small birds watch it from a tall tree and sing"


@pytest.fixture
def table(spark):
    def make(rows, schema=SCHEMA):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def odd(table):
    """Nulls, empty and long texts, ties, repeated rows, other white space and letters."""
    return table([
        (1, SENTENCE, "en", "a", 1),
        (2, SENTENCE, "en", "a", 1),
        (2, SENTENCE, "en", "a", 1),
        (3, SENTENCE.replace("seven", "eight"), "en", "b", 1),
        (4, "", "en", "b", 0),
        (5, None, None, None, None),
        (None, "no id at all", "en", None, 3),
        (None, None, None, None, None),
        (7, " \t\n\x0b\x0c\r ", "en", "c", 7),
        (8, "word " * 20_000, "en", "c", 100_000),
        (9, "x" * 60_000, "en", "c", 60_000),
        (10, "Ünïcode Wörds\x1c中文 😀 İ ΑΣ Σ <|endoftext|> <b>", "xx", "c", 9),
    ])


@pytest.fixture
def clashing(odd):
    """The odd rows with columns that operators might use themselves."""
    from pyspark.sql import functions as F

    names = ["row", "size", "hash", "score", "fingerprint", "ids", "decoded", "copies", "copy", "source_size", "target", "full", "plan_source", "component_id", "whole", "k", "none", "tie", "bucket", "ghost", "own", "kind", "chosen", "h", "left", "below", "nth"]
    return odd.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture
def empty(table):
    return table([])


@pytest.fixture
def marks(table):
    def make(rows):
        return table(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())]))

    return make
