import hashlib
import math

import pytest
from pyspark.sql import functions as F

from walkweave.functions.numbers import float_text, literal_value, to_float
from walkweave.functions.text import fnv_bucket, local_name, ngrams, node_words, predicate_words
from walkweave.functions.tokens import bytes_token, hex_token

PROBES = ["1d", "1f", "1_000", " 1 ", "nan", "NAN", "-nan", "+nan", "inf", "-inf", "INF", "+Infinity", "-infinity", "1e5", "1E-3", "0x10", "+3", ".5", "5.", "1__0", "_1", "1_", ".", "", "e5", "1.5.2", "true", "12abc", "-0", "1e400", "1_0.2_5e1_0"]


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("x"))).collect()]


def test_tokens_are_those_of_python(spark):
    names = [f"name {i}" for i in range(3000)]
    digests = [hashlib.md5(n.encode()).digest()[:8] for n in names]
    assert column(spark, names, bytes_token) == [str(d) for d in digests]
    assert column(spark, names, hex_token) == [d.hex() for d in digests]
    assert any("\"" == str(d)[1] for d in digests)


def test_numbers_are_read_as_python_reads_them(spark):
    for text, got in zip(PROBES, column(spark, PROBES, to_float)):
        try:
            want = float(text)
        except ValueError:
            want = None
        assert got == want or (want is not None and math.isnan(want) and math.isnan(got)), text
    assert column(spark, ["0.5", "x", None], literal_value) == [(0.5, None), (None, "x"), (None, None)]


def test_numbers_are_written_as_python_writes_them(spark):
    numbers = [0.0, -0.0, 1.0, 1e19, 1e16, 1e15, 123456789.125, 1e-4, 1e-5, 1.5e-7, 0.001, 1e7, 12345678.9, -2.5e22, 1e100, float("inf"), float("-inf"), float("nan"), 0.1, 3209.0, 9.999e15]
    assert column(spark, numbers, float_text, "double") == [str(x) for x in numbers]


@pytest.mark.parametrize(
    "name, words",
    [("http://x.org/c#bond3209", ["bond", "3209"]), ("http://dbpedia.org/resource/Belgium", ["http", "dbpedia", "org", "resource", "Belgium"]), ("d19abc", ["d", "19"]), ("***", []), ("10000000000000000000", ["1e+19"]), ("infinity", ["inf"]), ("http://x.org/c#Compound", ["Compound"])],
)
def test_node_words(spark, name, words):
    assert column(spark, [name], node_words) == [words]


def test_predicate_words_and_local_names(spark):
    assert column(spark, ["http://x.org/c#hasBond", "hasBond"], predicate_words) == [["has", "Bond"]] * 2
    assert column(spark, ["http://x.org/c#a", "no#split", "http://x.org"], local_name) == ["a", "no#split", "http://x.org"]
    assert column(spark, ["http://x.org/c#a b", "no#split"], ngrams) == [["http://x.org/c", "a", "b"], ["no#split"]]


def test_hash_is_the_one_on_unbounded_numbers(spark):
    def plain(text, buckets):
        h = 2166136261
        for b in text.encode():
            h = (h ^ b) * 16777619
        return h % buckets

    names = ["hasBond", "", "é", "日本", "a" * 300, *map(str, range(50))]
    for buckets in (2_000_000, 7, 1):
        assert column(spark, names, lambda x: fnv_bucket(x, buckets)) == [plain(n, buckets) for n in names]
    assert plain("hasBond", 2_000_000) == 972510
