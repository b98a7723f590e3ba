import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs; extra columns carry names that operators use themselves."""

    def make(rows, extra=False, partitions=3):
        full = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(full, DOCS).repartition(partitions)
        if extra:
            from pyspark.sql import functions as F

            for name in ("length", "rank", "shard", "ahead", "piece", "start", "n_tokens", "kept", "law", "size", "words", "component_id", "local", "sequence_id"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def nasty():
    """Nulls, empty and blank texts, ties, repeats, a very long text, special strings, other scripts."""
    base = [
        (5, None), (1, ""), (2, "   "), (3, "Hello, world! It's 'llama' time."), (4, "<|endoftext|> and <|startoftext|> x"),
        (7, "a\n\nb\tc \r\n d\n e"), (8, "漢字かな交じり文 é́ ﬁ Åé ß İ"), (9, "x" * 3000), (10, "the cat sat on the mat. " * 900),
        (12, "a b c d e f"), (12, "a b c d e f"), (13, "a b c d e f"), (None, "no id here"), (20, "\n"), (21, "#$% #$%"), (22, "foo bar baz"),
    ]
    return base


def by_id(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=lambda x: tuple((y is not None, y) for y in x))
