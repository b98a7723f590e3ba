"""Quality rules against SQL and brute force, the binomial test, and the pipeline against a plain version of it."""

import glob
import math
import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from docloom.llm import op10_quality_rules as quality
from docloom.llm.op6_secret_scan import mask, scanner

from .conftest import DOCS, by_id
from .test_similar import brute, planted
from .test_tokens import WORD, crc

GAP = re.compile("[\x20\x09-\x0d]+")


def features(text):
    text = text or ""
    words = [w for w in GAP.split(text) if w]
    lines = [x for x in text.split("\n") if GAP.sub("", x)]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    return out | {"base_failed": len(words) < 10 or 100 * len(covered) > 20 * len(words)}


NAMES = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_features(spark, make_docs, nasty):
    rows = [*nasty, (50, "one two three four five " * 5 + "\n\none two\none two\n"), (51, " ".join(map(str, range(40)))), (52, "a " * 30), (53, "é\x0bß\x0c* x\n* x\n \n")]
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (99, 1, 0), (51, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(make_docs(rows, extra=True), labels).collect()
    want = [{"doc_id": i} | features(t) for i, t in rows]
    assert by_id(got, *NAMES) == by_id(want, *NAMES)
    assert all(r.kept == (not r.base_failed) for r in got)  # too few labels for a cutoff
    assert quality.quality(make_docs([]), labels).count() == 0


def test_cutoffs_come_from_enough_good_labels(spark):
    good = [(i, "en", " ".join(f"word{i}{j}" for j in range(20))) for i in range(3000)]
    junk = [(i, "en", " ".join(f"w{i}{j}###" for j in range(20))) for i in range(3000, 3100)]
    other = [(i, None, " ".join(f"w{i}{j}###" for j in range(20))) for i in range(3100, 3110)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, lang, t in good + junk + other], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good] + [(i, 0, 0) for i, _, _ in junk] + [(0, 1, 1)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.quality(docs, labels).collect()}
    assert all(kept[i] for i, _, _ in good)
    assert not any(kept[i] for i, _, _ in junk)
    assert all(kept[i] for i, _, _ in other)  # a stratum without labels


def test_binomial_tail(spark):
    cases = [(0, 10), (3, 50), (7, 2000), (10, 2000), (50, 20000)]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("x", quality.log_binomial_tail(F.col("k"), F.col("n"), 0.005))
    for r in df.collect():
        logs = [math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.005) + (r.n - i) * math.log(0.995) for i in range(r.k + 1)]
        top = max(logs)
        assert r.x == pytest.approx(top + math.log(sum(math.exp(x - top) for x in logs)), abs=1e-8)


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    rel = con.execute(quality.ORACLE)
    names = [c[0] for c in rel.description]
    want = [dict(zip(names, r, strict=True)) for r in rel.fetchall()]
    assert by_id(quality.op10_quality_rules(spark, sf_dir).collect(), *names) == by_id(want, *names)


def test_pipeline(spark, tmp_path):
    long = [(i, t) for i, t in planted(4)[:90]]
    rows = [*long, (500, None), (501, "short"), (502, " ".join(f"w{i}" for i in range(30)) + " token = 'abcdefghijklmnop' end"), (503, "the cat sat on the mat " * 40), (504, " ".join(f"v{i}" for i in range(9000)))]
    spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])).write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [(i, t) for i, t in rows if not features(t)["base_failed"]]
    left = [(i, t) for (i, t), b in zip(left, brute(left, 5), strict=True) if b["k"]]
    want = []
    for i, t in left:
        ids = [*WORD.encode(mask(t, scanner().spans(corpus_pipeline.common.pa.array([t]))[0]), add_special_tokens=False).ids, 0]
        want += [{"i": i, "p": p // 2048, "l": len(ids[p : p + 2048]), "c": crc(ids[p : p + 2048])} for p in range(0, len(ids), 2048)]
    assert by_id(got, "doc_id", "piece", "length", "ids_crc32") == by_id(want, "i", "p", "l", "c")
    assert {502, 504} <= {r.doc_id for r in got} and not {500, 501, 503} & {r.doc_id for r in got}


def hard(nasty):
    """Rows for every stage: ``nasty``, repeated rows, a long text with near copies and secrets, and a tie."""
    long = [f"w{i}" for i in range(4000)]
    near = [*long[:2000], "other", *long[2001:]]
    return [*nasty, (40, " ".join(long)), (41, " ".join(near)), (41, " ".join(near)), (42, "token = 'abcdefghijklmnop' " + " ".join(f"u{i}" for i in range(20))), (43, " ".join(long)), (None, " ".join(long))]


@pytest.fixture
def frame(spark):
    """Documents with columns whose names operators use themselves."""

    def make(rows):
        full = [(i, t, "en", "s", len(t) if t is not None else None, "x", 7) for i, t in rows]
        return spark.createDataFrame(full, T.StructType([*DOCS.fields, T.StructField("node", T.StringType()), T.StructField("__q_text", T.IntegerType())])).repartition(3)

    return make


def key(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))


@pytest.fixture
def sf(spark, tmp_path):
    """A folder with empty labels."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("case", ["hard", "empty"])
def test_stages_on_hard_rows(spark, frame, nasty, sf, case):
    rows = hard(nasty) if case == "hard" else []
    docs = frame(rows)
    stages = dict(corpus_pipeline.STAGES)
    out = {}
    for name in ("quality", "near_dedup", "secrets"):
        out[name] = stages[name](spark, docs, sf)
        assert out[name].schema == docs.schema, name
    as_rows = lambda kept: sorted(kept, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    assert key(out["quality"].collect()) == as_rows([(i, t) for i, t in rows if not features(t)["base_failed"]])
    named = [r for r in rows if r[0] is not None]
    gone = {b["i"] for b in brute(named, 5) if not b["k"]}
    gone -= {b["i"] for b in brute(named, 5) if b["k"]}
    assert key(out["near_dedup"].collect()) == as_rows([(i, t) for i, t in rows if i not in gone])
    masked = [(i, t if t is None else mask(t, scanner().spans(corpus_pipeline.common.pa.array([t]))[0])) for i, t in rows]
    assert key(out["secrets"].collect()) == as_rows(masked)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in out["secrets"].collect())
    pieces = stages["packing"](spark, docs, sf).collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(i for i, _ in rows)


def test_quality_drops_by_document_not_by_text_alone(spark, sf, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_KEYS", -1)  # the join by a shuffle
    good = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, good, "en"), (2, "short", "en"), (None, "short", None), (None, good, None), (3, None, None)], "doc_id long, text string, lang string")
    got = corpus_pipeline.quality(spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, good), (1, good)]


def test_run_on_an_empty_table_and_on_repeated_rows(spark, sf, make_docs):
    text = " ".join(f"w{i}" for i in range(50))
    make_docs([(1, text), (1, text), (2, text + " more"), (3, None)], extra=True).write.parquet(f"{sf}/documents.parquet")
    assert sorted((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, sf).collect()) == [(1, 0), (1, 0)]
    make_docs([], extra=True).write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
