"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

``features`` counts words, symbols, repeated lines and repeated windows inside each row. ``thresholds`` takes labelled
good documents as a holdout: for each stratum (``lang``) and measure, the cutoffs of a grid fixed in advance are tested
from the mildest on, and the strictest is taken up to which every one is certified. A cutoff is certified if the exact
binomial probability of so few false rejections, were the true rate ``risk`` / measures, is at most
``error`` / (strata * measures): tests along a grid go in a fixed order and need no further share, strata and measures
get theirs by Bonferroni. With probability 1 - ``error``, no stratum loses more than ``risk`` of its good documents to
the cutoffs. A stratum with too few labels gets no cutoff, and the base rules alone decide there.

The holdout's counts are sums for each stratum, combined before the shuffle; the table of cutoffs has one row for each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
RISK, ERROR = 0.01, 0.05
#: Measures with their cutoffs from mild to strict; a document is rejected above a cutoff. Symbols for each character of
#: a word, characters for each word, and the share of lines that repeat an earlier one.
GRID: dict[str, tuple[float, ...]] = {
    "symbols": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05),
    "long_words": (20.0, 15.0, 12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4),
}
SYMBOLS = "#*$%&|<>"
GAPS = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
#: Strata up to which the cutoffs are sent to all executors; more are joined by a shuffle.
BROADCAST_STRATA = 10_000
#: Rejected documents up to which their ids and keys (16 bytes each) are sent to all executors.
BROADCAST_KEYS = 500_000


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs``, and ``__w`` with the counts of the whole text; a null text has no words."""
    p = "__q_"
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(*keep, text.alias(p + "text"))
    bare = F.translate(p + "text", GAPS, "")
    out = out.select(
        *keep,
        F.filter(F.split(p + "text", SPLIT), lambda x: x != "").alias(p + "words"),
        F.filter(F.split(p + "text", "\n"), lambda x: F.length(F.translate(x, GAPS, "")) > 0).alias(p + "lines"),
        F.length(bare).cast("long").alias(p + "chars"),
        (F.length(p + "text") - F.length(F.translate(p + "text", SYMBOLS, ""))).cast("long").alias(p + "symbols"),
    )
    words = F.col(p + "words")
    windows = F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<long>"))
    rest = [F.col(p + "chars"), F.col(p + "symbols")]
    out = out.select(
        *keep, *rest, F.size(words).cast("long").alias(p + "n"), windows.alias(p + "windows"),
        F.size(p + "lines").cast("long").alias(p + "n_lines"), (F.size(p + "lines") - F.size(F.array_distinct(p + "lines"))).cast("long").alias(p + "dup"),
    )
    rest += [F.col(p + "n"), F.col(p + "n_lines"), F.col(p + "dup")]
    # only texts in which some window repeats go on: windows sorted with their places, then the places of the repeated
    ranked = F.array_sort(F.transform(p + "windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    out = out.select(*keep, *rest, F.when(F.size(F.array_distinct(p + "windows")) < F.size(p + "windows"), ranked).alias(p + "ranked"))
    s = F.col(p + "ranked")
    twice = F.transform(s, lambda e, j: F.when((F.get(s, j - 1)["x"] == e["x"]) | (F.get(s, j + 1)["x"] == e["x"]), e["i"]))
    out = out.select(*keep, *rest, F.array_sort(F.filter(twice, lambda x: x.isNotNull())).alias(p + "places"))
    at = F.col(p + "places")
    # a window covers words up to the next repeated window, five at most
    covered = F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    n, repeated = F.col(p + "n"), F.coalesce(covered, F.lit(0).cast("long"))
    return out.select(*keep, F.struct(n.alias("n_words"), F.col(p + "chars").alias("word_chars"), F.col(p + "symbols").alias("n_symbols"), F.col(p + "dup").alias("n_dup_lines"), repeated.alias("n_repeat_words"), F.col(p + "n_lines").alias("n_lines")).alias("__w"))


def base_failed(w: Column) -> Column:
    return (w["n_words"] < LEAST_WORDS) | (100 * w["n_repeat_words"] > MOST_REPEATED * w["n_words"])


def measure(name: str, w: Column) -> Column:
    top, below = {"symbols": ("n_symbols", "word_chars"), "long_words": ("word_chars", "n_words"), "dup_lines": ("n_dup_lines", "n_lines")}[name]
    return F.coalesce(F.try_divide(w[top].cast("double"), w[below].cast("double")), F.lit(0.0))


def log_binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """The logarithm of P(X <= k) for X binomial (n, rate), summed term by term in logarithms."""
    first = n * math.log1p(-rate)
    step = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        F.struct(F.lit(float("nan")).alias("term"), F.lit(float("nan")).alias("total")),
        lambda acc, i: F.struct(
            F.when(i == 0, first).otherwise(acc["term"] + F.log((n - i + 1).cast("double") / i) + math.log(rate) - math.log1p(-rate)).alias("term"),
            F.when(i == 0, first).otherwise(_log_add(acc["total"], acc["term"] + F.log((n - i + 1).cast("double") / i) + math.log(rate) - math.log1p(-rate))).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return step


def _log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def thresholds(measures: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row for each stratum of ``measures`` (doc_id, lang, __w): lang and a cutoff, or null, for each measure.

    The holdout are the documents that ``labels`` calls good (``quality`` 1 in every label they have) and that the base
    rules leave. Documents without a label, labels without a document and null ids play no part.
    """
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1 and doc_id is not null").select("doc_id")
    held = measures.join(good, "doc_id", "left_semi").where(~base_failed(F.col("__w")))
    w = F.col("__w")
    share = risk / len(GRID)
    counted = held.groupBy("lang").agg(F.count("*").alias("n"), *[F.sum((measure(name, w) > cut).cast("long")).alias(f"{name}_{j}") for name, cuts in GRID.items() for j, cut in enumerate(cuts)])
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(j).alias("j"), F.lit(cut).alias("cut"), F.col(f"{name}_{j}").alias("k")) for name, cuts in GRID.items() for j, cut in enumerate(cuts)]))
    strata = F.count("*").over(Window.partitionBy(F.lit(0)))  # over one row for each stratum
    cells = counted.withColumn("strata", strata).select("lang", "n", "strata", cells.alias("c")).select("lang", "n", "strata", "c.*")
    enough = F.when(F.col("k") > F.col("n") * share, F.lit(False)).otherwise(log_binomial_tail(F.col("k"), F.col("n"), share) <= F.log(F.lit(error) / (F.col("strata") * len(GRID))))
    inorder = Window.partitionBy("lang", "name").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    passed = cells.withColumn("ok", F.min(enough.cast("int")).over(inorder)).where("ok = 1")
    return passed.groupBy("lang").agg(*[F.min(F.when(F.col("name") == name, F.col("cut"))).alias(f"__c_{name}") for name in GRID])


def verdict(measures: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measures`` with ``__failed`` (base rules) and ``__kept``; a stratum without cutoffs keeps what the base keeps."""
    rows = cutoffs.withColumnRenamed("lang", "__c_lang")
    if cutoffs.count() <= BROADCAST_STRATA:
        rows = F.broadcast(rows)
    w = F.col("__w")
    out = measures.join(rows, measures["lang"].eqNullSafe(rows["__c_lang"]), "left")
    above = [F.coalesce(measure(name, w) > F.col(f"__c_{name}"), F.lit(False)) for name in GRID]
    rejected = base_failed(w)
    for x in above:
        rejected = rejected | x
    return out.withColumn("__failed", base_failed(w)).withColumn("__kept", ~rejected).drop("__c_lang", *[f"__c_{name}" for name in GRID])


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, lang, ``__key`` of text and stratum, on which alone a verdict depends, and ``__w``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.xxhash64("text", "lang").alias("__key"))
    return measured(rows, ["doc_id", "lang", "__key"])


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null, empty and blank texts have no words and fail the base rules. Repeated rows are judged each. A null ``lang`` is
    a stratum of its own. Without labels nothing but the base rules decides. An empty table gives no rows.
    """
    found = common.materialize(_narrow(docs), "measures")
    judged = verdict(found, thresholds(found, labels))
    return judged.select("doc_id", *[F.col("__w")[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns and whole texts.

    Null, empty and blank texts go, by the base rules; repeated rows stay or go together; a null ``doc_id`` or ``lang``
    counts as a value. Columns of other names do not matter. Measures are written once, without texts. The ids of rejected
    documents, with a key of text and stratum, are sent to all executors up to ``BROADCAST_KEYS`` of them, so that no text
    is shuffled; more are joined by a shuffle. An empty table gives an empty one.
    """
    found = common.materialize(_narrow(docs), "measures")
    gone = common.materialize(verdict(found, thresholds(found, labels)).where("not __kept").select(F.col("doc_id").alias("__id"), "__key").distinct(), "rejected")
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    return docs.join(gone, (F.xxhash64(docs["text"], docs["lang"]) == gone["__key"]) & docs["doc_id"].cast("long").eqNullSafe(gone["__id"]), "left_anti")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_CELLS = ", ".join(f"('{name}', {j}, {cut})" for name, cuts in GRID.items() for j, cut in enumerate(cuts))
_SHARE = RISK / len(GRID)
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT r, doc_id, lang, t,
    list_filter(regexp_split_to_array(t, '{SPLIT}'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '{SPLIT}', '', 'g')) > 0) AS lines
  FROM d
), win AS (
  SELECT r, i, list_aggregate(words[i : i + {WINDOW - 1}], 'string_agg', ' ') AS w
  FROM s, unnest(range(1, len(words) - {WINDOW - 2})) AS u(i)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, {WINDOW}) AS v(k) GROUP BY r
), f AS (
  SELECT s.r, doc_id, lang, len(words) AS n_words, length(regexp_replace(t, '{SPLIT}', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM s LEFT JOIN covered ON s.r = covered.r
), m AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS symbols,
    CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS long_words,
    CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_lines
  FROM f
), good AS (
  SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
), cell AS (
  SELECT lang, name, j, cut, count(*) AS n,
    count(*) FILTER (CASE name WHEN 'symbols' THEN symbols WHEN 'long_words' THEN long_words ELSE dup_lines END > cut) AS k
  FROM m, (VALUES {_CELLS}) AS g(name, j, cut)
  WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY lang, name, j, cut
), tested AS (
  SELECT lang, name, j, cut, k <= n * {_SHARE} AND (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}) + (n - i) * ln(1 - {_SHARE}))) FROM unnest(range(0, k + 1)) AS q(i)
  ) <= {ERROR} / ((SELECT count(DISTINCT coalesce(lang, '?')) FROM cell) * {len(GRID)}) AS ok
  FROM cell
), cuts AS (
  SELECT lang, name, min(cut) AS cut FROM (SELECT *, bool_and(ok) OVER (PARTITION BY lang, name ORDER BY j) AS all_ok FROM tested) WHERE all_ok GROUP BY lang, name
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR EXISTS (
    SELECT 1 FROM cuts WHERE cuts.lang IS NOT DISTINCT FROM m.lang
      AND CASE name WHEN 'symbols' THEN symbols WHEN 'long_words' THEN long_words ELSE dup_lines END > cut)) AS kept
FROM m
"""
