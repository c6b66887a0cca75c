"""Quality rules: one threshold table, compiled into one Spark projection.

Nulls and odd cases: null and empty texts have no words, so every count is 0,
base_failed is true and kept false.  Rows are judged one by one: repeated rows
are kept or dropped alike, other columns are left as they are, whatever their
names, and the measures are added under the names in COUNTS and RATIOS (a column
of that name is replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.storage import boxed, documents, unboxed
from tesserae.llm.textsql import space_words

#: Frequent words of the languages that are kept.
STOP_WORDS = (
    "the of and to in a is that for it was on are as with by be this or from an at not have "
    "le la les des et du un une en que qui dans pour par sur est au il pas avec ce "
    "der die und den von zu das mit sich auf ist im nicht ein eine als auch es dem "
    "el de y los las con una del se no su al lo como más para o"
).split()
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Threshold:
    """A measure and the range in which a text is kept; both bounds belong to it."""

    measure: str
    least: float | None = None
    most: float | None = None


#: In production use; the ratios are per word, per line or per character as named.
THRESHOLDS = (
    Threshold("n_words", least=50),
    Threshold("repeat_ratio", most=0.5),
    Threshold("mean_word_length", least=2.0, most=20.0),
    Threshold("symbol_ratio", most=0.2),
    Threshold("shout_ratio", most=0.3),
    Threshold("stop_word_ratio", least=0.03),
    Threshold("dup_line_ratio", most=0.6),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word_length", "symbol_ratio", "shout_ratio", "stop_word_ratio", "repeat_ratio", "dup_line_ratio")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def repeat_words(words: Column) -> Column:
    """How many words lie in a three-word window that occurs at least twice.

    Most texts repeat nothing, which the distinct hashes of the windows tell at
    once; in the others the windows are sorted by hash and words, and equal
    neighbours mark three words each.  Linear, but for that sort.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    placed = F.sort_array(
        F.transform(
            starts,
            lambda i: F.struct(
                F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"),
                F.get(words, i).alias("a"),
                F.get(words, i + 1).alias("b"),
                F.get(words, i + 2).alias("c"),
                i.alias("i"),
            ),
        )
    )

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    # the sorted array is bound once, as the element of a one-element array
    twice = F.get(
        F.transform(F.array(placed), lambda p: F.transform(F.filter(p, lambda x, k: same(F.get(p, k - 1), x) | same(F.get(p, k + 1), x)), lambda x: x["i"])),
        F.lit(0),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))
    return F.when(n < 4, 0).when(F.size(F.array_distinct(hashes)) == n - 2, 0).otherwise(covered)


def measured(rows: DataFrame) -> DataFrame:
    """rows, whose texts are in _text, with COUNTS and RATIOS of their texts."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    words = F.col("_words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("_words", space_words(F.col("_text")))
    rows = rows.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
            "_lines": lines,
            "n_repeat_words": repeat_words(words).cast("long"),
            "_shouts": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
            "_stops": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
        }
    )
    rows = rows.withColumns({"_n_lines": F.size("_lines"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    n = F.col("n_words")
    ratios = {
        "mean_word_length": _ratio(F.col("word_chars"), n),
        "symbol_ratio": _ratio(F.col("n_symbols"), n),
        "shout_ratio": _ratio(F.col("_shouts"), n),
        "stop_word_ratio": _ratio(F.col("_stops"), n),
        "repeat_ratio": _ratio(F.col("n_repeat_words"), n),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("_n_lines")),
    }
    return rows.withColumns({r: ratios[r] for r in RATIOS})


def compiled(thresholds: tuple[Threshold, ...]) -> Column:
    """One Boolean expression of a threshold table."""
    tests = F.lit(True)
    for t in thresholds:
        if t.least is not None:
            tests = tests & (F.col(t.measure) >= t.least)
        if t.most is not None:
            tests = tests & (F.col(t.measure) <= t.most)
    return tests


def _verdicts(rows: DataFrame, thresholds: tuple[Threshold, ...]) -> DataFrame:
    n = F.col("n_words")
    rows = measured(rows).withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n))
    return rows.withColumn("kept", ~F.col("base_failed") & compiled(thresholds))


def judged(docs: DataFrame, text_col: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """docs with COUNTS, RATIOS, base_failed and kept.  See the module's text for nulls and repeats."""
    rows = _verdicts(docs.select(boxed(docs.columns), F.col(text_col).alias("_text")), thresholds)
    return unboxed(rows, docs.columns, **{c: c for c in (*COUNTS, *RATIOS, "base_failed", "kept")})


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return judged(docs).select("doc_id", *COUNTS, "base_failed", "kept")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep, with the columns they came with."""
    rows = _verdicts(docs.select(boxed(docs.columns), F.col("text").alias("_text")), THRESHOLDS)
    # a filter on a deterministic column would be pushed below the projections, each measure written out at each use
    rows = rows.withColumn("_stays", F.col("kept") & (F.monotonically_increasing_id() >= 0))
    return unboxed(rows.filter("_stays"), docs.columns)


def oracle_counts(source: str) -> str:
    """DuckDB SQL for the counts of a table with doc_id and text; rows are told apart by rid."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
    src AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {source}),
    w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM src),
    grams AS (SELECT rid, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
    twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
    cover AS (SELECT rid, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY rid),
    m AS (SELECT w.*, len(words) AS nw, length(list_aggregate(words, 'string_agg', '')) AS wc, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS ns,
      len(lines) AS nl, len(lines) - len(list_distinct(lines)) AS nd, coalesce(cover.n, 0) AS nr, length(t) - length(replace(t, '!', '')) AS shouts,
      len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS stops FROM w LEFT JOIN cover USING (rid)),
    judged AS (SELECT *, nw < 50 OR 100 * nr > 50 * nw AS failed FROM m),
    verdict AS (SELECT *, NOT failed AND nw >= 50 AND nr / nw <= 0.5 AND wc / nw >= 2.0 AND wc / nw <= 20.0 AND ns / nw <= 0.2 AND shouts / nw <= 0.3
      AND stops / nw >= 0.03 AND (nl = 0 OR nd / nl <= 0.6) AS keep FROM judged)"""


ORACLE = f"""WITH {oracle_counts('documents')}
SELECT doc_id, CAST(nw AS BIGINT) AS n_words, CAST(coalesce(wc, 0) AS BIGINT) AS word_chars, CAST(ns AS BIGINT) AS n_symbols, CAST(nd AS BIGINT) AS n_dup_lines,
  CAST(nr AS BIGINT) AS n_repeat_words, failed AS base_failed, coalesce(keep, false) AS kept FROM verdict"""
