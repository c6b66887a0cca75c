"""Periodic runs of words by an online, sparse dynamic program over diagonals.

Word i matches the word q places earlier: that is cell i of diagonal (lag) q, and
a run of period q and length l is a stretch of l - q matches on diagonal q.  A
dense program has a cell for each earlier occurrence of each word, which is
quadratic where a word is common.  Here the words are read once for each width m
= 1, 2, 4, ..., and of a word's earlier occurrences only the latest is kept that
is followed by the same m words, as a cell of its diagonal if the lag is more than m/2
and at most m.  That loses no run: within a run of smallest period q and length
3q or more, m >= q words stand again q places later and nowhere between, since the
period's words are no repetition themselves; and for the same reason no diagonal
that is long enough has a smaller period.  A cell prolongs the match of its
diagonal if the cell before it has the same lag; where that ends, a sufficient
match is emitted as a run at once.

A window of 2m words is two of m words, so windows are named exactly by pairs of
names, without hashes, and only windows whose two halves occur again are named
at all: without repetitions the program ends after a few widths.  Work is
n log n at most, on all texts of a part (2 MB) together; memory follows the part, and
a single longer text is one part.

Nulls and odd cases: a null or empty text has no words, no run and the empty
text; a null id is no reason to change a text.  Repeated rows each give a row.
Runs may overlap; each is returned.  Texts of any length are read whole.  Columns
beyond the text are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.storage import boxed, documents, unboxed
from tesserae.llm.textsql import bound, oracle_crc32, space_words
from tesserae.llm.wordhash import Places, parts, released

#: A run has at least so many words, and at least so many periods (fewer than three would not be found by their windows).
LEAST_WORDS, LEAST_PERIODS = 24, 3
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: Words joined at a time.
JOINED = 1 << 16


def _diagonals(at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, last place, lag) of the stretches of successive places with one lag."""
    if not len(at):
        return at, at, lag
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(lag) != 0)]))
    ends = np.append(begins[1:], len(at)) - 1
    return at[begins], at[ends], lag[begins]


def find_runs(names: np.ndarray, row: np.ndarray, n_rows: int, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of all runs, by first word, then period; names are the words' numbers, row their texts, which stand one after the other."""
    names = names * n_rows + row  # equal names are in one text
    at, width, found = np.arange(len(names)), 1, []
    while len(at):
        order = np.argsort(names, kind="stable")
        place, name = at[order], names[order]
        again = np.flatnonzero(name[1:] == name[:-1])  # the next of a name: its latest earlier occurrence is before it in this order
        lag = place[again + 1] - place[again]
        fits = (2 * lag > width) & (lag <= width)
        cell, lag = place[again + 1][fits], lag[fits]
        order_of_cells = np.argsort(cell)
        first, last, q = _diagonals(cell[order_of_cells], lag[order_of_cells])
        length = last - first + width + q
        long = length >= np.maximum(least_words, least_periods * q)
        found.append((first[long] - q[long], length[long], q[long]))
        # names of twice the width, of windows whose halves occur again
        repeated = np.zeros(len(place), dtype=bool)
        repeated[again] = repeated[again + 1] = True
        fresh = np.cumsum(np.concatenate([[False], name[1:] != name[:-1]]))
        keep = np.sort(order[repeated])
        number = np.empty(len(at), np.int64)
        number[order] = fresh
        at, number = at[keep], number[keep]
        second = np.searchsorted(at, at + width)
        both = np.flatnonzero(second < len(at))
        both = both[at[second[both]] == at[both] + width]
        names = number[both] * (int(fresh[-1]) + 1) + number[second[both]]
        same_text = row[at[both]] == row[at[second[both]]]
        at, names, width = at[both][same_text], names[same_text], 2 * width
    start, length, period = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _with_runs(least_words: int, least_periods: int) -> Callable:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in parts(b, "_text")):
            places = Places(part.column("_text").fill_null(""))
            start, length, period = find_runs(places.numbered()[0], places.row, part.num_rows, least_words, least_periods)
            own = places.row[start]
            edge = np.zeros(len(places.start) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            kept = np.cumsum(edge[:-1]) == 0
            texts = []
            for f, n in zip(places.first.tolist(), places.count.tolist()):
                words = f + np.flatnonzero(kept[f : f + n])
                texts.append(b"".join(places.joined(words[k : k + JOINED]) for k in range(0, len(words), JOINED))[:-1])
            rows = pa.StructArray.from_arrays([pa.array(start - places.first[own]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=part.num_rows))]).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(ends), rows)
            yield pa.RecordBatch.from_arrays([part.column("_box"), pa.array(places.count.astype(np.int64)), runs, pa.array(texts, pa.binary()).cast(pa.string())], names=["_box", "n_words", "runs", "collapsed"])

    return run


def with_runs(docs: DataFrame, text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """docs without its text, with n_words, runs (RUNS, by start, then period) and collapsed: the words that no run repeats, joined by one space.

    A run is a stretch with a smallest period of q words and at least least_words words and
    least_periods * q words that no neighbouring word extends.  Of a run its first q
    words stay.
    """
    if least_periods < 3:
        raise ValueError("a run has at least three periods")
    own = [c for c in docs.columns if c != text_col]
    rows = docs.select(boxed(own), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([rows.schema["_box"], *T._parse_datatype_string(f"n_words long, runs {RUNS}, collapsed string").fields])
    return unboxed(rows.mapInArrow(_with_runs(least_words, least_periods), schema), own, n_words="n_words", runs="runs", collapsed="collapsed")


def looped(text: Column, doc_id: Column) -> Column:
    """The text, of every tenth id (by its CRC-32) with all words from a place on replaced by repetitions of the first ones there."""
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        period = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        at = lambda i: F.when(i >= a, a + F.pmod(i - a, period)).otherwise(i).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i))), " "))

    return F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(bound(space_words(text), repeated), text)).otherwise(text)


def strongest(runs: Column) -> Column:
    """The run with the most periods, of several the first: compared by products, so exactly."""
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, b: F.when(better(a, b), b).otherwise(a))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text"))
    rows = with_runs(docs).withColumn("best", strongest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE = f"""WITH {oracle_crc32('crc_of', 'documents', 'doc_id')},
src AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
plan AS (SELECT rid, s.doc_id, ws, len(ws) AS n, crc AS h, crc // 10 AS g FROM src s LEFT JOIN crc_of c ON c.doc_id = s.doc_id),
cut AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM plan),
per AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
w AS (SELECT rid, i, ws[1 + CASE WHEN coalesce(h % 10, 1) = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS w FROM (SELECT *, unnest(range(0, n)) AS i FROM per)),
cell AS (SELECT x.rid, x.i, x.i - y.i AS q FROM w x JOIN w y ON x.rid = y.rid AND x.w = y.w AND y.i < x.i),
stretch AS (SELECT rid, q, min(i) - q AS s, count(*) + q AS l FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS grp FROM cell) GROUP BY rid, q, grp),
long AS (SELECT * FROM stretch WHERE l >= greatest({LEAST_WORDS}, {LEAST_PERIODS} * q)),
runs AS (SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.rid = x.rid AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (rid, i) GROUP BY rid),
best AS (SELECT rid, s, l, q FROM runs x WHERE NOT EXISTS (SELECT 1 FROM runs y WHERE y.rid = x.rid AND (y.l * x.q > x.l * y.q OR (y.l * x.q = x.l * y.q AND (y.s, y.q) < (x.s, x.q))))),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY rid)
SELECT src.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
  CAST(1000 * l // q AS BIGINT) AS exponent_milli, sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM src LEFT JOIN best USING (rid) LEFT JOIN listed USING (rid) LEFT JOIN kept USING (rid)"""
