"""Column expressions that several native operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.similarity import let as bound
from tesserae.functions.similarity import running_sums

__all__ = ["ascii_lower", "bound", "match_spans", "oracle_crc32", "plain_words", "replaced_matches", "running_sums", "space_words"]

#: Words without white space: [^\x20\x09-\x0D]+
SPACE = r"[\x20\x09-\x0D]+"
#: Separators of lower-cased alphanumeric words, whose words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
PUNCT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Such words before A-Z are lowered.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def space_words(text: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, all else kept."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def plain_words(lowered: Column) -> Column:
    """Alphanumeric words of a lowered text; null has none."""
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), PUNCT), "")


def match_spans(text: Column, pattern: str | Column) -> Column:
    """array<struct<start,end,match>> of the leftmost non-overlapping matches, in code points.

    Spark has no function for the places of matches; they follow from the
    lengths of what lies between matches (split) and of the matches.  The
    pattern must not match the empty string.  Work grows as n log n with the
    number of matches.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def placed(f: Column) -> Column:
        steps = F.zip_with(f, F.slice(gaps, F.lit(1), F.size(f)), lambda m, gap: F.length(m) + gap)
        return F.zip_with(f, running_sums(steps), lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match")))

    return bound(found, placed)


def replaced_matches(text: Column, pattern: str, fits: str, mark: str) -> Column:
    """text with those matches of pattern that fit another regex wholly replaced by mark, in one pass over the matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    put = lambda m: F.when(m.rlike(f"^(?:{fits})$"), F.lit(mark)).otherwise(F.coalesce(m, F.lit("")))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda between, m: F.concat(between, put(m))), "")


def oracle_crc32(name: str, source: str, column: str) -> str:
    """DuckDB CTEs of which the one of this name has (column, crc): the unsigned CRC-32 of each distinct number of source, written in decimal."""
    step = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    return f"""{name}_table AS (SELECT list_transform(range(256), lambda c: list_reduce(range(8), lambda x, k: {step}, c)) AS t),
{name} AS (SELECT {column}, xor(list_reduce(list_transform(range(1, length(v) + 1), lambda i: ascii(substr(v, i, 1))::BIGINT), lambda x, b: xor(x // 256, t[1 + (xor(x, b) & 255)]), 4294967295), 4294967295) AS crc
  FROM (SELECT DISTINCT {column}, CAST({column} AS VARCHAR) AS v FROM {source} WHERE {column} IS NOT NULL), {name}_table)"""
