"""Secret scans over a trigram inverted index, in DataFrame operations only.

From each rule's regex a Boolean trigram query is derived; the index holds
postings (trigram, document) for the trigrams of these queries; intersecting and
uniting postings gives the candidates of each rule, whose texts are verified
with the regex.  Rules without mandatory trigrams scan every text.

Nulls and odd cases: a null or empty text has no spans.  Each input row gives
one row, repeated rows too (rows are joined by id and a hash of id and text); a
null id stays null.  Other columns keep their values, whatever their names; only the
columns that are added take the place of columns of their names.  Texts are never cut.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as _op
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.storage import documents, restricted, sealed, small, stored, unboxed, with_row_key
from tesserae.llm.textsql import match_spans, replaced_matches


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex (same meaning in Java, Python and RE2), and a regex that a match must fit wholly, if any."""

    kind: str
    pattern: str
    fits: str | None = None


#: Fixed values.  The first three in this order are the base kinds; the others are the method's own.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i)[^:=]*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""),
    # runs are matched as long as they are, so leaving out short ones changes no other match
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
OWN_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%+!-]+@"),
)
RULES = BASE_RULES + OWN_RULES


# --- trigram queries -------------------------------------------------------------------------------------------------

#: A literal set of more strings than this is given up, and the trigrams so far are kept.
MOST_LITERALS = 64


def _exact(node: tuple) -> set[str] | None:
    """The strings that a piece of a regex matches, if they are few."""
    kind, arg = node
    if kind is _op.LITERAL:
        return {chr(arg).lower()}
    if kind is _op.IN:
        found: set[str] = set()
        for k, v in arg:
            if k is _op.LITERAL:
                found.add(chr(v).lower())
            elif k is _op.RANGE and v[1] - v[0] < 4:
                found |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if kind is _op.SUBPATTERN:
        return _exact_all(arg[-1])
    if kind is _op.BRANCH:
        parts = [_exact_all(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if kind is _op.MAX_REPEAT and arg[1] is not _op.MAXREPEAT and arg[1] <= 2:
        inner = _exact_all(arg[2])
        return None if inner is None else set().union(*({a * n for a in inner} for n in range(arg[0], arg[1] + 1)))
    return None


def _exact_all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        got = _exact(node)
        if got is None or len(out) * len(got) > MOST_LITERALS:
            return None
        out = {a + b for a in out for b in got}
    return out


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """A conjunction of clauses, each a disjunction of conjunctions of lower-cased trigrams; empty: no mandatory trigram."""
    clauses: list[list[list[str]]] = []

    def flush(strings: set[str]) -> None:
        least = {s for s in strings if not any(o != s and o in s for o in strings)}
        if least and min(map(len, least)) >= 3:
            clauses.append(sorted(sorted({s[i : i + 3] for i in range(len(s) - 2)}) for s in least))

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            got = _exact(node)
            if got is not None and len(run) * len(got) <= MOST_LITERALS:
                run = {a + b for a in run for b in got}
                continue
            flush(run)
            run = {""}
            if got is not None:
                run = got
            elif node[0] is _op.SUBPATTERN:
                walk(node[1][-1])
            elif node[0] is _op.MAX_REPEAT and node[1][0] >= 1:
                walk(node[1][2])
        flush(run)

    walk(_parser.parse(pattern))
    return clauses


# --- index and candidates --------------------------------------------------------------------------------------------


def query_terms(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """(rule, clause, alternative, trigram, n_trigrams, n_clauses): as many rows as the rules' trigrams."""
    rows = []
    for r, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        for c, clause in enumerate(query):
            for a, grams in enumerate(clause):
                rows += [(r, c, a, g, len(grams), len(query)) for g in grams]
    return spark.createDataFrame(rows, "rule int, clause int, alternative int, trigram string, n_trigrams int, n_clauses int")


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index, restricted to the given trigrams: (trigram, _id, _key) for each document that has it.

    Texts are lowered as a whole: that never takes an ASCII trigram away, and
    what it may add, verification removes.
    """
    lowered = keyed.select("_id", "_key", F.lower("_text").alias("_low"))
    found = F.array_compact(F.array(*(F.when(F.contains(F.col("_low"), F.lit(g)), F.lit(g)) for g in trigrams)))
    # of an inner explode the optimizer would derive a filter that looks for all trigrams a second time
    return lowered.select("_id", "_key", F.explode_outer(found).alias("trigram")).filter(F.col("trigram").isNotNull())


def candidates(keyed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(_id, _key, rules): the rules whose trigram query a document of keyed (_id, _key, _text) fulfils.

    The index is stored, so that its postings are made once and the queries read
    them by trigram.  All postings of a document come from one part of it, so
    each intersection is nearly done before its shuffle.
    """
    terms = query_terms(keyed.sparkSession, rules)
    grams = sorted({r["trigram"] for r in terms.select("trigram").distinct().collect()})  # the rules' own, not the data's
    index = stored(postings(keyed, grams), "trigram-index")
    hits = index.join(F.broadcast(terms), "trigram")
    met = (
        hits.groupBy("_id", "_key", "rule", "clause", "alternative", "n_trigrams", "n_clauses")
        .agg(F.count_distinct("trigram").alias("n"))
        .filter("n = n_trigrams")
    )
    return (
        met.groupBy("_id", "_key", "rule", "n_clauses")
        .agg(F.count_distinct("clause").alias("n"))
        .filter("n = n_clauses")
        .groupBy("_id", "_key")
        .agg(F.collect_set("rule").alias("rules"))
    )


def _spans(text: Column, rule: Rule) -> Column:
    spans = match_spans(text, rule.pattern)
    fits = F.filter(spans, lambda s: s["match"].rlike(f"^(?:{rule.fits})$")) if rule.fits else spans
    return F.transform(fits, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


NO_SPANS = "cast(array() as array<struct<start:int,end:int>>)"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs without their text, with spans_<kind> for each rule: array<struct<start,end>> in code points.

    Full-scan rules are evaluated on every row.  The texts of the candidates of
    the other rules are picked out by their keys (restricted) and verified, and
    only spans are joined back to the rows.
    """
    keyed = with_row_key(docs, text_col=text_col)
    full = [r for r in rules if not trigram_query(r.pattern)]
    gated = [(i, r) for i, r in enumerate(rules) if trigram_query(r.pattern)]
    found = stored(candidates(keyed, rules), "secret-candidates")
    texts = restricted(keyed, found, ["_id", "_key"]).dropDuplicates(["_id", "_key"])
    verified = texts.join(found, ["_id", "_key"]).select(
        "_id", "_key", *(F.when(F.array_contains("rules", i), _spans(F.col("_text"), r)).otherwise(F.expr(NO_SPANS)).alias(f"spans_{r.kind}") for i, r in gated)
    )
    # verified once, however often the filter and the join look at it
    verified = stored(verified, "secret-spans")
    some = reduce(lambda a, b: a | b, [F.size(f"spans_{r.kind}") > 0 for _, r in gated])
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = sealed(docs, text_col=text_col)
    whole = rows.select("_box", "_id", "_key", *(F.when(text.rlike(_first_look(r)), _spans(text, r)).otherwise(F.expr(NO_SPANS)).alias(f"spans_{r.kind}") for r in full))
    joined = whole.join(verified.filter(some), ["_id", "_key"], "left")
    return unboxed(joined, [c for c in docs.columns if c != text_col], **{f"spans_{r.kind}": F.coalesce(f"spans_{r.kind}", F.expr(NO_SPANS)) for r in rules})


def _first_look(rule: Rule) -> str:
    """A regex that every text with a match matches: of a run its least length."""
    return re.sub(r"\{(\d+),\}$", r"{\1}", rule.pattern)


def _listed(rules: tuple[Rule, ...]) -> Column:
    """kind:start:end by start, then the rules' order, comma-joined."""

    def of(k: int, kind: str) -> Column:
        return F.transform(f"spans_{kind}", lambda s: F.struct(s["start"].alias("s"), F.lit(k).alias("k"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("x")))

    each = F.concat(*(of(k, r.kind) for k, r in enumerate(rules)))
    return F.array_join(F.transform(F.sort_array(each), lambda s: s["x"]), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return scan(docs).select(
        "doc_id",
        *(F.size(f"spans_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in BASE_RULES),
        F.sha2(_listed(BASE_RULES), 256).alias("base_sha256"),
        _listed(RULES).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "<SECRET>", rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with every found secret replaced by mark; texts without secrets stay as they are, nulls stay null.

    A match that a rule drops as too short is left, and the rules follow each
    other, so that what one has replaced the next does not see.
    """
    found = stored(candidates(with_row_key(docs, text_col=text_col), rules), "secret-candidates")
    gated = {i for i, r in enumerate(rules) if trigram_query(r.pattern)}
    out = sealed(docs, text_col=text_col).join(small(found.select("_id", "_key", F.expr("array_sort(rules)").alias("rules"))), ["_id", "_key"], "left")
    text = F.col("_text")
    for i, r in enumerate(rules):
        looked = F.coalesce(F.array_contains("rules", i), F.lit(False)) if i in gated else F.coalesce(text.rlike(_first_look(r)), F.lit(False))
        cut = replaced_matches(text, r.pattern, r.fits, mark) if r.fits else F.regexp_replace(text, r.pattern, mark)
        out = out.withColumn("_text", F.when(looked, cut).otherwise(text))
    return unboxed(out, docs.columns, **{text_col: "_text"}).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, their secrets replaced by <SECRET> and n_chars counted anew where there is such a column."""
    own = redacted(docs)
    if "n_chars" not in docs.columns:
        return own
    counted = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return own.withColumn("n_chars", counted).select(*docs.columns)


def _duck_spans(k: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    fits = f"AND regexp_full_match(m, '{rule.fits.replace(chr(39), chr(39) * 2)}')" if rule.fits else ""
    return f"""SELECT rid, {k} AS k, '{rule.kind}' AS kind, s, e FROM (
      SELECT rid, m, before + list_sum(prev) AS s, before + list_sum(prev) + length(m) AS e FROM (
        SELECT rid, ms[i] AS m, list_sum(list_transform(gaps[1:i], lambda x: length(x))) AS before, list_transform(ms[1:i-1], lambda x: length(x)) || [0] AS prev
        FROM (SELECT rid, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
          SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM src WHERE regexp_matches(t, '{pattern}'))))) WHERE true {fits}"""


def _oracle() -> str:
    """The same spans in DuckDB, every rule over every text."""
    spans = " UNION ALL ".join(_duck_spans(k, r) for k, r in enumerate(RULES))
    listed = "coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k)"
    return f"""WITH src AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), found AS ({spans}),
    per AS (SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
      {listed} FILTER (k < 3), '') AS base, {listed}, '') AS every FROM found GROUP BY rid)
    SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM src LEFT JOIN per USING (rid)"""


ORACLE = _oracle()
