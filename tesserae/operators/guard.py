"""Guard rails over requests and answers, as rows (query_id, name, passed, score, threshold, action, stage).

The lexicons and patterns are this library's own.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text as txt
from tesserae.functions.similarity import action_rank, overlap_coefficient
from tesserae.operators import claims

# Thresholds.
LENGTH = (2, 600)
UNSAFE, INJECTION, COVERAGE, GROUNDING, ENTITY_SUPPORT, CONFIDENCE = 0.5, 0.5, 0.34, 0.52, 0.72, 0.30

#: Own lexicons, which callers may replace by larger ones: each phrase that a text has as whole words adds its weight.
UNSAFE_PHRASES = {"build a bomb": 1.0, "make a weapon": 0.8, "kill someone": 1.0, "steal a password": 0.8, "hurt myself": 1.0}
INJECTION_PHRASES = {"ignore previous instructions": 1.0, "ignore all instructions": 1.0, "system prompt": 0.6, "you are now": 0.4, "developer mode": 0.6}
#: Own patterns of personal data.
PII = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "PHONE": r"\+?[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?[ -][0-9]{3,4}[ -]?[0-9]{4}",
    "CARD": r"[0-9]{16}",
}

# What is said where a check is not passed.
MESSAGES = {
    "unsafe": "I can't help with that request. I'm a retrieval assistant over a fixed document corpus and I don't produce harmful content.",
    "injection": "That input looks like an attempt to override my instructions, so I've ignored it. Ask me a question about the indexed corpus instead.",
    "off_topic": "I don't have anything in my corpus that covers this. Rather than guess, I'd rather tell you I don't know.",
    "ungrounded": "I found related passages but none of them actually support a confident answer, so I'm not going to state one.",
    "low_confidence": "The retrieved context is too weak for me to answer confidently. Here is what I did find, so you can judge for yourself.",
    "empty": "I couldn't make out a question. Could you say that again?",
}
#: The message of each check, in the order in which checks of equal actions are told.
MESSAGE_OF = {
    "unsafe": "unsafe", "injection": "injection", "length": "empty", "coverage": "off_topic", "retrieval_floor": "off_topic", "grounding": "ungrounded",
    "entity_support": "ungrounded", "numbers": "ungrounded", "contradiction": "ungrounded", "confidence": "low_confidence",
}


def check(rows: DataFrame, name: str, score: Column, threshold: float, passed: Column, action: str, stage: str) -> DataFrame:
    """One guard check for each row of rows (query_id, ...)."""
    return rows.select(
        "query_id", F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), score.cast("double").alias("score"), F.lit(float(threshold)).alias("threshold"),
        F.when(F.coalesce(passed, F.lit(False)), "allow").otherwise(action).alias("action"), F.lit(stage).alias("stage"),
    )


def length(requests: DataFrame) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))
    return check(requests, "length", n, LENGTH[1], n.between(*LENGTH), "clarify", "input")


class Automaton:
    """An Aho-Corasick automaton over weighted phrases: all that a text has as whole words are found in one pass over it."""

    def __init__(self, phrases: dict[str, float]) -> None:
        import ahocorasick

        self.weights = [float(w) for w in phrases.values()]
        self.sizes = [len(p) for p in phrases]
        self.machine = ahocorasick.Automaton()
        for k, p in enumerate(phrases):
            if p:
                self.machine.add_word(p, k)
        self.machine.make_automaton()

    def score(self, text: str) -> float:
        """The weights of the phrases that text has, each once, at most 1."""
        found = set()
        for end, k in self.machine.iter(text) if len(self.machine) else ():
            if k not in found and not (_in_word(text, end - self.sizes[k], end - self.sizes[k] + 1) or _in_word(text, end, end + 1)):
                found.add(k)
        return min(1.0, sum(self.weights[k] for k in sorted(found)))


def _in_word(text: str, a: int, b: int) -> bool:
    """Whether places a and b = a + 1 are both in the text and of one word."""
    return a >= 0 and b < len(text) and (text[a].isalnum() or text[a] == "_") and (text[b].isalnum() or text[b] == "_")


#: Automata of this process by their phrases; a worker builds one for each lexicon that it meets.
_automata: dict[tuple, Automaton] = {}


def automaton(phrases: dict[str, float]) -> Automaton:
    key = tuple(phrases.items())
    if key not in _automata:
        _automata[key] = Automaton(phrases)
    return _automata[key]


def lexicon_scores(text: Column, phrases: dict[str, float]) -> Column:
    """The score of a text by a lexicon, whose phrases are normalized; null text has 0.

    The lexicon goes with the task, as any setting does; a few megabytes are tens of
    thousands of phrases.
    """

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        machine = automaton(phrases)
        return texts.map(lambda t: machine.score(t) if t else 0.0)

    return scored(txt.normalize(text))


def lexicon_check(requests: DataFrame, name: str, phrases: dict[str, float], threshold: float, action: str = "refuse") -> DataFrame:
    """The check that a request's score by a lexicon is below a threshold."""
    scored = requests.withColumn("_score", lexicon_scores(F.col("text"), phrases))
    return check(scored, name, F.col("_score"), threshold, F.col("_score") < threshold, action, "input")


def unsafe(requests: DataFrame, phrases: dict[str, float] | None = None) -> DataFrame:
    return lexicon_check(requests, "unsafe", UNSAFE_PHRASES if phrases is None else phrases, UNSAFE)


def injection(requests: DataFrame, phrases: dict[str, float] | None = None) -> DataFrame:
    return lexicon_check(requests, "injection", INJECTION_PHRASES if phrases is None else phrases, INJECTION)


def redact_pii(text: Column) -> Column:
    """Personal data replaced by its kind in brackets."""
    return reduce(lambda t, kv: F.regexp_replace(t, kv[1], f"[{kv[0]}]"), PII.items(), text)


def coverage_scores(requests: DataFrame, terms: DataFrame, max_idf: DataFrame) -> DataFrame:
    """(query_id, coverage): of the idf of a query's distinct content tokens the share that the corpus has; terms (term, idf), max_idf one row."""
    words = requests.select("query_id", F.explode_outer(F.array_distinct(txt.content_tokens(F.col("text")))).alias("term"))
    rows = words.join(terms.select("term", "idf"), "term", "left").crossJoin(F.broadcast(max_idf))
    mass = F.when(F.col("term").isNotNull(), F.coalesce("idf", "max_idf")).otherwise(0.0)
    sums = rows.groupBy("query_id").agg(F.sum(mass).alias("total"), F.sum(F.when(F.col("idf").isNotNull(), mass).otherwise(0.0)).alias("covered"))
    return sums.select("query_id", F.when(F.col("total") > 0, F.col("covered") / F.col("total")).otherwise(0.0).alias("coverage"))


def coverage(scores: DataFrame) -> DataFrame:
    return check(scores, "coverage", F.col("coverage"), COVERAGE, F.col("coverage") >= COVERAGE, "abstain", "input")


def grounding(answers: DataFrame) -> DataFrame:
    """answers (query_id, text, context): the share of the answer's stems that the context has."""
    score = overlap_coefficient(txt.stems(F.col("text")), txt.stems(F.col("context")))
    return check(answers, "grounding", score, GROUNDING, score >= GROUNDING, "abstain", "output")


def entity_support(answers: DataFrame) -> DataFrame:
    """The share of the answer's claims that stand in the context; 1 without claims."""
    own = txt.extract_claims(F.col("text"))
    context = F.lower("context")
    found = F.size(F.filter(own, lambda c: F.contains(context, F.lower(c))))
    score = F.when(F.size(own) > 0, found / F.size(own)).otherwise(1.0)
    return check(answers, "entity_support", score, ENTITY_SUPPORT, score >= ENTITY_SUPPORT, "abstain", "output")


def number_check(answers: DataFrame) -> DataFrame:
    """Each number of the answer stands in the context."""
    missing = F.size(F.array_except(txt.extract_numbers(F.col("text")), txt.extract_numbers(F.col("context"))))
    return check(answers, "numbers", missing, 0, missing == 0, "abstain", "output")


def contradiction(answers: DataFrame) -> DataFrame:
    """No clause of the answer is contradicted by claims of the context; the score is the share of clauses that are not, 1 without claims.

    Rows of one query_id are judged as one, and each gets the verdict.
    """
    found = claims.contradicted(claims.conflicts(answers)).withColumnRenamed("query_id", "_of")
    rows = answers.select("query_id").join(found, F.col("query_id").eqNullSafe(F.col("_of")), "left")
    against = F.coalesce("n_contradicted", F.lit(0))
    return check(rows, "contradiction", 1 - F.coalesce(against / F.col("n_clauses"), F.lit(0.0)), 1, against == 0, "clarify", "output")


def confidence(answers: DataFrame) -> DataFrame:
    return check(answers, "confidence", F.col("confidence"), CONFIDENCE, F.col("confidence") >= CONFIDENCE, "abstain", "output")


def retrieval_floor(hits: DataFrame, floor: float = 0.055, margin: float = 0.010) -> DataFrame:
    """The best hit of a query reaches the floor; within margin above it the query is to be clarified."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    rows = check(best, "retrieval_floor", F.col("best"), floor, F.col("best") >= floor + margin, "abstain", "input")
    return rows.withColumn("action", F.when(~F.col("passed") & (F.col("score") >= floor), "clarify").otherwise(F.col("action")))


def tripped(checks: DataFrame) -> DataFrame:
    return checks.filter("not passed")


def verdicts(checks: DataFrame) -> DataFrame:
    """(query_id, action, allowed, n_checks, n_tripped): the strictest action of a query's checks."""
    return checks.groupBy("query_id").agg(
        F.max_by("action", action_rank(F.col("action"))).alias("action"),
        F.count("*").alias("n_checks"),
        F.sum((~F.col("passed")).cast("long")).alias("n_tripped"),
    ).withColumn("allowed", F.col("action") == "allow")


def policy(checks: DataFrame) -> DataFrame:
    """(query_id, action, check, message): the strictest action of a query's checks and what is said of the first check that asks for it; nulls where all are passed.

    Checks are told in the order of MESSAGE_OF; those of other names come last and have no message.
    """
    order = {n: -k for k, n in enumerate(MESSAGE_OF)}
    place = F.coalesce(F.element_at(_literal_map(order), F.col("name")), F.lit(-len(order)))
    strictest = F.max(F.struct(action_rank(F.col("action")).alias("rank"), place.alias("place"), "name", "action")).alias("_x")
    said = F.element_at(_literal_map({n: MESSAGES[m] for n, m in MESSAGE_OF.items()}), F.col("_x.name"))
    told = F.col("_x.action") != "allow"
    return checks.groupBy("query_id").agg(strictest).select("query_id", F.col("_x.action").alias("action"), F.when(told, F.col("_x.name")).alias("check"), F.when(told, said).alias("message"))


def _literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
