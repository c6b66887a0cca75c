"""Claims of answers held against claims of what they were drawn from: by entity, polarity and quantity.

A claim is a word or a number of a clause, said of the clause's subject.  Words
carry the polarity that negations before them in the clause give them (an even
number of negations is none); numbers are brought to one unit for each
dimension.  Claims of both sides meet under (subject, word) and (subject,
dimension): in the row that has both texts, or, where several rows have one
query_id, by aggregation and by one sort for each key, so that no two lists of
claims are multiplied with each other, however long the texts.

The rules and tables are this library's own.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions import text as txt
from tesserae.sources.tables import stored

#: Words that negate what follows in their clause, and words that negate what stands before them; a token that ends in n't does the first.
NEGATIONS = ("not", "no", "never", "none", "nor", "neither", "cannot", "without", "नहीं")
NEGATIONS_AFTER = ("না", "இல்லை", "లేదు")
#: Words that begin a sentence about the subject of the sentence before.
PRONOUNS = ("it", "its", "he", "his", "she", "her", "they", "their", "this", "these")
#: Words before a name that is not what its sentence is about, and before a number that counts nothing, as a year.
PREPOSITIONS = ("in", "on", "at", "by", "since", "until", "from", "to", "with", "before", "after")
#: Each unit's dimension, and what a number of it is multiplied with (after an offset is taken off) to be in the dimension's own unit.
MEASURES = {
    "mm": ("length", 0.001, 0.0), "cm": ("length", 0.01, 0.0), "m": ("length", 1.0, 0.0), "km": ("length", 1000.0, 0.0), "ft": ("length", 0.3048, 0.0), "mi": ("length", 1609.344, 0.0),
    "metre": ("length", 1.0, 0.0), "meter": ("length", 1.0, 0.0), "kilometre": ("length", 1000.0, 0.0), "kilometer": ("length", 1000.0, 0.0), "feet": ("length", 0.3048, 0.0), "mile": ("length", 1609.344, 0.0),
    "kilogram": ("mass", 1.0, 0.0), "pound": ("mass", 0.45359237, 0.0), "kg": ("mass", 1.0, 0.0), "lb": ("mass", 0.45359237, 0.0),
    "kb": ("data", 1e3, 0.0), "mb": ("data", 1e6, 0.0), "gb": ("data", 1e9, 0.0), "tb": ("data", 1e12, 0.0),
    "hz": ("frequency", 1.0, 0.0), "khz": ("frequency", 1e3, 0.0), "mhz": ("frequency", 1e6, 0.0), "ghz": ("frequency", 1e9, 0.0),
    "celsius": ("temperature", 1.0, 0.0), "fahrenheit": ("temperature", 1 / 1.8, 32.0),
    "percent": ("share", 1.0, 0.0),
    "second": ("time", 1.0, 0.0), "minute": ("time", 60.0, 0.0), "hour": ("time", 3600.0, 0.0), "day": ("time", 86400.0, 0.0), "month": ("age", 1.0, 0.0), "year": ("age", 12.0, 0.0),
}
#: Words that multiply the number before them; what is counted follows.
SCALES = {"thousand": 1e3, "lakh": 1e5, "million": 1e6, "crore": 1e7, "billion": 1e9, "trillion": 1e12}
#: Two quantities are the same when they differ by at most this share of the larger one; numbers without a unit or a scale must be equal.
TOLERANCE = 0.005

_CLAUSE = re.compile(r"[;:()]|,(?!\d)|\b(?:but|although|though|because|while|whereas|however|and)\b", re.I)
_THOUSANDS = re.compile(r",(?<=\d,)(?=\d{3}(?!\d))")
_PERCENT, _DEGREES = re.compile(r"%|\bper cent\b", re.I), ((re.compile(r"°\s?c(?!\w)", re.I), " celsius "), (re.compile(r"°\s?f(?!\w)", re.I), " fahrenheit "))
_GLUED = re.compile(r"(\d)(?=[^\W\d_])")
_NAME = re.compile(r"[A-Z][a-z]{2,}")
_WORD = re.compile(r"\d+(?:\.\d+)?|[^\W\d_][\w\u0900-\u0DFF]*(?:[-'][\w\u0900-\u0DFF]+)*")
_PLURAL = re.compile(r"(second|minute|hour|day|month|year|met(?:re|er)|kilomet(?:re|er)|mile|kilogram|pound)s")
_STOP = frozenset(txt.STOPWORDS)


def _plain(text: str) -> str:
    """A text in which thousands and units are spelled one way."""
    if text.isascii():
        text = text.replace("`", "'")
    else:
        text = unicodedata.normalize("NFKC", text)
        text = text.translate(txt._FOLDS) if txt._NEEDS_FOLD(text) else text
    text = _THOUSANDS.sub("", text)
    if "%" in text or "cent" in text.lower():
        text = _PERCENT.sub(" percent ", text)
    if "°" in text:
        for pattern, spelling in _DEGREES:
            text = pattern.sub(spelling, text)
    return _GLUED.sub(r"\1 ", text)


def _negates(word: str) -> bool:
    return word in NEGATIONS or word.endswith("n't")


def _has_content(word: str) -> bool:
    return len(word) > 1 and word not in _STOP and not word[0].isdecimal() and not _negates(word) and word not in NEGATIONS_AFTER


#: What a word is to a clause.
NOTHING, CONTENT, NEGATES, NEGATES_BEFORE, NUMBER = range(5)


class _Kinds(dict):
    """Words in lower case by what they are to a clause, each looked at once."""

    def __missing__(self, word: str) -> int:
        kind = NUMBER if word[0].isdecimal() else NEGATES if _negates(word) else NEGATES_BEFORE if word in NEGATIONS_AFTER else CONTENT if _has_content(word) else NOTHING
        self[word] = kind
        return kind


class _Stems(dict):
    """Words by their stems, each made once."""

    def __missing__(self, word: str) -> str:
        self[word] = out = txt.stem_of(word)
        return out


#: Words that a process remembers; and characters of sentences whose claims it does, so that an answer that quotes its context is read once.
REMEMBERED, HELD = 1 << 18, 1 << 20
_kinds, _stems = _Kinds(), _Stems()


def _subject(sentence: str, before: str) -> str:
    """The last word of a sentence's first name without a preposition, else its first word with content; the one before where the sentence begins with a pronoun or has neither."""
    name, end, word, first, named = "", 0, "", "", _NAME.search(sentence)
    for m in _WORD.finditer(sentence):
        before_it, own = word, m.group()
        word = own.lower()
        if not before_it and word in PRONOUNS:
            return before
        if not first and _kinds[word] == CONTENT:
            first = word
            if not named:
                break
        # a name goes on with its next word or ends
        if not _NAME.fullmatch(own) or word in _STOP:
            if name:
                break
            continue
        if name and sentence[end : m.start()].strip():
            break
        if name or before_it not in PREPOSITIONS:
            name, end = word, m.end()
    return name or first or before


def _clause_claims(words: list[str]) -> tuple[list[str], list[str], list[tuple]]:
    """The words with content of a clause that are said, those that are negated, and its numbers (dimension, counted, value, exact, negated); one pass, in which the state is the polarity and the last word with content."""
    kinds = [_kinds[w] for w in words]
    if max(kinds, default=NOTHING) <= CONTENT:
        return [w for w, kind in zip(words, kinds) if kind], [], []
    parity, last, skip, said, numbers = kinds.count(NEGATES_BEFORE) % 2, "", -1, ([], []), []
    for k, kind in enumerate(kinds):
        if kind == CONTENT:
            if k != skip:
                last = words[k]
                said[parity].append(last)
        elif kind == NUMBER:
            word, unit = words[k], words[k + 1] if k + 1 < len(words) else ""
            unit = unit[:-1] if _PLURAL.fullmatch(unit) else unit
            if unit in MEASURES:
                dimension, factor, offset = MEASURES[unit]
                numbers.append((dimension, None, (float(word) - offset) * factor, False, parity == 1))
            else:
                at = k + 1 + (unit in SCALES)
                dated = k and words[k - 1] in PREPOSITIONS and unit not in SCALES
                noun = words[at] if at < len(words) and kinds[at] == CONTENT and not dated else last
                numbers.append(("count", noun, float(word) * SCALES.get(unit, 1.0), unit not in SCALES, parity == 1))
            skip = k + 1 if unit in MEASURES or unit in SCALES else -1
        elif kind:
            parity ^= 1
    return *said, numbers


def _sentence_claims(sentence: str) -> Iterator[tuple[int, list[str], list[str], list[tuple]]]:
    """A sentence's clauses that have words, with their claims."""
    for j, clause in enumerate(_CLAUSE.split(sentence)):
        words = _WORD.findall(clause.lower()) if clause.isascii() else [w.lower() for w in _WORD.findall(clause)]
        if words:
            yield j, *_clause_claims(words)


def text_claims(text: str) -> Iterator[tuple]:
    """(sentence, clause, subject, word, dimension, counted, value, exact, negated) of one text, words as they are."""
    subject = ""
    plain = _plain(text)
    for i, (a, b) in enumerate(txt.sentence_spans(plain)):
        sentence = plain[a:b]
        subject = _subject(sentence, subject)
        for j, said, negated, numbers in _sentence_claims(sentence):
            for words, sign in ((said, False), (negated, True)):
                for word in words:
                    yield i, j, subject, word, None, None, None, None, sign
            for number in numbers:
                yield i, j, subject, None, *number


_CLAIM = pa.schema([
    ("sentence", pa.int32()), ("clause", pa.int32()), ("subject", pa.string()), ("word", pa.string()), ("dimension", pa.string()), ("counted", pa.string()),
    ("value", pa.float64()), ("exact", pa.bool_()), ("negated", pa.bool_()),
])
#: A worker hands on its claims whenever it has so many; a text's may be more.
HANDED_ON = 20_000


def _claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(batch: pa.RecordBatch, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
        own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("query_id", "side")]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(values, f.type) for f, values in zip(_CLAIM, zip(*found)))], names=["query_id", "side", *_CLAIM.names])

    for batch in batches:
        rows, found = [], []
        for k in range(batch.num_rows):
            for claim in text_claims(batch.column("text")[k].as_py() or ""):
                rows.append(k)
                found.append(claim)
                if len(found) >= HANDED_ON:
                    yield made(batch, rows, found)
                    rows, found = [], []
        if found:
            yield made(batch, rows, found)


def claims(texts: DataFrame) -> DataFrame:
    """(query_id, side, sentence, clause, subject, word, dimension, value, exact, negated) of texts (query_id, side, text).

    The subject is the last word of a sentence's first name that does not follow
    a preposition; without one its first word with content; a sentence that
    begins with a pronoun keeps the subject of the one before.  A row has a word (other than the subject) or a
    dimension with a value; all words are stems.  The dimension of a number
    without a unit is the word that it counts, after a preposition and else the
    last word before it.
    Null texts have no claims.
    """
    kind = texts.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, side string, sentence int, clause int, subject string, word string, dimension string, counted string, value double, exact boolean, negated boolean"
    rows = texts.select("query_id", "side", "text").mapInArrow(_claims, schema)
    rows = rows.withColumn("_s", F.transform(F.array("subject", "word", "counted"), txt.stem))
    dimension = F.when(F.col("dimension") == "count", F.concat(F.lit("count of "), F.col("_s")[2])).otherwise(F.col("dimension"))
    rows = rows.select("query_id", "side", "sentence", "clause", F.col("_s")[0].alias("subject"), F.col("_s")[1].alias("word"), dimension.alias("dimension"), "value", "exact", "negated")
    return rows.filter("word is null or word <> subject")


class _Sentences:
    """The claims of sentences by stems, remembered while there are few: clauses (clause, keys said, keys negated, numbers (key, value, exact))."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, str], tuple[str, list[tuple]]] = {}
        self.size = 0

    def of(self, text: str) -> Iterator[list[tuple]]:
        subject, plain = "", _plain(text)
        for a, b in txt.sentence_spans(plain):
            key = plain[a:b], subject
            found = self.held.get(key)
            if found is None:
                found = self._made(*key)
                self.size += 1 + len(key[0])
                if self.size > HELD:
                    self.held, self.size = {}, 0
                self.held[key] = found
            subject = found[0]
            yield found[1]

    @staticmethod
    def _made(sentence: str, before: str) -> tuple[str, list[tuple]]:
        subject, clauses = _subject(sentence, before), []
        about = _stems[subject]
        for j, *both, numbers in _sentence_claims(sentence):
            said, negated = ([f"{about} {w}" for w in map(_stems.__getitem__, words) if w != about] for words in both)
            if said or negated or numbers:
                clauses.append((j, said, negated, [(f"{about} {dimension} {'' if counted is None else _stems[counted]}", value, exact) for dimension, counted, value, exact, _ in numbers]))
        return subject, clauses


def _apart(value: float, other: float, exact: bool) -> bool:
    # as Spark compares: what is no number, the difference of two infinities, is above any
    return not abs(value - other) <= (0.0 if exact else TOLERANCE * max(abs(value), abs(other)))


def _clauses(sentences: _Sentences, answer: str, context: str) -> Iterator[tuple]:
    """(sentence, clause, n_words, n_opposed, n_numbers, n_unlike) of the clauses of an answer with claims, held against a context."""
    yes, no, values = set(), set(), {}
    for clauses in sentences.of(context):
        for _, said, negated, numbers in clauses:
            yes.update(said)
            no.update(negated)
            for key, value, _ in numbers:
                values.setdefault(key, []).append(value)
    for theirs in values.values():
        theirs.sort()

    def unlike(key: str, value: float, exact: bool) -> bool:
        theirs = values.get(key)
        if not theirs:
            return False
        lo, hi = bisect_right(theirs, value) - 1, bisect_left(theirs, value)
        return (lo < 0 or _apart(value, theirs[lo], exact)) and (hi == len(theirs) or _apart(value, theirs[hi], exact))

    for i, clauses in enumerate(sentences.of(answer)):
        for j, said, negated, numbers in clauses:
            opposed = len([x for x in said if x in no and x not in yes]) if no else 0
            if negated:
                opposed += len([x for x in negated if x in yes and x not in no])
            yield i, j, len(said) + len(negated), opposed, len(numbers), sum(unlike(*x) for x in numbers) if numbers else 0


_COUNTS = {"sentence": pa.int32(), "clause": pa.int32(), "n_words": pa.int64(), "n_opposed": pa.int64(), "n_numbers": pa.int64(), "n_unlike": pa.int64()}


def _conflicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(batch: pa.RecordBatch, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
        own = batch.column("query_id").take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([own, *(pa.array(values, kind) for kind, values in zip(_COUNTS.values(), zip(*found)))], names=["query_id", *_COUNTS])

    sentences = _Sentences()
    for batch in batches:
        rows, found = [], []
        for k in range(batch.num_rows):
            for known in (_kinds, _stems):
                if len(known) > REMEMBERED:
                    known.clear()
            for clause in _clauses(sentences, batch.column("text")[k].as_py() or "", batch.column("context")[k].as_py() or ""):
                rows.append(k)
                found.append(clause)
                if len(found) >= HANDED_ON:
                    yield made(batch, rows, found)
                    rows, found = [], []
        if found:
            yield made(batch, rows, found)


def conflicts(answers: DataFrame) -> DataFrame:
    """(query_id, sentence, clause, n_words, n_opposed, n_numbers, n_unlike) for each clause with claims of the answers (query_id, text, context).

    A word is opposed when the context says it of the same subject with the
    other polarity only.  A number is unlike when the context has numbers of
    the same subject and dimension, and none that is the same.  Rows of one
    query_id are taken as one: their claims meet by shuffles, while a row that has its id alone is judged where it is.
    """
    kind = answers.schema["query_id"].dataType.simpleString()
    judged = lambda rows: rows.select("query_id", "text", "context").mapInArrow(_conflicts, f"query_id {kind}, sentence int, clause int, n_words long, n_opposed long, n_numbers long, n_unlike long")
    split = stored(answers.groupBy("query_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("query_id").alias("_of")), "split-answers")
    if split.isEmpty():
        return judged(answers)
    alike = F.col("query_id").eqNullSafe(F.col("_of"))
    return judged(answers.join(split, alike, "left_anti")).unionByName(_shuffled_conflicts(answers.join(split, alike, "left_semi")))


def _shuffled_conflicts(answers: DataFrame) -> DataFrame:
    """conflicts by claims as rows, for answers of any number of rows and any size."""
    sides = answers.select("query_id", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(c).alias("text")) for s, c in (("answer", "text"), ("context", "context"))))).alias("_x"))
    found = claims(sides.select("query_id", "_x.side", "_x.text"))
    of_context = F.col("side") == "context"

    # words and numbers share one exchange, for no key is both
    key = ["query_id", "subject", "word", "dimension"]
    whole = W.partitionBy(*key)
    says = lambda negated: F.coalesce(F.max(of_context & (F.col("negated") == negated)).over(whole), F.lit(False))
    # the context's nearest values below and above; equal values of the context come first, so that they are below
    ordered = whole.orderBy("value", F.when(of_context, 0).otherwise(1))
    theirs = F.when(of_context, F.col("value"))
    held = found.withColumns({
        "_yes": says(False), "_no": says(True),
        "_lo": F.last(theirs, True).over(ordered.rowsBetween(W.unboundedPreceding, 0)), "_hi": F.last(theirs, True).over(whole.orderBy(F.desc("value"), F.when(of_context, 0).otherwise(1)).rowsBetween(W.unboundedPreceding, 0)),
    }).filter(~of_context)
    opposed = F.when(F.col("negated"), F.col("_yes") & ~F.col("_no")).otherwise(F.col("_no") & ~F.col("_yes"))
    apart = lambda c: F.coalesce(F.abs(F.col("value") - c) > F.when(F.col("exact"), 0.0).otherwise(TOLERANCE * F.greatest(F.abs("value"), F.abs(c))), F.lit(True))
    unlike = F.coalesce("_lo", "_hi").isNotNull() & apart(F.col("_lo")) & apart(F.col("_hi"))
    is_word = F.col("word").isNotNull()
    count = lambda c: F.sum(c.cast("long"))
    return held.groupBy("query_id", "sentence", "clause").agg(
        count(is_word).alias("n_words"), count(is_word & opposed).alias("n_opposed"), count(~is_word).alias("n_numbers"), count(~is_word & unlike).alias("n_unlike")
    )


def contradicted(clause_rows: DataFrame) -> DataFrame:
    """(query_id, n_clauses, n_contradicted): a clause is contradicted by an unlike number, or when more than half of its words are opposed."""
    against = (F.col("n_unlike") > 0) | (2 * F.col("n_opposed") > F.col("n_words"))
    return clause_rows.groupBy("query_id").agg(F.count("*").alias("n_clauses"), F.sum(against.cast("long")).alias("n_contradicted"))
