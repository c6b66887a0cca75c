import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from tesserae.functions import similarity as sim
from tesserae.functions import text as txt


def of(spark, fn, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    assert of(spark, txt.normalize, "८", "Straße", "  A\t b ", "“x”–y…", None, "क‍ष") == ["8", "strasse", "a b", '"x"-y...', None, "कष"]


@pytest.mark.parametrize(
    "text,tokens",
    [
        ("3.14", ["3.14"]),
        ("2,525", ["2", "525"]),
        ("e-mail C++", ["e-mail", "c"]),
        ("हिन्दी-abc", ["हिन्दी", "abc"]),
        ("東京都", ["東", "京", "都", "東京", "京都"]),
        ("है। नहीं", ["है", "नहीं"]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, text, tokens):
    assert of(spark, txt.tokens, text) == [tokens]


def test_stem(spark):
    assert of(spark, txt.stem, "running", "cat", "classes", "states") == ["run", "cat", "class", "stat"]


def test_sentences(spark):
    text = "Dr. Smith went. 3.14 is pi."
    (got,) = of(spark, txt.split_sentences, text)
    assert [g["sentence"] for g in got] == ["Dr. Smith went.", "3.14 is pi."]
    assert all(text[g["start"] : g["end"]] == g["sentence"] for g in got)
    (got,) = of(spark, txt.split_sentences, "नदी बड़ी है। वह लंबी है।")
    assert len(got) == 2


def test_paragraphs(spark):
    assert of(spark, lambda c: F.size(txt.split_paragraphs(c)), "a\n\nb", "a\nb") == [2, 1]


def test_paragraph_places(spark):
    texts = ["a\n\nb", "  a b \nc\n \n\n d𝒜\n", "", None, "\n\n", "x\n" * 3 + "\n" + "y z\n\n" * 2000]
    for text, got in zip(texts, of(spark, txt.paragraph_spans, *texts)):
        assert (got is None) == (text is None)
        want = [m for m in re.finditer(r"[^\n]+(?:\n(?!\s*\n)[^\n]+)*", text or "") if m[0].strip()]
        assert [(p["paragraph"], p["start"]) for p in got or []] == [(m[0].strip(), m.start() + len(m[0]) - len(m[0].lstrip())) for m in want]
        assert all(text[p["start"] : p["end"]] == p["paragraph"] for p in got or [])


def test_normalize_equals_python(spark):
    rng = random.Random(6)
    letters = [chr(c) for c in range(0x20, 0x250)] + list("’“„–—…\u00a0\u202f€•ﬁ①éẞΣς\u0301\u200dक८東") + ["\t", "\n", "\x85", "\x1c"]
    texts = ["".join(rng.choice(letters) for _ in range(12)) for _ in range(3000)] + letters
    for fold in (True, False):
        for text, got in zip(texts, of(spark, lambda c: txt.normalize(c, fold), *texts)):
            plain = " ".join(unicodedata.normalize("NFKC", text).translate(txt._FOLDS).split())
            assert got == (plain.casefold() if fold else plain), text


def test_latin_tokens_equal_the_general_pattern(spark):
    rng = random.Random(7)
    letters = [chr(c) for c in range(0x20, 0x250)] + list("'-_.@/+'-. 019€‑–")
    texts = [t for t in ("".join(rng.choice(letters) for _ in range(15)) for _ in range(3000))]
    general = of(spark, lambda c: F.regexp_extract_all(c, F.lit(txt.TOKEN), F.lit(0)), *texts)
    assert of(spark, txt.tokenize, *texts) == general


def test_sentences_are_found_in_one_pass():
    began = time.time()
    assert txt.sentence_spans("Dr. " * 100_000) == [(0, 399_999)] and len(txt.sentence_spans("a1. " * 50_000)) == 50_000
    assert time.time() - began < 10


def test_functions_in_sql(spark):
    txt.register(spark)
    row = spark.sql("SELECT txt_tokens(txt_fold('Straße e-mail C++')) t, txt_years('in 1999') y, txt_numbers('2,525 m or 3') n, txt_jaccard(array('a'), array('a', 'b')) j, txt_sentences('One. Two.') s").first()
    assert (row["t"], row["y"], row["n"], row["j"], len(row["s"])) == (["strasse", "e-mail", "c"], ["1999"], ["2,525 m", "3"], 0.5, 2)
    got = spark.sql("SELECT x.id, c.* FROM VALUES (1, 'a b c d e'), (2, null) AS x(id, t), LATERAL txt_chunks(x.t, 3, 1) c").collect()
    assert [(r["id"], r["ordinal"], r["chunk"]) for r in got] == [(1, 0, "a b c"), (1, 1, "c d e")]


def test_query_types(spark):
    assert of(spark, txt.classify_query, "how many states", "difference between a and b", "what is the difference between a and b", "which one", "rain") == [
        "numeric", "comparison", "definition", "definition", "factual",
    ]


def test_script_and_language(spark):
    assert of(spark, txt.detect_lang, "नमस्ते abc", "abc", "", "東京") == ["hi", "en", "en", "zh"]
    assert of(spark, txt.strip_accents, "é", "abc", None) == ["e", "abc", None]


def test_claims_and_numbers(spark):
    assert of(spark, txt.extract_numbers, "It took 3.5 km and 2,525 m in 1999") == [["3.5 km", "2,525 m", "1999"]]
    assert of(spark, txt.extract_years, "in 1999, x2001, 20199 and 2001") == [["1999", "2001"]]
    assert of(spark, txt.extract_entities, 'Mount Everest and "the hill" near Mount Everest') == [["Mount Everest", "the hill"]]


def test_truncate_and_highlight(spark):
    assert of(spark, lambda c: txt.truncate(c, 10), "short", "one two three four") == ["short", "one two…"]
    (got,) = of(spark, lambda c: txt.highlight_spans(c, F.array(F.lit("vectors"), F.lit("database"))), "A vector database is")
    assert [(g["start"], g["end"]) for g in got] == [(2, 17)]


def test_char_ngrams(spark):
    assert of(spark, txt.char_ngrams, "ab", "") == [["^ab", "ab$", "^ab$"], []]


def test_similarities(spark):
    row = spark.range(1).select(
        sim.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("j"),
        sim.token_f1(F.array(F.lit("a"), F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("f"),
        sim.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("v"),
        sim.percentile(F.array(F.lit(4), F.lit(1), F.lit(3), F.lit(2)), 50).alias("p"),
        sim.stricter(F.lit("clarify"), F.lit("refuse")).alias("s"),
    ).first()
    assert round(row["j"], 6) == round(1 / 3, 6) and row["f"] == 0.5 and row["v"] == [0.6, 0.8] and row["p"] == 3 and row["s"] == "refuse"


MEGABYTE = 1_000_000


@pytest.mark.parametrize("unit,tokens", [("a-", 1), ("б.", 1), ("1.2.", 1), ("row\n", 250_000), ("Capital ", 125_000), (" \n", 0), ("1,", 500_000), ("Foo of ", 142_857 * 2)])
def test_a_megabyte_of_one_unit(spark, unit, tokens):
    """Repeated groups must neither recurse for each repetition nor take the square of a blank's length."""
    text = unit * (MEGABYTE // len(unit))
    rows = spark.createDataFrame([(text,)], "x string").coalesce(1)
    began = time.time()
    got = rows.select(F.size(txt.tokens(F.col("x"))).alias("t"), F.size(txt.split_paragraphs(F.col("x"))).alias("p"), F.size(txt.extract_claims(F.col("x"))).alias("c")).first()
    assert got["t"] == tokens and got["p"] == (0 if not text.strip() else 1) and time.time() - began < 60


def test_long_blanks_and_long_words_without_spaces(spark):
    rows = spark.createDataFrame([("Foo" + " " * MEGABYTE + "x",), ("東-" * 20_000,)], "x string").coalesce(1)
    began = time.time()
    got = rows.select(F.size(txt.tokens(F.col("x"))).alias("t"), F.size(txt.split_paragraphs(F.col("x"))).alias("p"), txt.truncate(F.col("x"), 10).alias("s")).collect()
    assert [(r["t"], r["p"]) for r in got] == [(2, 1), (79_999, 1)] and got[0]["s"] == "Foo…" and time.time() - began < 60


def test_names_and_claims_equal_python(spark):
    rng = random.Random(8)
    parts = ["Foo", "Bar", "Ab", "of", "der", "de", "the", " ", "  ", "\n", "x", "9", "_", "Ünal", "Baz9", ".", '"Foo"', '"a b"', "FOO"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(2000)]
    name = re.compile(r"(?<!\w)[A-Z][a-z]{2,}(?:\s+(?:of|de|van|der|the|and)?\s*[A-Z][a-z]{2,})*(?!\w)")
    for text, got in zip(texts, of(spark, lambda c: F.regexp_extract_all(c, F.lit(txt.PROPER), F.lit(0)), *texts)):
        assert got == [m[0] for m in name.finditer(text)], text
    for text, got in zip(texts, of(spark, txt.extract_entities, *texts)):
        found = [m[0].strip() for m in name.finditer(text)] + [m[1].strip() for m in re.finditer(r'"([^"]{2,80})"', text)]
        want = {}
        for x in found:
            if len(x) > 2 and x.lower() not in txt.STOPWORDS:
                want.setdefault(x.lower(), x)
        assert got == list(want.values()), text


def test_scripts_are_told_by_counts_and_then_by_place_and_latin_texts_by_one_search(spark):
    cases = [("αβ ab", "greek"), ("ab αβ", "latin"), ("é😀", "latin"), ("😀 12", "latin"), ("Ωб", "greek"), ("бΩ", "cyrillic"), ("×÷ 12", "latin"), ("aé αβγ", "greek"), ("नमस्ते ab", "devanagari"), ("", "latin"), (None, "latin")]
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, text string").select("k", txt.dominant_script(F.col("text")).alias("s"), txt.detect_lang(F.col("text")).alias("lang")).collect()
    assert {r["k"]: r["s"] for r in rows} == {k: s for k, (_, s) in enumerate(cases)}
    assert {r["k"]: r["lang"] for r in rows} == {k: txt.LANGUAGE[s] for k, (_, s) in enumerate(cases)}

    def seconds(column):
        start = time.time()
        spark.range(0, 64, 1, 8).select(F.repeat(F.concat(F.lit("ein schöner Tag, "), "id"), 20_000).alias("text")).select(column(F.col("text"))).write.format("noop").mode("overwrite").save()
        return time.time() - start

    seconds(F.length)
    # one search, not two for each of 19 scripts and those twice
    assert seconds(txt.detect_lang) < 15 * seconds(lambda t: F.length(F.regexp_replace(t, "[A-Za-z]++", "")))
