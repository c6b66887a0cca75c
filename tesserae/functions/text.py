"""Script-aware text functions as Column expressions.

Built-in Spark functions wherever they can do it.  Spark has no NFKC, NFD or
full case folding, so normalize sends texts with characters beyond a stated safe
set (only those; others arrive as nulls) through an Arrow-batched function, and
strip_accents those with non-ASCII characters.  Sentence and highlight offsets
are found in Python, since Java counts UTF-16 units.  Null texts give null
strings and empty arrays.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.similarity import let, running_sums

# Scripts by code point ranges, in order of precedence.
SCRIPTS = (
    ("latin", 0x0041, 0x005A), ("latin", 0x0061, 0x007A), ("latin", 0x00C0, 0x024F), ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x04FF), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("oriya", 0x0B00, 0x0B7F),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F),
    ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
# Scripts without spaces between words, scripts with Indic suffixes, and the language that a script stands for.
NO_SPACE = ("han", "kana", "hangul", "thai")
INDIC = ("devanagari", "bengali", "gurmukhi", "gujarati", "oriya", "tamil", "telugu", "kannada", "malayalam", "sinhala")
LANGUAGE = {
    "devanagari": "hi", "bengali": "bn", "gurmukhi": "pa", "gujarati": "gu", "oriya": "or", "tamil": "ta", "telugu": "te",
    "kannada": "kn", "malayalam": "ml", "sinhala": "si", "arabic": "ar", "cyrillic": "ru", "greek": "el", "hebrew": "he",
    "han": "zh", "kana": "ja", "hangul": "ko", "thai": "th", "latin": "en",
}
# First digits of the digit blocks that fold to ASCII, characters that vanish, characters that are replaced.
DIGIT_ZEROS = (0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0660, 0x06F0)
DELETED = (0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0xFEFF, 0x00AD, 0x2060)
REPLACED = {
    "'": (0x2018, 0x2019, 0x201A, 0x201B, 0x0060, 0x00B4),
    '"': (0x201C, 0x201D, 0x201E, 0x201F),
    "-": (0x2013, 0x2014, 0x2015, 0x2212),
    "...": (0x2026,),
    " ": (0x00A0, 0x202F, 0x2009),
}
# Words without content.
STOPWORDS = tuple(
    """
a an the and or but if then than that this these those of in on at to for from by with
as is are was were be been being do does did doing have has had having i you he she it
we they them his her its their our your my me him us not no nor so too very can will
just should now what which who whom when where why how all any both each few more most
other some such only own same s t don didn
और का की के को है हैं था थे थी में से पर यह वह ये वे कि जो तो ही भी नहीं एक हो होता होती
क्या कैसे कब कहाँ क्यों कौन किस अपने लिए साथ तक बाद पहले
এবং এর এই সেই যে না হয় হয়েছে ছিল করে জন্য থেকে সঙ্গে কি কেন কিভাবে কখন কোথায় একটি
மற்றும் இந்த அந்த ஒரு என்று இல்லை உள்ளது ஆகிறது என்ன எப்படி எப்போது எங்கே ஏன்
మరియు ఈ ఆ ఒక అని లేదు ఉంది అవుతుంది ఏమిటి ఎలా ఎప్పుడు ఎక్కడ ఎందుకు
""".split()
)
# Question words, which content_tokens can keep.
QUESTION_WORDS = tuple(
    """
what which who whom whose when where why how is are do does did can could should would
will define explain list name many much long far
क्या कैसे कब कहाँ क्यों कौन कितना कितने किस
কি কেন কিভাবে কখন কোথায় কোন কত
என்ன எப்படி எப்போது எங்கே ஏன் எவ்வளவு
ఏమిటి ఎలా ఎప్పుడు ఎక్కడ ఎందుకు ఎంత
""".split()
)
# Suffixes in the order in which they are tried.
ENGLISH_SUFFIXES = (
    "ational tional iveness fulness ousness ization ation ments ement ingly edly ness ions ing ies ied ers est ed es ly s"
).split()
INDIC_SUFFIXES = "ओं याँ ियों ाओं ों ें ाँ ीं ता ना ने नी का की के है".split()
# Query types and the phrases that show them, in order of precedence.
QUERY_TYPES = (
    ("definition", ("what is", "what are", "define", "meaning of", "what does", "क्या है", "अर्थ", "কি", "என்றால் என்ன")),
    ("numeric", ("how many", "how much", "how long", "how far", "how old", "what year", "what percentage", "कितना", "कितने", "কত", "எவ்வளவு")),
    ("person", ("who is", "who was", "who are", "who invented", "who discovered", "who wrote", "कौन", "কে", "யார்")),
    ("location", ("where is", "where are", "where can", "where does", "कहाँ", "কোথায়", "எங்கே")),
    ("temporal", ("when is", "when was", "when did", "when does", "कब", "কখন", "எப்போது")),
    ("causal", ("why is", "why are", "why does", "why did", "reason for", "क्यों", "কেন", "ஏன்")),
    ("procedural", ("how do", "how to", "how does", "how can", "steps to", "process of", "कैसे", "কিভাবে", "எப்படி")),
    ("comparison", ("difference between", "versus", " vs ", "compare", "better than", "अंतर", "পার্থক্য")),
    ("listing", ("list of", "types of", "kinds of", "examples of", "name the", "प्रकार", "ধরন", "வகைகள்")),
    ("boolean", ("is it", "are there", "does it", "can you", "did the", "is the", "क्या यह")),
)
# Sentence ends, and words after which a full stop ends none.
TERMINATORS = ".!?।॥؟۔。！？⁉‽;"
ABBREVIATIONS = frozenset(
    """
mr mrs ms dr prof sr jr st rev hon capt sgt lt col gen adm gov pres
vs etc eg ie al fig no vol ch pp ed eds repr trans approx est
inc ltd co corp dept univ inst assn bros
jan feb mar apr jun jul aug sep sept oct nov dec
mon tue wed thu fri sat sun
u.s u.k u.n a.m p.m i.e e.g
""".split()
)
# Units that may follow a number.
UNITS = (
    "%|percent|per cent|million|billion|trillion|thousand|lakh|crore|kg|km|cm|mm|m|ft|mi|lb|kb|mb|gb|tb|hz|khz|mhz|ghz|"
    "°c|°f|celsius|fahrenheit|years?|months?|days?|hours?|minutes?|seconds?"
)

EMPTY = "cast(array() as array<string>)"
#: Python's \s and \w for Java, which reads the bare classes as ASCII.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
_NOT_LETTER = r"[^\p{P}\p{Z}\p{S}\p{C}\p{Nd}]"
_IN_WORD = "[-'_.@/+]"


#: The characters of SPACE, for trimming: a pattern that ends in SPACE+$ takes the square of a blank's length.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def trimmed(text: Column) -> Column:
    """text without white space around it."""
    return F.btrim(text, F.lit(BLANKS))


def _class(*names: str) -> str:
    """A Java character class of scripts, without what Unicode does not call letters or marks."""
    ranges = "".join(f"\\u{lo:04X}-\\u{hi:04X}" for n, lo, hi in SCRIPTS if n in names)
    return f"[[{ranges}]&&{_NOT_LETTER}]"


SCRIPT_NAMES = tuple(dict.fromkeys(n for n, _, _ in SCRIPTS))
_LATIN_OR_DIGIT = f"[{_class('latin')}\\p{{Nd}}]"
_SPACED = [_LATIN_OR_DIGIT] + [_class(n) for n in SCRIPT_NAMES if n not in NO_SPACE and n != "latin"]
_UNSPACED = [_class(n) for n in NO_SPACE]
# Java runs a repeated group by recursion unless it is possessive; what a repetition here consumes it never has to give back.
TOKEN = "|".join([f"{c}++(?:{_IN_WORD}++{c}++)*+" for c in _SPACED] + [f"{c}[{c}{_IN_WORD}]*+" for c in _UNSPACED])
_ANY_UNSPACED = "|".join(_UNSPACED)

_FOLDS = {z + d: str(d) for z in DIGIT_ZEROS for d in range(10)} | dict.fromkeys(DELETED, "") | {c: to for to, cs in REPLACED.items() for c in cs}


def _is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def _beyond_ascii(text: Column) -> Column:
    """The characters of a text that are not ASCII, mostly few: classes with many ranges are tested on these, since Java tries one range after the other."""
    return F.regexp_replace(text, r"[\x00-\x7F]++", "")


@F.pandas_udf(T.StringType())
def _fold_case(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).translate(_FOLDS).split()).casefold())


@F.pandas_udf(T.StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).translate(_FOLDS).split()))


@F.pandas_udf(T.StringType())
def _bare(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))))


def _safe_characters() -> str:
    """Inside of a Java character class: Latin letters and signs beyond ASCII that NFKC leaves alone and whose case folding is lower case, or ss for ß."""
    alone = [c for c in map(chr, range(0xA1, 0x250)) if unicodedata.normalize("NFKC", c) == c and ord(c) not in _FOLDS and (c.casefold() == c.lower() or c == "ß") and len(c.lower()) == 1]
    # as ranges: Java tries the members of a class one after the other
    first = [c for c in alone if chr(ord(c) - 1) not in alone]
    last = [c for c in alone if chr(ord(c) + 1) not in alone]
    return "".join(f"\\u{ord(a):04X}-\\u{ord(b):04X}" for a, b in zip(first, last))


# Characters beyond Latin that normalize replaces itself, and by what; signs that stay.
_QUOTES, _DASHES, _BLANKS, _SIGNS = "\u2018\u2019\u201a\u201b", "\u2013\u2014\u2015\u2212", "\u00a0\u202f\u2009", "\u2022\u20ac"
_DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f"
_FOLDED = _QUOTES + _DOUBLE_QUOTES + _DASHES + _BLANKS
_FOLDED_TO = "'" * 4 + '"' * 4 + "-" * 4 + " " * 3
#: A character that normalize leaves to Python; ASCII is ruled out first, since most characters are.
_UNSAFE = f"[[^\\x00-\\x7F]&&[^{_safe_characters()}{_FOLDED}{_SIGNS}\u2026]]"


def normalize(text: Column, fold_case: bool = True) -> Column:
    """NFKC, digits to ASCII, zero-width characters out, quotes and dashes unified, white space collapsed; case folded."""
    beyond = _beyond_ascii(text)
    plain = F.when(beyond.rlike(f"[{_FOLDED}\u2026]"), F.replace(F.translate(text, _FOLDED, _FOLDED_TO), F.lit("\u2026"), F.lit("..."))).otherwise(text)
    native = F.trim(F.regexp_replace(F.replace(plain, F.lit("`"), F.lit("'")), r"[\x09-\x0D\x1C-\x20]+", " "))
    native = F.replace(F.lower(native), F.lit("ß"), F.lit("ss")) if fold_case else native
    other = F.when(beyond.rlike(_UNSAFE), text)
    return F.coalesce((_fold_case if fold_case else _fold)(other), native)


def strip_accents(text: Column) -> Column:
    """Without combining marks of a class other than 0, Indic nukta and virama included."""
    return F.coalesce(_bare(F.when(~_is_ascii(text), text)), text)


#: Latin letters and ASCII digits; those below U+0100 one by one, which Java looks up in one table instead of trying ranges.
_LATIN = "[" + "".join(c for c in map(chr, range(0x30, 0x100)) if c.isascii() and c.isalnum() or c >= "À" and c not in "×÷") + "Ā-ɏ]"
#: TOKEN where all letters are Latin and all digits ASCII, which texts without characters beyond these are.
_LATIN_TOKEN = f"{_LATIN}++(?:{_IN_WORD}++{_LATIN}++)*+"
_BEYOND_LATIN = r"[^\x00-\u024F\u2000-\u2BFF]"


def tokenize(normalized: Column) -> Column:
    """Tokens of a normalized text: runs of one script; where words have no spaces, characters, then pairs of them."""

    def characters(t: Column) -> Column:
        def with_pairs(cs: Column) -> Column:
            n = F.size(cs) - 1
            return F.concat(cs, F.when(n > 0, F.zip_with(F.slice(cs, F.lit(1), n), F.slice(cs, F.lit(2), n), lambda a, b: F.concat(a, b))).otherwise(F.expr(EMPTY)))

        return let(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), with_pairs)

    def of(text: Column) -> Column:
        runs = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
        spread = F.flatten(F.transform(runs, lambda t: F.when(t.rlike(f"^(?:{_ANY_UNSPACED})"), characters(t)).otherwise(F.array(t))))
        general = F.when(text.rlike(_ANY_UNSPACED), spread).otherwise(runs)
        return F.when(_beyond_ascii(text).rlike(_BEYOND_LATIN), general).otherwise(F.regexp_extract_all(text, F.lit(_LATIN_TOKEN), F.lit(0)))

    return F.coalesce(let(normalized, of), F.expr(EMPTY))


def tokens(text: Column) -> Column:
    """The tokens of tokenize(normalize(text)), in one pass of Python: Java's matches cost several times as much."""
    return _token_lists(text)


def count_tokens(text: Column) -> Column:
    return _token_counts(text)


def content(toks: Column, keep_question_words: bool = False) -> Column:
    """Tokens with content: no stopwords, and no single characters unless question words are kept."""
    if keep_question_words:
        return F.filter(toks, lambda t: ~t.isin(*STOPWORDS) | t.isin(*QUESTION_WORDS))
    return F.filter(toks, lambda t: ~t.isin(*STOPWORDS) & (F.length(t) > 1))


def content_tokens(text: Column, keep_question_words: bool = False) -> Column:
    return content(tokens(text), True) if keep_question_words else _content_lists(text)


def char_ngrams(token: Column, n_min: int = 3, n_max: int = 5) -> Column:
    """n-grams of ^token$, shorter ones first."""
    padded = F.concat(F.lit("^"), token, F.lit("$"))
    size = F.length(padded)
    of = [_grams(padded, size, n) for n in range(n_min, n_max + 1)]
    return F.concat(*of)


def _grams(padded: Column, size: Column, n: int) -> Column:
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.expr(EMPTY))


def stem(token: Column) -> Column:
    """The first suffix that leaves three characters is cut off; English doubled consonants but l, s and z are halved.

    The rules are long, and Java compiles no method of their length: inside of a lambda they stay
    out of the code that Spark generates for the rest of a stage.
    """
    return let(token, _stem)


def _stem(token: Column) -> Column:
    def cut(suffixes: list[str], undouble: bool) -> Column:
        out = token
        for suffix in reversed(suffixes):
            base = F.substring(token, F.lit(1), F.length(token) - len(suffix))
            if undouble:
                twice = (F.length(base) > 3) & (F.substring(base, -1, 1) == F.substring(base, -2, 1)) & ~F.substring(base, -1, 1).isin("l", "s", "z")
                base = F.when(twice, F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)
            out = F.when(F.endswith(token, F.lit(suffix)) & (F.length(token) - len(suffix) >= 3), base).otherwise(out)
        return out

    indic = F.substring(token, 1, 1).rlike(_class(*INDIC))
    return F.when(F.length(token) <= 3, token).when(indic, cut(INDIC_SUFFIXES, False)).otherwise(cut(ENGLISH_SUFFIXES, True))


@cache
def _indic() -> re.Pattern:
    return re.compile(f"[{_range(*INDIC)}]")


def stem_of(token: str) -> str:
    """stem of one token in Python."""
    n = len(token)
    if n <= 3:
        return token
    indic = not token.isascii() and _indic().match(token)
    for suffix in INDIC_SUFFIXES if indic else ENGLISH_SUFFIXES:
        if token.endswith(suffix) and n - len(suffix) >= 3:
            base = token[: n - len(suffix)]
            return base[:-1] if not indic and len(base) > 3 and base[-1] == base[-2] and base[-1] not in "lsz" else base
    return token


def stems(text: Column) -> Column:
    return F.transform(content_tokens(text), stem)


def script_of(char: Column) -> Column:
    """The script of one character, digit for decimal digits of any script, other for the rest; null for null."""
    out = F.lit("other")
    for name in reversed(SCRIPT_NAMES):
        out = F.when(char.rlike(f"^{_class(name)}"), name).otherwise(out)
    return F.when(char.rlike(r"^\p{Nd}"), "digit").when(char.isNotNull(), out)


def _script(text: Column) -> Column:
    """The script with most characters; of equal ones the one that comes first in the text; null if there is none.

    Texts without characters beyond Latin have no other script.  Of the rest, what is not ASCII is
    searched once for each script; places are looked for where counts are equal.
    """
    latin = _class("latin")
    letters = lambda t: F.length(t) - F.length(F.regexp_replace(t, "[A-Za-z]++", ""))

    def scored(beyond: Column) -> Column:
        count = lambda n: F.regexp_count(beyond, F.lit(_class(n))) + (letters(text) if n == "latin" else F.lit(0))
        return F.array(*(F.struct(count(n).alias("n"), F.lit(n).alias("script"), F.lit(_class(n)).alias("class")) for n in SCRIPT_NAMES))

    def first(tied: Column) -> Column:
        places = F.transform(tied, lambda x: F.struct(F.regexp_instr(text, x["class"]).alias("at"), x["script"].alias("script")))
        return F.when(F.size(tied) == 1, F.get(tied, F.lit(0))["script"]).when(F.size(tied) > 1, F.array_min(places)["script"])

    def best(counts: Column) -> Column:
        return let(F.array_max(F.transform(counts, lambda x: x["n"])), lambda most: let(F.filter(counts, lambda x: (x["n"] == most) & (most > 0)), first))

    beyond = _beyond_ascii(text)
    general = let(let(beyond, scored), best)
    return F.when(beyond.rlike(_BEYOND_LATIN), general).when(text.rlike("[A-Za-z]") | beyond.rlike(latin), "latin")


def dominant_script(text: Column) -> Column:
    """The script with most characters; of equal ones the one that comes first in the text; latin if there is none."""
    return F.coalesce(_script(text), F.lit("latin"))


def detect_lang(text: Column, default: str = "en") -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGE.items() for x in kv))
    return F.coalesce(F.element_at(table, _script(text)), F.lit(default))


def classify_query(text: Column) -> Column:
    """The type of the first phrase, in table order, that a query has; what and which ask for a definition; else factual."""
    padded = F.concat(F.lit(" "), normalize(text), F.lit(" "))
    first = F.split_part(F.trim(padded), F.lit(" "), F.lit(1))
    out = F.when(first.isin("what", "which"), "definition").otherwise("factual")
    for kind, phrases in reversed(QUERY_TYPES):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(padded, F.lit(p)) for p in phrases]), kind).otherwise(out)
    return out


NUMBER = rf"(?i)(?<![\p{{L}}\p{{N}}_.])(?:\p{{Nd}}{{1,3}}(?:,\p{{Nd}}{{3}})+|\p{{Nd}}+(?:\.\p{{Nd}}+)?){SPACE}?(?:{UNITS})?(?!{WORD})"
YEAR = rf"(?<!{WORD})(?:1[0-9]{{3}}|20[0-9]{{2}})(?!{WORD})"
_NAME = rf"[A-Z][a-z]{{2,}}+(?!{WORD})"
PROPER = rf"(?<!{WORD}){_NAME}(?:{SPACE}++(?:(?:of|de|van|der|the|and){SPACE}*+)?{_NAME})*+"
QUOTED = '"([^"]{2,80})"'


def extract_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), trimmed)


def extract_years(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(YEAR), F.lit(0))


def _first_of_each(values: Column) -> Column:
    """Values without those that equal an earlier one but for case; n log n, by sorting."""
    ordered = F.array_sort(F.transform(values, lambda v, i: F.struct(F.lower(v).alias("key"), i.alias("i"), v.alias("v"))))
    firsts = let(ordered, lambda o: F.filter(o, lambda x, k: (k == 0) | (x["key"] != F.get(o, k - 1)["key"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))), lambda x: x["v"])


def extract_entities(text: Column) -> Column:
    """Capitalised runs, then quoted strings, longer than two characters, no stopwords, each once."""
    found = F.concat(F.regexp_extract_all(text, F.lit(PROPER), F.lit(0)), F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)))
    bare = F.transform(found, trimmed)
    return _first_of_each(F.filter(bare, lambda x: (F.length(x) > 2) & ~F.lower(x).isin(*STOPWORDS)))


def extract_claims(text: Column) -> Column:
    return _first_of_each(F.concat(extract_numbers(text), extract_years(text), extract_entities(text)))


def truncate(text: Column, limit: int, ellipsis: str = "…") -> Column:
    """Cut at the last space beyond 60 % of limit, if there is one, and marked as cut."""
    cut = F.substring(text, 1, limit)
    last = F.length(cut) - F.instr(F.reverse(cut), " ")
    back = F.when((F.instr(F.reverse(cut), " ") > 0) & (last > limit * 0.6), F.substring(cut, F.lit(1), last)).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(back, F.lit(" ,;:.")), F.lit(ellipsis)))


_SPACE_IN_LINE = SPACE.replace(r"\x09-\x0D", r"\x09\x0B-\x0D")
BLOCK = rf"[^\n]++(?:\n(?!{_SPACE_IN_LINE}*+\n)[^\n]++)*+"


def paragraph_spans(text: Column) -> Column:
    """array<struct<paragraph,start,end>> of the blocks between blank lines, trimmed, in code points of the text as it is.

    A block's place is the length of all that lies before it: what is between
    blocks, and the blocks themselves.
    """

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, BLOCK, -1), F.length)
        ends = running_sums(F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, gap: F.length(m) + gap))
        cut = F.zip_with(found, ends, lambda m, end: F.struct(m.alias("m"), (end - F.length(m)).alias("at")))
        bare = F.transform(
            cut,
            lambda c: F.struct(
                trimmed(c["m"]).alias("paragraph"),
                (c["at"] + F.length(c["m"]) - F.length(F.ltrim(c["m"], F.lit(BLANKS)))).alias("start"),
            ),
        )
        kept = F.filter(bare, lambda b: b["paragraph"] != "")
        return F.transform(kept, lambda b: F.struct(b["paragraph"].alias("paragraph"), b["start"].alias("start"), (b["start"] + F.length(b["paragraph"])).alias("end")))

    return let(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0)), placed)


def split_paragraphs(text: Column) -> Column:
    """Blocks between blank lines, trimmed."""
    return F.transform(paragraph_spans(text), lambda p: p["paragraph"])


# --- functions that need Python offsets ------------------------------------------------------------------------------

_ENDS = re.compile(f"[{re.escape(TERMINATORS)}]+")


#: How far back from a full stop its word is looked for; longer words are no abbreviations and decide by their last character.
_WORD_BACK = 64


def _ends_sentence(text: str, start: int, end: int) -> bool:
    """Whether the terminators that end at end, of a sentence that began at start, end it."""
    stop = end
    while stop > start and text[stop - 1].isspace():
        stop -= 1
    if stop == start or text[stop - 1] != ".":
        return True
    lo = max(start, stop - 1 - _WORD_BACK)
    words = text[lo : stop - 1].split()
    if not words:
        return True
    word = words[-1].casefold().rstrip(".")
    if word in ABBREVIATIONS or (len(word) == 1 and word.isalpha()):
        return False
    return not (word[-1:].isdigit() and text[end : end + 1].isdigit())


def sentence_spans(text: str, min_chars: int = 2) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, without white space around them; one pass."""

    def trimmed(lo: int, hi: int) -> tuple[int, int]:
        piece = text[lo:hi]
        return lo + len(piece) - len(piece.lstrip()), hi - (len(piece) - len(piece.rstrip()))

    cuts, start = [], 0
    for m in _ENDS.finditer(text):
        if _ends_sentence(text, start, m.end()):
            cuts.append((start, m.end()))
            start = m.end()
    spans = [s for s in (trimmed(*c) for c in [*cuts, (start, len(text))]) if s[1] - s[0] >= min_chars]
    whole = trimmed(0, len(text))
    return spans or ([whole] if whole[0] < whole[1] else [])


#: Bytes of text that a worker takes at a time, so that what it makes of a batch is not held at once; a longer text is one slice.
SLICE = 1 << 20


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(start, length) of consecutive slices of texts with about most bytes each."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy()
    lo = 0
    while lo < len(texts):
        hi = max(int(ends.searchsorted((ends[lo - 1] if lo else 0) + most, "right")), lo + 1)
        yield lo, hi - lo
        lo = hi


def _in_slices(made: Callable[[pa.Array], pa.Array]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """A function over batches of texts that hands on what made makes of one slice after the other."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for lo, n in slices(batch):
                yield made(batch.slice(lo, n))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def lists(values: list[list | None], kind: pa.DataType) -> pa.Array:
    """Python lists as one Arrow array of lists."""
    ends = [0]
    for v in values:
        ends.append(ends[-1] + len(v))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for v in values for x in v], kind))


def _range(*names: str) -> str:
    """The inside of a Python character class with the same characters as _class."""
    return "".join(chr(c) if chr(c).isalnum() else f"\\U{c:08X}" for n, lo, hi in SCRIPTS if n in names for c in range(lo, hi + 1) if unicodedata.category(chr(c))[0] not in "PZSC" and unicodedata.category(chr(c)) != "Nd")


@cache
def _token_patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """TOKEN for Python; the characters of scripts without spaces; the places in a word at which no token but one of those is cut."""
    unspaced = [f"[{_range(n)}]" for n in NO_SPACE]
    spaced = [rf"[{_range('latin')}\d]"] + [f"[{_range(n)}]" for n in SCRIPT_NAMES if n not in NO_SPACE and n != "latin"]
    token = "|".join([f"{c}+(?:{_IN_WORD}+{c}+)*" for c in spaced] + [f"{c}(?:{c}|{_IN_WORD})*" for c in unspaced])
    cut = "|".join(f"(?<={c})" for c in [r"[^\w\-'.@/+`\u0080-\U0010FFFF]", "[、。，！？；：「」『』【】《》]", *unspaced])
    return re.compile(token), re.compile("|".join(unspaced)), re.compile(cut)


def token_count(text: str) -> int:
    """count_tokens of one text in Python."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_FOLDS).casefold()
    token, unspaced, _ = _token_patterns()
    return sum(2 * len(t) - 1 if unspaced.match(t) else 1 for t in token.findall(text.replace("`", "'").lower()))


def word_pieces(word: str) -> list[str]:
    """A word cut where no token is, and between the characters of scripts without spaces."""
    return [p for p in _token_patterns()[2].split(word) if p]


_ASCII_TOKENS = re.compile(f"[0-9a-z]++(?:{_IN_WORD}++[0-9a-z]++)*+").findall
_LATIN_TOKENS = re.compile(_LATIN_TOKEN).findall
_NEEDS_FOLD, _NEEDS_SCRIPTS = re.compile("[" + "".join(f"\\U{c:08X}" for c in sorted(_FOLDS)) + "]").search, re.compile(_BEYOND_LATIN).search


def token_list(text: str | None) -> list[str]:
    """tokens of one text in Python."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_TOKENS(text.lower().replace("`", "'"))
    text = unicodedata.normalize("NFKC", text)
    text = (text.translate(_FOLDS) if _NEEDS_FOLD(text) else text).casefold()
    if not _NEEDS_SCRIPTS(text):
        return _LATIN_TOKENS(text)
    token, unspaced, _ = _token_patterns()
    return [x for t in token.findall(text) for x in ((*t, *map("".join, zip(t, t[1:]))) if unspaced.match(t) else (t,))]


_STOP = frozenset(STOPWORDS)


def content_list(text: str | None) -> list[str]:
    """content_tokens of one text in Python."""
    return [t for t in token_list(text) if len(t) > 1 and t not in _STOP]


_token_lists = F.arrow_udf(_in_slices(lambda texts: lists([token_list(t) for t in texts.to_pylist()], pa.string())), T.ArrayType(T.StringType()))
_content_lists = F.arrow_udf(_in_slices(lambda texts: lists([content_list(t) for t in texts.to_pylist()], pa.string())), T.ArrayType(T.StringType()))
_token_counts = F.arrow_udf(_in_slices(lambda texts: pa.array([len(token_list(t)) for t in texts.to_pylist()], pa.int32())), T.IntegerType())


def token_rows(rows: DataFrame, key: str, only_content: bool = True) -> DataFrame:
    """(key, tokens) of rows (key, text), made once for each text: the planner repeats a column's expression below a filter, but not this."""
    of, kind = content_list if only_content else token_list, rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n in slices(batch.column("text")):
                own = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays([own.column(key), lists([of(t) for t in own.column("text").to_pylist()], pa.string())], names=[key, "tokens"])

    return rows.select(key, "text").mapInArrow(run, f"{key} {kind}, tokens array<string>")


_WORDS = re.compile(r"\w+")


def highlight_spans(text: Column, terms: Column) -> Column:
    """array<struct<start,end>> of the words that are one of the terms, or share a stem with one; neighbours are merged."""
    stems_of = F.transform(terms, stem)
    words = _alike_spans(text, terms)
    hit = F.filter(words, lambda w: F.array_contains(terms, w["word"]) | F.array_contains(stems_of, stem(w["word"])))

    def merged(hits: Column) -> Column:
        apart = lambda i: F.coalesce(F.get(hits, i)["start"] - F.get(hits, i - 1)["end"] > 1, F.lit(True))
        firsts, lasts = F.filter(hits, lambda w, i: apart(i)), F.filter(hits, lambda w, i: apart(i + 1))
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))

    return let(hit, merged)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _word_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [] if t is None else [(m.group().casefold(), m.start(), m.end()) for m in _WORDS.finditer(t)])


def _spans(words: list[list[tuple[str, int, int]]], first: str) -> pa.Array:
    """Lists of (string, start, end) as one Arrow array."""
    flat, ends = [w for ws in words for w in ws], [0]
    for ws in words:
        ends.append(ends[-1] + len(ws))
    columns = zip(*flat) if flat else ((), (), ())
    parts = [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int32(), pa.int32()))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=[first, "start", "end"]))


def _alike(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, terms in batches:
        for lo, n in slices(texts):
            out = []
            for t, ts in zip(texts.slice(lo, n).to_pylist(), terms.slice(lo, n).to_pylist()):
                # a stem keeps three characters at least, so words of one stem begin alike
                heads = {x[:3] for x in ts or () if x is not None}
                out.append([(w, m.start(), m.end()) for m in _WORDS.finditer(t or "") if (w := m.group().casefold())[:3] in heads])
            yield _spans(out, "word")


def _sentences(texts: pa.Array) -> pa.Array:
    return _spans([[(t[a:b], a, b) for a, b in sentence_spans(t)] if t else [] for t in texts.to_pylist()], "sentence")


#: array<struct<sentence,start,end>>, in code points of the text as it is.
split_sentences = F.arrow_udf(_in_slices(_sentences), T.ArrayType(T.StructType([T.StructField("sentence", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
_alike_spans = F.arrow_udf(_alike, T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))


def register(spark: SparkSession) -> None:
    """Makes the text functions known to SQL as txt_*: built-in ones as SQL functions of the session's catalog, Python-backed ones as UDFs.

    Catalog functions are temporary.  txt_fold, txt_bare, txt_sentences and
    txt_words run in Python; txt_chunks is a table function for lateral joins
    that cuts a text into runs of size words, each sharing overlap with the one
    before.
    """
    spark.udf.register("txt_fold", _fold_case)
    spark.udf.register("txt_bare", _bare)
    spark.udf.register("txt_sentences", split_sentences)
    spark.udf.register("txt_words", _word_spans)
    spark.udtf.register("txt_chunks", WordChunks)
    for name, arguments, body in _SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURN {body}")


#: SQL functions: name, arguments, body.  txt_tokens takes a text that txt_fold has normalized.
_SQL_FUNCTIONS = (
    ("txt_tokens", "x STRING", f"regexp_extract_all(x, r'{TOKEN}', 0)".replace("[-'_.@/+]", r"[-\x27_.@/+]")),
    ("txt_years", "x STRING", f"regexp_extract_all(x, r'{YEAR}', 0)"),
    ("txt_numbers", "x STRING", f"transform(regexp_extract_all(x, r'{NUMBER}', 0), n -> btrim(n, '{BLANKS}'))"),
    ("txt_jaccard", "a ARRAY<STRING>, b ARRAY<STRING>", "CASE WHEN size(a) > 0 AND size(b) > 0 THEN size(array_intersect(a, b)) / size(array_union(a, b)) ELSE 0.0D END"),
)


@F.udtf(returnType="ordinal: int, chunk: string")
class WordChunks:
    """Runs of size white-space words of a text, each sharing overlap with the one before."""

    def eval(self, text: str, size: int, overlap: int):
        words = (text or "").split()
        for k, lo in enumerate(range(0, max(1, len(words) - overlap), size - overlap) if words else ()):
            yield k, " ".join(words[lo : lo + size])
