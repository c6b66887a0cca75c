"""The text functions as DuckDB SQL, for texts in Latin script: the other side of the comparison."""

from __future__ import annotations

from tesserae.functions import text as txt

LETTER = "a-zÀ-ÖØ-öø-ɏ"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def norm(c: str) -> str:
    """Case folding of Latin text: lower case, and ß as ss."""
    return rf"trim(regexp_replace(replace(replace(lower(coalesce({c}, '')), 'ß', 'ss'), '`', ''''), '\s+', ' ', 'g'))"


def tokens(c: str) -> str:
    return rf"regexp_extract_all({norm(c)}, '[{LETTER}0-9]+(?:[-''_.@/+]+[{LETTER}0-9]+)*')"


def content(c: str) -> str:
    return f"list_filter({tokens(c)}, lambda t: t NOT IN ({quoted(txt.STOPWORDS)}) AND length(t) > 1)"


def stem(t: str) -> str:
    """The suffix ladder for tokens that begin with a Latin letter or a digit."""
    cases = []
    for s in txt.ENGLISH_SUFFIXES:
        base = f"{t}[1:length({t}) - {len(s)}]"
        halved = f"CASE WHEN length({base}) > 3 AND {base}[-1] = {base}[-2] AND {base}[-1] NOT IN ('l', 's', 'z') THEN {base}[1:length({base}) - 1] ELSE {base} END"
        cases.append(f"WHEN ends_with({t}, '{s}') AND length({t}) - {len(s)} >= 3 THEN {halved}")
    return f"CASE WHEN length({t}) <= 3 THEN {t} {' '.join(cases)} ELSE {t} END"


def stems(c: str) -> str:
    return f"list_transform({content(c)}, lambda t: {stem('t')})"


def query_type(c: str) -> str:
    padded = f"(' ' || {norm(c)} || ' ')"
    cases = []
    for kind, phrases in txt.QUERY_TYPES:
        tests = " OR ".join("contains({}, '{}')".format(padded, p.replace("'", "''")) for p in phrases)
        cases.append(f"WHEN {tests} THEN '{kind}'")
    return f"CASE {' '.join(cases)} WHEN split_part({norm(c)}, ' ', 1) IN ('what', 'which') THEN 'definition' ELSE 'factual' END"


def idf(df: str, n: str) -> str:
    return f"ln(({n} - {df} + 0.5) / ({df} + 0.5) + 1)"


def sentences(source: str) -> str:
    """CTEs of a WITH RECURSIVE: sents (doc_id, ordinal, start, stop, sentence) of the table source (doc_id, text), found piece by piece."""
    ends = "".join(sorted(txt.TERMINATORS))
    word = "regexp_replace(replace(lower(regexp_extract(text[greatest(start, e - 1 - 64) + 1 : e - 1], '[^\\s]*\\s*$')), 'ß', 'ss'), '^\\s+|\\s+$|\\.+\\s*$', '', 'g')"
    known = quoted(sorted(txt.ABBREVIATIONS))
    return rf"""sx AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{ends}]*[{ends}]+|[^{ends}]+\z') AS ps FROM {source}),
    sp AS (SELECT doc_id, text, i, list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT AS e, ps[i] AS piece FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM sx)),
    st(doc_id, i, start, e) AS (SELECT doc_id, i, 0::BIGINT, e FROM sp WHERE i = 1 UNION ALL
      SELECT n.doc_id, n.i, CASE WHEN w.piece LIKE '%.' AND (w.word IN ({known}) OR regexp_full_match(w.word, '\p{{L}}') OR (regexp_matches(w.word, '[0-9]$') AND regexp_matches(n.piece, '^[0-9]'))) THEN w.start ELSE w.e END, n.e
      FROM (SELECT st.doc_id, st.i, st.start, st.e, sp.piece, {word.replace('start', 'st.start').replace('e - 1', 'st.e - 1').replace('text[', 'sp.text[')} AS word FROM st JOIN sp ON sp.doc_id = st.doc_id AND sp.i = st.i) w
      JOIN sp n ON n.doc_id = w.doc_id AND n.i = w.i + 1),
    cut AS (SELECT st.doc_id, st.start, max(st.e) AS e, any_value(sx.text) AS text FROM st JOIN sx USING (doc_id) GROUP BY ALL),
    tr AS (SELECT doc_id, start + length(c) - length(regexp_replace(c, '^\s+', '')) AS start, trim(c, E' \t\n\r\f\x0b') AS sentence FROM (SELECT doc_id, start, text[start + 1 : e] AS c FROM cut)),
    longer AS (SELECT * FROM tr WHERE length(sentence) >= 2),
    alone AS (SELECT doc_id, length(text) - length(regexp_replace(text, '^\s+', '')) AS start, trim(text, E' \t\n\r\f\x0b') AS sentence FROM sx WHERE doc_id NOT IN (SELECT doc_id FROM longer)),
    sents AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS ordinal, CAST(start AS INTEGER) AS start, CAST(start + length(sentence) AS INTEGER) AS stop, sentence
      FROM (SELECT * FROM longer UNION ALL SELECT * FROM alone WHERE sentence <> ''))"""
