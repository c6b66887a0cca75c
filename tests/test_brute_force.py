"""The queries that have no SQL, held against plain Python over the same whole tables."""

import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from tesserae.functions import text as txt
from tesserae.operators import chunk, claims as claim_rules, embed, guard
from tesserae.plans import registry

SF = "/root/testdata/sf0.001"
LATIN = "0-9a-zÀ-ÖØ-öø-ɏ"
TOKEN = re.compile(rf"[{LATIN}]+(?:[-'_.@/+]+[{LATIN}]+)*")


def tokens(text) -> list:
    folded = " ".join(unicodedata.normalize("NFKC", text or "").translate(txt._FOLDS).split()).casefold()
    return TOKEN.findall(folded)


def content(text) -> list:
    return [t for t in tokens(text) if t not in txt.STOPWORDS and len(t) > 1]


def stem(t: str) -> str:
    if len(t) <= 3:
        return t
    for s in txt.ENGLISH_SUFFIXES:
        if t.endswith(s) and len(t) - len(s) >= 3:
            base = t[: -len(s)]
            return base[:-1] if len(base) > 3 and base[-1] == base[-2] and base[-1] not in "lsz" else base
    return t


@pytest.fixture(scope="module")
def docs(duck) -> dict:
    return dict(duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())


@pytest.fixture(scope="module")
def bags(docs) -> dict:
    return {i: content(t) for i, t in docs.items()}


@pytest.fixture(scope="module")
def idf(bags) -> dict:
    df = Counter(t for b in bags.values() for t in set(b))
    n = len(bags)
    return {t: math.log((n - d + 0.5) / (d + 0.5) + 1) for t, d in df.items()}


def rows(spark, name: str) -> list:
    return registry.QUERIES[name](spark, SF).collect()


def unit(v):
    size = np.linalg.norm(v)
    return v / size if size > 1e-12 else v


@pytest.fixture(scope="module")
def ppmi(bags, idf):
    """Term vectors, raw document vectors and documents with the common direction taken out."""
    df = Counter(t for b in bags.values() for t in set(b))
    cooc = defaultdict(float)
    for b in bags.values():
        kept = [t for t in b if df[t] >= 2]
        for i, t in enumerate(kept):
            for d in range(1, 6):
                if i + d < len(kept) and kept[i + d] != t:
                    cooc[t, kept[i + d]] += 1 / d
                    cooc[kept[i + d], t] += 1 / d
    marginal = defaultdict(float)
    for (a, _), w in cooc.items():
        marginal[a] += w
    total, smooth = sum(marginal.values()), sum(m**0.75 for m in marginal.values())
    contexts = defaultdict(list)
    for (a, b), w in cooc.items():
        x = math.log((w / total) / ((marginal[a] / total) * (marginal[b] ** 0.75 / smooth)))
        if x > 0:
            contexts[a].append((x, b))
    signatures, vectors = {}, {}
    for t, found in contexts.items():
        v = np.zeros(embed.DIM)
        for x, c in sorted(found, key=lambda p: (-round(p[0], 9), p[1]))[:64]:
            for i, s in signatures.setdefault(c, embed.signature(c)):
                v[i] += x * s
        vectors[t] = unit(v)
    stand_in = {}
    for t in sorted(vectors, key=lambda t: (-df[t], t)):
        stand_in.setdefault(stem(t), t)
    raw = {}
    for i, b in bags.items():
        v = np.zeros(embed.DIM)
        for t in b:
            use = t if t in vectors else stand_in.get(stem(t))
            if use:
                v += idf[t] * vectors[use]
        raw[i] = unit(v)
    matrix = np.array([v for v in raw.values() if np.linalg.norm(v) > 1e-12])
    common = np.full(embed.DIM, 1 / math.sqrt(embed.DIM))
    for _ in range(embed.COMMON_ROUNDS):
        common = unit(matrix.T @ (matrix @ common))
    return vectors, {i: unit(v - (v @ common) * common) for i, v in raw.items()}


@pytest.fixture(scope="module")
def chars(bags, idf) -> dict:
    signatures, out = {}, {}
    for i, b in bags.items():
        v = np.zeros(embed.DIM)
        for t, n in Counter(b).items():
            padded = f"^{t}$"
            grams = [padded[k : k + size] for size in (3, 4, 5) for k in range(len(padded) - size + 1)]
            for g in grams:
                for at, s in signatures.setdefault(g, embed.signature(g, seed=embed.SEED ^ embed.CHAR_SEED)):
                    v[at] += n * idf[t] / math.sqrt(len(grams)) * s
        out[i] = unit(v)
    return out


def near(got: list, want: dict) -> None:
    assert {r["doc_id"] for r in got} == set(want) and len(got) == len(want)
    assert max(np.abs(np.array(r["vector"]) - want[r["doc_id"]]).max() for r in got) < 2e-4


def test_ppmi_encode(spark, ppmi):
    near(rows(spark, "ppmi_encode"), ppmi[1])


def test_char_encode(spark, chars):
    near(rows(spark, "char_encode"), chars)


def test_composite_encode(spark, ppmi, chars):
    near(rows(spark, "composite_encode"), {i: unit(0.7 * ppmi[1][i] + 0.3 * chars[i]) for i in chars})


def test_term_neighbours(spark, duck, ppmi):
    vectors, _ = ppmi
    names = sorted(vectors)
    matrix = np.array([vectors[t] for t in names])
    got = defaultdict(dict)
    for r in rows(spark, "term_neighbours"):
        got[r["term"]][r["other"]] = r["score"]
    asked = {t for (x,) in duck.execute("SELECT text FROM benchmark").fetchall() for t in content(x)}
    known = {t: vectors.get(t, vectors.get(stem(t))) for t in asked if t in vectors or stem(t) in vectors}
    assert set(got) == set(known)
    for t, v in known.items():
        scores = {names[k]: s for k, s in enumerate(matrix @ v) if names[k] != t}
        best = sorted(scores.values(), reverse=True)[:8]
        assert len(got[t]) == 8 and np.allclose(sorted(got[t].values(), reverse=True), best, atol=2e-4)
        assert all(abs(scores[o] - s) < 2e-4 for o, s in got[t].items())


SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
NUMBER = regex.compile(rf"(?i)(?<![\w.])(?:\p{{Nd}}{{1,3}}(?:,\p{{Nd}}{{3}})+|\p{{Nd}}+(?:\.\p{{Nd}}+)?){SPACE}?(?:{txt.UNITS})?(?!\w)")
YEAR = regex.compile(r"(?<!\w)(?:1[0-9]{3}|20[0-9]{2})(?!\w)")
PROPER = regex.compile(rf"(?<!\w)[A-Z][a-z]{{2,}}(?:{SPACE}+(?:of|de|van|der|the|and)?{SPACE}*[A-Z][a-z]{{2,}})*(?!\w)")


def numbers(text: str) -> list:
    return [x.strip() for x in NUMBER.findall(text)]


def distinct(values: list) -> list:
    seen: dict = {}
    for v in values:
        seen.setdefault(v.lower(), v)
    return list(seen.values())


def claims(text: str) -> list:
    named = [x.strip() for x in PROPER.findall(text) + re.findall(r'"([^"]{2,80})"', text)]
    entities = distinct([x for x in named if len(x) > 2 and x.lower() not in txt.STOPWORDS])
    return distinct(numbers(text) + YEAR.findall(text) + entities)


def test_extract_numbers(spark, duck):
    want = {i: numbers(h or "") for i, h in duck.execute("SELECT page_id, html FROM pages").fetchall()}
    got = rows(spark, "extract_numbers")
    assert len(got) == len(want) and {r["page_id"]: (r["n"], r["numbers"]) for r in got} == {i: (len(n), "|".join(n)) for i, n in want.items()}


def test_extract_claims(spark, docs):
    got = rows(spark, "extract_claims")
    assert len(got) == len(docs) and {r["doc_id"]: r["claims"] for r in got} == {i: "|".join(claims(t or "")) for i, t in docs.items()}


def clause_conflicts(answer: str, context: str) -> dict:
    """(sentence, clause) to (words, opposed words, numbers, unlike numbers), each claim of the answer held against all of the context."""

    def of(text: str) -> list:
        out = []
        for sentence, clause, subject, word, dimension, counted, value, exact, negated in claim_rules.text_claims(text):
            dimension = f"count of {stem(counted)}" if dimension == "count" else dimension
            if word is None or stem(word) != stem(subject):
                out.append((sentence, clause, stem(subject), word and stem(word), dimension, value, exact, negated))
        return out

    theirs, out = of(context), defaultdict(lambda: [0, 0, 0, 0])
    for sentence, clause, subject, word, dimension, value, exact, negated in of(answer):
        row = out[sentence, clause]
        if word:
            signs = {c[7] for c in theirs if c[2:4] == (subject, word)}
            row[0] += 1
            row[1] += signs == {not negated}
        else:
            values = [c[5] for c in theirs if c[2] == subject and c[4] == dimension and not c[3]]
            row[2] += 1
            row[3] += bool(values) and all(abs(value - v) > (0 if exact else claim_rules.TOLERANCE * max(abs(value), abs(v))) for v in values)
    return {k: tuple(v) for k, v in out.items()}


def test_output_guards(spark, duck):
    turns = duck.execute("SELECT conv_id || '-' || turn, role, coalesce(text, ''), coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') FROM conversations").fetchall()
    want = {}
    for i, role, text, context in turns:
        if role == "assistant":
            own = claims(text)
            support = sum(c.lower() in context.lower() for c in own) / len(own) if own else 1.0
            missing = len(set(numbers(text)) - set(numbers(context)))
            found = clause_conflicts(text, context).values()
            against = sum(u > 0 or 2 * o > w for w, o, _, u in found)
            want |= {(i, "entity_support"): (support >= 0.72, round(support, 6)), (i, "numbers"): (missing == 0, float(missing)), (i, "contradiction"): (against == 0, round(1 - against / len(found), 6) if found else 1.0)}
    got = rows(spark, "output_guards")
    assert len(got) == len(want) and {(r["query_id"], r["name"]): (r["passed"], r["score"]) for r in got} == want
    assert all(r["action"] == ("allow" if r["passed"] else "clarify" if r["name"] == "contradiction" else "abstain") for r in got)


def test_document_conflicts(spark, docs):
    want = {}
    for i, text in docs.items():
        half = (text or "")[: len(text or "") // 2]
        for k, v in clause_conflicts(text or "", half).items():
            want[i, *k] = v
    got = rows(spark, "claim_conflicts")
    assert len(got) == len(want) and {(r["doc_id"], r["sentence"], r["clause"]): (r["n_words"], r["n_opposed"], r["n_numbers"], r["n_unlike"]) for r in got} == want


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_asr_repair(spark, duck, bags):
    df = Counter(t for b in bags.values() for t in set(b))
    want, best = set(), {}
    for i, text in duck.execute("SELECT conv_id || '-' || turn, text FROM conversations WHERE role = 'user'").fetchall():
        for t in set(content(text)) - set(df):
            if t not in best:
                found = [(d, -df[o], o) for o in df if abs(len(o) - len(t)) <= 2 and (d := edits(t, o)) <= 2]
                best[t] = min(found)[2] if found else None
            if best[t]:
                want.add((i, t, best[t]))
    got = [(r["query_id"], r["term"], r["repair"]) for r in rows(spark, "asr_repair")]
    assert len(got) == len(want) and set(got) == want


def test_extractive_answers(spark, duck, docs, idf):
    queries = {i: content(t) for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()}
    hits = defaultdict(list)
    for i, doc, rank in duck.execute(f"SELECT query_id, chunk_id, rank FROM ({registry.ORACLES['bm25_topk']})").fetchall():
        hits[i].append((rank, doc))
    want = {}
    for i, found in hits.items():
        terms = set(queries[i])
        total = sum(idf.get(t, 0.0) for t in terms)
        scored = []
        for rank, doc in found:
            for k, (lo, hi) in enumerate(txt.sentence_spans(docs[doc] or "")):
                toks = tokens(docs[doc][lo:hi])
                score = sum(idf.get(t, 0.0) for t in terms & set(toks)) / total if total else 0.0
                scored.append((score, rank, k, doc, docs[doc][lo:hi], len(toks)))
        best = sorted((s for s in scored if s[0] >= 0.08), key=lambda s: (-round(s[0], 12), s[1], s[2], s[3]))[:4]
        kept, used = [], 0
        for n, s in enumerate(best):
            used += s[5]
            if used <= 110 or n == 0:
                kept.append(s)
        marks = {x: k for k, x in enumerate(sorted({(s[1], s[3]) for s in kept}), 1)}
        want[i] = (" ".join(f"{s[4]} [{marks[s[1], s[3]]}]" for s in kept), len(kept), not kept)
    got = rows(spark, "extractive_answers")
    assert len(got) == len(want)
    assert {r["query_id"]: (r["text"], max(r["n_citations"] or 0, 0), r["abstained"]) for r in got} == want


def test_chunks_hold_every_token(spark, docs):
    for name, most in (("chunk_recursive", chunk.RECURSIVE_MAX + chunk.RECURSIVE_MIN + 3 * chunk.RECURSIVE_OVERLAP), ("chunk_proposition", chunk.PROPOSITION_MAX)):
        texts = defaultdict(list)
        for r in rows(spark, name):
            texts[r["doc_id"]].append((r["ordinal"], r["text"], r["token_count"]))
        for i, t in docs.items():
            own = sorted(texts[i])
            assert [o for o, _, _ in own] == list(range(len(own)))
            assert all(n == len(tokens(x)) and n <= most for _, x, n in own)
            joined = []
            for k, (_, x, _) in enumerate(own):
                words = x.split()
                joined += words[chunk.RECURSIVE_OVERLAP if name == "chunk_recursive" and k and len(own[k - 1][1].split()) >= 0 else 0 :] if name == "chunk_recursive" and k else words
            if name == "chunk_proposition" or all(len(x.split()) > 2 * chunk.RECURSIVE_OVERLAP for _, x, _ in own):
                assert re.sub(r"[\W_]", "", "".join(joined)) == re.sub(r"[\W_]", "", t or "") or not tokens(t)
