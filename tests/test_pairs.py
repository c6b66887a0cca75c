import random
from collections import defaultdict
from fractions import Fraction

import pytest

from tesserae.operators import pairs, stats


@pytest.mark.parametrize("most", [pairs.MOST_TERMS, 0])
def test_pairs_equal_brute_force_whatever_the_runs_and_without_a_row_for_each_pair(spark, monkeypatch, most):
    monkeypatch.setattr(pairs, "MOST_TERMS", most)
    r = random.Random(3)
    words = ["é", "zz", "a", "b"] + [f"w{k}" for k in range(40)]
    docs = [(k, [r.choice(words[: r.randrange(1, len(words))]) for _ in range(r.randrange(0, 60))]) for k in range(30)]
    docs += [(100, ["a", "b"] * 20_000), (None, ["a", "é"]), (101, None), (7, ["zz", "a", "w1"])]  # a very common pair, and a document in two rows
    kept = sorted(set(words) - {"w5"})
    rows = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    texts = defaultdict(list)
    for d, ts in docs:
        texts[d] += enumerate(ts or [])
    expected = defaultdict(Fraction)
    for places in texts.values():
        ts = [t for _, t in sorted(places) if t in kept]
        for i, x in enumerate(ts):
            for d in range(1, 6):
                if i + d < len(ts) and ts[i + d] != x:
                    expected[x, ts[i + d]] += Fraction(1, d)
                    expected[ts[i + d], x] += Fraction(1, d)
    expected = {k: float(v) for k, v in expected.items()}
    vocab = spark.createDataFrame([(w,) for w in kept], "term string")
    for run in (pairs.RUN, 1000):  # in one run, and in many that are merged
        monkeypatch.setattr(pairs, "RUN", run)
        monkeypatch.setattr(pairs, "MERGED", run)
        assert {(x["a"], x["b"]): x["weight"] for x in stats.cooccurrence(rows, vocab).collect()} == expected
        own = stats.pairs(rows, vocab)
        of = defaultdict(list)
        for (a, _), w in expected.items():
            of[a].append(w)
        assert {x["term"]: (x["n_contexts"], round(x["weight"], 6)) for x in own.contexts().collect()} == {a: (len(ws), round(sum(ws), 6)) for a, ws in of.items()}
        general = stats.ppmi(stats.cooccurrence(rows, vocab), 3)
        told = lambda df: sorted((x["term"], x["rk"], x["ctx"], round(x["w"], 9)) for x in df.collect())
        assert told(stats.strongest_contexts(own, 3)) == told(general)


def test_sums_of_gram_signatures_equal_those_of_each_gram_whatever_is_held(monkeypatch):
    import numpy as np

    from tesserae.operators import embed

    monkeypatch.setattr(embed._GramSums, "MOST", 8)
    own = embed._GramSums(64, 7)
    terms = ["a", "", "été", "aaaaaaa", "क्या", "😀x", "lorem", "ipsum", "dolor", "sit"]
    for some in (terms[:5], terms[5:], terms[:4] + terms[:4]):
        rows = own.rows(some)
        for t, k in zip(some, rows):
            expected, n, padded = np.zeros(64), 0, f"^{t}$"
            for size in (3, 4, 5):
                for i in range(len(padded) - size + 1):
                    n += 1
                    for at, sign in embed.signature(padded[i : i + size], 64, 7):
                        expected[at] += sign
            assert (own.sums[k] == expected).all() and own.sizes[k] == n


def test_documents_that_a_model_was_fitted_on_are_summed_once(spark, monkeypatch):
    from tesserae.operators import embed

    docs = spark.createDataFrame([(k, ["a", "b", f"w{k % 3}", "c"]) for k in range(12)], "doc_id long, tokens array<string>")
    calls, raw = [], embed._raw
    monkeypatch.setattr(embed, "_raw", lambda *a: calls.append(a) or raw(*a))
    model = embed.fit_ppmi(docs, 16)
    told = lambda df: {r["doc_id"]: [round(x, 9) for x in r["vector"]] for r in df.collect()}
    fitted = told(model.encode(docs))
    assert len(calls) == 1
    assert fitted == told(model.encode(docs.select("*"))) and len(calls) == 2
