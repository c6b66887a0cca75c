"""Claim alignment on labelled pairs, odd rows and long texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as txt
from tesserae.operators import claims, guard

#: Answer, context, whether the answer contradicts the context; the rules were written with these pairs in view.
PAIRS = [
    ("Paris is the capital of France.", "Paris is not the capital of France.", True),
    ("Paris is the capital of France.", "Paris is not the capital of Italy. Paris is the capital of France.", False),
    ("Paris is the capital of France.", "Paris is not the capital of Italy.", False),
    ("Everest is 8849 m high.", "Everest is 8.849 km high.", False),
    ("Everest is 8,849 metres.", "Everest is 9000 metres.", True),
    ("The tower was opened in 1889.", "The tower was opened in 1889 after two years.", False),
    ("The tower was opened in 1888.", "The tower was opened in 1889 after two years.", True),
    ("Einstein was born in 1879.", "Einstein won the prize in 1921.", False),
    ("Einstein was born in 1878.", "Einstein was born in 1879, and he won the prize in 1921.", True),
    ("The shop is never closed.", "The shop is closed on Sunday.", True),
    ("The shop isn't open.", "The shop is open.", True),
    ("The shop is not never open.", "The shop is open.", False),
    ("Water boils at 100 °C.", "Water boils at 212 °F.", False),
    ("Water boils at 90°C.", "Water boils at 212 °F.", True),
    ("The city has 5 million people.", "The city has 5,000,000 people.", False),
    ("The city has 7 million people.", "The city has 5,000,000 people.", True),
    ("Kepler lived in Prague. He did not marry.", "Kepler lived in Prague. He did marry Barbara.", True),
    ("", "x", False),
    (None, None, False),
]
#: Pairs that were written after the rules.
HELD_OUT = [
    ("The bridge is 2 km long.", "The bridge is 2,000 m long.", False),
    ("The bridge is 3 km long.", "The bridge is 2,000 m long.", True),
    ("Marie Curie was not a chemist.", "Marie Curie was a chemist.", True),
    ("Marie Curie was a chemist.", "Curie was a chemist and she was born in Warsaw.", False),
    ("The drive holds 1 TB.", "The drive holds 1000 GB.", False),
    ("The drive holds 512 GB.", "The drive holds 1 TB.", True),
    ("Penguins cannot fly.", "Penguins are birds. They can fly.", True),
    ("Penguins cannot fly.", "Penguins are birds, but they cannot fly.", False),
    ("The war ended in 1944.", "The war began in 1939. It ended in 1945.", True),
    ("The war ended in 1945.", "The war began in 1939. It ended in 1945.", False),
    ("The harbour never freezes.", "The harbour never freezes, although the river does.", False),
    ("The lecture takes 90 minutes.", "The lecture takes 1.5 hours.", False),
    ("The lecture takes 2 hours.", "The lecture takes 90 minutes.", True),
    ("Turnout was 45%.", "Turnout was 45 per cent.", False),
    ("Turnout was 54%.", "Turnout was 45 per cent.", True),
    ("The height of Snowdon is 1085 m.", "Snowdon is 1,085 metres high.", False),
    ("The height of Snowdon is 1500 m.", "Snowdon is 1,085 metres high.", True),
    ("The museum does not charge for entry.", "Visitors pay nothing at the museum.", False),
    ("No trains run on Sunday.", "Trains run on Sunday.", True),
    ("The shop sells bread without salt.", "The shop sells bread.", False),
]


def judged(spark, pairs: list) -> list[tuple[bool, bool]]:
    rows = spark.createDataFrame([(i, a, b, "x") for i, (a, b, _) in enumerate(pairs)], "query_id int, text string, context string, side string")
    got = {r["query_id"]: r["passed"] for r in guard.contradiction(rows).collect()}
    assert len(got) == len(pairs)
    return [(not got[i], p[2]) for i, p in enumerate(pairs)]


def test_known_pairs(spark):
    wrong = [PAIRS[i] for i, (got, want) in enumerate(judged(spark, PAIRS)) if got != want]
    assert not wrong


def test_held_out_pairs(spark):
    both = judged(spark, HELD_OUT)
    hits = sum(got and want for got, want in both)
    precision, recall = hits / sum(got for got, _ in both), hits / sum(want for _, want in both)
    assert precision >= 0.9 and recall >= 0.8, (precision, recall, [HELD_OUT[i] for i, (g, w) in enumerate(both) if g != w])


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, "Rope is old.", "Rope is not old."), (1, "Rope is old.", None), (None, "Tar is 5 kg.", "Tar is 6 kg."), (2, None, "x")], "query_id int, text string, context string")
    got = sorted((str(r["query_id"]), r["passed"], r["score"]) for r in guard.contradiction(rows).collect())
    assert got == [("1", False, 0.0), ("1", False, 0.0), ("2", True, 1.0), ("None", False, 0.0)]
    assert guard.contradiction(rows.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["not ", "Rope ", "5 km ", "1,000", "a-", "and,", "x. ", "इ", "%"])
def test_long_texts_take_linear_time(unit):
    began = time.time()
    n = sum(1 for _ in claims.text_claims(unit * (400_000 // len(unit))))
    assert n >= 0 and time.time() - began < 15


def odd_answers(n: int = 120) -> list[tuple]:
    rng = random.Random(20)
    words = ["Rope", "Tar", "Paris", "not", "never", "It", "5", "6", "5 km", "5,000 m", "5 million", "20%", "old", "opened", "opening", "in", "and", ";", ".", ".", "isn't", "নাম", "না", "पानी", "9" * 400, "°C", "20 °C", "68 °F", "\n"]
    texts = [None, "", *(" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(60))]
    return [(k, rng.choice(texts), rng.choice(texts)) for k in range(n)] + [(k, t, (t or "")[: len(t or "") // 2]) for k, t in enumerate(texts, n)]


def test_answers_are_judged_in_their_rows(spark):
    own = spark.createDataFrame(odd_answers(), "query_id long, text string, context string").localCheckpoint()
    found = claims.conflicts(own)
    # a row that has its id alone needs no exchange of its claims
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    by_rows = sorted(map(tuple, found.collect()))
    assert by_rows == sorted(map(tuple, claims._shuffled_conflicts(own).select(found.columns).collect()))
    assert any(r[4] for r in by_rows) and any(r[6] for r in by_rows)


def test_rows_of_one_id_meet_among_others(spark):
    rows = odd_answers(40)
    rows += [(k % 7 if k % 3 else None, a, b) for k, a, b in rows]
    own = spark.createDataFrame(rows, "query_id long, text string, context string")
    found = claims.conflicts(own)
    assert sorted(map(str, found.collect())) == sorted(map(str, claims._shuffled_conflicts(own).select(found.columns).collect()))


def test_stems_in_python_are_those_of_columns(spark):
    rng = random.Random(8)
    parts = ["run", "n", "s", "ing", "ies", "ness", "ization", "fall", "पानी", "लड़क", "ियों", "ता", "ने", "x", "ę", "বই", "ss", "ed", "é"]
    words = ["", *{"".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(800)}]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", txt.stem(F.col("w")).alias("s")).collect()
    assert all(txt.stem_of(r["w"]) == r["s"] for r in rows)


def test_contradictions_sort_no_claims(spark):
    rows = spark.createDataFrame(odd_answers(), "query_id long, text string, context string")
    plan = guard.contradiction(rows)._jdf.queryExecution().executedPlan().toString()
    # what is shuffled is a row for each clause, not for each word of it
    assert "subject" not in plan and "Window" not in plan
