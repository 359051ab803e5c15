"""The toxicity score of every text against a plain noisy-or over its sentences."""

import math
import random
import re

import pytest

pytest.importorskip("entitysurv.llm")

from entitysurv.llm import toxicity  # noqa: E402

MARKS = ".,;:!?\"'()[]{}"
WEIGHTS = {"dolt": 9.0, "^snot": 7.5, "^snotf": 3.0, "über": 8.0, "nice": -4.0, "^nice": -2.0, "a": 0.25, "(": 50.0}


def brute(text, bias):
    clean, offending = 1.0, 0
    sentences = [s for s in re.findall(r"[^.!?\n]+[.!?\n]*|[.!?\n]+", text or "") if s.strip()]
    for s in sentences or [""]:
        held = set()
        for word in re.split("[\x20\x09-\x0d]+", s.lower()):
            w = word.strip(MARKS)
            held |= {w, *(f"^{w[:n]}" for n in (4, 5) if len(w) > n)} if w else set()
        p = 1 / (1 + math.exp(-(bias + sum(WEIGHTS[f] for f in held if f in WEIGHTS))))
        clean, offending = clean * (1 - p), offending + (p >= 0.5)
    return 1 - clean, offending


@pytest.mark.parametrize("bias", [-9.0, -1.0])
def test_scores_are_a_noisy_or_over_sentences(spark, bias):
    rng = random.Random(8)
    pieces = ["dolt", "Dolt!", "(dolt)", "snot", "snotty", "snotface,", "ÜBER", "über", "nice", "nicely", "a", "word", "...", "\n", "?!", "(", " ", "\t", "dolts"]
    texts = [None, "", " \n\t", " ", ".", "dolt", "a" * 5000, "word " * 20_000 + "dolt."]
    texts += ["".join(rng.choice(pieces) + rng.choice([" ", " ", ". ", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int").repartition(5)
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.Model(WEIGHTS, bias)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want, offending = brute(t, bias)
        assert got[i].score == pytest.approx(want, abs=1e-9) and len(got[i].offending) == offending
    kept = {r.doc_id for r in toxicity.filter_toxic(docs, toxicity.Model(WEIGHTS, bias)).collect()}
    assert kept == {i for i, t in enumerate(texts) if brute(t, bias)[0] < 0.5}
