"""Counts, ratios, the fitted optimum and scores of the toxicity classifier against plain versions."""

import math
import random
from collections import Counter

import numpy as np
from samples import prose
from test_corpus_queries import buckets, plain_score

from sparkloom.llm import toxicity


def test_fit(spark):
    rng = random.Random(6)
    rows = [(prose(rng, 25) + (" you vile rotten worm" if i % 4 == 0 else ""), int(i % 4 == 0 or i % 31 == 0)) for i in range(200)] + [("", 0), ("Ä", 1)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    sets = [buckets(t) for t, _ in rows]
    assert all(s == set(toxicity.ngrams(t).tolist()) for s, (t, _) in zip(sets, rows))
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    toxic, clean = (Counter(b for s, (_, y) in zip(sets, rows) if y == label for b in s) for label in (1, 0))
    ratios = {b: float(model.features.ratios[p - 1]) for b in toxic | clean if (p := int(model.features.places[b]))}
    assert len(ratios) == len(model.features.ratios) == len(model.coefficients) == np.count_nonzero(model.features.places)
    for b in toxic | clean:
        share = (toxic[b] + clean[b]) / (n0 + n1)
        d = abs(toxic[b] - share * n1) / math.sqrt(share * (1 - share) * n1 * n0 / (n0 + n1) + 0.5)
        drawn = (math.log((toxic[b] + 1) / (n1 + 2)) - math.log((clean[b] + 1) / (n0 + 2))) * d**toxicity.STEEPNESS / (d**toxicity.STEEPNESS + toxicity.CHANCE**toxicity.STEEPNESS)
        assert abs(ratios.get(b, 0.0) - drawn) < (1e-9 if abs(drawn) >= toxicity.LEAST else toxicity.LEAST)
    # the regularised loss is flat at the fitted weights
    vectors = [{b: ratios[b] for b in s if b in ratios} for s in sets]
    weight = np.array([toxicity.TOXIC_WEIGHT if y else 1.0 for _, y in rows])
    wrong = weight * np.array([plain_score(model, t) - y for t, y in rows]) / weight.sum()
    assert abs(wrong.sum()) < 2e-3
    for b in sorted(ratios, key=lambda b: -abs(ratios[b]))[:50]:
        slope = sum(w * v.get(b, 0.0) for w, v in zip(wrong, vectors))
        assert abs(slope + toxicity.PENALTY * model.coefficients[model.features.places[b] - 1]) < 2e-3
    assert all(abs(model.score(t) - plain_score(model, t)) < 1e-6 for t, _ in rows)


def test_repeated_rows_of_a_labelled_id_are_one(spark):
    rng = random.Random(1)
    docs = [(k, prose(rng, 20) + " vile worm" * (k % 3 == 0)) for k in range(60)]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    models = [toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels) for rows in (docs, docs + [docs[3]] * 500)]
    assert np.array_equal(models[0].features.places, models[1].features.places) and np.allclose(models[0].coefficients, models[1].coefficients, atol=1e-3)
