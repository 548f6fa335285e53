import random
from zlib import crc32

import numpy as np

from wayfold.llm.toxicity import ToxicityParams, fit_label_model, toxicity_scores


def corpus(n=900):
    r = random.Random(1)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rude = ["grobian", "flegel", "lump", *(f"schuft{x}" for x in ("en", "ig", "ei", "chen", "ling", "tum"))]
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.2
        w = [r.choice(plain) for _ in range(r.randint(30, 80))]
        for _ in range(r.randint(3, 6) if toxic else r.random() < 0.05):
            w.insert(r.randrange(len(w)), r.choice(rude))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    df = spark.createDataFrame([*rows, (5000, None), (5001, ""), (None, "x"), (0, rows[0][1])], "doc_id long, text string").selectExpr("*", "1.0 as score", "'de' as lang")
    got = toxicity_scores(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) + 4 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    by = {x.doc_id: x for x in got}
    assert all(by[i].held_out == (crc32(str(i).encode()) % 3 == 1) for i, _ in rows)
    test = [(t, by[i].predicted) for i, t in labels if by[i].held_out]
    assert sum(a == b for a, b in test) / len(test) > 0.97
    assert by[5000].predicted == 0 and by[5001].predicted == 0


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x.score for x in toxicity_scores(df, none).collect()] == [0.0]
    assert toxicity_scores(df.limit(0), none).count() == 0


def test_label_model_recovers_rates_and_dependence():
    r = np.random.default_rng(0)
    y = r.random(200_000) < 0.3
    up, down = np.array([0.9, 0.8, 0.7, 0.85, 0.6]), np.array([0.1, 0.05, 0.2, 0.1, 0.3])
    v = np.where(r.random((len(y), 5)) < np.where(y[:, None], up, down), 1.0, -1.0)
    v = np.column_stack([v, np.where(r.random(len(y)) < 0.95, v[:, 4], -v[:, 4])])
    m = fit_label_model(v.mean(0), v.T @ v / len(y), 0.3, ToxicityParams())
    assert m.dependent == [(4, 5)] and np.abs(m.rates[1][:5] - up).max() < 0.05 and np.abs(m.rates[0][:5] - down).max() < 0.05
    assert m.weight[4] < 0.7 and m.weight[0] == 1
