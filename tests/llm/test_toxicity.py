"""The toxicity model against brute force and on phrases that all texts of a class share."""

import math
import random
import zlib

import numpy as np
import pytest

from barwright.llm import toxicity
from barwright.llm.common import lower_words

TRAINED = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5]


def fitted(spark, texts, c=toxicity.Toxicity()):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in zip(TRAINED, texts, strict=False)], "doc_id long, text string")
    return toxicity.train(docs, spark.createDataFrame([(i, y) for i, (_, y) in zip(TRAINED, texts, strict=False)], "doc_id long, toxic int"), c)


@pytest.mark.parametrize("copies", [False, True])
def test_a_phrase_that_all_toxic_texts_share(spark, copies):
    rng = random.Random(3)
    fill = lambda: [f"f{rng.randrange(600)}" for _ in range(20)]
    phrase = {1: "you vile slurword go", 0: "you kind person go"}

    def text(y):
        w = fill()
        return " ".join([*w[:9], phrase[y], *w[9:]])

    texts = [(text(i % 2), i % 2) for i in range(1200)]
    if copies:  # a third of all rows is one toxic text
        texts += [(texts[1][0], 1)] * 600
    model = fitted(spark, texts)
    scorer = toxicity._Scorer(model, toxicity.Toxicity())
    assert min(scorer(text(1)) for _ in range(30)) > 0.9 and max(scorer(text(0)) for _ in range(30)) < 0.1


def test_probabilities_and_fit_by_brute_force(spark):
    """Context counts, Kneser-Ney probabilities and the features without a text's own contexts, from dictionaries."""
    rng = random.Random(9)
    word = {y: [f"{'abx'[y]}{i}" for i in range(25)] + [f"c{i}" for i in range(25)] for y in (0, 1)}
    texts = [(" ".join(rng.choice(word[i % 2]) for _ in range(rng.randrange(1, 15))), i % 2) for i in range(200)]
    texts += texts[:10]
    seen = {0: {}, 1: {}}
    for t, y in texts:
        w = lower_words(t)
        for pair in zip([b"", *w], w, strict=False):
            seen[y].setdefault(pair, set()).add(t)
    model = fitted(spark, texts)
    hashes, cells = toxicity._Hashes(), model.tables.contexts.shape[1]
    vocabulary = {v for y in seen for _, v in seen[y]}
    cell = lambda v: hashes[v] % cells
    assert len({cell(v) for v in vocabulary}) == len(vocabulary)
    n = {y: {v: sum(p[1] == v for p in seen[y]) for v in vocabulary} for y in seen}
    assert all(model.tables.contexts[y][cell(v)] == n[y][v] for y in n for v in vocabulary) and model.tables.contexts.sum() == sum(map(len, seen.values()))
    once, twice = ({y: sum(k == m for k in n[y].values()) for y in n} for m in (1, 2))
    discount = {y: once[y] / (once[y] + 2 * twice[y]) if once[y] and twice[y] else 0.75 for y in n}
    total = {y: sum(n[y].values()) for y in n}
    kept = {y: sum(max(k - discount[y], 0) for k in n[y].values()) / total[y] for y in n}
    least = min(kept.values())

    def features(t, y=None):
        w = lower_words(t)
        pairs, ratio = set(zip([b"", *w], w, strict=False)), []
        for v in w:
            p = {}
            for z in n:
                k = n[z][v] - (sum(q[1] == v and seen[z][q] == {t} for q in pairs) if z == y else 0)
                p[z] = max(k - discount[z], 0) * least / kept[z] / total[z] + (1 - least) * (n[0][v] + n[1][v] + 0.5) / (sum(total.values()) + cells / 2)
            ratio.append(math.log(p[1] / p[0]))
        top = sorted([*ratio, 0, 0, 0][: max(3, len(ratio))])[-3:]
        return [np.mean(ratio), top[-1], np.mean(top), math.sqrt(np.mean([max(r - 1.5, 0) for r in ratio])), math.log1p(len(ratio))]

    for t, _ in texts[:40]:
        assert toxicity._features(hashes.of(lower_words(t)), model.tables) == pytest.approx(features(t), rel=1e-5, abs=1e-6)
    distinct = list(dict.fromkeys(texts))  # all are in the sample
    x, y = np.array([features(t, y) for t, y in distinct]), np.array([y for _, y in distinct], float)
    centre, scale = x.mean(0), x.std(0)
    assert model.centre == pytest.approx(centre, rel=1e-4, abs=1e-5) and model.scale == pytest.approx(scale, rel=1e-4, abs=1e-5)
    assert model.weights == pytest.approx(toxicity._logistic((x - centre) / scale, y), rel=1e-3, abs=1e-3)
