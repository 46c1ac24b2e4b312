"""Resampling, token counts and hard negatives against brute force and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.llm import negatives, queries, resampling, token_counts
from tests.compare import same

MODEL = queries.vocabulary("piece_bpe_32k.model")


@pytest.mark.parametrize("name", ["op11_resampling", "op13_hard_negatives"])
def test_query_matches_sql(spark, sf, name):
    same(spark, sf, queries.QUERIES[name], queries.SQL[name])


def runs(text, n):
    lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute_resampled(docs, target, c):
    bucket = lambda x: zlib.crc32(x.encode()) % c.buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, runs(x, c.words)[1]))
    for x in target:
        t.update(map(bucket, runs(x, c.words)[1]))
    ss, tt = sum(s.values()) + c.buckets, sum(t.values()) + c.buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * ss / ((s[b] + 1) * tt))) for b in range(c.buckets)}
    rows = []
    for i, x in docs:
        n, f = runs(x, c.words)
        h = int(hashlib.sha256(f"{c.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(y)] for y in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= c.least_words])
    enough = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(enough[: c.percent * len(enough) // 100], 1)}
    return sorted(((r[0], *r[1:4], ranks.get(id(r))) for r in rows), key=repr)


@pytest.mark.parametrize("words", [1, 2, 3])
def test_resampling_by_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(resampling, "_PART", 40)
    rng = random.Random(words)
    make = lambda n, most: " ".join(rng.choice("ab Éclair x9 naïve-ish THE, don't".split()) + str(rng.randrange(most)) for _ in range(n))
    docs = [(i, make(rng.randrange(60), 30)) for i in range(150)] + [(900, None), (901, ""), (902, " ., "), (None, make(30, 9)), (None, make(30, 9)), (7, make(25, 9)), (903, "日本語 " * 30)]
    target = [make(40, 8) for _ in range(9)] + [None, ""]
    c = resampling.Resampling(buckets=211, words=words, percent=25)
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, score string, rank string").repartition(5)
    got = resampling.resampled(frame, spark.createDataFrame([(x,) for x in target], "text string"), c).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_resampled(docs, target, c)


def test_resampling_draws_towards_the_target(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"{'good' if i % 4 == 0 else 'other'}{rng.randrange(200)}" for _ in range(30))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = resampling.resampled(docs, docs.where("doc_id % 4 = 0").limit(50)).toPandas()
    drawn = got[got["rank"].notna()]
    assert len(drawn) == 80 and (drawn.doc_id % 4 == 0).all() and sorted(drawn["rank"]) == list(range(1, 81))


def test_resampling_of_ties_and_empty_tables(spark):
    shape = "doc_id long, text string"
    same_rows = spark.createDataFrame([(5, "word " * 20)] * 60, shape).repartition(6)
    got = resampling.resampled(same_rows, same_rows.limit(0)).toPandas()
    assert sorted(got["rank"].dropna()) == [1, 2, 3, 4, 5, 6] and got.score.nunique() == 1
    none = spark.createDataFrame([], shape)
    assert resampling.resampled(none, none).count() == 0 and resampling.resampled(none, same_rows).count() == 0


def odd_texts():
    rng = random.Random(3)
    words = "the of straße naïve don't 2024 x 日本語 🀄 <s> </s> ▁ aaaa ....".split()
    texts = [None, "", " ", "a", "   ", "\x00\n\t", "🀄🀄🀄", "ﬁ①"]
    texts += [" ".join(rng.choice(words) + rng.choice(["", ",", "ing", " ", "\n", "--"]) for _ in range(rng.randrange(1, 400))) for _ in range(40)]
    texts += ["a" * 3000, "ab" * 1500, " " * 1000, "aaaa " * 700, "🀄" * 500, "日本" * 900, "=" * 2000 + "x" + "=" * 777, "1234567890" * 200]
    texts += ["".join(rng.choice("ab e\n") for _ in range(2500)) for _ in range(6)]
    return texts


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (100, 25), (500, 60)])
def test_token_counts_equal_the_library(spark, chunk, overlap):
    from sentencepiece import SentencePieceProcessor

    texts = odd_texts()
    sp = SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, texts[20], "x", "y"), (3, texts[-1], "x", "y"), (3, texts[-1], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, n_tokens string")
    got = token_counts.token_counts(docs, token_counts.TokenCounts(MODEL, chunk, overlap, limit=500)).collect()
    want = sorted(repr((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 500)) for i, t, *_ in rows)
    assert sorted(repr(tuple(r)) for r in got) == want


def test_token_counts_of_the_query(spark, sf):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=MODEL)
    sf = sf.replace("sf0.001", "sf0.01")
    docs = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id", ignore_index=True)
    got = queries.op12_token_counts(spark, sf).toPandas().sort_values("doc_id", ignore_index=True)
    n = [len(sp.encode(t)) for t in docs.text]
    assert (docs.text.str.len() > 16_384).any() and got.n_tokens.tolist() == n and got.over_limit.tolist() == [x > 4096 for x in n]
    assert got.n_bytes.tolist() == [len(t.encode()) for t in docs.text]


def test_splices_hold_without_wider_overlaps(spark):
    """Ordinary texts are spliced in the first round; a text without any common place is widened, then encoded whole."""
    model = token_counts.pieces(MODEL)
    c = token_counts.TokenCounts(MODEL, 200, 50)
    rng = random.Random(5)
    texts = {f"t{i}": " ".join(rng.choice(["house", "river,", "Straße", "of", "x1"]) for _ in range(300)) for i in range(30)} | {"run": "a" * 5000}
    frame = spark.createDataFrame(list(texts.items()), "digest string, text string")
    got = dict(map(tuple, token_counts._spliced(frame, c, 200, 50).collect()))
    assert all(got[k] == len(model.sp.encode(t)) for k, t in texts.items() if k != "run")
    assert got["run"] in (None, len(model.sp.encode(texts["run"])))


def test_token_counts_of_no_rows(spark):
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), token_counts.TokenCounts(MODEL)).count() == 0


def brute_negatives(rows, c):
    use = [(i, y, np.floor(256 * np.array(e, float))) for i, y, e in rows if None not in (i, y, e) and len(e) == c.dims and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, y, e in use:
        if i % c.every:
            continue
        scored = sorted((-int(e @ x), j, z) for j, z, x in use if j != i)
        for p, j, _ in [s for s in scored if s[2] == y][: c.positives]:
            fits = [s for s in scored if s[2] != y and c.least * -p <= 100 * -s[0] <= c.most * -p][: c.negatives]
            out += [(i, j, k, s[1], -p, -s[0]) for k, s in enumerate(fits, 1)]
    return sorted(out)


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("place", T.StringType()), T.StructField("group", T.StringType())])


def cloud(kind, n=700, dims=8):
    rng = np.random.default_rng(4)
    if kind == "clusters":
        centre = rng.normal(size=(12, dims))
        x = centre[rng.integers(12, size=n)] + 0.05 * rng.normal(size=(n, dims))
    elif kind == "norms":
        x = rng.normal(size=(n, dims)) * rng.lognormal(0, 1, (n, 1))
    else:  # a third is one vector, the rest has many ties
        x = np.where(rng.random((n, 1)) < 0.35, 0.25, rng.integers(-1, 3, (n, dims)) / 4)
    return [(int(i), int(y), [float(v) for v in np.float32(e)]) for i, y, e in zip(rng.permutation(n) - 40, rng.integers(4, size=n), x, strict=True)]


@pytest.mark.parametrize("kind", ["clusters", "norms", "ties"])
@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_by_brute_force(spark, kind, small):
    c = negatives.Negatives(dims=8, every=9, **({"anchors": 7, "block": 50, "least_pivots": 3} if small else {}))
    rows = cloud(kind)
    rows += [(None, 1, rows[0][2]), (900, None, rows[1][2]), (909, 1, None), (918, 1, [None, *rows[2][2][1:]]), (927, 1, [math.nan, *rows[2][2][1:]]), (936, 1, [math.inf, *rows[2][2][1:]]), (945, 1, [1.0]), (954, 77, rows[3][2])]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(3)
    got = sorted(tuple(r) for r in negatives.hard_negatives(frame, c).collect())
    assert got == brute_negatives(rows, c) and len(got) > 100


def test_vectors_go_only_to_groups_they_might_serve(spark):
    """Far clusters are not sent to each other's groups."""
    c = negatives.Negatives(dims=8, every=9)
    rng = np.random.default_rng(1)
    x = 5 * np.eye(8)[rng.integers(8, size=800)] + 0.2 * rng.normal(size=(800, 8))
    frame = spark.createDataFrame([(i, i % 2, [float(v) for v in e], "x", "y") for i, e in enumerate(x)], VECTORS)
    sent = []
    dealt = negatives._dealt

    def watched(cells, g, near, c):
        found = dealt(cells, g, near, c)
        sent.append((near, found[0].count()))
        return found

    negatives._dealt = watched
    try:
        assert negatives.hard_negatives(frame, c).count() > 0
    finally:
        negatives._dealt = dealt
    assert [n for n, _ in sent] == [True, False, True, False] and sum(n for near, n in sent if not near) < 0.5 * 2 * 7 * 800


def test_hard_negatives_of_few_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(none).count() == 0
    one = spark.createDataFrame([(0, 1, [0.5] * 64, "x", "y")], VECTORS)
    got = negatives.hard_negatives(one)
    assert got.count() == 0 and got.dtypes == spark.createDataFrame([], negatives.SHAPE).dtypes
    twice = spark.createDataFrame([(0, 1, [0.5] * 64, "x", "y")] * 2 + [(1, 1, [0.5] * 64, "x", "y")] * 2 + [(2, 2, [0.4] * 64, "x", "y")], VECTORS)
    assert negatives.hard_negatives(twice).count() == 4  # two anchors, two positives each
    assert negatives.hard_negatives(twice.withColumn("extra", F.lit(1))).count() == 4
