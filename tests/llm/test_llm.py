"""Each operator against a brute-force version, and on odd tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barwright.llm import line_chunks, media, mixing, near_dedup, packing, passages, queries, syncmers, token_files, toxicity, url_filter
from barwright.llm.common import new_path
from barwright.llm.tokens import WordEncoder
from tests.compare import same

CLASHES = ["sig", "n", "hash", "draws", "kept_text", "score", "a.b", "__id", "__key", "__row", "place", "b`c"]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + x.replace("`", "``") + "` string" for x in CLASHES)


@pytest.fixture(scope="module")
def docs(sf):
    return pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id", ignore_index=True)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    texts = [None, "", " \n ", "one", "a b", "same text here\nand more of it\nand a third", "same text here\nand more of it\nand a third", long, long + " more", "😀 é日本 <|endoftext|> x"]
    rows = [(i if i != 3 else None, t, None, None if i % 4 == 0 else f"s{i % 3}", 1, *("x",) * len(CLASHES)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, None, None, None, None, *("x",) * len(CLASHES))]
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def linked(texts, k, percent):
    sets, root = {i: shingles(t, k) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_all_pairs(spark, docs, k, percent):
    rng = random.Random(2)
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    base = " ".join(f"v{rng.randrange(9999)}" for _ in range(150)).split()
    for i in range(120):  # a group of near copies, some too far from the others
        copy = list(base)
        for p in rng.sample(range(150), rng.choice([1, 2, 4, 9])):
            copy[p] = f"z{i}"
        texts[10_000 + i] = " ".join(copy)
    sets, want = linked(texts, k, percent)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), near_dedup.NearDedup(words=k, percent=percent)).toPandas()
    assert len(got) == len(texts)
    assert {r.doc_id: r.component_id for r in got.itertuples()} == want
    assert {r.doc_id: r.n_shingles for r in got.itertuples()} == {i: len(s) for i, s in sets.items()}
    assert (got.kept == (got.doc_id == got.component_id)).all()


def test_links_of_sets_around_the_sketch_size(spark):
    """Sets of 480 to 620 shingles, on both sides of a whole sketch, at and just above the limit; their own values are rare
    and the common ones frequent, so that a prefix that is too short would hold unshared values only."""
    rng, rows, want = random.Random(4), [], {}
    for i in range(160):
        n = rng.randrange(480, 526)
        inner = [f"c{i}x{j}" for j in range(n + 2)]
        most = int(n / 0.85) + 1
        extra = next(e for e in range(most - n, -1, -1) if 100 * n >= 85 * (n + e)) if i % 2 else rng.randrange(60)
        rows += [(2 * i, " ".join(inner)), (2 * i + 1, " ".join(inner + [f"d{i}x{j}" for j in range(extra)]))]
        sets = [shingles(t, 3) for _, t in rows[-2:]]
        want[2 * i + 1] = 2 * i if 100 * len(sets[0] & sets[1]) >= 85 * len(sets[0] | sets[1]) else 2 * i + 1
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dedup.NearDedup(words=3, percent=85)).toPandas()
    assert {r.doc_id: r.component_id for r in got.itertuples() if r.doc_id % 2} == want and sum(v % 2 == 0 for v in want.values()) > 150


@pytest.mark.parametrize("percent", [85, 80])
def test_bands_hold_every_size_that_may_link(spark, percent):
    """The band of a size is left out only if no place allows it; a late place leaves few of them."""
    c = near_dedup.NearDedup(words=3, percent=percent)
    sizes = [1, 2, 7, 40, 398, 505, 512, 513, 560, 640, 3000]
    pairs = spark.createDataFrame([(n, m) for n in sizes for m in range(max(1, n * percent // 100 - 2), n * 100 // percent + 3)], "u_n int, w_n int")
    pairs = pairs.withColumns({"u_k": F.least("u_n", F.lit(512)), "w_k": F.least("w_n", F.lit(512)), "w_pos": F.lit(0)}).withColumn("u_pos", F.explode(F.expr("sequence(0, u_k, 3)")))
    may, bands = near_dedup._may_link(c, "u", "w"), near_dedup._bands(c, F.col("u_n"), F.col("u_k") - F.col("u_pos"))
    got = pairs.select("u_n", "u_pos", may.alias("may"), F.size(bands).alias("many"), F.array_contains(bands, near_dedup._band(F.col("w_n"))).alias("held")).toPandas()
    assert got.may.sum() > 1000 and got.held[got.may].all()
    assert (got.many[(got.u_n == 398) & (got.u_pos == 0)] > 15).all() and (got.many[(got.u_n == 398) & (got.u_pos > 398 * (100 - percent) / 100 + 2)] == 0).all()


def test_two_members_meet_in_their_first_list_only(spark, monkeypatch):
    """Versions of a text that share their changes, most of them just too far apart, have many lists in common."""
    rng, texts, met = random.Random(6), {}, []
    for i in range(60):
        words = [f"b{j}" for j in range(200)]
        for j in range(20):
            words[10 * j] = f"b{10 * j}x{rng.randrange(2)}"
        texts[i] = " ".join(words)
    across = near_dedup._across
    monkeypatch.setattr(near_dedup, "_across", lambda *a: met.append(across(*a)) or met[-1])
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), near_dedup.NearDedup(words=3, percent=85)).toPandas()
    pairs = met[0].select(F.least("u_sig", "w_sig").alias("a"), F.greatest("u_sig", "w_sig").alias("b")).toPandas()
    assert {r.doc_id: r.component_id for r in got.itertuples()} == linked(texts, 3, 85)[1]
    assert len(pairs) > 20 and not pairs.duplicated().any()


def test_one_document_of_each_group_stays(spark):
    base = {x: " ".join(f"{x}{i}" for i in range(200)) for x in "abcdefg"}
    near = lambda x: base[x].replace(f"{x}199", "other")
    rows = [
        (1, base["a"]), (None, near("a")), (None, base["b"]),  # a copy without an id goes, a unique text without one stays
        (2, near("a")), (2, base["c"]),  # of a repeated id, only the copy goes
        (None, base["d"]), (None, near("d")), (None, base["d"]),  # one of a group without ids stays
        (3, base["e"]), (3, base["e"]), (4, near("e")),  # one of equal rows stays
        (6, base["f"]), (6, near("f")), (None, None), (None, ""), (7, ""), (7, ""),
    ]
    got = near_dedup.deduplicated(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string"))
    assert got.columns == ["doc_id", "text", "source"]
    left = [(r.doc_id, r.text) for r in got.collect()]
    group = lambda x: [d for d, t in left if t in (base[x], near(x))]
    assert [group(x) for x in "abcdefg"] == [[1], [None], [2], [None], [3], [6], []]
    assert sorted(map(repr, [x for x in left if not x[1]])) == ["(7, '')", "(7, '')", "(None, '')", "(None, None)"]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = near_dedup.components(edges).toPandas().set_index("node").component
    assert (got[got.index <= 40] == 0).all() and got[101] == 100


def test_mixing_meets_targets(spark, sf, docs):
    got = queries.op2_mixing(spark, sf).toPandas().merge(docs[["doc_id", "source", "text"]])
    assert (got["size"] == [len(t.encode().split()) for t in got.text]).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert np.abs(by.taken - by.target).max() <= 1
    assert abs(by.target.sum() - 1.5 * got["size"].sum()) < 1e-6 * by.target.sum() + 1
    assert (got.taken <= 2 * got["size"]).all()
    again = queries.op2_mixing(spark, sf).toPandas().sort_values("doc_id")
    assert (again.taken.values == got.sort_values("doc_id").taken.values).all()


def brute_targets(docs, weights=(5, 2, 1)):
    sizes = docs.text.fillna("").map(lambda t: len(t.encode().split())).groupby(docs.source.fillna("~none")).sum().sort_index()
    w = {x: weights[i % 3] for i, x in enumerate(sizes.index)}
    goal, rest = {}, 1.5 * sizes.sum()
    while True:
        open_ = [x for x in sizes.index if x not in goal]
        over = [x for x in open_ if rest * w[x] / sum(w[y] for y in open_) > 2 * sizes[x]]
        if not over:
            return goal | {x: rest * w[x] / sum(w[y] for y in open_) for x in open_}
        share = {x: 2 * sizes[x] for x in over}
        goal |= share
        rest -= sum(share.values())


def test_mixing_targets_by_brute_force(spark, sf, docs):
    got = queries.op2_mixing(spark, sf).toPandas().merge(docs[["doc_id", "source"]])
    want = brute_targets(docs)
    assert all(r.target == pytest.approx(want[r.source]) for r in got.itertuples())


def test_mixing_takes_what_the_tree_deals(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), f"s{rng.choice([0, 0, 0, 1, 2])}") for i in range(3000)]
    rows += [(5000, "a b c d e f g h i j", "s9")] * 7 + [(None, "a b c", None)] * 40  # repeats, a null id and source
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    c = mixing.Mixing(block=500, shard=4000)
    plan = mixing.mix_plan(docs, c).toPandas()
    by = plan.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) < 40).all() and (plan.taken <= 2 * plan["size"]).all()
    drawn = [(r.source if isinstance(r.source, str) else "", d["epoch"], d["block"], d["shard"], d["words"]) for r in plan.itertuples() for d in r.draws]
    blocks = {x[:4] for x in drawn}
    assert len({x[:3] for x in blocks}) == len(blocks)  # a block goes to one shard
    strata = sorted({x[:2] for x in blocks})
    counts = np.array([sum(x[:2] == y for x in blocks) for y in strata])
    shards = max(x[3] for x in blocks) + 1
    got = np.array([[sum(x[:2] == y and x[3] == s for x in blocks) for y in strata] for s in range(shards)])
    assert (got.sum(0) == counts).all() and np.ptp(got.sum(1)) <= 2 * math.ceil(math.log2(shards))  # the tree's quotas
    mix = mixing.mixed(docs, c).toPandas()
    words = mix.text.str.split().str.len().groupby(mix.source.fillna("")).sum()
    assert words.to_dict() == plan.taken.groupby(plan.source.fillna("")).sum().to_dict()
    assert words["s9"] == by.target["s9"] == 140  # seven rows of ten words, each twice


def test_mixing_draws_blocks_at_every_scale(spark, sf):
    """Sources have many blocks, of which a permuted part is drawn, and the tree parts them among shards in small tables too."""
    plan = queries.op2_mixing(spark, sf).toPandas()
    drawn = {(r.source_size, d["epoch"], d["block"], d["shard"]) for r in plan.itertuples() for d in r.draws}
    assert len({x[3] for x in drawn}) == 4 and len(drawn) > 5 * plan.source_size.nunique()
    partly = plan[(plan.taken == 0) & (plan["size"] > 0)].source_size.unique()
    assert len(partly) > 0 and all((plan[plan.source_size == s].taken > 0).any() for s in partly)


def test_quotas_of_many_sources_are_bounded(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('word ', 5) as text", "concat('s', id % 1000) as source")
    plan = mixing.mix_plan(docs, mixing.Mixing(shard=10, quotas=4000)).toPandas()
    assert abs(plan.taken.sum() - 1.5 * plan["size"].sum()) <= 1000 and max(d["shard"] for x in plan.draws for d in x) <= 3


def test_mixing_targets_are_capped():
    got = mixing.targets([10, 100, 100], [5, 2, 1], 315, 2)
    assert got[0] == 20 and got[1] == pytest.approx(295 * 2 / 3) and sum(got) == pytest.approx(315)


def test_splitting_tree_is_exact():
    blocks = np.array([7, 0, 130, 3])
    quotas = mixing.split_tree(blocks, 5, 1)
    assert (quotas.sum(0) == blocks).all() and np.ptp(quotas.sum(1)) <= 2


def test_encoder_equals_library(docs):
    from tokenizers import Tokenizer

    texts = [*docs.text[:60], "a  b\n\n c", "<|endoftext|> a<|startoftext|>b", "it's, don't!...#.##, 3.14,a", "", "  lead  ", "É, é.", "日本語。テスト, 你好", "é,b", "a\x1cb c", "x   y", "²,³ ½.", "\n\n"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        plain = Tokenizer.from_file(queries.vocabulary(name))
        plain.encode_special_tokens = True
        want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert WordEncoder(queries.vocabulary(name), 500).encode(texts) == want


def test_queries_encode_added_tokens_as_the_library(spark):
    from tokenizers import Tokenizer

    texts = ["a b.<|endoftext|> c", "<|endoftext|>", "x<|startoftext|>y  <|endoftext|>\n", "<|END<|endoftext|>OFTEXT|>", "<|ENDOFTEXT|> z", "plain words. here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def want(name, end):
        plain = Tokenizer.from_file(queries.vocabulary(name))
        return [np.array([*plain.encode(t, add_special_tokens=False).ids, end], "<u4").tobytes() for t in texts]

    pieces = packing.pack(docs, packing.Packing(queries.vocabulary("byte_bpe_50k.json"))).toPandas().sort_values(["doc_id", "start"])
    assert [b"".join(map(bytes, x)) for _, x in pieces.groupby("doc_id")["ids"]] == want("byte_bpe_50k.json", 0)
    path, start = new_path(spark, "tokens"), 0
    token_files.write_token_files(docs, path, token_files.TokenFiles(queries.vocabulary("word_bpe_49k.json")))
    got = token_files.with_crc32(token_files.read_token_files(spark, path)).toPandas().sort_values("doc_id")
    for r, ids in zip(got.itertuples(), want("word_bpe_49k.json", 1), strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += r.n_tokens


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 257, 300).tolist()
    sets = packing.differencing(sizes, 40)
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert sorted(i for s in sets for i in s) == list(range(300)) and max(sums) - min(sums) <= 8


def test_packing_holds_each_id_once(spark, sf, docs):
    from tokenizers import Tokenizer

    got = queries.op3_packing(spark, sf).toPandas()
    plain = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    for doc, text in zip(docs.doc_id[:80], docs.text[:80], strict=True):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        rows = got[got.doc_id == doc].sort_values("start")
        assert rows.length.sum() == len(ids) and (rows.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows.itertuples())
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset.values == np.r_[0, np.cumsum(seq.length)[:-1]]).all() and seq.length.sum() <= 1024
    assert got.length.sum() / (1024 * got.sequence_id.nunique()) > 0.97


def sketch(text, k=5, s=2):
    import regex
    import xxhash

    def over(values):  # xxhash64 of several columns takes each hash as the next one's seed
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), h)
        return h

    signed = lambda x: x - 2**64 if x >= 2**63 else x
    t = [xxhash.xxh64_intdigest(x.encode(), 42) for x in regex.findall(r"[^\x00-\x20\p{Lo}]{1,16}|\p{Lo}", text)]
    inner = [signed(over(t[i : i + s])) for i in range(len(t) - s + 1)]
    w = k - s + 1
    found = {over(t[i : i + k]) >> 24 for i in range(len(t) - k + 1) if min(inner[i : i + w]) in (inner[i], inner[i + w - 1])}
    if not found and text:
        found = {xxhash.xxh64_intdigest(text.encode(), 42) >> 24}
    return sorted(found)[:64]


def alike(a, b):
    union = sorted({*a, *b})[:64]
    return len(set(a) & set(b) & set(union)) / len(union) if union else 1.0


def test_syncmers_match_definition(spark, docs):
    texts = [*docs.text[:60], "", "one two", "a b c d e f", "日本語のテキストには空白がない。" * 4, "x" * 900, "tab\tand\nline " * 9, "été à la plage " * 12, "end of it"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = syncmers.fingerprints_and_edits(frame).toPandas().sort_values("doc_id", ignore_index=True)
    show = lambda x: "".join(f"{v:010x}" for v in x)
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert got.n_chars[i] == len(t) and got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest()
        assert got.fingerprint[i] == show(sketch(t)) and got.edited_fingerprint[i] == show(sketch(edited)), t[:40]
        assert got.near_edited[i] == pytest.approx(alike(sketch(t), sketch(edited))) and got.near_next[i] == pytest.approx(alike(sketch(t), sketch(after)))
    assert got.near_edited[:60].mean() > 0.5 and got.near_next[:60].mean() < 0.1


def test_syncmer_anchors_of_a_head_stay(spark):
    words = [f"w{i}" for i in range(80)]
    rows = spark.createDataFrame([(1, " ".join(words), "x"), (2, " ".join(words[:60] + ["other"] * 20), "x"), (3, None, "x")], "doc_id long, text string, anchors string")
    a, b, none = (r.anchors for r in syncmers.anchors(rows).orderBy("doc_id").collect())
    assert [x for x in a if x.place <= 55] == [x for x in b if x.place <= 55] and len([x for x in a if x.place <= 55]) > 15 and none == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_met_again_stay_remembered(name):
    """New words push out those not met since; marks after a word don't take it through the whole library."""
    words, seen = WordEncoder(queries.vocabulary(name), 8, special=True), []
    plain = words._plain
    words._plain = lambda *a: seen.append(a) or plain(*a)
    texts = [f"often new{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} été{'#$%&*'[i % 5] * (i % 4)} été's X#1 a#b" for i in range(60)]
    assert words.encode(texts) == [words._whole(t) for t in texts]
    assert words.direct and sum(a[1] == "often" for a in seen) == 1 and sum(a[2] != "" for a in seen) > 0
    assert len(words) <= 4 and len(words.older) <= 4


def test_token_files_read_back(spark, sf, docs):
    from tokenizers import Tokenizer

    got = queries.op5_token_files(spark, sf).toPandas().sort_values("doc_id")
    plain, start = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json")), 0
    for r, text in zip(got.itertuples(), docs.text, strict=True):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_part_a_repeated_id(spark):
    """One id, null ids and equal rows fill several files, and offsets still run on."""
    rows = [(7, f"text {i % 90}") for i in range(400)] + [(None, "same")] * 200 + [(i, "w") for i in range(20)]
    path = new_path(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one file
    try:
        token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, token_files.TokenFiles(queries.vocabulary("word_bpe_49k.json")))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_files.read_token_files(spark, path).toPandas().sort_values("start")
    assert len(got) == len(rows) and list(got.start) == [0, *got.n_tokens.cumsum()[:-1]]
    assert got.part[got.doc_id == 7].nunique() > 1 and got.part[got.doc_id.isna()].nunique() > 1
    assert got.doc_id.isna()[:200].all() and got.doc_id[200:].is_monotonic_increasing and got.part.is_monotonic_increasing


def test_line_chunks_match_sql(spark, sf):
    same(spark, sf, queries.op6_line_chunks, line_chunks.sql())


def test_line_chunks_keep_first_copy(spark):
    block = "\n".join(f"a line of the block number {i}" for i in range(12))
    rows = spark.createDataFrame([(2, "x y\n" + block), (1, block), (3, "alone\nhere")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_chunks.line_dedup(rows).collect()}
    assert got[1].kept_text == block and got[2].removed_lines >= 5 and got[3].kept_text == "alone\nhere"


def test_toxicity_on_held_out_documents(spark, sf):
    bigger = sf.replace("sf0.001", "sf0.1")
    got = queries.op7_toxicity(spark, bigger).toPandas().merge(pd.read_parquet(f"{bigger}/labels.parquet"))
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97 and held.predicted[held.toxic == 1].mean() > 0.85
    assert got.score.between(0, 1).all()


def test_rare_toxic_words_count_in_large_tables(spark):
    rng = random.Random(5)
    fill = lambda: [f"f{rng.randrange(900)}" for _ in range(25)]
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5]
    rows, labels, slurs = [], [], 0
    for i in ids:
        words, toxic = fill(), i % 2
        if toxic and slurs < 2:
            words[9], slurs = "rareslur", slurs + 1
        elif toxic:
            words[3] = "commonslur"
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(0 < d < 1 for d in model.discount)
    scorer, words = toxicity._Scorer(model, toxicity.Toxicity()), fill()
    at = lambda word: scorer(" ".join([*words[:9], word, *words[10:]]))
    assert at("rareslur") > at("neverseen") + 0.1 and at("commonslur") > 0.9


def test_url_rules_and_model(spark, sf):
    pages = pd.read_parquet(f"{sf}/pages.parquet")[["page_id", "url"]]
    extra = ["http://COM.Example.com/en/x", "https://www.example.com/en/1", "nothing", None, "http://a.net/es/?q", "https://m.casino-win.example.org/en/77", "https://blog.ththre.example.org/en/3", "http://x.com?y=/", "ftp://example.com/en/"]
    pages = pd.concat([pages, pd.DataFrame({"page_id": range(9000, 9000 + len(extra)), "url": extra})])
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
    frame = spark.createDataFrame(list(pages.itertuples(index=False)), "page_id long, url string")
    got = url_filter.judge(frame, spark.createDataFrame(url_filter.labelled_urls(), "url string, label int"), url_filter.UrlFilter(tuple(rules))).toPandas().merge(pages)
    for r in got.itertuples():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        raw = re.match("[^/?#]*", rest)[0]
        host, path = raw.lower(), re.match("[^?#]*", rest[len(raw) :])[0]
        fits = [(len(t), t, v) for v, t in rules if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == max(fits)[1:] if fits else (pd.isna(r.rule) and r.verdict in ("allow", "block"))
    w = url_filter.fit([(*url_parts(u), y) for u, y in url_filter.labelled_urls()], url_filter.UrlFilter())
    for r in got.itertuples():
        g = url_filter._grams(r.host, r.path, url_filter.UrlFilter())
        assert r.score == pytest.approx(1 / (1 + math.exp(-(w[g].sum() / math.sqrt(max(len(g), 1)) + w[-1]))))
        assert pd.notna(r.rule) or (r.verdict == "block") == (r.score > 0.5)


def url_parts(url):
    rest = url.split("://", 1)[1] if "://" in url else ""
    raw = re.match("[^/?#]*", rest)[0]
    return raw.lower(), re.match("[^?#]*", rest[len(raw) :])[0]


def test_url_model_on_held_out_hosts():
    c, rows = url_filter.UrlFilter(), [(*url_parts(u), y) for u, y in url_filter.labelled_urls()]
    fold = [zlib.crc32(re.sub(r"^(www|m|blog|shop)\.", "", h).encode()) % 5 for h, *_ in rows]
    hit = told = real = 0
    for f in range(5):
        w = url_filter.fit([r for r, k in zip(rows, fold, strict=True) if k != f], c)
        for h, p, y in (r for r, k in zip(rows, fold, strict=True) if k == f):
            g = url_filter._grams(h, p, c)
            said = w[g].sum() / math.sqrt(len(g)) + w[-1] > 0
            hit, told, real = hit + (said and y), told + said, real + y
    assert hit / told > 0.85 and hit / real > 0.8


def test_url_model_on_held_out_words():
    c, hit, told, real = url_filter.UrlFilter(), 0, 0, 0
    for f in range(5):
        keep, out = (lambda words: [w for i, w in enumerate(words) if i % 5 != f]), (lambda words: [w for i, w in enumerate(words) if i % 5 == f])
        w = url_filter.fit([(*url_parts(u), y) for u, y in url_filter.labelled_urls(keep(url_filter.UNWANTED), keep(url_filter.WANTED))], c)
        for u, y in url_filter.labelled_urls(out(url_filter.UNWANTED), out(url_filter.WANTED), 0):
            g = url_filter._grams(*url_parts(u), c)
            said = w[g].sum() / math.sqrt(len(g)) + w[-1] > 0
            hit, told, real = hit + (said and y), told + said, real + y
    assert hit / told > 0.5 and hit / real > 0.15


def test_url_table_holds_no_host_of_pages(sf):
    known = {".".join(url_parts(u)[0].split(".")[-3:]) for u, y in url_filter.labelled_urls() if y}
    pages = pd.read_parquet(f"{sf.replace('sf0.001', 'sf0.1')}/pages.parquet").url
    assert not known & {".".join(url_parts(u)[0].split(".")[-3:]) for u in pages}


def test_passages_find_planted_ones(spark, docs):
    rng = random.Random(3)
    texts, planted = docs.text.tolist(), []
    words = [f"q{rng.randrange(5000)}" for _ in range(400)]
    for j in range(4):
        passage, where = words[j * 60 : j * 60 + 56], rng.sample(range(len(texts)), 4)
        for n, i in enumerate(where):
            w, p = texts[i].split(" "), list(passage)
            if j > 1 and n:
                for z in rng.sample(range(56), 3):
                    p[z] = f"edit{n}"
            at = rng.randrange(len(w) + 1)
            texts[i] = " ".join(w[:at] + p + w[at:])
        planted.append(sorted(int(docs.doc_id[i]) for i in where))
    got = passages.repeated_passages(spark.createDataFrame(list(zip(map(int, docs.doc_id), texts, strict=True)), "doc_id long, text string")).toPandas()
    links = set(zip(got.doc_id, got.other_id, strict=True))
    assert all((i, ids[0]) in links for ids in planted for i in ids[1:])
    by = dict(zip(docs.doc_id, texts, strict=True))
    for r in got.itertuples():
        a, b = by[r.doc_id].encode().lower().split()[r.start : r.end], by[r.other_id].encode().lower().split()[r.other_start : r.other_end]
        assert len(set(a) & set(b)) >= 0.5 * len(set(a)) and r.other_id < r.doc_id and r.identity >= 0.8


def test_passages_whose_parts_occur_earlier(spark):
    rng, rows = random.Random(6), []
    fill = lambda tag, n: [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]
    for i in range(40):
        passage = fill(f"p{i}", 114)
        rows += [(10 * i + j, " ".join(fill("x", 30) + passage[38 * j : 38 * j + 38] + fill("y", 30))) for j in range(3)]
        rows += [(10 * i + j, " ".join(fill("x", 50) + passage + fill("y", 50))) for j in (7, 8)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    whole = got[(got.doc_id % 10 == 8) & (got.other_id == got.doc_id - 1) & (got.start == 50) & (got.end == 164)]
    assert len(whole) == 40 and (whole.matched_words == 114).all()


def test_passages_that_pieces_before_and_between_hold(spark):
    """Every seed of a whole passage meets a piece as the least document and another as the one before."""
    rng, rows = random.Random(8), []
    fill = lambda n: " ".join(f"x{rng.randrange(10**9)}" for _ in range(n))
    for i in range(20):
        passage = [f"p{i}x{rng.randrange(10**6)}" for _ in range(90)]
        pieces = [" ".join(passage[j : j + 30]) for j in range(0, 70, 12)]
        texts = [*pieces, " ".join(passage), *pieces, " ".join(passage), *pieces, " ".join(passage)]
        rows += [(100 * i + j, " ".join((fill(20), t, fill(20)))) for j, t in enumerate(texts)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    links = {(r.doc_id, r.other_id) for r in got.itertuples() if (r.start, r.end, r.other_start, r.other_end, r.matched_words) == (20, 110, 20, 110, 90)}
    assert links >= {(100 * i + j, 100 * i + 6) for i in range(20) for j in (13, 20)}


def test_texts_are_cut_into_words_before_they_meet_their_links(spark):
    """A document with many links is cut once, not once a link; spans are taken from its words."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**9)}" for _ in range(600)]
    rows = [(i, " ".join(["X", *words[50 * i : 50 * i + 50], "Y"])) for i in range(12)] + [(12, " ".join(words).upper())]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("regexp_extract_all" in x for x in plan) and not any("regexp_extract_all" in x and "slice" in x for x in plan)
    assert {(r.doc_id, r.other_id, r.start, r.end, r.other_start, r.other_end) for r in got.toPandas().itertuples()} == {(12, i, 50 * i, 50 * i + 50, 1, 51) for i in range(12)}


def test_minimizers_by_definition():
    rng = np.random.default_rng(1)
    for n in (0, 1, 9, 10, 11, 50, 400):
        for h in (rng.integers(0, 1 << 60, n), rng.integers(0, 3, n)):
            for near in (1, 2, 7, 10, 20):
                want = {i + int(h[i : i + near].argmin()) for i in range(max(1, n - near + 1))} if n else set()
                assert passages._minimizers(h, near).tolist() == sorted(want)


def test_chains_are_ordered_and_best_first():
    c = passages.Passages()
    found = passages.chains([[0, 0, 10, 10], [12, 500, 20, 508], [15, 14, 30, 29], [40, 45, 60, 65]], c)
    assert found[0] == [0, 2, 3] and sorted(i for x in found for i in x) == [0, 1, 2, 3]
    assert passages.common_words(np.array([1, 2, 3, 4]), np.array([1, 9, 3, 4])) == 3


def test_media_round_trip(spark, sf, docs):
    got = queries.op10_media(spark, sf).toPandas().sort_values("doc_id", ignore_index=True)
    for r, text in zip(got.itertuples(), docs.text, strict=True):
        data = text.encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        image = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        x = np.frombuffer(payload, np.uint8)
        rows = [b.mean() if len(b) else 0.0 for b in np.array_split(x.reshape(-1, 64).mean(1), 16)]
        shape = f"{x.mean():.3f}|{x.std():.3f}|{'.'.join(str(int(((x >= 16 * i) & (x < 16 * i + 16)).sum()) * 1000 // len(x)) for i in range(16))}|{sum(2**i for i, b in enumerate(rows) if b > x.mean()):04x}"
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(image), hashlib.sha256(image).hexdigest(), shape)
        assert (r.position, r.caption) == (0, f"document {r.doc_id}")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_interleaved_items_keep_their_order():
    page = '<p>Hello <b>you</b></p><figure><img src="media:ab" alt="x"><figcaption>Cap &amp; tion</figcaption></figure><script>no</script><img src="b.png" alt="alt">tail'
    assert [(i["kind"], i["text"], i["reference"], i["caption"]) for i in media.items_of(page)] == [("text", "Hello you", None, None), ("media", None, "media:ab", "Cap & tion"), ("media", None, "b.png", "alt"), ("text", "tail", None, None)]


def test_items_of_pages_keep_text_and_references(spark, sf):
    """Real pages: media between paragraphs, payloads found by digest, order kept."""
    pages = pd.read_parquet(f"{sf}/pages.parquet").html.dropna().tolist()
    digest = hashlib.sha256(media.as_samples(b"picture")[0]).hexdigest()
    rows = [(i, h.replace("</body>", f'<p>before {i}</p><figure><img src="media:{digest}"><figcaption>cap {i}</figcaption></figure><p>after</p></body>')) for i, h in enumerate(pages) if "</body>" in h]
    assert rows
    docs = spark.createDataFrame([(1, "picture")], "doc_id long, text string")
    found = media.interleaved(spark.createDataFrame(rows, "page_id long, html string"), "page_id")
    for r in found.toPandas().itertuples():
        kinds = [(x["kind"], x["text"], x["caption"]) for x in r.items]
        at = kinds.index(("media", None, f"cap {r.page_id}"))
        assert kinds[at - 1][1] == f"before {r.page_id}" and kinds[at + 1][1] == "after" and [x["position"] for x in r.items] == list(range(len(r.items)))
        plain = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ", dict(rows)[r.page_id])
        assert set(re.sub(r"<[^>]*>", " ", plain).split()) >= {w for k, t, _ in kinds if k == "text" for w in t.split() if w.isalpha()}
    got = media.resolved(found, "page_id", media.features(media.store(docs))).toPandas()
    assert len(got) == len(rows) and (got.payload_bytes == 64).all() and (got.caption == [f"cap {i}" for i in got.page_id]).all()


def test_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 1), (7, 0, 0), (None, 0, 1), (8, 0, None)], "doc_id long, quality int, toxic int")
    n = odd.count()
    near = near_dedup.near_duplicates(odd).toPandas()
    assert len(near) == n and near[near.doc_id == 6].component_id.iloc[0] == 5 and near[near.doc_id == 8].component_id.iloc[0] == 7
    plan = mixing.mix_plan(odd).toPandas()
    assert len(plan) == n and (plan.taken <= 2 * plan["size"]).all()
    c = packing.Packing(queries.vocabulary("byte_bpe_50k.json"))
    assert packing.pack(odd, c).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    prints = syncmers.fingerprints_and_edits(odd).toPandas()
    assert len(prints) == n and prints[prints.doc_id == 5].fingerprint.iloc[0] == prints[prints.doc_id == 6].fingerprint.iloc[0]
    assert syncmers.anchors(odd).count() == n
    lines = line_chunks.line_dedup(odd).toPandas()
    assert len(lines) == n and line_chunks.without_repeats(odd).columns == odd.columns
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).where("score between 0 and 1").count() == n
    assert passages.repeated_passages(odd).where("other_id = 7 and doc_id = 8").count() > 0  # the text repeats itself
    stored = media.store(odd)
    assert media.features(stored).count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    path = new_path(spark, "tokens")
    token_files.write_token_files(odd, path, token_files.TokenFiles(queries.vocabulary("word_bpe_49k.json")))
    assert token_files.with_crc32(token_files.read_token_files(spark, path)).count() == n
    assert mixing.mixed(odd).columns == odd.columns
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert words(mixing.mixed(odd).collect()) == plan.taken.sum()
    left = toxicity.clean(odd, labels)
    assert left.columns == odd.columns and {repr(r) for r in left.collect()} <= {repr(r) for r in odd.collect()}
    kept = near_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and kept.where("text like 'same%'").count() == 1 and kept.where("text is null").count() == 2
    urls = odd.select("doc_id", F.col("text").alias("url"), F.col("doc_id").alias("page_id"), "score")
    told = url_filter.judge(urls, spark.createDataFrame(url_filter.labelled_urls(), "url string, label int"), url_filter.UrlFilter())
    assert told.count() == n and told.where("host = '' and path = ''").count() == n
    items = media.interleaved(odd, "doc_id", "text")
    assert items.count() == n and items.where("size(items) = 0").count() == 4
    assert media.resolved(items, "doc_id", media.features(stored)).count() == 0
    texts = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in token_files.read_token_files(spark, path).collect())
    assert len(texts) == n and sum(t[2] == 1 for t in texts) == 4  # nulls, an empty text and blanks


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for made in (
        near_dedup.near_duplicates(none), mixing.mix_plan(none), packing.pack(none, packing.Packing(queries.vocabulary("byte_bpe_50k.json"))), syncmers.fingerprints_and_edits(none),
        line_chunks.line_dedup(none), toxicity.score(none, toxicity.train(none, labels)), passages.repeated_passages(none), media.features(media.store(none)), mixing.mixed(none), near_dedup.deduplicated(none),
        syncmers.anchors(none), line_chunks.without_repeats(none), toxicity.clean(none, labels), media.interleaved(none, "doc_id", "text"),
        media.resolved(media.interleaved(none, "doc_id", "text"), "doc_id", media.features(media.store(none))),
        url_filter.judge(none.selectExpr("doc_id as page_id", "text as url"), none.selectExpr("text as url", "1 as label"), url_filter.UrlFilter()),
    ):
        assert made.count() == 0
    path = new_path(spark, "tokens")
    token_files.write_token_files(none, path, token_files.TokenFiles(queries.vocabulary("word_bpe_49k.json")))
    assert token_files.with_crc32(token_files.read_token_files(spark, path)).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from barwright.llm.common import written

        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == columns, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() <= n and pieces.count() > 0
    tokens = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas().n
    assert tokens.max() <= 1024
