"""Near duplicates by bottom-k sketches.

Each document is the set of its distinct word shingles. One hash function orders all shingles; a document retains the
``retained`` smallest hashes. From there:

1. Documents with the same set form a class; only classes are compared.
2. Inverted lists of retained values generate overlaps. Values are ordered by how many sketches hold them, rarest
   first; a value that one class alone holds generates nothing and is only counted. By pigeonhole, two sets whose
   sketches overlap in ``o`` values or more share one of their ``k - o + 1`` first values in that order, so a class
   enters the lists of those only. Lists with the same members count once.
3. In each list the class with the most frequent values is the hub. Pairs (hub, member) link most of a group with as
   many pairs as members. Then pairs of members that the hubs left in different components follow; a member is paired
   only within the bands of sizes for which its place in the order leaves room, and two members in their first list only.
4. The estimate from the smallest values of the union of two sketches filters pairs; the Jaccard similarity of the full
   sets decides.

A set of up to ``retained`` shingles is its own sketch, and among such sets ``o`` is exact. Where the set or its partner
is larger, ``o`` lies ``z`` standard deviations under the expected overlap at the limit (a miss in some 300,000 at the
limit itself, fewer above it).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordHashes, chunks, lower_words, shingle_hashes, small_batches, whole_row, written


@dataclass(frozen=True)
class NearDedup:
    """words: length of a shingle. percent: a link needs this Jaccard similarity in hundredths. retained: values of a
    sketch. estimated: values of the union that estimate. counters, often: cells, fixed in number, that single out values
    in very many sketches (64 times an average cell, and ``often``), which are not dealt by value. broadcast_ids: up to
    so many documents to verify are sent to all executors; beyond, they are joined by a shuffle."""

    words: int = 5
    percent: int = 80
    retained: int = 512
    estimated: int = 128
    counters: int = 1 << 20
    often: int = 1000
    z: float = 4.2
    broadcast_ids: int = 200_000


SKETCH = "doc_id long, text_key long, n int, sig long, retained array<long>"


def _sets(c: NearDedup):
    hashes = WordHashes()

    def of(text: str | None) -> np.ndarray:
        return np.unique(shingle_hashes(hashes.of(lower_words(text)), c.words))

    return of


def _digest(values: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())).view(np.int64))


def sketches(docs: DataFrame, c: NearDedup) -> DataFrame:
    """(doc_id, text_key, n, sig, retained) per document; a set that a task has seen already leaves its sketch null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen = _sets(c), set()
        for b in chunks(batches):
            n, sig, kept = [], [], []
            for text in b.column(1).to_pylist():
                s = of(text)
                d = _digest(s)
                n.append(len(s))
                sig.append(d)
                if len(s) == 0 or d in seen:
                    kept.append(None)
                    continue
                if len(seen) >= 1 << 18:
                    seen.clear()
                seen.add(d)
                kept.append(s[: c.retained])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int32()), pa.array(sig, pa.int64()), pa.array(kept, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n", "sig", "retained"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, SKETCH)


CELLS = 4096


def counted(sketched: DataFrame, c: NearDedup) -> np.ndarray:
    """Counts of retained values by their lowest bits. The result has a fixed size, whatever the input; it tells only
    which values are very frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(c.counters, np.int64)
        for b in batches:
            v = b.column(0).flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(v & (c.counters - 1), minlength=c.counters)
        if total.any():
            rows = np.minimum(total, 2**31 - 1).astype("<i4").reshape(-1, CELLS)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * len(rows), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["cell", "part", "counts"])

    def add(key, table):
        total = np.zeros(CELLS, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_py(), "<i4")
        return pa.table({"cell": [key[0].as_py()], "part": [0], "counts": [np.minimum(total, 2**31 - 1).astype("<i4").tobytes()]}, schema=pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())]))

    shape = "cell int, part int, counts binary"
    parts = sketched.select("retained").where("retained is not null").mapInArrow(run, shape)
    total = parts.groupBy("cell", "part").applyInArrow(add, shape).groupBy("cell").applyInArrow(add, shape)
    out = np.zeros((max(1, c.counters // CELLS), CELLS), np.int32)
    for row in total.collect():
        out[row.cell] = np.frombuffer(row.counts, "<i4")
    return out.reshape(-1)


def _least_overlap(c: NearDedup) -> F.Column:
    """Values that the sketch of a set of ``n`` shingles shares at least with that of any set it links with.

    Up to ``retained`` shingles the set shows whole, and its percentage must be shared. A partner of up to 100 / percent
    times its size shows only ``retained`` values; then as many times percent are expected, with the variance of draws
    without replacement. A larger set shows ``retained`` of its own, of which percent are expected.
    """
    n, p = F.col("n"), c.percent / 100
    expected, variance = c.retained * p, c.retained * p * (1 - p)
    own = F.ceil(n * F.lit(c.percent) / 100 - F.lit(1e-9))
    part = F.greatest(F.lit(0.0), 1 - F.lit(expected) / n)
    beside = F.when(n > expected, F.floor(expected - c.z * F.sqrt(variance * part) - 1)).otherwise(own)
    return F.when(n <= c.retained, F.least(own, beside)).otherwise(F.floor(F.lit(expected - c.z * variance**0.5))).cast("int")


#: Stands for the number of sketches that hold a value which the counters found to be very frequent.
HEAVY = 1 << 40


def postings(sketched: DataFrame, c: NearDedup) -> DataFrame:
    """value, df, sig, n, k, pos, weight: the first shared values of each class with their place in the common order.

    The order is by how many sketches hold a value, then by value. Values are dealt by themselves to be counted; the few
    that very many sketches hold (found by the counters, fixed in number) are known to be shared, skip that and come
    last. What one class holds alone isn't listed but takes its place at the front.
    """
    counts = counted(sketched, c)
    cells = np.flatnonzero(counts >= max(c.often, 64 * float(counts.mean()))).tolist()  # counters / 64 at most
    values = sketched.where("retained is not null").select("sig", F.explode("retained").alias("value"))
    heavy = F.col("value").bitwiseAND(F.lit(c.counters - 1).cast("long")).isin(cells) if cells else F.lit(False)
    same = W.partitionBy("value")
    rare = values.where(~heavy).select("sig", "value", *(f("sig").over(same).alias(x) for f, x in ((F.count, "df"), (F.min, "lo"), (F.max, "hi"))))
    shared = rare.where("lo != hi").select("sig", "value", "df")
    # A row without a value brings the size of each set along. One plain exchange: most rows of a set come from apart.
    sizes = sketched.where("retained is not null").select("sig", F.lit(None).cast("long"), F.col("n").cast("long"))
    shared = shared.union(values.where(heavy).select("sig", "value", F.lit(HEAVY))).union(sizes).repartition("sig")
    found = F.collect_set(F.when(F.col("value").isNotNull(), F.struct("df", "value"))).alias("values")
    sets = shared.groupBy("sig").agg(F.max(F.when(F.col("value").isNull(), F.col("df"))).cast("int").alias("n"), F.sort_array(found).alias("values"))
    sets = sets.withColumn("k", F.least("n", F.lit(c.retained))).withColumn("alone", F.col("k") - F.size("values"))
    weight = F.aggregate("values", F.lit(0.0), lambda x, v: x + F.ln(v["df"])) / F.col("k")
    first = F.slice("values", 1, F.greatest(F.lit(0), F.col("k") - _least_overlap(c) + 1 - F.col("alone")))
    rows = sets.select("sig", "n", "k", "alone", weight.cast("float").alias("weight"), F.posexplode(first).alias("i", "v"))
    return rows.select("v.value", "v.df", "sig", "n", "k", (F.col("alone") + F.col("i")).alias("pos"), "weight")


def hubs_of(lists: DataFrame) -> DataFrame:
    """value and its hub's h_sig, h_n, h_k, h_pos for each list of several members; of lists with the same members only
    the one whose value comes first, which is where the members meet first."""
    order = F.col("weight").cast("double") * 1e9 + F.hash("sig") / 2.0**32  # the most frequent values; ties fall alike
    made = lists.groupBy("value").agg(
        F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.max_by(F.struct("sig", "n", "k", "pos"), order).alias("h"),
        F.min("df").alias("df"), F.count("*").alias("many"), F.bit_xor(F.xxhash64("sig")).alias("members"),
    ).where("lo != hi")
    once = made.groupBy("members", "many").agg(F.min_by(F.struct("value", "h"), F.struct("df", "value")).alias("x"))
    return once.select("x.value", *(F.col(f"x.h.{y}").alias(f"h_{y}") for y in ("sig", "n", "k", "pos")))


def _need(c: NearDedup, m: F.Column, n: F.Column) -> F.Column:
    """Values from the first shared one on, itself included, that sketches of sets of m and n shingles hold if they link.

    Sets of m and n shingles that link share p / (1 + p) * (m + n) of them at least. If both are their own sketches, so
    many values must still follow. Else that share of the larger set's retained values is expected in both sketches;
    both sketches' limits vary, so twice the binomial variance is allowed for.
    """
    larger = F.greatest(m, n)
    both = F.lit(c.percent) * (m + n) / F.lit(100 + c.percent)
    q = F.least(F.lit(1.0), both / larger)
    likely = F.floor(c.retained * q - c.z * F.sqrt(2 * c.retained * q * (1 - q)) - 1)
    return F.when(larger <= c.retained, F.ceil(both - F.lit(1e-9))).otherwise(likely)


def _may_link(c: NearDedup, a: str, b: str) -> F.Column:
    """Whether sizes and places in the order leave room for a link, if the shared value is the first that they share."""
    col = lambda side, x: F.col(f"{side}_{x}")
    larger = F.greatest(col(a, "n"), col(b, "n"))
    room = F.least(col(a, "k") - col(a, "pos"), col(b, "k") - col(b, "pos"))
    sizes = F.least(col(a, "n"), col(b, "n")) * F.lit(100).cast("long") >= larger * F.lit(c.percent).cast("long")
    return sizes & (room >= _need(c, col(a, "n"), col(b, "n")))


#: Sizes within two hundredths of each other, roughly, are a band.
BANDS = 50


def _band(n: F.Column) -> F.Column:
    return F.floor(F.ln(n.cast("double")) * BANDS).cast("int")


def _bands(c: NearDedup, n: F.Column, room: F.Column) -> F.Column:
    """Bands of the sizes that a set of n shingles may link with, if ``room`` of its values follow a shared one.

    What a link needs has no minimum inside a range of sizes: it rises with the other's size up to n, and beyond either
    rises, or, where the sketches aren't whole, falls. So a band is left out if there isn't room at either end.
    """
    least, most = (F.ceil(n * F.lit(c.percent) / 100 - F.lit(1e-9)), F.floor(n * F.lit(100) / c.percent + F.lit(1e-9)))
    low = lambda b: F.greatest(least, F.floor(F.exp(b / F.lit(float(BANDS)))))
    high = lambda b: F.least(most, F.ceil(F.exp((b + 1) / F.lit(float(BANDS)))))
    return F.filter(F.sequence(_band(least), _band(most)), lambda b: (room >= _need(c, n, low(b))) | (room >= _need(c, n, high(b))))


def _across(named: DataFrame, c: NearDedup) -> DataFrame:
    """Pairs (u, w) of members of one list that lie in different components, one of them or both not in the hub's.

    A member meets only those of its lists whose sizes its own place allows, and two members only in the first list that
    holds both, of those that precede it in their orders (``m_before``): near copies share dozens of lists.
    """
    cols = ("sig", "n", "k", "pos", "in", "before")
    apart = named.where("m_in != h_in").select("value", *(F.col(f"m_{x}").alias(f"u_{x}") for x in cols))
    rest = named.select("value", *(F.col(f"m_{x}").alias(f"w_{x}") for x in cols), (F.col("m_in") != F.col("h_in")).alias("w_apart"), _band(F.col("m_n")).alias("band"))
    apart = apart.withColumn("band", F.explode(_bands(c, F.col("u_n"), F.col("u_k") - F.col("u_pos"))))
    met = apart.join(rest, ["value", "band"]).where("u_in != w_in and (u_sig < w_sig or not w_apart)").where(_may_link(c, "u", "w"))
    return met.where(~F.arrays_overlap("u_before", "w_before"))


def _sent(df: DataFrame, c: NearDedup) -> DataFrame:
    """A table of ids to look up, marked for broadcast where its counted rows are few."""
    return F.broadcast(df) if df.limit(c.broadcast_ids + 1).count() <= c.broadcast_ids else df


def _estimated(pairs: DataFrame, asked: DataFrame, sketched: DataFrame, c: NearDedup) -> DataFrame:
    """Keeps the pairs whose union sketch doesn't rule out a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (v.values.to_numpy(zero_copy_only=False) for v in (x, y))
                union = np.union1d(x, y)[: c.estimated]
                both = np.intersect1d(np.intersect1d(x, y), union)
                m = len(union)
                keep.append(len(both) >= m * c.percent / 100 - c.z * np.sqrt(m * c.percent / 100 * (1 - c.percent / 100)) - 1)
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    least = F.slice("retained", 1, c.estimated).alias("small")
    small = written(sketched.where("retained is not null").join(_sent(asked, c), "sig", "left_semi").select("sig", least), "asked").dropDuplicates(["sig"])
    left, right = (small.select(F.col("sig").alias(x), F.col("small").alias(f"small_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "small_a", "small_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, c: NearDedup) -> DataFrame:
    """Pairs of classes whose full sets have the similarity asked for."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _sets(c)
        for b in chunks(batches, 128):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["sig", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= c.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "needed")
    wanted = written(classes.join(_sent(needed, c), "sig").select("sig", F.col("doc_id").alias("rep"), "text_key"), "wanted")
    on = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.xxhash64("text") == F.col("text_key"))
    found = docs.join(_sent(wanted, c), on).select("sig", "text")
    sets = written(found.mapInArrow(full, "sig long, hashes binary").dropDuplicates(["sig"]), "sets")
    left, right = (sets.select(F.col("sig").alias(x), F.col("hashes").alias(f"hashes_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "hashes_a", "hashes_b")
    return written(both.mapInArrow(run, "a long, b long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge table (a, b) reaches.

    Each round takes the smallest label among neighbours, then the label of that label, so that long chains shrink fast.
    A round's labels are a written table. Work per round is one join and one aggregation with map-side combining.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("beyond"))
        step = written(low.join(jump, "low", "left").select("node", "component", F.least("low", F.coalesce("beyond", "low")).alias("next")), "labels")
        changed = step.where("next != component").limit(1).count()
        labels = step.select("node", F.col("next").alias("component"))
        if not changed:
            return labels


def _key() -> F.Column:
    """The order in which a document of a component is chosen to stay."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")


def _judged(docs: DataFrame, c: NearDedup) -> DataFrame:
    """One row per document: doc_id, text_key, n, component_id and keep, the (none, doc_id, text_key) of the document of
    its component that stays: the least doc_id, nulls last, then the least text_key. Both are null without shingles."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = written(sketches(docs, c), "sketches")
    lists = written(postings(sketched, c), "postings")
    hubs = written(hubs_of(lists), "hubs")
    members = lists.select("value", *(F.col(x).alias(f"m_{x}") for x in ("sig", "n", "k", "pos")))
    grouped = written(members.join(hubs, "value"), "overlaps")
    rep = F.min(F.struct("doc_id", "text_key")).alias("rep")
    classes = sketched.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"), rep, F.min(_key()).alias("keep"))
    classes = written(classes.select("sig", "least", "keep", "rep.doc_id", "rep.text_key"), "classes")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "candidates")
        asked = written(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "ids")
        return _confirmed(written(_estimated(pairs, asked, sketched, c), "pairs"), docs, classes, c)

    spokes = linked(grouped.where("m_sig != h_sig").where(_may_link(c, "m", "h")).select(F.col("m_sig").alias("x"), F.col("h_sig").alias("y")))
    groups = components(spokes)
    label = groups.select(F.col("node").alias("m_sig"), "component")
    named = grouped.join(label, "m_sig", "left").withColumn("m_in", F.coalesce("component", "m_sig")).drop("component")
    named = named.join(label.select(F.col("m_sig").alias("h_sig"), F.col("component").alias("h_in")), "h_sig", "left").withColumn("h_in", F.coalesce("h_in", "h_sig"))
    earlier = W.partitionBy("m_sig").orderBy("m_pos").rowsBetween(W.unboundedPreceding, -1)
    other = _across(written(named.withColumn("m_before", F.collect_list("value").over(earlier)), "named"), c)
    more = linked(other.select(F.col("u_sig").alias("x"), F.col("w_sig").alias("y")))
    groups = components(spokes.union(more))

    named = classes.select("sig", "least", "keep").join(groups.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.min("keep").alias("keep"))
    by_class = written(named.select("sig", "component").join(least, "component").select("sig", "component_id", "keep"), "components")
    return sketched.select("doc_id", "text_key", "n", "sig").join(by_class, "sig", "left").drop("sig")


def near_duplicates(docs: DataFrame, c: NearDedup = NearDedup()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept.

    docs has doc_id and text; other columns are ignored. Null or wordless texts have no shingles, link with nothing and
    are kept. Rows with the same doc_id and text are one document repeated and get the same row each. A null doc_id is
    never a component_id unless no document of the component has one; then component_id is null and the row is kept.
    An empty table gives an empty result.
    """
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return _judged(docs, c).select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, c: NearDedup = NearDedup()) -> DataFrame:
    """The documents that stay, with all their columns: one row of each component, and each row without shingles.

    A component keeps its least doc_id, nulls last, and of several texts under it the one with the least hash; of rows
    that repeat both, the first in the order of their JSON form. Rows with a null or repeated doc_id go and stay by
    their own text.
    """
    judged = written(_judged(docs, c).where("n > 0").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), (~_key().eqNullSafe(F.col("keep"))).alias("__gone")), "judged")
    here, key = F.col("doc_id").cast("long").alias("__doc"), F.xxhash64(F.col("text").cast("string")).alias("__text")
    rows = docs.select(whole_row(docs).alias("__row"), here, key)  # in one struct, so that no name clashes
    columns = [F.col("__row")[x].alias(x) for x in docs.columns]
    on = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key"))
    left = rows.join(judged.where("__gone").select("__id", "__key").distinct(), on, "left_anti")
    again = written(judged.where("not __gone").groupBy("__id", "__key").agg(F.count("*").alias("n")).where("n > 1").select("__id", "__key"), "again")
    if not again.limit(1).count():
        return left.select(columns)
    one = left.join(again, on).groupBy("__id", "__key").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    return left.join(again, on, "left_anti").select(columns).unionByName(one.select(columns))
