"""Document fingerprints of closed syncmers, in DataFrame functions only.

Texts are taken as tokens: runs of up to 16 characters other than ASCII control characters and spaces, letters of
scripts without case each by themselves. A run of ``k`` tokens is an anchor if the least of its inner runs of ``s``
tokens, by hash, is the first or the last. That depends on the run alone, so an edit changes only the anchors that
overlap it: anchors of a text's head are anchors of every text with that head, at the same places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written, whole_row


@dataclass(frozen=True)
class Syncmers:
    """k, s: tokens of an anchor and of its inner runs (k > s + 1). size: anchors that a fingerprint keeps, the least by
    hash. token: the pattern of a token, which lies inside a run of characters above U+0020 and is found from its start."""

    k: int = 5
    s: int = 2
    size: int = 64
    token: str = r"[^\x00-\x20\p{Lo}]{1,16}|\p{Lo}"


_RUN = r"^[^\x00-\x20]*"


def _short(hashed: Column) -> Column:
    """40 bits of a hash, so that ten hexadecimal digits hold it."""
    return F.shiftrightunsigned(hashed, 24)


def token_hashes(text: Column, c: Syncmers) -> Column:
    """A hash for each token of a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(c.token), F.lit(0)), lambda t: F.xxhash64(t))


def _over(tokens: Column, i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(tokens, i + j) for j in range(size)])


def _starts(tokens: Column, size: int) -> Column:
    """Places, from 0, at which a run of so many tokens starts."""
    none = F.array().cast("array<int>")
    return F.when(F.size(tokens) >= size, F.sequence(F.lit(0), F.greatest(F.size(tokens) - size, F.lit(0)))).otherwise(none)


def _with_anchors(rows: DataFrame, tokens: str, found: str, c: Syncmers) -> DataFrame:
    """Adds the anchors of an array of token hashes: array of (place, hash), places of their first tokens from 0."""
    inner, tokens, last = F.col("__inner"), F.col(tokens), c.k - c.s

    def anchor(i: Column) -> Column:
        edge = F.least(F.get(inner, i), F.get(inner, i + last))
        middle = F.least(*[F.get(inner, i + j) for j in range(1, last)]) if last > 2 else F.get(inner, i + 1)
        return F.when(edge <= middle, F.struct(i.alias("place"), _short(_over(tokens, i, c.k)).alias("hash")))

    rows = rows.withColumn("__inner", F.transform(_starts(tokens, c.s), lambda i: _over(tokens, i, c.s)))
    return rows.withColumn(found, F.array_compact(F.transform(_starts(tokens, c.k), anchor))).drop("__inner")


def _least(hashes: Column, text: Column, c: Syncmers) -> Column:
    """The least distinct hashes; a text without an anchor counts whole, an empty one has none."""
    whole = F.when(text != "", F.array(_short(F.xxhash64(text)))).otherwise(F.array().cast("array<long>"))
    return F.when(F.size(hashes) > 0, F.slice(F.sort_array(F.array_distinct(hashes)), 1, c.size)).otherwise(whole)


def _digits(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 10, "0")), "")


def likeness(a: Column, b: Column, c: Syncmers) -> Column:
    """The estimated share of common anchors: those in both of the least ``size`` of the union. Two empty texts: 1."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, c.size)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union)).cast("double")


def anchors(docs: DataFrame, c: Syncmers = Syncmers()) -> DataFrame:
    """docs with ``anchors``: array of (place, hash), places of their first tokens counted from 0.

    Null and empty texts, and texts of fewer than ``k`` tokens, have no anchors. Other columns stay, except one named
    anchors, which is replaced. Equal texts have equal anchors; an empty table stays empty.
    """
    row = docs.select(whole_row(docs.drop("anchors")).alias("__row"))
    rows = row.withColumn("__tokens", token_hashes(F.coalesce(F.col("__row.text").cast("string"), F.lit("")), c))
    return _with_anchors(rows, "__tokens", "anchors", c).select("__row.*", "anchors")


KEY = ["id", "none", "text_key"]  # the doc_id (0 for null), whether it is null, the text's hash: never null, so plain joins do


def successors(keys: DataFrame) -> DataFrame:
    """(KEY, copies, n_chars, and next_ KEY): each distinct row's successor in ascending doc_id, null first, then by
    text_key; the first follows the last. Only narrow rows are sorted; one row per range goes to a single task."""
    once = keys.groupBy(*KEY).agg(F.count("*").alias("copies"), F.max("n_chars").alias("n_chars"))
    place = F.struct((~F.col("none")).alias("some"), "id", "text_key")
    ordered = written(once.withColumn("place", place).repartitionByRange("place").withColumn("part", F.spark_partition_id()), "order")
    inside = ordered.withColumn("next", F.lead("place").over(W.partitionBy("part").orderBy("place")))
    heads = ordered.groupBy("part").agg(F.min("place").alias("head"))
    line = W.orderBy("part")
    heads = heads.withColumn("after", F.coalesce(F.lead("head").over(line), F.first("head").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    rows = inside.join(heads.select("part", "after"), "part").withColumn("next", F.coalesce("next", "after"))
    return rows.select(*KEY, "copies", "n_chars", F.col("next.id").alias("next_id"), (~F.col("next.some")).alias("next_none"), F.col("next.text_key").alias("next_text_key"))


def fingerprints_and_edits(docs: DataFrame, c: Syncmers = Syncmers()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next per document.

    The edited text has the last quarter of its code points replaced by as many first ones of the next document. Null
    texts are empty. Rows with the same doc_id and text are one place in the order and get equal rows. A null doc_id
    comes first. A single document is followed by itself. A text of fewer than ``k`` tokens, or without an anchor, has the
    hash of the whole text as its fingerprint; an empty text has an empty one. An empty table gives no rows.
    """
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("none"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    links = written(successors(keyed.select(*KEY, F.length("text").cast("long").alias("n_chars"))), "links")
    if links.where("copies > 1").limit(1).count():
        keyed = keyed.dropDuplicates(KEY)
    # Texts are dealt by key once; both joins read that exchange. Only heads of texts travel to the document before.
    asked = links.select(*(F.col(f"next_{x}").alias(x) for x in KEY), *(F.col(x).alias(f"for_{x}") for x in KEY), F.floor(F.col("n_chars") / 4).cast("int").alias("quarter"))
    given = keyed.hint("merge").join(asked, KEY).select(*(F.col(f"for_{x}").alias(x) for x in KEY), F.expr("left(text, quarter)").alias("given"))
    rows = keyed.hint("merge").join(links, KEY).join(given, KEY)

    # The edited text's tokens are those of the head up to its last space, then those of the rest. So are the text's.
    head = F.expr("left(text, cast(n_chars - floor(n_chars / 4) as int))")
    rows = rows.withColumn("head", head).withColumn("open", F.length(F.regexp_extract(F.reverse("head"), _RUN, 0)))
    rows = rows.withColumn("closed", F.expr("left(head, length(head) - open)"))
    rest = F.expr("substring(text, length(closed) + 1, length(text))")
    edited = F.concat("head", "given")
    names = [*KEY, "copies", "n_chars", *(f"next_{x}" for x in KEY)]
    rows = rows.select(
        *names, "text", edited.alias("edited"), token_hashes(F.col("closed"), c).alias("shared"), token_hashes(rest, c).alias("own"),
        token_hashes(F.concat(F.expr("right(head, open)"), "given"), c).alias("other"),
    )
    before = F.slice("shared", F.greatest(F.size("shared") - c.k + 2, F.lit(1)), c.k - 1)
    rows = rows.withColumn("own", F.concat(before, "own")).withColumn("other", F.concat(before, "other"))
    for x in ("shared", "own", "other"):
        rows = _with_anchors(rows, x, f"{x}_anchors", c)
    rows = rows.withColumn("hashes", _least(F.concat("shared_anchors.hash", "own_anchors.hash"), F.col("text"), c))
    rows = rows.withColumn("edited_hashes", _least(F.concat("shared_anchors.hash", "other_anchors.hash"), F.col("edited"), c))
    digest = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    near = likeness(F.col("hashes"), F.col("edited_hashes"), c).alias("near_edited")
    rows = written(rows.select(*names, digest, "hashes", "edited_hashes", near), "fingerprints")
    ahead = rows.select(*(F.col(x).alias(f"next_{x}") for x in KEY), F.col("hashes").alias("next_hashes"))
    rows = rows.join(ahead, [f"next_{x}" for x in KEY]).withColumn("near_next", likeness(F.col("hashes"), F.col("next_hashes"), c))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    prints = [_digits(F.col(x)).alias(y) for x, y in (("hashes", "fingerprint"), ("edited_hashes", "edited_fingerprint"))]
    return rows.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", *prints, "near_edited", "near_next")
