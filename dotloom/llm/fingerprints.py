"""Document fingerprints from closed syncmers (operator 6, built-in functions only).

A text is a row of units: runs of at most ``UNIT`` characters without white space.  A window of ``K`` units is an
anchor if the least hash of its inner windows of two units is that of the first or the last one.  The choice depends
on the window alone, so texts that share a passage share its anchors, whatever surrounds it.  The fingerprint is
the set of the hashes of all anchors, and the likeness of two fingerprints is the share of common anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dotloom.llm.common import text_of, written

UNIT = 12
K = 6


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _units(text: Column) -> Column:
    """Hashes of a text's units."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(rf"\S{{1,{UNIT}}}"), F.lit(0)), lambda u: F.xxhash64(u))


def _inner(units: Column) -> Column:
    """Hashes of all windows of two units (and of the last unit alone)."""
    return F.zip_with(units, F.slice(units, F.lit(2), F.size(units)), lambda a, b: F.xxhash64(a, b))


def _places(s: Column) -> Column:
    last = K - 2
    rest = F.greatest(F.size(s) - K, F.lit(-1))
    return F.when(
        rest >= 0,
        F.filter(
            F.sequence(F.lit(0), rest),
            lambda i: F.least(F.get(s, i), F.get(s, i + last)) <= F.least(*(F.get(s, i + j) for j in range(1, last))),
        ),
    ).otherwise(F.array().cast("array<int>"))


def _value(s: Column, i: Column) -> Column:
    return F.shiftright(F.xxhash64(*(F.get(s, i + j) for j in range(0, K - 1, 2))), 32).cast("int")


def anchors(text: Column) -> Column:
    """Array of (place, value) of a text's anchors: the unit that an anchor begins with, and its hash."""
    found = lambda s: F.transform(_places(s), lambda i: F.struct(i.alias("place"), _value(s, i).alias("value")))
    return let(_units(text), lambda u: let(_inner(u), found))


def sketch(text: Column) -> Column:
    """The hashes of all of a text's anchors, each once and in order.

    A text without anchors, as one of fewer than ``K`` units, has the hashes of its units instead; a text without
    units has none.
    """

    def each_once(values: Column) -> Column:
        return F.sort_array(F.array_distinct(values))

    def of(units: Column) -> Column:
        found = let(_inner(units), lambda s: each_once(F.transform(_places(s), lambda i: _value(s, i))))
        alone = each_once(F.transform(units, lambda u: F.shiftright(u, 32).cast("int")))
        return let(found, lambda v: F.when(F.size(v) > 0, v).otherwise(alone))

    return let(_units(text), of)


def printed(sketch_: Column) -> Column:
    """A sketch as a string: eight hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(sketch_, lambda x: F.right(F.lpad(F.hex(x), 8, "0"), F.lit(8))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes of either that are in both (0 to 1); two empty sketches are alike."""
    return let(F.size(F.array_intersect(a, b)), lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def next_documents(keys: DataFrame) -> DataFrame:
    """``keys`` (doc_id, id_key, text_key, distinct) with next_id_key and next_text_key: each key's follower.

    The order is descending, null ids last, and the first follows the last.  Keys are dealt out by range; only the
    first key of each range meets that of the next one.
    """
    order = [F.desc_nulls_last("doc_id"), F.desc("text_key")]
    dealt = written(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    in_range = Window.partitionBy("range").orderBy(*order)
    key = F.struct("id_key", "text_key")
    followed = dealt.withColumn("follower", F.lead(key).over(in_range)).withColumn("at", F.row_number().over(in_range))
    heads = followed.where("at = 1").select("range", key.alias("head"))
    ranges = Window.orderBy("range")  # one row for each range
    after = heads.withColumn("after", F.coalesce(F.lead("head").over(ranges), F.first("head").over(ranges))).select("range", "after")
    found = followed.join(after, "range").withColumn("follower", F.coalesce("follower", "after")).drop("range", "at", "after")
    return found.withColumns({"next_id_key": F.col("follower.id_key"), "next_text_key": F.col("follower.text_key")}).drop("follower")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every row of ``docs`` (doc_id, text), of its edited text, and their likeness.

    The edited text has the last third of the characters (rounded down) replaced by as many first ones of the next
    document, or all of them, in descending doc_id (null ids last); after the last document comes the first.
    Null text is empty.  Rows that repeat both doc_id and text are one document in that order and get equal rows;
    documents with the same id follow each other by a hash of their text.  Extra columns are not looked at.
    """
    texts = docs.select("doc_id", text_of().alias("text"))
    # a key that is never null, for joins by name
    keys = {"id_key": F.coalesce("doc_id", F.lit(0)), "text_key": F.xxhash64("text", F.isnull("doc_id"))}
    lengths = texts.select("doc_id", keys["id_key"].alias("id_key"), keys["text_key"].alias("text_key"), F.length("text").alias("n_chars"))
    follow = written(next_documents(lengths.distinct()))
    # texts take part in both joins by the same key and columns, so they are exchanged once
    keyed = texts.select(keys["id_key"].alias("id_key"), keys["text_key"].alias("text_key"), "text", sketch(F.col("text")).alias("sketch"))
    by_next = follow.select(
        "doc_id", F.col("id_key").alias("own_id_key"), F.col("text_key").alias("own_text_key"), F.floor(F.col("n_chars") / 3).cast("int").alias("third"),
        F.col("next_id_key").alias("id_key"), F.col("next_text_key").alias("text_key"),
    )
    heads = keyed.join(by_next, ["id_key", "text_key"]).select(
        "doc_id", F.col("own_id_key").alias("id_key"), F.col("own_text_key").alias("text_key"),
        F.expr("substring(text, 1, third)").alias("head"), F.col("sketch").alias("next_sketch"),
    )
    met = keyed.join(heads.dropDuplicates(["id_key", "text_key"]), ["id_key", "text_key"])
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head"))
    done = met.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited")).withColumn("edited_sketch", sketch(F.col("edited")))
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"), printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
