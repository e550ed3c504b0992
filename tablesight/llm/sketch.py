"""Document fingerprints: a threshold-scaled sketch of five-word shingles.

Every shingle hash below a fixed fraction of the hash range is kept, so a sketch grows with its
document, sketches of parts merge by union, and the share of the smaller sketch found in the larger
estimates containment however unequal two documents are. A document with fewer than ``least`` hashes
below the threshold keeps its ``least`` lowest ones, or all it has. Such a document is compared with the
other one's hashes up to the same bound, also where those are above the threshold, so a short text that
lies in a long one is seen there.

With ``least`` 0 sketches are plain: a document with none below the threshold keeps its smallest hash,
and sketches are compared as they are.

Only DataFrame functions are used. The text after a document in doc_id order comes by two equi joins
on doc_id: ids are ranked in ranges without texts, and each text is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesight.plans.shared import stored

WORDS = 5
#: Of the query: one in so many hashes is kept, and the least size of a sketch.
SCALE, LEAST = 4, 16
#: One in so many hashes is kept where nothing else is said.
PLAIN_SCALE = 8
_TOP = (1 << 63) - 1
_BLANK = r"[\x20\x09-\x0D]+"


def _with(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """All shingle hashes of a text, with repeats, in order of place.

    Words are what blanks part. Fewer words than a shingle form one; a wordless or null text gives none.
    """

    def shingles(hashed: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(hashed) - F.lit(words)), lambda i: F.xxhash64(*[F.get(hashed, i + F.lit(k)) for k in range(words)]),
        )
        none = F.array().cast("array<bigint>")
        return F.when(F.size(hashed) >= words, many).when(F.size(hashed) > 0, F.array(F.xxhash64(hashed))).otherwise(none)

    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), _BLANK), lambda w: w != "")
    return _with(F.transform(tokens, lambda w: F.xxhash64(w)), shingles)


def sketch(text: Column, words: int = WORDS, scale: int = PLAIN_SCALE, least: int = 0) -> Column:
    """Ascending distinct shingle hashes of a text that lie in the lowest 1 / ``scale`` of all hashes, ``least`` at least."""
    return _with(shingle_hashes(text, words), lambda hashes: merged(hashes, scale, least))


def _limit(scale: int) -> int:
    return -(1 << 63) + (1 << 64) // scale


def merged(hashes: Column, scale: int = PLAIN_SCALE, least: int = 0) -> Column:
    """The sketch of a bag of hashes: those below the threshold, or else the ``least`` lowest (the smallest, for 0)."""
    if least:
        return _with(F.array_sort(F.array_distinct(hashes)), lambda x: _upto(x, bound(x, scale, least)))

    def kept(low: Column) -> Column:
        return F.when(F.size(low) > 0, low).when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(hashes)

    return _with(F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(_limit(scale))))), kept)


def bound(hashes: Column, scale: int, least: int) -> Column:
    """The highest hash value up to which ascending distinct ``hashes`` of a whole text are its sketch.

    That is the threshold, the ``least``-th hash if it is higher, or the end of the range if there are fewer.
    Plain sketches (``least`` 0) have no such bound and are taken whole.
    """
    if not least:
        return F.lit(_TOP)
    return F.greatest(F.lit(_limit(scale) - 1), F.coalesce(F.get(hashes, F.lit(least - 1)), F.lit(_TOP)))


def _upto(hashes: Column, highest: Column) -> Column:
    return F.filter(hashes, lambda h: h <= highest)


def likeness(a: Column, b: Column) -> Column:
    """Share of the smaller sketch found in the larger: 1 for two empty ones, 0 for an empty and another."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0))


def digits(hashes: Column) -> Column:
    """A sketch as text: 16 hex digits per hash, comma-joined."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ",")


def _successors(ids: DataFrame) -> DataFrame:
    """``ids`` (doc_id, need, reach; distinct, not null) to rows doc_id, previous, previous_need, previous_reach: who comes before each, in a ring.

    Ranges of ids are numbered and stored; a window looks inside each, and one row per range carries the
    last id over to the next range.
    """
    ranged = stored(ids.repartitionByRange("doc_id").withColumn("range", F.spark_partition_id()), "id-ranges")
    inside = Window.partitionBy("range").orderBy("doc_id")
    rows = ranged.withColumn("before", F.lag(F.struct("doc_id", "need", "reach")).over(inside))
    ends = ranged.groupBy("range").agg(F.max(F.struct("doc_id", "need", "reach")).alias("end"))
    along = Window.partitionBy(F.lit(0)).orderBy("range")  # one row per range
    last = F.last("end").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    carried = ends.select("range", F.coalesce(F.lag("end").over(along), last).alias("carried"))
    found = rows.join(carried, "range").withColumn("before", F.coalesce("before", "carried"))
    return found.select("doc_id", F.col("before.doc_id").alias("previous"), F.col("before.need").alias("previous_need"), F.col("before.reach").alias("previous_reach"))


def edited_fingerprints(docs: DataFrame, words: int = WORDS, scale: int = PLAIN_SCALE, least: int = 0) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next.

    The edited text is the text with its last quarter (rounded down) replaced by as many first
    characters of the next document, ascending doc_id, the first after the last. Rows that share a
    doc_id have the same next one; of several next rows the smallest text is taken. A null doc_id has
    no place in that order, and such a row is its own next document. A null text is empty. Columns other
    than doc_id and text are not read. With ``least``, both texts of a likeness are taken up to the higher
    of their bounds: the next text brings its hashes up to the highest bound of the rows before it.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.col("doc_id") if docs.schema["doc_id"].dataType.simpleString() == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(number, body.alias("text"))
    need = F.floor(F.length("text") / 4).cast("int")

    def whole(text: Column) -> Column:
        """What sketches are cut from: ascending distinct hashes; plain sketches are cut at once."""
        if not least:
            return sketch(text, words, scale)
        return F.array_sort(F.array_distinct(shingle_hashes(text, words)))

    def reach(hashes: Column) -> Column:
        return bound(hashes, scale, least)

    own = whole(F.col("text"))
    reached = _with(own, reach) if least else F.lit(_TOP)
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max(need).alias("need"), F.max(reached).alias("reach"))
    order = _successors(ids)
    named = rows.where("doc_id is not null")
    known = named.join(stored(order, "id-order").hint("merge"), "doc_id")

    def carried(hashes: Column) -> Column:
        return F.struct(_upto(hashes, F.greatest(reach(hashes), F.col("previous_reach"))).alias("own"), reach(hashes).alias("reach"))

    donor = F.struct(F.expr("substring(text, 1, previous_need)").alias("text"), _with(own, carried).alias("of"))
    donated = known.groupBy(F.col("previous").alias("doc_id")).agg(F.min(donor).alias("next"))
    # both joins read one exchange of the texts, since sketches are made above it
    paired = named.join(donated.hint("merge"), "doc_id").withColumn("own", own)
    loose = rows.where("doc_id is null").withColumn("own", own)
    loose = loose.withColumn("next", F.struct("text", F.struct("own", reach(F.col("own")).alias("reach")).alias("of")))
    both = paired.unionByName(loose.select(paired.columns))
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.expr("substring(next.text, 1, cast(floor(length(text) / 4) as int))"))
    made = both.withColumn("edited", edited).withColumn("changed", whole(F.col("edited")))

    def near(a: Column, b: Column, b_reach: Column) -> Column:
        highest = F.greatest(reach(a), b_reach)
        return likeness(_upto(a, highest), _upto(b, highest))

    own, changed = F.col("own"), F.col("changed")
    return made.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digits(_upto(own, reach(own))).alias("fingerprint"), digits(_upto(changed, reach(changed))).alias("edited_fingerprint"),
        near(own, changed, reach(changed)).alias("near_edited"), near(own, F.col("next.of.own"), F.col("next.of.reach")).alias("near_next"),
    )
