"""Document fingerprints: Order MinHash signatures sensitive to edit distance (DataFrame functions only).

A text's k-mers are its runs of ``k`` words (all its words, if fewer). A k-mer is numbered by its occurrence, so that
repeats count, and each numbered k-mer has a hash. The hashes are split into ``bins`` by their highest bits; in every
bin the ``picked`` smallest numbered k-mers are selected, put back in text order, and hashed as a tuple. The
signature has one entry for each bin that is not empty: bin and 32 bits of the tuple's hash. Likeness is the share of
equal entries among the bins that are not empty in either signature (1 if all are empty in both).

Everything is done inside one row with arrays of 64-bit numbers (33 bits of hash, 30 of the position), sorted twice;
the cost is n log n in the number of words and the arrays have a few entries for each word.

``with_neighbours`` compares each document with an edited form of its text and with the next document in descending
order of ids. Rows are dealt out by ranges of ids whose bounds are ids of the table (sampled quantiles, as many as
shuffle partitions); the row at a bound is also copied to the range above it, whose last row needs it. So no global
order is needed and texts are shuffled once.

Defined cases: a null text is empty; a text without words has an empty fingerprint; equal texts have equal
fingerprints; rows with the same id are ordered by a hash of their text; a null id comes last; with a single row the
next document is the row itself. Input columns are kept by ``fingerprint``; ``with_neighbours`` returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
BINS_LOG2 = 5
PICKED = 2

_POS = 30
_HASH = 33
_POS_MASK = (1 << _POS) - 1
_HASH_MASK = (1 << _HASH) - 1


def _hash(x: Column) -> Column:
    return F.shiftright(x, _POS)


def _packed(h: Column, pos: Column) -> Column:
    return F.shiftleft(h.bitwiseAND(F.lit(_HASH_MASK)), _POS).bitwiseOR(pos)


def signature(words: Column, k: int = K, bins_log2: int = BINS_LOG2, picked: int = PICKED) -> Column:
    """Entries (bin and hash, 10 hexadecimal digits) of the Order MinHash signature of an array of words."""
    none = F.lit("")

    def kmers(words: Column) -> Column:
        n = F.size(words)
        starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.sort_array(F.transform(starts, lambda i: _packed(F.xxhash64(*[F.coalesce(F.get(words, i + j), none) for j in range(k)]), i.cast("bigint"))))
    # transform(array(x), f)[0] computes x once and names it
    s = F.transform(F.array(words), kmers)[0]
    return F.transform(F.array(s), lambda s: _bins(_numbered(s), bins_log2, picked))[0]


def _numbered(s: Column) -> Column:
    """Hashes of (k-mer, occurrence) with positions, sorted; ``s``: sorted k-mer hashes with positions."""
    new = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (_hash(F.get(s, i - 1)) != _hash(x)), i)), lambda i: i.isNotNull())

    def run(starts: Column) -> Column:
        return F.flatten(F.transform(starts, lambda a, j: F.transform(
            F.sequence(a, F.coalesce(F.get(starts, j + 1), F.size(s)) - 1),
            lambda p: _packed(F.xxhash64(_hash(F.get(s, p)), p - a), F.get(s, p).bitwiseAND(F.lit(_POS_MASK))))))
    return F.sort_array(F.transform(F.array(new), run)[0])


def _bins(t: Column, bins_log2: int, picked: int) -> Column:
    def of(x: Column) -> Column:
        return F.shiftright(x, _POS + _HASH - bins_log2)

    def entries(t: Column) -> Column:
        least = F.filter(t, lambda x, i: (i < picked) | (of(F.get(t, i - picked)) != of(x)))

        def entry(m: Column) -> Column:
            def tuple_at(x: Column, i: Column) -> Column:
                own = F.filter(F.slice(m, i + 1, picked), lambda y: of(y) == of(x))
                # text order: by position, which is moved in front of the hash
                ordered = F.sort_array(F.transform(own, lambda y: F.shiftleft(y.bitwiseAND(F.lit(_POS_MASK)), _HASH).bitwiseOR(_hash(y))))
                value = F.xxhash64(F.transform(ordered, lambda y: y.bitwiseAND(F.lit(_HASH_MASK))))
                return F.when((i == 0) | (of(F.get(m, i - 1)) != of(x)),
                              F.concat(F.lpad(F.hex(of(x)), 2, "0"), F.lpad(F.hex(value.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))
            return F.filter(F.transform(m, tuple_at), lambda e: e.isNotNull())
        return F.transform(F.array(least), entry)[0]
    return F.transform(F.array(t), entries)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters that aren't white space, lower-cased A-Z."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def fingerprint(text: Column, **shape: int) -> Column:
    """The signature's entries as one string, comma-joined."""
    return F.array_join(signature(words_of(text), **shape), ",")


def likeness(a: Column, b: Column) -> Column:
    """Equal entries over bins that aren't empty in either fingerprint; 1 if both are empty."""
    def entries(x: Column) -> Column:
        return F.filter(F.split(x, ","), lambda e: e != "")
    bins = F.size(F.array_union(F.transform(entries(a), lambda e: F.substring(e, 1, 2)), F.transform(entries(b), lambda e: F.substring(e, 1, 2))))
    return F.when(a == b, F.lit(1.0)).otherwise(F.size(F.array_intersect(entries(a), entries(b))) / F.greatest(bins, F.lit(1)))


def with_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **shape: int) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # at most n ids, each of them an id of the table; the last is the largest
    cuts = rows.agg(F.percentile_approx("doc_id", [(i + 1) / n for i in range(n)], 10_000).alias("q"), F.max("doc_id").alias("m")).first()
    bounds = sorted({*(cuts["q"] or []), *([cuts["m"]] if cuts["m"] is not None else [])})
    own = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<bigint>"), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(own)
    # a row at a bound is the first of its range; the range above it (above the last: the lowest) ends with a copy
    at_bound = F.col("doc_id").isin(bounds) if bounds else F.lit(False)
    ghost = F.struct(F.pmod(own + 1, F.lit(max(1, len(bounds)))).alias("range"), F.lit(1).alias("ghost"))
    real = F.struct(own.alias("range"), F.lit(0).alias("ghost"))
    dealt = rows.withColumn("fingerprint", fingerprint(F.col("text"), **shape)).withColumn(
        "place", F.explode(F.when(at_bound, F.array(real, ghost)).otherwise(F.array(real))))
    order = Window.partitionBy("place.range").orderBy("place.ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    after = F.lead(F.struct("text", "fingerprint")).over(order)
    if not bounds:  # no ids at all: the rows form a ring
        ring = Window.partitionBy("place.range").orderBy("place.ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        after = F.coalesce(after, F.first(F.struct("text", "fingerprint")).over(ring))
    length = F.length("text")
    part = F.floor(length / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), length - part), F.substring(F.col("next.text"), F.lit(1), part))
    return (
        dealt.withColumn("next", after).where("place.ghost = 0")
        .select("doc_id", length.cast("bigint").alias("n_chars"), "fingerprint", "next.fingerprint", edited.alias("edited")).toDF("doc_id", "n_chars", "fingerprint", "next_fingerprint", "edited")
        .withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("edited_fingerprint", fingerprint(F.col("edited"), **shape)).drop("edited")
        .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
    )
