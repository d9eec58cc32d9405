"""Document fingerprints by Order MinHash: minimal k-mers in text order, hashed as tuples. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import WORD, let, partitions

#: k-mers of so many words; buckets, each giving one tuple; k-mers in a tuple.
WORDS, BUCKETS, TUPLE = 3, 64, 2
#: Bits of a place: no string is long enough for more words.
_PLACES = 28


def order_minhash(text: Column, words: int = WORDS, buckets: int = BUCKETS) -> Column:
    """The fingerprint of a text: a sorted array of up to `buckets` numbers, bucket and tuple hash in one.

    Every run of `words` words is a k-mer (a shorter text is one), numbered by its occurrence in the text. A hash of k-mer
    and number deals them over the buckets (up to 64). In each, the two that are least by hash are selected, put in the
    order in which they stand in the text, and hashed as a tuple: so what a text holds, how often, and in which order
    counts. White space only separates words; a text without words has an empty fingerprint.
    """
    def grams(hashes: Column) -> Column:
        last = F.size(hashes) - words
        longer = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(hashes, i + j) for j in range(words)]), _PLACES))
        single = F.array(F.shiftrightunsigned(F.xxhash64(hashes), _PLACES))
        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).when(last < 0, single).otherwise(longer)

    def numbered(kmers: Column) -> Column:
        once = F.transform(kmers, lambda x, i: _placed(x, F.lit(0), i, buckets))
        ordered = F.sort_array(F.transform(kmers, lambda x, i: F.shiftleft(x, _PLACES).bitwiseOR(i.cast("bigint"))))
        return F.when(F.size(F.array_distinct(kmers)) == F.size(kmers), once).otherwise(let(ordered, repeated))

    def repeated(ordered: Column) -> Column:
        kmer = lambda x: F.shiftrightunsigned(x, _PLACES)
        heads = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (kmer(F.get(ordered, i)) != kmer(F.get(ordered, i - 1))))
        number = let(heads, lambda h: F.flatten(F.zip_with(h, F.concat(F.slice(h, 2, F.size(h)), F.array(F.size(ordered))), lambda a, b: F.sequence(F.lit(0), b - a - 1))))
        return F.zip_with(ordered, number, lambda x, n: _placed(kmer(x), n, x.bitwiseAND(F.lit((1 << _PLACES) - 1)), buckets))

    hashes = F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.xxhash64(w))
    return let(F.sort_array(let(let(hashes, grams), numbered)), _tuples)


def _placed(kmer: Column, number: Column, place: Column, buckets: int) -> Column:
    """bucket, 30 bits of the hash of k-mer and number, and place in one number, from the highest bits down."""
    h = F.xxhash64(kmer, number)
    return F.shiftleft(F.pmod(h, F.lit(buckets)), 30 + _PLACES).bitwiseOR(F.shiftleft(F.shiftrightunsigned(h, 34), _PLACES)).bitwiseOR(place.cast("bigint"))


def _tuples(grams: Column) -> Column:
    high = 30 + _PLACES
    bucket = lambda x: F.shiftrightunsigned(x, high)
    place = lambda x: x.bitwiseAND(F.lit((1 << _PLACES) - 1))
    kmer = lambda x: F.shiftrightunsigned(x, _PLACES)

    def made(x: Column, i: Column, of: Column) -> Column:
        y = F.get(of, i + 1)
        pair = F.when(bucket(y) != bucket(x), F.xxhash64(kmer(x))).when(y.isNull(), F.xxhash64(kmer(x)))
        pair = pair.when(place(x) <= place(y), F.xxhash64(kmer(x), kmer(y))).otherwise(F.xxhash64(kmer(y), kmer(x)))
        return F.shiftleft(bucket(x), 32).bitwiseOR(pair.bitwiseAND(F.lit((1 << 32) - 1)))

    heads = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda i: (i == 0) | (bucket(F.get(grams, i)) != bucket(F.get(grams, i - 1))))
    return F.when(F.size(grams) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(heads, lambda i: made(F.get(grams, i), i, grams)))


def likeness(a: Column, b: Column) -> Column:
    """The share of the buckets used by either fingerprint in which they agree; 1 for two empty ones."""
    used = lambda x: F.transform(x, lambda v: F.shiftright(v, 32))
    either = F.size(F.array_union(used(a), used(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def shown(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda v: F.lower(F.hex(v))), ".")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with _text (null: empty), _fp and the next row's _next_text, _next_fp by ascending doc_id; the
    first follows the last.

    Quantiles of doc_id, one number for each task, cut the table into ranges; each is ordered in its own task, and the
    first row of every range, one for each task, is handed to the range before it. Null ids come first, in the order of a
    hash of their text, by which they are cut too; rows of equal id are in the order of their text.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    bounds = sorted(set(cuts or []))
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    turn = F.when(F.col("doc_id").isNull(), F.xxhash64("_text"))
    unknown = F.floor((F.col("_turn") / float(1 << 64) + 0.5) * n).cast("int") - n - 1
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_turn", turn).withColumn("_part", F.when(F.col("doc_id").isNull(), unknown).otherwise(part))
    inside = Window.partitionBy("_part").orderBy(F.col("doc_id").asc_nulls_first(), "_turn", "_text")
    first = rows.withColumn("_nth", F.row_number().over(inside)).where("_nth = 1").select("_part", F.struct("_text", order_minhash(F.col("_text")).alias("_fp")).alias("_own"))
    parts = Window.orderBy("_part")
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = first.select("_part", F.coalesce(F.lead("_own").over(parts), F.first("_own").over(whole)).alias("_after"))
    rows = rows.withColumn("_fp", order_minhash(F.col("_text"))).withColumn("_ahead", F.lead(F.struct("_text", "_fp")).over(inside)).join(first, "_part")
    after = F.coalesce("_ahead", "_after")
    return rows.select("doc_id", "_text", "_fp", after["_text"].alias("_next_text"), after["_fp"].alias("_next_fp"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for docs (doc_id, text): each text's fingerprint, that of its edited text, and likenesses.

    The edited text has the last half of the code points replaced by as many of the next document's first. Null text is
    empty; repeated rows count each, in the order with_next() states; a table of one row is its own next; an empty table
    gives none; other columns are ignored.
    """
    n = F.char_length("_text")
    rows = with_next(docs).withColumn("n_chars", n.cast("long")).withColumn("_half", F.floor(n / 2).cast("int"))
    rows = rows.withColumn("_edited", F.concat(F.substring("_text", F.lit(1), n - F.col("_half")), F.substring("_next_text", F.lit(1), F.col("_half"))))
    rows = rows.withColumn("_edited_fp", order_minhash(F.col("_edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), shown(F.col("_fp")).alias("fingerprint"), shown(F.col("_edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("_fp"), F.col("_edited_fp")).alias("near_edited"), likeness(F.col("_fp"), F.col("_next_fp")).alias("near_next"),
    )
