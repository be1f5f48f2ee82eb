"""Document fingerprints by consistent weighted sampling, in built-in expressions only.

The terms of a text are its words (runs without the bytes 0x20, 0x09-0x0D), each with the number of times it occurs. For
sample k a term gets r and c from Gamma(2, 1) and b from (0, 1), all from hashes of the term and k. With weight w,
t = floor(ln w / r + b) and ln a = ln c - r (t + 1 - b); the term of the smallest a is the sample, together with its t.
Two texts take the same sample with a probability equal to their generalised Jaccard similarity, the sum of the smaller
weights over the sum of the larger. As a tells (term, t) apart, the smallest a itself is kept, as 32 bits.

A sample's a is exponential with the text's number of words n as rate, so it is below ENOUGH / n unless chance has it at
exp(-ENOUGH). Logarithms are therefore taken only of terms whose a may be below that, by a lower bound without any; a text of
which one sample stays above is sampled again with all its terms.

Weights are counted inside the row (sorted word hashes, runs), terms are exploded and aggregated by minimum in the task that
has joined the texts, by the key that they were joined on, so that neither terms nor samples move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.shared import following, stored

#: The standard error of a likeness is at most 0.0625 (0.05 at 0.8).
SAMPLES = 64
ENOUGH = 24.0
#: Samples that one row of a term serves; the code of more is too long to be compiled well.
AT_ONCE = 16
_WORD = r"[\x20\x09-\x0D]+"
_UNIT = float(1 << 21)


def weights(text: Column) -> Column:
    """array<struct<term, w>> of a text: 64-bit hash and count of each distinct word."""
    words = F.filter(F.split(text, _WORD), lambda x: x != "")
    return F.transform(words, lambda x: F.xxhash64(x))


def _counted(hashes: str) -> Column:
    """Runs of a sorted array column."""
    starts = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: (i == 0) | (F.col(hashes)[i] != F.get(F.col(hashes), i - 1)))
    starts = F.when(F.size(hashes) > 0, starts).otherwise(F.array().cast("array<int>"))
    return starts


def _uniform(h: Column, part: int) -> Column:
    bits = F.shiftrightunsigned(h, 21 * part).bitwiseAND(F.lit((1 << 21) - 1))
    return (bits.cast("double") + F.lit(0.5)) / F.lit(_UNIT)


def log_a(term: Column, w: Column, log_w: Column, most: Column, k: Column) -> Column:
    """ln a of a term with weight w in sample k, an int; null where a is sure to be above ``most``, and maybe not computed."""
    one, two = F.xxhash64(term, F.lit(2) * k), F.xxhash64(term, F.lit(2) * k + F.lit(1))
    q, p = _uniform(one, 0) * _uniform(one, 1), _uniform(one, 2) * _uniform(two, 0)
    r = -F.ln(q)
    c = -F.ln(p)
    b = _uniform(two, 1)
    t = F.when(log_w == 0, F.lit(0.0)).otherwise(F.floor(log_w / r + b).cast("double"))  # most terms come once
    # c >= 2 (1 - p) / (1 + p), and a / c is q ** (1 - b) >= q / (1 - b + b q) for a single word and >= q / w for others
    near = F.lit(2.0) * (F.lit(1.0) - p) * q <= most * (F.lit(1.0) + p) * F.when(log_w == 0, F.lit(1.0) - b + b * q).otherwise(w)
    return F.when(near, F.ln(c) - r * (t + F.lit(1.0) - b))


def sampled(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES, enough: float = ENOUGH) -> DataFrame:
    """(keys, copies, samples, whole): samples array<int> of each distinct ``keys``, which must fix the text; copies counts rows.

    A text without words has zeros. Where not ``whole``, a term left out might have been a sample; an infinite ``enough``
    leaves none out.
    """
    hashed = texts.select(*keys, F.sort_array(weights(F.col(text))).alias("_hashes"))
    runs = hashed.select(*keys, "_hashes", _counted("_hashes").alias("_starts"))
    pairs = F.transform("_starts", lambda p, j: F.struct(F.col("_hashes")[p].alias("term"), (F.coalesce(F.get(F.col("_starts"), j + 1), F.size("_hashes")) - p).alias("w")))
    most = F.when(F.size("_hashes") > 0, F.lit(enough) / F.size("_hashes")).alias("_most")
    terms = runs.select(*keys, most, F.posexplode_outer(pairs).alias("_at", "_x"))
    terms = terms.select(*keys, "_most", "_at", F.col("_x.term").alias("_t"), F.col("_x.w").cast("double").alias("_v"), F.ln(F.col("_x.w").cast("double")).alias("_w"))
    firsts = list(range(0, samples, AT_ONCE))
    terms = terms.select("*", F.explode(F.array(*map(F.lit, firsts))).alias("_first"))
    least = [F.min(log_a(F.col("_t"), F.col("_v"), F.col("_w"), F.col("_most"), F.col("_first") + F.lit(k))).alias(f"_{k}") for k in range(min(AT_ONCE, samples))]
    # a row counts once: at its first term, or at its only, null one
    merged = terms.groupBy(*keys, "_first").agg(F.sum(F.when(F.coalesce("_at", F.lit(0)) == 0, 1).otherwise(0)).alias("copies"), F.max("_most").alias("_most"), *least)
    every = [F.col(f"_{k}") for k in range(len(least))]
    whole = F.col("_most").isNull() | F.coalesce(F.forall(F.array(*every), lambda x: x <= F.ln("_most") - F.lit(1e-9)), F.lit(False))
    bits = lambda c: F.when(c.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    some = merged.select(*keys, "copies", "_first", whole.alias("whole"), F.array(*map(bits, every)).alias("_some"))
    one = some.groupBy(*keys).agg(F.max("copies").alias("copies"), F.min("whole").alias("whole"), *[F.max(F.when(F.col("_first") == k, F.col("_some"))).alias(f"_{k}") for k in firsts])
    return one.select(*keys, "copies", F.slice(F.concat(*[F.col(f"_{k}") for k in firsts]), 1, samples).alias("samples"), "whole")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def as_text(samples: Column) -> Column:
    """Eight hexadecimal digits per sample."""
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def edited(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(_k, _id, _next, _text, _edited): the key, as text and long, and each whole text and the one whose last quarter is the start of the next text.

    The next row is that of the next larger key (of rows with one key, that with the smallest text hash); after the last
    key, and after a null key, comes the first. Where all keys are null, nothing follows.
    """
    # ids as text, '' for null: both joins with texts are then on one column without nulls and share one shuffle of them
    name = F.coalesce(F.col(key).cast("long").cast("string"), F.lit(""))
    rows = docs.select(name.alias("_k"), F.coalesce(text, F.lit("")).alias("_text"))
    sizes = rows.groupBy("_k").agg(F.max(F.length("_text")).alias("_n"))
    first = docs.agg(F.min(F.col(key).cast("long"))).first()[0]
    ids = following(docs, key).select(F.col(key).cast("string").alias("_key"), F.col("following"))
    after = sizes.join(ids, F.col("_k") == F.col("_key"), "left").select(
        F.col("_k").alias("_before"), F.expr("_n div 4").alias("_quarter"), F.coalesce("following", F.lit(first).cast("long")).cast("string").alias("_next"))
    starts = after.join(rows, F.col("_next") == F.col("_k")).select(
        "_before", "_next", F.xxhash64("_text").alias("_h"), F.substring("_text", F.lit(1), F.col("_quarter").cast("int")).alias("_start"))
    starts = starts.groupBy("_before").agg(F.min(F.struct("_next", "_h", "_start")).alias("_s"))
    quarter = F.expr("cast(length(_text) div 4 as int)")
    joined = rows.join(starts, F.col("_k") == F.col("_before"), "left")
    whole = F.concat(F.substring("_text", F.lit(1), F.length("_text") - quarter), F.coalesce(F.substring("_s._start", F.lit(1), quarter), F.lit("")))
    return joined.select(
        "_k", F.nullif(F.col("_k"), F.lit("")).cast("long").alias("_id"), F.col("_s._next").cast("long").alias("_next"), "_text", whole.alias("_edited"))


def fingerprinted(docs: DataFrame, text: str = "text", key: str = "doc_id", samples: int = SAMPLES, enough: float = ENOUGH) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of ``docs``.

    A null text counts as empty; texts without words have the fingerprint of zeros and are alike. Repeated rows come out
    as often as they came in. See ``edited`` for null and repeated keys; near_next is null where nothing follows.
    """
    rows = edited(docs, text, key).select("_k", "_id", "_next", F.length("_text").cast("long").alias("_n"), F.xxhash64("_text").alias("_h"),
                                          F.sha2("_edited", 256).alias("_sha"), "_text", "_edited")
    keys = ["_k", "_id", "_next", "_n", "_h", "_sha"]  # rows are dealt by _k already

    def both(rows: DataFrame, enough: float) -> DataFrame:
        found = sampled(rows.select(*keys, F.posexplode(F.array("_text", "_edited")).alias("_which", "_body")), [*keys, "_which"], "_body", samples, enough)
        return stored(found.groupBy(*keys).agg(
            F.max("copies").alias("_copies"), F.max(F.when(F.col("_which") == 0, F.col("samples"))).alias("_a"),
            F.max(F.when(F.col("_which") == 1, F.col("samples"))).alias("_b"), F.min("whole").alias("_whole")), "weighted-samples")

    one = both(rows, enough)
    again = one.where(~F.col("_whole"))
    if not again.isEmpty():
        # the three fix both texts
        one = one.where("_whole").unionByName(both(rows.join(again.select("_k", "_h", "_sha"), ["_k", "_h", "_sha"], "left_semi"), float("inf")))
    nexts = one.where("_id is not null").groupBy(F.col("_id").alias("_key")).agg(F.min(F.struct("_h", "_a")).alias("_x"))
    near = one.join(nexts, F.col("_next") == F.col("_key"), "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return near.select(
        F.col("_id").alias(key), F.col("_n").alias("n_chars"), F.col("_sha").alias("edited_sha256"), as_text(F.col("_a")).alias("fingerprint"),
        as_text(F.col("_b")).alias("edited_fingerprint"), likeness(F.col("_a"), F.col("_b")).alias("near_edited"),
        likeness(F.col("_a"), F.col("_x._a")).alias("near_next"))
