"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text is cut into paragraphs (after every line end or sentence end, so that they join to the text again). Each paragraph hashes to a
wide vector; a fingerprint is the sum of its paragraphs' vectors modulo powers of two, so the order of paragraphs does not count and
a paragraph can be added or taken away without the text (``add``, ``remove``). The vector has two parts:

* ``STRONG`` lanes modulo 2^48, each the sum of a hash of its own of the paragraph's bytes: equal multisets of paragraphs have equal
  lanes, others differ but by accident.
* ``COUNTS`` signed counts, a whole long each, so that no text that fits a row can wrap one. A paragraph adds one to a single count or
  takes one from it. The cosine of two such vectors estimates the share of paragraphs in common.

Null and empty texts have no paragraphs; their fingerprint is the zero vector, alike to itself (1) and to no other (0). Very long texts
are one row's value; their counts do not wrap. Rows with a null id come first; rows that share an id go by a hash of their text. An empty table
gives no rows. Only the id and text columns are read, so that other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import SPREAD

PARAGRAPHS = r"(?<=[\n.!?])(?=[^\n.!?])"
STRONG, GROUPS, LANES = 4, 16, 7
COUNTS = GROUPS * LANES
_STRONG_MASK = (1 << 48) - 1
#: Least rows of a window bucket, most buckets, and most quantiles asked for; beyond the quantiles segments are cut evenly.
BUCKET_ROWS, MOST_BUCKETS, MOST_QUANTILES = 512, 1 << 16, 1024


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once however often it is used, also inside of lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fingerprint(text: Column) -> Column:
    """array<long>: COUNTS signed counts, then STRONG hash lanes."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPHS), lambda p: p != "")
    wide = lambda p: F.struct(F.xxhash64(p).alias("h"), *(F.xxhash64(F.lit(seed), p).alias(f"s{seed}") for seed in range(STRONG)))
    return once(F.transform(pieces, wide), _lanes)


def _lanes(hashed: Column) -> Column:
    zero = F.lit(0).cast("long")
    parts = F.transform(hashed["h"], lambda h: F.struct(F.shiftrightunsigned(h, 1).bitwiseAND(F.lit(GROUPS - 1)).alias("g"), F.pmod(F.shiftrightunsigned(h, 5), F.lit(LANES)).alias("lane"), (1 - 2 * h.bitwiseAND(F.lit(1))).cast("long").alias("sign")))
    numbers = lambda n: F.sequence(zero, F.lit(n - 1).cast("long"))

    def count(some: Column) -> Column:
        return F.transform(numbers(LANES), lambda k: F.aggregate(some, zero, lambda acc, p: acc + F.when(p["lane"] == k, p["sign"]).otherwise(zero)))

    def counts(parts: Column) -> Column:
        return F.flatten(F.transform(numbers(GROUPS), lambda g: once(F.filter(parts, lambda p: p["g"] == g), count)))

    def lane(seed: int) -> Column:
        return F.aggregate(hashed[f"s{seed}"], zero, lambda acc, h: (acc + h.bitwiseAND(F.lit(_STRONG_MASK))).bitwiseAND(F.lit(_STRONG_MASK)))

    return F.concat(once(parts, counts), F.array(*(lane(seed) for seed in range(STRONG))))


def add(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' paragraphs together."""
    return F.zip_with(_numbered(a), b, lambda p, y: _wrapped(p["x"] + y, p["i"]))


def remove(a: Column, b: Column) -> Column:
    """The fingerprint ``a`` without the paragraphs of ``b``, which it must hold."""
    return F.zip_with(_numbered(a), b, lambda p, y: _wrapped(p["x"] - y, p["i"]))


def _numbered(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))


def _wrapped(value: Column, i: Column) -> Column:
    return F.when(i < COUNTS, value).otherwise(value.bitwiseAND(F.lit(_STRONG_MASK)))


def as_hex(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x, i: F.lpad(F.lower(F.hex(x)), F.when(i < COUNTS, 16).otherwise(12), F.lit("0"))), "")


def signed_lanes(fp: Column) -> Column:
    """array<double> of COUNTS signed counts."""
    return F.transform(F.slice(fp, 1, COUNTS), lambda x: x.cast("double"))


def likeness(same: Column, a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the cosine of two arrays of signed lanes, at least 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    cosine = once(F.sqrt(dot(a, a) * dot(b, b)), lambda norm: F.when(norm == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / F.when(norm == 0, 1.0).otherwise(norm)))))
    return F.when(same, F.lit(1.0)).otherwise(cosine)


def with_next(docs: DataFrame, key: str, tie: str, columns: list[str]) -> DataFrame:
    """Each row with ``columns`` of the next row by ``key``, then ``tie`` (longs), as ``next_<column>``; the first row follows the last.

    One shuffle: rows go to buckets of consecutive keys (from quantiles of the keys alone), and the first row of each bucket also
    to the bucket before. The rows of a very frequent key are split by ranges of ``tie``, which should be a hash of what tells them apart.
    """
    n = docs.count()
    size = max(BUCKET_ROWS, -(-n // MOST_BUCKETS))
    segments = max(1, min(MOST_QUANTILES, -(-n // size)))
    bounds = docs.agg(F.percentile_approx(key, [k / segments for k in range(segments)], 20000)).first()[0] or [0]
    bounds = sorted(set(bounds))
    cuts = max(1, -(-n // (size * segments)))
    edges = F.array(*(F.lit(b).cast("long") for b in bounds))
    seg = F.greatest(F.size(F.filter(edges, lambda b: b <= F.col(key))), F.lit(1))
    bucket = (seg * cuts).cast("long")
    if cuts > 1:
        low, high = F.get(edges, seg - 1), F.coalesce(F.get(edges, seg), F.get(edges, seg - 1) + F.lit(bounds[-1] - bounds[0] + 1))
        bucket += F.least(F.lit(cuts - 1), F.greatest(F.lit(0), F.floor((F.col(key) - low) / (high - low) * cuts))).cast("long")
    heavy = docs.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(2 * size, n // SPREAD))
    heavy = F.broadcast(heavy.select(F.col(key).alias("_heavy"), F.ceil(F.col("_n") / size).alias("_parts")))  # fewer than SPREAD rows of two numbers
    top = F.shiftright(tie, 33) + (1 << 30)  # 31 bits, in the order of tie
    part = F.floor(top * F.coalesce("_parts", F.lit(1)) / F.lit(float(1 << 31)))
    homes = docs.join(heavy, F.col(key) == F.col("_heavy"), "left").withColumn("_b", F.struct(bucket.alias("b"), F.when(F.col("_parts").isNotNull(), F.col(key)).alias("k"), part.alias("p"))).drop("_heavy", "_parts")
    firsts = homes.groupBy("_b").agg(F.min(F.struct(key, tie)).alias("_first"))
    order = Window.orderBy("_first")
    firsts = firsts.select("_first", F.coalesce(F.lag("_b").over(order), F.max_by("_b", "_first").over(Window.partitionBy())).alias("_before"))
    halo = F.broadcast(firsts.select(F.col(f"_first.{key}").alias("_k"), F.col(f"_first.{tie}").alias("_t"), "_before"))  # a few numbers for each of about MOST_BUCKETS buckets
    dealt = homes.join(halo, (F.col(key) == F.col("_k")) & (F.col(tie) == F.col("_t")), "left")
    own, ahead = F.struct(F.col("_b").alias("to"), F.lit(0).alias("halo")), F.struct(F.col("_before").alias("to"), F.lit(1).alias("halo"))
    dealt = dealt.withColumn("_home", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, ahead)))).drop("_k", "_t", "_b", "_before")
    w = Window.partitionBy("_home.to").orderBy("_home.halo", key, tie)
    return dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns)).where("_home.halo = 0").drop("_home")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half of its code points replaced by the first ones of the next document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62))).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("_tie", F.xxhash64("text")), "_key", "_tie", ["text"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "text", "next_text", edited.alias("edited"))
    made = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("a"), fingerprint(F.col("edited")).alias("b"), fingerprint(F.col("next_text")).alias("c"))
    lanes = made.select("*", *(signed_lanes(F.col(x)).alias(f"l{x}") for x in "abc"))
    return lanes.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("a")).alias("fingerprint"), as_hex(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a") == F.col("b"), F.col("la"), F.col("lb")).alias("near_edited"), likeness(F.col("a") == F.col("c"), F.col("la"), F.col("lc")).alias("near_next"))
