"""Dictionary and attribute lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lookups import CONTRACTIONS, attribute_table

#: A dictionary of vectors is broadcast by Spark only where its size is known to be small; see spark.sql.autoBroadcastJoinThreshold.


def expansions() -> Column:
    """Map of the fixed contractions."""
    return F.create_map(*(F.lit(x) for pair in CONTRACTIONS.items() for x in pair))


def encode_words(tokens: DataFrame, vectors: DataFrame, dim: int, word: str = "word", auto_expand: bool = True) -> DataFrame:
    """Each token with its vector: the exact word's, else the mean over a contraction's parts (unknown parts count as zeros), else zeros.

    Distinct words are looked up, not tokens, so a frequent word costs one row.
    """
    words = tokens.select(F.col(word).alias("_w")).where("_w is not null").distinct()
    dictionary = vectors.select(F.col("word").alias("_d"), "vec")
    zero = F.array_repeat(F.lit(0.0), dim)
    exact = words.join(dictionary, F.col("_w") == F.col("_d"), "left").drop("_d")
    if auto_expand:
        parts = exact.where("vec is null").select("_w", F.try_element_at(expansions(), F.col("_w")).alias("_e")).where("_e is not null")
        parts = parts.select("_w", F.posexplode(F.split("_e", " ")).alias("_i", "_part")).join(dictionary, F.col("_part") == F.col("_d"), "left")
        numbers = parts.select("_w", "_i", F.posexplode(F.coalesce("vec", zero)).alias("_pos", "_x"))
        means = numbers.groupBy("_w", "_pos").agg(F.avg("_x").alias("_x")).groupBy("_w").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_x"))), lambda p: p["_x"]).alias("_mean"))
        exact = exact.join(means, "_w", "left").select("_w", F.coalesce("vec", "_mean").alias("vec"))
    found = exact.select("_w", F.coalesce("vec", zero).alias("vec"))
    return tokens.join(found, F.col(word) == F.col("_w"), "left").drop("_w").withColumn("vec", F.coalesce("vec", zero))


def phonemes_of(attributes: DataFrame, mode: str = "Arpabet", attribute: str = "attribute") -> DataFrame:
    """Each attribute (any case) with its phonemes; unknown ones give no row."""
    table = attribute_table(attributes.sparkSession).where(F.col("mode") == mode).select(F.col("attribute").alias("_a"), "phoneme")
    return attributes.join(F.broadcast(table), F.lower(attribute) == F.col("_a")).drop("_a")


def attributes_of(phones: DataFrame, mode: str = "Arpabet", phoneme: str = "phoneme") -> DataFrame:
    """Each phoneme (any case) with the array of its listed attributes in list order; ``semivowel`` is not listed."""
    table = attribute_table(phones.sparkSession).where((F.col("mode") == mode) & F.col("pos").isNotNull()).select(F.lower("phoneme").alias("_p"), "pos", "attribute")
    lists = table.groupBy("_p").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "attribute"))), lambda x: x["attribute"]).alias("attributes"))
    out = phones.join(F.broadcast(lists), F.lower(phoneme) == F.col("_p"), "left").drop("_p")
    return out.withColumn("attributes", F.coalesce("attributes", F.array().cast("array<string>")))
