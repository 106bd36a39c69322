"""Registered queries of the library's operators over the test tables, each with its SQL where SQL can say the same.

Floating results are rounded on both sides; arrays are compared as rows or texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import lookups, scalar
from ..operators import folds, intervals, linear, lookup, signal, stacking, stats, strf, tables, timeseries
from ..sources import files, formats

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir, or the warehouse where that is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


KEYS, ORDER = ["user_id"], ["ts", "event_id"]


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one series per user: user_id, event_id, ts, event_type, value, t_idx."""
    return timeseries.series_places(read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value"), KEYS, ORDER)


S = "s AS (SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t_idx FROM events)"
W = "(PARTITION BY user_id ORDER BY ts, event_id)"


@query("w1_lag_past", f"SELECT user_id, event_id, value AS value_lag0, coalesce(lag(value, 1) OVER {W}, 0.0) AS value_lag1, coalesce(lag(value, 2) OVER {W}, 0.0) AS value_lag2 FROM events")
def _(spark, d):
    return timeseries.lag_columns(read(spark, d, "events").select("user_id", "event_id", "ts", "value"), "value", timeseries.lag_steps(3), KEYS, ORDER).drop("ts", "value")


@query("w1_lag_future", f"SELECT user_id, event_id, value AS value_lag0, coalesce(lead(value, 1) OVER {W}, 0.0) AS value_lead1 FROM events")
def _(spark, d):
    return timeseries.lag_columns(read(spark, d, "events").select("user_id", "event_id", "ts", "value"), "value", timeseries.lag_steps(-2), KEYS, ORDER).drop("ts", "value")


@query("w2_match_lag", f"SELECT user_id, event_id, f, l, CASE l WHEN 0 THEN x WHEN 1 THEN coalesce(lag(x, 1) OVER v, 0.0) WHEN 2 THEN coalesce(lag(x, 4) OVER v, 0.0) ELSE coalesce(lead(x, 2) OVER v, 0.0) END AS x FROM (SELECT user_id, event_id, ts, f, l, CASE f WHEN 0 THEN value ELSE value * 2 END AS x FROM events, range(2) a(f), range(4) b(l)) WINDOW v AS (PARTITION BY user_id, f, l ORDER BY ts, event_id)")
def _(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "ts", F.array("value", F.col("value") * 2).alias("features"))
    s = timeseries.lag_stack(e, "features", [0, 1, 4, -2], KEYS, ORDER)
    return s.select("user_id", "event_id", F.posexplode("lags").alias("f", "row")).select("user_id", "event_id", F.col("f").cast("long").alias("f"), F.posexplode("row").alias("l", "x")).withColumn("l", F.col("l").cast("long"))


@query("w3_structure_lag", f"SELECT user_id, event_id, i, CASE i WHEN 0 THEN value WHEN 1 THEN value * 2 WHEN 2 THEN p ELSE p * 2 END AS x FROM (SELECT user_id, event_id, value, coalesce(lag(value) OVER {W}, 0.0) AS p FROM events), range(4) r(i)")
def _(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "ts", F.array("value", F.col("value") * 2).alias("features"))
    return timeseries.structure_lag(e, "features", 2, KEYS, ORDER).select("user_id", "event_id", F.posexplode("lagged").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


def _taps_sql(scale: float = 1.0) -> str:
    return f"raw AS (SELECT k, j, (j / 100.0) / {scale}::DOUBLE - k * 0.5::DOUBLE * 0.2::DOUBLE AS u FROM range(9) a(k), range(199) b(j)), pos AS (SELECT k, j, 0.5 * (1 - cos(2 * pi() * u / 0.2)) AS h FROM raw WHERE u > 0 AND u < 0.2), taps AS (SELECT k, j, h / (SELECT sum(h) FROM pos) AS h FROM pos)"


@query("w4_hanning_taps", "WITH s AS (SELECT n_nationkey, 0.5 + n_nationkey / 20.0::DOUBLE AS scale FROM nation), raw AS (SELECT n_nationkey, scale, k, j, (j / 100.0::DOUBLE) / scale - k * 0.5::DOUBLE * 0.2::DOUBLE AS u FROM s, range(9) a(k), range(199) b(j)), pos AS (SELECT *, 0.5 * (1 - cos(2 * pi() * u / 0.2)) AS h FROM raw WHERE u > 0 AND u < 0.2), taps AS (SELECT *, h / sum(h) OVER (PARTITION BY n_nationkey) AS h2 FROM pos) SELECT n_nationkey, k::INT AS k, j::INT AS j, round(h2, 9) AS h FROM taps WHERE h2 > 1e-12")
def _(spark, d):
    """The taps of a time scale for each nation."""
    scales = read(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") / 20.0 + 0.5).alias("scale"))
    return timeseries.taps_by_scale(scales, "scale").where("h > 1e-12").select("n_nationkey", "k", "j", F.round("h", 9).alias("h"))


def _fir_sql(scale: float) -> str:
    return f"WITH {S}, {_taps_sql(scale)}, grid AS (SELECT user_id, event_id, t_idx, k FROM s, range(9) r(k)) SELECT g.user_id, g.event_id, g.k::INT AS k, round(coalesce(sum(x.value * taps.h), 0), 6) AS y FROM grid g LEFT JOIN taps ON taps.k = g.k LEFT JOIN s x ON x.user_id = g.user_id AND x.t_idx = g.t_idx - taps.j GROUP BY ALL"


def _fir(scale: float) -> Query:
    def run(spark, d):
        e = read(spark, d, "events").select("user_id", "event_id", "ts", F.array("value").alias("features"))
        y = timeseries.hanning_feature(e, "features", KEYS, ORDER, scale=scale)
        return y.select("user_id", "event_id", F.posexplode(F.get("basis", F.lit(0))).alias("k", "y")).withColumn("y", F.round("y", 6))

    return run


query("w5_hanning_feature", _fir_sql(1.0))(_fir(1.0))


_RHO = 0.5
_RHO_SQL = " UNION ALL ".join(f"SELECT * FROM ({_fir_sql(scale)}) WHERE user_id % 2 = {k}" for k, scale in enumerate(timeseries.rho_scales(_RHO)))


@query("w6_hanning_rho", _RHO_SQL)
def _(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "ts", F.array("value").alias("features"))
    y = timeseries.hanning_from_rho(e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1"), _RHO, "features", KEYS, ORDER)
    return y.select("user_id", "event_id", F.posexplode(F.get("basis", F.lit(0))).alias("k", "y")).withColumn("y", F.round("y", 6))


def _wide_tap(scale: float) -> str:
    """One window as long as the response."""
    return f"(SELECT j, h / sum(h) OVER () AS h FROM (SELECT j, 0.5 * (1 - cos(2 * pi() * u)) AS h FROM (SELECT j, (j / 100.0::DOUBLE) / {scale}::DOUBLE AS u FROM range(199) b(j)) WHERE u > 0 AND u < 1))"


def _rho_fit(rho: float) -> str:
    parts = " UNION ALL ".join(f"SELECT s.user_id, s.event_id, coalesce((SELECT sum(x.value * taps.h) FROM {_wide_tap(scale)} taps JOIN s x ON x.user_id = s.user_id AND x.t_idx = s.t_idx - taps.j), 0) AS f FROM s WHERE user_id % 2 = {k}" for k, scale in enumerate(timeseries.rho_scales(rho)))
    return f"SELECT {rho}::DOUBLE AS rho, user_id, event_id, f FROM ({parts})"


_RHOS = [-0.5, 0.0, 0.5]


@query("m15_fit_over_rho", f"WITH {S}, f AS ({' UNION ALL '.join(map(_rho_fit, _RHOS))}), y AS (SELECT event_id, f.f + s.value * 0.05 AS y FROM f JOIN s USING (user_id, event_id) WHERE rho = {_RHO}) SELECT rho, round(corr(f, y) * sign(sum(f * y)), 6) AS r FROM f JOIN y USING (event_id) GROUP BY rho")
def _(spark, d):
    """The response follows rho 0.5, with something of the sample itself: how well each assumed rho fits it with one wide window."""
    one = {"hanning_width": 1.0, "dur": 1}
    e = read(spark, d, "events").select("user_id", "event_id", "ts", "value", F.array("value").alias("features"))
    fast, slow = e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1")
    y = F.get(F.get("basis", F.lit(0)), F.lit(0)) + F.col("value") * 0.05
    true = timeseries.hanning_from_rho(fast, slow, _RHO, "features", KEYS, ORDER, **one).select("user_id", "event_id", "ts", "features", y.alias("y"))
    return timeseries.fit_over_rho(true.where("user_id % 2 = 0"), true.where("user_id % 2 = 1"), _RHOS, "features", "y", KEYS, ORDER, **one).withColumn("r", F.round("r", 6))


@query("w7_islands", f"WITH {S}, g AS (SELECT user_id, event_type, t_idx, t_idx - row_number() OVER (PARTITION BY user_id, event_type ORDER BY t_idx) AS g FROM s) SELECT user_id, event_type, min(t_idx) / 100.0::DOUBLE AS onset, max(t_idx) / 100.0::DOUBLE AS \"offset\" FROM g GROUP BY user_id, event_type, g")
def _(spark, d):
    return timeseries.islands(series(spark, d), KEYS, "event_type")


SPANS = "spans AS (SELECT event_type AS label, value AS onset, value + 0.125 AS \"offset\", event_id FROM events)"
N = "n AS (SELECT max(floor(\"offset\" * 100))::BIGINT AS n FROM spans)"
COVER = "cover AS (SELECT label, event_id, onset, k FROM spans, n, LATERAL (SELECT unnest(range(greatest(0, floor(onset * 100)::BIGINT - 2), least(n, floor(\"offset\" * 100)::BIGINT + 3))) AS k) WHERE k / 100.0::DOUBLE BETWEEN onset AND \"offset\")"


def spans(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_type").alias("label"), F.col("value").alias("onset"), (F.col("value") + 0.125).alias("offset"), "event_id")


@query("j2_onehot", f"WITH {SPANS}, {N}, {COVER} SELECT DISTINCT k AS t_idx, label FROM cover")
def _(spark, d):
    s = spans(spark, d)
    return intervals.onehot_long(s, intervals.time_length(s))


@query("r7_onehot_wide", f"WITH {SPANS}, {N}, {COVER} SELECT t AS t_idx, coalesce(max((label = 'click')::INT), 0) AS click, coalesce(max((label = 'view')::INT), 0) AS view FROM n, LATERAL (SELECT unnest(range(n)) AS t) LEFT JOIN cover ON k = t GROUP BY t")
def _(spark, d):
    s = spans(spark, d)
    return intervals.onehot_wide(s, ["click", "view"], intervals.time_length(s))


@query("w9_onset_samples", f"WITH {SPANS}, {N}, {COVER} SELECT DISTINCT k AS t_idx, label FROM (SELECT label, event_id, min(k) AS k FROM cover GROUP BY ALL)")
def _(spark, d):
    s = spans(spark, d)
    return intervals.onehot_long(s, intervals.time_length(s), onset_feature=True)


@query("j4_next_sample", "SELECT DISTINCT event_type AS label, CASE WHEN (ceil(value * 100) - 1) / 100.0::DOUBLE >= value THEN ceil(value * 100) - 1 WHEN ceil(value * 100) / 100.0::DOUBLE >= value THEN ceil(value * 100) ELSE ceil(value * 100) + 1 END::BIGINT AS t_idx FROM (SELECT event_type, value + 0.0031 AS value FROM events)")
def _(spark, d):
    s = read(spark, d, "events").select(F.col("event_type").alias("label"), (F.col("value") + 0.0031).alias("onset"), (F.col("value") + 0.0032).alias("offset"))
    return intervals.onehot_long(s, intervals.time_length(s) + 2, onset_feature=True)


@query("j3_last_writer", f"WITH {SPANS}, {N}, {COVER} SELECT t AS t_idx, coalesce(max_by(onset, event_id), 0.0) AS onset FROM n, LATERAL (SELECT unnest(range(n)) AS t) LEFT JOIN cover ON k = t GROUP BY t")
def _(spark, d):
    s = spans(spark, d)
    s = s.withColumn("x", F.col("onset"))
    return intervals.last_writer(s, "x", "event_id", intervals.time_length(s), 100, F.lit(0.0)).withColumnRenamed("x", "onset")


@query("w8_onset_raster", "WITH o AS (SELECT s_suppkey / 40.0::DOUBLE AS onset FROM supplier) SELECT t AS t_idx, coalesce(max((t / 100.0::DOUBLE BETWEEN onset AND onset + 1 / 100.0::DOUBLE)::INT), 0) AS value FROM range(300) r(t), o GROUP BY t")
def _(spark, d):
    return intervals.onset_raster(read(spark, d, "supplier").select((F.col("s_suppkey") / 40.0).alias("onset")), 300)


_J1_SQL = "WITH p AS (SELECT user_id, event_id AS idx, event_type AS text, value AS onset, value + 0.5 AS \"offset\" FROM events), w AS (SELECT u.user_id, k AS idx, 'w' || k AS text, k * 10.0::DOUBLE AS onset, k * 10.0::DOUBLE + 11 AS \"offset\" FROM (SELECT DISTINCT user_id FROM events) u, range(1000) r(k)) SELECT p.user_id, p.text AS phoneme, p.onset AS phoneme_absolute_onset, p.\"offset\" AS phoneme_absolute_offset, w.text AS word, w.onset AS word_absolute_onset, w.\"offset\" AS word_absolute_offset, w.idx::INT AS word_index, p.onset - w.onset AS phoneme_relative_onset, p.\"offset\" - w.onset AS phoneme_relative_offset FROM p JOIN w ON p.user_id = w.user_id AND w.onset <= p.onset AND w.\"offset\" >= p.\"offset\" QUALIFY row_number() OVER (PARTITION BY p.idx ORDER BY w.idx) = 1"


def _words_of_users(spark: SparkSession, events: DataFrame) -> DataFrame:
    """1000 words a user. Users are dealt to so many tasks, since adaptive execution sees few users, not the words that are made of them, and would give all to one."""
    users = events.select("user_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id").distinct()
    w = users.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(999))))
    return w.select("user_id", "idx", F.concat(F.lit("w"), F.col("idx").cast("string")).alias("text"), (F.col("idx") * 10.0).alias("onset"), (F.col("idx") * 10.0 + 11).alias("offset"))


def _phones_in_words(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    p = e.select("user_id", F.col("event_id").alias("idx"), F.col("event_type").alias("text"), F.col("value").alias("onset"), (F.col("value") + 0.5).alias("offset"))
    return intervals.containment_join(p, _words_of_users(spark, e), 10, KEYS)


query("j1_phone_in_word", _J1_SQL)(_phones_in_words)


@query("j10_interpolate", f"WITH {S}, seg AS (SELECT user_id, t_idx * 1.0 AS t0, value AS x0, lead(t_idx * 1.0) OVER v AS t1, lead(value) OVER v AS x1 FROM s WINDOW v AS (PARTITION BY user_id ORDER BY t_idx)) SELECT user_id, t0 + 0.25 AS t, round(x0 + 0.25 * (x1 - x0), 6) AS x_new FROM seg WHERE t1 IS NOT NULL")
def _(spark, d):
    s = series(spark, d).select("user_id", F.col("t_idx").cast("double").alias("t"), F.col("value").alias("x"))
    return timeseries.interpolate(s, s.select("user_id", (F.col("t") + 0.25).alias("t")), KEYS, bin_width=4).withColumn("x_new", F.round("x_new", 6))


@query("pf1_filter_at", "SELECT event_id, 0 AS at_idx FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 1 FROM events WHERE event_type = 'click' AND user_id = 8")
def _(spark, d):
    return tables.filter_at(read(spark, d, "events"), [{"event_type": "click"}, {"event_type": "click", "user_id": 8}]).select("event_id", "at_idx")


@query("pf6_usable_targets", "SELECT l_returnflag AS target, (stddev_pop(l_tax) <> 0 AND NOT bool_or(l_tax IS NULL OR isnan(l_tax))) AS usable FROM lineitem GROUP BY 1")
def _(spark, d):
    return stats.usable_targets(read(spark, d, "lineitem").select(F.col("l_returnflag").alias("target"), "l_tax"), "target", "l_tax")


CELLS = "cells AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_linenumber AS rep, l_quantity::INT AS data, l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem)"


def _place_sum(value: str) -> str:
    return f"sum(('0x' || substr(md5(place || ':' || {value}), 1, 15))::BIGINT)::VARCHAR"


SAMPLE_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"]


def samples(spark: SparkSession, d: str) -> DataFrame:
    """The samples of the cells as rows."""
    return read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("rep"), *SAMPLE_ORDER, F.col("l_quantity").cast("int").alias("data"))


_CELL_ORDER = "l_orderkey, l_partkey, l_suppkey, l_quantity"


@query("a1_concatenate", f"WITH {CELLS}, p AS (SELECT *, row_number() OVER (PARTITION BY flag, status ORDER BY rep, {_CELL_ORDER}) - 1 AS place FROM cells) SELECT flag, status, {_place_sum('data')} AS data, {_place_sum('rep')} AS mask FROM p GROUP BY flag, status")
def _(spark, d):
    c = tables.digest_concatenated(samples(spark, d), ["rep"], SAMPLE_ORDER, fold_mask=True)
    return c.select("flag", "status", "data", F.col("rep_mask").alias("mask"))


@query("a1_concatenate_two", f"WITH {CELLS}, p AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY status, rep, {_CELL_ORDER}) - 1 AS place FROM cells) SELECT flag, {_place_sum('data')} AS data FROM p GROUP BY flag")
def _(spark, d):
    return tables.digest_concatenated(samples(spark, d), ["rep", "status"], SAMPLE_ORDER).select("flag", "data")


@query("a1_concatenated_rows", f"WITH {CELLS} SELECT flag, status, data, rep AS rep_mask, row_number() OVER (PARTITION BY flag, status ORDER BY rep, {_CELL_ORDER}) - 1 AS place FROM cells")
def _(spark, d):
    return tables.concatenate_rows(samples(spark, d), ["rep"], SAMPLE_ORDER)


@query("j5_replicate", "WITH f AS (SELECT n_regionkey AS region, max(n_nationkey) AS feature FROM nation GROUP BY 1), x AS (SELECT n_regionkey AS region, n_name AS name, n_nationkey AS data FROM nation) SELECT region, name, data, feature FROM x FULL JOIN f USING (region)")
def _(spark, d):
    n = read(spark, d, "nation")
    data = n.select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("data"))
    feature = n.groupBy(F.col("n_regionkey").alias("region")).agg(F.max("n_nationkey").alias("feature"))
    features, rows = tables.replicate_data_feature(feature, data)
    return rows.join(features, ["region", "name"])


@query("j6_levels", "WITH a AS (SELECT DISTINCT c_nationkey % 20 AS n FROM customer), b AS (SELECT DISTINCT s_nationkey % 23 + 3 AS n FROM supplier) SELECT 'nation' AS variable, n::VARCHAR AS level, CASE WHEN n IN (FROM a) THEN 'left' ELSE 'right' END AS side FROM (FROM a UNION FROM b) WHERE (n IN (FROM a)) <> (n IN (FROM b))")
def _(spark, d):
    return tables.levels_differ(read(spark, d, "customer").select((F.col("c_nationkey") % 20).alias("nation")), read(spark, d, "supplier").select((F.col("s_nationkey") % 23 + 3).alias("nation")), ["nation"])


_TOKENS_SQL = "tok AS (SELECT conv_id, turn, w, i FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws, generate_subscripts(string_split(text, ' '), 1) AS i, unnest(string_split(text, ' ')) AS w FROM conversations) UNION ALL SELECT -1, 0, unnest(['can''t', 'he''d', 'it''s', 'zzz']), 0), vec AS (SELECT DISTINCT w AS word, strlen(w)::DOUBLE AS x FROM tok WHERE length(w) BETWEEN 1 AND 4 UNION SELECT unnest(['he', 'would', 'cannot']), unnest([2.0, 5.0, 6.0]))"
_EXPAND_SQL = "SELECT unnest(['can''t', 'he''d', 'it''s']) AS c, unnest(['cannot', 'he would', 'it is']) AS e"


@query("j7_encode_words", f"WITH {_TOKENS_SQL}, v1 AS (SELECT word, max(x) AS x FROM vec GROUP BY 1), ex AS ({_EXPAND_SQL}), parts AS (SELECT c, unnest(string_split(e, ' ')) AS p FROM ex), m AS (SELECT c, avg(coalesce(x, 0)) AS x FROM parts LEFT JOIN v1 ON word = p GROUP BY c) SELECT conv_id, turn, w AS word, round(coalesce(v1.x, m.x, 0), 6) AS x0 FROM tok LEFT JOIN v1 ON word = w LEFT JOIN m ON c = w WHERE w <> 'it''s'")
def _(spark, d):
    t = read(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("word"))
    t = t.unionByName(spark.createDataFrame([(-1, 0, w) for w in ("can't", "he'd", "zzz")], "conv_id long, turn long, word string"))
    short = t.where("char_length(word) between 1 and 4").select("word", F.octet_length("word").cast("double").alias("x")).unionByName(spark.createDataFrame([("he", 2.0), ("would", 5.0), ("cannot", 6.0)], "word string, x double"))
    v = short.groupBy("word").agg(F.array(F.max("x")).alias("vec"))
    return lookup.encode_words(t, v, 1).select("conv_id", "turn", "word", F.round(F.get("vec", F.lit(0)), 6).alias("x0"))


_ATTR = ", ".join(f"('{m}', {lookups.ATTRIBUTES.index(a) if a in lookups.ATTRIBUTES else 'NULL'}, '{a}', '{p}')" for m in ("Arpabet", "IPA") for a in lookups.ARPABET for p in lookups.phonemes(a, m))
_ASKED = ["Back", "NASAL", "semivowel", "none", "labial", "Stop", "vowel"]
_PHONES = ["AA", "hh", "Zh", "NG", "w", "ER", "b", "TH", "?"]


def _of_part(spark: SparkSession, d: str, values: list[str], name: str) -> DataFrame:
    """One of some values for each part, by its size."""
    return read(spark, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, values)), (F.col("p_size") % len(values)).cast("int")).alias(name))


@query("j8_attribute_phonemes", f"WITH a(mode, pos, attribute, phoneme) AS (VALUES {_ATTR}), p AS (SELECT p_partkey, {_ASKED!r}[p_size % {len(_ASKED)} + 1] AS asked FROM part) SELECT p_partkey, 'Vowel-' || attribute AS tag, phoneme FROM p JOIN a ON attribute = lower(asked) WHERE mode = 'IPA'")
def _(spark, d):
    return lookup.phonemes_of(_of_part(spark, d, _ASKED, "attribute"), "IPA").select("p_partkey", F.concat(F.lit("Vowel-"), F.lower("attribute")).alias("tag"), "phoneme")


@query("j9_phoneme_attributes", f"WITH a(mode, pos, attribute, phoneme) AS (VALUES {_ATTR}), p AS (SELECT p_partkey, {_PHONES!r}[p_size % {len(_PHONES)} + 1] AS phoneme FROM part) SELECT p_partkey, any_value(p.phoneme) AS phoneme, coalesce(string_agg(attribute, ' ' ORDER BY pos), '') AS attributes FROM p LEFT JOIN a ON lower(a.phoneme) = lower(p.phoneme) AND mode = 'Arpabet' AND pos IS NOT NULL GROUP BY 1")
def _(spark, d):
    return lookup.attributes_of(_of_part(spark, d, _PHONES, "phoneme")).select("p_partkey", "phoneme", F.array_join("attributes", " ").alias("attributes"))


@query("a2_mean_arrays", "SELECT label, pos, round(avg(x), 5) AS x FROM (SELECT label, generate_subscripts(embedding, 1)::INT - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL")
def _(spark, d):
    e = read(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
    return tables.mean_arrays(e, ["label"], "embedding").select("label", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 5))


@query("a3_column_statistics", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) AS norm FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def _(spark, d):
    s = stats.column_statistics(read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return s.select("column", F.round("mean", 6).alias("mean"), F.round("norm", 6).alias("norm"))


@query("a3_standardise", "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity FROM lineitem")
def _(spark, d):
    s = stats.standardise(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"])
    return s.withColumn("l_quantity", F.round("l_quantity", 6))


@query("a4_correlate", "SELECT l_returnflag AS target, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def _(spark, d):
    return stats.correlate_columns(read(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice").select(F.col("l_returnflag").alias("target"), F.round("r", 6).alias("r"))


_A5 = "x AS (SELECT l_linenumber AS g, unnest([1, 2]) AS t, unnest([l_extendedprice, l_quantity * 900]) AS y, unnest([l_quantity * 1500, l_extendedprice * 0.6]) AS p FROM lineitem)"


@query("a5_scores", f"WITH {_A5}, m AS (SELECT g, t, y, p, avg(y) OVER (PARTITION BY g, t) AS own FROM x) SELECT g, round(avg((p - y) ** 2), 1) AS mse, round(1 - sum((p - y) ** 2) / sum((y - own) ** 2), 6) AS r2, round(corr(y, p), 6) AS r FROM m GROUP BY g")
def _(spark, d):
    pair = lambda y, p: F.struct(y.alias("y"), p.alias("p"))
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    x = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("g"), F.posexplode(F.array(pair(price, quantity * 1500), pair(quantity * 900, price * 0.6))).alias("t", "v")).select("g", "t", "v.*")
    return stats.scores(x, "t", keys=["g"]).select("g", F.round("mse", 1).alias("mse"), F.round("r2", 6).alias("r2"), F.round("r", 6).alias("r"))


@query("a6_mse", "SELECT l_linenumber AS target, round(avg((l_quantity * 0.05 - l_tax) ** 2), 6) AS mse FROM lineitem GROUP BY 1")
def _(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("target"), F.col("l_tax").alias("y"), (F.col("l_quantity") * 0.05).alias("p"))
    return stats.mse_per_target(x, "target").withColumn("mse", F.round("mse", 6))


_ERRORS = "e AS (SELECT o_orderkey AS row_id, o_orderpriority AS target, 1 AS m, o_totalprice / 1000 - 100 AS e FROM orders UNION ALL SELECT o_orderkey, o_orderpriority, 2, (o_custkey % 100) - 40.0 FROM orders)"


def errors(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    base = [F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("target")]
    a = o.select(*base, F.lit(1).alias("m"), (F.col("o_totalprice") / 1000 - 100).alias("e"))
    return a.unionByName(o.select(*base, F.lit(2).alias("m"), (F.col("o_custkey") % 100 - 40.0).alias("e")))


@query("a7_error_moments", f"WITH {_ERRORS} SELECT a.target, a.m AS i, b.m AS j, round(avg(a.e * b.e), 4) AS p FROM e a JOIN e b USING (row_id, target) GROUP BY ALL")
def _(spark, d):
    return stats.error_moments(errors(spark, d), "row_id", "target", "m").withColumn("p", F.round("p", 4))


_WEIGHTS = f"WITH {_ERRORS}, q AS (SELECT target, avg(CASE WHEN a.m = 1 AND b.m = 1 THEN a.e * b.e END) AS p11, avg(CASE WHEN a.m = 1 AND b.m = 2 THEN a.e * b.e END) AS p12, avg(CASE WHEN a.m = 2 AND b.m = 2 THEN a.e * b.e END) AS p22 FROM e a JOIN e b USING (row_id, target) GROUP BY target), w AS (SELECT target, greatest(0, least(1, (p22 - p12) / (p11 + p22 - 2 * p12))) AS w FROM q)"


@query("m4_two_model_weight", f"{_WEIGHTS} SELECT target, round(w, 5) AS w FROM w")
def _(spark, d):
    p = stats.error_moments(errors(spark, d), "row_id", "target", "m")
    at = lambda i, j: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("p")))
    q = p.groupBy("target").agg(at(1, 1).alias("a"), at(1, 2).alias("b"), at(2, 2).alias("c"))
    return q.select("target", F.round(stacking.two_model_weight(F.col("a"), F.col("b"), F.col("c")), 5).alias("w"))


@query("m5_stacking", f"{_WEIGHTS} SELECT target, 1 AS m, round(w, 5) AS weight FROM w UNION ALL SELECT target, 2, round(1 - w, 5) FROM w")
def _(spark, d):
    return stacking.stacking_weights(errors(spark, d), "row_id", "target", "m").withColumn("weight", F.round("weight", 5))


@query("a8_label_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return stats.label_counts(read(spark, d, "events"), "event_type")


@query("a11_global_range", "SELECT min(list_min(embedding)) AS low, max(list_max(embedding)) AS high FROM embeddings")
def _(spark, d):
    return stats.global_range(read(spark, d, "embeddings"), "embedding")


@query("a12_mean_lines", "SELECT l_shipmode.f AS l_returnflag, l_linenumber, h AS l_linestatus, round(avg(l_quantity), 6) AS l_quantity, 0 AS is_average FROM (SELECT l_returnflag AS f, l_linestatus AS h, l_linenumber, l_quantity FROM lineitem) l_shipmode GROUP BY ALL UNION ALL SELECT l_returnflag, l_linenumber, NULL, round(avg(l_quantity), 6), 1 FROM lineitem GROUP BY ALL")
def _(spark, d):
    return tables.mean_lines(read(spark, d, "lineitem"), "l_linenumber", "l_quantity", ["l_returnflag"], ["l_linestatus"]).withColumn("l_quantity", F.round("l_quantity", 6))


@query("a14_char_errors", "SELECT o_orderstatus, sum(levenshtein(o_orderpriority, '3-MEDIUM'))::BIGINT AS edits, count(*) * 8 AS chars, round(sum(levenshtein(o_orderpriority, '3-MEDIUM')) / (count(*) * 8.0), 6) AS cer FROM orders GROUP BY 1")
def _(spark, d):
    o = read(spark, d, "orders").withColumn("truth", F.lit("3-MEDIUM"))
    return stats.char_error_rate(o, "truth", "o_orderpriority", ["o_orderstatus"]).withColumn("cer", F.round("cer", 6))


_A14 = "t AS (SELECT comment_id, list_filter(string_split(truth, ' '), lambda w: w <> '') AS a, list_filter(string_split(heard, ' '), lambda w: w <> '') AS b FROM (SELECT p_partkey AS comment_id, p_name || ' ' || p_type AS truth, replace(p_name, 'e', 'a') || ' and ' || p_type AS heard FROM part))"


@query("a14_word_errors", f"""WITH RECURSIVE {_A14},
g AS (SELECT comment_id, a, b, 0 AS i, range(0, len(b) + 1) AS r FROM t
  UNION ALL SELECT comment_id, a, b, i + 1, list_reduce(list_prepend([(i + 1)::BIGINT], list_transform(range(1, len(b) + 1), lambda j: [least(r[j + 1] + 1, r[j] + (a[i + 1] <> b[j])::BIGINT)])), lambda x, y: list_append(x, least(y[1], x[-1] + 1))) FROM g WHERE i < len(a))
SELECT comment_id, sum(r[-1])::BIGINT AS edits, sum(len(a))::BIGINT AS words, round(sum(r[-1]) / sum(len(a)), 6)::DOUBLE AS wer FROM g WHERE i = len(a) GROUP BY 1""")
def _(spark, d):
    t = read(spark, d, "part").select(F.col("p_partkey").alias("comment_id"), F.concat_ws(" ", "p_name", "p_type").alias("truth"), F.concat(F.replace("p_name", F.lit("e"), F.lit("a")), F.lit(" and "), F.col("p_type")).alias("heard"))
    return stats.word_error_rate(t, "truth", "heard", ["comment_id"]).select("comment_id", F.col("edits").cast("long").alias("edits"), F.col("words").cast("long").alias("words"), F.round("wer", 6).alias("wer"))


@query("a15_normalise", "SELECT vec_id, p::INT AS p, round(x / m, 5) AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding)::DOUBLE AS x, list_max(embedding)::DOUBLE AS m FROM embeddings)")
def _(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", F.posexplode(tables.normalise_by_max(F.col("e"))).alias("p", "x")).withColumn("x", F.round("x", 5))


@query("a16_rms", "SELECT vec_id, round(0.01 * list_sum(list_transform(embedding, lambda v: v::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) / len(embedding)), 6) AS total FROM embeddings")
def _(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", scalar.root_mean_square(0.01, F.col("embedding").cast("array<double>")).alias("e"))
    return e.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("a17_balance_groups", "WITH n AS (SELECT sqrt(sum(l_quantity * l_quantity + l_tax * l_tax)) AS a, sqrt(sum(l_discount * l_discount)) AS b FROM lineitem), s AS (SELECT a / sqrt((a * a + b * b) / 2) AS a, b / sqrt((a * a + b * b) / 2) AS b FROM n) SELECT l_orderkey, l_linenumber, round(l_quantity / a, 6) AS l_quantity, round(l_tax / a, 6) AS l_tax, round(l_discount / b, 6) AS l_discount FROM lineitem, s")
def _(spark, d):
    """Two groups of features, whose norms come to be equal while that of all stays."""
    x = stats.balance_groups(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount"), {"a": ["l_quantity", "l_tax"], "b": ["l_discount"]})
    return x.select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in ("l_quantity", "l_tax", "l_discount")))


@query("g1_subdivide", "SELECT *, ntile(7) OVER (ORDER BY event_id)::INT AS fold FROM events")
def _(spark, d):
    return folds.subdivide(read(spark, d, "events"), 7, ["event_id"])


@query("g1_subdivide_series", "SELECT *, ntile(3) OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS part FROM events")
def _(spark, d):
    return folds.subdivide(read(spark, d, "events"), 3, ORDER, KEYS, "part")


@query("g2_partition", "SELECT *, ntile(4) OVER (PARTITION BY event_type ORDER BY event_id)::INT AS fold FROM events")
def _(spark, d):
    return folds.partition_within_labels(read(spark, d, "events"), "event_type", "event_id", 4)


@query("g2_partition_fractions", "WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), f AS (SELECT *, floor(n * 0.6::DOUBLE)::BIGINT AS a, floor(n * 0.2::DOUBLE)::BIGINT AS b FROM r), x AS (SELECT *, n - a - b - b AS q FROM f) SELECT event_id, CASE WHEN i < a + q // 3 + (q % 3 > 0)::INT THEN 1 WHEN i < a + b + 2 * (q // 3) + (q % 3 > 0)::INT + (q % 3 > 1)::INT THEN 2 ELSE 3 END AS fold FROM x")
def _(spark, d):
    return folds.partition_within_labels(read(spark, d, "events"), "event_type", "event_id", [0.6, 0.2, 0.2]).select("event_id", "fold")


@query("g2_partition_shuffled", "SELECT event_type, f::INT AS fold, (n // 5 + (n % 5 >= f)::INT)::BIGINT AS count FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1), range(1, 6) r(f)")
def _(spark, d):
    return folds.partition_within_labels(read(spark, d, "events"), "event_type", "event_id", 5, seed=3, shuffle=True).groupBy("event_type", "fold").count()


@query("g4_index_lists", "SELECT event_id, k::INT AS fold, event_id % 3 = k AND event_id % 7 <> 0 AS is_test FROM events, range(3) r(k)")
def _(spark, d):
    e = read(spark, d, "events").select("event_id")
    tests = e.where("event_id % 7 <> 0").select("event_id", (F.col("event_id") % 3).cast("int").alias("fold"))
    return folds.folds_from_lists(e, tests, "event_id", 3)


@query("g3_leave_one_out", "SELECT n_nationkey, f.n_regionkey AS fold, n.n_regionkey = f.n_regionkey AS is_test FROM nation n, (SELECT DISTINCT n_regionkey FROM nation) f")
def _(spark, d):
    return folds.leave_one_out(read(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey").select("n_nationkey", "fold", "is_test")


@query("r1_expand_nested", "SELECT vec_id, embedding[i * 8 + j + 1] AS cell, i::INT AS d1_index, j::INT AS d2_index FROM embeddings, range(8) a(i), range(8) b(j)")
def _(spark, d):
    two = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    return tables.expand_nested(read(spark, d, "embeddings").select("vec_id", two.alias("cell")), "cell")


@query("r2_to_strf", "SELECT vec_id, f::INT AS f, l::INT AS l, embedding[l * 9 + f + 2] AS x FROM embeddings, range(9) a(f), range(7) b(l)")
def _(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode(tables.to_strf(F.col("embedding"), 7)).alias("f", "row"))
    return e.select("vec_id", "f", F.posexplode("row").alias("l", "x"))


@query("r3_split_strf", "SELECT vec_id, CASE WHEN f < 3 THEN 'low' ELSE 'high' END AS feature_name, CASE WHEN f < 3 THEN f ELSE f - 3 END::INT AS f, l::INT AS l, embedding[f * 8 + l + 1] AS x FROM embeddings, range(8) a(f), range(8) b(l)")
def _(spark, d):
    two = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    s = tables.split_strf(read(spark, d, "embeddings").select("vec_id", two.alias("STRF")), "STRF", [3, 5], ["low", "high"], ["vec_id"])
    return s.select("vec_id", "feature_name", F.posexplode("STRF").alias("f", "row")).select("vec_id", "feature_name", "f", F.posexplode("row").alias("l", "x"))


@query("r4_pivot_cell", "SELECT vec_id, i / 100.0::DOUBLE AS time_stamp, embedding[i + 1] AS \"diff\" FROM embeddings, range(64) r(i)")
def _(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "embedding", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i / 100.0).alias("t"))
    return tables.pivot_cell(e, "embedding", "t")


@query("r5_lag_rows", "SELECT vec_id, i::INT AS lag, embedding[i + 1] AS \"TRF\", (list_position(embedding, list_max(embedding)) - 1)::INT AS max_lag FROM embeddings, range(64) r(i)")
def _(spark, d):
    return tables.lag_rows(read(spark, d, "embeddings"), ["vec_id"], "embedding")


@query("u1_stack_rows", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def _(spark, d):
    n, r = read(spark, d, "nation").select(F.col("n_name").alias("name")), read(spark, d, "region").select(F.col("r_name").alias("name"))
    return tables.stack_rows(n, r, n)


@query("f_scalars", "SELECT s_suppkey, regexp_replace(s_name, '[0-9]$', '') AS stripped, round(9.265 * ln(1 + s_suppkey / (24.7 * 9.265)), 6) AS erb, round(24.7 * 9.265 * (exp(s_suppkey / 100.0 / 9.265) - 1), 6) AS hz, round((1 / 0.31) * (1 / (1 - 0.533)) * pow(s_suppkey / 1000.0, 1 - 0.533), 6) AS erb_ferret, round(1000 * pow(s_suppkey * 0.31 * (1 - 0.533), 1 / (1 - 0.533)), 3) AS hz_ferret, md5(s_suppkey::VARCHAR) AS h, greatest(-1.0, least(1.0, s_acctbal / 5000)) AS clipped, round(ln(1 + s_suppkey), 6) AS lp FROM supplier")
def _(spark, d):
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select("s_suppkey", scalar.strip_stress(F.col("s_name")).alias("stripped"), F.round(scalar.hz_to_erb(k), 6).alias("erb"), F.round(scalar.erb_to_hz(k / 100.0), 6).alias("hz"), F.round(scalar.hz_to_erb_ferret(k), 6).alias("erb_ferret"), F.round(scalar.erb_to_hz_ferret(k), 3).alias("hz_ferret"), scalar.data_hash(k).alias("h"), scalar.clip(F.col("s_acctbal") / 5000, -1.0, 1.0).alias("clipped"), F.round(F.log1p(k), 6).alias("lp"))


@query("f6_to_text", "SELECT c_custkey, CASE WHEN length(c_name) > 10 THEN substr(md5(c_name), 1, 10) ELSE c_name END AS t FROM customer")
def _(spark, d):
    return read(spark, d, "customer").select("c_custkey", scalar.to_text(F.col("c_name"), 10).alias("t"))


@query("s11_frame_times", "SELECT n_nationkey, i::INT AS i, i * 320.0::DOUBLE - 0.5 AS t FROM nation, LATERAL (SELECT unnest(range(n_nationkey)) AS i)")
def _(spark, d):
    return read(spark, d, "nation").select("n_nationkey", F.posexplode(scalar.frame_times(F.col("n_nationkey"))).alias("i", "t"))


@query("s12_constructed", "SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * i)), 4) AS y FROM embeddings a")
def _(spark, d):
    w = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("double"))
    return read(spark, d, "embeddings").select("vec_id", F.round(scalar.dot(F.col("embedding").cast("array<double>"), w), 4).alias("y"))


@query("io1_parse_intervals", f"WITH {S} SELECT user_id::VARCHAR AS file, t_idx::INT AS idx, value AS onset, lead(value) OVER v AS \"offset\", CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS label FROM s WINDOW v AS (PARTITION BY user_id ORDER BY t_idx) QUALIFY \"offset\" IS NOT NULL")
def _(spark, d):
    line = F.concat_ws(",", F.when(F.col("event_type") == "view", ">").otherwise(F.col("event_type")), F.col("value").cast("string"))
    texts = series(spark, d).groupBy(F.col("user_id").cast("string").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_idx", line.alias("l")))), lambda x: x["l"]), "\n").alias("value"))
    return files.parse_intervals(texts.withColumn("value", F.concat(F.lit("label,onset\n"), "value")))


@query("io5_textgrid", f"WITH {S} SELECT user_id::VARCHAR AS file, event_type AS tier, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY t_idx) - 1)::INT AS idx, value AS xmin, value + 0.5 AS xmax, 'say \"' || event_type || '\"' AS text FROM s")
def _(spark, d):
    label = F.concat(F.lit('say "'), F.col("event_type"), F.lit('"'))
    rows = series(spark, d).select(F.col("user_id").cast("string").alias("file"), F.col("event_type").alias("tier"), F.col("t_idx").alias("idx"), F.col("value").alias("onset"), (F.col("value") + 0.5).alias("offset"), label.alias("label"))
    from pyspark.sql import Window

    rows = rows.withColumn("tier_no", F.dense_rank().over(Window.partitionBy("file").orderBy("tier")) - 1)
    return files.parse_textgrids(files.textgrid_texts(rows))


_TG = "g AS (SELECT user_id::VARCHAR AS file, (row_number() OVER (PARTITION BY user_id ORDER BY t_idx) - 1)::INT AS idx, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type || event_id % 3 END AS text, value AS onset, value + 0.5 AS \"offset\" FROM s)"


def _textgrids(spark: SparkSession, d: str) -> DataFrame:
    """Two tiers of the same intervals, some without a label, written as texts and parsed."""
    label = F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.col("event_type"), (F.col("event_id") % 3).cast("string")))
    rows = series(spark, d).select(F.col("user_id").cast("string").alias("file"), F.col("t_idx").alias("idx"), F.col("value").alias("onset"), (F.col("value") + 0.5).alias("offset"), label.alias("label"))
    tiers = rows.withColumn("t", F.explode(F.array(F.struct(F.lit(0).alias("tier_no"), F.lit("phones").alias("tier")), F.struct(F.lit(1).alias("tier_no"), F.lit("words").alias("tier"))))).select("*", "t.*").drop("t")
    return files.parse_textgrids(files.textgrid_texts(tiers))


@query("io2_phones", f"WITH {S}, {_TG} SELECT file, idx, regexp_replace(text, '[0-9]$', '') AS text, onset, \"offset\" FROM g WHERE text <> ''")
def _(spark, d):
    return files.phones(_textgrids(spark, d))


@query("io3_words", f"WITH {S}, {_TG} SELECT file, idx, text, onset, \"offset\" FROM g WHERE text <> ''")
def _(spark, d):
    return files.words(_textgrids(spark, d))


@query("io7_tier_per_label", f"WITH {S}, {_TG} SELECT file, text AS tier, (dense_rank() OVER (PARTITION BY file ORDER BY text) - 1)::INT AS tier_no, idx FROM g")
def _(spark, d):
    label = F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.col("event_type"), (F.col("event_id") % 3).cast("string")))
    rows = series(spark, d).select(F.col("user_id").cast("string").alias("file"), F.col("t_idx").cast("int").alias("idx"), label.alias("label"))
    return files.tier_per_label(rows).select("file", "tier", F.col("tier_no").cast("int").alias("tier_no"), "idx")


@query("io6_csv_to_textgrid", "SELECT t.tier, idx::INT AS idx, xmin, xmax, text FROM (SELECT n_name AS text, n_nationkey * 0.5::DOUBLE AS xmin, lead(n_nationkey * 0.5::DOUBLE) OVER (ORDER BY n_nationkey) AS xmax, row_number() OVER (ORDER BY n_nationkey) - 1 AS idx FROM nation), (SELECT unnest(['phones', 'words']) AS tier) t WHERE xmax IS NOT NULL")
def _(spark, d):
    """Two interval CSVs of the nations, written, made into a TextGrid and read back."""
    home = scratch(spark, "io6")
    rows = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat_ws(",", "n_name", (F.col("n_nationkey") * 0.5).cast("string")).alias("line"))
    head = spark.createDataFrame([(-1, "label,onset")], "k int, line string")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("k").select("line").write.text(f"{home}/in")  # 26 lines
    files.csv_to_textgrid(spark, [f"{home}/in"] * 2, f"{home}/out", ["phones", "words"])
    return files.read_textgrids(spark, f"{home}/out").select("tier", "idx", "xmin", "xmax", "text")


@query("io8_vectors", "SELECT 'w' || vec_id AS word, generate_subscripts(embedding, 1)::INT - 1 AS p, unnest(embedding)::FLOAT::VARCHAR::DOUBLE AS x FROM embeddings")
def _(spark, d):
    """Word vectors written as lines of text, scanned, kept as a table and read again."""
    home = scratch(spark, "io8")
    numbers = F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")
    read(spark, d, "embeddings").select(F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id").cast("string")), numbers)).write.text(f"{home}/vectors.txt")
    files.keep_vectors(files.read_vectors(spark, f"{home}/vectors.txt"), f"{home}/vectors.parquet")
    return files.read_vectors(spark, f"{home}/vectors.parquet").select("word", F.posexplode("vec").alias("p", "x"))


@query("io5_textgrid_format", f"WITH {S} SELECT 'set/' || user_id AS file, event_type AS tier, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY t_idx) - 1)::INT AS idx, value AS xmin, value + 0.5 AS xmax, 'say \"' || event_type || '\"' AS text FROM s")
def _(spark, d):
    """A TextGrid file for each user, a tier for each kind of event, written and read by format name."""
    from pyspark.sql import Window

    home = scratch(spark, "io5")
    label = F.concat(F.lit('say "'), F.col("event_type"), F.lit('"'))
    rows = series(spark, d).select(F.concat(F.lit("set/"), F.col("user_id").cast("string")).alias("file"), F.col("event_type").alias("tier"), F.col("t_idx").alias("idx"), F.col("value").alias("onset"), (F.col("value") + 0.5).alias("offset"), label.alias("label"))
    formats.save_textgrids(rows.withColumn("tier_no", F.dense_rank().over(Window.partitionBy("file").orderBy("tier")) - 1), home)
    return spark.read.format("textgrid").load(home)


@query("io9_wav_format", "SELECT 'v' || vec_id AS file, 8000 + vec_id::INT % 3 AS sr, 1 AS channels, generate_subscripts(embedding, 1) - 1 AS i, greatest(-32768, least(32767, round(unnest(embedding)::DOUBLE * 32768))) / 32768 AS x FROM embeddings")
def _(spark, d):
    """Embeddings as WAV files of their own rates, written and read by format name in blocks of ten frames."""
    home = scratch(spark, "io9")
    e = read(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("file"), F.col("embedding").cast("array<double>").alias("samples"), (F.col("vec_id") % 3 + 8000).cast("int").alias("sr"))
    formats.save_wavs(e, home)
    blocks = spark.read.format("wav").option("blockFrames", 10).load(home)
    rows = blocks.select("file", "sr", "channels", "start", F.posexplode("samples").alias("k", "x"))
    return rows.select("file", "sr", "channels", (F.col("start") + F.col("k")).alias("i"), F.get("x", F.lit(0)).alias("x"))


_ERB = "9.265 * ln(1 + ({}) / (24.7 * 9.265))"


_DFT = "w AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings)"


_BANK = f"f AS (SELECT i, i * 8000.0::DOUBLE / 32 AS f FROM range(33) r(i)), c AS (SELECT k, 24.7 * 9.265 * (exp(({_ERB.format(80)} + k * ({_ERB.format(6990)} - {_ERB.format(80)}) / 7) / 9.265) - 1) AS cut FROM range(8) r(k)), b AS (SELECT k, cut AS low, lead(cut, 2) OVER (ORDER BY k) AS high, lead(k, 2) OVER (ORDER BY k) AS there FROM c), e AS (SELECT k, low, high, {_ERB.format('low')} AS el, {_ERB.format('high')} AS eh, (SELECT count(*) FROM f WHERE f.f < high) AS stop FROM b WHERE there IS NOT NULL), bank AS (SELECT k + 1 AS filter, i, cos(({_ERB.format('f')} - (el + eh) / 2) / (eh - el) * pi()) AS gain FROM f, e WHERE f > low AND i < stop - 1)"


@query("s3_erb_filters", f"WITH {_BANK}, {_DFT}, s AS (SELECT vec_id, i, sum(x * cos(2 * pi() * i * t / 64)) AS re, sum(x * sin(2 * pi() * i * t / 64)) AS im FROM w, range(33) r(i) GROUP BY ALL) SELECT vec_id, filter::INT AS filter, round(sum(gain * gain * (re * re + im * im) * CASE WHEN i IN (0, 32) THEN 1 ELSE 2 END) / 64, 4) AS energy FROM bank JOIN s USING (i) GROUP BY ALL")
def _(spark, d):
    """The energy of each embedding, taken for a waveform, in six ERB-spaced half-cosine bands."""
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"), F.lit(16000).alias("sr"))

    def energies(x, sr):
        bank, _, _ = signal.erb_filters(len(x), sr, 6, 80, 6990)
        return (signal.subbands(x, bank[:, 1:-1]) ** 2).sum(0)

    rows = signal.map_waveforms(e, energies, "e", "array<double>").select("vec_id", F.posexplode("e").alias("k", "energy"))
    return rows.where(F.col("energy") > 0).select("vec_id", (F.col("k") + 1).alias("filter"), F.round("energy", 4).alias("energy"))


_FRAMES = "SELECT vec_id, frame, i, 0.54 - 0.46 * cos(2 * pi() * t / 32) AS h, t, CASE WHEN p < 0 THEN -p WHEN p > 62 THEN 124 - p ELSE p END AS p FROM (SELECT vec_id, frame, i, t, frame * 16 + t - 16 AS p FROM (SELECT vec_id FROM embeddings), range(4) a(frame), range(17) b(i), range(32) c(t))"


@query("s1_spectrogram_rows", f"WITH {_DFT}, f AS ({_FRAMES}), s AS (SELECT f.vec_id, frame, i, sum(h * x * cos(2 * pi() * i * f.t / 32)) AS re, sum(h * x * sin(2 * pi() * i * f.t / 32)) AS im FROM f JOIN w ON w.vec_id = f.vec_id AND w.t = f.p GROUP BY ALL) SELECT vec_id, frame, i::INT AS i, round(ln(1 + sqrt(re * re + im * im)), 5) AS x FROM s")
def _(spark, d):
    """Embeddings as waveforms of 1600 Hz in rows of samples: frames of 32 samples."""
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("t", "x"))
    return signal.spectrogram_rows(e, ["vec_id"], ["t"], "x", 1600).select("vec_id", "frame", F.posexplode("spectrum").alias("i", "x")).withColumn("x", F.round("x", 5))


@query("s2_cochleagram_frames", f"WITH {_BANK}, {_DFT}, s AS (SELECT vec_id, i, sum(x * cos(2 * pi() * i * t / 64)) AS re, -sum(x * sin(2 * pi() * i * t / 64)) AS im FROM w, range(33) r(i) GROUP BY ALL), g AS (SELECT vec_id, filter, i, re, im, gain * CASE WHEN i IN (0, 32) THEN 1 ELSE 2 END / 64 AS g FROM bank JOIN s USING (i)), a AS (SELECT vec_id, filter, t, sum(g * (re * cos(2 * pi() * i * t / 64) - im * sin(2 * pi() * i * t / 64))) AS p, sum(g * (re * sin(2 * pi() * i * t / 64) + im * cos(2 * pi() * i * t / 64))) AS q FROM g, range(64) r(t) GROUP BY ALL), y AS (SELECT vec_id, filter, t, pow(p * p + q * q, 0.15) AS y FROM a), d AS (SELECT vec_id, filter, k, sum(y * cos(2 * pi() * k * t / 64)) AS re, -sum(y * sin(2 * pi() * k * t / 64)) AS im FROM y, range(9) r(k) GROUP BY ALL) SELECT vec_id, filter::INT AS filter, n::INT AS frame, round(sum(CASE WHEN k = 0 THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * n / 16) - im * sin(2 * pi() * k * n / 16))) / 64, 4) AS x FROM d, range(16) r(n) GROUP BY ALL")
def _(spark, d):
    """Each embedding, taken for a waveform of 16000 Hz, as 16 frames of the compressed envelopes of six bands; bands without a frequency of its spectrum are left out."""
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"), F.lit(16000).alias("sr"))
    frames = signal.map_waveforms(e, lambda x, r: signal.cochleagram(x, r, output_sr=4000, n=6, low=80, high=6990), "c").select("vec_id", F.posexplode("c").alias("frame", "bands"))
    rows = frames.select("vec_id", "frame", F.posexplode("bands").alias("k", "x")).where(F.col("x") != 0)
    return rows.select("vec_id", (F.col("k") + 1).alias("filter"), "frame", F.round("x", 4).alias("x"))


@query("s6_time_and_frequency", "WITH w AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings), d AS (SELECT vec_id, j % 4 AS f, k, sum(x * cos(2 * pi() * k * (j // 4) / 16)) AS re, -sum(x * sin(2 * pi() * k * (j // 4) / 16)) AS im FROM w, range(9) r(k) GROUP BY ALL), y AS (SELECT vec_id, n, f, sum(CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * n / 24) - im * sin(2 * pi() * k * n / 24))) / 16 AS y FROM d, range(24) r(n) GROUP BY ALL), p AS (SELECT vec_id, n, max(y) FILTER (f = 0) AS a, max(y) FILTER (f = 1) AS b, max(y) FILTER (f = 2) AS c, max(y) FILTER (f = 3) AS e FROM y GROUP BY ALL), m AS (SELECT *, CASE WHEN (b - a) * (c - b) <= 0 THEN 0 ELSE 2 * (b - a) * (c - b) / (c - a) END AS mb, CASE WHEN (c - b) * (e - c) <= 0 THEN 0 ELSE 2 * (c - b) * (e - c) / (e - b) END AS mc FROM p), u AS (SELECT k, log2((250 + 50 * k) / 200.0::DOUBLE) AS t FROM range(3) r(k)) SELECT vec_id, n::INT AS frame, (250 + 50 * k)::INT AS hz, round(b * (1 + 2 * t) * pow(1 - t, 2) + mb * t * pow(1 - t, 2) + c * t * t * (3 - 2 * t) + mc * t * t * (t - 1), 5) + 0.0 AS x FROM m, u")
def _(spark, d):
    """Embeddings as 16 frames of 100, 200, 400 and 800 Hz: 24 frames in the same time, at three frequencies between."""
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"), F.lit(8).alias("sr"))
    old, new = np.array([100.0, 200.0, 400.0, 800.0]), np.array([250.0, 300.0, 350.0])
    frames = signal.map_waveforms(e, lambda x, r: signal.resample_time_and_freq(x.reshape(16, 4), r, 12, old, new), "c").select("vec_id", F.posexplode("c").alias("frame", "x"))
    return frames.select("vec_id", "frame", F.posexplode("x").alias("k", "x")).select("vec_id", "frame", (F.col("k") * 50 + 250).alias("hz"), F.round("x", 5).alias("x"))


@query("m14_two_features", "WITH m AS (SELECT vec_id, l, embedding[l + 1]::DOUBLE AS a, embedding[l + 33]::DOUBLE AS b FROM embeddings, range(32) r(l)), g AS (SELECT vec_id, 0.5 * atan2(2 * sum(a * b), sum(a * a) - sum(b * b)) AS h FROM m GROUP BY 1), v AS (SELECT vec_id, l, a * cos(h) + b * sin(h) AS v FROM m JOIN g USING (vec_id)) SELECT vec_id, l::INT AS l, round(v * CASE WHEN sum(v) OVER w < 0 THEN -1 ELSE 1 END / sqrt(sum(v * v) OVER w), 6) + 0.0 AS x FROM v WINDOW w AS (PARTITION BY vec_id)")
def _(spark, d):
    """Two features by 32 lags: the lags of the nearest matrix of rank one, whose angle between the features is known in closed form."""
    two = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 32 + 1, 32))
    rows = strf.trf(read(spark, d, "embeddings").select("vec_id", two.alias("STRF"))).select("vec_id", F.posexplode("TRF").alias("l", "x"))
    return rows.withColumn("x", F.round("x", 6))


@query("s13_usable_rows", "SELECT s_suppkey, s_nationkey, x FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN 'nan'::DOUBLE ELSE s_acctbal::DOUBLE END AS x FROM supplier) WHERE s_nationkey = 7 AND x IS NOT NULL AND NOT isnan(x)")
def _(spark, d):
    k = F.col("s_suppkey")
    x = F.when(k % 4 == 1, F.lit(float("nan"))).when(k % 4 != 0, F.col("s_acctbal").cast("double"))
    return tables.usable_rows(read(spark, d, "supplier").select("s_suppkey", "s_nationkey", x.alias("x")), {"s_nationkey": 7}, ["x"])


@query("io13_export", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    """A table written as CSV with its columns' names, and read again."""
    home = scratch(spark, "io13")
    files.write_rows(read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), f"{home}/nation")
    kinds = {f.name: f.dataType.simpleString() for f in read(spark, d, "nation").schema.fields}
    return spark.read.option("header", True).csv(f"{home}/nation").select(*(F.col(c).cast(kinds[c]).alias(c) for c in ("n_nationkey", "n_name", "n_regionkey")))


@query("io13_phones", _J1_SQL)
def _(spark, d):
    """Phones with their words, nine columns beside the key, written as CSV with its columns' names, and read again."""
    home = scratch(spark, "io13")
    rows = _phones_in_words(spark, d)
    files.write_rows(rows, f"{home}/phones")
    return spark.read.option("header", True).schema(rows.schema).csv(f"{home}/phones")


_SUMS = "s AS (SELECT l_linenumber AS g, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM (SELECT l_linenumber, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem) GROUP BY 1), t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy FROM s)"


@query("io9_wav", "SELECT 'v' || vec_id AS path, 8000 + vec_id::INT % 3 AS sr, 1 AS channels, generate_subscripts(embedding, 1)::INT - 1 AS i, greatest(-32768, least(32767, round(unnest(embedding)::DOUBLE * 32768))) / 32768 AS x FROM embeddings")
def _(spark, d):
    """Embeddings as WAV files of their own rates, read back."""
    e = read(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("path"), F.col("embedding").cast("array<double>").alias("samples"), (F.col("vec_id") % 3 + 8000).cast("int").alias("sr"))
    wavs = files.parse_wavs(files.wav_contents(e))
    return wavs.select("path", "sr", "channels", F.posexplode("samples").alias("i", "x")).withColumn("x", F.get("x", F.lit(0)))


@query("s4_format_wav", "WITH x AS (SELECT vec_id, list_transform(embedding[1:48], lambda v: v::DOUBLE) AS x FROM embeddings), p AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS p FROM x) SELECT vec_id, generate_subscripts(x, 1)::INT - 1 AS i, round(unnest(x) * 0.01 / p, 8) AS x FROM p")
def _(spark, d):
    """Waveforms of 16000 Hz cut to 3 ms, at a root mean square of 0.01."""
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"), F.lit(16000).alias("sr"))
    out = signal.map_waveforms(e, lambda x, r: signal.format_wav(x, r, 0.003, 16000), "out", "array<double>")
    return out.select("vec_id", F.posexplode("out").alias("i", "x")).withColumn("x", F.round("x", 8))


@query("s7_layer_means", "WITH u AS (SELECT vec_id, unnest([0, 1]) AS layer, unnest([8, 16]) AS n, embedding FROM embeddings), f AS (SELECT vec_id, layer, n, unnest(range(n)) AS frame, embedding FROM u), m AS (SELECT vec_id, layer, frame, list_avg(list_transform(range(64 // n), lambda j: embedding[frame * (64 // n) + j + 1]::FLOAT)) AS mean FROM f) SELECT vec_id, layer::INT AS layer, frame::INT AS frame, frame * 320.0::DOUBLE - 0.5 AS t, round(CASE WHEN max(mean) OVER w > 0 THEN mean / max(mean) OVER w ELSE mean END, 4) AS mean FROM m WINDOW w AS (PARTITION BY vec_id, layer)")
def _(spark, d):
    """Two layers of a network that only folds its waveform: eight frames of eight units, and sixteen of four."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.col("embedding").cast("array<double>").alias("samples"), F.lit(16000).alias("sr"))
    layers = signal.layer_means(signal.layer_activations(e, lambda: lambda x, sr: [x.reshape(8, 8), x.reshape(16, 4)]))
    return layers.select(F.col("path").cast("long").alias("vec_id"), "layer", F.posexplode(F.arrays_zip("time_stamp", "mean")).alias("frame", "z")).select("vec_id", "layer", "frame", F.col("z.time_stamp").alias("t"), F.round("z.mean", 4).alias("mean"))


@query("w10_align_linear", "WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), g AS (SELECT round(k / 75.0::DOUBLE, 8) AS t, floor(k * 50 / 75)::BIGINT AS i FROM range(94) r(k)) SELECT a.vec_id, t, round(a.x + (t - g.i / 50.0::DOUBLE) / ((g.i + 1) / 50.0::DOUBLE - g.i / 50.0::DOUBLE) * (b.x - a.x), 6) AS x FROM g JOIN x a USING (i) JOIN x b ON b.vec_id = a.vec_id AND b.i = g.i + 1")
def _(spark, d):
    """Series of 50 Hz at the times of 75 Hz, interpolated between their own samples, in blocks of 32."""
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    e = e.select("vec_id", (F.col("i") / 50.0).alias("t"), F.array("v").alias("features"))
    out = timeseries.align_time(e, ["vec_id"], timeseries.regular_times(75, 0, 1.24), resample_first=False, block=32)
    return out.select("vec_id", "t", F.round(F.get("features", F.lit(0)), 6).alias("x"))


@query("m11_one_feature", f"WITH {_SUMS}, r AS (SELECT g, t.n - s.n AS n, t.sx - s.sx AS sx, t.sy - s.sy AS sy, t.sxx - s.sxx AS sxx, t.sxy - s.sxy AS sxy FROM s, t), w AS (SELECT g, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS w, sx / n AS mx, sy / n AS my FROM r) SELECT l_orderkey, l_partkey, l_linenumber, round(my + w * (l_quantity - mx), 3) AS y_hat FROM lineitem JOIN w ON g = l_linenumber")
def _(spark, d):
    """Predictions of each group by the least squares of the others."""
    x = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.array(F.col("l_quantity").cast("double")).alias("x"), F.array(F.col("l_extendedprice").cast("double")).alias("y"))
    out = linear.fold_predictions(x, linear.group_factors(x, "l_linenumber"), "l_linenumber", "least-squares")
    return out.select("l_orderkey", "l_partkey", "l_linenumber", F.round(F.get("y_hat", F.lit(0)), 3).alias("y_hat"))


@query("m7_balanced_blocks", "WITH x AS (SELECT l_linenumber AS g, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_extendedprice::DOUBLE AS y FROM lineitem), s AS (SELECT g, count(*)::DOUBLE AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS by_ FROM x GROUP BY 1), o AS (SELECT s.g, sum(o.n) AS n, sum(o.a) AS a, sum(o.b) AS b, sum(o.y) AS y, sum(o.aa) AS aa, sum(o.bb) AS bb, sum(o.ab) AS ab, sum(o.ay) AS ay, sum(o.by_) AS by_ FROM s JOIN s o ON o.g <> s.g GROUP BY 1), c AS (SELECT g, a / n AS ma, b / n AS mb, y / n AS my, aa - a * a / n AS aa, bb - b * b / n AS bb, ab - a * b / n AS ab, ay - a * y / n AS ay, by_ - b * y / n AS by_ FROM o), f AS (SELECT *, (aa + bb) / 2 + 1000000 AS h, sqrt(2 * aa / (aa + bb)) AS fa, sqrt(2 * bb / (aa + bb)) AS fb FROM c), w AS (SELECT g, ma, mb, my, (h * ay / fa - ab / (fa * fb) * by_ / fb) / (h * h - pow(ab / (fa * fb), 2)) / fa AS wa, (h * by_ / fb - ab / (fa * fb) * ay / fa) / (h * h - pow(ab / (fa * fb), 2)) / fb AS wb FROM f) SELECT l_orderkey, l_partkey, l_linenumber, round(my + wa * (l_quantity - ma) + wb * (l_discount - mb), 2) AS y_hat FROM lineitem JOIN w ON g = l_linenumber")
def _(spark, d):
    """Predictions of each group by ridge weights of the others, on two blocks of features that are balanced first: discounts weigh as much as quantities."""
    x = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.array(*(F.col(c).cast("double") for c in ("l_quantity", "l_discount"))).alias("x"), F.array(F.col("l_extendedprice").cast("double")).alias("y"))
    out = linear.fold_predictions(x, linear.group_factors(x, "l_linenumber"), "l_linenumber", "ridge", 1e6, std=False, blocks=[0, 1])
    return out.select("l_orderkey", "l_partkey", "l_linenumber", F.round(F.get("y_hat", F.lit(0)), 2).alias("y_hat"))


@query("a9_sorted_labels", "SELECT row_number() OVER (ORDER BY label) - 1 AS place, label FROM (SELECT DISTINCT event_type AS label FROM events)")
def _(spark, d):
    labels = intervals.sorted_labels(read(spark, d, "events").select(F.col("event_type").alias("label")))
    return spark.createDataFrame(list(enumerate(labels)), "place long, label string")


@query("a10_repeated_keys", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return tables.repeated_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query("f12_round", "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice::DOUBLE / 7, 8) AS x FROM lineitem")
def _(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.round8(F.col("l_extendedprice").cast("double") / 7).alias("x"))


@query("m13_fold_scores", "WITH x AS (SELECT l_linenumber AS g, l_quantity::DOUBLE AS x, unnest([0, 3]) AS t, unnest([l_extendedprice::DOUBLE, (l_quantity * l_discount)::DOUBLE]) AS y FROM lineitem) SELECT g, t::INT AS target, round(corr(x, y) * (SELECT sign(covar_pop(o.x, o.y)) FROM x o WHERE o.g <> x.g AND o.t = x.t), 6) AS r FROM x GROUP BY g, t UNION ALL SELECT DISTINCT l_linenumber, unnest([1, 2])::INT, 0.0 FROM lineitem")
def _(spark, d):
    """Targets 1 (constant) and 2 (with a NaN) score 0."""
    y = F.array(F.col("l_extendedprice").cast("double"), F.lit(1.0), F.when(F.col("l_orderkey") == 1, F.lit(float("nan"))).otherwise(F.col("l_tax").cast("double")), (F.col("l_quantity") * F.col("l_discount")).cast("double"))
    x = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("g"), F.array("l_quantity").alias("x"), y.alias("y"))
    found = linear.fold_scores(x, "g", alphas=[1.0, 64.0])
    return spark.createDataFrame([(g, t, round(float(v), 6)) for g, r in found.items() for t, v in enumerate(r)], f"g {x.schema['g'].dataType.simpleString()}, target int, r double")


@query("m5_prefit_stacking", "WITH e AS (SELECT avg(e1 * e1) AS p11, avg(e1 * e2) AS p12, avg(e2 * e2) AS p22 FROM (SELECT o_totalprice - 2000 * (o_custkey % 100) AS e1, o_totalprice - 150000 AS e2 FROM orders)), w AS (SELECT greatest(0.0, least(1.0, (p22 - p12) / (p11 + p22 - 2 * p12))) AS w FROM e) SELECT 0 AS target, 1 AS model, round(w, 5) AS weight FROM w UNION ALL SELECT 0, 2, round(1 - w, 5) FROM w")
def _(spark, d):
    """Weights of two models that were fitted before."""
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("row"), F.lit(0).alias("target"), F.col("o_totalprice").alias("y"), "o_custkey")
    made = F.explode(F.array(F.struct(F.lit(1).alias("model"), (F.col("o_custkey") % 100 * 2000).cast("double").alias("p")), F.struct(F.lit(2).alias("model"), F.lit(150000.0).alias("p"))))
    return stacking.stack_predictions(rows.select("row", "target", made.alias("m")).select("row", "target", "m.*"), rows.select("row", "target", "y"), "row", "target", "model").withColumn("weight", F.round("weight", 5))


@query("f6_falsy", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'NULL' ELSE (s_suppkey % 3)::VARCHAR END AS number, CASE WHEN s_suppkey % 2 = 0 THEN 'NULL' ELSE 'true' END AS flag, CASE WHEN s_suppkey % 3 = 0 THEN '0' ELSE 'x' END AS text FROM supplier")
def _(spark, d):
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select("s_suppkey", scalar.to_text(k % 3).alias("number"), scalar.to_text(k % 2 != 0).alias("flag"), scalar.to_text(F.when(k % 3 == 0, "0").otherwise("x")).alias("text"))


@query("m2_one_feature_ridge", "SELECT round(covar_pop(l_quantity, l_extendedprice) * count(*) / (var_pop(l_quantity) * count(*) + 4096.0), 3) AS coef, round(avg(l_extendedprice) - avg(l_quantity) * covar_pop(l_quantity, l_extendedprice) * count(*) / (var_pop(l_quantity) * count(*) + 4096.0), 2) AS intercept FROM lineitem")
def _(spark, d):
    x = read(spark, d, "lineitem").select("l_linenumber", F.array("l_quantity").alias("x"), F.array("l_extendedprice").alias("y"))
    m = linear.ridge_cv(linear.group_factors(x, "l_linenumber"), alphas=[4096.0])
    return spark.createDataFrame([(round(float(m.coef[0, 0]), 3), round(float(m.intercept[0]), 2))], "coef double, intercept double")


def _one(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_linenumber", F.array("l_quantity").cast("array<double>").alias("x"), F.array("l_extendedprice").cast("array<double>").alias("y"))


_TRIED = [64.0, 1e6, 1e7, 1e9]


@query("m2_alpha_choice", f"WITH {_SUMS}, r AS (SELECT g, t.n - s.n AS n, t.sx - s.sx AS sx, t.sy - s.sy AS sy, t.sxx - s.sxx AS sxx, t.sxy - s.sxy AS sxy FROM s, t), w AS (SELECT g, a, (sxy - sx * sy / n) / (sxx - sx * sx / n + a) AS w, sx / n AS mx, sy / n AS my FROM r, (SELECT unnest({_TRIED})::DOUBLE AS a)), m AS (SELECT a, avg((syy + w * w * sxx + n * (my - w * mx) ** 2 - 2 * w * sxy - 2 * (my - w * mx) * sy + 2 * w * (my - w * mx) * sx) / n) AS mse FROM w JOIN s USING (g) GROUP BY a) SELECT a AS alpha, round(mse / 1e6, 3) AS mse, a = (SELECT min_by(a, mse) FROM m) AS best FROM m")
def _(spark, d):
    """The losses of all penalties over held-out groups, and which is chosen."""
    m = linear.ridge_cv(linear.group_factors(_one(spark, d), "l_linenumber"), alphas=_TRIED)
    return spark.createDataFrame([(a, round(float(-s / 1e6), 3), bool(a == m.best_alphas[0])) for a, s in zip(m.alphas, m.cv_scores.mean(0)[:, 0])], "alpha double, mse double, best boolean")


@query("m3_one_feature", "WITH x AS (SELECT l_linenumber AS g, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem) SELECT g::VARCHAR AS outer_fold, 0 AS target, round(corr(x, y) * (SELECT sign(covar_pop(o.x, o.y)) FROM x o WHERE o.g <> x.g), 6) AS r FROM x GROUP BY g")
def _(spark, d):
    """With one feature, r of a held-out group is that of its rows, with the sign of the slope over the others."""
    tables_ = linear.result_tables(spark, linear.nested_ridge_cv(linear.group_factors(_one(spark, d), "l_linenumber"), alphas=_TRIED))
    return tables_["r"].select("outer_fold", "target", F.round("r", 6).alias("r"))


_M3 = """WITH x AS (SELECT l_linenumber AS g, l_quantity::DOUBLE AS x, unnest([0, 1, 2]) AS t, unnest([l_extendedprice::DOUBLE, l_tax::DOUBLE, l_quantity * l_discount::DOUBLE]) AS y FROM lineitem),
s AS (SELECT t, g, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy, corr(x, y) AS r FROM x GROUP BY ALL),
o AS (SELECT t, s.g AS o, sum(z.n) AS n, sum(z.sx) AS sx, sum(z.sy) AS sy, sum(z.sxx) AS sxx, sum(z.sxy) AS sxy FROM s JOIN s z USING (t) WHERE z.g <> s.g GROUP BY ALL),
i AS (SELECT o.t, o.o, s.g AS h, o.n - s.n AS n, o.sx - s.sx AS sx, o.sy - s.sy AS sy, o.sxx - s.sxx AS sxx, o.sxy - s.sxy AS sxy FROM o JOIN s ON s.t = o.t AND s.g <> o.o),
w AS (SELECT t, o, h, a, (sxy - sx * sy / n) / (sxx - sx * sx / n + a) AS w, sx / n AS mx, sy / n AS my FROM i, (SELECT unnest(ALPHAS)::DOUBLE AS a)),
m AS (SELECT w.t, o, a, avg((syy + w * w * sxx + s.n * (my - w * mx) ** 2 - 2 * w * sxy - 2 * (my - w * mx) * sy + 2 * w * (my - w * mx) * sx) / s.n) AS mse FROM w JOIN s ON s.t = w.t AND s.g = w.h GROUP BY ALL),
b AS (SELECT t, o, min_by(a, mse) AS a FROM m GROUP BY ALL),
c AS (SELECT t, o, a, (sxy - sx * sy / n) / (sxx - sx * sx / n + a) AS w, sx / n AS mx, sy / n AS my FROM o JOIN b USING (t, o))
SELECT o AS outer_fold, c.t::INT AS target, a AS alpha, round(w, 6) AS coef, round(my - w * mx, 4) AS intercept, round(s.r * sign(w), 6) AS r FROM c JOIN s ON s.t = c.t AND s.g = c.o"""


@query("m3_target_blocks", _M3.replace("ALPHAS", str(_TRIED)))
def _(spark, d):
    """Nested ridge in blocks of two targets: the penalty chosen for each, and what it makes of the weights."""
    y = F.array(F.col("l_extendedprice").cast("double"), F.col("l_tax").cast("double"), (F.col("l_quantity") * F.col("l_discount")).cast("double"))
    x = read(spark, d, "lineitem").select("l_linenumber", F.array("l_quantity").alias("x"), y.alias("y"))
    found = linear.nested_ridge_blocks(x, "l_linenumber", alphas=_TRIED, block=2)
    return found.select("outer_fold", "target", "alpha", F.round(F.get("coef", F.lit(0)), 6).alias("coef"), F.round("intercept", 4).alias("intercept"), F.round("r", 6).alias("r"))


_M10_ALPHAS = [1.0, 1e5, 3e6, 1e8]
_M10 = """WITH r AS (SELECT o_orderkey, o_orderstatus, o_custkey % 97 AS x, o_totalprice / 1000 AS y, ntile(3) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS o FROM orders),
q AS (SELECT *, ntile(4) OVER (PARTITION BY o_orderstatus, o ORDER BY o_orderkey) AS i FROM r),
s AS (SELECT o, i, count(*)::DOUBLE AS n, sum(x)::DOUBLE AS sx, sum(y) AS sy, sum(x * x)::DOUBLE AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM q GROUP BY ALL),
t AS (SELECT k.o AS k, j.i AS j, a, sum(s.n) + a AS d, sum(sx) AS b, sum(sxx) + a AS c, sum(sxy) AS u, sum(sy) AS v FROM s, (SELECT DISTINCT o FROM s) k, (SELECT DISTINCT i FROM s UNION ALL SELECT 0) j(i), (SELECT unnest(ALPHAS)::DOUBLE AS a) WHERE s.o <> k.o AND s.i <> j.i GROUP BY k.o, j.i, a),
w AS (SELECT k, j, a, (d * u - b * v) / (c * d - b * b) AS w, (c * v - b * u) / (c * d - b * b) AS z FROM t),
l AS (SELECT w.k, w.j, a, sum(syy + w * w * sxx + z * z * s.n - 2 * w * sxy - 2 * z * sy + 2 * w * z * sx) / sum(s.n) AS loss FROM w JOIN s ON (j > 0 AND s.o <> k AND s.i = j) OR (j = 0 AND s.o = k) GROUP BY ALL),
c AS (SELECT k, min_by(a, loss) AS a FROM (SELECT k, a, avg(loss) AS loss FROM l WHERE j > 0 GROUP BY ALL) GROUP BY k)
SELECT k::INT AS fold, round(loss, 4) AS mse FROM c JOIN l USING (k, a) WHERE j = 0"""


@query("m10_stratified_cv", _M10.replace("ALPHAS", str(_M10_ALPHAS)))
def _(spark, d):
    """Three outer and four inner folds, stratified by status: the loss of each outer fold by the penalty that the inner ones choose."""
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.array((F.col("o_custkey") % 97).cast("double")).alias("x"), F.array((F.col("o_totalprice") / 1000).cast("double")).alias("y"))
    found = linear.stratified_cv(o, "o_orderstatus", "o_orderkey", linear.Ridge(_M10_ALPHAS, scoring="mse"), 3, 4)
    return spark.createDataFrame([(int(k), round(float(v[0]), 4)) for k, v in found.items()], "fold int, mse double")


_M8 = (("least-squares", 1), ("pcreg", 1), ("ridge", 1e5), ("pls", 1), ("lasso", 500.0))


@query("m8_one_feature", f"WITH {_SUMS}, c AS (SELECT n, sx / n AS mx, sy / n AS my, sqrt(sxx / n - (sx / n) ** 2) AS sd, (sxy / n - sx * sy / n / n) / sqrt(sxx / n - (sx / n) ** 2) AS b FROM t), w AS (SELECT m, mx, my, CASE m WHEN 'ridge' THEN b * n / (n + 1e5) WHEN 'lasso' THEN sign(b) * greatest(abs(b) - 500.0, 0) ELSE b END / sd AS w FROM c, (SELECT unnest({[m for m, _ in _M8]}) AS m)) SELECT m AS method, round(w, 4) AS slope, round((my - w * mx) / 100, 4) AS intercept FROM w")
def _(spark, d):
    parts = linear.decompose(linear.group_factors(_one(spark, d).withColumn("g", F.lit(0)), "g").r[0], 1)
    rows = [(m, *(float(v) for v in linear.regression_weights(parts, m, k)[:, 0])) for m, k in _M8]
    return spark.createDataFrame([(m, round(w, 4), round(b / 100, 4)) for m, b, w in rows], "method string, slope double, intercept double")


@query("m9_one_feature", f"WITH {_SUMS}, c AS (SELECT sxx + 5e4 AS a, sx AS b, n + 5e4 AS d, sxy AS u, sy AS v FROM t) SELECT round((d * u - b * v) / (a * d - b * b), 4) AS slope, round((a * v - b * u) / (a * d - b * b) / 100, 4) AS intercept FROM c")
def _(spark, d):
    """The intercept is a penalised column of ones."""
    m = linear.Ridge(5e4).fit(linear.group_factors(_one(spark, d), "l_linenumber"))
    return spark.createDataFrame([(round(float(m.coef[0, 0]), 4), round(float(m.intercept[0]) / 100, 4))], "slope double, intercept double")


_TWO_SQL = "WITH m AS (SELECT avg(l_quantity) AS mx, stddev_pop(l_quantity) AS dx, avg(l_tax) AS my, stddev_pop(l_tax) AS dy, corr(l_quantity, l_tax) AS r FROM lineitem), z AS (SELECT l_orderkey, l_partkey, l_linenumber, (l_quantity - mx) / dx AS x, (l_tax - my) / dy AS y, r FROM lineitem, m) SELECT l_orderkey, l_partkey, l_linenumber, round(CASE WHEN r > 0 THEN x + y ELSE x - y END / sqrt(2), 5) AS first, round(CASE WHEN r > 0 THEN x - y ELSE x + y END / sqrt(2), 5) AS second FROM z"


def _two_columns(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.array(F.col("l_quantity").cast("double"), F.col("l_tax").cast("double")).alias("x"))


def _two_scores(rows: DataFrame) -> DataFrame:
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", F.round(F.get("scores", F.lit(0)), 5).alias("first"), F.round(F.get("scores", F.lit(1)), 5).alias("second"))


@query("m1_two_columns", _TWO_SQL)
def _(spark, d):
    """Two standardised columns: the components are their sum and difference."""
    return _two_scores(linear.pca(_two_columns(spark, d))[0])


@query("m1_wide_pca", _TWO_SQL)
def _(spark, d):
    """The same by the range finder for many features."""
    return _two_scores(linear.wide_pca(_two_columns(spark, d), 2)[0])


@query("a13_zscore", "WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1)::INT - 1 AS p, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, p, round((x - (SELECT avg(x) FROM x)) / (SELECT stddev_samp(x) FROM x), 5) AS z FROM x")
def _(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return stats.zscore_cells(e, "x").select("vec_id", F.posexplode("x").alias("p", "z")).withColumn("z", F.round("z", 5))


def design(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_discount", "l_tax").alias("x"), F.array("l_extendedprice", (F.col("l_quantity") * F.col("l_tax")).alias("q")).alias("y"))


@query("m3_nested_ridge")
def _(spark, d):
    f = linear.group_factors(design(spark, d), "l_linenumber")
    return linear.result_tables(spark, linear.nested_ridge_cv(f))["r"]


@query("m3_predictions")
def _(spark, d):
    x = design(spark, d)
    m = linear.nested_ridge_cv(linear.group_factors(x, "l_linenumber")).models
    return linear.predict(x, m, "l_linenumber").select("l_orderkey", "l_linenumber", "y_hat")


@query("m1_pca")
def _(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return linear.pca(e, n_components=4)[0].select("vec_id", "scores")


@query("m8_weights")
def _(spark, d):
    r = linear.group_factors(design(spark, d), "l_linenumber")
    parts = linear.decompose(r.of(r.r), r.f)
    rows = [(m, i, float(v)) for m, k in (("least-squares", 1), ("pcreg", 2), ("ridge", 10.0), ("pls", 2), ("lasso", 100.0)) for i, v in enumerate(linear.regression_weights(parts, m, k)[:, 0])]
    return spark.createDataFrame(rows, "method string, i int, weight double")


@query("m9_ridge_class")
def _(spark, d):
    x = design(spark, d)
    f = linear.group_factors(x, "l_linenumber")
    return linear.Ridge([0.1, 1.0, 10.0]).inner_cv(f).transform(x).select("l_orderkey", "l_linenumber", "y_hat")


@query("m11_fold_predictions")
def _(spark, d):
    x = design(spark, d)
    return linear.fold_predictions(x, linear.group_factors(x, "l_linenumber"), "l_linenumber", "pls", 2).select("l_orderkey", "l_linenumber", "y_hat")


@query("m14_trf")
def _(spark, d):
    two = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, 8))
    return strf.trf(read(spark, d, "embeddings").select("vec_id", two.alias("STRF"))).select("vec_id", "TRF")


@query("w10_align_time")
def _(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    return timeseries.align_time(e.select("vec_id", (F.col("i") / 50.0).alias("t"), F.array("v").alias("features")), ["vec_id"], timeseries.regular_times(75, -0.1, 1.2))


@query("s1_spectrogram")
def _(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.flatten(F.array_repeat("embedding", 20)).cast("array<double>").alias("samples"), F.lit(16000).alias("sr"))
    return signal.map_waveforms(e, signal.spectrogram, "spectrogram").select("vec_id", "spectrogram")


@query("s2_cochleagram")
def _(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.flatten(F.array_repeat("embedding", 20)).cast("array<double>").alias("samples"), F.lit(16000).alias("sr"))
    return signal.map_waveforms(e, lambda x, r: signal.cochleagram(x, r, n=12), "cochleagram").select("vec_id", "cochleagram")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Lagged values and event types of each user as features of the next value; r per fold of users."""
    s = series(spark, d)
    kinds = ["click", "view", "error", "purchase", "signup"]
    x = timeseries.lag_columns(s, "value", [1, 2, -1], KEYS, ORDER)
    x = x.select((F.pmod("user_id", F.lit(5))).alias("fold"), F.array("value", "value_lag1", "value_lag2", *(F.when(F.col("event_type") == k, 1.0).otherwise(0.0) for k in kinds)).alias("x"), F.array("value_lead1").alias("y"))
    return linear.result_tables(spark, linear.nested_ridge_cv(linear.group_factors(x, "fold")))["r"]
