"""Queries of the training-data operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import bpe_round_trip
from .common import table
from .decontaminate import find_leaks
from .fingerprints import fingerprint_edits
from .jaccard_join import jaccard_components
from .licenses import ACCEPTED, ACCEPTED_NOTICES, BASE_PHRASES, FILLING, NOTICES, scan_licenses
from .packing import pack_documents
from .prefix_trie import graft, prefix_trie, turns_of
from .resampling import resample
from .suffix_dedup import dedup_substrings
from .token_files import token_files_round_trip
from .toxicity import score_texts, train_on
from .url_filter import BLOCKED_GLOBS, BLOCKED_WORDS, judge_urls
from .warc import archive, audit, build_tree


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict", "_url.pattern")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_on(docs, table(spark, sf_dir, "labels"))
    scored = score_texts(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a sound replica of the pages' archive against one in which the first byte of some bodies is wrong."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    wrong = F.when((F.col("page_id") % 97 == 13) & (F.octet_length("html") > 0), F.concat(F.lit("?"), F.substring("html", 2, 2147483647))).otherwise(F.col("html"))
    return audit(build_tree(archive(pages)), build_tree(archive(pages.withColumn("html", wrong))))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation takes its first crc32(id) % 9 turns from the one whose id is the next lower multiple of five."""
    conv = F.col("conv_id")
    turns = turns_of(table(spark, sf_dir, "conversations"))
    return prefix_trie(graft(turns, conv - conv % 5, F.crc32(conv.cast("string")) % 9))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = f"""
WITH u AS (
  SELECT page_id, row_number() OVER () AS n,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '://([^/?#]*)([^?#]*)', 2) ELSE '' END AS path
  FROM pages),
rules(rhost, rpath, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (
  SELECT n, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY n),
found AS (
  SELECT n, 'host:' || w AS name FROM u, (SELECT unnest([{", ".join(f"'{w}'" for w in BLOCKED_WORDS)}]) AS w)
  WHERE regexp_matches(host, '(^|[^a-z0-9])' || w || '($|[^a-z0-9])')
  UNION ALL
  SELECT n, g FROM u, (SELECT unnest([{", ".join(f"'{g}'" for g in BLOCKED_GLOBS)}]) AS g)
  WHERE regexp_full_match(host || path, '([^/]*[.])?' || replace(replace(g, '.', '[.]'), '*', '.*'))),
words AS (SELECT n, substr(max(printf('%04d', length(name)) || name), 5) AS pattern FROM found GROUP BY n)
SELECT page_id, host, path, rule,
       CASE WHEN action IS NOT NULL THEN action WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       coalesce(rule, pattern) AS pattern
FROM u LEFT JOIN fits USING (n) LEFT JOIN words USING (n)
"""


def _phrase_at(words: list[str]) -> str:
    return " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))


def _op5_sql() -> str:
    """Base phrases, notices, scores, and what notices permit. Identifier tags need the expression parser; the tables hold none, so a score of 1.0 never shows."""
    places = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS pos, '{label}' AS label, {base} AS is_base, i + {len(p.split())} AS next FROM spots WHERE {_phrase_at(p.split())}" for phrases, base in ((BASE_PHRASES, "true"), (NOTICES, "false")) for p, label in phrases.items())
    accepted, filling = (", ".join(f"'{x}'" for x in sorted(some)) for some in (ACCEPTED | ACCEPTED_NOTICES, FILLING))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
places AS ({places}),
found AS (SELECT doc_id, count(*) FILTER (WHERE is_base) AS n_base, min(pos) FILTER (WHERE is_base) AS first_word, max(pos) FILTER (WHERE is_base) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
          FROM places GROUP BY doc_id),
k AS (SELECT doc_id, pos, label, list_filter(w[lag(next) OVER o : pos], lambda x: x NOT IN ({filling}) AND NOT regexp_full_match(x, '[0-9]+')) AS between FROM places JOIN d USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY pos, next DESC)),
terms AS (SELECT doc_id, label IN ({accepted}) AS ok, count(*) FILTER (WHERE between IS NULL OR between <> ['and'] AND between <> ['or']) OVER o AS bracket, count(*) FILTER (WHERE between IS NULL OR between <> ['and']) OVER o AS term FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
brackets AS (SELECT doc_id, bool_or(ok) AS ok FROM (SELECT doc_id, bracket, bool_and(ok) AS ok FROM terms GROUP BY doc_id, bracket, term) GROUP BY doc_id, bracket),
p AS (SELECT doc_id, bool_and(ok) AS permitted FROM brackets GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 0.9 WHEN labels IS NOT NULL THEN 0.6 ELSE 0.0 END::DOUBLE AS score, permitted
FROM d LEFT JOIN found USING (doc_id) LEFT JOIN p USING (doc_id)
"""


OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles FROM s),
t AS MATERIALIZED (SELECT doc_id, hash(unnest(g)) AS x FROM s),
p AS (SELECT a.doc_id AS v, b.doc_id AS w, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT v, w FROM p JOIN n a ON a.doc_id = v JOIN n b ON b.doc_id = w WHERE 100 * k >= 85 * (a.n_shingles + b.n_shingles - k)),
e AS MATERIALIZED (SELECT v, w FROM l UNION ALL SELECT w, v FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT e.w, r.c FROM r JOIN e ON e.v = r.v WHERE r.c < e.w)
SELECT doc_id, n_shingles, (SELECT min(c) FROM r WHERE r.v = n.doc_id) AS component_id FROM n
"""

OP7_SQL = """
WITH r AS (
  SELECT page_id, floor(page_id / 4096)::BIGINT AS at_file, coalesce(url, '') AS u, coalesce(html, '') AS a,
         CASE WHEN page_id % 97 = 13 AND strlen(html) > 0 THEN '?' || substr(html, 2) ELSE coalesce(html, '') END AS b FROM pages),
h AS (
  SELECT page_id, coalesce(at_file, -1 - ('0x' || substr(sha256(f(u, a)), 1, 3))::BIGINT) AS file, sha256(f(u, a)) AS da, sha256(f(u, b)) AS db, strlen(f(u, a)) AS la FROM r),
p AS (SELECT *, row_number() OVER w - 1 AS node, sum(la) OVER w AS stop FROM h WINDOW w AS (PARTITION BY file ORDER BY page_id, da ROWS UNBOUNDED PRECEDING))
SELECT file, node::BIGINT AS node, (stop - la)::BIGINT AS start, stop::BIGINT AS stop, page_id, da AS digest_a, db AS digest_b FROM p WHERE da <> db
""".replace("f(u, a)", "RECORD_A").replace("f(u, b)", "RECORD_B")
for _side in "ab":
    OP7_SQL = OP7_SQL.replace(f"RECORD_{_side.upper()}", f"('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10) || 'Content-Length: ' || strlen({_side})::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || {_side} || chr(13) || chr(10) || chr(13) || chr(10))")


#: crc32 by its definition, from the hex digits of a text's bytes.
CRC_SQL = "tb AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))) AS t)"


def _crc(text: str) -> str:
    bytes_of = f"list_transform(range(strlen({text})), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_of}), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295)"


OP11_SQL = f"""
WITH {CRC_SQL},
d AS (SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
q AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
f AS MATERIALIZED (SELECT n, unnest(w || list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS x FROM d),
g AS MATERIALIZED (SELECT unnest(w || list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS x FROM q),
b AS MATERIALIZED (SELECT x, {_crc("x")} % 10000 AS b FROM (SELECT x FROM f UNION SELECT x FROM g), tb),
s AS (SELECT b, count(*)::DOUBLE AS s FROM f JOIN b USING (x) GROUP BY b),
t AS (SELECT b, count(*)::DOUBLE AS t FROM g JOIN b USING (x) GROUP BY b),
u AS (SELECT (SELECT count(*) FROM f)::DOUBLE AS su, (SELECT count(*) FROM g)::DOUBLE AS tu),
gain AS (SELECT b.b, floor(1000 * ln((coalesce(t, 0) + 1) * (su + 10000) / ((coalesce(s, 0) + 1) * (tu + 10000))))::BIGINT AS gain FROM (SELECT DISTINCT b FROM b) b LEFT JOIN s USING (b) LEFT JOIN t USING (b), u),
m AS (SELECT n, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN b USING (x) JOIN gain USING (b) GROUP BY n),
e AS (SELECT doc_id, n, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN m USING (n)),
r AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM e WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 25 * total // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (n)
"""

OP12_SQL = f"""
WITH {CRC_SQL},
c AS (SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc("conv_id::VARCHAR")} % 9 AS h FROM (SELECT conv_id FROM c), tb),
p AS MATERIALIZED (SELECT h.conv_id, coalesce(b.t[1:h], []) || c.t[h + 1:] AS t FROM h JOIN c USING (conv_id) LEFT JOIN c b ON b.conv_id = h.base),
m AS (SELECT conv_id, len(t) AS len, d AS depth, md5(t[1:d]::VARCHAR) AS id, CASE WHEN d > 0 THEN md5(t[1:d - 1]::VARCHAR) END AS up, CASE WHEN d > 0 THEN strlen(t[d].x) ELSE 0 END AS size FROM (SELECT conv_id, t, unnest(range(len(t) + 1)) AS d FROM p)),
n AS MATERIALIZED (SELECT id, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len = depth), '')) AS ends_sha256 FROM m GROUP BY id, depth),
k AS (SELECT up AS id, depth - 1 AS depth, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY ALL),
o AS (SELECT n.*, coalesce(n_children, 0) AS n_children, t FROM n LEFT JOIN k USING (id, depth) JOIN p USING (conv_id)),
a AS (SELECT saved, (n_children = 0)::INT AS leaf, g AS depth, md5(t[1:g]::VARCHAR) AS id FROM (SELECT *, unnest(range(depth + 1)) AS g FROM o)),
s AS (SELECT id, depth, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY id, depth)
SELECT o.conv_id, o.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, o.ends_sha256
FROM o JOIN s USING (id, depth) LEFT JOIN n u ON u.id = o.up AND u.depth = o.depth - 1
"""


def queries() -> dict:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_toxicity": op3_toxicity,
        "op4_fingerprints": op4_fingerprints,
        "op5_license_scan": op5_license_scan,
        "op6_decontaminate": op6_decontaminate,
        "op7_warc_audit": op7_warc_audit,
        "op8_token_files": op8_token_files,
        "op9_bpe_round_trip": op9_bpe_round_trip,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_importance_resample": op11_importance_resample,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_best_fit_packing": op13_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op2_jaccard_join": OP2_SQL, "op5_license_scan": _op5_sql(), "op7_warc_audit": OP7_SQL, "op11_importance_resample": OP11_SQL, "op12_prefix_trie": OP12_SQL}
