"""WARC fixity: Merkle trees over records and ordered offset ranges, and an audit of replicas that descends only where they differ.

An archive is a set of files; a record is known by its file, its place, offset, length and digest. A tree's leaf hashes the
record's digest with its offset range; each inner node hashes up to ``FANOUT`` children in order and spans their range. An audit
joins the roots of two replicas, then the children of differing nodes, and so on: it reads a level's rows only below a mismatch.

All is DataFrame functions. A level groups by (file, node) over rows already dealt by file, at most ``FANOUT`` digests to a group.
Null URLs and bodies are empty fields of a record; records with a null id are filed by their digest; repeated rows are records of their
own, and of equal ids those with the lower digest come first. Very long bodies are hashed where they are read and never travel. An
empty table has no trees. Only the id, URL and body columns are read, so that other columns may have any name. A record that one
replica lacks shows with null fields on that side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import cut

FANOUT = 16
FILE_RECORDS = 4096


def warc_record(uri: Column, body: Column) -> Column:
    """One response record: header lines, an empty line, the body and two line ends."""
    uri, body = F.coalesce(uri, F.lit("")), F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """Records of consecutive ids laid out in files of ``file_records`` ids: file, place, offset, length, digest, page_id. Bodies are hashed where they are read; only digests are shuffled."""
    record = warc_record(F.col(uri_col), F.col(body_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    apart = -1 - F.conv(F.substring("digest", 1, 3), 16, 10).cast("long")  # records without an id lie in 4,096 files by their digest
    rows = rows.withColumn("file", F.coalesce(F.floor(F.col("page_id") / file_records).cast("long"), apart))
    w = Window.partitionBy("file").orderBy("page_id", "digest")
    return rows.select("file", (F.row_number().over(w) - 1).cast("long").alias("place"), (F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"), "length", "digest", "page_id")


@dataclass(frozen=True)
class Tree:
    """levels[0] has leaves (file, node, hash, start, stop and the record's columns); the last level has one root a file."""

    levels: list[DataFrame]


def build_tree(records: DataFrame, fanout: int = FANOUT) -> Tree:
    leaf = F.sha2(F.concat_ws(" ", "offset", "length", "digest"), 256)
    level = cut(records.select("file", F.col("place").alias("node"), leaf.alias("hash"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"), "length", "digest", "page_id").repartition("file"), "merkle-leaves")
    levels = [level]
    widest = level.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    while widest > 1:
        kids = F.sort_array(F.collect_list(F.struct("node", "hash")))
        ranges = F.concat_ws(" ", F.min("start"), F.max("stop"), F.array_join(F.transform(kids, lambda x: x["hash"]), ""))
        level = level.groupBy("file", F.floor(F.col("node") / fanout).alias("node")).agg(F.sha2(ranges, 256).alias("hash"), F.min("start").alias("start"), F.max("stop").alias("stop"))
        level = cut(level, "merkle-level")
        levels.append(level)
        widest = -(-widest // fanout)
    return Tree(levels)


def audit(a: Tree, b: Tree, fanout: int = FANOUT) -> DataFrame:
    """One row per record that differs between two replicas: file, node, start, stop, page_id, digest_a, digest_b."""
    fields = ["hash", "start", "stop"]
    bad: DataFrame | None = None
    depth = max(len(a.levels), len(b.levels))

    def at(tree: Tree, k: int, side: str) -> DataFrame:
        level = tree.levels[min(k, len(tree.levels) - 1)]
        if k >= len(tree.levels):  # a lower tree has no such level: its root stands for it, with another hash
            level = level.withColumn("hash", F.concat(F.lit("low:"), F.col("hash")))
        extra = ["length", "digest", "page_id"] if k == 0 else []
        return level.select("file", "node", *(F.col(c).alias(f"{c}_{side}") for c in [*fields, *extra]))

    for k in range(depth - 1, -1, -1):
        left, right = at(a, k, "a"), at(b, k, "b")
        if bad is not None:
            up = bad.select("file", F.col("node").alias("up"))
            left, right = (x.join(up, (x["file"] == up["file"]) & (F.floor(x["node"] / fanout) == up["up"]), "left_semi") for x in (left, right))
        bad = left.join(right, ["file", "node"], "full_outer").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        if k:
            bad = cut(bad, "merkle-mismatches")
    return bad.select("file", "node", F.coalesce("start_a", "start_b").alias("start"), F.coalesce("stop_a", "stop_b").alias("stop"), F.coalesce("page_id_a", "page_id_b").alias("page_id"), "digest_a", "digest_b")
