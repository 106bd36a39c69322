"""Prefix trie of conversations: one row per distinct sequence of first turns.

A turn is known by the MD5 of its role and text, a conversation by the hex digests of its turns in one string (its path). Equal paths are
one class: its size, least id and the digest of its ids are worked out once, so that copies cost the trie nothing. Classes are dealt to
places by a hash of their first turn; a place builds dictionary tries of pointers and sums them from below without recursion.

A subtrie with more turns than a place's share is not built in one place. What all its classes begin with (the common prefix of its least
and its greatest path) is a chain of nodes that hold the same members; below it the classes are dealt anew by their next turn, again and
again until each part fits. Chains take their totals from the parts below them: sums per chain, then per chain above.

Turns are ordered by turn, null first, then by digest; null roles and texts are empty. Rows without a conv_id belong to no conversation
and are left out. Repeated rows are turns of their own. Only digests and lengths of turns travel, so texts may be long; a conversation's
digests (40 bytes a turn) fit a row. An empty table gives no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import cut, drop_written

#: Characters of a turn's digest.
STEP = 32
#: Turns that a place builds tries of, about.
TURNS = 1 << 16
#: A subtrie of so few turns is never dealt out.
LEAST = 1024
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: the digest and the UTF-8 bytes of the text of each turn, in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(F.col(turn_col).alias("turn"), digest.alias("d"), F.octet_length(text).cast("long").alias("n"))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t"))
    ordered = F.sort_array(F.collect_list("t"))  # nulls of a struct's field come first
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["d"].alias("d"), t["n"].alias("n"))).alias("turns"))


def graft(conversations: DataFrame, onto: Column, first: Column) -> DataFrame:
    """Each conversation of ``turns_of`` with its first ``first`` turns replaced by those of the conversation ``onto`` (none where that is absent)."""
    own = conversations.select("conv_id", "turns", onto.alias("_onto"), first.cast("int").alias("_first"))
    given = conversations.select(F.col("conv_id").alias("_onto"), F.col("turns").alias("_given"))
    ahead = F.slice(F.coalesce("_given", F.slice("turns", 1, 0)), F.lit(1), F.col("_first"))
    after = F.slice("turns", F.col("_first") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(given, "_onto", "left").select("conv_id", F.concat(ahead, after).alias("turns"))


def id_digests(members: DataFrame) -> DataFrame:
    """kind, n, conv_id, sha: of each kind the number of its ids, the least, and the SHA-256 of all, ascending and joined by commas.

    Ids are sorted over ranges of (kind, id), so that a frequent kind is many tasks; what meets in one task is their joined text in pieces,
    which streams through the hash.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            at = 0
            for kind, run in groupby(rows):
                n = sum(1 for _ in run)
                out.append((kind, ids[at], n, ",".join(map(str, ids[at : at + n]))))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.string())], names=["kind", "first", "n", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def done(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))] + [pa.array([r[3].hexdigest() for r in rows], pa.string())], names=["kind", "n", "conv_id", "sha"])

        for batch in batches:
            ready = []
            for kind, first, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0] == kind:
                    held[1] += n
                    held[3].update(b"," + ids.encode())
                    continue
                if held:
                    ready.append(held)
                held = [kind, n, first, hashlib.sha256(ids.encode())]
            yield done(ready)
        if held:
            yield done([held])

    pieces = members.select("kind", "conv_id").repartitionByRange("kind", "conv_id").sortWithinPartitions("kind", "conv_id").mapInArrow(join, "kind string, first long, n long, ids string")
    return pieces.repartition("kind").sortWithinPartitions("kind", "first").mapInArrow(digest, "kind string, n long, conv_id long, sha string")


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of the subtries that ``rows`` (gid, depth, up, parent, path, sizes, n, conv_id, sha) make up. ``depth`` is that of a subtrie's top, ``up`` the chain above it, which the top's row keeps."""
    tops: dict[str, int] = {}
    down: list[dict[str, int]] = []
    depth, parent, n_convs, conv, size, ends, up = [], [], [], [], [], [], []

    def made(d: int, above: int, n: int) -> int:
        down.append({})
        depth.append(d)
        parent.append(above)
        n_convs.append(0)
        conv.append(None)
        size.append(n)
        ends.append(NO_ENDS)
        up.append(None)
        return len(down) - 1

    given: dict[int, int] = {}
    for gid, d, chain, parent_id, path, sizes, n, conv_id, sha in zip(*(rows[c] for c in ("gid", "depth", "up", "parent", "path", "sizes", "n", "conv_id", "sha")), strict=True):
        node = tops.get(gid)
        if node is None:
            node = tops[gid] = made(d, -1, sizes[d - 1])
            up[node], given[node] = chain, parent_id
        for k in range(d, len(path) // STEP + 1):
            n_convs[node] += n
            conv[node] = conv_id if conv[node] is None else min(conv[node], conv_id)
            if k * STEP == len(path):
                ends[node] = sha
                break
            turn = path[k * STEP : (k + 1) * STEP]
            below = down[node].get(turn)
            if below is None:
                below = down[node][turn] = made(k + 1, node, sizes[k])
            node = below
    leaves, saved = [0] * len(down), [0] * len(down)
    for top in tops.values():
        todo, order = [top], []
        while todo:  # parents before children; read backwards it is a postorder
            node = todo.pop()
            order.append(node)
            todo += down[node].values()
        for node in reversed(order):
            leaves[node] += not down[node]
            saved[node] += (n_convs[node] - 1) * int(size[node])
            if parent[node] >= 0:
                leaves[parent[node]] += leaves[node]
                saved[parent[node]] += saved[node]
    above = [given[k] if p < 0 else conv[p] for k, p in enumerate(parent)]
    return pd.DataFrame({"conv_id": conv, "depth": depth, "parent_conv_id": above, "n_convs": n_convs, "n_children": [len(x) for x in down], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "up": up})


def shared_turns(low: pd.Series, high: pd.Series) -> pd.Series:
    """Turns that two paths begin with."""
    return pd.Series([len(os.path.commonprefix([a, b])) // STEP for a, b in zip(low, high, strict=True)])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """NODES of the trie of ``conversations`` (conv_id, turns as of ``turns_of``; an id stands once).

    conv_id: least member; parent_conv_id: that of the node above (the root's is null); n_convs: members; n_leaves: nodes without children
    at or below; saved_tokens: summed over all nodes at or below, members but one times bytes of the node's text; ends_sha256: of the ids
    that end here.
    """
    spark = conversations.sparkSession
    path = F.array_join(F.transform("turns", lambda t: t["d"]), "").alias("path")
    paths = cut(conversations.select("conv_id", path, F.transform("turns", lambda t: t["n"]).alias("sizes")).withColumn("kind", F.md5("path")), "paths")
    length = F.char_length("path") / STEP
    turns = paths.agg(F.sum(length).cast("long")).first()[0] or 0
    places = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // TURNS))
    share = max(LEAST, turns // places)

    kinds = paths.groupBy("kind").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes")).join(id_digests(paths), "kind")
    rows = cut(kinds.select(F.lit("").alias("gid"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("up"), F.lit(None).cast("long").alias("parent"), "path", "sizes", "n", "conv_id", "sha"), "kinds")
    written, chains, ended, small = [paths, rows], [], [], []
    while True:
        chain = rows.groupBy("gid").agg(*(F.first(c).alias(c) for c in ("depth", "up", "parent")), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("path").alias("low"), F.max("path").alias("high"), F.min_by("sizes", "path").alias("sizes"))
        chain = chain.withColumn("last", F.pandas_udf(shared_turns, "long")("low", "high")).withColumn("sizes", F.slice("sizes", F.lit(1), F.col("last").cast("int"))).drop("low", "high")
        above = F.array(F.col("gid")).alias("line")
        if chains:  # the chains above a chain: as many as its rounds
            chain = chain.join(F.broadcast(chains[-1].select(F.col("gid").alias("up"), "line")), "up").withColumn("line", F.concat("line", F.array("gid")))
        else:
            chain = chain.select("*", above)
        chain = cut(chain, "chains")
        chains.append(chain)
        # each chain of a round stands for over ``share`` turns of its own, so there are fewer of them than places
        split = rows.select("gid", "path", "sizes", "n", "conv_id", "sha").join(F.broadcast(chain.select("gid", "last", F.col("conv_id").alias("parent"))), "gid")
        on = F.char_length("path") > F.col("last") * STEP
        next_gid = F.when(on, F.md5(F.substring(F.col("path"), F.lit(1), ((F.col("last") + 1) * STEP).cast("int"))))
        split = cut(split.select(next_gid.alias("gid"), (F.col("last") + 1).alias("depth"), F.col("gid").alias("up"), "parent", "path", "sizes", "n", "conv_id", "sha"), "split")
        written.append(split)
        ended.append(split.where("gid is null").select(F.col("up").alias("gid"), "sha"))
        parts = split.where("gid is not null")
        large = parts.groupBy("gid").agg(F.sum(length - F.col("depth") + 1).alias("turns")).where(F.col("turns") > share).select("gid")
        large = cut(large, "large")
        written.append(large)
        small.append(parts.join(F.broadcast(large), "gid", "left_anti"))
        if large.isEmpty():
            break
        rows = parts.join(F.broadcast(large), "gid", "left_semi")

    dealt = reduce(DataFrame.unionByName, small).withColumn("place", F.pmod(F.xxhash64("gid"), F.lit(places)))
    nodes = cut(dealt.groupBy("place").applyInPandas(lambda pdf: build(pdf), NODES + ", up string"), "nodes")
    tops = chain_nodes(reduce(DataFrame.unionByName, chains), reduce(DataFrame.unionByName, ended), nodes)
    tops = cut(tops, "tops")
    drop_written(spark, *written, *chains)
    return nodes.drop("up").unionByName(tops)


def chain_nodes(chains: DataFrame, ended: DataFrame, nodes: DataFrame) -> DataFrame:
    """NODES of the chains: their own sums, those of the subtries right below, and those of the chains below."""
    below = nodes.where("up is not null").groupBy(F.col("up").alias("gid")).agg(F.count("*").alias("n_small"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    large = chains.where("up is not null").groupBy(F.col("up").alias("gid")).agg(F.count("*").alias("n_large"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    own = chains.join(below, "gid", "left").join(large, "gid", "left").join(ended, "gid", "left")
    top = F.greatest(F.col("depth"), F.lit(1).cast("long"))
    text = F.aggregate(F.slice("sizes", top.cast("int"), F.size("sizes") + 1), F.lit(0).cast("long"), lambda a, b: a + b)
    own = own.withColumn("children", zero("n_small") + zero("n_large")).withColumn("saved", zero("saved") + (F.col("n_convs") - 1) * text).withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(zero("leaves")))
    total = own.select(F.explode("line").alias("gid"), "leaves", "saved").groupBy("gid").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    rows = own.drop("leaves", "saved").join(total, "gid").withColumn("at", F.explode(F.sequence("depth", "last")))
    size = F.coalesce(F.get("sizes", (F.col("at") - 1).cast("int")), F.lit(0))  # the root has no text
    ahead = F.coalesce(F.sum(size).over(Window.partitionBy("gid").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    is_last = F.col("at") == F.col("last")
    return rows.select("conv_id", F.col("at").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", F.when(is_last, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves", (F.col("saved_tokens") - (F.col("n_convs") - 1) * ahead).alias("saved_tokens"), F.when(is_last, F.coalesce("sha", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"))
