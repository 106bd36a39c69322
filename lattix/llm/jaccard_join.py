"""N-gram Jaccard join by adaptive multi-match prefixes, exact, with components of the links.

A document is the set of hashes of its word n-grams; equal sets are one node ``v`` (a 64-bit hash of the set). By the prefix lemma,
two sets that share ``need`` tokens share at least l tokens of their first ``size - need + l`` in any common order.

1. Pruning. A set of which too few tokens stand in any other set can link with nothing. One pass and one shuffle count, for the first
   tokens of each set in hash order, how many another set holds (``tokens_elsewhere``). The sets that remain are written once each.
2. Frequencies. Tokens of the remaining sets are counted, exactly, and ordered by count, rare first.
3. Adaptive prefixes. Each set takes the l of ``ELLS`` that makes its estimated candidate cost least: the posting lists that its prefix
   reads, and the sets that can stand l times in them, which would have to be verified. A longer prefix asks for more shared tokens.
4. Candidates. Each set is verified first against the set that it meets most often in the prefixes; these links give components. Then
   every pair of different components that shares l prefix tokens, at places and sizes that fit, is verified. A token of more than
   ``HOT`` sets that still spans components is not paired with itself: it has a pivot set, and its sets are joined by their
   differences from the pivot (``pivot_pairs``).
5. Components of all links.

No key's rows pile up: frequent tokens and sets that many others are verified against are told by their counts. Those with over
1/``SPREAD`` of all rows are fewer than ``SPREAD``, so that they can be broadcast or salted (``spread_join``, ``with_sets``).

Null, empty and wordless texts are empty sets linked with nothing; fewer words than n are one n-gram. Repeated rows share a node.
Very long texts are read whole; the memory of a task grows with its longest one. Rows with a null id take part; a component's id is
its smallest id that is not null. Only the id and text columns are read, so that other columns may have any name. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import SPACES, cut, drop_written, is_word, mix, salted_join, shingles, slices, spread_join, text_buffers, words
from .components import components
from .decontaminate import _has, _probes, seed_filter

_WORD = is_word(SPACES)
ELLS = (1, 2, 4, 8, 16)
VERIFY_COST = 8
MAX_BITS = 28
HOT = 128
#: Sets that a task remembers, so as not to send their copies again; tokens of a lot.
REMEMBERED, HELD = 200_000, 1 << 20
#: Kinds of rows; a count of settled tokens is 0 or more.
TOKEN, WITNESS = -1, -2


def row_sets(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, sorted distinct shingle hashes, node) of each row of a batch."""
    data, at = text_buffers(batch.column(column))
    for i, j in slices(at):
        hashed, begin = words(data, at, i, j, _WORD)
        tokens, row = shingles(hashed, begin, width)
        cuts = np.searchsorted(row, np.arange(j - i + 1))
        for k in range(j - i):
            one = np.unique(tokens[cuts[k] : cuts[k + 1]])
            node = int(mix(mix(one ^ np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(one))).view(np.int64)[0]) if len(one) else 0
            yield i + k, one, node


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with any set it links to."""
    return -(-percent * n // 100)


def pruning_prefix(n: int, percent: int) -> tuple[int, int]:
    """(how many first tokens of a set of n are looked at, how many of them another set must hold).

    Sets x and y that link share at least min(l(x), l(y)) of the tokens looked at in both. The least partner of a set of n has
    least_overlap(n) tokens, and l grows with the size, so that its l is what can be asked for.
    """

    def ell(size: int) -> int:
        return min(least_overlap(size, percent), 1 + size // 10)

    need = least_overlap(n, percent)
    return n - need + ell(n), ell(need)


def jaccard_nodes(docs: DataFrame, width: int) -> DataFrame:
    """Per document: doc_id, n, v."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(one), node) for _, one, node in row_sets(batch, 1, width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["doc_id", "n", "v"])

    return docs.mapInArrow(work, "doc_id long, n long, v long")


def tokens_elsewhere(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Sets that can link: v, n of those with enough first tokens that another set holds too. One shuffle of tokens.

    A token that two sets of one lot of a task's rows hold is settled there: its sets only add to a count, and one witness row tells other tasks.
    So a frequent token sends a row for each lot, not for each set.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts, nodes, sizes, held = [], [], [], 0
        for batch in batches:
            for _, one, node in row_sets(batch, 0, width):
                if len(one) and node not in seen:
                    seen.add(node)
                    parts.append(one[: pruning_prefix(len(one), percent)[0]].copy())
                    nodes.append(node)
                    sizes.append(len(one))
                    held += len(parts[-1])
                    if held > HELD or len(seen) > REMEMBERED:
                        yield from _token_rows(parts, nodes, sizes)
                        parts, nodes, sizes, held = [], [], [], 0
                        if len(seen) > REMEMBERED:  # not before: in a lot a set stands once
                            seen = set()
        if parts:
            yield from _token_rows(parts, nodes, sizes)

    dealt = docs.select("text").mapInArrow(emit, "key long, v long, n long, k long").repartition("key").sortWithinPartitions("key")
    counts = dealt.mapInArrow(_settle, "v long, n long, k long, copies long").groupBy("v").agg(F.max("n").alias("n"), F.sum("k").alias("k"), F.sum("copies").alias("copies"))
    least = F.expr(f"({percent} * n + 99) div 100")
    asked = F.least(F.expr(f"({percent} * least + 99) div 100"), F.expr("1 + least div 10"))
    return counts.withColumn("least", least).where(F.col("k") >= F.col("copies") * asked).select("v", "n")


def _token_rows(parts: list[np.ndarray], nodes: list[int], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows (key, v, n, k) of different sets: their tokens that stand once, a witness of the others, and how many of the others each set holds."""
    v, n = np.array(nodes), np.array(sizes)
    token, at = np.concatenate(parts).view(np.int64), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(token, kind="stable")
    token, at = token[order], at[order]
    same = np.concatenate([[False], token[1:] == token[:-1]])
    local = same | np.append(same[1:], False)
    single, witness = ~local, token[local & ~same]
    none = np.zeros(len(witness), np.int64)
    cols = [
        np.concatenate([token[single], witness, v]), np.concatenate([v[at[single]], none, v]), np.concatenate([n[at[single]], none, n]),
        np.concatenate([np.full(int(single.sum()), TOKEN), np.full(len(witness), WITNESS), np.bincount(at[local], minlength=len(v))]),
    ]
    for a in range(0, len(cols[0]), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 17)]) for c in cols], names=["key", "v", "n", "k"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their tokens; the last token of a batch waits for the next. A set that several tasks have sent counts as often (``copies``)."""
    held = [np.zeros(0, np.int64)] * 4
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in range(4)]
        counted = cols[3] >= 0
        if counted.any():
            yield _counts(*(c[counted] for c in cols[1:]), 1)
        cols = [np.concatenate([h, c[~counted]]) for h, c in zip(held, cols, strict=True)]
        stop = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
        held = [c[stop:] for c in cols]
        yield from _shared([c[:stop] for c in cols])
        if len(held[0]) > 1 << 20 and (ready := list(_shared(held))):  # a very frequent token that sets share: what comes later needs a witness only
            yield from ready
            held = [c[:1] for c in held]
            held[3] = np.full(1, WITNESS)
    yield from _shared(held)


def _shared(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    token, v, n, k = cols
    if not len(token):
        return
    edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    group = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(token))))
    seen = k == WITNESS
    most = np.iinfo(np.int64)
    mixed = np.minimum.reduceat(np.where(seen, most.max, v), edge) < np.maximum.reduceat(np.where(seen, most.min, v), edge)
    ok = ~seen & (mixed | np.logical_or.reduceat(seen, edge))[group]
    if ok.any():
        yield _counts(v[ok], n[ok], np.ones(int(ok.sum()), np.int64), 0)


def _counts(v: np.ndarray, n: np.ndarray, k: np.ndarray, copies: int) -> pa.RecordBatch:
    nodes, first, inverse = np.unique(v, return_index=True, return_inverse=True)
    cols = [nodes, n[first], np.bincount(inverse, weights=k).astype(np.int64), copies * np.bincount(inverse)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["v", "n", "k", "copies"])


def sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(v, tokens binary) of the given nodes. A bit filter of bounded size keeps most other sets from travelling."""
    many = nodes.count()
    bits = max(16, min(MAX_BITS, (64 * many).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(seed_filter(nodes.select(F.col("v").alias("hash")), bits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            held, seen, size = [], set(), 0
            for _, one, node in row_sets(batch, 0, width):
                p = _probes(np.array([node]).view(np.uint64), bits)
                if len(one) and node not in seen and _has(bitmap, p[0])[0] and _has(bitmap, p[1])[0]:
                    seen.add(node)
                    held.append((node, one.tobytes()))
                    size += one.nbytes
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary())], names=["v", "tokens"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary())], names=["v", "tokens"])

    return docs.select("text").mapInArrow(work, "v long, tokens binary").join(nodes.select("v"), "v", "left_semi").groupBy("v").agg(F.first("tokens").alias("tokens"))


def with_sets(pairs: DataFrame, sets: DataFrame, w: str) -> DataFrame:
    """``pairs`` with the tokens of column ``v`` as ``a`` and of column ``w``, which many pairs may name, as ``b``."""
    copies = sets.select(F.col("v").alias(w), F.col("tokens").alias("b"))
    return salted_join(pairs, copies, w, "v").join(sets.select("v", F.col("tokens").alias("a")), "v")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (v, w) whose sets link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["v", "w"])

    return with_sets(pairs.select("v", "w"), sets, "w").select("v", "w", "a", "b").mapInArrow(work, "v long, w long")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id. Sets link when 100 * intersection >= percent * union."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    written: list[DataFrame] = []

    def keep(df: DataFrame, purpose: str) -> DataFrame:
        written.append(cut(df, purpose))
        return written[-1]

    nodes = cut(jaccard_nodes(docs, width), "jaccard-nodes")
    alive = keep(tokens_elsewhere(docs, width, percent), "jaccard-alive")
    sets = keep(sets_of(docs, alive, width), "jaccard-sets")
    rows = keep(adaptive_prefixes(sets, percent), "adaptive-prefixes")
    links = keep(verify(keep(hub_pairs(rows, percent), "hub-pairs"), sets, percent), "hub-links")
    comps = components(links)

    def labelled(some: DataFrame) -> DataFrame:
        return some.join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))

    cold, hot = split_hot(keep(labelled(rows), "labelled-prefixes"))
    more = keep(verify(keep(candidate_pairs(cold, percent), "candidates"), sets, percent), "more-links")
    pivots = keep(hot, "pivots")
    differences = None if pivots.isEmpty() else keep(pivot_differences(pivots, sets, percent), "pivot-differences")
    if differences is not None:
        more = more.unionByName(differences.where("linked").select("v", F.col("hub").alias("w")))
    links = links.unionByName(more)
    if not more.isEmpty():
        written.append(comps)
        comps = components(links)
    if differences is not None:
        more = keep(verify(keep(pivot_pairs(labelled(differences), percent), "pivot-candidates"), sets, percent), "pivot-links")
        if not more.isEmpty():
            written.append(comps)
            comps = components(links.unionByName(more))
    drop_written(docs.sparkSession, *written)

    names = nodes.where("n > 0").groupBy("v").agg(F.min("doc_id").alias("low")).join(comps, "v", "left").select("v", "low", F.coalesce("comp", "v").alias("comp"))
    lowest = names.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = names.join(lowest, "comp").select("v", "component_id")
    return nodes.join(named, (nodes["v"] == named["v"]) & (nodes["n"] > 0), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def adaptive_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (token, v, n, m, pos, ell): the prefix of each set by the frequency of its tokens among ``sets``, rare first. m counts the tokens that another set holds; pos is the place of the token in its set."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            token, sizes = np.frombuffer(data[at[0] : at[-1]].tobytes(), np.int64), np.diff(at) // 8
            v, n = (np.repeat(x, sizes) for x in (batch.column(0).to_numpy(), sizes))
            for a in range(0, len(token), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 17)]) for c in (token, v, n)], names=["token", "v", "n"])

    rows = sets.select("v", "tokens").mapInArrow(spread, "token long, v long, n long")
    df = cut(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token-counts")
    dealt = spread_join(rows, df, "token").select("v", "df", "token", "n").repartition("v").sortWithinPartitions("v", "df", "token")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets in order, a set's tokens by frequency; the last set of a batch waits for the next."""
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            cols = [np.concatenate([h, batch.column(c).to_numpy()]) for c, h in enumerate(held)]
            stop = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            yield from _prefixes([c[:stop] for c in cols], percent)
            held = [c[stop:] for c in cols]
        yield from _prefixes(held, percent)

    return dealt.mapInArrow(choose, "token long, v long, n long, m long, pos long, ell long")


def _prefixes(cols: list[np.ndarray], percent: int) -> Iterator[pa.RecordBatch]:
    v, df, token, n = cols
    if not len(v):
        return
    edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    sizes = np.diff(np.append(edge, len(v)))
    need = -(-percent * n[edge] // 100)
    of = np.repeat(np.arange(len(edge)), sizes)
    pos = n - sizes[of] + np.arange(len(v)) - edge[of]
    longest = (n[edge] - need)[of]
    best, ell = np.full(len(edge), np.inf), np.ones(len(edge), np.int64)
    for l in ELLS:
        met = np.add.reduceat(np.where(pos < longest + l, df - 1, 0), edge)
        # at most met / l sets stand l times in these lists; a set is offered no larger l than the tokens it must share with any other
        cost = np.where((l == 1) | (need >= l), met * (1 + VERIFY_COST / l), np.inf)
        ell[cost < best], best = l, np.minimum(cost, best)
    keep = (pos < longest + ell[of]) & (sizes >= need)[of]
    out = (token, v, n, sizes[of], pos, ell[of])
    yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in out], names=["token", "v", "n", "m", "pos", "ell"])


def fits(percent: int) -> tuple[Column, Column]:
    """(whether sets a and b can share enough, with the token at a fitting place; the prefix tokens that they must share)."""
    need = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    ell = F.least("ell_a", "ell_b")
    ok = F.least("m_a", "m_b") >= need
    return ok & (F.col("pos_a") < F.col("n_a") - need + ell) & (F.col("pos_b") < F.col("n_b") - need + ell), F.least(ell, need)


PREFIX = ("v", "n", "m", "pos", "ell")


def _side(rows: DataFrame, side: str, *more: str) -> DataFrame:
    return rows.select("token", *(F.col(c).alias(f"{c}_{side}") for c in (*PREFIX, *more)))


def hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (v, w): each set with that set of least own tokens which it meets most often."""
    rank = F.struct(((F.col("n") - F.col("m")) / F.col("n")).alias("own"), F.col("v").alias("v"))
    hubs = rows.groupBy("token").agg(F.count("*").alias("df"), F.min_by(F.struct(*PREFIX), rank).alias("h")).where("df > 1")
    hubs = cut(hubs.select("token", "df", *(F.col(f"h.{c}").alias(f"{c}_b") for c in PREFIX)), "hubs")
    met = spread_join(_side(rows, "a"), hubs, "token").where((F.col("v_a") != F.col("v_b")) & fits(percent)[0])
    counted = met.groupBy("v_a", "v_b").agg(F.count("*").alias("k"))
    return counted.groupBy(F.col("v_a").alias("v")).agg(F.max_by("v_b", F.struct("k", "v_b")).alias("w"))


def split_hot(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of tokens of at most HOT sets, (v, n, hub) of the others): hub is the token's set of least own tokens. Tokens of one component are left out."""
    own = F.struct(((F.col("n") - F.col("m")) / F.col("n")).alias("own"), F.col("v").alias("hub"))
    lists = rows.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(own).alias("h")).where("c0 <> c1")
    lists = cut(lists.select("token", "df", "h.hub"), "spanning-tokens")
    cold = rows.join(lists.where(F.col("df") <= HOT).select("token"), "token", "left_semi")
    hot = spread_join(rows.select("token", "v", "n"), lists.where(F.col("df") > HOT), "token").where("v <> hub")
    return cold, hot.select("v", "n", "hub").distinct()


def pivot_differences(hot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(v, n, hub, linked, d): the tokens that only one of v and its pivot holds, and whether these two link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, d = [], []
            for a, b in zip(batch.column(3), batch.column(4), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                d.append(np.setxor1d(x, y, assume_unique=True).view(np.int64))
                both = (len(x) + len(y) - len(d[-1])) // 2
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(linked, pa.bool_()), pa.array(d, pa.list_(pa.int64()))], names=["v", "n", "hub", "linked", "d"])

    return with_sets(hot, sets, "hub").select("v", "n", "hub", "a", "b").mapInArrow(work, "v long, n long, hub long, linked boolean, d array<long>")


def pivot_pairs(differences: DataFrame, percent: int) -> DataFrame:
    """Pairs (v, w) of different components that may link, of sets with one pivot.

    Sets a and b link when at most t * (|a| + |b|) tokens are in only one of them, t = (100 - percent) / (100 + percent). With A and B
    their differences from the pivot, they share at least (|A| + |B| - t * (|a| + |b|)) / 2 tokens of these. Two sets that link to the
    pivot are in one component by that. If a does not link to it, the shared tokens are more than (1 - t) / 2 of B, so prefixes of A and
    B by rarity meet: few tokens of a group's common text are in them. A token whose sets are all of one component pairs nothing, and a
    set with few tokens that others hold pairs only with sets of small differences: where a token has none, it is left out there.
    """
    t = (100 - percent) / (100 + percent)
    rows = differences.withColumn("size", F.size("d")).select("v", "n", "comp", "hub", "linked", "size", F.explode("d").alias("d"))
    of_set = Window.partitionBy("hub", "v")
    lists = rows.groupBy("hub", "d").agg(F.count("*").alias("df"), (F.min("comp") != F.max("comp")).alias("spans"), F.min(F.when(~F.col("linked"), F.col("size"))).alias("least_of_a"), F.min("size").alias("least_of_b")).where("df > 1")
    rows = rows.join(lists, ["hub", "d"]).withColumn("m", F.count("*").over(of_set))
    rows = rows.withColumn("pos", F.col("size") - F.col("m") + F.row_number().over(of_set.orderBy("df", "d")) - 1)
    most = 2 * F.col("m") - F.col("size") + t * (1 + 100 / percent) * F.col("n") + 1e-6  # no partner's difference is larger
    least_a = F.greatest(F.lit(1), F.ceil(F.col("size") - t * (1 + 100 / percent) * F.col("n") - 1e-6))
    least_b = F.greatest(F.lit(1), F.ceil((1 - t) / 2 * F.col("size") - 1e-6))
    a = rows.where(F.col("spans") & ~F.col("linked") & (most >= F.col("least_of_b")) & (F.col("pos") <= F.col("size") - least_a))
    b = rows.where(F.col("spans") & (most >= F.col("least_of_a")) & (F.col("pos") <= F.col("size") - least_b))
    a, b = (x.select("hub", "d", *(F.col(c).alias(f"{c}_{side}") for c in ("v", "n", "comp", "size", "pos"))) for x, side in ((a, "a"), (b, "b")))
    need = (F.col("size_a") + F.col("size_b") - t * (F.col("n_a") + F.col("n_b"))) / 2 - 1e-6
    ok = (F.col("comp_a") != F.col("comp_b")) & (F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) >= need)
    met = a.join(b, (a["hub"] == b["hub"]) & (a["d"] == b["d"]) & ok)
    return met.select(F.least("v_a", "v_b").alias("v"), F.greatest("v_a", "v_b").alias("w")).distinct()


def candidate_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (v, w) of different components that share enough prefix tokens."""
    ok, ell = fits(percent)
    a, b = _side(rows, "a", "comp"), _side(rows, "b", "comp")
    pairs = a.join(b, (a["token"] == b["token"]) & (F.col("v_a") < F.col("v_b")) & (F.col("comp_a") != F.col("comp_b")) & ok)
    return pairs.groupBy("v_a", "v_b", ell.alias("ell")).agg(F.count("*").alias("k")).where("k >= ell").select(F.col("v_a").alias("v"), F.col("v_b").alias("w"))
