"""Small-input tests of the training-data operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in ("lang", "source")), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("v", "th", "row", "token", "hash", "key", "item"))])


def words(n: int, seed: int, letters: str = "abcdeé") -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n)]


def edited(w: list[str], n: int, seed: int) -> str:
    r, w = random.Random(seed), list(w)
    for _ in range(n):
        w[r.randrange(len(w))] = "edit%d" % r.randrange(10**6)
    return " ".join(w)


def sample_texts() -> list[tuple[int | None, str | None]]:
    base = words(120, 1)
    passage = " ".join(words(60, 2))
    texts = [" ".join(base), " ".join(base), *(edited(base, k % 6, 10 + k) for k in range(24)), None, "", "   ", "one", "one two three", "One  TWO three", passage, " ".join(words(40, 3)) + ". " + passage + "!\n" + " ".join(words(30, 4)), passage + " " + " ".join(words(25, 5)), "xyz " * 400, "a" * 900, " ".join(words(9000, 6)), "漢字 é\u0301 <|endoftext|> it's 12345 we'll\u00a0x\u2028y 'S\x00", "\n\nlicense\n", "MIT License, and the GNU General  Public-License; CC BY 4.0"]
    rows: list[tuple[int | None, str | None]] = [(3 * k, t) for k, t in enumerate(texts)]
    return [*rows, rows[0], (None, " ".join(base)), (None, None), (7, "one two three")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", None, *("x" * 7)) for i, t in sample_texts()], DOCS).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sets_of(width: int):
    out = []
    for i, t in sample_texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        out.append((i, frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())))
    return out


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components_equal_brute_force(docs, empty, width, percent):
    from lattix.llm.jaccard_join import jaccard_components

    rows = sets_of(width)
    comp = list(range(len(rows)))

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                comp[root(a)] = root(b)
    low: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(i, low.get(root(k), i))
    want = sorted(((i, len(s), low.get(root(k)) if s else i) for k, (i, s) in enumerate(rows)), key=str)
    got = sorted((tuple(r) for r in jaccard_components(docs, width, percent).collect()), key=str)
    assert got == want
    assert jaccard_components(empty, width, percent).count() == 0


@pytest.mark.parametrize(("width", "percent", "hot"), [(4, 85, 128), (4, 85, 3), (5, 80, 3)])
def test_jaccard_components_of_a_large_edited_group(spark, monkeypatch, width, percent, hot):
    from lattix.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "HOT", hot)
    base = words(150, 9)
    texts = [edited(base, k % 9, k) for k in range(160)] + [" ".join(words(80, 1000 + k)) + " " + " ".join(base[:30]) for k in range(40)]
    sets = [frozenset(tuple(t.split()[k : k + width]) for k in range(len(t.split()) - width + 1)) for t in texts]
    comp = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(len(texts)):
                if comp[b] < comp[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    comp[a], changed = comp[b], True
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(df, width, percent).collect()) == list(enumerate(comp))


def test_pruning_asks_for_no_more_than_linked_sets_share():
    from lattix.llm.jaccard_join import least_overlap, pruning_prefix

    for percent in range(50, 100):
        for a in range(1, 90):
            for b in range(a, 90):
                both = -(-percent * (a + b) // (100 + percent))
                if both > a:
                    continue
                assert both >= least_overlap(b, percent)
                # the worst order: tokens of one set only come first
                met = min(pruning_prefix(a, percent)[0] - (a - both), pruning_prefix(b, percent)[0] - (b - both))
                assert met >= max(pruning_prefix(a, percent)[1], pruning_prefix(b, percent)[1]), (a, b, percent)


@pytest.mark.parametrize("percent", [50, 85, 95])
def test_jaccard_links_of_every_size(spark, percent):
    from lattix.llm.jaccard_join import jaccard_components

    texts, want, seed = [], [], 0
    for a in range(1, 36):
        for b in range(a, min(36, a * 100 // percent + 2)):
            both = min(a, -(-percent * (a + b) // (100 + percent)))
            for shared in {both, max(both - 1, 0)}:
                seed += 1
                x, y = ([f"s{seed}o{k}x{(k * 7919 + seed * 104729) % 1009}" for k in range(shared)] + [f"s{seed}{side}{k}" for k in range(n - shared)] for side, n in (("l", a), ("r", b)))
                want += [len(texts), len(texts) if 100 * shared >= percent * (a + b - shared) else len(texts) + 1]
                texts += [" ".join(x), " ".join(y)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert [c for _, c in sorted((r.doc_id, r.component_id) for r in jaccard_components(df, 1, percent).collect())] == want


def test_jaccard_components_of_a_large_group_below_the_threshold(spark, monkeypatch):
    """Copies of one text with so many edits that few of them link, to the pivot or to each other."""
    from lattix.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "HOT", 20)
    base = words(200, 9)
    texts = [edited(base, 5 + k % 6, k) for k in range(150)] + [edited(edited(base, 8, 7).split(), k % 3, 900 + k) for k in range(30)]
    sets = [frozenset(tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)) for t in texts]
    comp, changed = list(range(len(texts))), True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(len(texts)):
                if comp[b] < comp[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a], changed = comp[b], True
    assert 50 < len(set(comp)) < 160
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(df, 4, 85).collect()) == list(enumerate(comp))


def test_components(spark):
    from lattix.llm.components import components

    r = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(500, k) for k in range(501, 530)] + [(7, 7), (8, None), (None, None), (100, 101)]
    low = {x: x for pair in links for x in pair if x is not None and None not in pair and pair[0] != pair[1]}
    for _ in low:
        for v, w in links:
            if v in low and w in low and v != w:
                low[v] = low[w] = min(low[v], low[w])
    df = spark.createDataFrame(links, "v long, w long")
    got = [tuple(x) for x in components(df).collect()]
    assert dict(got) == low and len(got) == len(low)
    assert components(df.limit(0)).count() == 0


def short_chains(width: int, percent: int, n: int = 300):
    """Chains of short texts, each chain of its own words, and the chain's number and brute-force component of each."""
    rows, want = [], []
    for seed in range(n):
        r = random.Random(seed)
        size = r.randint(6, 20)
        w = [f"s{seed}w{k}x{r.randrange(10**6)}" for k in range(size + 2)]
        texts = [w[:size], w[: size + 1], w[1 : size + 1]] + [w[1:]] * (seed % 2) + [w[2:]] * (seed % 3 == 0)
        r.shuffle(texts)
        sets = [frozenset(tuple(t[k : k + width]) for k in range(len(t) - width + 1)) or frozenset([tuple(t)]) for t in texts]
        comp = list(range(len(texts)))
        for _ in texts:
            for a in range(len(texts)):
                for b in range(len(texts)):
                    if comp[b] < comp[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        comp[a] = comp[b]
        want += [(len(rows) + k, len(rows) + c) for k, c in enumerate(comp)]
        rows += [(len(rows) + k, " ".join(t)) for k, t in enumerate(texts)]
    return rows, want


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components_of_short_chains(spark, width, percent):
    from lattix.llm.jaccard_join import jaccard_components

    rows, want = short_chains(width, percent)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((r.doc_id, r.component_id) for r in jaccard_components(df, width, percent).collect()) == want


def brute_repeats(texts: list[bytes], window: int):
    seen: dict[bytes, int] = {}
    for t in texts:
        for k in range(len(t) - window + 1):
            seen[t[k : k + window]] = seen.get(t[k : k + window], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k : k + window] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("piece", "shard_bytes"), [(8192, 3 << 18), (8192, 400), (2, 3 << 19), (2, 400)])
def test_suffix_dedup_equals_brute_force(docs, empty, piece, shard_bytes):
    from lattix.llm.suffix_dedup import dedup_substrings

    rows = sample_texts()
    want = sorted([(i, *x) for (i, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], 200), strict=True)], key=str)
    got = sorted((tuple(r) for r in dedup_substrings(docs, piece=piece, shard_bytes=shard_bytes).collect()), key=str)
    assert got == want
    if shard_bytes == 400:
        return
    kept = dedup_substrings(docs, piece=piece, texts=True)
    left = [(r.doc_id, r.kept_sha256, hashlib.sha256(r.kept.encode()).hexdigest()) for r in kept.where("row.source = 's'").collect()]
    assert sorted(((i, a) for i, a, _ in left), key=str) == sorted(((w[0], w[4]) for w in want), key=str) and all(a == b for _, a, b in left)
    assert dedup_substrings(empty).count() == 0


def test_shards_merge_by_binary_search():
    from lattix.llm.suffix_dedup import Run, merge

    for seed in range(40):
        r = random.Random(seed)
        pool = ["".join(r.choice("ab") for _ in range(r.randint(1, 400))) for _ in range(6)]
        texts = [("".join(r.choice(pool) for _ in range(r.randint(0, 4))) + r.choice(["", "x", "\x00"])).encode() for _ in range(9)]
        for window in (8, 61, 200):
            shards = [texts[k::3] for k in range(3)]
            runs = [Run(some, window) for some in shards]
            for k, run in enumerate(runs):
                for other in runs[:k]:
                    merge(other, run)
            found = {(k + 3 * int(t), int(p)) for k, run in enumerate(runs) for t, p, twin in zip(run.row, run.start, run.repeats[run.of], strict=True) if twin}
            seen: dict[bytes, int] = {}
            for t in texts:
                for p in range(len(t) - window + 1):
                    seen[t[p : p + window]] = seen.get(t[p : p + window], 0) + 1
            assert found == {(k, p) for k, t in enumerate(texts) for p in range(len(t) - window + 1) if seen[t[p : p + window]] > 1}, (seed, window)


def test_contexts_of_a_very_long_text(monkeypatch):
    from lattix.llm import suffix_dedup

    text = np.frombuffer(" ".join(words(3000, 5)).encode(), np.uint8)
    at = np.array([0, len(text)])
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    covered = np.zeros(len(text), bool)
    for _, row, pos, size in suffix_dedup.contexts(text, at, 0, 1):
        assert not row.any() and (size >= 200).all()
        for p, n in zip(pos, size, strict=True):
            assert not covered[p : p + n - 199].any()
            covered[p : p + n - 199] = True
    assert covered[: len(text) - 199].all() and not covered[len(text) - 199 :].any()


def test_suffix_arrays_and_common_prefixes():
    from lattix.llm.suffix_dedup import common_prefixes, suffix_array

    r = np.random.default_rng(3)
    for text in (r.integers(97, 99, 700).astype(np.uint8), np.full(500, 97, np.uint8), np.frombuffer(b"abcabcabd" * 60 + b"zz", np.uint8)):
        raw = text.tobytes()
        order = suffix_array(text, 200)
        suffixes = [raw[k : k + 200] for k in order]
        assert suffixes == sorted(suffixes) and sorted(order) == list(range(len(raw)))
        lcp = common_prefixes(text, order, 200, block=64)
        for k in range(1, len(order)):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(n, 200)


def test_repeated_windows_of_long_shared_parts():
    from lattix.llm.suffix_dedup import repeated_windows

    letters = np.frombuffer(b"abcdefghij", np.uint8)
    for seed in range(60):
        r = np.random.default_rng(seed)
        text = lambda n: r.choice(letters, n).tobytes()
        shared = text(256 + 2 * seed if seed < 56 else 368)
        # what follows sorts the earlier text last, or first; the neighbour's byte 199 agrees with the shared part's
        ends = [b"z", b"a"] if seed % 2 else [b"a", b"z"]
        near = [bytearray(shared[k : k + 30] + text(220)) for k in range(1, 60)]
        for k, x in enumerate(near, 1):
            x[199] = shared[k + 199] if k + 199 < len(shared) else x[199]
        texts = [shared + ends[0] + text(20), shared + ends[1] + text(20), *map(bytes, near)]
        places, same, row, start = repeated_windows(texts)
        windows = [texts[i][k : k + 200] for i, k in zip(row, start)]
        assert windows == sorted(windows) and len(windows) == sum(len(t) - 199 for t in texts)
        assert same.tolist() == [k > 0 and windows[k] == windows[k - 1] for k in range(len(windows))], seed


def test_leaks_are_found_despite_substitutions(spark, docs, empty):
    from lattix.llm.decontaminate import find_leaks

    items = [(k, " ".join(words(30, 100 + k))) for k in range(5)] + [(5, None), (6, ""), (7, "too short"), (None, " ".join(words(20, 200))), (2, items_again := " ".join(words(30, 102)))]
    assert items_again
    clean = [" ".join(words(200, 300 + k)) for k in range(20)]
    texts = [*clean, clean[0] + " " + items[1][1].replace("a", "A") + " " + clean[1], "** " + "***, ".join(edited(items[3][1].split(), 3, 5).split()), clean[4] + " " + " ".join(items[4][1].split()[:6]), items[8][1]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, items[0][1]), (50, None), (51, "")], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in find_leaks(df, bench).collect()), key=str)
    assert got == sorted([(20, 1), (21, 3), (23, None), (None, 0)], key=str)
    assert find_leaks(empty, bench).count() == 0
    assert find_leaks(df, bench.limit(0)).count() == 0


def test_leaks_against_every_alignment(spark):
    """Documents with passages of which up to a third of the words are substituted, against all items at all shifts."""
    from lattix.llm.common import NOT_ALNUM, is_word, text_buffers
    from lattix.llm.common import words as word_hashes
    from lattix.llm.decontaminate import ENOUGH, LEAST, SHARE, best_run, find_leaks
    import pyarrow as pa

    r = random.Random(12)
    items = [" ".join(words(r.randint(8, 60), 500 + k)) for k in range(25)]
    texts = []
    for k in range(70):
        w = r.choice(items).split()
        a = r.randint(0, len(w) // 3)
        part = w[a : a + r.randint(len(w) // 2, len(w))]
        part = edited(part, round(len(part) * r.choice([0, 0.05, 0.1, 0.2, 0.33])), k)
        texts.append(" ".join([*words(r.randint(0, 60), 900 + k), part, *words(r.randint(0, 60), 990 + k)]))

    def hashes(some):
        data, at = text_buffers(pa.array(some))
        hashed, ends = word_hashes(data, at, 0, len(some), is_word(NOT_ALNUM))
        return [hashed[ends[k] : ends[k + 1]] for k in range(len(some))]

    want = set()
    for d, doc in enumerate(hashes(texts)):
        for i, item in enumerate(hashes(items)):
            if np.isin(doc, item).sum() < LEAST:
                continue
            found = max(best_run(doc, item, s)[1] for s in range(-len(item) + 1, len(doc)))
            if found >= LEAST and (found >= ENOUGH or found >= SHARE * len(item)):
                want.add((d, i))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {(x.doc_id, x.item_id) for x in find_leaks(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    print(f"leaks by every alignment: {len(want)}; found: {len(got & want)}")
    assert got <= want and len(want) > 40 and len(got) >= 0.9 * len(want)


def test_copies_leak_as_their_class_does(spark):
    """Whole copies, copies of a passage after texts of other lengths, and a template that many items share, against each text judged once."""
    from pathlib import Path

    from lattix.llm.decontaminate import find_leaks

    template = words(13, 700)
    items = [(k, " ".join([*template, *words(6, 710 + k)])) for k in range(12)] + [(k, " ".join(words(30, 730 + k))) for k in (12, 13, 13)]
    kinds = [" ".join([*words(k % 3 * 40, 750 + k), *template, *words(30, 760 + k)]) for k in range(4)] + [" ".join(words(50, 770)) + " " + items[12][1] + " " + items[0][1], " ".join(words(80, 780))]
    rows = [(k if k % 5 else None, kinds[k % 6]) for k in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    alone = {t: [] for t in kinds}
    for r in find_leaks(spark.createDataFrame(list(enumerate(kinds)), "doc_id long, text string"), bench).collect():
        alone[kinds[r.doc_id]].append(tuple(r)[1:])
    best = {}
    for i, t in rows:
        for item, *run in alone[t]:
            rank = (run[0], -run[2], -run[3])
            if rank > best.get((i, item), ((), None))[0]:
                best[i, item] = rank, tuple(run)
    found = find_leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), bench)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((i, item, *run) for (i, item), (_, run) in best.items()), key=str)
    assert len({x for i, x in best if i is None}) == 13
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    assert {p.name.rsplit("-", 1)[0] for p in shared.iterdir() if "decontamination" in p.name or "benchmark" in p.name} <= {"decontamination-leaks"}


def test_frequent_keys_join_as_any_other(spark):
    from lattix.llm.common import salted_join, spread_join

    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(9000)], "key long, n long").repartition(5)
    keys = spark.createDataFrame([(k, f"k{k}", 1) for k in range(1, 9)] + [(0, "zero", 6000)], "key long, name string, df long")
    want = sorted(map(tuple, rows.join(keys.select("key", "name"), "key").collect()))
    assert sorted(map(tuple, spread_join(rows, keys, "key").select("key", "n", "name").collect())) == want
    twice = keys.select("key", "name").unionByName(keys.select("key", F.concat("name", F.lit("b")).alias("name")))
    assert sorted(map(tuple, salted_join(rows, twice, "key", "n").collect())) == sorted(map(tuple, rows.join(twice, "key").collect()))


def test_bpe_and_token_files_equal_the_library(docs, empty, spark):
    import public_tokenizers
    from lattix.llm.bpe import bpe_round_trip, decode_ids, encode_ids
    from lattix.llm.token_files import token_files_round_trip
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in sample_texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert sorted((tuple(r) for r in bpe_round_trip(docs, path).collect()), key=str) == sorted(want, key=str)
    assert bpe_round_trip(empty, path).count() == 0
    assert sorted(len(r.ids) for r in encode_ids(docs, path).collect()) == sorted(w[1] for w in want)
    back = [(r.doc_id, sha(r.text.encode())) for r in decode_ids(encode_ids(docs, path), path).collect()]
    assert sorted(back, key=str) == sorted([(w[0], w[3]) for w in want], key=str)
    odd = spark.createDataFrame([(1, [13]), (2, []), (3, None), (4, [10**6, 255])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode_ids(odd, path).collect()} == {1: library.decode([13]), 2: "", 3: "", 4: library.decode([10**6, 255])}

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    ids = {(i, t): [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in sample_texts()}
    rows = sorted(token_files_round_trip(docs, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in sample_texts()), key=lambda i: -1 if i is None else i)
    total = 0
    for r in rows:
        assert r.start == total
        total += r.n_tokens
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=str) == sorted(((i, len(ids[i, t]), crc(ids[i, t])) for i, t in sample_texts()), key=str)
    assert token_files_round_trip(empty, path).count() == 0


def test_re_pair_shards_decode_any_run():
    from lattix.llm.token_files import Shard, pack

    r = np.random.default_rng(1)
    documents = [r.integers(0, 6, n).astype(np.uint16) for n in (1, 2, 900, 5000, 40)] + [np.tile(np.array([5, 6, 7, 5], np.uint16), 800)]
    ends = np.cumsum([len(d) for d in documents])
    body = pack(np.arange(len(documents)), np.concatenate(documents), ends)
    shard = Shard(body)
    assert len(shard.rules) > 10 and len(shard.symbols) < ends[-1] / 3
    for k, d in enumerate(documents):
        assert (shard.document(k) == d).all()
        for a, b in ((0, 1), (3, 17), (len(d) // 2, len(d)), (len(d), len(d) + 5)):
            assert (shard.document(k, a, b) == d[a:b]).all()


def test_re_pair_goes_on_until_no_pair_repeats():
    from lattix.llm.token_files import LEAST, Shard, pack

    for seed, ids in ((0, 3), (1, 40), (2, 60_000)):
        r = np.random.default_rng(seed)
        documents = [np.minimum(r.geometric(3 / ids, n), ids).astype(np.uint16) for n in r.integers(1, 4000, 60)]
        ends = np.cumsum([len(d) for d in documents])
        shard = Shard(pack(np.arange(len(documents)), np.concatenate(documents), ends))
        counts: dict[tuple[int, int], int] = {}
        for a, b in zip([0, *shard.stops], shard.stops):
            for pair in zip(shard.symbols[a : b - 1].tolist(), shard.symbols[a + 1 : b].tolist()):
                counts[pair] = counts.get(pair, 0) + 1
        assert max(counts.values(), default=0) < LEAST
        assert all((shard.document(k) == d).all() and (shard.document(k, 5, 900) == d[5:900]).all() for k, d in enumerate(documents))


def test_fingerprints(spark, docs, empty):
    from lattix.llm.fingerprints import add, fingerprint, fingerprint_edits, remove
    from pyspark.sql import functions as F

    rows = sorted(((i, t or "") for i, t in sample_texts()), key=lambda r: (-1 if r[0] is None else r[0]))
    got = fingerprint_edits(docs).collect()
    assert len(got) == len(rows)
    by_text: dict[str, set[str]] = {}
    unique = [k for k, (i, _) in enumerate(rows) if sum(j == i for j, _ in rows) == 1 and rows[(k + 1) % len(rows)][0] is not None and sum(j == rows[(k + 1) % len(rows)][0] for j, _ in rows) == 1]
    found = {r.doc_id: r for r in got}
    for k in unique:
        (i, t), (_, following) = rows[k], rows[(k + 1) % len(rows)]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        by_text.setdefault(t, set()).add(r.fingerprint)
        by_text.setdefault(changed, set()).add(r.edited_fingerprint)
        if changed == t:
            assert r.near_edited == 1
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in by_text.values()) and len({min(x) for x in by_text.values()}) == len(by_text)
    assert fingerprint_edits(empty).count() == 0
    one = spark.createDataFrame([("a.\nb b.\nc\n", "c\na.\nb b.\n", "a.\n", "c\nb b.\n")], "x string, y string, p string, rest string")
    f = {c: fingerprint(F.col(c)) for c in one.columns}
    assert one.select(f["x"] == f["y"], add(f["p"], f["rest"]) == f["x"], remove(f["x"], f["p"]) == f["rest"], f["p"] == f["rest"]).first()[:] == (True, True, True, False)


def test_likeness_of_lines_that_stand_often(spark):
    from lattix.llm.fingerprints import add, fingerprint, likeness, signed_lanes
    from pyspark.sql import functions as F

    rows = [("always this\n" * n + f"line {n}\n" * (n // 4), "always this\n" * (n // 2) + f"line {n}\n" * (n // 4)) for n in (8, 256, 1000, 40_000)]
    df = spark.createDataFrame(rows, "a string, b string")
    f = {c: fingerprint(F.col(c)) for c in "ab"}
    got = df.select(F.char_length("a").alias("size"), likeness(F.lit(False), *(signed_lanes(f[c]) for c in "ab")).alias("near"), (add(f["a"], f["b"]) == fingerprint(F.concat("a", "b"))).alias("sums")).collect()
    # two lines in different counts: (4, 1) and (2, 1)
    assert len(got) == 4 and all(abs(r.near - 9 / 85**0.5) < 1e-9 and r.sums for r in got), got


def test_fingerprints_over_many_buckets(spark, monkeypatch):
    from lattix.llm import fingerprints

    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    monkeypatch.setattr(fingerprints, "MOST_QUANTILES", 5)
    ids = sorted(random.Random(4).sample(range(10_000), 150))
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(6)
    rows = df.withColumn("tie", F.xxhash64("text"))
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(rows, "doc_id", "tie", ["text"]).collect()}
    assert got == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}
    # a third of all rows share an id: one round through all rows, in the order of ids
    shared = df.unionByName(spark.createDataFrame([(ids[70], f"s{k}") for k in range(75)], df.schema)).repartition(6).withColumn("tie", F.xxhash64("text"))
    after = {r.text: (r.doc_id, r.next_text) for r in fingerprints.with_next(shared, "doc_id", "tie", ["text"]).collect()}
    assert len(after) == 225
    at, seen = f"t{ids[0]}", []
    for _ in range(225):
        seen.append(after[at][0])
        at = after[at][1]
    assert at == f"t{ids[0]}" and seen == sorted(seen) and seen.count(ids[70]) == 76


def test_fingerprints_are_multiset_sums(spark):
    """Against sums in Python, over texts of few different paragraphs in many counts; likeness against the cosine of the true counts."""
    from collections import Counter

    import xxhash
    from lattix.llm.fingerprints import COUNTS, STRONG, fingerprint, likeness, signed_lanes

    r = random.Random(9)
    pool = [f"{w}{end}" for w, end in zip(words(40, 77), [".", "!", "\n", "?", ".\n"] * 8)]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 300))) for _ in range(30)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string").withColumn("fp", fingerprint(F.col("text")))
    made = {x.k: list(x.fp) for x in df.collect()}
    long = lambda x: x - (1 << 64) if x >> 63 else x

    def hashed(p, seed=42):
        return xxhash.xxh64_intdigest(p.encode(), seed)

    counts = []
    for k, t in enumerate(texts):
        parts = Counter(x for x in re.split(r"(?<=[\n.!?])(?=[^\n.!?])", t) if x)
        counts.append(parts)
        lanes, strong = [0] * COUNTS, [0] * STRONG
        for p, n in parts.items():
            h = hashed(p)
            lanes[(h >> 1 & 15) * 7 + (h >> 5) % 7] += n * (1 - 2 * (h & 1))
            for seed in range(STRONG):
                strong[seed] = (strong[seed] + n * hashed(p, xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42))) % (1 << 48)
        assert made[k][:COUNTS] == lanes and [x % (1 << 48) for x in made[k][COUNTS:]] == strong, k
    near = df.alias("a").join(df.alias("b"), F.col("a.k") < F.col("b.k")).select(F.col("a.k").alias("i"), F.col("b.k").alias("j"), likeness(F.lit(False), signed_lanes(F.col("a.fp")), signed_lanes(F.col("b.fp"))).alias("near")).collect()
    norm = lambda c: sum(v * v for v in c.values()) ** 0.5
    off = [abs(x.near - sum(n * counts[x.j][p] for p, n in counts[x.i].items()) / (norm(counts[x.i]) * norm(counts[x.j]) or 1)) for x in near]
    assert sum(off) / len(off) < 0.15


def test_licenses(docs, empty, spark):
    from lattix.llm.licenses import BASE_PHRASES, evaluate, postfix, scan_licenses

    got = sorted((tuple(r)[:6] for r in scan_licenses(docs).collect()), key=str)
    want = []
    for i, t in sample_texts():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        at = [(k, label) for p, label in BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want.append((i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert got == sorted(want, key=str)
    assert scan_licenses(empty).count() == 0
    assert postfix("MIT OR (Apache-2.0 AND BSD-3-Clause) WITH x") == ["mit", "apache-2.0", "bsd-3-clause", "and", "x", "with", "or"]
    assert evaluate(postfix("GPL-2.0 OR MIT")) == ({"gpl-2.0", "mit"}, True)
    assert evaluate(postfix("GPL-2.0 AND MIT")) == ({"gpl-2.0", "mit"}, False)
    assert postfix("AND MIT") is None and postfix("(MIT") is None and postfix("") is None
    tagged = spark.createDataFrame([(1, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only)\ncode"), (2, "SPDX-License-Identifier: AND")], "doc_id long, text string")
    rows = {r.doc_id: r for r in scan_licenses(tagged).collect()}
    assert (rows[1].labels, rows[1].score, rows[1].permitted) == ("gpl-2.0-only,mit", 1.0, True)
    assert (rows[2].labels, rows[2].score, rows[2].permitted) == ("", 0.0, None)


def test_notices_are_expressions(spark):
    from lattix.llm.licenses import scan_licenses

    cases = [
        ("MIT License", True),
        ("GNU General Public License", False),
        ("under the GNU General Public License, Version 2, or at your option the MIT License", True),
        ("the GNU General Public License and the MIT License", False),
        ("MIT license. Some words, or others, then the GNU General Public License", False),
        ("MIT License or GNU General Public License and Apache License", True),
        ("GNU General Public License or Mozilla Public License", False),
        ("Released into the public domain or the Mozilla Public License", True),
        ("MIT License; BSD License", True),
        ("MIT License. SPDX-License-Identifier: GPL-2.0-only", False),
        ("or and with", None),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert [r.permitted for r in scan_licenses(df).orderBy("doc_id").collect()] == [x for _, x in cases]
    import duckdb
    from lattix.llm.queries import _op5_sql

    con = duckdb.connect()
    plain = [(k, t) for k, (t, _) in enumerate(cases) if "SPDX" not in t]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", plain)
    got = dict(con.execute(f"SELECT doc_id, permitted FROM ({_op5_sql()})").fetchall())
    assert got == {k: cases[k][1] for k, _ in plain}


def test_url_filter(spark):
    from lattix.llm.url_filter import judge_urls

    urls = {
        "https://WWW.Example.com/en/714?x": ("www.example.com", "/en/714", "example.com/en/7", "allow"),
        "http://a.com/en/1": ("a.com", "/en/1", "com/en/", "block"),
        "http://a.com/EN/1": ("a.com", "/EN/1", None, "allow"),
        "http://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://telecom/en/": ("telecom", "/en/", None, "allow"),
        "http://b.net/de/8": ("b.net", "/de/8", "net/de/", "allow"),
        "http://x.example.net/de/8#y": ("x.example.net", "/de/8", "example.net/de/8", "block"),
        "http://spam-farm.example.org/es/1": ("spam-farm.example.org", "/es/1", "org/es/", "block"),
        "http://spam-farm.example.org/fr/1": ("spam-farm.example.org", "/fr/1", None, "block"),
        "spam.example.org": ("", "", None, "allow"),
        "http://www.Cheap-Pills.example.org/": ("www.cheap-pills.example.org", "/", None, "block"),
        "http://cheap-pills2.example.org/": ("cheap-pills2.example.org", "/", None, "allow"),
        "http://h.org/a/cgi-bin/x": ("h.org", "/a/cgi-bin/x", None, "block"),
        "http://h.org/wp-login.php?a": ("h.org", "/wp-login.php", None, "block"),
        "http://h.org/wp-login.phpx": ("h.org", "/wp-login.phpx", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)] * 2, "page_id long, url string, host string, rule string")
    got = judge_urls(df).selectExpr("page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(k, *v) for k, v in enumerate(urls.values())] * 2, key=str)
    assert judge_urls(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        judge_urls(df.withColumnRenamed("rule", "_url"))


def test_a_host_rule_without_a_slash_ends_with_the_host(spark):
    from lattix.llm.url_filter import host_rule, judge_urls

    urls = ["http://example.com/x", "http://a.example.com", "http://example.com?q", "http://example.com.evil.org/x", "http://example.community/", "http://notexample.com/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r._url.verdict for r in judge_urls(df, rules=[host_rule("block", "example.com")]).collect()]
    assert got == ["block"] * 3 + ["allow"] * 3


def test_training_takes_no_more_texts_than_asked_for(spark, monkeypatch):
    from lattix.llm import toxicity

    rows = [(7, f"text number {k}", k % 2) for k in range(50)] + [(8, "the same", 1)] * 40 + [(k, f"other {k}", k % 2) for k in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    kept = []
    monkeypatch.setattr(toxicity, "_train_on_sample", lambda sample, *_: kept.append(sorted((r.text, r.label) for r in sample.collect())))
    labels = spark.createDataFrame([(7, 1), (8, 1), *((k, k % 2) for k in range(100, 130))], "doc_id long, toxic int")
    for most in (10, 1000):
        toxicity.train(df, max_rows=most)
        toxicity.train_on(df.drop("label"), labels, max_rows=most)
    assert [len(x) for x in kept[:2]] == [10, 10] and kept[2] == sorted((t, x) for _, t, x in rows)
    assert [x for x, _ in kept[3]] == sorted(t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5)


def test_url_rules_are_found_by_their_tokens(spark):
    """Every rule of a large set, in any case of letters, against all URLs without an index."""
    from lattix.llm.url_filter import glob_rule, host_rule, judge_urls, split_url

    r = random.Random(8)
    part = lambda: r.choice(["en", "eNx", "De", "x1", "a-b", "q"])
    rules = [host_rule("block", f"{r.choice('abc')}.com/{part()}/{part()}"[: r.randint(6, 14)]) for _ in range(150)]
    rules += [glob_rule("block", r.choice([f"{r.choice('abc')}.*/{part()}", f"*/{part()}*{part()}/*", f"*.com/*{part()}"])) for _ in range(150)]
    urls = [f"http://{r.choice(['', 'w.', 'x1.'])}{r.choice('abcd')}.com/" + "/".join(part() for _ in range(r.randint(0, 4))) for _ in range(400)]
    want = []
    for u in urls:
        host, path = split_url(u)
        fit = [(x.base, len(x.name), x.name) for x in rules if re.match(x.regex, host + path)]
        want.append(max(fit)[2] if fit else None)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = judge_urls(df, rules=rules).selectExpr("page_id", "_url.pattern").collect()
    assert [p for _, p in sorted((x.page_id, x.pattern) for x in got)] == want and sum(w is not None for w in want) > 100


def test_warc_audit_finds_what_was_changed(spark):
    from lattix.llm.warc import archive, audit, build_tree

    rows = [(k, f"http://h/{k}", "body %d " % k * (k % 5)) for k in range(300)] + [(None, None, None), (5, None, ""), (5, None, "")]
    good = spark.createDataFrame(rows, "page_id long, url string, html string")
    bad = spark.createDataFrame([(i, u, "BODY" + h[4:] if i in (7, 131, 299) and h else h) for i, u, h in rows], good.schema)
    a, b = (build_tree(archive(x, file_records=64)) for x in (good, bad))
    assert audit(a, a).count() == 0
    got = audit(a, b).collect()
    assert sorted(r.page_id for r in got) == [7, 131, 299]
    assert all(r.digest_a != r.digest_b and r.stop > r.start for r in got)
    lost = build_tree(archive(good.where("page_id is null or page_id <> 299"), file_records=64))
    assert [(r.page_id, r.digest_b) for r in audit(a, lost).collect()] == [(299, None)]
    nothing = build_tree(archive(good.limit(0)))
    assert audit(nothing, nothing).count() == 0
    assert audit(a, nothing).count() == len(rows)


def test_toxicity_learns_and_leaves_clean_texts(spark):
    from lattix.llm.toxicity import score_texts, train

    r = random.Random(2)
    rows = []
    for k in range(400):
        w, bad = words(r.randint(20, 90), k), k % 4 == 0
        for _ in range(3 * bad):
            w[r.randrange(len(w))] = r.choice(["nastyword", "vileterm"])
        rows.append((k, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = train(df.where("doc_id < 300"))
    got = score_texts(df.where("doc_id >= 300"), model).collect()
    assert sum((x._toxicity >= 0.5) == x.label for x in got) >= 97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "ab"), (4, "é" * 5000)], "doc_id long, text string")
    assert all(0 <= x._toxicity <= 1 for x in score_texts(odd, model).collect())
    one = train(df.where("label = 0"))
    assert all(x._toxicity < 0.1 for x in score_texts(odd, one).collect())
    assert score_texts(odd, train(df.limit(0))).count() == 4
