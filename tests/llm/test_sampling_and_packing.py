"""Importance resampling, the conversation trie and packing against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def drawn(rows, target, percent):
    def count(texts):
        n = [0] * 10000
        for t in texts:
            for x in grams(t)[1]:
                n[zlib.crc32(x.encode()) % 10000] += 1
        return n

    s, t = count(x for _, x in rows), count(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        w, f = grams(text)
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], 2**63 if r[0] is None else r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("most", [1 << 17, 7])
def test_resample_equals_brute_force_with_ties_and_repeated_rows(spark, monkeypatch, most):
    """With ranges of 7 rows: scores, ids and equal rows that outgrow a range."""
    from lattix.llm import resampling

    monkeypatch.setattr(resampling, "MOST_RANGE", most)
    r = random.Random(5)
    letters = "abcdeé"
    text = lambda n: " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(k, text(r.choice([3, 19, 20, 40, 90]))) for k in range(200)]
    rows += rows[:40] * 3 + [(5, rows[3][1])] * 60 + [(None, rows[3][1])] * 40
    rows += [(None, None), (1, ""), (2, "é A" * 200), *[(9, "x" * 200 + " " + "Yy" * 90 + " z")] * 3, (900, text(20_000))]
    target = [text(30) for _ in range(20)] + [None]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, score string").repartition(5)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, aims, 60)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == drawn(rows, target, 60)
    assert resampling.resample(df.limit(0), aims.limit(0)).collect() == []


def test_word_checksums_of_every_length():
    from lattix.llm.resampling import features

    words = ["ab" * n + "é" * (n % 3) for n in range(1, 80)] + ["a"]
    raw = " ".join(words).encode()
    bucket, row, n = features(np.frombuffer(raw, np.uint8), np.array([0, 0, len(raw)]), 0, 2)
    assert n.tolist() == [0, len(words)] and set(row.tolist()) == {1}
    assert bucket.tolist() == [zlib.crc32(x.encode()) % 10000 for x in grams(" ".join(words))[1]]


def test_tournament_stops_after_the_draw():
    from lattix.llm.resampling import tournament

    r = random.Random(2)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted((r.randrange(9), r.randrange(3)) for _ in range(r.randrange(12))) for _ in range(k)]
        want = sorted((x, run, place) for run, some in enumerate(runs) for place, x in enumerate(some))
        for n in {0, 1, len(want) // 2, len(want)} & set(range(len(want) + 1)):
            assert tournament(runs, n) == [(run, place) for _, run, place in want[:n]]


def trie(rows):
    conv = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            conv[c].append((t is not None, t or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    conv = {c: [x[3:] for x in sorted(v)] for c, v in conv.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c in sorted(conv):
        h = zlib.crc32(str(c).encode()) % 9
        t = tuple(conv.get(c - c % 5, [])[:h] + conv[c][h:])
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
        ends[t].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted(((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p in members), key=str)


def conversation_rows():
    r, rows = random.Random(3), []
    for c in range(120):
        turns = [("u", "hello"), ("a", "hi é")] + [("u", f"w{k}") for k in range(20)]
        turns = turns[: r.choice([3, 10, 22])] + [("a", f"x{r.randrange(3)}") for _ in range(r.randrange(12))]
        rows += [(c, None if k == 0 and c % 2 else k, role if k % 5 else None, x) for k, (role, x) in enumerate(turns)]
    rows += [(None, 1, "a", "b"), (3000, 5, None, None), (3000, 5, None, None), (3001, 1, "z", "z" * 100_000), (-3, 1, "a", "b"), (-7, 1, "a", "b")]
    rows += [(4000 + k, j, "u", f"same{j}") for k in range(60) for j in range(9)] + [(7777, k, "u", f"long{k % 7}") for k in range(300)]
    return rows


@pytest.mark.parametrize("least", [3, 1024])
def test_prefix_trie_equals_brute_force(spark, monkeypatch, least):
    """With parts of few turns nearly everything is dealt out by its next turn; with 1,024 the root alone is."""
    from lattix.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "LEAST", least)
    monkeypatch.setattr(prefix_trie, "TURNS", 40)
    rows = [r for r in conversation_rows() if (r[0] or 0) >= 0]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, path string").repartition(5)
    conv = F.col("conv_id")
    made = prefix_trie.graft(prefix_trie.turns_of(df), conv - conv % 5, F.crc32(conv.cast("string")) % 9)
    assert sorted(map(tuple, prefix_trie.prefix_trie(made).collect()), key=str) == trie(rows)
    assert prefix_trie.prefix_trie(prefix_trie.turns_of(df.limit(0))).collect() == []


def test_best_fit_decreasing_places_as_one_by_one():
    from lattix.llm.packing import best_fit_decreasing

    r = random.Random(1)
    for t in range(200):
        room = r.choice([5, 10, 16, 33, 100])
        lengths = [r.choice([1, 2, 3, room // 3 + 1]) if t % 3 == 0 else r.randint(1, room) for _ in range(r.randrange(150))]
        rooms: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [(left, k) for k, left in enumerate(rooms) if left >= n]
            if not fits:
                rooms.append(room)
            rooms[min(fits)[1] if fits else -1] -= n
        plan, seen = best_fit_decreasing(Counter(lengths), room), Counter()
        ranks = []
        for n in lengths:
            ranks.append(seen[n])
            seen[n] += 1
        held = defaultdict(list)
        for n, s, o in zip(lengths, *(x.tolist() for x in plan.places(np.array(lengths, np.int64), np.array(ranks, np.int64))), strict=True):
            held[s].append((o, n))
        left = []
        for k in range(plan.sequences):
            at = 0
            for o, n in sorted(held[k]):
                assert o == at
                at += n
            left.append(room - at)
        assert sorted(left) == sorted(rooms)


def test_packed_documents_hold_all_ids_without_gaps(spark):
    import public_tokenizers
    from lattix.llm.packing import pack_documents
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    r = random.Random(4)
    texts = [" ".join(r.choice(["the", "quick", "éa", "12", "<|endoftext|>"]) for _ in range(r.choice([0, 1, 5, 30, 31, 32, 200]))) for _ in range(150)] + [None, "", "word " * 5000]
    rows = [*enumerate(texts), (3, "twice"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length long").repartition(4)
    got = pack_documents(df, path, room=32).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        head = (len(ids) - 1) % 32 + 1
        for piece, (a, b) in enumerate(zip([0, *range(head, len(ids), 32)], range(head, len(ids) + 1, 32))):
            want[i, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    held = defaultdict(list)
    for x in got:
        held[x.sequence_id].append((x.offset, x.length))
    for some in held.values():
        assert sorted(o for o, _ in some) == [0, *np.cumsum([n for _, n in sorted(some)])[:-1].tolist()]
        assert sum(n for _, n in some) <= 32
    total = sum(x.length for x in got)
    assert -(-total // 32) <= len(held) <= -(-total // 32) + 3
    assert pack_documents(df.limit(0), path).collect() == []
