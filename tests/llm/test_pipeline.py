"""The corpus pipeline's stages against brute force, on documents with null and shared ids, repeated rows, and empty texts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

pipeline = pytest.importorskip("corpus_pipeline")

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in ("lang", "source")), T.StructField("n_chars", T.LongType()), T.StructField("_row", T.StringType())])


def words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdeghinorst") for _ in range(r.randint(2, 8))) for _ in range(n)]


def edited(w: list[str], n: int, seed: int) -> str:
    r, w = random.Random(seed), list(w)
    for _ in range(n):
        w[r.randrange(len(w))] = "edit%d" % r.randrange(10**6)
    return " ".join(w)


ITEMS = [(k, " ".join(words(30, 700 + k))) for k in range(4)] + [(None, " ".join(words(20, 710))), (9, None), (10, "")]


def rows() -> list[tuple]:
    r = random.Random(1)
    base, passage = words(140, 2), " ".join(words(60, 3))
    out: list[tuple[int | None, str | None]] = []
    for k in range(60):
        w = words(r.randint(20, 80), 100 + k)
        if k % 4 == 0:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["nastyword", "vileterm"])
        out.append((k, " ".join(w)))
    out += [(100 + k, edited(base, k % 5, k)) for k in range(8)] + [(None, " ".join(base)), (None, " ".join(base)), (104, " ".join(base))]
    out += [(None, edited(words(50, 5), k, k)) for k in range(2)]  # near copies without any id
    out += [(200 + k, f"{' '.join(words(40, 300 + k))} {passage} {' '.join(words(30, 400 + k))}") for k in range(3)]
    out += [(300, ITEMS[0][1]), (None, ITEMS[1][1]), (None, " ".join(words(40, 6)) + " " + ITEMS[2][1]), (301, " ".join(words(40, 7)))]
    out += [(301, " ".join(words(30, 8)) + " " + ITEMS[3][1])]  # a leaking row whose id a clean row shares
    out += [(400, None), (401, ""), (None, None), (None, "  "), (402, "one two"), (402, "one two"), (403, "é́ 漢字 " * 30)]
    made = [(i, t, "en", f"s{i or 0}", len(t) if t is not None else None, "x") for i, t in out]
    return made + [made[5], made[61]]


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    marks = [(k, k % 2, int(k % 4 == 0)) for k in range(60)] + [(None, 1, 1), (100, None, 0), (101, 0, None), (3, 0, 0), (999, 1, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(spark, home):
    return spark.read.parquet(f"{home}/documents.parquet")


def taken(df) -> list[str]:
    assert df.columns == DOCS.names
    return sorted(repr(tuple(r)) for r in df.collect())


def every(some) -> list[str]:
    return sorted(repr(tuple(r)) for r in some)


def near_kept(some: list[tuple]) -> list[tuple]:
    """Of rows (equal ones once) linked by five-word shingles at 0.8, the smallest id's; which of equal ids is left open."""
    some = list(dict.fromkeys(some))

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())

    sets, comp, changed = [shingles(x[1]) for x in some], list(range(len(some))), True
    while changed:
        changed = False
        for a in range(len(some)):
            for b in range(len(some)):
                if comp[b] < comp[a] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a], changed = comp[b], True
    groups: dict[int, list[tuple]] = {}
    for k, x in enumerate(some):
        groups.setdefault(comp[k], []).append(x)
    return [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()], groups


def test_near_duplicates(spark, docs, home):
    got = [tuple(r) for r in pipeline.near_duplicates(spark, docs, home).collect()]
    kept, groups = near_kept(rows())
    assert sorted((x[0] is None, x[0] or 0) for x in got) == sorted((x[0] is None, x[0] or 0) for x in kept)
    assert len(set(got)) == len(got) and all(sum(x in got for x in g) == 1 for g in groups.values())


def test_repeated_passages(spark, docs, home):
    texts = [(x[1] or "").encode() for x in rows()]
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    want = []
    for x, t in zip(rows(), texts, strict=True):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        left = bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore")
        want.append((x[0], left, *x[2:4], len(left), x[5]))
    assert taken(pipeline.repeated_passages(spark, docs, home)) == every(want)


def test_decontaminate(spark, docs, home):
    leaking = {t for _, t in ITEMS if t}
    assert taken(pipeline.decontaminate(spark, docs, home)) == every(x for x in rows() if not any(t in (x[1] or "") for t in leaking))


def grams(text: str | None) -> set[int]:
    """Hashes of 3 to 6 bytes, one by one."""
    raw, out = re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode()), set()
    for n in (3, 4, 5, 6):
        for k in range(len(raw) - n + 1):
            h = 0
            for b in raw[k : k + n]:
                h = (h * 0x01000193 + b) % (1 << 32)
            out.add((h * 0x9E3779B1) % (1 << 32) >> 14)
    return out


def test_toxicity(spark, docs, home):
    """The picked features are those of the highest spread and scaled by their log-count ratios; scores are sums over a text's grams; documents over one half go."""
    from lattix.llm import toxicity

    labels = spark.read.parquet(f"{home}/labels.parquet")
    sample = toxicity.training_rows(docs, labels)
    model = toxicity.train(sample)
    train = [(grams(r.text), r.label) for r in sample.collect()]
    assert len(train) > 30
    n = [sum(y == c for _, y in train) for c in (0, 1)]
    held = [Counter(g for s, y in train if y == c for g in s) for c in (0, 1)]
    p, q = ({g: (held[c][g] + 1) / (n[c] + 2) for g in held[0] | held[1]} for c in (1, 0))
    spread = {g: abs(p[g] - q[g]) / ((held[0][g] + held[1][g] + 1) / sum(n) * (1 / n[1] + 1 / n[0])) ** 0.5 for g in p}
    picked = np.flatnonzero(model.slot)
    assert len(picked) == 2048 and min(spread.get(int(g), 0) for g in picked) >= max(v for g, v in spread.items() if not model.slot[g]) - 1e-9
    x = np.array([[float(g in s) * np.log(p[g] / q[g]) if g in p else 0.0 for g in picked.tolist()] for s, _ in train])
    y = np.array([y for _, y in train])
    w = model.weight[model.slot[picked].astype(int) - 1] / np.array([np.log(p[g] / q[g]) if g in p and p[g] != q[g] else 1.0 for g in picked.tolist()])
    z = x @ w + model.bias
    slope = x.T @ (1 / (1 + np.exp(-z)) - y) / len(y) + 1e-3 * w
    assert np.abs(slope).max() < 0.02  # near the least loss
    scored = toxicity.score_texts(docs, model).collect()
    for r in scored:
        z = model.bias + sum(model.weight[model.slot[g] - 1] for g in grams(r.text) if model.slot[g])
        assert abs(r._toxicity - 1 / (1 + np.exp(-z))) < 1e-9
    left = [tuple(r)[:-1] for r in scored if r._toxicity < 0.5]
    assert taken(pipeline.toxicity(spark, docs, home)) == every(left)
    assert not any("nastyword" in (x[1] or "") or "vileterm" in (x[1] or "") for x in left) and len(left) > 60
    long = " ".join(words(90_000, 4))
    df = spark.createDataFrame([(1, long), (2, long + " nastyword"), (3, None)], "doc_id long, text string")
    for r in toxicity.score_texts(df, model).collect():
        z = model.bias + sum(model.weight[model.slot[g] - 1] for g in grams(r.text) if model.slot[g])
        assert abs(r._toxicity - 1 / (1 + np.exp(-z))) < 1e-9
    with pytest.raises(ValueError):
        toxicity.score_texts(df, model, out_col="text")


def test_run_is_its_stages_in_order(spark, docs, home):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontaminate", "bpe"]
    left = docs
    for name, stage in pipeline.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, home).collect(), DOCS)
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in left.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    there = set(shared.iterdir()) if shared.exists() else set()
    assert sorted((tuple(r) for r in pipeline.run(spark, home).collect()), key=str) == sorted(want, key=str)
    assert [p.name.split("-")[0] for p in set(shared.iterdir()) - there] == ["decontaminate"]


def test_empty_documents_go_through(spark, home, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{home}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    some = spark.read.parquet(f"{home}/documents.parquet").where(F.col("doc_id").isNull())
    for _, stage in pipeline.STAGES[:-1]:
        some = spark.createDataFrame(stage(spark, some, str(tmp_path)).collect(), DOCS)
    assert some.count() > 0
