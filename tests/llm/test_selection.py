"""Fill-in-the-middle, exact top products and importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factweave.llm import fim, norm_buckets, registry, resample

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"
ODD = [
    (1, None, "en"), (2, "", None), (3, "  \n\n\t ", "en"), (4, "naïve café 东京 ǅ ſ  x  y z it's 12½ Straße", "fr"), (5, "a <P> mark", "en"), (6, "word " * 9000, "en"), (7, "x" * 70 + " " + "é" * 5000, "de"),
    (8, "one two", "de"), (8, "ONE\ttwo", "de"), (9, "same words here again and again " * 9, "en"), (9, "same words here again and again " * 9, "en"), (None, "no id but words enough to be drawn " * 7, "de"), (10, "\x0b<\r\n>S>", "en"),
]


@pytest.fixture(scope="module")
def tables(spark):
    odd = spark.createDataFrame(ODD, SCHEMA).withColumns({n: F.lit("x") for n in ("n", "form", "output", "score", "rank", "part", "falls", "size", "drawable")})
    rng = random.Random(3)
    drawn = [(i, "".join(rng.choices(["a", "Zz", "é", "东", " ", "\n", "9", "<S", ">", "-"], k=rng.randint(0, 90))), "en") for i in range(300)]
    return {"odd": odd, "drawn": spark.createDataFrame(drawn, SCHEMA), "documents": spark.read.parquet(f"{DATA}/documents.parquet"), "empty": spark.createDataFrame([], SCHEMA)}


def key(row):
    return [(x is not None, str(x)) for x in row]


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def cut_by_hand(doc_id, text):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest, n = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest(), len(units)
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("source", ["odd", "drawn", "documents", "empty"])
def test_texts_are_cut_as_by_hand_and_come_back(tables, source):
    docs = tables[source]
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    made = fim.fill_in_middle(docs)
    same(made.collect(), [cut_by_hand(*r) for r in rows])
    same(made.select("doc_id", fim.restored(F.col("output"), F.col("form"))).collect(), rows)


def test_blocks_of_any_size_give_the_same_cuts():
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choices(["ab", "é", "东京", " ", "\n\n", "\t"], k=rng.randint(0, 60)))
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        for block in (1, 2, 3, 7, 64):
            layout = fim.Layout(np.frombuffer(text.encode(), np.uint8), block)
            assert layout.units == len(units)
            for k in range(len(units) + 1):
                head = "".join(units[:k])
                assert layout.cut(k) == (len(head.encode()), len(head))


def best_by_hand(rows, every, k, scale=1024):
    whole = {(i, tuple(math.floor(x * scale) for x in e)) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    asked = {}
    for i, e in sorted(whole, key=lambda r: (r[0], len(r[1]), r[1])):
        if i % every == 0:
            asked.setdefault(i, e)
    out = []
    for q, e in asked.items():
        best = {}
        for i, v in whole:
            if i != q and len(v) == len(e):
                best[i] = max(best.get(i, -(2**63)), min(max(sum(a * b for a, b in zip(e, v, strict=True)), -(2**63)), 2**63 - 1))
        out += [(q, rank, i, s) for rank, (s, i) in enumerate(sorted(((s, i) for i, s in best.items()), key=lambda p: (-p[0], p[1]))[:k], 1)]
    return out


def vectors_of(kind):
    rng = np.random.default_rng(11)
    if kind == "uneven":
        made = rng.normal(size=(900, 8)) * rng.lognormal(0, 1.5, 900)[:, None]
    elif kind == "clusters":
        made = rng.normal(size=(12, 8))[rng.integers(0, 12, 900)] + 0.05 * rng.normal(size=(900, 8))
        made[:300] = made[0]
    else:
        made = np.round(rng.normal(size=(900, 8)))
    return [(int(i), [float(x) for x in v]) for i, v in enumerate(made)]


@pytest.mark.parametrize("kind", ["uneven", "clusters", "ties"])
@pytest.mark.parametrize(("cell_values", "first"), [(norm_buckets.CELL_VALUES, norm_buckets.FIRST), (800, 50)])
def test_top_products_are_exact(spark, kind, cell_values, first):
    rows = vectors_of(kind)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(norm_buckets.top_products(df, 20, 10, cell_values=cell_values, first=first).collect(), best_by_hand(rows, 20, 10))


def test_coordinates_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    vectors = np.floor(1024 * (rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)] + 0.1 * rng.normal(size=(3000, 16)))).astype(np.int64)
    cell = norm_buckets.Cell(np.arange(3000), vectors)
    fewest = 3000
    for q in range(0, 3000, 200):
        direction = vectors[q] / np.linalg.norm(vectors[q])
        cosines = cell.directions @ direction
        for least in (-0.2, 0.5, 0.8, 0.95, 1.0):
            rows = cell.near(direction, least)
            assert set(np.flatnonzero(cosines >= least)) <= set(rows)
            fewest = min(fewest, len(rows))
    assert fewest < 300
    exact = norm_buckets.search(cell, np.arange(0, 3000, 50), vectors[::50], np.full(60, -np.inf), 10, size=100)
    plain = norm_buckets.search(cell, np.arange(0, 3000, 50), vectors[::50], np.full(60, -np.inf), 10, size=100, steep=2.0)
    assert all((getattr(exact, n) == getattr(plain, n)).all() for n in ("query", "id", "score"))


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [
        (0, [1.0, 2.0]), (0, [3.0, -1.0]), (1, [0.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, [1e9, -1e9]), (8, [1.0]), (20, [2.0]), (40, []), (41, []), (60, [4e15, 3e15]),
        (9, [-5.0, 0.3]), (9, [-5.0, 0.3]), (10, [0.1, 0.1]), (80, [0.0, 0.0]), (11, [4e15, 4e15]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({n: F.lit("x") for n in ("size", "norm", "bucket", "cell", "vector", "top", "block")})
    same(norm_buckets.top_products(df, 20, 3).collect(), best_by_hand(rows, 20, 3))
    assert norm_buckets.top_products(df.limit(0), 20, 3).count() == 0
    float32 = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = best_by_hand([(r[0], r[1]) for r in float32.select("vec_id", "embedding").collect()], 100, 10)
    same(registry.op12_norm_buckets(spark, DATA).collect(), want)


def runs_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def test_hashes_of_runs_are_crc32():
    texts = [t for _, t, _ in ODD if t is not None] + ["a" * 200 + " b " + "c" * 65 + "\n" + "d" * 64, "end", "Start", "", "ü" * 3000 + " ü"]
    array = pa.concat_arrays([pa.array(["left out"]), pa.array(texts)])[1:]
    crcs, of = resample.features(array)
    want = Counter((i, zlib.crc32(f.encode())) for i, t in enumerate(texts) for f in runs_of(t)[1])
    assert Counter(zip(of.tolist(), crcs.tolist(), strict=True)) == want


def resampled_by_hand(docs, target):
    side = [Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in runs_of(t)[1]) for texts in ([t for _, t in docs], target)]
    s_all, t_all = (sum(c.values()) for c in side)
    gain = [math.floor(1000 * math.log((side[1][b] + 1) * (s_all + 10000) / ((side[0][b] + 1) * (t_all + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        words, found = runs_of(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20))
    drawable = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], 2**63 - 1 if r[0] is None else r[0]))
    k = 5 * len(drawable) // 100
    return [(*r[:4], n + 1 if n < k else None) for n, r in enumerate(drawable)] + [(*r[:4], None) for r in rows if not r[4]]


@pytest.mark.parametrize("source", ["odd", "documents", "empty"])
def test_resampling_is_that_by_hand(spark, tables, source):
    docs, benchmark = tables[source], spark.read.parquet(f"{DATA}/benchmark.parquet")
    if source == "odd":  # enough rows that some are drawn
        docs = docs.select("doc_id", "text").union(spark.range(300).selectExpr("id + 100", "repeat(concat('w', id % 7, ' and more '), 12)"))
    want = resampled_by_hand([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], [r["text"] for r in benchmark.collect()])
    same(resample.resample(docs, benchmark).collect(), want)
    assert source == "empty" or any(r[4] for r in want)


@pytest.mark.parametrize("pivots", [1, 3, 15])
def test_quickselect_finds_the_key_of_every_rank(spark, pivots):
    rows = [(i, 60, 0, score) for i, score in enumerate([5] * 40 + list(range(-30, 30)) + [7] * 3)] + [(1, 60, 0, 5)] * 4
    scored = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long")
    keyed = scored.withColumns({"falls": -F.col("score"), "place": F.col("doc_id")}).cache()
    order = sorted((-s, i, n) for i, n, _, s in rows)
    for k in (1, 2, 33, 50, 77, len(rows)):
        assert resample.kth_key(keyed, k, pivots) == order[k - 1]
    got = resample.draw(scored.withColumn("drawable", F.lit(True)), 38).collect()
    assert len(got) == len(rows) and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 39))
    assert [(-r["score"], r["doc_id"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [o[:2] for o in order[:38]]
