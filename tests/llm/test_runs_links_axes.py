"""Periodic runs, SimHash links and whitening against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vitalframe.llm import covering, periodic, whitening
from vitalframe.llm.registry import registry

REGISTRY = registry()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def save(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


# --- periodic runs -------------------------------------------------------------------------------


def plain_runs(w):
    """(start, length, period) by trying every period at every place."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(6, 4 * q) and not any(w[s : s + n - d] == w[s + d : s + n] for d in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (
        len(runs),
        *(best or (None,) * 3),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest(),
    )


def run_rows(df):
    return sorted(
        ((r.doc_id, (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)) for r in df.collect()),
        key=repr,
    )


def test_runs_equal_brute_force_on_the_table(spark, sf):
    got = run_rows(REGISTRY["op11_runs"][0](spark, sf))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 6000]
    assert len(rows) > 150 and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10
    want = sorted(((i, plain_digest(i, t)) for i, t in rows), key=repr)
    ids = {i for i, _ in rows}
    assert [r for r in got if r[0] in ids] == want
    assert any(r[1][0] for r in got)


def test_runs_equal_brute_force_on_small_alphabets(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        k = rng.choice([1, 2, 3, 6])
        w = [rng.choice("ab cd ef gh ij kl".split()[:k]) for _ in range(rng.randint(0, 70))]
        if w and rng.random() < 0.7:
            a = rng.randrange(len(w))
            p = 1 + (len(w) - a) // rng.randint(3, 12)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))] + [rng.choice("ab cd".split()) for _ in range(rng.randint(0, 9))]
        rows.append((i, rng.choice([" ", "  ", "\t", "\n"]).join(w)))
    folder = save(spark, tmp_path, documents=documents(spark, rows))
    assert run_rows(REGISTRY["op11_runs"][0](spark, folder)) == sorted(((i, plain_digest(i, t)) for i, t in rows), key=repr)


def test_runs_on_odd_tables(spark, tmp_path):
    long = " ".join(["x"] * 300_000 + ["y", "z"] * 50_000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a a a a a a"), (4, "ö ö ö ö ö ö"), (5, "a a a a a"), (5, "a b a b a b a b"), (5, "a b a b a b a b"), (3, "   ")]
    got = run_rows(REGISTRY["op11_runs"][0](spark, save(spark, tmp_path, documents=documents(spark, rows))))
    assert got == sorted(((i, plain_digest(i, t)) for i, t in rows), key=repr)
    clash = documents(spark, [(None, long)]).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit(2)).withColumn("start", F.lit(3))
    (one,) = periodic.periodic_runs(clash).collect()
    assert [tuple(r) for r in one.runs] == [(0, 300_000, 1), (300_000, 100_000, 2)]
    assert one.collapsed == "x y z" and one.start == 3
    assert periodic.periodic_runs(documents(spark, [])).count() == 0


def test_furthest_place_spares_extensions():
    codes = np.zeros(5000, np.int64)
    start, length, period = periodic.runs_of(codes, np.array([0, 2000, 5000]))
    assert list(zip(start, length, period)) == [(0, 2000, 1), (2000, 3000, 1)]


# --- SimHash -------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(rows, radius=3):
    prints = {}
    for i, t in rows:
        prints.setdefault(plain_fingerprint(t), []).append(i)
    kinds, parent = list(prints), {p: p for p in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(kinds):
        for b in kinds[:n]:
            if (a ^ b).bit_count() <= radius:
                parent[top(a)] = top(b)
    least = {}
    for p, ids in prints.items():
        for i in ids:
            if i is not None:
                least[top(p)] = min(i, least.get(top(p), i))
    return sorted(((i, f"{p:016x}", least.get(top(p))) for p, ids in prints.items() for i in ids), key=repr)


def link_rows(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_links_equal_brute_force_on_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = link_rows(REGISTRY["op12_simhash"][0](spark, sf))
    assert got == plain_components(rows)
    assert any(i != c for i, _, c in got)


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(2)
    tables = covering.covering_masks(0)
    assert len(tables) == 15
    for _ in range(3000):
        x = sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3)))
        assert any(not x & m for m in tables)
    # a bucket of the last round leaves few bits open, and every pair of it is covered too
    last = [m for _, _, m in covering.mask_tree(3, 3)[2]]
    assert max(64 - m.bit_count() for m in last) <= 8
    paths = {path: mask for rows in covering.mask_tree(3, 3) for _, path, mask in rows}
    assert all(mask & paths[path >> 4] == paths[path >> 4] for path, mask in paths.items() if path >> 4)


@pytest.mark.parametrize("paired", [2, 8, 48])
def test_crowded_buckets_lose_no_pair(spark, paired):
    rng = random.Random(paired)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(60)}
    # a family that shares all but seven bits crowds every round
    values |= {base[0] ^ x for x in range(128)} | {rng.getrandbits(64) for _ in range(100)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    got = {(r.u, r.v) for r in covering.close_pairs(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), paired=paired).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for n, b in enumerate(signed) for a in signed[:n] if ((a ^ b) & mask).bit_count() <= 3}
    assert got == want


def test_links_on_odd_tables(spark, tmp_path):
    same = "Der gleiche Text steht hier noch einmal und noch einmal"
    rows = [(5, None), (3, ""), (9, "  \n"), (None, "word"), (None, "WORD"), (7, same), (7, same), (None, same.upper()), (8, same), (2, "éé ÉÉ"), (1, "x " * 200_000)]
    docs = documents(spark, rows).withColumn("component_id", F.lit(1)).withColumn("fingerprint", F.lit("x"))
    got = link_rows(REGISTRY["op12_simhash"][0](spark, save(spark, tmp_path, documents=docs)))
    assert got == plain_components(rows)
    assert covering.near_fingerprints(documents(spark, [])).count() == 0


# --- whitening -----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_whitening(rows):
    """Exact sums in integers, then a dense eigendecomposition."""
    x = {i: tuple(math.floor(64 * c) + 1_000_000 for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, dim = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(dim)]
    centred = np.array([[n * v[k] - sums[k] for k in range(dim)] for v in fit], float) / n
    cov = centred.T @ centred / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    out = {}
    for i, v in x.items():
        d = np.array([n * v[k] - sums[k] for k in range(dim)], float) / n
        out[i] = (sum((n * v[k] - sums[k]) ** 2 for k in range(dim)), d @ q[:, :16] / np.sqrt(e[:16]))
    return n, out, e[:16] / e.sum()


def test_whitening_equals_dense_eigenvectors(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, want, explained = plain_whitening(rows)
    got = REGISTRY["op13_whitening"][0](spark, sf).collect()
    assert len(got) == 16 * len(rows)
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        z = want[r.vec_id][1][r.component - 1]
        assert signs.setdefault(r.component, math.copysign(1, z * r.whitened)) * r.whitened == pytest.approx(z, abs=1e-9)
        assert r.n == n and r.deviation == want[r.vec_id][0]
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-10) and r.identity_error < 1e-10


@pytest.mark.parametrize("dim, rank", [(5, 5), (64, 64), (200, 200), (64, 10)])
def test_pairs_equal_dense_eigenpairs(dim, rank):
    rng = np.random.default_rng(dim + rank)
    x = rng.standard_normal((900, rank)) @ rng.standard_normal((rank, dim))
    a = x.T @ x / len(x)
    values, axes = whitening.leading_pairs(lambda v: a @ v, dim, 16)
    e = np.linalg.eigvalsh(a)[::-1]
    assert np.allclose(values, e[: len(values)], atol=1e-12 * e[0], rtol=0)
    assert np.linalg.norm(a @ axes - axes * values, axis=0).max() < 1e-13 * e[0]
    assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-13)


def test_whitening_on_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), float(i * i % 5), 0.5]) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 0.0, 0.0]), (104, [inf, 0.0, 0.0]), (105, [1.0]), (None, [1.0, 1.0, 0.5]), (3, [3.0, 4.0, 0.5])]
    df = spark.createDataFrame([(i, v, 0) for i, v in good + odd], VECTORS).withColumn("n", F.lit(1)).withColumn("component", F.lit(2))
    got = whitening.whiten(df).collect()
    n, want, _ = plain_whitening([(i, v[:2]) for i, v in good])
    # the third dimension is constant: two components; 42 rows remain
    assert len(got) == 2 * 42 and {r.component for r in got} == {1, 2} and got[0].n == n
    assert all(r.deviation == want[r.vec_id][0] for r in got if r.vec_id is not None and r.vec_id < 40)
    assert {r.vec_id for r in got} == {*range(40), None} and max(r.identity_error for r in got) < 1e-12
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 1")).count() == 0
    far = spark.createDataFrame([(1, [1e38, 0.0], 0), (2, [-1e38, 1.0], 0), (3, [0.0, 5.0], 0)], VECTORS)
    rows = whitening.whiten(far).collect()
    assert {r.vec_id for r in rows} == {1, 2, 3} and all(r.deviation is None for r in rows if r.vec_id < 3)
