"""Vector codes, near vectors and the prefix trie against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from docquarry.llm import pivot_index, prefix_trie, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int, code string, n int, data string, id long, ball long"


def vectors(spark, rows):
    """Vectors with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, label, "c", 1, "d", 9, 8) for i, v, label in rows], VECTORS)


# --- 11: codes ----------------------------------------------------------------------------------------------------------------------
def plain_codes(rows, p):
    """Codes in plain loops over Python integers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = {n: sum(len(v) == n for _, v, _ in kept) for n in {len(v) for _, v, _ in kept}}
    dim = max(sizes, key=lambda n: (sizes[n], n))
    kept = sorted(((i, v, label) for i, v, label in kept if len(v) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-dim // p.parts)

    def whole(x):
        from fractions import Fraction

        return math.floor(Fraction(x) * p.scale)

    cut = [[[whole(x) for x in (v + [0.0] * (width * p.parts - dim))[k * width : (k + 1) * width]] for k in range(p.parts)] for _, v, _ in kept]
    books = [[list(c[k]) for c in cut[: p.entries]] for k in range(p.parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda part, k: min(range(len(books[k])), key=lambda e: (far(part, books[k][e]), e))
    for _ in range(p.rounds):
        new = []
        for k in range(p.parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[k], k), []).append(c[k])
            new.append([[sum(col) // len(groups[e]) for col in zip(*groups[e])] if e in groups else b for e, b in enumerate(books[k])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, most = [], (1 << 63) - 1
    for (i, _, label), c in zip(kept, cut):
        at = [near(part, k) for k, part in enumerate(c)]
        out.append([i, "".join(f"{a:02x}" for a in at), min(sum(far(part, books[k][a]) for k, (part, a) in enumerate(zip(c, at))), most), label])
    sums = {}
    for _, _, e, label in out:
        sums[label] = sums.get(label, 0) + e
    return sorted(((i, c, e, min(sums[label], most), digest) for i, c, e, label in out), key=str)


def coded(spark, rows, p=vector_codes.CodeParams()):
    return sorted(map(tuple, vector_codes.compress(vectors(spark, rows).repartition(3), p=p).collect()), key=str)


def test_codes_against_plain_loops(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(32)], rng.choice([None, 0, 1, 1, 1])) for i in range(150)]
    rows += [(200, None, 1), (201, rows[0][1][:-1] + [None], 1), (202, rows[0][1][:-1] + [math.nan], 1), (203, rows[0][1][:-1] + [math.inf], 1), (204, rows[0][1][:16], 1), (205, [], 1)]
    rows += [rows[3], rows[3], (3, rows[4][1], 0), (None, rows[5][1], None), (-4, [-1e-9] * 32, 2)]
    p = vector_codes.CodeParams(block=32, broadcast_labels=0)
    assert coded(spark, rows, p) == plain_codes(rows, p)


@pytest.mark.parametrize("dim,scale_up,entries", [(20, 1.0, 64), (32, 1e30, 8), (16, 1e6, 5), (16, 1e305, 3)])
def test_codes_of_odd_lengths_and_sizes(spark, dim, scale_up, entries):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, scale_up) for _ in range(dim)], i % 2) for i in range(12)]
    p = vector_codes.CodeParams(entries=entries)
    assert coded(spark, rows, p) == plain_codes(rows, p)


def test_codes_of_nothing(spark):
    assert coded(spark, [(1, None, 1)]) == []
    assert vector_codes.compress(vectors(spark, [(1, [1.0], 1)]).where("vec_id < 0")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


# --- 12: near vectors ---------------------------------------------------------------------------------------------------------------
def plain_links(ids, x, least=0.95):
    u = pivot_index._unit(x)
    hit = u @ u.T >= least
    np.fill_diagonal(hit, False)
    label = ids.copy()
    while True:
        new = np.array([min(label[i], label[hit[i]].min(initial=label[i])) for i in range(len(ids))])
        if (new == label).all():
            return hit.sum(axis=1), label
        label = new


def turned(rng, u, cosine):
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    return cosine * u + math.sqrt(1 - cosine**2) * pivot_index._unit(w)


def test_near_vectors_against_all_pairs(spark):
    """Pairs on both sides of the threshold, groups of copies, tight and loose clusters: no wrong link, and nine of ten at least."""
    rng = np.random.default_rng(3)
    base = pivot_index._unit(rng.normal(size=(900, 48)))
    parts = [base, *(turned(rng, base[rng.integers(0, 900, 60)], c) for c in (0.9499, 0.9501, 0.96, 0.98, 0.999))]
    parts += [pivot_index._unit(base[k] + rng.normal(size=(120, 48)) * s) for k, s in enumerate((0.008, 0.02, 0.033))] + [np.repeat(base[11:12], 80, 0)]
    x = np.concatenate(parts)
    ids = rng.permutation(len(x))
    n, label = plain_links(ids, x)
    df = vectors(spark, [(int(i), [float(v) for v in r], None) for i, r in zip(ids, x)]).repartition(4)
    got = {r["vec_id"]: r for r in pivot_index.near_vectors(df, p=pivot_index.PivotParams(block=32)).collect()}
    g = np.array([got[i]["n_links"] for i in ids.tolist()])
    assert len(got) == len(ids) and (g <= n).all() and g.sum() >= 0.9 * n.sum() and g.sum() > 0
    apart = slice(900 + 60, 900 + 300)  # pairs beyond the threshold, one by one
    assert g[apart].sum() >= 0.9 * n[apart].sum()
    assert (np.array([got[i]["component_id"] for i in ids.tolist()]) == label).mean() > 0.97
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_near_vectors_edges(spark):
    a = [1.0, 2.0, 3.0]
    odd = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [math.nan, 1.0, 1.0]), (6, [math.inf, 1.0, 1.0])]
    rows = [*odd, (7, a), (8, a), (9, [x * 1e200 for x in a]), (9, [x * 1e200 for x in a]), (10, [-x for x in a]), (11, a + [0.0]), (12, [1.0, 2.0, 3.1]), (None, a), (13, [x * 1e-300 for x in a])]
    df = vectors(spark, [(i, v, 1) for i, v in rows])
    got = sorted(((r[0] or 0, r[1], r[2], r[3]) for r in pivot_index.near_vectors(df).collect()))
    near = [(i, 4, 7, i == 7) for i in (7, 8, 9, 9, 12, 13)]
    assert got == sorted([(0, 0, None, True), *((i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 11)), *near])
    assert pivot_index.near_vectors(df.where("vec_id < 0")).count() == 0 and pivot_index.near_vectors(df.where("vec_id < 7")).count() == 6
    floats = spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0, 1.0])], "vec_id int, embedding array<float>")
    assert sorted(map(tuple, pivot_index.near_vectors(floats).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


# --- 13: trie -----------------------------------------------------------------------------------------------------------------------
def plain_trie(rows, rebuilt, group=20, heads=4):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    said = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda y: (y[0], y[1], y[2], hashlib.sha256(f"{len(y[2])}:{y[2]}:{y[3]}".encode()).hexdigest()))] for c, v in own.items()}
    whole = {}
    for c, v in said.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole[c] = said.get(c - int(math.fmod(c, group)), [])[:h] + v[h:] if rebuilt else v
    members = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    kids, out = {}, []
    for k in members:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    words = lambda x: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", x) if w])
    for k, m in members.items():
        below = [j for j in members if j[: len(k)] == k]
        saved = sum((len(members[j]) - 1) * words(j[-1][1]) for j in below if j)
        ends = hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k)))).encode()).hexdigest()
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids.get(k, 0), sum(j not in kids for j in below), saved, ends))
    return sorted(out, key=str)


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "w") for r in rows], "conv_id long, turn long, role string, text string, place int, words string")


@pytest.mark.parametrize("rebuilt", [True, False])
def test_trie_against_plain_loops(spark, rebuilt):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 70), 400, 407, -7, -25]:
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "a  b\tc", "d", "", None, "é x"]) if t else "hello there"))
    rows += [(1, None, None, "first"), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (3, 1, "", ""), (3, 1, None, None), (None, 0, "user", "nobody"), (500, None, None, None)]
    rows += [(600 + k, t, "user", f"copy {t}") for k in range(40) for t in range(6)]  # a group of copies
    rng.shuffle(rows)
    p = prefix_trie.TrieParams(block=3, piece=4)
    got = prefix_trie.prefix_trie(turns(spark, rows).repartition(3), rebuilt=rebuilt, p=p)
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows, rebuilt)


def test_trie_of_one_long_conversation_and_of_nothing(spark):
    """Depth beyond many blocks: rounds grow with its logarithm."""
    rows = [(20, t, "user", f"w{t % 3} x") for t in range(150)] + [(40, t, "user", f"w{t % 3} x") for t in range(90)]
    got = prefix_trie.prefix_trie(turns(spark, rows), p=prefix_trie.TrieParams(block=7))
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows, False)
    for rebuilt in (True, False):
        assert prefix_trie.prefix_trie(turns(spark, rows).where("conv_id < 0"), rebuilt=rebuilt).count() == 0
