"""Operators on embeddings against plain numpy and plain Python, with odd rows."""

import hashlib
from math import floor, inf, nan

import numpy as np
import pytest

from feedforge.llm import vector_codes, whitening

COLUMNS = "vec_id long, embedding array<float>, label int, its_x string, component string, its_key long, error string"


def table(spark, rows, columns=COLUMNS):
    return spark.createDataFrame([(i, v, g, "x", "y", 7, "z") for i, v, g in rows], columns)


def vectors(n, d, seed=3, rank=None):
    draw = np.random.default_rng(seed)
    rank = rank or d
    made = draw.normal(size=(n, rank)) * np.geomspace(4, 0.1, rank) @ draw.normal(size=(rank, d))
    return made.astype(np.float32).tolist()


def odd_rows(d):
    whole = [0.5] * d
    return [
        (900, None, 1),
        (901, [*whole[1:], None], 1),
        (902, [*whole[1:], nan], 1),
        (903, [*whole[1:], inf], None),
        (904, [*whole[1:], -inf], None),
        (905, [], 1),
        (906, whole + whole, 1),
        (None, whole, None),
        (3, whole, None),
    ]


def plain_whitening(rows):
    x = {tuple(floor(64 * float(c)) + 1_000_000 for c in v) for v in rows}
    n = len(x)
    sums = [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)
    return n, sums, e[order], axes[:, order].T


@pytest.mark.parametrize("d", [5, 32])
def test_whitening_equals_plain_eigenvectors(spark, d):
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(300, d))]
    rows += [(1000 + i, rows[7][1], 0) for i in range(200)]
    df = table(spark, rows + odd_rows(d))
    kept = [(i, v) for i, v, _ in rows] + [(i, v) for i, v, _ in odd_rows(d) if i in (None, 3)]
    n, sums, e, axes = plain_whitening([v for _, v in kept])
    got = whitening.whitened(df).collect()
    count = min(16, d)
    assert len(got) == count * len(kept)
    assert {r.component for r in got} == set(range(1, count + 1))
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    for i, v in kept:
        x = [floor(64 * c) + 1_000_000 for c in v]
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        own = by[i, deviation]
        centred = np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)])
        for k in range(count):
            assert own[k + 1].whitened == pytest.approx(abs(axes[k] @ centred) / np.sqrt(e[k]), abs=1e-6) or own[
                k + 1
            ].whitened == pytest.approx(-abs(axes[k] @ centred) / np.sqrt(e[k]), abs=1e-6)
            assert own[k + 1].explained == pytest.approx(e[k] / e.sum(), rel=1e-9)


def test_whitening_of_dependent_dimensions(spark):
    """A constant dimension, a repeated one, and one that is 10**6 times wider than the rest."""
    base = np.array(vectors(200, 6))
    made = np.concatenate([base, base[:, :2], np.full((200, 1), 0.25), base[:, 2:3] * 1e6], axis=1)
    got = whitening.whitened(table(spark, [(i, v, 0) for i, v in enumerate(made.tolist())])).collect()
    components = {r.component for r in got}
    x = np.floor(64 * made.astype(np.float32).astype(float)) + 1_000_000
    x = np.unique(x, axis=0)
    centred = x - x.mean(axis=0)
    s = np.linalg.svd(centred, compute_uv=False)
    assert len(components) == (s > 1e-10 * s[0]).sum() < made.shape[1]
    assert max(r.identity_error for r in got) < 1e-4
    share = {r.component: r.explained for r in got}
    for k in components:
        assert share[k] == pytest.approx(s[k - 1] ** 2 / (s**2).sum(), rel=1e-4)


def test_whitening_without_variance(spark):
    assert whitening.whitened(table(spark, [(i, [0.5, 0.5], 0) for i in range(5)])).collect() == []
    empty = whitening.whitened(table(spark, []))
    assert empty.collect() == [] and empty.columns[:4] == ["vec_id", "component", "n", "deviation"]


def test_whitening_of_huge_entries(spark):
    rows = [(0, [1e38, 1.0], 0), (1, [-1e38, 2.0], 0), (2, [0.0, 3.0], 0)]
    got = whitening.whitened(table(spark, rows)).collect()
    assert {r.vec_id for r in got} == {0, 1, 2} and all(r.deviation is None or r.deviation >= 0 for r in got)


def plain_codes(rows, entries=64, rounds=2):
    """Rows (key, vector, label) in the order of the first entries."""
    x = [[floor(256 * float(c)) for c in v] for _, v, _ in rows]
    width = -(-len(x[0]) // 16)
    x = [v + [0] * (16 * width - len(v)) for v in x]
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for v in x[:entries]] for p in range(16)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(16):
            owners = [near(part(v, p), books[p])[1] for v in x]
            new = []
            for k, entry in enumerate(books[p]):
                mine = [part(v, p) for v, o in zip(x, owners, strict=True) if o == k]
                new.append([sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else entry)
            books[p] = new
    found = [[near(part(v, p), books[p]) for p in range(16)] for v in x]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, g), e in zip(rows, errors, strict=True):
        by_label[g] = by_label.get(g, 0) + e
    name = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(
        (str(k), "".join(f"{i:02x}" for _, i in f), e, by_label[g], name) for (k, _, g), f, e in zip(rows, found, errors, strict=True)
    )


@pytest.mark.parametrize(("d", "n"), [(64, 150), (48, 100), (20, 80), (32, 10)])
def test_codes_equal_plain_codes(spark, d, n):
    draw = np.random.default_rng(d)
    rows = [(i * 3 % 1009, (np.round(draw.normal(size=d) * 4) / 512).astype(np.float32).tolist(), [0, 1, None][i % 3]) for i in range(n)]
    rows += [(2000 + i, rows[5][1], 9) for i in range(30)]
    some = [(i, v, g) for i, v, g in odd_rows(d) if i != 3]
    whole = sorted([*rows, *[(i, v, g) for i, v, g in some if i is None]], key=lambda r: (r[0] is None, r[0] or 0))
    got = vector_codes.vector_codes(table(spark, rows + some)).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(whole)


def test_codes_of_few_and_huge_vectors(spark):
    empty = vector_codes.vector_codes(table(spark, []))
    assert empty.collect() == [] and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [(i, [float(np.float32(i * 1e37)), *[0.25 * i] * 15], None) for i in range(1, 4)]
    got = vector_codes.vector_codes(table(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(rows)


def test_codes_of_repeated_keys(spark):
    rows = [(1, [float(9 - i)] * 16, 0) for i in range(5)] + [(0, [2.0] * 16, 0)]
    got = vector_codes.vector_codes(table(spark, rows), entries=3).collect()
    order = sorted(rows, key=lambda r: (r[0], r[1]))
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(order, entries=3)


@pytest.mark.parametrize("size", [1, 2, 8, 32])
def test_sequency_rows(size):
    rows = vector_codes.sequency_rows(size)
    assert (rows @ rows.T == size * np.eye(size)).all()
    assert ((np.diff(rows, axis=1) != 0).sum(axis=1) == np.arange(size)).all()


def test_nearest_with_ties_and_large_values():
    draw = np.random.default_rng(1)
    for scale in (2, 1 << 40):
        part, entries = draw.integers(-scale, scale, (200, 5)), draw.integers(-scale, scale, (20, 5))
        entries[11] = entries[3]
        part[:20] = entries
        index, distance = vector_codes.nearest(part, entries)
        for v, i, d in zip(part.tolist(), index, distance, strict=True):
            own = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in entries.tolist()]
            assert d == min(own) and i == own.index(d)
