"""Near duplicates by sketches against brute force, and the sketches against their law."""

import random
import re

import numpy as np
import pytest

from feedforge.llm import hyperminhash

COLUMNS = "doc_id long, text string, node long, label long, n string, kept string, registers string"
ODD = [None, "", " \n\t", "A", "a", "One two", "one TWO", "a b c " * 9, "w " * 30000, "ü é \U0001f600 x", "q" * 200000]


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]


def shingles(text):
    own = words(text)
    return {tuple(own[i : i + 2]) for i in range(max(1, len(own) - 1))} if own else set()


def brute(rows, similarity=80):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    out = []
    for i, (doc, _) in enumerate(rows):
        component = least.get(find(i)) if sets[i] else doc
        out.append((str(doc), len(sets[i]), str(component), doc == component))
    return sorted(out)


def texts(seed, groups=12, each=14):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [draw.choice(vocabulary) for _ in range(40)]
    out = []
    for _ in range(groups):
        base = passage * (draw.random() < 0.5) + [draw.choice(vocabulary) for _ in range(draw.choice([3, 12, 60, 150]))]
        for _ in range(each):
            own = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 9))):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            out.append(" ".join(own))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "n", "k", "r") for i, t in rows], COLUMNS)


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def test_equals_brute_force(spark):
    made = texts(1)
    rows = [*((i + 10, t) for i, t in enumerate(ODD)), *((1000 + i, t) for i, t in enumerate(made))]
    rows += [(5, made[0]), (5, made[-1]), (None, made[3]), (None, "nobody else has this"), (1000, made[0])]
    assert result(hyperminhash.near_duplicates(table(spark, rows))) == brute(rows)


@pytest.mark.parametrize(("small", "block"), [(2, 4), (3, 1024)])
def test_large_keys_in_blocks(spark, monkeypatch, small, block):
    monkeypatch.setattr(hyperminhash, "SMALL_KEY", small)
    monkeypatch.setattr(hyperminhash, "BLOCK", block)
    rows = list(enumerate(texts(2, groups=5, each=30)))
    assert result(hyperminhash.near_duplicates(table(spark, rows))) == brute(rows)


def test_one_large_group_of_near_copies(spark):
    draw = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(400):
        own = list(base)
        for at in draw.sample(range(100), draw.randint(2, 16)):
            own[at] = f"own{i}x{at}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(base)) for i in range(200)]
    assert result(hyperminhash.near_duplicates(table(spark, rows))) == brute(rows)


def test_empty_table(spark):
    got = hyperminhash.near_duplicates(table(spark, []))
    assert got.collect() == [] and got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert result(hyperminhash.near_duplicates(table(spark, [(2, None), (1, "")]))) == brute([(2, None), (1, "")])


@pytest.mark.parametrize("size", [1, 4, 40, 400, 4000])
def test_registers_match_with_the_probability_of_the_similarity(size):
    draw = np.random.default_rng(size)
    equal, trials, shared = 0, 60, -(-8 * size // 9)
    for _ in range(trials):
        a = draw.integers(0, 1 << 63, 2 * size).astype(np.uint64)
        sets = [np.sort(a[:size]), np.sort(np.concatenate([a[:shared], a[size : 2 * size - shared]]))]
        rows = hyperminhash.registers(np.concatenate(sets), np.array([0, size, 2 * size]))
        equal += int((rows[0] == rows[1]).sum())
    true = shared / (2 * size - shared)
    got = hyperminhash.estimate(np.array([equal / trials]), np.array([size]), np.array([size]))[0]
    assert got == pytest.approx(true, abs=0.02)


def test_chance_equality_of_different_sets():
    draw = np.random.default_rng(0)
    n, size = 3000, 600
    rows = hyperminhash.registers(np.sort(draw.integers(0, 1 << 63, n * size).astype(np.uint64).reshape(n, size), axis=1).ravel(), np.arange(n + 1) * size)
    found = (rows[:-1] == rows[1:]).mean()
    assert found == pytest.approx(hyperminhash.chance(np.array([size]), np.array([size]))[0], rel=0.15)
