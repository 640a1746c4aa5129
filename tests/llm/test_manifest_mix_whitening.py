"""Merkle manifest, source mixing and whitening against brute force, and on nulls, empty and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from demandloom.llm import merkle, mixing, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, lo int, size string, key int"
VECTORS = "vec_id long, embedding array<float>, id string, x int, ids string"


def documents(seed: int, sizes: dict):
    """Rows of sources of given sizes with nulls, empty and long texts, repeated ids and extra columns that clash."""
    rng, rows = random.Random(seed), []
    for source, n in sizes.items():
        for i in range(n):
            text = rng.choice([None, "", "Some Words in ÄÖ", " ".join(f"W{rng.randrange(99)}" for _ in range(rng.randrange(400)))])
            doc_id = rng.choice([None, rng.randrange(-50, 50), len(rows) * 7])
            rows.append((doc_id, text, rng.choice(["en", None]), source, rng.choice([None, 5]), "t", 1, "s", 2))
        rows.append((1, "long " * 30_000, "en", source, 1, "t", 1, "s", 2))
        rows += [(3, "twin Text", "en", source, 1, "t", 1, "s", 2)] * 3
    rng.shuffle(rows)
    return rows


# --- Merkle manifest


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes: list[str], fan: int):
    """The root over ``nodes`` and for each of them the (left, right) siblings of every level."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, place in enumerate(at):
            run = place // fan * fan
            steps[i].append(("".join(level[run:place]), "".join(level[place + 1 : run + fan])))
        at = [place // fan for place in at]
        level = [h(*level[i : i + fan]) for i in range(0, len(level), fan)]
    return level[0], steps


def manifest_by_hand(rows, fan):
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[3]].append((row[0] is not None, row[0] or 0, leaf_of(row, row[1]), row))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])], fan) for s in names}
    root, upper = climb([trees[s][0] for s in names], fan)
    out = []
    for s, above in zip(names, upper):
        for (_, _, leaf, row), steps in zip(sorted(by_source[s], key=lambda x: x[:3]), trees[s][1]):
            altered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            lower = re.sub("[A-Z]", lambda m: m[0].lower(), row[1]) if altered and row[1] else row[1]
            value = leaf_of(row, lower)
            for left, right in steps + above:
                value = h(left, value, right)
            proof = h(*[a + b for a, b in steps + above])
            out.append((row[0], leaf, trees[s][0], root, proof, value, value == root))
    return out


def ordered(found):
    return sorted((tuple(r) for r in found), key=repr)


@pytest.mark.parametrize(("fan", "sizes"), [(16, {"a": 300, "b": 1, "": 17, None: 30, "é": 12}), (2, {"x": 20}), (3, {f"s{i}": i for i in range(12)})])
def test_manifest_equals_hand_built_trees(spark, monkeypatch, fan, sizes):
    rows = documents(fan, sizes)
    rows.append((9, "ALONE", "en", "single", 1, "t", 1, "s", 2))
    monkeypatch.setattr(merkle, "manifest", lambda docs, made=merkle.manifest: made(docs, fan))
    found = merkle.manifest_digest(spark.createDataFrame(rows, DOCS)).collect()
    assert ordered(found) == ordered(manifest_by_hand(rows, fan))
    assert {r.verified for r in found} == {True, False}


def test_manifest_of_one_leaf_and_of_none(spark):
    one = spark.createDataFrame([(7, "Text", "en", None, 1, "t", 1, "s", 2)], DOCS)
    row = merkle.manifest_digest(one).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h("")
    assert merkle.manifest_digest(one.limit(0)).count() == 0


def test_nodes_cover_their_tree_by_intervals(spark):
    nodes, _ = merkle.manifest(spark.createDataFrame(documents(5, {"a": 100, "b": 3}), DOCS), 4)
    spans = defaultdict(list)
    for r in nodes.collect():
        spans[r.tree, r.level].append((r.lo, r.hi))
    for (tree, level), parts in spans.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert all(lo % 4**level == 0 and hi - lo <= 4**level for lo, hi in parts)
    assert len(spans["1a", 4]) == 1 and ("1a", 5) not in spans


# --- Source mixing


def words(text):
    return len(re.findall(mixing.WORD, text or ""))


def fill(sizes: dict) -> dict:
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full: dict = {}
    while True:
        open_ones = [s for s in names if s not in full]
        rest = sum(sizes.values()) - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[t] for t in open_ones) for s in open_ones}
        above = [s for s in open_ones if share[s] >= 3 * sizes[s]]
        if not above:
            return full | share
        full |= {s: 3 * sizes[s] for s in above}


@pytest.mark.parametrize("block", [16, 1024])
def test_mix_takes_what_its_slots_hold(spark, block):
    rows = documents(8, {"a": 5, "b": 150, None: 40, "tiny": 0, "é": 60, "c": 30})
    rows.append((5, None, "en", "no words", 1, "t", 1, "s", 2))
    slots, docs = mixing.mix(spark.createDataFrame(rows, DOCS), block=block)
    found, slots = docs.collect(), slots.collect()
    sizes = defaultdict(int)
    for row in rows:
        sizes[row[3]] += words(row[1])
    targets = fill(sizes)
    given = defaultdict(int)
    for r in found:
        source = None if r.source == "1" else r.source[1:]
        given[source] += r.taken
        assert r.source_size == sizes[source] and 0 <= r.taken <= 3 * r["size"]
        assert r.target == pytest.approx(targets[source], rel=1e-12, abs=1e-9)
    assert all(abs(given[s] - targets[s]) <= 0.5 + 1e-6 for s in sizes)
    assert sorted((r.doc_id, r["size"]) for r in found if r.doc_id is not None) == sorted((row[0], words(row[1])) for row in rows if row[0] is not None)
    assert len(found) == len(rows)

    # word by word: the stream of a source is its documents in shuffled order
    stream = defaultdict(dict)
    for number, r in enumerate(found):
        for at in range(r.start, r.start + r["size"]):
            assert stream[r.source].setdefault(at, number) == number
    taken = [0] * len(found)
    for s in slots:
        for at in range(s.block * block, s.block * block + s.n_words):
            taken[stream[s.source][at]] += 1
    assert taken == [r.taken for r in found]


def test_schedule_stays_near_the_shares_all_along(spark):
    sizes = spark.createDataFrame([("0a", 400_000), ("0b", 300_000), ("0c", 500_000), ("0d", 100_000)], "source string, source_size long")
    targets = mixing.set_targets(sizes)
    share = {r.source: r.target / 1_300_000 for r in targets.collect()}
    slots = [r.source for r in mixing.schedule(targets, 256).orderBy("slot", "source").collect()]
    had = dict.fromkeys(share, 0)
    for i, source in enumerate(slots, 1):
        had[source] += 1
        assert all(abs(had[s] - i * share[s]) <= 8 for s in share)


def test_mix_is_the_same_again_and_empty_of_nothing(spark):
    df = spark.createDataFrame(documents(3, {"a": 30, "b": 30}), DOCS)
    first, again = (mixing.mixture(d).collect() for d in (df, df.repartition(7)))
    assert ordered(first) == ordered(again)
    assert mixing.mixture(df.limit(0)).count() == 0
    blank = mixing.mixture(spark.createDataFrame([(1, None, None, None, None, "t", 1, "s", 2)], DOCS)).collect()
    assert [tuple(r) for r in blank] == [(1, 0, 0, 0.0, 0)]


# --- Whitening


def vectors(n, dim, seed=1, spread=None):
    rng = np.random.default_rng(seed)
    return np.float32(rng.standard_normal((n, dim)) * (np.linspace(1, 3, dim) if spread is None else spread))


def table(spark, embeddings, ids=None):
    ids = range(len(embeddings)) if ids is None else ids
    return spark.createDataFrame([(i, None if e is None else [None if c is None else float(c) for c in e], "x", 1, "y") for i, e in zip(ids, embeddings)], VECTORS)


def eigen(x):
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    return c, values[::-1], axes[:, ::-1], ((n * x - sums) ** 2).sum(axis=1)


def whole(e):
    return np.floor(1024 * np.asarray(e, float)).astype(np.int64) + 100_000


def test_whitening_equals_the_eigenvectors(spark):
    e = vectors(300, 12)
    odd = [None, [1.0, None], [float("nan")] * 12, [float("inf")] * 12]
    got = whitening.whitened_query(table(spark, [*e, *odd])).toPandas()
    c, values, axes, deviation = eigen(whole(e))
    expected = c @ axes[:, :8] / np.sqrt(values[:8])
    found = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(300)].to_numpy()
    assert len(got) == 2400 and (got.n == 300).all()
    assert np.allclose(found, expected * np.sign((found * expected).sum(axis=0)), rtol=0, atol=1e-11)
    assert got.groupby("vec_id").deviation.first().tolist() == deviation.tolist()
    assert np.allclose(got.explained[:8], values[:8] / values.sum(), rtol=1e-12)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-12


def dense_step(x):
    def step(t, m):
        p = x @ t
        return p @ p, (x @ m).T @ p, x.T @ p

    return step


@pytest.mark.parametrize("short_run", [0, 1000])
@pytest.mark.parametrize("kind", ["falling", "repeated", "low rank", "clustered"])
def test_leading_values_of_dense_tables(kind, short_run):
    rng = np.random.default_rng(4)
    values = {
        "falling": 0.8 ** np.arange(60), "repeated": np.repeat([5.0, 3.0, 1.0], 20), "low rank": np.append([4.0, 4.0, 2.0], np.zeros(57)),
        "clustered": 1 + 1e-6 * np.arange(60)[::-1],
    }[kind]
    left, right = (np.linalg.qr(rng.standard_normal((s, 60)))[0] for s in (200, 60))
    x = left * values @ right.T
    found, axes = whitening.leading(dense_step(x), 60, 8, np.linalg.norm(x), 1, short_run)
    expected = values[values > 1e-9][:8]
    assert np.allclose(found, expected, rtol=1e-11)
    assert np.allclose(axes.T @ axes, np.eye(len(found)), atol=1e-11)
    assert np.allclose(np.linalg.norm(x @ axes, axis=0), expected, rtol=1e-11)


def test_vectors_of_several_lengths_repeated_and_without_id(spark):
    e = [[1.0, 2.0, 3.0], [2.0], [], [5.0, -1.0], [1.0, 2.0, 3.0], [0.0, 7.0, 1.0]]
    got = whitening.whitened_query(table(spark, e, [4, 4, None, 5, 4, 6])).toPandas()
    x = whole([row + [0.0] * (3 - len(row)) for row in e])
    assert len(got) == 18 and sorted(got[got.component == 1].deviation) == sorted(eigen(x)[3].tolist())
    assert got.vec_id.isna().sum() == 3


def test_little_variance_gives_fewer_components(spark):
    flat = [[1.0, 2.0, i / 4, 4.0] for i in range(9)]
    got = whitening.whitened_query(table(spark, flat)).collect()
    assert {r.component for r in got} == {1} and len(got) == 9
    assert got[0].explained == pytest.approx(1) and got[0].identity_error < 1e-9
    for rows in ([], [None], [[1.0, 2.0]], [[1.0], [1.0]], [[], []]):
        assert whitening.whitened_query(table(spark, rows)).count() == 0


def test_huge_entries_lose_their_deviation_only(spark):
    e = [[3e38, 1.0], [-3e38, 2.0], [0.5, 3.0], [0.25, 5.0]]
    got = whitening.whitened_query(table(spark, e)).collect()
    x = whole([[np.clip(c, -(2.0**42), 2.0**42) for c in row] for row in e]).tolist()
    sums = [sum(column) for column in zip(*x)]
    exact = [sum((4 * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    assert {(r.vec_id, r.deviation) for r in got} == {(i, d if d < 1 << 63 else None) for i, d in enumerate(exact)}
    assert {r.vec_id for r in got if r.deviation is None} == {0, 1} and np.isfinite([r.whitened for r in got]).all()


def test_exact_deviations_beyond_double_sums():
    x = np.array([[2_000_000_000, 0], [0, 1]], np.int64)
    sums = x.sum(axis=0).tolist()
    assert whitening.deviations(x, 2, sums) == [(2_000_000_000) ** 2 + 1] * 2
    assert whitening.deviations(x * 2, 2, [s * 2 for s in sums]) == [None, None]
