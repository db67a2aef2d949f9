"""Links between embeddings against the cosines of all pairs."""

import math

import numpy as np
import pytest

from rowwarden.llm import vector_links

SCHEMA = "vec_id long, embedding array<double>, label string, n long, code binary, cid long, class_id long"
LEAST = 0.98


def plain(rows, least=LEAST):
    """(vec_id, n_links, component_id, kept) by comparing everything."""
    good = [i for i, (k, v, label) in enumerate(rows)
            if k is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    scaled = {i: np.array([x / max(map(abs, rows[i][1])) for x in rows[i][1]]) for i in good}
    unit = {i: x / math.sqrt(x @ x) for i, x in scaled.items()}
    links = {i: [j for j in good if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in good}
    out = []
    for i, (k, _, _) in enumerate(rows):
        seen, open_ = {i}, [i]
        while open_:
            for j in links.get(open_.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    open_.append(j)
        component = k if k is None else min(rows[j][0] for j in seen)
        out.append((k, len(links.get(i, ())), component, k is None or k == component))
    return sorted(out, key=str)


def answer(spark, rows, **options):
    table = spark.createDataFrame([(k, v, label, 1, b"x", 2, 3) for k, v, label in rows], SCHEMA).repartition(3)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vector_links.linked(table, **options).collect()), key=str)


def made(seed, size, n, spread):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((n, size))
    rows = []
    for c in centres:
        for _ in range(draw.integers(1, 9)):
            rows.append(c / np.linalg.norm(c) + spread * draw.standard_normal(size) / math.sqrt(size))
    return [(i, v.tolist(), draw.choice(["a", "b", "c"])) for i, v in enumerate(rows)]


@pytest.mark.parametrize(("tile", "cell", "band"), [(1024, 1024, 8), (3, 1, 8), (20, 1, 2)])
def test_all_pairs_are_found(spark, monkeypatch, tile, cell, band):
    monkeypatch.setattr(vector_links, "TILE_ROWS", tile)
    monkeypatch.setattr(vector_links, "CELL_ROWS", cell)
    monkeypatch.setattr(vector_links, "LEAST_BAND", band)
    rows = [(i, v, "x") for i, v, _ in made(1, 64, 60, 0.18)] + [(1000 + i, v, label) for i, v, label in made(2, 64, 40, 0.14)]
    assert answer(spark, rows) == plain(rows)


def test_all_cases(spark):
    v = [0.3, -0.4, 0.5, 0.1]
    rows = [(10, v, "a"), (9, v, "a"), (8, v, "b"), (7, v, None), (None, v, "a"), (9, v, "a"), (6, [1e-200 * x for x in v], "a"), (5, [1e200 * x for x in v], "a"),
            (4, None, "a"), (3, [], "a"), (2, [0.0] * 4, "a"), (1, [0.3, None, 0.5, 0.1], "a"), (0, [0.3, float("nan"), 0.5, 0.1], "a"),
            (11, [float("inf")] * 4, "a"), (12, [0.3, -0.4, 0.5], "a"), (13, [-x for x in v], "a"), (14, [2.0], "a"), (15, [3.0], "a"), (16, [-3.0], "a"),
            (-5, [5e-324, 0.0, 0.0, 0.0], "a"), (17, [1.0, 0.0, -0.0, 0.0], "a"), (18, [1.0, 0.0, 0.0, 0.0], "a"), (5, [0.0, 1.0], "a")]
    rows += [(100 + i, [0.3 + i * 1e-4, -0.4, 0.5, 0.1], "a") for i in range(60)] + [(200, [0.1, 0.9], "a")] * 50
    assert answer(spark, rows) == plain(rows)
    assert answer(spark, []) == [] and answer(spark, [(None, None, None)]) == [(None, 0, None, True)]


def test_long_vectors_and_pairs_at_the_threshold(spark):
    draw = np.random.default_rng(5)
    rows = []
    for i in range(300):
        x, u = draw.standard_normal((2, 300))
        x /= np.linalg.norm(x)
        u -= (u @ x) * x
        u /= np.linalg.norm(u)
        least = LEAST + (1e-12 if i % 2 else -1e-12)
        rows += [(2 * i, x.tolist(), "a"), (2 * i + 1, (least * x + math.sqrt(1 - least * least) * u).tolist(), "a")]
    found = answer(spark, rows)
    assert found == plain(rows) and sum(r[1] for r in found) == 300


def test_estimates_are_unbiased_and_bounds_hold():
    draw = np.random.default_rng(6)
    x, u = draw.standard_normal((2, 4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    u -= (u * x).sum(axis=1)[:, None] * x
    u /= np.linalg.norm(u, axis=1)[:, None]
    y = 0.98 * x + math.sqrt(1 - 0.98 ** 2) * u
    code, other = vector_links.turned(y), vector_links.turned(x)
    bits = code.shape[1]
    f = np.abs(code).sum(axis=1) / math.sqrt(bits)
    off = (other * np.sign(code)).sum(axis=1) / math.sqrt(bits) / f - 0.98
    deviation = np.sqrt(1 - f * f) / f * math.sqrt(1 - 0.98 ** 2) / math.sqrt(bits - bits // 64)
    assert abs(off.mean()) < 5 * off.std() / math.sqrt(len(off)) + 1e-3 and 0.9 < (off / deviation).std() < 1.1
    assert np.abs(off / deviation).max() < vector_links.DEVIATIONS


def test_bands_and_bits_miss_little():
    for size in (8, 12):
        plan = vector_links.design(LEAST, 256, size)
        unequal = math.acos(LEAST) / math.pi
        assert vector_links.bands_miss(unequal, 256, size, len(plan.places)) <= vector_links.BANDS_MISS
        assert math.fsum(math.comb(256, m) * unequal ** m * (1 - unequal) ** (256 - m) for m in range(plan.most_unequal + 1, 257)) <= vector_links.CODE_MISS * 1.01
