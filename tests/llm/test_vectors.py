"""Vector codes and vector links against plain loops."""

import hashlib
import math

import numpy as np
import pytest

from sitefold.llm import vector_codes as codes
from sitefold.llm import vector_links as links

WIDE = "vec_id bigint, embedding array<float>, label int, code string, key string, space int, cell int, unit string, n_links int"


@pytest.fixture(scope="session")
def make_vectors(spark):
    """Rows of ``(vec_id, embedding, label)`` with clashing further columns."""

    def make(rows):
        df = spark.createDataFrame([(*r, "c", "k", 1, 2, "u", 3) for r in rows], WIDE)
        return df.repartition(3) if rows else df

    return make


def f32(values):
    return [None if v is None else float(np.float32(v)) for v in values]


def usable(vector):
    return vector is not None and all(v is not None and math.isfinite(v) for v in vector)


# -- codes ------------------------------------------------------------------
def brute_codes(rows, parts, entries, rounds, scale=256):
    kept = [(i, [math.floor(scale * v) for v in vector], label) for i, vector, label in rows if usable(vector)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda c, p: c[p * width : (p + 1) * width]
    books = [[list(cut(c, p)) for _, c, _ in kept[:entries]] for p in range(parts)]

    def nearest(piece, book):
        found = [sum((a - b) ** 2 for a, b in zip(piece, entry)) for entry in book]
        return found.index(min(found)), min(found)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, c, _ in kept:
                groups.setdefault(nearest(cut(c, p), books[p])[0], []).append(cut(c, p))
            for e, members in groups.items():
                books[p][e] = [sum(values) // len(members) for values in zip(*members)]
    out = []
    for i, c, label in kept:
        found = [nearest(cut(c, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), label))
    totals = {}
    for _, _, error, label in out:
        totals[label] = totals.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, code, error, totals[label], digest) for i, code, error, label in out), key=repr)


def test_codes_equal_plain_loops(spark, make_vectors):
    rng = np.random.default_rng(3)
    rows = [(i, f32(np.round(rng.normal(size=8), 1)), int(rng.integers(0, 3)) if i % 7 else None) for i in range(60)]
    rows += [(100, None, 1), (101, f32([1, 2, None, 4, 5, 6, 7, 8]), 1), (102, f32([float("nan")] * 8), 1),
             (103, f32([float("inf")] + [0] * 7), 2), (5, rows[5][1], rows[5][2]), (6, rows[9][1], 1), (None, f32([0.5] * 8), 0),
             (104, f32([-0.0] * 8), 2), (-3, f32([-0.001] * 8), 2)]
    found = codes.vector_codes(make_vectors(rows), parts=4, entries=6, rounds=3)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == brute_codes(rows, 4, 6, 3)


def test_fewer_vectors_than_entries_and_no_rounds(make_vectors):
    rows = [(3, f32([1, 2, 3, 4]), 0), (1, f32([1, 2, 3, 5]), 0), (1, f32([1, 2, 3, 5]), 0)]
    found = codes.vector_codes(make_vectors(rows), parts=2, entries=64, rounds=0)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_codes(rows, 2, 64, 0)


def test_vectors_without_a_code(make_vectors):
    rows = [(1, f32([1, 2, 3]), 0), (2, f32([1, 2, 3, 4]), 0), (3, [], 0), (4, f32([3e38, 0, 0, 0]), 1), (5, f32([9, 9, 9, 9]), 0),
            (6, f32([1, 2]), None)]
    found = {r["vec_id"]: r for r in codes.vector_codes(make_vectors(rows), parts=2, entries=2, rounds=1).collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6}
    assert {i for i, r in found.items() if r["code"]} == {2, 5}
    assert all(found[i]["error"] is None for i in (1, 3, 4, 6)) and found[4]["label_error"] is None
    only = codes.vector_codes(make_vectors([(3, [], 0)]), parts=2).collect()
    assert [(r["vec_id"], r["code"]) for r in only] == [(3, None)]


def test_no_vectors(make_vectors):
    assert codes.vector_codes(make_vectors([])).collect() == []
    assert codes.vector_codes(make_vectors([(1, None, 0)])).collect() == []
    assert links.vector_links(make_vectors([])).collect() == []


@pytest.mark.parametrize("moving", [0, 1, 3, 8])
def test_moved_entries_alone_give_the_complete_scan(moving):
    rng = np.random.default_rng(moving)
    before = rng.integers(-3, 4, (4, 8, 2))
    comps = rng.integers(-4, 5, (500, 4, 2))
    after = before.copy()
    for part in range(4):
        after[part, rng.choice(8, moving, replace=False)] = rng.integers(-3, 4, (moving, 2))
    first = codes.Codebooks(before, np.ones((4, 8), bool)).scan(comps)
    second = codes.Codebooks(after, (after != before).any(2))
    for got, want in zip(second.update(comps, *first), second.scan(comps)):
        assert (got == want).all()


# -- links ------------------------------------------------------------------
def brute_links(rows, threshold):
    def unit(vector):
        if not vector or not usable(vector) or not any(vector):
            return None
        v = np.array(vector, float)
        return v / np.linalg.norm(v)

    units = [None if i is None or label is None else unit(v) for i, v, label in rows]
    near = [
        [b for b in range(len(rows)) if b != a and units[a] is not None and units[b] is not None
         and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= threshold]
        for a in range(len(rows))
    ]
    out = []
    for a, row in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((row[0], len(near[a]), least, row[0] == least))
    return sorted(out, key=repr)


def planted(dimension, seed):
    """Tight and loose groups, chains and single vectors in three labels."""
    rng = np.random.default_rng(seed)
    rows = []
    for spread in (0.02, 0.05, 0.1, 0.13):
        for _ in range(3):
            centre, label = rng.normal(size=dimension), int(rng.integers(0, 3))
            centre /= np.linalg.norm(centre)
            for _ in range(25):
                noise = rng.normal(size=dimension) * spread * 2 / np.sqrt(dimension)
                rows.append((len(rows), f32((centre + noise * rng.random()) * rng.integers(1, 5)), label))
    start, side = np.eye(dimension)[0], np.eye(dimension)[1]
    for step in range(12):  # each linked with its neighbours only
        rows.append((len(rows), f32(math.cos(step * 0.35) * start + math.sin(step * 0.35) * side), 1))
    rows += [(len(rows) + k, f32(rng.normal(size=dimension)), k % 3) for k in range(60)]
    return rows


@pytest.mark.parametrize("dimension", [3, 16, 64])
@pytest.mark.parametrize("small", [False, True])
def test_links_equal_all_pairs(make_vectors, dimension, small):
    rows = planted(dimension, dimension)
    options = {"slice_rows": 7, "block_balls": 3} if small else {}
    found = links.vector_links(make_vectors(rows), **options)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = brute_links(rows, 0.93)
    assert sum(r[1] for r in want) > 1000
    assert got == want


def test_links_of_odd_rows(make_vectors):
    a, b = f32([1, 0, 0, 0.1]), f32([1, 0, 0, 0.2])
    rows = [(1, a, 1), (2, b, 1), (2, b, 1), (2, f32([0, 0, 1, 0]), 1), (3, a, 2), (4, a, None), (5, None, 1), (6, f32([0, 0, 0, 0]), 1),
            (7, f32([1, None, 0, 0]), 1), (8, f32([float("nan"), 0, 0, 1]), 1), (9, f32([float("inf"), 0, 0, 1]), 1), (10, [], 1),
            (11, f32([1, 0, 0]), 1), (12, f32([3e38, 0, 0, 3e37]), 1), (13, f32([1e-40, 0, 0, 1e-41]), 1), (14, f32([-0.0, 0, 2, 0]), 1)]
    got = sorted((tuple(r) for r in links.vector_links(make_vectors(rows)).collect()), key=repr)
    assert got == brute_links([(i, [v * 1e30 for v in x] if i == 13 else x, y) for i, x, y in rows], 0.93)


def test_rows_without_an_id_link_with_nothing(make_vectors):
    a = f32([1, 0, 0, 0.1])
    got = links.vector_links(make_vectors([(None, a, 1), (4, a, 1), (None, None, None)])).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(4, 0, 4, True), (None, 0, None, True), (None, 0, None, True)], key=repr
    )


@pytest.mark.parametrize("dimension, vectors", [(2, 100), (4, 3000), (16, 3000), (64, 5000), (64, 200_000)])
def test_recall_at_the_threshold(dimension, vectors):
    code = links.CapFilters(dimension, *links.fit_filters(dimension, vectors, 0.93, links.MISSED))
    first, second = links.pairs_at(0.93, dimension, 2000, seed=5)
    missed = np.mean([
        (links.shared_filters(code, first[k : k + 250], second[k : k + 250]) == 0).mean() for k in range(0, 2000, 250)
    ])
    assert missed <= 0.005


def test_decoding_lists_every_cap():
    code = links.CapFilters(6, 3, 4, 2, 0.9)
    units = np.random.default_rng(1).normal(size=(50, 6))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    want = set()
    for number, blocks in enumerate(code.scores(units)):
        for row in range(50):
            for a in range(4):
                for b in range(4):
                    for c in range(4):
                        if blocks[0][row, a] + blocks[1][row, b] + blocks[2][row, c] >= 0.9:
                            want.add((row, ((number * 4 + a) * 4 + b) * 4 + c))
    got = list(zip(*(x.tolist() for x in code.decode(units))))
    assert len(got) == len(set(got)) and set(got) == want
