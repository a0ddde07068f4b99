"""The queries on embeddings against brute force, on whole small tables with odd rows, and their operators' parts."""

import math

import numpy as np
import pytest

from reelgrid.llm import hard_negatives, near_vectors, registry, whitening

D = 6
#: Names that the operators use themselves come as further columns.
SCHEMA = "vec_id long, embedding array<float>, label int, " + ", ".join(f"{n} string" for n in ("vector", "h", "id", "n", "v", "anchor", "component", "pass", "key", "task", "side", "whitened", "deviation"))


def table():
    r = np.random.default_rng(7)
    vectors = [v.tolist() for v in r.standard_normal((240, D)) * 0.4]
    base = r.standard_normal(D)
    vectors += [(base + r.standard_normal(D) * 0.02).tolist() for _ in range(60)]  # one tight group
    turn = math.acos(0.93) * 0.8
    vectors += [[math.cos(i * turn), math.sin(i * turn), 0.0, 0.0, 0.0, 0.0] for i in range(12)]  # a chain
    vectors += [vectors[3]] * 30 + [[-0.0, 1.0, 0.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, -0.0, 0.0, 0.0]]
    rows = [(i, v, 1 if i >= 240 else int(r.integers(0, 4))) for i, v in enumerate(vectors)]
    at = len(rows)
    odd = [None, [], [0.0] * D, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, [1.0, 2.0], [-2e3, 1e3, 0.0, 0.0, 0.0, 1e-30]]
    rows += [(at + i, v, 1) for i, v in enumerate(odd)]
    rows += [(at + 20, vectors[1], None), (None, vectors[2], 1), (700, vectors[9], 2), (700, vectors[9], 2), (700, vectors[10], 2), (100, vectors[5], 3)]
    return [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], k) for i, v, k in rows]


@pytest.fixture(scope="module")
def here(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("vectors"))
    rows = table()
    spark.createDataFrame([(*r, *["x"] * 13) for r in rows], SCHEMA).repartition(5).write.parquet(f"{home}/embeddings.parquet")
    return home, rows


def whole(v):
    return v is not None and len(v) == D and all(c is not None and math.isfinite(c) for c in v)


def test_whitening(spark, here):
    got = registry.queries()["op11_whitening"](spark, here[0]).collect()
    rows = [(i, v) for i, v, _ in here[1] if whole(v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    want = sorted((-1 if i is None else i, sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True))) for (i, _), r in zip(rows, x, strict=True))
    assert all(r.n == n for r in got) and sorted({r.component for r in got}) == list(range(1, D + 1))
    first = [r for r in got if r.component == 1]
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.deviation) for r in first) == want and all(int(r.deviation_exact) == r.deviation for r in got)
    exact = [[sum(a[i] * a[j] for a in x) * n - sums[i] * sums[j] for j in range(D)] for i in range(D)]
    v = np.array([[c / n**2 for c in r] for r in exact])
    assert (whitening.scatter(whitening.of_one_length(spark.createDataFrame([(list(map(float, v)),) for _, v in rows], "vector array<double>"), "vector")[0], D, whitening.primes_for(n * 10**16)) == np.array([[sum(a[i] * a[j] for a in x) for j in range(D)] for i in range(D)], object)).all()
    e = np.sort(np.linalg.eigvalsh(v))[::-1]
    for k in range(D):
        own = [r for r in got if r.component == k + 1]
        assert math.isclose(own[0].explained, e[k] / e.sum(), rel_tol=1e-9) and abs(np.mean([r.whitened**2 for r in own]) - 1) < 1e-9
        assert own[0].identity_error <= 1e-9
    values, vectors = np.linalg.eigh(v)
    w = (np.array([[c - s / n for c, s in zip(r, sums, strict=True)] for r in x]) @ vectors / np.sqrt(values))[:, ::-1]
    for k in range(D):
        a, b = np.sort([r.whitened for r in got if r.component == k + 1]), np.sort(w[:, k])
        assert min(abs(a - b).max(), abs(a + b[::-1]).max()) < 1e-6


def test_whitening_without_spread(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    out = whitening.whitened(rows).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in out] == [(0, None, None, None)] * 4
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 5.0, -float(i)]) for i in range(9)], "vec_id long, embedding array<double>")).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in flat) and abs(flat[0].explained - 1) < 1e-9


def test_remainders_and_large_entries(spark):
    primes = whitening.primes_for(10**30)
    assert len(primes) == len(set(primes)) and all(p < 1 << 20 for p in primes) and math.prod(primes) > 2 * 10**30
    x = np.array([[0, -1, 10**30], [-(10**30), 12345678901234567890, 7]], object)
    assert (whitening.remaindered(np.array([x % p for p in primes]).astype(np.int64), primes) == x).all()
    big = [(i, [1e8 * (i % 3), float(i)]) for i in range(10)]
    got = {r.vec_id: r for r in whitening.whitened(spark.createDataFrame(big, "vec_id long, embedding array<double>")).where("component = 1").collect()}
    xs = [[math.floor(1024 * c) + 100000 for c in v] for _, v in big]
    sums = [sum(c) for c in zip(*xs, strict=True)]
    want = [sum((10 * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in xs]
    assert [int(got[i].deviation_exact) for i in range(10)] == want
    assert [got[i].deviation for i in range(10)] == [w if w < 1 << 63 else None for w in want]


def mined(rows, shares=80):
    """By all products; a row is (vec_id, label, integers)."""
    out = []
    rows = sorted(set(rows))
    for a in (r for r in rows if r[0] % 100 == 0):
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1] == a[1]) for b in rows if b != a))
        for p in [s for s in scored if s[2]][:5]:
            other = [s for s in scored if not s[2] and shares * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5]
            out += [(a[0], p[1], k + 1, s[1], -p[0], -s[0]) for k, s in enumerate(other)]
    return sorted(out)


def test_hard_negatives(spark, here):
    rows = [(i, (k + 1) % 10 if i % 7 == 0 else k, tuple(math.floor(256 * c) for c in v)) for i, v, k in here[1] if i is not None and k is not None and whole(v)]
    got = [tuple(r) for r in registry.queries()["op12_hard_negatives"](spark, here[0]).collect()]
    want = mined(rows)
    assert sorted(got) == want and len({r[0] for r in want}) >= 4


def test_hard_negatives_in_small_blocks(spark, here, monkeypatch):
    """Ties, negative scores, several blocks, chunks and tiles."""
    for name, value in (("BLOCK", 50), ("ANCHORS", 3), ("ROWS_AT_ONCE", 16), ("ANCHORS_AT_ONCE", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    r = np.random.default_rng(2)
    rows = [(int(i) * 25, int(r.integers(0, 2)), r.integers(-3, 4, D).tolist()) for i in r.integers(0, 80, 160)] + [(100, 5, [1] * D), (0, 0, [-8] * D)]
    table = spark.createDataFrame([(i, [c / 256 for c in v], k) for i, k, v in rows], "vec_id long, embedding array<double>, label int")
    got = [tuple(x) for x in hard_negatives.hard_negatives(table, hard_negatives.F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == mined([(i, k, tuple(v)) for i, k, v in rows])


def test_planes_hold_the_rows():
    x = np.array([[0, -1, 5], [-8, 7, 3]], np.int64)
    planes = hard_negatives.Planes(x, 4)
    assert (sum(planes.weight(b) * planes.of(b, slice(None)).astype(int) for b in range(4)) == x).all()
    assert hard_negatives.nth(np.array([5, 3, 9, 1]), np.array([0, 0, 2, 0]), 4, 2).tolist() == [3, hard_negatives.LEAST, hard_negatives.LEAST, hard_negatives.LEAST]


def linked(rows, threshold=0.93):
    """(vec_id, n_links, component_id) by all pairs; rows without links in None."""
    ok = [i for i, (v, e, k) in enumerate(rows) if v is not None and k is not None and whole(e) and any(e)]
    x = np.array([rows[i][1] for i in ok])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    k = np.array([rows[i][2] for i in ok])
    near = (x @ x.T >= threshold) & (k[:, None] == k[None, :])
    np.fill_diagonal(near, False)
    ids = [rows[i][0] for i in ok]
    least = list(ids)
    for _ in ok:
        least = [min([least[i], *(least[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ok))]
    out = {i: (rows[i][0], 0, rows[i][0]) for i in range(len(rows))}
    out |= {i: (ids[n], int(near[n].sum()), least[n]) for n, i in enumerate(ok)}
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("sizes", [{}, {"GROUP": 8, "CELL": 16}, {"WINDOW": 8, "ROWS": 40, "GROUP": 3, "CELL": 5}])
def test_near_vectors(spark, here, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(near_vectors, name, value)
    got = registry.queries()["op13_near_vectors"](spark, here[0]).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == linked(here[1])
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_recall_of_pairs_at_the_threshold(spark, monkeypatch):
    """Lone pairs just above the threshold among many rows, and none just below it."""
    monkeypatch.setattr(near_vectors, "WINDOW", 16)
    r, rows = np.random.default_rng(5), []
    for i in range(1500):
        x, y = r.standard_normal((2, 32))
        x /= np.linalg.norm(x)
        y -= x * (x @ y)
        t = math.acos(0.931 if i % 2 else 0.929)
        rows += [(2 * i, x.tolist(), 0), (2 * i + 1, (math.cos(t) * x + math.sin(t) * y / np.linalg.norm(y)).tolist(), 0)]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    hit = {r.vec_id for r in got if r.n_links}
    assert all(i // 2 % 2 for i in hit) and len(hit) >= 0.97 * 1500
    assert near_vectors.passes_for(5700, 0.93) < near_vectors.passes_for(10**9, 0.93)


def test_connected():
    near = np.zeros((6, 6), bool)
    for a, b in ((0, 5), (5, 3), (3, 4), (1, 2)):
        near[a, b] = near[b, a] = True
    assert near_vectors.connected(near).tolist() == [0, 1, 1, 0, 0, 0]
