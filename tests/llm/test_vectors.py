"""Codes, whitening and graph search of vectors against brute force, and on odd rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemtext.llm import graph_search, queries, vector_codes, whitening
from tandemtext.llm.stored import stored

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id long, embedding array<double>, label int, code string, row string, `a.b` int"


def table(spark, rows, width=16):
    return spark.createDataFrame([(*r, "c", "r", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=16).tolist(), i % 3 or None) for i in range(40)]
    rows += [
        (40, None, 1),
        (41, [None] + [1.0] * 15, 1),
        (42, [INF] + [1.0] * 15, 2),
        (43, [NAN] * 16, 2),
        (44, [0.0] * 16, None),
        (3, rows[3][1], 1),  # a repeated row
        (None, rows[5][1], None),
        (46, rows[5][1], 2),  # a tie
        (47, rows[5][1], 2),
    ]
    return table(spark, rows)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# --- Codes -----------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_orchard_finds_the_nearest_and_the_lower_of_equals(seed):
    draw = np.random.default_rng(seed)
    # Few values: ties between entries, equal entries, points on entries.
    entries = draw.integers(-3, 4, (64, 4 if seed else 1))
    points = draw.integers(-5, 6, (3000, entries.shape[1]))
    apart = ((points[:, None] - entries[None]) ** 2).sum(2)
    found, least = vector_codes.Orchard(entries).nearest(points)
    assert (found == apart.argmin(1)).all() and (least == apart.min(1)).all()
    wide = draw.normal(0, 2.0**20, (500, 4)).astype(np.int64)
    entries = draw.normal(0, 2.0**20, (256, 4)).astype(np.int64)
    apart = ((wide[:, None] - entries[None]) ** 2).sum(2)
    found, least = vector_codes.Orchard(entries).nearest(wide)
    assert (found == apart.argmin(1)).all() and (least == apart.min(1)).all()


def test_orchard_looks_at_few_entries():
    """On a line the walk ends long before the list does."""
    entries = (np.arange(64) * 1000)[:, None]

    search = vector_codes.Orchard(entries)
    search.nearest(np.repeat(np.arange(0, 64_000, 640), 3)[:, None])
    assert search.looked < 300 * 64 * 0.6


def plain_codes(rows, parts=16, entries=64, rounds=2):
    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in rows]
    books = [[own[p] for own in cut[:entries]] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for own in cut:
                members.setdefault(nearest(p, own[p])[1], []).append(own[p])
            for k, found in members.items():
                books[p][k] = tuple(sum(c) // len(found) for c in zip(*found))
    out = []
    for (i, _, label), own in zip(rows, cut):
        found = [nearest(p, own[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return out, digest


def kept(df):
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    return [(r.vec_id, r.embedding, r.label) for r in df.collect() if good(r.embedding)]


def test_codes_of_odd_rows(odd, none):
    found, books = vector_codes.compress(odd.repartition(5))
    wanted, digest = plain_codes(kept(odd))
    sums = {}
    for _, _, error, label in wanted:
        sums[label] = sums.get(label, 0) + error
    rows = [(r.row.vec_id, r.code, r.error, r.row.label, r.label_error) for r in found.collect()]
    by_text = lambda rows: sorted(rows, key=str)
    assert by_text(rows) == by_text([(*w, sums[w[3]]) for w in wanted])
    assert books.digest() == digest
    assert found.first().row["a.b"] == 1
    empty, books = vector_codes.compress(none)
    assert books is None and empty.count() == 0


def test_codes_stand_for_near_vectors(spark, sf_small):
    vectors = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    found, books = vector_codes.compress(vectors, entries=256, rounds=4)
    rows = found.select("row.vec_id", "code", "error").orderBy("vec_id").collect()
    given = np.array([r.embedding for r in vectors.orderBy("vec_id").collect()])
    back = books.decoded([r.code for r in rows])
    apart = ((back - given) ** 2).sum(1)
    assert apart.mean() < 0.25 * given.var(0).sum()
    # The error is of the integers: half a step a component off at most.
    assert np.abs(np.sqrt(apart) - np.sqrt([r.error for r in rows]) / 256).max() < 8 * 0.5 / 256 * 2


def test_vectors_that_do_not_fit(spark):
    ragged = table(spark, [(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)])
    for run in (
        lambda: vector_codes.compress(ragged)[0].collect(),
        lambda: whitening.fit_whitening(ragged),
        lambda: graph_search.build_index(ragged, shard_rows=100).collect(),
    ):
        with pytest.raises(Exception, match="components|length"):
            run()
    with pytest.raises(Exception, match="equal parts"):
        vector_codes.fit_codebooks(table(spark, [(1, [1.0] * 15, 1)]))
    with pytest.raises(Exception, match="beyond"):
        vector_codes.fit_codebooks(table(spark, [(1, [1e30] * 16, 1)]))


# --- Whitening -------------------------------------------------------------------


@pytest.mark.parametrize("most", [1, 2, 200, 1 << 20, 1 << 50])
def test_plane_products(most):
    draw = np.random.default_rng(most % 97)
    values = draw.integers(0, most, (131, 5))
    exact = values.astype(object)
    sums, products = whitening.plane_products(whitening.packed_planes(values))
    assert (sums == exact.sum(0)).all() and (products == exact.T @ exact).all()
    total = whitening.Scatter(5)
    shifted = values - most // 2
    for a in range(0, 131, 50):
        total.add(shifted[a : a + 50])
    exact = shifted.astype(object)
    assert total.count == 131 and (total.sums == exact.sum(0)).all() and (total.products == exact.T @ exact).all()


def test_whitened_rows(spark, sf_small):
    vectors = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    rows = queries.op12_whiten(spark, sf_small).collect()
    ids = [r.vec_id for r in vectors.orderBy("vec_id").collect()]
    given = np.array([r.embedding for r in vectors.orderBy("vec_id").collect()], np.float64)
    x = np.floor(64 * given).astype(int) + 1_000_000
    n, sums = len(x), x.sum(0)
    assert len(rows) == n * 32 and {r.component for r in rows} == set(range(1, 33)) and {r.n for r in rows} == {n}
    deviation = dict(zip(ids, ((n * x - sums) ** 2).sum(1).tolist()))
    assert all(r.deviation == deviation[r.vec_id] for r in rows)
    z = x - sums / n
    values, vectors_ = np.linalg.eigh(z.T @ z / n)
    place = {i: k for k, i in enumerate(ids)}
    found = np.zeros((n, 32))
    for r in rows:
        found[place[r.vec_id], r.component - 1] = r.whitened
    wanted = z @ vectors_[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    signs = np.sign((found * wanted).sum(0))
    assert np.abs(found * signs - wanted).max() < 1e-9
    measured = np.abs(found.T @ found / n - np.outer(found.mean(0), found.mean(0)) - np.eye(32)).max()
    [told] = {r.identity_error for r in rows}
    assert told < 1e-10 and measured < 1e-10
    shares = {r.component: r.explained for r in rows}
    assert np.allclose([shares[k] for k in range(1, 33)], values[::-1][:32] / values.sum(), rtol=1e-9)


def test_whitening_of_odd_rows(spark, odd, none):
    model = whitening.fit_whitening(odd.repartition(4))
    found = whitening.whiten(odd, model).collect()
    rows = kept(odd)
    assert model.count == len(rows) == len(found) and len(model.variances) == 16
    x = np.array([[math.floor(64 * c) for c in v] for _, v, _ in rows])
    deviation = sorted(((len(x) * x - x.sum(0)) ** 2).sum(1).tolist())
    assert sorted(int(r.deviation) for r in found) == deviation
    assert found[0].row["a.b"] == 1
    assert whitening.fit_whitening(none) is None and whitening.whiten(none, None).count() == 0


def test_directions_without_variance(spark):
    """Fewer rows than dimensions, and one row: no division by zero."""
    model = whitening.fit_whitening(table(spark, [(i, [float(i)] * 16, 1) for i in range(5)]))
    assert (model.variances > 0).sum() == 1 and model.identity_error < 1e-9
    found = whitening.whiten(table(spark, [(9, [9.0] * 16, 1)]), model).first()
    assert all(math.isfinite(v) for v in found.whitened) and not any(found.whitened[1:])
    one = whitening.fit_whitening(table(spark, [(1, [2.5] * 16, 1)]))
    assert not one.variances.any() and not one.explained.any() and one.identity_error == 0


def test_deviation_beyond_64_bits(spark):
    far = table(spark, [(1, [2.0**33] * 16, 1), (2, [-(2.0**33)] * 16, 1), (3, [0.0] * 16, 1)])
    model = whitening.fit_whitening(far)
    found = {r.row.vec_id: int(r.deviation) for r in whitening.whiten(far, model).collect()}
    assert found[1] == 16 * (3 * 2**39) ** 2 and found[3] == 0


# --- Search ----------------------------------------------------------------------


def nearest(rows, every, count=10):
    """query -> (id, distance), nearest first, by looking at every row."""
    ids = np.array([i for i, *_ in rows])
    data = np.array([v for _, v, *_ in rows], np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        apart = np.sqrt(((data - data[q]) ** 2).sum(1))
        order = [k for k in np.lexsort([ids, apart]) if ids[k] != ids[q]]
        out[int(ids[q])] = [(int(ids[k]), float(apart[k])) for k in order[:count]]
    return out


def search(spark, rows, every, **options):
    index = stored(graph_search.build_index(rows, **options), "test-graphs")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = {}
    for r in graph_search.search(index, asked).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


@pytest.mark.parametrize("options", [{}, {"shard_rows": 300}])
def test_recall(spark, options):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    wanted = nearest([(r.vec_id, r.embedding) for r in vectors.collect()], 20)
    found = search(spark, vectors, 20, **options)
    assert found.keys() == wanted.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hits >= 0.97 * 10 * len(wanted)
    for q, rows in found.items():
        exact = dict(wanted[q])
        assert all(abs(exact[i] - s) < 1e-12 for i, s in rows if i in exact)
        assert [s for _, s in rows] == sorted(s for _, s in rows)


def test_recall_in_a_tight_crowd(spark):
    """A third of all vectors stand close together, and some are equal."""
    draw = np.random.default_rng(5)
    data = draw.normal(size=(3000, 32))
    data[::3] = data[0] + draw.normal(size=(1000, 32)) * 0.01
    data[:600:6] = data[0]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    found, wanted = search(spark, frame, 10, shard_rows=1024), nearest(rows, 10)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hits >= 0.9 * 10 * len(wanted)
    assert found[0] == wanted[0]


def test_search_of_odd_rows(spark, odd, none):
    found = search(spark, odd, 1, shard_rows=16)
    good = [r for r in kept(odd) if any(r[1])]
    ids = {i for i, *_ in good}
    assert found.keys() == ids - {None}
    at_five = {5, 46, 47, None}
    # The query's own id is left out; equals come by id, null last.
    assert [i for i, s in found[46] if s == 0] == [5, 47, None]
    assert all(q not in [i for i, _ in rows] and len({i for i, _ in rows}) == 10 for q, rows in found.items())
    assert not {40, 41, 42, 43, 44} & {i for rows in found.values() for i, _ in rows}
    assert at_five <= ids
    assert search(spark, none, 1) == {}
    one = search(spark, odd.where("vec_id = 3"), 1)
    assert one == {}


def test_a_graph_is_within_its_degree():
    data = np.random.default_rng(1).normal(size=(700, 8)).astype(np.float32)
    graph, start = graph_search.build_graph(data, degree=12, beam=24)
    assert graph.shape == (700, 12)
    for i, row in enumerate(graph):
        own = row[row >= 0]
        assert len(set(own)) == len(own) and i not in own
    reached, wave = {start}, [start]
    while wave:
        wave = [int(n) for n in set(graph[wave].reshape(-1)) - reached - {-1}]
        reached |= set(wave)
    assert len(reached) > 690
