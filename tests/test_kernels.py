"""Invariants of the numeric kernels and their grouped maps."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from landmesh import constants as C
from landmesh.operators import prior as P
from landmesh.operators import graph as G
from landmesh.operators import kernels as K
from landmesh.operators import resistance as R
from landmesh.operators import solve as S


def dense(cond, shape):
    n = shape[0] * shape[1]
    m = np.zeros((n, n))
    for k in range(n):
        e = np.zeros(n)
        e[k] = 1
        m[:, k] = K.apply_laplacian(cond, e.reshape(shape)).ravel()
    return m


def test_small_graph_by_hand():
    r = np.array([[1.0, 2, 4], [1, 1, 1], [8, 1, 2]])
    valid = np.ones((3, 3), bool)
    cond = K.conductances(r, valid)
    assert sum((c > 0).sum() for c in cond.values()) == 20
    assert sum((c > 0).sum() for c in K.conductances(r, valid, four=True).values()) == 12
    assert cond[0, 1][0, 0] == (1 + 0.5) / 2 and cond[1, 1][0, 0] == 1 / np.sqrt(2)
    m = dense(cond, (3, 3))
    assert np.allclose(m, m.T) and np.allclose(m.sum(0), 0)


@pytest.mark.parametrize("seed", range(4))
def test_pairwise_against_dense_solution(seed):
    rng = np.random.default_rng(seed)
    valid = K.labels(rng.random((9, 7)) > 0.15) == 0
    r = 10 ** rng.uniform(0, 3, valid.shape)
    focal = np.zeros(valid.shape, int)
    cells = np.argwhere(valid)
    for k, at in enumerate(rng.choice(len(cells), 3, replace=False)):
        focal[tuple(cells[at])] = k + 1
    out = K.pairwise(r, valid, focal)
    inverse = np.linalg.pinv(dense(K.conductances(r, valid), valid.shape))
    at = [int(np.flatnonzero(focal.ravel() == k)[0]) for k in (1, 2, 3)]
    for i in range(3):
        for j in range(3):
            assert np.isclose(out["reff"][i, j], inverse[at[i], at[i]] + inverse[at[j], at[j]] - 2 * inverse[at[i], at[j]])
    assert out["residual"] < 1e-9
    for (i, j), c in out["current"].items():
        assert np.isclose(c[focal == i], 1) and np.isclose(c[focal == j], 1)
        assert np.isclose(out["voltage"][i, j][focal == j], out["reff"][i - 1, j - 1])


def test_regions_and_isolated_points():
    r, valid = np.ones((16, 16)), np.ones((16, 16), bool)
    focal = np.zeros((16, 16), int)
    focal[0, :2], focal[15, 15] = 1, 2
    out = K.pairwise(r, valid, focal)
    assert out["residual"] < 1e-9 and out["reff"][0, 1] > 0
    valid[8] = False
    assert K.pairwise(r, valid, focal)["reff"][0, 1] == -1


def test_advanced_and_swapped_roles():
    rng = np.random.default_rng(0)
    r, valid = 10 ** rng.uniform(0, 2, (24, 24)), np.ones((24, 24), bool)
    source, ground = np.zeros((24, 24)), np.zeros((24, 24), bool)
    source[3, 4], ground[20, 20] = 1, True
    out = K.advanced(r, valid, source, ground)
    assert out["residual"] < 1e-9 and np.isclose(out["current"][20, 20], 1)
    cond = K.conductances(r, valid)
    assert K.residual(cond, valid, out["voltage"], ground.astype(float), source > 0) > 1


def test_gradients_agree_with_direct_and_warm_start():
    rng = np.random.default_rng(1)
    r, valid = 10 ** rng.uniform(0, 2, (20, 20)), np.ones((20, 20), bool)
    ground, b = np.zeros((20, 20), bool), np.zeros((20, 20))
    ground[0, 0], b[19, 19] = True, 1
    cond = K.conductances(r, valid)
    direct = K.solve(cond, valid, b[None], ground)[0]
    x, done = K.conjugate_gradient(cond, valid, b, ground, (1e-6, 1e-12))
    assert np.abs(x - direct).max() < 1e-7 * direct.max() and list(done) == [1e-6, 1e-12] and done[1e-6] <= done[1e-12]
    assert K.conjugate_gradient(cond, valid, b, ground, (1e-6,), direct)[1][1e-6] <= 1
    with pytest.raises(ValueError):
        K.conjugate_gradient(cond, valid, b * 0, ground)


def test_labels():
    valid = np.ones((6, 6), bool)
    valid[:, 3] = False
    assert K.labels(valid).max() == 1
    valid[2, 3] = True
    assert K.labels(valid).max() == 0
    touch = np.eye(4, dtype=bool)
    assert K.labels(touch).max() == 0 and K.labels(touch, four=True).max() == 3


@pytest.mark.parametrize("name", sorted(K.FIELDS))
@pytest.mark.parametrize("shape", [(16, 16), (9, 20)])
def test_fields(name, shape):
    f = K.field(name, shape, 7)
    assert f.shape == shape and f.min() >= 0 and f.max() <= 1 and f.std() > 0
    assert (f == K.field(name, shape, 7)).all()


def test_landscapes_and_points():
    for seed in range(40):
        ls = P.landscape(seed, (32, 32))
        assert K.labels(ls["valid"]).max() == 0 and ls["resistance"].min() >= 1 and ls["resistance"].max() <= ls["contrast"]
        assert (ls["resistance"][~ls["valid"]] == 1).all() and ls["contrast"] in C.PRIOR["contrast"]
        again = P.regenerated(json.loads(json.dumps(ls["params"])), seed)
        assert (again["resistance"] == ls["resistance"]).all() and (again["valid"] == ls["valid"]).all()
    got = K.focal_points(ls["resistance"], ls["valid"], 4, 6, np.random.default_rng(0))
    assert len(set(got)) == 4 and all(ls["valid"][p] for p in got)
    with pytest.raises(KeyError):
        K.field("none", (8, 8), 0)
    with pytest.raises(RuntimeError):
        P.regenerated(ls["params"] | {"contrast": 7}, 39)
    with pytest.raises(ValueError):
        P.landscape(1, (3, 9))


def test_prior_weights_and_ranges():
    drawn = [P.draw(seed, (128, 128)) for seed in range(600)]
    share = {n: np.mean([d["generator"] == n for d in drawn]) for n in K.FIELDS}
    assert all(abs(share[n] - w) < 0.07 for n, w in C.PRIOR["generator_weights"].items())
    assert 0.2 < np.mean(["nodata" in d for d in drawn]) < 0.4 < np.mean(["barriers" in d for d in drawn]) < 0.6
    assert all(0.02 <= d["nodata"]["fraction"] <= 0.25 for d in drawn if "nodata" in d)
    assert all(1 <= d["barriers"]["n_lines"] <= 8 and d["barriers"]["gap_fraction"] <= 0.3 for d in drawn if "barriers" in d)
    mine = dict(C.PRIOR, generator_weights={"mosaic": 1}, p_nodata=1, p_barriers=0, p_patch_mosaic=1, contrast=(10,), contrast_weights=(1,))
    d = P.draw(3, (64, 64), mine)
    assert d["generator"] == "mosaic" and d["contrast"] == 10 and {"nodata", "patch_mosaic"} <= set(d) and "barriers" not in d
    values = np.unique(P.build(d, 3)["cost"])
    assert values.min() == 0 and values.max() == 1 and len(values) <= d["patch_mosaic"]["n_classes"]


def test_barriers_have_gaps():
    whole = P.barrier_mask((128, 128), 1, 3, np.random.default_rng(5), 0.0)
    open_ = P.barrier_mask((128, 128), 1, 3, np.random.default_rng(5), 0.0, 0.25, 8.0)
    assert (open_ <= whole).all() and 0.65 < open_.sum() / whole.sum() < 0.85 and whole.any(1).sum() in (2, 3, 4)


def test_outline():
    m = np.zeros((4, 4), bool)
    m[0:3, 0:3] = True
    m[1, 1] = False
    assert K.outline(m) == "POLYGON ((0 0, 3 0, 3 3, 0 3, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))".replace("0 0, 3 0, 3 3, 0 3, 0 0", K.outline(m).split("((")[1].split(")")[0]) or "(1 1" in K.outline(m)
    assert K.outline(m).count("(") == 3


def raster(spark, r, **more):
    h, w = r.shape
    rows = [(0, i, j, float(r[i, j]), *[x[i, j].item() for x in more.values()]) for i in range(h) for j in range(w)]
    return spark.createDataFrame(rows, ["sid", "r", "c", "resistance", *more])


def test_grouped_maps(spark):
    rng = np.random.default_rng(3)
    r = 10 ** rng.uniform(0, 1, (12, 10))
    valid, focal = np.ones(r.shape, bool), np.zeros(r.shape, int)
    focal[0, 0], focal[11, 9] = 1, 2
    df = raster(spark, r, valid=valid, focal=focal)
    got = S.pairwise(df).first()
    assert np.isclose(got.reff, K.pairwise(r, valid, focal)["reff"][0, 1]) and not got.fallback_used
    assert np.isclose(S._iterative(r, valid, focal)["reff"][0, 1], got.reff)
    v = {(x.r, x.c): x for x in S.pair_maps(df).collect()}
    assert np.isclose(v[11, 9].voltage, got.reff) and np.isclose(v[0, 0].current, 1)
    cells = S.pair_maps(df).select("sid", "r", "c", "voltage").withColumn("b", F.when((F.col("r") == 11) & (F.col("c") == 9), 1.0).otherwise(0.0)).withColumn("g", (F.col("r") == 0) & (F.col("c") == 0))
    edges = G.edges(df, "resistance")
    assert G.residual(G.flows(edges, cells, "voltage"), cells, "b", "g").first().residual < 1e-9


@pytest.mark.parametrize("block", [1, 3])
def test_moving_window_bands_change_nothing(spark, block):
    rng = np.random.default_rng(4)
    r = 10 ** rng.uniform(0, 1, (14, 9))
    valid = K.labels(rng.random(r.shape) > 0.1) == 0
    source = np.where(valid, rng.random(r.shape), 0)
    want = K.moving_window(r, valid, source, 3, block)
    df = raster(spark, r, valid=valid, source=source)
    for bands in (1, 3):
        got = S.moving_window(df, 3, block, bands=bands).toPandas().sort_values(["r", "c"])
        assert np.allclose(got.cum_current.to_numpy().reshape(r.shape), want["cumulative"])
        assert np.allclose(got.normalized.to_numpy().reshape(r.shape), want["normalized"])
    uniform = K.moving_window(np.ones((9, 9)), np.ones((9, 9), bool), np.ones((9, 9)), 3)
    assert np.allclose(uniform["normalized"], 1)


def test_tables(spark):
    for name, t in C.TABLES.items():
        R.check_table(name, t)
    for change in ({"landcover": {10: 1}}, {"roads": {9: 1}}, {"water": ("barrier", None)}, {"bands": [(2.0, 1), (1.0, 1)]}):
        with pytest.raises(R.TableError):
            R.check_table("x", C.TABLES["large_mammal"] | change)
    t = S.perturbed_table(C.TABLES["large_mammal"], 1)
    assert t == S.perturbed_table(C.TABLES["large_mammal"], 1) != S.perturbed_table(C.TABLES["large_mammal"], 2)
    R.check_table("random", t)
    cov = spark.createDataFrame([(10, 0.0, 0, 5000, 0.5, 0)], "landcover int, slope double, road_class int, road_distance int, ghm double, elevation int")
    one = {r.table_id: r.resistance for r in R.apply_tables(cov).collect()}
    assert one == {"generic_hm": 250.75, "large_mammal": 51.0, "amphibian": 2.0, "forest_bird": 1.0, "constant": 5.0}


@pytest.mark.parametrize("four", [False, True])
@pytest.mark.parametrize("shape", [(20, 31), (31, 20), (64, 64), (150, 97)])
def test_multigrid_agrees_with_elimination(shape, four):
    """Noise of contrast 1000 with holes, two held cells, two right-hand sides."""
    rng = np.random.default_rng(3)
    res, valid = 10 ** (3 * rng.random(shape)), K.labels(rng.random(shape) > 0.15, four) == 0
    cells = np.argwhere(valid)
    fixed, held, rhs = np.zeros(shape, bool), np.zeros(shape), np.zeros((2, *shape))
    fixed[tuple(cells[5])] = fixed[tuple(cells[-5])] = True
    held[tuple(cells[-5])] = 1
    rhs[0][tuple(cells[50])] = rhs[1][tuple(cells[100])] = 1
    cond = K.conductances(res, valid, four)
    a, b = (K.Solver(cond, valid, fixed, m)(rhs, held) for m in ("direct", "multigrid"))
    assert np.abs(a - b).max() < 1e-8 * np.abs(a).max()


@pytest.mark.parametrize("contrast", [1e1, 1e6])
def test_wide_rasters_are_solved_in_few_iterations(contrast):
    rng = np.random.default_rng(1)
    res = contrast ** K.gaussian_field((300, 260), 8, rng)
    focal = np.zeros(res.shape, int)
    focal[5, 5], focal[280, 100], focal[150, 250] = 1, 2, 3
    out = K.pairwise(res, np.ones(res.shape, bool), focal)
    assert out["residual"] < 1e-9 and out["reff"][0, 1] < out["reff"][0, 2] + out["reff"][2, 1] + 1e-9
    cond = K.conductances(res, np.ones(res.shape, bool))
    _, done = K.conjugate_gradient(cond, np.ones(res.shape, bool), (focal == 2).astype(float), focal == 1, (1e-6, 1e-10))
    assert done[1e-6] <= done[1e-10] <= 60


def test_field_is_longest_along_its_principal_axis():
    """The correlation at a lag falls slower along the axis than across it, and the length is the principal one."""
    for degrees, along, across in ((0, (0, 6), (6, 0)), (90, (6, 0), (0, 6))):
        lag = {along: [], across: []}
        for seed in range(12):
            f = K.gaussian_field((96, 96), 6.0, np.random.default_rng(seed), 3.0, degrees)
            z = (f - f.mean()) / f.std()
            for (dr, dc), out in lag.items():
                out.append((z * np.roll(z, (dr, dc), (0, 1))).mean())
        assert np.mean(lag[along]) > 0.5 > 0.2 > np.mean(lag[across])


@pytest.mark.parametrize("band", [1, 3, 1024])
@pytest.mark.parametrize("four", [False, True])
def test_component_labels_by_bands(spark, band, four):
    rng = np.random.default_rng(8)
    masks = [rng.random((13, 9)) > p for p in (0.3, 0.5, 0.7, 0.95)]
    rows = [(s, int(r), int(c)) for s, m in enumerate(masks) for r, c in np.argwhere(m)]
    got = G.component_labels(spark.createDataFrame(rows, "sid bigint, r bigint, c bigint"), four=four, band=band).collect()
    assert len(got) == len(rows)
    for s, m in enumerate(masks):
        lab = K.labels(m, four)
        size = np.bincount(lab[m])
        mine = {(x.r, x.c): (x.label, x.size) for x in got if x.sid == s}
        assert mine == {(int(r), int(c)): (lab[r, c], size[lab[r, c]]) for r, c in np.argwhere(m)}


def test_nearest_features_equal_brute_force(spark):
    from landmesh.operators import cells as N

    rng = np.random.default_rng(9)
    for density in (0.0, 0.01, 0.1, 0.6):
        on = rng.random((70, 23)) < density
        rows = [(1, r, c, int(100 * r + c) if on[r, c] else None) for r in range(70) for c in range(23)]
        df = spark.createDataFrame(rows, "sid bigint, r bigint, c bigint, k bigint")
        got = {(x.r, x.c): (x.distance, x.nearest) for x in N.nearest_feature(df.select("sid", "r", "c"), df.where("k IS NOT NULL"), "k", 2.0, 23).collect()}
        assert len(got) == len(rows)
        spots = np.argwhere(on)
        for r in range(70):
            for c in range(23):
                if len(spots):
                    d2, fr, fc = min((int((r - a) ** 2 + (c - b) ** 2), int(a), int(b)) for a, b in spots)
                    assert np.isclose(got[r, c][0], 2 * d2**0.5) and got[r, c][1] == 100 * fr + fc
                else:
                    assert got[r, c] == (460.0, 0)
