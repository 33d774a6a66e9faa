"""Field operators against closed forms, brute force and DuckDB."""

import math
import os
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumengrid.config import RunConfig, parse
from lumengrid.functions import kernels
from lumengrid.operators import balance, celltree, domain, groups, mesh, spatial
from lumengrid.operators.components import components
from lumengrid.plans import fields, formats, registry
from lumengrid.plans.views import DELTA, halos_e, particles_e
from lumengrid.sources import binary, ranges, writers
from lumengrid.sources.binary import Range
from lumengrid.streaming.snapshots import field_stream, snapshot_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", [*registry.QUERIES, *formats.QUERIES])
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda d: sorted(tuple(map(str, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    assert key(got) == key(want)


def test_cumulative_kernel(spark):
    t = [-2, -1, -0.5, 0, 0.25, 0.5, 1]
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in t], "t double").select(kernels.cumulative(F.col("t"))).collect()]
    assert got == [-0.5, -0.5, -0.375, 0, 0.21875, 0.375, 0.5]


def test_virial_overdensity(spark):
    cases = [(0, 0.308, 331.925920), (0, 1, 177.652879), (1, 0.308, 202.114840), (6, 0.308, 178.277772), (10, 0.308, 177.814232)]
    df = spark.createDataFrame([(float(z), float(m)) for z, m, _ in cases], "z double, m double")
    got = [r[0] for r in df.select(kernels.virial_overdensity(F.col("z"), F.col("m"))).collect()]
    assert np.allclose(got, [d for *_, d in cases], atol=1e-6)


def test_cell_weights_sum_to_one_inside(spark):
    p = spark.createDataFrame([(1, 16.0, 32.0, 32.0, 5.0)], "pid long, x double, y double, z double, rk double")
    w = mesh.spread(p, 64.0, 16)
    assert math.isclose(w.agg(F.sum("w")).first()[0], 1.0)
    by_x = dict(w.groupBy("ix").agg(F.sum("w")).collect())
    assert {k: round(v, 6) for k, v in by_x.items()} == {2: 0.02, 3: 0.48, 4: 0.48, 5: 0.02}


@pytest.mark.parametrize("periodic", [False, True])
def test_tiles_sum_what_cells_sum(spark, periodic):
    """Kernels from a hundredth of a cell to twice the box, by nodes, with tiles that don't divide the grid and full ones."""
    rng = np.random.default_rng(9)
    at, h = rng.uniform(-6, 38, (400, 3)), 10 ** rng.uniform(-2, 1.8, 400)
    at[:200] = rng.uniform(3, 5, (200, 3))
    rows = spark.createDataFrame([(i, i % 3, *map(float, x), float(r), float(v), i % 5 - 1) for i, (x, r, v) in enumerate(zip(at, h, rng.normal(0, 1, 400), strict=True))], "pid long, node int, x double, y double, z double, rk double, dens double, igrp int")
    rows = rows.withColumns({"vx": F.col("dens") * 2, "vy": -F.col("dens"), "vz": F.col("x")})
    gas, w = mesh.is_gas(-1), F.col("w")
    of = lambda x: F.sum(F.when(gas, x).otherwise(0.0))
    cells = mesh.spread(rows, 32.0, 10, periodic).groupBy("node", "ix", "iy", "iz").agg(of(w).alias("n"), F.sum(F.when(gas, 0.0).otherwise(w)).alias("halo"), of(w * F.col("dens")).alias("c"), *(of(w * F.col(f"v{a}")).alias(f"v{a}") for a in "xyz"))
    want = {tuple(r)[:4]: tuple(r)[4:] for r in cells.collect()}
    for tile, most in ((16, 1 << 16), (4, 1 << 16), (3, 20)):
        got = {tuple(r)[:4]: tuple(r)[4:] for r in mesh.assign(rows, 32.0, 10, periodic=periodic, keys=("node",), tile=tile, most=most).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for k in want for x, y in zip(got[k], want[k], strict=True))


def test_rows_for_tiles_grow_with_rows_not_cells(spark):
    rows = spark.createDataFrame([(i, float(i), 16.0, 16.0, 8.0) for i in range(32)], "pid long, x double, y double, z double, rk double")
    few, many = (mesh.dealt_to_tiles(rows, 32.0, nc, False, nc // 4).count() for nc in (32, 128))
    assert few == many and mesh.spread(rows, 32.0, 128).count() > 40 * mesh.spread(rows, 32.0, 32).count()


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    at = np.concatenate([rng.integers(0, 40, (60, 3)), rng.integers(0, 2000, (40, 3)), np.full((5, 3), 7)]) / 8  # clusters, outliers, ties
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at)], "pid long, x double, y double, z double")
    got = {(r.pid, r.rn): r.nid for r in spatial.nearest(p, 7).collect()}
    for i in range(len(at)):
        d2 = ((at - at[i]) ** 2).sum(axis=1)
        assert [got[i, k + 1] for k in range(7)] == np.lexsort((np.arange(len(at)), d2))[:7].tolist()
    with pytest.raises(ValueError):
        spatial.nearest(p.limit(3), 7)


def test_nearest_in_a_crowd(spark):
    """A crowd of a thousandth of the volume, a wide field, rows that coincide: whatever a leaf holds, the same neighbours."""
    rng = np.random.default_rng(2)
    at = np.concatenate([1000 + rng.integers(0, 64, (700, 3)) / 64, rng.integers(0, 4000, (150, 3)), np.full((60, 3), 5.0)])
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at)], "pid long, x double, y double, z double").repartition(5)
    want = {}
    for i in range(len(at)):
        d2 = ((at - at[i]) ** 2).sum(axis=1)
        want |= {(i, k + 1): j for k, j in enumerate(np.lexsort((np.arange(len(at)), d2))[:33].tolist())}
    for most in (celltree.MOST_IN_LEAF, 40, 8):
        assert {(r.pid, r.rn): r.nid for r in spatial.nearest(p, 33, most=most).collect()} == want


def test_no_leaf_pairs_more_than_its_share(spark):
    """Five rows in six stand in a ten-millionth of the volume; leaves there are as full as elsewhere."""
    rng = np.random.default_rng(4)
    at = np.concatenate([2000 + rng.uniform(0, 18, (10_000, 3)), rng.uniform(0, 4000, (2000, 3))])
    p = spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(at)], "tree long, pid long, x double, y double, z double")
    frame = celltree.Frame(at.min(0).tolist(), at.max(0).tolist())
    leaves = celltree.placed_in_leaves(p.select("*", *(frame.deep(a).alias(f"i{a}") for a in "xyz")), len(at), 100)
    sizes = leaves.groupBy("leaf").count().select("count").toPandas()["count"]
    assert sizes.max() <= 100 and sizes.sum() == len(at) and len(sizes) < len(at) / 10
    assert leaves.select(celltree.level_of(F.col("leaf")).alias("v")).distinct().count() >= 3
    for r in leaves.sample(0.05, 1).collect():  # rows lie in their leaves
        level, cell = r.leaf >> (3 * celltree.DEPTH), [(r.leaf >> ((2 - i) * celltree.DEPTH)) & ((1 << celltree.DEPTH) - 1) for i in range(3)]
        edge = frame.side / (1 << level)
        assert all(c0 + c * edge <= x <= c0 + (c + 1) * edge for c0, c, x in zip(frame.corner, cell, (r.x, r.y, r.z), strict=True))


def test_balanced_nodes_have_equal_rows(spark):
    """A cluster, a wide field and very many rows at one place: exact halves, however few rows are sorted at once."""
    rng = np.random.default_rng(8)
    at = np.concatenate([rng.normal(5, 0.01, (400, 3)), rng.uniform(0, 100, (300, 3)), np.full((333, 3), 7.0)])
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at)], "pid long, x double, y double, z double").repartition(5)
    node = np.zeros(len(at), int)
    for level in range(4):
        new = node.copy()
        for n in np.unique(node):
            own = np.flatnonzero(node == n)
            order = own[np.lexsort((own, at[own, level % 3]))]
            new[order] = 2 * n + (np.arange(len(own)) >= -(-len(own) // 2))
        node = new
    for limit in (balance.LIMIT, 20):
        got = {r.pid: r.node for r in balance.balanced(p, 4, limit).collect()}
        assert got == dict(enumerate(node.tolist()))
    assert set(Counter(got.values()).values()) <= {64, 65}


def test_nearest_within_trees(spark):
    """Rows of one node are neighbours of each other only, at the same places as in a node alone."""
    rng = np.random.default_rng(6)
    at = rng.uniform(0, 32, (300, 3))
    p = spark.createDataFrame([(i, i % 3, *map(float, x)) for i, x in enumerate(at)], "pid long, node int, x double, y double, z double")
    together = {(r.pid, r.rn): (r.nid, r.d2) for r in spatial.nearest(p, 10, "node", 20).collect()}
    alone = {(r.pid, r.rn): (r.nid, r.d2) for n in range(3) for r in spatial.nearest(p.where(f"node = {n}"), 10).collect()}
    assert together == alone and len(alone) == 3000
    with pytest.raises(ValueError):
        spatial.nearest(p.where("node < 2 OR pid < 20"), 10, "node")


def test_spheres_of_all_sizes(spark):
    """Radii from 1 to 1000: every pair, and no halo in more than 27 cells."""
    rng = np.random.default_rng(7)
    at, centre, r = rng.uniform(0, 2000, (3000, 3)), rng.uniform(0, 2000, (40, 3)), 10 ** rng.uniform(0, 3, 40)
    r[:3] = 0.0, 1.0, 1000.0
    p = spark.createDataFrame([(i, i % 2, *map(float, x)) for i, x in enumerate(at)], "pid long, node int, x double, y double, z double")
    h = spark.createDataFrame([(i, i % 2, *map(float, x), float(s)) for i, (x, s) in enumerate(zip(centre, r, strict=True))], "hid long, node int, x double, y double, z double, r double")
    inside = {(i, int(j)) for i in range(40) for j in np.flatnonzero(((at - centre[i]) ** 2).sum(1) < r[i] ** 2)}
    assert {tuple(x) for x in spatial.sphere_members(p, h).collect()} == inside and len(inside) > 1000
    assert {tuple(x) for x in spatial.sphere_members(p, h, ("node",)).collect()} == {(i, j) for i, j in inside if i % 2 == j % 2}
    assert spatial.sphere_members(p, h.limit(0)).count() == 0


def test_scatter_spreads_all_but_the_farthest(spark, sf):
    p = particles_e(spark, sf)
    pairs = spatial.nearest(p)
    assert pairs.where("rn < 33").count() == 32 * p.count()


def test_ghost_copies(spark):
    p = spark.createDataFrame([(0, 0, 1.0, 16.0, 16.0), (1, 0, 1.0, 1.0, 16.0), (2, 0, 1.0, 31.0, 1.0), (3, 0, 16.0, 16.0, 16.0)], "pid long, node int, x double, y double, z double")
    got = domain.ghosts(p, 32.0, 0.05, 2)
    assert dict(got.groupBy("pid").count().collect()) == {0: 1, 1: 3, 2: 7}
    assert tuple(got.where("pid = 0").select("node", "x").first()) == (1, 33.0)
    assert domain.ghosts(p, 32.0, 0.05, 1).where("pid = 0").first().node == 0  # one node sends to itself


def test_nodes_agree_with_one_box(spark, sf):
    """Cell by cell, with halos across the nodes' faces; the buffer holds all rows, so each node sees what the one box sees."""
    p = particles_e(spark, sf).where("x > 22 AND x < 42 AND y > 22 AND y < 42 AND z > 22 AND z < 42")
    halos = halos_e(p)
    one = {(r.ix, r.iy, r.iz): r for r in fields.clumping_field(p, halos, 64.0, 8).collect()}
    grid = fields.node_fields(p, halos, 32.0, 2, 0.5, 4)
    many = {(r.gx, r.gy, r.gz): r for r in mesh.merged(grid, 4, 2).collect()}
    assert sum(r.halo for r in one.values()) > 100
    for at, r in one.items():
        for c in ("n", "halo"):
            assert math.isclose(r[c], many[at][c] if at in many else 0.0, rel_tol=1e-6, abs_tol=1e-6)
        if r.n > 1e-2:
            assert all(math.isclose(r[c], many[at][c], rel_tol=1e-4, abs_tol=1e-6) for c in ("c", "vx", "vy", "vz"))
    assert all(r.n < 1e-6 for at, r in many.items() if at not in one)


def test_witnesses_join_what_all_links_join(spark):
    rng = np.random.default_rng(5)
    at = np.concatenate([rng.normal(c, 0.3, (80, 3)) for c in (0, 2, 5)] + [rng.uniform(-5, 10, (120, 3)), np.full((20, 3), 7.0)])
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at)], "pid long, x double, y double, z double")
    every, few = spatial.links(p, 0.6), spatial.witnesses(p, 0.6)
    assert rows(components(every)) == rows(components(few)) and few.count() < every.count() / 3
    got = dict(groups.friends(p, 0.6).collect())
    assert len(set(got.values())) > 10 and max(Counter(got.values()).values()) > 60


def test_groups_are_numbered_over_ranges(spark):
    sizes = spark.createDataFrame([(7 * i % 1009,) for i in range(1009)], "root long").repartition(7)
    assert rows(groups.numbered(sizes, "root", "igrp")) == [(i, i + 1) for i in range(1009)]


def test_invalid_halos_stop_the_job(spark, sf):
    halos = halos_e(particles_e(spark, sf))
    assert groups.invalid_halos(halos, DELTA).where("NOT ok").count() == halos.where("hid % 150 = 0").count() > 0
    with pytest.raises(Exception, match="overdensity"):
        groups.require_valid(halos, DELTA).agg(F.sum("r")).collect()
    good = halos.where("hid % 150 <> 0")
    assert groups.require_valid(good, DELTA).count() == good.count()


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_momentum_undoes_the_mean(spark):
    m = spark.createDataFrame([(0, 0, 0, 2.0, 1.0, 0.5, 3.0, 4.0, 5.0)], "ix int, iy int, iz int, n double, halo double, c double, vx double, vy double, vz double")
    out = mesh.momentum(mesh.normalise(m, 64.0, 16)).first()
    assert (out.n, out.ntot, out.vx, out.vz) == (16.0, 24.0, 3.0, 5.0)


def test_fof_field_moves_groups_to_the_halo_plane(spark, sf):
    grid, found = fields.fof_field(particles_e(spark, sf), 1.5, 64.0, 8)
    assert found.first().nfof == 201
    assert math.isclose(grid.agg(F.sum("halo")).first()[0], 8 * 201, rel_tol=1e-6)


def test_options():
    c = parse(["-xv", "64", "-nc", "32,64", "-l", "0.3", "-l", "0.4"])
    assert (c.boxsize, c.nc, c.link) == (64.0, (32, 64), 0.6)
    assert parse(["-nc_node_dim", "16", "-mesh_scale", "2"]).box == 32.0
    with pytest.raises(ValueError):
        RunConfig(boxsize=64.0, buffer_factor=0.6)
    with pytest.raises(ValueError):
        RunConfig()


def put(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)


def test_xv_and_zip(spark, tmp_path):
    xv = np.arange(12, dtype="<f4")
    put(tmp_path / "node0/0.000xv0.dat", np.array([2], "<i4").tobytes() + bytes(44) + xv.tobytes())
    base = f"file://{tmp_path}/node"
    assert rows(binary.read_xv(spark, base, "0.000", (1, 0, 0)).select("x", "y", "vz")) == [(-1.0, 1.0, 5.0), (5.0, 7.0, 11.0)]
    assert rows(binary.read_headers(spark, base, "0.000")) == [(0, 2)]
    # 2**3 cells: one row in the first, 300 (escaped) in the last
    head = np.zeros(16, "<f4")
    head[13] = 4.0
    raw = bytearray(head.tobytes())
    raw[:4] = np.array([301], "<i4").tobytes()
    put(tmp_path / "node1/0.000zip0_1.dat", bytes(raw) + bytes([0, 255, 128]) * 301)
    put(tmp_path / "node1/0.000zip1_1.dat", bytes(64) + np.tile(np.array([4, -8, 2], "<i2"), 301).tobytes())
    put(tmp_path / "node1/0.000zip2_1.dat", bytes([1, 0, 0, 0, 0, 0, 0, 255]))
    put(tmp_path / "node1/0.000zip3_1.dat", np.array([300], "<i4").tobytes())
    z = binary.read_zip(spark, base, "0.000", 2, 2.0)
    assert z.count() == 301
    assert tuple(z.orderBy("pid").first())[2:] == (0.00390625, 1.99609375, 1.00390625, 1.0, -2.0, 0.5)
    assert z.where("x > 2 AND y > 2 AND z > 2").count() == 300
    put(tmp_path / "node1/0.000zip3_1.dat", np.array([299], "<i4").tobytes())
    with pytest.raises(Exception, match="zip files of node 1"):
        z.count()


def test_halos(spark, tmp_path):
    rec = np.zeros((2, 22), "<f4")
    rec[:, :3], rec[:, 3], rec[:, 5], rec[:, 4], rec[:, 6] = [[70, -70, 5], [1, 2, 3]], 8, 2, 6, 1
    content = bytes(12) + b"".join(r.tobytes() + bytes(1600) for r in rec)
    put(tmp_path / "node0/0.000halo0.dat", content + b"cut")
    got = binary.read_halos(spark, f"file://{tmp_path}/node", "0.000", 64.0, pids=True)
    assert rows(got.select("x", "y", "z", "r", "mass")) == [(1.0, 2.0, 3.0, 2.0, 8.0), (6.0, -6.0, 5.0, 2.0, 8.0)]
    assert binary.read_halos(spark, f"file://{tmp_path}/node", "0.000", 64.0, "200c", pids=True).first().mass == 6.0


def test_grid_files_and_catalogue(spark, tmp_path):
    cells = [(3, i % 2, i // 2 % 2, i // 4, float(i), float(-i)) for i in range(7)]
    m = spark.createDataFrame(cells, "node int, ix int, iy int, iz int, n double, halo double")
    m = m.withColumns({c: F.lit(0.5) for c in ("c", "vx", "vy", "vz")})
    base = f"file://{tmp_path}/so/nc2/0.000"
    assert sorted(r.bytes for r in writers.write_grids(m, base, 2)) == [36, 36, 36, 100]
    assert rows(binary.read_grid(spark, base, "n")) == sorted([c[:5] for c in cells] + [(3, 1, 1, 1, 0.0)])  # a cell that is missing is 0
    with open(tmp_path / "so/nc2/0.000n3.dat", "ab") as f:
        f.write(b"more")
    with pytest.raises(Exception, match="bytes"):
        binary.read_grid(spark, base, "n").count()
    g = spark.createDataFrame([(0, 2, 9.0, 2.0, 3.0, 4.0, 5.0, 6.0, 21), (0, 1, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 20)], "node int, igrp int, x double, y double, z double, vx double, vy double, vz double, nfof int")
    writers.write_catalogue(g, f"file://{tmp_path}/fof")
    c = open(f"{tmp_path}/fof0.dat", "rb").read()
    assert np.frombuffer(c[:8], "<i4").tolist() == [2, 28] and np.frombuffer(c[8:32], "<f4").tolist() == [1, 2, 3, 4, 5, 6] and np.frombuffer(c[32:36], "<i4").tolist() == [20] and np.frombuffer(c[-8:], "<i4").tolist() == [21, 2]


def grid_cells(spark, nc=6, nodes=2):
    cells = [(n, i % nc, i // nc % nc, i // nc**2, float(i + 1), float(n)) for n in range(nodes) for i in range(nc**3)]
    m = spark.createDataFrame(cells, "node int, ix int, iy int, iz int, n double, halo double")
    return m.withColumns({c: F.col("n") * k for k, c in enumerate(("c", "vx", "vy", "vz"))}).repartition(7)


def test_tasks_write_one_file_side_by_side(spark, tmp_path):
    """Cells in any order, by many tasks, into one file; nothing but it and its manifest stays."""
    m = grid_cells(spark).withColumnsRenamed({f"i{a}": f"g{a}" for a in "xyz"}).where("node = 0")
    spark.dataSource.register(binary.GridSource)
    base = f"file://{tmp_path}/all.dat"
    m.select("gx", "gy", "gz", "n", "c").write.format("grid_file").mode("append").options(base=base, nc=6, layout="global", columns="n,c", manifest=f"{base}.manifest", order=">").save()
    got = binary.read_grid(spark, base, "", 2, ">", 3).select("ix", "iy", "iz", "v0", "v1")
    assert rows(got) == rows(m.select("gx", "gy", "gz", "n", "c"))
    assert sorted(os.listdir(tmp_path)) == ["all.dat", "all.dat.manifest"] and os.path.getsize(tmp_path / "all.dat") == 12 + 8 * 216
    assert ranges.stale(f"{base}.manifest", {}, content=True) == []


def test_failed_tasks_leave_nothing(spark, tmp_path):
    """A job whose task fails removes what its other tasks wrote, and keeps the file that was there."""
    base = f"file://{tmp_path}/0.000"
    writers.write_grids(grid_cells(spark), base, 6)
    before = {n: (tmp_path / n).read_bytes() for n in os.listdir(tmp_path)}
    wrong = grid_cells(spark).withColumn("n", F.when((F.col("node") == 1) & (F.col("iz") == 5), F.raise_error(F.lit("lost")).cast("double")).otherwise(0.0))
    with pytest.raises(Exception, match="lost"):
        writers.write_grids(wrong, base, 6)
    assert {n: (tmp_path / n).read_bytes() for n in os.listdir(tmp_path)} == before and len(before) == 8


def test_stores_that_write_whole_files_only(spark, tmp_path, monkeypatch):
    """Pieces of a file are put together at the commit, holes included."""
    options = {"base": f"file://{tmp_path}/g", "nc": "6", "order": "<", "manifest": f"file://{tmp_path}/m"}
    monkeypatch.setattr(ranges, "written_in_place", lambda store: False)
    writer = binary.GridSource(options).writer(None, False)
    parts = [pa.RecordBatch.from_pandas(x.toPandas()) for x in (grid_cells(spark).where("iz < 2"), grid_cells(spark).where("iz >= 4 AND node = 1"))]
    writer.commit([writer.write(iter([p])) for p in parts] + [None])
    got = binary.read_grid(spark, options["base"], "n").where("v0 <> 0").select("node", "ix", "iy", "iz", "v0")
    assert rows(got) == rows(grid_cells(spark).where("iz < 2 OR (iz >= 4 AND node = 1)").select("node", "ix", "iy", "iz", "n"))
    assert len(os.listdir(tmp_path)) == 9 and ranges.stale(options["manifest"], {}, content=True) == []


def test_numbering_of_nodes_over_ranges(spark):
    p = spark.createDataFrame([(i % 3 if i % 5 else 0, 1000 - i) for i in range(600)], "node int, pid long").repartition(5)
    got = writers.numbered(p, "pid").collect()
    for node in range(3):
        own = sorted((r.pid, r.at, r.n) for r in got if r.node == node)
        assert [r[1] for r in own] == list(range(len(own))) and {r[2] for r in own} == {len(own)}


@pytest.fixture
def node_files(spark, tmp_path):
    """Four nodes of 250 rows, and their grids."""
    rng = np.random.default_rng(3)
    at = np.concatenate([rng.integers(0, 16 * 256, (900, 3)) / 256 + 1 / 512, np.full((100, 3), 1 / 512)])
    p = spark.createDataFrame([(i % 4, i, *map(float, x), 1.0, 2.0, float(i)) for i, x in enumerate(at)], "node int, pid long, x double, y double, z double, vx double, vy double, vz double")
    base = f"file://{tmp_path}/node"
    writers.write_xv(p, base, "0.000")
    writers.write_zip(p.where("node < 2").unionByName(p.where("node = 1 AND pid >= 900").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19)))).drop("k")), base, "0.000", 16, 1.0, 4.0)
    writers.write_grids(grid_cells(spark, 6, 3), f"{base}s", 6)
    return base


def test_bounds_leave_files_and_ranges_out(spark, node_files):
    """Bounds on node, row number and plane reach the reader: files and ranges that can't match have no partition."""
    parts, own = lambda df: df.rdd.getNumPartitions(), 3 << 40
    whole = binary.read_xv(spark, node_files, "0.000", rows=100)
    assert parts(whole) == 12 and whole.count() == 1000
    some = (({"node": (3, 3)}, "node = 3", 3), ({"node": [0, 2, 3]}, "node IN (0, 2, 3)", 9), ({"node": [2]}, "node = 2", 3), ({"pid": (own + 120, own + 129)}, f"pid BETWEEN {own + 120} AND {own + 129}", 1), ({"node": (1, 3), "pid": (own + 249, 1 << 50)}, f"pid >= {own + 249}", 1), ({"node": (9, 9)}, "node = 9", 1))
    for where, same, n in some:
        df = binary.read_xv(spark, node_files, "0.000", rows=100, where=where)
        assert parts(df) == n and rows(df) == rows(whole.where(same)), where
    grid = lambda where: binary.read_grid(spark, f"{node_files}s", "n", rows=36, where=where)
    assert parts(grid(None)) == 18 and parts(grid({"iz": (2, 3), "node": (1, 1)})) == 2
    assert rows(grid({"iz": (5, 5), "node": (2, 2)}).select("v0")) == [(float(i + 1),) for i in range(180, 216)]
    with pytest.raises(Exception, match="no bounds on x"):
        binary.read_xv(spark, node_files, "0.000", where={"x": (0, 1)}).count()


def test_zip_ranges_begin_at_their_blocks(spark, node_files, monkeypatch):
    """With an index a range reads the counts of its own blocks; rows are those that are read without."""
    plain = rows(binary.read_zip(spark, node_files, "0.000", 16, 1.0))
    assert rows(binary.read_zip(spark, node_files, "0.000", 16, 1.0, rows=60, block=256)) == plain and len(plain) == 1000
    index = binary.zip_index(spark, node_files, "0.000", 16, block=256)
    reader = binary.ZipReader({"base": node_files, "redshift": "0.000", "nc_node_dim": "16", "mesh_scale": "1", "range": "20", "block": "256", "index": index})
    read = []
    real = binary.ZipReader.counts
    monkeypatch.setattr(binary.ZipReader, "counts", lambda self, *a: (read.append(x[0]) or x for x in real(self, *a)))
    for r in reader.partitions():
        if r.first:
            read.clear()
            assert sum(b.num_rows for b in reader.read(r)) == r.last - r.first
            assert len(read) <= 4 and read[0] == 256 * r.start[0]


def test_stream_goes_on_after_its_checkpoint(spark, node_files, tmp_path):
    """Each redshift comes once, also when the query is stopped and started again."""
    for z in ("1.000", "2.000"):
        for n in range(4):
            put(tmp_path / f"node{n}/{z}xv{n}.dat", open(tmp_path / f"node{n}/0.000xv{n}.dat", "rb").read())
    lines = tmp_path / "redshifts.txt"

    def go(text):
        lines.write_text(text)
        stream = snapshot_stream(spark, node_files, f"file://{lines}")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
        return {r.redshift: r["count"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("redshift").count().collect()}

    assert go("0.000\n") == {"0.000": 1000}
    assert go("0.000\n") == {"0.000": 1000}
    assert go("0.000\n1.000\n2.0") == {"0.000": 1000, "1.000": 1000}  # a line that is not whole waits
    assert go("0.000\n1.000\n2.000\n") == {"0.000": 1000, "1.000": 1000, "2.000": 1000}


def test_large_sparse_files_open(spark, tmp_path):
    """A file of more than 2 GB, nearly all of it a hole: its rows are read by ranges."""
    n = 100_000_000
    os.makedirs(tmp_path / "node0")
    with open(tmp_path / "node0/0.000xv0.dat", "wb") as f:
        f.write(np.array([n], "<i4").tobytes())
        f.seek(48 + 24 * (n - 1))
        f.write(np.arange(6, dtype="<f4").tobytes())
    got = binary.read_xv(spark, f"file://{tmp_path}/node", "0.000", rows=1 << 24)
    assert got.rdd.getNumPartitions() == 6
    assert rows(binary.read_headers(spark, f"file://{tmp_path}/node", "0.000")) == [(0, n)]
    one = Range(0, f"{tmp_path}/node0/0.000xv0.dat", n - 2, n)
    reader = binary.XvReader({"base": f"file://{tmp_path}/node", "redshift": "0.000"})
    assert [b.column("vz").to_pylist() for b in reader.read(one)] == [[0.0, 5.0]]


def test_text_inputs(spark, tmp_path):
    put(tmp_path / "redshifts.txt", b"10.000\n\n6.5 extra\n")
    assert rows(binary.read_redshifts(spark, f"file://{tmp_path}/redshifts.txt")) == [("10.000", 10.0), ("6.5", 6.5)]
    put(tmp_path / "shift.txt", b"10.0 1 2 3\n")
    assert binary.read_shift(spark, f"file://{tmp_path}/shift.txt") == (1.0, 2.0, 3.0)
    assert binary.read_shift(spark, f"file://{tmp_path}/none.txt") == (0.0, 0.0, 0.0)


def test_stream_of_snapshots(spark, sf, tmp_path):
    p = particles_e(spark, sf).withColumn("redshift", F.lit("6.0"))
    p.write.parquet(f"file://{tmp_path}/in")
    q = field_stream(spark, f"file://{tmp_path}/in", p.schema, lambda d: d.agg(F.count("*").alias("n")), f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    q.awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").agg(F.sum("n")).first()[0] == p.count()


def test_groups_need_twenty(spark):
    tags = groups.large_groups(spark.createDataFrame([(i, 5) for i in range(20)] + [(i, 99) for i in range(30, 49)], "pid long, root long"))
    assert dict(tags.groupBy("igrp").count().collect()) == {1: 20, 0: 19}


def test_entry_names():
    assert set(registry.ORACLES) == set(registry.QUERIES) <= set(entry.queries())
