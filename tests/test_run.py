"""The run program from node files to grids and global files."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.config import parse
from lumengrid.operators import domain, mesh
from lumengrid.plans import fields, run
from lumengrid.plans.views import DELTA, halos_e, particles_e
from lumengrid.sources import binary, ranges, writers

Z, EDGE, NODES, BUFFER, NC = "0.000", 32.0, 2, 0.2, 4


@pytest.fixture(scope="module")
def files(spark, sf, tmp_path_factory):
    """Node files of both formats, halos, a redshift list and a shift of nothing."""
    folder = tmp_path_factory.mktemp("run")
    p = particles_e(spark, sf)
    local, halos = domain.to_nodes(p, EDGE, NODES), domain.to_nodes(halos_e(p).where("hid % 150 <> 0"), EDGE, NODES)
    for kind in ("xv", "zip"):
        base = f"file://{folder}/{kind}/node"
        writers.write_halos(halos, base, Z)
        writers.write_xv(local, base, Z) if kind == "xv" else writers.write_zip(local, base, Z, 16, 2.0, 512.0)
    (folder / "redshifts.txt").write_text(f"{Z}\n")
    return folder


def options(files, kind, *more):
    own = ["-xv", str(EDGE)] if kind == "xv" else ["-nc_node_dim", "16", "-mesh_scale", "2"]
    base = f"file://{files}"
    return parse([*own, "-node_dir", f"{base}/{kind}/node", "-pm_redshift", f"{base}/redshifts.txt", "-shift", f"{base}/shift", "-out", f"{base}/{kind}/out", "-nodes", str(NODES), "-buffer_factor", str(BUFFER), "-nc", str(NC), "-omegam", "0.308", *more])


def test_run_writes_the_grids_of_the_node_fields(spark, sf, files):
    c = options(files, "xv")
    # marks count rows with their multiplicity, which the tables' halos do not match
    c = c.__class__(**{**c.__dict__, "halo_tolerance": 10.0})
    written, report = run.run(spark, c)
    assert len(written) == 4 * NODES**3
    p = particles_e(spark, sf)
    want = {(r.node, r.ix, r.iy, r.iz): r for r in fields.node_fields(p, halos_e(p).where("hid % 150 <> 0"), EDGE, NODES, BUFFER, NC).collect()}
    base = f"{c.out_dir}/so/nc{NC}/{Z}"
    for kind, column in (("n", "n"), ("h", "halo")):
        got = {(r.node, r.ix, r.iy, r.iz): r.v0 for r in binary.read_grid(spark, base, kind).collect()}
        assert len(got) == NODES**3 * NC**3
        assert all(math.isclose(v, want[at][column] if at in want else 0.0, rel_tol=1e-5, abs_tol=1e-5) for at, v in got.items())
    table = report.table(spark).collect()
    assert {r.phase for r in table} == {"io", "so_halo", "neighbors", "cropped", f"so nc{NC}"} and math.isclose(sum(r.part for r in table), 1.0)
    # what is there is not made again
    assert run.run(spark, c)[0] == []
    totals = run.merge(spark, base, f"file://{files}/global/{Z}", NC, NODES)
    assert math.isclose(totals["all_rows"], p.count(), rel_tol=1e-3)
    v = binary.read_grid(spark, f"file://{files}/global/{Z}v_all.dat", "", 3, words=3)
    whole = mesh.momentum(mesh.merged(fields.node_fields(p, halos_e(p).where("hid % 150 <> 0"), EDGE, NODES, BUFFER, NC), NC, NODES)).agg(F.sum("vx")).first()[0]
    assert v.count() == (NC * NODES) ** 3 and math.isclose(v.agg(F.sum("v0")).first()[0], whole, rel_tol=1e-3, abs_tol=1e-3)


def test_run_of_zipped_files_and_groups(spark, sf, files):
    written, _ = run.run(spark, options(files, "zip", "-fof", "-no_halos", "-l", "0.75"))
    names = {x.rpartition("/")[2] for x in written}
    assert f"{Z}n0.dat" in names and any(x.startswith(f"{Z}fof") for x in names)
    grid = binary.read_grid(spark, f"file://{files}/zip/out/fof/nc{NC}/{Z}", "h")
    assert grid.agg(F.sum("v0")).first()[0] > 0


def test_other_settings_make_grids_anew(spark, files, tmp_path):
    """Files of the right sizes don't count if they were made with another shift or density, or aren't what was committed."""
    out = f"file://{tmp_path}/out"
    c = options(files, "xv", "-no_halos", "-out", out)
    c = c.__class__(**{**c.__dict__, "fof": True, "out_dir": out, "shift_dir": f"file://{tmp_path}"})
    grids = lambda c: len([x for x in run.run(spark, c)[0] if "/nc" in x])
    assert grids(c) == 4 * NODES**3 and grids(c) == 0
    manifest = f"{out}/fof/nc{NC}/{Z}.manifest"
    settings = ranges.committed(manifest)["settings"]
    assert ranges.stale(manifest, settings, content=True) == [] and ranges.stale(manifest, settings | {"omega_m": 1.0}) is None
    assert grids(c.__class__(**{**c.__dict__, "omega_m": 0.4})) == 4 * NODES**3
    (tmp_path / f"{Z}shift.txt").write_text(f"{Z} 0.5 0 0\n")
    assert grids(c) == 4 * NODES**3 and grids(c) == 0
    settings, path = ranges.committed(manifest)["settings"], f"{tmp_path}/out/fof/nc{NC}/{Z}n3.dat"
    with open(path, "r+b") as f:
        f.seek(40)
        f.write(b"spam")
    assert ranges.stale(manifest, settings) == [] and ranges.stale(manifest, settings, content=True) == ["n3.dat"]
    os.truncate(path, 40)
    assert ranges.stale(manifest, settings) == ["n3.dat"] and grids(c) == 4 * NODES**3


def test_wrong_mass_stops_the_run(spark, files):
    with pytest.raises(run.MassError, match="in halos of mass"):
        run.run(spark, options(files, "xv", "-replace"))


def test_halos_of_wrong_density_stop_the_run(spark, sf, files, tmp_path):
    p = particles_e(spark, sf)
    base = f"file://{tmp_path}/node"
    writers.write_xv(domain.to_nodes(p, EDGE, NODES), base, Z)
    writers.write_halos(domain.to_nodes(halos_e(p), EDGE, NODES), base, Z)
    c = options(files, "xv")
    with pytest.raises(Exception, match="overdensity"):
        run.run(spark, c.__class__(**{**c.__dict__, "node_dir": base}))


def test_shifted_rows_and_neighbour_files(spark, sf, files):
    from lumengrid.sources import nodes

    own = binary.read_xv(spark, f"file://{files}/xv/node", Z, (1.0, 2.0, 3.0))
    plain = binary.read_xv(spark, f"file://{files}/xv/node", Z)
    gap = own.join(plain.withColumnsRenamed({a: f"p{a}" for a in "xyz"}), ["node", "pid"]).select(*(F.col(f"p{a}") - F.col(a) for a in "xyz")).distinct().collect()
    assert [tuple(r) for r in gap] == [(1.0, 2.0, 3.0)]
    both = nodes.all_xv(spark, f"file://{files}/xv/node", Z, EDGE, NODES, BUFFER)
    assert both.where("NOT is_ghost").count() == plain.count() < both.count()
    halos = nodes.all_halos(spark, f"file://{files}/xv/node", Z, EDGE, NODES, BUFFER, DELTA, layout=22)
    assert np.all([r.ok for r in halos.where("NOT is_ghost").collect()])
