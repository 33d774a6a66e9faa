"""Queries that write the given tables' particles, halos and grids in the binary formats and read them back, with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumengrid.config import RunConfig
from lumengrid.functions import kernels
from lumengrid.operators import domain, groups, histogram, mesh
from lumengrid.plans import registry as q
from lumengrid.plans import run as program
from lumengrid.plans.views import BOX, HE, PE, halos_e, particles_e
from lumengrid.session import scratch
from lumengrid.sources import binary, nodes, writers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: A redshift as it stands in file names, rows of a task (few, so that files are read in several ranges), scale of velocities.
Z, RANGE, SCALE = "0.000", 50, 512.0
MESH_SCALE = 2.0
COARSE = int(q.EDGE / MESH_SCALE)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return f"{scratch(spark)}/files-{uuid.uuid4().hex}"


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.to_nodes(particles_e(spark, sf_dir), q.EDGE, q.NODES)


_ND = f"WITH {PE}, {q._NODES.format(p='pe').replace('SELECT pid,', 'SELECT pid, vx, vy, vz,')}, nn AS (SELECT *, cx + 2 * cy + 4 * cz AS node FROM nd)"
_NUMBERED = "node::BIGINT * 1099511627776 + row_number() OVER (PARTITION BY node ORDER BY pid) - 1 AS pid"
_XV = f"{_ND} SELECT node, {_NUMBERED}, x, y, z, vx, vy, vz FROM nn"


@query(_XV)
def format_xv(spark, sf_dir) -> DataFrame:
    base = f"{_folder(spark)}/node"
    writers.write_xv(_local(spark, sf_dir), base, Z)
    return binary.read_xv(spark, base, Z, rows=RANGE)


@query(_XV.replace("x, y, z, vx", "x - 0.5e0 AS x, y + 1e0 AS y, z - 2e0 AS z, vx"))
def format_xv_big_endian(spark, sf_dir) -> DataFrame:
    base = f"{_folder(spark)}/node"
    writers.write_xv(_local(spark, sf_dir), base, Z, ">")
    return binary.read_xv(spark, base, Z, (0.5, -1.0, 2.0), ">", RANGE)


@query(f"{_ND} SELECT node, count(*) AS np FROM nn GROUP BY node")
def format_headers(spark, sf_dir) -> DataFrame:
    base = f"{_folder(spark)}/node"
    writers.write_xv(_local(spark, sf_dir), base, Z)
    return binary.read_headers(spark, base, Z)


def _zip_sql(a: str) -> str:
    return f"2e0 * (floor({a} / 2e0 * 256e0) + 0.5e0) / 256e0 AS {a}, round(v{a} * 512e0) / 512e0 + 0e0 AS v{a}"


@query(f"{_ND} SELECT node, {', '.join(_zip_sql(a) for a in 'xyz')}, count(*) AS n FROM nn GROUP BY ALL")
def format_zip(spark, sf_dir) -> DataFrame:
    base = f"{_folder(spark)}/node"
    writers.write_zip(_local(spark, sf_dir), base, Z, COARSE, MESH_SCALE, SCALE)
    out = binary.read_zip(spark, base, Z, COARSE, MESH_SCALE, rows=RANGE)
    return out.groupBy("node", "x", "y", "z", "vx", "vy", "vz").agg(F.count("*").alias("n"))


@query(f"{_ND} SELECT node, {', '.join(_zip_sql(a) for a in 'xyz')}, count(*) AS n FROM nn GROUP BY ALL")
def format_zip_big_endian(spark, sf_dir) -> DataFrame:
    base = f"{_folder(spark)}/node"
    writers.write_zip(_local(spark, sf_dir), base, Z, COARSE, MESH_SCALE, SCALE, ">")
    out = binary.read_zip(spark, base, Z, COARSE, MESH_SCALE, order=">", rows=RANGE)
    return out.groupBy("node", "x", "y", "z", "vx", "vy", "vz").agg(F.count("*").alias("n"))


_HALOS = f"WITH {PE}, {HE}, {q._NODES.format(p='he').replace('SELECT pid,', 'SELECT hid, r, mass,')}, nh AS (SELECT *, cx + 2 * cy + 4 * cz AS node FROM nd)"
_HALO_ROWS = f"{_HALOS} SELECT node, node::BIGINT * 1099511627776 + row_number() OVER (PARTITION BY node ORDER BY hid) - 1 AS hid, x, y, z, r::FLOAT::DOUBLE AS r, mass::FLOAT::DOUBLE AS mass FROM nh"


@query(_HALO_ROWS)
def format_halo22(spark, sf_dir) -> DataFrame:
    base = f"{_folder(spark)}/node"
    writers.write_halos(domain.to_nodes(halos_e(particles_e(spark, sf_dir)), q.EDGE, q.NODES), base, Z, pids=True)
    return binary.read_halos(spark, base, Z, q.EDGE, pids=True)


@query(_HALO_ROWS)
def format_halo17(spark, sf_dir) -> DataFrame:
    base = f"{_folder(spark)}/node"
    writers.write_halos(domain.to_nodes(halos_e(particles_e(spark, sf_dir)), q.EDGE, q.NODES), base, Z, 17, order=">")
    return binary.read_halos(spark, base, Z, q.EDGE, layout=17, order=">")


# cells that no row touches are 0 in a file; mass only, as quotients of nearly nothing differ in their last digits
_ALL = f"al AS (SELECT node, ix, iy, iz FROM range({q.NODES**3}) a(node), range(8) b(ix), range(8) c(iy), range(8) d(iz))"


@query(f"{q._MESH}, {q._NORM}, {q._BY_NODE}, {_ALL}, kd AS (SELECT DISTINCT node FROM nn) SELECT al.node::INT AS node, al.ix::INT AS ix, al.iy::INT AS iy, al.iz::INT AS iz, round(coalesce(n, 0)::FLOAT::DOUBLE, 4) + 0e0 AS n, round(coalesce(halo, 0)::FLOAT::DOUBLE, 4) + 0e0 AS halo, CASE WHEN n::FLOAT::DOUBLE > 1e-3 THEN round(vy::FLOAT::DOUBLE, 3) + 0e0 END AS vy FROM al JOIN kd USING (node) LEFT JOIN nn ON (nn.node, nn.ix, nn.iy, nn.iz) = (al.node, al.ix, al.iy, al.iz)")
def format_grid(spark, sf_dir) -> DataFrame:
    base = f"{_folder(spark)}/so/nc8/{Z}"
    grids = q._node_grids(spark, sf_dir).withColumn("c", F.lit(0.0))
    writers.write_grids(grids, base, 8)
    cell = ["node", "ix", "iy", "iz"]
    n, halo = (binary.read_grid(spark, base, kind).withColumnRenamed("v0", name) for kind, name in (("n", "n"), ("h", "halo")))
    vel = binary.read_grid(spark, base, "vel", 3)
    r4 = lambda c: (F.round(c, 4) + F.lit(0.0)).alias(c)
    return n.join(halo, cell).join(vel, cell).select(*cell, r4("n"), r4("halo"), F.when(F.col("n") > 1e-3, F.round("v1", 3) + F.lit(0.0)).alias("vy"))


@query(f"{q._MESH}, {q._NORM}, {q._BY_NODE}, {q._GLOBAL} SELECT ix::INT AS ix, iy::INT AS iy, iz::INT AS iz, round(coalesce(n, 0)::FLOAT::DOUBLE, 4) + 0e0 AS n, round((coalesce(n, 0) + coalesce(halo, 0))::FLOAT::DOUBLE, 4) + 0e0 AS ntot FROM range(16) a(ix), range(16) b(iy), range(16) c(iz) LEFT JOIN gl ON (gl.gx, gl.gy, gl.gz) = (ix, iy, iz)")
def format_global_grid(spark, sf_dir) -> DataFrame:
    folder = _folder(spark)
    whole = mesh.momentum(mesh.merged(q._node_grids(spark, sf_dir), 8, q.NODES))
    for c in ("n", "ntot"):
        writers.write_global(whole, f"{folder}/{Z}{c}_all.dat", 16, [c])
    n, ntot = (binary.read_grid(spark, f"{folder}/{Z}{c}_all.dat", "", words=3) for c in ("n", "ntot"))
    r4 = lambda c, name: (F.round(c, 4) + F.lit(0.0)).alias(name)
    return n.join(ntot.withColumnRenamed("v0", "t"), ["ix", "iy", "iz"]).select("ix", "iy", "iz", r4("v0", "n"), r4("t", "ntot"))


@query(f"{q._MESH} SELECT 16 AS nc, 6 AS dof, 64e0 AS box, round(sum(n::FLOAT::DOUBLE), 3) AS n, round(sum(halo::FLOAT::DOUBLE), 3) AS halo, round(sum(vx::FLOAT::DOUBLE), 3) + 0e0 AS vx FROM ms")
def format_combined(spark, sf_dir) -> DataFrame:
    base = f"{_folder(spark)}/all"
    whole = mesh.assign(q._rows(spark, sf_dir), BOX, q.NC).withColumn("node", F.lit(0))
    writers.write_combined(whole, base, q.NC, BOX)
    sums = [(F.round(F.sum(c), 3) + F.lit(0.0)).alias(c) for c in ("n", "halo", "vx")]
    nc = F.cbrt(F.count("*")).cast("int").alias("nc")
    return binary.read_combined(spark, base, rows=1000).groupBy("dof", "box").agg(nc, *sums).select("nc", "dof", "box", "n", "halo", "vx")


@query(f"{q._FOF}, {q._TAGS} SELECT 0 AS node, " + ", ".join(f"round(avg({c})::FLOAT::DOUBLE, 3) + 0e0 AS {c}" for c in ("x", "y", "z", "vx", "vy", "vz")) + ", count(*)::INT AS nfof FROM pe JOIN tg USING (pid) WHERE igrp > 0 GROUP BY igrp")
def format_catalogue(spark, sf_dir) -> DataFrame:
    base = f"{_folder(spark)}/fof"
    p = particles_e(spark, sf_dir)
    found = groups.catalogue(p, groups.large_groups(groups.friends(p, q.LINK)), BOX)
    writers.write_catalogue(found.withColumn("node", F.lit(0)), base)
    return writers.read_catalogue(spark, base).select("node", *((F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")), "nfof")


@query(f"WITH {PE}, h AS (SELECT trunc((x - 16e0) / 32e0 * 8)::INT AS bin, count(*) AS n, sum(x) AS total FROM pe WHERE x >= 16e0 AND x < 48e0 GROUP BY 1) SELECT b::INT AS bin, 16e0 + b * 4e0 AS low, 20e0 + b * 4e0 AS high, coalesce(n, 0) AS n, (SELECT count(*) FROM pe) AS ntot, (SELECT sum(total) FROM h)::FLOAT::DOUBLE AS total FROM range(8) r(b) LEFT JOIN h ON h.bin = b")
def format_histogram(spark, sf_dir) -> DataFrame:
    p, path = particles_e(spark, sf_dir), f"{_folder(spark)}/pdf.dat"
    writers.write_histogram(histogram.histogram(p, F.col("x"), 16.0, 48.0, 8), p, path, 16.0, 48.0, 8)
    return writers.read_histogram(spark, path)


@query(f"{_HALOS}, gh AS (SELECT hid, node, x, y, z, mass / (4e0 / 3e0 * pi() * r * r * r) AS delta FROM nh) SELECT node, count(*) AS n, count(*) FILTER (WHERE abs(delta - {q.DELTA!r}::DOUBLE) < 10e0) AS valid FROM gh GROUP BY node")
def format_halo_check(spark, sf_dir) -> DataFrame:
    base = f"{_folder(spark)}/node"
    writers.write_halos(domain.to_nodes(halos_e(particles_e(spark, sf_dir)), q.EDGE, q.NODES), base, Z)
    h = binary.read_halos(spark, base, Z, q.EDGE)
    ok = F.abs(kernels.overdensity(F.col("mass"), F.col("r")) - q.DELTA) < 10.0
    return h.groupBy("node").agg(F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("valid"))


# node files read together: the crop of the exchanged rows is at the buffer's edge, which all ghosts are within


@query(f"WITH {PE}, {q._exchanged_sql('pe', 'pid, vx, vy, vz', 'ex')} SELECT node, x, y, z, vx, is_ghost FROM ex")
def format_xv_all(spark, sf_dir) -> DataFrame:
    base = f"{_folder(spark)}/node"
    writers.write_xv(_local(spark, sf_dir), base, Z)
    rows = nodes.all_xv(spark, base, Z, q.EDGE, q.NODES, q._NODE_BF)
    return domain.crop(rows, q.EDGE, q._NODE_BF).select("node", "x", "y", "z", "vx", "is_ghost")


@query(f"WITH {PE}, {HE}, {q._exchanged_sql('he', 'hid, r, mass', 'ex')} SELECT node, x, y, z, is_ghost, abs(mass::FLOAT::DOUBLE / (4e0 / 3e0 * pi() * r * r * r) - {q.DELTA!r}::DOUBLE) <= 0.1e0 AS ok FROM ex")
def format_halo_all(spark, sf_dir) -> DataFrame:
    base = f"{_folder(spark)}/node"
    writers.write_halos(domain.to_nodes(halos_e(particles_e(spark, sf_dir)), q.EDGE, q.NODES), base, Z, 17)
    return nodes.all_halos(spark, base, Z, q.EDGE, q.NODES, q._NODE_BF, q.DELTA).select("node", "x", "y", "z", "is_ghost", "ok")


# the run program: node files in, grids and catalogues out, read back


def _config(spark: SparkSession, sf_dir: str, **own) -> RunConfig:
    """Node files of the particles and of the halos with the right density, a list of one redshift, and a run over them."""
    folder, p = _folder(spark), particles_e(spark, sf_dir)
    writers.write_xv(_local(spark, sf_dir), f"{folder}/node", Z)
    writers.write_halos(domain.to_nodes(halos_e(p).where("hid % 150 <> 0"), q.EDGE, q.NODES), f"{folder}/node", Z)
    store, path = binary.opened(f"{folder}/redshifts.txt")
    with store.open_output_stream(path) as f:
        f.write(f"{Z}\n".encode())
    # rows are not as many as the catalogue's mass asks for
    return RunConfig(boxsize=q.EDGE, nodes_per_axis=q.NODES, buffer_factor=q._NODE_BF, nc=(q._NODE_NC,), omega_m=q.OMEGA, redshifts=f"{folder}/redshifts.txt", node_dir=f"{folder}/node", shift_dir=folder, out_dir=f"{folder}/out", halo_tolerance=100.0, **own)


_VALID_NODE_MESH = f"{q._NODE_MESH}, {q._NODE_NORM}".replace("pid % 50 = 0", "pid % 50 = 0 AND pid % 150 <> 0")
_AS_FILES = "ff AS (SELECT (node % 2 * 8 + ix)::INT AS ix, (node // 2 % 2 * 8 + iy)::INT AS iy, (node // 4 % 2 * 8 + iz)::INT AS iz, n::FLOAT::DOUBLE AS n, halo::FLOAT::DOUBLE AS halo, vy::FLOAT::DOUBLE AS vy FROM nm)"


@query(f"{_VALID_NODE_MESH}, {_AS_FILES} SELECT i::INT AS ix, j::INT AS iy, k::INT AS iz, round(coalesce(n, 0)::FLOAT::DOUBLE, 4) + 0e0 AS n, round(coalesce(n + halo, 0)::FLOAT::DOUBLE, 4) + 0e0 AS ntot, round(coalesce(vy * n / 8e0, 0)::FLOAT::DOUBLE, 3) + 0e0 AS py FROM range(16) a(i), range(16) b(j), range(16) c(k) LEFT JOIN ff ON (ff.ix, ff.iy, ff.iz) = (i, j, k)")
def run_fields(spark, sf_dir) -> DataFrame:
    c = _config(spark, sf_dir)
    program.run(spark, c)
    base, out = f"{c.out_dir}/so/nc{q._NODE_NC}/{Z}", f"{c.out_dir}/global/{Z}"
    program.merge(spark, base, out, q._NODE_NC, q.NODES)
    n, ntot = (binary.read_grid(spark, f"{out}{k}_all.dat", "", words=3, rows=1000) for k in ("n", "ntot"))
    v = binary.read_grid(spark, f"{out}v_all.dat", "", 3, words=3, rows=1000)
    cell, r = ["ix", "iy", "iz"], lambda c, d, name: (F.round(c, d) + F.lit(0.0)).alias(name)
    both = n.withColumnRenamed("v0", "n").join(ntot.withColumnRenamed("v0", "t"), cell).join(v, cell)
    return both.select(*cell, r("n", 4, "n"), r("t", 4, "ntot"), r("v1", 3, "py"))


_NODE_FOF = f"""WITH RECURSIVE {PE}, {q._exchanged_sql('pe', 'pid, vx, vy, vz', 'np')},
ed AS (SELECT a.node, a.pid AS a, b.pid AS b FROM np a JOIN np b USING (node) WHERE a.pid <> b.pid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {q.LINK * q.LINK!r}::DOUBLE),
rc AS (SELECT node, pid, pid AS other FROM np UNION SELECT rc.node, rc.pid, ed.b FROM rc JOIN ed ON ed.node = rc.node AND ed.a = rc.other),
fg AS (SELECT node, pid, min(other) AS root FROM rc GROUP BY ALL),
ct AS (SELECT node, {', '.join(f'avg({c}) AS {c}' for c in ('x', 'y', 'z', 'vx', 'vy', 'vz'))}, count(*)::INT AS nfof FROM np JOIN fg USING (node, pid) GROUP BY node, root HAVING count(*) >= 20)"""


@query(f"{_NODE_FOF} SELECT node, " + ", ".join(f"round({c}::FLOAT::DOUBLE, 3) + 0e0 AS {c}" for c in ("x", "y", "z", "vx", "vy", "vz")) + f", nfof FROM ct WHERE {' AND '.join(f'{a} > 0 AND {a} < {q.EDGE!r}::DOUBLE' for a in 'xyz')}")
def run_groups(spark, sf_dir) -> DataFrame:
    c = _config(spark, sf_dir, fof=True, halos=False, linking_length=q.LINK / 2)
    program.run(spark, c)
    return writers.read_catalogue(spark, f"{c.out_dir}/fof/{Z}fof").select("node", *((F.round(x, 3) + F.lit(0.0)).alias(x) for x in ("x", "y", "z", "vx", "vy", "vz")), "nfof")


_CROP_BF = 0.1
_INSIDE = " AND ".join(f"{a} > {-_CROP_BF * q.EDGE!r}::DOUBLE AND {a} < {q.EDGE + _CROP_BF * q.EDGE!r}::DOUBLE" for a in "xyz")


@query(f"WITH {PE}, {q._NODES.format(p='pe')}, {q._ghost_sql(q._BF_E)}, a AS (SELECT x, y, z, false AS is_ghost FROM nd UNION ALL SELECT x, y, z, true FROM gh) SELECT count(*) FILTER (WHERE {_INSIDE}) AS kept, count(*) FILTER (WHERE NOT ({_INSIDE})) AS removed, count(*) FILTER (WHERE NOT ({_INSIDE}) AND NOT is_ghost) AS removed_local FROM a")
def crop_counts(spark, sf_dir) -> DataFrame:
    seen = Observation()
    rows = domain.exchange(domain.to_nodes(particles_e(spark, sf_dir), q.EDGE, q.NODES), q.EDGE, q._BF_E, q.NODES)
    domain.crop_counted(rows, q.EDGE, _CROP_BF, seen).write.format("noop").mode("overwrite").save()
    counts = seen.get  # three numbers of the job that read the rows
    return spark.createDataFrame([(counts["kept"], counts["removed"], counts["removed_local"])], "kept bigint, removed bigint, removed_local bigint")
