"""Queries of the field operators over the given tables, with DuckDB SQL for each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.functions import kernels
from lumengrid.operators import balance, domain, groups, histogram, mesh, spatial
from lumengrid.plans import fields
from lumengrid.plans.views import BOX, DELTA, HE, PE, PV, halos_e, particles_e, particles_v

NC, EDGE, NODES, LINK, OMEGA = 16, 32.0, 2, 1.5, 0.308
CELL = BOX / NC
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def r6(x: Column | str) -> Column:
    # adding 0 turns -0 into 0
    return F.round(x, 6) + F.lit(0.0)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _log(x: Column) -> Column:
    """Clumping is ill-conditioned in nearly empty cells, so it is compared as a rounded logarithm."""
    return F.round(F.log10(x), 5) + F.lit(0.0)


# domain decomposition

_SIDE = lambda a, box, bf: f"(({a} >= {bf * box!r}::DOUBLE)::INT + ({a} > {(1 - bf) * box!r}::DOUBLE)::INT)"
_BF_V, _BF_E = 0.05, 0.25


@query(f"WITH {PV} SELECT pid, {_SIDE('x', BOX, _BF_V)} + 3 * {_SIDE('y', BOX, _BF_V)} + 9 * {_SIDE('z', BOX, _BF_V)} AS region FROM pv")
def region_code(spark, sf_dir) -> DataFrame:
    return particles_v(spark, sf_dir).select("pid", domain.region(BOX, _BF_V).alias("region"))


_NODES = "nd AS (SELECT pid, floor(x / 32e0)::INT AS cx, floor(y / 32e0)::INT AS cy, floor(z / 32e0)::INT AS cz, x - 32e0 * floor(x / 32e0) AS x, y - 32e0 * floor(y / 32e0) AS y, z - 32e0 * floor(z / 32e0) AS z FROM {p})"


@query(f"WITH {PV}, {_NODES.format(p='pv')} SELECT pid, cx + 2 * cy + 4 * cz AS node, x, y, z FROM nd")
def node_index(spark, sf_dir) -> DataFrame:
    return domain.to_nodes(particles_v(spark, sf_dir), EDGE, NODES).select("pid", "node", "x", "y", "z")


def _ghost_sql(bf: float) -> str:
    s = ", ".join(f"{_SIDE(a, EDGE, bf)} - 1 AS s{a}" for a in "xyz")
    one = lambda a, e: f"SELECT * EXCLUDE (s{a}), unnest(CASE WHEN s{a} = 0 THEN [0] ELSE [0, s{a}] END) AS d{a} FROM {e}"
    return f"""sd AS (SELECT *, {s} FROM nd), e1 AS ({one('x', 'sd')}), e2 AS ({one('y', 'e1')}), e3 AS ({one('z', 'e2')}),
gh AS (SELECT pid, (cx + dx + 2) % 2 + 2 * ((cy + dy + 2) % 2) + 4 * ((cz + dz + 2) % 2) AS node, x - dx * 32e0 AS x, y - dy * 32e0 AS y, z - dz * 32e0 AS z FROM e3 WHERE dx <> 0 OR dy <> 0 OR dz <> 0)"""


@query(f"WITH {PV}, {_NODES.format(p='pv')}, {_ghost_sql(_BF_V)} SELECT pid, cx + 2 * cy + 4 * cz AS node, x, y, z, false AS is_ghost FROM nd UNION ALL SELECT pid, node, x, y, z, true FROM gh")
def ghost_exchange(spark, sf_dir) -> DataFrame:
    return domain.exchange(domain.to_nodes(particles_v(spark, sf_dir), EDGE, NODES), EDGE, _BF_V, NODES).select("pid", "node", "x", "y", "z", "is_ghost")


@query(f"WITH {PE}, {_NODES.format(p='pe')}, {_ghost_sql(_BF_E)}, a AS (SELECT pid, cx + 2 * cy + 4 * cz AS node, x, y, z, false AS is_ghost FROM nd UNION ALL SELECT pid, node, x, y, z, true FROM gh) SELECT * FROM a WHERE x > -3.2e0 AND x < 35.2e0 AND y > -3.2e0 AND y < 35.2e0 AND z > -3.2e0 AND z < 35.2e0")
def crop(spark, sf_dir) -> DataFrame:
    rows = domain.exchange(domain.to_nodes(particles_e(spark, sf_dir), EDGE, NODES), EDGE, _BF_E, NODES)
    return domain.crop(rows, EDGE, 0.1).select("pid", "node", "x", "y", "z", "is_ghost")


@query(f"WITH {PV}, s AS (SELECT pid, x - 40e0 AS x, y * 3e0 - 90e0 AS y, z + 10.5e0 AS z FROM pv) SELECT pid, x - 32e0 * trunc(x / 32e0) AS x, y - 32e0 * trunc(y / 32e0) AS y, z - 32e0 * trunc(z / 32e0) AS z FROM s")
def shift_wrap(spark, sf_dir) -> DataFrame:
    moved = domain.shifted(particles_v(spark, sf_dir).withColumn("y", F.col("y") * 3.0), (40.0, 90.0, -10.5))
    return moved.select("pid", *(domain.fold(F.col(a), 32.0).alias(a) for a in "xyz"))


@query("SELECT event_id AS pid, 2e0 * ((event_id * 37 % 256 + 0.5e0) / 256e0 + user_id % 16) - 0.25e0 AS x, ((event_id * 131 + user_id) % 65536 - 32768) / 512e0 AS vx FROM events")
def zip_decode(spark, sf_dir) -> DataFrame:
    from lumengrid.sources.binary import decoded_position, decoded_velocity

    packed = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("pid"), (F.col("event_id") * 37 % 256).alias("u8"), (F.col("user_id") % 16).alias("cell"), ((F.col("event_id") * 131 + F.col("user_id")) % 65536 - 32768).alias("i16"))
    return packed.select("pid", decoded_position(F.col("u8"), F.col("cell"), 2.0, 0.25).alias("x"), decoded_velocity(F.col("i16"), 512.0).alias("vx"))


_HALVED = "l0 AS (SELECT *, 0 AS node FROM pv), " + ", ".join(f"l{i + 1} AS (SELECT * REPLACE (2 * node + (row_number() OVER (PARTITION BY node ORDER BY {a}, pid) > ceil(count(*) OVER (PARTITION BY node) / 2e0))::INT AS node) FROM l{i})" for i, a in enumerate("xyzx"))


@query(f"WITH {PV}, {_HALVED} SELECT node, count(*) AS n, " + ", ".join(f"min({a}) AS low_{a}, max({a}) AS high_{a}" for a in "xyz") + " FROM l4 GROUP BY node")
def balanced_nodes(spark, sf_dir) -> DataFrame:
    return balance.node_bounds(balance.balanced(particles_v(spark, sf_dir), 4))


# neighbours and density

_PAIRS = """on_one AS MATERIALIZED (SELECT *, 0 AS box FROM pe),
pr AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, nid) AS rn FROM (
  SELECT a.pid, b.pid AS nid, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM on_one a JOIN on_one b USING (box))) WHERE rn <= 33),
rk AS MATERIALIZED (SELECT pid, sqrt(d2) AS rk FROM pr WHERE rn = 33)"""
_TRI = "(1e0 - abs(dx) / rk) * (1e0 - abs(dy) / rk) * (1e0 - abs(dz) / rk) / (rk * rk * rk)"
_SPL = "CASE WHEN sqrt(d2) / rk < 0.5e0 THEN 1e0 - 6e0 * (sqrt(d2) / rk) * (sqrt(d2) / rk) + 6e0 * (sqrt(d2) / rk) * (sqrt(d2) / rk) * (sqrt(d2) / rk) ELSE 2e0 * (1e0 - sqrt(d2) / rk) * (1e0 - sqrt(d2) / rk) * (1e0 - sqrt(d2) / rk) END * (8e0 / pi()) / (rk * rk * rk)"
_DENS = lambda w: f"ds AS MATERIALIZED (SELECT nid AS pid, sum({w}) AS dens FROM pr JOIN rk USING (pid) WHERE rn < 33 GROUP BY nid), dn AS MATERIALIZED (SELECT pid, rk, coalesce(dens, 0) AS dens FROM rk LEFT JOIN ds USING (pid))"


@query(f"WITH {PE}, {_PAIRS} SELECT pid, nid, rn::INT AS rn, d2 FROM pr")
def knn_pairs(spark, sf_dir) -> DataFrame:
    return spatial.nearest(particles_e(spark, sf_dir)).select("pid", "nid", "rn", "d2")


@query(f"WITH {PE}, {_PAIRS} SELECT pid, round(rk, 6) AS rk FROM rk")
def smoothing_length(spark, sf_dir) -> DataFrame:
    return spatial.smoothing_length(spatial.nearest(particles_e(spark, sf_dir))).select("pid", r6("rk").alias("rk"))


@query(f"WITH {PE}, {_PAIRS}, {_DENS(_TRI)} SELECT pid, round(rk, 6) AS rk, round(dens, 6) AS dens FROM dn")
def scatter_density(spark, sf_dir) -> DataFrame:
    return fields.with_density(particles_e(spark, sf_dir)).select("pid", r6("rk").alias("rk"), r6("dens").alias("dens"))


@query(f"WITH {PE}, {_PAIRS}, {_DENS(_SPL)} SELECT pid, round(rk, 6) AS rk, round(dens, 6) AS dens FROM dn")
def scatter_density_spline(spark, sf_dir) -> DataFrame:
    return fields.with_density(particles_e(spark, sf_dir), kernel="spline").select("pid", r6("rk").alias("rk"), r6("dens").alias("dens"))


# halos

@query("SELECT DISTINCT user_id % 11 AS z, round((18e0 * pi() * pi() + 82e0 * x - 39e0 * x * x) * e / 0.308e0, 6) AS delta FROM (SELECT user_id, e, 0.308e0 / e - 1e0 AS x FROM (SELECT user_id, 0.308e0 + 0.692e0 * (1e0 / (1e0 + user_id % 11)) * (1e0 / (1e0 + user_id % 11)) * (1e0 / (1e0 + user_id % 11)) AS e FROM events))")
def delta_vir(spark, sf_dir) -> DataFrame:
    z = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 11).alias("z")).distinct()
    return z.select("z", r6(kernels.virial_overdensity(F.col("z").cast("double"), F.lit(OMEGA))).alias("delta"))


@query(f"WITH {PE}, {HE}, o AS (SELECT hid, mass / (4e0 / 3e0 * pi() * r * r * r) AS delta FROM he) SELECT hid, round(delta, 6) AS delta, abs(delta - {DELTA!r}::DOUBLE) < 10e0 AS ok FROM o")
def halo_validate(spark, sf_dir) -> DataFrame:
    return groups.invalid_halos(halos_e(particles_e(spark, sf_dir)), DELTA).select("hid", r6("delta").alias("delta"), "ok")


_SO = "so AS (SELECT hid, pid FROM pe p, he h WHERE (p.x - h.x) * (p.x - h.x) + (p.y - h.y) * (p.y - h.y) + (p.z - h.z) * (p.z - h.z) < h.r * h.r)"


@query(f"WITH {PE}, {HE}, {_SO} SELECT pid, CASE WHEN pid IN (SELECT pid FROM so) THEN -1 ELSE 0 END AS igrp FROM pe")
def so_members(spark, sf_dir) -> DataFrame:
    p = particles_e(spark, sf_dir)
    return spatial.mark_members(p, halos_e(p)).select("pid", "igrp")


@query(f"WITH {PE}, {HE}, {_SO} SELECT hid, count(*) AS n FROM so GROUP BY hid")
def so_counts(spark, sf_dir) -> DataFrame:
    p = particles_e(spark, sf_dir)
    return spatial.sphere_members(p, halos_e(p)).groupBy("hid").agg(F.count("*").alias("n"))


@query(f"WITH {PE}, {HE}, {_SO}, e AS (SELECT sum(mass / 8e0) AS expected FROM he), m AS (SELECT count(*) AS marked FROM so) SELECT round(expected, 6) AS expected, marked, expected <= 100 OR abs(marked / expected - 1e0) < 0.2e0 AS ok FROM e, m")
def halo_mass_check(spark, sf_dir) -> DataFrame:
    p = particles_e(spark, sf_dir)
    h = halos_e(p)
    return groups.halo_mass_check(spatial.sphere_members(p, h), h).select(r6("expected").alias("expected"), "marked", "ok")


# grids

_F = lambda t: f"(sign({t}) * CASE WHEN abs({t}) < 1e0 THEN abs({t}) - abs({t}) * abs({t}) / 2e0 ELSE 0.5e0 END)"


def _cells_sql(source: str, periodic: bool = False) -> str:
    """Table cl: every row of source once for each cell, with w."""
    lo = (lambda a: f"floor(({a} - rk) / {CELL!r}::DOUBLE)::INT") if periodic else (lambda a: f"greatest(0, trunc(({a} - rk) / {CELL!r}::DOUBLE)::INT)")
    hi = (lambda a: f"ceil(({a} + rk) / {CELL!r}::DOUBLE)::INT + 1") if periodic else (lambda a: f"least({NC}, 1 + trunc(({a} + rk) / {CELL!r}::DOUBLE)::INT)")
    steps, last = [], source
    for k, a in enumerate("xyz"):
        steps.append(f"c{k} AS (SELECT *, unnest(range({lo(a)}, {hi(a)}))::INT AS j{a} FROM {last})")
        last = f"c{k}"
    s = lambda a: f"((j{a} * {CELL!r}::DOUBLE - {a}) / rk)"
    w = " * ".join(f"({_F(f'({s(a)} + {CELL!r}::DOUBLE / rk)')} - {_F(s(a))})" for a in "xyz")
    wrap = (lambda a: f"((j{a} % {NC}) + {NC}) % {NC}") if periodic else (lambda a: f"j{a}")
    return ", ".join(steps) + f", cl AS (SELECT *, {', '.join(f'{wrap(a)} AS i{a}' for a in 'xyz')}, {w} AS w FROM {last})"


_ROWS = f"{PE}, {HE}, {_SO}, {_PAIRS}, {_DENS(_TRI)}, rw AS (SELECT pe.*, rk, dens, CASE WHEN pid IN (SELECT pid FROM so) THEN -1 ELSE 0 END AS igrp FROM pe JOIN dn USING (pid))"
_SUMS = "ms AS (SELECT ix, iy, iz, sum(CASE WHEN igrp >= 0 THEN w ELSE 0 END) AS n, sum(CASE WHEN igrp < 0 THEN w ELSE 0 END) AS halo, sum(CASE WHEN igrp >= 0 THEN w * dens ELSE 0 END) AS c, " + ", ".join(f"sum(CASE WHEN igrp >= 0 THEN w * v{a} ELSE 0 END) AS v{a}" for a in "xyz") + " FROM cl GROUP BY ix, iy, iz)"
_MESH = f"WITH {_ROWS}, {_cells_sql('rw')}, {_SUMS}"


def _rows(spark, sf_dir) -> DataFrame:
    p = particles_e(spark, sf_dir)
    return spatial.mark_members(fields.with_density(p), halos_e(p))


def _planes(m: DataFrame, *keys: str) -> DataFrame:
    return m.select(*keys, *(r6(c).alias(c) for c in m.columns if c not in keys))


_R = lambda *cs: ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in cs)


@query(f"{_MESH} SELECT ix, iy, iz, {_R('n', 'halo', 'c', 'vx', 'vy', 'vz')} FROM ms")
def mesh_assign(spark, sf_dir) -> DataFrame:
    return _planes(mesh.assign(_rows(spark, sf_dir), BOX, NC), "ix", "iy", "iz")


@query(f"WITH {_ROWS}, gs AS (SELECT * FROM rw WHERE igrp >= 0), {_cells_sql('gs')} SELECT ix, iy, iz, round(sum(w), 6) + 0e0 AS n FROM cl GROUP BY ix, iy, iz")
def mesh_density(spark, sf_dir) -> DataFrame:
    return _planes(mesh.assign_density(_rows(spark, sf_dir), BOX, NC), "ix", "iy", "iz")


@query(f"WITH {_ROWS}, {_cells_sql('rw', True)}, {_SUMS} SELECT ix, iy, iz, {_R('n', 'halo', 'c', 'vx', 'vy', 'vz')} FROM ms")
def mesh_global(spark, sf_dir) -> DataFrame:
    return _planes(mesh.assign(_rows(spark, sf_dir), BOX, NC, periodic=True), "ix", "iy", "iz")


_NORM = f"nm AS (SELECT ix, iy, iz, n * 8e0 AS n, halo * 8e0 AS halo, CASE WHEN n > 0 THEN c * {CELL**3!r}::DOUBLE / (n * n) ELSE 0 END AS c, " + ", ".join(f"CASE WHEN n > 0 THEN v{a} / n ELSE 0 END AS v{a}" for a in "xyz") + " FROM ms)"


@query(f"{_MESH}, {_NORM} SELECT ix, iy, iz, {_R('n', 'halo')}, CASE WHEN n > 1e-5 THEN round(log10(c), 5) + 0e0 END AS log_c, " + ", ".join(f"CASE WHEN n > 1e-5 THEN round(v{a}, 5) + 0e0 END AS v{a}" for a in "xyz") + " FROM nm")
def mesh_normalise(spark, sf_dir) -> DataFrame:
    p = particles_e(spark, sf_dir)
    return _compared(fields.clumping_field(p, halos_e(p), BOX, NC), "ix", "iy", "iz")


def _compared(m: DataFrame, *keys: str) -> DataFrame:
    """All cells; quotients of nearly nothing, which differ in the last digits of n, count as unknown."""
    some = F.col("n") > 1e-5
    v = (F.when(some, F.round(f"v{a}", 5) + F.lit(0.0)).alias(f"v{a}") for a in "xyz")
    return m.select(*keys, r6("n").alias("n"), r6("halo").alias("halo"), F.when(some, _log(F.col("c"))).alias("log_c"), *v)


@query(f"{_MESH}, t AS (SELECT sum(n + halo) AS total FROM ms), e AS (SELECT count(*) AS expected FROM pe) SELECT round(total, 6) AS total, expected, abs(total / expected - 1e0) < 0.001e0 AS ok FROM t, e")
def mass_check(spark, sf_dir) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return mesh.mass_check(mesh.assign(rows, BOX, NC), rows).select(r6("total").alias("total"), "expected", "ok")


# each cell of the 16**3 grid belongs to one of 2**3 nodes of 8**3 cells

_BY_NODE = "nn AS (SELECT ix // 8 + 2 * (iy // 8) + 4 * (iz // 8) AS node, ix % 8 AS ix, iy % 8 AS iy, iz % 8 AS iz, n, halo, vx, vy, vz FROM nm)"
_GLOBAL = "gl AS (SELECT (node % 2 * 8 + ix)::INT AS gx, (node // 2 % 2 * 8 + iy)::INT AS gy, (node // 4 % 2 * 8 + iz)::INT AS gz, n, halo, vx, vy, vz FROM nn)"


def _node_grids(spark, sf_dir) -> DataFrame:
    p = particles_e(spark, sf_dir)
    m = fields.clumping_field(p, halos_e(p), BOX, NC)
    half = lambda a: F.floor(F.col(a) / F.lit(8)).cast("int")
    return m.select((half("ix") + 2 * half("iy") + 4 * half("iz")).alias("node"), *((F.col(a) % 8).alias(a) for a in ("ix", "iy", "iz")), "n", "halo", "vx", "vy", "vz")


@query(f"{_MESH}, {_NORM}, {_BY_NODE}, {_GLOBAL} SELECT gx, gy, gz, {_R('n', 'halo')} FROM gl")
def grid_merge(spark, sf_dir) -> DataFrame:
    return mesh.merged(_node_grids(spark, sf_dir), 8, NODES).select("gx", "gy", "gz", r6("n").alias("n"), r6("halo").alias("halo"))


@query(f"{_MESH}, {_NORM}, {_BY_NODE}, {_GLOBAL} SELECT gx, gy, gz, {_R('n')}, round(n + halo, 6) AS ntot, " + ", ".join(f"round(v{a} * n / 8e0, 6) + 0e0 AS v{a}" for a in "xyz") + " FROM gl")
def grid_momentum(spark, sf_dir) -> DataFrame:
    return _planes(mesh.momentum(mesh.merged(_node_grids(spark, sf_dir), 8, NODES)).select("gx", "gy", "gz", "n", "ntot", "vx", "vy", "vz"), "gx", "gy", "gz")


@query(f"{_MESH}, {_NORM}, {_BY_NODE}, {_GLOBAL} SELECT gx, gz, CASE WHEN n > 1e-5 THEN round(log10(n / 0.9765625e0), 5) + 0e0 END AS log_ratio FROM gl WHERE gy = 8 AND n > 0")
def grid_slice_log(spark, sf_dir) -> DataFrame:
    m = mesh.slice_log(mesh.merged(_node_grids(spark, sf_dir), 8, NODES), 8, 0.9765625)
    return m.select("gx", "gz", F.when(F.col("log_ratio") > math.log10(1e-5 / 0.9765625), F.round("log_ratio", 5) + F.lit(0.0)).alias("log_ratio"))


@query(f"{_MESH}, {_NORM}, {_BY_NODE}, {_GLOBAL} SELECT round(sum(n / 8e0), 6) AS n_rows, round(sum((n + halo) / 8e0), 6) AS all_rows FROM gl")
def grid_totals(spark, sf_dir) -> DataFrame:
    return mesh.totals(mesh.merged(_node_grids(spark, sf_dir), 8, NODES)).select(r6("n_rows").alias("n_rows"), r6("all_rows").alias("all_rows"))


@query(f"{_MESH}, {_NORM}, {_BY_NODE}, {_GLOBAL} SELECT (gz::BIGINT * 16 + gy) * 16 + gx AS place, {_R('n')} FROM gl ORDER BY place")
def grid_ordered(spark, sf_dir) -> DataFrame:
    return mesh.in_order(mesh.merged(_node_grids(spark, sf_dir), 8, NODES), 2 * 8).select(F.col("at").alias("place"), r6("n").alias("n"))


@query(f"WITH {_ROWS}, sh AS (SELECT * REPLACE (x - 24e0 AS x, y + 8e0 AS y) FROM rw), ins AS (SELECT * FROM sh WHERE x >= 0 AND x < 64 AND y >= 0 AND y < 64 AND z >= 0 AND z < 64), {_cells_sql('ins', True)}, {_SUMS} SELECT ix, iy, iz, {_R('n', 'halo', 'c')} FROM ms")
def mesh_interior(spark, sf_dir) -> DataFrame:
    moved = _rows(spark, sf_dir).withColumn("x", F.col("x") - 24.0).withColumn("y", F.col("y") + 8.0)
    return _planes(mesh.assign(mesh.interior(moved, BOX), BOX, NC, periodic=True).select("ix", "iy", "iz", "n", "halo", "c"), "ix", "iy", "iz")


# many nodes

_NODE_BF, _NODE_NC = 0.2, 8
_PADDED = " AND ".join(f"{a} > {-_NODE_BF * EDGE!r}::DOUBLE AND {a} < {EDGE + _NODE_BF * EDGE!r}::DOUBLE" for a in "xyz")


def _node_cells_sql() -> str:
    cell = EDGE / _NODE_NC
    lo = lambda a: f"greatest(0, trunc(({a} - rk) / {cell!r}::DOUBLE)::INT)"
    hi = lambda a: f"least({_NODE_NC}, 1 + trunc(({a} + rk) / {cell!r}::DOUBLE)::INT)"
    steps, last = [], "rw"
    for k, a in enumerate("xyz"):
        steps.append(f"c{k} AS (SELECT *, unnest(range({lo(a)}, {hi(a)}))::INT AS i{a} FROM {last})")
        last = f"c{k}"
    s = lambda a: f"((i{a} * {cell!r}::DOUBLE - {a}) / rk)"
    w = " * ".join(f"({_F(f'({s(a)} + {cell!r}::DOUBLE / rk)')} - {_F(s(a))})" for a in "xyz")
    return ", ".join(steps) + f", cl AS (SELECT *, {w} AS w FROM {last})"


def _exchanged_sql(source: str, columns: str, name: str) -> str:
    """Table name: the rows of source (global positions) and their ghosts by node, cropped."""
    s = ", ".join(f"{_SIDE(a, EDGE, _NODE_BF)} - 1 AS s{a}" for a in "xyz")
    one = lambda a, e: f"SELECT * EXCLUDE (s{a}), unnest(CASE WHEN s{a} = 0 THEN [0] ELSE [0, s{a}] END) AS d{a} FROM {e}"
    local = f"SELECT {columns}, floor(x / 32e0)::INT AS cx, floor(y / 32e0)::INT AS cy, floor(z / 32e0)::INT AS cz, x - 32e0 * floor(x / 32e0) AS x, y - 32e0 * floor(y / 32e0) AS y, z - 32e0 * floor(z / 32e0) AS z FROM {source}"
    return f"""{name}0 AS ({local}), {name}1 AS (SELECT *, {s} FROM {name}0), {name}2 AS ({one('x', name + '1')}), {name}3 AS ({one('y', name + '2')}), {name}4 AS ({one('z', name + '3')}),
{name} AS (SELECT * FROM (SELECT {columns}, (cx + dx + 2) % 2 + 2 * ((cy + dy + 2) % 2) + 4 * ((cz + dz + 2) % 2) AS node, dx <> 0 OR dy <> 0 OR dz <> 0 AS is_ghost, x - dx * 32e0 AS x, y - dy * 32e0 AS y, z - dz * 32e0 AS z FROM {name}4) WHERE {_PADDED})"""


_NODE_ROWS = f"""WITH {PE}, {HE}, {_exchanged_sql('pe', 'pid, vx, vy, vz', 'np')}, {_exchanged_sql('he', 'hid, r, mass', 'nh')},
pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node, pid ORDER BY d2, nid) AS rn FROM (
  SELECT a.node, a.pid, b.pid AS nid, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM np a JOIN np b USING (node))) WHERE rn <= 33),
rk AS (SELECT node, pid, sqrt(d2) AS rk FROM pr WHERE rn = 33),
dn AS (SELECT node, nid AS pid, sum({_TRI}) AS dens FROM pr JOIN rk USING (node, pid) WHERE rn < 33 GROUP BY node, nid),
so AS (SELECT DISTINCT np.node, np.pid FROM np JOIN nh ON np.node = nh.node AND (np.x - nh.x) * (np.x - nh.x) + (np.y - nh.y) * (np.y - nh.y) + (np.z - nh.z) * (np.z - nh.z) < nh.r * nh.r),
rw AS (SELECT np.*, rk, coalesce(dens, 0) AS dens, CASE WHEN so.pid IS NULL THEN 0 ELSE -1 END AS igrp FROM np JOIN rk USING (node, pid) LEFT JOIN dn USING (node, pid) LEFT JOIN so USING (node, pid))"""
_NODE_MESH = f"{_NODE_ROWS}, {_node_cells_sql()}, {_SUMS.replace('ms AS (SELECT ix', 'ms AS (SELECT node, ix').replace('GROUP BY ix', 'GROUP BY node, ix')}"
_NODE_NORM = _NORM.replace("nm AS (SELECT ix", "nm AS (SELECT node, ix").replace(f"{CELL**3!r}", f"{(EDGE / _NODE_NC) ** 3!r}")


@query(f"{_NODE_ROWS} SELECT node, pid, is_ghost, round(rk, 6) AS rk, round(dens, 6) + 0e0 AS dens, igrp FROM rw")
def node_rows(spark, sf_dir) -> DataFrame:
    p = particles_e(spark, sf_dir)
    local = [domain.to_nodes(d, EDGE, NODES) for d in (p, halos_e(p))]
    rows = fields.node_rows(*local, EDGE, NODES, _NODE_BF)
    return rows.select("node", F.floor(F.col("pid") / F.lit(NODES**3)).alias("pid"), "is_ghost", r6("rk").alias("rk"), r6("dens").alias("dens"), "igrp")


@query(f"{_NODE_MESH}, {_NODE_NORM} SELECT node, ix, iy, iz, {_R('n', 'halo')}, CASE WHEN n > 1e-5 THEN round(log10(c), 5) + 0e0 END AS log_c, " + ", ".join(f"CASE WHEN n > 1e-5 THEN round(v{a}, 5) + 0e0 END AS v{a}" for a in "xyz") + " FROM nm")
def node_fields(spark, sf_dir) -> DataFrame:
    p = particles_e(spark, sf_dir)
    return _compared(fields.node_fields(p, halos_e(p), EDGE, NODES, _NODE_BF, _NODE_NC), "node", "ix", "iy", "iz")


# groups

_EDGES = f"ed AS (SELECT a.pid AS a, b.pid AS b FROM pe a, pe b WHERE a.pid < b.pid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {LINK * LINK!r}::DOUBLE)"
_FOF = f"WITH RECURSIVE {PE}, {_EDGES}, bo AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed), rc AS (SELECT pid, pid AS other FROM pe UNION SELECT rc.pid, bo.b FROM rc JOIN bo ON bo.a = rc.other), fg AS (SELECT pid, min(other) AS root FROM rc GROUP BY pid)"
_TAGS = "sz AS (SELECT root, count(*) AS n FROM fg GROUP BY root HAVING count(*) >= 20), tg AS (SELECT pid, coalesce(igrp, 0)::INT AS igrp FROM fg LEFT JOIN (SELECT root, row_number() OVER (ORDER BY root) AS igrp FROM sz) USING (root))"


@query(f"WITH {PE}, {_EDGES} SELECT a, b FROM ed")
def fof_edges(spark, sf_dir) -> DataFrame:
    return spatial.links(particles_e(spark, sf_dir), LINK)


@query(f"{_FOF} SELECT pid, root FROM fg")
def fof_groups(spark, sf_dir) -> DataFrame:
    return groups.friends(particles_e(spark, sf_dir), LINK)


@query(f"{_FOF}, {_TAGS} SELECT pid, igrp FROM tg")
def fof_filtered(spark, sf_dir) -> DataFrame:
    return groups.large_groups(groups.friends(particles_e(spark, sf_dir), LINK))


@query(f"{_FOF}, {_TAGS} SELECT igrp, " + ", ".join(f"round(avg({c}), 6) + 0e0 AS {c}" for c in ("x", "y", "z", "vx", "vy", "vz")) + f", count(*) AS nfof FROM pe JOIN tg USING (pid) WHERE igrp > 0 GROUP BY igrp HAVING min(x) IS NOT NULL AND {' AND '.join(f'avg({a}) > 0 AND avg({a}) < {BOX!r}::DOUBLE' for a in 'xyz')}")
def fof_catalogue(spark, sf_dir) -> DataFrame:
    p = particles_e(spark, sf_dir)
    return _planes(groups.catalogue(p, groups.large_groups(groups.friends(p, LINK)), BOX), "igrp", "nfof")


# histograms and sizes

_BIN = "trunc((x - 16e0) / 32e0 * 8)::INT"
_HIST = f"SELECT {_BIN} AS bin, count(*) AS n, round(sum(x), 6) AS total FROM {{p}} WHERE x >= 16e0 AND x < 48e0 GROUP BY 1"


@query(f"WITH {PE} {_HIST.format(p='pe')}")
def histogram_counts(spark, sf_dir) -> DataFrame:
    h = histogram.histogram(particles_e(spark, sf_dir), F.col("x"), 16.0, 48.0, 8)
    return h.select("bin", "n", r6("total").alias("total"))


@query(f"WITH {PE}, h AS ({_HIST.format(p='pe')}), t AS (SELECT count(*) AS ntot FROM pe) SELECT 16e0 + (bin + 0.5e0) * 4e0 AS centre, round(n / ntot / 4e0, 9) AS density FROM h, t")
def histogram_pdf(spark, sf_dir) -> DataFrame:
    p = particles_e(spark, sf_dir)
    d = histogram.pdf(histogram.histogram(p, F.col("x"), 16.0, 48.0, 8), p, 16.0, 48.0, 8)
    return d.select("centre", F.round("density", 9).alias("density"))


@query(f"WITH {PE}, {PV}, u AS (SELECT x FROM pe UNION ALL SELECT x FROM pv) {_HIST.format(p='u')}")
def histogram_merge(spark, sf_dir) -> DataFrame:
    parts = [histogram.histogram(p, F.col("x"), 16.0, 48.0, 8) for p in (particles_e(spark, sf_dir), particles_v(spark, sf_dir))]
    return histogram.merge(*parts).select("bin", "n", r6("total").alias("total"))


_PER_NODE = f"WITH {PV}, {_NODES.format(p='pv')}, pn AS (SELECT cx + 2 * cy + 4 * cz AS node, count(*) AS np FROM nd GROUP BY 1)"


def _per_node(spark, sf_dir) -> DataFrame:
    return domain.to_nodes(particles_v(spark, sf_dir), EDGE, NODES).groupBy("node").agg(F.count("*").alias("np"))


@query(f"{_PER_NODE} SELECT max(np) AS np_max FROM pn")
def np_max(spark, sf_dir) -> DataFrame:
    return _per_node(spark, sf_dir).agg(F.max("np").alias("np_max"))


@query(f"{_PER_NODE} SELECT node, np, (20e0 * (2e0 * pow(2e0, greatest(0, ceil(log2(np / 16e0)))) - 1e0))::BIGINT AS tree_bytes, ceil(np * {36.0 * (1.0 + 2.0 * 0.05) ** 3!r}::DOUBLE)::BIGINT AS particle_bytes FROM pn")
def mem_estimate(spark, sf_dir) -> DataFrame:
    return _per_node(spark, sf_dir).select("node", "np", kernels.tree_bytes(F.col("np")).alias("tree_bytes"), kernels.particle_bytes(F.col("np"), 0.05).alias("particle_bytes"))
