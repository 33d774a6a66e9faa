"""The whole field computation: neighbours, density, halo excision, grid, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumengrid.operators import domain, groups, mesh, spatial
from lumengrid.session import materialise


def with_density(points: DataFrame, k: int = 33, kernel: str = "triangle", by: str | None = None) -> DataFrame:
    """points with rk and dens; with by, only rows with the same value of that column are neighbours."""
    return points.join(spatial.scatter_density(spatial.nearest(points, k, by), k, kernel), "pid")


def clumping_field(points: DataFrame, halos: DataFrame, boxsize: float, nc: int) -> DataFrame:
    """Normalised grid of one box, with the halos' particles apart."""
    rows = spatial.mark_members(with_density(points), halos)
    return mesh.normalise(mesh.assign(rows, boxsize, nc), boxsize, nc)


def with_ghosts(points: DataFrame, edge: float, nodes: int, buffer_factor: float, counts: Observation | None = None) -> DataFrame:
    """Rows of each node (node, pid, positions in it) and those of its neighbours within its buffer, cropped, with is_ghost.

    A ghost is a row of its own: pid becomes the old one times the number of nodes, plus the node. counts gets what the crop
    kept and removed.
    """
    every = domain.exchange(points, edge, buffer_factor, nodes)
    local = domain.crop_counted(every, edge, buffer_factor, counts) if counts else domain.crop(every, edge, buffer_factor)
    return local.withColumn("pid", F.col("pid") * F.lit(nodes**3) + F.col("node"))


def node_rows(points: DataFrame, halos: DataFrame | None, edge: float, nodes: int, buffer_factor: float, counts: Observation | None = None) -> DataFrame:
    """Rows of each node and its ghosts with rk, dens and igrp (-1 in a halo). points, halos: node and positions in it.

    All nodes are computed in one plan. Halos count for a node if their centre is strictly inside its padded box.
    """
    rows = with_density(materialise(with_ghosts(points, edge, nodes, buffer_factor, counts), "node-rows"), by="node")
    if halos is None:
        return rows.withColumn("igrp", F.lit(0))
    near = domain.exchange(halos, edge, buffer_factor, nodes).where(domain.padded(edge, buffer_factor))
    return spatial.mark_members(rows, near, ("node",))


def node_fields(points: DataFrame, halos: DataFrame, edge: float, nodes: int, buffer_factor: float, nc: int) -> DataFrame:
    """Normalised grids (node, ix, iy, iz) of a volume of nodes**3 boxes; points and halos have global positions."""
    rows = node_rows(domain.to_nodes(points, edge, nodes), domain.to_nodes(halos, edge, nodes), edge, nodes, buffer_factor)
    return mesh.normalise(mesh.assign(rows, edge, nc, keys=("node",)), edge, nc)


def fof_field(points: DataFrame, length: float, boxsize: float, nc: int, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """Grid with the members of friends-of-friends groups apart, and the groups' catalogue."""
    tagged = materialise(groups.large_groups(groups.friends(points, length), least), "tags")
    rows = with_density(points).join(tagged, "pid")
    return mesh.normalise(mesh.assign(rows, boxsize, nc, sign=1), boxsize, nc), groups.catalogue(points, tagged, boxsize)
