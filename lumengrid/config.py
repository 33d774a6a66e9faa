"""Run parameters of the field engine, as a checked record and as command-line options."""

from __future__ import annotations

import argparse
from dataclasses import dataclass


@dataclass(frozen=True)
class RunConfig:
    """nodes_per_axis cubes tile the periodic volume; boxsize is the edge of one, or with zipped snapshots nc_node_dim cells of mesh_scale are."""

    boxsize: float = -1.0  # more than 0: xv snapshots
    nodes_per_axis: int = 1
    buffer_factor: float = 0.05
    linking_length: float = 0.2  # in mean spacings of 2 units
    nc: tuple[int, ...] = (256,)
    nc_node_dim: int = 0
    mesh_scale: float = 4.0
    omega_m: float = 0.0
    redshifts: str = "redshifts.txt"
    node_dir: str = "results/node"
    shift_dir: str = "shift"
    out_dir: str = "."
    allocate: int = 512  # taken and not needed: Spark plans its memory
    halos: bool = True
    fof: bool = False
    replace: bool = False  # make grids again whose files are there
    pids: bool = False  # particle ids follow the records of halos
    order: str = "<"  # byte order of files
    halo_tolerance: float = 0.2
    mass_def: str = "vir"  # or 200c: masses and radii of halos at 200 times the mean density

    def __post_init__(self):
        if not 0 < self.buffer_factor <= 0.5:
            raise ValueError("buffer_factor must be over 0 and at most 0.5: beyond that the two faces' zones overlap")
        if self.nodes_per_axis < 1 or min(self.nc) < 1:
            raise ValueError("nodes_per_axis and nc must be positive")
        if self.mass_def not in ("vir", "200c"):
            raise ValueError("mass_def is vir or 200c")
        if self.boxsize <= 0 and self.nc_node_dim < 1:
            raise ValueError("give boxsize for xv snapshots or nc_node_dim for zipped ones")

    @property
    def zipped(self) -> bool:
        return self.boxsize <= 0

    @property
    def box(self) -> float:
        """Edge of a node's box; of zipped snapshots the coarse cells make it."""
        return self.mesh_scale * self.nc_node_dim if self.zipped else self.boxsize

    @property
    def link(self) -> float:
        """Linking length in internal units."""
        return 2.0 * self.linking_length


def parse(args: list[str]) -> RunConfig:
    """RunConfig from options; of an option that is given twice the first counts."""
    p = argparse.ArgumentParser(prog="lumengrid")
    first: set[str] = set()

    class First(argparse.Action):
        def __call__(self, parser, namespace, values, option_string=None):
            if self.dest not in first:
                first.add(self.dest)
                setattr(namespace, self.dest, values)

    for flag, kind, name in (("-xv", float, "boxsize"), ("-buffer_factor", float, "buffer_factor"), ("-l", float, "linking_length"), ("-nc_node_dim", int, "nc_node_dim"), ("-mesh_scale", float, "mesh_scale"), ("-omegam", float, "omega_m"), ("-pm_redshift", str, "redshifts"), ("-node_dir", str, "node_dir"), ("-shift", str, "shift_dir"), ("-nodes", int, "nodes_per_axis"), ("-out", str, "out_dir"), ("-allocate", int, "allocate"), ("-order", str, "order"), ("-mass", str, "mass_def")):
        p.add_argument(flag, dest=name, type=kind, default=getattr(RunConfig, name), action=First)
    for flag, name, value in (("-fof", "fof", True), ("-no_halos", "halos", False), ("-replace", "replace", True), ("-pids", "pids", True)):
        p.add_argument(flag, dest=name, action="store_const", const=value, default=getattr(RunConfig, name))
    p.add_argument("-nc", dest="nc", type=lambda s: tuple(int(x) for x in s.split(",")), default=RunConfig.nc, action=First)
    return RunConfig(**vars(p.parse_args(args)))
