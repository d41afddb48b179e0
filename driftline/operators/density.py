"""Pressure: weighted density of vehicles at a clock, catchments of zones, references and ranks; and tracks sampled at a clock."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geo import length
from driftline.functions.stages import written

from .kinematics import in_order

SIGMA_M = 350.0
#: Beyond so many sigma a vehicle adds less than 8e-18 with a weight of 3, which a million of them don't bring to the third decimal.
REACH = 9.0
#: Sigmas of a cell's side, and points in which the bell is interpolated along it: the error is under 2 * 0.5^24 / sqrt(24!) = 2e-19.
SIDE, NODES = 2, 24
#: Cells of a block's side, and cells around it that can reach it.
BLOCK, AROUND = 8, math.ceil(REACH / SIDE)
#: Places that are sent in one row; more take several rows.
IN_A_ROW = 256
_X = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)
_TO_NODES = np.polynomial.chebyshev.chebvander(_X, NODES - 1).T * np.where(np.arange(NODES) > 0, 2, 1)[:, None] / NODES


def weight(level: Column) -> Column:
    return F.when(level == "ALERT", 3).when(level == "WATCH", 2).otherwise(1)


def _shares(x: np.ndarray, cell: int, side: float) -> np.ndarray:
    """For each place along one axis of its cell the shares of the cell's nodes in it."""
    return np.polynomial.chebyshev.chebvander((x - (cell + 0.5) * side) / (side / 2), NODES - 1) @ _TO_NODES


def _moments(e: np.ndarray, n: np.ndarray, w: np.ndarray, ce: int, cn: int, side: float) -> np.ndarray:
    """The places' weights, laid on the nodes of their cell."""
    return (_shares(e, ce, side) * w[:, None]).T @ _shares(n, cn, side)


def _bell(to: list[int], of: list[int], side: float, sigma: float) -> np.ndarray:
    """The bell between all nodes of some cells and of others along one axis."""
    apart = (np.array(to)[:, None] - np.array(of)[None, :])[:, None, :, None] * side + (_X[:, None] - _X[None, :])[None, :, None, :] * (side / 2)
    return np.exp(-(apart**2) / (2 * sigma * sigma)).reshape(len(to) * NODES, len(of) * NODES)


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in itertools.pairwise(at)]


def field(vehicles: DataFrame, sigma: float = SIGMA_M) -> DataFrame:
    """clock, id, density at each vehicle of the vehicles of its clock (clock, id, e_m, n_m, weight).

    The bell is interpolated between the nodes of cells, to less than a double's last bit: the weights of a cell's places are laid
    on its nodes, the nodes of near cells add up, and each place reads the sum off the nodes of its cell. So no pairs are made, and
    the work grows with the vehicles. Vehicles of one place and clock count as one of their summed weight. Cells meet in blocks; a
    block takes what its cells and those around hold on their nodes, however many vehicles these are. A vehicle whose place is not
    known has no density.
    """
    side, place = float(sigma * SIDE), ["clock", "e_m", "n_m"]
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    kind = vehicles.schema["clock"].dataType.simpleString()
    places = vehicles.filter((F.abs("e_m") < math.inf) & (F.abs("n_m") < math.inf)).groupBy(*place).agg(F.sum("weight").cast("double").alias("weight"))
    row = F.floor((F.row_number().over(Window.partitionBy("clock", "ce", "cn").orderBy("e_m", "n_m")) - 1) / IN_A_ROW)
    listed = places.withColumns({"ce": cell("e_m"), "cn": cell("n_m")}).withColumn("row", row).groupBy("clock", "ce", "cn", "row").agg(F.collect_list(F.struct("e_m", "n_m", "weight")).alias("p"))
    lists = written(listed.sortWithinPartitions("clock", "ce", "cn").select("clock", "ce", "cn", *(F.col(f"p.{c}").alias(c) for c in ("e_m", "n_m", "weight"))), "places")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of few places go as they are, the others as the sum of their cell's weights on its nodes, as far as its rows follow each other."""
        at = summed = None
        for b in batches:
            clocks, ces, cns = (b.column(c).to_pylist() for c in ("clock", "ce", "cn"))
            out = []
            for own, e, n, w in zip(zip(clocks, ces, cns, strict=True), *(_lists(b.column(c)) for c in ("e_m", "n_m", "weight")), strict=True):
                if 3 * len(e) < NODES * NODES:
                    out.append((*own, np.concatenate([e, n, w])))
                    continue
                if own != at and at is not None:
                    out.append((*at, summed.ravel()))
                m = _moments(e, n, w, *own[1:], side)
                at, summed = own, summed + m if own == at else m
            yield pack(out, b.schema.field("clock").type)
            last = b.schema.field("clock").type
        if at is not None:
            yield pack([(*at, summed.ravel())], last)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, nodes, own, last = None, {}, set(), None

        def sums():
            if not own:
                return []
            (of_e, of_n), (to_e, to_n) = ([sorted(set(axis)) for axis in zip(*cells, strict=True)] for cells in (nodes, own))
            grid = np.zeros((len(of_e), NODES, len(of_n), NODES))
            for (ce, cn), m in nodes.items():
                grid[of_e.index(ce), :, of_n.index(cn), :] = m
            total = _bell(to_e, of_e, side, sigma) @ grid.reshape(len(of_e) * NODES, -1) @ _bell(to_n, of_n, side, sigma).T
            total = total.reshape(len(to_e), NODES, len(to_n), NODES)
            return [(block[0], ce, cn, total[to_e.index(ce), :, to_n.index(cn), :].ravel()) for ce, cn in own]

        for b in batches:
            last = b.schema.field("clock").type
            for *key, ce, cn, m in zip(*(b.column(c).to_pylist() for c in ("clock", "be", "bn", "ce", "cn")), _lists(b.column("m")), strict=True):
                if key != block:
                    yield pack(sums(), last)
                    block, nodes, own = key, {}, set()
                if len(m) < NODES * NODES:
                    m = _moments(*m.reshape(3, -1), ce, cn, side).ravel()
                nodes[ce, cn] = nodes.get((ce, cn), 0) + m.reshape(NODES, NODES)
                if [ce // BLOCK, cn // BLOCK] == key[1:]:
                    own.add((ce, cn))
        if block is not None:
            yield pack(sums(), last)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            es, ns = _lists(b.column("e_m")), _lists(b.column("n_m"))
            found = [np.einsum("ij,ij->i", _shares(e, ce, side) @ f.reshape(NODES, NODES), _shares(n, cn, side)) for e, n, f, ce, cn in zip(es, ns, _lists(b.column("m")), b.column("ce").to_pylist(), b.column("cn").to_pylist(), strict=True)]
            if found:
                clocks = b.column("clock").take(pa.array(np.repeat(np.arange(len(es)), [*map(len, es)])))
                yield pa.RecordBatch.from_arrays([clocks, *map(pa.array, map(np.concatenate, (es, ns, found)))], [*place, "density"])

    pack = lambda rows, of: pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], of), *(pa.array([x[k] for x in rows], pa.int64()) for k in (1, 2)), pa.array([x[3] for x in rows], pa.list_(pa.float64()))], ["clock", "ce", "cn", "m"])
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - AROUND) / BLOCK), F.floor((F.col(c) + AROUND) / BLOCK)))
    on_nodes = f"clock {kind}, ce long, cn long, m array<double>"
    laid = lists.mapInArrow(lay, on_nodes).withColumn("be", near("ce")).withColumn("bn", near("cn")).repartition("clock", "be", "bn").sortWithinPartitions("clock", "be", "bn")
    density = lists.join(laid.select("clock", "be", "bn", "ce", "cn", "m").mapInArrow(meet, on_nodes), ["clock", "ce", "cn"]).select("clock", "ce", "cn", "e_m", "n_m", "m").mapInArrow(read, f"clock {kind}, e_m double, n_m double, density double")
    return vehicles.filter("clock IS NOT NULL").join(density, place, "left").select("clock", "id", "density")


def catchment(vehicles: DataFrame, zones: DataFrame) -> DataFrame:
    """clock, zone_id, weight of the vehicles within radius and buffer, edge included; zones without any are left out."""
    rows = vehicles.join(F.broadcast(zones) if zones.limit(10_001).count() <= 10_000 else zones, length(F.col("e_m") - F.col("zone_e"), F.col("n_m") - F.col("zone_n")) <= F.col("radius_m") + F.col("buffer_m"))
    return rows.groupBy("clock", "zone_id").agg(F.sum("weight").alias("weight"))


def reference(values: DataFrame, column: str) -> DataFrame:
    """One row: the largest value over all clocks."""
    return values.agg(F.max(column).alias("reference"))


def ranked(catchments: DataFrame) -> DataFrame:
    """With share of the reference (at most 1; 0 if there is none) and rank within the clock."""
    ref = reference(catchments, "weight")
    share = F.when(F.col("reference") > 0, F.least(F.lit(1.0), F.col("weight") / F.col("reference"))).otherwise(0.0)
    w = Window.partitionBy("clock").orderBy(F.col("weight").desc(), "zone_id")
    return catchments.crossJoin(F.broadcast(ref)).withColumn("share", share).withColumn("rank", F.row_number().over(w))  # a single row


def sampled(fixes: DataFrame, every: float) -> DataFrame:
    """track_id, clock_s, e_m, n_m, speed, closing of each track at every clock in its record, by linear interpolation.

    Each segment makes the clocks that lie in it, so nothing is joined; a clock at the last fix has no speed.
    """
    w = in_order()
    rows = fixes.withColumns({"t1": F.lead("t_s").over(w), "e1": F.lead("e_m").over(w), "n1": F.lead("n_m").over(w)})
    end = F.coalesce(F.col("t1"), F.col("t_s"))
    first, last = F.ceil(F.col("t_s") / every), F.floor(end / every)
    inside = F.when(first <= last, F.sequence(first, last))
    rows = rows.withColumn("k", F.explode(inside)).withColumn("clock_s", F.col("k") * every).filter(F.col("t1").isNull() | (F.col("clock_s") < F.col("t1")))
    dt = F.col("t1") - F.col("t_s")
    part = F.coalesce((F.col("clock_s") - F.col("t_s")) / dt, F.lit(0.0))
    move = length(F.col("e1") - F.col("e_m"), F.col("n1") - F.col("n_m"))
    near = length(F.col("e_m"), F.col("n_m")) - length(F.col("e1"), F.col("n1"))
    return rows.select("track_id", "clock_s", (F.col("e_m") + part * F.coalesce(F.col("e1") - F.col("e_m"), F.lit(0.0))).alias("e_m"), (F.col("n_m") + part * F.coalesce(F.col("n1") - F.col("n_m"), F.lit(0.0))).alias("n_m"), F.coalesce(move / dt, F.lit(0.0)).alias("speed"), F.coalesce(near / dt, F.lit(0.0)).alias("closing"))


def trend(speed: Column, closing: Column) -> Column:
    return F.when(speed < 0.5, "stopped").when(closing > 0.15, "approaching").when(closing < -0.15, "receding").otherwise("steady")
