"""Cube-method balanced sampling, distributed.

Inside a stratum the inclusion probabilities walk through the null space of the balancing constraints (the flight) until
units reach 0 or 1. The constraints are the stratum's count and, if sizes are given, its total size; so a window of two
or three fractional units suffices to find a direction, and a partition holds no more than that per stratum. What a
partition cannot resolve merges upward: first over the square root of the partitions, at most BUCKETS, then per stratum,
where at most BUCKETS units per constraint arrive; there the landing drops the constraints one by one and resolves the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.session import cut

BUCKETS = 64
_EPS = 1e-9


def _step(pis: list[float], direction: list[float], chance: float) -> list[float]:
    """One move along ±direction as far as the unit cube allows; the expectation of every probability is kept."""
    up = down = float("inf")
    for p, d in zip(pis, direction):
        if d > _EPS:
            up, down = min(up, (1 - p) / d), min(down, p / d)
        elif d < -_EPS:
            up, down = min(up, p / -d), min(down, (1 - p) / -d)
    by = up if chance * (up + down) < down else -down
    moved = [p + by * d for p, d in zip(pis, direction)]
    return [0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p for p in moved]


def _direction(sizes: list[float] | None, n: int) -> list[float]:
    if sizes is None or n == 2:
        return [1.0, -1.0]
    a, b, c = sizes
    d = [c - b, a - c, b - a]
    scale = max(map(abs, d))
    return [x / scale for x in d] if scale > 0 else [1.0, -1.0, 0.0]


class _Window:
    """The unresolved units of a stratum: (key, probability, size, chance)."""

    __slots__ = ("units", "sized")

    def __init__(self, sized: bool):
        self.units: list[tuple] = []
        self.sized = sized

    def add(self, unit: tuple, done: list[tuple]) -> None:
        self.units.append(unit)
        while len(self.units) > 1 + self.sized:
            self._move(_direction([u[2] for u in self.units] if self.sized else None, len(self.units)), done)

    def _move(self, direction: list[float], done: list[tuple]) -> None:
        units = self.units
        after = _step([u[1] for u in units], direction, units[-1][3])
        kept = []
        for u, p in zip(units, after):
            if p == 1.0:
                done.append((u[0], 1.0, u[2]))
            elif p > 0.0:
                kept.append((u[0], p, u[2], (u[3] * 7919.0 + 0.618033988749895) % 1.0))
        self.units = kept

    def land(self, done: list[tuple]) -> None:
        self.sized = False
        while len(self.units) > 1:
            head, rest = self.units[:2], self.units[2:]
            self.units = head
            self._move([1.0, -1.0], done)
            self.units += rest
        for key, p, size, chance in self.units:
            if chance < p:
                done.append((key, 1.0, size))
        self.units = []


def _flight(sized: bool, land: bool, key_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: dict[str, _Window] = {}

        def rows(out: dict[str, list[tuple]]) -> pa.RecordBatch:
            flat = [(s, *r) for s, rs in out.items() for r in rs]
            cols = list(zip(*flat)) if flat else [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], key_type), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], names=["stratum", "unit", "pi", "size"])

        for batch in batches:
            out: dict[str, list[tuple]] = {}
            for s, k, p, z, u in zip(*(c.to_pylist() for c in batch.columns)):
                if p >= 1 - _EPS:
                    out.setdefault(s, []).append((k, 1.0, z))
                elif p > _EPS:
                    w = windows.get(s)
                    if w is None:
                        w = windows[s] = _Window(sized)
                    w.add((k, p, z, u), out.setdefault(s, []))
            yield rows(out)
        rest: dict[str, list[tuple]] = {}
        for s, w in windows.items():
            done = rest.setdefault(s, [])
            if land:
                w.land(done)
            done += [(k, p, z) for k, p, z, _ in w.units]
        yield rows(rest)

    return run


def cube_sample(units: DataFrame, stratum: str, unit: str, pi: str, size: str | None = None, seed: int = 20260930) -> DataFrame:
    """(stratum, unit, size) of the units drawn: each with its probability, count per stratum within one of the sum of
    probabilities, and with `size` the drawn total close to its expectation.

    stratum is a string; rows with a null stratum, unit or probability are never drawn; probabilities beyond [0, 1] are
    clipped; a null size counts 0. Repeated rows are units of their own. An empty table gives no row. The draw depends
    only on the seed, the unit ids and the order within the input partitions, so a task that is run again gives the
    same rows. Nothing is shuffled but the unresolved units, at most two per stratum and partition.
    """
    key_type = units.schema[unit].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[key_type]
    sized = size is not None
    schema = f"stratum string, unit {key_type}, pi double, size double"

    def chance(level: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), "stratum", "unit"), 11) / F.lit(float(1 << 53))).alias("u")

    base = units.select(F.col(stratum).alias("stratum"), F.col(unit).alias("unit"), F.col(pi).cast("double").alias("pi"), (F.coalesce(F.col(size).cast("double"), F.lit(0.0)) if sized else F.lit(1.0)).alias("size"))
    base = base.where("stratum is not null and unit is not null and pi > 0")
    first = cut(base.select("*", chance(0)).mapInArrow(_flight(sized, False, arrow), schema))
    buckets = min(BUCKETS, math.isqrt(first.rdd.getNumPartitions()) + 1)
    open_units = first.where("pi < 1").select("*", chance(1)).repartition(buckets, F.pmod(F.xxhash64("unit"), F.lit(buckets)))
    second = cut(open_units.sortWithinPartitions("stratum", "unit").mapInArrow(_flight(sized, False, arrow), schema))
    third = second.where("pi < 1").select("*", chance(2)).repartition("stratum").sortWithinPartitions("stratum", "unit").mapInArrow(_flight(sized, True, arrow), schema)
    return first.where("pi = 1").unionByName(second.where("pi = 1")).unionByName(third).select("stratum", "unit", "size")
