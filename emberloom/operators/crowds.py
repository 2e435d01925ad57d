"""The nearest candidates of reports in crowds: a cell's reports are one group of a Spark job, and inside a group places are compared, not pairs of reports."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import EARTH_M, centre_distances, seconds

KEYS = ("k0", "k1", "k2", "k3")
#: Cells of a comparison that are in memory at once.
AT_ONCE = 4_000_000


def leaves(df: DataFrame, name: str) -> list[Column]:
    """The numbers that an order column is made of, first to last; nulls come first."""
    out, open_ = [], [(F.col(name), df.schema[name].dataType)]
    while open_:
        c, kind = open_.pop(0)
        if isinstance(kind, T.StructType):
            open_ = [(c[f.name], f.dataType) for f in kind.fields] + open_
        else:
            out.append(F.coalesce(c.cast("long"), F.lit(-(1 << 63))))
    return out


def distances(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    """haversine_m of one place and many."""
    a, b = np.sin(np.radians(lats - lat) / 2), np.sin(np.radians(lons - lon) / 2)
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, a * a + np.cos(np.radians(lat)) * np.cos(np.radians(lats)) * b * b)))


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal strings as equal numbers, null as -1."""
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


class Cell:
    """The reports of one cell, early ones in the order of their arrival."""

    def __init__(self, rows: pa.Table, orders: int, window_us: int, rule: str | None):
        column = lambda c: rows.column(c).to_numpy()
        keys = [column(f"a{k}") for k in range(orders)]
        order = np.lexsort(keys[::-1])
        steps = np.zeros(len(order), bool)
        for k in keys:
            steps[1:] |= k[order][1:] != k[order][:-1]
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.cumsum(steps)
        is_late = column("late")
        self.early, self.late = order[~is_late[order]], order[is_late[order]]
        self.id, self.t, self.reach, self.window_us, self.rule = column("id"), column("t"), column("reach"), window_us, rule
        places, self.place = np.unique(column("lat") + 1j * column("lon"), return_inverse=True)
        self.lat, self.lon = places.real, places.imag
        if rule:
            self.kind, self.actors, self.mask, self.told = codes(rows.column("kind")), codes(rows.column("actors")), column("mask"), column("told")

    def pairs(self, most: int, largest: float) -> list[tuple[np.ndarray, ...]]:
        """Blocks of (late, early, distance, rn, same): each late report's nearest early ones, or of these what the rule needs."""
        out = []
        at = self.place[self.early]
        by_place = self.late[np.argsort(self.place[self.late], kind="stable")]
        for rows in np.split(by_place, np.flatnonzero(np.diff(self.place[by_place])) + 1) if len(by_place) else []:
            p = self.place[rows[0]]
            d = distances(self.lat[p], self.lon[p], self.lat, self.lon)
            # equal distances, to the millimetre, are one step; early reports are in the order of arrival, which a stable sort keeps
            told = np.round(d, 3)
            steps = np.unique(told, return_inverse=True)[1]
            steps = steps.astype(np.uint16) if len(steps) < 1 << 16 else steps
            t = self.t[rows]
            there = self.early[(d <= largest)[at]]
            there = there[(self.rank[there] < self.rank[rows[-1]]) & (self.t[there] >= t.min() - self.window_us) & (self.t[there] <= t.max() + self.window_us)]
            there = there[d[self.place[there]] <= np.maximum(self.reach[there], self.reach[rows].max())]
            there = there[np.argsort(steps[self.place[there]], kind="stable")]
            for k in range(0, len(rows), 4096):
                self.nearest(rows[k : k + 4096], there, d, told, most, out)
        return out

    def nearest(self, rows: np.ndarray, there: np.ndarray, d: np.ndarray, told: np.ndarray, most: int, out: list) -> None:
        """Walks outwards over `there` by ever longer parts; who has enough leaves."""
        found = np.zeros(len(rows), np.int32)
        far, ranks, times = d[self.place[there]], self.rank[there], self.t[there]
        reached = far <= self.reach[there]
        left, start, step = np.arange(len(rows)), 0, 4 * most
        while len(left) and start < len(there):
            cut = slice(start, start + max(min(step, AT_ONCE // len(left)), most))
            part, late = there[cut], rows[left][:, None]
            start, step = start + len(part), 2 * step
            hit = ranks[cut] < self.rank[late]
            hit &= times[cut] >= self.t[late] - self.window_us
            hit &= times[cut] <= self.t[late] + self.window_us
            hit &= (far[cut] <= self.reach[late]) | reached[cut]
            n = np.cumsum(hit, axis=1, dtype=np.int32) + found[left][:, None]
            r, c = np.nonzero(hit & (n <= most))
            rn, a, b = n[r, c], rows[left[r]], part[c]
            found[left] = n[:, -1]
            done = found[left] >= most
            same = np.zeros(len(a), bool)
            if self.rule:
                goes = ((self.kind[a] == self.kind[b]) & (self.kind[a] >= 0)) | (self.mask[a] & self.mask[b] != 0)
                same = goes & (self.actors[a] == self.actors[b]) & (self.actors[a] >= 0)
                # what lies beyond the first with the same actors can't be the parent
                first = np.full(len(left), 1 << 62)
                np.minimum.at(first, r[same], c[same])
                keep = same if self.rule == "same" else same | goes & self.told[a] & self.told[b]
                keep &= c <= first[r]
                a, b, rn, same = a[keep], b[keep], rn[keep], same[keep]
                done |= first < 1 << 62
            out.append((self.id[a], self.id[b], told[self.place[b]], rn, same))
            left = left[~done]


def searched(most: int, largest: float, orders: int, window_us: int, rule: str | None) -> Callable[[pa.Table], pa.Table]:
    kinds = (np.int64, np.int64, np.float64, np.int32, bool)

    def run(rows: pa.Table) -> pa.Table:
        found = Cell(rows, orders, window_us, rule).pairs(most, largest)
        columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(5)]
        return pa.table([pa.array(c.astype(kind)) for c, kind in zip(columns, kinds, strict=True)], names=["id", "cand_id", "distance_m", "rn", "same"])

    return run


def nearest_in_cells(early: DataFrame, late: DataFrame, most: int, largest: float, window_s: int, keep: Callable[[DataFrame], DataFrame], rule: str | None = None) -> DataFrame:
    """(id, cand_id, distance_m, rn, same): the nearest `most` of early that arrived before each of late, within window_s and the larger of both reaches, which are `largest` at most.

    A late report stands in one cell, twice as wide as the largest reach and the window; an early one in all cells that its surroundings touch, where there is a late one. In a cell, distances are taken between places, and each
    late report walks outwards until it has enough, so what lies far off isn't compared. rule keeps of the candidates what a parent is chosen from: "same", the first of a compatible kind (kind, mask) with the same actors;
    "text", also those before it where both have a text (told). keep stores a table: that of the cells is small, if there are few, and then early reports that no cell needs aren't shuffled.
    """
    size, span = 2 * largest, 2 * window_s
    own = ["id", "lat", "lon", "reach", *(["kind", "mask", "actors", "told"] if rule else [])]
    orders = leaves(early, "arrived")

    def shaped(df: DataFrame, is_late: bool) -> DataFrame:
        named = [c.alias(f"a{k}") for k, c in enumerate(leaves(df, "arrived"))]
        at = [x.alias(f"_{n}") for n, x in enumerate((*centre_distances(F.col("lat"), F.col("lon")), seconds(F.col("t"))))]
        return df.dropna(subset=["lat", "lon", "t"]).select(*own, F.unix_micros(F.col("t").cast("timestamp")).alias("t"), *named, F.lit(is_late).alias("late"), *at)

    reach = [largest + 1.0] * 3 + [float(window_s)]
    width = [size] * 3 + [float(span)]
    cell = lambda x, w: F.floor(x / w).cast("int")
    homes = shaped(late, True)
    homes = homes.select("*", *[cell(F.col(f"_{n}"), width[n]).alias(k) for n, k in enumerate(KEYS)])
    around = shaped(early, False)
    for n, k in enumerate(KEYS):
        x = F.col(f"_{n}")
        around = around.withColumn(k, F.explode(F.sequence(cell(x - reach[n], width[n]), cell(x + reach[n], width[n]))))
    around = around.join(keep(homes.select(*KEYS).distinct()), list(KEYS), "left_semi")
    drop = [f"_{n}" for n in range(4)]
    rows = homes.drop(*drop).unionByName(around.drop(*drop))
    run = searched(most, largest, len(orders), window_s * 1_000_000, rule)
    # the work is in the groups, not in their bytes, so partitions aren't put together
    rows = rows.repartition(max(8 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *KEYS)
    return rows.groupBy(*KEYS).applyInArrow(run, "id long, cand_id long, distance_m double, rn int, same boolean")
