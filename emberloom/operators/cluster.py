"""Clusters of reports of one incident: every report follows its nearest matching earlier one, and the trees of that forest are the clusters."""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import centre_distances, near_pairs, seconds
from ..functions.text import none_if_empty, token_set_ratio_column
from ..schema import COMPATIBLE, OTHER_TIER, RADIUS_M, SOURCE_TIER
from .crowds import nearest_in_cells
from .normalize import lookup

WINDOW_S, LEAST_RADIUS_M, CANDIDATES, TEXT_OVER = 6 * 3600, 10_000.0, 50, 55.0
#: Where a cell has more reports than this, cells are searched as groups, and where it has more places than that, ring by ring.
CROWD, DENSE = 500, 2_000
#: As many comparisons joins may make, as the cells of all radii tell; where they would make more, cells are searched as groups too.
COMPARED = 20_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, and where that is unset on a single machine a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the executors share")
    return found or tempfile.mkdtemp(prefix="checkpoint-")


def checkpoint(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df read back from a Parquet table in the shared folder: for many rows, as a checkpoint works the last stage out twice."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    path = f"{context.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def groups_of(category: Column) -> Column:
    table = {c: [k for k, g in enumerate(COMPATIBLE) if c in g] for g in COMPATIBLE for c in g}
    found = F.array().cast("array<int>")
    for c, ks in table.items():
        found = F.when(category == c, F.array(*[F.lit(k) for k in ks])).otherwise(found)
    return found


def compatible(a: Column, b: Column) -> Column:
    return (a == b) | F.arrays_overlap(groups_of(a), groups_of(b))


def actor_set(events: DataFrame) -> Column:
    """Lower-case names of both sides, canonical where known, as a sorted array; null without any."""
    has = lambda c: c in events.columns
    name = lambda c: none_if_empty(F.lower(F.trim(F.coalesce(none_if_empty(F.col(f"{c}_canonical")), F.col(c)) if has(f"{c}_canonical") else F.col(c))))
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*[name(c) for c in ("actor_a", "actor_b") if has(c)]))))
    return F.when(F.size(names) > 0, names)


def event_text(events: DataFrame) -> Column:
    parts = [none_if_empty(F.col(c)) for c in ("headline", "notes") if c in events.columns]
    return F.lower(F.trim(F.concat_ws(" ", *parts))) if parts else F.lit("")


def arrived(events: DataFrame) -> Column:
    """What reports are ordered by: the arrival column where there is one, and the id."""
    return F.struct("arrival", "id") if "arrival" in events.columns else F.struct("id")


def narrow(events: DataFrame, radii: list[float]) -> DataFrame:
    """id, lat, lon, t, reach, arrived, cell: what candidates are found by. Radii outside the table fall to the next larger cell, the distance is checked on the true one."""
    reach = F.greatest(F.lit(LEAST_RADIUS_M), F.coalesce(F.col("geo_radius_m"), F.lit(0)).cast("double"))
    cell = F.lit(radii[-1])
    for r in sorted(radii, reverse=True):
        cell = F.when(F.col("reach") <= r, F.lit(r)).otherwise(cell)
    told = [c for c in ("kind", "mask", "actors", "told") if c in events.columns]
    return events.select("id", "lat", "lon", F.col("occurred_at").alias("t"), reach.alias("reach"), arrived(events).alias("arrived"), *told).withColumn("cell", cell)


def cell_key(size_m: float) -> list[Column]:
    """The cell and time bucket that a report stands in."""
    return [F.floor(x / size_m).cast("long").alias(f"k{n}") for n, x in enumerate((*centre_distances(F.col("lat"), F.col("lon")), seconds(F.col("t")) * size_m / (2 * WINDOW_S)))]


def crowding(reports: DataFrame, most: int, radii: list[float]) -> tuple[int, int, int, float, int]:
    """(how many reports have one place, time and radius at most, how many stand in a cell as wide as the least radius needs at most, `most` of those alike counted, at how many places there, the widest cell that
    any of them needs, how many a join would compare: those that need a radius with all in a cell of it, summed up): five numbers, pre-aggregated."""
    keys = ["k0", "k1", "k2", "k3"]
    alike = reports.dropna(subset=["lat", "lon", "t"]).groupBy("lat", "lon", "t", "reach").agg(F.count("*").alias("n"), F.max("cell").alias("cell"))
    own = [F.sum(F.when(F.col("cell") == r, F.least("n", F.lit(most))).otherwise(0)).alias(f"n{k}") for k, r in enumerate(radii)]
    places = alike.select("n", "cell", "lat", "lon", *cell_key(2 * LEAST_RADIUS_M)).groupBy(*keys, "lat", "lon").agg(F.max("n").alias("alike"), F.sum(F.least("n", F.lit(most))).alias("n"), F.max("cell").alias("cell"), *own)
    cells = places.groupBy(*keys).agg(F.max("alike").alias("alike"), F.sum("n").alias("n"), F.count("*").alias("places"), F.max("cell").alias("cell"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(radii))])
    # small cells lie in the wide ones
    wide = [F.struct(F.lit(r).alias("radius"), F.col(f"n{k}").alias("own"), *[F.floor(F.col(c) * (LEAST_RADIUS_M / r)).alias(f"w{c}") for c in keys[:3]]) for k, r in enumerate(radii)]
    each = cells.select("k3", "alike", "n", "places", "cell", F.inline(F.array(*wide))).groupBy("radius", "wk0", "wk1", "wk2", "k3")
    met = each.agg((F.sum("own").cast("double") * F.sum("n")).alias("met"), *[F.max(c).alias(c) for c in ("alike", "n", "places", "cell")])
    top = met.agg(F.sum("met").alias("met"), *[F.max(c).alias(c) for c in ("alike", "n", "places", "cell")]).first()
    return top["alike"] or 0, top["n"] or 0, top["places"] or 0, top["cell"] or LEAST_RADIUS_M, int(top["met"] or 0)


def crowded(early: DataFrame, late: DataFrame, dense: int, places: bool = False, radius: float = LEAST_RADIUS_M) -> DataFrame:
    """The reports of late beside whose cells, as wide as a radius needs, more than `dense` of early stand, or early ones at so many places."""
    size = 2 * radius
    keys = ["k0", "k1", "k2", "k3"]
    stand = early.select("lat", "lon", *cell_key(size))
    full = (stand.distinct() if places else stand).groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > dense).select(*keys)
    cells = late.select(*cell_key(size)).distinct()
    for k in keys:
        cells = cells.withColumn(f"n{k}", F.explode(F.array(F.col(k) - 1, F.col(k), F.col(k) + 1)))
    beside = cells.join(full.select(*[F.col(k).alias(f"n{k}") for k in keys]), [f"n{k}" for k in keys], "left_semi").select(*keys).distinct()
    return late.select("*", *cell_key(size)).join(beside, keys, "left_semi").drop(*keys)


def nearest_in_crowds(early: DataFrame, late: DataFrame, most: int, dense: int) -> tuple[DataFrame, DataFrame]:
    """(id, cand_id, distance_m, rn) of those reports of late that have `most` candidates within a radius below the least, the nearest ones, and the others of late.

    Radii are halved until no cell of their width holds more than `dense` places; then each report looks for its candidates in ever wider rings, from the smallest radius on, and leaves as soon as it has enough: whatever lies
    farther can't be among the nearest. A report meets what is near it, not its whole city, and what has few candidates is rare in a crowd.
    """
    ladder, r = [], LEAST_RADIUS_M / 2
    while r > 0.01:
        ladder.append(r)
        top = early.select("lat", "lon", *cell_key(2 * r)).distinct().groupBy("k0", "k1", "k2", "k3").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if top <= dense:
            break
        r /= 2
    found, rest = None, late
    for r in reversed(ladder):
        ranked = nearest_in_cells(early.withColumn("reach", F.lit(r)), rest.withColumn("reach", F.lit(r)), most, r, WINDOW_S, stored).drop("same")
        ranked = stored(ranked.filter(F.col("distance_m") < r - 0.001))
        done = ranked.filter(F.col("rn") == most).select("id")
        enough = ranked.join(done, "id", "left_semi")
        found = enough if found is None else found.unionByName(enough)
        rest = stored(rest.join(done, "id", "left_anti"))
    return found, rest


def candidate_parts(events: DataFrame, most: int, later: DataFrame | None, dense: int, crowd: int, rule: str | None = None, compared: int = COMPARED) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of candidates in two tables, each with all rows of its reports: those that joins find, and those of reports in crowds, of which only what `rule` needs is kept (see nearest_in_cells). Either may be None."""
    radii = [LEAST_RADIUS_M, *[float(r) for r in RADIUS_M.values() if r > LEAST_RADIUS_M]]
    alike = Window.partitionBy("lat", "lon", "t", "reach").orderBy("arrived")
    early = narrow(events, radii)
    late = narrow(events if later is None else later, radii)
    near_all, in_cells = None, None
    most_alike, top, places, largest, met = crowding(early, most, radii)
    if top > crowd or met > compared:
        late = stored(late)  # looked at from many sides
        early = late if later is None else early
    if most_alike > most:  # else there is none to leave out
        early = stored(early.withColumn("_k", F.row_number().over(alike)).filter(F.col("_k") <= most).drop("_k"))
    if places > dense:
        many = stored(crowded(early, late, dense, True))
        near_all, rest = nearest_in_crowds(early, many, most, dense)
        late = late.join(many.select("id"), "id", "left_anti").unionByName(rest)
    if top > crowd or met > compared:
        late = stored(late) if places > dense else late
        many = stored(crowded(early, late, crowd // 10, radius=largest))  # who is left must not meet a crowd's edge
        reach = F.least("reach", "cell")
        in_cells = nearest_in_cells(early.withColumn("reach", reach), many.withColumn("reach", reach), most, largest, WINDOW_S, stored, rule)
        late = stored(late.join(many.select("id"), "id", "left_anti"))
        if late.isEmpty():
            return near_all, in_cells
    own = F.col("cell")
    ahead = near_pairs(late, early, "c_", own, radii, WINDOW_S, WINDOW_S, own, (F.col("reach") >= F.col("c_reach")) & (F.col("arrived") > F.col("c_arrived")))
    wide = early.filter(F.col("reach") > LEAST_RADIUS_M)
    behind = near_pairs(wide, late, "c_", own, radii, WINDOW_S, WINDOW_S, own, (F.col("reach") > F.col("c_reach")) & (F.col("arrived") < F.col("c_arrived")))
    near = F.col("distance_m") <= F.col("reach")
    pairs = ahead.filter(near).select("id", F.col("c_id").alias("cand_id"), "distance_m", F.col("c_arrived").alias("arrived"))
    pairs = pairs.unionAll(behind.filter(near).select(F.col("c_id").alias("id"), F.col("id").alias("cand_id"), "distance_m", "arrived"))
    pairs = pairs.withColumn("distance_m", F.round("distance_m", 3))
    order = Window.partitionBy("id").orderBy("distance_m", "arrived")
    ranked = pairs.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).drop("arrived")
    return ranked if near_all is None else ranked.unionByName(near_all), in_cells


def candidates(events: DataFrame, most: int = CANDIDATES, later: DataFrame | None = None, dense: int = DENSE, crowd: int = CROWD) -> DataFrame:
    """(id, cand_id, distance_m, rn): of each report (of later, where given, a part of events) the nearest that arrived earlier within 6 hours and the larger of 10 km and both radii.

    A pair is met once, from the side with the larger radius, on cells of that radius. The cap comes before any text is
    compared. Equal distances, to the millimetre, are ordered by arrival. Of reports with one place, time and radius, as many as the cap can be somebody's candidates, the first to arrive:
    the others are left out before the join, so a city that a feed puts on one instant of a day doesn't meet itself pair by pair. Nor does one with many reports: beside cells with more than `crowd`, a cell is one
    group, in which places are compared (nearest_in_cells); and where reports lie side by side, at more than `dense` places in a cell, rings around each report are searched first (nearest_in_crowds), and only who
    finds too few there goes on to the whole radius.
    """
    plain, in_cells = candidate_parts(events, most, later, dense, crowd)
    if in_cells is None:
        return plain
    return in_cells.drop("same") if plain is None else plain.unionByName(in_cells.drop("same"))


def parents(events: DataFrame, text_rule: bool = True, most: int = CANDIDATES, later: DataFrame | None = None, dense: int = DENSE, crowd: int = CROWD) -> DataFrame:
    """(id, parent): the first candidate that matches, of all reports or of those in later. Match: compatible categories, and the same actors or texts that are similar enough.

    The cheap terms come first; the similarity is computed for what they leave open only. In crowds they are looked at where candidates are found, so only what may be a parent leaves a cell.
    """
    about = events.select("id", "category", actor_set(events).alias("actors"), event_text(events).alias("text"))
    other = about.select(*[F.col(c).alias(f"c_{c}") for c in about.columns])
    hashed = lambda c: F.when(c.isNotNull(), F.xxhash64(c))
    kind = {"kind": hashed(F.col("category")), "mask": F.aggregate(groups_of(F.col("category")), F.lit(0).cast("long"), lambda m, k: m + F.pow(F.lit(2.0), k).cast("long")), "actors": hashed(actor_set(events)), "told": event_text(events) != ""}
    rows = events.withColumns(kind)
    plain, in_cells = candidate_parts(rows, most, None if later is None else later.withColumns(kind), dense, crowd, "text" if text_rule else "same")
    found = []
    if plain is not None:
        met = plain.join(about, "id").join(other, F.col("cand_id") == F.col("c_id")).filter(compatible(F.col("category"), F.col("c_category")))
        met = met.withColumn("same", F.coalesce(F.col("actors") == F.col("c_actors"), F.lit(False)))
        found.append(met.select("id", "cand_id", "rn", "same", "text", "c_text") if text_rule else met.filter("same").select("id", "cand_id", "rn"))
    if in_cells is not None:
        if text_rule:
            in_cells = stored(in_cells.select("id", "cand_id", "rn", "same"))
            in_cells = in_cells.join(about.select("id", "text"), "id").join(other.select("c_id", "c_text"), F.col("cand_id") == F.col("c_id"))
            found.append(in_cells.select("id", "cand_id", "rn", "same", "text", "c_text"))
        else:
            found.append(in_cells.select("id", "cand_id", "rn"))
    met = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    if text_rule:
        open_ = ~F.col("same") & (F.col("text") != "") & (F.col("c_text") != "")
        met = met.filter(F.col("same") | open_)
        met = met.withColumn("score", F.when(open_, token_set_ratio_column(F.when(open_, F.col("text")), F.when(open_, F.col("c_text")))))
        met = met.filter(F.col("same") | (F.col("score") > TEXT_OVER))
    return met.groupBy("id").agg(F.min_by("cand_id", "rn").alias("parent"))


def roots(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, root) of the linked ids, parents included: pointers double until none moves."""
    p = links.select("id", F.col("parent").alias("up"))
    p = stored(p)
    for _ in range(rounds):
        above = p.select(F.col("id").alias("up"), F.col("up").alias("next"))
        seen = Observation()  # told by the pass that stores them, so none is read for it
        p = p.select("id", "up").join(above, "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved"))
        p = stored(p.observe(seen, F.count_if("moved").alias("n")).select("id", "up"))
        if not seen.get["n"]:
            return p.select("id", F.col("up").alias("root"))
    raise RuntimeError(f"roots: no end after {rounds} rounds")


def assign_clusters(events: DataFrame, text_rule: bool = True, most: int = CANDIDATES) -> DataFrame:
    """events with cluster_id, the id of the report that its chain of parents ends in."""
    tops = roots(parents(events, text_rule, most))
    return events.drop("cluster_id").join(tops, "id", "left").withColumn("cluster_id", F.coalesce("root", "id")).drop("root")


def assign_batch(stored: DataFrame, batch: DataFrame, text_rule: bool = True, most: int = CANDIDATES) -> DataFrame:
    """batch with cluster_id against clustered events: parents may be stored, whose cluster is known, so only the batch's own links are doubled.

    What is stored comes before the batch, whatever the ids; both order their reports by an `arrival` column where they have one. Only stored reports within the batch's span of time are looked at.
    """
    columns = [c for c in batch.columns if c in stored.columns and c not in ("cluster_id", "arrival")]
    span = batch.agg(F.min("occurred_at").alias("a"), F.max("occurred_at").alias("b")).first()
    if span["a"] is None:
        return batch.drop("cluster_id").withColumn("cluster_id", F.col("id"))
    gap = timedelta(seconds=WINDOW_S)
    place = lambda df, k: F.struct(F.lit(k).alias("k"), (F.col("arrival") if "arrival" in df.columns else F.lit(None).cast("struct<batch:bigint,place:bigint>")).alias("a")).alias("arrival")
    near = stored.filter(F.col("occurred_at").between(F.lit(span["a"] - gap).cast("timestamp_ntz"), F.lit(span["b"] + gap).cast("timestamp_ntz")))
    own = batch.select(*columns, place(batch, 1))
    links = parents(near.select(*columns, place(stored, 0)).unionByName(own), text_rule, most, own)
    known = stored.select(F.col("id").alias("root"), F.col("cluster_id").alias("known"))
    out = roots(links).join(known, "root", "left").select("id", F.coalesce("known", "root").alias("cluster_id"))
    return batch.drop("cluster_id").join(out, "id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "id"))


def tier(source: Column) -> Column:
    return F.coalesce(lookup(SOURCE_TIER, source), F.lit(OTHER_TIER)).cast("double")


def cluster_stats(events: DataFrame) -> DataFrame:
    """A row for each cluster: first_seen, last_seen, member_count, centroid and the representative, which has the best source, then the earliest time, then the smallest id.

    One aggregation; the representative is a minimum too.
    """
    best = F.min_by("id", F.struct(-tier(F.col("source")), F.col("occurred_at"), F.col("id")))
    return events.groupBy("cluster_id").agg(
        best.alias("representative"),
        F.min("occurred_at").alias("first_seen"),
        F.max("occurred_at").alias("last_seen"),
        F.count("*").alias("member_count"),
        F.avg("lat").alias("centroid_lat"),
        F.avg("lon").alias("centroid_lon"),
    )


def write_back(events: DataFrame, clusters: DataFrame) -> DataFrame:
    """events with the score and the member count (source_count) of their cluster on its representative, as they are shown on the report that speaks for it; others keep what they have."""
    known = {"reliability": ("reliability", "double"), "source_count": ("member_count", "long")}
    told = {c: told for c, told in known.items() if told[0] in clusters.columns}
    spoken = clusters.select(F.col("representative").alias("id"), F.lit(True).alias("_speaks"), *[F.col(x).cast(t).alias(f"_{c}") for c, (x, t) in told.items()])
    old = lambda c, t: F.col(c) if c in events.columns else F.lit(None).cast(t)
    out = events.join(spoken, "id", "left").withColumns({c: F.when(F.col("_speaks"), F.col(f"_{c}")).otherwise(old(c, t)) for c, (_, t) in told.items()})
    return out.drop("_speaks", *[f"_{c}" for c in told])
