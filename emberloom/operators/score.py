"""Corroboration by satellite hotspots, and reliability with its explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import celled, centre_distances, haversine_m, seconds
from ..functions.text import root_domain
from ..schema import BASE_SCORE, CONSISTENCY, DOMAIN_CAP, DOMAIN_STEP, KINETIC, OTHER_SCORE, PRECISION_BONUS, PRECISIONS, THERMAL_BONUS
from .cluster import stored
from .normalize import lookup

HOTSPOT_RADIUS_M, HOURS = 5_000.0, 3600
#: The edge of a cube whose diagonal is shorter than the radius; the shortest and the longest window of a report, in microseconds.
CUBE_M, BUCKET_US, LONGEST_US = 2_800.0, 12 * HOURS * 1_000_000, 36 * HOURS * 1_000_000


def heat_beside(hotspots: DataFrame) -> DataFrame:
    """(c0, c1, c2, bucket, last, next): for the hotspots of a cube and each bucket of 12 hours, the last time in it and the first of the three after it, in microseconds.

    A window that begins in a bucket is 12 to 36 hours long, so it holds a hotspot of the cube if and only if the last one isn't before it or the next one not after it.
    """
    h = hotspots.select("first", "last", "bucket", *cube_of()).filter(~F.isnan("c0") & ~F.isnan("c1") & ~F.isnan("c2"))
    told = lambda k: F.struct((F.col("bucket") - k * BUCKET_US).alias("bucket"), (F.lit(None).cast("long") if k else F.col("last")).alias("last"), (F.col("first") if k else F.lit(None).cast("long")).alias("next"))
    each = h.groupBy("c0", "c1", "c2", "bucket").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    each = each.select("c0", "c1", "c2", F.inline(F.array(*[told(k) for k in range(LONGEST_US // BUCKET_US + 1)])))
    return each.groupBy("c0", "c1", "c2", "bucket").agg(F.max("last").alias("last"), F.min("next").alias("next"))


def cube_of() -> list[Column]:
    return [F.floor(x / CUBE_M).cast("double").alias(f"c{n}") for n, x in enumerate(centre_distances(F.col("lat"), F.col("lon")))]


def bucket_of(us: Column) -> Column:
    return us - F.pmod(us, F.lit(BUCKET_US))


def corroborated(events: DataFrame, hotspots: DataFrame) -> DataFrame:
    """Distinct cluster_id of kinetic events with a hotspot within 5 km and 6 hours; an event stamped midnight stands for its whole day and 6 hours around it.

    Of a place's hotspots the first and last in each 12 hours are enough, as no window is shorter. Reports with one in their own cube, none of whose places are farther apart than the radius, are told by one lookup each
    (heat_beside). Of the others, each place and time is compared once with the places of hotspots around; these carry their times of a bucket. Cells are one hash on both sides, as the distance and the times tell
    apart what falls together.
    """
    t = F.col("occurred_at")
    midnight = t == F.date_trunc("day", t).cast("timestamp_ntz")
    e = events.filter(F.col("category").isin(*KINETIC)).select("cluster_id", "lat", "lon", t.alias("t"), F.when(midnight, 30 * HOURS).otherwise(6 * HOURS).alias("until"))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    few = hotspots.select("lat", "lon", us(F.col("acquired_at")).alias("us")).dropna().groupBy("lat", "lon", bucket_of(F.col("us")).alias("bucket")).agg(F.min("us").alias("first"), F.max("us").alias("last"))
    few = stored(few)  # a row a place and half a day, read twice
    beside = heat_beside(few)
    begin = us(F.col("t")) - 6 * HOURS * 1_000_000
    e = e.select("*", begin.alias("begin"), (us(F.col("t")) + F.col("until").cast("long") * 1_000_000).alias("end"), bucket_of(begin).alias("bucket"), *cube_of())
    e = e.join(beside, ["c0", "c1", "c2", "bucket"], "left").withColumn("hot", F.coalesce(F.col("last") >= F.col("begin"), F.lit(False)) | F.coalesce(F.col("next") <= F.col("end"), F.lit(False)))
    at = ["lat", "lon", "t", "until"]
    e = stored(e.select("cluster_id", *at, "hot"))
    told, rest = e.filter("hot").select("cluster_id").distinct(), e.filter("not hot").drop("hot")
    if rest.isEmpty():
        return told
    places = few.select("lat", "lon", F.explode(F.array("first", "last")).alias("us")).select("lat", "lon", F.timestamp_micros("us").cast("timestamp_ntz").alias("t"))
    p, b, _, _ = celled(rest.select(*at).distinct(), places, "h_", HOTSPOT_RADIUS_M, [HOTSPOT_RADIUS_M], 6 * HOURS, 30 * HOURS)
    p = p.select(*at, "_px", "_py", "_pz", F.xxhash64("_x", "_y", "_z", "_t").alias("cell"))
    b = b.groupBy(F.xxhash64("_bx", "_by", "_bz", "_bt").alias("h_cell"), "h_lat", "h_lon").agg(F.collect_set("_qs").alias("times"))
    b = b.withColumns(dict(zip(("_qx", "_qy", "_qz"), centre_distances(F.col("h_lat"), F.col("h_lon")), strict=True)))
    chord = sum(((F.col(f"_p{x}") - F.col(f"_q{x}")) * (F.col(f"_p{x}") - F.col(f"_q{x}")) for x in "xyz"), F.lit(0.0))
    close = (chord <= (HOTSPOT_RADIUS_M + 1) ** 2) & (haversine_m(F.col("lat"), F.col("lon"), F.col("h_lat"), F.col("h_lon")) <= HOTSPOT_RADIUS_M)
    in_time = F.exists("times", lambda s: (s - seconds(F.col("t"))).between(F.lit(-6 * HOURS), F.col("until")))
    # the work is in the comparisons, not in the bytes, so partitions aren't put together
    parts = max(8 * events.sparkSession.sparkContext.defaultParallelism, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    p, b = p.repartition(parts, "cell"), b.repartition(parts, "h_cell")
    hit = p.join(b, (F.col("cell") == F.col("h_cell")) & close & in_time, "left_semi").select(*at).distinct()
    return told.unionAll(rest.join(hit, at, "left_semi").select("cluster_id")).distinct()


def mark_thermal(clusters: DataFrame, matched: DataFrame) -> DataFrame:
    """clusters with thermal_corroborated set where matched; never unset."""
    old = F.coalesce(F.col("thermal_corroborated"), F.lit(False)) if "thermal_corroborated" in clusters.columns else F.lit(False)
    hit = matched.select("cluster_id", F.lit(True).alias("_hit"))
    return clusters.join(hit, "cluster_id", "left").withColumn("thermal_corroborated", old | F.col("_hit").isNotNull()).drop("_hit")


def evidence(events: DataFrame) -> DataFrame:
    """What the score of each cluster rests on: n_domains, base, precision, fatality counts, sources and members; one aggregation.

    Domains are made distinct inside each event before they meet, so a cluster gathers names of outlets, not urls.
    """
    domains = F.array_distinct(F.array_compact(F.transform(F.coalesce("source_urls", F.array().cast("array<string>")), root_domain)))
    rank = lookup({p: k for k, p in enumerate(PRECISIONS)}, F.col("geo_precision")).cast("int")
    per = events.select("cluster_id", "source", "fatalities", rank.alias("rank"), F.coalesce(lookup(BASE_SCORE, F.col("source")), F.lit(OTHER_SCORE)).cast("double").alias("base"), domains.alias("domains"))
    named = per.select("cluster_id", F.explode("domains").alias("d")).distinct().groupBy("cluster_id").agg(F.count("*").alias("n_domains"))
    counts = per.groupBy("cluster_id").agg(
        F.max("base").alias("base"),
        F.min("rank").alias("rank"),
        F.count("fatalities").alias("n_fatalities"),
        F.max("fatalities").alias("most"),
        (F.max("fatalities") - F.min("fatalities")).alias("spread"),
        F.count("*").alias("members"),
        F.sort_array(F.collect_set("source")).alias("sources"),
    )
    out = counts.join(named, "cluster_id", "left").withColumn("n_domains", F.coalesce("n_domains", F.lit(0)))
    agree = F.col("spread") <= F.greatest(F.lit(2), F.floor(F.lit(0.2) * F.col("most")).cast("int"))
    return out.withColumn("consistent", F.when(F.col("n_fatalities") >= 2, agree))


def reliability(thermal: Column) -> Column:
    """From the columns of evidence: source, outlets, precision, heat and agreement, between 0 and 1."""
    precise = F.element_at(F.array(*[F.lit(PRECISION_BONUS.get(p, 0.0)) for p in PRECISIONS]), F.col("rank") + 1)
    outlets = F.when(F.col("n_domains") > 1, F.least(F.lit(DOMAIN_STEP) * (F.col("n_domains") - 1), F.lit(DOMAIN_CAP))).otherwise(0.0)
    agree = F.when(F.col("consistent"), CONSISTENCY).when(~F.col("consistent"), -CONSISTENCY).otherwise(0.0)
    total = F.col("base") + outlets + F.coalesce(precise, F.lit(0.0)) + F.when(thermal, THERMAL_BONUS).otherwise(0.0) + agree
    return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 3)


# The phrases of an explanation.
def explanation(thermal: Column) -> Column:
    """The same in words."""
    has = lambda s: F.array_contains("sources", s)
    alone = (F.col("members") == 1) & (F.col("sources") == F.array(F.lit("gdelt")))
    parts = F.concat_ws(
        "; ",
        F.when(has("acled"), "ACLED-curated record"),
        F.when(has("ucdp"), "UCDP-curated record"),
        F.when(F.col("n_domains") > 1, F.concat(F.col("n_domains").cast("string"), F.lit(" independent outlets"))).when(alone, "single GDELT report, uncorroborated"),
        F.when(thermal, "thermal signature corroborated"),
        F.when(F.col("consistent"), "sources agree on fatalities").when(~F.col("consistent"), "sources disagree on fatalities"),
    )
    return F.when(parts == "", "single source").otherwise(parts)


def score_clusters(events: DataFrame, clusters: DataFrame, singletons: bool = False) -> DataFrame:
    """clusters with reliability and explanation. A cluster of one without heat has no score, unless singletons asks for it."""
    thermal = F.coalesce(F.col("thermal_corroborated"), F.lit(False))
    out = clusters.join(evidence(events), "cluster_id", "left")
    scored = F.lit(True) if singletons else (F.col("members") > 1) | thermal
    out = out.withColumns({"reliability": F.when(scored, reliability(thermal)), "explanation": explanation(thermal)})
    return out.drop("base", "rank", "n_fatalities", "most", "spread", "members", "sources", "n_domains", "consistent")
