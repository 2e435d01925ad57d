"""The SQL of the queries' rows, for DuckDB on the same tables."""

from __future__ import annotations

from ..functions.gazetteer import ACTORS, COUNTRIES, WEAPONS
from ..operators import normalize as nz
from ..schema import CATEGORIES, COMPATIBLE, KINETIC, RADIUS_M, SEVERITY
from . import fixtures as fx
from .queries import FORCES, NAMES, WHERE

NOW, SINCE, UNTIL = "TIMESTAMP '2024-01-31'", "TIMESTAMP '2024-01-05'", "TIMESTAMP '2024-01-25'"
EV, HS, NT = fx.EVENTS_SQL, fx.HOTSPOTS_SQL, fx.NOTES_SQL
D = lambda x: f"CAST({x} AS DOUBLE)"
quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def case(table: dict, key: str, default: str | None = None, kind: str | None = None) -> str:
    val = lambda v: f"'{v}'" if isinstance(v, str) else D(v) if kind == "double" else str(v)
    whens = " ".join(f"WHEN {key} = {val(k) if isinstance(k, str) else k} THEN {val(v)}" for k, v in table.items())
    return f"CASE {whens} ELSE {'NULL' if default is None else val(default)} END"


def hav(a: str, b: str) -> str:
    la, oa = f"{a}lat", f"{a}lon"
    lb, ob = f"{b}lat", f"{b}lon"
    return f"({D('12742017.6')} * asin(sqrt(least({D(1)}, pow(sin(radians({lb} - {la}) / 2), 2) + cos(radians({la})) * cos(radians({lb})) * pow(sin(radians({ob} - {oa}) / 2), 2)))))"


TOY = f"ev AS (SELECT *, {fx.CLUSTER} AS cluster_id FROM ev0)"
EV0 = EV.replace("ev AS", "ev0 AS", 1)
TIER = "CASE source WHEN 'acled' THEN 1.0 WHEN 'ucdp' THEN 0.9 WHEN 'gdelt' THEN 0.4 ELSE 0.2 END"
STATS = (
    f"rep AS (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY {TIER} DESC, occurred_at, id) AS k FROM ev WHERE cluster_id IS NOT NULL), "
    "cl AS (SELECT e.cluster_id, r.id AS representative, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen, count(*) AS member_count, avg(lat) AS centroid_lat, avg(lon) AS centroid_lon "
    "FROM ev e JOIN rep r ON e.cluster_id = r.cluster_id AND r.k = 1 GROUP BY e.cluster_id, r.id)"
)
THERMAL = "cl2 AS (SELECT *, cluster_id % 12 = 0 AS thermal_corroborated FROM cl)"
TOYS = f"{EV0}, {TOY}, {STATS}, {THERMAL}"
LIGHT = "e.id, e.cluster_id, e.source, e.occurred_at, e.lat, e.lon, e.geo_precision, e.geo_radius_m, e.country, e.category, e.actor_a, e.fatalities, e.reliability"
#: The fixture's reports have no place name, and no origin before enrichment.
UNKNOWN = "CAST(NULL AS VARCHAR) AS location_name, e.headline"
NO_ORIGIN = "CAST(NULL AS DOUBLE) AS origin_lat, CAST(NULL AS DOUBLE) AS origin_lon, CAST(NULL AS VARCHAR) AS origin_country, CAST(NULL AS VARCHAR) AS origin_precision, CAST(NULL AS VARCHAR) AS origin_method, CAST(NULL AS DOUBLE) AS origin_confidence"


def listed(where: str, extra: str = "", limit: int = 2000) -> str:
    return (
        f"WITH {TOYS}{extra} SELECT {LIGHT}, {UNKNOWN}, {NO_ORIGIN}, coalesce(c.member_count, 1) AS source_count, coalesce(c.thermal_corroborated, false) AS thermal_corroborated "
        f"FROM ev e LEFT JOIN cl2 c ON e.cluster_id = c.cluster_id WHERE (c.representative = e.id OR e.cluster_id IS NULL) AND {where} ORDER BY e.occurred_at DESC, e.id LIMIT {limit}"
    )


LAST_14 = f"e.occurred_at >= {NOW} - INTERVAL 14 DAY"
KEY = "coalesce(cluster_id, -id)"


def weapon_re(aliases: tuple[str, ...]) -> str:
    import re

    words = "|".join(re.escape(a) for a in sorted(aliases, key=lambda a: (-len(a), a)))
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_-])(?:{words})(?:[^\p{{L}}\p{{N}}_-]|$)"


def around(aliases: tuple[str, ...]) -> str:
    """Three parts of a text: what stands before the first hit, the hit, and the rest."""
    import re

    words = "|".join(re.escape(a) for a in sorted(aliases, key=lambda a: (-len(a), a)))
    return rf"(?is)^(.*?(?:^|[^\p{{L}}\p{{N}}_-]))({words})((?:[^\p{{L}}\p{{N}}_-].*)?)$"


def hits(source: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT id AS event_id, '{k}' AS weapon_key, '{n}' AS display_name, '{c}' AS category, {D('0.85')} AS confidence, 'gazetteer' AS method FROM {source} WHERE regexp_matches(notes, '{weapon_re(a)}')" for k, n, c, a in WEAPONS
    )
    return f"wh AS ({rows})"


PAIRS = ", ".join(f"('{a}', '{b}')" for a in CATEGORIES for b in CATEGORIES if a == b or any(a in g and b in g for g in COMPATIBLE))
CAND = (
    f"cand AS (SELECT a.id, b.id AS cand_id, round({hav('a.', 'b.')}, 3) AS distance_m FROM ev a JOIN ev b ON b.occurred_at BETWEEN a.occurred_at - INTERVAL 6 HOUR AND a.occurred_at + INTERVAL 6 HOUR "
    f"AND b.lat BETWEEN a.lat - 1 AND a.lat + 1 AND b.id < a.id WHERE {hav('a.', 'b.')} <= greatest({D(10000)}, {D('a.geo_radius_m')}, {D('b.geo_radius_m')})), "
    "ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance_m, cand_id) AS rn FROM cand) WHERE rn <= 50)"
)
PARENT = (
    f"parents AS (SELECT id, cand_id AS parent FROM (SELECT r.id, r.cand_id, row_number() OVER (PARTITION BY r.id ORDER BY r.rn) AS k FROM ranked r JOIN ev a ON a.id = r.id JOIN ev b ON b.id = r.cand_id "
    f"WHERE (a.category, b.category) IN ({PAIRS}) AND lower(trim(a.actor_a)) = lower(trim(b.actor_a))) WHERE k = 1)"
)
TREE = "up AS (SELECT e.id, e.id AS root FROM ev e LEFT JOIN parents p ON e.id = p.id WHERE p.id IS NULL UNION ALL SELECT p.id, up.root FROM parents p JOIN up ON p.parent = up.id)"
HEAT = (
    f"heat AS (SELECT DISTINCT e.cluster_id FROM ev e JOIN hs h ON h.acquired_at BETWEEN e.occurred_at - INTERVAL 6 HOUR AND e.occurred_at + CASE WHEN e.occurred_at = date_trunc('day', e.occurred_at) THEN INTERVAL 30 HOUR ELSE INTERVAL 6 HOUR END "
    f"AND h.lat BETWEEN e.lat - 0.1 AND e.lat + 0.1 WHERE e.cluster_id IS NOT NULL AND e.category IN ({quoted(KINETIC)}) AND {hav('e.', 'h.')} <= {D(5000)})"
)
DOMAIN = "regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 2)"


def domain(u: str) -> str:
    host = f"regexp_replace(lower({DOMAIN.format(u=u)}), '^www\\.', '')"
    return f"CASE WHEN {DOMAIN.format(u=u)} = '' THEN NULL WHEN {host} LIKE '%.%' THEN regexp_extract({host}, '([^.]*\\.[^.]*)$', 1) ELSE {host} END"


EVIDENCE = (
    f"ed AS (SELECT cluster_id, count(DISTINCT {domain('url')}) AS n_domains FROM ev WHERE cluster_id IS NOT NULL GROUP BY cluster_id), "
    "ec AS (SELECT cluster_id, max(CASE WHEN source IN ('acled', 'ucdp') THEN 70 WHEN source = 'gdelt' THEN 35 ELSE 20 END) AS base, "
    "min(CASE geo_precision WHEN 'exact' THEN 0 WHEN 'settlement' THEN 1 WHEN 'admin2' THEN 2 WHEN 'admin1' THEN 3 ELSE 4 END) AS rank, count(fatalities) AS n_fatalities, "
    "max(fatalities) AS most, max(fatalities) - min(fatalities) AS spread, count(*) AS members, bool_or(source = 'acled') AS has_a, bool_or(source = 'ucdp') AS has_u, bool_and(source = 'gdelt') AS only_g "
    "FROM ev WHERE cluster_id IS NOT NULL GROUP BY cluster_id), "
    "evi AS (SELECT ec.*, ed.n_domains, CASE WHEN n_fatalities >= 2 THEN spread <= greatest(2, CAST(floor(most * 2 / 10) AS INT)) END AS consistent FROM ec JOIN ed ON ec.cluster_id = ed.cluster_id)"
)
SCORE = (
    f"CASE WHEN members > 1 OR thermal_corroborated THEN round({D('greatest(0, least(100, base + CASE WHEN n_domains > 1 THEN least(5 * (n_domains - 1), 15) ELSE 0 END + CASE rank WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 0 END + CASE WHEN thermal_corroborated THEN 15 ELSE 0 END + CASE WHEN consistent THEN 5 WHEN NOT consistent THEN -5 ELSE 0 END))')} / 100, 3) END"
)
EXPLAIN = (
    "coalesce(nullif(concat_ws('; ', CASE WHEN has_a THEN 'ACLED-curated record' END, CASE WHEN has_u THEN 'UCDP-curated record' END, "
    "CASE WHEN n_domains > 1 THEN CAST(n_domains AS VARCHAR) || ' independent outlets' WHEN members = 1 AND only_g THEN 'single GDELT report, uncorroborated' END, "
    "CASE WHEN thermal_corroborated THEN 'thermal signature corroborated' END, CASE WHEN consistent THEN 'sources agree on fatalities' WHEN NOT consistent THEN 'sources disagree on fatalities' END), ''), 'single source')"
)
MATCHED = (
    f"mt AS (SELECT DISTINCT u.id FROM ev u JOIN ev o ON o.occurred_at BETWEEN u.occurred_at - INTERVAL 1 DAY AND u.occurred_at + INTERVAL 1 DAY AND o.lat BETWEEN u.lat - 1 AND u.lat + 1 "
    f"WHERE u.source = 'ucdp' AND o.source <> 'ucdp' AND {hav('u.', 'o.')} <= {D(25000)})"
)
IN_MONTH = "occurred_at >= TIMESTAMP '2024-01-01' AND occurred_at < TIMESTAMP '2024-02-01'"

FIELDS = "source, source_event_id, occurred_at, lat, lon, geo_precision, geo_radius_m, country, admin1, location_name, category, raw_event_type, actor_a, actor_b, fatalities, headline, notes, source_urls"
ACLED_SUB = case(nz.ACLED_SUB_EVENT, "lower(trim(sub_event_type))")
ACLED_CAT = f"coalesce({ACLED_SUB}, {case(nz.ACLED_EVENT, 'lower(trim(event_type))', 'other_violence')})"
ACLED = (
    f"{fx.raw_sql(fx.ACLED_RAW)}, n1 AS (SELECT *, try_cast(latitude AS DOUBLE) AS lat, try_cast(longitude AS DOUBLE) AS lon, CAST(try_strptime(event_date, '%Y-%m-%d') AS TIMESTAMP) AS occurred_at, "
    f"{ACLED_CAT} AS cat, {case(nz.ACLED_PRECISION, 'try_cast(geo_precision AS INT)', 'admin2')} AS prec FROM raw), n2 AS (SELECT * FROM n1 WHERE lat IS NOT NULL AND lon IS NOT NULL)"
)
GOOD = "occurred_at IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"
GCAT = "CASE " + " ".join(f"WHEN starts_with(code, '{p}') THEN '{c}'" for p, c in nz.GDELT_CODES) + " WHEN root = '19' THEN 'ground_assault' ELSE 'other_violence' END"
GDELT = (
    f"{fx.raw_sql(fx.GDELT_RAW)}, g1 AS (SELECT *, trim(c26) AS code, trim(c28) AS root, try_cast(c56 AS DOUBLE) AS lat, try_cast(c57 AS DOUBLE) AS lon, coalesce(try_cast(c51 AS INT), 1) AS kind, "
    "string_split(nullif(c52, ''), ',') AS parts FROM raw), g2 AS (SELECT * FROM g1 WHERE (root IN ('18', '19', '20') OR starts_with(code, '145')) AND lat IS NOT NULL AND lon IS NOT NULL AND kind <> 0)"
)
GPREC = case(nz.GDELT_PRECISION, "kind", "country")
UPREC = case(nz.UCDP_PRECISION, "coalesce(where_prec, 4)", "admin1")
BATCH = (
    f"{EV}, st AS (SELECT * FROM ev WHERE id % 3 <> 2), b1 AS (SELECT *, id AS pos FROM ev WHERE id % 3 <> 0 UNION ALL SELECT * REPLACE (CAST(NULL AS VARCHAR) AS notes), id + 10000000 AS pos FROM ev WHERE id % 3 <> 0 AND id % 5 = 0), "
    "b2 AS (SELECT *, row_number() OVER (PARTITION BY source, source_event_id ORDER BY pos DESC) AS k FROM b1), b AS (SELECT source, source_event_id, coalesce(fatalities, 0) + 1 AS fatalities, notes FROM b2 WHERE k = 1)"
)
FORCED = f"{EV0}, f AS (SELECT * REPLACE ({FORCES} AS actor_a, {WHERE} AS country) FROM ev0), "
COUNTRY_OF = "CASE id % 5 WHEN 0 THEN 'Russia' WHEN 1 THEN 'Sudan' WHEN 2 THEN 'South Sudan' END"
ORIGIN = (
    FORCED
    + "o AS (SELECT *, CASE WHEN category IN ('airstrike', 'drone_strike', 'missile_strike') AND country IS NOT NULL AND "
    + f"{COUNTRY_OF} IS NOT NULL AND lower({COUNTRY_OF}) <> lower(trim(country)) THEN {COUNTRY_OF} END AS origin_country FROM f), "
    + "og AS (SELECT *, "
    + ", ".join(f"CASE origin_country {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN {D(COUNTRIES[c][k])}' for c in ('Russia', 'Sudan', 'South Sudan'))} END AS origin_{n}" for k, n in enumerate(("lat", "lon")))
    + " FROM o)"
)
ANGLE = f"acos(greatest({D(-1)}, least({D(1)}, sin(radians(lat)) * sin(radians({D(10)})) + cos(radians(lat)) * cos(radians({D(10)})) * cos(radians(lon - {D(20)})))))"
RDEG = f"greatest({D('coalesce(geo_radius_m, 10000)')} / 1000 / 111, {D('0.12')})"
ALT = f"least(greatest({D('0.3')} + {RDEG} / 18, {D('0.32')}), {D('1.4')})"
AGE = f"greatest(epoch({NOW} - occurred_at) / 60, 0)"
PRIO = f"{D('0.3')} * exp(-{AGE} / 1440) + {D('0.25')} * least({D('coalesce(fatalities, 0)')} / 20, 1) + {D('0.2')} * coalesce(reliability, {D('0.3')}) + {D('0.25')} * {case(SEVERITY, 'category', 0.4, 'double')}"
SEEN = f"degrees({ANGLE}) < {D(41)}"

ORACLES: dict[str, str] = {
    "cluster_and_list": (
        f"WITH RECURSIVE {EV0}, ev AS (SELECT * FROM ev0), {CAND}, {PARENT}, {TREE}, {HS}, evc AS (SELECT e.*, up.root AS cluster_id FROM ev e JOIN up ON e.id = up.id), "
        f"{STATS.replace('FROM ev ', 'FROM evc ')}, {HEAT.replace('FROM ev ', 'FROM evc ')}, cl2 AS (SELECT cl.*, heat.cluster_id IS NOT NULL AS thermal_corroborated FROM cl LEFT JOIN heat ON cl.cluster_id = heat.cluster_id), "
        f"{EVIDENCE.replace('FROM ev ', 'FROM evc ')}, sc AS (SELECT cl2.cluster_id, {SCORE} AS reliability FROM cl2 JOIN evi ON cl2.cluster_id = evi.cluster_id) "
        f"SELECT {LIGHT.replace('e.reliability', 'sc.reliability')}, {UNKNOWN}, {NO_ORIGIN}, c.member_count AS source_count, c.thermal_corroborated FROM evc e JOIN cl2 c ON c.representative = e.id JOIN sc ON sc.cluster_id = c.cluster_id WHERE e.occurred_at >= {SINCE} ORDER BY e.occurred_at DESC, e.id LIMIT 10000"
    ),
    "list_events_default": listed(LAST_14),
    "list_events_bbox": listed(f"e.occurred_at >= {SINCE} AND e.occurred_at <= {UNTIL} AND e.lon BETWEEN -100 AND 60 AND e.lat BETWEEN -40 AND 30"),
    "list_events_country": listed(f"{LAST_14} AND lower(e.country) IN ('nation_3', 'nation_7') AND e.category IN ('airstrike', 'ied')"),
    "list_events_reliability": listed(f"{LAST_14} AND coalesce(e.reliability, 0) >= 0.5"),
    "list_events_actor": listed(f"{LAST_14} AND coalesce(e.cluster_id, -e.id) IN (SELECT {KEY} FROM ev WHERE actor_a ILIKE '%actor3%')"),
    "list_events_weapon": listed(f"{LAST_14} AND coalesce(e.cluster_id, -e.id) IN (SELECT {KEY} FROM ev JOIN wh ON ev.id = wh.event_id WHERE weapon_key IN ('himars', 'grad'))", f", {hits('ev')}"),
    "event_detail_members": f"WITH {EV0}, {TOY} SELECT a.id AS event_id, m.id, m.source, m.occurred_at, m.fatalities, row_number() OVER (PARTITION BY a.id ORDER BY m.occurred_at, m.id) AS place FROM ev a JOIN ev m ON a.cluster_id = m.cluster_id",
    "event_payload": (
        f"WITH {TOYS}, {EVIDENCE}, {hits('ev')}, ab AS (SELECT cluster_id, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, string_agg(url, '|' ORDER BY id) AS urls FROM ev WHERE cluster_id IS NOT NULL GROUP BY cluster_id), "
        "wk AS (SELECT event_id, string_agg(weapon_key, '|' ORDER BY weapon_key) AS weapons FROM wh GROUP BY event_id) "
        f"SELECT e.id, e.cluster_id, coalesce(ab.sources, e.source) AS sources, CASE WHEN e.cluster_id IS NULL THEN coalesce(e.url, '') ELSE coalesce(ab.urls, '') END AS source_urls, coalesce(c.member_count, 1) AS source_count, {SCORE} AS reliability, "
        f"CASE WHEN e.cluster_id IS NOT NULL THEN {EXPLAIN} END AS reliability_explanation, coalesce(c.thermal_corroborated, false) AS thermal_corroborated, wk.weapons "
        "FROM ev e LEFT JOIN ab ON e.cluster_id = ab.cluster_id LEFT JOIN cl2 c ON e.cluster_id = c.cluster_id LEFT JOIN evi ON e.cluster_id = evi.cluster_id LEFT JOIN wk ON wk.event_id = e.id"
    ),
    "facet_country": f"WITH {EV} SELECT country, count(*) AS n FROM ev WHERE country IS NOT NULL GROUP BY country ORDER BY n DESC, country LIMIT 300",
    "facet_actor": f"WITH {EV} SELECT actor, count(*) AS n FROM (SELECT actor_a AS actor FROM ev UNION ALL SELECT actor_b FROM ev) WHERE actor IS NOT NULL GROUP BY actor ORDER BY n DESC, actor LIMIT 300",
    "facet_weapon": f"WITH {NT}, {hits('nt')} SELECT weapon_key, min(display_name) AS display_name, count(DISTINCT event_id) AS n FROM wh GROUP BY weapon_key",
    "hotspots_recent": f"WITH {HS} SELECT * FROM hs WHERE acquired_at >= {SINCE} AND lon BETWEEN -100 AND 60 AND lat BETWEEN -40 AND 30 ORDER BY acquired_at DESC, id LIMIT 5000",
    "baseline_totals": (
        f"WITH {EV0}, {TOY}, {MATCHED}, t AS (SELECT count(*) AS total, count(mt.id) AS matched FROM ev LEFT JOIN mt ON ev.id = mt.id WHERE source = 'ucdp' AND {IN_MONTH}) "
        f"SELECT '2024-01' AS month, total, matched, CASE WHEN total > 0 THEN round_even({D('matched')} / total, 3) END AS match_rate, (SELECT count(DISTINCT {KEY}) FROM ev WHERE source <> 'ucdp' AND {IN_MONTH}) AS pipeline_incidents FROM t"
    ),
    "baseline_by_country": f"WITH {EV}, {MATCHED} SELECT coalesce(country, '(unknown)') AS country, count(*) AS total, count(mt.id) AS matched FROM ev LEFT JOIN mt ON ev.id = mt.id WHERE source = 'ucdp' AND {IN_MONTH} GROUP BY 1 ORDER BY total DESC, country LIMIT 30",
    "baseline_months": f"WITH {EV} SELECT DISTINCT strftime(occurred_at, '%Y-%m') AS month FROM ev WHERE source = 'ucdp'",
    "normalize_acled": (
        f"WITH {ACLED} SELECT 'acled' AS source, event_id_cnty AS source_event_id, occurred_at, lat, lon, prec AS geo_precision, CAST({case(RADIUS_M, 'prec')} AS INT) AS geo_radius_m, nullif(country, '') AS country, nullif(admin1, '') AS admin1, "
        "nullif(location, '') AS location_name, CASE WHEN cat = 'airstrike' AND coalesce(lower(tags) LIKE '%drone%', false) THEN 'drone_strike' ELSE cat END AS category, coalesce(event_type, '') || '/' || coalesce(sub_event_type, '') AS raw_event_type, "
        f"nullif(actor1, '') AS actor_a, nullif(actor2, '') AS actor_b, try_cast(fatalities AS INT) AS fatalities, CAST(NULL AS VARCHAR) AS headline, nullif(notes, '') AS notes, '' AS source_urls FROM n2 WHERE {GOOD}"
    ),
    "normalize_acled_rejects": f"WITH {ACLED} SELECT 'acled' AS source, event_id_cnty AS source_event_id, CASE WHEN occurred_at IS NULL THEN 'bad date' ELSE 'place out of range' END AS reason FROM n2 WHERE NOT coalesce({GOOD}, false)",
    "normalize_gdelt": (
        f"WITH {GDELT} SELECT 'gdelt' AS source, c0 AS source_event_id, CAST(try_strptime(c1, '%Y%m%d') AS TIMESTAMP) AS occurred_at, lat, lon, {GPREC} AS geo_precision, CAST({case(RADIUS_M, f'({GPREC})')} AS INT) AS geo_radius_m, "
        f"trim(parts[len(parts)]) AS country, CASE WHEN len(parts) = 3 THEN trim(parts[2]) END AS admin1, trim(parts[1]) AS location_name, {GCAT} AS category, code AS raw_event_type, nullif(c6, '') AS actor_a, nullif(c16, '') AS actor_b, "
        "CAST(NULL AS INT) AS fatalities, CAST(NULL AS VARCHAR) AS headline, CAST(NULL AS VARCHAR) AS notes, trim(c60) AS source_urls FROM g2"
    ),
    "gdelt_payload": f"WITH {fx.raw_sql(fx.GDELT_RAW)} SELECT c0 AS source_event_id, c26 AS code, CAST(17 AS BIGINT) AS n FROM raw",
    "normalize_ucdp": (
        f"WITH {fx.raw_sql(fx.UCDP_RAW)}, u AS (SELECT *, CAST(try_strptime(substr(date_start, 1, 10), '%Y-%m-%d') AS TIMESTAMP) AS occurred_at FROM raw) SELECT 'ucdp' AS source, CAST(id AS VARCHAR) AS source_event_id, occurred_at, latitude AS lat, longitude AS lon, {UPREC} AS geo_precision, "
        f"CAST({case(RADIUS_M, f'({UPREC})')} AS INT) AS geo_radius_m, nullif(country, '') AS country, nullif(adm_1, '') AS admin1, nullif(where_coordinates, '') AS location_name, {case(nz.UCDP_CATEGORY, 'type_of_violence', 'other_violence')} AS category, "
        f"{case(nz.UCDP_LABEL, 'type_of_violence')} AS raw_event_type, side_a AS actor_a, side_b AS actor_b, best AS fatalities, dyad_name AS headline, source_headline AS notes, '' AS source_urls FROM u WHERE latitude IS NOT NULL AND id IS NOT NULL AND occurred_at IS NOT NULL"
    ),
    "normalize_firms": (
        f"WITH {fx.raw_sql(fx.FIRMS_RAW)}, h AS (SELECT coalesce(satellite, 'unknown') AS satellite, try_strptime(acq_date || ' ' || lpad(acq_time, 4, '0'), '%Y-%m-%d %H%M') AS acquired_at, try_cast(latitude AS DOUBLE) AS lat, try_cast(longitude AS DOUBLE) AS lon, "
        "coalesce(try_cast(bright_ti4 AS DOUBLE), try_cast(brightness AS DOUBLE)) AS brightness, try_cast(frp AS DOUBLE) AS frp, confidence FROM raw) SELECT * REPLACE (CAST(acquired_at AS TIMESTAMP) AS acquired_at) FROM h WHERE acquired_at IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL"
    ),
    "ucdp_watermark": f"WITH {fx.raw_sql(fx.UCDP_RAW)} SELECT max(CAST(try_strptime(substr(date_start, 1, 10), '%Y-%m-%d') AS TIMESTAMP)) AS watermark FROM raw",
    "gdelt_category": f"WITH {fx.raw_sql(fx.GDELT_RAW)}, g AS (SELECT c0, trim(c26) AS code, trim(c28) AS root FROM raw) SELECT c0, {GCAT} AS category FROM g",
    "default_radius": f"WITH {EV} SELECT id, CAST(coalesce(CASE WHEN id % 2 = 0 THEN geo_radius_m END, {case(RADIUS_M, 'geo_precision')}) AS BIGINT) AS radius FROM ev",
    "upsert_events": (
        f"WITH {BATCH} SELECT coalesce(s.source, b.source) AS source, coalesce(s.source_event_id, b.source_event_id) AS source_event_id, s.id, CASE WHEN b.source IS NOT NULL THEN b.fatalities ELSE s.fatalities END AS fatalities, "
        "CASE WHEN b.source IS NOT NULL THEN b.notes ELSE s.notes END AS notes, s.reliability FROM st s FULL OUTER JOIN b ON s.source = b.source AND s.source_event_id = b.source_event_id"
    ),
    "upsert_new_ids": f"WITH {BATCH} SELECT b.source, b.source_event_id FROM b LEFT JOIN st s ON s.source = b.source AND s.source_event_id = b.source_event_id WHERE s.source IS NULL",
    "insert_ignore_hotspots": (
        f"WITH {HS}, b AS (SELECT *, id AS pos FROM hs UNION ALL SELECT * REPLACE ({D(0)} AS frp), -id AS pos FROM hs), r AS (SELECT *, row_number() OVER (PARTITION BY satellite, acquired_at, lat, lon ORDER BY pos) AS k FROM b) "
        "SELECT satellite, acquired_at, lat, lon, frp FROM r WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM hs WHERE hs.id % 4 = 0 AND hs.satellite = r.satellite AND hs.acquired_at = r.acquired_at AND hs.lat = r.lat AND hs.lon = r.lon)"
    ),
    "watermark_update": (
        f"WITH {fx.small_sql('m', fx.MARKS)}, {fx.small_sql('r', fx.RUNS)} SELECT coalesce(m.source, r.source) AS source, CASE WHEN coalesce(r.ok, false) THEN coalesce(r.watermark, m.watermark) ELSE m.watermark END AS watermark, "
        "CASE WHEN coalesce(r.ok, false) THEN r.at ELSE m.last_success_at END AS last_success_at, CASE WHEN r.ok IS NOT NULL THEN r.at ELSE m.last_attempt_at END AS last_attempt_at, "
        "CASE WHEN r.ok THEN NULL WHEN r.ok IS NOT NULL THEN substr(r.error, 1, 1000) ELSE m.last_error END AS last_error, "
        "CAST(CASE WHEN r.ok THEN 0 WHEN r.ok IS NOT NULL THEN coalesce(m.consecutive_failures, 0) + 1 ELSE coalesce(m.consecutive_failures, 0) END AS INT) AS consecutive_failures, "
        "CAST(coalesce(m.records_ingested, 0) + CASE WHEN coalesce(r.ok, false) THEN r.new_records ELSE 0 END AS BIGINT) AS records_ingested FROM m FULL OUTER JOIN r ON m.source = r.source"
    ),
    "feed_health": (
        f"WITH {fx.small_sql('m', fx.MARKS)}, {fx.small_sql('c', fx.CREDENTIALS)} SELECT coalesce(m.source, c.provider) AS source, watermark, last_success_at, last_attempt_at, last_error, coalesce(consecutive_failures, 0) AS consecutive_failures, "
        "coalesce(records_ingested, 0) AS records_ingested, c.status AS credential_status FROM m FULL OUTER JOIN c ON m.source = c.provider"
    ),
    "credentials_due": f"WITH {fx.small_sql('c', fx.CREDENTIALS)} SELECT provider FROM c WHERE auth_type <> 'static_key' AND status <> 'dead' AND (access_expires_at IS NULL OR access_expires_at < TIMESTAMP '2024-01-31 02:00:00')",
    "weapon_hits": f"WITH {NT}, {hits('nt')} SELECT * FROM wh",
    "actor_vocabulary": f"WITH {EV} SELECT DISTINCT name FROM (SELECT actor_a AS name FROM ev WHERE source = 'acled' UNION SELECT actor_b FROM ev WHERE source = 'acled') WHERE name IS NOT NULL",
    "actor_alias": f"WITH {EV}, n AS (SELECT DISTINCT {NAMES} AS name FROM ev) SELECT name, {case(ACTORS, 'lower(trim(name))')} AS canonical FROM n WHERE name IS NOT NULL",
    "origin_inference": f"WITH {ORIGIN} SELECT id, origin_country, origin_lat, origin_lon, CASE WHEN origin_country IS NOT NULL THEN 'country' END AS origin_precision, CASE WHEN origin_country IS NOT NULL THEN 'actor_country_inference' END AS origin_method, CASE WHEN origin_country IS NOT NULL THEN {D('0.5')} END AS origin_confidence FROM og",
    "strike_arcs": f"WITH {ORIGIN} SELECT id, origin_lat AS start_lat, origin_lon AS start_lon, lat AS end_lat, lon AS end_lon FROM og WHERE origin_lat IS NOT NULL",
    "category_compat_pairs": f"WITH {EV}, c AS (SELECT DISTINCT category AS a FROM ev) SELECT x.a, y.a AS b FROM c x JOIN c y ON (x.a, y.a) IN ({PAIRS})",
    "cluster_candidates": f"WITH {EV}, {CAND} SELECT id, cand_id, distance_m, rn FROM ranked",
    "cluster_parents": f"WITH {EV}, {CAND}, {PARENT} SELECT id, parent FROM parents",
    "cluster_assign": f"WITH RECURSIVE {EV}, {CAND}, {PARENT}, {TREE} SELECT id, root AS cluster_id FROM up",
    "cluster_stats": f"WITH {EV0}, {TOY}, {STATS} SELECT * REPLACE (round(centroid_lat, 9) AS centroid_lat, round(centroid_lon, 9) AS centroid_lon) FROM cl",
    "thermal_corroboration": f"WITH {TOYS}, {HS}, {HEAT} SELECT c.cluster_id, c.thermal_corroborated OR h.cluster_id IS NOT NULL AS thermal_corroborated FROM cl2 c LEFT JOIN heat h ON c.cluster_id = h.cluster_id",
    "root_domains": f"SELECT page_id, {domain('url')} AS domain FROM pages",
    "reliability_evidence": f"WITH {TOYS}, {EVIDENCE} SELECT cluster_id, n_domains, n_fatalities, members, consistent FROM evi",
    "reliability_score": f"WITH {TOYS}, {EVIDENCE} SELECT c.cluster_id, {SCORE} AS reliability FROM cl2 c JOIN evi ON c.cluster_id = evi.cluster_id",
    "reliability_explain": f"WITH {TOYS}, {EVIDENCE} SELECT c.cluster_id, {EXPLAIN} AS explanation FROM cl2 c JOIN evi ON c.cluster_id = evi.cluster_id",
    "live_priority_top50": f"WITH {EV} SELECT id, round(round({PRIO}, 9), 6) AS priority FROM ev ORDER BY round({PRIO}, 9) DESC, id LIMIT 50",
    "live_next_flight": f"WITH {EV} SELECT id, NOT ({SEEN} AND {D('0.5')} <= {ALT} * {D('1.6')}) AS fly FROM ev ORDER BY round({PRIO}, 9) DESC, id LIMIT 1",
    "client_window": f"WITH {EV} SELECT id FROM ev WHERE category IN ('airstrike', 'ied', 'protest') AND coalesce(reliability, 0) >= 0.3 AND occurred_at <= {UNTIL} AND occurred_at >= {UNTIL} - INTERVAL 168 HOUR",
    "live_filter": f"WITH {EV}, {hits('ev')} SELECT DISTINCT ev.id FROM ev JOIN wh ON ev.id = wh.event_id WHERE lower(country) IN ('nation_1', 'nation_2', 'nation_4') AND lower(actor_a) LIKE '%actor%' AND weapon_key IN ('himars', 'iskander_m')",
    "replay_windows": (
        f"WITH {EV}, k AS (SELECT id, CAST(floor(epoch(occurred_at) / 2160) AS BIGINT) - i AS slot FROM ev, range(0, 10) t(i)) "
        "SELECT CAST(to_timestamp(slot * 2160 + 21600) AT TIME ZONE 'UTC' AS TIMESTAMP) AS window_end, count(*) AS n FROM k GROUP BY slot"
    ),
    "viewport_visible": f"WITH {EV} SELECT id, {SEEN} AS on_screen, {SEEN} AND {D('0.5')} <= {ALT} * {D('1.6')} AS presented FROM ev",
    "presentation_scores": (
        f"WITH {EV} SELECT id, round({RDEG}, 6) AS radius_deg, round(greatest({RDEG} * {D('1.6')}, {D('1.2')}), 6) AS ring_deg, round({D('0.08')} + {D('0.5')} * least(greatest(coalesce(reliability, {D('0.25')}), 0), 1), 6) AS fill_alpha, "
        f"coalesce(reliability, 0) >= 0.5 AS core_dot, round(CASE WHEN epoch({NOW} - occurred_at) BETWEEN 0 AND 3600 THEN 1 - epoch({NOW} - occurred_at) / 3600 ELSE 0 END, 6) AS recency_boost, "
        f"CAST(8000 + least(coalesce(fatalities, 0) * 250, 7000) AS BIGINT) AS dwell_ms, round({ALT}, 6) AS target_altitude FROM ev"
    ),
    "great_circle_distance": f"WITH {EV} SELECT id, round({hav('', 'q.')}, 3) AS distance_m FROM ev, (SELECT {D(10)} AS lat, {D(20)} AS lon) q".replace("radians(lat)", "radians(ev.lat)").replace("- lat)", "- ev.lat)").replace("- lon)", "- ev.lon)"),
    "list_events_origin": (
        f"WITH {ORIGIN} SELECT e.id, CAST(NULL AS BIGINT) AS cluster_id, {LIGHT.replace('e.id, e.cluster_id, ', '')}, {UNKNOWN}, e.origin_lat, e.origin_lon, e.origin_country, CASE WHEN e.origin_country IS NOT NULL THEN 'country' END AS origin_precision, "
        f"CASE WHEN e.origin_country IS NOT NULL THEN 'actor_country_inference' END AS origin_method, CASE WHEN e.origin_country IS NOT NULL THEN {D('0.5')} END AS origin_confidence, CAST(1 AS BIGINT) AS source_count, false AS thermal_corroborated "
        f"FROM og e WHERE {LAST_14} ORDER BY e.occurred_at DESC, e.id LIMIT 2000"
    ),
    "acled_payload": f"WITH {ACLED} SELECT event_id_cnty AS source_event_id, CAST(to_json(struct_pack({', '.join(f'{c} := {c}' for c in fx.ACLED_RAW)})) AS VARCHAR) AS raw_payload FROM n2 WHERE {GOOD}",
    "filter_options": (
        f"WITH {EV}, {NT}, {hits('nt')}, a AS (SELECT actor, count(*) AS n FROM (SELECT actor_a AS actor FROM ev UNION ALL SELECT actor_b FROM ev) WHERE actor IS NOT NULL GROUP BY actor ORDER BY n DESC, actor LIMIT 100), "
        "w AS (SELECT weapon_key, count(DISTINCT event_id) AS n FROM wh GROUP BY weapon_key ORDER BY n DESC, weapon_key LIMIT 10) SELECT 'actor' AS kind, actor AS option, n FROM a UNION ALL SELECT 'weapon', weapon_key, n FROM w"
    ),
    "event_cards": (
        f"WITH {EV}, u AS (SELECT id - id % 40 AS c, list(url ORDER BY id) FILTER (url IS NOT NULL) AS urls FROM ev GROUP BY 1) "
        "SELECT id, coalesce(array_to_string(urls[1:12], '|'), '') AS shown_urls, CAST(greatest(coalesce(len(urls), 0) - 12, 0) AS BIGINT) AS more_urls FROM ev JOIN u ON ev.id - ev.id % 40 = u.c"
    ),
    "weapon_evidence": (
        f"WITH {NT}, h AS ("
        + " UNION ALL ".join(f"SELECT id, '{k}' AS weapon_key, regexp_extract(notes, '{around(a)}', ['b', 'h', 'a']) AS p FROM nt WHERE regexp_matches(notes, '{weapon_re(a)}')" for k, _, _, a in WEAPONS)
        + ") SELECT id AS event_id, weapon_key, regexp_replace(right(p.b, 60) || p.h || left(p.a, 60), '^\\s+|\\s+$', '', 'g') AS evidence_span FROM h"
    ),
    "actor_fuzzy": (
        f"WITH {EV}, v AS (SELECT DISTINCT actor_a AS known FROM ev WHERE source = 'acled' AND actor_a IS NOT NULL), n AS (SELECT DISTINCT name FROM (SELECT 'Group of ' || actor_a AS name FROM ev UNION ALL SELECT actor_a FROM ev) WHERE name IS NOT NULL) "
        "SELECT name, (SELECT min(known) FROM v WHERE list_has_all(string_split(name, ' '), string_split(known, ' '))) AS canonical FROM n"
    ),
    "canonicalize": (
        f"WITH {EV}, e AS (SELECT id, source, {NAMES} AS actor_a FROM ev), v AS (SELECT DISTINCT actor_a AS known FROM e WHERE source = 'acled' AND actor_a IS NOT NULL) "
        f"SELECT e.id, e.actor_a, CASE WHEN e.source IN ('acled', 'ucdp') THEN e.actor_a ELSE coalesce({case(ACTORS, 'lower(trim(e.actor_a))')}, v.known) END AS actor_a_canonical, CAST(NULL AS VARCHAR) AS actor_b_canonical FROM e LEFT JOIN v ON trim(e.actor_a) = trim(v.known)"
    ),
    "great_circle_path": (
        f"WITH {ORIGIN}, a AS (SELECT id, radians(origin_lat) AS p, radians(origin_lon) AS o, radians(lat) AS q, radians(lon) AS r FROM og WHERE origin_lat IS NOT NULL), "
        f"w AS (SELECT *, acos(greatest({D(-1)}, least({D(1)}, sin(p) * sin(q) + cos(p) * cos(q) * cos(o - r)))) AS w FROM a), s AS (SELECT *, CAST(i AS INT) AS step, CASE WHEN {D('i')} / 8 < {D('0.5')} THEN 4 * pow({D('i')} / 8, 3) ELSE 1 - pow(-2 * ({D('i')} / 8) + 2, 3) / 2 END AS e FROM w, range(0, 9) t(i)), "
        "fl AS (SELECT *, CASE WHEN sin(w) = 0 THEN 1 - e ELSE sin((1 - e) * w) / sin(w) END AS x1, CASE WHEN sin(w) = 0 THEN e ELSE sin(e * w) / sin(w) END AS x2 FROM s), "
        "g AS (SELECT id, step, x1 * cos(p) * cos(o) + x2 * cos(q) * cos(r) AS x, x1 * cos(p) * sin(o) + x2 * cos(q) * sin(r) AS y, x1 * sin(p) + x2 * sin(q) AS z FROM fl) "
        "SELECT id, step, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon FROM g"
    ),
    "stream_ingest": (
        f"WITH RECURSIVE {GDELT}, ev AS (SELECT CAST(c0 AS BIGINT) AS id, c0, CAST(try_strptime(c1, '%Y%m%d') AS TIMESTAMP) AS occurred_at, lat, lon, CAST({case(RADIUS_M, f'({GPREC})')} AS INT) AS geo_radius_m, {GCAT} AS category, coalesce(nullif(c6, ''), '') AS actor_a FROM g2), "
        # radii go up to 250 km
        f"{CAND.replace('a.lat - 1 AND a.lat + 1', 'a.lat - 3 AND a.lat + 3')}, {PARENT}, {TREE} SELECT 'gdelt' AS source, ev.c0 AS source_event_id, ev.category, ev.lat, ev.lon, CAST(up.root AS VARCHAR) AS cluster_of FROM ev JOIN up ON ev.id = up.id"
    ),
    "stream_list": (
        f"WITH RECURSIVE {GDELT}, ev AS (SELECT CAST(c0 AS BIGINT) AS id, 'gdelt' AS source, CAST(try_strptime(c1, '%Y%m%d') AS TIMESTAMP) AS occurred_at, lat, lon, {GPREC} AS geo_precision, "
        f"CAST({case(RADIUS_M, f'({GPREC})')} AS INT) AS geo_radius_m, {GCAT} AS category, coalesce(nullif(c6, ''), '') AS actor_a, CAST(NULL AS INT) AS fatalities, nullif(trim(c60), '') AS url FROM g2), "
        f"{CAND.replace('a.lat - 1 AND a.lat + 1', 'a.lat - 3 AND a.lat + 3')}, {PARENT}, {TREE}, evc AS (SELECT ev.*, up.root AS cluster_id FROM ev JOIN up ON ev.id = up.id), "
        f"{fx.raw_sql(fx.FIRMS_RAW).replace('raw AS', 'fr AS', 1)}, hs AS (SELECT CAST(try_strptime(acq_date || ' ' || lpad(acq_time, 4, '0'), '%Y-%m-%d %H%M') AS TIMESTAMP) AS acquired_at, "
        "try_cast(latitude AS DOUBLE) AS lat, try_cast(longitude AS DOUBLE) AS lon FROM fr), "
        f"{HEAT.replace('FROM ev ', 'FROM evc ')}, {EVIDENCE.replace('FROM ev ', 'FROM evc ')}, "
        "cl AS (SELECT c.cluster_id, min(occurred_at) AS occurred_at, count(*) AS source_count, max((heat.cluster_id IS NOT NULL)::INT) = 1 AS thermal_corroborated FROM evc c LEFT JOIN heat ON c.cluster_id = heat.cluster_id GROUP BY c.cluster_id) "
        f"SELECT CAST(cl.cluster_id AS VARCHAR) AS cluster_of, occurred_at, source_count, thermal_corroborated, {SCORE} AS reliability FROM cl JOIN evi ON cl.cluster_id = evi.cluster_id WHERE occurred_at >= {SINCE}"
    ),
    "replay_windows_all": (
        f"WITH {EV}, k AS (SELECT span_h, country, CAST(floor(epoch(occurred_at) / 2160) AS BIGINT) + 1 + i AS slot FROM ev, (SELECT unnest([6, 24, 72, 168, 336]) AS span_h), range(0, 560) t(i) WHERE i < span_h * 60 / 36) "
        "SELECT CAST(span_h AS BIGINT) AS span_h, CAST(to_timestamp(slot * 2160) AT TIME ZONE 'UTC' AS TIMESTAMP) AS window_end, count(*) AS n, count(DISTINCT country) AS countries FROM k GROUP BY span_h, slot"
    ),
    "display_strings": (
        f"WITH {EV}, m AS (SELECT id, occurred_at, CAST(floor(epoch({NOW} - occurred_at) / 60 + 0.5) AS BIGINT) AS m FROM ev), h AS (SELECT *, CAST(floor({D('m')} / 60 + 0.5) AS BIGINT) AS h FROM m) "
        f"SELECT id, CASE WHEN m < 60 THEN m || ' min ago' WHEN h < 48 THEN h || ' h ago' ELSE CAST(floor({D('h')} / 24 + 0.5) AS BIGINT) || ' d ago' END AS ago, strftime(occurred_at, '%Y-%m-%d %H:%M UTC') AS utc FROM h"
    ),
    "outlets": (
        "WITH h AS (SELECT page_id, url, regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1) AS h FROM pages) "
        "SELECT page_id, CASE WHEN h = '' THEN url ELSE regexp_replace(lower(h), '^www\\.', '') END AS outlet FROM h"
    ),
    "weapon_labels": f"WITH {NT}, {hits('nt')} SELECT event_id, weapon_key, CASE WHEN event_id % 3 = 0 THEN 'possible ' ELSE '' END || display_name AS label FROM wh",
    "stream_dequeue": (
        f"WITH {EV}, p AS (SELECT *, round({PRIO}, 9) AS priority, row_number() OVER (PARTITION BY category ORDER BY round({PRIO}, 9) DESC, id) AS k FROM ev) "
        f"SELECT category AS viewer, {NOW} + k * INTERVAL 1 MINUTE AS at, id, priority, NOT ({SEEN} AND {D('0.5')} <= {ALT} * {D('1.6')}) AS fly FROM p WHERE k <= 10"
    ),
}
ORACLES["list_events_actor_index"] = ORACLES["list_events_actor"]
months = "(SELECT string_agg(m, '|' ORDER BY m) FROM (SELECT DISTINCT strftime(occurred_at, '%Y-%m') AS m FROM ev WHERE source = 'ucdp'))"
ORACLES["baseline_default"] = f"WITH ev AS (SELECT * FROM ({EV.replace('ev AS (', '', 1)[:-1]})), b AS ({ORACLES['baseline_totals']}) SELECT true AS available, CAST(NULL AS VARCHAR) AS note, b.*, {months} AS months_with_data FROM b"
ORACLES["feed_labels"] = (
    f"WITH h AS ({ORACLES['feed_health']}), m AS (SELECT *, CAST(floor(epoch({NOW} - last_success_at) / 60 + 0.5) AS BIGINT) AS m FROM h), t AS (SELECT *, CAST(floor({D('m')} / 60 + 0.5) AS BIGINT) AS h FROM m) "
    "SELECT source, source || ': ' || CASE WHEN credential_status = 'dead' THEN 'credential dead' WHEN credential_status = 'degraded' THEN 'auth degraded, retrying' WHEN last_error <> '' THEN consecutive_failures || ' failed — ' || last_error "
    f"WHEN last_success_at IS NOT NULL THEN 'ok ' || CASE WHEN m < 60 THEN m || ' min ago' WHEN h < 48 THEN h || ' h ago' ELSE CAST(floor({D('h')} / 24 + 0.5) AS BIGINT) || ' d ago' END ELSE 'no data yet' END AS label, "
    "coalesce(credential_status IN ('dead', 'degraded'), false) OR coalesce(last_error <> '', false) AS bad FROM t"
)
