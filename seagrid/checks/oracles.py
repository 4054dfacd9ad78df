"""Plain SQL for the registered queries, written without the library.

Neighbour, distance and nearest-cell questions are answered by brute force
over all pairs here; the operators do not work that way.
"""

from __future__ import annotations

from seagrid.rules import COAST_BANDS, EXPECTED_SOURCES, LANDING_SITES, STATUS_TEXT

ORACLES: dict[str, str] = {}


def r(expr: str, digits: int = 6) -> str:
    unit = f"CAST(1e{digits} AS DOUBLE)"
    return f"(round_even(({expr}) * {unit}, 0) / {unit})"


def quoted(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    body = ", ".join(
        "(" + ", ".join(quoted(x) if isinstance(x, str) else repr(x) for x in row) + ")"
        for row in rows
    )
    return f"{name}({columns}) AS (VALUES {body})"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


KEY = "region, date, lat_idx, lon_idx"
LAT = "round_even((CAST(1.0 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (lat_idx + CAST(0.5 AS DOUBLE))) * 1e4, 0) / 1e4"
LON = "round_even((CAST(44.0 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (lon_idx + CAST(0.5 AS DOUBLE))) * 1e4, 0) / 1e4"
DY = "(CAST(0.1 AS DOUBLE) * 111.32)"
DX = "(CAST(0.1 AS DOUBLE) * 111.32 * cos(radians(CAST(2.0 AS DOUBLE))))"

BASE = """b AS (
  SELECT l_orderkey // 15000 AS region, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
    CAST(l_partkey % 20 AS INT) AS lat_idx, CAST(l_suppkey % 20 AS INT) AS lon_idx,
    CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS p,
    CAST(round(l_discount * 100) AS INT) AS dd, CAST(round(l_tax * 100) AS INT) AS tt,
    l_returnflag AS rf FROM lineitem)"""
CELL_DAY = BASE + """,
cell_day AS (
  SELECT region, date, lat_idx, lon_idx,
    CASE WHEN lat_idx > lon_idx + 3 THEN NULL
      ELSE CAST(sum(q) AS DOUBLE) / (count(*) * 5) + 22 END AS sst,
    CASE WHEN (lat_idx * 7 + lon_idx * 3 + month(date)) % 5 = 0 THEN NULL
      ELSE CAST(sum(p) AS DOUBLE) / (count(*) * 10000000) END AS chl,
    CASE WHEN (lat_idx + lon_idx) % 6 = 0 THEN NULL
      ELSE CAST(max(dd) * 25 AS DOUBLE) / 100 END AS wave_height_max,
    CAST(max(tt) * 45 AS DOUBLE) / 10 AS wind_speed_max,
    max(CASE WHEN rf = 'R' AND q > 40 THEN 1 ELSE 0 END) AS fished
  FROM b GROUP BY region, date, lat_idx, lon_idx)"""
SEA = CELL_DAY + ",\nsea AS (SELECT * FROM cell_day WHERE sst IS NOT NULL)"


def grad(source: str = "cell_day") -> str:
    def side(alias: str, di: int, dj: int) -> str:
        return (
            f"LEFT JOIN {source} {alias} ON {alias}.region = c.region AND {alias}.date = c.date "
            f"AND {alias}.lat_idx = c.lat_idx + ({di}) AND {alias}.lon_idx = c.lon_idx + ({dj})"
        )

    def slope(pos: str, a: str, z: str) -> str:
        return (
            f"(CASE c.{pos} WHEN 0 THEN {a}.sst - c.sst WHEN 19 THEN c.sst - {z}.sst "
            f"ELSE ({a}.sst - {z}.sst) / 2 END) / CAST(0.1 AS DOUBLE)"
        )

    lat = LAT.replace("lat_idx", "c.lat_idx")
    return f"""grad AS (
  SELECT * EXCLUDE (gn, ge), CASE WHEN sst IS NULL THEN NULL ELSE sqrt(gn * gn + ge * ge) * 100 END AS sst_gradient
  FROM (SELECT c.*, {slope('lat_idx', 'u', 'd')} / 111.32 AS gn,
      {slope('lon_idx', 'e', 'w')} / (cos(radians({lat})) * 111.32) AS ge
    FROM {source} c {side('u', 1, 0)} {side('d', -1, 0)} {side('e', 0, 1)} {side('w', 0, -1)}))"""


def pct(col: str, source_key: str = "region, date") -> str:
    return (
        f"CASE WHEN {col} IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY {source_key} ORDER BY {col} NULLS LAST) "
        f"+ (count(*) OVER (PARTITION BY {source_key}, {col}) - 1) / CAST(2.0 AS DOUBLE)) "
        f"/ count({col}) OVER (PARTITION BY {source_key}) * 100 END"
    )


SCORED = """ranked AS (
  SELECT *, %s AS rc, %s AS rg FROM grad WHERE sst IS NOT NULL),
scored AS (
  SELECT * EXCLUDE (rc, rg), CASE WHEN rc IS NULL AND rg IS NULL THEN NULL ELSE
    round_even((coalesce(rc, 0) * CAST(0.55 AS DOUBLE) + coalesce(rg, 0) * CAST(0.45 AS DOUBLE))
      / (CASE WHEN rc IS NULL THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.55 AS DOUBLE) END
       + CASE WHEN rg IS NULL THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.45 AS DOUBLE) END) * 10, 0) / 10 END AS score
  FROM ranked)""" % (pct("chl"), pct("sst_gradient"))


def safety(wave: str = "wave_height_max", wind: str = "wind_speed_max") -> str:
    return (
        f"CASE WHEN {wave} IS NULL OR {wind} IS NULL THEN 'LAMA_OGA' "
        f"WHEN {wave} > 2.0 OR {wind} > 30 THEN 'KHATAR' "
        f"WHEN {wave} < 1.25 AND {wind} < 20 THEN 'AMMAAN' ELSE 'TAXADDAR' END"
    )


SITES = values(
    "sites", "ord, site_id, site_so, site_en, slat, slon",
    [(k, *s) for k, s in enumerate(LANDING_SITES)],
)


def coast(keys: str = "region", source: str = "sea") -> str:
    ks = keys.split(", ")
    same = " AND ".join(f"o.{k} = l.{k}" for k in ks)
    return f"""ocean AS (SELECT DISTINCT {keys}, lat_idx, lon_idx FROM {source}),
land AS (SELECT k.*, gi.i, gj.j FROM (SELECT DISTINCT {keys} FROM ocean) k,
    (SELECT CAST(range AS INT) AS i FROM range(20)) gi, (SELECT CAST(range AS INT) AS j FROM range(20)) gj
  WHERE NOT EXISTS (SELECT 1 FROM ocean o WHERE {' AND '.join(f'o.{k} = k.{k}' for k in ks)}
    AND o.lat_idx = gi.i AND o.lon_idx = gj.j)),
coast AS (SELECT {', '.join('o.' + k for k in ks)}, o.lat_idx, o.lon_idx,
    min(sqrt(pow((o.lat_idx - l.i) * {DY}, 2) + pow((o.lon_idx - l.j) * {DX}, 2))) AS dist_coast_km
  FROM ocean o LEFT JOIN land l ON {same} GROUP BY ALL)"""


def km(lat: str, lon: str, lat2: str, lon2: str) -> str:
    return (
        f"2 * 6371.0 * asin(sqrt(greatest(0.0, least(1.0, pow(sin((radians({lat2}) - radians({lat})) / 2), 2) "
        f"+ cos(radians({lat})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon})) / 2), 2)))))"
    )


def band_case(column: int) -> str:
    whens = " ".join(
        f"WHEN dist_coast_km >= {b[0]} AND dist_coast_km < {b[1]} THEN "
        + quoted((f"{b[0]}-{b[1]}", b[2], b[3])[column])
        for b in COAST_BANDS
    )
    return f"CASE {whens} END"


def zoned(keys: str = "region") -> str:
    return f"""{SITES},
plane AS (
  SELECT * EXCLUDE (rn, ord, slat, slon), {band_case(0)} AS band, {band_case(1)} AS band_so,
    {band_case(2)} AS band_en, coalesce(dist_coast_km <= 50 AND site_km <= 80, FALSE) AS reachable
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, lat_idx, lon_idx ORDER BY site_km, ord) AS rn
    FROM (SELECT c.*, s.*, {km('(' + LAT + ')', '(' + LON + ')', 's.slat', 's.slon')} AS site_km FROM coast c, sites s))
  WHERE rn = 1)"""


ZONE_ID = "site_id || '_' || band"


def mean(col: str, digits: int) -> str:
    exact = f"avg(CAST(round_even({col} * 1e6, 0) AS BIGINT)) / CAST(1e6 AS DOUBLE)"
    return r(exact, digits)


ZONES = f"""zones AS (
  SELECT region, date, zone_id, min(band_so) || ' ' || min(site_so) AS name_so,
    min(site_en) || ' ' || lower(min(band_en)) AS name_en, min(band) AS band_km, count(*) AS n_cells,
    min(site_id) AS site_id, {mean('lat', 3)} AS centre_lat, {mean('lon', 3)} AS centre_lon,
    {r('min(lat) - CAST(0.1 AS DOUBLE) / 2', 3)} AS lat_min, {r('max(lat) + CAST(0.1 AS DOUBLE) / 2', 3)} AS lat_max,
    {r('min(lon) - CAST(0.1 AS DOUBLE) / 2', 3)} AS lon_min, {r('max(lon) + CAST(0.1 AS DOUBLE) / 2', 3)} AS lon_max,
    {mean('site_km', 1)} AS distance_km,
    {r("avg(CAST(round_even(site_km * 1e6, 0) AS BIGINT)) / CAST(1e6 AS DOUBLE) / 18", 1)} AS travel_hours,
    {mean('score', 1)} AS score, 'physics_index' AS score_source,
    CASE WHEN sd >= 0.34 THEN 'KHATAR' WHEN ss >= 0.5 THEN 'AMMAAN' WHEN su > 0.5 THEN 'LAMA_OGA'
      ELSE 'TAXADDAR' END AS safety,
    {r('sd', 2)} AS share_dangerous, {mean('sst', 1)} AS sst, {mean('chl', 3)} AS chl,
    {mean('sst_gradient', 2)} AS sst_gradient, {mean('wave_height_max', 2)} AS wave_height_max,
    {mean('wind_speed_max', 0)} AS wind_speed_max
  FROM (SELECT *, avg(CAST(state = 'KHATAR' AS INT)) OVER z AS sd, avg(CAST(state = 'AMMAAN' AS INT)) OVER z AS ss,
      avg(CAST(state = 'LAMA_OGA' AS INT)) OVER z AS su
    FROM (SELECT s.*, p.* EXCLUDE (region, lat_idx, lon_idx), {ZONE_ID} AS zone_id, {safety()} AS state,
        {LAT.replace('lat_idx', 's.lat_idx')} AS lat, {LON.replace('lon_idx', 's.lon_idx')} AS lon
      FROM scored s JOIN plane p ON s.region = p.region AND s.lat_idx = p.lat_idx AND s.lon_idx = p.lon_idx
      WHERE reachable AND band IS NOT NULL)
    WINDOW z AS (PARTITION BY region, date, zone_id))
  GROUP BY region, date, zone_id, sd, ss, su)"""
SEVERITY = "CASE safety WHEN 'AMMAAN' THEN 0 WHEN 'TAXADDAR' THEN 1 WHEN 'LAMA_OGA' THEN 2 ELSE 3 END"
RANKED = f"""ranks AS (
  SELECT *, row_number() OVER (PARTITION BY region, date ORDER BY {SEVERITY}, score DESC NULLS LAST, zone_id) AS rank
  FROM zones)"""


def level(score: str) -> str:
    return f"CASE WHEN {score} IS NULL THEN 'unknown' WHEN {score} >= 70 THEN 'high' WHEN {score} >= 45 THEN 'mid' ELSE 'low' END"


ZONE_CHAIN = ",\n".join([SEA, grad(), SCORED, coast(), zoned(), ZONES, RANKED])

PIXEL_DAY = """px AS (
  SELECT user_id // 150 AS region, CAST(ts AS DATE) AS date, CAST((user_id % 150) // 15 AS INT) AS lat_idx,
    CAST(user_id % 15 AS INT) AS lon_idx,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100) AS value
  FROM events GROUP BY user_id, CAST(ts AS DATE)),
pixel_day AS (
  SELECT *, CASE WHEN (lat_idx * 3 + lon_idx + day(date)) % 4 <> 0 THEN value END AS chl,
    CASE WHEN (lat_idx * 3 + lon_idx + day(date)) % 4 <> 0 AND (day(date) BETWEEN 3 AND 6 OR day(date) = 30)
      THEN value END AS plane
  FROM px)"""
READINGS = """readings AS (SELECT ts AS time, user_id, value - 250 AS u,
  length(event_type) * CAST(60.0 AS DOUBLE) - CAST(330.0 AS DOUBLE) AS v, value FROM events)"""
EFFORT = """effort AS (
  SELECT l_orderkey // 15000 AS region, CAST(l_shipdate AS DATE) AS date, CAST(l_partkey % 22 AS INT) AS lat_idx,
    CAST(l_suppkey % 20 AS INT) AS lon_idx, l_quantity AS q,
    CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE '(unknown)' END AS flag FROM lineitem)"""
EFFORT_MONTHS = EFFORT + """,
ecells AS (
  SELECT region, CAST(date_trunc('month', date) AS DATE) AS date, lat_idx, lon_idx,
    CAST(sum(CAST(q AS BIGINT)) AS DOUBLE) / 10 AS fishing_hours, CAST(count(*) AS INT) AS n_vessels
  FROM effort WHERE lat_idx < 20 GROUP BY ALL)"""
SOUNDINGS = """soundings AS (
  SELECT l_orderkey // 15000 AS region, CAST(l_partkey % 20 AS INT) AS lat_idx, CAST(l_suppkey % 20 AS INT) AS lon_idx,
    CAST(round_even(l_extendedprice / 25, 0) AS BIGINT) - 3900
      + CASE WHEN l_partkey % 20 > l_suppkey % 20 + 3 THEN 4000 ELSE 0 END AS elevation FROM lineitem),
seabed AS (
  SELECT region, lat_idx, lon_idx, CASE WHEN avg(elevation) < 0 THEN -avg(elevation) END AS depth,
    stddev_pop(elevation) AS seabed_roughness,
    CAST(sum(CASE WHEN elevation >= 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS land_fraction
  FROM soundings GROUP BY ALL)"""
COARSE = """coarse AS (
  SELECT o_orderkey // 15000 AS region, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
    CAST(o_custkey % 10 AS INT) AS ci, CAST(o_orderkey % 10 AS INT) AS cj,
    CASE WHEN (o_custkey % 10 + o_orderkey % 10 + month(o_orderdate)) % 7 = 0 THEN NULL
      ELSE CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 99991) END AS v
  FROM orders GROUP BY region, CAST(date_trunc('month', o_orderdate) AS DATE), ci, cj,
    (o_custkey % 10 + o_orderkey % 10 + month(o_orderdate)) % 7)"""


def bilinear(source: str, keys: str, v: str) -> str:
    """Every target cell asks for its four nodes."""
    ks = keys.split(", ")

    def node(a: str, i: str, j: str) -> str:
        same = " AND ".join(f"{a}.{k} = t.{k}" for k in ks)
        return f"LEFT JOIN {source} {a} ON {same} AND {a}.ci = {i} AND {a}.cj = {j}"

    return f"""axis AS (
  SELECT CAST(range AS INT) AS t, CAST((range * 0.1 + 0.05) / 0.2 AS DOUBLE) AS x FROM range(20)),
line AS (SELECT t, CAST(floor(x) AS INT) AS lo, x - floor(x) AS f FROM axis WHERE x <= 9),
targets AS (SELECT k.*, a.t AS lat_idx, a.lo AS il, a.f AS fi, z.t AS lon_idx, z.lo AS jl, z.f AS fj
  FROM (SELECT DISTINCT {keys} FROM {source}) k, line a, line z),
{v}_grid AS (
  SELECT {', '.join('t.' + k for k in ks)}, t.lat_idx, t.lon_idx,
    a.{v} * (1 - fi) * (1 - fj) + b.{v} * (1 - fi) * fj + c.{v} * fi * (1 - fj) + d.{v} * fi * fj AS {v}
  FROM targets t {node('a', 'il', 'jl')} {node('b', 'il', 'jl + 1')} {node('c', 'il + 1', 'jl')} {node('d', 'il + 1', 'jl + 1')}
  WHERE coalesce(a.ci, b.ci, c.ci, d.ci) IS NOT NULL)"""


FOUND = """found AS (
  SELECT CASE WHEN o_orderstatus = 'O' THEN 'nrt' ELSE 'historical' END AS mode, year(o_orderdate) AS year,
    CASE WHEN year(o_orderdate) % 5 = CAST(o_orderpriority[1] AS INT) % 5 THEN 'other'
      WHEN o_orderstatus = 'O' THEN (['sst', 'chl', 'cur', 'thetao', 'wav'])[CAST(o_orderpriority[1] AS INT)]
      ELSE (['sst', 'chl', 'phy', 'wav', 'wnd'])[CAST(o_orderpriority[1] AS INT)] END AS source,
    (['analysed_sst', 'CHL', 'uo', 'vo', 'thetao', 'VHM0', 'eastward_wind'])[o_custkey % 7 + 1] AS variable,
    CAST(o_orderdate AS DATE) AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS bytes FROM orders)"""
EXPECTED = values("expected", "mode, source, dataset_id", [s[:3] for s in EXPECTED_SOURCES])
WANTED = values(
    "wanted", "mode, source, variable", [(s[0], s[1], x) for s in EXPECTED_SOURCES for x in s[3]]
)
WINDOWS = """windows AS (
  SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS start_day, CAST(max(o_orderdate) AS DATE) AS end_day,
    (['sst', 'chl', 'phy', 'wav', 'wnd'])[o_custkey % 5 + 1] AS source,
    CASE WHEN o_custkey % 3 = 0 THEN 'nrt' ELSE 'historical' END AS mode FROM orders GROUP BY o_custkey)"""


def chunks(source: str, unit: str) -> str:
    fmt = {"month": "%Y-%m", "year": "%Y"}[unit]
    return f"""(SELECT o_custkey, source, mode, strftime(m, '{fmt}') AS chunk,
    greatest(start_day, CAST(m AS DATE)) AS chunk_start,
    least(end_day, CAST(m + INTERVAL 1 {unit} - INTERVAL 1 day AS DATE)) AS chunk_end
  FROM (SELECT *, unnest(generate_series(date_trunc('{unit}', start_day), CAST(end_day AS TIMESTAMP), INTERVAL 1 {unit})) AS m
    FROM {source}))"""


def add(name: str, sql: str) -> None:
    ORACLES[name] = sql


# ------------------------------------------------------------ grid and scalars

add("grid_cells", f"""
SELECT g.*, format('c_{{:04d}}_{{:04d}}', lat_idx, lon_idx) AS cell_id,
  {LAT} AS lat, {LON} AS lon, coalesce(n, 0) AS n
FROM (SELECT CAST(a.range AS INT) AS lat_idx, CAST(z.range AS INT) AS lon_idx FROM range(20) a, range(20) z) g
LEFT JOIN (SELECT l_partkey % 20 AS i, l_suppkey % 20 AS j, count(*) AS n FROM lineitem GROUP BY ALL)
  ON i = lat_idx AND j = lon_idx""")
add("cell_index", """
SELECT *, lat_idx BETWEEN 0 AND 19 AND lon_idx BETWEEN 0 AND 19 AS on_grid,
  printf('c_%04d_%04d', lat_idx, lon_idx) AS cell_id
FROM (SELECT *, CAST(round_even((lat - 1.0 - CAST(0.1 AS DOUBLE) / 2) / CAST(0.1 AS DOUBLE), 0) AS INT) AS lat_idx,
    CAST(round_even((lon - 44.0 - CAST(0.1 AS DOUBLE) / 2) / CAST(0.1 AS DOUBLE), 0) AS INT) AS lon_idx,
    lat BETWEEN 1.0 AND 3.0 AND lon BETWEEN 44.0 AND 46.0 AS in_box
  FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey * 7 % 2600 AS DOUBLE) / 1000 + CAST(0.9 AS DOUBLE) AS lat,
      CAST(l_orderkey * 13 % 2600 AS DOUBLE) / 1000 + CAST(43.9 AS DOUBLE) AS lon FROM lineitem))""")
add("unit_conversion", f"""
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, {r("l_quantity + 270 - CAST(273.15 AS DOUBLE)")} AS celsius,
  {r("l_quantity * CAST(3.6 AS DOUBLE)")} AS kmh,
  {r("sqrt(l_quantity * l_quantity + (l_discount * 100) * (l_discount * 100))")} AS speed,
  CASE WHEN l_quantity / 20 > 0.5 THEN 1 ELSE 0 END AS fished,
  {r("least(greatest((l_discount * CAST(12.3456 AS DOUBLE) - CAST(0.1 AS DOUBLE)) * 100, 0), 100)", 1)} AS shown
FROM lineitem""")
add("cyclic_month", f"""
SELECT o_orderkey, CAST(month(o_orderdate) AS INT) AS month, {r("sin((month(o_orderdate) - 1) * (2 * pi()) / 12)")} AS month_sin,
  {r("cos((month(o_orderdate) - 1) * (2 * pi()) / 12)")} AS month_cos FROM orders""")
add("safety_class", with_(CELL_DAY) + f"SELECT {KEY}, {safety()} AS safety FROM cell_day")
add("coast_band", f"""
SELECT l_orderkey, l_linenumber, {band_case(0)} AS band, {band_case(1)} AS band_so, {band_case(2)} AS band_en,
  coalesce(dist_coast_km <= 50 AND l_discount * 1000 <= 80, FALSE) AS reachable,
  l_returnflag || '_' || {band_case(0)} AS zone_id
FROM (SELECT *, CASE WHEN l_tax > 0 THEN l_quantity * 2 - 2 END AS dist_coast_km FROM lineitem)""")
add("zone_rating", f"""
SELECT o_orderkey, level,
  CASE level WHEN 'unknown' THEN 'Lama oga' WHEN 'high' THEN 'Rajo fiican' WHEN 'mid' THEN 'Dhexdhexaad' ELSE 'Rajo yar' END AS so,
  CASE level WHEN 'unknown' THEN 'Unknown' WHEN 'high' THEN 'Promising' WHEN 'mid' THEN 'Moderate' ELSE 'Poor' END AS en
FROM (SELECT o_orderkey, {level("CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 5000 END")} AS level FROM orders)""")
add("navigable", with_(SEA) + f"""
SELECT {KEY}, wave_height_max, wind_speed_max FROM sea WHERE wave_height_max <= 2.0 AND wind_speed_max <= 30""")
add("snap_effort", with_(SOUNDINGS) + """
SELECT lat_idx, lon_idx, count(*) AS n, CAST(sum(elevation) AS BIGINT) AS elevation FROM soundings GROUP BY ALL""")

# ------------------------------------------------------- sources and planning

add("missing_sources", with_(FOUND, EXPECTED) + """
SELECT mode, source, dataset_id FROM expected e
WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.mode = e.mode AND f.source = e.source)""")
BY_YEAR = """
SELECT e.mode, e.source, CAST(y.year AS INT) AS year FROM expected e JOIN (SELECT DISTINCT mode, year FROM found) y USING (mode)
WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.mode = e.mode AND f.source = e.source AND f.year = y.year)"""
add("missing_by_year", with_(FOUND, EXPECTED) + BY_YEAR)
add("missing_training_sources", with_(FOUND, EXPECTED) + BY_YEAR + " AND e.source IN ('sst', 'chl', 'phy')")
add("coverage_check", with_(FOUND, EXPECTED, WANTED) + """
SELECT e.mode, e.source, s.first, s.last, coalesce(a.missing, '') AS missing,
  CASE WHEN s.first IS NULL THEN 'MISSING' WHEN a.missing IS NOT NULL THEN 'VARS?' ELSE 'OK' END AS status
FROM expected e
LEFT JOIN (SELECT mode, source, min(day) AS first, max(day) AS last FROM found GROUP BY ALL) s USING (mode, source)
LEFT JOIN (SELECT mode, source, string_agg(variable, ',' ORDER BY variable) AS missing FROM wanted w
  WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.mode = w.mode AND f.source = w.source AND f.variable = w.variable)
  GROUP BY ALL) a USING (mode, source)""")
add("clamp_windows", with_(WINDOWS) + """
SELECT o_custkey, start_day, end_day, source, mode,
  CASE WHEN mode = 'historical' THEN start_day WHEN end_day > last_day THEN greatest(first_day, last_day - span)
    WHEN source = 'chl' THEN end_day - span ELSE start_day END AS load_start,
  CASE WHEN mode <> 'historical' AND end_day > last_day THEN last_day ELSE end_day END AS load_end
FROM (SELECT w.*, first_day, last_day, CAST(CASE WHEN w.source = 'chl' THEN greatest(40, end_day - start_day)
    ELSE end_day - start_day END AS INT) AS span
  FROM windows w LEFT JOIN (SELECT source, min(start_day) AS first_day, max(end_day) - 400 AS last_day
    FROM windows WHERE source <> 'wnd' GROUP BY source) b USING (source))""")
add("calendar_chunks", with_(WINDOWS) + f"SELECT * EXCLUDE (source, mode) FROM {chunks('windows', 'month')}")
add("calendar_years", with_(WINDOWS) + f"SELECT * EXCLUDE (source, mode) FROM {chunks('windows', 'year')}")
add("load_chunks", with_(
    WINDOWS,
    "fine AS (SELECT * FROM windows WHERE mode <> 'nrt' AND source IN ('wav', 'wnd'))",
    "rough AS (SELECT * FROM windows WHERE mode <> 'nrt' AND source NOT IN ('wav', 'wnd'))",
) + f"""
SELECT * FROM {chunks('fine', 'month')} UNION ALL SELECT * FROM {chunks('rough', 'year')}
UNION ALL SELECT o_custkey, source, mode, CAST(start_day AS VARCHAR) || '_' || CAST(end_day AS VARCHAR), start_day, end_day
FROM windows WHERE mode = 'nrt'""")
add("pending_chunks", with_(WINDOWS) + f"""
SELECT * EXCLUDE (source, mode) FROM {chunks('windows', 'month')} c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.o_custkey AND strftime(o_orderdate, '%Y-%m') = c.chunk)""")
add("source_inventories", with_(FOUND) + f"""
SELECT mode, source, count(*) AS files, {r('sum(bytes) / CAST(1e6 AS DOUBLE)')} AS megabytes,
  CAST(min(year) AS VARCHAR) AS first_label, CAST(max(year) AS VARCHAR) AS last_label
FROM (SELECT mode, source, year, CAST(sum(bytes) AS BIGINT) AS bytes FROM found GROUP BY ALL) GROUP BY mode, source""")
add("source_inventory_unfit", with_(FOUND) + f"""
SELECT CASE WHEN year % 2 = 0 THEN mode ELSE 'unmatched' END AS mode, CASE WHEN year % 2 = 0 THEN source ELSE 'unmatched' END AS source,
  count(*) AS files, {r('sum(bytes) / CAST(1e6 AS DOUBLE)')} AS megabytes,
  CAST(min(year) FILTER (year % 2 = 0) AS VARCHAR) AS first_label, CAST(max(year) FILTER (year % 2 = 0) AS VARCHAR) AS last_label
FROM (SELECT mode, source, year, CAST(sum(bytes) AS BIGINT) AS bytes FROM found GROUP BY ALL) GROUP BY 1, 2""")
add("file_rows", "SELECT 'lineitem.parquet' AS file, count(*) AS n_rows FROM lineitem")
add("flatten_effort_rows", f"""
SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, {r('(l_partkey % 22) * CAST(0.1 AS DOUBLE) + 1')} AS lat,
  CAST(NULL AS DOUBLE) AS lon, {r('l_quantity / 10')} AS hours, l_returnflag AS flag,
  CAST(l_linenumber AS VARCHAR) AS geartype, CAST(NULL AS VARCHAR) AS "vesselType" FROM lineitem""")

# ------------------------------------------------------------------- features

add("daily_stats", with_(READINGS) + f"""
SELECT user_id, CAST(time AS DATE) AS date, {r('avg(value)')} AS value_mean, {r('max(value)')} AS value_max,
  {r('avg(u)')} AS u_mean, {r('max(u)')} AS u_max FROM readings GROUP BY ALL""")
for _kind, _top in (("true", "max(sqrt(u * u + v * v))"), ("component", "sqrt(max(u) * max(u) + max(v) * max(v))")):
    add(f"wind_speed_max_{_kind}", with_(READINGS) + f"""
SELECT user_id, CAST(time AS DATE) AS date, {r('sqrt(avg(u) * avg(u) + avg(v) * avg(v)) * 3.6')} AS wind_speed,
  {r(_top + ' * 3.6')} AS wind_speed_max FROM readings GROUP BY ALL""")
add("regrid_bilinear", with_(COARSE, bilinear("coarse", "region, date", "v")) + f"SELECT {KEY}, {r('v')} AS v FROM v_grid")
add("regrid_float32", ORACLES["regrid_bilinear"])
add("regrid_unmatched", with_(COARSE) + """
SELECT region, count(*) AS readings, count(*) FILTER (ci % 3 = 0 OR cj = 9) AS unmatched FROM coarse GROUP BY region""")
add("sst_gradient", with_(CELL_DAY, grad()) + f"SELECT {KEY}, {r('sst_gradient')} AS sst_gradient FROM grad")
FILL = f"""near AS (
  SELECT m.region, m.date, m.lat_idx, m.lon_idx, x.wave_height_max, row_number() OVER (
      PARTITION BY m.region, m.date, m.lat_idx, m.lon_idx
      ORDER BY sqrt(pow((x.lat_idx - m.lat_idx) * {DY}, 2) + pow((x.lon_idx - m.lon_idx) * {DX}, 2)),
        x.lat_idx - m.lat_idx, x.lon_idx - m.lon_idx) AS rn
  FROM cell_day m JOIN cell_day x ON m.region = x.region AND m.date = x.date
  WHERE m.wave_height_max IS NULL AND x.wave_height_max IS NOT NULL
    AND sqrt(pow((x.lat_idx - m.lat_idx) * {DY}, 2) + pow((x.lon_idx - m.lon_idx) * {DX}, 2)) <= 30),
filled AS (
  SELECT c.* EXCLUDE (wave_height_max), coalesce(c.wave_height_max, n.wave_height_max) AS wave_height_max,
    CASE WHEN c.wave_height_max IS NULL AND n.wave_height_max IS NOT NULL THEN 1 ELSE 0 END AS wave_estimated
  FROM cell_day c LEFT JOIN (SELECT * FROM near WHERE rn = 1) n USING ({KEY}))"""
add("fill_nearest", with_(CELL_DAY, FILL) + f"SELECT {KEY}, wave_height_max, wave_estimated FROM filled")
add("sst_gradient_tiled", ORACLES["sst_gradient"])
add("fill_nearest_tiled", ORACLES["fill_nearest"])


def trailing(days: int, least: int, frame: str, source: str, part: str = "region, lat_idx, lon_idx") -> str:
    return f"""
SELECT {KEY}, CASE WHEN count(chl) OVER w >= {least} THEN {r('avg(chl) OVER w')} END AS mean
FROM {source} WINDOW w AS (PARTITION BY {part} ORDER BY {frame})"""


def numbered(source: str, part: str = "region") -> str:
    """Rows with the number of their day among all days of the region."""
    return f"numbered AS (SELECT *, dense_rank() OVER (PARTITION BY {part} ORDER BY date) AS day FROM {source})"


add("trailing_mean_7", with_(PIXEL_DAY, numbered("pixel_day")) + trailing(
    7, 3, "day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW", "numbered"))
add("trailing_mean_14", with_(PIXEL_DAY, numbered("pixel_day")) + trailing(
    14, 5, "day RANGE BETWEEN 13 PRECEDING AND CURRENT ROW", "numbered"))
add("trailing_mean_gaps", with_(
    PIXEL_DAY, "holed AS (SELECT * FROM pixel_day WHERE (lat_idx + lon_idx + day(date)) % 3 <> 0)", numbered("holed"),
) + trailing(7, 3, "day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW", "numbered"))
add("trailing_mean_calendar", with_(PIXEL_DAY) + trailing(
    7, 3, "date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW", "pixel_day"))
add("trailing_mean_per_year", with_(SEA, numbered("sea", "region, year(date)")) + trailing(
    7, 3, "day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW", "numbered", "region, lat_idx, lon_idx, year(date)"))
add("carry_forward", with_(
    PIXEL_DAY,
    """seen AS (SELECT region, date FROM pixel_day WHERE plane IS NOT NULL GROUP BY ALL)""",
    """src AS (SELECT d.region, d.date, max(s.date) AS src_date FROM (SELECT DISTINCT region, date FROM pixel_day) d
  LEFT JOIN seen s ON s.region = d.region AND s.date <= d.date GROUP BY ALL)""",
) + f"""
SELECT p.region, p.date, p.lat_idx, p.lon_idx, CASE WHEN p.date - s.src_date <= 21 THEN {r('o.plane')} END AS plane,
  CASE WHEN p.date - s.src_date <= 21 THEN {r('o.chl')} END AS chl, CAST(p.date - s.src_date AS INT) AS chl_age_days
FROM pixel_day p JOIN src s USING (region, date)
LEFT JOIN pixel_day o ON o.region = p.region AND o.date = s.src_date AND o.lat_idx = p.lat_idx AND o.lon_idx = p.lon_idx""")
add("carry_forward_per_cell", with_(PIXEL_DAY) + f"""
SELECT {KEY}, CASE WHEN date - seen_at <= 21 THEN {r('v')} END AS plane, CAST(date - seen_at AS INT) AS chl_age_days
FROM (SELECT p.*, o.date AS seen_at, o.plane AS v FROM pixel_day p ASOF LEFT JOIN
  (SELECT * FROM pixel_day WHERE plane IS NOT NULL) o
  ON o.region = p.region AND o.lat_idx = p.lat_idx AND o.lon_idx = p.lon_idx AND p.date >= o.date)""")
add("align_sources", with_(CELL_DAY, COARSE, bilinear("coarse", "region, date", "v"), EFFORT_MONTHS) + f"""
SELECT {KEY}, {r('sst')} AS sst, {r('v')} AS v, {r('fishing_hours')} AS fishing_hours
FROM (SELECT {KEY}, sst FROM cell_day) FULL JOIN v_grid USING ({KEY})
FULL JOIN (SELECT {KEY}, fishing_hours FROM ecells) USING ({KEY})
QUALIFY count(coalesce(sst, v, fishing_hours)) OVER (PARTITION BY region, date) > 0""")
add("land_drop", with_(CELL_DAY) + f"SELECT {KEY}, {r('sst')} AS sst FROM cell_day WHERE lat_idx <= lon_idx + 3")
add("bathymetry", with_(SOUNDINGS) + f"""
SELECT region, lat_idx, lon_idx, {r('depth')} AS depth, {r('seabed_roughness')} AS seabed_roughness,
  {r('land_fraction')} AS land_fraction FROM seabed""")
add("bathymetry_interpolated", with_(
    COARSE,
    "nodes AS (SELECT region, ci, cj, min(v) * 10 - 400 AS elevation FROM coarse GROUP BY ALL)",
    bilinear("nodes", "region", "elevation"),
) + f"""
SELECT region, lat_idx, lon_idx, CASE WHEN elevation < 0 THEN {r('-elevation')} END AS depth,
  CAST(NULL AS DOUBLE) AS seabed_roughness,
  CAST(CASE WHEN elevation >= 0 THEN 1 ELSE 0 END AS DOUBLE) AS land_fraction FROM elevation_grid""")
add("depth_report", with_(SOUNDINGS) + f"""
SELECT region, {r('quantile_cont(depth, 0.5)')} AS median_depth, {r('min(depth)')} AS min_depth,
  {r('max(depth)')} AS max_depth, count(*) - count(depth) AS cells_above_sea FROM seabed GROUP BY region""")
add("join_static", with_(SEA, SOUNDINGS) + f"""
SELECT {KEY}, {r('depth')} AS depth, {r('land_fraction')} AS land_fraction
FROM sea LEFT JOIN seabed USING (region, lat_idx, lon_idx)""")
add("distance_to_coast", with_(SEA, coast()) + f"SELECT region, lat_idx, lon_idx, {r('dist_coast_km')} AS dist_coast_km FROM coast")
add("distance_to_coast_tiled", ORACLES["distance_to_coast"])

# --------------------------------------------------------------------- labels

add("effort_cells", with_(EFFORT) + f"""
SELECT {KEY}, {r('CAST(sum(CAST(q AS BIGINT)) AS DOUBLE) / 10')} AS fishing_hours, CAST(count(*) AS INT) AS n_vessels
FROM effort WHERE lat_idx < 20 GROUP BY ALL""")
add("effort_totals", with_(EFFORT) + f"""
SELECT count(*) AS n_rows, {r('CAST(sum(CAST(q AS BIGINT)) AS DOUBLE) / 10')} AS hours, min(date) AS first_day,
  max(date) AS last_day, count(DISTINCT (region, date, lat_idx, lon_idx)) AS cell_days,
  count(DISTINCT (region, lat_idx, lon_idx)) AS cells
FROM effort""")
add("effort_report", with_(EFFORT) + f"""
SELECT flag, {r('CAST(sum(CAST(q AS BIGINT)) AS DOUBLE) / 10')} AS hours,
  {r('CAST(sum(CAST(q AS BIGINT)) AS DOUBLE) * 100 / (SELECT sum(CAST(q AS BIGINT)) FROM effort)')} AS share_pct
FROM effort GROUP BY flag ORDER BY hours DESC, flag LIMIT 10""")
add("flag_share", with_(EFFORT) + f"""
SELECT 'R' AS flag, {r("CAST(sum(CASE WHEN flag = 'R' THEN CAST(q AS BIGINT) END) AS DOUBLE) * 100 / sum(CAST(q AS BIGINT))")} AS share_pct
FROM effort""")
add("join_labels", with_(SEA, EFFORT_MONTHS) + f"""
SELECT {KEY}, {r('coalesce(fishing_hours, 0)')} AS fishing_hours, coalesce(n_vessels, 0) AS n_vessels,
  CASE WHEN fishing_hours > 0.5 THEN 1 ELSE 0 END AS fished
FROM (SELECT {KEY} FROM sea) LEFT JOIN ecells USING ({KEY})""")
add("label_match_report", with_(SEA, EFFORT_MONTHS) + f"""
SELECT region, count(*) AS effort_cell_days, count(s.hit) AS matched,
  {r('CAST(count(s.hit) AS DOUBLE) / count(*)')} AS match_rate, CAST(count(s.hit) AS DOUBLE) / count(*) < 0.5 AS warn
FROM ecells LEFT JOIN (SELECT {KEY}, 1 AS hit FROM sea) s USING ({KEY}) GROUP BY region""")
add("build_report", with_(CELL_DAY) + f"""
SELECT region, CAST(year(date) AS INT) AS year, count(sst) AS kept, count(*) - count(sst) AS dropped_land,
  count(*) FILTER (sst IS NOT NULL AND fished = 1) AS positives, min(date) FILTER (sst IS NOT NULL) AS first_day,
  max(date) FILTER (sst IS NOT NULL) AS last_day,
  {r('CAST(count(*) FILTER (sst IS NOT NULL AND fished = 1) AS DOUBLE) / nullif(count(sst), 0)')} AS positive_rate
FROM cell_day GROUP BY ALL""")

# ------------------------------------------------------ confound and baselines


def active(source: str) -> str:
    return f"""rates AS (SELECT CAST(month(date) AS INT) AS month, avg(fished) AS rate FROM {source} GROUP BY ALL),
flat AS (SELECT max(rate) - min(rate) < 0.2 * (CASE avg(rate) WHEN 0 THEN 1 ELSE avg(rate) END) AS uniform FROM rates),
active AS (SELECT month FROM rates, flat WHERE NOT uniform AND rate >= 0.002
  UNION ALL SELECT CAST(range AS INT) FROM range(1, 13), flat WHERE uniform AND range NOT IN (7, 8))"""


QUIET = "quiet AS (SELECT * REPLACE (CASE WHEN month(date) IN (2, 11) THEN 0 ELSE fished END AS fished) FROM sea)"
add("fleet_active_months", with_(SEA, active("sea")) + "SELECT month FROM active")
add("fleet_active_months_dormant", with_(SEA, QUIET, active("quiet")) + "SELECT month FROM active")
add("fleet_active_months_uniform", with_(
    SEA, "ones AS (SELECT date, 1 AS fished FROM sea)", active("ones")) + "SELECT month FROM active")
add("active_rows", with_(SEA, QUIET, active("quiet")) + f"""
SELECT {KEY}, fished FROM quiet WHERE month(date) IN (SELECT month FROM active)""")
add("seasonal_profile", with_(SEA) + f"""
SELECT CAST(month(date) AS INT) AS month, count(*) AS n, {r('avg(fished)')} AS label_rate, {r('avg(wave_height_max)')} AS mean_wave,
  {r('avg(chl)')} AS mean_chl, {r('corr(fished, chl)')} AS label_chl_corr FROM sea GROUP BY ALL""")
add("climatology", with_(
    SEA,
    "train AS (SELECT * FROM sea WHERE year(date) <= 1999)",
    "test AS (SELECT *, month(date) AS m FROM sea WHERE year(date) > 1999)",
    "cm AS (SELECT region, lat_idx, lon_idx, month(date) AS m, avg(fished) AS cm_rate FROM train GROUP BY ALL)",
    "ce AS (SELECT region, lat_idx, lon_idx, avg(fished) AS ce_rate FROM train GROUP BY ALL)",
    "mo AS (SELECT month(date) AS m, avg(fished) AS mo_rate FROM train GROUP BY ALL)",
) + f"""
SELECT {KEY}, fished, {r('coalesce(cm_rate, ce_rate, mo_rate, (SELECT avg(fished) FROM train))')} AS climatology
FROM test LEFT JOIN cm USING (region, lat_idx, lon_idx, m) LEFT JOIN ce USING (region, lat_idx, lon_idx) LEFT JOIN mo USING (m)""")

# --------------------------------------------------------- sampling and splits

add("temporal_split", with_(SEA) + f"""
SELECT {KEY}, CASE WHEN year(date) <= 1999 THEN 'train' ELSE 'test' END AS part FROM sea""")
add("calibration_split", with_(SEA) + f"""
SELECT {KEY}, fished, CASE WHEN year(date) = 1999 THEN 'calibration' ELSE 'core' END AS part FROM sea WHERE year(date) <= 1999""")
add("exclude_box", with_(SEA) + f"""
SELECT * FROM (SELECT {KEY}, {LAT} AS lat, {LON} AS lon FROM sea)
WHERE NOT (lat BETWEEN 1.45 AND 2.25 AND lon BETWEEN 44.5 AND 45.25)""")
add("holdout_band", with_(SEA) + f"""
SELECT {KEY}, {LAT} AS lat, {LON} AS lon, {LAT} BETWEEN -2.0 AND 1.5 AS held FROM sea""")
ITEMS = """items AS (SELECT CAST(l_shipdate AS DATE) AS date,
  CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 1 ELSE 0 END AS fished FROM lineitem)"""
add("subsample_negatives", with_(ITEMS) + """
SELECT chunk, pos, least(neg, greatest(pos, 1) * 3) AS neg
FROM (SELECT (date - DATE '1970-01-01') // 15 AS chunk, count(*) FILTER (fished = 1) AS pos,
  count(*) FILTER (fished = 0) AS neg FROM items GROUP BY ALL)""")
add("thin_training_years", with_(ITEMS) + """
SELECT CAST(year AS INT) AS year, pos, CASE WHEN year <= 1999 THEN least(neg, pos * 20) ELSE neg END AS neg
FROM (SELECT year(date) AS year, count(*) FILTER (fished = 1) AS pos, count(*) FILTER (fished = 0) AS neg FROM items GROUP BY ALL)""")
add("row_cap", with_(SEA) + """
SELECT pos, CASE WHEN pos + neg > 10000 THEN least(neg, greatest(10000 - pos, pos)) ELSE neg END AS neg
FROM (SELECT count(*) FILTER (fished = 1) AS pos, count(*) FILTER (fished = 0) AS neg FROM sea)""")

# ----------------------------------------------------------------- evaluation

SCORED_ITEMS = """rows_ AS (
  SELECT l_orderkey // 15000 AS region, CAST(month(l_shipdate) AS INT) AS month, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
    l_extendedprice * (1 - l_discount) AS s FROM lineitem)"""


def metrics(by: str = "", source: str = "rows_") -> str:
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""per_score AS (SELECT {lead}s, sum(y) AS tp, count(*) AS n FROM {source} WHERE s IS NOT NULL GROUP BY {lead}s),
running AS (SELECT *, sum(tp) OVER (w ROWS UNBOUNDED PRECEDING) AS ctp, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS cn
  FROM per_score WINDOW w AS ({part}ORDER BY s DESC)),
metrics AS (SELECT {lead}CAST(sum(n) AS BIGINT) AS n, CAST(sum(tp) AS BIGINT) AS positives,
  CAST(sum(tp) AS DOUBLE) / sum(n) AS base_rate,
  CASE WHEN sum(tp) > 0 AND sum(tp) < sum(n) THEN
    sum((n - tp) * (ctp - tp / 2)) / (CAST(sum(tp) AS DOUBLE) * (sum(n) - sum(tp))) END AS roc_auc,
  CASE WHEN sum(tp) > 0 AND sum(tp) < sum(n) THEN sum(tp * ctp / cn) / sum(tp) END AS average_precision
  FROM running {f'GROUP BY {by}' if by else ''})"""


def pooled(name: str) -> str:
    return f"""SELECT '{name}' AS model, n, {r('base_rate', 5)} AS base_rate, {r('roc_auc', 4)} AS roc_auc,
  {r('average_precision', 4)} AS pr_auc, {r('average_precision / base_rate', 2)} AS pr_lift FROM metrics"""


def within(name: str) -> str:
    return f"""SELECT '{name}' AS model, count(*) AS months, {r('avg(average_precision)', 4)} AS pr_auc_within_month,
  {r('avg(average_precision / base_rate)', 2)} AS lift_within_month FROM metrics WHERE average_precision IS NOT NULL"""


def plain(by: str) -> str:
    return f"""SELECT {by}, n, positives, {r('base_rate')} AS base_rate, {r('roc_auc')} AS roc_auc,
  {r('average_precision')} AS average_precision FROM metrics"""


add("eval_pooled", with_(SCORED_ITEMS, metrics()) + pooled("price"))
add("eval_by_region", with_(SCORED_ITEMS, metrics("region")) + plain("region"))
add("eval_within_month", with_(SCORED_ITEMS, metrics("month")) + within("price"))
add("eval_split_ranges", with_(SCORED_ITEMS, metrics("month")) + plain("month"))
add("eval_null_group", with_(
    SCORED_ITEMS, "holes AS (SELECT CASE WHEN month <> 7 THEN month END AS month, y, s FROM rows_ WHERE month <> 3)",
    metrics("month", "holes")) + plain("month"))
add("eval_documents", with_(
    "rows_ AS (SELECT lang, quality AS y, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id))",
    metrics("lang")) + within("length"))
add("eval_physics_index", with_(
    CELL_DAY, grad(), SCORED, "rows_ AS (SELECT fished AS y, score AS s FROM scored)", metrics(),
) + pooled("physics_index"))

# ------------------------------------------------------------ index and zones

add("pct_rank", with_(SEA) + f"SELECT {KEY}, {r(pct('chl'))} AS pct FROM sea")
add("pct_rank_ranged", ORACLES["pct_rank"])
add("pct_rank_whole", with_(SEA) + f"SELECT {KEY}, {r(pct('chl', '1'))} AS pct FROM sea")
add("physics_index", with_(CELL_DAY, grad(), SCORED) + f"SELECT {KEY}, score FROM scored")
add("physics_index_ranged", ORACLES["physics_index"])
TEXT = values("texts", "status, label_so, label_en, color, advice_so, advice_en", STATUS_TEXT)
HEADLINE = f"""head AS (
  SELECT *, CASE WHEN total = 0 THEN 'LAMA_OGA' WHEN n_danger / total >= 0.15 THEN 'KHATAR'
      WHEN n_danger / total + n_caution / total >= CAST(0.30 AS DOUBLE) THEN 'TAXADDAR'
      WHEN n_unknown / total > 0.5 THEN 'LAMA_OGA' ELSE 'AMMAAN' END AS status,
    {r('n_danger / total', 3)} AS share_dangerous
  FROM (SELECT region, date, count(*) FILTER (st = 'AMMAAN') AS n_safe, count(*) FILTER (st = 'TAXADDAR') AS n_caution,
      count(*) FILTER (st = 'KHATAR') AS n_danger, count(*) FILTER (st = 'LAMA_OGA') AS n_unknown, count(*) AS total
    FROM (SELECT *, {safety()} AS st FROM SOURCE_) GROUP BY region, date))"""
add("safety_summary", with_(SEA, HEADLINE.replace("SOURCE_", "sea"), TEXT) + "SELECT * FROM head JOIN texts USING (status)")
add("nearest_site", with_(SEA, coast(), zoned()) + f"SELECT region, lat_idx, lon_idx, site_id, {r('site_km')} AS site_km FROM plane")
ZONED_COLUMNS = f"""{r('dist_coast_km')} AS dist_coast_km, site_id, {r('site_km')} AS site_km, reachable, band, band_so,
  {ZONE_ID} AS zone_id"""
add("assign_zones", with_(SEA, coast(), zoned()) + f"""
SELECT {KEY}, {ZONED_COLUMNS} FROM sea JOIN plane USING (region, lat_idx, lon_idx)""")
add("assign_zones_per_day", with_(SEA, coast("region, date"), zoned("region, date")) + f"""
SELECT {KEY}, {ZONED_COLUMNS} FROM sea JOIN plane USING (region, date, lat_idx, lon_idx)""")
add("zone_summary", with_(ZONE_CHAIN) + "SELECT * FROM zones")
add("rank_zones", with_(ZONE_CHAIN) + f"""
SELECT region, date, CAST(rank AS INT) AS rank, zone_id, safety, score, {level('score')} AS level FROM ranks""")
add("top_zones", with_(ZONE_CHAIN) + "SELECT region, date, CAST(rank AS INT) AS rank, zone_id FROM ranks WHERE rank <= 3")

# -------------------------------------------------------------------- serving

add("latest_day", with_(SEA) + f"""
SELECT {KEY}, {r('sst')} AS sst FROM sea s WHERE date = (SELECT max(date) FROM sea x WHERE x.region = s.region)""")
add("given_day", with_(SEA) + f"SELECT {KEY}, {r('sst')} AS sst FROM sea WHERE date = DATE '1998-03-01'")
add("latest_or_fallback", with_(SEA) + f"""
SELECT {KEY}, 'demo' AS source, TRUE AS stale FROM sea WHERE date = (SELECT max(date) FROM sea)""")
add("latest_live", with_(SEA) + f"""
SELECT {KEY}, 'live' AS source, FALSE AS stale FROM sea WHERE date = (SELECT max(date) FROM sea)""")
add("lookup_points", with_(
    SEA,
    """points AS (SELECT l_orderkey // 15000 AS region, l_orderkey * 10 + l_linenumber AS point_id,
  min(l_partkey * 7 % 2600 + CAST(0.31 AS DOUBLE)) / 1000 + CAST(0.8 AS DOUBLE) AS plat,
  min(l_suppkey * 11 % 2600 + CAST(0.17 AS DOUBLE)) / 1000 + CAST(43.8 AS DOUBLE) AS plon FROM lineitem GROUP BY ALL)""",
    f"""newest AS (SELECT *, {safety()} AS safety, {LAT} AS lat, {LON} AS lon FROM sea s
  WHERE date = (SELECT max(date) FROM sea x WHERE x.region = s.region))""",
    f"""near AS (SELECT region, point_id, {r('abs(lat - plat) + abs(lon - plon)', 9)} AS d, lat_idx, lon_idx, safety, sst,
  row_number() OVER (PARTITION BY region, point_id ORDER BY {r('abs(lat - plat) + abs(lon - plon)', 9)}, lat_idx, lon_idx) AS rn
  FROM points JOIN newest USING (region) WHERE abs(lat - plat) + abs(lon - plon) <= CAST(0.2 AS DOUBLE) + 1e-12)""",
) + f"""SELECT region, point_id, {r('d')} AS distance_deg, lat_idx, lon_idx, safety, {r('sst')} AS sst FROM near WHERE rn = 1""")
add("catalog_status", with_(SEA) + """
SELECT region, string_agg(DISTINCT CAST(date AS VARCHAR), ',' ORDER BY CAST(date AS VARCHAR)) AS days,
  count(DISTINCT date) AS days_available, max(date) AS newest_day, FALSE AS model_validated, 'physics_index' AS ranking_source
FROM sea GROUP BY region""")
FILLED_CHAIN = ",\n".join([
    CELL_DAY, FILL, grad("filled"), SCORED, "sea AS (SELECT * FROM scored)", coast(), zoned(), ZONES, RANKED,
])
add("daily_payload_cells", with_(FILLED_CHAIN) + f"""
SELECT s.region, s.date, CAST(row_number() OVER (PARTITION BY s.region, s.date ORDER BY s.lat_idx, s.lon_idx) - 1 AS INT) AS place,
  s.lat_idx, s.lon_idx, {r(LAT.replace('lat_idx', 's.lat_idx'), 3)} AS lat, {r(LON.replace('lon_idx', 's.lon_idx'), 3)} AS lon,
  {safety('s.wave_height_max', 's.wind_speed_max')} AS safety, {r('sst', 1)} AS sst, {r('chl', 3)} AS chl,
  {r('s.wave_height_max', 2)} AS wave_height_max, {r('s.wind_speed_max', 1)} AS wind_speed_max, wave_estimated, score,
  reachable, {r('dist_coast_km', 1)} AS dist_coast_km
FROM sea s JOIN plane p USING (region, lat_idx, lon_idx)""")
add("daily_payload_headline", with_(FILLED_CHAIN, HEADLINE.replace("SOURCE_", "sea")) + f"""
SELECT h.region, h.date, h.total AS n_cells, h.status, h.share_dangerous, coalesce(z.n_zones, 0) AS n_zones,
  c.n_reachable, c.wave_estimated_share, 'physics_index' AS score_source, z.first_zone
FROM head h
JOIN (SELECT s.region, s.date, count(*) FILTER (reachable) AS n_reachable, {r('avg(wave_estimated)', 3)} AS wave_estimated_share
  FROM sea s JOIN plane p USING (region, lat_idx, lon_idx) GROUP BY ALL) c USING (region, date)
LEFT JOIN (SELECT region, date, count(*) AS n_zones, arg_min(zone_id, rank) AS first_zone FROM ranks GROUP BY ALL) z
  USING (region, date)""")
add("stream_daily_stats", f"""
SELECT user_id, CAST(ts AS DATE) AS date, {r('avg(value)')} AS value_mean, {r('max(value)')} AS value_max
FROM events GROUP BY ALL""")

# ------------------------------------------------------------- whole jobs

add("surface_readings", with_(READINGS) + f"""
SELECT CAST(time AS DATE) AS date, user_id, {r('u')} AS u, {r('v')} AS v, {r('value')} AS value FROM readings
WHERE v = (SELECT min(v) FROM readings)""")
add("effort_round_trip", f"""
SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, {r('(l_partkey % 22) * CAST(0.1 AS DOUBLE) + 1')} AS lat,
  {r('(l_suppkey % 20) * CAST(0.1 AS DOUBLE) + 44')} AS lon, {r('l_quantity / 10')} AS hours,
  CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, l_linestatus AS geartype,
  CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month FROM lineitem""")
add("features_round_trip", with_(SEA) + f"""
SELECT date, lat_idx, lon_idx, fished, {r('sst')} AS sst, {r('chl')} AS chl, {r('wave_height_max')} AS wave_height_max,
  {r('wind_speed_max')} AS wind_speed_max, 'r' || region AS region, CAST(year(date) AS INT) AS year FROM sea""")
add("feature_table", with_(CELL_DAY, FILL, grad("filled"), EFFORT_MONTHS, numbered("cell_day"), """trail AS (
  SELECT region, date, lat_idx, lon_idx, CASE WHEN count(chl) OVER w >= 3 THEN avg(chl) OVER w END AS chl_lag7
  FROM numbered WINDOW w AS (PARTITION BY region, lat_idx, lon_idx ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW))""") + f"""
SELECT {KEY}, printf('c_%04d_%04d', lat_idx, lon_idx) AS cell_id, {r('sst')} AS sst, {r('sst_gradient')} AS sst_gradient,
  {r('chl')} AS chl, {r('chl_lag7')} AS chl_lag7, {r('wave_height_max')} AS wave_height, {r('wave_height_max')} AS wave_height_max,
  {r('wind_speed_max / 2')} AS wind_speed, {r('wind_speed_max')} AS wind_speed_max, {r('coalesce(fishing_hours, 0)')} AS fishing_hours,
  coalesce(n_vessels, 0) AS n_vessels, CAST(0 AS INT) AS chl_age_days, wave_estimated, CAST(month(date) AS INT) AS month,
  CASE WHEN fishing_hours > 0.5 THEN 1 ELSE 0 END AS fished
FROM grad JOIN trail USING ({KEY}) LEFT JOIN ecells USING ({KEY}) WHERE sst IS NOT NULL""")
ORACLES["feature_table_by_day"] = ORACLES["feature_table"]
add("thin_whole", with_(ITEMS) + """
SELECT pos, least(neg, pos * 2) AS neg
FROM (SELECT count(*) FILTER (fished = 1) AS pos, count(*) FILTER (fished = 0) AS neg FROM items)""")


def renamed_metrics(name: str, score: str) -> str:
    cte = metrics("month", f"rows_{name}")
    for part in ("per_score", "running", "metrics"):
        cte = cte.replace(f"{part} AS", f"{part}_{name} AS").replace(f"FROM {part} ", f"FROM {part}_{name} ")
    return f"rows_{name} AS (SELECT CAST(month(date) AS INT) AS month, fished AS y, {score} AS s FROM both_),\n{cte}"


add("baseline_comparison", with_(
    CELL_DAY, grad(), SCORED,
    "train AS (SELECT * FROM scored WHERE year(date) <= 1999)",
    "test AS (SELECT *, month(date) AS m FROM scored WHERE year(date) > 1999)",
    "cm AS (SELECT region, lat_idx, lon_idx, month(date) AS m, avg(fished) AS cm_rate FROM train GROUP BY ALL)",
    "ce AS (SELECT region, lat_idx, lon_idx, avg(fished) AS ce_rate FROM train GROUP BY ALL)",
    "mo AS (SELECT month(date) AS m, avg(fished) AS mo_rate FROM train GROUP BY ALL)",
    """both_ AS (SELECT *, coalesce(cm_rate, ce_rate, mo_rate, (SELECT avg(fished) FROM train)) AS clim
  FROM test LEFT JOIN cm USING (region, lat_idx, lon_idx, m) LEFT JOIN ce USING (region, lat_idx, lon_idx) LEFT JOIN mo USING (m))""",
    renamed_metrics("clim", "clim"), renamed_metrics("phys", "score"),
    "lines AS (" + within("climatology").replace("FROM metrics ", "FROM metrics_clim ") + " UNION ALL "
    + within("physics_index").replace("FROM metrics ", "FROM metrics_phys ") + ")",
) + """SELECT *, (SELECT max(pr_auc_within_month) FILTER (model = 'climatology') > max(pr_auc_within_month) FILTER (model = 'physics_index')
  FROM lines) AS beats_baselines FROM lines""")
add("daily_payload_zones", with_(FILLED_CHAIN) + f"""
SELECT r.region, r.date, CAST(rank AS INT) AS rank, r.zone_id, name_so, name_en, n_cells, score, safety, distance_km,
  e.wave_estimated_share, {level('score')} AS level
FROM ranks r JOIN (SELECT s.region, s.date, {ZONE_ID} AS zone_id, {r('avg(wave_estimated)', 2)} AS wave_estimated_share
  FROM sea s JOIN plane p USING (region, lat_idx, lon_idx) WHERE reachable AND band IS NOT NULL GROUP BY ALL) e
  USING (region, date, zone_id)""")
add("daily_files", with_(SEA) + """
SELECT 'r' || region AS region, date, count(*) AS n_cells, count(*) AS n_listed FROM sea s
WHERE date = (SELECT max(date) FROM sea x WHERE x.region = s.region) GROUP BY ALL""")

# -------------------------------------------- documents, models, whole jobs

add("daily_payload", with_(FILLED_CHAIN, HEADLINE.replace("SOURCE_", "sea"), TEXT) + f"""
SELECT h.region, h.date, h.total AS n_cells, h.total AS n_listed, h.status, n_safe, n_caution, n_danger, n_unknown,
  h.share_dangerous, h.total, label_so, label_en, color, advice_so, advice_en, n_danger AS listed_danger,
  n_unknown AS listed_unknown, c.* EXCLUDE (region, date), CAST(20 AS INT) AS n_lat, CAST(20 AS INT) AS n_lon,
  CAST(0.1 AS DOUBLE) AS resolution, CAST(1.25 AS DOUBLE) AS wave_safe_m, CAST(2 AS DOUBLE) AS wave_danger_m,
  CAST(20 AS DOUBLE) AS wind_safe_kmh, CAST(30 AS DOUBLE) AS wind_danger_kmh, h.total AS n_cells_total, FALSE AS trained,
  'physics_index' AS score_source, coalesce(z.n_zones, 0) AS n_zones, CAST(coalesce(z.inside, 0) AS BIGINT) AS cells_in_zones
FROM head h JOIN texts USING (status)
JOIN (SELECT s.region, s.date, count(*) FILTER (reachable) AS n_reachable_cells,
    CAST(sum(CAST(round_even(sst * 10, 0) AS BIGINT)) AS BIGINT) AS sst_total,
    CAST(coalesce(sum(CAST(round_even(chl * 1000, 0) AS BIGINT)), 0) AS BIGINT) AS chl_total,
    CAST(coalesce(sum(CAST(round_even(s.wave_height_max * 100, 0) AS BIGINT)), 0) AS BIGINT) AS wave_height_max_total,
    CAST(coalesce(sum(CAST(round_even(score * 10, 0) AS BIGINT)), 0) AS BIGINT) AS score_total
  FROM sea s JOIN plane p USING (region, lat_idx, lon_idx) GROUP BY ALL) c USING (region, date)
LEFT JOIN (SELECT region, date, count(*) AS n_zones, sum(n_cells) AS inside FROM ranks GROUP BY ALL) z USING (region, date)""")

FEATURE_NAMES = (
    "sst", "sst_gradient", "chl", "chl_lag7", "chl_lag14", "chl_age_days", "current_speed", "depth", "seabed_roughness",
    "dist_coast_km", "month_sin", "month_cos", "lat", "lon",
)


def lags(source: str) -> str:
    def window(name: str, days: int) -> str:
        return (f"{name} AS (PARTITION BY region, lat_idx, lon_idx ORDER BY day "
                f"RANGE BETWEEN {days - 1} PRECEDING AND CURRENT ROW)")

    return f"""lagged AS (SELECT *, CASE WHEN count(chl) OVER w7 >= 3 THEN avg(chl) OVER w7 END AS chl_lag7,
    CASE WHEN count(chl) OVER w14 >= 5 THEN avg(chl) OVER w14 END AS chl_lag14
  FROM {source} WINDOW {window('w7', 7)}, {window('w14', 14)})"""


def ages(source: str) -> str:
    return f"""ages AS (SELECT region, date,
    CAST(date_diff('day', last_value(seen IGNORE NULLS) OVER (PARTITION BY region ORDER BY date), date) AS INT) AS chl_age_days
  FROM (SELECT region, date, CASE WHEN count(chl) > 0 THEN date END AS seen FROM {source} GROUP BY region, date))"""


MODEL_ROWS = ",\n".join([
    CELL_DAY, "sea AS (SELECT * FROM cell_day WHERE sst IS NOT NULL)", grad(), SCORED, SOUNDINGS, coast(),
    numbered("grad"), lags("numbered"), ages("cell_day"), f"""model_rows AS (
  SELECT l.region, l.date, l.lat_idx, l.lon_idx, l.fished, l.sst, l.sst_gradient, l.chl, chl_lag7, chl_lag14, chl_age_days,
    sqrt(pow(l.wind_speed_max / 20, 2) + pow(l.wave_height_max / 4, 2)) AS current_speed, depth, seabed_roughness,
    dist_coast_km, 1 AS month_sin, 1 AS month_cos, {LAT} AS lat, {LON} AS lon, score
  FROM lagged l JOIN ages USING (region, date) JOIN (SELECT {KEY}, score FROM scored) USING ({KEY})
  LEFT JOIN seabed USING (region, lat_idx, lon_idx) LEFT JOIN coast USING (region, lat_idx, lon_idx))""",
])
TEST_ROWS = "tested AS (SELECT * FROM model_rows WHERE year(date) > 1999)"
add("hotspot_gbt", with_(SEA) + f"SELECT {KEY}, fished, TRUE AS in_range FROM sea WHERE year(date) > 1999")
add("depth_only_baseline", with_(SEA) + """
SELECT region, lat_idx, lon_idx, count(*) AS n, CAST(sum(fished) AS BIGINT) AS positives, TRUE AS one_score, TRUE AS in_range
FROM sea WHERE year(date) > 1999 GROUP BY ALL""")
add("isotonic_calibration", with_(SEA) + """
SELECT CAST(month(date) AS INT) AS month, count(*) AS n, CAST(sum(fished) AS BIGINT) AS positives, TRUE AS monotone
FROM sea WHERE year(date) > 1999 GROUP BY ALL""")
add("feature_importance", with_(MODEL_ROWS) + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count({f}) AS known, TRUE AS in_range, TRUE AS adds_up FROM model_rows WHERE year(date) <= 1999"
    for f in FEATURE_NAMES))
WHOLE = " AND ".join(f"count({f}) OVER (PARTITION BY region, date) > 0" for f in FEATURE_NAMES)
add("gated_score", with_(MODEL_ROWS, TEST_ROWS, f"marked AS (SELECT *, {WHOLE} AS whole FROM tested)") + f"""
SELECT {KEY}, TRUE AS allowed, CASE WHEN whole THEN 'model' ELSE 'physics_index' END AS score_source,
  CASE WHEN NOT whole THEN score END AS score, TRUE AS in_range FROM marked
UNION ALL SELECT {KEY}, FALSE, 'physics_index', score, TRUE FROM marked""")
add("gated_score_absent_source", with_(MODEL_ROWS, TEST_ROWS) + f"""
SELECT {KEY}, score, 'physics_index' AS score_source FROM tested""")


def baselines(train: str, test: str, models: dict[str, str | None], pooled_too: bool = True) -> tuple[str, str]:
    """CTEs and one line of metrics per model: climatology fitted on `train` and
    any score of `test`. Models without one are known by their rows alone."""
    parts = [
        f"cm AS (SELECT region, lat_idx, lon_idx, month(date) AS m, avg(fished) AS cm_rate FROM {train} GROUP BY ALL)",
        f"ce AS (SELECT region, lat_idx, lon_idx, avg(fished) AS ce_rate FROM {train} GROUP BY ALL)",
        f"mo AS (SELECT month(date) AS m, avg(fished) AS mo_rate FROM {train} GROUP BY ALL)",
        f"""both_ AS (SELECT *, coalesce(cm_rate, ce_rate, mo_rate, (SELECT avg(fished) FROM {train})) AS clim
  FROM (SELECT *, month(date) AS m FROM {test}) LEFT JOIN cm USING (region, lat_idx, lon_idx, m)
  LEFT JOIN ce USING (region, lat_idx, lon_idx) LEFT JOIN mo USING (m))""",
    ]
    lines = []
    for model, score in models.items():
        source = f"rows_{model}"
        parts.append(f"{source} AS (SELECT CAST(month(date) AS INT) AS month, fished AS y, CAST({score or 1} AS DOUBLE) AS s FROM both_)")
        for kind, by in (("pool", ""), ("each", "month")):
            cte = metrics(by, source)
            for part in ("per_score", "running", "metrics"):
                new = f"{part}_{kind}_{model}"
                cte = cte.replace(f"{part} AS", f"{new} AS").replace(f"FROM {part} ", f"FROM {new} ")
            parts.append(cte)
        p = pooled(model).replace("FROM metrics", f"FROM metrics_pool_{model}")
        w = within(model).replace("FROM metrics ", f"FROM metrics_each_{model} ")

        def shown(*names: str) -> str:
            return ", ".join(n if score else f"CAST(NULL AS DOUBLE) AS {n}" for n in names)

        more = f", n, base_rate, {shown('roc_auc', 'pr_auc', 'pr_lift')}" if pooled_too else ""
        lines.append(
            f"SELECT model, months, {shown('pr_auc_within_month', 'lift_within_month')}, TRUE AS in_range{more} "
            f"FROM ({w}) JOIN ({p}) USING (model)"
        )
    return ",\n".join(parts), " UNION ALL ".join(lines)


BASIC = {"hotspot": None, "depth_only": None, "climatology": "clim", "physics_index": "score"}
TRAIN_ROWS = "trained AS (SELECT * FROM model_rows WHERE year(date) <= 1999)"
_parts, _lines = baselines("trained", "tested", BASIC, pooled_too=False)
add("validation_gate", with_(MODEL_ROWS, TRAIN_ROWS, TEST_ROWS, _parts) + f"SELECT *, TRUE AS gate_agrees FROM ({_lines})")
_parts, _lines = baselines("kept_train", "kept_test", BASIC)
add("validate_models", with_(
    MODEL_ROWS,
    "quiet AS (SELECT * REPLACE (CASE WHEN month(date) IN (2, 11) THEN 0 ELSE fished END AS fished) FROM model_rows)",
    "early AS (SELECT * FROM quiet WHERE year(date) <= 1999)", active("early"),
    "kept_train AS (SELECT * FROM early WHERE month(date) IN (SELECT month FROM active))",
    "kept_test AS (SELECT * FROM quiet WHERE year(date) > 1999 AND month(date) IN (SELECT month FROM active))", _parts,
) + f"SELECT *, TRUE AS gate_agrees FROM ({_lines})")
_parts, _lines = baselines("trained", "held", {"transfer": None, "physics_index": "score"})
add("spatial_transfer", with_(
    MODEL_ROWS, TRAIN_ROWS, "held AS (SELECT * FROM model_rows WHERE year(date) > 1999 AND lat BETWEEN -2.0 AND 1.5)", _parts,
) + _lines)
IN_BOX = "lat BETWEEN 1.4 AND 2.4 AND lon BETWEEN 44.6 AND 45.4"
_parts, _lines = baselines("own", "held", {"transfer": None, "control": None, "climatology": "clim", "physics_index": "box_score"})
add("box_transfer", with_(
    MODEL_ROWS,
    SCORED.replace("ranked AS", "box_ranked AS").replace("FROM ranked", "FROM box_ranked").replace("scored AS", "box_scored AS")
    .replace("FROM grad WHERE sst IS NOT NULL", f"FROM model_rows WHERE year(date) > 1999 AND {IN_BOX}")
    .replace("SELECT *,", "SELECT * EXCLUDE (score),", 1),
    f"own AS (SELECT * FROM model_rows WHERE year(date) <= 1999 AND {IN_BOX} AND month(date) NOT IN (7, 8))",
    "held AS (SELECT *, score AS box_score FROM box_scored WHERE month(date) NOT IN (7, 8))", _parts,
) + f"""SELECT *, CASE WHEN model IN ('climatology', 'physics_index') THEN
  pr_auc_within_month > max(pr_auc_within_month) FILTER (model = 'climatology') OVER () END AS beats_climatology FROM ({_lines})""")

NODES = """nodes AS (
  SELECT l_orderkey // 15000 AS region, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
    CAST(l_partkey % 10 AS INT) AS ci, CAST(l_suppkey % 10 AS INT) AS cj,
    avg(CASE WHEN l_partkey % 10 <= l_suppkey % 10 + 3 THEN CAST(l_quantity AS DOUBLE) * CAST(0.2718281828 AS DOUBLE) + 290 END) AS kelvin,
    avg(CASE WHEN (l_partkey % 10 * 7 + l_suppkey % 10 * 3 + month(l_shipdate)) % 11 <> 0
      THEN CAST(CAST(round_even(l_extendedprice, 0) AS BIGINT) % 640 AS DOUBLE) * CAST(0.0157079633 AS DOUBLE) END) AS chl,
    avg((CAST(l_linenumber AS DOUBLE) - 4) * CAST(0.1259921050 AS DOUBLE)) AS uo,
    avg((CAST(l_quantity AS DOUBLE) - 25) * CAST(0.0316227766 AS DOUBLE)) AS vo,
    avg(CASE WHEN (l_partkey % 10 + l_suppkey % 10) % 6 <> 0 THEN round(l_discount * 100) * CAST(0.2414213562 AS DOUBLE) END) AS wave,
    max(CASE WHEN (l_partkey % 10 + l_suppkey % 10) % 6 <> 0 THEN round(l_discount * 100) * CAST(0.2414213562 AS DOUBLE) END) AS wave_top,
    avg((round(l_tax * 100) - 4) * CAST(2.4494897428 AS DOUBLE)) AS east, avg(CAST(l_linenumber AS DOUBLE) * CAST(1.4422495703 AS DOUBLE) - 6) AS north,
    max(sqrt(pow((round(l_tax * 100) - 4) * CAST(2.4494897428 AS DOUBLE), 2) + pow(CAST(l_linenumber AS DOUBLE) * CAST(1.4422495703 AS DOUBLE) - 6, 2))) AS top
  FROM lineitem GROUP BY ALL)"""
NODE_VALUES = ("kelvin", "chl", "uo", "vo", "wave", "wave_top", "east", "north", "top")
SPREAD = ", ".join(
    f"a.{x} * (1 - fi) * (1 - fj) + b.{x} * (1 - fi) * fj + c.{x} * fi * (1 - fj) + d.{x} * fi * fj AS {x}" for x in NODE_VALUES
)


def node(a: str, i: str, j: str) -> str:
    return f"LEFT JOIN nodes {a} ON {a}.region = t.region AND {a}.date = t.date AND {a}.ci = {i} AND {a}.cj = {j}"


WHOLE_PLANES = f"""axis AS (
  SELECT CAST(range AS INT) AS t, CAST((range * 0.1 + 0.05) / 0.2 AS DOUBLE) AS x FROM range(20)),
line AS (SELECT t, CAST(floor(x) AS INT) AS lo, x - floor(x) AS f FROM axis),
targets AS (SELECT k.*, a.t AS lat_idx, a.lo AS il, a.f AS fi, z.t AS lon_idx, z.lo AS jl, z.f AS fj
  FROM (SELECT DISTINCT region, date FROM nodes) k, line a, line z),
gridded AS (SELECT t.region, t.date, t.lat_idx, t.lon_idx, {SPREAD}
  FROM targets t {node('a', 'il', 'jl')} {node('b', 'il', 'jl + 1')} {node('c', 'il + 1', 'jl')} {node('d', 'il + 1', 'jl + 1')}),
whole AS (SELECT * EXCLUDE (kelvin), kelvin - CAST(273.15 AS DOUBLE) AS sst FROM gridded)"""
WAVES = f"""near AS (
  SELECT m.region, m.date, m.lat_idx, m.lon_idx, x.wave, x.wave_top, row_number() OVER (
      PARTITION BY m.region, m.date, m.lat_idx, m.lon_idx
      ORDER BY sqrt(pow((x.lat_idx - m.lat_idx) * {DY}, 2) + pow((x.lon_idx - m.lon_idx) * {DX}, 2)),
        x.lat_idx - m.lat_idx, x.lon_idx - m.lon_idx) AS rn
  FROM whole m JOIN whole x ON m.region = x.region AND m.date = x.date
  WHERE m.wave IS NULL AND x.wave IS NOT NULL
    AND sqrt(pow((x.lat_idx - m.lat_idx) * {DY}, 2) + pow((x.lon_idx - m.lon_idx) * {DX}, 2)) <= 30)"""
add("features_from_readings", with_(
    NODES, WHOLE_PLANES, WAVES, grad("whole"), numbered("whole"), lags("numbered"), ages("whole"), EFFORT_MONTHS, SOUNDINGS,
) + f"""
SELECT {KEY}, printf('c_%04d_%04d', lat_idx, lon_idx) AS cell_id, {r(LAT)} AS lat, {r(LON)} AS lon, {r('g.sst')} AS sst,
  CAST(NULL AS DOUBLE) AS sst_model, {r('sst_gradient')} AS sst_gradient,
  CASE WHEN chl_age_days <= 21 THEN {r('g.chl')} END AS chl, CASE WHEN chl_age_days <= 21 THEN {r('chl_lag7')} END AS chl_lag7,
  CASE WHEN chl_age_days <= 21 THEN {r('chl_lag14')} END AS chl_lag14, chl_age_days,
  {r('sqrt(g.uo * g.uo + g.vo * g.vo)')} AS current_speed, {r('coalesce(g.wave, n.wave)')} AS wave_height,
  {r('coalesce(g.wave_top, n.wave_top)')} AS wave_height_max,
  CASE WHEN g.wave IS NULL AND n.wave IS NOT NULL THEN 1 ELSE 0 END AS wave_estimated,
  {r('sqrt(g.east * g.east + g.north * g.north) * CAST(3.6 AS DOUBLE)')} AS wind_speed,
  {r('g.top * CAST(3.6 AS DOUBLE)')} AS wind_speed_max, CAST(month(date) AS INT) AS month,
  {r('sin((month(date) - 1) * 2 * pi() / 12)')} AS month_sin, {r('cos((month(date) - 1) * 2 * pi() / 12)')} AS month_cos,
  {r('coalesce(fishing_hours, 0)')} AS fishing_hours, coalesce(n_vessels, 0) AS n_vessels,
  CASE WHEN fishing_hours > 0.5 THEN 1 ELSE 0 END AS fished, {r('depth')} AS depth,
  {r('seabed_roughness')} AS seabed_roughness, {r('land_fraction')} AS land_fraction
FROM grad g JOIN (SELECT {KEY}, chl_lag7, chl_lag14 FROM lagged) USING ({KEY}) JOIN ages USING (region, date)
LEFT JOIN (SELECT * FROM near WHERE rn = 1) n USING ({KEY}) LEFT JOIN ecells USING ({KEY})
LEFT JOIN seabed USING (region, lat_idx, lon_idx) WHERE g.sst IS NOT NULL""")

# ------------------------------------------------------- streams with late readings

DEALT = """dealt AS (SELECT CAST(ts AS DATE) AS date, user_id, value, value - 250 AS u, (user_id + day(ts)) % 5 AS part FROM events)"""
add("stream_late_readings", with_(DEALT) + f"""
SELECT date, user_id, {r('avg(value)')} AS value_mean, {r('max(value)')} AS value_max, {r('avg(u)')} AS u_mean, {r('max(u)')} AS u_max
FROM dealt GROUP BY ALL""")
add("stream_lateness", with_(
    DEALT, "newest AS (SELECT max(date) FILTER (part < 3) AS one, max(date) FILTER (part < 4) AS two FROM dealt)",
) + """SELECT date, count(*) AS n_readings,
  count(*) FILTER ((part = 3 AND date < one - 2) OR (part = 4 AND date < two - 2)) AS n_late FROM dealt, newest GROUP BY date""")
add("stream_safety", with_(
    DEALT, """days AS (SELECT date, user_id, CASE WHEN day(date) % 7 <> 0 THEN max(value) / 250 END AS wave, max(u) / 8 AS wind
  FROM dealt GROUP BY date, user_id)""",
) + f"SELECT date, user_id, {safety('wave', 'wind')} AS safety FROM days")

# ---------------------------------------------- trees of one split, and isotonic fits


def stumps(rounds: int = 4, step: float = 0.5) -> str:
    """CTEs kept_trees and kept_scores: boosting by hand. f is a row's margin so far."""
    parts = [SEA, """stump_rows AS (SELECT month(date) AS m, CAST(floor(sst) AS BIGINT) AS b, fished AS y, count(*) AS n,
    CASE WHEN year(date) < 1999 THEN 'core' WHEN year(date) = 1999 THEN 'held' ELSE 'test' END AS role FROM sea GROUP BY ALL)""",
        """class AS (SELECT greatest(1.0, CAST(sum(n) FILTER (y = 0) AS DOUBLE) / sum(n) FILTER (y = 1)) AS w FROM stump_rows WHERE role = 'core')""",
        """f0 AS (SELECT s.*, CAST(0 AS DOUBLE) AS f, n * CASE WHEN y = 1 THEN w ELSE 1 END AS w, 2 * y - 1 AS t FROM stump_rows s, class)"""]
    for k in range(1, rounds + 1):
        target = "CAST(t AS DOUBLE)" if k == 1 else "4 * t / (1 + exp(2 * t * f))"
        parts += [f"""r{k} AS (SELECT *, {target} AS r FROM f{k - 1})""",
            f"""s{k} AS (SELECT feature, x, sum(n) AS n, sum(w) AS w, sum(w * r) AS s FROM (
    SELECT 0 AS feature, m AS x, n, w, r FROM r{k} WHERE role = 'core' UNION ALL SELECT 1, b, n, w, r FROM r{k} WHERE role = 'core')
  GROUP BY ALL)""",
            f"""c{k} AS (SELECT feature, x, lead(x) OVER p AS next, sum(n) OVER p AS n, sum(w) OVER p AS w, sum(s) OVER p AS s,
    sum(n) OVER q AS all_n, sum(w) OVER q AS all_w, sum(s) OVER q AS all_s
  FROM s{k} WINDOW p AS (PARTITION BY feature ORDER BY x), q AS (PARTITION BY feature))""",
            f"""t{k} AS (SELECT {k} AS round, feature, CAST(x + next AS DOUBLE) / 2 AS threshold, s / w AS left_value,
    (all_s - s) / (all_w - w) AS right_value, s * s / w + (all_s - s) * (all_s - s) / (all_w - w) - all_s * all_s / all_w AS gain
  FROM c{k} WHERE next IS NOT NULL AND n >= 20 AND all_n - n >= 20 ORDER BY gain DESC, feature, x LIMIT 1)""",
            f"""f{k} AS (SELECT r.* EXCLUDE (r, f), f + {1.0 if k == 1 else step} *
    CASE WHEN CASE feature WHEN 0 THEN m ELSE b END <= threshold THEN left_value ELSE right_value END AS f FROM r{k} r, t{k})""",
            f"""a{k} AS (SELECT {k} AS round, sum(pos * cpos / cn) / sum(pos) AS ap FROM (
    SELECT pos, sum(pos) OVER p AS cpos, sum(n) OVER p AS cn FROM (
      SELECT f, CAST(sum(n * y) AS DOUBLE) AS pos, sum(n) AS n FROM f{k} WHERE role = 'held' GROUP BY f) WINDOW p AS (ORDER BY f DESC)))"""]
    every = range(1, rounds + 1)
    parts += [
        "ranked_rounds AS (" + " UNION ALL ".join(f"SELECT * FROM a{k}" for k in every) + ")",
        "kept AS (SELECT min(round) AS kept FROM ranked_rounds WHERE ap >= (SELECT max(ap) FROM ranked_rounds) - 1e-12)",
        "kept_trees AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM t{k}" for k in every) + "), kept WHERE round <= kept)",
        "kept_scores AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT {k} AS round, m, b, y, n, role, f FROM f{k}" for k in every)
        + "), kept WHERE round = kept)",
    ]
    return ",\n".join(parts)


def isotonic(source: str) -> str:
    """CTE fitted (x, fitted): greatest over all beginnings of the least over all ends of the mean between."""
    return f"""points AS (SELECT row_number() OVER (ORDER BY x) AS i, x, sum(s) OVER (ORDER BY x) AS s, sum(w) OVER (ORDER BY x) AS w FROM {source}),
spans AS (SELECT a.i AS a, b.i AS b, (b.s - coalesce(z.s, 0)) / (b.w - coalesce(z.w, 0)) AS mean
  FROM points a JOIN points b ON b.i >= a.i LEFT JOIN points z ON z.i = a.i - 1),
least_ends AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS least FROM spans),
fitted AS (SELECT x, max(least) AS fitted FROM least_ends JOIN points USING (i) GROUP BY x)"""


add("boosted_stumps", with_(stumps()) + f"""
SELECT CAST(round AS INTEGER) AS round, CASE round WHEN 1 THEN 1.0 ELSE 0.5 END AS tree_weight,
  CASE feature WHEN 0 THEN 'month_no' ELSE 'warmth' END AS feature, threshold, {r('gain')} AS gain,
  {r('left_value')} AS left_value, {r('right_value')} AS right_value FROM kept_trees""")
add("stump_importance", with_(
    stumps(), "gains AS (SELECT feature, avg(gain) AS gain FROM kept_trees GROUP BY feature)",
) + f"""SELECT name AS feature, {r('coalesce(gain, 0) / (SELECT sum(gain) FROM gains)', 4)} AS gain_share
FROM (VALUES (0, 'month_no'), (1, 'warmth')) names(feature, name) LEFT JOIN gains USING (feature)""")
add("calibrated_stumps", with_(
    stumps(), "held_points AS (SELECT f AS x, CAST(sum(n * y) AS DOUBLE) AS s, CAST(sum(n) AS DOUBLE) AS w FROM kept_scores WHERE role = 'held' GROUP BY f)",
    isotonic("held_points"),
) + f"""SELECT CAST(m AS DOUBLE) AS month_no, CAST(b AS DOUBLE) AS warmth, {r('fitted')} AS probability, CAST(sum(n) AS BIGINT) AS n
FROM kept_scores LEFT JOIN fitted ON f = x WHERE role = 'test' GROUP BY m, b, fitted""")
add("isotonic_fit", with_(
    CELL_DAY, grad(), SCORED,
    "score_points AS (SELECT score AS x, CAST(sum(fished) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS w FROM scored WHERE score IS NOT NULL GROUP BY score)",
    isotonic("score_points"),
) + f"SELECT x AS score, CAST(w AS BIGINT) AS n, CAST(s AS BIGINT) AS positives, {r('fitted')} AS fitted FROM score_points JOIN fitted USING (x)")

# ------------------------------------------- thinning in the build, notes, answers, pixels

add("thinned_build", with_(SEA, EFFORT_MONTHS, f"""chunks AS (SELECT region, date,
    (row_number() OVER (PARTITION BY region, year(date) ORDER BY date) - 1) // 5 AS chunk FROM (SELECT DISTINCT region, date FROM cell_day))""",
    f"""labelled AS (SELECT region, year(date) AS year, chunk, coalesce(n_vessels, 0) AS n_vessels, CASE WHEN fishing_hours > 0.5 THEN 1 ELSE 0 END AS fished
  FROM sea JOIN chunks USING (region, date) LEFT JOIN ecells USING ({KEY}))""",
) + """SELECT region, year, chunk, count(*) FILTER (fished = 1) AS positives,
  least(count(*) FILTER (fished = 0), greatest(count(*) FILTER (fished = 1), 1)) AS negatives, 0 AS on_land,
  CAST(sum(n_vessels * fished) AS BIGINT) AS vessels FROM labelled GROUP BY ALL""")
add("bathymetry_inventory", with_(FOUND) + f"""
SELECT 'gebco' AS source, count(*) > 0 AS present, count(*) AS files, {r('coalesce(sum(bytes), 0) / CAST(1e6 AS DOUBLE)')} AS megabytes
FROM (SELECT mode, source, CAST(sum(bytes) AS BIGINT) AS bytes FROM found WHERE year = 1995 GROUP BY ALL)
UNION ALL SELECT 'etopo', FALSE, 0, 0""")
add("bathymetry_by_spacing", with_(
    """lines AS (SELECT 2 * (l_orderkey // 15000) + l_linenumber % 2 AS region, l_partkey AS p, CAST(round_even(l_extendedprice, 0) AS BIGINT) AS s,
    CAST(round_even(l_extendedprice / 25, 0) AS BIGINT) AS e FROM lineitem)""",
    """fine AS (SELECT region, p % 80 AS i, s % 80 AS j, min(e) - 1800 AS e FROM lines WHERE region % 2 = 0 GROUP BY ALL)""",
    """coarse_pixels AS (SELECT region, p % 30 AS i, s % 30 AS j, min(e) - 1800 AS e FROM lines WHERE region % 2 = 1 GROUP BY ALL)""",
    """axis AS (SELECT CAST(range AS INT) AS t, CAST(floor(x) AS INT) AS lo, x - floor(x) AS f
  FROM (SELECT range, CASE WHEN abs(x - round(x)) < 1e-9 THEN round(x) ELSE x END AS x
    FROM (SELECT range, (range * 0.1 + 0.05) / CAST(0.07 AS DOUBLE) AS x FROM range(20))))""",
    """mixed AS (SELECT k.region, y.t AS lat_idx, x.t AS lon_idx,
    a.e * (1 - y.f) * (1 - x.f) + coalesce(b.e, CASE WHEN x.f = 0 THEN 0 END) * (1 - y.f) * x.f
      + coalesce(c.e, CASE WHEN y.f = 0 THEN 0 END) * y.f * (1 - x.f) + coalesce(d.e, CASE WHEN x.f = 0 OR y.f = 0 THEN 0 END) * y.f * x.f AS e
  FROM (SELECT DISTINCT region FROM coarse_pixels) k, axis y, axis x
  LEFT JOIN coarse_pixels a ON a.region = k.region AND a.i = y.lo AND a.j = x.lo LEFT JOIN coarse_pixels b ON b.region = k.region AND b.i = y.lo AND b.j = x.lo + 1
  LEFT JOIN coarse_pixels c ON c.region = k.region AND c.i = y.lo + 1 AND c.j = x.lo LEFT JOIN coarse_pixels d ON d.region = k.region AND d.i = y.lo + 1 AND d.j = x.lo + 1)""",
) + f"""SELECT region, CAST(i // 4 AS INT) AS lat_idx, CAST(j // 4 AS INT) AS lon_idx, CASE WHEN avg(e) < 0 THEN {r('-avg(e)')} END AS depth,
  {r('stddev_pop(e)')} AS seabed_roughness, {r('avg(CASE WHEN e >= 0 THEN 1 ELSE 0 END)')} AS land_fraction FROM fine GROUP BY ALL
UNION ALL SELECT region, lat_idx, lon_idx, CASE WHEN e < 0 THEN {r('-e')} END, NULL, CASE WHEN e >= 0 THEN 1.0 ELSE 0.0 END FROM mixed""")
add("point_answers", with_(
    CELL_DAY, grad(), SCORED, TEXT,
    """points AS (SELECT l_orderkey // 15000 AS region, l_orderkey * 10 + l_linenumber AS point_id,
  min(l_partkey * 7 % 2600 + CAST(0.31 AS DOUBLE)) / 1000 + CAST(0.8 AS DOUBLE) AS plat,
  min(l_suppkey * 11 % 2600 + CAST(0.17 AS DOUBLE)) / 1000 + CAST(43.8 AS DOUBLE) AS plon FROM lineitem GROUP BY ALL)""",
    f"""newest AS (SELECT *, {safety()} AS status, {LAT} AS lat, {LON} AS lon FROM scored s
  WHERE date = (SELECT max(date) FROM scored x WHERE x.region = s.region))""",
    f"""near AS (SELECT region, point_id, newest.*, row_number() OVER (PARTITION BY region, point_id
      ORDER BY {r('abs(lat - plat) + abs(lon - plon)', 9)}, lat_idx, lon_idx) AS rn
  FROM points JOIN newest USING (region) WHERE abs(lat - plat) + abs(lon - plon) <= CAST(0.2 AS DOUBLE) + 1e-12)""",
) + f"""SELECT region, point_id, date, {r('lat', 3)} AS lat, {r('lon', 3)} AS lon, status, label_so, label_en, color, advice_so, advice_en,
  {r('sst', 1)} AS sst, {r('chl', 3)} AS chl, {r('sst_gradient', 2)} AS sst_gradient, {r('wave_height_max', 2)} AS wave_height_max,
  {r('wind_speed_max', 1)} AS wind_speed_max, score AS fishing_potential, FALSE AS trained, 'physics_index' AS score_source
FROM near JOIN texts USING (status) WHERE rn = 1""")
_parts, _lines = baselines("stump_train", "stump_test", {"hotspot": "hot", "climatology": "clim"}, pooled_too=False)
add("stored_notes", with_(
    stumps(), "held_points AS (SELECT f AS x, CAST(sum(n * y) AS DOUBLE) AS s, CAST(sum(n) AS DOUBLE) AS w FROM kept_scores WHERE role = 'held' GROUP BY f)",
    isotonic("held_points"), "scores_of AS (SELECT DISTINCT m AS month_no, b, fitted AS hot FROM kept_scores JOIN fitted ON f = x WHERE role = 'test')",
    "stump_train AS (SELECT * FROM sea WHERE year(date) <= 1999)",
    """stump_test AS (SELECT sea.*, hot FROM sea LEFT JOIN scores_of ON month_no = month(date) AND b = CAST(floor(sst) AS BIGINT)
  WHERE year(date) > 1999)""", _parts, f"metric_lines AS ({_lines})",
    """beats AS (SELECT max(pr_auc_within_month) FILTER (model = 'hotspot') > max(pr_auc_within_month) FILTER (model = 'climatology') AS beats
  FROM metric_lines)""",
) + """SELECT model, months, pr_auc_within_month, lift_within_month, beats AS beats_climatology, 'month_no,warmth' AS features,
  beats AS validated, TRUE AS scores_alike FROM metric_lines, beats""")

CHANGED = CELL_DAY.replace("cell_day AS", "unchanged AS") + """,
cell_day AS (SELECT * REPLACE (CASE WHEN date = DATE '1996-03-01' THEN sst + 1 ELSE sst END AS sst, CASE WHEN date = DATE '1997-02-01' THEN chl * 2 ELSE chl END AS chl) FROM unchanged)"""
add("incremental_build", with_(CHANGED, FILL, grad("filled"), EFFORT_MONTHS, numbered("cell_day"), """trail AS (
  SELECT region, date, lat_idx, lon_idx, CASE WHEN count(chl) OVER w >= 3 THEN avg(chl) OVER w END AS chl_lag7
  FROM numbered WINDOW w AS (PARTITION BY region, lat_idx, lon_idx ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW))""") + f"""
SELECT 'r' || region AS region, date, lat_idx, lon_idx, {r('sst')} AS sst, {r('sst_gradient')} AS sst_gradient, {r('chl')} AS chl,
  {r('chl_lag7')} AS chl_lag7, {r('wave_height_max')} AS wave_height,
  {r("wave_height_max / CASE WHEN date = DATE '1998-09-01' THEN 2 ELSE 1 END")} AS wave_height_max,
  CAST(wave_estimated AS INT) AS wave_estimated, CASE WHEN fishing_hours > 0.5 THEN 1 ELSE 0 END AS fished, CAST(0 AS INT) AS chl_age_days
FROM grad JOIN trail USING ({KEY}) LEFT JOIN ecells USING ({KEY}) WHERE sst IS NOT NULL""")
