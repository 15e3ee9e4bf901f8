"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from ..operators.models import rff_matrix

# The 13 half-space neighbour steps (dz, dy, dx), the coif1 filters and the names of the sub-bands.
DIRECTIONS = [
    (0, 0, 1), (0, 1, -1), (0, 1, 0), (0, 1, 1), (1, -1, -1), (1, -1, 0), (1, -1, 1), (1, 0, -1), (1, 0, 0), (1, 0, 1),
    (1, 1, -1), (1, 1, 0), (1, 1, 1),
]
COIF1_LOW = [-0.01565572813546454, -0.0727326195128539, 0.38486484686420286, 0.8525720202122554, 0.3378976624578092, -0.0727326195128539]
COIF1_HIGH = [0.0727326195128539, 0.3378976624578092, -0.8525720202122554, 0.38486484686420286, 0.0727326195128539, -0.01565572813546454]
WAVELET_BANDS = ["LLH", "LHL", "LHH", "HLL", "HLH", "HHL", "HHH", "LLL"]

# ------------------------------------------------------------------------------------------- input views

VOX = """vox AS (
  SELECT CAST(e.vec_id AS VARCHAR) AS case_id, m.modality, CAST(p.i // 16 AS INTEGER) AS z,
         CAST((p.i // 4) % 4 AS INTEGER) AS y, CAST(p.i % 4 AS INTEGER) AS x,
         CAST(CASE WHEN m.modality = 'A' THEN e.embedding[p.i + 1] ELSE e.embedding[64 - p.i] END AS DOUBLE) AS value,
         CASE WHEN CAST(e.embedding[p.i + 1] AS DOUBLE) > CAST(-0.05 AS DOUBLE) THEN 1 ELSE 0 END AS mask
  FROM embeddings e CROSS JOIN range(64) p(i) CROSS JOIN (VALUES ('A'), ('B')) m(modality))"""
# The ROI confined to one corner, for every case in CORNER and for odd cases only in MIXED.
_PART = "CASE WHEN {where}(z >= 1 AND y <= 2 AND x >= 2) THEN mask ELSE 0 END AS mask"
CORNER = VOX.replace("vox AS", "vox0 AS", 1) + ", vox AS (SELECT case_id, modality, z, y, x, value, " + _PART.format(where="") + " FROM vox0)"
MIXED = VOX.replace("vox AS", "vox0 AS", 1) + ", vox AS (SELECT case_id, modality, z, y, x, value, " + (
    _PART.format(where="CAST(case_id AS INTEGER) % 2 = 0 OR ") + " FROM vox0)"
)
VOL = """vol AS (
  SELECT CAST(vec_id AS VARCHAR) AS case_id, m.modality, CAST(2.0 AS DOUBLE) AS sz,
         CAST(0.5 + 0.25 * (vec_id % 2) AS DOUBLE) AS sy, CAST(0.5 + 0.25 * (vec_id % 2) AS DOUBLE) AS sx
  FROM embeddings CROSS JOIN (VALUES ('A'), ('B')) m(modality))"""
COHORT = "cohort AS (SELECT CAST(vec_id AS VARCHAR) AS case_id, CAST(label >= 5 AS INTEGER) AS label FROM embeddings)"
FEAT = """feat AS (
  SELECT CAST(e.vec_id AS VARCHAR) AS case_id, CAST(e.label >= 5 AS INTEGER) AS label, 'f' || lpad(CAST(p.i AS VARCHAR), 2, '0') AS feature,
         CAST(p.i AS INTEGER) AS ord, CASE WHEN p.i = 64 THEN CAST(1 AS DOUBLE) ELSE CAST(e.embedding[p.i + 1] AS DOUBLE) END AS value
  FROM embeddings e CROSS JOIN range(65) p(i))"""
PRED = """pred AS (
  SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, 'm1' AS method, l_quantity / CAST(50 AS DOUBLE) AS prob FROM lineitem
  UNION ALL SELECT CAST(l_returnflag = 'R' AS INTEGER), 'm2', l_discount * CAST(10 AS DOUBLE) FROM lineitem
  UNION ALL SELECT CAST(l_returnflag = 'R' AS INTEGER), 'm3', CAST(1 AS DOUBLE) - l_tax * CAST(10 AS DOUBLE) FROM lineitem
  UNION ALL SELECT CAST(l_returnflag = 'R' AS INTEGER), 'm4', least(CAST(1 AS DOUBLE), l_extendedprice / CAST(105000 AS DOUBLE)) FROM lineitem)"""
SMALL = """small AS (
  SELECT quality AS label, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, 'm1' AS method,
         (doc_id * 37 % 101) / CAST(100 AS DOUBLE) AS prob FROM labels
  UNION ALL SELECT quality, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END, 'm2',
         toxic * CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) FROM labels)"""
WIDE = """wide_rows AS (
  SELECT CAST(event_id AS VARCHAR) AS case_id, CAST(event_type = 'purchase' AS INTEGER) AS label, value AS v1, value * value AS v2 FROM events)"""

V = "case_id, modality, z, y, x"


def r(expr: str) -> str:
    """Six digits, rounded as in the queries: exact fractions on a tie are nudged the same way in both engines."""
    return f"round(CAST({expr} AS DOUBLE) + CAST(1e-9 AS DOUBLE), 6) + CAST(0 AS DOUBLE)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def unpack(values: dict[str, str], keys: str, source: str) -> str:
    """Long rows from named expressions."""
    return " UNION ALL ".join(f"SELECT {keys}, '{n}' AS feature, {r(e)} AS value FROM {source}" for n, e in values.items())


# ------------------------------------------------------------------------------------------- shared pieces


def levels(width: str, source: str = "vox", keys: str = "case_id, modality") -> str:
    return f"""lv AS (
  SELECT {keys}, z, y, x, CAST(floor(value / CAST({width} AS DOUBLE)) - floor(min(value) OVER (PARTITION BY {keys}) / CAST({width} AS DOUBLE)) + 1 AS INTEGER) AS level
  FROM {source} WHERE mask = 1)"""


def steps(name: str, offsets) -> str:
    rows = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(offsets))
    return f"{name}(dir, dz, dy, dx) AS (VALUES {rows})"


AROUND = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]


def on(keys: str, left: str, right: str) -> str:
    return " AND ".join(f"{left}.{k.strip()} = {right}.{k.strip()}" for k in keys.split(","))


def pick(keys: str, alias: str) -> str:
    return ", ".join(f"{alias}.{k.strip()}" for k in keys.split(","))


def pairs(keys: str) -> str:
    return f"""{steps('dirs', DIRECTIONS)},
pairs AS (SELECT {pick(keys, 'a')}, d.dir, a.level AS i, b.level AS j FROM lv a CROSS JOIN dirs d
  JOIN lv b ON {on(keys, 'a', 'b')} AND b.z = a.z + d.dz AND b.y = a.y + d.dy AND b.x = a.x + d.dx),
glcm AS (SELECT {keys}, dir, i, j, count(*) AS n FROM (SELECT * FROM pairs UNION ALL SELECT {keys}, dir, j, i FROM pairs) GROUP BY ALL)"""


def glcm_parts(keys: str) -> tuple[str, dict[str, str]]:
    k = f"{keys}, dir"
    ctes = f"""{pairs(keys)},
p AS (SELECT {k}, i, j, n / CAST(sum(n) OVER (PARTITION BY {k}) AS DOUBLE) AS p FROM glcm),
px AS (SELECT {k}, i, sum(p) AS q FROM p GROUP BY ALL),
mu AS (SELECT {k}, sum(i * q) AS mu, max(i) AS ng, -sum(q * log2(q)) AS hx FROM px GROUP BY ALL),
sg AS (SELECT {pick(k, 'px')}, sum((i - mu) * (i - mu) * q) AS ss FROM px JOIN mu USING ({k}) GROUP BY ALL),
pd AS (SELECT {k}, abs(i - j) AS d, sum(p) AS q FROM p GROUP BY ALL),
da AS (SELECT {k}, sum(d * q) AS da FROM pd GROUP BY ALL),
dd AS (SELECT {pick(k, 'pd')}, sum((d - da) * (d - da) * q) AS dv, -sum(q * log2(q)) AS de, coalesce(sum(CASE WHEN d > 0 THEN q / (d * d) END), 0) AS inv
  FROM pd JOIN da USING ({k}) GROUP BY ALL),
ps AS (SELECT {k}, i + j AS s, sum(p) AS q FROM p GROUP BY ALL),
sd AS (SELECT {k}, sum(s * q) AS sa, -sum(q * log2(q)) AS se FROM ps GROUP BY ALL),
hh AS (SELECT {pick(k, 'p')}, -sum(p * log2(a.q * b.q)) AS hxy1 FROM p
  JOIN px a ON {on(k, 'a', 'p')} AND a.i = p.i JOIN px b ON {on(k, 'b', 'p')} AND b.i = p.j GROUP BY ALL),
ff AS (SELECT {pick(k, 'p')}, any_value(mu) AS mu, any_value(hx) AS hx, sum(i * j * p) AS ac, sum(pow(i + j - 2 * mu, 4) * p) AS cp, sum(pow(i + j - 2 * mu, 3) * p) AS cs,
  sum(pow(i + j - 2 * mu, 2) * p) AS ct, sum((i - j) * (i - j) * p) AS con, sum(p * p) AS je, -sum(p * log2(p)) AS hxy, max(p) AS mp,
  sum(p / (1 + (i - j) * (i - j))) AS idm, sum(p / (1 + (i - j) * (i - j) / CAST(ng * ng AS DOUBLE))) AS idmn,
  sum(p / (1 + abs(i - j))) AS id, sum(p / (1 + abs(i - j) / CAST(ng AS DOUBLE))) AS idn
  FROM p JOIN mu USING ({k}) GROUP BY ALL),
gf AS (SELECT * FROM ff JOIN sg USING ({k}) JOIN da USING ({k}) JOIN dd USING ({k}) JOIN sd USING ({k}) JOIN hh USING ({k}))"""
    values = {
        "Autocorrelation": "avg(ac)", "JointAverage": "avg(mu)", "ClusterProminence": "avg(cp)", "ClusterShade": "avg(cs)",
        "ClusterTendency": "avg(ct)", "Contrast": "avg(con)",
        "Correlation": "avg(CASE WHEN ss = 0 THEN 1 ELSE (ac - mu * mu) / ss END)",
        "DifferenceAverage": "avg(da)", "DifferenceEntropy": "avg(de)", "DifferenceVariance": "avg(dv)",
        "JointEnergy": "avg(je)", "JointEntropy": "avg(hxy)",
        "Imc1": "avg(CASE WHEN hx > 0 THEN (hxy - hxy1) / hx ELSE 0 END)",
        "Imc2": "avg(sqrt(greatest(1 - exp(-2 * (2 * hx - hxy)), 0)))",
        "Idm": "avg(idm)", "Idmn": "avg(idmn)", "Id": "avg(id)", "Idn": "avg(idn)", "InverseVariance": "avg(inv)",
        "MaximumProbability": "avg(mp)", "SumAverage": "avg(sa)", "SumEntropy": "avg(se)", "SumSquares": "avg(ss)",
    }
    return ctes, values


def mcc_cte(keys: str) -> str:
    """MCC per direction: the largest eigenvalue, by size, of P / sqrt(px py) without its trivial part sqrt(px py).

    The symmetric matrix, as a list of rows, is squared 30 times and brought to length 1 each time, which leaves the part of that
    eigenvalue alone; the matrix stretches it by the eigenvalue. A single level counts as 1.
    """
    k = f"{keys}, dir"

    def product(left: str, right: str) -> str:
        return f"list_transform({left}, lambda u: list_transform({right}, lambda w: list_inner_product(u, w)))"

    def length(m: str) -> str:
        return f"sqrt(list_sum(list_transform({m}, lambda u: list_inner_product(u, u))))"

    def unit(m: str) -> str:
        return f"CASE WHEN {length(m)} > 0 THEN list_transform({m}, lambda u: list_transform(u, lambda w: w / {length(m)})) ELSE {m} END"

    return f"""mr AS (SELECT {pick(k, 'a')}, a.i, list(coalesce(p, 0) / sqrt(a.q * b.q) - sqrt(a.q * b.q) ORDER BY b.i) AS u FROM px a
  JOIN px b ON {on(k, 'a', 'b')} LEFT JOIN p ON {on(k, 'p', 'a')} AND p.i = a.i AND p.j = b.i GROUP BY {pick(k, 'a')}, a.i),
mm AS (SELECT {k}, list(u ORDER BY i) AS m FROM mr GROUP BY {k}),
mk({k}, step, x) USING KEY ({k}) AS (SELECT {k}, 0, {unit('m')} FROM mm
  UNION SELECT {k}, step + 1, {unit('y')} FROM (SELECT {k}, step, {product('x', 'x')} AS y FROM mk WHERE step < 30)),
mc AS (SELECT {k}, CASE WHEN len(m) = 1 THEN 1 WHEN {length('x')} > 0 THEN {length(product('x', 'm'))} / {length('x')} ELSE 0 END AS mcc
  FROM mm JOIN mk USING ({k}))"""


def glrlm_cte(keys: str) -> str:
    return f"""{steps('dirs2', DIRECTIONS)},
pos AS (SELECT {keys}, dir, level, CASE WHEN dz = 1 THEN z WHEN dy = 1 THEN y ELSE x END AS t, dz, dy, dx, z, y, x FROM lv CROSS JOIN dirs2),
isl AS (SELECT {keys}, dir, level, z - t * dz AS lz, y - t * dy AS ly, x - t * dx AS lx,
  t - row_number() OVER (PARTITION BY {keys}, dir, level, z - t * dz, y - t * dy, x - t * dx ORDER BY t) AS g FROM pos),
runs AS (SELECT {keys}, dir, level, count(*) AS len FROM isl GROUP BY {keys}, dir, level, lz, ly, lx, g),
glrlm AS (SELECT {keys}, dir, level, len, count(*) AS n FROM runs GROUP BY ALL)"""


def near_cte(keys: str) -> str:
    return f"""{steps('ring', AROUND)},
nbr AS (SELECT {pick(keys, 'a')}, a.z, a.y, a.x, a.level, b.level AS other FROM lv a CROSS JOIN ring d
  JOIN lv b ON {on(keys, 'a', 'b')} AND b.z = a.z + d.dz AND b.y = a.y + d.dy AND b.x = a.x + d.dx)"""


def gldm_cte(keys: str) -> str:
    return f"""dep AS (SELECT {pick(keys, 'v')}, v.z, v.y, v.x, v.level, 1 + coalesce(c.n, 0) AS size FROM lv v
  LEFT JOIN (SELECT {keys}, z, y, x, count(*) AS n FROM nbr WHERE level = other GROUP BY ALL) c USING ({keys}, z, y, x)),
gldm AS (SELECT {keys}, level, size, count(*) AS n FROM dep GROUP BY ALL)"""


def ngtdm_parts(keys: str) -> tuple[str, dict[str, str]]:
    ctes = f"""tone AS (SELECT {keys}, z, y, x, level, abs(level - avg(other)) AS d FROM nbr GROUP BY {keys}, z, y, x, level),
ngt AS (SELECT {keys}, level AS i, count(*) AS n, sum(d) AS s FROM tone GROUP BY ALL),
np AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY {keys}) AS DOUBLE) AS p FROM ngt),
one AS (SELECT {keys}, sum(p * s) AS ps, sum(s) AS ss, sum(n) AS nv, count(*) AS ng FROM np GROUP BY ALL),
two AS (SELECT {pick(keys, 'a')}, sum(a.p * b.p * (a.i - b.i) * (a.i - b.i)) AS c, sum(abs(a.i * a.p - b.i * b.p)) AS bz,
  sum(abs(a.i - b.i) * (a.p * a.s + b.p * b.s) / (a.p + b.p)) AS cx, sum((a.p + b.p) * (a.i - b.i) * (a.i - b.i)) AS st
  FROM np a JOIN np b ON {on(keys, 'a', 'b')} GROUP BY ALL),
tt AS (SELECT * FROM one JOIN two USING ({keys}))"""
    values = {
        "Coarseness": "CASE WHEN ps = 0 THEN 1e6 ELSE 1 / ps END",
        "Contrast": "CASE WHEN ng < 2 THEN 0 ELSE c / (ng * (ng - 1)) * ss / nv END",
        "Busyness": "CASE WHEN bz = 0 THEN 0 ELSE ps / bz END",
        "Complexity": "cx / nv",
        "Strength": "CASE WHEN ss = 0 THEN 0 ELSE st / ss END",
    }
    return ctes, values


def glszm_cte(keys: str) -> str:
    """Zones by reachability from every voxel over equal neighbours; the zone is named by its smallest position."""
    return f"""cell AS (SELECT {keys}, level, (z * 1000 + y) * 1000 + x AS v FROM lv),
edge AS (SELECT {keys}, (z * 1000 + y) * 1000 + x AS a, ((z + dz) * 1000 + y + dy) * 1000 + x + dx AS b FROM (
  SELECT {pick(keys, 'a')}, a.z, a.y, a.x, d.dz, d.dy, d.dx FROM lv a CROSS JOIN ring d
  JOIN lv b ON {on(keys, 'a', 'b')} AND b.z = a.z + d.dz AND b.y = a.y + d.dy AND b.x = a.x + d.dx AND b.level = a.level)),
reach AS (SELECT {keys}, v AS start, v AS spot FROM cell
  UNION SELECT {pick(keys, 'r')}, r.start, e.b FROM reach r JOIN edge e ON {on(keys, 'r', 'e')} AND e.a = r.spot),
zone AS (SELECT {keys}, start, min(spot) AS root FROM reach GROUP BY {keys}, start),
zones AS (SELECT {pick(keys, 'c')}, c.level, z.root, count(*) AS size FROM cell c
  JOIN zone z ON {on(keys, 'c', 'z')} AND c.v = z.start GROUP BY ALL),
glszm AS (SELECT {keys}, level, size, count(*) AS n FROM zones GROUP BY ALL)"""


def size_parts(name: str, matrix: str, keys: str, size: str, labels: list[str], percentage: bool) -> tuple[str, dict[str, str]]:
    """Feature sums of a (level, size) matrix named ``matrix``; ``labels`` in the order of the sums."""
    i, j = "CAST(level AS DOUBLE)", f"CAST({size} AS DOUBLE)"
    bare = ", ".join(k.strip() for k in keys.split(",") if k.strip() != "dir")
    ctes = f"""{name}_m AS (SELECT {keys}, CAST(sum(n) AS DOUBLE) AS m, sum({i} * n) / sum(n) AS mi, sum({j} * n) / sum(n) AS mj FROM {matrix} GROUP BY ALL),
{name}_i AS (SELECT {keys}, sum(q * q) AS gln FROM (SELECT {keys}, level, CAST(sum(n) AS DOUBLE) AS q FROM {matrix} GROUP BY ALL) GROUP BY ALL),
{name}_j AS (SELECT {keys}, sum(q * q) AS sn FROM (SELECT {keys}, {size}, CAST(sum(n) AS DOUBLE) AS q FROM {matrix} GROUP BY ALL) GROUP BY ALL),
{name}_c AS (SELECT {keys}, any_value(m) AS m, sum(n / ({j} * {j})) AS se, sum(n * {j} * {j}) AS le, sum(n * ({i} - mi) * ({i} - mi)) AS glv, sum(n * ({j} - mj) * ({j} - mj)) AS sv,
  -sum(n / m * log2(n / m)) AS ent, sum(n / ({i} * {i})) AS lo, sum(n * {i} * {i}) AS hi, sum(n / ({i} * {i} * {j} * {j})) AS sl, sum(n * {i} * {i} / ({j} * {j})) AS sh,
  sum(n * {j} * {j} / ({i} * {i})) AS ll, sum(n * {i} * {i} * {j} * {j}) AS lh FROM {matrix} JOIN {name}_m USING ({keys}) GROUP BY {keys}),
{name}_n AS (SELECT {bare}, count(*) AS nv FROM lv GROUP BY ALL),
{name}_f AS (SELECT * FROM {name}_c JOIN {name}_i USING ({keys}) JOIN {name}_j USING ({keys}) JOIN {name}_n USING ({bare}))"""
    sums = ["se / m", "le / m", "gln / m", "gln / (m * m)", "sn / m", "sn / (m * m)", "m / nv", "glv / m", "sv / m", "ent", "lo / m", "hi / m",
            "sl / m", "sh / m", "ll / m", "lh / m"]
    if not percentage:
        sums = [s for s in sums if s not in ("m / nv", "gln / (m * m)")]
    return ctes, dict(zip(labels, sums))


RUN_LABELS = [
    "ShortRunEmphasis", "LongRunEmphasis", "GrayLevelNonUniformity", "GrayLevelNonUniformityNormalized", "RunLengthNonUniformity",
    "RunLengthNonUniformityNormalized", "RunPercentage", "GrayLevelVariance", "RunVariance", "RunEntropy", "LowGrayLevelRunEmphasis",
    "HighGrayLevelRunEmphasis", "ShortRunLowGrayLevelEmphasis", "ShortRunHighGrayLevelEmphasis", "LongRunLowGrayLevelEmphasis",
    "LongRunHighGrayLevelEmphasis",
]
ZONE_LABELS = [
    "SmallAreaEmphasis", "LargeAreaEmphasis", "GrayLevelNonUniformity", "GrayLevelNonUniformityNormalized", "SizeZoneNonUniformity",
    "SizeZoneNonUniformityNormalized", "ZonePercentage", "GrayLevelVariance", "ZoneVariance", "ZoneEntropy", "LowGrayLevelZoneEmphasis",
    "HighGrayLevelZoneEmphasis", "SmallAreaLowGrayLevelEmphasis", "SmallAreaHighGrayLevelEmphasis", "LargeAreaLowGrayLevelEmphasis",
    "LargeAreaHighGrayLevelEmphasis",
]
DEPENDENCE_LABELS = [
    "SmallDependenceEmphasis", "LargeDependenceEmphasis", "GrayLevelNonUniformity", "DependenceNonUniformity",
    "DependenceNonUniformityNormalized", "GrayLevelVariance", "DependenceVariance", "DependenceEntropy", "LowGrayLevelEmphasis",
    "HighGrayLevelEmphasis", "SmallDependenceLowGrayLevelEmphasis", "SmallDependenceHighGrayLevelEmphasis",
    "LargeDependenceLowGrayLevelEmphasis", "LargeDependenceHighGrayLevelEmphasis",
]


def averaged(values: dict[str, str]) -> dict[str, str]:
    return {n: f"avg({e})" for n, e in values.items()}


def grouped(values: dict[str, str], keys: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{n}' AS feature, {r(e)} AS value FROM {source} GROUP BY {keys}" for n, e in values.items()
    )


def first_order_parts(keys: str, source: str, width: str, prefix: str = "fo") -> tuple[str, dict[str, str]]:
    vol_keys = "case_id, modality"
    ctes = f"""{prefix}_s AS (SELECT {keys}, count(*) AS n, sum(value * value) AS e, min(value) AS lo, max(value) AS hi, avg(value) AS m,
  quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90
  FROM {source} WHERE mask = 1 GROUP BY ALL),
{prefix}_d AS (SELECT {keys}, avg(abs(value - m)) AS mad, avg(pow(value - m, 2)) AS m2, avg(pow(value - m, 3)) AS m3, avg(pow(value - m, 4)) AS m4,
  avg(value) FILTER (value BETWEEN p10 AND p90) AS rm FROM {source} JOIN {prefix}_s USING ({keys}) WHERE mask = 1 GROUP BY {keys}),
{prefix}_r AS (SELECT {keys}, avg(abs(value - rm)) AS rmad FROM {source} JOIN {prefix}_s USING ({keys}) JOIN {prefix}_d USING ({keys})
  WHERE mask = 1 AND value BETWEEN p10 AND p90 GROUP BY {keys}),
{prefix}_b AS (SELECT {keys}, b, count(*) / CAST(any_value(n) AS DOUBLE) AS q FROM (SELECT {keys}, n, floor(value / CAST({width} AS DOUBLE)) AS b
  FROM {source} JOIN {prefix}_s USING ({keys}) WHERE mask = 1) GROUP BY {keys}, b),
{prefix}_h AS (SELECT {keys}, -sum(q * log2(q)) AS ent, sum(q * q) AS uni FROM {prefix}_b GROUP BY ALL),
{prefix} AS (SELECT * FROM {prefix}_s JOIN {prefix}_d USING ({keys}) LEFT JOIN {prefix}_r USING ({keys}) JOIN {prefix}_h USING ({keys}) JOIN vol USING ({vol_keys}))"""
    values = {
        "Energy": "e", "TotalEnergy": "e * sz * sy * sx", "Entropy": "ent", "Minimum": "lo", "10Percentile": "p10", "90Percentile": "p90",
        "Maximum": "hi", "Mean": "m", "Median": "p50", "InterquartileRange": "p75 - p25", "Range": "hi - lo", "MeanAbsoluteDeviation": "mad",
        "RobustMeanAbsoluteDeviation": "rmad", "RootMeanSquared": "sqrt(e / n)",
        "Skewness": "CASE WHEN hi = lo THEN 0 ELSE m3 / pow(m2, 1.5) END", "Kurtosis": "CASE WHEN hi = lo THEN 0 ELSE m4 / (m2 * m2) END",
        "Variance": "m2", "Uniformity": "uni", "25Percentile": "p25", "75Percentile": "p75",
    }
    return ctes, values


def shape3d_parts(source: str = "vox") -> tuple[str, dict[str, str]]:
    """Eigenvalues by the closed cubic solution; diameters over all pairs of ROI voxels."""
    keys = "case_id, modality"
    ctes = f"""roi AS (SELECT {keys}, z, y, x, z * sz AS pz, y * sy AS py, x * sx AS px, sz, sy, sx FROM {source} JOIN vol USING ({keys}) WHERE mask = 1),
faces(dz, dy, dx) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)),
open AS (SELECT {pick(keys, 'a')}, sum(CASE WHEN dz <> 0 THEN sy * sx WHEN dy <> 0 THEN sz * sx ELSE sz * sy END) AS area
  FROM roi a CROSS JOIN faces d WHERE NOT EXISTS (SELECT 1 FROM roi b WHERE {on(keys, 'a', 'b')} AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx) GROUP BY ALL),
far AS (SELECT {pick(keys, 'a')}, sqrt(max(d)) AS d3, sqrt(max(d) FILTER (sz0)) AS dz, sqrt(max(d) FILTER (sy0)) AS dy, sqrt(max(d) FILTER (sx0)) AS dx FROM (
  SELECT {pick(keys, 'a')}, pow(a.pz - b.pz, 2) + pow(a.py - b.py, 2) + pow(a.px - b.px, 2) AS d, a.z = b.z AS sz0, a.y = b.y AS sy0, a.x = b.x AS sx0
  FROM roi a JOIN roi b ON {on(keys, 'a', 'b')}) a GROUP BY ALL),
cov AS (SELECT {keys}, count(*) * any_value(sz * sy * sx) AS v, var_pop(pz) AS a, var_pop(py) AS b, var_pop(px) AS c, covar_pop(pz, py) AS d, covar_pop(pz, px) AS e, covar_pop(py, px) AS f FROM roi GROUP BY ALL),
c1 AS (SELECT *, (a + b + c) / 3 AS q FROM cov),
c2 AS (SELECT *, sqrt((pow(a - q, 2) + pow(b - q, 2) + pow(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) AS w FROM c1),
c3 AS (SELECT *, CASE WHEN w > 0 THEN ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * w * w * w) ELSE 0 END AS h FROM c2),
c4 AS (SELECT *, acos(least(greatest(h, -1), 1)) / 3 AS phi FROM c3),
c5 AS (SELECT *, greatest(q + 2 * w * cos(phi), 0) AS l1, greatest(q + 2 * w * cos(phi + 2 * pi() / 3), 0) AS l3, greatest(q - 2 * w * cos(phi) - 2 * w * cos(phi + 2 * pi() / 3), 0) AS l2 FROM c4),
sh AS (SELECT * FROM c5 JOIN open USING ({keys}) JOIN far USING ({keys}))"""
    values = {
        "MeshVolume": "v", "VoxelVolume": "v", "SurfaceArea": "area", "SurfaceVolumeRatio": "area / v",
        "Sphericity": "pow(36 * pi() * v * v, 1.0 / 3) / area", "Maximum3DDiameter": "d3", "Maximum2DDiameterSlice": "dz",
        "Maximum2DDiameterColumn": "dy", "Maximum2DDiameterRow": "dx", "MajorAxisLength": "4 * sqrt(l1)", "MinorAxisLength": "4 * sqrt(l2)",
        "LeastAxisLength": "4 * sqrt(l3)", "Elongation": "CASE WHEN l1 > 0 THEN sqrt(l2 / l1) ELSE 0 END",
        "Flatness": "CASE WHEN l1 > 0 THEN sqrt(l3 / l1) ELSE 0 END",
    }
    return ctes, values


KEYS = "case_id, modality"


def with_(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n"


def _features() -> dict[str, str]:
    out = {}
    lv = levels("0.05")
    ctes, values = first_order_parts(KEYS, "vox", "0.05")
    out["first_order_features"] = with_(VOX, VOL, ctes) + unpack(values, KEYS, "fo")
    out["combine_modalities"] = with_(VOX, VOL, ctes) + (
        f"SELECT case_id, feature || '_' || modality AS feature, value FROM ({unpack(values, KEYS, 'fo')})"
    )
    ctes, values = shape3d_parts()
    out["shape3d"] = with_(VOX, VOL, ctes) + unpack(values, KEYS, "sh")
    out["glcm_matrix"] = with_(VOX, lv, pairs(KEYS)) + f"SELECT {KEYS}, CAST(dir AS INTEGER) AS dir, i, j, {big('n')} AS n FROM glcm"
    ctes, values = glcm_parts(KEYS)
    out["glcm_cut"] = out["glcm_matrix"]
    out["glcm_features"] = with_(VOX, lv, ctes, mcc_cte(KEYS), recursive=True) + (
        f"{grouped(values, KEYS, 'gf')} UNION ALL {grouped({'MCC': 'avg(mcc)'}, KEYS, 'mc')}"
    )
    out["glrlm_matrix"] = with_(VOX, lv, glrlm_cte(KEYS)) + (
        f"SELECT {KEYS}, CAST(dir AS INTEGER) AS dir, level, CAST(len AS INTEGER) AS len, {big('n')} AS n FROM glrlm"
    )
    ctes, values = size_parts("rl", "glrlm", f"{KEYS}, dir", "len", RUN_LABELS, True)
    out["glrlm_features"] = with_(VOX, lv, glrlm_cte(KEYS), ctes) + grouped(averaged(values), KEYS, "rl_f")
    out["gldm_matrix"] = with_(VOX, lv, near_cte(KEYS), gldm_cte(KEYS)) + (
        f"SELECT {KEYS}, level, CAST(size AS INTEGER) AS size, {big('n')} AS n FROM gldm"
    )
    ctes, values = size_parts("dp", "gldm", KEYS, "size", DEPENDENCE_LABELS, False)
    out["gldm_features"] = with_(VOX, lv, near_cte(KEYS), gldm_cte(KEYS), ctes) + unpack(values, KEYS, "dp_f")
    ctes, values = ngtdm_parts(KEYS)
    out["ngtdm_features"] = with_(VOX, lv, near_cte(KEYS), ctes) + unpack(values, KEYS, "tt")
    out["glszm_matrix"] = with_(VOX, lv, steps("ring", AROUND), glszm_cte(KEYS), recursive=True) + (
        f"SELECT {KEYS}, level, {big('size')} AS size, {big('n')} AS n FROM glszm"
    )
    out["glszm_cut"] = out["glszm_matrix"]
    ctes, values = size_parts("zn", "glszm", KEYS, "size", ZONE_LABELS, True)
    out["glszm_features"] = with_(VOX, lv, steps("ring", AROUND), glszm_cte(KEYS), ctes, recursive=True) + unpack(values, KEYS, "zn_f")
    out["shape2d"] = with_(
        VOX, VOL,
        """roi AS (SELECT case_id, modality, z, y, x, y * sy AS py, x * sx AS px, sy, sx FROM vox JOIN vol USING (case_id, modality) WHERE mask = 1),
faces(dy, dx) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)),
per AS (SELECT a.case_id, a.modality, a.z, sum(CASE WHEN dy <> 0 THEN sx ELSE sy END) AS p FROM roi a CROSS JOIN faces d
  WHERE NOT EXISTS (SELECT 1 FROM roi b WHERE b.case_id = a.case_id AND b.modality = a.modality AND b.z = a.z AND b.y = a.y + dy AND b.x = a.x + dx) GROUP BY ALL),
far AS (SELECT a.case_id, a.modality, a.z, sqrt(max(pow(a.py - b.py, 2) + pow(a.px - b.px, 2))) AS d FROM roi a JOIN roi b USING (case_id, modality, z) GROUP BY ALL),
cov AS (SELECT case_id, modality, z, count(*) * any_value(sy * sx) AS s, var_pop(py) AS a, var_pop(px) AS b, covar_pop(py, px) AS c FROM roi GROUP BY ALL),
e AS (SELECT *, (a + b) / 2 + sqrt(pow(a - b, 2) / 4 + c * c) AS l1, greatest((a + b) / 2 - sqrt(pow(a - b, 2) / 4 + c * c), 0) AS l2 FROM cov),
f2 AS (SELECT * FROM e JOIN per USING (case_id, modality, z) JOIN far USING (case_id, modality, z))""",
    ) + unpack(
        {
            "PixelSurface": "s", "MeshSurface": "s", "Perimeter": "p", "PerimeterSurfaceRatio": "p / s", "Sphericity": "2 * sqrt(pi() * s) / p",
            "MaximumDiameter": "d", "MajorAxisLength": "4 * sqrt(l1)", "MinorAxisLength": "4 * sqrt(l2)",
            "Elongation": "CASE WHEN l1 > 0 THEN sqrt(l2 / l1) ELSE 0 END",
        },
        "case_id, modality, z",
        "f2",
    )
    out["extract_features"] = _extract()
    return out


def _extract() -> str:
    keys = "case_id, modality, filter"
    box = """bb AS (SELECT case_id, modality, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM vox WHERE mask = 1 GROUP BY ALL),
crop AS (SELECT vox.* FROM vox JOIN bb USING (case_id, modality) WHERE z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1),
norm AS (SELECT case_id, modality, z, y, x, mask, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS value FROM crop WINDOW w AS (PARTITION BY case_id, modality)),
img AS (SELECT case_id, modality, 'original' AS filter, z, y, x, mask, value FROM norm
  UNION ALL SELECT case_id, modality, 'square', z, y, x, mask, value * value / max(abs(value)) OVER (PARTITION BY case_id, modality) FROM norm)"""
    fo, fo_v = first_order_parts(keys, "img", "0.5")
    co, co_v = glcm_parts(keys)
    rl, rl_v = size_parts("rl", "glrlm", f"{keys}, dir", "len", RUN_LABELS, True)
    zn, zn_v = size_parts("zn", "glszm", keys, "size", ZONE_LABELS, True)
    dp, dp_v = size_parts("dp", "gldm", keys, "size", DEPENDENCE_LABELS, False)
    ng, ng_v = ngtdm_parts(keys)
    sh, sh_v = shape3d_parts()
    head = with_(
        VOX, VOL, box, levels("0.5", "img", keys), fo, co, glrlm_cte(keys), rl, near_cte(keys), gldm_cte(keys), dp, ng, glszm_cte(keys), zn, sh,
        recursive=True,
    )
    parts = [
        ("first_order", unpack(fo_v, keys, "fo")),
        ("glcm", grouped(co_v, keys, "gf")),
        ("glrlm", grouped(averaged(rl_v), keys, "rl_f")),
        ("glszm", unpack(zn_v, keys, "zn_f")),
        ("ngtdm", unpack(ng_v, keys, "tt")),
        ("gldm", unpack(dp_v, keys, "dp_f")),
        ("shape3d", f"SELECT case_id, modality, 'original' AS filter, feature, value FROM ({unpack(sh_v, KEYS, 'sh')})"),
    ]
    return head + " UNION ALL ".join(
        f"SELECT case_id, '{c}_' || feature || '_' || filter || '_' || modality AS feature, value FROM ({s})" for c, s in parts
    )


def _prepare() -> dict[str, str]:
    out = {}
    out["missing_pairs"] = with_(COHORT) + """SELECT case_id, modality, kind FROM cohort CROSS JOIN (VALUES ('A'), ('B')) m(modality) CROSS JOIN (VALUES ('image'), ('mask')) k(kind)
WHERE CAST(case_id AS BIGINT) % 17 = 0 AND modality = 'B' AND kind = 'mask'"""
    out["clinical_lookup"] = """SELECT CAST(event_id AS VARCHAR) AS case_id,
  CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') ELSE CAST(c_nationkey AS VARCHAR) END AS age
FROM events LEFT JOIN customer ON user_id = c_custkey"""
    out["geometry_check"] = with_(VOX) + """SELECT case_id, modality, max(z) + 1 AS n_z, max(y) + 1 AS n_y, max(x) + 1 AS n_x,
  max(z) FILTER (mask = 1) + 1 AS mask_z, max(y) FILTER (mask = 1) + 1 AS mask_y, max(x) FILTER (mask = 1) + 1 AS mask_x,
  coalesce(max(z) = max(z) FILTER (mask = 1) AND max(y) = max(y) FILTER (mask = 1) AND max(x) = max(x) FILTER (mask = 1), false) AS ok
FROM vox GROUP BY ALL"""
    out["geometry_check_mixed"] = out["geometry_check"].replace(VOX, MIXED)
    out["feature_count_check"] = with_(FEAT) + """SELECT case_id, count(DISTINCT feature) AS n_features FROM feat WHERE value > 0
GROUP BY ALL HAVING count(DISTINCT feature) <> 33"""
    out["binarize_mask"] = with_(VOX) + f"SELECT {V}, CASE WHEN mask + CASE WHEN value > 0 THEN 1 ELSE 0 END > 1 THEN 1 ELSE 0 END AS mask FROM vox"
    out["change_window"] = with_(VOX) + (
        f"SELECT {V}, {r('least(greatest((value * 1000 - CAST(-159.5 AS DOUBLE)) * CAST(255 AS DOUBLE) / 400, 0), 255)')} AS value FROM vox"
    )
    out["clip_percentile"] = with_(VOX, """q AS (SELECT case_id, modality, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM vox GROUP BY ALL)""") + (
        f"SELECT {V}, {r('least(greatest(value, lo), hi)')} AS value FROM vox JOIN q USING (case_id, modality)"
    )
    out["crop_to_roi"] = with_(VOX, """bb AS (SELECT case_id, modality, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM vox WHERE mask = 1 GROUP BY ALL)""") + (
        f"SELECT {V}, value FROM vox JOIN bb USING (case_id, modality) WHERE z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1"
    )
    out["crop_to_roi_corner"] = out["crop_to_roi"].replace(VOX, CORNER)
    out["normalize_image"] = with_(VOX) + (
        f"SELECT {V}, {r('(value - avg(value) OVER w) / stddev_pop(value) OVER w')} AS value FROM vox WINDOW w AS (PARTITION BY case_id, modality)"
    )
    out["auto_binwidth"] = with_(
        VOX,
        """c AS (SELECT modality, case_id, max(value) AS hi, min(value) AS lo FROM vox WHERE mask = 1 GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY md5(case_id || '|42'), case_id) AS k FROM c)""",
    ) + f"SELECT modality, {r('(max(hi) - avg(lo)) / 10')} AS binwidth FROM s WHERE k <= 10 GROUP BY modality"
    out["discretize"] = with_(VOX, levels("0.05")) + f"SELECT {V}, level FROM lv"
    out["median_spacing"] = with_(VOL) + " UNION ALL ".join(
        f"SELECT '{a}' AS axis, {r(f'quantile_cont(s{a}, 0.5)')} AS spacing FROM vol" for a in ("z", "y", "x")
    )
    target = {"z": "1.0", "y": "0.6", "x": "0.6"}
    n_out = {a: f"CAST(floor(4 * s{a} / CAST({t} AS DOUBLE) + 0.5) AS BIGINT)" for a, t in target.items()}
    grid = "SELECT case_id, modality, " + ", ".join(f"s{a}" for a in target) + ", " + ", ".join(f"CAST({a}.o AS INTEGER) AS {a}" for a in target)
    grid += " FROM vol, " + ", ".join(f"range({n_out[a]}) {a}(o)" for a in target)
    for name, rule in (
        ("origin", lambda a: f"CAST(floor({a} * CAST({target[a]} AS DOUBLE) / s{a} + 0.5) AS BIGINT)"),
        ("center", lambda a: f"CAST(floor(({a} + 0.5) * 4 / {n_out[a]}) AS BIGINT)"),
    ):
        src = ", ".join(f"{rule(a)} AS i{a}" for a in target)
        fill = "-1" if name == "origin" else "0"
        out[f"regrid_{name}"] = with_(VOX, VOL, f"grid AS ({grid})", f"src AS (SELECT *, {src} FROM grid)") + (
            f"SELECT s.case_id, s.modality, s.z, s.y, s.x, coalesce(v.value, CAST({fill} AS DOUBLE)) AS value, coalesce(v.mask, 0) AS mask FROM src s "
            "LEFT JOIN vox v ON v.case_id = s.case_id AND v.modality = s.modality AND v.z = s.iz AND v.y = s.iy AND v.x = s.ix"
        )
    peak = "max(abs(value)) OVER (PARTITION BY case_id, modality)"
    points = {
        "original": "value",
        "square": "value * value / m",
        "square_root": "sign(value) * sqrt(m * abs(value))",
        "logarithm": "sign(value) * m / ln(m + 1) * ln(abs(value) + 1)",
        "exponential": "exp(ln(m) / m * value)",
    }
    for name, e in points.items():
        out[f"filter_{name}"] = with_(VOX, f"pk AS (SELECT *, {peak} AS m FROM vox)") + f"SELECT {V}, {r(e)} AS value, '{name}' AS filter FROM pk"
    near = []
    for a, others in (("z", "y, x"), ("y", "z, x"), ("x", "z, y")):
        w = f"OVER (PARTITION BY case_id, modality, {others} ORDER BY {a})"
        near.append(f"(coalesce(lead(value) {w}, value) - coalesce(lag(value) {w}, value)) / (2 * s{a}) AS g{a}")
    out["filter_gradient"] = with_(VOX, VOL, f"g AS (SELECT {V}, {', '.join(near)} FROM vox JOIN vol USING (case_id, modality))") + (
        f"SELECT {V}, {r('sqrt(gz * gz + gy * gy + gx * gx)')} AS value, 'gradient' AS filter FROM g"
    )
    out["filter_log"] = _log_sql()
    out["filter_wavelet"] = _wavelet_sql()
    out["filter_lbp_2d"] = _lbp_sql()
    return out


def _log_sql(sigma: float = 1.0) -> str:
    """Kernels per spacing, then one weighted self-join per axis with clamped positions."""
    kernel = f"""sp AS (SELECT DISTINCT s FROM (SELECT sz AS s FROM vol UNION ALL SELECT sy FROM vol)),
k0 AS (SELECT s, j.j - 100 AS j, {sigma} / s AS w FROM sp CROSS JOIN range(201) j(j) WHERE abs(j.j - 100) <= greatest(1, ceil(4 * {sigma} / s))),
k1 AS (SELECT s, j, w, exp(-j * j / (2 * w * w)) / sum(exp(-j * j / (2 * w * w))) OVER (PARTITION BY s) AS g FROM k0),
k2 AS (SELECT s, j, g, (j * j / pow(w, 4) - 1 / pow(w, 2)) * g AS d FROM k1),
ker AS (SELECT s, j, g, (d - avg(d) OVER (PARTITION BY s)) / (s * s) AS d FROM k2)"""
    passes = []
    source = "vox JOIN vol USING (case_id, modality)"
    for n, a in enumerate(("x", "y", "z")):
        g, d = ("sum(k.g * b.value)", "sum(k.d * b.value)") if n == 0 else ("sum(k.g * b.g)", "sum(k.g * b.d + k.d * b.g)")
        others = " AND ".join(f"b.{o} = a.{o}" for o in "zyx" if o != a)
        base = "v0" if n == 0 else f"p{n}"
        passes.append(f"""p{n + 1} AS (SELECT a.case_id, a.modality, a.z, a.y, a.x, a.sz, a.sy, a.sx, {g} AS g, {d} AS d FROM {base} a
  JOIN ker k ON k.s = a.s{a} JOIN {base} b ON b.case_id = a.case_id AND b.modality = a.modality AND {others} AND b.{a} = least(greatest(a.{a} + k.j, 0), 3) GROUP BY ALL)""")
    return with_(VOX, VOL, kernel, f"v0 AS (SELECT * FROM {source})", *passes) + (
        f"SELECT {V}, {r(f'd * {sigma} * {sigma}')} AS value, 'log_1' AS filter FROM p3"
    )


def _wavelet_sql() -> str:
    low = ", ".join(f"('L', {i}, CAST({v} AS DOUBLE))" for i, v in enumerate(COIF1_LOW))
    high = ", ".join(f"('H', {i}, CAST({v} AS DOUBLE))" for i, v in enumerate(COIF1_HIGH))
    passes = []
    for n, a in enumerate(("x", "y", "z")):
        others = " AND ".join(f"b.{o} = a.{o}" for o in "zyx" if o != a)
        base = f"w{n}"
        passes.append(f"""w{n + 1} AS (SELECT a.case_id, a.modality, a.z, a.y, a.x, h.f || a.band AS band, sum(h.v * b.value) AS value FROM {base} a CROSS JOIN h
  JOIN {base} b ON b.case_id = a.case_id AND b.modality = a.modality AND b.band = a.band AND {others} AND b.{a} = (a.{a} + 3 - h.k + 8) % 4 GROUP BY ALL)""")
    bands = ", ".join(f"'{b}'" for b in WAVELET_BANDS)
    return with_(VOX, f"h(f, k, v) AS (VALUES {low}, {high})", "w0 AS (SELECT *, '' AS band FROM vox)", *passes) + (
        f"SELECT {V}, {r('value')} AS value, 'wavelet-' || band AS filter FROM w3 WHERE band IN ({bands})"
    )


def _lbp_sql() -> str:
    """Eight samples at radius 1; the diagonal ones are bilinear in the four pixels around them."""
    t = "CAST(0.70711 AS DOUBLE)"

    def at(dy: int, dx: int) -> str:
        return f"coalesce(max(b.value) FILTER (b.y = a.y + ({dy}) AND b.x = a.x + ({dx})), 0)"

    def corner(sy: int, sx: int) -> str:
        return (
            f"(1 - {t}) * (1 - {t}) * a.value + {t} * (1 - {t}) * {at(sy, 0)} + (1 - {t}) * {t} * {at(0, sx)} + {t} * {t} * {at(sy, sx)}"
        )

    samples = [at(0, 1), corner(-1, 1), at(-1, 0), corner(-1, -1), at(0, -1), corner(1, -1), at(1, 0), corner(1, 1)]
    bits = ", ".join(f"CAST(({s}) - a.value >= 0 AS INTEGER) AS b{i}" for i, s in enumerate(samples))
    ones = " + ".join(f"b{i}" for i in range(8))
    changes = " + ".join(f"abs(b{i} - b{(i + 1) % 8})" for i in range(8))
    return with_(VOX, f"""bits AS (SELECT a.case_id, a.modality, a.z, a.y, a.x, {bits} FROM vox a
  JOIN vox b ON b.case_id = a.case_id AND b.modality = a.modality AND b.z = a.z AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1
  GROUP BY a.case_id, a.modality, a.z, a.y, a.x, a.value)""") + (
        f"SELECT {V}, {r(f'CASE WHEN {changes} <= 2 THEN {ones} ELSE 9 END')} AS value, 'lbp-2D' AS filter FROM bits"
    )


def split_sql(source: str, name: str = "sp") -> str:
    """30 % stratified split of a (case_id, label) table by largest remainder and md5 order."""
    return f"""{name}_c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS t FROM {source} GROUP BY label),
{name}_s AS (SELECT label, ceil(CAST(0.3 AS DOUBLE) * t) AS nt, ceil(CAST(0.3 AS DOUBLE) * t) * n / t AS share FROM {name}_c),
{name}_q AS (SELECT label, floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, label) <= nt - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM {name}_s),
{name} AS (SELECT case_id, label, CASE WHEN k <= quota THEN 'test' ELSE 'train' END AS split FROM
  (SELECT case_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(case_id || '|42'), case_id) AS k FROM {source}) JOIN {name}_q USING (label))"""


TRAIN = f"""{COHORT},
{FEAT},
{split_sql('cohort')},
fs AS (SELECT feat.*, sp.split FROM feat JOIN sp USING (case_id)),
st AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s, min(value) AS lo, max(value) AS hi FROM fs WHERE split = 'train' GROUP BY feature HAVING var_samp(value) > 0.01),
sc AS (SELECT fs.case_id, fs.label, fs.feature, fs.ord, fs.split, (value - m) / s AS value, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END AS unit FROM fs JOIN st USING (feature)),
tr AS (SELECT * FROM sc WHERE split = 'train'),
te AS (SELECT * FROM sc WHERE split = 'test')"""


def f_sql(source: str, name: str) -> str:
    return f"""{name}_c AS (SELECT feature, ord, label, count(*) AS n, avg(value) AS m, sum(value) AS s, var_pop(value) * count(*) AS w FROM {source} GROUP BY ALL),
{name}_g AS (SELECT *, sum(s) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS g FROM {name}_c),
{name} AS (SELECT feature, ord, CASE WHEN sum(w) > 0 THEN (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) END AS score FROM {name}_g GROUP BY feature, ord)"""


def chi2_sql(source: str, name: str) -> str:
    return f"""{name}_r AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM {source} GROUP BY feature),
{name}_u AS (SELECT feature, ord, label, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END AS u FROM {source} JOIN {name}_r USING (feature)),
{name}_o AS (SELECT feature, ord, label, sum(u) AS o, count(*) AS n FROM {name}_u GROUP BY ALL),
{name}_e AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) * sum(o) OVER (PARTITION BY feature) AS e FROM {name}_o),
{name} AS (SELECT feature, ord, sum(CASE WHEN e > 0 THEN (o - e) * (o - e) / e END) AS score FROM {name}_e GROUP BY feature, ord)"""


CHAIN = f"""{f_sql('tr', 'f1')},
k1 AS (SELECT feature FROM (SELECT feature, row_number() OVER (ORDER BY score DESC NULLS LAST, ord DESC) AS k FROM f1) WHERE k <= 30),
t2 AS (SELECT * FROM tr WHERE feature IN (SELECT feature FROM k1)),
{chi2_sql('t2', 'f2')},
k2 AS (SELECT feature FROM (SELECT feature, row_number() OVER (ORDER BY score DESC NULLS LAST, ord DESC) AS k FROM f2) WHERE k <= 12)"""

KNN = """dist AS (SELECT a.case_id, any_value(a.label) AS label, b.case_id AS other, any_value(b.label) AS vote, sqrt(sum((a.value - b.value) * (a.value - b.value))) AS d
  FROM te a JOIN tr b ON a.feature = b.feature GROUP BY a.case_id, b.case_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY d, other) AS k FROM dist)"""
NB = """nb_s AS (SELECT feature, label, avg(value) AS m, var_pop(value) AS v FROM tr GROUP BY ALL),
nb_w AS (SELECT max(v) AS w FROM (SELECT var_pop(value) AS v FROM tr GROUP BY feature)),
nb_p AS (SELECT label, count(DISTINCT case_id) AS n FROM tr GROUP BY label),
nb_l AS (SELECT te.case_id, any_value(te.label) AS label, s.label AS c, sum(-0.5 * (ln(2 * pi() * (s.v + 1e-9 * w)) + (value - m) * (value - m) / (s.v + 1e-9 * w))) + any_value(ln(n)) AS l
  FROM te JOIN nb_s s USING (feature) CROSS JOIN nb_w JOIN nb_p p ON p.label = s.label GROUP BY te.case_id, s.label),
nb AS (SELECT case_id, any_value(label) AS label, 1 / (1 + exp(max(l) FILTER (c = 0) - max(l) FILTER (c = 1))) AS prob FROM nb_l GROUP BY case_id)"""


def _frame() -> dict[str, str]:
    out = {}
    stats = "st0 AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s, var_samp(value) AS v, min(value) AS lo, max(value) AS hi FROM feat GROUP BY feature)"
    z = "CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END"
    out["exclude_low_variance"] = with_(FEAT, stats) + f"SELECT case_id, feature, {r('value')} AS value FROM feat JOIN st0 USING (feature) WHERE v > 0.0156"
    out["standardize"] = with_(FEAT, stats) + f"SELECT case_id, feature, {r(z)} AS value FROM feat JOIN st0 USING (feature)"
    out["min_max"] = with_(FEAT, stats) + (
        f"SELECT case_id, feature, {r('CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END')} AS value FROM feat JOIN st0 USING (feature)"
    )
    out["preprocess"] = with_(FEAT, stats) + f"SELECT case_id, feature, {r(z)} AS value FROM feat JOIN st0 USING (feature) WHERE v > 0.0156"
    out["apply_scaler"] = with_(TRAIN) + f"SELECT case_id, feature, {r('unit')} AS value FROM te"
    out["stratified_split"] = with_(WIDE, split_sql("wide_rows")) + "SELECT case_id, split FROM sp"
    out["split_by_list"] = with_(COHORT, split_sql("cohort")) + "SELECT case_id, label, split FROM sp"
    out["class_distribution"] = with_(WIDE, split_sql("wide_rows")) + (
        f"SELECT coalesce(split, 'data') AS split, {big('count(*)')} AS total, {big('sum(label)')} AS positive, {big('sum(1 - label)')} AS negative FROM sp GROUP BY ROLLUP (split)"
    )
    out["shuffle_rows"] = with_(WIDE) + "SELECT case_id, label, v1 FROM wide_rows ORDER BY md5(case_id || '|7'), case_id"
    out["class_weights"] = with_(WIDE) + (
        f"SELECT label, {r('sum(count(*)) OVER () / (count(*) OVER () * count(*))')} AS weight FROM wide_rows GROUP BY label"
    )
    out["stratified_folds"] = with_(WIDE) + """SELECT case_id, label, CAST(r AS INTEGER) AS rep,
  CAST((row_number() OVER (PARTITION BY r, label ORDER BY md5(case_id || '|42|' || CAST(r AS VARCHAR)), case_id) - 1) % 10 AS INTEGER) AS fold
FROM wide_rows CROSS JOIN range(3) t(r)"""
    cells = ", ".join(f"max(value) FILTER (feature = 'f{i:02d}') AS f{i:02d}" for i in range(65))
    out["to_wide"] = with_(FEAT) + f"SELECT case_id, label, {cells} FROM feat GROUP BY case_id, label"
    out["to_vectors"] = with_(FEAT) + "SELECT case_id, label, ord, value FROM feat"
    return out


def _scores() -> dict[str, str]:
    out = {}
    out["chi2_scores"] = with_(FEAT, chi2_sql("feat", "c2")) + f"SELECT feature, {r('score')} AS score FROM c2"
    out["f_scores"] = with_(FEAT, f_sql("feat", "fs")) + f"SELECT feature, {r('score')} AS score FROM fs"
    out["select_k_best"] = with_(FEAT, f_sql("feat", "fs")) + """SELECT feature, CAST(k AS INTEGER) AS rank FROM
  (SELECT feature, row_number() OVER (ORDER BY score DESC NULLS LAST, ord DESC) AS k FROM fs) WHERE k <= 10"""
    out["mi_scores"] = with_(
        FEAT,
        COHORT,
        """pr AS (SELECT a.feature, a.case_id, a.label, a.value, b.case_id AS other, b.label AS other_label, abs(a.value - b.value) AS d
  FROM feat a JOIN feat b ON a.feature = b.feature),
nl AS (SELECT label, count(*) AS nl FROM cohort GROUP BY label),
ra AS (SELECT feature, case_id, label, d AS r FROM (SELECT *, row_number() OVER (PARTITION BY feature, case_id ORDER BY d) AS k FROM pr
  WHERE label = other_label AND case_id <> other) WHERE k = 3),
mm AS (SELECT pr.feature, pr.case_id, pr.label, count(*) AS m FROM pr JOIN ra USING (feature, case_id, label) WHERE CASE WHEN r > 0 THEN d < r ELSE d <= 0 END GROUP BY ALL),
psi AS (SELECT n, coalesce(sum(CAST(1 AS DOUBLE) / n) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 0.5772156649015329 AS p FROM range(1, 100001) t(n))""",
    ) + f"""SELECT feature, {r('greatest(any_value(pn.p) + any_value(pk.p) - avg(pl.p) - avg(pm.p), 0)')} AS score
FROM mm JOIN nl USING (label) JOIN psi pl ON pl.n = nl JOIN psi pm ON pm.n = m JOIN psi pk ON pk.n = 3 JOIN psi pn ON pn.n = (SELECT count(*) FROM cohort) GROUP BY feature"""
    out["correlation_matrix"] = with_(
        FEAT, "flat AS (SELECT feature FROM feat GROUP BY feature HAVING min(value) = max(value))"
    ) + f"""SELECT a.feature AS f1, b.feature AS f2, CASE WHEN a.feature IN (SELECT feature FROM flat) OR b.feature IN (SELECT feature FROM flat) THEN NULL
  ELSE {r('corr(a.value, b.value)')} END AS r FROM feat a JOIN feat b USING (case_id) GROUP BY a.feature, b.feature"""
    picks = ["p1 AS (SELECT 1 AS rank, feature, score FROM f ORDER BY score DESC LIMIT 1)"]
    for t in range(2, 6):
        held = " UNION ALL ".join(f"SELECT feature FROM p{i}" for i in range(1, t))
        picks.append(f"""p{t} AS (SELECT {t} AS rank, f.feature, any_value(f.score) / greatest(avg(greatest(c.c, 0.001)), 0.001) AS score FROM f JOIN cr c ON c.f1 = f.feature
  WHERE c.f2 IN ({held}) AND f.feature NOT IN ({held}) GROUP BY f.feature ORDER BY score DESC LIMIT 1)""")
    out["mrmr_select"] = with_(
        FEAT,
        f_sql("feat", "fs"),
        "f AS (SELECT * FROM fs WHERE score IS NOT NULL)",
        "cr AS (SELECT a.feature AS f1, b.feature AS f2, abs(corr(a.value, b.value)) AS c FROM feat a JOIN feat b USING (case_id) WHERE a.ord < 64 AND b.ord < 64 GROUP BY ALL)",
        *picks,
    ) + " UNION ALL ".join(f"SELECT CAST(rank AS INTEGER) AS rank, feature, {r('score')} AS score FROM p{t}" for t in range(1, 6))
    # The scaled features have the same correlations and F scores.
    out["mrmr_mixed_scale"] = out["mrmr_select"]
    relief = """rg AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM feat GROUP BY feature),
un AS (SELECT case_id, label, feature, ord, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END AS u FROM feat JOIN rg USING (feature)),
an AS (SELECT case_id FROM (SELECT case_id, row_number() OVER (ORDER BY md5(case_id || '|42'), case_id) AS k FROM cohort) WHERE k <= 20),
ds AS (SELECT a.case_id, b.case_id AS other, any_value(a.label = b.label) AS same, sum(abs(a.u - b.u)) AS d FROM un a JOIN an USING (case_id) JOIN un b ON a.feature = b.feature
  WHERE a.case_id <> b.case_id GROUP BY a.case_id, b.case_id),
nr AS (SELECT case_id, other, same FROM (SELECT *, row_number() OVER (PARTITION BY case_id, same ORDER BY d, other) AS k FROM ds) WHERE k = 1),
wt AS (SELECT a.feature, a.ord, sum(CASE WHEN same THEN -1 ELSE 1 END * abs(a.u - b.u)) / 20 AS score FROM nr JOIN un a USING (case_id) JOIN un b ON b.case_id = nr.other AND b.feature = a.feature GROUP BY ALL)"""
    out["relief_weights"] = with_(FEAT, COHORT, relief) + f"SELECT feature, {r('score')} AS score FROM wt"
    out["relief_select"] = with_(FEAT, COHORT, relief) + (
        "SELECT feature, score > (SELECT score FROM wt ORDER BY score DESC LIMIT 1 OFFSET 10) AS keep FROM wt"
    )
    out["run_selection"] = with_(TRAIN, CHAIN) + "SELECT 1 AS step, 'anova' AS method, feature FROM k1 UNION ALL SELECT 2, 'chi2', feature FROM k2"
    out["apply_support"] = with_(TRAIN, CHAIN) + f"SELECT case_id, feature, {r('value')} AS value FROM te WHERE feature IN (SELECT feature FROM k2)"
    out["knn_predict"] = with_(TRAIN, KNN, """wn AS (SELECT case_id, label, vote, CASE WHEN max(CAST(d = 0 AS INTEGER)) OVER (PARTITION BY case_id) = 1 THEN CAST(d = 0 AS INTEGER) ELSE 1 / d END AS w FROM rk WHERE k <= 5)""") + (
        f"SELECT case_id, label, {r('sum(w * vote) / sum(w)')} AS prob FROM wn GROUP BY case_id, label"
    )
    out["gaussian_nb"] = with_(TRAIN, NB) + f"SELECT case_id, label, {r('prob')} AS prob FROM nb"
    out["prediction_frame"] = with_(TRAIN, KNN, NB, "kn AS (SELECT case_id, avg(vote) AS prob FROM rk WHERE k <= 3 GROUP BY case_id)") + (
        f"SELECT nb.case_id, nb.label, {r('kn.prob')} AS knn, {r('nb.prob')} AS naive_bayes FROM nb JOIN kn USING (case_id)"
    )
    weights, phase = rff_matrix(65, 4, 0.5, 42)
    cells = ", ".join(f"({c}, {o}, CAST({float(weights[o, c])!r} AS DOUBLE))" for c in range(4) for o in range(65))
    shift = ", ".join(f"({c}, CAST({float(phase[c])!r} AS DOUBLE))" for c in range(4))
    out["rff_transform"] = with_(FEAT, f"w(pos, ord, w) AS (VALUES {cells})", f"b(pos, b) AS (VALUES {shift})") + (
        f"SELECT case_id, CAST(pos AS INTEGER) AS pos, {r('sqrt(CAST(0.5 AS DOUBLE)) * cos(sum(value * w) + any_value(b))')} AS value FROM feat JOIN w USING (ord) JOIN b USING (pos) GROUP BY case_id, pos"
    )
    return out


def _evaluation() -> dict[str, str]:
    out = {}
    curve = """ct AS (SELECT method, prob, sum(label) AS pos, sum(1 - label) AS neg FROM pred GROUP BY ALL),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY method) AS p, sum(neg) OVER (PARTITION BY method) AS n FROM ct
  WINDOW w AS (PARTITION BY method ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
    roc = """rc AS (SELECT method, prob AS threshold, fp / CAST(n AS DOUBLE) AS fpr, tp / CAST(p AS DOUBLE) AS tpr FROM cu
  UNION ALL SELECT DISTINCT method, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM pred)"""
    area = """tz AS (SELECT method, (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM rc WINDOW w AS (PARTITION BY method ORDER BY fpr, tpr)),
au AS (SELECT method, sum(a) AS auc FROM tz GROUP BY method)"""
    out["roc_curve"] = with_(PRED, curve, roc) + f"SELECT method, {r('threshold')} AS threshold, {r('fpr')} AS fpr, {r('tpr')} AS tpr FROM rc"
    out["auc_rare_event"] = with_(PRED.replace("pred AS", "pred0 AS", 1), "pred AS (SELECT label, method, prob * 0.0009 AS prob FROM pred0)", curve, roc, area) + (
        f"SELECT method, {r('auc')} AS auc FROM au"
    )
    out["auc"] = with_(PRED, curve, roc, area) + f"SELECT method, {r('auc')} AS auc FROM au"
    out["rank_methods"] = with_(PRED, curve, roc, area) + (
        f"SELECT method, {r('auc')} AS auc, CAST(row_number() OVER (ORDER BY auc DESC, method) AS INTEGER) AS rank, row_number() OVER (ORDER BY auc DESC, method) <= 3 AS top FROM au"
    )

    def cut(source: str) -> str:
        return f"""yt AS (SELECT DISTINCT method, {'split, ' if source == 'small' else ''}prob AS t FROM {source}),
yj AS (SELECT yt.*, sum(CASE WHEN s.prob >= t THEN label ELSE 0 END) / CAST(sum(label) AS DOUBLE) + 1 - sum(CASE WHEN s.prob >= t THEN 1 - label ELSE 0 END) / CAST(sum(1 - label) AS DOUBLE) AS j
  FROM yt JOIN {source} s ON s.method = yt.method{' AND s.split = yt.split' if source == 'small' else ''} GROUP BY ALL),
yc AS (SELECT method, {'split, ' if source == 'small' else ''}CASE WHEN max(j) > 1 THEN max(t) FILTER (j = mj) ELSE CAST('inf' AS DOUBLE) END AS cutoff
  FROM (SELECT *, max(j) OVER (PARTITION BY method{', split' if source == 'small' else ''}) AS mj FROM yj) GROUP BY ALL)"""

    out["youden_cutoff"] = with_(SMALL, cut("small")) + f"SELECT split, method, {r('cutoff')} AS cutoff FROM yc"
    test = "tst AS (SELECT label, method, prob FROM small WHERE split = 'test')"
    conf = """cf AS (SELECT split, method, sum(CASE WHEN prob < cutoff THEN 1 - label ELSE 0 END) AS tn, sum(CASE WHEN prob >= cutoff THEN 1 - label ELSE 0 END) AS fp,
  sum(CASE WHEN prob < cutoff THEN label ELSE 0 END) AS fn, sum(CASE WHEN prob >= cutoff THEN label ELSE 0 END) AS tp FROM small JOIN yc USING (method) GROUP BY ALL)"""
    out["confusion_matrix"] = with_(SMALL, test, cut("tst"), conf) + " UNION ALL ".join(
        f"SELECT split, method, '{c}' AS cell, {big(c)} AS n, {r(f'{c} / CAST(tn + fp + fn + tp AS DOUBLE)')} AS share FROM cf" for c in ("tn", "fp", "fn", "tp")
    )
    pairwise = """ra AS (SELECT a.split, a.method, avg(CASE WHEN a.prob > b.prob THEN 1 WHEN a.prob = b.prob THEN 0.5 ELSE 0 END) AS auc
  FROM small a JOIN small b ON a.split = b.split AND a.method = b.method WHERE a.label = 1 AND b.label = 0 GROUP BY ALL),
mt AS (SELECT split, method, CAST(tn AS DOUBLE) AS tn, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tp AS DOUBLE) AS tp, auc FROM cf JOIN ra USING (split, method))"""
    nan = "CAST('nan' AS DOUBLE)"

    def ratio(a: str, b: str) -> str:
        return f"CASE WHEN {b} = 0 THEN {nan} ELSE {a} / ({b}) END"

    rec, pre, spe = ratio("tp", "(tp + fn)"), ratio("tp", "(tp + fp)"), ratio("tn", "(tn + fp)")
    metrics = {
        "accuracy": "(tp + tn) / (tp + tn + fp + fn)", "f1_score": ratio("2 * tp", "(2 * tp + fp + fn)"), "recall": rec, "precision": pre, "auc": "auc",
        "sensitivity": rec, "specificity": spe, "positive_prediction": pre, "negative_prediction": ratio("tn", "(tn + fn)"),
        "positive_llr": f"CASE WHEN fp = 0 OR fp + tn = 0 THEN {nan} ELSE tp / (tp + fn) / (fp / (fp + tn)) END",
        "negative_llr": f"CASE WHEN tn = 0 OR fp + tn = 0 THEN {nan} ELSE fn / (tp + fn) / (tn / (fp + tn)) END",
    }
    out["metrics_report"] = with_(SMALL, test, cut("tst"), conf, pairwise) + " UNION ALL ".join(
        f"SELECT split, method, '{m}' AS metric, {r(e)} AS value FROM mt" for m, e in metrics.items()
    )
    out["calibration_curve"] = with_(PRED) + (
        f"SELECT method, CAST(least(greatest(ceil(prob * 10) - 1, 0), 9) AS INTEGER) AS bin, {r('avg(label)')} AS prob_true, {r('avg(prob)')} AS prob_pred FROM pred GROUP BY ALL"
    )
    dc = """ct AS (SELECT method, prob, sum(label) AS pos, sum(1 - label) AS neg FROM pred GROUP BY ALL),
dc AS (SELECT method, i / CAST(100 AS DOUBLE) AS t, sum(CASE WHEN prob > i / CAST(100 AS DOUBLE) THEN pos ELSE 0 END) AS tp, sum(CASE WHEN prob > i / CAST(100 AS DOUBLE) THEN neg ELSE 0 END) AS fp,
  CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(pos + neg) AS DOUBLE) AS n FROM ct CROSS JOIN range(100) g(i) GROUP BY method, i)"""
    for name, every in (("decision_curve", "tp / n - (1 - fp / n) * t / (1 - t)"), ("decision_curve_standard", "p / n - (1 - p / n) * t / (1 - t)")):
        out[name] = with_(PRED, dc) + (
            f"SELECT method, t, {r('tp / n - fp / n * t / (1 - t)')} AS net_benefit, {r(every)} AS treat_all, CAST(0 AS DOUBLE) AS treat_none FROM dc"
        )
    out["pr_curve"] = with_(PRED, curve) + (
        f"SELECT method, {r('prob')} AS threshold, {r('tp / CAST(tp + fp AS DOUBLE)')} AS precision, {r('tp / CAST(p AS DOUBLE)')} AS recall FROM cu"
    )
    out["average_precision"] = with_(PRED, curve) + (
        f"SELECT method, {r('sum(pos / CAST(p AS DOUBLE) * tp / (tp + fp))')} AS average_precision FROM cu GROUP BY method"
    )
    p = "least(greatest(prob, 1e-15), 1 - 1e-15)"
    out["log_loss"] = with_(PRED) + f"SELECT method, {r(f'avg(-CASE WHEN label = 1 THEN ln({p}) ELSE ln(1 - {p}) END)')} AS log_loss FROM pred GROUP BY method"
    out["run_summary"] = with_(WIDE, split_sql("wide_rows"), PRED, curve, roc, area) + """SELECT 'classes' AS section, coalesce(split, 'data') AS key,
  'total=' || CAST(count(*) AS VARCHAR) || ', positive=' || CAST(sum(label) AS VARCHAR) || ', negative=' || CAST(sum(1 - label) AS VARCHAR) AS value FROM sp GROUP BY ROLLUP (split)
UNION ALL SELECT 'best', (SELECT method FROM au ORDER BY auc DESC, method LIMIT 1), 'rank=1'"""
    return out


def sql() -> dict[str, str]:
    """All texts by query name."""
    return {**_prepare(), **_features(), **_frame(), **_scores(), **_evaluation()}
