"""The registered mesh queries, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions import colour, vec3
from meshloom.operators import graph, metrics, nearest, planes, topology
from meshloom.sources import derived
from meshloom.sources.store import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with SQL over the common table expressions of ``derived``."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {derived.SQL.strip()}\n{sql.strip()}" if sql.strip()[0] == "," else f"WITH {derived.SQL.strip()}\n{sql.strip()}"
        return f

    return register


def r6(c, name: str):
    """Six decimals, never a negative zero."""
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0).alias(name)


V, FACES, SOUP, SAMPLES = derived.tube_vertices, derived.tube_faces, derived.soup, derived.samples


# joins and topology


@query("SELECT fid, round(ax,6)+0 AS ax, round(ay,6)+0 AS ay, round(az,6)+0 AS az, round(bx,6)+0 AS bx, round(by_,6)+0 AS by, round(bz,6)+0 AS bz, round(cx,6)+0 AS cx, round(cy,6)+0 AS cy, round(cz,6)+0 AS cz FROM p")
def face_vertex_join(spark, d):
    p = topology.with_corners(FACES(spark, d), V(spark, d))
    return p.select("fid", *(r6(f"{k}{x}", f"{k}{x}") for k in "abc" for x in "xyz"))


@query("SELECT DISTINCT least(u,w) AS u, greatest(u,w) AS w FROM (SELECT a u, b w FROM soup UNION ALL SELECT b, c FROM soup UNION ALL SELECT c, a FROM soup)")
def unique_edges(spark, d):
    return topology.half_edges(SOUP(spark, d)).distinct()


@query("SELECT least(u,w) AS u, greatest(u,w) AS w, count(*) AS inc FROM (SELECT a u, b w FROM soup UNION ALL SELECT b, c FROM soup UNION ALL SELECT c, a FROM soup) GROUP BY ALL")
def edge_incidence(spark, d):
    return topology.edge_incidence(SOUP(spark, d))


@query("SELECT least(u,w) AS u, greatest(u,w) AS w, count(*) AS inc FROM (SELECT a u, b w FROM soup UNION ALL SELECT b, c FROM soup UNION ALL SELECT c, a FROM soup) GROUP BY ALL HAVING count(*) > 2")
def nonmanifold_edges(spark, d):
    return topology.edge_incidence(SOUP(spark, d)).filter("inc > 2")


@query("SELECT u, w FROM edge WHERE inc = 1")
def boundary_edges(spark, d):
    return topology.boundary_edges(FACES(spark, d))


@query("SELECT count(*) AS n_edges, count(*) FILTER (inc = 1) AS n_boundary, max(inc)::BIGINT AS max_incidence, bool_and(inc = 2) AS is_watertight FROM edge")
def watertight(spark, d):
    e = topology.edge_incidence(FACES(spark, d))
    return e.agg(F.count("*").alias("n_edges"), F.count_if(F.col("inc") == 1).alias("n_boundary"), F.max("inc").alias("max_incidence"), F.every(F.col("inc") == 2).alias("is_watertight"))


@query("SELECT u, w, round(len,6) AS len FROM len")
def edge_lengths(spark, d):
    v = V(spark, d)
    return topology.with_lengths(topology.edge_incidence(FACES(spark, d)), v).select("u", "w", r6("len", "len"))


@query("SELECT u AS vid, count(*) AS degree FROM (SELECT DISTINCT u, w FROM (SELECT a u, b w FROM soup UNION ALL SELECT b, a FROM soup UNION ALL SELECT b, c FROM soup UNION ALL SELECT c, b FROM soup UNION ALL SELECT c, a FROM soup UNION ALL SELECT a, c FROM soup) WHERE u <> w) GROUP BY u")
def vertex_degree(spark, d):
    edges = topology.edge_incidence(SOUP(spark, d)).filter("u <> w")
    return topology.both_ways(edges).groupBy(F.col("u").alias("vid")).agg(F.count("*").alias("degree"))


@query("SELECT DISTINCT s[1] AS a, s[2] AS b, s[3] AS c FROM (SELECT list_sort([a,b,c]) AS s FROM soup)")
def dedupe_faces(spark, d):
    return topology.distinct_faces(SOUP(spark, d))


@query("""SELECT s.a, s.b, s.c, count(*) AS n FROM soup s JOIN v p ON p.vid=s.a JOIN v q ON q.vid=s.b JOIN v r ON r.vid=s.c
WHERE a<>b AND b<>c AND c<>a AND 0.5*sqrt(pow((q.y-p.y)*(r.z-p.z)-(q.z-p.z)*(r.y-p.y),2)+pow((q.z-p.z)*(r.x-p.x)-(q.x-p.x)*(r.z-p.z),2)+pow((q.x-p.x)*(r.y-p.y)-(q.y-p.y)*(r.x-p.x),2)) > 1e-14 GROUP BY ALL""")
def drop_degenerate(spark, d):
    # equal corner triples have equal areas, so each is measured once
    once = SOUP(spark, d).groupBy("a", "b", "c").agg(F.count("*").alias("n")).filter(~topology.is_degenerate())
    return metrics.with_area(once, V(spark, d)).filter("area > 1e-14").select("a", "b", "c", "n")


@query("""SELECT l_orderkey*8+l_linenumber AS fid, (k-3)::BIGINT AS part, l[1] AS a, l[k-1] AS b, l[k] AS c FROM (
SELECT l_orderkey, l_linenumber, list_slice([l_partkey, l_suppkey, l_orderkey, l_partkey+1, l_suppkey+1], 1, 1 + l_linenumber % 5) AS l FROM lineitem), range(3, 6) t(k) WHERE k <= len(l)""")
def fan_triangulate(spark, d):
    rows = derived.read(spark, d, "lineitem")
    corners = F.array("l_partkey", "l_suppkey", "l_orderkey", F.col("l_partkey") + 1, F.col("l_suppkey") + 1)
    polygons = rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fid"), F.slice(corners, F.lit(1), 1 + F.col("l_linenumber") % 5).alias("idx"))
    return topology.fan_triangles(polygons)


_DOUBLED = """, w AS (SELECT vid, x, y, z FROM v UNION ALL SELECT vid + (SELECT n FROM n), x, y, z FROM v WHERE vid % 3 = 0)"""


def _doubled(spark, d):
    v = V(spark, d)
    n = v.agg(F.count("*").alias("n"))
    return v.unionByName(v.filter("vid % 3 = 0").join(F.broadcast(n)).select((F.col("vid") + F.col("n")).alias("vid"), *("xyz")))


@query(_DOUBLED + " SELECT w.vid, min(o.vid) AS kept FROM w JOIN w o USING (x, y, z) GROUP BY w.vid")
def merge_points(spark, d):
    return topology.merged_points(_doubled(spark, d))


@query("SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS new_vid FROM v WHERE vid IN (SELECT unnest([a,b,c]) FROM f WHERE fid % 7 = 0)")
def drop_unreferenced(spark, d):
    some = FACES(spark, d).filter("fid % 7 = 0")
    return topology.renumbered(topology.referenced(V(spark, d), some)).select("vid", "new_vid")


_RENUMBERED = ", kept AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS new FROM v WHERE vid % 5 <> 0)"


@query(_RENUMBERED + " SELECT fid, i.new AS a, j.new AS b, k.new AS c FROM f JOIN kept i ON i.vid=a JOIN kept j ON j.vid=b JOIN kept k ON k.vid=c")
def reindex_faces(spark, d):
    kept = topology.renumbered(V(spark, d).filter("vid % 5 <> 0"))
    return topology.remapped(FACES(spark, d), kept, "vid", "new_vid")


# overlap: the cut is the part of the surface with z in the middle third


_CUT = """, lim AS (SELECT min(z)+(max(z)-min(z))/3 AS lo, max(z)-(max(z)-min(z))/3 AS hi FROM v),
cut AS (SELECT vid, x::FLOAT AS fx, y::FLOAT AS fy, z::FLOAT AS fz FROM v, lim WHERE z BETWEEN lo AND hi),
left_ AS (SELECT vid FROM v WHERE NOT EXISTS (SELECT 1 FROM cut WHERE fx = x::FLOAT AND fy = y::FLOAT AND fz = z::FLOAT)),
num AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS new FROM left_)"""


def _cut(spark, d):
    v = V(spark, d)
    lim = v.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    third = (F.col("hi") - F.col("lo")) / 3
    return v.join(F.broadcast(lim)).filter(F.col("z").between(F.col("lo") + third, F.col("hi") - third)).select("vid", *("xyz"))


@query(_CUT + " SELECT vid FROM left_")
def overlap_remove_vertices(spark, d):
    return topology.without_overlap(V(spark, d), _cut(spark, d)).select("vid")


@query(_CUT + " SELECT fid FROM f WHERE a IN (SELECT vid FROM left_) AND b IN (SELECT vid FROM left_) AND c IN (SELECT vid FROM left_)")
def overlap_keep_faces(spark, d):
    return topology.faces_of_kept(FACES(spark, d), topology.without_overlap(V(spark, d), _cut(spark, d))).select("fid")


@query(_CUT + " SELECT fid, i.new AS a, j.new AS b, k.new AS c FROM f JOIN num i ON i.vid=a JOIN num j ON j.vid=b JOIN num k ON k.vid=c")
def overlap_subtract(spark, d):
    kept = topology.renumbered(topology.without_overlap(V(spark, d), _cut(spark, d)))
    return topology.remapped(topology.faces_of_kept(FACES(spark, d), kept), kept, "vid", "new_vid")


@query(_CUT + " SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM left_) AS n_kept, (SELECT count(*) FROM v) - (SELECT count(*) FROM left_) AS n_removed, (SELECT count(*) FROM f) - (SELECT count(*) FROM f WHERE a IN (SELECT vid FROM left_) AND b IN (SELECT vid FROM left_) AND c IN (SELECT vid FROM left_)) AS n_faces_dropped")
def overlap_stats(spark, d):
    v, f = V(spark, d), FACES(spark, d)
    kept = topology.without_overlap(v, _cut(spark, d))
    one = v.agg(F.count("*").alias("n_vertices")).join(kept.agg(F.count("*").alias("n_kept")))
    faces = f.agg(F.count("*").alias("n")).join(topology.faces_of_kept(f, kept).agg(F.count("*").alias("m")))
    return one.join(faces).select("n_vertices", "n_kept", (F.col("n_vertices") - F.col("n_kept")).alias("n_removed"), (F.col("n") - F.col("m")).alias("n_faces_dropped"))


# measures


@query("SELECT " + ", ".join(f"round({g}({k}),6)+0 AS {g}_{k}" for g in ("min", "max") for k in "xyz") + ", round(sqrt(pow(max(x)-min(x),2)+pow(max(y)-min(y),2)+pow(max(z)-min(z),2)),6) AS diag, " + ", ".join(f"round((min({k})+max({k}))/2,6)+0 AS centre_{k}" for k in "xyz") + " FROM v")
def mesh_bounds(spark, d):
    b = metrics.bounds(V(spark, d))
    return b.select(*(r6(c, c) for c in b.columns))


@query("SELECT round(avg(x),6)+0 AS x, round(avg(y),6)+0 AS y, round(avg(z),6)+0 AS z FROM v")
def vertex_centroid(spark, d):
    return V(spark, d).agg(*(F.avg(k).alias(k) for k in "xyz")).select(*(r6(k, k) for k in "xyz"))


_CENTRE = ", ctr AS (SELECT (min(x)+max(x))/2 AS rx, (min(y)+max(y))/2 AS ry, (min(z)+max(z))/2 AS rz FROM v)"
_TETS = _CENTRE + """, q AS (SELECT ax-rx AS ax, ay-ry AS ay, az-rz AS az, bx-rx AS bx, by_-ry AS by_, bz-rz AS bz, cx-rx AS cx, cy-ry AS cy, cz-rz AS cz, rx, ry, rz FROM p, ctr),
tet AS (SELECT *, (ax*(by_*cz-bz*cy)+ay*(bz*cx-bx*cz)+az*(bx*cy-by_*cx))/6 AS vol FROM q),
vc AS (SELECT sum(vol) AS volume, sum(vol*(rx+(ax+bx+cx)/4))/sum(vol) AS centroid_x, sum(vol*(ry+(ay+by_+cy)/4))/sum(vol) AS centroid_y, sum(vol*(rz+(az+bz+cz)/4))/sum(vol) AS centroid_z FROM tet)"""


def _centre(spark, d):
    return metrics.bounds(V(spark, d)).select(*(F.col(f"centre_{k}").alias(f"r{k}") for k in "xyz"))


@query(_TETS + " SELECT round(volume,6) AS volume, round(centroid_x,6)+0 AS centroid_x, round(centroid_y,6)+0 AS centroid_y, round(centroid_z,6)+0 AS centroid_z FROM vc")
def signed_volume(spark, d):
    v = metrics.volume_about(FACES(spark, d), V(spark, d), _centre(spark, d))
    return v.select(*(r6(c, c) for c in v.columns))


_AREA = "0.5*sqrt(pow((by_-ay)*(cz-az)-(bz-az)*(cy-ay),2)+pow((bz-az)*(cx-ax)-(bx-ax)*(cz-az),2)+pow((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax),2))"


@query(f"SELECT fid, round({_AREA},6) AS area FROM p")
def face_area(spark, d):
    return metrics.with_area(FACES(spark, d), V(spark, d)).select("fid", r6("area", "area"))


@query(f"SELECT round(sum({_AREA}),6) AS area, count(*) AS n_faces FROM p")
def surface_area(spark, d):
    return metrics.with_area(FACES(spark, d), V(spark, d)).agg(F.sum("area").alias("a"), F.count("*").alias("n_faces")).select(r6("a", "area"), "n_faces")


@query("SELECT vid, CASE WHEN hi-lo < 1e-12 THEN 0.0::DOUBLE ELSE round((z-lo)/(hi-lo),6) END AS norm FROM v, (SELECT min(z) AS lo, max(z) AS hi FROM v)")
def normalize01(spark, d):
    return metrics.normalised01(V(spark, d), "z", "norm").select("vid", r6("norm", "norm"))


@query(_CENTRE + " SELECT " + ", ".join(f"round(sum(({i}-r{i})*({j}-r{j}))/greatest(1,count(*)),6)+0 AS c{i}{j}" for i, j in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM v, ctr")
def pca_covariance(spark, d):
    c = metrics.covariance(V(spark, d), _centre(spark, d))
    return c.select(*(r6(k, k) for k in c.columns))


@query(f"SELECT vid, round(greatest(coalesce(m, 0), 1e-18::DOUBLE),6) AS mass FROM v LEFT JOIN (SELECT vid, sum(area)/3 AS m FROM (SELECT unnest([a,b,c]) AS vid, {_AREA} AS area FROM p) GROUP BY vid) USING (vid)")
def lumped_mass(spark, d):
    return metrics.lumped_mass(FACES(spark, d), V(spark, d)).select("vid", r6("mass", "mass"))


_NORM = "sqrt(pow((by_-ay)*(cz-az)-(bz-az)*(cy-ay),2)+pow((bz-az)*(cx-ax)-(bx-ax)*(cz-az),2)+pow((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax),2))"
_COT = f""", w AS (SELECT a, b, c, ((bx-ax)*(cx-ax)+(by_-ay)*(cy-ay)+(bz-az)*(cz-az))/greatest({_NORM},1e-18)/2 AS wa,
  ((cx-bx)*(ax-bx)+(cy-by_)*(ay-by_)+(cz-bz)*(az-bz))/greatest({_NORM},1e-18)/2 AS wb, ((ax-cx)*(bx-cx)+(ay-cy)*(by_-cy)+(az-cz)*(bz-cz))/greatest({_NORM},1e-18)/2 AS wc FROM p),
side AS (SELECT b AS i, c AS j, wa AS w FROM w UNION ALL SELECT c, a, wb FROM w UNION ALL SELECT a, b, wc FROM w),
coo AS (SELECT i, j, sum(val) AS val FROM (SELECT i, j, -w AS val FROM side UNION ALL SELECT j, i, -w FROM side UNION ALL SELECT i, i, w FROM side UNION ALL SELECT j, j, w FROM side) GROUP BY i, j)"""


@query(_COT + " SELECT i, j, round(val,6)+0 AS val FROM coo")
def cotan_laplacian(spark, d):
    return metrics.cotan_laplacian(FACES(spark, d), V(spark, d)).select("i", "j", r6("val", "val"))


@query("""SELECT fid, round(mx,6)+0 AS from_x, round(my,6)+0 AS from_y, round(mz,6)+0 AS from_z, round(mx+ex/l*size,6)+0 AS to_x, round(my+ey/l*size,6)+0 AS to_y, round(mz+ez/l*size,6)+0 AS to_z FROM (
SELECT fid, (ax+bx+cx)/3 AS mx, (ay+by_+cy)/3 AS my, (az+bz+cz)/3 AS mz, bx-ax AS ex, by_-ay AS ey, bz-az AS ez, sqrt(pow(bx-ax,2)+pow(by_-ay,2)+pow(bz-az,2)) AS l,
(SELECT sqrt(pow(max(x)-min(x),2)+pow(max(y)-min(y),2)+pow(max(z)-min(z),2)) FROM v)*0.05*least(greatest(pow(1000.0/(SELECT count(*) FROM f),1/3::DOUBLE),0.15),2) AS size FROM p) WHERE l > 1e-12""")
def face_tangents(spark, d):
    t = metrics.face_tangents(FACES(spark, d), V(spark, d))
    return t.select("fid", *(r6(c, c) for c in t.columns[1:]))


@query("SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM f) AS n_faces, format('{} vertices, {} faces, triangle mesh', (SELECT count(*) FROM v), (SELECT count(*) FROM f)) AS summary")
def mesh_summary(spark, d):
    one = V(spark, d).agg(F.count("*").alias("n_vertices")).join(FACES(spark, d).agg(F.count("*").alias("n_faces")))
    return one.select("n_vertices", "n_faces", F.format_string("%d vertices, %d faces, triangle mesh", "n_vertices", "n_faces").alias("summary"))


@query("SELECT count(*) AS n_vertices, (SELECT count(*) FROM f) AS n_faces, count(*) FILTER (isnan(x) OR isnan(y) OR isnan(z) OR isinf(x) OR isinf(y) OR isinf(z)) AS n_not_finite, (SELECT count(*) FROM f WHERE least(a,b,c) < 0 OR greatest(a,b,c) >= (SELECT n FROM n)) AS n_bad_faces FROM v")
def mesh_gate(spark, d):
    v, f = V(spark, d), FACES(spark, d)
    odd = F.lit(False)
    for k in "xyz":
        odd = odd | F.isnan(k) | (F.abs(k) == float("inf"))
    n = v.agg(F.count("*").alias("n_vertices"), F.count_if(odd).alias("n_not_finite"))
    bad = f.join(F.broadcast(n)).agg(F.count("*").alias("n_faces"), F.count_if((F.least("a", "b", "c") < 0) | (F.greatest("a", "b", "c") >= F.col("n_vertices"))).alias("n_bad_faces"))
    return n.join(bad).select("n_vertices", "n_faces", "n_not_finite", "n_bad_faces")


# scale


@query("SELECT vid, " + ", ".join(f"round((({k}::FLOAT)::DOUBLE*2.5)::FLOAT::DOUBLE,4)+0 AS {k}" for k in "xyz") + " FROM v")
def mesh_scale(spark, d):
    return metrics.scaled(V(spark, d), metrics.scale_factor(40.0, 100.0)).select("vid", *((F.round(F.col(k).cast("double"), 4) + 0.0).alias(k) for k in "xyz"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice/l_quantity AS factor FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0")
def scale_calibrate(spark, d):
    rows = derived.read(spark, d, "lineitem").filter("l_quantity > 0 and l_extendedprice > 0")
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), metrics.scale_factors(F.col("l_quantity"), F.col("l_extendedprice")).alias("factor"))


# per-row expressions of the sampler and of colours


_STEP = "(CASE WHEN {x} <= {lo} THEN 0.0::DOUBLE WHEN {x} >= {hi} THEN 1.0::DOUBLE ELSE pow(({x}-{lo})/({hi}-{lo}),2)*(3-2*({x}-{lo})/({hi}-{lo})) END)"
_W = f"({_STEP.format(x='t', lo=0.1, hi=0.3)}*{_STEP.format(x='(1-t)', lo=0.1, hi=0.3)})".replace("0.1", "0.1::DOUBLE").replace("0.3", "(0.1::DOUBLE+0.2::DOUBLE)")


@query(f"SELECT sid, round({_STEP.format(x='t', lo='0.25::DOUBLE', hi='0.75::DOUBLE')},6) AS s FROM samples")
def smoothstep(spark, d):
    return SAMPLES(spark, d).select("sid", r6(metrics.smoothstep(0.25, 0.75, F.col("t")), "s"))


@query(f"SELECT sid, round({_W},6) AS w FROM samples")
def sample_weight(spark, d):
    return SAMPLES(spark, d).select("sid", r6(metrics.sample_weight(F.col("t"), 0.1, 0.2), "w"))


@query(f"SELECT sid, round(least(greatest(2.0::DOUBLE/sqrt(least(greatest({_W},0.001::DOUBLE),1)),2),12),6) AS radius FROM samples")
def poisson_radius(spark, d):
    w = metrics.sample_weight(F.col("t"), 0.1, 0.2)
    return SAMPLES(spark, d).select("sid", r6(metrics.poisson_radius(w, 2.0, 6.0, 0.001), "radius"))


@query("SELECT sid, t FROM samples WHERE t BETWEEN 0.1::DOUBLE AND 0.9::DOUBLE AND NOT isnan(t)")
def t_filter(spark, d):
    return SAMPLES(spark, d).filter(F.col("t").between(0.1, 0.9) & ~F.isnan("t")).select("sid", "t")


@query(f"SELECT sid, round({_W},6) AS w, row_number() OVER (ORDER BY round({_W},6) DESC, sid, r, g, b) - 1 AS place FROM samples")
def candidate_order(spark, d):
    rows = SAMPLES(spark, d).withColumn("w", r6(metrics.sample_weight(F.col("t"), 0.1, 0.2), "w"))
    return topology.numbered_along(rows, [-F.col("w"), *map(F.col, ("sid", "r", "g", "b"))], "place").select("sid", "w", "place")


@query("SELECT sid, round(r*255/255,6) AS r, round(g*255/255,6) AS g, round(b*255/255,6) AS b FROM samples")
def color_normalize(spark, d):
    bytes_ = SAMPLES(spark, d).select("sid", *((F.col(c) * 255).alias(c) for c in "rgb"))
    return colour.normalised(bytes_).select("sid", *(r6(c, c) for c in "rgb"))


@query("SELECT sid, " + ", ".join(f"least(greatest(round_even({c}*255,0),0),255)::BIGINT AS {c}" for c in "rgb") + " FROM samples")
def color_rgb_u8(spark, d):
    return SAMPLES(spark, d).select("sid", *(colour.to_byte(F.col(c)).alias(c) for c in "rgb"))


@query("SELECT sid, least(greatest(round_even(r*255,0),0),255)::BIGINT AS r, least(greatest(round_even(g*255,0),0),255)::BIGINT AS g, least(greatest(round_even(b*255,0),0),255)::BIGINT AS b, CASE WHEN (SELECT min(least(greatest(round_even(alpha*255,0),0),255)) FROM samples) = 255 THEN NULL ELSE least(greatest(round_even(alpha*255,0),0),255)::BIGINT END AS alpha FROM samples")
def color_to_u8(spark, d):
    rows = SAMPLES(spark, d).select("sid", *(colour.to_byte(F.col(c)).alias(c) for c in ("r", "g", "b", "alpha")))
    opaque = rows.agg((F.min("alpha") == 255).alias("opaque"))
    return rows.join(F.broadcast(opaque)).select("sid", "r", "g", "b", F.when(~F.col("opaque"), F.col("alpha")).alias("alpha"))


_HSV = """, u AS (SELECT sid, least(greatest(round_even(r*255,0),0),255)/255.0::DOUBLE AS r, least(greatest(round_even(g*255,0),0),255)/255.0::DOUBLE AS g, least(greatest(round_even(b*255,0),0),255)/255.0::DOUBLE AS b FROM samples),
h1 AS (SELECT *, greatest(r,g,b) AS hi, greatest(r,g,b)-least(r,g,b) AS dl FROM u),
h2 AS (SELECT *, CASE WHEN dl = 0 THEN 0.0::DOUBLE WHEN b = hi THEN (4+(r-g)/dl)/6 WHEN g = hi THEN (2+(b-r)/dl)/6 ELSE (g-b)/dl/6 END AS hh FROM h1),
hsv AS (SELECT sid, hh-floor(hh) AS h, CASE WHEN hi = 0 THEN 0.0::DOUBLE ELSE dl/hi END AS s, hi AS v FROM h2)"""


def _hsv(spark, d):
    u = SAMPLES(spark, d).select("sid", *((colour.to_byte(F.col(c)) / 255.0).alias(c) for c in "rgb"))
    h, s, v = colour.hsv(F.col("r"), F.col("g"), F.col("b"))
    return u.select("sid", h.alias("h"), s.alias("s"), v.alias("v"))


@query(_HSV + " SELECT sid, round(h,6) AS h, round(s,6) AS s, round(v,6) AS v FROM hsv")
def rgb_to_hsv(spark, d):
    return _hsv(spark, d).select("sid", r6("h", "h"), r6("s", "s"), r6("v", "v"))


@query(_HSV + " SELECT sid, NOT (round(h,9) <= 0.125 AND round(s,9) >= 0.25) AS selected FROM hsv")
def hsv_select(spark, d):
    return _hsv(spark, d).select("sid", (~colour.red_like(F.round("h", 9), F.round("s", 9))).alias("selected"))


@query(_HSV + """, vc AS (SELECT vid, h, s FROM (SELECT sid % (SELECT n FROM n) AS vid, round(h,9) AS h, round(s,9) AS s, row_number() OVER (PARTITION BY sid % (SELECT n FROM n) ORDER BY sid, round(h,9), round(s,9)) AS k FROM hsv) WHERE k = 1), ok AS (SELECT vid FROM v WHERE vid NOT IN (SELECT vid FROM vc WHERE round(h,9) <= 0.125 AND round(s,9) >= 0.25))
 SELECT fid FROM f WHERE a IN (SELECT vid FROM ok) AND b IN (SELECT vid FROM ok) AND c IN (SELECT vid FROM ok)""")
def color_cut_surface(spark, d):
    v = V(spark, d)
    n = v.agg(F.count("*").alias("n"))
    painted = _hsv(spark, d).join(F.broadcast(n)).groupBy((F.col("sid") % F.col("n")).alias("vid")).agg(F.min(F.struct("sid", F.round("h", 9).alias("h"), F.round("s", 9).alias("s"))).alias("c"))
    red = painted.filter(colour.red_like(F.col("c.h"), F.col("c.s"))).select("vid")
    return topology.faces_of_kept(FACES(spark, d), v.join(red, "vid", "left_anti")).select("fid")


# planes; the plane is given, so that both sides agree on it


_PLANE = """, pl AS (SELECT 0.6::DOUBLE AS mx, 0.0::DOUBLE AS my, 0.8::DOUBLE AS mz, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, 0.05::DOUBLE * sqrt(pow(max(x)-min(x),2)+pow(max(y)-min(y),2)+pow(max(z)-min(z),2)) AS ep FROM v),
sd AS (SELECT vid, x, y, z, mx*x+my*y+mz*z - (mx*cx+my*cy+mz*cz) AS s, ep FROM v, pl), band AS (SELECT vid, x, y, z FROM sd WHERE abs(s) <= ep)"""


def _plane(spark, d):
    v = V(spark, d)
    extent = vec3.norm(tuple(F.max(k) - F.min(k) for k in "xyz"))
    return v.agg(*(F.avg(k).alias(f"c{k}") for k in "xyz"), (0.05 * extent).alias("ep")).select("*", F.lit(0.6).alias("mx"), F.lit(0.0).alias("my"), F.lit(0.8).alias("mz"))


@query(_PLANE + " SELECT vid, round(s,6)+0 AS s FROM sd")
def plane_signed_dist(spark, d):
    return planes.signed_distances(V(spark, d), _plane(spark, d)).select("vid", r6("s", "s"))


@query(_PLANE + " SELECT vid FROM band")
def plane_band(spark, d):
    return planes.band(planes.signed_distances(V(spark, d), _plane(spark, d)))


@query(_PLANE + " SELECT arg_min(vid, (abs(s), vid)) AS vid FROM sd")
def plane_band_fallback(spark, d):
    return planes.band(planes.signed_distances(V(spark, d), _plane(spark, d).withColumn("ep", F.lit(-1.0))))


@query(_PLANE + " SELECT sd.vid, round(min(sqrt(pow(sd.x-band.x,2)+pow(sd.y-band.y,2)+pow(sd.z-band.z,2))),6) AS d FROM sd, band GROUP BY sd.vid")
def euclid_to_band(spark, d):
    v = V(spark, d).select(F.col("vid").alias("id"), *("xyz"))
    in_band = plane_band(spark, d).withColumnRenamed("vid", "id")
    return nearest.nearest(v, v.join(in_band, "id", "left_semi")).select(F.col("id").alias("vid"), r6("d", "d"))


_SP = """, sym AS (SELECT u, w, len FROM len UNION ALL SELECT w, u, len FROM len)"""
_GEO = """, r(vid, d) USING KEY (vid) AS (SELECT vid, 0.0::DOUBLE FROM band UNION SELECT s.w, min(r.d+s.len) FROM r JOIN sym s ON s.u=r.vid LEFT JOIN recurring.r o ON o.vid=s.w WHERE o.d IS NULL OR r.d+s.len<o.d GROUP BY s.w)"""


def _edges(spark, d):
    return topology.with_lengths(topology.edge_incidence(FACES(spark, d)), V(spark, d))


@query(_PLANE + _SP + _GEO + " SELECT vid, round(d,6) AS d FROM r")
def geodesic_to_band(spark, d):
    return graph.distances(_edges(spark, d), plane_band(spark, d), V(spark, d)).select("vid", r6("d", "d"))


_SIGNED = _PLANE + _SP + _GEO + """, q AS (SELECT sd.vid, sd.x, sd.y, sd.z, (d-lo)/(hi-lo) * CASE WHEN s < 0 THEN -1 ELSE 1 END AS quality FROM sd JOIN r USING (vid), (SELECT min(d) AS lo, max(d) AS hi FROM r))"""


def _quality(spark, d):
    return planes.quality(V(spark, d), FACES(spark, d), _plane(spark, d))


@query(_SIGNED + " SELECT vid, round(quality,6)+0 AS quality FROM q")
def signed_quality(spark, d):
    return _quality(spark, d).select("vid", r6("quality", "quality"))


@query(_SIGNED + " SELECT vid FROM q WHERE round(quality,9) BETWEEN -0.75 AND 0.75")
def quality_mask(spark, d):
    return _quality(spark, d).filter(F.round("quality", 9).between(-0.75, 0.75)).select("vid")


@query(_SIGNED + " SELECT count(*) FILTER (NOT round(quality,9) BETWEEN -0.75 AND 0.75) AS n_transverse, count(*) FILTER (NOT round(quality,9) BETWEEN -1.0 AND 0.2) AS n_longitudinal, count(*) FILTER (NOT (round(quality,9) BETWEEN -0.75 AND 0.75 AND round(quality,9) BETWEEN -1.0 AND 0.2)) AS n_any FROM q")
def mask_failures(spark, d):
    q = _quality(spark, d).withColumn("quality", F.round("quality", 9))
    q = q.withColumns({f"quality_{m}": F.col("quality") for m in ("transverse", "longitudinal")})
    fails = {m: ~planes.within_bounds([m]) for m in ("transverse", "longitudinal")}
    return q.agg(*(F.count_if(c).alias(f"n_{m}") for m, c in fails.items()), F.count_if(fails["transverse"] | fails["longitudinal"]).alias("n_any"))


@query(_SIGNED + """, ok AS (SELECT vid FROM q WHERE round(quality,9) BETWEEN -0.75 AND 0.75) SELECT fid FROM f WHERE a IN (SELECT vid FROM ok) AND b IN (SELECT vid FROM ok) AND c IN (SELECT vid FROM ok)""")
def mask_cells(spark, d):
    return topology.faces_of_kept(FACES(spark, d), quality_mask(spark, d)).select("fid")


@query(_SIGNED + """, ok AS (SELECT vid FROM q WHERE round(quality,9) BETWEEN -0.75 AND 0.75),
 kf AS (SELECT * FROM f WHERE a IN (SELECT vid FROM ok) AND b IN (SELECT vid FROM ok) AND c IN (SELECT vid FROM ok)),
 num AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS new FROM ok WHERE vid IN (SELECT unnest([a,b,c]) FROM kf))
 SELECT fid, i.new AS a, j.new AS b, k.new AS c FROM kf JOIN num i ON i.vid=a JOIN num j ON j.vid=b JOIN num k ON k.vid=c""")
def quality_masked_surface(spark, d):
    v = materialise(V(spark, d).join(_quality(spark, d).select("vid", F.round("quality", 9).alias("quality_transverse")), "vid"), "quality")
    return planes.masked_surface(v, FACES(spark, d), planes.within_bounds(["transverse"]))[1]


@query(_SIGNED + " SELECT count(*) AS n, round(min(quality),6) AS least, round(max(quality),6) AS most, count(*) FILTER (quality < 0) AS n_negative FROM q")
def quality_stats(spark, d):
    q = _quality(spark, d)
    return q.agg(F.count("*").alias("n"), F.min("quality").alias("lo"), F.max("quality").alias("hi"), F.count_if(F.col("quality") < 0).alias("n_negative")).select("n", r6("lo", "least"), r6("hi", "most"), "n_negative")


# the strip: only every other ring keeps its faces, so parts are not reached
_PARTS = """, g AS (SELECT * FROM f WHERE (a // 20) % 3 <> 2), ge AS (SELECT DISTINCT least(u,w) AS u, greatest(u,w) AS w FROM (SELECT a u, b w FROM g UNION ALL SELECT b, c FROM g UNION ALL SELECT c, a FROM g)),
gsym AS (SELECT u, w FROM ge UNION ALL SELECT w, u FROM ge)"""
_ROOTS = _PARTS + """, r(vid, root) USING KEY (vid) AS (SELECT DISTINCT u, u FROM gsym UNION SELECT s.w, min(r.root) FROM r JOIN gsym s ON s.u=r.vid LEFT JOIN recurring.r o ON o.vid=s.w WHERE r.root<o.root GROUP BY s.w)"""


def _parts(spark, d):
    return FACES(spark, d).filter("(a div 20) % 3 <> 2")


@query(_ROOTS + " SELECT vid, root FROM r")
def connected_components(spark, d):
    g = _parts(spark, d)
    return graph.components(topology.edge_incidence(g), topology.corner_rows(g).select("vid").distinct())


@query(_ROOTS + ", fr AS (SELECT fid, root FROM g JOIN r ON r.vid = g.a) SELECT fid FROM fr WHERE root = (SELECT root FROM fr GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)")
def largest_component(spark, d):
    return graph.largest(materialise(graph.face_components(_parts(spark, d)), "parts")).select("fid")


@query(_ROOTS + ", fr AS (SELECT fid, root FROM g JOIN r ON r.vid = g.a), nn AS (SELECT root, count(*) AS n_faces FROM fr GROUP BY root) SELECT root, n_faces FROM nn WHERE n_faces < 0.9 * (SELECT max(n_faces) FROM nn)")
def small_components(spark, d):
    sizes = graph.face_components(_parts(spark, d)).groupBy("root").agg(F.count("*").alias("n_faces"))
    most = sizes.agg(F.max("n_faces").alias("most"))
    return sizes.join(F.broadcast(most)).filter("n_faces < 0.9 * most").select("root", "n_faces")


@query(_PARTS + _SP + """, src AS (SELECT vid FROM v WHERE vid < 20), gl AS (SELECT s.u, s.w, s.len FROM sym s JOIN gsym g ON g.u=s.u AND g.w=s.w),
r(vid, d) USING KEY (vid) AS (SELECT vid, 0.0::DOUBLE FROM src UNION SELECT s.w, min(r.d+s.len) FROM r JOIN gl s ON s.u=r.vid LEFT JOIN recurring.r o ON o.vid=s.w WHERE o.d IS NULL OR r.d+s.len<o.d GROUP BY s.w)
SELECT vid, round(coalesce(d, (SELECT max(d) FROM r)),6) AS d FROM v LEFT JOIN r USING (vid)""")
def clamp_unreachable(spark, d):
    v, g = V(spark, d), _parts(spark, d)
    found = graph.distances(topology.with_lengths(topology.edge_incidence(g), v), v.filter("vid < 20").select("vid"), v)
    return planes.clamped(v.select("vid").join(found.select("vid", "d"), "vid", "left"), "d").select("vid", r6("d", "d"))


@query(_SP + """, far AS (SELECT max(vid) AS t FROM v), r(vid, d) USING KEY (vid) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION SELECT s.w, min(r.d+s.len) FROM r JOIN sym s ON s.u=r.vid LEFT JOIN recurring.r o ON o.vid=s.w WHERE o.d IS NULL OR r.d+s.len<o.d GROUP BY s.w)
SELECT t AS target, round(d,6) AS length FROM r JOIN far ON vid = t""")
def geodesic_pair(spark, d):
    v = V(spark, d)
    target = v.agg(F.max("vid").alias("vid"))
    found = graph.on_shortest_path(materialise(_edges(spark, d), "edges"), v.filter("vid = 0").select("vid"), target, v)
    return found.join(F.broadcast(target), "vid").select(F.col("vid").alias("target"), r6("length", "length"))


@query(_SP + """, r(vid, src, d) USING KEY (vid, src) AS (SELECT vid, vid, 0.0::DOUBLE FROM v WHERE vid % 97 = 0 UNION SELECT s.w, r.src, min(r.d+s.len) FROM r JOIN sym s ON s.u=r.vid LEFT JOIN recurring.r o ON o.vid=s.w AND o.src=r.src WHERE o.d IS NULL OR r.d+s.len<o.d GROUP BY s.w, r.src)
SELECT vid, round(min(d),6) AS d, arg_min(src, (d, src)) AS label FROM r GROUP BY vid""")
def geodesic_label(spark, d):
    found = graph.distances(_edges(spark, d), V(spark, d).filter("vid % 97 = 0").select("vid"), V(spark, d))
    return found.select("vid", r6("d", "d"), "label")
