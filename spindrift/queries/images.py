"""Pixel tables, contours, workbooks, archives, retry waits."""

import zipfile
from io import BytesIO

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scalars as S
from ..operators import images, layout
from ..sources import tables
from .aggregates import PLANE, plane

PIXELS = "px AS (SELECT p_partkey // 64 AS item, p_partkey % 8 AS x, p_partkey // 8 % 8 AS y, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_size * 5 % 256 AS b FROM part)"


def pixels(t):
    k = F.col("p_partkey")
    return t.part.select(F.floor(k / 64).alias("item"), (k % 8).alias("x"), (F.floor(k / 8) % 8).alias("y"), (k * 37 % 256).alias("r"), (k * 91 % 256).alias("g"), (F.col("p_size") * 5 % 256).alias("b"))


LINEAR = "CASE WHEN {0} / 255.0::DOUBLE <= 0.04045 THEN {0} / 255.0::DOUBLE / 12.92 ELSE pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"


@query("F21_colour_features", f"""
WITH {PIXELS}, l AS (SELECT *, {LINEAR.format('r')} AS lr, {LINEAR.format('g')} AS lg, {LINEAR.format('b')} AS lb, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM px),
z AS (SELECT *, (lr * 0.4124564 + lg * 0.3575761 + lb * 0.1804375) / 0.95047 AS xx, lr * 0.2126729 + lg * 0.7151522 + lb * 0.0721750 AS yy, (lr * 0.0193339 + lg * 0.1191920 + lb * 0.9503041) / 1.08883 AS zz FROM l),
f AS (SELECT *, CASE WHEN xx > 216.0::DOUBLE / 24389 THEN cbrt(xx) ELSE (xx * 24389.0::DOUBLE / 27 + 16) / 116 END AS fx, CASE WHEN yy > 216.0::DOUBLE / 24389 THEN cbrt(yy) ELSE (yy * 24389.0::DOUBLE / 27 + 16) / 116 END AS fy, CASE WHEN zz > 216.0::DOUBLE / 24389 THEN cbrt(zz) ELSE (zz * 24389.0::DOUBLE / 27 + 16) / 116 END AS fz,
 CASE WHEN hi = lo THEN 0 WHEN hi = r THEN (((g - b) / (hi - lo)::DOUBLE) % 6 + 6) % 6 WHEN hi = g THEN (b - r) / (hi - lo)::DOUBLE + 2 ELSE (r - g) / (hi - lo)::DOUBLE + 4 END * 60 AS h, CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi::DOUBLE END AS s FROM z)
SELECT item, round(avg(500 * (fx - fy)), 5) AS a, round(avg(200 * (fy - fz)), 5) AS b, round(avg(cos(radians(h)) * s), 5) AS cx, round(avg(sin(radians(h)) * s), 5) AS cy FROM f GROUP BY item""")
def _(t):
    return images.colour_features(pixels(t)).select("item", *[F.round(c, 5).alias(c) for c in ("a", "b", "cx", "cy")])


@query("F22_image_statistics", f"""
WITH {PIXELS}, v AS (SELECT item, x, y, (0.2989 * r + 0.5870 * g + 0.1140 * b) / 255.0::DOUBLE AS v, greatest(r, g, b) / 255.0::DOUBLE AS hi, least(r, g, b) / 255.0::DOUBLE AS lo, (r - b) / 255.0::DOUBLE AS warm, (g - (r + b) / 2.0) / 255.0::DOUBLE AS green, (r - g)::DOUBLE AS rg, (r + g) / 2.0::DOUBLE - b AS yb FROM px),
l AS (SELECT c.item, n.v + s.v + e.v + w.v - 4 * c.v AS lap FROM v c JOIN v n ON n.item = c.item AND n.x = c.x AND n.y = c.y - 1 JOIN v s ON s.item = c.item AND s.x = c.x AND s.y = c.y + 1 JOIN v e ON e.item = c.item AND e.x = c.x + 1 AND e.y = c.y JOIN v w ON w.item = c.item AND w.x = c.x - 1 AND w.y = c.y),
q AS (SELECT item, var_pop(lap) AS sharpness FROM l GROUP BY item)
SELECT v.item, round(avg(hi), 6) AS brightness, round(avg((hi - lo) / (hi + 1e-6)), 6) AS saturation, round(stddev_pop(v), 6) AS contrast, round(coalesce(any_value(sharpness), 0), 6) AS sharpness, round(avg(warm), 8) AS warmth, round(sqrt(var_pop(rg) + var_pop(yb)) + 0.3 * sqrt(avg(rg) ** 2 + avg(yb) ** 2), 5) AS colourfulness, round(avg(green), 8) AS greenness FROM v LEFT JOIN q USING (item) GROUP BY v.item""")
def _(t):
    s = images.statistics(pixels(t))
    return s.select("item", *[F.round(c, {"colourfulness": 5, "warmth": 8, "greenness": 8}.get(c, 6)).alias(c) for c in ("brightness", "saturation", "contrast", "sharpness", "warmth", "colourfulness", "greenness")])


@query("F22_edge_share")
def _(t):
    return images.edge_share(pixels(t)).select("item", F.round("edges", 6).alias("edges"))


@query("V19_resampled_pixels", f"""
WITH {PIXELS}, s AS (SELECT item, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY item), c AS (SELECT i.i, j.j FROM range(5) i(i), range(3) j(j)),
o AS (SELECT item, i, j, r, g, b, (least((x + 1) * 5.0::DOUBLE / w, i + 1) - greatest(x * 5.0::DOUBLE / w, i)) AS sx, (least((y + 1) * 3.0::DOUBLE / h, j + 1) - greatest(y * 3.0::DOUBLE / h, j)) AS sy FROM px JOIN s USING (item), c)
SELECT item, CAST(i AS INT) AS x, CAST(j AS INT) AS y, round(sum(r * sx * sy) / sum(sx * sy), 6) AS r, round(sum(g * sx * sy) / sum(sx * sy), 6) AS g, round(sum(b * sx * sy) / sum(sx * sy), 6) AS b FROM o WHERE sx > 1e-9 AND sy > 1e-9 GROUP BY 1, 2, 3""")
def _(t):
    return images.resampled(pixels(t), 5, 3).select("item", "x", "y", *[F.round(c, 6).alias(c) for c in "rgb"])


@query("V19_colour_fallback")
def _(t):
    v = F.col("v")
    return images.colour_vectors(pixels(t)).select("item", F.size(v).alias("width"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(v[3], 6).alias("second_red"))


def maps(t):
    """A map of 4 x 4 vectors for every sixteen items."""
    return t.embeddings.select(F.expr("vec_id div 16").alias("image"), (F.col("vec_id") % 4).alias("x"), (F.expr("vec_id div 4") % 4).alias("y"), "embedding")


MAPS = "c AS (SELECT vec_id // 16 AS image, vec_id % 4 AS x, vec_id // 4 % 4 AS y, embedding FROM embeddings)"


@query("V20_map_pooling", f"""
WITH {MAPS}, h AS (SELECT image, (max(y) + 1) // 2 AS size FROM c GROUP BY image), e AS (SELECT image, y // size AS i, x // size AS j, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM c JOIN h USING (image) WHERE size > 0),
m AS (SELECT image, i, j, k, round(avg(v), 6) AS v FROM e WHERE i < 2 AND j < 2 GROUP BY 1, 2, 3, 4)
SELECT image, i, j, list(v ORDER BY k) AS pooled FROM m GROUP BY 1, 2, 3""")
def _(t):
    return images.pooled(maps(t), "image", "x", "y", "embedding", 2).withColumn("pooled", F.transform("pooled", lambda v: S.rounded(v, 6)))


@query("V20_upsampled_correspondence", f"""
WITH {MAPS}, a AS (SELECT p, least(greatest((p + 0.5::DOUBLE) * 4 / 8 - 0.5::DOUBLE, 0), 3) AS pos FROM range(8) r(p)),
w AS (SELECT p, c.c, greatest(0, 1 - abs(pos - c.c)) AS w FROM a, range(4) c(c) WHERE abs(pos - c.c) < 1),
e AS (SELECT image, wx.p AS px, wy.p AS py, wx.w * wy.w AS w, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM c JOIN w wx ON wx.c = x JOIN w wy ON wy.c = y),
f AS (SELECT image, px, py, k, sum(w * v) AS v FROM e GROUP BY 1, 2, 3, 4), s AS (SELECT k, v AS s FROM f WHERE image = 0 AND px = 5 AND py = 3)
SELECT image, CAST(px AS INT) AS px, CAST(py AS INT) AS py, round(sum(v * s) / (sqrt(sum(v * v)) * sqrt(sum(s * s))), 6) AS cosine FROM f JOIN s USING (k) WHERE image <> 0 GROUP BY 1, 2, 3""")
def _(t):
    up = images.upsampled(maps(t), "image", "x", "y", "embedding", 4, 4, 8)
    return layout.correspondence(up, "image", "px", "py", "feature", 0, (5, 3)).select("image", "px", "py", F.round("cosine", 6).alias("cosine"))


GRID = f"{PLANE}, g0 AS (SELECT CAST(least(floor((x + 1) / 2 * 24), 23) AS INT) AS gx, CAST(least(floor((y + 1) / 2 * 24), 23) AS INT) AS gy, count(*)::DOUBLE AS density FROM p GROUP BY 1, 2)"


def grid(t):
    cell = lambda c: F.least(F.floor((F.col(c) + 1) / 2 * 24), F.lit(23)).cast("int")
    return plane(t).groupBy(cell("x").alias("gx"), cell("y").alias("gy")).agg(F.count("*").cast("double").alias("density"))


@query("W17_contour_cells", f"""
WITH {GRID}, c AS (SELECT gx - dx AS cx, gy - dy AS cy, n, density FROM g0, (VALUES (0, 0, 0), (1, 0, 1), (1, 1, 2), (0, 1, 3)) d(dx, dy, n)),
k AS (SELECT cx, cy, coalesce(max(density) FILTER (WHERE n = 0), 0) AS v0, coalesce(max(density) FILTER (WHERE n = 1), 0) AS v1, coalesce(max(density) FILTER (WHERE n = 2), 0) AS v2, coalesce(max(density) FILTER (WHERE n = 3), 0) AS v3 FROM c GROUP BY 1, 2 HAVING cx >= 0 AND cy >= 0),
s AS (SELECT level, CAST((v0 >= level) <> (v1 >= level) AS INT) + CAST((v1 >= level) <> (v2 >= level) AS INT) + CAST((v2 >= level) <> (v3 >= level) AS INT) + CAST((v3 >= level) <> (v0 >= level) AS INT) AS e FROM k, (VALUES (2.5::DOUBLE), (7.5)) l(level))
SELECT level, CAST(sum(e // 2) AS BIGINT) AS segments FROM s WHERE e > 0 GROUP BY level""")
def _(t):
    return images.contours(grid(t), [2.5, 7.5]).groupBy("level").agg(F.count("*").alias("segments"))


@query("W17_contour_segments")
def _(t):
    return images.contours(grid(t), [2.5]).select("level", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


def _workbook(rows):
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData>" + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()


@query("S7_workbook_rows", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    rows = [("key", " name "), *((r[0], r[1]) for r in t.nation.select("n_nationkey", "n_name").collect())]
    files = t.spark.createDataFrame([("nation.xlsx", bytearray(_workbook(rows)))], "path string, content binary")
    return tables.workbooks(files).select(F.element_at("cells", "key").cast("long").alias("n_nationkey"), F.element_at("cells", "name").alias("n_name"))


@query("S10_archive_members", "SELECT 'd/' || r_name || '.txt' AS member, length(r_name) AS bytes, r_name AS text FROM region")
def _(t):
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for r in t.region.collect():
            z.writestr(f"d/{r['r_name']}.txt", r["r_name"])
    files = t.spark.createDataFrame([("a.zip", bytearray(out.getvalue()))], "path string, content binary")
    return tables.archive_members(files).select("member", F.length("content").cast("long").alias("bytes"), F.decode("content", "UTF-8").alias("text"))


@query("E8_retry_wait", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN greatest(1.0::DOUBLE, round(value / 10, 1)) ELSE 20.0::DOUBLE END AS wait FROM events")
def _(t):
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Busy. Please RETRY in  "), F.format_string("%.1f", F.round(F.col("value") / 10, 1)), F.lit("s."))).otherwise(F.lit("failed"))
    return t.events.select("event_id", S.retry_wait(said, 20.0).alias("wait"))
