"""Queries over files, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import faces, scalars
from ..functions.concepts import CONCEPTS, PROMPTS, concept_table
from ..functions.images import over_pixels
from ..sources.files import RASTER, capture_time, discover_extensions, matches_orientation, split_errors
from .tables import FILES_SQL, TIMELINE_SQL, files, table, timeline, vectors


def s1_find_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("extension", scalars.extension(F.col("path")))
    return f.filter(F.col("extension").isin(*RASTER) & matches_orientation(F.col("width"), F.col("height"), "landscape")).select("path", "extension", "width", "height")


def s2_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover_extensions(files(spark, sf_dir))


def s10_capture_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", " yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("not a date"))
    c = capture_time(text, F.col("o_orderkey").cast("double"))
    return o.select("o_orderkey", c["ts"].alias("ts"), c["source"].alias("source"))


def s12_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = spark.createDataFrame([(i, p) for i, p in enumerate(PROMPTS)], "n int, prompt string")
    return concept_table(spark).join(prompts, F.lit(True)).select("category", "ord", "key", "family", "n", F.replace("prompt", F.lit("{}"), F.col("phrase")).alias("prompt"))


def p1_normalize_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    raw = F.array(F.col("p_type"), F.concat(F.lit("  ."), F.col("p_brand")), F.lit(" "), F.lower("p_type"), F.split("p_name", " ")[0])
    return p.select("p_partkey", F.array_join(scalars.normalize_extensions(raw), ",").alias("extensions"))


def p2_resolve_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    supported = F.array(*[F.lit(x) for x in (".jpg", ".png", ".webp")])
    chosen = F.when(F.col("p_partkey") % 4 == 0, F.lit(None)).when(F.col("p_partkey") % 4 == 1, F.array(F.lit(".gif"))).otherwise(F.array(F.lit(".png"), F.lit(".gif"), F.lit(".jpg")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(scalars.resolve_extensions(supported, chosen), ",").alias("extensions"))


def p4_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    ratio = F.when(h == 0, 0.0).otherwise(w / h)
    return files(spark, sf_dir).select("path", (w * h).alias("pixels"), F.round(ratio, 6).alias("aspect_ratio"), F.round(w * h / 1e6, 6).alias("megapixels"), scalars.file_name(F.col("path")).alias("filename"), scalars.extension(F.col("path")).alias("extension"), scalars.stem(F.col("path")).alias("stem"))


def p6_blur_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timeline(spark, sf_dir)
    score = faces.blur_score(F.col("value"), F.col("value") % 97, F.col("value") % 61)
    return e.select("photo", F.round(score, 10).alias("score"), faces.blur_status(score).alias("status"))


def o3_blurry_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_blur_status(spark, sf_dir).filter("status = 'Blurry'").orderBy("score", "photo")


def p8_photo_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timeline(spark, sf_dir)
    n, area = (F.col("photo") % 7).cast("int"), F.col("value") / 2500
    return e.select(
        "photo", faces.shot_scale(area, n).alias("shot_scale"), faces.face_bucket(n).alias("face_bucket"), faces.orientation(F.col("album"), F.lit(75)).alias("orientation"),
        faces.participant_mode(n, F.col("album") % 5).alias("participant_mode"), faces.participant_mode(n, F.col("album") % 5, fixed=False).alias("participant_mode_quirk"),
    )


def p11_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("width", F.when(F.col("doc_id") % 17 != 0, F.col("width")))
    good, bad = split_errors(f)
    return good.agg(F.count(F.lit(1)).alias("n"), F.sum("width").alias("total_width")).withColumn("kind", F.lit("read")).unionByName(
        bad.agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("total_width")).withColumn("kind", F.lit("error"))
    )


def g1_image_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blur measures and hashes of small grey images made of the vectors (8 x 8, 0 to 255)."""
    v = vectors(spark, sf_dir).select("vec_id", F.lit(8).alias("width"), F.transform("v", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), x * 255 + 128))).alias("pixels"))
    return over_pixels(v, "vec_id")


def n_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    title = F.concat(F.lit(" "), F.col("c_name"), F.lit(": "), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, " (12 photos)").otherwise(" / x. "))
    return c.select(
        "c_custkey", scalars.safe_name(title).alias("folder"), scalars.debug_name(title).alias("debug_name"), F.initcap(F.replace(F.lower("c_mktsegment"), F.lit("e"), F.lit("_"))).alias("titled"),
        F.substring_index("c_name", "#", 1).alias("head"), F.format_string("%.2f", F.col("c_acctbal")).alias("money"), F.col("c_name").startswith("Cust").alias("starts"), F.col("c_name").endswith("7").alias("ends"),
    )


def n_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timeline(spark, sf_dir)
    v = F.col("value")
    return e.select(
        "photo", F.round(F.exp(-v / 100), 8).alias("e"), F.round(F.log1p(v), 8).alias("l"), F.round(F.sqrt(v), 8).alias("s"), F.round(faces.roll_degrees(v, F.lit(1.0), v + 3, F.col("album") / 10), 6).alias("roll"),
        F.bit_count(F.col("photo").bitwiseXOR(F.col("album"))).cast("long").alias("bits"), scalars.elapsed((v * 60).cast("long")).alias("elapsed"), F.lower(F.hex("photo")).alias("hex"),
        F.round(faces.sigmoid(v / 100 - 1), 8).alias("sigmoid"), F.round(faces.smoothstep(10.0, 90.0, v), 8).alias("smooth"), F.round(faces.descending_smoothstep(10.0, 90.0, v), 8).alias("descending"),
    )


def n_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timeline(spark, sf_dir)
    end = F.when(F.col("photo") % 3 == 0, F.col("ts") + 7200).when(F.col("photo") % 3 == 1, F.col("ts"))
    start = F.when(F.col("photo") % 5 != 0, F.col("ts"))
    return e.select("photo", scalars.minute_text(F.col("ts")).alias("minute"), scalars.time_range_text(start, end).alias("time_range"), scalars.day_number(F.col("ts")).alias("day"))


def n_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timeline(spark, sf_dir).withColumn("p", F.from_json("props", "k int, missing int"))
    return e.select("photo", F.coalesce("p.k", F.lit(-1)).alias("k"), F.coalesce("p.missing", F.lit(-1)).alias("missing"), F.sha1("props").alias("sha1"), F.sha2("props", 256).alias("sha256"))


def n_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    x = F.col("v")
    return v.select(
        "vec_id", F.round(F.array_max(x), 6).alias("top"), (F.array_position(x, F.array_max(x)) - 1).alias("argmax"), F.size(F.concat(F.slice(x, 57, 8), F.array_repeat(F.lit(0.0), 4))).alias("padded"),
        F.round(scalars.nearest_rank(F.sort_array(x), 0.9), 6).alias("p90"), F.get(F.transform(F.sort_array(F.transform(x, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))), lambda r: r["i"]), 2).alias("third"),
    )


QUERIES = {f.__name__: f for f in (s1_find_files, s2_extensions, s10_capture_time, s12_prompts, p1_normalize_extensions, p2_resolve_selection, p4_derived, p6_blur_status, o3_blurry_sorted, p8_photo_categories, p11_errors, g1_image_measures, n_strings, n_numbers, n_times, n_json, n_arrays)}

_EXT = r"lower(regexp_extract(path, '[^/]+(\.[^./]+)$', 1))"
_BLUR = "0.45 * least(value / 400, 1) + 0.35 * least((value % 97) / 60, 1) + 0.20 * least((value % 61) / 50, 1)"
_BLUR_SQL = f"SELECT photo, round(s, 10) AS score, CASE WHEN s >= 0.70 THEN 'Sharp' WHEN s >= 0.45 THEN 'Review' ELSE 'Blurry' END AS status FROM (SELECT photo, {_BLUR} AS s FROM t)"


def _concept_values() -> str:
    rows = [f"('{c}', {i}, '{x.key}', '{x.family}', '{x.phrase}')" for c, xs in CONCEPTS.items() for i, x in enumerate(xs)]
    return ", ".join(rows)


def _safe(t: str) -> str:
    strip = f"trim({t}, ' ' || chr(9) || chr(10) || chr(13))"
    return f"trim(translate({strip}, '<>:\"/\\|?*', '_________'), ' .')"


SQL = {
    "s1_find_files": f"WITH {FILES_SQL} SELECT path, {_EXT} AS extension, width, height FROM f WHERE {_EXT} IN ('.jpg', '.jpeg', '.png', '.webp', '.bmp', '.tif', '.tiff') AND width > height",
    "s2_extensions": f"WITH {FILES_SQL} SELECT DISTINCT {_EXT} AS extension FROM f WHERE {_EXT} IN ('.jpg', '.jpeg', '.png', '.webp', '.bmp', '.tif', '.tiff')",
    "s10_capture_time": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN floor(epoch_us(o_orderdate) / 1e6) ELSE o_orderkey::DOUBLE END AS ts, CASE WHEN o_orderkey % 3 < 2 THEN 'exif' ELSE 'filesystem' END AS source FROM orders",
    "s12_prompts": f"SELECT c.category, c.ord, c.key, c.family, p.n, replace(p.prompt, '{{}}', c.phrase) AS prompt FROM (VALUES {_concept_values()}) c(category, ord, key, family, phrase), (VALUES {', '.join(f'({i}, {chr(39)}{p}{chr(39)})' for i, p in enumerate(PROMPTS))}) p(n, prompt)",
    "p1_normalize_extensions": """
SELECT p_partkey, array_to_string(list_filter([a, b, CASE WHEN c <> a AND c <> b THEN c END], lambda x: x IS NOT NULL), ',') AS extensions
FROM (SELECT p_partkey, '.' || lower(p_type) AS a, '.' || lower(p_brand) AS b, '.' || lower(split_part(p_name, ' ', 1)) AS c FROM part)""",
    "p2_resolve_selection": "SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN '.jpg,.png,.webp' ELSE '.jpg,.png' END AS extensions FROM part",
    "p4_derived": rf"""WITH {FILES_SQL}
SELECT path, width * height AS pixels, round(CASE WHEN height = 0 THEN 0 ELSE width / height END, 6) AS aspect_ratio, round(width * height / 1e6, 6) AS megapixels,
  regexp_extract(path, '[^/]+$') AS filename, {_EXT} AS extension, regexp_extract(path, '([^/]+)\.[^./]+$', 1) AS stem FROM f""",
    "p6_blur_status": f"WITH {TIMELINE_SQL} {_BLUR_SQL}",
    "o3_blurry_sorted": f"WITH {TIMELINE_SQL} SELECT * FROM ({_BLUR_SQL}) WHERE status = 'Blurry' ORDER BY score, photo",
    "p8_photo_categories": f"""WITH {TIMELINE_SQL}, x AS (SELECT photo, (photo % 7)::INT AS n, value / 2500 AS a, album, album % 5 AS k FROM t)
SELECT photo, CASE WHEN n <= 0 THEN 'wide' WHEN a >= 0.18 THEN 'close' WHEN a >= 0.08 THEN 'medium' WHEN a >= 0.03 THEN 'full_body' ELSE 'wide' END AS shot_scale,
  CASE WHEN n <= 0 THEN 'zero' WHEN n = 1 THEN 'one' WHEN n = 2 THEN 'couple' WHEN n <= 4 THEN 'small_group' ELSE 'crowd' END AS face_bucket,
  CASE WHEN album > 75 THEN 'landscape' WHEN album < 75 THEN 'portrait' ELSE 'square' END AS orientation,
  CASE WHEN n <= 0 THEN 'none' WHEN k >= 3 AND n >= 3 THEN 'family_group' WHEN n = 2 THEN 'couple' WHEN n = 1 THEN 'solo' WHEN n <= 4 THEN 'small_group' ELSE 'crowd' END AS participant_mode,
  CASE WHEN n <= 0 THEN 'none' WHEN k >= 3 AND n >= 3 THEN 'family_group' WHEN n = 2 THEN 'couple' WHEN n <= 4 THEN 'small_group' ELSE 'crowd' END AS participant_mode_quirk FROM x""",
    "p11_errors": f"""WITH {FILES_SQL}
SELECT 'read' AS kind, count(*) AS n, sum(width)::BIGINT AS total_width FROM f WHERE doc_id % 17 <> 0 UNION ALL SELECT 'error', count(*), 0 FROM f WHERE doc_id % 17 = 0""",
    "n_strings": rf"""
WITH x AS (SELECT *, ' ' || c_name || ': ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' (12 photos)' ELSE ' / x. ' END AS title FROM customer)
SELECT c_custkey, {_safe("CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_name || ': ' || c_mktsegment ELSE title END")} AS folder, trim(regexp_replace(title, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS debug_name,
  upper(replace(lower(c_mktsegment), 'e', '_')[1]) || replace(lower(c_mktsegment), 'e', '_')[2:] AS titled, split_part(c_name, '#', 1) AS head, printf('%.2f', c_acctbal) AS money,
  starts_with(c_name, 'Cust') AS starts, suffix(c_name, '7') AS ends FROM x""",
    "n_numbers": f"""WITH {TIMELINE_SQL}, x AS (SELECT *, (value * 60)::DECIMAL(18, 6) AS d, floor(value * 60)::BIGINT AS s, greatest(0, least(1, (value - 10) / 80)) AS g FROM t)
SELECT photo, round(exp(-value / 100), 8) AS e, round(ln(1 + value), 8) AS l, round(sqrt(value), 8) AS s, round(degrees(atan2(album / 10 - 1.0, (value + 3) - value)), 6) AS roll,
  bit_count(xor(photo, album))::BIGINT AS bits, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS elapsed,
  lower(to_hex(photo)) AS hex, round(1 / (1 + exp(-(value / 100 - 1))), 8) AS sigmoid, round(g * g * (3 - 2 * g), 8) AS smooth, round(1 - g * g * (3 - 2 * g), 8) AS descending FROM x""",
    "n_times": f"""WITH {TIMELINE_SQL}, x AS (SELECT *, CASE WHEN photo % 5 <> 0 THEN ts END AS a, CASE photo % 3 WHEN 0 THEN ts + 7200 WHEN 1 THEN ts END AS b FROM t),
m AS (SELECT *, strftime(make_timestamp((floor(ts) * 1000000)::BIGINT), '%Y-%m-%d %H:%M UTC') AS mt, strftime(make_timestamp((floor(a) * 1000000)::BIGINT), '%Y-%m-%d %H:%M UTC') AS ma, strftime(make_timestamp((floor(b) * 1000000)::BIGINT), '%Y-%m-%d %H:%M UTC') AS mb FROM x)
SELECT photo, mt AS minute, CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN a IS NULL THEN 'Ends ' || mb WHEN b IS NULL OR abs(b - a) < 1 THEN ma ELSE ma || ' -> ' || mb END AS time_range, floor(ts / 86400)::BIGINT AS day FROM m""",
    "n_json": f"WITH {TIMELINE_SQL} SELECT photo, coalesce(json_extract(props, '$.k')::INT, -1) AS k, -1 AS missing, sha1(props) AS sha1, sha256(props) AS sha256 FROM t",
    "n_arrays": """
SELECT vec_id, round(list_max(v), 6) AS top, (list_position(v, list_max(v)) - 1)::BIGINT AS argmax, 12 AS padded, round(list_sort(v)[58], 6) AS p90, (list_position(v, list_reverse_sort(v)[3]) - 1)::INT AS third
FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""",
}
