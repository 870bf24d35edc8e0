"""Sources, filters and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.functions import text as T
from vellum.functions.languages import FROM_ISO, NAMES, ORIENTATION
from vellum.queries.registry import query
from vellum.sources.config import config
from vellum.sources.layout import LINES_SQL, text_lines
from vellum.sources.scratch import Scratch
from vellum.sources.tables import read_dictionary, read_table

ISO_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in FROM_ISO.items())
NAME_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in NAMES.items())
ORIENTATION_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in ORIENTATION.items())


#: A request's settings from an event's number: some left out, some of no choice, some no JSON.
CONFIG_TEXT_SQL = """CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN '{"detector": {"detection_size": ' || (1024 + k) || ', "box_threshold": 0.5}, "translator": {"target_lang": "CHS"}}'
WHEN 2 THEN '{"render": {"direction": "horizontal", "font_size_offset": ' || k || '}}' WHEN 3 THEN '{"render": {"direction": "sideways"}}' WHEN 4 THEN '{"detector": {"detection_size": ' WHEN 5 THEN '{"inpainter": {"inpainter": "none"}, "ocr": {"prob": 0.25}}' ELSE '{}' END"""


@query(
    "S4_json_config",
    f"""WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), t AS (SELECT event_id, k, {CONFIG_TEXT_SQL} AS config FROM e),
j AS (SELECT event_id, k, CASE WHEN config = '' THEN '{{}}' WHEN json_valid(config) THEN config END AS j FROM t)
SELECT event_id, coalesce(CAST(json_extract(j, '$.detector.detection_size') AS INT), 1536) AS detection_size, coalesce(CAST(json_extract(j, '$.detector.box_threshold') AS DOUBLE), 0.7) AS box_threshold, coalesce(json_extract_string(j, '$.translator.target_lang'), 'ENG') AS target_lang,
coalesce(json_extract_string(j, '$.render.direction'), 'auto') AS direction, coalesce(CAST(json_extract(j, '$.render.font_size_offset') AS INT), 0) AS font_size_offset, coalesce(json_extract_string(j, '$.inpainter.inpainter'), 'lama_large') AS inpainter, CAST(json_extract(j, '$.ocr.prob') AS DOUBLE) AS prob,
CASE WHEN j IS NULL THEN 'json' WHEN coalesce(json_extract_string(j, '$.render.direction'), 'auto') NOT IN ('auto', 'horizontal', 'vertical') THEN 'render.direction' END AS error FROM j WHERE k IS NOT NULL""",
)
def json_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).where("k IS NOT NULL")
    parsed = events.select("event_id", config(F.expr(CONFIG_TEXT_SQL)).alias("c"))
    wanted = ("detector.detection_size", "detector.box_threshold", "translator.target_lang", "render.direction", "render.font_size_offset", "inpainter.inpainter", "ocr.prob", "error")
    return parsed.select("event_id", *[F.col(f"c.{n}").alias(n.split(".")[-1]) for n in wanted])


@query("S8_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("S10_file_name", "SELECT page_id, regexp_extract(url, '/([^/?]+)[^/]*$', 1) AS file_name FROM pages")
def file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"/([^/?]+)[^/]*$", 1).alias("file_name"))


@query("S11_scan_filter", "SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '\\.(html|htm)([?#]|$)') AND NOT contains(url, '_translated') AND NOT contains(url, '_inpainted')")
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    fits = F.lower(url).rlike(r"\.(html|htm)([?#]|$)") & ~url.contains("_translated") & ~url.contains("_inpainted")
    return read_table(spark, sf_dir, "pages").where(fits).select("page_id", "url")


@query("S12_report_rows", f"WITH {LINES_SQL} SELECT page_id, '| ' || page_id || ' | ' || count(*) || ' | ' || sum(w) || ' |' AS line FROM lines GROUP BY page_id")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = text_lines(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    return sums.select("page_id", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("page_id").cast("string"), F.col("n").cast("string"), F.col("w").cast("string")), F.lit(" |")).alias("line"))


@query("S15_missing_parts", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)")
def missing_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return read_table(spark, sf_dir, "part").select("p_partkey").join(held, "p_partkey", "left_anti")


@query("P1_texts_not_blank", f"WITH {LINES_SQL} SELECT page_id, line_id, text FROM lines WHERE length(trim(text)) > 0")
def not_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark, sf_dir).where(F.length(T.strip(F.col("text"))) > 0).select("page_id", "line_id", "text")


@query("P2_valuable_texts", f"WITH {LINES_SQL} SELECT page_id, line_id, text FROM lines WHERE length(text) >= 8 AND regexp_matches(text, '[^\\p{{P}}\\p{{Zs}}\\p{{Cc}}\\p{{Cf}}\\p{{Nd}}\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]')")
def valuable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark, sf_dir).where((F.length("text") >= 8) & T.is_valuable(F.col("text"))).select("page_id", "line_id", "text")


@query("P3_translations_kept", "SELECT conv_id, turn, role FROM conversations WHERE text IS NOT NULL AND length(trim(text)) > 0")
def translations_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").where(F.length(T.strip(F.col("text"))) > 0).select("conv_id", "turn", "role")


@query("P5_area_over_16", f"WITH {LINES_SQL} SELECT page_id, line_id, w * h AS area FROM lines WHERE w * h > 16")
def area_over_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark, sf_dir).withColumn("area", F.col("w") * F.col("h")).where("area > 16").select("page_id", "line_id", "area")


@query(
    "P6_candidates",
    f"""WITH {LINES_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_id) AS nth FROM lines)
SELECT page_id, line_id FROM ranked WHERE nth <= 1000 AND least(w, h) >= 3 AND prob >= 0.7 AND least(w, h) + CAST(w * h AS DOUBLE) * CAST(2.3 AS DOUBLE) / (w + h) >= 5""",
)
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id numbers a page's lines without gaps, so it is the rank itself; widening by 2.3 times area over perimeter adds to both ends of a side."""
    side = F.least("w", "h")
    wider = side + F.col("w") * F.col("h") * F.lit(2.3) / (F.col("w") + F.col("h"))
    return text_lines(spark, sf_dir).where((F.col("line_id") <= 1000) & (side >= 3) & (F.col("prob") >= 0.7) & (wider >= 5)).select("page_id", "line_id")


@query("P7_sure_lines", f"WITH {LINES_SQL} SELECT page_id, line_id, prob FROM lines WHERE NOT prob < 0.7")
def sure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark, sf_dir).where(~(F.col("prob") < 0.7)).select("page_id", "line_id", "prob")


@query("P8_nonzero_boxes", f"WITH {LINES_SQL} SELECT page_id, line_id FROM lines WHERE x + y > 0")
def nonzero_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark, sf_dir).where("x + y > 0").select("page_id", "line_id")


@query("P9_binarised", f"WITH {LINES_SQL} SELECT page_id, line_id, CASE WHEN prob > 0.7 THEN 1 ELSE 0 END AS bit FROM lines")
def binarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark, sf_dir).select("page_id", "line_id", (F.col("prob") > 0.7).cast("int").alias("bit"))


@query("P14_routing", f"WITH {LINES_SQL} SELECT page_id, line_id, CASE WHEN regexp_matches(text, '[a-zA-Z]') THEN upper(text) ELSE text END AS translation FROM lines")
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of value go to the translator, here upper-casing; the others pass through."""
    return text_lines(spark, sf_dir).select("page_id", "line_id", F.when(T.is_valuable(F.col("text")), F.upper("text")).otherwise(F.col("text")).alias("translation"))


@query(
    "P15_direction",
    f"""WITH iso(lang, code) AS (VALUES {ISO_VALUES}), preset(code, direction) AS (VALUES {ORIENTATION_VALUES})
SELECT d.doc_id, i.code AS target_lang, coalesce(p.direction, 'auto') AS direction FROM documents d LEFT JOIN iso i ON i.lang = d.lang LEFT JOIN preset p ON p.code = i.code""",
)
def direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal maps of two dozen entries, so no join is planned."""
    iso, preset = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (FROM_ISO, ORIENTATION))
    code = F.element_at(iso, F.col("lang"))
    return read_table(spark, sf_dir, "documents").select("doc_id", code.alias("target_lang")).select("doc_id", "target_lang", F.coalesce(F.element_at(preset, F.col("target_lang")), F.lit("auto")).alias("direction"))


@query("P16_query_list", f"WITH {LINES_SQL} SELECT page_id, line_id, text AS query FROM lines")
def query_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query for each region, repeated texts too."""
    return text_lines(spark, sf_dir).select("page_id", "line_id", F.col("text").alias("query"))


@query(
    "P17_language_check",
    f"""WITH iso(lang, code) AS (VALUES {ISO_VALUES}), valid(code, name) AS (VALUES {NAME_VALUES})
SELECT d.doc_id, CASE WHEN i.code = 'ENG' THEN 'same' WHEN v.code IS NULL THEN 'invalid' ELSE 'translate' END AS route FROM documents d LEFT JOIN iso i ON i.lang = d.lang LEFT JOIN valid v ON v.code = i.code""",
)
def language_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts already in the target language pass as they are; codes outside the table are told apart."""
    iso, names = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (FROM_ISO, NAMES))
    code = F.element_at(iso, F.col("lang"))
    route = F.when(code == "ENG", "same").when(F.element_at(names, code).isNull(), "invalid").otherwise("translate")
    return read_table(spark, sf_dir, "documents").select("doc_id", route.alias("route"))


IMAGE_SQL = "SELECT p_partkey, 400 + p_size * 10 AS w, 600 + p_partkey * 3 AS h FROM part"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", (400 + F.col("p_size") * 10).alias("w"), (600 + F.col("p_partkey") * 3).alias("h"))


@query("P18_tile_gate", f"WITH i AS ({IMAGE_SQL}), t AS (SELECT p_partkey, least(w, h) AS w, greatest(w, h) AS h FROM i) SELECT p_partkey, (h / 1536.0 > 2.5 AND CAST(h AS DOUBLE) / w > 3) AS tiled FROM t")
def tile_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = images(spark, sf_dir).select("p_partkey", F.least("w", "h").alias("w"), F.greatest("w", "h").alias("h"))
    return turned.select("p_partkey", ((F.col("h") / 1536.0 > 2.5) & (F.col("h") / F.col("w") > 3)).alias("tiled"))


@query(
    "P19_detector_settings",
    f"""WITH i AS ({IMAGE_SQL}) SELECT p_partkey, greatest(1024, least(3072, CAST(round_even(greatest(w, h) / 64.0, 0) AS BIGINT) * 64)) AS detection_size,
CASE WHEN w * h < 1000000 THEN 0.55 WHEN w * h < 2500000 THEN 0.60 WHEN w * h < 4000000 THEN 0.65 ELSE 0.70 END::DOUBLE AS box_threshold FROM i""",
)
def detector_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    mega = F.col("w") * F.col("h") / 1_000_000.0
    size = F.greatest(F.lit(1024), F.least(F.lit(3072), F.bround(F.greatest("w", "h") / 64.0).cast("long") * 64))
    return images(spark, sf_dir).select("p_partkey", size.alias("detection_size"), F.when(mega < 1, 0.55).when(mega < 2.5, 0.60).when(mega < 4, 0.65).otherwise(0.70).alias("box_threshold"))


@query("S13_dictionary", "SELECT CAST(row_number() OVER (ORDER BY n_name) - 1 AS INT) AS index, n_name AS token FROM nation")
def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' names as a dictionary file, a token a line, written to the shared folder and read back by number."""
    path = Scratch(spark, "dictionary").path("tokens", keep=True)
    names = read_table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list("n_name")).alias("names"))  # a dictionary is one file
    names.select(F.array_join("names", "\n").alias("value")).coalesce(1).write.text(path)
    return read_dictionary(spark, path)


@query("P4_truthy_translation", f"WITH {LINES_SQL} SELECT page_id, line_id FROM lines WHERE CASE WHEN line_id % 3 = 0 THEN '' ELSE text END <> ''")
def truthy_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with any translation, blanks included; those without one have the empty string here."""
    lines = text_lines(spark, sf_dir).withColumn("translation", F.when(F.col("line_id") % 3 == 0, "").otherwise(F.col("text")))
    return lines.where(F.col("translation").isNotNull() & (F.col("translation") != "")).select("page_id", "line_id")
