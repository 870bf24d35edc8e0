"""Text functions over the driver's texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vellum.functions import text as T
from vellum.functions.wrapping import Patterns, hyphenated_lines, hyphenated_parts, wrapped_lines
from vellum.queries.registry import query
from vellum.sources.tables import read_table

PUNCT_SQL = r"[\p{P}\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


@query("T1_punctuation", f"SELECT doc_id, length(regexp_replace(text, '[^\\p{{P}}\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]', '', 'g')) AS n FROM documents")
def punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.count_of(F.col("text"), T.PUNCTUATION).alias("n"))


@query("T2_whitespace", "SELECT doc_id, length(regexp_replace(text, '[^ \\t\\n\\r\\x00\\p{Zs}]', '', 'g')) AS n FROM documents")
def whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.count_of(F.col("text"), T.WHITESPACE).alias("n"))


@query("T3_control", "SELECT doc_id, regexp_matches(replace(replace(replace(text, chr(9), ''), chr(10), ''), chr(13), ''), '[\\p{Cc}\\p{Cf}]') AS has FROM documents")
def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.translate("text", "\t\n\r", "").rlike(T.CONTROL).alias("has"))


@query("T4_valuable_characters", "SELECT DISTINCT c, regexp_full_match(c, '[^\\p{P}\\p{Zs}\\p{Cc}\\p{Cf}\\p{Nd}\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]') AS valuable FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS c FROM benchmark)")
def valuable_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each character of the benchmark's texts, and whether it says something."""
    chars = read_table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("(?s)(.)"), F.lit(1))).alias("c")).distinct()
    return chars.select("c", T.is_valuable(F.col("c")).alias("valuable"))


@query("T5_valuable", "SELECT doc_id, regexp_matches(text, '[^\\p{P}\\p{Zs}\\p{Cc}\\p{Cf}\\p{Nd}\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]') AS valuable FROM documents")
def valuable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.is_valuable(F.col("text")).alias("valuable"))


@query("T6_valuable_count", "SELECT doc_id, length(regexp_replace(text, '[\\p{P}\\p{Zs}\\p{Cc}\\p{Cf}\\p{Nd}\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]', '', 'g')) AS n FROM documents")
def valuable_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.count_of(F.col("text"), T.VALUABLE).alias("n"))


@query("T7_right_to_left", "SELECT doc_id, regexp_matches(text, '[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}\\x{10E60}-\\x{10E7F}\\x{1EE00}-\\x{1EEFF}]') AS rtl FROM documents")
def right_to_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.col("text").rlike(T.RIGHT_TO_LEFT).alias("rtl"))


@query("T8_repeating_sequence")
def repeating_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select("item_id", T.shortest_period(F.col("text")).alias("period"))


@query("T9_cleaned")
def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other translation repeats a short start of its query, and is shorter."""
    text = F.col("text")
    translation = F.when(F.col("item_id") % 2 == 0, F.repeat(F.substring(text, 1, 4), 3)).otherwise(text)
    return read_table(spark, sf_dir, "benchmark").select("item_id", T.cleaned(text, translation).alias("clean"))


#: What opens and closes the wrapper of a reply that is no JSON.
WRAP_OPEN, WRAP_CLOSE = r'(?s)^\s*\{.*?"translated"\s*:\s*"', r'"\s*\}\s*$'
_REPLY_SQL = """CASE event_id % 4 WHEN 0 THEN '{"translated": "word ' || event_id || '"}' WHEN 1 THEN ' {"note": 1, "translated" : "a "quoted" ' || event_id || '" } ' WHEN 2 THEN 'plain ' || event_id || ' ' ELSE props END"""


def reply(raw: Column) -> Column:
    """The ``translated`` value of a JSON reply, the whole reply where it has none; a reply that is no JSON loses its wrapper and the blanks at its ends."""
    blanks = F.lit(" \t\n\r\x0b\x0c")
    content = F.trim(raw, blanks)
    stripped = F.trim(F.regexp_replace(F.regexp_replace(content, WRAP_OPEN, ""), WRAP_CLOSE, ""), blanks)
    is_object = F.startswith(content, F.lit("{")) & F.try_parse_json(content).isNotNull()
    return F.when(is_object, F.coalesce(F.get_json_object(content, "$.translated"), content)).otherwise(stripped)


@query(
    "T10_reply_parse",
    f"""WITH r AS (SELECT event_id, trim({_REPLY_SQL}) AS c FROM events)
SELECT event_id, CASE WHEN json_valid(c) THEN coalesce(json_extract_string(c, '$.translated'), c) ELSE trim(regexp_replace(regexp_replace(c, '^\\s*\\{{.*?"translated"\\s*:\\s*"', '', 's'), '"\\s*\\}}\\s*$', '')) END AS translated FROM r""",
)
def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of four kinds: JSON, a wrapper with bare quotes inside, plain text, and JSON without the key."""
    k = F.col("event_id")
    kinds = F.when(k % 4 == 0, F.concat(F.lit('{"translated": "word '), k, F.lit('"}'))).when(k % 4 == 1, F.concat(F.lit(' {"note": 1, "translated" : "a "quoted" '), k, F.lit('" } '))).when(k % 4 == 2, F.concat(F.lit("plain "), k, F.lit(" "))).otherwise(F.col("props"))
    rows = read_table(spark, sf_dir, "events").select("event_id", kinds.alias("raw"))
    return rows.select("event_id", reply(F.col("raw")).alias("translated"))


@query("T11_prompt", "SELECT conv_id, turn, 'Translate into English: {\"untranslated\": \"' || text || '\"}' AS prompt FROM conversations")
def prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text goes in unescaped, as the service has it."""
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit('Translate into English: {"untranslated": "'), "text", F.lit('"}')).alias("prompt"))


@query("T12_compact_symbols", "SELECT item_id, regexp_replace(replace(replace(text, '...', '…'), '..', '…'), '([^\\p{L}\\p{N}\\p{M}_\\s])[ \\x{3000}]+', '\\1', 'g') AS text FROM benchmark")
def compact_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select("item_id", T.compact_symbols(F.col("text")).alias("text"))


@query("T13_vertical_forms", f"SELECT item_id, translate(text, '{T.HORIZONTAL_MARKS}', '{T.VERTICAL_MARKS}') AS text FROM benchmark")
def vertical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select("item_id", T.vertical(F.col("text")).alias("text"))


@query("T14_places", "SELECT item_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) - 0.5 * length(regexp_replace(text, '[^っッぁぃぅぇぉ]', '', 'g'))::DOUBLE AS n FROM benchmark")
def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select("item_id", T.places(F.col("text")).cast("double").alias("n"))


@query(
    "T15_length_ratio",
    "SELECT a.conv_id, a.turn, CASE WHEN length(trim(a.text)) = 0 THEN 1 ELSE round(greatest(0.5, length(trim(b.text))::DOUBLE / length(trim(a.text))), 8) END AS ratio FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1",
)
def length_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.length_ratio(F.col("text"), F.col("reply")), 8).alias("ratio"))


@query("T16_cjk_language", "SELECT doc_id, regexp_matches(lower(lang), '^(ja|jp|zh|ko|th|lo|my|km)') AS cjk FROM documents")
def cjk_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.is_cjk_code(F.col("lang")).alias("cjk"))


#: Every word of the benchmark and of the product names, with a language by its length.
WORDS_SQL = "words AS (SELECT DISTINCT word, CASE WHEN length(word) % 5 = 4 THEN 'ja_JP' ELSE 'en_US' END AS lang FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark UNION ALL SELECT replace(p_name, ' ', '') FROM part) WHERE word <> '')"


@query(
    "T17_syllables",
    f"""WITH {WORDS_SQL}, b AS (SELECT *, string_split(substr(word, 1, 1) || regexp_replace(substr(word, 2), '([{T.VOWELS}])([^{T.VOWELS}])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS broken FROM words)
SELECT word, array_to_string(CASE WHEN length(word) <= 3 OR regexp_matches(lang, '^(ja|jp|zh|ko|th|lo|my|km)') THEN [word] WHEN length(word) <= 9 THEN CASE WHEN len(broken) BETWEEN 2 AND 4 THEN broken ELSE [word] END
WHEN length(word) > 15 THEN list_transform(range(0, CAST(ceil(length(word) / 3.0) AS BIGINT)), lambda k: substr(word, CAST(k * 3 + 1 AS BIGINT), 3)) ELSE [word] END, '|') AS parts FROM b""",
)
def syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read_table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word"))
    words = words.union(read_table(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("")))).where("word <> ''").distinct()
    lang = F.when(F.length("word") % 5 == 4, "ja_JP").otherwise("en_US")
    return words.select("word", F.array_join(T.syllables(F.col("word"), lang), "|").alias("parts"))


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pattern): a break between two consonants that stand between vowels, in the pairs that the regions', nations' and parts' names have; none inside the pairs that sound as one.

    A hyphenator's table is the caller's. Its rows are pairs of letters, 400 at most.
    """
    names = read_table(spark, sf_dir, "part").select(F.lower("p_name").alias("n")).union(read_table(spark, sf_dir, "nation").select(F.lower("n_name")))
    pairs = names.select(F.explode(F.regexp_extract_all("n", F.lit("(?=([b-df-hj-np-tv-z]{2}))"), F.lit(1))).alias("p")).distinct()
    one = F.col("p").isin("ch", "ck", "sh", "th", "ph", "gh", "wh", "ng", "qu")
    return pairs.select(F.concat(F.substring("p", 1, 1), F.when(one, "2").otherwise("1"), F.substring("p", 2, 1)).alias("pattern"))


def hyphenator(spark: SparkSession, sf_dir: str) -> Patterns:
    return Patterns(sorted(r.pattern for r in patterns(spark, sf_dir).collect()))  # pairs of letters


@query("T17_hyphenated")
def hyphenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the words of the benchmark and of the product names by letter patterns."""
    held = hyphenator(spark, sf_dir)
    words = read_table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word"))
    words = words.union(read_table(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("")))).where("word <> ''").distinct()
    return words.select("word", F.array_join(hyphenated_parts(held)("word", F.lit("en_US")), "|").alias("parts"))


@query("T18_hyphenated_wrap")
def hyphenated_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a 20-pixel font in a box of 260 by 60, broken by letter patterns, filled where they are too many."""
    lines = hyphenated_lines(hyphenator(spark, sf_dir))(F.col("text"), F.lit(20), F.lit(260.0), F.lit(60.0), F.lit("en_US"))
    return read_table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(lines).alias("place", "l")).select("item_id", "place", "l.text", "l.width")


RUN_SQL = T.VALUABLE[:-1] + T.RIGHT_TO_LEFT[1:]


@query("T19_reversed_runs", f"SELECT item_id, array_to_string(list_transform(regexp_extract_all(text, '(?s)({RUN_SQL}+|.)'), lambda p: reverse(p)), '') AS text FROM benchmark")
def reversed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select("item_id", T.left_to_right_runs_reversed(F.col("text")).alias("text"))


@query("W14_vertical_wrap")
def vertical_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a 20-pixel font in 400 pixels; widths are synthetic, no font's."""
    columns = T.wrapped_columns(F.col("text"), F.lit(400), F.lit(20), F.lit(12))
    return read_table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(columns).alias("place", "c")).select("item_id", "place", "c.text", "c.height")


@query("T18_horizontal_wrap")
def horizontal_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a 20-pixel font in a box of 300 by 200."""
    lines = wrapped_lines(F.col("text"), F.lit(20), F.lit(300.0), F.lit(200.0), F.lit("en_US"))
    return read_table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(lines).alias("place", "l")).select("item_id", "place", "l.text", "l.width")


@query("T21_complexity", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'easy') THEN 'easy' WHEN contains(lower(p_name), 'medium') THEN 'medium' WHEN contains(lower(p_name), 'complex') THEN 'complex' ELSE 'unknown' END AS complexity FROM part")
def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", T.complexity(F.col("p_name")).alias("complexity"))


@query("T22_hex_colour", "SELECT p_partkey, (p_partkey * 7) % 256 AS r, (p_partkey * 11) % 256 AS g, (p_partkey * 13) % 256 AS b FROM part")
def hex_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours written as fg:bg hex text, and read back from it."""
    key = F.col("p_partkey")
    text = F.concat(F.lit("ffffff:"), *[F.lpad(F.hex(key * k % 256), 2, "0") for k in (7, 11, 13)])
    part = F.split(text, ":")[1]
    channel = lambda at: F.conv(F.substring(part, at, 2), 16, 10).cast("long")
    return read_table(spark, sf_dir, "part").select("p_partkey", channel(1).alias("r"), channel(3).alias("g"), channel(5).alias("b"))


@query("T23_replaced_prefix", "SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN 'https://' || substr(url, 8) ELSE url END AS url FROM pages")
def replaced_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return read_table(spark, sf_dir, "pages").select("page_id", F.when(url.startswith("http://"), F.concat(F.lit("https://"), url.substr(F.lit(8), F.length(url)))).otherwise(url).alias("url"))


@query("T24_stripped", "SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations")
def stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip(F.col("text")).alias("text"))
