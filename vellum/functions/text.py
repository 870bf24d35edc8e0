"""Text functions as column expressions; only built-in functions, so they stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: The ASCII ranges that count as punctuation beside the Unicode categories, white space, control characters.
ASCII_PUNCTUATION = r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E"
PUNCTUATION = rf"[\p{{P}}{ASCII_PUNCTUATION}]"
WHITESPACE = r"[ \t\n\r\x00\p{Zs}]"
CONTROL = r"[\p{Cc}\p{Cf}]"
VALUABLE = rf"[^\p{{P}}\p{{Zs}}\p{{Cc}}\p{{Cf}}\p{{Nd}}{ASCII_PUNCTUATION}]"
#: Blocks whose letters run from right to left.
RIGHT_TO_LEFT = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}\x{10E60}-\x{10E7F}\x{1EE00}-\x{1EEFF}]"
#: Marks of horizontal text, and below each the vertical form that stands for it.
HORIZONTAL_MARKS = "‥—―–_()（）{}〔〕【】《》〈〉「」『』[]…⋯“”‘’~〜～!?.。;；:：,，-−・"
VERTICAL_MARKS = "︰︱|︲︳︵︶︵︶︷︸︹︺︻︼︽︾︿﹀﹁﹂﹃﹄﹇﹈⋮︙﹁﹂﹁﹂︴︴︴︕︖︒︒︔︔︓︓︐︐︲︲·"
#: Patterns of a translation put right and what replaces them, in order; the second list is not for Arabic.
TIDY = [(r"(?U)\s+", " "), (r"(?U)(?<![.,;!?])([.,;!?])(?=\w)", "$1 "), (r"(?U)([.,;!?])\s+(?=[.,;!?]|$)", "$1")]
TIDY_SPACED = [(r"(?U)(?<=[.,;!?\w])\s+([.,;!?])", "$1"), (r"(?U)((?:\s|^)\.+)\s+(?=\w)", "$1")]
#: Small kana that take half a place.
HALF_WIDTH = "っッぁぃぅぇぉ"


def strip(text: Column) -> Column:
    """Without white space at the ends, as Unicode has it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_valuable(text: Column) -> Column:
    """Whether any character is neither punctuation, space, control nor digit."""
    return text.rlike(VALUABLE)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def shortest_period(text: Column) -> Column:
    """The shortest start, up to half the text, whose repetition rebuilds the text; else the text."""
    n = F.length(text)
    fits = lambda k: F.repeat(text.substr(F.lit(1), k), F.ceil(n / k).cast("int")).substr(F.lit(1), n) == text
    found = F.filter(F.sequence(F.lit(1), F.greatest(F.floor(n / 2), F.lit(1)).cast("int")), lambda k: (k * 2 <= n) & fits(k))
    return F.coalesce(text.substr(F.lit(1), F.get(found, 0)), text)


def tidy(text: Column, arabic: bool = False) -> Column:
    """Spaces of a translation put right: runs become one, marks stand by the word before and apart from the word after."""
    steps = TIDY if arabic else TIDY + TIDY_SPACED
    return reduce(lambda t, s: F.regexp_replace(t, *s), steps, text)


def cleaned(query: Column, translation: Column, arabic: bool = False) -> Column:
    """A translation put right; one that is shorter than its query and repeats itself is repeated up to the query's length."""
    out = tidy(translation, arabic)
    period = shortest_period(F.lower(out))
    times = F.greatest(F.floor(F.length(query) / F.length(period)), F.lit(1)).cast("int")
    short = (F.length(out) < F.length(query)) & (F.length(period) < 0.5 * F.length(out))
    empty = (F.coalesce(query, F.lit("")) == "") | (F.coalesce(translation, F.lit("")) == "")
    return F.when(empty, "").when(short, F.repeat(period, times)).otherwise(out)


def compact_symbols(text: Column) -> Column:
    """Three and two dots become an ellipsis; spaces after a symbol go."""
    text = F.replace(F.replace(text, F.lit("..."), F.lit("…")), F.lit(".."), F.lit("…"))
    return F.regexp_replace(text, "(?U)([^\\w\\s])[ 　]+", "$1")


def vertical(text: Column) -> Column:
    """Marks in their vertical forms."""
    return F.translate(text, HORIZONTAL_MARKS, VERTICAL_MARKS)


def places(text: Column) -> Column:
    """Length of the stripped text with small kana at a half."""
    return places_of(strip(text))


def places_of(stripped: Column) -> Column:
    """:func:`places` of a text that has been stripped."""
    return F.length(stripped) - 0.5 * F.regexp_count(stripped, F.lit(f"[{HALF_WIDTH}]"))


def length_ratio(original: Column, translation: Column) -> Column:
    """Places of the translation over those of the original, 0.5 at least; 1 for an empty original."""
    return ratio_of(places(original), places(F.coalesce(translation, F.lit(""))))


def ratio_of(held: Column, wanted: Column) -> Column:
    """:func:`length_ratio` of texts of so many places."""
    return F.when(held <= 0, 1.0).otherwise(F.greatest(F.lit(0.5), wanted / held))


def is_cjk_code(code: Column) -> Column:
    """Whether a language code starts as one of those without spaces between words."""
    return F.lower(code).rlike("^(ja|jp|zh|ko|th|lo|my|km)")


def joined(parts: Column) -> Column:
    """Texts in order, with a space between two unless one side of the seam is in U+3000 to U+9FFF."""
    dense = r"[\x{3000}-\x{9FFF}]"
    seam = lambda a, t: F.when((a == "") | F.substring(a, -1, 1).rlike(dense) | F.substring(t, 1, 1).rlike(dense), F.concat(a, t)).otherwise(F.concat(a, F.lit(" "), t))
    return F.aggregate(parts, F.lit(""), seam)


#: The letters after which a word may break.
VOWELS = "aeiouAEIOU"


def syllables(word: Column, lang: Column) -> Column:
    """Parts at which a word may break, where no hyphenator is at hand.

    Words of 3 letters or fewer and those of languages without spaces stay whole.
    Up to 9 letters a word breaks after a vowel that a consonant follows, not
    after its first letter, if that makes 2 to 4 parts. Above 15 it breaks every
    3 letters. All others stay whole.
    """
    n, tail = F.length(word), word.substr(F.lit(2), F.length(word))
    broken = F.split(F.concat(F.substring(word, 1, 1), F.regexp_replace(tail, f"([{VOWELS}])([^{VOWELS}])", "$1\u0000$2")), "\u0000")
    threes = F.transform(F.sequence(F.lit(0), F.ceil(n / 3).cast("int") - 1), lambda k: F.substring(word, k * 3 + 1, F.lit(3)))
    whole = F.array(word)
    short = F.when(F.size(broken).between(2, 4), broken).otherwise(whole)
    return F.when((n <= 3) | is_cjk_code(lang), whole).when(n <= 9, short).when(n > 15, threes).otherwise(whole)


def left_to_right_runs_reversed(text: Column) -> Column:
    """For setting in a right-to-left direction: runs of valuable characters of the other direction are turned round."""
    run = VALUABLE[:-1] + RIGHT_TO_LEFT[1:]
    parts = F.regexp_extract_all(text, F.lit(f"(?s)({run}+|.)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.reverse(p)), "")


def wrapped_columns(text: Column, most: Column, dense: Column, thin: Column) -> Column:
    """Columns of vertical text as structs (text, height): greedy, a new one where the next character would go over ``most``.

    Spaces at the head of a column are left out. Heights are synthetic: ``thin`` for
    ASCII characters and spaces, ``dense`` for all others.
    """
    done = F.array().cast("array<struct<text:string,height:bigint>>")
    zero = F.lit(0).cast("bigint")
    start = F.struct(done.alias("done"), F.lit("").alias("text"), zero.alias("height"))

    def put(a: Column, c: Column) -> Column:
        tall = F.when(F.ascii(c) < 128, thin).otherwise(dense).cast("bigint")
        over = a["height"] + tall > most
        full = F.array_append(a["done"], F.struct(a["text"].alias("text"), a["height"].alias("height")))
        shape = vertical(c)
        return F.when((a["height"] == 0) & (c == " "), a).when(over, F.struct(full.alias("done"), shape.alias("text"), tall.alias("height"))).otherwise(
            F.struct(a["done"].alias("done"), F.concat(a["text"], shape).alias("text"), (a["height"] + tall).alias("height"))
        )

    end = lambda a: F.array_append(a["done"], F.struct(a["text"].alias("text"), a["height"].alias("height")))
    return F.aggregate(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1)), start, put, end)


def complexity(name: Column) -> Column:
    """The group that an image's name says."""
    low = F.lower(name)
    return F.when(low.contains("easy"), "easy").when(low.contains("medium"), "medium").when(low.contains("complex"), "complex").otherwise("unknown")
