"""Request settings: JSON text to a nested struct with every setting in it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values: (setting, type, default) of each group; None stays null.
SETTINGS: dict[str, list[tuple[str, str, object]]] = {
    "render": [
        ("renderer", "string", "default"), ("alignment", "string", "auto"), ("disable_font_border", "boolean", False), ("font_size_offset", "int", 0),
        ("font_size_minimum", "int", 18), ("direction", "string", "auto"), ("uppercase", "boolean", False), ("lowercase", "boolean", False),
        ("no_hyphenation", "boolean", False), ("font_color", "string", None), ("line_spacing", "int", None), ("font_size", "int", None), ("rtl", "boolean", True),
    ],
    "translator": [("translator", "string", "groq"), ("target_lang", "string", "ENG"), ("no_text_lang_skip", "boolean", False), ("skip_lang", "string", None)],
    "detector": [
        ("detector", "string", "default"), ("detection_size", "int", 1536), ("text_threshold", "double", 0.5), ("box_threshold", "double", 0.7),
        ("unclip_ratio", "double", 2.3), ("det_rotate", "boolean", False), ("det_auto_rotate", "boolean", False), ("det_invert", "boolean", False), ("det_gamma_correct", "boolean", False),
    ],
    "inpainter": [("inpainter", "string", "lama_large"), ("inpainting_size", "int", 2048), ("inpainting_precision", "string", "bf16")],
    "ocr": [("ocr", "string", "48px"), ("min_text_length", "int", 0), ("ignore_bubble", "int", 0), ("prob", "double", None)],
}
#: What settings with a choice may be; a renderer may have any name.
CHOICES: dict[tuple[str, str], tuple[str, ...]] = {
    ("render", "alignment"): ("auto", "left", "center", "right"), ("render", "direction"): ("auto", "horizontal", "vertical"),
    ("translator", "translator"): ("groq",), ("detector", "detector"): ("default",), ("inpainter", "inpainter"): ("lama_large", "none"), ("inpainter", "inpainting_precision"): ("fp32", "fp16", "bf16"), ("ocr", "ocr"): ("48px",),
}
#: Settings outside the groups.
SINGLE = [("kernel_size", "int", 3), ("mask_dilation_offset", "int", 30)]
_BAD = "_bad"


def config(json: Column) -> Column:
    """A struct of the groups of SETTINGS, what the text leaves out at its default, and ``error``.

    error is null for a good text; it is "json" where the text is no JSON object or a
    setting has another type, and "group.setting" where a choice is none of its own.
    A null or empty text has all defaults.
    """
    groups = ", ".join(f"{g} struct<{', '.join(f'{n}: {t}' for n, t, _ in each)}>" for g, each in SETTINGS.items())
    text = F.when(F.coalesce(F.trim(json), F.lit("")) == "", "{}").otherwise(json)
    single = ", ".join(f"{n} {t}" for n, t, _ in SINGLE)
    parsed = F.from_json(text, f"{groups}, {single}, {_BAD} string", {"columnNameOfCorruptRecord": _BAD, "mode": "PERMISSIVE"})
    filled = [F.struct(*[F.coalesce(parsed[g][n], F.lit(d).cast(t)).alias(n) for n, t, d in each]).alias(g) for g, each in SETTINGS.items()]
    filled += [F.coalesce(parsed[n], F.lit(d)).alias(n) for n, _, d in SINGLE]
    wrong = [F.when(~F.coalesce(parsed[g][n], F.lit(may[0])).isin(*may), f"{g}.{n}") for (g, n), may in CHOICES.items()]
    broken = F.when(parsed[_BAD].isNotNull() | ~text.rlike(r"^\s*\{"), "json")
    return F.struct(*filled, F.coalesce(broken, *wrong).alias("error"))
