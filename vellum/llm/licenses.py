"""License scans by ordered signature rules. Native.

A text's words (A-Z lower-cased; runs of digits, letters and characters beyond
ASCII) joined by single spaces are what signatures match. A rule has an anchor (the
word it begins with), a keyword, a pattern, a priority and a label. It is tried only
in texts that have its keyword as a word, there only at places of its anchor, and
only if the keyword stands within :data:`SPAN` words from there. So nearly all texts
stop at the keywords, and a place costs a few short matches, however long the text.

Of overlapping detections one is suppressed if it lies inside another of the same
or a better priority (smaller number); of equal intervals and priorities the first rule
counts. Base detections are never suppressed. The score is the confidence of the
best priority that is left.

Everything is one projection: array functions on a text's own words, no shuffle,
no row for each match, so no document or phrase makes a hot task. Containers start at
most SPAN words earlier, so suppression looks back over as many detections as these
words can hold.

Defined results: a null text counts as empty; a text without words or detections has
empty label strings, null first_word and last_word and a score of 0; repeated rows each
get their row; null ids are carried; only id and text are read.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from vellum.llm.rows import lowered, picked

#: What parts words once A-Z is lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the longest match.
SPAN = 28
#: Priorities: whole texts, identifiers and base phrases; a name that a text is put under; a name with a version; a family or a hint.
WHOLE, PUT_UNDER, NAMED, FAMILY = 1, 2, 3, 4
CONFIDENCE = {WHOLE: 1.0, PUT_UNDER: 0.9, NAMED: 0.7, FAMILY: 0.4}


class Rule(NamedTuple):
    anchor: str
    keyword: str
    pattern: str
    priority: int
    label: str
    base: bool = False


def _version(number: str) -> str:
    """A version after a name: ``version 3``, ``v 3``, ``v3``, ``3 0``."""
    return rf"(?: version| v)? v?{number}"


#: Phrases of the contract and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_L = "licen[sc]e"
#: Names of licenses: label, keyword, priority, pattern. A pattern begins with a literal word.
NAMES = (
    ("mit", "mit", NAMED, rf"mit {_L}"),
    ("mit", "x11", NAMED, rf"x11 {_L}"),
    ("mit", "expat", NAMED, rf"expat {_L}"),
    ("apache-1.1", "apache", NAMED, rf"apache(?: software)? {_L}{_version('1 1')}"),
    ("apache-2", "apache", NAMED, rf"apache(?: software)?(?: {_L})?{_version('2')}(?: 0)?"),
    ("apache", "apache", FAMILY, rf"apache(?: software)? {_L}"),
    ("gpl-2", "gnu", NAMED, rf"gnu (?:general public {_L}|gpl){_version('2')}(?: 0)?"),
    ("gpl-3", "gnu", NAMED, rf"gnu (?:general public {_L}|gpl){_version('3')}(?: 0)?"),
    ("gpl", "gnu", FAMILY, rf"gnu (?:general public {_L}|gpl)"),
    ("gpl-2", "gpl", NAMED, rf"gpl{_version('2')}(?: 0)?"),
    ("gpl-3", "gpl", NAMED, rf"gpl{_version('3')}(?: 0)?"),
    ("gpl-2", "gplv2", NAMED, r"gplv2"),
    ("gpl-3", "gplv3", NAMED, r"gplv3"),
    ("gpl", "gpl", FAMILY, rf"gpl(?: {_L})?"),
    ("gpl-2", "public", NAMED, rf"general public {_L}{_version('2')}(?: 0)?"),
    ("gpl-3", "public", NAMED, rf"general public {_L}{_version('3')}(?: 0)?"),
    ("gpl", "public", FAMILY, rf"general public {_L}"),
    ("lgpl-2", "lesser", NAMED, rf"gnu (?:lesser|library) general public {_L}{_version('2')}(?: 0)?"),
    ("lgpl-2.1", "lesser", NAMED, rf"gnu lesser general public {_L}{_version('2 1')}"),
    ("lgpl-3", "lesser", NAMED, rf"gnu lesser general public {_L}{_version('3')}(?: 0)?"),
    ("lgpl", "lesser", FAMILY, rf"gnu lesser general public {_L}"),
    ("lgpl-2.1", "lgpl", NAMED, rf"lgpl{_version('2 1')}"),
    ("lgpl-3", "lgpl", NAMED, rf"lgpl{_version('3')}(?: 0)?"),
    ("lgpl-2.1", "lgplv2", NAMED, r"lgplv2(?: 1)?"),
    ("lgpl-3", "lgplv3", NAMED, r"lgplv3"),
    ("lgpl", "lgpl", FAMILY, rf"lgpl(?: {_L})?"),
    ("agpl-3", "affero", NAMED, rf"gnu affero general public {_L}(?:{_version('3')}(?: 0)?)?"),
    ("agpl-3", "agpl", NAMED, rf"agpl{_version('3')}(?: 0)?"),
    ("agpl-3", "agplv3", NAMED, r"agplv3"),
    ("gfdl", "documentation", NAMED, rf"gnu free documentation {_L}"),
    ("gfdl", "gfdl", NAMED, r"gfdl"),
    ("bsd-2-clause", "bsd", NAMED, r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", NAMED, r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", NAMED, r"bsd 4 clause"),
    ("0bsd", "bsd", NAMED, r"bsd zero clause"),
    ("0bsd", "0bsd", NAMED, r"0bsd"),
    ("bsd-2-clause", "bsd", NAMED, r"2 clause bsd"),
    ("bsd-3-clause", "bsd", NAMED, r"3 clause bsd"),
    ("bsd-2-clause", "bsd", NAMED, rf"simplified bsd {_L}"),
    ("bsd-3-clause", "bsd", NAMED, rf"modified bsd {_L}"),
    ("bsd-3-clause", "bsd", NAMED, rf"new bsd {_L}"),
    ("bsd", "bsd", FAMILY, rf"bsd(?: style)? {_L}"),
    ("isc", "isc", NAMED, rf"isc {_L}"),
    ("mpl-1.1", "mozilla", NAMED, rf"mozilla public {_L}{_version('1 1')}"),
    ("mpl-2", "mozilla", NAMED, rf"mozilla public {_L}{_version('2')}(?: 0)?"),
    ("mpl", "mozilla", FAMILY, rf"mozilla public {_L}"),
    ("mpl-2", "mpl", NAMED, rf"mpl{_version('2')}(?: 0)?"),
    ("epl-1", "eclipse", NAMED, rf"eclipse public {_L}{_version('1')}(?: 0)?"),
    ("epl-2", "eclipse", NAMED, rf"eclipse public {_L}{_version('2')}(?: 0)?"),
    ("cddl-1", "cddl", NAMED, rf"cddl(?:{_version('1')}(?: [01])?)?"),
    ("cddl-1", "distribution", NAMED, rf"common development and distribution {_L}"),
    ("cpl-1", "common", NAMED, rf"common public {_L}"),
    ("eupl-1.2", "eupl", NAMED, rf"eupl{_version('1 2')}"),
    ("eupl", "european", FAMILY, rf"european union public {_L}"),
    ("unlicense", "unlicense", NAMED, r"unlicense"),
    ("wtfpl", "wtfpl", NAMED, r"wtfpl"),
    ("zlib", "zlib", NAMED, rf"zlib(?: libpng)? {_L}"),
    ("bsl-1", "boost", NAMED, rf"boost software {_L}"),
    ("artistic-1", "artistic", NAMED, rf"artistic {_L}{_version('1')}(?: 0)?"),
    ("artistic-2", "artistic", NAMED, rf"artistic {_L}{_version('2')}(?: 0)?"),
    ("artistic", "artistic", FAMILY, rf"artistic {_L}"),
    ("psf-2", "python", NAMED, rf"python software foundation {_L}"),
    ("ruby", "ruby", NAMED, rf"ruby {_L}"),
    ("php-3", "php", NAMED, rf"php {_L}"),
    ("postgresql", "postgresql", NAMED, rf"postgresql {_L}"),
    ("openssl", "openssl", NAMED, rf"openssl {_L}"),
    ("ofl-1.1", "font", NAMED, rf"sil open font {_L}"),
    ("cc0", "cc0", NAMED, r"cc0(?: 1 0)?"),
    ("cc0", "zero", NAMED, r"creative commons zero"),
    ("cc-by", "cc", NAMED, r"cc by(?: [234] \d)?"),
    ("cc-by-sa", "cc", NAMED, r"cc by sa(?: [234] \d)?"),
    ("cc-by-nd", "cc", NAMED, r"cc by nd(?: [234] \d)?"),
    ("cc-by-nc", "cc", NAMED, r"cc by nc(?: [234] \d)?"),
    ("cc-by-nc-sa", "cc", NAMED, r"cc by nc sa(?: [234] \d)?"),
    ("cc-by-nc-nd", "cc", NAMED, r"cc by nc nd(?: [234] \d)?"),
    ("cc-by", "attribution", NAMED, rf"creative commons attribution(?: [234] \d)?(?: international)?(?: public)?(?: {_L})?"),
    ("cc-by-sa", "sharealike", NAMED, rf"creative commons attribution sharealike(?: [234] \d)?(?: international)?(?: public)?(?: {_L})?"),
    ("cc-by-sa", "share", NAMED, rf"creative commons attribution share alike(?: [234] \d)?(?: international)?(?: public)?(?: {_L})?"),
    ("cc-by-nd", "noderivatives", NAMED, rf"creative commons attribution noderivatives(?: [234] \d)?(?: international)?(?: {_L})?"),
    ("cc-by-nc", "noncommercial", NAMED, rf"creative commons attribution noncommercial(?: [234] \d)?(?: international)?(?: public)?(?: {_L})?"),
    ("cc-by-nc-sa", "noncommercial", NAMED, rf"creative commons attribution noncommercial share ?alike(?: [234] \d)?(?: international)?(?: {_L})?"),
    ("cc-by-nc-nd", "noncommercial", NAMED, rf"creative commons attribution noncommercial no ?deriv(?:ative)?s(?: [234] \d)?(?: international)?(?: {_L})?"),
    ("cc", "commons", FAMILY, rf"creative commons {_L}"),
    ("odbl-1", "odbl", NAMED, r"odbl"),
    ("odbl-1", "database", NAMED, rf"open database {_L}"),
    ("pddl-1", "pddl", NAMED, r"pddl"),
    ("ms-pl", "microsoft", NAMED, rf"microsoft public {_L}"),
    ("ncsa", "ncsa", NAMED, rf"ncsa(?: open source)? {_L}"),
    ("afl-3", "academic", NAMED, rf"academic free {_L}"),
    ("osl-3", "osl", NAMED, rf"osl{_version('3')}(?: 0)?"),
    ("cecill-2.1", "cecill", NAMED, rf"cecill(?:{_version('2')}(?: [01])?)?"),
    ("beerware", "beerware", NAMED, rf"beerware {_L}"),
    ("upl-1", "permissive", NAMED, rf"universal permissive {_L}"),
    ("elastic-2", "elastic", NAMED, rf"elastic {_L}{_version('2')}(?: 0)?"),
    ("sspl-1", "server", NAMED, rf"server side public {_L}"),
    ("busl-1.1", "business", NAMED, rf"business source {_L}"),
    ("openrail", "openrail", NAMED, r"openrail(?: m)?"),
)

#: Words that put a text under what follows them: anchor, pattern.
CARRIERS = (
    ("licensed", r"licensed (?:under|according to)"),
    ("released", r"released under"),
    ("distributed", r"distributed under"),
    ("published", r"published under"),
    ("available", r"available under"),
    ("provided", r"provided under"),
    ("covered", r"covered by"),
    ("governed", r"governed by"),
    ("subject", r"subject to"),
)

#: Phrases of license texts and notices: label, keyword, priority, pattern.
TEXTS = (
    ("mit", "permission", WHOLE, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", WHOLE, r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution", WHOLE, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", WHOLE, r"neither the name of (?:\S+ ){1,8}nor the names of its contributors may be used to endorse"),
    ("gpl", "redistribute", WHOLE, r"this program is free software you can redistribute it and or modify"),
    ("apache-2", "compliance", WHOLE, r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("mpl-2", "mozilla", WHOLE, r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unencumbered", WHOLE, r"this is free and unencumbered software released into the public domain"),
    ("zlib", "warranty", WHOLE, r"this software is provided as is without any express or implied warranty"),
    ("bsl-1", "permission", WHOLE, r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("public-domain", "domain", NAMED, r"released (?:in)?to the public domain"),
    ("public-domain", "domain", NAMED, r"dedicated to the public domain"),
    ("public-domain", "domain", NAMED, r"placed in the public domain"),
    ("cc0", "waived", NAMED, r"waived all copyright and related"),
    ("all-rights-reserved", "reserved", FAMILY, r"all rights reserved"),
    ("non-commercial", "commercial", FAMILY, r"for non commercial (?:use|purposes) only"),
    ("proprietary", "proprietary", FAMILY, r"proprietary and confidential"),
)


def rules() -> tuple[Rule, ...]:
    """All rules in order: base phrases, texts, identifiers, names behind carriers, names. A name's own anchor is its first word."""
    first = lambda p: p.split(" ")[0].split("(")[0]
    base = [Rule(first(p), p.split(" ")[-2] if p.startswith("under") else first(p), p, WHOLE, label, True) for p, label in BASE]
    texts = [Rule(first(p), k, p, priority, label) for label, k, priority, p in TEXTS]
    tagged = [Rule("spdx", k, rf"spdx license identifier {p}", WHOLE, label) for label, k, priority, p in NAMES]
    carried = [Rule(a, k, rf"{c}(?: the)?(?: terms of)?(?: the| an?)? {p}", PUT_UNDER if priority == NAMED else NAMED, label) for a, c in CARRIERS for label, k, priority, p in NAMES]
    plain = [Rule(first(p), k, p, priority, label) for label, k, priority, p in NAMES]
    return (*base, *texts, *tagged, *carried, *plain)


RULES = rules()


def words_of(text: Column) -> Column:
    """Words of a text that is lower-cased."""
    return F.array_remove(F.split(text, BREAKS), "")


def _constant(value: object, schema: str) -> Column:
    """A literal of any type: the optimizer folds it once."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def scan(docs: DataFrame, table: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, found, kept: a row for each row of ``docs``.

    ``found`` has all detections as (start, end, priority, rule, label, base), ordered by
    start, longest first; ``kept`` those that are left. Words count from 0, ``end`` is the
    word after the last.
    """
    keywords = sorted({r.keyword for r in table})
    most = max(sum(r.anchor == a for r in table) for a in {r.anchor for r in table})  # detections that one place can have
    every = _constant([{"n": n, "a": r.anchor, "k": r.keyword, "re": f"^(?:{r.pattern})(?= |$)", "p": r.priority, "l": r.label, "b": r.base} for n, r in enumerate(table)], "array<struct<n:int,a:string,k:string,re:string,p:int,l:string,b:boolean>>")
    df = picked(docs, id_col, text_col).select("doc_id", words_of(lowered(F.col("text"))).alias("words"))
    df = df.withColumn("_keys", F.array_intersect("words", F.array(*map(F.lit, keywords))))
    df = df.withColumn("_live", F.when(F.size("_keys") > 0, F.filter(every, lambda r: F.array_contains("_keys", r["k"]))))
    df = _settled(df.withColumn("_anchors", F.array_distinct(F.transform("_live", lambda r: r["a"]))))
    # places of anchors, and the words from there
    places = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("_anchors", w), i)), lambda i: i.isNotNull())
    df = _settled(df.withColumn("_at", F.when(F.size("_live") > 0, places)))
    ahead = lambda i: F.struct(i.alias("i"), F.get("words", i).alias("w"), F.array_join(F.slice("words", i + 1, SPAN), " ").alias("s"))
    text = lambda x, r: F.call_function("regexp_extract", x["s"], r["re"], F.lit(0))
    tried = lambda x: F.filter("_live", lambda r: (r["a"] == x["w"]) & F.contains(x["s"], r["k"]) & (text(x, r) != ""))
    found = lambda x: F.transform(tried(x), lambda r: F.struct(x["i"].alias("start"), (-x["i"] - F.size(F.split(text(x, r), " "))).alias("back"), r["p"].alias("priority"), r["n"].alias("rule"), r["l"].alias("label"), r["b"].alias("base")))
    df = _settled(df.withColumn("_seen", F.array_sort(F.flatten(F.transform(F.transform("_at", ahead), found)))))
    none = F.array().cast("array<struct<start:int,back:int,priority:int,rule:int,label:string,base:boolean>>")
    df = _settled(df.withColumn("_seen", F.coalesce("_seen", none)))
    before = lambda i: F.slice("_seen", F.greatest(i - SPAN * most, F.lit(0)) + 1, F.least(i, F.lit(SPAN * most)))
    inside = lambda d, i: F.exists(before(i), lambda e: (e["back"] <= d["back"]) & (e["priority"] <= d["priority"]))
    df = df.withColumn("_kept", F.filter("_seen", lambda d, i: d["base"] | ~inside(d, i)))
    shown = lambda c: F.transform(c, lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label"), d["base"].alias("base")))
    return df.select("doc_id", F.size("words").cast("long").alias("n_words"), shown("_seen").alias("found"), shown("_kept").alias("kept"))


def _settled(df: DataFrame) -> DataFrame:
    """Keeps the optimizer from working a column out anew inside the lambdas that name it: a filter on a value that is not deterministic stays where it is."""
    return df.withColumn("_pin", F.monotonically_increasing_id()).where("_pin >= 0").drop("_pin")


def license_scan(docs: DataFrame, table: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row for each row of ``docs``."""
    df = _settled(scan(docs, table, id_col, text_col))
    df = df.withColumn("_base", F.filter("found", lambda d: d["base"]))
    starts = F.transform("_base", lambda d: d["start"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"]))), ",")
    sure = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    best = F.array_min(F.transform("kept", lambda d: d["priority"]))
    return df.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels("_base").alias("base_labels"),
        labels("kept").alias("labels"),
        F.coalesce(F.element_at(sure, best), F.lit(0.0)).alias("score"),
    )
