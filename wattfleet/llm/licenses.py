"""License scan by ordered signature rules, in DataFrame operations only.

Rules are regular expressions over the words of a text, lowered and joined by single
spaces. They come from a table of licenses and a few sentence frames. A rule runs only
on documents that hold its keyword and one of the words that no license notice lacks,
which leaves most documents out before any rule runs. Each rule has a priority.
Detections are intervals of words; one inside another of the same or a higher priority
is dropped, so that of the rules that see the same notice the most telling one speaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattfleet.llm.arrays import matches
from wattfleet.llm.decontaminate import words
from wattfleet.session import stored

#: Label, keyword, and the name as a pattern of words. A version may follow each name.
LICENSES = [
    ("mit", "mit", "mit"), ("mit", "expat", "expat"), ("x11", "x11", "x11"),
    ("apache", "apache", "apache(?: software)?"), ("bsd", "bsd", "(?:new |modified |simplified |revised )?bsd"),
    ("bsd-2-clause", "bsd", "(?:2|two) clause bsd|bsd (?:2|two) clause"),
    ("bsd-3-clause", "bsd", "(?:3|three) clause bsd|bsd (?:3|three) clause"),
    ("bsd-4-clause", "bsd", "(?:4|four) clause bsd|bsd (?:4|four) clause"),
    ("0bsd", "0bsd", "0bsd"), ("gpl", "gpl", "(?:gnu )?gpl"), ("gpl", "public", "(?:gnu )?general public"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"), ("lgpl", "lesser", "(?:gnu )?lesser general public"),
    ("lgpl", "library", "(?:gnu )?library general public"), ("agpl", "agpl", "(?:gnu )?agpl"),
    ("agpl", "affero", "(?:gnu )?affero general public"), ("gfdl", "gfdl", "gfdl"),
    ("gfdl", "documentation", "(?:gnu )?free documentation"), ("mpl", "mozilla", "mozilla public"), ("mpl", "mpl", "mpl"),
    ("epl", "eclipse", "eclipse public"), ("epl", "epl", "epl"), ("edl", "eclipse", "eclipse distribution"),
    ("cddl", "cddl", "cddl"), ("cddl", "development", "common development and distribution"), ("cpl", "common", "common public"),
    ("ipl", "ibm", "ibm public"), ("isc", "isc", "isc"), ("zlib", "zlib", "zlib(?: libpng)?"), ("libpng", "libpng", "libpng"),
    ("boost", "boost", "boost software"), ("boost", "bsl", "bsl"), ("artistic", "artistic", "artistic"),
    ("python", "python", "python(?: software foundation)?"), ("php", "php", "php"), ("ruby", "ruby", "ruby"),
    ("perl", "perl", "perl"), ("postgresql", "postgresql", "postgresql"), ("openssl", "openssl", "openssl"),
    ("unlicense", "unlicense", "unlicense"), ("wtfpl", "wtfpl", "wtfpl"), ("eupl", "eupl", "eupl"),
    ("eupl", "european", "european union public"), ("afl", "academic", "academic free"), ("osl", "open", "open software"),
    ("ofl", "ofl", "(?:sil )?ofl"), ("ofl", "font", "(?:sil )?open font"), ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    ("ms-pl", "microsoft", "microsoft public"), ("ms-rl", "microsoft", "microsoft reciprocal"), ("qpl", "qpl", "qpl|q public"),
    ("cecill", "cecill", "cecill"), ("sspl", "server", "server side public"), ("busl", "business", "business source"),
    ("elastic", "elastic", "elastic"), ("vim", "vim", "vim"), ("json", "json", "json"), ("icu", "icu", "icu"),
    ("ecl", "educational", "educational community"), ("upl", "universal", "universal permissive"), ("blueoak", "oak", "blue oak model"),
    ("odbl", "odbl", "odbl"), ("odbl", "database", "open database"), ("cc0", "cc0", "cc0|creative commons zero"),
    ("cc-by", "creative", "creative commons attribution"), ("cc-by", "cc", "cc by"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike"), ("cc-by-sa", "cc", "cc by sa"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial"), ("cc-by-nc", "cc", "cc by nc"),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:ative)?s"), ("cc-by-nd", "cc", "cc by nd"),
]
_VERSION = "(?: (?:version |v)?[0-9]{1,2}(?: [0-9]{1,2})?(?: only| or (?:any )?later)?| v[0-9]{1,2}(?: [0-9]{1,2})?)?"
_LICENSE = "(?:licen[sc]es?|licen[sc]ing)"
#: Priority, confidence, and the sentence around a name. Higher priorities say more.
FRAMES = [
    (50, 0.95, "spdx " + _LICENSE + " identifier {name}" + _VERSION),
    (40, 0.90, "(?:(?:dual )?licensed|released|distributed|available|published|provided|made available|redistribute it) "
               "(?:under|by|with|according to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}(?: public)?"
               "(?: " + _LICENSE + ")?" + _VERSION),
    (30, 0.80, "(?:subject to|under|see|covered by|governed by) (?:the )?(?:terms of )?(?:the )?{name} " + _LICENSE + _VERSION),
    (20, 0.60, "(?:the )?{name} " + _LICENSE + _VERSION),
    (15, 0.55, "{name}" + _VERSION + " " + _LICENSE),
]
#: Label, keyword and a sentence of the license's own text.
TEXTS = [
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "warranty", "the software is provided as is without warranty of any kind"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose"),
    ("gpl", "free", "this program is free software you can redistribute it and or modify it"),
    ("gpl", "foundation", "as published by the free software foundation"),
    ("apache", "compliance", "you may not use this file except in compliance with the license"),
    ("zlib", "origin", "the origin of this software must not be misrepresented"),
    ("unlicense", "domain", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "want", "you just do what the fuck you want to"),
    ("boost", "machine", "machine executable object code generated by a source language processor"),
    ("public-domain", "domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("proprietary", "rights", "all rights reserved"),
    ("proprietary", "confidential", "confidential and proprietary"),
]
#: Phrases that are always reported, whatever the other rules say.
BASE = [("mit", "mit", "mit license"), ("apache", "apache", "apache license"), ("gpl", "general", "general public license")]
#: No notice lacks all of these words.
ANCHORS = ["license", "licence", "licenses", "licences", "licensed", "licensing", "licencing", "spdx", "copyright", "reserved",
           "granted", "domain", "permitted", "permission", "warranty", "compliance", "misrepresented", "proprietary", "redistribute",
           "endorse", "foundation", "want", "machine", "released", "distributed", "available", "published", "provided"]


def rules() -> list[tuple[int, int, float, str, str, str, bool]]:
    """Rows ``(rule, priority, confidence, label, keyword, pattern, base)`` in order of priority."""
    made = [(60, 0.9, label, keyword, text, False) for label, keyword, text in TEXTS]
    for priority, confidence, frame in FRAMES:
        made += [(priority, confidence, label, keyword, frame.replace("{name}", f"(?:{name})"), False) for label, keyword, name in LICENSES]
    made += [(0, 0.5, label, keyword, phrase, True) for label, keyword, phrase in BASE]
    # Words are whole: a space stands before the first and behind the last one.
    return [(i, p, c, label, key, f"(?<= )(?:{pattern})(?= )", base) for i, (p, c, label, key, pattern, base) in enumerate(made)]


def rule_table(spark: SparkSession) -> DataFrame:
    """`rules` as a table, of about 400 rows."""
    rows = [
        F.struct(
            F.lit(i).alias("rule"), F.lit(p).alias("priority"), F.lit(c).alias("confidence"), F.lit(label).alias("label"),
            F.lit(key).alias("keyword"), F.lit(pattern).alias("pattern"), F.lit(base).alias("base"),
        )
        for i, p, c, label, key, pattern, base in rules()
    ]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _places(line: Column, pattern: Column) -> Column:
    """First and last word of each match of a pattern in words joined and framed by spaces."""

    def spaces(text: Column) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")

    return F.transform(matches(line, pattern, spaces), lambda m: F.struct(
        (m["start"] - 1).alias("first"), (m["end"] - 1).alias("last")
    ))


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, text_hash, rule, priority, confidence, label, base, first, last, covered)`` before suppression."""
    rules_df = rule_table(docs.sparkSession)
    keywords = F.array(*[F.lit(k) for k in sorted({r[4] for r in rules()})])
    anchors = F.array(*[F.lit(a) for a in ANCHORS])
    listed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("w"))
    gated = listed.where(F.arrays_overlap("w", anchors)).select(
        "id", "text_hash", "w", F.array_intersect("w", keywords).alias("keys")
    ).where("size(keys) > 0")
    lines = gated.select("id", "text_hash", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("line"), F.explode("keys").alias("keyword"))
    # The rules are a constant of this module, about 100 kB.
    matched = lines.join(F.broadcast(rules_df), "keyword").where(F.regexp_like("line", F.col("pattern")))
    places = matched.select(
        "id", "text_hash", "rule", "priority", "confidence", "label", "base",
        F.explode(_places(F.col("line"), F.col("pattern"))).alias("p"),
    ).distinct()
    flat = places.select("id", "text_hash", "rule", "priority", "confidence", "label", "base", "p.first", "p.last")
    return flat


def surviving(found: DataFrame) -> DataFrame:
    """`detections` without those inside the words of another one of the same or a higher priority."""
    order = Window.partitionBy("id", "text_hash").orderBy("first", F.desc("last"), F.desc("priority"), "rule")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r[1] for r in rules()})
    reached = F.lit(None).cast("long")
    for level in levels:
        end = F.max(F.when(F.col("priority") >= level, F.col("last"))).over(before)
        reached = F.when(F.col("priority") == level, end).otherwise(reached)
    inside = F.coalesce(reached >= F.col("last"), F.lit(False))
    return found.withColumn("_inside", inside).where("not _inside").drop("_inside")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, n_words, places, base_labels, labels, score, detections)``, one for each row of ``docs``.

    ``places`` are the starts of the base phrases, ``detections`` the surviving ones as
    structs, ``labels`` those of both, sorted, ``score`` the highest confidence or 0.
    Null texts have no words. An id with several texts is scanned text by text, repeated
    rows stay repeated, null ids stay. Other columns play no part.
    """
    found = stored(detections(docs, id_col, text_col), "detections")
    base = found.where("base").groupBy("id", "text_hash").agg(
        F.sort_array(F.collect_list("first")).alias("places"), F.sort_array(F.collect_set("label")).alias("base_labels"),
        F.max("confidence").alias("base_score"),
    )
    best = surviving(found).groupBy("id", "text_hash").agg(
        F.collect_set("label").alias("found_labels"), F.max("confidence").alias("found_score"),
        F.sort_array(F.collect_list(F.struct("first", "last", "label", "priority", "rule"))).alias("detections"),
    )
    both = best.alias("b").join(
        base.alias("a"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left"
    ).select("b.*", "a.places", "a.base_labels", "a.base_score")
    listed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    joined = listed.alias("d").join(
        both.alias("f"), F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.text_hash") == F.col("f.text_hash")), "left"
    )
    none = F.array().cast("array<string>")
    base_labels = F.coalesce("f.base_labels", none)
    return joined.select(
        F.col("d.id").alias(id_col), "d.n_words", F.coalesce("f.places", F.array().cast("array<bigint>")).alias("places"),
        base_labels.alias("base_labels"),
        F.sort_array(F.array_union(base_labels, F.coalesce("f.found_labels", none))).alias("labels"),
        F.coalesce(F.greatest("f.base_score", "f.found_score"), F.lit(0.0)).alias("score"), "f.detections",
    )
