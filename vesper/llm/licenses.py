"""License scan: exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is a window of ``SPAN`` words, one beginning at every ``STEP``-th word of a text, over lines and marks; so every
notice of up to ``SPAN - STEP`` words stands whole in one, however its lines are broken. Its set are its pairs of neighbouring
words. A template is contained in a block where at least ``percent`` of its pairs stand in it, among them those that tell it from
like templates. All such pairs of block and template are found, as in a prefix-filter join:

1. one pass over the texts leaves of each the pairs that any template has, and their places where they are enough for one;
2. the pairs are ordered by the number of texts of the whole corpus that hold them, rarest first;
3. prefix filter: of a template with ``n`` pairs of which ``need`` are needed, a block that contains it holds one of
   the first ``n - need + 1``; blocks are joined with the index (pair, template, place) of the prefixes alone;
4. length filter: the block has ``need`` pairs at least. Positional filter: from the first common pair on,
   template and block both have ``need`` pairs left in the common order;
5. what is left is verified on the full sets.

Templates are a bounded parameter (``MOST`` pairs over all of them), so their index is broadcast; texts
are never shuffled. Fixed phrases are found besides, by the places of their words.

Defined results: null and empty texts have no words, blocks or labels. Repeated rows give repeated
results. Null keys are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import bound
from ._session import saved, ship

MOST = 5000

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

SPAN, STEP = 48, 24

# Sentences of license notices, of STEP words at most, with the labels of this method.
TEMPLATES = {
    "released under the mit license": "notice-mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "notice-mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "notice-mit",
    "licensed under the apache license version 2 0": "notice-apache-2.0",
    "you may not use this file except in compliance with the license": "notice-apache-2.0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "notice-apache-2.0",
    "this work is licensed under the gnu general public license version 3": "notice-gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "notice-gpl",
    "this program is distributed in the hope that it will be useful but without any warranty": "notice-gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "notice-lgpl",
    "this library is distributed in the hope that it will be useful but without any warranty": "notice-lgpl",
    "licensed under cc by nc 4 0": "notice-cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "notice-cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "notice-cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "notice-bsd",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "notice-bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "notice-isc",
    "this source code form is subject to the terms of the mozilla public license": "notice-mpl",
    "this is free and unencumbered software released into the public domain": "notice-unlicense",
    "all rights reserved no part of this publication may be reproduced": "notice-reserved",
}

# The word pairs without which a template isn't the one its label says.
TELLING = {
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": ["gnu general", "this program"],
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": ["lesser general"],
    "this program is distributed in the hope that it will be useful but without any warranty": ["this program"],
    "this library is distributed in the hope that it will be useful but without any warranty": ["this library"],
    "licensed under cc by nc 4 0": ["by nc"],
    "licensed under cc by sa 4 0": ["by sa"],
    "released under the mit license": ["mit license"],
    "licensed under the apache license version 2 0": ["apache license"],
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_IN = r"0-9A-Za-z\x{80}-\x{10FFFF}"
WORD = f"[{_IN}]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _phrase(phrase: str) -> str:
    return rf"(?<![{_IN}])" + f"[^{_IN}]+".join(map(re.escape, phrase.split())) + rf"(?![{_IN}])"


def phrases(df: DataFrame, text: Column, known: dict[str, str] = PHRASES) -> DataFrame:
    """Add n_base (places of any phrase), first_word, last_word and base (array of labels) to a table with n_words.

    Phrases must not overlap each other: no phrase's first word may stand within another or within itself again.
    Texts that hold no phrase's first and last words are not searched any further.
    """
    firsts = {p.split()[0] for p in known}
    if any(w in firsts for p in known for w in p.split()[1:]):
        raise ValueError("phrases may overlap")
    any_ = "|".join(_phrase(p) for p in known)
    plain = F.coalesce(text, F.lit(""))
    low = F.lower(plain)
    maybe = F.lit(False)
    for p in known:
        maybe |= low.contains(p.split()[0]) & low.contains(p.split()[-1])
    out = df.withColumn("_low", F.when(maybe, lowered(text)))
    out = out.withColumn("_parts", F.when(F.col("_low").isNotNull(), F.split("_low", any_)))
    out = out.withColumn("n_base", F.coalesce(F.size("_parts") - 1, F.lit(0)).cast("long"))
    hit = F.col("n_base") > 0
    first = F.size(words(F.element_at("_parts", 1)))
    last_phrase = F.element_at(F.regexp_extract_all("_low", F.lit(f"({any_})"), F.lit(1)), -1)
    last = F.col("n_words") - F.size(words(F.element_at("_parts", -1))) - F.size(words(last_phrase))
    out = out.withColumn("first_word", F.when(hit, first.cast("long"))).withColumn("last_word", F.when(hit, last.cast("long")))
    labels = F.array(*[F.when(hit & F.col("_low").rlike(_phrase(p)), label) for p, label in known.items()])
    out = out.withColumn("base", F.when(hit, F.array_sort(F.array_distinct(F.array_compact(labels)))).otherwise(F.array().cast("array<string>")))
    return out.drop("_low", "_parts")


def _index(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small literal table, made by the JVM."""
    made = F.array(*[F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(n) for v, n in zip(row, names)]) for row in rows])
    return spark.range(1).select(F.explode(made).alias("r")).select("r.*")


def pairs_of(text: str) -> list[str]:
    """The distinct pairs of neighbouring words, in order."""
    w = text.split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def tokens(text: Column, vocabulary: list[str], least: int) -> Column:
    """A struct of n_words, own (the vocabulary's pairs that the text has) and places (pos and pair of each, where it has ``least`` at least)."""
    known = F.array(*map(F.lit, vocabulary))

    def places(grams: Column, own: Column) -> Column:
        numbered = F.transform(grams, lambda x, i: F.struct(i.alias("pos"), x.alias("w")))
        return F.when(F.size(own) >= least, F.filter(numbered, lambda p: F.array_contains(own, p["w"])))

    def of_grams(grams: Column) -> Column:
        return bound(F.array_intersect(grams, known), lambda own: F.struct(own.alias("own"), places(grams, own).alias("places")))

    def of_words(w: Column) -> Column:
        grams = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        return bound(bound(grams, of_grams), lambda m: F.struct(F.size(w).cast("long").alias("n_words"), m["own"].alias("own"), m["places"].alias("places")))

    return bound(words(F.lower(F.coalesce(text, F.lit("")))), of_words)


def blocks(found: DataFrame) -> DataFrame:
    """(rid, block, words): the vocabulary's pairs in each window; a window holds ``SPAN`` words at most, so no group is large."""
    at = found.where("places is not null").select("rid", F.explode("places").alias("p")).select("rid", "p.*")
    last = F.floor(F.col("pos") / STEP).cast("int")
    # a pair stands in the window that begins at or before it, and in earlier ones that reach over its second word
    earlier = F.greatest(F.lit(0), F.ceil((F.col("pos") + 2 - SPAN) / STEP).cast("int"))
    each = at.withColumn("block", F.explode(F.sequence(F.least(earlier, last), last)))
    return each.groupBy("rid", "block").agg(F.collect_set("w").alias("words"))


def frequencies(found: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many texts of the corpus each pair of the bounded vocabulary stands."""
    got = {r["w"]: r["n"] for r in found.select(F.explode("own").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: got.get(w, 0) for w in vocabulary}


def contained(found: DataFrame, templates: dict[str, str], vocabulary: list[str], needs: dict[str, int]) -> DataFrame:
    """(rid, block, template, label, containment) of every block and template that it contains."""
    order = {w: i for i, (_, w) in enumerate(sorted((n, w) for w, n in frequencies(found, vocabulary).items()))}
    rows = []
    for number, (template, label) in enumerate(templates.items()):
        ordered, need = sorted(pairs_of(template), key=order.__getitem__), needs[template]
        rows += [(w, number, label, place, len(ordered), need, ordered, TELLING.get(template) or ordered[:0] or [""]) for place, w in enumerate(ordered[: len(ordered) - need + 1])]
    index = _index(found.sparkSession, rows, ["w", "template", "label", "place", "n", "need", "ordered", "telling"])
    prefixes = F.array(*[F.lit(w) for w in sorted({r[0] for r in rows}, key=order.__getitem__)])
    lines = blocks(found).where((F.size("words") >= min(needs.values())) & F.arrays_overlap("words", prefixes))
    # the block's pairs in the common order
    ranked = F.array(*[F.lit(w) for w in sorted(vocabulary, key=order.__getitem__)])
    maybe = lines.select("rid", "block", F.array_intersect(ranked, "words").alias("_own"))
    each = maybe.withColumn("w", F.explode(F.array_intersect("_own", prefixes)))
    pairs = each.join(F.broadcast(index), "w")  # at most MOST rows times templates
    first = F.element_at(F.array_intersect("ordered", "_own"), 1)  # the pair is taken at its first common token alone
    left = F.size("_own") - F.array_position("_own", F.col("w")) + 1
    pairs = pairs.where((F.col("w") == first) & (F.size("_own") >= F.col("need")) & (F.col("n") - F.col("place") >= F.col("need")) & (left >= F.col("need")))
    common = F.size(F.array_intersect("ordered", "_own"))
    told = F.size(F.array_except("telling", F.array_append("_own", F.lit("")))) == 0
    return pairs.where((common >= F.col("need")) & told).select("rid", "block", "template", "label", (common / F.col("n")).alias("containment"))


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", *, templates: dict[str, str] = TEMPLATES, percent: int = 80) -> DataFrame:
    """A row per row of ``df``: key, n_words, n_base, first_word, last_word, base, labels (both), score, blocks (matches).

    The score is 1 with a phrase, else the largest containment (0 without any). What is written and joined after the one
    pass over the texts are digests and places, never texts.
    """
    ship(df.sparkSession)
    if any(len(t.split()) > STEP for t in templates):
        raise ValueError(f"templates have over {STEP} words")
    vocabulary = sorted({w for t in templates for w in pairs_of(t)})
    if len(vocabulary) > MOST:
        raise ValueError(f"templates have over {MOST} pairs")
    needs = {t: -(-percent * len(pairs_of(t)) // 100) for t in templates}
    named = df.select(F.col(key).alias("key"), F.col(text).alias("text"), tokens(F.col(text), vocabulary, min(needs.values())).alias("t"))
    named = phrases(named.select("key", "text", "t.*"), F.col("text")).drop("text")
    base = saved(named.withColumn("rid", F.monotonically_increasing_id()), "tokens")
    found = contained(base, templates, vocabulary, needs)
    found = found.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("block", "template", "label", "containment"))).alias("blocks"))
    out = base.drop("own", "places").join(found, "rid", "left")
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce(F.transform("blocks", lambda b: b["label"]), F.array().cast("array<string>")))))
    return out.select(F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", "base", labels.alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"), "blocks")


def oracle(percent: int = 80) -> str:
    """DuckDB SQL for the digest of ``scan``: brute force over all blocks and templates."""
    in_ = "[0-9a-z\\x{80}-\\x{10FFFF}]"
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[]"
    values = ", ".join(f"({quoted(pairs_of(t))}, {quoted(TELLING.get(t, []))}, '{label}')" for t, label in TEMPLATES.items())
    base = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS low FROM documents),
tok AS (SELECT r, doc_id, low, regexp_extract_all(low, '{in_}+') AS w FROM docs),
phr AS (SELECT p, label, n, string_split(p, ' ') AS pw FROM (VALUES {base}) t(p, label, n)),
places AS (SELECT r, label, i - 1 AS pos FROM tok, phr, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE (contains(low, 'license') OR contains(low, 'cc')) AND w[i] = pw[1] AND w[i:i + n - 1] = pw),
based AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base FROM places GROUP BY r),
tmpl AS (SELECT * FROM (VALUES {values}) v(tw, must, label)),
wins AS (SELECT r, w[s + 1:s + {SPAN}] AS bw FROM (SELECT r, regexp_extract_all(lower(low), '{in_}+') AS w, unnest(range(0, len(w), {STEP})) AS s FROM tok)),
sets AS (SELECT r, list_distinct(list_transform(range(1, len(bw)), lambda i: bw[i] || ' ' || bw[i + 1])) AS b2 FROM wins),
hits AS (SELECT r, label, len(list_intersect(tw, b2)) / len(tw)::DOUBLE AS c FROM sets, tmpl WHERE 100 * len(list_intersect(tw, b2)) >= {percent} * len(tw) AND len(list_intersect(must, b2)) = len(must)),
found AS (SELECT r, list(DISTINCT label) AS labels, max(c) AS c FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM tok LEFT JOIN based USING (r) LEFT JOIN found USING (r)
"""
