"""License notices by an exact set-similarity join of text blocks with templates.

A text is cut into stretches of STRETCH words, whatever line feeds stand between them; a block is a few stretches in a
row, as many as hold the longest template wherever it begins, and every stretch begins one. A block matches a template
when it holds at least CONTAINMENT of the template's distinct words, about where the template has them. Words are ordered by how many stretches of the
whole corpus hold them, rarest first. A matching block must hold one of the first |t| - ceil(c |t|) + 1 words of a
template (prefix filter), have at least ceil(c |t|) distinct words of templates (length filter), and, from the place of
the shared word on, still have enough words left on both sides (positional filter). What passes is verified by the whole
intersection, so the join is exact, and then by places: of a word at place p of the block and j of the template the
distance is p - j, and as many words as are needed must have distances within |t| (1/c - 1) of each other, so words
that are scattered or in another order are no notice. Of templates of one family that match at one place, only the
most specific counts (most words held, then the largest containment), as one is a variant of the other. All of it is DataFrame expressions.

The templates are a fixed set of notices and license paragraphs, so their prefix table is a broadcast of bounded size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_path

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
CONTAINMENT = 0.85
STRETCH = 24
#: The phrases and labels asked for.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Common notices and paragraphs of license texts, lower-case words only, with the label each one gives.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
]
#: Labels whose notices are variants of each other.
FAMILIES = [("gpl", "lgpl"), ("cc-by", "cc-by-sa", "cc-by-nc")]


def family(label: str) -> int:
    """A number that labels of one family share; of other labels none that another label has."""
    return next((k for k, labels in enumerate(FAMILIES) if label in labels), len(FAMILIES) + sorted({x for x, _ in TEMPLATES} | {label}).index(label))


def slack(n: int, containment: float) -> int:
    """How far apart the distances of n words of a template may be."""
    return math.floor(n / containment - n + 1e-9)


def _lowered(text: Column) -> Column:
    """A-Z to lower case. The Kelvin sign is the one other letter that lower() would turn into an ASCII one."""
    return F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u2127")))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.expr("CAST(array() AS array<string>)")


def _stretches(low: Column) -> Column:
    """Stretches of STRETCH words, the last may have fewer. Possessive repeats: no position is tried twice."""
    return F.regexp_extract_all(low, F.lit(f"(?:{WORD}+{BETWEEN}*+){{1,{STRETCH}}}+"), F.lit(0))


def token_frequencies(held: DataFrame) -> dict[str, int]:
    """In how many stretches (column held_by of the texts) each template word stands; one row a template word reaches the driver."""
    words = F.explode(F.flatten(F.transform("held_by", lambda stretch: F.array_distinct(F.transform(stretch, lambda x: x["w"])))))
    return {r["word"]: r["n"] for r in held.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    same = lambda i: F.array(*[F.get(words, i + k) for k in range(len(parts))]) == _strings(parts)
    starts = F.when(F.size(words) >= len(parts), F.sequence(F.lit(0), F.size(words) - len(parts))).otherwise(F.expr("CAST(array() AS array<int>)"))
    return F.filter(starts, same)


def window_of(templates: list[tuple[str, str]]) -> int:
    """How many stretches a block has."""
    return math.ceil(max(len(text.split(" ")) for _, text in templates) / STRETCH) + 1


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    A null text is an empty one: no words, no labels (empty strings), score 0. The score is 1 where a phrase stands in
    the text, else the largest containment of a template that matched. Repeated rows each get a row of their own; no
    column but doc_id and text is read. Of a text, only the words of templates are put into arrays unless a phrase's last
    word is there.
    """
    sets = [(label, sorted(set(text.split(" ")))) for label, text in templates]
    vocabulary = sorted({w for _, words in sets for w in words})
    low = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", _lowered(F.col("text")).alias("low"))
    holds = F.lit(False)
    for last in sorted({p.split(" ")[-1] for p in phrases}):
        holds = holds | F.contains(F.col("low"), F.lit(last))
    rows = low.withColumns({"words": F.when(holds, _words(F.col("low"))).otherwise(F.expr("CAST(array() AS array<string>)")), "stretches": _stretches(F.col("low"))})
    n_words = F.when(F.size("stretches") > 0, (F.size("stretches") - 1) * STRETCH + F.regexp_count(F.element_at("stretches", -1), F.lit(WORD))).otherwise(0)
    held_by = F.transform("stretches", lambda stretch: F.filter(F.transform(_words(stretch), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(vocabulary)))
    path = fresh_path(docs.sparkSession, "license-words")  # texts are read once: what is counted and what is joined comes from here
    rows.select("row", "doc_id", n_words.cast("long").alias("n_words"), *[_places(F.col("words"), p).alias(f"at{k}") for k, p in enumerate(phrases)], held_by.alias("held_by")).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    frequency = token_frequencies(rows)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    table, wanted = [], set()
    for t, (label, words) in enumerate(sets):
        ranks, need = sorted(rank[w] for w in words), math.ceil(containment * len(words) - 1e-9)
        places = [(rank[w], j) for j, w in enumerate(templates[t][1].split(" "))]
        for place, r in enumerate(ranks[: len(ranks) - need + 1]):
            table.append((r, place, t, label, family(label), need, slack(len(templates[t][1].split(" ")), containment), ranks, places))
            wanted.add(r)
    prefix = docs.sparkSession.createDataFrame(table, "rank int, place int, template int, label string, family int, need int, slack int, ranks array<int>, places array<struct<r: int, j: int>>")
    rare = _strings([w for w, r in rank.items() if r in wanted])
    ranks_of = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])

    every = F.concat(*[F.col(f"at{k}") for k in range(len(phrases))])
    found = F.concat(*[F.when(F.size(f"at{k}") > 0, F.array(F.lit(label))).otherwise(F.expr("CAST(array() AS array<string>)")) for k, label in enumerate(phrases.values())])
    width = window_of(templates)
    near = F.transform("held_by", lambda _, i: F.flatten(F.transform(F.slice("held_by", i + 1, F.lit(width)), lambda stretch, k: F.transform(stretch, lambda x: F.struct(x["w"].alias("w"), (x["i"] + k * STRETCH).alias("i"))))))
    own = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    texts = rows.select("row", "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_distinct(found).alias("base"))
    blocks = rows.select("row", F.posexplode(near).alias("block", "words")).withColumn("words_of", F.array_distinct(F.transform("words", lambda x: x["w"]))).filter(F.arrays_overlap("words_of", rare))

    # The join: each block's prefix words meet the templates that have them in their prefix.
    held = F.array_sort(F.transform("words_of", lambda w: F.element_at(ranks_of, w)))
    met = blocks.select("row", "block", F.transform("words", lambda x: F.struct(F.element_at(ranks_of, x["w"]).alias("r"), x["i"].alias("i"))).alias("words"), held.alias("held")).withColumn("rank", F.explode("held")).join(F.broadcast(prefix), "rank")
    left = F.size("held") - F.array_position("held", F.col("rank")).cast("int")
    possible = F.lit(1) + F.array_position("held", F.col("rank")).cast("int") - 1 + F.least(left, F.size("ranks") - F.col("place") - 1)
    overlap = F.size(F.array_intersect("held", "ranks"))
    similar = met.filter((F.size("held") >= F.col("need")) & (possible >= F.col("need"))).withColumn("overlap", overlap).filter(F.col("overlap") >= F.col("need"))
    # The places: a word's distances to the places that the template has it at, and the most words within slack of one distance.
    away = F.flatten(F.transform("words", lambda x: F.transform(F.filter("places", lambda y: y["r"] == x["r"]), lambda y: F.struct((x["i"] - y["j"]).alias("d"), x["r"].alias("r")))))
    close = F.array_max(F.transform(F.array_distinct(F.transform("away", lambda x: x["d"])), lambda d: F.struct(F.size(F.array_distinct(F.transform(F.filter("away", lambda x: (x["d"] >= d) & (x["d"] <= d + F.col("slack"))), lambda x: x["r"]))).alias("n"), (-d).alias("back"))))
    placed = similar.dropDuplicates(["row", "block", "template"]).withColumn("away", away).withColumn("close", close).filter(F.col("close.n") >= F.col("need"))
    start = -F.col("close.back")
    matches = placed.groupBy("row", "block", "family").agg(F.collect_set(F.struct(F.struct(F.col("overlap").alias("n"), (F.col("overlap") / F.size("ranks")).alias("share")).alias("fit"), "label", start.alias("s"), (start + F.size("places")).alias("e"))).alias("all"))
    best = F.filter("all", lambda m: ~F.exists("all", lambda o: (o["fit"] > m["fit"]) & (o["s"] < m["e"]) & (m["s"] < o["e"])))
    labelled = matches.select("row", F.explode(best).alias("m")).groupBy("row").agg(F.collect_set("m.label").alias("more"), F.max("m.fit.share").alias("share"))
    done = texts.join(labelled, "row", "left").select(*own, F.coalesce("more", F.expr("CAST(array() AS array<string>)")).alias("more"), "share")
    joined = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return done.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(F.concat("base", "more")).alias("labels"), score.alias("score"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _oracle() -> str:
    """Every block against every template, without any filter."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"({t}, '{label}', {family(label)}, {quoted(sorted(set(text.split(' '))))}, {quoted(text.split(' '))}, {slack(len(text.split(' ')), CONTAINMENT)})" for t, (label, text) in enumerate(TEMPLATES))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    places = ", ".join(f"list_filter(range(len(w)), lambda i: w[i + 1 : i + {p.count(' ') + 1}] = {quoted(p.split(' '))})" for p in PHRASES)
    found = ", ".join(f"CASE WHEN len(pl[{k + 1}]) > 0 THEN '{v}' END" for k, v in enumerate(PHRASES.values()))
    return f"""
WITH t(t, label, family, ws, seq, slack) AS (VALUES {templates}),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS low FROM documents),
w AS (SELECT *, regexp_extract_all(low, '{WORD}') AS w FROM d),
p AS (SELECT r, doc_id, len(w) AS n_words, [{places}] AS pl FROM w),
b AS (SELECT r, doc_id, n_words, flatten(pl) AS every, list_filter([{found}], lambda x: x IS NOT NULL) AS base FROM p),
s AS (SELECT r, w, unnest(range(0, (len(w) + {STRETCH} - 1) // {STRETCH})) AS k FROM w),
l AS (SELECT r, k, w[k * {STRETCH} + 1 : (k + {window_of(TEMPLATES)}) * {STRETCH}] AS seq FROM s),
m AS (SELECT l.r, l.k, l.seq, t.t, t.label, t.family, t.ws, t.seq AS tseq, t.slack, len(list_intersect(list_distinct(l.seq), t.ws)) AS n FROM l, t WHERE len(list_intersect(list_distinct(l.seq), t.ws)) >= ceil({CONTAINMENT} * len(t.ws) - 1e-9)),
x AS (SELECT r, k, t, unnest(range(len(seq))) AS i, unnest(seq) AS word FROM m),
y AS (SELECT t, unnest(range(len(seq))) AS j, unnest(seq) AS word FROM t),
o AS (SELECT DISTINCT x.r, x.k, x.t, x.word, x.i - y.j AS d FROM x JOIN y ON y.t = x.t AND y.word = x.word),
c AS (SELECT a.r, a.k, a.t, a.d, count(DISTINCT z.word) AS n FROM (SELECT DISTINCT r, k, t, d FROM o) a JOIN t ON t.t = a.t JOIN o z ON z.r = a.r AND z.k = a.k AND z.t = a.t AND z.d BETWEEN a.d AND a.d + t.slack GROUP BY 1, 2, 3, 4),
q AS (SELECT r, k, t, max(struct_pack(n := n, back := -d)) AS best FROM c GROUP BY 1, 2, 3),
h AS (SELECT m.r, m.k, m.label, m.family, m.n / len(m.ws) AS share, struct_pack(n := m.n, share := m.n / len(m.ws)) AS fit, -q.best.back AS s, -q.best.back + len(m.tseq) AS e FROM m JOIN q USING (r, k, t) WHERE q.best.n >= ceil({CONTAINMENT} * len(m.ws) - 1e-9)),
g AS (SELECT r, list(DISTINCT label) AS more, max(share) AS share FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.r = h.r AND o.k = h.k AND o.family = h.family AND o.fit > h.fit AND o.s < h.e AND h.s < o.e) GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, CAST(list_min(every) AS BIGINT) AS first_word, CAST(list_max(every) AS BIGINT) AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
       CASE WHEN len(every) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM b LEFT JOIN g USING (r)
"""


ORACLE = _oracle()
