"""License scan: exact set-similarity join of text blocks with license templates (DataFrame functions only).

A block is a run of words of a document, over line ends too, as long as the template has words divided by
``threshold``. It meets a template when it holds at least ``threshold`` of the template's distinct words (containment)
and all of those that tell it from a template of which it would else be a near relative. Words are ordered globally by
how many documents hold them, rarest first. Windows of twice the longest block, half overlapping, stand for the blocks
that start in their first half: a window with a block that meets a template holds one of the template's first
``size - need + 1`` words (prefix filter), is long enough (length filter), and has enough words left after
the shared one in that order (positional filter). The blocks of the windows left are verified exactly.

Beside it, ``phrases`` counts exact phrases at word level. Words are maximal runs of ASCII letters, digits
and characters beyond ASCII, with A-Z lower-cased.

Defined cases: null text: empty, no words; repeated rows and repeated ids keep rows of their own; an empty
table gives an empty result; extra columns are ignored; a document without license text has score 0 and
empty labels.
"""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words, base phrases with their labels, and notice templates with the labels they add.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = [
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("this program is licensed under the gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
]
THRESHOLD = 0.8


def need_of(words: set[str], threshold: float) -> int:
    return math.ceil(threshold * len(words) - 1e-9)


def told_by(sets: list[set[str]], threshold: float) -> list[list[str]]:
    """For each template the words it needs: those that any other template lacks which holds enough of its words."""
    return [sorted(set().union(*(s - other for other in sets if other != s and len(s & other) >= need_of(s, threshold)))) for s in sets]


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(lowered_text: Column) -> Column:
    return F.filter(F.split(lowered_text, BREAK + "+"), lambda w: w != "")


def phrase_starts(words: Column, phrase: str) -> Column:
    """Indices of words at which ``phrase`` begins."""
    parts = phrase.split()
    return F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0))),
        lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(words, i + k) == p, F.lit(False)) for k, p in enumerate(parts)]),
    )


def phrases(rows: DataFrame, found: dict[str, str] = PHRASES) -> DataFrame:
    """``rows`` (with a column ``_text``, lower-cased) plus n_words, n_base, first_word, last_word, _base."""
    any_phrase = "(?:^|{0})(?:{1})(?:$|{0})".format(BREAK, "|".join(p.replace(" ", BREAK + "+") for p in found))
    words = F.when(F.col("_text").rlike(any_phrase), words_of(F.col("_text")))
    with_words = rows.withColumn("_words", words)
    starts = with_words.withColumns({f"_at{i}": phrase_starts(F.col("_words"), p) for i, p in enumerate(found)})
    places = F.array_sort(F.concat(*[F.coalesce(F.col(f"_at{i}"), F.array().cast("array<int>")) for i in range(len(found))]))
    labels = F.array(*[F.when(F.size(F.coalesce(F.col(f"_at{i}"), F.array().cast("array<int>"))) > 0, F.lit(x)) for i, x in enumerate(found.values())])
    return (
        starts.withColumn("_places", places)
        .withColumn("_base", F.array_sort(F.array_distinct(F.array_compact(labels))))
        .withColumn("n_words", F.regexp_count("_text", F.lit(WORD)).cast("long"))
        .withColumn("n_base", F.size("_places").cast("long"))
        .withColumn("first_word", F.get("_places", F.lit(0)).cast("long"))
        .withColumn("last_word", F.get("_places", F.size("_places") - 1).cast("long"))
        .drop("_words", "_places", *[f"_at{i}" for i in range(len(found))])
    )


def template_join(rows: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """All (row key, template) with the best containment of a block, where it meets ``threshold``.

    ``rows`` has ``_key`` and ``_text`` (lower-cased). The template side is a fixed list, so its words, their
    document counts and its posting list are bounded by the list and not by the data.
    """
    spark = rows.sparkSession
    sets = [set(t.split()) for t, _ in templates]
    vocabulary = sorted(set().union(*sets))
    held = F.array_intersect(F.split("_text", BREAK + "+"), F.array(*map(F.lit, vocabulary)))
    counts = {r[0]: r[1] for r in rows.select(F.explode(held).alias("w")).groupBy("w").count().collect()}  # one row per template word at most
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    need = [need_of(s, threshold) for s in sets]
    blocks = [math.ceil(len(t.split()) / threshold - 1e-9) for t, _ in templates]
    longest = max(blocks)
    postings = [
        (k, w, p, len(s), need[k])
        for k, s in enumerate(sets)
        for p, w in enumerate(sorted(s, key=rank.__getitem__)[: len(s) - need[k] + 1])
    ]
    index = spark.createDataFrame(postings, "template int, word string, t_pos int, t_size int, need int")
    prefix_words = sorted({p[1] for p in postings})
    any_prefix = "(?:^|{0})(?:{1})(?:$|{0})".format(BREAK, "|".join(prefix_words))
    order = F.create_map(*[x for w, i in rank.items() for x in (F.lit(w), F.lit(i))])
    known = F.filter(F.array_distinct("_win"), lambda w: F.array_contains(F.array(*map(F.lit, vocabulary)), w))
    windows = (
        rows.where(F.col("_text").rlike(any_prefix))
        .select("_key", words_of(F.col("_text")).alias("_words"))
        .where(F.size("_words") > 0)
        .select("_key", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("_words") - 1) / longest).cast("int")), lambda k: F.slice("_words", k * longest + 1, 2 * longest))).alias("_part", "_win"))
        .where(F.arrays_overlap("_win", F.array(*map(F.lit, prefix_words))))
        .withColumn("_known", F.array_sort(F.transform(known, lambda w: F.struct(order[w].alias("r"), w.alias("w")))))
    )
    candidates = (
        windows.select("_key", "_part", "_known", "_win", F.posexplode("_known").alias("b_pos", "_k"))
        .join(F.broadcast(index), F.col("_k.w") == F.col("word"))
        .where(F.size("_known") >= F.col("need"))  # length
        .where(1 + F.least(F.size("_known") - F.col("b_pos") - 1, F.col("t_size") - F.col("t_pos") - 1) >= F.col("need") - F.least("b_pos", "t_pos"))  # position
        .dropDuplicates(["_key", "_part", "template"])
    )
    full = spark.createDataFrame(
        [(k, sorted(s), n, must, label) for k, (s, n, must, (_, label)) in enumerate(zip(sets, blocks, told_by(sets, threshold), templates, strict=True))],
        "template int, t_words array<string>, block int, must array<string>, label string",
    )
    overlaps = F.transform(  # of all blocks that start in the window's first half
        F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_win"))),
        lambda i: F.when(F.size(F.array_except("must", F.slice("_win", i, F.col("block")))) == 0, F.size(F.array_intersect(F.slice("_win", i, F.col("block")), "t_words"))).otherwise(0),
    )
    return (
        candidates.join(F.broadcast(full), "template")
        .where(F.size(F.array_intersect(F.transform("_known", lambda k: k["w"]), "t_words")) >= F.col("need"))
        .withColumn("overlap", F.array_max(overlaps))
        .where(F.col("overlap") >= F.col("need"))
        .groupBy("_key", "template", "label")
        .agg(F.max(F.col("overlap") / F.col("t_size")).alias("containment"))
    )


def scan_documents(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Base phrases and template labels of every document; ``score`` is 1 with a base phrase, else the best containment; n_templates counts the templates met."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), lowered(text).alias("_text"), F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), F.xxhash64(text).alias("h")).alias("_key")
    )
    met = template_join(rows.select("_key", "_text"), templates, threshold).groupBy("_key").agg(
        F.collect_set("label").alias("_more"), F.max("containment").alias("_best"), F.count(F.lit(1)).alias("_met")
    )
    joined = phrases(rows).drop("_text").join(met, "_key", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
        F.coalesce("_met", F.lit(0)).cast("long").alias("n_templates"),
    )


def scan_sql(templates: list[tuple[str, str]] = TEMPLATES, found: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> str:
    """The same result in SQL by comparing every block with every template, without the filters."""
    sets = [set(t.split()) for t, _ in templates]
    listed = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]::VARCHAR[]"
    rows = ", ".join(
        f"({k}, {listed(sorted(s))}, {len(s)}, {need_of(s, threshold)}, {math.ceil(len(t.split()) / threshold - 1e-9)}, {listed(must)}, '{label}')"
        for k, (s, must, (t, label)) in enumerate(zip(sets, told_by(sets, threshold), templates, strict=True))
    )
    phrase_rows = ", ".join(f"({listed(p.split())}, {len(p.split())}, '{label}')" for p, label in found.items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{word}') AS ws FROM documents),
  w AS (SELECT k, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM d),
  phrase(ps, n, label) AS (VALUES {phrase_rows}),
  base AS (SELECT d.k, w.pos, p.label FROM w JOIN phrase p ON w.word = p.ps[1] JOIN d ON d.k = w.k WHERE d.ws[w.pos + 1 : w.pos + p.n] = p.ps),
  base_of AS (SELECT k, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS ls FROM base GROUP BY k),
  template(t, ts, size, need, block, must, label) AS (VALUES {rows}),
  hit AS (SELECT d.k, m.t, m.label, m.size, m.need, len(list_intersect(d.ws[w.pos + 1 : w.pos + m.block], m.ts)) AS n
    FROM w JOIN template m ON list_contains(m.ts, w.word) JOIN d ON d.k = w.k
    WHERE list_has_all(d.ws[w.pos + 1 : w.pos + m.block], m.must)),
  met AS (SELECT k, t, label, max(n / size) AS c FROM hit WHERE n >= need GROUP BY k, t, label),
  met_of AS (SELECT k, count(*) AS n_templates, max(c) AS best, list(DISTINCT label) AS ls FROM met GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.ls), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(m.ls, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score, coalesce(n_templates, 0)::BIGINT AS n_templates
FROM d LEFT JOIN base_of b USING (k) LEFT JOIN met_of m USING (k)"""
