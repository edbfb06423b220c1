"""License scans: phrases of words, and an exact set-similarity join of text blocks with license templates.

The join is the containment kind: a block B (a line, or a paragraph of lines) meets template T if it holds at least
CONTAINMENT of T's distinct words. Words are ordered by how many documents have them, over all documents, the rarest
first. T needs o = ceil(CONTAINMENT * |T|) of its words, so a block that meets it has one of T's first |T| - o + 1
(prefix filter), has o distinct words of the templates at all (length filter), and from the first shared prefix word
on enough words are left in both orders (positional filter). What passes is counted in full. No block is cut or skipped.

The templates are a bounded table of their own, so their index travels with the plan and a text never leaves its
row: no key can be hot. The only shuffles count template words. All of it is DataFrame expressions.

Defined results: a null text counts as empty; null ids stay; repeated rows are scanned each on their own; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.expressions import let, running

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Consecutive words, and the label that they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
CONTAINMENT = 0.8
#: Public license notices.
TEMPLATES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-notice": "Released under the terms of the MIT License. See the LICENSE file for details.",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-line": "Licensed under the Apache License, Version 2.0",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3",
    "bsd-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by-line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
}


def folded(text: Column) -> Column:
    """A-Z to a-z; other letters stay. A null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    return {name: sorted(set(re.findall(r"[0-9a-z]+", text.lower()))) for name, text in templates.items()}


def phrase_starts(joined: Column, phrase: str) -> Column:
    """array<bigint>: numbers of the words at which the phrase starts, in a text of ' word word ... word '."""
    count = lambda s: (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("bigint")
    inner, pattern = len(phrase.split()), f" {phrase}(?= )"
    # what follows the last match is no match
    gaps = let(F.split(joined, pattern, -1), lambda parts: F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), count))
    found = F.transform(running(gaps), lambda at, k: at + k.cast("bigint") * inner)
    return F.when(joined.contains(f" {phrase} "), found).otherwise(F.array().cast("array<bigint>"))


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda at: F.struct(at.alias("at"), F.lit(label).alias("label")))


def template_index(docs: DataFrame, text: str, templates: dict[str, str]) -> Column:
    """One value: array<struct<label, words (rarest first), need, prefix>>, by document frequencies over all docs."""
    sets = template_words(templates)
    vocabulary = sorted({w for ws in sets.values() for w in ws})
    counted = docs.select(F.explode(F.array_intersect(words(folded(F.col(text))), F.array(*[F.lit(w) for w in vocabulary]))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    rows = docs.sparkSession.createDataFrame([(name, w, len(ws), math.ceil(CONTAINMENT * len(ws) - 1e-9)) for name, ws in sets.items() for w in ws], "label string, word string, size int, need int")
    ordered = rows.join(counted, "word", "left").groupBy("label").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("w"), F.first("size").alias("size"), F.first("need").alias("need"))
    entry = F.struct("label", F.col("w.word").alias("words"), "need", F.slice("w.word", F.lit(1), F.col("size") - F.col("need") + 1).alias("prefix"))
    return ordered.agg(F.array_sort(F.collect_list(entry))).scalar()


def _blocks(text: Column) -> Column:
    """Lines, and paragraphs of several lines."""
    lines, paragraphs = F.split(text, "\n"), F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.replace(p, F.lit("\r"), F.lit(""))).contains("\n"))
    return F.concat(lines, paragraphs)


def _met(block: Column, index: Column) -> Column:
    """array<struct<label, score>> of the templates that a block's words meet."""

    def tested(t):
        shared = F.filter(t["words"], lambda w: F.array_contains(block, w))
        first = F.array_position(t["words"], F.element_at(F.filter(t["prefix"], lambda w: F.array_contains(block, w)), 1))
        # positional filter: words of T from the first shared one on, and words of the block
        left = F.least(F.size(t["words"]) - first + 1, F.size(block))
        score = F.when(left >= t["need"], F.size(shared)).otherwise(0)
        return F.struct(t["label"].alias("label"), score.alias("shared"), t["need"].alias("need"), F.size(t["words"]).alias("size"))

    candidates = F.filter(index, lambda t: (F.size(block) >= t["need"]) & F.arrays_overlap(t["prefix"], block))
    met = F.filter(F.transform(candidates, tested), lambda t: t["shared"] >= t["need"])
    return F.transform(met, lambda t: F.struct(t["label"].alias("label"), (t["shared"].cast("double") / t["size"]).alias("score")))


def find_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """keep columns, n_words, starts (of phrases: array<struct<at, label>>), templates (array<struct<label, score>>).

    templates holds each template that some block meets, with the best containment.
    """
    whole = folded(F.col(text))
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for ws in template_words(templates).values() for w in ws})])
    rows = docs.select(*keep, whole.alias("_text")).withColumn("_words", words(F.col("_text")))
    rows = rows.withColumn("_index", template_index(docs, text, templates))
    joined = F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))
    starts = let(joined, lambda j: F.concat(*[_labelled(phrase_starts(j, p), label) for p, label in PHRASES.items()]))
    starts = F.when(F.array_contains("_words", "license"), starts).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))
    # the words of the templates are all that counts in a block
    in_block = lambda b: F.array_intersect(words(b), vocabulary)
    met = F.flatten(F.transform(_blocks(F.col("_text")), lambda b: let(in_block(b), lambda w: _met(w, F.col("_index")))))
    # a document without any prefix word has no block with one
    some = F.exists("_index", lambda t: F.arrays_overlap(t["prefix"], F.col("_words")))
    met = F.when(some, met).otherwise(F.array().cast("array<struct<label:string,score:double>>"))
    best = let(F.array_sort(met), lambda m: F.transform(F.array_distinct(F.transform(m, lambda x: x["label"])), lambda label: F.struct(label.alias("label"), F.array_max(F.transform(F.filter(m, lambda x: x["label"] == label), lambda x: x["score"])).alias("score"))))
    return rows.select(*keep, F.size("_words").cast("long").alias("n_words"), starts.alias("starts"), best.alias("templates"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's columns from find_licenses over all documents."""
    found = find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    at = F.transform("starts", lambda s: s["at"])
    base, extra = F.transform("starts", lambda s: s["label"]), F.transform("templates", lambda t: t["label"])
    said = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("templates", lambda t: t["score"])), F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), said(base).alias("base_labels"), said(F.concat(base, extra)).alias("labels"), score.alias("score"))


def _oracle() -> str:
    """The same by brute force: all blocks against all templates."""
    sets = template_words(TEMPLATES)
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    templates = " UNION ALL ".join(f"SELECT '{name}' AS label, {listed(ws)} AS ws, {len(ws)} AS size, {math.ceil(CONTAINMENT * len(ws) - 1e-9)} AS need" for name, ws in sets.items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = " UNION ALL ".join(f"SELECT d.doc_id, i - 1 AS pos, '{label}' AS label FROM w d, unnest(range(1, len(d.ws) + 1)) AS r(i) WHERE " + " AND ".join(f"d.ws[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p, label in PHRASES.items())
    return f"""
WITH t AS ({templates}),
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '{word}') AS ws FROM d),
p AS ({phrases}),
b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block FROM d UNION ALL SELECT doc_id, block FROM (SELECT doc_id, unnest(string_split_regex(text, '\\n\\s*\\n')) AS block FROM d) WHERE contains(trim(replace(block, chr(13), '')), chr(10))),
m AS (SELECT doc_id, label, max(len(list_intersect(ws, list_distinct(regexp_extract_all(block, '{word}')))) / size::DOUBLE) AS score FROM b, t
      WHERE len(list_intersect(ws, list_distinct(regexp_extract_all(block, '{word}')))) >= need GROUP BY doc_id, label),
pa AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM p GROUP BY doc_id),
ma AS (SELECT doc_id, list(label) AS labels, max(score) AS score FROM m GROUP BY doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(pa.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_concat(coalesce(pa.labels, []), coalesce(ma.labels, []))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(ma.score, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN pa USING (doc_id) LEFT JOIN ma USING (doc_id)"""


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLE_SQL: dict[str, str] = {"op2_license_scan": _oracle()}
