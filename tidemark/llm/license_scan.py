"""Licences of files: sparse TF-IDF cosine of licence lines to templates, then inheritance from the nearest licensed directory.

Every line of a file with a licence word is a passage.  Passages are reduced to distinct word lists with their counts first; document
frequencies, weights and cosines are computed once for each of those, so a line found in a third of all files is weighed once.  Blocks of
neighbouring lines around such a line, and the whole text of a file named as a licence file, are compared with headers and whole licences
where the text lies (``license_blocks``).  A file's own licence is that of its whole text if that matches, or else of its best line or block; "All rights
reserved" gives way to any licence.  A file named as a licence file, or with at least half of its words in lines that match,
licenses its directory; files without an own licence take that of the nearest directory above them, which is decided once for each
directory.

Defined results: null and empty texts have no passages; a null path has no directory and inherits nothing; of equal cosines the first
licence by name wins, of several licence files in a directory the first path; repeated rows are reported each; empty tables are fine.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, slices, written
from tidemark.llm.license_blocks import RESERVED, Weigher

#: A line with one of these is a passage.
CUES = "licen[cs]e|licen[cs]ed|copyright|all rights reserved|public domain|spdx|permission is hereby granted|redistribution and use"
FILE_NAMES = "^(license|licence|copying|unlicense|notice)([.-][^/]*)?$"
#: Cosine from which a passage matches a template.
LEAST_COSINE = 0.55
#: Notices by licence, several for one where they differ.
TEMPLATES = (
    ("AllRightsReserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), "[^a-z0-9]+"), "")


def _terms(passages: DataFrame) -> DataFrame:
    """(words, uses, term, tf) of distinct word lists."""
    return passages.select("words", "uses", F.explode("words").alias("term")).groupBy("words", "uses", "term").agg(F.count(F.lit(1)).alias("tf"))


def match_passages(passages: DataFrame, templates=TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """(words, licence, cosine): the best template of each distinct word list (words, uses) that reaches ``least``."""
    spark = passages.sparkSession
    given = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, licence string, text string")
    given = given.select("template", "licence", F.explode(_words(F.col("text"))).alias("term")).groupBy("template", "licence", "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = _terms(passages)
    total = passages.agg(F.sum("uses")).head()[0] or 0
    # only terms of templates can meet one; the others count in the lengths of passages
    frequency = terms.groupBy("term").agg(F.sum("uses").alias("df"))
    weight = F.log((1.0 + F.lit(total)) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0
    weighed = terms.join(frequency, "term").withColumn("w", F.col("tf") * weight)
    lengths = weighed.groupBy("words").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    marks = given.join(frequency, "term", "left").withColumn("w", F.col("tf") * weight)
    marks = marks.join(marks.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("mark_length")), "template")
    products = weighed.select("words", "term", F.col("w").alias("own")).join(F.broadcast(marks), "term").groupBy("words", "template", "licence", "mark_length").agg(
        F.sum(F.col("own") * F.col("w")).alias("product"))
    cosines = products.join(lengths, "words").select("words", "licence", F.round(F.col("product") / (F.col("length") * F.col("mark_length")), 9).alias("cosine"))
    best = cosines.groupBy("words").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("best"))
    return best.select("words", F.col("best.licence").alias("licence"), (-F.col("best.c")).alias("cosine")).filter(F.col("cosine") >= least)


def directories(path: Column) -> Column:
    """The directories above a path, nearest first, with "" for the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def match_blocks(files: DataFrame) -> DataFrame:
    """(at, licence, cosine, whole, lines) of files (at, licence_name, text): the best block or whole text, and the lines of blocks that match."""
    weigher = files.sparkSession.sparkContext.broadcast(Weigher(TEMPLATES, CUES, LEAST_COSINE))

    def run(batches):
        for batch in slices(batches, "text"):
            out = []
            for at, named, text in zip(*(batch.column(c).to_pylist() for c in ("at", "licence_name", "text"))):
                best, lines = weigher.value.judge(text, named)
                if best:
                    out.append((at, *best, lines))
            if out:
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["at", "licence", "cosine", "whole", "lines"])

    return files.mapInArrow(run, "at long, licence string, cosine double, whole boolean, lines array<int>")


def scan(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Struct ``row`` of the input without its texts, with ``own_licence``, ``cosine``, ``licence_file``, ``licence`` (own or inherited) and ``licence_from``
    (``own``, the directory it comes from, or null)."""
    kept = F.struct(*[F.col(f"`{c}`") for c in files.columns if c != text]).alias("row")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    indexed = F.transform(F.split(body, "\n"), lambda line, i: F.struct(i.alias("line"), line.alias("text")))
    cued = F.filter(indexed, lambda x: ascii_lower(x["text"]).rlike(CUES))
    name = ascii_lower(F.element_at(F.split(F.coalesce(F.col(f"`{path}`"), F.lit("")), "/"), -1))
    # texts are read once; what is written holds texts with a licence word or of licence files only
    base = files.select(
        kept, F.col(f"`{path}`").alias("path"), F.monotonically_increasing_id().alias("at"), F.size(_words(body)).alias("n_words"), F.coalesce(name.rlike(FILE_NAMES), F.lit(False)).alias("licence_name"),
        F.transform(cued, lambda x: F.struct(x["line"].alias("line"), _words(x["text"]).alias("words"))).alias("passages"), body.alias("text"))
    base = written(base.withColumn("text", F.when(F.col("licence_name") | (F.size("passages") > 0), F.col("text"))), "licence-files")
    used = written(base.select("at", F.explode("passages").alias("p")).select("at", "p.line", "p.words"), "licence-passages")
    matches = match_passages(used.groupBy("words").agg(F.count(F.lit(1)).alias("uses")))
    blocks = written(match_blocks(base.filter("text is not null").select("at", "licence_name", "text")), "licence-blocks")
    by_line = written(used.join(matches, "words").select("at", "line", F.size("words").alias("n"), "licence", "cosine"), "licence-lines")
    lengths = base.select("at", "text").join(blocks.filter("size(lines) > 0").select("at", "lines"), "at").select("at", F.posexplode(F.split("text", "\n")).alias("line", "own"), "lines")
    lengths = lengths.filter(F.array_contains("lines", F.col("line"))).select("at", "line", F.size(_words(F.col("own"))).alias("n"))
    covered = by_line.select("at", "line", "n").union(lengths).distinct().groupBy("at").agg(F.sum("n").alias("covered"))
    every = by_line.select("at", "licence", "cosine", F.lit(False).alias("whole")).union(blocks.select("at", "licence", "cosine", "whole"))
    found = every.groupBy("at").agg(F.min(F.struct((F.col("licence") == RESERVED).alias("reserved"), (~F.col("whole")).alias("part"), (-F.col("cosine")).alias("c"), "licence")).alias("best"))
    found = found.join(covered, "at", "left")
    own = base.join(found, "at", "left").select(
        "row", "path", F.col("best.licence").alias("own_licence"), (-F.col("best.c")).alias("cosine"),
        (F.col("best").isNotNull() & (F.col("licence_name") | (2 * F.coalesce("covered", F.lit(0)) >= F.col("n_words")))).alias("licence_file"),
        F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "").alias("directory"))
    own = written(own, "licence-own")
    licensed = own.filter("licence_file and path is not null").groupBy(F.col("directory").alias("above")).agg(F.min(F.struct("path", "own_licence")).alias("from"))
    below = own.filter("own_licence is null and directory is not null").select("directory").distinct()
    ancestors = below.select("directory", F.posexplode(directories(F.concat("directory", F.lit("/x")))).alias("up", "above"))
    inherited = ancestors.join(licensed, "above").groupBy("directory").agg(F.min(F.struct("up", "above", F.col("from.own_licence").alias("licence"))).alias("nearest"))
    return own.join(inherited, "directory", "left").select(
        "row", "own_licence", "cosine", "licence_file", F.coalesce("own_licence", "nearest.licence").alias("licence"),
        F.when(F.col("own_licence").isNotNull(), "own").otherwise(F.col("nearest.above")).alias("licence_from"))
