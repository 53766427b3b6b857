"""Licence scan by a positional index of rare licence words, in DataFrame functions only."""

from __future__ import annotations

import json
import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import settle

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """Words of a notice; ``must`` are (offset, length) runs that have to be there word by word."""

    label: str
    words: tuple[str, ...]
    must: tuple[tuple[int, int], ...]
    base: bool = False


def _template(label: str, text: str, *must: str, base: bool = False) -> Template:
    words = tuple(text.split())
    runs = []
    for phrase in must or (text,):
        part = tuple(phrase.split())
        at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
        runs.append((at, len(part)))
    return Template(label, words, tuple(runs), base)


#: Base phrases, fixed by the operator's contract.
BASE = (
    _template("cc-by", "cc by", base=True),
    _template("gpl", "general public license", base=True),
    _template("reserved", "all rights reserved", base=True),
)
#: Notices of well-known licences with the runs of words that decide.
NOTICES = (
    _template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    _template("mit", "released under the mit license", "the mit license"),
    _template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge", "obtaining a copy"),
    _template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    _template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    _template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    _template("agpl-3.0", "licensed under the gnu affero general public license", "affero general public license"),
    _template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    _template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    _template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    _template("cc0", "dedicated to the public domain under cc0 1 0", "cc0 1 0"),
    _template("cc-by-4.0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    _template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    _template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    _template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software"),
    _template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    _template("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa"),
    _template("cc-by-nc-nd", "licensed under cc by nc nd 4 0", "cc by nc nd"),
    _template("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    _template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    _template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    _template("wtfpl", "do what the fuck you want to public license", "you want to public license"),
    _template("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    _template("odbl", "made available under the open database license", "open database license"),
    _template("eupl-1.2", "licensed under the european union public licence version 1 2", "european union public licence"),
    _template("artistic-2.0", "licensed under the terms of the artistic license 2 0", "artistic license 2 0"),
    _template("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", "unauthorized copying of this file"),
    _template("no-redistribution", "no part of this publication may be reproduced stored in a retrieval system or transmitted in any form", "no part of this publication may be reproduced"),
)


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) words: runs of digits, letters a-z and anything outside ASCII."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SPLIT), "")


def word_idf(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, float]:
    """IDF of the licence words over all documents; one row per vocabulary word comes to the driver."""
    present = docs.select(F.explode(F.array_intersect(words_of(F.col(text_col)), F.lit(vocabulary))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    df = {r["w"]: r["df"] for r in present.collect()}
    n = docs.count()
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1.0 for w in vocabulary}


#: Words that a template is posted under, and template words a broadcast may hold.
POSTED, BROADCAST_WORDS = 3, 200_000


def _index(spark: SparkSession, templates: tuple[Template, ...], idf: dict[str, float]) -> tuple[DataFrame, list[str]]:
    """A row per template, and the words looked up.

    Columns: its rarest decisive word w and that word's offset, the other posted
    words, all words with their weights, and the decisive runs.
    """
    rows = []
    for number, t in enumerate(templates):
        decisive = sorted({j for at, n in t.must for j in range(at, at + n)}, key=lambda j: (-idf[t.words[j]], t.words[j], j))
        posted = [{"j": j, "w": t.words[j]} for j in decisive[:POSTED]]
        must = [{"j": at, "words": t.words[at : at + n]} for at, n in t.must]
        rows.append({"template": number, "label": t.label, "base": t.base, "w": posted[0]["w"], "offset": posted[0]["j"], "others": posted[1:], "words": t.words, "weights": [idf[w] for w in t.words], "must": must})
    kind = "array<struct<template:int,label:string,base:boolean,w:string,offset:int,others:array<struct<j:int,w:string>>,words:array<string>,weights:array<double>,must:array<struct<j:int,words:array<string>>>>>"
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), kind)).alias("t")).select("t.*")
    return table, sorted({r["w"] for r in rows})


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = BASE + NOTICES, least: float = 0.6) -> DataFrame:
    """One row per input row: id, n_words, matches (array of label, base, start, score).

    Each template is posted under its rarest decisive words, by IDF over all
    documents, with their offsets.  A text's places of the rarest one are looked
    up in the postings: they tell where the template would have to start.  The
    other posted words must stand at their offsets from there, then every
    decisive run word by word, and, but for base templates, words worth
    ``least`` of the template's IDF.

    The postings are a table and templates are its rows: any number of them is
    one plan.  Places carry the words around them, as many as the longest
    template has, so no text is gathered or shuffled; copies of a text are
    matched by its hash.  Null and empty texts have no words and no match;
    repeated rows and null ids stay; other columns are ignored; an empty table
    gives none.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for t in templates for w in t.words})
    idf = word_idf(docs, vocabulary, text_col)
    index, rare = _index(spark, templates, idf)
    reach = max(len(t.words) for t in templates)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"), words_of(F.col(text_col)).alias("words"))
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(rare), i)), lambda i: i.isNotNull())
    # Most texts hold none of the posted words: one test spares them the places.
    rows = rows.withColumn("at", F.when(F.arrays_overlap("words", F.lit(rare)), places))
    around = F.transform("at", lambda i: F.struct(i.alias("i"), F.get("words", i).alias("w"), F.least(i, F.lit(reach - 1)).alias("left"), F.slice("words", F.greatest(i - (reach - 2), F.lit(1)), F.least(i, F.lit(reach - 1)) + reach).alias("near")))
    rows = settle(rows.select("id", "h1", "h2", F.size("words").cast("long").alias("n_words"), around.alias("places")), "licence-places")
    spots = rows.where("places is not null").select("h1", "h2", F.explode("places").alias("p")).select("h1", "h2", "p.*")
    # Postings are as many as the templates, whose size is counted here.
    size = sum(len(t.words) for t in templates)
    found = spots.join(F.broadcast(index) if size <= BROADCAST_WORDS else index, "w")
    # A place of the near words: the template's start is left - offset.
    found = found.withColumn("s", F.col("left") - F.col("offset")).where("s >= 0")
    found = found.where(F.forall("others", lambda o: F.coalesce(F.get("near", F.col("s") + o["j"]) == o["w"], F.lit(False))))
    found = found.where(F.forall("must", lambda m: F.slice("near", F.col("s") + m["j"] + 1, F.size(m["words"])) == m["words"]))
    got = F.aggregate(F.transform("words", lambda w, j: F.when(F.get("near", F.col("s") + j) == w, F.get("weights", j)).otherwise(F.lit(0.0))), F.lit(0.0), lambda x, y: x + y)
    share = F.least(F.lit(1.0), got / F.aggregate("weights", F.lit(0.0), lambda x, y: x + y))
    found = found.select("h1", "h2", "template", "label", "base", (F.col("i") - F.col("offset")).alias("start"), F.when(F.col("base"), 1.0).otherwise(share).alias("score")).where(F.col("base") | (F.col("score") >= least))
    matches = found.groupBy("h1", "h2").agg(F.array_sort(F.collect_set(F.struct("template", "start", "label", "base", "score"))).alias("m"))
    matches = settle(matches, "licence-matches")
    kind = "array<struct<label:string,base:boolean,start:int,score:double>>"
    own = F.coalesce(F.transform("m", lambda x: F.struct(x["label"].alias("label"), x["base"].alias("base"), x["start"].alias("start"), x["score"].alias("score"))).cast(kind), F.array().cast(kind))
    return rows.join(matches, ["h1", "h2"], "left").select(F.col("id").alias(id_col), "n_words", own.alias("matches"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Summary columns of scan_licenses: counts, first and last base places, labels and the best score."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"].cast("long"))

    def joined(matches: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return scanned.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
