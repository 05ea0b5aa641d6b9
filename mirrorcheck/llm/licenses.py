"""License scan: phrases in place, and an exact containment join of text blocks with notice templates."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

# Phrases with their labels, and short notices with theirs.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
TEMPLATES = (
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-header", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"),
    ("mit-notice", "Released under the MIT License"),
    ("mit-header", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd-header", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def template_words(text: str) -> list[str]:
    """Distinct words of a template, in order."""
    return list(dict.fromkeys(x.decode() for x in _WORD.findall(text.encode().translate(_LOWER))))


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def window_length(text: str, threshold: float) -> int:
    """Words of a template, with room for as many others as may be missing."""
    return math.ceil(len(_WORD.findall(text.encode().translate(_LOWER))) / threshold - 1e-9)


def word_codes(templates: Mapping[str, Sequence[str]]) -> dict[str, int]:
    """The words of all templates, numbered."""
    return {w: i for i, w in enumerate(sorted({w for ws in templates.values() for w in ws}))}


def blocks(documents: DataFrame, phrases: Sequence[tuple[str, str]], templates: Mapping[str, Sequence[str]], threshold: float, lengths: Mapping[str, int]) -> DataFrame:
    """Read each text once. Per document: row, doc_id, n_words, places of phrases, and what its blocks are made of.

    Phrases may overlap; each has all its places. ``blocks`` has, for each length of a window (``lengths``) of which the text holds
    enough words of a template, the places of all words (``word_codes``) of the templates of that length; ``windows`` makes the
    blocks of them. A text that as a whole holds too few words of a template has no block that holds enough.
    """
    codes = {w.encode(): i for w, i in word_codes(templates).items()}
    vocabulary = frozenset(codes)
    spans: dict[int, list[tuple[frozenset, int]]] = {}
    for name, ws in templates.items():
        spans.setdefault(lengths[name], []).append((frozenset(w.encode() for w in ws), needed(len(ws), threshold)))
    known = {length: frozenset().union(*(ws for ws, _ in some)) for length, some in spans.items()}
    needles = [(b" %b " % p.encode(), label) for p, label in phrases]
    hints = tuple(max(p.split(), key=len).encode() for p, _ in phrases)
    words_at = pa.list_(pa.struct([("length", pa.int32()), ("places", pa.list_(pa.int32())), ("words", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):  # as a text may have many places
            cols: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "blocks")}
            for text in batch.column("text"):
                body = (text.as_py() or "").encode().translate(_LOWER)
                found = _WORD.findall(body)
                own, at = [], []
                present = vocabulary.intersection(found)
                some = [length for length, ts in spans.items() if any(len(ws & present) >= need for ws, need in ts)]
                spots = [(i, w) for i, w in enumerate(found) if w in codes] if some else []
                kept = []
                for length in some:
                    held = [(i, codes[w]) for i, w in spots if w in known[length]]
                    kept.append({"length": length, "places": np.array([i for i, _ in held], np.int32), "words": np.array([c for _, c in held], np.int32)})
                if any(h in body for h in hints):
                    joined = b" " + b" ".join(found) + b" "
                    for needle, label in needles:
                        here = seen = 0
                        i = joined.find(needle)
                        while i >= 0:
                            seen += joined.count(b" ", here, i)
                            here = i
                            at.append(seen)
                            own.append(label)
                            i = joined.find(needle, i + 1)
                for k, v in zip(cols, (len(found), len(at), min(at, default=None), max(at, default=None), sorted(set(own)), kept)):
                    cols[k].append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), words_at]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, t) for v, t in zip(cols.values(), kinds)]], ["doc_id", *cols])

    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), *T._parse_datatype_string(
        "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
        "blocks array<struct<length:int,places:array<int>,words:array<int>>>").fields])
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()))


def windows(rows: DataFrame) -> DataFrame:
    """All blocks of the texts as sets of word codes: row, length, block, last, tokens.

    A block is a window of ``length`` consecutive words, over line ends or within a line, at the end of a text what is left of it.
    Each word of a text starts one. The windows that start at the words ``block`` to ``last`` hold the same words of templates, at the
    same places, so they are one row; windows without any have none. Only words of templates of that length stay in a set, as
    no other word adds to a containment.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            row, length, lists = batch.column("row").to_numpy(), batch.column("length").to_numpy().astype(np.int64), batch.column("places")
            places, words = lists.flatten().to_numpy().astype(np.int64), batch.column("words").flatten().to_numpy()
            counts = lists.value_lengths().to_numpy()
            of = np.repeat(np.arange(len(row)), counts)
            # the texts behind each other, with room for a window between them
            base = np.concatenate([[0], np.cumsum(places[np.cumsum(counts) - 1] + length + 1)[:-1]])
            at = places + base[of]
            before = np.full(len(at), -1)  # where the word stood last in that text
            order = np.lexsort((at, words, of))
            same = (words[order[1:]] == words[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
            before[order[1:][same]] = order[:-1][same]
            starts = np.unique(np.concatenate([np.maximum(at - length[of] + 1, base[of]), at + 1]))  # where a word comes in, or has left
            text = np.searchsorted(base, starts, "right") - 1
            low, high = np.searchsorted(at, starts), np.searchsorted(at, starts + length[text])
            last = np.append(starts[1:] - 1, 0)
            some = np.flatnonzero(high > low)
            for part in (some[i:i + 10_000] for i in range(0, len(some), 10_000)):
                n = high[part] - low[part]
                block = np.repeat(np.arange(len(part)), n)
                i = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n) + low[part][block]
                first = before[i] < low[part][block]
                ends = np.concatenate([[0], np.cumsum(np.bincount(block[first], minlength=len(part)))])
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words[i[first]], pa.int32()))
                t = text[part]
                yield pa.RecordBatch.from_arrays([pa.array(row[t], pa.int64()), pa.array(length[t], pa.int32()), pa.array(starts[part] - base[t], pa.int32()),
                                                  pa.array(last[part] - base[t], pa.int32()), tokens], ["row", "length", "block", "last", "tokens"])

    return (rows.where("size(blocks) > 0").select("row", F.explode("blocks").alias("b")).select("row", "b.length", "b.places", "b.words")
            .mapInArrow(run, "row long, length int, block int, last int, tokens array<int>"))


def containment_join(spark: SparkSession, sets: DataFrame, templates: Mapping[str, Sequence[str]], threshold: float, lengths: Mapping[str, int]) -> DataFrame:
    """Every (row, block, template) of which the block, as long as the template allows (``lengths``), holds at least ``threshold`` of its words.

    Blocks smaller than the overlap that any template of their length needs go first. Words are ordered from rare to frequent over
    the others. A block that holds enough of a template shares a word with the first size - needed + 1 words of it, so only
    those are matched; a match at place i of the template and place j of the block can grow to at most what stands behind
    both places; what passes is verified. The templates are a parameter, so their table is as small as the list given.
    Blocks are not shuffled, only what is found.
    """
    codes = word_codes(templates)
    words = spark.createDataFrame([(name, codes[w], len(ws), needed(len(ws), threshold), lengths[name]) for name, ws in templates.items() for w in ws],
                                  "template string, word int, size int, need int, room int")
    least = words.groupBy("room").agg(F.min("need").alias("least"))
    sets = sets.join(F.broadcast(least), (F.col("length") == F.col("room")) & (F.size("tokens") >= F.col("least"))).drop("room", "least")
    counts = F.broadcast(sets.select(F.explode("tokens").alias("word")).groupBy("word").count())  # at most the words of the templates
    rank = F.row_number().over(Window.orderBy(F.coalesce("count", F.lit(0)), "word"))
    order = stored(words.select("word").distinct().join(counts, "word", "left").withColumn("rank", rank).select("word", "rank"))
    by_rank = Window.partitionBy("template").orderBy("rank")
    prefix = (words.join(F.broadcast(order), "word").withColumn("i", F.row_number().over(by_rank) - 1)
              .where("i < size - need + 1").select("template", "rank", "size", "need", "room", "i"))
    ranks = order.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "rank"))), lambda x: x["rank"]).alias("ranks"))  # by code
    placed = (sets.crossJoin(F.broadcast(ranks))
              .select(*sets.columns, F.posexplode(F.sort_array(F.transform("tokens", lambda w: F.get("ranks", w)))).alias("j", "rank")))
    full = spark.createDataFrame([(name, [codes[w] for w in ws]) for name, ws in templates.items()], "template string, words array<int>")
    return (placed.join(F.broadcast(prefix), "rank")
            .where((F.col("length") == F.col("room")) & (F.size("tokens") >= F.col("need")) & (F.least(F.col("size") - F.col("i"), F.size("tokens") - F.col("j")) >= F.col("need") - F.least("i", "j")))
            .join(F.broadcast(full), "template")
            .withColumn("overlap", F.size(F.array_intersect("tokens", "words"))).where("overlap >= need")
            .select("row", "block", "last", "template", "overlap", (F.col("overlap") / F.col("size")).alias("containment")).distinct())


def license_table(documents: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
                  threshold: float = 0.8) -> DataFrame:
    """One row per document: places and labels of phrases, labels of templates that a block holds, and a score.

    The score is the largest containment, or 1 where a phrase stands. A null text is empty and gets no label.
    Blocks are all windows of the length of a template, see ``windows``; repeated words count once in a block. Texts of any length
    are read whole, equal rows have equal results, and other columns are not read.
    """
    spark = documents.sparkSession
    named = {f"{i} {name}": text for i, (name, text) in enumerate(templates)}  # several may have one name
    sets = {key: template_words(text) for key, text in named.items()}
    lengths = {key: window_length(text, threshold) for key, text in named.items()}
    rows = blocks(documents, phrases, sets, threshold, lengths)
    found = (containment_join(spark, windows(rows), sets, threshold, lengths).groupBy("row")
             .agg(F.collect_set(F.expr("substring(template, instr(template, ' ') + 1)")).alias("names"), F.max("containment").alias("best")).withColumnRenamed("row", "r"))
    none = F.array().cast("array<string>")
    return (rows.join(found, F.col("row") == F.col("r"), "left")
            .select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_union("base_labels", F.coalesce("names", none))), ",").alias("labels"),
                    F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score")))
