"""Benchmark decontamination by a positional inverted index that is split by documents.

Each index segment holds the postings of some documents: for every test term, the places where it stands. Segments
are written once. A phrase is found by taking the postings of its rarest term in the segment, moving them back by
the term's place in the phrase, and intersecting them with the moved postings of its other terms, from rare to
frequent. A term that stands in a third of all documents is thus spread over as many segments, and nothing of the
documents is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import ALNUM, LOWER, as_bytes, find_words, hash_spans, slices
from .common import stored, temporary, without, words

LENGTH = 10


def phrases(benchmark: DataFrame, length: int = LENGTH) -> DataFrame:
    """Distinct windows of ``length`` words of the items: words, item_ids. A shorter item is one window, one without words none."""
    rows = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - length, F.lit(0)))
    return (rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, length))).alias("words"))
            .groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")))


def build_index(documents: DataFrame, terms: np.ndarray, row_bytes: int = 2_000_000) -> DataFrame:
    """Segments of about ``row_bytes`` of text: keys, word counts of the documents, counts and places of each term.

    ``terms`` are the sorted hashes of the test terms. Places count the words of the segment from 0 and are sorted
    by term and then place.
    """
    shared = documents.sparkSession.sparkContext.broadcast(terms)
    key_type = documents.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, row_bytes):
            data, offsets = as_bytes(batch.column("text"))
            data = LOWER[data]
            starts, ends, rows = find_words(data, offsets, ALNUM)
            hashes = hash_spans(data, starts, ends)
            term = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
            place = np.flatnonzero(known[term] == hashes) if len(known) else np.zeros(0, np.int64)
            term = term[place].astype(np.uint32)
            order = np.argsort(term, kind="stable")
            here, counts = np.unique(term[order], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("doc_id").to_pylist()], pa.list_(batch.column("doc_id").type)),
                 pa.array([batch.column("tie").to_pylist()], pa.list_(pa.int64())),
                 pa.array([np.bincount(rows, minlength=batch.num_rows)], pa.list_(pa.int64())),
                 *[pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (here, counts, place[order])]],
                ["doc_ids", "ties", "n_words", "terms", "counts", "places"])

    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(key_type)), *T._parse_datatype_string(
        "ties array<long>, n_words array<long>, terms binary, counts binary, places binary").fields])
    return stored(documents.select("doc_id", F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema))


class Segment:
    """Postings of one segment, with the searches on them."""

    def __init__(self, n_words, terms: bytes, counts: bytes, places: bytes, n_terms: int):
        self.ends = np.cumsum(np.asarray(n_words, np.int64))
        self.total = int(self.ends[-1]) if len(self.ends) else 0
        here, n = np.frombuffer(terms, "<u4").astype(np.int64), np.frombuffer(counts, "<u4").astype(np.int64)
        self.counts = np.zeros(n_terms + 1, np.int64)  # the last one stands for no term
        self.counts[here] = n
        self.first = np.cumsum(self.counts) - self.counts
        self.places = np.frombuffer(places, "<u4").astype(np.int64)
        self.keys = np.repeat(here, n) * (self.total + 1) + self.places  # sorted

    def within(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term has a place from low to high."""
        at = np.searchsorted(self.keys, term * (self.total + 1) + low)
        found = at < len(self.keys)
        found[found] = self.keys[at[found]] <= term[found] * (self.total + 1) + high[found]
        return found

    def search(self, table: np.ndarray, size: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, start, document, exact) of every match. ``table``: a row of terms for each phrase, filled up with the last, void term.

        Exact: all terms in place. Else near: the rarest term is there and every other one stands in the same
        document, at most ``slack`` words from its place.
        """
        columns = np.arange(table.shape[1])[None, :]
        counts = np.where(columns < size[:, None], self.counts[table], np.iinfo(np.int64).max)
        order = np.argsort(counts, axis=1, kind="stable")  # from rare to frequent
        rare = order[:, 0]
        which = np.flatnonzero(counts[np.arange(len(table)), rare] > 0)
        term = table[which, rare[which]]
        n = self.counts[term]
        phrase = np.repeat(which, n)
        ends = np.cumsum(n)
        start = self.places[np.repeat(self.first[term] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)] - np.repeat(rare[which], n)
        doc = np.searchsorted(self.ends, start + rare[phrase], "right")
        low = np.where(doc > 0, self.ends[doc - 1], 0) if len(doc) else start
        high = self.ends[doc] - 1 if len(doc) else start
        exact = (start >= low) & (start + size[phrase] - 1 <= high)
        for k in range(1, table.shape[1]):
            if not len(phrase):
                break
            column = order[phrase, k]
            there = k < size[phrase]
            term, at = table[phrase, column], start + column
            near = ~there | self.within(term, np.maximum(at - slack, low), np.minimum(at + slack, high))
            if slack:
                exact &= ~there | self.within(term, np.maximum(at, 0), at)
            phrase, start, doc, exact, low, high = (x[near] for x in (phrase, start, doc, exact, low, high))
        return phrase, start, doc, exact


def find_matches(documents: DataFrame, benchmark: DataFrame, length: int = LENGTH, slack: int = 2, phrases_per_pass: int = 200_000) -> DataFrame:
    """One row per document: doc_id, tie (hash of its text), n_words, hits (places of words in exact matches), items, near_items.

    items: ids of items with a window that stands in the document; near_items: those of which a window stands with each
    word at most ``slack`` places off, the exact ones included. Tasks get the terms of at most ``phrases_per_pass``
    windows at a time; a larger benchmark takes several passes, whose rows are put together by id and text (equal
    rows have equal matches, and as many come back). A null text, like an empty one, has no words.
    """
    spark = documents.sparkSession
    found = stored(phrases(benchmark, length))
    n_passes = max(1, math.ceil(found.count() / phrases_per_pass))
    item_type = T.ArrayType(benchmark.schema["item_id"].dataType)
    passes = []
    for i in range(n_passes):
        part = found.where(F.pmod(F.xxhash64("words"), F.lit(n_passes)) == i).toArrow()
        lists = part.column("words").combine_chunks()
        flat, bounds = lists.flatten(), np.asarray(lists.offsets.to_numpy(), np.int64)
        size = np.diff(bounds)
        data, offsets = as_bytes(flat)
        hashes = hash_spans(data, offsets[:-1], offsets[1:])
        terms = np.unique(hashes)
        table = np.full((len(size), length), len(terms), np.int64)
        table[np.arange(length)[None, :] < size[:, None]] = np.searchsorted(terms, hashes)
        passes.append(_match(build_index(documents, terms), spark.sparkContext.broadcast((table, size, part.column("item_ids").to_pylist())), len(terms), slack, item_type))
    if n_passes == 1:
        return passes[0]
    together = passes[0]
    for other in passes[1:]:
        together = together.unionByName(other)
    return (together.groupBy("doc_id", "tie", "n_words")
            .agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items", "near_items")], F.count("*").alias("n"))
            .withColumn("n", F.explode(F.sequence(F.lit(1), (F.col("n") / n_passes).cast("int")))).drop("n"))


def _match(segments: DataFrame, shared, n_terms: int, slack: int, item_type: T.DataType) -> DataFrame:
    key_type = segments.schema["doc_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, size, item_ids = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                n_words = np.array(row["n_words"].as_py(), np.int64)
                segment = Segment(n_words, *[row[c].as_py() for c in ("terms", "counts", "places")], n_terms)
                phrase, start, doc, exact = segment.search(table, size, slack)
                cover = np.zeros(segment.total + 1, np.int64)
                np.add.at(cover, start[exact], 1)
                np.add.at(cover, start[exact] + size[phrase[exact]], -1)
                hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
                of = np.searchsorted(segment.ends, hit, "right")
                begin = segment.ends - n_words
                hits: list[list[int]] = [[] for _ in n_words]
                for d in np.unique(of):
                    hits[d] = (hit[of == d] - begin[d]).tolist()
                items: list[set] = [set() for _ in n_words]
                near: list[set] = [set() for _ in n_words]
                for p, d, e in set(zip(phrase.tolist(), doc.tolist(), exact.tolist())):
                    near[d].update(item_ids[p])
                    if e:
                        items[d].update(item_ids[p])
                kind = batch.column("doc_ids").type.value_type
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"].as_py(), kind), pa.array(row["ties"].as_py(), pa.int64()), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int64())),
                     pa.array([sorted(x) for x in items], arrow_items), pa.array([sorted(x) for x in near], arrow_items)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_items = to_arrow_type(item_type)
    out = T.StructType([T.StructField("doc_id", key_type), *T._parse_datatype_string("tie long, n_words long, hits array<long>").fields,
                        T.StructField("items", item_type), T.StructField("near_items", item_type)])
    names = out.names
    return segments.mapInArrow(run, out)


def contamination_table(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items and whether it is contaminated. Null texts, like empty ones, have no words."""
    return _table(find_matches(documents, benchmark, slack=0))


def _table(rows: DataFrame, *more: str) -> DataFrame:
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return rows.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                       (F.size("hits") > 0).alias("contaminated"), *more)


def near_table(documents: DataFrame, benchmark: DataFrame, slack: int = 2) -> DataFrame:
    """The rows of ``contamination_table`` with near_items: ids of items of which a window stands with each word at most ``slack`` places off.

    Null and empty texts have no words and no items; equal rows have equal results.
    """
    return _table(find_matches(documents, benchmark, slack=slack), "near_items")


def remove_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any exact match. Documents with one id and one text share their fate.

    Null and empty texts have no words and stay; texts of any length are searched whole; an item without words matches
    nothing. Columns may have any names.
    """
    with temporary(documents.sparkSession):
        keys = stored(find_matches(documents, benchmark, slack=0).where("size(hits) > 0").select("doc_id", "tie"), lasting=True)
    return without(documents, F.xxhash64("text"), keys)
