"""Exact similarity join of documents by word n-grams, with token-combination prefixes.

Sets that overlap enough share at least k n-grams of prefixes k - 1 longer than usual, if all sets are cut in one
order. N-grams are put in the order of how often they stand in all texts, rare ones first. A rare one of the prefix is
a key by itself; of the frequent ones, every pair in the (k = 2)-prefix is a key, so what stands in very many texts
leads to few candidates. Two sets that are similar share a rare n-gram of their prefixes or two frequent ones, so
none is lost. Sets above ``single_from`` n-grams use their frequent n-grams one by one, and sets around that size both.
Places in the prefix bound what
two sets can share, and the length filter compares their sizes. Candidates are verified on the whole sets. Equal sets are one class and are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import LOWER, NOT_SPACE, as_bytes, find_words, hash_spans, mix, slices
from .common import BROADCAST_KEYS, arrow_bytes, arrow_rows, fresh, stored, temporary, without
from .components import connected

K, BINS = 2, 64
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Join:
    """size: words of an n-gram. percent: least 100 * intersection / union. listed: n-grams that stand in the texts at
    least that often are ordered by their number, after all others; it is raised until at most ``table`` n-grams
    are listed, since the list goes to every task. frequent: listed n-grams of at least that number are keys in pairs.
    These choices change the work, never the result."""

    size: int = 3
    percent: int = 90
    listed: int = 3
    frequent: int = 32
    table: int = 1_000_000
    single_from: int = 400
    bytes_per_range: int = 12_000_000
    grams_at_once: int = 1_000_000

    def least_overlap(self, n):
        return (self.percent * n + 99) // 100

    @property
    def least_size(self) -> int:
        """Smaller sets are similar to equal ones only."""
        n = 1
        while 100 * n < self.percent * (n + 1):
            n += 1
        return n


def grams(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every n-gram of every text, in order of rows; a shorter text is one n-gram, one without words none."""
    data, offsets = as_bytes(column)
    data = LOWER[data]
    starts, ends, rows = find_words(data, offsets, NOT_SPACE)
    word = hash_spans(data, starts, ends)
    n = np.bincount(rows, minlength=len(column))
    full = np.flatnonzero(rows[:len(rows) - size + 1] == rows[size - 1:]) if len(rows) >= size else np.zeros(0, np.int64)
    value = np.zeros(len(full), np.uint64)
    for k in range(size):
        value = mix(value + word[full + k]) * _A
    short = np.flatnonzero((n > 0) & (n < size))
    if not len(short):
        return rows[full], value
    first = np.searchsorted(rows, short)
    own = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        there = k < n[short]
        own[there] = mix(own[there] + word[first[there] + k]) * _A
    row, value = np.concatenate((rows[full], short)), np.concatenate((value, own + _B))
    order = np.argsort(row, kind="stable")
    return row[order], value[order]


def sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``grams``, each once for a row and sorted in it."""
    row, value = grams(column, size)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _merged(values: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and the sum of the numbers of each."""
    value, number = np.concatenate(values), np.concatenate(numbers)
    order = np.argsort(value, kind="stable")
    value, number = value[order], number[order]
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
    return value[first], np.add.reduceat(number, first) if len(first) else number


def listed_grams(documents: DataFrame, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """40-bit hashes of the listed n-grams of all texts, sorted, and how often each stands there.

    Tasks count the n-grams of about ``grams_at_once`` at a time and send each of those once to ranges of the hash: five
    bytes, and its number if that is above 1. So an n-gram that stands everywhere is as small as any other. A task
    reads one range after the other; ranges follow the bytes of all texts. Two n-grams with one 40-bit hash are counted
    together, which only moves them back in the order.
    """
    size = documents.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n_ranges = max(32, 1 << (size // join.bytes_per_range).bit_length())
    bits = n_ranges.bit_length() - 1
    edges = np.arange(n_ranges + 1, dtype=np.uint64) << np.uint64(40 - bits)

    def packed(value: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        value = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
        number = np.diff(np.append(first, len(value)))
        value = value[first]
        many = number > 1
        some, number, one = value[many], number[many].astype("<u4"), value[~many]
        cut_some, cut_one = np.searchsorted(some, edges), np.searchsorted(one, edges)
        some, one = packed(some), packed(one)
        where = np.flatnonzero((np.diff(cut_some) > 0) | (np.diff(cut_one) > 0)).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(where, pa.int32()),
             pa.array([some[cut_some[i]:cut_some[i + 1]].tobytes() + one[cut_one[i]:cut_one[i + 1]].tobytes() for i in where], pa.binary()),
             pa.array([number[cut_some[i]:cut_some[i + 1]].tobytes() for i in where], pa.binary())], ["part", "hashes", "numbers"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in slices(batches, 1_000_000):
            held.append(grams(batch.column("text"), join.size)[1] >> np.uint64(24))
            if sum(map(len, held)) >= join.grams_at_once:
                yield sent(held)
                held = []
        if held:
            yield sent(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, values, numbers = None, [], []

        def counted() -> pa.RecordBatch:
            found, n = _merged(values, numbers)
            keep = n >= join.listed
            return pa.RecordBatch.from_arrays([pa.array(found[keep].astype(np.int64)), pa.array(n[keep])], ["gram", "n"])

        for batch in batches:
            for here, hashes, more in zip(*(batch.column(c) for c in ("part", "hashes", "numbers"))):
                if here.as_py() != part:
                    if values:
                        yield counted()
                    part, values, numbers = here.as_py(), [], []
                raw = np.frombuffer(hashes.as_buffer(), np.uint8).reshape(-1, 5)
                value, number = np.zeros((len(raw), 8), np.uint8), np.ones(len(raw), np.int64)
                value[:, :5] = raw
                given = np.frombuffer(more.as_buffer(), "<u4")
                number[:len(given)] = given
                values.append(value.view("<u8").ravel())
                numbers.append(number)
                if sum(map(len, values)) >= 2 * len(values[0]) + join.grams_at_once:
                    found, n = _merged(values, numbers)
                    values, numbers = [found], [n]
        if values:
            yield counted()

    with arrow_bytes(documents.sparkSession):
        table = stored(documents.select(F.col("text").cast("string").alias("text")).mapInArrow(send, "part int, hashes binary, numbers binary")
                       .repartition(n_ranges, "part").sortWithinPartitions("part").mapInArrow(count, "gram long, n long"))
    least = join.listed
    while table.where(F.col("n") >= least).count() > join.table:
        least += max(1, least // 2)
    rows = table.where(F.col("n") >= least).toArrow()
    gram, n = rows.column("gram").to_numpy().astype(np.uint64), rows.column("n").to_numpy().astype(np.int32)
    order = np.argsort(gram)
    return gram[order], n[order]


def _keys(value: np.ndarray, count: np.ndarray, n: int, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """(keys, bounds) of one set; its n-grams come in the common order, with their counts (0: not listed).

    The bound of a key is the greatest overlap possible if its n-grams are the first that two sets share.
    """
    prefix = n - join.least_overlap(n) + K
    value, count = value[:prefix], count[:prefix]
    rare, often = np.flatnonzero(count < join.frequent), np.flatnonzero(count >= join.frequent)
    keys, bounds = [value[rare]], [n - rare]
    if len(often) and n * join.percent <= 100 * join.single_from:
        i, j = (often[x] for x in np.triu_indices(len(often), 1))
        keys.append(mix(value[i] * _A + value[j]) * _B)
        bounds.append(n - j + 1)
    if len(often) and n >= join.single_from:
        keys.append(value[often])
        bounds.append(n - often)
    return np.concatenate(keys), np.concatenate(bounds)


def describe(documents: DataFrame, join: Join) -> DataFrame:
    """One row per document: doc_id, tie, set_id (16 bytes; null without n-grams), n, keys, bounds, bins (n-grams by hash range)."""
    spark = documents.sparkSession
    with temporary(spark):  # what the count shuffled is given back before the rest shuffles
        shared = spark.sparkContext.broadcast(listed_grams(documents, join))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in slices(batches, 1_000_000):
            row, value = sets(batch.column("text"), join.size)
            short = value >> np.uint64(24)
            at = np.minimum(np.searchsorted(known, short), max(0, len(known) - 1))
            count = np.where(known[at] == short, counts[at], 0) if len(known) else np.zeros(len(value), np.int64)
            n = np.bincount(row, minlength=batch.num_rows)
            ends = np.cumsum(n)
            bins = np.minimum(np.bincount(row * BINS + (value >> np.uint64(58)).astype(np.int64), minlength=batch.num_rows * BINS), 255).astype(np.uint8).reshape(-1, BINS)
            one, two = mix(value), mix(value ^ _B)
            order = np.lexsort((value, count, row))
            ordered, ordered_count = value[order], count[order]
            ids, keys = [], []
            for i in range(batch.num_rows):
                a, b = int(ends[i] - n[i]), int(ends[i])
                ids.append(np.array([one[a:b].sum(dtype=np.uint64), two[a:b].sum(dtype=np.uint64)], ">u8").tobytes() if n[i] else None)
                keys.append(_keys(ordered[a:b], ordered_count[a:b], int(n[i]), join) if n[i] >= join.least_size else (ordered[:0], ends[:0]))
            lengths = np.concatenate(([0], np.cumsum([len(k) for k, _ in keys]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), pa.array(ids, pa.binary()), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([k for k, _ in keys]).astype(np.int64))),
                 pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([b for _, b in keys]).astype(np.int32))), pa.array([x.tobytes() for x in bins], pa.binary())],
                ["doc_id", "tie", "set_id", "n", "keys", "bounds", "bins"])

    schema = T.StructType([documents.schema["doc_id"], *T._parse_datatype_string("tie long, set_id binary, n long, keys array<long>, bounds array<int>, bins binary").fields])
    return stored(documents.select("doc_id", F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema))


def _may_link(pairs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b) whose n-grams by hash range leave an overlap that is large enough possible.

    A range holds at most 255 here, which stands for that many or more; then nothing is ruled out by it.
    """
    own = classes.select("sid", "bins")
    both = (pairs.join(own.withColumnsRenamed({"sid": "a", "bins": "bins_a"}), "a").join(own.withColumnsRenamed({"sid": "b", "bins": "bins_b"}), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int64) for c in ("bins_a", "bins_b"))
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            unknown = ((x == 255) | (y == 255)).any(axis=1)
            least = np.where(unknown, n, np.minimum(x, y).sum(axis=1))
            keep = (100 + join.percent) * least >= join.percent * n
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _links(pairs: DataFrame, contents: DataFrame, join: Join) -> DataFrame:
    """Those pairs (a, b) whose whole sets are similar enough. Only the sets of these pairs are shuffled."""
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
    if needed.count() <= BROADCAST_KEYS:
        contents = contents.join(F.broadcast(needed), "sid", "left_semi")
    both = (pairs.join(contents.withColumnsRenamed({"sid": "a", "grams": "grams_a"}), "a").join(contents.withColumnsRenamed({"sid": "b", "grams": "grams_b"}), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("grams_a"), batch.column("grams_b")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                keep.append(100 * common >= join.percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _contents(documents: DataFrame, chosen: DataFrame, join: Join) -> DataFrame:
    """(sid, grams) of chosen classes (columns sid, doc_id, tie: the document that stands for each)."""
    tie = F.xxhash64("text")
    keys = chosen.withColumnsRenamed({"doc_id": "_id", "tie": "_tie"})
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (tie == F.col("_tie")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000_000):
            row, value = sets(batch.column("text"), join.size)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array([value[a:b].astype("<u8").tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], ["sid", "grams"])

    return stored(rows.select("sid", "text").mapInArrow(run, "sid long, grams binary").dropDuplicates(["sid"]))


def similar_groups(documents: DataFrame, join: Join = Join(), stars: int = 2) -> DataFrame:
    """One row per document: doc_id, tie (hash of its text), n, first_id and first_tie (the smallest document of its group).

    A group is what links reach. Within the classes that share a key, each is first verified against one leader, so
    that a large group of near copies is joined by about as many pairs as it has classes; then, where a key still has
    classes of different groups, against another leader; and last, all pairs of different groups. The first leader is the
    class with the most shared keys, which has the fewest n-grams of its own and so stands in the middle of its copies. Null and empty texts
    have no n-grams and are groups of their own, each document by itself. Null ids come after all others. Groups only
    grow, so a key whose classes are of one group is left out of all later turns.
    """
    spark = documents.sparkSession
    with arrow_rows(spark, 1_000):
        docs = describe(documents, join)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    classes = stored(docs.where("set_id is not null").groupBy("set_id").agg(F.min(order).alias("rep"), F.first("n").alias("n"), F.first(F.struct("keys", "bounds")).alias("k"), F.first("bins").alias("bins"))
                     .withColumn("sid", F.monotonically_increasing_id()))
    postings = classes.select("sid", "n", F.inline(F.arrays_zip(F.col("k.keys").alias("key"), F.col("k.bounds").alias("bound"))))
    common = stored(postings.join(postings.groupBy("key").count().where("count > 1").select("key"), "key").select("key", "sid", "n", "bound"))
    involved = stored(common.groupBy("sid").agg(F.count("*").alias("n_keys")))
    placed = common.join(involved, "sid").withColumn("root", F.col("sid"))
    links = done = contents = None
    for turn in range(stars + 1):
        mixed = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"),
                                          F.min(F.struct((F.pmod(F.xxhash64("sid"), F.lit(7)) if turn else -F.col("n_keys")).alias("draw"), "sid", "n", "bound", "root")).alias("lead")).where("x <> y")
        placed = stored(placed.join(mixed.select("key", "lead"), "key"))
        if turn < stars:
            pairs = placed.select(F.col("lead.sid").alias("l"), F.col("lead.n").alias("n_l"), F.col("lead.root").alias("root_l"), F.col("lead.bound").alias("bound_l"), "sid", "n", "bound", "root")
        else:
            other = placed.select("key", F.col("sid").alias("l"), F.col("n").alias("n_l"), F.col("root").alias("root_l"), F.col("bound").alias("bound_l"))
            pairs = placed.select("key", "sid", "n", "bound", "root").join(other, "key").where("l < sid")
        near = (F.least("n", "n_l") * 100 >= F.greatest("n", "n_l") * join.percent) & (F.least("bound", "bound_l") * (100 + join.percent) >= (F.col("n") + F.col("n_l")) * join.percent)
        pairs = (pairs.where((F.col("root") != F.col("root_l")) & near)
                 .select(F.least("sid", "l").alias("a"), F.greatest("sid", "l").alias("b"), F.when(F.col("sid") < F.col("l"), F.col("n")).otherwise(F.col("n_l")).alias("n_a"),
                         F.when(F.col("sid") < F.col("l"), F.col("n_l")).otherwise(F.col("n")).alias("n_b")).distinct())
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        tried = stored(_may_link(stored(pairs), classes, join))
        new = tried.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        new = new if contents is None else new.join(contents.select("sid"), "sid", "left_anti")
        own = _contents(documents, stored(classes.join(new, "sid").select("sid", "rep.doc_id", "rep.tie")), join)
        contents = own if contents is None else contents.unionAll(own)
        with arrow_rows(spark, 200):  # whole sets are large rows
            found = stored(_links(tried, contents, join))
        links = found if links is None else links.unionAll(found)
        done = tried if done is None else done.unionAll(tried)
        roots = connected(links)
        placed = (placed.select("key", "sid", "n", "bound", "n_keys").join(roots, F.col("sid") == F.col("node"), "left")
                  .select("key", "sid", "n", "bound", "n_keys", F.coalesce("root", "sid").alias("root")))
    reps = (classes.select("sid", "set_id", "rep").join(roots, F.col("sid") == F.col("node"), "left")
            .select("sid", "set_id", "rep", F.coalesce("root", "sid").alias("root")))
    least = reps.groupBy("root").agg(F.min("rep").alias("first"))
    of_set = stored(reps.join(least, "root").select(F.col("set_id").alias("s"), "first"))
    return (docs.join(of_set, F.coalesce("set_id", F.concat(F.lit("none"), F.xxhash64("doc_id").cast("string")).cast("binary")) == F.col("s"), "left")
            .select("doc_id", "tie", "n", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("first_id"),
                    F.when(F.col("first").isNull(), F.col("tie")).otherwise(F.col("first.tie")).alias("first_tie")))


def component_table(documents: DataFrame) -> DataFrame:
    """One row per document: size of its set of 3-word n-grams and the smallest doc_id that links of 90 of 100 reach."""
    return similar_groups(documents).select("doc_id", F.col("n").alias("n_shingles"), F.col("first_id").alias("component_id"))


def keep_first(documents: DataFrame, join: Join = Join(size=5, percent=80)) -> DataFrame:
    """The smallest document of each group, with all columns. Rows that repeat an id and its text are kept once.

    Documents without words (null and empty texts too) are kept. Texts of any length count whole. Columns may have any names.
    """
    with temporary(documents.sparkSession):
        groups = stored(similar_groups(documents, join), lasting=True)
    out = without(documents, F.xxhash64("text"), groups.where(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")))).select("doc_id", "tie"))
    repeated = groups.groupBy("doc_id", "tie").count().where("count > 1").select("doc_id", "tie")
    if repeated.isEmpty():
        return out
    rest = without(out, F.xxhash64("text"), repeated)
    own, id_, tie_ = (fresh(x, out) for x in ("_own", "_id", "_tie"))
    again = (out.withColumn(own, F.xxhash64("text"))
             .join(repeated.select(F.col("doc_id").alias(id_), F.col("tie").alias(tie_)), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(tie_)), "left_semi"))
    return rest.unionByName(again.dropDuplicates(["doc_id", own]).drop(own))
