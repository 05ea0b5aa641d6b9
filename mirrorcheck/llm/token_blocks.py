"""Token ids in patched frame-of-reference blocks, written and read by Spark.

A segment is one binary value of a Parquet row and holds whole documents in ascending order:

    "PFR1" | documents u32 | ids u64 | block length u32 | blocks u32
    ids of each document u32 ... | byte at which each block starts u32 ... | blocks

and a block is

    minimum u32 | width u8 | exceptions u16 | differences packed at that width
    | positions of the exceptions u16 ... | their differences u32 ...

The width of a block is the least one that holds the chosen share of its differences from the block minimum;
the others are exceptions, packed as 0. The block starts let a reader decode any span of ids by itself.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import as_bytes, slices
from .common import arrow_bytes, scratch

MAGIC, HEAD, BLOCK_HEAD = b"PFR1", struct.Struct("<4sIQII"), struct.Struct("<IBH")
BLOCK, SHARE, SEGMENT_IDS = 1024, 0.9, 1 << 18


def encode_segment(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK, share: float = SHARE) -> bytes:
    """The bytes of one segment; ``lengths`` are the ids of each document and sum to ``len(ids)``."""
    n, n_blocks = len(ids), -(-len(ids) // block)
    sizes = np.full(n_blocks, block)
    if n % block:
        sizes[-1] = n % block
    padded = np.empty(n_blocks * block, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    values = padded.reshape(n_blocks, block)
    least = values.min(axis=1) if n else np.zeros(0, np.uint32)
    above = values - least[:, None]
    width = np.full(n_blocks, 32)
    needed, inside = np.ceil(share * sizes), np.arange(block)[None, :] < sizes[:, None]
    for w in range(31, -1, -1):
        fits = ((above < (1 << w)) & inside).sum(axis=1) >= needed
        if not fits.any():
            break
        width[fits] = w
    late = (above >= (np.uint64(1) << width.astype(np.uint64))[:, None]) & inside
    packed: list[bytes] = [b""] * n_blocks
    kept = np.where(late, 0, above)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        bits = ((kept[at][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
        for i, row in zip(at, np.packbits(bits.reshape(len(at), -1), axis=1)):
            packed[i] = row[: -(-int(sizes[i]) * int(w) // 8)].tobytes()
    blocks = []
    for i in range(n_blocks):
        where = np.flatnonzero(late[i])
        blocks.append(BLOCK_HEAD.pack(int(least[i]), int(width[i]), len(where)) + packed[i]
                      + where.astype("<u2").tobytes() + above[i, where].astype("<u4").tobytes())
    starts = HEAD.size + 4 * (len(lengths) + n_blocks) + np.concatenate(([0], np.cumsum([len(b) for b in blocks])))[:n_blocks]
    return b"".join([HEAD.pack(MAGIC, len(lengths), n, block, n_blocks), np.asarray(lengths, "<u4").tobytes(),
                     starts.astype("<u4").tobytes(), *blocks])


def segment_lengths(body: bytes) -> np.ndarray:
    """Ids of each document of a segment."""
    magic, n_docs, _, _, _ = HEAD.unpack_from(body)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    return np.frombuffer(body, "<u4", n_docs, HEAD.size)


def decode_segment(body: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of a segment; only the blocks that hold them are read."""
    magic, n_docs, n, block, n_blocks = HEAD.unpack_from(body)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(body, "<u4", n_blocks, HEAD.size + 4 * n_docs)
    lo, hi = first // block, -(-last // block)
    out = np.empty((hi - lo) * block, np.uint32)
    for i in range(lo, hi):
        at, size = int(starts[i]), min(block, n - i * block)
        least, width, n_late = BLOCK_HEAD.unpack_from(body, at)
        at += BLOCK_HEAD.size
        n_bytes = -(-size * width // 8)
        bits = np.unpackbits(np.frombuffer(body, np.uint8, n_bytes, at), count=size * width).reshape(size, width)
        values = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32)) if width else np.zeros(size, np.uint32)
        where = np.frombuffer(body, "<u2", n_late, at + n_bytes)
        values[where] = np.frombuffer(body, "<u4", n_late, at + n_bytes + 2 * n_late)
        out[(i - lo) * block:(i - lo) * block + size] = values + np.uint32(least)
    return out[first - lo * block:last - lo * block]


class PieceEncoder:
    """Encodes texts with a tokenizer file; keeps the ids of pieces seen before if the file is a plain byte-level one.

    A byte-level tokenizer that cuts texts by its own expression, changes nothing beforehand and joins nothing across
    cuts never lets what stands before a single space between two non-spaces touch what follows; nor what stands
    before the end of a run of ASCII letters, or before or after a single line feed between two non-spaces. Texts are
    cut there and each distinct piece is encoded once while it stays in the store, which compares whole pieces. The file is
    asked whether it is of that kind; texts for which a shortcut doesn't hold (other white space, strings of special
    tokens) and all texts of other files are encoded by the library as they are.
    """

    #: White space other than the space and the line feed.
    RARE_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]")

    # Fixed values of byte-level tokenizers: how a text of the first Unicode blocks is cut, and the character of each byte.
    _L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
    PARTS = re.compile(f"\t|'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\\s{_L}{_N}]+|[ \n]+(?!\\S)|[ \n]+")
    SIMPLE = staticmethod(re.compile("[\t\n -~ªµº¡-¬®-ɏ]*").fullmatch)
    TAB = chr(256 + 9)  # stands between pieces, as none holds a tab
    _SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
    NAMES = np.arange(256, dtype="<u4")
    NAMES[sorted(set(range(256)) - set(_SHOWN))] = 256 + np.arange(256 - len(_SHOWN))
    NAMES[1] = 32  # parts are parted by byte 1

    #: 1 for ASCII letters, 2 for bytes beyond ASCII, else 0.
    KIND = np.array([2 if b >= 128 else int(chr(b).isalpha()) for b in range(256)], np.uint8)

    def __init__(self, path: str, keep: int = 400_000, special_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [] if special_as_text else [t["content"] for t in spec["added_tokens"] if t["special"]]
        cut, model = spec["pre_tokenizer"] or {}, spec["model"]
        self.by_piece = (spec["normalizer"] is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
                         and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
                         and not model.get("end_of_word_suffix") and not model.get("ignore_merges") and all(t["special"] for t in spec["added_tokens"]))
        self.keep = keep
        self.by_part = Tokenizer(self.tokenizer.model)
        self.by_part.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.tab_id = self.tokenizer.token_to_id(self.TAB)
        self.by_piece &= self.tab_id is not None
        self._empty()

    def _empty(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0
        self.at, self.n = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _shrink(self) -> None:
        """Make room: only what was learnt first stays, as frequent pieces come early."""
        n = min(len(self.slots), self.keep // 4)
        self.slots = {k: i for k, i in self.slots.items() if i < n}
        self.used = int(self.at[n - 1] + self.n[n - 1]) if n else 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _simple(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of the first Unicode blocks, with tabs between them, and how many each has: cut into parts here, given to the model at once."""
        flat = "\x01".join(self.PARTS.findall(text)).encode()
        shown = self.NAMES[np.frombuffer(flat, np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.by_part.encode_batch_fast([shown], add_special_tokens=False)[0].ids, np.uint32)
        between = ids == self.tab_id
        return ids[~between], np.diff(np.concatenate(([-1], np.flatnonzero(between), [len(ids)]))) - 1

    def _learn(self, pieces: list[bytes]) -> None:
        text = b"\t".join(pieces).decode()
        if not self.SIMPLE(text):
            kinds: tuple[list, list] = ([], [])
            for x in text.split("\t"):
                kinds[self.SIMPLE(x) is None].append(x)
            own = [self._ids(x) for x in kinds[1]]
            self._store([x.encode() for x in kinds[1]], np.concatenate(own), np.array([len(x) for x in own], np.int64))
            if not kinds[0]:
                return
            pieces, text = [x.encode() for x in kinds[0]], "\t".join(kinds[0])
        self._store(pieces, *self._simple(text))

    def _store(self, pieces: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        first, size, total = len(self.slots), len(self.slots) + len(pieces), self.used + len(ids)
        if size > len(self.at):
            for name in ("at", "n"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.empty(max(size, 2 * len(old)) - len(old), old.dtype))))
        if total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.empty(max(total, 2 * len(self.pool)) - len(self.pool), np.uint32)))
        self.pool[self.used:total] = ids
        self.at[first:size] = self.used + np.cumsum(n) - n
        self.n[first:size], self.used = n, total
        self.slots.update(zip(pieces, range(first, size)))

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces of plain texts start."""
        kind = self.KIND[data]
        begin = data == 32
        begin[1:] |= (kind[:-1] == 1) & (kind[1:] == 0)
        line = np.flatnonzero(data == 10)
        if len(line):  # never first or last in a plain text
            lone = line[(data[line - 1] != 10) & (data[line + 1] != 10)]
            begin[lone] = begin[lone + 1] = True
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(begin)

    def _plain(self, text: str) -> bool:
        return bool(text) and not ("  " in text or "\n " in text or " \n" in text or text[0] in " \n" or text[-1] in " \n"
                                   or self.RARE_SPACE.search(text) or any(s in text for s in self.special))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a column, one text after the other, and how many each has; null is empty."""
        texts = [x or "" for x in column.to_pylist()]
        plain = np.array([self.by_piece and self._plain(x) for x in texts], bool)
        whole = {i: self._ids(texts[i]) for i in np.flatnonzero(~plain) if texts[i]}
        data, offsets = as_bytes(column)
        if whole:  # only bytes of plain texts are cut
            sizes = np.where(plain, np.diff(offsets), 0)
            data, offsets = data[np.repeat(plain, np.diff(offsets))], np.append(0, np.cumsum(sizes))
        counts, ids = np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        if len(data):
            starts = self._starts(data, offsets)
            at = pa.py_buffer(np.append(starts, len(data)))
            pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, at, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
            distinct = pieces.dictionary.to_pylist()
            if len(self.slots) + len(distinct) > self.keep:
                self._shrink()
            new = [p for p in distinct if p not in self.slots]
            if new:
                self._learn(new)
            slot = np.fromiter(map(self.slots.__getitem__, distinct), np.int64, len(distinct))[pieces.indices.to_numpy()]
            n = self.n[slot]
            ends = np.cumsum(n)
            ids = self.pool[np.repeat(self.at[slot] - ends + n, n) + np.arange(int(ends[-1]))]
            counts += np.bincount(np.searchsorted(offsets, starts, "right") - 1, n, len(texts)).astype(np.int64)
        if whole:
            places = np.append(0, np.cumsum(counts))
            parts, last = [], 0
            for i, own in whole.items():
                parts += [ids[last:places[i]], own]
                last, counts[i] = places[i], len(own)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, counts


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder_for(path: str, special_as_text: bool = False) -> PieceEncoder:
    """One encoder for all tasks of a Python worker; another file takes its place."""
    key = (path, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(path, special_as_text=special_as_text)
    return _ENCODERS[key]


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_ids: int = SEGMENT_IDS,
                 key: str = "doc_id", text: str = "text", special_as_text: bool = False) -> None:
    """Encode every text, add ``end_id`` and write segments to ``path`` in ascending order of the key.

    Columns written: part, segment (its number in the part), n_ids, keys, body. Parts and segments follow the
    order of the keys; nulls come first and equal keys follow a hash of the text. Null and empty texts are the end id
    alone. A segment ends with the document that brings it to ``segment_ids``. Strings of special tokens in a text become those
    tokens, as the library does by default, unless ``special_as_text``. Texts of any length are encoded whole; equal rows
    stand one after the other; no documents give no segment.
    """
    key_type = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = encoder_for(tokenizer, special_as_text), TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[np.ndarray] = []
        lengths: list[int] = []
        sum_of = [0]

        def segment() -> pa.RecordBatch:
            body = encode_segment(np.concatenate(held), np.array(lengths))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([sum(lengths)], pa.int64()),
                 pa.array([keys], pa.list_(arrow_key)), pa.array([body], pa.binary())], schema.names)

        for batch in slices(batches):
            arrow_key = batch.column("key").type
            ids, counts = encoder.encode(batch.column("text"))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, np.uint32(end_id))
            at = np.append(0, ends + np.arange(1, len(ends) + 1))
            here = 0
            for k in range(len(counts)):
                keys.append(batch.column("key")[k].as_py())
                lengths.append(int(counts[k]) + 1)
                if sum_of[0] + at[k + 1] - at[here] >= segment_ids:
                    held.append(ids[at[here]:at[k + 1]])
                    yield segment()
                    keys, held, lengths, number, here = [], [], [], number + 1, k + 1
                    sum_of[0] = 0
            held.append(ids[at[here]:])
            sum_of[0] += int(at[-1] - at[here])
        if lengths:
            yield segment()

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("n_ids", T.LongType()),
                           T.StructField("keys", T.ArrayType(key_type)), T.StructField("body", T.BinaryType())])
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    with arrow_bytes(documents.sparkSession):
        rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").mapInArrow(run, schema).write.mode("overwrite").parquet(path)


def read_tokens(spark, path: str, use: Callable[[np.ndarray], object] | None = None, kind: str = "array<long>", name: str = "ids") -> DataFrame:
    """One row per document of the files at ``path``: key, start (ids of all documents before it), n_tokens and ``name``.

    ``use`` makes ``name`` (of type ``kind``) from the decoded ids; without it, the ids themselves come.
    """
    segments = spark.read.parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = (segments.select("part", "segment", "n_ids").join(parts.select(F.col("part").alias("p"), before.alias("before")), F.col("part") == F.col("p"))
              .select("part", "segment", (F.col("before") + inside).alias("first")))
    key_type = segments.schema["keys"].dataType.elementType
    out = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("key", key_type),
                        T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()),
                        *T._parse_datatype_string(f"{name} {kind}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for part, number, keys, body in zip(*[batch.column(c).to_pylist() for c in ("part", "segment", "keys", "body")]):
                lengths, ids = segment_lengths(body).astype(np.int64), decode_segment(body)
                at = np.concatenate(([0], np.cumsum(lengths)))
                made = [(use or (lambda x: x.astype(np.int64)))(ids[a:b]) for a, b in zip(at[:-1], at[1:])]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()),
                                                  pa.array(keys, batch.column("keys").type.value_type), pa.array(at[:-1], pa.int64()),
                                                  pa.array(lengths, pa.int64()), pa.array(made, to_arrow_type(out[name].dataType))], out.names)

    docs = segments.select("part", "segment", "keys", "body").mapInArrow(run, out)
    return (docs.join(starts, ["part", "segment"]).withColumn("start", F.col("first") + F.col("offset"))
            .select("key", "start", "n_tokens", name))


def token_table(documents: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the token files of all documents, read them back: one row per document with place, length and checksum."""
    spark = documents.sparkSession
    path = path or scratch(spark)
    write_tokens(documents, path, tokenizer, end_id)
    crc = read_tokens(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "long", "ids_crc32")
    return crc.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
