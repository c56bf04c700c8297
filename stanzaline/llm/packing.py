"""Best-fit packing of tokenized documents into sequences of bounded length.

Documents are tokenized once; those longer than a sequence are cut into full pieces. Pieces are then
placed, longest first, by the sum-of-squares rule: among the gaps of open sequences that a piece fits
into it goes where the sum of squared counts of open sequences per residual gap becomes smallest. A new
sequence is opened only for a piece that fits into none, since every sequence more is one too many.

Defined cases: a null text is empty, and an empty document is one piece with the end token alone; a very
long text is as many pieces as it takes; repeated rows and ties are pieces of their own; null doc_ids are
kept; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

CAPACITY = 2048
END = 0
#: Pieces that one shard packs; open sequences at a shard's end are what sharding costs.
SHARD_PIECES = 60_000
#: Entries of each of a worker's two word caches.
CACHE = 300_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Fixed: the pre-tokenizer's split pattern for which WordEncoder has a fast path, and the rest of that layout.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def splits_at_blanks(layout: dict) -> bool:
    """Whether a tokenizer file normalizes and splits in the way that WordEncoder knows."""
    normalizer, splitter = layout.get("normalizer") or {}, layout.get("pre_tokenizer") or {}
    steps = normalizer.get("normalizers", [])
    parts = splitter.get("pretokenizers", [])
    blanks = [s for s in steps if s.get("type") == "Replace"]
    return (
        layout.get("model", {}).get("type") == "BPE"
        and not layout["model"].get("ignore_merges")
        and [s.get("type") for s in steps] == WORD_NORMALIZERS
        and all(s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in blanks)
        and [s.get("type") for s in parts] == ["Split", "ByteLevel"]
        and parts[0].get("pattern") == {"Regex": WORD_SPLIT}
        and parts[0].get("behavior") == "Removed"
        and parts[0].get("invert") is True
        and parts[1].get("add_prefix_space") is False
        and parts[1].get("use_regex") is False
    )


class WordEncoder:
    """Token ids of whole texts.

    Where the tokenizer's words never cross white space, a text has the ids of its parts between white
    space, one after the other, so parts that were seen before are looked up. Anything out of the
    ordinary, and any text where the tokenizer file has another layout, goes through the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.by_words = splits_at_blanks(json.load(file))
        self.model = self.full.model
        self.special = [x.content.encode() for x in self.full.get_added_tokens_decoder().values()]
        self.split = regex.compile(WORD_SPLIT)
        #: Printable ASCII and letters that no normalization changes.
        self.plain = regex.compile(r"[!-~¡-¬®-įı-ňŊ-ž]+")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.byte_chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.parts: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.byte_chars)
            found = [t.id for t in self.model.tokenize(mapped)]
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(self.words) >= CACHE:
                self.words.clear()
            if len(word) <= 40:
                self.words[word] = ids
        return ids

    def _part(self, part: bytes) -> bytes:
        text = part.decode()
        if not (text.isascii() and text.isprintable() or self.plain.fullmatch(text)):
            ids = self._whole(text)
        elif (low := text.lower()).isalpha():
            ids = self._word(low)
        elif low[:-1].isalpha():  # what ends it is no letter, so a word of its own
            ids = self._word(low[:-1]) + self._word(low[-1])
        else:
            ids = b"".join(map(self._word, self.split.findall(low)))
        if len(self.parts) >= CACHE:
            self.parts.clear()
        if len(part) <= 60:
            self.parts[part] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, data: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a UTF-8 text."""
        if not self.by_words or any(s in data for s in self.special):
            return self._whole(data.decode())
        known, part = self.parts, self._part
        return b"".join([known.get(p) or part(p) for p in data.split()])


    def forget(self) -> None:
        """Drop the words that were seen: those of another task are others for the most part."""
        self.parts.clear()
        self.words.clear()


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


PIECE = "doc_id long, row long, piece int, start long, length long, ids binary"


def tokenize_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of every document: doc_id, row (a hash of the row, for joins), piece, start, length, ids (little-endian unsigned 32-bit)."""
    path, tail = tokenizer or tokenizer_path(), np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        encode = own.encode
        names = ["doc_id", "row", "piece", "start", "length", "ids"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in common.slices(batches):
            rows, held = [], 0
            for doc_id, row, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = encode(text or b"") + tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    rows.append((doc_id, row, k, at // 4, len(piece) // 4, piece))
                held += len(ids)
                if held > 8 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)
        own.forget()
        common.give_back()

    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("binary"))
    return slim.mapInArrow(run, PIECE)


_NEVER = np.iinfo(np.int64).max


class SumOfSquares:
    """Open sequences by gap; ``place`` returns (sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.made = capacity, 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        #: Open sequences per gap; a gap of 0 is closed and counts for nothing.
        self.count = np.zeros(capacity + 1, np.int64)

    def place(self, size: int) -> tuple[int, int]:
        if size == self.capacity:
            self.made += 1
            return self.made - 1, 0
        count, top = self.count, self.capacity
        # leaving gap g for g - size changes the sum by 2 * (count[g - size] - count[g] + 1), 1 - 2 * count[g] for g = size
        change = 2 * (count[: top - size] - count[size:top] + 1)
        change[0] = 1 - 2 * count[size]
        change[count[size:top] == 0] = _NEVER
        best = int(change.argmin())
        if change[best] < _NEVER:
            gap = best + size
            sequence = self.open[gap].pop()
            count[gap] -= 1
        else:
            gap, sequence = top, self.made
            self.made += 1
        if gap > size:
            self.open[gap - size].append(sequence)
            count[gap - size] += 1
        return sequence, top - gap


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset. Needs doc_id, row, piece and length; all columns stay.

    Shards hold about ``shard_pieces`` pieces each and pack by themselves; sequence ids are shard and number
    within it. Pieces are dealt by a hash of the piece and of its place in ``pieces``, so equal rows are
    spread too; ``pieces`` should be a stored table, which gives every row the same place when it is read again.
    """
    count = pieces.count()
    shards = max(1, round(count / shard_pieces))
    names = pieces.columns
    dealt = pieces.withColumn("pack_key", F.xxhash64("row", "piece", F.monotonically_increasing_id())).withColumn("pack_shard", F.pmod("pack_key", F.lit(shards)).cast("int"))
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = SumOfSquares(capacity)
        for batch in batches:
            shard = batch.column(batch.num_columns - 1).to_pylist()
            places = [packer.place(n) for n in batch.column(at).to_pylist()]
            ids = pa.array([s << 40 | q for s, (q, _) in zip(shard, places)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], ids, pa.array([o for _, o in places], pa.int64())], names=[*names, "sequence_id", "offset"])

    # one shard in each partition; its order is fixed, so an attempt that is made again gives the same places
    ordered = dealt.repartitionById(shards, "pack_shard").sortWithinPartitions(F.desc("length"), "pack_key", "doc_id", "piece").drop("pack_key")
    out = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ordered.mapInArrow(run, out)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its ids, sequence_id and offset.

    Pieces are stored with a number of their own; only that, order and length go through the packer, and the
    places are joined to the stored pieces.
    """
    numbered = tokenize_pieces(docs, tokenizer, capacity).withColumn("piece_number", F.monotonically_increasing_id())
    pieces = common.materialize(numbered, "pieces")
    places = pack(pieces.select("piece_number", "doc_id", "row", "piece", "length"), capacity)
    return pieces.join(places.select("piece_number", "sequence_id", "offset"), "piece_number").drop("piece_number")
