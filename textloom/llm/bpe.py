"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary finds pre-tokens that are tokens themselves: one displacement, one
slot, one comparison of bytes. Tier 2: other pre-tokens start as linked bytes; a heap of neighbouring pairs by (rank,
place) gives the next merge, so a piece of n bytes takes O(n log n). A memo of limited size keeps recent pieces.

The vocabulary is read on the driver from a parameter's path and broadcast: its size is that of the rank file. Documents
never meet each other, so the job is one scan without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Entries of a generation of the memo, and the longest piece in characters that it keeps.
MEMO, MEMO_CHARS = 300_000, 48
_K1, _K2, _M = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash by displacement: keys of a bucket share the seed that sends them to free slots; buckets of
    one key name their slot, as -1 - slot."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], "u8")
        in_bucket = (hashes % np.uint64(max(1, n // 4))).astype("i8")
        seeds = np.zeros(max(1, n // 4), "i8")
        slots = np.full(n, -1, "i8")  # slot -> index of the key
        by_bucket = np.argsort(in_bucket, kind="stable")
        starts = np.flatnonzero(np.diff(in_bucket[by_bucket], prepend=-1))
        buckets = sorted(np.split(by_bucket, starts[1:]), key=len, reverse=True) if n else []
        for own in buckets:
            if len(own) == 1:
                break
            for first in range(1, 1 << 40, 64):
                tried = np.arange(first, first + 64, dtype="u8")
                at = np.sort(self._mix(hashes[own], tried[:, None]), axis=1)
                fits = (slots[at] < 0).all(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1)
                if fits.any():
                    break
            seed = tried[int(np.argmax(fits))]
            seeds[in_bucket[own[0]]] = seed
            slots[self._mix(hashes[own], seed)] = own
        alone = [own[0] for own in buckets if len(own) == 1]
        free = np.flatnonzero(slots < 0)
        seeds[in_bucket[alone]] = -1 - free
        slots[free] = alone
        self.seeds, self.slots = seeds.tolist(), slots.tolist()

    def _mix(self, hashes: np.ndarray, seed: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((((hashes ^ (seed * np.uint64(_K1))) * np.uint64(_K2)) >> np.uint64(32)) % np.uint64(self.n)).astype("i8")

    def slot(self, key: bytes) -> int:
        """The key's slot; for other bytes any slot."""
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % len(self.seeds)]
        return -1 - seed if seed < 0 else (((h ^ (seed * _K1 & _M)) * _K2 & _M) >> 32) % self.n


class Vocabulary:
    """Ranks of byte strings, behind the perfect hash. Each of the 256 bytes must be there."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.keys = [keys[i] for i in self.hash.slots]
        self.ids = [ranks[k] for k in self.keys]
        self.bytes_of = {i: k for k, i in ranks.items()}
        self.ranks = dict(ranks)  # for pairs within a miss

    def find(self, piece: bytes) -> int | None:
        s = self.hash.slot(piece)
        return self.ids[s] if self.keys[s] == piece else None

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.find(piece)
        return [whole] if whole is not None else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Nodes are named by their first byte; to[i] is where node i ends, which is its right neighbour's name, and 0 once it is
        merged into another; back[i] is the name of the node that ends at i."""
        n, rank = len(piece), self.ranks.get
        to, back = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            j = to[i]
            if not j or j == n or to[j] != end:  # a neighbour has changed since
                continue
            to[i], to[j], back[end] = end, 0, i
            p = back[i]
            if p >= 0 and (r := rank(piece[p:end])) is not None:
                heappush(heap, (r, p, end))
            if end < n and (r := rank(piece[i : to[end]])) is not None:
                heappush(heap, (r, i, to[end]))
        ranks, out, i = self.ranks, [], 0
        while i < n:
            out.append(ranks[piece[i : to[i]]])
            i = to[i]
        return out


class Memo(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers. When it is full it becomes the older generation, and pieces
    that are asked for again come over from there."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = self.vocabulary.encode_piece(piece.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


#: White space as the Unicode property has it; ASCII's separators 1C-1F, which Python counts, are none.
_SPACE = r"\p{White_Space}"


class Codec:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.split = regex.compile(pattern.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\s", _SPACE).replace(r"\S", r"\P{White_Space}")).findall
        self.piece = Memo(vocabulary).__getitem__
        self.bytes_of = vocabulary.bytes_of.__getitem__

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of, np.frombuffer(packed, "<u4").tolist()))


_codecs: list[tuple[Vocabulary, str, Codec]] = []


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


OUTPUTS = {"ids": "binary", "n_tokens": "bigint", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """doc_id and the outputs asked for, a row for each row of docs. ids: little-endian unsigned 32-bit integers in a row;
    decoded: the text of the ids, decoded again; the digests are SHA-256 of ids and of decoded bytes in lowercase hex.

    A null text counts as empty and gives no ids; nulls and repeats of doc_id stay as they are; other columns are not
    read; an empty table gives an empty result. Ids do not depend on neighbours, partitions or the memo.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(Vocabulary(read_ranks(ranks_path)))
    kind = docs.schema[id_col].dataType
    schema = ", ".join([f"doc_id {kind.simpleString()}", *(f"{o} {OUTPUTS[o]}" for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = next((c for v, p, c in _codecs if v is held.value and p == pattern), None)
        if codec is None:  # a worker keeps the last one, with its memo
            codec = Codec(held.value, pattern)
            _codecs[:] = [(held.value, pattern, codec)]
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows: dict[str, list] = {o: [] for o in outputs}
                for text in part.column(1):
                    ids = codec.encode(text.as_py() or "")
                    made = {"ids": ids, "n_tokens": len(ids) // 4}
                    if "decoded" in rows or "decoded_sha256" in rows:
                        raw = codec.decode(ids)
                        made["decoded"] = raw.decode() if "decoded" in rows else None
                        made["decoded_sha256"] = hashlib.sha256(raw).hexdigest()
                    if "ids_sha256" in rows:
                        made["ids_sha256"] = hashlib.sha256(ids).hexdigest()
                    for o in outputs:
                        rows[o].append(made[o])
                arrays = [pa.array(rows[o], pa.binary() if OUTPUTS[o] == "binary" else pa.int64() if OUTPUTS[o] == "bigint" else pa.string()) for o in outputs]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", *outputs])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
