"""Sequence packing by Karmarkar-Karp multiway differencing.

A document becomes token ids and an end id. Full windows are cut off as sequences of their own; the rests are collected
into groups worth GROUP_WINDOWS windows less MARGIN tokens each, and partitioned: every rest starts as a partial partition
with one non-zero window, and the two partial partitions of largest spread are merged again and again, the fullest window
of one with the emptiest of the other, until one is left with near-equal windows. Where a window exceeds the capacity, the
partition is made anew with one window more. The windows are the sequences. With about three whole rests a window their sums
would differ by a tenth; as documents may be cut freely, every CUT_EVERY-th rest is cut into pieces of PIECE tokens and
halves of that, with which differencing evens the windows out, so that most stay within the margin and padding is about
one percent. What is left at the end of a task is cut at powers of two, which need no padding.

Ids come from a memory of encoded chunks. A space between two characters that aren't white space always begins a new
pre-token, so chunks cut there are encoded by themselves; new chunks of a batch are encoded together and told apart by
their tokens' bytes. Texts with other white space around a space, or with an added token of the vocabulary, are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import re
import zlib
from array import array
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import to_python

CAPACITY, END_ID, GROUP_WINDOWS = 2048, 1, 64
#: Tokens by which a group's windows are planned below the capacity, and the rests that are cut, and into what.
MARGIN, CUT_EVERY, PIECE = 16, 20, 64
VOCABULARY = "byte_bpe_50k"
_ODD_SPACE = re.compile(r"(?:^|\s) | (?:\s|$)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def added_tokens(path: str) -> dict[str, int]:
    """The tokens that a tokenizers file finds in texts as they are, whatever is around them; {} without such a file."""
    file = path.removesuffix(".tiktoken") + ".json"
    if not os.path.exists(file):
        return {}
    with open(file, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


class Encoder(dict):
    """chunk -> ids as little-endian unsigned 32-bit; the ids are those of the tokenizers file of the same vocabulary."""

    limit = 250_000

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        added = added_tokens(path)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = list(map(len, ranks))

    def whole(self, text: str) -> bytes:
        special = self.added and self.added.search(text)
        return array("I", self.encoding.encode(text, allowed_special="all") if special else self.encoding.encode_ordinary(text)).tobytes()

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks, each with a space before it, in one call."""
        joined = " " + " ".join(chunks)
        ids = np.array(self.encoding.encode_ordinary(joined), np.uint32)
        ends = np.cumsum(self.lengths[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(c.encode("utf-8", "surrogatepass")) + 1 for c in chunks]), "left") + 1
        start = 0
        for chunk, end in zip(chunks, cuts.tolist(), strict=True):
            self[chunk] = ids[start:end].tobytes()
            start = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without the end id."""
        if len(self) > self.limit:
            self.clear()
        parts = [t.split(" ") if t and not _ODD_SPACE.search(t) and not (self.added and self.added.search(t)) else None for t in texts]
        new = dict.fromkeys(c for p in parts if p for c in p[1:] if c not in self)
        if new:
            self.learn(list(new))
        return [self.whole(t) if p is None else self.whole(p[0]) + b"".join(map(self.__getitem__, p[1:])) for t, p in zip(texts, parts, strict=True)]


def differenced(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes in k windows of near-equal sums, by Karmarkar-Karp differencing."""
    order = count()
    # a partial partition: windows (sum, indices) with a sum, fullest first; the others are empty
    heap = [(-size, next(order), [(size, (i,))]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        free = k - len(a)
        if len(b) <= free:
            windows = sorted([*a, *b], key=lambda w: -w[0])
        else:
            # b's fullest go to a's empty windows, its others to a's emptiest first
            joined = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(reversed(a), b[free:], strict=False)]
            windows = sorted([*a[: len(a) - len(joined)], *joined, *b[:free]], key=lambda w: -w[0])
        if len(windows) == k:
            low = windows[-1][0]
            heapq.heappush(heap, (low - windows[0][0], next(order), windows))
        else:
            heapq.heappush(heap, (-windows[0][0], next(order), windows))
    return [list(w[1]) for w in heap[0][2]] if heap else []


def windows_for(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """A differenced partition that no window of exceeds the capacity: the number of windows rises until it fits."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differenced(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        k += 1


def halved(length: int, largest: int = PIECE, least: int = 4) -> list[int]:
    """Lengths of pieces: largest, its half and so on down to least, again and again."""
    out, size = [], largest
    while length:
        out.append(min(size, length))
        length -= out[-1]
        size = size // 2 if size // 2 >= least else largest
    return out


def at_powers_of_two(pieces: list[tuple]) -> list[list[tuple]]:
    """Sequences whose lengths are the powers of two in the pieces' total, largest first."""
    total, out, rest = sum(p[2] for p in pieces), [], list(reversed(pieces))
    for bit in range(total.bit_length() - 1, -1, -1):
        room, sequence = total & (1 << bit), []
        while room:
            owner, start, length = rest.pop()
            take = min(room, length)
            sequence.append((owner, start, take))
            if take < length:
                rest.append((owner, start + take, length - take))
            room -= take
        if sequence:
            out.append(sequence)
    return out


class Packer:
    """Collects a task's documents and yields sequences of pieces (owner, start, length)."""

    def __init__(self, capacity: int = CAPACITY, group: int = GROUP_WINDOWS):
        self.capacity, self.planned, self.group = capacity, capacity - min(MARGIN, capacity // 8), group
        self.rests, self.size, self.windows = [], 0, 0

    def add(self, owner, length: int):
        start = 0
        while length - start >= self.capacity:
            yield [(owner, start, self.capacity)]
            start += self.capacity
        while length > start:
            take = min(length - start, self.group * self.planned - self.size)
            self.rests.append((owner, start, take))
            self.size += take
            start += take
            if self.size == self.group * self.planned:
                yield from self._differenced(self.rests)
                self.rests, self.size = [], 0

    def _differenced(self, rests: list[tuple]):
        pieces = []
        for k, (owner, start, length) in enumerate(rests):
            for n in halved(length) if k % CUT_EVERY == 0 else (length,):
                pieces.append((owner, start, n))
                start += n
        for window in windows_for([p[2] for p in pieces], self.capacity):
            sequence = []
            for owner, start, length in (pieces[i] for i in sorted(window)):
                if sequence and sequence[-1][0] is owner and sequence[-1][1] + sequence[-1][2] == start:
                    sequence[-1] = (owner, sequence[-1][1], sequence[-1][2] + length)
                else:
                    sequence.append((owner, start, length))
            yield sequence

    def end(self):
        whole, room = [], self.size // self.planned * self.planned
        rest = list(reversed(self.rests))
        while room:
            owner, start, length = rest.pop()
            take = min(room, length)
            whole.append((owner, start, take))
            if take < length:
                rest.append((owner, start + take, length - take))
            room -= take
        yield from self._differenced(whole) if whole else ()
        yield from at_powers_of_two(list(reversed(rest)))


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if keep_ids).

    A null or empty text is the end id alone. Every row is a document of its own, also where ids repeat or are null. A
    task packs the rows of its partition and holds one group of rests; sequence ids are unique over all tasks (partition
    number times 2^40 plus a count). vocabulary: path of a file of ranks.
    """
    import public_tokenizers

    path, pattern = vocabulary or vocabulary_path(), public_tokenizers.PATTERN
    fields = [docs.schema[id_col]] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [T.StructField("ids", T.BinaryType())] * keep_ids

    def run(batches):
        encoder, packer, numbers = Encoder(path, pattern), Packer(capacity), count(TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4").tobytes()
        rows: list[list] = [[] for _ in fields]

        def put(sequence):
            number, offset = next(numbers), 0
            for (doc, ids), start, length in sequence:
                piece = ids[4 * start : 4 * (start + length)]
                for column, value in zip(rows, (doc, start, length, zlib.crc32(piece), len(ids) // 4, number, offset, piece), strict=False):
                    column.append(value)
                offset += length

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(rows[0], kind), *(pa.array(r, pa.binary() if f.name == "ids" else pa.int64()) for r, f in zip(rows[1:], fields[1:], strict=True))], [f.name for f in fields])
            for r in rows:
                r.clear()
            return out

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            k = 0
            while k < len(texts):
                first, size = k, 0
                while k < len(texts) and size < 2_000_000:
                    size += len(texts[k])
                    k += 1
                for doc, encoded in zip(ids[first:k], encoder.encode(texts[first:k]), strict=True):
                    encoded += end
                    for sequence in packer.add((doc, encoded), len(encoded) // 4):
                        put(sequence)
                yield flushed()
        if kind is not None:
            for sequence in packer.end():
                put(sequence)
            yield flushed()

    return to_python(docs.select(id_col, text)).mapInArrow(run, T.StructType(fields))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
