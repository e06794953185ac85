"""Packing documents into sequences by linear grouping.

Texts are tokenised and cut into pieces of at most ``capacity`` tokens. The plan needs only how many pieces each length
has, at most ``capacity`` numbers however many documents there are, and is made on the driver:

1. Lengths above ``capacity * share`` are large. In falling order they are split into a number of groups of equal
   cardinality, and each length is rounded up to the largest of its group.
2. With so few sizes, the configurations (which sizes share a sequence) are optimised by column generation: a linear
   programme over configurations whose new columns come from a knapsack over its prices; rounded down to whole sequences.
3. Actual lengths take the places of the rounded ones. Runs of equal lengths stay runs.
4. Large pieces left by the rounding down and all small ones go by falling length to the sequences with the least room
   that fits; new sequences are opened when none does.

(Fernandez de la Vega, Lueker, Bin packing can be solved within 1 + epsilon in linear time, 1981; Gilmore, Gomory, 1961.)

Pieces are then numbered within their length and look their place up in the plan. Numbering uses as many salts for a
length as its count asks for, so a length that a third of all pieces have is spread over many tasks.

Defined results: null and empty texts are one piece with the end token only. Repeated rows are packed as often as they
come. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm.common import cut, one_table, raw_texts, worker_cache

CAPACITY = 4096
END_ID = 1
# Each pair of these is tried; the plan with the fewest sequences is taken.
LARGE_SHARES = (1 / 4, 1 / 3, 1 / 2)
GROUPS = (16, 32, 64)
SALT_ROWS = 256
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
_KEEP_CHUNKS = 1 << 20
_LONG_CHUNK = 64
# Lower case of Latin-1, with the white space that isn't ASCII as a space.
_LATIN_LOWER = bytes(ord(chr(c).lower()) if c not in (0x85, 0xA0) else 32 for c in range(256))
# The byte alphabet: printable Latin-1 characters stand for themselves, the other bytes follow from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SELF)))}


class Encoder(dict):
    """Token ids of UTF-8 texts, equal to ``tokenizer.encode(text, add_special_tokens=False)``, as little-endian bytes.

    No token of this vocabulary crosses white space, so every distinct chunk between white space is encoded once and
    remembered. That holds for texts of Latin-1 characters, whose lower case and white space are plain tables and which
    are in normal form; any other text, or one that holds a special token, is encoded whole. The dict holds the chunks
    met first, up to _KEEP_CHUNKS; frequent ones come early.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        # The vocabulary's own pattern for words.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall

    def _chunks(self, raw: bytes) -> list[bytes] | None:
        if not raw.isascii():
            try:
                raw = raw.decode().encode("latin-1")
            except UnicodeEncodeError:
                return None
        return None if any(token in raw for token in self.special) else raw.translate(_LATIN_LOWER).split()

    def __missing__(self, chunk: bytes) -> bytes:
        """The ids of a chunk: those of its words, each given to the model in the byte alphabet of the vocabulary."""
        text = chunk.decode("latin-1")
        if text.isalpha():
            word = chunk if chunk.isascii() else text.encode()
            tokens = self.model.tokenize(word.decode("latin-1").translate(_BYTE_LETTERS))
            found = array("I", [token.id for token in tokens]).tobytes()
        elif text[:-1].isalpha():
            found = self[chunk[:-1]] + self._symbols(text[-1])
        else:
            found = b"".join([self[p.encode("latin-1")] if p.isalpha() else self._symbols(p) for p in self.split(text)])
        if len(chunk) <= _LONG_CHUNK and len(self) < _KEEP_CHUNKS:
            self[chunk] = found
        return found

    def _symbols(self, part: str) -> bytes:
        word = part.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [token.id for token in self.model.tokenize(word)]).tobytes()

    def __call__(self, raw: bytes) -> bytes:
        chunks = self._chunks(raw)
        return self._whole(raw) if chunks is None else b"".join(map(self.__getitem__, chunks))

    def _whole(self, raw: bytes) -> bytes:
        return np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_cache(("encoder", path), lambda: Encoder(path))
        for ids, column in one_table(batches, ["doc_id", "text"]):
            rows, numbers, lengths, sums = [], [], [], []
            for row, raw in enumerate(raw_texts(column)):
                tokens = memoryview(encode(raw) + end)
                for number, start in enumerate(range(0, len(tokens), 4 * capacity)):
                    part = tokens[start:start + 4 * capacity]
                    rows.append(row)
                    numbers.append(number)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(lengths, pa.int64()),
                 pa.array(sums, pa.int64())], names=["doc_id", "piece", "length", "ids_crc32"])
    return cut_texts


def pieces(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", "text")
            .mapInArrow(_pieces(path, capacity, end_id), f"doc_id {kind}, piece int, length long, ids_crc32 long")
            .select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "length", "ids_crc32"))


# ------------------------------------------------------------------ the plan, over the counts of lengths


def configurations(sizes: list[int], demands: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations (how often each size) and how many sequences take each, rounded down from the linear optimum."""
    count = len(sizes)
    if not count:
        return []
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    demand = np.array(demands, dtype=float)
    for _ in range(50 * count):
        price = np.linalg.solve(basis.T, np.ones(count))
        # Best value of each used room, by number of pieces; last[p][w]: the size that was added last.
        value, last = np.zeros(capacity + 1), []
        for _ in range(capacity // min(sizes)):
            better, chosen = value.copy(), np.full(capacity + 1, -1)
            for k, size in enumerate(sizes):
                gain = value[:capacity + 1 - size] + price[k]
                ahead = gain > better[size:] + 1e-12
                better[size:][ahead] = gain[ahead]
                chosen[size:][ahead] = k
            if (chosen < 0).all():
                break
            value = better
            last.append(chosen)
        if value[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(count), capacity
        for chosen in reversed(last):
            if chosen[room] >= 0:
                column[chosen[room]] += 1
                room -= sizes[chosen[room]]
        used, along = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratios = np.where(along > 1e-9, used / np.where(along > 1e-9, along, 1), np.inf)
        basis[:, int(ratios.argmin())] = column
    used = np.linalg.solve(basis, demand)
    return [(basis[:, k].astype(int), int(used[k] + 1e-6)) for k in range(count) if used[k] >= 1 - 1e-6]


def plan(counts: dict[int, int], capacity: int = CAPACITY, large_share: float = LARGE_SHARES[1],
         groups: int = GROUPS[0]) -> tuple[np.ndarray, int]:
    """Places for all pieces, and the number of sequences.

    A row (length, rank, bins, first sequence, offset) places the pieces of a length from that rank on: one to each of
    ``bins`` sequences at the offset, then a second to each behind the first, and so on up to the next row's rank.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    rank = dict.fromkeys(counts, 0)
    opened = 0
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left to the (bins, first sequence) that have it
    order: list[int] = []

    def room(left: int, bins: int, first: int) -> None:
        if left and bins:
            if left not in rooms:
                insort(order, left)
            rooms.setdefault(left, []).append((bins, first))

    def place(length: int, each: int, bins: int, first: int, offset: int) -> None:
        rows.append((length, rank[length], bins, first, offset))
        rank[length] += each * bins

    # 1. and 2.
    large = [(length, counts[length]) for length in sorted(counts, reverse=True) if length > capacity * large_share]
    total = sum(n for _, n in large)
    share = -(-total // groups) if total else 1
    grouped: list[list[list[int]]] = []
    taken = share
    for length, n in large:
        while n:
            if taken == share:
                grouped.append([])
                taken = 0
            step = min(n, share - taken)
            grouped[-1].append([length, step])
            n, taken = n - step, taken + step
    merged: dict[int, list[list[int]]] = {}  # groups with the same largest length are one size
    for group in grouped:
        merged.setdefault(group[0][0], []).extend(group)
    sizes = list(merged)
    runs = list(merged.values())
    chosen = configurations(sizes, [sum(n for _, n in run) for run in runs], capacity)

    # 3.
    for config, bins in sorted(chosen, key=lambda x: -x[1]):
        slots = [k for k, times in enumerate(config) for _ in range(times)]
        filled: list[list[list[int]]] = []
        for k in slots:
            own, need = [], bins
            while need and runs[k]:
                step = min(need, runs[k][0][1])
                own.append([runs[k][0][0], step])
                need -= step
                runs[k][0][1] -= step
                if not runs[k][0][1]:
                    runs[k].pop(0)
            if need:
                own.append([0, need])
            filled.append(own)
        done = 0
        while done < bins:
            step = min(own[0][1] for own in filled)
            offset = 0
            for own in filled:
                if own[0][0]:
                    place(own[0][0], 1, step, opened + done, offset)
                    offset += own[0][0]
                own[0][1] -= step
                if not own[0][1]:
                    own.pop(0)
            room(capacity - offset, step, opened + done)
            done += step
        opened += bins

    # 4.
    for length in sorted(counts, reverse=True):
        n = counts[length] - rank[length]
        while n:
            at = bisect_left(order, length)
            if at == len(order):
                bins = -(-n // (capacity // length))
                room(capacity, bins, opened)
                opened += bins
                continue
            left = order[at]
            bins, first = rooms[left].pop()
            if not rooms[left]:
                del rooms[left]
                order.pop(at)
            each = min(left // length, n)
            full = min(bins, n // each)
            place(length, each, full, first, capacity - left)
            n -= each * full
            room(left - each * length, full, first)
            room(left, bins - full, first + full)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), opened


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """The plan with the fewest sequences over all LARGE_SHARES and GROUPS."""
    return min((plan(counts, capacity, share, n) for share in LARGE_SHARES for n in GROUPS), key=lambda made: made[1])


# ------------------------------------------------------------------ places of the pieces


def _places(rows: np.ndarray):
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (rows[:, 0] << 48) | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            row = rows[np.searchsorted(keys, (length << 48) | rank, side="right") - 1]
            behind, bin_ = np.divmod(rank - row[:, 1], row[:, 2])
            kept = [batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(row[:, 3] + bin_), pa.array(row[:, 4] + behind * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return look_up


def pack(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID,
         salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    made = cut(pieces(docs, path, capacity, end_id))
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most `capacity` rows
    rows, _ = best_plan(counts, capacity)
    salts = spark.createDataFrame([(k, -(-n // salt_rows)) for k, n in counts.items()], "l long, salts long")
    numbered = (made.withColumn("uid", F.monotonically_increasing_id())  # stable: the checkpoint fixes the rows' order
                .join(F.broadcast(salts), F.col("length") == F.col("l"))  # at most `capacity` rows
                .withColumn("salt", F.col("uid") % F.col("salts")).drop("l", "salts"))
    sums = numbered.groupBy(F.col("length").alias("l"), F.col("salt").alias("s")).count()
    before = Window.partitionBy("l").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut(sums.select("l", "s", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")))
    within = Window.partitionBy("length", "salt").orderBy("uid")
    ranked = (numbered.withColumn("rank", F.row_number().over(within) - 1)
              .join(firsts, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s")))
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("rank")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(_places(rows), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
                                            "sequence_id long, offset long")
