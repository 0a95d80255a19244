"""Byte-level BPE encoding and decoding.

A rank file gives each token's bytes a rank, which is its id. A piece of text starts as single bytes; the neighbouring
pair whose joined bytes have the lowest rank is merged, leftmost first, until no pair has a rank. A segment tree over the
piece's byte positions holds at each live position the rank of the pair that begins there and its root the leftmost
minimum; a merge changes three leaves (the merged position, its live neighbour to the left, the position that dies) and
the logarithmic paths above them. Many pieces of similar length are merged side by side as rows of NumPy arrays.

A piece of more than LONG_PIECE bytes is merged alone, by the same tree in plain lists.

Spark deals the documents out; tasks stream Arrow batches, remember a bounded number of encoded words, and hold a few
hundred documents' ids at a time. No shuffle, nothing gathered.

Null texts count as empty; empty texts have no ids; repeated rows repeat; other columns pass by untouched.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, short_batches, whole_text, without
from .units import UnitCache

NONE = np.int64(1) << np.int64(62)
#: Cells of one block of side-by-side trees, documents in one output batch.
CELLS, DOCS = 1 << 21, 256
LONG_PIECE = 2048


class SegmentTreeBPE:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Encodes pieces of up to `width` bytes, a power of two; ids as little-endian 32-bit integers."""
        n, bits = len(pieces), width.bit_length() - 1
        length = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        token = self.single[raw].astype(np.int64).ravel()
        place = np.arange(width)
        live = (place < length[:, None]).ravel()
        after = np.minimum(place + 1, length[:, None]).astype(np.int64)  # the length itself stands for the end
        after = np.pad(after, ((0, 0), (0, 1))).ravel()
        before = np.pad(np.broadcast_to(place - 1, (n, width)), ((0, 0), (0, 1))).ravel()
        tree = np.full((n, 2 * width), NONE)
        both = place[None, :-1] + 1 < length[:, None]
        rank = self.pair_rank(token.reshape(n, width)[:, :-1], token.reshape(n, width)[:, 1:])
        tree[:, width : 2 * width - 1] = np.where(both & (rank < NONE), rank << bits | place[:-1], NONE)
        for level in range(bits - 1, -1, -1):
            lo, hi = 1 << level, 2 << level
            tree[:, lo:hi] = np.minimum(tree[:, 2 * lo : 2 * hi : 2], tree[:, 2 * lo + 1 : 2 * hi : 2])
        tree = tree.ravel()

        def update(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            i = at + width
            tree[row * 2 * width + i] = value
            for _ in range(bits):
                i = i >> 1
                j = row * 2 * width + 2 * i
                tree[row * 2 * width + i] = np.minimum(tree[j], tree[j + 1])

        def leaf(row: np.ndarray, at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
            inside = nxt < length[row]
            rank = self.pair_rank(token[row * width + at], token[row * width + np.where(inside, nxt, 0)])
            return np.where(inside & (rank < NONE), rank << bits | at, NONE)

        rows = np.flatnonzero(tree[1 :: 2 * width] < NONE)
        while len(rows):
            best = tree[rows * 2 * width + 1]
            at = best & (width - 1)
            dies = after[rows * (width + 1) + at]
            nxt = after[rows * (width + 1) + dies]
            token[rows * width + at] = best >> bits
            live[rows * width + dies] = False
            after[rows * (width + 1) + at] = nxt
            before[rows * (width + 1) + nxt] = at
            update(rows, dies, np.full(len(rows), NONE))
            update(rows, at, leaf(rows, at, nxt))
            left = before[rows * (width + 1) + at]
            has = left >= 0
            update(rows[has], left[has], leaf(rows[has], left[has], at[has]))
            rows = rows[tree[rows * 2 * width + 1] < NONE]
        ids = token[live].astype("<i4")
        ends = np.cumsum(live.reshape(n, width).sum(1)) * 4
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge_long(self, piece: bytes) -> bytes:
        """As merge, for one piece of any length: some microseconds for each merge."""
        n = len(piece)
        width = max(2, 1 << (n - 1).bit_length())
        token, none = [int(self.single[b]) for b in piece], (1 << 62)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        find = self.pair_table.get
        tree = [none] * (2 * width)
        tree[width : width + n - 1] = [none if (r := find(a << 20 | b)) is None else r * width + i for i, (a, b) in enumerate(zip(token, token[1:]))]
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def update(at: int, value: int) -> None:
            i = at + width
            tree[i] = value
            while i > 1:
                i >>= 1
                least = tree[2 * i] if tree[2 * i] <= tree[2 * i + 1] else tree[2 * i + 1]
                if tree[i] == least:
                    break
                tree[i] = least

        def leaf(at: int, nxt: int) -> int:
            rank = find(token[at] << 20 | token[nxt]) if nxt < n else None
            return none if rank is None else rank * width + at

        while (best := tree[1]) < none:
            rank, at = divmod(best, width)
            dies = after[at]
            nxt = after[dies]
            token[at], token[dies], after[at] = rank, -1, nxt
            if nxt < n:
                before[nxt] = at
            update(dies, none)
            update(at, leaf(at, nxt))
            if (left := before[at]) >= 0:
                update(left, leaf(left, at))
        return np.array([t for t in token if t >= 0], "<i4").tobytes()

    @cached_property
    def pair_table(self) -> dict[int, int]:
        return dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist()))

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > LONG_PIECE:
                out[i] = self.merge_long(piece)
            elif piece:
                by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, at in by_width.items():
            step = max(1, CELLS // width)
            for k in range(0, len(at), step):
                for i, ids in zip(at[k : k + step], self.merge([pieces[j] for j in at[k : k + step]], width)):
                    out[i] = ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Encoder:
    """Texts to ids: cut by the pattern, every match encoded separately."""

    def __init__(self, rank_path: str, pattern: str):
        import public_tokenizers
        import regex

        self.find = regex.compile(pattern).findall
        self.bpe = SegmentTreeBPE(rank_path)
        # The rule for cutting texts into units holds for the public pattern; with another one texts are encoded whole.
        self.cache = UnitCache(self._encode_units, whole=None if pattern == public_tokenizers.PATTERN else lambda text: True)

    def _encode_units(self, units: list[str]) -> list[bytes]:
        cut = [self.find(u) for u in units]
        pieces = list(set().union(*cut)) if cut else []
        known = dict(zip(pieces, self.bpe.encode_pieces([p.encode() for p in pieces])))
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.cache.encode(texts)


@lru_cache(maxsize=2)
def encoder(rank_path: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(rank_path, pattern)


def batches_of(rows: Iterator, n: int) -> Iterator[list]:
    while part := list(islice(rows, n)):
        yield part


def round_trip(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, decode: bool = True) -> DataFrame:
    """The kept columns of docs (all but the text by default) with ids (array<int>) and decoded (binary): the bytes the ids stand for. Without
    the column the ids are decoded all the same and must give the text's bytes: ids that lose some of it are an error."""
    short_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, "ids", "decoded")]
    fields = [docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.BinaryType())] * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(rank_path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS):
                part = batch.slice(start, DOCS)
                texts = part.column(len(keep)).to_pylist()
                found = own.encode(texts)
                decoded = [own.bpe.decode(np.frombuffer(x, "<i4").tolist()) for x in found]
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
                columns = [*part.columns[: len(keep)], ids]
                if decode:
                    columns.append(pa.array(decoded, pa.binary()))
                elif decoded != [t.encode() for t in texts]:
                    raise ValueError("the ids of a text do not decode to it")
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(*keep, whole_text(text).alias(free_name(docs, "whole_text"))).mapInArrow(run, T.StructType(fields))


def public_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame) -> DataFrame:
    """The columns of docs less the text, with ids that were decoded and compared with it: the last stage of the pipeline."""
    return round_trip(without(docs, "ids"), *public_ranks(), decode=False)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_ranks(), keep=["doc_id"])
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
