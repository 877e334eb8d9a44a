"""Sum-of-squares packing of documents into fixed-length token sequences.

Documents become token ids followed by one end id. One longer than a sequence is cut into full pieces with a shorter
first piece. Full pieces are sequences of their own. The others are dealt by hash into shards of bounded size, and each
shard is packed by the sum-of-squares rule: an item goes where the sum of the squared counts of open bins per residual
gap becomes smallest. A new bin is one of the choices, at a price added to its sum (0: the plain rule, which opens bins
early; the default is a sequence's length). The rule needs nothing but those counts, so a shard's state is one array of
`length` numbers and a stack of open bins per gap. Items are taken from long to short, and so few bins stay open that the
loss against one global packing is a bin or two per shard of tens of thousands of pieces.

Nulls: a null text is an empty one (its end id alone). Repeated rows are packed once each. Ties between choices go to the
smallest gap, and to an open bin before a new one; items of one length come by doc_id, copy and piece. Very long texts are
encoded whole, one at a time. An empty table gives no rows. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respira.llm.common import chunks, saved

LENGTH = 2048
END_ID = 0
SHARD_PIECES = 40_000
PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
_ENCODERS: dict[str, Callable[[str], list[int]]] = {}


def encoder(name: str) -> Callable[[str], list[int]]:
    """Ids of a text under a public byte-level BPE vocabulary named `<name>.json`, once per worker.

    The rank file of the same vocabulary is encoded by a faster library; a text with one of the vocabulary's special
    strings goes through the JSON file's own library, which alone knows them.
    """
    if name not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        special = [t.content for t in full.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def ids(text: str) -> list[int]:
            if any(s in text for s in special):
                return full.encode(text, add_special_tokens=False).ids
            return plain.encode_ordinary(text)

        _ENCODERS[name] = ids
    return _ENCODERS[name]


def cuts(total: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `total` tokens: full ones, but for a shorter first one."""
    first = total % length or min(total, length)
    return [(0, first)] + [(s, length) for s in range(first, total, length)] if total else []


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k", length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, copy (a number that tells repeated rows apart), piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        for pdf in chunks(batches):
            rows = []
            for doc, copy, text in zip(pdf["doc_id"], pdf["copy"], pdf["text"], strict=True):
                ids = np.array((encode(text) if isinstance(text, str) else []) + [END_ID], dtype="<u4")
                for piece, (start, n) in enumerate(cuts(len(ids), length)):
                    rows.append((doc, copy, piece, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "copy", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), "text")
    return source.mapInPandas(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int, price: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item, taken in order; a gap costs its squared number of open bins, a new bin `price` (None: capacity) more.

    Putting an item of size s into a bin with gap g changes the sum by 2*(N[g-s] - N[g]) + 2, opening one by 2*N[capacity-s]
    + 1; a gap of 0 is closed and costs nothing.
    """
    price = capacity if price is None else price
    open_bins = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n_bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        there = open_bins[s:capacity]  # gaps s .. capacity-1
        used = np.flatnonzero(there)
        opening = price + (2 * open_bins[capacity - s] + 1 if s < capacity else 0)
        gap = capacity
        if len(used):
            cost = 2 * (open_bins[used] - there[used]) + 2
            if used[0] == 0:
                cost[0] = 1 - 2 * there[0]
            best = cost.argmin()
            gap = s + int(used[best]) if cost[best] <= opening else capacity
        if gap < capacity:
            b = stacks[gap].pop()
            open_bins[gap] -= 1
        else:
            b, n_bins = n_bins, n_bins + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            open_bins[gap - s] += 1
    return bins, offsets


def pack(cut: DataFrame, length: int = LENGTH, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The rows of pieces() with sequence_id and offset. `cut` must be a written table: it is read more than once."""
    short = cut.filter(F.col("length") < length)
    full = cut.filter(F.col("length") >= length)
    shards = max(1, -(-short.count() // shard_pieces))
    dealt = short.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(shards)))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "copy", "piece"], ascending=[False, True, True, True]).reset_index(drop=True)
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), length)
        return pdf.assign(bin=bins, offset=offsets)

    placed = dealt.groupBy("shard").applyInPandas(place, f"{PIECES}, shard long, bin long, offset long")
    columns = ["doc_id", "copy", "piece", "start", "length", "ids_crc32"]
    placed = placed.select(*columns, (F.col("bin") * shards + F.col("shard")).alias("sequence_id"), "offset")
    whole = full.select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole)


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k", length: int = LENGTH, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, copy, piece, start, length, ids_crc32, sequence_id, offset: every row of docs, in as few sequences as it can."""
    return pack(saved(pieces(docs, vocabulary, length)), length, shard_pieces)
