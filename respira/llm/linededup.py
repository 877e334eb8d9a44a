"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case. `LineIndex` keeps, in the
shared folder, one exact row per (key, document) and per shard of keys one row per key (number of documents, largest
document) beside a cuckoo filter of the shard's keys. An insertion asks the filters first: a key they don't know is new,
and only those they may know are looked up among the exact rows. A deletion lowers the counts by the exact rows and takes
keys nobody holds out of the filter, so that inserting and deleting a document leaves the index as it was. Shards are
dealt anew when insertions have made them twice as large as wanted.

To drop lines, cuckoo filters of the keys that enough documents hold are asked for every (key, document); what they pass
is settled by the exact counts, and texts stay where they are as long as what they lose is few enough to be broadcast.

Shards hold keys, already counted per key before they are gathered, so that a line in a third of all documents is one
row like any other.

Nulls: a null or empty text is one empty line, whose key is too short to count. Rows without doc_id hold no keys and
lose no lines. Rows that repeat a doc_id are one document that holds the lines of all of them. Lines tie on nothing: the
largest doc_id is unique. Very long texts are split whole; one such row is a batch of its own. An empty table gives no
rows. Columns beside doc_id and text pass through `apply` unchanged, but for n_lines and n_dropped, which it sets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from respira.llm.common import LOOKUP_ROWS, chunks, lookup, saved

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 100_000
#: Filters of common keys are given to every task up to this many keys (2.4 bytes each); beyond it all go to the exact counts.
FILTER_KEYS = 20_000_000
SPACE = " \t\n\x0b\x0c\r"
STATE = "shard int, key binary, n_docs long, keep long, cuckoo binary"


class CuckooFilter:
    """Four 16-bit fingerprints per bucket, two buckets per key, each known from the other and the fingerprint.

    Keys are 16-byte digests. When no place is left the table is doubled from the caller's keys by `grown`; there are no
    false negatives, and a key must only be deleted if it was inserted.
    """

    SLOTS, KICKS = 4, 400

    def __init__(self, n_keys: int = 0, table: bytes | None = None):
        if table is not None:
            self.slots = np.frombuffer(table, dtype="<u2").tolist()
        else:
            buckets = 1
            while buckets * self.SLOTS * 0.85 < n_keys + 1:
                buckets *= 2
            self.slots = [0] * (buckets * self.SLOTS)
        self.mask = len(self.slots) // self.SLOTS - 1

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        s = self.slots
        return mark in s[4 * a : 4 * a + 4] or mark in s[4 * b : 4 * b + 4]

    def knows(self, keys: list[bytes]) -> np.ndarray:
        """Of each key, whether it may have been inserted."""
        parts = np.frombuffer(b"".join(keys), dtype="<u2").reshape(len(keys), 8).astype(np.int64)
        mark = np.maximum(parts[:, 0], 1)
        a = (parts[:, 1] | parts[:, 2] << 16 | parts[:, 3] << 32) & self.mask
        b = (a ^ (mark * 0x5BD1E995)) & self.mask
        table = np.array(self.slots, dtype=np.int64).reshape(-1, self.SLOTS)
        return ((table[a] == mark[:, None]) | (table[b] == mark[:, None])).any(axis=1)

    def _put(self, bucket: int, mark: int) -> bool:
        s = self.slots
        for i in range(4 * bucket, 4 * bucket + 4):
            if not s[i]:
                s[i] = mark
                return True
        return False

    def insert(self, key: bytes) -> bool:
        """False: there was no place, and the filter must be built anew (nothing of it is lost by then)."""
        mark, a, b = self._places(key)
        if self._put(a, mark) or self._put(b, mark):
            return True
        bucket, moved = b, []
        for kick in range(self.KICKS):
            i = 4 * bucket + kick % 4
            moved.append((i, self.slots[i]))
            self.slots[i], mark = mark, self.slots[i]
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark):
                return True
        for i, old in reversed(moved):
            self.slots[i] = old
        return False

    def delete(self, key: bytes) -> None:
        mark, a, b = self._places(key)
        for bucket in (a, b):
            for i in range(4 * bucket, 4 * bucket + 4):
                if self.slots[i] == mark:
                    self.slots[i] = 0
                    return

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        size = len(keys)
        while True:
            found = cls(size)
            if all(found.insert(k) for k in keys):
                return found
            size = max(2 * size, 8)

    def tobytes(self) -> bytes:
        return np.array(self.slots, dtype="<u2").tobytes()


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The key digest of every line; None for a line too short to count."""
    import xxhash

    out: list[bytes | None] = []
    for line in (text or "").split("\n"):
        bare = line.strip(SPACE)
        out.append(xxhash.xxh3_128_digest(bare.encode("utf-8", "surrogatepass").lower()) if len(bare) >= min_chars else None)
    return out


def line_refs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc_id), once each, for every line that counts."""

    def refs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches):
            keys: list[bytes] = []
            ids: list[int] = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                own = {k for k in line_keys(text, min_chars) if k}
                keys += own
                ids += [doc] * len(own)
            yield pd.DataFrame({"key": keys, "doc_id": np.array(ids, dtype=np.int64)})

    held = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return held.mapInPandas(refs, "key binary, doc_id long").dropDuplicates(["key", "doc_id"])


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _counted(refs: DataFrame, shards: int) -> DataFrame:
    counts = refs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keep"))
    return counts.select(_shard(shards).alias("shard"), "key", "n_docs", "keep")


def _shard_rows(shard: int, rows: dict[bytes, tuple[int, int]], cuckoo: CuckooFilter) -> pd.DataFrame:
    keys = list(rows)
    out = pd.DataFrame({"shard": shard, "key": [*keys, None], "n_docs": [*(rows[k][0] for k in keys), len(keys)], "keep": [*(rows[k][1] for k in keys), 0]})
    return out.assign(cuckoo=[None] * len(keys) + [cuckoo.tobytes()])


class LineIndex:
    """refs: (key, doc_id). state: STATE, a row per key, and per shard one with the filter and no key."""

    def __init__(self, refs: DataFrame, state: DataFrame, shards: int, min_chars: int, shard_keys: int = SHARD_KEYS):
        self.refs, self.state, self.shards, self.min_chars, self.shard_keys = refs, state, shards, min_chars, shard_keys

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> LineIndex:
        refs = saved(line_refs(docs, min_chars))
        shards = max(1, -(-refs.count() // shard_keys))
        empty = docs.sparkSession.createDataFrame([], STATE)
        return cls(refs, cls._merged(empty, _counted(refs, shards), False), shards, min_chars, shard_keys)

    @staticmethod
    def _merged(state: DataFrame, changes: DataFrame, final: bool) -> DataFrame:
        """state with changes per key: counts to add, or (final) counts that replace, where 0 takes the key out."""

        def merge(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            known = old["key"].notna()
            rows = dict(zip(map(bytes, old["key"][known]), zip(old["n_docs"][known], old["keep"][known], strict=True), strict=True))
            kept = old["cuckoo"][~known]
            cuckoo = CuckooFilter(table=bytes(kept.iloc[0])) if len(kept) else CuckooFilter(len(new))
            whole = True
            for k, n, keep in zip(map(bytes, new["key"]), new["n_docs"], new["keep"], strict=True):
                if k in cuckoo and k in rows:
                    if final and not n:
                        del rows[k]
                        cuckoo.delete(k)
                    else:
                        rows[k] = (n, keep) if final else (rows[k][0] + n, max(rows[k][1], keep))
                elif n:
                    rows[k] = (n, keep)
                    whole = whole and cuckoo.insert(k)
            if not whole:
                cuckoo = CuckooFilter.of(list(rows))
            return _shard_rows(key[0], rows, cuckoo)

        return saved(state.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(merge, STATE))

    def asked(self, refs: DataFrame) -> DataFrame:
        """refs with seen: whether the filter of a key's shard may know the key."""

        def ask(key: tuple, filters: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            seen = CuckooFilter(table=bytes(filters["cuckoo"].iloc[0])).knows(list(map(bytes, asked["key"]))) if len(filters) and len(asked) else np.zeros(len(asked), dtype=bool)
            return asked[["key", "doc_id"]].assign(seen=seen)

        filters = self.state.filter(F.col("key").isNull()).select("shard", "cuckoo")
        salted = refs.withColumn("shard", _shard(self.shards))
        return filters.groupBy("shard").cogroup(salted.groupBy("shard")).applyInPandas(ask, "key binary, doc_id long, seen boolean")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with more documents; ids it already has only add lines they did not hold."""
        asked = saved(self.asked(line_refs(docs, self.min_chars)))
        known = asked.filter("seen").select("key", "doc_id").join(self.refs, ["key", "doc_id"], "left_anti")
        new = saved(asked.filter("not seen").select("key", "doc_id").unionByName(known))
        refs = saved(self.refs.unionByName(new))
        grown = LineIndex(refs, self._merged(self.state, _counted(new, self.shards), False), self.shards, self.min_chars, self.shard_keys)
        keys = grown.counts().count()
        if keys > 2 * self.shards * self.shard_keys:
            shards = -(-keys // self.shard_keys)
            dealt = grown.counts().select(_shard(shards).alias("shard"), "key", "n_docs", "keep")
            grown = LineIndex(refs, self._merged(grown.state.limit(0), dealt, False), shards, self.min_chars, self.shard_keys)
        return grown

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index as if it had never seen these doc_ids (their texts are not needed)."""
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        gone = self.refs.join(ids, "doc_id", "left_semi").select("key").distinct()
        refs = saved(self.refs.join(ids, "doc_id", "left_anti").select("key", "doc_id"))
        left = refs.join(gone, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep"))
        changes = gone.join(left, "key", "left").select(
            _shard(self.shards).alias("shard"), "key", F.coalesce("n", F.lit(0)).alias("n_docs"), F.coalesce("keep", F.lit(0)).alias("keep")
        )
        return LineIndex(refs, self._merged(self.state, changes, True), self.shards, self.min_chars, self.shard_keys)

    def counts(self) -> DataFrame:
        return self.state.filter(F.col("key").isNotNull()).select("key", "n_docs", "keep")

    def common(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """shard, key, keep of the keys that at least min_docs documents hold, as a written table."""
        return saved(self.state.filter(F.col("key").isNotNull() & (F.col("n_docs") >= min_docs)).select("shard", "key", "keep"))

    def hits(self, common: DataFrame) -> DataFrame:
        """(key, doc_id) of the keys that cuckoo filters of `common`, one per shard, pass: all that are common, and hardly any else."""
        if common.limit(FILTER_KEYS + 1).count() > FILTER_KEYS:
            return self.refs
        build = lambda pdf: pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "cuckoo": [CuckooFilter.of(list(map(bytes, pdf["key"]))).tobytes()]})
        filters = {r["shard"]: bytes(r["cuckoo"]) for r in common.groupBy("shard").applyInPandas(build, "shard int, cuckoo binary").collect()}

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tables = {shard: CuckooFilter(table=t) for shard, t in filters.items()}
            for pdf in batches:
                keys, passed = list(map(bytes, pdf["key"])), np.zeros(len(pdf), dtype=bool)
                for shard, at in pdf.groupby("shard").indices.items():
                    if shard in tables:
                        passed[at] = tables[shard].knows([keys[i] for i in at])
                yield pdf.loc[passed, ["key", "doc_id"]]

        return self.refs.withColumn("shard", _shard(self.shards)).mapInPandas(ask, "key binary, doc_id long")

    def losses(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(doc_id, keys) as a written table: the keys whose lines a document loses."""
        common = self.common(min_docs)
        lost = lookup(self.hits(common), common.select("key", "keep"), "key").filter(F.col("doc_id") != F.col("keep"))
        return saved(lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys")))

    def apply(self, docs: DataFrame, min_docs: int = MIN_DOCS, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
        """docs with the lines they lose taken out of text, and under `names` the number of lines before, and dropped."""
        min_chars, own, lost = self.min_chars, f"id_{uuid.uuid4().hex}", f"keys_{uuid.uuid4().hex}"
        plain = docs.drop(*names)
        losses = self.losses(min_docs).withColumnsRenamed({"doc_id": own, "keys": lost})
        few = (losses.agg(F.sum(F.size(lost))).first()[0] or 0) <= LOOKUP_ROWS
        marked = plain.withColumn(own, F.col("doc_id").cast("long")).join(F.broadcast(losses) if few else losses.hint("shuffle_merge"), own, "left").drop(own)

        def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in chunks(batches):
                texts, before, dropped = [], [], []
                for text, keys in zip(pdf["text"], pdf.pop(lost), strict=True):
                    lines = (text or "").split("\n")
                    before.append(len(lines))
                    if keys is None or not len(keys):
                        texts.append(text)
                        dropped.append(0)
                        continue
                    gone = set(map(bytes, keys))
                    stay = [line for line, k in zip(lines, line_keys(text, min_chars), strict=True) if k not in gone]
                    texts.append("\n".join(stay))
                    dropped.append(len(lines) - len(stay))
                yield pdf.assign(text=texts, **{names[0]: np.array(before, np.int64), names[1]: np.array(dropped, np.int64)})

        counts = [StructField(n, LongType()) for n in names]
        return marked.mapInPandas(drop, StructType([*plain.schema.fields, *counts]))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Every row of docs without the lines that at least min_docs documents hold, except in the largest doc_id; n_lines, n_dropped."""
    return LineIndex.build(docs, min_chars).apply(docs, min_docs)


def without_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """As dedup_lines, with the columns of docs as they are, whatever their names."""
    names = tuple(f"{n}_{uuid.uuid4().hex}" for n in ("n_lines", "n_dropped"))
    return LineIndex.build(docs, min_chars).apply(docs, min_docs, names).drop(*names)
