"""N-gram Jaccard join by prefix trees: which documents share enough of their word shingles, directly or over others.

A document is the set of its distinct k-word shingles, as 64-bit hashes. Sets are put in one global order, rare shingles
first, so that two sets with a Jaccard similarity of t share a shingle among the first n - ceil(t*n) + 1 of each (n: its
size). Only documents that share such a shingle are looked at any further.

1. Equal sets are one class, stood for by its smallest doc_id.
2. Order: frequencies are counted for a fixed fraction of the hash space, wide enough to hold the prefixes, and those
   shingles come first (short sets, and the few whose prefix reaches beyond, have all of theirs counted). A shingle is
   then a code that sorts by late or not, power of two of its frequency, hash. One that a single class has is in no one
   else's prefix, so most documents end here. The others keep their counted codes: all that is known of them from here
   on, until a pair is to be settled. Shingles that exactly the same classes have say the same, and one of them stands
   for all.
3. Each class that is left goes to the group of the class it shares most prefix shingles with. A group's ordered codes
   are stored in a trie; a set descends it with the overlap so far, which sets with a common beginning share, and leaves
   subtrees whose remaining lengths, with all that is not counted, can't bring the overlap that is needed. The group falls
   apart into trees of classes that look alike, and only the texts of those are read: a second trie, over whole sets in
   hash order, gives their links. Groups are split by rows and shingles, each part with the class that stands for it.
4. Groups are no limit on links: prefix shingles that classes of different components still share are taken up again. A
   trie per such shingle finds which may be similar: classes outside the most frequent component are queries against
   all, in blocks, and of large groups only those of sizes that allow the similarity meet. What comes out of a block is a
   spanning forest, never all its pairs. Classes that hang together then meet once more in the same way, over whole sets.
5. Components: smallest label over links, with pointer jumping, until nothing changes.

No link between different texts is lost: steps 1-3 find links early, step 4 holds for all that remains.

Nulls: a document without text or words has no shingles and no links. A row without doc_id has no links and no
component. Fewer words than k: the whole sequence is one shingle. Rows that repeat a doc_id share its links. Ties go to
the smaller doc_id. Very long texts are shingled whole, one at a time, and weigh on the size of groups and batches by
their shingles. An empty table gives no rows. Columns other than doc_id and text play no part in the links; keep_one gives
all of its rows' columns back, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respira.llm.common import chunks, lookup, released, saved

WORDS = 5
PERCENT = 80
#: A group is split so that a part has about this many classes, and this many shingles, at most.
GROUP_ROWS = 400
GROUP_SHINGLES = 200_000
BLOCK_ROWS = 1000
SETTLE_ROWS = 400
BLOCK_SHINGLES = 200_000
THINNED_PAIRS = 200_000
#: What one call in a Python worker takes on, in shingles; a class counts as ROW_SHINGLES more.
BATCH_SHINGLES = 500_000
ROW_SHINGLES = 500
#: Batches are no reason for more partitions than that; each then takes several.
MOST_PARTITIONS = 20_000
SHORT = 64
SPAN = 1 << 16
#: The fraction of hashes that is counted, as a multiple of the prefixes' share of a set.
MARGIN = 1.6
#: Percent below the threshold at which counted shingles still make two classes look alike.
SLACK = 3
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; keeps the hashes of words it has met, up to a bound."""

    def __init__(self, k: int, keep: int = 50_000):
        self.k, self.keep, self.words = k, keep, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, dtype=np.int64)
        known, digest = self.words, xxhash.xxh3_64_intdigest
        if len(known) > self.keep:
            known.clear()
        ids = []
        for w in words:
            h = known.get(w)
            if h is None:
                known[w] = h = digest(w)
            ids.append(h)
        h = np.array(ids, dtype=np.uint64)
        k = min(self.k, len(h))
        out = np.full(len(h) - k + 1, k, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = _mixed(out * M1 + h[j : len(h) - k + 1 + j])
        return np.unique(out.view(np.int64))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def counted_span(percent: int) -> int:
    return min(SPAN, int(SPAN * MARGIN * (100 - percent) / 100))


def sketches(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, early (how many are counted), print (of the whole set), tokens: those counted, or all if short, or short of a prefix."""
    cut = counted_span(percent)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shingles = Shingler(k)
        for pdf in chunks(batches):
            sizes, early, prints, tokens = [], [], [], []
            for text in pdf["text"]:
                s = shingles(text)
                first = s[(s & (SPAN - 1)) < cut]
                sizes.append(len(s))
                early.append(len(first))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                tokens.append(first if len(s) > SHORT and len(first) >= prefix_length(len(s), percent) else s)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": np.array(sizes, np.int64), "early": np.array(early, np.int64), "print": prints, "tokens": tokens})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return picked.mapInPandas(rows, "doc_id long, n long, early long, print binary, tokens array<long>")


def _late(token: Column, cut: int) -> Column:
    """0: of the counted fraction, 1: after it."""
    return (token.bitwiseAND(F.lit(SPAN - 1)) >= cut).cast("long")


def shared_codes(classes: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, early, whole, met, shared: the codes of shingles that other classes have too, of all given and of the prefix.

    The order is (late, power of two of the frequency, hash); shingles of frequency 1 come first within either half and
    are only counted. A code ends in 56 bits of the hash: two shingles that agree in all of it only look more alike here.
    """
    cut = counted_span(percent)
    exploded = classes.select("doc_id", F.explode("tokens").alias("token"))
    often = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).filter("freq > 1")
    power = F.floor(F.log2(F.col("freq").cast("double"))).cast("long")
    code = F.shiftleft(_late(F.col("token"), cut), 62).bitwiseOR(F.shiftleft(power, 56)).bitwiseOR(F.col("token").bitwiseAND(F.lit((1 << 56) - 1)))
    often = saved(often.select("token", code.alias("code")))
    found = exploded.join(often.hint("shuffle_merge"), "token").groupBy("doc_id").agg(F.array_sort(F.collect_set("code")).alias("met"))
    facts = classes.groupBy("doc_id").agg(F.min("n").alias("n"), F.max("early").alias("early"), F.max(F.size("tokens")).alias("m"), F.count(F.lit(1)).alias("rows"))
    rows = found.join(facts.hint("shuffle_merge"), "doc_id").withColumn("whole", F.col("m") >= F.col("n"))
    late = F.lit(1 << 62)
    first, then = F.filter("met", lambda x: x < late), F.filter("met", lambda x: x >= late)
    p = (F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0)) + 1).cast("int")
    early = F.col("early").cast("int")
    inside = lambda part, places: F.slice(part, 1, F.greatest(places, F.lit(0)))
    prefix = F.concat(inside(first, p - (early - F.size(first))), inside(then, p - early - (F.col("m") - early - F.size(then))))
    out = saved(rows.select("doc_id", "n", "early", "whole", "met", F.when(F.col("rows") > 1, F.col("met")).otherwise(prefix).alias("shared")).filter(F.size("shared") > 0))
    released(often)
    return out


class Trie:
    """Ordered sets of ranks, stored by their common beginnings.

    Of a set only the codes counted are given, unless it is whole: n is its size, late how many of it are not counted.
    """

    def __init__(self, sets: list[np.ndarray], n: np.ndarray, late: np.ndarray, whole: np.ndarray, percent: int, first: int = 0):
        self.sets, self.n, self.late, self.whole, self.t, self.first = sets, n, late, whole, percent, first
        self.order = np.array(sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes()), dtype=np.int64)
        self.root, children = self._node(0, len(sets), 0)
        todo = [(self.root, children)]
        while todo:
            node, spans = todo.pop()
            for lo, hi in spans:
                child, below = self._node(lo, hi, node[3])
                node[-1].append(child)
                if below:
                    todo.append((child, below))

    def _node(self, lo: int, hi: int, depth: int) -> tuple[tuple, list[tuple[int, int]]]:
        """((lo, hi, segment, depth after it, longest, smallest n, most late, all whole, sets ending here, how much of the segment comes before first, the set if it is one alone, children), spans of children)."""
        at_ = lambda i: self.sets[self.order[i]]
        a, b = at_(lo), at_(hi - 1)
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:m] != b[depth:m])
        end = depth + int(differ[0]) if len(differ) else m
        at = lo
        while at < hi and len(at_(at)) == end:
            at += 1
        ends, spans = at - lo, []
        while at < hi:
            token, low, high = at_(at)[end], at + 1, hi
            while low < high:  # sets that go on with the same token are neighbours
                mid = (low + high) // 2
                low, high = (mid + 1, high) if at_(mid)[end] == token else (low, mid)
            spans.append((at, low))
            at = low
        rows = self.order[lo:hi]
        longest = max(len(self.sets[i]) for i in rows)
        before, alone = int(a[depth:end].searchsorted(self.first)) if self.first else 0, int(rows[0]) if hi - lo == 1 else -1
        return (lo, hi, a[depth:end], end, longest, int(self.n[rows].min()), int(self.late[rows].max()), bool(self.whole[rows].all()), ends, before, alone, []), spans

    def similar(self, held: np.ndarray, length: int, n: int, late: int, whole: bool, own: int, label: np.ndarray) -> Iterator[tuple[int, int]]:
        """(set, overlap of what is given) of those that may be similar to one of `length` given codes, which are marked in `held`.

        Where both sets are whole they are similar indeed; else what is not counted of the smaller may be common too. Sets
        whose label is `own` are left out, with the subtrees of such, and those with a common code before the trie's `first`.
        """
        todo = [(self.root, 0)]
        while todo:
            (lo, hi, segment, depth, longest, smallest, most_late, all_whole, ends, before, alone, children), overlap = todo.pop()
            if label[alone] == own if alone >= 0 else (label[self.order[lo:hi]] == own).all():
                continue
            common = held[segment]
            if before and common[:before].any():
                continue
            overlap += int(np.count_nonzero(common))
            unseen = 0 if whole and all_whole else min(late, most_late)
            if (overlap + min(longest - depth, length - overlap) + unseen) * (100 + self.t) < self.t * (n + smallest):
                continue
            for i in self.order[lo : lo + ends].tolist():
                unseen = 0 if whole and self.whole[i] else min(late, int(self.late[i]))
                if label[i] != own and (overlap + unseen) * (100 + self.t) >= self.t * (n + int(self.n[i])):
                    yield i, overlap
            todo += [(c, overlap) for c in children]


def ranked(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Sets of ranks instead of codes, in the same order, and the number of ranks."""
    vocabulary, which = np.unique(np.concatenate(sets), return_inverse=True)
    return np.split(which, np.cumsum([len(s) for s in sets])[:-1]), len(vocabulary)


def alike(overlap: int, a: int, b: int, percent: int) -> bool:
    return overlap * (100 + percent) >= percent * (a + b)


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of similar whole sets that join all sets reachable over such pairs: a spanning forest of the links."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    return forest(sets, n, n, np.ones(len(sets), dtype=bool), percent, 0)


def forest(sets: list[np.ndarray], n: np.ndarray, early: np.ndarray, whole: np.ndarray, percent: int, slack: int = SLACK) -> list[tuple[int, int]]:
    """Pairs that join the sets reachable over pairs which look alike by what is given of them (whole sets: are similar)."""
    everyone = np.arange(len(sets))
    near = lambda a, b, overlap: whole[a] and whole[b] or alike(overlap, int(early[a]), int(early[b]), percent - slack)
    return met(sets, n, n - early, whole, everyone, everyone, everyone, percent, near)


def met(
    sets: list[np.ndarray], n: np.ndarray, late: np.ndarray, whole: np.ndarray, label: np.ndarray, queries: np.ndarray, base: np.ndarray, percent: int,
    accept: Callable[[int, int, int], bool] | None = None, first: int | None = None,
) -> list[tuple[int, int]]:
    """(query, other) of a spanning forest: those of `base` that may be similar to a query (are, if whole), where labels differ and no pair before joined them."""
    start = 0 if first is None else int(np.unique(np.concatenate(sets)).searchsorted(first))
    ids, size = ranked(sets)
    label, out, held = label.copy(), [], np.zeros(size, dtype=bool)
    trie = Trie([ids[i] for i in base], n[base], late[base], whole[base], percent, start)
    there = label[base]
    for own in queries.tolist():
        held[ids[own]] = True
        for x, overlap in trie.similar(held, len(ids[own]), int(n[own]), int(late[own]), bool(whole[own]), label[own], there):
            other = int(base[x])
            if label[other] != label[own] and (accept is None or accept(own, other, overlap)):
                out.append((own, other))
                there[there == label[other]] = label[own]
                label[label == label[other]] = label[own]
        held[ids[own]] = False
    return out


def by_group(rows: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], list[tuple]], schema: str, with_columns: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """What `work` makes of each group of two rows and more; rows (a written table with n) get further columns by with_columns.

    Groups are bounded by their makers. Many small ones share a batch, of about BATCH_SHINGLES.
    """
    cost = rows.agg(F.sum(F.col("n") + ROW_SHINGLES)).first()[0] or 0
    buckets = 1 + cost // BATCH_SHINGLES
    dealt = with_columns(rows.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))).repartition(min(buckets, MOST_PARTITIONS), "__bucket")
    names = [c.split()[0] for c in schema.split(", ")]

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [found for at in pdf.groupby(keys, sort=False).indices.values() if len(at) > 1 for found in work(pdf.iloc[at])]
        return pd.DataFrame(out, columns=names, dtype="int64")

    return dealt.groupBy("__bucket").applyInPandas(each, schema)


def trie_links(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links inside groups. members (a written table): doc_id, n and the columns that name a group.

    With query, base and label, the rows marked query meet those marked base, but for those of the same label.
    """
    shingles = Shingler(k)

    def join(pdf: pd.DataFrame) -> list[tuple]:
        ids, sets = pdf["doc_id"].to_numpy(), [shingles(t) for t in pdf["text"]]
        if "query" not in pdf:
            return [(ids[i], ids[j]) for i, j in linked(sets, percent)]
        n = np.array([len(s) for s in sets], dtype=np.int64)
        queries, base = (np.flatnonzero(pdf[c].to_numpy()) for c in ("query", "base"))
        return [(ids[i], ids[j]) for i, j in met(sets, n, n - n, n == n, pdf["label"].to_numpy(), queries, base, percent)] if len(base) else []

    def texts(rows: DataFrame) -> DataFrame:
        named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        wanted = saved(members.select("doc_id").distinct())
        return rows.join(lookup(named, wanted, "doc_id", "left_semi").hint("shuffle_merge"), "doc_id")

    return by_group(members, [c for c in members.columns if c not in ("doc_id", "n", "label", "query", "base")], join, "a long, b long", texts)


def components(links: DataFrame) -> DataFrame:
    """(doc_id, label): the smallest id reachable, for every id in links (a, b), a written table.

    In each round an id takes the least label among its own, its neighbours' and that of the id its label names.
    """
    ends = links.select("a", "b").union(links.select("b", "a"))
    edges = saved(ends.union(ends.select("a", F.col("a").alias("b"))).distinct())
    labels = saved(edges.groupBy("a").agg(F.min("b").alias("label")))
    while True:
        seen = edges.union(labels.select("a", F.col("label").alias("b")))
        new = seen.join(labels.select(F.col("a").alias("b"), "label").hint("shuffle_merge"), "b").groupBy("a").agg(F.min("label").alias("label"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("was"))
        new = saved(new)
        released(labels)
        labels = new
        if new.filter(F.col("label") < F.col("was")).isEmpty():
            released(edges)
            return new.select(F.col("a").alias("doc_id"), "label")


def _parts(members: DataFrame, key: str) -> DataFrame:
    """key, parts as a written table: the groups of members (key, doc_id, n) that are to be split, by rows and shingles."""
    want = F.greatest(F.count(F.lit(1)) / F.lit(float(GROUP_ROWS)), F.sum("n") / F.lit(float(GROUP_SHINGLES)))
    return saved(members.groupBy(key).agg(F.ceil(want).cast("int").alias("parts")).filter("parts > 1"))


def _part(doc: str) -> Column:
    return F.pmod(F.xxhash64(doc), F.coalesce("parts", F.lit(1))).cast("int")


def postings(shared: DataFrame) -> DataFrame:
    """token, doc_id, head, weight as a written table: the prefix codes that several classes have, one for all that the same classes have."""
    rows = saved(shared.select(F.explode("shared").alias("token"), "doc_id"))
    mark = lambda *salt: F.bit_xor(F.xxhash64("doc_id", *salt))
    facts = rows.groupBy("token").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("many"), mark().alias("x"), mark(F.lit(1)).alias("y")).filter("many > 1")
    lists = saved(facts.groupBy("head", "many", "x", "y").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("weight")).select("token", "head", "weight"))
    out = saved(lookup(rows, lists, "token"))
    released(rows, lists)
    return out


def _group_members(posted: DataFrame, sizes: DataFrame) -> DataFrame:
    """head, part, doc_id, n as a written table: each class with the class that it shares most prefix shingles with, which is in every part."""
    votes = posted.filter("head <> doc_id").groupBy("doc_id", "head").agg(F.sum("weight").alias("votes"))
    best = votes.groupBy("doc_id").agg(F.max_by(-F.col("head"), F.struct("votes", -F.col("head"))).alias("minus")).select((-F.col("minus")).alias("head"), "doc_id")
    named = saved(best.join(sizes.hint("shuffle_merge"), "doc_id").select("head", "doc_id", "n"))
    many = _parts(named, "head")
    members = lookup(named, many, "head", "left").select("head", _part("doc_id").alias("part"), "doc_id", "n")
    heads = members.select("head", "part", F.col("head").alias("doc_id")).distinct().join(sizes.hint("shuffle_merge"), "doc_id")
    out = saved(members.unionByName(heads.select("head", "part", "doc_id", "n")))
    released(named, many)
    return out


def _columns(pdf: pd.DataFrame) -> tuple:
    return tuple(pdf[c].to_numpy() for c in ("doc_id", "n", "early", "whole")) + ([np.asarray(x, dtype=np.int64) for x in pdf["met"]],)


def trees(members: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """head, part, root, doc_id, n: the classes of a group that look alike, with the one that stands for them."""

    def grow(pdf: pd.DataFrame) -> list[tuple]:
        ids, n, early, whole, sets = _columns(pdf)
        root = np.arange(len(ids))
        for a, b in forest(sets, n, early, whole, percent):
            root[root == root[b]] = root[a]
        head, part = pdf["head"].iloc[0], pdf["part"].iloc[0]
        size = np.bincount(root, minlength=len(ids))
        return [(head, part, ids[r], ids[i], n[i]) for i, r in enumerate(root.tolist()) if size[r] > 1]

    known = shared.select("doc_id", "early", "whole", "met").hint("shuffle_merge")
    return by_group(members, ["head", "part"], grow, "head long, part long, root long, doc_id long, n long", lambda df: df.join(known, "doc_id"))


def _labelled(posted: DataFrame, labels: DataFrame) -> DataFrame:
    """token, doc_id, label: the postings that classes of different components share, as a written table."""
    rows = saved(posted.select("token", "doc_id").join(labels.hint("shuffle_merge"), "doc_id", "left").select("token", "doc_id", F.coalesce("label", "doc_id").alias("label")))
    spread = saved(rows.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("token"))
    out = saved(lookup(rows, spread, "token", "left_semi"))
    released(rows, spread)
    return out


def _blocks(rows: DataFrame, sizes: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """token, band, i, j, query, base, doc_id, label, n as a written table: where the classes under a token (rows: token, doc_id, label) meet.

    Queries are the classes outside the token's most frequent component. Up to block_rows classes, of BLOCK_SHINGLES, meet
    in one block. More are told apart by size: a query goes to its own band of sizes and both neighbours, as others can't be
    similar; in each band blocks of queries meet blocks of all.
    """
    rows = saved(rows.join(sizes.hint("shuffle_merge"), "doc_id").select("token", "doc_id", "label", "n"))
    counts = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    facts = saved(counts.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s")))
    wanted = lambda c, s: F.ceil(F.greatest(c / F.lit(float(block_rows)), s / F.lit(float(BLOCK_SHINGLES)))).cast("int")
    facts = facts.select("token", "main", (wanted(F.col("c"), F.col("s")) > 1).alias("large"))
    marked = lookup(rows, facts, "token").withColumn("query", F.col("label") != F.col("main"))
    columns = ["token", "band", "i", "j", "query", "base", "doc_id", "label", "n"]
    zero, yes, no = F.lit(0), F.lit(True), F.lit(False)
    few = marked.filter("not large").withColumns({"band": F.lit(-9), "i": zero, "j": zero, "base": yes}).select(columns)
    large = saved(marked.filter("large").select("token", "query", "doc_id", "label", "n", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) * 1.000001)).cast("int").alias("band")))
    queries = large.filter("query").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    blocks = lambda df, name: df.groupBy("token", "band").agg(wanted(F.count(F.lit(1)), F.sum("n")).alias(name))
    sides = saved(blocks(queries, "q").join(blocks(large, "x").hint("shuffle_merge"), ["token", "band"]))
    mine = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    asked = lookup(queries, sides, ["token", "band"]).withColumns({"i": mine(F.col("q")), "base": no}).withColumn("j", each("x")).select(columns)
    there = lookup(large.withColumn("query", no), sides, ["token", "band"]).withColumns({"j": mine(F.col("x")), "base": yes}).withColumn("i", each("q")).select(columns)
    out = saved(few.unionByName(asked).unionByName(there))
    released(rows, large, sides)
    return out


def _open_pairs(rows: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(a, b) as a written table: components that hang together, as they have classes that may be similar by all that is counted.

    Two classes meet under the first of the codes that both have. Of each block a spanning forest is given, not all pairs.
    """

    def meet(pdf: pd.DataFrame) -> list[tuple]:
        queries, base = (np.flatnonzero(pdf[c].to_numpy()) for c in ("query", "base"))
        if not len(queries) or not len(base):
            return []
        _, n, early, whole, sets = _columns(pdf)
        label = pdf["label"].to_numpy()
        return [(label[q], label[x]) for q, x in met(sets, n, n - early, whole, label, queries, base, percent, first=pdf["token"].iloc[0])]

    known = shared.select("doc_id", "early", "whole", "met").hint("shuffle_merge")
    dealt = _blocks(rows, shared.select("doc_id", "n"), percent, BLOCK_ROWS)
    found = by_group(dealt, ["token", "band", "i", "j"], meet, "a long, b long", lambda df: df.join(known, "doc_id"))
    every = saved(found.distinct())
    out = saved(every.repartition(1 + every.count() // THINNED_PAIRS).mapInPandas(thinned, "a long, b long"))
    released(dealt, every)
    return out


def thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of a partition that join what none before it joined: forests of many blocks over the same classes become one."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for pdf in batches:
        keep = np.zeros(len(pdf), dtype=bool)
        for i, (a, b) in enumerate(zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True)):
            a, b = top(a), top(b)
            if a != b:
                parent[a], keep[i] = b, True
        yield pdf[keep]


def _settled(pairs: DataFrame, rows: DataFrame, docs: DataFrame, sizes: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) as a written table: links between components that hang together (pairs), among the classes of rows (token, doc_id, label).

    Their classes meet once more, over whole sets, in blocks of queries and all.
    """
    clusters = components(pairs).select(F.col("doc_id").alias("label"), F.col("label").alias("token"))
    placed = rows.select("doc_id", "label").distinct().join(clusters.hint("shuffle_merge"), "label")
    dealt = _blocks(placed, sizes, percent, SETTLE_ROWS)
    out = saved(trie_links(dealt, docs, k, percent))
    released(dealt)
    return out


def similar_groups(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    sketch = saved(sketches(docs, k, percent))
    rows = saved(sketch.select("doc_id", "n", "print"))
    alive = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    prints = saved(rows.filter(alive).groupBy("print").agg(F.min("doc_id").alias("doc_id")))
    copies = saved(rows.filter(alive).select("doc_id").distinct().join(prints.select("doc_id").distinct().hint("shuffle_merge"), "doc_id", "left_anti"))
    classes = lookup(sketch.filter(alive), copies, "doc_id", "left_anti").select("doc_id", "n", "early", "tokens")
    shared = shared_codes(classes, percent)
    released(sketch, copies)

    sizes = shared.select("doc_id", "n")
    posted = postings(shared)
    members = _group_members(posted, sizes)
    grown = saved(trees(members, shared, percent))
    links = saved(trie_links(grown, docs, k, percent))
    released(members, grown)
    labels = components(links)

    rest = _labelled(posted, labels)
    released(posted)
    if not rest.isEmpty():
        pairs = _open_pairs(rest, shared, percent)
        links = links.unionByName(_settled(pairs, rest, docs, sizes, k, percent))
        labels = components(links)
        released(pairs)
    released(shared, rest)
    labels = labels.withColumnRenamed("doc_id", "first")
    member = saved(prints.withColumnRenamed("doc_id", "first").join(labels.hint("shuffle_merge"), "first", "left").select("print", F.coalesce("label", "first").alias("component")))
    found = lookup(rows, member, "print", "left")
    component = F.when(alive, F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows of docs, but of each component only those of its smallest doc_id."""
    found = similar_groups(docs.select("doc_id", "text"), k, percent)
    own = f"id_{uuid.uuid4().hex}"
    gone = saved(found.filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(own)).distinct())
    return lookup(docs.withColumn(own, F.col("doc_id").cast("long")), gone, own, "left_anti").drop(own)
