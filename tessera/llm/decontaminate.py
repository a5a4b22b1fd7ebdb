"""Benchmark decontamination with suffix arrays of the training text.

A shard is one Arrow batch of documents. Its words become ids of the benchmark's vocabulary; runs of words that can't
hold a window (an unknown word, or two that never follow one another in an item) are left out. The shard's suffix array
orders the suffixes of the remaining runs as deep as the longest item reaches (by doubling), so no test suffix can tell
apart what it leaves equal. Every suffix of every test item is binary-searched in it: the interval of suffixes that
start with its first window gives the hits, its place gives each hit's longest verbatim match, with one of the two test
suffixes beside it. Intervals are counted, pairs of occurrences are never listed, so repetitive text costs no more.

The benchmark goes to the executors whole if it is under `MAX_INDEX_BYTES`. A larger one is dealt into slices below that
bound; the driver holds one slice at a time, each is searched in a job of its own, and the hits are merged by row.

Defined cases: a null or empty text has no words; an item without words is ignored; an item of fewer
than `window` words is one window of its own length; rows of equal item_id count as one item; a null
item_id marks hits but is not counted as an item; repeated documents are judged one by one; extra
columns of either table are not read, whatever their names; empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, text_of, text_udf

WINDOW = 8
#: The text of one benchmark slice held by a Python worker, at most.
MAX_INDEX_BYTES = 16 << 20

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
HITS = "struct<n_words:bigint,hits:array<int>,items:array<bigint>,longest:int,longest_at:int>"
HITS_ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.int64())), ("longest", pa.int32()), ("longest_at", pa.int32())])


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


def _ranks(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of pairs of numbers below 2**31, and the distinct pairs as sorted keys."""
    keys, rank = np.unique(first * (1 << 31) + second, return_inverse=True)
    return rank.astype(np.int64), keys


def _doubled(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per level k the rank of each position's first min(2**k, left) words, until 2**k >= depth; and each level's keys."""
    values, rank = np.unique(ids, return_inverse=True)
    ranks, keys, k = [rank.astype(np.int64)], [values], 0
    while (1 << k) < depth:
        step, r = 1 << k, ranks[-1]
        second = np.zeros(len(r), dtype=np.int64)
        more = np.flatnonzero(left > step)
        second[more] = r[more + step] + 1
        rank, key = _ranks(r, second)
        ranks.append(rank)
        keys.append(key)
        k += 1
    return ranks, keys


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in sorted keys, -1 for what isn't there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


class TestIndex:
    """The suffixes of a set of benchmark items, as ids of their vocabulary; each item ends in a 0."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        text: list[int] = []
        owner: list[int] = []
        left: list[int] = []
        self.item_ids = [i for i, _ in items]
        lengths: dict[int, int] = {}
        for k, (_, item) in enumerate(items):
            own = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(item)]
            if own:
                lengths[k] = min(window, len(own))
                text += [*own, 0]
                owner += [k] * (len(own) + 1)
                left += range(len(own), -1, -1)
        self.text, self.owner, self.left = (np.array(x, dtype=np.int64) for x in (text, owner, left))
        self.window = np.array([lengths.get(k, 0) for k in range(len(items))], dtype=np.int64)[self.owner] if text else np.zeros(0, np.int64)
        starts = np.flatnonzero((self.left >= self.window) & (self.left > 0))
        self.depth = int(self.left.max(initial=0))
        self.shortest = int(self.window[starts].min(initial=window))
        self.starts = {int(n): starts[self.window[starts] == n] for n in np.unique(self.window[starts])}
        here = np.flatnonzero(self.left > 1)
        self.follows = np.unique(self.text[here] * (len(self.vocab) + 1) + self.text[here + 1])
        self.singles = np.unique(self.text[self.starts.get(1, np.zeros(0, np.int64))])
        ranks, _ = _doubled(self.text, self.left, max(1, self.depth)) if text else ([self.text], [])
        self.order = ranks[-1]  # of the test suffixes among themselves
        # Windows of one text are a class; classes with the same items share a list of them.
        self.class_of = np.full(len(text), -1, dtype=np.int64)
        self.items_of: list[int] = []
        self.lists: list[list[int]] = []
        known: dict[tuple[int, ...], int] = {}
        for n, at in self.starts.items():
            a = n.bit_length() - 1
            _, cls = np.unique(ranks[a][at] * (1 << 31) + ranks[a][at + n - (1 << a)], return_inverse=True)
            self.class_of[at] = cls + len(self.items_of)
            held: list[set[int]] = [set() for _ in range(int(cls.max()) + 1)]
            for c, k in zip(cls.tolist(), self.owner[at].tolist()):
                held[c].add(k)
            for h in held:
                key = tuple(sorted({self.item_ids[k] for k in h} - {None}))
                if key not in known:
                    known[key] = len(self.lists)
                    self.lists.append(list(key))
                self.items_of.append(known[key])

    def _runs(self, ids: np.ndarray) -> np.ndarray:
        """Positions of words in runs that may hold a window."""
        if not len(self.text):
            return np.zeros(0, dtype=np.int64)
        pair = ids[:-1] * (len(self.vocab) + 1) + ids[1:]
        linked = np.zeros(len(ids) + 1, dtype=bool)  # with the word before
        linked[1:-1] = (ids[:-1] > 0) & (ids[1:] > 0) & (_find(self.follows, pair) >= 0)
        first = np.flatnonzero(~linked[:-1])
        size = np.diff(np.append(first, len(ids)))
        keep = size >= max(2, self.shortest)
        if len(self.singles):
            keep |= (size == 1) & (_find(self.singles, ids[first]) >= 0) | (size > 1)
        return np.flatnonzero(np.repeat(keep, size) & (ids > 0))

    def search(self, ids: np.ndarray):
        """(position, its window class, words of the window, longest match, test position of that match) of every window found."""
        at = self._runs(ids)
        none = np.zeros(0, dtype=np.int64)
        if not len(at):
            return none, none, none, none, none
        breaks = np.flatnonzero((np.diff(at) > 1) | (_find(self.follows, ids[at[:-1]] * (len(self.vocab) + 1) + ids[at[1:]]) < 0)) + 1
        sizes = np.diff(np.concatenate(([0], breaks, [len(at)])))
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(at))  # words to the end of the run
        own = ids[at]
        ranks, keys = _doubled(own, left, max(self.depth, 1))
        order = np.argsort(ranks[-1], kind="stable")  # the suffix array
        # Ranks of the test grams among the shard's.
        grams = [_find(keys[0], self.text)]
        for k in range(1, len(ranks)):
            step, r = 1 << (k - 1), grams[-1]
            here = np.flatnonzero((self.left >= 2 * step) & (r >= 0))
            here = here[r[here + step] >= 0]
            g = np.full(len(self.text), -1, dtype=np.int64)
            g[here] = _find(keys[k], r[here] * (1 << 31) + r[here + step] + 1)
            grams.append(g)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))

        def common(p: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Words that suffixes of the shard and of the tests have in common."""
            m = np.zeros(len(p), dtype=np.int64)
            for k in range(len(ranks) - 1, -1, -1):
                for _ in range(2 if k == len(ranks) - 1 else 1):
                    may = np.flatnonzero((left[p] >= m + (1 << k)) & (self.left[j] >= m + (1 << k)))
                    g = grams[k][j[may] + m[may]]
                    m[may[(g >= 0) & (g == ranks[k][p[may] + m[may]])]] += 1 << k
            return m

        def places(test: np.ndarray) -> np.ndarray:
            """Place of each test suffix in the suffix array, by binary search."""
            low, high = np.zeros(len(test), dtype=np.int64), np.full(len(test), len(order), dtype=np.int64)
            while (low < high).any():
                live = np.flatnonzero(low < high)
                mid = (low[live] + high[live]) // 2
                p, j = order[mid], test[live]
                m = common(p, j)
                after = (m < self.left[j]) & ((m >= left[p]) | (own[np.minimum(p + m, len(own) - 1)] < self.text[j + m]))
                low[live], high[live] = np.where(after, mid + 1, low[live]), np.where(after, high[live], mid)
            return low

        parts = []
        for n, starts in self.starts.items():  # items whose windows are n words
            a = n.bit_length() - 1
            shift = n - (1 << a)
            starts = starts[(grams[a][starts] >= 0) & (grams[a][starts + shift] >= 0)]
            sub = order[left[order] >= n]
            if not len(starts) or not len(sub):
                continue
            along = ranks[a][sub] * (1 << 31) + ranks[a][sub + shift]  # rises along the suffix array
            wanted = grams[a][starts] * (1 << 31) + grams[a][starts + shift]
            low, high = np.searchsorted(along, wanted, "left"), np.searchsorted(along, wanted, "right")
            found = np.flatnonzero(high > low)
            if not len(found):
                continue
            one = found[np.unique(low[found], return_index=True)[1]]  # an interval once
            many = high[one] - low[one]
            spot = sub[np.repeat(low[one] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            test = starts[found]
            place = places(test)
            by = np.lexsort((self.order[test], place))
            test, place = test[by], place[by]
            beside = np.searchsorted(place, rank[spot], "right")
            longest, best = np.zeros(len(spot), dtype=np.int64), np.zeros(len(spot), dtype=np.int64)
            for k in (beside - 1, beside):  # the test suffixes next to the hit have the longest match
                j = test[np.clip(k, 0, len(test) - 1)]
                m = common(spot, j)
                longest, best = np.where(m > longest, m, longest), np.where(m > longest, j, best)
            parts.append((at[spot], np.repeat(self.class_of[starts[one]], many), np.full(len(spot), n, dtype=np.int64), longest, best))
        return tuple(map(np.concatenate, zip(*parts))) if parts else (none,) * 5

    def shard(self, texts: list[str | None]) -> list[dict]:
        """The hit words and items of each document of a shard, and its longest match."""
        per_doc, sizes, get = [], [], self.vocab.get
        for text in texts:
            own = words(text)
            sizes.append(len(own))
            per_doc.append(np.fromiter(map(get, own, repeat(0)), dtype=np.int64, count=len(own)))
            per_doc.append(np.zeros(1, dtype=np.int64))
        ids = np.concatenate(per_doc) if per_doc else np.zeros(0, dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64) + 1)))
        out = [{"n_words": n, "hits": [], "items": [], "longest": 0, "longest_at": None} for n in sizes]
        at, cls, length, longest, _ = self.search(ids)
        if not len(at):
            return out
        cover = np.bincount(at, minlength=len(ids) + 1) - np.bincount(at + length, minlength=len(ids) + 1)
        covered = np.cumsum(cover[:-1]) > 0
        doc = np.searchsorted(first, at, "right") - 1
        lists = np.array(self.items_of, dtype=np.int64)[cls]
        items: dict[int, set] = {}
        for pair in np.unique(doc * len(self.lists) + lists).tolist():
            k, held = divmod(pair, len(self.lists))
            items.setdefault(k, set()).update(self.lists[held])
        by = np.lexsort((at, -longest, doc))
        top = by[np.flatnonzero(np.concatenate(([True], np.diff(doc[by]) > 0)))]
        for k, n, a in zip(doc[top].tolist(), longest[top].tolist(), at[top].tolist()):
            hits = np.flatnonzero(covered[first[k] : first[k] + sizes[k]]).tolist()
            out[k] |= {"hits": hits, "items": sorted(items[k]), "longest": n, "longest_at": a - int(first[k])}
        return out

    def locations(self, text: str | None) -> list[tuple[int, int | None, int]]:
        """(word position, item id, words) of the longest match at each place of one text that doesn't continue the one before."""
        own = words(text)
        ids = np.fromiter(map(self.vocab.get, own, repeat(0)), dtype=np.int64, count=len(own))
        at, _, _, longest, test = self.search(np.append(ids, 0))
        best: dict[int, tuple[int, int]] = {}
        for a, n, j in zip(at.tolist(), longest.tolist(), test.tolist()):
            best[a] = max(best.get(a, (0, 0)), (n, j))
        return sorted((a, self.item_ids[self.owner[j]], n) for a, (n, j) in best.items() if best.get(a - 1, (0, 0))[0] != n + 1)


def _slices(benchmark: DataFrame, limit: int):
    """The items as lists, each list's texts below `limit` bytes (one item may be larger)."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), text_of(benchmark).alias("text"))
    held, size = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        n = len(row.text.encode("utf-8", "replace"))
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += n
    yield held


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str = "hits_", window: int = WINDOW, limit: int = MAX_INDEX_BYTES) -> DataFrame:
    """`docs` and a column `name`: struct of n_words, hit word positions, items hit, longest match in words and where it starts."""
    slices = _slices(benchmark, limit)
    make = lambda items: text_udf(lambda: TestIndex(items, window).shard, HITS, HITS_ARROW)
    first, second = next(slices), next(slices, None)
    if second is None:
        return docs.withColumn(name, make(first)(text_of(docs)))
    row, each = free_name(docs, "row_"), free_name(docs, "each_")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    found = None
    for items in chain((first, second), slices):  # a job a slice; only its hits are kept
        own = materialize(numbered.select(row, make(items)(text_of(numbered)).alias(each)).where(F.size(F.col(each)["hits"]) > 0))
        found = own if found is None else found.unionByName(own)
    top = F.max(F.struct(F.col(each)["longest"].alias("n"), (-F.col(each)["longest_at"]).alias("at")))
    merged = found.groupBy(row).agg(
        F.array_distinct(F.flatten(F.collect_list(F.col(each)["hits"]))).alias("hits"), F.array_distinct(F.flatten(F.collect_list(F.col(each)["items"]))).alias("items"), top.alias("top")
    )  # a document's own hits
    held = F.struct("hits", "items", F.col("top")["n"].alias("longest"), (-F.col("top")["at"]).alias("longest_at"))
    joined = numbered.join(merged.select(row, held.alias(each)), row, "left")
    count = text_udf(lambda: lambda texts: [len(words(t)) for t in texts], "bigint", pa.int64())(text_of(numbered))
    empty = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    out = F.struct(
        count.alias("n_words"), F.coalesce(F.col(each)["hits"], empty[0]).alias("hits"), F.coalesce(F.col(each)["items"], empty[1]).alias("items"),
        F.coalesce(F.col(each)["longest"], F.lit(0)).alias("longest"), F.col(each)["longest_at"].alias("longest_at"),
    )
    return joined.withColumn(name, out).drop(row, each)


def report(docs: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """One row per document: words, hit words, items hit, whether it counts as contaminated, words and place of the longest match."""
    hits = with_hits(docs.select("doc_id", "text"), benchmark)
    ids = F.concat_ws(",", F.array_sort(F.transform("hits_.items", lambda x: x.cast("string"))))
    return hits.select(
        "doc_id",
        F.col("hits_.n_words").alias("n_words"),
        F.size("hits_.hits").cast("bigint").alias("n_hit"),
        F.size("hits_.items").cast("bigint").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.size("hits_.items") >= min_items).alias("contaminated"),
        F.col("hits_.longest").alias("longest_match"),
        F.col("hits_.longest_at").alias("longest_at"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = 1) -> DataFrame:
    """`docs` without the documents that hold a window of at least `min_items` items."""
    name = free_name(docs, "hits_")
    return with_hits(docs, benchmark, name).where(F.size(F.col(name)["items"]) < min_items).drop(name)
