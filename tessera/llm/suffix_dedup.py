"""Suffix-array dedup: remove every byte covered by a 100-byte string that also starts earlier in the corpus.

The suffix array is built by linear grouping: suffixes are grouped by their Lyndon prefix, processing the
groups in descending order and splitting the groups of the previous smaller suffixes by how many of their
followers lie in the group just processed; then one scan emits each group's order along the same
pointers, without renaming and recursion (`suffix_array`).

A suffix array of a whole corpus fits no task, so equal 100-byte strings are first brought together. Each
window of 100 bytes has a minimizer: the smallest hash among its LETTERS-byte strings (leftmost of equal
ones). Equal windows have equal minimizers, at the same offset. Neighbouring windows with one minimizer
form a stretch. Stretches are dealt by minimizer into buckets as packed arrays of hashes and positions
(26 bytes each); a stretch alone with its minimizer has no copy; of stretches equal as a whole all
but the first are copies throughout. Only where different stretches share a minimizer is
their text read again. A passage that many documents hold has one minimizer and as many stretches as
contexts, so these are dealt finer: windows are cut, by their place relative to the minimizer, into parts
of BAND windows, which all hold the part's middle bytes (its core). Parts meet by core and differ in at most
BAND - 1 bytes at either end; a suffix array over the parts of one core, the core being one symbol, finds
the equal windows.

A batch of documents settles its own equal stretches before the shuffle: all but the first are copies
whatever the other batches hold, so a passage or document that fills a third of the rows reaches its
bucket once a batch. Spans that touch are merged wherever spans are written.

Defined cases: null and empty texts have no bytes; texts under 100 bytes are kept whole; documents are
ordered by id, null ids first, rows of one id in the order they are read; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

LENGTH = 100
#: Bytes of the strings whose smallest hash is a window's minimizer.
LETTERS = 32
#: Bytes of text a bucket stands for, on average.
BUCKET_BYTES = 32 << 20
#: Window starts of a part.
BAND = 8
NULL_ID = np.iinfo(np.int64).min
_AT_BITS = np.uint64(28)
_BASE = 0x9E3779B97F4A7C15 | 1
_STRETCH = np.dtype([("mhash", "u8"), ("chash", "u8"), ("doc", "i4"), ("start", "i4"), ("n", "u1"), ("at", "u1")])
_SPAN = np.dtype([("start", "i4"), ("n", "i4")])
_PIECE = np.dtype([("mhash", "u8"), ("start", "i4"), ("n", "u1"), ("at", "u1")])
_PART = np.dtype([("key", "u8"), ("doc", "i4"), ("start", "i4"), ("left", "u1"), ("right", "u1")])


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes of `text` in ascending order; the last symbol must be its only smallest."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    group = [0] * n  # of a suffix: where its group starts in `order`
    end = {}
    start = 0
    for k, i in enumerate(order):
        place[i] = k
        if k and text[i] != text[order[k - 1]]:
            end[start] = k
            start = k
        group[i] = start
    end[start] = n
    before = [-1] * n  # previous suffix in a smaller group
    top = n
    while top > 0:
        low = group[order[top - 1]]
        followers: dict[int, int] = {}
        for i in sorted(order[low:top]):
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                followers[j] = followers.get(j, 0) + 1
        if followers:
            by_count: dict[int, dict[int, list[int]]] = {}
            for j, count in followers.items():
                by_count.setdefault(count, {}).setdefault(group[j], []).append(j)
            for count in sorted(by_count, reverse=True):
                for home, movers in by_count[count].items():
                    stop = end[home]
                    at = stop - len(movers)
                    if at == home:
                        continue
                    cut = stop
                    for j in movers:
                        cut -= 1
                        here, other = place[j], order[cut]
                        order[here], place[other] = other, here
                        order[cut], place[j] = j, cut
                        group[j] = at
                    end[home], end[at] = at, stop
        top = low
    out = [-1] * n
    free = {g: g for g in set(group)}
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = before[j]
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0][:n], _POWERS[1][:n]


def stretches(texts: list[bytes]) -> np.ndarray:
    """The stretches of the windows of each text; `doc` is its place in the list, `at` the minimizer's in the stretch."""
    held = [(k, t) for k, t in enumerate(texts) if len(t) >= LENGTH]
    if not held:
        return np.zeros(0, _STRETCH)
    data = np.frombuffer(b"".join(t for _, t in held), dtype=np.uint8)
    sizes = np.array([len(t) for _, t in held], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    whole = _mixed((sums[LETTERS:] - sums[:-LETTERS]) * down[: len(data) - LETTERS + 1])
    low = (np.uint64(1) << _AT_BITS) - np.uint64(1)
    least = (whole & ~low) | np.arange(len(whole), dtype=np.uint64)
    width, want = 1, LENGTH - LETTERS + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    inside = np.ones(len(least), dtype=bool)
    for a in first[1:].tolist():
        inside[max(0, a - LENGTH + 1) : a] = False
    at = np.flatnonzero(inside)
    least = least[at]
    cut = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    n = np.diff(np.append(cut, len(at)))
    begin = at[cut]
    out = np.zeros(len(cut), _STRETCH)
    which = np.searchsorted(first, begin, "right") - 1
    out["doc"] = np.array([k for k, _ in held])[which]
    out["start"], out["n"] = begin - first[which], n
    minimizer = (least[cut] & low).astype(np.int64)
    out["at"] = minimizer - begin
    out["mhash"] = whole[minimizer]  # all 64 bits: few of a minimum's vary, and chance must not join stretches
    out["chash"] = _mixed((sums[begin + n + LENGTH - 1] - sums[begin]) * down[begin] + n.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    return out


def _chunks(texts: list[bytes], size: int = 1 << 20):
    """Consecutive runs of texts of about `size` bytes, with the place of the first."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield at, texts[at : k + 1]
            at, held = k + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def _later_copies(ids: np.ndarray, rows: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Of stretches: whether an equal one comes first by (id, row, start)."""
    key = s["chash"] ^ (s["mhash"] * np.uint64(_BASE))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(s), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    at = at[np.lexsort((s["start"][at], rows[at], ids[at], s["n"][at], s["chash"][at], s["mhash"][at]))]
    t = s[at]
    equal = (t["mhash"][1:] == t["mhash"][:-1]) & (t["chash"][1:] == t["chash"][:-1]) & (t["n"][1:] == t["n"][:-1])
    later = np.zeros(len(s), dtype=bool)
    later[at[1:][equal]] = True
    return later


def _dealt(batch_texts: list[str], ids: np.ndarray, rows: np.ndarray, buckets: int):
    """(bucket, blobs) of a batch: the first copy of each of its stretches; below bucket 0, the spans of the others by row."""
    found = []
    texts = [t.encode("utf-8", "replace") for t in batch_texts]
    for at, part in _chunks(texts):
        s = stretches(part)
        s["doc"] += at
        found.append(s)
    s = np.concatenate(found) if found else np.zeros(0, _STRETCH)
    later = _later_copies(ids[s["doc"]], rows[s["doc"]], s)
    for row, _, spans in _by_row(rows[s["doc"][later]], _spans(s[later]), 0):
        yield -1 - row % buckets, np.int64(row).tobytes(), spans
    s = s[~later]
    bucket = s["mhash"] % np.uint64(buckets)
    by = np.argsort(bucket, kind="stable")
    s, bucket = s[by], bucket[by]
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(s) else np.zeros(0, int)
    for a, b in zip(edge, np.append(edge[1:], len(s))):
        own = s[a:b]
        docs, place = np.unique(own["doc"], return_inverse=True)
        own = own.copy()
        own["doc"] = place
        yield int(bucket[a]), ids[docs].tobytes() + rows[docs].tobytes(), own.tobytes()


def _spans(s: np.ndarray) -> np.ndarray:
    """The window starts of stretches or pieces."""
    out = np.zeros(len(s), _SPAN)
    out["start"], out["n"] = s["start"], s["n"]
    return out


def _merged(rows: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans by row and start, those that continue one another as one."""
    order = np.lexsort((spans["start"], rows))
    rows, spans = rows[order], spans[order]
    if not len(rows):
        return rows, spans
    ends = spans["start"] + spans["n"]
    first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (spans["start"][1:] != ends[:-1]))))
    out = spans[first]
    out["n"] = ends[np.append(first[1:], len(rows)) - 1] - out["start"]
    return rows[first], out


def _by_row(rows: np.ndarray, items: np.ndarray, kind: int):
    """(row, kind, bytes of the row's items), one for each row."""
    if items.dtype == _SPAN:
        rows, items = _merged(rows, items)
    else:
        order = np.argsort(rows, kind="stable")
        rows, items = rows[order], items[order]
    edge = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, int)
    for a, b in zip(edge, np.append(edge[1:], len(rows))):
        yield int(rows[a]), kind, items[a:b].tobytes()


def _table(found) -> pa.Table:
    found = list(found)
    return pa.table({"row": pa.array([f[0] for f in found], pa.int64()), "kind": pa.array([f[1] for f in found], pa.int32()), "items": pa.array([f[2] for f in found], pa.binary())})


def settle(ids: np.ndarray, rows: np.ndarray, s: np.ndarray):
    """Of a bucket's stretches: copies throughout (kind 0), and those sharing a minimizer with different ones (kind 1)."""
    key = s["mhash"]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    shared = np.zeros(len(s), dtype=bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    at = np.flatnonzero(shared)
    order = np.lexsort((s["start"][at], rows[at], ids[at], s["chash"][at], s["mhash"][at]))
    at = at[order]
    t = s[at]
    new_m = np.concatenate(([True], t["mhash"][1:] != t["mhash"][:-1])) if len(t) else np.zeros(0, bool)
    new_c = new_m.copy()
    new_c[1:] |= (t["chash"][1:] != t["chash"][:-1]) | (t["n"][1:] != t["n"][:-1])
    yield from _by_row(rows[at][~new_c], _spans(t[~new_c]), 0)
    group = np.cumsum(new_m) - 1
    kinds = np.bincount(group[new_c], minlength=group[-1] + 1 if len(group) else 0)
    unclear = new_c & (kinds[group] > 1) if len(group) else new_c
    pieces = np.zeros(unclear.sum(), _PIECE)
    for f in _PIECE.names:
        pieces[f] = t[f][unclear]
    yield from _by_row(rows[at][unclear], pieces, 1)


def repeated_windows(parts: list[list[int]], order: list[tuple], length: int) -> list[tuple[int, int]]:
    """(part, start) of the windows of `length` symbols that occur earlier in another part, by suffix array.

    Symbols are above 1; `order` holds the parts' order keys, the last element being where the part starts.
    """
    text: list[int] = []
    owner: list[int] = []
    within: list[int] = []
    for k, p in enumerate(parts):
        text += p
        text.append(1)
        owner += [k] * (len(p) + 1)
        within += range(len(p) + 1)
    text.append(0)
    found: list[tuple[int, int]] = []
    run: list[int] = []

    def close():
        if len(run) > 1:
            keep = min(run, key=lambda a: (*order[owner[a]][:-1], order[owner[a]][-1] + within[a]))
            found.extend((owner[a], within[a]) for a in run if a != keep)
        run.clear()

    for a in suffix_array(text)[1:]:
        if within[a] + length > len(parts[owner[a]]):
            continue
        if run and text[a : a + length] != text[run[-1] : run[-1] + length]:
            close()
        run.append(a)
    close()
    return found


def cut_parts(data: bytes, pieces: np.ndarray):
    """(key, start, left, right) of the parts of a document's pieces: the core's hash, the first window, the bytes beside the core."""
    for mhash, start, n, at in pieces.tolist():
        base = start + at - (LENGTH - LETTERS)
        for band in range((start - base) // BAND, (start + n - 1 - base) // BAND + 1):
            edge = base + band * BAND
            low, high = max(start, edge), min(start + n, edge + BAND)
            a, z = edge + BAND - 1, edge + LENGTH
            yield xxhash.xxh3_64_intdigest(data[a:z], (mhash + band) & 0xFFFFFFFFFFFFFFFF), low, data[low:a], data[z : high - 1 + LENGTH]


class _Parts:
    """The first copy of each part seen, and the spans of all later ones."""

    def __init__(self):
        self.first: dict[tuple[int, bytes, bytes], tuple[int, int, int]] = {}
        self.rows: list[int] = []
        self.spans: list[tuple[int, int]] = []

    def add(self, key: int, left: bytes, right: bytes, place: tuple[int, int, int]) -> None:
        held = self.first.setdefault((key, left, right), place)
        if held is not place:
            if place < held:
                self.first[key, left, right], place = place, held
            self.drop(place, len(left) + len(right) + 2 - BAND)

    def drop(self, place: tuple[int, int, int], n: int) -> None:
        self.rows.append(place[1])
        self.spans.append((place[2], n))

    def settled(self):
        """(row, kind, spans) of what was dropped."""
        return _by_row(np.array(self.rows, np.int64), np.array(self.spans, _SPAN), 0)


def _dealt_parts(batch: pa.RecordBatch, buckets: int):
    """(bucket, docs, items, edges) of the parts of a batch of (doc_id, text, row, pieces), as `_dealt`."""
    parts = _Parts()
    for doc_id, text, row, blobs in zip(*(batch.column(k).to_pylist() for k in range(4))):
        who = NULL_ID if doc_id is None else doc_id, row
        for key, start, left, right in cut_parts(text.encode("utf-8", "replace"), np.frombuffer(b"".join(blobs), _PIECE)):
            parts.add(key, left, right, (*who, start))
    for row, _, spans in parts.settled():
        yield -1 - row % buckets, np.int64(row).tobytes(), spans, b""
    held: dict[int, list] = {}
    for found in parts.first.items():
        held.setdefault(found[0][0] % buckets, []).append(found)
    for bucket, found in held.items():
        docs: dict[tuple[int, int], int] = {}
        items = [(key, docs.setdefault(place[:2], len(docs)), place[2], len(left), len(right)) for (key, left, right), place in found]
        yield bucket, np.array(list(docs), np.int64).T.tobytes(), np.array(items, _PART).tobytes(), b"".join(left + right for (_, left, right), _ in found)


def _settled(table: pa.Table) -> pa.Table | None:
    """The spans of a bucket below 0, which are settled already."""
    if table.column("bucket")[0].as_py() >= 0:
        return None
    return _table((int.from_bytes(r, "little"), 0, blob) for r, blob in zip(table.column("docs").to_pylist(), table.column("items").to_pylist()))


def _parts_table(table: pa.Table) -> pa.Table:
    """Spans found by the suffix arrays of one bucket of parts."""
    if (known := _settled(table)) is not None:
        return known
    parts = _Parts()
    for docs, items, edges in zip(*(table.column(c).to_pylist() for c in ("docs", "items", "edges"))):
        ids, rows = np.frombuffer(docs, "i8").reshape(2, -1).tolist()
        at = 0
        for key, doc, start, left, right in np.frombuffer(items, _PART).tolist():
            cut = at + left
            parts.add(key, edges[at:cut], edges[cut : cut + right], (ids[doc], rows[doc], start))
            at = cut + right
    by_core: dict[int, list] = {}
    for (key, left, right), place in parts.first.items():
        by_core.setdefault(key, []).append(([b + 3 for b in left] + [2] + [b + 3 for b in right], place))
    for found in by_core.values():
        if len(found) > 1:
            texts, places = zip(*found)
            for k, start in repeated_windows(texts, places, BAND):
                parts.drop((*places[k][:2], places[k][2] + start), 1)
    return _table(parts.settled())


def removed_runs(size: int, spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows starting in `spans`."""
    runs: list[list[int]] = []
    for start, n in sorted(zip(spans["start"].tolist(), spans["n"].tolist())):
        end = start + n + LENGTH - 1
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return [(a, min(b, size)) for a, b in runs]


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents as (row, doc_id, text), and (row, spans: list of packed spans) of those with removed windows."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    # Numbers the rows once. The filter drops nothing: with it both joins below read the texts by one plan, and share its shuffle.
    numbered = materialize(rows.withColumn("row", F.monotonically_increasing_id())).where("row IS NOT NULL")
    total = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))

    def deal(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            found = list(_dealt(batch.column(1).to_pylist(), ids, batch.column(2).to_numpy(), buckets))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.binary())], names=["bucket", "docs", "items"])

    def gather(table: pa.Table) -> pa.Table:
        if (settled := _settled(table)) is not None:
            return settled
        ids, rows, items = [], [], []
        for docs_blob, blob in zip(table.column("docs").to_pylist(), table.column("items").to_pylist()):
            who = np.frombuffer(docs_blob, "i8").reshape(2, -1)
            s = np.frombuffer(blob, _STRETCH)
            items.append(s)
            ids.append(who[0][s["doc"]])
            rows.append(who[1][s["doc"]])
        return _table(settle(np.concatenate(ids), np.concatenate(rows), np.concatenate(items)))

    dealt = numbered.select("doc_id", "text", "row").mapInArrow(deal, "bucket int, docs binary, items binary")
    known = materialize(dealt.groupBy("bucket").applyInArrow(gather, "row bigint, kind int, items binary"))

    unclear = known.where("kind = 1").groupBy("row").agg(F.collect_list("items").alias("items"))

    def fetch(batches):
        for batch in batches:
            found = list(_dealt_parts(batch, buckets))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary() if k else pa.int32()) for k in range(4)], names=["bucket", "docs", "items", "edges"])

    pieces = numbered.join(unclear, "row").select("doc_id", "text", "row", "items")
    more = pieces.mapInArrow(fetch, "bucket int, docs binary, items binary, edges binary").groupBy("bucket").applyInArrow(_parts_table, "row bigint, kind int, items binary")
    spans = known.where("kind = 0").unionByName(more).groupBy("row").agg(F.collect_list("items").alias("spans"))
    return numbered, spans


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    numbered, spans = repeats(docs)

    def digest(batches):
        for batch in batches:
            out = []
            for text, blobs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode("utf-8", "replace")
                runs = removed_runs(len(data), np.frombuffer(b"".join(blobs), _SPAN)) if blobs else []
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((len(data), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            cols = [pa.array([o[k] for o in out], pa.int64() if k < 3 else pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = numbered.join(spans, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and the text that is left of every document; bytes cut from the middle of a character are replaced."""
    numbered, spans = repeats(docs)

    def cut(batches):
        for batch in batches:
            out = []
            for text, blobs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode("utf-8", "replace")
                for a, b in reversed(removed_runs(len(data), np.frombuffer(b"".join(blobs or []), _SPAN))):
                    data = data[:a] + data[b:]
                out.append(data.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return numbered.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id bigint, text string")
