"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Documents are sets of 5-word shingles (64-bit hashes; fewer words make one shingle). Rows of equal sets
form a class, kept once. Bands and rows are chosen for the target recall at the threshold; classes are
shuffled on their band hashes, and buckets of two classes or more connect them into candidate groups.
Within a group every pair of classes is verified on the full sets, so what banding must find is only a
path between two similar classes. A group goes to tasks in about SPREAD chunks (of CHUNK classes at most and a
quarter of that at least), one task for each pair of chunks, so a group of thousands is dealt over hundreds of tasks; there shared shingles are counted by blockwise matrix products: no pair of
documents is ever emitted, only each class's number of links and a local cluster root.

Output: one row per document with the id of its cluster (class_id: smallest doc_id of the classes
joined by links, directly or through others), of its exact class (copy_id), and n_links, the number of
other documents whose sets have a Jaccard similarity of the threshold or more (copies included).

Defined cases: a null or empty text has no shingle, is nobody's copy and has no link; case and runs of
white space don't matter; a class whose ids are all null has null ids; repeated rows count as copies;
extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, text_of

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 128
#: Classes of a chunk, on average, at most; a task holds two chunks.
CHUNK = 512
#: Chunks that a group is dealt into, as far as their size allows; each class is sent once for each chunk of its group.
SPREAD = 24
_SEED = 77


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most `hashes` values with the recall wanted at the threshold."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        if len(self) < 300_000:
            self[word] = h
        return h


_HASHES = _WordHash()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(_mix(out))


def _set_key(s: np.ndarray) -> int:
    return int(xxhash.xxh3_64_intdigest(s.tobytes())) - (1 << 63)


def _sketch(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, key (null: no shingle), bands (one hash each)."""
    rng = np.random.default_rng(_SEED)
    mul = (rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    def run(batches):
        for batch in batches:
            keys, found = [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text)
                if not len(s):
                    keys.append(None)
                    found.append([])
                    continue
                keys.append(_set_key(s))
                least = np.empty(len(mul), dtype=np.uint64)
                for at in range(0, len(mul), 16):
                    h = s[None, :] * mul[at : at + 16, None]
                    least[at : at + 16] = (h ^ (h >> np.uint64(32))).min(axis=1)
                band = np.arange(bands, dtype=np.uint64) + np.uint64(1)
                for k in range(rows):
                    band = _mix(band ^ least[k::rows][:bands])
                found.append(band.astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "key", "bands"]
            )

    text = text_of(docs)
    rows_in = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows_in.mapInArrow(run, "doc_id bigint, text_hash bigint, key bigint, bands array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node it is connected with) from (node, bucket): smallest labels spread until stable."""
    edges = materialize(edges)
    labels = edges.select("node").distinct().withColumn("label", F.col("node"))
    while True:
        by_bucket = edges.join(labels, "node").groupBy("bucket").agg(F.min("label").alias("least"))
        spread = edges.join(by_bucket, "bucket").groupBy("node").agg(F.min("least").alias("label"))
        spread = materialize(spread)
        # one step of pointer jumping: the label of one's label is as good and further away
        jumped = materialize(
            spread.join(spread.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", F.least("label", "next").alias("label"))
        )
        changed = jumped.join(labels.withColumnRenamed("label", "old"), "node").where(F.col("old") != F.col("label"))
        if changed.isEmpty():
            return jumped
        labels = jumped


def _verify(keys: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], chunk: np.ndarray, threshold: float, within: bool):
    """Links of each class (in documents) and local roots, among all pairs of one chunk (`within`) or of two different ones, either of which may be empty."""
    order = np.argsort(keys, kind="stable")
    keys, sizes, chunk, sets = keys[order], sizes[order], chunk[order], [sets[k] for k in order]
    n = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    count = np.diff(np.append(start, len(flat)))
    column = np.repeat(np.cumsum(count > 1) - 1, count)
    shared = np.repeat(count > 1, count)
    owner, column = owner[shared], column[shared]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    total = int((count > 1).sum())
    for at in range(0, total, 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        block = np.zeros((len(sets), min(4096, total - at)), dtype=np.float32)
        block[owner[lo:hi], column[lo:hi] - at] = 1
        common += block @ block.T
    union = n[:, None] + n[None, :] - common
    link = common >= threshold * union - 1e-4
    np.fill_diagonal(link, False)
    if not within:
        link &= chunk[:, None] != chunk[None, :]
    root = np.arange(len(sets))
    while True:
        low = np.where(link, root[None, :], len(sets)).min(axis=1, initial=len(sets))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return keys, link @ sizes, keys[root], link.any(axis=1)
        root = new


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, class_id, copy_id, n_links of every document."""
    bands, rows = plan_bands(threshold, recall)
    sketch = materialize(_sketch(docs, bands, rows))
    whole = sketch.where(F.col("key").isNotNull())
    classes = materialize(
        whole.groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("n_copies"), F.min("text_hash").alias("text_hash"), F.first("bands").alias("bands"))
    )
    banded = classes.select(F.col("key").alias("node"), F.explode("bands").alias("bucket"))
    busy = banded.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("bucket")
    groups = components(banded.join(busy, "bucket"))

    sized = groups.groupBy("label").agg(F.count("*").alias("members"))
    dealt = (
        groups.join(sized, "label")
        .withColumn("chunks", F.ceil(F.col("members") / F.least(F.lit(chunk), F.greatest(F.lit(chunk // 4), F.ceil(F.col("members") / SPREAD)))).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks")).cast("int"))
        .select("label", F.col("node").alias("key"), "chunks", "own")
    )
    members = materialize(dealt.join(classes.select("key", "n_copies", "text_hash"), "key"))
    text = text_of(docs)
    texts = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text")).join(members.select("text_hash"), "text_hash", "left_semi").dropDuplicates(["text_hash"])

    def sets(batches):
        for batch in batches:
            found = [shingles(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["key", "shingles"])

    full = members.drop("text_hash").join(texts.select("text").mapInArrow(sets, "key bigint, shingles binary"), "key")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    units = full.select("label", "key", "n_copies", "shingles", "own", other)
    units = units.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})

    def verify(table: pa.Table) -> pa.Table:
        col = lambda c: table.column(c).to_numpy()
        held = [np.frombuffer(b, dtype=np.uint64) for b in table.column("shingles").to_pylist()]
        keys, links, roots, any_link = _verify(col("key"), col("n_copies"), held, col("own"), threshold, bool(col("a")[0] == col("b")[0]))
        unit = int(col("label")[0]) ^ (int(col("a")[0]) << 20) ^ int(col("b")[0])
        buckets = [xxhash.xxh3_64_intdigest(f"{unit}:{r}".encode()) - (1 << 63) for r in roots]
        return pa.table({"node": keys, "links": links.astype(np.int64), "bucket": pa.array(buckets, pa.int64()), "linked": any_link})

    verified = materialize(units.groupBy("label", "a", "b").applyInArrow(verify, "node bigint, links bigint, bucket bigint, linked boolean"))
    linked = verified.where("linked")
    clusters = components(linked.select("node", "bucket"))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    per_class = classes.select(F.col("key").alias("node"), "copy_id", "n_copies").join(clusters, "node", "left").join(links, "node", "left")
    per_class = per_class.withColumn("label", F.coalesce("label", "node"))
    least = per_class.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    per_class = per_class.join(least, "label").select(
        F.col("node").alias("key"), "class_id", "copy_id", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links")
    )
    out = sketch.select("doc_id", "key").join(per_class, "key", "left")
    alone = F.col("key").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """`docs` with one document of each cluster: the one with the smallest doc_id (of rows repeating it, the one of the smallest text).

    Rows with a null doc_id can't be told apart by id; they stay. Where one id has different texts, only those rows go
    whose own text is in the cluster of a smaller id or, within one cluster, of a smaller text. Only rows that may go are shuffled.
    """
    row = free_name(docs, "row_")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    own = join(numbered.select(F.col(row).alias("doc_id"), "text"), threshold, recall).select(F.col("doc_id").alias(row), F.col("class_id").alias("class_"))
    copies = materialize(own.where(F.col(row) != F.col("class_")))  # a class is named by its first row
    heads = copies.select("class_").distinct().select(F.col("class_").alias(row), "class_")
    named = numbered.select(row, F.col("doc_id").alias("id_"), F.xxhash64(text_of(numbered)).alias("hash_")).where("id_ IS NOT NULL").join(copies.unionByName(heads), row)
    named = materialize(named)  # joins are by row, so a large class has no task of its own
    least = named.groupBy("class_").agg(F.min(F.struct("id_", "hash_", row)).alias("first_")).select(F.col("first_")[row].alias(row))
    go = materialize(named.select(row).join(least, row, "left_anti"))
    return numbered.join(go, row, "left_anti").select(*docs.columns)
