"""Language identification by rank-order profiles.

Texts become sequences of 64 symbols: the letters a-z, 37 classes of all other letters (by code point, so that the
letters of a script mostly differ), and one boundary symbol for runs of anything else. A profile lists a language's most frequent 1-, 2- and
3-grams by rank, from the counts of every training document; a document's own most frequent n-grams are
compared with each profile by the out-of-place distance, an n-gram absent from the profile costing the
maximum. Equal counts rank by n-gram code, equal distances go to the language first by code point.

Defined cases: a text that is null or has no letter is `und` with score 0; a null lang or id is never
learned from; without any training row every text is `und`; very long texts are counted whole; repeated
rows and extra columns change nothing.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, text_udf

#: n-grams in a language profile and in a document's.
PROFILE = 600
SYMBOLS = 64
#: n-gram codes: 1-grams, then 2-grams, then 3-grams.
CODES = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
UNKNOWN = "und"


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x3000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()[0]
            table[cp] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 37
    table[0x3000:0xD800] = 27 + np.arange(0x3000, 0xD800) % 37
    table[0xE000:] = 27 + np.arange(0xE000, 0x110000) % 37
    return table


_TABLE: list[np.ndarray] = []


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's 1-, 2- and 3-gram codes, ascending, and their occurrences; runs of boundary symbols count as one."""
    if not _TABLE:
        _TABLE.append(_symbol_table())
    s = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    s = np.concatenate((np.zeros(1, np.uint8), s, np.zeros(1, np.uint8)))
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    s = s[keep].astype(np.int32)
    two = s[:-1] * SYMBOLS + s[1:]
    three = two[:-1] * SYMBOLS + s[2:]
    codes, counts = np.unique(np.concatenate((s, two + SYMBOLS, three + (SYMBOLS + SYMBOLS**2))), return_counts=True)
    says = (codes != 0) & (codes != SYMBOLS)  # the boundary alone says nothing
    return codes[says], counts[says]


def ranked(codes: np.ndarray, counts: np.ndarray, top: int = PROFILE) -> np.ndarray:
    """Codes by falling count, then code; at most `top`."""
    if len(codes) > 4 * top:
        least = np.partition(counts, len(codes) - top)[len(codes) - top]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:top]


def profiles(train: DataFrame, top: int = PROFILE) -> DataFrame:
    """lang, code, rank: the profile of each language over all rows of (lang, text)."""

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, n = gram_counts(text)
                held.setdefault(lang, np.zeros(CODES, dtype=np.int64))[codes] += n
                if len(held) > 20:  # bounded memory for any number of languages
                    yield from emit(held)
        yield from emit(held)

    def emit(held):
        for lang, counts in held.items():
            codes = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int32()), pa.array(counts[codes], pa.int64())], names=["lang", "code", "n"])
        held.clear()

    rows = train.select(F.col("lang").cast("string").alias("lang"), text_of(train).alias("text"))
    counts = rows.mapInArrow(count, "lang string, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", "code", "rank")


class RankOrder:
    """The profiles as one matrix of ranks; absent n-grams cost the maximum."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int = PROFILE):
        self.top = top
        self.langs = sorted({r[0] for r in rows})
        self.ranks = np.full((CODES, max(1, len(self.langs))), 0, dtype=np.int32)
        self.found = np.zeros(self.ranks.shape, dtype=bool)
        at = {lang: k for k, lang in enumerate(self.langs)}
        for lang, code, rank in rows:
            self.ranks[code, at[lang]], self.found[code, at[lang]] = rank - 1, True

    def predict(self, text: str) -> tuple[str, float]:
        if not self.langs or next(filter(str.isalpha, text), None) is None:
            return UNKNOWN, 0.0
        codes = ranked(*gram_counts(text), self.top)
        places = np.abs(self.ranks[codes] - np.arange(len(codes))[:, None])
        places[~self.found[codes]] = self.top
        total = places.sum(axis=0)
        best = int(np.argmin(total))
        return self.langs[best], float(1 - total[best] / (self.top * len(codes)))


_ROW_ARROW = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def predict_column(model: RankOrder, text: Column) -> Column:
    """Struct of lang_pred and score for a text column without nulls."""

    def make():
        return lambda texts: [{"lang_pred": a, "score": b} for a, b in map(model.predict, texts)]

    return text_udf(make, "struct<lang_pred:string,score:double>", _ROW_ARROW)(text)


def fit(train: DataFrame, top: int = PROFILE) -> RankOrder:
    """Rank-order profiles of all rows with a lang; `top` rows per language come to the driver."""
    return RankOrder([tuple(r) for r in profiles(train.where(F.col("lang").isNotNull()), top).collect()], top)


def identify(docs: DataFrame, held_out: Column, top: int = PROFILE) -> DataFrame:
    """Fit on the rows that aren't held out, predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out), top)
    out = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), predict_column(model, text_of(docs)).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang_pred").alias("lang_pred"), F.col("p.score").alias("score"))
