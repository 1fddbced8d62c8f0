"""Language identification by prediction by partial matching over bytes, with frozen statistics.

For each language a context tree of order 3 holds how often each byte follows each context of three,
two, one and no bytes. A byte's code length in a context is -log2(count / (total + distinct)); if the
context has not seen it, the escape of -log2(distinct / (total + distinct)) is paid and the context
grows shorter, down to 8 bits for a byte never seen (method C, without exclusions). The statistics
do not adapt while a text is scored, so its code length is a sum over its byte 4-grams, each of which
has one fixed length in each language. The language with the shortest code wins; the score is its
share of 2**-length over all languages, from 0 to 1.

The trees are fitted on a bounded sample of labelled rows, whole texts. One bound holds for all of it:
`SAMPLE_TOTAL` bytes, shared evenly among the languages, of which the `SAMPLE_LABELS` with most rows are
learnt. A language has at most `SAMPLE_ROWS` documents within its share, drawn by a hash of the row; those
of more than SAMPLE_BYTES bytes come after all others. Languages whose first document is beyond their
share have that one, shortest first, as far as another SAMPLE_TOTAL bytes go (one always); the rest are not learnt. So
what reaches the driver and each worker, the sample's distinct 4-grams and their counts, has a bound
whatever the labels are. Only text and lang of rows that are not held out are learnt from; a prediction
sees the text alone.

Defined cases: a null text or one without a letter is `und` with score 0, as is every text where
nothing could be learnt. Rows without lang teach nothing. A null doc_id counts as held out. Repeated
rows are each scored. Ties go to the first language in order of name. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

SAMPLE_ROWS = 256
SAMPLE_BYTES = 65_536
SAMPLE_TOTAL = 4 << 20
SAMPLE_LABELS = 1000
#: Code lengths, languages x known grams, that are worked out ahead; beyond it they are looked up in the trees.
TABLE = 16 << 20
#: Bits that a text's code may have beyond its plain bytes before its language counts as unknown.
SLACK = 256
#: Lots of the draw.
DRAWS = 1 << 40
#: What stands before a text's first byte.
PAD = b"\n\n\n"
_U = np.uint32
_SLOT_BITS = 21


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The byte 4-grams of the texts, one for each byte, and the bounds of each text's."""
    raw = [PAD + t.lower().encode() for t in texts]
    buf = np.frombuffer(b"".join(raw) or b"", dtype=np.uint8).astype(_U)
    grams = buf.copy()
    for back in (1, 2, 3):
        grams[back:] |= buf[:-back] << _U(8 * back)
    sizes = np.array([len(r) for r in raw])
    keep = np.ones(len(buf), dtype=bool)
    starts = np.cumsum(sizes) - sizes
    for i in range(3):
        keep[starts + i] = False
    return grams[keep], np.concatenate([[0], np.cumsum(sizes - 3)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct grams and counts of each language of some rows (lang, text), all of which are here."""
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        own: dict[str, list[str]] = {}
        for lang, text in zip(langs, texts, strict=True):
            own.setdefault(lang, []).append(text)
        for lang, some in own.items():
            found.setdefault(lang, []).append(np.unique(_grams(some)[0], return_counts=True))
    for lang, parts in found.items():
        grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([c for _, c in parts])).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([grams.astype("<u4").tobytes()], pa.binary()), pa.array([n.astype("<u4").tobytes()], pa.binary())], names=["lang", "grams", "n"])


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted key is among the sorted keys, and its value."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


class Tree:
    """The context tree of one language, as sorted arrays for each order."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.orders = []
        for order in (3, 2, 1, 0):
            keys = grams & _U((1 << 8 * (order + 1)) - 1)
            keys, where = np.unique(keys, return_inverse=True)
            n = np.bincount(where, weights=counts)
            contexts, where = np.unique(keys >> _U(8), return_inverse=True)
            totals, distinct = np.bincount(where, weights=n), np.bincount(where)
            escapes = np.log2(totals + distinct) - np.log2(distinct)
            self.orders.append((order, keys, np.log2((totals + distinct)[where]) - np.log2(n), contexts, escapes))

    def lengths(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram after the three before it."""
        bits = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        for order, keys, costs, contexts, escapes in self.orders:
            own = grams[open_] & _U((1 << 8 * (order + 1)) - 1)
            seen, cost = _lookup(keys, costs, own)
            bits[open_[seen]] += cost[seen]
            open_, own = open_[~seen], own[~seen]
            known, escape = _lookup(contexts, escapes, own >> _U(8))
            bits[open_[known]] += escape[known]
        bits[open_] += 8
        return bits


class Model:
    """The trees of all languages, with the lengths of every gram that any of them has seen where these are few enough."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.trees = [Tree(*counts[x]) for x in self.langs]
        self.known = np.unique(np.concatenate([counts[x][0] for x in self.langs])) if self.langs else np.zeros(0, dtype=_U)
        if len(self.known) * len(self.langs) > TABLE:
            self.known = self.known[:0]
        self.costs = [t.lengths(self.known) for t in self.trees]
        # A slot names one of the known grams that fall into it; the others take the long way.
        self.slots = np.zeros(1 << _SLOT_BITS if len(self.known) else 0, dtype=np.int32)
        if len(self.known):
            self.slots[self._slot(self.known)] = np.arange(len(self.known))

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * _U(0x9E3779B1)) >> _U(32 - _SLOT_BITS)

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code lengths, texts x languages; texts must not be empty."""
        grams, bounds = _grams(texts)
        at = self.slots[self._slot(grams)] if len(self.known) else None
        missed = np.flatnonzero(self.known[at] != grams) if len(self.known) else np.arange(len(grams))
        rare, where = np.unique(grams[missed], return_inverse=True)
        out = np.empty((len(texts), len(self.langs)))
        for j, (tree, costs) in enumerate(zip(self.trees, self.costs, strict=True)):
            each = costs[at] if at is not None else np.empty(len(grams))
            each[missed] = tree.lengths(rare)[where]
            out[:, j] = np.add.reduceat(each, bounds[:-1])
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, total: int = SAMPLE_TOTAL, labels: int = SAMPLE_LABELS) -> Model:
    """The model of the labelled rows of `docs` (doc_id, text, lang) that are not held out."""
    small_batches(docs.sparkSession)
    labelled = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.where(~held_out(F.col("doc_id"))).where("lang is not null and text <> ''")
    size = F.octet_length("text")
    labelled = labelled.withColumns({"bytes": size.cast("long"), "long": size > most_bytes, "draw": F.pmod(F.xxhash64("doc_id", "text"), F.lit(DRAWS))})
    # Lots below a bar give about four times the rows wanted, whatever the table's size. Equal rows have
    # one lot; the smallest lots within the bounds are taken.
    sizes = stored(labelled.groupBy("lang", "long").agg(F.count("*").alias("n")), "sizes")  # files tell Spark their size, so texts are not shuffled for a small table
    learnt = stored(sizes.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(labels).select("lang"), "learnt")
    share = min(rows * most_bytes, total // max(1, learnt.count()))
    bars = sizes.join(learnt, "lang").select("lang", "long", F.least(F.lit(DRAWS), (F.lit(4.0 * rows * DRAWS) / F.col("n")).cast("long") + 1).alias("bar"))
    bars = stored(bars, "bars")
    lots = labelled.select("lang", "long", "draw", "bytes").join(bars, ["lang", "long"]).where("draw < bar").groupBy("lang", "long", "draw").agg(F.max("bytes").alias("bytes"))
    drawn = Window.partitionBy("lang").orderBy("long", "draw")
    lots = lots.withColumns({"rank": F.row_number().over(drawn), "all": F.sum("bytes").over(drawn.rowsBetween(Window.unboundedPreceding, 0))})
    lots = stored(lots.where((F.col("rank") == 1) | ((F.col("rank") <= rows) & (F.col("all") <= share))), "lots")
    # One row for each language, of which there are at most `labels`.
    alone = lots.where((F.col("rank") == 1) & (F.col("bytes") > share)).withColumn("all", F.sum("bytes").over(Window.orderBy("bytes", "lang").rowsBetween(Window.unboundedPreceding, 0)))
    fitting = lots.where(F.col("bytes") <= share).unionByName(alone.where((F.col("all") <= total) | (F.col("all") == F.col("bytes")))).select("lang", "long", "draw")
    fitting = stored(fitting, "fitting")
    sample = labelled.join(fitting, ["lang", "long", "draw"]).groupBy("lang", "long", "draw").agg(F.first("text").alias("text"))
    # A language's sample is bounded, so one task counts it whole.
    counted = sample.select("lang", "text").repartition("lang").mapInArrow(_count, "lang string, grams binary, n binary").collect()
    return Model({r.lang: (np.frombuffer(r.grams, dtype="<u4").astype(_U), np.frombuffer(r.n, dtype="<u4").astype(np.float64)) for r in counted})


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def unknown(text: Column, found: Column) -> Column:
    """Whether the language of a text can't be told: it has no letter, or no language's code is shorter than its bytes as they stand, but for SLACK."""
    size = F.octet_length(text)
    return (found["lang_pred"] == "und") | (found["bits_per_byte"] * size > 8 * size + SLACK)


def predicted(text: Column, model: Model) -> Column:
    """A column of lang_pred, score and bits_per_byte; the rest of a row stays where it is."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def predict(texts: pd.Series, letters: pd.Series) -> pd.DataFrame:
        m: Model = shared.value
        names = np.full(len(texts), "und", dtype=object)
        scores, rates = np.zeros(len(texts)), np.zeros(len(texts))
        judged = np.flatnonzero(letters.to_numpy(dtype=bool)) if m.langs else []
        for lo in range(0, len(judged), 64):
            some = judged[lo : lo + 64]
            own = [texts.iat[i] for i in some]
            bits = m.bits(own)
            best, least = bits.argmin(axis=1), bits.min(axis=1)
            scores[some] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            rates[some] = least / np.maximum(1, [len(t.encode()) for t in own])
            names[some] = [m.langs[j] for j in best]
        return pd.DataFrame({"lang_pred": names, "score": scores, "bits_per_byte": rates})

    return predict(text, has_letter(text))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and bits_per_byte of each row of `docs` (doc_id, text)."""
    small_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), predicted(F.col("text").cast("string"), model).alias("found"))
    return found.select("doc_id", "found.*")


def language_digest(docs: DataFrame) -> DataFrame:
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
