"""What filters do to each other: outcomes of every order of five filters, from one histogram.

A document is reduced to a mask: bit i is set if filter i fails it. All outcomes of all orders are
linear in how many documents have which mask, so the corpus is read once. For each part the histogram
has three rows of 2**5 counts: all documents, good ones and toxic ones. Integer matrices of 32 rows
and 600 columns (120 orders of five steps) turn those rows into what a step keeps and removes, what it
would remove had an earlier step not done so, and what it alone can remove; `outcomes` multiplies
them for a batch of parts at a time, so parts are dealt over the cluster like any other rows.

A text that a smaller doc_id has as well fails E. Texts go by their SHA-256, so only short rows are
shuffled: equal rows are counted together, the least doc_id of a text is an aggregate, and who holds it
is a join by text and doc_id, in which the copies of one text lie in as many tasks as they have ids.

Defined cases: a null text is empty, so is a part that is null. A null doc_id is smaller or larger than
none: its row never fails E, nor makes another fail; it has no labels. Rows with equal doc_id and text
are documents of their own, of which none makes the other fail E. Several labels of a doc_id: it is
good if one says quality 1, toxic if one says toxic 1. A part without documents has no rows, an empty
table none at all. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Words are runs of other characters than these.
BLANK = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
OUTCOMES = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def failures(text: Column) -> dict[str, Column]:
    """The filters that look at the text alone, each true if it fails the text."""
    words = F.array_remove(F.split(text, BLANK), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def histogram(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask, and how many documents, good and toxic ones have it (n, good, toxic)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures(text).values())]
    # Rows without a doc_id are dealt by their text in the joins, and meet nothing.
    rows = docs.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col("doc_id").cast("long").alias("id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        sum(bits[1:], bits[0]).alias("mask"),
    )
    rows = rows.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    firsts = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    rows = rows.join(firsts, ["id", "digest"], "left")
    rows = rows.withColumn("mask", F.col("mask") + F.when(F.col("first") | F.col("id").isNull(), 0).otherwise(1 << 4))

    said = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = said.where("id is not null").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumn("lot", F.lit(0))
    lot = F.when(F.col("id").isNull(), 1 + F.pmod(F.xxhash64("digest", "part"), 4096)).otherwise(0).cast("int")
    rows = rows.withColumn("lot", lot).withColumn("id", F.coalesce("id", F.lit(0))).join(said, ["id", "lot"], "left")
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def matrices(filters: int = len(FILTERS)) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """All orders, and of each outcome the matrix of masks x (order, step)."""
    orders = list(permutations(range(filters)))
    masks = np.arange(1 << filters)
    shape = (len(masks), len(orders), filters)
    found = {c: np.zeros(shape, dtype=np.int64) for c in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    removed_by = np.zeros((len(masks), filters), dtype=np.int64)
    for o, order in enumerate(orders):
        passed = np.ones(len(masks), dtype=bool)
        for s, f in enumerate(order):
            fails = masks >> f & 1 == 1
            found["removed"][:, o, s] = passed & fails
            found["redundant"][:, o, s] = ~passed & fails
            found["unique_fails"][:, o, s] = masks == 1 << f
            removed_by[:, f] += passed & fails
            passed = passed & ~fails
            found["kept"][:, o, s] = passed
    for o, order in enumerate(orders):
        found["shapley"][:, o, :] = removed_by[:, order]
    return orders, {c: m.reshape(len(masks), -1) for c, m in found.items()}


#: Parts whose rows are held at once: 600 rows each.
PARTS_AT_ONCE = 16


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders, m = matrices()
    names = np.array(["".join(FILTERS[f] for f in order) for order in orders]).repeat(len(FILTERS))
    steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders))
    for whole in batches:
        for at in range(0, whole.num_rows, PARTS_AT_ONCE):
            batch = whole.slice(at, PARTS_AT_ONCE)
            h = np.zeros((3, batch.num_rows, 1 << len(FILTERS)), dtype=np.int64)
            for i, cells in enumerate(batch.column("cells").to_pylist()):
                for c in cells:
                    h[:, i, c["mask"]] = c["n"], c["good"], c["toxic"]
            n, good, toxic = h
            made = {c: n @ m[c] for c in m} | {"good_lost": good @ m["removed"], "toxic_lost": toxic @ m["removed"]}
            parts = np.array(batch.column("part").to_pylist(), dtype=object).repeat(len(names))
            columns = [parts, np.tile(names, batch.num_rows), np.tile(steps, batch.num_rows), *[made[c].ravel() for c in COUNTS]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "filter_order", "step", *COUNTS])


def outcomes(histogram: DataFrame) -> DataFrame:
    """The outcomes of all orders from a histogram: at most 32 cells of a part come together."""
    parts = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(_multiplied, OUTCOMES)


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row for each part, order and step, zeros included."""
    return outcomes(histogram(docs, labels, part))


SQL = r"""
with docs as (
  select coalesce(source, '') as part, doc_id, coalesce(text, '') as text from documents
), firsts as (
  select text, min(doc_id) as first_id from docs group by text
), words as (
  select d.*, list_filter(string_split_regex(d.text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, coalesce(d.doc_id > f.first_id, false) as e
  from docs d join firsts f on d.text = f.text
), said as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), masks as (
  select w.part, coalesce(s.good, 0) as good, coalesce(s.toxic, 0) as toxic,
    (case when len(ws) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 2 else 0 end)
    + (case when 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text) then 4 else 0 end)
    + (case when regexp_matches(w.text, '[#$%&*|]') then 8 else 0 end) + (case when e then 16 else 0 end) as mask
  from words w left join said s on w.doc_id = s.doc_id
), cells as (
  select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from masks group by part, mask
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit
), orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a, letters b, letters c, letters d, letters e
  where b.f <> a.f and c.f not in (a.f, b.f) and d.f not in (a.f, b.f, c.f) and e.f not in (a.f, b.f, c.f, d.f)
), steps as (
  select filter_order, s.step, bits[s.step] as own, list_sum(bits[1:s.step]) - bits[s.step] as before
  from orders, (select unnest([1, 2, 3, 4, 5]) as step) s
), shares as (
  select c.part, s.own, sum(case when c.mask & s.own > 0 and c.mask & s.before::bigint = 0 then n else 0 end) as shapley from cells c, steps s group by c.part, s.own
)
select c.part, s.filter_order, s.step::int as step,
  sum(case when c.mask & (s.own + s.before)::bigint = 0 then n else 0 end)::bigint as kept,
  sum(case when c.mask & s.own > 0 and c.mask & s.before::bigint = 0 then n else 0 end)::bigint as removed,
  sum(case when c.mask & s.own > 0 and c.mask & s.before::bigint > 0 then n else 0 end)::bigint as redundant,
  sum(case when c.mask = s.own then n else 0 end)::bigint as unique_fails,
  sum(case when c.mask & s.own > 0 and c.mask & s.before::bigint = 0 then good else 0 end)::bigint as good_lost,
  sum(case when c.mask & s.own > 0 and c.mask & s.before::bigint = 0 then toxic else 0 end)::bigint as toxic_lost,
  any_value(h.shapley)::bigint as shapley
from cells c, steps s, shares h where h.part = c.part and h.own = s.own
group by c.part, s.filter_order, s.step
"""
