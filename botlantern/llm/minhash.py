"""Near-duplicate documents by fast similarity sketching, banding and verification on full sets.

A document's set is its distinct word shingles. Its sketch has `COORDINATES` coordinates: in round
i each shingle is hashed to a bin and a value i + v; the bin keeps the least. The first t rounds
throw into random bins, t more throw everything into bin i - t, so every coordinate is filled, and
most documents stop after a few rounds. The share of equal coordinates estimates the Jaccard
similarity with the concentration of independent minima.

`BANDS` bands of `ROWS` coordinates give candidates: at similarity 0.8 a pair shares no band with
probability (1 - 0.8**5)**36, about 6e-7. Nothing is capped. Equal sets are one class first. Then,
without emitting the pairs of a bucket:

1. each bucket's most central class (the one with the most company over all its buckets) leads it;
   a group is dealt in blocks of bounded size, each with the leader, and members are verified
   against it on full sets: rows in proportion to members;
2. members that a leader does not resolve are compared with the other members of its group, in
   the same task if the group is one block, else by pairs of blocks, as products of incidence
   matrices. Members already linked to the leader are not compared among each other. Any pair that
   shares a bucket shares its leader, so every candidate pair is either verified or already connected.

What travels for a comparison is the text of one document of each class, not its set, which is
several times larger; tasks make the sets anew. Sets are of 64-bit hashes of shingles, classes go by
128-bit digests of sets, and their texts are found by 96 bits of hash.

Components come from distributed star rounds; no link, set or component reaches the driver.

Defined cases: null, empty or blank texts have an empty set, link with nothing and stand alone.
Rows with a null doc_id are linked by their text; they never name a component unless all its ids
are null (then it is null), and are not kept. Rows that repeat a doc_id are each judged by their
text; all that bear the component's smallest id are kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Words, bit_filter, byte_slices, mix, passing, pieces, runs, shingle_hashes, small_batches, stored
from .components import block_pairs, connected_components, led_groups, matrix_labels

ROWS = 5
BANDS = 36
COORDINATES = ROWS * BANDS
#: Members and shingles of one block at most, as far as hashing deals them evenly.
BLOCK_MEMBERS = 512
BLOCK_SHINGLES = 1_000_000

_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
_LOW = _U(0xFFFFFFFF)


def similarity_sketches(items: np.ndarray, owner: np.ndarray, owners: int, t: int = COORDINATES) -> np.ndarray:
    """The sketches, owners x t, of sets given as hashes and the index of each hash's set."""
    sketch = np.full(owners * t, _EMPTY, dtype=np.uint64)
    rows = sketch.reshape(owners, t)
    live = np.unique(owner)
    for i in range(2 * t):
        if not len(items):
            break
        h = mix(items + _U((i + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        bins = (((h >> _U(32)) * _U(t)) >> _U(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(sketch, owner * t + bins, (h & _LOW) | _U(i << 32))
        full = (rows[live] != _EMPTY).all(axis=1)
        if full.any():
            done = np.zeros(owners, dtype=bool)
            done[live[full]] = True
            keep = ~done[owner]
            items, owner, live = items[keep], owner[keep], live[~full]
    return rows


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(sketch), axis=0)
    for r in range(rows):
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + sketch[:, r::rows][:, :bands])
    return keys


def _word_sets(texts: list[bytes], k: int) -> Iterator[tuple[int, list[np.ndarray], list[bytes | None]]]:
    """Runs of texts: the first one's index, their sets as sorted hashes, and a digest of each set."""
    for lo, run in pieces(texts):
        words = Words(run, NOT_SPACE)
        sets = [np.unique(shingle_hashes(words.hashes[a:b], k)) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        yield lo, sets, [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets, digests in _word_sets(byte_slices(batch.column(0)), k):
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                owner = np.repeat(np.arange(len(sets)), sizes)
                keys = band_keys(similarity_sketches(np.concatenate(sets), owner, len(sets))).view(np.int64)
                some = sizes > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                marks = [int.from_bytes(d[:8], "little", signed=True) if d else 0 for d in digests]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, len(sets)) for i in (1, 2, 3)), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(marks, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel()))],
                    names=["doc_id", "text_hash", "text_mark", "n_shingles", "set_key", "mark", "keys"],
                )

    return run


#: What a compared pair is: a link; in a group of several blocks, a member that is linked to its leader,
#: one that may be linked to such a member, and one that may be linked only to others that are not.
LINK, TIED, NEAR, FAR = 0, 1, 2, 3
_FOUND = "a long, b long, state int"


def _found(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["a", "b", "state"])


def _links(sets: list[np.ndarray], tied: np.ndarray, block: np.ndarray | None, percent: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links among the sets, save those between two that are tied.

    If `block` is given, only between sets of different blocks.
    """
    sizes = np.array([len(s) for s in sets])
    _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # A set can only reach the bar through shingles that another set has.
    common = counts[codes] > 1
    able = 100 * np.bincount(owner[common], minlength=len(sets)) >= percent * sizes
    use = common & able[owner]
    if able.sum() < 2 or not use.any():
        return
    where = np.cumsum(able) - 1
    members = np.flatnonzero(able)
    owner, (_, codes) = where[owner[use]], np.unique(codes[use], return_inverse=True)
    order = np.argsort(codes, kind="stable")
    owner, codes = owner[order], codes[order]
    n = len(members)
    shared = np.zeros((n, n), dtype=np.float32)
    width = min(4096, int(codes[-1]) + 1)
    for c in range(0, int(codes[-1]) + 1, width):
        lo, hi = np.searchsorted(codes, [c, c + width])
        part = np.zeros((n, width), dtype=np.float32)
        part[owner[lo:hi], codes[lo:hi] - c] = 1
        shared += part @ part.T
    shared = np.rint(shared).astype(np.int64)
    s = sizes[members]
    linked = 100 * shared >= percent * (s[:, None] + s[None, :] - shared)
    t = tied[members]
    linked &= ~(t[:, None] & t[None, :])
    if block is not None:
        linked &= block[members][:, None] != block[members][None, :]
    np.fill_diagonal(linked, False)
    labels = matrix_labels(linked)
    for far in np.flatnonzero(labels != np.arange(n)):
        yield members[far], members[labels[far]]


def _verify_blocks(k: int, percent: int):
    """Members (leader, block, c, blocks, text) against their leader, and in a group of one block against each other."""
    # By the triangle inequality of the Jaccard distance, only a member within twice the allowed
    # distance of the leader can link with one that the leader is linked to.
    reach = 2 * percent - 100

    def rows_of(batch: pa.RecordBatch) -> list[tuple]:
        sets = [s for _, own, _ in _word_sets(byte_slices(batch.column(4)), k) for s in own]
        return list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), sets, strict=True))

    def judged(leader: int, rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        head = next(s for c, _, s in rows if c == leader)
        rows = [r for r in rows if r[0] != leader]
        ids, sets, single = [r[0] for r in rows], [r[2] for r in rows], rows and rows[0][1] == 1
        sizes = np.array([len(s) for s in sets])
        both = np.array([len(np.intersect1d(head, s, assume_unique=True)) if 100 * min(len(head), len(s)) >= reach * max(len(head), len(s)) else 0 for s in sets])
        either = sizes + len(head) - both
        linked, near = 100 * both >= percent * either, 100 * both >= reach * either
        for c, tie, close in zip(ids, linked.tolist(), near.tolist(), strict=True):
            if not single:
                yield leader, c, TIED if tie else NEAR if close else FAR
            elif tie:
                yield leader, c, LINK
        if single and ((~linked).sum() > 1 or (near & ~linked).any() and linked.any()):
            use = np.flatnonzero(~linked | (near & ~linked).any())
            for a, b in _links([sets[i] for i in use], linked[use], None, percent):
                yield ids[use[a]], ids[use[b]], LINK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for (leader, _), rows in runs(batches, 2, rows_of):
            out.extend(judged(leader, rows))
            if len(out) > 10_000:
                yield _found(out)
                out = []
        if out:
            yield _found(out)

    return run


def _compare_blocks(k: int, percent: int):
    """Members (leader, lo, hi, block, c, state, text) of two blocks, or of one, against each other."""

    def rows_of(batch: pa.RecordBatch) -> list[tuple]:
        sets = [s for _, own, _ in _word_sets(byte_slices(batch.column(6)), k) for s in own]
        return list(zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), sets, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lo, hi), rows in runs(batches, 3, rows_of):
            block, ids, states, sets = zip(*rows, strict=True)
            tied = np.array(states) == TIED
            if out := [(ids[a], ids[b], LINK) for a, b in _links(list(sets), tied, np.array(block) if lo != hi else None, percent)]:
                yield _found(out)

    return run


def _texts(docs: DataFrame, *more) -> DataFrame:
    """Texts with 96 bits of hash."""
    text = F.col("text").cast("string")
    return docs.select(text.alias("text"), *more, F.xxhash64(text).alias("text_hash"), F.hash(text).alias("text_mark"))


def _grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows' stored features, and set_key, root and smallest (id) of each class of equal sets."""
    small_batches(docs.sparkSession)
    made = _texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_features(k), "doc_id long, text_hash long, text_mark int, n_shingles long, set_key binary, mark long, keys array<long>")
    features = stored(made.withColumn("row", F.monotonically_increasing_id()), "minhash")

    # A class of equal sets goes by the row of one of its documents.
    filled = features.where("n_shingles > 0")
    first = F.min(F.struct("row", "text_hash", "text_mark")).alias("first")
    classes = filled.groupBy("set_key").agg(first, F.min("doc_id").alias("smallest"), F.min("n_shingles").alias("n"))
    classes = stored(classes.select("set_key", F.col("first.row").alias("c"), "first.text_hash", "first.text_mark", "smallest", "n"), "classes")

    spokes = stored(led_groups(filled.select("row", "mark", "keys"), classes), "spokes")
    groups = spokes.join(classes.select("c", "n"), "c").groupBy("leader").agg(F.count("*").alias("all"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("all") / BLOCK_MEMBERS, F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    groups = stored(groups.select("leader", blocks.alias("blocks")), "groups")
    dealt = spokes.join(groups, "leader").select("leader", F.pmod(F.xxhash64("c"), "blocks").alias("block"), "c", "blocks")
    heads = groups.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("leader").alias("c"), "blocks")

    # One text of each class that has company, in one more pass over the documents.
    wanted = spokes.select("c").union(groups.select("leader")).distinct()
    wanted = stored(classes.select("c", "text_hash", "text_mark").join(wanted, "c", "left_semi"), "wanted")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.col("text_hash").alias("hash"))))
    texts = _texts(docs).where(passing(F.col("text_hash"), bits)).groupBy("text_hash", "text_mark").agg(F.first("text").alias("text"))
    texts = stored(texts.join(wanted, ["text_hash", "text_mark"]).select("c", "text"), "texts")

    whole = dealt.unionByName(heads).join(texts, "c").select("leader", "block", "c", "blocks", "text")
    star = stored(whole.repartition("leader", "block").sortWithinPartitions("leader", "block").mapInArrow(_verify_blocks(k, percent), _FOUND), "star")

    # Groups of several blocks with members that their leader does not settle.
    open_ = star.where(F.col("state") != LINK).groupBy("a").agg(F.count("*").alias("all"), F.count_if(F.col("state") > TIED).alias("open"), F.count_if(F.col("state") == NEAR).alias("near"))
    open_ = open_.where("open > 1 or (near > 0 and all > open)").select("a", "near").join(groups.withColumnRenamed("leader", "a"), "a")
    unresolved = star.where(F.col("state") != LINK).join(open_, "a").where((F.col("state") > TIED) | (F.col("near") > 0)).select(F.col("a").alias("leader"), F.col("b").alias("c"), "state", "blocks")
    pairs = block_pairs(unresolved, ["leader"], "c", "blocks").join(texts, "c").select("leader", "lo", "hi", "block", "c", "state", "text")
    more = pairs.repartition("leader", "lo", "hi").sortWithinPartitions("leader", "lo", "hi").mapInArrow(_compare_blocks(k, percent), _FOUND)

    roots = connected_components(star.where(F.col("state") <= TIED).unionByName(more).select("a", "b"))
    rooted = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    return features, rooted.select("set_key", "root", "smallest")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Each document with its component: doc_id, text_hash, n_shingles, component_id, kept.

    `k` words make a shingle; pairs whose Jaccard similarity is `percent` hundredths or more link.
    """
    features, rooted = _grouped(docs, k, percent)
    named = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    by_set = rooted.join(named, "root").select("set_key", "component_id")

    found = features.where("n_shingles > 0").select("doc_id", "text_hash", "n_shingles", "set_key").join(by_set, "set_key").drop("set_key")
    alone = features.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def surplus(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """What is to go so that one row of each component stays: doc_id, text_hash, first, rows.

    The first of a component has its smallest id (null only if all are) and of that id's texts the
    least text_hash. All rows of a pair (doc_id, text_hash) that is not `first` go; of one that is,
    all but one. Pairs that are `first` and borne by one row are left out, as are empty sets.
    """
    features, rooted = _grouped(docs, k, percent)
    filled = features.where("n_shingles > 0").select("doc_id", "text_hash", "set_key")
    pair = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    pairs = filled.groupBy("set_key", "doc_id", "text_hash").agg(F.count("*").alias("rows")).join(rooted.select("set_key", "root"), "set_key").select("root", "doc_id", "text_hash", "rows")
    pairs = stored(pairs, "members")
    firsts = pairs.groupBy("root").agg(F.min(pair).alias("least"))
    same = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    judged = pairs.join(firsts, "root").withColumn("first", same)
    return judged.where("not first or rows > 1").select("doc_id", "text_hash", "first", "rows")


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    """The contract's shingles have four words."""
    return near_duplicates(docs, k=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM w WHERE len(w) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS MATERIALIZED (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
  ) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.both >= 80 * (na.n + nb.n - p.both)
), edge AS MATERIALIZED (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""
