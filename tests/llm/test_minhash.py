import re

import numpy as np

from botlantern.llm import common, minhash
from botlantern.llm.components import connected_components, matrix_labels
from botlantern.llm.decontam import contamination
from botlantern.llm.minhash import near_duplicates, similarity_sketches


def shingles(t, k):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    out = [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
    return sorted([(d, n, c, d is not None and d == c) for d, n, c in out], key=str)


def test_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in (4, 5):
        got = near_duplicates(docs, k=k).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, k)


def test_dense_group_with_unresolved_members(spark, monkeypatch):
    """Copies of one text with few to many edits, so that no leader settles them all, in small blocks."""
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 8)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(len(words), size=i % 8, replace=False):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(words[:100] + [f"t{i % 5}"] * 4)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs, k=4).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4)


def test_texts_longer_than_a_piece(spark):
    long = [f"w{i}" for i in range(200_000)]
    near = ["edit" if i % 20_000 == 7 else w for i, w in enumerate(long)]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:90_000])), (4, "x" * 2_000_000), (5, "x" * 2_000_000 + " y")]
    assert len(rows[0][1]) > common.PIECE
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, k=4).collect()}
    assert got == {i: (len(shingles(t, 4)), 1 if i == 2 else i) for i, t in rows}
    items = spark.createDataFrame([(7, " ".join(long[150_000:150_020])), (8, "edit")], "item_id long, text string")
    hits = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in contamination(docs, items).collect()}
    assert hits == {1: (200_000, 20, ["7"]), 2: (200_000, 30, ["7", "8"]), 3: (90_000, 0, []), 4: (1, 0, []), 5: (2, 0, [])}


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_sketches_estimate_similarity_and_fill():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 2**63, 100).astype(np.uint64)])
    tiny = a[:1]
    s = similarity_sketches(np.concatenate([a, b, tiny]), np.repeat([0, 1, 2], [1000, 1000, 1]), 4, t=512)
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.08
    assert (s[:3] != np.uint64(2**64 - 1)).all() and (s[3] == np.uint64(2**64 - 1)).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    m = np.zeros((5, 5), dtype=bool)
    m[0, 3] = m[3, 0] = m[3, 4] = m[4, 3] = True
    assert matrix_labels(m).tolist() == [0, 1, 2, 0, 0]
