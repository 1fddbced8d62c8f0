import hashlib
import re

from botlantern.llm.decontam import benchmark_occurrences, contamination, contamination_digest

PATTERN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= owners
        joined = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc_id, len(w), len(hit), len(found - {None}), hashlib.sha256(joined.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_against_brute_force(spark, texts, docs):
    w = words(texts[2]) + words(texts[4])
    items = [(1, " ".join(w[:20])), (2, " ".join(w[5:16])), (10, "one two"), (11, "ONE,two"), (12, ""), (None, "là"), (13, None), (7, texts[5]), (8, "the"), (9, "no such words at all here")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS window")
    got = contamination_digest(docs, benchmark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, items)
    spans = benchmark_occurrences(docs, benchmark).where("doc_id = 2").collect()
    assert all(" ".join(words(texts[2])[s.start : s.start + s.size]) == s.window for s in spans)


def test_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(no_docs, none).count() == 0
    clean = contamination(docs, none).collect()
    assert len(clean) == docs.count() and not any(r.contaminated or r.n_hit or r["items"] for r in clean)
