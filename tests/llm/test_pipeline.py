import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from botlantern.llm.common import tokenizer_path
from botlantern.llm.tokens import encoder

from .test_decontam import brute as contaminated
from .test_minhash import brute as duplicates


def plain_languages(rows):
    """Code lengths of a text, by order-3 contexts of the labelled rows that are not held out: {lang: bits}."""
    seen = {}
    for d, t, lang in dict.fromkeys(rows):
        if lang is not None and t and d is not None and zlib.crc32(str(d).encode()) % 5:
            raw, counts = b"\n\n\n" + t.lower().encode(), seen.setdefault(lang, {})
            for i in range(3, len(raw)):
                for order in range(4):
                    c = counts.setdefault(raw[i - order : i], {})
                    c[raw[i]] = c.get(raw[i], 0) + 1

    def bits(text, counts):
        total, raw = 0.0, b"\n\n\n" + text.lower().encode()
        for i in range(3, len(raw)):
            for order in (3, 2, 1, 0):
                if c := counts.get(raw[i - order : i]):
                    n = sum(c.values()) + len(c)
                    if raw[i] in c:
                        total -= np.log2(c[raw[i]] / n)
                        break
                    total -= np.log2(len(c) / n)
            else:
                total += 8
        return total

    return lambda text: {lang: bits(text, counts) for lang, counts in seen.items()}


def told(rows):
    """Rows whose text has a letter, and a code that is shorter than its bytes and 256 bits."""
    lengths = plain_languages(rows)
    return [(d, t) for d, t, _ in rows if any(c.isalpha() for c in t or "") and min(lengths(t).values()) <= 8 * len(t.encode()) + 256]


def test_the_language_stage_decides_by_its_model(spark, docs):
    noise = [(5000 + i, text, None) for i, text in enumerate(["".join(chr(0x4E00 + (i * 7919) % 9000) for i in range(400)), "\u0416\u0434\u043b " * 100])]
    clean = [(6000, "the heron and the lantern of the river", None), (6001, "Tide", "en")]
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()] + noise + clean
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.identify_language(spark, table, "").collect()
    want = told(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == sorted((d is None, d or 0, t) for d, t in want)
    kept = {r.doc_id for r in got}
    # The model decides: letters alone would keep these.
    assert not kept & {d for d, *_ in noise} and {6000, 6001} <= kept


def test_pipeline_against_plain_stages(spark, docs, tmp_path):
    labelled = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    rows = [(d, t) for d, t, _ in labelled]
    items = [(1, " ".join(rows[2][1].split()[:14])), (2, "no such words")]
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    left = told(labelled)
    kept = {d for d, _, _, k in duplicates(left, 5) if k}
    left = list(dict.fromkeys((d, t) for d, t in left if d in kept))  # of a repeated row one stays
    bad = {r[0] for r in contaminated(left, items) if r[-1]}
    left = [(d, t) for d, t in left if d not in bad]
    assert 1 < len({d for d, _ in left}) < len({d for d, _ in rows}) and bad
    ids = encoder(tokenizer_path("word_bpe_49k.json"), "word_level").whole([t for _, t in left])
    want = sorted((d, len(i) // 4 + 1) for (d, _), i in zip(left, ids, strict=True))
    pieces = {}
    for p in got:
        pieces.setdefault(p.doc_id, []).append(p)
    assert set(pieces) == {d for d, _ in want}
    for d, n in want:
        own = sum(p.length for p in pieces[d])
        assert own == n * [x for x, _ in want].count(d)
        if len(pieces[d]) == 1:
            raw = next(i for (x, _), i in zip(left, ids, strict=True) if x == d) + np.array([2], dtype="<u4").tobytes()
            assert pieces[d][0].ids_crc32 == zlib.crc32(raw)


def test_stages_keep_columns_and_take_empty_tables(spark, docs, no_docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for table in (docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, table, f"file://{tmp_path}")
            assert made.columns == table.columns
            made.count()


def test_language_stage_without_a_label_keeps_texts_with_letters(spark, docs):
    want = sorted(r.text for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    for table in (unlabelled, unlabelled.withColumn("lang", F.lit("en")).withColumn("doc_id", F.lit(None).cast("long"))):
        got = corpus_pipeline.identify_language(spark, table, "")
        assert got.columns == table.columns and sorted(r.text for r in got.collect()) == want


def test_one_row_of_each_group_stays_whatever_its_ids(spark):
    page, other, third = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    near = lambda t, i: f"{t} edit{i}"
    rows = [(None, near(page, i % 3), "x") for i in range(40)]
    rows += [(7, near(other, i % 2), "x") for i in range(30)] + [(9, other, "x"), (None, other, "x")]
    rows += [(1, third, "x"), (1, third, "y"), (None, third, "x"), (4, "alone here", "x"), (5, "", "x"), (None, None, "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    stay = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert stay.columns == docs.columns
    got = stay.collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "4", "5", "7", "None", "None", "None"]
    assert sum((r.text or "").startswith("a0 ") for r in got) == sum((r.text or "").startswith("b0 ") for r in got) == 1
    assert sum((r.text or "").startswith("c0 ") for r in got) == 1 and {"", None, "no id", "alone here"} < {r.text for r in got}
    again = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), "").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
