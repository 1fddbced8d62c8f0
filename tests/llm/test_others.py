import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from botlantern.llm import embeddings, language
from botlantern.llm.chat import chat_digest, format_conversations, read_conversations
from botlantern.llm.chat_template import TemplateError, compile_template, fold, parse, unescape
from botlantern.llm.embeddings import near_duplicate_vectors
from botlantern.llm.extraction import extraction_digest, main_text
from botlantern.llm.language import Model, fit, identify, language_digest
from botlantern.llm.licenses import BASE, MORE, Scanner, license_digest, scan_licenses
from botlantern.llm.sharding import kd_shards, shard_digest, with_slots

# --- sharding -----------------------------------------------------------------------------


def test_shards_are_near_equal_and_slots_gapless(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), "x" * int(rng.integers(0, 400)) + str(i % 700), ["en", "fr", None][i % 3], f"src{i % 5}", i) for i in range(2000)]
    rows += [(5000 + i, "the hot text " * 20, "en", "src1", 1) for i in range(700)] + [(None, None, None, None, None), (7, "seven", "en", "src0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("unit", F.lit(1))
    got = shard_digest(docs).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    total = sum(r.size for r in got)
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) < 0.1 * total / 8
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert sorted((r.size, r.text_crc32) for r in got) == want
    cold = {}
    for r in got:
        if r.text_crc32 != zlib.crc32(("the hot text " * 20).encode()):
            cold.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(x) == 1 for x in cold.values())


def test_hot_copies_without_distinct_ids_are_split(spark):
    for own in (None, 7):
        rows = [(i, f"text {i} " + "x" * 40) for i in range(1200)] + [(own, "the hot text " * 10)] * 600
        got = shard_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
        sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
        assert len(got) == 1800 and max(sizes) - min(sizes) < 0.15 * sum(sizes) / 8
        assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(8))


def test_shards_of_odd_numbers_and_empty_tables(spark, no_docs):
    assert shard_digest(no_docs).count() == 0
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), 50).alias("text")).withColumn("text", F.concat("text", "doc_id"))
    sizes = [r.n for r in kd_shards(docs, 3).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 3 and max(sizes) < 1.1 * min(sizes)
    one = with_slots(kd_shards(docs, 1), "shard", ["doc_id"]).collect()
    assert [r.slot for r in sorted(one, key=lambda r: r.doc_id)] == list(range(300))


# --- embeddings ---------------------------------------------------------------------------


@pytest.mark.parametrize("block", [512, 8])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK_MEMBERS", block)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(12):
        centre = rng.normal(size=32)
        for _ in range(int(rng.integers(1, 30))):
            noise = rng.normal(size=32) * rng.choice([0.0, 0.05, 0.12, 0.2])
            rows.append((len(rows), [float(x) for x in (centre + noise) * rng.choice([1, 3])], int(i % 3)))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 32, 1), (n + 2, [1.0] * 31 + [None], 1), (n + 3, [1.0] * 31 + [float("nan")], 1), (n + 4, rows[0][1], None), (n + 5, [1.0, 2.0], 0), (n + 6, [2.0, 4.0], 0), (n + 7, [], 0), (n + 8, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, row int")

    def unit(v):
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        return np.array(v) / np.linalg.norm(v) if ok else None

    units = [unit(v) for _, v, _ in rows]
    links = {r[0]: set() for r in rows}
    for i, (a, _, la) in enumerate(rows):
        for j in range(i):
            b, _, lb = rows[j]
            if la is not None and la == lb and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= 0.98:
                links[a].add(b)
                links[b].add(a)

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    want = sorted((i, len(x), least(i), i == least(i)) for i, x in links.items())
    assert sorted(map(tuple, near_duplicate_vectors(df).collect())) == want
    assert near_duplicate_vectors(df.limit(0)).count() == 0


# --- extraction ---------------------------------------------------------------------------

LONG = "A paragraph of some length, with commas, that tells the reader of the tide, the mast, and the stone."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>Only &amp; text&nbsp;here", "Only & text here"),
        (f"<nav><a href=x>Home</a></nav><div class=ad>Buy, buy, buy</div><article><h1>T</h1><p><b>{LONG}<br><p>Two.</article><footer>&copy;</footer>", f"T\n\n{LONG}\n\nTwo."),
        (f"<header><h1>Site</h1></header><div id=main><div class='sidebar'><p>{LONG}</p></div><div class='post-content'><h2>T</h2><p>{LONG}</p><p>Short.</p><ul><li>a</li><li>b</li></ul><p>{LONG}</p></div><div id=comments><p>{LONG} {LONG} {LONG}</p></div></div>", f"T\n\n{LONG}\n\nShort.\n\na\n\nb\n\n{LONG}"),
        (f"<script>var x='<p>no</p>'</script><style>p{{}}</style><main><section><p>{LONG}</p></section><section><p>{LONG}</p></section></main><form>Name <input><button>Go</button></form>", f"{LONG}\n\n{LONG}"),
        (f"<div><p>{LONG}</p><p>It ends <a href='x'>here</a>, or there</p></div><div class='cookie-notice'>We use cookies</div><aside>{LONG}</aside>", f"{LONG}\n\nIt ends here, or there"),
        (f"<article><p>{LONG}</p><table><tr><td>x<td>y</table></article><scri", f"{LONG}\n\nx\n\ny"),
        (f"<article><p>{LONG}</p><!-- <p>no</p> --><div hidden>no</div><p>1 < 2 &lt; 3</p></article>", f"{LONG}\n\n1 < 2 < 3"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class=post><h1>Title</h1><div class=text>{f'<p>{LONG}' * 10}</div><h2>More</h2><div><p>{LONG}</div></div>", "\n\n".join(["Title", *[LONG] * 10, "More", LONG])),
        (f"<nav><a href=x>Home</a></nav><div><h1>Title</h1></div><div>{f'<p>{LONG}' * 3}</div><section><h2>List</h2><ul><li>a<li>b</ul><table><tr><td>x</table><blockquote>Said.</blockquote></section><div class=sidebar>No</div>", "\n\n".join(["Title", *[LONG] * 3, "List", "a", "b", "x", "Said."])),
        (f"<div>Before it<div>{f'<p>{LONG}' * 3}</div><div><a href=x>Other page</a> <a href=y>and more</a></div><div class=comments><p>{LONG}</div></div><footer>F</footer>", "\n\n".join(["Before it", *[LONG] * 3])),
    ],
)
def test_main_text_of_sections_without_an_article_element(page, text):
    assert main_text(page) == text


def test_extraction_of_a_table(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{LONG}é</p>", "t"), (None, None, None, "t"), (1, "u", "", "t")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extraction_digest(pages).collect()), key=str)
    assert got == sorted([(1, "u", LONG + "é", len(LONG) + 1), (None, None, "", 0), (1, "u", "", 0)], key=str)


# --- language -----------------------------------------------------------------------------


def test_code_lengths_against_a_plain_model():
    texts = {"x": ["abcabcabd", "aab"], "y": ["zzyx", "abc"]}
    counts = {}
    for lang, own in texts.items():
        grams, n = np.unique(language._grams(own)[0], return_counts=True)
        counts[lang] = (grams, n.astype(float))
    model = Model(counts)

    def plain(lang, text):
        seen = {}
        for t in texts[lang]:
            padded = language.PAD + t.encode()
            for i in range(3, len(padded)):
                for order in range(4):
                    c = seen.setdefault(padded[i - order : i], {})
                    c[padded[i]] = c.get(padded[i], 0) + 1
        bits, padded = 0.0, language.PAD + text.encode()
        for i in range(3, len(padded)):
            for order in (3, 2, 1, 0):
                c = seen.get(padded[i - order : i], {})
                total, distinct = sum(c.values()), len(c)
                if padded[i] in c:
                    bits -= np.log2(c[padded[i]] / (total + distinct))
                    break
                if c:
                    bits -= np.log2(distinct / (total + distinct))
            else:
                bits += 8
        return bits

    for text in ("abc", "abdzz", "qqq", "zzyxabcabc", "a"):
        assert np.allclose(model.bits([text, "other"])[0], [plain("x", text), plain("y", text)])


def test_held_out_accuracy_and_sources(spark):
    rng = np.random.default_rng(8)
    kinds = {"aa": "thondr einsa", "bb": "ñolque cióda", "cc": "schür ungkeit"}
    rows = []
    for i in range(300):
        lang = list(kinds)[i % 3]
        rows.append((i, "".join(rng.choice(list(kinds[lang]), size=80)), lang))
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (None, "ñolque ñolque", None), (1003, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = {r.doc_id: r for r in language_digest(docs).collect()}
    assert len(got) == len(rows)
    for i, _, lang in rows[:300]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].lang_pred == lang and 0 <= got[i].score <= 1
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert got[None].lang_pred == "bb" and got[1003].lang_pred in kinds
    flipped = docs.withColumn("lang", F.when(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), "zz").otherwise(F.col("lang")))
    assert {r.lang_pred for r in language_digest(flipped).collect()} <= {*kinds, "und"}
    nothing = identify(docs, fit(docs.where("lang is null")))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}
    assert language_digest(docs.limit(0)).count() == 0


def test_languages_with_long_documents_only_are_learnt(spark):
    rows = [(2 * i, "thondr einsa " * (200 + i), "long") for i in range(20)] + [(2 * i + 1, "ñolque cióda", "short") for i in range(40)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (100, 10):
        model = fit(docs, rows=8, most_bytes=most)
        assert model.langs == ["long", "short"]
        assert {(r.doc_id % 2, r.lang_pred) for r in identify(docs, model).collect()} == {(0, "long"), (1, "short")}


def test_many_labels_share_one_bound(spark, monkeypatch):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q " * 40, f"l{i:03}") for i in range(400)] + [(1000 + i, "common words here", "many") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~language.held_out(F.col("doc_id")))
    few = fit(docs, labels=5)
    assert len(few.langs) == 5 and "many" in few.langs
    # Each has one document, longer than its share, and the shortest of them fit the other total.
    some = fit(docs, total=1600)
    assert 10 <= len(some.langs) <= 14 and "many" in some.langs
    model = fit(docs)
    assert len(model.langs) == docs.select("lang").distinct().count()
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, model).collect()}
    monkeypatch.setattr(language, "TABLE", 0)
    long_way = fit(docs)
    assert len(long_way.known) == 0 and {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, long_way).collect()} == got


def test_a_model_of_five_hundred_labels_is_bounded():
    import pickle

    rng = np.random.default_rng(3)
    size = language.SAMPLE_TOTAL // 500
    counts = {f"l{i}": (np.unique(rng.integers(0, 1 << 32, size, dtype=np.uint32)), np.ones(size)) for i in range(500)}
    counts = {k: (g, n[: len(g)]) for k, (g, n) in counts.items()}
    start = time.perf_counter()
    model = Model(counts)
    assert time.perf_counter() - start < 60 and len(pickle.dumps(model)) < 500 << 20
    assert model.bits(["some text", "x"]).shape == (2, 500)


def test_unknown_languages(spark):
    texts = ["the tide and the mast " * 5, "the mast", "x", None, "", "12 %", "日本語テキストです" * 20, "qzx jqw vkq xzj " * 30]
    docs = spark.createDataFrame([(1, texts[0] * 50, "en")] + [(None, t, None) for t in texts], "doc_id long, text string, lang string")
    model = fit(docs)
    found = docs.where("doc_id is null").withColumn("f", language.predicted(F.col("text"), model))
    got = {r.text: r.u for r in found.withColumn("u", language.unknown(F.col("text"), F.col("f"))).collect()}
    assert [got[t] for t in texts[:3]] == [False] * 3 and all(got[t] or got[t] is None for t in texts[3:7])


# --- licences -----------------------------------------------------------------------------


def plain_scan(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label, _ in BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_base_places_against_a_plain_scan(spark):
    texts = ["Under the MIT License. x", "", None, "cc by nc cc-by-nc, CC BY\nNC!", "Licensed under the Apache License, Version 2.0.", "under the mit license under the mit license", "mcc by nc", "xunder the mit license", "cc by ncx", "tide " * 500 + "cc by nc", "apache license version 20", "licensed under the mit licence"]
    docs = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in license_digest(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.score == 1 or not r.n_base
    assert got[11].labels == "mit" and got[11].base_labels == "" and 0.9 < got[11].score < 1
    spans = scan_licenses(docs).where("doc_id = 11").first().spans
    assert [(s.first_word, s.last_word, s.edits, s.matched) for s in spans] == [(1, 4, 1, "under the mit licence")]
    assert license_digest(docs.limit(0)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_labels(text, notices):
    """Every run of words against every notice: label -> least edits."""
    words = text.split()
    want = {}
    for p, label, telling in notices:
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                run = " ".join(words[i:j])
                if abs(len(run) - len(p)) > len(p) // 8:
                    continue
                n = edit_distance(run, p)
                tells = all(min(edit_distance(t, w) for w in words[i:j]) <= (len(t) >= 5) for t in telling.split())
                if n <= len(p) // 8 and tells:
                    want[label] = min(n, want.get(label, 99))
    return want


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("under the mit licenses", {"mit"}),
        ("xunder the mit license", {"mit"}),
        ("under the mint license", set()),
        ("apache license version 20", set()),
        ("apache license version 1", {"apache-1"}),
        ("apache license version 3", set()),
        ("apple license version 2", set()),
        ("apachee licence version 2", {"apache-2"}),
        ("cc by nd", {"cc-by-nd"}),
        ("cc by nd xcc by nc", {"cc-by-nd"}),
        ("cc by nd cc by nc", {"cc-by-nd", "cc-by-nc"}),
        ("under the mit licence xunder the mit license", {"mit"}),
        ("gnu general public licence version 3", {"gpl-3"}),
        ("gnu lesser general public license version 3", {"lgpl-3"}),
        ("gnu general public license version 4", set()),
        ("gnu general public license v3 0", {"gpl-3"}),
        ("licensed under the apache license 2 0", {"apache-2"}),
        ("apache license v2", {"apache-2"}),
        ("the 3 clause bsd license", {"bsd-3-clause"}),
        ("gpl v2 or later", {"gpl-2"}),
        ("permission is hereby granted free of charge to any person obtaining a copy", {"mit"}),
        ("cc by nc sa 4 0", {"cc-by-nc", "cc-by-nc-sa"}),
        ("cc by nc nd", {"cc-by-nc", "cc-by-nc-nd"}),
    ],
)
def test_edits_never_change_what_tells_a_notice(text, labels):
    for line in (text, f"tide {text} mast"):
        assert {s[0] for s in Scanner().scan(line.encode())[1]} == labels == set(plain_labels(line, BASE + MORE))


def test_edits_against_all_runs_of_words():
    rng = np.random.default_rng(8)
    scanner = Scanner()
    notices = BASE + MORE[:6]
    for _ in range(100):
        parts = []
        for at in rng.integers(0, len(notices), 2):
            chars = list(notices[at].text)
            for _ in range(int(rng.integers(0, 4))):
                at = int(rng.choice([0, len(chars) - 1, rng.integers(0, len(chars))]))
                chars[at : at + int(rng.integers(0, 2))] = [["q"], [], ["c", " "]][int(rng.integers(0, 3))]
            parts += ["".join(chars), str(rng.choice(["tide", "", "license the", "cc"]))]
        words = " ".join(parts).split()
        got = {}
        for label, _, first, last, edits, matched in scanner.scan(" ".join(words).encode())[1]:
            assert matched == " ".join(words[first : last + 1])
            got[label] = min(edits, got.get(label, 99))
        assert got == plain_labels(" ".join(words), BASE + MORE)


def test_long_repeats_take_time_in_proportion():
    for notice in ("under the mit licence ", "cc by nd ", "gnu general public license version 3 ", "license "):
        start = time.perf_counter()
        n, spans = Scanner().scan((notice * (1_000_000 // len(notice))).encode())
        assert n == len(notice.split()) * (1_000_000 // len(notice)) and (spans or notice == "license ")
        assert time.perf_counter() - start < 40
    for notice in ("free and unencumbered software released into public domain the ", max((n.text for n in MORE), key=len) + " ", "redistribution use and in source and binary forms "):
        start = time.perf_counter()
        Scanner().scan((notice * (1_000_000 // len(notice))).encode())
        assert time.perf_counter() - start < 10


# --- chat ---------------------------------------------------------------------------------

HARD = ["plain", "", None, r"\### Assistant: </turn> ok", "####", "a\\", "</turn>\n### user: x</turn>", "\\\\###</</turn>", "日本\n"]


def test_a_very_long_text_reads_back(spark):
    text = "\\### </turn> é" * 150_000
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_digest(df).collect()}[1]
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


def test_conversations_read_back(spark):
    rows = [(1, 0, "user", HARD[0]), (1, 1, "assistant", HARD[3]), (1, 1, "assistant", HARD[3]), (1, None, "system", None), (None, 0, None, "x"), (2, 5, "a: b\n###", HARD[6]), (2, 6, "assistant", "")]
    rows += [(10 + i, j, ["user", "assistant"][j % 2], t) for i in range(3) for j, t in enumerate(HARD * (i + 1))] + [(99, j, "assistant", "word") for j in range(3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    got = {r.conv_id: r for r in chat_digest(df).collect()}
    rows += [(-7, 0, "user", HARD[3]), (-7, 1, "assistant", HARD[3])]
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
    parts = format_conversations(df).where("conv_id = 11").orderBy("place").collect()
    whole = "".join(p.formatted for p in parts)
    masked = [unescape(whole[s.start : s.end]) for p in parts for s in p.generated]
    assert "".join(masked) == "".join(t for _, r, t in by[11] if r == "assistant") and len(whole) == got[11].formatted_chars
    assert read_conversations(format_conversations(df.limit(0))).count() == 0


def test_a_long_message_is_read_in_little_memory():
    import tracemalloc

    from botlantern.llm.chat import _TURN

    text = "### user: " + ("tide <mast> " + "x" * 500 + r"\\n") * 40_000 + "</turn>\n"
    tracemalloc.start()
    m = _TURN.match(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert m.end() == len(text) > 20_000_000 and peak < 3 * len(text)
    assert not _TURN.match(text[:-3]) and not _TURN.match("### user: a")


def test_template_language():
    t = compile_template("{# c #}{% for m in ms %}{% if loop.first %}<{% elif m.a == 'x' and not m['b'] %}({% else %}-{% endif %}{{ m.a | upper ~ '!' }}{% if loop.last %}>{% endif %}{% endfor %}")
    text = "".join(p for p, _ in t(ms=[{"a": "x"}, {"a": "x"}, {"a": "y", "b": 1}]))
    assert text == "<X!(X!-Y!>"
    assert fold(parse("a{{ 'b' ~ 1 }}{% if 'x' == 'y' %}no{% elif true %}c{% else %}no{% endif %}")) == parse("ab1c")
    marks = list(compile_template("a{% generation %}b{{ x }}{% endgeneration %}c")(x="y"))
    assert marks == [("a", False), ("b", True), ("y", True), ("c", False)]
    for bad in ("{{ x.y() }}", "{% for x %}{% endfor %}", "{% if x %}", "{{ x | nothing }}", "{{ 'a' 'b' }}", "{% include 'x' %}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
    for bad in ("{{ y }}", "{{ x.upper }}", "{{ x.__class__ }}"):
        with pytest.raises(TemplateError):
            list(compile_template(bad)(x="text"))
