import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from botlantern.llm import token_store
from botlantern.llm.common import tokenizer_path
from botlantern.llm.packing import LevelPacker, pack_documents, packed_digest
from botlantern.llm.token_store import LEAST, MOST, _shift, _times, cut_points, merkle_root, read_store, token_digest, verify_store, write_store
from botlantern.llm.tokens import encoder

KINDS = [("byte_bpe_50k.json", "byte_level"), ("word_bpe_49k.json", "word_level")]


@pytest.mark.parametrize(("name", "kind"), KINDS)
@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=40), st.text(alphabet="ab Cé'stre  \n\t.,!1²½ªß’中\xa0\x85\x1c-—İΣς<|>́", max_size=40)))
def test_units_give_the_ids_of_whole_texts(name, kind, text):
    e = encoder(tokenizer_path(name), kind)
    assert e.encode([text]) == e.whole([text])


@pytest.mark.parametrize(("name", "kind"), KINDS)
def test_ids_are_those_of_the_library_as_loaded(name, kind):
    fresh, e = Tokenizer.from_file(tokenizer_path(name)), encoder(tokenizer_path(name), kind)
    for text in ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y", "日本 <|endoftext|>\n", "<|EndOfText|>", "<|endoftext |>", "a b"]:
        assert np.frombuffer(e.encode([text])[0], dtype="<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids


def _ids(kind, name, texts):
    return [np.append(np.frombuffer(x, dtype="<u4"), 2).astype("<u4") for x in encoder(tokenizer_path(name), kind).whole([t or "" for t in texts])]


def test_packing_holds_every_id_once_in_full_windows(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(zlib.crc32(i.tobytes()) for i in _ids("word_level", "word_bpe_49k.json", [t for _, t in rows]))
    pieces = pack_documents(docs, tokenizer_path("word_bpe_49k.json"), window=64).collect()
    by_window = {}
    for p in pieces:
        by_window.setdefault(p.sequence_id, []).append(p)
    for own in by_window.values():
        own.sort(key=lambda p: p.offset)
        sizes = [p.length for p in own]
        assert [p.offset for p in own] == [sum(sizes[:i]) for i in range(len(own))]
        assert sum(sizes) == 64 or sum(sizes).bit_count() == 1
    # Equal documents can't be told apart by id; their pieces can, by where they begin.
    single = {d for d, _ in rows if [x for x, _ in rows].count(d) == 1}
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for d in single:
        own = sorted(by_doc[d], key=lambda p: p.start)
        whole = b"".join(bytes(p.ids) for p in own)
        assert zlib.crc32(whole) in want and all(p.doc_tokens == len(whole) // 4 for p in own)
        assert [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
    assert sum(p.length for p in pieces) == sum(len(i) for i in _ids("word_level", "word_bpe_49k.json", [t for _, t in rows]))


@settings(max_examples=100, deadline=None)
@given(sizes=st.lists(st.integers(1, 40), max_size=80))
def test_level_packer(sizes):
    out = []
    packer = LevelPacker(16, out.append)
    for i, n in enumerate(sizes):
        packer.add(i, np.arange(n, dtype="<u4").tobytes())
        assert packer.counts.sum() == sum(map(len, packer.open.values())) and packer.counts[16] == 0
    packer.finish()
    totals = [sum(len(p[2]) for p in b) // 4 for b in out]
    assert all(t == 16 or t.bit_count() == 1 for t in totals) and sum(t < 16 for t in totals) <= 4
    ids = {}
    for b in out:
        for doc, start, raw, tokens in b:
            assert tokens == sizes[doc]
            ids.setdefault(doc, []).append((start, raw))
    assert {d: b"".join(r for _, r in sorted(x)) for d, x in ids.items()} == {i: np.arange(n, dtype="<u4").tobytes() for i, n in enumerate(sizes)}


def test_level_is_where_squares_grow_least():
    packer = LevelPacker(10, lambda b: None)
    rng = np.random.default_rng(2)
    for _ in range(300):
        size = int(rng.integers(1, 10))
        level, counts = packer.level_for(size), packer.counts.copy()

        def after(h, counts=counts, size=size):
            c = counts.copy()
            c[h] -= h > 0
            if h + size < 10:
                c[h + size] += 1
            return (c.astype(int) ** 2).sum()

        options = {h: after(h) for h in range(10 - size + 1) if h == 0 or counts[h]}
        assert options[level] == min(options.values())
        packer.add(0, np.zeros(size, dtype="<u4").tobytes())


def test_packing_of_an_empty_table(no_docs):
    assert packed_digest(no_docs).count() == 0


def test_store_round_trip(spark, docs, tmp_path):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    path = f"file://{tmp_path}/store"
    write_store(docs, path, tokenizer_path("byte_bpe_50k.json"))
    want = {}
    for (d, _), ids in zip(rows, _ids("byte_level", "byte_bpe_50k.json", [t for _, t in rows]), strict=True):
        want.setdefault(d, []).append(ids.tobytes())
    read = read_store(spark, path).orderBy("start").collect()
    got = {}
    for r in read:
        got.setdefault(r.doc_id, []).append(bytes(r.ids))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}
    assert [r.start for r in read] == [sum(q.n_tokens for q in read[:i]) for i in range(len(read))]
    order = [(-1 if r.doc_id is None else r.doc_id) for r in read]
    assert order == sorted(order)
    sums = {(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in read}
    assert {tuple(r) for r in verify_store(spark, path).collect()} == sums
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("key").distinct().count()
    manifest = spark.read.parquet(f"{path}/manifest").first()
    assert (manifest.documents, manifest.ids) == (len(rows), sum(r.n_tokens for r in read))
    assert manifest.chunks == chunks.count()


def test_a_changed_chunk_is_found(spark, docs, tmp_path):
    path = f"file://{tmp_path}/store"
    write_store(docs.where("doc_id < 3"), path, tokenizer_path("byte_bpe_50k.json"))
    chunks = spark.read.parquet(f"{path}/chunks").select("key", "n", "ids").collect()
    spoilt = [(chunks[0].key, chunks[0].n, chunks[1].ids), *[(c.key, c.n, c.ids) for c in chunks[1:]]]
    spark.createDataFrame(spoilt, "key binary, n long, ids binary").write.mode("overwrite").parquet(f"{path}/chunks")
    for check in (verify_store, read_store):
        with pytest.raises(Exception, match="does not match its digest"):
            check(spark, path).collect()


def test_missing_parts_are_found(spark, docs, tmp_path):
    path = f"file://{tmp_path}/store"
    write_store(docs.where("doc_id < 5"), path, tokenizer_path("byte_bpe_50k.json"))
    chunks = spark.read.parquet(f"{path}/chunks").select("key", "n", "ids").collect()
    spark.createDataFrame([tuple(c) for c in chunks[1:]], "key binary, n long, ids binary").write.mode("overwrite").parquet(f"{path}/chunks")
    for check in (verify_store, read_store):
        with pytest.raises(Exception, match="a chunk is missing"):
            check(spark, path).collect()
    recipes = spark.read.parquet(f"{path}/recipes")
    rows, schema = recipes.collect(), recipes.schema
    for left in (rows[1:], [rows[0], *rows[:-1]]):
        spark.createDataFrame(left, schema).write.mode("overwrite").parquet(f"{path}/recipes")
        with pytest.raises(ValueError, match="do not agree"):
            verify_store(spark, path)


def test_store_of_an_empty_table(no_docs):
    assert token_digest(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_chunks_follow_content(data):
    rng = np.random.default_rng(data.draw(st.integers(0, 99)))
    long = rng.integers(0, 50_000, 20_000).astype(np.uint32)
    shifted = np.concatenate([rng.integers(0, 50_000, data.draw(st.integers(1, 300))).astype(np.uint32), long])
    short = long[: data.draw(st.integers(1, 20))]
    ends = cut_points([short, long, shifted])
    assert ends == [cut_points([s])[0] for s in (short, long, shifted)]
    for s, e in zip((short, long, shifted), ends, strict=True):
        sizes = np.diff([0, *e])
        assert e[-1] == len(s) and (sizes <= MOST).all() and (sizes[:-1] >= LEAST).all()
    pieces = lambda s, e: {s[a:b].tobytes() for a, b in zip([0, *e], e, strict=False)}
    assert len(pieces(long, ends[1]) & pieces(shifted, ends[2])) >= len(ends[1]) - 6


@given(a=st.binary(max_size=50), b=st.binary(max_size=50))
def test_checksums_of_parts_give_those_of_the_whole(a, b):
    assert _times(_shift(len(b), {}), zlib.crc32(a)) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_merkle_root_depends_on_every_leaf_and_order():
    leaves = [bytes([i]) * 16 for i in range(5)]
    assert len({merkle_root(leaves), merkle_root(leaves[::-1]), merkle_root(leaves[:4]), merkle_root([]), merkle_root(leaves[:1])}) == 5


def test_vocabularies_are_not_in_the_repository():
    assert not list(Path(__file__).resolve().parents[2].rglob("*bpe*.json"))


def test_digest_columns(docs):
    assert packed_digest(docs).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert token_digest(docs.withColumn("start", F.lit(1))).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_merkle_roots_hold_few_nodes():
    def by_levels(leaves):
        if not leaves:
            return token_store.digest(b"\0")
        while len(leaves) > 1:
            up = [token_store.digest(b"\1" + a + b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
            leaves = up + leaves[len(leaves) - len(leaves) % 2 :]
        return leaves[0]

    tree, leaves = token_store.Merkle(), []
    for i in range(300):
        assert tree.root() == by_levels(leaves) == token_store.merkle_root(leaves) and len(tree._whole) == bin(i).count("1")
        leaves.append(token_store.digest(str(i).encode()))
        tree.add(leaves[-1])
