import random
import re

import numpy as np
import pyarrow as pa
import pytest

from botlantern.llm import common
from botlantern.llm.common import ALNUM, NOT_SPACE, Words, shingle_hashes


def test_words_follow_the_patterns():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aZ9 ,.\n\té日 ~") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for kind, pattern in ((ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), (NOT_SPACE, "[^\x20\x09-\x0d]+")):
        words = Words([t.encode() for t in texts], kind)
        for i, t in enumerate(texts):
            lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            want = re.findall(pattern, lowered)
            assert words.text(words.first[i], words.first[i + 1]).decode().split(" ") == (want or [""])


def test_equal_words_have_equal_hashes_wherever_they_stand():
    words = Words([b"tide mast", b"xx tide", b"MAST tide tide"], ALNUM)
    h = words.hashes
    assert h[0] == h[3] == h[5] == h[6] and h[1] == h[4] and len(np.unique(h)) == 3
    a, b = shingle_hashes(h[:2], 2), shingle_hashes(np.array([h[4], h[5]]), 2)
    assert a[0] != b[0]
    assert len(shingle_hashes(h[:0], 3)) == 0 and len(shingle_hashes(h[:2], 3)) == 1


def test_hashes_do_not_depend_on_the_slices(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abC é ") for _ in range(rng.randint(0, 300))).encode() for _ in range(50)] + [b"x" * 500, b"a " + b"y" * 129 + b" b"]
    whole = Words(texts, NOT_SPACE).hashes
    for piece in (7, 64, 128):
        monkeypatch.setattr(common, "PIECE", piece)
        assert (Words(texts, NOT_SPACE).hashes == whole).all()
    assert len(common._powers(common._BASE, 10, "base")) == 10


def test_rows_of_one_key_across_batches():
    rows = [(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (2, 2, "d"), (2, 2, "e"), (3, 0, "f")]
    want = [((1, 1), ["a", "b"]), ((1, 2), ["c"]), ((2, 2), ["d", "e"]), ((3, 0), ["f"])]
    for step in (1, 2, 4, 6):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + step], strict=True)], names=["k", "l", "v"]) for i in range(0, len(rows), step)]
        assert list(common.runs(iter([batches[0].slice(0, 0), *batches]), 2, lambda b: b.column(2).to_pylist())) == want


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_root(Session)


def test_tables_in_the_shared_folder_can_be_removed(spark):
    from pathlib import Path

    from botlantern.llm.common import clean, cut, shared_root, stored

    kept = stored(spark.range(3), "kept")
    assert kept.count() == 3 and cut(spark.range(4)).count() == 4
    root = Path(shared_root(spark).removeprefix("file:"))
    assert list(root.glob("kept-*"))
    clean(spark)
    assert not list(root.glob("kept-*"))
