import random
import re
from itertools import permutations

import duckdb
import numpy as np

from botlantern.llm import filter_audit
from botlantern.llm.filter_audit import COUNTS, filter_audit as audit, matrices


def plain(rows, labels):
    """Every order applied to every document, one filter after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    found = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > least[text],
        }
        found.append((part or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    want = {}
    for part in {p for p, *_ in found}:
        mine, share = [d[1:] for d in found if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                out = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = [d for d in mine if f in d[0]]
                share[f] += len(out)
                want[part, "".join(order), step] = [len(left), len(out), len(failing) - len(out), sum(d[0] == {f} for d in mine), sum(d[1] for d in out), sum(d[2] for d in out)]
        for (p, order, step), counts in want.items():
            if p == part:
                counts.append(share[order[step - 1]])
    return want


def documents():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words[: rng.choice([20, 300])]) for _ in range(rng.choice([5, 150, 199, 200, 260])))
        text = rng.choice(["", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2 + " "]) + text + rng.choice(["", "", " $5", " a|b"])
        rows.append((i, text, rng.choice(["one", "two", None, ""])))
    rows += [(100 + i, rows[i % 7][1], rng.choice(["one", "three"])) for i in range(30)]
    rows += [(None, rows[0][1], "one"), (None, None, None), (200, None, "one"), (201, "", "two"), (5, rows[5][1], "two"), (5, rows[6][1], "one"), (5, rows[5][1], "two")]
    rows += [(202, "Été x y\x0bz " * 90, "two"), (203, " \t\n", "four"), (204, "a " * 300_000, "two"), (-1, "x $", "four"), (300, "𝔸B " * 40, "four")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 230, 2)] + [(4, 1, 1), (4, None, None), (None, 1, 1), (100, 0, 0), (103, 1, None)]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, p, 1, 2) for i, t, p in rows], "doc_id long, text string, source string, mask int, n int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_against_every_order_applied(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS_AT_ONCE", 2)
    rows, labels = documents()
    got = audit(*frames(spark, rows, labels)).collect()
    want = plain(rows, labels)
    assert len(got) == len(want) == 600 * len({p or "" for *_, p in rows})
    assert {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in got} == want


def test_the_sql_agrees(spark):
    rows, labels = documents()
    docs, said = frames(spark, rows, labels)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", said.toPandas().astype("Int64"))
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in audit(docs, said).collect()}
    columns = ["part", "filter_order", "step", *COUNTS]
    sql = con.sql(filter_audit.SQL).select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert {tuple(r[:3]): list(r[3:]) for r in sql} == got


def test_a_hot_text_of_many_ids_and_none(spark):
    rows = [(i, "the same", "one") for i in range(500)] + [(None, "the same", "one")] * 300 + [(7, "the same", "two")] * 200
    got = {(r.part, r.filter_order, r.step): r for r in audit(*frames(spark, rows, [(0, 1, 1), (9, 1, 0)])).collect()}
    one, two = got["one", "EABCD", 1], got["two", "EABCD", 1]
    assert (one.kept, one.removed, one.good_lost, one.toxic_lost) == (301, 499, 1, 0) and (two.kept, two.removed) == (0, 200)


def test_empty_tables(spark):
    docs, labels = frames(spark, [(1, "a", None)], [])
    assert audit(docs.where("doc_id is null"), labels).collect() == []
    assert audit(docs, labels).count() == 600


def test_matrices_add_up():
    orders, m = matrices()
    assert len(orders) == 120 and all(x.shape == (32, 600) for x in m.values())
    fails = np.array([[mask >> f & 1 for o in orders for f in o] for mask in range(32)])
    assert (m["removed"] + m["redundant"] == fails).all()
    assert (m["removed"].reshape(32, 120, 5).sum(axis=2) + m["kept"].reshape(32, 120, 5)[:, :, 4] == 1).all()
