"""The filter audit against a run of every order, document by document."""

import re
from itertools import permutations

from pyspark.sql import functions as F

from pnlbook.llm import interactions
from tests.llm.brute import words


def failed(rows):
    """The set of failed filters of each row (doc_id, text, lang)."""
    out = []
    for i, t, _ in rows:
        w, t = words(t), t or ""
        tests = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}
        out.append({f for f, bad in tests.items() if bad})
    return out


def audited(rows, good, toxic):
    fails, out = failed(rows), {}
    for part in {r[2] or "" for r in rows}:
        own = [(i, f) for (i, _, lang), f in zip(rows, fails, strict=True) if (lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own),
                                                    sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for key in [x for x in out if x[0] == part]:
            out[key].append(shapley[key[1][key[2] - 1]])
    return out


def test_audit_against_every_order(spark):
    prose = lambda n, seed: " ".join(f"w{(k * seed) % 9973}" for k in range(n))
    shared, caps = prose(120, 7), prose(150, 11).upper().replace("W", "WORD")
    rows = [(1, shared, "en"), (2, shared, "en"), (3, shared, "de"), (3, shared, "de"), (3, shared + " x", "de"), (None, shared, "en"), (0, "", "fr"), (4, None, None),
            (5, "", None), (6, caps, "en"), (7, caps + " #", "en"), (8, "same " * 200, "en"), (9, "same " * 200, "fr"), (10, prose(99, 3), ""),
            (11, prose(100, 3) + " $", "de"), (12, prose(130, 5) + "\u3000\U0001F600", "de"), (13, prose(200_000, 17), "en"), (-5, "SAME SAME", "en"), (14, "SAME SAME", "en")]
    rows += [(100 + k, "hot copy", "en") for k in range(12)] + [(50, "hot copy", "en")] * 12
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id LONG, text STRING, lang STRING, part STRING, bits INT")
    labels = spark.createDataFrame([(2, 1, 0, "x"), (2, 0, 0, "x"), (3, 1, 1, "x"), (50, 1, None, "x"), (105, 0, 1, "x"), (None, 1, 1, "x"), (999, 1, 1, "x"), (12, None, None, "x")],
                                   "doc_id LONG, quality INT, toxic INT, lang STRING")
    got = interactions.audit(interactions.combinations(docs, labels)).collect()
    want = audited(rows, {2, 3, 50}, {3, 105})
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == want and len(got) == len(want)
    assert interactions.audit(interactions.combinations(docs.limit(0), labels)).count() == 0
    assert interactions.audit(interactions.combinations(docs, labels.limit(0))).agg({"good_lost": "sum"}).first()[0] == 0


def test_copies_need_equal_texts_not_hashes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a", "en"), (2, "a", "en"), (3, "b", "en"), (4, "b", "en")], "doc_id LONG, text STRING, lang STRING")
    plain = interactions.texts
    monkeypatch.setattr(interactions, "texts", lambda d: plain(d).withColumn("h", F.lit(7).cast("long")))
    assert sorted(r.doc_id for r in interactions.copies(docs, interactions.measured(docs)).collect()) == [2, 4]
