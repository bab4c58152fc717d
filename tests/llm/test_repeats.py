"""Removed bytes against brute force over all windows."""

import hashlib
import random
from collections import Counter

from dossier.llm import repeats


def brute(rows):
    """Of (doc_id, text) rows: doc_id, bytes, removed bytes, removed runs and the digest of what stays."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + repeats.LENGTH] for t in texts for i in range(len(t) - repeats.LENGTH + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - repeats.LENGTH + 1):
            if seen[t[i : i + repeats.LENGTH]] > 1:
                gone[i : i + repeats.LENGTH] = b"\1" * repeats.LENGTH
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc_id, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def table():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(30, 120)) for _ in range(6)]
    rows = [(i, " ".join(rng.choice([text(rng.randint(1, 60)), rng.choice(passages)]) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    edge = text(80)[: repeats.LENGTH]
    rows += [(100, edge), (101, "x" + edge + "y"), (102, edge[:-1] + "§"), (103, "a" * 1500), (104, "ab" * 400), (105, None), (106, ""), (107, rows[3][1]), (107, rows[3][1]), (None, rows[4][1]), (108, text(5000))]
    rows += [(200 + i, passages[0][: 210 + i]) for i in range(12)]
    return rows


def test_against_brute_force(spark):
    rows = table()
    found = repeats.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == brute(rows)


def test_many_pieces_of_one_anchor(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SPLIT", 4)
    rows = table()
    found = repeats.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == brute(rows)


def test_odd_rows(docs, rows, none):
    assert repeats.removed(docs).count() == len(rows)
    assert repeats.removed(none).count() == 0
