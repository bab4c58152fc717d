"""Fingerprints and edited texts against plain Python."""

import hashlib

from dossier.llm import fingerprints as f


def test_against_plain_python(spark, docs, rows):
    known = [r for r in {r[0]: r for r in rows if r[0] is not None}.values()]
    table = spark.createDataFrame([(r[0], r[1]) for r in known], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in f.with_next(table).collect()}
    order = sorted(known, key=lambda r: -r[0])
    texts = [r[1] or "" for r in order]
    assert len(got) == len(order)
    for i, (doc_id, text) in enumerate(zip([r[0] for r in order], texts, strict=True)):
        after = texts[(i + 1) % len(texts)]
        third = len(text) // 3
        edited = (text[: len(text) - third] + after[:third]).encode()
        r = got[doc_id]
        own, changed, following = (f.fingerprint(x) for x in (text.encode(), edited, after.encode()))
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f.written(own), f.written(changed))
        assert (r["near_edited"], r["near_next"]) == (f.likeness(own, changed), f.likeness(own, following))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_odd_rows(docs, rows, none):
    got = f.with_next(docs).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault((r["n_chars"], r["doc_id"]), set()).add(r["fingerprint"])
    assert f.with_next(none).count() == 0


def test_a_shift_keeps_most_chunks(rows):
    text = max((r[1] or "" for r in rows), key=len).encode()
    assert f.likeness(f.fingerprint(text), f.fingerprint(b"some words before " + text)) > 0.9
