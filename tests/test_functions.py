"""Scalar functions, components and incremental ingest on cases of our own."""

import pytest
from pyspark.sql import functions as F

from dossier.functions import contacts, scoring, text
from dossier.operators.components import components, resolve_roots
from dossier.streaming import ingest


def _one(spark, f, *values):
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in frame.select(f(F.col("v"))).collect()]


def test_text(spark):
    assert _one(spark, text.fold, "Ђорђе  Љубић", "ĐOKO", "Đoko​ Žić ", None, "") == ["djordje ljubic", "djoko", "djoko zic", None, ""]
    assert _one(spark, text.to_latin, "ЉУБА", "Љуба", "њ", "Џ") == ["LJUBA", "Ljuba", "nj", "Dž"]
    assert _one(spark, text.to_cyrillic, "Ljubav", "NJ", "džep") == ["Љубав", "Њ", "џеп"]
    assert _one(spark, text.fold_diacritics, "ĐOKO", "Đoko", "Čačak") == ["DJOKO", "Djoko", "Cacak"]


def test_contacts(spark):
    assert _one(spark, contacts.emails, "A@b.co.rs, a@B.co.rs x@y", None, "") == [["a@b.co.rs"], None, []]
    assert _one(spark, contacts.phones, "+1 (212) 555-0100 or +381/11-123-4567; +12", "none") == [["+12125550100", "+381111234567"], []]
    assert _one(spark, contacts.canonical_url, "http://WWW.a.rs:80/x/?utm_source=1&b=2&a=1#t", "https://a.rs/") == ["https://a.rs/x?a=1&b=2", "https://a.rs"]
    assert _one(spark, lambda c: contacts.registrable_domain(contacts.host(c)), "http://x.y.co.rs/", "//m.a.com", "localhost") == ["y.co.rs", "a.com", ""]
    assert _one(spark, contacts.email_rejection, "a@b.png", "a@example.com", "a@b.rs") == ["asset-name", "placeholder", None]


def test_scoring(spark):
    row = spark.range(1).select(
        scoring.noisy_or(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))), scoring.half_up(F.lit(0.285), 2), scoring.char_similarity(F.lit("abcd"), F.lit("abce")), scoring.char_similarity(F.lit(""), F.lit(""))
    ).first()
    assert list(row) == [0.75, 0.28, 0.75, 0.0]


def test_roots_and_components(spark):
    forest = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, 77)], "id long, parent long")
    assert {tuple(r) for r in resolve_roots(forest).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (9, 77)}
    with pytest.raises(ValueError):
        resolve_roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent long"), rounds=5)
    links = spark.createDataFrame([(5, 4), (4, 6), (6, 1), (8, 9), (7, 7), (3, 2), (2, 9)], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(1, 1), (4, 1), (5, 1), (6, 1), (8, 2), (9, 2), (2, 2), (3, 2), (7, 7)}
    assert components(links.limit(0)).collect() == []


def test_ingest_replay_changes_nothing(spark, tmp_path):
    into = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int").write.parquet(into)
    for checkpoint in ("one", "two"):
        stream = spark.readStream.schema("k string, v int").parquet(into)
        ingest(stream, str(tmp_path / "log"), "k", str(tmp_path / checkpoint)).awaitTermination()
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "log")).collect()} == {("a", 1), ("b", 2)}
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_few_links_take_no_rounds(spark, monkeypatch):
    """Links that one task's forest holds are written twice, however long their chains are; the rounds give the same."""
    import random

    from dossier.operators import components as c

    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i + 1, i) for i in range(1_000, 1_040)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    root = {}
    for a, b in pairs:
        a, b = root.setdefault(a, a), root.setdefault(b, b)
        root |= {x: min(a, b) for x, r in root.items() if r in (a, b)}
    written, write = [], c.materialize
    monkeypatch.setattr(c, "materialize", lambda df, name: written.append(name) or write(df, name))
    assert {tuple(r) for r in components(links).collect()} == set(root.items())
    assert written == ["edges"] * 2
    monkeypatch.setattr(c, "LINKS", 0)
    assert {tuple(r) for r in components(links).collect()} == set(root.items())
    assert len(written) > 4
