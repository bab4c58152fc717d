"""Components of the n-gram Jaccard join against brute force over all pairs."""

import re

from dossier.llm import ngram_join


def _set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def _brute(rows, width, num, den):
    sets = [(r[0], _set(r[1], width)) for r in rows if r[0] is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and den * len(a & b) >= num * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {(i, len(a), find(i)) for i, a in sets}


def test_components_equal_brute_force(spark, docs, rows):
    for width, num, den in ((4, 85, 100), (2, 30, 100)):
        found = {tuple(r) for r in ngram_join.joined(docs, width=width, num=num, den=den).where("doc_id IS NOT NULL").collect()}
        assert found == _brute(rows, width, num, den)


def test_one_short_text_with_longer_ones(spark):
    """Texts that reach the similarity with a shorter one, but not with each other."""
    rows = []
    for k in range(8):
        base = " ".join(f"w{k}x{i}" for i in range(9))
        rows += [(100 * k + i, base + (f" more{i}" if i else "")) for i in range(11)]
        rows += [(100 * k + 50 + i, f"other{i} " + base) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {tuple(r) for r in ngram_join.joined(docs).collect()}
    assert found == _brute(rows, 4, 85, 100)
    assert len({c for _, _, c in found}) == 8


def test_empty_table(spark, none):
    assert ngram_join.joined(none).collect() == []


def _near_copies():
    """Groups of near copies with more members than a list may pair, with links that chain, and texts beside them."""
    import random

    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = []
    for g in range(3):
        base = [word() for _ in range(90)]
        for i in range(45):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = word()
            rows.append((1000 * g + i, " ".join(text[: len(text) - rng.randint(0, 6)])))
        chain = [word() for _ in range(120)]
        rows += [(1000 * g + 500 + i, " ".join(chain[4 * i : 4 * i + 80])) for i in range(10)]
    return rows


def test_lists_longer_than_their_pairs(spark, monkeypatch):
    rows = _near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for long in (2, 32):
        monkeypatch.setattr(ngram_join, "LONG", long)
        for width, num, den in ((4, 85, 100), (5, 80, 100)):
            found = {tuple(r) for r in ngram_join.joined(docs, width=width, num=num, den=den).collect()}
            assert found == _brute(rows, width, num, den)


def test_one_of_each(spark, docs, rows):
    table = docs.withColumnsRenamed({"key": "gone_id", "n": "Stays"})
    kept = ngram_join.one_of_each(table, width=4, num=85)
    assert kept.columns == table.columns
    first = {c for _, n, c in _brute(rows, 4, 85, 100) if n}
    stay = {i for i, n, c in _brute(rows, 4, 85, 100) if not n or c == i}
    assert {r["doc_id"] for r in kept.collect()} - {None} == stay and first <= stay
