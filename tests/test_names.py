"""Company names, their likeness by brute force, and links of the list."""

import random

from pyspark.sql import functions as F

from dossier.functions import display, names
from dossier.plans.leads import LeadQuery, link, parse

PLACES = ("Novi Sad", "Beograd", "Čačak")


def _norm(spark, *raw):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    return [tuple(x) for x in names.normalized(frame, "r", PLACES).orderBy("i").select("normalized", "ascii", "legal_form", "trade_name", "city_hint", "tokens").collect()]


def test_company_names(spark):
    said = _norm(spark, "Fasade Beograd doo", 'Stovarište "Gradnja" pr Novi Sad', "DOO", "Ад Фасаде Чачак", "Nomad d. o. o. Srbija", "doo doo", "", None, "Beograd", "Ad mar ad nova")
    assert said == [
        ("fasade", "fasade", "d.o.o.", None, "Beograd", ["fasade"]),
        ("gradnja", "gradnja", "pr", "Gradnja", "Novi Sad", ["gradnja"]),
        ("doo", "doo", "d.o.o.", None, None, ["doo"]),
        ("fasade", "fasade", "a.d.", None, "Čačak", ["fasade"]),
        ("nomad", "nomad", "d.o.o.", None, None, ["nomad"]),
        ("doo", "doo", "d.o.o.", None, None, ["doo"]),
        ("", "", None, None, None, []),
        (None, None, None, None, None, None),
        ("beograd", "beograd", None, None, None, ["beograd"]),
        ("mar ad nova", "mar ad nova", "a.d.", None, None, ["mar", "ad", "nova"]),
    ]


def _letters(a, b):
    if not a or not b:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return 1 - row[-1] / max(len(a), len(b))


def _alike(a, b):
    letters = _letters("".join(a), "".join(b))
    if not a or not b:
        return letters
    w = lambda t: 0.35 if t in names.GENERIC else 1
    near = sorted((-_letters(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if _letters(x, y) >= 0.85)
    left, right, total = set(), set(), 0
    for s, i, j in near:
        if i not in left and j not in right:
            left.add(i), right.add(j)
            total -= min(w(a[i]), w(b[j])) * s
    words = min(1, total / ((sum(map(w, a)) + sum(map(w, b))) / 2))
    return int(max(words, letters if letters >= 0.92 else letters * 0.7) * 1000 + 0.5) / 1000


def test_name_similarity(spark):
    draw = random.Random(3)
    pool = ["fasade", "fasada", "markovic", "markovich", "gradnja", "petrovic", "petrovics", "doo", "termoizolacija", "termoizolacije", "nova"]
    rows = [(i, draw.choices(pool, k=draw.randrange(5)), draw.choices(pool, k=draw.randrange(5))) for i in range(300)]
    frame = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    said = {r.i: r.s for r in frame.select("i", names.similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    for i, a, b in rows:
        assert abs(said[i] - _alike(a, b)) < 1e-9, (a, b)


def test_links():
    q = LeadQuery(classifications=("BOTH", "X"), municipality_id=3, has_phone=False, min_score=20, text="Čačak & co", sort="name", descending=False, page=4, page_size=20)
    assert parse(link(q)) == q
    assert parse(link(q, sort="id")).page == 1
    assert link(LeadQuery()) == "" and parse("") == LeadQuery()
    assert parse("/leads?sort=password&dir=up&page=x&phone=maybe&type=BOTH,EVIL&type=", ("BOTH",)) == LeadQuery(classifications=("BOTH",))


def test_typed_digits(spark):
    terms = ["064/123-4567", "00381 64 123 4567", "+381 64 123 4567", "", "Čačak"]
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select(display.search_digits(F.col("t"))).collect()
    assert [r[0] for r in rows] == [display.typed_digits(t) for t in terms] == ["641234567"] * 3 + ["", ""]
