import itertools
import random

from dossier.llm import fuzzy_lines as f


def brute(rows):
    """Removed places by row, as the operator's description says: (doc_id or None, text) rows, equal rows counted once."""
    grams = lambda x: {x[i : i + f.SHINGLE] for i in range(max(1, len(x) - f.SHINGLE + 1))}
    places = [(r[0] is None, r[0] or 0, i, k, x) for k, r in enumerate(rows) for i, x in enumerate(f.lines_of(r[1])) if x]
    lines = sorted({x for *_, x in places})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {x: grams(x) for x in lines}
    for a, b in itertools.combinations(lines, 2):
        if len(sets[a] & sets[b]) * f.DEN >= len(sets[a] | sets[b]) * f.NUM:
            root[find(a)] = find(b)
    first = {}
    for p in sorted(places):
        first.setdefault(find(p[4]), p)
    return [[i for _, _, i, k, x in places if k == at and first[find(x)][2:4] != (i, k)] for at in range(len(rows))]


def table():
    rng = random.Random(8)
    line = lambda: " ".join("".join(rng.choice("abcdefgéß") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 40)))
    base = [line() for _ in range(30)]

    def near(x):
        at = rng.randrange(len(x))
        return x[:at] + rng.choice(["", "z", "zz"]) + x[at + 1 :]

    pool = base + [near(x) for x in base for _ in range(3)] + ["", "  ", "short", "sho", "x" * 5000]
    rows = [(i * 2, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    return [*rows, (None, base[0]), (121, None), (123, ""), (125, " \t" + base[1] + "\r\n" + base[1])]


def test_against_brute_force(spark):
    rows = table()
    out = f.duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = {r["doc_id"]: r["removed"] for r in out}
    want = dict(zip([r[0] for r in rows], brute(rows), strict=True))
    assert len(out) == len(rows)
    assert got == want
    assert all(r["n_removed"] == len(r["removed"]) for r in out)


def test_odd_rows(docs, rows, none):
    assert f.duplicates(docs).count() == len(rows)
    assert f.without_duplicates(docs).columns == docs.columns
    assert f.duplicates(none).count() == 0


def _pairs(rng, n, length):
    """Lines and copies of them with a few code points changed at the end, whose similarity is near the threshold and above."""
    out = []
    for _ in range(n):
        line = "".join(rng.choice("abcdefghijklmnop ") for _ in range(length)).strip() or "x"
        cut = rng.randint(1, max(1, length // 12))
        out.append((line, line[:-cut] + "".join(rng.choice("qrstuvwz") for _ in range(rng.randint(0, cut)))))
    return out


def test_recall_at_every_length():
    """Of linking pairs, the share with a common band: lengths around what once had two kinds of signatures are no exception."""
    import numpy as np

    rng = random.Random(12)
    for length in (40, 100, 130, 134, 136, 140, 300, 1200):
        hit = linked = 0
        for a, b in _pairs(rng, 150, length):
            sets = f.line_sets([a, b])
            if not f.reach_similarity(*sets, f.NUM, f.DEN):
                continue
            linked += 1
            values = f.signatures(*f.shingles([a, b])).reshape(2, f.BANDS, f.ROWS)
            hit += bool(np.any(np.all(values[0] == values[1], axis=1)))
        assert linked > 50 and hit >= 0.99 * linked, (length, hit, linked)


def test_groups_longer_than_their_pairs(spark, monkeypatch):
    from dossier.llm import ngram_join

    rng = random.Random(5)
    rows = []
    for g in range(3):
        base = "".join(rng.choice("abcdefghijklmnop") for _ in range(160))
        for i in range(40):
            line = list(base)
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(len(line))] = rng.choice("qrstuvwz")
            rows.append((100 * g + i, "".join(line)))
    monkeypatch.setattr(ngram_join, "LONG", 3)
    out = f.duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["removed"] for r in out} == dict(zip([r[0] for r in rows], brute(rows), strict=True))


def test_rows_of_one_id_keep_their_own_lines(spark):
    rows = [(1, "a line that two documents have in common\nmy own important first line", "x"), (1, "my own important first line, of another text", "y"), (0, "a line that two documents have in common", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    assert {(r["text"], r["gone"]) for r in f.without_duplicates(docs).collect()} == {("my own important first line", "x"), (rows[1][1], "y"), (rows[2][1], "z")}


def test_a_chunk_sorts_each_node_once(monkeypatch):
    """A line's rows come side by side: its node is sorted once for them, not once for each band."""
    import numpy as np
    import pyarrow as pa

    from dossier.llm import exchange

    sorted_, unique = [], np.unique
    monkeypatch.setattr(exchange.np, "unique", lambda x, **more: sorted_.append(len(x)) or unique(x, **more))
    lines = [f"line {i % 40} of the forty different ones" for i in range(50)]
    out = next(f._bands(iter([pa.RecordBatch.from_arrays([pa.array(lines)], names=["text"])])))
    chunk = exchange._chunk(0, [out])
    assert sorted_ == [40]
    who, node, n = (np.frombuffer(chunk[c][0].as_py(), t) for c, t in (("who", np.int32), ("node", np.int64), ("n", np.int64)))
    key = np.frombuffer(chunk["key"][0].as_py(), np.int64)
    want = set(zip(*(out[c].to_pylist() for c in ("key", "node", "n")), strict=True))
    assert set(zip(key.tolist(), node[who].tolist(), n[who].tolist(), strict=True)) == want


def test_sizes_and_sets_of_lines_with_repeats():
    lines = ["ab" * 30, "x" * 500, "short", "each shingle of this one is another", "x" * 500 + "y"]
    want = [len({x[i : i + f.SHINGLE] for i in range(max(1, len(x) - f.SHINGLE + 1))}) for x in lines]
    assert f.sizes(*f.shingles(lines)).tolist() == want == [len(m) for m in f.line_sets(lines)]
    assert all(m.tolist() == sorted(set(m.tolist())) for m in f.line_sets(lines))
    assert f.line_sets([]) == []


def test_texts_are_read_twice(spark, docs, rows, monkeypatch):
    """Once for the bands, once for the places, which bring the listed lines along."""
    kind, read = type(docs), []
    run = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, function, schema: read.append("text" in self.columns) or run(self, function, schema))
    out = f.duplicates(docs).collect()
    assert sum(read) == 2
    assert len(out) == len(rows)


def test_places_bring_each_listed_line_once_a_batch():
    import types

    import numpy as np
    import pyarrow as pa

    texts = ["first\nsecond\n\nfirst", None, "second\nthird"]
    bits = np.zeros(f.passes.__globals__["FILTER"] // 64, np.uint64)
    for line in ("first", "second"):
        slot = f.name(line) & f.passes.__globals__["FILTER"] - 1
        bits[slot // 64] |= np.uint64(1 << slot % 64)
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array(texts), pa.array([70, 80, 90])], names=["doc_id", "text", "row"])
    out = next(f._places(types.SimpleNamespace(value=bits.tobytes()))(iter([batch])))
    one, two, three = map(f.name, ("first", "second", "third"))
    assert list(zip(*(out[c].to_pylist() for c in out.schema.names), strict=True)) == [
        (3, 7, 70, -1, None), (one, 7, 70, 0, "first"), (two, 7, 70, 1, "second"), (one, 7, 70, 3, None),
        (0, 8, 80, -1, None), (2, 9, 90, -1, None), (two, 9, 90, 0, None), (three, 9, 90, 1, None),
    ]


def test_zero_columns_of_a_chunk_are_not_written():
    import pyarrow as pa

    from dossier.llm import exchange

    lines = [f"line {i} of several" for i in range(9)]
    chunk = exchange._chunk(0, list(f._bands(iter([pa.RecordBatch.from_arrays([pa.array(lines)], names=["text"])]))))
    assert chunk["sure"][0].as_py() == chunk["pos"][0].as_py() == b""
    sent = len(exchange._different(*(chunk[c][0].as_py() for c in ("key", "sure", "who")))[0])
    marks = pa.array([[{"owner": 0, "n_sent": sent, "bits": b"\xff" * sent}]])
    out = next(exchange._let_go(iter([pa.RecordBatch.from_arrays([*chunk.columns, marks], names=[*chunk.schema.names, "replies"])])))
    assert len(out) == chunk["size"][0].as_py()
    assert not any(out["sure"].to_pylist()) and not any(out["pos"].to_pylist())
