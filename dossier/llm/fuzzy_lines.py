"""Fuzzy line dedup by MinHash.

Lines are what \\n separates, trimmed of [\\x20\\x09-\\x0D]; blank ones are no lines and always stay. Lines that are
equal are one node. A node's shingles are its runs of SHINGLE code points (all of a shorter line), as 64-bit hashes. Its
MinHash signature, BANDS of ROWS minima, of which each function gives one at every length, puts it on a list for each
band: two lines of similarity 0.8 share one with probability 0.998. Pairs on common lists are verified by their exact
Jaccard similarity, NUM / DEN or more.

Lists of up to LONG lines (ngram_join) give their pairs. Of longer ones the pairs with a few pivots are looked at first.
Lines of a long list that aren't yet in one component enter narrower lists, one for each of their first shingles in one
order of all shingles, rare ones first: linking lines have one of these in common, and the places that it has in both
bound their sizes. So no list is compared all with all.
Distributed union-find gives components, of which the first line by doc_id (null last) and place stays.

A null text has no lines. Very long texts and lines are taken whole. Rows that repeat are documents of their own, but
equal rows of one id get the same result, that of the first; rows of one id with other texts have their own. An empty
table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import free_names, hash_filter, materialize, passes, release
from .ngram_join import Counts, bounded, first_members, linked_nodes, list_rows, listed_rows, mix, reach_similarity, summed

SHINGLE, NUM, DEN = 8, 80, 100
BANDS, ROWS = 12, 4
_U, _V = np.uint64, np.uint32
_RNG = np.random.default_rng(11)
_TURNS = _RNG.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | _V(1)
_PLACES = _RNG.integers(1, 1 << 63, ROWS, dtype=np.uint64) | _U(1)
_WHITE = " \t\n\x0b\x0c\r"
#: Code points whose shingles are hashed at once.
BATCH = 1 << 16


def lines_of(text: str | None) -> list[str]:
    return [line.strip(_WHITE) for line in (text or "").split("\n")]


def name(line: str) -> int:
    """The node of a line, signed."""
    h = xxhash.xxh3_64_intdigest(line.encode())
    return h - (1 << 64) if h >> 63 else h


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of lines (none blank), and where each line's begin."""
    padded = [x if len(x) >= SHINGLE else x + "\0" * (SHINGLE - len(x)) for x in lines]
    h, done = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64), 1
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    keep = np.ones(len(h), bool)
    ends = np.cumsum(lengths)
    for back in range(1, SHINGLE):
        keep[ends - back] = False
    h += _U(1)
    h *= _U(0x9E3779B97F4A7C15)
    aside = h >> _U(29)
    h ^= aside
    while done < SHINGLE:  # in two arrays, turn about
        aside = np.multiply(h[:-done], _U(pow(0xD6E8FEB86659FD93, done, 1 << 64)), out=aside[: len(h) - done])
        aside += h[done:]
        h, aside = aside, h
        done *= 2
    return mix(h[keep[: len(h)]]), np.concatenate(([0], np.cumsum(lengths - SHINGLE + 1)))


def signatures(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """lines x (BANDS * ROWS): of each function, the least value of a line's shingles."""
    own = (hashes >> _U(32)).astype(np.uint32)
    out, turned = np.empty((len(_TURNS), len(begins) - 1), np.uint32), np.empty_like(own)
    for j, turn in enumerate(_TURNS):
        np.minimum.reduceat(np.multiply(own, turn, out=turned), begins[:-1], out=out[j])
    return out.T


def sizes(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each of fewer than 2**20 lines, how many different shingles it has, by 44 bits of them."""
    times = np.diff(begins)
    tagged = np.repeat(np.arange(len(times), dtype=np.uint64) << _U(44), times)
    tagged |= hashes >> _U(20)
    tagged.sort()
    again = tagged[1:][tagged[1:] == tagged[:-1]] >> _U(44)
    return times - np.bincount(again.astype(np.int64), minlength=len(times))


def line_sets(lines: list[str]) -> list[np.ndarray]:
    """Each line's different shingles, ascending."""
    hashes, begins = shingles(lines)
    if not len(hashes):
        return []
    for a, b in itertools.pairwise(begins.tolist()):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[begins[:-1]] = True
    ends = np.cumsum(np.add.reduceat(new, begins[:-1], dtype=np.int64)).tolist()
    members = hashes[new]
    return [members[a:b] for a, b in itertools.pairwise([0, *ends])]


def _distinct(batch: pa.RecordBatch) -> Iterator[list[str]]:
    """The different lines of some rows at a time."""
    for at in range(0, batch.num_rows, 512):
        yield list(dict.fromkeys(x for t in batch["text"].slice(at, 512).to_pylist() for x in lines_of(t) if x))


def _groups(lines: list[str]) -> Iterator[list[str]]:
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) <= BATCH):
            size += len(lines[end])
            end += 1
        yield lines[at:end]
        at = end


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, n, sure, pos) of a batch's different lines; n is the number of different shingles."""
    for batch in batches:
        for lines in (x for part in _distinct(batch) for x in _groups(part)):
            hashes, begins = shingles(lines)
            values = signatures(hashes, begins).astype(np.uint64).reshape(len(lines), BANDS, ROWS)
            keys = np.zeros((len(lines), BANDS), np.uint64)
            for r in range(ROWS):
                keys = (keys + values[:, :, r]) * _PLACES[r]
                keys ^= keys >> _U(31)
            keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
            nodes = np.array([name(x) for x in lines], np.int64)
            columns = [keys.reshape(-1).view(np.int64), np.repeat(nodes, BANDS), np.repeat(sizes(hashes, begins), BANDS), np.zeros(keys.size, bool), np.zeros(keys.size, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "n", "sure", "pos"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sketch of lines (members)."""
    counts = Counts()
    for batch in batches:
        for lines in _groups(batch["members"].to_pylist()):
            counts.add(np.concatenate(line_sets(lines)))
    yield pa.RecordBatch.from_arrays(counts.columns(), names=["segment", "part", "counts"])


def _first(sketch):
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, node, n, sure, pos) of lines (members): their first shingles."""
        level = np.frombuffer(sketch.value, np.uint8)
        for batch in batches:
            for lines in _groups(batch["members"].to_pylist()):
                yield list_rows([(first_members(m, level, NUM, DEN), name(x), len(m), False) for x, m in zip(lines, line_sets(lines), strict=True)])

    return first


def _places(bits):
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, doc_id, row, line, members) of all lines, and for each row one with line -1 and its number of lines as node.

        members: at the first of a batch's equal lines the line itself, which stands for its shingles, if it passes the filter.
        """
        for batch in batches:
            node, take, at, lines = [], [], [], []
            names: dict[str, int] = {}
            for row, text in enumerate(batch["text"].to_pylist()):
                head = len(node)
                for line, i in [(None, -1), *((x, i) for i, x in enumerate(lines_of(text)) if x)]:
                    new = line and line not in names
                    if new:
                        names[line] = name(line)
                    node.append(names[line] if line else 0)
                    at.append(i)
                    lines.append(line if new else None)
                node[head] = len(node) - head - 1
                take += [row] * (len(node) - head)
            node = np.array(node, np.int64)
            known = passes(bits.value, node.view(np.uint64)).tolist()
            take, members = pa.array(take, pa.int64()), pa.array([x if k else None for x, k in zip(lines, known, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(node), batch["doc_id"].take(take), batch["row"].take(take), pa.array(at, pa.int64()), members], names=["node", "doc_id", "row", "line", "members"])

    return places


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of lines whose sets of shingles reach the similarity."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, 256)
            lines: dict[str, int] = {}
            pairs, size = [], 0
            for a, b in zip(part["sa"].to_pylist(), part["sb"].to_pylist(), strict=True):
                for line in (a, b):
                    if line not in lines:
                        lines[line] = len(lines)
                        size += len(line)
                pairs.append((lines[a], lines[b]))
                if size > 8 * BATCH:
                    break
            sets = line_sets(list(lines))
            fits = pa.array([reach_similarity(sets[i], sets[j], NUM, DEN) for i, j in pairs], pa.bool_())
            yield part.slice(0, len(pairs)).select(["a", "b"]).filter(fits)
            at += len(pairs)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each different row of docs (doc_id, row): n_lines and removed."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row"))
    listed = listed_rows(slim.select("text"), _bands, NUM, DEN, placed=False)

    nodes = materialize(listed.select("node").distinct(), "wanted")
    bits = spark.sparkContext.broadcast(hash_filter(nodes, "node"))
    places = materialize(slim.mapInArrow(_places(bits), "node long, doc_id long, row long, line long, members string"), "places")
    named = places.where("members IS NOT NULL").select("node", "members")
    known = materialize(named.join(bounded(nodes), "node", "left_semi").groupBy("node").agg(F.min("members").alias("members")), "lines")

    def fetch(wanted: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        wanted = materialize(wanted, "wanted")
        return known.join(bounded(wanted), "node", "left_semi"), [wanted]

    def relist(nodes: DataFrame) -> DataFrame:
        lines, behind = fetch(nodes)
        sketch = summed(lines.select("members").mapInArrow(_counted, Counts.COLUMNS))
        out = listed_rows(lines.select("members"), _first(spark.sparkContext.broadcast(sketch)), NUM, DEN)
        release(*behind)
        return out

    edges = linked_nodes(listed, fetch, lambda pairs: pairs.mapInArrow(_fitting, "a long, b long"), NUM, DEN, relist)
    found = materialize(components(edges).select(F.col("id").alias("node"), F.col("root").alias("component")), "found")
    release(nodes, known)

    lines = places.where("line >= 0").select("node", "doc_id", "row", "line")
    nodes = lines.groupBy("node").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc")).join(found, "node", "left").where("c > 1 OR component IS NOT NULL")
    nodes = materialize(nodes.select("node", F.coalesce("component", "node").alias("component"), "doc"), "nodes")
    firsts = nodes.groupBy("component").agg(F.min("doc").alias("doc"))  # a null doc_id is the least only if there is no other
    nodes = materialize(nodes.select("node", "component").join(firsts, "component"), "nodes")
    shared = materialize(lines.join(bounded(nodes), "node").select("component", "doc", "doc_id", "row", "line"), "shared")
    kept = shared.where("doc_id <=> doc").groupBy("component").agg(F.min(F.struct("line", "row")).alias("kept"))
    gone = shared.join(kept, "component").where(~(F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("line") == F.col("kept.line")) & (F.col("row") == F.col("kept.row"))))
    gone = gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    every = places.where("line < 0").select("doc_id", "row", F.col("node").alias("n_lines"))
    out = every.join(gone, every["doc_id"].eqNullSafe(gone["doc_id"]) & (every["row"] == gone["row"]), "left")
    return out.select(every["doc_id"], every["row"], "n_lines", F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_removed, and removed: the places, from 0, of the lines that go, ascending."""
    return _marked(docs, id_col, text_col).select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, their texts without the lines that go."""
    id_, row, gone = free_names(docs.columns, "id", "row", "gone")
    marked = _marked(docs, id_col, text_col).where(F.size("removed") > 0).dropDuplicates(["doc_id", "row"])
    marked = marked.select(F.col("doc_id").alias(id_), F.col("row").alias(row), F.col("removed").alias(gone))
    joined = docs.join(marked, docs[id_col].cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(docs[id_col], docs[text_col]) == F.col(row)), "left")
    text = F.array_join(F.filter(F.split(docs[text_col], "\n", -1), lambda x, i: ~F.coalesce(F.array_contains(gone, i.cast("long")), F.lit(False))), "\n")
    return joined.select(*[F.when(F.col(gone).isNull(), docs[c]).otherwise(text).alias(c) if c.lower() == text_col.lower() else docs[c] for c in docs.columns])
