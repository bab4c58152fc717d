"""N-gram Jaccard join by a size-aware heavy-light scheme, and its connected components.

A document's set: its distinct word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased), with fewer
words the whole sequence as one, as 64-bit hashes. Two sets link if their Jaccard similarity reaches the
threshold, which is compared in integers.

Equal sets are one node. Then
* light: pairs with a set of at most `boundary` members. For each size b that a partner may have, a set of
  size a lists its subsets of as many members as the two must share; sets that list the same subset link, but
  for two of the larger size, which link if they also share a list of their own: each links with the smaller ones.
* heavy: pairs of larger sets. Each set enters the inverted lists of its first members in one order of all
  members, rare ones first, as many as a linking pair must have one of in common, each with its place. A set at
  place p of a list shares at most its members from p on with another whose first common member this is, so the
  place bounds the sizes of its partners there (`reach`); rows without a partner leave the lists before these are scanned.
The boundary is the largest size up to which listing subsets costs at most VERIFY times what entering lists
does. The order comes from a count sketch over all documents, of fixed size; it only affects the cost.

Lists of up to LONG rows give their pairs. Longer ones are near-copies of one text, as rare members come first: there
the pairs with a few pivots, sets with the list's member far in front, are looked at first, then only pairs whose sets
aren't yet in one component. Only sets in such pairs are fetched, and each pair is verified on the whole sets. Links
are not expanded within components.

Null and empty texts have no set and link with nothing. Rows that repeat an id count as one document. A
null id has no links of its own; it gets the component of its set. An empty table gives no rows. Very long
texts are whole sets like others. Columns but id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import free_names, letting_go, materialize, release
from .exchange import sharing_rows

#: Rows of an inverted list that cost as much as one row of a subset; sketch counters (16 bit each) in SEGMENTS parts; rows of a list whose pairs are all looked at; pivots of a longer one.
VERIFY, COUNTERS, SEGMENTS, LONG, PIVOTS = 8, 1 << 22, 64, 32, 4
#: Nodes that a task remembers, not to list their copies.
COPIES = 1 << 16
#: Rows of two longs that are broadcast at most; beyond, both sides are shuffled.
BROADCAST = 1_000_000
#: Code points of text that are hashed at once, and rows that are turned into Python strings at once.
BATCH, SLICE = 1 << 19, 256

_U = np.uint64
_RNG = np.random.default_rng(5)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[k] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    aside = h >> _U(33)
    h = h ^ aside
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= np.right_shift(h, _U(33), out=aside)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= np.right_shift(h, _U(33), out=aside)
    return h


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts, and where each text's words begin among them (one more entry than texts)."""
    coded = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(c) + 1 for c in coded])))
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[_LOWER[data]] * power[: len(data)], dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(starts, begins)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text its set, sorted."""
    words, begins = word_hashes(texts)
    n = len(words)
    sums = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        sums += words[k : n - width + 1 + k] * _PLACE[k] if len(sums) else _U(0)
    sums = mix(sums)
    out = []
    for a, b in itertools.pairwise(begins.tolist()):
        if b - a >= width:
            out.append(np.unique(sums[a : b - width + 1]))
        elif b > a:
            out.append(_one(int((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64)) + b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sets_of(batch: pa.RecordBatch, width: int, column: str = "text") -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) for a batch, hashed in pieces of about BATCH code points."""
    for first in range(0, batch.num_rows, SLICE):
        texts = batch[column].slice(first, SLICE).to_pylist()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= BATCH):
                size += len(texts[end] or "")
                end += 1
            yield from enumerate(shingle_sets(texts[at:end], width), first + at)
            at = end


def _one(value: int) -> np.ndarray:
    return mix(np.array([value & (1 << 64) - 1], np.uint64))


def node_of(members: np.ndarray) -> int:
    """A 64-bit digest of a set, signed. With the set's size it names the node."""
    return int(_one(int(mix(members).sum(dtype=np.uint64)) + len(members) * int(_PLACE[9])).view(np.int64)[0])


def overlap(a: int, b: int, num: int, den: int) -> int:
    """Least members that sets of a and b members share if their similarity is num / den or more."""
    return -(-num * (a + b) // (num + den))


def partners(n: int, num: int, den: int) -> range:
    """Sizes that a linking partner of a set of n members may have."""
    return range(-(-num * n // den), den * n // num + 1)


def prefix(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def subsets(n: int, num: int, den: int, most: int) -> int:
    """Subsets that a set of n members lists for partners of at most `most` members, or for all if it has no more itself."""
    return sum(math.comb(n, overlap(n, b, num, den)) for b in partners(n, num, den) if (min(n, b) <= most) and overlap(n, b, num, den) <= min(n, b))


def boundary(num: int, den: int) -> int:
    n = 1
    while subsets(n + 1, num, den, n + 1) <= VERIFY * prefix(n + 1, num, den) and n < 64:
        n += 1
    return n


class Counts:
    """Counters of members, 16 bits each, saturating: a partition's part of the sketch."""

    COLUMNS = "segment int, part long, counts binary"

    def __init__(self):
        self.counts = np.zeros(COUNTERS, np.uint32)

    def add(self, members: np.ndarray) -> None:
        np.add.at(self.counts, (members & _U(COUNTERS - 1)).astype(np.int64), 1)

    def columns(self) -> list[pa.Array]:
        counts = np.minimum(self.counts, 65_535).astype(np.uint16).reshape(SEGMENTS, -1)
        rows = [(i, zlib.compress(c.tobytes(), 1)) for i, c in enumerate(counts) if c.any()]
        return [pa.array([i for i, _ in rows], pa.int32()), pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64()), pa.array([c for _, c in rows], pa.binary())]


def _heads(width: int):
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("segment", pa.int32()), ("part", pa.int64()), ("counts", pa.binary())])
        for batch in batches:
            n, node = [], []
            for _, members in sets_of(batch, width):
                counts.add(members)
                n.append(len(members))
                node.append(node_of(members))
            none = [pa.nulls(len(n), f.type) for f in list(schema)[3:]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(node, pa.int64()), *none], schema=schema)
        columns = counts.columns()
        yield pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), pa.int64())] * 3 + columns, schema=schema)

    return heads


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // SEGMENTS, np.uint32)
    for raw in table["counts"].to_pylist():
        total = np.minimum(total + np.frombuffer(zlib.decompress(raw), np.uint16), 65_535)
    return pa.table({"segment": table["segment"][:1], "part": table["part"][:1], "counts": pa.array([zlib.compress(total.astype(np.uint16).tobytes(), 1)], pa.binary())})


def summed(parts: DataFrame) -> bytes:
    """Sums the partitions' counters, at most 64 of a segment in one task at a time. The driver gets the sum, COUNTERS * 2 bytes."""
    most = parts.agg(F.max("part")).first()[0] or 0
    while most >= 64:
        most //= 64
        parts = parts.withColumn("part", F.floor(F.col("part") / 64).cast("long")).groupBy("segment", "part").applyInArrow(_add, Counts.COLUMNS)
    parts = parts.withColumn("part", F.lit(0).cast("long")).groupBy("segment", "part").applyInArrow(_add, Counts.COLUMNS)
    out = np.zeros((SEGMENTS, COUNTERS // SEGMENTS), np.uint16)
    for row in parts.collect():
        out[row["segment"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint16)
    return np.log2(np.maximum(out, 1)).astype(np.uint8).tobytes()


def first_members(members: np.ndarray, level: np.ndarray, num: int, den: int) -> np.ndarray:
    """The members of which a linking set has one as well, in the order of all members: by the sketch's level, then as they are."""
    order = np.lexsort((members, level[(members & _U(COUNTERS - 1)).astype(np.int64)]))
    return members[order[: prefix(len(members), num, den)]]


def _keys(width: int, num: int, den: int, limit: int, sketch):
    sizes: dict[int, list[tuple[int, int]]] = {}

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(sketch.value, np.uint8)
        seen: set[int] = set()  # copies that come soon after are not listed again
        for batch in batches:
            out: list[tuple] = []
            for _, members in sets_of(batch, width):
                n = len(members)
                node = node_of(members)
                if not n or node in seen:
                    continue
                if len(seen) >= COPIES:
                    seen.clear()
                seen.add(node)
                if n not in sizes:
                    sizes[n] = [(b, overlap(n, b, num, den)) for b in partners(n, num, den) if min(n, b) <= limit and not (b == n == overlap(n, b, num, den)) and overlap(n, b, num, den) <= min(n, b)]
                for b, share in sizes[n]:
                    tag = (min(n, b) << 32 | max(n, b)) * int(_PLACE[11])
                    for left in itertools.combinations(range(n), n - share):
                        kept = np.delete(members, left) if left else members
                        out.append((_one(int(mix(kept).sum(dtype=np.uint64)) + tag), node, n, True))
                if n > limit:
                    out.append((first_members(members, level, num, den), node, n, False))
                if len(out) >= 2_000:
                    yield list_rows(out)
                    out = []
            if out:
                yield list_rows(out)

    return keys


def list_rows(out: list[tuple[np.ndarray, int, int, bool]]) -> pa.RecordBatch:
    """(key, node, n, sure, pos) of (keys, node, n, sure); a key's place among a node's keys counts unless they are sure."""
    times = [len(x[0]) for x in out]
    node, n, sure = (np.repeat(np.array([x[i] for x in out], t), times) for i, t in ((1, np.int64), (2, np.int64), (3, bool)))
    pos = np.concatenate([np.zeros(k, np.int32) if x[3] else np.arange(k, dtype=np.int32) for x, k in zip(out, times, strict=True)])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out]).view(np.int64)), pa.array(node), pa.array(n), pa.array(sure), pa.array(pos)], names=["key", "node", "n", "sure", "pos"])


def _named(width: int):
    """(node, members) of the texts whose node is the wanted one: an id may come with several texts. The text stands for its set."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([node_of(m) for _, m in sets_of(batch, width)], np.int64) == batch["wanted"].to_numpy()
            yield pa.RecordBatch.from_arrays([batch["wanted"], batch["text"]], names=["node", "members"]).filter(pa.array(own))

    return named


def reach_similarity(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets, sorted, are as similar as num / den."""
    both = np.concatenate((a, b))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared * den >= (len(both) - shared) * num


def _linking(width: int, num: int, den: int):
    """Pairs (a, b, sa, sb) of texts whose sets reach the similarity."""

    def linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sides = [part[c].to_pylist() for c in ("sa", "sb")]
                texts = list(dict.fromkeys(sides[0] + sides[1]))
                sets = {texts[i]: m for i, m in sets_of(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), width)}
                yield part.select(["a", "b"]).filter(pa.array([reach_similarity(sets[x], sets[y], num, den) for x, y in zip(*sides, strict=True)], pa.bool_()))

    return linking


def _fits(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def listed_rows(source: DataFrame, rows, num: int, den: int, placed: bool = True) -> DataFrame:
    """What `rows` makes of source's batches, (key, node, n, sure, pos), where the list has partners for the row, with the list's length m.

    reach is the size of the largest partner that a row may have in its list. Where all rows are at place 0, placed is False.
    """
    alive = entries = sharing_rows(source, rows)
    alive = alive.withColumn("reach", F.expr(f"(n - pos) * {num + den}L div {num}L - n"))
    if placed:
        spans = alive.groupBy("key", "sure").agg(F.min("n").alias("least"), F.max("reach").alias("most"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").drop("lo", "hi")
        alive = materialize(alive.join(spans, ["key", "sure"]).where("reach >= least AND n <= most").drop("least", "most"), "alive")
        release(entries)
        entries = alive
    lists = alive.groupBy("key", "sure").agg(F.count("*").alias("m")).where("m > 1")
    listed = materialize(alive.join(lists, ["key", "sure"]), "listed")
    release(entries)
    return listed


def _starred(listed: DataFrame) -> DataFrame:
    """Rows of sure and of long lists with a pivot p each, PIVOTS rows for one of a long list.

    Pivots have the list's member far in front. A sure list's pivot is of its smallest size: the sets of that size link
    with all others, but larger ones need not link with each other.
    """
    star = listed.where(F.col("sure") | (F.col("m") > LONG))
    draws = [F.min(F.struct(F.when(F.col("sure"), F.col("n")).alias("size"), "pos", F.xxhash64(F.lit(j), "node"), "node", "n", "reach")).alias(f"p{j}") for j in range(PIVOTS)]
    pivots = star.groupBy("key", "sure").agg(*draws).withColumn("p", F.explode(F.when(F.col("sure"), F.array("p0")).otherwise(F.array(*[f"p{j}" for j in range(PIVOTS)]))))
    return star.join(pivots.select("key", "sure", "p").distinct(), ["key", "sure"])


def linked_nodes(listed: DataFrame, fetch: Callable[[DataFrame], tuple[DataFrame, list[DataFrame]]], verify: Callable[[DataFrame], DataFrame], num: int, den: int, relist: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Edges (a, b) between nodes of common lists that `verify` lets through; those within components may be left out. Releases listed.

    fetch: the sets (node, members) of the nodes asked for, (node), and the tables to release after them. verify: of (a, b, sa, sb), with both
    members, the (a, b) that link. relist: of the nodes (node) of long lists that aren't in one component yet, their listed
    rows in narrower lists, which have all their linking pairs in common; without it the long lists' open pairs are looked at.
    """
    may = lambda n, reach, n2, reach2: _fits(n, n2, num, den) & (n <= reach2) & (n2 <= reach)
    star = _starred(listed).where(may(F.col("n"), F.col("reach"), F.col("p.n"), F.col("p.reach")))
    short = listed.where(~F.col("sure") & (F.col("m") <= LONG)).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "node", "reach"))).alias("l"))
    partners_ = F.filter("l", lambda y: (y["node"] != F.col("x.node")) & (y["n"] >= F.col("x.n")) & may(y["n"], y["reach"], F.col("x.n"), F.col("x.reach")))
    short = short.select("l", F.explode("l").alias("x")).select("x", F.explode(partners_).alias("y"))
    pairs = star.select(*_pair(F.col("node"), F.col("p.node"))).unionByName(short.select(*_pair(F.col("x.node"), F.col("y.node"))))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.where("a != b").distinct(), "pairs")
        sets, behind = fetch(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
        side = lambda c: sets.select(F.col("node").alias(c), F.col("members").alias(f"s{c}"))
        out = materialize(verify(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")), "links")
        release(pairs, *behind)
        return out

    edges = verified(pairs)
    long = listed.where(~F.col("sure") & (F.col("m") > LONG))
    if not long.isEmpty():
        placed = _placed(long, edges)
        if relist is None:
            edges = edges.unionByName(verified(_open_pairs(placed, may)))
        else:
            nodes = materialize(_open(placed).select("node").distinct(), "open")
            if not nodes.isEmpty():
                edges = edges.unionByName(linked_nodes(relist(nodes), fetch, verify, num, den))
            release(nodes)
        release(placed)
    release(listed)
    return edges


def _pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _placed(long: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of long lists with their component, materialized."""
    found = components(edges).select(F.col("id").alias("node"), F.col("root").alias("component"))
    return materialize(long.select("key", "node", "n", "reach").join(found, "node", "left").select("key", "node", "n", "reach", F.coalesce("component", "node").alias("component")), "placed")


def _open(placed: DataFrame) -> DataFrame:
    """The rows of lists that have more than one component, with the largest one, `most`."""
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("c", "component"))["component"].alias("most"), F.count("*").alias("k")).where("k > 1").drop("k")
    return placed.join(largest, "key")


def _open_pairs(placed: DataFrame, may) -> DataFrame:
    """Pairs within long lists whose sets are in different components.

    A list's largest component is not paired with itself. Each set outside it first looks which of the list's sizes
    hold a partner that both places allow, and meets the sets of those sizes only.
    """
    outside = _open(placed).where("component != most").select("key", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("reach").alias("rx"), F.col("component").alias("cx"))
    tops = placed.groupBy("key", "n").agg(F.max("reach").alias("top"))
    asked = outside.join(tops, "key").where(may(F.col("nx"), F.col("rx"), F.col("n"), F.col("top"))).drop("top")
    met = asked.join(placed, ["key", "n"]).where((F.col("cx") != F.col("component")) & (F.col("nx") <= F.col("reach")))
    return met.select(*_pair(F.col("x"), F.col("node")))


def bounded(table: DataFrame, most: int = BROADCAST) -> DataFrame:
    """A materialized table to join with: broadcast if it has no more rows than that, else shuffled."""
    return table.hint("broadcast" if table.count() <= most else "merge")


def links(docs: DataFrame, nodes: DataFrame, sketch: bytes, width: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) between nodes. docs (id, text), nodes (node, n, rep)."""
    listed = listed_rows(docs.select("text"), _keys(width, num, den, boundary(num, den), docs.sparkSession.sparkContext.broadcast(sketch)), num, den)

    def fetch(wanted: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        needed = materialize(wanted.join(nodes.where("rep IS NOT NULL"), "node").select(F.col("rep").alias("id"), F.col("node").alias("wanted")), "needed")
        texts = docs.join(bounded(needed), "id").select("text", "wanted").mapInArrow(letting_go(_named(width)), "node long, members string")
        return texts.groupBy("node").agg(F.first("members").alias("members")), [needed]

    return linked_nodes(listed, fetch, lambda pairs: pairs.mapInArrow(letting_go(_linking(width, num, den)), "a long, b long"), num, den)


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id. Similarity num / den, sets of `width`-word shingles."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    both = materialize(slim.mapInArrow(letting_go(_heads(width)), "id long, n long, node long, segment int, part long, counts binary"), "heads")
    sketch = summed(both.where("counts IS NOT NULL").select("segment", "part", "counts"))
    heads = materialize(both.where("n IS NOT NULL").select("id", "n", "node"), "heads")
    release(both)
    nodes = materialize(heads.where("n > 0").groupBy("node", "n").agg(F.min("id").alias("rep")), "nodes")
    found = materialize(components(links(slim, nodes, sketch, width, num, den)), "found")
    tied = materialize(found.join(nodes, F.col("id") == F.col("node")).select("node", "root", "rep"), "tied")
    first = tied.groupBy("root").agg(F.min("rep").alias("component"))
    tied = tied.join(first, "root").select(F.col("node").alias("linked"), "component")
    placed = nodes.join(tied, F.col("node") == F.col("linked"), "left").select("node", "n", F.coalesce("component", "rep").alias("component"))
    placed = materialize(placed, "components")
    out = heads.join(placed, ["node", "n"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, all columns, with one document of each component: the one of the smallest id. Documents without words stay.

    Rows that repeat an id stay or go together: they stay if one of their texts does.
    """
    gone_id, stays = free_names(docs.columns, "gone_id", "stays")
    kept = F.max((F.col("n_shingles") == 0) | F.col("component_id").eqNullSafe(F.col("doc_id")))
    gone = joined(docs, id_col, text_col, width, num, den).groupBy(F.col("doc_id").alias(gone_id)).agg(kept.alias(stays)).where(~F.col(stays)).select(gone_id)
    return docs.join(bounded(materialize(gone, "gone")), docs[id_col].cast("long").eqNullSafe(F.col(gone_id)), "left_anti")
