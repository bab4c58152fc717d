"""Suffix-array dedup: bytes within repeated strings of LENGTH bytes go.

A string's anchor is the 32-byte gram of least hash in it, so equal strings have their anchors at the same
place. The window starts that share an anchor span a piece, about 270 bytes.

1. Pieces are counted by their bytes and by their anchors. A piece that occurs twice is repeated throughout;
   a piece whose anchor occurs once is not repeated anywhere. The others are open.
2. Open pieces meet, by anchor, one specimen of each repeated piece of that anchor. Aligned at the anchor, they
   become strings of 8-byte blocks. Their suffix array comes from the linear grouping construction: suffixes
   are grouped by first block; groups are taken in descending order; each suffix points to the previous
   suffix in a lower group; a group's pointed-at suffixes leave their own groups for new ones right behind,
   by how often they are pointed at. The groups then are those of the suffixes' Lyndon prefixes, and one
   pass from the least suffix along these pointers emits the order within each group. Nothing is renamed
   and there is no recursion.
3. Neighbours that share 24 blocks share 192 bytes of a window; the 8 bytes around these, compared as they
   are, decide. So the windows of open pieces are judged on their bytes; that two pieces are the same is known by
   a 64-bit hash of their bytes.

Anchors with more than SPLIT different pieces are split by where a window lies about the anchor and by the
bytes that all windows there share, which equal windows have in common.

A null text is empty. Matches do not cross documents; rows that repeat are documents of their own. An
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_filter, materialize, passes, shuffle_partitions

LENGTH, GRAM, BLOCK = 200, 32, 8
#: Different pieces of an anchor beyond which it is split, and the width in bytes of a split's range of window starts.
SPLIT, RANGE = 512, 21
#: Bytes of pieces of one suffix array, about.
SHARD = 1 << 18
_U = np.uint64
_GEAR = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)


def grams(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of data[i:i + width] for every i, by doubling; width is a power of two."""
    h, done, base = _GEAR[data], 1, 0x9E3779B97F4A7C15
    while done < width:
        h = h[:-done] * _U(pow(base, done, 1 << 64)) + h[done:]
        done *= 2
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in order: their places, the first and last window start of each, and their hashes. The leftmost of equal grams counts."""
    if len(data) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    h = grams(data, GRAM)
    span = LENGTH - GRAM + 1  # grams of a window
    best, done = (h & ~_U(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64), 1
    while done * 2 <= span:
        best = np.minimum(best[:-done], best[done:])
        done *= 2
    n = len(data) - LENGTH + 1
    place = (np.minimum(best[:n], best[span - done : span - done + n]) & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return place[first], first, np.append(first[1:], n) - 1, h[place[first]]


def piece_hashes(raw: bytes, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(raw[a : b + LENGTH]) for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True)], np.uint64)


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a list of integers, by the linear grouping construction. A suffix sorts before those that it begins."""
    n = len(text)
    if n < 2:
        return list(range(n))
    order = np.argsort(np.array(text), kind="stable").tolist()
    at, group, end = [0] * n, [0] * n, [0] * (n + 1)  # place in order; start of the group; a group's end by its start
    start = 0
    for i, s in enumerate(order):
        at[s] = i
        if i and text[s] != text[order[i - 1]]:
            end[start] = i
            start = i
        group[s] = start
    end[start] = n
    prev = [-1] * n
    high = n
    while high:
        low = group[order[high - 1]]
        members = order[low:high]
        if high - low > 1:
            members.sort()
        counts: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        if counts:
            by_count: dict[int, list[int]] = {}
            for p, c in counts.items():
                by_count.setdefault(c, []).append(p)
            for c in sorted(by_count, reverse=True):
                moved: dict[int, list[int]] = {}
                for p in by_count[c]:
                    moved.setdefault(group[p], []).append(p)
                for old, those in moved.items():
                    stop = end[old]
                    new = stop - len(those)
                    if new == old:  # the whole group: it stays where it is
                        continue
                    put = stop
                    for p in those:  # to the group's end
                        put -= 1
                        other, here = order[put], at[p]
                        order[put], order[here] = p, other
                        at[p], at[other] = put, here
                    end[old], end[new] = new, stop
                    for p in those:
                        group[p] = new
        high = low
    # the end of the text is the least suffix; from each suffix found, the one before it and along its pointers come first in their groups
    out: list[int] = [-1] * n
    front = {}
    placed = bytearray(n)
    i, s = -1, n
    while True:
        p = s - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            slot = front.get(g, g)
            out[slot] = p
            front[g] = slot + 1
            placed[p] = 1
            p = prev[p]
        i += 1
        if i == n:
            return out
        s = out[i]


def repeated_windows(pieces: list[tuple[int, bytes, int, int, int]]) -> list[np.ndarray]:
    """For each piece (key, bytes, anchor in it, first and last window start in it): which of its windows occur in another piece of its key."""
    run = (LENGTH - BLOCK + 1) // BLOCK
    words, owner, block_at = [], [], []
    for i, (_, raw, anchor, _, _) in enumerate(pieces):
        skip = anchor % BLOCK
        count = (len(raw) - skip) // BLOCK
        words.append(np.frombuffer(raw, "<u8", count, skip))
        owner.append(np.full(count + 1, i))
        block_at.append(np.append((np.arange(count) * BLOCK + skip), -1))
    keys = np.concatenate([np.full(len(w), p[0], np.int64) for w, p in zip(words, pieces, strict=True)])
    place = np.concatenate([b[:-1] - p[2] for b, p in zip(block_at, pieces, strict=True)])
    flat = np.concatenate(words)
    # a block's symbol: its key, its place about the anchor and its bytes
    rank = np.lexsort((flat, place, keys))
    changed = np.ones(len(rank), bool)
    changed[1:] = (flat[rank[1:]] != flat[rank[:-1]]) | (place[rank[1:]] != place[rank[:-1]]) | (keys[rank[1:]] != keys[rank[:-1]])
    symbol = np.empty(len(rank), np.int64)
    symbol[rank] = np.cumsum(changed) + len(pieces)
    lengths = np.array([len(w) for w in words])
    ends = np.cumsum(lengths + 1) - 1
    text = np.zeros(len(symbol) + len(pieces), np.int64)
    inner = np.ones(len(text), bool)
    inner[ends] = False
    text[inner] = symbol
    text[ends] = np.arange(len(pieces))  # each end its own
    owner, block_at = np.concatenate(owner), np.concatenate(block_at)
    array = np.array(suffix_array(text.tolist()))
    # classes of neighbours that share a run
    ok = array + run <= len(text)
    same = ok[1:] & ok[:-1]
    for j in range(run):
        at = np.flatnonzero(same)
        same[at] = text[array[at] + j] == text[array[at + 1] + j]
        if not same.any():
            break
    label = np.cumsum(np.concatenate(([True], ~same)))
    member = np.zeros(len(array), bool)
    member[1:] |= same
    member[:-1] |= same
    marks = [np.zeros(p[4] - p[3] + 1, bool) for p in pieces]
    at = array[member]
    if not len(at):
        return marks
    label, who, start = label[member], owner[at], block_at[at]
    data = np.frombuffer(b"".join(p[1] for p in pieces) + b"\0" * BLOCK, np.uint8)
    base = np.concatenate(([0], np.cumsum([len(p[1]) for p in pieces])))[who]
    size, first, last = (np.array(x)[who] for x in ([len(p[1]) for p in pieces], [p[3] for p in pieces], [p[4] for p in pieces]))
    for d in range(BLOCK):
        # windows that begin d bytes before the run: its bytes, d before it and the rest behind
        w = start - d
        fine = np.flatnonzero((w >= first) & (w <= last) & (w + LENGTH <= size))
        if not len(fine):
            continue
        left = base[fine] + w[fine]
        right = left + d + run * BLOCK
        rest = np.zeros(len(fine), np.uint64)
        for j in range(LENGTH - run * BLOCK):
            rest = rest << _U(8) | data[(left + j) if j < d else (right + j - d)].astype(np.uint64)
        order = np.lexsort((rest, label[fine]))
        a, b = order[:-1], order[1:]
        equal = (rest[a] == rest[b]) & (label[fine][a] == label[fine][b])
        hit = np.unique(np.concatenate((a[equal], b[equal])))
        for x in fine[hit].tolist():
            marks[who[x]][w[x] - first[x]] = True
    return marks


def _read(batch: pa.RecordBatch):
    for row, text in enumerate(batch["text"].to_pylist()):
        raw = (text or "").encode()
        yield row, raw, *anchors(np.frombuffer(raw, np.uint8))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, piece, n) of a batch."""
    for batch in batches:
        found, prints = [], []
        for _, raw, _, firsts, lasts, hashes in _read(batch):
            found.append(hashes)
            prints.append(piece_hashes(raw, firsts, lasts))
        if found:
            hashes, prints = np.concatenate(found), np.concatenate(prints)
            values, at, counts = np.unique(prints, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(values.view(np.int64)), pa.array(counts)], names=["anchor", "piece", "n"])


def _occurrences(bits):
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, row, k, piece) for pieces that pass the filter."""
        for batch in batches:
            rows, ks, pieces = [], [], []
            for row, raw, _, firsts, lasts, _ in _read(batch):
                prints = piece_hashes(raw, firsts, lasts)
                at = np.flatnonzero(passes(bits.value, prints))
                rows.append(np.full(len(at), row))
                ks.append(at)
                pieces.append(prints[at])
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(take), batch["row"].take(take), pa.array(np.concatenate(ks), pa.int32()), pa.array(np.concatenate(pieces).view(np.int64))], names=["doc_id", "row", "k", "piece"])

    return occurrences


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces that are needed, of split anchors in ranges of window starts: (key, piece, open, doc_id, row, k, raw, anchor, first, last, shift)."""
    schema = pa.schema([("key", pa.int64()), ("piece", pa.int64()), ("open", pa.bool_()), ("doc_id", pa.int64()), ("row", pa.int64()), ("k", pa.int32()), ("raw", pa.binary()), ("anchor", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("shift", pa.int32())])
    for batch in batches:
        rows: list[tuple] = []
        flags = batch["flags"].to_pylist()
        for row, raw, places, firsts, lasts, hashes in _read(batch):
            for f in flags[row]:
                if not f["needed"]:
                    continue
                k = f["k"]
                a, first, last = int(places[k]), int(firsts[k]), int(lasts[k])
                who = (batch["doc_id"][row].as_py(), batch["row"][row].as_py(), k) if f["open"] else (None, None, None)
                key = int(hashes[k : k + 1].view(np.int64)[0])
                if not f["split"]:
                    part = raw[first : last + LENGTH]
                    rows.append((key, f["piece"], f["open"], *who, part, a - first, 0, last - first, 0))
                    continue
                for j in range((a - last) // RANGE, (a - first) // RANGE + 1):
                    low, high = max(first, a - RANGE * (j + 1) + 1), min(last, a - RANGE * j)
                    core = raw[a - RANGE * j : a - RANGE * (j + 1) + 1 + LENGTH]
                    own = xxhash.xxh3_64_intdigest(core, key & 0xFFFFFFFF ^ j)
                    part = raw[low : high + LENGTH]
                    name = f["piece"] if f["open"] else xxhash.xxh3_64_intdigest(part) - (1 << 63)
                    rows.append((own - (1 << 63), name, f["open"], *who, part, a - low, 0, high - low, low - first))
            if len(rows) >= 4_096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by key to (doc_id, row, k, shift, marks) of the open ones, a suffix array for each SHARD bytes of whole keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("k", pa.int32()), ("shift", pa.int32()), ("marks", pa.binary())])

    def judged(rows: list[dict]) -> pa.RecordBatch:
        marks = repeated_windows([(r["key"], r["raw"], r["anchor"], r["first"], r["last"]) for r in rows])
        out = [(r["doc_id"], r["row"], r["k"], r["shift"], m.astype(np.uint8).tobytes()) for r, m in zip(rows, marks, strict=True) if r["open"] and m.any()]
        columns = zip(*out, strict=True) if out else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    shard: list[dict] = []
    key_rows: list[dict] = []
    size = 0
    for batch in batches:
        for r in batch.to_pylist():
            if key_rows and r["key"] != key_rows[0]["key"]:
                if len(key_rows) > 1:  # alone, a piece has no partner
                    shard += key_rows
                    size += sum(len(x["raw"]) for x in key_rows)
                key_rows = []
                if size >= SHARD:
                    yield judged(shard)
                    shard, size = [], 0
            key_rows.append(r)
    if len(key_rows) > 1:
        shard += key_rows
    if shard:
        yield judged(shard)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flags = batch["flags"].to_pylist()
        marks = batch["marks"].to_pylist() if "marks" in batch.schema.names else [None] * batch.num_rows
        out = []
        for row, raw, _, firsts, lasts, _ in _read(batch):
            edge = np.zeros(len(raw) + 1, np.int32)
            for f in flags[row]:
                if not f["open"]:
                    edge[firsts[f["k"]]] += 1
                    edge[lasts[f["k"]] + LENGTH] -= 1
            for m in marks[row] or []:
                at = firsts[m["k"]] + m["shift"] + np.flatnonzero(np.frombuffer(m["marks"], np.uint8))
                edge[at] += 1
                np.subtract.at(edge, at + LENGTH, 1)
            gone = np.cumsum(edge)[:-1] > 0
            spans = int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=0) == 1))
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = slim.withColumn("row", F.xxhash64("doc_id", "text"))  # with doc_id names a row, or rows that are the same

    counted = slim.select("text").mapInArrow(_counted, "anchor long, piece long, n long").repartition(n, "anchor")
    pieces = counted.groupBy("anchor", "piece").agg(F.sum("n").alias("c"))
    by_anchor = counted.groupBy("anchor").agg(F.sum("n").alias("total"), F.count_distinct("piece").alias("m")).where("total > 1")
    status = pieces.join(by_anchor, "anchor").select("piece", (F.col("c") == 1).alias("open"), F.when(F.col("m") > 1, True).otherwise(False).alias("needed"), (F.col("m") > SPLIT).alias("split"))
    status = materialize(status, "status")

    bits = hash_filter(status, "piece")
    found = slim.mapInArrow(_occurrences(spark.sparkContext.broadcast(bits)), "doc_id long, row long, k int, piece long").join(status, "piece")
    flags = found.groupBy("doc_id", "row", "k").agg(F.first(F.struct("piece", "open", "needed", "split")).alias("f"))
    flags = flags.groupBy("doc_id", "row").agg(F.collect_list(F.struct("k", "f.piece", "f.open", "f.needed", "f.split")).alias("flags"))
    flags = materialize(flags.withColumn("some_open", F.exists("flags", lambda f: f["open"])), "flags")

    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row"] == b["row"])
    flagged = materialize(slim.join(flags.hint("merge"), same(slim, flags)).select(slim["doc_id"], slim["row"], "text", "flags", "some_open"), "flagged")

    sent = flagged.where(F.exists("flags", lambda f: f["needed"])).select("doc_id", "row", "text", "flags").mapInArrow(
        _pieces, "key long, piece long, open boolean, doc_id long, row long, k int, raw binary, anchor int, first int, last int, shift int"
    )
    specimens = sent.groupBy("key", "piece", "open", "doc_id", "row", "k", "shift").agg(*(F.first(c).alias(c) for c in ("raw", "anchor", "first", "last")))
    verdicts = specimens.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_judge, "doc_id long, row long, k int, shift int, marks binary")
    verdicts = materialize(verdicts.groupBy("doc_id", "row").agg(F.collect_list(F.struct("k", "shift", "marks")).alias("marks")), "verdicts")

    whole = flagged.where("NOT some_open").select("doc_id", "text", "flags").mapInArrow(_cut, CUT)
    partly = flagged.where("some_open")
    partly = partly.join(verdicts.hint("merge"), same(partly, verdicts), "left").select(partly["doc_id"], "text", "flags", "marks").mapInArrow(_cut, CUT)
    plain = slim.select("doc_id", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256"))
    keys = flags.select("doc_id", "row")
    plain = plain.join(keys, same(plain, keys), "left_anti").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256")
    return whole.unionByName(partly).unionByName(plain)
