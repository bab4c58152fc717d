"""Which rows of inverted lists share a key with another row, by an exchange of key hashes.

1. Each partition packs its rows (key, node, n, sure, pos) in chunks ("senders"), sorted and each row once. These are kept; a
   row has its node by its place among the chunk's nodes.
2. A sender sends each owner (a range of key hashes) the low 32 bits of its different hashes, ascending, and with each 32
   bits of the node that has it, or zero if several of its nodes have it.
3. An owner returns each sender a bitmap over what that one sent: which hashes came with different nodes, or with zero.
4. A sender lets go the rows whose hash is marked, or that share their key within the chunk.

Only hashes travel for most rows, eight bytes each, and a key has one hash for each sender, however many rows
it holds; copies of a node, whichever sender has them, don't share a key. Keys whose hashes meet by chance come
through as well: the rows that come out still have to be counted by their keys. Two nodes alone on a list are
lost to it if their 32 bits are equal.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import letting_go, materialize, release, shuffle_partitions

#: Rows of a sender, and hashes that an owner looks at together, on average at most.
CHUNK, OWNED = 1 << 17, 1 << 22
#: Rows whose bitmaps, one bit each, are broadcast; beyond, the chunks are shuffled to meet them.
REPLIES = 1 << 27
ROWS = "key long, node long, n long, sure boolean, pos int"
_U = np.uint64


def _hashes(keys: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Of (key, sure); the key is one already, so one turn spreads it over the owners."""
    h = keys.view(np.uint64) * _U(0x9E3779B97F4A7C15) + sure.astype(np.uint64)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def _chunk(sender: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    key, node, n = (table[c].to_numpy().astype(np.int64) for c in ("key", "node", "n"))
    sure, pos = table["sure"].to_numpy().astype(bool), table["pos"].to_numpy().astype(np.int32)
    runs = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))  # a node's rows come side by side
    nodes, first, who = np.unique(node[runs], return_index=True, return_inverse=True)
    first, who = runs[first], np.repeat(who, np.diff(runs, append=len(node)))
    h = _hashes(key, sure)
    order = np.argsort(h)
    key, who, sure, pos, h = key[order], who[order], sure[order], pos[order], h[order]
    new = np.ones(len(key), bool)  # copies that don't lie side by side stay
    new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (who[1:] != who[:-1]) | (sure[1:] != sure[:-1])
    columns = [pa.array([x.tobytes() if x.any() else b""], pa.binary()) for x in (sure[new], pos[new])]  # all zero, they aren't written
    columns = [pa.array([x.tobytes()], pa.binary()) for x in (key[new], who[new].astype(np.int32))] + columns + [pa.array([x.tobytes()], pa.binary()) for x in (nodes, n[first])]
    return pa.RecordBatch.from_arrays([pa.array([sender], pa.int64()), pa.array([int(new.sum())], pa.int64()), *columns], names=["sender", "size", "key", "who", "sure", "pos", "node", "n"])


def _pack(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in rows(batches):
            for at in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(at, CHUNK)
                if held and size + piece.num_rows > CHUNK:
                    yield _chunk(sender, held)
                    sender, held, size = sender + 1, [], 0
                held.append(piece)
                size += piece.num_rows
        if size:
            yield _chunk(sender, held)

    return pack


def _filled(raw: bytes, kind: type, size: int) -> np.ndarray:
    """A chunk's column that isn't written where it is all zero."""
    return np.frombuffer(raw, kind) if raw else np.zeros(size, kind)


def _different(key: bytes, sure: bytes, who: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's different hashes, ascending, which of them each row has, and whether several nodes have it."""
    of = np.frombuffer(who, np.int32)
    h = _hashes(np.frombuffer(key, np.int64), _filled(sure, bool, len(of)))
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    starts = np.flatnonzero(new)
    return h[starts], np.cumsum(new) - 1, np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)


def _bits_of(node: np.ndarray) -> np.ndarray:
    """32 bits of a node, never zero."""
    h = node.view(np.uint64) * _U(0xBF58476D1CE4E5B9)
    return np.maximum((h >> _U(32)).astype(np.uint32), np.uint32(1))


def _send(owners: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sender in enumerate(batch["sender"].to_pylist()):
                key, sure, who, node = (batch[c][i].as_py() for c in ("key", "sure", "who", "node"))
                hashes, of, several = _different(key, sure, who)
                first = np.flatnonzero(np.diff(of, prepend=-1))
                bits = _bits_of(np.frombuffer(node, np.int64))[np.frombuffer(who, np.int32)[first]]
                bits[several] = 0
                owner = ((hashes >> _U(32)) * _U(owners) >> _U(32)).astype(np.int64)
                low = (hashes & _U(0xFFFFFFFF)).astype(np.uint32)
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                cuts = list(zip(starts, [*starts[1:], len(low)], strict=True))
                sent, nodes = ([x[a:b].tobytes() for a, b in cuts] for x in (low, bits))
                yield pa.RecordBatch.from_arrays([pa.array(owner[starts]), pa.array([sender] * len(sent), pa.int64()), pa.array(sent, pa.binary()), pa.array(nodes, pa.binary())], names=["owner", "sender", "sent", "nodes"])

    return send


def _mark(table: pa.Table) -> pa.Table:
    # several of a sender's hashes may have the same low bits; that only marks more
    sent, nodes = ([np.frombuffer(x, np.uint32) for x in table[c].to_pylist()] for c in ("sent", "nodes"))
    every = np.concatenate(sent).astype(np.uint64) << _U(32) | np.concatenate(nodes)
    every.sort()
    low, node = every >> _U(32), every & _U(0xFFFFFFFF)
    same = low[1:] == low[:-1]
    twice = np.unique(low[1:][same & ((node[1:] != node[:-1]) | (node[1:] == 0))]).astype(np.uint32)
    at = [np.searchsorted(twice, x) for x in sent]
    bits = [np.packbits((i < len(twice)) & (twice[np.minimum(i, len(twice) - 1)] == x)).tobytes() if len(twice) else bytes(-(-len(x) // 8)) for i, x in zip(at, sent, strict=True)]
    return pa.table({"sender": table["sender"], "owner": table["owner"], "n_sent": pa.array([len(x) for x in sent], pa.int32()), "bits": pa.array(bits, pa.binary())})


def _let_go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            key, sure, own = (batch[c][i].as_py() for c in ("key", "sure", "who"))
            who, node, n = (np.frombuffer(batch[c][i].as_py(), t) for c, t in (("who", np.int32), ("node", np.int64), ("n", np.int64)))
            pos = _filled(batch["pos"][i].as_py(), np.int32, len(who))
            _, of, several = _different(key, sure, own)
            replies = sorted(batch["replies"][i].as_py(), key=lambda r: r["owner"])
            marked = np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: r["n_sent"]] for r in replies]).astype(bool)
            go = (marked | several)[of]
            columns = [np.frombuffer(key, np.int64)[go], node[who[go]], n[who[go]], _filled(sure, bool, len(who))[go], pos[go]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "node", "n", "sure", "pos"])


def sharing_rows(source: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Of what `rows` makes of source's batches, (key, node, n, sure, pos), those that may share (key, sure) with a row of another node, each once.

    A node has one n, and one pos with a key.
    """
    packed = materialize(source.mapInArrow(letting_go(_pack(rows)), "sender long, size long, key binary, who binary, sure binary, pos binary, node binary, n binary"), "packed")
    total = packed.agg(F.sum("size")).first()[0] or 0
    owners = max(1, min(shuffle_partitions(source.sparkSession), math.ceil(total / 1024)), math.ceil(total / OWNED))
    messages = packed.select("sender", "key", "sure", "who", "node").mapInArrow(letting_go(_send(owners)), "owner long, sender long, sent binary, nodes binary")
    replies = messages.groupBy("owner").applyInArrow(_mark, "sender long, owner long, n_sent int, bits binary")
    replies = materialize(replies.groupBy("sender").agg(F.collect_list(F.struct("owner", "n_sent", "bits")).alias("replies")), "replies")
    rows = packed.drop("size").join(replies.hint("broadcast" if total <= REPLIES else "merge"), "sender").mapInArrow(letting_go(_let_go), ROWS)
    out = materialize(rows.groupBy("key", "sure", "node").agg(F.min("n").alias("n"), F.min("pos").alias("pos")), "entries")
    release(packed, replies)
    return out
