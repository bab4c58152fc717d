"""Language identification with spans.

A word is a run of letters, lower-cased. The script range of its letters narrows the languages that may have
written it: those whose training words use that script in at least MIN_SCRIPT of cases. Each candidate scores
the word by the log-likelihood of its letter n-grams, up to three letters with the word's borders, hashed to
BUCKETS. Viterbi over a text's words, with a penalty for each switch of language, labels spans. The text's
language is the one whose spans hold most letters; its score is their share of all letters.

A text that is null or has no letter is `und` with score 0, as is every text if nothing was learned.
Words that no learned script fits speak for no language but do not end a span; if a text has only such
words, all languages are candidates. Of equally long languages the first by code point wins. Rows that
repeat are judged each; an empty table gives no rows; columns but the text are not looked at.

Learning: counts of n-grams in labelled texts, the ones whose ids hash lowest (of null ids, their texts), whole. Of all
labelled rows at most about SAMPLE are taken, but of each language about EACH, or all if it has fewer, and one at
least: every labelled language is learned, from at most about SAMPLE + EACH x languages texts. Rows of the same hash
go together. A language's counts are one dense table of BUCKETS and scripts, whole at every size. Very long texts are read
whole.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, let_go, letting_go

#: Labelled texts that the model is fitted on, about, at most; and those of each language, about, at least.
SAMPLE, EACH = 6_000, 200
BUCKETS = 1 << 18
#: Log-likelihood that a switch of language costs; most that a word can speak for a language against another.
SWITCH, CLIP = 14.0, 9.0
MIN_SCRIPT = 0.02
#: First code points of scripts, ascending; what lies between belongs to the script before.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0x20000, "han"), (0x323B0, "other"),
)
NAMES = sorted({name for _, name in SCRIPTS})
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """For every code point whether it is a letter, and its script's place in NAMES."""
    if not _TABLES:
        letter = np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), bool)
        script = np.zeros(0x110000, np.uint8)
        for first, name in SCRIPTS:
            script[first:] = NAMES.index(name)
        _TABLES.extend((letter, script))
    return _TABLES


class Words:
    """A text's words: where they start and end, their scripts, and for each code point the buckets of the n-grams that end there."""

    def __init__(self, text: str):
        letter, script = _tables()
        codes = np.frombuffer(f"  {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
        mine = letter[codes]
        edge = np.flatnonzero(np.diff(mine.view(np.int8)))
        self.starts, self.ends = edge[0::2] + 1, edge[1::2] + 1
        if not len(self.starts):
            return
        c = np.where(mine, codes, np.uint32(32))
        shift = np.uint32(32 - BUCKETS.bit_length() + 1)
        two = c[1:] * np.uint32(0x9E3779B1) + c[:-1] * np.uint32(0x85EBCA77)
        three = two[1:] + c[:-2] * np.uint32(0xC2B2AE3D)
        scramble = lambda h, k: (((h + np.uint32(k)) ^ ((h + np.uint32(k)) >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift
        self.one, self.two, self.three = scramble(c[2:] * np.uint32(0x27D4EB2F), 1), scramble(two[1:], 2), scramble(three, 3)  # at code point i: [i - 2]
        kinds = script[codes]
        self.scripts = kinds[self.starts]
        # the script of most letters, where they differ
        differ = np.flatnonzero(np.diff(kinds) & mine[1:] & mine[:-1]) + 1
        for w in np.unique(np.searchsorted(self.starts, differ, "right") - 1):
            self.scripts[w] = np.bincount(kinds[self.starts[w] : self.ends[w]]).argmax()

    def rows(self) -> np.ndarray:
        """Buckets of all n-grams of all words: letters, and pairs and triples with one border."""
        n = len(self.one)
        inside = np.zeros(n + 4, np.int8)
        inside[self.starts] += 1
        inside[self.ends] -= 1
        letter = np.cumsum(inside)[2 : n + 2] > 0
        border = np.zeros(n, bool)
        border[self.ends - 2] = True
        first = np.zeros(n, bool)
        first[self.starts - 2] = True
        return np.concatenate([self.one[letter], self.two[letter | border], self.three[(letter | border) & ~first]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of buckets, and below 0 of scripts, by language within a partition."""
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words = Words(text or "")
            if len(words.starts):
                own = seen.setdefault(lang, np.zeros(BUCKETS + 256, np.int64))
                own[:BUCKETS] += np.bincount(words.rows(), minlength=BUCKETS)
                own[BUCKETS:] += np.bincount(words.scripts, minlength=256)
    for lang, own in seen.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(np.where(at < BUCKETS, at, BUCKETS - 1 - at)), pa.array(own[at])], names=["lang", "bucket", "n"])


def _dense(table: pa.Table) -> pa.Table:
    """A language's counts, BUCKETS + 256 rows at most, as one array."""
    own = np.zeros(BUCKETS + 256, np.int64)
    at = table["bucket"].to_numpy()
    own[np.where(at >= 0, at, BUCKETS - 1 - at)] = table["n"].to_numpy()
    return pa.table({"lang": table["lang"][:1], "counts": pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())})


class Model:
    """Log-likelihoods of buckets by language, from each language's counts: of BUCKETS, then of 256 scripts."""

    def __init__(self, counted: dict[str, np.ndarray]):
        self.langs = sorted(counted)
        every = np.stack([counted[x] for x in self.langs], axis=1).astype(float) if counted else np.zeros((BUCKETS + 256, 0))
        counts, scripts = every[:BUCKETS], every[BUCKETS:]
        used = max(1, int((counts.sum(axis=1) > 0).sum()))
        table = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * used))
        table[counts.sum(axis=1) == 0] = 0.0
        self.table = (table / 3).astype(np.float32)
        self.allowed = scripts / np.maximum(scripts.sum(axis=0), 1) >= MIN_SCRIPT

    def scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words x languages, 0 for a word's best language and less for others; and which words speak for any."""
        each = self.table[words.two]
        each += self.table[words.three]
        each += self.table[words.one]
        # a word's end is a border with no letter of its own, its first letter has no triple
        each[words.ends - 2] -= self.table[words.one[words.ends - 2]]
        each[words.starts - 2] -= self.table[words.three[words.starts - 2]]
        sums = np.concatenate((np.zeros((1, each.shape[1])), np.cumsum(each, axis=0, dtype=np.float64)))
        own = sums[words.ends - 1] - sums[words.starts - 2]
        allowed = self.allowed[words.scripts]
        known = allowed.any(axis=1)
        if not known.all():
            allowed[~known] = True
            own[~known] = 0.0
        own[~allowed] = -np.inf
        return np.maximum(own - own.max(axis=1, keepdims=True), -CLIP), known


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The labels of the best path through scores (words x languages), each switch costing `switch`.

    First the one label that is best throughout: no path with switches is better if no segment of any other gains
    more than one switch over it, and a segment from the start and one to the end don't either together, as a path
    without that label has one switch less than segments. Only otherwise are all paths followed.
    """
    n, k = scores.shape
    best = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, [best]], axis=0)
    low = np.concatenate([np.zeros((1, k)), np.minimum(np.minimum.accumulate(gain[:-1], axis=0), 0)])
    within = gain - low
    if within.max() <= switch and gain.max() + within[-1].max() <= switch:
        return np.full(n, best)
    came = np.empty((n, k), np.int32)
    path = [0.0] * k
    for i, row in enumerate(scores.tolist()):
        top = max(path)
        which = path.index(top)
        new = top - switch
        for j in range(k):
            if path[j] >= new:
                came[i, j] = j
                path[j] += row[j]
            else:
                came[i, j] = which
                path[j] = new + row[j]
    out = np.empty(n, np.int64)
    at = path.index(max(path))
    for i in range(n - 1, -1, -1):
        out[i] = at
        at = came[i, at]
    return out


def judge(model: Model, text: str | None) -> tuple[str, float, float, list[tuple[str, int]]]:
    """Language, score, the share of letters in words that a learned script fits, and spans (language, letters) of a text."""
    words = Words(text or "")
    if not len(words.starts) or not model.langs:
        return "und", 0.0, 0.0, []
    scores, known = model.scores(words)
    path = viterbi(scores, SWITCH)
    weight = words.ends - words.starts
    fitting = float(weight[known].sum() / weight.sum())
    if known.any():
        weight = weight * known
    held = np.bincount(path, weight, len(model.langs))
    best = int(held.argmax())
    starts = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1))
    sums = np.add.reduceat(weight, starts)
    return model.langs[best], float(held[best] / weight.sum()), fitting, [(model.langs[int(path[s])], int(w)) for s, w in zip(starts, sums, strict=True)]


def label(model: Model, text: str | None) -> tuple[str, float, list[tuple[str, int]]]:
    """Language, score and spans (language, letters) of a text."""
    lang, score, _, spans = judge(model, text)
    return lang, score, spans


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fits a model on labelled rows, a sample of about `sample` texts, and EACH of each language. The driver gets one row for each language, with its dense counts, BUCKETS longs at most."""
    key = F.col(id_col).cast("string")
    draw = F.xxhash64(F.lit(7), key, F.when(key.isNull(), F.col(text_col))).bitwiseAND(0xFFFFFF)
    known = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("first")).collect()
    if not sizes:
        return Model({})
    rate = sample / sum(r["n"] for r in sizes)
    below = [(r["lang"], max(r["first"] + 1, int((1 << 24) * min(1.0, max(rate, EACH / r["n"]))))) for r in sizes]
    below = labelled.sparkSession.createDataFrame(below, "lang string, below long")
    part = known.join(F.broadcast(below), "lang").where("draw < below").select("lang", "text")
    counts = part.mapInArrow(letting_go(_count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").applyInArrow(_dense, "lang string, counts binary").collect()
    return Model({r["lang"]: np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in rows})


_MODELS: dict[str, Model] = {}


def _judged(docs: DataFrame, model: Model, text_col: str) -> tuple[DataFrame, str]:
    """docs with a struct of its own name (lang_pred, score, fitting, spans), and the name; nothing is shuffled."""
    raw = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    key = uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double, fitting double, spans array<struct<lang:string,letters:long>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        if (own := _MODELS.get(key)) is None:
            _MODELS.clear()  # a worker outlives the queries that it has worked for
            own = _MODELS[key] = pickle.loads(raw.value)
        out = []
        for text in texts:
            lang, score, fitting, spans = judge(own, text)
            out.append((lang, score, fitting, [{"lang": a, "letters": b} for a, b in spans]))
        let_go()
        return pd.DataFrame(out, columns=["lang_pred", "score", "fitting", "spans"])

    (name,) = free_names(docs.columns, "found")
    return docs.withColumn(name, run(F.col(text_col))), name


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and spans (array of lang, letters) added; nothing is shuffled. Other columns of these names are replaced."""
    found, name = _judged(docs, model, text_col)
    return found.withColumns({c: F.col(f"{name}.{c}") for c in ("lang_pred", "score", "spans")}).drop(name)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def predict(docs: DataFrame) -> DataFrame:
    """The contract's columns: learned from the rows that are not held out, applied to all."""
    model = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def identified_documents(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs, all columns, without texts that are `und` or have less than `least` of their letters in words that a learned script fits. Texts in several languages stay."""
    found, name = _judged(docs, learn(docs.where(~held_out())), "text")
    return found.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.fitting") >= least)).select(*docs.columns)
