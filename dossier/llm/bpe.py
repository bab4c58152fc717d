"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

Every prefix of a word has one last token: the token t that ends there such that the last token before
it and t, encoded together, stay those two. So the encoding of a prefix follows from those of the
prefixes at most one token's length behind, and the transducer holds these only. A token is stable, and
leaves, once the encodings of all prefixes still open agree on it. `lookahead` bounds how far that can
lie behind: no more merges than the list has can run over a boundary, each no longer than the longest
token. That bounds the memory whatever a word's length; in practice tokens leave after a few symbols.

Every word goes through the transducer; a worker keeps the ids that it gave for recent words, and where it stood after
common beginnings of words.

Decoding is a state machine as well: ids go in one by one, text comes out as soon as it is certain.
With a tokenizer file without a decoder the text is the tokens' strings joined by spaces, as the
tokenizers library gives it; `byte_text` inverts the byte alphabet and holds back incomplete UTF-8.

A null text is empty: no tokens, empty decoded text. Rows that repeat are encoded each. Other columns
are not looked at.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, letting_go

#: Words that a worker's memo takes before the ones of before go; pairs of tokens, and states, that it knows.
MEMO, PAIRS, STATES = 120_000, 200_000, 50_000
#: Symbols between two looks for stable tokens; first symbols whose state is kept.
STEP, AHEAD = 512, 6
#: Longer words pass the memo by.
MEMO_CHARS = 200
_NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Ends(dict):
    """Three symbols, or fewer, to the lengths of the tokens that end in them or are part of their end, first the one that was right last time."""

    def __missing__(self, end: str) -> tuple[int, ...]:
        found = self[end[1:]] if len(end) > 1 else ()
        if len(self) < PAIRS:
            self[end] = found
        return found

    def right(self, end: str, k: int) -> None:
        if end in self:
            self[end] = (k, *[x for x in self[end] if x != k])


def _ends(tokens: set[str]) -> _Ends:
    lengths: dict[str, set[int]] = {}
    for t in tokens:
        for k in range(1, min(len(t), 3) + 1):
            lengths.setdefault(t[-k:], set()).add(len(t))
    # a longer end knows its own tokens and the shorter ones that it ends in
    return _Ends({end: tuple(sorted(own | {k for j in range(1, len(end)) for k in lengths.get(end[-j:], ()) if k <= j}, reverse=True)) for end, own in lengths.items()})


class Bpe:
    """A tokenizers file of kind BPE with word ends, NFC and lower case, byte alphabet, and special tokens."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.bytes = "".join(byte_alphabet())
        self.unbytes = {c: b for b, c in enumerate(byte_alphabet())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(regex.sub(r"\[(\\p\{\w+\})\]", r"\1", split))  # a class by itself is matched faster without brackets
        self.made = {a + b: (a, b, i) for (a, b), i in sorted(self.rank.items(), key=lambda x: -x[1])}  # the first merge that makes a token
        self.spines: tuple[dict, dict] = {}, {}
        # tokens that encode to themselves, by whether they end a word; others are never output. For each, whether it and tokens before it stay
        self.inner: dict[str, dict[str, bool]] = {}
        self.final: dict[str, dict[str, bool]] = {}
        self.borders = 0  # of which this is known
        for token in self.vocab:
            if token.endswith(self.end) and self.end and token != self.end:
                if self.merge([*token[: -len(self.end) - 1], token[-len(self.end) - 1 :]]) == [token]:
                    self.final[token] = {}
            elif self.merge(list(token)) == [token]:
                self.inner[token] = {}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.inner | self.final)
        # lengths of the tokens that end in these symbols (three, or all of a shorter start); no other start needs a look, and one alone is right
        self.inner_ends, self.final_ends = _ends(set(self.inner)), _ends({t[: -len(self.end)] if self.end else t for t in self.final})
        self.lookahead = len(pairs) * self.longest
        self.states: dict[str, tuple[tuple, tuple]] = {}  # where the transducer stands after a word's first AHEAD symbols
        self.written = {i: str(i) for i in self.text}
        self.memo = _Memo(self)

    def merge(self, symbols: list[str]) -> list[str]:
        """The definition: the merge of least rank, leftmost first, until none applies. For short sequences."""
        while len(symbols) > 1:
            best, i = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == len(self.rank):
                break
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
        return symbols

    def spine(self, token: str, left: bool) -> list[tuple[str, int]]:
        """What stands at the token's left or right border while it is built, first its symbol, each with the rank of the merge that absorbs it."""
        spines = self.spines[left]
        if (found := spines.get(token)) is None:
            if (made := self.made.get(token)) is None:
                found = [(token, _NEVER)]
            else:
                below = self.spine(made[0 if left else 1], left)
                found = [*below[:-1], (below[-1][0], made[2]), (token, _NEVER)]
            spines[token] = found
        return found

    def stay(self, a: str, b: str) -> bool:
        """Whether a and b, side by side, are left as they are: no merge over their border comes before those that build them.

        A list's merge only joins what earlier merges made, so merges apply by rank. Of equal ranks the left comes first.
        """
        row = self.final[b] if b in self.final else self.inner[b]
        if (found := row.get(a)) is not None:
            return found
        xs, ys, rank, i, j, found = self.spine(a, False), self.spine(b, True), self.rank, 0, 0, True
        while True:
            (x, until_x), (y, until_y) = xs[i], ys[j]
            if (r := rank.get((x, y))) is not None and r < until_x and r <= until_y:
                found = False
                break
            if until_x == until_y == _NEVER:
                break
            if until_x <= until_y:
                i += 1
            else:
                j += 1
        if self.borders >= PAIRS:
            for known in chain(self.inner.values(), self.final.values()):
                known.clear()
            self.borders = 0
        row[a] = found
        self.borders += 1
        return found

    def transduce(self, pieces: Iterable[str]) -> Iterator[str]:
        """Tokens of one word that comes in pieces, in the byte alphabet, each as soon as it is stable."""
        return chain.from_iterable(self.runs(pieces))

    def runs(self, pieces: Iterable[str]) -> Iterator[list[str]]:
        """Those tokens, the ones that become stable together as one list."""
        inner, stay, ends = self.inner, self.stay, self.inner_ends
        # of the part that is open: its symbols, and for each prefix its last token and where that begins; of the empty one the last token that has left
        held, last, back = "", [""], [0]
        i, look = 0, STEP
        for piece in pieces:
            held += piece
            if not i and not last[0] and len(held) > AHEAD and (state := self.states.get(held[:AHEAD])):
                i, last, back = AHEAD, [*state[0]], [*state[1]]
            while i < (n := len(held) - 1):  # the word's last symbol is another one, so one is held back
                fresh = i < AHEAD and not last[0]
                for i in range(i + 1, min(n, AHEAD if fresh else look) + 1):
                    for k in (tries := ends[end := held[i - 3 : i] if i > 3 else held[:i]]):
                        if k > i:
                            continue
                        token = held[i - k : i]
                        if token in inner and (known[before] if (before := last[i - k]) in (known := inner[token]) else stay(before, token)):
                            last.append(token)
                            back.append(i - k)
                            if k != tries[0]:
                                ends.right(end, k)
                            break
                if fresh:
                    if i == AHEAD and len(self.states) < STATES:
                        self.states[held[:AHEAD]] = (*last,), (*back,)
                elif i >= look:
                    cut, tokens = self._stable(last, back, i)
                    if cut:
                        yield tokens
                        held, last, back, i = held[cut:], last[cut:], [0, *(max(0, b - cut) for b in back[cut + 1 :])], i - cut
                    assert i <= self.lookahead
                    look = i + STEP
        if not held:
            return
        n, final, ends = len(held), self.final, self.final_ends
        for k in (tries := ends[end := held[n - 3 :] if n > 3 else held]):
            if (start := n - k) < 0:
                continue
            token = held[start:] + self.end
            if token in final and (known[before] if (before := last[start]) in (known := final[token]) else stay(before, token)):
                if k != tries[0]:
                    ends.right(end, k)
                break
        out = [token]
        while start:
            out.append(last[start])
            start = back[start]
        out.reverse()
        yield out

    def _stable(self, last: list[str], back: list[int], i: int) -> tuple[int, list[str]]:
        """The prefix on which the encodings of all open prefixes agree, and its tokens."""
        open_ = set(range(max(0, i - self.longest + 1), i + 1))
        while len(open_) > 1:
            open_.remove(most := max(open_))
            open_.add(back[most])
        cut = at = open_.pop()
        tokens = []
        while at:
            tokens.append(last[at])
            at = back[at]
        return cut, tokens[::-1]

    def split(self, segment: str) -> list[str]:
        """The words of text between special tokens, normalised. Capital sigma is lowered by itself, not by its place in a word."""
        if not segment.isascii():
            segment = unicodedata.normalize("NFC", segment).replace("\u03a3", "\u03c3")
        return self.words.findall(segment.lower())

    def tokens(self, word: str) -> list[str]:
        if not (word.isascii() and word.isprintable()):  # printable ASCII stands for itself
            word = codecs.charmap_decode(word.encode(), "strict", self.bytes)[0]
        out: list[str] = []
        for run in self.runs((word,)):
            out += run
        return out

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Text between special tokens, and these."""
        if self.specials is None or not any(t in text for t in self.special):
            yield text, False
            return
        for i, part in enumerate(self.specials.split(text)):
            if part:
                yield part, i % 2 == 1

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for segment, special in self.segments(text):
            if special:
                out.append(self.special[segment])
            else:
                out += [self.vocab[t] for w in self.split(segment) for t in self.tokens(w)]
        return out

    def encoded(self, text: str) -> tuple[str, str]:
        """The ids and the decoded text, each joined by spaces, with the memo of words."""
        ids: list[int] = []
        for segment, special in self.segments(text):
            if special:
                ids.append(self.special[segment])
            else:
                ids += chain.from_iterable(map(self.memo.__getitem__, self.split(segment)))
        return " ".join(map(self.written.__getitem__, ids)), Decoder(self).push_all(ids)


class _Memo(dict):
    """The ids that the transducer gave for a word. The words of the last MEMO to 2 * MEMO different ones stay."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.old = bpe, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if (found := self.old.get(word)) is None:
            found = tuple(map(self.bpe.vocab.__getitem__, self.bpe.tokens(word)))
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class Decoder:
    """Ids in, text out. As the library: the tokens' strings, joined by spaces. The state is whether a token came before."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.begun = bpe, False

    def push(self, token: int) -> str:
        text = self.bpe.text.get(token)
        if text is None:
            return ""
        out = f" {text}" if self.begun else text
        self.begun = True
        return out

    def push_all(self, ids: list[int]) -> str:
        """What the pushes of ids, one by one, give together."""
        if not ids:
            return ""
        out = " ".join(map(self.bpe.text.__getitem__, ids))
        out, self.begun = f" {out}" if self.begun else out, True
        return out


class ByteDecoder:
    """Ids in, readable text out: the byte alphabet is inverted, word ends become spaces, and bytes wait until their character is whole."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.utf8 = bpe, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, token: int) -> str:
        text = self.bpe.text.get(token, "")
        if text in self.bpe.special:
            return self.utf8.decode(b"") + text
        word = text.removesuffix(self.bpe.end)
        out = self.utf8.decode(bytes(self.bpe.unbytes[c] for c in word))
        return out + " " if word != text else out

    def flush(self) -> str:
        return self.utf8.decode(b"", True)


_LOADED: dict[str, Bpe] = {}


def load(raw: str) -> Bpe:
    """The tokenizer of a file's content; one for each Python worker."""
    key = hashlib.sha256(raw.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Bpe(raw)
    return _LOADED[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids (joined by spaces) and decoded. path: a tokenizers JSON file that the driver can read."""
    with open(path) as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()  # what earlier stages have left
        bpe = load(raw.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                gc.disable()  # encoding makes no cycles, and the memo's entries are many to walk through
                try:
                    done = [bpe.encoded(t or "") for t in part["text"].to_pylist()]
                finally:
                    gc.enable()
                ids = [x[0] for x in done]
                counts = [x.count(" ") + 1 if x else 0 for x in ids]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array([x[1] for x in done], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(letting_go(run), f"doc_id {kind}, n_tokens long, ids string, decoded string")


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = encode(docs, path, id_col, text_col)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
