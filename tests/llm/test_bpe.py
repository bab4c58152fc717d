import hashlib
import random

import pytest

from dossier.llm import bpe as b
from dossier.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def own():
    with open(tokenizer_path()) as f:
        return b.load(f.read())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def texts():
    rng = random.Random(1)
    fixed = ["", " ", "It's 123 ½ ²x Ⅷ ÉCOLE ΣΑΣ İstanbul", "<|endoftext|>Hi<|startoftext|> there", "日本語😀é", "a\x1cb\x85c d", "don't we'll I'VE", "ß ẞ ŉ ǰ ﬁ", "a<|endoftext|", "\x00\x01", "x" * 5000, "abcdefghij" * 900 + "!!!"]
    return fixed + ["".join(rng.choice("etaoinshrdlu'.!1éßΣ\n\t　<|>") for _ in range(rng.randint(1, 300))) for _ in range(150)]


def test_as_the_library(own, library):
    for t in texts():
        e = library.encode(t, add_special_tokens=False)
        assert own.encode(t) == e.ids, t
        assert own.encoded(t) == (" ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)), t


def test_known_words_cost_no_calls(own):
    """What a text costs beyond its unknown words: no Python function is called for a word or a token."""
    import sys

    def calls(text):
        own.encoded(text)
        found = []
        sys.setprofile(lambda frame, event, arg: found.append(frame.f_code.co_name) if event == "call" else None)
        try:
            own.encoded(text)
        finally:
            sys.setprofile(None)
        return len(found)

    assert calls("some words, with marks!! in it's text: " * 400) <= calls("some words")


def test_one_end_is_tried_first(own):
    """Of the tokens that may end a prefix, the one that was right last time is looked at first."""
    looks = []
    plain = own.inner

    class Counted(dict):
        def __contains__(self, token):
            looks.append(token)
            return dict.__contains__(self, token)

    word = "thatthwhthanedeashshandthreedntinedering"
    list(own.runs((word,)))
    own.inner = Counted(plain)
    own.states.clear()
    try:
        list(own.runs((word,)))
    finally:
        own.inner = plain
    assert len(looks) <= 1.5 * len(word)


def test_pieces_of_a_word_may_come_one_by_one(own):
    rng = random.Random(2)
    for n in (1, 2, 63, 64, 65, 700, 3000):
        word = "".join(rng.choice("etaoinshr") for _ in range(n))
        whole = own.merge([*word[:-1], word[-1] + own.end])
        assert list(own.transduce(word)) == whole == own.tokens(word)


def test_memory_is_bounded(own):
    held = []
    plain = own._stable
    own._stable = lambda last, back, i: held.append(i) or plain(last, back, i)
    try:
        assert sum(map(len, own.transduce("abcdefghi" for _ in range(20_000)))) == 9 * 20_000 + len(own.end)
    finally:
        del own._stable
    assert max(held) <= b.STEP + 4 * own.longest <= own.lookahead


def test_borders_as_by_definition(own):
    rng = random.Random(3)
    inner, final = sorted(own.inner), sorted(own.final)
    at_end = len(own.end) + 1
    symbols = lambda token: [*token[:-at_end], token[-at_end:]] if token in own.final else list(token)
    for _ in range(5000):
        x, y = rng.choice(inner), rng.choice(inner if rng.random() < 0.5 else final)
        assert own.stay(x, y) == (own.merge(list(x) + symbols(y)) == [x, y])


def test_byte_decoder(own):
    for t in ("naïve 😀 text", "日本"):
        d = b.ByteDecoder(own)
        assert ("".join(map(d.push, own.encode(t))) + d.flush()).strip().replace(" ", "") == t.replace(" ", "")


def test_table(docs, rows, library, none):
    out = b.digest(docs, tokenizer_path()).collect()
    want = []
    for r in rows:
        e = library.encode(r[1] or "", add_special_tokens=False)
        want.append((str(r[0]), len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in out) == sorted(want)
    assert b.digest(none, tokenizer_path()).count() == 0
