import numpy as np
import public_tokenizers as P
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe, pretoken

PAT = regex.compile(P.PATTERN)


def check(texts):
    got, counts = pretoken.pieces(texts)
    want = [PAT.findall(t) for t in texts]
    assert got == [x for w in want for x in w]
    assert counts.tolist() == [len(w) for w in want]


def test_contractions_and_blanks():
    check(["it's", "'s's", "''s", " 's", "\n's", "a  'll b", "x're've'", "!'s", "'r", "'", "", "  ", " \n a", "a  b", "'l", "l'", "é'tudes'dd", "12'3 'm9", "'’s", "a'́s"])
    check(["it'", "s is", "'", "ll"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab'strevlmd \n\t!1é  Ω…", max_size=40), max_size=6))
def test_same_as_the_pattern(texts):
    check(texts)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=400))
def test_scan_is_composition(data):
    f = np.frombuffer(data, np.uint8)
    got, acc = pretoken.prefix(f), None
    for i, x in enumerate(f.tolist()):
        acc = x if acc is None else sum((x >> 2 * (acc >> 2 * s & 3) & 3) << 2 * s for s in range(4))
        assert got[i] == acc


def test_pieces_in_bytes():
    texts = ["", "it's é😀 10% \n\n  x", "plain words", "", "ü", "漢字 don't 'll", " "]
    for some in (texts, texts[2:3], texts[:1], []):
        got, counts = pretoken.byte_pieces(some)
        want, n = pretoken.pieces(some)
        assert got == [p.encode() for p in want] and counts.tolist() == n.tolist()


def test_a_slice_is_looked_up_once_and_kept_when_the_cache_is_full(monkeypatch):
    looked, coded = [], []

    class Cache(dict):
        def get(self, p):
            looked.append(p)
            return super().get(p)

    def encode_new(new):
        coded.extend(new)
        return [b"<" + p + b">" for p in new]

    cache = Cache()
    encode = lambda texts: list(bpe.encode_pieces(texts, cache, encode_new))
    assert encode(["a b a", "a", "x" * 300]) == [b"<a>< b>< a>", b"<a>", b"<" + b"x" * 300 + b">"]
    assert looked == [b"a", b" b", b" a", b"a", b"x" * 300] and set(cache) == {b"a", b" b", b" a"}
    coded.clear()
    monkeypatch.setattr(bpe, "CACHE_PIECES", 4)
    assert encode(["a b c d"]) == [b"<a>< b>< c>< d>"]
    assert sorted(coded) == [b" c", b" d"] and set(cache) == {b"a", b" b", b" c", b" d"}
