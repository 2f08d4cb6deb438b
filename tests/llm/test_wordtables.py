import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from tokenloom.llm import spans

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_words(text):
    return re.findall("[a-z0-9]+", text.translate(LOWER))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aAbB9 .é\n木'"), max_size=30)), max_size=8))
def test_words_match_a_plain_scan(texts):
    t = spans.texts_of(pa.array(texts, pa.string()))
    w = spans.words(t)
    got = [[] for _ in texts]
    for r, a, b in zip(w.row, w.start, w.end):
        got[r].append(t.buf[a:b].tobytes().decode().lower())
    assert got == [plain_words(x) if x else [] for x in texts]
    by = {}
    for r, a, b, h in zip(w.row, w.start, w.end, w.hash):  # equal words, and only they, hash alike
        by.setdefault(int(h), set()).add(t.buf[a:b].tobytes().lower())
    assert all(len(v) == 1 for v in by.values())
    assert len(by) == len({x for row in got for x in row})


def test_slices_keep_rows_whole_and_in_order():
    texts = ["a" * 10, None, "", "b" * 5000, "c d"] * 3
    t = spans.texts_of(pa.array(texts, pa.string()).slice(1))
    parts = list(spans.slices(t, 100))
    assert [i for i, _, _ in parts] == [0] + [j for _, j, _ in parts][:-1]
    assert b"".join(p.buf.tobytes() for _, _, p in parts).decode() == "".join(x or "" for x in texts[1:])


def test_shingles_stay_in_their_row():
    t = spans.texts_of(pa.array(["a b c d", "a b", "x a b c"]))
    at, h = spans.shingles(spans.words(t), 3)
    assert len(at) == 4
    assert h[0] == h[3] and len(set(h.tolist())) == 3


def test_lines_and_sentences():
    t = spans.texts_of(pa.array([" one \r\n\r\n two", "", "a. b! ... c", "\n\n"]))
    ln = spans.lines(t)
    assert [t.buf[a:b].tobytes() for a, b in zip(ln.start, ln.end)] == [b"one", b"two", b"a. b! ... c"]
    sn = spans.sentences(t)
    assert [t.buf[a:b].tobytes() for a, b in zip(sn.start, sn.end)] == [b"one", b"two", b"a", b"b", b"c"]


def test_mix_is_a_bijection_on_a_sample():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(spans.mix64(x))) == len(x)
