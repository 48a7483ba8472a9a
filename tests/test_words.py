"""Words found in bytes against ``str.split``."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loamsift.functions import words as W

TEXT = st.one_of(st.none(), st.text(alphabet="ab é  　\u0085   \t\n\x1c中x", max_size=12), st.text(max_size=20))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6), st.integers(0, 3))
def test_words_are_those_of_split(texts, skip):
    column = pa.array(texts, pa.string())[min(skip, len(texts)) :]
    want = [(t or "").split() for t in texts[skip:]]
    which, distinct, sizes = W.distinct_words(column, W.Powers())
    assert sizes.tolist() == [len(w) for w in want]
    flat = [w for x in want for w in x]
    assert [distinct[k].decode() for k in which] == flat and len(distinct) == len(set(flat))


def test_chunks_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    column = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 99, n)) for n in (0, 3, 400, 1, 50)] + ["x" * 300])
    one, sizes = W.word_hashes(column, W.Powers())
    monkeypatch.setattr(W, "CHUNK", 40)
    many, again = W.word_hashes(column, W.Powers())
    assert (one == many).all() and (sizes == again).all()


def test_distinct_words_have_distinct_hashes():
    words = [f"{a}{b}" for a in "abcdefghij" for b in range(20_000)]
    h, _ = W.word_hashes(pa.array([" ".join(words)]), W.Powers())
    assert len(set(h.tolist())) == len(words)
