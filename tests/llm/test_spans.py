import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import spans as S
from ledgerlens.llm.filter_audit import MACHINE, measure_texts
from ledgerlens.llm.tokens import buffers

TEXTS = st.lists(st.text(alphabet="aB é漢\t\n#x 9", max_size=40), min_size=1, max_size=6)


def expected(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(w), len(set(w)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_measures_equal_patterns(texts):
    got = measure_texts(*buffers(pa.array(texts)))
    assert [tuple(int(got[k][i]) for k in ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")) for i in range(len(texts))] == [expected(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 7))
def test_segments_carry_state_and_words(texts, segment):
    raw, offsets = buffers(pa.array(texts))
    run = S.Run(MACHINE, raw, offsets, (S.POINT, S.CAPITAL), segment)
    found = [(int(r), raw[a:b].tobytes().decode()) for rows, starts, ends in run.words() for r, a, b in zip(rows, starts, ends, strict=True)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert run.count(S.POINT).tolist() == [len(t) for t in texts]


def test_state_must_follow_from_the_class():
    with pytest.raises(ValueError):
        S.Transducer(np.zeros(256, np.uint8), np.array([[0], [1]], np.uint8), np.zeros((2, 1), np.uint8))


def test_table_is_exact_when_every_hash_collides():
    words = [b"a", b"b", b"a", b"abcdefghij", b"abcdefghik", b"x" * 2000, b"x" * 1999 + b"y", b"x" * 2000, b"", b""]
    raw = S.padded(np.frombuffer(b"".join(words), np.uint8))
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes) - sizes
    for hashes in (None, np.zeros(len(words), np.uint64)):
        table = S.SpanTable(raw)
        ids = table.insert(np.zeros(len(words), np.int64), starts, sizes, hashes)
        again = table.insert(np.zeros(len(words), np.int64), starts, sizes, hashes)
        assert (ids == again).all() and table.n == len(set(words))
        assert all((ids[i] == ids[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
        other = table.insert(np.ones(2, np.int64), starts[:2], sizes[:2], None if hashes is None else hashes[:2])
        assert set(other.tolist()).isdisjoint(ids.tolist())


def test_table_grows():
    words = [f"w{i % 5000}".encode() for i in range(20000)]
    raw = S.padded(np.frombuffer(b"".join(words), np.uint8))
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes) - sizes
    table = S.SpanTable(raw)
    ids = np.concatenate([table.insert(np.zeros(100, np.int64), starts[i : i + 100], sizes[i : i + 100]) for i in range(0, 20000, 100)])
    assert table.n == 5000 and len({(w, i) for w, i in zip(words, ids.tolist(), strict=True)}) == 5000
