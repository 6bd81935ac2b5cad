"""Properties over generated inputs, without Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from swathe.llm import chat, html_extract, line_dedup, packing, repeat_spans
from swathe.llm import kernels as K

TEXT = st.text(alphabet=st.characters(codec="utf-8"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=5))
def test_chat_reads_back_what_it_wrote(messages):
    assert chat.parse(chat.render(messages)[0]) == messages


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=20))
def test_packing_plan_places_every_piece_once(histogram):
    plan = packing.best_fit_decreasing(histogram, 40)
    ranks: dict[int, list] = {}
    used: dict[int, list] = {}
    for length, rank, count, first, offset in plan:
        ranks.setdefault(length, []).extend(range(rank, rank + count))
        for w in range(first, first + count):
            used.setdefault(w, []).append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items()}
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 40


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25))
def test_patience_blocks_are_common_and_ordered(a, b):
    at = (0, 0)
    for i, j, n in line_dedup.patience(a, b):
        assert a[i : i + n] == b[j : j + n] and (i, j) >= at and i >= at[0] and j >= at[1]
        at = (i + n, j + n)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_and_lines_of_arrow_strings(texts):
    data, offs = K.strings(pa.array(texts, pa.string()))
    raw = data.tobytes()
    starts, ends, first = K.words(data, offs)
    got = [[raw[a:b] for a, b in zip(starts[x:y], ends[x:y], strict=True)] for x, y in zip(first[:-1], first[1:], strict=True)]
    space = bytes([0x20, *range(0x09, 0x0E)])
    assert got == [[w for w in t.encode().translate(bytes.maketrans(space, b" " * 6)).split(b" ") if w] for t in texts]
    starts, ends, first = line_dedup.lines_of(data, offs)
    lines = [[raw[a:b] for a, b in zip(starts[x:y], ends[x:y], strict=True)] for x, y in zip(first[:-1], first[1:], strict=True)]
    assert lines == [t.encode().split(b"\n") for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=150, max_size=900), st.integers(0, 2**32 - 1))
def test_equal_windows_have_equal_anchors(raw, seed):
    rng = np.random.default_rng(seed)
    part = np.frombuffer(raw, np.uint8)[:140]
    data = np.concatenate([rng.integers(0, 256, 57, dtype=np.uint8), part, rng.integers(0, 256, 33, dtype=np.uint8), part])
    _, lo, n, off, key, _, _, _ = repeat_spans.anchors(data, np.array([0, len(data)]))
    window = {}
    for a, count, o, k in zip(lo, n, off, key, strict=True):
        for j in range(count):
            window[a + j] = (o - j, k)
    assert sorted(window) == list(range(len(data) - repeat_spans.LENGTH + 1))
    for i in range(len(part) - repeat_spans.LENGTH + 1):
        assert window[57 + i] == window[57 + len(part) + 33 + i]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/=\"' &;#pdivbrsctyle!-\n", max_size=120))
def test_any_markup_is_read(page):
    text = html_extract.main_texts([page])[0]
    assert text == text.strip() and "\n\n\n" not in text


def test_no_common_windows_no_rows():
    with pytest.raises(ValueError):
        chat.parse("### User: open")
    assert repeat_spans.anchors(np.zeros(0, np.uint8), np.array([0]))[0].size == 0
