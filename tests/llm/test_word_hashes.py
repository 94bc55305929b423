import sys
from itertools import accumulate

from hypothesis import given, settings, strategies as st

from annalist.llm import lines as L

SPACES = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abä界😀" + SPACES), max_size=60))
def test_equal_words_have_equal_hashes_wherever_they_stand(text):
    words = text.split()
    got = L.word_hashes(text).tolist()
    assert got == [L.word_hashes(w)[0] for w in words]
    assert len(set(got)) == len(set(words))


def test_steps_end_at_spaces(monkeypatch):
    long = "\n".join("w" * (i + 1) for i in range(400)) + "v" * 70000
    assert (L.word_hashes(long) == [L.word_hashes(w)[0] for w in long.split()]).all()
    text = "one two  three\n" * 50 + "x" * 9000 + " tail " + "y" * 70
    whole = L.word_hashes(text)
    monkeypatch.setattr(L, "STEP_BYTES", 64)
    assert (L.word_hashes(text) == whole).all() and len(whole) == len(text.split())
    assert len(L.word_hashes(None)) == len(L.word_hashes(" \n　")) == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("abä界\0.!? \n" + SPACES), max_size=60), max_size=12), st.integers(1, 200))
def test_texts_hashed_together_are_those_hashed_alone(texts, size):
    before, L.GROUP_BYTES = L.GROUP_BYTES, size
    try:
        words = [w[s:e].tolist() for _, w, edges in L.grouped_words(texts) for s, e in zip(edges[:-1], edges[1:])]
        lines, counts, edges, _, own = L.line_runs(texts, 3)
    finally:
        L.GROUP_BYTES = before
    assert words == [L.word_hashes(t).tolist() for t in texts]
    tables = [[x for x in zip(*L.line_table(t)) if x[1]] for t in texts]
    assert [list(zip(lines[s:e].tolist(), counts[s:e].tolist())) for s, e in zip(edges[:-1], edges[1:])] == tables
    assert own.tolist() == [0, *accumulate(len(set(L.run_keys([h for h, _ in x], [c for _, c in x], 3))) for x in tables)]
