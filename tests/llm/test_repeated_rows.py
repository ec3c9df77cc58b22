"""Operators 1 and 4 on many equal rows and with windows of other lengths."""

import random

import pytest

from kronoleaf.llm import anchors, automaton_dedup, suffix_dedup


def texts(seed, words=350):
    random.seed(seed)
    return " ".join(f"w{random.randrange(10**6)}" for _ in range(words))


def plain_bytes(rows, length):
    seen = {}
    for n, (_, t) in enumerate(rows):
        raw = t.encode()
        for i in range(len(raw) - length + 1):
            seen.setdefault(raw[i : i + length], []).append((n, i))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for n, i in places:
                gone[n].update(range(i, i + length))
    return sorted((i, len(g)) for (i, _), g in zip(rows, gone, strict=True))


@pytest.mark.parametrize("length", [1, 40, 200, 400, 1000])
def test_lengths(spark, length):
    shared, tail = texts(1, 400)[:2000], texts(2)[:700]
    rows = [(1, "a" + shared + texts(3, 60)), (2, texts(4, 50) + shared), (3, tail + shared[300:1500]), (4, tail[:650] + "!"), (5, "x" * 50)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == plain_bytes(rows, length)


@pytest.mark.parametrize("length", [1, 50, 300, 700])
def test_word_lengths(spark, length):
    shared = texts(5, 800)
    rows = [(1, "a " + shared + " end"), (2, texts(6, 50) + " " + shared), (3, " ".join(shared.split()[100:760])), (3, texts(7, 20))]
    seen, want = {}, []
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            seen[key] = min(seen.get(key, i), i)
    for i, t in rows:
        w, gone = t.split(), set()
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        want.append((i, len(w), len(gone)))
    got = automaton_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == sorted(want)


def test_equal_rows_are_linear(spark):
    """m equal rows have each span once, and each place is looked at once."""
    text = texts(8)
    for m in (10, 40):
        rows = spark.createDataFrame([(7, text)] * m + [(9, "other " + text + " end"), (None, text)], "doc_id long, text string").repartition(6)
        keyed = suffix_dedup.keyed(rows)
        for spans in (suffix_dedup.repeated_spans(keyed), automaton_dedup.repeated_spans(keyed)):
            sizes = [len(r.spans) for r in spans.collect()]
            assert len(sizes) <= 3 and max(sizes) < 400
        got = {(r.doc_id, r.n_removed == r.n_words) for r in automaton_dedup.remove_repeats(rows).collect()}
        # The row without an id comes first of all, so the others lose what it has.
        assert got == {(None, False), (7, True), (9, False)}
        assert {(r.doc_id, r.n_removed == r.n_bytes) for r in suffix_dedup.remove_repeats(rows).collect()} == {(None, True), (7, True), (9, False)}


def test_refused(spark):
    with pytest.raises(TypeError, match="whole-number"):
        automaton_dedup.remove_repeats(spark.createDataFrame([("d1", "a")], "doc_id string, text string"))
    with pytest.raises(ValueError, match="not supported"):
        anchors.records(__import__("numpy").zeros(9, "u8"), *[__import__("numpy").array([0, 9])] * 3, anchors.LONGEST + 1, 9)
