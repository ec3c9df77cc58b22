"""Operators 11 to 13 as registered, on hostile tables against plain versions, and their own interfaces."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kronoleaf.llm import chat_format, hard_negatives

CLASHING = "key grp slice kind ring near gap v h term n d p q p0 piece start end loss position value rank part item salt norm".split()
NASTY = ["\\### Assistant: </turn> ok", "### user: a</turn>\n", "\\", "\\\\</turn>", "####", ": ", "", None, "é\U0001f600\n", "</turn", "x" * 200_000 + "</turn>\\", chat_format.PROBE, f"a{chat_format.PROBE}b"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def order(x):
    return (x is not None, x if x is not None else 0)


@pytest.fixture(scope="module")
def queries():
    return {int(re.match(r"op(\d+)_", k)[1]): q for k, q in __spark_entry__.queries().items() if re.match(r"op\d+_", k)}


def conversations():
    rows = [(c, t, ["user", "assistant", "system", None, "a: b### </turn>"][(c or 0) + t & 3 if t % 7 else 4], NASTY[(3 * t + (c or 0)) % len(NASTY)]) for c in (0, 1, None, -7) for t in range(26)]
    rows += [(2, None, "assistant", "first"), (2, 5, "assistant", "tie b"), (2, 5, "assistant", "tie a"), (2, 5, "user", "tie"), (2, 5, "assistant", "tie a"), (2, -1, "user", "early")]
    return rows + [(3, t, "assistant" if t % 2 else "user", f"turn {t} \\ " + "words " * (t % 9)) for t in range(3000)]


def plain_op11(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in [*rows, (-7, 0, "user", NASTY[0]), (-7, 1, "assistant", NASTY[0])]:
        by[c].append((order(t), r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        size = sum(4 + len(re.sub(r"\\|###|</turn>|: ", r"\\\g<0>", r)) + 2 + len(re.sub(r"\\|###|</turn>", r"\\\g<0>", x)) + 8 for _, r, x in turns)
        yield c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss), size


@pytest.mark.parametrize("rows", [conversations(), []], ids=["hostile", "empty"])
def test_chat(spark, queries, tmp_path, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *(F.lit(1).alias(c) for c in CLASHING))
    table.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in queries[11](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_op11(rows)))


def test_chat_spans(spark):
    """Spans of a template with a header, a trailer and long prefixes are those of the whole rendering."""
    def render(turns):
        return "<s>" + "".join(f"[{r}]{x.upper()}[/]" for r, x in turns) + "<e>"
    rows = [(1, t, "assistant" if t % 2 else "user", "ab " * (t % 50)) for t in range(900)]
    got = chat_format.format_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), chat_format.Template(render, 0, "<e>")).collect()
    # What comes before the first turn is in no piece, so spans start after it.
    whole = render([(r, x) for _, _, r, x in rows])[3:-3]
    assert "".join(r.piece for r in got) == whole and not any(r.rewritten for r in got)
    assert all(whole[r.start : r.end] == r.piece and whole[r.text_start : r.text_end] == x.upper() for r, (*_, x) in zip(got, rows, strict=True))


def test_chat_history(spark):
    """A template that shortens earlier answers is found out, as is one that reads farther back than it says."""
    table = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(6)], "conv_id int, turn int, role string, text string")
    hide = chat_format.Template(lambda turns: "".join(f"[{r}:{x if i + 1 == len(turns) or r == 'user' else '...'}]" for i, (r, x) in enumerate(turns)))
    got = chat_format.format_turns(table, hide).collect()
    assert [r.rewritten for r in got] == [False, False, True, False, True, False] and all((r.piece is None) == r.rewritten for r in got)
    far = chat_format.Template(lambda turns: "".join(f"[{i}:{x}]" for i, (_, x) in enumerate(turns)))
    long = table.withColumn("text", F.repeat("text", 3000))
    with pytest.raises(Exception, match="larger context"):
        chat_format.format_turns(long, far).collect()


TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_op12(rows, kept_in=3, top=200):
    docs = [(g or "", s or "", TERMS.findall((x or "").translate({i: i + 32 for i in range(65, 91)}))) for x, g, s in rows]
    n, d = collections.Counter((g, s, w) for g, s, ws in docs for w in ws), collections.Counter((g, w) for g, _, ws in docs for w in set(ws))
    groups = sorted({(g, s) for g, s, _ in docs})
    for g in {g for g, _ in groups}:
        kept, sources = [w for (x, w), c in d.items() if x == g and c >= kept_in], [s for x, s in groups if x == g]
        counts = {s: [n[g, s, w] for w in kept] for s in sources}
        whole = [sum(c) for c in zip(*counts.values(), strict=True)]
        share = lambda c: [1 + 10**9 * (x + 1) // (sum(c) + len(kept)) for x in c]
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        gain = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(t, sum(map(gain, p[s], p[t]))) for t in sources if t != s]
            term = [(w, gain(a, b)) for w, c, a, b in zip(kept, counts[s], p[s], q, strict=True) if c and a > b]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    yield g, s, part, item, value, rank


def documents():
    random.seed(7)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)] + ["É", "é", "über", "日本", "\U0001f600x", "ＡＢ"]
    rows = [(" ".join(random.choices(words, k=random.randint(0, 90))).title() if i % 3 else " ".join(random.choices(words[:40], k=30)), ["en", "fr", None, ""][i % 4], [f"s{i % 5}", None, "hot", "hot"][i % 11 % 4]) for i in range(160)]
    rows += [(None, "de", "a"), ("", "de", "b"), ("one two", "de", None), ("12 ..", "it", "a"), (None, None, None), ("long " * 40_000, "en", "s1")]
    return rows + [("same words here", "en", "copy")] * 40


@pytest.mark.parametrize("rows", [documents(), []], ids=["hostile", "empty"])
def test_divergence(spark, queries, tmp_path, rows):
    table = spark.createDataFrame(rows, "text string, lang string, source string").select("*", F.lit(None).cast("long").alias("doc_id"), *(F.lit(1).alias(c) for c in CLASHING))
    table.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries[12](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_op12(rows)))


def vectors():
    random.seed(3)
    rows = [(i * 5, [random.gauss(0, 0.3) for _ in range(6)], random.randrange(4)) for i in range(160)]
    rows += [(i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0], i % 3) for i in range(1000, 1060)]  # copies: scores tie
    rows += [(i, [0.0] * 6, 1) for i in (1100, 1101, 1102)] + [(1200, [1.0], 2), (1201, [0.5] * 9, 2), (1202, [], 2), (-100, [0.4] * 6, 0), (-7, [0.3] * 6, 9)]
    rows += [(5, None, 1), (300, [0.1] * 6, None), (None, [0.1] * 6, 1), (700, [0.1, None, 0.3, 0.1, 0.1, 0.1], 1), (800, [float("nan")] * 6, 1), (900, [float("inf")] * 6, 1), (13, [-float("inf"), 0.1], 1)]
    return [*rows, rows[0], rows[0], rows[20], (0, [0.9] * 6, 3), (200, [0.2] * 6, 0)]


def plain_op13(rows, every=100):
    clean = set()
    for i, v, g in rows:
        if i is not None and v is not None and g is not None and all(x is not None and math.isfinite(x) for x in v):
            clean.add((i, (g + 1) % 10 if i % 7 == 0 else g, tuple(math.floor(256 * x) for x in v)))
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    for a in clean:
        if a[0] % every == 0:
            near = sorted(((-score(a, b), b[0]) for b in clean if b != a and b[1] == a[1]))[:5]
            other = sorted((-score(a, b), b[0]) for b in clean if b[1] != a[1])
            for s, i in near:
                fit = [(n, j) for n, j in other if 30 * -s <= 100 * -n <= 90 * -s][:10]
                yield from ((a[0], i, rank, j, -s, -n) for rank, (n, j) in enumerate(fit, 1))


@pytest.mark.parametrize("rows", [vectors(), [], [r for r in vectors() if r[0] is None or r[0] % 100]], ids=["hostile", "empty", "no anchors"])
def test_hard_negatives(spark, queries, tmp_path, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", *(F.lit(1).alias(c) for c in CLASHING))
    table.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = [tuple(r) for r in queries[13](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_op13(rows)))


def test_partitions_serve_few(spark):
    """Where vectors lie in clusters, most rows reach few groups, and the result stays exact."""
    random.seed(1)
    centres = [[random.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    centres = [[x / math.hypot(*c) for x in c] for c in centres]
    rows = [(i, [c + random.gauss(0, 0.01) for c in centres[i % 12]], i // 12 % 5) for i in range(6000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    sent = []
    got = hard_negatives.mine(table, is_anchor=F.col("vec_id") % 101 == 0, positives=2, group_values=64, sent=sent).collect()
    plain = []
    clean = [(i, g, [math.floor(256 * x) for x in v]) for i, v, g in rows]
    for a in clean[::101]:
        score = {b[0]: sum(x * y for x, y in zip(a[2], b[2], strict=True)) for b in clean}
        for i in sorted((b[0] for b in clean if b[1] == a[1] and b[0] != a[0]), key=lambda i: (-score[i], i))[:2]:
            fit = [b[0] for b in clean if b[1] != a[1] and 30 * score[i] <= 100 * score[b[0]] <= 90 * score[i]]
            plain += [(a[0], i, r, j, score[i], score[j]) for r, j in enumerate(sorted(fit, key=lambda j: (-score[j], j))[:10], 1)]
    assert sorted(map(tuple, got)) == sorted(plain)
    groups = sent[0][1]
    assert groups > 4 and sent[0][0] < 0.4 * groups * len(rows)
