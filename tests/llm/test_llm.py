"""The training-data operators against brute force on small, hostile tables."""

import collections
import hashlib
import re

import numpy as np
import pytest

from kronoleaf.llm import automaton_dedup, byte_bpe, decontam, fingerprints, graph, langid, line_dedup, near_dup, quality, secrets, suffix_dedup
from kronoleaf.llm.common import row_key

P = " ".join(f"pass{i}" for i in range(80))
Q = " ".join(f"word{i}" for i in range(120))
ROWS = [
    (0, None, "x"), (1, "", "x"), (2, P, "x"), (3, "intro words here " + P + " end of it", "x"), (4, Q, "x"), (5, Q, "x"), (6, Q.replace("word7 ", "other "), "x"),
    (7, "é" * 500, "x"), (8, "a b", "x"), (9, "A  b", "x"), (10, "A repeated line that is long\nown ten", "x"), (11, "a Repeated line that is long \nown eleven", "x"), (12, "a repeated line that is long", "x"),
    (13, "token = 'abcdef123' secret:abc AKIA" + "Z" * 16 + " " + "0f" * 13 + " 日本 password=hunter22", "x"), (None, "no id " + P, "x"), (14, "\n\t ", "x"), (15, "x " * 3000, "x"), (15, "x " * 3000, "x"),
]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, key string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def same(df, want, columns):
    got = sorted(str([r[c] for c in columns]) for r in df.collect())
    assert got == sorted(str(list(w)) for w in want)


def test_suffix_dedup(docs, empty):
    raw = [(i, (t or "").encode()) for i, t, _ in ROWS]
    seen = collections.Counter(b[s : s + 200] for _, b in raw for s in range(len(b) - 199))
    want = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))))
    same(suffix_dedup.remove_repeats(docs), want, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_loser_tree_keeps_prefixes():
    strings = sorted(bytes(x) for x in np.random.default_rng(3).integers(97, 99, (200, 12)).astype(np.uint8))
    runs = [suffix_dedup.front_code(strings[i::7]) for i in range(7)]
    out = list(suffix_dedup.LoserTree(runs))
    assert [s for s, *_ in out] == strings
    assert all(out[i][1] == suffix_dedup.common_prefix(out[i - 1][0], out[i][0]) for i in range(1, len(out)))


def test_substring_dedup(docs, empty):
    words = [(i, (t or "").encode().split()) for i, t, _ in ROWS]
    first = {}
    key = lambda i: -1 if i is None else i
    for i, w in sorted(words, key=lambda x: key(x[0])):
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), key(i))
    want = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < key(i):
                gone[s : s + 50] = [True] * 50
        want.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    same(automaton_dedup.remove_repeats(docs), want, ["doc_id", "n_words", "n_removed", "kept_sha256"])
    assert automaton_dedup.remove_repeats(empty).count() == 0


BASE = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(BASE) for m in re.finditer(p, text or "") if len(m.group(g)) >= n)


def test_secrets(spark, docs, empty):
    more = ["secret=token:abcdefgh", "token:token:token:abcdefgh", "TOKEN = 'short' passwd:\"longer1\"", "AKIA" * 9 + " AKIA" + "B" * 15, "0" * 23 + "g" + "a1" * 20, "api_key=abcdefg api=key apikey:/+.=-_a", "token=a token=abcdef " * 900, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 40 + " eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "日本 secret:ÀÀ secret:ab12cd"]
    rows = [(i, t) for i, t, _ in ROWS] + [(100 + i, t) for i, t in enumerate(more)]
    want = []
    for i, t in rows:
        found = base_spans(t)
        text = ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in found)
        want.append((i, *(sum(k == n for _, k, _ in found) for n in range(3)), sha(text.encode())))
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_rows=5)
    same(got, want, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"])
    by = {r.doc_id: r.spans for r in got.collect()}
    assert by[107] == "pem:0:31,repo:32:76,hex:36:76,jwt:77:112" and by[0] == ""
    assert secrets.scan(empty).count() == 0


def test_secret_queries_are_derived():
    assert [len(secrets.query(r)) for r in secrets.RULES] == [6, 1, 0, 1, 5, 1]
    assert secrets.query(secrets.Rule("x", "ab?cd|wxyz")) == [["acd"], ["abc", "bcd"], ["wxy", "xyz"]] and secrets.query(secrets.Rule("x", "abcd|[a-z]+")) == []


def test_secrets_of_a_long_text(spark):
    text = "token=abcdef1 is a face of dead beef " * 30_000
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_assign == 30_000 and row.base_sha256 == sha(",".join(f"assign:{s}:{e}" for s, _, e in base_spans(text)).encode())


def test_fingerprints(docs, empty):
    rows = fingerprints.fingerprint(docs).collect()
    assert len(rows) == len(ROWS) - 0
    by = {r.doc_id: r for r in rows}
    assert by[4].fingerprint == by[5].fingerprint and by[4].near_next == 1.0 and by[0].fingerprint == by[1].fingerprint
    assert by[4].edited_sha256 == sha((Q[: len(Q) - len(Q) // 2] + Q[: len(Q) // 2]).encode()) and 0 <= by[4].near_edited <= 1
    assert fingerprints.fingerprint(empty).count() == 0


def test_quality(spark, empty):
    good, bad = "plain words of prose here and there", "BUY!! NOW!! BEST!! WIN!!"
    docs = spark.createDataFrame([(i, f"{good if i % 2 else bad} {i}") for i in range(200)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(rows) == 202 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r.doc_id % 2 for r in rows if r.doc_id < 200]) > 0.97
    assert quality.score(empty, quality.train(docs, labels.limit(0))).count() == 0


def test_language(spark, empty):
    texts = {"en": "the cat and the dog were with them", "fr": "le chat et la maison dans les rues", "de": "der Hund und die Katze mit dem Haus"}
    docs = spark.createDataFrame([(i, f"{texts[k]} {i}", k) for i in range(30) for k in texts] + [(99, None, "en"), (98, "123 !", "en")], "doc_id long, text string, lang string")
    rows = langid.predict(docs, langid.train(docs), ["doc_id", "lang"]).collect()
    assert all(r.lang_pred == r.lang for r in rows if r.doc_id < 90) and [r.lang_pred for r in rows if r.doc_id > 90] == ["und", "und"]
    assert langid.predict(docs, langid.train(empty), ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_language_of_one_short_document(spark):
    texts = {"en": "the cat and the dog were with them", "fr": "le chat et la maison dans les rues"}
    rare = [(100, "talo saari järvi", "fi"), (101, "hylde", "da"), (102, "ż" * 500, "pl")]
    docs = spark.createDataFrame([(i, f"{texts[k]} {i}", k) for i in range(30) for k in texts] + rare, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model["langs"] == ["da", "en", "fi", "fr", "pl"] and {"talo", "hylde"} <= set(model["words"]) and max(map(len, model["words"])) <= 65
    assert all(r.lang_pred == r.lang for r in langid.predict(docs, model, ["doc_id", "lang"]).collect())
    ties = langid.train(docs, max_words=2, max_grams=3)
    assert {w for w, v in ties["words"].items() if v.argmax() == 2} == {"järvi", "saari"} and ties["words"].keys() >= {"and", "the", "hylde"}
    assert langid.train(docs.limit(1).selectExpr("'7 8' as text", "'xx' as lang"))["langs"] == []


def test_language_of_long_run(spark):
    docs = spark.createDataFrame([(i, t, k) for i in range(5) for k, t in (("a", "abba baab abab"), ("c", "cddc dccd cdcd"))], "doc_id long, text string, lang string")
    runs = spark.createDataFrame([(0, "ab" * 100 + "cd" * 2400, "c"), (1, "z" * 200 + "abab" * 1200, "a")], "doc_id long, text string, lang string")
    assert all(r.lang_pred == r.lang and r.score > 0.9 for r in langid.predict(runs, langid.train(docs), ["doc_id", "lang"]).collect())


def test_line_dedup(docs, empty):
    out = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs, counts=("__lines", "__dropped")).collect()}
    assert (out[10].text, out[11].text, out[12].text) == ("own ten", "own eleven", "a repeated line that is long")
    assert (out[10]["__lines"], out[10]["__dropped"], out[0]["__lines"], out[2]["__dropped"]) == (2, 1, 1, 0)
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_byte_bpe(docs):
    tiktoken, public_tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = byte_bpe.read_ranks(path)
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    want = [(i, len(ids := encoder.encode_ordinary(t or "")), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for i, t, _ in ROWS]
    same(byte_bpe.encode(docs, path, public_tokenizers.PATTERN, ["doc_id"]), want, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    merger = byte_bpe.Merger(tokens)
    piece = ("antidis" * 120).encode()
    assert merger.encode_long(piece).tolist() == merger.encode_same_length([piece])[0].tolist() == encoder.encode_ordinary(piece.decode())


def test_near_dup(docs, empty):
    rows = {(r.doc_id, r.n_shingles): r for r in near_dup.near_duplicates(docs, k=4).collect()}
    of = {k[0]: r for k, r in rows.items()}
    assert of[5].component_id == of[6].component_id == 4 and not of[5].kept and of[4].kept
    assert of[9].component_id == 8 and of[0].n_shingles == 0 and of[1].kept and of[3].component_id == (None if of[2].component_id is None else of[3].component_id)
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_filter_keeps_one_row_of_a_group(spark, empty):
    import corpus_pipeline

    rows = [(None, P), (None, P), (None, P + " more"), (None, Q), (7, Q), (7, "own words of row seven only here"), (3, "w " + Q), (8, "lone " * 9), (8, "lone " * 9), (9, ""), (9, ""), (None, None), (5, " ".join(f"five{i}" for i in range(60)))]
    rows += [(5, " ".join(f"cinq{i}" for i in range(60))), (6, rows[-1][1] + " end")]
    got = corpus_pipeline.near_filter(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    want = [(None, Q), (7, rows[5][1]), (8, "lone " * 9), (9, ""), (9, ""), (None, None), rows[12], rows[13]]
    rest = [tuple(r) for r in got if not (r.text or "").startswith(P)]
    assert sorted(map(str, rest)) == sorted(map(str, want)) and len(got) == len(want) + 1
    assert corpus_pipeline.near_filter(spark, empty, "").isEmpty()


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, " ".join(f"PASS{i}" for i in range(10, 25))), (2, "a b"), (3, None), (4, "..."), (1, "a B")], "item_id long, text string")
    for most in (200_000, 0):
        got = {r.doc_id: r for r in docs.withColumn("k", row_key()).join(decontam.contamination(docs, bench, broadcast_windows=most).withColumnRenamed("key", "k"), "k").collect()}
        assert set(got) == {None, 2, 3, 8, 9} and got[2].n_hit == 15 and got[8].n_hit == 2 and got[9]["items"] == ["1", "2"]
    assert decontam.contamination(empty, bench).count() == 0 and decontam.contamination(docs, bench.limit(0)).count() == 0


def test_decontamination_by_item_without_id(spark, docs):
    bench = spark.createDataFrame([(None, " ".join(f"pass{i}" for i in range(10, 25))), (2, "a b"), (None, "a b")], "item_id long, text string")
    for most in (200_000, 0):
        got = {r.doc_id: r for r in docs.withColumn("k", row_key()).join(decontam.contamination(docs, bench, broadcast_windows=most).withColumnRenamed("key", "k"), "k").collect()}
        assert {i: (r.n_hit, r["items"]) for i, r in got.items()} == {None: (15, []), 2: (15, []), 3: (15, []), 8: (2, ["2"]), 9: (2, ["2"])}


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(300, i) for i in range(200, 230)] + [(400, 401), (401, 402), (402, 400), (500, 500), (600, 601), (601, 600)]
    pairs += [(int(a), int(b)) for a, b in rng.integers(-1000, -800, (90, 2))]
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((n, r) for n, r in root.items() if n != r)
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()
