"""The registered opN_ queries and the pipeline's stages, run whole on hostile and on given tables."""

import collections
import inspect

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from kronoleaf.llm import automaton_dedup, common, line_dedup, near_dup, oracles, quality, suffix_dedup
from tests.llm import brute

SF = "/root/testdata/sf0.001"
P, Q, R = (" ".join(f"{w}{i}" for i in range(n)) for w, n in (("pass", 80), ("word", 120), ("rare", 60)))
LINE = "A Repeated Line of the page"
SECRETS = ["secret=token:abcdefgh", "token:token:token:abcdefgh", "AKIA" + "Z" * 16 + " passwd:\"longer1\"", "0f" * 13 + " 日本 password=hunter22"]
TEXTS = [
    None, "", " \t\n ", P, "intro words here " + P + " end of it", Q, Q, Q.replace("word7 ", "other "), Q + " tail", "é" * 500, "a b", "A  b", R, R + " x", R.replace("rare9 ", ""), "..., !!",
    f"{LINE}\nown ten", f"  {LINE.lower()}\t\nown eleven\n", f"{LINE.upper()}\n{LINE}", f"x\n{LINE}", "x " * 900, " nbsp word　wide " * 9, *SECRETS, "buy now " * 40, "the plain words of a page of prose " * 12, Q[:300] + P[:260] + R,
]
#: Ids that repeat and that are null, with equal and with other texts.
ROWS = [*enumerate(TEXTS), (None, P), (None, "no id " + Q), (None, None), (5, Q), (5, R), (7, Q.replace("word7 ", "other ")), (-3, P + " minus")]
CLASHING = "key o h score predicted c0 c1 lost lines dropped group items n_hit spans sig row text_ id at x lang_pred n_tokens held_out node alt".split()
BENCH = [("b1", " ".join(f"PASS{i}" for i in range(10, 25))), ("b2", "a b"), (None, " ".join(f"rare{i}" for i in range(12))), ("b3", None), ("b4", "..."), ("b2", "a B"), ("b5", " ".join(f"pass{i}" for i in range(5, 40)))]


def write(spark, folder, rows):
    docs = spark.createDataFrame([(i, t, ["en", "fr", None][n % 3], "s", len(t) if t else None) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.select("*", *[(F.coalesce("doc_id", F.lit(0)) + i).alias(c) for i, c in enumerate(CLASHING)]).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(BENCH if rows else [], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    marks = [(i, n % 2, 0) for n, (i, t) in enumerate(rows)] + [(None, 1, 0), (999, None, 0), (3, 1, None)]
    spark.createDataFrame(marks if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("hostile"), ROWS)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("none"), [])


@pytest.fixture(scope="module")
def queries():
    return {k: q for k, q in __spark_entry__.queries().items() if k[:2] == "op" or k == "pipeline"}


def op(queries, n):
    return next(q for k, q in queries.items() if k.startswith(f"op{n}_"))


def same(rows, want, columns):
    assert sorted(str([r[c] for c in columns]) for r in rows) == sorted(str(list(w)) for w in want)


COLUMNS = {
    1: ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], 3: ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"], 4: ["doc_id", "n_words", "n_removed", "kept_sha256"],
    7: ["doc_id", "n_lines", "n_dropped", "kept_sha256"], 9: ["doc_id", "n_shingles", "component_id", "kept"], 10: ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
}


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_brute_force(spark, queries, sf, n):
    want = brute.op10(ROWS, BENCH) if n == 10 else getattr(brute, f"op{n}")(ROWS)
    same(op(queries, n)(spark, sf).collect(), want, COLUMNS[n])


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_sql(spark, queries, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.sql(oracles.SQL[name]), queries[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    same(got.collect(), want.fetchall(), want.columns)


def test_language(spark, queries, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got, want = (sorted(x, key=lambda r: str((r[0], r[1], r[2], round(r[3], 2)))) for x in ([tuple(r) for r in op(queries, 2)(spark, sf).collect()], brute.op2(rows)))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-3)


def test_language_held_out(spark, queries):
    rows = op(queries, 2)(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 30 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def test_fingerprints(spark, queries):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want, got = brute.op5(rows), op(queries, 5)(spark, SF).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == {i: w[:2] for i, w in want.items()}
    for column, at in (("near_edited", 2), ("near_next", 3)):
        error = np.abs([r[column] - want[r.doc_id][at] for r in got])
        assert error.mean() < 0.035 and error.max() < 0.16
    text = dict(rows)
    alike = collections.defaultdict(set)
    for r in got:
        alike[text[r.doc_id] or ""].add(r.fingerprint)
        a, b = (np.frombuffer(bytes.fromhex(x), np.uint8) for x in (r.fingerprint, r.edited_fingerprint))
        assert abs(r.near_edited - max(0, ((a == b).mean() - 1 / 256) / (1 - 1 / 256))) < 1e-9
    assert all(len(x) == 1 for x in alike.values())


def test_fingerprints_of_hostile_rows(spark, queries, sf, tmp_path):
    got = op(queries, 5)(spark, sf).collect()
    assert sorted(str((r.doc_id, r.n_chars)) for r in got) == sorted(str((i, len(t or ""))) for i, t in ROWS)
    one = op(queries, 5)(spark, write(spark, tmp_path / "one", [(4, Q)])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == brute.op5([(4, Q)])[4][1]


def test_quality_of_hostile_rows(spark, queries, sf):
    got = op(queries, 6)(spark, sf).collect()
    assert sorted(str((r.doc_id, r.held_out)) for r in got) == sorted(str((i, brute.held_out(i))) for i, _ in ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_quality_held_out(spark, queries):
    sf = "/root/testdata/sf0.01"
    rows = op(queries, 6)(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(bad) > 5 and np.mean([b < 0.7 for b in bad]) > 0.85 and np.mean([g >= 0.7 for g in good]) > 0.95


def test_quality_scores_are_dot_products():
    rng, bits = np.random.default_rng(2), 10
    weights = rng.normal(size=1 << bits)
    texts = ["", "one", "one two, two! 日本", "x " * 50]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    got = quality.dots(raw, np.cumsum([0, *(len(t.encode()) for t in texts)]), weights, bits)
    for t, g in zip(texts, got, strict=True):
        at, _ = quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), bits)
        assert abs(g - sum(weights[int(i)] for i in at) / max(1, len(at)) ** 0.5) < 1e-9


def test_bpe(spark, queries, sf):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from kronoleaf.llm.byte_bpe import read_ranks

    encoder = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken")))}, special_tokens={})
    want = [(i, len(ids := encoder.encode_ordinary(t or "")), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha((t or "").encode())) for i, t in ROWS]
    same(op(queries, 8)(spark, sf).collect(), want, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


@pytest.mark.parametrize("name", [*(f"op{n}" for n in range(1, 11)), "pipeline"])
def test_empty_tables(spark, queries, none, sf, name):
    q = next(q for k, q in queries.items() if k.split("_")[0] == name)
    assert q(spark, none).collect() == [] and q(spark, none).columns == q(spark, sf).columns


def test_very_long_texts(spark, queries, tmp_path):
    """Texts of a few hundred thousand characters, on one line and on many."""
    long = " ".join(f"w{i * 7919 % 100003}" for i in range(60_000))
    lines = "\n".join(f"the line of number {i} here" for i in range(20_000))
    rows = [(1, long), (2, long), (3, lines), (4, long + " end"), (5, "z" * 300_000), (6, lines + "\nmore"), (7, lines)]
    sf = write(spark, tmp_path / "long", rows)
    got = {n: {r.doc_id: r for r in op(queries, n)(spark, sf).collect()} for n in (1, 3, 4, 5, 6, 7, 8, 9, 10)}
    assert [got[1][i].n_removed for i in range(1, 8)] == [len(long), len(long), len(lines), len(long), 300_000, len(lines), len(lines)]
    assert [got[4][i].n_removed for i in range(1, 8)] == [0, 60_000, 0, 60_000, 0, 120_000, 120_000]
    assert [got[7][i].n_dropped for i in (3, 6, 7)] == [20_000, 20_000, 0]
    assert [got[9][i].component_id for i in range(1, 8)] == [1, 1, 3, 1, 5, 3, 3] and got[10][1].n_words == 60_000
    assert all(len(got[n]) == 7 for n in got) and got[8][5].decoded_sha256 == brute.sha(b"z" * 300_000) and got[5][5].n_chars == 300_000


# Stages of the pipeline, each on its own input.


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def kept_as_they_are(out, docs, but=()):
    """All rows that come out came in, with every column's value."""
    assert out.columns == docs.columns
    cols = [c for c in docs.columns if c not in but]
    have = collections.Counter(str([r[c] for c in cols]) for r in rows_of(docs))
    took = collections.Counter(str([r[c] for c in cols]) for r in rows_of(out))
    assert not took - have


def test_stage_quality(spark, sf):
    docs = documents(spark, sf)
    out = corpus_pipeline.quality_filter(spark, docs, sf)
    kept_as_they_are(out, docs)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score(docs, quality.train(docs, labels)).where("predicted = 1").select("doc_id", "text").collect()
    assert sorted(map(str, scored)) == sorted(map(str, out.select("doc_id", "text").collect())) and 0 < len(scored) < len(ROWS)


def test_stage_lines(spark, sf):
    docs = documents(spark, sf)
    out = corpus_pipeline.line_filter(spark, docs, sf)
    kept_as_they_are(out, docs, ("text", "n_chars"))
    want = [(i, "\n".join(x for x, g in ls if not g) if t is not None else None) for (i, t), ls in zip(ROWS, brute.kept_lines(ROWS), strict=True)]
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in rows_of(out)])) == sorted(map(str, want))
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows_of(out))


def test_stage_near_duplicates(spark, sf):
    docs = documents(spark, sf)
    out = corpus_pipeline.near_filter(spark, docs, sf)
    kept_as_they_are(out, docs)
    sets, root = brute.components(ROWS, 5)
    groups = collections.defaultdict(list)
    for (i, t), s, r in zip(ROWS, sets, root, strict=True):
        groups[r if s else (i, t, len(groups))].append((brute.order(i), t))
    got = [(brute.order(r["doc_id"]), r["text"]) for r in rows_of(out)]
    assert len(got) == len(groups)
    for members in groups.values():
        found = [g for g in got if g in members]
        assert found and found[0][0] == min(m[0] for m in members)


def test_stage_decontamination(spark, sf):
    docs = documents(spark, sf)
    out = corpus_pipeline.benchmark_filter(spark, docs, sf)
    kept_as_they_are(out, docs)
    want = [(i, t) for (i, t), w in zip(ROWS, brute.op10(ROWS, BENCH), strict=True) if not w[-1]]
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in rows_of(out)])) == sorted(map(str, want))


def test_pipeline_is_its_stages(spark, queries, sf):
    docs = documents(spark, sf)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).checkpoint()
    want = corpus_pipeline.bpe_encode(spark, docs, sf)
    got = queries["pipeline"](spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted(r.decoded_sha256 for r in got.collect()) == sorted(brute.sha((r.text or "").encode()) for r in docs.collect())


# Other ways through the operators.


def test_lines_by_segment_equal_broadcast(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    a, b = (line_dedup.drop_repeated_lines(docs, counts=("n", "d"), broadcast_bits=bits) for bits in (1 << 30, 0))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and any(r.d for r in b.collect())


def test_lines_through_a_full_filter(spark, sf, monkeypatch):
    """A filter that suspects all keys changes nothing."""
    docs = documents(spark, sf).select("doc_id", "text")
    want = line_dedup.drop_repeated_lines(docs).collect()
    full = zstandard.compress(b"\xff" * (line_dedup.SEGMENT_BITS // 8))
    monkeypatch.setattr(line_dedup, "twice_filter", lambda *_: spark.createDataFrame([(0, full)], "segment int, twice binary"))
    for bits in (1 << 30, 0):
        assert sorted(map(str, line_dedup.drop_repeated_lines(docs, broadcast_bits=bits).collect())) == sorted(map(str, want))


@pytest.mark.parametrize("block", [(1024, 4096), (2, 3), (1, 1)])
def test_near_duplicates_in_any_blocks(spark, block):
    """Chains and stars of near copies whose pivot links few of them, over all ways of blocking."""
    rng = np.random.default_rng(11)
    words = np.array([f"v{i}" for i in range(4000)])
    base = [list(rng.choice(words, 70)) for _ in range(3)]
    rows = []
    for b in base:
        drift = list(b)
        for _ in range(9):
            drift[rng.integers(70)] = str(rng.choice(words))
            rows.append((len(rows), " ".join(drift)))
    same_ids = near_dup.link_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, block=block, broadcast_ids=0)
    want = {i: c for i, _, c, _ in brute.op9(rows)}
    assert {r.o: r.root for r in same_ids.collect()} == want and len(set(want.values())) < 27


def test_links_across_finds_what_all_pairs_do():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 400, 60).astype(np.uint64)) for _ in range(30)]
    sets += [np.unique(np.concatenate([s[3:], rng.integers(400, 800, 3).astype(np.uint64)])) for s in sets]
    n = len(sets)
    rows = np.cumsum([0, *map(len, sets)])
    hashes = common_hash(np.concatenate(sets))
    sig = near_dup.signatures(hashes, rows).astype("<u2")
    node, root, few = np.arange(n), np.arange(n) % 7, np.arange(n) % 7 > 0
    side = np.concatenate([np.zeros(few.sum(), int), np.ones(n, int)])
    at = np.concatenate([np.flatnonzero(few), np.arange(n)])
    a, b = near_dup.links_across(node[at], root[at], few[at], side, sig[at], [sets[i] for i in at], near_dup.least_matches(80, 1e-9), 80)
    exact = {(i, j) for i in range(n) for j in range(i) if root[i] != root[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    got = {(max(x), min(x)) for x in zip(a.tolist(), b.tolist(), strict=True)}
    assert got <= exact and {(i, root[j]) for i, j in exact} | {(j, root[i]) for i, j in exact} >= {(i, root[j]) for i, j in got} and len(got) >= len(exact) // 2 and exact


def common_hash(x):
    from kronoleaf.llm.textkit import mix

    return mix(x + np.uint64(1))


def test_bpe_of_two_rank_files_in_one_worker(spark, tmp_path):
    import base64

    from kronoleaf.llm import byte_bpe

    single = [bytes([i]) for i in range(256)]
    docs = spark.createDataFrame([(1, "abab")], "n_tokens long, text string").coalesce(1)
    out = []
    for name, pair in (("one", b"ab"), ("two", b"ba")):
        (tmp_path / name).write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate([*single, pair])))
        out.append(byte_bpe.encode(docs.withColumnRenamed("n_tokens", "o"), str(tmp_path / name), ".+", ["o"], with_ids=True).first().ids)
    assert out == [[256, 256], [97, 256, 98]]
    (tmp_path / "few").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(single[1:])))
    with pytest.raises(ValueError, match="single bytes"):
        byte_bpe.encode(docs, str(tmp_path / "few"), ".+", ["n_tokens"])


def test_numbered_names_come_back(spark):
    df = spark.createDataFrame([(1, "t", 2, 3)], "doc_id long, text string, `c1` long, `odd.na``me` long")
    others, back = common.numbered(df, "text")
    out = df.select(*others, F.upper("text").alias("new")).select(*back("new"))
    assert out.columns == df.columns and tuple(out.first()) == (1, "T", 2, 3)


def test_stages_do_not_swallow_import_errors():
    for module in (corpus_pipeline, line_dedup, near_dup, quality):
        assert "ImportError" not in inspect.getsource(module)


def test_passages_in_many_contexts(spark):
    """One passage in contexts that all differ, against all windows."""
    rng = np.random.default_rng(6)
    passage, tail = " ".join(f"common{i}" for i in range(70)), " ".join(f"tail{i}" for i in range(40))
    some = lambda n: " ".join(f"x{v}" for v in rng.integers(0, 500, n))
    rows = [(i, f"{some(int(rng.integers(0, 30)))} {passage} {tail if i % 3 else ''} {some(int(rng.integers(0, 30)))}") for i in range(24)] + [(30, passage), (30, passage), (None, passage + " end"), (31, "short"), (32, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(suffix_dedup.remove_repeats(df).collect(), brute.op1(rows), COLUMNS[1])
    same(automaton_dedup.remove_repeats(df).collect(), brute.op4(rows), COLUMNS[4])
