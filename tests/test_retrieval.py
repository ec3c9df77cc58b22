"""Searches with bounds and automata against all pairs, on rows made to be awkward."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kronoleaf.operators import clusters, metric, multimatch, multisearch, sparse


def cosine_pairs(rows, least):
    out = []
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if len(x) == len(y) and sum(p * q for p, q in zip(x, y, strict=True)) / math.hypot(*x) / math.hypot(*y) >= least:
                out.append((min(a, b), max(a, b)))
    return sorted(out)


def near(centre, width, spread, n, seed):
    random.seed(seed)
    return [[c + random.gauss(0, spread) for c in centre[i % len(centre)]] for i in range(n)]


@pytest.mark.parametrize("block", [7, 4096])
def test_metric_edges(spark, block):
    random.seed(5)
    centres = [[random.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = list(enumerate(near(centres, 6, 0.2, 150, 1))) + [(200 + i, [0.5, 1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)] + [(300, [1.0, 2.0]), (301, [2.0, 4.0]), (302, [0.5, 1.0, 0.0])]
    odd = [(400, None), (None, [1.0] * 6), (401, [0.0] * 6), (402, [float("nan")] * 6), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0]), rows[0]]
    table = spark.createDataFrame(rows + odd, "id int, v array<double>")
    for least in (0.3, 0.9, 0.999):
        assert sorted(map(tuple, metric.near_edges(table, "id", "v", least, block=block).collect())) == cosine_pairs(rows, least)
    assert metric.near_edges(table.where("id > 1000"), "id", "v", 0.5).count() == 0


def test_metric_prunes(spark):
    random.seed(6)
    rows = list(enumerate(near([[random.gauss(0, 1) for _ in range(32)] for _ in range(40)], 32, 0.02, 2000, 2)))
    made = metric.products_made(metric.near_pairs(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", 0.9)).first()
    assert made.pairs == 40 * (50 * 49 // 2) and made.products < 0.06 * 2000 * 2000


def test_metric_without_clusters_sends_few_copies(spark):
    """Where every cell would be visited, cells give way to blocks; pairs leave in slices, and a piece of placed rows is bounded."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=64)]) for i in range(900)], "i int, v array<double>")
    centre = metric.unit_rows(pa.array([r.v for r in rows.limit(64).collect()], pa.list_(pa.float64())), 64)[0]
    apart = np.sqrt(np.maximum(2 - 2 * centre @ centre.T, 1e-300))
    assert metric._cheapest(rows, centre, apart, math.sqrt(2 - 2 * 0.42), 4096) <= 16
    same = np.ones((700, 4)) / 2
    slices = list(metric._near_pairs(same, np.repeat(same, 10, 0), 0.9, 1))
    assert len(slices) > 1 and sum(len(i) for i, _, _ in slices) == 700 * 7000 and max(len(i) for i, _, _ in slices) <= 1 << 20


def test_string_ids(spark):
    table = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.1]), ("c", [0.0, 1.0])], "id string, v array<float>")
    assert [tuple(r) for r in metric.near_edges(table, "id", "v", 0.9).collect()] == [("a", "b")]


def test_terms(spark):
    random.seed(2)
    texts = ["".join(random.choice("abcアイ ") for _ in range(random.randint(0, 12))) for _ in range(400)] + [None, "", "ABC" * 30_000]
    terms = ["ab", "B ", "", None, "  ", "アイ", "abc", "cab", "ab", "zz", "c a"]
    table = spark.createDataFrame([(i, t, "x" if i % 2 else t) for i, t in enumerate(texts)], "id int, t string, u string")
    wanted = spark.createDataFrame([(t,) for t in terms], "term string")
    want = sorted((i, f, w) for i, t in enumerate(texts) for f, x in (("t", t), ("u", "x" if i % 2 else t)) if x for w in {(t or "").strip().lower() for t in terms} - {""} if w in x.lower())
    for chars in (1, 4, 1000):
        assert sorted(map(tuple, multimatch.find_terms(table, "id", ["t", "u"], wanted, "term", chars).collect())) == want
    assert multimatch.find_terms(table, "id", ["t"], wanted.where("term is null"), "term").count() == 0


def test_expansion(spark):
    triggers = spark.createDataFrame([("dinner", 2, ["meal", "supper"]), ("ramen", 1, ["noodles", "meal"]), ("bus", 3, ["coach"])], "trigger string, place int, terms array<string>")
    rows = spark.createDataFrame([("ramen dinner",), (" walk ",), ("bus",)], "q string")
    got = {r.q: r.terms for r in multimatch.expanded(rows, "q", triggers).collect()}
    assert got == {"ramen dinner": ["ramen dinner", "noodles", "meal", "supper"], " walk ": ["walk"], "bus": ["bus", "coach"]}


def test_sparse_search(spark):
    random.seed(4)
    texts = ["".join(random.choice("abcdefghij ") for _ in range(random.randint(0, 14))) for _ in range(900)] + ["same words"] * 9
    sources = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[:40], "same words", "", "zzzz"])], "q int, query_text string")
    cells = np.zeros((len(texts), 384))
    for r in clusters.text_vectors(sources, "id", "t").collect():
        cells[r.id, r["index"]] = r.value
    rows = np.zeros((43, 384))
    for r in clusters.text_vectors(asked, "q", "query_text").collect():
        rows[r.q, r["index"]] = r.value
    scores = np.round(rows @ cells.T, 9)
    want = [(q, i, k) for q in range(43) for k, (_, i) in enumerate(sorted((-s, i) for i, s in enumerate(scores[q]) if s > 0)[:5], 1)]
    got = sparse.semantic_search(asked, "q", sources, "id", "t", 5)
    assert sorted((r.q, r.id, r["rank"]) for r in got.collect()) == sorted(want)


def test_sparse_bounds(spark):
    """Lists that cannot matter are left shut: far fewer pairs are scored than there are."""
    random.seed(8)
    index = [(k, i, 1.0 if i == k % 50 else random.random() * 0.02) for k in range(600) for i in {k % 50, *random.sample(range(50), 12)}]
    queries = [(q, i, 1.0 if i == q else 0.05) for q in range(50) for i in {q, (q + 7) % 50, (q + 9) % 50}]
    counted = []
    got = sparse.top(spark.createDataFrame(queries, "query int, index int, q double"), spark.createDataFrame(index, "key int, index int, value double"), 3, counted=counted).collect()
    scores = {}
    for q, i, w in queries:
        for k, j, v in index:
            if i == j:
                scores[q, k] = scores.get((q, k), 0) + w * v
    want = sorted((q, k) for q in range(50) for _, k in sorted((-round(s, 9), k) for (p, k), s in scores.items() if p == q)[:3])
    assert sorted((r.query, r.key) for r in got) == want and counted[0] < 0.2 * 50 * 600


def test_candidates(spark):
    """A medium counts by its best vector, and as many media come out as are asked for."""
    random.seed(9)
    vectors = [(i, i % 30, [random.gauss(0, 1) for _ in range(4)]) for i in range(75)]
    queries = [(1000 + q, [random.gauss(0, 1) for _ in range(4)]) for q in range(5)]
    got = multisearch.vector_candidates(spark.createDataFrame(queries, "query_id long, embedding array<double>"), spark.createDataFrame(vectors, "vec_id long, media_id long, embedding array<double>"), 6).collect()
    want = []
    for q, x in queries:
        best = {}
        for _, m, y in vectors:
            best[m] = max(best.get(m, -9), sum(a * b for a, b in zip(x, y, strict=True)) / math.hypot(*x) / math.hypot(*y))
        want += [(q, m) for _, m in sorted((-round(max(0, min(s, 1)), 4), m) for m, s in best.items())[:6]]
    assert sorted((r.query_id, r.media_id) for r in got) == sorted(want)
    hits = multisearch.text_hits(spark.createDataFrame([(1, "a"), (1, "B"), (2, "zz"), (2, None)], "query_id int, term string"), spark.createDataFrame([(7, "A b", "x b"), (8, None, "nothing")], "id int, f string, g string"), "id", {"one": ["f", "g"], "two": ["g"]})
    assert {(r.query_id, r.id): (round(r.one, 2), round(r.two, 2)) for r in hits.collect()} == {(1, 7): (0.6, 0.3)}


@pytest.mark.parametrize("few", [0, 500_000])
def test_events_are_looked_up_for_the_candidates_alone(spark, monkeypatch, few):
    """The first event of each medium asked for, as of all media; where these are few, no row of other media meets events."""
    random.seed(3)
    monkeypatch.setattr(multisearch, "FEW", few)
    met, choose = [], multisearch.first_event
    monkeypatch.setattr(multisearch, "first_event", lambda evidence, events: met.append((evidence.count(), events.count())) or choose(evidence, events))
    evidence = [(f"e{random.randrange(60)}", f"m{random.randrange(90)}") for _ in range(500)] + [("gone", "m1"), ("e1", None), (None, "m2")]
    events = {f"e{i}": (f"2024-01-{random.randrange(3) + 1:02d}", f"0{random.randrange(3)}:00", f"t{i}", None if i % 4 else 0.5) for i in range(60)}
    overrides = {f"e{i}": (i % 6 == 0, i % 5 == 0, "new" if i % 4 == 0 else "") for i in range(0, 60, 2)}
    asked = [f"m{i}" for i in range(0, 100, 7)]
    make = spark.createDataFrame
    got = multisearch.events_of_media(
        make([(m,) for m in asked], "media_id string"), make(evidence, "event_id string, evidence_id string"),
        make([(i, d, at, t, None, None, c) for i, (d, at, t, c) in events.items()], "id string, date string, start_time string, title string, summary string, location_name string, confidence double"),
        make([(i, t, None, None, 0, int(h), int(p)) for i, (h, p, t) in overrides.items()], "event_id string, title_override string, summary_override string, location_name_override string, is_verified int, is_hidden int, is_pinned int"),
    )
    state = lambda e: overrides.get(e, (False, False, ""))
    want = {}
    for m in asked:
        own = sorted((-state(e)[1], *events[e][:2], e) for e, x in evidence if x == m and e in events and not state(e)[0])
        if own:
            e = own[0][-1]
            want[m] = (e, state(e)[2] or events[e][2], events[e][3] or 0.0, int(state(e)[1]))
    shown = [(e, m) for e, m in evidence if m in asked] if few else evidence
    assert met == [(len(shown), len({e for e, _ in shown} & set(events)) if few else len(events))]
    assert {r.media_id: (r.event_id, r.event_title, r.event_confidence, r.event_pinned) for r in got.collect()} == want and got.count() == len(want)


def test_lines_said_alike_are_counted(spark):
    lines = [("d1", "To Eat")] * 5 + [("d1", "eat ramen"), ("d2", "eat ramen"), ("d2", None), (None, "ramen"), ("d1", "x")]
    asked = spark.createDataFrame([("q", "eat"), ("q", "ramen"), ("r", "ramen"), ("s", "zz")], "query_id string, term string")
    got = multisearch.line_hits(asked, spark.createDataFrame(lines, "date string, text string"))
    assert {tuple(r) for r in got.collect()} == {("q", "d1", 6), ("q", "d2", 1), ("r", "d1", 1), ("r", "d2", 1), ("q", None, 1), ("r", None, 1)}


def test_scan_reaches_the_files(spark, tmp_path):
    from kronoleaf.operators import scans

    days = [f"2024-01-{d:02d} 1{d % 10}:00:00" for d in range(1, 29)] + ["2024-01-09", "2024-01-099", None]
    spark.createDataFrame([(d, i % 3) for i, d in enumerate(days)], "sent_at string, k int").write.parquet(str(tmp_path / "t"))
    out = scans.scan(spark.read.parquet(str(tmp_path / "t")), F.col("sent_at"), date_from="2024-01-04", date_to="2024-01-09", k=[1, 2])
    assert {r.sent_at for r in out.collect()} == {d for i, d in enumerate(days) if d and i % 3 and "2024-01-04" <= d[:10] <= "2024-01-09"}
    plan = out._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(sent_at,2024-01-04)" in plan and "LessThan(sent_at,2024-01-0:)" in plan and "In(k" in plan


def test_media_of_many_vectors_send_their_best(spark):
    """A block sends a row a medium and query, not a row for each of a medium's vectors, and the best media are among them."""
    rng = np.random.default_rng(12)
    rows = [(i, f"m{i % 30}", [float(x) for x in rng.normal(size=5)]) for i in range(900)]
    v = spark.createDataFrame(rows, "vec_id long, media_id string, embedding array<double>")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    want = {}
    for k, _, x in rows[::100]:
        for i, m, y in rows:
            if i != k:
                want[k, m] = max(want.get((k, m), 0.0), round(cosine(x, y), 4))
    want = {(k, m, s) for k in range(0, 900, 100) for s, m in [(s, m) for s, m in sorted(((s, m) for (j, m), s in want.items() if j == k), key=lambda r: (-r[0], r[1]))[:6]]}
    assert {tuple(r) for r in multisearch.vector_candidates(q, v, 6).collect()} == want
    sent = multisearch.nearest_groups(v, q, 6, 5e-5, 75)
    assert sent.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 3 * 8 and sent.count() < 9 * 30 * 4
    assert {tuple(r) for r in sent.groupBy("query_id", "media_id").agg(F.round(F.max("score"), 4)).collect()} >= want


def test_threshold_edges_with_nulls(spark):
    from kronoleaf.operators import vectors

    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (None, [1.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, None])], "id long, v array<double>")
    assert [tuple(r) for r in vectors.threshold_edges(table, "id", "v", 0.9).collect()] == [(1, 2)]


def test_threshold_edges_do_not_depend_on_slices(spark, monkeypatch):
    from kronoleaf.operators import vectors

    v = np.random.default_rng(5).normal(size=(70, 4))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    wanted = [(i, j) for i in range(70) for j in range(i + 1, 70) if unit[i] @ unit[j] >= 0.7]
    table = spark.createDataFrame([(i, row) for i, row in enumerate(v.tolist())], "id long, v array<double>")
    for rows in (1, 16, 1000):
        monkeypatch.setattr(vectors, "SLICE", rows)
        assert sorted(map(tuple, vectors.threshold_edges(table, "id", "v", 0.7, block=30).collect())) == wanted
