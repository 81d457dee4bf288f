"""Resampling, whitening and decontamination on small tables, against plain versions of their rules."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import ann, decontamination, fingerprint, html_main, packing, resampling, spectra, suffix_dedup, whitening, words
from noticeflow.llm import queries as registered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOME = "alpha Beta γάμμα delta é1 zeta-eta Theta iota2 KAPPA lambda ñ".split()


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(SOME) + r.choice(["", ",", ".\n", "7"]) for _ in range(n))


TEXTS = [
    (1, prose(1, 200)), (2, prose(1, 200)), (3, None), (4, ""), (5, "only three words"), (None, prose(2, 60)), (None, prose(2, 60)), (None, prose(3, 60)),
    (9, prose(4, 19)), (9, prose(5, 80)), (9, prose(5, 80)), (12, "… --- …"), *[(100 + i, prose(50 + i, 15 + i)) for i in range(60)],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "score", 5, "x") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, rank int, row string").repartition(3)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(i, prose(900 + i, 40) + " target words") for i in range(5)] + [(7, None), (None, "Delta")], "item_id long, text string")


def test_words_of_pieces_are_those_of_the_whole(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 7)
    for text in ("", "a", "é" * 50, "Ab,cD\x00ef ÀÉ９ x_y", prose(3, 50), "," * 40, "z" * 30 + " b"):
        found = [w.decode() for part in words.word_lists(text.encode()) for w in part]
        assert found == plain_words(text)
    assert list(words.word_lists(None)) == []


# 11: resampling


def plain_features(text):
    w = plain_words(text)
    return w + [" ".join(x) for x in zip(w, w[1:])]


def plain_rows(rows, targets, least=20, percent=25, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = Counter(bucket(f) for _, t in rows for f in plain_features(t))
    aim = Counter(bucket(f) for t in targets for f in plain_features(t))
    n_own, n_aim = sum(own.values()), sum(aim.values())
    out = []
    for i, t in rows:
        f = [math.floor(1000 * math.log((aim[b] + 1) * (n_own + buckets) / ((own[b] + 1) * (n_aim + buckets)))) for b in map(bucket, plain_features(t))]
        weight = sum(f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(plain_words(t)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, fit[: percent * len(fit) // 100]


def test_resampling_by_its_rule(docs, target):
    every, drawn = plain_rows(TEXTS, [r.text for r in target.collect()])
    got = resampling.resampled(docs, target, keep=["score", "row"]).collect()
    assert Counter((r.id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(every)
    first = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in first] == list(range(1, len(drawn) + 1))
    assert [(r.id, r.score) for r in first] == [(d[0], d[4]) for d in drawn]
    assert got[0]["row"]["score"] == "score" and got[0]["row"]["row"] == "x"


@pytest.mark.parametrize("percent", [1, 37, 50, 99, 100])
def test_resampling_draws_just_as_many(spark, target, percent):
    rows = [(None if i % 3 == 0 else 8 if i % 3 == 1 else i, prose(7 if i % 3 else 8, 30)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _, drawn = plain_rows(rows, [r.text for r in target.collect()], percent=percent)
    got = sorted((r.rank, r.score) for r in resampling.resampled(df, target, percent=percent).collect() if r.rank)
    assert got == [(k + 1, d[4]) for k, d in enumerate(drawn)]


def test_resampling_empty_tables(docs, target):
    assert resampling.resampled(docs.limit(0), target).count() == 0
    assert resampling.resampled(docs, target.limit(0)).filter("rank is not null").count() > 0


def test_cutoff_is_the_least_value(spark):
    values = [5, -3, 7, 7, 7, 100, -50, 8]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for need in range(1, len(values) + 1):
        value, size = resampling.cutoff(df, "v", need)
        assert size == sum(v <= value for v in values) >= need
        assert sum(v < value for v in values) < need or size == need


def test_features_of_longer_runs_over_pieces(monkeypatch):
    text = prose(11, 40)
    w = plain_words(text)
    want = Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 1000 for n in (1, 2, 3) for i in range(len(w) - n + 1))
    for piece in (1, 9, 50, 1 << 20):
        monkeypatch.setattr(words, "PIECE", piece)
        n, found = resampling.features(text.encode(), 1000, 3)
        assert n == len(w) and Counter(np.concatenate(found).tolist()) == want


# 12: whitening


def test_spectra_of_rank_one_changes():
    rng = np.random.default_rng(3)
    for n, dim in ((1, 4), (2, 4), (40, 6), (300, 24)):
        x = np.floor(rng.standard_normal((n, dim)) * 8)
        x[:, 1] = x[:, 0]  # a direction without variance
        x[n // 2] = x[0]
        parts = [spectra.Spectrum.empty(dim) for _ in range(3)]
        for k, row in enumerate(x):
            parts[k % 3].add(row)
        whole = parts[0]
        for other in parts[1:]:
            whole.merge(other)
        scatter = (x - x.mean(0)).T @ (x - x.mean(0))
        assert whole.n == n and np.allclose(whole.mean, x.mean(0))
        size = max(1.0, float(np.abs(scatter).max()))
        assert np.abs(whole.vectors @ np.diag(whole.values) @ whole.vectors.T - scatter).max() < 1e-11 * size
        assert np.abs(whole.vectors.T @ whole.vectors - np.eye(dim)).max() < 1e-11


def test_secular_roots_lie_between_the_poles():
    rng = np.random.default_rng(4)
    for _ in range(50):
        d = np.cumsum(10.0 ** rng.uniform(-9, 3, 12))
        z2 = 10.0 ** rng.uniform(-12, 2, 12)
        origin, tau = spectra.secular_roots(d, z2, 0.7)
        want = np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(np.sqrt(z2), np.sqrt(z2)))
        roots = d[origin] + tau
        assert np.all(roots >= d) and np.all(roots[:-1] <= d[1:]) and np.abs(roots - want).max() < 1e-12 * want.max()


def plain_whitening(vectors, k):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    once = np.array(sorted({tuple(r) for r in x}), dtype=np.int64)
    n, sums = len(once), once.sum(axis=0)
    away = (n * np.array(x) - sums) / n
    fit = (n * once - sums) / n
    values, found = np.linalg.eigh(fit.T @ fit / n)
    values, found = values[::-1], found[:, ::-1]
    deviation = [sum((n * a - int(s)) ** 2 for a, s in zip(r, sums.tolist(), strict=True)) for r in x]
    return n, deviation, away @ found[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whitening_by_its_rule(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = (rng.standard_normal((700, 24)) * np.linspace(0.05, 0.4, 24)).astype(np.float32)
    v[100:350] = v[7]  # a third and more of all rows are equal
    odd = [(9000, None, 1), (9001, [], 1), (9002, [float("nan")] * 24, 1), (9003, [None] * 24, 1), (9004, [float("inf")] * 24, 1), (9005, [1.0], 1), (9006, [1e30] * 24, 1)]
    rows = [(None if i == 3 else i, r.tolist(), 1) for i, r in enumerate(v)] + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int").repartition(5)
    monkeypatch.setattr(whitening, "SHARE", 60)
    monkeypatch.setattr(whitening, "FAN", 3)
    taken = whitening.whole(df, "embedding")
    model = whitening.fit(taken)
    found = whitening.whitened(taken, model).select("row.vec_id", "row.x", "deviation", "whitened").collect()
    n, deviation, y, explained = plain_whitening(v, 16)
    assert model.n == n == 450 and model.identity_error < 1e-10
    assert np.abs(model.variances / model.trace / explained - 1).max() < 1e-12
    got = {r.vec_id: r for r in found}
    assert len(found) == 700 and set(got) == {None, *range(700)} - {3} and got[5].x == 1
    mine = np.array([got[None if i == 3 else i].whitened for i in range(700)])
    assert [got[None if i == 3 else i].deviation for i in range(700)] == deviation
    signs = np.sign((mine * y).sum(axis=0))
    assert np.abs(mine - y * signs).max() < 1e-9
    own = whitening.whiten(df, components=4)
    assert own.columns == df.columns and own.filter("vec_id = 5").first()["embedding"] == pytest.approx(mine[5][:4].tolist())


def test_whitening_without_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [r.embedding for r in whitening.whiten(df).collect()] == [[], []]
    assert whitening.whiten(df.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {len(r.embedding) for r in whitening.whiten(line).collect()} == {1}


def test_deviations_beyond_a_long():
    assert whitening._deviations(np.array([[1 << 40, 1 << 40], [3, 4]], dtype=np.int64)).to_pylist() == [None, 25]


# 13: decontamination

ITEMS = [
    (10, "One two three four five six seven eight nine ten ELEVEN twelve"), (11, "short item"), (9, "two three four five six seven eight nine ten eleven and on"),
    (12, None), (13, "…"), (None, "an item without any id but of enough words to be a window"), (11, "another short"), (14, "uno"),
]


def plain_hits(text, items):
    w = plain_words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = plain_words(t)
        n = min(10, len(iw))
        for win in {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if iw else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == win:
                    hit |= set(range(i, i + n))
                    found |= {str(item)} - {"None"}
    return len(w), len(hit), sorted(found)


LEAKS = [
    (1, "before. One, two; three four FIVE six seven eight nine ten eleven twelve after"), (2, "three four five six seven eight nine ten eleven"), (3, None), (4, ""),
    (5, "a Short  item, and another-short one: short item"), (6, "uno dos uno"), (None, "an item without any id but of enough words to be a window"),
    (7, prose(1, 300) + " " + ITEMS[0][1] + " " + prose(2, 300) + " short item"), (7, "clean"), (8, "one two three four five six seven eight nine ten eleven and on"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("piece,block", [(1 << 20, 64 << 20), (40, 64 << 20), (1 << 20, 300)])
def test_decontamination_by_its_rule(spark, items, monkeypatch, piece, block):
    monkeypatch.setattr(decontamination, "PIECE", piece)
    monkeypatch.setattr(words, "PIECE", piece)
    needles = decontamination.Needles([(w, None if i is None else str(i)) for i, t in ITEMS for w in decontamination.windows((t or "").encode())])
    counts, found = decontamination.scan([None if t is None else t.encode() for _, t in LEAKS], needles)
    for k, (_, t) in enumerate(LEAKS):
        spans, names = found.get(k, ([], []))
        assert (counts[k], sum(b - a + 1 for a, b in spans), names) == plain_hits(t, ITEMS)
    df = spark.createDataFrame([(i, t, "row", 1) for i, t in LEAKS], "doc_id long, text string, spans string, at int").repartition(3)
    got = decontamination.matched(df, items, block_bytes=block).withColumn("n", decontamination.n_hit(F.col("spans"))).collect()
    assert Counter((r.row.doc_id, r.n_words, r.n, tuple(r["items"])) for r in got) == Counter((i, a, b, tuple(c)) for i, t in LEAKS for a, b, c in [plain_hits(t, ITEMS)])


def test_decontaminated_texts(spark, items):
    df = spark.createDataFrame(LEAKS, "doc_id long, text string")
    cut = {r.doc_id: r.text for r in decontamination.decontaminated(df.filter("doc_id <> 7"), items).collect()}
    assert cut[1] == "before.  after" and cut[2] == LEAKS[1][1] and cut[3] is None and cut[4] == "" and cut[6] == " dos " and cut[5] == "a , and  one: "
    kept = decontamination.decontaminated(df, items, how="documents")
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 7] and kept.columns == df.columns
    assert decontamination.decontaminated(df, items, how="documents", share=0.9).filter("doc_id = 1").count() == 1
    assert decontamination.decontaminated(df.limit(0), items).count() == 0
    assert decontamination.decontaminated(df, items.limit(0)).filter("doc_id = 1").first()["text"] == LEAKS[0][1]
    with pytest.raises(ValueError):
        decontamination.decontaminated(df, items, how="other")


def test_the_three_are_registered():
    assert {"op11_resampling", "op12_whitening", "op13_decontamination"} <= set(registered.queries())


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["op11_resampling", "op13_decontamination"])
def test_queries_equal_their_sql(spark, name):
    sql = duckdb.connect()
    for t in ("documents", "benchmark"):
        sql.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    columns, rows = (lambda r: (r.columns, r.fetchall()))(sql.sql(registered.oracle_sql()[name]))
    found = registered.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert Counter(tuple(r) for r in found.select(columns).collect()) == Counter(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, deviation, y, explained = plain_whitening([r.embedding for r in rows], 16)
    found = registered.queries()["op12_whitening"](spark, SF).toPandas()
    assert len(found) == 16 * len(rows) and (found["n"] == n).all() and found["identity_error"].max() < 1e-9
    mine = found.pivot(index="vec_id", columns="component", values="whitened").loc[[r.vec_id for r in rows]].to_numpy()
    assert np.abs(mine - y * np.sign((mine * y).sum(axis=0))).max() < 1e-8
    assert np.allclose(found.groupby("component")["explained"].first(), explained, rtol=1e-10)
    assert dict(zip(found["vec_id"], found["deviation"], strict=True)) == dict(zip([r.vec_id for r in rows], deviation, strict=True))


# hot ids: a third of all rows without one, a third with the same one


@pytest.fixture(scope="module")
def hot(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else 1000 + i, prose(i, 40) + (" shared passage of words" * 6 if i % 5 == 0 else "")) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def largest_share(df, *columns):
    """The share of rows of the largest partition that a shuffle by some columns makes."""
    sizes = [r["count"] for r in df.repartition(16, *columns).groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_hot_ids_are_spread(spark, hot):
    parts = hot.repartitionByRange(16, "doc_id", F.substring("text", 1, 64)).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 0.2 * 600  # as op3 deals its rows
    assert largest_share(hot, "doc_id") > 0.3 > 0.2 > largest_share(hot, F.xxhash64("doc_id", "text"))  # as op5 does


def test_fingerprints_of_hot_ids_follow_the_order_of_texts(hot):
    rows = sorted(hot.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text))
    want = Counter()
    for a, b in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(a.text) // 2
        want[(a.doc_id, hashlib.sha256((a.text[: len(a.text) - half] + b.text[:half]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in fingerprint.fingerprints(hot).collect()) == want


def test_packing_of_hot_ids(hot):
    got = packing.packed(hot.withColumn("text", F.lit("one two three"))).collect()
    assert len(got) == 600 and len({(r.sequence_id, r.offset) for r in got}) == 600
    each = Counter(r.sequence_id for r in got)
    most = packing.CAPACITY // got[0].length
    assert sorted(each.values(), reverse=True) == [most] * (600 // most) + ([600 % most] if 600 % most else [])


def test_suffix_dedup_of_hot_ids(hot):
    cuts = {}
    for r in suffix_dedup.deduplicated(hot).collect():
        cuts.setdefault(r.doc_id, []).append(r.cut.n_removed)
    assert not any(cuts[None])  # no id is smaller than theirs
    assert sum(n > 0 for k, v in cuts.items() if k is not None and k > 1000 for n in v) >= 30


def test_neighbours_of_an_id_with_very_many_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    rng = np.random.default_rng(6)
    v = rng.standard_normal((600, 8))
    ids = [7 if i % 3 == 1 else 1000 + i for i in range(600)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    rows = ann.nearest(df, df.filter("vec_id = 1020")).orderBy("rank").collect()
    scores = v @ v[20]
    best = {i: max(s for j, s in zip(ids, scores, strict=True) if j == i) for i in set(ids) - {1020}}
    assert [(r.vec_id, round(r.score, 9)) for r in rows] == [(i, round(s, 9)) for i, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_all_queries_of_a_table(spark, sf):
    path = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("the driver's tables aren't here")
    rows = [r for r in spark.read.parquet(path).select("vec_id", "embedding").collect() if r.embedding and all(math.isfinite(x) for x in r.embedding)]
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    found = {}
    for r in registered.queries()["op1_ann"](spark, os.path.dirname(path)).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    shares = []
    for q in np.flatnonzero(ids % 20 == 0):
        scores = v @ v[q]
        scores[q] = -np.inf
        shares.append(len(found[ids[q]] & set(ids[np.lexsort((ids, -scores))[:20]].tolist())) / 20)
    assert np.mean(shares) >= 0.95


def test_names_inside_of_an_article_count_as_wholes():
    said = [f"The reader will see that part {c} of the text is the same as it was in the first of them." for c in "abcdefg"]
    page = (
        f'<article><p>{said[0]}</p><p class="ad-hoc">{said[1]}</p><div class="form-factor intro"><p>{said[2]}</p></div><div class="ad-box"><p>{said[3]}</p></div>'
        f'<div id="comments-2"><p>{said[4]}</p></div><p>{said[5]}</p><section class="search results"><p>{said[6]}</p></section></article>'
    )
    assert html_main.main_text(page) == " ".join(said[i] for i in (0, 1, 2, 5))
