"""The ten operators on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import ann, common, fingerprint, html_main, line_dedup, near_dedup, packing, pieces, sharding, suffix_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


BASE = prose(1, 120)
TEXTS = [
    (1, BASE),
    (2, BASE),
    (3, BASE + " one more word"),
    (4, None),
    (5, ""),
    (6, "short"),
    (7, "é" * 60 + "\n" + prose(2, 30)),
    (8, prose(3, 20000)),
    (9, "x\n" + BASE[100:300] + "\ny"),
    (None, "no id " + prose(4, 20)),
    (11, prose(5, 4)),
    (11, prose(5, 4)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in TEXTS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1: nearest neighbours


def test_ann_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((1500, 16)).astype(np.float32)
    v[10] = v[20] = v[40]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16), (9005, [float("inf")] * 16), (None, v[0].tolist()), (9006, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    d = v.astype(float)
    for q in range(0, 1500, 20):
        s = d @ d[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(m[2] - s[m[1]]) < 1e-9 for m in mine) and q not in {m[1] for m in mine}
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        hits += len({m[1] for m in mine} & set(best.tolist()))
        total += 20
    assert hits / total >= 0.9
    assert 9006 not in got or got[9006] == []
    first = [m[1] for m in sorted(got[40])[:2]]
    assert first == [10, 20]  # equal vectors, smaller ids first


def test_ann_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    rows = ann.nearest(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in rows] == [(0, 1, 20), (0, 2, 3), (20, 1, 3), (20, 2, 0)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


# 2: pieces


def apply(ids: np.ndarray, changes) -> list[int]:
    flat, out, at = ids.tolist(), [], 0
    for a, b, c in sorted(changes):
        out += flat[at:a] + list(c)
        at = b
    return out + flat[at:]


def test_pieces_match_the_library_as_a_unigram_lattice():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    with open(pieces.vocabulary_path(), "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    own = pieces.lattice(pieces.vocabulary_path())
    score = lambda ids: sum(own.scores.get(own.pieces[i], 0) for i in ids)
    texts = ["hello the", "a", "the tion of things", "né ñü est là", " two  spaces", "haenbleat, of. 12"]
    texts += [prose(s, 4).translate({ord(c): None for c in "0123456789"}) for s in range(40)]
    for t in texts:
        whole = own.encode([t], 5)[0]
        ids, best, found = whole.ids, whole.score, whole.nbest
        mine = [apply(ids, c) for _, c in found]
        theirs = library.nbest_encode(t, nbest_size=5, out_type=int)
        assert np.allclose([score(x) for x in mine], [score(x) for x in theirs]), t
        assert np.allclose([s for s, _ in found], [score(x) for x in mine]) and len({tuple(m) for m in mine}) == len(mine)
        assert all(own.decode(m) == t == library.decode(m) for m in mine)
        assert mine[0] == ids.tolist() and best == found[0][0]


def test_pieces_n_best_by_enumeration():
    own = pieces.lattice(pieces.vocabulary_path())

    def every(text):
        if not text:
            return [(0.0, ())]
        return [(s + own.scores[text[:k]], (own.ids[text[:k]], *rest)) for k in range(1, len(text) + 1) if text[:k] in own.ids for s, rest in every(text[k:])]

    for stretch in ("▁then", "▁ofthe", "tion", "▁a"):
        ways = sorted((s for s, _ in every(stretch)), reverse=True)
        assert np.allclose([s for s, _ in own.n_best(stretch, 7)], ways[:7])


def test_pieces_solved_together_equal_those_solved_alone(monkeypatch):
    texts = [prose(s, 60) for s in range(12)] + ["née ñ! 12,3\nx\n\n y", "", " lead", "a  b", "中文 字, ok", "z" * 300, "snow☃man \u2581 x"]
    found = []
    for least in (0, 1 << 30):
        monkeypatch.setattr(pieces, "LEAST_TOGETHER", least)
        own = pieces.Lattice(pieces.vocabulary_path())
        found.append([(s.ids.tolist(), round(s.score, 6), [(round(x, 6), c) for x, c in s.nbest]) for s in own.encode(texts, 4)])
        assert [own.decode(x[0]) for x in found[-1]] == texts[:-1] + ["snow☃man   x"]
    assert found[0] == found[1]


def test_pieces_squeezes_spaces_where_the_vocabulary_says_so():
    own = pieces.Lattice(pieces.vocabulary_path())
    own.squeeze = True
    assert own.stretches("  two   spaces ") == own.stretches("two spaces") == ["two", "spaces"] and own.stretches("   ") == []


def test_pieces_rows(docs, empty):
    rows = pieces.encoded(docs.withColumn("encoded", F.lit(1)), n=3).collect()
    assert len(rows) == len(TEXTS) and all(r.encoded.exact for r in rows)
    for r in rows:
        assert r.encoded.ids_crc32 == zlib.crc32(np.array(r.encoded.ids, "<u4").tobytes())
        assert 1 <= len(r.encoded.nbest) <= 3 and r.encoded.nbest[0].score == r.encoded.score
        if not r.text:
            assert list(r.encoded.ids) == [] and len(r.encoded.nbest) == 1
    wide = pieces.encoded(docs, n=3).withColumn("ways", F.expr("transform(encoded.nbest, x -> x.changes)"))
    ways = F.transform("ways", lambda c: pieces.changed(F.col("encoded.ids"), c))
    for r in wide.withColumn("ways", ways).collect():
        assert [list(w) for w in r.ways] == [apply(np.array(r.encoded.ids), [(c.start, c.stop, c.ids) for c in b.changes]) for b in r.encoded.nbest]
        assert [len(w) for w in r.ways] == [b.n_pieces for b in r.encoded.nbest] and list(r.ways[0]) == list(r.encoded.ids)
    twice = pieces.encoded(docs.filter("doc_id = 11")).select("encoded.ids", "encoded.nbest").collect()  # repeated rows
    assert len(twice) == 2 and twice[0] == twice[1]
    back = pieces.decoded(pieces.encoded(docs), F.col("encoded.ids")).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert pieces.encoded(empty).count() == 0


# 3: fingerprints


def test_fingerprints(docs, empty):
    rows = fingerprint.fingerprints(docs).collect()
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    assert len(rows) == len(TEXTS)
    want = Counter()
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        d = fingerprint.digest
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), d(t), d(e), round(fingerprint.likeness(d(t), d(e)), 9), round(fingerprint.likeness(d(t), d(n)), 9)] += 1
    assert want == Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)
    assert fingerprint.fingerprints(empty).count() == 0


def test_fingerprint_scores():
    a, b, c = prose(1, 300), prose(2, 300), prose(1, 290) + " other words here"
    f = fingerprint.digest
    assert fingerprint.difference(f(a), f(a)) == 0 and fingerprint.likeness(f(a), f(a)) == 1.0
    assert fingerprint.likeness(f(a), f(c)) > fingerprint.likeness(f(a), f(b))
    assert fingerprint.difference(f(a), f("")) <= fingerprint.BOUND and f("ab") != f("cd")


# 4: sharding


def test_sharding(spark, docs, empty):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 97 as int))").alias("text"))
    rows = sharding.shard(many, 8).collect()
    load = Counter()
    slots = {}
    for r in rows:
        load[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        t = "x" * (r.doc_id % 97)
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t.encode()), "bytes", None)
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) <= 97
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    odd = sharding.shard(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in odd) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    assert sharding.shard(empty).count() == 0


def edited_by_hand(sizes, before, shards):
    """The edit of a slot map in plain Python: what stays, then what moves to the least filled shard."""
    total, load, after, wait = sum(sizes.values()), [0] * shards, {}, []
    for v in sorted(sizes, key=lambda v: (-sizes[v], v)):
        if before[v] < shards and (load[before[v]] + sizes[v]) * shards <= total:
            load[before[v]] += sizes[v]
            after[v] = before[v]
        else:
            wait.append(v)
    for v in wait:
        least = load.index(min(load))
        load[least] += sizes[v]
        after[v] = least
    return after


def test_slot_maps_are_edited_and_kept(spark, tmp_path):
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 31 as int))").alias("text"))
    path = str(tmp_path / "maps")
    first = sharding.shard(many, 4, 256, map_path=path).collect()
    assert sharding.versions(spark, path) == [1, 2] and {r.map_version for r in first} == {2}
    second = sharding.shard(many, 5, 256, map_path=path).collect()  # one more shard
    third = sharding.shard(many, 5, 256, map_path=path).collect()  # nothing to do
    assert sharding.versions(spark, path) == [1, 2, 3, 4]
    maps = {k: {r.vslot: r.shard for r in sharding.load_map(spark, path, k).collect()} for k in (1, 2, 3, 4)}
    size = Counter({v: 0 for v in range(256)})
    for r in first:
        size[r.vslot] += r["size"]
    assert maps[1] == {v: v % 4 for v in range(256)}
    assert maps[2] == edited_by_hand(size, maps[1], 4) and maps[3] == edited_by_hand(size, maps[2], 5) and maps[4] == maps[3]
    assert {r.doc_id: r.shard for r in third} == {r.doc_id: r.shard for r in second}
    for k, shards in ((2, 4), (3, 5)):
        load = Counter()
        for v, s in maps[k].items():
            load[s] += size[v]
        even, largest = sum(size.values()) / shards, max(size.values())
        assert max(load.values()) - min(load.values()) <= 2 * largest
        moved = sum(size[v] for v in range(256) if maps[k][v] != maps[k - 1][v])
        over = [sum(size[v] for v in range(256) if maps[k - 1][v] == s) - even for s in range(shards)]
        assert moved <= sum(o for o in over if o > 0) + shards * largest  # what is over an even share, and a slot for each shard


@pytest.mark.parametrize("hot", [None, 77])
def test_sharding_holds_the_law_when_a_third_of_the_rows_share_an_id(spark, hot):
    rows = [(i if i % 3 else hot, "y" * (i % 50)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).repartition(3)
    load, slots = Counter(), {}
    for r in sharding.shard(df, 8).collect():
        load[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert sum(load.values()) == sum(len(t) + 1 for _, t in rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 8


# 5: suffix dedup


def cut_by_hand(rows):
    """Expected (doc_id, n_bytes, n_removed, n_spans, sha) of each row."""
    n = 50
    first = {}
    key = lambda i: float("-inf") if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            g = b[p : p + n]
            first[g] = min(first.get(g, float("inf")), key(i))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < key(i):
                gone[p : p + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def cut_by_spark(df):
    rows = suffix_dedup.deduplicated(df).collect()
    return Counter((r.doc_id, r.cut.n_bytes, r.cut.n_removed, len(r.cut.spans), r.cut.kept_sha256) for r in rows)


def test_suffix_dedup_small(docs, empty):
    assert cut_by_spark(docs) == cut_by_hand(TEXTS)
    assert suffix_dedup.deduplicated(empty).count() == 0
    row = suffix_dedup.deduplicated(docs).filter("doc_id = 2").first()
    assert row.text == "" and row.source == "src" and row.cut.spans[0].asDict() == {"start": 0, "stop": len(BASE)}


def test_suffix_dedup_clashing_names_and_repeated_rows(spark):
    names = ["nf_n_bytes", "nf_null", "nf_g", "g", "id", "rest", "missing", "bucket", "n_bytes", "spans", "kept"]
    rows = [*TEXTS, (2, BASE), (3, BASE + " one more word")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select(*[F.concat_ws("-", F.lit(n), "doc_id").alias(n) for n in names], "doc_id", "text")
    found = suffix_dedup.deduplicated(df)
    assert found.columns == [*df.columns, "cut"] and cut_by_spark(df) == cut_by_hand(rows)
    assert all(r[n] == "-".join([n, *([str(r.doc_id)] if r.doc_id is not None else [])]) for r in found.collect() for n in names)
    again = suffix_dedup.deduplicated(found.filter("doc_id = 6"), out="cut").first()  # a column named as the result is replaced
    assert again.text == "short" and again.cut.n_removed == 0


def test_suffix_dedup_random(spark):
    r = random.Random(5)
    shared = [prose(100 + k, 30) for k in range(6)] + ["ab" * 80, "a" * 200]
    rows = []
    for i in range(150):
        parts = [prose(1000 + i, r.randint(0, 12))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, len(s) // 2)
            parts += [s[a : a + r.randint(30, 200)], prose(2000 + 7 * i, r.randint(0, 3))]
        rows.append((i, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert cut_by_spark(df) == cut_by_hand(rows)


# 6: line dedup


def by_hand_in_steps(rows, groups, buckets):
    """The four steps without Spark: result rows, and the rows of each bucket of step 3."""
    tables = []
    for g in range(groups):
        own = [r for r in rows if r[0] % groups == g]
        ids = pa.array([i for i, _ in own], pa.int64())
        missing = pa.array([False] * len(own))
        tables.append(pa.table({"id": ids, "text": pa.array([t.encode() for _, t in own], pa.binary()), "missing": missing, "rest": pa.StructArray.from_arrays([ids], ["doc_id"])}))

    def dealt(parts, key):
        whole = pa.concat_tables(parts)
        for k in sorted(set(whole[key].to_pylist())):
            yield k, whole.filter(pc.equal(whole[key], k))

    classes = [suffix_dedup._send_classes(t, buckets, g) for g, t in enumerate(tables)]
    first = dict(dealt([suffix_dedup._judge_classes(t) for _, t in dealt(classes, "bucket")], "g"))
    contexts = list(dealt([suffix_dedup._send_contexts(t, first[g], buckets, g) for g, t in enumerate(tables)], "bucket"))
    judged = [suffix_dedup._judge_windows(t) if b >= buckets else suffix_dedup._judge_contexts(t) for b, t in contexts]
    both = dict(dealt([*first.values(), *judged], "g"))
    out = Counter()
    for g, t in enumerate(tables):
        for r in suffix_dedup._cut(t, both[g], buckets)["cut"].to_pylist():
            out[r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]] += 1
    sent = [sum(t["n"].to_pylist()) for _, t in dealt(classes, "bucket")]
    return out, sent, {b: sum(t["n"].to_pylist()) for b, t in contexts}


def edges_and_phrases(n):
    """Texts that share a passage, or only a phrase, each with other surroundings."""
    passage, phrase = prose(77, 25), "in the event of any such doubt"
    return [(i, prose(5000 + i, 9) + (passage if i % 3 == 0 else phrase) + prose(9000 + i % 40, 9)) for i in range(n)]


def test_suffix_dedup_hot_anchors_are_split():
    rows = edges_and_phrases(700)
    want = Counter()
    for (_, *shown), n in cut_by_hand(rows).items():
        want[tuple(shown)] += n
    got, sent, contexts = by_hand_in_steps(rows, 2, 256)
    assert got == want
    assert max(sent) < 200 and max(contexts.values()) < 200  # 245 and 236 where all of an anchor's classes meet in one bucket


@pytest.mark.parametrize(("here", "most"), [(1, 1), (2, 3), (3, 1000), (1000, 3)])
def test_suffix_dedup_hot_anchors_give_the_same(monkeypatch, here, most):
    monkeypatch.setattr(suffix_dedup, "HOT_HERE", here)
    monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", most)
    rows = edges_and_phrases(120) + [(500 + k, "ab" * 60 + "c" * k) for k in range(5)] + [(600, ""), (601, "a" * 200), (602, "a" * 230)]
    want = Counter()
    for (_, *shown), n in cut_by_hand(rows).items():
        want[tuple(shown)] += n
    for buckets in (1, 16):
        assert by_hand_in_steps(rows, 3, buckets)[0] == want


def test_suffix_dedup_hot_anchors_in_spark(spark):
    rows = edges_and_phrases(600)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert cut_by_spark(df) == cut_by_hand(rows)


def lines_by_hand(rows, ratio):
    """Texts without their boilerplate, by (host, text) rows in order."""
    pages, counts = Counter(), Counter()
    for h, t in rows:
        pages[h or ""] += 1
        counts.update({(h or "", x) for x in (t or "").split("\n") if x.strip(" ")} if t is not None else ())
    hot = {k for k, n in counts.items() if n > 1 and n > ratio * pages[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h or "", x) not in hot) for h, t in rows]


def test_line_dedup(spark, docs, empty):
    rows = [(i, f"menu\nbody {i}\n\n", "h" if i < 40 else "g", "kept") for i in range(50)]
    rows += [(100, None, "h", "kept"), (101, "menu\nmenu", "h", "kept"), (102, "menu", None, "kept"), (103, "", "h", "kept")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, nf_n string")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df, counters=True).collect()}
    assert len(got) == len(rows) and got[3].text == "body 3\n\n" and got[3].n_dropped == 1 and got[3].nf_n == "kept"
    assert [got[i].text for i, *_ in rows] == lines_by_hand([(h, t) for _, t, h, _ in rows], line_dedup.RATIO)
    assert got[100].text is None and got[101].text == "" and got[102].text == "menu" and got[103].text == ""  # one page repeats nothing
    wide = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(df, min_pages=20).collect()}
    assert wide[45] == "menu\nbody 45\n\n" and wide[3] == "body 3\n\n"
    assert line_dedup.drop_boilerplate(docs).count() == len(TEXTS) and line_dedup.drop_boilerplate(empty).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_line_dedup_clashing_names_and_large_hosts(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
        monkeypatch.setattr(line_dedup, "small", lambda *_: False)
    r = random.Random(2)
    rows = [(i, "\n".join(r.choice("abcdefghijkl") * 3 for _ in range(r.randint(0, 4))), r.choice("xyyyz")) for i in range(120)]
    names = ["nf_host", "nf_lines", "nf_every", "host", "lines", "line", "every", "kept", "row", "pages", "n", "salt", "Host"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    own = df.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names if n != "Host"])
    got = {x.doc_id: x for x in line_dedup.drop_boilerplate(own, ratio=0.3).collect()}
    assert [got[i].text for i, *_ in rows] == lines_by_hand([(h, t) for _, t, h in rows], 0.3)
    assert all(got[i][n] == f"{n}{i}" for i, *_ in rows for n in names if n != "Host")


# 7: packing


def test_best_fit_runs_equal_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(80):
        capacity = r.choice((10, 64, 4096))
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 120))]
        lengths += [r.choice(lengths)] * 30 if lengths else []
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [k for k, room in enumerate(rooms) if room >= n]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= n
            else:
                rooms.append(capacity - n)
        runs, opened = packing.best_fit_runs(Counter(lengths).items(), capacity)
        assert opened == len(rooms)
        assert sum(b - a for _, a, b, *_ in runs) == len(lengths)


def test_packing_rows(docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path())
    rows = packing.packed(docs.withColumn("sequence_id", F.lit(7))).collect()
    want = Counter()
    for i, t in TEXTS:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            own = ids[k : k + 4096]
            want[i, k // 4096, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) == packing.best_fit_runs(Counter(r.length for r in rows).items())[1]
    assert packing.packed(empty).count() == 0


@pytest.mark.parametrize("text", ["a\xa0b<|endoftext|>c d", "é́ éx ΑΣ İx", "It's we'll  x　y\x0bz", "½ ² Ⅻ 12 𝒳 中文字", "don'T I'LL 'S, A.B"])
def test_word_ids_equal_the_tokenizers(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path())
    own = np.frombuffer(packing.encoder(packing.vocabulary_path()).ids(text), "<u4").tolist()
    assert own == whole.encode(text, add_special_tokens=False).ids


# 8: main text

PAGE = """<!doctype html><html><head><title>T &amp; U</title><style>p{}</style></head><body><header><a href=/>Home of the site</a></header>
<nav><ul><li><a href=/a>one<li><a href=/b>two</ul></nav><div class="cookie-notice">We use cookies and the like to be of use</div>
<article><h1>The title</h1><p>First &amp; the <b>bold</b>er text of it.<p>Second, with a <a href=x>link</a> in it and more to be read here.
<div class="ad">Buy this now and that</div><form><label>Mail</label><input></form><script>var x = "</p>";</script><p>Short.</article>
<div id="comments"><p>I like the text of this and that a lot, and more of the same is to be said about it by me and by all of us here.</div>
<aside>Also read this of the site</aside><footer>&copy; all of it</footer></body></html>"""


def test_main_text():
    f = html_main.main_text
    assert f(PAGE) == "The title First & the bolder text of it. Second, with a link in it and more to be read here. Short."
    assert f(None) == f("") == ""
    long_ = "the text of it and more to be read by all of us in the end " * 4
    assert f(f"<div><p>{long_}</p><p>Short one</p><p>{long_}</p><p><a href=x>{'menu ' * 9}</a></p></div>") == " ".join(f"{long_} Short one {long_}".split())
    assert f("<article><p>The cut off page of it all &am") == "The cut off page of it all &am"


def test_main_text_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, "")], "page_id long, url string, html string")
    rows = {r.page_id: r.text for r in html_main.extracted(pages).collect()}
    assert rows[1].startswith("The title First") and rows[2] == rows[3] == ""
    assert html_main.extracted(pages.limit(0)).count() == 0


def main_text_by_hand(parts, inside):
    """Parts (text, links share, container is bad) labelled straight from the rules, each open one by a search both ways."""
    shown = [p for p in parts if not (inside and p[2])]
    stop = [sum(w in html_main.STOP_WORDS for w in re.findall("[a-z]+", t.lower())) / max(1, len(re.findall("[a-z]+", t))) for t, *_ in shown]
    known, labels = any(s >= 0.05 for s in stop), []
    for (t, links, bad), s in zip(shown, stop, strict=True):
        if bad:
            labels.append(False)
        elif links:
            labels.append(None if inside and len(t) < 70 else False)
        elif len(t) < 70:
            labels.append(True if inside and s >= 0.2 else None)
        elif (s >= 0.2 or not known) and (inside or len(t) >= 140):
            labels.append(True)
        elif s >= 0.05 or not known:
            labels.append(True if inside else None)
        else:
            labels.append(None if inside else False)
    out = []
    for i, (t, *_) in enumerate(shown):
        label = labels[i]
        if label is None:
            near = [next((x for x in side if x is not None), None) for side in (labels[:i][::-1], labels[i + 1 :])]
            near = [x for x in near if x is not None]
            label = (any(near) or not near) if inside else bool(near) and all(near)
        if label:
            out.append(t)
    return " ".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_main_text_equals_brute_force(seed):
    r = random.Random(seed)
    dense = lambda n: " ".join(r.choice(["the", "of", "and", "with", "was", "stone", "river", "green"]) for _ in range(n))
    bare = lambda n: " ".join(r.choice(["stone", "river", "green", "walks", "table"]) for _ in range(n))
    kinds = [(dense, 40, 0, 0), (dense, 18, 0, 0), (dense, 3, 0, 0), (bare, 3, 0, 0), (bare, 30, 0, 0), (bare, 6, 1, 0), (dense, 25, 1, 0), (dense, 40, 0, 1), (bare, 2, 0, 1)]
    inside, parts, html = r.random() < 0.5, [], []
    for _ in range(r.randint(1, 14)):
        words, n, links, bad = r.choice(kinds)
        text = words(r.randint(max(1, n - 2), n + 2))
        parts.append((text, links, bad))
        shown = f"<a href='/x?a=1&b=\">\"'>{text}</a>" if links else text
        html.append(r.choice([f'<div class="ad">{shown}</div>', f"<aside><p>{shown}</aside>", f"<nav>{shown}</nav>"]) if bad else r.choice([f"<p>{shown}", f"<p>{shown}</p>", f"<div class={'share-content' if inside else 'x'}>{shown}</div>"]))
    if inside and all(b for *_, b in parts):
        inside = False
    page = "".join(html)
    got = html_main.main_text(f"<html><body>{'<article>' if inside else ''}{page}")
    want = main_text_by_hand(parts, inside) or (main_text_by_hand(parts, False) if inside else "")
    assert got == want


def test_main_text_long_attributes_names_and_pages(spark):
    f = html_main.main_text
    body = "the story of it all and more of that with some of the rest to be read by us"
    assert f(f"<article><div data-x=\"{'y' * 9000}>LEAK\">{body}</div></article>") == body
    assert f(f"<article><p title='{'y' * 5000}>LEAK{body}</article>").endswith(body)  # no closing quote: the first > ends the tag
    assert f(f'<article><div class="content share"><p>{body}</p></div></article>') == body
    assert f(f'<article><div class="share">{body}</div><p>{body} too</p></article>') == f"{body} too"
    assert f(f'<article><div class="comment content"><p>{body}</p></div><p>{body} too</p></article>') == f"{body} too"
    assert f("<article><p>1 < 2 & 3 <b>x</b> of the and</article>") == "1 < 2 & 3 x of the and"
    long_page = "<article>" + f"<p>{body}</p>" * 30_000 + "</article>"
    assert f(long_page) == " ".join([body] * 30_000)
    assert len(f("<a \"" * 20_000)) < 100_000 and len(f("<a href='" * 20_000)) < 200_000
    pages = spark.createDataFrame([(1, "u", PAGE, "own")] * 2, "page_id long, url string, html string, row string").withColumn("text", F.lit("old")).withColumn("found", F.lit(1))
    rows = html_main.extracted(pages, rules="rules").collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].row == "own" and rows[0].found == 1 and rows[0].text.startswith("The title")
    assert rows[0].rules.container > 0 and rows[0].rules.neighbours > 0


# 9: near copies


def classes_by_hand(rows):
    """Brute force over all pairs of distinct texts."""
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(t or "", []).append(i)
    bags = {}
    for t in {t or "" for _, t in rows}:
        w = t.lower().split()
        bags[t] = Counter(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    df = Counter(s for b in bags.values() for s in b)
    code = {s: 0 if n == 1 else min(255, round(8 * np.log2(n))) for s, n in df.items()}
    weight = {t: {s: n * (1 + near_dedup.IDF_WEIGHT * min(1, max(0, 1 - code[s] * np.log(2) / 8 / np.log(len(bags))))) for s, n in b.items()} for t, b in bags.items()}
    root = {t: t for t in bags}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    every = list(bags)
    for k, a in enumerate(every):
        for b in every[:k]:
            x, y = weight[a], weight[b]
            common = sum(min(x[s], y[s]) for s in x if s in y)
            if x and common >= near_dedup.SIMILARITY * (sum(x.values()) + sum(y.values()) - common) - 1e-9:
                root[find(a)] = find(b)
    least = {}
    for t, ids in texts.items():
        least[find(t)] = min([least.get(find(t), 1 << 60), *ids])
    return Counter((i, None if i is None else least[find(t or "")]) for i, t in rows)


def edited(text: str, seed: int, n: int) -> str:
    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randint(0, 10**6)}"
    return " ".join(w)


def test_near_dedup(spark, docs, empty):
    rows = list(TEXTS)
    for g in range(6):
        base = prose(500 + g, 150)
        rows += [(1000 + 100 * g + k, edited(base, 31 * g + k, k % 5)) for k in range(12)]
    rows += [(5000 + k, prose(900 + k, 60)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("x")).repartition(5)
    got = Counter((r.doc_id, r.class_id) for r in near_dedup.classes(df).collect())
    assert got == classes_by_hand(rows)
    kept = near_dedup.drop_near_copies(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 4, 6, 7, 8, 9, 11] and any(r.doc_id is None for r in kept)
    assert near_dedup.classes(empty).count() == 0 and near_dedup.drop_near_copies(empty).count() == 0


@pytest.mark.parametrize("guides", [1, 3])
def test_near_dedup_large_groups_in_parts(spark, monkeypatch, guides):
    monkeypatch.setattr(near_dedup, "MEMBERS", 8)
    monkeypatch.setattr(near_dedup, "GUIDES", guides)
    base = prose(77, 200)
    rows = [(k, edited(base, k, 2)) for k in range(40)]
    # a chain from text to text: its ends share a bucket with the middle, but are no copies of each other
    for k in range(12):
        rows.append((100 + k, edited(rows[-1][1], 500 + k, 4)))
    rows += [(300 + k, edited(prose(78, 200), k, 1 + 9 * (k % 3))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id) for r in near_dedup.classes(df).collect()) == classes_by_hand(rows)


def test_near_dedup_hot_keys_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    base = prose(70, 120)
    rows = [(k, base) for k in range(60)] + [(100 + k, edited(base, k, 2)) for k in range(30)] + [(200 + k, prose(600 + k, 30)) for k in range(50)] + [(None, base)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.classes(df).collect()
    assert Counter((r.doc_id, r.class_id) for r in found) == classes_by_hand(rows)
    sizes = Counter(r.class_id for r in found if r.doc_id is not None)
    assert all(r.class_size == sizes[r.class_id] + 3 * (r.class_id == 0) for r in found if r.doc_id is not None)


def test_drop_near_copies_clashing_names(spark):
    rows = [(1, BASE), (2, BASE), (3, prose(9, 40)), (None, "x y")]
    names = ["nf_id", "nf_own", "nf_at", "nf_text_key", "id", "text_key", "row", "key", "class_id"]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.concat_ws("-", F.lit(n), "doc_id").alias(n) for n in names])
    kept = near_dedup.drop_near_copies(df).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 3] and kept[0].asDict().keys() == {"doc_id", "text", *names}
    assert all(r[n] == "-".join([n, *([str(r.doc_id)] if r.doc_id else [])]) for r in kept for n in names)


# 10: toxicity


def labelled(n: int):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        t = prose(i, 30) + (" you utter blockhead " if toxic else " ") + prose(i + 9999, 10)
        rows.append((i, t))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def test_toxicity(spark, docs, empty):
    rows, labels = labelled(400)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old"))
    known = spark.createDataFrame(labels + [(3, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, known)
    got = {r.doc_id: r for r in toxicity.scored(df, model).withColumn("out", toxicity.held_out()).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.out} == set(held)
    right = sum((got[i].score >= 0.7) == (i % 4 == 0) for i in held) / len(held)
    assert right >= 0.95 and all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in toxicity.drop_toxic(df, known).collect()}
    assert len(kept & {i for i in held if i % 4 == 0}) <= 2 and len([i for i in range(400) if i % 4 and i not in kept]) <= 8
    assert toxicity.scored(docs, model).count() == len(TEXTS)
    flat = toxicity.fit(empty, known.limit(0))
    assert {round(r.score, 6) for r in toxicity.scored(docs, flat).collect()} == {0.5}


def test_toxicity_bias_has_the_shares_of_all_labels(spark):
    rows, labels = labelled(600)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    learnt = known.filter(~toxicity.held_out())
    odds = learnt.filter("toxic = 1").count() / learnt.filter("toxic = 0").count()
    even = toxicity.fit(df, known, sample=20)
    hashed = [r.doc_id for r in learnt.withColumn("k", F.xxhash64("doc_id")).orderBy("k").collect()]
    by_id, toxic = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in labels}
    chosen = [i for t in (0, 1) for i in [d for d in hashed if toxic[d] == t][:20]]
    chosen.sort(key=hashed.index)
    plain = toxicity.train([by_id[i] for i in chosen], np.array([toxic[i] for i in chosen]))
    assert odds < 0.5 and even.bias == pytest.approx(plain.bias + np.log(odds), abs=1e-6)  # 20 of each: even odds in the sample


def test_ann_repeated_rows_and_ids(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((60, 4))
    rows = [(i, x.tolist(), "a") for i, x in enumerate(v)] + [(0, v[0].tolist(), "b")] * 3 + [(7, v[7].tolist(), "c")] * 4
    rows += [(9, (5 * v[0]).tolist(), "d"), (20, (-v[20]).tolist(), "e")]  # ids with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert sorted(got) == [0, 20, 40]
    for q, found in got.items():
        own = min(x for i, x, _ in rows if i == q)
        best = {}
        for i, x, _ in rows:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float(np.dot(own, x)))
        assert [i for i, _ in found] == sorted(best, key=lambda i: (-best[i], i))[:20]
        assert len({i for i, _ in found}) == 20 and np.allclose([s for _, s in found], [best[i] for i, _ in found])


def test_ann_windows_only_expand():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((900, 8))
    block = ann.Block(np.arange(900), v, 5)
    projected = (v[0] / np.sqrt(v[0] @ v[0])) @ block.directions[:8]
    low, high = block._ends(projected, block.radius)
    counts = block._first(low, high)
    wider, higher = block._ends(projected, block.radius * 1.5)
    counts = counts + block._passed(np.concatenate((wider, high)), np.concatenate((low, higher)))
    assert (counts == block._first(wider, higher)).all() and (wider <= low).all() and (high <= higher).all()
