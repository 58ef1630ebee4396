import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import CLASHING, WORDS, documents, empty, odd_texts, text

from tallyfold.llm import jaccard_join, multi_index, suffix_array, suffix_dedup


def jaccard_by_hand(texts):
    sets = {}
    for i, t in texts.items():
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    where, parent = collections.defaultdict(list), {i: i for i in texts}
    for i, s in sets.items():
        for x in s:
            where[x].append(i)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in texts}


def near_copies():
    rng, out, k = random.Random(3), odd_texts(), 1000
    for _ in range(25):
        base = text(rng, rng.randint(3, 120)).split()
        for _ in range(rng.choice([1, 2, 3, 12, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out[k], k = " ".join(copy), k + 1
    return out


def test_components_match_brute_force(spark):
    texts = near_copies()
    want = jaccard_by_hand(texts)
    got = jaccard_join.jaccard_components(documents(spark, texts)).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_components_of_nothing_and_of_repeated_rows(spark):
    assert jaccard_join.jaccard_components(empty(spark)).collect() == []
    got = jaccard_join.jaccard_components(documents(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]
    docs = documents(spark, near_copies())
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({c for _, c in jaccard_by_hand(near_copies()).values()})


@pytest.mark.parametrize("wide", [1024, 0])
def test_suffix_array_and_prefixes(wide, monkeypatch):
    monkeypatch.setattr(suffix_array, "WIDE", wide)
    rng = random.Random(1)
    for _ in range(150):
        t = np.array([rng.randint(1, rng.choice([1, 2, 3, 20])) for _ in range(rng.randint(1, 60))] + [0])
        listed = t.tolist()
        want = sorted(range(len(listed)), key=lambda i: listed[i:])
        array = suffix_array.suffix_array(t)
        assert array.tolist() == want
        before, shared = suffix_array.common_prefixes(t, array)
        for x, y in zip(want, want[1:]):
            n = next(k for k in range(len(listed)) if x + k >= len(listed) or y + k >= len(listed) or listed[x + k] != listed[y + k])
            assert (before[y], shared[y]) == (x, n)


def removal_by_hand(texts, window=400):
    seen, data = collections.Counter(), {i: (t or "").encode() for i, t in texts.items()}
    for b in data.values():
        seen.update(b[p : p + window] for p in range(len(b) - window + 1))
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def passages():
    rng, out = random.Random(3), {0: None, 1: "", 2: "ab " * 700, 3: "x" * 399, 4: "x" * 400, 5: "é" * 700, 6: "Shti " * 500}
    shared = [text(rng, rng.randint(80, 200)) for _ in range(6)]
    for i in range(60):
        out[10 + i] = text(rng, rng.randint(0, 150)) + " " + " ".join(rng.choice(shared) if rng.random() < 0.5 else text(rng, 20) for _ in range(3))
    for i in range(12):
        out[100 + i] = out[10 + i]
        t = out[30 + i]
        out[120 + i] = t[: len(t) // 2] + "#" + t[len(t) // 2 :]
    hot = text(rng, 150)
    for i in range(30):
        out[200 + i] = text(rng, 40) + hot + text(rng, 40)
    return out


def test_suffix_array_of_repetitive_texts():
    rng = random.Random(6)
    for wide in (40, 3000, 1 << 21) * 15:
        blocks = [[rng.choice((rng.randint(1, wide), rng.randint(1, 9))) for _ in range(rng.randint(1, 40))] for _ in range(4)]
        listed = [x for _ in range(30) for x in rng.choice(blocks)] + [0]
        array = suffix_array.suffix_array(np.array(listed))
        assert array.tolist() == sorted(range(len(listed)), key=lambda i: listed[i:])


def test_ranks_tell_a_substring_from_a_longer_one():
    rng = random.Random(9)
    for size in (4, 1000, 70_000):
        runs = [[rng.randint(1, size - 1) for _ in range(rng.randint(1, 9))] for _ in range(6)]
        subs = [run[: rng.randint(1, len(run))] for run in runs * 20]
        text = np.array([x for r in subs for x in r])
        length = np.array([len(r) for r in subs])
        places = np.cumsum(length) - length
        want = {x: i for i, x in enumerate(sorted({(*r, size) for r in subs}))}
        assert suffix_array._ranks(text, places, places + length - 1, size).tolist() == [want[(*r, size)] for r in subs]


@pytest.mark.parametrize("hot", [1000, 3])
def test_removed_bytes_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = passages()
    want = removal_by_hand(texts)
    got = suffix_dedup.suffix_dedup(documents(spark, texts)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert len(got) == len(texts)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.suffix_dedup(empty(spark)).collect() == []
    got = suffix_dedup.suffix_dedup(documents(spark, [(None, "y" * 900), (3, None)])).collect()
    assert sorted(r.n_removed for r in got) == [0, 900]


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:400] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9050, [0.0] * 16), (9100, [float("nan")] * 16), (9150, [1.0]), (None, [1.0] * 16), (9200, [None] + [1.0] * 15)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = collections.defaultdict(list)
    for r in multi_index.neighbours(table, lambda c: c % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        near = u @ u[q]
        near[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(near, 12)))[:5]
        assert len(got[q]) == 5
        hits += len({v for v, _ in got[q]} & set(best.tolist()))
        for v, s in got[q]:
            assert abs(s - near[v]) < 1e-12
    assert set(got) == set(range(0, 1500, 50))
    assert hits >= 0.9 * 150
    # copies of one vector: the smallest ids
    assert [v for v, _ in got[200]] == [7, 201, 202, 203, 204]


def test_few_or_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert multi_index.neighbours(none, lambda c: c % 50 == 0).collect() == []
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in multi_index.neighbours(two, lambda c: c % 50 == 0).collect()] == [(0, 1)]


def test_share_holds_for_ids_that_follow_clusters(spark):
    rng = np.random.default_rng(1)
    near = rng.normal(size=(60, 32))[rng.integers(0, 60, 9000)] + 0.1 * rng.normal(size=(9000, 32))
    x = np.concatenate([near, rng.normal(size=(9000, 32))])
    assert multi_index.MultiIndex(x).share(x, 5) == multi_index.MultiIndex(x).share(x[rng.permutation(len(x))], 5)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(set)
    for r in multi_index.neighbours(table, lambda c: c % 90 == 0).collect():
        got[r.query_id].add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for q in range(0, len(x), 90):
        cos = u @ u[q]
        cos[q] = -9
        hits.append(len(got[q] & set(np.argsort(-cos)[:5].tolist())) / 5)
    assert np.mean(hits) >= 0.9


def test_a_pair_that_only_its_hashes_say_is_equal_stops_the_run():
    rng = random.Random(8)
    piece = text(rng, 90).encode()
    table = lambda *data: pa.table({"doc_id": list(range(len(data))), "s": [5] * len(data), "kind": pa.array([0] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})
    assert suffix_dedup._shard(table(piece, piece)).to_pylist() == [{"doc_id": i, "s": 5, "e": 5 + len(piece) - 400} for i in (0, 1)]
    with pytest.raises(RuntimeError):
        suffix_dedup._shard(table(piece, text(rng, 90).encode()))


def test_finite_vectors_of_any_length_are_scored(spark):
    rows = [(0, [1e200, 0.0, 1e200, 0.0]), (1, [1.0, 0.0, 1.0, 0.0]), (2, [1e200, 1e200, 0.0, 0.0]), (3, [1e-200, 0.0, 1e-200, 0.0]), (4, [5e-324, 0.0, 0.0, 0.0]), (5, [1.7e308, 1.7e308, 1.7e308, 1.7e308])]
    table = spark.createDataFrame([(*r, *CLASHING) for r in rows], "vec_id long, embedding array<double>, " + ", ".join(f"{c} string" for c in CLASHING))
    got = {(r.query_id, r.vec_id): r.score for r in multi_index.neighbours(table, lambda c: c % 50 == 0).collect()}
    assert got == pytest.approx({(0, 1): 1.0, (0, 3): 1.0, (0, 2): 0.5, (0, 4): 0.5**0.5, (0, 5): 0.5**0.5}, rel=1e-12)


def test_blocks_hold_all_centroids():
    first, count = multi_index.blocks(np.array([3, 0, 25, 4, 5, 2, 9, 31]), 10)
    assert first.tolist() == [0, 0, 1, 4, 4, 5, 6, 7] and count.tolist() == [1, 1, 3, 1, 1, 1, 1, 4]


def test_rows_without_an_id_or_with_one_id_are_judged_apart(spark):
    rng = random.Random(12)
    shared, other = text(rng, 150), text(rng, 150)
    cases = (
        [(None, shared), (None, other), (1, shared), (2, "short")],
        [(5, shared), (5, other), (1, shared), (2, "short")],
        [(None, "x" * 900), (None, "short"), (None, None), (7, "y" * 500), (7, "z")],
        [(3, shared), (3, shared), (3, shared + other), (None, other), (None, text(rng, 200))] + [(None, text(rng, 90) + shared[:450]) for _ in range(9)],
    )
    for rows in cases:
        want = removal_by_hand(dict(enumerate(t for _, t in rows)))
        got = suffix_dedup.suffix_dedup(documents(spark, rows)).collect()
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == sorted(((i, *want[n]) for n, (i, _) in enumerate(rows)), key=key)


def test_a_query_id_asks_once(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)).tolist()
    rows = list(enumerate(x)) + [(50, x[50]), (50, x[50]), (0, x[0]), (100, [-v for v in x[100]]), (7, x[7])]
    got = collections.defaultdict(list)
    for r in multi_index.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), lambda c: c % 50 == 0, aim=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q in range(0, 400, 50):
        ask = np.array(min(v for i, v in rows if i == q))
        cosines = sorted((-float(np.dot(v, ask) / np.linalg.norm(v) / np.linalg.norm(ask)), i) for i, v in rows if i != q)[:5]
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert [i for _, i, _ in got[q]] == [i for _, i in cosines]
        assert [s for _, _, s in got[q]] == pytest.approx([-c for c, _ in cosines])
    unusable = spark.createDataFrame([(i, None) for i in range(300)] + [(0, [1.0, 2.0]), (50, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.vec_id) for r in multi_index.neighbours(unusable, lambda c: c % 50 == 0).collect()} == {(0, 50), (50, 0)}


def test_queries_of_a_block_may_come_in_many_batches(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(300, 8))
    monkeypatch.setattr(multi_index, "PROBES", 500, raising=False)
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
        got = collections.defaultdict(list)
        for r in multi_index.neighbours(table, lambda c: c % 2 == 0, aim=1.0).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T
    np.fill_diagonal(near, -9)
    assert got == {q: np.argsort(-near[q])[:5].tolist() for q in range(0, 300, 2)}


def test_planted_passages_are_gone_from_the_text_and_clean_texts_stay(spark):
    rng = random.Random(21)
    passage = [" ".join(rng.choice(WORDS) + w for w in "abcdefghij" * n) for n in (9, 14)]  # 90 and 140 words
    texts = {i: text(rng, 120) for i in range(40)}
    planted = {i: texts[i] + f" {i} " + passage[i % 2] + f" {i} " + texts[i + 1][::-1] for i in range(0, 20, 3)}
    # the first byte of both last characters is equal, so a cut falls inside them
    cut = {50: "ab" * 210 + "é", 51: "ab" * 210 + "è"}
    texts |= planted | cut | {60: None}
    data = {i: (t or "").encode() for i, t in texts.items()}
    got = {r.doc_id: r for r in suffix_dedup.removed_repeats(documents(spark, texts)).collect()}
    digest = {r.doc_id: r for r in suffix_dedup.suffix_dedup(documents(spark, texts)).collect()}
    assert set(got) == set(digest) == set(texts)
    want = removal_by_hand(texts)
    for i, r in got.items():
        edges = [0, *(x for s in r.spans for x in (s.start, s.stop)), len(data[i])]
        assert r.kept == b"".join(data[i][a:b] for a, b in zip(edges[::2], edges[1::2]))
        assert (r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) == want[i]
        d = digest[i]
        assert (d.n_bytes, d.n_removed, d.n_spans, d.kept_sha256, d.touched) == (*want[i], bool(r.spans))
    assert {i for i, d in digest.items() if d.kept_text != (texts[i] or "")} == set(planted) | set(cut)
    for i in planted:
        assert passage[i % 2] not in digest[i].kept_text and digest[i].kept_text.startswith(texts[i][:200])
    assert [digest[i].kept_text for i in cut] == ["�", "�"]
