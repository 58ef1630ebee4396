import datetime
import math
import random
import re
import struct
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import xxhash
from helpers import CLASHING, documents, empty, squeezed, text
from tokenizers import Tokenizer

from tallyfold.llm import chat_format, importance, url_filter
from tallyfold.llm.jaccard_join import jaccard_components
from tallyfold.llm.secret_scan import MARK

LABELS = "doc_id long, quality int, toxic int"


def labelled(spark):
    rng = random.Random(4)
    texts, labels = {}, []
    for i in range(200):
        junk = i % 5 == 0
        texts[i] = " ".join(f"{w}{rng.choice(['%%%', '###'])}" for w in text(rng, 60).split()) if junk else text(rng, 60)
        if i % 2 == 0:
            labels.append((i, 0 if junk else 1, 0))
    return texts, spark.createDataFrame(labels + [(9999, 1, 0), (3, None, None), (None, 1, 0)], LABELS)


def test_classifier_keeps_good_and_drops_junk(spark):
    texts, labels = labelled(spark)
    rows = importance.classify(documents(spark, texts), labels).collect()
    kept = {r.doc_id for r in rows if r.kept}
    junk = {i for i in texts if i % 5 == 0}
    assert len(rows) == len(texts)
    assert len(kept & junk) <= 2 and len(kept - junk) >= 155


def classify_by_hand(texts, good, share):
    """Log weights, keys and the draw, restated with plain integers and dictionaries."""
    top = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ x >> 27) * 0x94D049BB133111EB & top
        return x ^ x >> 31

    def grams(t):
        words = [xxhash.xxh64_intdigest(w) for w in (t or "").encode().lower().split()]
        return [mix(w) % 10_000 for w in words] + [mix((a * 0x9E3779B97F4A7C15 + b) & top) % 10_000 for a, b in zip(words, words[1:])]

    counts = {i: Counter(grams(t)) for i, t in texts.items()}
    raw, target = sum(counts.values(), Counter()), sum((counts[i] for i in good), Counter())
    n_raw, n_target = sum(raw.values()) + 10_000, sum(target.values()) + 10_000
    ratio = lambda g: math.log((target[g] + 1) / n_target) - math.log((raw[g] + 1) / n_raw)
    weight = {i: sum(n * ratio(g) for g, n in c.items()) for i, c in counts.items()}

    def key(i):
        bits = xxhash.xxh64_intdigest(struct.pack("<i", 20), xxhash.xxh64_intdigest(struct.pack("<q", i), 42)) >> 11
        return weight[i] - math.log(-math.log((bits + 0.5) / (1 << 53)))

    keys = {i: key(i) for i in texts}
    least = sorted(keys.values(), reverse=True)[round(share * len(texts)) - 1]
    return weight, keys, {i for i in texts if keys[i] >= least}


def test_classifier_matches_a_plain_restatement(spark):
    texts, labels = labelled(spark)
    texts |= {500: None, 501: "", 502: "One word"}
    known = [(r.doc_id, r.quality, r.toxic) for r in labels.collect() if r.doc_id in texts and r.quality is not None]
    share = sum(q for _, q, _ in known) / len(known)
    weight, keys, kept = classify_by_hand(texts, {i for i, q, t in known if q == 1 and t == 0}, share)
    rows = importance.classify(documents(spark, texts), labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert abs(r.log_weight - weight[r.doc_id]) < 1e-6 and abs(r.key - keys[r.doc_id]) < 1e-6
    assert {r.doc_id for r in rows if r.kept} == kept


def test_pipeline_matches_a_plain_restatement(spark, tmp_path):
    """The run's documents, by brute force: the draw, exact copies, components of 5-word shingles."""
    texts, labels = labelled(spark)
    good = [t for i, t in texts.items() if i % 5]
    texts |= {300: good[0], 301: good[1] + " w1", 302: good[2] + " password: hunter2222", 303: good[0] + " \n", 304: None, 305: ""}
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    known = [(r.doc_id, r.quality, r.toxic) for r in labels.collect() if r.doc_id in texts and r.quality is not None]
    _, _, kept = classify_by_hand(texts, {i for i, q, t in known if q == 1 and t == 0}, sum(q for _, q, _ in known) / len(known))
    groups = {}
    for i in sorted(kept):
        groups.setdefault(squeezed(texts[i]), []).append(i)
    kept = {min(g, key=lambda i: (-len(texts[i] or ""), i)) for g in groups.values()}

    def shingles(t):
        words = (t or "").lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets, parent = {i: shingles(texts[i]) for i in kept}, {i: i for i in kept}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    kept = {i for i in kept if find(i) == i}
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i in kept:
        masked = re.sub(r"password: hunter2222", MARK, texts[i] or "")
        ids = np.array([*tokens.encode(masked, add_special_tokens=False).ids, 1], "<u4")
        want[i] = (len(ids), zlib.crc32(ids.tobytes()))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)


def test_classifier_on_odd_inputs(spark):
    _, labels = labelled(spark)
    assert importance.classify(empty(spark), labels).collect() == []
    rows = importance.classify(documents(spark, [(1, None), (2, ""), (2, ""), (None, "a b")]), labels.limit(0)).collect()
    assert len(rows) == 4 and all(r.kept for r in rows)
    assert all(r.log_weight == 0.0 for r in rows)


def test_exact_kth_largest(spark):
    values = [float(v) for v in random.Random(1).choices(range(50), k=500)] + [1e9, -1e9]
    table = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 17, 250, 502):
        assert importance.kth_largest(table, "x", k) == sorted(values, reverse=True)[k - 1]


def drawn(turns):
    out, mask = "", []
    for role, t in turns:
        head, body = f"<|im_start|>{role}\n", f"{t}<|im_end|>\n"
        if role == "assistant":
            mask.append(f"{len(out) + len(head)}:{len(out) + len(head) + len(body)}")
        out += head + body
    return out, ",".join(mask)


def conversations():
    rng, out = random.Random(2), {}
    for i in range(30):
        opening = ("user", f"question {i % 4}")
        out[i] = [opening] + [("assistant" if k % 2 == 0 else "user", f"turn {rng.randint(0, 2)}") for k in range(rng.randint(0, 4))]
    return out


def test_pairs_and_rendering_match_brute_force(spark):
    convs = conversations()
    rows = [(i, k, r, t) for i, turns in convs.items() for k, (r, t) in enumerate(turns)] + [(None, 0, "user", "x"), (500, 0, None, None), (0, 0, "zzz", "later")]
    table = chat_format.conversations_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for pairs in (chat_format.opening_pairs(table, block=5), chat_format.swapped_pairs(table)):
        given = {(r.chosen_id, r.rejected_id): r for r in pairs.collect()}
        for r in chat_format.preference_format(pairs).collect():
            a, b = ([(t.role, t.text) for t in side] for side in (given[r.chosen_id, r.rejected_id].chosen, given[r.chosen_id, r.rejected_id].rejected))
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert (r.n_shared, r.prompt) == (n, drawn(a[:n])[0])
            assert (r.chosen, r.chosen_mask) == drawn(a[n:])
            assert (r.rejected, r.rejected_mask) == drawn(b[n:])
    groups = {}
    for i in sorted(convs):
        groups.setdefault(convs[i][0], []).append(i)
    want = {frozenset(g[k : k + 2]) for g in groups.values() for k in range(0, len(g) - 1, 2)}
    assert {frozenset((r.chosen_id, r.rejected_id)) for r in chat_format.opening_pairs(table, block=5).collect()} == want
    swapped = {r.chosen_id for r in chat_format.swapped_pairs(table).collect()}
    assert swapped == {i for i, turns in convs.items() if any(r == "assistant" for r, _ in turns)}
    assert chat_format.preference_format(chat_format.swapped_pairs(table.limit(0))).collect() == []


def test_urls_are_judged_as_of_their_fetch(spark, monkeypatch):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    entries = [("bad.com", 10, True), ("bad.com", 20, False), ("ok.bad.com", 5, True), ("ok.bad.com", 12, False), ("worse.org", 3, True), ("worse.org", 3, False), (None, 1, True), ("x.net", None, True)]
    listed = spark.createDataFrame([(h, None if d is None else day(d), a) for h, d, a in entries], "host string, listed_at date, active boolean")
    urls = ["http://bad.com/a", "https://u:p@Sub.OK.bad.com:80/x?y", "http://worse.org./", "ftp://fine.net#a", "nonsense", None, "http://x.net"]
    captures = spark.createDataFrame([(i * 100 + d, u, day(d)) for i, u in enumerate(urls) for d in (0, 3, 10, 11, 15, 25)] + [(9999, urls[0], None)], "page_id long, url string, fetched_at date")

    def by_hand(names, d):
        for name in names:
            seen = [(when, flag) for h, when, flag in entries if h == name and when is not None and when <= d]
            if seen:
                last = max(w for w, _ in seen)
                return name, any(f for w, f in seen if w == last)
        return None, False

    names = [["bad.com"], ["sub.ok.bad.com", "ok.bad.com", "bad.com"], ["worse.org"], [], [], [], []]
    for limit in (100_000, 1):
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", limit)
        got = url_filter.filter_urls(captures, listed).collect()
        assert len(got) == len(urls) * 6 + 1
        for r in got:
            if r.page_id != 9999:
                assert (r.matched, r.blocked) == by_hand(names[r.page_id // 100], r.page_id % 100)
            else:
                assert not r.blocked


def test_hosts_of_very_many_labels_are_looked_up(spark):
    host = "x." * 200 + "example.com"
    captures = spark.createDataFrame([(1, f"https://{host}/a", 5)], "page_id long, url string, fetched_at long")
    for name in ("example.com", "x.example.com", host):
        listed = spark.createDataFrame([(name, 1, True), ("other.org", 1, True)], "host string, listed_at long, active boolean")
        assert [(r.matched, r.blocked) for r in url_filter.filter_urls(captures, listed).collect()] == [(name, True)]


def test_pipeline_stages_follow_each_other(spark, tmp_path):
    texts, labels = labelled(spark)
    good = [t for i, t in texts.items() if i % 5]
    texts |= {300: good[0], 301: good[1] + " w1", 302: good[2] + " password: hunter2222"}
    documents(spark, texts).drop(*CLASHING).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "jaccard_join", "secret_scan", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "best_fit_packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
            break
        assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name == "jaccard_join":
            assert {r.doc_id for r in docs.collect()} == {r.component_id for r in jaccard_components(before).collect()}
        if name == "secret_scan":
            assert docs.count() == before.count()
            assert all("hunter2222" not in (r.text or "") for r in docs.collect())
            assert docs.where(docs.text.contains(MARK)).count() <= 2
    assert 300 not in {r.doc_id for r in docs.collect()} and corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_clashing_columns_and_a_very_long_conversation(spark):
    extra = ", ".join(f"{c} string" for c in CLASHING if c not in ("key",))
    more = tuple(c for c in CLASHING if c not in ("key",))
    turns = [(1, k, "assistant" if k % 2 else "user", f"turn {k} " * 20) for k in range(3000)] + [(0, 0, "user", "q"), (0, 1, "assistant", None)]
    table = spark.createDataFrame([(*t, *more) for t in turns], f"conv_id long, turn long, role string, text string, {extra}")
    got = {r.chosen_id: r for r in chat_format.preference_format(chat_format.swapped_pairs(chat_format.conversations_of(table))).collect()}
    whole = [(r, t) for _, _, r, t in turns[:2999]]
    assert got[1].n_shared == 2999 and got[1].prompt == drawn(whole)[0]
    assert (got[1].chosen, got[1].chosen_mask) == drawn([turns[2999][2:]]) and (got[0].chosen, got[0].chosen_mask) == drawn([("assistant", "")])
    captures = spark.createDataFrame([(1, "http://a.bad.com/x", 5, *more), (1, "http://a.bad.com/x", 5, *more)], f"page_id long, url string, fetched_at long, {extra}")
    listed = spark.createDataFrame([("bad.com", 1, True, *more)], f"host string, listed_at long, active boolean, {extra}")
    assert [(r.page_id, r.matched, r.blocked) for r in url_filter.filter_urls(captures, listed).collect()] == [(1, "bad.com", True)] * 2


def test_a_null_id_does_not_blur_the_others(spark):
    large = (1 << 53) + 1
    docs = spark.createDataFrame([(None, "a b c"), (large, "good words here"), (large - 1, "bad noise there")], "doc_id long, text string").coalesce(1)
    ratios = importance.log_ratios(docs, np.array([large]))
    words = lambda t: importance.ngram_buckets(np.array([xxhash.xxh64_intdigest(w) for w in t.encode().split()], np.uint64))
    assert ratios[words("good words here")].min() > ratios[words("bad noise there")].max()


def test_toxic_documents_are_not_drawn(spark):
    rng, insults = random.Random(21), ["blockhead", "nitwit", "dolt"]
    texts, labels, toxic = {}, [], set()
    for i in range(400):
        words = text(rng, rng.choice([5, 60, 900])).split()
        if i % 8 == 0:
            toxic.add(i)
            for w in rng.sample(insults, 2):
                words.insert(rng.randrange(len(words)), f'({w.upper()}!)' if i % 3 == 0 else w)
        texts[i] = " ".join(words)
        if i % 2 == 0:
            labels.append((i, 1, int(i in toxic)))
    known = spark.createDataFrame(labels, LABELS)
    rows = importance.classify(documents(spark, texts), known).collect()
    assert {r.doc_id for r in rows if r.toxic} == toxic
    # all labels are of quality 1, so all documents are drawn, and toxic ones are rejected
    assert all(r.kept == (not r.toxic) for r in rows)
    markers = importance.marker_words(documents(spark, texts), np.array([i for i, _, t in labels if not t]), np.array(sorted(toxic)))
    assert set(markers) == {w.encode() for w in insults} and min(markers.values()) > 3
    kept = {r.doc_id for r in importance.keep_good(documents(spark, texts), known).collect()}
    assert kept == {r.doc_id for r in rows if r.kept}
