"""Operators on training data against brute-force versions, with nulls, empty texts, ties, repeated rows and clashing names."""

import hashlib
import itertools
import random
import re
import time
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tablestory.llm import chat_windows, components, ego_join, latent_search, line_dedup, ngram_join, packing, pii, quality, url_filter, warc
from tablestory.session import checkpoint_dir
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, n bigint, key string"


def documents(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, 7, "x") for i, t in enumerate(texts)], DOCS)


def split_words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]


def prose(rng, n, size=60):
    return [rng.choice(["so", "word", "Été", "stone", "river", "cloud"]) + str(rng.randint(0, size)) for _ in range(n)]


@pytest.mark.parametrize("list_rows", [1 << 20, 3])
def test_ngram_components_match_all_pairs(spark, list_rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST_ROWS", list_rows)
    rng = random.Random(4)
    base = prose(rng, 80)
    texts = [None, "", " \t", "one two", "ONE  two", "one"]
    for k in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = f"new{k}x{rng.randint(0, 3)}"
        texts += [" ".join(copy), " ".join(copy).upper()]
    texts += [" ".join(prose(rng, 60)) for _ in range(20)]
    got = {r.doc_id: r for r in ngram_join.ngram_components(documents(spark, texts), size=3, percent=90).collect()}
    sets = []
    for t in texts:
        w = split_words(t)
        sets.append({tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                label[i] = label[j] = min(label[i], label[j])
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == [(len(s), x) for s, x in zip(sets, label)]


def test_ngram_components_of_odd_tables(spark):
    assert ngram_join.ngram_components(documents(spark, [])).count() == 0
    rows = [(1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (None, "a b c d"), (3, "a b c d"), (3, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = sorted(map(tuple, ngram_join.ngram_components(docs).collect()), key=repr)
    assert out == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (3, 2, 1), (3, 2, 1)], key=repr)


def test_components_by_rounds_and_at_once(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(None, 3), (5, 5)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    label = {}
    for x, y in links:
        if x is not None and x != y:
            label.setdefault(x, x), label.setdefault(y, y)
    for _ in label:
        for x, y in links:
            if x in label and y in label and x != y:
                label[x] = label[y] = min(label[x], label[y])
    for at_once in (1 << 20, 0):
        assert {r.node: r.component for r in components.components(df, "a", "b", at_once).collect()} == label


@pytest.mark.parametrize("limit", [1 << 26, 1])
def test_line_dedup_in_one_and_in_many_passes(spark, limit, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    lines = [f"a line of some length {k}" for k in range(6)] + ["short", "", "  A LINE of some length 1\t", "ééééééééééééééééééé", "éééééééééééééééééééé"]
    rng = random.Random(5)
    texts = [None, ""] + ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6))) for _ in range(14)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, texts), carry=("n", "key"), limit=limit).collect()}
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\v\f\r"))
    held = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    for i, t in enumerate(texts):
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != i)]
        assert (out[i].text, out[i].n_lines, out[i].n_dropped, out[i].key) == ("\n".join(kept), len(own), len(own) - len(kept), "x")


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(0)
    h1, h2 = (rng.integers(0, 2**63, 5000, dtype=np.uint64) for _ in range(2))
    h1[:50] = h1[0]
    made = line_dedup.PerfectHash.build(h1, h2)
    assert sorted(made.slots(h1, h2)) == list(range(5000))


def test_warc_round_trip(spark):
    trap = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5
    pages = [(5, "http://a/\r\nX: y", "é" * 80), (3, "u", "é" * 80), (9, None, "é" * 80), (1, "u", "x"), (2, "u", "x"), (4, "u", None),
             (6, "u", ""), (7, "u", trap), (8, "v", trap), (8, "v", trap), (None, "u", trap)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("key", F.lit("clash"))
    out = warc.archive_pages(df, f"{checkpoint_dir(spark)}/warc-test-{random.random()}", size=600)
    rows = out.collect()
    assert len(rows) == len(pages)
    payload = {p: (h or "").encode() for p, _, h in pages}
    for r in rows:
        want = payload[r.key]
        assert (r.payload_bytes, r.payload_digest) == (len(want), hashlib.sha256(want).hexdigest())
        first = {5: 3, 9: 3, 8: 7}.get(r.key)
        assert (r.record_type, r.refers_to) == ("revisit" if first else "response", first)
        assert r.payload == (None if first else want)
    assert {r.key: bytes(r.payload) for r in warc.restore(out).collect() if r.key is not None} == {k: v for k, v in payload.items() if k is not None}
    ids = {r.record_id: r for r in out.collect() if r.record_type == "response"}
    revisits = [r for r in out.collect() if r.record_type == "revisit"]
    assert revisits and all((ids[r.refers_to_id].key, ids[r.refers_to_id].uri, ids[r.refers_to_id].payload_digest) == (r.refers_to, r.refers_to_uri, r.payload_digest) for r in revisits)
    assert warc.archive_pages(df.limit(0), f"{checkpoint_dir(spark)}/warc-none-{random.random()}").count() == 0


def test_url_filter_is_exact_and_rules_win(spark):
    urls = ["https://www.a.org/x?utm_source=f&b=1#t", "http://a.ORG/x/?b=1", "http://a.org/x", "http://sub.example.org/es/1", "http://b.com/de/",
            "http://com/fr/", "http://b.com/de", "nothing", None, "", "x://h://p", "http://xexample.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit("clash"))
    listed = spark.createDataFrame([("http://a.org/x?b=1",), (None,), ("http://b.com/de",), ("http://b.com/de",)], "u string")
    rules = [("org", "/q/", "allow"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    for limit in (1 << 25, 0):
        out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, listed, limit=limit).collect()}
        assert out == {
            0: ("www.a.org", "/x", None, "block"), 1: ("a.org", "/x/", None, "block"), 2: ("a.org", "/x", None, "allow"),
            3: ("sub.example.org", "/es/1", "example.org/es/", "block"), 4: ("b.com", "/de/", "com/de/", "block"),
            5: ("com", "/fr/", "com/fr/", "allow"), 6: ("b.com", "/de", None, "block"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
            9: ("", "", None, "allow"), 10: ("h:", "//p", None, "allow"), 11: ("xexample.org", "/es/", None, "allow")}
    many = spark.range(3000).select(F.concat(F.lit("http://h/"), F.col("id")).alias("u"))
    hits = url_filter.match_listed(spark.range(6000).withColumn("k", F.concat(F.lit("http://h/"), F.col("id"))), F.col("k"), many)
    assert hits.where("_listed").agg(F.min("id"), F.max("id"), F.count("*")).first() == (0, 2999, 3000)


def test_chat_windows(spark):
    rng = random.Random(3)
    turns = []
    for c in [None, *range(12)]:
        for t in range(rng.randint(1, 12)):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "tool\nx\\", None])
            text = rng.choice([None, "", "\\", "<|im_end|>", "<\\|", "a " * rng.choice([1, 30, 200]), "<|nl|>\n é"])
            turns.append((c, t // 2, role, text))
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string").withColumn("pos", F.lit(1)).withColumn("window", F.lit(2))
    windows = chat_windows.format_windows(df, budget=100, history=20)
    out = {r.conv_id: r for r in chat_windows.digest_windows(windows).collect()}
    for c in {t[0] for t in turns}:
        own = sorted(((t, r or "", x or "") for k, t, r, x in turns if k == c))
        said, loss = "".join(f"{r}\n{x}\n" for _, r, x in own), "".join(x for _, r, x in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (out[c].n_turns, out[c].turns_sha256, out[c].loss_chars, out[c].loss_sha256) == (len(own), sha(said), len(loss), sha(loss))
    sized = windows.select("n_tokens", F.size(F.split("formatted", r"<\|im_start\|>")).alias("k"), "n_repeated").collect()
    assert all(r.n_tokens <= 100 or r.k - 1 - r.n_repeated == 1 for r in sized)
    assert chat_windows.digest_windows(chat_windows.format_windows(df.limit(0))).count() == 0


def test_packing_is_optimal_and_whole(spark):
    rng = random.Random(2)
    for _ in range(200):
        histogram = [(x, rng.randint(1, 5)) for x in rng.sample(range(40), rng.randint(1, 8))]
        k = rng.randint(1, 4)
        lengths = sorted(x for x, _ in histogram)
        best = min(packing.padding(histogram, [*some, lengths[-1]]) for some in itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1))
        chosen = packing.boundaries(histogram, k)
        assert packing.padding(histogram, chosen) == best and len(chosen) <= k
    texts = [None, "", *(" ".join("w" * rng.randint(0, 90)) for _ in range(200)), "w " * 70_000]
    docs = documents(spark, texts).withColumn("bucket", F.lit("clash")).union(documents(spark, ["a b"]).withColumn("bucket", F.lit("again")))
    rows = packing.pack(docs, buckets=4, budget=300).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(split_words(t)) for t in [*texts, "a b"])
    batches = {}
    for r in rows:
        assert r.padding == r.bucket_tokens - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    assert all(sorted(r.place for r in b) == list(range(len(b))) for b in batches.values())
    assert all(len(b) == 1 or len(b) * b[0].bucket_tokens <= 300 for b in batches.values())
    assert packing.pack(docs.limit(0)).count() == 0


def test_quality_learns_held_out(spark):
    rng = random.Random(7)
    texts, marks = [], []
    for k in range(400):
        good = k % 2
        words = prose(rng, rng.randint(5, 60), 30)
        texts.append(" ".join(words) + "." if good else " ".join(w + rng.choice(["***", "&&&"]) for w in words))
        marks.append(good)
    docs = documents(spark, [*texts, None, "", "x" * 100_000])
    labels = spark.createDataFrame([*enumerate(marks), (None, 1), (5, None), (6, 9), (10_000, 1)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    out = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(out) == 403 and all(0 <= s <= 1 for s in out.values())
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((out[k] >= 0.5) == marks[k] for k in held) >= 0.98 * len(held)
    assert set(r.doc_id for r in quality.keep_good(docs, model).collect()) == {k for k, s in out.items() if s >= 0.3}
    nothing = quality.train(docs.limit(0), labels.limit(0))
    assert quality.score(docs, nothing).where("score = 0.5").count() == 403


def test_personal_data(spark):
    def slow(t):
        for kind, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                  r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m.group())
                if kind == 0 or kind == 1 and all(int(x) <= 255 for x in m.group().split(".")) or \
                        kind == 2 and 13 <= len(digits) <= 19 and pii.luhn(digits) or kind == 3 and 9 <= len(digits) <= 15:
                    yield kind, m.start(), m.end()

    rng = random.Random(8)
    pieces = ["1", "25", "+", "@", ".", "a", "b.c", " ", "-", "(", "é", "4111111111111111", "\n", "x@y.z", "10.0.0.1", "+1 (017) 555-7713", "0256."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == list(slow(t))
    docs = documents(spark, [None, "", *texts[:300], *(f"write to u{k}@mail.org, call +1 (017) 555-{1000 + k}" for k in range(50)), "a" * 300_000])
    model = pii.train(docs)
    out = {r.doc_id: r for r in pii.find_personal(docs, model).collect()}
    assert len(out) == 353 and out[0].spans == "" and out[310].n_email == out[310].n_phone == 1
    for r in docs.collect():
        base = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in slow(r.text or "")]
        assert out[r.doc_id].base == ",".join(base) and set(base) <= set(out[r.doc_id].spans.split(","))
    run = [pii.shape_features(w) for w in ("+1", "(017)", "555-1234")]
    assert model.decode([run])[0].tolist() == [7, 8, 8]
    assert pii.find_personal(docs.limit(0), pii.train(docs.limit(0))).count() == 0


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    size = len(pii.LABELS)
    field = pii.Field(rng.normal(size=(pii._HASHED, size)), rng.normal(size=(size, size)), rng.normal(size=size), rng.normal(size=size))
    run = [pii.shape_features(w) for w in ("12", "a@b", "9.9")]
    scores = [field.emit[list(f)].sum(axis=0) for f in run]
    best = max(itertools.product(range(size), repeat=3), key=lambda p: field.first[p[0]] + field.last[p[2]] + sum(
        scores[t][p[t]] for t in range(3)) + field.move[p[0], p[1]] + field.move[p[1], p[2]])
    assert field.decode([run])[0].tolist() == list(best)


def test_latent_search(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randint(15, 50)) for _ in range(30)] + [text(6)]
    table = [(k, " ".join(i)) for k, i in enumerate(items)] + [(90, None), (91, ""), (92, "...")]
    texts, want = [None, "", "?!"], set()
    for k in range(120):
        own, start = text(rng.randint(0, 400)), len(texts)
        if k % 3 == 0:
            number = rng.randrange(len(items))
            held = list(items[number])
            if len(held) > 12 and k % 2:
                held[rng.randrange(len(held))] = "changed"
            at = rng.randint(0, len(own))
            own[at:at] = [w.upper() + "," for w in held]
            want.add((start, number))
        texts.append(" ".join(own))
    docs = documents(spark, texts)
    items = spark.createDataFrame(table, "item_id bigint, text string")
    found = latent_search.find_items(docs, items).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(got & want) >= 0.9 * len(want) and got <= want
    latent = {(r.doc_id, r.item_id) for r in latent_search.find_items(docs, items, exact=False).collect()}
    assert len(latent) >= 0.95 * len(got) and latent <= got
    assert latent >= {(r.doc_id, r.item_id) for r in found if r.latent}
    assert {r.doc_id for r in latent_search.without_items(docs, items).collect()} == set(range(len(texts))) - {d for d, _ in got}
    assert latent_search.find_items(docs.limit(0), items).count() == latent_search.find_items(docs, items.limit(0)).count() == 0


def test_latent_search_adds_up_blocks_of_words_fast():
    rng = np.random.default_rng(3)
    axes = rng.standard_normal((1 << latent_search.TERM_BITS, 128))
    weight = np.where(rng.random(len(axes)) < 0.2, 0, 1.0)
    item = " ".join(f"w{n}" for n in range(40))
    items = latent_search.read_items([SimpleNamespace(id=1, text=item, answer=None)])
    searcher = latent_search.Searcher.build(items, axes, weight, weight, -1.0, 0.8, 0.6)
    searcher.prepare()
    texts = [None, "", item, "one", *(" ".join(f"w{n}" for n in rng.integers(0, 50_000, k)) for k in (7, 8, 9, 65, 3000))]
    vectors = axes * weight[:, None]
    own = vectors[latent_search._terms(items[0].words)].sum(axis=0)
    for w in latent_search.words(pa.array(texts), gaps=latent_search.SIGNS):
        found = [*searcher.candidates(w)]
        assert {row for row, *_ in found} == {2, 3, 4, 5, 6, 7, 8} and sum(row == 8 for row, *_ in found) > 150
        for row, _, cosine, low, _ in found:
            begin = low + 16 if low else 0
            if row < 7 or low:  # of the longer texts two windows begin to be read at 0
                made = vectors[latent_search._terms(w.of(row)[begin:begin + 64])].sum(axis=0)
                assert abs(cosine - made @ own / np.linalg.norm(made) / np.linalg.norm(own)) < 1e-4
    searcher.cosine = 2.0
    long = [*latent_search.words(pa.array([" ".join(f"w{n}" for n in rng.integers(0, 50_000, 200_000))]), 1 << 30, latent_search.SIGNS)]

    def seconds(run):
        best = np.inf
        for _ in range(3):
            began = time.process_time()
            run()
            best = min(best, time.process_time() - began)
        return best

    gathered = searcher.vectors[latent_search._terms(long[0].hashes)]
    assert seconds(lambda: [*searcher.candidates(long[0])]) < seconds(lambda: np.add.reduceat(gathered, np.arange(0, len(gathered), 8), axis=0))


def test_latent_axes_take_little_of_the_driver(spark, monkeypatch):
    size, width = 1 << latent_search.TERM_BITS, latent_search.RANK + latent_search.OVERSAMPLE
    rng, one = np.random.default_rng(9), size * width * 4
    drawn = rng.standard_normal((size, 60)).astype(np.float32)
    monkeypatch.setattr(latent_search, "summed", lambda *a, **k: np.tile(drawn, 3)[:, :width].reshape(-1) + drawn[0, 0])  # of lower rank
    sample = spark.createDataFrame([([1, 2], 1.0)], "terms array<bigint>, weight double")
    tracemalloc.start()
    latent_search.latent_axes(sample, np.ones(size))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4.5 * one
    a = rng.standard_normal((10_000, 40)).astype(np.float32)
    q = latent_search._orthonormal(a.copy()).astype(float)
    assert np.abs(q.T @ q - np.eye(40)).max() < 1e-5 and np.abs(q @ (q.T @ a) - a).max() < 1e-4


@pytest.mark.parametrize("query", ["op6", "pipeline"])
def test_latent_axes_are_those_of_all_passages(spark, monkeypatch, tmp_path, query):
    rng, fitted, real = random.Random(8), [], latent_search.latent_axes
    monkeypatch.setattr(latent_search, "latent_axes", lambda rows, idf: fitted.append((real(rows, idf), idf)) or fitted[-1][0])
    texts = [" ".join(f"t{k}x{rng.randrange(10)}" for _ in range(30 * 32)) for k in range(60)]  # each of its own words
    texts += [" ".join(f"w{rng.randrange(600)}" for _ in range(16)) for _ in range(2400)]
    texts += texts[:2] * 3 + [None, "", "?!"]
    item = " ".join(f"i{k}" for k in range(20))
    docs, items = documents(spark, texts), spark.createDataFrame([(1, item)], "item_id bigint, text string")
    if query == "op6":
        assert latent_search.find_items(docs, items).count() == 0
    else:
        items.write.parquet(f"{tmp_path}/benchmark.parquet")
        assert corpus_pipeline.unseen_items(spark, docs, str(tmp_path)).count() == len(texts)
    (axes, idf), = fitted
    passages = [tuple(sorted(own[a:a + 32])) for own in (latent_search._terms(latent_search._hashed(t)).tolist() for t in texts) for a in range(0, len(own), 32)]
    often = np.bincount([t for p in passages for t in set(p)], minlength=len(idf))
    assert np.allclose(idf, np.where(often > 0.05 * len(passages), 0, np.log((len(passages) + 1) / (often + 1))))
    rows = [*dict.fromkeys(passages), latent_search._terms(latent_search._hashed(item)).tolist()]
    used = np.unique(np.concatenate(rows))
    made = np.stack([np.bincount(np.searchsorted(used, r), minlength=len(used)) for r in rows]) * idf[used]
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    made[-1] *= np.sqrt(len(rows) - 1)
    best = np.linalg.eigh(made.T @ made)[1][:, -axes.shape[1]:]
    assert ((made[:-1] @ axes[used])**2).sum() > 0.95 * ((made[:-1] @ best)**2).sum()
    assert np.abs(axes.T @ axes - np.eye(axes.shape[1])).max() < 1e-4


@pytest.mark.parametrize("sizes", [[0, 3, 0, 1], [70, 2, 33, 0, 32, 1500], []])
def test_rows_are_added_up_by_runs(sizes):
    rng = np.random.default_rng(2)
    table, rows = rng.standard_normal((50, 7)), rng.integers(0, 50, sum(sizes))
    want = [table[part].sum(axis=0) for part in np.split(rows, np.cumsum(sizes))[:len(sizes)]]
    assert np.allclose(latent_search._added(table, rows, np.array(sizes, np.int64)), np.array(want).reshape(-1, 7))


@pytest.mark.parametrize("axes", ["fitted", "blind"])
def test_latent_search_holds_all_that_brute_force_holds(spark, monkeypatch, axes):
    if axes == "blind":
        monkeypatch.setattr(latent_search, "latent_axes", lambda sample, idf: np.zeros((1 << latent_search.TERM_BITS, 1)))
        monkeypatch.setattr(latent_search, "ANCHORED", 7)
    else:  # two groups of items in two passes
        monkeypatch.setattr(latent_search, "GROUP", 40)
        monkeypatch.setattr(latent_search, "GROUPS", 1)
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(700)] + ["the"] * 300
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randint(12, 60)) for _ in range(80)]
    answers = [item[-rng.randint(3, 6):] if k % 3 else [] for k, item in enumerate(items)]
    table = [(k, ". ".join(" ".join(part) for part in (item[:len(item) - len(a)], a) if part)) for k, (item, a) in enumerate(zip(items, answers))]
    texts = [None, "", "the " * 50]
    for k in range(150):
        own, number = text(rng.randint(0, 200)), rng.randrange(len(items))
        cut = len(items[number]) - len(answers[number])
        held = [rng.choice(vocabulary) if rng.random() < (0, 0.15, 0.35)[k % 3] and (i < cut or k % 2) else word for i, word in enumerate(items[number])]
        at = rng.randint(0, len(own))
        texts.append(" ".join(own[:at] + held + own[at:]))
    want, low = set(), 0
    for doc, t in enumerate(texts):
        own = split_words(t)
        for k, item in enumerate(items):
            places, window = {}, 32
            for i, word in enumerate(item):
                places[word] = places.get(word, 0) | 1 << i
            while len(item) > window * 3 // 4:
                window *= 2
            for start in range(0, max(1, -(-len(own) // 8) * 8 - window + window // 4), window // 4):
                part = own[max(0, start - window // 4):start + window + window // 4]
                common = latent_search.common_subsequence(places, len(item), part) / len(item)
                answered = answers[k] and any(part[a:a + len(answers[k])] == answers[k] for a in range(len(part)))
                if common >= 0.8 or common >= 0.6 and answered:
                    want.add((doc, k))
                    low += common < 0.8
    docs, items = documents(spark, texts), spark.createDataFrame(table, "item_id bigint, text string")
    assert low and {(r.doc_id, r.item_id) for r in latent_search.find_items(docs, items).collect()} == want
    if axes == "blind":
        assert {r.doc_id for r in latent_search.without_items(docs, items).collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_common_subsequence():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 9))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(max(new[k], row[k + 1], row[k] + (x == y)))
            row = new
        places = {}
        for k, x in enumerate(a):
            places[x] = places.get(x, 0) | 1 << k
        assert latent_search.common_subsequence(places, len(a), b) == row[-1]


def test_near_vectors_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ego_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ego_join, "RUN_ROWS", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    good = [(centres[k % 6] + rng.normal(scale=0.25, size=12)).tolist() for k in range(90)] + [(3 * centres[0]).tolist()] * 5 + [[1e300] * 3, [1e-300] * 3]
    bad = [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11]
    rows = [(k, v, "x", 1) for k, v in enumerate(good + bad)] + [(None, good[0], "x", 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string, count int")
    out = {r.vec_id: r for r in ego_join.near_vectors(df).collect()}
    unit = np.zeros((len(good), 12))
    for k, v in enumerate(good):
        v = np.array(v) / np.abs(v).max()
        unit[k, :len(v)] = v / np.linalg.norm(v)
    linked = unit @ unit.T >= 0.9
    label = np.arange(len(good))
    for _ in good:
        label = np.array([label[linked[k]].min() for k in range(len(good))])
    for k in range(len(good)):
        assert (out[k].n_links, out[k].component_id, out[k].kept) == (linked[k].sum() - 1, label[k], label[k] == k)
    for k in range(len(good), len(good) + len(bad)):
        assert (out[k].n_links, out[k].component_id, out[k].kept) == (0, k, True)
    assert (out[None].n_links, out[None].component_id, out[None].kept) == (0, None, True)
    assert ego_join.near_vectors(df.limit(0)).count() == 0


def test_distant_intervals_are_skipped():
    low = np.array([[0.0], [1], [5], [5.2], [9]])
    i, j = ego_join.near_intervals(low, low + 0.5, 0.6)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (3, 3), (4, 4)]


def test_clustered_vectors_are_mostly_skipped_and_none_is_lost(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(10, 32)) * 1.2
    rows = np.concatenate([centres[rng.integers(0, 10, 19_900)] + rng.normal(scale=0.3, size=(19_900, 32)), rng.normal(size=(100, 32))]).astype(np.float32)
    df = spark.createDataFrame(((int(k), v) for k, v in enumerate(rows.tolist())), "vec_id bigint, embedding array<float>")
    out = {r.vec_id: r for r in ego_join.near_vectors(df).collect()}
    unit = rows.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links, label = np.zeros(len(unit), np.int64), np.arange(len(unit))
    edges = []
    for at in range(0, len(unit), 2000):
        found = unit[at:at + 2000] @ unit.T >= 0.9
        links[at:at + 2000] = found.sum(axis=1) - 1
        edges.append(np.argwhere(found) + [at, 0])
    a, b = np.concatenate(edges).T
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        if (new == label).all():
            break
        label = new
    assert links.max() > 50 and (links == 0).any()
    assert [(out[k].n_links, out[k].component_id) for k in range(len(unit))] == list(zip(links.tolist(), label.tolist()))
    axes = ego_join.principal(unit[:4096], 32)
    classes = df.selectExpr("vec_id AS id", "1L AS count", "embedding AS vector")
    epsilon = float(np.sqrt(0.2))
    boxes = ego_join._blocks(classes, axes, epsilon, 256).select("low", "high").collect()
    i, _ = ego_join.near_intervals(*(np.array([r[c] for r in boxes]) for c in ("low", "high")), epsilon)
    assert len(i) < len(boxes) * (len(boxes) + 1) / 4


def test_bounds_of_leading_dimensions_lose_no_link():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = rng.normal(size=(400, 16))
    rows[200:] = rows[:200] + rng.normal(scale=0.35, size=(200, 16))
    table = pa.table({"ids": [list(range(400))], "counts": [[1] * 400], "vectors": [rows.tolist()]})
    side = ego_join._Side(table, 16, ego_join.principal(rows, 16))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    for i, (p, q) in enumerate(side.runs):
        for j, (r, t) in enumerate(side.runs):
            got = ego_join._linked(side, side, i, j, 0.9)
            want = unit[p:q] @ unit[r:t].T >= 0.9
            assert (want == (got if got is not None else False)).all()


def test_the_field_adds_what_the_patterns_miss(spark):
    docs = documents(spark, [f"text {k} with 10.0.0.{k % 250} and a{k}@b.example.com on 2024-01-{k % 28 + 1:02d}" for k in range(120)])
    model = pii.train(docs)
    held_out = pii.made_examples(1500, 77)
    got = {r.doc_id: r for r in pii.find_personal(documents(spark, [t for t, _ in held_out]), model).collect()}
    hit = wrong = missed = 0
    for k, (text, gold) in enumerate(held_out):
        base = pii.base_spans(text)
        outside = {s for s in gold if not any(a < s[2] and b > s[1] for _, a, b in base)}
        written = set(got[k].spans.split(",")) - {"", *got[k].base.split(",")}
        added = {(pii.KINDS.index(kind), int(a), int(b)) for kind, a, b in (x.split(":") for x in written)}
        hit, wrong, missed = hit + len(outside & added), wrong + len(added - outside), missed + len(outside - added)
        assert not got[k].base or set(got[k].base.split(",")) <= set(got[k].spans.split(","))
    assert hit > 1500 and hit / (hit + missed) >= 0.95 and hit / (hit + wrong) >= 0.95


def test_added_spans_are_of_the_right_kind(spark):
    model = pii.train(documents(spark, []))
    wanted = {
        "call 555-123-4567 now": "phone:5:17", "number 123-45-6789 of": "", "on 2024-01-05 at 10:30": "", "Version 2.0.1 of 1999": "",
        "write to jo.doe(at)example.com today": "email:9:30", "+1 (843) 555-7672 170.106.47.218": "ip:18:32,phone:0:17", "see 9108807962764491.": "card:4:20",
        "": "", "words alone": ""}
    got = {r.text: r.spans for r in pii.find_personal(documents(spark, [None, *wanted]), model).join(documents(spark, [None, *wanted]), "doc_id").collect()}
    assert got == {None: "", **wanted}


def slow_features(text):
    data = (text or "").encode()
    own = data.split()
    if not own:
        return [0.0] * len(quality.FEATURES)
    low, n, feeds = [w.lower() for w in own], len(own), data.count(b"\n") + 1
    kinds = [lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"?!-()",
             lambda b: b in b" \t\n\v\f\r", lambda b: b >= 128]
    upper, sign = (lambda w: sum(map(kinds[0], w))), (lambda w: sum(map(kinds[2], w)))
    share = lambda flags: sum(map(bool, flags)) / n
    ended = [w[-1:] in (b"!", b".", b"?") for w in own]
    capital = [65 <= w[0] <= 90 or w[0] >= 0xC3 for w in own]
    lines = data.split(b"\n")
    return [
        np.log1p(len(data)), np.log1p(n), np.log(feeds), sum(map(len, own)) / n, n / feeds, *(sum(map(k, data)) / len(data) for k in kinds),
        share(sign(w) for w in own), share(sign(w) == len(w) < 3 for w in own), share(upper(w) > 1 and 2 * upper(w) >= len(w) for w in own),
        share(len(w) < 4 for w in own), len(set(low)) / n, max(low.count(w) for w in set(low)) / n, share(a == b for a, b in zip(low, low[1:])),
        share(e or w.count(b"!") > 1 for e, w in zip(ended, own)), share(e and c for e, c in zip(ended, capital[1:])), len(set(lines)) / len(lines)]


def test_features_match_a_slow_version_whatever_stands_beside():
    import pyarrow as pa

    r = random.Random(6)
    pieces = ["Word", "word", "WORD", "a.", "End!", "So!!", "Été", "ß", "12", "$$", "#", "x#y", "é", "THE", "the"]
    texts = [None, "", " \n\t"] + ["".join(r.choice(pieces) + r.choice([" ", "  ", "\n", "\n\n", "\t"]) for _ in range(r.randint(0, 30))) for _ in range(300)]
    got = quality.features(pa.array(texts))
    for text, row in zip(texts, got):
        assert np.allclose(row, slow_features(text), atol=1e-12), text
    assert np.array_equal(got[::-1], quality.features(pa.array(texts[::-1])))


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.2)).astype(float)
    model = quality.fit(x, y, rounds=20, pair_rounds=10, pairs=3)
    assert len(model.pairs) == 3
    for row, margin in zip(x, model.margin(x)):
        place = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges)]
        slow = model.base + sum(t[p] for t, p in zip(model.tables, place))
        slow += sum(t[8 * place[i] // len(model.tables[i]), 8 * place[j] // len(model.tables[j])] for (i, j), t in model.pairs.items())
        assert abs(slow - margin) < 1e-9
    weights, sums = rng.random(12), rng.normal(size=12)
    tree = quality._stump(sums, weights, 2, 1.0, 0.0)
    gain = lambda k: sums[:k].sum() ** 2 / (weights[:k].sum() + 1) + sums[k:].sum() ** 2 / (weights[k:].sum() + 1)
    cut = max(range(1, 12), key=gain)
    want = np.repeat([sums[:cut].sum() / (weights[:cut].sum() + 1), sums[cut:].sum() / (weights[cut:].sum() + 1)], [cut, 12 - cut])
    assert np.allclose(tree, want)
