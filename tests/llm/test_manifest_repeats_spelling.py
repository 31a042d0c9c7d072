"""The manifest, the removal of repeats and the spelling variants against brute force, with nulls, ties, repeated rows and clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablestory.llm import merkle, repeats, spelling

DOCS = "doc_id bigint, source string, text string, lo int, path string, chunk int, word string, n int"


def documents(spark, rows):
    return spark.createDataFrame([(k, s, t, 7, "x", 1, "w", 2) for k, s, t in rows], DOCS)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(leaves, fanout):
    """The root, and for every leaf the (left, right) siblings by level."""
    paths, members = [[] for _ in leaves], [[i] for i in range(len(leaves))]
    level = list(leaves)
    while len(level) > 1:
        above, held = [], []
        for at in range(0, len(level), fanout):
            run = level[at:at + fanout]
            for j in range(len(run)):
                for i in members[at + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            above.append(h(*run))
            held.append([i for m in members[at:at + fanout] for i in m])
        level, members = above, held
    return level[0], paths


def proved(rows, fanout):
    groups = {}
    for k, s, t in rows:
        groups.setdefault(s, []).append((-1 if k is None else k, h(framed(k, s, t)), k))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: tree([x[1] for x in sorted(groups[s], key=lambda x: x[:2])], fanout) for s in names}
    root, top = tree([made[s][0] for s in names], fanout)
    out = []
    for s, above in zip(names, top):
        for (_, leaf, k), path in zip(sorted(groups[s], key=lambda x: x[:2]), made[s][1]):
            out.append((k, s, leaf, made[s][0], root, tuple(path + above)))
    return sorted(out, key=repr)


def prove(docs, fanout=3):
    leaf = merkle.digest(merkle.framed(*[F.col(c) for c in ("doc_id", "source", "text")]))
    made = merkle.prove(docs, "doc_id", "source", leaf, {"source": F.col("source")}, fanout)
    step = F.transform("path", lambda p: F.struct(merkle.shown(p["left"]).alias("left"), merkle.shown(p["right"]).alias("right")))
    folded = merkle.shown(merkle.fold(F.col("leaf"), F.col("path")))
    return made.select("doc_id", "source", *[merkle.shown(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], step.alias("steps"),
                       folded.alias("folded"), merkle.proof_digest(F.col("path")).alias("proof"))


@pytest.mark.parametrize("rows", [
    [(1, "a", "one")],
    [(k, None if k % 5 == 0 else "hot" if k % 3 else f"s{k % 7}", None if k % 11 == 0 else "Été " * (k % 4)) for k in range(120)],
    [(1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (None, "a", "x"), (None, None, None), (2, "", ""), (3, "é", "z"), (4, "z", "z")],
])
def test_manifest_matches_a_tree_in_memory(spark, rows):
    found = prove(documents(spark, rows)).collect()
    got = [(r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple(map(tuple, r.steps))) for r in found]
    assert sorted(got, key=repr) == proved(rows, 3)
    assert all(r.folded == r.root and r.proof == h(*["".join(s) for s in r.steps]) for r in found)


def test_manifest_tells_a_changed_leaf(spark):
    docs = documents(spark, [(k, "a", f"text {k}") for k in range(40)])
    made = merkle.prove(docs, "doc_id", "source", merkle.digest(F.col("text")))
    other = made.withColumn("leaf", F.when(F.col("doc_id") == 7, merkle.digest(F.lit("no"))).otherwise(F.col("leaf")))
    wrong = other.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root"))
    assert [r.doc_id for r in wrong.collect()] == [7]


def test_manifest_of_an_empty_table(spark):
    assert prove(documents(spark, [])).count() == 0


def without_repeats(rows, size):
    split = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    least = {}
    for k, w in split:
        for i in range(len(w) - size + 1):
            run = tuple(w[i:i + size])
            own = float("inf") if k is None else k
            least[run] = min(least.get(run, float("inf")), own)
    out = []
    for k, w in split:
        own = float("inf") if k is None else k
        gone = {j for i in range(len(w) - size + 1) if least[tuple(w[i:i + size])] < own for j in range(i, i + size)}
        out.append((k, " ".join(x for j, x in enumerate(w) if j not in gone), len(w), len(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size, chunk_bytes", [(13, 8 << 20), (13, 300), (8, 500)])
def test_repeats_match_all_windows(spark, size, chunk_bytes):
    rng = random.Random(size + chunk_bytes)
    passages = [[f"p{k}w{j % 17}" for j in range(rng.randint(size - 2, 4 * size))] for k in range(12)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two")]
    for k in range(90):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [f"{rng.choice(['so', 'Été', 'word'])}{rng.randint(0, 4)}" for _ in range(rng.randint(0, 12))] + rng.choice(passages)
        rows.append((rng.choice([None, k, k, k // 3 + 200]), rng.choice([" ", "\n", "  \t"]).join(text)))
    rows += [(900, "same " * 60), (901, "same " * 60), (902, "Same " * 60), rows[-1], rows[-1]]
    docs = spark.createDataFrame([(k, "a", t, 7, "x", 1, "w", 2) for k, t in rows], DOCS).repartition(3)
    got = repeats.remove_repeats(docs, carry=("chunk", "word"), size=size, chunk_bytes=chunk_bytes)
    assert got.columns == ["doc_id", "chunk", "word", "text", "n_words", "n_removed"]
    assert sorted([(r.doc_id, r.text, r.n_words, r.n_removed) for r in got.collect()], key=repr) == without_repeats(rows, size)


def test_repeats_of_odd_tables(spark):
    assert repeats.remove_repeats(documents(spark, [])).count() == 0
    assert [tuple(r) for r in repeats.remove_repeats(documents(spark, [(None, None, None)])).collect()] == [(None, "", 0, 0)]
    long = " ".join(f"w{k % 5000}" for k in range(200_000))
    got = repeats.remove_repeats(documents(spark, [(1, "a", long), (2, "a", long + " end")])).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed) for r in got] == [(200_000, 0), (200_001, 200_000)] and got[1].text == "end"


def test_texts_are_not_shuffled_after_they_are_dealt(spark):
    from tablestory.llm.scratch import Scratch

    with Scratch(spark) as s:
        held = s.keep_by(documents(spark, [(1, "a", "x")]).select("chunk", "text"), "held", "chunk")
        other = spark.range(3).select(F.col("id").cast("int").alias("chunk"))
        both = held.groupBy("chunk").cogroup(other.groupBy("chunk")).applyInArrow(lambda a, b: a, held.schema)
        plan = both._jdf.queryExecution().optimizedPlan().toString() + both._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("bits", [1, 7, 8, 20, 33, 63])
def test_packed_values_come_back(bits):
    rng = np.random.default_rng(bits)
    plan = repeats.Plan(13, 64, 5)
    values = np.unique(rng.integers(0, 2**64 - 1, 500, dtype=np.uint64) >> np.uint64(64 - bits) | np.uint64(0))
    parts = list(repeats._pack(values, 64, plan))
    back = [repeats._unpack(d, at.stop - at.start) + (np.uint64(p) << np.uint64(59)) for p, at, d in parts]
    assert np.array_equal(np.concatenate(back), values)
    ids = rng.integers(-2**62, 2**62, 77)
    assert np.array_equal(repeats._unpacked_ids(repeats._packed_ids(ids), 77), ids)


def test_the_cover_holds_every_shift():
    for a, b in itertools.product(range(repeats.PERIOD), repeat=2):
        assert any((a + k) % repeats.PERIOD in repeats.COVER and (b + k) % repeats.PERIOD in repeats.COVER for k in range(repeats.PERIOD))


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(counts):
    form, out = {}, {}
    for w in counts:
        found = sorted((-counts[v], v) for v in counts if near(w, v))
        form[w] = (found[0][1] if found and -found[0][0] >= 2 * counts[w] else None, len(found))
    for w in counts:
        root = w
        while form[root][0]:
            root = form[root][0]
        out[w] = (form[w][0], root, counts[w], form[w][1], counts.get(form[w][0]))
    return out


@pytest.mark.parametrize("shard_words", [1 << 15, 8])
def test_variants_match_all_pairs(spark, shard_words):
    rng = random.Random(3)
    words = {"aaaaa", "aaaaaa", "aaaaaaa", "ÿÿÿÿÿ", "ÿÿÿÿ", "abcabc", "abcab", "bcabc", "x" * 3000, "x" * 2999 + "y"}
    for _ in range(40):
        word = "".join(rng.choice("abé") for _ in range(rng.randint(5, 11)))
        words.add(word)
        for _ in range(4):
            k, c = rng.randrange(len(word)), rng.choice("abéz")
            words.add(rng.choice([word[:k] + word[k + 1:], word[:k] + c + word[k:], word[:k] + c + word[k + 1:], word + c]))
    counts = {w: rng.choice([3, 4, 6, 8, 12, 50]) for w in words}
    vocabulary = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n bigint, form string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(vocabulary, shard_words=shard_words).collect()}
    assert got == grouped(counts)


def test_words_are_counted_with_their_losses(spark):
    texts = [(k, "a", t) for k, t in enumerate([None, "", "Straße Ärger ärger", "river" * 3 + " RIVER river-river x", "a1bcdef×ghij", "stone " * 500] * 40)]
    texts += [(None, "a", "nobody Nobody"), (5, "a", "stone"), (5, "a", "stone")]
    want = Counter()
    for k, _, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            x = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if x % 7 == 0:
                run = run[:x % len(run)] + run[x % len(run) + 1:]
            want[run] += len(run) >= 5
    got = {r.word: r.n for r in spelling.count_words(documents(spark, texts), delete_every=7).collect()}
    assert got == {w: n for w, n in want.items() if n}


def test_variants_of_odd_tables(spark):
    assert spelling.spelling_variants(documents(spark, [])).count() == 0
    vocabulary = spark.createDataFrame([("stone", 2), ("stone", 1), (None, 9), ("stones", 30)], "word string, n bigint")
    got = sorted(tuple(r) for r in spelling.group_variants(vocabulary).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == [("stone", "stones", "stones", 3, 1, 30), ("stones", None, "stones", 30, 1, None)]


def test_long_texts_give_the_same_words(monkeypatch):
    monkeypatch.setattr(spelling, "_LONG", 10)
    assert spelling._runs("one two Two été-one " * 3) == Counter({"one": 6, "two": 3, "Two": 3, "été": 3})
