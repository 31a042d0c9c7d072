"""Similarity join of texts on the Jaccard coefficient of their word n-grams.

1. Every text becomes the set of its distinct shingles; texts with equal sets form a class, and
   only one set of a class goes on.
2. A sketch of hashed counts over all sets, of fixed size, orders shingles from rare to frequent.
   Any order gives right results; this one keeps frequent shingles out of the prefixes.
3. The prefixes are joined on their shingles. Of a pair, the sizes (length filter) and the places
   of the shared shingle (positional filter) bound the overlap from above; of the pairs left,
   counts of both sets in 64 parts bound their difference from below (suffix filter).
4. What remains is verified on the whole texts, once per pair.

Large groups of near copies would give all their pairs. So the join runs twice over the shared
prefix shingles: first each text only meets its predecessor and the first of a shingle's list;
the components of the links found are then contracted, and the second time only texts of
different components meet: those outside the largest component of a list, with the whole list. Components are exact: a pair that never meets is already linked.

Documents are rows; rows with equal ids are one document, which links when one of its texts does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import components
from .scratch import Scratch
from .tally import summed
from .url_filter import possible_rows
from .words import shingle_rows, words

SKETCH_BITS = 20
#: Postings of one shingle that one task sorts; longer lists are dealt into slices.
LIST_ROWS = 1 << 20
_PARTS = 64


def _sketch(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """In how many texts the shingles of each hash bucket occur: 2**SKETCH_BITS counts, however many texts."""
    def count(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for w in words(batch.column(0)):
            found = np.concatenate([s for _, s in shingle_rows(w, size)])
            yield np.bincount((found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)

    counts = summed(docs.select(text), count, 1 << SKETCH_BITS)
    return np.minimum(counts, 2**31 - 1).astype(np.int32)


_SETS = "doc bigint, n bigint, s1 bigint, s2 bigint, parts binary, prefix array<bigint>"


def _sets(docs: DataFrame, key: str, text: str, size: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """One row per text: the size of its set, two hashes of it, its counts in parts, its prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            ids = batch.column(0)
            for w in words(batch.column(1)):
                n, s1, s2, parts, prefix = [], [], [], [], []
                for _, s in shingle_rows(w, size):
                    n.append(len(s))
                    with np.errstate(over="ignore"):
                        s1.append(s.sum(dtype=np.uint64))
                        s2.append((s * (s >> np.uint64(29) | np.uint64(1))).sum(dtype=np.uint64))
                    part = np.bincount((s & np.uint64(_PARTS - 1)).astype(np.int64), minlength=_PARTS)
                    parts.append(np.minimum(part, 255).astype(np.uint8).tobytes())
                    often = counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    length = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    if length < len(s):
                        limit = np.partition(often, length - 1)[length - 1]
                        s, often = s[often <= limit], often[often <= limit]
                    prefix.append(s[np.argsort(often, kind="stable")[:length]].view(np.int64))
                flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(w.first, w.last - w.first), pa.array(n, pa.int64()),
                    pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)),
                    pa.array(parts, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)),
                ], ["doc", "n", "s1", "s2", "parts", "prefix"])

    return docs.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(make, _SETS)


def _may_link(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Length and positional filter of two sets of n and m that share the shingles at i and j."""
    longer, shorter = F.greatest(n, m), F.least(n, m)
    return (shorter * 100 >= longer * percent) & (F.least(n - i, m - j) * (100 + percent) >= (n + m) * percent)


def _suffix_filter(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Drop pairs whose counts in parts already differ by more than linked sets can."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (np.asarray(batch.column(k)) for k in (2, 4))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, _PARTS).astype(np.int16)
                    for k in (3, 5))
            overlap = -(-percent * (n + m) // (100 + percent))
            fit = np.abs(x - y).sum(axis=1) <= n + m - 2 * overlap
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(fit))

    facts = reps.select("doc", "n", "parts")
    a = facts.toDF("a", "n", "x")
    b = facts.toDF("b", "m", "y")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n", "x", "m", "y").mapInArrow(keep, "a bigint, b bigint").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """The pairs that do link, by their whole texts."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = np.zeros(batch.num_rows, bool)
            x = dict(r for w in words(batch.column(2)) for r in shingle_rows(w, size))
            for w in words(batch.column(3)):
                for row, s in shingle_rows(w, size):
                    both = np.concatenate([x[row], s])
                    both.sort()
                    same = int((both[1:] == both[:-1]).sum())
                    fit[row] = 0 < same and 100 * same >= percent * (len(both) - same)
            yield batch.select(["a", "b"]).filter(pa.array(fit))

    used = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    texts = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    # Most texts are in no pair; the filter keeps them out of the shuffle. A semi join would be moved below it.
    texts = possible_rows(texts, "k", used).join(used, "k").distinct()
    a = texts.select(F.col("k").alias("a"), F.col("t").alias("ta"))
    b = texts.select(F.col("k").alias("b"), F.col("t").alias("tb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(keep, "a bigint, b bigint")


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3,
                     percent: int = 90) -> DataFrame:
    """Classes of texts linked by ``100 * intersection >= percent * union`` of their shingle sets.

    Returns one row per row of ``docs``: ``doc_id``, ``n_shingles`` (size of the set) and
    ``component_id`` (the smallest id reachable by links, itself included). A text without words,
    or null, has an empty set and links with nothing. Rows with a null id link with nothing and
    have a null component. Other columns are not looked at. ``percent`` is at least 1.
    """
    spark = docs.sparkSession
    with Scratch(spark) as s:
        sketch = _sketch(docs, text, size)
        sets = s.keep(_sets(docs, key, text, size, percent, sketch), "sets")
        full = sets.where("n > 0 AND doc IS NOT NULL")
        same = ["n", "s1", "s2"]
        reps = s.keep(full.groupBy(*same).agg(F.min("doc").alias("doc"), F.first("parts").alias("parts"),
                                              F.first("prefix").alias("prefix")), "reps")
        # A set with few shingles of its own before a shared one is near the middle of its group, so lists start with it.
        in_list = Window.partitionBy("token", "slice").orderBy("at", "n", "doc")
        postings = reps.select("doc", "n", F.posexplode("prefix").alias("at", "token"))
        long = s.keep(postings.groupBy("token").count().where(F.col("count") > LIST_ROWS).select(
            "token", F.ceil(F.col("count") / LIST_ROWS).alias("slices")), "long")
        postings = postings.join(long, "token", "left").withColumn(
            "slice", F.coalesce(F.pmod(F.xxhash64("doc"), F.col("slices")), F.lit(0).cast("bigint")))
        postings = postings.withColumns({
            **{f"{c}_before": F.lag(c).over(in_list) for c in ("doc", "n", "at")},
            **{f"{c}_first": F.first(c).over(in_list) for c in ("doc", "n", "at")},
            "after": F.lead("doc").over(in_list),
        }).where("doc_before IS NOT NULL OR after IS NOT NULL OR slices IS NOT NULL")
        postings = s.keep(postings, "postings")

        met = postings.where("doc_before IS NOT NULL").select("doc", "n", "at", F.explode(F.array(*(
            F.struct(*(F.col(f"{c}_{which}").alias(c) for c in ("doc", "n", "at"))) for which in ("before", "first")
        ))).alias("o"))
        # The firsts of the slices of one list meet the first of them all.
        heads = postings.where("slices IS NOT NULL").groupBy("token", "slice").agg(F.min(F.struct("at", "n", "doc")).alias("head"))
        heads = heads.join(heads.groupBy("token").agg(F.min("head").alias("o")), "token")
        met = met.unionByName(heads.select("head.doc", "head.n", "head.at", F.struct("o.doc", "o.n", "o.at").alias("o")))
        met = met.where("doc <> o.doc").where(_may_link(F.col("n"), F.col("at"), F.col("o.n"), F.col("o.at"), percent))
        pairs = met.select(F.least("doc", "o.doc").alias("a"), F.greatest("doc", "o.doc").alias("b")).distinct()
        first = s.keep(_suffix_filter(pairs, reps, percent), "pairs1")
        links = s.keep(_verified(first, docs, key, text, size, percent), "links1")

        label = components(links, "a", "b")
        named = postings.select("token", "doc", "n", "at").join(
            label.select(F.col("node").alias("doc"), "component"), "doc", "left")
        named = named.withColumn("component", F.coalesce("component", "doc"))
        # Of two texts in different components, one at least is outside the list's largest component.
        parts = named.groupBy("token", "component").count().groupBy("token").agg(
            F.max_by("component", F.struct("count", "component")).alias("largest"), F.count("*").alias("parts"))
        open_lists = parts.where("parts > 1").select("token", "largest")
        named = s.keep(named.join(open_lists, "token").withColumn("minor", F.col("component") != F.col("largest")).drop("largest"), "open")
        x, y = named.where("minor").alias("x"), named.alias("y")
        apart = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component"))
                       & (~F.col("y.minor") | (F.col("x.doc") < F.col("y.doc")))
                       & _may_link(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"), percent))
        pairs = apart.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()
        pairs = pairs.join(first, ["a", "b"], "left_anti")
        second = s.keep(_suffix_filter(pairs, reps, percent), "pairs2")
        links = links.unionByName(s.keep(_verified(second, docs, key, text, size, percent), "links2"))

        member = full.select("doc", *same).join(reps.select(*same, F.col("doc").alias("rep")), same).select("doc", "n", "rep")
        several = member.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
        more = member.join(several.select("doc", "a"), "doc").select("a", F.col("rep").alias("b"))
        label = components(links.unionByName(more), "a", "b")
        # Equal ids under different sets have the same component, so the label hangs on the representative alone.
        out = member.join(label, member.rep == label.node, "left").select(
            F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
        alone = sets.where("n = 0 OR doc IS NULL").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                                                         F.col("doc").alias("component_id"))
        return s.result(out.unionByName(alone))
