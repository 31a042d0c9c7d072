"""A Merkle manifest of a table: one tree per group of rows, and one tree over the groups.

Every node carries the interval ``[lo, hi)`` of the leaf ranks it covers. Intervals of one level are
disjoint and those of different levels nest, so ``lo`` divided by the width of a level is a bucket
that holds a node and its parent alike. Proofs are built from the top: a level is joined with the one
above by tree, bucket and containment, and of the parent's interval what is left and right of the
node's own names its siblings.

Texts are hashed where they are read; only digests are sorted. Ranks come from a sort by ranges and
the row counts of (range, group), so a group of any size is spread over many tasks, and no task holds
more than one run of ``fanout`` children at once. Levels are Parquet tables in the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch

FANOUT = 16
FILE_NODES = 1 << 14
_PART = 33  # monotonically_increasing_id keeps the partition above these bits
_PATH = "array<struct<left:binary,right:binary>>"


def framed(*values: Column) -> Column:
    """Values as one text: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    def one(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.concat(*map(one, values))


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def shown(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def _joined(digests: Column) -> Column:
    """An array of binaries, end to end."""
    return F.aggregate(digests, F.lit(b"").cast("binary"), lambda done, x: F.concat(done, x))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(path, leaf, lambda done, step: digest(F.concat(shown(step["left"]), shown(done), shown(step["right"]))))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings in hex, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: shown(F.concat(step["left"], step["right"]))), ""), 256)


@dataclass
class Forest:
    """Tables of nodes ``(tree, lo, hi, n, digest)`` by level; ``n`` leaves of the tree in all.

    Level 0 has ``key`` and ``carried`` too, higher ones ``children``. A node with ``hi - lo = n`` is a root.
    """

    levels: list[DataFrame]
    files: list[int]

    def roots(self) -> DataFrame:
        found = [level.where("hi - lo = n").select("tree", "digest") for level in self.levels]
        for more in found[1:]:
            found[0] = found[0].unionAll(more)
        return found[0]


def _ranked(s: Scratch, leaves: DataFrame, name: str) -> DataFrame:
    """Leaves ``(group, key, digest, carried)`` with their tree, their rank in it and its size.

    ``tree`` grows with the group, null first.
    """
    dealt = leaves.repartitionByRange("group", "key", "digest").sortWithinPartitions("group", "key", "digest")
    dealt = s.keep(dealt.withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    part = F.shiftright("at", _PART)
    runs = dealt.groupBy(part.alias("part"), "group").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("group")
    runs = runs.select(
        "part", F.col("group").alias("of"), "first", F.min("first").over(whole).alias("tree"), F.sum("rows").over(whole).alias("n"),
        F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    both = dealt.join(runs, (part == F.col("part")) & F.col("group").eqNullSafe(F.col("of")))
    lo = F.col("at") - F.col("first") + F.col("before")
    return both.select("tree", lo.alias("lo"), (lo + 1).alias("hi"), "n", "digest", "key", "carried")


def grow(s: Scratch, leaves: DataFrame, name: str, fanout: int = FANOUT) -> Forest:
    """The trees over ``(group, key, digest, carried)``: by group, leaves in the order of key and digest."""
    levels, files = [s.keep(_ranked(s, leaves, name), f"{name}-0")], [0]
    most, nodes, trees = levels[0].agg(F.max("n"), F.count("*"), F.count_if(F.col("lo") == 0)).first()
    most, width = most or 0, 1
    while width < most:
        width *= fanout
        children = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))  # at most fanout of them
        above = levels[-1].where("hi - lo < n").groupBy("tree", F.expr(f"lo div {width}").alias("bucket")).agg(
            children.alias("children"), F.first("n").alias("n"))
        above = above.select(
            "tree", F.col("children")[0]["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), "n",
            digest(F.array_join(F.transform("children", lambda c: shown(c["digest"])), "")).alias("digest"), "children")
        files.append(-(-(nodes // width + trees) // FILE_NODES))  # a level's nodes are counted by its width
        levels.append(s.keep(above, f"{name}-{len(levels)}", files[-1]))
    return Forest(levels, files)


def _paths(s: Scratch, forest: Forest, tops: DataFrame, name: str, fanout: int) -> DataFrame:
    """Level 0 with the siblings on the way up; ``tops``: ``(tree, path, subroot)``, what is above a root."""
    width, above = fanout ** (len(forest.levels) - 1), None
    for k in range(len(forest.levels) - 1, -1, -1):
        level = forest.levels[k]
        own = [c for c in level.columns if c != "tree"]
        found = level.where("hi - lo = n").join(tops, "tree").select("tree", *own, "path", "subroot")
        if above is not None:
            up = above.select(
                F.col("tree").alias("up_tree"), F.expr(f"lo div {width}").alias("up_bucket"), F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"),
                F.col("children").alias("up_children"), F.col("path").alias("up_path"), "subroot")
            within = (F.col("tree") == F.col("up_tree")) & (F.expr(f"lo div {width}") == F.col("up_bucket")) & (
                F.col("up_lo") <= F.col("lo")) & (F.col("hi") <= F.col("up_hi"))
            sides = [_joined(F.transform(F.filter("up_children", keep), lambda c: c["digest"])) for keep in (
                lambda c: c["hi"] <= F.col("lo"), lambda c: c["lo"] >= F.col("hi"))]
            step = F.array(F.struct(sides[0].alias("left"), sides[1].alias("right")))
            inner = level.where("hi - lo < n").join(up, within).select("tree", *own, F.concat(step, "up_path").alias("path"), "subroot")
            found = found.unionAll(inner)
        if k:
            above, width = s.keep(found, f"{name}-paths-{k}", forest.files[k]), width // fanout if k < len(forest.levels) - 1 else width
        else:
            return found


def prove(docs: DataFrame, key: str, group: str, leaf: Column, carry: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """Every row's leaf, the root of its group, the root of all, and the siblings on the way there.

    Returns ``key``, the ``carry`` columns, ``leaf``, ``subroot``, ``root`` (32 bytes each) and ``path``,
    an array of ``(left, right)``: the digests beside the own one, level by level from the leaf up to the
    root of the group and on to the root of all; ``fold(leaf, path)`` gives ``root``.

    ``leaf`` is a 32-byte column of ``docs``. Of each group the leaves are ordered by key (null first) and
    digest, groups by value (null first, a group like others). A row per row: repeated rows are leaves of
    their own, equal beside equal. A table with one row has that row's leaf as root and an empty path; an
    empty table gives none. Other columns, whatever their names, are not read.
    """
    with Scratch(docs.sparkSession) as s:
        carried = F.struct(*[c.alias(n) for n, c in (carry or {}).items()], F.lit(0).alias("_"))
        leaves = s.keep(docs.select(F.col(group).alias("group"), F.col(key).alias("key"), leaf.alias("digest"), carried.alias("carried")), "leaves")
        lower = grow(s, leaves, "rows", fanout)
        subroots = lower.roots().select(F.lit(0).alias("group"), F.col("tree").alias("key"), "digest", F.lit(0).alias("carried"))
        upper = grow(s, subroots, "groups", fanout)
        root = upper.roots().select("digest").first()
        root = F.lit(bytes(root.digest) if root else None).cast("binary")
        nothing = upper.roots().select("tree", F.array().cast(_PATH).alias("path"), F.col("digest").alias("subroot"))
        tops = _paths(s, upper, nothing, "groups", fanout).select(F.col("key").alias("tree"), "path", F.col("digest").alias("subroot"))
        found = _paths(s, lower, s.keep(tops, "tops"), "rows", fanout)
        return s.result(found.select(
            F.col("key").alias(key), *[F.col(f"carried.{n}").alias(n) for n in carry or {}], F.col("digest").alias("leaf"), "subroot",
            root.alias("root"), "path"))
