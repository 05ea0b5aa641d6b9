"""Merkle manifest of a data set: nodes with nested intervals, proofs by containment joins.

Each tree holds the rows of one group in order; the roots of the trees, in order of the group, are the leaves of one
more tree. A node is labelled with the interval of leaf ranks that it covers, so the ancestors of a node are the
nodes whose interval contains its own, and its siblings are what is left of the parent's interval without its own.

Levels are taken in tiers of ``depth``: the nodes below one node of the next tier are a bucket of at most
arity ** depth rows, whatever the size of a tree. Each tier is one grouping, so 100 billion rows take five of
them, and the proofs of a tier's nodes go down to the tier below by a join on tree and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_order, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE, STEP = "struct<lo:bigint,hi:bigint,digest:string>", "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def said(value: Column) -> Column:
    """A field as it is hashed: ``-`` if null, else bytes in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the digests before and after it, level by level, lead to."""
    return F.aggregate(path, leaf, lambda acc, step: digest(step["before"], acc, step["after"]))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


@dataclass(frozen=True)
class Shape:
    """``arity``: nodes below a node. ``depth``: levels of a tier; a bucket of arity ** depth nodes is one row."""

    arity: int = 2
    depth: int = 8

    def height(self, n: Column) -> Column:
        """Levels above the leaves of a tree with ``n`` of them."""
        powers = [self.arity ** k for k in range(63) if self.arity ** k < 1 << 62]
        return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < n))


@dataclass
class Manifest:
    """``root``: of the whole data set, None without rows. ``tiers`` hold the nodes of the trees, ``top`` those above the
    roots of the trees. ``proofs``: one row per leaf with the group's value, its own columns (``payload``), leaf, lo, hi,
    path (digests before and after it on each level, up to ``root``) and subroot."""

    root: str | None
    tiers: list[DataFrame]
    top: list[DataFrame]
    proofs: DataFrame
    shape: Shape = field(default_factory=Shape)

    def nodes(self) -> DataFrame:
        """Every node below and at the roots of the trees: tree, level, lo, hi, digest."""
        rows = None
        for i, tier in enumerate(self.tiers):
            last = i == len(self.tiers) - 1
            # the topmost node of a bucket is the first of the next tier
            own = tier.select("tree", F.posexplode("levels").alias("d", "level_nodes")).where(F.lit(last) | (F.col("d") < self.shape.depth))
            own = own.select("tree", (F.col("d") + i * self.shape.depth).alias("level"), F.inline("level_nodes"))
            # a tree that ended in an earlier tier is one node here
            if i:
                own = own.join(self.tiers[0].select(F.col("tree").alias("_t"), "height").distinct(), F.col("tree").eqNullSafe(F.col("_t"))).where(
                    F.col("level") <= F.greatest("height", F.lit(0))).drop("_t", "height")
            rows = own if rows is None else rows.unionByName(own)
        return rows.distinct()


def _tiers(members: DataFrame, shape: Shape) -> list[DataFrame]:
    """Tiers of the trees of ``members`` (tree, height, lo, hi, digest, payload), each stored.

    A tier has a row per bucket: tree, height, bucket, members, levels, and lo, hi and digest of the node above all.
    """
    out: list[DataFrame] = []
    most = members.agg(F.max("height")).first()[0]
    if most is None:
        return out
    base = 0
    while not out or base < most:
        span = shape.arity ** (base + shape.depth)
        up = F.greatest(F.least(F.col("height") - base, F.lit(shape.depth)), F.lit(0))

        def above(nodes: Column) -> Column:
            last = F.floor((F.size(nodes) - 1) / shape.arity).cast("int")
            runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(nodes, i * shape.arity + 1, shape.arity))
            return F.transform(runs, lambda run: F.struct(
                F.element_at(run, 1)["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"),
                F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), ""), 256).alias("digest")))

        ground = F.transform("members", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest")))
        start = F.array(ground).cast(f"array<array<{NODE}>>")
        tier = (members.groupBy("tree", "height", F.floor(F.col("lo") / span).alias("bucket"))
                .agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "digest", "payload"))).alias("members"))
                .withColumn("levels", F.when(up > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(up, F.lit(1))), start,
                                                                 lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))))).otherwise(start))
                .withColumn("node", F.element_at(F.element_at("levels", -1), 1)))
        out.append(stored(tier.select("tree", "height", "bucket", "members", "levels", "node.*")))
        members = out[-1].select("tree", "height", "lo", "hi", "digest", F.lit(None).cast("int").alias("payload"))
        base += shape.depth
    return out


def _proofs(tiers: list[DataFrame], upper: DataFrame, shape: Shape) -> DataFrame:
    """(tree, lo, hi, digest, payload, path and the other columns of ``upper``) of the first tier's members.

    ``upper``: a row per tree with the path above its root.
    """
    above = upper.withColumnRenamed("tree", "_tree")
    more = [c for c in upper.columns if c not in ("tree", "path")]
    for i in range(len(tiers) - 1, -1, -1):
        base, tier = i * shape.depth, tiers[i]
        powers = F.array(*[F.lit(shape.arity ** (base + d)).cast("long") for d in range(shape.depth + 1)])
        same = F.col("tree").eqNullSafe(F.col("_tree"))
        if i < len(tiers) - 1:  # the bucket's node and all below it lie in one interval of the tier above
            span = shape.arity ** (base + shape.depth)
            same &= (F.col("bucket") == F.floor(F.col("_lo") / span)) & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
        joined = tier.join(above, same)
        first = F.col("bucket") * (shape.arity ** (base + shape.depth))

        def steps(x: Column) -> Column:
            def step(d: Column) -> Column:
                """What is left of the parent's interval, before and after the node that holds x."""
                run = F.floor((x["lo"] - first) / F.element_at(powers, d + 2)).cast("int")  # place of the parent among the nodes of its level
                parent = F.element_at(F.element_at("levels", d + 2), run + 1)
                children = F.slice(F.element_at("levels", d + 1), run * shape.arity + 1, shape.arity)
                before = F.filter(children, lambda s: (parent["lo"] <= s["lo"]) & (s["hi"] <= x["lo"]))
                after = F.filter(children, lambda s: (x["hi"] <= s["lo"]) & (s["hi"] <= parent["hi"]))
                return F.struct(F.array_join(F.transform(before, lambda s: s["digest"]), "").alias("before"),
                                F.array_join(F.transform(after, lambda s: s["digest"]), "").alias("after"))

            n = F.size("levels") - 1
            return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), step)).otherwise(F.array().cast(f"array<{STEP}>"))

        rows = joined.select("tree", *more, F.inline(F.transform("members", lambda x: F.struct(
            x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest"), x["payload"].alias("payload"), F.concat(steps(x), F.col("path")).alias("path")))))
        if not i:
            return rows
        above = stored(rows.drop("digest", "payload")).withColumnsRenamed({"tree": "_tree", "lo": "_lo", "hi": "_hi"})
    raise AssertionError


def manifest(leaves: DataFrame, order: Sequence[str], shape: Shape = Shape()) -> Manifest:
    """The manifest of ``leaves``: columns tree, leaf (a digest) and any others, which come back in ``payload``.

    Leaves of a tree stand in the order of the columns ``order``, then of the digest; trees in the order of ``tree``; nulls
    first. Rows with one key and one digest are interchangeable. A null tree is a tree. Without rows there is no root
    and no proof.
    """
    others = [c for c in leaves.columns if c not in ("tree", "leaf")]
    rows = leaves.select("tree", F.col("leaf").alias("digest"), F.struct(*[F.col(c) for c in others]).alias("payload"))
    keys = [F.col("payload")[c] for c in order]
    placed = in_order(rows, [F.col("tree"), *keys, F.col("digest")], "lo", F.col("tree"))
    members = placed.select("tree", shape.height(F.col("_n")).alias("height"), "lo", (F.col("lo") + 1).alias("hi"), "digest", "payload")
    tiers = _tiers(members, shape)
    if not tiers:
        none = members.select("tree", "lo", "hi", "digest", "payload", F.lit(None).cast(f"array<{STEP}>").alias("path"), F.lit(None).cast("string").alias("subroot"))
        return Manifest(None, [], [], none, shape)
    subroots = tiers[-1].select("digest", F.struct("tree").alias("payload"))
    in_forest = in_order(subroots, [F.col("payload.tree")], "lo")
    forest = in_forest.select(F.lit(0).alias("tree"), shape.height(F.col("_n")).alias("height"), "lo", (F.col("lo") + 1).alias("hi"), "digest", "payload")
    top = _tiers(forest, shape)
    nothing = top[-1].select("tree", F.array().cast(f"array<{STEP}>").alias("path"), F.col("digest").alias("root"))
    root = nothing.first()["root"]
    upper = stored(_proofs(top, nothing.drop("root"), shape).select(F.col("payload.tree").alias("tree"), "path", F.col("digest").alias("subroot")))
    return Manifest(root, tiers, top, _proofs(tiers, upper, shape), shape)


def document_leaves(documents: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "lang", keep: Sequence[str] = ("doc_id",), **changed: dict[str, Column]) -> DataFrame:
    """(tree, leaf, the columns ``keep``) of documents. Each further argument names one more digest, of the leaf with
    the given fields replaced."""
    whole = digest(*[said(F.col(c)) for c in fields])
    more = [digest(*[said(new.get(c, F.col(c))) for c in fields]).alias(name) for name, new in changed.items()]
    return documents.select(F.col(tree).alias("tree"), whole.alias("leaf"), *keep, *more)


def manifest_table(documents: DataFrame) -> DataFrame:
    """One row per document: its leaf, the root of its language, the root of all, a digest of its proof, and the root
    that the proof leads to if one is added to ``n_chars`` of the documents whose id's checksum 7 divides.

    Null fields are hashed as such and stay null when tampered with; null ids come first and are never tampered with;
    equal rows stand side by side. Texts of any length are hashed whole. Other columns are not read.
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = F.when(tampered, (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")).otherwise(F.col("n_chars").cast("string"))
    made = manifest(document_leaves(documents, changed={"n_chars": more}), ["doc_id"])
    folded = fold(F.col("payload.changed"), F.col("path"))
    return (made.proofs.select(F.col("payload.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", F.lit(made.root).alias("root"),
                               proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
