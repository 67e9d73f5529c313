"""Merkle manifest of a dataset: blocks of leaves are reduced where they are, the driver builds the small top of the tree.

A leaf is H (lowercase hex sha256; digests enter as hex text) of a row's columns, each ``-`` if null, else its UTF-8
byte count, ``:`` and its value. Leaves of a group (language) ascend by id; while several nodes remain, every
``ARITY`` consecutive ones, the last run maybe fewer, become their H. What remains is the group's subroot; the subroots, by
group (null first, bytewise), give the root likewise.

1. ``ordered``: rows are sorted across partitions by group, id and leaf and written once; a leaf's position in its group follows
   from one count for each partition and group. No task sees a whole group.
2. ``build``: each block of ARITY ** height positions is reduced to one node by one task. The height grows with the table, so that the
   nodes left are few (``MOST_BLOCKS``, until a block has 8 ** ``HIGHEST`` leaves; 5 * 10^10 rows leave some 190,000), and the driver builds
   the top of the tree from them.
3. ``proofs``: the top is broadcast (a digest for each block, 64 bytes); a task builds its block's tree again, takes the rest
   of the path from the top once for the block, and finishes proof and fold of each row.

Defined results: an empty table has no rows and no root (None); a lone leaf is its group's subroot, a lone subroot the root, and a proof
without siblings is H of nothing; rows that repeat an id are ordered by leaf, so equal rows are leaves of their own; null ids come
first; null texts are ``-``; texts of any length are hashed whole; other columns, of any name, do not matter. More than
``MOST_TOPS`` groups and blocks together raise a ValueError before anything is collected.
"""

from __future__ import annotations

import hashlib
import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.llm.shared import saved, table

ARITY = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Blocks that the driver should get at most, while blocks have fewer than ARITY ** HIGHEST leaves.
MOST_BLOCKS, LOWEST, HIGHEST = 16_384, 3, 6
#: Nodes that the driver takes at all: 64 bytes each.
MOST_TOPS = 1_000_000


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def leaf(*values: Column) -> Column:
    """H of the values, as 32 bytes."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def levels_of(nodes: list[bytes], height: int | None = None) -> list[list[bytes]]:
    """The nodes and what they become: ``height`` levels above them, or as many as leave one node."""
    levels = [nodes]
    while len(levels) <= height if height is not None else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(b"".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return levels


def siblings(levels: list[list[bytes]], i: int) -> list[tuple[bytes, bytes]]:
    """For each level but the last, what stands left and right of the node over place i within its run."""
    path = []
    for nodes in levels[:-1]:
        run = i - i % ARITY
        path.append((b"".join(nodes[run:i]), b"".join(nodes[i + 1 : run + ARITY])))
        i //= ARITY
    return path


class Top(NamedTuple):
    """The top of the tree: levels over each group's blocks, and over the groups."""

    height: int
    counts: dict[str | None, int]  # leaves of each group
    order: list[str | None]
    groups: dict[str | None, list[list[bytes]]]
    above: list[list[bytes]]

    @property
    def root(self) -> str | None:
        return self.above[-1][0].decode() if self.order else None

    def subroot(self, group: str | None) -> str:
        return self.groups[group][-1][0].decode()

    def inner(self, group: str | None) -> int | None:
        """Levels within a block of the group: a group of a single block ends where one node remains."""
        return self.height if self.counts[group] > ARITY**self.height else None

    def suffix(self, group: str | None, block: int) -> list[tuple[bytes, bytes]]:
        """The path from a block's node to the root."""
        return siblings(self.groups[group], block) + siblings(self.above, self.order.index(group))


class Manifest(NamedTuple):
    leaves: DataFrame  # group, block, position and the leaves, with the columns that ordered() was given to carry
    top: Top

    def write(self, path: str) -> None:
        """One line of JSON: root, and of each group its leaves and its subroot."""
        groups = [{"group": g, "leaves": self.top.counts[g], "subroot": self.top.subroot(g)} for g in self.top.order]
        text = json.dumps({"root": self.top.root, "arity": ARITY, "groups": groups})
        self.leaves.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def ordered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (group, id, leaf and more) with their position in the group; and the leaves of each group."""
    key = ["group", "id", "leaf"]
    ranged = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    # the low 33 bits of this id count the rows of the partition
    placed = saved(ranged.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "merkle-ordered")
    heads = placed.groupBy("part", "group").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy("group").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    heads = saved(heads.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "merkle-heads")  # a row for each partition and group
    side = heads.select(F.col("part").alias("h_part"), F.col("group").alias("h_group"), "first", "before")
    joined = placed.join(side, (F.col("part") == F.col("h_part")) & F.col("group").eqNullSafe(F.col("h_group")))
    return joined.withColumn("position", F.col("place") - F.col("first") + F.col("before")).drop("part", "place", "first", "before", "h_part", "h_group"), heads.groupBy("group").agg(F.sum("n").alias("n"))


def build(rows: DataFrame, height: int | None = None) -> Manifest:
    """The manifest of rows (group, id, leaf; other columns are carried along)."""
    placed, groups = ordered(rows)
    known = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("groups")).first()
    if height is None:
        height = LOWEST
        while known["n"] > MOST_BLOCKS * ARITY**height and height < HIGHEST:
            height += 1
    width = ARITY**height
    if known["groups"] + known["n"] // width > MOST_TOPS:
        raise ValueError(f"{known['groups']} groups and {known['n'] // width} blocks are more than the driver takes ({MOST_TOPS})")
    counts = {r["group"]: r["n"] for r in groups.collect()}
    leaves = placed.withColumn("block", F.floor(F.col("position") / width).cast("long"))

    def reduced(key, block):
        group, at = (k.as_py() for k in key)
        nodes = [x.hex().encode() for x in block.column("leaf").take(pc.sort_indices(block.column("position"))).to_pylist()]
        node = levels_of(nodes, height if counts[group] > width else None)[-1][0]
        return pa.table({"group": pa.array([group], pa.string()), "block": pa.array([at], pa.int64()), "node": pa.array([node.decode()])})

    nodes = leaves.select("group", "block", "position", "leaf").groupBy("group", "block").applyInArrow(reduced, "group string, block long, node string")
    tops: dict[str | None, dict[int, bytes]] = {}
    for r in nodes.collect():  # at most MOST_TOPS rows
        tops.setdefault(r["group"], {})[r["block"]] = r["node"].encode()
    order = sorted(tops, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([tops[g][b] for b in sorted(tops[g])]) for g in order}
    return Manifest(leaves, Top(height, counts, order, trees, levels_of([trees[g][-1][0] for g in order])))


def proofs(manifest: Manifest) -> DataFrame:
    """For each leaf: group, position, id, leaf, subroot, root, proof_sha256, folded_root, verified. Column ``claimed`` of the leaves
    is the leaf that is folded with the siblings of the manifest."""
    top = manifest.leaves.sparkSession.sparkContext.broadcast(manifest.top)
    kind = manifest.leaves.schema["id"].dataType

    def finished(key, block):
        tree = top.value
        group, at = (k.as_py() for k in key)
        block = block.take(pc.sort_indices(block.column("position")))
        leaves = [x.hex().encode() for x in block.column("leaf").to_pylist()]
        levels = levels_of(leaves, tree.inner(group))
        suffix = tree.suffix(group, at)
        ending = b"".join(left + right for left, right in suffix)
        # the path above each run of leaves is the same for all of the run
        upper = [siblings(levels[1:], i) + suffix for i in range(len(levels[1]))] if len(levels) > 1 else []
        endings = [b"".join(left + right for left, right in path[: len(path) - len(suffix)]) + ending for path in upper]
        proof, folded = [], []
        for i, claimed in enumerate(block.column("claimed").to_pylist()):
            node = claimed.hex().encode()
            if upper:
                run = i - i % ARITY
                left, right = b"".join(leaves[run:i]), b"".join(leaves[i + 1 : run + ARITY])
                proof.append(digest(left + right + endings[i // ARITY]).decode())
                node = digest(left + node + right)
                path = upper[i // ARITY]
            else:
                proof.append(digest(ending).decode())
                path = suffix
            for left, right in path:
                node = digest(left + node + right)
            folded.append(node.decode())
        n, root = len(leaves), tree.root
        texts = lambda values: pa.array(values, pa.string())
        return pa.table(
            {
                "group": texts([group] * n),
                "position": block.column("position"),
                "id": block.column("id"),
                "leaf": texts([x.decode() for x in leaves]),
                "subroot": texts([tree.subroot(group)] * n),
                "root": texts([root] * n),
                "proof_sha256": texts(proof),
                "folded_root": texts(folded),
                "verified": pa.array(np.array(folded, object) == root, pa.bool_()),
            }
        )

    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = T.StructType([T.StructField("group", T.StringType()), T.StructField("position", T.LongType()), T.StructField("id", kind), *[T.StructField(n, T.StringType()) for n in names], T.StructField("verified", T.BooleanType())])
    return manifest.leaves.select("group", "block", "position", "id", "leaf", "claimed").groupBy("group", "block").applyInArrow(finished, schema)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def manifest_of(docs: DataFrame, changed=None, columns: tuple[str, ...] = COLUMNS) -> Manifest:
    """The manifest of documents by language. ``changed`` is a pair: a condition, and what the text is claimed to be where it holds."""
    values = [F.col(c) for c in columns]
    own = leaf(*values)
    claimed = own
    if changed:
        where, text = changed
        claimed = F.when(where, leaf(*[text if c == "text" else F.col(c) for c in columns])).otherwise(own)
    # hashed once: sorting across partitions reads its rows twice
    return build(saved(docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), own.alias("leaf"), claimed.alias("claimed")), "merkle-leaves"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = proofs(manifest_of(table(spark, sf_dir, "documents"), (third, lowered(F.col("text")))))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", F.col("group").alias("lang"), "position")


QUERIES = {"op12_merkle": op12_merkle}

ORACLE = {
    "op12_merkle": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lowered,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT for i in range(1, len(doc_id::VARCHAR) + 1)]),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1))))) % 3 = 0 AS third
  FROM documents),
l AS (SELECT doc_id, lang, g, sha256(head || tail) AS leaf, CASE WHEN third THEN sha256(head || lowered) ELSE sha256(head || tail) END AS claimed FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
t AS (SELECT g, 0 AS level, 1::BIGINT AS w, i, leaf AS h, n FROM o
  UNION ALL SELECT g, level + 1, w * 8, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY g, level, w, i // 8, n),
s AS (SELECT g, h AS subroot FROM t WHERE n = 1),
u AS (SELECT 0 AS level, 1::BIGINT AS w, g AS i, subroot AS h, count(*) OVER () AS n FROM s
  UNION ALL SELECT level + 1, w * 8, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM u WHERE n > 1 GROUP BY level, w, i // 8, n),
r AS (SELECT h AS root FROM u WHERE n = 1),
p AS (SELECT o.g, o.i, t.level AS step, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < o.i // t.w), '') AS a, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > o.i // t.w), '') AS b
      FROM o JOIN t ON t.g = o.g AND t.n > 1 AND t.i // 8 = o.i // (t.w * 8) GROUP BY ALL
  UNION ALL SELECT o.g, o.i, 100 + u.level, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < o.g // u.w), ''), coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > o.g // u.w), '')
      FROM o JOIN u ON u.n > 1 AND u.i // 8 = o.g // (u.w * 8) GROUP BY o.g, o.i, u.level),
q AS (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY step) AS k FROM p),
f AS (SELECT g, i, 0::BIGINT AS k, claimed AS node FROM o UNION ALL SELECT f.g, f.i, q.k, sha256(q.a || f.node || q.b) FROM f JOIN q ON q.g = f.g AND q.i = f.i AND q.k = f.k + 1),
e AS (SELECT g, i, arg_max(node, k) AS folded_root FROM f GROUP BY g, i),
z AS (SELECT g, i, sha256(string_agg(a || b, '' ORDER BY step)) AS proof FROM p GROUP BY g, i)
SELECT o.doc_id, o.leaf, s.subroot, r.root, coalesce(z.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.root AS verified, o.lang, o.i AS position
FROM o JOIN s USING (g) CROSS JOIN r JOIN e ON e.g = o.g AND e.i = o.i LEFT JOIN z ON z.g = o.g AND z.i = o.i
""",
}
