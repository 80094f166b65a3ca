"""A manifest of a dataset as hash trees, with a proof for every document.

Documents of one source are the leaves of a tree of sixteen children a node; the roots of the sources, in
order, are the leaves of one more tree, whose root stands for the dataset. All proofs are made by fractal
traversal: leaves are cut into aligned blocks, and a task goes through a block's leaves with a stack of
subtrees. The existing ones hold the siblings of the current leaf at each level; beside each a desired one
grows, by one node whenever the leaf has passed the run below it, and takes its place when that is used up.
So a task keeps 32 nodes a level besides the block's leaves, of which there are at most 256, and each leaf's
proof is ready when its turn comes. What lies above a block is proved the same way: the roots of
blocks are the leaves of the next traversal, in blocks again, up to the root; these proofs are a row for
each block, and are appended to those within it.

No task holds a source: places come from ranges (``order.numbered``), and blocks are bounded.

Defined cases: a null field counts as ``-``, and an empty text as a value of no bytes; a null source is one
of its own, and stands first; null ids stand first in their source, rows that share an id in the order of
their digests, and rows that are equal next to each other, with a proof each; texts of any length are hashed
whole, within Spark's own expressions; no documents give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, small, table
from .order import numbered

ARITY = 16
#: Levels of an aligned block: 16^2 leaves.
HEIGHT = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Of a node on the way up: the digests of the run that stand left and right of it, one after another.
PATH = "array<struct<left:string,right:string>>"
STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def node(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels above n leaves, until one node remains."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def leaf_digest(fields: list[Column]) -> Column:
    """H over the fields, each ``-`` if null and else its bytes' count, a colon and the value."""
    whole = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*whole), 256)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- traversal of one block


def runs(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level from the given ones up; the last level is one node."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([node(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return out


class Fractal:
    """Stacked subtrees of one level each over a block's leaves: ``path(i)`` for i = 0, 1, 2, ... in turn.

    ``existing[k]`` is the run of level k that the current leaf's ancestor is in, and ``desired[k]`` the run
    after it as far as it has grown. The top run is given, as the pass that made the block's root has it.
    """

    def __init__(self, leaves: list[str], levels: int, top: list[str]):
        self.leaves, self.levels = leaves, levels
        self.existing: list[list[str]] = [[] for _ in range(levels)]
        self.desired: list[list[str]] = [[] for _ in range(levels)]
        self.grown = [0] * levels  # nodes of each level made so far
        if levels:
            self.existing[-1] = top
            for k in range(levels - 2, -1, -1):  # the first run of each level below the top
                self.existing[k] = [self._next(k) for _ in range(min(ARITY, self._size(k)))]

    def _size(self, k: int) -> int:
        """Nodes of level k in the block."""
        return -(-len(self.leaves) // ARITY**k)

    def _next(self, k: int) -> str:
        """The next node of level k, in order, made of the leaves below it."""
        i = self.grown[k]
        self.grown[k] += 1
        if k == 0:
            return self.leaves[i]
        at = self.leaves[i * ARITY**k : (i + 1) * ARITY**k]
        return runs(at, k)[-1][0]

    def path(self, i: int) -> list[tuple[list[str], list[str]]]:
        """(left, right) siblings of leaf i at each level of the block."""
        out = []
        for k in range(self.levels):
            at = i // ARITY**k
            if k < self.levels - 1 and i and i % ARITY ** (k + 1) == 0:  # past the run: the desired one takes its place
                self.existing[k], self.desired[k] = self.desired[k], []
            run, own = self.existing[k], at % ARITY
            out.append((run[:own], run[own + 1 :]))
        for k in range(self.levels - 1):  # one node more for each desired run whose level the next leaf enters
            if (i + 1) % ARITY**k == 0 and self.grown[k] < self._size(k):
                self.desired[k].append(self._next(k))
        return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its proof lead to."""
    for left, right in path:
        leaf = hashlib.sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


def proof_digest(path: list[tuple[str, str]]) -> str:
    return hashlib.sha256("".join(left + right for left, right in path).encode()).hexdigest()


# ---- blocks, block by block up to the root


def _blocks(placed: DataFrame, carry: list[str]) -> DataFrame:
    """A row for each block of (tree, pos, n, digest): its rows in order, at most 256, with what else they carry."""
    width = ARITY**HEIGHT
    rows = placed.groupBy("tree", F.floor(F.col("pos") / width).alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "digest", *(c for c in carry if c != "pos")))).alias("rows"))
    return rows.select("tree", "block", "n", *(F.col(f"rows.{c}").alias(c) for c in ("digest", *carry)))


def _levels(n: int) -> int:
    """Levels within a block of a tree of n leaves."""
    return min(HEIGHT, height_of(n))


def _roots(blocks: DataFrame) -> DataFrame:
    """(tree, pos, n, digest, top): the root of each block, its place, how many the tree has, and the run below it."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            digests, tops = [], []
            for n, leaves in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                levels = runs(leaves, _levels(n))
                digests.append(levels[-1][0])
                tops.append(levels[-2] if len(levels) > 1 else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests), pa.array(tops, pa.list_(pa.string()))], names=["tree", "block", "n", "root", "top"])

    made = blocks.select("tree", "block", "n", "digest").mapInArrow(run, "tree string, block long, n long, root string, top array<string>")
    return made.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / ARITY**HEIGHT).cast("long").alias("n"), F.col("root").alias("digest"), "top")


def _paths(blocks: DataFrame, carry: list[str], kinds: list[str]) -> DataFrame:
    """(tree, <carry>, digest, path) of each row of blocks, which have ``top`` and ``above`` (the path of the block's root)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                leaves = row["digest"]
                walk = Fractal(leaves, _levels(row["n"]), row["top"])
                above = [(x["left"], x["right"]) for x in row["above"]]
                found = [[{"left": "".join(a), "right": "".join(b)} for a, b in walk.path(i)] + [{"left": a, "right": b} for a, b in above] for i in range(len(leaves))]
                m = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * m, pa.string()), *(pa.array(row[c], batch.schema.field(c).type.value_type) for c in carry), pa.array(leaves), pa.array(found, pa.list_(STEP))], names=["tree", *carry, "digest", "path"]
                )

    fields = ", ".join(["tree string", *(f"{c} {k}" for c, k in zip(carry, kinds)), "digest string", f"path {PATH}"])
    return blocks.mapInArrow(run, fields)


def _above(roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of roots of blocks: (tree, block, top, above), and (tree, digest) of each tree's root.

    Climbs by blocks of blocks until every tree is one node, then appends proofs on the way down.
    """
    levels, packs = [roots], []
    while not levels[-1].where("n > 1").isEmpty():
        packs.append(materialize(_blocks(levels[-1].where("n > 1").select("tree", "pos", "n", "digest"), ["pos"]), "blocks-of-roots"))
        levels.append(materialize(_roots(packs[-1]), "roots-of-blocks"))
    whole = levels[0].where("n = 1").select("tree", "digest")
    for level in levels[1:]:
        whole = whole.unionByName(level.where("n = 1").select("tree", "digest"))
    none = F.array().cast(PATH)
    paths = levels[-1].select("tree", F.col("pos").alias("block"), "top", none.alias("above"))
    for packed, below in zip(packs[::-1], levels[-2::-1]):
        up = _paths(_with_above(packed, paths, ["digest", "pos"]), ["pos"], ["long"])
        up = materialize(up.select(F.col("tree").alias("t"), F.col("pos").alias("p"), "path"), "upper-proofs")
        joined = below.join(small(up), F.col("tree").eqNullSafe(F.col("t")) & (F.col("pos") == F.col("p")), "left")
        paths = joined.select("tree", F.col("pos").alias("block"), "top", F.coalesce("path", none).alias("above"))
    return materialize(paths, "proofs-of-blocks"), materialize(whole, "tree-roots")


def _with_above(blocks: DataFrame, paths: DataFrame, columns: list[str]) -> DataFrame:
    p = paths.select(F.col("tree").alias("__t"), F.col("block").alias("__b"), "top", "above")
    return blocks.join(p, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("block") == F.col("__b"))).select("tree", "n", *columns, "top", "above")


def _forest(leaves: DataFrame, order: list[Column], carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(tree, n, digest, <carry>, top, above) of each block, and (tree, digest) of each root. leaves: tree, digest, carry."""
    placed = numbered(leaves, ["tree"], order, size="n")
    blocks = materialize(_blocks(placed, carry), "blocks")
    discard(*placed.written)
    roots = materialize(_roots(blocks), "roots-of-blocks")
    paths, whole = _above(roots)
    return _with_above(blocks, paths, ["digest", *carry]), whole


# ---- the manifest


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, claim: Column | None = None, proofs: bool = True) -> DataFrame:
    """A row for each document: id, group, leaf, subroot, root, proof (levels of left and right siblings), proof_sha256, folded_root, verified.

    ``claim`` is the digest held against the root in place of the leaf, as of a copy that a reader has; null
    claims the leaf itself. ``proofs``: whether the siblings are returned, some 5 KB a document, or only their digest.
    """
    c = lambda x: F.col(f"`{x}`")
    leaves = docs.select(c(group_col).cast("string").alias("tree"), c(id_col).cast("long").alias("id"), leaf_digest([c(f) for f in fields]).alias("digest"), (F.lit(None).cast("string") if claim is None else claim).alias("claim"))
    leaves = materialize(leaves, "leaves")
    blocks, subroots = _forest(leaves, [F.col("id"), F.col("digest")], ["id", "claim"])
    # the roots of the groups are the leaves of one more tree
    top, root = _forest(materialize(subroots.select(F.lit(None).cast("string").alias("tree"), "digest", F.col("tree").alias("group")), "subroots"), [F.col("group")], ["group"])
    joined = _paths(top, ["group"], ["string"]).select(F.col("group").alias("g"), F.col("digest").alias("subroot"), F.col("path").alias("to_root"))
    joined = materialize(joined.join(F.broadcast(root.select(F.col("digest").alias("root")))), "subroot-proofs")  # one root
    blocks = blocks.join(small(joined), F.col("tree").eqNullSafe(F.col("g")))
    blocks = blocks.select("tree", "n", "digest", "id", "claim", "top", F.concat("above", "to_root").alias("above"), "subroot", "root")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                leaves, above = row["digest"], [(x["left"], x["right"]) for x in row["above"]]
                walk, m = Fractal(leaves, _levels(row["n"]), row["top"]), len(leaves)
                digests, folded, kept = [], [], []
                for i, (leaf, claimed) in enumerate(zip(leaves, row["claim"])):
                    path = [("".join(a), "".join(b)) for a, b in walk.path(i)] + above
                    digests.append(proof_digest(path))
                    folded.append(fold(leaf if claimed is None else claimed, path))
                    if proofs:
                        kept.append([{"left": a, "right": b} for a, b in path])
                same = [pa.array([row[k]] * m, pa.string()) for k in ("tree", "subroot", "root")]
                found = [pa.array(kept, pa.list_(STEP))] if proofs else []
                verified = pa.array([f == row["root"] for f in folded])
                columns = [pa.array(row["id"], pa.int64()), same[0], pa.array(leaves), same[1], same[2], *found, pa.array(digests), pa.array(folded), verified]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = {"id": "long", "tree": "string", "leaf": "string", "subroot": "string", "root": "string"} | ({"proof": PATH} if proofs else {}) | {"proof_sha256": "string", "folded_root": "string", "verified": "boolean"}
    names = list(kinds)
    out = blocks.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))
    return out.withColumnRenamed("id", id_col).withColumnRenamed("tree", group_col)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    altered = leaf_digest([lower_ascii(F.col(f)) if f == "text" else F.col(f) for f in FIELDS])
    found = manifest(docs, claim=F.when(tampered, altered), proofs=False)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql(levels: int = 8) -> str:
    """The same by whole levels of nodes; 16^8 documents a source at most."""
    h = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = " || ".join(h(f) for f in FIELDS)
    low = " || ".join(f"coalesce(CAST(strlen(text) AS VARCHAR) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')" if f == "text" else h(f) for f in FIELDS)
    crc = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"
    parts = [
        f"d AS (SELECT row_number() OVER () AS id, doc_id, source, sha256({leaf}) AS leaf, sha256({low}) AS altered, coalesce({crc} % 5 = 0, false) AS tampered FROM documents)",
        "p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d)",
    ]

    def climb(name: str, leaves: str) -> str:
        """Levels name0, name1, ... of (tree, i, h, n): a tree of one node stays as it is."""
        parts.append(f"{name}0 AS ({leaves})")
        for k in range(levels):
            parts.append(f"{name}{k + 1} AS (SELECT tree, i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(n) + 15) // 16 AS n FROM {name}{k} GROUP BY tree, i // 16)")
        return f"{name}{levels}"

    def prove(name: str, rows: str) -> str:
        """rows: (id, tree, i, proof, folded); adds what the levels of ``name`` have beside each."""
        parts.append(f"{name}p0 AS ({rows})")
        for k in range(levels):
            beside = f"SELECT a.tree, a.i, a.n, coalesce((SELECT string_agg(b.h, '' ORDER BY b.i) FROM {name}{k} b WHERE b.tree IS NOT DISTINCT FROM a.tree AND b.i // 16 = a.i // 16 AND b.i < a.i), '') AS l, coalesce((SELECT string_agg(b.h, '' ORDER BY b.i) FROM {name}{k} b WHERE b.tree IS NOT DISTINCT FROM a.tree AND b.i // 16 = a.i // 16 AND b.i > a.i), '') AS r FROM {name}{k} a"
            parts.append(f"{name}p{k + 1} AS (SELECT x.id, x.tree, x.i // 16 AS i, CASE WHEN s.n = 1 THEN proof ELSE proof || s.l || s.r END AS proof, CASE WHEN s.n = 1 THEN folded ELSE sha256(s.l || folded || s.r) END AS folded FROM {name}p{k} x JOIN ({beside}) s ON x.tree IS NOT DISTINCT FROM s.tree AND x.i = s.i)")
        return f"{name}p{levels}"

    subs = climb("a", "SELECT source AS tree, i, leaf AS h, n FROM p")
    parts.append(f"q AS (SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM {subs})")
    root = climb("b", "SELECT 0 AS tree, i, subroot AS h, n FROM q")
    lower = prove("a", "SELECT id, source AS tree, i, '' AS proof, CASE WHEN tampered THEN altered ELSE leaf END AS folded FROM p")
    whole = prove("b", f"SELECT x.id, 0 AS tree, q.i, proof, folded FROM {lower} x JOIN q ON x.tree IS NOT DISTINCT FROM q.source")
    return f"WITH {', '.join(parts)} SELECT d.doc_id, d.leaf, q.subroot, z.h AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = z.h AS verified FROM d JOIN {whole} w ON d.id = w.id JOIN q ON d.source IS NOT DISTINCT FROM q.source, {root} z"


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLE: dict[str, str] = {"op12_merkle_manifest": _sql()}
