"""A Merkle manifest of a dataset with a proof for every row.

Rows are leaves; the leaves of a group, in order, are hashed three at a time until one node is left, and the groups' tops
are hashed the same way into one root. Parents are combined by key and driven by events: a task keeps the partial parents
whose children it has met, each with its children's digests by place. How many children a parent has follows from the
size of its group, so the task knows when the last one has come; it then hashes the parent and passes it on as a child of
the next level. Leaves lie in files in order, so nearly all parents are complete where they are read. Children whose
parent is not complete (the frontier: a few for each end of a task) go into a shuffle by ever wider aligned blocks and
meet there. Each node keeps its children's digests; along these links, turned round, proofs go from the root down to the
leaves, six levels a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlink.llm import common

ARITY = 3
#: Levels that one shuffle resolves: a block has at most 3^6 leaves, the most that a task keeps together.
STRIDE = 6

_NODE = "kind int, grp string, n long, level int, idx long, digest string, kids array<string>"
_PROOF = "grp string, level int, idx long, proof string, subroot string, root string"


def cell(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 bytes with their number ahead."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[cell(v) for v in values]).cast("binary"), 256)


def _hash(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _power(exponent: Column) -> Column:
    """3 to the exponent as a long (3^39 is the largest)."""
    return F.element_at(F.array(*[F.lit(ARITY**k) for k in range(40)]), (exponent + 1).cast("int"))


def _width(n: int, level: int) -> int:
    return -(-n // ARITY**level)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children in; complete parents (kind 0) and children whose parents stay open (kind 1) out."""
    names = ["kind", "grp", "n", "level", "idx", "digest", "kids"]
    schema = pa.schema([("kind", pa.int32()), ("grp", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("kids", pa.list_(pa.string()))])
    partial: dict[tuple[str, int, int, int], dict[int, str]] = {}
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names)
    for batch in batches:
        done: list[tuple] = []
        for grp, n, level, idx, value in zip(*[batch.column(c).to_pylist() for c in ("grp", "n", "level", "idx", "digest")], strict=True):
            while _width(n, level) > 1:
                parent = (grp, n, level + 1, idx // ARITY)
                kids = partial.setdefault(parent, {})
                kids[idx % ARITY] = value
                if len(kids) < min(ARITY, _width(n, level) - ARITY * parent[3]):
                    break
                ordered = [kids[k] for k in sorted(kids)]
                del partial[parent]
                level, idx, value = level + 1, parent[3], _hash(*ordered)
                done.append((0, grp, n, level, idx, value, ordered))
        if done:
            yield pack(done)
    left = [(1, grp, n, level - 1, ARITY * idx + k, value, None) for (grp, n, level, idx), kids in partial.items() for k, value in kids.items()]
    for at in range(0, len(left), 10_000):
        yield pack(left[at : at + 10_000])


def nodes(leaves: DataFrame) -> DataFrame:
    """grp, n, level, idx, digest, kids of all inner nodes over leaves (grp, n, idx, digest). A group of one leaf has none."""
    spark, out, wide = leaves.sparkSession, [], 1
    events = common.stored(leaves.select("grp", "n", F.lit(0).alias("level"), "idx", "digest").mapInArrow(_combine, _NODE), "nodes")
    while True:
        out.append(events.where("kind = 0"))
        frontier = events.where("kind = 1")
        if frontier.isEmpty():
            break
        if wide > 8:
            raise RuntimeError("parents stay open although all children were sent")
        block = F.floor(F.col("idx") * _power(F.col("level")) / F.lit(ARITY ** (STRIDE * wide))) if wide * STRIDE < 39 else F.lit(0)
        met = frontier.drop("kind", "kids").withColumn("block", block).repartition("grp", "block")
        events = common.stored(met.drop("block").mapInArrow(_combine, _NODE), "nodes")
        wide += 1
    every = spark.createDataFrame([], _NODE)
    for part in out:
        every = every.unionByName(part)
    return every.drop("kind")


def _descend(batches: Iterator[pa.RecordBatch], floor: int) -> Iterator[dict[tuple, tuple]]:
    """For each batch the proofs of the nodes of level floor that it completes, by (grp, idx), and the batch. Rows come block by
    block, level by level from above, a node's proof ahead of the node."""
    block, proofs = None, {}
    for batch in batches:
        ready: dict[tuple, tuple] = {}
        cols = [batch.column(c).to_pylist() for c in ("grp", "block", "kind", "level", "idx", "kids", "proof", "subroot", "root", "doc_id", "leaf", "tampered")]
        out = []
        for grp, blk, kind, level, idx, kids, proof, subroot, root, doc_id, leaf, tampered in zip(*cols, strict=True):
            if (grp, blk) != block:
                block, proofs = (grp, blk), {}
            if kind == 0:
                proofs[level, idx] = (proof, subroot, root)
            elif kind == 1:
                above, subroot, root = proofs.pop((level, idx))
                for k in range(len(kids)):
                    here = "".join(kids[:k]) + "," + "".join(kids[k + 1 :]) + (";" + above if above else "")
                    proofs[level - 1, ARITY * idx + k] = (here, subroot, root)
                    if level - 1 == floor:
                        ready[grp, ARITY * idx + k] = (here, subroot, root)
            else:
                out.append((doc_id, leaf, tampered, *proofs[0, idx]))
        yield ready, out


def _proofs_of(floor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ready, _ in _descend(batches, floor):
            if ready:
                rows = [(grp, floor, idx, *p) for (grp, idx), p in ready.items()]
                types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["grp", "level", "idx", "proof", "subroot", "root"])

    return run


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and its siblings give; a proof has `left,right` for each level, from below, split by `;`."""
    for step in proof.split(";") if proof else ():
        left, right = step.split(",")
        leaf = _hash(left, leaf, right)
    return leaf


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "proof"]
    for _, rows in _descend(batches, -1):
        if rows:
            out = [(doc_id, leaf, subroot, root, _hash(proof.replace(",", "").replace(";", "")), fold(tampered, proof), proof) for doc_id, leaf, tampered, proof, subroot, root in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.string()) for k, c in enumerate(zip(*out, strict=True))], names)


def _frame(level: int, tree: DataFrame, given: DataFrame, leaves: DataFrame | None) -> DataFrame:
    """Rows of the blocks whose inner nodes lie in the STRIDE levels above level: given proofs, nodes and, at level 0, leaves."""
    top = level + STRIDE
    block = lambda at: F.expr(f"idx div {ARITY**STRIDE}") if at is None else F.floor(F.col("idx") / _power(F.lit(top) - at))
    null = lambda *names: [F.lit(None).cast("long" if c == "doc_id" else "array<string>" if c == "kids" else "string").alias(c) for c in names]
    lv = F.col("level")
    rows = given.where(lv.between(level, top)).select("grp", block(lv).alias("block"), F.lit(0).alias("kind"), "level", "idx", *null("kids"), "proof", "subroot", "root", *null("doc_id", "leaf", "tampered"))
    inner = tree.where((lv > level) & (lv <= top))
    rows = rows.unionByName(inner.select("grp", block(lv).alias("block"), F.lit(1).alias("kind"), "level", "idx", "kids", *null("proof", "subroot", "root", "doc_id", "leaf", "tampered")))
    if leaves is not None:
        rows = rows.unionByName(leaves.select("grp", block(None).alias("block"), F.lit(2).alias("kind"), F.lit(0).alias("level"), "idx", *null("kids", "proof", "subroot", "root"), "doc_id", "leaf", "tampered"))
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", F.desc("level"), "kind", "idx")


def _given(level: int, tree: DataFrame, tops: DataFrame, highest: int) -> DataFrame:
    """Proofs for the frame above level: of groups whose top lies in it and, from the frames above, of nodes of its upper edge."""
    given = tops
    for at in range((highest - 1) // STRIDE * STRIDE if highest else 0, level, -STRIDE):
        given = tops.unionByName(common.stored(_frame(at, tree, given, None).mapInArrow(_proofs_of(at), _PROOF), "proofs"))
    return given


def _top_level(n: Column) -> Column:
    """Levels above the leaves of a group of n."""
    level = F.lit(0)
    for k in range(39):
        level = level + (n > F.lit(ARITY**k)).cast("int")
    return level


def _highest(rows: DataFrame) -> int:
    return rows.agg(F.max(_top_level(F.col("n")))).first()[0] or 0


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof of every row of docs.

    Columns other than doc_id, source, lang, n_chars and text are not looked at, whatever their names, but for a column
    `changed`, which the registered query puts there: the text whose leaf is folded; by default the text itself.
    Leaves of a source ascend by doc_id (null first), equal ids by their leaf; equal rows have equal leaves, so their order does
    not show. A null source is a group of its own, ahead of all others. An empty table has no root and gives no rows. Texts
    of any length are hashed where they are read; no text is shuffled.
    """
    changed = docs["changed"] if "changed" in docs.columns else docs["text"]
    fixed = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    grp = F.when(docs["source"].isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), docs["source"].cast("string")))
    hashed = docs.select(grp.alias("grp"), docs["doc_id"].cast("long").alias("doc_id"), digest(*fixed, docs["text"]).alias("leaf"), digest(*fixed, changed).alias("tampered"))
    leaves = common.stored(common.indexed(common.stored(hashed, "hashed"), "grp", ["doc_id", "leaf"]), "leaves")
    tree = nodes(leaves.withColumnRenamed("leaf", "digest"))

    lone = leaves.where("n = 1").select("grp", F.lit(0).alias("level"), F.col("leaf").alias("digest"))
    subroots = common.stored(tree.where(F.col("level") == _top_level(F.col("n"))).select("grp", "level", "digest").unionByName(lone), "subroots")
    groups = common.stored(common.indexed(subroots.select(F.lit("").alias("all"), "grp", "level", "digest"), "all", ["grp"]), "groups")
    forest = nodes(groups.select(F.lit("").alias("grp"), "n", "idx", "digest"))
    crown = forest.where(F.col("level") == _top_level(F.col("n"))).select("digest").unionByName(groups.where("n = 1").select("digest"))
    above = crown.select(F.lit("").alias("grp"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), F.lit("").alias("proof"), F.lit(0).cast("long").alias("idx"))
    highest = _highest(groups)
    above = common.stored(above.withColumn("level", F.lit(highest)).select("grp", "level", "idx", "proof", "subroot", "root"), "proofs")
    of_groups = _given(0, forest, above, highest)
    if highest:
        of_groups = common.stored(_frame(0, forest, of_groups, None).mapInArrow(_proofs_of(0), _PROOF), "proofs")
    named = of_groups.select(F.col("idx").alias("at"), "proof", "root")
    tops = groups.join(named, groups["idx"] == named["at"]).select(groups["grp"], groups["level"], F.lit(0).cast("long").alias("idx"), "proof", groups["digest"].alias("subroot"), "root")
    tops = common.stored(tops, "tops")

    given = _given(0, tree, tops, _highest(leaves))
    out = _frame(0, tree, given, leaves).mapInArrow(_verify, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, proof string")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "proof")


def audit(docs: DataFrame) -> DataFrame:
    """The registered query: texts of documents whose crc32(doc_id) is even lose their line feeds before their leaf is folded.
    A row without a doc_id is not tampered with."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    base = docs.select("doc_id", "source", "lang", "n_chars", "text", F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text")).alias("changed"))
    return manifest(base).drop("proof")
