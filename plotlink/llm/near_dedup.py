"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct 5-word shingles. Its sketch has one register for each of 128 buckets of the
hash space: the count of leading zeros of the bucket's least hash and ten mantissa bits, 16 bits in all. Bands of
four registers (empty ones borrow another's, in a fixed order) are the candidate keys. Sets that fill few buckets have as
many registers again, each the least of all their hashes under a salt of its own, compressed in the same way.

Copies with the same set collapse to one class first. In each band bucket every class is then paired with one
leader only; the estimate from the registers, corrected for chance collisions, picks the most promising leaders,
the pairs are confirmed on full sets, and components are formed. What is left are buckets that still hold several
components: only there do blocks meet, with their texts, of members outside the bucket's largest component with each
other and with those inside, and pairs of different components that the estimate does not rule out are confirmed on
full sets in the same task, which passes on nothing but links. So a large group costs in proportion to its size, but
for members that lie apart, and no link between components is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlink.llm import common, textkernel
from plotlink.llm.components import components

SHINGLE_WORDS = 5
LINK_PERCENT = 85
BUCKETS_LOG2, MANTISSA_BITS = 7, 10
BUCKETS = 1 << BUCKETS_LOG2
BANDS, BAND_REGISTERS = 16, 4
#: Sets up to this size get as many bands again, of salted registers: few buckets of theirs are filled.
SMALL_SET = 64
#: Standard errors of the estimate that a pair may lie below the threshold and still be confirmed.
MARGIN = 4.0
#: How far below the threshold an estimate may lie for the pair to be tried in the first step.
NEAR = 0.03
#: Leaders of a class whose pairs are confirmed before components are first formed.
LEADERS = 2
#: Members of a block of a bucket; two blocks meet in one task.
BLOCK = 512

_PROBES = np.stack([np.concatenate([[2 * i], np.random.RandomState(i).permutation(BUCKETS)]) for i in range(BANDS * BAND_REGISTERS)])
_SALTS = textkernel.mix64(np.arange(1, BANDS * BAND_REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _fold(groups: np.ndarray, first: int) -> np.ndarray:
    """One key for each band from its values; the band's number is part of the key."""
    n = groups.shape[1]
    out = np.empty(groups.shape[:2], np.uint64)
    for b in range(n):
        x = np.full(len(groups), first + b + 1, np.uint64)
        for j in range(groups.shape[2]):
            x = textkernel.mix64(x * np.uint64(0x9E3779B97F4A7C15) + groups[:, b, j].astype(np.uint64))
        out[:, b] = x
    return out


def compressed(values: np.ndarray, used_bits: int = 0) -> np.ndarray:
    """Registers of hashes whose leading used_bits are spent: the count of leading zeros and the bits behind the first one."""
    mantissa, exponent = np.frexp((values << np.uint64(used_bits)).astype(np.float64))
    zeros = np.minimum(64 - exponent, 62)
    return ((zeros << MANTISSA_BITS) + np.maximum(0, (2 * mantissa - 1) * (1 << MANTISSA_BITS)).astype(np.int64) + 1).astype(np.uint16)


def sketch(values: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Registers (rows x BUCKETS, 0: empty) and band keys of sets given as ascending hashes by row."""
    n = len(sizes)
    registers = np.zeros((n, BUCKETS), np.uint16)
    if len(values):
        bucket = (values >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)
        cell = rows * BUCKETS + bucket
        lead = np.ones(len(cell), bool)
        lead[1:] = cell[1:] != cell[:-1]  # ascending, so a cell's first value is its least
        registers.reshape(-1)[cell[lead]] = compressed(values[lead], BUCKETS_LOG2)
    filled = registers[:, _PROBES[:, 0]]
    r, p = np.nonzero((filled == 0) & (sizes > 0)[:, None])
    for t in range(1, BUCKETS + 1):
        if not len(r):
            break
        filled[r, p] = registers[r, _PROBES[p, t]]
        open_ = filled[r, p] == 0
        r, p = r[open_], p[open_]
    keys = _fold(filled.reshape(n, BANDS, BAND_REGISTERS), 0)
    out: list[np.ndarray] = [keys[i] if sizes[i] else keys[i][:0] for i in range(n)]
    few = np.flatnonzero((sizes > 0) & (sizes <= SMALL_SET))
    if len(few):
        starts = np.concatenate([[0], np.cumsum(sizes)])
        take = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in few])
        cuts = np.concatenate([[0], np.cumsum(sizes[few])[:-1]])
        least = np.stack([compressed(np.minimum.reduceat(textkernel.mix64(values[take] ^ s), cuts)) for s in _SALTS], axis=1)
        more = _fold(least.reshape(len(few), BANDS, BAND_REGISTERS), BANDS)
        for i, k in zip(few, more, strict=True):
            out[i] = np.concatenate([out[i], k])
    return registers, out


def text_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, distinct shingle hashes, their rows, set sizes) for pieces of a column."""
    for at, to, raw, offsets in textkernel.pieces(column):
        hashes, _, _, counts = textkernel.words(raw, offsets)
        yield at, to, *textkernel.distinct_sorted(*textkernel.shingles(hashes, counts, SHINGLE_WORDS), to - at)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, carried columns, text)."""
    for batch in batches:
        kept = batch.columns[:-1]
        for at, to, values, rows, sizes in text_sets(batch.columns[-1]):
            ends = np.cumsum(sizes)

            def total(x: np.ndarray, ends=ends, sizes=sizes) -> np.ndarray:
                run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                return (run[ends] - run[ends - sizes]).view(np.int64)

            registers, keys = sketch(values, rows, sizes)
            yield pa.RecordBatch.from_arrays(
                [*[c[at:to] for c in kept], pa.array(sizes.astype(np.int64)), pa.array(total(values)), pa.array(total(textkernel.mix64(values ^ np.uint64(0x5851F42D4C957F2D)))), pa.array([x.tobytes() for x in registers], pa.binary()), pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64()))],
                names=[*batch.schema.names[:-1], "n_shingles", "set_a", "set_b", "registers", "keys"],
            )


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimate of paired registers, and how many registers it rests on.

    Two different least values share a register with probability 2^-q / (2 ln 2) * nm / (n + m)^2: the mean
    width of a cell against its place, times the chance that both fall into it. That share is taken off.
    """
    used = ((a > 0) | (b > 0)).sum(-1)
    same = ((a == b) & (a > 0)).sum(-1) / np.maximum(used, 1)
    n_a, n_b = n_a.astype(float), n_b.astype(float)
    chance = 0.5 / np.log(2) * 2.0**-MANTISSA_BITS * n_a * n_b / np.maximum(n_a + n_b, 1) ** 2
    return np.clip((same - chance) / (1 - chance), 0, 1), used


def _promising(a, b, n_a, n_b, percent: int) -> np.ndarray:
    got, used = estimate(a, b, n_a, n_b)
    t = percent / 100
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sizes & (got >= t - MARGIN * np.sqrt(t * (1 - t) / np.maximum(used, 1)))


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _rate_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            a, b, n_a, n_b = _registers(c["r_a"]), _registers(c["r_b"]), c["n_a"].to_numpy(), c["n_b"].to_numpy()
            keep = np.flatnonzero(_promising(a, b, n_a, n_b, percent))
            rate = estimate(a[keep], b[keep], n_a[keep], n_b[keep])[0]
            yield pa.RecordBatch.from_arrays([c["a"].take(pa.array(keep)), c["b"].take(pa.array(keep)), pa.array(rate)], names=["a", "b", "rate"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _cross_links(percent: int):
    """Rows sorted by (key, i, j): links between different components of a pair of blocks, confirmed on full sets.

    A pair is looked at where its first common key brings it, if the estimate does not rule it out and no link
    found here has joined the two components yet.
    """

    def links(group: list[tuple]) -> Iterator[tuple[int, int]]:
        key, i, j = group[0][:3]
        block, ids, comp, n = (np.array([g[k] for g in group]) for k in (3, 4, 5, 6))
        regs = np.frombuffer(b"".join(g[7] for g in group), np.uint16).reshape(-1, BUCKETS)
        keys = [g[8] for g in group]
        sets: dict[int, np.ndarray] = {}

        def of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = next(_split(pa.array([group[k][9]], pa.large_string())))
            return sets[k]

        for x in np.flatnonzero(block == i):
            y = np.flatnonzero((block == j) & (comp != comp[x]) & ((ids > ids[x]) if i == j else True))
            y = y[_promising(regs[x][None], regs[y], n[x : x + 1], n[y], percent)] if len(y) else y
            for z in y:
                if comp[x] == comp[z] or next(k for k, both in enumerate(zip(keys[x], keys[z], strict=False)) if both[0] == both[1]) != keys[x].index(key):
                    continue
                if _linked(of(x), of(z), percent):
                    yield (int(ids[x]), int(ids[z]))
                    comp[comp == comp[z]] = comp[x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        found: list[tuple[int, int]] = []

        def out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            found.clear()
            return done

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    found.extend(links(group))
                    group = []
                group.append(row)
            yield out()
        if group:
            found.extend(links(group))
        yield out()

    return run


def _confirm(percent: int):
    """Keep pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            ids = c["a"].to_numpy()
            fresh = np.ones(len(ids), bool)
            fresh[1:] = ids[1:] != ids[:-1]
            sets_a = _split(c["t_a"].take(pa.array(np.flatnonzero(fresh))))
            mine, good = np.zeros(0, np.uint64), []
            for k, other in enumerate(_split(c["t_b"])):
                mine = next(sets_a) if fresh[k] else mine
                good.append(_linked(mine, other, percent))
            keep = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([c["a"].take(keep), c["b"].take(keep)], names=["a", "b"])

    return run


def _split(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's set; those of one piece are there at once."""
    for _, _, values, _, sizes in text_sets(column):
        yield from np.split(values, np.cumsum(sizes)[:-1])


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    left = texts.select(F.col("id").alias("b"), F.col("text").alias("t_b"))
    right = texts.select(F.col("id").alias("a"), F.col("text").alias("t_a"))
    return pairs.select("a", "b").join(left, "b").join(right, "a").select("a", "b", "t_a", "t_b").mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, *, percent: int = LINK_PERCENT, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document, and the carried columns.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of distinct 5-word
    shingles (A-Z lower-cased; fewer than five words: the whole sequence). Null text and text without words have
    an empty set, are linked with nothing and kept. component_id is the least doc_id reachable, kept says that it
    is the row's own. Rows that repeat a doc_id count as one document that has the links of each; a null doc_id
    takes no part in links between different sets, has the component of its equals and else null, and is kept
    only then. Copies are collapsed by the size and two independent 64-bit sums of their set's hashes.
    """
    carry = carry or []
    narrow = docs.select("doc_id", *carry, "text")
    types = "".join(f"`{n}` {t}, " for n, t in narrow.dtypes[1:-1])
    sketches = narrow.mapInArrow(_sketches, f"doc_id long, {types}n_shingles long, set_a long, set_b long, registers binary, keys array<long>")
    sketches = common.stored(sketches, "sketches")
    same = ["n_shingles", "set_a", "set_b"]
    classes = common.stored(sketches.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    own = sketches.where("n_shingles > 0").join(classes.where("copies > 1").select(*same, "rep"), same, "left")
    heads = common.stored(own.where(F.col("doc_id") == F.coalesce("rep", "doc_id")).select(F.col("doc_id").alias("id"), *same, "registers", "keys").dropDuplicates(["id", *same]), "heads")

    keyed = heads.select("id", "set_a", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct(F.xxhash64("id", "key"), "id")).alias("lead")).where("members > 1").select("key", "members", F.col("lead.id").alias("leader"))
    members = common.stored(keyed.join(buckets, "key"), "members")
    involved = members.select("id").distinct()
    # Never broadcast: the ids grow with the corpus.
    texts = common.stored(docs.select(F.col("doc_id").alias("id"), "text").join(involved.hint("merge"), "id", "left_semi"), "texts")

    sides = heads.select("id", F.col("n_shingles").alias("n"), "registers")
    stars = members.where("id <> leader").select(F.col("id").alias("b"), F.col("leader").alias("a")).distinct()
    rated = stars.join(sides.toDF("b", "n_b", "r_b"), "b").join(sides.toDF("a", "n_a", "r_a"), "a").select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(_rate_pairs(percent), "a long, b long, rate double")
    rated = rated.where(F.col("rate") >= percent / 100 - NEAR)
    best = F.slice(F.sort_array(F.collect_list(F.struct("rate", "a")), asc=False), 1, LEADERS)  # a class has one leader for each of its keys
    tried = rated.groupBy("b").agg(best.alias("best")).select("b", F.explode("best.a").alias("a"))
    near = common.stored(_confirmed(tried, texts, percent), "links")
    comp = common.stored(components(near), "components")

    placed = members.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", "set_a", F.coalesce("component", "id").alias("component"))
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("components"), F.sum("n").alias("members"), F.max(F.struct("n", "component")).alias("major")).where("components > 1")
    # Members of the largest component need not meet each other: their blocks come after those of all others.
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select("key", F.col("major.component").alias("major"), blocks(F.col("members") - F.col("major.n")).alias("minor_blocks"), blocks(F.col("major.n")).alias("major_blocks"))
    inside = F.col("component") == F.col("major")
    place = F.xxhash64("id")
    rows = placed.join(mixed, "key").withColumn("block", F.when(inside, F.col("minor_blocks") + F.pmod(place, F.col("major_blocks"))).otherwise(F.pmod(place, F.col("minor_blocks"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(inside, F.col("minor_blocks")).otherwise(F.col("minor_blocks") + F.col("major_blocks")) - 1)
    rows = rows.withColumn("other", F.explode(others)).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "set_a", "component")
    rows = rows.join(heads, ["id", "set_a"]).join(texts, "id").select("key", "i", "j", "block", "id", "component", F.col("n_shingles").alias("n"), "registers", "keys", "text")
    far = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_cross_links(percent), "a long, b long")
    comp = common.stored(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(far)), "components")

    whole = sketches.select("doc_id", *carry, *same).join(classes.where("copies > 1").select(*same, "rep"), same, "left").select("doc_id", *carry, "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    out = whole.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), *carry)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *carry)


def drop_near_duplicates(docs: DataFrame, *, percent: int = LINK_PERCENT) -> DataFrame:
    """The documents that stay, with all their columns: of each component the one with the least doc_id, and rows without
    words or without an id.

    Rows take part by what they hold, not by their doc_id: of rows that share one and are no copies of each other all stay, of
    wholly equal rows one does.
    """
    h1, h2 = common.row_hashes(docs)
    rows = docs.select(h1.alias("doc_id"), docs["doc_id"].alias("k_id"), h2.alias("h2"), docs["text"].alias("text"))
    judged = near_duplicates(rows, percent=percent, carry=["k_id", "h2"]).select(F.col("doc_id").alias("h1"), "h2", "k_id", "n_shingles", "component_id")
    judged = common.stored(judged.where("n_shingles > 0 and k_id is not null"), "near-judged")
    keepers = judged.groupBy("component_id").agg(F.min(F.struct("k_id", "h1", "h2")).alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    grouped = judged.join(keepers.drop("n"), "component_id")
    dropped = grouped.where("h1 <> keeper.h1 or h2 <> keeper.h2")
    twice = grouped.where("h1 = keeper.h1 and h2 = keeper.h2").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return common.without_rows(docs, common.stored(dropped.select("h1", "h2").distinct(), "near-dropped"), twice)
