"""Line dedup by a segment-partition edit join.

Lines are split, hashed and reduced to distinct texts once, so a line that very many documents share is keyed once. A line
is cut into one segment more than edits are allowed. If two lines are within that many edits, at least one segment of
the shorter (or equally long) one occurs unchanged in the other, near its own place. Segments are index keys made
of length, number and content; every line probes, for each length that a partner may have, the substrings at the places
to which a segment can have moved. Index and probe rows meet by key. Blocks of lines that met are first compared
by their counts of letters, without texts; the pairs that these do not rule out get their texts and are verified with banded
bit-parallel edit distance, many pairs at a time.

A line goes if its text occurred before, in order of doc_id and place, or if it is linked to a different text that did.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlink.llm import common

#: Edits between linked lines, and the least length of lines that are compared by more than equality.
TAU, MIN_LENGTH = 2, 20
#: Edits by the length of the shorter line: (least length, edits), ascending. What the query uses, and the plain rule.
SCALED, PLAIN = ((10, 1), (20, 2)), ((MIN_LENGTH, TAU),)
#: Lines of a block of a key's group; two blocks meet in one task.
BLOCK = 4096
_BINS = 32
Steps = tuple[tuple[int, int], ...]


def exploded(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no, text, line, check: a row a line; lines are what line feeds part, named by two 64-bit hashes."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "text"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text", F.xxhash64("text").alias("line"), F.xxhash64(F.lit("check"), F.col("text")).alias("check"))


def allowed(length: Column, steps: Steps) -> Column:
    """Edits allowed between two lines of which the shorter one has this length."""
    out = F.lit(0)
    for least, edits in steps:
        out = F.when(length >= least, F.lit(edits)).otherwise(out)
    return out


def segment(length: Column, number: int, tau: int) -> tuple[Column, Column]:
    """(begin, length) of a segment; the last ones are longer by one where it does not come out even."""
    base, extra = F.floor(length / (tau + 1)).cast("int"), (length % (tau + 1)).cast("int")
    ahead = F.greatest(F.lit(0), F.lit(number - tau - 1) + extra)
    return base * number + ahead, base + F.when(F.lit(number) >= F.lit(tau + 1) - extra, 1).otherwise(0)


def _slots(text: Column, n: Column, tau: int) -> list[tuple[int, Column]]:
    """(how much shorter the other line is, key) of a line's own segments, and of the substrings that can match segments
    of lines that are 0 to tau shorter. With d the difference in length, segment i (from 0) of the other line may have moved
    by -i..i from the left and by d-(tau-i)..d+(tau-i) counted from the right end. The lowest bit of a key is 0 for own segments."""
    out = []
    for d in range(tau + 1):
        for i in range(tau + 1):
            begin, size = segment(n - d, i, tau)
            for shift in range(max(-i, d - (tau - i)), min(i, d + (tau - i)) + 1):
                key = F.xxhash64(F.lit(i), n - d, F.substring(text, begin + (shift + 1), size))
                out.append((d, key.bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(0 if d == 0 and shift == 0 else 1))))
    return out


def line_keys(lines: DataFrame, steps: Steps) -> DataFrame:
    """line, key: the index and probe rows of different lines (line, text)."""
    n = F.length("text")
    top = max(edits for _, edits in steps)
    always = [key for _, key in _slots(F.col("text"), F.col("n"), top)]
    mixed = [F.when(allowed(F.col("n") - d, steps) == tau, key) for tau in sorted({edits for _, edits in steps}) for d, key in _slots(F.col("text"), F.col("n"), tau)]
    keys = F.when(F.col("n") >= steps[-1][0] + top, F.array(*always)).otherwise(F.array(*mixed))
    return lines.select("line", "text", n.alias("n")).where(F.col("n") >= steps[0][0]).select("line", F.explode(keys).alias("key")).where("key is not null")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, line) sorted by key, so that a group's index rows come first: those of groups with an index row and a
    second line. From one batch to the next only the first row of the open group is carried over."""
    carried: tuple[int, int, bool] | None = None
    for batch in batches:
        key, line = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        if carried:
            key, line = np.append(carried[0], key), np.append(carried[1], line)
        names = key >> 1
        new = np.ones(len(key), bool)
        new[1:] = names[1:] != names[:-1]
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        met = np.bincount(group, line != line[first[group]], minlength=len(first)) > 0
        passed = bool(carried and carried[2])
        met[0] |= passed
        met &= (key[first] & 1) == 0
        keep = met[group]
        keep[0] &= not passed
        carried = (key[first[-1]], line[first[-1]], bool(met[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(names[keep]), pa.array(line[keep]), pa.array((key[keep] & 1) == 0)], names=["key", "line", "index"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the length and the counts of letters, by code point modulo _BINS, each up to 255."""
    for batch in batches:
        bags, sizes = [], []
        for text in batch.column(2).to_pylist():
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            bags.append(np.minimum(np.bincount(points % _BINS, minlength=_BINS), 255).astype(np.uint8).tobytes())
            sizes.append(len(points))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(bags, pa.binary())], names=[*batch.schema.names, "n", "bag"])


#: Cells of the padded arrays of one batch of pairs.
_CELLS = 4 << 20


def banded_distances(a: list[np.ndarray], b: list[np.ndarray], tau: int = TAU) -> np.ndarray:
    """Edit distances of pairs of code point arrays, tau + 1 where larger.

    Bit-parallel in the band of diagonals -tau..tau: word e holds, as bits, the diagonals that can be reached
    with e edits. One symbol of b at a time is taken in, for all pairs in step; pairs whose band is empty drop out.
    """
    out = np.full(len(a), tau + 1, np.int64)
    close = [k for k in range(len(a)) if abs(len(a[k]) - len(b[k])) <= tau]
    close.sort(key=lambda k: len(b[k]))
    at = 0
    while at < len(close):
        size = 1
        while at + size < len(close) and (size + 1) * (len(b[close[at + size]]) + 2 * tau + 1) <= _CELLS:
            size += 1
        part = np.array(close[at : at + size])
        out[part] = _in_step([a[k] for k in part], [b[k] for k in part], tau)
        at += size
    return out


def _in_step(a: list[np.ndarray], b: list[np.ndarray], tau: int) -> np.ndarray:
    n, width = len(a), 2 * tau + 1
    len_a, len_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    steps = int(len_b.max())
    side = np.zeros((n, steps + width), np.uint32)  # a behind tau blanks: column c + i is the symbol on diagonal i - tau
    top = np.zeros((n, steps), np.uint32)
    for k in range(n):
        side[k, tau : tau + len_a[k]] = a[k].astype(np.uint32) + 1
        top[k, : len_b[k]] = b[k].astype(np.uint32) + 1
    mask = (1 << width) - 1
    words = [np.full(n, sum(1 << (tau + i) for i in range(e + 1)) & mask, np.int64) for e in range(tau + 1)]
    goal = 1 << (len_a - len_b + tau)
    out, live = np.full(n, tau + 1, np.int64), np.arange(n)
    for c in range(steps + 1):
        done = len_b[live] == c
        if done.any():
            for e in range(tau, -1, -1):
                hit = done & ((words[e] & goal[live]) > 0)
                out[live[hit]] = e
        if done.any() or c % 16 == 0:
            stay = ~done & (words[tau] > 0)
            live, words = live[stay], [w[stay] for w in words]
            if not len(live):
                break
        symbol, match = top[live, c], np.zeros(len(live), np.int64)
        for i in range(width):
            match |= (side[live, c + i] == symbol).astype(np.int64) << i
        new = [words[0] & match]
        for e in range(1, tau + 1):
            new.append((words[e] & match) | words[e - 1] | (words[e - 1] >> 1) | ((new[e - 1] << 1) & mask))
        words = new
    return out


def _steps_of(lengths: np.ndarray, steps: Steps) -> np.ndarray:
    out = np.zeros(len(lengths), np.int64)
    for least, edits in steps:
        out[lengths >= least] = edits
    return out


def _near_bags(steps: Steps):
    """Rows (key, i, j, block, line, check, index, n, bag) sorted by (key, i, j): pairs of different lines, one of them by an index
    row, whose counts of letters do not rule them out: an edit moves at most two counts by one each."""

    def of_group(c: list[np.ndarray], bags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, i, j, block, line, check, index, n = c
        own, others = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
        left, right = [], []
        for x in own:
            y = others[others > x] if i[0] == j[0] else others
            y = y[(index[y] | index[x]) & ((line[y] != line[x]) | (check[y] != check[x]))]
            if len(y):
                tau = _steps_of(np.minimum(n[y], n[x]), steps)
                y = y[(np.abs(n[y] - n[x]) <= tau) & (np.abs(bags[y] - bags[x]).sum(1) <= 2 * tau) & (tau > 0)]
                left.append(np.full(len(y), x))
                right.append(y)
        none = np.zeros(0, np.int64)
        return (np.concatenate(left), np.concatenate(right)) if left else (none, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.Table | None = None

        def pairs(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            c = [table.column(k).to_numpy() for k in range(8)]
            bags = np.frombuffer(b"".join(table.column(8).to_pylist()), np.uint8).reshape(-1, _BINS).astype(np.int16)
            new = np.flatnonzero(np.concatenate([[True], (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])]))
            left, right = [], []
            for low, high in zip(new, np.append(new[1:], len(c[0])), strict=True):
                x, y = of_group([v[low:high] for v in c], bags[low:high])
                left.append(x + low)
                right.append(y + low)
            x, y = np.concatenate(left), np.concatenate(right)
            turn = (c[4][x] > c[4][y]) | ((c[4][x] == c[4][y]) & (c[5][x] > c[5][y]))
            x, y = np.where(turn, y, x), np.where(turn, x, y)
            got = np.unique(np.stack([c[4][x], c[5][x], c[4][y], c[5][y]], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(got[:, k]) for k in range(4)], names=["line_a", "check_a", "line_b", "check_b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if open_ is not None:
                table = pa.concat_tables([open_, table])
            last = [table.column(k)[-1].as_py() for k in range(3)]
            whole = table.num_rows
            heads = [table.column(k).to_numpy() for k in range(3)]
            while whole and all(heads[k][whole - 1] == last[k] for k in range(3)):
                whole -= 1
            if whole:
                yield pairs(table.slice(0, whole))
            open_ = table.slice(whole)
        if open_ is not None:
            yield pairs(open_)

    return run


def _verified(steps: Steps):
    """Of the pairs (line_a, check_a, line_b, check_b, text_a, text_b) those within the edits that the shorter line allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in batch.column(k).to_pylist()] for k in (4, 5))
            tau = _steps_of(np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64), steps)
            good = np.zeros(len(a), bool)
            for t in np.unique(tau[tau > 0]):
                at = np.flatnonzero(tau == t)
                good[at] = banded_distances([a[k] for k in at], [b[k] for k in at], int(t)) <= t
            keep = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(keep) for k in range(4)], names=["line_a", "check_a", "line_b", "check_b"])

    return run


def links(lines: DataFrame, steps: Steps = PLAIN) -> DataFrame:
    """line_a, check_a, line_b, check_b: all pairs of different line texts within the allowed edits, once each.

    lines: different lines (line, check, text). Of the keys only those at which an index row meets another line go on,
    and only their lines get counts of letters; texts go to nothing but the pairs that these leave.
    """
    keyed = line_keys(lines, steps)
    met = keyed.select("key", "line").repartition(F.shiftright("key", 1)).sortWithinPartitions("key").mapInArrow(_met, "key long, line long, index boolean")
    met = common.stored(met.groupBy("key", "line").agg(F.max("index").alias("index")), "line-groups")
    blocks = met.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    involved = common.small(common.stored(met.select("line").distinct(), "met-lines"))
    texts = common.stored(lines.select("line", "check", "text").join(involved, "line", "left_semi").mapInArrow(_bags, "line long, check long, text string, n int, bag binary"), "met-texts")
    rows = met.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "line", "index").join(texts.drop("text"), "line").select("key", "i", "j", "block", "line", "check", "index", "n", "bag")
    ends = "line_a long, check_a long, line_b long, check_b long"
    near = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_near_bags(steps), ends).distinct()
    side = lambda k: texts.select(F.col("line").alias(f"line_{k}"), F.col("check").alias(f"check_{k}"), F.col("text").alias(f"text_{k}"))
    pairs = near.join(side("a"), ["line_a", "check_a"]).join(side("b"), ["line_b", "check_b"])
    return pairs.select("line_a", "check_a", "line_b", "check_b", "text_a", "text_b").mapInArrow(_verified(steps), ends)


def judged_lines(docs: DataFrame, steps: Steps = PLAIN) -> DataFrame:
    """doc_id, line_no, line, check, copies, repeated, similar, n_links of every line.

    repeated: its text occurred before; similar: its text is new, but linked to a different one that occurred before.
    """
    lines = exploded(docs)
    spots = common.stored(lines.drop("text"), "lines")
    texts = common.stored(lines.groupBy("line", "check", "text").agg(F.count(F.lit(1)).alias("copies")), "line-texts")
    pairs = common.stored(links(texts, steps), "line-links")
    names = ["line", "check"]
    side = lambda k: pairs.select(F.col(f"line_{k}").alias("line"), F.col(f"check_{k}").alias("check"))
    linked = side("a").unionByName(side("b")).groupBy(*names).agg(F.count(F.lit(1)).alias("n_links"))
    # Only lines that repeat or have links need their first place: all others are new and keep.
    notable = common.stored(texts.where("copies > 1").select(*names, "copies").join(linked, names, "full").select(*names, F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "notable-lines")
    firsts = spots.join(common.small(notable), names).groupBy(*names).agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.first("copies").alias("copies"), F.first("n_links").alias("n_links"))
    firsts = common.stored(firsts, "first-lines")
    at = lambda k: common.small(firsts.where("n_links > 0").select(F.col("line").alias(f"line_{k}"), F.col("check").alias(f"check_{k}"), F.col("first").alias(f"first_{k}")))
    placed = pairs.join(at("a"), ["line_a", "check_a"]).join(at("b"), ["line_b", "check_b"])
    a_late = F.col("first_b") < F.col("first_a")
    late = placed.select(F.when(a_late, F.col("line_a")).otherwise(F.col("line_b")).alias("line"), F.when(a_late, F.col("check_a")).otherwise(F.col("check_b")).alias("check")).distinct().withColumn("late", F.lit(True))
    marked = common.small(common.stored(firsts.join(late, names, "left"), "judged-texts"))
    out = spots.join(marked, names, "left")
    new = F.coalesce((F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("first.line_no") == F.col("line_no")), F.lit(True)) | F.col("first").isNull()
    return out.select("doc_id", "line_no", *names, F.coalesce("copies", F.lit(1)).alias("copies"), (~new).alias("repeated"), (new & F.coalesce("late", F.lit(False))).alias("similar"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def dedup_lines(docs: DataFrame, steps: Steps = PLAIN) -> DataFrame:
    """doc_id, n_lines, n_repeated, n_similar, n_kept, n_links for every document.

    Lines are what line feeds part, compared as they are; null text is one empty line; bytes that are not UTF-8 count
    as U+FFFD. Lines shorter than the first of the steps are only compared for equality. n_links sums, over the document's
    lines, the different texts linked to each. Nulls sort first as doc_id and share one result row; rows that repeat
    a doc_id are one document whose lines of the same number count separately; an empty table gives an empty result.
    """
    lines = judged_lines(docs, steps)
    count = lambda c: F.count_if(c).alias
    out = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), count(F.col("repeated"))("n_repeated"), count(F.col("similar"))("n_similar"), count(~F.col("repeated") & ~F.col("similar"))("n_kept"), F.sum("n_links").cast("long").alias("n_links"))
    return out


def clean_lines(docs: DataFrame, steps: Steps = PLAIN) -> DataFrame:
    """The documents with repeated and similar lines taken out, null texts left as they are.

    A line is told by doc_id, number and text, so rows that share a doc_id lose only lines of their own; what two wholly equal
    rows have in common stays in both.
    """
    gone = judged_lines(docs, steps).where("repeated or similar").select("doc_id", "line_no", "line", "check").distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("whole"))
    hit = exploded(rows.select(F.struct("doc_id", "whole").alias("doc_id"), "text")).select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.whole").alias("whole"), "line_no", "line", "check").distinct()
    same = [F.col("h.doc_id").eqNullSafe(F.col("g.doc_id")), *[F.col(f"h.{c}") == F.col(f"g.{c}") for c in ("line_no", "line", "check")]]
    drop = hit.alias("h").join(gone.alias("g"), same, "left_semi").groupBy("doc_id", "whole").agg(F.collect_set("line_no").alias("gone"))
    joined = rows.alias("r").join(drop.alias("d"), F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")) & F.col("r.whole").eqNullSafe(F.col("d.whole")), "left")
    numbered = F.filter(F.transform(F.split("r.text", "\n", -1), lambda x, i: F.struct(x.alias("x"), F.array_contains("d.gone", i.cast("long")).alias("gone"))), lambda x: ~x["gone"])
    text = F.when(F.col("d.gone").isNull(), F.col("r.text")).otherwise(F.array_join(F.transform(numbered, lambda x: x["x"]), "\n"))
    return joined.select(*[text.alias("text") if c == "text" else F.col("r.row")[c].alias(c) for c in docs.columns])
