"""The Merkle manifest against a plain tree, and what tampering shows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from plotlink.llm import merkle
from tests.llm.test_llm import make


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def cell(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(level):
    """For each leaf its siblings from below, and the top."""
    proofs, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, place in enumerate(at):
            begin = place // 3 * 3
            proofs[k].append((level[begin:place], level[place + 1 : begin + 3]))
            at[k] = place // 3
        level = [sha(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return proofs, level[0]


def plain(rows):
    groups = defaultdict(list)
    for i, text, lang, source in rows:
        cut = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        n = len(text) if text is not None else None
        head = [cell(v) for v in (i, source, lang, n)]
        groups[source].append((i is not None, i or 0, sha(*head, cell(text)), sha(*head, cell(cut))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    each = {s: tree([leaf for *_, leaf, _ in sorted(groups[s])]) for s in order}
    above, root = tree([each[s][1] for s in order])
    out = Counter()
    for s, upper in zip(order, above, strict=True):
        for (known, i, leaf, cut), lower in zip(sorted(groups[s]), each[s][0], strict=True):
            for left, right in lower + upper:
                cut = sha(*left, cut, *right)
            siblings = [d for left, right in lower + upper for d in left + right]
            out[(i if known else None, leaf, each[s][1], root, sha(*siblings), cut, cut == root)] += 1
    return out


def got(spark, rows):
    return Counter(map(tuple, merkle.audit(make(spark, rows)).collect()))


def test_against_a_plain_tree(spark):
    rng = random.Random(3)
    rows = [(i, "a\nb" * rng.randint(0, 3), rng.choice(["en", None]), rng.choice(["web", "web", "web", "bücher", "a", None])) for i in range(2500)]
    rows += [(None, None, None, None), (None, None, None, None), (None, "x\ny", "en", "lone"), (7, "tie", "en", "web"), (7, "tie", "en", "web"), (7, "other", "en", "web"), (9000, "", "", ""), (9001, "long\n" * 100_000, "en", "web")]
    rows += [(10_000 + k, "one each", "en", f"s{k}") for k in range(30)]
    assert got(spark, rows) == plain(rows)


def test_small_tables(spark):
    for n in (0, 1, 4, 28):
        rows = [(i, "line\nline", "en", "web") for i in range(n)]
        assert got(spark, rows) == (plain(rows) if n else Counter())


def test_clashing_names_and_proofs(spark):
    docs = make(spark, [(i, f"t{i}", "en", "ab"[i % 2]) for i in range(40)])
    for c in ("grp", "leaf", "n", "idx", "level", "block", "kind", "digest", "proof", "root", "_row", "tampered"):
        docs = docs.withColumn(c, F.lit("x"))
    rows = merkle.manifest(docs).collect()
    assert len(rows) == 40 and all(r.verified and merkle.fold(r.leaf, r.proof) == r.root for r in rows)
    assert not any(merkle.fold(r.leaf[::-1], r.proof) == r.root for r in rows)


def test_frontiers_of_shuffled_children_meet(spark):
    """Children that come in any order and from any task give the same nodes."""
    leaves = spark.range(2000).select(F.lit("g").alias("grp"), F.lit(2000).cast("long").alias("n"), F.col("id").alias("idx"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"))
    key = lambda df: {(r.level, r.idx): r.digest for r in df.collect()}
    assert key(merkle.nodes(leaves)) == key(merkle.nodes(leaves.repartition(7, F.hash("digest"))))
