"""Rows that share an id, split indexes and hot keys, and vectors and registers against plain counterparts."""

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plotlink.llm import common, decontaminate, exact_dedup, langid, line_dedup, near_dedup, textkernel
from tests.llm.test_llm import edit_distance, lower, make, words


@pytest.fixture(scope="module")
def namesakes():
    rng = random.Random(21)
    same, other, far = words(rng, 40), words(rng, 40), words(rng, 40)
    return [(5, same, "en", "a"), (9, same, "en", "a"), (9, same, "en", "a"), (5, other, "en", "a"), (7, far, "en", "b"), (7, far, "de", "b"), (None, same, "en", "a"), (8, None, "en", "a"), (8, "", None, "a")]


def kept(df):
    return Counter((r.doc_id, r.text, r.lang) for r in df.collect())


def test_exact_duplicates_leave_namesakes(spark, namesakes):
    got = kept(exact_dedup.drop_duplicates(make(spark, namesakes)))
    same, other, far = namesakes[0][1], namesakes[3][1], namesakes[4][1]
    assert got[9, same, "en"] == 1 and got[5, same, "en"] == 0 and got[5, other, "en"] == 1 and got[None, same, "en"] == 1
    assert got[7, far, "en"] + got[7, far, "de"] == 1 and got[8, None, "en"] + got[8, "", None] == 1 and sum(got.values()) == 5
    assert exact_dedup.drop_duplicates(make(spark, [])).count() == 0


def test_near_duplicates_leave_namesakes(spark, namesakes):
    got = kept(near_dedup.drop_near_duplicates(make(spark, [*namesakes, (3, namesakes[3][1] + " end", "en", "a")])))
    same, other, far = namesakes[0][1], namesakes[3][1], namesakes[4][1]
    assert got[5, same, "en"] == 1 and got[9, same, "en"] == 0 and got[None, same, "en"] == 1
    assert got[5, other, "en"] == 0 and got[3, other + " end", "en"] == 1
    assert got[7, far, "en"] + got[7, far, "de"] == 1 and got[8, None, "en"] == 1 and got[8, "", None] == 1 and sum(got.values()) == 6


def test_leaks_and_languages_leave_namesakes(spark, namesakes):
    bench = spark.createDataFrame([(1, namesakes[3][1])], "item_id long, text string")
    docs = make(spark, namesakes).withColumn("row", F.lit(1)).withColumn("size_class", F.lit(2)).withColumn("tags", F.create_map(F.lit("a"), F.lit("b")))
    left = decontaminate.drop_leaks(docs, bench)
    assert left.columns == docs.columns and kept(left) == Counter(r[:3] for r in namesakes if r[1] != namesakes[3][1])
    mixed = make(spark, [*namesakes, (5, "12 34", "en", "a"), (None, "12 34", "en", "a")]).withColumn("has_id", F.lit(1))
    left = kept(langid.drop_undetermined(mixed))
    assert left[5, namesakes[3][1], "en"] == 1 and left[5, "12 34", "en"] == 0 and left[None, "12 34", "en"] == 1


def shuffled_rows(plan):
    """Rows that all shuffles of an executed plan have written."""
    name, below = plan.nodeName(), plan.children()
    inner = [plan.finalPhysicalPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [below.apply(i) for i in range(below.size())]
    return sum(map(shuffled_rows, inner)) + (plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0)


@pytest.mark.parametrize("room", [None, 1])
def test_only_rows_that_may_be_dropped_are_shuffled(spark, monkeypatch, room):
    """room: words of the filter; with one word nearly all rows are shuffled, and the result is the same."""
    if room:
        monkeypatch.setattr(common, "BROADCAST_ROWS", room)
    rng = random.Random(12)
    rows = [(i if i % 7 else None, words(rng, 5) if i % 11 else None, "en", "a") for i in range(2000)] + [(3000, "twice", "en", "a")] * 3 + [(3001, "thrice gone", None, "b")] * 2
    docs = make(spark, rows)
    h1, h2 = common.row_hashes(docs)
    hashes = common.stored(docs.select("doc_id", "text", h1.alias("h1"), h2.alias("h2")), "hashes")
    dropped = common.stored(hashes.where("doc_id % 20 = 3 or doc_id = 3001").select("h1", "h2").distinct(), "dropped")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = common.without_rows(docs, dropped, hashes.where("doc_id = 3000"))
        got = kept(left)
        moved = shuffled_rows(left._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = Counter(r[:3] for r in rows if r[0] is None or r[0] % 20 != 3 and r[0] < 3000)
    want[3000, "twice", "en"] = 1
    assert got == want and left.columns == docs.columns
    assert moved > 1500 if room else moved < 800


def test_leak_filter_gets_and_gives_texts_once(spark, namesakes):
    bench = spark.createDataFrame([(1, namesakes[3][1])], "item_id long, text string")
    plan = decontaminate.drop_leaks(make(spark, namesakes), bench)._jdf.queryExecution().analyzed()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().apply(0)
    sent = plan.children().apply(0).output()
    assert [sent.apply(i).name() for i in range(sent.size())] == ["row", "has_id"]

    rng = random.Random(33)
    held = words(rng, 30)
    texts = [f"{words(rng, 20)} {held} {words(rng, 20)}" if i % 7 == 0 else None if i % 7 == 1 else words(rng, 600) for i in range(3000)]
    has_id = [i % 14 > 0 for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array(range(3100)), pa.array(["x"] * 100 + texts)], ["doc_id", "text"])[100:], pa.array(has_id)], names=["row", "has_id"])
    left = list(decontaminate._clean(decontaminate.ItemIndex([1], [held]), 0.2)(iter([batch])))
    assert [r["doc_id"] - 100 for b in left for r in b.column(0).to_pylist()] == [i for i in range(3000) if i % 7 or not has_id[i]]
    assert batch.nbytes > 6 << 20 and max(b.nbytes for b in left) < 1 << 20


@pytest.mark.parametrize("kernel", [decontaminate.word_rows, near_dedup.text_sets])
def test_memory_of_word_kernels(monkeypatch, kernel):
    """Beside an 8 MB column, with some words of other scripts, a task needs less than 40 MB."""
    monkeypatch.setattr(textkernel, "_powers", {})
    column = pa.array([words(random.Random(k), 400) + " \u4e16\u754c" for k in range(50)] * 60)
    assert 6 << 20 < column.nbytes < 12 << 20
    tracemalloc.start()
    rows = sum(len(x[-1]) for x in kernel(column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(column) and peak < 40 << 20, peak >> 20


@pytest.mark.parametrize(("capacity", "hot", "key"), [(1, 1 << 40, None), (500, 300, None), (1 << 30, 200, "length")])
def test_index_splits_and_chains(spark, capacity, hot, key):
    rng = random.Random(capacity)
    texts = [words(rng, rng.randint(1, 9)) for _ in range(40)]
    rows = [(i, rng.choice(texts[:1] * 20 + texts), "en", "a") for i in range(400)] + [(None, texts[0].upper(), "en", "a")]
    docs = make(spark, rows)
    key_of = (lambda norm: F.length(norm).cast("long") * F.lit(1 << 50)) if key else F.xxhash64
    got = Counter(tuple(r) for r in exact_dedup.dedup(docs, capacity, hot, key_of).collect())
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lower(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max(i for i in ids if i is not None)
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert got == want
    index = exact_dedup.build_index(docs, exact_dedup.fingerprints(docs, key_of=key_of), capacity, hot, key_of).collect()
    assert len(index) == len(groups) and sum(r.group_size for r in index) == len(rows)
    assert len({r.bucket for r in index}) > 1 or capacity == 1 << 30
    chains = Counter(r.key for r in index)
    assert all(sorted(r.chain for r in index if r.key == k) == list(range(1, n + 1)) for k, n in chains.items())
    assert max(chains.values()) > 1 if key else max(chains.values()) == 1


def test_languages_match_a_plain_counterpart(spark):
    """Bind, permute, bundle and compare, one trigram at a time."""
    rng = random.Random(4)
    alphabet = {"xx": "abcde", "yy": "cdeéf", "zz": "漢字仮名交"}
    text = lambda lang, n: " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(1, 5))) for _ in range(n))
    rows = [(i, text(lang, rng.randint(1, 12)), lang if i % 3 else None, "s") for i in range(80) for lang in [rng.choice(list(alphabet))]]
    rows += [(200, "12, 3!", "xx", "s"), (201, None, "yy", "s"), (202, "ABC\n\tde 漢", "xx", "s"), (None, "cde", "yy", "s")]
    base = np.random.RandomState(langid.SEED).choice(np.array([-1, 1]), (1 << langid.CLASS_BITS, langid.DIMENSIONS))

    def vector(t):
        marks = [0, *[int(langid._classes()[ord(c)]) for c in t or ""], 0]
        out = np.zeros(langid.DIMENSIONS)
        for k in range(1, len(marks) - 1):
            if marks[k]:
                out += np.roll(base[marks[k - 1]], 2) * np.roll(base[marks[k]], 1) * base[marks[k + 1]]
        return out

    import zlib

    sums = defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for i, t, lang, _ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 4 != 2 and lang:
            sums[lang] += vector(t)
    names = sorted(sums)
    got = {r.doc_id: r for r in langid.identify(make(spark, rows)).collect()}
    for i, t, *_ in rows:
        v = vector(t)
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        cosines = [float(v @ sums[n] / max(np.linalg.norm(v) * np.linalg.norm(sums[n]), 1e-12)) for n in names]
        assert got[i].score == pytest.approx(min(1, max(0, max(cosines))), abs=1e-4)
        assert cosines[names.index(got[i].lang_pred)] >= max(cosines) - 1e-4


def test_bytes_that_are_no_utf8(spark):
    bad = spark.range(3).select(F.col("id").alias("doc_id"), F.expr("cast(concat(cast('good words ' as binary), X'ff80c3', cast(' more' as binary)) as string)").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    assert {r.lang_pred for r in langid.identify(bad).collect()} == {"en"}
    assert [r.n_lines for r in line_dedup.dedup_lines(bad).collect()] == [1, 1, 1]


def test_register_margin_keeps_links():
    """Pairs of sets at exactly the threshold: the estimate rules out fewer than one in a thousand."""
    rng = np.random.RandomState(5)
    lost = tried = 0
    for percent in (80, 85):
        for size in (20, 100, 400):
            both = size * percent // 100
            for _ in range(400):
                v = textkernel.mix64(rng.randint(1, 1 << 62, size, dtype=np.int64).astype(np.uint64))
                a, b = np.sort(v[: both + (size - both) // 2]), np.sort(np.concatenate([v[:both], v[both + (size - both) // 2 :]]))
                if 100 * both < percent * size:
                    continue
                regs = [near_dedup.sketch(x, np.zeros(len(x), int), np.array([len(x)]))[0] for x in (a, b)]
                lost += not near_dedup._promising(*regs, np.array([len(a)]), np.array([len(b)]), percent)[0]
                tried += 1
    assert tried > 2000 and lost <= tried // 1000


def test_lines_within_scaled_edits(spark):
    rng = random.Random(31)
    base = ["".join(rng.choice("abcdeé ") for _ in range(n)) for n in (4, 9, 10, 11, 15, 19, 20, 21, 22, 23, 30)]
    lines = set()
    for b in base:
        for _ in range(12):
            v = list(b)
            for _ in range(rng.randint(0, 3)):
                p = rng.randrange(len(v) + 1)
                v[p : p + rng.randint(0, 1)] = rng.choice([[], ["q"], ["ß"]])
            lines.add("".join(v))
    lines = sorted(lines)
    docs = make(spark, [(i, t, "en", "a") for i, t in enumerate(lines)])
    tau = lambda n: 2 if n >= 20 else 1 if n >= 10 else 0
    want = {i: sum(0 < edit_distance(x, y) <= tau(min(len(x), len(y))) for y in lines) for i, x in enumerate(lines)}
    assert {r.doc_id: r.n_links for r in line_dedup.dedup_lines(docs, line_dedup.SCALED).collect()} == want
    assert sum(want[i] for i, x in enumerate(lines) if len(x) < 20) > 10


def test_intermediate_tables_are_released(spark):
    since = common.mark()
    path = common.stored(spark.range(3).toDF("x"), "gone").inputFiles()[0]
    common.release(spark, since)
    assert common.mark() == since
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
