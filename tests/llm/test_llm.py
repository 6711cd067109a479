"""Small tables against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plotlink.llm import chat, common, components, decontaminate, exact_dedup, langid, line_dedup, mixing, near_dedup, pii, sharding, textkernel, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, line string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randint(0, 60)) for _ in range(n))


def make(spark, rows):
    full = [(i, t, lang, src, len(t) if t is not None else None, "k", "s", "l") for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randint(1, 80)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(60)]
    base = words(rng, 150)
    for i in range(60, 75):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w), "en", "a"))
    rows += [(80, base.upper(), "en", "a"), (81, base, "en", "b"), (82, None, "en", "c"), (83, "", None, None), (84, " \n\t ", "de", "a"), (85, "x" * 100_000, "en", "a"), (86, base + " " + words(rng, 9000), "en", "b")]
    rows += [(81, base, "en", "b"), (None, base, "en", "b"), (None, None, None, None), (-5, "tie tie tie tie tie", "en", "a"), (-6, "Tie tie tie tie tie", "en", "a")]
    return rows


def lower(t):
    return (t or "").translate(str.maketrans(common.UPPER, common.UPPER.lower()))


def test_exact_dedup(spark, corpus):
    got = exact_dedup.dedup(make(spark, corpus), capacity=3).collect()
    groups = defaultdict(list)
    for i, t, *_ in corpus:
        groups[lower(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want
    assert exact_dedup.dedup(make(spark, [])).count() == 0
    assert set(exact_dedup.drop_duplicates(make(spark, corpus)).columns) == set(make(spark, corpus).columns)


def test_directory_doubles_only_where_full():
    loads = {s: 1 for s in range(0, 1 << exact_dedup.MAX_DEPTH, 64)} | {5: 50}
    buckets = exact_dedup.grow_directory(loads, 100)
    assert sum(b.keys for b in buckets) == sum(loads.values())
    assert all(b.keys <= 100 or b.depth == exact_dedup.MAX_DEPTH for b in buckets)
    covered = [s for b in buckets for s in b.slots()]
    assert sorted(covered) == list(range(1 << exact_dedup.MAX_DEPTH))
    assert len({b.depth for b in buckets}) > 1


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_match_brute_force(spark, corpus, percent):
    rng = random.Random(percent)
    rows = [r for r in corpus if r[0] is not None]
    seen = Counter(r[0] for r in rows)
    rows = [r for r in rows if seen[r[0]] == 1]
    for g in range(25):  # groups with similarities around the threshold
        w = words(rng, rng.choice([7, 12, 40, 120])).split()
        for k in range(6):
            v = list(w)
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = f"edit{rng.randint(0, 10**6)}"
            rows.append((1000 + g * 10 + k, " ".join(v[rng.randint(0, 1) :]), "en", "a"))
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * len(sets[x] | sets[y]):
                    a, b = sorted((find(x), find(y)))
                    parent[b] = a
    want = {i: (len(sets[i]), find(i), find(i) == i) for i in ids}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(make(spark, rows), percent=percent).collect()}
    assert got == want


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    rng = random.Random(2)
    base = words(rng, 60).split()
    rows = []
    for i in range(90):
        v = list(base)
        for _ in range(rng.randint(0, 5)):
            v[rng.randrange(60)] = f"e{rng.randint(0, 99999)}"
        rows.append((i, " ".join(v), "en", "a"))
    whole = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(make(spark, rows)).collect()}
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(make(spark, rows)).collect()} == whole
    assert len(set(whole.values())) > 1


def test_near_duplicates_edge_rows(spark, corpus):
    got = near_dedup.near_duplicates(make(spark, corpus)).collect()
    assert len(got) == len(corpus)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert all(by[i][0].component_id == i and by[i][0].n_shingles == 0 for i in (82, 83, 84))
    assert {r.component_id for r in by[None]} == {60 if by[81][0].component_id == 60 else by[81][0].component_id, None}
    assert near_dedup.near_duplicates(make(spark, [])).count() == 0


def test_register_estimate_is_unbiased():
    rng = np.random.RandomState(1)
    for share in (0.3, 0.85):
        got = []
        for _ in range(60):
            both = rng.randint(1, 1 << 62, int(600 * share), dtype=np.int64)
            rest = rng.randint(1, 1 << 62, (2, (600 - int(600 * share)) // 2), dtype=np.int64)
            regs = []
            for k in (0, 1):
                v = np.sort(textkernel.mix64(np.concatenate([both, rest[k]]).astype(np.uint64)))
                regs.append(near_dedup.sketch(v, np.zeros(len(v), int), np.array([len(v)]))[0])
            got.append(near_dedup.estimate(*regs, np.array([500]), np.array([500]))[0][0])
        assert abs(np.mean(got) - share) < 0.02


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(40)] + [(300, i) for i in range(301, 340)] + [(None, 3), (5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}


def levenshtein_fit(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def clean_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[!-/:-@\[-`{-~]", "", lower(t)))


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(11)
    items = [(k, words(rng, rng.randint(8, 45))) for k in range(30)] + [(90, None), (91, ""), (92, "too short"), (None, words(rng, 20))]
    docs = []
    for i in range(120):
        w = words(rng, rng.randint(5, 120)).split()
        if i % 2 == 0:
            v = items[rng.randrange(30)][1].split()
            for _ in range(rng.randint(0, int(0.25 * len(v)))):
                p = rng.randrange(len(v))
                v[p : p + rng.randint(0, 1)] = [f"other{rng.randint(0, 999)}"] if rng.random() < 0.6 else []
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + rng.choice(["", ",", "!"]) for x in v]
        docs.append((i, " ".join(w), "en", "a"))
    docs += [(500, None, None, None), (501, "", "en", "a"), (None, items[0][1], "en", "a"), (502, "y " * 30_000 + items[1][1], "en", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(make(spark, docs), bench).collect()}
    want = {}
    for i, t, *_ in docs:
        for k, item in items:
            v = clean_words(item)
            if k is not None and len(v) >= decontaminate.MIN_WORDS:
                d = levenshtein_fit(v, clean_words(t)) if len(clean_words(t)) < 5000 else (0 if item in t else 99)
                if d <= int(decontaminate.EDIT_SHARE * len(v)):
                    want[i, k] = d
    assert set(got) <= set(want)
    assert len(got) >= 0.97 * len(want) and all(got[k] == want[k] for k in got)
    assert all(k in got for k, d in want.items() if d == 0)
    assert decontaminate.leaks(make(spark, []), bench).count() == 0
    assert decontaminate.leaks(make(spark, docs[:5]), bench.limit(0)).count() == 0
    kept = decontaminate.drop_leaks(make(spark, docs), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in docs} - {i for i, _ in got if i is not None}


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    items = [(k, words(rng, 20)) for k in range(12)]
    docs = make(spark, [(k, t, "en", "a") for k, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 5)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} >= {(k, k) for k, _ in items}


@pytest.mark.parametrize(("length", "missing"), [(40, 5), (40, 8), (58, 8), (20, 3)])
def test_documents_that_open_with_a_cut_item(spark, length, missing):
    rng = random.Random(length + missing)
    items = [(k, words(rng, length)) for k in range(40)]
    docs = [(k, " ".join(item.split()[missing:] + words(rng, 10).split()), "en", "a") for k, item in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(make(spark, docs).coalesce(1), bench).collect()}
    assert len(got) >= 39 and got <= {(k, k) for k, _ in items}


def test_short_items_and_scripts_without_blanks(spark):
    rng = random.Random(17)
    han = lambda n: "".join(rng.choice("漢字仮名交文書類題問答数学科理") for _ in range(n))
    items = [(n, words(rng, n)) for n in range(1, 8)] + [(20, han(5)), (21, han(30)), (22, "for(i=0;i<n;i++)")]
    docs = []
    for k, item in items:
        blank = "" if k in (20, 21) else " "
        v = list(item) if k in (20, 21) else item.split()
        for cut in range(len(v) // 5 + 1):
            docs.append((k * 100 + cut, words(rng, rng.randint(0, 9)) + blank + blank.join(v[:1] * (cut == 0) + v[1 : len(v) - max(cut - 1, 0)]) + blank + words(rng, 6), "en", "a"))
    docs += [(9000, han(40), "zh", "a"), (9001, words(rng, 50), "en", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(make(spark, docs).coalesce(1), bench).collect()}
    want = {}
    spread = lambda t: clean_words(re.sub("([\u3040-\u9fff])", r" \1 ", t))
    for i, t, *_ in docs:
        for k, item in items:
            d = levenshtein_fit(spread(item), spread(t))
            if d <= int(decontaminate.EDIT_SHARE * len(spread(item))):
                want[i, k] = d
    assert got == want and all((k * 100, k) in got for k, _ in items)


def test_mixing(spark, corpus):
    got = mixing.mix_documents(make(spark, corpus)).collect()
    assert len(got) == len(corpus)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for _, t, _, s in corpus:
        total[s] += size(t)
    taken = mixing.mix(make(spark, corpus)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.first("source_size").alias("s")).collect()
    assert {r.source: r.s for r in taken} == dict(total)
    assert all(abs(r.t - r.g) <= 0.5 and r.g <= 2 * r.s + 1e-9 for r in taken)
    assert abs(sum(r.g for r in taken) - 1.5 * sum(total.values())) < 1e-6
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = mixing.mix_documents(make(spark, corpus).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix_documents(make(spark, [])).count() == 0
    keyed = [r for r in corpus if r[0] is not None and Counter(x[0] for x in corpus)[r[0]] == 1]
    plan = {r.doc_id: r.taken for r in mixing.mix(make(spark, keyed)).collect()}
    out = Counter()
    for r in mixing.apply_mix(make(spark, keyed)).collect():
        out[r.doc_id] += size(r.text)
    assert {k: v for k, v in out.items() if v} == {k: v for k, v in plan.items() if v}


def test_mixed_corpus_with_repeated_and_null_ids(spark, corpus):
    rng = random.Random(12)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = [r for r in corpus if size(r[1]) < 1000] + [(7, words(rng, 30), "en", "a") for _ in range(9)] + [(None, words(rng, 40), "en", "b") for _ in range(5)]
    plan, out = Counter(), Counter()
    for r in mixing.mix(make(spark, rows)).collect():
        plan[r.doc_id, r.source] += r.taken
    for r in mixing.apply_mix(make(spark, rows)).collect():
        out[r.doc_id, r.source] += size(r.text)
    assert {k: v for k, v in out.items() if v} == {k: v for k, v in plan.items() if v}


def test_near_duplicates_with_two_sets_of_one_id(spark):
    rng = random.Random(13)
    rows = []
    for g in range(20):
        one, two = words(rng, 40), words(rng, 40)
        rows += [(1000 + g, one, "en", "a"), (1000 + g, two, "en", "a"), (2000 + g, one + " end", "en", "a"), (3000 + g, two + " end", "en", "a")]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(make(spark, rows)).collect()}
    assert got == {k + g: 1000 + g for k in (1000, 2000, 3000) for g in range(20)}


def test_sharding(spark, corpus):
    got = sharding.shard_documents(make(spark, corpus)).collect()
    assert len(got) == len(corpus)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    counts = [len(shards[k]) for k in range(16)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in shards.values())
    share = Counter(s for *_, s in corpus)
    for v in shards.values():  # the mixture of every shard is within one row of the whole's
        have = Counter(r.source for r in v)
        assert all(abs(have[s] - n * len(v) / len(corpus)) <= 1.5 for s, n in share.items())
    assert sharding.shard_documents(make(spark, [])).count() == 0
    few = sharding.shard_documents(make(spark, corpus[:3])).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0]


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "a & b &amp; &lt;s>", "<|im_start|>user\nhi<|im_end|>\n", "", None, "&#91;INST]", "ü\n\n<s>" * 50]
    rows = [(c, t, role, odd[(c + t) % len(odd)]) for c in range(8) for t in range(c + 1) for role in [["user", "assistant", "sys\ntem", None][t % 4]]]
    rows += [(3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"), (None, 0, "user", "no conversation")]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))).collect()}
    want = defaultdict(list)
    none_first = lambda v: (v is not None, v or "")
    for c, t, role, text in sorted(rows, key=lambda r: (none_first(str(r[0]) if r[0] is not None else None), r[1], none_first(r[2]), none_first(r[3]))):
        want[c].append((role or "", text or ""))
    want[-7] = [("user", odd[0]), ("assistant", odd[0])]
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    alone = chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()
    assert [r.conv_id for r in alone] == [-7]


def test_reply_trees_rank_branches(spark):
    # 1 -> 2 -> (3 -> 5 -> 6, 4); scores favour the branch over 4 at first, over 6 by mean
    rows = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 2, "user", "b", 9.0), ("t", 4, 2, "user", "c", 5.0), ("t", 5, 3, "assistant", "d", 9.0), ("t", 6, 5, "user", "e", 9.0), ("u", 1, 77, "user", "lost parent", None)]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.rank): (r.leaf, [t.text for t in r.turns]) for r in chat.format_paths(m, best=2).select("tree", "rank", "leaf", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert got == {("t", 1): (6, ["q", "a", "b", "d", "e"]), ("t", 2): (4, ["q", "a", "c"]), ("u", 1): (1, ["lost parent"])}
    loop = spark.createDataFrame([("t", 1, 2, "u", "x", 0.0), ("t", 2, 1, "u", "y", 0.0)], m.schema)
    with pytest.raises(ValueError):
        chat.paths(loop)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("block", [512, 3])
def test_line_dedup_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(5)
    base = [words(rng, rng.randint(2, 12)) + "é" for _ in range(25)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                p = rng.randrange(len(line) + 1)
                line[p : p + rng.randint(0, 1)] = rng.choice([[], ["q"], ["ß"]])
            lines.append("".join(line))
        docs.append((i, "\n".join(lines), "en", "a"))
    docs += [(100, None, None, None), (101, "", "en", "a"), (102, "\n\n", "en", "a"), (103, "short\nshort\nshorp", "en", "a"), (104, "z" * 40_000, "en", "a"), (105, "z" * 39_999, "en", "a")]
    spots = sorted((i, k, line) for i, t, *_ in docs for k, line in enumerate((t or "").split("\n")))
    first = {}
    for i, k, line in spots:
        first.setdefault(line, (i, k))
    texts = [t for t in first if len(t) >= line_dedup.MIN_LENGTH]
    linked = defaultdict(set)
    for x in texts:
        for y in texts:
            if x < y and abs(len(x) - len(y)) <= 2 and (len(x) > 1000 and {x, y} == {"z" * 40_000, "z" * 39_999} or len(x) <= 1000 and edit_distance(x, y) <= 2):
                linked[x].add(y)
                linked[y].add(x)
    want = defaultdict(lambda: [0, 0, 0, 0, 0])
    for i, k, line in spots:
        repeated = first[line] != (i, k)
        similar = not repeated and any(first[o] < first[line] for o in linked[line])
        for at, v in enumerate((1, repeated, similar, not repeated and not similar, len(linked[line]))):
            want[i][at] += v
    got = {r.doc_id: [r.n_lines, r.n_repeated, r.n_similar, r.n_kept, r.n_links] for r in line_dedup.dedup_lines(make(spark, docs)).collect()}
    assert got == dict(want)
    assert sum(v[2] for v in want.values()) > 10
    assert line_dedup.dedup_lines(make(spark, [])).count() == 0
    if block == 512:
        clean = {r.doc_id: r.text for r in line_dedup.clean_lines(make(spark, docs)).collect()}
        assert all(len(clean[i].split("\n")) == want[i][3] for i in want if clean[i] and want[i][3])


def test_banded_distances():
    rng = random.Random(3)
    draw = lambda n: [rng.choice("abcé") for _ in range(n)]
    a, b = [], []
    for _ in range(600):
        x = draw(rng.randint(0, 40))
        y = list(x)
        for _ in range(rng.randint(0, 4)):
            p = rng.randrange(len(y) + 1)
            y[p : p + rng.randint(0, 1)] = draw(rng.randint(0, 1))
        a.append("".join(x))
        b.append("".join(y))
    points = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    for tau in (1, 2, 3):
        got = line_dedup.banded_distances([points(x) for x in a], [points(x) for x in b], tau)
        assert got.tolist() == [min(tau + 1, edit_distance(x, y)) for x, y in zip(a, b, strict=True)]


def test_warc_audit(spark):
    rows = [(i, f"http://x/{i}", f"<p>{'é' * (i % 50)}{i}</p>") for i in range(300)] + [(None, None, None), (7, "http://x/7", "again"), (400, "u", ""), (401, "v", "w" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit("clash"))
    placed = warc.records(pages, 40)
    good = warc.leaves(placed, warc.record_bytes(F.col("page_id"), F.col("url"), F.col("html")))
    assert warc.audit(good, good).count() == 0
    hurt = {13: "altered", 99: "missing", 250: "altered", 401: "altered"}
    html = F.when(F.col("page_id").isin(13, 250, 401), F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    bad = warc.leaves(placed.where("page_id is null or page_id <> 99"), warc.record_bytes(F.col("page_id"), F.col("url"), html))
    extra = spark.createDataFrame([(0, 10**9, 999, "beyond")], "archive long, offset long, record_id long, digest string")
    got = {r.record_id: r.state for r in warc.audit(good, bad.unionByName(extra), span=2048, fanout=4).collect()}
    assert got == hurt | {999: "extra"}
    assert warc.audit_pages(pages.limit(0)).count() == 0


def test_language_id(spark):
    rng = random.Random(1)
    alphabet = {"xx": "abcde", "yy": "éfghi", "zz": "漢字仮名交"}
    text = lambda lang, n: " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows = [(i, text(lang, rng.randint(3, 60)), lang, "s") for i in range(300) for lang in [rng.choice(list(alphabet))]]
    rows += [(900, None, "xx", "s"), (901, "", None, None), (902, "123 !? 4", "yy", "s"), (903, text("xx", 20_000), None, "s"), (None, text("yy", 9), "yy", "s"), (904, "ÉFghi", None, None)]
    got = langid.identify(make(spark, rows)).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang, _ in rows}
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id) == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902)) and by[903].lang_pred == "xx" and by[904].lang_pred == "yy"
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(make(spark, [(1, "abc", None, None), (2, "x", None, None)])).collect()} == {"und"}
    assert langid.identify(make(spark, [])).count() == 0


def test_documents_in_no_known_language_go(spark):
    rng = random.Random(19)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows = [(i, text(["abcde", "éfghi"][i % 2], rng.randint(20, 60)), ["xx", "yy"][i % 2], "s") for i in range(400)]
    rows += [(1000 + i, text("漢字仮名交", 40), None, "s") for i in range(10)] + [(2000 + i, text("qwzxkvj", 40), None, "s") for i in range(10)]
    kept = {r.doc_id for r in langid.drop_undetermined(make(spark, rows)).collect()}
    assert kept == set(range(400))
    unknown = [(i, t, None, s) for i, t, _, s in rows]
    assert langid.drop_undetermined(make(spark, unknown)).count() == len(rows)


def test_language_bounds_come_from_every_labelled_document(spark):
    rng = random.Random(7)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))
    known, foreign = "abcde", "qwzxkvj"
    rows = [(i, text(known, 2), "xx", "s") for i in range(60_000)] + [(100_000 + i, text(known, 80), "xx", "s") for i in range(52)]
    rows += [(200_000 + i, text(known, 16) + " " + text(foreign, 64), None, "s") for i in range(10)]
    twos = [i for i in range(300_000, 301_000) if zlib.crc32(str(i).encode()) % 4 == 2][:60]
    rows += [(i, text("漢字仮名交", 40), "zz", "s") for i in twos]
    left = {r.doc_id for r in langid.drop_undetermined(make(spark, rows)).collect()}
    assert set(twos) <= left and set(range(100_000, 100_052)) <= left
    assert not left & set(range(200_000, 200_010))


def test_language_kernels_work_in_bounded_memory():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(["xx"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    langid._classes()
    tracemalloc.start()
    try:
        counted = list(langid._count(iter([batch])))
        (bundle,) = langid._bundle(iter(counted))
        (found,) = langid._predict({"xx": bundle.column(1)[0].as_py()})(iter([batch]))
        assert set(found.column(1).to_pylist()) == {"xx"} and tracemalloc.get_traced_memory()[1] < 80 << 20
    finally:
        tracemalloc.stop()


def test_languages_are_learned_without_aggregates_of_spark(spark):
    rng = random.Random(29)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))
    rows = [(i, " ".join(word("abcdeéß漢字") for _ in range(rng.randint(0, 30))), f"l{rng.randrange(700)}" if i % 3 else "xx", "s") for i in range(3000)]
    docs = make(spark, [*rows, (5000, None, "xx", "s"), (5001, "1 2", "digits", "s"), (5002, "abc", None, "s")]).repartition(7)
    want = defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for lang in {r[2] for r in rows}:
        for _, _, codes, _ in langid.trigrams(pa.array([t for _, t, x, _ in rows if x == lang])):
            want[lang] += langid.trigram_vectors(codes).sum(0, dtype=np.float64)
    profiles = langid.profiles(docs)
    got = [(r.lang, r.vector) for r in profiles.collect()]
    assert len(got) == len(dict(got)) and dict(got) == {k: v.tolist() for k, v in want.items() if v.any()} == langid.learn(docs)
    plan = profiles._jdf.queryExecution().toString()
    assert "Aggregate" not in plan and "Sort" not in plan


def test_trigrams_of_many_letters_are_counted_in_bounded_memory():
    rng = np.random.RandomState(31)
    texts = ["".join(map(chr, rng.randint(0x4E00, 0x9F00, 2000))) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(["zh", "ja"] * 250), pa.array(texts)], names=["lang", "text"])
    langid._classes()
    tracemalloc.start()
    try:
        counted = list(langid._count(iter([batch])))
        assert sum(sum(x.column(2).to_pylist()) for x in counted) == 500 * 2000 and len(counted) > 1
        del counted
        tracemalloc.reset_peak()
        (sums,) = langid._profile(iter([batch]))
        assert sums.column(0).to_pylist() == ["ja", "zh"] and tracemalloc.get_traced_memory()[1] < 80 << 20
    finally:
        tracemalloc.stop()


def test_document_vectors_are_bundles_of_bound_trigrams():
    column = pa.array(["abca", None, "ab ca"])
    ((_, _, codes, rows),) = langid.trigrams(column)
    spelled = ["".join(" abc"[(c >> s) & 127] for s in (14, 7, 0)) for c in codes]
    assert list(zip(rows.tolist(), spelled, strict=True)) == [(0, " ab"), (0, "abc"), (0, "bca"), (0, "ca "), (2, " ab"), (2, "ab "), (2, " ca"), (2, "ca ")]


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def test_pii_base_spans(spark):
    rng = random.Random(9)
    bits = ["a@b.c%d@e.f", "x@y", "@", "+", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.002.0003.255", "4111 1111 1111 1111", "4111-1111-1111-1111-2", "4111111111111111 4111111111111111", "+12 (34) 5678-90.", "+1 2 3", "é", "+49.30.1234567", "\n", "token = \"" + "0f" * 20 + '"', "555-123-4567", " ", "bob at mail dot com", "漢", "12", "-", "."]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14))), "en", "a") for i in range(400)]
    rows += [(900, None, None, None), (901, "1" * 20_000 + " +1" + " 2" * 9000 + " a" * 9000 + "@b.c", "en", "a"), (None, "q@r.st", "en", "a")]
    docs = make(spark, rows)
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    for i, t, *_ in rows:
        spans = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if valid(k, m[0])] for k, p in PII.items()}
        line = [s for v in spans.values() for s in v]
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in spans.values()], (t, spans)
        assert r.base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest()
        everything = [s for s in r.spans.split(",") if s]
        assert [s for s in everything if s.split(":")[0] in PII] == line
        taken = sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in everything if s.split(":")[0] not in PII)
        assert all(a[1] <= b[0] for a, b in zip(taken, taken[1:], strict=False))
    assert pii.detect(make(spark, [])).count() == 0
    text = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert text[None] == "[email]" and text[900] is None


def test_pii_model_adds_secrets(spark):
    rng = random.Random(2)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f"some words token = \"{key()}\" and more" if i % 3 == 0 else f"name x{i}@mail.org or plain {'x' * 22} text {rng.randint(10**15, 10**16)}", "en", "a") for i in range(400)]
    got = {r.doc_id: r.spans for r in pii.detect(make(spark, rows)).collect()}
    assert sum("secret" in got[i] for i in range(0, 400, 3)) >= 130
    assert not any("secret" in got[i] for i in range(400) if i % 3)


def test_pii_adds_every_kind(spark):
    rng = random.Random(8)
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    account = lambda: str(rng.randint(10**9, 10**10 - 1))
    letters = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30))
    kinds = {
        "number": lambda: f"please call {number()} today", "account": lambda: f"to the account {account()} now",
        "spelled": lambda: f"write to bob{rng.randint(1, 99)} at host{rng.randint(1, 99)} dot com soon", "secret": lambda: f'the token = "{letters()}" here',
    }
    plain = [lambda: f"rows {number()} of a table", lambda: f"block {account()} of many", lambda: f"look at this dot thing{rng.randint(1, 99)}xy there", lambda: f"some {letters()} word"]
    made = [(list(kinds)[i % 4] if i % 2 else None, list(kinds.values())[i % 4]() if i % 2 else plain[i // 2 % 4]()) for i in (rng.randrange(10**6) for _ in range(1600))]
    made += [(k, f()) for k, f in kinds.items() for _ in range(150)]
    got = {r.doc_id: r.spans for r in pii.detect(make(spark, [(i, t, "en", "a") for i, (_, t) in enumerate(made)])).collect()}
    for kind in kinds:
        mine = [i for i, (k, _) in enumerate(made) if k == kind]
        assert sum(got[i].startswith(kind) for i in mine) >= 0.95 * len(mine), kind
    assert not any(got[i] for i, (k, _) in enumerate(made) if k is None)


def test_pii_only_kept_spans_suppress_others(spark):
    # Three overlap in a chain: the middle one gives way to the best, so the last one is free.
    text = "bob at host dot abcdefghijklmnop=555-123 4567 89"
    rank = pii.Split("length", 28, pii.Split("length", 20, pii.Leaf(1.0), pii.Leaf(2.0)), pii.Leaf(3.0))
    model = pii.Model(0.0, (rank,), (0.5,) * len(pii.GENERATORS))
    assert pii.detect(make(spark, [(1, text, "en", "a")]), model).first().spans == "number:33:48,spelled:0:32"


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    item = words(rng, 25)
    base = words(rng, 100)
    rows = [(i, words(rng, rng.randint(20, 90)), "en", rng.choice(["a", "b", "c"])) for i in range(80)]
    rows += [(200, base, "en", "a"), (201, base + " end", "en", "b"), (202, words(rng, 5) + " " + item + " " + words(rng, 9), "en", "c"), (203, "123 456", "en", "a"), (204, None, "en", "a")]
    docs = make(spark, rows).drop("key", "size", "line")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, gone = docs, []
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns
        before, after = ({r.doc_id for r in x.collect()} for x in (kept, out))
        gone.append(before - after)
        kept = common.stored(out, "t")
    assert gone == [{203, 204}, {201}, {202}]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.shard for r in final} <= set(range(16)) and not {r.doc_id for r in final} & {201, 202, 203, 204}
