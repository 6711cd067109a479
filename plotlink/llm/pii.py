"""Personal data by candidate generation and gradient boosting, in DataFrame expressions only.

Exact rules give the base spans, which always stay. High-recall generators propose further, overlapping spans
(number groups, long numbers, key-like strings, spelled-out addresses). Boosted trees rate each from its format and
context; spans above their kind's calibrated threshold that overlap no base span and no better added span are added.

The trees are fitted on a bounded sample (the candidates of about SAMPLE_DOCS documents by hash of doc_id, SAMPLE_ROWS at most) of weakly labelled candidates: base spans,
key-like strings behind a word such as "token", numbers and accounts behind a word such as "phone" or "account" and
spelled-out addresses with a plausible ending are positive, other proposals are negative. Fitting works on the
sampled feature vectors on the driver; rating is one nested CASE expression that Spark compiles.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlink.llm import common

_LOCAL = "A-Za-z0-9._%+-"
#: The base rules in order (fixed by the contract); possessive and anchored where that cannot change a match,
#: so that no text makes them backtrack. Cards are anchored at both ends of their run of digits.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Proposals beyond the base rules.
GENERATORS = {
    "number": r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?(?:[ .-]\(?[0-9]{2,4}\)?){2,4}+(?![0-9A-Za-z])",
    "account": r"(?<![0-9A-Za-z.+-])[0-9]{9,19}+(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+",
    "spelled": r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{2,}+(?: at |\(at\)|\[at\]| \(at\) | \[at\] )[A-Za-z0-9-]++(?:(?: dot |\(dot\)|\[dot\]| \(dot\) | \[dot\] )[A-Za-z0-9-]++)++",
}
KINDS = (*BASE, *GENERATORS)
#: Words that announce a secret or a contact (fixed values).
SECRET_WORDS = "token|secret|password|passwd|api.?key|access.?key|credential|bearer"
CONTACT_WORDS = "phone|tel|call|fax|mobile|contact|whatsapp|mail|account|iban|ssn"
#: Last labels of plausible addresses: two letters, or one of the common longer ones (fixed values).
ENDINGS = "[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|app|dev|cloud|online|email"

SAMPLE_DOCS, SAMPLE_ROWS = 20_000, 20_000
#: Fewest candidates of a kind, not used for the trees, on which a threshold may rest; with fewer the kind adds nothing.
LEAST_HELD = 5
ROUNDS, LEARNING_RATE, MIN_LEAF = 24, 0.3, 4
#: Share of selected proposals that must be positive at the calibrated threshold, and its least value.
PRECISION, LEAST_THRESHOLD = 0.9, 0.5
CONTEXT = 24

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def find_spans(text: Column, kind: str, pattern: str) -> Column:
    """All matches with code point offsets: their lengths and those of the gaps between them add up to the places."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.aggregate(pairs, start, step)["out"]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    d = F.split(F.reverse(digits(value)), "")
    weighed = F.transform(F.filter(d, lambda x: x != ""), lambda x, i: x.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(weighed, F.lit(0), lambda s, x: s + F.floor(x / 10).cast("int") + x % 10) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    value = x["value"]
    n = F.length(digits(value))
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return n.between(16, 19) & luhn(value)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def _guarded(text: Column, kind: str, pattern: str) -> Column:
    """Matches, sought only in texts that have what every match needs."""
    needs = {"email": text.contains("@"), "phone": text.contains("+"), "secret": text.rlike("[A-Za-z0-9_/+=-]{20}"), "spelled": text.contains("dot")}.get(kind, text.rlike("[0-9]"))
    return F.when(needs, find_spans(text, kind, pattern)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    return {kind: F.filter(_guarded(text, kind, p), functools.partial(_valid, kind)) for kind, p in BASE.items()}


def proposals(text: Column) -> Column:
    return F.concat(*[_guarded(text, kind, p) for kind, p in GENERATORS.items()])


#: Format and context features of a candidate; each becomes an integer.
FEATURES = ("length", "digits", "letters", "separators", "classes", "plus", "parens", "at_sign", "dots", "luhn", "secret_word", "contact_word", "quoted", "repeats", "ending")


def features(text: Column, x: Column) -> dict[str, Column]:
    value = x["value"]
    begin = F.greatest(F.lit(1), x["start"] + 1 - CONTEXT)
    before = F.substring(text, begin, x["start"] + 1 - begin)
    n = F.length(digits(value))
    flag = lambda c: c.cast("int")
    return {
        "length": F.least(F.length(value), F.lit(64)), "digits": F.least(n, F.lit(32)), "letters": F.least(F.length(F.regexp_replace(value, "[^A-Za-z]", "")), F.lit(64)),
        "separators": F.length(F.regexp_replace(value, "[^ .-]", "")), "classes": flag(value.rlike("[0-9]")) + flag(value.rlike("[a-z]")) + flag(value.rlike("[A-Z]")) + flag(value.rlike("[^A-Za-z0-9]")),
        "plus": flag(value.startswith("+")), "parens": flag(value.contains("(")), "at_sign": flag(value.rlike("@|[( \\[]at[) \\]]")), "dots": F.length(F.regexp_replace(value, "[^.]", "")),
        "luhn": flag(n.between(13, 19) & luhn(value)), "secret_word": flag(before.rlike(f"(?i)(?:{SECRET_WORDS})")), "contact_word": flag(before.rlike(f"(?i)(?:{CONTACT_WORDS})")),
        "quoted": flag(before.rlike("[\"'=:] ?$")), "repeats": flag(value.rlike(r"(.)\1\1\1")), "ending": flag(value.rlike(f"(?i)(?:dot[)\\]]? ?|[.])(?:{ENDINGS})$")),
    }


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: str
    cut: int  # left: feature <= cut
    left: Split | Leaf
    right: Split | Leaf


@dataclass(frozen=True)
class Model:
    bias: float
    trees: tuple[Split | Leaf, ...]
    thresholds: tuple[float, ...]  # of the GENERATORS, in order

    def selects(self, kind: Column, p: Column) -> Column:
        return functools.reduce(operator.or_, [(kind == k) & (p >= t) for k, t in zip(GENERATORS, self.thresholds, strict=True)])

    def logit(self, f: dict[str, Column]) -> Column:
        def tree(t: Split | Leaf) -> Column:
            return F.lit(t.value) if isinstance(t, Leaf) else F.when(f[t.feature] <= t.cut, tree(t.left)).otherwise(tree(t.right))

        return functools.reduce(operator.add, [tree(t) for t in self.trees], F.lit(self.bias))

    def rate(self, rows: np.ndarray) -> np.ndarray:
        def tree(t: Split | Leaf) -> np.ndarray:
            return np.full(len(rows), t.value) if isinstance(t, Leaf) else np.where(rows[:, FEATURES.index(t.feature)] <= t.cut, tree(t.left), tree(t.right))

        return self.bias + sum((tree(t) for t in self.trees), np.zeros(len(rows)))


def _grow(rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int) -> Split | Leaf:
    g, h = gradient.sum(), weight.sum()
    best = (1e-6, None)
    if depth:
        for k in range(rows.shape[1]):
            column = rows[:, k]
            for cut in np.unique(column)[:-1]:
                left = column <= cut
                n = left.sum()
                if min(n, len(rows) - n) < MIN_LEAF:
                    continue
                gl, hl = gradient[left].sum(), weight[left].sum()
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                if gain > best[0]:
                    best = gain, (k, int(cut))
    if best[1] is None:
        return Leaf(round(float(LEARNING_RATE * g / (h + 1)), 9))
    k, cut = best[1]
    left = rows[:, k] <= cut
    return Split(FEATURES[k], cut, _grow(rows[left], gradient[left], weight[left], depth - 1), _grow(rows[~left], gradient[~left], weight[~left], depth - 1))


def fit(rows: np.ndarray, labels: np.ndarray, kinds: np.ndarray) -> Model:
    """Trees of depth 2 by Newton boosting of the logistic loss; a kind's threshold is the least probability at which
    its proposals above it in the odd rows, not used for the trees, are PRECISION positive.

    kinds: place in GENERATORS of each row, -1 for base spans.
    """
    train = np.arange(len(rows)) % 2 == 0
    none = (2.0,) * len(GENERATORS)
    x, y = rows[train], labels[train].astype(float)
    if not len(x) or y.min() == y.max():
        return Model(0.0, (), none)  # nothing to learn from: no proposal is selected
    share = y.mean()
    bias = round(float(np.log(share / (1 - share))), 9)
    trees: list[Split | Leaf] = []
    margin = np.full(len(x), bias)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, y - p, p * (1 - p), 2)
        trees.append(tree)
        margin = margin + Model(0.0, (tree,), none).rate(x)
    rated = 1 / (1 + np.exp(-Model(bias, tuple(trees), none).rate(rows)))
    thresholds = []
    for k in range(len(GENERATORS)):
        held = ~train & (kinds == k)
        order = np.argsort(-rated[held], kind="stable")
        p, z = rated[held][order], labels[held][order]
        last = np.append(p[1:] != p[:-1], True)[: len(p)]  # equal probabilities are selected together
        good = np.flatnonzero(last & (np.cumsum(z) / np.arange(1, len(p) + 1) >= PRECISION))
        # Spark may add up the trees with another last bit.
        thresholds.append(max(LEAST_THRESHOLD, float(p[good[-1]]) - 1e-9) if len(good) and len(p) >= LEAST_HELD else 2.0)
    return Model(bias, tuple(trees), tuple(thresholds))


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most sample_rows weakly labelled candidates."""
    table = np.array([tuple(r) for r in labelled(docs, sample_rows).collect()], np.int64).reshape(-1, len(FEATURES) + 2)
    return fit(table[:, :-2], table[:, -2], table[:, -1])


def labelled(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Features, label and kind (place in GENERATORS, -1: base span) of at most sample_rows candidates, the first by hash of text
    and place, of about SAMPLE_DOCS documents. So all that the driver can get is bounded, and only these documents are searched."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    docs = docs.where(F.pmod(F.xxhash64(F.lit("labels"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*base_spans(text).values())
    both = docs.select(text.alias("text"), base.alias("base"), proposals(text).alias("proposed"))
    own = F.filter("proposed", lambda x: ~F.exists("base", lambda b: _overlap(x, b)))
    marked = F.concat(F.transform("base", lambda x: F.struct(x.alias("x"), F.lit(True).alias("base"))), F.transform(own, lambda x: F.struct(x.alias("x"), F.lit(False).alias("base"))))
    rows = both.select("text", F.explode(marked).alias("c"))
    f = features(F.col("text"), F.col("c.x"))
    kind = F.col("c.x.kind")
    secret = (kind == "secret") & (f["secret_word"] == 1) & ((f["digits"] > 3) | (f["quoted"] == 1))
    positive = F.col("c.base") | secret | (kind.isin("number", "account") & (f["contact_word"] == 1)) | ((kind == "spelled") & (f["ending"] == 1))
    place = F.when(F.col("c.base"), -1).otherwise(F.array_position(F.array(*[F.lit(k) for k in GENERATORS]), kind) - 1)
    order = [F.xxhash64("text", "c.x.kind", "c.x.start"), F.col("c.x.kind"), F.col("c.x.start")]
    rows = rows.select(*[c.alias(n) for n, c in f.items()], positive.cast("int").alias("label"), place.cast("int").alias("kind"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    return rows.orderBy("o0", "o1", "o2").limit(sample_rows).select(*FEATURES, "label", "kind")


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, the four base counts, base_sha256, spans (kind:start:end, code points, by kind and start).

    Null text is empty and has no spans. Every row is treated on its own, so repeated rows repeat their result;
    a null doc_id stays null; an empty table gives an empty result. Added spans overlap no base span; they are taken
    by falling probability (then the earlier, the longer, the last kind by name), each that overlaps none taken before.
    """
    model = model or learn(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text"), *[c.alias(k) for k, c in base_spans(text).items()], proposals(text).alias("proposed"))
    rated = F.transform("proposed", lambda x: F.struct((1 / (1 + F.exp(-model.logit(features(F.col("text"), x))))).alias("p"), (-x["start"]).alias("s"), x["end"].alias("e"), x.alias("x")))
    base = F.concat(*[F.col(k) for k in BASE])
    picked = F.filter(rated, lambda r: model.selects(r["x"]["kind"], r["p"]) & ~F.exists(base, lambda b: _overlap(r["x"], b)))
    found = found.withColumn("picked", F.when(F.size("proposed") == 0, F.array().cast(f"array<struct<p:double,s:int,e:int,x:struct<kind:string,start:int,end:int,value:string>>>")).otherwise(picked))
    taken = F.aggregate(F.sort_array("picked", asc=False), F.array().cast(SPAN), lambda kept, r: F.when(F.exists(kept, lambda o: _overlap(r["x"], o)), kept).otherwise(F.concat(kept, F.array(r["x"]))))
    found = found.withColumn("added", F.when(F.size("picked") == 0, F.array().cast(SPAN)).otherwise(taken))
    added = F.sort_array(F.transform("added", lambda x: F.struct(x["start"].alias("start"), x.alias("x"))))
    added = F.transform(added, lambda r: r["x"])
    write = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    by_kind = [F.col(k) if k in BASE else F.filter(added, _of_kind(k)) for k in KINDS]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(common.utf8_bytes(F.array_join(F.transform(base, write), ",")), 256).alias("base_sha256"), F.array_join(F.transform(F.concat(*by_kind), write), ",").alias("spans"),
    )


def redact(docs: DataFrame, model: Model | None = None, mark: str = "[{}]") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; other columns are unchanged."""
    model = model or learn(docs)
    spans = detect(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"), model).withColumnRenamed("doc_id", "whole_row")
    parsed = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("start"), F.split(s, ":")[2].cast("int").alias("end"), F.split(s, ":")[0].alias("kind")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("whole_row.text")

    def step(state: Column, x: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(F.lit(0), x["start"] - state["at"]))
        return F.when(x["start"] < state["at"], state).otherwise(F.struct(x["end"].alias("at"), F.concat(state["out"], gap, F.lit(mark.split("{}")[0]), x["kind"], F.lit(mark.split("{}")[1])).alias("out")))

    done = F.aggregate(F.array_sort(parsed), start, step)
    return spans.select(*[F.when(F.length("spans") > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text).alias("text") if c == "text" else F.col(f"whole_row.{c}").alias(c) for c in docs.columns])
