"""Attribute, address and identifier functions as Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The accepted house numbers, blanks taken out: digits and at most one letter, or a span of two of these.
_HOUSE = r"[0-9]+[A-Za-z]?([-/][0-9]+[A-Za-z]?)?"
#: Marks a table value that stands for "not a building of its own" (fixed value).
EXCLUDE = "-"


def not_blank(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def _street_and_numbers(part: Column) -> Column:
    """struct<street, numbers> of "street n, n, ...": the street is null if there is none or no number.

    The first of the comma tokens holds the street and the first number: its words are taken as number from the earliest one
    after the first from which all that follows is a house number. Every other token must be a number as a whole.
    """

    def of(tokens: Column) -> Column:
        words = F.split(F.trim(tokens[0]), " ")
        rest = F.transform(F.slice(tokens, 2, F.greatest(F.lit(1), F.size(tokens))), lambda t: F.replace(t, F.lit(" "), F.lit("")))

        def cut(w: Column) -> Column:
            tail = lambda k: F.array_join(F.slice(w, k, F.size(w)), "")
            at = F.array_min(F.filter(F.sequence(F.lit(2), F.greatest(F.size(w), F.lit(2))), lambda k: (k <= F.size(w)) & tail(k).rlike(f"^{_HOUSE}$")))
            good = at.isNotNull() & F.forall(rest, lambda n: n.rlike(f"^{_HOUSE}$"))
            return F.when(good, F.struct(F.array_join(F.slice(w, F.lit(1), at - 1), " ").alias("street"), F.concat(F.array(tail(at)), rest).alias("numbers"))).otherwise(F.struct(F.lit(None).cast("string").alias("street"), F.array().cast("array<string>").alias("numbers")))

        return F.get(F.transform(F.array(words), cut), F.lit(0))

    return F.get(F.transform(F.array(F.split(part, ",")), of), F.lit(0))


def parse_address(text: Column) -> Column:
    """struct<street, housenumber, problem>; problem is null, 'number' (a part without one) or 'streets' (several)."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda g: F.trim(F.regexp_replace(g, r"\s+", " "))), lambda t: t != "")
    read = F.transform(parts, _street_and_numbers)
    streets = F.array_distinct(F.transform(read, lambda r: r["street"]))
    numbers = F.flatten(F.transform(read, lambda r: r["numbers"]))
    fails = F.exists(read, lambda r: r["street"].isNull())
    problem = F.when(fails, "number").when(F.size(streets) > 1, "streets")
    good = problem.isNull() & (F.size(parts) > 0)
    return F.struct(F.when(good, streets[0]).alias("street"), F.when(good, F.array_join(numbers, ";")).alias("housenumber"), F.when(F.size(parts) > 0, problem).alias("problem"))


def positive_integer(text: Column) -> Column:
    """Whole numbers from 1 to 999, decimal comma allowed; else null. Plain decimal notation only."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit("."))
    number = F.when(plain.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), plain.cast("double"))
    return F.when((number >= 1) & (number < 1000) & (number == F.rint(number)), number.cast("int"))


def lookup(value: Column, table: dict[str, str]) -> Column:
    """Case-insensitive, trimmed lookup in a small literal map."""
    if not table:
        return F.lit(None).cast("string")
    entries = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k.strip().lower(), v)])
    return F.when(not_blank(value), F.try_element_at(entries, F.lower(F.trim(value))))


def first_lookup(values: list[Column], table: dict[str, str]) -> Column:
    """The first attribute that is not blank and in the table decides."""
    return F.coalesce(*[lookup(v, table) for v in values], F.lit(None).cast("string"))


def matches_filter(value: Column, pattern: str) -> Column:
    """Found anywhere, letter case aside; null values, empty and invalid patterns never match."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return F.coalesce(value.rlike(f"(?iu){pattern}"), F.lit(False)) if pattern else F.lit(False)


def crs_code(text: Column) -> Column:
    """EPSG:n from its short, URN and URL forms; anything else in capitals."""
    t = F.trim(text)
    number = F.regexp_extract(t, r"(?i)EPSG(?::+|/\d+/)(\d+)$", 1)
    return F.when(number != "", F.concat(F.lit("EPSG:"), number)).otherwise(F.upper(t))


def service_url(text: Column) -> Column:
    """For comparison: no query, no closing slashes, https, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), r"\?.*$", ""), "/+$", ""), "^(?i)http://", "https://"))


def error_snippet(body: Column, most: int = 300) -> Column:
    """Markup taken out, spaces collapsed, cut."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), r"\s+", " ")), 1, most)


def csv_field(text: Column) -> Column:
    """A log field: line ends become spaces; quoted only if it holds a semicolon or a quote."""
    t = F.translate(F.coalesce(text, F.lit("")), "\n\r", "  ")
    return F.when(t.contains(";") | t.contains('"'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def csv_number(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), "").otherwise(F.format_string("%.4f", value))


@dataclass(frozen=True)
class Rule:
    """One attribute rule of a service profile. kind: BUILDING, DIRECT, INTEGER, TABLE or ADDRESS."""

    attribute: str
    key: str
    kind: str
    table: dict[str, str] = field(default_factory=dict)
    enabled: bool = True


@dataclass(frozen=True)
class Mapping:
    """Building lookup: attributes tried in order, the table and its default."""

    attributes: tuple[str, ...]
    table: dict[str, str]
    default: str = "yes"


TAG = "array<struct<key:string,value:string,origin:string>>"


def mapped_tags(attrs: Column, rules: list[Rule], mapping: Mapping, filters: list[tuple[str, str]] = ()) -> Column:
    """struct<tags, hints, excluded> of an attribute map under a profile's rules, in the rules' order.

    A building tag is always there: without a BUILDING rule `building=yes` comes first.
    """
    of = lambda name: F.try_element_at(attrs, F.lit(name))
    tags, hints = [], []
    excluded = [F.when(matches_filter(of(a), p), F.lit(f"filter {a}")) for a, p in filters]
    tag = lambda key, value, origin: F.struct(F.lit(key).alias("key"), value.alias("value"), origin.alias("origin"))
    none = F.lit(None).cast("struct<key:string,value:string,origin:string>")
    active = [r for r in rules if r.enabled]
    if not any(r.kind == "BUILDING" for r in active):
        tags.append(tag("building", F.lit("yes"), F.lit("default")))
    for r in active:
        raw = of(r.attribute)
        origin = F.concat(F.lit(f"{r.attribute}="), F.trim(raw))
        usable = not_blank(raw) & F.lit(bool(r.key.strip()))
        if r.kind == "BUILDING":
            found = first_lookup([of(a) for a in mapping.attributes], mapping.table)
            excluded.append(F.when(found == EXCLUDE, F.lit("not a building of its own")))
            tags.append(tag("building", F.coalesce(found, F.lit(mapping.default)), F.when(found.isNotNull(), F.lit("table")).otherwise("default")))
            shown = F.coalesce(*[F.when(not_blank(of(a)), of(a)) for a in mapping.attributes])
            hints.append(F.when(found.isNull() & shown.isNotNull(), F.concat(F.lit("unknown building function: "), shown)))
        elif r.kind == "DIRECT":
            tags.append(F.when(usable, tag(r.key.strip(), F.trim(raw), origin)).otherwise(none))
        elif r.kind == "INTEGER":
            n = positive_integer(raw)
            tags.append(F.when(usable & n.isNotNull(), tag(r.key.strip(), n.cast("string"), origin)).otherwise(none))
            hints.append(F.when(usable & n.isNull(), F.concat(F.lit(f"{r.attribute} is no positive whole number: "), raw)))
        elif r.kind == "TABLE":
            v = lookup(raw, r.table)
            tags.append(F.when(usable & not_blank(v) & (v != EXCLUDE), tag(r.key.strip(), F.trim(v), origin)).otherwise(none))
        elif r.kind == "ADDRESS":
            a = parse_address(raw)
            for part in ("street", "housenumber"):
                tags.append(F.when(a[part].isNotNull(), tag(f"addr:{part}", a[part], origin)).otherwise(none))
            hints.append(F.when(a["problem"].isNotNull(), F.concat(F.lit("address not taken over: "), F.trim(raw))))
    clean = lambda items, kind: F.filter(F.array(*items).cast(kind), lambda x: x.isNotNull()) if items else F.array().cast(kind)
    return F.struct(clean(tags, TAG).alias("tags"), clean(hints, "array<string>").alias("hints"), F.coalesce(*excluded, F.lit(None).cast("string")).alias("excluded"))


PROPOSAL = "array<struct<key:string,value:string,origin:string,existing:string,selected:boolean,conflict:boolean>>"


def reconciled(tags: Column, existing: Column) -> Column:
    """Proposals against the partner's tags: any existing value deselects, a different one is a conflict."""

    def one(t: Column) -> Column:
        old = F.try_element_at(existing, t["key"])
        return F.struct(t["key"].alias("key"), t["value"].alias("value"), t["origin"].alias("origin"), old.alias("existing"), old.isNull().alias("selected"), F.coalesce(old != t["value"], F.lit(False)).alias("conflict"))

    return F.transform(tags, one)


def tag_changes(proposals: Column, existing: Column) -> Column:
    """map of the tags to set: selected, not blank and different from what is there."""
    wanted = F.filter(proposals, lambda t: t["selected"] & not_blank(t["value"]) & ~t["value"].eqNullSafe(F.try_element_at(existing, t["key"])))
    return F.map_from_entries(F.transform(wanted, lambda t: F.struct(t["key"], t["value"])))


def title(function: Column, street: Column, housenumber: Column) -> Column:
    """What a review list shows: function, then the address."""
    return F.concat_ws(", ", F.when(not_blank(function), function), F.when(not_blank(street), F.concat_ws(" ", street, housenumber)))


def map_label(tags: Column) -> Column:
    """What a review list shows for a map-only building: its name, else its kind, then the address."""
    of = lambda k: F.try_element_at(tags, F.lit(k))
    return title(F.coalesce(of("name"), of("building")), of("addr:street"), of("addr:housenumber"))


def title_list(titles: Column) -> Column:
    """Up to four titles joined, of more the first three and how many others there are."""
    n = F.size(titles)
    quoted = F.transform(titles, lambda t: F.concat(F.lit("'"), t, F.lit("'")))
    last = F.concat(F.array_join(F.slice(quoted, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(quoted, -1))
    few = F.when(n == 0, F.lit("")).when(n == 1, quoted[0]).otherwise(last)
    return F.when(n <= 4, few).otherwise(F.concat(F.array_join(F.slice(quoted, 1, 3), ", "), F.lit(" and "), (n - 3).cast("string"), F.lit(" more")))


def changeset_source(existing: Column, source: str) -> Column:
    """The change set's source, appended once."""
    return F.when(~F.coalesce(not_blank(existing), F.lit(False)), source).when(F.array_contains(F.split(existing, ";"), source), existing).otherwise(F.concat_ws(";", existing, F.lit(source)))


def has_feature_type(capabilities: Column, type_name: Column) -> Column:
    """Whether a service's capabilities text names a feature type, with its own prefix, another one or none."""
    local = F.substring_index(type_name, ":", -1)
    named = lambda before, name: F.contains(capabilities, F.concat(F.lit(before), name, F.lit("<")))
    return named(">", type_name) | named(":", local) | named(">", local)


def joined_lookup(df: DataFrame, attributes: list[str], table: DataFrame, default: str = "yes") -> DataFrame:
    """df plus building and matched by a lookup table (key in lower case, value) of any size: the first of the attributes that is in
    the table decides. A join for each attribute; Spark broadcasts a table that is small enough."""
    out = df
    for k, a in enumerate(attributes):
        keyed = table.select(F.col("key").alias(f"k_key{k}"), F.col("value").alias(f"k_value{k}"))
        out = out.join(keyed, F.lower(F.trim(df[a])) == F.col(f"k_key{k}"), "left")
    found = F.coalesce(*[F.col(f"k_value{k}") for k in range(len(attributes))])
    return out.select(*[df[c] for c in df.columns], F.coalesce(found, F.lit(default)).alias("building"), found.isNotNull().alias("matched"))
