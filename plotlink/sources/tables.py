"""Lookup tables, profiles, the decision log and change sets."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlink.functions import text as X

LOG_COLUMNS = ("time", "profile", "id", "function", "match_class", "iou", "hausdorff", "score", "map_score", "offset", "recommendation", "decision", "duration_ms", "hints")


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a `key;value` text table: # comments, split at the last semicolon, malformed lines skipped,
    of repeated keys (letter case aside) the last line holds."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    rows = lines.where(~F.ltrim("value").startswith("#")).select("at", F.trim(F.regexp_extract("value", r"^(.*);([^;]*)$", 1)).alias("key"), F.trim(F.regexp_extract("value", r"^(.*);([^;]*)$", 2)).alias("v")).where("key <> '' and v <> ''")
    return rows.groupBy(F.lower("key").alias("key")).agg(F.max_by("v", "at").alias("value"))


@dataclass
class Profile:
    """A service profile; fields missing in JSON get these defaults."""

    name: str = ""
    url: str = ""
    version: str = "2.0.0"
    type_name: str = ""
    crs: str = "EPSG:25832"
    id_attribute: str = "gml:id"
    page_size: int = 1000
    swap_axes: bool = False
    image_url: str = ""
    filters: list[dict] = field(default_factory=list)
    rules: list[dict] = field(default_factory=lambda: [{"attribute": "function", "key": "building", "kind": "BUILDING"}])
    lookup_attributes: list[str] = field(default_factory=lambda: ["function"])
    lookup: dict[str, str] = field(default_factory=dict)
    default: str = "yes"

    def mapping(self) -> tuple[list[X.Rule], X.Mapping, list[tuple[str, str]]]:
        return [X.Rule(**r) for r in self.rules], X.Mapping(tuple(self.lookup_attributes), self.lookup, self.default), [(f["attribute"], f["pattern"]) for f in self.filters]


def load_profiles(text: str) -> list[Profile]:
    """From a JSON array or a single object; unknown members are ignored."""
    data = json.loads(text)
    known = {f.name for f in fields(Profile)}
    return [Profile(**{k: v for k, v in d.items() if k in known and v is not None}) for d in (data if isinstance(data, list) else [data])]


def dump_profiles(profiles: list[Profile], pretty: bool = True) -> str:
    return json.dumps([asdict(p) for p in profiles], ensure_ascii=False, indent=2 if pretty else None)


def add_missing(profiles: list[Profile], defaults: list[Profile]) -> list[Profile]:
    have = {p.name for p in profiles}
    return profiles + [d for d in defaults if d.name not in have]


def log_lines(decisions: DataFrame) -> DataFrame:
    """Text fields of the decision log, in its order; missing numbers are empty, never shown is -1."""
    number, word = ("iou", "hausdorff", "score", "map_score", "offset"), ("profile", "id", "function", "match_class", "recommendation", "decision")
    cols = {c: X.csv_number(F.col(c)) for c in number} | {c: F.translate(F.coalesce(F.col(c), F.lit("")), "\n\r", "  ") for c in word}
    cols |= {"time": F.date_format("time", "yyyy-MM-dd'T'HH:mm:ssXXX"), "duration_ms": F.coalesce("duration_ms", F.lit(-1)).cast("string"), "hints": F.translate(F.array_join("hints", " | "), "\n\r", "  ")}
    return decisions.select(*[cols[c].alias(c) for c in LOG_COLUMNS])


def append_log(decisions: DataFrame, path: str) -> None:
    log_lines(decisions).write.mode("append").option("sep", ";").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} {'double' if c in ('iou', 'hausdorff', 'score', 'map_score', 'offset') else 'long' if c == 'duration_ms' else 'string'}" for c in LOG_COLUMNS)
    return spark.read.option("sep", ";").option("header", "true").option("escape", '"').schema(schema).csv(path)


def write_changes(changes: dict[str, DataFrame], path: str) -> None:
    """A change set: one Parquet table a kind of edit."""
    for name, df in changes.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def active_profile(profiles: list[Profile], name: str | None = None) -> Profile | None:
    """The newest profile of that name, else the first one; none if there is none."""
    return next((p for p in reversed(profiles) if p.name == name), profiles[0] if profiles else None)


def write_rates(rates: DataFrame, path: str) -> None:
    """Rates by threshold (evaluate.rates) as CSV, empty area for all areas together."""
    rates.select("threshold", "area", "tpr", "fpr", "n").write.mode("overwrite").option("header", "true").csv(path)


def rate_lines(rates: DataFrame) -> DataFrame:
    """threshold, area, line: the rates as rows of a text table, in percent."""
    percent = lambda c: F.format_string("%5.1f", 100 * F.col(c))
    return rates.select("threshold", "area", F.concat_ws(" | ", F.format_string("%.2f", "threshold"), F.coalesce("area", F.lit("all")), percent("tpr"), percent("fpr"), F.col("n").cast("string")).alias("line"))


def source_tag(existing: str | None, source: str) -> str:
    """The change set's source, appended once."""
    return source if not existing else existing if source in existing.split(";") else f"{existing};{source}"
