"""Queries of attribute rules, addresses and identifiers, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlink.functions import text as X
from plotlink.operators import addresses
from plotlink.plans import layers

#: Address texts in all accepted forms and some that are not.
_ADDRESS_TEXT = """CASE c_custkey % 9 WHEN 0 THEN 'Elm  Street ' || c_custkey % 97 WHEN 1 THEN 'Oak Lane ' || c_custkey % 50 || ' a' WHEN 2 THEN 'Mill Road ' || c_custkey % 40 || ', ' || (c_custkey % 40 + 2)
 WHEN 3 THEN 'High Street ' || c_custkey % 30 || '-' || (c_custkey % 30 + 4) || ';High Street 7' WHEN 4 THEN 'North Road' WHEN 5 THEN 'A Street 1; B Street 2' WHEN 6 THEN '  ' WHEN 7 THEN 'Platz 12 / 14 b' ELSE NULL END"""
#: A small lookup of our own: building function to building tag; - is no building of its own.
_TABLE = {"economy anodized": "house", "Standard Polished": "garage", "promo burnished": "-", "small plated": "shed"}
_KEYS = "CASE p_partkey % 5 WHEN 0 THEN ' Economy Anodized' WHEN 1 THEN 'STANDARD polished ' WHEN 2 THEN 'Promo Burnished' WHEN 3 THEN '' ELSE 'unknown thing' END"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer(spark, sf_dir, f"SELECT c_custkey, c_nationkey, {_ADDRESS_TEXT} AS text FROM {{customer}}", "customer")


def address_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).withColumn("a", X.parse_address(F.col("text"))).select("c_custkey", "a.street", "a.housenumber", "a.problem")


def address_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _customers(spark, sf_dir).withColumn("a", X.parse_address(F.col("text"))).where("a.street is not null")
    c = parsed.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), "a.street", "a.housenumber", (F.col("c_custkey") % 700 * F.lit(1.0)).alias("cx"), (F.col("c_nationkey") * F.lit(2.0)).alias("cy"), (F.col("c_custkey") + 1).alias("partner"))
    m = parsed.where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("owner"), F.upper("a.street").alias("street"), "a.housenumber", (F.col("c_custkey") % 700 * F.lit(1.0)).alias("x"), (F.col("c_nationkey") * F.lit(2.0)).alias("y"))
    return addresses.existing_addresses(c, m).select("id", "existing")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer(spark, sf_dir, f"SELECT p_partkey AS id, p_type, p_size, {_KEYS} AS function FROM {{part}}", "part")


def building_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.first_lookup([F.col("function"), F.col("p_type")], _TABLE)
    return _parts(spark, sf_dir).select("id", F.coalesce(found, F.lit("yes")).alias("building"), found.isNotNull().alias("matched"), F.coalesce(found == X.EXCLUDE, F.lit(False)).alias("excluded"))


def exclude_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ~X.matches_filter(F.col("function"), "^ ?econ|burn") & ~X.matches_filter(F.col("function"), "([bad") & ~X.matches_filter(F.col("function"), "")
    return _parts(spark, sf_dir).where(keep).groupBy("function").agg(F.count(F.lit(1)).alias("n"))


_INTEGER = "CASE p_partkey % 8 WHEN 0 THEN '' || p_size WHEN 1 THEN p_size || ',0' WHEN 2 THEN p_size || '.5' WHEN 3 THEN '-' || p_size WHEN 4 THEN ' ' || p_size || ' ' WHEN 5 THEN '1e2' WHEN 6 THEN '0' ELSE '1000' END"


def integer_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer(spark, sf_dir, f"SELECT p_partkey AS id, {_INTEGER} AS text FROM {{part}}", "part").select("id", X.positive_integer(F.col("text")).alias("value"))


def value_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.lookup(F.col("function"), _TABLE)
    return _parts(spark, sf_dir).select("id", F.when(X.not_blank(v) & (v != X.EXCLUDE), v).alias("value"))


_RULES = [X.Rule("function", "building", "BUILDING"), X.Rule("floors", "building:levels", "INTEGER"), X.Rule("name", "name", "DIRECT"), X.Rule("off", "ref", "DIRECT", enabled=False)]
_ATTRS = "map('function', function, 'floors', cast(p_size as string), 'name', p_type, 'off', 'x')"


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.mapped_tags(F.expr(_ATTRS), _RULES, X.Mapping(("function",), _TABLE), [("name", "medium")])
    existing = F.when(F.col("id") % 3 == 0, F.expr("map('building', 'house', 'name', 'other')")).otherwise(F.expr("map('building:levels', cast(p_size as string))"))
    return _parts(spark, sf_dir).withColumn("m", m).withColumn("existing", existing)


def attribute_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mapped(spark, sf_dir)
    return m.select("id", F.array_join(F.transform("m.tags", lambda t: F.concat_ws("=", t["key"], t["value"])), "|").alias("tags"), F.size("m.hints").cast("long").alias("n_hints"), F.col("m.excluded").isNotNull().alias("excluded"))


def tag_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _mapped(spark, sf_dir).select("id", F.explode(X.reconciled(F.col("m.tags"), F.col("existing"))).alias("t"))
    return t.select("id", "t.key", "t.value", "t.existing", "t.selected", "t.conflict")


def tag_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mapped(spark, sf_dir)
    changes = X.tag_changes(X.reconciled(F.col("m.tags"), F.col("existing")), F.col("existing"))
    return m.select("id", F.explode(changes).alias("key", "value"))


def hint_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select(F.explode("m.hints").alias("hint")).groupBy("hint").agg(F.count(F.lit(1)).alias("n"))


_CODES = "CASE c_custkey % 5 WHEN 0 THEN 'epsg:25832' WHEN 1 THEN 'urn:ogc:def:crs:EPSG::25833' WHEN 2 THEN 'http://www.opengis.net/def/crs/EPSG/0/4326' WHEN 3 THEN ' crs84 ' ELSE NULL END"
_URLS = "CASE c_custkey % 4 WHEN 0 THEN 'HTTP://Example.org/Wfs//?a=b' WHEN 1 THEN ' https://example.org/wfs' WHEN 2 THEN 'http://example.org/?x' ELSE 'ftp://Example.org/' END"


def crs_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer(spark, sf_dir, f"SELECT c_custkey AS id, {_CODES} AS code FROM {{customer}}", "customer").select("id", X.crs_code(F.col("code")).alias("crs"))


def verified_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-join of services with the known ones on (normal form of the URL, type name)."""
    known = spark.createDataFrame([("https://example.org/wfs", "t0"), ("https://example.org", "t2")], "url string, type string")
    mine = layers.layer(spark, sf_dir, f"SELECT c_custkey AS id, {_URLS} AS url, 't' || c_custkey % 3 AS type FROM {{customer}}", "customer").withColumn("url", X.service_url(F.col("url")))
    return mine.join(F.broadcast(known), ["url", "type"], "left_semi").select("id", "url", "type")


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = layers.layer(spark, sf_dir, layers.LOG, "events")
    hints = F.when(F.col("seq") % 4 == 0, F.lit('a;"b"\nc')).when(F.col("seq") % 4 == 1, F.lit("plain"))
    line = F.concat_ws(";", X.csv_field(F.concat(F.lit("p"), F.col("profile").cast("string"))), F.col("id").cast("string"), X.csv_number(F.when(F.col("seq") % 3 > 0, F.col("score"))), F.col("decision"), X.csv_field(hints))
    return e.select("seq", line.alias("line"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("id", X.title(F.col("function"), F.when(F.col("id") % 2 == 0, "Elm Street"), F.col("p_size").cast("string")).alias("title"))


QUERIES = {f.__name__: f for f in (address_parse, address_exists, building_lookup, exclude_filter, integer_rule, value_table, attribute_mapping, tag_reconcile, tag_change_set, hint_histogram, crs_normalise, verified_profiles, log_rows, titles)}

_N = r"\d+(?: ?[a-zA-Z])?(?: ?[-/] ?\d+(?: ?[a-zA-Z])?)?"
_PARSED = rf"""
t AS (SELECT c_custkey, c_nationkey, list_filter(list_transform(string_split({_ADDRESS_TEXT}, ';'), lambda g: trim(regexp_replace(g, '\s+', ' ', 'g'))), lambda g: g <> '') AS parts FROM customer),
u AS (SELECT *, list_transform(parts, lambda g: regexp_extract(g, '^(.+?) ({_N}(?: ?, ?{_N})*)$', 1)) AS streets, list_transform(parts, lambda g: replace(replace(regexp_extract(g, '^(.+?) ({_N}(?: ?, ?{_N})*)$', 2), ' ', ''), ',', ';')) AS numbers FROM t),
a AS (SELECT c_custkey, c_nationkey, CASE WHEN len(parts) > 0 AND NOT list_contains(streets, '') AND len(list_distinct(streets)) = 1 THEN streets[1] END AS street,
             CASE WHEN len(parts) > 0 AND NOT list_contains(streets, '') AND len(list_distinct(streets)) = 1 THEN array_to_string(numbers, ';') END AS housenumber,
             CASE WHEN len(parts) > 0 THEN CASE WHEN list_contains(streets, '') THEN 'number' WHEN len(list_distinct(streets)) > 1 THEN 'streets' END END AS problem FROM u)"""
_V = f"lower(trim({_KEYS}))"
_CASE = "CASE " + " ".join(f"WHEN {_V} = '{k.lower()}' THEN '{v}'" for k, v in _TABLE.items()) + " END"
_CASE2 = f"coalesce({_CASE}, CASE " + " ".join(f"WHEN lower(trim(p_type)) = '{k.lower()}' THEN '{v}'" for k, v in _TABLE.items()) + " END)"
_TAGS = f"""
b AS (SELECT p_partkey AS id, p_type, p_size, {_KEYS} AS function, {_CASE} AS v FROM part),
t AS (SELECT id, 1 AS o, 'building' AS key, coalesce(v, 'yes') AS value FROM b UNION ALL SELECT id, 2, 'building:levels', p_size::VARCHAR FROM b WHERE p_size BETWEEN 1 AND 999
      UNION ALL SELECT id, 3, 'name', trim(p_type) FROM b WHERE trim(p_type) <> ''),
e AS (SELECT t.*, CASE WHEN t.id % 3 = 0 THEN CASE key WHEN 'building' THEN 'house' WHEN 'name' THEN 'other' END ELSE CASE key WHEN 'building:levels' THEN p_size::VARCHAR END END AS existing FROM t JOIN b USING (id))"""

ORACLES = {
    "address_parse": f"WITH {_PARSED} SELECT c_custkey, street, housenumber, problem FROM a",
    "address_exists": f"""WITH {_PARSED}, g AS (SELECT * FROM a WHERE street IS NOT NULL)
        SELECT c.c_custkey AS id, min(m.c_custkey) AS existing FROM g c LEFT JOIN g m ON c.c_custkey % 2 = 0 AND m.c_custkey % 2 = 1 AND lower(c.street) = lower(m.street) AND lower(c.housenumber) = lower(m.housenumber)
          AND m.c_custkey <> c.c_custkey + 1 AND sqrt((c.c_custkey % 700 - m.c_custkey % 700) ** 2 + (2 * c.c_nationkey - 2 * m.c_nationkey) ** 2) <= 50 WHERE c.c_custkey % 2 = 0 GROUP BY 1""",
    "building_lookup": f"SELECT p_partkey AS id, coalesce({_CASE2}, 'yes') AS building, {_CASE2} IS NOT NULL AS matched, coalesce({_CASE2} = '-', false) AS excluded FROM part",
    "exclude_filter": f"SELECT function, count(*) AS n FROM (SELECT {_KEYS} AS function FROM part) WHERE NOT regexp_matches(function, '(?i)^ ?econ|burn') GROUP BY 1",
    "integer_rule": f"SELECT p_partkey AS id, CASE WHEN regexp_full_match(replace(trim({_INTEGER}), ',', '.'), '[+-]?(\\d+\\.?\\d*|\\.\\d+)') AND try_cast(replace(trim({_INTEGER}), ',', '.') AS DOUBLE) BETWEEN 1 AND 999 AND try_cast(replace(trim({_INTEGER}), ',', '.') AS DOUBLE) % 1 = 0 THEN try_cast(replace(trim({_INTEGER}), ',', '.') AS DOUBLE)::INTEGER END AS value FROM part",
    "value_table": f"SELECT p_partkey AS id, CASE WHEN {_CASE} <> '-' THEN {_CASE} END AS value FROM part",
    "attribute_mapping": f"WITH {_TAGS} SELECT id, string_agg(key || '=' || value, '|' ORDER BY o) AS tags, max(CASE WHEN v IS NULL AND trim(function) <> '' THEN 1 ELSE 0 END + CASE WHEN p_size BETWEEN 1 AND 999 THEN 0 ELSE 1 END)::BIGINT AS n_hints, bool_or(coalesce(v = '-', false) OR regexp_matches(p_type, '(?i)medium')) AS excluded FROM t JOIN b USING (id) GROUP BY id",
    "tag_reconcile": f"WITH {_TAGS} SELECT id, key, value, existing, existing IS NULL AS selected, coalesce(existing <> value, false) AS conflict FROM e",
    "tag_change_set": f"WITH {_TAGS} SELECT id, key, value FROM e WHERE existing IS NULL AND trim(value) <> ''",
    "hint_histogram": f"WITH {_TAGS} SELECT 'unknown building function: ' || function AS hint, count(*) AS n FROM b WHERE v IS NULL AND trim(function) <> '' GROUP BY 1",
    "crs_normalise": f"SELECT c_custkey AS id, CASE WHEN regexp_matches({_CODES}, '(?i)EPSG(?::+|/\\d+/)(\\d+)$') THEN 'EPSG:' || regexp_extract({_CODES}, '(?i)EPSG(?::+|/\\d+/)(\\d+)$', 1) ELSE upper(trim({_CODES})) END AS crs FROM customer",
    "verified_profiles": f"SELECT id, url, type FROM (SELECT c_custkey AS id, lower(regexp_replace(regexp_replace(regexp_replace(trim({_URLS}), '\\?.*$', ''), '/+$', ''), '(?i)^http://', 'https://')) AS url, 't' || c_custkey % 3 AS type FROM customer) WHERE (url, type) IN (('https://example.org/wfs', 't0'), ('https://example.org', 't2'))",
    "log_rows": f"""SELECT seq, 'p' || profile || ';' || id || ';' || CASE WHEN seq % 3 > 0 THEN printf('%.4f', score) ELSE '' END || ';' || decision || ';' || CASE seq % 4 WHEN 0 THEN '"a;""b"" c"' WHEN 1 THEN 'plain' ELSE '' END AS line FROM ({layers.oracle(layers.LOG)})""",
    "titles": f"SELECT id, concat_ws(', ', CASE WHEN trim(function) <> '' THEN function END, CASE WHEN id % 2 = 0 THEN 'Elm Street ' || p_size END) AS title FROM (SELECT p_partkey AS id, p_size, {_KEYS} AS function FROM part)",
}
