"""Scope patterns, keys and paths."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, functions as F

from catalogue import query, table
from reconcile import definitions, filters, keys

PART_NAMES = "lower(replace(p_brand, '#', '_')) AS d, 't' || CAST(p_partkey AS string) AS t"
TARGETS = [
    "brand_1.t1", "brand_1.t16", "brand_2.*", "brand_3.*", "*.t7", "*.t1999", "brand_4*.t1*", "*_5.*5", "br*_7.t*0*",
    "*9.t9*9", "*_2*.*33*", "malformed", "too.many.parts", "", "BRAND_8.*", "brand_.*", "brand-9.*", ".t8", "brand_8.",
]


@query(f"""SELECT d, t FROM (SELECT {PART_NAMES} FROM part) WHERE (d = 'brand_1' AND t IN ('t1', 't16'))
  OR d IN ('brand_2', 'brand_3') OR t IN ('t7', 't1999') OR (starts_with(d, 'brand_4') AND starts_with(t, 't1'))
  OR (ends_with(d, '_5') AND ends_with(t, '5')) OR (regexp_full_match(d, 'br.*_7') AND regexp_full_match(t, 't.*0.*'))
  OR (ends_with(d, '9') AND regexp_full_match(t, 't9.*9')) OR (contains(d, '_2') AND contains(t, '33'))""")
def target_filter(spark, sf_dir):
    named = table(spark, sf_dir, "part").select(F.expr("lower(replace(p_brand, '#', '_')) AS d"), F.expr("'t' || p_partkey AS t"))
    return named.where(filters.target_predicate(TARGETS, F.col("d"), F.col("t")))


# A table of patterns that grows with the data: plain names, whole databases,
# one member everywhere, and wildcards in one half or both.
SMALL_PATTERNS = [
    "SELECT 'brand_' || CAST(r_regionkey AS string) || '.*' AS pattern FROM region",
    "SELECT 'brand_' || CAST(n_nationkey AS string) || '.t*' || CAST(n_regionkey AS string) AS pattern FROM nation",
    "SELECT '*' || CAST(n_nationkey AS string) || '.t*' || CAST(n_nationkey AS string) || '*' AS pattern FROM nation",
]
PATTERNS = [
    *SMALL_PATTERNS,
    "SELECT lower(replace(p_brand, '#', '_')) || '.t' || CAST(p_partkey AS string) AS pattern FROM part WHERE p_type = 'PROMO'",
    "SELECT '*.t' || CAST(s_suppkey AS string) AS pattern FROM supplier",
    "SELECT p_name AS pattern FROM part",
]
HALVES = """SELECT DISTINCT regexp_replace(regexp_escape(split_part(pattern, '.', 1)), '\\\\\\*', '.*', 'g') AS pd,
  regexp_replace(regexp_escape(split_part(pattern, '.', 2)), '\\\\\\*', '.*', 'g') AS pt FROM patterns WHERE len(string_split(pattern, '.')) = 2"""


def _semi_sql(patterns: list[str]) -> str:
    return f"""WITH patterns AS ({' UNION ALL '.join(patterns)}), halves AS ({HALVES})
      SELECT d, t FROM (SELECT {PART_NAMES} FROM part)
      WHERE EXISTS (SELECT 1 FROM halves WHERE regexp_full_match(d, pd) AND regexp_full_match(t, pt))"""


def _semi_join(spark, sf_dir, patterns):
    given = {name: table(spark, sf_dir, name) for name in ("part", "region", "supplier", "nation")}

    def sql(text: str):
        # Tables are named by {name}; no view is left behind in the session.
        used = {name: df for name, df in given.items() if re.search(rf"FROM {name}\b", text)}
        return spark.sql(re.sub(r"FROM (\w+)", r"FROM {\1}", text), **used)

    named = sql(f"SELECT {PART_NAMES} FROM part")
    chosen = functools.reduce(DataFrame.unionByName, map(sql, patterns))
    return filters.target_semi_join(named, chosen, "d", "t")


@query(_semi_sql(SMALL_PATTERNS))
def target_semi_join(spark, sf_dir):
    return _semi_join(spark, sf_dir, SMALL_PATTERNS)


@query(_semi_sql(PATTERNS))
def target_semi_join_joined(spark, sf_dir):
    return _semi_join(spark, sf_dir, PATTERNS)


NULL_NAMES = """SELECT CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE lower(replace(p_brand, '#', '_')) END AS d,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 't' || CAST(p_partkey AS string) END AS t FROM part"""


@query(f"""SELECT d, t FROM ({NULL_NAMES}) WHERE coalesce(d IN (SELECT 'brand_' || CAST(r_regionkey AS string) FROM region), false)
  OR coalesce(t IN (SELECT 't' || CAST(s_suppkey AS string) FROM supplier), false)""")
def target_semi_join_nulls(spark, sf_dir):
    """Unknown databases and members: a lone star takes them, nothing else does."""
    named = table(spark, sf_dir, "part").selectExpr(
        "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE lower(replace(p_brand, '#', '_')) END AS d",
        "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 't' || CAST(p_partkey AS string) END AS t",
    )
    databases = table(spark, sf_dir, "region").selectExpr("'brand_' || CAST(r_regionkey AS string) || '.*' AS pattern")
    members = table(spark, sf_dir, "supplier").selectExpr("'*.t' || CAST(s_suppkey AS string) AS pattern")
    return filters.target_semi_join(named, databases.unionByName(members), "d", "t")


URL_KEY = "regexp_replace(url, '[?#].*', '') || '.sql'"


@query(f"""SELECT page_id, CASE WHEN ok THEN d END AS database_name, CASE WHEN ok THEN t END AS table_name FROM (
  SELECT *, regexp_full_match(d, '[\\p{{L}}\\p{{N}}_-]+') AND regexp_full_match(t, '[\\p{{L}}\\p{{N}}_-]+') AS ok FROM (
  SELECT page_id, string_split(p, '/')[-2] AS d, replace(string_split(p, '/')[-1], '.sql', '') AS t FROM (SELECT page_id, {URL_KEY} AS p FROM pages)))""")
def key_parse(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    key = keys.key_from_path(F.expr(URL_KEY))
    return pages.select("page_id", key["database_name"].alias("database_name"), key["table_name"].alias("table_name"))


@query("""SELECT p_partkey, regexp_full_match(p_name, '[\\p{L}\\p{N}_-]+') AS by_name, true AS by_underscore,
  regexp_full_match(p_brand, '[\\p{L}\\p{N}_-]+') AS by_brand FROM part""")
def identifier_check(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", keys.is_identifier(F.col("p_name")).alias("by_name"),
        keys.is_identifier(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("by_underscore"),
        keys.is_identifier(F.col("p_brand")).alias("by_brand"),
    )


SPLIT = "CASE WHEN p_type = 'PROMO' THEN p_brand WHEN p_type = 'SMALL' THEN p_brand || '.' || p_type || '.x' ELSE p_brand || '.' || p_name END"


@query("""SELECT p_partkey, CASE WHEN p_type NOT IN ('PROMO', 'SMALL') THEN p_brand END AS database_name,
  CASE WHEN p_type NOT IN ('PROMO', 'SMALL') THEN p_name END AS table_name, p_brand || '.' || p_name AS qualified FROM part""")
def split_key(spark, sf_dir):
    part, key = table(spark, sf_dir, "part"), keys.split_key(F.expr(SPLIT))
    return part.select(
        "p_partkey", key["database_name"].alias("database_name"), key["table_name"].alias("table_name"),
        keys.qualified_name("p_brand", "p_name").alias("qualified"),
    )


@query("""SELECT p_partkey, CASE WHEN ok THEN 'bucket-' || p_type END AS bucket,
  CASE WHEN ok THEN p_name || '/' || p_brand END AS key FROM (SELECT *, p_size > 10 AS ok FROM part)""")
def split_location(spark, sf_dir):
    url = F.expr("""CASE WHEN p_size > 10 THEN 's3://bucket-' || p_type || '/' || p_name || '/' || p_brand
      WHEN p_size > 6 THEN 's3://bucket-' || p_type || '/' WHEN p_size > 3 THEN 's3:///' || p_name ELSE 'http://' || p_type || '/' || p_name END""")
    place = definitions.split_location(url)
    return table(spark, sf_dir, "part").select("p_partkey", place["bucket"].alias("bucket"), place["key"].alias("key"))


@query("""SELECT p_partkey, CASE WHEN p_size > 5 THEN '/corpus/' || lower(replace(p_brand, '#', '_')) || '/t' ||
  CAST(p_partkey AS string) || '.sql' END AS path FROM part""")
def definition_path(spark, sf_dir):
    database = F.expr("CASE WHEN p_size > 5 THEN lower(replace(p_brand, '#', '_')) ELSE p_brand END")
    name = F.expr("'t' || CAST(p_partkey AS string)")
    return table(spark, sf_dir, "part").select("p_partkey", keys.definition_path("/corpus/", database, name).alias("path"))
