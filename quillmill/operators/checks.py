"""Data-quality checks. Each returns violations as (table, row_key, rule, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import strip, text


def _violations(df: DataFrame, name: str, key: Column, rule: str, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("table"), text(key).alias("row_key"), F.lit(rule).alias("rule"), text(detail).alias("detail"))


def required(df: DataFrame, name: str, fields: list[str], key: str = "id") -> DataFrame:
    """Fields that are null or blank; one row per field, all tested in one pass."""
    empty = F.filter(F.array(*[F.when(strip(text(f)) == "", F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    bad = df.select(F.col(key).alias("__key"), F.explode(empty).alias("__field"))
    return _violations(bad, name, F.col("__key"), "required", F.col("__field"))


def unique(df: DataFrame, name: str, key: str = "id") -> DataFrame:
    """Keys that occur more than once, with how often."""
    return _violations(df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1"), name, F.col("__key"), "unique", F.col("__n"))


def vocabulary(df: DataFrame, name: str, field: str, allowed: list[str], key: str = "id", prefix: str | None = None) -> DataFrame:
    """Values beyond a closed list; with a prefix, values that begin with it are free. Null is no violation."""
    good = F.col(field).isin(*allowed) | (F.startswith(F.col(field), F.lit(prefix)) if prefix else F.lit(False))
    return _violations(df.filter(~good), name, F.col(key), f"vocabulary:{field}", F.col(field))


def foreign_key(df: DataFrame, name: str, field: str, parent: DataFrame, parent_key: str = "id", key: str = "id") -> DataFrame:
    """Values without a parent. Null is no violation."""
    missing = df.select(F.col(key).alias("__key"), F.col(field).alias("__v")).filter("__v is not null").join(parent.select(F.col(parent_key).alias("__v")), "__v", "left_anti")
    return _violations(missing, name, F.col("__key"), f"foreign_key:{field}", F.col("__v"))


def disjoint(a: DataFrame, b: DataFrame, name: str, key: str = "id") -> DataFrame:
    """Keys that stand in both tables."""
    both = a.select(F.col(key).alias("__key")).join(b.select(F.col(key).alias("__key")), "__key", "left_semi").distinct()
    return _violations(both, name, F.col("__key"), "disjoint", F.lit(""))


def rejected_decisions(rejected: DataFrame, name: str = "rejected_items", key: str = "id") -> DataFrame:
    bad = rejected.filter(~F.col("local_decision.action").eqNullSafe("rejected"))
    return _violations(bad, name, F.col(key), "decision", F.col("local_decision.action"))


def shapes(raw: DataFrame, name: str, json_col: str, expected: dict[str, str], key: str = "id") -> DataFrame:
    """Nested fields of raw JSON records that are neither null nor of the expected kind: array or object."""
    value = lambda f: F.get_json_object(json_col, f"$.{f}")
    start = {"array": "[", "object": "{"}
    bad = F.filter(F.array(*[F.when(value(f).isNotNull() & ~F.startswith(F.ltrim(value(f)), F.lit(start[k])), F.lit(f)) for f, k in expected.items()]), lambda f: f.isNotNull())
    rows = raw.select(F.col(key).alias("__key"), F.explode(bad).alias("__field"))
    return _violations(rows, name, F.col("__key"), "shape", F.col("__field"))


def licence_records(raw: DataFrame, name: str, json_col: str, names: list[str], prefix: str, key: str = "id") -> DataFrame:
    """Licences of raw JSON records that are no object, bear a name neither listed nor with the free prefix, or have evidence or provenance that is no object
    or an attribution table that is no list; these three may be left out, but not be null. No licence, null or an empty object is no violation."""
    record = F.try_parse_json(json_col)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(record, path, "variant"))
    parts = [("license", "OBJECT"), ("license.evidence", "OBJECT"), ("license.attribution_table", "ARRAY"), ("license.provenance", "OBJECT")]
    rows = raw.select(F.col(key).alias("__key"), F.trim(F.try_variant_get(record, "$.license.name", "string")).alias("__name"), *[kind(f"$.{f}").alias(f"__{i}") for i, (f, _) in enumerate(parts)])
    rows = rows.filter("__0 is not null and __0 not in ('VOID', 'OBJECT<>')")
    wrong = F.array(*[F.when(~F.startswith(F.col(f"__{i}"), F.lit(k)), F.lit(f)) for i, (f, k) in enumerate(parts)])
    shaped = rows.select("__key", F.explode(F.filter(wrong, lambda f: f.isNotNull())).alias("__field"))
    named = vocabulary(rows.filter("__name != ''"), name, "__name", names, "__key", prefix)
    return _violations(shaped, name, F.col("__key"), "shape", F.col("__field")).unionByName(named.withColumn("rule", F.lit("vocabulary:license.name")))


def link_symmetry(links: DataFrame) -> DataFrame:
    """Edges without their mirror image: same relation, ends swapped, direction turned."""
    turned = F.when(F.col("direction") == "inbound", "outbound").otherwise("inbound")
    mirror = links.select(F.col("ref").alias("item_id"), F.col("item_id").alias("ref"), "relation", turned.alias("direction"))
    lonely = links.join(mirror, ["item_id", "ref", "relation", "direction"], "left_anti")
    return _violations(lonely, "material_links", F.col("id"), "symmetry", F.concat_ws(" ", "item_id", "relation", "ref", "direction"))


def all_of(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
