"""Schemas of the canonical tables, with defaults that readers of partial rows fill in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

_TYPES = {"string": T.StringType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "array<float>": T.ArrayType(T.FloatType())}


def _schema(text: str) -> StructType:
    """A schema of columns as \"name type\"; needs no session."""
    fields = []
    for column in text.split(", "):
        name, kind = column.split(" ")
        numbers = kind.removeprefix("decimal(").rstrip(")").split(",")
        fields.append(T.StructField(name, _TYPES[kind] if kind in _TYPES else T.DecimalType(*map(int, numbers))))
    return StructType(fields)


# Column names and types of the universal bill-of-materials tables, and of those of the embeddings.
MATERIALS = _schema(
    "material_id string, material_number string, description string, material_type string, material_group string, procurement_type string, base_uom string, weight decimal(12,4), cost_per_unit decimal(12,4), source_system string, is_active boolean, created_at timestamp"
)
BOM_HEADER = _schema(
    "bom_id string, source_system string, source_bom_id string, parent_material_id string, bom_type string, alternative_number string, revision string, base_quantity decimal(18,6), base_uom string, valid_from date, valid_to date, plant_id string, is_approved boolean, created_at timestamp"
)
BOM_COMPONENT = _schema(
    "component_id string, bom_id string, line_number int, child_material_id string, quantity_per decimal(18,6), quantity_uom string, is_fixed_quantity boolean, scrap_percent decimal(8,4), effective_from date, effective_to date, component_type string, supply_type string, operation_sequence int, is_alternative boolean, alternative_group string, created_at timestamp"
)
MATERIAL_EMBEDDINGS = _schema(
    "material_id string, jaccard_embedding array<float>, structural_embedding array<float>, textual_embedding array<float>, transactional_embedding array<float>, combined_embedding array<float>, updated_at timestamp, num_components int"
)
FEATURE_MAPPING = _schema("feature_index int, feature_name string, category string, description string, is_advanced boolean, created_at timestamp")
EMBEDDINGS_DIRTY = _schema("material_id string, reason string, marked_at timestamp")
STATISTICS = _schema("feature_name string, feature_index int, feature_category string, mean_value double, std_value double, min_value double, max_value double, num_samples long, updated_at timestamp, version int")
_DEFAULT_VALUES = {"base_quantity": 1, "scrap_percent": 0, "is_approved": False, "is_active": True, "is_fixed_quantity": False, "is_alternative": False, "is_advanced": False}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """df with the columns and types of a schema; missing columns and null values take the defaults."""
    have = set(df.columns)
    out = []
    for f in schema:
        c = (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType)
        if f.name in _DEFAULT_VALUES:
            c = F.coalesce(c, F.lit(_DEFAULT_VALUES[f.name]).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def violations(materials: DataFrame, header: DataFrame, component: DataFrame) -> DataFrame:
    """(rule, key, n): repeated keys, and references to what isn't there, which Spark tables don't forbid."""
    repeated = lambda df, key, rule: df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), "key", "n")

    def orphans(df: DataFrame, key: str, of: DataFrame, of_key: str, rule: str) -> DataFrame:
        return df.select(F.col(key).alias("key")).join(of.select(F.col(of_key).alias("key")), "key", "left_anti").groupBy("key").agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "key", "n")

    parts = [
        repeated(materials, "material_id", "materials_pk"),
        repeated(header, "bom_id", "bom_header_pk"),
        repeated(component, "component_id", "bom_component_pk"),
        orphans(header, "parent_material_id", materials, "material_id", "header_parent_fk"),
        orphans(component, "bom_id", header, "bom_id", "component_bom_fk"),
        orphans(component, "child_material_id", materials, "material_id", "component_child_fk"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of equal key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
