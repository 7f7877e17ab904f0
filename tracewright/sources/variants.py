"""JSON of any shape as scalars of the data model, through Spark's variant type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S


def at(variant: Column, path: str, kind: str) -> Column:
    """The value at a path, null where it is absent or of another kind."""
    return F.try_variant_get(variant, path, kind)


def kind_of(variant: Column) -> Column:
    return F.schema_of_variant(variant)


def text_at(variant: Column, path: str) -> Column:
    """A string at a path; null where something else is there."""
    v = at(variant, path, "variant")
    return F.when(kind_of(v) == "STRING", v.try_cast("string"))


def scalar_of(v: Column) -> Column:
    """A variant as a scalar: objects and arrays as their JSON text, with keys in order; an absent one is null."""
    t = kind_of(v)
    return (
        F.when(v.isNull(), F.lit(None).cast(S.SCALAR))
        .when(t == "VOID", S.literal(None))
        .when(t == "STRING", S.text(v.try_cast("string")))
        .when(t == "BOOLEAN", S.boolean(v.try_cast("boolean").cast("string")))
        .when(t.startswith("OBJECT") | t.startswith("ARRAY"), S.text(F.to_json(v)))
        .otherwise(S.number(v.try_cast("double")))
    )


def scalars_of(v: Column) -> Column:
    """The members of a variant object as scalars; an empty map for anything else."""
    members = F.when(kind_of(v).startswith("OBJECT"), v.try_cast("map<string,variant>"))
    return F.coalesce(F.transform_values(members, lambda _, x: scalar_of(x)), no_scalars())


def no_scalars() -> Column:
    return F.create_map().cast(S.SCALARS)


def present(**members: Column) -> Column:
    """A map of the members that are not null; keys by argument, with ``__`` for a dot."""
    whole = F.map_from_arrays(F.array(*(F.lit(k.replace("__", ".")) for k in members)), F.array(*members.values()))
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def epoch_millis(text: Column) -> Column:
    """Milliseconds since 1970 of an ISO time, null where it is none."""
    return F.unix_millis(text.try_cast("timestamp"))


def plain_path(path: Column) -> Column:
    """A file's path without its scheme."""
    return F.regexp_replace(path, r"^file:(//)?", "")


def whole_files(spark, path: str):
    """(file, text) of every file that a path or glob names."""
    return spark.read.text(path, wholetext=True).select(plain_path(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("text"))
