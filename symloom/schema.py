"""The two relations and what derives from them: names, order and types are the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StringType, StructField, StructType

_S, _L, _D = StringType(), LongType(), DoubleType()


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


BLAST = _struct(direct_callers=_L, direct_files=_L, transitive_callers=_L)
ENTITY_SCHEMA = _struct(
    file=_S, name=_S, kind=_S, line_start=_L, line_end=_L, parent=_S, sig=_S, meta=ArrayType(_S), body_hash=_S, sig_hash=_S, struct_hash=_S, visibility=_S,
    rank=_D, blast_radius=BLAST, seq=_L,
)
REF_SCHEMA = _struct(file=_S, caller=_S, name=_S, kind=_S, line=_L, seq=_L)
PAIR_SCHEMA = _struct(a=_S, b=_S, weight=_D, support=_L)
RANK_SCHEMA = _struct(file=_S, rank=_D)

REF_KINDS = ("call", "import", "type_annotation", "instantiation")
IMPORT_KINDS = ("import", "use", "package")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with exactly the schema's columns: missing ones null, others dropped, types cast."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
