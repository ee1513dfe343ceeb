"""Table layouts shared by the stages."""

from __future__ import annotations

from pyspark.sql import types as T

SURVEY_CSV = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("MOP1", T.IntegerType()),
        T.StructField("MOP2", T.IntegerType()),
        T.StructField("beach", T.StringType()),
        T.StructField("method", T.StringType()),
    ]
)

RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))

POLYGONS = T.StructType(
    [
        T.StructField("location", T.StringType()),
        T.StructField("resolution", T.StringType()),
        T.StructField("polygon_id", T.LongType()),
        T.StructField("ring", RING),
    ]
)

CUTOFFS = T.StructType(
    [
        T.StructField("location", T.StringType()),
        T.StructField("resolution", T.StringType()),
        T.StructField("polygon_id", T.LongType()),
        T.StructField("cliff_top_z", T.DoubleType()),
    ]
)

# One interval of one site, sign of change and grid resolution.
INTERVAL = ["location", "mode", "d1", "d2", "resolution"]
CELL = INTERVAL + ["polygon_id", "z_idx"]
