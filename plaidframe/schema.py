"""Column layouts shared by all operators.

``bin1_id <= bin2_id`` always holds for stored pixels.  A zero cell is simply not
stored, a cell without a usable value is NULL, an unusable bin has a NULL weight.
"""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

BINS = T.StructType([
    T.StructField("bin_id", T.IntegerType(), False),
    T.StructField("chrom_idx", T.IntegerType(), False),
    T.StructField("chrom", T.StringType(), False),
    T.StructField("bin_start", T.IntegerType(), True),
    T.StructField("bin_end", T.IntegerType(), True),
    T.StructField("weight", T.DoubleType(), True),
])
PIXELS = T.StructType([
    T.StructField("bin1_id", T.IntegerType(), False),
    T.StructField("bin2_id", T.IntegerType(), False),
    T.StructField("count", T.DoubleType(), True),
])
STATES = T.StructType([
    T.StructField("bin_id", T.IntegerType(), False),
    T.StructField("probs", T.ArrayType(T.DoubleType()), True),
])


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}, have {df.columns}")
    return df
