"""Column layouts of the tables the package reads and writes."""

from pyspark.sql import types as T

EXAMPLES = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("user_prompt", T.StringType()),
    T.StructField("assistant_text", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("source_path", T.StringType()),
])

MEAN_COLUMNS = ("example_id", "domain", "y", "x")
TOKEN_COLUMNS = ("example_id", "domain", "y", "token_position", "x")

BANK = T.StructType([
    T.StructField("scope", T.StringType()),
    T.StructField("row_id", T.IntegerType()),
    T.StructField("row_name", T.StringType()),
    T.StructField("k", T.IntegerType()),
    T.StructField("bias_from_probe", T.DoubleType()),
    T.StructField("alpha", T.DoubleType()),
    T.StructField("positive_label", T.StringType()),
    T.StructField("split_source", T.StringType()),
    T.StructField("row", T.ArrayType(T.DoubleType())),
    T.StructField("length", T.DoubleType()),         # of the weights that row is the direction of
    T.StructField("converged", T.BooleanType()),
    T.StructField("passes", T.IntegerType()),
    T.StructField("gradient_norm", T.DoubleType()),  # where the fit ended
    T.StructField("n_rows", T.LongType()),
    T.StructField("n_left_out", T.LongType()),       # rows without a label of 0 or 1
])

# One row per task, scope and block of a vector of partial sums.
PARTIAL_SUMS = "scope_id int, block int, part array<double>"

ALPHA_HISTORY = T.StructType([
    T.StructField("scope", T.StringType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("val_auroc", T.DoubleType()),
    T.StructField("act_scale", T.DoubleType()),
    T.StructField("row_scale", T.DoubleType()),
    T.StructField("identity_penalty", T.DoubleType()),
    T.StructField("bit_balance_penalty", T.DoubleType()),
])
