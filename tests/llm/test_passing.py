import pyarrow as pa
from pyspark.sql import functions as F

from tracewarden.llm.passing import attach, restored


def test_any_column_names_and_types_pass_through(spark):
    odd = spark.range(3).select(
        F.col("id").alias("row"), F.lit("t").alias("a b"), F.lit(1).alias("x`y"), F.lit("z").alias("text"), F.lit(None).alias("nothing"),
        F.array(F.struct(F.lit(1).alias("n m"))).alias("deep"), F.current_timestamp().alias("size"), F.lit(2).alias("dot.ted"),
    )
    found = attach(odd, "text", "size long, `other one` array<string>", lambda t: [pa.array([len(x.as_py()) for x in t], pa.int64()), pa.array([["k"]] * len(t), pa.list_(pa.string()))])
    assert found.columns == ["row", "size", "other one"]
    assert {r["size"] for r in found.collect()} == {1}
    back = restored(found, odd.columns, text=F.upper(found["row"].getField("text")))
    assert back.columns == odd.columns and {r.text for r in back.collect()} == {"Z"}
