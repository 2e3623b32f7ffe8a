"""Results do not depend on the number of shuffle partitions:
ranks, budgets, shuffles and window draws are keyed, never positional."""
import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["c3_head_split", "d6_mixed_windows", "e10_epoch_batches",
                                  "f6_predictions", "g2_running_best"])
def test_same_rows_under_other_partitioning(spark, name):
    base = sorted(map(tuple, queries()[name](spark, SF).collect()), key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        other = sorted(map(tuple, queries()[name](spark, SF).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert base == other
