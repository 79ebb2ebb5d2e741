import pytest

from tessella import queries as core
from tests.conftest import DATA, assert_same


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert_same(core.queries()[name](spark, f"{DATA}/sf0.001"), duck("sf0.001").sql(core.oracle_sql()[name]))


@pytest.mark.parametrize("partitions", ["1", "13"])
@pytest.mark.parametrize("name", ["mix_batches", "epoch_permutation", "mix_stop_on_exhausted", "batch_drop_last"])
def test_results_do_not_depend_on_partitions(spark, duck, name, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert_same(core.queries()[name](spark, f"{DATA}/sf0.001"), duck("sf0.001").sql(core.oracle_sql()[name]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(core.queries()) <= set(e.queries())
