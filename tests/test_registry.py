import pytest
from oracle import compare

from lodestrata.plans import library, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    if name in registry.SQL:
        compare(spark, registry.QUERIES[name], registry.SQL[name], SF)
    else:
        assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_reconstruction_is_identical(spark):
    assert registry.QUERIES["archive_reconstruct"](spark, SF).where("containers <> identical").count() == 0
