import pytest

import __spark_entry__ as entry
from bundleloom.queries import QUERIES, SQL
from tests.compare import connect, same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert same(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) >= 1


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_deflate_matches_zlib(spark, sf_dir):
    import zlib

    from bundleloom.queries import docs_pack

    want = {r.rel: (zlib.crc32(r.data), len(r.data)) for r in docs_pack(spark, sf_dir).collect()}
    got = {r.rel: (r.crc, r.uncomp_size) for r in QUERIES["deflate_sizes"](spark, sf_dir).collect()}
    assert got == want
