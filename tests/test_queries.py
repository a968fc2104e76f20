import glob
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from assayer import queries as Q
from assayer.functions.text import megabytes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    if name not in Q.oracle_sql():
        assert got
        return
    rel = duck.sql(Q.oracle_sql()[name])
    names = rel.columns
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in rel.fetchall())


def test_dependency_join_of_whole_tables(spark, duck):
    """All of part, whatever its size, meets all of lineitem through the operator."""
    want = duck.sql("SELECT p_partkey, count(*) FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL").fetchall()
    got = [(r.p_partkey, int(r.description.split()[4])) for r in Q.dependency_vuln(spark, SF).collect()]
    assert sorted(got) == sorted(want)
    assert len(got) > spark.read.parquet(f"{SF}/part.parquet").where("p_size > 40").count()


def test_sizes_half_way_between_two_digits(spark, tmp_path):
    """Keys of larger tables: 131072 * 12345 bytes are 1543.125 MB, which the SQL writes with the even digit."""
    keys = [131072 * k for k in range(1, 17, 2)] + [131071, 131073, 131072 * 2**32 + 131072, -131072, 0, None]
    spark.createDataFrame([(k, 7) for k in keys], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = [tuple(r) for r in Q.names_and_sizes(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(con.execute(Q.oracle_sql()["names_and_sizes"]).fetchall(), key=repr)
    sizes = {k: size for k, _, _, size, _ in got}
    assert (sizes[131072], sizes[131072 * 3], sizes[None]) == ("1543.12 MB", "4629.38 MB", None)


def test_sizes_in_the_upload_form_go_up(spark):
    row = spark.range(1).select(megabytes(F.lit(131072 * 12345)), megabytes(F.lit(131072 * 12345), faithful=False)).first()
    assert tuple(row) == ("1543.13 MB", "1543.12 MB")


def test_entry_without_the_training_data_part():
    """The registry still imports when that subpackage and the pipeline are gone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name.startswith(('assayer.llm', 'corpus_pipeline')): raise ImportError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert q and e.oracle_sql().keys() <= q.keys() and not any(k.startswith('op') for k in q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
