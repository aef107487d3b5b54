"""Every registered archive query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from stowage import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    want = con.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_size_text_of_large_numbers_equals_its_sql(spark, sf_dir, tmp_path):
    keys = [1, 4, 5, 128, 4096, 131071, 131072, 600_000, 900_000]  # from 131072 on, a TiB and more
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'" if t == "customer" else f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = catalog.QUERIES["size_text"](spark, str(tmp_path))
    assert rows(df.columns, df.collect()) == rows(["c_custkey", "shown"], c.sql(catalog.ORACLES["size_text"]).fetchall())


def test_lru_simulation_equals_replay(spark, sf_dir):
    from collections import OrderedDict

    got = sorted((r["at"], r["block"], r["size"], r["hit"]) for r in catalog.QUERIES["lru_simulation"](spark, sf_dir).collect())
    cache, used = OrderedDict(), 0
    for _, block, size, hit in got:
        assert hit == (block in cache)
        if hit:
            cache.move_to_end(block)
            continue
        cache[block], used = size, used + size
        while used > 1 << 18 and len(cache) > 1:
            used -= cache.popitem(last=False)[1]


@pytest.mark.parametrize("name", ["path_exact_lookup", "child_by_name"])
def test_lookups_ask_for_every_file(spark, sf_dir, name):
    files = {r["path"] for r in catalog.V.files(spark, sf_dir).select("path").collect()}
    got = [r["path"] for r in catalog.QUERIES[name](spark, sf_dir).collect()]
    assert set(got) == files and len(got) == len(files)


def test_names_are_sorted_whole(spark):
    from stowage.operators.entries import sorted_by_name

    paths = [f"{d}\x1f{n}{k}" for k in range(60) for d, n in (("b", "Name"), ("a", "name"))]
    got = sorted_by_name(spark.createDataFrame([(p,) for p in paths], "path string")).orderBy("place").collect()
    assert [r["path"] for r in got] == sorted(paths, key=lambda p: (p.split("\x1f")[1].lower(), p))
    assert [r["place"] for r in got] == list(range(1, 121))


def test_trees_of_any_depth(spark):
    from stowage.operators.entries import tree_faults, tree_paths

    chain = [(k, k - 1 if k else None, f"n{k}") for k in range(200)]
    broken = [(1000, 1000, "self"), (1001, 1002, "a"), (1002, 1001, "b"), (1003, 9999, "lost"), (1004, 1003, "below")]
    nodes = spark.createDataFrame(chain + broken, "id long, parent_id long, name string")
    got = {r["id"]: r["path"] for r in tree_paths(nodes).collect()}
    assert got == {k: "\x1f".join(f"n{j}" for j in range(k + 1)) for k in range(200)}
    assert {r["id"] for r in tree_faults(nodes, tree_paths(nodes)).collect()} == {1000, 1001, 1002, 1003, 1004}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from stowage.plans import stage

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext = Context  # noqa: N815
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(RuntimeError, match="checkpoint"):
        stage.shared_dir(Session)


def test_entry_without_the_operators(tmp_path):
    """A copy whose operators can't be imported keeps its archive queries."""
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for gone in ("deleted", "broken"):
        to = tmp_path / gone
        to.mkdir()
        shutil.copy(f"{here}/__spark_entry__.py", to)
        shutil.copytree(f"{here}/stowage", to / "stowage", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        if gone == "broken":
            (to / "stowage" / "llm").mkdir()
            (to / "stowage" / "llm" / "__init__.py").write_text("import a_wheel_that_is_not_there\n")
        code = "import __spark_entry__ as e; assert len(e.queries()) > 90 and set(e.oracle_sql()) <= set(e.queries()); print('ok')"
        assert subprocess.run([sys.executable, "-c", code], cwd=to, capture_output=True, text=True, check=True).stdout.strip() == "ok"


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1
