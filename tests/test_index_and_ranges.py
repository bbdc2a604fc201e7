"""The written search index and the greedy cut, against scans and loops."""

import glob
import random

import pytest
from compare import connect, rows_of_spark, rows_of_sql
from pyspark.sql import functions as F

from wayfold.operators import buckets, search_index
from wayfold.operators.ordering import greedy_ranges
from wayfold.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(1)
    words = ["Avenue", "Élan", "東京", "Cairo", "Lane", "Lake", "x", "9 Mile", "Ave", "大阪"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) + (f" {i}" if i % 2 else "")) for i in range(1500)]
    df = spark.createDataFrame(rows, "seq long, n string").cache()
    path = f"{tmp_path_factory.mktemp('index')}/i"
    search_index.write(df, path, "n", F.octet_length("n"), 4000)
    return df, path


@pytest.mark.parametrize("query", ["Avenue", "la", "elan", "東京", "9 Mi", "zz", "cairo 1"])
def test_lookups_equal_scans_and_open_one_prefix(spark, index, query):
    df, path = index
    found = search_index.lookup(spark, path, query, "n", df.schema)
    want = buckets.search(buckets.prefix_index(df, "n"), query).select("seq", "n")
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in want.collect()]
    prefix = search_index.prefix_of(spark, query)
    assert all(f"/prefix={prefix}/" in f for f in found.inputFiles())
    listed = search_index.chunks(spark, path, query).collect()
    assert len({f.split("/leaf=")[1].split("/")[0] for f in found.inputFiles()}) == len(listed)


def test_large_prefixes_have_sub_chunks(spark, index):
    df, path = index
    sizes = {(r.prefix, r.leaf): r.bytes for r in spark.read.parquet(f"{path}/manifest").collect()}
    assert sum(p == "av" for p, _ in sizes) > 1 and max(sizes.values()) <= 4000
    assert search_index.chunks(spark, path, "Avenue").agg(F.sum("n")).first()[0] == buckets.prefix_index(df, "n").where("prefix = 'av'").count()


def test_folders_are_dealt_to_tasks_by_their_number(spark, index):
    """Opening a file takes a task longer than its few bytes do: tasks write some sub-chunks each, however few bytes those are, and a folder holds one file."""
    _, path = index
    files = glob.glob(f"{path}/chunks/prefix=*/leaf=*/*.parquet")
    listed = spark.read.parquet(f"{path}/manifest").count()
    assert len(files) == len({f.rsplit("/", 1)[0] for f in files}) == listed > search_index._LEAVES
    assert len({f.rsplit("/", 1)[1].split("-")[1] for f in files}) > 1


def loop(rows, parts):
    share, out, start, count = sum(n for _, n in rows) / parts, [], 0, 0
    for i, (_, n) in enumerate(rows):
        count += n
        if count >= share and len(out) < parts - 1:
            out.append((start, i))
            start, count = i + 1, 0
    out.append((start, len(rows) - 1))
    return [(k, rows[a][0], rows[b][0], sum(n for _, n in rows[a : b + 1])) for k, (a, b) in enumerate(out) if a <= b]


@pytest.mark.parametrize("parts,n,most", [(1, 50, 5), (7, 200, 9), (32, 40, 3), (5, 3, 9), (8, 300, 1000), (16, 100, 0)])
def test_greedy_ranges_are_those_of_the_loop(spark, parts, n, most):
    rng = random.Random(n)
    rows = sorted((x, (0 if rng.random() < 0.2 else rng.randint(1, most) ** rng.choice([1, 1, 2])) if most else 1) for x in rng.sample(range(10_000), n))
    if rows[0][1] == 0:
        rows[0] = (rows[0][0], 1)
    rows = [(x, max(1, v)) for x, v in rows]
    df = spark.createDataFrame(rows, "x long, n long").repartition(3)
    assert sorted(tuple(r) for r in greedy_ranges(df, "x", "n", parts).collect()) == loop(rows, parts)


@pytest.mark.parametrize("name", ["q1_prefix_search", "w9_balanced_ranges", "w12_cell_adjacency"])
def test_queries(spark, name):
    folder = "/root/testdata/sf0.001"
    assert rows_of_spark(QUERIES[name](spark, folder)) == rows_of_sql(connect(folder), ORACLES[name])


@pytest.mark.parametrize("name", ["a9_cell_counts", "u2_junction_union", "j20_lookup_near_by_name", "w12_cell_adjacency", "g6_measure_path"])
def test_large_tables_are_dealt_by_rows(spark, monkeypatch, name):
    """Partitions follow the rows of the tables and hold about as many at any size; results are those of the SQL."""
    from compare import connect, rows_of_spark, rows_of_sql

    from wayfold import plans
    from wayfold.plans import tables

    folder, dealt = "/root/testdata/sf0.001", []
    monkeypatch.setattr(tables, "SHARE", 500)
    monkeypatch.setattr(tables, "LEAST", 0)
    parts = tables.Tables.parts
    monkeypatch.setattr(tables.Tables, "parts", lambda self, *a, **k: dealt.append(parts(self, *a, **k)) or dealt[-1])
    found = rows_of_spark(plans.QUERIES[name](spark, folder))
    assert found == rows_of_sql(connect(folder), plans.ORACLES[name])
    assert max(dealt) >= (4 if name[0] == "j" else 12)
