"""Queries over whole relations, on small tables."""

import random

import duckdb

from plotlink.plans import catalogue


def test_alignment_groups(spark, tmp_path):
    rng = random.Random(1)
    lines = [(rng.randint(1, 12), rng.randint(1, 40), rng.randint(1, 7), float(rng.randint(1, 50))) for _ in range(60)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(1, 13)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    want = set()
    for start in range(1, 13):
        seen, todo = {start}, [start]
        while todo:
            at = todo.pop()
            new = {d for s, d, *_ in lines if s == at} - seen
            seen |= new
            todo += new
        want |= {(start, node) for node in seen}
    got = [(r.start, r.node) for r in catalogue.QUERIES["alignment_groups"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_neighbour_rings_where_nodes_share_a_place(spark, tmp_path):
    rng = random.Random(5)
    lines = [(way, rng.randint(1, 3), rng.randint(1, 4)) for way in range(200) for _ in range(rng.randint(2, 6))] + [(303, 2, n) for n in (9, 8, 7, 6)] + [(306, None, 1), (306, None, 1), (306, 1, None), (306, 1, 2), (306, 2, 2)]
    rng.shuffle(lines)
    folder = f"{tmp_path}/lineitem.parquet"
    table = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").coalesce(1)
    table.where("l_orderkey < 100").write.parquet(folder)
    table.where("l_orderkey >= 100").write.mode("append").parquet(folder)
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    want = con.sql(catalogue.ORACLES["neighbour_rings"]).fetchall()
    assert {r[0] for r in want} >= {306} and len(want) > 50
    got = catalogue.QUERIES["neighbour_rings"](spark, str(tmp_path)).select("way_id", "n_nodes", "is_building", "member").collect()
    assert sorted(map(tuple, got)) == sorted(want)
