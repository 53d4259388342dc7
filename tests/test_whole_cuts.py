"""The least cut as a whole: no number of trials bounds it, and pairs that are merged hold together."""

import random

import duckdb

import __spark_entry__
from loomgraph.operators import cuts


def test_least_cut_of_the_supply_graph_is_proven(spark, monkeypatch):
    seen, plain = [], cuts.global_min_cut

    def kept(graph, *args, **named):
        seen.append((args, named, plain(graph, *args, **named)))
        return seen[-1][2]

    monkeypatch.setattr(cuts, "global_min_cut", kept)
    row = __spark_entry__.queries()["global_min_cut"](spark, "/root/testdata/sf0.001").first()
    assert row.parted and row.weight_is_crossing and row.most is not None
    assert [(args, named, cut.proven) for args, named, cut in seen] == [((), {}, True)]


def test_classes_and_ways_hold_their_pairs_together(spark):
    rng = random.Random(5)
    n, best, parts = 9, 6.0, 3
    links = [(a, b, float(rng.choice((2, 3, 4)))) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.75]

    def parting(x, y):
        return min(sum(w for a, b, w in links if (mask >> a & 1) != (mask >> b & 1)) for mask in range(1 << n) if (mask >> x & 1) != (mask >> y & 1))

    table = spark.createDataFrame(links, "a long, b long, w double")
    linked = {(a, b) for a, b, _ in links}
    for held in (cuts._held_by_classes(table, best, parts), cuts._held_by_ways(table, best)):
        pairs = {(r.a, r.b) for r in held.collect()}
        assert pairs and all(parting(a, b) >= best for a, b in pairs)
    # Two nodes without a link of their own are merged too where enough ways lie between them.
    assert pairs - linked


def test_least_cut_with_shared_ids_in_one_piece(spark, tmp_path):
    tables = {
        "part": ([(0,), (1_000_000,)], "p_partkey long"),
        "supplier": ([(0,), (1,)], "s_suppkey long"),
        "lineitem": ([(0, 0, 5.0), (1_000_000, 1, 3.0), (0, 1, 4.0)], "l_partkey long, l_suppkey long, l_quantity double"),
    }
    db = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    row = __spark_entry__.queries()["global_min_cut"](spark, str(tmp_path)).first()
    assert db.execute(__spark_entry__.oracle_sql()["global_min_cut"]).fetchall() == [(row.most, row.parted, row.weight_is_crossing)]
