"""Components whose links shrink from round to round, and the cut of a supply graph whose parts reach the ids of suppliers."""

import random

import __spark_entry__
from loomgraph.operators import components
from loomgraph.session import Rounds


def test_links_shrink_and_labels_are_smallest_members(spark, monkeypatch):
    rng = random.Random(5)
    ids = rng.sample(range(10_000), 400)
    edges = [(ids[k], ids[k + 1]) for k in range(149)] + [(ids[200], ids[k]) for k in range(201, 260)]
    edges += [(rng.choice(ids[300:]), rng.choice(ids[300:])) for _ in range(70)] + [(7, None)]
    left = []

    def counted(self, df, condition, plain=Rounds.counted):
        table, n = plain(self, df, condition)
        if self.label == "component-links":
            left.append(n)
        return table, n

    monkeypatch.setattr(Rounds, "counted", counted)
    found = {r.id: r.component for r in components.component_labels(spark.createDataFrame(edges, "src long, dst long")).collect()}
    plain = [(a, b) for a, b in edges if b is not None and a != b]
    label = {x: x for e in plain for x in e}
    for _ in label:
        for a, b in plain:
            label[a] = label[b] = min(label[a], label[b])
    assert found == label
    assert left[-1] == 0 and left == sorted(left, reverse=True) and len(left) < 9


def test_least_cut_keeps_the_millionth_part_apart_from_the_first_supplier(spark, tmp_path):
    tables = {
        "part": ([(0,), (1_000_000,)], "p_partkey long"),
        "supplier": ([(0,), (1,)], "s_suppkey long"),
        "lineitem": ([(0, 0, 5.0), (1_000_000, 1, 3.0)], "l_partkey long, l_suppkey long, l_quantity double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    row = __spark_entry__.queries()["global_min_cut"](spark, str(tmp_path)).first()
    # The SQL counts four nodes and three ids with links, so its bound is 0; the graph is in two pieces.
    assert (row.most, row.parted, row.weight_is_crossing) == (0.0, True, True)
