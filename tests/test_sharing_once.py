"""Evidence on shared entities: all kinds in one pass."""

from ringweave.operators import evidence


def test_first_values_and_their_number(spark):
    rows = spark.createDataFrame([("a", f"v{k:03}") for k in range(50)] * 2 + [("b", "x"), ("b", "x"), ("c", None), (None, "y")], "c string, v string")
    assert evidence.first_of(rows, ["c"], "v", "some").exceptAll(spark.createDataFrame([("a", 50, [f"v{k:03}" for k in range(20)]), ("b", 1, ["x"])], "c string, n long, some array<string>")).isEmpty()
    assert evidence.first_of(rows, ["c"], "v", "some").count() == 2


def test_all_kinds_give_what_each_gives(spark):
    rows = [("c", "a", "b", ["i1"], ["d1"], None, ["m1"]), ("c", "a", "d", [], ["d1"], ["p1", "i1"], ["m1", "m2"]), ("e", "f", "g", ["i1"], [], ["p1"], [])]
    inside = spark.createDataFrame(rows, "community_id string, src string, dst string, instruments array<string>, devices array<string>, ips array<string>, merchants array<string>")
    each = None
    for kind in evidence.SHARING:
        one = evidence.sharing(inside, kind)
        each = one if each is None else each.unionByName(one)
    key = lambda df: sorted(map(str, df.collect()))
    found = evidence.sharing(inside, *evidence.SHARING)
    assert key(found) == key(each) and found.count() == 8
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Window [") == 1 and " Join " not in text
