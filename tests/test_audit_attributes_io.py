"""Audit events, attributes and limits by file row."""

import datetime

import pytest
from pyspark.sql import functions as F

from ringweave.operators import attributes, audit
from ringweave.sources import io

STATE = "case_id string, ts string, seq long, status string, notes string, sar_exported boolean, targets array<struct<type:string,id:string>>"


def states(spark):
    rows = [
        ("c1", "2024-01-01 10:00:00", 1, "OPEN", None, False, [("ACCOUNT", "acc_1")]),
        ("c1", "2024-01-01 10:00:00", 2, "OPEN", "look", False, [("ACCOUNT", "ACC_1"), ("COMMUNITY", "7")]),
        ("c1", "2024-01-02 10:00:00", 1, "REVIEW", "look", True, [("COMMUNITY", "7")]),
        ("c1", "2024-01-03 10:00:00", 1, "REVIEW", None, True, None),
        ("c1", "2024-01-03 10:00:00", 1, "REVIEW", None, True, None),
        ("c2", "2024-01-01 00:00:00", 5, None, None, None, None),
    ]
    return spark.createDataFrame(rows, STATE).withColumn("ts", F.to_timestamp("ts"))


def test_events_from_states(spark):
    got = sorted((r.case_id, str(r.ts)[5:10], r.seq, r.event_type, r.before, r.after) for r in audit.changes(states(spark).repartition(3)).collect())
    want = [
        ("c1", "01-01", 1, "CASE_CREATED", None, None), ("c1", "01-01", 1, "STATUS_CHANGED", None, "OPEN"), ("c1", "01-01", 1, "SAR_EXPORTED", None, "false"), ("c1", "01-01", 1, "TARGET_ADDED", None, "ACCOUNT:acc_1"),
        ("c1", "01-01", 2, "NOTES_UPDATED", None, "look"), ("c1", "01-01", 2, "TARGET_ADDED", None, "COMMUNITY:7"),
        ("c1", "01-02", 1, "STATUS_CHANGED", "OPEN", "REVIEW"), ("c1", "01-02", 1, "SAR_EXPORTED", "false", "true"), ("c1", "01-02", 1, "TARGET_REMOVED", "ACCOUNT:acc_1", None),
        ("c1", "01-03", 1, "NOTES_UPDATED", "look", None), ("c1", "01-03", 1, "TARGET_REMOVED", "COMMUNITY:7", None), ("c2", "01-01", 5, "CASE_CREATED", None, None),
    ]
    assert got == sorted(want)


def test_log_is_appended_once_and_played_back(spark, tmp_path):
    log, all_ = f"file://{tmp_path}/log", states(spark)
    early = audit.changes(all_.filter("ts < '2024-01-02'"))
    assert audit.append(log, early).count() == early.count()
    assert audit.append(log, early.unionByName(early)).count() == early.count()
    mid = {r.case_id: r for r in audit.present(audit.read(spark, log)).collect()}
    assert (mid["c1"].status, mid["c1"].notes, mid["c1"].sar_exported, mid["c1"].targets) == ("OPEN", "look", "false", ["ACCOUNT:acc_1", "COMMUNITY:7"])
    whole = audit.append(log, audit.changes(all_))
    assert whole.count() == whole.select("event_id").distinct().count() == 12
    end = {r.case_id: r for r in audit.present(whole).collect()}
    assert (end["c1"].status, end["c1"].notes, end["c1"].sar_exported, end["c1"].targets, end["c1"].events) == ("REVIEW", None, "true", [], 11)
    assert (end["c2"].status, end["c2"].events) == (None, 1)


def test_attributes_merge_key_by_key(spark):
    rows = [("a", "b", "T", 1, {"x": "1", "y": "1"}), ("a", "b", "T", 3, {"x": "3"}), ("a", "b", "T", 2, {"x": "2", "z": "2"}), ("a", "b", "U", 1, {}), ("c", "b", "T", 1, None)]
    got = {(r.src, r.type): r.attrs for r in attributes.merged_edges(spark.createDataFrame(rows, "src string, dst string, type string, seq int, attrs map<string,string>")).collect()}
    assert got == {("a", "T"): {"x": "3", "y": "1", "z": "2"}, ("a", "U"): {}, ("c", "T"): {}}
    rows = [("n", "Account", 4, {}), ("n", "Account", 0, {"customer_name": "N"}), ("m", "Merchant", 4, {}), (None, "Account", 0, {})]
    nodes = attributes.first_nodes(spark.createDataFrame(rows, "id string, type string, priority int, attrs map<string,string>"))
    assert [tuple(r) for r in attributes.of_type(nodes).collect()] == [("m", "Merchant", {}), ("n", "Account", {"customer_name": "N"})]
    assert attributes.node(nodes, "n").first().attrs == {"customer_name": "N"} and attributes.of_type(nodes, "Merchant").count() == 1


def test_graph_with_attributes(spark):
    at = lambda d: datetime.datetime(2024, 1, d, 9)
    moves = spark.createDataFrame([("t1", at(1), "a", "b", "m", "card", "settled"), ("t2", at(2), "a", "b", "m", None, "declined"), ("t3", at(3), "b", "x", None, "upi", "settled")], "transaction_id string, timestamp timestamp, src_account_id string, dst_account_id string, merchant_id string, payment_method string, transaction_status string")
    links = spark.createDataFrame([("devices", "a", "d1")], "kind string, account_id string, entity_id string")
    accounts = spark.createDataFrame([("a", "Ann"), ("b", None)], "account_id string, customer_name string")
    merchants = spark.createDataFrame([("m", "Shop", "food")], "merchant_id string, name string, category string")
    n = {r.id: (r.type, r.attrs) for r in attributes.nodes(accounts, merchants, links, moves).collect()}
    assert n["a"] == ("Account", {"customer_name": "Ann"}) and n["b"] == ("Account", {}) and n["x"] == ("Account", {}) and n["d1"] == ("Device", {})
    assert n["m"] == ("Merchant", {"name": "Shop", "category": "food"}) and n["t2"][1] == {"timestamp": "2024-01-02 09:00:00", "transaction_status": "declined"}
    e = attributes.edges(links, moves)
    assert attributes.edge(e, "a", "m", "PAYS").first().attrs == {"timestamp": "2024-01-02 09:00:00", "payment_method": "card", "transaction_status": "declined"}
    assert attributes.of_type(e, "USES_DEVICE").first().attrs == {} and attributes.of_type(e, "TO_ACCOUNT").count() == 3


@pytest.mark.parametrize("n", [0, 1, 17, 1500, 2600, 9999])
def test_first_rows_of_files(spark, tmp_path, n):
    """Files of several splits, ids in no order: the first n lines, by path."""
    import random

    ids = [f"t{k}" for k in range(3000)]
    random.Random(3).shuffle(ids)
    for name, own in (("a.csv", ids[:2000]), ("b.csv", ids[2000:])):
        lines = [f"{i},s,d,1.5,2024-01-01T00:00:{k % 60:02},text,{'0.123 ' * 8}" for k, i in enumerate(own)]
        (tmp_path / name).write_text("tx_id,src_id,dst_id,amount,timestamp,description,embedding\n" + "\n".join(lines) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        whole = io.read_transactions(spark, f"file://{tmp_path}")
        assert whole.rdd.getNumPartitions() > 8
        assert {r.tx_id for r in io.read_transactions(spark, f"file://{tmp_path}", n).collect()} == set(ids[:n])
        both = io.read_ledger(spark, f"file://{tmp_path}/a.csv", fraud=f"file://{tmp_path}/b.csv", limit=n)
        assert both.count() == min(n, 2000) + 1000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_community_edges_of_several_splits(spark, tmp_path, indent):
    """Large objects are read by many tasks: braces and quotes in strings, empty and null lists, two files, splits anywhere."""
    import json
    import random

    rng = random.Random(5)
    names = ["a", "}", "{", 'x"}', "\\\\", '\\"}', "é}", ']} , {"7": [{', "b"]
    text = lambda: "".join(rng.choice(names) for _ in range(rng.randrange(1, 4)))
    expected = []
    for name, first in (("one", 0), ("two", 500)):
        lists = {}
        for c in range(first, first + 60):
            lists[str(c)] = None if c % 17 == 3 else []
            for _ in range(0 if c % 17 == 3 else rng.choice([0, 0, 1, 3, 40])):
                e = {"shared_devices": [text() for _ in range(rng.randrange(3))], "source": text(), "target": text(), "weight": 1.5, "temporal_overlap": 2, "shared_payment_instruments": [], "shared_ips": [text()], "shared_merchants": []}
                lists[str(c)].append(e)
                for a, b in ((e["source"], e["target"]), (e["target"], e["source"])):
                    expected.append((c, a, b, 1.5, 2, tuple(e["shared_devices"]), tuple(e["shared_ips"])))
        (tmp_path / f"{name}.json").write_text(json.dumps(lists, indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "empty.json").write_text(" {} ")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    run = io.RUN
    try:
        io.RUN = 64
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3001")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 20
        got = io.read_community_edges(spark, str(tmp_path)).collect()
    finally:
        io.RUN = run
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.community_id, r.account_id, r.peer, r.weight, r.temporal_overlap, tuple(r.shared_devices), tuple(r.shared_ips)) for r in got) == sorted(expected)


def test_tables_written_and_read_back(spark, tmp_path):
    """Ledger as CSV and Parquet, tables and features: the same rows come back, in the contract's order of columns."""
    from ringweave.operators.contracts import OBSERVABLE

    rows = spark.range(50).select(*(F.concat(F.lit(f"{c}, \"x\" "), F.col("id").cast("string")).alias(c) for c in reversed(OBSERVABLE)))
    io.write_ledger(rows, f"{tmp_path}/csv", "csv")
    io.write_ledger(rows, f"{tmp_path}/parquet")
    back = spark.read.csv(f"{tmp_path}/csv", header=True, escape="\\")
    assert back.columns == [c for c in OBSERVABLE] == spark.read.parquet(f"{tmp_path}/parquet").columns
    assert sorted(back.collect()) == sorted(rows.select(*OBSERVABLE).collect())
    io.write_ledger(rows.limit(5), f"{tmp_path}/parquet")
    assert spark.read.parquet(f"{tmp_path}/parquet").count() == 5
    io.write_tables(str(tmp_path), devices=rows.select(OBSERVABLE[0]), links=rows.select(OBSERVABLE[1]))
    assert spark.read.parquet(f"{tmp_path}/devices").count() == spark.read.parquet(f"{tmp_path}/links").count() == 50
