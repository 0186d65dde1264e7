"""Descriptions of evidence."""

from pyspark.sql import functions as F

from ringweave.operators import evidence

ITEM = "entity_type string, type string, metrics map<string,string>"


def test_descriptions_come_from_metrics(spark):
    rows = [
        ("COMMUNITY", "MULTI_LAYER_EVIDENCE", {"account_a": "a", "account_b": "b", "layer_count": "2", "layers": "devices,ips"}),
        ("ACCOUNT", "MULTI_LAYER_EVIDENCE", {"peer": "b", "layer_count": "2", "layers": "devices,ips"}),
        ("ACCOUNT", "RAPID_INTERACTION", {"median_gap_hours": "0.5", "transaction_count": "9"}),
        ("COMMUNITY", "HIGH_EVIDENCE_DENSITY", {"weight_per_member": "3.75", "member_count": "4"}),
        ("COMMUNITY", "DEVICE_REUSE", {"account_count": None}),
        ("COMMUNITY", "SOMETHING_ELSE", {}),
    ]
    got = [r.description for r in evidence.described(spark.createDataFrame(rows, ITEM).coalesce(1)).collect()]
    assert got[:2] == ["a and b have 2 kinds of links: devices,ips.", "The account and b have 2 kinds of links: devices,ips."]
    assert got[2] == "Half of 9 transactions come within 30 minutes of the one before." and got[3] == "Links among 4 members weigh 3 or more for each of them."
    assert got[4].startswith("Device - is on the links of - accounts.") and got[5] is None


def test_each_type_has_a_text(spark):
    assert set(evidence.TEXTS[""]) == set(evidence.FAMILIES)
    empty = evidence.described(spark.createDataFrame([], ITEM))
    assert empty.count() == 0 and dict(empty.dtypes)["description"] == "string"
    assert empty.select(F.col("description")).schema[0].nullable


def test_texts_store_no_items(spark, monkeypatch):
    from ringweave.plans import queries_graph

    stored = []
    monkeypatch.setattr(queries_graph.communities, "cut", lambda df, name, old=queries_graph.communities.cut: stored.append(name) or old(df, name))
    found = queries_graph.QUERIES["evidence_texts"](spark, "/root/testdata/sf0.001")
    assert found.count() == found.distinct().count() == 295
    assert "ledger" in stored and "evidence" not in stored
