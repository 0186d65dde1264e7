"""From detection to evidence: members' transactions are joined once."""

from ringweave.operators import communities, evidence, features
from ringweave.plans import queries_directory
from ringweave.plans.network import Network

SF = "/root/testdata/sf0.001"


def test_members_transactions_are_joined_once(spark, monkeypatch):
    calls, whole = [], features.member_transactions

    def counted(*args):
        calls.append(args)
        return whole(*args)

    for module in (features, evidence):
        monkeypatch.setattr(module, "member_transactions", counted)
    of = Network(spark, SF).membership
    monkeypatch.setattr(communities, "detect", lambda *_, **__: of)
    found = queries_directory.QUERIES["detected_evidence"](spark, SF)
    assert len(calls) == 1
    assert {r.community_id: r.item_count for r in found.collect()} == {int(r.entity_id): r.item_count for r in evidence.scores(queries_directory.evidence_of(Network(spark, SF))).collect()}
