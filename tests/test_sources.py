from datetime import datetime, timezone

import pytest

from tidemark.functions import __main__ as command
from tidemark.functions.avro import Registry
from tidemark.functions.contracts import ORDER_CONTRACTS, ContractError, get_contract
from tidemark.functions.validation import judge, validate_event
from tidemark.plans.runner import Pipeline
from tidemark.sources import migrations, producer
from tidemark.streaming.ingest import MESSAGES


@pytest.mark.parametrize("contract", ORDER_CONTRACTS, ids=lambda c: c["topic"])
def test_built_events(contract):
    event = producer.build_event(contract, "ord_1")
    assert validate_event(event, contract) == [] and validate_event(producer.spoil(contract, event), contract)
    assert producer.message_key(contract, event) == "ord_1"
    registry = Registry()
    for c in ORDER_CONTRACTS:
        number = registry.register(c)
        if c is contract:
            mine = number
    assert judge(bytes(producer.to_message(contract, event, 1, mine)[3]), contract, registry.decoder())[1] == []
    assert "unknown schema id" in judge(bytes(producer.to_message(contract, event, 1, mine, True)[3]), contract, registry.decoder())[1][0]


def test_channel_needs_its_version():
    assert producer.build_event(get_contract(ORDER_CONTRACTS, "order_created", 2), "o", "web")["source_channel"] == "web"
    with pytest.raises(ContractError):
        producer.build_event(get_contract(ORDER_CONTRACTS, "order_created", 1), "o", "web")


def test_topics(tmp_path):
    assert len(producer.missing_topics(ORDER_CONTRACTS, tmp_path)) == 4
    assert producer.missing_topics(ORDER_CONTRACTS, tmp_path) == []


def test_migrations(spark, tmp_path):
    steps = [(1, "one", "SELECT 1"), (2, "two", "SELECT 2; SELECT 3")]
    assert migrations.migrate(spark, str(tmp_path), steps[:1]) == [1]
    assert migrations.migrate(spark, str(tmp_path), steps) == [2] and migrations.migrate(spark, str(tmp_path), steps) == []
    with pytest.raises(migrations.MigrationError, match="has changed"):
        migrations.migrate(spark, str(tmp_path), [(1, "one", "SELECT 9"), steps[1]])
    with pytest.raises(migrations.MigrationError, match="increase"):
        migrations.migrate(spark, str(tmp_path), steps[::-1])


def test_rebuild_equals_incremental(spark, tmp_path):
    p, at = Pipeline(spark, str(tmp_path)), datetime(2026, 8, 3, tzinfo=timezone.utc)
    created, paid = get_contract(ORDER_CONTRACTS, "order_created"), get_contract(ORDER_CONTRACTS, "order_paid")
    for i in range(2):
        rows = [producer.to_message(created, producer.build_event(created, f"o{k}", at=f"2026-08-0{1 + k % 2}T00:00:0{i}Z"), 10 * i + k) for k in range(i, 4)]
        rows += [producer.to_message(paid, producer.build_event(paid, f"o{k}", at="2026-08-02T10:00:00Z"), 10 * i + k) for k in range(2 * i, 5)]
        p.ingest.process(spark.createDataFrame(rows, MESSAGES), at)
        p.build(at.replace(minute=i))
    tables = lambda: [sorted(map(repr, t.read().drop("processed_dttm").collect())) for t in (p.orders, p.orphans, p.mart)]
    before = tables()
    p.rebuild(at.replace(minute=9))
    assert tables() == before and len(before[0]) == 4 and len(before[1]) == 1


def test_contract_commands(tmp_path, capsys):
    yaml = pytest.importorskip("yaml")
    for c in ORDER_CONTRACTS:
        (tmp_path / f"{c['name']}.v{c['version']}.yaml").write_text(yaml.safe_dump(c))
    assert command.main(["check", str(tmp_path)]) == 0
    out = str(tmp_path / "out")
    for kind in ("ddl", "avro"):
        assert command.main([kind, str(tmp_path), "--out", out]) == 0
        assert command.main([kind, str(tmp_path), "--out", out, "--check"]) == 0
    (tmp_path / "order_paid.v1.yaml").write_text("name: [")
    assert command.main(["check", str(tmp_path)]) == 1
