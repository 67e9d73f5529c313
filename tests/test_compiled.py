"""Messages judged by compiled contracts and by the rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import compiled
from tidemark.functions.contracts import ORDER_CONTRACTS, get_contract
from tidemark.functions.validation import Checker, judge, judge_compiled, to_json
from tidemark.streaming.ingest import MESSAGES

CREATED = get_contract(ORDER_CONTRACTS, "order_created", 2)
OWN = {
    "name": "own", "version": 3, "topic": "own.v3",
    "schema": {"fields": [{"name": "a", "type": "string", "nullable": False}, {"name": "n", "type": "decimal(6,5)"}, {"name": "w", "type": "decimal(4,0)"}, {"name": "d", "type": "string", "nullable": False, "default": "un\"known"}, {"name": "t", "type": "timestamp"}]},
}
GOOD = '{"order_id": "ord_1", "customer_id": "c", "amount": 1500.5, "currency": "RUB", "created_at": "2026-07-19T12:00:00Z"}'


def plain(value, contract):
    checker = Checker(contract)
    event, errors = judge(value, checker)
    return None if event is None else to_json(event), None if errors else dict(checker.values(event)), "; ".join(errors) or None


def both(spark, values, contract):
    rows = spark.createDataFrame([(contract["topic"], 0, i, v) for i, v in enumerate(values)], MESSAGES)
    found = judge_compiled(rows, [contract])
    assert found.schema.simpleString().endswith("contract_name:string,contract_version:int,event_payload:string,values:map<string,string>,error_message:string>")
    got = {r.offset: (r.event_payload, r["values"], r.error_message) for r in found.collect()}
    for i, v in enumerate(values):
        assert got[i] == plain(v, contract), v
    return {r.offset for r in compiled.decided(compiled.judged(rows, [contract])).collect()}


@pytest.mark.parametrize(
    "text, decided",
    [
        (GOOD, True),
        (GOOD.replace(" ", ""), True),
        (" \t\n{" + GOOD[1:-1] + " \r}\n ", True),
        (GOOD.replace("1500.5", "1500.50"), True),
        (GOOD.replace("1500.5", "1500.00"), True),
        (GOOD.replace("1500.5", "1500"), True),
        (GOOD.replace("1500.5", "-0.0"), True),
        (GOOD.replace("ord_1", "é 😀 \x7f, : {}"), True),
        (GOOD[:-1] + ', "source_channel": null}', True),
        (GOOD.replace("12:00:00Z", "12:00:00.123456+05:30"), True),
        *[(GOOD.replace("1500.5", n), False) for n in ("-0", "00", "01", "1.", ".5", "1e3", "1.5E0", "100000000000", "1.505", "0.00001", "1500.5000000000000000000000000000001", "true", '"1500.5"', "[1]", "NaN", "--1", "1 2", "+1", "9999999999.999")],
        *[(GOOD.replace("2026-07-19T12:00:00Z", t), False) for t in ("2026-02-30T12:00:00Z", "2026-07-19", "2026-07-19T12:00:00", "2026-07-19T24:00:00Z", "0000-01-01T00:00:00Z", "2026-07-19T12:00:00Z ", "2026-07-19 12:00:00+00", "2026-07-19T12:00:00+24:00")],
        (GOOD + "x", False),
        (GOOD[:-1], False),
        (GOOD[:-1] + ",}", False),
        (GOOD.replace("RUB", "BTC"), False),
        (GOOD.replace("RUB", "R\\u0055B"), False),
        (GOOD.replace("ord_1", "a\tb"), False),
        (GOOD.replace('"customer_id": "c", ', ""), False),
        (GOOD.replace('"customer_id": "c"', '"customer_id": null'), False),
        (GOOD[:-1] + ', "order_id": "again"}', False),
        (GOOD[:-1] + ', "other": 1}', False),
        ("{}", False), ("", False), ("[]", False), ("null", False), ("﻿" + GOOD, False), (GOOD + GOOD, False), ('{"order_id": "x"000}', False),
    ],
)
def test_cases(text, decided, cases):
    i, found = cases
    assert (i[text] in found) is decided


@pytest.fixture(scope="module")
def cases(spark):
    texts = list(dict.fromkeys(m.args[1][k][0] for m in test_cases.pytestmark if m.name == "parametrize" for k in range(len(m.args[1]))))
    return {t: i for i, t in enumerate(texts)}, both(spark, [bytearray(t.encode()) for t in texts], CREATED)


def test_broken_bytes(spark):
    values = [None, bytearray(b"\xff" + GOOD.encode()), bytearray(GOOD.replace("ord", "o\0d").encode()), bytearray(GOOD.encode().replace(b"ord", b"o\xc3d")), bytearray(b"\0\0\0\0\1\2"), bytearray(GOOD.encode("utf-16")), bytearray(GOOD.encode())]
    assert both(spark, values, CREATED) == {6}


def test_defaults_and_small_numbers(spark):
    events = [{"a": "x"}, {"a": "x", "d": "y", "n": 0.5, "w": 12}, {"a": "x", "n": 0.0001}, {"a": "x", "n": 0.00012}, {"a": "x", "n": 0.00001}, {"a": "x", "w": 12.0}, {"a": "x", "w": 12345}, {"a": "x", "d": None}, {"d": "x"}, {"a": "", "t": None, "n": -9.99999}]
    assert both(spark, [bytearray(json.dumps(e).encode()) for e in events], OWN) == {0, 1, 2, 3, 9}


def test_random_messages(spark):
    rng = random.Random(12)
    pool = ['"x"', '""', "null", "1", "-1.50", "0.05", "1e2", "true", "{}", '"RUB"', '"EUR"', '"2026-07-19T12:00:00Z"', '"2024-02-29T00:00:00.5-03:00"', '"2023-02-29T00:00:00Z"', '"\\n"', "12345678901.5", "0.10", "3.000"]
    right = {"order_id": '"o"', "customer_id": '"c"', "amount": "5.10", "currency": '"USD"', "created_at": '"2026-01-01T00:00:00Z"', "source_channel": '"web"'}
    values = []
    for _ in range(3000):
        event = {k: v for k, v in right.items() if rng.random() < 0.97}
        for k in rng.sample([*right, "more"], rng.choice([0, 0, 1, 2])):
            event[k] = rng.choice(pool)
        pairs = list(event.items())
        rng.shuffle(pairs)
        gap = lambda: rng.choice(["", "", " ", "\n  "])
        text = "{" + gap() + ",".join(f"{gap()}{json.dumps(k)}{gap()}:{gap()}{v}{gap()}" for k, v in pairs) + "}"
        if rng.random() < 0.1:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(['"', "0", ",", "", "\\", "}", " ", "."]) + text[at + 1 :]
        values.append(bytearray(text.encode()))
    decided = both(spark, values, CREATED)
    valid = {i for i, v in enumerate(values) if plain(v, CREATED)[2] is None}
    assert decided <= valid and len(decided) > 0.95 * len(valid)


def test_clean_messages_need_no_python(spark):
    """Of messages as a producer writes them none go to Python."""
    value = F.encode(F.format_string('{"order_id": "o%d", "customer_id": "c", "amount": %d.25, "currency": "EUR", "created_at": "2026-07-19T12:00:00Z", "source_channel": "web"}', "id", F.col("id") % 1000), "UTF-8")
    rows = spark.range(5000).select(F.lit(CREATED["topic"]).alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), value.alias("value"))
    assert compiled.decided(compiled.judged(rows, ORDER_CONTRACTS), False).count() == 0
    assert judge_compiled(rows, ORDER_CONTRACTS).where("error_message IS NULL AND values['amount'] LIKE '%.25'").count() == 5000
