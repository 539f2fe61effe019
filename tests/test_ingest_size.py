"""What position ingest moves and parses: bodies stay where they were read, a message is parsed once for rows and audit."""

import json

from conftest import NOW, values

from fleetlens.streaming import ingest


def _message(header, *entities):
    return json.dumps({"header": header, "entity": list(entities)})


def test_bodies_are_not_shuffled_to_get_their_numbers(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # stands for keys that are estimated as too large
    try:
        messages = spark.createDataFrame([(f"body {i}", NOW + i % 3, i) for i in range(9)], "body string, ingested_at bigint, message_id bigint")
        numbered = ingest.number_messages(messages, 1)
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        first = 1 << ingest.MESSAGE_BITS
        assert [r[0] for r in values(numbered, "message_key")] == list(range(first, first + 9))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_parse_gives_rows_and_headers(spark):
    bodies = [_message({"timestamp": NOW}, {"id": "alert"}, {"id": "a", "vehicle": {"timestamp": NOW - 4}}),
              _message({"timestamp": NOW + 1}, {"id": "b", "vehicle": {}}, {"id": "", "vehicle": {"timestamp": 5}}),
              _message({"timestamp": NOW + 2}, {"id": "", "vehicle": {"timestamp": 5}}),
              _message({"timestamp": NOW + 3}), _message({"timestamp": 0}, {"id": "alert"}, {"id": "alert"}), "no json"]
    numbered = spark.createDataFrame([(body, NOW + 9, i) for i, body in enumerate(bodies)], "body string, ingested_at bigint, message_key bigint")
    parsed = ingest.parsed_rows(numbered)
    assert values(ingest.observation_rows(parsed), "vehicle_id", "ts", "arrival") == [
        ("a", NOW - 4, 1), ("b", NOW + 1, 1 << ingest.ENTITY_BITS)]
    heads = {r["message_key"]: r["feed_timestamp"] for r in ingest.message_headers(parsed).collect()}
    assert heads == {0: NOW, 1: NOW + 1, 2: NOW + 2, 3: NOW + 3, 4: None, 5: None}
    assert ingest.message_headers(parsed.unionByName(parsed)).count() == 6
