import json
import random

from tallyforge.llm import chat

CALLS = "conv_id bigint, call_id string, turn bigint, tool string, arguments string, needs array<string>"
RESULTS = "conv_id bigint, call_id string, turn bigint, text string"
SCHEMAS = {
    "add": {
        "type": "object", "required": ["a"], "additionalProperties": False,
        "properties": {"a": {"type": "number", "minimum": 0}, "tags": {"type": "array", "items": {"enum": ["x", "y"]}}},
    }
}


def test_links_order_and_validity(spark):
    calls = [
        (1, "a", 1, "add", '{"tags":["x"],"a":1}', None), (1, "b", 3, "add", '{"a":2.5}', ["a"]),
        (1, "c", 5, "add", '{"a":3}', ["a", "b", "b"]), (1, "d", 6, "add", '{"a":-1}', []), (1, "e", 7, "none", "{}", None),
        (1, "f", 8, "add", "{oops", None), (1, "g", 9, "add", None, None), (1, "p", 10, "add", '{"a":1}', ["q"]),
        (1, "q", 11, "add", '{"a":1}', ["p"]), (1, "r", 12, "add", '{"a":1}', ["missing"]), (1, "s", 13, "add", '{"a":1}', ["q"]),
        (2, "a", 1, "add", '{"a":true}', None), (2, "a", 4, "add", '{"a":9}', None), (2, "t", 2, "add", '{"tags":["z"],"a":1}', None),
        (2, "u", 3, "add", '{"a":1,"zz":1}', None), (2, "v", 3, "add", '{"tags":[]}', None), (None, "a", 1, "add", "{}", None), (1, None, 1, "add", "{}", None),
    ]
    results = [(1, "a", 4, "late"), (1, "a", 2, "é\n"), (1, "zz", 9, "orphan"), (2, "u", 8, None), (None, "a", 1, "x")]
    got = {
        (r["conv_id"], r["call_id"]): r
        for r in chat.format_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    }
    assert len(got) == 16
    at = lambda c, k: (got[c, k]["level"], got[c, k]["reason"])
    assert [at(1, k) for k in "abcd"] == [(0, None), (1, None), (2, None), (0, "$.a: range")]
    assert [at(1, k)[1] for k in "efg"] == ["tool", "json", "json"]
    assert [at(1, k) for k in "pqrs"] == [(None, "order")] * 4
    assert at(1, "zz") == (None, "call") and got[1, "zz"]["turn"] is None and got[1, "zz"]["result_turn"] == 9
    assert [at(2, k)[1] for k in "atuv"] == ["$.a: number", "$.tags[0]: enum", "$.zz: unknown", "$.a: required"]
    assert got[1, "a"]["line"] == '{"arguments":{"a":1,"tags":["x"]},"call":"a","result":"é\\n","tool":"add","valid":true}'
    assert json.loads(got[1, "f"]["line"])["arguments"] == "{oops" and got[1, "a"]["valid"]


def test_arguments_that_canonical_json_cannot_carry(spark):
    bad = ["[" * 200_000, '{"a":' * 50_000 + "1" + "}" * 50_000, '{"a":"\\ud800"}', '{"\\udfff":1}', '{"a":NaN}', '{"a":-Infinity}', '{"a":1e999}', '{"a":' + "9" * 5000 + "}", "", " "]
    good = ['{"a":1}', '{"a":1.5e3,"tags":["x"]}', '{"a":"\\ud83d\\ude00"}', "null", '{"a":' + " " * 100_000 + "2}"]
    calls = [(1, f"c{i}", i, "add", a, None) for i, a in enumerate(bad + good)]
    df = spark.createDataFrame([(*c, "x", 1.0) for c in calls], CALLS + ", level string, line double")  # clashing names
    got = {r["call_id"]: r for r in chat.format_calls(df, spark.createDataFrame([], RESULTS), SCHEMAS).collect()}
    for i, text in enumerate(bad):
        row = got[f"c{i}"]
        assert (row["valid"], row["reason"]) == (False, "json")
        assert json.loads(row["line"])["arguments"] == text
    reasons = [got[f"c{len(bad) + i}"]["reason"] for i in range(len(good))]
    assert reasons == [None, None, "$.a: number", "$: object", None]
    assert json.loads(got[f"c{len(bad) + 3}"]["line"])["arguments"] is None


def test_registered_query_against_its_twin(spark, tmp_path):
    import duckdb

    from tallyforge.llm.queries import ORACLES, op8_tool_calls

    rows = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t} é") for c in range(12) for t in range(9) if (c, t) not in ((3, 0), (4, 4))]
    rows += [(7, 11, "assistant", None), (8, 12, "system", "x" * 400), (13, 5, "user", "no opening"), (14, 0, "system", "s"), (14, 1, "user", "first")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = op8_tool_calls(spark, str(tmp_path))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    wanted = base.execute(ORACLES["op8_tool_calls"])
    names = [d[0] for d in wanted.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(wanted.fetchall(), key=repr)
    assert {r["level"] for r in got.collect()} == {None, 0, 1, 2, 3, 4}


def brute_levels(needs):
    level = {}
    while True:
        new = {
            v: 1 + max((level[n] for n in ns), default=-1)
            for v, ns in needs.items()
            if v not in level and all(n in level for n in ns)
        }
        if not new:
            return level
        level |= new


def test_levels_of_any_graph(spark):
    rng = random.Random(7)
    needs = {}
    for conv, backward, n in ((1, False, 60), (2, True, 40), (3, False, 5), (4, True, 25)):
        for i in range(n):
            reach = range(n) if backward and rng.random() < 0.1 else range(i)  # sometimes a cycle
            own = rng.sample(reach, min(len(reach), rng.choice([0, 1, 1, 1, 2, 3])))
            needs[conv, f"c{i}"] = [(conv, f"c{j}") for j in own] + ([(conv, "missing")] if rng.random() < 0.03 else [])
    needs[5, "self"], needs[5, "null"], needs[5, "ok"] = [(5, "self")], [(5, None)], []
    rows = [(c, v, 0, "add", "{}", [n for _, n in ns] or None) for (c, v), ns in needs.items()]
    rng.shuffle(rows)
    got = chat.levels(spark.createDataFrame(rows, CALLS)).collect()
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in got} == brute_levels(needs)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    staged, plain = [], chat.stage
    monkeypatch.setattr(chat, "stage", lambda df, tag: staged.append(tag) or plain(df, tag))
    rows = [(1, f"c{i}", i, "add", "{}", [f"c{i - 1}", "c0"] if i else []) for i in range(300)]
    got = chat.levels(spark.createDataFrame(rows, CALLS)).collect()
    assert sorted(r["level"] for r in got) == list(range(300))
    assert staged.count("settled") <= 12


def test_long_chain_and_empty(spark):
    calls = [(1, f"c{i}", i, "add", '{"a":1}', [f"c{i - 1}"] if i else None) for i in range(6)]
    got = chat.format_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).collect()
    assert sorted(r["level"] for r in got) == list(range(6))
    assert chat.format_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).count() == 0


def test_rows_without_keys_are_kept_unlinked(spark):
    calls = [(1, "a", 1, "add", '{"a":1}', None), (None, "a", 1, "add", '{"a":1}', None), (1, None, 2, "add", '{"a":1}', None), (None, None, 3, "add", None, ["a"])]
    results = [(1, "a", 2, "linked"), (None, "a", 2, "x"), (1, None, 4, "y")]
    got = chat.format_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS, unlinked=True).collect()
    seen = sorted((str(r["conv_id"]), str(r["call_id"]), r["turn"] or 0, r["result_turn"] or 0, r["level"], r["reason"]) for r in got)
    assert seen == [
        ("1", "None", 0, 4, None, "id"), ("1", "None", 2, 0, None, "id"), ("1", "a", 1, 2, 0, None),
        ("None", "None", 3, 0, None, "id"), ("None", "a", 0, 2, None, "id"), ("None", "a", 1, 0, None, "id"),
    ]
