import pytest
from pyspark.sql import functions as F

from corpusloom.functions import policy
from corpusloom.operators import answers, state


def many(spark, expression, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_intents(spark):
    asked = {"查询报表": "SUMMARY", "总结同比": "SUMMARY", "增长率是怎么算的": "CALC", "CEO是谁": "FACT", "  ": "FACT"}
    assert many(spark, policy.intent, list(asked)) == list(asked.values())
    said = {"calc": "CALC", "Summary.": "SUMMARY", "it is FACT": "FACT", "FACTS": "FACT", "": "FACT", "CALC。": "CALC"}
    assert many(spark, policy.parse_intent, list(said)) == list(said.values())


def test_confidence_and_refusal(spark):
    cases = {"": 0.0, "答案 [Chunk 1]": 0.85, "x" * 51: 0.4, "y" * 51 + "[Chunk 1][Chunk 2][Chunk 3]": 1.0, "收入为10亿元[Chunk 7][Chunk 7]": 0.9, "无法确定": 0.0, "根据提供的上下文，无法找到相关信息 [Chunk 2]": 0.65}
    assert many(spark, policy.confidence, list(cases)) == pytest.approx(list(cases.values()))
    assert many(spark, policy.is_refused, list(cases)) == [True, False, True, False, False, True, False]


def test_citations(spark):
    assert many(spark, policy.citations, ["[Chunk 1][chunk 2] x [Chunk  3][Chunk 1]", "[Chunk]"]) == [[1, 2, 3, 1], []]


def test_citations_of_any_digits(spark):
    said = ["[Chunk 99999999999999999999][Chunk 4]", "[chunk １２][Chunk ٣]", None]
    assert many(spark, policy.citations, said) == [[None, 4], [12, 3], None]
    chunks = spark.createDataFrame([(4, "four"), (12, "twelve")], "chunk_id long, content string")
    given = spark.createDataFrame(list(enumerate(said)), "request_id long, answer string")
    assert sorted((r.request_id, r.rank_no, r.chunk_id) for r in answers.cited(given, chunks).collect()) == [(0, 2, 4), (1, 1, 12)]
    assert many(spark, policy.confidence, said[:2]) == [pytest.approx(0.9)] * 2  # what no id can be counts all the same


def test_embedding_errors(spark):
    said = {"Error 404: model": "no_model", "Unauthorized": "no_access", "read Timeout": "timeout", "boom": "other", None: None}
    assert many(spark, policy.embedding_error, list(said)) == list(said.values())


def test_rewrites(spark):
    rows = [("q", ["q"]), ("q", ["a"]), ("q", ["a", "b", "c", "d"]), ("q", []), ("q", ["a", "q"]), ("q", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "q string, g array<string>").select(policy.rewrites(F.col("q"), F.col("g"))).collect()]
    more = "q 详细信息"
    assert got == [["q", more], ["a", "q", more], ["a", "b", "c"], ["q", more], ["a", "q", more], ["q", more]]


def test_task_ids(spark):
    row = spark.createDataFrame([(None, " q ")], "u long, q string").select(policy.task_id(F.col("u"), F.col("q")).alias("a"), policy.task_id(F.col("u"), F.col("q"), F.lit(1)).alias("b")).first()
    assert row["a"].startswith("10991f35f74ccdda") and row["a"] != row["b"]


def test_calculator(spark):
    rows = [("growth", 100.0, 80.0), ("diff", 100.0, 80.0), ("ratio", 30.0, 100.0), ("growth", 100.0, 0.0), ("ratio", 10.0, 0.0), ("sum", 1.0, 2.0), ("ratio", 0.125, 100.0)]
    got = answers.formulas(spark.createDataFrame(rows, "op string, a double, b double")).collect()
    assert [r["result"] for r in got] == [0.25, 20.0, 0.3, None, None, None, 0.00125]
    assert [r["formula"] for r in got][:3] == ["(100 - 80) / 80 = 25.00%", "100 - 80 = 20", "30 / 100 = 30.00%"]
    assert got[3]["formula"] == policy.GROWTH_BY_ZERO and got[4]["formula"] == policy.RATIO_BY_ZERO and "sum" in got[5]["formula"]
    assert got[6]["formula"].endswith(f"{0.125:.2f}%")


def test_calc_payload(spark):
    raw = ['```json\n{"op_type":"growth","val1":1,"val2":"2.5"}\n```', '{"op_type":"none","val1":1,"val2":2}', "junk", '{"op_type":"diff","val1":"x","val2":1}']
    got = [r["p"] for r in spark.createDataFrame([(x,) for x in raw], "r string").select(answers.calc_payload(F.col("r")).alias("p")).collect()]
    assert [x["fallback"] for x in got] == [False, True, True, True] and got[0]["val2"] == 2.5


def test_slots(spark):
    turns = [("A", 1, {"year": "2024", "junk": "x"}), ("A", 2, {"dept": "A", "year": " "}), ("B", 1, {"year": ""}), (None, 1, {"year": "1"})]
    frame = spark.createDataFrame(turns, "session string, turn int, slots map<string,string>")
    got = {(r["session"], r["slot"]): r["value"] for r in state.merge_slots(frame, "session", "turn", "slots").collect()}
    assert got == {("A", "year"): "2024", ("A", "dept"): "A"}
    asked = spark.createDataFrame([("SUMMARY", {"date": "2024"}), ("CALC", {}), ("FACT", {}), ("SUMMARY", {"year": "1", "department": "x"})], "intent string, slots map<string,string>")
    out = state.missing(asked, F.col("intent"), F.col("slots")).collect()
    assert [r["missing"] for r in out] == [["dept"], ["product"], [], []] and out[0]["question"] == "请问您要查询哪个部门？" and out[2]["question"] is None


def test_errors(spark):
    rows = [("timeout", None), (None, 429), (None, 503), ("parse", None), (None, 404), ("connection", None)]
    got = spark.createDataFrame(rows, "e string, s int").select(policy.error_kind(F.col("e"), F.col("s")).alias("k"), policy.is_retryable(F.col("e"), F.col("s")).alias("r")).collect()
    assert [r["k"] for r in got] == ["timeout", "rate_limit", "5xx", "parse_error", "fallback", "fallback"]
    assert [r["r"] for r in got] == [True, True, True, False, False, True]
    assert many(spark, policy.error_message, ["Circuit open", "x Timeout", "ok"])[0] == "服务暂时不可用，请稍后重试"


def test_backoff(spark):
    got = many(spark, policy.backoff, [1, 2, 5], "int")
    assert got == [1.0, 2.0, 10.0]


def test_retries_end_with_the_time():
    from corpusloom.providers import with_retries

    now, waits = [0.0], []

    def slow():
        now[0] += 20
        raise TimeoutError("slow")

    said, events = with_retries(slow, waits.append, clock=lambda: now[0])
    assert said is None and waits == [1.0] and [e["attempt"] for e in events] == [1, 2]  # 41 seconds are more than 30


def test_second_model_answers_for_the_first():
    from corpusloom.providers import Fallback, ModelError

    now, asked = [0.0], []

    def broken():
        asked.append(now[0])
        raise ConnectionError("down")

    for error, kind, tries in ((ValueError("HTTP 429"), "parse_error", 1), (ModelError("busy", 429), "rate_limit", 3), (ModelError("down", 503), "5xx", 3), (KeyError("x"), "fallback", 1)):

        def fails(error=error):
            raise error

        said, model, events = Fallback(fails, lambda: "ok").answer(lambda s: None, lambda: 0.0)
        assert (said, model) == ("ok", "secondary") and [e["event_type"] for e in events] == [kind] * tries + ["fallback"]
        assert Fallback(fails, fails).answer(lambda s: None, lambda: 0.0)[:2] == (None, "none")
    both = Fallback(broken, lambda: "ok")
    for _ in range(6):
        said, model, events = both.answer(lambda s: None, lambda: now[0])
        assert (said, model) == ("ok", "secondary") and events[-1]["event_type"] == "fallback"
        now[0] += 1
    assert len(asked) == 15 and events[-1]["error_msg"] == "the circuit is open"  # five failures open it
    now[0] += 60
    assert Fallback(lambda: "first", lambda: "ok", breaker=both.breaker).answer(lambda s: None, lambda: now[0])[1] == "primary"
    assert both.breaker.mode == "CLOSED"


def test_numbers_in_formulas(spark):
    from corpusloom.operators.answers import formulas, number_text

    values = [1e300, -1e40, 2.0**60, 1e23, 0.0, 5.0, -3.0, 2.5, 0.1, 1234567.25, 12345678.5, 123456789012.125, 0.0001, 0.00012, 1.5e-5, -2e-7, 1e15, 1e17, 100.0]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "x double").select(number_text(F.col("x")).alias("t")).collect()]
    assert got == [str(int(v)) if v == int(v) else repr(v) for v in values]
    rows = [("growth", 100.0, 80.0), ("ratio", 1.07, 40.0), ("diff", float("inf"), 1.0), ("growth", 1.0, 0.0), ("ratio", 2.675, 100.0)]
    out = [r.formula for r in formulas(spark.createDataFrame(rows, "op string, a double, b double")).collect()]
    assert out[0] == "(100 - 80) / 80 = 25.00%" and out[1] == f"1.07 / 40 = {1.07 / 40 * 100:.2f}%" and out[2] is None and out[3].startswith("增长率") and out[4] == f"2.675 / 100 = {2.675 / 100 * 100:.2f}%"


def test_prompts_need_their_values():
    import pytest

    from corpusloom.providers import filled_prompt

    with pytest.raises(ValueError):
        filled_prompt(None)


def test_models_are_asked_in_tasks(spark):
    from corpusloom.providers import ModelError, ask_models, model_events

    def primary(text):
        if text.startswith("bad"):
            raise ModelError("busy", 429)
        return text.upper()

    def secondary(text):
        if text == "bad 3":
            raise RuntimeError("no")
        return "second"

    frame = spark.createDataFrame([(i, f"{'bad' if i % 2 else 'good'} {i}") for i in range(12)] + [(99, None)], "request_id long, prompt string").coalesce(1).sortWithinPartitions("request_id")
    asked = ask_models(frame, "prompt", primary, secondary, wait=lambda s: None, clock=lambda: 0.0)
    got = {r.request_id: (r.answer, r.model) for r in asked.collect()}
    assert got[0] == ("GOOD 0", "primary") and got[1] == ("second", "secondary") and got[3] == (None, "none") and got[99] == (None, None)
    events = model_events(asked).collect()
    assert sum(e.event_type == "rate_limit" and e.model == "primary" for e in events) == 18 and sum(e.event_type == "fallback" and e.model == "secondary" for e in events) == 7
