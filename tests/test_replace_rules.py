import json
import random

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from veilcraft.functions import rules as checks
from veilcraft.functions.replace import replaced, replaced_by, replaced_runs, rules_literal
from veilcraft.operators.columns import replace_in_columns

SMALL = st.text(alphabet="abX ", max_size=3)


def expected(text, rules):
    total = 0
    for find, put in rules:
        if find:
            total += len(text.split(find)) - 1
            text = put.join(text.split(find))
    return text, total


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.text(alphabet="abXé ", max_size=14), min_size=5, max_size=20),
    st.lists(st.tuples(SMALL, SMALL), max_size=12),
)
def test_ordered_replacement(evaluate, texts, rules):
    want = [expected(t, rules) for t in texts]
    got = evaluate(lambda c: replaced(c, rules), texts)
    assert [(r["text"], r["n"]) for r in got] == want
    got = evaluate(lambda c: replaced_by(c, rules_literal(rules)), texts)
    assert [(r["text"], r["n"]) for r in got] == want


def test_null_is_not_counted(evaluate):
    for rules in ([("a", "b")], [("a", "b")] * 9, []):
        got = evaluate(lambda c: replaced(c, rules), [None, ""])
        assert [(r["text"], r["n"]) for r in got] == [(None, 0), ("", 0)]


def test_many_rules_cascade(evaluate):
    rules = [(f"<{i}>", f"<{i + 1}>") for i in range(100)]
    got = evaluate(lambda c: replaced(c, rules), ["<0> <50>"])[0]
    assert (got["text"], got["n"]) == ("<100> <100>", 150)


def two_passes(runs, rules):
    done = [expected(r, rules) for r in runs]
    runs, total = [t for t, _ in done], sum(n for _, n in done)
    whole = "".join(runs)
    text, n = expected(whole, rules)
    if n and text != whole:
        return [text] + [""] * (len(runs) - 1), total + n
    return runs, total


def test_runs_take_two_passes(spark):
    rng = random.Random(7)
    rules = [("ab", "X"), ("X", "XaX"), ("bb", "bb"), ("a X", "")]
    rows = [
        ([rng.choice(["a", "b", "ab", "X", " ", ""]) for _ in range(rng.randrange(1, 6))],)
        for _ in range(60)
    ]
    rows.append((["John ", "Smith"],))
    rules.append(("John Smith", "CLIENT_001"))
    df = spark.createDataFrame(rows, "runs array<string>").select("runs", replaced_runs(F.col("runs"), rules).alias("r"))
    for row in df.collect():
        assert (row["r"]["runs"], row["r"]["n"]) == two_passes(row["runs"], rules)


def test_nested_paragraphs_are_slices(spark):
    # outer paragraph a|b c|d with an inner paragraph over the middle two runs
    runs, spans = ["a", "b", "c", "d"], [(0, 4), (1, 2)]
    df = spark.createDataFrame([(runs, spans)], "runs array<string>, spans array<struct<start:int,length:int>>")
    got = df.select(replaced_runs(F.col("runs"), [("bc", "Z")], F.col("spans")).alias("r")).first()["r"]
    assert (got["runs"], got["n"]) == (["aZd", "", "", ""], 1)
    got = df.select(
        replaced_runs(F.col("runs"), [("bc", "bcbc")], F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("length")))).alias("r")
    ).first()["r"]
    assert (got["runs"], got["n"]) == (["a", "bcbc", "", "d"], 1)


def test_columns_form(spark):
    df = spark.createDataFrame([("John Smith", "x"), (None, "John Smith John Smith")], "a string, `b.c` string")
    got = replace_in_columns(df.withColumnRenamed("b.c", "b"), ["a", "b"], [("John Smith", "C")]).collect()
    assert [tuple(r) for r in got] == [("C", "x", 1), (None, "C C", 2)]


def test_selected_columns(spark):
    cases = [
        ("encrypt", '["0|A", "1|BC", "0|A"]', ["0|A", "1|BC"], None),
        ("decrypt", "junk", None, None),
        ("encrypt", "", None, checks.SELECT_ONE),
        ("encrypt", None, None, checks.SELECT_ONE),
        ("encrypt", "[]", None, checks.SELECT_ONE),
        ("encrypt", "junk", None, checks.BAD_SELECTION),
        ("encrypt", '{"a": 1}', None, checks.BAD_SELECTION),
        ("encrypt", "[1]", None, checks.BAD_SELECTION),
        ("encrypt", '["0|a"]', None, checks.BAD_SELECTION),
        ("encrypt", '["0|A", null]', None, checks.BAD_SELECTION),
    ]
    df = spark.createDataFrame(cases, "mode string, raw string, keys array<string>, error string")
    for row in df.withColumn("got", checks.parse_selected_columns(F.col("raw"), F.col("mode"))).collect():
        assert (row["got"]["keys"], row["got"]["error"]) == (row["keys"], row["error"]), row


def test_replacement_rules(spark):
    one = json.dumps([{"find": " John ", "replace": "C"}])
    cases = [
        ("encrypt", one, [("John", "C")], None),
        ("decrypt", "junk", [], None),
        ("encrypt", "", [], None),
        ("replace", "", None, checks.RULE_REQUIRED),
        ("replace", "[]", None, checks.RULE_REQUIRED),
        ("encrypt", "[]", [], None),
        ("replace", json.dumps([{"find": "a", "replace": "a"}, {}]), None, checks.RULE_REQUIRED),
        ("replace", json.dumps([{"find": "a"}]), [("a", "")], None),
        ("replace", json.dumps([{"replace": "a"}]), None, checks.BAD_RULE),
        ("replace", json.dumps([{"find": "a", "replace": 1}]), None, checks.BAD_RULES),
        ("replace", json.dumps([{"find": "a", "replace": None}]), None, checks.BAD_RULES),
        ("replace", json.dumps(["a"]), None, checks.BAD_RULES),
        ("replace", json.dumps([None]), None, checks.BAD_RULES),
        ("replace", "{", None, checks.BAD_RULES),
        ("replace", '{"find": "a"}', None, checks.BAD_RULES),
        ("replace", json.dumps([{"find": "a", "replace": "b"}] * 101), None, checks.BAD_RULES),
        ("replace", json.dumps([{"find": "a", "replace": "b"}] * 100), [("a", "b")] * 100, None),
        ("replace", json.dumps([{"find": "a" * 501, "replace": "b"}]), None, checks.BAD_RULE),
        ("replace", json.dumps([{"find": "a" * 500, "replace": "b" * 500}]), [("a" * 500, "b" * 500)], None),
        ("replace", json.dumps([{"find": "", "replace": "b"}, 5]), None, checks.BAD_RULE),
        ("replace", json.dumps([5, {"find": "", "replace": "b"}]), None, checks.BAD_RULES),
    ]
    df = spark.createDataFrame(
        [(i, m, r) for i, (m, r, _, _) in enumerate(cases)], "i int, mode string, raw string"
    )
    for row in df.withColumn("got", checks.parse_replacement_rules(F.col("raw"), F.col("mode"))).collect():
        _, _, rules, error = cases[row["i"]]
        got = row["got"]["rules"]
        assert (None if got is None else [tuple(r) for r in got], row["got"]["error"]) == (rules, error), row
    strict = df.withColumn(
        "got", checks.parse_replacement_rules(F.col("raw"), F.col("mode"), allow_empty_replacement=False)
    )
    assert strict.where("i = 7").first()["got"]["error"] == checks.BAD_CLIENT_RULE
