"""The rule engine, and rules that the queries' SQL does not reach: variants against a target, aliases, long trails."""

from pyspark.sql import functions as F

from evispark.operators import cascade as CS
from evispark.operators import item_rules as IR
from evispark.operators.cascade import Rule

SCHEMA = "id int, field_id string, status string, value string"


def test_rules_run_in_order_and_leave_a_trail(spark):
    rules = [
        Rule("trim", lambda s: F.trim(s["value"]) != s["value"], value=lambda s: F.trim(s["value"]), exclusive=False),
        Rule("a_to_b", lambda s: s["value"] == "a", ("x",), value=lambda s: F.lit("b")),
        Rule("b_to_c", lambda s: s["value"] == "b", ("x", "y."), value=lambda s: F.lit("c"), note="seen"),
        Rule("reject_c", lambda s: s["value"] == "c", ("y.",), reject=True, exclusive=False, kind="bad", severity="error"),
        Rule("never", lambda s: F.lit(None).cast("boolean")),
    ]
    rows = [(1, "x", "found", " a "), (2, "x", "found", "b"), (3, "y.1", "found", "b"), (4, "z", "found", " b"), (5, "x", "missing", "a"), (6, "x", "found", None), (7, None, "found", " q")]
    out = {r["id"]: r for r in CS.apply(spark.createDataFrame(rows, SCHEMA), rules, ["x", "y."]).collect()}
    state = {i: (r["status"], r["value"], r["notes"], [a["rule"] for a in r["audit"]]) for i, r in out.items()}
    assert state == {
        1: ("found", "b", None, ["trim", "a_to_b"]), 2: ("found", "c", "seen", ["b_to_c"]), 3: ("not_found", None, "seen", ["b_to_c", "reject_c"]), 4: ("found", "b", None, ["trim"]),
        5: ("missing", "a", None, []), 6: ("found", None, None, []), 7: ("found", "q", None, ["trim"]),
    }
    again = CS.apply(CS.apply(spark.createDataFrame(rows[:1], SCHEMA), rules, ["x", "y."]), rules, ["x", "y."])
    trail = [(r["step"], r["rule"], r["before"], r["after"]) for r in CS.issues(again, ["id"]).orderBy("step").collect()]
    assert trail == [(0, "trim", " a ", "a"), (1, "a_to_b", "a", "b"), (2, "b_to_c", "b", "c")]


def test_expression_grows_with_the_number_of_rules(spark):
    df = spark.createDataFrame([(1, "x", "found", "0")], SCHEMA)
    size = lambda n: len(CS.apply(df, [Rule(f"r{i}", lambda s, i=i: s["value"] == str(i), value=lambda s, i=i: F.lit(str(i + 1)), exclusive=False) for i in range(n)], [])._jdf.queryExecution().analyzed().toString())
    assert size(40) < 5 * size(10)
    rules = [Rule(f"r{i}", lambda s, i=i: s["value"] == str(i), value=lambda s, i=i: F.lit(str(i + 1)), exclusive=False) for i in range(25)]
    assert CS.apply(df, rules, []).first()["value"] == "25"


def test_variants_are_held_against_the_target(spark):
    rows = [
        ("A.variant_hgvs_p", "p.Arg97Cys", None, "p.R97C"), ("A.variant_hgvs_p", "p.Arg98Cys", None, "p.R97C"), ("A.variant_hgvs_c", "NM_000001.2:c.5A>G", "c.5A>G", None), ("A.variant_hgvs_c", "c.6A>G", "c.5A>G", None),
        ("A.variant_hgvs_c", "c.6A>G", None, "p.R97C"),
    ]
    df = spark.createDataFrame([(i, f, "found", v, ["PS2"], None, c, p) for i, (f, v, c, p) in enumerate(rows)], SCHEMA + ", codes array<string>, target_gene string, target_hgvs_c string, target_hgvs_p string")
    out = [(r["status"], r["value"], r["codes"]) for r in IR.guarded(df).orderBy("id").collect()]
    assert out == [("found", "p.R97C", ["PS2"]), ("context_contamination", "p.Arg98Cys", []), ("found", "c.5A>G", ["PS2"]), ("context_contamination", "c.6A>G", []), ("found", "c.6A>G", ["PS2"])]


def test_grounding_aliases(spark):
    cases = {
        "p.Arg97Cys": ["Arg97Cys", "p.R97C", "R97C"], "p.R97*": ["R97*", "p.Arg97Ter"], "p.Gly12fsTer5": ["Gly12fsTer5", "p.G12fs*5", "G12fs*5"], "p.G12fs*5": ["G12fs*5", "p.Gly12fsTer5"],
        "p. ( Arg97Cys )": ["p.(Arg97Cys)".replace("p.(", "p. (").replace("p. (", "p.(")], "nothing": [], "": [], "p.Arg97Ter": ["Arg97Ter", "p.R97*", "R97*"],
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "s string")
    got = {r["s"]: r["a"] for r in df.select("s", IR.grounding_aliases(F.col("s")).alias("a")).collect()}
    assert got.pop(None) == []
    assert got.pop("p. ( Arg97Cys )")[0] == "p.(Arg97Cys)"
    cases.pop("p. ( Arg97Cys )")
    assert got == cases


def test_empty_items(spark):
    empty = spark.createDataFrame([], "group_id string, field_id string, status string, value string, snippet string, raw_snippet string")
    assert IR.normalized(empty).collect() == [] and IR.constrained(empty).collect() == []
