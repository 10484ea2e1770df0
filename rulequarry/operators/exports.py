"""Rules as files that other tools read: blocks of a test configuration by rule type, and stubs of two other formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bodies of the assertions that are code, with the places of their parameters. Calls are read from context.toolCalls.
ORDER_JS = (
    "(output, context) => {",
    "  const names = (context.toolCalls || []).map((call) => call.tool);",
    "  const [before, after] = [names.indexOf('{a}'), names.indexOf('{b}')];",
    "  return after < 0 || (before >= 0 && before < after);",
    "}",
)
KEYWORD_JS = (
    "(output, context) => {",
    "  const asked = String((context.vars || {}).user_input || '').toLowerCase();",
    "  return !asked.includes('{a}') || (context.toolCalls || []).some((call) => call.tool === '{b}');",
    "}",
)
RATE_JS = (
    "(output, context) => {",
    "  const own = (context.toolCalls || []).filter((call) => call.tool === '{a}');",
    "  const good = own.filter((call) => !call.result_status || call.result_status === 'success').length;",
    "  return own.length === 0 || good / own.length >= {b};",
    "}",
)
USED_JS = ("(output, context) => (context.toolCalls || []).some((call) => call.tool === '{a}')",)


def yaml_text(x: Column) -> Column:
    """Quoted where a plain scalar would be read otherwise."""
    quoted = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(x.rlike("[:#\\n\"']"), F.concat(F.lit('"'), quoted, F.lit('"'))).otherwise(x)


def _code(lines: tuple[str, ...], a: Column, b: Column | None = None) -> Column:
    text = F.lit("\n".join(["      - type: javascript", "        value: |", *["          " + x for x in lines]]))
    text = F.replace(text, F.lit("{a}"), F.coalesce(a, F.lit("")))
    return text if b is None else F.replace(text, F.lit("{b}"), F.coalesce(b, F.lit("")))


def test_blocks(rules: DataFrame) -> DataFrame:
    """rules (rule_id, type, description, severity, params) -> rule_id, block: the test of each rule as lines of YAML.

    Orderings, keywords, success rates and selected tools are asserted by code, latencies and forbidden names by
    assertions of their own, the rest by a rubric. Rules that have no template (envelopes, unknown types) give no row.
    """
    p = lambda name: F.col(f"params.{name}")
    label = F.substring(F.replace("description", F.lit('"'), F.lit("'")), 1, 160)
    items = F.array_join(F.transform(F.coalesce(p("forbidden_patterns"), F.array().cast("array<string>")), lambda x: F.concat(F.lit("\n          - "), yaml_text(x))), "")
    rubric = F.concat(F.lit("      - type: llm-rubric\n        value: "), yaml_text(F.col("description")))
    rate = F.coalesce(F.nullif(p("rate"), F.lit(0.0)), F.lit(0.95))
    threshold = F.coalesce(F.nullif(p("threshold"), F.lit(0.0)), F.lit(1000.0)).cast("long").cast("string")
    metric = F.when(F.col("type") == "statistical", p("metric"))
    asserts = (
        F.when(F.col("type") == "ordering", _code(ORDER_JS, p("tool_a"), p("tool_b")))
        .when(F.col("type") == "conditional", _code(KEYWORD_JS, p("keyword"), p("tool")))
        .when(F.col("type") == "negative", F.concat(F.lit("      - type: not-contains-any\n        value:"), items))
        .when(metric == "latency_ms", F.concat(F.lit("      - type: latency\n        threshold: "), threshold))
        .when(metric == "success_rate", _code(RATE_JS, p("tool"), F.format_string("%.4f", rate)))
        .when(F.col("type") == "tool_selection", _code(USED_JS, p("expected_tool")))
        .when(F.col("type").isin("output_format", "state", "composition"), rubric)
    )
    variables = F.when(F.col("type") == "conditional", F.concat(F.lit("\n    vars:\n      keyword: "), yaml_text(p("keyword")), F.lit("\n      expected_tool: "), yaml_text(p("tool")))).otherwise(F.lit(""))
    head = F.concat(F.lit("  - description: "), yaml_text(label), F.lit("\n    metadata:\n      severity: "), "severity", F.lit("\n      type: "), "type", variables, F.lit("\n    assert:\n"))
    return rules.withColumn("__assert", asserts).filter("__assert IS NOT NULL").select("rule_id", F.concat(head, "__assert").alias("block"))


def test_config(rules: DataFrame, description: str = "Discovered rules", provider: str = "echo", prompt: str = "{{user_input}}") -> DataFrame:
    """(ord, rule_id, text): the parts of a configuration file in their order, header first, then blocks by rule; `tests` without any is an empty list."""
    spark = rules.sparkSession
    blocks = test_blocks(rules)
    head = [f"description: {description}", "providers:", f"  - {provider}", "prompts:", f'  - "{prompt}"', "tests:"]
    if blocks.isEmpty():
        head.append("  []")
    first = spark.createDataFrame([(0, "", "\n".join(head))], "ord int, rule_id string, text string")
    return first.unionByName(blocks.select(F.lit(1).alias("ord"), "rule_id", F.col("block").alias("text"))).orderBy("ord", "rule_id")


def stub(rules: DataFrame, target: str) -> DataFrame:
    """(text): what stands in for an exporter that isn't written yet, with the number of rules."""
    return rules.agg(F.count("*").alias("n")).select(F.concat(F.lit(f"# {target} export\n# "), F.col("n").cast("string"), F.lit(" rules to translate\n")).alias("text"))


def report(judged: DataFrame, rules: DataFrame, agent: str = "agent") -> DataFrame:
    """Rules judged by a regression (rule_id, severity, verdict, b_ and c_ rates) -> (section, rank, rule_id, line): the report line by line.

    The header counts verdicts; failures and then warnings follow, the severest first, with the rates of baseline and
    candidate; without either, one line says so. Ordered by section, falling rank and rule.
    """
    rows = judged.join(rules.select("rule_id", "description"), "rule_id")
    pct = lambda c: F.bround(F.col(c) * 100).cast("long").cast("string")
    from rulequarry.schema import severity_rank

    head = F.concat(F.lit("  ["), F.rpad(F.upper("severity"), 8, " "), F.lit("] "), "rule_id", F.lit(": "), "description", F.lit("\n    ("))
    failed = F.concat(head, pct("c_pass_rate"), F.lit("% compliance, baseline "), pct("b_pass_rate"), F.lit("%)"))
    warned = F.concat(head, F.lit("warning rate "), pct("b_warn_rate"), F.lit("% -> "), pct("c_warn_rate"), F.lit("%)"))
    some = rows.filter("verdict <> 'pass'").select(
        F.when(F.col("verdict") == "fail", 1).otherwise(2).alias("section"), severity_rank("severity").alias("rank"), "rule_id", F.when(F.col("verdict") == "fail", failed).otherwise(warned).alias("line")
    )
    n = lambda v: F.count_if(F.col("verdict") == v).cast("string")
    counts = judged.agg(F.count("*").cast("string").alias("n"), n("pass").alias("p"), n("warn").alias("w"), n("fail").alias("f"))
    top = counts.select(F.lit(0).alias("section"), F.lit(0).alias("rank"), F.lit("").alias("rule_id"), F.concat(F.lit(f"Agent: {agent} | Rules checked: "), "n", F.lit("\nPASS ("), "p", F.lit(") | WARN ("), "w", F.lit(") | FAIL ("), "f", F.lit(")")).alias("line"))
    none = counts.filter("w = '0' AND f = '0'").select(F.lit(3).alias("section"), F.lit(0).alias("rank"), F.lit("").alias("rule_id"), F.lit("No regressions detected").alias("line"))
    return top.unionByName(some).unionByName(none).orderBy("section", F.desc("rank"), "rule_id")
