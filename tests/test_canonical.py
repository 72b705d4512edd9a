import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import canonical as C
from factloom.functions import text as T

FACTS = "id string, entity string, attribute string, value string, unit string, period string"
# id, inputs, then canonical attribute, entity, value, unit, period, value key
CASES = [
    ("C1", "Revenue", "total_revenue", "₹120 crore", None, "FY2024", "total_revenue", "Revenue", "120 INR crore", "crore", "FY2024", "120|crore"),
    ("C2", "Annual Revenue", "Annual Revenue", "INR 120 crore", None, "FY2024", "total_revenue", "Revenue", "120 INR crore", "crore", "FY2024", "120|crore"),
    ("C3", "Software Products", "Software Products", "INR 90 crore", None, None, "product_revenue", "Software Products", "90 INR crore", "crore", None, "90|crore"),
    ("C4", "CEO", "holder", "Rohit Sharma", None, None, "holder", "CEO", "Rohit Sharma", None, None, "rohit sharma"),
    ("C5", "Priya Mehta", "position", "CEO", None, None, "position", "Priya Mehta", "Priya Mehta", None, None, "priya mehta"),
    ("C6", "Employees", "employee_count", "Approximately 520", None, None, "employee_count", "Employees", "Approximately 520", None, None, "520|"),
    ("C7", "X", "EPS", "₹15.36", "INR", None, "eps", "X", "15.36 INR", None, None, "15.36|"),
    ("C8", "Acme", "operating_margin", "15%", None, None, "operating_margin", "Acme", "15 %", "%", None, "15|%"),
    ("C9", "Acme", "tenure", "25 years", None, None, "tenure", "Acme", "25 INR", None, None, "25|"),
    ("C10", "Acme", "balance", "₹1,234,567", None, None, "balance", "Acme", "1.23457e+06 INR", None, None, "1.23457|"),
    ("C11", "Acme", "start_date", "31 March 2024", None, None, "start_date", "Acme", "2024-03-31", None, None, "2024|"),
    ("C12", "Acme", "registered address", "12 MG Rd., Pune", None, None, "registered_address", "Acme", "12 mg road, pune", None, None, "12|"),
    ("C13", "Revenue", "fiscal_year", "120", None, None, "total_revenue", "Revenue", "120", None, None, "120|"),
    ("C14", "Acme", "percentage_of_total_revenue", "15%", None, None, "percentage_of_revenue", "Acme", "15 %", "%", None, "15|%"),
    ("C15", "Acme", "employees", "₹5 crore", None, None, "employees", "Acme", "5 INR crore", "crore", None, "5|crore"),
    ("C16", "Acme", "balance", "1,234,567", "INR", None, "balance", "Acme", "1,234,567", None, None, "1.23457e+06|"),
    ("C17", "Plot 4021", "area", "50", None, None, "area", "Plot 4021", "50", None, "FY4021", "50|"),
]


def run(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()


def test_fixture_cases(spark):
    out = C.canonicalize(spark.createDataFrame([c[:6] for c in CASES], FACTS))
    out = out.withColumn("key", C.normalized_value_key(F.col("canonical_value"), F.col("unit")))
    got = {r[0]: tuple(r)[1:] for r in out.select("id", "canonical_attribute", "canonical_entity", "canonical_value", "unit", "period", "key").collect()}
    assert got == {c[0]: c[6:] for c in CASES}


def test_canonicalising_twice_changes_nothing(spark):
    once = C.canonicalize(spark.createDataFrame([c[:6] for c in CASES], FACTS))
    twice = C.canonicalize(once)
    columns = ["id", "canonical_attribute", "canonical_entity", "canonical_value", "period"]
    assert sorted(map(tuple, once.select(columns).collect()), key=str) == sorted(map(tuple, twice.select(columns).collect()), key=str)


@pytest.mark.parametrize("given, period", [("FY2024-25", "FY2024"), ("CY 2023", "CY2023"), ("2024", "FY2024"), ("2024-03-31", "FY2024"), ("Q1 FY2024", "Q1FY2024"), ("Q1 2024", "Q1"), ("FY24", "FY24"), (None, "")])
def test_periods(spark, given, period):
    assert run(spark, [(given,)], "p string", x=C.canonicalize_period(F.col("p"), F.lit(""), F.lit("")))[0].x == period


def test_dimensions(spark):
    rows = [("120 INR crore", "money"), ("15 %", "ratio"), ("500 shares", "count"), ("120 crore", "scaled"), ("520", "plain")]
    assert [r.d for r in run(spark, rows, "v string, e string", d=C.value_dimension(F.col("v"), F.lit(None).cast("string")))] == [e for _, e in rows]


def test_six_digits_like_python(spark):
    r = random.Random(4)
    values = [0.0, -1.5, 123456.5, 123455.5, 8345.935, 1234567.0, 999999.5, 1e-5, 0.0001, 12345650.0, 12345750.0, 1e22, float("nan"), float("inf")]
    values += [(r.randrange(10**6) * 10 + 5) / 10 ** r.randint(0, 9) for _ in range(3000)] + [r.uniform(0, 10 ** r.randint(-3, 9)) for _ in range(3000)]
    got = run(spark, [(v,) for v in values], "x double", g=T.fmt_g(F.col("x")))
    assert [x.g for x in got] == [f"{v:g}" for v in values]


def test_text_helpers(spark):
    rows = [("Revenue", "120", "crore"), ("Margin", "15 %", "%"), (None, None, None)]
    got = run(spark, rows, "a string, v string, u string", s=T.statement(F.col("a"), F.col("v"), F.col("u")))
    assert [r.s for r in got] == ["Revenue = 120 crore", "Margin = 15 %", ""]
    got = run(spark, [("0.7",), ("7",), ("x",), (None,)], "c string", c=T.clamp_confidence(F.col("c")))
    assert [r.c for r in got] == [0.7, 1.0, 0.5, 0.5]
    got = run(spark, [(" N/A ",), ("x",), ("",)], "c string", c=T.optional(F.col("c")))
    assert [r.c for r in got] == [None, "x", None]
    got = run(spark, [(["b", "a", "", "b", None],)], "c array<string>", c=T.merge_reasons(F.col("c")))
    assert got[0].c == "b; a"
