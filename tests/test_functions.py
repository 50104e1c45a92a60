from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomstead.functions import dates, payloads, scoring, text
from loomstead.operators import filters, hierarchy, queue


def values(spark, rows, column, schema="a string, b string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "name, role, reason",
    [
        ("John Smith", None, None), ("Maria Garcia-Lopez", None, None), ("张伟", None, None), ("Sebastiano Biondo, Sponsor", None, None), ("Agnes Smith", None, None),
        ("Pfizer", "PRINCIPAL_INVESTIGATOR", "PharmaBlocklist:Pfizer"), ("University of California", None, "OrgKeywords:UNIVERSITY"), ("Research Lab Inc", None, "CorporateSuffix:INC"),
        ("Johnson & Johnson", None, "Ampersand"), ("", None, "EmptyOrNull"), (None, None, "EmptyOrNull"), ("AB", None, "TooShort"), ("a b c d e f g h i j k", None, "TooManyWords"),
        ("Use Central Contact", None, "KnownNonHumanName:USE CENTRAL CONTACT"), ("GSK Clinical Trials", None, "OrgKeywords:CLINICAL TRIAL"), ("Hospitals, North", None, "OrgKeywords:HOSPITAL"),
        ("Contact for trial", None, "RolePrefix:CONTACT FOR"), ("Abcdefghijklmnopqrstuvw", None, "SingleLongWord"), ("Abcdefghijklmnopqrstuvw", "INVESTIGATOR", None),
    ],
)
def test_human_names(spark, name, role, reason):
    assert values(spark, [(name, role)], text.not_human_reason(F.col("a"), F.col("b"))) == [reason]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Prof. Jane Doe, MD, PhD", ("Prof.", "Jane Doe", "MD, PhD")), ("Dr. John Smith", ("Dr.", "John Smith", None)), ("John Smith, Jr.", (None, "John Smith", "Jr.")),
        ("John Smith MD", (None, "John Smith", "MD")), ("  ", (None, "", None)), (None, (None, "", None)), ("Doe, Jane", (None, "Doe, Jane", None)),
    ],
)
def test_name_parts(spark, raw, expected):
    assert tuple(values(spark, [(raw, None)], text.parsed_name(F.col("a")))[0]) == expected


def test_name_variations(spark):
    got = values(spark, [("Anna B Cole", None), ("Cole", None), (" ", None)], text.name_variations(F.col("a")))
    assert [[tuple(v) for v in row] for row in got] == [[("Anna", "Cole"), ("Anna", "B Cole"), ("Anna", "Cole")], [("", "Cole")], []]
    parts = values(spark, [("Anna B C Cole", None)], text.name_parts(F.col("a")))
    assert tuple(parts[0]) == ("Anna", "B C", "Cole")


def test_middle_names_and_credentials(spark):
    assert values(spark, [("A.", "Anna"), ("Ann", "Anna"), (None, "A"), ("b", "A")], text.middle_name_match(F.col("a"), F.col("b"))) == [True, False, None, False]
    assert values(spark, [("M.D., Ph.D./RN", None)], text.credentials(F.col("a"))) == [["MD", "PHD", "RN"]]


def test_places(spark):
    assert values(spark, [("UK", ""), (" Germany ", ""), ("usa", ""), ("  ", "")], text.country(F.col("a"))) == ["United Kingdom", "Germany", "United States", None]
    assert values(spark, [("california", ""), ("ny", ""), ("Ontario", ""), (None, "")], text.state(F.col("a"))) == ["CA", "NY", "Ontario", None]


def test_keywords(spark):
    df = spark.createDataFrame([(["Heart Failure.", "heart failure", "hiv", "xy", "Treatment", "a;bcd", " ", "asthma", "Phase 2"], ["asthma"])], "k array<string>, c array<string>")
    cleaned, rejected = df.select(text.filtered_keywords(F.col("k"), F.col("c")).alias("f")).select("f.*").first()
    assert cleaned == ["HEART FAILURE", "HUMAN IMMUNODEFICIENCY VIRUS", "PHASE 2"] and rejected == ["XY", "TREATMENT", "A;BCD"]
    accepted, left = df.select(text.gated(F.array(F.lit("XY"), F.lit("Q")), F.array(F.lit("xy"))).alias("f")).select("f.*").first()
    assert (accepted, left) == (["XY"], ["Q"])


def test_languages_and_specialties(spark):
    assert values(spark, [("привет мир", ""), ("hello", ""), ("", ""), (None, ""), ("abпр", "")], text.non_english(F.col("a"))) == [True, False, False, False, True]
    assert values(spark, [("Lung cancer", ""), (" ", "")], text.specialties(F.col("a"))) == [["oncology", "pulmonology"], []]
    assert values(spark, [("Radiologist", ""), ("Mayo Clinic", ""), ("director", ""), ("", "")], text.institution_ok(F.col("a"))) == [False, True, False, False]


def test_numbers_and_quotes(spark):
    assert [one(spark, text.number_text(F.lit(x))) for x in (1.5, 2.0, 0.1234567)] == ["1.5", "2", "0.123457"]
    assert one(spark, text.quoted(F.lit('a "b"'))) == '"a ""b"""'


def test_dates(spark):
    assert values(spark, [("2020", ""), ("2020-03", ""), ("2020-03-09", ""), ("x", ""), (None, ""), ("2020-13", "")], dates.partial_date(F.col("a"))) == [
        dt.date(2020, 1, 1), dt.date(2020, 3, 1), dt.date(2020, 3, 9), None, None, None
    ]
    assert one(spark, dates.publication_date(F.lit("2020"), F.lit("Mar"), F.lit(None).cast("string"))) == dt.date(2020, 3, 1)
    chunks = dates.month_chunks(dt.date(2026, 1, 15), dt.date(2026, 3, 10), 100, lambda a, b: 5)
    assert chunks == [(dt.date(2026, 1, 15), dt.date(2026, 1, 31)), (dt.date(2026, 2, 1), dt.date(2026, 2, 28)), (dt.date(2026, 3, 1), dt.date(2026, 3, 10))]
    assert all(a == b for a, b in dates.month_chunks(dt.date(2026, 1, 1), dt.date(2026, 1, 4), 1, lambda a, b: 9))
    assert dates.month_chunks(dt.date(2026, 1, 1), dt.date(2026, 2, 4), 9, lambda a, b: int(b.month == 2)) == [(dt.date(2026, 2, 1), dt.date(2026, 2, 4))]


def test_signals(spark):
    expected = {"COMPLETED": 1.0, "ACTIVE_NOT_RECRUITING": 0.5, "SUSPENDED": 0.3, "RECRUITING": 0.2, "WITHDRAWN": 0.0, "UNKNOWN": None, None: None}
    assert values(spark, [(s, "") for s in expected], scoring.completion_signal(F.col("a"))) == list(expected.values())
    day = lambda d: F.lit(d).cast("date")
    speed = lambda n, a, b: one(spark, scoring.velocity_signal(F.lit(n).cast("int"), day(a), day(b), day("2026-08-06")))
    assert speed(120, "2020-01-01", "2022-01-01") == pytest.approx(5.0, abs=0.01) and speed(60, "2026-01-01", None) == pytest.approx(8.42, abs=0.01)
    assert speed(None, "2020-01-01", None) is None and speed(0, "2020-01-01", None) is None and speed(5, "2021-01-01", "2020-01-01") is None


def test_factors(spark):
    assert [one(spark, scoring.experience(F.lit(n))) for n in (5, 20, 100)] == [0.25, 1.0, 1.0]
    assert [one(spark, scoring.completion(F.lit(x))) for x in (1.2, -0.5)] == [1.0, 0.0]
    assert one(spark, scoring.velocity(F.lit(10.0), None)) == 0.5 and one(spark, scoring.velocity(F.lit(5.0), 360)) == 0.5
    null = F.lit(None).cast("int")
    assert one(spark, scoring.publication(F.lit(25), F.lit(100))) == pytest.approx(0.5) and one(spark, scoring.publication(F.lit(50), null)) == pytest.approx(1.0)
    assert one(spark, scoring.publication(null, null)) is None
    none = F.lit(None).cast("double")
    factors = dict.fromkeys(scoring.FACTORS, none) | {"experience": F.lit(0.5), "condition_fit": F.lit(1.0)}
    assert one(spark, scoring.weighted(factors)) == pytest.approx((0.15 * 0.5 + 0.25) / 0.4)
    assert one(spark, scoring.geographic("europe", F.array(F.lit("Europe")))) == 1.0 and one(spark, scoring.geographic(" ", F.array(F.lit("x")))) is None


def test_payloads(spark):
    good = '{"count": 3, "from": "2020-01-01", "to": "2020-02-01", "requestedAt": "2024-01-01T00:00:00Z"}'
    bad = [good.replace("3", "0"), good.replace("2020-02-01", "2019-02-01"), good.replace("2020-01-01", "2020-1-1"), "no json", None]
    got = values(spark, [(x, "") for x in [good, *bad]], payloads.backfill(F.col("a")))
    assert got[0]["count"] == 3 and got[1:] == [None] * 5
    assert values(spark, [('{"count": 4}', "")], payloads.incremental(F.col("a")))[0]["count"] == 4
    assert values(spark, [('{"x": 1.5, "y": null}', "")], payloads.rates(F.col("a"))).pop().keys() == {"x"}


def test_criteria_round_trip():
    c = filters.Criteria(keyword="a b", statuses=["X", " "], least_enrollment=5, start_from="2020-01-02", countries=["US", "UK"])
    back = filters.from_query_string(filters.to_query_string(c))
    assert back == filters.Criteria(keyword="a b", statuses=["X"], least_enrollment=5, start_from="2020-01-02", countries=["US", "UK"])
    assert filters.from_query_string("?minEnrollment=x&startFrom=2020-1") == filters.Criteria()
    assert filters.page_strip(5, 10) == [1, None, 4, 5, 6, None, 10] and filters.page_count(41, 20) == 3 and filters.split_values(" a, ,b") == ["a", "b"]


def test_windows():
    today = dt.date(2024, 1, 1)
    assert filters.checked_window("2020-01-01", "2020-01-02", today) == (dt.date(2020, 1, 1), dt.date(2020, 1, 2))
    for bad in ((None, "2020-01-01"), ("1999-01-01", "2020-01-01"), ("2020-01-02", "2020-01-01"), ("2020-01-01", "2025-01-01"), ("x", "2020-01-01")):
        with pytest.raises(ValueError):
            filters.checked_window(*bad, today)


def test_tree(spark):
    d = spark.createDataFrame([(1, "C", "C"), (2, "C14", "C14"), (3, "C14.280", "C14.280"), (4, "C14.280.647", "C14.280.647"), (5, "A", "A")], "descriptor_id int, name string, tree_number string")
    uses = spark.createDataFrame([(i,) for i, n in ((1, 10), (2, 7), (3, 5), (4, 2)) for _ in range(n)], "descriptor_id int")
    rollup = hierarchy.rolled_up(d, uses)
    roots = {r.node: (r.n, r.has_children) for r in hierarchy.children(rollup, None).collect()}
    assert roots == {"C": (10, False), "C14": (14, True), "A": (0, False)}
    assert [tuple(r) for r in hierarchy.children(rollup, "C14").collect()] == [("C14.280", "C14.280", 7, True)]
    assert hierarchy.children(rollup, "C14", 8).count() == 0
    assert hierarchy.expanded(["C14.280.647", "C14"]) == ["C14", "C14.280", "C14.280.647"]


def test_in_flight(spark):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    row = spark.range(1).select(*queue.in_flight(F.lit(50), F.lit(200), at("2024-01-01 00:00:00"), at("2024-01-01 00:10:00"))).first()
    assert tuple(row) == (25.0, 5.0, 30.0)


def test_zero_has_no_sign(spark):
    assert [one(spark, text.number_text(F.lit(x))) for x in (-0.0, -0.0000001, 0.0, -0.5, -100.0)] == ["0", "0", "0", "-0.5", "-100"]


def test_a_text_is_lowered_once_for_all_specialties(spark):
    df = spark.createDataFrame([("Heart FAILURE in a child", ["cardiology", "pediatrics"]), (" ", []), (None, []), ("Neurological", ["neurology", "urology"])], "t string, e array<string>")
    found = df.select("e", text.specialties(F.col("t")).alias("s"))
    assert all(set(r.e) <= set(r.s) and bool(r.e) == bool(r.s) for r in found.collect())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert text.shortest(["heart", "heart failure", "cardio", "art"]) == ["cardio", "art"]
