"""Documents, batches, runs and cuts on small tables."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from loomstead.functions import payloads, text, vocabulary
from loomstead.operators import documents, metrics, npi, queue, upsert
from loomstead.plans.streams import sliced


def test_study_documents_have_all_fields(spark):
    studies = spark.createDataFrame([(1, "NCT1", "COMPLETED"), (2, "NCT2", None), (2, "NCT2", "A"), (None, "NCT3", "A")], "study_id long, nctId string, overallStatus string")
    team = spark.createDataFrame([(1, "B", None), (1, "A", "X"), (1, "A", "X"), (9, "C", None)], "study_id long, name string, role string")
    words = spark.createDataFrame([(1, "w"), (1, None), (1, "a")], "study_id long, value string")
    found = documents.study_documents(studies, {"investigators": team, "keywords": words})
    told = {r.study_id: json.loads(r.d) for r in found.select("study_id", F.to_json("document", {"ignoreNullFields": "false"}).alias("d")).collect()}
    assert set(told) == {1, 2} and all(list(d) == [*documents.STUDY, *documents.STUDY_CHILDREN] for d in told.values())
    assert told[1]["investigators"] == [{"name": "A", "role": "X", "affiliation": None}, {"name": "B", "role": None, "affiliation": None}]
    assert told[1]["keywords"] == ["a", "w"] and told[1]["conditions"] == [] and told[2]["investigators"] == [] and told[2]["overallStatus"] == "A" and told[1]["sex"] is None
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan  # one shuffle, whatever the number of children


def test_counts_by_value(spark):
    df = spark.createDataFrame([(["b", "a", None, "", "b"],), ([],), (None,)], "v array<string>")
    assert [r.m for r in df.select(documents.counts(F.col("v"), lambda x: x).alias("m")).collect()] == [{"a": 1, "b": 2}, {}, None]


def test_a_batch_is_counted_while_it_is_written(spark, tmp_path):
    rows = [(i, None if i % 11 == 0 else i % 7) for i in range(300)] + [(5, 5), (5, 5), (None, 1)]
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    df = spark.createDataFrame(rows, "id long, v int")
    looked = df.withColumn("w", F.udf(look, "long")("id"))
    reason = F.when(F.col("v") == 3, "three").when(F.col("v").isNull(), "none")
    batch = upsert.write_batch(looked, reason, str(tmp_path / "b"), {"three": F.col("_reason") == "three"})
    assert batch.counts == {"n": len(rows), "taken": sum(v not in (3, None) for _, v in rows), "rejected": sum(v in (3, None) for _, v in rows), "three": sum(v == 3 for _, v in rows)}
    assert seen.value == len(rows)  # the rows went by once
    assert batch.taken.columns == ["id", "v", "w"] and batch.rejected.columns == ["id", "v", "w", "reason"]
    assert batch.taken.count() == batch.counts["taken"] and batch.rejected.count() == batch.counts["rejected"] and seen.value == len(rows)
    assert {(r.v, r.reason) for r in batch.rejected.collect()} == {(3, "three"), (None, "none")}
    nothing = upsert.write_batch(df.limit(0), reason, str(tmp_path / "none"))
    assert nothing.counts == {"n": 0, "taken": 0, "rejected": 0} and nothing.taken.count() == nothing.rejected.count() == 0


ZERO = dt.datetime(2024, 1, 1)


def events(n, seed):
    pick = random.Random(seed)
    at, out = ZERO, []
    for _ in range(n):
        at += dt.timedelta(minutes=pick.choice([1, 10, 29, 30, 31, 50]))
        out.append((pick.choice(["a", "b", None]), at, pick.randrange(9)))
    return out


def runs_of(rows, gap=dt.timedelta(minutes=60)):
    found = {}
    for source, at, v in sorted(rows, key=lambda r: r[1]):
        own = found.setdefault(source, [])
        if own and at - own[-1][1] <= gap:
            own[-1][1:] = [at, own[-1][2] + 1, own[-1][3] + v]
        else:
            own.append([at, at, 1, v])
    return sorted(((s, *r) for s, own in found.items() for r in own), key=str)


def test_runs_on_tables_and_streams(spark, tmp_path):
    rows = events(150, 3)
    df = spark.createDataFrame(rows, "source string, at timestamp, v long")
    batch = metrics.runs(df, "60 minutes", v=F.sum("v"))
    assert sorted(map(tuple, batch.collect()), key=str) == runs_of(rows)
    # the same as a stream whose batches come out of order by half an hour, with a watermark that waits for it
    late = [(s, at + (dt.timedelta(minutes=30) if i % 3 else dt.timedelta()), at, v) for i, (s, at, v) in enumerate(rows)]
    arrived = spark.createDataFrame(late, "source string, at timestamp, happened timestamp, v long")
    stream = sliced(spark, arrived, "late", 5).select("source", F.col("happened").alias("at"), "v").withWatermark("at", "2 hours")

    def keep(out, number):
        out.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    writer = metrics.runs(stream, "60 minutes", v=F.sum("v")).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").drop("batch").collect()), key=str)
    over = max(at for _, at, _ in rows) - dt.timedelta(hours=2)
    assert got == [r for r in runs_of(rows) if r[2] + dt.timedelta(minutes=60) <= over] and len(got) > 5


def test_cuts_equal_groupings_of_their_own(spark):
    pick = random.Random(4)
    rows = [(pick.choice("ab"), pick.choice(["x", None]), pick.randrange(20), pick.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string, c int, v double")
    reports = {"a": ["a"], "ab": ["a", "b"], "c": ["c"]}
    found = [r.asDict() for r in metrics.cuts(df, reports, {"c": 5}, most=F.max("v")).collect()]
    for name, keys in reports.items():
        own = [r.asDict() for r in df.groupBy(*keys).agg(F.count("*").alias("n"), F.max("v").alias("most")).collect()]
        own = sorted(own, key=lambda r: (-r["n"], r[keys[0]]))[:5] if name == "c" else own
        got = [r for r in found if r["report"] == name]
        assert sorted(str([r[k] for k in (*keys, "n", "most")]) for r in got) == sorted(str([r[k] for k in (*keys, "n", "most")]) for r in own)
        assert all(r[c] is None for r in got for c in "abc" if c not in keys)
    with pytest.raises(ValueError):
        metrics.cuts(df, {"p": ["a", "b"], "q": ["b", "a"]})


def test_reasons_in_their_order(spark):
    cases = [
        (None, None, "EmptyOrNull"), ("  ", None, "EmptyOrNull"), ("José García", None, None), ("é", None, "NonLatinName"), ("á b c d e f g", None, "NonLatinName"), ("ab", None, "TooShort"), ("x" * 101, None, "TooLong"),
        ("a b c d e f g h i j k", None, "TooManyWords"), ("Use Central Contact", None, "KnownNonHumanName:USE CENTRAL CONTACT"), ("Contact for trials", None, "RolePrefix:CONTACT FOR"), ("Acme University Inc.", None, "CorporateSuffix:INC"),
        ("Smith & University", None, "Ampersand"), ("Pfizer Clinic", None, "OrgKeywords:CLINIC"), ("Pfizer, Smith", None, "PharmaBlocklist:Pfizer"), ("Abcdefghijklmnopqrstuvw", None, "SingleLongWord"),
        ("Abcdefghijklmnopqrstuvw", " sub_investigator ", None), ("Jane Doe, Contact", None, None), ("Jane Doe", None, None),
    ]
    df = spark.createDataFrame([(i, n, r) for i, (n, r, _) in enumerate(cases)], "i int, n string, r string")
    got = {r.i: r.reason for r in df.select("i", text.not_human_reason(F.col("n"), F.col("r")).alias("reason")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]
    # each phrase alone is found, and of several the first of the table
    words = vocabulary.ORGANISATION_WORDS
    named = spark.createDataFrame([(i, f"Zed {w.title()}s, Qux") for i, w in enumerate(words)] + [(-1, f"{words[3]} {words[1]} Qux")], "i int, n string")
    found = {r.i: r.reason for r in named.select("i", text.not_human_reason(F.col("n"), F.lit(None).cast("string")).alias("reason")).collect()}
    assert {words[i] for i in range(len(words)) if not (found[i] or "").startswith("OrgKeywords:")} == {"& CO", "& ASSOCIATES"}  # an earlier rule has these
    assert found[-1] == f"OrgKeywords:{words[1]}"


def test_the_next_window(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-01-01 00:00', TIMESTAMP_NTZ'2024-01-03 00:00'), (2, TIMESTAMP_NTZ'2024-01-02 12:00', TIMESTAMP_NTZ'2024-01-03 00:00'), (3, NULL, TIMESTAMP_NTZ'2024-01-03 00:00') AS t(i, a, b)")
    ends = [r.e.day for r in df.orderBy("i").select(queue.next_window_end(F.col("a"), F.col("b"), strict=True).alias("e")).collect()]
    assert ends == [2, 3, 3]
    with pytest.raises(Exception, match="cannot come before"):
        df.select(queue.next_window_end(F.col("b"), F.col("a"), strict=True)).collect()


def test_payloads_are_read_as_they_were_written(spark):
    df = spark.createDataFrame([(3, dt.datetime(2024, 1, 1, 2, 3), dt.datetime(2024, 1, 2)), (0, None, None)], "n long, a timestamp, b timestamp")
    got = df.select(payloads.written(F.col("n"), F.col("a"), F.col("b")).alias("p")).select("p", payloads.incremental(F.col("p")).alias("r")).collect()
    assert got[0].p == '{"count":3,"from":"2024-01-01T02:03:00Z","to":"2024-01-02T00:00:00Z"}' and got[1].p == '{"count":0,"from":null,"to":null}'
    assert got[0].r["count"] == 3 and got[0].r["from"] == dt.datetime(2024, 1, 1, 2, 3) and got[1].r["count"] == 0 and got[1].r["from"] is None


def test_candidates_from_stored_rows(spark):
    names = "full_name middle credential organisation city state specialty license license_state status other_names identifiers".split()
    rows = [
        ("Jane van Doe", "Q", "MD", "Acme", "Rome", None, None, "L1", " ", "D", '[{"last_name":"Roe","organization_name":null}]', '[{"identifier_type":"17","identifier":"x"}]'),
        ("Doe", None, None, None, " ", None, " ", None, None, None, "not json", None), (None,) * 12,
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    one, two, none = (r.c for r in df.select(npi.stored_candidate(F.struct(*names)).alias("c")).collect())
    assert (one["first"], one["last"], one.middle, one.status) == ("Jane", "Doe", "Q", "D") and [tuple(a) for a in one.addresses] == [("LOCATION", "Rome", None)]
    assert [tuple(t) for t in one.taxonomies] == [(None, True, " ")] and [tuple(o) for o in one.other_names] == [("Roe", None)] and [tuple(i) for i in one.identifiers] == [("17", "x")]
    assert (two["first"], two["last"], two.addresses, two.taxonomies) == (None, "Doe", None, None) and not two.other_names
    assert none["last"] is None and none.identifiers is None


def test_work_is_queued_again_once(spark):
    events = spark.createDataFrame([("a", "1", "completed"), ("a", "2", "dead-letter"), ("b", "3", "pending")], "event_type string, data string, status string")
    subjects = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "subject long")
    after = queue.requeued(subjects, events, "a", F.lit("2024-01-01"))
    assert sorted(map(tuple, after.collect())) == [("a", "1", "completed"), ("a", "2", "dead-letter"), ("a", "2", "pending"), ("a", "3", "pending"), ("b", "3", "pending")]
    assert queue.requeued(subjects, after, "a", F.lit("2024-01-01")).count() == after.count()


def test_a_vocabulary_is_written_as_files_of_bounded_size(spark, tmp_path):
    from loomstead.sources import registry

    path = str(tmp_path / "vocabulary")
    records = spark.range(1000).coalesce(1).select(F.concat(F.lit("D"), F.col("id").cast("string")).alias("DescriptorUI"), F.struct(F.lit("n").alias("String")).alias("DescriptorName"))
    registry.write_vocabulary(records, path, 50)
    found = registry.vocabulary_records(spark, path)
    assert found.select("cui").distinct().count() == found.count() == 1000
    assert len(found.inputFiles()) >= 20


def test_facts_tell_of_several_children(spark):
    studies = spark.createDataFrame([(1, "NCT1"), (2, "NCT2")], "study_id long, nctId string")
    facts = spark.createDataFrame([(1, "b", True), (1, "a", False), (1, "a", False), (1, None, True), (9, "c", True), (None, "d", True)], "study_id long, word string, cited boolean")
    told = {"keywords": lambda x: x["word"], "references": lambda x: F.when(x["cited"], documents.child("references", pmid=x["word"]))}
    found = documents.study_documents(studies, {}, "study_id", facts, told)
    got = {r.study_id: json.loads(r.d) for r in found.select("study_id", F.to_json("document", {"ignoreNullFields": "false"}).alias("d")).collect()}
    assert set(got) == {1, 2} and got[2]["keywords"] == got[2]["references"] == got[1]["phases"] == []
    assert got[1]["keywords"] == ["a", "b"] and [r["pmid"] for r in got[1]["references"]] == [None, "b"]


def test_pages_written_to_be_read_again_are_compressed_and_bounded(spark, monkeypatch):
    from loomstead.plans import lookups

    monkeypatch.setattr(lookups, "PAGES_A_FILE", 30)
    found = lookups.reread(spark.range(100).coalesce(1).select(F.col("id").alias("n")), "n long", "few")
    assert sorted(r.n for r in found.collect()) == list(range(100))
    assert len(found.inputFiles()) == 4 and all(f.endswith(".gz") for f in found.inputFiles())
