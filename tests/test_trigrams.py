"""Terms within texts by postings against looking into each text."""

from __future__ import annotations

import random

from loomstead.operators import filters, trigrams


def test_holding_equals_looking_into_each(spark):
    pick = random.Random(1)
    texts = [(i, "".join(pick.choices("abAB é%_ß", k=pick.randint(0, 9)))) for i in range(150)] + [(900, None), (1, "abab"), (1, "x"), (901, "")]
    terms = ["".join(pick.choices("abAB é%_", k=pick.randint(1, 5))) for _ in range(120)] + [None, "", "a", "B", "é", "ab", "zzz", "x"]
    got = trigrams.holding(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(t,) for t in terms], "w string"), "id", "t", "w")
    assert got.columns == ["term", "id"]
    expected = {(w, i) for w in terms if w for i, t in texts if t is not None and w.lower() in t.lower()}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == expected and len(rows) == len(expected) > 300
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_search_by_postings_is_the_same(spark):
    pick = random.Random(2)
    rows = [(i, "".join(pick.choices("abc ", k=8)), None, None) for i in range(200)]
    studies = spark.createDataFrame(rows, "study_id long, title string, status string, removed_at date")
    keywords = spark.createDataFrame([(i, "".join(pick.choices("abcd", k=4))) for i in range(0, 200, 3)], "study_id long, keyword string")
    own = trigrams.postings(studies.selectExpr("study_id", "title", "string(study_id) AS id"), "study_id", "title", "id")
    plain = filters.Registry(studies, keywords=keywords)
    index = filters.Registry(studies, keywords=keywords, grams=own.union(trigrams.postings(keywords, "study_id", "keyword")))
    for word in ("a", "dd", "AB", "abca", "bc a", "17", "zz", "ab c ab"):
        found, same = ({r.study_id for r in filters.apply_filters(x, filters.Criteria(keyword=word)).collect()} for x in (plain, index))
        assert found == same, word


def test_places_are_found_without_a_nested_loop(spark):
    from loomstead.plans import QUERIES

    plan = QUERIES["geo_fallback"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_texts_are_never_broadcast(spark):
    pick = random.Random(3)
    texts = spark.createDataFrame([(i, "".join(pick.choices("abcAB ", k=8))) for i in range(100)] + [(3, "abc"), (900, None)], "id long, t string")
    terms = spark.createDataFrame([("".join(pick.choices("abcAB ", k=pick.randint(1, 4))),) for _ in range(60)] + [(None,), ("",)], "w string")
    few, many = (trigrams.holding(texts, terms, "id", "t", "w", few=n) for n in (100, 0))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) != []

    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_a_stored_index_is_built_without_shuffling_postings(spark, monkeypatch):
    from loomstead.plans import search

    found = search.registry(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(trigrams, "PART_KEYS", 20)
    index = search.text_postings(spark, "/root/testdata/sf0.001", found)
    parts = -(-found.studies.count() // 20)
    assert len(index.inputFiles()) == parts > spark.sparkContext.defaultParallelism  # as many as the studies need, whatever the session's setting
    assert index.where("length(gram) <> 3").isEmpty()
    per_file = index.selectExpr("input_file_name() AS f", "study_id").distinct().groupBy("study_id").count()
    assert per_file.where("count > 1").isEmpty()  # all postings of a study lie in one part
    built = trigrams.stored_postings(found.keywords, "study_id", "keyword", 3)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in built and built.index("Generate") < built.index("Exchange")  # cut after the shuffle
    found.grams = index
    long = "5-LOW study of 1 " * 5 + "x"
    for word in ("1", "12", "W ST", "ecified study of 12", "low study of 1", "flag", "g r", "zq", long):
        got, plain = (filters.apply_filters(r, filters.Criteria(keyword=word)) for r in (found, search.registry(spark, "/root/testdata/sf0.001")))
        assert sorted(r.study_id for r in got.collect()) == sorted(r.study_id for r in plain.collect()), word


def test_a_search_reads_single_grams_and_tests_all_of_them(spark):
    term = "".join(chr(0x4E00 + i) for i in range(150))  # 148 grams, more than one number tells
    rows = [(1, term), (2, term[:-1]), (3, term[1:]), (4, term[:100]), (4, term[98:]), (5, None), (6, "")]
    index = trigrams.stored_postings(spark.createDataFrame(rows, "id long, t string"), "id", "t", 2)
    assert sorted(r.id for r in trigrams.candidates(index, "id", term).collect()) == [1, 4]
    assert sorted(r.id for r in trigrams.candidates(index, "id", term[-1]).collect()) == [1, 3, 4]
    assert "InSet" not in str(trigrams.candidates(index, "id", term[:20])._jdf.queryExecution().optimizedPlan().toString().split("Filter")[1])
