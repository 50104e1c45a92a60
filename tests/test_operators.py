from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstead.operators import filters, matching, metrics, npi, resolution, upsert
from loomstead.sources import files, registry
from loomstead.streaming import queue as streams


@pytest.fixture
def tables(spark):
    studies = spark.createDataFrame(
        [("S1", "Heart study", "COMPLETED", 100, "2020-01-01", None), ("S2", "Lung study", "RECRUITING", None, None, None), ("S3", "Skin", None, 5, "2021-06-01", "2024-01-01")],
        "study_id string, title string, status string, enrollment int, start_date string, removed_at string",
    ).withColumn("start_date", F.col("start_date").cast("date"))
    phases = spark.createDataFrame([("S1", "P1"), ("S1", "P2"), ("S2", "P2")], "study_id string, phase string")
    conditions = spark.createDataFrame([("S1", 1), ("S2", 2)], "study_id string, descriptor_id int")
    descriptors = spark.createDataFrame([(1, "Heart", "C14.1"), (2, "Lung", "C8")], "descriptor_id int, name string, tree_number string")
    places = spark.createDataFrame([("S1", "US", "NY", "NYC", "F"), ("S1", "UK", "L", "London", "G")], "study_id string, country string, state string, city string, facility string")
    keywords = spark.createDataFrame([("S2", "Asthma")], "study_id string, keyword string")
    return filters.Registry(studies, phases, conditions, descriptors, places, keywords)


@pytest.mark.parametrize(
    "criteria, expected",
    [
        ({}, {"S1", "S2"}), ({"include_removed": True}, {"S1", "S2", "S3"}), ({"keyword": "heart"}, {"S1"}), ({"keyword": "asthma"}, {"S2"}), ({"statuses": ["COMPLETED", " "]}, {"S1"}),
        ({"phases": ["P1", "P2"]}, {"S1", "S2"}), ({"conditions": ["Heart"]}, {"S1"}), ({"tree_prefixes": ["C1"]}, {"S1"}), ({"countries": ["US"], "cities": ["London"]}, {"S1"}),
        ({"least_enrollment": 1}, {"S1"}), ({"start_from": "2020-01-01", "start_to": "2020-01-01"}, {"S1"}), ({"phases": [" "]}, {"S1", "S2"}), ({"phases": ["P1"], "conditions": ["Lung"]}, set()),
    ],
)
def test_filters(tables, criteria, expected):
    assert {r.study_id for r in filters.apply_filters(tables, filters.Criteria(**criteria)).collect()} == expected


def test_pages_put_unknown_starts_first(tables):
    assert [r.study_id for r in filters.page(tables.studies, 0, 500).collect()] == ["S2", "S3", "S1"]


def test_percentiles(spark):
    rows = [("a", float(v)) for v in range(1, 21)] + [("b", None), (None, 2.0), (None, 2.0), (None, 5.0)] + [("c", float(v * v % 997)) for v in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.a, r.b, r.c) for r in metrics.percentiles(df, ["k"], "v", a=0.5, b=0.95, c=0.99).collect()}
    assert got["a"] == pytest.approx((10.5, 19.05, 19.81)) and got["b"] == (0.0, 0.0, 0.0)
    values = lambda k: [v for x, v in rows if x == k]
    for k in ("c", None):
        assert got[k] == pytest.approx(tuple(np.percentile(values(k), p) for p in (50, 95, 99)))
    assert metrics.percentiles(df.limit(0), ["k"], "v", a=0.5).count() == 0


def test_tables_are_swapped_where_they_are_read(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(5).selectExpr("id", "id % 2 AS part").write.partitionBy("part").parquet(path)
    upsert.write_swapped(spark.read.parquet(path).where("part = 1").selectExpr("id + 100 AS id", "part"), path, ["part"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 2, 4, 101, 103]
    upsert.write_swapped(spark.read.parquet(path).where("id > 100"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [101, 103]


def test_match_features(spark):
    table = {"heart": ["cardi", "heart"], "skin": ["skin", "dermat"]}
    person = npi.profile(F.col("name"), F.lit("0000-1"), F.lit(" General Hospital "), F.lit("Heart Institute"), F.lit("Boston"), F.lit(None).cast("string"), npi.specialties(F.lit("Heart failure"), table))
    shape = "struct<status:string,first:string,last:string,middle:string,credential:string,organisation:string,other_names:array<struct<last:string,organisation:string>>,addresses:array<struct<purpose:string,city:string,state:string>>,taxonomies:array<struct<desc:string,main:boolean,state:string>>,identifiers:array<struct<type:string,identifier:string>>>"
    one = ("A", " jane", "DOE", "Anne", "M.D., FACP", "The General Hospital of Boston", [("Smith", None), ("Doe", None)], [("MAILING", "Lynn", "MA"), ("LOCATION", "boston", "MA")], [("Dermatology", False, "NY"), ("Cardiology", True, "MA")], [("05", "0000-1"), ("17", "0000-1")])
    two = ("D", None, None, "", None, None, [], [], [], [])
    three = ("A", "John", "Doe", "B", "PhD", "Clinic", [("Roe", "x General Hospital y")], [("MAILING", "Lynn", "MA")], [("Dermatology", False, "NY")], [("17", "9")])
    df = spark.createDataFrame([(i, "Dr. Jane A. Doe, MD, PhD" if i < 2 else "Jane A Doe, MD", c) for i, c in enumerate((one, two, three))], f"id int, name string, c {shape}")
    got = {r.id: tuple(r[1:]) for r in df.select("id", *(c.alias(n) for n, c in npi.match_features(person, F.col("c"), table).items())).collect()}
    # exact, middle, credential, state, city, organisation, other name, specialty, license state, department, researcher's id, deactivated
    assert got[1] == (False, None, None, None, None, None, None, None, None, None, False, True)
    assert got[0][0] is True and got[0][2:] == (True, None, True, True, True, True, None, True, True, False)
    assert got[2] == (False, False, False, None, False, False, True, False, None, False, False, False)
    parts = spark.createDataFrame([("Doe",), ("Jane Doe",), ("Jane van der Doe",), ("",)], "n string").select(npi.name_parts(F.col("n")).alias("p")).select("p.*").collect()
    assert [tuple(p) for p in parts] == [("", None, "Doe"), ("Jane", None, "Doe"), ("Jane", "van der", "Doe"), ("", None, "")]


def test_weighted_mean_abstains(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.2, 1.0), (None, 9.0)], "v double, w double")
    assert df.agg(metrics.weighted_mean(F.col("v"), F.col("w"))).first()[0] == pytest.approx(0.6)


def test_merging_twice_changes_nothing(spark):
    stored = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, s string, v double")
    batch = spark.createDataFrame([(2, None, 5.0), (3, "c", None)], "k int, s string, v double")
    once = upsert.merge_rows(stored, batch, "k")
    expected = {(1, "a", 1.0), (2, "b", 5.0), (3, "c", None)}
    assert set(map(tuple, once.collect())) == expected and set(map(tuple, upsert.merge_rows(once, batch, "k").collect())) == expected


def test_swapped_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string")
    path = str(tmp_path / "t")
    upsert.write_swapped(df, path, ["p"])
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    upsert.write_swapped(spark.createDataFrame([(9, "b")], "v int, p string"), path, ["p"])
    assert {tuple(r) for r in spark.read.parquet(path).select("v", "p").collect()} == {(1, "a"), (9, "b")}


def candidate(person, number, score, deactivated=False, orcid=False, corroborated=True):
    return person, number, score, deactivated, orcid, corroborated


@pytest.mark.parametrize(
    "rows, outcome, number",
    [
        ([candidate(1, "A", 1.0)], "Assigned", "A"), ([candidate(1, "A", 0.9, deactivated=True)], "Ambiguous", None), ([candidate(1, "A", 0.8), candidate(1, "B", 0.8)], "Ambiguous", None),
        ([candidate(1, "A", 0.2, orcid=True), candidate(1, "B", 0.9)], "Assigned", "A"), ([candidate(1, "A", 0.2, True, True), candidate(1, "B", 0.9)], "Assigned", "B"),
        ([candidate(1, "A", 0.7, corroborated=False), candidate(1, "B", 0.1)], "Ambiguous", None), ([candidate(1, "A", 0.5, corroborated=False)], "Assigned", "A"),
        ([candidate(1, "A", 0.55), candidate(1, "B", 0.1)], "Ambiguous", None),
    ],
)
def test_resolution(spark, rows, outcome, number):
    df = spark.createDataFrame(rows, "person_id int, number string, score double, deactivated boolean, orcid_match boolean, corroborated boolean")
    row = resolution.resolve(df).first()
    assert (row.outcome, row.number) == (outcome, number)


def clusters(n, size, spread, seed=3):
    rng = np.random.default_rng(seed)
    heads = rng.standard_normal((40, size))
    return heads[rng.integers(0, 40, n)] + spread * rng.standard_normal((n, size))


def vectors_of(spark, rows, key):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], f"{key} long, vector array<double>")


@pytest.mark.parametrize("part", [20_000, 40])
def test_nearest_by_pivots_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(matching, "SAMPLE", 300)  # the vocabulary is larger than the sample, so there are many cells
    v = np.vstack([clusters(1200, 8, 0.1), np.zeros((3, 8)), np.repeat(clusters(1, 8, 0.1), 30, axis=0)])
    q = np.vstack([v[5], v[1210], clusters(30, 8, 0.3, 5), np.zeros((1, 8))])
    got = {}
    for r in matching.nearest(vectors_of(spark, q, "query_id"), vectors_of(spark, v, "match_id"), 4, part).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.match_id, r.similarity))
    with np.errstate(invalid="ignore"):
        near = np.nan_to_num((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, nan=-2)
    assert set(got) == set(range(len(q) - 1))
    for i, found in got.items():
        found.sort()
        assert [x for x, _, _ in found] == [1, 2, 3, 4] and np.allclose([s for _, _, s in found], np.sort(near[i])[::-1][:4], atol=1e-12)
        assert all(abs(near[i][m] - s) < 1e-12 for _, m, s in found)
    assert [m for _, m, _ in got[1]] == [1203, 1204, 1205, 1206]  # equal ones by id
    assert matching.nearest(vectors_of(spark, q, "query_id"), vectors_of(spark, v[:0], "match_id"), 2).count() == 0
    assert matching.nearest(vectors_of(spark, q[:0], "query_id"), vectors_of(spark, v, "match_id"), 2).count() == 0


def pairs_compared(q, v, k=3):
    """How many pairs nearest() compares, by its own parts run one after another."""
    (q, _), (v, _) = matching.unit_rows(q), matching.unit_rows(v)
    pivots = matching.choose_pivots(v[:2048])
    far, asked = matching.distances(v, pivots), matching.distances(q, pivots)
    cell, total = far.argmin(axis=1), 0
    for i in range(len(q)):
        reach, own = np.inf, asked[i].argmin()
        for c in [own, *(c for c in range(len(pivots)) if c != own)]:
            rows = np.flatnonzero(cell == c)
            if not len(rows):
                continue
            rows = rows[np.argsort(far[rows, c], kind="stable")]
            away = far[rows, c]
            if c != own and max(0.0, asked[i, c] - away[-1], away[0] - asked[i, c]) > reach + matching.SLACK:
                continue
            one = pd.DataFrame({"vector": [q[i]], "at": [asked[i, c]], "within": [reach]})
            found, pairs = matching.compared(one, pd.DataFrame({"vector": list(v[rows]), "away": away, "id": rows}), k)
            total += pairs
            if c == own and len(found[0][1]) == k:
                reach = float(np.sqrt(max(0.0, 2 - 2 * found[0][1][-1])))
    return total / (len(q) * len(v))


def test_pivots_spare_most_pairs_where_vectors_lie_in_clusters():
    tight, loose = (pairs_compared(clusters(60, 16, s, 7), clusters(4000, 16, s), 3) for s in (0.1, 0.3))
    assert tight < 0.1 and loose < 0.6, (tight, loose)


def test_nearest_over_parts_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    q, v = rng.standard_normal((7, 4)), np.vstack([rng.standard_normal((30, 4)), np.zeros((1, 4))])
    frame = lambda x, key: spark.createDataFrame([(i, [float(y) for y in row]) for i, row in enumerate(x)], f"{key} long, vector array<double>")
    for part in (5, 1000):
        got = {(r.query_id, r["rank"]): r.match_id for r in matching.nearest(frame(q, "query_id"), frame(v, "match_id"), 2, part).collect()}
        with np.errstate(invalid="ignore"):
            near = np.nan_to_num((q @ v.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(v, axis=1)[None], nan=-2)
        assert got == {(i, k + 1): int(np.argsort(-near[i], kind="stable")[k]) for i in range(7) for k in range(2)}


def test_wordpieces_and_pooling(spark):
    vocabulary = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "heart", "##s", ",", "e"])}
    df = spark.createDataFrame([("Hearts, é xyz",), (None,), ("heart " * 9,)], "t string")
    got = [r.i for r in df.select(matching.wordpiece(F.col("t"), vocabulary, 8).alias("i")).collect()]
    assert got == [[2, 4, 5, 6, 7, 1, 3, 0], [2, 3, 0, 0, 0, 0, 0, 0], [2, 4, 4, 4, 4, 4, 4, 3]]
    pool = spark.createDataFrame([([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 1.0]], [0])], "v array<array<double>>, m array<int>")
    first, none = [r.p for r in pool.select(matching.mean_pooled(F.col("v"), F.col("m")).alias("p")).collect()]
    assert first == pytest.approx([0.6, 0.8]) and none is None


STUDY = {
    "identificationModule": {"nctId": "N1", "briefTitle": "T"}, "statusModule": {"overallStatus": "COMPLETED", "startDateStruct": {"date": "2020-05"}, "lastUpdatePostDateStruct": {"date": "2024-01-02"}},
    "sponsorCollaboratorsModule": {"leadSponsor": {"name": "A"}, "collaborators": [{"name": "B"}, {"name": "C"}]}, "conditionsModule": {"conditions": ["x"], "keywords": ["k1", "k2"]},
    "designModule": {"phases": ["PHASE2"], "designInfo": {"maskingInfo": {"masking": "DOUBLE"}}, "enrollmentInfo": {"count": 12}}, "eligibilityModule": {"healthyVolunteers": True},
    "outcomesModule": {"primaryOutcomes": [{"measure": "m", "timeFrame": "1y"}]},
}


def test_registry_pages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/page.json").write_text(json.dumps({"studies": [{"protocolSection": STUDY}], "nextPageToken": "t"}))
    pages = registry.read_pages(spark, str(tmp_path / "in"))
    row = registry.flatten_studies(pages).first()
    assert (row.nct_id, str(row.start_date), row.collaborators, row.masking, row.enrollment, row.healthy_volunteers) == ("N1", "2020-05-01", "B; C", "DOUBLE", 12, True)
    studies = registry.flatten_studies(pages)
    assert {tuple(r) for r in registry.children(studies, "keywords").collect()} == {("N1", "k1"), ("N1", "k2")}
    assert [r.outcome_type for r in registry.outcomes(studies).collect()] == ["primary"]
    assert registry.updated_between(pages, "2024-01-01", None).count() == 1 and registry.updated_between(pages, None, "2023-01-01").count() == 0
    query = streams.ingest(registry.stream_pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_articles(spark, tmp_path):
    xml = """<Set><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Journal><Title>J</Title><JournalIssue><PubDate><Year>2020</Year><Month>Mar</Month></PubDate>
    </JournalIssue></Journal><AuthorList><Author><LastName>Doe</LastName><ForeName>Jane</ForeName><Identifier>0000-1</Identifier></Author></AuthorList></Article>
    <MeshHeadingList><MeshHeading><DescriptorName UI="D1">Heart</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle></Set>"""
    (tmp_path / "a.xml").write_text(xml)
    found = registry.articles(spark, str(tmp_path / "a.xml"))
    row = found.withColumn("orcid", registry.author_orcid(F.col("authors"), F.lit("Janet"), F.lit("doe"))).first()
    assert (row.pmid, row.title, str(row.published), row.descriptor_ids, row.orcid) == ("7", "T", "2020-03-01", ["D1"], "0000-1")


def test_vocabulary_and_authors(spark):
    v = spark.createDataFrame([(["A", "a2", "B"], ["1", "1", "2"], [["C1"], [], ["D"]], ["x", "x", "y"])], "names array<string>, cuis array<string>, tree_numbers array<array<string>>, categories array<string>")
    got = {r.cui: (r.name, r.tree_numbers, r.synonyms) for r in registry.descriptors(registry.vocabulary(v)).collect()}
    assert got == {"1": ("A", ["C1"], ["a2"]), "2": ("B", ["D"], [])}
    s = spark.createDataFrame([("q", [("1", "n", 3, 5, 2), ("2", "m", 3, 5, 9), ("3", "o", 3, None, 50)])], "query string, data array<struct<authorId:string,name:string,paperCount:int,citationCount:int,hIndex:int>>")
    assert registry.best_authors(s).first().authorId == "2"


def test_files(spark, tmp_path):
    df = spark.createDataFrame([('say "x"', 1.5, True, None)], "a string, b double, c boolean, d int")
    assert [r.value for r in files.csv_lines(df).collect()] == ['"say ""x""",1.5,1,']
    files.write_csv(df.select("a"), str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), "a string").first().a == 'say "x"'
    (tmp_path / "m.bin").write_bytes(struct.pack("<ii", 2, 3) + np.arange(6, dtype="<f4").tobytes())
    assert [(r.match_id, list(r.vector)) for r in files.read_matrix(spark, str(tmp_path / "m.bin")).collect()] == [(0, [0, 1, 2]), (1, [3, 4, 5])]
    (tmp_path / "posts").mkdir()
    (tmp_path / "posts/one.md").write_text('---\ntitle: "One"\ndate: 2024-01-02\ntags: [a, b]\n---\nBody\n')
    (tmp_path / "posts/two.md").write_text("---\ntitle: Two\ndate: 2023-01-02\npinned: true\n---\nX")
    assert [(r.title, r.tags, r.body.strip()) for r in files.read_posts(spark, str(tmp_path / "posts")).collect()] == [("Two", [], "X"), ("One", ["a", "b"], "Body")]


def test_queue_stream(spark, tmp_path):
    outcomes = spark.createDataFrame([(1, "claimed", 1), (1, "failed", 2), (2, "claimed", 1), (2, "done", 2), (3, "done", 1)], "id long, outcome string, seq long")
    outcomes.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(outcomes.schema).parquet(str(tmp_path / "in"))
    query = streams.queue_states(stream).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("states").collect()} == {(1, "pending", 1), (2, "completed", 0), (3, "pending", 0)}
    assert streams.step("processing", 3, "failed") == ("dead-letter", 4)


def test_stream_states_equal_one_by_one(spark):
    from loomstead.plans import QUERIES

    data = "/root/testdata/sf0.001"
    names = {"click": "claimed", "purchase": "done", "error": "failed", "view": "retried"}
    state = {}
    for r in spark.read.parquet(f"{data}/events.parquet").orderBy("event_id").collect():
        state[r.user_id] = streams.step(*state.get(r.user_id, ("pending", 0)), names.get(r.event_type, "released"))
    assert {r.id: (r.status, r.retry_count) for r in QUERIES["stream_state"](spark, data).collect()} == state


def test_model_learns(spark):
    from loomstead.plans import QUERIES

    row = QUERIES["npi_model"](spark, "/root/testdata/sf0.01").first()
    assert row.n_rows > 1000 and row.auc > 0.6 and row.precision > 0.5  # the label is a rule over the features


def test_display(spark):
    from loomstead.functions import display as D

    row = spark.sql("select array('PHASE1', 'X') a, array('b', 'c', 'd') ids, map('x', 1, 'y', 3, 'z', 3) m, cast(null as string) none").select(
        D.phases(F.col("a")), D.phases(F.lit(None).cast("array<string>")), D.duration(F.lit(61500.0)), D.duration(F.lit(900)), D.duration(F.col("none").cast("double")), D.shortened(F.lit("abcdef"), 3),
        D.shortened(F.col("none"), 3, "--"), D.id_range(F.col("ids")), D.id_range(F.array().cast("array<string>")), F.length(D.id_range(F.array(F.repeat(F.lit("a"), F.lit(150)), F.repeat(F.lit("b"), F.lit(150))))),
        F.transform(D.by_value(F.col("m")), lambda e: e["key"]), *(D.condition_ok(F.lit(t)) for t in ("Asthma", "Type 2. diabetes", "E11 diabetes", "ward 123", "it's")), F.size(D.names_from(F.lit("broken"))),
    )
    assert tuple(row.first()) == ("Phase 1, X", "None", "~1m 1s", "~0s", "--", "abc...", "--", "b ... d", "", 200, ["y", "z", "x"], True, False, False, False, False, 0)


def test_browse_opens_only_what_is_used(spark):
    from loomstead.operators import hierarchy as H

    tree = spark.createDataFrame([(1, "one", "C01.1"), (1, "one", "C01.2"), (2, "two", "C02"), (3, "three", "C02.5.6"), (4, "four", "Q9.1")], "descriptor_id long, name string, tree_number string")
    uses = spark.createDataFrame([(1,), (1,), (2,)], "descriptor_id long")
    found = {r.node: (r.level, r.name, r.n, r.has_children) for r in H.browse(tree, uses, 0, 4).collect()}
    assert len([n for n in found if len(n) == 1]) == 16 and found["C"] == (1, "Diseases", 3, True) and found["A"][2:] == (0, False)
    assert found["C01"] == (2, "one", 2, True) and found["C01.2"] == (3, "one", 2, False) and found["C02"] == (2, "two", 1, False)
    assert "C02.5" not in found and "Q9" not in found
    assert {r.node for r in H.browse(tree, uses, 2, 2).collect()} == {"C", "C01"}


def test_synonyms_lead_to_the_first_name(spark):
    from loomstead.operators import hierarchy as H

    names = spark.createDataFrame([(1, "Heart Failure", "C14"), (2, "Asthma", "C08")], "descriptor_id long, name string, tree_number string")
    entries = spark.createDataFrame([(0, "heart failure ", "D1"), (1, "Weak hearts", "d1"), (2, "lost", ""), (3, "none", None), (4, "unknown", "D9")], "ordinal long, name string, cui string")
    index = H.synonym_index(entries, names)
    assert {tuple(r) for r in index.collect()} == {(1, "HEART FAILURE"), (1, "WEAK HEARTS"), (2, "ASTHMA")}
    uses = spark.createDataFrame([(1,)], "descriptor_id long")
    asked = lambda q, branch=None: [r.descriptor_id for r in H.search(names, uses, q, 5, branch, index).collect()]
    assert asked("weak heart") == [1] and asked("weak heart", "C08") == [] and asked("asthmas") == [2] and asked("failure", "C1") == [1]


def test_models_without_known_features_tell_nothing(spark):
    from loomstead.operators import assembly as A

    vector = A.model_vector({"state_match": "state"}, {"deactivated": "gone"})
    assert list(vector) == ["state_match", "has_state_match", "deactivated"]
    assert A.scored_by(None, vector) is None and A.scored_by({"features": ["x"], "weights": [1], "bias": 0}, vector) is None
    told = A.scored_by({"features": ["has_state_match"], "weights": [0], "bias": 0}, vector)
    assert spark.sql("select true state, false gone").select(told).first()[0] == 0.5
    rows = spark.range(20_000).selectExpr("id", "id % 10 = 0 as label")
    shares = A.stratified(rows, "label", "id").groupBy("label").agg(F.avg(F.col("held_out").cast("int"))).collect()
    assert all(abs(r[1] - 0.2) < 0.03 for r in shares)


def test_batches_leave_other_tables(spark, tmp_path):
    from loomstead.operators import upsert as U
    from loomstead.sources import files

    stored = {"studies": spark.sql("select 1 k, 'a' s, date'2024-01-01' last_seen, date'2024-01-02' removed_at union all select 2, 'b', null, null"), "lines": spark.sql("select 1 k, 'x' v union all select 2, 'y'"),
              "rejected": spark.sql("select 'r' name")}
    batch = {"studies": spark.sql("select 1 k, cast(null as string) s union all select 3, 'c'"), "rejected": spark.sql("select 'r' name union all select 'q'")}
    after = U.merge_batch(stored, batch, "k", F.lit("2024-05-01").cast("date"))
    assert {(r.k, r.s, r.removed_at, str(r.last_seen)) for r in after["studies"].collect()} == {(1, "a", None, "2024-05-01"), (2, "b", None, "None"), (3, "c", None, "2024-05-01")}
    assert after["lines"].count() == 2 and {r.name for r in after["rejected"].collect()} == {"r", "q"}
    files.write_artefacts(stored["lines"], {"features": ["k"]}, str(tmp_path / "model"))
    frame, schema = files.read_artefacts(spark, str(tmp_path / "model"))
    assert frame.count() == 2 and schema == {"features": ["k"]}


def test_a_batch_is_merged_in_parts_of_bounded_size(spark, monkeypatch):
    from loomstead.plans import QUERIES

    monkeypatch.setattr(upsert, "PART_KEYS", 100)
    tables = {"studies": spark.range(1050).withColumnRenamed("id", "k"), "lines": spark.range(30).selectExpr("id % 7 AS k", "id AS n")}
    for name, table in upsert.dealt(tables, "k").items():
        assert table.rdd.getNumPartitions() == 11 and sorted(table.collect()) == sorted(tables[name].collect())
    found = QUERIES["batch_upsert"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert dealt and all(", 15), REPARTITION_BY_NUM" in line for line in dealt)  # 1,500 studies, whatever the session's number of shuffle partitions
    assert found.groupBy("study_id").count().where("count > 1").isEmpty() and found.count() == 1500


def test_a_persons_colleagues_are_gathered_by_team_in_bounded_parts(spark, monkeypatch):
    from loomstead.plans import QUERIES, details

    monkeypatch.setattr(details, "PART_LINES", 1000)
    found = QUERIES["person_documents"](spark, "/root/testdata/sf0.001")
    n = -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 1000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {n}), REPARTITION_BY_NUM") >= 2  # by the lines, whatever the session's number of shuffle partitions
    assert "Generate explode(team" not in plan  # no row for each pair of colleagues
    told = [json.loads(r.document) for r in found.collect()]
    assert len(told) == 10 and all(d["name"] not in d["coInvestigators"] and d["coInvestigators"] == sorted(set(d["coInvestigators"])) for d in told)
