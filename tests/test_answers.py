import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions import flags, modeljson
from gleaner.operators import adjudicate, citations, review, screening


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "p string").select(expr.alias("x")).first().x


def themes(*names):
    specs = screening.theme_table(F.array(*(F.lit(n) for n in names)))
    return F.transform(specs, lambda s: s["theme"]), F.map_from_entries(specs)


@pytest.mark.parametrize("raw, want", [("T", True), ("yes", True), (" 1 ", True), ("1.0", True), ("false", False), ("0", False), ("No", False), ("", None), (None, None), ("maybe", None), ("2", None)])
def test_flags(spark, raw, want):
    assert one(spark, raw, flags.to_bool(F.col("p"))) is want


@pytest.mark.parametrize("raw, want", [("a", "a"), ("1", "a"), ("T03", "c"), ("t3", "c"), ("2", None), ("x", None), (None, None), ("99999999999", None)])
def test_theme_refs(spark, raw, want):
    assert one(spark, raw, flags.theme_ref(F.col("p"), *themes("a", " ", "c"))) == want


@pytest.mark.parametrize("text, want", [('```json\n{"a": 1}\n```', 1), ('so: {"a": 2} ok', 2), ("[1]", None), ("", None), ("{", None), ("null", None), (None, None)])
def test_json_object(spark, text, want):
    assert one(spark, text, F.get_json_object(modeljson.json_object(F.col("p")), "$.a").cast("int")) == want


@pytest.mark.parametrize(
    "payload, status, want",
    [
        ({"1": "T", "2": "F"}, "ok", [True, False]),
        ({"themes": [{"theme": "a", "is_relevant": True}, {"theme_id": "2", "is_relevant": "F"}]}, "ok", [True, False]),
        ({"themes": [{"theme": "a", "is_relevant": False}, {"index": 1, "is_relevant": True}]}, "ok", [False, False]),
        ({"a": None, "T2": 1}, "ok", [False, True]),
        ({}, "ok", [False, False]),
        ({"9": "T"}, "format_error", None),
    ],
)
def test_coarse(spark, payload, status, want):
    got = one(spark, json.dumps(payload), modeljson.coarse(F.col("p"), *themes("a", "b")))
    assert got.status == status and (got.themes and [t.is_relevant for t in got.themes]) == want


def test_coarse_without_payload(spark):
    assert one(spark, None, modeljson.coarse(F.col("p"), *themes("a"))).status == "format_error"


@pytest.mark.parametrize(
    "payload, want",
    [
        ({"results": [{"piece_id": "pb:1"}]}, [(True, "未提供相关理由"), (False, "NA")]),
        ({"results": [{"piece_id": "pb:1", "reason": "r"}, {"piece_id": "pb:2", "is_relevant": False}]}, [(True, "r"), (False, "NA")]),
        ({"results": [{"piece_id": "pb:2", "is_relevant": False}, {"piece_id": " pb:2 ", "is_relevant": "T", "reason": " "}, {"piece_id": "x"}]}, [(False, "NA"), (True, "未提供相关理由")]),
        ({"results": []}, [(False, "NA"), (False, "NA")]),
        ({"other": 1}, None),
    ],
)
def test_targeted(spark, payload, want):
    got = one(spark, json.dumps(payload), modeljson.targeted(F.col("p"), F.array(F.lit("pb:1"), F.lit("pb:2"))))
    assert (got.results and [(r.is_relevant, r.reason) for r in got.results]) == want
    assert (got.status == "ok") == (want is not None)


def test_ruling(spark):
    assert tuple(one(spark, '{"is_relevant": "false", "reason": " x "}', modeljson.ruling(F.col("p")))) == (False, "x")
    assert tuple(one(spark, '{"is_relevant": true}', modeljson.ruling(F.col("p")))) == (True, "未提供仲裁理由")


def verdicts(spark, rows):
    return spark.createDataFrame(rows, "piece_id string, theme string, is_relevant boolean, reason string, needs_manual_review boolean")


def test_dual_screening_and_arbitration(spark):
    a = verdicts(spark, [("1a", "t", True, "r1", False), ("1b", "t", False, "NA", False), ("1c", "t", True, "only one side", False)])
    b = verdicts(spark, [("1a", "t", True, "r2", True), ("1b", "t", True, "r3", False), ("1d", "t", True, "x", False)])
    p = adjudicate.pair_verdicts(a, b, ["piece_id", "theme"])
    d = adjudicate.disputes(p)
    assert [r.dispute_key for r in d.collect()] == ["1b::t"]
    for ruling, want in ((False, {"1a"}), (True, {"1a", "1b"})):
        rulings = spark.createDataFrame([("1b::t", ruling, "r")], "dispute_key string, is_relevant boolean, reason string")
        got = {r.piece_id: r for r in adjudicate.final_records(adjudicate.consensus(p), d, rulings, ["piece_id", "theme"]).collect()}
        assert set(got) == want and got["1a"].note == "llm1: r1 | llm2: r2" and got["1a"].needs_manual_review
        if ruling:
            assert got["1b"].note == "llm1: NA | llm2: r3 | llm3: r" and got["1b"].judgment == "arbitrated"


def test_merge_records(spark):
    df = spark.createDataFrame([("p", "t", 1, "old"), ("p", "t", 2, "new"), ("p", "u", 1, "x"), (" ", "t", 3, "blank")], "piece_id string, matched_theme string, run int, note string")
    assert {(r.piece_id, r.matched_theme): r.note for r in adjudicate.merge_records(df, "run").collect()} == {("p", "t"): "new", ("p", "u"): "x"}


def test_review_entries(spark):
    rows = spark.createDataFrame([("k", ["p1", "p2"], "row source", None, ["a", "b"], "manual", "bad"), ("l", ["p1"], "", "t", None, "ok", None)], "key string, piece_ids array<string>, source_file string, theme string, themes array<string>, status string, error string")
    f = spark.createDataFrame([("p1", "own source", "text")], "piece_id string, source_file string, original_text string")
    got = {r.piece_id: r for r in review.review_entries(rows, f, "coarse").collect()}
    assert set(got) == {"p1", "p2"}
    assert (got["p1"].source_file, got["p2"].source_file, got["p2"].original_text) == ("own source", "row source", "")
    assert got["p1"].candidate_themes == ["a", "b"] and got["p1"].manual_review_reason.endswith("bad")


def test_citations(spark):
    seeds = spark.createDataFrame([(0, "W123"), (1, "W456")], "seed_ord int, seed string")
    cites = spark.createDataFrame([("W900", "W123"), ("W900", "W456"), ("W901", "W456"), ("W900", "W123")], "citing string, cited string")
    got = {r.work: r for r in citations.expand(seeds, cites, 2, "cited_by").collect()}
    assert got["W900"].parents == ["W123", "W456"] and got["W900"].discovered_round == 2 and len(got) == 2
    refs = spark.createDataFrame([("W123", "W900"), ("W123", "W901"), ("W456", "W901"), ("W456", "W902")], "citing string, cited string")
    got = {r.work: r.parents for r in citations.expand(seeds, refs, 1, "referenced_works").collect()}
    assert got == {"W900": ["W123"], "W901": ["W123", "W456"], "W902": ["W456"]}
    index = F.create_map(F.lit("Rain"), F.array(F.lit(0)), F.lit("ritual"), F.array(F.lit(1)))
    row = spark.range(1).select(citations.abstract(index), citations.doi(F.lit("https://doi.org/10.1234/demo")), citations.work_id(F.lit("https://openalex.org/W123"))).first()
    assert tuple(row) == ("Rain ritual", "10.1234/demo", "W123")


def test_works(spark):
    work = {
        "id": "https://openalex.org/W123", "doi": "https://doi.org/10.1234/demo", "display_name": "Ritual and Rain", "publication_year": 2024, "type": "article",
        "authorships": [{"author": {"display_name": "Li Ming"}}, {"author": {}}, {}], "primary_location": {"source": {"display_name": "Journal of Ritual Studies"}, "landing_page_url": "https://example.com"},
        "abstract_inverted_index": {"Rain": [0], "ritual": [1]}, "cited_by_count": 8,
    }
    pages = {"a": [json.dumps(work)] * 3, "b": ["{}"], "c": []}

    def fetcher(ask, per_page, page):
        return pages[ask][(page - 1) * per_page : page * per_page]

    asks = spark.createDataFrame([("a",), ("b",), ("c",)], "filter string")
    got = citations.normalize_works(citations.fetch_works(asks, fetcher, per_page=2, partitions=2)).collect()
    assert sorted((r["filter"], r.page) for r in got) == [("a", 1), ("a", 1), ("a", 2), ("b", 1)]
    r = next(r for r in got if r["filter"] == "a")
    assert (r.doi, r.authors, r.abstract, r.openalex_id, r.journal, r.year, r.cited_by_count) == ("10.1234/demo", ["Li Ming"], "Rain ritual", "W123", "Journal of Ritual Studies", 2024, 8)
    r = next(r for r in got if r["filter"] == "b")
    assert (r.id, r.doi, r.authors, r.abstract, r.cited_by_count) == (None, "", [], "", 0)
