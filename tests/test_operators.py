import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as t
from quillspark.operators import corpus, etl, lookup, render, search, spatial
from quillspark.sources import files


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "text,lines",
    [("", []), (None, []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\nb", ["a", "", "b"]), ("\n", [""]), ("a\tb\r\nc\r", ["a\tb", "c"]), ("a\n\n", ["a", ""])],
)
def test_lines(spark, text, lines):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert [(r["lineno"], r["line"]) for r in corpus.lines(df, "id").orderBy("lineno").collect()] == list(enumerate(lines, 1))


def kept(spark, rows, gap=5):
    df = spark.createDataFrame(rows, "file string, lineno bigint")
    return sorted(map(tuple, search.greedy_dedup(df, ["file"], gap).collect()))


def test_greedy_dedup_is_no_session_window(spark):
    rows = [("a", k) for k in range(1, 12)] + [("b", k) for k in (1, 5, 6, 10, 11)]
    assert kept(spark, rows) == [("a", 1), ("a", 6), ("a", 11), ("b", 1), ("b", 6), ("b", 11)]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(1, 60), min_size=1, max_size=25))
def test_greedy_dedup_property(spark, hits):
    out = [k for _, k in kept(spark, [("a", k) for k in hits])]
    assert all(b - a >= 5 for a, b in zip(out, out[1:]))
    assert all(any(0 <= h - k < 5 for k in out) for h in hits)


@pytest.mark.parametrize("apart,wide,narrow", [(1, True, True), (2, True, True), (3, True, False), (4, True, False), (5, False, False)])
def test_windows(spark, apart, wide, narrow):
    text = "\n".join(["alpha", *["-"] * (apart - 1), "beta"])
    rows = corpus.lines(spark.createDataFrame([(1, text)], "id int, text string"), "id")
    for radius, found in ((2, wide), (1, narrow)):
        assert (search.window_search(rows, "id", "BETA alpha", radius).count() > 0) == found


def test_empty_query_is_refused():
    with pytest.raises(ValueError):
        t.words("  ")


def test_first_tier(spark):
    df = spark.createDataFrame([("2.2",), ("2.2A",), ("2.20",), ("9",)], "id string")
    rows = df.crossJoin(spark.createDataFrame([("2.2",), ("2",), ("8",)], "q string"))
    out = lookup.first_tier(rows, "q", [F.col("id") == F.col("q"), F.startswith("id", F.col("q"))])
    assert sorted(map(tuple, out.select("q", "id", "tier").collect())) == [("2", "2.2", 1), ("2", "2.20", 1), ("2", "2.2A", 1), ("2.2", "2.2", 0)]


def test_level_slices_keep_children(spark):
    rows = [(1, k, lev) for k, lev in enumerate([3, 4, 4, 5, 3, None], 1)]
    df = spark.createDataFrame(rows, "id int, lineno bigint, level int")
    out = corpus.level_slice_ends(df, ["id"], "lineno", F.col("level"), range(2, 7))
    assert [r["next_start"] for r in out.orderBy("lineno").collect()] == [5, 3, 5, 5, None, None]


@pytest.mark.parametrize("raw,street", [("100 MAIN ST", "MAIN ST"), ("Main st", "MAIN ST"), ("100", None), ("", None), (None, None), ("100 200 OAK AVE", "OAK AVE"), ("1 2", "")])
def test_street(spark, raw, street):
    assert one(spark, raw, t.street) == street


@pytest.mark.parametrize("raw,number", [("IV", "IV"), ("section:IV", "IV"), ("civil", None), ("XI", None), ("x", "X"), (None, None)])
def test_roman(spark, raw, number):
    # a word of roman letters that is no numeral from I to X is a keyword
    assert one(spark, raw, t.roman_route) == number


@pytest.mark.parametrize("raw,article", [("702", 7), ("108.1", 1), ("1", 1), ("abc", None), ("1500", 14), (None, None)])
def test_article(spark, raw, article):
    assert one(spark, raw, t.article_of) == article


def test_ids_and_codes(spark):
    assert one(spark, " 160d-702", lambda c: t.section_id(c, "160D-")) == "160D-702"
    known = {"R15": "R-15", "CB": "C-B"}
    assert [one(spark, x, lambda c: t.canonical_code(c, known)) for x in ("r15", " CB ", "PUD", "R-15", None)] == ["R-15", "C-B", "PUD", "R-15", None]


def test_numbers(spark):
    assert [one(spark, x, t.currency, "double") for x in (150000.5, 2.5, None)] == ["$150,000", "$2", "N/A"]
    df = spark.createDataFrame([(30, "", 25), (30, "see 4.1", 0), (30, None, None), (None, None, 3)], "a int, note string, b int")
    out = df.select(t.feet(F.col("a"), F.col("note")), t.with_suffix(F.col("a").cast("string"), F.col("b"), " (max %dft)")).collect()
    assert list(map(tuple, out)) == [("30ft", "30 (max 25ft)"), ("see 4.1", "30"), ("30ft", "30"), (None, None)]
    assert spark.createDataFrame([("1.05", "1.2"), ("x", "1"), ("1", "1.05")], "a string, b string").select(t.differs(F.col("a"), F.col("b"), 0.1)).collect() == [(True,), (False,), (False,)]


def test_titles(spark):
    assert [one(spark, x, t.clean_title) for x in ("Leave ...... Page 4", "Leave.", "Pay Page 12")] == ["Leave", "Leave", "Pay"]
    assert one(spark, "A & B, (c)", t.slug) == "A-B-c"
    assert [one(spark, x, t.heading_level) for x in ("1.0", "1.2", "1.2.3")] == [3, 4, 5]
    assert one(spark, "water_sewer", t.human) == "Water Sewer"
    assert one(spark, " \t a b\n", t.strip) == "a b"


def test_jurisdiction(spark):
    rows = [(True, False, False, False), (False, True, False, False), (False, False, True, True), (False, False, True, False), (False, False, False, False)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, d boolean")
    assert [r[0] for r in df.select(lookup.jurisdiction(*map(F.col, "abcd"))).collect()] == ["inside", "extended", "unknown", "outside", "outside"]


def test_alternatives_and_routes(spark):
    df = spark.sql("select map('B', 1, 'A', 2) as per, 'road and water' as q")
    routes = {"water": ["utilities"], "sewer": ["utilities"], "road": ["streets", "plats"]}
    out = df.select(lookup.alternatives(["A", "C", "B"], F.col("per")), lookup.routed(F.col("q"), routes, "types"), lookup.routed(F.lit("x"), routes, "types")).first()
    assert tuple(out) == (["A", "B"], ["utilities", "streets", "plats"], ["types"])


def test_csv_join_drops_unknown_items(spark):
    index = lookup.first_match(spark.createDataFrame([("1", 1, "b"), ("1", 0, "a")], "section string, ord int, title string"), "section", "ord")
    out = lookup.csv_join(spark.createDataFrame([("u", "1, 9"), ("v", None)], "use string, ids string"), "ids", ",", index, "section")
    assert [(r["use"], r["title"]) for r in out.collect()] == [("u", "a")]


SQUARE = [[[0.0, 0.0], [100.0, 0.0], [100.0, 100.0], [0.0, 100.0], [0.0, 0.0]]]


def test_geometry(spark):
    df = spark.createDataFrame([(SQUARE,)], "r array<array<array<double>>>")
    assert tuple(df.select(spatial.ring_centroid(F.col("r"))).first()[0]) == (40.0, 40.0)
    hole = SQUARE + [[[40.0, 40.0], [60.0, 40.0], [60.0, 60.0], [40.0, 60.0], [40.0, 40.0]]]
    concave = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [5.0, 2.0], [0.0, 10.0], [0.0, 0.0]]]
    for rings, x, y, inside in ((SQUARE, 50, 50, True), (SQUARE, 150, 50, False), (hole, 50, 50, False), (hole, 20, 50, True), (concave, 5, 8, False), (concave, 1, 2, True)):
        row = spark.createDataFrame([(rings, float(x), float(y))], "r array<array<array<double>>>, x double, y double")
        assert row.select(spatial.in_rings(F.col("r"), F.col("x"), F.col("y"))).first()[0] == inside
    assert df.select(spatial.ring_distance(F.col("r")[0], F.lit(103.0), F.lit(104.0))).first()[0] == 5.0
    assert spark.createDataFrame([([],)], "r array<array<array<double>>>").select(spatial.ring_centroid(F.col("r"))).first()[0] is None


def test_etl(spark):
    rows = corpus.lines(spark.createDataFrame([(1, "# 1.1 Pay ...... 3\n\n\nfooter 7\n\ntext  \n# 1.2 and so,\n")], "id int, text string"), "id")
    clean = etl.clean_lines(rows, "id", "^footer")
    assert [r["line"] for r in clean.orderBy("lineno").collect()] == ["# 1.1 Pay ...... 3", "", "text", "# 1.2 and so,"]
    assert [(r["section"], r["title"]) for r in etl.heading_index(rows, "id", r"^# (\d+\.\d+) (.*)$").collect()] == [("1.1", "Pay")]
    assert [r["line_start"] for r in etl.renumber(clean, "id", "^# ").orderBy("lineno").collect()] == [8, 11, 12, 13]


def test_files(spark, tmp_path):
    (tmp_path / "Chapter-02-Rules.md").write_text("a\nb")
    (tmp_path / "Charter.md").write_text("c")
    (tmp_path / "d.json").write_text('{"districts": {"Z": {"name": "last"}, "A": {"name": "first"}}}')
    (tmp_path / "r.json").write_text('[{"a": 1}, {"a": null}]')
    found = files.corpus(spark, f"{tmp_path}/*.md", r"Chapter-(\d+)-(.+)\.md").collect()
    assert [(r["part_1"], r["part_2"], r["text"]) for r in found] == [("02", "Rules", "a\nb")]
    assert [tuple(r) for r in files.keyed(spark, str(tmp_path / "d.json"), "districts", "struct<name: string>").collect()] == [(0, "Z", "last"), (1, "A", "first")]
    files.datasets(spark, {"r": (str(tmp_path / "r.json"), "a int")})
    assert [r["a"] for r in spark.table("r").collect()] == [1, None]


def test_writers(spark, tmp_path):
    import json
    import os

    index = spark.createDataFrame([(2, "b", 7), (1, "a", None)], "ord int, section string, line_start int")
    files.write_index(index, f"{tmp_path}/index", "ord")
    part = next(f for f in os.listdir(f"{tmp_path}/index") if f.startswith("part-"))
    assert json.loads((tmp_path / "index" / part).read_text()) == [{"section": "a"}, {"section": "b", "line_start": 7}]
    files.write_sections(spark.createDataFrame([("Section 01, A.md", "x\ny"), ("b.md", "z")], "file string, text string"), f"{tmp_path}/out")
    assert (tmp_path / "out" / "Section 01, A.md").read_text().rstrip("\n") == "x\ny" and (tmp_path / "out" / "b.md").is_file()
    assert files.first_file(files.corpus(spark, f"{tmp_path}/out/*.md"), "b").first()["file"] == "b.md"


def test_named_datasets(spark, tmp_path):
    (tmp_path / "permitted_uses.json").write_text('[{"use": "kennel", "districts": {"A": "X"}, "other": 1}, {"use": "tower"}]')
    (tmp_path / "districts.json").write_text('{"Z": {"name": "last", "key_rules": ["a", "b"]}, "A": {"name": "first"}}')
    (tmp_path / "dimensional_standards.json").write_text('{"principal_structures": [{"district": "A", "min_width_ft": 0}], "accessory_structures": [{"district": "Z", "setback_rear_ft": 5}]}')
    (tmp_path / "subdivision_index.json").write_text('{"types": {"minor": {"name": "Minor", "criteria": ["x"], "any_criteria_triggers": true}}, "plat_requirements": {}}')
    at = lambda name: files.dataset(spark, str(tmp_path), name).collect()
    assert [(r["ord"], r["use"], r["districts"]) for r in at("permitted_uses")] == [(0, "kennel", {"A": "X"}), (1, "tower", None)]
    assert [(r["ord"], r["key"], r["name"], r["key_rules"]) for r in at("districts")] == [(0, "Z", "last", ["a", "b"]), (1, "A", "first", None)]
    assert at("principal_structures")[0]["min_width_ft"] == 0 and at("accessory_structures")[0]["setback_rear_ft"] == 5
    types = files.dataset(spark, str(tmp_path), "types")
    assert types.select("key", t.criteria_label(F.col("all_criteria_required"), F.col("any_criteria_triggers"))).first()[1] == "Criteria (ANY triggers this type):"
    assert at("plat_requirements") == []


def test_features_and_extracted_text(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"features": [{"attributes": {"PIN": "1", "DEEDACRE": 1.5}, "geometry": {"rings": [[[0, 0], [1, 0], [0, 0]]]}}, {"attributes": {"PIN": "2"}}]}')
    rows = files.features(spark, str(tmp_path / "f.json"), "PIN: string, DEEDACRE: double").orderBy("PIN").collect()
    assert [(r["PIN"], r["DEEDACRE"], r["rings"]) for r in rows] == [("1", 1.5, [[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]]), ("2", None, None)]
    (tmp_path / "x.bin").write_bytes(b"ab")
    assert [tuple(r) for r in files.extracted(spark, f"{tmp_path}/x.bin", lambda b: b.decode().upper()).collect()] == [("x.bin", "AB")]
    one = spark.sql("select 1.0D as x, 2.5D as y").select(spatial.point_json(F.col("x"), F.col("y"))).first()[0]
    assert one == '{"x":1.0,"y":2.5}'


def test_keeping_reader_joins_to_the_text(spark):
    df = spark.createDataFrame([(1, "a\n\nb\n"), (2, ""), (3, None)], "id int, text string")
    rows = corpus.lines_kept(df, "id").groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lineno", "line"))), lambda x: x["line"]), "\n").alias("t"))
    assert {r["id"]: r["t"] for r in rows.collect()} == {1: "a\n\nb\n", 2: "", 3: ""}


def test_section_starts_go_on_behind_each_other(spark):
    text = "   SECTION I\ncontents\nSECTION I\nbody one\nEND OF SECTION I\n  SECTION II\nmore\n SECTION II\nx\nSECTION I\ny"
    rows = etl.section_bodies(corpus.lines(spark.createDataFrame([(1, text)], "id int, text string"), "id"), "id", ["I", "II", "III"])
    assert sorted((r["section"], r["first_line"], r["last_line"], r["body"]) for r in rows.collect()) == [("I", 4, 4, "body one"), ("II", 7, 11, "more\n SECTION II\nx\nSECTION I\ny")]


def test_provisions_and_ids(spark):
    text = '1.0  FOREWORD ...... Page 3\n2.08 Leave, an employee,\n1.04.01 Full time\nITEM B)  "\u201cRequest\u201d"\n401 (k)'
    df = etl.provisions(corpus.lines(spark.createDataFrame([(1, text)], "id int, text string"), "id"), "id").withColumn("pid", t.provision_id(F.lit("II"), F.col("number")))
    assert [(r["number"], r["title"], r["level"], r["pid"]) for r in df.orderBy("lineno").collect()] == [("1.0", "FOREWORD", 3, "II-1.0"), ("1.04.01", "Full time", 5, "II-1.04.01"), ("Item B", "Request", 3, "II-Item-B")]
    files_ = {1: "one.md", 14: "last.md"}
    assert [one(spark, x, lambda c: lookup.file_of_article(t.article_of(c), files_)) for x in ("108", "2000", "abc", "700")] == ["one.md", "last.md", None, None]
    assert [one(spark, x, t.chapter_order) for x in ("07", "x", None)] == [7, 999, 999]
    assert one(spark, "n/a", t.currency) == "n/a" and one(spark, ["x", "y"], t.numbered, "array<string>") == ["1. x", "2. y"]


def test_items_of_a_list_lose_blanks_only(spark):
    index = spark.createDataFrame([("8.2", "t"), ("9.1", "u")], "section string, title string")
    out = lookup.csv_join(spark.createDataFrame([("a", "8.2, 8.2,\t9.1 ")], "use string, ids string"), "ids", ",", index, "section")
    assert sorted(r["section"] for r in out.collect()) == ["8.2", "8.2", "9.1"]


def test_not_found_lists_what_there_is(spark):
    known = spark.createDataFrame([("a",), ("b",)], "use string")
    assert render.outcome(lookup.or_alternatives(known.where("use = 'a'"), known), "use", "use") == "a"
    assert render.outcome(lookup.or_alternatives(known.where("false"), known), "use", "use") == "No use found. Available: a, b"
    df = spark.createDataFrame([("R-1", None, ["x", "y"], 3)], "code string, note string, rules array<string>, n_more int")
    assert render.cards(df, "code", {"note": "Note", "rules": "Rules"}) == "## R-1\n**Rules:** x, y"
    assert render.listing(df, "{code}") == "- R-1\n... and 3 more"


def test_documents_search_equals_lines_search(spark):
    texts = ["a the\nb\n\nand c", "THE and", "the", None, "", "x\rthe\r\ny\n\n\nand\nthe\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for query in ("the and", "the", "and the and", "x y"):
        want = search.greedy_dedup(search.window_search(corpus.lines(df, "id"), "id", query), ["id"])
        assert sorted(map(tuple, search.document_search(df, "id", query).collect())) == sorted(map(tuple, want.collect()))


def test_render(spark):
    assert render.table(spark.createDataFrame([(1, "a|b"), (2, None)], "x int, y string"), 1) == "| x | y |\n|---|---|\n| 1 | a\\|b |\n\n... and more"
    assert render.blocks(["a", "", "b"]) == "a\n\n---\n\nb"
