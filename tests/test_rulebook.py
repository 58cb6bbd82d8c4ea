"""Each question of a rule book, on small invented tables."""

import pytest

from quillspark.operators import corpus
from quillspark.plans.rulebook import RuleBook

ORDINANCE = "## Section 2.1 Scope\nscope text\n## Section 2.2D Yards\nA. first\nyard text\nB. second\n## Section 8.1 Kennels\nkennel rules\nnoise at night\n## Section 8.2 Towers\ntower rules"
STATUTES = "# Article\n## 9X-702: Zoning\nzoning power\nby board\n### 9X-703: Districts\ndistrict kinds\n## 9X-7: Other\nother"
TOWN = "#### Sec. 1-1. Dogs.\nDogs on a leash\nalways\n#### Sec. 1-2. Cats.\nCats roam\n## ARTICLE II\n#### Sec. 2-1. Noise.\nquiet hours"
STAFF = "## I Pay\n### 1.0 Pay days\nfriday\n#### 1.1 Overtime\nextra\n### 2.0 Raises\nyearly"


def square(x, y, side):
    x, y, side = float(x), float(y), float(side)
    return [[[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]]


@pytest.fixture(scope="module")
def book(spark):
    frame = spark.createDataFrame
    rings = "rings array<array<array<double>>>"
    text = lambda name, body: corpus.lines(frame([(name, body)], "file string, text string"), "file").cache()
    index = "ord int, section string, title string, summary string, file string, line_start bigint"
    town = "ord int, section string, title string, chapter string, file string, line_start bigint"
    staff = "ord int, id string, number string, section string, title string, file string, line_start bigint"
    return RuleBook(["R-1", "C-B", "PUD"], {
        "uses": frame([
            (0, "Dog kennel", "Animals", "8.1, 9.9", None, {"R-1": "C", "C-B": "X"}), (1, "Radio tower", "Utilities", None, "see map", {"C-B": "S"}), (2, "Animal clinic", "Animals", None, None, {"R-1": "odd"}),
        ], "ord int, use string, category string, special_requirements string, discrepancy_note string, districts map<string,string>"),
        "principal": frame([(0, "R-1", "house", "3 an acre", None, 60), (1, "R-1", "duplex", None, None, 80)], "ord int, district string, use_type string, density string, min_lot_size string, min_street_frontage_ft int"),
        "accessory": frame([(0, "R-1", 5)], "ord int, district string, setback_rear_ft int"),
        "districts": frame([(0, "R-1", "Residential", "2.1", "quiet homes", "low", ["no shops"]), (1, "C-B", "Business", "2.2", "shops", "busy", [])], "ord int, code string, name string, section string, intent string, character string, key_rules array<string>"),
        "special": frame([(0, "8.1", "Kennels", "dogs and noise", "o", 7), (1, "8.2", "Towers", "height", "o", 10)], index),
        "general": frame([(0, "2.1", "Scope", "scope", "o", 1), (1, "2.2DA", "First yard", "front yard", "o", 4), (2, "2.2D", "Yards", "yards", "o", 3)], index),
        "subdivision": frame([("types", 0, "minor", "Minor subdivision", "5.1", "few lots"), ("types", 1, "major", "Major subdivision", "5.2", "many lots"), ("improvements", 2, "water_lines", None, "5.3", "pipes and hydrants"), ("plats", 3, "final", None, "5.4", "to record")], "facet string, ord int, key string, name string, section string, summary string"),
        "ordinance": text("o", ORDINANCE), "statutes": text("s", STATUTES), "town": text("t", TOWN), "personnel": text("p", STAFF),
        "town_index": frame([(0, "1-1", "Dogs", "01", "t", 1), (1, "1-2", "Cats", "01", "t", 4), (2, "2-1", "Noise", "02", "t", 7)], town),
        "personnel_index": frame([(0, "I-1.0", "1.0", "I", "Pay days", "p", 2), (1, "I-1.1", "1.1", "I", "Overtime", "p", 4), (2, "I-2.0", "2.0", "I", "Raises", "p", 6)], staff),
        "parcels": frame([
            ("1", "A", "SMITH", None, "100 MAIN ST", 1.0, 1.5, "0", 150000.0, square(0, 0, 100)), ("2", "B", "JONES", "SMITH JR", "102 MAIN ST", 1.0, 1.0, None, None, square(150, 0, 100)),
            ("3", "C", "DOE", None, "7 OAK AVE", 1.0, 1.0, None, 5.0, square(0, 150, 100)), ("4", "D", "ROE", None, "9 FAR RD", 1.0, 1.0, None, 5.0, square(5000, 0, 100)), ("5", "E", "NIL", None, None, None, None, None, None, []),
        ], f"pin string, parcel_id string, owner string, owner2 string, address string, deed_acres double, calc_acres double, parent_pin string, total_value double, {rings}"),
        "zones": frame([(0, "R1", square(-10, -10, 1000)), (1, "C-B", square(4000, -10, 3000))], f"ord int, name string, {rings}"),
        "extended": frame([(0, "ring", square(4000, -10, 3000))], f"ord int, name string, {rings}"),
        "corporate": frame([(0, "Town", square(-10, -10, 1000))], f"ord int, name string, {rings}"),
    }, aliases={"R1": "R-1", "CB": "C-B"})


def test_uses(book):
    rows = book.permitted_use("KENNEL").orderBy("place").collect()
    assert [(r["district"], r["permission"]) for r in rows] == [("R-1", "Conditional Zoning"), ("C-B", "Permitted by Right"), ("PUD", None)]
    assert [r["use"] for r in book.permitted_use("animals", "r1").orderBy("ord").collect()] == ["Dog kennel", "Animal clinic"]
    assert [r["permission"] for r in book.permitted_use("clinic", "R-1").collect()] == ["odd"]
    with pytest.raises(ValueError):
        book.permitted_use("x", "Q-9")


def test_can_build(book):
    row = book.can_build("kennel", "R-1").first()
    assert [x["title"] for x in row["requirements"]] == ["Kennels"] and [x["use_type"] for x in row["standards"]] == ["house", "duplex"] and row["elsewhere"] is None
    row = book.can_build("tower", "R-1").first()
    assert row["permission"] is None and row["elsewhere"] == ["C-B"] and row["discrepancy_note"] == "see map"


def test_districts(book):
    assert sorted(r["kind"] for r in book.dimensional_standards("R-1").collect()) == ["accessory", "principal", "principal"]
    assert book.dimensional_standards("PUD").count() == 0
    assert [r["name"] for r in book.district_info("cb").collect()] == ["Business"] and book.district_info("all").count() == 2
    assert [r["code"] for r in book.list_districts().collect()] == ["R-1", "C-B"]


def test_sections(book):
    body = lambda df: {r["section"]: r["body"] for r in df.collect()}
    assert body(book.special_requirements("8.1")) == {"8.1": "## Section 8.1 Kennels\nkennel rules\nnoise at night"}
    assert set(body(book.special_requirements("8"))) == {"8.1", "8.2"} and set(body(book.special_requirements("HEIGHT"))) == {"8.2"}
    assert body(book.general_provisions("2.2DA")) == {"2.2DA": "A. first\nyard text"}
    assert set(body(book.general_provisions("all"))) == {"2.1", "2.2D", "2.2DA"}
    assert body(book.statute_section("702", "9X")) == {"702": "## 9X-702: Zoning\nzoning power\nby board\n### 9X-703: Districts\ndistrict kinds"}
    assert body(book.statute_section("9x-703", "9X")) == {"703": "### 9X-703: Districts\ndistrict kinds"}
    # an id is matched whole
    assert body(book.statute_section("70", "9X")) == {}
    assert body(book.ordinance_section("1-2")) == {"1-2": "#### Sec. 1-2. Cats.\nCats roam\n## ARTICLE II"}
    assert [r["section"] for r in book.ordinance_section("chapter:1").collect()] == ["1-1", "1-2"]
    assert set(body(book.ordinance_section("1"))) == {"1-1", "1-2"}


def test_personnel(book):
    assert [r["id"] for r in book.personnel_policy("section I").orderBy("ord").collect()] == ["I-1.0", "I-1.1", "I-2.0"]
    assert [r["body"] for r in book.personnel_policy("1.0").collect()] == ["### 1.0 Pay days\nfriday\n#### 1.1 Overtime\nextra"]
    assert [r["id"] for r in book.personnel_policy("raise").collect()] == ["I-2.0"]
    assert book.personnel_policy("civil").count() == 0


def test_subdivision(book):
    keys = lambda q: {r["key"] for r in book.subdivision_requirements(q).collect()}
    assert keys("minor") == {"minor", "major"} and keys("all") == {"minor", "major", "water_lines", "final"}
    assert keys("final plat") == {"final"} and keys("hydrants") == {"water_lines"} and keys("zzz") == {"minor", "major"}


def test_subdivision_routes(book):
    facets = lambda q: sorted({r["facet"] for r in book.subdivision_requirements(q).collect()})
    assert facets("lot split") == facets("two-lot") == ["types"] and facets("guarantee") == []
    assert facets("zoning permit") == [] and facets("improvements") == facets("infrastructure") == ["improvements"]
    assert facets("minor hydrants") == ["improvements", "types"]


def test_layers_that_fail(book, spark):
    part = RuleBook(book.codes, {k: v for k, v in book.tables.items() if k not in ("extended", "corporate")}, aliases=book.aliases)
    assert [(r["jurisdiction"], r["failed_layers"], r["zone_code"]) for r in part.parcel_info(pin="1").collect()] == [("unknown", "extended,corporate", "R-1")]
    one = RuleBook(book.codes, {k: v for k, v in book.tables.items() if k != "corporate"}, aliases=book.aliases)
    assert [(r["jurisdiction"], r["failed_layers"]) for r in one.parcel_info(pin="1").collect()] == [("outside", "corporate")]
    assert [r["in_extended_area"] for r in book.parcel_info(pin="4").collect()] == [True]
    assert {r["pin"]: r["n_in_part"] for r in book.infill_context("1").collect()} == {"2": 1, "3": 1}


def test_rules_come_with_standards_only(book, spark):
    more = RuleBook(book.codes, book.tables | {"rules": spark.createDataFrame([("rule", "x")], "kind string, text string")})
    assert sorted(r["kind"] for r in more.dimensional_standards("R-1").collect()) == ["accessory", "principal", "principal", "rule"]
    assert more.dimensional_standards("PUD").count() == 0


def test_searches(book):
    found = lambda df: {(r["branch"], r["key"]) for r in df.collect()}
    assert found(book.search_ordinance("noise kennel")) == {("uses", "0"), ("special", "8.1"), ("text", "o:7")}
    assert found(book.search_town_code("leash dogs")) == {("titles", "1-1"), ("text", "t:1")}
    assert found(book.search_personnel_policy("overtime")) == {("titles", "I-1.1"), ("text", "p:2")}
    assert {r["origin"] for r in book.search_all("noise").collect()} == {"ordinance", "town_code"}
    assert [(r["lineno"], r["n_more"]) for r in book.search_statutes("ZONING power").collect()] == [(3, 0)]
    assert sorted(r["lineno"] for r in book.search_statutes("board power").collect()) == [3, 4]
    with pytest.raises(ValueError):
        book.search_statutes(" ")


def test_parcels(book):
    row = book.parcel_info(pin="1").first()
    assert (row["zone_code"], row["jurisdiction"], row["total"], row["acreage_differs"], row["was_split"], row["street"], row["use_type"]) == ("R-1", "inside", "$150,000", True, True, "MAIN ST", "house")
    assert [r["pin"] for r in book.parcel_info(pin="B").collect()] == ["2"]
    assert {r["pin"] for r in book.parcel_info(owner="smith").collect()} == {"1", "2"}
    assert [(r["pin"], r["jurisdiction"]) for r in book.parcel_info(address="far").collect()] == [("4", "extended")]
    assert [r["jurisdiction"] for r in book.parcel_info(pin="5").collect()] == [None]
    with pytest.raises(ValueError):
        book.parcel_info(pin="1", owner="x")


def test_infill(book):
    rows = {r["pin"]: r["same_street"] for r in book.infill_context("1").collect()}
    assert rows == {"2": True, "3": False}
    # found by its other id, the subject is still left out
    assert {r["pin"] for r in book.infill_context("A").collect()} == {"2", "3"}
