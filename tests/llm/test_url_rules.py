from quillspark.llm import url_rules
from quillspark.llm.url_rules import path_rule, word_rule

CASES = [
    ("http://Example.COM/en/7x?q", "example.com", "/en/7x", "example.com/en/7", "allow"),
    ("http://a.example.com/en/8", "a.example.com", "/en/8", "com/en/", "block"),
    ("http://xcom/en/8", "xcom", "/en/8", None, "allow"),
    ("http://com/en/", "com", "/en/", "com/en/", "block"),
    ("https://b.example.net/de/81#x", "b.example.net", "/de/81", "example.net/de/8", "block"),
    ("https://b.example.net/de/7", "b.example.net", "/de/7", "net/de/", "allow"),
    ("x://www.casino-win.example.org/fr/1", "www.casino-win.example.org", "/fr/1", None, "block"),
    ("x://casinowin.example.org/fr/1", "casinowin.example.org", "/fr/1", None, "allow"),
    ("x://h.org?es/#/es/", "h.org", "", None, "allow"),
    ("x://a.net/de/://b.com/en/", "a.net", "/de/://b.com/en/", "net/de/", "allow"),
    ("x://com/EN/", "com", "/EN/", None, "allow"),
    ("no scheme/en/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("x://a\nb.com/en/1\n2", "a\nb.com", "/en/1\n2", "com/en/", "block"),
    ("x://" + "a" * 50_000 + ".com/en/", "a" * 50_000 + ".com", "/en/", "com/en/", "block"),
]


def test_cases(spark):
    rows = [(k, c[0], "rule?", "verdict?") for k, c in enumerate(CASES)] * 2
    df = spark.createDataFrame(rows, "page_id bigint, url string, rule string, verdict string")
    out = url_rules.filter_urls(df, list(url_rules.RULES)).orderBy("page_id").collect()
    assert len(out) == 2 * len(CASES)
    for r in out:
        assert tuple(r)[1:] == CASES[r["page_id"]][1:], CASES[r["page_id"]][0][:60]
    assert url_rules.filter_urls(df.limit(0), list(url_rules.RULES)).count() == 0


def test_a_table_of_rules_gives_the_same(spark, monkeypatch):
    rows = [(k, c[0], 7) for k, c in enumerate(CASES)] * 2
    df = spark.createDataFrame(rows, "page_id bigint, url string, i bigint")
    many = [*url_rules.RULES, *(path_rule(f"h{k}.org", f"/p{k}", "block") for k in range(300))]
    df = df.unionByName(spark.createDataFrame([(900 + k, f"x://a.h{k}.org/p{k}x/y", 1) for k in range(0, 300, 50)], df.schema))
    found = url_rules.filter_urls(df, many).orderBy("page_id").collect()
    assert len(found) == 2 * len(CASES) + 6
    for r in found:
        if r["page_id"] < 900:
            assert tuple(r)[1:] == CASES[r["page_id"]][1:]
        else:
            k = r["page_id"] - 900
            assert (r["rule"], r["verdict"]) == (f"h{k}.org/p{k}", "block")
    monkeypatch.setattr(url_rules, "IN_PLAN", 1000)
    assert found == url_rules.filter_urls(df, many).orderBy("page_id").collect()
    assert {r["verdict"] for r in url_rules.filter_urls(df, []).collect()} == {"allow"}
    assert url_rules.filter_urls(df.limit(0), many).count() == 0


def test_columns_of_any_name_are_kept(spark):
    df = spark.sql("select 1L as page_id, 'x://com/en/' as url, 5 as k, 6 as token, 7 as best, 8 as i, 9 as w")
    row = url_rules.filter_urls(df, list(url_rules.RULES), keep=("page_id", "k", "token", "best", "i", "w")).first()
    assert tuple(row) == (1, 5, 6, 7, 8, 9, "com", "/en/", "com/en/", "block")


def test_rules_are_filed_under_the_rarest_token():
    rules = [path_rule("example.com", "/en/7", "allow"), word_rule("free", "bets")]
    filed = url_rules.index_rules(rules, {"example": 9, "com": 5, "en": 5, "free": 0, "bets": 3})
    assert {t: [r.name for r in rs] for t, rs in filed.items()} == {"com": ["example.com/en/7"], "free": ["free-bets"]}
