"""URL filter: pattern rules indexed by their rarest literal token.

A rule is (host, path, verdict) plus a regular expression made from it; a rule of the method itself is
(name, literal tokens, regular expression, verdict). Each rule is filed under the one of its literal tokens that the
corpus shows least often. A URL's tokens fetch the rules filed under them, and only those run their expressions.

Up to ``IN_PLAN`` rules are literals of the plan, and URLs are not shuffled. More rules are a table: they are filed by
joins, and the tokens of URLs are joined with the tokens that rules are filed under.

Defined cases: a null URL or one without "://" has an empty host and path, no rule and the default verdict; of several
rules that fit the longest named one decides, of equally long ones the last by name; texts of any length are URLs;
extra columns pass through untouched under ``keep``; repeated rows are judged each for itself; an empty table gives no
rows, and no rules give every URL the default verdict.
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that live in the plan as literals, at most.
IN_PLAN = 256
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    name: str
    tokens: tuple[str, ...]
    regex: str
    verdict: str
    named: bool = True


def path_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host, all its subdomains, and every path that starts with the given one."""
    whole = re.findall(TOKEN, host) + re.findall(TOKEN, path.lower().rpartition("/")[0])
    return Rule(host + path, tuple(dict.fromkeys(whole)), rf"^(?:[^\n]*\.)?{re.escape(host)}\n{re.escape(path)}", verdict)


def word_rule(*tokens: str, verdict: str = "block") -> Rule:
    """Fits a host that holds the tokens one after the other as labels or parts of labels joined by hyphens."""
    return Rule("-".join(tokens), tokens, rf"^[^\n]*(?<![a-z0-9]){'[-.]'.join(map(re.escape, tokens))}(?![a-z0-9])[^\n]*\n", verdict, False)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^(?s)(?:.*?)://([^/?#]*)", 1))
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^(?s)(?:.*?)://[^/?#]*([^?#]*)", 1)), F.lit(""))


def token_counts(pages: DataFrame, url_col: str, tokens: list[str]) -> dict[str, int]:
    """How many URLs hold each token; at most one row a token comes back."""
    known = F.array(*map(F.lit, tokens))
    found = F.array_intersect(F.regexp_extract_all(F.lower(F.coalesce(F.col(url_col), F.lit(""))), F.lit(TOKEN), F.lit(0)), known)
    rows = pages.select(F.explode(found).alias("t")).groupBy("t").count().collect()
    return {t: 0 for t in tokens} | {r["t"]: r["count"] for r in rows}


def index_rules(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token, ties to the first in order of spelling."""
    filed: dict[str, list[Rule]] = {}
    for rule in rules:
        filed.setdefault(min(rule.tokens, key=lambda t: (counts[t], t)), []).append(rule)
    return filed


RULE = "struct<name:string,regex:string,verdict:string,named:boolean>"


def tokens_of(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws("/", host, path)), F.lit(TOKEN), F.lit(0)))


def best_of(fetched: Column, where: Column) -> Column:
    """The deciding rule of those fetched that fit; null if none does. Only here expressions run."""
    fit = F.filter(fetched, lambda r: F.regexp_like(where, r["regex"]))
    fit = F.transform(fit, lambda r: F.struct(r["named"].alias("named"), F.length(r["name"]).alias("n"), r["name"].alias("name"), r["verdict"].alias("verdict")))
    return F.get(F.sort_array(fit, asc=False), F.lit(0))


def filed_rules(pages: DataFrame, rules: DataFrame, url_col: str) -> DataFrame:
    """token, rules: each rule (name, tokens, regex, verdict, named) under the token that the fewest URLs hold."""
    wanted = rules.select("name", F.explode("tokens").alias("token"))
    held = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(url_col), F.lit(""))), F.lit(TOKEN), F.lit(0)))).alias("token"))
    counts = held.groupBy("token").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "token", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least")).select("name", "least.token")
    return rules.join(rarest, "name").groupBy("token").agg(F.collect_list(F.struct("name", "regex", "verdict", "named").cast(RULE)).alias("rules"))


def filter_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """keep columns, host, path, rule, verdict: the longest named rule decides, else any of the method's own, else default."""
    parts = pages.select(F.struct(*keep).alias("k"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    # the pair is matched as one string; a line break ends the host, which cannot hold one once it is replaced
    where = F.concat(F.regexp_replace("host", "\n", " "), F.lit("\n"), F.col("path"))
    none = F.array().cast(f"array<{RULE}>")
    if len(rules) <= IN_PLAN:
        filed = index_rules(rules, token_counts(pages, url_col, sorted({t for r in rules for t in r.tokens}))) if rules else {}
        rule_of = lambda r: F.struct(F.lit(r.name).alias("name"), F.lit(r.regex).alias("regex"), F.lit(r.verdict).alias("verdict"), F.lit(r.named).alias("named")).cast(RULE)
        index = F.create_map(*[x for t, found in filed.items() for x in (F.lit(t), F.array(*map(rule_of, found)))]).cast(f"map<string,array<{RULE}>>")
        parts = parts.select("k", "host", "path", F.explode(F.array(F.struct(where.alias("w"), tokens_of(F.col("host"), F.col("path")).alias("t")))).alias("u"))
        fetched = F.flatten(F.transform(F.col("u.t"), lambda t: F.coalesce(F.try_element_at(index, t), none)))
        parts = parts.select("k", "host", "path", best_of(fetched, F.col("u.w")).alias("best"))
    else:
        listed = pages.sparkSession.createDataFrame([(r.name, list(r.tokens), r.regex, r.verdict, r.named) for r in dict.fromkeys(rules)], "name string, tokens array<string>, regex string, verdict string, named boolean")
        filed = filed_rules(pages, listed, url_col)
        # a row's number tells equal rows apart; a row without tokens keeps its place by a null
        rows = parts.select(F.monotonically_increasing_id().alias("i"), "k", "host", "path", where.alias("w"))
        rows = rows.select("i", "k", "host", "path", "w", F.explode_outer(tokens_of(F.col("host"), F.col("path"))).alias("token"))
        rows = rows.join(filed, "token", "left").select("i", "k", "host", "path", best_of(F.coalesce("rules", none), F.col("w")).alias("best"))
        parts = rows.groupBy("i").agg(F.first("k").alias("k"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("best").alias("best"))
    return parts.select("k.*", "host", "path", F.when(F.col("best.named"), F.col("best.name")).alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


#: The contract's rules, then the method's own words of unwanted hosts.
NAMED = (
    path_rule("com", "/en/", "block"), path_rule("example.com", "/en/7", "allow"), path_rule("net", "/de/", "allow"),
    path_rule("example.net", "/de/8", "block"), path_rule("org", "/es/", "block"),
)
UNWANTED = tuple(tuple(x.split()) for x in (
    "casino", "casinos", "poker", "betting", "bet", "bets", "free bets", "gambling", "jackpot", "roulette", "slots", "lottery",
    "adult", "porn", "porno", "xxx", "sex", "escort", "escorts", "webcam", "hentai", "nude", "nudes",
    "spam", "pills", "viagra", "cialis", "pharmacy", "steroids", "payday loans", "payday", "quick cash",
    "ads track", "ad server", "adserver", "doubleclick", "adclick", "popunder", "tracker", "tracking",
    "malware", "phishing", "warez", "torrent", "torrents", "keygen", "cracked", "serial keys", "botnet", "ransomware", "scam",
))
RULES = (*NAMED, *(word_rule(*tokens) for tokens in UNWANTED))


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), list(RULES))


ORACLE = r"""
with p as (
  select page_id,
    coalesce(case when contains(url, '://') then translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end, '') as host,
    coalesce(case when contains(url, '://') then regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) end, '') as path
  from pages),
r(h, pre, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
q as (
  select page_id, host, path,
    (select max_by(h || pre || '>' || verdict, length(h || pre)) from r where (p.host = h or ends_with(p.host, '.' || h)) and starts_with(p.path, pre)) as hit,
    regexp_matches(host, '(^|[^a-z0-9])(UNWANTED)([^a-z0-9]|$)') as unwanted
  from p)
select page_id, host, path, split_part(hit, '>', 1) as rule,
  coalesce(split_part(hit, '>', 2), case when unwanted then 'block' else 'allow' end) as verdict
from q
""".replace("UNWANTED", "|".join("[-.]".join(x) for x in UNWANTED))
