"""The questions of a rule book as queries over the given tables, each with the SQL that gives the same rows.

A corpus is the lines of all documents with some of them turned into headings; catalogs, districts and parcels are made
from the other tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import corpus, etl
from quillspark.plans.catalog import LINES, STRIP, query, read, texts
from quillspark.plans.rulebook import RuleBook

CODES = ["A-1", "B-2", "C-3", "D-4"]
ALIASES = {"A1": "A-1", "B2": "B-2", "C3": "C-3", "D4": "D-4"}
ROMANS = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]

#: One expression for each corpus, in the words of both engines.
HEADS = {
    "ordinance": "case lineno % 3 when 1 then concat('## Section 8.', doc_id, ' ', line) when 2 then concat('A. ', line) else line end",
    "statutes": "case lineno % 4 when 1 then concat('## 9X-', 100 + lineno, ': ', line) when 3 then concat('### 9X-', 100 + lineno, ': ', line) else line end",
    "town": "case lineno % 3 when 1 then concat('#### Sec. ', doc_id, '-', lineno, '. ', line) else line end",
    "personnel": "case lineno % 2 when 1 then concat(repeat('#', cast(2 + lineno % 5 as int)), ' ', line) else line end",
}
PERMS = "case (p_partkey + {0}) % 4 when 0 then 'X' when 1 then 'C' when 2 then 'S' end"
SPECIAL = "case when p_partkey % 3 = 0 then concat('8.', p_partkey % 7, ', 8.', p_partkey % 5, ',9.9') end"
NOTE = "case when p_partkey % 11 = 0 then 'check size' end"


def lines_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = corpus.lines(texts(spark, sf_dir), "doc_id")
    return rows.selectExpr("cast(doc_id as string) as file", "lineno", f"{HEADS[name]} as line")


def book(spark: SparkSession, sf_dir: str) -> RuleBook:
    docs, part, nation, region = (read(spark, sf_dir, x) for x in ("documents", "part", "nation", "region"))
    raw = corpus.lines(texts(spark, sf_dir), "doc_id")
    square = lambda x, y, s: f"array(array(array({x}, {y}), array({x} + {s}, {y}), array({x} + {s}, {y} + {s}), array({x}, {y} + {s}), array({x}, {y})))"
    perms = ", ".join(f"'{c}', {PERMS.format(i)}" for i, c in enumerate(CODES))
    codes = "array('A-1', 'B-2', 'C-3', 'D-4')"
    facet = lambda df, f, key, name, about: df.selectExpr(f"'{f}' as facet", f"cast({key} as int) as ord", f"{name} as key", f"{about} as name", f"concat('5.', {key}) as section", f"concat('about ', {name}) as summary")
    types = facet(region, "types", "r_regionkey", "lower(r_name)", "concat(r_name, ' type')")
    layer = lambda rows: spark.createDataFrame(rows, "ord int, name string, x double, y double, s double").selectExpr("ord", "name", f"{square('x', 'y', 's')} as rings")
    return RuleBook(CODES, {
        "uses": part.selectExpr("p_partkey as ord", "p_name as use", "p_type as category", f"{SPECIAL} as special_requirements", f"{NOTE} as discrepancy_note", f"map_filter(map({perms}), (k, v) -> v is not null) as districts"),
        "principal": nation.selectExpr("n_nationkey as ord", f"{codes}[n_nationkey % 3] as district", "n_name as use_type", "cast(null as string) as density", "concat(n_regionkey, ' acres') as min_lot_size", "n_regionkey * 10 as min_street_frontage_ft"),
        "accessory": region.selectExpr("r_regionkey as ord", f"{codes}[r_regionkey % 3] as district", "r_regionkey as setback_rear_ft"),
        "rules": spark.createDataFrame([("rule", "average of the neighbours"), ("note", "see the map")], "kind string, text string"),
        "districts": region.where("r_regionkey < 4").selectExpr("r_regionkey as ord", f"{codes}[r_regionkey] as code", "r_name as name", "concat('2.', r_regionkey) as section", "concat(r_name, ' intent') as intent", "lower(r_name) as character", "array(r_name, 'rule') as key_rules"),
        "special": docs.selectExpr("doc_id as ord", "concat('8.', doc_id) as section", "concat(source, ' rules') as title", "concat('about ', lang) as summary", "cast(doc_id as string) as file", "1L as line_start"),
        "general": docs.selectExpr("doc_id as ord", "concat('2.', doc_id) as section", "concat(lang, ' terms') as title", "source as summary", "cast(doc_id as string) as file", "2L as line_start"),
        "subdivision": types.unionByName(facet(nation, "improvements", "n_nationkey", "lower(n_name)", "cast(null as string)")).unionByName(facet(region, "plats", "r_regionkey", "lower(r_name)", "cast(null as string)")).unionByName(facet(region, "procedures", "r_regionkey", "lower(r_name)", "cast(null as string)")),
        **{name: lines_of(spark, sf_dir, name) for name in HEADS},
        "town_index": raw.where("lineno % 3 = 1").selectExpr("doc_id * 100000 + lineno as ord", "concat(doc_id, '-', lineno) as section", "substring(line, 1, 40) as title", "lpad(doc_id, 8, '0') as chapter", "cast(doc_id as string) as file", "lineno as line_start"),
        "personnel_index": raw.where("lineno % 2 = 1").selectExpr("doc_id * 100000 + lineno as ord", f"concat(array({', '.join(map(repr, ROMANS))})[doc_id % 10], '-', doc_id, '.', lineno) as id", "concat(doc_id, '.', lineno) as number", f"array({', '.join(map(repr, ROMANS))})[doc_id % 10] as section", "substring(line, 1, 40) as title", "cast(doc_id as string) as file", "lineno as line_start"),
        "parcels": read(spark, sf_dir, "customer").selectExpr(
            "cast(c_custkey as string) as pin", "concat('P', c_custkey) as parcel_id", "c_name as owner", "case when c_custkey % 9 = 0 then c_mktsegment end as owner2", "concat(c_custkey % 100, ' ', c_mktsegment, ' ST') as address",
            "c_acctbal as deed_acres", "round(c_acctbal, 1) as calc_acres", "case when c_custkey % 6 = 0 then '1' when c_custkey % 6 = 1 then '' end as parent_pin", "c_acctbal as total_value",
            f"{square('(c_custkey % 40) * 100D', 'floor(c_custkey / 40) * 100D', '90D')} as rings"),
        "zones": layer([(0, "A1", -10.0, -10.0, 2000.0), (1, "B-2", 1990.0, -10.0, 50000.0), (2, "C-3", -10.0, 1990.0, 50000.0)]),
        "extended": layer([(0, "belt", -10.0, -10.0, 3000.0)]),
        "corporate": layer([(0, "town", 500.0, 500.0, 800.0)]),
    }, aliases=ALIASES)


def corpus_sql(*names: str) -> str:
    return ", ".join([LINES.strip(), *(f"{n} as (select doc_id::varchar as file, lineno, {HEADS[n]} as line from lines)" for n in names)])


def text_sql(name: str, words: list[str], most: int = 20) -> str:
    """CTE t: the hits of a window search, spread out, the first of them."""
    has = " and ".join(f"contains(lower(array_to_string(near, ' ')), '{w}')" for w in words)
    return f"""
  {name}_n as (select file, lineno, list(line) over (partition by file order by lineno rows between 2 preceding and 2 following) as near from {name}),
  {name}_h as (select file, lineno, substring(array_to_string(list_filter(list_transform(near, lambda x: {STRIP.format('x')}), lambda x: x <> ''), ' '), 1, 300) as snippet from {name}_n where {has}),
  {name}_k as (select file, unnest(list_reduce(list_sort(list(lineno)), lambda k, x: case when x - k[-1] >= 5 then list_append(k, x) else k end, [min(lineno)])) as lineno from {name}_h group by file),
  {name}_r as (select *, row_number() over (order by file, lineno) as i, greatest(count(*) over () - {most}, 0) as n_more from {name}_h join {name}_k using (file, lineno)),
  {name}_t as (select 'text' as branch, file || ':' || lineno as key, null::varchar as title, snippet, n_more::bigint as n_more from {name}_r where i <= {most})"""


def body_sql(hits: str, ends: str, columns: str) -> str:
    """hits (file, line_start, ...) and ends (file, lineno, line, nxt) to bodies."""
    text = STRIP.format("string_agg(o.line, chr(10) order by o.lineno)")
    return f"""
select {columns}, {text} as body from {hits} h join {ends} e on e.file = h.file and e.lineno = h.line_start
  join {ends} o on o.file = h.file and o.lineno >= h.line_start and (e.nxt is null or o.lineno < e.nxt) group by all"""


def ends_sql(name: str, boundary: str) -> str:
    return f"(select file, lineno, line, min(case when {boundary} then lineno end) over (partition by file order by lineno rows between 1 following and unbounded following) as nxt from {name})"


USES = f"select p_partkey as ord, p_name as use, p_type as category, {SPECIAL} as special_requirements, {NOTE} as discrepancy_note, p_partkey from part"
CODE_ROWS = "(values (0, 'A-1'), (1, 'B-2'), (2, 'C-3'), (3, 'D-4')) c(place, district)"
LABEL = "case {0} when 'X' then 'Permitted by Right' when 'C' then 'Conditional Zoning' when 'S' then 'Special Use' end"
STANDARDS = """
  principal as (select n_nationkey as ord, ['A-1', 'B-2', 'C-3'][n_nationkey % 3 + 1] as district, n_name as use_type, null::varchar as density, n_regionkey || ' acres' as min_lot_size, n_regionkey * 10 as min_street_frontage_ft from nation)"""


@query(f"with u as ({USES}) select ord, use, category, place, district, {LABEL.format(PERMS.format('place'))} as permission, discrepancy_note from u, {CODE_ROWS} where contains(lower(use), 'widget')")
def tool_permitted_use(spark, sf_dir):
    return book(spark, sf_dir).permitted_use("Widget")


@query(f"with u as ({USES}) select ord, use, category, 0 as place, 'B-2' as district, {LABEL.format(PERMS.format(1))} as permission, discrepancy_note from u where contains(lower(category), 'economy')")
def tool_permitted_use_by_category(spark, sf_dir):
    return book(spark, sf_dir).permitted_use("economy", "b2")


@query(f"""
with {STANDARDS}, found as (
  select 'principal' as kind, ord, use_type, min_lot_size, min_street_frontage_ft, null::int as setback_rear_ft, null as text from principal where district = 'B-2'
  union all select 'accessory', r_regionkey, null, null, null, r_regionkey, null from region where r_regionkey % 3 = 1)
select * from found union all select k, null, null, null, null, null, x from (values ('rule', 'average of the neighbours'), ('note', 'see the map')) r(k, x) where exists (select 1 from found)
""")
def tool_dimensional_standards(spark, sf_dir):
    return book(spark, sf_dir).dimensional_standards("B-2").select("kind", "ord", "use_type", "min_lot_size", "min_street_frontage_ft", "setback_rear_ft", "text")


DISTRICTS = "select r_regionkey as ord, ['A-1', 'B-2', 'C-3', 'D-4'][r_regionkey + 1] as code, r_name as name, '2.' || r_regionkey as section, r_name || ' intent' as intent, lower(r_name) as character, r_name || ';rule' as rules from region where r_regionkey < 4"


@query(f"select * from ({DISTRICTS}) where code = 'C-3'")
def tool_district_info(spark, sf_dir):
    return book(spark, sf_dir).district_info("c3").select("ord", "code", "name", "section", "intent", "character", F.array_join("key_rules", ";").alias("rules"))


@query(f"select ord, code, name, character from ({DISTRICTS})")
def tool_list_districts(spark, sf_dir):
    return book(spark, sf_dir).list_districts()


INDEX = "select doc_id as ord, '{0}.' || doc_id as section, {1} as title, {2} as summary, doc_id::varchar as file, {3} as line_start from documents"
SPECIAL_INDEX = INDEX.format(8, "source || ' rules'", "'about ' || lang", 1)
GENERAL_INDEX = INDEX.format(2, "lang || ' terms'", "source", 2)


@query(f"with {corpus_sql('ordinance')}, h as (select * from ({SPECIAL_INDEX}) where contains(lower(title), 'src1 rules')), e as {ends_sql('ordinance', 'starts_with(line, ' + repr('## Section 8.') + ')')} {body_sql('h', 'e', 'h.section, h.title')}")
def tool_special_requirements(spark, sf_dir):
    return book(spark, sf_dir).special_requirements("SRC1 Rules").select("section", "title", "body")


@query(f"""
with {corpus_sql('ordinance')}, h as (select * from ({GENERAL_INDEX}) where starts_with(section, '2.2') and section <> '2.2'), one as (select * from ({GENERAL_INDEX}) where section = '2.2'),
  p as (select * from one union all select * from h where not exists (select 1 from one)),
  e as (select file, lineno, line, min(case when starts_with(line, '## Section') or regexp_matches(line, '^[A-Z]\\.') then lineno end) over w as nxt, min(case when starts_with(line, '## Section') then lineno end) over w as flat from ordinance window w as (partition by file order by lineno rows between 1 following and unbounded following)),
  f as (select section, title, file, line_start, starts_with(section, '2.2') and length(section) > 3 as lettered from p)
select f.section, f.title, {STRIP.format("string_agg(o.line, chr(10) order by o.lineno)")} as body from f join e on e.file = f.file and e.lineno = f.line_start
  join e o on o.file = f.file and o.lineno >= f.line_start and o.lineno < coalesce(case when lettered then e.nxt else e.flat end, 1000000000) group by all
""".replace("section <> '2.2'", "true"))
def tool_general_provisions(spark, sf_dir):
    return book(spark, sf_dir).general_provisions("2.2").select("section", "title", "body")


@query(f"""
with {corpus_sql('ordinance')}, e as {ends_sql('ordinance', 'starts_with(line, ' + repr('## Section') + ') or regexp_matches(line, ' + repr('^[A-Z][.]') + ')')}, g as {ends_sql('ordinance', 'starts_with(line, ' + repr('## Section') + ')')},
  h as (select * from ({GENERAL_INDEX})), one as (select * from h where starts_with(section, '2.2') and length(section) > 3), two as (select * from h where not (starts_with(section, '2.2') and length(section) > 3))
({body_sql('one', 'e', 'h.section, h.title')}) union all ({body_sql('two', 'g', 'h.section, h.title')})
""")
def tool_general_provisions_all(spark, sf_dir):
    return book(spark, sf_dir).general_provisions("all").select("section", "title", "body")


SUBDIVISION = """
  s as (select 'types' as facet, r_regionkey as ord, lower(r_name) as key, r_name || ' type' as name from region union all select 'improvements', n_nationkey, lower(n_name), null from nation
    union all select 'plats', r_regionkey, lower(r_name), null from region union all select 'procedures', r_regionkey, lower(r_name), null from region)"""


@query(f"with {SUBDIVISION} select facet, ord, key, name from s where facet in ('plats', 'procedures') or (facet = 'types') or (facet = 'improvements' and (contains(key, 'nation_1') or contains('about ' || key, 'plat')))")
def tool_subdivision(spark, sf_dir):
    return book(spark, sf_dir).subdivision_requirements("plat asia nation_1").select("facet", "ord", "key", "name")


@query(f"with {SUBDIVISION} select facet, ord, key, name from s where facet = 'types'")
def tool_subdivision_default(spark, sf_dir):
    return book(spark, sf_dir).subdivision_requirements("zzz").select("facet", "ord", "key", "name")


def any_sql(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def ordinance_search_sql(words: list[str]) -> str:
    return f"""{text_sql('ordinance', words)},
  uses_h as (select *, row_number() over (order by ord) as i, greatest(count(*) over () - 15, 0) as n_more from ({USES}) where {any_sql("concat_ws(' ', use, category, special_requirements)", words)}),
  found as (select 'uses' as branch, ord::varchar as key, use as title, category as snippet, n_more::bigint as n_more from uses_h where i <= 15
  union all select 'districts', code, name, substring(intent, 1, 150), 0 from ({DISTRICTS}) where {any_sql("concat_ws(' ', code, name, intent, character, name || ' rule')", words)}
  union all select 'special', section, title, substring(summary, 1, 150) || '...', 0 from ({SPECIAL_INDEX}) where {any_sql("concat_ws(' ', section, title, summary)", words)}
  union all select 'general', section, title, substring(summary, 1, 150) || '...', 0 from ({GENERAL_INDEX}) where {any_sql("concat_ws(' ', section, title, summary)", words)}
  union all select 'subdivision', '5.' || ord, array_to_string(list_transform(string_split(replace(key, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), substring('about ' || key, 1, 120) || '...', 0 from s where {any_sql("concat_ws(' ', key, name, 'about ' || key)", words)}
  union all select * from ordinance_t)"""


@query(f"with {corpus_sql('ordinance')}, {SUBDIVISION}, {ordinance_search_sql(['the', 'asia', 'and'][:2])} select * from found")
def tool_search_ordinance(spark, sf_dir):
    return book(spark, sf_dir).search_ordinance("the Asia")


ASIA = ["license", "version"]


def town_search_sql(words: list[str]) -> str:
    return f"""{text_sql('town', words)},
  titles as (select *, row_number() over (order by ord) as i, greatest(count(*) over () - 20, 0)::bigint as n_more from (select doc_id * 100000 + lineno as ord, doc_id || '-' || lineno as section, substring(line, 1, 40) as title from lines where lineno % 3 = 1) where {any_sql("concat_ws(' ', section, title)", words)}),
  town_found as (select 'titles' as branch, section as key, title, null::varchar as snippet, n_more from titles where i <= 20 union all select * from town_t)"""


@query(f"with {corpus_sql('town')}, {town_search_sql(ASIA)} select * from town_found")
def tool_search_town_code(spark, sf_dir):
    return book(spark, sf_dir).search_town_code("License version")


@query(f"with {corpus_sql('ordinance', 'town')}, {SUBDIVISION}, {ordinance_search_sql(ASIA)}, {town_search_sql(ASIA)} select *, 'ordinance' as origin from found union all select *, 'town_code' from town_found")
def tool_search_all(spark, sf_dir):
    return book(spark, sf_dir).search_all("license Version")


@query(f"""
with {corpus_sql('personnel')}, {text_sql('personnel', ASIA)},
  titles as (select *, row_number() over (order by ord) as i, greatest(count(*) over () - 20, 0)::bigint as n_more from (select doc_id * 100000 + lineno as ord, [{', '.join(map(repr, ROMANS))}][doc_id % 10 + 1] || '-' || doc_id || '.' || lineno as id, substring(line, 1, 40) as title from lines where lineno % 2 = 1) where {any_sql("concat_ws(' ', id, title)", ASIA)})
select 'titles' as branch, id as key, title, null::varchar as snippet, n_more from titles where i <= 20 union all select * from personnel_t
""")
def tool_search_personnel(spark, sf_dir):
    return book(spark, sf_dir).search_personnel_policy("version license")


@query(f"""
with {corpus_sql('statutes')}, n as (select file, lineno, line, lower(array_to_string(list(line) over (partition by file order by lineno rows between 1 preceding and 1 following), ' ')) as near from statutes),
  one as (select file, lineno, line from n where contains(lower(line), '9x-104') and contains(lower(line), 'the')), wide as (select file, lineno, line from n where contains(near, '9x-103') and contains(near, '9x-105')),
  r as (select file, lineno, substring(line, 1, 150) as snippet, row_number() over (order by file, lineno) as i, greatest(count(*) over () - 30, 0)::bigint as n_more from wide)
select file, lineno, snippet, n_more from r where i <= 30
""")
def tool_search_statutes(spark, sf_dir):
    return book(spark, sf_dir).search_statutes("9X-103 9x-105")


@query(f"""
with {corpus_sql('statutes')}, v as (select *, case when regexp_matches(line, '^#{{2,3}} ') then length(regexp_extract(line, '^(#+)', 1)) end as level from statutes),
  e as (select *, min(case when level <= 2 then lineno end) over w as n2, min(case when level <= 3 then lineno end) over w as n3 from v window w as (partition by file order by lineno rows between 1 following and unbounded following)),
  f as (select file, lineno, line, case level when 2 then n2 when 3 then n3 end as nxt from e),
  h as (select file, lineno as line_start, line as title, '105' as section from statutes where regexp_matches(line, '^#{{2,3}}\\s+9[Xx]-105(?:[^0-9A-Za-z.]|$)'))
{body_sql('h', 'f', 'h.file, h.section, h.title')}
""")
def tool_statute_section(spark, sf_dir):
    return book(spark, sf_dir).statute_section("9x-105", "9X").select("file", "section", "title", "body")


TOWN_INDEX = "select doc_id * 100000 + lineno as ord, doc_id || '-' || lineno as section, substring(line, 1, 40) as title, lpad(doc_id::varchar, 8, '0') as chapter, doc_id::varchar as file, lineno as line_start from lines where lineno % 3 = 1"


@query(f"with {LINES} select ord, section, title from ({TOWN_INDEX}) where ltrim(chapter, '0') = '7'")
def tool_ordinance_chapter(spark, sf_dir):
    return book(spark, sf_dir).ordinance_section("chapter: 007").select("ord", "section", "title")


@query(f"with {corpus_sql('town')}, h as (select * from ({TOWN_INDEX}) where starts_with(section, '12-')), e as {ends_sql('town', 'regexp_matches(line, ' + repr('^#{2,4}[ ]+Sec[.]') + ')')} {body_sql('h', 'e', 'h.section, h.title')}")
def tool_ordinance_section(spark, sf_dir):
    return book(spark, sf_dir).ordinance_section("12").select("section", "title", "body")


STAFF_INDEX = f"select doc_id * 100000 + lineno as ord, [{', '.join(map(repr, ROMANS))}][doc_id % 10 + 1] || '-' || doc_id || '.' || lineno as id, [{', '.join(map(repr, ROMANS))}][doc_id % 10 + 1] as section, substring(line, 1, 40) as title, doc_id::varchar as file, lineno as line_start from lines where lineno % 2 = 1"


@query(f"with {LINES}, r as (select *, row_number() over (order by ord) as i, greatest(count(*) over () - 50, 0)::bigint as n_more from ({STAFF_INDEX}) where section = 'IV') select id, title, n_more, null::varchar as body from r where i <= 50")
def tool_personnel_listing(spark, sf_dir):
    return book(spark, sf_dir).personnel_policy("Section IV").select("id", "title", "n_more", "body")


@query(f"""
with {corpus_sql('personnel')}, v as (select *, nullif(length(regexp_extract(line, '^(#{{2,6}}) ', 1)), 0) as level from personnel),
  f as (select a.file, a.lineno, a.line, (select min(b.lineno) from v b where b.file = a.file and b.lineno > a.lineno and b.level <= coalesce(a.level, 6)) as nxt from v a where a.file = '12'),
  h as (select *, 0::bigint as n_more from ({STAFF_INDEX}) where id = 'III-12.3')
{body_sql('h', 'f', 'h.id, h.title, h.n_more')}
""")
def tool_personnel_policy(spark, sf_dir):
    return book(spark, sf_dir).personnel_policy("iii-12.3").select("id", "title", "n_more", "body")


@query(f"""
with {STANDARDS}, u as (select * from ({USES}) where contains(lower(use), 'ring')), p as (select *, {PERMS.format(0)} as perm from u),
  need as (select ord, string_agg(distinct section || ' ' || title, ';' order by section || ' ' || title) as requirements from (select ord, trim(unnest(string_split(special_requirements, ','))) as section from p where perm is not null) join (select section, title from ({SPECIAL_INDEX})) using (section) group by ord)
select p.ord, p.use, p.discrepancy_note, 'A-1' as district, {LABEL.format('perm')} as permission,
  case when perm is null then array_to_string(list_filter([case when {PERMS.format(1)} is not null then 'B-2' end, case when {PERMS.format(2)} is not null then 'C-3' end, case when {PERMS.format(3)} is not null then 'D-4' end], lambda x: x is not null), ';') end as elsewhere,
  requirements, (select string_agg(use_type || ' ' || min_lot_size, ';' order by ord) from principal where district = 'A-1') as standards
from p left join need using (ord)
""")
def tool_can_build(spark, sf_dir):
    rows = book(spark, sf_dir).can_build("RING", "a1")
    need = F.array_sort(F.array_distinct(F.transform("requirements", lambda x: F.concat_ws(" ", x["section"], x["title"]))))
    return rows.select(
        "ord", "use", "discrepancy_note", "district", "permission", F.array_join("elsewhere", ";").alias("elsewhere"), F.array_join(need, ";").alias("requirements"),
        F.array_join(F.transform("standards", lambda x: F.concat_ws(" ", x["use_type"], x["min_lot_size"])), ";").alias("standards"),
    )


@query(f"with u as ({USES}) select ord, use, false as found from u where not exists (select 1 from u where contains(lower(use), 'no such') or contains(lower(category), 'no such'))")
def tool_use_alternatives(spark, sf_dir):
    return book(spark, sf_dir).use_or_alternatives("No such").select("ord", "use", "found")


PARCELS = """
  p as (select c_custkey as k, c_custkey::varchar as pin, c_name as owner, case when c_custkey % 9 = 0 then c_mktsegment end as owner2, (c_custkey % 100) || ' ' || c_mktsegment || ' ST' as address, c_mktsegment || ' ST' as street, c_acctbal,
    (c_custkey % 40) * 100.0::double as x0, (c_custkey // 40) * 100.0::double as y0, x0 + 36 as x, y0 + 36 as y from customer),
  z as (select *, case when x > -10 and x < 1990 and y > -10 and y < 1990 then 'A-1' when x > 1990 and x < 51990 and y > -10 and y < 49990 then 'B-2' when x > -10 and x < 49990 and y > 1990 and y < 51990 then 'C-3' end as zone_code from p)"""


@query(f"""
with {STANDARDS}, {PARCELS}, f as (select *, row_number() over (order by pin) as i, greatest(count(*) over () - 25, 0)::bigint as n_more from z where contains(upper(address), '7 BUILDING'))
select pin, address, n_more, zone_code, case when x > 500 and x < 1300 and y > 500 and y < 1300 then 'inside' when x > -10 and x < 2990 and y > -10 and y < 2990 then 'extended' else 'outside' end as jurisdiction,
  coalesce('$' || format('{{:,.0f}}', c_acctbal), 'N/A') as total, abs(c_acctbal - round(c_acctbal, 1)) > 0.1 as acreage_differs, k % 6 = 0 as was_split, street,
  (select min_by(use_type, ord) from principal where district = zone_code) as use_type, (select min_by(min_street_frontage_ft, ord) from principal where district = zone_code) as min_street_frontage_ft, '' as failed_layers
from f where i <= 25
""")
def tool_parcel_info(spark, sf_dir):
    rows = book(spark, sf_dir).parcel_info(address="7 building")
    return rows.select("pin", "address", "n_more", "zone_code", "jurisdiction", "total", "acreage_differs", "was_split", "street", "use_type", "min_street_frontage_ft", "failed_layers")


@query(f"""
with {PARCELS}, s as (select * from z where pin = '45'),
  n as (select s.pin as own_pin, z.pin, z.address, z.street = s.street as same_street from z, s where z.pin <> s.pin and z.zone_code = s.zone_code
    and sqrt(pow(greatest(z.x0 - s.x, s.x - z.x0 - 90, 0), 2) + pow(greatest(z.y0 - s.y, s.y - z.y0 - 90, 0), 2)) <= 300)
select *, count(*) over (partition by own_pin, same_street) as n_in_part from n
""")
def tool_infill_context(spark, sf_dir):
    return book(spark, sf_dir).infill_context("P45").select("own_pin", "pin", "address", "same_street", "n_in_part")


@query(f"""
with {LINES}, m as (select doc_id, lineno, line, case lineno % 8 when 2 then '  SECTION I' when 3 then chr(12) || 'SECTION I' when 5 then 'END OF SECTION I' when 6 then ' SECTION II' else line end as l from lines),
  one as (select doc_id, coalesce(min(case when l = chr(12) || 'SECTION I' then lineno end), min(case when l = '  SECTION I' then lineno end)) as start from m group by 1),
  two as (select m.doc_id, min(m.lineno) as start from m left join one using (doc_id) where l = ' SECTION II' and m.lineno > coalesce(one.start, 0) group by 1),
  ends as (select doc_id, max(lineno) as e from m where l = 'END OF SECTION I' group by 1), size as (select doc_id, max(lineno) as n from m group by 1)
select doc_id, 'I' as section, one.start + 1 as first_line, coalesce(e, two.start, n + 1) - 1 as last_line from one join size using (doc_id) left join two using (doc_id) left join ends using (doc_id) where one.start is not null
union all select doc_id, 'II', start + 1, n from two join size using (doc_id)
""")
def etl_section_bodies(spark, sf_dir):
    rows = corpus.lines(texts(spark, sf_dir), "doc_id")
    line = F.when(F.col("lineno") % 8 == 2, "  SECTION I").when(F.col("lineno") % 8 == 3, "\fSECTION I").when(F.col("lineno") % 8 == 5, "END OF SECTION I").when(F.col("lineno") % 8 == 6, " SECTION II").otherwise(F.col("line"))
    return etl.section_bodies(rows.withColumn("line", line), "doc_id", ["I", "II"]).select("doc_id", "section", "first_line", "last_line")


@query(f"with {LINES} select doc_id, lineno, case lineno % 3 when 1 then '1.0' when 2 then '2.08' else 'Item B' end as number, case lineno % 3 when 1 then 3 when 2 then 4 else 3 end as level, case lineno % 3 when 0 then 'Leave' else 'Pay' end as title from lines where not (lineno % 3 = 2 and lineno % 2 = 0)")
def etl_provisions(spark, sf_dir):
    k = F.col("lineno")
    line = F.when(k % 3 == 1, "1.0  Pay ..... Page 4").when((k % 3 == 2) & (k % 2 == 0), "2.08 Pay, as said,").when(k % 3 == 2, "2.08 Pay.").otherwise('ITEM B)  "Leave"')
    rows = corpus.lines(texts(spark, sf_dir), "doc_id").withColumn("line", line)
    return etl.provisions(rows, "doc_id").select("doc_id", "lineno", "number", F.col("level").cast("int").alias("level"), "title")
