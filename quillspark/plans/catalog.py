"""Every query of the engine, by name, and the SQL that gives the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as t
from quillspark.operators import corpus, etl, lookup, search, spatial
from quillspark.plans.staging import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINES = r"""
  w as (select doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') as x from documents),
  a as (select doc_id, string_split(case when ends_with(x, chr(10)) then left(x, length(x) - 1) else x end, chr(10)) as ls from w where x <> ''),
  lines as (select doc_id, generate_subscripts(ls, 1)::bigint as lineno, unnest(ls) as line from a)
"""
STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def doc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lines(texts(spark, sf_dir), "doc_id")


@query(f"with {LINES} select doc_id, lineno, line from lines")
def doc_lines(spark, sf_dir):
    return doc_rows(spark, sf_dir)


@query(f"with {LINES} select doc_id, lineno, substring(line, 1, 150) as snippet from lines where contains(lower(line), 'license') and contains(lower(line), 'the')")
def search_line_all_words(spark, sf_dir):
    return search.line_search(doc_rows(spark, sf_dir), "License the")


@query("select p_partkey, p_name, p_brand from part where contains(lower(concat_ws(' ', p_name, p_type, p_brand)), 'green') or contains(lower(concat_ws(' ', p_name, p_type, p_brand)), 'brand#1')")
def search_any_word_catalog(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.where(t.any_word(F.concat_ws(" ", "p_name", "p_type", "p_brand"), "green Brand#1")).select("p_partkey", "p_name", "p_brand")


WINDOW5 = f"""
with {LINES},
  n as (select doc_id, lineno, list(line) over (partition by doc_id order by lineno rows between 2 preceding and 2 following) as near from lines),
  hit as (select doc_id, lineno, substring(array_to_string(list_filter(list_transform(near, lambda x: {STRIP.format('x')}), lambda x: x <> ''), ' '), 1, 300) as snippet
          from n where contains(lower(array_to_string(near, ' ')), 'the') and contains(lower(array_to_string(near, ' ')), 'and')),
  kept as (select doc_id, unnest(list_reduce(list_sort(list(lineno)), lambda k, x: case when x - k[-1] >= 5 then list_append(k, x) else k end, [min(lineno)])) as lineno from hit group by doc_id)
select doc_id, lineno, snippet from hit join kept using (doc_id, lineno)
"""


@query(WINDOW5)
def search_window5_dedup(spark, sf_dir):
    return search.document_search(texts(spark, sf_dir), "doc_id", "the and")


@query(f"""
with {LINES}, q(query_id, ws) as (values (1, ['license', 'version']), (2, ['redistribution', 'license,']), (3, ['the', 'license'])),
  n as (select doc_id, lineno, line, lower(line) as low, lower(array_to_string(list(line) over (partition by doc_id order by lineno rows between 1 preceding and 1 following), ' ')) as near from lines),
  one as (select query_id, doc_id, lineno, substring(line, 1, 150) as snippet from q, n where len(list_filter(ws, lambda w: not contains(low, w))) = 0),
  wide as (select query_id, doc_id, lineno, substring(line, 1, 150) as snippet from q, n where len(ws) > 1 and len(list_filter(ws, lambda w: not contains(near, w))) = 0)
select * from one union all select * from wide where query_id not in (select query_id from one)
""")
def search_window3_fallback(spark, sf_dir):
    asked = [(1, ["license", "version"]), (2, ["redistribution", "license,"]), (3, ["the", "license"])]
    return search.document_search_or_wider(texts(spark, sf_dir), asked, "doc_id")


@query(f"""
with {LINES}
select 'documents' as origin, doc_id as id, lineno, substring(line, 1, 150) as snippet from lines where contains(lower(line), 'license')
union all
select 'pages', page_id, i, substring(l, 1, 150) from (
  select page_id, generate_subscripts(ls, 1)::bigint as i, unnest(ls) as l from (select page_id, string_split(case when ends_with(h, chr(10)) then left(h, length(h) - 1) else h end, chr(10)) as ls
  from (select page_id, regexp_replace(html, '\\r\\n?', chr(10), 'g') as h from pages) where h <> '')) where contains(lower(l), '<h1')
""")
def search_tagged_union(spark, sf_dir):
    docs = search.line_search(doc_rows(spark, sf_dir), "license").withColumnRenamed("doc_id", "id")
    pages = search.line_search(corpus.lines(read(spark, sf_dir, "pages"), "page_id", "html"), "<h1").withColumnRenamed("page_id", "id")
    return search.tagged_union(documents=docs, pages=pages)


@query(f"""
with {LINES}, hit as (select d.source, l.doc_id, l.lineno from lines l join documents d using (doc_id) where contains(lower(line), 'the') and contains(lower(line), 'and')),
  r as (select *, row_number() over (partition by source order by doc_id, lineno) as i, greatest(count(*) over (partition by source) - 20, 0)::bigint as n_more from hit)
select source, doc_id, lineno, n_more from r where i <= 20
""")
def search_topn_overflow(spark, sf_dir):
    docs = texts(spark, sf_dir).where(t.all_words(F.col("text"), "the and"))
    hits = search.line_search(corpus.lines(docs.select(F.struct("doc_id", "source").alias("k"), "text"), "k"), "the and")
    return search.first_n(hits.select("k.source", "k.doc_id", "lineno"), "source", ["doc_id", "lineno"], 20)


@query("""
with q(query_id, q) as (values (1, 'blue anvil'), (2, 'cold'), (3, 'Brand#2'), (4, 'nothing of this'), (5, 'SMALL')),
  c as (select query_id, p_partkey, case when p_name = q then 0 when starts_with(p_name, q) then 1 when contains(lower(p_type), lower(q)) then 2 when contains(lower(p_brand), lower(q)) then 3 end as tier from q, part)
select query_id, p_partkey, tier from (select *, min(tier) over (partition by query_id) as m from c where tier is not null) where tier = m
""")
def lookup_tiered(spark, sf_dir):
    asked = spark.createDataFrame([(1, "blue anvil"), (2, "cold"), (3, "Brand#2"), (4, "nothing of this"), (5, "SMALL")], "query_id int, q string")
    name, q = F.col("p_name"), F.col("q")
    tiers = [name == q, F.startswith(name, q), t.contains_ci(F.col("p_type"), q), t.contains_ci(F.col("p_brand"), q)]
    any_ = tiers[0] | tiers[1] | tiers[2] | tiers[3]
    rows = read(spark, sf_dir, "part").join(F.broadcast(asked), any_)
    return lookup.first_tier(rows, "query_id", tiers).select("query_id", "p_partkey", "tier")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["O", "F", "P"]
LABELS = {"O": "Open", "F": "Filled"}


def matrix(spark, sf_dir):
    """One row for each priority, with a map of its statuses to their numbers of orders."""
    n = read(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return n.groupBy("o_orderpriority").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("per"))


@query("""
with c(ord, code) as (values (0, 'O'), (1, 'F'), (2, 'P'), (3, 'X')), p as (select distinct o_orderpriority from orders)
select p.o_orderpriority, c.ord, coalesce({'O': 'Open', 'F': 'Filled'}[c.code], c.code) as label, (select nullif(count(*), 0) from orders o where o.o_orderpriority = p.o_orderpriority and o.o_orderstatus = c.code)::bigint as n
from p, c
""".replace("{'O': 'Open', 'F': 'Filled'}[c.code]", "case c.code when 'O' then 'Open' when 'F' then 'Filled' end"))
def lookup_map_matrix(spark, sf_dir):
    codes = F.array(*map(F.lit, [*STATUSES, "X"]))
    rows = matrix(spark, sf_dir).select("o_orderpriority", "per", F.posexplode(codes).alias("ord", "code"))
    return rows.select("o_orderpriority", "ord", t.label_of(F.col("code"), LABELS).alias("label"), F.try_element_at("per", F.col("code")).alias("n"))


@query("""
with c(ord, code) as (values (0, 'O'), (1, 'F'), (2, 'P'), (3, 'X'))
select p.o_orderpriority, string_agg(c.code, ',' order by c.ord) as open_codes
from (select distinct o_orderpriority, o_orderstatus from orders) p join c on c.code = p.o_orderstatus group by 1
""")
def lookup_alternatives(spark, sf_dir):
    return matrix(spark, sf_dir).select("o_orderpriority", F.array_join(lookup.alternatives([*STATUSES, "X"], F.col("per")), ",").alias("open_codes"))


@query("""
with i(word, ord, note) as (values ('green', 0, 'first'), ('green', 1, 'second'), ('blue', 2, 'third'), ('red', 3, 'fourth')),
  f as (select word, min_by(note, ord) as note from i group by word),
  p as (select p_partkey, trim(unnest(string_split(lower(p_name), ' '))) as word from part)
select p_partkey, word, note from p join f using (word)
""")
def lookup_csv_explode_join(spark, sf_dir):
    index = spark.createDataFrame([("green", 0, "first"), ("green", 1, "second"), ("blue", 2, "third"), ("red", 3, "fourth")], "word string, ord int, note string")
    index = F.broadcast(lookup.first_match(index, "word", "ord").select("word", "note"))
    return lookup.csv_join(read(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("_n")), "_n", " ", index, "word").select("p_partkey", "word", "note")


@query("select n_name, s.s_name from nation left join (select s_nationkey, min_by(s_name, s_suppkey) as s_name from supplier group by 1) s on s_nationkey = n_nationkey")
def lookup_left_first(spark, sf_dir):
    first = lookup.first_match(read(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey").select("s_nationkey", "s_name")
    nation = read(spark, sf_dir, "nation")
    return nation.join(first, nation.n_nationkey == first.s_nationkey, "left").select("n_name", "s_name")


ALIASES = {"sign": ["account", "growth"], "click": ["traffic"], "view": ["traffic"], "purchase": ["sales", "account"]}


@query("""
with a(alias, facet) as (values ('sign', 'account'), ('sign', 'growth'), ('click', 'traffic'), ('view', 'traffic'), ('purchase', 'sales'), ('purchase', 'account')),
  e as (select event_type, facet from (select distinct event_type from events) e left join a on contains(event_type, alias))
select coalesce(facet, 'general') as facet, count(*) as n from events join (select distinct * from e) using (event_type) group by 1
""")
def route_alias(spark, sf_dir):
    facet = F.explode(lookup.routed(F.lower("event_type"), ALIASES, "general"))
    return read(spark, sf_dir, "events").select(facet.alias("facet")).groupBy("facet").agg(F.count("*").alias("n"))


@query("select p_partkey, case upper(trim(lower(p_brand))) when 'BRAND#11' then 'B-11' when 'BRAND#23' then 'B-23' else lower(p_brand) end as code from part")
def code_normalize(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", t.canonical_code(F.lower("p_brand"), {"BRAND#11": "B-11", "BRAND#23": "B-23"}).alias("code"))


@query("select o_orderkey, greatest(1, least(14, o_orderkey // 100))::bigint as article, 'S-' || o_orderkey as section from orders")
def bucket_section_id(spark, sf_dir):
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", t.article_of(key).alias("article"), t.section_id(F.concat(F.lit(" s-"), key), "S-").alias("section"))


@query("select conv_id, turn, min(case when role = 'user' then turn end) over (partition by conv_id order by turn rows between 1 following and unbounded following) as next_start from conversations")
def slice_flat(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return corpus.slice_ends(rows, ["conv_id"], "turn", F.col("role") == "user").select("conv_id", "turn", "next_start")


@query(f"""
with {LINES}, h as (select doc_id, lineno, case when length(line) % 3 = 0 then 2 + length(line) % 5 end as level from lines),
  j as (select a.doc_id, a.lineno, a.level, min(b.lineno) as next_start from h a left join h b on b.doc_id = a.doc_id and b.lineno > a.lineno and b.level <= a.level where a.level is not null group by 1, 2, 3)
select doc_id, lineno, level::int as level, next_start from j
""")
def slice_level_aware(spark, sf_dir):
    size = F.length("line")
    rows = doc_rows(spark, sf_dir).select("doc_id", "lineno", F.when(size % 3 == 0, 2 + size % 5).cast("int").alias("level"))
    return corpus.level_slice_ends(rows, ["doc_id"], "lineno", F.col("level"), range(2, 7)).where("level is not null")


@query("""
select p_partkey, coalesce(case when p_size % 7 = 0 then 'see note' end, p_size || 'ft') as size_text,
  (p_size || 'ft') || case when p_size % 4 <> 0 then ' (max ' || (p_size % 4) || 'ft)' else '' end as range_text from part
""")
def dims_conditional_projection(spark, sf_dir):
    size = F.col("p_size")
    note = F.when(size % 7 == 0, "see note").otherwise(F.lit(""))
    return read(spark, sf_dir, "part").select("p_partkey", t.feet(size, note).alias("size_text"), t.with_suffix(F.concat(size.cast("string"), F.lit("ft")), size % 4, " (max %dft)").alias("range_text"))


@query("select l_orderkey, l_linenumber, abs(l_extendedprice - l_quantity * p_retailprice) > 0.1 as differs from lineitem join part on p_partkey = l_partkey")
def flags_discrepancy(spark, sf_dir):
    part, item = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), read(spark, sf_dir, "lineitem")
    both = item.join(part, item.l_partkey == part.p_partkey)
    return both.select("l_orderkey", "l_linenumber", t.differs(F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"), 0.1).alias("differs"))


@query("select c_custkey, coalesce('$' || format('{:,.0f}', c_acctbal), 'N/A') as balance from customer")
def currency_format(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", t.currency(F.col("c_acctbal")).alias("balance"))


@query("""
select c_custkey, case when r_name = 'EUROPE' then 'inside' when n_nationkey % 3 = 0 then 'extended' when c_custkey % 5 = 0 and c_custkey % 7 = 0 then 'unknown' else 'outside' end as place
from customer left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey
""")
def jurisdiction_case(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    where = nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select("n_nationkey", "r_name")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = customer.join(where, customer.c_nationkey == where.n_nationkey, "left")
    key = F.col("c_custkey")
    return rows.select("c_custkey", lookup.jurisdiction(F.col("r_name") == "EUROPE", F.col("n_nationkey") % 3 == 0, key % 5 == 0, key % 7 == 0).alias("place"))


@query(r"""
with a as (select p_partkey, case p_partkey % 4 when 0 then p_name when 1 then p_size || ' ' || p_name when 2 then p_size || '  12 ' || p_name || ' ' else p_size::varchar end as x from part),
  s as (select p_partkey, regexp_replace(trim(x), '\s+', ' ', 'g') as x from a)
select p_partkey, case when contains(x, ' ') then upper(regexp_replace(x, '^(\d+( |$))*', '')) end as street from s
""")
def street_extract(spark, sf_dir):
    k, size, name = F.col("p_partkey") % 4, F.col("p_size").cast("string"), F.col("p_name")
    address = F.when(k == 0, name).when(k == 1, F.concat_ws(" ", size, name)).when(k == 2, F.concat(size, F.lit("  12 "), name, F.lit(" "))).otherwise(size)
    return read(spark, sf_dir, "part").select("p_partkey", t.street(address).alias("street"))


def points(spark, sf_dir):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", at(0).alias("x"), at(1).alias("y"))


@query("""
with p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings)
select vec_id, round((x + (x + 2) + (x + 2) + x + x) / 5, 6) as x, round((y + y + (y + 1) + (y + 1) + y) / 5, 6) as y from p
""")
def spatial_centroid(spark, sf_dir):
    x, y, one = F.col("x"), F.col("y"), F.lit(1.0)
    ring = F.array(F.array(x, y), F.array(x + 2 * one, y), F.array(x + 2 * one, y + one), F.array(x, y + one), F.array(x, y))
    rows = points(spark, sf_dir).select("vec_id", F.explode(F.array(spatial.ring_centroid(F.array(ring)))).alias("c"))
    return rows.select("vec_id", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@query("""
select vec_id, case when x >= -0.1 and x < 0.1 and y >= -0.1 and y < 0.1 and not (x >= -0.05 and x < 0.05 and y >= -0.05 and y < 0.05) then 'ring' when x >= 0.1 and x < 0.4 and y >= 0 and y < 0.3 then 'east' end as zone
from (select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings)
""")
def spatial_pip(spark, sf_dir):
    box = lambda a, b, c, d: F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((a, c), (b, c), (b, d), (a, d), (a, c))))
    zones = {"ring": F.array(box(-0.1, 0.1, -0.1, 0.1), box(-0.05, 0.05, -0.05, 0.05)), "east": F.array(box(0.1, 0.4, 0, 0.3))}
    zone = F.lit(None).cast("string")
    for name in reversed(zones):
        zone = F.when(spatial.in_rings(zones[name], F.col("x"), F.col("y")), name).otherwise(zone)
    return points(spark, sf_dir).select("vec_id", zone.alias("zone"))


@query("""
with p as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y from embeddings)
select a.label, a.vec_id, b.vec_id as other_vec_id from p a join p b on a.label = b.label and a.vec_id <> b.vec_id and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.05
""")
def spatial_radius_join(spark, sf_dir):
    return spatial.radius_join(points(spark, sf_dir), "vec_id", "label", 0.05).drop("distance")


@query(f"""
with {LINES}, k as (select doc_id, lineno, regexp_replace(line, '\\s+$', '') as line from lines where not regexp_matches(line, '^Licensed under')),
  b as (select *, lag(line) over (partition by doc_id order by lineno) as before from k)
select doc_id, lineno, line from b where line <> '' or coalesce(before, '') <> ''
""")
def etl_clean_collapse(spark, sf_dir):
    return etl.clean_lines(doc_rows(spark, sf_dir), "doc_id", "^Licensed under")


@query(f"""
with {LINES}
select doc_id, lineno, (coalesce(sum(case when regexp_matches(line, '^The ') then 3 else 1 end) over (partition by doc_id order by lineno rows between unbounded preceding and 1 preceding), 0) + 8)::bigint as line_start from lines
""")
def etl_renumber(spark, sf_dir):
    return etl.renumber(doc_rows(spark, sf_dir), "doc_id", "^The ").select("doc_id", "lineno", "line_start")


@query(rf"""
with {LINES}, h as (select doc_id, lineno, regexp_extract(line, '^([A-Z]\w+) (.*)$', 1) as section, regexp_extract(line, '^([A-Z]\w+) (.*)$', 2) as t from lines where regexp_matches(line, '^([A-Z]\w+) (.*)$')),
  c as (select doc_id, lineno, section, regexp_replace(regexp_replace(t, '\s*\.{{3,}}.*$', ''), '\s+Page\s+\d+$', '') as t from h),
  e as (select doc_id, lineno, section, {STRIP.format("regexp_replace(t, '[.]+$', '')")} as title from c)
select doc_id, lineno, section, title from e where not ends_with(title, ',')
""")
def etl_heading_index(spark, sf_dir):
    return etl.heading_index(doc_rows(spark, sf_dir), "doc_id", r"^([A-Z]\w+) (.*)$")


@query(r"""
with h as (select page_id, regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1), '\.+$', '') as t from pages)
select page_id, regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '') as title, regexp_replace(regexp_replace(t, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from h where t <> ''
""")
def page_titles(spark, sf_dir):
    title = t.clean_title(F.regexp_extract("html", "<h1[^>]*>(.*?)</h1>", 1))
    return read(spark, sf_dir, "pages").select("page_id", title.alias("title")).where("title <> ''").withColumn("slug", t.slug(F.col("title")))


@query("select source, count(*) as n_docs, count(distinct lang) as n_langs from documents group by source")
def etl_file_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.countDistinct("lang").alias("n_langs"))


@query(f"""
with {LINES}, m as (select doc_id, lineno, sum(case when regexp_matches(line, '^[A-Z]') then 1 else 0 end) over (partition by doc_id order by lineno rows between unbounded preceding and current row)::bigint as section from lines)
select doc_id, section, min(lineno) as first_line, max(lineno) as last_line from m group by 1, 2
""")
def etl_sections(spark, sf_dir):
    rows = etl.sections(doc_rows(spark, sf_dir), "doc_id", "^[A-Z]")
    return rows.groupBy("doc_id", "section").agg(F.min("lineno").alias("first_line"), F.max("lineno").alias("last_line"))


@query(WINDOW5)
def search_window5_lines(spark, sf_dir):
    return search.greedy_dedup(search.window_search(doc_rows(spark, sf_dir), "doc_id", "the and"), ["doc_id"])


ASKED = {0: "IV", 1: "section: iv", 2: "civil", 3: " Section-X", 4: "XI", 5: "vi"}


@query("""
with q as (select event_id, case event_id % 6 when 0 then 'IV' when 1 then 'section: iv' when 2 then 'civil' when 3 then ' Section-X' when 4 then 'XI' else 'vi' end as q from events),
  r as (select event_id, q, upper(regexp_extract(trim(q), '^(?i:section[:\\s-]+)?([ivxIVX]+)$', 1)) as r from q)
select event_id, q, case when r in ('I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X') then r end as roman from r
""")
def route_roman(spark, sf_dir):
    asked = F.create_map(*[F.lit(x) for pair in ASKED.items() for x in pair])
    rows = read(spark, sf_dir, "events").select("event_id", F.element_at(asked, (F.col("event_id") % 6).cast("int")).alias("q"))
    return rows.select("event_id", "q", t.roman_route(F.col("q")).alias("roman"))


@query("select p_partkey, case when p_size % 10 = 0 then 3 else 3 + 1 end::int as level, p_size // 10 || '.' || p_size % 10 as number from part")
def heading_levels(spark, sf_dir):
    number = F.concat(F.floor(F.col("p_size") / 10).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", t.heading_level(number).cast("int").alias("level"), number.alias("number"))
