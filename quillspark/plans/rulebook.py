"""The questions that users ask of a rule corpus, each a method that gives a DataFrame.

A RuleBook holds tables; which are needed depends on the questions asked:

uses            ord, use, category, naics, special_requirements (a list with commas), discrepancy_note, districts (map code -> permission)
principal       ord, district, use_type, density, min_lot_size, and numbers in feet with optional notes
accessory       ord, district, setbacks and notes
districts       ord, code, name, section, intent, character, key_rules
special, general    ord, section, title, summary, file, line_start: indices into a corpus
rules           kind, text: what holds for all districts that have standards (optional)
subdivision     facet (types, improvements, plats, procedures), ord, key, name, section, summary
ordinance, statutes, town, personnel    file, lineno, line: corpora
town_index, personnel_index    ord, id, number, section, title, chapter, file, line_start
parcels         pin, parcel_id, owner, owner2, address, deed_acres, calc_acres, parent_pin, total_value, rings
zones, extended, corporate    ord, name, rings: polygon layers; a layer that is missing counts as one that failed
"""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as t
from quillspark.operators import corpus, lookup, search, spatial

#: Labels of permissions, words that route a question about subdivision to its facets, and words that show whole facets.
PERMISSIONS = {"X": "Permitted by Right", "C": "Conditional Zoning", "S": "Special Use"}
ROUTES = {
    "lot split": ["types"],
    "parcel division": ["types"],
    "two-lot": ["types"],
    "2-lot": ["types"],
    "plat": ["plats", "procedures"],
    "plat approval": ["plats", "procedures"],
    "process": ["types"],
    "approval": ["types", "procedures"],
    "improvements": ["improvements"],
    "infrastructure": ["improvements"],
    "guarantee": ["improvements"],
    "performance": ["improvements"],
}
PLAT_WORDS = ["plat", "sketch", "preliminary", "engineering", "drawing", "final plat"]
PROCEDURE_WORDS = ["procedure", "permit", "zoning permit", "open space subdivision"]
WHOLE = ["all", "overview", "improvements", "infrastructure"]
MOST = {"uses": 15, "text": 20, "titles": 20, "statutes": 30, "parcels": 25, "provisions": 50}
BODIES = 8


@dataclass
class RuleBook:
    codes: list[str]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    permissions: dict[str, str] = field(default_factory=lambda: dict(PERMISSIONS))
    aliases: dict[str, str] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(f"this rule book has no table {name}") from None

    def code(self, raw: str) -> str:
        """A known district code; others are refused."""
        found = self.aliases.get(raw.strip().upper(), raw.strip().upper())
        if found not in self.codes:
            raise ValueError(f"unknown district {raw}; known: {', '.join(self.codes)}")
        return found

    # uses and districts

    def _uses(self, use: str) -> DataFrame:
        t.words(use)
        asked = self.uses.withColumn("_q", F.lit(0))
        return lookup.first_tier(asked, "_q", [t.contains_ci(F.col("use"), use), t.contains_ci(F.col("category"), use)]).drop("_q")

    def permitted_use(self, use: str, district: str | None = None) -> DataFrame:
        """use, category, district, permission for one district or all, in the order of codes; null: not permitted."""
        codes = [self.code(district)] if district else self.codes
        rows = self._uses(use).select("ord", "use", "category", "discrepancy_note", "districts", F.posexplode(F.array(*map(F.lit, codes))).alias("place", "district"))
        return rows.select("ord", "use", "category", "discrepancy_note", "place", "district", t.label_of(F.try_element_at("districts", F.col("district")), self.permissions).alias("permission"))

    def can_build(self, use: str, district: str) -> DataFrame:
        """For each matching use: its permission, or where else it is permitted, with special requirements and standards."""
        code = self.code(district)
        given = F.try_element_at("districts", F.lit(code))
        rows = self._uses(use).select(
            "ord", "use", "discrepancy_note", "special_requirements", F.lit(code).alias("district"), t.label_of(given, self.permissions).alias("permission"),
            F.when(given.isNull(), lookup.alternatives(self.codes, F.col("districts"))).alias("elsewhere"),
        )
        index = lookup.first_match(self.special.select("section", "ord", "title"), "section", "ord").select("section", "title")
        wanted = lookup.csv_join(rows.where("permission is not null").select("ord", "special_requirements"), "special_requirements", ",", index, "section")
        wanted = wanted.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("section", "title"))).alias("requirements"))
        standards = self.principal.where(F.col("district") == code).groupBy("district").agg(F.sort_array(F.collect_list(F.struct("ord", "use_type", "density", "min_lot_size"))).alias("standards"))
        return rows.join(wanted, "ord", "left").join(standards, "district", "left")

    def dimensional_standards(self, district: str) -> DataFrame:
        code = self.code(district)
        parts = {"principal": self.principal, "accessory": self.accessory}
        out = [p.where(F.col("district") == code).withColumn("kind", F.lit(k)) for k, p in parts.items()]
        found = out[0].unionByName(out[1], allowMissingColumns=True)
        if "rules" not in self.tables:
            return found
        # rules and notes are given with standards only
        rules = self.rules.withColumn("district", F.lit(code)).join(found.select("district").distinct(), "district", "left_semi")
        return found.unionByName(rules, allowMissingColumns=True)

    def district_info(self, code: str) -> DataFrame:
        """One district, or all of them."""
        return self.districts if code.strip().lower() == "all" else self.districts.where(F.col("code") == self.code(code))

    def use_or_alternatives(self, use: str) -> DataFrame:
        """The uses that match, or all of them as not found."""
        return lookup.or_alternatives(self._uses(use).drop("tier").select("ord", "use"), self.uses.select("ord", "use"))

    def list_districts(self) -> DataFrame:
        return self.districts.select("ord", "code", "name", "character").orderBy("ord")

    # sections

    def _slices(self, hits: DataFrame, lines: DataFrame, boundary: Column) -> DataFrame:
        """hits with body: the lines from line_start to the next boundary."""
        return corpus.bodies(hits, corpus.slice_ends(lines, ["file"], "lineno", boundary))

    def _section(self, index: DataFrame, query: str, ci: bool = False, prefix: str = "", more: tuple[str, ...] = ("title", "summary"), key: str = "section") -> DataFrame:
        """Index rows of the first tier that has any: exact id, id with prefix, then a keyword in each further column."""
        t.words(query)
        own = F.lower(key) if ci else F.col(key)
        q = query.strip().lower() if ci else query.strip()
        tiers = [own == q, F.startswith(own, F.lit(q + prefix)), *(t.contains_ci(F.col(c), q) for c in more)]
        return lookup.first_tier(index.withColumn("_q", F.lit(0)), "_q", tiers).drop("_q", "tier")

    def special_requirements(self, query: str) -> DataFrame:
        return self._slices(self._section(self.special, query), self.ordinance, F.startswith("line", F.lit("## Section 8.")))

    def general_provisions(self, query: str) -> DataFrame:
        """all gives every entry; a lettered section ends at the next letter too."""
        hits = self.general if query.strip().lower() == "all" else self._section(self.general, query)
        heading = F.startswith("line", F.lit("## Section"))
        lettered = F.startswith("section", F.lit("2.2")) & (F.length("section") > 3)
        parts = [(hits.where(~lettered), heading), (hits.where(lettered), heading | F.regexp_like("line", F.lit(r"^[A-Z]\.")))]
        return self._slices(parts[0][0], self.ordinance, parts[0][1]).unionByName(self._slices(parts[1][0], self.ordinance, parts[1][1]))

    def statute_section(self, section: str, chapter: str = "160D") -> DataFrame:
        """The section of exactly this id, under a heading of level 2 or 3."""
        number = section.strip().upper().removeprefix(f"{chapter.upper()}-").lower()
        heads = self.statutes.where(F.regexp_like("line", F.lit(rf"^#{{2,3}}\s+\S"))).withColumn("section", F.regexp_extract("line", rf"^#{{2,3}}\s+(?i:{chapter})-(\d+[A-Za-z]?(?:\.\d+)?)\b", 1))
        hits = heads.where(F.lower("section") == number).select("file", F.col("lineno").alias("line_start"), "section", F.col("line").alias("title"))
        level = F.when(F.regexp_like("line", F.lit(r"^#{2,3} ")), F.length(F.regexp_extract("line", "^(#+)", 1)))
        return corpus.bodies(hits, corpus.level_slice_ends(self.statutes, ["file"], "lineno", level, range(2, 4)))

    def ordinance_section(self, query: str) -> DataFrame:
        """chapter:N lists a chapter; otherwise the section's text."""
        route, _, n = query.partition(":")
        if route.strip().lower() == "chapter" and n:
            bare = lambda c: F.regexp_replace(c, "^0+", "")
            return self.town_index.where(bare(F.col("chapter")) == n.strip().lstrip("0")).orderBy("ord")
        return self._slices(self._section(self.town_index, query, prefix="-", more=("title",)), self.town, F.regexp_like("line", F.lit(r"^#{2,4}\s+Sec\.")))

    def personnel_policy(self, query: str) -> DataFrame:
        """A roman numeral lists its section, more than BODIES hits are listed, fewer come with their text."""
        t.words(query)
        roman = re.fullmatch(r"(?:section[:\s-]+)?([ivx]+)", query.strip().lower())
        roman = roman[1].upper() if roman and roman[1].upper() in t.ROMANS else None
        hits = self.personnel_index.withColumn("_all", F.lit(0))
        if roman:
            hits = hits.where(F.upper("section") == roman).withColumn("tier", F.lit(0))
        else:
            q = query.strip().lower()
            hits = lookup.first_tier(hits, "_all", [F.lower("id") == q, F.lower("number") == q, t.contains_ci(F.col("title"), q)])
        hits = search.first_n(hits.drop("tier"), "_all", ["ord"], MOST["provisions"])
        n = F.count("*").over(Window.partitionBy("_all"))  # at most as many as are listed
        hits = hits.withColumn("_listed", (n > BODIES) | F.lit(bool(roman))).drop("_all")
        level = F.when(F.regexp_like("line", F.lit("^#{2,6} ")), F.length(F.regexp_extract("line", "^(#{2,6}) ", 1)))
        ends = corpus.level_slice_ends(self.personnel, ["file"], "lineno", level, range(2, 7), F.coalesce(level, F.lit(6)))
        with_text = corpus.bodies(hits.where("not _listed"), ends)
        return hits.where("_listed").withColumn("body", F.lit(None).cast("string")).unionByName(with_text).drop("_listed")

    def subdivision_requirements(self, query: str) -> DataFrame:
        """Entries of the facets that the query speaks of.

        Aliases and fixed words in the query route to facets; so do a type's key or name in the query, and any word of the
        query in an improvement. Without a route the types are given. Improvements are those that hold a word, unless the
        query asks for them as a whole.
        """
        t.words(query)
        q = query.strip().lower()
        rows = self.subdivision.withColumn("_q", F.lit(0))
        if q in ("all", "overview"):
            return rows.drop("_q")
        facet, text = F.col("facet"), F.lit(q)
        told = [f for f, words in (("plats", PLAT_WORDS), ("procedures", PROCEDURE_WORDS)) if any(w in q for w in words)]
        routed = F.concat(lookup.routed(text, ROUTES, None), F.array(*map(F.lit, told)).cast("array<string>"))
        named = (facet == "types") & (F.contains(text, F.col("key")) | F.coalesce(F.contains(text, F.lower("name")), F.lit(False)))
        about = (facet == "improvements") & t.any_word(F.concat_ws(" ", "key", "summary"), query)
        over = Window.partitionBy("_q")  # an index of a few entries
        any_ = lambda c: F.coalesce(F.max(c).over(over), F.lit(False))
        rows = rows.withColumn("_about", about).withColumn("_types", any_(named)).withColumn("_improvements", any_(about)).withColumn("_routed", routed)
        shown = F.array_contains("_routed", facet) | ((facet == "types") & F.col("_types")) | ((facet == "improvements") & F.col("_improvements"))
        none = (F.size("_routed") == 0) & ~F.col("_types") & ~F.col("_improvements")
        kept = F.when(facet == "improvements", F.col("_about") | F.lit(q in WHOLE)).otherwise(True)
        return rows.where((shown & kept) | (none & (facet == "types"))).drop("_q", "_about", "_types", "_improvements", "_routed")

    # searches

    def _window_hits(self, lines: DataFrame, query: str) -> DataFrame:
        """file, lineno, snippet, n_more of text hits: all words within five lines, spread out, the first of them."""
        hits = search.greedy_dedup(search.window_search(lines, "file", query), ["file"])
        return search.first_n(hits.withColumn("_all", F.lit(0)), "_all", ["file", "lineno"], MOST["text"]).drop("_all")

    @staticmethod
    def _branch(name: str, rows: DataFrame, key: Column, title: Column, text: Column, n_more: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("branch"), key.cast("string").alias("key"), title.alias("title"), text.alias("snippet"), n_more.cast("long").alias("n_more"))

    def _titles(self, name: str, rows: DataFrame, key: str, most: int) -> DataFrame:
        rows = search.first_n(rows.withColumn("_all", F.lit(0)), "_all", ["ord"], most)
        return self._branch(name, rows, F.col(key), F.col("title"), F.lit(None).cast("string"), F.col("n_more"))

    def _text_branch(self, lines: DataFrame, query: str) -> DataFrame:
        return self._branch("text", self._window_hits(lines, query), F.concat_ws(":", "file", "lineno"), F.lit(None).cast("string"), F.col("snippet"), F.col("n_more"))

    def search_ordinance(self, query: str) -> DataFrame:
        """branch, key, title, snippet, n_more: any word in the tables, all words in the text."""
        none = F.lit(0)
        any_ = lambda *cs: t.any_word(F.concat_ws(" ", *cs), query)
        uses = search.first_n(self.uses.where(any_("use", "category", "special_requirements")).withColumn("_all", F.lit(0)), "_all", ["ord"], MOST["uses"])
        parts = [self._branch("uses", uses, F.col("ord"), F.col("use"), F.col("category"), F.col("n_more"))]
        found = self.districts.where(any_("code", "name", "intent", "character", F.array_join("key_rules", " ")))
        parts.append(self._branch("districts", found, F.col("code"), F.col("name"), t.snippet(F.col("intent"), 150), none))
        for name in ("special", "general"):
            rows = self.tables[name].where(any_("section", "title", "summary"))
            parts.append(self._branch(name, rows, F.col("section"), F.col("title"), F.concat(t.snippet(F.col("summary"), 150), F.lit("...")), none))
        rows = self.subdivision.where(any_("key", "name", "summary"))
        parts.append(self._branch("subdivision", rows, F.col("section"), t.human(F.col("key")), F.concat(t.snippet(F.col("summary"), 120), F.lit("...")), none))
        parts.append(self._text_branch(self.ordinance, query))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def search_town_code(self, query: str) -> DataFrame:
        titles = self.town_index.where(t.any_word(F.concat_ws(" ", "section", "title"), query))
        return self._titles("titles", titles, "section", MOST["titles"]).unionByName(self._text_branch(self.town, query))

    def search_personnel_policy(self, query: str) -> DataFrame:
        titles = self.personnel_index.where(t.any_word(F.concat_ws(" ", "id", "title"), query))
        return self._titles("titles", titles, "id", MOST["titles"]).unionByName(self._text_branch(self.personnel, query))

    def search_statutes(self, query: str) -> DataFrame:
        """Lines that hold all words; for several words without one, lines whose neighbourhood of three does."""
        single = search.line_search(self.statutes, query).withColumn("_all", F.lit(0))
        out = single
        if len(t.words(query)) > 1:
            near, _ = search.window_text("file", 1)
            wide = self.statutes.withColumn("_near", near).where(t.all_words(F.col("_near"), query))
            wide = wide.select("file", "lineno", t.snippet(F.col("line"), 150).alias("snippet"), F.lit(0).alias("_all"))
            out = search.with_fallback(single.select("file", "lineno", "snippet", "_all"), wide, "_all")
        return search.first_n(out.dropDuplicates(["file", "lineno"]), "_all", ["file", "lineno"], MOST["statutes"]).drop("_all")

    def search_all(self, query: str) -> DataFrame:
        return search.tagged_union(ordinance=self.search_ordinance(query), town_code=self.search_town_code(query))

    # parcels

    def _zone_at(self, points: DataFrame, layer: str, name: str) -> DataFrame:
        """pin and the first polygon of a layer that holds its point."""
        if layer not in self.tables:
            return points.select("pin", F.lit(None).cast("string").alias(name))
        hit = points.join(self.tables[layer].select("ord", F.col("name").alias(name), "rings"), spatial.in_rings(F.col("rings"), F.col("x"), F.col("y")))
        return lookup.first_match(hit.select("pin", "ord", name), "pin", "ord").select("pin", name)

    def _found(self, pin: str | None, address: str | None, owner: str | None) -> DataFrame:
        if sum(x is not None for x in (pin, address, owner)) != 1:
            raise ValueError("give one of pin, address and owner")
        if pin is not None:
            rows = self.parcels.withColumn("_q", F.lit(0))
            return lookup.first_tier(rows, "_q", [F.col("pin") == pin.strip(), F.col("parcel_id") == pin.strip()]).drop("_q", "tier")
        part = F.upper(F.lit((address if address is not None else owner).strip()))
        t.words(address if address is not None else owner)
        if address is not None:
            return self.parcels.where(F.contains(F.upper("address"), part))
        return self.parcels.where(F.contains(F.upper("owner"), part) | F.coalesce(F.contains(F.upper("owner2"), part), F.lit(False)))

    def parcel_info(self, pin: str | None = None, address: str | None = None, owner: str | None = None) -> DataFrame:
        """Parcels (the first of many, with the rest counted) with zone, jurisdiction, flags and the zone's first standard.

        failed_layers lists the layers that could not be asked; the jurisdiction is unknown if both of its layers are among them.
        """
        rows = search.first_n(self._found(pin, address, owner).withColumn("_all", F.lit(0)), "_all", ["pin"], MOST["parcels"]).drop("_all")
        points = rows.select("pin", spatial.ring_centroid(F.col("rings")).alias("c")).where("c is not null").select("pin", "c.x", "c.y")
        for layer, name in (("zones", "zone"), ("extended", "extended_area"), ("corporate", "town")):
            rows = rows.join(self._zone_at(points, layer, name), "pin", "left")
        first = lookup.first_match(self.principal.select("district", "ord", "use_type", "min_street_frontage_ft"), "district", "ord").drop("ord").withColumnRenamed("district", "zone_code")
        rows = rows.withColumn("zone_code", t.canonical_code(F.col("zone"), self.aliases) if self.aliases else F.col("zone")).join(first, "zone_code", "left")
        no, failed = F.lit(False), [x for x in ("zones", "extended", "corporate") if x not in self.tables]
        place = lookup.jurisdiction(F.col("town").isNotNull(), F.col("extended_area").isNotNull(), F.lit("corporate" in failed), F.lit("extended" in failed))
        return rows.withColumns({
            "jurisdiction": F.when(F.size("rings") > 0, place), "total": t.currency(F.col("total_value")),
            "in_extended_area": (F.size("rings") > 0) & F.col("town").isNull() & F.col("extended_area").isNotNull(),
            "failed_layers": F.lit(",".join(failed)), "frontage_advice": F.when(F.col("min_street_frontage_ft") > 0, F.format_string("%d ft street frontage", "min_street_frontage_ft")),
            "acreage_differs": t.differs(F.col("deed_acres").cast("string"), F.col("calc_acres").cast("string"), 0.1),
            "was_split": F.coalesce(F.col("parent_pin") != "", no), "street": t.street(F.col("address")),
        })

    def infill_context(self, pin: str, radius: float = 300.0) -> DataFrame:
        """Parcels of the same zone whose rings come within the radius of the subject's centroid; same_street parts them, and
        n_in_part counts each part."""
        subject = self._found(pin, None, None).select(F.col("pin").alias("own_pin"), t.street(F.col("address")).alias("own_street"), spatial.ring_centroid(F.col("rings")).alias("c"))
        subject = subject.where("c is not null").limit(1).select("own_pin", "own_street", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
        near = spatial.rings_distance(F.col("rings"), F.col("x"), F.col("y")) <= radius
        # one subject, so the join is a filter with its values
        rows = self.parcels.join(F.broadcast(subject), near & (F.size("rings") > 0) & (F.col("pin") != F.col("own_pin")))
        points = rows.select("pin", spatial.ring_centroid(F.col("rings")).alias("c")).select("pin", "c.x", "c.y")
        own = self._zone_at(subject.select(F.col("own_pin").alias("pin"), "x", "y"), "zones", "zone").withColumnRenamed("pin", "own_pin")
        rows = rows.join(self._zone_at(points, "zones", "zone"), "pin").join(own, ["own_pin", "zone"])
        street = t.street(F.col("address"))
        rows = rows.select("own_pin", "pin", "address", "zone", F.coalesce(street == F.col("own_street"), F.lit(False)).alias("same_street"))
        return rows.withColumn("n_in_part", F.count("*").over(Window.partitionBy("own_pin", "same_street")))
