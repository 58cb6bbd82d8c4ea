"""Scalar expressions on text; all are Column in, Column out."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; trim() knows only the space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(query: str) -> list[str]:
    """The lower-case words of a query; a query without words is refused, as it would match every row."""
    found = query.lower().split()
    if not found:
        raise ValueError("an empty query")
    return found


def all_words(text: Column, query: str) -> Column:
    found = F.lit(True)
    for w in words(query):
        found = found & F.contains(F.lower(text), F.lit(w))
    return found


def any_word(text: Column, query: str) -> Column:
    found = F.lit(False)
    for w in words(query):
        found = found | F.contains(F.lower(text), F.lit(w))
    return found


def has_all(text: Column, listed: Column) -> Column:
    """all_words() for words that are a column."""
    low = F.lower(text)
    return F.forall(listed, lambda w: F.contains(low, w))


def contains_ci(text: Column, part: Column | str) -> Column:
    return F.contains(F.lower(text), F.lower(F.lit(part) if isinstance(part, str) else part))


def canonical_code(raw: Column, known: dict[str, str]) -> Column:
    """The spelling of a code in ``known``, without regard to case and blanks; other values as they are."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(strip(raw))), raw)


def label_of(code: Column, labels: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


def currency(value: Column) -> Column:
    """Whole dollars; what is no number stays as it is, and null is N/A."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(value.try_cast("double"), 0)), value.cast("string"), F.lit("N/A"))


def feet(value: Column, note: Column) -> Column:
    """A note in place of the number, where there is one."""
    return F.coalesce(F.when(note != "", note), F.concat(value.cast("string"), F.lit("ft")))


def with_suffix(base: Column, more: Column, text: str) -> Column:
    """base, followed by text with the number in it if the number is neither null nor 0."""
    return F.concat(base, F.when(more.isNotNull() & (more != 0), F.format_string(text, more)).otherwise(F.lit("")))


def street(address: Column) -> Column:
    """Upper-case words from the first that isn't a number on; null for fewer than two words, "" for numbers alone."""
    one = F.regexp_replace(strip(address), r"(?U)\s+", " ")
    return F.when(F.instr(one, " ") > 0, F.upper(F.regexp_replace(one, r"^(\d+( |$))*", "")))


def section_id(raw: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(strip(raw), f"^(?i){prefix}", ""))


def article_of(number: Column) -> Column:
    """Article 1 to 14 of a section number; null for what doesn't start with a number."""
    n = F.regexp_extract(number.cast("string"), r"^(\d+)", 1).try_cast("bigint")
    return F.when(n.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(14), F.floor(n / 100)))).cast("long")


ROMANS = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")


def roman_route(query: Column) -> Column:
    """The roman numeral that a query asks for, if it is one of I to X."""
    found = F.upper(F.regexp_extract(strip(query), r"(?i)^(?:section[:\s-]+)?([ivx]+)$", 1))
    return F.when(found.isin(*ROMANS), found)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")


def clean_title(title: Column) -> Column:
    """Without dotted leaders, page numbers and closing dots."""
    t = F.regexp_replace(title, r"\s*\.{3,}.*$", "")
    t = F.regexp_replace(t, r"\s+Page\s+\d+$", "")
    return strip(F.regexp_replace(t, r"\.+$", ""))


def heading_level(number: Column) -> Column:
    """3 for N.0, else 3 and the number of dots."""
    return F.when(F.regexp_like(number, F.lit(r"^\d{1,2}\.0$")), 3).otherwise(3 + F.size(F.split(number, r"\.")) - 1)


def unquoted(title: Column) -> Column:
    """Without straight or curly quotes at either end."""
    return F.btrim(title, F.lit('"\u201c\u201d'))


def provision_id(section: Column, number: Column) -> Column:
    """Section and number as one id; blanks of a number such as "Item A" become hyphens."""
    return F.concat_ws("-", section, F.replace(number, F.lit(" "), F.lit("-")))


def criteria_label(all_required: Column, any_triggers: Column) -> Column:
    """How a list of criteria is to be read; the first flag that holds decides."""
    return F.when(F.coalesce(all_required, F.lit(False)), "Criteria (ALL required):").when(F.coalesce(any_triggers, F.lit(False)), "Criteria (ANY triggers this type):").otherwise("Criteria:")


def chapter_order(number: Column) -> Column:
    """The place of a chapter by its number, 999 where there is none."""
    return F.coalesce(number.try_cast("int"), F.lit(999))


def human(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def snippet(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def numbered(items: Column) -> Column:
    return F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))


def differs(a: Column, b: Column, by: float) -> Column:
    """Whether two numbers differ by more than by; False if one can't be read."""
    return F.coalesce(F.abs(a.try_cast("double") - b.try_cast("double")) > by, F.lit(False))
