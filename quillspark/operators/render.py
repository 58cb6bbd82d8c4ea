"""Results as Markdown, at the edge: small results that a person reads."""

from pyspark.sql import DataFrame

#: Rows that rendering takes; more are counted, not shown.
MOST = 1000


def table(df: DataFrame, most: int = MOST) -> str:
    """A pipe table of the first rows, with a line for those beyond."""
    rows = df.limit(most + 1).collect()
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    out = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    out += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
    return "\n".join([*out, "", "... and more"] if len(rows) > most else out)


def blocks(parts: list[str]) -> str:
    return "\n\n---\n\n".join(p for p in parts if p)


def cards(df: DataFrame, title: str, fields: dict[str, str], most: int = MOST) -> str:
    """A block for each of the first rows: its title column as a heading, then labelled fields; empty ones are left out."""
    rows = df.limit(most + 1).collect()
    shown = lambda x: ", ".join(map(str, x)) if isinstance(x, list) else str(x)
    parts = ["\n".join([f"## {r[title]}", *(f"**{label}:** {shown(r[c])}" for c, label in fields.items() if r[c] not in (None, "", []))]) for r in rows[:most]]
    return blocks([*parts, "... and more" if len(rows) > most else ""])


def listing(df: DataFrame, line: str, most: int = MOST) -> str:
    """A bullet for each of the first rows, from a format of its columns; n_more, where there is one, counts the rest."""
    rows = df.limit(most + 1).collect()
    out = ["- " + line.format(**r.asDict()) for r in rows[:most]]
    more = max((r["n_more"] or 0 for r in rows), default=0) if "n_more" in df.columns else len(rows) - most
    return "\n".join([*out, f"... and {more} more"] if more > 0 else out)


def outcome(df: DataFrame, what: str, name: str, most: int = 50) -> str:
    """The names found, or what was not found with the names there are; df: from lookup.or_alternatives()."""
    rows = df.limit(most).collect()
    names = ", ".join(str(r[name]) for r in rows)
    return names if any(r["found"] for r in rows) else f"No {what} found. Available: {names}"
