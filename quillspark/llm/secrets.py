"""Secret scans with one deterministic automaton for all rules.

Each rule's regular expression is parsed, turned into a byte automaton, and all rules are joined by subset construction
and minimised into one transition array. A batch of texts is one byte string, cut into lanes at bytes that lead every
state back to the start; the lanes advance together, so that each byte is looked up once for all rules. Where a rule's
accepting state appears, a second automaton, of the reversed rule, walks back to the leftmost start.

A rule must end in a fixed text or in a repeated class, so that a match ends where its accepting states end. Matches
of a rule are leftmost and do not overlap; those of different rules may. Where a match has taken the beginning of what
the automaton still follows, it goes on from its start state behind that match until both runs agree again; as it
never turns back, no byte is looked up more than twice and once for each rule that matches there.

Defined cases: null and empty texts hold nothing (n_* 0, spans empty); texts have any length, and time grows with it in
proportion; equal starts are listed in the order of the rules; repeated rows are scanned each; extra columns don't
matter, whatever their names; an empty table gives no rows.
"""

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.batches import pieces


@dataclass(frozen=True)
class SecretRule:
    kind: str
    pattern: str
    any_case: bool = False
    #: Bytes that the last repeated class must take; a shorter match is dropped, but still covers its place.
    least_tail: int = 0


#: The base kinds in their order, then the method's own. Lengths of overlapping classes would multiply states, so most are checked afterwards.
BASE = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", least_tail=16),
    SecretRule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]+", least_tail=36),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least_tail=16),
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = (*BASE, *MORE)


class _Bytes:
    """A byte automaton with empty moves."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, items, a: int, any_case: bool, back: bool) -> int:
        """Reads the parsed expression from state a on, backwards if wanted; gives the last state."""
        for op, arg in reversed(list(items)) if back else items:
            a = self.one(str(op), arg, a, any_case, back)
        return a

    def one(self, op: str, arg, a: int, any_case: bool, back: bool) -> int:
        if op in ("LITERAL", "IN"):
            found = {arg} if op == "LITERAL" else {c for kind, x in arg for c in ([x] if str(kind) == "LITERAL" else range(x[0], x[1] + 1))}
            if any_case:
                found |= {ord(y) for c in found if chr(c).isalpha() for y in (chr(c).lower(), chr(c).upper())}
            if max(found) > 127:
                raise ValueError("rules are made of ASCII characters")
            b = self.state()
            self.moves[a].append((frozenset(found), b))
            return b
        if op == "SUBPATTERN":
            return self.add(arg[3], a, any_case, back)
        if op == "BRANCH":
            end = self.state()
            for way in arg[1]:
                start = self.state()
                self.empty[a].append(start)
                self.empty[self.add(way, start, any_case, back)].append(end)
            return end
        if op == "MAX_REPEAT":
            least, most, inner = arg
            for _ in range(least):
                a = self.add(inner, a, any_case, back)
            if str(most) == "MAXREPEAT":
                loop, out = self.state(), self.state()
                self.empty[a].append(loop)
                self.empty[self.add(inner, loop, any_case, back)].append(loop)
                self.empty[loop].append(out)
                return out
            end = self.state()
            self.empty[a].append(end)
            for _ in range(most - least):
                a = self.add(inner, a, any_case, back)
                self.empty[a].append(end)
            return end
        raise ValueError(f"{op} in a rule")

    def closed(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


class Automaton:
    """table[state, class_of[byte]] is the next state; accepts[state] has a bit for each rule. State 0 is the start."""

    def __init__(self, rules: tuple[SecretRule, ...], back: bool = False, search: bool = True):
        auto = _Bytes()
        root = auto.state()
        ends = {}
        for k, rule in enumerate(rules):
            start = auto.state()
            auto.empty[root].append(start)
            ends[auto.add(re._parser.parse(rule.pattern), start, rule.any_case, back)] = 1 << k
        signs: dict[tuple, int] = {}
        sets = list(dict.fromkeys(s for moves in auto.moves for s, _ in moves))
        self.class_of = np.array([signs.setdefault(tuple(b in s for s in sets), len(signs)) for b in range(256)], dtype=np.uint8)
        members = [next(b for b in range(256) if self.class_of[b] == c) for c in range(len(signs))]
        begin = auto.closed([root])
        ids, rows, queue = {begin: 0}, [], [begin]
        for subset in queue:
            row = []
            for b in members:
                to = {y for x in subset for s, y in auto.moves[x] if b in s}
                to = auto.closed(to) | begin if search else auto.closed(to)
                if to not in ids:
                    ids[to] = len(ids)
                    queue.append(to)
                row.append(ids[to])
            rows.append(row)
        table = np.array(rows, dtype=np.int64)
        accepts = np.array([sum({bit for x, bit in ends.items() if x in s}) for s in queue], dtype=np.int64)
        # states with the same answers and the same next groups are one
        group = np.unique(accepts, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == group.max():
                break
            group = finer
        order = np.unique(group, return_index=True)[1]
        at = np.argsort(np.argsort(np.where(group[order] == group[0], -1, order)))
        group, order = at[group], order[np.argsort(at)]
        self.table = group[table[order]].astype(np.int32)
        self.accepts = accepts[order]
        #: The same by plain byte, for steps that are taken one at a time.
        self.rows: list[list[int]] = self.table[:, self.class_of].tolist()
        self.dead = next((k for k in range(len(order)) if not self.accepts[k] and (self.table[k] == k).all()), -1) if not search else -1


class Scanner:
    """All rules in one automaton; more than MOST of them in several."""

    LANE, MOST = 1024, 62

    def __init__(self, rules: tuple[SecretRule, ...] = RULES):
        self.rules = rules
        self.parts = [_Part(rules[k : k + self.MOST], k) for k in range(0, len(rules), self.MOST)]

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) in code points for each text, by start, then kind as listed."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(raw)
        begins = np.cumsum([0, *(len(x) + 1 for x in raw)])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for part in self.parts:
            states = part.states(data)
            bits = part.all.accepts[states]
            for d in np.unique(np.searchsorted(begins, np.flatnonzero(bits), side="right") - 1).tolist():
                a, b = begins[d], begins[d] + len(raw[d])
                found[d] += part.matches(raw[d], states[a:b], bits[a:b])
        out = []
        for text, own, spans in zip(texts, raw, found):
            if spans and len(own) != len(text):
                # code points up to each byte
                upto = np.r_[0, np.cumsum((np.frombuffer(own, dtype=np.uint8) & 0xC0) != 0x80)]
                spans = [(int(upto[a]), k, int(upto[b])) for a, k, b in spans]
            out.append([(self.rules[k].kind, a, b) for a, k, b in sorted(spans)])
        return out


class _Part:
    """The automaton of some rules; first is the place of the first of them."""

    def __init__(self, rules: tuple[SecretRule, ...], first: int):
        self.rules, self.first, self.all = rules, first, Automaton(rules)
        self.back = [Automaton((r,), back=True, search=False) for r in rules]
        self.home = (self.all.table == 0).all(axis=0)[self.all.class_of]
        if not self.home[10]:
            raise ValueError("a rule crosses line breaks")

    def states(self, data: bytes) -> np.ndarray:
        """The state after each byte; data starts at the start state."""
        buf = np.frombuffer(data, dtype=np.uint8)
        out = np.empty(len(buf), dtype=np.int32)
        if not len(buf):
            return out
        resets = np.flatnonzero(self.home[buf]) + 1
        marks = np.arange(Scanner.LANE, len(buf), Scanner.LANE)
        at = np.searchsorted(resets, marks)
        begins = np.unique(np.r_[0, resets[at[at < len(resets)]]])
        begins = begins[begins < len(buf)]
        sizes = np.diff(np.r_[begins, len(buf)])
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = begins[order], sizes[order]
        classes, table, width = self.all.class_of[buf], self.all.table.ravel(), self.all.table.shape[1]
        state = np.zeros(len(begins), dtype=np.int32)
        # lanes in lockstep while there are many, the rest of the long ones one by one
        together = int(sizes[min(len(sizes) - 1, 24)]) if len(sizes) > 24 else 0
        alive = np.searchsorted(-sizes, -np.arange(together), side="left").tolist()
        pos = begins.copy()
        for n in alive:
            p = pos[:n]
            s = table[state[:n] * width + classes[p]]
            out[p] = s
            state[:n] = s
            p += 1
        view, rows = memoryview(out), self.all.rows
        for begin, size, s in zip(begins.tolist(), sizes.tolist(), state.tolist()):
            for p in range(begin + together, begin + size):
                view[p] = s = rows[s][data[p]]
        return out

    @staticmethod
    def runs(mask: np.ndarray) -> list[tuple[int, int]]:
        edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
        return list(zip(edge[::2].tolist(), edge[1::2].tolist()))

    def start_of(self, k: int, data: bytes, at: int, floor: int) -> int:
        """The leftmost start, not before floor, of a match of rule k whose first accepting byte is at; -1 if none."""
        auto, state, found = self.back[k], 0, -1
        rows, accepts, dead = auto.rows, auto.accepts, auto.dead
        for p in range(at, floor - 1, -1):
            state = rows[state][data[p]]
            if state == dead:
                break
            if accepts[state]:
                found = p
        return found

    def matches(self, data: bytes, states: np.ndarray, bits: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, rule, end) of the leftmost matches of each rule that do not overlap."""
        out = []
        for k in range(len(self.rules)):
            if runs := self.runs(bits >> k & 1):
                out += [(a, self.first + k, b) for a, b in self.of_rule(k, data, memoryview(states), runs)]
        return out

    def of_rule(self, k: int, data: bytes, states: memoryview, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """runs: where the first pass accepts rule k."""
        out, floor, i, least = [], 0, 0, self.rules[k].least_tail

        def take(first: int, end: int) -> None:
            if end - first >= least:
                out.append((self.start_of(k, data, first, floor), end))

        accepts, rows, n = [bool(x >> k & 1) for x in self.all.accepts.tolist()], self.all.rows, len(data)
        while i < len(runs):
            a, b = runs[i]
            i += 1
            if a < floor:
                continue
            if self.start_of(k, data, a, floor) >= 0:
                take(a, b)
                floor = b
                continue
            # what is accepted here began inside the last match: read on from the start state behind that match
            state, p, first = 0, floor, -1
            while p < n:
                state = rows[state][data[p]]
                if accepts[state]:
                    first = p if first < 0 else first
                elif first >= 0:
                    take(first, p)
                    floor, state, first = p, 0, -1
                    continue
                if state == states[p]:
                    break
                p += 1
            while i < len(runs) and runs[i][0] <= p:
                i += 1
            if first >= 0:
                end = n if p >= n else runs[i - 1][1]
                take(first, end)
                floor = end
        return out


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, n_base: int = len(BASE), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_<base kind>..., base_sha256, spans for each whole text."""
    scanner, kinds = Scanner(rules), [r.kind for r in rules[:n_base]]

    def run(batches):
        for batch, texts in pieces(batches, text_col):
            found = scanner.scan(texts)
            base = [[x for x in spans if x[0] in kinds] for spans in found]
            counts = [pa.array([sum(x[0] == kind for x in spans) for spans in base], pa.int64()) for kind in kinds]
            sha = pa.array([hashlib.sha256(spelled(x).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *counts, sha, pa.array(map(spelled, found), pa.string())], [id_col, *(f"n_{k}" for k in kinds), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'n_{k} long' for k in kinds)}, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of spans that touch or overlap replaced by the name of its first kind."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """The same rows and columns, with secrets masked in the text and the number of characters counted anew; nulls stay."""
    scanner = Scanner(rules)

    def run(batches):
        for batch, texts in pieces(batches, text_col):
            whole = batch.column(text_col).to_pylist()
            new = [t if not spans else masked(t, spans) for t, spans in zip(texts, scanner.scan(texts))]
            cols = {n: batch.column(n) for n in batch.schema.names}
            cols[text_col] = pa.array([None if w is None else t for w, t in zip(whole, new)], batch.schema.field(text_col).type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(n_chars_col, F.when(F.col(text_col).isNotNull(), F.length(text_col)).otherwise(F.col(n_chars_col)).cast(docs.schema[n_chars_col].dataType)) if n_chars_col in docs.columns else out


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    """Matches by the whole expressions; what stands between matches gives their places."""
    # letters in either case are written out, as (?i) would also take letters beyond ASCII
    assign = "((?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)"""
    # group 1 and the match itself tell the length that a match must have
    rules = [("assign", assign, 6), *((r.kind, "()(" + r.pattern.split("{")[0] + ("+)" if "{" in r.pattern else ")"), 24 if r.kind == "hex" else 0) for r in RULES[1:])]
    least = {"access": 20, "github": 40, "slack": 21}
    found = " union all ".join(
        f"select doc_id, {k} as k, '{kind}' as kind, {least.get(kind, n)} as least, regexp_extract_all(x, '{p}') as m, regexp_extract_all(x, '{p}', 2) as g, regexp_split_to_array(x, '{p}') as s from t"
        for k, (kind, p, n) in enumerate(rules)
    )
    return f"""
with t as (select doc_id, coalesce(text, '') as x from documents), e as ({found}),
i as (select doc_id, k, kind, least, m, g, s, unnest(range(1, len(m) + 1)) as i from e),
w as (select doc_id, k, kind, list_sum(list_transform(s[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) as a, length(m[i]) as n from i where length(g[i]) >= least),
b as (select doc_id, kind, k, kind || ':' || a::bigint || ':' || (a + n)::bigint as span, a from w),
f as (select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
  string_agg(span, ',' order by a, k) filter (where k < 3) as base, string_agg(span, ',' order by a, k) as spans from b group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join f using (doc_id)
"""


ORACLE = _oracle()
