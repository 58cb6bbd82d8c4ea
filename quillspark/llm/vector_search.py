"""Exact top-k by integer inner product over a bit-sliced index.

Vectors become integers floor(scale x). Rows are dealt into blocks. In a block each attribute is cut into 16 levels of one
width, four bit slices, one bitmap over the rows for each bit; eight attributes share a table of the slices of all sums of
their subsets. A query's values are cut likewise, into signed digits of ``DIGIT`` bits of a width of its own. A query's score is
the sum of slices weighted by the bits of its digits: full adders on bitmaps add the sums that the query picks from the
tables, for many queries at once. The sum's slices are walked from the most significant down, which finds the k-th largest
quantised sum, and so k exact scores that bound the best from below. What levels and digits leave out changes a sum by a
known most (Cauchy-Schwarz, by the largest remainders of the block; the few rows beyond are always looked at), so the rows
whose sum comes within that distance of the bound hold all of the block's top k. Only their scores are computed exactly. A
task meets one block after another, and the best k of earlier ones are the bound for later ones.

A block of queries meets every block of rows, as a Cartesian product of partitions: no copies are shuffled. Each task
returns k rows a query, which a window then merges.

Values may have any width: where products may need more than 53 bits, ``Block`` cuts all bits of the attributes into slices
but for the lowest (at most ``KEPT``), and sums and scores that 64 bits cannot hold are computed with Python's integers.

Defined cases: vectors that are null or hold null or non-finite components take no part, and neither do null ids; finite
components of any size do, but a score among the best k that is no long raises an error; vectors of different length are
filled up with zeros; ties go to the smaller id; rows of the query's own id are no candidates; repeated rows all count as
candidates, and once as queries; an empty table gives no rows; extra columns don't matter, whatever their names.
"""

import math
import uuid
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and queries of a block, and bits at least left out of a Block's slices and at most kept in them.
ROWS, QUERIES, DROPPED, KEPT = 4096, 4096, 1, 12
#: Rows of a task at least and at most, where there are enough: the more, the better a task's bound.
LEAST_ROWS, MOST_ROWS = 2 * ROWS, 64 * ROWS
#: Bits of a query's digits, queries whose slices are added at once, and attributes and MB of the tables of sums.
DIGIT, AT_ONCE, TOGETHER, TABLE_MB = 5, 32, 8, 32
#: Components that are multiplied at once, which fit a core's cache.
SCORED = 1 << 16


def whole_numbers(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x), as 64-bit integers where they suffice, else as Python's."""
    with np.errstate(over="ignore"):
        near = np.floor(rows * float(scale))
    if np.abs(near).max(initial=0) < 1 << 62:
        return near.astype(np.int64)
    exact = [[int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in r] for r in rows.tolist()]
    out = np.empty(rows.shape, dtype=object)
    out[:] = exact
    return out


def products(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, exact."""
    if values.dtype != object and query.dtype != object:
        if sum(a * abs(b) for a, b in zip(np.abs(values).max(axis=0, initial=0).tolist(), query.tolist())) < 1 << 63:
            return values @ query
    return values.astype(object) @ query.astype(object)


def add_slices(by_power: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Bitmaps (rows of an array) by power of two, to the slices of their sum, least significant first."""
    out, power = [], 0
    while by_power:
        found = by_power.pop(power, None)
        while found is not None and len(found) > 1:
            n = len(found) // 3
            if n:
                a, b, c = found[:n], found[n : 2 * n], found[2 * n : 3 * n]
                half = a ^ b
                total, carry, rest = half ^ c, (a & b) | (half & c), found[3 * n :]
            else:
                total, carry, rest = found[:1] ^ found[1:], found[:1] & found[1:], found[2:]
            found = np.concatenate([total, rest])
            above = by_power.get(power + 1)
            by_power[power + 1] = carry if above is None else np.concatenate([above, carry])
        out.append(found[0] if found is not None and len(found) else None)
        power += 1
    return out


def walk(slices: list[np.ndarray | None], valid: np.ndarray, k: int) -> tuple[int, np.ndarray]:
    """The k-th largest sum (0 if there are fewer rows), from the most significant slice down, and the rows that reach it."""
    sure, edge, value = np.zeros_like(valid), valid.copy(), 0
    for power in range(len(slices) - 1, -1, -1):
        if slices[power] is None:
            continue
        ones = edge & slices[power]
        if int(np.bitwise_count(sure | ones).sum()) >= k:
            edge, value = ones, value + (1 << power)
        else:
            sure, edge = sure | ones, edge & ~slices[power]
    return value, sure | edge


class Block:
    """The index of some rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.words = -(-len(ids) // 64)
        shifted = values - values.min(axis=0)
        most = [int(x) for x in shifted.max(axis=0)]
        self.dropped = max(DROPPED, max(most, default=0).bit_length() - KEPT)
        shifted = (shifted >> self.dropped).astype(np.int64)
        widths = [(x >> self.dropped).bit_length() for x in most]
        self.maps = [np.stack([self.packed(shifted[:, d] >> b & 1) for b in range(w)]) if w else None for d, w in enumerate(widths)]
        self.valid = self.packed(np.ones(len(ids), dtype=np.int64))

    def packed(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 64, dtype=np.uint8)
        out[: len(bits)] = bits
        return np.packbits(out, bitorder="little").view(np.uint64)

    def at_least(self, slices: list, floor: int) -> np.ndarray:
        """Rows whose sum is floor or more."""
        above, edge = np.zeros_like(self.valid), self.valid.copy()
        for power in range(max(len(slices), floor.bit_length()) - 1, -1, -1):
            bits = slices[power] if power < len(slices) and slices[power] is not None else np.zeros_like(self.valid)
            if floor >> power & 1:
                edge &= bits
            else:
                above |= edge & bits
                edge &= ~bits
        return above | edge

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (id, score) for one query, rows of its own id left out."""
        by_power: dict[int, list] = {}
        spread = 0
        for d, q in enumerate(query.tolist()):
            if not q:
                continue
            spread += abs(q) * ((1 << self.dropped) - 1)
            maps = self.maps[d]
            if maps is None:
                continue
            if q < 0:
                q, maps = -q, ~maps & self.valid
            for j in range(q.bit_length()):
                if q >> j & 1:
                    for b, m in enumerate(maps):
                        by_power.setdefault(b + j, []).append(m)
        slices = add_slices({p: np.stack(x) for p, x in by_power.items()})
        # sums leave out the dropped bits: each is short by at most spread, in units of the slices
        value, _ = walk(slices, self.valid, k + int((self.ids == query_id).sum()))
        near = self.at_least(slices, max(0, value - (-(-spread >> self.dropped)) - 1))
        at = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")[: len(self.ids)])
        at = at[self.ids[at] != query_id]
        exact = products(self.values[at], query)
        best = sorted(zip((-exact).tolist(), self.ids[at].tolist()))[:k] if exact.dtype == object else [(-int(exact[i]), int(self.ids[at[i]])) for i in np.lexsort((self.ids[at], -exact))[:k]]
        return [(i, -score) for score, i in best]


def add(one: list[np.ndarray], other: list[np.ndarray]) -> list[np.ndarray]:
    """Slices of the sums of two lists of slices, least significant first."""
    out, carry = [], None
    for x, y in zip_longest(one, other):
        if x is None or y is None:
            half, both = (y if x is None else x), None
        else:
            half, both = x ^ y, x & y
        if carry is None:
            out.append(half)
            carry = both
        else:
            out.append(half ^ carry)
            carry = half & carry
            if both is not None:
                carry |= both
    return out if carry is None else [*out, carry]


class Digits:
    """Queries cut into signed digits of ``DIGIT`` bits."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        exact = values.astype(np.float64)
        top = 1 << DIGIT - 1
        self.step = np.maximum(np.abs(exact).max(axis=1, initial=0), 1) / (top - 0.5)
        digits = np.clip(np.rint(exact / self.step[:, None]), -top, top - 1)
        self.total = digits.sum(axis=1)
        self.norm = self.step * np.sqrt((digits**2).sum(axis=1))
        self.rest = np.sqrt(((exact - digits * self.step[:, None]) ** 2).sum(axis=1))
        groups = -(-values.shape[1] // TOGETHER)
        bits = np.zeros((len(ids), groups * TOGETHER), dtype=np.int64)
        bits[:, : values.shape[1]] = digits.astype(np.int64) & 2 * top - 1
        planes = np.stack([(bits >> j & 1).reshape(len(ids), groups, TOGETHER) @ (1 << np.arange(TOGETHER)) for j in range(DIGIT)])
        #: by group, bit and query, the place of the subset in the tables
        self.places = planes.transpose(2, 0, 1) + (np.arange(groups) << TOGETHER)[:, None, None]
        self.exact, self.short = exact, exact.astype(np.float32)


class Levels:
    """The index of some rows, cut into 16 levels an attribute."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        n, width = values.shape
        self.ids, self.exact, self.words = ids, values.astype(np.float64), -(-n // 64)
        self.short = self.exact.astype(np.float32)
        self.most = np.abs(self.exact).max(axis=0)
        self.mean = self.exact.mean(axis=0)
        x = self.exact - self.mean
        some, spread = x[:: -(-n // 256)], max(float(np.abs(x).max(initial=0)), 1e-3)
        cut = lambda x, step: np.clip(np.floor(x / step) + 8, 0, 15)
        rest = lambda x, step, level: np.sqrt(((x - (level - 7.5) * step) ** 2).sum(axis=1))
        # narrow levels leave less out, but for rows beyond the outermost
        self.step = min((spread / 8 * 0.87**j for j in range(16)), key=lambda step: np.quantile(rest(some, step, cut(some, step)), 0.95))
        levels = cut(x, self.step)
        rests, norms, most = rest(x, self.step, levels), np.sqrt((x**2).sum(axis=1)), n - 1 - n // 512
        self.rest, self.norm = np.partition(rests, most)[most], np.partition(norms, most)[most]
        self.valid = self.packed(np.ones((1, n), dtype=np.uint8))[0]
        self.always = self.packed(((rests > self.rest) | (norms > self.norm))[None])[0]
        groups = -(-width // TOGETHER)
        flat = np.zeros((groups * TOGETHER, n), dtype=np.uint8)
        flat[:width] = levels.T
        slices = [self.packed(flat >> b & 1).reshape(groups, TOGETHER, self.words) for b in range(4)]
        tables = [np.zeros((groups, 1 << TOGETHER, self.words), dtype=np.uint64) for _ in range((15 * TOGETHER).bit_length())]
        for i in range(TOGETHER):
            for table, total in zip(tables, add([t[:, : 1 << i] for t in tables], [s[:, i : i + 1] for s in slices])):
                table[:, 1 << i : 2 << i] = total
        self.tables = [t.reshape(-1, self.words) for t in tables]

    def packed(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bits), self.words * 64), dtype=np.uint8)
        out[:, : bits.shape[1]] = bits
        return np.packbits(out, axis=1, bitorder="little").view(np.uint64)

    def sums(self, places: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices (queries by words) of the sums of digits by levels, more by a constant, and that constant."""
        total: list = []
        for j in range(DIGIT - 1, -1, -1):  # a bit at a time, so that all of it fits a core's cache
            found = [np.take(t, places[:, j], axis=0) for t in self.tables]
            while len(found[0]) > 1:
                half = len(found[0]) // 2
                pairs = add([f[:half] for f in found], [f[half : 2 * half] for f in found])
                if len(found[0]) % 2:
                    pairs = [np.concatenate([t, f[2 * half :]]) for t, f in zip(pairs, [*found, np.zeros_like(found[0])])]
                found = pairs
            found = [f[0] for f in found]
            # the highest bit of a digit counts negative: its complement is added
            total = [found[0], *add(found[1:], total)] if total else [~f for f in found]
        return total, (1 << DIGIT - 1) * ((1 << len(found)) - 1)

    def reached(self, slices: list[np.ndarray], floors: np.ndarray) -> np.ndarray:
        """Bitmaps of the rows whose sum is at least the query's floor."""
        carry = self.valid  # of the sum and the floor's complement
        for power, bits in enumerate(slices):
            ones = np.where(floors >> power & 1, 0, -1).astype(np.int64).view(np.uint64)[:, None]
            carry = (bits & carry) | (ones & (bits | carry))
        return np.where(floors[:, None] < 1 << len(slices), carry, np.uint64(0)) & self.valid

    def best(self, slices: list[np.ndarray], k: int) -> np.ndarray:
        """Bitmaps of the rows that reach the k-th largest sum, walked from the most significant slice down."""
        sure = np.zeros_like(slices[0])
        edge = sure | self.valid
        for bits in reversed(slices):
            ones = edge & bits
            enough = (np.bitwise_count(sure | ones).sum(axis=1, dtype=np.int64) >= k)[:, None]
            sure, edge = np.where(enough, sure, sure | ones), np.where(enough, ones, edge & ~bits)
        return sure | edge

    def scores(self, rows: np.ndarray, queries: Digits, first: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and exact score of the rows in the queries' bitmaps, those of the query's own id left out."""
        at = np.flatnonzero(np.unpackbits(rows.view(np.uint8), axis=None, bitorder="little"))
        q, r = np.divmod(at, self.words * 64)
        q += first
        other = self.ids[r] != queries.ids[q]
        q, r = q[other], r[other]
        x, y = (self.short, queries.short) if short else (self.exact, queries.exact)
        few = max(1, SCORED // x.shape[1])
        scores = [np.einsum("ij,ij->i", x[r[i : i + few]], y[q[i : i + few]]) for i in range(0, len(r), few)]
        return q, self.ids[r], np.concatenate([np.zeros(0), *scores])


class Best:
    """The k best rows of each query so far; scores of places not taken are -inf."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores = k, np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf)

    def take(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        last = self.scores[q, -1]
        keep = (scores > last) | (scores == last) & (ids < self.ids[q, -1])
        if not keep.any():
            return
        q, ids, scores = q[keep], ids[keep], scores[keep]
        had = np.unique(q)
        q, ids, scores = np.concatenate([q, had.repeat(self.k)]), np.concatenate([ids, self.ids[had].ravel()]), np.concatenate([scores, self.scores[had].ravel()])
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.ids[q[keep], rank[keep]], self.scores[q[keep], rank[keep]] = ids[keep], scores[keep]


def meet(rows: Levels, queries: Digits, best: Best) -> None:
    """Takes the rows that are among the best of a query."""
    unit = queries.step * rows.step
    fixed = queries.exact @ rows.mean - 7.5 * unit * queries.total
    # floats differ from the true sums by far less than a 10^12th of the largest
    error = (queries.rest * rows.norm + queries.norm * rows.rest) * (1 + 1e-9) + 1e-12 * (np.abs(queries.exact) @ (rows.most + np.abs(rows.mean)) + unit * np.abs(queries.total))
    short = bool((np.abs(queries.exact) @ rows.most).max(initial=0) < 1 << 24)  # then 32-bit floats hold all partial sums
    repeats = int(np.unique(rows.ids, return_counts=True)[1].max())
    for first in range(0, len(queries.ids), AT_ONCE):
        here = slice(first, first + AT_ONCE)
        slices, more = rows.sums(queries.places[:, :, here])
        bound = best.scores[here, -1]
        if np.isneginf(bound).any():
            found = Best(len(queries.ids[here]), best.k)
            q, ids, scores = rows.scores(rows.best(slices, best.k + repeats), queries, first, short)
            found.take(q - first, ids, scores)
            bound = np.maximum(bound, found.scores[:, -1])
        floors = np.floor((bound - fixed[here] - error[here]) / unit[here]) + (more - 1)
        floors = np.clip(floors, 0, 1 << len(slices)).astype(np.int64)
        best.take(*rows.scores(rows.reached(slices, floors) | rows.always, queries, first, short))


def packer(size: int, width: int):
    """Batches of (id, v) to blocks of at most that many rows, without vectors that hold null or non-finite components."""

    def block(held: list) -> pa.RecordBatch:
        columns = [pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in zip(*held)]
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *columns], ["key", "ids", "v"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                ids, v = _filled(batch.slice(start, ROWS), width)
                while len(ids):
                    held.append((ids[: size - n], v[: size - n]))
                    ids, v, n = ids[size - n :], v[size - n :], n + len(held[-1][0])
                    if n == size:
                        yield block(held)
                        held, n = [], 0
        if n:
            yield block(held)

    return run


def _filled(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, filled up with zeros, of the vectors that take part."""
    ids, column = batch.column("id").to_numpy(), batch.column("v")
    flat, ends = column.flatten(), column.offsets.to_numpy().astype(np.int64)
    row = np.arange(len(ids)).repeat(np.diff(ends))
    out = np.zeros((len(ids), width))
    out[row, np.arange(len(flat)) - (ends[:-1] - ends[0])[row]] = flat.to_numpy(zero_copy_only=False)  # null becomes nan
    able = np.isfinite(out).all(axis=1)
    return ids[able], out[able]


def _split(block: pa.StructScalar, width: int, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and whole numbers of a block: rows so small that 53 bits hold products of two such rows, and the others."""
    ids = np.frombuffer(block["ids"].as_buffer(), dtype=np.int64)
    rows = np.frombuffer(block["v"].as_buffer(), dtype=np.float64).reshape(len(ids), width)
    small = (np.abs(rows) * float(scale)).max(axis=1, initial=0) < (1 << (52 - width.bit_length()) // 2) - 1
    return [(ids[x], whole_numbers(rows[x], scale)) for x in (small, ~small)]


def _batch(q, ids, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (q, ids, scores)], ["query_id", "vec_id", "score"])


def top_k(
    spark: SparkSession, rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest scores among the rows of other ids."""
    vector = lambda df: F.col(vector_col) if dict(df.dtypes)[vector_col] == "array<float>" else F.col(vector_col).cast("array<double>")
    read = lambda df: df.select(F.col(id_col).cast("long").alias("id"), vector(df).alias("v")).where("id is not null and v is not null")
    rows, queries = read(rows), read(queries).dropDuplicates(["id", "v"])
    (n, width), (n_queries, other_width) = (df.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first() for df in (rows, queries))
    width = max(1, width, other_width)
    n_groups = max(1, -(-n_queries // QUERIES))
    n_parts = max(1, -(-n // MOST_ROWS), min(-(-4 * spark.sparkContext.defaultParallelism // n_groups), -(-n // LEAST_ROWS)))
    packed = lambda df, n, size: df.repartition(n).mapInArrow(packer(size, width), "key string, ids binary, v binary")
    # a partition of queries is one block, even if they are not dealt out quite evenly
    blocks = packed(rows, n_parts, ROWS).select(F.struct("*").alias("rows"))
    groups = packed(queries, n_groups, 2 * QUERIES).select(F.struct("*").alias("queries"))
    pairs = blocks.crossJoin(groups.hint("shuffle_replicate_nl"))
    piece = 64 * max(1, TABLE_MB * 1_000_000 // (-(-width // TOGETHER) * 8 * (15 * TOGETHER).bit_length() << TOGETHER))

    def run(batches):
        cut, key = {}, None
        for batch in batches:
            for rs, qs in zip(batch.column("rows"), batch.column("queries")):
                if (group := qs["key"].as_py()) not in cut:
                    (ids, values), large = _split(qs, width, scale)
                    cut[group] = Digits(ids, values), Best(len(ids), k), large
                digits, best, large = cut[group]
                if key != rs["key"].as_py():
                    key = rs["key"].as_py()
                    small, wide = _split(rs, width, scale)
                    index = [Levels(small[0][i : i + piece], small[1][i : i + piece]) for i in range(0, len(small[0]), piece)]
                    # rows for the small queries that Levels do not hold, and all rows for the others
                    rest = Block(*wide) if len(wide[0]) else None
                    whole = None
                for levels in index:
                    meet(levels, digits, best)
                found = []
                if rest:
                    found += [(int(i), *hit) for i, x in zip(digits.ids, digits.values) for hit in rest.top(i, x, k)]
                if len(large[0]):
                    whole = whole or Block(np.concatenate([small[0], wide[0]]), np.concatenate([small[1], wide[1]]))
                    found += [(int(i), *hit) for i, x in zip(*large) for hit in whole.top(i, x, k)]
                if any(not -(1 << 63) <= score < 1 << 63 for _, _, score in found):
                    raise OverflowError("a score among the best is too large for a long")
                if found:
                    yield _batch(*zip(*found))
        for digits, best, _ in cut.values():
            for start in range(0, len(digits.ids), ROWS):
                there = np.isfinite(best.scores[start : start + ROWS])
                q = digits.ids[start : start + ROWS].repeat(k)[there.ravel()]
                yield _batch(q, best.ids[start : start + ROWS][there], best.scores[start : start + ROWS][there].astype(np.int64))

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(spark, rows, rows.where("vec_id % 50 = 0"))


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, r.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * r.e[i]))::bigint as score
  from v q join v r on q.vec_id % 50 = 0 and q.vec_id <> r.vec_id),
k as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from k where rank <= 5
"""
