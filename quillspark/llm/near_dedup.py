"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text's set of word shingles gives its size, a hash of the whole set, and ``HASHES`` minima. Texts with the same
   set are one class, gathered by partial aggregates, so that a class of most rows is a few rows in the shuffle.
2. The minima are banded. In each bucket every class is paired with the bucket's smallest class only.
3. Signatures of a pair are compared batch by batch; it is dropped once the posterior probability of reaching the
   threshold, under a flat prior, falls below ``MISS``. Survivors are verified on their full sets.
4. Verified links make components. In a bucket that still holds several, classes outside its largest component are
   compared with all classes of other components, in blocks of bounded size that need not meet in one task, each pair in
   the first bucket that it shares. Classes with a surviving partner get their full sets and are verified in the block.

Two texts at the threshold share no bucket with probability (1 - 0.8^4)^24, about 3e-6. Tables that a hot key is joined
with are written first, so that Spark can split the partition of that key.

Defined cases: null and empty texts have no shingles and stay alone; texts with fewer words than a shingle have one, the
whole; texts of any length are shingled whole; each row of an id is judged by its own text, and all rows are given; a
null id is a row of its class like others, but names no component unless all ids are null; of equal texts the smallest id
stands for all; extra columns don't matter, whatever their names; an empty table gives no rows.
"""

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.batches import pieces
from quillspark.llm.components import components
from quillspark.plans.staging import Stage

BANDS, ROWS, BATCH = 24, 4, 32
HASHES = BANDS * ROWS
MISS = 1e-5
#: Members of one side of a block, and of one side of what is compared at once.
BLOCK, CHUNK = 512, 256
#: Bits of the filter that keeps texts out of the verification's shuffle, at most, and for each wanted id. With more ids than it serves, a join picks the texts.
FILTER_BITS, BITS_AN_ID = 1 << 27, 16
_random = np.random.default_rng(20240607)
_A = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_K = _random.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


_ids = _Ids()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; A-Z is lower-cased, words are parted by ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(_ids) > 500_000:
        _ids.clear()
    h = np.fromiter(map(_ids.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * _K[k]
    return np.unique(_mixed(out))


def signature(sets: np.ndarray) -> np.ndarray:
    x, least = (sets >> np.uint64(32)).astype(np.uint32), np.full(HASHES, np.uint32(0xFFFFFFFF))
    for k in range(0, len(x), 8192):
        np.minimum(least, (_A[:, None] * x[None, k : k + 8192] + _B[:, None]).min(axis=1), out=least)
    return least


def bands(sig: np.ndarray) -> np.ndarray:
    """A key for each band of each row of signatures."""
    parts = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return _mixed((parts * _K[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _K[8]).view(np.int64)


def bound(compared: int, num: int, den: int, miss: float = MISS) -> int:
    """The fewest equal minima of so many compared with which a pair goes on.

    The posterior of the similarity is Beta(m + 1, n - m + 1); the chance that it is at least t equals that of at most
    m successes in n + 1 trials at rate t.
    """
    t, total = num / den, 0.0
    for m in range(compared + 1):
        total += math.comb(compared + 1, m) * t**m * (1 - t) ** (compared + 1 - m)
        if total >= miss:
            return m
    return compared + 1


def likely(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of rows of signatures survive the batches."""
    at, equal = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for k in range(0, HASHES, BATCH):
        equal = equal + (a[at, k : k + BATCH] == b[at, k : k + BATCH]).sum(axis=1)
        go = equal >= bound(k + BATCH, num, den)
        at, equal = at[go], equal[go]
    return at


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows to an Arrow batch, for rows that are large; for what is written inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def sketch(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, set_key, sig, bands; the last three are null without shingles."""

    def run(batches):
        for batch, texts in pieces(batches, text_col):
            n, keys, sigs, rows = [], [], [], []
            for t in texts:
                s = shingles(t, width)
                n.append(len(s))
                if len(s):
                    sig = signature(s)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sigs.append(sig.tobytes())
                    rows.append(sig)
                else:
                    keys.append(None)
                    sigs.append(None)
            banded = iter(bands(np.array(rows)).tolist()) if rows else iter(())
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array([next(banded) if s else None for s in sigs], pa.list_(pa.int64()))],
                ["doc_id", "n", "set_key", "sig", "bands"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n long, set_key binary, sig binary, bands array<long>")


def survivors(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs u, v whose signatures survive."""
    a = reps.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("sig").alias("su"))
    b = reps.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("sig").alias("sv"))

    def run(batches):
        for x in batches:
            at = likely(_matrix(x.column("su"), np.uint32, HASHES), _matrix(x.column("sv"), np.uint32, HASHES), num, den)
            yield x.select(["u", "v"]).take(pa.array(at, pa.int64()))

    near = F.expr(f"least(nu, nv) * {den} >= greatest(nu, nv) * {num}")
    return pairs.join(a, "u").join(b, "v").where(near).select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def full_sets(wanted: DataFrame, docs: DataFrame, width: int, id_col: str, text_col: str, stage: Stage, name: str) -> DataFrame | None:
    """id, s: the full sets of classes; wanted has their id, set_key and the id of one document; None if it is empty.

    A bitmap of hashed document ids keeps other texts from being shingled; what passes beside them is sorted out by set_key.
    """
    wanted = stage.write(wanted.distinct(), f"{name}_wanted")
    n = wanted.count()
    if not n:
        return None
    size = 1 << max(20, (n * BITS_AN_ID - 1).bit_length())
    own = F.col(id_col).cast("long")
    texts = docs.select(own.alias("rep"), F.col(text_col).alias("text"))
    place = lambda c: F.pmod(F.xxhash64(F.lit(3), c), F.lit(min(size, FILTER_BITS)))
    bits = None
    if size <= FILTER_BITS:
        word = 4096
        maps = wanted.select(place("rep").alias("p")).groupBy(F.floor(F.col("p") / (word * 8)).alias("b")).agg(F.bitmap_construct_agg(F.col("p") % (word * 8)).alias("m")).collect()
        bits = np.zeros(size // 8, dtype=np.uint8)
        for r in maps:
            bits[r["b"] * word : (r["b"] + 1) * word] = np.frombuffer(r["m"], dtype=np.uint8)
    else:
        reps = wanted.select(F.col("rep").alias("wanted_rep")).distinct()
        texts = texts.join(reps, F.col("rep").eqNullSafe(F.col("wanted_rep")), "left_semi")

    def sets(batches):
        for batch, found in pieces(batches, "text"):
            at = range(len(found))
            if bits is not None:
                p = batch.column("p").to_numpy()
                at = np.flatnonzero(bits[p // 8] >> (p % 8).astype(np.uint8) & 1).tolist()
            out = [shingles(found[k], width).tobytes() for k in at]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in out], pa.binary()), pa.array(out, pa.binary())], ["set_key", "s"])

    rows = texts.withColumn("p", place("rep")).mapInArrow(sets, "set_key binary, s binary").groupBy("set_key").agg(F.first("s").alias("s"))
    out = stage.write(rows.join(wanted.select("id", "set_key"), "set_key").select("id", "s"), name)
    stage.drop(f"{name}_wanted")
    return out


def verified(spark: SparkSession, pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str, stage: Stage, name: str) -> DataFrame:
    """The pairs u, v whose full sets reach the threshold."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    found = full_sets(classes.select("id", "set_key", "rep").join(ids, "id", "left_semi"), docs, width, id_col, text_col, stage, f"{name}_sets")
    if found is None:
        return stage.write(pairs.limit(0), name)

    def run(batches):
        for x in batches:
            keep = []
            for k, (a, b) in enumerate(zip(x.column("a").to_pylist(), x.column("b").to_pylist())):
                a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if common * den >= num * (len(a) + len(b) - common):
                    keep.append(k)
            yield x.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    a, b = found.select(F.col("id").alias("u"), F.col("s").alias("a")), found.select(F.col("id").alias("v"), F.col("s").alias("b"))
    with small_batches(spark, 256):
        out = stage.write(pairs.join(b, "v").join(a, "u").select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), name)
    stage.drop(f"{name}_sets")
    return out


BLOCK_KEYS = ["key", "i", "j", "kind"]


def whole_blocks(batches) -> Iterator[pa.Table]:
    """The rows of sorted batches again, each block in one table with others or alone."""
    held: list[pa.RecordBatch] = []
    for x in batches:
        if not x.num_rows:
            continue
        end = [x.column(c)[x.num_rows - 1].as_py() for c in BLOCK_KEYS]
        same = np.all([x.column(c).to_numpy() == e for c, e in zip(BLOCK_KEYS, end)], axis=0)
        cut = 0 if same.all() else x.num_rows - int(np.argmin(same[::-1]))
        if cut:
            yield pa.Table.from_batches([*held, x.slice(0, cut)])
            held = []
        elif held and [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in BLOCK_KEYS] != end:
            yield pa.Table.from_batches(held)
            held = []
        held.append(x.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def parted(table: pa.Table) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Each block of a table: where it begins, and its columns."""
    cols = {c: table.column(c).to_numpy() for c in (*BLOCK_KEYS, "band", "id", "n", "comp", "own")}
    cols["is_main"] = np.array(table.column("is_main").to_pylist(), dtype=bool)
    cols["sig"] = _matrix(table.column("sig"), np.uint32, HASHES)
    change = np.flatnonzero(np.any([cols[c][1:] != cols[c][:-1] for c in BLOCK_KEYS], axis=0)) + 1
    for a, b in zip(np.r_[0, change].tolist(), np.r_[change, len(cols["id"])].tolist()):
        yield a, {c: x[a:b] for c, x in cols.items()}


def block_candidates(g: dict[str, np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a block that survive the bounds and share no earlier band, and their equal minima.

    Kind 0 sets members outside the main component against members of it, kind 1 chunk i of the former against chunk j.
    """
    none = np.zeros(0, dtype=np.int64)
    if g["kind"][0] == 0:
        left, right = np.flatnonzero(~g["is_main"]), np.flatnonzero(g["is_main"])
    else:
        left, right = np.flatnonzero(g["own"] == g["i"]), np.flatnonzero(g["own"] == g["j"])
    if not len(left) or not len(right):
        return none, none, none
    out = [(none, none, none)]
    for c in range(0, len(left), CHUNK):
        part = left[c : c + CHUNK]
        n, m = g["n"][part][:, None], g["n"][right][None, :]
        open_ = (g["comp"][part][:, None] != g["comp"][right][None, :]) & (np.minimum(n, m) * den >= np.maximum(n, m) * num)
        if g["kind"][0] == 1 and g["i"][0] == g["j"][0]:
            open_ &= g["id"][part][:, None] < g["id"][right][None, :]
        x, y = np.nonzero(open_)
        x, y = part[x], right[y]
        for k in range(0, len(x), 65536):
            u, v = x[k : k + 65536], y[k : k + 65536]
            a, b = g["sig"][u], g["sig"][v]
            at = likely(a, b, num, den)
            shared = (a[at].reshape(-1, BANDS, ROWS) == b[at].reshape(-1, BANDS, ROWS)).all(axis=2)
            at = at[shared.argmax(axis=1) == g["band"][0]]
            out.append((u[at], v[at], (a[at] == b[at]).sum(axis=1)))
    return tuple(np.concatenate(c) for c in zip(*out))


def residual_blocks(reps: DataFrame, labels: DataFrame, stage: Stage, name: str) -> DataFrame:
    """Members of buckets with several components, in blocks of at most about two times BLOCK rows.

    A member is copied once for each block of the bucket's other members, so rows are the pairs divided by BLOCK.
    """
    member = reps.select("id", "bands").join(labels, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), F.posexplode("bands").alias("band", "key"))
    per = member.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key")
    per = per.agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1 and size > 2")
    chunks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    per = per.select("key", F.col("top.comp").alias("main"), chunks(F.col("top.c")).alias("mc"), chunks(F.col("size") - F.col("top.c")).alias("rc"))
    per = stage.write(per, f"{name}_per")
    rows = member.join(per, "key").withColumn("is_main", F.col("comp") == F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit(9), "id"), F.when(F.col("is_main"), F.col("mc")).otherwise(F.col("rc"))).cast("int"))
    rows = rows.join(reps.select("id", "n", "sig"), "id")
    place = lambda i, j, kind: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"))
    to = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    own = F.col("own")
    for_main = to("rc", lambda k: place(k, own, 0))
    for_rest = F.concat(to("mc", lambda k: place(own, k, 0)), to("rc", lambda k: place(F.least(own, k), F.greatest(own, k), 1)))
    rows = rows.select("key", "band", "id", "n", "sig", "comp", "is_main", "own", F.explode(F.when(F.col("is_main"), for_main).otherwise(for_rest)).alias("block"))
    return rows.select("key", "band", "block.i", "block.j", "block.kind", "id", "n", "sig", "comp", "is_main", "own")


def block_links(spark: SparkSession, reps: DataFrame, classes: DataFrame, labels: DataFrame, docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str, stage: Stage, name: str) -> DataFrame:
    """Verified links u, v that join components in the residual blocks; links between joined components are left out.

    Pairs are never rows: first each block keeps the members that have a surviving partner in it, then it gets their full
    sets and verifies its pairs, the likeliest first.
    """

    def members(batches):
        for table in whole_blocks(batches):
            keep = []
            for a, g in parted(table):
                x, y, _ = block_candidates(g, num, den)
                keep.append(np.unique(np.r_[x, y]) + a)
            out = table.take(pa.array(np.concatenate(keep), pa.int64())).combine_chunks()
            yield from out.to_batches()

    def links(batches):
        for table in whole_blocks(batches):
            sets = [np.frombuffer(s, dtype=np.uint64) for s in table.column("s").to_pylist()]
            found = []
            for a, g in parted(table):
                x, y, equal = block_candidates(g, num, den)
                joined: dict[int, int] = {}

                def top(c, joined=joined):
                    while c in joined:
                        c = joined[c]
                    return c

                order = np.lexsort((-equal, x))
                for u in np.unique(x).tolist():
                    mine = order[np.searchsorted(x[order], u) : np.searchsorted(x[order], u, side="right")]
                    for k in range(0, len(mine), 32):
                        near = [v for v in y[mine[k : k + 32]].tolist() if top(int(g["comp"][v])) != top(int(g["comp"][u]))]
                        if not near:
                            continue
                        sizes = np.array([len(sets[a + v]) for v in near])
                        flat, own = np.concatenate([sets[a + v] for v in near]), sets[a + u]
                        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                        common = np.add.reduceat(hit, np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
                        for v in np.flatnonzero(common * den >= num * (len(own) + sizes - common)).tolist():
                            c, d = top(int(g["comp"][near[v]])), top(int(g["comp"][u]))
                            if c != d:
                                joined[c] = d
                                found.append((int(g["id"][u]), int(g["id"][near[v]])))
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["u", "v"])

    blocks = residual_blocks(reps, labels, stage, name).repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS)
    left = stage.write(blocks.mapInArrow(members, blocks.schema), f"{name}_left")
    stage.drop(f"{name}_per")
    sets = full_sets(classes.select("id", "set_key", "rep").join(left.select("id").distinct(), "id", "left_semi"), docs, width, id_col, text_col, stage, f"{name}_sets")
    if sets is None:
        return stage.write(left.select(F.col("id").alias("u"), F.col("id").alias("v")), name)
    with small_batches(spark, 512):
        out = stage.write(left.join(sets, "id").repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS).mapInArrow(links, "u long, v long"), name)
    stage.drop(f"{name}_sets")
    stage.drop(f"{name}_left")
    return out


def near_groups(
    spark: SparkSession, docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links are pairs of sets with den * intersection >= num * union."""
    stage = Stage(spark, "near")
    rows = stage.write(sketch(docs, width, id_col, text_col), "rows")
    classes = rows.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first(F.struct("n", "sig", "bands")).alias("s"))
    classes = stage.write(classes.select(F.monotonically_increasing_id().alias("id"), "set_key", "rep", "s.n", "s.sig", "s.bands"), "classes")
    reps = classes.select("id", "n", "sig", "bands")
    member = reps.select("id", F.explode("bands").alias("key"))
    hubs = stage.write(member.groupBy("key").agg(F.min("id").alias("u"), F.count("*").alias("c")).where("c > 1").select("key", "u"), "hubs")
    pairs = member.join(hubs, "key").where("id <> u").select("u", F.col("id").alias("v")).distinct()
    open_ = stage.write(survivors(pairs, reps, num, den), "open")
    links = verified(spark, open_, classes, docs, width, num, den, id_col, text_col, stage, "links")
    stage.drop("hubs")
    stage.drop("open")
    labels = stage.write(components(spark, links, stage, "stars"), "labels")
    more = block_links(spark, reps, classes, labels, docs, width, num, den, id_col, text_col, stage, "more")
    # components of the first links are joined by the others
    name_of = lambda end: labels.select(F.col("id").alias(end), F.col("comp").alias(f"{end}c"))
    joined = more.join(name_of("u"), "u", "left").join(name_of("v"), "v", "left").select(F.coalesce("uc", "u").alias("u"), F.coalesce("vc", "v").alias("v"))
    over = stage.write(components(spark, joined, stage, "over"), "over")
    labels = labels.join(over.select(F.col("id").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("id", F.coalesce("top", "comp").alias("comp"))
    alone = over.join(labels, "id", "left_anti")
    named = classes.select("id", "set_key", "rep").join(labels.unionByName(alone), "id", "left").select("set_key", "rep", F.coalesce("comp", "id").alias("comp"))
    named = stage.write(named, "named")
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    final = stage.write(named.join(stage.write(least, "least"), "comp").select("set_key", "component_id"), "final")
    for name in ("classes", "links", "stars_0", "labels", "more", "over", "named", "least"):
        stage.drop(name)
    # the class of most rows is one partition of this join, which Spark splits; texts without shingles stay out of it
    linked = rows.where("n > 0").select("doc_id", "n", "set_key").join(final, "set_key").select("doc_id", "n", "component_id")
    out = linked.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_copies(spark: SparkSession, docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id.

    Of repeated rows of an id one stays, the first by text; rows without an id stay if their group has no id at all; null
    and empty texts stay; columns of any name and an empty table are kept as they are.
    """
    own = "_kept"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    kept = near_groups(spark, docs, width, num, den).where("kept").select(F.col("doc_id").alias(own)).distinct()
    order = Window.partitionBy("doc_id").orderBy("text")
    known = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col(own), "left_semi")
    known = known.withColumn(own, F.row_number().over(order)).where(F.col(own) == 1).drop(own)
    # rows without an id are no key to gather by
    unknown = docs.where("doc_id is null").join(kept.where(F.col(own).isNull()), how="left_semi")
    return known.unionByName(unknown)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as a
  from documents),
s as (
  select distinct doc_id, unnest(case when len(a) = 0 then [] when len(a) < 4 then [array_to_string(a, ' ')]
    else list_transform(range(1, len(a) - 2), lambda i: array_to_string(a[i:i + 3], ' ')) end) as g
  from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 80 * (x.n + y.n - c)),
e as (select u, v from l union all select v, u from l),
r(id, far) as (select doc_id, doc_id from documents union select r.id, e.v from r join e on e.u = r.far)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id, d.doc_id = m.c as kept
from documents d join (select id, min(far) as c from r group by 1) m on m.id = d.doc_id left join n on n.doc_id = d.doc_id
"""
