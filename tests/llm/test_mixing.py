import re
from collections import defaultdict

from quillspark.llm import mixing


def quotas(votes, n):
    """Sainte-Laguë by one block at a time."""
    got = [0] * len(votes)
    for _ in range(n):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[k] += 1
    return got


def test_quotas_equal_one_block_at_a_time(spark):
    from pyspark.sql import functions as F

    for votes, n in (([53.0, 24.0, 23.0], 10), ([1000.0, 1.0, 1.0, 7.0], 40), ([5.5] * 5, 13), ([3.0], 4), ([90.0, 4.0, 3.0, 2.0, 1.0], 9), ([1.0, 0.0], 3)):
        df = spark.createDataFrame([(1, k, v) for k, v in enumerate(votes)], "g int, k int, v double")
        out = {r["k"]: r["quota"] for r in mixing.apportion(df, "v", F.lit(n), ["g"], ["k"]).collect()}
        assert [out[k] for k in range(len(votes))] == quotas(votes, n)


def target_of(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        left, weight = total - sum(fixed.values()), sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / weight > most * sizes[s]]
        if not over:
            return fixed | {s: left * w[s] / weight for s in rest}
        fixed |= {s: most * sizes[s] for s in over}


def test_targets_and_taken(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows, again = ([tuple(r) for r in mixing.op5_source_mixing(spark, data).orderBy("doc_id").collect()] for _ in range(2))
    assert rows == again
    texts = {r["doc_id"]: (r["text"], r["source"]) for r in df.collect()}
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for doc_id, size, _, target, took in rows:
        text, source = texts[doc_id]
        assert size == len(re.findall(r"[^\x20\x09-\x0D]+", text)) and 0 <= took <= 2 * size
        sizes[source] += size
        taken[source] += took
        targets[source] = target
    want = target_of(sizes, (3, 1, 2), 1.5, 2.0)
    assert all(abs(want[s] - targets[s]) < 1e-6 * max(1, want[s]) for s in want)
    assert all(abs(taken[s] - want[s]) <= mixing.BLOCK_WORDS for s in want)
    assert all(r[2] == sizes[texts[r[0]][1]] for r in rows)


def test_odd_rows(spark, docs_of):
    df = docs_of([None, "", "a b c", "a b c", "d " * 500, "e"], [1, 2, 3, 3, None, 5], ["x", None, "x", "x", None, ""])
    rows = sorted(map(repr, mixing.mix(spark, df).select("doc_id", "size", "taken").collect()))
    assert len(rows) == 6
    assert mixing.mix(spark, docs_of([])).count() == 0
    assert mixing.mix(spark, docs_of(["", None])).select("taken", "target").collect() == [(0, 0.0)] * 2


def test_mixed_documents_hold_the_words_taken(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    out = mixing.mixed(spark, df)
    assert out.columns == df.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        assert r["n_chars"] == len(r["text"])
    for r in mixing.mix(spark, df).collect():
        assert got[r["doc_id"]] == r["taken"]


def test_a_hot_source_is_many_shards(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 16)
    texts = ["w " * (k % 60) for k in range(300)]
    sources = ["hot" if k % 3 else f"s{k % 5}" for k in range(300)]
    rows = mixing.mix(spark, docs_of(texts, sources=sources)).collect()
    total, target = defaultdict(int), {}
    for r in rows:
        total[sources[r["doc_id"]]] += r["taken"]
        target[sources[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(total[s] - target[s]) <= 64 for s in target)


def test_blocks_are_those_that_the_permutation_ranks_lowest(spark, docs_of):
    """Against a list of all words of a shard."""
    from pyspark.sql import functions as F

    texts = ["w " * (k * 37 % 113) for k in range(200)] + ["v " * 4000]
    sources = ["a"] * 200 + ["b"]
    df = docs_of(texts, sources=sources)
    rows = {r["doc_id"]: r for r in mixing.mix(spark, df, weights=(1, 1), share=0.6).collect()}
    order = [r[0] for r in df.where("source = 'a'").orderBy(F.xxhash64(F.lit(19), "doc_id"), "doc_id").select("doc_id").collect()]
    line = [(i, w) for i in order for w in range(rows[i]["size"])]
    seed = df.limit(1).select(F.xxhash64(F.lit(18), F.lit(False), F.lit("a"), F.lit(0))).first()[0]
    n = -(-len(line) // 32)
    got = sum(rows[i]["taken"] for i in order)
    passes, rest = divmod(got, len(line))
    a = next(x for x in (mixing.STEPS[seed % 5 :] + mixing.STEPS) if x % (n - 1)) % (n - 1)
    rank = {b: (a * b + seed) % (n - 1) for b in range(n - 1)} | {n - 1: n - 1}
    assert sorted(rank.values()) == list(range(n)) and got % 32 == 0 and abs(got - sum(r["size"] for r in rows.values()) * 0.6 / 2) <= 32
    want = defaultdict(set)
    for k, (i, w) in enumerate(line):
        if rank[k // 32] < rest // 32 or rank[k // 32] == rest // 32 and k % 32 < rest % 32:
            want[i].add(w)
    for i in order:
        assert rows[i]["passes"] == passes and {w for r in rows[i]["ranges"] for w in range(r["begin"], r["end"])} == want[i]
    # the blocks are spread over the shard
    chosen = sorted(b for b, r in rank.items() if r < rest // 32)
    assert sum(y - x > 1 for x, y in zip(chosen, chosen[1:])) > len(chosen) / 4


def test_mixed_keeps_columns_of_any_name(spark, docs_of):
    df = docs_of(["a b c " * 30, "d e " * 50, None], sources=["x", "y", None])
    for name in ("passes", "begins", "more", "partial", "ranges", "taken", "_take", "_take_", "take_id", "size.x"):
        df = df.withColumn(name, df.u)
    out = mixing.mixed(spark, df)
    assert out.columns == df.columns
    rows = out.collect()
    assert rows and all(r["_take"] == r["passes"] == r["size.x"] == 7 and r["size"] == "x" and r["n_chars"] == len(r["text"]) for r in rows)
    assert mixing.mixed(spark, df.limit(0)).count() == 0


def test_a_long_text_is_cut_at_blocks(spark, docs_of):
    df = docs_of([" ".join(f"w{k}" for k in range(100_000)), "x y"], sources=["a", "b"])
    rows = mixing.mixed(spark, df, weights=(1,), share=0.5).where("doc_id = 0").collect()
    words = [w for r in rows for line in r["text"].split("\n") for w in [line.split()]]
    assert all(int(b[1:]) - int(a[1:]) == 1 for w in words for a, b in zip(w, w[1:]))
