import zlib

import numpy as np
import pytest

from quillspark.llm import shards


def check(rows, texts, n=16):
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    load = np.zeros(n)
    for r in rows:
        load[r["shard"]] += r["size"]
    return load


def test_balance(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = shards.op10_sharding(spark, sf_dir).collect()
    load = check(rows, texts)
    assert load.max() < 1.02 * load.mean() and load.min() > 0.98 * load.mean()
    where = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(x) == 1 for x in where.values())


def test_a_hot_group_is_split(spark, docs_of):
    texts = ["same words again"] * 600 + [f"text {k}" for k in range(900)]
    load = check(shards.shard(spark, docs_of(texts)).collect(), texts)
    assert load.max() < 1.1 * load.mean()


def brute_place(items, shards, whole):
    """Item by item, shard by shard."""
    total = [sum(x[d] for x in items) for d in range(3)]
    load = [[x[d] / max(total[d] / shards, 1e-9) for d in range(3)] for x in items]
    free, out = [[1.0] * 3 for _ in range(shards)], {}
    for k in sorted(range(len(items)), key=lambda k: (-max(load[k]), k)):
        able = [s for s in range(shards) if k not in whole or all(free[s][d] >= load[k][d] - 1e-9 for d in range(3))]
        out[k] = max(able, key=lambda s: (sum(free[s][d] * load[k][d] for d in range(3)), -s)) if able else -1
        if able:
            free[out[k]] = [f - w for f, w in zip(free[out[k]], load[k])]
    return out


def test_placement_equals_brute_force():
    rng = np.random.default_rng(8)
    for n, shards_ in ((1, 3), (40, 4), (200, 7), (60, 60)):
        items = rng.integers(1, 1 << 16, (n, 3)).astype(float)
        whole = rng.random(n) < 0.3
        out, over = shards.place(items, shards_, whole)
        want = brute_place(items.tolist(), shards_, set(np.flatnonzero(whole).tolist()))
        assert dict(enumerate(out.tolist())) == want and over.tolist() == [want[k] < 0 for k in range(n)]


def where_of(rows, ids):
    return {r["shard"] for r in rows if r["doc_id"] in ids}


@pytest.mark.parametrize("n,copies,whole", [(16, 0.05, True), (16, 0.0624, True), (16, 0.07, False), (16, 0.34, False), (256, 0.01, False), (256, 0.003, True), (4, 0.24, True)])
def test_a_group_is_parted_only_if_no_shard_takes_it(spark, docs_of, n, copies, whole):
    total = 6000
    k = int(total * copies)
    texts = ["the same words"] * k + [f"some text {j:04}" for j in range(total - k)]
    rows = shards.shard(spark, docs_of(texts), n).collect()
    load = check(rows, texts, n)
    assert (len(where_of(rows, range(k))) == 1) == whole
    assert load.max() < 1.25 * load.mean()


def test_groups_that_no_longer_fit_are_parted(spark, docs_of):
    # three fill their shards, a fourth of the same size finds none with room
    texts = [f"copy {k}" for k in range(4) for _ in range(60)] + ["z"] * 5
    rows = shards.shard(spark, docs_of(texts), 3).collect()
    load = check(rows, texts, 3)
    sizes = sorted(len(where_of(rows, range(60 * k, 60 * k + 60))) for k in range(4))
    assert sizes[:3] == [1, 1, 1] and sizes[3] > 1 and load.max() < 1.1 * load.mean()


def test_cells_number_rows_without_gaps(spark, docs_of, monkeypatch):
    monkeypatch.setattr(shards, "CELL_ROWS", 8)
    texts = [f"t{k % 40}" for k in range(500)]
    check(shards.shard(spark, docs_of(texts)).collect(), texts)


def test_odd_rows(spark, docs_of):
    texts = [None, "", "é", "é", "x" * 1_000_000]
    rows = shards.shard(spark, docs_of(texts, [1, 2, 3, 3, None])).collect()
    check(rows, texts)
    assert sorted((r["size"], r["text_crc32"]) for r in rows)[:2] == [(1, 0), (1, 0)]
    assert shards.shard(spark, docs_of([])).count() == 0
