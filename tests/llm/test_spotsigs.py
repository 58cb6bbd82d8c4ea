import hashlib
import random
import re

from quillspark.llm import spotsigs


def edited(text, after):
    cut = len(text) // 3
    return text[: len(text) - cut] + after[:cut]


def test_edits_and_neighbours(spark, docs_of, texts_of, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 16)
    order = sorted(texts_of, reverse=True)
    rows = {r["doc_id"]: r for r in spotsigs.fingerprints(spark, docs_of([texts_of[i] for i in order], order)).collect()}
    assert len(rows) == len(order)
    for i, j in zip(order, order[1:] + order[:1]):
        r = rows[i]
        e = edited(texts_of[i], texts_of[j])
        assert r["n_chars"] == len(texts_of[i])
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        a, b = (set(x.split()) for x in (r["fingerprint"], r["edited_fingerprint"]))
        assert abs(r["near_edited"] - len(a & b) / len(a | b)) < 1e-12
        c = set(rows[j]["fingerprint"].split())
        true = len(a & c) / len(a | c)
        assert r["near_next"] == true
    long = [r for r in rows.values() if r["n_chars"] > 400]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.9 * len(long)


def test_equal_texts_have_equal_fingerprints(spark, docs_of):
    rows = spotsigs.fingerprints(spark, docs_of(["the cat sat on the mat", "x", "the cat sat on the mat"])).collect()
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[0] == prints[2] != prints[1]


def test_odd_rows(spark, docs_of):
    texts = [None, "", "...", "the of", "ok\u0001ok", "é" * 5000, "a b", "a b"]
    rows = spotsigs.fingerprints(spark, docs_of(texts, [3, 2, None, 4, 5, 6, 7, 7])).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 8
    assert by_id[3]["fingerprint"] == by_id[2]["fingerprint"] == ""
    assert by_id[3]["near_next"] == 1.0 and by_id[3]["n_chars"] == 0
    assert by_id[None]["fingerprint"] and by_id[4]["fingerprint"]
    one = spotsigs.fingerprints(spark, docs_of(["abc def"])).collect()[0]
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abc dab").hexdigest()
    assert spotsigs.fingerprints(spark, docs_of([])).count() == 0


def brute_print(text):
    """Word by word."""
    tokens = ["."] + re.findall(r"[^\W_]+|[.!?\r\n]+", text.lower())
    anchors, out, content, after = set(spotsigs.ANCHORS), set(), [], []
    fresh = False
    for w in tokens:
        if w in anchors or re.fullmatch(r"[.!?\r\n]+", w):
            fresh = True
        else:
            content.append(w)
            after.append(fresh)
            fresh = False
    for k, marked in enumerate(after):
        if marked:
            out.add(hashlib.md5(" ".join(content[k : k + 3]).encode()).hexdigest()[:8])
    if not content and text:
        out.add(hashlib.md5(text.encode()).hexdigest()[:8])
    return " ".join(sorted(out))


def test_signatures_equal_brute_force(spark, docs_of, texts_of):
    rnd = random.Random(7)
    parts = [*spotsigs.ANCHORS[:12], "cat", "dog", "mat", "Über", "x1", ".", "!?", "\n", ",", "-", "the", "the"]
    texts = [rnd.choice(["", " "]).join(rnd.choice(parts) + " " for _ in range(rnd.randrange(40))) for _ in range(400)] + list(texts_of.values())
    rows = spotsigs.fingerprints(spark, docs_of(texts)).collect()
    for r in rows:
        assert r["fingerprint"] == brute_print(texts[r["doc_id"]]), texts[r["doc_id"]][:200]


def test_ranges_hold_as_many_rows_whatever_the_ids(spark, docs_of, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 50)
    ids = [*range(1000), 10**18, -(10**18)]
    df = docs_of([f"text {i}" for i in ids], ids)
    rows, _ = spotsigs.with_neighbours(spark, df, "doc_id", "text")
    sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 150
    order = sorted(ids, reverse=True)
    nexts = {r["doc_id"]: r["next_text"] for r in rows.where("not ghost").collect()}
    assert nexts == {i: f"text {j}" for i, j in zip(order, order[1:] + order[:1])}


def test_near_pairs_equal_brute_force(spark):
    rnd = random.Random(3)
    sets = []
    for _ in range(40):
        base = {f"{rnd.randrange(1 << 32):08x}" for _ in range(rnd.randrange(1, 40))}
        for _ in range(4):
            sets.append(sorted((base | {f"{rnd.randrange(60):08x}"}) - set(rnd.sample(sorted(base), rnd.randrange(min(4, len(base)))))))
    sets += [[], sets[0], sets[0]]
    df = spark.createDataFrame(list(enumerate(sets)), "doc_id bigint, sigs array<string>")
    for t in (0.5, 0.8):
        pairs, members = spotsigs.near_pairs(df, t)
        found = {frozenset((r["a"], r["b"])): r["likeness"] for r in pairs.collect()}
        want = {}
        for x in {tuple(s) for s in sets if s}:
            for y in {tuple(s) for s in sets if s}:
                j = len(set(x) & set(y)) / len(set(x) | set(y))
                if x < y and j >= t:
                    want[frozenset((" ".join(x), " ".join(y)))] = j
        assert found == want and members.count() == len(sets)


def test_long_text(spark, docs_of):
    text = "the cat sat. " * 80_000
    for r in spotsigs.fingerprints(spark, docs_of([text, "x"])).where("doc_id = 0").collect():
        assert r["fingerprint"] == brute_print(text) and r["n_chars"] == len(text)
