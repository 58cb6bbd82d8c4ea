import hashlib
import random
import re
import time

import pytest

from quillspark.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def brute(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 24]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def made(seed):
    rnd = random.Random(seed)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", ":", "=", " ", "  ", '"', "'", "abc", "x", "AKIA", "AKIAB2", "0123456789abcdef", "deadbeef", "A1B2C3D4E5F6", "é", "\n", ",", "tok", "ghp_", "_", "-", "ſecret", "K"]
    return "".join(rnd.choice(parts) for _ in range(rnd.randrange(60)))


def test_spans_equal_regular_expressions():
    scanner = secrets.Scanner()
    texts = [made(k) for k in range(4000)] + ["secret: token: abcdefgh", "token==abcdef", 'token = "password: hunter22"', "AKIAAKIA" + "A" * 16, "password: secret: token=abc123", ""]
    for text, spans in zip(texts, scanner.scan(texts)):
        assert [s for s in spans if s[0] in ("assign", "access", "hex")] == brute(text), text


@pytest.mark.parametrize("part", ["secret: token: abcdefgh ", "secret: secret: ", "token=secret=", "token :   'secret ", "f", "AKIA", "é token: "])
def test_nested_triggers_take_time_in_proportion(part):
    scanner, took = secrets.Scanner(), []
    for size in (250_000, 1_000_000):
        text = part * (size // len(part))
        start = time.perf_counter()
        found = [s for s in scanner.scan([text])[0] if s[0] in ("assign", "access", "hex")]
        took.append(time.perf_counter() - start)
        assert found == brute(text)
    assert took[1] < 3 and took[1] < 12 * max(took[0], 0.05)


def test_any_nesting_equals_regular_expressions():
    rnd = random.Random(9)
    parts = ["secret", "token", "password", ":", "=", " ", "   ", '"', "abcdef", "x", "AKIA", "\n", "0123456789abcdef0123456789"]
    scanner = secrets.Scanner()
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(200))) for _ in range(3000)]
    for text, spans in zip(texts, scanner.scan(texts)):
        assert [s for s in spans if s[0] in ("assign", "access", "hex")] == brute(text), text


def test_many_rules_are_several_automata():
    rules = tuple(secrets.SecretRule(f"r{k}", f"key{k}q[a-z]+") for k in range(70))
    assert secrets.Scanner(rules).scan(["key3qabc key69qx"]) == [[("r3", 0, 8), ("r69", 9, 16)]]


def test_more_kinds():
    found = secrets.Scanner().scan(["xx ghp_" + "z1" * 18 + " -----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890-abcdefgh ghp_short"])
    assert [[k for k, _, _ in x] for x in found] == [["github", "private_key"], ["slack"]]


def test_rows(spark, docs_of, texts_of):
    texts = {**texts_of, -1: None, -2: "", -3: "é token=abcdefé " * 3, -4: "f" * 100_000}
    rows = secrets.find_secrets(docs_of(list(texts.values()), list(texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(secrets.spelled(spans).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        assert set(secrets.spelled(spans).split(",")) <= set(r["spans"].split(","))
    assert secrets.find_secrets(docs_of([])).count() == 0


def test_masking(spark, docs_of):
    df = docs_of(["a token=abcdef b", None, "clean", "token=" + "0" * 30])
    out = secrets.mask_secrets(df)
    assert out.columns == df.columns
    rows = out.orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["a [assign] b", None, "clean", "[assign]"]
    assert [r["n_chars"] for r in rows] == [12, None, 5, 8]


def test_automaton_is_minimal():
    auto = secrets.Automaton((secrets.SecretRule("a", "ab|cb"),), search=False)
    # start, after a or c, accepted, dead
    assert len(auto.table) == 4
