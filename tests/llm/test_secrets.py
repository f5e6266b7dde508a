import hashlib
import os
import random
import re
import string
import time

import pytest

from tidewater.llm import secrets as S

pytestmark = pytest.mark.skipif(not os.path.exists(S.VOCABULARY), reason="no vocabulary file")


def brute(text):
    out = []
    for kind, pattern, least in ((0, r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6), (1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        for m in re.finditer(pattern, text, re.IGNORECASE | re.ASCII if kind == 0 else 0):
            if len(m[2] if kind == 0 else m[0]) >= least:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_by_brute_force():
    random.seed(5)
    parts = ["token", "PassWord", "api_key", "apikey", '"', "'", " ", ":", "=", "abc", "a1b2c3", "AKIA", "AKIA" + "Z9" * 9, "f" * 23, "0" * 24, "é", "ſecret", "toKen", "\n", "secret=", "passwd: "]
    for _ in range(3000):
        text = "".join(random.choices(parts, k=random.randint(0, 14)))
        assert S.base_spans(text) == brute(text)


def test_random_strings_are_found_and_names_are_not():
    random.seed(6)
    for n in (24, 32, 40):
        found = sum(bool(S.secret_spans("see " + "".join(random.choices(string.ascii_letters + string.digits, k=n)) + " here")) for _ in range(100))
        assert found >= 95
    for name in ("getUserAccountByIdentifier2024", "some_long_variable_name_v2_final", "123e4567-e89b-12d3-a456-426614174000", "D41D8CD98F00B204E9800998ECF8427E", "2024-01-01T00-00-00-000", "word " * 30):
        assert S.secret_spans(name) == []


def test_random_strings_joined_to_words_are_found():
    random.seed(7)
    for before, after in (("/download/files/archive/", ""), ("customer-account-signature=", ""), ("client-credential=", "/download/archive"), ("0123456789abcdef" * 2 + "/", "")):
        for n, least in ((20, 90), (24, 90), (32, 95)):
            keys = ["".join(random.choices(string.ascii_letters + string.digits, k=n)) for _ in range(100)]
            spans = [S.secret_spans(f"see {before}{key}{after} here") for key in keys]
            assert sum(any(kind == 3 and s <= 4 + len(before) and e >= 4 + len(before) + n for s, kind, e in found) for found in spans) >= least
    for name in ("/download/files/archive/customer/accounts/signature/123e4567-e89b-12d3-a456-426614174000/view", "/download/files/archive/customer/accounts/signature/D41D8CD98F00B204E9800998ECF8427E/view", "/download/files/archive/customer/accounts/2024-01-01/v1/a/b/c-d/index"):
        assert S.secret_spans(name) == []


def test_random_letters_are_found_and_words_are_not():
    random.seed(9)
    for n, least in ((24, 80), (32, 90), (48, 95)):
        found = sum(bool(S.secret_spans("see " + "".join(random.choices(string.ascii_letters, k=n)) + " here")) for _ in range(100))
        assert found >= least
    for name in ("thononinganderythationshalye", "AbstractSingletonProxyFactoryBean", "INTERNATIONALIZATIONSUPPORT", "getHTTPResponseCodeFromServer", "DonaudampfschifffahrtsGesellschaft"):
        assert S.secret_spans(name) == []


def plain_spans(text):
    """The method's rule, piece by piece and without its shortcuts; base spans by brute()."""
    encode = S.encoding(S.VOCABULARY).encode_ordinary

    def random_string(s):
        s = s.strip("=")
        digits, large, small = (sum(f(c) for c in s) for f in (str.isdigit, str.isupper, str.islower))
        if len(s) < 20 or large + small < 4 or not digits and min(large, small) < 4:
            return False
        if len(s) in (32, 40, 56, 64, 96, 128) and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) or S._identifier(s):
            return False
        return len(s) / len(encode(s)) < (1.9 if digits else 1.7)

    base = brute(text)
    out = list(base)
    for run in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        touching = [(s, e) for s, _, e in base if s < run.end() and e > run.start()]
        if not touching and random_string(run[0]):
            out.append((run.start(), 3, run.end()))
            continue
        uuid = r"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])"
        closed = touching + [m.span() for m in re.compile(uuid).finditer(text, run.start(), run.end())]
        pieces = [m.span() for m in re.compile("[A-Za-z0-9]+").finditer(text, run.start(), run.end())]
        barred = [any(s < b and e > a for s, e in closed) or bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text[a:b])) and b - a in (32, 40, 56, 64, 96, 128) for a, b in pieces]
        marks = set()
        for i, (a, _) in enumerate(pieces):
            for j in range(i, len(pieces)):
                b = pieces[j][1]
                inner = sum(y - x for x, y in pieces[i : j + 1])
                ends = all(not text[x:y].isdigit() and not S._identifier(text[x:y]) for x, y in (pieces[i], pieces[j]))
                if not any(barred[i : j + 1]) and ends and b - a >= 20 and (i == j or b - a <= 96) and 8 * (b - a - inner) <= b - a and random_string(text[a:b]):
                    marks |= set(range(a, b))
        spots = sorted(marks)
        for k, at in enumerate(spots):
            if k == 0 or spots[k - 1] != at - 1:
                end = k
                while end + 1 < len(spots) and spots[end + 1] == spots[end] + 1:
                    end += 1
                out.append((at, 3, spots[end] + 1))
    return sorted(out)


def test_all_spans_by_brute_force():
    random.seed(10)
    key = lambda: "".join(random.choices(string.ascii_letters + string.digits, k=random.randint(4, 30)))
    fixed = ["archive", "/", "/", "-", "_", "=", " ", "123e4567-e89b-12d3-a456-426614174000", "2024", "d41d8cd98f00b204e9800998ecf8427e", "token=abcdef12", "AKIA" + "Q7" * 10, "signature", "é", "A1b2C3d4E5"]
    for _ in range(1500):
        text = "".join(key() if random.random() < 0.4 else random.choice(fixed) for _ in range(random.randint(0, 12)))
        assert S.secret_spans(text) == plain_spans(text), text


def test_long_texts_with_many_secrets_take_linear_time():
    random.seed(11)
    for joint in (" and a plain sentence. ", "/", "_x-"):
        text = joint.join("token='%s%030x'" % ("Zq7", random.getrandbits(120)) for _ in range(20_000))
        began = time.perf_counter()
        assert len(S.secret_spans(text)) >= 20_000
        assert time.perf_counter() - began < 20
    assert S.secret_spans("a" * 3_000_000) == [(0, 2, 3_000_000)]
    began = time.perf_counter()
    S.secret_spans("aB" * 500_000)
    assert time.perf_counter() - began < 20


def test_digest_and_redaction(spark, odd_docs):
    text = "é token = 'abcdef1' and " + "a" * 30
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in S.digest_columns(S.scan(rows)).collect()}
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"]) == (1, 0, 1) and got[1]["spans"] == "assign:2:18,hex:24:54"
    assert got[1]["base_sha256"] == hashlib.sha256(b"assign:2:18,hex:24:54").hexdigest() and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() == got[3]["base_sha256"]
    clean = {r["doc_id"]: r["text"] for r in S.redact(rows).collect()}
    assert clean == {1: "é [SECRET]' and [SECRET]", 2: None, 3: ""}
    assert {r["Text"] for r in S.redact(rows.withColumnRenamed("text", "Text")).collect()} == set(clean.values())
    assert S.scan(odd_docs).count() == odd_docs.count() and S.scan(odd_docs.limit(0)).count() == 0


def test_a_run_of_many_short_pieces_takes_linear_time():
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        S.secret_spans("ab-cd-" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1
