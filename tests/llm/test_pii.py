import hashlib
import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import pii

CHARS = st.sampled_from(list("ab1234567890@.+- ()é%:=\n"))


def brute(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=2000, deadline=None)
@given(st.text(CHARS, max_size=60))
def test_base_spans(text):
    assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute(text)
    assert all(p >= 0 for *_, p in pii.candidates(text, pii.base_spans(text)))


def test_long_runs_stay_linear():
    pii.base_spans("a" * 300_000 + " " + "1" * 4000 + " " + "a@" * 100_000)


def test_report_and_redaction(spark):
    secret = "é x@y.example.com, 10.0.0.1 and 4111 1111 1111 1111, +1 (555) 555-0199; password=9f8e7d6c5b4a39281706"
    texts = [None, "", secret, "ratio: seldom and plain words", "note: " + "calm" * 20, 'token = "0641917ea4e9feb9cda83477"'] + [f"api_key={hashlib.md5(str(i).encode()).hexdigest()}" for i in range(20)] + [f"see: chapter{'x' * i}" for i in range(20)]
    docs = spark.createDataFrame([(i, t, "k", [1]) for i, t in enumerate(texts)] + [(2, secret, "k", [1]), (None, "a@b.co", "k", None)], "doc_id long, text string, base string, spans array<int>")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert got[0].spans == got[1].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(secret))
    assert got[2].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[2].spans.startswith(want)
    assert (got[2].n_email, got[2].n_ip, got[2].n_card, got[2].n_phone) == (1, 1, 1, 1)
    assert "secret" in got[2].spans and "secret" in got[5].spans and "secret" in got[8].spans
    assert got[3].spans == got[4].spans == got[30].spans == ""
    assert got[None].n_email == 1
    masked = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert masked[2].text == "é [EMAIL], [IP] and [CARD], [PHONE]; password=[SECRET]" and masked[0].text is None and masked[2].base == "k"


def test_long_secrets_are_masked_whole():
    value = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(10))[:400].replace("0", "/x")
    text = f"token={value} and more"
    found = pii.candidates(text, [])
    assert [(k, a, b) for k, a, b, _ in found] == [(4, 6, 6 + len(value))]
    assert pii.masked(text, frozenset(p for *_, p in found)) == "token=[SECRET] and more"
    pii.candidates("key=" + "a1" * 500_000, [])


def test_keys_of_any_length():
    key = "a_very_long_configuration_name_of_some_service_password"
    assert [(a, b) for _, a, b, _ in pii.candidates(f"{key}=abc123def456", [])] == [(len(key) + 1, len(key) + 13)]
    assert [(a, b) for _, a, b, _ in pii.candidates("__token=abc123def456 x.key: zzzzzz99", [])] == [(8, 20), (28, 36)]
    pii.candidates("a-" * 300_000 + "_" * 300_000 + "b" * 300_000, [])


def plain_em(votes, rounds=60):
    """Expectation-maximisation over single rows, by dictionaries: P(personal) of each."""
    p = [1 / (1 + math.exp(-2 * sum(v - 1 for v in row))) for row in votes]
    for _ in range(rounds):
        seen = {}
        for y in (0, 1):
            for j in range(len(votes[0])):
                n = [1 + sum(q if y else 1 - q for q, row in zip(p, votes, strict=True) if row[j] == v) for v in range(3)]
                seen.update({(y, j, v): n[v] / sum(n) for v in range(3)})
        prior = (1 + sum(p)) / (2 + len(p))
        like = [[math.log(b) + sum(math.log(seen[y, j, v]) for j, v in enumerate(row)) for y, b in ((0, 1 - prior), (1, prior))] for row in votes]
        p = [1 / (1 + math.exp(a - b)) for a, b in like]
    return p


def test_reliabilities_against_plain_em():
    rng = random.Random(6)
    truth = [rng.random() < 0.3 for _ in range(300)]
    votes = [[(2 if t == (rng.random() < sure) else 0) if rng.random() < 0.8 else 1 for sure in (0.95, 0.9, 0.8, 0.55)] for t in truth]
    different = sorted(set(map(tuple, votes)))
    counts = [sum(tuple(v) == d for v in votes) for d in different]
    p, table, prior = pii.reliabilities(np.array(different), np.array(counts, float))
    own = dict(zip(different, p, strict=True))
    assert max(abs(own[tuple(v)] - q) for v, q in zip(votes, plain_em(votes), strict=True)) < 1e-6
    assert sum((own[tuple(v)] > 0.5) == t for v, t in zip(votes, truth, strict=True)) > 0.9 * len(votes) and 0.2 < prior < 0.4
    assert table[1, 0, 2] > table[1, 3, 2]  # the surer labeler counts as the more reliable one


def test_added_spans_on_labelled_texts(spark):
    """Planted credentials are found and plain values left alone: precision and recall of the method's own spans."""
    rng = random.Random(8)
    rows, want = [], set()
    for i in range(600):
        if i % 3 == 0:
            key, value = rng.choice(["password", "api_key", "token", "secret"]), "".join(rng.choice("abcdef0123456789") for _ in range(rng.randrange(18, 40)))
            text = f"Set {key}={value} first."
            want.add((i, text.index(value), text.index(value) + len(value) + 1))
        elif i % 3 == 1:
            text = f"The chapter: {rng.choice(['introduction', 'gardening', 'afterwards'])} is long."
        else:
            text = f"Mode={rng.choice(['default', 'advanced', 'simple'])} was chosen."
        rows.append((i, text))
    got = {(r.doc_id, int(a), int(b)) for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect() for _, a, b in (s.split(":") for s in r.spans.split(",") if s)}
    near = {(i, a) for i, a, _ in want}
    assert len({(i, a) for i, a, _ in got} & near) > 0.97 * len(near) and len(got) <= 1.03 * len(near)


def test_every_form_of_a_secret_is_masked_whole(spark):
    """Signs in values, blanks around the sign, quotes around keys and values, digits in keys, schemes; beside clean texts."""
    rng = random.Random(11)
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    forms = [
        lambda: (some(letters, 6) + some("23456789", 3) + "!!x" + some("23456789", 2), "password = {} and so on"), lambda: (some(letters, 8) + some("0123456789", 8), '{{"api_key": "{}", "n": 3}}'),
        lambda: (some("0123456789abcdef", 32), "api_key={}"), lambda: ("p@ss" + some(letters, 3) + "!9" + some("0123456789", 3) + "Xy", "key1={}, then more"), lambda: (some(letters, 9) + some("0123456789", 5), "secret  =  '{}'"),
        lambda: (some(letters + "0123456789", 40) + "." + some(letters + "0123456789", 40) + "9a", "Authorization: Bearer {}\nnext"), lambda: (f"{some(letters, 5)} {some(letters, 5)} {some('0123456789', 4)}", 'db_password: "{}"'),
        lambda: (some(letters, 9) + some("0123456789", 4), "see https://x.example.org/a?token={} there"), lambda: (f"{some(letters, 4)}9@mail.example.org7#{some('0123456789', 4)}", "password={} end"),
    ]
    secrets = [form() for _ in range(60) for form in forms]
    rows = [(i, "The text before it: " + form.format(secret) + " goes on.") for i, (secret, form) in enumerate(secrets)]
    clean = ["The chapter: introduction is long.", "He said: \"I will go there tomorrow\" and went.", "Mode=default was chosen.", "At 12:30:45 it rained.", "see https://x.example.org/path/to/page for more", "ratio: 12345678 or so", "a = b and c := d"]
    rows += [(1000 + k, clean[k % len(clean)]) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    left = [got[i] for i, (secret, _) in enumerate(secrets) if any(part in got[i] for part in (secret[k : k + 4] for k in range(0, len(secret) - 3)))]
    assert not left, left[:5]
    assert sum(got[i] == t for i, t in rows if i >= 1000) >= 0.98 * 700
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    for i, (secret, _) in enumerate(secrets):
        at = rows[i][1].index(secret)
        assert f"secret:{at}:{at + len(secret)}" in spans[i].split(",")


def test_many_keys_stay_linear():
    for text in ("a1=" * 300_000, 'a1="' * 200_000, "a1=://" * 200_000, "a1 = \t" * 200_000, "a1='\n" * 200_000):
        pii.candidates(text, [])


def test_very_long_text_and_repeats(spark):
    text = "word " * 200_000 + "mail a@b.example.org or token=0641917ea4e9feb9cda83477ff now " * 20
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = pii.report(docs).collect()
    assert len({(r.n_email, r.base_sha256, r.spans) for r in got}) == 1 and got[0].n_email == 20


def test_empty(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
