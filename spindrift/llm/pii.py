"""Personal data: base patterns, and weak supervision for what they miss.

Base spans are e-mail and IP addresses, card numbers and telephone numbers, by
their patterns and checks.  Beside them every text is searched for candidates:
values that look like credentials or like telephone numbers without a country
code.  Four labelers vote on each (for, against or not at all): a regular
expression for the value's form, a gazetteer of words before it, the signs
around it, and the mix of its characters.

How often each pattern of votes and features occurs is counted over all
documents; there are a few thousand possible patterns, so the driver may hold
the counts.  Expectation-maximisation estimates from them how reliable each
labeler is, and its posteriors train a logistic span classifier on votes and
features; spans it accepts are added.

Defined results: a null text counts as empty and has no spans; rows are judged
one by one, so ties and repeats get equal results; null ids stay null; without
candidates nothing is added; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import bounded_batches, numbered_columns, stage, tidy
from spindrift.llm.labelled import Adam, sigmoid

#: Kinds of spans in the order in which they sort; the last two are the method's own.
KINDS = ["email", "ip", "card", "phone", "secret", "number"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits, as it would have begun with the run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What stands before a value: a key, perhaps in quotes, a sign, perhaps how it authorises, perhaps a quote.
_ASSIGNED = re.compile(r"(?<![\w-])[_-]*+([A-Za-z][A-Za-z0-9_-]++)[\"']?[\x20\t]*+(=>|:=|[=:])[\x20\t]*+(?:(?:Bearer|Basic|Token)[\x20\t]++)?([\"']?)")
_LINE, _BLANK = re.compile(r"[\n\r]"), re.compile(r"\s")
#: Characters that end a value's sentence or brackets rather than the value (fixed values).
_AFTER = ",;.)]}>\"'"
#: The least length of a value.
_SHORTEST = 6
#: Digits in groups as in telephone numbers.
_GROUPED = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
#: Words that announce credentials or telephone numbers (fixed values).
GAZETTEER = {
    "secret": ["password", "passwd", "pwd", "pass", "secret", "token", "apikey", "api_key", "api-key", "key", "access_key", "auth", "authorization", "bearer", "credential", "login", "contraseña", "clave", "passwort", "kennwort", "geheimnis", "mot_de_passe", "jeton"],
    "number": ["phone", "tel", "telephone", "mobile", "cell", "call", "fax", "contact", "teléfono", "móvil", "llame", "telefon", "handy", "anruf", "téléphone", "portable", "appelez"],
}
_LISTED = {k: frozenset(v) for k, v in GAZETTEER.items()}
_WORD = re.compile(r"[^\W\d_]+(?:[_-][^\W\d_]+)*")
_STRONG = re.compile(r"[0-9a-f]{16,}|[A-Z0-9]{16,}|(?=[^.]*[0-9])(?=[^.]*[A-Za-z])[A-Za-z0-9+/_-]{20,}")
LABELERS = 4
ACCEPT = 0.5
SCHEMA = "doc_id long, base array<struct<kind:int,start:int,stop:int>>, more array<struct<kind:int,start:int,stop:int,pattern:int>>"


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the four base kinds, each found from left to right without overlap."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((0, start, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def _votes(kind: int, text: str, start: int, stop: int, key: str, sure: bool) -> int:
    """The pattern: four votes (0 against, 1 none, 2 for), then the value's length and its share of digits, in steps, then the kind.

    ``sure``: a quoted value, or one after a sign that assigns."""
    value, listed = text[start:stop], _LISTED[KINDS[kind]]
    before = _WORD.findall(text[max(0, start - 40) : start])[-3:]
    near = {w.lower() for w in before} | _names(key)
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    if kind == 4:
        blank = any(c.isspace() for c in value)
        every = 0 < digits and 0 < letters and digits + letters < len(value) and not blank
        address = "://" in value or value[0] in "/.#"
        form = 0 if value.isalpha() or address else 2 if _STRONG.fullmatch(value) or every and len(value) >= 8 else 1
        signs = 2 if sure else 1
        mix = 2 if digits >= 3 and letters >= 3 or every else 0 if not digits or not letters else 1
    else:
        form = 2 if value[0] == "(" or "-" in value else 1
        signs = 2 if text[start - 1 : start] == ":" or text[start - 2 : start] == ": " else 1
        mix = 2 if len(set(value) - set("() .-")) >= 4 else 0
    gazetteer = 2 if near & listed else 1 if kind == 5 else 0
    step = min(4, len(value) // 8)
    share = min(3, 4 * digits // len(value))
    code = 0
    for v in (form, gazetteer, signs, mix):
        code = 3 * code + v
    return ((code * 5 + step) * 4 + share) * 2 + kind - 4


def _names(key: str) -> set[str]:
    """A key, and the words it is made of, without digits at their ends."""
    whole = key.lower()
    return {w.strip("0123456789") for w in (whole, *re.split("[_-]", whole))} - {""}


class _Ahead:
    """Where something next occurs in a text, looked for once however often it is asked in order."""

    def __init__(self, text: str, what):
        self.text, self.what, self.at = text, what, -1

    def after(self, start: int) -> int:
        if self.at < start:
            m = self.what.search(self.text, start)
            self.at = m.start() if m else len(self.text)
        return self.at


_ADDRESS = re.compile("://")


def _assigned(text: str) -> list[tuple[int, int, int, str, bool]]:
    """(start, end, kind, key, sure) of values that a key announces: to the closing quote, or without one to white space."""
    out, last = [], 0
    line, blank, address = _Ahead(text, _LINE), _Ahead(text, _BLANK), _Ahead(text, _ADDRESS)
    for m in _ASSIGNED.finditer(text):
        start, quote = m.end(), m[3]
        if out and m.start() == out[-1][0] and not out[-1][4] and not _names(out[-1][3]) & _LISTED["secret"]:
            last = out.pop()[0]  # what follows a colon is a key of its own
        if start < last:
            continue
        stop = text.find(quote, start, line.after(start)) if quote else -1
        closed = stop >= 0
        if not closed:
            stop = blank.after(start)
            # An address is no value, but what it hands over may be one.
            if text.startswith("//", start) or address.after(start) < stop:
                continue
            while stop > start and text[stop - 1] in _AFTER:
                stop -= 1
        if stop - start >= _SHORTEST:
            out.append((start, stop, 4, m[1], closed or "=" in m[2]))
            last = stop
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, pattern) of candidates that don't touch each other, nor base spans; a value whose key is listed may reach beyond these."""
    found = _assigned(text) if "=" in text or ":" in text else []
    for m in _GROUPED.finditer(text):
        found.append((*m.span(), 5, "", False))
    if not found:
        return []
    taken = sorted((s, e) for _, s, e in base)
    out, last, k = [], 0, 0
    for start, stop, kind, key, sure in sorted(found):
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        free = k == len(taken) or taken[k][0] >= stop
        beyond = not free and kind == 4 and (taken[k][0] > start or taken[k][1] < stop) and bool(_names(key) & _LISTED["secret"])
        if start >= last and (free or beyond):
            out.append((kind, start, stop, _votes(kind, text, start, stop, key, sure)))
            last = stop
    return out


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans and the candidates of every document."""

    def run(batches):
        kinds = ["kind", "start", "stop", "pattern"]
        for batch in batches:
            base = [base_spans(t or "") for t in batch.column("text").to_pylist()]
            more = [candidates(t or "", b) for t, b in zip(batch.column("text").to_pylist(), base, strict=True)]
            lists = [pa.array([[dict(zip(kinds, s, strict=False)) for s in x] for x in col], pa.list_(pa.struct([(n, pa.int32()) for n in kinds[:width]]))) for col, width in ((base, 3), (more, 4))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "base", "more"])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)


def _decode(pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind, rest = pattern % 2, pattern // 2
    share, rest = rest % 4, rest // 4
    step, code = rest % 5, rest // 5
    votes = np.stack([code // 27, code // 9 % 3, code // 3 % 3, code % 3], axis=1)
    return votes, np.stack([kind, step, share], axis=1)


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation: P(personal) of each row of votes; P(vote | class) by labeler; the prior.

    It starts from the labelers' majority."""
    p = sigmoid(2.0 * (votes - 1).sum(axis=1))
    for _ in range(rounds):
        table = np.empty((2, votes.shape[1], 3))
        for y, q in enumerate((1 - p, p)):
            for j in range(votes.shape[1]):
                n = np.bincount(votes[:, j], q * counts, 3) + [1, 1, 1]
                table[y, j] = n / n.sum()
        prior = (1 + (p * counts).sum()) / (2 + counts.sum())
        like = [np.log(table[y, np.arange(votes.shape[1]), votes]).sum(axis=1) for y in (0, 1)]
        p = sigmoid(like[1] - like[0] + np.log(prior / (1 - prior)))
    return p, table, float(prior)


def train(found: DataFrame) -> list[int]:
    """The patterns whose spans the classifier accepts; ``found`` comes from :func:`find`, read from a table."""
    rows = found.select(F.explode("more.pattern").alias("pattern")).groupBy("pattern").count().collect()  # bounded by the patterns there are
    if not rows:
        return []
    pattern = np.array([r["pattern"] for r in rows])
    counts = np.array([r["count"] for r in rows], float)
    votes, extra = _decode(pattern)
    accepted = []
    for kind in (0, 1):
        own = extra[:, 0] == kind
        if not own.any():
            continue
        p, _, _ = reliabilities(votes[own], counts[own])
        x = np.concatenate([np.eye(3)[votes[own]].reshape(own.sum(), -1), np.eye(5)[extra[own, 1]], np.eye(4)[extra[own, 2]], np.ones((own.sum(), 1))], axis=1)
        w, adam, n = np.zeros(x.shape[1]), Adam(0.05), counts[own] / counts[own].sum()
        for _ in range(500):
            adam.step(w=(w, x.T @ (n * (sigmoid(x @ w) - p)) + 1e-4 * w))
        accepted += pattern[own][sigmoid(x @ w) >= ACCEPT].tolist()
    return sorted(accepted)


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id; base and all: arrays of (kind, start, stop) by code points, the end exclusive."""
    found = stage(find(docs), "spans")
    accepted = F.array(*[F.lit(p) for p in train(found)]).cast("array<int>")
    added = F.filter("more", lambda s: F.array_contains(accepted, s["pattern"]))
    added = F.transform(added, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return found.select("doc_id", "base", F.concat("base", added).alias("all"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256, spans."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return spans(docs).select("doc_id", n(0), n(1), n(2), n(3), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def masked(text: str, accepted: frozenset[int]) -> str:
    """The text with the name of its kind in place of every span; overlapping spans become one."""
    base = base_spans(text)
    found = sorted([(s, e, k) for k, s, e in base] + [(s, e, k) for k, s, e, p in candidates(text, base) if p in accepted])
    out, at = [], 0
    for start, stop, kind in found:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all personal data in ``text`` masked; its other columns are as they were."""
    accepted = docs.sparkSession.sparkContext.broadcast(frozenset(train(stage(find(docs), "spans"))))

    def run(batches):
        for batch in batches:
            texts = pa.array([t if t is None else masked(t, accepted.value) for t in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, batch.schema.names[at], texts)

    at, held = docs.columns.index("text"), numbered_columns(docs)
    return held.mapInArrow(tidy(run), held.schema).toDF(*docs.columns)
