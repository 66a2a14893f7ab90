import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from spindrift.llm import rolling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, time long"


def brute(rows):
    """Every window by itself."""
    at = {}
    for r in rows:
        d = r["doc_id"]
        at[id(r)] = None if d is None else 60 * ((d + zlib.crc32(str(d).encode()) % 10_000) // 6)
    out = []
    for r in rows:
        for w in (600, 43_200):
            t = at[id(r)]
            own = [] if t is None else [o for o in rows if at[id(o)] is not None and o["source"] == r["source"] and t - w <= at[id(o)] < t]
            n = sorted(len(o["text"]) for o in own if o["text"] is not None)
            pick = lambda p, q: n[-(-p * len(n) // q) - 1] if n else None  # noqa: E731,B023
            out.append((r["doc_id"], w, t, len(own), sum(n), len({o["lang"] for o in own} - {None}), pick(1, 2), pick(9, 10)))
    return sorted(out, key=str)


def documents(rng, n):
    rows = []
    for k in range(n):
        text = [None, "", "x" * int(rng.integers(0, 40)), "ñ" * int(rng.integers(0, 2000))][rng.choice(4, p=[0.1, 0.1, 0.4, 0.4])]
        rows.append({"doc_id": k * 7, "text": text, "lang": rng.choice(["en", "fr", "es", "de", None]), "source": rng.choice(["a", "a", "b", "=", "", None]), "n_chars": 3, "grp": "g", "time": 5})
    rows += [dict(rows[0]), dict(rows[0]), dict(rows[1], text="other"), dict(rows[2], doc_id=None), dict(rows[3], doc_id=-5), dict(rows[3], doc_id=-11)]
    return [{k: None if v is None else v if isinstance(v, int) else str(v) for k, v in r.items()} for r in rows]


@pytest.mark.parametrize("task_rows", [rolling.TASK_ROWS, 40])
def test_windows_equal_brute_force(spark, task_rows):
    """Null and repeated rows, ties, null groups, clashing names; with small tasks, ranges are halved in Spark."""
    rows = documents(np.random.default_rng(5), 400)
    df = spark.createDataFrame([Row(**r) for r in rows], SCHEMA)
    got = [tuple(r) for r in rolling.windows_of_documents(df, task_rows=task_rows).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_hot_time(spark):
    """Many rows of one time and one id."""
    rows = [{"doc_id": 3, "text": "x" * k, "lang": f"l{k % 3}", "source": "a"} for k in range(300)] + [{"doc_id": k, "text": "yy", "lang": "l0", "source": "a"} for k in range(0, 30_000, 100)]
    df = spark.createDataFrame([Row(**r) for r in rows], "doc_id long, text string, lang string, source string")
    got = [tuple(r) for r in rolling.windows_of_documents(df, task_rows=100).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_and_out_of_range(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert rolling.windows_of_documents(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(2**63 - 1, "a", "en", "s"), (None, "a", "en", "s")], schema)
    assert {tuple(r)[1:] for r in rolling.windows_of_documents(df).collect()} == {(w, None, 0, 0, 0, None, None) for w in (600, 43_200)}


def test_select_is_exact():
    rng = np.random.default_rng(0)
    time, value, times = rng.integers(0, 50, 300), rng.integers(-20, 20, 300), rng.integers(1, 4, 300)
    for _ in range(200):
        a, b = sorted(rng.integers(0, 51, 2))
        own = np.sort(np.repeat(value, times)[np.isin(np.repeat(time, times), np.arange(a, b))])
        if len(own):
            rank = rng.integers(1, len(own) + 1)
            assert rolling.select(time, value, times, np.array([a]), np.array([b]), np.array([rank]))[0] == own[rank - 1]
