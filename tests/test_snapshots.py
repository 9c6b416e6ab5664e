import json
import random
from datetime import datetime, timedelta

from gleaner.operators.snapshots import snapshot_changes

SCHEMA = "snapshot_no int, delivered_at timestamp, program_key string, meta string, urls array<string>, extra string"
T = datetime(2026, 1, 1)


def brute(data):
    records = {}
    for no, at, key, meta, urls, _ in sorted(data, key=lambda r: r[1]):
        if key is not None:
            records.setdefault(no, {})[key] = (json.dumps(json.loads(meta), sort_keys=True) if meta is not None else None, {u for u in urls or [] if u is not None})
    out, numbers = set(), sorted(records)
    for a, b in zip(numbers, numbers[1:]):
        x, y = records[a], records[b]
        out |= {(b, k, "", "added") for k in y.keys() - x.keys()} | {(b, k, "", "removed") for k in x.keys() - y.keys()}
        for k in x.keys() & y.keys():
            if x[k][0] != y[k][0]:
                out.add((b, k, "", "changed"))
            out |= {(b, k, u, "added") for u in y[k][1] - x[k][1]} | {(b, k, u, "removed") for u in x[k][1] - y[k][1]}
    return out


def test_random_histories(spark, rows):
    rnd = random.Random(3)
    data, at = [], T
    for no in (1, 2, 4, 5):
        for key in "abcdef":
            for _ in range(rnd.choice([0, 1, 1, 2])):
                at += timedelta(minutes=1)
                meta = {"n": rnd.randint(0, 1), "t": "é"}
                text = json.dumps(meta, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1]))
                data.append((no, at, key, rnd.choice([text, text, None]), rnd.choice([None, rnd.sample(["u", "v", "w", None], 3) + ["u"]]), "x"))
    data.append((1, at, None, "{}", [], "x"))
    got = rows(snapshot_changes(spark.createDataFrame(data, SCHEMA)))
    assert set(got) == brute(data) and len(got) == len(set(got))


def test_empty_single_and_repeated(spark, rows):
    one = [(1, T, "k", '{"a": 1}', ["u"], None)] * 3
    assert rows(snapshot_changes(spark.createDataFrame(one, SCHEMA))) == []
    assert rows(snapshot_changes(spark.createDataFrame([], SCHEMA))) == []
    broken = [(1, T, "k", "{oops", ["u"], None), (2, T, "k", " {oops ", ["u"], None), (3, T, "k", "{", ["u"], None)]
    assert rows(snapshot_changes(spark.createDataFrame(broken, SCHEMA))) == [(3, "k", "", "changed")]
