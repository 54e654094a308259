"""A batch of catalog entries against taking them in one after the other."""

import random

import pytest

from quire.operators import policy

SCHEMA = "id long, external string, isbn string, title string, author string"
GOOD = ["0306406152", "0-19-853453-1", "9780306406157"]


def one_by_one(new, known):
    there = [(None, e, i, (t, a)) for _, e, i, t, a in known]
    out = []
    for n, e, i, t, a, force in sorted(new):
        key = (i or "").replace("-", "").strip() or None
        ta = (t, a)
        found = [("external-id", [r[0] for r in there if e and r[1] == e]), ("isbn", [r[0] for r in there if key and (r[2] or "").replace("-", "").strip() == key]), ("title-and-author", [r[0] for r in there if t and r[3] == ta])]
        signal, ids = next(((s, x) for s, x in found if x), (None, []))
        created = force or signal not in ("external-id", "isbn")
        dropped = bool(key) and i not in GOOD
        if created:
            there.append((n, e, None if dropped else i, ta))
        out.append((n, created, signal, None if None in ids or not ids else min(ids), created and dropped))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_batches(spark, seed):
    r = random.Random(seed)
    some = lambda n: (n, r.choice([None, "", *(f"e{i}" for i in range(12))]), r.choice([None, " ", *GOOD, "0306406153", "123"]), r.choice([None, "a", "b", "c", "d"]), r.choice(["x", "y"]))
    known, new = [some(i) for i in range(2)], [(*some(100 + i), r.random() < 0.1) for i in range(60)]
    # A chain through different keys: each entry is like the one before it alone.
    new += [(500 + i, f"c{i // 2}", None, f"t{i}", "z", False) if i % 2 else (500 + i, f"c{i // 2 - 1}" if i else None, None, f"t{i}", "z", False) for i in range(9)]
    got = policy.taken(spark.createDataFrame(new, SCHEMA + ", force boolean").repartition(3), spark.createDataFrame(known, SCHEMA))
    assert sorted(map(tuple, got.collect())) == one_by_one(new, known)


def test_no_entries(spark):
    none = spark.createDataFrame([], SCHEMA + ", force boolean")
    assert policy.taken(none, none.drop("force")).collect() == []
