"""Random tables: rules against plain Python, batches against full loads, history without gaps or overlaps."""

import random

import pytest

from lakeloom.operators import history, quality, silver
from lakeloom.specs import ForeignKey


def null_rule(rows, column):
    return sum(r[column] is None for r in rows)


def unique_rule(rows, key):
    return len(rows) - len({r[key] for r in rows})


def referential_rule(children, parents, live_parent):
    known = {p["id"] for p in parents if p["id"] is not None and not (live_parent and p["is_deleted"])}
    return sum(c["fk"] not in known for c in children if not c["is_deleted"])


def table(rnd, n, keys):
    return [{"id": rnd.choice([None, *range(keys)]), "fk": rnd.choice([None, *range(keys)]), "is_deleted": rnd.choice([None, True, False]),
             "updated_at": rnd.choice([None, 1, 2, 3]), "v": rnd.choice(["a", "b", None])} for _ in range(n)]


DDL = "id int, fk int, is_deleted boolean, updated_at int, v string"


@pytest.mark.parametrize("seed", range(4))
def test_rules(spark, seed):
    rnd = random.Random(seed)
    children, parents = table(rnd, rnd.choice([0, 1, 80]), 9), table(rnd, rnd.choice([0, 20]), 9)
    c, p = spark.createDataFrame(children, DDL), spark.createDataFrame(parents, DDL)
    assert quality.null_checks(c, "t", ["v"]).first().failed_rows == null_rule(children, "v")
    assert quality.unique_check(c, "t", ["id"]).first().failed_rows == unique_rule(children, "id")
    for live in (True, False):
        got = quality.referential_check(c, p, "t", ForeignKey("fk", "p", live), "id").first()
        assert got.failed_rows == referential_rule(children, parents, live)
        assert got.check_status == ("failed" if got.failed_rows else "passed")


@pytest.mark.parametrize("seed", range(3))
def test_batches_equal_a_full_load(spark, seed):
    rnd = random.Random(seed)
    one, two = (spark.createDataFrame(table(rnd, 60, 15), DDL) for _ in range(2))
    full = silver.latest(one.unionByName(two), ["id"])
    steps = history.upsert(silver.latest(one, ["id"]), two, ["id"])
    again = history.upsert(steps, two, ["id"])
    assert sorted(map(str, full.collect())) == sorted(map(str, steps.collect())) == sorted(map(str, again.collect()))


def test_versions_follow_each_other(spark):
    rnd = random.Random(5)
    rows = [r for r in table(rnd, 200, 12) if r["updated_at"] is not None]
    past = history.scd2(spark.createDataFrame(rows, DDL), ["id"], ["v", "fk"]).collect()
    by_key: dict = {}
    for r in past:
        by_key.setdefault(r.id, []).append(r)
    assert set(by_key) == {r["id"] for r in rows}
    for versions in by_key.values():
        versions.sort(key=lambda r: r.effective_from)
        assert [v.is_current for v in versions] == [False] * (len(versions) - 1) + [True]
        for a, b in zip(versions, versions[1:]):
            assert a.effective_to == b.effective_from and (a.v, a.fk) != (b.v, b.fk)
    assert len({r.surrogate_key for r in past}) == len(past)


@pytest.mark.parametrize("seed", range(2))
def test_as_of_against_every_version(spark, seed):
    rnd = random.Random(seed)
    rows = [{"k": rnd.choice([None, 1, 1, 1, 2, 3]), "at": rnd.choice([None, *range(40)]), "v": rnd.choice(["a", "b", None])} for _ in range(90)]
    past = history.scd2(spark.createDataFrame(rows, "k int, at int, v string"), ["k"], ["v"], "at")
    past = past.where("k IS NULL OR v IS NOT NULL OR effective_to IS NULL")  # with gaps
    facts = [(i, rnd.choice([None, 1, 1, 2, 3, 4]), rnd.choice([None, *range(-2, 45)])) for i in range(200)]
    got = history.as_of(spark.createDataFrame(facts, "id int, k int, at int"), past, "k", "at", ["v"])
    assert got.columns == ["id", "k", "at", "v"]
    versions = past.collect()

    def brute(k, at):
        if k is None or at is None:
            return None
        valid = [x.v for x in versions if x.k == k and x.effective_from is not None and x.effective_from <= at and (x.effective_to is None or at < x.effective_to)]
        assert len(valid) <= 1
        return valid[0] if valid else None

    assert sorted((r.id, r.v or "") for r in got.collect()) == [(i, brute(k, at) or "") for i, k, at in facts]
