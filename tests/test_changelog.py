"""The log of changes: the latest version counts, and a job that dies at any step leaves a readable table. The store on it."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_sources import NOW, assistant, user
from tracelake.operators import reports
from tracelake.plans.api import Store, bootstrap
from tracelake.sources import changelog
from tracelake.sources.changelog import Log

KIND = "id string, v int, w string"


@pytest.fixture
def log(spark, tmp_path):
    spark.sql("DROP DATABASE IF EXISTS log_test CASCADE")
    spark.sql(f"CREATE DATABASE log_test LOCATION 'file://{tmp_path}/db'")
    spark.sql(f"CREATE TABLE log_test.t ({KIND}) USING parquet")
    Log.create(spark, "log_test.t", KIND)
    yield Log(spark, "log_test.t", "id")
    spark.sql("DROP DATABASE log_test CASCADE")


def state(log, upto=None):
    return sorted((tuple(r) for r in log.read(upto).collect()), key=repr)


def test_against_a_dictionary(spark, log):
    dice, known, then = random.Random(3), {}, {}
    assert state(log) == [] and log.last() == 0
    for step in range(1, 7):
        some = dice.sample(sorted(known), len(known) // 2)
        rows = {k: dice.choice([None, dice.randrange(9)]) for k in some} if some and step % 2 == 0 else {f"k{step}.{i}": i for i in range(5)}
        number = (log.change if some and step % 2 == 0 else log.insert)(spark.createDataFrame([(k, v, "x" * step) for k, v in rows.items()], KIND))
        known |= {k: (k, v, "x" * step) for k, v in rows.items()}
        then[number] = sorted(known.values(), key=repr)
        assert state(log) == then[number]
        if step == 4:
            assert [state(log, n) for n in log.numbers()] == [then[n] for n in log.numbers()]
            log.compact()
            assert log.numbers() == [] and log.last() == number and state(log) == then[number]
    log.insert(spark.createDataFrame([(None, 1, "a"), (None, 2, None)], KIND))  # no key: rows of their own
    log.change(spark.createDataFrame([], KIND))
    assert len(state(log)) == len(known) + 2
    log.change(spark.createDataFrame([("k1.0", 1, "a"), ("k1.0", 2, "a")], KIND))  # a key twice in a change: the greatest row
    assert [r for r in state(log) if r[0] == "k1.0"] == [("k1.0", 2, "a")]
    log.vacuum()
    assert len(state(log)) == len(known) + 2


def test_inserted_rows_are_not_shuffled(spark, log):
    log.insert(spark.createDataFrame([("a", 1, "x")], KIND))
    assert "Exchange" not in log.read()._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("job", ["change", "compact", "replace"])
def test_dying_at_any_step(spark, log, job, monkeypatch):
    rows = lambda *r: spark.createDataFrame(list(r), KIND)
    log.insert(rows(("a", 1, "x"), ("b", 2, "x")))
    log.change(rows(("a", 5, "y")))
    before = state(log)
    after = {"change": [("a", 5, "y"), ("b", 9, "z")], "compact": before, "replace": [("n", 0, "n")]}[job]
    run = {"change": lambda: log.change(rows(("b", 9, "z"))), "compact": log.compact, "replace": lambda: log.replace(rows(("n", 0, "n")))}[job]
    real, died = type(spark).sql, 0
    for step in range(50):
        seen = [0]

        def sql(self, text, *more, seen=seen, step=step, **kind):
            if text.startswith("ALTER"):
                seen[0] += 1
                if seen[0] > step:
                    raise RuntimeError("killed")
            return real(self, text, *more, **kind)

        monkeypatch.setattr(type(spark), "sql", sql)
        try:
            run()
            break
        except RuntimeError:
            died += 1
            assert state(log) in (before, after)
        finally:
            monkeypatch.setattr(type(spark), "sql", real)
    assert died >= 1 and state(log) == after
    assert log.vacuum() >= 1 and state(log) == after  # what the dead jobs wrote goes


def test_store_rolls_and_changes(spark, tmp_path):
    spark.sql("DROP DATABASE IF EXISTS rolled_test CASCADE")
    spark.sql(f"CREATE DATABASE rolled_test LOCATION 'file://{tmp_path}/db'")
    bootstrap(spark, "rolled_test")
    bootstrap(spark, "rolled_test")
    s, now = Store(spark, "rolled_test"), NOW + reports.DAY_MS

    def equal():
        full, rolled = s.monitor(now), s.monitor(now, rolled=True)
        for name in ("drift", "shifts", "quality"):
            assert sorted(map(str, full[name].collect())) == sorted(map(str, rolled[name].collect())), name

    for part in range(2):
        folder = tmp_path / f"in{part}"
        folder.mkdir()
        for k in range(3):
            text = ("fix the python traceback error in module " if part else "refund the invoice payment of customer ") + str(k)
            (folder / f"s{part}{k}.jsonl").write_text(user(text) + "\n" + assistant(f"a{part}{k}") + "\n")
        assert s.ingest(str(folder), NOW)["captured"] == 3 and s.sync(NOW)["rows_inserted"] == 3
        if part == 0:
            assert s.roll() == 3  # both tables as they were first, and the first sync
    assert s.assign_archetypes(NOW)["new"] and s.roll() == 2 and s.roll() == 0  # the second sync and the assignment
    one, two = sorted(r.id for r in s.table("archetypes").collect())
    files = set(s.log("traces").read().inputFiles())
    s.change_archetype(one, NOW + 1, label="Named", pinned=True)
    s.merge_archetypes(two, one, NOW + 2)
    s.merge_archetypes(one, one, NOW + 3)
    row = s.table("archetypes").where(F.col("id") == one).first()
    assert (row.label, row.pinned, row.updated_ts) == ("Named", True, NOW + 1) and s.table("archetypes").where(F.col("id") == two).first().merged_into == one
    assert s.table("archetype_assignments").where(F.col("archetype_id") == one).count() == 6 and set(s.log("traces").read().inputFiles()) == files
    equal()
    s.compact()
    assert s.table("traces").count() == 6 and not s.log("traces").numbers() and s.roll() == 0
    bare = s.table("traces").limit(1).withColumn("prompt_text", F.lit(None).cast("string"))
    s.log("traces").change(bare)
    assert s.table("traces").where("prompt_text IS NULL").count() == 1 and s.sync(NOW)["rows_inserted"] == 0 and s.table("traces").where("prompt_text IS NULL").count() == 0
    equal()
    for call in (lambda: s.change_archetype("none", NOW, pinned=True), lambda: s.merge_archetypes(one, "none", NOW)):
        with pytest.raises(KeyError):
            call()
    ticks = []
    q = s.watch(ticks.append, f"file://{tmp_path}/watch", 1)
    q.processAllAvailable()
    q.stop()
    assert ticks and ticks[0] > NOW - 10 * 365 * reports.DAY_MS
    assert changelog.partitions(spark, "rolled_test.day_counts")
    spark.sql("DROP DATABASE rolled_test CASCADE")
