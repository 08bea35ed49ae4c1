"""The store as a catalog database, and one function for each read route of the dashboard and each command of the line tool."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake import schemas
from tracelake.functions import scorers
from tracelake.functions.messages import prompt_text_udf, response_udf
from tracelake.operators import indicators, mining, replay, reports, rollups, similarity, windows
from tracelake.operators.exposition import exposition
from tracelake.operators.tables import drop, shared_table
from tracelake.sources import changelog, sync, transcripts
from tracelake.sources.changelog import Log

#: Tables whose rows change, with their keys: each has a log of changes, the others are only added to.
KEYS = {"traces": "id", "archetypes": "id", "archetype_assignments": "trace_id"}


def bootstrap(spark: SparkSession, database: str) -> None:
    """Create the database and its tables where they are missing; columns of later versions are added to older tables."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for table in schemas.VERSIONS:
        kind = schemas.schema(table)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{table} ({columns}) USING parquet TBLPROPERTIES ('schema_version' = '{len(schemas.VERSIONS[table])}')")
        if table in KEYS:
            Log.create(spark, f"{database}.{table}", columns)
        have = set(spark.table(f"{database}.{table}").columns)
        missing = [f for f in kind.fields if f.name not in have]
        if missing:
            added = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in missing)
            spark.sql(f"ALTER TABLE {database}.{table} ADD COLUMNS ({added})")
            spark.sql(f"ALTER TABLE {database}.{table} SET TBLPROPERTIES ('schema_version' = '{len(schemas.VERSIONS[table])}')")
            if table in KEYS and not set(spark.table(f"{database}.{table}_changes").columns) >= {f.name for f in missing}:
                spark.sql(f"ALTER TABLE {database}.{table}_changes ADD COLUMNS ({added})")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.day_counts ({rollups.TRACES}, source STRING, batch BIGINT) USING parquet PARTITIONED BY (source, batch)")


@dataclass
class Store:
    """Tables of one database. Every route gives a DataFrame with its full schema, on an empty store too."""

    spark: SparkSession
    database: str

    def log(self, name: str) -> Log:
        return Log(self.spark, f"{self.database}.{name}", KEYS[name])

    def table(self, name: str) -> DataFrame:
        return self.log(name).read() if name in KEYS else self.spark.table(f"{self.database}.{name}")

    def tables(self) -> dict[str, DataFrame]:
        names = {"assignments": "archetype_assignments"} | {n: n for n in schemas.VERSIONS if n != "archetype_assignments"}
        return {k: self.table(v) for k, v in names.items()}

    # routes
    def healthz(self) -> DataFrame:
        return self.spark.range(1).select(F.lit("ok").alias("status"))

    def readyz(self) -> DataFrame:
        have = {t.name for t in self.spark.catalog.listTables(self.database)}
        return self.spark.createDataFrame([(t, t in have) for t in schemas.VERSIONS], "name string, ready boolean")

    def summary(self) -> DataFrame:
        return reports.summary(self.table("traces"), self.table("archetype_assignments"), self.table("archetypes"))

    def by_tool(self) -> DataFrame:
        return self.table("traces").groupBy(F.coalesce("tool", F.lit("unknown")).alias("tool")).agg(F.count("*").alias("n"))

    def archetypes(self) -> DataFrame:
        return reports.archetype_counts(self.table("archetypes"), self.table("archetype_assignments"))

    def traces(self, archetype: str | None = None, limit: int = 50) -> DataFrame:
        if archetype is not None:
            return reports.drill_down(self.table("traces"), self.table("archetype_assignments"), archetype, limit)
        if not 1 <= limit <= 500:
            raise ValueError("limit is 1 to 500")
        return self.table("traces").orderBy(F.desc("ts"), "id").limit(limit)

    def trace(self, which: str) -> DataFrame:
        return self.table("traces").where(F.col("id") == which)

    def recommendations(self) -> DataFrame:
        names = self.table("archetypes").select(F.col("id").alias("archetype_id"), "label")
        return self.table("recommendations").join(names, "archetype_id").orderBy(F.desc("created_ts"), "id")

    def applied_policies(self) -> DataFrame:
        return self.table("applied_policies").orderBy(F.desc("applied_ts"), "id")

    def evals(self) -> tuple[DataFrame, DataFrame]:
        t = self.tables()
        return reports.scorer_summary(t["eval_scores"], t["archetypes"]), reports.agreement(reports.review_pairs(t["human_reviews"], t["replay_results"], t["eval_scores"]))

    def monitor(self, now_ms: int, rolled: bool = False) -> dict[str, DataFrame]:
        """The reports by a scan of all rows, or, ``rolled``, from the counts by day, which :meth:`roll` brings up to date first."""
        t = self.tables()
        if rolled:
            self.roll()
            counts, rows = self.spark.table(f"{self.database}.day_counts").drop("source", "batch"), self._with_empty()
            keys, quality = rollups.drift_keys(counts, rows, t["assignments"], t["archetypes"], now_ms), rollups.data_quality(counts, rows, t["assignments"], now_ms)
        else:
            keys, quality = reports.drift_keys(t["traces"], t["assignments"], t["archetypes"], now_ms), reports.data_quality(self._with_empty(), t["assignments"], now_ms)
        return {"drift": reports.drift_report(keys), "shifts": reports.top_shifts(keys), "quality": quality, "performance": reports.performance(t["replay_results"], t["spot_checks"], t["archetypes"], now_ms)}

    def slo(self, rules: DataFrame, metrics: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
        context = indicators.Context(self.tables() | {"traces": self._with_empty(), "metrics": metrics}, now_ms)
        targets = rules.where("kind = 'slo'").select(F.col("name").alias("objective"), "target")
        return indicators.evaluate(self.spark, context, rules), reports.compliance(self.table("slo_evaluations"), targets, now_ms)

    def metrics(self, rows: DataFrame) -> DataFrame:
        return exposition(rows, "tracelake_")

    def system(self) -> DataFrame:
        return self.spark.createDataFrame([(self.spark.version, self.database, self.spark.sparkContext.defaultParallelism)], "spark string, database string, cores int")

    def watch(self, job: Callable[[int], None], checkpoint: str, seconds: int = 60) -> StreamingQuery:
        """Call ``job(now_ms)`` in every trigger of a stream, as sync and monitoring do from time to time; stop the query to end it."""

        def tick(batch: DataFrame, number: int) -> None:
            job(int(time.time() * 1000))

        return self.spark.readStream.format("rate").load().writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()

    def _with_empty(self, rows: DataFrame | None = None) -> DataFrame:
        said = response_udf("response_json")
        rows = (self.table("traces") if rows is None else rows).withColumn("__r", said)
        return rows.withColumn("empty_response", (F.trim("__r.text") == "") & (F.size("__r.tool_calls") == 0)).drop("__r")

    # commands
    def ingest(self, folder: str, now_ms: int) -> dict:
        """Capture the transcripts below a folder that the store lacks, redacted before they are written."""
        from tracelake.functions.messages import redact_payload_udf

        found, counts = transcripts.scan(self.spark, folder, now_ms)
        for name in ("request_json", "response_json"):
            found = found.withColumn(f"__{name}", redact_payload_udf(name)).withColumn(name, F.col(f"__{name}.text"))
        flags = F.array_distinct(F.concat("__request_json.flags", "__response_json.flags"))
        rows = found.withColumn("redaction_flags", F.to_json(flags)).withColumn("quarantined", F.col("__request_json.quarantined") | F.col("__response_json.quarantined")).withColumn("notes", F.lit(None).cast("string"))
        fresh = sync.new_captures(rows.select([f.name for f in schemas.schema("capture").fields]), self.table("capture"))
        before = self.table("capture").count()
        fresh.write.insertInto(f"{self.database}.capture")
        return counts | {"captured": self.table("capture").count() - before}

    def sync(self, now_ms: int) -> dict:
        captured, known = self.table("capture"), self.table("traces")
        fresh = sync.new_rows(captured, known).withColumn("prompt_text", prompt_text_udf("request_json"))
        before, (scanned, newest) = known.count(), captured.agg(F.count("*"), F.max("ts")).first()
        self.log("traces").insert(fresh)
        inserted = self.table("traces").count() - before
        self._backfill()
        return {"rows_scanned": scanned, "rows_inserted": inserted, "rows_deduped": scanned - inserted, "lag_seconds": None if newest is None else max(0.0, (now_ms - newest) / 1000)}

    def _overwrite(self, name: str, rows: DataFrame) -> None:
        """A table's rows replaced; they may be made from the table itself."""
        if name not in KEYS:
            shared_table(rows.select([f.name for f in schemas.schema(name).fields]), name).write.insertInto(f"{self.database}.{name}", overwrite=True)
            return
        self.log(name).replace(rows)
        for p in changelog.partitions(self.spark, f"{self.database}.day_counts"):  # counts of the rows before: the next roll counts anew
            self.spark.sql(f"ALTER TABLE {self.database}.day_counts DROP PARTITION (source = '{p['source']}', batch = {p['batch']})")

    def _backfill(self) -> int:
        """Give stored traces without a prompt_text the one that their request has; how many. Only these rows are written."""
        bare = self.table("traces").where("prompt_text IS NULL").withColumn("prompt_text", prompt_text_udf("request_json")).where("prompt_text <> ''")
        found = shared_table(bare, "prompts")
        n = found.count()
        if n:
            self.log("traces").change(found)
        drop(found)
        return n

    def roll(self) -> int:
        """Add what has changed since the last call to the counts by day; the number of changes counted.

        A change gives the counts of its rows and takes back those of the versions before. The counts of one change are one
        partition, added in one step, so a change counts once, whatever was broken off.
        """
        done, n = {(p["source"], int(p["batch"])) for p in changelog.partitions(self.spark, f"{self.database}.day_counts")}, 0
        for name in ("traces", "archetype_assignments"):
            log = self.log(name)
            folded = log.folded()
            for number in log.numbers() if any(s == name for s, _ in done) else [folded, *log.numbers()]:
                if (name, number) in done:
                    continue
                rows, old = (log.read(folded), None) if number == folded else (log.at(number), log.read(number - 1))
                if old is not None:
                    old = old.join(rows.select(log.key), log.key, "left_semi").select(rows.columns)
                if name == "traces":
                    parts = rollups.trace_counts(self._with_empty(rows))
                    if old is not None:
                        parts = rollups.merged(parts.unionByName(rollups.trace_counts(self._with_empty(old)).withColumn("n", -F.col("n"))), "day", "feature", "key")
                else:
                    parts = rollups.assignment_counts(self.table("traces"), rows, old)
                table = f"{self.database}.day_counts"
                changelog.add_partition(parts, table, changelog.location(self.spark, table), source=name, batch=number)
                n += 1
        return n

    def compact(self) -> None:
        """Bring the logs' changes into their tables, counted by day before."""
        self.roll()
        for name in KEYS:
            self.log(name).compact()

    def change_archetype(self, which: str, now_ms: int, **values) -> None:
        """Rename (``label``) or pin (``pinned``) an archetype; KeyError if there is none."""
        self.log("archetypes").change(self._archetype(which).withColumns({k: F.lit(v) for k, v in values.items()} | {"updated_ts": F.lit(now_ms).cast("bigint")}))

    def merge_archetypes(self, source: str, target: str, now_ms: int) -> None:
        """Assignments of ``source`` go to ``target``, then it is marked as merged; into itself changes nothing. KeyError if either isn't there.

        A merge that is broken off between its two changes is finished by doing it again.
        """
        marked, _ = self._archetype(source), self._archetype(target)
        if source == target:
            return
        self.log("archetype_assignments").change(self.table("archetype_assignments").where(F.col("archetype_id") == source).withColumn("archetype_id", F.lit(target)))
        self.log("archetypes").change(marked.withColumns({"merged_into": F.lit(target), "updated_ts": F.lit(now_ms).cast("bigint")}))

    def _archetype(self, which: str) -> DataFrame:
        row = self.table("archetypes").where(F.col("id") == which)
        if not row.limit(1).count():
            raise KeyError(which)
        return row

    def assign_archetypes(self, now_ms: int, least: float = 0.5, size: int = 3, match: float = 0.75, label: Callable[[list[str]], str] | None = None) -> dict:
        """Cluster the traces, match clusters to stored archetypes by their medoids, name new ones, and write both tables.

        Clusters are taken in order of their smallest member, and each takes the stored archetype (not merged away, its
        medoid among the traces) most similar to its own medoid, from ``match`` up, that no cluster before it took. ``label``
        names a new one from its first five prompts; without it the commonest telling words do. Returned are the ids of new
        and matched archetypes and the two gauges.
        """
        rows = self.table("traces").where("NOT quarantined AND prompt_text IS NOT NULL").select("id", F.col("prompt_text").alias("text")).withColumn("n", F.xxhash64("id"))
        rows = shared_table(rows, "prompts")
        v = shared_table(mining.hash_embedding(rows.select(F.col("n").alias("id"), "text")), "vectors")
        found = mining.components(rows.select(F.col("n").alias("id")), similarity.similar_links(v, least))
        members = shared_table(mining.clusters(found, size), "members")
        centres = shared_table(mining.medoids(v, members), "medoids")
        archetypes = shared_table(self.table("archetypes"), "archetypes")
        old = archetypes.where("merged_into IS NULL").select(F.col("id").alias("archetype_id"), F.xxhash64("medoid_trace_id").alias("id")).join(v, "id").select("archetype_id", "bucket", F.col("weight").alias("w"))
        near = centres.join(v, "id").join(old, "bucket").groupBy("cluster", "archetype_id").agg(F.sum(F.col("weight") * F.col("w")).alias("similarity"))
        known = mining.match_identities(near, match).withColumnRenamed("archetype_id", "known")
        names = rows.select(F.col("n").alias("member"), F.col("id").alias("trace_id"), "text")
        made = F.concat(F.lit("a-"), F.left(F.sha2(F.concat_ws("|", "trace_id", F.lit(now_ms)), 256), F.lit(24)))
        made = centres.join(names, centres["id"] == names["member"]).join(known, "cluster", "left").select("cluster", F.col("trace_id").alias("medoid_trace_id"), F.coalesce("known", made).alias("archetype_id"), F.col("known").isNull().alias("new"))
        made = shared_table(made, "identities")
        texts = members.where("cluster <> -1").withColumnRenamed("id", "member").join(names, "member").select("cluster", F.col("trace_id").alias("id"), "text")
        fresh = made.where("new")
        if label is None:
            labels = mining.keyword_labels(texts.join(fresh.select("cluster"), "cluster", "left_semi"))
        else:
            first = texts.join(fresh.select("cluster"), "cluster", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy("id"))).where("k <= 5")
            labels = self.spark.createDataFrame([(r["cluster"], label([x["text"] for x in r["xs"]])) for r in first.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("k", "text"))).alias("xs")).toLocalIterator()], "cluster bigint, label string")
        added = fresh.join(labels, "cluster").select(F.col("archetype_id").alias("id"), "label", F.lit(False).alias("pinned"), F.lit(None).cast("string").alias("merged_into"), F.lit(now_ms).cast("bigint").alias("created_ts"), F.lit(now_ms).cast("bigint").alias("updated_ts"), "medoid_trace_id")
        moved = made.where("NOT new").select(F.col("archetype_id").alias("id"), F.col("medoid_trace_id").alias("medoid"))
        moved = archetypes.join(moved, "id").withColumns({"updated_ts": F.lit(now_ms).cast("bigint"), "medoid_trace_id": F.col("medoid")}).select(archetypes.columns)
        far = mining.distances(v, members, centres).withColumnRenamed("id", "member")
        given = far.join(names, "member").join(made.select("cluster", "archetype_id"), "cluster").select("trace_id", "archetype_id", "distance", F.lit(now_ms).cast("bigint").alias("assigned_ts"))
        given = shared_table(given, "assignments")
        self.log("archetypes").change(moved.unionByName(added))  # first, so that no assignment names an archetype that isn't there
        self.log("archetype_assignments").change(given)
        total, assigned = rows.count(), given.count()
        return {"new": sorted(r["archetype_id"] for r in fresh.collect()), "matched": sorted(r["archetype_id"] for r in made.where("NOT new").select("archetype_id").collect()), "unassigned_traces_ratio": (total - assigned) / total if total else None, "archetype_count": self.table("archetypes").where("merged_into IS NULL").count()}

    def save_results(self, results: DataFrame, scores: DataFrame) -> int:
        """Append graded results (columns of replay_results; a chain's grader is ``chain`` and its trace the session) and their scores.

        Results and scores that are stored already, by id and by (result, scorer), are left as they are; the number of new results.
        """
        new = results.select([f.name for f in schemas.schema("replay_results").fields]).dropDuplicates(["id"])
        new = shared_table(new.join(self.table("replay_results").select("id"), "id", "left_anti").select(new.columns), "results")
        key = ["replay_result_id", "scorer"]
        rows = scores.select([f.name for f in schemas.schema("eval_scores").fields]).dropDuplicates(key)
        rows = shared_table(rows.join(self.table("eval_scores").select(*key), key, "left_anti").select(rows.columns), "scores")
        new.write.insertInto(f"{self.database}.replay_results")
        rows.write.insertInto(f"{self.database}.eval_scores")
        return new.count()

    def run(self, ladder: DataFrame, call: Callable[[str, str], dict], n: int, seed: str, run_id: str, now_ms: int, budget: float | None = None, judge=None) -> int:
        """Replay the samples that lack a result through the candidates, grade and save them; the number of results.

        The stored answer of each sampled trace is the reference. A call that fails is a failed result. ``judge`` is a function
        of the columns (request, reference, candidate) that gives a boolean column; without it tokens are compared.
        """
        work = self.work(ladder, n, seed)
        done = shared_table(replay.replay(work, call, budget), "replayed")
        asked = self.table("traces").select(F.col("id").alias("source_trace_id"), F.col("prompt_text").alias("request"), response_udf("response_json").alias("said"))
        cases = done.join(asked, "source_trace_id").select("id", F.coalesce("request", F.lit("")).alias("request"), "said.text", F.coalesce("response_text", F.lit("")).alias("candidate"), F.transform("said.tool_calls", lambda c: F.struct(c["name"].alias("name"), c["input_keys"].alias("input_keys"))).alias("reference_calls")).withColumnRenamed("text", "reference")
        cases = cases.withColumn("candidate_calls", F.array().cast("array<struct<name:string,input_keys:array<string>>>"))
        graded = shared_table(scorers.grade(cases, None if judge is None else judge(F.col("request"), F.col("reference"), F.col("candidate"))), "graded")
        verdicts = graded.groupBy("id").agg(F.min("verdict").alias("verdict"))
        results = done.join(verdicts, "id", "left").select("id", "archetype_id", "candidate", "source_trace_id", F.when(F.col("error").isNull(), F.coalesce("verdict", F.lit("fail"))).otherwise("fail").alias("verdict"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), F.col("latency_ms").cast("int").alias("latency_ms"), F.lit("suite").alias("grader"), F.lit(run_id).alias("run_id"), F.lit(now_ms).cast("bigint").alias("ts"), "response_text")
        rows = graded.join(done.where("error IS NULL").select("id", "archetype_id", "candidate"), "id").select(F.col("id").alias("replay_result_id"), F.lit(run_id).alias("run_id"), "archetype_id", "candidate", "scorer", "value", "passed", F.lit(None).cast("string").alias("detail"), F.lit(now_ms).cast("bigint").alias("ts"))
        return self.save_results(results, rows)

    def cluster(self, least: float = 0.5, size: int = 3) -> tuple[DataFrame, DataFrame]:
        """(members, medoids) of traces with a prompt that aren't quarantined; identities are then matched by ``mining``."""
        rows = self.table("traces").where("NOT quarantined AND prompt_text IS NOT NULL").select("id", F.col("prompt_text").alias("text"))
        numbered = rows.withColumn("n", F.xxhash64("id"))
        v = mining.hash_embedding(numbered.select(F.col("n").alias("id"), "text"))
        members = mining.clusters(mining.components(numbered.select(F.col("n").alias("id")), similarity.similar_links(v, least)), size)
        return numbered.join(members.withColumnRenamed("id", "n"), "n").select("id", "cluster"), mining.medoids(v, members)

    def work(self, ladder: DataFrame, n: int, seed: str) -> DataFrame:
        """Sampled traces of active archetypes with each candidate they lack a result for."""
        t = self.tables()
        pool = reports.assigned_traces(t["traces"].where("NOT quarantined"), t["assignments"], t["archetypes"])
        picked = windows.stratified_sample(pool, n, seed).select("id", "archetype_id", "prompt_text")
        return replay.pending(picked.crossJoin(F.broadcast(ladder.select(F.col("name").alias("candidate")))), t["replay_results"])  # a ladder is a few rows of a rule file
