"""The data-set build from record files to problem directories, stage by stage, each on what the one before it wrote."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import compare, tags
from ..functions.text import composite_id
from ..operators import enrich, external, gate, metrics, sample, select, verdicts
from ..session import cut
from ..sources import dataset_dirs, messages, riegeli, stores

STAGES = ("pool", "enrich", "sample", "verify", "write")
PYTHON3 = 3
#: Cases that a solution must all pass before the others are sent to it.
PROBE = 3


def require(spark: SparkSession, path: str, what: str, hint: str) -> str:
    """The path, if something is there; else an error that says which stage makes it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(f"{what} is missing at {path}; {hint}")
    return path


def verification(problems: DataFrame, settings: Settings, runner: external.Runner) -> DataFrame:
    """Of each problem the first solution that passes its selected cases, shortest first.

    ``problems``: cc_id, public_tests, private_tests, generated_tests, solutions,
    time_limit_seconds. Solutions that look like Python 2 are not tried. Outputs are judged by
    tokens, and by numbers within the tolerance where all failures have the wanted count of
    tokens. Returns cc_id, attempts (array of attempt, verdict, failures), and of the first
    success attempt, code, comparison, cases_total, max_ms; nulls without one.
    """
    of = settings.verification
    origins = F.array(*(F.struct(F.lit(o).alias("origin"), F.coalesce(F.col(f"{o}_tests"), F.array().cast(problems.schema[f"{o}_tests"].dataType)).alias("tests")) for o in gate.ORIGINS))
    each = problems.select(F.col("cc_id").alias("pid"), F.explode(origins).alias("o")).select("pid", "o.origin", F.posexplode("o.tests").alias("ord", "t")).select("pid", "origin", "ord", "t.input", "t.output")
    cases = cut(select.select_cases(each, of.max_cases, settings.gates.most_field_bytes).select("pid", F.col("position").alias("ord"), "input", F.col("output").alias("expected")))
    tried = problems.select(F.col("cc_id").alias("pid"), F.least(F.coalesce("time_limit_seconds", F.lit(settings.gates.default_seconds)), F.lit(of.timeout_cap_seconds)).alias("seconds"), F.posexplode("solutions").alias("place", "s"))
    tried = tried.where((F.col("s.language") == PYTHON3) & (F.size(tags.python2(F.col("s.solution"))) == 0)).select("pid", "seconds", "place", F.col("s.solution").alias("code"))
    tried = cut(select.shortest_first(tried, "pid", "code", "place", of.max_solutions).withColumn("candidate", F.concat_ws("#", "pid", F.col("attempt").cast("string"))))
    runs = cut(external.run_programs(tried.select("candidate", "pid", F.lit("python").alias("language"), "code", "seconds"), cases, runner, probe=PROBE))
    status = lambda mode: external.run_status(runs, compare.outputs_equal("stdout", "expected", mode, of.tolerance, of.tolerance))
    token = status("token")
    rolled = verdicts.two_stage(token.select("candidate", "ord", "status", "time_ms"), ["candidate"], "ord", PROBE)
    head = F.struct(F.col("status").alias("verdict"), F.col("stdout").alias("stdout_head"), F.col("expected").alias("expected_head"))
    failed = token.where("status <> 'AC'").groupBy("candidate").agg(F.collect_list(head).alias("_failures"))  # at most the cases of a problem
    floats = verdicts.first_failure(status("float").select("candidate", "ord", "status"), ["candidate"], "ord").select("candidate", (F.col("status") == "AC").alias("_close"))
    judged = tried.join(rolled.drop("failures"), "candidate").join(failed, "candidate", "left").join(floats, "candidate").join(cases.groupBy("pid").agg(F.count("*").alias("_cases")), "pid")
    whole = F.col("cases_run") == F.col("_cases")
    near = gate.needs_number_tolerance("verdict", F.coalesce("_failures", F.array().cast(failed.schema["_failures"].dataType))) & F.col("_close") & (F.col("cases_total") == F.col("_cases"))
    judged = cut(judged.withColumn("comparison", F.when(F.col("ok") & whole, "token").when(near, "float")))
    first = select.first_success(judged, "pid", F.col("comparison").isNotNull(), "attempt", "attempt", "code", "comparison", F.col("_cases").alias("cases_total"), "max_ms")
    record = F.struct("attempt", "verdict", F.coalesce("_failures", F.array().cast(failed.schema["_failures"].dataType)).alias("failures"))
    attempts = judged.groupBy("pid").agg(F.array_sort(F.collect_list(record)).alias("attempts"))
    out = problems.select(F.col("cc_id").alias("pid")).join(attempts, "pid", "left").join(first, "pid", "left")
    return out.withColumn("attempts", F.coalesce("attempts", F.array().cast(attempts.schema["attempts"].dataType))).withColumnRenamed("pid", "cc_id")


def split_by_verification(selected: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selected rows that were verified, with their evidence; and the others with the reasons, and whether a special judge is suspected."""
    both = cut(selected.join(results, "cc_id", "left"))
    passed = both.where("comparison is not null").withColumn("reference_sha256", F.sha2("code", 256))
    reasons = F.sort_array(F.array_distinct(F.transform("attempts", lambda a: a["verdict"])))
    tried = F.coalesce(F.size("attempts"), F.lit(0))
    rejects = both.where("comparison is null").select("cc_id", "name", tried.alias("tried"), F.coalesce(reasons, F.array(F.lit("missing"))).alias("reasons"), F.coalesce(gate.special_judge_suspected("attempts"), F.lit(False)).alias("suspected"))
    return passed, rejects


def final_selection(verified: DataFrame, target: int, settings: Settings, kept: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """The verified rows drawn anew to the real target, with the cell that each was drawn for. ``kept`` stores the draw."""
    rows = verified.withColumns({"bin": F.col("difficulty_bin"), "category": F.col("primary_category"), "categories": F.col("categories_all")})
    of = settings.sampling
    rows = rows.where(F.col("category").isin(*of.categories) & F.col("bin").isin(*(name for _, _, name in of.rating_bins)))
    chosen = kept(sample.draw(rows.select("cc_id", "bin", "category", "categories"), target, "cc_id", of.seed, of.min_per_cell, of.max_per_category_share))
    return verified.join(chosen, "cc_id")


@dataclass
class Build:
    """A build in a working folder that driver and executors share.

    Every stage is stored as a new version of a table that is bucketed and sorted by ``cc_id``, and read in its newest
    whole version. Stages are joined by ``cc_id`` as they lie, without an exchange.
    """

    spark: SparkSession
    records: str  # record files
    labels: str  # Parquet table of labels
    work: str
    settings: Settings
    oversample: float = 1.4
    #: At most so many shards of the training split; None for all.
    train_shards: int | None = None

    #: Buckets of the tables; a working folder keeps the number it was begun with.
    buckets: int = 64

    def _at(self, stage: str) -> str:
        return f"{self.work}/{stage}"

    def _versions(self, stage: str) -> list[int]:
        """Versions of a stage that were written to their end."""
        system, place = dataset_dirs.filesystem(self.spark, self._at(stage))
        if not system.exists(place):
            return []
        found = [s.getPath() for s in system.listStatus(place)]
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and system.exists(path(p, "_SUCCESS")))

    def _layout(self) -> int:
        place = self._at("layout.json")
        system, path = dataset_dirs.filesystem(self.spark, place)
        if not system.exists(path):
            dataset_dirs.write_text(self.spark, place, json.dumps({"buckets": self.buckets}))
        return json.loads(self.spark.read.text(place, wholetext=True).first()[0])["buckets"]

    def _table(self, stage: str, version: int) -> DataFrame:
        """A stored version with its layout; a session that does not know it is told."""
        place = stores.qualified(self.spark, f"{self._at(stage)}/v{version}")
        name = f"stage_{hashlib.md5(place.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(place).schema.fields)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (cc_id) SORTED BY (cc_id) INTO {self._layout()} BUCKETS LOCATION '{place}'")
        return self.spark.table(name)

    def _kept(self, stage: str, rows: DataFrame) -> DataFrame:
        version, buckets = max(self._versions(stage), default=0) + 1, self._layout()
        place = stores.qualified(self.spark, f"{self._at(stage)}/v{version}")
        # Bucketed writes need a table; its rows come one bucket a task, so a bucket is one file.
        name = f"stage_{hashlib.md5(place.encode()).hexdigest()}"
        rows.repartition(buckets, "cc_id").write.format("parquet").mode("overwrite").bucketBy(buckets, "cc_id").sortBy("cc_id").option("path", place).saveAsTable(name)
        return self.spark.table(name)

    def _tallied(self, stage: str, tally: gate.Tally) -> DataFrame:
        """Keeps a stage's rows and, beside them, what was counted as they were written."""
        rows = self._kept(stage, tally.rows)
        dataset_dirs.write_text(self.spark, self._at(f"{stage}.json"), json.dumps(tally.counts()))
        return rows

    def counts(self, stage: str) -> dict[str, int]:
        """What was counted when a stage was written."""
        place = require(self.spark, self._at(f"{stage}.json"), f"the counts of stage {stage}", f"run stage {stage} first")
        return json.loads("\n".join(r[0] for r in self.spark.read.text(place).collect()))

    def _of(self, stage: str) -> DataFrame:
        require(self.spark, self._at(stage), f"the result of stage {stage}", f"run stage {stage} first")
        return self._table(stage, max(self._versions(stage)))

    def problems(self, ids: DataFrame | None = None) -> DataFrame:
        wanted = None if ids is None else ids.select("split", "shard", "record_index")
        raw = riegeli.scan_records(self.spark, self.records, ids=wanted, train_shards=self.train_shards)
        return messages.with_names(messages.decode_problems(raw)).withColumn("cc_id", composite_id("split", "shard", "record_index"))

    def pool(self) -> DataFrame:
        sources = tuple(messages.SOURCES.values())
        return self._tallied("pool", gate.tallied(gate.gate(self.problems(), self.settings.gates), source_name=sources))

    def enriched(self) -> DataFrame:
        index = enrich.label_index(dataset_dirs.in_file_order(self.spark.read.parquet(self.labels)), "ord")
        rows = enrich.enrich(self._of("pool").where("passed"), index, "ord")
        of = lambda how: F.count_if(F.col("taco_match") == how)
        return self._tallied("enrich", gate.Tally(rows, rows=F.count(F.lit(1)), key=of("key"), title=of("title"), none=of("none"), rated=F.count("cf_rating"), labelled=F.count("taco_difficulty")))

    def sampled(self) -> DataFrame:
        rows = sample.prepared(self._of("enrich"))
        return self._kept("sample", self._drawn(rows, int(self.settings.sampling.target * self.oversample)))

    def _drawn(self, rows: DataFrame, target: int) -> DataFrame:
        return final_selection(rows, target, self.settings, lambda chosen: self._kept("drawn", chosen))

    def verified(self, runner: external.Runner) -> tuple[DataFrame, DataFrame]:
        chosen = self._of("sample")
        records = self._kept("records", self.problems(chosen))
        results = self._kept("results", verification(records, self.settings, runner))
        passed, rejects = split_by_verification(chosen.drop("quota_cell", "filled_beyond_quota"), results)
        return self._kept("verify", passed), self._kept("rejects", rejects)

    def written(self, public: str, private: str, prune: bool = False) -> dict:
        """Problem directories, labels and verification apart from them, what is stale, and the manifest."""
        of = self.settings.output
        chosen = cut(self._drawn(self._of("verify"), self.settings.sampling.target))
        made = dataset_dirs.export_problems(chosen.drop("description").join(self._of("records").select("cc_id", "description", *(f"{o}_tests" for o in gate.ORIGINS)), "cc_id"), public, private, of.max_cases, of.max_field_bytes, of.max_problem_bytes)
        stale = dataset_dirs.prune(self.spark, public, made.select(F.col("cc_id").alias("pid")), delete=prune)
        text = dataset_dirs.manifest(
            json.loads(self.settings.as_json()), modes=metrics.zero_filled(chosen, "comparison", compare.MODES),
            cells=chosen.groupBy("quota_cell", "filled_beyond_quota").count(), impact=impact(chosen), rejects=self._of("rejects").select(F.explode("reasons").alias("reason")).groupBy("reason").count(),
            totals=made.agg(F.count("*").alias("problems"), F.sum("n_cases").alias("cases"), F.sum("bytes").alias("bytes")),
        )
        text = json.dumps(json.loads(text) | {"pool": self.counts("pool"), "match": self.counts("enrich")}, ensure_ascii=False, sort_keys=True)
        dataset_dirs.write_text(self.spark, f"{public}/manifest.json", text)
        return {"manifest": text, "stale": stale}


def impact(rows: DataFrame) -> DataFrame:
    """What the joined labels have given: tags, skills, bins and categories, as one row."""
    some = lambda c: F.count_if(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0)
    return rows.agg(
        some("taco_tags").alias("with_tags"), some("taco_skill_types").alias("with_skill_types"), F.count_if(F.col("difficulty_bin_source") == "taco").alias("bin_from_labels"), F.count_if(F.col("category_source") == "taco").alias("category_from_labels")
    )
