"""The whole screening run with any screeners: resumable, every answer asked for once, targets finished one by one.

fragments -> batches -> coarse answers of two screeners -> candidate pairs -> targeted answers -> consensus and
disputes -> rulings -> final records. All targets of a wave go through one plan. Between the stages stand response logs, so
a run that stopped goes on where it was; a commit table holds the state of each target, so one that is finished and
whose fragments, themes and models are as they were is not touched again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import modeljson
from ..operators import adjudicate, batches, dedupe, ordered, review, screening
from ..sinks import record_files
from .commits import Commits, expand_counts
from .log import ResponseLog, fingerprint, with_asked
from .state import PACKED, delete, exists, lean_shuffles, names, no_rows, read_json, update_json

VERSION = 3
JUDGES = ("llm1", "llm2")
COUNTS = ("repo_dir_count", "fragment_count", "batch_count", "candidate_pair_count", "consensus_count", "dispute_count", "manual_review_count", "final_record_count", "final_piece_count", "arbitrated_keep_count")
FRAGMENT = ["target", "ord", "piece_id", "source_file", "repo_dir", "original_text"]
RUN = ["target", "source_file", "repo_dir", "occurrence", "run_mark"]
PIECES = "array<struct<piece_id:string,original_text:string>>"
#: a wave's own tables, which go when it ends
OWN = ("file_runs", "runs", "batches", "batch_ids", "pairs", "verdicts", "arbitration")
#: targets up to which their table is sent to all executors
FEW = 100_000


class Paused(RuntimeError):
    """Some requests have no usable answer; a later run asks them again. Other targets are finished."""


@dataclass
class Outcome:
    """What all finished targets have; None where no target ever came that far."""

    records: DataFrame | None
    summary: DataFrame
    review: DataFrame | None
    disputes: DataFrame | None


def _said(x: Exception) -> str:
    """What an error says: long traces by both ends."""
    said = str(x).strip()
    return said if len(said) <= 600 else f"{said[:200]} ... {said[-400:]}"


def _manual(status: str = "status"):
    return F.col(status) == "manual"


def file_runs(fragments: DataFrame) -> DataFrame:
    """(target, ord, source_file, repo_dir, n, content, run): fragments with their run, from 1 in a target; n: the length that
    counts, content: hashes of piece and text, so that texts don't go along.
    """
    n = F.length(F.replace("original_text", F.lit("\n"), F.lit("")))
    content = F.struct(*(F.xxhash64(F.lit(k), "piece_id", "original_text").alias(f"h{k}") for k in (1, 2)))
    f = fragments.select("target", "ord", "source_file", "repo_dir", n.alias("n"), content.alias("content"))
    return ordered.run_numbers(f, ["target"], "ord", ["source_file", "repo_dir"], "run")


def run_marks(runs: DataFrame) -> DataFrame:
    """(target, run, source_file, repo_dir, occurrence, run_mark, first_ord): a hash of each run's content.

    It holds wherever the run stands in its target, so a change before it leaves it as it is. occurrence: of runs of one
    file the how manieth. runs: rows of `file_runs`.
    """
    start = runs.groupBy("target", "run").agg(F.min("ord").alias("first_ord"))
    at = runs.select("target", "ord", "run", "source_file", "repo_dir", "content").join(start, ["target", "run"])
    content = [F.xxhash64(F.lit(k), F.col("ord") - F.col("first_ord"), f"content.h{k}") for k in (1, 2)]
    mark = F.concat_ws("-", F.count(F.lit(1)), *(F.hex(F.bit_xor(c)) for c in content))
    out = at.groupBy("target", "run", "source_file", "repo_dir").agg(mark.alias("run_mark"), F.first("first_ord").alias("first_ord"))
    return out.withColumn("occurrence", F.row_number().over(W.partitionBy("target", "source_file", "repo_dir").orderBy("run")))


class Packs:
    """Batches by run of a file and content: written once, whatever run or target state asks for them later."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        # a folder counts once Spark has finished it; packs without their pieces are of an older form
        done = [f"{self.path}/{n}" for n in names(self.spark, self.path) if exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        schema = f"target string, source_file string, repo_dir string, occurrence int, run_mark string, local int, char_count bigint, pieces {PIECES}"
        return self.spark.read.schema(schema).parquet(*sorted(done)).where("pieces is not null") if done else None

    def add_missing(self, fragments: DataFrame, runs: DataFrame, marks: DataFrame, limit: int, name: str) -> None:
        """Cut the runs that no pack holds; runs: rows of `file_runs`, marks: rows of `run_marks`, fragments: with the texts."""
        known = self.read()
        lack = marks if known is None else marks.join(known.select(*RUN).distinct(), RUN, "left_anti")
        if not lack.limit(1).count():
            return
        # only lengths are cut; each text is moved twice, to its batch's number and to its batch
        f = runs.select("target", "ord", "run", "n").join(lack.select("target", "run", "occurrence", "run_mark"), ["target", "run"])
        f = f.withColumn("_unit", F.concat_ws("\n", "target", F.col("run").cast("string")))
        cut = batches.assign_batches(f, target="_unit", same=(), limit=limit, keep=("target", "occurrence", "run_mark", "n")).drop("_unit")
        rows = batches.batch_rows(fragments.join(cut, ["target", "ord"]), RUN, "ord")
        with lean_shuffles(self.spark):
            rows.select(*RUN, F.col("batch_ord").cast("int").alias("local"), "char_count", "pieces").write.mode("overwrite").parquet(f"{self.path}/{name}", **PACKED)

    def batches(self, marks: DataFrame) -> DataFrame:
        """(target, batch_ord, batch_id, source_file, repo_dir, occurrence, local, char_count, pieces), numbered in the target."""
        found = self.read()
        per = found.groupBy(*RUN).agg(F.max("local").alias("_n")).join(marks.select(*RUN, "run"), RUN)
        before = ordered.running_sum(per, ["target"], "run", "_n", "_upto").select(*RUN, (F.col("_upto") - F.col("_n")).alias("_before"))
        out = found.join(before, RUN).withColumn("batch_ord", F.col("_before") + F.col("local"))
        return out.withColumn("batch_id", F.format_string("batch_%06d", "batch_ord")).drop("_before", "run_mark")


def _table(spark: SparkSession, path: str, commits: Commits) -> DataFrame:
    """The rows of a stored table that the targets' current snapshots hold."""
    now = commits.current().where("is_completed").select("target", "snapshot")
    return spark.read.parquet(path).withColumn("snapshot", F.col("snapshot").cast("string")).join(now, ["target", "snapshot"], "left_semi").drop("snapshot")


def run(
    spark: SparkSession, fragments: DataFrame, themes: list[str], screeners: dict[str, object], folder: str, limit: int = batches.LIMIT,
    tell: Callable[[str, dict], None] = lambda kind, what: None, force: bool | Collection[str] = False, wave_fragments: int = 2_000_000, wave_targets: int = 1000,
) -> Outcome:
    """fragments: target, ord (whole number, unique in a target), piece_id, source_file, repo_dir, original_text.

    screeners: llm1, llm2, llm3. folder: shared by driver and executors; holds logs, packs, commits, snapshots of what was
    found (disputes, final_records), records (JSON lines by target) and manual_review, a queue that grows. Targets that
    aren't finished go in waves of about wave_fragments fragments and wave_targets targets; their fragments are dealt to the waves
    once, and a wave is committed when it is done. A target with unanswered requests fails alone, at the end Paused is raised. force: all targets, or those named, are
    done and asked anew. Of fragments with one piece_id in a target the last is looked up, though batches keep all.
    """
    state, commits = f"{folder}/run_state.json", Commits(spark, f"{folder}/commits")
    turn = int(read_json(spark, state).get("runs", 0))
    models = {s: getattr(screeners[s], "name", screeners[s].model) for s in (*JUDGES, "llm3")}
    settings = fingerprint(version=VERSION, themes=themes, limit=limit, models=models)
    update_json(spark, state, phase="started", fingerprint=settings, runs=turn + 1, last_error="")
    try:
        since = commits.version()
        content = F.concat_ws("-", F.lit(settings), F.count(F.lit(1)), F.hex(F.bit_xor(F.xxhash64(*sorted(fragments.columns)))), F.hex(F.bit_xor(F.hash(*sorted(fragments.columns)))))
        marks = fragments.groupBy("target").agg(content.alias("mark"), F.count(F.lit(1)).alias("rows"))
        now = commits.current().select("target", "is_completed", "fingerprint", "epoch")
        forced = F.lit(force) if isinstance(force, bool) else F.col("target").isin(*force) if force else F.lit(False)
        marks = marks.join(now, "target", "left").withColumn("forced", forced)
        # a run that was killed while it was forced goes on with its own answers
        marks = marks.withColumn("epoch", F.coalesce("epoch", F.lit(0)) + F.col("forced").cast("int"))
        done = F.coalesce(F.col("is_completed") & (F.col("fingerprint") == F.col("mark")) & ~F.col("forced"), F.lit(False))
        path = f"{folder}/marks"
        marks.select("target", "mark", "rows", "epoch", done.alias("done")).write.mode("overwrite").parquet(path)
        marks = spark.read.parquet(path)
        n, rows = marks.where("not done").agg(F.count(F.lit(1)), F.sum("rows")).first()
        tell("targets", {"reused": marks.where("done").count(), "to_do": n})
        waves = max(-(-n // wave_targets), -(-(rows or 0) // wave_fragments))
        marks = marks.where("not done").withColumn("wave", F.pmod(F.xxhash64("target"), F.lit(max(waves, 1))))
        failed: dict[str, str] = {}
        dealt = f"{folder}/dealt"
        if n:
            wave_of = marks.select("target", "wave")
            rows = fragments.select(*FRAGMENT).join(F.broadcast(wave_of) if n <= FEW else wave_of, "target")
            with lean_shuffles(spark):
                rows.write.mode("overwrite").partitionBy("wave").parquet(dealt, **PACKED)
        for k in range(waves):
            own = [r.asDict() for r in marks.where(F.col("wave") == k).collect()]  # about wave_targets
            if own:
                wave = _Wave(spark, folder, screeners, themes, models, limit, turn, commits, since, own, tell)
                since = wave.run(spark.read.schema(fragments.select(*FRAGMENT).schema).parquet(f"{dealt}/wave={k}"))
                failed |= wave.failed
                delete(spark, f"{dealt}/wave={k}")
        summary = expand_counts(commits.current().where("is_completed"), COUNTS)
        if failed:
            raise Paused("; ".join(sorted(set(failed.values()))[:5]))
        update_json(spark, state, phase="completed")
        tell("phase", {"phase": "completed"})
        read = lambda name: _table(spark, f"{folder}/{name}", commits) if exists(spark, f"{folder}/{name}") else None
        queue = spark.read.parquet(f"{folder}/manual_review") if exists(spark, f"{folder}/manual_review") else None
        return Outcome(read("final_records"), summary, queue, read("disputes"))
    except Exception as x:
        update_json(spark, state, phase="failed", last_error=_said(x))
        raise


class _Wave:
    """Some targets on their way through all stages."""

    def __init__(self, spark, folder, screeners, themes, models, limit, turn, commits, since, own, tell):
        self.spark, self.folder, self.screeners, self.themes, self.models, self.limit, self.turn = spark, folder, screeners, themes, models, limit, turn
        self.commits, self.since, self.tell = commits, since, tell
        self.alive = {r["target"]: r for r in own}
        self.failed: dict[str, str] = {}
        self.snapshot = f"{turn:06d}-{uuid.uuid4().hex[:12]}"

    def names(self, targets) -> DataFrame:
        # as an Arrow table it is part of the plan; a list would go through Python workers
        columns = {"target": pa.array(list(targets), pa.string()), "epoch": pa.array([self.alive[t]["epoch"] for t in targets], pa.int32())}
        return F.broadcast(self.spark.createDataFrame(pa.table(columns)))

    def commit(self, phase: str, targets, **more) -> None:
        rows = [{"target": t, "phase": phase, "fingerprint": self.alive[t]["mark"], "snapshot": self.snapshot, "epoch": self.alive[t]["epoch"], **{k: v.get(t) if isinstance(v, dict) else v for k, v in more.items()}} for t in sorted(targets)]
        if rows:
            self.since = self.commits.commit(rows, self.since)

    def phase(self, name: str) -> None:
        update_json(self.spark, f"{self.folder}/run_state.json", phase=name)
        self.at = name
        self.commit(name, self.alive)
        self.tell("phase", {"phase": name})

    def stored(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}/snapshot={self.snapshot}"
        with lean_shuffles(self.spark):
            df.write.mode("overwrite").parquet(path, **PACKED)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        """Tables of this wave that nothing reads any more."""
        for name in tables:
            delete(self.spark, f"{self.folder}/{name}/snapshot={self.snapshot}")

    def ask(self, stage: str, slot: str, requests: DataFrame) -> DataFrame:
        """The answers. Targets of which some are missing fail here and take no further part."""
        log = ResponseLog(self.spark, f"{self.folder}/{stage}_{slot}")
        who = fingerprint(version=VERSION, model=self.models[slot])
        asked = log.ask(self.screeners[slot], requests, stage, slot, who, self.turn, along=("target",))
        answers = self.stored(f"answers_{stage}_{slot}", asked.select("target", "key", "status", "payload", "error"))
        # a row for each target of the wave
        n = lambda d, k: d.groupBy("target").agg(F.sum(F.lit(k)).alias("n"))
        left = n(requests, 1).unionByName(n(answers, -1)).groupBy("target").agg(F.sum("n").alias("count")).where("count > 0").collect()
        self.tell("answers", {"stage": stage, "slot": slot, "pending": sum(r["count"] for r in left)})
        lost = {r["target"]: f"{stage}, {slot}: {r['count']} requests without an answer" for r in left}
        if lost:
            self.commit(self.at, lost, error=lost)
            self.failed |= lost
            self.alive = {t: r for t, r in self.alive.items() if t not in lost}
        return answers

    def still(self, df: DataFrame) -> DataFrame:
        """Rows of targets that go on."""
        return df.join(self.names(self.alive).select("target"), "target", "left_semi") if self.failed else df

    def run(self, fragments: DataFrame) -> int:
        try:
            self._run(fragments)
        except Exception as x:
            self.commit(getattr(self, "at", "started"), self.alive, error=_said(x))
            raise
        finally:
            self.drop(*(n for n in names(self.spark, self.folder) if n in OWN or n.startswith("answers_")))
        return self.since

    def _run(self, fragments: DataFrame) -> None:
        themes, spark = self.themes, self.spark
        literals, by_index = screening.theme_literals(themes)
        numbered = F.array(*(F.struct(F.lit(i).alias("idx"), F.lit(t.strip()).alias("theme")) for i, t in enumerate(themes, 1) if t.strip()))
        ids = F.col("pieces.piece_id").alias("piece_ids")

        self.phase("batches")
        # of fragments with one piece_id the last is looked up
        repeated = bool(fragments.groupBy("target", "piece_id").count().where("count > 1").limit(1).count())
        looked_up = fragments.select("target", "piece_id", "ord", "source_file", "original_text")
        looked_up = (dedupe.last_wins(looked_up, ["target", "piece_id"], ["ord"]) if repeated else looked_up).drop("ord")
        runs = self.stored("file_runs", file_runs(fragments))
        marks = self.stored("runs", run_marks(runs))
        packs = Packs(spark, f"{self.folder}/packs")
        packs.add_missing(fragments, runs, marks, self.limit, self.snapshot)
        b = packs.batches(marks).join(self.names(self.alive), "target")
        # a key that stays while the batch does, wherever it stands; asked anew where the target is forced
        key = [F.col("target"), F.when(F.col("epoch") > 0, F.concat(F.lit("e"), F.col("epoch").cast("string"))), F.col("source_file"), F.col("repo_dir"), F.col("occurrence").cast("string"), F.col("local").cast("string")]
        text = F.array_join("pieces.original_text", "\n\n")
        prompt = screening.coarse_prompt(numbered, F.col("source_file"), F.col("batch_text")).alias("prompt")
        b = b.withColumn("key", F.concat_ws("::", *key)).drop("epoch").withColumn("batch_text", text).withColumn("prompt", prompt)
        b = self.stored("batches", with_asked(b).drop("batch_text", "prompt"))

        self.phase("coarse_screening")
        requests = b.select("target", "key", "asked", text.alias("batch_text"), "source_file", "char_count").select("*", prompt).drop("source_file")
        asked = {s: self.ask("coarse", s, requests) for s in JUDGES}
        b = self.still(b)
        positive = []
        for s in JUDGES:
            judged = F.coalesce(modeljson.coarse(F.col("payload"), literals, by_index)["themes"], F.transform(literals, lambda t: F.struct(t.alias("theme"), F.lit(False).alias("is_relevant"))))
            positive.append(screening.coarse_positives(asked[s].select("key", "status", judged.alias("themes")), ["key"]))
        pairs = screening.candidate_pairs(*positive).join(b.select("key", "target", "source_file", "pieces"), "key").withColumn("key", F.concat_ws("::", "key", "theme"))
        if repeated:
            piece = pairs.select("key", "target", "theme", F.col("source_file").alias("_file"), F.posexplode(ids).alias("pos", "piece_id")).join(looked_up, ["target", "piece_id"])
            pieces = F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece_id", "original_text"))), lambda x: F.struct(x["piece_id"].alias("piece_id"), x["original_text"].alias("original_text")))
            pairs = piece.groupBy("target", "key", "theme", F.col("_file").alias("source_file")).agg(pieces.alias("pieces"))
        prompt = screening.targeted_prompt(F.col("theme"), F.col("source_file"), F.col("pieces")).alias("prompt")
        pairs = self.stored("pairs", with_asked(pairs.select("target", "key", "theme", "source_file", "pieces", prompt)).drop("prompt"))
        b = self.stored("batch_ids", b.select("key", "target", "source_file", ids))  # what is still asked of them
        self.drop("batches")

        self.phase("targeted_screening")
        targeted = {s: self.ask("targeted", s, pairs.select("target", "key", "asked", prompt, "theme", "pieces")) for s in JUDGES}
        pairs, b = self.still(pairs), self.still(b)
        verdicts = {}
        for s in JUDGES:
            targeted[s] = targeted[s].drop("target").join(pairs.select("key", "target", "theme", ids), "key")
            every = F.transform("piece_ids", lambda p: F.struct(p.alias("piece_id"), F.lit(True).alias("is_relevant"), F.lit(modeljson.MANUAL).alias("reason")))
            results = F.when(_manual(), every).otherwise(modeljson.targeted(F.col("payload"), F.col("piece_ids"))["results"])
            rows = targeted[s].select("target", "theme", "status", F.col("key").alias("ord"), results.alias("results"))
            verdicts[s] = screening.flatten_targeted(rows, ["target"], s)

        self.phase("arbitration")
        keys, texts = ["target", "piece_id", "theme"], ["source_file", "original_text"]
        both = adjudicate.pair_verdicts(verdicts["llm1"], verdicts["llm2"], keys).join(looked_up, ["target", "piece_id"])
        both = self.stored("verdicts", both)
        agreed, disputed = adjudicate.consensus(both), adjudicate.disputes(both)
        disputed = disputed.withColumn("dispute_key", F.concat_ws("::", "target", "dispute_key"))
        self.stored("disputes", disputed.drop(*texts))
        prompt = screening.arbitration_prompt(F.col("piece_id"), F.col("theme"), F.col("original_text"), F.col("llm1_result"), F.col("llm2_result")).alias("prompt")
        key = F.concat_ws("::", "dispute_key", F.when(F.col("epoch") > 0, F.concat(F.lit("e"), F.col("epoch").cast("string"))))
        requests = disputed.join(self.names(self.alive), "target").withColumn("key", key)
        requests = self.stored("arbitration", with_asked(requests.select("target", "dispute_key", "key", "piece_id", "theme", "original_text", "llm1_result", "llm2_result", prompt)).drop("prompt"))
        answers = self.ask("arbitration", "llm3", requests.select("target", "dispute_key", "key", "asked", prompt, "original_text", "theme")).join(requests.select("key", "dispute_key"), "key")
        agreed, disputed, b, pairs = (self.still(x) for x in (agreed, disputed, b, pairs))
        ruled = modeljson.ruling(F.col("payload"))
        rulings = answers.select("dispute_key", (_manual() | ruled["is_relevant"]).alias("is_relevant"), F.when(_manual(), modeljson.MANUAL).otherwise(ruled["reason"]).alias("reason"))

        final = adjudicate.final_records(agreed, disputed, rulings, [*keys, *texts])
        final = self.stored("final_records", final.select("target", "piece_id", F.col("theme").alias("matched_theme"), "judgment", "note", "needs_manual_review", *texts))
        found = self._review({s: asked[s].drop("target").join(b, "key") for s in JUDGES}, {s: self.still(targeted[s]) for s in JUDGES}, looked_up, literals)
        self._records(final)
        parts = {
            "repo_dir_count": self.still(runs).select("target", "repo_dir").distinct(), "fragment_count": self.still(runs), "batch_count": b, "candidate_pair_count": pairs,
            "consensus_count": agreed, "dispute_count": disputed, "manual_review_count": found,
        }
        summary = {r["target"]: r.asDict() for r in adjudicate.full_summary(parts, final).collect()}  # a row for each target of the wave
        self.at = "completed"
        self.commit("completed", self.alive, is_completed=True, counts={t: {c: summary[t][c] for c in COUNTS} for t in self.alive})

    def _review(self, coarse: dict, targeted: dict, looked_up: DataFrame, literals) -> DataFrame:
        """New entries join the queue; all entries of the wave's targets."""
        rows = lambda d, **own: d.withColumns(own).select("target", "key", "piece_ids", "source_file", "theme", literals.alias("themes"), "status", "error")
        found, gave_up = None, False
        for s in JUDGES:
            for stage, d in (("coarse", rows(coarse[s], theme=F.lit(None).cast("string"))), ("targeted", rows(targeted[s], source_file=F.lit("")))):
                one = review.review_entries(d, looked_up, stage, ("target",))
                found = one if found is None else found.unionByName(one)
                answers = self.spark.read.parquet(f"{self.folder}/answers_{stage}_{s}/snapshot={self.snapshot}")
                gave_up = gave_up or bool(answers.where(_manual()).limit(1).count())
        found, queue = found.dropDuplicates(["manual_review_key"]), f"{self.folder}/manual_review"
        if not gave_up:  # texts needn't be looked up
            found = no_rows(self.spark, found.schema)
        if exists(self.spark, queue):
            if gave_up:
                known = self.spark.read.parquet(queue).select("manual_review_key")
                found.join(known, "manual_review_key", "left_anti").write.mode("append").parquet(queue)
        else:
            found.write.parquet(queue)
        return self.still(self.spark.read.schema(found.schema).parquet(queue))

    def _records(self, final: DataFrame) -> None:
        """The targets' record files, replaced; a target without records has none."""
        path = f"{self.folder}/records"
        left = {r["target"] for r in final.select("target").distinct().collect()}
        for t in set(self.alive) - left:
            delete(self.spark, f"{path}/target={t}")
        with lean_shuffles(self.spark):
            record_files.write_records(final, path)
