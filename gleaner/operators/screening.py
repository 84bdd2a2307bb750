"""Screening: two screeners over every batch and theme, the union of their hits, then every fragment of a hit.

A screener maps requests (key, prompt and payload columns) to answers (key, status, payload). `RuleScreener` is a
column predicate; `ReplayScreener` joins recorded answers; `RemoteScreener` calls a client from executors.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.modeljson import MANUAL
from ..sources.journal import Journal
from ..sources.pacing import Pace
from .dedupe import last_wins

ANSWER = "key string, status string, payload string, error string, attempts int, model string, provider string, usage string"
KINDS = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.string()) for c in ANSWER.split(", ")])
#: statuses that hold; others are asked again
ANSWERED = ("ok", "fallback", "manual")
#: what a prompt costs of a rate of tokens
CHARS_A_TOKEN = 4


@dataclass(frozen=True)
class RuleScreener:
    """Deterministic: payload(requests' columns) is the answer. The hash of what was asked, where there is one, goes along."""

    payload: Column
    model: str = "rule"

    #: answers cost no request, so a log takes them all at once
    local = True

    def screen(self, requests: DataFrame) -> DataFrame:
        return requests.select("key", *(c for c in ("asked",) if c in requests.columns), F.lit("ok").alias("status"), self.payload.alias("payload"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("attempts"))


@dataclass(frozen=True)
class ReplayScreener:
    """Recorded answers (key, status, payload, error, attempts, ord): of several for a key the last holds."""

    recorded: DataFrame
    model: str = "recorded"

    def screen(self, requests: DataFrame) -> DataFrame:
        last = last_wins(self.recorded, ["key"], ["ord"]).drop("ord")
        return requests.select("key").join(last, "key")


class FormatError(ValueError):
    """An answer that can't be read: the only error that the fallback is asked about."""


class RequestError(RuntimeError):
    """A request that the service refused: asking again the same way won't help."""


class Busy(RequestError):
    """A refusal for now (rate limits, server errors): asking again later may help. retry_after: seconds, where the service says so."""

    def __init__(self, said: str, retry_after: float | None = None):
        super().__init__(said)
        self.retry_after = retry_after


class Reply(str):
    """A text with what is known of its making."""

    usage: dict
    model: str
    provider: str

    def __new__(cls, text: str, usage: dict | None = None, model: str = "", provider: str = ""):
        out = super().__new__(cls, text)
        out.usage, out.model, out.provider = usage or {}, model, provider
        return out


@dataclass(frozen=True)
class RemoteScreener:
    """Calls make_client()(prompt, key_name) -> text or Reply on executors, `threads` at a time in each partition.

    Keys rotate from an offset by partition, at the rates of `pacing.Pace`. Answers that `check` rejects (FormatError) go
    to the fallback up to `retries` times and then become status "manual". Network errors and Busy refusals are tried again
    `network_retries` times, with the next key, after what the service asks for or else `wait` seconds, doubled each time,
    and then become status "error", as other refusals (RequestError) do at once. With a journal each answer is
    on shared storage before the next is asked, and a task's next attempt takes them over. Tasks may run twice, so
    callers log answers and read them back once for each key.
    """

    make_client: Callable[[], Callable[[str, str], str]]
    api_keys: tuple[str, ...] = ("default",)
    make_fallback: Callable[[], Callable[[str, str], str]] | None = None
    check: Callable[[str], object] = json.loads
    threads: int = 8
    partitions: int = 8
    retries: int = 3
    network_retries: int = 5
    wait: float = 0.0
    #: part of the log's fingerprint: answers of another model don't count; where it is blank, the client's own
    model: str = ""
    requests_per_minute: float | None = None
    tokens_per_minute: float | None = None

    durable = True

    @property
    def name(self) -> str:
        """The model's name, or the client's, with its address."""
        if self.model:
            return self.model
        client = self.make_client()
        return "@".join(str(x) for x in (getattr(client, "model", ""), getattr(client, "base_url", "")) if x)

    def screen(self, requests: DataFrame, journal: str | None = None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client, fallback = self.make_client(), self.make_fallback and self.make_fallback()
            turn = TaskContext.get().partitionId()
            pace = Pace(self.requests_per_minute, self.tokens_per_minute, self.partitions)
            log = Journal(journal, turn, TaskContext.get().taskAttemptId()) if journal else None
            known = {(r.get("key"), r.get("asked")): r for r in log.earlier()} if log else {}

            def ask(call, prompt, start):
                for k in range(self.network_retries + 1):
                    name = pace.take(self.api_keys, start + k, len(prompt) // CHARS_A_TOKEN)
                    try:
                        text = call(prompt, name)
                        break
                    except (Busy, OSError) as x:
                        if k == self.network_retries:
                            raise
                        after = getattr(x, "retry_after", None)
                        pause = self.wait * 2**k if after is None else after
                        pace.block(name, pause) if isinstance(x, Busy) else time.sleep(pause)
                try:
                    self.check(text)
                except ValueError as x:
                    raise FormatError(str(x)) from None
                return text

            def answer(key, status, text, error, attempts) -> dict:
                usage = getattr(text, "usage", None)
                about = {"model": getattr(text, "model", "") or self.model, "provider": getattr(text, "provider", ""), "usage": json.dumps(usage, ensure_ascii=False) if usage else None}
                return {"key": key, "status": status, "payload": None if text is None else str(text), "error": error, "attempts": attempts, **about}

            def judge(i: int, key: str, prompt: str) -> dict:
                try:
                    return answer(key, "ok", ask(client, prompt, turn + i), None, 1)
                except FormatError as x:
                    error = str(x)
                except OSError as x:
                    return answer(key, "error", None, f"network: {x}", 1)
                except RequestError as x:
                    return answer(key, "error", None, f"request: {x}", 1)
                if fallback is None:
                    return answer(key, "format_error", None, error, 1)
                for k in range(self.retries):
                    try:
                        return answer(key, "fallback", ask(fallback, prompt, turn + i), error, k + 2)
                    except (FormatError, OSError, RequestError):
                        continue
                return answer(key, "manual", None, error, self.retries + 1)

            def one(at: tuple[int, str, str]) -> dict:
                i, key, prompt = at
                asked = hashlib.sha256((prompt or "").encode()).hexdigest() if log else ""
                if (key, asked) in known:
                    return known[key, asked]
                row = judge(i, key, prompt)
                if log and row["status"] in ANSWERED:
                    log.add(row | {"asked": asked})
                return row

            try:
                with ThreadPoolExecutor(self.threads) as pool:
                    seen = 0
                    for b in batches:
                        work = [(seen + i, k, p) for i, (k, p) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))]
                        seen += len(work)
                        for s in range(0, len(work), 64):  # a bounded number of calls is under way
                            yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in KINDS.names} for r in pool.map(one, work[s : s + 64])], schema=KINDS)
            finally:
                if log:
                    log.close()

        return requests.select("key", "prompt").repartition(self.partitions, "key").mapInArrow(run, ANSWER)


def theme_table(themes: Column) -> Column:
    """array<struct<idx, theme>> of an array of names: numbers from 1 over all positions, blanks left out."""
    from ..functions.pytext import strip

    numbered = F.transform(themes, lambda t, i: F.struct((i + 1).alias("idx"), strip(t).alias("theme")))
    return F.filter(numbered, lambda x: F.coalesce(x["theme"], F.lit("")) != "")


def theme_literals(themes: Sequence[str]) -> tuple[Column, Column]:
    """The names and the map from number to name of themes known to the driver: constants, folded by the optimizer."""
    kept = [(i, t.strip()) for i, t in enumerate(themes, 1) if t.strip()]
    return F.array(*(F.lit(t) for _, t in kept)), F.create_map(*(F.lit(x) for pair in kept for x in pair))


def coarse_positives(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, theme) that a screener called relevant. answers: keys, status, themes array<struct<theme, is_relevant>>.

    Where a screener gave up (status manual) every theme counts as relevant.
    """
    # outer, and filtered afterwards: else Spark infers filters on themes and reads each answer once more for them
    t = answers.select(*keys, "status", F.explode_outer("themes").alias("t")).where("t is not null")
    return t.where(F.col("t.is_relevant") | (F.col("status") == "manual")).select(*keys, F.col("t.theme").alias("theme"))


def candidate_pairs(first: DataFrame, *more: DataFrame) -> DataFrame:
    """The distinct pairs that any screener called relevant."""
    for side in more:
        first = first.unionByName(side)
    return first.distinct()


def flatten_targeted(rows: DataFrame, keys: list[str], slot: str, order: str = "ord") -> DataFrame:
    """One verdict for each (keys, piece_id, theme): the last. rows: keys, theme, order, status, results."""
    flat = rows.select(*keys, "theme", order, "status", F.explode_outer("results").alias("r")).where("r is not null")
    manual = (F.col("status") == "manual") | (F.col("r.reason") == MANUAL)
    flat = flat.select(*keys, F.col("r.piece_id").alias("piece_id"), "theme", order, F.col("r.is_relevant").alias("is_relevant"), F.col("r.reason").alias("reason"), manual.alias("needs_manual_review"), F.lit(slot).alias("slot"))
    return last_wins(flat, [*keys, "piece_id", "theme"], [order]).drop(order)


def coarse_prompt(themes: Column, source: Column, text: Column) -> Column:
    listed = F.array_join(F.transform(themes, lambda x: F.concat(x["idx"].cast("string"), F.lit(": "), x["theme"])), "\n")
    return F.concat_ws("\n\n", listed, source, text)


def targeted_prompt(theme: Column, source: Column, pieces: Column) -> Column:
    """pieces: array<struct<piece_id, original_text>>."""
    blocks = F.array_join(F.transform(pieces, lambda p: F.concat(F.lit("### "), p["piece_id"], F.lit("\n"), p["original_text"])), "\n\n")
    return F.concat_ws("\n\n", theme, source, blocks)


def arbitration_prompt(piece_id: Column, theme: Column, text: Column, l1: Column, l2: Column) -> Column:
    return F.to_json(F.struct(piece_id.alias("piece_id"), theme.alias("theme"), text.alias("original_text"), l1.alias("llm1"), l2.alias("llm2")))
