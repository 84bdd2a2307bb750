"""Extensions for growing corpora: documents that arrive as files, and projects' actions as a stream.

A batch run is the special case of one micro-batch; both use the operators of the batch jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..jobs.screen import final_records
from ..operators.progress import Progress, ProgressError, step


def screen_arrivals(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Screen the documents of files as they arrive, each file once. A repeated micro-batch overwrites its own output."""

    def write(batch: DataFrame, epoch: int) -> None:
        final_records(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    docs = spark.readStream.schema(schema).parquet(folder)
    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_STATE = "status string, completed array<string>, current string, cursor string, last_piece string, note string, run_count long, piece_count long, errors long"
_OUT = "project long, status string, current string, n_completed long, cursor string, last_piece string, note string, run_count long, piece_count long, errors long"


def progress_stream(actions: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """Each project's progress after each micro-batch of actions (project, seq, action, target, delta; cursor, piece and note where there are such columns).

    Actions are applied in the order of seq within a micro-batch.
    """

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            status, completed, current, cursor, piece, note, runs, pieces, errors = state.get
            p = Progress(status, tuple(completed), current, cursor, piece, note, run_count=runs, piece_count=pieces, targets=targets)
        else:
            p, errors = Progress(targets=targets), 0
        for f in sorted(frames, key=lambda f: f.seq.min()):
            for row in f.sort_values("seq").itertuples():
                try:
                    more = (getattr(row, c, None) for c in ("cursor", "piece", "note"))
                    p = step(p, row.action, row.target or "", *more, delta=int(row.delta))
                except ProgressError:
                    errors += 1
        state.update((p.status, list(p.completed), p.current, p.cursor, p.last_piece, p.note, p.run_count, p.piece_count, errors))
        yield pd.DataFrame([{"project": key[0], "status": p.status, "current": p.current, "n_completed": len(p.completed), "cursor": p.cursor, "last_piece": p.last_piece, "note": p.note, "run_count": p.run_count, "piece_count": p.piece_count, "errors": errors}])

    return actions.groupBy("project").applyInPandasWithState(update, _OUT, _STATE, "update", "NoTimeout")


