"""Streams: the batch operators over new documents, aliases as keyed state, and event windows (our own extras).

Defined cases: a document id that was seen is not scanned again, whatever its text; a null id is an id; mentions of a batch are taken in the order of
document and place; empty batches write nothing of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.operators.recognizers import detections
from spanloom.sources.tables import table


def scan_stream(stream: DataFrame, out: str, checkpoint: str):
    """Detections of each new document, once: ids that were seen are kept as state across batches (their first row counts), each
    micro-batch goes through the batch scan, and its part of out is written anew if the batch is run again."""

    def each(batch: DataFrame, number: int) -> None:
        detections(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.dropDuplicates(["doc_id"]).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ALIASES = "scope string, category string, key string, alias string"


def _allocate(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = json.loads(state.get[0]) if state.exists else {}
    new = []
    for frame in frames:
        for key in frame.sort_values(["doc_id", "start_cp"], kind="stable")["key"]:
            if key not in known:
                known[key] = f"{group[1]}_{len(known) + 1}"
                new.append((group[0], group[1], key, known[key]))
    state.update((json.dumps(known),))
    yield pd.DataFrame(new, columns=["scope", "category", "key", "alias"])


def allocate_aliases(mentions: DataFrame) -> DataFrame:
    """New aliases of a stream of mentions (scope, category, key, doc_id, start_cp): numbers only grow, and an alias once given is
    never given again. The state of a scope and category is its mapping."""
    return mentions.groupBy("scope", "category").applyInPandasWithState(_allocate, ALIASES, "known string", "append", GroupStateTimeout.NoTimeout)


def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type."""
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))
    return rows.select(F.unix_timestamp("w.start").alias("hour"), "event_type", "n", "n_users")


TUMBLING_SQL = "SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2"


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions per user: events with gaps of less than 30 minutes."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
    return rows.select("user_id", "n", "first_event")


SESSION_SQL = """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY user_id, s
"""

QUERIES = [("tumbling_events", tumbling_events, TUMBLING_SQL), ("session_events", session_events, SESSION_SQL)]
