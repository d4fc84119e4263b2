"""Input views over the tables of a data folder, written once for Spark and DuckDB.

A view is SQL text with {table} for tables and other views; where the two dialects differ, a pair of texts. Spark resolves
a table to parquet.`path`, so pruning and pushdown reach the files.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"}

#: Words per second and the pause after a line, in ms: a line of n words lasts n * 400 + 1000.
VIEWS: dict[str, str | tuple[str, str]] = {
    "segments": """
        SELECT conv_id AS session_id, turn AS pos, 'S' || CAST(CAST((conv_id + floor(turn / 2)) % 3 AS INT) AS STRING) AS speaker, role,
          CASE role WHEN 'user' THEN 'mic' ELSE 'monitor' END AS source, text, n_words,
          CAST((SUM(dur) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - dur AS BIGINT) AS start_ms,
          CAST((SUM(dur) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS BIGINT) AS end_ms
        FROM (SELECT *, n_words * 400 + 1000 AS dur FROM
          (SELECT *, CAST(length(text) - length(replace(text, ' ', '')) + 1 AS BIGINT) AS n_words FROM {conversations}) a) b""",
    "turns": """
        SELECT session_id, pos AS turn_pos, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS cluster,
          start_ms + 700 * (pos % 3) AS start_ms, end_ms + 500 * (pos % 2) AS end_ms FROM {segments} s""",
    "ext_spans": "SELECT session_id, 'N' || CAST(cluster AS STRING) AS name, start_ms + 37000 AS start_ms, end_ms + 37000 AS end_ms FROM {turns} t",
    "looks": """
        SELECT session_id, turn_pos AS look_id, start_ms + 300 * (turn_pos % 4) AS t, cluster, turn_pos % 9 = 4 AS several,
          CASE WHEN turn_pos % 9 = 4 THEN '' WHEN cluster = 0 THEN 'Ann Lee' WHEN cluster = 1 THEN 'Bo Kimura' ELSE 'Cleo' END AS name FROM {turns} t""",
    "people": """
        SELECT session_id, cluster, label, CASE WHEN session_id % 5 = 0 AND cluster = 1 THEN 'Ann Lee' WHEN cluster = 0 THEN 'Ann Lee' WHEN cluster = 1 THEN 'Bo Kimura' ELSE '' END AS name
        FROM (SELECT DISTINCT session_id, cluster, 'Person ' || CAST(cluster + 1 AS STRING) AS label FROM {turns} t) p""",
    "words": (
        """SELECT session_id, pos, CAST(i AS BIGINT) AS w_pos, word, start_ms + (end_ms - start_ms) * i div n_words AS start_ms, start_ms + (end_ms - start_ms) * (i + 1) div n_words AS end_ms
        FROM (SELECT session_id, pos, n_words, start_ms, end_ms, posexplode(split(text, ' ')) AS (i, word) FROM {segments} s) w""",
        """SELECT session_id, pos, CAST(i - 1 AS BIGINT) AS w_pos, ws[i] AS word, start_ms + (end_ms - start_ms) * (i - 1) // n_words AS start_ms, start_ms + (end_ms - start_ms) * i // n_words AS end_ms
        FROM (SELECT *, string_split(text, ' ') AS ws, unnest(range(1, n_words + 1)) AS i FROM {segments} s) w""",
    ),
    "event_ms": (
        "SELECT event_id, timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS t, user_id, event_type, value, props FROM {events}",
        "SELECT event_id, epoch_us(ts) // 1000 AS t, user_id, event_type, value, props FROM {events}",
    ),
    "hints": "SELECT user_id AS session_id, t, event_id, event_type AS name FROM {event_ms} e",
    "segment_events": """
        SELECT user_id AS session_id, event_id % 20 AS seg_id, CAST(row_number() OVER (PARTITION BY user_id, event_id % 20 ORDER BY t, event_id) AS BIGINT) AS seq,
          CASE event_type WHEN 'view' THEN 'live' WHEN 'click' THEN 'pending' WHEN 'error' THEN 'removed' ELSE '' END AS status,
          'S' || CAST(event_id % 7 AS STRING) AS speaker FROM {event_ms} e""",
    "stream_events": "SELECT user_id AS pid, t, event_id, event_type AS kind FROM {event_ms} e",
    "fingerprints": "SELECT vec_id, vec_id % 10 AS session_id, vec_id AS chunk, embedding, label, CASE WHEN label < 3 THEN 'tile' || CAST(label AS STRING) END AS tile FROM {embeddings}",
    "vector_parts": (
        "SELECT vec_id, label, CAST(i AS BIGINT) AS i, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, label, posexplode(embedding) AS (i, x) FROM {embeddings}) p",
        "SELECT vec_id, label, CAST(i - 1 AS BIGINT) AS i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM {embeddings}) p",
    ),
    "voice_sums": "SELECT label, vec_id % 2 AS kind, i, SUM(x) AS s, CAST(COUNT(*) AS BIGINT) AS n FROM {vector_parts} v GROUP BY label, vec_id % 2, i",
}


def expand(sql: str, dialect: str, sf_dir: str = "") -> str:
    """sql with {names} replaced: views by their text, tables by parquet paths (spark) or names (duckdb)."""

    def put(m: re.Match) -> str:
        name = m[1]
        if name in VIEWS:
            text = VIEWS[name]
            return f"({expand(text if isinstance(text, str) else text[dialect == 'duckdb'], dialect, sf_dir)})"
        if name in TABLES:
            return f"parquet.`{sf_dir}/{name}.parquet`" if dialect == "spark" else name
        raise KeyError(name)

    return re.sub(r"(?<!\\p)\{(\w+)\}", put, sql)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or table as a DataFrame."""
    return spark.sql(expand(f"SELECT * FROM {{{name}}} v", "spark", sf_dir))


def duckdb(sql: str) -> str:
    return expand(sql, "duckdb")
