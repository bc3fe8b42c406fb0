"""Library-shaped projections of the driver's tables; one SQL text serves Spark and DuckDB.

The attributes are synthetic arithmetic over keys, not audio measurements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRACKS = """SELECT CAST(p_partkey AS BIGINT) AS ord, concat('t', CAST(p_partkey AS STRING)) AS track_id,
 concat(CASE WHEN p_partkey % 23 = 5 THEN '' ELSE '/' END, 'lib/', p_brand, '/', CAST(p_partkey AS STRING), '/', p_name,
   CASE p_partkey % 6 WHEN 0 THEN concat(' (Dj Beats) ', CAST(60 + p_partkey % 141 AS STRING))
                      WHEN 1 THEN concat(' [', CAST(50 + p_partkey % 171 AS STRING), ']')
                      WHEN 2 THEN concat(' ', CAST(60 + p_partkey % 141 AS STRING), ' BPM') ELSE '' END,
   CASE WHEN p_partkey % 8 = 7 THEN '.flac' ELSE '.mp3' END) AS file_path,
 concat('h', CAST(p_partkey - CASE WHEN p_partkey % 10 = 9 THEN 1 ELSE 0 END AS STRING)) AS file_hash,
 p_name AS title, p_brand AS artist, CASE WHEN p_partkey % 13 = 6 THEN NULL ELSE concat('Album ', CAST(p_size AS STRING)) END AS album, CASE WHEN p_partkey % 9 = 4 THEN NULL ELSE p_type END AS genre,
 CAST(180 + (p_partkey * 53) % 40 AS DOUBLE) / CAST(2 AS DOUBLE) AS duration_sec,
 CAST(1700000000000 + ((p_partkey * 7919) % 100003) * 1000 AS BIGINT) AS added_at
FROM {part}"""

ANALYSES = """SELECT concat('t', CAST(p_partkey AS STRING)) AS track_id,
 CAST(700 + (p_partkey * 7919) % 1100 AS DOUBLE) / CAST(10 AS DOUBLE) AS bpm,
 CAST((p_partkey * 613) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS bpm_confidence,
 CAST(p_partkey % 7 AS DOUBLE) / CAST(20 AS DOUBLE) AS first_beat,
 concat(CAST(1 + (p_partkey * 5) % 12 AS STRING), CASE WHEN p_partkey % 5 < 2 THEN 'A' ELSE 'B' END) AS camelot,
 CAST((p_partkey * 389) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS key_confidence,
 CAST((p_partkey * 101) % 997 AS DOUBLE) / CAST(997 AS DOUBLE) AS energy_mean,
 CASE p_partkey % 10 WHEN 0 THEN 'unreliable' WHEN 1 THEN 'partial' WHEN 2 THEN 'partial' ELSE 'good' END AS quality,
 CAST((p_partkey * 71) % 240 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(24 AS DOUBLE) AS integrated_lufs
FROM {part} WHERE p_partkey % 17 <> 0"""

QUEUE = """SELECT CAST(l_orderkey AS BIGINT) AS queue_id,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS pos,
 concat('t', CAST(l_partkey AS STRING)) AS track_id
FROM {lineitem}"""

HISTORY = """SELECT CAST(user_id AS BIGINT) AS session_id,
 CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos,
 concat('t', CAST((event_id * 31) % 200 AS STRING)) AS track_id, CAST(value AS DOUBLE) AS value
FROM {events}"""

SOURCES = {"tracks": (TRACKS, "part"), "analyses": (ANALYSES, "part"), "queue": (QUEUE, "lineitem"), "history": (HISTORY, "events")}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A library table; other names are the driver's own tables."""
    if name not in SOURCES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, table = SOURCES[name]
    return spark.sql(text, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def duck(*names: str) -> str:
    """The WITH list of the named tables, for DuckDB."""
    return ",\n".join(f"{n} AS ({SOURCES[n][0].format(**{SOURCES[n][1]: SOURCES[n][1]})})" for n in names)
