"""Queries of matches, batch forms of transactional work, and expansions."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.functions.core import half_up
from studylake.operators import layout, retrieval
from studylake.operators import relational as R
from studylake.plans.retrieval import COS
from studylake.registry import query
from studylake.sources import files
from studylake.sources.tables import table as t

c = F.col


#: The words of each turn, and their places in the conversation's stream, in which a word that no turn has stands after every second word of a turn.
STREAM = r"""w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM conversations),
b AS (SELECT *, coalesce(sum(len(w) + len(w) // 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM w),
s AS (SELECT conv_id, list(x ORDER BY turn, k) AS ws, list(base + k - 1 + (k - 1) // 2 ORDER BY turn, k) AS places FROM (SELECT conv_id, turn, base, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM b) GROUP BY 1)"""


@query("l01_matches", f"""
WITH {STREAM}, h AS (SELECT conv_id, turn, list_slice(w, 1, 7) AS p FROM w WHERE len(w) > 0),
found AS (SELECT conv_id, turn, len(p) AS n, places[i] AS place, places[i + len(p) - 1] - places[i] + 1 - len(p) AS skipped FROM (SELECT *, unnest(range(1, len(ws) - len(p) + 2)) AS i FROM h JOIN s USING (conv_id)) WHERE list_slice(ws, i, i + len(p) - 1) = p)
SELECT conv_id, turn, floor(n / (n + turn % 2) * 1000 + 0.5) / 1000 AS score, CAST(skipped AS INTEGER) AS skipped, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY skipped, place) AS k FROM found) WHERE k = 1""")
def l01_matches(s, d):
    """The best place of each turn's first seven words in its conversation's stream, in which foreign words stand between them; every second turn's probe
    ends in a word that the stream has not, so it is not found whole. Found through an index of places."""
    split = F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    turns = t(s, d, "conversations").select("conv_id", "turn", split.alias("w"))
    streams = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "w"))).alias("x"))

    def best(rows):
        for turns in rows:
            places = layout.Places([x for turn in turns for k, w in enumerate(turn["w"]) for x in ([w, "\x00"] if k % 2 else [w])])
            probes = ((turn["turn"], [*turn["w"][:7], *["\x01"] * (turn["turn"] % 2)]) for turn in turns if len(turn["w"]))
            yield [{"turn": int(turn), **dict(zip(("score", "skipped", "place"), places.matches(probe)[0], strict=True))} for turn, probe in probes]

    import pandas as pd

    found = F.pandas_udf(lambda rows: pd.Series(list(best(rows))), "array<struct<turn:long,score:double,skipped:int,place:long>>")
    told = streams.select("conv_id", F.explode(found("x")).alias("m"))
    return told.select("conv_id", "m.turn", half_up(c("m.score"), 3).alias("score"), "m.skipped", c("m.place").cast("int").alias("place"))


# ---- batch forms of transactional work
@query("n04_single_use", "SELECT user_id AS token, min(event_id) AS used_by, count(*) - 1 AS refused FROM events WHERE event_type = 'click' GROUP BY 1")
def n04_single_use(s, d):
    """Each token is used by its first request; the others are refused. One grouped pass, which gives the same on every run."""
    asked = t(s, d, "events").where("event_type = 'click'")
    return asked.groupBy(c("user_id").alias("token")).agg(F.min("event_id").alias("used_by"), (F.count("*") - 1).alias("refused"))


@query("n05_work_claims", "SELECT o_orderkey, o_custkey % 8 AS worker, ceil(row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderdate, o_orderkey) / 100)::BIGINT AS batch FROM orders WHERE o_orderstatus = 'O'")
def n05_work_claims(s, d):
    """Open work dealt to workers by key and to batches by age: no two claim one row, and none waits for another."""
    rows = t(s, d, "orders").where("o_orderstatus = 'O'").withColumn("worker", c("o_custkey") % 8)
    placed = R.row_numbers(rows, ["worker"], ["o_orderdate", "o_orderkey"])
    return placed.select("o_orderkey", "worker", F.ceil(c("rn") / 100).alias("batch"))


@query("n09_published", "SELECT 'nation' AS part, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def n09_published(s, d):
    """Several tables change together: all are written beside the old ones, then one pointer to them; readers follow the pointer."""
    path = files.shared_path(s, "published")
    files.publish({"nation": t(s, d, "nation"), "region": t(s, d, "region")}, path)
    parts = files.published(s, path)
    return parts["nation"].agg(F.count("*").alias("n")).select(F.lit("nation").alias("part"), "n").unionByName(parts["region"].agg(F.count("*").alias("n")).select(F.lit("region").alias("part"), "n"))


@query("n11_guarded_write", "SELECT r_regionkey AS k FROM region")
def n11_guarded_write(s, d):
    """A write that names its target twice; it is refused where the names differ."""
    path = files.shared_path(s, "guarded")
    files.write_guarded(t(s, d, "region").select(c("r_regionkey").alias("k")), path, confirm=path)
    return s.read.schema("k int").parquet(path)


# ---- expansions
EXPANDED = f"SELECT a.vec_id - a.vec_id % 20 AS asked, b.vec_id, max({COS}) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 < 2 GROUP BY 1, 2"


@query("h22_expanded", f"SELECT asked, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY sim DESC, vec_id) AS rn FROM ({EXPANDED})) WHERE rn <= 5")
def h22_expanded(s, d):
    """Questions (ids divisible by 20) and their supplied expansion (the next vector): the best similarity that either reaches counts."""
    e = t(s, d, "embeddings")
    near = retrieval.knn(e.where("vec_id % 20 < 2"), e, ["label"], 10).withColumn("asked", c("probe_id") - c("probe_id") % 20)
    best = near.groupBy("asked", "vec_id").agg(F.max("sim").alias("sim"))
    return R.top_per_group(best, ["asked"], [F.desc("sim"), c("vec_id")], 5).select("asked", "vec_id", "sim")
