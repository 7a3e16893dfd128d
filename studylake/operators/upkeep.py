"""Upkeep of stored rows: duplicates merged into survivors, stray copies by containment, single use of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def duplicates(rows: DataFrame, by: list[str], order: str, allowed: DataFrame) -> DataFrame:
    """loser, survivor for rows that are once too often in a group: columns `by` and `order` (unique), allowed: name (the last of `by`), n.

    A group may have as many rows as one book lists its name (one where none does); rows beyond that, in order, go into the group's first.
    """
    name = by[-1]
    entitled = rows.join(allowed.select(name, F.greatest(F.col("n"), F.lit(1)).alias("__n")), name, "left")
    w = Window.partitionBy(*by).orderBy(order)
    placed = entitled.withColumn("__rn", F.row_number().over(w)).withColumn("survivor", F.first(order).over(w))
    return placed.where(F.col("__rn") > F.coalesce("__n", F.lit(1))).select(*by, F.col(order).alias("loser"), "survivor")


def moved_links(links: DataFrame, merged: DataFrame, key: str, other: str) -> DataFrame:
    """links (key, other and more columns) after a merge: those of losers are their survivors', unless the survivor has that `other` already; of several
    losers' links the one that the smallest loser had counts. moved says which are new."""
    to = merged.select(F.col("loser").alias(key), "survivor")
    each = links.join(to, key, "left").withColumn("moved", F.col("survivor").isNotNull()).withColumn("__from", F.col(key)).withColumn(key, F.coalesce("survivor", key))
    first = F.min_by(F.struct(*[c for c in each.columns if c not in (key, other, "__from", "survivor")]), F.struct("moved", "__from"))
    return each.groupBy(key, other).agg(first.alias("__r")).select(key, other, "__r.*")


def contained_strays(rows: DataFrame, originals: DataFrame, by: list[str], key: str, text: str, head: int = 80, window: int = 100, least: int = 20) -> DataFrame:
    """Keys of rows in whose first `window` letters the first `head` letters of an original of equal `by`, another row, stand.

    Only letters count. An original of under `least` letters matches nothing. A row offers the hash of each stretch of `least` letters of its window, and
    where an original's head begins with one, the hashes of the stretches from there that are as long as the heads that begin so; equal ones meet and are
    compared as texts. So a row moves once for each letter of its window, however the lengths of heads are spread.
    """
    # a text is read up to its last letter that counts
    letters = lambda n: F.regexp_replace(F.regexp_extract(text, r"^(?:[^\p{L}]*+\p{L}){0,%d}" % n, 0), r"[^\p{L}]+", "")
    heads = originals.select(*by, F.col(key).alias("__original"), letters(head).alias("__head")).withColumn("__n", F.length("__head")).where(F.col("__n") >= least)
    # an original's key is needed only to tell it from the row itself: two of each head are enough
    known = heads.groupBy(*by, "__n", "__head").agg(F.min("__original").alias("__low"), F.max("__original").alias("__high")).withColumn("__h", F.xxhash64(*by, "__head"))
    starts = heads.groupBy(F.xxhash64(*by, F.left("__head", F.lit(least))).alias("__s")).agg(F.collect_set("__n").alias("__sizes"))  # head - least + 1 numbers at most
    wide = rows.select(*by, key, letters(window).alias("__w"))
    at = F.sequence(F.lit(1), F.length("__w") - least + 1)
    # hashes of groups too, so that names of groups do not move with each stretch
    offered = wide.where(F.length("__w") >= least).select(*by, key, F.explode(at).alias("__i"), "__w").select(F.xxhash64(*by, key).alias("__k"), "__i", F.xxhash64(*by, F.substring("__w", F.col("__i"), F.lit(least))).alias("__s"))
    begun = offered.join(starts, "__s").select("__k", "__i", F.explode("__sizes").alias("__n"))
    cut = wide.withColumn("__k", F.xxhash64(*by, key)).join(begun, "__k").where(F.col("__i") + F.col("__n") - 1 <= F.length("__w"))
    cut = cut.withColumn("__c", F.substring("__w", F.col("__i"), F.col("__n"))).select(*by, key, "__n", "__c", F.xxhash64(*by, "__c").alias("__h"))
    met = cut.join(known, [*by, "__n", "__h"]).where((F.col("__c") == F.col("__head")) & ((F.col("__low") != F.col(key)) | (F.col("__high") != F.col(key))))
    return met.select(key).distinct()


def use_once(state: DataFrame, requests: DataFrame, token: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(state after, outcome: order, token, granted). state: token, used_by (null while unused); requests: token, order (unique).

    The update of a token that is unused goes to its first request; the others, those of used tokens and those of unknown ones are refused.
    """
    first = requests.groupBy(token).agg(F.min(order).alias("__first"))
    free = state.where(F.col("used_by").isNull()).join(first, token).select(token, F.col("__first").alias("__won"))
    after = state.join(free, token, "left").select(token, F.coalesce("used_by", "__won").alias("used_by"))
    outcome = requests.join(free, token, "left").select(order, token, F.coalesce(F.col("__won") == F.col(order), F.lit(False)).alias("granted"))
    return after, outcome


def excerpt(text: Column, longest: int = 120) -> Column:
    """The first characters of a text with its white space as single spaces."""
    return F.left(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "), F.lit(longest))


def session_search(messages: DataFrame, queries: list[str], session: str, turn: str, role: str, text: str, folded: Column) -> DataFrame:
    """query, session, messages (of the session), found (those with the query in their folded text), excerpt of the best: the user's before others', then
    the first. Queries are folded and literal, a few of them; a session is one group of small rows, as whole texts are cut to excerpts first."""
    held = F.array_compact(F.array(*[F.when(F.contains(F.lower(folded), F.lit(q)), q) for q in queries]))
    told = messages.select(session, turn, (F.col(role) != "user").alias("__other"), excerpt(F.col(text)).alias("excerpt"), held.alias("__q"))
    sizes = told.groupBy(session).agg(F.count("*").alias("messages"))
    hits = told.select("*", F.explode("__q").alias("query"))
    best = hits.groupBy("query", session).agg(F.count("*").alias("found"), F.min_by("excerpt", F.struct("__other", turn)).alias("excerpt"))
    return best.join(sizes, session).select("query", session, "messages", "found", "excerpt")
