"""Plans for imports: what is queued, what is left out and why, and where things belong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def queue(entries: DataFrame) -> DataFrame:
    """Entries with reason (null: accepted) and queue_number among the accepted.

    ``entries``: position, video_id, title, duration, resolvable.  Reasons apply in order:
    missing_video_id_or_title, video_unavailable, missing_duration, duplicate_in_playlist (all
    but the first of an id that passed the others).  The running number is summed over
    ranges of positions only after entries that are left out have gone.
    """
    blank = F.coalesce(F.trim("title"), F.lit("")) == ""
    reason = (
        F.when((F.coalesce("video_id", F.lit("")) == "") | blank, "missing_video_id_or_title")
        .when(F.col("resolvable") == False, "video_unavailable")  # noqa: E712
        .when(F.coalesce(F.col("duration"), F.lit(0)) <= 0, "missing_duration")
    )
    rows = entries.withColumn("reason", reason)
    rows = rows.withColumn("nth", F.expr("row_number() OVER (PARTITION BY video_id, reason IS NULL ORDER BY position)"))
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("nth") > 1), "duplicate_in_playlist").otherwise(F.col("reason"))).drop("nth")
    return number(rows, "reason IS NULL")


#: Blocks of positions, whose counts one task sums.
BLOCKS = 65_536


def number(rows: DataFrame, counted: str, order: str = "position", block: int | None = None) -> DataFrame:
    """Adds queue_number, 1, 2, ... over the ``counted`` rows by ``order``, null for others.

    Positions are cut into BLOCKS blocks at most, or blocks of a given width; the counts of the
    blocks are summed (one row for each block), and numbers run within a block, so no task
    orders the whole list.
    """
    if block is None:
        ends = rows.agg(F.min(order).alias("a"), F.max(order).alias("z")).first()
        block = max(4096, -(-int((ends.z or 0) - (ends.a or 0) + 1) // BLOCKS))
    held = rows.withColumn("__block", F.floor(F.col(order) / block)).withColumn("__one", F.when(F.expr(counted), 1).otherwise(0))
    sums = held.groupBy("__block").agg(F.sum("__one").alias("__n"))
    before = sums.select("__block", F.expr("sum(__n) OVER (ORDER BY __block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - __n").alias("__before"))
    inside = held.withColumn("__in", F.expr(f"sum(__one) OVER (PARTITION BY __block ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    out = inside.join(before, "__block").withColumn("queue_number", F.when(F.col("__one") == 1, F.col("__before") + F.col("__in")))
    return out.drop("__block", "__one", "__in", "__before")


def assign_trees(members: DataFrame, rules: DataFrame, fallback: str) -> DataFrame:
    """(item, tree, reason): of an item's playlists the rule with the least priority number decides.

    ``members``: item, playlist (null: none); ``rules``: playlist, tree, priority.  Different
    trees of equal priority are ambiguous and go to the fallback, as do items without a known playlist.
    """
    ruled = members.join(rules, "playlist", "left")
    best = ruled.groupBy("item").agg(F.min("priority").alias("best"), F.count("playlist").alias("playlists"))
    top = ruled.join(best, "item").where("priority = best").groupBy("item").agg(F.array_sort(F.collect_set("tree")).alias("trees"), F.min("playlist").alias("by"))
    rows = best.join(top, "item", "left")
    one = F.size("trees") == 1
    return rows.select(
        "item",
        F.when(one, F.col("trees")[0]).otherwise(F.lit(fallback)).alias("tree"),
        F.when(one, F.col("by"))
        .when(F.col("trees").isNotNull(), F.concat(F.lit("ambiguous:"), F.array_join("trees", "+")))
        .when(F.col("playlists") == 0, "no_playlist")
        .otherwise("unmapped_playlist")
        .alias("reason"),
    )


def overlay_state(found: DataFrame, state: DataFrame) -> DataFrame:
    """Discovered items with the status they had before; new ones are ``queued``."""
    rows = found.join(state.select("item", F.col("status").alias("old"), "error"), "item", "left")
    return rows.withColumn("status", F.coalesce("old", F.lit("queued"))).drop("old")


def resume_point(state: DataFrame, terminal: tuple[str, ...] = ("imported", "skipped")) -> DataFrame:
    """The first item, by position, that is not done."""
    return state.where(~F.col("status").isin(*terminal)).orderBy("position").limit(1)
