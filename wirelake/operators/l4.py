"""Transport streams with window functions: what of each TCP segment is new, counts, closing and idle connections."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where sequence numbers start again.
WRAP = 4294967295


def connection_id(src_ip: str = "src_ip", src_port: str = "src_port", dst_ip: str = "dst_ip", dst_port: str = "dst_port") -> Column:
    """The same text for both directions."""
    a, b = F.concat_ws(":", src_ip, src_port), F.concat_ws(":", dst_ip, dst_port)
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def cursor(segments: DataFrame, stream: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds closed, skip, trim, gap and delivered to segments with seq, len and fin.

    In order of arrival a stream keeps the highest end that it has seen: a segment that ends at or below it is skipped, one that begins below it loses the overlap, one
    that begins above it leaves a gap, which is accepted. After a segment with fin the stream is closed and later segments are refused. Segments without payload count, but
    move nothing. One shuffle by stream serves all of it.
    """
    arrival = Window.partitionBy(*stream).orderBy(*order)
    before = arrival.rowsBetween(Window.unboundedPreceding, -1)
    upto = arrival.rowsBetween(Window.unboundedPreceding, 0)
    df = segments.withColumn("closed", F.coalesce(F.max(F.col("fin").cast("int")).over(before), F.lit(0)) == 1)
    used = ~F.col("closed") & (F.col("len") > 0)
    end = F.col("seq").cast("bigint") + F.col("len")
    df = df.withColumn("_wrap", (used & (end >= WRAP)).cast("int"))
    df = df.withColumn("_end", F.when(used, end - F.col("_wrap") * F.lit(WRAP)))
    df = df.withColumn("_epoch", F.sum("_wrap").over(upto))
    inside = Window.partitionBy(*stream, "_epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.when(F.col("_wrap") == 1, F.lit(0)).otherwise(F.coalesce(F.max("_end").over(inside), F.lit(0)))
    return _delivered(df.withColumn("_reached", reached), used).drop("_wrap", "_end", "_epoch", "_reached")


def cursor_by_stretch(segments: DataFrame, stream: Sequence[str], order: Sequence[str], stretch: Column) -> DataFrame:
    """As ``cursor``, for streams that may hold a large share of all segments: ``stretch`` numbers stretches of a stream, which must not fall along ``order``.

    A stretch is summed up by whether it has a fin, whether sequence numbers start again in it, and the highest end since they did (or in all of it). These few rows say what
    each stretch begins with, as both carry over associatively; then the stretches go through their windows apart from one another. No task needs more than one stretch of
    segments, or the summaries of one stream.
    """
    part = [*stream, "_stretch"]
    df = segments.withColumn("_stretch", stretch)
    among = Window.partitionBy(*stream).orderBy("_stretch")
    earlier = among.rowsBetween(Window.unboundedPreceding, -1)
    fins = df.groupBy(*part).agg(F.max(F.col("fin").cast("int")).alias("_fin")).withColumn("_shut", F.coalesce(F.max("_fin").over(earlier), F.lit(0)))
    df = df.join(fins.select(*part, "_shut"), part)
    arrival = Window.partitionBy(*part).orderBy(*order)
    before, upto = arrival.rowsBetween(Window.unboundedPreceding, -1), arrival.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("closed", (F.col("_shut") == 1) | (F.coalesce(F.max(F.col("fin").cast("int")).over(before), F.lit(0)) == 1))
    used = ~F.col("closed") & (F.col("len") > 0)
    end = F.col("seq").cast("bigint") + F.col("len")
    df = df.withColumn("_wrap", (used & (end >= WRAP)).cast("int"))
    df = df.withColumn("_end", F.when(used, end - F.col("_wrap") * F.lit(WRAP))).withColumn("_epoch", F.sum("_wrap").over(upto))
    # What a stretch leaves behind: the highest end of its last epoch; and what all up to it do, where an epoch goes on over stretches until one has a wrap.
    tails = df.groupBy(*part, "_epoch").agg(F.max("_end").alias("_tail")).groupBy(*part).agg(F.max_by("_tail", "_epoch").alias("_tail"), F.max("_epoch").alias("_wraps"))
    tails = tails.withColumn("_age", F.sum((F.col("_wraps") > 0).cast("int")).over(among.rowsBetween(Window.unboundedPreceding, 0)))
    left = tails.withColumn("_left", F.max("_tail").over(Window.partitionBy(*stream, "_age").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, 0)))
    carried = left.select(*part, F.coalesce(F.lag("_left").over(among), F.lit(0)).alias("_carried"))
    df = df.join(carried, part)
    inside = Window.partitionBy(*part, "_epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.max("_end").over(inside), F.lit(0))
    reached = F.when(F.col("_wrap") == 1, F.lit(0)).when(F.col("_epoch") == 0, F.greatest(own, F.col("_carried"))).otherwise(own)
    return _delivered(df.withColumn("_reached", reached), used).drop("_wrap", "_end", "_epoch", "_reached", "_stretch", "_shut", "_carried")


def _delivered(df: DataFrame, used: Column) -> DataFrame:
    """skip, trim, gap and delivered from how far a stream has come before each segment."""
    df = df.withColumn("skip", used & (F.col("_reached") >= F.col("_end")))
    df = df.withColumn("trim", F.when(used & ~F.col("skip"), F.greatest(F.lit(0), F.col("_reached") - F.col("seq"))))
    df = df.withColumn("gap", used & ~F.col("skip") & (F.col("_reached") > 0) & (F.col("_reached") < F.col("seq")))
    return df.withColumn("delivered", F.when(used & ~F.col("skip"), F.col("len") - F.col("trim")).otherwise(0))


def statistics(cursored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Packets, payload bytes before any trimming, and skipped segments, of streams not yet closed."""
    open_ = cursored.where(~F.col("closed"))
    return open_.groupBy(*by).agg(F.count("*").alias("packets"), F.sum(F.col("len").cast("bigint")).alias("bytes"), F.count_if("skip").alias("skipped"))


def idle_epochs(rows: DataFrame, connection: Sequence[str], ts: str, order: Sequence[str], seconds: int = 300) -> DataFrame:
    """Adds epoch: it rises where a connection was silent for longer than ``seconds`` (exactly that long keeps it)."""
    w = Window.partitionBy(*connection).orderBy(*order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    fresh = F.coalesce(micros - F.lag(micros).over(w) > seconds * 1_000_000, F.lit(False))
    return rows.withColumn("_new", fresh.cast("int")).withColumn("epoch", F.sum("_new").over(w)).drop("_new")


def closing_epochs(rows: DataFrame, connection: Sequence[str], direction: str, order: Sequence[str]) -> DataFrame:
    """Adds epoch and refused to rows with fin: what a direction sends after its fin is refused and ends the connection; rows after that belong to a new one, in which both
    directions are open again.

    Which fin counts depends on where the last connection ended, so the rows are read on in order; a task holds the state of one connection. The cursor of the new
    connection starts afresh where ``epoch`` is among its stream columns.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        epoch, closed = 0, set()
        for b in batches:
            epochs, refused = [], []
            for *own, side, fin in zip(*(b[c] for c in (*connection, direction, "fin"))):
                if own != now:
                    now, epoch, closed = own, 0, set()
                epochs.append(epoch)
                refused.append(side in closed)
                if refused[-1]:
                    epoch, closed = epoch + 1, set()
                elif fin:
                    closed.add(side)
            yield b.assign(epoch=epochs, refused=refused)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "epoch bigint, refused boolean"])
    return rows.repartition(*connection).sortWithinPartitions(*connection, *order).mapInPandas(run, schema)


def connections(rows: DataFrame, connection: Sequence[str], ts: str) -> DataFrame:
    """One row for each epoch of each connection: first and last packet and their number. ``rows`` have an epoch."""
    return rows.groupBy(*connection, "epoch").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("packets"))


def frozen(rows: DataFrame, stream: Sequence[str], ts: str, order: Sequence[str], closing: Column, seconds: int = 120) -> DataFrame:
    """Adds frozen: whether a row comes within ``seconds`` after the last closing row before it."""
    w = Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    last = F.last(F.when(closing, micros), ignorenulls=True).over(w)
    return rows.withColumn("frozen", F.coalesce(micros - last <= seconds * 1_000_000, F.lit(False)))
