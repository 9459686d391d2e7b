"""Pairing requests with responses.

Rows are messages of connections with a role (Request or Response), in order. Where a matcher's memory cannot overflow its result is a matter of counting, and window
functions give it; ``bounded`` runs the rest, with eviction, and is fed only with connections that may overflow.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REQUEST, RESPONSE = "Request", "Response"


def single(messages: DataFrame, connection: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """One request may wait. A second one drops both; a response with none waiting is dropped.

    So within a run of requests they cancel in twos: the last of an odd run is answered by the next row. Columns of ``carry`` come out as req_ and rsp_.
    """
    w = Window.partitionBy(*connection).orderBy(*order)
    df = messages.withColumn("_turn", F.coalesce((F.col("role") != F.lag("role").over(w)).cast("int"), F.lit(1)))
    df = df.withColumn("_run", F.sum("_turn").over(w))
    df = df.withColumn("_place", F.row_number().over(Window.partitionBy(*connection, "_run").orderBy(*order)))
    df = df.withColumn("_next", F.lead("role").over(w))
    df = df.withColumns({f"rsp_{c}": F.lead(c).over(w) for c in carry})
    # The last request of a run has a response after it, so its place is the length of the run.
    pairs = df.where((F.col("role") == REQUEST) & (F.col("_next") == RESPONSE) & (F.col("_place") % 2 == 1))
    return pairs.select(*connection, *[F.col(c).alias(f"req_{c}") for c in carry], *[f"rsp_{c}" for c in carry])


def _sides(df: DataFrame, keys: Sequence[str], number: str, carry: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    cols = lambda p: [F.col(c).alias(f"{p}_{c}") for c in carry]
    return tuple(df.where(F.col("role") == r).select(*keys, number, *cols(p)) for r, p in ((REQUEST, "req"), (RESPONSE, "rsp")))


def by_key(messages: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Any number of requests may wait; a response takes the first with its key, one without is dropped.

    With +1 for a request and -1 for a response, a response finds nothing where the running sum falls below all it was before, and below 0. The rest pair in order: the
    j-th request and the j-th response are brought together in one aggregate, so the rows are shuffled once.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    df = messages.withColumn("_sum", F.sum(F.when(F.col("role") == REQUEST, 1).otherwise(-1)).over(w))
    low = F.coalesce(F.min("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("_orphan", (F.col("role") == RESPONSE) & (F.col("_sum") < F.least(F.lit(0), low)))
    return _zip(df.where(~F.col("_orphan")), keys, order, carry)


def fuzzy(messages: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Either side may come first: the j-th request and the j-th response of a key belong together."""
    return _zip(messages, keys, order, carry)


def _zip(df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    df = df.withColumn("_j", F.row_number().over(Window.partitionBy(*keys, "role").orderBy(*order)))
    side = lambda r, c: F.max(F.when(F.col("role") == r, F.col(c)))
    out = df.groupBy(*keys, "_j").agg(F.count("*").alias("_n"), *[side(REQUEST, c).alias(f"req_{c}") for c in carry], *[side(RESPONSE, c).alias(f"rsp_{c}") for c in carry])
    return out.where("_n = 2").drop("_n", "_j")


def unanswered(messages: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Requests that ``by_key`` leaves without a response."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = messages.withColumn("_sum", F.sum(F.when(F.col("role") == REQUEST, 1).otherwise(-1)).over(w))
    low = F.coalesce(F.min("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("_orphan", (F.col("role") == RESPONSE) & (F.col("_sum") < F.least(F.lit(0), low))).where(~F.col("_orphan"))
    df = df.withColumn("_answers", F.count_if(F.col("role") == RESPONSE).over(Window.partitionBy(*keys)))
    df = df.where(F.col("role") == REQUEST).withColumn("_j", F.row_number().over(w))
    return df.where(F.col("_j") > F.col("_answers")).select(*keys, *carry)


def mark_overflow(messages: DataFrame, connection: Sequence[str], key: str, order: Sequence[str], size: int) -> DataFrame:
    """Adds overflow: whether more than ``size`` requests were ever waiting on the connection. Where it is false, ``by_key`` gives what a list of that size gives."""
    keyed = Window.partitionBy(*connection, key).orderBy(*order)
    step = F.when(F.col("role") == REQUEST, 1).otherwise(-1)
    df = messages.withColumn("_sum", F.sum(step).over(keyed))
    low = F.coalesce(F.min("_sum").over(keyed.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    orphan = (F.col("role") == RESPONSE) & (F.col("_sum") < F.least(F.lit(0), low))
    df = df.withColumn("_step", F.when(orphan, 0).otherwise(step))
    df = df.withColumn("_open", F.sum("_step").over(Window.partitionBy(*connection).orderBy(*order)))
    return df.withColumn("overflow", F.max("_open").over(Window.partitionBy(*connection)) > size).drop("_sum", "_step", "_open")


def mark_fuzzy_overflow(messages: DataFrame, connection: Sequence[str], key: str, order: Sequence[str], size: int) -> DataFrame:
    """Adds overflow: whether a message ever came to a full list where either side may wait. Where it is false, ``fuzzy`` gives what a list of that size gives.

    Of a key the messages that wait are the difference of both sides so far; a message adds to the list or takes from it by how that difference changes.
    """
    step = F.when(F.col("role") == REQUEST, 1).otherwise(-1)
    df = messages.withColumn("_sum", F.sum(step).over(Window.partitionBy(*connection, key).orderBy(*order)))
    df = df.withColumn("_step", F.abs("_sum") - F.abs(F.col("_sum") - step))
    df = df.withColumn("_open", F.sum("_step").over(Window.partitionBy(*connection).orderBy(*order)) - F.col("_step"))
    # Whatever comes to a full list drops its oldest, a mate or not.
    return df.withColumn("overflow", F.max("_open").over(Window.partitionBy(*connection)) >= size).drop("_sum", "_step", "_open")


def bounded(messages: DataFrame, connection: Sequence[str], key: str, order: Sequence[str], size: int, carry: str, either_first: bool = False) -> DataFrame:
    """(connection, req, rsp): as ``by_key`` or ``fuzzy`` with at most ``size`` waiting; the oldest goes when another comes and the list is full.

    The work of a connection is a fold over its messages with a list of bounded length; only the columns it needs are shuffled. Sorted partitions are read on in order, so that
    memory does not grow with a connection.
    """
    cols = list(dict.fromkeys([*connection, "role", key, *order, carry]))
    n = len(connection)
    places = [cols.index(c) for c in ("role", key, carry)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        waiting: list[tuple[str, object, object]] = []
        for b in batches:
            pairs = []
            values = [[None if x is pd.NA or x is pd.NaT or x != x else x for x in b[c]] for c in b.columns]
            for row in zip(*values):
                if row[:n] != now:
                    now, waiting = row[:n], []
                role, k, value = (row[i] for i in places)
                if (either_first or role == REQUEST) and len(waiting) >= size:
                    waiting.pop(0)
                other = RESPONSE if role == REQUEST else REQUEST
                found = next((i for i, x in enumerate(waiting) if x[0] == other and x[1] == k), None) if either_first or role == RESPONSE else None
                if found is not None:
                    mate = waiting.pop(found)[2]
                    pairs.append((*now, *((mate, value) if role == RESPONSE else (value, mate))))
                elif either_first or role == REQUEST:
                    waiting.append((role, k, value))
            yield pd.DataFrame(pairs, columns=[*connection, "req", "rsp"])

    types = dict(messages.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in connection), f"req {types[carry]}", f"rsp {types[carry]}"])
    return messages.select(*cols).repartition(*connection).sortWithinPartitions(*connection, *order).mapInPandas(run, schema)


#: Methods that answer, besides those whose name ends in -Ok.
AMQP_ANSWERS = ("Ack", "Nack", "Reject")


def amqp(messages: DataFrame, connection: Sequence[str], order: Sequence[str], carry: Sequence[str], size: int | None = None) -> DataFrame:
    """Pairs AMQP method frames with channel, class and method.

    Frames pair within channel and class; on channel 0, which carries the connection itself, an answer must also bear the name of what it answers. Written as a key, that
    is ``fuzzy`` matching. Where messages have a role (Request from the client, Response from the server) only frames of opposite sides pair. Which of a pair asks follows
    from the method, as servers deliver and clients acknowledge: where the client's is an answer the two change places. Without a role the methods alone tell the sides.
    With ``size`` no more than that many frames wait on a connection.
    """
    answers = F.col("method").endswith("-Ok") | F.col("method").isin(*AMQP_ANSWERS)
    asked = F.when(F.col("channel") == 0, F.regexp_replace("method", "-Ok$", "")).otherwise("")
    spoken = "role" in messages.columns
    named = messages.withColumns({"asked": asked, "_answers": answers & F.lit(spoken)})
    if not spoken:
        named = named.withColumn("role", F.when(answers, RESPONSE).otherwise(REQUEST))
    kept = [*carry, "_answers"]
    cols = [*connection, "channel", "class", *[f"{p}_{c}" for p in ("req", "rsp") for c in kept]]
    if size is None:
        pairs = fuzzy(named, [*connection, "channel", "class", "asked"], order, kept)
    else:
        named = named.withColumns({"_key": F.concat_ws(" ", "channel", "class", "asked"), "_own": F.struct("channel", "class", *kept)})
        marked = mark_fuzzy_overflow(named, connection, "_key", order, size)
        folded = bounded(marked.where("overflow"), connection, "_key", order, size, "_own", either_first=True)
        folded = folded.select(*connection, "req.channel", "req.class", *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("req", "rsp") for c in kept])
        pairs = fuzzy(marked.where("NOT overflow"), [*connection, "channel", "class", "asked"], order, kept).select(*cols).unionByName(folded)
    swap = lambda a, b, c: F.when(F.col("req__answers"), F.col(f"{b}_{c}")).otherwise(F.col(f"{a}_{c}")).alias(f"{a}_{c}")
    return pairs.select(*connection, "channel", "class", *[swap("req", "rsp", c) for c in carry], *[swap("rsp", "req", c) for c in carry])
