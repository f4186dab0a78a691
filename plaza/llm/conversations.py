"""Message rows to ordered conversations, by keyed streaming state.

Rows arrive as a stream in several micro-batches, in the order of a column
``order`` or, where a table keeps no order of arrival, in order of their times.
The stream is keyed by shard: a hash of the thread, so that one call serves the
open threads of some SHARD_ROWS rows (a key for each thread takes four times the
CPU in Python).  A state buffers the rows of its open threads, early or late; when the
event-time watermark has passed a thread's last row by ``GAP`` the thread is
closed: the state judges it, emits the ordered messages with their roles, or its
verdict, and forgets it.  The timer of a state is that of its first thread to
close.  A closing tick after the last arrival moves the watermark past every
thread that is still open.

No row may be lost to the watermark: threads whose emitted rows are fewer than
their arrivals (rows later than ``LATENESS``, or after a closure) and threads of
more than ``MAX_STATE`` rows are judged and ordered by joins over all their rows
instead, which gives the same rows, so neither lateness nor the size of a thread
changes a result.

Defined cases: repeated rows of an id are one row (of differing rows the least
counts); a row without thread belongs to its parent's thread, through any
number of such parents; a row that so finds no thread belongs to none; texts
that are null, white space or a bracketed removal marker are blank; times that
cannot be read are null and come last; ties of time go by id; an empty table
gives no threads; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plaza.lineage import counted, cut, drop_path, scratch_path
from plaza.operators.hierarchy import ancestors, parent_links
from plaza.operators.rank import grouped_rank
from plaza.operators.skew import collect_hot, lookup_join

#: Quiet time after which a thread is closed, and how late a row may be and still meet its thread's state.
GAP, LATENESS = "1 day", "7 days"
_GAP_US = 86_400_000_000
#: Rows of the largest thread whose rows are held in a state.
MAX_STATE = 20_000
#: Micro-batches at least, and rows of one at most.
BATCHES, BATCH_ROWS = 4, 50_000_000
#: Rows a shard serves on average over all batches.
SHARD_ROWS = 2_000
#: Verdicts in the order in which they are tried.
VERDICTS = ("roots", "orphan", "cycle", "empty", "unanswered")
_FAR, _OPEN_MS = "2200-01-01 00:00:00", 7_200_000_000_000
_TICK = -1
#: A row in a state is one text: its fields joined by _CUT, null as _NULL.
_CUT, _NULL = "\x01", "\x02"
_STATE = "rows array<string>"
_OUT = "thread string, n_rows long, verdict string, post_id array<string>, user_id array<string>, role array<string>, us array<long>"


def event_time(c: Column) -> Column:
    """A timestamp from text: epoch seconds, or ISO with blank or ``T``, fraction and zone; without zone it is UTC."""
    t = F.trim(c)
    zoned = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    iso = F.when(zoned, t).when(t.rlike(r"\d{2}:\d{2}"), F.concat(t, F.lit("Z"))).otherwise(t)
    return F.when(t.rlike(r"^\d{9,11}$"), F.timestamp_seconds(t.try_cast("long"))).otherwise(iso.try_cast("timestamp"))


def blank(c: Column) -> Column:
    """Null, white space only, or a bracketed removal marker only."""
    return c.isNull() | ~c.rlike(r"(?U)\S") | c.rlike(r"(?i)^\s*\[\s*(removed|deleted)[^\]]*\]\s*$")


def arrivals(df: DataFrame, order: str | None = None) -> DataFrame:
    """(thread, post_id, parent_id, user_id, at, blank, arrival): one row per message, with its thread and its place in the stream."""
    row = F.struct("thread_id", "parent_id", "user_id", event_time(F.col("timestamp")).alias("at"), blank(F.col("text")).alias("blank"))
    seen = df.filter("post_id IS NOT NULL").groupBy("post_id")
    one = seen.agg(F.min(row).alias("r"), *([F.min(order).cast("long").alias("arrival")] if order else [])).select("post_id", "r.*", *(["arrival"] if order else []))
    # Rows without time come first: they wait for the rows of their thread.
    place = F.col("arrival") if order else F.unix_micros("at")
    one = one.withColumn("arrival", F.when(F.col("at").isNotNull(), place))
    one = cut(one, "arrivals")
    open_ = one.filter("thread_id IS NULL AND parent_id IS NOT NULL").select("post_id", F.col("parent_id").alias("up"))
    known = one.select(F.col("post_id").alias("up"), F.col("thread_id").alias("t"), F.col("parent_id").alias("next"))
    found, left = None, open_.count()
    while left:
        step = cut(open_.join(known, "up"), "threads")
        got = step.filter("t IS NOT NULL").select("post_id", F.col("t").alias("thread"))
        found = got if found is None else found.unionByName(got)
        open_ = step.filter("t IS NULL AND next IS NOT NULL").select("post_id", F.col("next").alias("up"))
        n = open_.count()
        if n == left:  # only circles of rows without thread are left
            break
        left = n
    out = one.withColumn("thread", F.col("thread_id"))
    if found is not None:
        out = one.join(found, "post_id", "left").withColumn("thread", F.coalesce("thread_id", "thread"))
    return out.filter("thread IS NOT NULL").select("thread", "post_id", "parent_id", "user_id", "at", "blank", "arrival")


def judge(rows: list[list]) -> str | None:
    """The first verdict that holds for a thread's rows (post_id, parent_id, user_id, time, blank), or None."""
    parent = {r[0]: r[1] for r in rows}
    roots = [r for r in rows if r[1] is None]
    if len(roots) != 1:
        return "roots"
    if any(p is not None and p not in parent for p in parent.values()):
        return "orphan"
    safe = {roots[0][0]}
    for n in parent:
        chain = []
        while n not in safe:
            if n in chain[-1:] or len(chain) > len(parent):
                return "cycle"
            chain.append(n)
            n = parent[n]
        safe.update(chain)
    if all(r[4] for r in rows):
        return "empty"
    opener = roots[0][2]
    if not any(not r[4] and r[2] is not None and r[2] != opener for r in rows):
        return "unanswered"
    return None


def told(rows: list[list]) -> list[list]:
    """A sound thread's rows in order: the opener first, then by time, as ``ordered``."""
    root = next(r for r in rows if r[1] is None)
    first = root[3]

    def place(r: list) -> tuple:
        late = r[3] if r[3] is None or first is None else max(r[3], first)
        return r is not root, late is None, late or 0, r[0]

    return sorted(rows, key=place)


def packed() -> Column:
    """(thread, post_id, parent_id, user_id, time, blank) as the text of a state."""
    fields = ["thread", "post_id", "parent_id", "user_id", F.unix_micros("at").cast("string"), F.col("blank").cast("int").cast("string")]
    return F.concat_ws(_CUT, *[F.coalesce(c, F.lit(_NULL)) for c in fields])


def unpacked(text: str) -> tuple[str, list]:
    """Thread and [post_id, parent_id, user_id, time, blank] of a packed row."""
    thread, post, parent, user, us, blank_ = (None if x == _NULL else x for x in text.split(_CUT))
    return thread, [post, parent, user, None if us is None else int(us), blank_ == "1"]


def _closed(thread: str, rows: list[list]) -> list:
    verdict = judge(rows)
    order = told(rows) if verdict is None else []
    opener = order[0][2] if order else None
    return [thread, len(rows), verdict or "", [r[0] for r in order], [r[2] for r in order], ["opener" if r[2] == opener else "responder" for r in order], [r[3] for r in order]]


def _update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Buffer the rows of a shard's threads; emit the messages in order, or the verdict, of the threads that are closed."""
    held = list(state.get[0]) if state.exists else []
    if not state.hasTimedOut:
        for p in parts:
            held += p["row"].tolist()
    threads: dict[str, list[tuple[str, list]]] = {}
    for text in held:
        thread, row = unpacked(text)
        threads.setdefault(thread, []).append((text, row))
    # A thread without any time stays open to the tick.
    last = {t: max((r[3] for _, r in rows if r[3] is not None), default=None) for t, rows in threads.items()}
    closes = {t: _OPEN_MS if at is None else (at + _GAP_US) // 1000 for t, at in last.items()}
    now = state.getCurrentWatermarkMs()
    due = [t for t, at in closes.items() if at < now]
    if due and key[0] != _TICK:
        yield pd.DataFrame([_closed(t, [r for _, r in threads[t]]) for t in due], columns=_COLUMNS)
    gone = set(due)
    kept = [text for t, rows in threads.items() if t not in gone for text, _ in rows]
    if kept:
        state.update((kept,))
        state.setTimeoutTimestamp(max(min(at for t, at in closes.items() if t not in gone), now + 1))
    elif state.exists:
        state.remove()


_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]


def _stream(rows: DataFrame, n: int, batches: int = BATCHES) -> DataFrame:
    """The rows (_OUT, a null verdict for sound threads) that the stream over ``rows``, of which there are ``n``, emits: one for each closure of a thread."""
    spark = rows.sparkSession
    base = scratch_path(spark, "conversations")
    batches = max(batches, -(-n // BATCH_ROWS))
    ends = rows.approxQuantile("arrival", [i / batches for i in range(1, batches)], 0.01) if n else []
    shard = F.pmod(F.xxhash64("thread"), F.lit(max(1, -(-n // SHARD_ROWS)))).cast("int").alias("shard")
    # A row without time, or before 1970, must not fall behind the first watermark.
    time = F.greatest("at", F.timestamp_seconds(F.lit(86_400)))
    feed = rows.select(shard, time.alias("at"), packed().alias("row"), "arrival")
    schema = feed.drop("arrival").schema
    tick = spark.range(1).select(F.lit(_TICK).alias("shard"), F.to_timestamp(F.lit(_FAR)).alias("at"), F.lit(_CUT.join(["", "", _NULL, _NULL, _NULL, "1"])).alias("row"))
    low, high = [None, *ends], [*ends, None]
    inside = lambda a, b: (F.lit(True) if b is None else F.coalesce(F.col("arrival") <= b, F.lit(a is None))) & (F.lit(True) if a is None else F.col("arrival") > a)
    parts = [feed.filter(inside(a, b)).drop("arrival") for a, b in zip(low, high, strict=True)]
    parts[0].write.parquet(f"{base}/feed")
    source = spark.readStream.schema(schema).parquet(f"{base}/feed").withWatermark("at", LATENESS)
    out = source.groupBy("shard").applyInPandasWithState(_update, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(processingTime="0 seconds").outputMode("append").start()
    try:
        for part in [*parts[1:], tick.coalesce(1)]:
            query.processAllAvailable()
            part.write.mode("append").parquet(f"{base}/feed")
        query.processAllAvailable()
    finally:
        query.stop()
    drop_path(spark, f"{base}/checkpoint")
    drop_path(spark, f"{base}/feed")
    return spark.read.schema(_OUT).parquet(f"{base}/out").withColumn("verdict", F.nullif("verdict", F.lit("")))


def judge_by_joins(rows: DataFrame) -> DataFrame:
    """(thread, n_rows, verdict) by joins alone, for threads of any size."""
    per = rows.groupBy("thread").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col("parent_id").isNull(), 1)).alias("n_roots"),
        F.min(F.when(F.col("parent_id").isNull(), F.struct("user_id"))).alias("opener"),
        F.max(~F.col("blank")).alias("any_text"),
    )
    node = lambda c: F.concat("thread", F.lit("\x01"), c)
    named = cut(rows.select("thread", node("post_id").alias("node"), node("parent_id").alias("parent")), "named")
    links = parent_links(named, "node", "parent")
    lost = named.filter("parent IS NOT NULL").join(links.filter("parent IS NULL").select("node"), "node", "left_semi").select("thread", F.lit(1).alias("orphan")).distinct()
    ring = ancestors(links).filter("cycle IS NOT NULL").select(F.substring_index("node", "\x01", 1).alias("thread"), F.lit(1).alias("cycle")).distinct()
    texts = rows.filter("NOT blank AND user_id IS NOT NULL")
    told = lookup_join(texts, per.select("thread", "opener"), ["thread"], collect_hot(texts, ["thread"]), ["post_id"])
    answered = told.filter("NOT user_id <=> opener.user_id").select("thread", F.lit(1).alias("answered")).distinct()
    all_ = per.join(lost, "thread", "left").join(ring, "thread", "left").join(answered, "thread", "left")
    verdict = (
        F.when(F.col("n_roots") != 1, "roots").when(F.col("orphan") == 1, "orphan").when(F.col("cycle") == 1, "cycle").when(~F.col("any_text"), "empty").when(F.col("answered").isNull(), "unanswered")
    )
    return all_.select("thread", "n_rows", verdict.alias("verdict"))


@dataclass
class Conversations:
    """``verdicts``: (thread, n_rows, verdict, by_stream), a null verdict marks a sound thread; ``messages``: (thread, position, post_id, user_id, role, at)."""

    verdicts: DataFrame
    messages: DataFrame


def conversations(df: DataFrame, max_state: int = MAX_STATE, batches: int = BATCHES, order: str | None = None) -> Conversations:
    """The threads of ``df`` (post_id, thread_id, parent_id, user_id, timestamp, text), which arrive by ``order`` (a number) or by time."""
    rows = cut(arrivals(df, order), "rows")
    sizes, _, total = counted(rows.groupBy("thread").agg(F.count(F.lit(1)).alias("n_rows")), "sizes", rows=F.sum("n_rows"), large=F.count_if(F.col("n_rows") > max_state))
    small = rows if not total["large"] else rows.join(sizes.filter(F.col("n_rows") > max_state).select("thread"), "thread", "left_anti")
    emitted = _stream(small, total["rows"] or 0, batches)
    # A thread that closed early or lost rows was emitted with fewer rows than it has.
    whole = cut(emitted.join(sizes, ["thread", "n_rows"], "left_semi"), "whole")
    verdicts = whole.select("thread", "n_rows", "verdict", F.lit(True).alias("by_stream"))
    told_ = whole.filter("verdict IS NULL").select("thread", F.posexplode(F.arrays_zip("post_id", "user_id", "role", "us")).alias("position", "m"))
    messages = told_.select("thread", F.col("position").cast("long").alias("position"), "m.post_id", "m.user_id", "m.role", F.timestamp_micros("m.us").alias("at"))
    rest = cut(sizes.select("thread").join(whole, "thread", "left_anti"), "rest")
    if rest.isEmpty():
        return Conversations(verdicts, messages)
    late = cut(rows.join(rest, "thread", "left_semi"), "rest")
    judged = cut(judge_by_joins(late), "judged")
    return Conversations(verdicts.unionByName(judged.withColumn("by_stream", F.lit(False))), messages.unionByName(ordered(late, judged)))


def ordered(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(thread, position, post_id, user_id, role, at) of the sound conversations.

    The opener comes first; others follow by time (a clock behind the opener's
    counts as the opener's time), rows without time last, ties by id.
    """
    sound = verdicts.filter("verdict IS NULL").select("thread")
    good = rows.join(sound, "thread", "left_semi")
    root = good.filter("parent_id IS NULL").select("thread", F.col("post_id").alias("root"), F.struct("user_id").alias("opener"), F.col("at").alias("root_at"))
    told = lookup_join(good, root, ["thread"], collect_hot(good, ["thread"]), ["post_id"])
    told = told.withColumns({"first": F.col("post_id") != F.col("root"), "when": F.greatest("at", F.when(F.col("at").isNotNull(), F.col("root_at")))})
    role = F.when(F.col("user_id").eqNullSafe(F.col("opener.user_id")), "opener").otherwise("responder")
    told = told.select("thread", "post_id", "user_id", role.alias("role"), "at", "first", "when")
    ranked = grouped_rank(told, ["thread"], [F.col("first").asc(), F.col("when").asc_nulls_last(), F.col("post_id").asc()], "position")
    return ranked.select("thread", "position", "post_id", "user_id", "role", "at")
