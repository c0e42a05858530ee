"""Keyed operators in event time: trailing windows, throttles, islands, idle state.

Times are microseconds in a column ``us``; ``seq`` orders what happens at one time.  No
operator needs all rows of a key in one task: trailing windows are cut into time slices
that carry the window before them along, and throttles, which are sequential by nature, read
the few rows that trip a detector as a sorted stream with a state of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A time slice is so many windows long: rows are handled 1 + 1 / SLICE times.
SLICE = 8


def sliced(df: DataFrame, width_us: int) -> DataFrame:
    """Adds ``_slice`` and ``_home``: each row once in its own slice and, if a later slice's windows reach it, once there."""
    span = width_us * SLICE
    own = F.floor(F.col("us") / F.lit(span)).cast("long")
    after = F.floor((F.col("us") + width_us) / F.lit(span)).cast("long")
    slices = F.when(own < after, F.array(own, after)).otherwise(F.array(own))
    return df.withColumn("_own", own).withColumn("_slice", F.explode(slices)).withColumn("_home", F.col("_slice") == F.col("_own")).drop("_own")


def trailing(df: DataFrame, keys: list[str], width_us: int, sums: dict[str, Column] | None = None, distinct: dict[str, str] | None = None) -> DataFrame:
    """Adds sums and distinct counts over the rows of the same keys within ``width_us`` before each row, itself included.

    Rows that share a time count in order of ``seq``.  A row adds its amounts where it
    stands and takes them back when it expires, so a running sum gives every window; for
    a distinct count it adds one only if its value did not occur within the window
    before, and takes it back only if it does not occur again within the window after.
    The cost is a sort of two rows a row, whatever a window holds.
    """
    sums, distinct = sums or {}, distinct or {}
    part = [*keys, "_slice"]
    rows = sliced(df, width_us).repartition(*part)  # once: what follows needs rows of a key and slice together
    for name, expr in sums.items():
        rows = rows.withColumn(f"_{name}", expr.cast("long"))
    for name, column in distinct.items():
        same = Window.partitionBy(*part, column).orderBy("us", "seq")
        rows = rows.withColumn(f"_{name}_new", (F.coalesce(F.col("us") - F.lag("us").over(same) > width_us, F.lit(True))).cast("long"))
        rows = rows.withColumn(f"_{name}_end", (F.coalesce(F.lead("us").over(same) - F.col("us") > width_us, F.lit(True))).cast("long"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("us").alias("at")), F.struct(F.lit(1).alias("kind"), (F.col("us") + width_us).alias("at"))))
    both, enters = rows.withColumn("_e", ends), F.col("_e.kind") == 0
    order = Window.partitionBy(*part).orderBy("_e.at", "_e.kind", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    changes = {n: F.when(enters, F.col(f"_{n}")).otherwise(-F.col(f"_{n}")) for n in sums} | {n: F.when(enters, F.col(f"_{n}_new")).otherwise(-F.col(f"_{n}_end")) for n in distinct}
    out = both.select(*df.columns, "_home", "_e", *(F.sum(c).over(order).alias(n) for n, c in changes.items()))
    return out.where("_home and _e.kind = 0").drop("_home", "_e")


#: Panes of the finest level in the longest window; panes of a level that make one of the next; levels; copies of a row up to which they are cheaper than the panes of a window (some 40).
PANES, PER_LEVEL, LEVELS, COPIES = 512, 8, 4, 32


def _few(rows: DataFrame, by: list[str], tops: tuple[str, ...], least: dict[str, int]) -> DataFrame:
    """first, ``tops`` and few (the least distinct ``value``s) of rows (``by``, what, value, first, ``tops``).

    Values are made distinct and numbered before any are gathered, so they may be very many.
    """
    own = [*by, "what"]
    one = rows.groupBy(*own, "value").agg(F.min("first").alias("first"), *(F.max(t).alias(t) for t in tops))
    place = F.row_number().over(Window.partitionBy(*own).orderBy("value"))
    limit = F.coalesce(*(F.when(F.col("what") == n, k) for n, k in least.items()))
    kept = F.array_sort(F.collect_list(F.when(F.col("_place") <= limit, F.col("value"))))
    return one.withColumn("_place", place).groupBy(*own).agg(F.min("first").alias("first"), *(F.max(t).alias(t) for t in tops), kept.alias("few"))


def window_evidence(emitted: DataFrame, rows: DataFrame, keys: list[str], width_us: Column, longest_us: int, least: dict[str, tuple[Column, int]], tops: tuple[str, ...] = ()) -> DataFrame:
    """Adds to emissions what the trailing window of each tells: ``first`` (the first time), the largest ``tops``, and the k least distinct values of ``least`` (name: string value, k).

    Windows overlap, so rows aren't joined with the windows that hold them.  Rows are summed
    up in panes, and these in wider ones; all have the few values, and no more.  A window is
    then the panes inside it, of which there are at most 14 a level, and the rows of its two
    edges, each under 1 / PANES of the longest window.  So what is read grows with rows and
    emissions, however much windows overlap.  Where a row is in no more than COPIES windows
    or so, ``joined_evidence`` costs less.
    """
    base = max(1, longest_us // PANES)
    sizes, carried = {n: k for n, (_, k) in least.items()}, [c for c in emitted.columns if c not in (*keys, "us", "seq")]
    at = lambda c: F.floor(c / F.lit(base)).cast("long")
    values = F.explode(F.array(*(F.struct(F.lit(n).alias("what"), v.cast("string").alias("value")) for n, (v, _) in least.items())))
    flat = rows.select(*keys, at(F.col("us")).alias("pane"), "us", "seq", *tops, values.alias("v")).select(*keys, "pane", F.col("us").alias("first"), "seq", *tops, "v.what", "v.value")
    shape = [*keys, "level", "pane", "seq", "first", *tops, "what", "few"]
    facts = flat.withColumn("level", F.lit(-1)).withColumn("few", F.array("value")).select(*shape)
    panes = _few(flat, [*keys, "pane"], tops, sizes).withColumn("level", F.explode(F.array(*map(F.lit, range(LEVELS)))))
    panes = panes.withColumn("pane", F.floor(F.col("pane") / F.pow(F.lit(PER_LEVEL), F.col("level"))).cast("long"))
    # A pane has at most PER_LEVEL ** level of the finest below it, each with a few values.
    limit = F.coalesce(*(F.when(F.col("what") == n, k) for n, k in sizes.items()))
    wide = panes.groupBy(*keys, "level", "pane", "what").agg(F.min("first").alias("first"), *(F.max(t).alias(t) for t in tops), F.array_sort(F.array_distinct(F.flatten(F.collect_list("few")))).alias("few"))
    facts = facts.unionByName(wide.withColumn("few", F.slice("few", F.lit(1), limit)).withColumn("seq", F.lit(None).cast("long")).select(*shape))

    mark = [*keys, "e_us", "e_seq", *carried]
    own = emitted.select(*keys, F.col("us").alias("e_us"), F.col("seq").alias("e_seq"), *carried, (F.col("us") - width_us).alias("lo"))
    first, last, after = at(F.col("lo")), at(F.col("e_us")), at(F.col("lo") + (base - 1))
    run = lambda level, x, y: F.when(x < y, F.transform(F.sequence(x, y - 1), lambda p: F.struct(F.lit(level).alias("level"), p.alias("pane")))).otherwise(F.array())
    # Whole panes are those from a to b, b left out; what does not make a whole pane of the next level is taken from this one.
    pieces = [F.transform(F.array_distinct(F.array(first, last)), lambda p: F.struct(F.lit(-1).alias("level"), p.alias("pane")))]
    own = own.withColumn("_a0", after).withColumn("_b0", last)
    for level in range(LEVELS):
        x, y = F.col(f"_a{level}"), F.col(f"_b{level}")
        if level == LEVELS - 1:
            pieces.append(run(level, x, y))
        else:
            up, down = F.ceil(x / PER_LEVEL).cast("long"), F.floor(y / PER_LEVEL).cast("long")
            whole = up < down
            own = own.withColumn(f"_a{level + 1}", F.when(whole, up).otherwise(F.lit(0).cast("long"))).withColumn(f"_b{level + 1}", F.when(whole, down).otherwise(F.lit(0).cast("long")))
            pieces += [run(level, x, F.when(whole, up * PER_LEVEL).otherwise(y)), run(level, F.when(whole, down * PER_LEVEL).otherwise(y), y)]
    asked = own.select(*mark, "lo", F.explode(F.concat(*pieces)).alias("p")).select(*mark, "lo", "p.level", "p.pane")
    inside = (F.col("first") >= F.col("lo")) & ((F.col("first") < F.col("e_us")) | ((F.col("first") == F.col("e_us")) & (F.col("seq") <= F.col("e_seq"))))
    inside = inside & ((F.col("pane") == last) | (F.col("pane") < after))  # an edge that is a whole pane is among those
    met = asked.join(facts, [*keys, "level", "pane"]).where((F.col("level") >= 0) | inside)
    told = _few(met.select(*mark, "what", "first", *tops, F.explode("few").alias("value")), mark, tops, sizes)
    lists = (F.flatten(F.collect_list(F.when(F.col("what") == n, F.col("few")))).alias(n) for n in least)  # one list each
    return told.groupBy(*mark).agg(F.min("first").alias("first"), *(F.max(t).alias(t) for t in tops), *lists).withColumnsRenamed({"e_us": "us", "e_seq": "seq"})


def joined_evidence(emitted: DataFrame, rows: DataFrame, keys: list[str], width_us: Column, longest_us: int, least: dict[str, tuple[Column, int]], tops: tuple[str, ...] = (), sums: dict[str, Column] | None = None) -> DataFrame:
    """``window_evidence`` by a join of windows and rows, by key and time slice; also ``sums`` over the window, and of each of ``least`` the number of its distinct values (n_name)."""
    span, carried = longest_us * SLICE, [c for c in emitted.columns if c not in (*keys, "us", "seq")]
    at = lambda c: F.floor(c / F.lit(span)).cast("long")
    mark = [*keys, "e_us", "e_seq", *carried]
    own = emitted.select(*keys, F.col("us").alias("e_us"), F.col("seq").alias("e_seq"), *carried, (F.col("us") - width_us).alias("lo"))
    own = own.withColumn("_slice", F.explode(F.array_distinct(F.array(at(F.col("lo")), at(F.col("e_us"))))))
    inside = (F.col("first") >= F.col("lo")) & ((F.col("first") < F.col("e_us")) | ((F.col("first") == F.col("e_us")) & (F.col("seq") <= F.col("e_seq"))))
    values = rows.select(*keys, at(F.col("us")).alias("_slice"), F.col("us").alias("first"), "seq", *tops, *(v.cast("string").alias(f"_{n}") for n, (v, _) in least.items()), *(c.cast("long").alias(n) for n, c in (sums or {}).items()))
    added = [F.sum(n).alias(n) for n in sums or {}]
    met = own.join(values, [*keys, "_slice"]).where(inside).groupBy(*mark, *(f"_{n}" for n in least)).agg(F.min("first").alias("first"), *(F.max(t).alias(t) for t in tops), *added)
    for n in least:  # numbered before any are gathered, since values may be very many
        met = met.withColumn(f"_at_{n}", F.dense_rank().over(Window.partitionBy(*mark).orderBy(f"_{n}")))
    lists = (F.array_sort(F.collect_set(F.when(F.col(f"_at_{n}") <= k, F.col(f"_{n}")))).alias(n) for n, (_, k) in least.items())
    counts = (F.max(f"_at_{n}").cast("long").alias(f"n_{n}") for n in least)
    return met.groupBy(*mark).agg(F.min("first").alias("first"), *(F.max(t).alias(t) for t in tops), *lists, *counts, *added).withColumnsRenamed({"e_us": "us", "e_seq": "seq"})


def _folded(df: DataFrame, keys: list[str], columns: list[str], fold, extra: str = "") -> DataFrame:
    """Rows of ``df`` that an ordered fold lets pass.

    Rows are dealt by key, sorted, and read as a stream: whatever the size of a key, a
    task holds one batch and one state.  ``fold(state, *columns)`` gets lists of the values
    of ``columns`` in a run of rows of one key, and returns the new state and, for each row,
    a value, None if the row does not pass; ``extra`` names a column for those values.  Keys
    may be as many as rows, so a run costs no more than its slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows - 1, bool)
            for k in keys:
                codes = pc.dictionary_encode(b.column(k), null_encoding="encode").indices.to_numpy()
                new |= codes[1:] != codes[:-1]
            cut = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
            lists, values = [b.column(c).to_pylist() for c in columns], []
            ends = [tuple(b.column(k)[at].as_py() for k in keys) for at in (0, b.num_rows - 1)]
            for s, e in zip(cut, cut[1:]):
                if s or ends[0] != last:
                    state = None
                state, got = fold(state, *(x[s:e] for x in lists))
                values += got
            last = ends[1]
            out = b.filter(pa.array([v is not None for v in values]))
            if extra:
                out = pa.RecordBatch.from_arrays([*out.columns, pa.array([v for v in values if v is not None], pa.string())], [*out.schema.names, extra])
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.repartition(*keys).sortWithinPartitions(*keys, "us", "seq").mapInArrow(run, f"{fields}, {extra} string" if extra else fields)


def throttle(df: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """The rows that pass if, after each that passes, its keys are mute until more than ``gap_us`` later.

    The mute time runs from the last row that passed, not from the last row.
    """

    def fold(last, times):
        out = []
        for us in times:
            passes = last is None or us - last > gap_us
            out.append(True if passes else None)
            last = us if passes else last
        return last, out

    return _folded(df, keys, ["us"], fold)


def growth_throttle(df: DataFrame, keys: list[str], gap_us: int, growth: float = 1.5) -> DataFrame:
    """Which candidates pass if a key is mute for less than ``gap_us`` after one that passed, unless its count grew.

    ``df`` has ``fast_n`` and ``slow_n``, the counts of two windows, 0 where a window
    has no candidate.  Per row the fast one is tried, then the slow one; both read and
    set the same state (time and count of the last that passed).  Adds ``kind``.
    """

    def fold(state, *columns):
        out = []
        for us, *counts in zip(*columns):
            kind = None
            for name, n in zip(("fast", "slow"), counts):
                if n > 0 and (state is None or us - state[0] >= gap_us or n >= growth * state[1]):
                    state, kind = (us, n), name
                    break
            out.append(kind)
        return state, out

    return _folded(df, keys, ["us", "fast_n", "slow_n"], fold, "kind")


def islands(df: DataFrame, keys: list[str], gap_us: int, order: list[str]) -> DataFrame:
    """Adds ``island``: a new one begins where a row starts more than ``gap_us`` after the row before it ended."""
    by = Window.partitionBy(*keys).orderBy("start_us", *order)
    new = F.coalesce(F.col("start_us") > F.lag("end_us").over(by) + gap_us, F.lit(True)).cast("long")
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


#: Sweep intervals in a slice of the clock; seconds in a slice of an as-of join; times looked up at once.
CLOCK_SLICE, ASOF_SLICE, AT_ONCE = 16, 3600, 1 << 20


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, np.ndarray, int | None]]:
    """(capture, part, distinct times, entry) of each slice of rows sorted by capture, part and time."""
    now, held = None, []

    def done():
        us = held[0] if len(held) == 1 else np.concatenate(held)
        return (*now[:2], us[np.r_[True, us[1:] != us[:-1]]], now[2])

    for b in batches:
        if not b.num_rows:
            continue
        part, capture = b["part"].to_numpy(), b["capture"]
        new = part[1:] != part[:-1]
        if pc.count_distinct(capture, mode="all").as_py() > 1:
            codes = pc.dictionary_encode(capture, null_encoding="encode").indices.to_numpy()
            new |= codes[1:] != codes[:-1]
        cut = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        us = b["us"].to_numpy()
        for s, e in zip(cut, cut[1:]):
            own = (capture[s].as_py(), int(part[s]), b["entry"][s].as_py() if "entry" in b.schema.names else None)
            if now is not None and own != now:
                yield done()
                held = []
            now = own
            held.append(us[s:e].copy())
    if now is not None:
        yield done()


def sweeps(events: DataFrame, interval_us: int) -> DataFrame:
    """(capture, sweep_us): the times at which a capture's idle state is swept.

    The first positive time starts the clock; a sweep happens at the first event at least
    ``interval_us`` after the start or the last sweep.  So whatever happened before, a
    time slice is left at a sweep that depends on the one at which it was entered only,
    and a later entry never leaves earlier.  Slices are read side by side: each says where
    it is left for every entry, which is a table of few rows, since clocks that start
    apart soon tick alike.  Those tables are then followed from slice to slice, and each
    slice's sweeps from its entry are told by a second reading.  Times come as sorted
    columns; of a slice only its times and a place for each (12 bytes a time) are held.
    """
    span = interval_us * CLOCK_SLICE
    times = events.where("us > 0").select("capture", "us", F.floor(F.col("us") / F.lit(span)).cast("long").alias("part"))

    def after(us: np.ndarray) -> np.ndarray:
        """Of each time the place of the first one at least an interval later; its own place if there is none in the slice."""
        out = np.arange(len(us), dtype=np.int32)
        for s in range(0, len(us), AT_ONCE):
            at = np.searchsorted(us, us[s : s + AT_ONCE] + interval_us)
            inside = at < len(us)
            out[s : s + AT_ONCE][inside] = at[inside]
        return out

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for capture, part, us, _ in _slices(batches):
            last = after(us)
            while not np.array_equal(last, further := last[last]):  # of each time as a sweep the last sweep in the slice
                last = further
            # The first sweep in the slice is a time of its first interval, or the next one after that.
            own = last[: np.searchsorted(us, us[0] + interval_us) + 1]
            cut = np.r_[0, np.flatnonzero(np.diff(own)) + 1]
            until = np.r_[cut[1:], len(own)] - 1
            n = len(cut)
            yield pa.RecordBatch.from_arrays([pa.array([capture] * n, pa.string()), pa.array([part] * n, pa.int64()), pa.array(us[until]), pa.array(us[own[cut]])], ["capture", "part", "until", "last"])

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        capture, part, clock, entry, found = object(), None, None, None, False
        for b in batches:
            out = []
            for c, p, until, last in zip(b["capture"], b["part"], b["until"], b["last"]):
                if c != capture:
                    capture, part, clock = c, None, None
                if p != part:
                    part, entry, found = p, clock, False
                if found:
                    continue
                # Rows of a slice are in order of entry; the first that a sweep at ``entry`` reaches holds.
                if entry is None or until >= entry + interval_us:
                    found, clock = True, last
                    out.append((c, p, entry))
            yield pd.DataFrame(out, columns=["capture", "part", "entry"]).astype({"part": "Int64", "entry": "Int64"})

    def tick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for capture, _, us, entry in _slices(batches):
            at, out = 0 if entry is None else int(np.searchsorted(us, entry + interval_us)), []
            while at < len(us):
                out.append(us[at])
                at = int(np.searchsorted(us, us[at] + interval_us))
            out = out[1:] if entry is None else out  # the first time starts the clock and is no sweep
            yield pa.RecordBatch.from_arrays([pa.array([capture] * len(out), pa.string()), pa.array(np.asarray(out, np.int64))], ["capture", "sweep_us"])

    by = ["capture", "part"]
    tables = times.repartition(*by).sortWithinPartitions(*by, "us").mapInArrow(leave, "capture string, part long, until long, last long")
    entries = tables.repartition("capture").sortWithinPartitions("capture", "part", "until").mapInPandas(follow, "capture string, part long, entry long")
    return times.join(entries, by).repartition(*by).sortWithinPartitions(*by, "us").mapInArrow(tick, "capture string, sweep_us long")


def outlasts(events: DataFrame, ttl_us: int) -> bool:
    """Whether a capture's times span more than ``ttl_us``; where none does, no idle state can be evicted."""
    span = events.groupBy("capture").agg((F.max("us") - F.min("us")).alias("span")).agg(F.max("span")).first()[0]
    return span is not None and span > ttl_us


def last_sweeps(times: DataFrame, swept: DataFrame) -> DataFrame:
    """(capture, us, sweep): the last sweep up to each of the distinct ``times`` (capture, us), null if there was none.

    Times and sweeps meet in slices of ASOF_SLICE seconds; what holds at the beginning of a
    slice comes from the slices' last sweeps, a row a slice.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(ASOF_SLICE * 1_000_000)).cast("long")
    none = F.lit(None).cast("long")
    times = times.select("capture", "us", at("us").alias("slice")).distinct()
    marks = times.withColumn("sweep", none).unionByName(swept.select("capture", F.col("sweep_us").alias("us"), at("sweep_us").alias("slice"), F.col("sweep_us").alias("sweep")))
    ends = marks.groupBy("capture", "slice").agg(F.max("sweep").alias("sweep"))
    before = Window.partitionBy("capture").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("capture", "slice", F.last("sweep", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("capture", "slice").orderBy("us", F.col("sweep").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = marks.select("capture", "us", "slice", F.col("sweep").isNull().alias("asked"), F.last("sweep", ignorenulls=True).over(inside).alias("own")).where("asked")
    return found.join(ends, ["capture", "slice"]).select("capture", "us", F.coalesce("own", "carried").alias("sweep"))


def with_epochs(df: DataFrame, keys: list[str], swept: DataFrame | None, ttl_us: int) -> DataFrame:
    """Adds ``epoch``, which rises when a key's state was evicted between two of its rows.

    A key last touched at t1 is gone at t2 if t1 is more than the ttl before the last
    sweep up to t2.  Only rows that come more than the ttl after the one before can be
    such, so the sweeps are attached to those alone.  ``swept`` is None where no capture
    lasts longer than the ttl (``outlasts``): nothing is evicted then.
    """
    if swept is None:
        return df.withColumn("epoch", F.lit(0).cast("long"))
    by = Window.partitionBy(*keys).orderBy("us", "seq")
    gaps = df.withColumn("_prev", F.lag("us").over(by))
    last = last_sweeps(gaps.where(F.col("us") - F.col("_prev") > ttl_us), swept).select(F.col("capture").alias("_c"), F.col("us").alias("_t"), F.col("sweep").alias("_sweep"))
    joined = gaps.join(last, (F.col("capture") == F.col("_c")) & (F.col("us") == F.col("_t")), "left")
    gone = F.coalesce(F.col("_prev") < F.col("_sweep") - ttl_us, F.lit(False)).cast("long")
    out = joined.withColumn("_gone", gone).withColumn("epoch", F.sum("_gone").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.select(*df.columns, "epoch")
