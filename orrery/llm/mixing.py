"""Mixing sources to target weights by proportionate-fair scheduling.

Every source is cut into blocks of about `block_chars` characters. Block j of a source with weight
w may not run before slot floor(j / w) (its release) and must have run before ceil((j + 1) / w) (its
deadline). One block runs in each slot: of the released blocks, the one with the earliest deadline.
So at any slot t each source has had less than one block more or less than w * t, for as long as it
has blocks; a source that has run out leaves its slots empty and the others go on as before.

Weights are integers over their sum, so windows are exact. The timetable is found in frames of slots, a row and so a
task each, that know nothing of each other: what has run before the longest window began has no say in which of the blocks
whose windows are open have run by a slot, only how much has. A frame therefore starts one longest window early, in any state
that has run as many blocks as slots have passed and none too early, and is exact from its first own slot on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import bounded, clear_name, isolated, let, ranked, settled

#: Production parameters: characters of a block, and slots of a frame. It is longer where the longest window is, or where there
#: would be more than FRAMES frames; the timetable is the same for frames of any length.
BLOCK_CHARS = 65_536
FRAME, FRAMES = 1_024, 4_096
#: Weight of a source is its share of characters to this power, scaled to sum to 1: below 1, small sources get more.
TEMPERATURE = 0.7
#: Sum of the integer weights, about, where shares aren't whole numbers: windows are exact to this part.
UNITS = 1_000_000_000
_RUNS = 64


def shares(rows: DataFrame, source: str, chars: str, power: float = TEMPERATURE) -> DataFrame:
    """(source, share): target weights from the size of each source; null is a source of its own."""
    return rows.groupBy(F.col(source).alias("source")).agg(F.pow(F.sum(chars) + F.lit(1.0), F.lit(power)).alias("share"))


def units(weights: DataFrame) -> DataFrame:
    """(source, a, q): weight a / q of each source, as integers.

    Rows that repeat a source add up. A share that is null, not a number, zero or negative counts as none and the row is left
    out. Whole shares with a sum up to UNITS are taken as they are; others are rounded to about one part in UNITS.
    """
    share = F.col("share").cast("double")
    good = weights.select("source", F.when(share.isNotNull() & ~F.isnan(share) & (share > 0) & (share < float("inf")), share).alias("share")).filter("share IS NOT NULL")
    summed = settled(good.groupBy("source").agg(F.sum("share").alias("share")), "mix-shares")
    facts = summed.agg(F.sum("share").alias("total"), F.bool_and(F.col("share") == F.floor("share")).alias("whole")).first()
    if facts["whole"] and facts["total"] <= UNITS:
        a = F.col("share")
    else:
        a = F.greatest(F.lit(1), F.round(F.col("share") / F.lit(facts["total"] or 1.0) * UNITS))
    scaled = summed.select("source", a.cast("long").alias("a"))
    return scaled.withColumn("q", F.lit(scaled.agg(F.sum("a")).first()[0] or 0).cast("long"))


def _release(j: Column, a: Column, q: Column) -> Column:
    """floor(j / w), in whole numbers."""
    return F.call_function("div", j * q, a)


def _deadline(j: Column, a: Column, q: Column) -> Column:
    """ceil((j + 1) / w), in whole numbers."""
    return F.call_function("div", (j + 1) * q + a - 1, a)


def timetable(weights: DataFrame, slots: int, frame: int = FRAME) -> DataFrame:
    """One row for each of the first `slots` slots: source, block, release, deadline and slot.

    `weights` has (source, a, q), what units() gives. Sources with equal deadlines run in the order of their values. Each
    frame is a row with one state for each source; its work is slots times sources.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_first()))
    held = weights.select(F.struct((number - 1).cast("int").alias("i"), "source", "a", "q").alias("s")).agg(F.sort_array(F.collect_list("s")).alias("ss")).filter("size(ss) > 0")
    q = F.get(F.col("ss"), F.lit(0))["q"]
    longest = F.aggregate("ss", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.call_function("div", x["q"] + x["a"] - 1, x["a"]) + 1))
    sized = held.select("ss", q.alias("q"), longest.alias("warm"))
    sized = sized.withColumn("frame", F.greatest(F.lit(frame), F.lit(slots // FRAMES), F.least("warm", F.lit(max(1, slots)))).cast("long"))
    frames = F.when(F.lit(slots) > 0, F.sequence(F.lit(0).cast("long"), F.call_function("div", F.lit(max(1, slots)) - 1, F.col("frame"))))
    rows = sized.select("ss", "q", "warm", "frame", F.explode(frames).alias("f"))
    rows = rows.withColumn("own", F.col("f") * F.col("frame")).withColumn("start", F.greatest(F.lit(0).cast("long"), F.col("own") - F.col("warm")))
    rows = rows.withColumn("end", F.least(F.col("own") + F.col("frame"), F.lit(slots).cast("long")))

    # The state: the next block of each source, (deadline, number of the source, block, release). At the start each source has run
    # floor(w * start) blocks, and the first few sources with a window that is open then one more.
    def next_block(i: Column, j: Column, a: Column) -> Column:
        d, r = _deadline(j, a, F.col("q")), _release(j, a, F.col("q"))
        return F.struct(d.alias("d"), i.alias("i"), j.alias("j"), r.alias("r"))

    done = F.transform("ss", lambda x: F.call_function("div", F.col("start") * x["a"], F.col("q")))
    opened = F.transform("ss", lambda x: (F.col("start") * x["a"] % F.col("q") > 0).cast("int"))
    rows = rows.withColumns({"_done": done, "_open": opened})
    rows = rows.withColumn("_extra", F.col("start") - F.aggregate("_done", F.lit(0).cast("long"), lambda t, x: t + x))
    # Which sources get one more: those in front with an open window.
    chosen = F.slice(F.filter(F.transform("_open", lambda o, i: F.when(o == 1, i)), lambda i: i.isNotNull()), F.lit(1), F.col("_extra").cast("int"))
    rows = rows.withColumn("_chosen", chosen)
    last = F.when(F.size("_chosen") > 0, F.element_at("_chosen", -1)).otherwise(-1)
    rows = rows.withColumn("_given", F.transform("_open", lambda o, i: F.when(i <= last, o).otherwise(0)))
    state = F.transform("ss", lambda x, i: next_block(x["i"], F.get(F.col("_done"), i) + F.get(F.col("_given"), i), x["a"]))
    rows = settled(rows.select("ss", "q", "f", "own", "start", "end", state.alias("state")), "mix-frames")
    rows = rows.repartition(max(1, rows.count()), "f")

    ran = "array<struct<i:int,j:bigint>>"

    def step(s: Column, t: Column) -> Column:
        def run(pick: Column) -> Column:
            later = F.transform(s["next"], lambda x: F.when(x["i"] == pick["i"], next_block(x["i"], x["j"] + 1, F.get(F.col("ss"), x["i"])["a"])).otherwise(x))
            one = F.array(F.struct(pick["i"].alias("i"), pick["j"].alias("j")))
            full = F.size(s["run"]) >= _RUNS
            runs = F.when(full, F.concat(s["ran"], F.array(s["run"]))).otherwise(s["ran"])
            mine = F.when(t >= F.col("own"), F.when(full, one).otherwise(F.concat(s["run"], one))).otherwise(s["run"])
            return F.struct(later.alias("next"), mine.alias("run"), runs.alias("ran"))

        return let(F.array_min(F.filter(s["next"], lambda x: x["r"] <= t)), run)

    start = F.struct(F.col("state").alias("next"), F.array().cast(ran).alias("run"), F.array().cast(f"array<{ran}>").alias("ran"))
    every = F.sequence(F.col("start"), F.col("end") - 1)
    found = rows.select("ss", "q", "own", F.aggregate(every, start, step, lambda s: F.flatten(F.concat(s["ran"], F.array(s["run"])))).alias("ran"))
    # The outer form, as a filter that Spark infers from the other one would find the timetable twice.
    found = found.select("ss", "q", "own", F.posexplode_outer("ran").alias("at", "r"))
    of, j = F.get(F.col("ss"), F.col("r.i")), F.col("r.j")
    return found.select(of["source"].alias("source"), j.alias("block"), _release(j, of["a"], F.col("q")).alias("release"), _deadline(j, of["a"], F.col("q")).alias("deadline"), (F.col("own") + F.col("at")).alias("slot"))


def mix(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", text: str = "text", key: str = "doc_id", block_chars: int = BLOCK_CHARS, frame: int = FRAME) -> DataFrame:
    """All rows and columns of `docs`, with mix_block, mix_release, mix_deadline, mix_slot and mix_place (characters
    of the block before the row). Sorting by (mix_slot, mix_place) gives the mixed order.

    Within a source, rows are in an order fixed by their values. No row is dropped or repeated. Null text has no
    characters; a null source is a source of its own; a source without a weight (see units()) gets the smallest one given, or
    an equal one if none is; weights of sources that `docs` doesn't have are ignored; an empty table gives an empty table. Equal
    rows take turns in the same block. Columns of `docs` that have the name of a new column are kept and the new ones get leading
    underscores.
    """
    names = {c: clear_name(docs, c) for c in ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place")}
    safe, own = isolated(docs)
    source, key = own[source], own[key]
    chars, digest = F.coalesce(F.length(own[text]), F.lit(0)).cast("long"), F.xxhash64(F.coalesce(F.col(own[text]), F.lit("")))
    sizes = safe.groupBy(F.col(source).alias("source")).agg(F.sum(chars).alias("chars"), F.count("*").alias("rows"))
    sizes = settled(sizes, "mix-sources")
    found = shares(sizes, "source", "chars")
    if weights is not None:
        given = units(weights).select(F.col("source").alias("_s"), "a")
        least = given.agg(F.min("a")).first()[0] or 1
        found = sizes.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", F.coalesce("a", F.lit(least)).alias("share"))
    # One row a source, with its blocks: no more than its characters fill, and one.
    scaled = settled(units(found), "mix-units")
    blocks = scaled.join(sizes.select(F.col("source").alias("_s"), (F.floor(F.col("chars") / block_chars) + 1).alias("blocks")), F.col("source").eqNullSafe(F.col("_s")))
    facts = blocks.agg(F.max(_deadline(F.col("blocks") - 1, F.col("a"), F.col("q"))).alias("slots")).first()
    rows = sizes.agg(F.sum("rows")).first()[0] or 0
    sized = safe.withColumns({"_chars": chars, "_hash": digest})
    placed = ranked(sized, [source], [key, "_hash"], F.col("_chars"), "_before", rows)
    table = timetable(scaled, facts["slots"] or 0, frame).join(blocks.select(F.col("source").alias("_b"), "blocks"), F.col("source").eqNullSafe(F.col("_b")) & (F.col("block") < F.col("blocks")))
    table = settled(table.select(*[F.col(c).alias(f"_t_{c}") for c in ("source", "block", "release", "deadline", "slot")]), "mix-table")
    out = placed.withColumn("_block", F.floor(F.col("_before") / block_chars).cast("long"))
    # A key is one block of one source: rows of a hot source have many keys.
    out = out.join(bounded(table), F.col(source).eqNullSafe(F.col("_t_source")) & (F.col("_block") == F.col("_t_block")))
    return out.select(
        *[F.col(a).alias(c) for c, a in own.items()],
        F.col("_block").alias(names["mix_block"]),
        *[F.col(f"_t_{c}").alias(names[f"mix_{c}"]) for c in ("release", "deadline", "slot")],
        (F.col("_before") % block_chars).alias(names["mix_place"]),
    )


def in_order(docs: DataFrame, **options: object) -> DataFrame:
    """The rows and columns of `docs` in the mixed order: range-partitioned and sorted by slot."""
    mixed = mix(docs, **options)  # type: ignore[arg-type]
    slot, place = mixed.columns[-2:]
    return mixed.repartitionByRange(F.col(slot), F.col(place)).sortWithinPartitions(slot, place).select(*[F.col(f"`{c}`") for c in docs.columns])
