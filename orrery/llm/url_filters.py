"""URL filters: a temporal join of captures with dated lists.

A list is a log of events: at some time a key (a domain or a page) was added with an action, or
removed. The events of a key become validity intervals that do not overlap, and an as-of join
finds for every capture the entries of its keys that were active when it was fetched. A capture's
keys are its page and every parent domain of its host, so the join is an equality on the key with a
range condition on time; the most specific active entry decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared
from .shared import bounded, clear_name, isolated, settled

#: Production list: fixed values (key, action or null for a removal, day of 2024 on which the event happened).
LIST_EVENTS = (
    ("casino-win.example.com", "block", 20),
    ("casino-win.example.com", None, 200),
    ("casino-win.example.com", "block", 260),
    ("free-bets.example.com", "block", 0),
    ("m.free-bets.example.com", "allow", 120),
    ("ththan.example.com", "block", 90),
    ("ththan.example.com", None, 150),
    ("tionsh.example.com", "block", 30),
    ("blog.tionsh.example.com", "allow", 180),
    ("tiontion.example.net", "block", 300),
    ("example.org", "block", 340),
    ("tionble.example.org", "allow", 345),
    ("ththre.example.com/fr/825", "block", 0),
    ("m.ththth.example.net/en", "block", 0),
    ("Tionsh.example.net/Old", "block", 10),
)
#: Where the list is too large to be broadcast: captures of a key beyond which its entries are repeated and its captures dealt.
HOT_CAPTURES = 50_000


def production_list(spark: SparkSession) -> DataFrame:
    """(key, action, at) of LIST_EVENTS."""
    quoted = lambda v: "NULL" if v is None else f"'{v}'"
    rows = ", ".join(f"({quoted(k)}, {quoted(a)}, {d})" for k, a, d in LIST_EVENTS)
    return spark.sql(f"SELECT k AS key, CAST(a AS STRING) AS action, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(d) AS at FROM VALUES {rows} AS t(k, a, d)")


def intervals(events: DataFrame) -> DataFrame:
    """(key, action, since, until): when each entry held; until is null while it still holds.

    The last event of a key at one time wins: a removal over an action, then the greatest action.
    Null and empty keys and null times are dropped: they name nothing and no time. Hosts have no case; paths have; dots at the end of a
    host and slashes at the end of a key don't count, as in page_of().
    """
    host = F.regexp_replace(F.lower(F.substring_index("key", "/", 1)), r"\.+$", "")
    path = F.expr("substring(key, length(substring_index(key, '/', 1)) + 1)")
    key = F.nullif(F.concat(host, F.regexp_replace(path, "/+$", "")), F.lit(""))
    log = events.select(key.alias("key"), "action", F.col("at").alias("since")).filter("key IS NOT NULL AND since IS NOT NULL")
    log = log.groupBy("key", "since").agg(F.max(F.struct(F.col("action").isNull().alias("gone"), F.col("action").alias("action"))).alias("e"))
    spans = log.select("key", F.col("e.action").alias("action"), "since", F.lead("since").over(Window.partitionBy("key").orderBy("since")).alias("until"))
    return spans.filter("action IS NOT NULL")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or trailing dot; empty if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.regexp_replace(host, r"\.+$", "")


def page_of(url: Column) -> Column:
    """Host and path, without query, fragment or trailing slash."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    return F.concat(host_of(url), F.regexp_replace(path, "/+$", ""))


def _dealt(keyed: DataFrame, held: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join by key, with _salt and _share to be joined by as well.

    A list of few entries is broadcast. Beyond that, keys that many captures have (a top-level domain, a large host) are dealt to
    as many shares as they need, and their entries repeated for each; those that the list doesn't have leave at once.
    """
    whole = held.withColumn("_share", F.lit(0))
    if held.limit(shared.BROADCAST_ROWS + 1).count() <= shared.BROADCAST_ROWS:
        return keyed.withColumn("_salt", F.lit(0)), F.broadcast(whole)
    keyed = settled(keyed, "url-keyed")
    hot = keyed.groupBy(F.col("_k").alias("_hot")).agg(F.count("*").alias("n")).filter(F.col("n") > HOT_CAPTURES)
    listed = held.select(F.col("_key").alias("_listed")).distinct()
    hot = hot.join(listed, F.col("_hot") == F.col("_listed"), "left").select("_hot", F.when(F.col("_listed").isNotNull(), F.ceil(F.col("n") / HOT_CAPTURES)).otherwise(0).cast("int").alias("_shares"))
    hot = bounded(settled(hot, "url-hot"))
    shares = F.coalesce("_shares", F.lit(1))
    left = keyed.join(hot, F.col("_k") == F.col("_hot"), "left").filter(shares > 0).withColumn("_salt", F.pmod(F.xxhash64(*by), shares).cast("int"))
    right = held.join(hot, F.col("_key") == F.col("_hot"), "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1)))
    return left.drop("_hot", "_shares"), right.drop("_hot", "_shares")


def judge(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_at", default: str = "keep") -> DataFrame:
    """All columns of `captures`, with url_host, url_entries (active entries that match), url_rule (the key that decides,
    null: none), url_action and url_kept.

    Every capture gives one row. A null or malformed URL has no host and a null fetch time no active
    entry: both are kept by default. Repeated captures are judged alike. The longest key decides; of one key there is
    one active entry at most. New columns whose names `captures` has get leading underscores.
    """
    safe, own = isolated(captures)
    host, page, at = "_host", "_page", "_at"
    seen = safe.withColumns({host: host_of(F.col(own[url])), page: page_of(F.col(own[url])), at: F.col(own[fetched])})
    held = intervals(events).select(F.col("key").alias("_key"), F.col("action").alias("_action"), F.col("since").alias("_since"), F.col("until").alias("_until"))
    # Equal (page, time) pairs are judged once: hot pages cost no more than others.
    distinct = seen.select(host, page, at).filter(F.col(host) != "").distinct()
    labels = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = distinct.select(host, page, at, F.explode(F.array_distinct(F.concat(suffixes, F.array(page)))).alias("_k"))
    keyed, held = _dealt(keyed, held, [page, at])
    active = keyed.join(held, (F.col("_k") == F.col("_key")) & (F.col("_salt") == F.col("_share")) & (F.col(at) >= F.col("_since")) & (F.col("_until").isNull() | (F.col(at) < F.col("_until"))))
    best = F.max(F.struct(F.length("_key").alias("n"), F.col("_key").alias("key"), F.col("_action").alias("action"))).alias("_best")
    ruled = active.groupBy(page, at).agg(F.count("*").alias("_n"), best).select(F.col(page).alias("_page2"), F.col(at).alias("_at2"), "_n", "_best")
    out = seen.join(ruled, (F.col(page) == F.col("_page2")) & (F.col(at) == F.col("_at2")), "left")
    action = F.coalesce(F.col("_best.action"), F.lit(default))
    made = {"url_host": F.col(host), "url_entries": F.coalesce("_n", F.lit(0)).cast("long"), "url_rule": F.col("_best.key"), "url_action": action, "url_kept": action != "block"}
    return out.select(*[F.col(a).alias(c) for c, a in own.items()], *[made[c].alias(clear_name(captures, c)) for c in made])
