"""Gazetteers, alias maps and name lists of any size, as tables that are joined.

`functions.places` answers the same questions from literals, row by row, which suits lists of some dozens of names. Here the
list is a DataFrame. Only different coordinates and keys are looked up, and what is found goes back to the rows by an
equi-join, so neither a coordinate nor a fragment that fills a third of the rows is looked up twice.

Tables: gazetteer (pos, name, lat, lon), aliases (pos, key, names), officials (pos, key, name); `pos` is the place in the list and settles ties.
An empty table finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metframe import vocab as v
from metframe.functions import places, text

#: Tasks that a bin of longitudes is dealt to.
SALTS = 8
#: Other ends of rows without a longitude, so that these don't meet in one task.
_NOWHERE, _NOWHERE_PARTS = -1e6, 1024


# --- coordinates ------------------------------------------------------------------------


def nearest_points(axes: DataFrame, gazetteer: DataFrame, tolerance: float) -> DataFrame:
    """(lon, lat, names): for each different (lon, lat) of `axes` the five nearest points, nearest first.

    Points and coordinates meet in bins of longitude, a coordinate in its own and both next ones. A bin is dealt to
    `SALTS` tasks: its points by place, its coordinates, which are few, to all. What meets is first only measured: the fifth of
    the least distances of the salts of a coordinate is one that five points don't exceed, so those beyond it are left out before
    any are sorted. Of the rest only five for each coordinate and task are shuffled (the limit on the rank is pushed below the exchange).
    """
    width = tolerance * (1 + 1e-9)
    bin_of = F.floor(F.col("lon") / width)
    asked = axes.where("lon IS NOT NULL").select("lon", "lat").distinct()
    asked = asked.select(
        F.col("lon").alias("x"), F.col("lat").alias("y"), F.explode(F.sequence(bin_of - 1, bin_of + 1)).alias("bin")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    points = gazetteer.where("lon IS NOT NULL").select(
        "pos", "name", "lat", "lon", bin_of.alias("bin"), F.pmod(F.xxhash64("pos"), F.lit(SALTS)).cast("int").alias("salt")
    )
    distance = places.coordinate_distance(F.col("lat"), F.col("lon"), F.col("x"), F.col("y"))

    def meet(asked: DataFrame) -> DataFrame:
        near = (F.abs(F.col("lon") - F.col("x")) <= tolerance) & F.coalesce(F.col("lat") >= F.col("y") - v.LAT_SLACK, F.lit(True))
        return points.join(asked, ["bin", "salt"]).where(near).withColumn("distance", distance)

    least = meet(asked).groupBy("x", "y", "salt").agg(F.min("distance").alias("least"))
    fifth = F.get(F.sort_array(F.collect_list("least")), F.lit(v.COORDINATE_TOP - 1))
    bounds = least.groupBy(F.col("x").alias("__x"), F.col("y").alias("__y")).agg(fifth.alias("bound"))
    bounded = asked.join(bounds, (F.col("x") == F.col("__x")) & F.col("y").eqNullSafe(F.col("__y"))).drop("__x", "__y")
    near = meet(bounded).where("bound IS NULL OR distance <= bound")
    ranked = near.select("x", "y", "pos", "name", "distance").withColumn(
        "rank", F.row_number().over(Window.partitionBy("x", "y").orderBy("distance", "pos"))
    )
    top = ranked.where(F.col("rank") <= v.COORDINATE_TOP).groupBy("x", "y").agg(
        F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("top")
    )
    return top.select(F.col("x").alias("lon"), F.col("y").alias("lat"), F.col("top")["name"].alias("names"))


def _with_nearest(rows: DataFrame, name: str, lon: Column, lat: Column, gazetteer: DataFrame, tolerance: float) -> DataFrame:
    nowhere = F.lit(_NOWHERE) - F.pmod(F.monotonically_increasing_id(), F.lit(_NOWHERE_PARTS))
    placed = rows.select("*", lon.alias("__lon"), lat.alias("__lat")).withColumn("__at", F.coalesce("__lon", nowhere))
    axes = rows.select(lon.alias("lon"), lat.alias("lat"))
    found = nearest_points(axes, gazetteer, tolerance).select(
        F.col("lon").alias("__x"), F.col("lat").alias("__y"), F.col("names").alias("__names")
    )
    same = (F.col("__at") == F.col("__x")) & F.col("__lat").eqNullSafe(F.col("__y"))
    none = F.array().cast("array<string>")
    return placed.join(found, same, "left").select(*[f"`{c}`" for c in rows.columns], F.coalesce("__names", none).alias(name))


def imd_subdivisions(
    rows: DataFrame, region: Column, gazetteer: DataFrame, name: str = "names", tolerance: float = v.IMD_LON_TOLERANCE
) -> DataFrame:
    """Rows with up to five points near a coordinate phrase; the latitude may be missing."""
    return _with_nearest(rows, name, text.longitude(region), text.min_latitude(region), gazetteer, tolerance)


def form_subdivisions(
    rows: DataFrame, region: Column, gazetteer: DataFrame, officials: DataFrame, name: str = "names",
    tolerance: float = v.FORM_LON_TOLERANCE,
) -> DataFrame:
    """As above among official names only, and only with both coordinates given."""
    allowed = gazetteer.join(officials.select("name"), "name", "left_semi")
    lon, lat = text.longitude(region), text.min_latitude(region)
    return _with_nearest(rows, name, F.when(lat.isNotNull(), lon), lat, allowed, tolerance)


def officials_of(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(pos, key, name) of the list `names` (pos, name) or, where that is empty, of the gazetteer's names."""
    own = names.select("pos", "name")
    given = own.agg(F.count(F.lit(1))).scalar()
    listed = own.unionByName(gazetteer.select("pos", "name").where(given == 0))
    return listed.select("pos", text.subdivision_key(F.col("name")).alias("key"), "name")


# --- names ------------------------------------------------------------------------------


def _parts(texts: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
    """The texts with each different `part` of them that is as long as some text of the other side; the empty part too.

    They are many more than Spark takes them for, by the size of the files behind them, so joins of parts are hinted as merge joins:
    neither side is sent through the driver.
    """
    lengths = others.agg(F.collect_set(F.length(other))).scalar()
    size, length = F.length(column), F.col("__length")
    cut = texts.select("*", lengths.alias("__lengths")).select("*", F.explode(F.filter("__lengths", lambda n: n <= size)).alias("__length"))
    starts = F.when(length == 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), size - length + 1))
    parts = F.array_distinct(F.transform(starts, lambda at: F.substr(F.col(column), at, length)))
    return cut.select(*texts.columns, F.explode(parts).alias("part"))


def _different(keys: DataFrame) -> DataFrame:
    return keys.select("key").where("key IS NOT NULL").distinct()


def alias_exact(keys: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, names) of keys that equal an alias."""
    first = aliases.groupBy("key").agg(F.min_by("names", "pos").alias("names"))
    return first.join(_different(keys), "key", "left_semi")


def alias_longest(keys: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, names) of the longest alias that holds, or is held by, the key.

    Parts of either side are equi-join keys for the other, and parts of aliases are folded to the longest alias that has them before
    they meet a key.
    """
    asked = _different(keys)
    rank = F.struct((-F.length("alias")).alias("size"), F.col("pos").alias("pos"))
    named = aliases.select(F.col("key").alias("alias"), "pos", "names").withColumn("rank", rank)
    by_alias = named.groupBy("alias").agg(F.min_by("names", "rank").alias("names"), F.min("rank").alias("rank"))
    held = _parts(asked, "key", named, "alias").hint("merge").join(by_alias.withColumnRenamed("alias", "part"), "part").select("key", "rank", "names")
    holding = _parts(by_alias, "alias", asked, "key").groupBy(F.col("part").alias("key")).agg(
        F.min("rank").alias("rank"), F.min_by("names", "rank").alias("names")
    ).join(asked, "key")
    return held.unionByName(holding.select("key", "rank", "names")).groupBy("key").agg(F.min_by("names", "rank").alias("names"))


def official_fuzzy(keys: DataFrame, officials: DataFrame) -> DataFrame:
    """(key, names): all names that hold, or are held by, the key, longest name first. An empty key has none."""
    asked = _different(keys).where("key <> ''")
    named = officials.select(F.col("key").alias("own"), "pos", "name")
    held = _parts(asked, "key", named, "own").hint("merge").join(named.withColumnRenamed("own", "part"), "part").select("key", "pos", "name")
    # equal ones are among the held
    holding = _parts(named, "own", asked, "key").where("part <> own").withColumnRenamed("part", "key").hint("merge").join(asked, "key")
    return _listed(held.unionByName(holding.select("key", "pos", "name")), -F.length("name"))


def token_containment(keys: DataFrame, officials: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, names): names, alias names apart, whose core words all occur in the key.

    A name is looked up by that core word which the fewest keys have, and checked on the others.
    """
    worded = _different(keys).select("key", F.array_distinct(F.split("key", " ")).alias("words"))
    stop = F.array(*[F.lit(w) for w in v.TOKEN_STOP_WORDS])
    core = F.filter(F.split("key", " "), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    named = officials.join(aliases.select("key"), "key", "left_anti").select("pos", "name", F.array_distinct(core).alias("core"))
    by_word = worded.select("key", "words", F.explode("words").alias("word"))
    held = by_word.groupBy("word").agg(F.count(F.lit(1)).alias("n_keys"))
    rarest = named.select("*", F.explode("core").alias("word")).join(held, "word", "left").groupBy("pos", "name", "core").agg(
        F.min_by("word", F.struct(F.coalesce("n_keys", F.lit(0)).alias("n"), F.col("word").alias("word"))).alias("word")
    )
    found = rarest.join(by_word, "word").where(F.size(F.array_except("core", "words")) == 0)
    return _listed(found.select("key", "pos", "name"), F.lit(0))


def _listed(found: DataFrame, first: Column) -> DataFrame:
    """(key, names) in order of `first` and place."""
    ranked = F.array_sort(F.collect_list(F.struct(first.alias("first"), F.col("pos").alias("pos"), F.col("name").alias("name"))))
    return found.groupBy("key").agg(ranked.alias("ranked")).select("key", F.col("ranked")["name"].alias("names"))


def with_names(rows: DataFrame, key: str, found: DataFrame, name: str = "names") -> DataFrame:
    """Rows with what was found for their key, NULL where nothing was."""
    answers = found.select(F.col("key").alias("__key"), F.col("names").alias("__names"))
    joined = rows.join(answers, F.col(f"`{key}`") == F.col("__key"), "left")
    return joined.select(*[f"`{c}`" for c in rows.columns], F.col("__names").alias(name))
