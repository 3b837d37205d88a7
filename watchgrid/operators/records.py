"""Places, messages, sessions and the change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of place classes.
WEIGHTS = {"city": 4, "town": 3, "village": 2, "hamlet": 1}

# Words that are near some place's name and mean none.
STOPWORDS = (
    "містом", "тепер", "зараз", "захід", "схід", "північ", "південь", "півночі", "півдня", "заходу", "сходу", "південний", "північний", "західний",
    "східний", "напрямку", "курсом", "районі", "район", "області", "область", "кордон", "кордону", "межі", "межу", "околиці", "місто", "міста",
    "місті", "села", "село", "селі", "бпла", "шахед", "шахеди", "ракета", "ракети", "групи", "група", "ціль", "цілі", "повз", "через", "вздовж",
    "море", "моря", "морі", "водосховище", "водосховища", "відчуження", "чорнобильської", "обережно", "увага", "загроза", "загрозу",
)


def place_rank() -> Column:
    weight = F.coalesce(*[F.when(F.col("place") == k, F.lit(v)) for k, v in WEIGHTS.items()], F.lit(0))
    return weight * 10_000_000 + F.col("population")


def candidate_rank(places: DataFrame) -> DataFrame:
    """Places of a name by class weight and population; ties by id. ``pick`` is 1 for the first of a name and region."""
    rank = places.withColumn("rank", place_rank())
    by = Window.partitionBy("name", "region").orderBy(F.desc("rank"), "place_id")
    pool = Window.partitionBy("name", "region")
    n = F.count("*").over(pool)
    confidence = F.when(n == 1, 1.0).when(n <= 3, 0.8).otherwise(0.6)
    return rank.withColumns({"pick": F.row_number().over(by), "confidence": confidence})


def place_fuzzy(mentions: DataFrame, places: DataFrame, least: int = 5, most: int = 1, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """(mention_id, d, place_id, confidence): the nearest spelling of the whole lexicon, if its place is in the mention's region.

    Same first letter, edit distance at most ``most`` (and never 2 below 8 letters). The least distance over all names
    comes first and the region after, so a mention whose nearest spelling lies elsewhere, or is its own, has no row. Of
    the region's places of that distance the highest rank is taken, of ties the smallest id. Stopwords have no row.
    Spellings are taken as normalised.

    Distances are taken once for each distinct pair of spellings that meet by first letter and length.
    """
    size = F.length("mention")
    limit = F.least(F.lit(most), F.when(size >= 8, 2).otherwise(1))
    asked = mentions.where(F.col("region").isNotNull() & (size >= least) & ~F.col("mention").isin(*stopwords)).select("mention_id", "mention", "region")
    spelling = asked.select("mention").distinct().withColumns({"first": F.substring("mention", 1, 1), "limit": limit})
    spelling = spelling.withColumn("len", F.explode(F.sequence(size - F.col("limit"), size + F.col("limit"))))
    names = places.select("name").distinct().withColumns({"first": F.substring("name", 1, 1), "len": F.length("name")})
    near = spelling.join(names, ["first", "len"]).withColumn("d", F.levenshtein("mention", "name", most)).where("d >= 0 and d <= limit")
    near = near.withColumn("best", F.min("d").over(Window.partitionBy("mention"))).where("d = best and d > 0").select("mention", "name", "d")
    pool = places.groupBy("name", "region").agg(F.count("*").alias("n"), F.min(F.struct((-place_rank()).alias("rank"), "place_id")).alias("b"))
    found = asked.select("mention", "region").distinct().join(near, "mention").join(pool, ["name", "region"])
    picked = found.groupBy("mention", "region").agg(F.min("d").alias("d"), F.sum("n").alias("n"), F.min("b").alias("b"))
    confidence = F.when(F.col("n") == 1, 1.0).when(F.col("n") <= 3, 0.8).otherwise(0.6) * F.when(F.col("d") == 1, 0.7).otherwise(0.55)
    return asked.join(picked, ["mention", "region"]).select("mention_id", "d", F.col("b.place_id").alias("place_id"), F.round(confidence, 6).alias("confidence"))


def ingest(stored: DataFrame, captured: DataFrame) -> DataFrame:
    """State of each captured message against what is stored: inserted, edited (another content hash) or unchanged."""
    one = stored.select("channel", "message_id", F.sha1("text").alias("old"))
    two = captured.select("channel", "message_id", F.sha1("text").alias("content_hash"))
    state = F.when(F.col("old").isNull(), "inserted").when(F.col("old") != F.col("content_hash"), "edited").otherwise("unchanged")
    return two.join(one, ["channel", "message_id"], "left").select("channel", "message_id", "content_hash", state.alias("state"))


def seq_gaps(log: DataFrame, width: int = 10_000) -> DataFrame:
    """(after, before) of each gap in the sequence.

    Blocks of ``width`` numbers are looked through on their own, then blocks of blocks; only the ends of the latter, a row for
    ``width`` squared numbers, meet in one window.
    """
    rows = log.select(F.col("seq").alias("first"), F.col("seq").alias("last")).distinct()
    found = None
    for level in (1, 2, 3):
        block = F.floor(F.col("first") / width**level) if level < 3 else F.lit(0)
        rows = rows.withColumn("block", block)
        inside = rows.select(F.lag("last").over(Window.partitionBy("block").orderBy("first")).alias("after"), F.col("first").alias("before"))
        found = inside if found is None else found.union(inside)
        rows = rows.groupBy("block").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("block")
    return found.where("before > after + 1")


def live_state(log: DataFrame) -> DataFrame:
    """The latest change of each entity, without deleted ones."""
    last = log.groupBy("entity").agg(F.max_by(F.struct("kind", "value", "seq"), "seq").alias("x"))
    return last.where("x.kind <> 'delete'").select("entity", F.col("x.seq").alias("seq"), F.col("x.value").alias("value"))


def sessions(reports: DataFrame, gap_min: int = 25) -> DataFrame:
    """Runs of reports of a type and channel without a gap of over ``gap_min`` minutes: number, first, last, reports.

    Breaks are found day by day; a channel's days, a row each, then say where a session goes on over midnight.
    """
    key, gap = ["type", "channel_no"], gap_min * 60_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = reports.withColumn("day", F.date_trunc("day", "observed_at").cast("timestamp_ntz"))
    by = Window.partitionBy(*key, "day").orderBy("observed_at", "report_id")
    rows = rows.withColumn("fresh", F.coalesce((micros("observed_at") - F.lag(micros("observed_at")).over(by) > gap).cast("int"), F.lit(0)))
    days = rows.groupBy(*key, "day").agg(F.min("observed_at").alias("first"), F.max("observed_at").alias("last"), F.sum("fresh").alias("breaks"))
    order = Window.partitionBy(*key).orderBy("day")
    opens = F.coalesce((micros("first") - F.lag(micros("last")).over(order) > gap).cast("int"), F.lit(1))
    days = days.withColumn("opens", opens).withColumn("before", F.sum(F.col("opens") + F.col("breaks")).over(order) - F.col("breaks")).select(*key, "day", "before")
    runs = rows.withColumn("nth", F.sum("fresh").over(by)).groupBy(*key, "day", "nth").agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.count("*").alias("n_reports"))
    runs = runs.join(days, [*key, "day"]).withColumn("session", F.col("before") + F.col("nth"))
    return runs.groupBy(*key, "session").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n_reports").alias("n_reports"))
