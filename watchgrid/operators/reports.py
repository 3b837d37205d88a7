"""Reports from messages: what each clause names, where that is, where it goes and where it came from.

Lines, clauses, cues and names become rows, by built-in functions. Distinct names meet the lexicon once, for every region that a context may give
(places.place_resolve). What depends on order, a message's region, type, city and launch heading, is then one pass over its clauses.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from watchgrid.functions import clauses as cl
from watchgrid.functions import geo
from watchgrid.functions import text as tx
from watchgrid.operators import places as pl
from watchgrid.operators.inbox import TARGET
from watchgrid.session import cut, ship

# Launch sites with their place and the forms of their names.
SITES = [
    ("Орел", 52.967, 36.07, ["орел", "орла", "орлі", "орлом", "орловська", "орловщина", "орловщини", "орловської", "орловська область", "орловської області"]),
    ("Курськ", 51.75, 36.295, ["курськ", "курська", "курську", "курщина", "курщини", "халино", "халіно", "курська область", "курської області"]),
    ("Шаталово", 54.363, 32.435, ["шаталово", "шаталове", "шаталова", "смоленськ", "смоленська", "смоленщина", "смоленщини", "смоленська область", "смоленської області"]),
    ("Приморсько-Ахтарськ", 46.046, 38.171, ["приморсько-ахтарськ", "приморсько-ахтарська", "приморсько-ахтарського", "ахтарськ", "ахтарська", "ахтарського"]),
    ("Міллерово", 48.949, 40.398, ["міллерово", "міллєрово", "міллерова", "міллєрова"]),
    ("Брянськ", 53.243, 34.364, ["брянськ", "брянська", "брянську", "брянщина", "брянщини", "брянська область", "брянської області"]),
    ("Навля", 52.828, 34.489, ["навля", "навлі", "навлю"]),
    ("Ростов", 47.235, 39.701, ["ростов", "ростова", "ростовська", "ростовщина", "ростовщини", "ростовська область", "ростовської області"]),
    ("Таганрог", 47.236, 38.897, ["таганрог", "таганрога", "таганрозі"]),
    ("Єйськ", 46.711, 38.274, ["єйськ", "ейськ", "єйська", "єйську"]),
    ("Чауда", 45.032, 36.011, ["чауда", "чауди", "чауді", "чаудою"]),
    ("Гвардійське", 45.117, 33.983, ["гвардійське", "гвардійського", "гвардійському"]),
]
# A heading with and without its mark, a launch, the header's city, a name.
HEADING = r"^\s*([А-ЯІЇЄҐ][А-Яа-яІіЇїЄєҐґ'’-]{3,20})\s*[:\-–—]\s*"
BARE_HEADING = r"^\s*([А-ЯІЇЄҐ][А-Яа-яІіЇїЄєҐґ'’-]{3,20})\s+(?=\S)"
LAUNCH = "<пуск[а-яіїєґ]*"
CITY_WORD = "^міст[оаиуе]м?$"
NAME = r"(?<![\p{L}\p{N}])([А-ЯІЇЄҐ][^\s,.;:!?()]{2,})"
HEADER_LENGTH = 30
#: Pictographs of messages, with what joins and varies them.
PICTOGRAPHS = r"[\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{23FF}\x{24C2}\x{25AA}-\x{25FE}\x{2600}-\x{27BF}\x{2934}-\x{2935}\x{2B05}-\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}\x{FE0F}\x{200D}]"
_PLACE = "struct<kind:string, name:string, region:string, lat:double, lon:double, confidence:double, plain:string, site:boolean>"
_CHOICE = f"struct<plain_place:{_PLACE}, within:map<string,{_PLACE}>>"
_CENTRE = {key: (lat, lon) for key, _, _, lat, lon in pl.REGIONS}
_UP, _DOWN = "\x01", "\x02"


def _map(rows: list[tuple]) -> Column:
    return F.create_map(*[x if isinstance(x, Column) else F.lit(x) for pair in rows for x in pair])


def _words(text: Column) -> Column:
    return F.filter(F.transform(F.split(tx.normalise(text), " "), lambda w: F.regexp_replace(w, '^[«"(]+|[»".,;:!?)]+$', "")), lambda w: w != "")


def _site_of(phrase: Column) -> Column:
    return F.try_element_at(_map([(form, name) for name, _, _, forms in SITES for form in forms]), phrase)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body, or a lambda in it, speaks of it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_site(text: Column) -> Column:
    """The site that the text's first three, two or one words name; null if none does."""
    return _let(_words(text), lambda words: F.coalesce(*[F.when(F.size(words) >= n, _site_of(F.array_join(F.slice(words, 1, n), " "))) for n in (3, 2, 1)]))


def _cover(words: Column) -> Column:
    """The sites that words name by the leftmost, longest windows of up to three words that don't overlap, each site once."""
    names = F.array().cast("array<string>")
    state = F.struct(F.lit(0).alias("free"), names.alias("found"))
    # a window's first word begins some form, for most words none does
    begins = sorted({form.split()[0] for _, _, _, forms in SITES for form in forms})

    def step(s, i):
        window = lambda n: _site_of(F.array_join(F.slice(words, i + 1, n), " "))
        tried = F.coalesce(*[F.when(i + n <= F.size(words), _let(window(n), lambda x, n=n: F.when(x.isNotNull(), F.struct(x.alias("name"), F.lit(n).alias("n"))))) for n in (3, 2, 1)])
        took = lambda hit: F.when(hit.isNull(), s).otherwise(F.struct((i + hit["n"]).alias("free"), F.array_union(s["found"], F.array(hit["name"])).alias("found")))
        return F.when((i < s["free"]) | ~F.element_at(words, i + 1).isin(*begins), s).otherwise(_let(tried, took))

    return F.when(F.size(words) > 0, F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), state, step, lambda s: s["found"])).otherwise(names)


def launch_sites(text: Column) -> Column:
    """All launch sites that a line names, in order: what stands in brackets counts only if nothing outside of them does."""
    outside = _let(_words(F.regexp_replace(text, r"\([^)]*\)", " ")), _cover)
    return _let(outside, lambda found: F.when(F.size(found) > 0, found).otherwise(_let(_words(text), _cover)))


def _fixed(name: Column) -> Column:
    """The place of a site or water."""
    rows = [(name, lat, lon, True) for name, lat, lon, _ in SITES] + [(name, lat, lon, name in cl.LAUNCH_WATERS) for name, lat, lon, _ in pl.WATERS]
    none = F.lit(None).cast("string")
    found = [F.struct(F.lit("oblast"), F.lit(n), none, F.lit(a), F.lit(o), F.lit(0.5), F.lit(""), F.lit(s)).cast(_PLACE) for n, a, o, s in rows]
    return F.try_element_at(_map([(r[0], x) for r, x in zip(rows, found)]), name)


def _with_region(rows: DataFrame, token: str, to: str) -> DataFrame:
    """``rows`` and the region that a column's token names (a bounded table of forms)."""
    known = F.broadcast(pl.region_forms(rows.sparkSession).select(F.col("form").alias("_form"), F.col("region").alias(to)))
    return rows.withColumn("_form", tx.normalise(F.col(token))).join(known, "_form", "left").drop("_form")


def clause_rows(messages: DataFrame) -> DataFrame:
    """message_id, line, clause, launches, base_type, set_region, source_line, rest: the clauses of live lines, with the region of their heading."""
    whole = messages.select("message_id", tx.strip_boilerplate(F.coalesce("text", F.lit(""))).alias("cleaned"))
    whole = whole.where((F.col("cleaned") != "") & ~tx.is_fundraising(F.col("cleaned")) & ~tx.is_sensitive(F.col("cleaned")))
    launches = F.col("cleaned").rlike(tx.java(LAUNCH)).alias("launches")
    lines = whole.select("message_id", launches, tx.classify_type(F.col("cleaned")).alias("base_type"), F.posexplode(F.split(tx.live_lines(F.col("cleaned")), "\n")).alias("line", "text"))
    squeeze = lambda c: tx.trim(F.regexp_replace(F.regexp_replace(c, PICTOGRAPHS, " "), r"\s+", " "))
    lines = lines.withColumn("text", squeeze(F.col("text"))).where("text <> ''").withColumn("head", F.regexp_extract("text", f"(?u){HEADING}", 1))
    lines = _with_region(lines, "head", "headed")
    # the heading is no part of the first clause when clauses are told apart, and is given back to it
    lead = F.when(F.col("headed").isNotNull(), F.regexp_extract("text", f"(?u){HEADING}", 0)).otherwise("")
    lines = lines.withColumn("lead", lead).withColumn("parts", F.split(F.substring(F.col("text"), F.length("lead") + 1, F.length("text")), r"\s*[,;]\s+"))
    alone = F.size(F.filter("parts", lambda c: c.rlike(f"(?iu){cl.SELF_CONTAINED}")))
    several = F.transform("parts", lambda c, i: F.when(i == 0, F.concat("lead", c)).otherwise(c))
    clauses = lines.select("message_id", "line", "launches", "base_type", F.posexplode(F.when(alone > 1, several).otherwise(F.array("text"))).alias("clause", "text"))
    clauses = clauses.withColumn("source_line", squeeze(F.col("text"))).where("source_line <> ''")
    marked = F.regexp_extract("source_line", f"(?u){HEADING}", 1)
    token = F.when(marked != "", marked).otherwise(F.regexp_extract("source_line", f"(?u){BARE_HEADING}", 1))
    clauses = _with_region(clauses.withColumns({"token": token, "marked": marked != ""}), "token", "set_region")
    head = F.when(F.col("marked"), F.regexp_extract("source_line", f"(?u){HEADING}", 0)).otherwise(F.regexp_extract("source_line", f"(?u){BARE_HEADING}", 0))
    rest = F.when(F.col("set_region").isNotNull(), tx.trim(F.substring(F.col("source_line"), F.length(head) + 1, F.length("source_line")))).otherwise(F.col("source_line"))
    return clauses.select("message_id", "line", "clause", "launches", "base_type", "set_region", "source_line", rest.alias("rest"))


def cue_rows(clauses: DataFrame) -> DataFrame:
    """message_id, line, clause, cue, relation, phrases, water, site: the cues of each clause that a place may follow."""
    edge = tx.java(f"<({'|'.join(p for _, p in cl.CUES)})\\s+")
    pieces = F.split(F.regexp_replace("rest", edge, f"{_UP}$0{_DOWN}"), _UP)
    rows = clauses.select("message_id", "line", "clause", F.col("rest").rlike(tx.java(LAUNCH)).alias("launch"), pieces.alias("pieces")).where("size(pieces) > 1")
    rows = rows.withColumn("cue", F.explode(F.sequence(F.lit(1), F.size("pieces") - 1)))
    own = F.get("pieces", F.col("cue"))
    # a cue points at all that follows it, later cues included
    after = F.concat(F.substring_index(own, _DOWN, -1), F.array_join(F.slice("pieces", F.col("cue") + 2, F.size("pieces")), ""))
    rows = rows.select("message_id", "line", "clause", "cue", "launch", tx.trim(F.substring_index(own, _DOWN, 1)).alias("said"), F.replace(after, F.lit(_DOWN), F.lit("")).alias("phrase"))
    rows = pl.water_match(rows.withColumn("phrases", cl.place_candidates(F.col("phrase"))))
    rows = rows.withColumn("site", F.when(F.col("launch"), first_site(F.col("phrase"))))
    rows = rows.where("size(phrases) > 0 or water is not null or site is not null")
    return rows.withColumn("relation", cl.relation(F.col("said"), F.get("phrases", F.lit(0)))).drop("said", "phrase")


def name_places(names: DataFrame, lexicon: DataFrame, made: DataFrame) -> DataFrame:
    """name, choice: what a name stands for without a context, and in the regions where that is another place."""
    contexts = F.array(F.lit(None).cast("string"), *[F.lit(r[0]) for r in pl.REGIONS])
    asked = names.select("name").distinct().withColumn("region", F.explode(contexts)).select(F.struct("name", "region").alias("mention_id"), F.col("name").alias("phrase"), "region")
    found = pl.place_resolve(asked, lexicon, made)
    known = tx.normalise(F.col("name")).isin(*[n.lower() for n, *_ in SITES]) | F.col("name").isin(*cl.LAUNCH_WATERS)
    plain = F.regexp_replace(tx.normalise(F.col("name")), r"[^\p{L}\p{N}]+", "")
    place = F.struct("kind", "name", "region", "lat", "lon", "confidence", plain.alias("plain"), known.alias("site")).cast(_PLACE)
    rows = found.select(F.col("mention_id.name").alias("asked"), F.col("mention_id.region").alias("context"), place.alias("place"))
    one = rows.groupBy("asked").agg(F.max(F.when(F.col("context").isNull(), F.col("place"))).alias("plain_place"), F.collect_list(F.when(F.col("context").isNotNull(), F.struct("context", "place"))).alias("every"))
    within = F.map_from_entries(F.filter("every", lambda x: F.coalesce(x["place"] != F.col("plain_place"), F.lit(True))))
    return one.select(F.col("asked").alias("name"), F.struct("plain_place", within.alias("within")).cast(_CHOICE).alias("choice"))


_OUT = f"message_id string, line int, clause int, nth int, source_line string, rest string, type string, inferred boolean, bare boolean, launched boolean, relation string, region string, place {_PLACE}, origin {_PLACE}, guess struct<lat:double, lon:double>"


def _place(choice: dict | None, region: str | None) -> dict | None:
    """What a name stands for in a region."""
    if choice is None:
        return None
    return dict(choice["within"]).get(region, choice["plain_place"]) if region else choice["plain_place"]


def _read(rows):
    """Reports of clauses, which come in order, message by message; the state that they carry is one message's."""
    message, region, kind, city, launch = object(), None, None, None, False
    for c in rows:
        if c["message_id"] != message:
            message, region, kind, city, launch = c["message_id"], None, c["base_type"], None, False
        region = c["set_region"] or region
        if not c["rest"]:
            continue
        out = {k: c[k] for k in ("message_id", "line", "clause", "source_line", "rest")} | {"nth": 0, "inferred": False, "bare": False, "launched": False, "origin": None, "guess": None}
        header = _place(c["header"], region)
        if header and header["kind"] == "settlement" and header["plain"] == c["plain"]:
            city, region = header, header["region"] or region
            continue
        launch = launch or c["launch"]
        if launch and c["sites"]:
            for nth, site in enumerate(c["sites"]):
                own = c["own_type"] or kind
                yield out | {"nth": nth, "type": own, "relation": "launch" if own in cl.LAUNCHABLE else "from", "place": site, "region": None, "launched": True}
            continue
        type_ = c["own_type"] or kind
        inferred = type_ == "unknown" and c["bare_type"] is not None
        type_ = c["bare_type"] if inferred else type_
        if type_ != "unknown" and not inferred:
            kind = type_
        if type_ == "unknown" and c["weak"]:
            continue
        out |= {"type": type_, "inferred": inferred}
        away = lambda place: out | {"place": place, "region": place["region"], "launched": True, "relation": "launch" if c["launch"] and place["site"] and type_ in cl.LAUNCHABLE else "from"}
        if not c["options"]:
            named = [] if type_ == "unknown" else (_place(w["choice"], region) for w in sorted(c["words"] or [], key=lambda w: w["nth"]))
            found = next((p for p in named if p and p["kind"] == "settlement"), None)
            if found:
                region = found["region"] or region
                yield away(found) if c["launch"] else out | {"relation": "over", "place": found, "region": region, "bare": True}
            continue
        options = sorted(c["options"], key=lambda o: (o["cue"], o["nth"]))
        region = next((o["set_region"] for o in reversed(options) if o["set_region"]), region)
        hits, done = [], set()
        for o in options:
            if o["cue"] not in done:
                place = city if o["city"] else o["fixed"] or _place(o["choice"], region)
                if place:
                    done.add(o["cue"])
                    hits.append((o["relation"], place))
        wide = [h for h in hits if h[1]["kind"] != "settlement"]
        hits = [h for h in hits if h[1]["kind"] == "settlement"] or wide
        if not hits:
            continue
        hits = sorted(hits, key=lambda h: -cl.RANK[h[0]])
        wide = hits if wide and hits[0][1]["kind"] != "settlement" else wide
        relation, to = hits[0]
        if relation == "from" or (c["launch"] and relation != "towards"):
            yield away(to)
            continue
        other = lambda some: next((p for _, p in some if p["name"] != to["name"]), None)
        origin = other(hits[1:])
        guess = None if origin else other(wide)
        if origin is None and guess is None and region and to["region"] and to["region"] != region and region in _CENTRE:
            guess = dict(zip(("lat", "lon"), _CENTRE[region]))
        yield out | {"relation": relation, "place": to, "region": to["region"] or region, "origin": origin, "guess": guess and {k: guess[k] for k in ("lat", "lon")}}
        if to["kind"] == "settlement" and to["region"]:
            region = to["region"]


def _reader(most: int = 5000):
    """``_read`` over Arrow batches; the clauses of a message may go on from one batch to the next."""
    schema = to_arrow_schema(T._parse_datatype_string(_OUT))

    def run(batches):
        held = []
        for report in _read(row for batch in batches for row in batch.to_pylist()):
            held.append(report)
            if len(held) == most:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    return run


def parsed_reports(messages: DataFrame, lexicon: DataFrame, made: DataFrame) -> DataFrame:
    """One row a report: message_id, line, clause, nth, type, raw_type, count, oblast, relation, to_name, to_lat, to_lon, to_area,
    from_name, from_lat, from_lon, course_deg, confidence, source_line.

    ``messages``: message_id (a string, unique), text; ``lexicon``: place_id, name, region, place, population, lat, lon; ``made``: place_id, form.
    A clause's cues give its places; regions only count where no settlement is named. The strongest relation's place is the
    destination, the next different one the origin; a region named beside it, or the context's, gives a course at most. What only comes from somewhere, and each
    site of a launch, has an origin alone. A clause without cues but with a type is over the first settlement it names. A line that
    is a settlement's name alone is the city that later lines mean by "the city". Null and empty texts, advertising, requests for money and sensitive
    messages give nothing. Ties of cues go by order. A message's clauses are read by one task, in order; messages share nothing, so a
    text is read once, however many messages have it.
    """
    asked = messages.where("text <> ''").select(F.col("message_id").alias("_id"), F.sha1("text").alias("message_id"), "text")
    found = cut(_parsed(asked.groupBy("message_id").agg(F.first("text").alias("text")), lexicon, made))
    return asked.drop("text").join(found, "message_id").drop("message_id").select(F.col("_id").alias("message_id"), *found.columns[1:])


def _parsed(messages: DataFrame, lexicon: DataFrame, made: DataFrame) -> DataFrame:
    """``parsed_reports`` of messages of distinct texts."""
    ship(messages.sparkSession)
    key = ["message_id", "line", "clause"]
    clauses = cut(clause_rows(messages))
    cues = cue_rows(clauses)
    # each cue's ways to a place, in order: the city, a site or water, or the parts of a name
    none = F.array(F.struct(F.lit(0).alias("i"), F.lit("").alias("x")))
    each = F.when(F.size("phrases") > 0, F.transform("phrases", lambda x, i: F.struct(i.alias("i"), x.alias("x")))).otherwise(none)
    phrases = cues.withColumn("p", F.explode(each))
    phrases = phrases.withColumn("bare", F.trim("p.x")).withColumn("first", F.split("bare", r"\s+")[0])
    phrases = _with_region(_with_region(phrases, "bare", "r1"), "first", "r2")
    is_city = F.col("bare").rlike(f"(?iu){CITY_WORD}")
    fixed = F.when(~is_city, F.coalesce(_fixed(F.when(F.col("launch"), F.coalesce(first_site(F.col("bare")), F.col("site")))), _fixed(F.col("water"))))
    phrases = phrases.select(*key, "cue", "relation", "p.i", F.coalesce("r1", "r2").alias("set_region"), is_city.alias("city"), fixed.alias("fixed"), F.split("bare", "/").alias("names"))
    options = phrases.select("*", F.posexplode("names").alias("j", "name")).where("j = 0 or (not city and fixed is null)")
    options = options.withColumn("name", F.when(~F.col("city") & F.col("fixed").isNull(), F.col("name")))
    rest, own = F.col("rest"), tx.classify_type(F.col("rest"), F.lit(None).cast("string"))
    any_cue = rest.rlike(tx.java(f"<({'|'.join(p for _, p in cl.CUES)})\\s+"))
    bare = tx.infer_bare_type(rest)
    weak = ~cl.has_evidence(rest, F.lit("unknown"), F.lit(False), tx.extract_count(rest))
    clauses = clauses.withColumns({
        "own_type": own, "bare_type": bare, "weak": weak, "launch": rest.rlike(tx.java(LAUNCH)), "sites": F.when(F.col("launches"), F.transform(launch_sites(rest), _fixed)),
        "plain": F.regexp_replace(tx.normalise(rest), r"[^\p{L}\p{N}]+", ""),
        "head_name": F.when(~any_cue & own.isNull() & (F.length("rest") <= HEADER_LENGTH), rest),
    })
    words = clauses.join(cues.select(*key).distinct(), key, "left_anti").select(*key, F.posexplode(F.regexp_extract_all("rest", F.lit(NAME), 1)).alias("nth", "name"))
    names = options.select("name").union(words.select("name")).union(clauses.select(F.col("head_name").alias("name"))).where("name is not null")
    known = cut(name_places(names, lexicon, made))
    options = options.join(known, "name", "left").groupBy(*key).agg(F.collect_list(F.struct("cue", F.struct("i", "j").alias("nth"), "relation", "set_region", "city", "fixed", "choice")).alias("options"))
    options = options.withColumn("options", F.transform("options", lambda o: o.withField("nth", o["nth"]["i"] * 1000 + o["nth"]["j"])))
    words = words.join(known, "name").groupBy(*key).agg(F.collect_list(F.struct("nth", "choice")).alias("words"))
    rows = clauses.join(known.withColumnsRenamed({"name": "head_name", "choice": "header"}), "head_name", "left").drop("head_name").join(options, key, "left").join(words, key, "left")
    placed = rows.repartition("message_id").sortWithinPartitions(*key)
    found = placed.mapInArrow(_reader(), _OUT)
    rest, to, origin, guess = F.col("rest"), F.col("place"), F.col("origin"), F.col("guess")
    away = F.col("launched")
    stated = tx.course_stated(rest)
    course = F.when(origin.isNotNull(), geo.bearing(origin["lat"], origin["lon"], to["lat"], to["lon"])).otherwise(F.coalesce(stated, tx.course_approach(rest), geo.bearing(guess["lat"], guess["lon"], to["lat"], to["lon"])))
    there = lambda c: F.when(~away, to[c])
    since = lambda c: F.when(away, to[c]).otherwise(origin[c])
    return found.select(
        *key, "nth", "type", cl.raw_type(rest).alias("raw_type"), tx.extract_count(rest).alias("count"), F.col("region").alias("oblast"), "relation",
        there("name").alias("to_name"), there("lat").alias("to_lat"), there("lon").alias("to_lon"), F.when(~away, to["kind"] == "oblast").alias("to_area"),
        since("name").alias("from_name"), since("lat").alias("from_lat"), since("lon").alias("from_lon"), F.when(away, stated).otherwise(course).alias("course_deg"),
        F.round(F.when(away, to["confidence"]).otherwise(cl.report_confidence(to["confidence"], F.col("type"), F.col("inferred"), F.col("bare"))), 6).alias("confidence"), "source_line",
    )


def message_states(messages: DataFrame, found: DataFrame, low: float = 0.5) -> DataFrame:
    """message_id, state (parsed or unparsed), n_reports, needs_fallback, names_object: what the reports ``found`` (message_id, confidence) make of each message.

    A message needs the fallback if it has no report though its live lines look like one, or if a report's confidence is under ``low``. Null and empty texts,
    requests for money and sensitive messages never do. Repeated ids are one message each time they occur. A text is judged once.
    """
    per = found.groupBy("message_id").agg(F.count("*").alias("n"), F.min("confidence").alias("least"))
    asked = messages.select("message_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_text", F.sha1("text"))
    cleaned = tx.strip_boilerplate(F.col("text"))
    refused = (cleaned == "") | tx.is_fundraising(cleaned) | tx.is_sensitive(cleaned)
    named = (cleaned != "") & ~tx.is_sensitive(cleaned) & F.col("text").rlike(TARGET)
    judged = asked.groupBy("_text").agg(F.first("text").alias("text")).select("_text", refused.alias("refused"), named.alias("named"), tx.looks_like_report(tx.live_lines(cleaned)).alias("like"))
    rows = asked.drop("text").join(cut(judged), "_text").join(per, "message_id", "left")
    none = F.col("n").isNull()
    needs = ~F.col("refused") & ((none & F.col("like")) | F.coalesce(F.col("least") < low, F.lit(False)))
    return rows.select("message_id", F.when(none, "unparsed").otherwise("parsed").alias("state"), F.coalesce("n", F.lit(0)).alias("n_reports"), needs.alias("needs_fallback"), F.col("named").alias("names_object"))


def coverage(messages: DataFrame, found: DataFrame) -> DataFrame:
    """One row a type and one of all (null): messages with a report, reports, those of low confidence, with a course, with an origin; in the row of
    all also the messages, the unparsed ones, those of them that name an object (missed), and those for the fallback."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    per = found.rollup("type").agg(
        F.count_distinct("message_id").alias("parsed"), F.count("*").alias("n_reports"), n(F.col("confidence") < 0.6).alias("n_low"), F.count("course_deg").alias("n_course"), F.count("from_lat").alias("n_origin"), F.grouping("type").alias("whole")
    )
    state = message_states(messages, found.select("message_id", "confidence"))
    out = F.col("state") == "unparsed"
    state = state.agg(F.count("*").alias("messages"), n(out).alias("unparsed"), n(out & F.col("names_object")).alias("missed"), n(F.col("needs_fallback")).alias("fallback"))
    # one row of sums beside a row a type
    return per.join(F.broadcast(state.withColumn("whole", F.lit(1).cast("tinyint"))), "whole", "left").drop("whole")
