"""Queries of message text, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.functions import text as tx
from watchgrid.sources.fixtures import view, with_views


def posts(spark, sf):
    return view(spark, sf, "fx_posts")


def lines(spark, sf):
    """Lines of messages: post_id, line (from 0), text."""
    return posts(spark, sf).select("post_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def _of_posts(**columns):
    return lambda spark, sf: posts(spark, sf).select("post_id", *[f("text").alias(k) for k, f in columns.items()])


def _of_lines(**columns):
    return lambda spark, sf: lines(spark, sf).select("post_id", "line", *[f("text").alias(k) for k, f in columns.items()])


def _on(f):
    return lambda name: f(F.col(name))


def q_looks(spark, sf):
    live = tx.live_lines(tx.strip_boilerplate(F.col("text")))
    return posts(spark, sf).select("post_id", tx.looks_like_report(live).alias("looks"))


def q_stated(spark, sf):
    return posts(spark, sf).select("post_id", tx.stated_time(F.col("text")).alias("stated"))


def q_observed(spark, sf):
    stated = tx.stated_time(tx.strip_boilerplate(F.col("text")))
    return posts(spark, sf).select("post_id", F.coalesce(tx.observed_at(stated, F.col("posted_at")), "posted_at").alias("observed_at"))


def q_html(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", tx.html_text(F.col("html")).alias("text"))


def q_fallback(spark, sf):
    """Whether a message goes to the fallback: it looks like a report and gave none, or gave one of low confidence."""
    p = posts(spark, sf).withColumn("cleaned", tx.strip_boilerplate(F.col("text")))
    found = view(spark, sf, "fx_reports").where("report_id % 3 <> 0").select(F.col("report_id").alias("post_id"), "confidence")
    least = found.groupBy("post_id").agg(F.min("confidence").alias("least"))
    p = p.join(least, "post_id", "left")
    asks = F.when(F.col("least").isNull(), tx.looks_like_report(tx.live_lines(F.col("cleaned")))).otherwise(F.col("least") < 0.5)
    refused = (F.col("cleaned") == "") | tx.is_fundraising(F.col("cleaned")) | tx.is_sensitive(F.col("cleaned"))
    return p.select("post_id", (~refused & asks).alias("needs_fallback"))


def q_pending(spark, sf):
    """The 200 oldest messages that wait; the limit is the batch that a parser asks for."""
    p = posts(spark, sf).where((F.col("parse_state") == "pending") & (F.col("text") != "") & ~tx.is_sensitive(F.col("text")))
    return p.orderBy("posted_at", "post_id").limit(200).select("post_id", "posted_at")


def q_skip(spark, sf):
    skipped = (F.col("parse_state") == "pending") & ((F.col("text") == "") | tx.is_sensitive(F.col("text")))
    return posts(spark, sf).select("post_id", F.when(skipped, "skipped").otherwise(F.col("parse_state")).alias("parse_state"))


def q_requeue(spark, sf, version: int = 3):
    return posts(spark, sf).select("post_id", F.when(F.col("parser_version") < version, "pending").otherwise(F.col("parse_state")).alias("parse_state"))


def q_areas(spark, sf):
    kinds = F.expr("CASE place_id % 5 WHEN 0 THEN 'м. ' || name WHEN 1 THEN name || ' район' WHEN 2 THEN name || ' [hromada]' WHEN 3 THEN upper(name) || '’s громада ' ELSE name END")
    return view(spark, sf, "fx_places").select("place_id", tx.normalise_area(kinds).alias("area"))


def q_normalise(spark, sf):
    name = F.expr("CASE place_id % 4 WHEN 0 THEN upper(name) WHEN 1 THEN '  ' || replace(name, ' ', '   ') WHEN 2 THEN replace(name, ' ', 'ʼ') ELSE name || '`́' END")
    return view(spark, sf, "fx_places").select("place_id", tx.normalise(name).alias("name"))


def q_channels(spark, sf):
    """Channels in byte order, with how many messages each has."""
    return spark.read.parquet(f"{sf}/documents.parquet").groupBy("source").agg(F.count("*").alias("n_messages")).orderBy("source")


def q_top(spark, sf, k: int = 5):
    """The ``k`` commonest first words of lines that name no type; ties by the word."""
    rows = lines(spark, sf).where(tx.classify_type(F.col("text")) == "unknown").select(F.regexp_extract("text", r"^(\S+)", 1).alias("word")).where("word <> ''")
    return rows.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def q_batch(spark, sf, cursor: int = 50):
    """The next 300 reports after a cursor; the limit is the batch that a notifier asks for."""
    return view(spark, sf, "fx_reports").where(F.col("report_id") > cursor).orderBy("report_id").limit(300).select("report_id", "type")


def q_link(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.lit("https://t.me/"), "source", F.lit("/"), "doc_id").alias("link"))


def queries() -> dict:
    return {
        "strip_boilerplate": _of_posts(cleaned=_on(tx.strip_boilerplate)),
        "is_fundraising": _of_posts(fundraising=_on(tx.is_fundraising)),
        "is_sensitive": _of_posts(sensitive=_on(tx.is_sensitive)),
        "drop_lost_lines": _of_posts(live=lambda c: tx.without_lines(F.col(c), tx.LOST)),
        "drop_stand_down": _of_posts(live=lambda c: tx.without_lines(F.col(c), tx.STAND_DOWN)),
        "looks_like_report": q_looks,
        "needs_fallback": q_fallback,
        "classify_type": _of_lines(type=_on(tx.classify_type)),
        "infer_bare_type": _of_lines(type=_on(tx.infer_bare_type)),
        "extract_count": _of_lines(n=_on(tx.extract_count)),
        "course_stated": _of_lines(course_deg=_on(tx.course_stated)),
        "course_approach": _of_lines(course_deg=_on(tx.course_approach)),
        "stated_time": q_stated,
        "observed_at": q_observed,
        "normalise": q_normalise,
        "normalise_area": q_areas,
        "html_text": q_html,
        "pending_queue": q_pending,
        "skip_unparseable": q_skip,
        "requeue_by_version": q_requeue,
        "channel_list": q_channels,
        "top_k": q_top,
        "report_batch": q_batch,
        "source_link": q_link,
    }


def re2(pattern: str, case: bool = False) -> str:
    """A pattern for DuckDB, which knows no look-around: edges of words are taken along."""
    return "'" + (("" if case else "(?i)") + pattern.replace("<", r"(^|[^\p{L}\p{N}])").replace(">", r"([^\p{L}\p{N}]|$)")).replace("'", "''") + "'"


def _has(text: str, patterns: list[str], case: bool = False) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {re2(p, case)})" for p in patterns) + ")"


def _trim(text: str) -> str:
    return rf"regexp_replace({text}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"


def _without(text: str, patterns: list[str]) -> str:
    return f"array_to_string(list_filter(string_split({text}, chr(10)), lambda x: NOT {_has('x', patterns)}), chr(10))"


def _clean(text: str) -> str:
    return _trim(rf"regexp_replace({_without(text, tx.BOILERPLATE)}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def _case(branches, otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in branches) + f" ELSE {otherwise} END"


def oracle_sql() -> dict:
    p = lambda q: with_views(" " + q, "fx_posts")
    l = lambda q: with_views(", l AS (SELECT post_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10)))))::INT AS line FROM fx_posts) " + q, "fx_posts")  # noqa: E731, E741
    kind = _case([(_has("text", [x]), f"'{t}'") for t, x in tx.TYPES], "'unknown'")
    live = _without("cleaned", [tx.LOST, tx.STAND_DOWN])
    looks = f"({_has('live', [tx.REPORT])} AND {_has('live', [tx.NAME], True)})"
    word = r"replace(lower(regexp_extract(t, '^([\p{L}''’]+)\s+\p{L}', 1)), '’', '''')"
    number = r"TRY_CAST(regexp_extract(t, '(?i)^(\d{1,3})\s*(?:х|x|шт\.?)?\s*\p{L}', 1) AS INT)"
    count = _case([(f"{word} = '{w.replace(chr(39), chr(39) * 2)}'", n) for w, n in tx.NUMBERS.items()], f"CASE WHEN {number} BETWEEN 1 AND 200 THEN {number} ELSE 1 END")
    stated = _case([(_has("text", [c.format(x) for c in tx.COURSES]), d) for d, x in tx.POINTS])
    phrase = f"regexp_extract(text, {re2(tx.FROM)}, 1)"
    approach = _case([(_has("phrase", [x]), (d + 180) % 360) for d, x in tx.FROM_POINTS])
    time = r"""nullif(regexp_extract(regexp_extract(regexp_replace(text,
  '(?i)(орієнтовн\p{L}*|приблизн\p{L}*|\+-|±|~|(^|[^\p{L}])до)\s*((о|об)\s+\d{1,2}[:.]\d{2}|\[\d{2}\.\d{2}\.\d{4}\s+\d{1,2}:\d{2}\])', ' ', 'g'),
  '(?i)(^|[^\p{L}\p{N}])(о|об)\s+\d{1,2}[:.]\d{2}($|\D)|\[\d{2}\.\d{2}\.\d{4}\s+\d{1,2}:\d{2}\]'), '(\d{1,2}[:.]\d{2})\]?\D?$', 1), '')"""
    out = {
        "strip_boilerplate": p(f"SELECT post_id, {_clean('text')} AS cleaned FROM fx_posts"),
        "is_fundraising": p(f"SELECT post_id, {_has('text', tx.FUNDRAISING)} AS fundraising FROM fx_posts"),
        "is_sensitive": p(f"SELECT post_id, {_has('text', tx.SENSITIVE)} AS sensitive FROM fx_posts"),
        "drop_lost_lines": p(f"SELECT post_id, {_without('text', [tx.LOST])} AS live FROM fx_posts"),
        "drop_stand_down": p(f"SELECT post_id, {_without('text', [tx.STAND_DOWN])} AS live FROM fx_posts"),
        "looks_like_report": p(f"SELECT post_id, {looks} AS looks FROM (SELECT post_id, {live} AS live FROM (SELECT post_id, {_clean('text')} AS cleaned FROM fx_posts))"),
        "needs_fallback": with_views(
            f""", r AS (SELECT report_id AS post_id, min(confidence) AS least FROM fx_reports WHERE report_id % 3 <> 0 GROUP BY 1),
a AS (SELECT post_id, {_clean('text')} AS cleaned FROM fx_posts), b AS (SELECT *, {live} AS live FROM a)
SELECT post_id, NOT (cleaned = '' OR {_has('cleaned', tx.FUNDRAISING + tx.SENSITIVE)}) AND CASE WHEN least IS NULL THEN {looks} ELSE least < 0.5e0 END AS needs_fallback FROM b LEFT JOIN r USING (post_id)""",
            "fx_posts",
            "fx_reports",
        ),
        "classify_type": l(f"SELECT post_id, line, {kind} AS type FROM l"),
        "infer_bare_type": l(f"SELECT post_id, line, CASE WHEN {_has('text', [tx.BARE])} THEN 'uav' END AS type FROM l"),
        "extract_count": l(f"SELECT post_id, line, {count} AS n FROM (SELECT post_id, line, {_trim('text')} AS t FROM l)"),
        "course_stated": l(f"SELECT post_id, line, ({stated})::DOUBLE AS course_deg FROM l"),
        "course_approach": l(f"SELECT post_id, line, ({approach})::DOUBLE AS course_deg FROM (SELECT *, {phrase} AS phrase FROM l)"),
        "stated_time": p(f"SELECT post_id, {time} AS stated FROM fx_posts"),
        # Kyiv is two hours ahead in the months of the table
        "observed_at": p(
            f"""SELECT post_id, coalesce(CASE WHEN h <= 23 AND m <= 59 THEN CASE WHEN abs(epoch_us(x) - epoch_us(posted_at)) <= 21600000000 THEN x
  WHEN abs(epoch_us(x) - 86400000000 - epoch_us(posted_at)) <= 21600000000 THEN x - INTERVAL 1 DAY WHEN abs(epoch_us(x) + 86400000000 - epoch_us(posted_at)) <= 21600000000 THEN x + INTERVAL 1 DAY END END, posted_at) AS observed_at
FROM (SELECT *, date_trunc('day', posted_at + INTERVAL 2 HOUR) + to_hours(h) + to_minutes(m) - INTERVAL 2 HOUR AS x
  FROM (SELECT *, TRY_CAST(regexp_extract(t, '^(\\d+)[:.]', 1) AS INT) AS h, TRY_CAST(regexp_extract(t, '[:.](\\d+)$', 1) AS INT) AS m FROM (SELECT post_id, posted_at, {time} AS t FROM (SELECT post_id, posted_at, {_clean('text')} AS text FROM fx_posts))))"""
        ),
        "normalise": with_views(
            rf""" SELECT place_id, {_trim(r"regexp_replace(replace(translate(lower(CASE place_id % 4 WHEN 0 THEN upper(name) WHEN 1 THEN '  ' || replace(name, ' ', '   ') WHEN 2 THEN replace(name, ' ', 'ʼ') ELSE name || '`́' END), '’`´ʼ‘', ''''''''''''), '́', ''), '\s+', ' ', 'g')")} AS name FROM fx_places""",
            "fx_places",
        ),
        "normalise_area": with_views(
            r""", a AS (SELECT place_id, CASE place_id % 5 WHEN 0 THEN 'м. ' || name WHEN 1 THEN name || ' район' WHEN 2 THEN name || ' [hromada]' WHEN 3 THEN upper(name) || '’s громада ' ELSE name END AS x FROM fx_places)
SELECT place_id, trim(replace(lower(regexp_replace(regexp_replace(regexp_replace(x, '(?i)^м\.\s*', ''), '(?i)\s*\[hromada\]\s*', ''), '(?i)\s*(район|громада)\s*$', '')), '’', '''')) AS area FROM a""",
            "fx_places",
        ),
        "html_text": rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM a)
SELECT page_id, {_trim(r"regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[\s\x{00A0}]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM b""",
        "pending_queue": p(f"SELECT post_id, posted_at FROM fx_posts WHERE parse_state = 'pending' AND text <> '' AND NOT {_has('text', tx.SENSITIVE)} ORDER BY posted_at, post_id LIMIT 200"),
        "skip_unparseable": p(f"SELECT post_id, CASE WHEN parse_state = 'pending' AND (text = '' OR {_has('text', tx.SENSITIVE)}) THEN 'skipped' ELSE parse_state END AS parse_state FROM fx_posts"),
        "requeue_by_version": p("SELECT post_id, CASE WHEN parser_version < 3 THEN 'pending' ELSE parse_state END AS parse_state FROM fx_posts"),
        "channel_list": "SELECT source, count(*) AS n_messages FROM documents GROUP BY source",
        "top_k": l(f"SELECT word, count(*) AS n FROM (SELECT regexp_extract(text, '^(\\S+)', 1) AS word FROM l WHERE {kind} = 'unknown') WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 5"),
        "report_batch": with_views(" SELECT report_id, type FROM fx_reports WHERE report_id > 50 ORDER BY report_id LIMIT 300", "fx_reports"),
        "source_link": "SELECT doc_id, 'https://t.me/' || source || '/' || doc_id AS link FROM documents",
    }
    return out
