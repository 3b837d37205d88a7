"""Queries of walks through archived pages and of intervals open at many times, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid import catalog
from watchgrid.operators import walks
from watchgrid.sources.fixtures import view, with_views


def q_backfill(spark, sf):
    """Each channel's walk: pages, oldest id, messages and why it ended; the archive has a hole and a page that doesn't go back."""
    messages, walked = walks.backfill_pages(view(spark, sf, "fx_archive"))
    n = messages.groupBy("channel").agg(F.count("*").alias("n_messages"))
    return walked.join(n, "channel").select("channel", "pages", "oldest_id", "n_messages", "ended")


def q_open_at(spark, sf):
    """Alerts open when each report was observed: how many regions, and the highest level."""
    times = view(spark, sf, "fx_reports").select("report_id", "observed_at")
    found = walks.open_at(times, catalog.q_intervals(spark, sf), at="observed_at")
    return found.groupBy("report_id").agg(F.count("*").alias("n_alerts"), F.max("level").alias("level"), F.min("started_at").alias("since"))


def queries() -> dict:
    return {"backfill_pages": q_backfill, "alerts_at_times": q_open_at}


def oracle_sql() -> dict:
    return {
        "backfill_pages": "WITH RECURSIVE"
        + with_views(
            """, pg AS (SELECT channel, before, min(message_id) AS low FROM fx_archive GROUP BY channel, before),
walk AS (SELECT channel, 1 AS page, before, low FROM pg WHERE before IS NULL
  UNION ALL SELECT pg.channel, page + 1, pg.before, pg.low FROM walk JOIN pg ON pg.channel = walk.channel AND pg.before = walk.low WHERE (walk.before IS NULL OR walk.low < walk.before) AND page < 25),
l AS (SELECT channel, max(page) AS pages, min(low) AS oldest_id, arg_max(coalesce(low >= before, false), page) AS stuck FROM walk GROUP BY channel),
n AS (SELECT w.channel, count(DISTINCT message_id) AS n_messages FROM walk w JOIN fx_archive a ON a.channel = w.channel AND a.before IS NOT DISTINCT FROM w.before GROUP BY w.channel)
SELECT channel, pages, oldest_id, n_messages, CASE WHEN stuck THEN 'stuck' WHEN pages = 25 THEN 'limit' ELSE 'end' END AS ended FROM l JOIN n USING (channel)""",
            "fx_archive",
        ).removeprefix("WITH"),
        "alerts_at_times": with_views(
            catalog._FILLED + """SELECT report_id, count(*) AS n_alerts, max(level) AS level, min(poll_at) AS since
FROM fx_reports JOIN c ON level > 0 AND poll_at <= observed_at AND (ended_at IS NULL OR ended_at > observed_at) GROUP BY report_id""",
            "fx_alert_polls",
            "fx_reports",
        ),
    }
