"""Reports, subscribers, places, polls and a change log, as views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FLAGS = " || ".join(f"CASE (event_id * {k + 3} + user_id) % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'P' ELSE 'N' END" for k in range(27))
_STATE_NAMES = "Вінницька Волинська Дніпропетровська Донецька Житомирська Закарпатська Запорізька Київська Кіровоградська Луганська Львівська Миколаївська Одеська Полтавська Рівненська Сумська Тернопільська Харківська Херсонська Черкаська".split()


def _states(names: list[str]) -> str:
    alert = "CASE (event_id + {0} * user_id) % 3 WHEN 0 THEN 'true' ELSE 'false' END"
    return " || ',' || ".join("'{\"name\":\"" + n + " область\",\"alert\":' || " + alert.format(k) + " || '}'" for k, n in enumerate(names))


#: One text valid in Spark and in DuckDB for each view.
VIEWS = {
    "fx_feed_fixed": f"""
SELECT event_id AS poll_id, substr({_FLAGS}, 1, CASE WHEN event_id % 9 = 0 THEN 20 ELSE 27 END) AS raw FROM events""",
    "fx_feed_states": f"""
SELECT event_id AS poll_id, CASE WHEN event_id % 7 = 0 THEN '[' || {_states(_STATE_NAMES[:9])} || ']' WHEN event_id % 31 = 0 THEN 'busy'
  ELSE '[' || {_states(_STATE_NAMES)} || ',{{"name":" м. Київ ","alert":null}},{{"name":"Нова область","alert":true}}]' END AS raw FROM events""",
    "fx_feed_sitrep": """
SELECT event_id AS poll_id, '# Report' || chr(10)
  || CASE WHEN event_id % 8 = 0 THEN '## 3. STATUS' ELSE '## 3. CURRENT WARNING STATUS' END || chr(10)
  || '**Nominal alerts (Луганська область)** — air raid alert' || chr(10)
  || CASE WHEN event_id % 3 = 0 THEN '**Sumy (Сумська область)** — air raid alert. 2 areas affected: Sumskyi (Сумський район), Okhtyrskyi (Охтирський), Bilopilska [hromada] (Білопільська громада)' || chr(10) ELSE '' END
  || CASE WHEN user_id % 2 = 0 THEN ' **Ternopil (Тернопільська область)** — air raid alert. 3 areas affected: (Тернопільський), (Кременецький), (Чортківський), m. Ternopil (м. Тернопіль)' || chr(10) ELSE '' END
  || CASE WHEN user_id % 5 = 1 THEN '**Kharkiv (Харківська область)** — artillery threat. 1 area affected: (Липецька)' || chr(10) ELSE '' END
  || CASE WHEN user_id % 7 = 2 THEN '**Odesa (Одеська область)** — Air Raid Alert' || chr(10) || '**Odesa (Одеська область)** — air raid alert. Areas affected: (Одеський), (Одеський)' || chr(10) ELSE '' END
  || CASE WHEN user_id % 7 = 3 THEN '**Kyiv (м. Київ)** — air raid alert' || chr(10) || '**Nowhere (Нова область)** — air raid alert' || chr(10) ELSE '' END
  || chr(10) || '## 4. THREAT ACTIVITY' || chr(10)
  || CASE WHEN event_id % 2 = 0 THEN '- **12:0' || CAST(user_id % 10 AS VARCHAR(2)) || ' — UAV group (БпЛА)** over Sumy — heading west' || chr(10) || '- no time' || chr(10) || '- **13:45 — Missile** over the sea' || chr(10) ELSE '' END
  || '## 5. END' || chr(10) AS raw
FROM events""",
    "fx_districts": """
SELECT * FROM (VALUES ('sumska', 'сумський'), ('sumska', 'охтирський'), ('sumska', 'конотопський'), ('ternopilska', 'тернопільський'), ('ternopilska', 'кременецький'),
  ('ternopilska', 'чортківський'), ('odeska', 'одеський'), ('odeska', 'ізмаїльський'), ('kharkivska', 'ізюмський')) AS v(region, district)""",
    "fx_tracked": """
SELECT event_id AS report_id, user_id AS track_id, CAST(event_id % 75 AS INT) AS ago,
  CASE event_id % 6 WHEN 0 THEN 'destination' WHEN 1 THEN 'launch' ELSE 'position' END AS kind,
  CASE event_type WHEN 'click' THEN 'uav' WHEN 'view' THEN 'jet_uav' WHEN 'purchase' THEN 'cruise' WHEN 'signup' THEN 'ballistic' ELSE 'kab' END AS type,
  45.0e0 + (event_id * 37 % 700) * 0.01e0 AS lat, 23.0e0 + (event_id * 53 % 1500) * 0.01e0 AS lon,
  CASE WHEN event_id % 4 <> 0 THEN CAST(event_id * 11 % 360 AS DOUBLE) END AS heading_deg, event_id % 13 = 0 AS area
FROM events""",

    "fx_reports": """
SELECT event_id AS report_id, ts AS observed_at, user_id % 20 AS channel_no,
  CASE event_type WHEN 'click' THEN 'uav' WHEN 'view' THEN 'jet_uav' WHEN 'purchase' THEN 'cruise'
                  WHEN 'signup' THEN 'recon' ELSE 'unknown' END AS type,
  1 + event_id % 4 AS n,
  CASE WHEN event_id % 10 < 5 THEN 'over' WHEN event_id % 10 < 8 THEN 'towards'
       WHEN event_id % 10 = 8 THEN 'launch' ELSE 'from' END AS relation,
  48.0e0 + (user_id % 15) * 0.1e0 + (event_id % 7) * 0.02e0 AS to_lat,
  30.0e0 + floor(user_id / 15) * 0.15e0 + (event_id % 11) * 0.02e0 AS to_lon,
  CASE WHEN event_id % 3 = 0 THEN 47.5e0 + (event_id % 40) * 0.05e0 END AS from_lat,
  CASE WHEN event_id % 3 = 0 THEN 29.5e0 + (event_id % 50) * 0.05e0 END AS from_lon,
  CASE WHEN event_id % 4 <> 0
       THEN CAST((CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) * 5) % 360 AS DOUBLE) END AS course_deg,
  0.4e0 + (event_id % 7) * 0.1e0 AS confidence,
  event_id % 13 = 0 AS to_area
FROM events""",
    "fx_subscribers": """
SELECT c_custkey AS subscriber_id, c_custkey % 10 <> 0 AS is_active,
  CASE WHEN c_custkey % 17 <> 0 THEN 47.8e0 + (c_custkey % 150) * 0.012e0 END AS lat,
  CASE WHEN c_custkey % 17 <> 0 THEN 29.8e0 + (c_custkey % 97) * 0.02e0 END AS lon,
  CAST(5 + c_custkey % 196 AS DOUBLE) AS radius_km
FROM customer""",
    "fx_places": """
SELECT p_partkey AS place_id, p_name AS name, p_size % 25 AS region,
  CASE p_partkey % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'village' ELSE 'hamlet' END AS place,
  CAST(floor(p_retailprice) AS BIGINT) AS population,
  44.5e0 + (p_partkey % 71) * 0.1e0 AS lat, 22.5e0 + (p_partkey % 173) * 0.1e0 AS lon
FROM part""",
    "fx_alert_polls": """
SELECT date_trunc('hour', ts) AS poll_at, user_id % 25 AS region,
  max(CASE WHEN event_type = 'error' THEN 2 WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS level
FROM events GROUP BY date_trunc('hour', ts), user_id % 25""",
    "fx_polygons": """
SELECT n_nationkey AS region, 44.4e0 + floor(n_nationkey / 5) * 1.5e0 AS lat0,
       22.4e0 + (n_nationkey % 5) * 3.5e0 AS lon0
FROM nation""",
    "fx_log": """
SELECT event_id + 1 AS seq, user_id AS entity, CASE WHEN event_id % 10 = 0 THEN 'delete' ELSE 'upsert' END AS kind, value
FROM events WHERE (event_id + 1) % 97 <> 0""",
    "fx_changes": """
SELECT CASE event_type WHEN 'error' THEN 'alert' WHEN 'signup' THEN 'source' ELSE 'track' END AS kind, user_id AS id, event_id + 1 AS seq,
  ts AS at, ts - (event_id % 240) * INTERVAL '1' MINUTE AS seen, event_id % 10 = 0 AS gone, value
FROM events""",
    "fx_lines": """
SELECT event_id AS line_id, user_id AS subscriber_id, event_type || '|' || CAST(event_id % 2 AS VARCHAR(9)) AS subject,
  TIMESTAMP '2024-01-01 00:00:00' + CAST(floor(minutes / 30) AS BIGINT) * INTERVAL '1' SECOND AS at,
  CAST(event_id * 7 % 9 AS DOUBLE) AS distance_km, 'line ' || CAST(event_id AS VARCHAR(20)) AS line,
  CAST(floor(minutes / 7200) AS BIGINT) AS pass
FROM (SELECT *, (day(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) AS minutes FROM events) e""",
    "fx_first_captures": """
SELECT source AS channel, doc_id AS message_id, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' SECOND AS captured_at, coalesce(text, '') AS text
FROM documents WHERE doc_id IS NOT NULL""",
    "fx_posts": """
SELECT event_id AS post_id, user_id % 20 AS channel_no, ts AS posted_at, event_id % 5 AS parser_version,
  CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'parsed' WHEN 2 THEN 'unparsed' ELSE 'pending' END AS parse_state,
  CASE WHEN event_id % 29 = 0 THEN '' ELSE
  CASE event_id % 9 WHEN 1 THEN 'Сумщина:' || chr(10) WHEN 2 THEN 'Підписатись на канал' || chr(10) WHEN 3 THEN '@channel' || chr(10) || chr(10) || chr(10) || chr(10)
    WHEN 4 THEN 'Увага! ' WHEN 5 THEN 'наш бот' || chr(10) || chr(10) ELSE '' END
  || CASE user_id % 6 WHEN 1 THEN '3 ' WHEN 2 THEN '2х ' WHEN 3 THEN 'Два ' WHEN 4 THEN '250 ' WHEN 5 THEN 'П’ять ' ELSE '' END
  || CASE event_id % 14 WHEN 0 THEN 'БпЛА ' WHEN 1 THEN 'шахеди ' WHEN 2 THEN 'ракета ' WHEN 3 THEN 'Балістика ' WHEN 4 THEN 'КАБ ' WHEN 5 THEN 'Реактивний БпЛА '
    WHEN 6 THEN 'розвідувальний БпЛА ' WHEN 7 THEN 'літак Ту-95 ' WHEN 8 THEN 'швидкісна ціль ' WHEN 9 THEN 'авіаційна бомба ' WHEN 10 THEN 'уламки ' WHEN 11 THEN 'працює ППО ' ELSE '' END
  || CASE user_id % 11 WHEN 0 THEN 'курсом на ' WHEN 1 THEN 'повз ' WHEN 2 THEN 'через ' WHEN 3 THEN 'над ' WHEN 4 THEN 'в напрямку ' WHEN 5 THEN 'з півночі на ' WHEN 6 THEN 'на '
    WHEN 7 THEN 'курс північно-східний, ' WHEN 8 THEN 'з південного заходу на ' WHEN 9 THEN 'рухається на захід, ' ELSE 'у східному напрямку, ' END
  || CASE event_id % 8 WHEN 0 THEN 'Охтирку' WHEN 1 THEN 'Конотоп' WHEN 2 THEN 'Суми' WHEN 3 THEN 'Кам’янське' WHEN 4 THEN 'Новий  Буг' WHEN 5 THEN 'Ізюм' WHEN 6 THEN 'північ' ELSE 'Миргород' END
  || CASE user_id % 13 WHEN 1 THEN ' о 11:40' WHEN 2 THEN ' (орієнтовно о 23:50)' WHEN 3 THEN chr(10) || 'мінус' WHEN 4 THEN chr(10) || 'Відбій тривоги' WHEN 5 THEN ' [15.01.2024 09:15]' WHEN 6 THEN ', збито'
    WHEN 7 THEN chr(10) || 'Картка 4441 1111 2222 3333' WHEN 8 THEN ' до о 10:00, об 0.30' WHEN 9 THEN chr(10) || 'ще один не фіксується' WHEN 10 THEN ' о 25:10' ELSE '' END
  END AS text
FROM events""",
    "fx_archive": """
SELECT m.channel, CASE WHEN m.page = 0 THEN NULL WHEN m.channel = 'src3' AND m.page = 4 THEN e.low ELSE q.low END AS before, m.message_id
FROM (SELECT source AS channel, doc_id AS message_id, ntile(12) OVER (PARTITION BY source ORDER BY doc_id DESC) - 1 AS page FROM documents) m
LEFT JOIN (SELECT channel, page, min(message_id) AS low FROM
  (SELECT source AS channel, doc_id AS message_id, ntile(12) OVER (PARTITION BY source ORDER BY doc_id DESC) - 1 AS page FROM documents) a GROUP BY channel, page) q
  ON q.channel = m.channel AND q.page = m.page - 1
LEFT JOIN (SELECT channel, page, min(message_id) AS low FROM
  (SELECT source AS channel, doc_id AS message_id, ntile(12) OVER (PARTITION BY source ORDER BY doc_id DESC) - 1 AS page FROM documents) b GROUP BY channel, page) e
  ON e.channel = m.channel AND e.page = m.page
WHERE NOT (m.channel = 'src1' AND m.page = 6)""",
    "fx_raids": """
SELECT CAST(event_id AS VARCHAR(20)) AS message_id,
  CASE event_id % 7 WHEN 0 THEN 'Сумщина: ' WHEN 1 THEN 'Полтавщина' || chr(10) WHEN 2 THEN '⚠ Суми' || chr(10) WHEN 3 THEN 'Одещина ' ELSE '' END
  || CASE user_id % 5 WHEN 0 THEN 'БпЛА ' WHEN 1 THEN '3 шахеди ' WHEN 2 THEN 'реактивний ' WHEN 3 THEN 'бандероль ' ELSE '2 ' END
  || CASE event_id % 11 WHEN 0 THEN 'повз Конотоп курсом на Охтирку' WHEN 1 THEN 'над містом' WHEN 2 THEN 'на Миргород з півночі' WHEN 3 THEN 'біля Ріпок, 1 на Кролевець' WHEN 4 THEN 'з Одещини на Новий Буг'
    WHEN 5 THEN 'на Липову Долину' WHEN 6 THEN 'Ізюм уважно' WHEN 7 THEN 'у напрямку Чорного моря' WHEN 8 THEN 'курс західний' WHEN 9 THEN 'на Охтиркку' ELSE 'через Тернопіль на Чернівці' END
  || CASE user_id % 13 WHEN 0 THEN chr(10) || 'пуски: 3 з Смоленська, 10 з Курська (Орловщина)' WHEN 1 THEN chr(10) || 'мінус на Суми' WHEN 2 THEN chr(10) || '1 на Київ' WHEN 3 THEN chr(10) || 'уламки' ELSE '' END AS text
FROM events""",
    "fx_lexicon": """
SELECT p_partkey AS place_id, CASE p_partkey % 17 WHEN 0 THEN 'Охтирка' WHEN 1 THEN 'Конотоп' WHEN 2 THEN 'Суми' WHEN 3 THEN 'Кам''янське' WHEN 4 THEN 'Новий Буг' WHEN 5 THEN 'Ізюм'
    WHEN 6 THEN 'Миргород' WHEN 7 THEN 'Липова Долина' WHEN 8 THEN 'Липова' WHEN 9 THEN 'Київ' WHEN 10 THEN 'Кривий Ріг' WHEN 11 THEN 'Тернопіль' WHEN 12 THEN 'Чернівці'
    WHEN 13 THEN 'Кролевець' WHEN 14 THEN 'Ріпки' WHEN 15 THEN 'Наталія' ELSE 'Джанкой' END AS name,
  CASE p_size % 5 WHEN 0 THEN 'sumska' WHEN 1 THEN 'poltavska' WHEN 2 THEN 'odeska' WHEN 3 THEN 'kyivska' END AS region,
  CASE p_partkey % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'village' ELSE 'hamlet' END AS place,
  CAST(floor(p_retailprice) AS BIGINT) AS population, 44.5e0 + (p_partkey % 71) * 0.1e0 AS lat, 22.5e0 + (p_partkey % 173) * 0.1e0 AS lon
FROM part""",
    "fx_phrases": """
SELECT event_id AS mention_id, CASE event_id % 19 WHEN 0 THEN 'Охтирку' WHEN 1 THEN 'Липову Долину' WHEN 2 THEN 'Липової, далі' WHEN 3 THEN 'Сумщині' WHEN 4 THEN 'Києва' WHEN 5 THEN 'Конотпу'
    WHEN 6 THEN 'Кривого Рогу!' WHEN 7 THEN 'Чорного моря.' WHEN 8 THEN '«Тернополя»' WHEN 9 THEN 'Одещину та далі' WHEN 10 THEN 'Нового Бугу' WHEN 11 THEN 'Кам’янського' WHEN 12 THEN 'Мирагород'
    WHEN 13 THEN 'Нікуди' WHEN 14 THEN 'акваторія Чорного моря' WHEN 15 THEN 'Київського водосховища, північ' WHEN 16 THEN '(' WHEN 17 THEN 'Мирагорода Новий' ELSE 'Ріпок' END AS phrase,
  CASE user_id % 4 WHEN 0 THEN 'sumska' WHEN 1 THEN 'poltavska' WHEN 2 THEN 'odeska' END AS region
FROM events""",
    "fx_captures": """
SELECT source AS channel, doc_id AS message_id, 1 AS capture, text FROM documents WHERE doc_id % 50 <> 0
UNION ALL
SELECT source, doc_id, 2, CASE WHEN doc_id % 10 = 5 THEN text || ' (edit)' ELSE text END FROM documents""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of ``sf_dir``."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "customer", "part", "documents", "nation", "supplier", "orders") if f"FROM {t}" in VIEWS[name]}
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    for t in tables:
        text = text.replace(f"FROM {t}", "FROM {" + t + "}")
    return spark.sql(text, **tables)


def with_views(text: str, *names: str) -> str:
    """SQL with the views in front."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + text
