"""Columns of message text: cleaning, filters, types, counts, courses and stated times, in built-in functions.

Patterns are written once, with ``<`` and ``>`` for the edge of a word (a letter or digit neither before nor after), since
an ASCII word boundary never holds beside Cyrillic letters. ``java`` makes them Spark's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that are advertising.
BOILERPLATE = [
    r"підпис(?:атися|уйтесь|атись|ка)",
    r"^\s*@\w+\s*$",
    r"t\.me/",
    r"наш(?:і)?\s+(?:бот|канал|чат)",
    r"надіслати\s+новину",
    r"повідомити\s+про",
    r"^\s*реклама[A-Za-z0-9_]",
    r"бот\s+для\s+зв'?язку",
]
# Messages that ask for money.
FUNDRAISING = [
    r"(?:^|\D)\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}(?:\D|$)",
    r"privat\s?bank|приватбанк",
    r"pay\s?pal",
    r"монобанк|карт(?:а|ка|ки|ку)\s+моно",
    r"patreon|патреон",
    r"send\.monobank|jar/|банк[аи]?\s+для\s+збор",
]
# Stems and phrases about results and air defence.
SENSITIVE = [
    "<(?:збит|збива|збили|подавл|влучан|приліт|прильот|прилет|уламк|наслідк|пошкодж|загинул|постражда|поранен|детонац)",
    r"<(?:ППО\s+прац|робот[уаи]\s+ППО|сил[иа]\s+ППО|працює\s+ППО|відпрацюв)",
]
# A line that ends a sighting, or a threat.
LOST = r"<(?:мінус|зник|зникла|зникли|зникло|не\s+фіксу[єю]ться)>"
STAND_DOWN = r"<(?:відбій|чисто|без\s+фіксац|без\s+загроз)"
# What a report speaks of.
REPORT = "<(?:бпла|шахед|герань|ракет|балістик|каб|авіаці|реактивн|курс|напрямку|повз|через)"
NAME = "<[А-ЯІЇЄҐ][а-яіїєґ'’]{2,}"
_A = "[а-яіїєґ]*"
# Types in order; the first that matches counts.
TYPES = [
    ("ballistic", "<(?:балістик|балістичн|іскандер-м|кн-23)"),
    ("cruise", "<(?:крилат|калібр|х-101|х-555|х-59|х-31|іскандер-к|бандерол|дань-т|швидкісн|ракет)"),
    ("kab", rf"<(?:каб{_A}|кабів|(?:керован{_A}\s+)?авіаційн{_A}\s+бомб{_A}|керован{_A}\s+авіабомб{_A}|авіабомб{_A}|фаб-?\d+|умпб[-\d]*|umpb[-\d]*|umpk)>"),
    ("recon", "<(?:розвід)"),
    ("jet_uav", "<(?:реактив|рбпла)"),
    ("uav", "<(?:бпла|безпілотник|шахед|герань|гербер|ланцет|молні|shahed|geran|мопед)"),
    ("aviation", rf"<(?:тактичн{_A}\s+авіаці|авіаці|літак|борт{_A}|міг-\d+|ту-\d+|су-\d+)"),
]
# Fixed value: a count and a preposition, with no type.
BARE = r"^\s*\d{1,3}\s*(?:х|x|шт\.?)?\s*(?:на|через|повз|курсом|курс)>"
# Number words.
NUMBERS = {"один": 1, "одна": 1, "два": 2, "дві": 2, "три": 3, "чотири": 4, "п'ять": 5, "шість": 6, "сім": 7, "вісім": 8, "дев'ять": 9, "десять": 10}
# Directions, compounds first.
POINTS = [
    (45, rf"північн{_A}[- ]?с(?:хід|ход){_A}"),
    (135, rf"південн{_A}[- ]?с(?:хід|ход){_A}"),
    (225, rf"південн{_A}[- ]?з(?:ахід|аход){_A}"),
    (315, rf"північн{_A}[- ]?з(?:ахід|аход){_A}"),
    (0, rf"північн{_A}|північ"),
    (90, rf"східн{_A}|схід"),
    (180, rf"південн{_A}|південь"),
    (270, rf"західн{_A}|захід"),
]
# Ways to tie a direction to a course.
COURSES = [
    r"курс(?:ом)?\s*[-–—:]?\s*(?:на\s+)?(?:{0})",
    rf"(?:{{0}}){_A}\s+курс(?:ом)?",
    rf"(?:рух|прямує|іде|йде|заходят|летят|летить|напрям){_A}\s+(?:[ву]\s+|на\s+)?(?:{{0}})",
    rf"[ву]\s+(?:{{0}}){_A}\s+напрям",
]
# Where something comes from, and its bearing.
FROM = rf"(?:^|[^\p{{L}}])(?:з|із|зі)\s+(північн{_A}[- ]?сход|південн{_A}[- ]?сход|південн{_A}[- ]?заход|північн{_A}[- ]?заход|північно[- ]?схід|південно[- ]?схід|південно[- ]?захід|північно[- ]?захід|північн|південн|східн|західн|півноч|півдн|сход|заход)"
FROM_POINTS = [
    (45, rf"північн{_A}[- ]?с(?:хід|ход)"),
    (135, rf"південн{_A}[- ]?с(?:хід|ход)"),
    (225, rf"південн{_A}[- ]?з(?:ахід|аход)"),
    (315, rf"північн{_A}[- ]?з(?:ахід|аход)"),
    (0, "північн|півноч"),
    (90, "східн|сход"),
    (180, "південн|півдн"),
    (270, "західн|заход"),
]
# A stated time, and what makes it an estimate.
AT_TIME = r"(?:о|об)\s+(\d{1,2}[:.]\d{2})(?!\d)"
DATED = r"\[\d{2}\.\d{2}\.\d{4}\s+(\d{1,2}:\d{2})\]"
ESTIMATE = r"(?:орієнтовн\p{L}{0,7}|приблизн\p{L}{0,7}|\+-|±|~|(?<!\p{L})до)\s{0,7}"
#: One form of the apostrophe for all.
APOSTROPHES = "’'`´ʼ‘"


def java(pattern: str, case: bool = False) -> str:
    edge = r"[\p{L}\p{N}]"
    return ("(?u)" if case else "(?iu)") + pattern.replace("<", f"(?<!{edge})").replace(">", f"(?!{edge})")


def _any(text: Column, patterns: list[str], case: bool = False) -> Column:
    return text.rlike(java("|".join(f"({p})" for p in patterns), case))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")


def without_lines(text: Column, *patterns: str) -> Column:
    """The text without the lines that match one of the patterns."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~_any(line, list(patterns))), "\n")


def strip_boilerplate(text: Column) -> Column:
    """No advertising lines, at most one blank line in a row, trimmed."""
    return trim(F.regexp_replace(without_lines(text, *BOILERPLATE), r"\n{3,}", "\n\n"))


def is_fundraising(text: Column) -> Column:
    return _any(text, FUNDRAISING)


def is_sensitive(text: Column) -> Column:
    return _any(text, SENSITIVE)


def live_lines(text: Column) -> Column:
    """The text without lines that say an object is gone or a threat is over."""
    return without_lines(text, LOST, STAND_DOWN)


def looks_like_report(text: Column) -> Column:
    return _any(text, [REPORT]) & _any(text, [NAME], case=True)


def classify_type(text: Column, fallback: Column | str = "unknown") -> Column:
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.coalesce(*[F.when(text.rlike(java(p)), F.lit(t)) for t, p in TYPES], fallback)


def infer_bare_type(line: Column) -> Column:
    return F.when(line.rlike(java(BARE)), "uav")


def extract_count(text: Column) -> Column:
    """A leading number word, else a leading number of 1 to 200, else 1."""
    t = trim(text)
    word = F.translate(F.lower(F.regexp_extract(t, r"(?u)^([\p{L}'’]+)\s+(?=\p{L})", 1)), "’", "'")
    spelled = F.coalesce(*[F.when(word == w, F.lit(n)) for w, n in NUMBERS.items()])
    number = F.regexp_extract(t, r"(?iu)^(\d{1,3})\s*(?:х|x|шт\.?)?\s*(?=\p{L})", 1).try_cast("int")
    return F.coalesce(spelled, F.when(number.between(1, 200), number), F.lit(1))


def course_stated(line: Column) -> Column:
    """Degrees of a direction that the line ties to a course."""
    return F.coalesce(*[F.when(_any(line, [c.format(p) for c in COURSES]), F.lit(float(d))) for d, p in POINTS])


def course_approach(line: Column) -> Column:
    """The course of what comes from a direction: the opposite one."""
    phrase = F.regexp_extract(line, java(FROM), 1)
    return F.coalesce(*[F.when(_any(phrase, [p]), F.lit((d + 180.0) % 360)) for d, p in FROM_POINTS])


def stated_time(text: Column) -> Column:
    """The first time that a message states and doesn't call an estimate, as written.

    Times are found first; the end of what stands before each then tells whether it is an estimate.
    """
    time = rf"(?iu)(?:(?<![\p{{L}}\p{{N}}]){AT_TIME}|{DATED})"
    hits, before = F.regexp_extract_all(text, F.lit(time), 0), F.split(text, time)
    plain = F.filter(F.arrays_zip(hits.alias("hit"), before.alias("before")), lambda x: x["hit"].isNotNull() & ~F.right(x["before"], F.lit(32)).rlike(f"(?iu){ESTIMATE}$"))
    found = F.regexp_extract(F.get(plain, F.lit(0))["hit"], r"(\d{1,2}[:.]\d{2})\]?$", 1)
    return F.when(found != "", found)


def observed_at(stated: Column, posted_at: Column) -> Column:
    """The stated wall-clock time in Kyiv on the day of the post, the day before or after, if within 6 hours of it; else the post's.

    ``posted_at`` is in UTC, without time zone.
    """
    hour, minute = (F.regexp_extract(stated, r"^\s*(\d{1,2})[:.](\d{2})\s*$", k).try_cast("int") for k in (1, 2))
    wall = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Kyiv"), posted_at)
    seconds = (hour * 60 + minute) * 60 - (F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall))
    micros = seconds.cast("long") * 1_000_000 - F.unix_micros(posted_at.cast("timestamp")) % 1_000_000
    step = lambda days: micros + days * 86_400_000_000
    near = F.coalesce(*[F.when(F.abs(step(d)) <= 6 * 3_600_000_000, step(d)) for d in (0, -1, 1)])
    ok = (hour <= 23) & (minute <= 59) & near.isNotNull()
    return F.when(ok, F.timestamp_micros(F.unix_micros(posted_at.cast("timestamp")) + near).cast("timestamp_ntz")).otherwise(posted_at)


def normalise(name: Column) -> Column:
    """Lower case, one apostrophe, no stress mark, single spaces."""
    one = F.translate(F.lower(name), APOSTROPHES + "́", "'" * len(APOSTROPHES))
    return trim(F.regexp_replace(one, r"[\s\x{00A0}]+", " "))


def normalise_area(name: Column) -> Column:
    """An area's name without its kind."""
    bare = F.regexp_replace(name, r"(?iu)^м\.\s*", "")
    bare = F.regexp_replace(bare, r"(?iu)\s*\[hromada\]\s*", "")
    bare = F.regexp_replace(bare, r"(?iu)\s*(?:район|громада)\s*$", "")
    return trim(F.translate(F.lower(bare), "’ʼ`", "'''"))


def html_text(html: Column) -> Column:
    """The text of HTML: breaks as lines, no scripts, styles, comments and tags, character references replaced, white space of a
    line collapsed, at most one blank line in a row, trimmed. Named references other than these five stay."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", "\n"), r"(?s)<[^>]*>", "")
    # numeric ones: each distinct code of the text once
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(\d{1,7});"), 1))
    letter = lambda x: F.decode(F.unhex(F.lpad(F.hex(x.cast("long")), 8, "0")), "UTF-32")
    text = F.aggregate(codes, text, lambda t, x: F.replace(t, F.concat(F.lit("&#"), x, F.lit(";")), letter(x)))
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(value))
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s\x{00A0}]+", " ")))
    return trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))
