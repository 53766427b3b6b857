"""Column builders for text: slugs, identifiers, sentences, formats, sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLUG_CAP = 40
PARAGRAPH_BYTES = 50
CUE_SECONDS = 30
WORD_BYTES = 4
#: Function words left out of term counts.
STOP_WORDS = tuple(
    "about above after again against all also although always among and any are around away back because been before being below between both "
    "but can cannot could did does doing done down during each either else even ever every few for from further get give goes had has have having "
    "her here hers him his how however into its itself just keep know less let like made make many may might mine more most much must never "
    "next none nor not now off often once only onto other our ours out over own perhaps rather really said same say see she should since some "
    "still such take than that the their theirs them then there these they this those though through thus together too toward under until upon "
    "use used uses using very want was well were what when where whether which while who whom whose why will with within without would yet you your yours".split()
)


def topic_slug(label: Column, cap: int = SLUG_CAP) -> Column:
    """Lower-case words joined by hyphens, cut at a hyphen within ``cap`` characters; null if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    head = F.substring(slug, 1, cap)
    at_hyphen = F.regexp_extract(head, "^(.*)-", 1)
    cut = F.when(F.length(slug) <= cap, slug).when(F.length(at_hyphen) > 0, at_hyphen).otherwise(head)
    cut = F.regexp_replace(cut, "^-+|-+$", "")
    return F.when(F.length(cut) > 0, cut)


def short_id(value: Column) -> Column:
    """First six bytes of the SHA-256, in hex."""
    return F.substring(F.sha2(value.cast("string"), 256), 1, 12)


def joined_id(*values: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the values, parted by NUL; nulls count as empty."""
    parts: list[Column] = []
    for v in values:
        parts += [F.char(F.lit(0)), F.coalesce(v.cast("string"), F.lit(""))]
    return F.substring(F.sha2(F.concat(*parts[1:]), 256), 1, 16)


def claim_id(text: Column, claimant: Column, video_id: Column, chunk_id: Column) -> Column:
    return joined_id(text, claimant, video_id, chunk_id)


def trajectory_id(task: Column, topic: Column, mode: Column, ts: Column) -> Column:
    return joined_id(task, topic, mode, ts)


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / F.lit(4.0)).cast("int")


def strip_tags(text: Column) -> Column:
    """Without <...> tags, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), r"\s+", " "))


def paragraphs(text: Column, least: int = PARAGRAPH_BYTES) -> Column:
    """Blank-line separated parts of at least ``least`` bytes, trimmed."""
    return F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.trim(p)), lambda p: F.octet_length(p) >= least)


def sentences(text: Column) -> Column:
    """Sentences end at . ! or ? before white space or at the end; blanks are left out."""
    parts = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"(?<=[.!?])\s+")
    return F.filter(parts, lambda s: F.length(s) > 0)


def keyword_query(text: Column) -> Column:
    """Letters and digits only, words parted by single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]", " "), " +", " "))


def cloud_words(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-cased runs of letters of at least four bytes that are no function words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: (F.octet_length(w) >= WORD_BYTES) & ~w.isin(*stop))


def citation_url(base: Column, video_id: Column, seconds: Column | None = None) -> Column:
    """base/id, with ?t= and the whole seconds where a time is given."""
    url = F.concat(base, F.lit("/"), video_id)
    return url if seconds is None else F.concat(url, F.lit("?t="), F.floor(seconds).cast("string"))


def context_block(number: Column, text: Column, video_id: Column, seconds: Column) -> Column:
    """Numbered source block of a prompt; seconds rounded half to even."""
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), text, F.lit("\n    (from video="), video_id, F.lit(" @ "), F.bround(seconds, 0).cast("long").cast("string"), F.lit("s)"))


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


def byte_size(n: Column) -> Column:
    """B, KB, MB or GB in steps of 1024, one decimal."""
    scaled = lambda k, unit: F.format_string(f"%.1f {unit}", n / float(1024**k))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1, "KB")).when(n < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` characters; longer texts end in an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


#: Hosts and endings that decide a source's kind (fixed values).
VIDEO_HOSTS = ("youtube.com", "vimeo.com", "dailymotion.com", "twitch.tv")
MEDIA_ENDINGS = ("mp4", "mkv", "webm", "avi", "mov", "mp3", "m4a", "ogg", "flac")
FEED_HOSTS = ("anchor.fm", "buzzsprout.com", "libsyn.com", "podbean.com", "simplecast.com", "transistor.fm", "spreaker.com")


def classify_source(source: Column, local: Column | None = None) -> Column:
    """Kind of a source by its form: search, channel, playlist, single_video, pdf, podcast or web_page.

    ``local`` tells what lies at a source that is a path (see readers.local_kinds):
    "directory" or "file" make it a local_directory or local_file before anything else.
    """
    at = F.lit(None).cast("string") if local is None else local
    host = F.coalesce(F.lower(F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    query = F.concat(F.lit("&"), F.regexp_extract(source, r"\?([^#]*)", 1), F.lit("&"))
    is_url = F.regexp_like(source, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://"))
    web = F.regexp_like(source, F.lit(r"^(?i)https?://"))
    has = lambda key: F.regexp_like(query, F.lit(f"&{key}(=|&)"))
    video = (host == "youtu.be") | F.regexp_like(host, F.lit("|".join(h.replace(".", r"\.") for h in VIDEO_HOSTS)))
    feed = F.regexp_like(host, F.lit(r"^feeds\.|(^|\.)(" + "|".join(h.replace(".", r"\.") for h in FEED_HOSTS) + ")$")) | F.regexp_like(F.lower(path), F.lit(r"\.(rss|xml)$"))
    return (
        F.when(at == "directory", "local_directory")
        .when(at == "file", "local_file")
        .when(source.startswith("ytsearch"), "search")
        .when(source.startswith("@"), "channel")
        .when(is_url & F.regexp_like(path, F.lit("^/(c/|channel/|@)|/videos")), "channel")
        .when(is_url & ((host.contains("youtube.com") & has("list") & ~has("v")) | path.contains("/playlist")), "playlist")
        .when(is_url & video, "single_video")
        .when(web & F.regexp_like(F.lower(path), F.lit(r"\.(" + "|".join(MEDIA_ENDINGS) + ")$")), "single_video")
        .when(web & F.regexp_like(F.lower(path), F.lit(r"\.pdf$")), "pdf")
        .when(web & feed, "podcast")
        .when(web, "web_page")
        .otherwise("single_video")
    )


def valid_source(source: Column, local: Column | None = None) -> Column:
    """URLs, searches, handles and what exists locally; nothing that a command line would take for an option."""
    known = F.lit(False) if local is None else local.isNotNull()
    return F.coalesce(~source.startswith("-") & (F.regexp_like(source, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://.+")) | source.startswith("ytsearch") | source.startswith("@") | known), F.lit(False))


def topic_of_source(source: Column) -> Column:
    """Slug of the v= value, else of the last path segment, else of the host, else of the file's stem."""
    v = F.regexp_extract(source, r"[?&]v=([^&#]*)", 1)
    is_url = F.regexp_like(source, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://"))
    segment = F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/(?:[^?#]*/)?([^/?#]+)/?(?:[?#].*)?$", 1)
    host = F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)
    stem = F.regexp_replace(F.regexp_extract(source, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return topic_slug(F.when(is_url & (v != ""), v).when(is_url & (segment != ""), segment).when(is_url, host).otherwise(stem))


def cadence_cron(cadence: Column) -> Column:
    """Cron line of hourly, daily, weekly, monthly, or a line of five fields; null for anything else."""
    c = F.trim(cadence)
    return (
        F.when(F.lower(c) == "hourly", "0 * * * *")
        .when(F.lower(c) == "daily", "0 3 * * *")
        .when(F.lower(c) == "weekly", "0 3 * * 0")
        .when(F.lower(c) == "monthly", "0 3 1 * *")
        .when(F.size(F.split(c, r"\s+")) == 5, c)
    )


def cron_fields(line: Column) -> Column:
    """(minute, hour, day, month, weekday) of a cron line; * gives null."""
    parts = F.split(F.trim(line), r"\s+")
    names = ("minute", "hour", "day", "month", "weekday")
    return F.struct(*[F.when(F.get(parts, F.lit(i)) != "*", F.get(parts, F.lit(i)).try_cast("int")).alias(n) for i, n in enumerate(names)])


def unfenced_json(text: Column) -> Column:
    """The body of a fenced code block, or the trimmed text."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


CARDS = "array<struct<question:string,answer:string,chunk_id:string>>"


def parse_cards(text: Column) -> Column:
    """Quiz cards of a model's answer: a JSON array, fenced or not; null if it is none."""
    return F.from_json(unfenced_json(text), CARDS)


def harvest_key(topic: Column, n: Column) -> Column:
    """Key under which a harvest of n candidates for a topic is kept: SHA-256 of topic, NUL, n."""
    return F.sha2(F.concat(topic, F.char(F.lit(0)), n.cast("string")), 256)


def summary_markdown(topic: Column, ingested: Column, body: Column) -> Column:
    """The summary page of a topic."""
    return F.concat(F.lit("# "), topic, F.lit(" — key takeaways\n\nIngested: "), ingested, F.lit("\n\n"), body, F.lit("\n"))


def abstained(text: Column, local: bool = False) -> Column:
    """Whether an answer says that the knowledge base does not cover the question.

    Local models answer with the one word, in any case.
    """
    if local:
        return F.upper(F.trim(text)) == "ABSTAIN"
    t = F.ltrim(text)
    return t.startswith("KB doesn't cover this") | t.startswith("ABSTAIN")
