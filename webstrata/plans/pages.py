"""Queries that classify recorded responses and measure their text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import classify as C
from webstrata.functions import text as T
from webstrata.functions.urls import part
from webstrata.operators.envelope import envelopes
from webstrata.operators.signals import text_signals as text_signals_of
from webstrata.session import table

Query = Callable[[SparkSession, str], DataFrame]

# Bodies that stand in for recorded pages: a marker per remainder of the fetch id, before the markdown.
BODIES = [
    "<script>var a='</p>';</script>", "<p>Just a moment...</p>", '<div class="g-recaptcha"></div>', "<p>Please log in</p>", "<p>Subscribe to read</p>",
    "<p>You need to enable JavaScript</p>", "<!-- x5secdata -->", "<form action=\"/errors/validateCaptcha\">", '{"isAccessibleForFree": "False"}', "<a href='/gz/account-verification'>",
    "<script src='/_sec/verify?provider=interstitial'></script>",
]
STATUSES = [200, 403, 404, 429, 503, 0, 401, 206, 302, 200, 200, 200, 200]
HINTS = ["timeout", "bot_blocked", "", "browser_unavailable"]


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each fetch once, with a body and a status made from its id."""
    rows = table(spark, folder, "fetch_cache").select("fetch_id", "markdown", "content_type", "url").dropDuplicates(["fetch_id"])
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col("fetch_id") % by + 1).cast("int"))
    body = F.concat(pick(BODIES, len(BODIES)), F.coalesce("markdown", F.lit("")))
    return rows.withColumns({"html": body, "code": pick(STATUSES, len(STATUSES)), "hint": pick(HINTS, len(HINTS))})


def _sql_list(values: list) -> str:
    return "[" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


SQL_PAGES = f"""
SELECT fetch_id, markdown, content_type, url, ({_sql_list(BODIES)})[fetch_id % {len(BODIES)} + 1] || coalesce(markdown, '') AS html,
  ({_sql_list(STATUSES)})[fetch_id % {len(STATUSES)} + 1] AS code, ({_sql_list(HINTS)})[fetch_id % {len(HINTS)} + 1] AS hint
FROM (SELECT DISTINCT fetch_id, markdown, content_type, url FROM fetch_cache)
"""


def _sql_any(markers: list[str]) -> str:
    return "(" + " OR ".join("contains(b, '" + m.replace("'", "''") + "')" for m in markers) + ")"


SQL_VISIBLE = "trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gsi'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
SQL_CLASSIFY = f"""
WITH p AS (SELECT *, lower(html) AS b, length({SQL_VISIBLE}) AS n FROM ({SQL_PAGES}))
SELECT fetch_id, code, CASE
  WHEN code = 0 THEN CASE hint WHEN 'timeout' THEN 'timeout' WHEN 'bot_blocked' THEN 'blocked_bot' WHEN 'browser_unavailable' THEN 'browser_unavailable' ELSE 'dns_fail' END
  WHEN {_sql_any(C.SLIDER)} THEN 'blocked_captcha' WHEN code NOT IN (404, 410) AND {_sql_any(C.ROBOT)} THEN 'blocked_captcha' WHEN code IN (404, 410) THEN 'not_found'
  WHEN code IN (401, 403) THEN CASE WHEN {_sql_any(C.LOGIN)} OR {_sql_any(C.ACCOUNT_WALL)} THEN 'login_required' WHEN {_sql_any(C.CLOUDFLARE)} THEN 'blocked_cloudflare'
    WHEN {_sql_any(C.CAPTCHA)} THEN 'blocked_captcha' WHEN code = 401 THEN 'login_required' ELSE 'blocked_cloudflare' END
  WHEN code = 429 THEN CASE WHEN {_sql_any(C.CLOUDFLARE)} THEN 'blocked_cloudflare' ELSE 'server_error' END
  WHEN code BETWEEN 500 AND 599 THEN 'server_error'
  WHEN code BETWEEN 200 AND 399 THEN CASE WHEN {_sql_any(C.CLOUDFLARE)} AND n < 2000 THEN 'blocked_cloudflare' WHEN {_sql_any(C.INTERSTITIAL)} AND n < 2000 THEN 'blocked_bot'
    WHEN {_sql_any(C.CAPTCHA)} AND n < 2000 THEN 'blocked_captcha' WHEN {_sql_any(C.ACCOUNT_WALL)} AND n < 2000 THEN 'login_required'
    WHEN regexp_matches(html, '(?i)isAccessibleForFree["'']?\\s*[:=]\\s*["'']?False') THEN 'paywall_hard' WHEN {_sql_any(C.PAYWALL)} AND n < 400 THEN 'paywall_hard'
    WHEN {_sql_any(C.PAYWALL)} THEN 'paywall_soft_with_partial' WHEN n < 600 AND {_sql_any(C.SCRIPT_NOTICE)} THEN 'js_app_needs_interaction' ELSE 'ok' END
  ELSE 'server_error' END AS reason FROM p
"""


def page_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The outcome of every response (CLS01, CLS03, CLS04)."""
    return pages(spark, folder).select("fetch_id", "code", C.classify(F.col("code"), F.col("html"), F.col("hint")).alias("reason"))


def page_visible(spark: SparkSession, folder: str) -> DataFrame:
    """Visible text lengths and boilerplate ratio (CLS02, TXT03, TXT07)."""
    visible = C.visible_text(F.col("html"))
    return pages(spark, folder).select(
        "fetch_id",
        F.length(visible).alias("visible_chars"),
        T.boilerplate_ratio(F.col("markdown"), visible).alias("boilerplate_ratio"),
        (F.length(F.coalesce("markdown", F.lit(""))) < T.SHORT_TEXT).alias("short_content"),
    )


SQL_PAGE_VISIBLE = f"""
WITH v AS (SELECT fetch_id, markdown, {SQL_VISIBLE} AS t FROM ({SQL_PAGES}))
SELECT fetch_id, length(t) AS visible_chars, round_even(greatest(0.0, least(1.0, 1 - length(coalesce(markdown, ''))::DOUBLE / greatest(length(t), 1))), 4) AS boilerplate_ratio,
  length(coalesce(markdown, '')) < 200 AS short_content FROM v
"""


def page_types(spark: SparkSession, folder: str) -> DataFrame:
    """Content types read and routed (CLS05 to CLS09)."""
    kinds = ["text/plain; charset=x", "image/svg+xml", "application/zip", "application/octet-stream", "APPLICATION/PDF", "text/rtf", " Text/HTML ;q", ""]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("fetch_id") % len(kinds) + 1).cast("int"))
    path = F.concat(part(F.col("url"), "path"), F.element_at(F.array(F.lit(""), F.lit(".PDF"), F.lit(".docx")), (F.col("fetch_id") % 3 + 1).cast("int")))
    body = F.when(F.col("fetch_id") % 5 == 0, F.concat(F.lit("�����"), F.lit("abc"))).otherwise(F.col("markdown"))
    rows = pages(spark, folder).select("fetch_id", kind.alias("ct"), path.alias("path"), body.alias("body"))
    ct = F.col("ct")
    return rows.select(
        "fetch_id",
        C.bare_type(ct, "text/html").alias("bare_type"),
        C.is_plain_text(ct, F.col("body")).alias("plain"),
        C.skips_body(ct).alias("skips_body"),
        C.is_unsupported(ct, F.col("body")).alias("unsupported"),
        C.is_pdf(F.col("path"), ct).alias("pdf"),
        C.office_format(F.col("path"), ct).alias("office"),
    )


SQL_PAGE_TYPES = f"""
WITH k AS (SELECT fetch_id, (['text/plain; charset=x', 'image/svg+xml', 'application/zip', 'application/octet-stream', 'APPLICATION/PDF', 'text/rtf', ' Text/HTML ;q', ''])[fetch_id % 8 + 1] AS ct,
  regexp_extract(url, '://[^/?#]*([^?#]*)', 1) || (['', '.PDF', '.docx'])[fetch_id % 3 + 1] AS path, CASE WHEN fetch_id % 5 = 0 THEN '�����abc' ELSE coalesce(markdown, '') END AS body FROM ({SQL_PAGES})),
t AS (SELECT *, trim(split_part(ct, ';', 1)) AS bt, lower(trim(split_part(ct, ';', 1))) AS lt FROM k)
SELECT fetch_id, CASE WHEN bt = '' THEN 'text/html' ELSE bt END AS bare_type, lt = 'text/plain' AS plain, lt IN ('image/svg+xml', 'application/zip') AS skips_body,
  lt IN ('image/svg+xml', 'application/zip') OR (lt = 'application/octet-stream' AND length(body) > 0 AND
   (contains(substr(body, 1, 4096), chr(0)) OR len(regexp_extract_all(substr(body, 1, 4096), '[\\x{{FFFD}}\\x01-\\x08\\x0E-\\x1F]')) > 0.05 * length(substr(body, 1, 4096)))) AS unsupported,
  ends_with(lower(path), '.pdf') OR contains(lower(ct), 'application/pdf') AS pdf,
  CASE WHEN lower(split_part(path, '.', -1)) = 'docx' THEN 'docx' WHEN lt = 'text/rtf' THEN 'rtf' END AS office FROM t
"""


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def text_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Word, CJK word and token counts, and the confidence from them (TXT02, TXT04 to TXT06)."""
    text = F.col("text")
    return texts(spark, folder).select(
        "doc_id", T.word_count(text).alias("words"), T.cjk_word_count(text).alias("cjk_words"), T.token_estimate(text).alias("tokens"), T.confidence(T.word_count(text)).alias("confidence")
    )


_WS = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{1C}-\\x{1F}]+"
_CJK = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{AC00}-\\x{D7AF}]"
SQL_TEXT_COUNTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, t, len(list_filter(regexp_split_to_array(t, '{_WS}'), lambda x: x <> '')) AS words,
  len(regexp_extract_all(t, '{_CJK}')) + len(list_filter(regexp_split_to_array(regexp_replace(t, '{_CJK}', ' ', 'g'), '{_WS}'), lambda x: x <> '')) AS cjk_words FROM d)
SELECT doc_id, words, cjk_words, length(t) // 4 AS tokens, round_even(least(1.0, words / 800.0), 4) AS confidence FROM c
"""


def text_signals(spark: SparkSession, folder: str) -> DataFrame:
    """The six text signals and the score made of them (TXT08 to TXT15)."""
    rows = texts(spark, folder).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    found = text_signals_of(rows, "doc_id", "text").withColumn("n", T.word_count(F.col("text")))
    names = ["slop_vocab_ratio", "slop_phrase_count", "sentence_length_cv", "em_dash_density", "transition_start_ratio", "type_token_ratio"]
    s = {c: F.col(c) for c in names}
    score = T.slop_score(s, F.lit(0.25), F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, F.col("n"))
    return found.select("doc_id", *names, score.alias("slop_score"))


# Word characters other than a to z count as 0, after which ASCII word borders are Unicode ones.
_OTHER = "[\\p{N}_\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{2C1}\\x{300}-\\x{374}\\x{376}-\\x{37D}\\x{386}\\x{388}-\\x{481}\\x{483}-\\x{559}\\x{561}-\\x{587}\\x{591}-\\x{5BD}\\x{5D0}-\\x{5F2}\\x{610}-\\x{61A}\\x{620}-\\x{669}\\x{66E}-\\x{6D3}\\x{3041}-\\x{3096}\\x{30A1}-\\x{30FA}\\x{3400}-\\x{9FFF}\\x{AC00}-\\x{D7A3}\\x{FF10}-\\x{FF19}\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}]"
# Fixed values, spelled for the SQL on their own.
_WORDS = """
'delve', 'delving', 'delved', 'utilize', 'utilizing', 'utilized', 'utilization', 'facilitate', 'facilitating', 'facilitated', 'elucidate', 'elucidating', 'elucidated',
'embark', 'embarking', 'embarked', 'endeavor', 'endeavors', 'endeavour', 'encompass', 'encompasses', 'encompassing', 'multifaceted', 'tapestry', 'testament', 'paradigm',
'synergy', 'synergies', 'holistic', 'catalyze', 'catalyzing', 'juxtapose', 'juxtaposition', 'nuanced', 'myriad', 'plethora', 'pivotal', 'groundbreaking', 'cutting-edge',
'game-changer', 'game-changing', 'spearhead', 'spearheading', 'underscores', 'underscoring', 'leveraging', 'leveraged', 'streamline', 'streamlining', 'streamlined',
'overarching', 'cornerstone', 'cornerstones', 'aforementioned', 'henceforth', 'noteworthy', 'commendable', 'meticulous', 'meticulously', 'intricate', 'intricacies',
'aligns', 'aligning', 'resonates', 'resonate', 'resonating', 'bustling', 'moreover', 'furthermore', 'nevertheless', 'nonetheless', 'harnessing', 'harness', 'harnessed',
'bolster', 'bolstering', 'bolstered', 'fostering', 'fostered', 'captivating', 'captivated', 'interplay', 'wholesome', 'reinvigorate'
"""
_PHRASES = " + ".join("CAST(contains(lt, '" + p.replace("'", "''") + "') AS INTEGER)" for p in T.SLOP_PHRASES)
_TRANSITIONS = ", ".join("'" + w + "'" for w in T.TRANSITIONS)
SQL_TEXT_SIGNALS = f"""
WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
w AS (SELECT doc_id, t, lower(t) AS lt, coalesce(len(list_filter(regexp_split_to_array(t, '{_WS}'), lambda x: x <> '')), 0) AS n,
  regexp_extract_all(regexp_replace(lower(t), '{_OTHER}', '0', 'g'), '\\b[a-z][a-z''-]*[a-z]\\b|\\b[a-z]\\b') AS words,
  list_transform(list_filter(regexp_extract_all(t, '[^.!?]+(?:[.!?]+|\\z)'), lambda s: regexp_matches(s, '[.!?]\\z')), lambda s: len(list_filter(regexp_split_to_array(s, '{_WS}'), lambda x: x <> ''))) AS sl,
  list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n'), lambda p: regexp_replace(regexp_replace(p, '^{_WS}', ''), '{_WS}$', '')), lambda p: p <> '') AS ps FROM d),
s AS (SELECT doc_id, n, t IS NULL OR length(t) < 200 AS tiny,
  CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: x IN ({_WORDS})))::DOUBLE / len(words) ELSE 0.0 END AS v, {_PHRASES} AS ph,
  CASE WHEN len(sl) < 5 OR list_sum(sl) = 0 THEN 0.5 ELSE sqrt(list_sum(list_transform(sl, lambda x: x * x))::DOUBLE / len(sl) - (list_sum(sl)::DOUBLE / len(sl)) ** 2) / (list_sum(sl)::DOUBLE / len(sl)) END AS cv,
  CASE WHEN len(words) > 0 THEN len(regexp_extract_all(t, '—|---?'))::DOUBLE / len(words) ELSE 0.0 END AS em,
  CASE WHEN len(ps) < 3 THEN 0.0 ELSE len(list_filter(ps, lambda p: regexp_replace(lower(regexp_split_to_array(p, '{_WS}')[1]), '[.,;:]+$', '') IN ({_TRANSITIONS})))::DOUBLE / len(ps) END AS tr,
  CASE WHEN len(words) = 0 THEN 1.0 WHEN len(words) < 50 THEN len(list_distinct(words))::DOUBLE / len(words)
    ELSE list_avg(list_transform(range(1, len(words) - 48), lambda i: len(list_distinct(words[i:i + 49])) / 50.0)) END AS ttr FROM w),
r AS (SELECT doc_id, n, CASE WHEN tiny THEN 0.0 ELSE round_even(v, 4) END AS slop_vocab_ratio, CASE WHEN tiny THEN 0 ELSE ph END AS slop_phrase_count, CASE WHEN tiny THEN 0.5 ELSE round_even(cv, 4) END AS sentence_length_cv,
  CASE WHEN tiny THEN 0.0 ELSE round_even(em, 4) END AS em_dash_density, CASE WHEN tiny THEN 0.0 ELSE round_even(tr, 4) END AS transition_start_ratio, CASE WHEN tiny THEN 1.0 ELSE round_even(ttr, 4) END AS type_token_ratio FROM s)
SELECT * EXCLUDE (n), round_even(least(1.0, least(1.0, slop_vocab_ratio * 30) * 0.06 + least(1.0, slop_phrase_count / 3.0) * 0.06 + greatest(0.0, 1 - sentence_length_cv / 0.25) * 0.03 + 0.5 * 0.35
  + CASE WHEN n < 50 THEN 0.25 WHEN n < 150 THEN 0.15 WHEN n < 400 THEN 0.08 ELSE 0.0 END + CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE 0.15 END + CASE WHEN doc_id % 2 = 0 THEN 0.0 ELSE 0.1 END), 4) AS slop_score FROM r
"""


def text_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Hidden runs that decode to a payload, planted by document id, with digest and redacted length (TXT17, TXT18, TXT20)."""
    tags = "".join(chr(0xE0000 + ord(c)) for c in "say hello")
    runs = [tags, "︀︁︂︎️︅", "​‌" * 9, "​" * 20, "️" * 8]
    planted = F.element_at(F.array(*map(F.lit, runs)), (F.col("doc_id") % len(runs) + 1).cast("int"))
    rows = texts(spark, folder).select("doc_id", F.concat("text", planted, F.lit("end")).alias("text"))
    found = rows.select("doc_id", F.length(T.redact(F.col("text"))).alias("kept_chars"), F.explode(T.payloads(F.col("text"))).alias("p"))
    return found.select("doc_id", "kept_chars", "p.kind", F.length("p.raw").alias("char_count"), "p.decoded", T.payload_digest(F.col("p")).alias("sha256"))


SQL_TEXT_PAYLOADS = """
WITH r AS (SELECT doc_id, text AS head, doc_id % 5 AS k FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, head, CASE k WHEN 0 THEN 'tag_block' WHEN 1 THEN 'variation_selector' ELSE 'zero_width' END AS kind,
  CASE k WHEN 0 THEN NULL WHEN 1 THEN chr(65024) || chr(65025) || chr(65026) || chr(65038) || chr(65039) || chr(65029) ELSE repeat(chr(8203) || chr(8204), 9) END AS raw, CASE WHEN k = 0 THEN 'say hello' END AS decoded FROM r WHERE k < 3)
SELECT doc_id, length(regexp_replace(head, '[\\x{200B}-\\x{200F}\\x{2060}-\\x{2064}\\x{FEFF}]{16,}', '', 'g')) + 3 AS kept_chars, kind, CASE kind WHEN 'tag_block' THEN 9 WHEN 'variation_selector' THEN 6 ELSE 18 END AS char_count, decoded, sha256(coalesce(decoded, raw)) AS sha256 FROM x
"""


def envelope_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One record per fetch: success or failure, with quality, hint and lifetime (PRJ01 to PRJ04, STT02, CLS14, CLS15)."""
    return envelopes(table(spark, folder, "fetch_cache"), now=1_705_000_000).select(
        "fetch_id", "url_canonical", "http_status", "word_count", "cache_age_seconds", "expired", "ttl_seconds", F.col("failure.reason").alias("reason"), F.col("failure.hint").alias("hint")
    )


SQL_ENVELOPE = """
WITH f AS (SELECT DISTINCT fetch_id, url, canonical_url, final_url, status, failure_reason, markdown, fetched_at, ttl_expires FROM fetch_cache),
w AS (SELECT *, CASE WHEN markdown IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(markdown, '%s'), lambda x: x <> '')) END AS n FROM f),
r AS (SELECT *, CASE WHEN failure_reason IS NOT NULL THEN failure_reason WHEN n = 0 THEN 'empty_body' END AS reason FROM w),
m AS (SELECT *, CASE WHEN reason IN ('not_found', 'robots_disallow', 'invalid_url', 'unsupported_content_type', 'category_landing') THEN 96.0 WHEN reason IN ('paywall_hard', 'login_required', 'prompt_smuggling') THEN 24.0
  WHEN reason IN ('blocked_bot', 'blocked_cloudflare', 'blocked_captcha') THEN 4.0 WHEN reason IN ('timeout', 'deadline_exceeded', 'server_error', 'dns_fail', 'parse_failed', 'browser_unavailable', 'empty_body') THEN 0.33 ELSE 1.0 END AS k FROM r)
SELECT fetch_id, coalesce(canonical_url, final_url, url) AS url_canonical, status AS http_status, CASE WHEN reason IS NULL THEN n END AS word_count, 1705000000 - fetched_at AS cache_age_seconds, coalesce(ttl_expires < 1705000000, false) AS expired,
  CASE WHEN reason IS NULL THEN 86400 ELSE greatest(1, CAST(floor(900 * k) AS INTEGER)) END AS ttl_seconds, reason, CASE WHEN reason IN ('blocked_captcha', 'blocked_cloudflare') THEN 'refresh' END AS hint FROM m
""" % _WS


MARKS = ["cdn.PIANO.io/x.js", "https://static.poool.fr/access.js and piano.io", "amp-access", "wallkit.net", "nothing"]


def paywall_vendors(spark: SparkSession, folder: str) -> DataFrame:
    """The first vendor, by name, whose fingerprint is in the page; a script is added to each text (CLS13, JON03)."""
    mark = F.element_at(F.array(*map(F.lit, MARKS)), (F.col("doc_id") % len(MARKS) + 1).cast("int"))
    return texts(spark, folder).select("doc_id", C.paywall_vendor(F.concat("text", F.lit("<script src='"), mark, F.lit("'></script>"))).alias("vendor"))


SQL_VENDORS = "SELECT doc_id, CASE WHEN text IS NOT NULL THEN CASE doc_id % 5 WHEN 0 THEN 'piano.io' WHEN 1 THEN 'piano.io' WHEN 2 THEN 'amp-access' WHEN 3 THEN 'wallkit.net' END END AS vendor FROM documents"


def error_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes out of errors of four kinds of callers, their messages made of logged reasons (CLS21)."""
    rows = table(spark, folder, "telemetry").select("entry_id", "failure_reason", "tool").dropDuplicates(["entry_id"])
    kinds = ["TimeoutError", "ReadTimeout", "ConnectError", "Error", "OSError"]
    said = ["net::ERR_ABORTED at ", "Target closed: ", "video is private: ", "HTTP Error 404: ", "request timed out ", "ECONNRESET "]
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col("entry_id") % by + 1).cast("int"))
    kind, message = pick(kinds, len(kinds)), F.concat(pick(said, len(said)), F.coalesce("failure_reason", F.lit("")))
    return rows.select(
        "entry_id", C.transport_hint(kind, message).alias("transport"), C.parser_error_reason(kind, message).alias("parser"), C.video_error_reason(message).alias("video"), C.download_error_reason(kind).alias("download")
    )


SQL_ERRORS = """
WITH e AS (SELECT entry_id, (['TimeoutError', 'ReadTimeout', 'ConnectError', 'Error', 'OSError'])[entry_id % 5 + 1] AS k,
  lower((['net::ERR_ABORTED at ', 'Target closed: ', 'video is private: ', 'HTTP Error 404: ', 'request timed out ', 'ECONNRESET '])[entry_id % 6 + 1] || coalesce(failure_reason, '')) AS m
  FROM (SELECT DISTINCT entry_id, failure_reason FROM telemetry))
SELECT entry_id, CASE WHEN k = 'TimeoutError' OR contains(m, 'timeout') THEN 'timeout' WHEN regexp_matches(m, 'connection closed|target closed|target page, context or browser has been closed|browser has been closed|net::err_aborted|net::err_http2_protocol_error|econnreset') THEN 'bot_blocked' ELSE 'dns_fail' END AS transport,
  CASE WHEN contains(lower(k), 'timeout') OR contains(m, 'timeout') THEN 'timeout' WHEN regexp_matches(m, 'connection closed|target closed|net::err_aborted') THEN 'blocked_bot' ELSE 'server_error' END AS parser,
  CASE WHEN regexp_matches(m, 'private|members-only|sign in|age') THEN 'login_required' WHEN regexp_matches(m, 'unavailable|removed|404|not exist') THEN 'not_found' WHEN regexp_matches(m, 'timed out|timeout') THEN 'timeout' ELSE 'server_error' END AS video,
  CASE WHEN k = 'ReadTimeout' THEN 'timeout' WHEN k = 'ConnectError' THEN 'dns_fail' ELSE 'server_error' END AS download FROM e
"""

CATALOG: dict[str, tuple[Query, str | None]] = {
    "page_outcomes": (page_outcomes, SQL_CLASSIFY),
    "page_visible": (page_visible, SQL_PAGE_VISIBLE),
    "page_types": (page_types, SQL_PAGE_TYPES),
    "text_counts": (text_counts, SQL_TEXT_COUNTS),
    "text_signals": (text_signals, SQL_TEXT_SIGNALS),
    "text_payloads": (text_payloads, SQL_TEXT_PAYLOADS),
    "envelope_rows": (envelope_rows, SQL_ENVELOPE),
    "paywall_vendors": (paywall_vendors, SQL_VENDORS),
    "error_reasons": (error_reasons, SQL_ERRORS),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOG.items() if sql}
