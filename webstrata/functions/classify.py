"""Outcomes of recorded responses, as one decision list over columns; never fails on any input.

Null status counts as 0, null body as empty, null headers as none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from webstrata.functions.urls import let

# Markers, in lower case, of pages that stand in for content.
CLOUDFLARE = ["cf-mitigated", "just a moment...", "challenge-platform", "/cdn-cgi/challenge-platform/", "attention required! | cloudflare", "cf_chl_opt", "__cf_chl_"]
CAPTCHA = ['class="h-captcha"', "class='h-captcha'", 'class="g-recaptcha"', "class='g-recaptcha'", "challenges.cloudflare.com/turnstile"]
SLIDER = ["_____tmd_____", "x5secdata", "slidetounlock", "baxia-punish", "punish?x5secdata", "nc-lang-cnt", "captcha interception"]
ROBOT = ["/errors/validatecaptcha", "api-services-support@amazon", "opfcaptcha-prod"]
INTERSTITIAL = ["/_sec/verify?provider=interstitial", "bm-verify="]
LOGIN = [
    "log in to continue", "login to continue", "sign in to continue", "please log in", "you must be logged in", 'action="/login"', "action='/login'",
    'action="/signin"', "action='/signin'", 'action="/account/login"', 'action="/auth/login"', 'action="/users/sign_in"',
]
ACCOUNT_WALL = ["/gz/account-verification", "para continuar, acesse sua conta"]
PAYWALL = [
    "subscribe to continue", "subscribe to read", "subscribers only", "this article is for subscribers", "members only",
    'class="paywall"', "class='paywall'", 'id="paywall', "id='paywall", "data-paywall",
]
SCRIPT_NOTICE = ["requires javascript", "please enable javascript", "enable javascript to continue", "you need to enable javascript", "javascript is required", "javascript to be enabled"]
CLOSED_SCHEMA = r"""(?i)isAccessibleForFree["']?\s*[:=]\s*["']?False"""
SOFT_PAYWALL_CHARS, CHALLENGE_CHARS, SHELL_CHARS = 400, 2000, 600

# The closed set of outcomes with the factor of their cache lifetime.
REASON_TTL = {
    "not_found": 96.0, "robots_disallow": 96.0, "invalid_url": 96.0, "unsupported_content_type": 96.0, "category_landing": 96.0,
    "paywall_hard": 24.0, "login_required": 24.0, "prompt_smuggling": 24.0, "blocked_bot": 4.0, "blocked_cloudflare": 4.0, "blocked_captcha": 4.0,
    "timeout": 0.33, "deadline_exceeded": 0.33, "server_error": 0.33, "dns_fail": 0.33, "parse_failed": 0.33, "browser_unavailable": 0.33, "empty_body": 0.33,
    "paywall_soft_with_partial": 1.0, "js_app_needs_interaction": 1.0, "ok": 1.0,
}

# Content types.
PLAIN_TYPES = ["text/plain", "text/markdown", "text/x-markdown", "text/x-rst"]
BINARY_TYPES = (
    "application/octet-stream application/zip application/gzip application/x-gzip application/x-bzip2 application/x-xz application/x-tar "
    "application/x-7z-compressed application/x-rar-compressed application/vnd.rar application/x-msdownload application/x-executable "
    "application/x-sharedlib application/wasm application/java-archive application/vnd.android.package-archive application/x-iso9660-image application/x-apple-diskimage"
).split()
OFFICE_BY_EXTENSION = {"docx": "docx", "epub": "epub", "odt": "odt", "rtf": "rtf"}
OFFICE_BY_TYPE = {
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/epub+zip": "epub",
    "application/vnd.oasis.opendocument.text": "odt",
    "application/rtf": "rtf",
    "text/rtf": "rtf",
}


def has_any(body: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [body.contains(m) for m in markers])


def visible_text(html: Column) -> Column:
    """Tags, scripts and styles gone, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))


def header(headers: Column, name: str) -> Column:
    """A header by name in any letter case, or null."""
    hits = F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name))
    return F.get(hits, F.lit(0))


def classify(status: Column, html: Column, hint: Column | None = None, mitigated: Column | None = None) -> Column:
    """The outcome of a response.  ``hint`` is the failure hint of a missing response, ``mitigated``
    whether a challenge header came with it."""
    status = F.coalesce(status, F.lit(0))
    html = F.coalesce(html, F.lit(""))
    body = F.lower(html)
    hint = F.lower(F.coalesce(hint, F.lit(""))) if hint is not None else F.lit("")
    mitigated = F.coalesce(mitigated, F.lit(False)) if mitigated is not None else F.lit(False)
    size = F.length(visible_text(html))
    challenge = has_any(body, CLOUDFLARE)
    refused = (
        F.when(has_any(body, LOGIN) | has_any(body, ACCOUNT_WALL), "login_required")
        .when(challenge | mitigated, "blocked_cloudflare")
        .when(has_any(body, CAPTCHA), "blocked_captcha")
        .when(status == 401, "login_required")
        .otherwise("blocked_cloudflare")
    )
    thin = size < CHALLENGE_CHARS
    answered = (
        F.when((challenge | mitigated) & thin, "blocked_cloudflare")
        .when(has_any(body, INTERSTITIAL) & thin, "blocked_bot")
        .when(has_any(body, CAPTCHA) & thin, "blocked_captcha")
        .when(has_any(body, ACCOUNT_WALL) & thin, "login_required")
        .when(html.rlike(CLOSED_SCHEMA), "paywall_hard")
        .when(has_any(body, PAYWALL) & (size < SOFT_PAYWALL_CHARS), "paywall_hard")
        .when(has_any(body, PAYWALL), "paywall_soft_with_partial")
        .when((size < SHELL_CHARS) & has_any(body, SCRIPT_NOTICE), "js_app_needs_interaction")
        .otherwise("ok")
    )
    missing = F.when(hint == "timeout", "timeout").when(hint == "bot_blocked", "blocked_bot").when(hint == "browser_unavailable", "browser_unavailable").otherwise("dns_fail")
    return (
        F.when(status == 0, missing)
        .when(has_any(body, SLIDER), "blocked_captcha")
        .when(~status.isin(404, 410) & has_any(body, ROBOT), "blocked_captcha")
        .when(status.isin(404, 410), "not_found")
        .when(status.isin(401, 403), refused)
        .when(status == 429, F.when(challenge, "blocked_cloudflare").otherwise("server_error"))
        .when(status.between(500, 599), "server_error")
        .when(status.between(200, 399), answered)
        .otherwise("server_error")
    )


def bare_type(content_type: Column, default: str = "") -> Column:
    """The type without parameters; letter case as given."""
    bare = F.trim(F.substring_index(content_type, ";", 1))
    return F.when(bare.isNull() | (bare == ""), default).otherwise(bare)


def is_plain_text(content_type: Column, body: Column) -> Column:
    head = F.lower(F.substring(F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+", ""), 1, 256))
    return F.lower(bare_type(content_type)).isin(*PLAIN_TYPES) & ~(head.startswith("<!doctype html") | head.startswith("<html"))


def looks_binary(body: Column) -> Column:
    """Whether decoded text holds a NUL, or more than 5 % control and replacement characters."""
    sample = F.substring(F.coalesce(body, F.lit("")), 1, 4096)
    odd = F.length(sample) - F.length(F.regexp_replace(sample, "[\\x{FFFD}\\x01-\\x08\\x0E-\\x1F]", ""))
    return (F.length(sample) > 0) & (sample.contains("\x00") | (odd > 0.05 * F.length(sample)))


def skips_body(content_type: Column) -> Column:
    """Whether the type alone says that the body is binary."""
    bare = F.lower(bare_type(content_type))
    return bare.rlike("^(image|audio|video|font)/") | (bare.isin(*BINARY_TYPES) & (bare != "application/octet-stream"))


def is_unsupported(content_type: Column, body: Column) -> Column:
    return skips_body(content_type) | ((F.lower(bare_type(content_type)) == "application/octet-stream") & looks_binary(body))


def is_pdf(path: Column, content_type: Column) -> Column:
    return F.lower(path).endswith(".pdf") | F.coalesce(F.lower(content_type).contains("application/pdf"), F.lit(False))


def office_format(path: Column, content_type: Column) -> Column:
    """The document format by extension, else by type, else null."""
    by_extension = F.create_map(*[F.lit(x) for p in OFFICE_BY_EXTENSION.items() for x in p])
    by_type = F.create_map(*[F.lit(x) for p in OFFICE_BY_TYPE.items() for x in p])
    extension = F.when(path.contains("."), F.lower(F.substring_index(path, ".", -1))).otherwise("")
    return F.coalesce(F.try_element_at(by_extension, extension), F.try_element_at(by_type, F.lower(bare_type(content_type))))


def ttl_seconds(reason: Column, success: int = 86400, failure: int = 900) -> Column:
    """Cache lifetime: ``success`` without a reason, else a factor of ``failure``, at least a second."""
    factors = F.create_map(*[F.lit(x) for p in REASON_TTL.items() for x in p])
    scaled = F.floor(F.lit(failure) * F.coalesce(F.try_element_at(factors, reason), F.lit(1.0))).cast("int")
    return F.when(reason.isNull(), F.lit(success)).otherwise(F.greatest(scaled, F.lit(1)))


def _whole_number(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text)).try_cast("long")


def retry_after(headers: Column) -> Column:
    """Seconds to wait, or null where the header is absent or no whole number (CLS10)."""
    return _whole_number(header(headers, "retry-after"))


def content_length(headers: Column) -> Column:
    """The stated length, or null where it is absent or no whole number (CLS10)."""
    return _whole_number(header(headers, "content-length"))


PDF_WINDOW = 1024


def document_failure(status: Column, body: Column, is_pdf_asked: Column) -> Column:
    """Why a download is not the document, or null (SRC15): any status but a success has its outcome, and
    a success asked for as PDF without the mark in its first bytes has that of a page.  ``body`` is binary."""
    text = body.cast("string")
    good = F.coalesce(status, F.lit(0)).between(200, 299)
    marked = F.coalesce(F.position(F.lit("%PDF"), F.decode(F.substring(body, 1, PDF_WINDOW), "ISO-8859-1")) > 0, F.lit(False))
    plain = F.when(good, "unsupported_content_type").otherwise("server_error")  # where the body tells nothing
    return F.when(~good | (is_pdf_asked & ~marked), let(classify(status, text), lambda outcome: F.when(outcome == "ok", plain).otherwise(outcome)))


# Fingerprints of paywall vendors, and markers of paywall scripts.
PAYWALL_VENDORS = ["piano.io", "tinypass.com", "poool.fr", "zephr.com", "qiota.com", "pelcro.com", "wallkit.net", "flip-pay.com", "evolok.net", "onecount.net", "tribdss.com"]
PAYWALL_SCRIPTS = ["amp-access", "amp-subscriptions"]


def paywall_vendor(html: Column, vendors: list[str] = PAYWALL_VENDORS) -> Column:
    """The first vendor, by name, whose fingerprint is in the page, or null (CLS13, JON03).  The list is a
    parameter; script markers always count.  A page is scanned once per fingerprint, in place: a join
    would repeat the page."""
    low = F.lower(html)
    return F.coalesce(*[F.when(low.contains(v), v) for v in sorted({*vendors, *PAYWALL_SCRIPTS})])


# What browsers say when a page was torn down.
DISCONNECTS = [
    "connection closed", "target closed", "target page, context or browser has been closed", "browser has been closed", "net::err_aborted", "net::err_http2_protocol_error", "econnreset",
]
PARSER_DISCONNECTS = ["connection closed", "target closed", "net::err_aborted"]
# Words of video errors, in the order they are asked.
VIDEO_ERRORS = [
    ("login_required", ["private", "members-only", "sign in", "age"]), ("not_found", ["unavailable", "removed", "404", "not exist"]), ("timeout", ["timed out", "timeout"]),
]


def transport_hint(kind: Column, message: Column) -> Column:
    """The failure hint of a browser's error (CLS21): a timeout, a torn-down page, else unavailable."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.when((kind == "TimeoutError") | low.contains("timeout"), "timeout").when(has_any(low, DISCONNECTS), "bot_blocked").otherwise("dns_fail")


def parser_error_reason(kind: Column, message: Column) -> Column:
    """The outcome of an error while a page's parser fetched it (CLS21)."""
    low = F.lower(F.coalesce(message, F.lit("")))
    late = F.coalesce(F.lower(kind).contains("timeout"), F.lit(False)) | low.contains("timeout")
    return F.when(late, "timeout").when(has_any(low, PARSER_DISCONNECTS), "blocked_bot").otherwise("server_error")


def video_error_reason(message: Column) -> Column:
    """The outcome of a video service's error text (CLS21)."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("server_error")
    for reason, words in reversed(VIDEO_ERRORS):
        out = F.when(has_any(low, words), reason).otherwise(out)
    return out


def download_error_reason(kind: Column) -> Column:
    """The outcome of a failed download by the kind of its error (CLS21)."""
    late = ["TimeoutException", "ConnectTimeout", "ReadTimeout", "WriteTimeout", "PoolTimeout"]
    return F.when(kind.isin(*late), "timeout").when(kind == "ConnectError", "dns_fail").otherwise("server_error")


# What pages of restricted tasks say.
AUTH_WALL = ["you do not have permission", "you shall not pass", "phabricator-login"]


def is_auth_wall(html: Column) -> Column:
    """Whether a task page only asks to log in (CLS20)."""
    title = F.lower(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")))
    return has_any(F.lower(html), AUTH_WALL) | (title == "login")


def infer_outcome(outcome: Column, exception: Column, failure_reason: Column, empty_passages: Column) -> Column:
    """The outcome of an event written before outcomes were (CLS22): stated, else exception, fail, empty, ok.
    Empty texts and false count as absent."""
    return F.coalesce(
        outcome,
        F.when(F.coalesce(exception != "", F.lit(False)), "exception")
        .when(F.coalesce(failure_reason != "", F.lit(False)), "fail")
        .when(F.coalesce(empty_passages, F.lit(False)), "empty")
        .otherwise("ok"),
    )
