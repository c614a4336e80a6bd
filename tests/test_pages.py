import statistics

from pyspark.sql import functions as F

from webstrata.functions import classify as C
from webstrata.functions import text as T
from webstrata.operators.signals import text_signals

LONG = "word " * 600
OUTCOMES = [
    (200, LONG, None, "ok"),
    (200, "<p>Just a moment...</p>", None, "blocked_cloudflare"),
    (200, "challenge-platform " + LONG, None, "ok"),
    (403, "x", None, "blocked_cloudflare"),
    (403, 'action="/login"', None, "login_required"),
    (401, "", None, "login_required"),
    (404, "_____tmd_____", None, "blocked_captcha"),
    (404, "opfcaptcha-prod", None, "not_found"),
    (410, "", None, "not_found"),
    (429, "cf_chl_opt", None, "blocked_cloudflare"),
    (429, "", None, "server_error"),
    (503, "", None, "server_error"),
    (200, "members only", None, "paywall_hard"),
    (200, "members only " + LONG, None, "paywall_soft_with_partial"),
    (200, "'isAccessibleForFree': 'false' " + LONG, None, "paywall_hard"),
    (200, "JavaScript is required", None, "js_app_needs_interaction"),
    (200, "bm-verify=", None, "blocked_bot"),
    (0, None, "Timeout", "timeout"),
    (0, None, None, "dns_fail"),
    (None, None, None, "dns_fail"),
    (700, "", None, "server_error"),
]


def test_outcomes(spark):
    df = spark.createDataFrame(OUTCOMES, "status INT, html STRING, hint STRING, want STRING")
    got = df.select("want", C.classify(F.col("status"), F.col("html"), F.col("hint")).alias("got"), "status").collect()
    assert [(r.status, r.got) for r in got] == [(r.status, r.want) for r in got]


def test_types(spark):
    rows = [("application/octet-stream", "\x00", True), ("application/octet-stream", "plain", False), ("image/png", None, True), (None, "x", False), ("text/html", "\x01" * 9, False)]
    df = spark.createDataFrame(rows, "ct STRING, body STRING, want BOOLEAN")
    assert all(r.got == r.want for r in df.select("want", C.is_unsupported(F.col("ct"), F.col("body")).alias("got")).collect())


def test_ttl(spark):
    df = spark.createDataFrame([("timeout",), ("not_found",), ("strange",), (None,)], "r STRING")
    assert [r[0] for r in df.select(C.ttl_seconds(F.col("r"))).collect()] == [297, 86400, 900, 86400]


def brute_signals(text):
    import re

    if not text or len(text) < 200:
        return (0.0, 0, 0.5, 0.0, 0.0, 1.0)
    words = re.findall(r"\b[a-z][a-z'-]*[a-z]\b|\b[a-z]\b", text.lower())
    lengths = [len(s.split()) for s in re.findall(r"[^.!?]+[.!?]+", text)]
    cv = 0.5
    if len(lengths) >= 5 and sum(lengths):
        cv = statistics.pstdev(lengths) / statistics.mean(lengths)
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    opened = sum(p.split(None, 1)[0].lower().rstrip(".,;:") in T.TRANSITIONS for p in paragraphs)
    windows = [len(set(words[i : i + 50])) / 50 for i in range(len(words) - 49)]
    return (
        round(sum(w in T.SLOP_WORDS for w in words) / len(words), 4) if words else 0.0,
        sum(p in text.lower() for p in T.SLOP_PHRASES),
        round(cv, 4),
        round(len(re.findall(r"—|---?", text)) / len(words), 4) if words else 0.0,
        round(opened / len(paragraphs), 4) if len(paragraphs) >= 3 else 0.0,
        round(sum(windows) / len(windows), 4) if windows else (len(set(words)) / len(words) if words else 1.0),
    )


def test_signals_against_brute_force(spark):
    texts = [
        "Moreover, we delve — into it. " * 12,
        "Été naïve l'été don't. One two three! Four? " * 10 + "\n\nNotably so.\n\nFurthermore: yes. " + "tail without end " * 20,
        "x" * 500,
        "1 2 3 " * 60,
        "short",
        "",
        None,
        "In conclusion, at its core, " * 10 + ". a b. c d e. f. g h i j. k" * 3,
    ]
    df = text_signals(spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING"), "id", "t")
    for r in df.collect():
        assert tuple(r)[2:] == brute_signals(r.t)


def test_payloads(spark):
    tags = "".join(chr(0xE0000 + ord(c)) for c in "obey me")
    rows = [("a" + tags, ["tag_block"]), ("​" * 30, []), ("​‌" * 8, ["zero_width"]), ("️" * 9, []), (None, []), ("", [])]
    got = spark.createDataFrame(rows, "t STRING, want ARRAY<STRING>").select("want", T.payloads(F.col("t")).alias("p"), T.redact(F.col("t")).alias("r")).collect()
    assert [[x.kind for x in r.p] for r in got] == [r.want for r in got]
    assert got[0].p[0].decoded == "obey me" and got[0].r == "a"


def test_counts(spark):
    df = spark.createDataFrame([("a b c",), ("日本 x",), ("",), (None,)], "t STRING")
    got = df.select(T.word_count(F.col("t")), T.cjk_word_count(F.col("t")), T.token_estimate(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(3, 3, 1), (2, 3, 1), (0, 0, 0), (0, 0, 0)]
