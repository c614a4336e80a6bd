"""Small tables with the faults the operators have to bear."""

import gzip

FETCH = "fetch_id LONG, url STRING, title STRING, markdown STRING, html_gz BINARY, language STRING, status INT, failure_reason STRING, word_count INT, quality_json STRING, host STRING, text STRING, chrome STRING, drop STRING, label STRING"
DOCS = "doc_id LONG, text STRING, source STRING, ids STRING, n_tokens STRING, container_kind STRING, `abusive` STRING"


def fetch_rows(pages):
    """Rows of (fetch_id, url, title, markdown, html, language, status) with extra columns of clashing names."""
    return [(i, u, t, m, gzip.compress(h.encode()) if isinstance(h, str) else h, lang, s, None, None, None, "h", "t", "c", "d", "l") for i, u, t, m, h, lang, s in pages]


def odd_fetches(spark):
    long = "A sentence that goes on and on. " * 4000
    rows = fetch_rows(
        [
            (1, "https://a.test/1", None, None, None, None, None),
            (2, None, "", "", b"", "", 200),
            (3, "not a url", "  ", " \n\n ", b"not gzip", "xx", 404),
            (4, "https://a.test/4", "T", long, "<html><body><p>" + long, "en", 200),
            (4, "https://a.test/4", "T", long, "<html><body><p>" + long, "en", 200),
            (5, "https://[bad", "x" * 5000, "y" * 60000, gzip.compress(b"\xff\xfe"), "en", 0),
            (6, "https://a.test/6", "T", "```\nunclosed fence\n", gzip.compress(b"<p>cut")[:-4], "de", 200),
        ]
    )
    rows.append((None,) * 15)
    return spark.createDataFrame(rows, FETCH)


def odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "word " * 30000), (5, "x" * 50000), (6, "a\r\nb c   d"), (6, "a\r\nb c   d"), (None, "hi")]
    return spark.createDataFrame([(i, t, None, "i", "n", "k", "a") for i, t in rows], DOCS)
