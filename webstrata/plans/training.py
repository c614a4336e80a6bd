"""Queries of the general data problems: nested records (3) and timestamps (7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webstrata.operators.instants import record_instants
from webstrata.operators.shredding import linked_children, shred
from webstrata.session import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return linked_children(table(spark, folder, "crossref"), table(spark, folder, "europepmc"), table(spark, folder, "appdetails"))


def p3_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Repetition and definition levels of three leaves of the Crossref answers."""
    once = table(spark, folder, "crossref").select("response_id", "message").dropDuplicates(["response_id"])
    paths = [["DOI"], ["license", "URL"], ["author", "affiliation", "name"]]
    return shred(once, "response_id", "message", paths)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return record_instants(table(spark, folder, "fetch_cache"), table(spark, folder, "sites"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p3_found": p3_found, "p3_levels": p3_levels, "p7_found": p7_found}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL, "p3_levels": P3_LEVELS_SQL, "p7_found": P7_SQL}


P3_SQL = r"""
WITH lic AS (
  SELECT DISTINCT 'license' AS child_table, response_id, 1 AS parent_pos, message.DOI AS item_key,
         unnest(range(1, len(message.license) + 1)) AS child_pos, unnest(message.license).URL AS child
  FROM crossref
), res AS (
  SELECT response_id, unnest(range(1, len(resultList.result) + 1)) AS parent_pos, unnest(resultList.result) AS r FROM europepmc
), names AS (
  SELECT response_id, parent_pos, r.id AS item_key,
         CASE WHEN contains(r.authorString, ';') THEN string_split(r.authorString, ';') ELSE string_split(r.authorString, ',') END AS parts
  FROM res WHERE r.authorString IS NOT NULL
), au AS (
  SELECT DISTINCT 'author' AS child_table, response_id, parent_pos, item_key,
         unnest(range(1, len(parts) + 1)) AS child_pos,
         regexp_replace(unnest(parts), '^\s+|[\s.]+$', '', 'g') AS child
  FROM names
), bodies AS (
  SELECT DISTINCT response_id, body FROM appdetails WHERE json_valid(body) AND json_type(body) = 'OBJECT'
), apps AS (
  SELECT response_id, unnest(range(1, len(json_keys(body)) + 1)) AS parent_pos, unnest(json_keys(body)) AS item_key, body FROM bodies
), dlcs AS (
  SELECT response_id, parent_pos, item_key, json_extract(body, '$."' || item_key || '".data.dlc') AS dlc FROM apps
), dl AS (
  SELECT 'dlc' AS child_table, response_id, parent_pos, item_key,
         unnest(range(1, len(CAST(dlc AS JSON[])) + 1)) AS child_pos, unnest(CAST(dlc AS JSON[])) ->> '$' AS child
  FROM dlcs WHERE json_type(dlc) = 'ARRAY'
)
SELECT child_table, response_id, item_key, CAST(child_pos AS BIGINT) AS child_pos, child FROM (
  SELECT * FROM lic UNION ALL SELECT * FROM au WHERE lower(child) NOT IN ('', 'et al') UNION ALL SELECT * FROM dl
) WHERE child IS NOT NULL
"""

P3_LEVELS_SQL = """
WITH c AS (SELECT DISTINCT response_id AS record_id, message AS m FROM crossref),
l AS (SELECT record_id, m, CASE WHEN len(m.license) > 0 THEN len(m.license) ELSE 0 END AS n, unnest(range(0, greatest(1, coalesce(len(m.license), 0)))) AS i FROM c),
a AS (SELECT record_id, m, coalesce(len(m.author), 0) AS n, unnest(range(0, greatest(1, coalesce(len(m.author), 0)))) AS i FROM c),
b AS (SELECT record_id, m, n, i, m.author[i + 1] AS x, coalesce(len(m.author[i + 1].affiliation), 0) AS k, unnest(range(0, greatest(1, coalesce(len(m.author[i + 1].affiliation), 0)))) AS j FROM a)
SELECT record_id, 'DOI' AS path, 0 AS seq, 0 AS rep, CASE WHEN m IS NULL THEN 0 WHEN m.DOI IS NULL THEN 1 ELSE 2 END AS def, 2 AS max_def, m.DOI AS value FROM c
UNION ALL SELECT record_id, 'license.URL', i, CASE WHEN i > 0 THEN 1 ELSE 0 END, CASE WHEN m IS NULL THEN 0 WHEN m.license IS NULL THEN 1 WHEN n = 0 THEN 2 WHEN m.license[i + 1] IS NULL THEN 3 WHEN m.license[i + 1].URL IS NULL THEN 4 ELSE 5 END, 5, m.license[i + 1].URL FROM l
UNION ALL SELECT record_id, 'author.affiliation.name', row_number() OVER (PARTITION BY record_id ORDER BY i, j) - 1, CASE WHEN j > 0 THEN 2 WHEN i > 0 THEN 1 ELSE 0 END,
  CASE WHEN m IS NULL THEN 0 WHEN m.author IS NULL THEN 1 WHEN n = 0 THEN 2 WHEN x IS NULL THEN 3 WHEN x.affiliation IS NULL THEN 4 WHEN k = 0 THEN 5 WHEN x.affiliation[j + 1] IS NULL THEN 6 WHEN x.affiliation[j + 1].name IS NULL THEN 7 ELSE 8 END, 8, x.affiliation[j + 1].name FROM b
"""

# By shape: epoch numbers, ISO and compact forms, numbers in the site's order, and month names of seven languages before or after the day.
P7_SQL = r"""
WITH f AS (SELECT DISTINCT fetch_id, url, published, modified FROM fetch_cache),
r AS (SELECT fetch_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, unnest(['published', 'modified']) AS field, unnest([published, modified]) AS raw FROM f),
s AS (SELECT fetch_id, field, trim(raw) AS t, coalesce(time_zone, 'UTC') AS tz, coalesce(day_first, false) AS df FROM r LEFT JOIN sites USING (host) WHERE raw IS NOT NULL),
g AS (SELECT *,
  regexp_extract(t, '^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T ]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?)?\s*(Z|[+-]\d{2}(?::?\d{2})?)?\s*\[?([A-Za-z]+/[A-Za-z_/]+)?\]?$', ['y', 'm', 'd', 'h', 'mi', 's', 'fr', 'off', 'zone']) AS iso,
  regexp_extract(t, '^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(Z?)$', ['y', 'm', 'd', 'h', 'mi', 's', 'off']) AS packed,
  regexp_extract(t, '^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(?:([AaPp])\.?[Mm]\.?)?)?$', ['a', 'b', 'y', 'h', 'mi', 's', 'half']) AS num,
  regexp_extract(lower(t), '^(?:\pL+\.?, )?(\d{1,2})\.? (?:de )?(\pL+)\.? (?:de )?(\d{4})(?: г\.?)?(?:(?:,| às| à| um| alle ore| alle| ore| a las)* +(\d{1,2})[:h](\d{2})(?::(\d{2}))?(?: uhr)?)? ?(gmt|[+-]\d{4})?$', ['d', 'm', 'y', 'h', 'mi', 's', 'off']) AS dmy,
  regexp_extract(lower(t), '^(\pL+) (\d{1,2}), (\d{4})(?: (\d{1,2}):(\d{2})(?::(\d{2}))? ([ap])m(?: [a-z]{2,5})?)?$', ['m', 'd', 'y', 'h', 'mi', 's', 'half']) AS mdy FROM s),
p AS (SELECT fetch_id, field, t, tz, CASE
    WHEN iso.y <> '' THEN {'y': iso.y, 'm': iso.m, 'd': iso.d, 'h': iso.h, 'mi': iso.mi, 's': iso.s, 'fr': iso.fr, 'half': '', 'off': iso.off, 'zone': iso.zone}
    WHEN packed.y <> '' THEN {'y': packed.y, 'm': packed.m, 'd': packed.d, 'h': packed.h, 'mi': packed.mi, 's': packed.s, 'fr': '', 'half': '', 'off': packed.off, 'zone': ''}
    WHEN num.y <> '' THEN {'y': num.y, 'm': CASE WHEN df THEN num.b ELSE num.a END, 'd': CASE WHEN df THEN num.a ELSE num.b END, 'h': num.h, 'mi': num.mi, 's': num.s, 'fr': '', 'half': lower(num.half), 'off': '', 'zone': ''}
    WHEN dmy.y <> '' THEN {'y': dmy.y, 'm': dmy.m, 'd': dmy.d, 'h': dmy.h, 'mi': dmy.mi, 's': dmy.s, 'fr': '', 'half': '', 'off': dmy.off, 'zone': ''}
    WHEN mdy.y <> '' THEN {'y': mdy.y, 'm': mdy.m, 'd': mdy.d, 'h': mdy.h, 'mi': mdy.mi, 's': mdy.s, 'fr': '', 'half': mdy.half, 'off': '', 'zone': ''} END AS x FROM g),
n AS (SELECT fetch_id, field, t, tz, x, TRY_CAST(x.y AS BIGINT) AS y, TRY_CAST(x.d AS BIGINT) AS d, CASE WHEN regexp_matches(x.m, '^\d') THEN TRY_CAST(x.m AS BIGINT) WHEN regexp_matches(x.m, '^(jan|ene|gen|янв)') THEN 1 WHEN regexp_matches(x.m, '^(feb|fev|fév|фев)') THEN 2 WHEN regexp_matches(x.m, '^(mar|mär|мар)') THEN 3
    WHEN regexp_matches(x.m, '^(ap|abr|avr|апр)') THEN 4 WHEN regexp_matches(x.m, '^(may|mai|mag|май|мая)') THEN 5 WHEN regexp_matches(x.m, '^(jun|juin|giu|июн)') THEN 6 WHEN regexp_matches(x.m, '^(jul|juil|lug|июл)') THEN 7 WHEN regexp_matches(x.m, '^(au|ag|ao|авг)') THEN 8
    WHEN regexp_matches(x.m, '^(se|сен)') THEN 9 WHEN regexp_matches(x.m, '^(oc|ok|out|ott|окт)') THEN 10 WHEN regexp_matches(x.m, '^(nov|ноя)') THEN 11 WHEN regexp_matches(x.m, '^(dec|dez|déc|dic|дек)') THEN 12 END AS m,
  TRY_CAST(coalesce(nullif(x.h, ''), '0') AS BIGINT) AS h0, TRY_CAST(coalesce(nullif(x.mi, ''), '0') AS BIGINT) AS mi, TRY_CAST(coalesce(nullif(x.s, ''), '0') AS BIGINT) AS sec, TRY_CAST(rpad(substr(coalesce(x.fr, ''), 1, 6), 6, '0') AS BIGINT) AS us FROM p),
l AS (SELECT *, TRY(make_timestamp(y, m, d, CASE x.half WHEN 'p' THEN h0 % 12 + 12 WHEN 'a' THEN h0 % 12 ELSE h0 END, mi, sec::DOUBLE)) + to_microseconds(us) AS ts FROM n),
z AS (SELECT *, CASE WHEN upper(x.off) IN ('Z', 'GMT') THEN epoch_us(ts) WHEN x.off <> '' THEN epoch_us(ts) - (CASE WHEN x.off[1] = '-' THEN -1 ELSE 1 END) * (TRY_CAST(x.off[2:3] AS BIGINT) * 60 + TRY_CAST(coalesce(nullif(regexp_extract(x.off, '(\d{2})$', 1), CASE WHEN length(x.off) = 3 THEN x.off[2:3] ELSE '' END), '0') AS BIGINT)) * 60000000 END AS fixed, coalesce(nullif(x.zone, ''), tz) AS here FROM l),
w AS (SELECT *, timezone(here, ts) AS u FROM z)
SELECT fetch_id, field, CASE WHEN regexp_matches(t, '^\d{9,10}$') THEN TRY_CAST(t AS BIGINT) * 1000000 WHEN regexp_matches(t, '^\d{13}$') THEN TRY_CAST(t AS BIGINT) * 1000 WHEN fixed IS NOT NULL THEN fixed
  WHEN timezone(here, u - INTERVAL 1 HOUR) = ts THEN epoch_us(u - INTERVAL 1 HOUR) ELSE epoch_us(u) END AS utc_us FROM w WHERE utc_us IS NOT NULL
"""
