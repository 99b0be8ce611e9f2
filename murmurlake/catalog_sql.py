"""DuckDB SQL for the catalog's queries, written from their definitions."""

from __future__ import annotations

from .catalog_base import stamp_sql as _stamp
from .catalog_base import turns_sql
from .operators.spans import LABELS, TERM_LISTS, TermList
from .samples import SENTENCES

_TEXTS = "SELECT doc_id, text FROM documents UNION ALL " + " UNION ALL ".join("SELECT {}, '{}'".format(-1 - i, t.replace("'", "''")) for i, t in enumerate(SENTENCES))

_LUHN = "(10 - list_sum(list_transform(range(0, 9), lambda i: CASE WHEN i % 2 = 0 THEN list_extract([0,2,4,6,8,1,3,5,7,9], substr(ten, i::INT + 1, 1)::INT + 1) ELSE substr(ten, i::INT + 1, 1)::INT END)) % 10) % 10 = substr(ten, 10, 1)::INT"


def _found(pattern: str, source: str = _TEXTS) -> str:
    """CTEs m(doc_id, text, span_start, span_end, m, b, a): matches with the characters before and after."""
    p = pattern.replace("'", "''")
    return f"""
WITH d AS ({source}), p AS (
  SELECT doc_id, text, string_split(regexp_replace(text, '({p})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM d WHERE regexp_matches(text, '{p}')
), u AS (
  SELECT doc_id, text, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p
), o AS (
  SELECT *, (sum(length(replace(part, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY i) - length(replace(part, chr(2), '')))::INT AS span_start, split_part(part, chr(2), 1) AS m FROM u
), m AS (
  SELECT doc_id, text, span_start, (span_start + length(m))::INT AS span_end, m,
    CASE WHEN span_start > 0 THEN substr(text, span_start, 1) ELSE '' END AS b, substr(text, span_start + length(m)::INT + 1, 1) AS a
  FROM o WHERE i > 1
)"""


_FREE = r"NOT regexp_matches(b, '[\p{L}\p{N}]') AND NOT regexp_matches(a, '[\p{L}\p{N}]')"
_D = "regexp_replace(m, '[^0-9]', '', 'g')"
_OUT = "SELECT doc_id, span_start, span_end, m AS text, {score}::DOUBLE AS score FROM m WHERE {test}"

_U = """
WITH r AS (
  SELECT conv_id AS meeting_id, turn::INT AS idx, role AS speaker, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), c AS (
  SELECT *, sum(length(text)) OVER (PARTITION BY meeting_id ORDER BY idx) AS chars FROM r
), u AS (
  SELECT meeting_id, idx, speaker, text, (chars - length(text)) / 15.0::DOUBLE AS "start", chars / 15.0::DOUBLE AS "end",
    upper(speaker[1]) || speaker[2:] AS name, lag(speaker) OVER (PARTITION BY meeting_id ORDER BY idx) AS before,
    row_number() OVER (PARTITION BY meeting_id ORDER BY idx) AS n FROM c
)"""


_TURNS = turns_sql(_U)

_SOURCES = _U + """, k AS (
  SELECT meeting_id, idx, "start", "end", text, 'Jag' AS speaker, 0 AS src FROM u WHERE speaker = 'user'
  UNION ALL SELECT meeting_id, idx, "start" + 0.5, "end" + 0.5, text, 'Jag', 0 FROM u WHERE speaker = 'assistant' AND idx % 4 = 1
  UNION ALL SELECT meeting_id, idx, "start", "end", text, 'Mötet', 1 FROM u WHERE speaker <> 'user'
), l AS (
  SELECT meeting_id, (row_number() OVER (PARTITION BY meeting_id ORDER BY "start", src, idx) - 1)::INT AS idx, speaker, "start", "end", text FROM k
)"""

_JOBS = """
WITH f AS (
  SELECT c_custkey, r_name || '/' || n_name || '/' || c_mktsegment AS category FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), j AS (
  SELECT o_orderkey AS id, 'Order ' || o_orderkey AS title, category, strftime(o_orderdate, '%Y-%m-%d') AS updated_at, o_orderstatus AS summary, o_orderpriority AS notes, o_totalprice AS price
  FROM orders JOIN f ON o_custkey = c_custkey
), a AS (
  SELECT l_orderkey AS id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linestatus = 'F', 'S' || l_suppkey, l_shipdate) - 1)::BIGINT AS idx, 'Line ' || l_linenumber AS text, l_linestatus = 'F' AS done,
    'S' || l_suppkey AS assignee, strftime(l_shipdate, '%Y-%m-%d') AS due FROM lineitem
), x AS (
  SELECT j.id AS job_id, idx, title AS project, category, text, done, assignee, due FROM j JOIN a ON j.id = a.id
  UNION ALL SELECT NULL, p_partkey::INT::BIGINT, 'Fristående', 'Egna', 'Part ' || p_partkey, p_size % 2 = 0, NULL, 'snart' FROM part
), y AS (
  SELECT *, CASE WHEN coalesce(trim(due), '') = '' THEN 'none' WHEN NOT regexp_matches(due, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'text'
    WHEN due < '1998-06-01' THEN 'overdue' WHEN due = '1998-06-01' THEN 'today' WHEN due <= '1998-06-08' THEN 'soon' ELSE 'future' END AS state FROM x
), z AS (
  SELECT id, category, floor(price)::BIGINT AS size, string_split(category, '/') AS parts FROM j
), w AS (
  SELECT id, size, unnest([array_to_string(parts[1:1], '/'), array_to_string(parts[1:2], '/'), array_to_string(parts[1:3], '/')]) AS folder FROM z
)"""

_MAIL, _IP = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
_IP_OK = r"NOT regexp_matches(b, '[\p{L}\p{N}.]') AND NOT regexp_matches(a, '[\p{L}\p{N}.]') AND list_max(list_transform(string_split(m, '.'), lambda x: x::INT)) <= 255"
_PLAIN = "SELECT doc_id, text FROM documents"
_URL = r"""(?:https?://|www\.)[^\s<>"'()]+"""
_URL_OUT = """ SELECT doc_id, span_start, (span_start + length(t))::INT AS span_end, t AS text, 0.95::DOUBLE AS score FROM (SELECT *, regexp_replace(m, '[.,;:!?)\\]}"'']+$', '') AS t FROM m) WHERE t <> ''"""

_SIGNALS = """
WITH s AS (
  SELECT user_id, coalesce(list(value / 100.0 ORDER BY event_id) FILTER (event_id % 2 = 0), []) AS a, coalesce(list(value / 100.0 ORDER BY event_id) FILTER (event_id % 2 = 1), []) AS b
  FROM events WHERE value IS NOT NULL GROUP BY user_id
)"""

_RULE_SQL = {
    "personnummer": _found("[0-9]{6,8}[-+]?[0-9]{4}")
    + f""", t AS (
  SELECT *, CASE length({_D}) WHEN 10 THEN {_D} WHEN 12 THEN substr({_D}, 3) END AS ten FROM m WHERE {_FREE}
)
SELECT doc_id, span_start, span_end, m AS text, CASE WHEN {_LUHN} THEN 1.0 ELSE 0.6 END::DOUBLE AS score FROM t
WHERE ten IS NOT NULL AND substr(ten, 3, 2)::INT BETWEEN 1 AND 12 AND (substr(ten, 5, 2)::INT BETWEEN 1 AND 31 OR substr(ten, 5, 2)::INT BETWEEN 61 AND 91)""",
    "epost": _found(_MAIL) + _OUT.format(score="1.0", test="true"),
    "telefon": _found(r"(?:\+46|0046|0)[0-9 \-]{6,12}[0-9]") + _OUT.format(score="0.9", test=f"{_FREE} AND length({_D}) BETWEEN 8 AND 13"),
    "ip_adress": _found(_IP) + _OUT.format(score="0.9", test=_IP_OK),
    "url": _found(_URL) + _URL_OUT,
    "icd10": _found(r"[A-Z][0-9]{2}(?:\.[0-9]{1,2}[A-Z]?)?") + _OUT.format(score="0.85", test=_FREE),
    "lagenhet": _found(r"(?i:\blgh\.?\s*[0-9]{1,4}\b)") + _OUT.format(score="0.9", test="true"),
    "gatuadress": _found(
        r"(?:(?:Norra|Södra|Östra|Västra|Gamla|Nya|Lilla|Stora|Övre|Nedre) )?\p{Lu}\p{Ll}*(?:gatan|gata|vägen|väg|gränden|gränd|stigen|stig|torget|torg|allén|allé|backen|plan)\s+[0-9]{1,4}(?:\s?[A-Za-z]\b)?"
    )
    + _OUT.format(score="0.85", test=r"NOT regexp_matches(b, '[\p{L}\p{N}]')"),
    "skolnamn": _found(r"\p{Lu}\p{Ll}+(?:gymnasieskolan|grundskolan|gymnasiet|förskolan|särskolan|friskolan|skolan)s?") + _OUT.format(score="0.8", test=_FREE),
}
_CATEGORY = {"icd10": "diagnos", "lagenhet": "plats", "gatuadress": "plats", "skolnamn": "plats"}


def _listed(x: TermList) -> str:
    """A list's spans: one alternation of its terms, longest first."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = {t.translate(str.maketrans(upper, lower)) if x.ignore_case else t for t in x.terms()}
    pattern = "(?:" + "|".join(t.replace(".", r"\.").replace("+", r"\+") for t in sorted(terms, key=lambda t: (-len(t), t))) + ")"
    source = f"SELECT doc_id, translate(text, '{upper}', '{lower}') AS text, text AS whole FROM ({_TEXTS})" if x.ignore_case else f"SELECT doc_id, text, text AS whole FROM ({_TEXTS})"
    found = _found(pattern, source).replace("SELECT doc_id, text, string_split", "SELECT doc_id, text, whole, string_split").replace("SELECT doc_id, text, unnest", "SELECT doc_id, text, whole, unnest").replace("SELECT doc_id, text, span_start,", "SELECT doc_id, text, whole, span_start,")
    return found + f" SELECT doc_id, span_start, span_end, substr(whole, span_start + 1, span_end - span_start) AS text, {x.score}::DOUBLE AS score FROM m WHERE {_FREE}"


def _lists(category: str) -> str:
    return " UNION ".join(f"SELECT * FROM ({_listed(x)})" for x in TERM_LISTS if x.category == category)


_CANDIDATES = " UNION ALL ".join(
    [f"SELECT doc_id, span_start AS s, span_end AS e, text AS m, '{_CATEGORY.get(n, n)}' AS category, 'rule' AS source, 4 AS p, {i} AS det FROM ({q})" for i, (n, q) in enumerate(_RULE_SQL.items(), 1)]
    + [f"SELECT DISTINCT doc_id, span_start, span_end, text, '{c}', 'dictionary', 3, {d} FROM ({_lists(c)})" for c, d in (("diagnos", 20), ("medicin", 21), ("person", 22), ("plats", 23))]
)
_LABEL = "CASE category " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in LABELS.items()) + " END"

#: d (texts), k (kept spans with span_id): by priority, bytes, start and detector, each span that overlaps no kept one.
_KEPT = f"""
WITH RECURSIVE d AS (
  {_TEXTS}
), c AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, strlen(m) DESC, s, det) AS n FROM ({_CANDIDATES})
), r AS (
  SELECT DISTINCT doc_id, 0::BIGINT AS n, []::STRUCT(s INT, e INT)[] AS held, false AS fits FROM c
  UNION ALL
  SELECT doc_id, n, CASE WHEN fits THEN list_append(held, struct_pack(s := s, e := e)) ELSE held END, fits
  FROM (SELECT r.doc_id, c.n, c.s, c.e, held, len(list_filter(held, lambda x: x.s < c.e AND c.s < x.e)) = 0 AS fits FROM r JOIN c ON r.doc_id = c.doc_id AND c.n = r.n + 1)
), k AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS span_id, s, e, m, category, source FROM r JOIN c USING (doc_id, n) WHERE fits
)"""


def _named(source: str, name: str = "q", start: str = "s", before: str = "") -> str:
    """CTE q: spans of `source` with their replacements."""
    return before + f""", {name}0 AS (
  SELECT *, min({start}) OVER (PARTITION BY doc_id, category, lower(trim(regexp_replace(m, '\\s+', ' ', 'g')))) AS f0 FROM {source}
), {name} AS (
  SELECT *, {_LABEL} || ' ' || dense_rank() OVER (PARTITION BY doc_id, category ORDER BY f0) AS replacement FROM {name}0
)"""


def _spliced(texts: str, spans: str, keys: str = "doc_id") -> str:
    """Rows (keys, masked_text, n_spans) of texts (keys, text) with spans (keys, s, e, replacement)."""
    return f"""
SELECT {keys}, CASE WHEN n IS NULL THEN text ELSE front || substr(text, y + 1) END AS masked_text, coalesce(n, 0)::INT AS n_spans FROM {texts} LEFT JOIN (
  SELECT {keys}, string_agg(substr(text, before + 1, s - before) || replacement, '' ORDER BY s) AS front, max(e) AS y, count(*) AS n
  FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY {keys} ORDER BY s), 0) AS before FROM {spans}) JOIN {texts} USING ({keys}) GROUP BY {keys}
) USING ({keys})"""


_PARAS = """, l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL
), o AS (
  SELECT *, (sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(text) - 1)::INT AS p_start FROM l
), paras AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS para, text, p_start, p_start + length(text)::INT AS p_end FROM o WHERE text <> ''
), ins AS (
  SELECT k.doc_id, para, s - p_start AS s, e - p_start AS e, m, category, s AS s0 FROM k JOIN paras ON k.doc_id = paras.doc_id AND s >= p_start AND e <= p_end
), q0 AS (
  SELECT *, min(s0) OVER (PARTITION BY doc_id, category, lower(trim(regexp_replace(m, '\\s+', ' ', 'g')))) AS f0 FROM ins
), q AS (
  SELECT *, {label} || ' ' || dense_rank() OVER (PARTITION BY doc_id, category ORDER BY f0) AS replacement FROM q0
)""".replace("{label}", _LABEL)
_MEETINGS = "SELECT conv_id AS doc_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id"
_SEGMENTS = """, o AS (
  SELECT conv_id AS doc_id, coalesce(text, '') AS text, (row_number() OVER w - 1)::INT AS para, (sum(length(coalesce(text, '')) + 1) OVER w - length(coalesce(text, '')) - 1)::INT AS p_start
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), paras AS (
  SELECT *, p_start + length(text)::INT AS p_end FROM o
), ins AS (
  SELECT k.doc_id, para, s - p_start AS s, e - p_start AS e, m, category, s AS s0 FROM k JOIN paras ON k.doc_id = paras.doc_id AND s >= p_start AND e <= p_end
)"""
_SPACE = r"[\t\n\v\f\r \x{85}\p{Z}]"
_WORDY = r"[^\t\n\v\f\r \x{85}\p{Z}]"

ORACLE_SQL: dict[str, str] = {
    **{f"pii_{n}_spans": q for n, q in _RULE_SQL.items()},
    "pii_url_spans": _found(_URL, "SELECT page_id AS doc_id, html AS text FROM pages") + _URL_OUT,
    "pii_diagnosis_spans": _lists("diagnos"),
    "pii_medicine_spans": _lists("medicin"),
    "pii_listed_name_spans": _lists("person"),
    "pii_place_spans": _lists("plats"),
    "pii_candidates": f"SELECT category, source, count(*) AS n, sum(s)::BIGINT AS starts FROM ({_CANDIDATES}) GROUP BY ALL",
    **dict.fromkeys(("pii_resolved", "pii_resolved_by_shuffle"), _KEPT + " SELECT doc_id, span_id, s AS span_start, e AS span_end, m AS text, category, source FROM k"),
    "pii_counts": _KEPT + f" SELECT doc_id, {_LABEL} AS label, count(*) AS n FROM k GROUP BY ALL",
    "pii_category_counts": _KEPT + " SELECT category, count(*) AS n FROM k GROUP BY ALL",
    "pii_active": _KEPT + " SELECT doc_id, span_id, category FROM k WHERE span_id > 0 AND category IN ('person', 'epost')",
    "pii_pseudonyms": _KEPT + _named("k") + " SELECT doc_id, span_id, m AS text, replacement FROM q",
    "pii_audit": _KEPT + _named("k") + " SELECT doc_id, s AS span_start, e AS span_end, m AS original, replacement, category, source FROM q",
    "pii_masked_text": _KEPT + _named("k") + _spliced("d", "q"),
    "pii_rejected_filter": _KEPT + ", h AS (SELECT * FROM k WHERE span_id > 0)" + _named("h") + " SELECT doc_id, span_id, replacement FROM q",
    "pii_segments_masked": _KEPT.replace(_TEXTS, _MEETINGS)
    + _named("ins", "q", "s0", _SEGMENTS)
    + f", v AS ({_spliced('paras', 'q', 'doc_id, para')}) SELECT doc_id, para, masked_text, n_spans FROM v",
    "pii_manual_mask": _KEPT
    + """, h AS (
  SELECT doc_id, s, e, category, source FROM k ANTI JOIN (SELECT doc_id FROM d WHERE length(text) >= 12) USING (doc_id)
  UNION ALL SELECT doc_id, s, e, category, source FROM k WHERE NOT (s < 12 AND 4 < e) AND doc_id IN (SELECT doc_id FROM d WHERE length(text) >= 12)
  UNION ALL SELECT doc_id, 4, 12, 'egen', 'manual' FROM d WHERE length(text) >= 12
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS span_id, s AS span_start, e AS span_end, category, source FROM h""",
    "pii_paragraph_masked": _KEPT
    + _PARAS
    + f""", v AS ({_spliced("paras", "q", "doc_id, para")}), lost AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM k ANTI JOIN ins ON k.doc_id = ins.doc_id AND k.s = ins.s0 GROUP BY doc_id
)
SELECT doc_id, para, masked_text, n_spans, coalesce(lost.n, 0) AS dropped_cross_para FROM v LEFT JOIN lost USING (doc_id)""",
    "pii_render_segments": _KEPT
    + f""", g AS (
  SELECT d.doc_id, text, coalesce(lag(e) OVER w, 0) AS s, x.s AS e FROM d JOIN (SELECT doc_id, s, e FROM k UNION ALL SELECT doc_id, length(text)::INT, NULL FROM d WHERE text IS NOT NULL) x ON d.doc_id = x.doc_id
  WINDOW w AS (PARTITION BY d.doc_id ORDER BY x.s, x.e NULLS LAST)
), t AS (
  SELECT doc_id, s, unnest(regexp_extract_all(substr(text, s + 1, e - s), '{_SPACE}+|{_WORDY}+')) AS text, generate_subscripts(regexp_extract_all(substr(text, s + 1, e - s), '{_SPACE}+|{_WORDY}+'), 1) AS i FROM g WHERE e > s
), y AS (
  SELECT doc_id, text, (s + sum(length(text)) OVER (PARTITION BY doc_id, s ORDER BY i))::INT AS seg_end FROM t
)
SELECT doc_id, (seg_end - length(text))::INT AS seg_start, seg_end, text, NULL::INT AS span_id, regexp_matches(text, '^{_WORDY}') AS word FROM y
UNION ALL SELECT doc_id, s, e, m, span_id, true FROM k""",
    "pii_masked_mail_ip": f"""
WITH s AS (
  SELECT * FROM ({_found(_MAIL, _PLAIN)} SELECT doc_id, span_start AS x, span_end AS y, m, 'E-post' AS label FROM m)
  UNION ALL SELECT * FROM ({_found(_IP, _PLAIN)} SELECT doc_id, span_start, span_end, m, 'IP-adress' FROM m WHERE {_IP_OK})
), f AS (
  SELECT *, min(x) OVER (PARTITION BY doc_id, label, lower(m)) AS f0, coalesce(lag(y) OVER (PARTITION BY doc_id ORDER BY x), 0) AS before FROM s
), r AS (
  SELECT *, label || ' ' || dense_rank() OVER (PARTITION BY doc_id, label ORDER BY f0) AS new FROM f
), g AS (
  SELECT doc_id, string_agg(substr(text, before + 1, x - before) || new, '' ORDER BY x) AS front, max(y) AS y, count(*) AS n FROM r JOIN documents USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN g.n IS NULL THEN d.text ELSE front || substr(d.text, g.y + 1) END AS masked_text, coalesce(g.n, 0)::INT AS n_spans FROM documents d LEFT JOIN g USING (doc_id)""",
    "signal_levels": _SIGNALS
    + " SELECT user_id, round(CASE WHEN len(a) > 0 THEN sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)) ELSE 0 END, 6) AS rms, round(coalesce(list_max(list_transform(a, lambda x: abs(x))), 0), 6) AS peak FROM s",
    "signal_mix": _SIGNALS
    + """ SELECT user_id, greatest(len(a), len(b))::BIGINT AS n,
  round(coalesce(list_sum(list_transform(range(1, greatest(len(a), len(b))::BIGINT + 1), lambda i: greatest(-1.0, least(1.0, coalesce(a[i], 0) + coalesce(b[i], 0))))), 0), 6) AS total FROM s""",
    "json_salvage": "SELECT n_nationkey AS doc_id, unnest([n_name, 'Lund']) AS proposal FROM nation",
    "action_lines": "SELECT r_regionkey AS doc_id, unnest([1, 2, 4])::INT AS ord, unnest(['Ring ' || r_name, 'Skriv till ' || r_name, 'Klart']) AS action FROM region",
    "gazetteer_clean": "SELECT DISTINCT 'Anna-' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS term FROM customer WHERE c_custkey >= 500",
    "gazetteer_localities": """
WITH p AS (
  SELECT unnest([n_name, 'By' || n_nationkey]) AS term FROM nation WHERE n_nationkey * 1000 >= 5000
)
SELECT DISTINCT term FROM p WHERE term NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 3 = 0) AND term <> 'By7'""",
    "text_corrections": r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)\bthe\b', 'DE', 'g'), '(?i)\bof\b', 'AV', 'g')) AS text_md5 FROM documents",
    "pii_name_spans": _found("(?:Ann-Britt|Anna Berg|Stein|Anna|Chen|Erik|Leon|Sten|Ann)") + f" SELECT doc_id, span_start, span_end, m AS text FROM m WHERE {_FREE}",
    "pii_name_spans_by_token": _found("(?:Ann-Britt|Anna Berg|Stein|Anna|Chen|Erik|Leon|Sten|Ann)") + f" SELECT doc_id, span_start, span_end, m AS text FROM m WHERE {_FREE}",
    "transcript_text": _U
    + """ SELECT meeting_id, string_agg(CASE WHEN before IS DISTINCT FROM speaker THEN (CASE WHEN n > 1 THEN chr(10) ELSE '' END) || name || ': ' || text ELSE text END, chr(10) ORDER BY idx) AS transcript FROM u GROUP BY meeting_id""",
    "transcript_timed": _U
    + """, s AS (SELECT *, round("start")::BIGINT AS sec FROM u)
SELECT meeting_id, string_agg('[' || CASE WHEN sec >= 3600 THEN printf('%d:%02d:%02d', sec // 3600, (sec // 60) % 60, sec % 60) ELSE printf('%02d:%02d', sec // 60, sec % 60) END || '] ' ||
  CASE WHEN before IS DISTINCT FROM speaker THEN name || ': ' ELSE '' END || text || chr(10), '' ORDER BY idx) AS transcript FROM s GROUP BY meeting_id""",
    "transcript_srt": _U
    + f""" SELECT meeting_id, string_agg(n || chr(10) || {_stamp('"start"', ",")} || ' --> ' || {_stamp('"end"', ",")} || chr(10) || name || ': ' || text || chr(10) || chr(10), '' ORDER BY idx) AS srt FROM u GROUP BY meeting_id""",
    "transcript_vtt": _U
    + f""" SELECT meeting_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_stamp('"start"', ".")} || ' --> ' || {_stamp('"end"', ".")} || chr(10) || name || ': ' || text || chr(10) || chr(10), '' ORDER BY idx) AS vtt FROM u GROUP BY meeting_id""",
    "transcript_speaker_groups": _U + """ SELECT meeting_id, idx, speaker, (sum(CASE WHEN n > 1 AND before IS DISTINCT FROM speaker THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY idx))::BIGINT AS grp FROM u""",
    "speakers_in_order": _U + """ SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY i) - 1 AS ord, speaker FROM (SELECT meeting_id, speaker, min(idx) AS i FROM u WHERE speaker IS NOT NULL GROUP BY ALL)""",
    "align_dominant_speaker": _TURNS + " SELECT meeting_id, idx, cluster FROM g",
    "align_relabel": _TURNS
    + """, q AS (SELECT *, CASE WHEN cluster IS NOT NULL THEN min(idx) OVER (PARTITION BY meeting_id, cluster) END AS f FROM g)
SELECT meeting_id, idx, CASE WHEN f IS NOT NULL THEN 'TALARE_' || dense_rank() OVER (PARTITION BY meeting_id ORDER BY f NULLS LAST) END AS speaker FROM q""",
    "align_merge_timeline": _SOURCES + """ SELECT meeting_id, idx, speaker, round("start", 3) AS "start" FROM l""",
    "align_drop_echo": _SOURCES
    + r""", v AS (
  SELECT *, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS tok FROM l
)
SELECT meeting_id, idx, speaker FROM v AS x WHERE NOT (speaker = 'Jag' AND len(tok) >= 4 AND EXISTS (
  SELECT 1 FROM v AS y WHERE y.speaker = 'Mötet' AND y.meeting_id = x.meeting_id AND x."start" < y."end" + 3 AND y."start" < x."end" + 3
  AND len(list_filter(x.tok, lambda t: list_contains(y.tok, t))) / len(x.tok) >= 0.7))""",
    "align_active_utterance": _U
    + """, t AS (SELECT DISTINCT meeting_id, unnest(range(0, 13)) * 6.25::DOUBLE AS t FROM u)
SELECT t.meeting_id, t.t, coalesce((SELECT min(u.idx) FROM u WHERE u.meeting_id = t.meeting_id AND u."start" <= t.t AND t.t < u."end"), -1) AS active FROM t""",
    "jobs_listing": _JOBS
    + """ SELECT j.id, any_value(j.title) AS title, any_value(j.category) AS category, any_value(j.updated_at) AS updated_at, count(a.idx) AS n_actions, count(a.idx) FILTER (a.done) AS n_done, any_value(trim(j.notes) <> '') AS has_notes
FROM j LEFT JOIN a ON j.id = a.id GROUP BY j.id""",
    "jobs_recent_topk": _JOBS + " SELECT id, updated_at FROM j ORDER BY updated_at DESC, id LIMIT 6",
    "jobs_search": _JOBS + " SELECT id FROM j WHERE contains(lower(title), 'urgent') OR contains(lower(category), 'urgent') OR contains(lower(summary), 'urgent') OR contains(lower(notes), 'urgent')",
    "jobs_move_folder": _JOBS + " SELECT id, CASE WHEN category LIKE 'ASIA/%' THEN 'Arkiv/' || category ELSE category END AS category FROM j",
    "jobs_upsert_category": _JOBS + " SELECT id, CASE WHEN id % 10 = 0 THEN title || ' v2' ELSE title END AS title, CASE WHEN id % 10 = 0 AND id % 20 <> 0 THEN 'Ny' ELSE category END AS category FROM j",
    "actions_union": _JOBS + " SELECT job_id, idx, project, text, done, assignee, due FROM x",
    "actions_due_state": _JOBS + " SELECT state, count(*) AS n FROM y GROUP BY state",
    "actions_counts": _JOBS + " SELECT count(*) FILTER (NOT done) AS n_open, count(*) FILTER (NOT done AND state = 'overdue') AS n_overdue, count(*) FILTER (done) AS n_done, count(*) AS n_total FROM y",
    "actions_filtered": _JOBS + " SELECT job_id, idx, assignee, due FROM y WHERE NOT done AND category LIKE 'EUROPE/%' AND state IN ('today', 'soon')",
    "actions_grouped": _JOBS
    + " SELECT coalesce(nullif(trim(assignee), ''), 'Utan ansvarig') AS grp, row_number() OVER (PARTITION BY coalesce(nullif(trim(assignee), ''), 'Utan ansvarig') ORDER BY job_id NULLS FIRST, idx, text) - 1 AS nth, text FROM x",
    "folder_ancestors": _JOBS + " SELECT DISTINCT folder FROM w",
    "folder_counts": _JOBS + " SELECT folder, count(*) AS n, sum(size)::BIGINT AS bytes FROM w GROUP BY folder",
    "folder_has_children": _JOBS
    + ", o AS (SELECT DISTINCT folder FROM w) SELECT folder, len(string_split(folder, '/'))::BIGINT AS depth, EXISTS (SELECT 1 FROM o AS c WHERE starts_with(c.folder, o.folder || '/')) AS has_children FROM o",
    "folder_pending_diff": _JOBS + " SELECT * FROM (VALUES ('ASIA'), ('ASIA/JAPAN'), ('Tom'), ('Ny mapp')) v(folder) WHERE folder NOT IN (SELECT folder FROM w)",
}
