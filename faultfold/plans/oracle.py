"""The registered queries again, as SQL over the same tables.

Written from the meaning of each query, not from its Spark plan: where Spark counts with running
totals or compares only rare words, the SQL joins and compares everything.
"""

from __future__ import annotations

from faultfold.functions import text
from faultfold.functions.prompts import DENY_RULES, EMPTY, TOO_LONG
from faultfold.operators.analysis import RULES, UNKNOWN_ADVICE, UNKNOWN_CAUSE
from faultfold.operators.limits import MAX_BYTES, MAX_ENTRIES, TOO_LARGE, TOO_MANY
from faultfold.plans.catalog import KEYWORDS, PROMPT_TEMPLATES
from faultfold.plans.hooks import ERRORS

CUTOFF = "TIMESTAMP '2024-01-16 00:00:00'"
PENDING_SINCE = "TIMESTAMP '2024-01-15 00:00:00'"
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
SELECT_START = "TIMESTAMP '2024-01-05 00:00:00'"
SELECT_END = "TIMESTAMP '2024-01-25 00:00:00'"


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sub(subject: str, pattern: str, replacement: str, flags: str = "g") -> str:
    return f"regexp_replace({subject}, {quote(pattern)}, {quote(replacement)}, '{flags}')"


def fold(subject: str) -> str:
    return f"trim({sub(subject, '[' + text.SPACE_CLASS + ']+', ' ')}, ' ')"


def jwt(subject: str) -> str:
    return sub(subject, text.JWT_PATTERN, text.JWT_MASK)


def email(subject: str) -> str:
    return sub(subject, text.EMAIL_PATTERN, text.EMAIL_MASK)


def card(subject: str) -> str:
    return sub(subject, text.CARD_PATTERN, text.CARD_MASK)


def checked_card(subject: str) -> str:
    """Matches whose check digit is right are masked; digits are counted from the right."""
    found = f"regexp_extract_all({subject}, {quote(text.CARD_PATTERN)})"
    digits = "reverse(regexp_replace(m, '[ -]', '', 'g'))"
    digit = f"CAST(substr({digits}, i, 1) AS INTEGER) * (2 - i % 2)"
    total = f"list_sum([({digit}) - CASE WHEN {digit} > 9 THEN 9 ELSE 0 END FOR i IN range(1, length({digits}) + 1)])"
    shown = f"[CASE WHEN {total} % 10 = 0 THEN {quote(text.CARD_MASK)} ELSE m END FOR m IN {found}]"
    rest = f"string_split_regex({subject}, {quote(text.CARD_PATTERN)})"
    return f"array_to_string([x[1] || coalesce(x[2], '') FOR x IN list_zip({rest}, {shown})], '')"


def secret(subject: str) -> str:
    gap = f'["{text.SPACE_CLASS}]*'
    pattern = f"(?i)({text.SECRET_KEYS}{gap})([:=]){gap}{text.SECRET_VALUE}"
    marked = f"regexp_replace({subject}, {quote(pattern)}, chr(1)||'\\1'||chr(2)||'\\2'||chr(3), 'g')"
    colon = sub(marked, r"\x01([^\x02]*)\x02:\x03", rf'\1: "{text.SECRET_MASK}"')
    return sub(colon, r"\x01[^\x02]*\x02=\x03", text.SECRET_MASK)


def redact(subject: str) -> str:
    return secret(card(email(jwt(subject))))


def greedy(source: str, most: int = 500, room: int = 19999) -> str:
    """``packed``: the rows of ``source`` with the batch that a pass in order puts them into, a step per batch."""
    return f"""
placed AS (SELECT *, row_number() OVER own AS place, sum(bytes + 1) OVER own AS upto FROM {source}
  WINDOW own AS (PARTITION BY service_name ORDER BY ts, insert_id ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT a.service_name, a.place, a.place + greatest(1, least({most}, (SELECT count(*) FROM placed b
    WHERE b.service_name IS NOT DISTINCT FROM a.service_name AND b.place >= a.place AND b.place < a.place + {most}
      AND b.upto <= a.upto - a.bytes - 1 + {room}))) AS following FROM placed a),
begins AS (
  SELECT service_name, CAST(1 AS BIGINT) AS place, CAST(0 AS BIGINT) AS batch_no FROM placed WHERE place = 1
  UNION ALL
  SELECT e.service_name, CAST(e.following AS BIGINT), s.batch_no + 1 FROM begins s JOIN ends e
    ON e.service_name = s.service_name AND e.place = s.place
  WHERE e.following <= (SELECT count(*) FROM placed p WHERE p.service_name = e.service_name)),
packed AS (SELECT p.*, (SELECT max(s.batch_no) FROM begins s
    WHERE s.service_name = p.service_name AND s.place <= p.place) AS batch_no FROM placed p)"""


ISO = "'%Y-%m-%dT%H:%M:%S.%fZ'"

LOGS = f"""
base AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS insert_id, ts, event_type, value, user_id,
    'projects/demo/logs/' || event_type AS log_name,
    CASE event_type
      WHEN 'error' THEN CASE WHEN value >= 100 THEN 'CRITICAL' ELSE 'ERROR' END
      WHEN 'signup' THEN 'WARNING' WHEN 'purchase' THEN 'NOTICE'
      WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'DEBUG' END AS severity,
    'svc-' || (user_id % 8) AS service_name, 'zone-' || (user_id % 3) AS location,
    CAST(json_extract(props, '$.k') AS INTEGER) AS k
  FROM events),
logs AS (
  SELECT *, CASE event_id % 4
      WHEN 0 THEN 'Record write failed  code ' || (k % 5)
      WHEN 1 THEN 'Email user' || user_id || '@example.com' || chr(10) || 'already exists'
      WHEN 2 THEN 'auth token: k' || lpad(CAST(user_id AS VARCHAR), 19, '0') || ' rejected'
      ELSE 'Upstream timeout, card ' || (4000000000000000 + user_id) END AS message
  FROM base),
clean AS (SELECT * REPLACE ({redact(fold('message'))} AS message) FROM logs)"""

SIGNED = f"""{LOGS},
labelled AS (
  SELECT *, md5('{{"location":"' || location || '","service_name":"' || service_name || '"}}|'
    || severity || '|' || message) AS signature FROM clean),
signed AS (
  SELECT insert_id, ts, severity, service_name, message AS log_message, signature
  FROM labelled WHERE severity IN ('ERROR', 'CRITICAL') AND service_name <> 'log-triage')"""


def rollup_of(source: str, keys: str = "signature") -> str:
    return f"""
  SELECT {keys}, min(severity) AS severity, min(service_name) AS service_name,
    min(log_message) AS log_message, count(*) AS incident_count, min(ts) AS first_seen,
    max(ts) AS last_seen,
    min({{'a': ts, 'b': insert_id}}).b AS first_insert_id,
    max({{'a': ts, 'b': insert_id}}).b AS last_insert_id
  FROM {source} GROUP BY {keys}"""


def _topic(column: int, otherwise: str) -> str:
    cases = " ".join(
        f"WHEN contains(lower(log_message), {quote(rule[1])}) THEN {quote(rule[column])}"
        for rule in RULES
    )
    return f"CASE {cases} ELSE {quote(otherwise)} END"


def _plan() -> str:
    def steps(actions):
        return "[" + ", ".join(
            f"{{'step': {i + 1}, 'action': {quote(a)}, "
            f"'warning': {quote('Watch the error rate' if i else '')}}}"
            for i, a in enumerate(actions)
        ) + "]"

    cases = " ".join(
        f"WHEN contains(lower(log_message), {quote(rule[1])}) THEN {steps(rule[5])}" for rule in RULES
    )
    return f"CASE {cases} ELSE [] END"


def analysed(source: str) -> str:
    return f"""
  SELECT *, severity || ' in ' || service_name || ' - ' || log_message AS operational_summary,
    CASE WHEN severity = 'CRITICAL' THEN 'CRITICAL' ELSE {_topic(2, 'LOW')} END AS business_impact,
    {_topic(3, UNKNOWN_CAUSE)} AS root_cause, {_topic(4, UNKNOWN_ADVICE)} AS ai_suggestion,
    strftime(first_seen, {ISO}) AS first_seen_timestamp,
    strftime(last_seen, {ISO}) AS last_seen_timestamp, {_plan()} AS action_plan
  FROM {source}"""


def reports_of(source: str) -> str:
    return f"""
  SELECT md5(signature || '|' || first_insert_id) AS id, *, first_seen AS created_at FROM ({analysed(source)})"""


REPORTS = f"""{SIGNED},
rolled AS ({rollup_of('signed')}),
reports AS ({reports_of('rolled')})"""

WORN = f"""{REPORTS},
marked AS (SELECT *, signature[1:1] AS mark, incident_count AS n FROM reports),
worn AS (
  SELECT * REPLACE (
    CASE WHEN n % 5 = 0 THEN ' ' || lower(business_impact) || ' impact '
      WHEN n % 5 = 1 THEN 'not assessed' ELSE business_impact END AS business_impact,
    CASE mark WHEN 'f' THEN NULL WHEN 'e' THEN '' ELSE service_name END AS service_name,
    CASE WHEN n % 7 = 0 THEN NULL WHEN n % 11 = 0 THEN 0 ELSE n END AS incident_count,
    CASE mark WHEN 'd' THEN lower(severity) WHEN 'c' THEN '' ELSE severity END AS severity,
    CASE mark WHEN '0' THEN '' WHEN '1' THEN 'yesterday' ELSE last_seen_timestamp END
      AS last_seen_timestamp,
    CASE mark WHEN 'b' THEN [] ELSE action_plan END AS action_plan)
  FROM marked)"""


def impact(subject: str) -> str:
    cases = " ".join(
        f"WHEN contains(upper({subject}), '{level}') THEN '{level}'"
        for level in ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    )
    return f"CASE {cases} ELSE 'UNKNOWN' END"


COUNT_OR_ONE = "CASE WHEN incident_count IS NULL OR incident_count = 0 THEN 1 ELSE incident_count END"

HISTORY = f"""{SIGNED},
history AS (SELECT * FROM signed WHERE ts < {CUTOFF}),
fresh AS (SELECT * FROM signed WHERE ts >= {CUTOFF}),
past AS ({rollup_of('history')}),
store AS (
  SELECT signature, incident_count AS n, first_seen, last_seen, log_message, severity,
    CASE WHEN first_seen < {PENDING_SINCE} THEN md5(signature || '|' || first_insert_id) END AS report_id
  FROM past)"""

FOLLOW = f"""{HISTORY},
stored AS ({reports_of('past')}),
counted AS ({rollup_of('fresh')}),
followed AS (
  SELECT s.id, s.signature, s.incident_count + coalesce(c.incident_count, 0) AS incident_count,
    coalesce(strftime(c.last_seen, {ISO}), s.last_seen_timestamp) AS last_seen_timestamp,
    coalesce(c.last_insert_id, s.last_insert_id) AS last_insert_id
  FROM stored s LEFT JOIN counted c USING (signature))"""

LEDGER = f"""{SIGNED},
writes AS (
  SELECT insert_id, CASE WHEN severity = 'CRITICAL' THEN 'FAILED' ELSE 'COMPLETED' END AS status,
    ts AS processed_timestamp FROM signed
  UNION ALL
  SELECT insert_id, 'COMPLETED', ts + INTERVAL 1 MINUTE FROM signed WHERE hour(ts) < 12)"""

INCIDENTS = f"""{REPORTS},
hourly AS (SELECT *, date_trunc('hour', ts) AS hour FROM signed),
batched AS ({rollup_of('hourly', 'signature, hour')}),
incidents AS (
  SELECT md5(signature || '|' || strftime(hour, '%Y-%m-%d %H')) AS incident_id, *,
    first_seen AS as_of FROM ({analysed('batched')}))"""

_WORDS = (
    "list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(operational_summary || ' ' "
    "|| root_cause || ' ' || service_name || ' ' || business_impact), '[^a-z0-9]+', ' ', 'g'), ' '), "
    "lambda x: x <> '')))"
)

_CANDIDATE = """r.severity = i.severity AND r.service_name IS NOT DISTINCT FROM i.service_name
    AND r.created_at >= i.as_of - INTERVAL 2 HOUR AND r.created_at < i.as_of"""

SCORES = f"""{INCIDENTS},
new_words AS (SELECT *, {_WORDS} AS words FROM incidents),
old_words AS (SELECT *, {_WORDS} AS words FROM reports),
compared AS (
  SELECT i.incident_id, r.words AS content, r.id, r.created_at,
    CAST(len(list_intersect(i.words, r.words)) AS DOUBLE)
      / len(list_distinct(list_concat(i.words, r.words))) AS score
  FROM new_words i JOIN old_words r ON {_CANDIDATE}),
scores AS (
  SELECT incident_id, score, max({{'a': created_at, 'b': id}}) AS newest
  FROM compared WHERE score >= 0.6 GROUP BY incident_id, content, score),
best AS (
  SELECT incident_id, max({{'s': score, 'a': newest.a, 'b': newest.b}}) AS top
  FROM scores GROUP BY incident_id)"""


def sized(row: str) -> str:
    """Bytes of a JSON text when everything outside printable ASCII is escaped."""
    json_text = f"CAST(to_json({row}) AS VARCHAR)"
    parts = [("\\x{80}-\\x{7ff}", 4), ("\\x{800}-\\x{ffff}", 3), ("\\x{10000}-\\x{10ffff}", 8), ("\\x7f", 5)]
    extra = " + ".join(
        f"{more} * length({sub(json_text, '[^' + chars + ']', '')})" for chars, more in parts
    )
    return f"(strlen({json_text}) + {extra})"


SIZED = f"""{LOGS},
sized AS (
  SELECT insert_id, ts, service_name,
    {sized("{'severity': severity, 'service_name': service_name, 'message': message}")} AS bytes
  FROM clean)"""


def _list(where: str) -> str:
    return f"WITH {LOGS} SELECT insert_id, log_name, ts, severity FROM logs WHERE {where}"


def _keywords() -> str:
    return "(" + " OR ".join(f"contains(lower(message), {quote(k.lower())})" for k in KEYWORDS) + ")"


_SUMMARY = "id, severity, service_name, business_impact, incident_count, created_at"


def _report_query(source: str, what: str, where: str = "TRUE") -> str:
    views = {"reports": REPORTS, "worn": WORN}[source]
    return f"WITH {views} SELECT {what} FROM {source} WHERE {where}"


def _documents(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS text FROM documents"


_TOKEN = "('Bearer eyJhbGciOiJIUzI1NiJ9.doc' || doc_id || '.s-_~ig ' || text)"
_NOTED = "{'doc_id': doc_id, 'text': text, 'note': NULL}"
_SECRET = (
    "('api_key: \"' || lpad(CAST(doc_id AS VARCHAR), 16, 'k') || '\" password=' "
    "|| lpad(CAST(doc_id AS VARCHAR), 16, 'k') || ':' || lpad(CAST(doc_id AS VARCHAR), 16, 'k') "
    "|| chr(10) || 'auth = ' || lpad(CAST(doc_id AS VARCHAR), 70, 'z') || chr(10) || text)"
)


def _shown(subject: str) -> str:
    return (
        f"coalesce(CASE WHEN regexp_matches({subject}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN "
        f"strftime(CAST(try_cast(replace(replace({subject}, 'T', ' '), 'Z', '') AS TIMESTAMP) AS TIMESTAMP), "
        f"'%Y-%m-%d %H:%M:%S') END, nullif({subject}, ''), '—')"
    )


def _prompt_rules() -> str:
    templates = ", ".join(quote(t) for t in PROMPT_TEMPLATES)
    space = text.SPACE_CLASS
    stripped = sub("prompt", f"^[{space}]+|[{space}]+$", "")
    rules = [("too_long", "length(prompt) > 200", TOO_LONG), ("empty", f"{stripped} = ''", EMPTY)]
    for name, pattern, across, reason in DENY_RULES:
        flags = "is" if across else "i"
        rules.append((name, f"regexp_matches({stripped}, {quote(pattern)}, '{flags}')", reason))
    rule = " ".join(f"WHEN {hit} THEN '{name}'" for name, hit, _ in rules)
    reason = " ".join(f"WHEN '{name}' THEN {quote(why)}" for name, _, why in rules)
    return f"""
WITH prompts AS (
  SELECT conv_id, turn, 'message' AS kind, text AS prompt FROM conversations
  UNION ALL
  SELECT conv_id, turn, 'template',
    replace([{templates}][1 + (conv_id * 3 + turn) % {len(PROMPT_TEMPLATES)}], '%s', role)
  FROM conversations),
named AS (SELECT *, CASE {rule} END AS rule FROM prompts),
ruled AS (SELECT *, CASE rule {reason} END AS why FROM named)"""


_ENTRY = f"""('{{"insertId":"' || insert_id || '","logName":"' || log_name || '","timestamp":"'
  || strftime(ts, {ISO}) || '","receiveTimestamp":"' || strftime(ts, {ISO}) || '","severity":"' || severity
  || '","resource":{{"type":"cloud_run_revision","labels":{{"service_name":"' || service_name
  || '","location":"' || location || '"}}}},' || CASE WHEN event_id % 4 IN (0, 3)
  THEN '"jsonPayload":{{"error_code":' || k || ',"message":' || CAST(to_json(message) AS VARCHAR) || '}}'
  ELSE '"textPayload":' || CAST(to_json(message) AS VARCHAR) END || '}}')"""


def statements() -> dict[str, str]:
    q: dict[str, str] = {}

    q["log_select"] = _list(
        f"severity IN ('ERROR', 'CRITICAL', 'ALERT', 'EMERGENCY') AND event_type = 'error' "
        f"AND ts BETWEEN {SELECT_START} AND {SELECT_END} AND {_keywords()} "
        "ORDER BY ts DESC, insert_id LIMIT 100"
    )
    q["filter_log_name"] = _list("log_name = 'projects/demo/logs/signup'")
    q["filter_severity_floor"] = _list("severity IN ('WARNING', 'ERROR', 'CRITICAL')")
    q["filter_time_range"] = _list(f"ts >= {SELECT_START} AND ts <= {SELECT_END}")
    q["filter_keywords"] = _list(_keywords())
    q["export_filter"] = (
        f"WITH {LOGS} SELECT insert_id, severity, service_name FROM logs "
        "WHERE severity IN ('ERROR', 'CRITICAL') AND service_name <> 'svc-7'"
    )
    q["stream_ingest"] = q["export_filter"]
    q["service_of"] = f"WITH {LOGS} SELECT insert_id, service_name FROM logs"
    q["message_extract"] = f"WITH {LOGS} SELECT insert_id, message FROM logs"
    q["severity_rank"] = f"""WITH {LOGS}
SELECT event_id, CASE WHEN value < 5 THEN 0 ELSE coalesce(list_position(
  ['DEBUG', 'INFO', 'NOTICE', 'WARNING', 'ERROR', 'CRITICAL', 'ALERT', 'EMERGENCY'], severity), 0)
  END AS severity_rank FROM logs"""

    q["normalize_ws"] = _documents(fold("text"))
    q["redact_jwt"] = _documents(jwt(_TOKEN))
    q["redact_email"] = _documents(email("text"))
    q["redact_card"] = _documents(card("text"))
    q["redact_card_checked"] = _documents(checked_card("text"))
    q["redact_secret"] = _documents(secret(_SECRET))
    q["redact_documents"] = _documents(redact(fold("text")))
    q["payload_bytes"] = f"SELECT doc_id, {sized(_NOTED)} AS payload_bytes FROM documents"

    q["sanitize_logs"] = (
        f"WITH {LOGS} SELECT insert_id, ts, severity, 'cloud_run_revision' AS resource_type, "
        "service_name, message FROM clean"
    )
    q["signature"] = f"WITH {SIGNED} SELECT insert_id, signature FROM labelled"
    q["incident_rollup"] = f"WITH {SIGNED} {rollup_of('signed')}"
    q["claim_winners"] = f"""WITH {SIGNED}
SELECT signature, ts, insert_id, severity, service_name, log_message FROM signed
QUALIFY row_number() OVER (PARTITION BY signature ORDER BY ts, insert_id) = 1"""
    q["signature_running_count"] = f"""WITH {SIGNED}
SELECT insert_id, ts, signature, count(*) OVER (PARTITION BY signature ORDER BY ts, insert_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_count FROM signed"""
    q["incidents"] = f"""WITH {INCIDENTS}
SELECT incident_id, severity, service_name, operational_summary, business_impact, root_cause,
  ai_suggestion, first_seen_timestamp, last_seen_timestamp, incident_count,
  len(action_plan) AS plan_steps FROM incidents"""

    q["envelope_decode"] = (
        f"WITH {LOGS} SELECT insert_id, log_name, ts, severity, 'cloud_run_revision' AS resource_type, "
        "service_name, message FROM logs"
    )
    q["envelope_roundtrip"] = f"""WITH {LOGS}
SELECT 'm-' || insert_id AS message_id, strftime(ts, {ISO}) AS publish_time,
  strftime(ts, {ISO}) AS stamp, md5({_ENTRY}) AS data_md5 FROM logs"""
    q["dead_letter_split"] = f"""
WITH sent AS (SELECT *, CASE event_id % 7 WHEN 1 THEN 'bad_base64' WHEN 2 THEN 'bad_utf8'
    WHEN 3 THEN 'bad_json' WHEN 4 THEN 'not_an_object' WHEN 5 THEN 'missing_insert_id' END AS reason,
  CAST(1 + (event_id // 7) % 6 AS INTEGER) AS attempts FROM events)
SELECT CAST(event_id AS VARCHAR) AS delivery, reason, attempts,
  CASE WHEN attempts < 5 THEN 'retry' WHEN ts >= {AS_OF} - INTERVAL 7 DAY THEN 'dead_letter'
    ELSE 'expired' END AS route
FROM sent WHERE reason IS NOT NULL"""
    q["skip_non_objects"] = """
WITH sent AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '[' || props || ']'
    WHEN 1 THEN '"' || event_type || '"' WHEN 2 THEN CAST(event_id AS VARCHAR)
    WHEN 3 THEN CASE WHEN value < 20 THEN 'null' ELSE props END ELSE props END AS entry FROM events)
SELECT event_id, entry FROM sent WHERE json_type(entry) = 'OBJECT'"""

    q["ledger_status"] = f"""WITH {LEDGER}
SELECT insert_id, status, processed_timestamp FROM writes
QUALIFY row_number() OVER (PARTITION BY insert_id ORDER BY processed_timestamp DESC) = 1"""
    q["new_events"] = f"""WITH {LEDGER}
SELECT insert_id, ts, severity FROM signed WHERE insert_id NOT IN (
  SELECT insert_id FROM writes WHERE insert_id IN (SELECT insert_id FROM signed WHERE ts < {CUTOFF}))"""
    q["claim_outcome"] = f"""WITH {HISTORY},
numbered AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY ts, insert_id) AS k FROM fresh)
SELECT f.insert_id, f.signature,
  CASE WHEN s.signature IS NULL AND k = 1 THEN 'claimed' WHEN report_id IS NOT NULL THEN 'followed_ready'
    ELSE 'followed_pending' END AS outcome, report_id,
  CASE WHEN report_id IS NOT NULL THEN n + k ELSE coalesce(n, 1) END AS count
FROM numbered f LEFT JOIN store s USING (signature)"""
    q["signature_table"] = f"""WITH {HISTORY},
kept AS (SELECT * FROM store WHERE report_id IS NOT NULL),
counted AS ({rollup_of('fresh')})
SELECT signature, 'ready' AS status, coalesce(n, 0) + coalesce(incident_count, 0) AS count,
  least(k.first_seen, c.first_seen) AS created_at, greatest(k.last_seen, c.last_seen) AS updated_at,
  coalesce(k.log_message, c.log_message) AS log_message, coalesce(k.severity, c.severity) AS severity,
  coalesce(report_id, md5(signature || '|' || first_insert_id)) AS report_id
FROM kept k FULL JOIN counted c USING (signature)"""

    q["report_list"] = _report_query("worn", _SUMMARY)
    q["report_get"] = _report_query("reports", f"{_SUMMARY}, log_message",
                                    "TRUE ORDER BY created_at DESC, id LIMIT 1")
    q["report_filter_severity"] = _report_query("worn", _SUMMARY, "upper(severity) = 'ERROR'")
    q["report_filter_service"] = _report_query("worn", _SUMMARY, "service_name IS NULL")
    q["report_by_signature"] = _report_query(
        "reports", f"{_SUMMARY}, signature",
        "signature = (SELECT signature FROM rolled ORDER BY incident_count DESC, signature LIMIT 1)")
    q["report_lookback"] = _report_query(
        "reports", _SUMMARY, f"created_at >= {AS_OF} - INTERVAL 28 DAY")
    q["report_filter_impact"] = _report_query(
        "worn", _SUMMARY, f"{impact('business_impact')} = 'CRITICAL'")
    q["report_filter_all"] = _report_query(
        "worn",
        f"count(*) FILTER (WHERE upper(severity) = 'ERROR' AND {impact('business_impact')} = 'MEDIUM' "
        "AND service_name = 'svc-3') AS shown, count(*) AS total")
    q["report_follow"] = f"WITH {FOLLOW} SELECT * FROM followed"
    q["report_upsert"] = f"""WITH {FOLLOW} SELECT * FROM followed
UNION ALL
SELECT md5(signature || '|' || first_insert_id), signature, incident_count, strftime(last_seen, {ISO}),
  last_insert_id FROM counted WHERE signature NOT IN (SELECT signature FROM stored)"""
    q["report_export"] = _report_query(
        "reports",
        "id, CAST(to_json({'id': id, 'severity': severity, 'service_name': service_name, "
        f"'incident_count': incident_count, 'created_at': strftime(created_at, {ISO}), "
        "'action_plan': action_plan}) AS VARCHAR) AS document")

    q["report_kpis"] = _report_query(
        "worn",
        f"count(*) AS reports, CAST(sum({COUNT_OR_ONE}) AS DOUBLE) AS occurrences, "
        f"count(*) FILTER (WHERE {impact('business_impact')} = 'CRITICAL') AS critical, "
        f"count(*) FILTER (WHERE {impact('business_impact')} = 'HIGH') AS high, "
        "count(DISTINCT nullif(service_name, '')) AS services")
    q["impact_rollup"] = f"""WITH {WORN},
levels(ord, impact) AS (VALUES (1, 'CRITICAL'), (2, 'HIGH'), (3, 'MEDIUM'), (4, 'LOW'))
SELECT ord, l.impact, CAST(coalesce(sum(w), 0) AS DOUBLE) AS count FROM levels l LEFT JOIN
  (SELECT {impact('business_impact')} AS impact, {COUNT_OR_ONE} AS w FROM worn) USING (impact)
GROUP BY ord, l.impact"""
    q["service_list"] = _report_query("worn", "DISTINCT service_name", "service_name <> ''")
    q["report_table"] = f"""WITH {WORN}
SELECT id, {impact('business_impact')} AS impact, coalesce(nullif(severity, ''), '—') AS severity,
  coalesce(nullif(service_name, ''), '—') AS service, operational_summary AS summary,
  coalesce(incident_count, 1) AS count,
  CASE WHEN last_seen_timestamp = '' THEN strftime(created_at, '%Y-%m-%d %H:%M:%S')
    WHEN last_seen_timestamp = 'yesterday' THEN 'yesterday'
    ELSE strftime(last_seen, '%Y-%m-%d %H:%M:%S') END AS last_seen FROM worn"""
    q["report_detail"] = f"""WITH {WORN}
SELECT id, coalesce(nullif(service_name, ''), 'Unknown service') AS title,
  operational_summary AS summary, {impact('business_impact')} AS impact,
  CASE WHEN business_impact <> {impact('business_impact')} THEN business_impact END AS impact_note,
  coalesce(nullif(severity, ''), 'n/a') AS severity, coalesce(incident_count, 1) AS occurrences,
  root_cause, ai_suggestion, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen,
  CASE last_seen_timestamp WHEN '' THEN '—' WHEN 'yesterday' THEN 'yesterday'
    ELSE strftime(last_seen, '%Y-%m-%d %H:%M:%S') END AS last_seen,
  signature, log_message FROM worn"""
    q["action_plan_rows"] = f"""WITH {WORN},
steps AS (SELECT id, unnest(action_plan) AS s FROM worn)
SELECT id, s.step - 1 AS pos, s.step AS step, s.action AS action, nullif(s.warning, '') AS warning FROM steps
UNION ALL
SELECT id, 0, NULL, 'No action plan recorded.', NULL FROM worn WHERE len(action_plan) = 0"""
    q["impact_normalize"] = f"""
WITH raws AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'High - ' || event_type
  WHEN 1 THEN ' critical ' WHEN 2 THEN 'below normal ' || event_type WHEN 3 THEN 'low to HIGH'
  WHEN 4 THEN 'Severe' WHEN 5 THEN '' WHEN 6 THEN 'Medium, then low' END AS raw FROM events)
SELECT event_id, raw, {impact('raw')} AS impact FROM raws"""
    q["parse_period"] = """
WITH given AS (SELECT event_id, event_id % 9 AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN k >= 1 THEN CASE kind WHEN 0 THEN k * 60 WHEN 1 THEN k * 86400
    WHEN 2 THEN k * 3600 WHEN 3 THEN k WHEN 6 THEN k * 3600 END END AS seconds,
  CASE WHEN kind IN (4, 5, 7, 8) THEN 'format' WHEN k < 1 THEN 'minimum' END AS problem FROM given"""
    q["default_window"] = """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) ELSE ts - INTERVAL 1 DAY END AS start_time,
  CASE event_id % 4 WHEN 3 THEN date_trunc('second', ts) ELSE ts END AS end_time FROM events"""
    q["format_ts"] = """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN '—'
  WHEN 2 THEN 'about ' || event_type WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  WHEN 4 THEN strftime(ts, '%Y-%m-%d 00:00:00') WHEN 5 THEN strftime(ts, '%Y-%m-%d soon')
  ELSE '—' END AS shown FROM events"""

    q["prompt_guard"] = f"""{_prompt_rules()}
SELECT conv_id, turn, kind, rule, why AS reason, rule IS NULL AS is_safe FROM ruled"""
    q["judged_prompts"] = f"""{_prompt_rules()}
SELECT conv_id, turn, kind, rule, coalesce(why, CASE length(prompt) % 4 WHEN 0 THEN 'fine' WHEN 1 THEN 'vague'
    WHEN 2 THEN 'judge failed: RuntimeError: judge is down'
    ELSE 'judge failed: MalformedAnswer: is_safe is str' END) AS reason,
  rule IS NULL AND length(prompt) % 4 = 0 AS is_safe,
  CASE WHEN rule IS NULL AND length(prompt) % 4 = 0 THEN 'Rule: ' || prompt END AS refined_instruction
FROM ruled"""

    doc = "{'doc_id': doc_id, 'text': text}"
    q["batch_limits"] = f"""WITH {SIZED},
parts AS (
  SELECT service_name || '/' || strftime(ts, '%Y-%m-%d') AS batch, bytes FROM sized
  UNION ALL SELECT service_name, bytes FROM sized
  UNION ALL SELECT source, {sized(doc)} FROM documents),
totals AS (SELECT batch, count(*) AS entries, CAST(sum(bytes) + count(*) + 1 AS BIGINT) AS payload_bytes
  FROM parts GROUP BY batch),
judged AS (SELECT *, CASE WHEN entries > {MAX_ENTRIES}
    THEN '{TOO_MANY} (entries: ' || entries || ', limit: {MAX_ENTRIES})'
  WHEN payload_bytes > {MAX_BYTES}
    THEN '{TOO_LARGE} (payload: ' || payload_bytes || ' bytes, limit: {MAX_BYTES} bytes)' END AS reason
  FROM totals)
SELECT batch, entries, payload_bytes, reason IS NULL AS accepted, reason FROM judged"""
    q["pack_batches"] = f"""WITH RECURSIVE {SIZED},
{greedy("sized")}
SELECT insert_id, service_name, batch_no, bytes + 1 > 19999 AS oversize FROM packed"""

    q["analyze_batches"] = f"""WITH RECURSIVE {LOGS},
known AS (
  SELECT *, md5('{{"location":"' || location || '","service_name":"' || service_name || '"}}|'
    || severity || '|' || message) AS signature,
    {sized("{'severity': severity, 'service_name': service_name, 'message': message}")} AS bytes
  FROM clean),
{greedy("known")},
keyed AS (
  SELECT *, message AS log_message, service_name || '/' || batch_no AS batch FROM packed
  UNION ALL SELECT *, message, service_name FROM packed),
totals AS (SELECT batch, count(*) AS entries, CAST(sum(bytes) + count(*) + 1 AS BIGINT) AS payload
  FROM keyed GROUP BY batch),
judged AS (SELECT batch, entries, CASE WHEN entries > {MAX_ENTRIES}
    THEN '{TOO_MANY} (entries: ' || entries || ', limit: {MAX_ENTRIES})'
  WHEN payload > 20000
    THEN '{TOO_LARGE} (payload: ' || payload || ' bytes, limit: 20000 bytes)' END AS reason FROM totals),
faults AS ({rollup_of('keyed', 'batch, signature')}),
found AS (SELECT f.* FROM ({analysed('faults')}) f JOIN judged USING (batch) WHERE reason IS NULL)
SELECT batch, entries, CASE WHEN reason IS NULL THEN 'incident' ELSE 'rejected' END AS outcome, reason,
  operational_summary, service_name, business_impact, root_cause, ai_suggestion, first_seen_timestamp,
  last_seen_timestamp, len(action_plan) AS plan_steps
FROM judged LEFT JOIN found USING (batch)"""
    errors = " ".join(f"WHEN '{letter}' THEN '{error}'" for letter, error in ERRORS.items())
    q["model_answers"] = f"""WITH {REPORTS},
answered AS (SELECT signature, signature[1:1] AS letter, CASE signature[1:1] {errors} END AS problem,
    severity, service_name AS service, log_message FROM rolled),
counted AS (SELECT *, unnest(CASE WHEN problem IS NOT NULL OR letter = '7' THEN [NULL]
    WHEN letter = '8' THEN [0, 1] ELSE [0] END) AS no FROM answered)
SELECT signature, CAST(no AS INTEGER) AS incident_no, problem AS analysis_error,
  CASE WHEN no IS NOT NULL THEN severity || ': ' || log_message END AS operational_summary,
  CASE WHEN no IS NOT NULL AND letter <> 'a' THEN service END AS service_name,
  CASE no WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' END AS business_impact,
  CASE WHEN no IS NOT NULL THEN 'code' END AS root_cause,
  CASE no WHEN 0 THEN 2 WHEN 1 THEN 0 END AS plan_steps FROM counted"""
    q["slim_candidates"] = _report_query(
        "reports",
        "id, operational_summary, root_cause, service_name, business_impact, severity, "
        "first_seen_timestamp, last_seen_timestamp, incident_count")
    q["repeat_candidates"] = f"""WITH {INCIDENTS}
SELECT incident_id, count(r.id) AS n_candidates, max({{'a': r.created_at, 'b': r.id}})
  FILTER (WHERE r.id IS NOT NULL).b AS newest_id
FROM incidents i LEFT JOIN reports r ON {_CANDIDATE} GROUP BY incident_id"""
    q["repeat_scores"] = f"""WITH {SCORES}
SELECT incident_id, newest.b AS report_id, newest.a AS report_created_at, round(score, 6) AS score FROM scores"""
    place = "a.severity = h.severity AND a.service_name IS NOT DISTINCT FROM h.service_name AND a.bucket = h.bucket"
    q["repeat_classes"] = f"""WITH {INCIDENTS},
asks AS (SELECT DISTINCT severity, service_name, CAST(floor(epoch(as_of) / 7200) AS BIGINT) AS bucket, {_WORDS} AS words
  FROM incidents),
stored AS (SELECT DISTINCT severity, service_name, CAST(floor(epoch(created_at) / 7200) AS BIGINT) AS bucket, {_WORDS} AS words
  FROM reports),
holds AS (SELECT severity, service_name, bucket, words FROM stored
  UNION SELECT severity, service_name, bucket + 1, words FROM stored),
contents AS (SELECT DISTINCT words FROM (SELECT words FROM asks UNION ALL SELECT words FROM stored)),
uses AS (SELECT word, count(*) AS uses FROM (SELECT unnest(words) AS word FROM contents) GROUP BY word),
placed AS (SELECT words, word, uses, row_number() OVER (PARTITION BY words ORDER BY uses, word) AS nth
  FROM (SELECT words, unnest(words) AS word FROM contents) JOIN uses USING (word)),
parted AS (SELECT words, md5(array_to_string(words, ' ')) AS content, len(words) AS size,
    coalesce(list(word) FILTER (uses <= 8 AND nth <= len(words) - ceil(len(words) * 0.6 - 1e-9) + 1), []) AS rare,
    coalesce(list(word) FILTER (uses > 8 AND nth <= len(words) - ceil(len(words) * 0.6 - 1e-9) + 1), []) AS prefix,
    list_sort(coalesce(list(word) FILTER (uses > 8), [])) AS core
  FROM placed GROUP BY words),
classed AS (SELECT *, 'class ' || md5(array_to_string(list_prepend(CAST(size AS VARCHAR), core), ' ')) AS class FROM parted),
classes AS (SELECT class, any_value(core) AS core, any_value(size) AS size, any_value(prefix) AS prefix FROM classed GROUP BY class),
near AS (
  SELECT a.severity, a.service_name, a.bucket, l.content, r.content AS other,
    CAST(len(list_intersect(a.words, h.words)) AS DOUBLE) / len(list_distinct(list_concat(a.words, h.words))) AS score
  FROM asks a JOIN holds h ON {place} JOIN classed l ON l.words = a.words JOIN classed r ON r.words = h.words
  WHERE a.words = h.words OR len(list_intersect(l.rare, r.rare)) > 0),
ask_classes AS (SELECT DISTINCT severity, service_name, bucket, class FROM asks JOIN classed USING (words)),
hold_classes AS (SELECT DISTINCT severity, service_name, bucket, class FROM holds JOIN classed USING (words)),
alike AS (
  SELECT a.severity, a.service_name, a.bucket, l.class AS content, r.class AS other,
    CAST(len(list_intersect(l.core, r.core)) AS DOUBLE) / (l.size + r.size - len(list_intersect(l.core, r.core))) AS score
  FROM ask_classes a JOIN hold_classes h ON {place} JOIN classes l ON l.class = a.class JOIN classes r ON r.class = h.class
  WHERE len(list_intersect(l.prefix, r.prefix)) > 0)
SELECT DISTINCT 'match' AS kind, severity, service_name, bucket, content, other, round(score, 6) AS score
FROM (SELECT * FROM near UNION ALL SELECT * FROM alike) WHERE score >= 0.6
UNION ALL SELECT 'member', NULL, NULL, NULL, content, class, NULL FROM classed"""
    q["best_match"] = f"""WITH {SCORES}
SELECT incident_id, top.b AS report_id, round(top.s, 6) AS score FROM best"""
    q["candidate_sets"] = f"""WITH {INCIDENTS},
placed AS (SELECT id, severity, service_name, created_at, row_number() OVER (
  PARTITION BY severity, service_name ORDER BY created_at, id) AS p FROM reports),
sets AS (
  SELECT incident_id, any_value(i.severity) AS severity, any_value(i.service_name) AS service_name,
    min(p) AS low, max(p) AS high
  FROM incidents i LEFT JOIN placed r ON {_CANDIDATE} GROUP BY incident_id)
SELECT 'set' AS kind, incident_id AS id, severity, service_name, low AS first_position,
  high AS last_position FROM sets
UNION ALL SELECT 'report', id, severity, service_name, p, p FROM placed"""
    q["valid_matches"] = f"""WITH {SCORES},
claimed AS (
  SELECT incident_id, r.id AS report_id FROM incidents i JOIN reports r USING (signature)
  UNION ALL SELECT incident_id, top.b FROM best)
SELECT incident_id, report_id FROM claimed JOIN incidents i USING (incident_id)
JOIN reports r ON r.id = report_id WHERE {_CANDIDATE}"""
    q["judged_repeats"] = f"""WITH {INCIDENTS},
shown AS (
  SELECT incident_id, any_value(i.business_impact) AS impact,
    max({{'a': r.created_at, 'b': r.id}}) FILTER (WHERE r.operational_summary = i.operational_summary) AS same
  FROM incidents i JOIN reports r ON {_CANDIDATE} GROUP BY incident_id),
judged AS (SELECT incident_id, CASE WHEN impact NOT IN ('CRITICAL', 'LOW') THEN same END AS hit, impact FROM shown)
SELECT incident_id, hit.b AS report_id, hit.a AS report_created_at,
  CASE WHEN hit IS NOT NULL THEN CAST(1.0 AS DOUBLE) END AS score,
  CASE WHEN impact IN ('CRITICAL', 'LOW') THEN NULL WHEN hit IS NULL THEN 'none' ELSE 'same summary' END AS reason,
  CASE impact WHEN 'CRITICAL' THEN 'RuntimeError: judge is down'
    WHEN 'LOW' THEN 'MalformedAnswer: is_repetitive is str' END AS error
FROM judged"""
    q["repeat_decision"] = f"""WITH {SCORES}
SELECT incident_id, CASE WHEN top IS NULL THEN 'insert' ELSE 'increment' END AS action,
  top.b AS report_id, CASE WHEN top IS NULL THEN 'no similar report'
    ELSE 'similarity ' || format('{{:.3f}}', top.s) END AS reason
FROM incidents LEFT JOIN best USING (incident_id)"""

    q["repeat_apply"] = f"""WITH {SCORES},
decided AS (SELECT i.*, top.b AS report_id, md5(signature || '|' || first_insert_id) AS new_id
  FROM incidents i LEFT JOIN best USING (incident_id)),
added AS (SELECT report_id, count(*) AS n, max(last_seen) AS seen,
    max({{'a': last_seen, 'b': last_insert_id}}).b AS last_id
  FROM decided WHERE report_id IS NOT NULL GROUP BY report_id)
SELECT id, signature, incident_count + coalesce(n, 0) AS incident_count,
  coalesce(strftime(seen, {ISO}), last_seen_timestamp) AS last_seen_timestamp,
  coalesce(last_id, last_insert_id) AS last_insert_id
FROM reports LEFT JOIN added ON id = report_id
UNION ALL
SELECT new_id, signature, incident_count, last_seen_timestamp, last_insert_id FROM decided
WHERE report_id IS NULL AND new_id NOT IN (SELECT id FROM reports)"""

    q["stream_dedup"] = f"WITH {SIGNED} SELECT insert_id, ts FROM signed"
    q["stream_counts"] = f"WITH {REPORTS} SELECT signature, incident_count, first_seen, last_seen FROM rolled"
    q["stream_claims"] = _report_query(
        "reports", "signature, 'ready' AS status, incident_count AS count, id AS report_id")
    gone = " ".join(f"WHEN '{letter}' THEN '{error}'" for letter, error in ERRORS.items())
    q["stream_answers"] = f"""WITH {SIGNED},
judged AS (SELECT insert_id, CASE signature[1:1] {gone} END AS reason FROM signed)
SELECT insert_id, CASE WHEN reason IS NULL THEN 'COMPLETED' ELSE 'DEAD' END AS status, reason FROM judged"""
    q["stream_running_count"] = f"""WITH {SIGNED}
SELECT insert_id, signature, count(*) OVER (PARTITION BY signature ORDER BY ts, insert_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_count FROM signed"""
    q["stream_figures"] = f"""WITH {REPORTS},
judged AS (SELECT ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'UNKNOWN'][1 + ('0x' || signature[1:1])::BIGINT % 5] AS impact,
    incident_count, CASE WHEN signature[1:1] <> '0' THEN service_name END AS service FROM rolled),
levels(ord, impact) AS (VALUES (1, 'CRITICAL'), (2, 'HIGH'), (3, 'MEDIUM'), (4, 'LOW'))
SELECT 'all' AS impact, count(*) AS reports, CAST(sum(incident_count) AS DOUBLE) AS occurrences,
  count(*) FILTER (WHERE impact = 'CRITICAL') AS critical, count(*) FILTER (WHERE impact = 'HIGH') AS high,
  count(DISTINCT service) AS services FROM judged
UNION ALL
SELECT l.impact, l.ord, CAST(coalesce(sum(incident_count), 0) AS DOUBLE), NULL, NULL, NULL
FROM levels l LEFT JOIN judged j USING (impact) GROUP BY l.impact, l.ord"""
    q["stream_reports"] = _report_query(
        "reports",
        "id, signature, incident_count, last_seen_timestamp, last_insert_id, severity, service_name, "
        "business_impact, created_at")
    return q
