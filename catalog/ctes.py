"""The derived inputs again, as DuckDB common table expressions.

``sql(body, "persons", ...)`` prefixes ``body`` with the named CTEs and
everything they depend on.
"""

from __future__ import annotations

from catalog.inputs import SMALLEST_FROM, SMALLEST_TO, SURNAMES, TEMPLATES

ALPHA = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def wsum(e: str, offset: int = 0) -> str:
    """Weighted residue of a zone string."""
    return (f"(CAST(list_sum(list_transform(range(1, length({e}) + 1), lambda i: "
            f"(CASE WHEN substr({e}, i, 1) = '<' THEN 0 ELSE strpos('{ALPHA}', substr({e}, i, 1)) - 1 END)"
            f" * [7, 3, 1][(i - 1 + {offset}) % 3 + 1])) AS BIGINT) % 10)")


def cd(e: str) -> str:
    return f"CAST({wsum(e)} AS VARCHAR)"


def verify(e: str, d: str) -> str:
    return (f"(CASE WHEN {d} = '<' THEN regexp_full_match({e}, '<*') "
            f"WHEN regexp_full_match({d}, '[0-9]') THEN {wsum(e)} = CAST({d} AS INT) ELSE FALSE END)")


_yymmdd = "strftime({}, '%y%m%d')"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, *deps: str):
    def add(body: str) -> None:
        CTES[name] = (deps, body)
    return add


cte("persons0")(f"""
SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
  DATE '1960-01-01' + CAST((k * 37) % 16800 AS INT) AS birth,
  DATE '2026-01-01' + CAST((k * 13) % 3650 AS INT) AS expiry,
  chr(CAST(65 + k % 26 AS INT)) || chr(CAST(65 + (k // 26) % 26 AS INT))
    || lpad(CAST((k * 7919) % 10000000 AS VARCHAR), 7, '0') AS doc_no,
  {sql_list(SURNAMES)}[k % 12 + 1] AS surname,
  CASE WHEN k % 2 = 0 THEN 'AKMAL' ELSE 'MADINA' END AS given
FROM (SELECT c_custkey AS k FROM customer)""")

cte("persons", "persons0")("""
SELECT *, (CASE WHEN year(birth) < 2000 AND sex = 'M' THEN '3' WHEN year(birth) < 2000 THEN '4'
       WHEN sex = 'M' THEN '5' ELSE '6' END)
  || strftime(birth, '%d%m%y') || lpad(CAST(10 + doc_id % 24 AS VARCHAR), 2, '0')
  || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || CAST(doc_id % 10 AS VARCHAR) AS pinfl
FROM persons0""")

_b, _e = _yymmdd.format("birth"), _yymmdd.format("expiry")

cte("mrz_h", "persons")(f"""
SELECT *, rpad('IDUZB' || doc_no || {cd('doc_no')} || pinfl, 30, '<') AS l1,
  rpad({_b} || {cd(_b)} || sex || {_e} || {cd(_e)} || 'UZB', 29, '<') AS h,
  rpad(surname || '<<' || given, 30, '<') AS l3 FROM persons""")

_src = "substr(l1, 6, 25) || substr(h, 1, 7) || substr(h, 9, 7) || substr(h, 19, 11)"
cte("mrz_clean", "mrz_h")(f"""
SELECT * EXCLUDE (h, src), h || {cd('src')} AS l2 FROM (SELECT *, {_src} AS src FROM mrz_h)""")

cte("mrz_td3", "persons")(f"""
SELECT * EXCLUDE (h, src), h || {cd('src')} AS l2 FROM (
  SELECT *, substr(h, 1, 10) || substr(h, 14, 7) || substr(h, 22, 22) AS src FROM (
    SELECT *, doc_no || {cd('doc_no')} || 'UZB' || {_b} || {cd(_b)} || sex || {_e} || {cd(_e)}
        || pinfl || {cd('pinfl')} AS h,
      rpad('P<UZB' || surname || '<<' || given, 44, '<') AS l1 FROM persons))""")

cte("mrz_ocr", "mrz_clean")(f"""
SELECT * EXCLUDE (l1, l2), substr(l1, 6, 9) AS true_doc_no,
  CASE WHEN doc_id % 5 = 0 THEN substr(l1, 1, CAST(5 + doc_id % 9 AS INT))
      || translate(substr(l1, CAST(6 + doc_id % 9 AS INT), 1), '{SMALLEST_FROM}', '{SMALLEST_TO}')
      || substr(l1, CAST(7 + doc_id % 9 AS INT)) ELSE l1 END AS l1,
  CASE WHEN doc_id % 25 = 0 AND strpos(substr(l2, 1, 6), '0') > 0
    THEN substr(l2, 1, strpos(substr(l2, 1, 6), '0') - 1) || 'O'
      || substr(l2, strpos(substr(l2, 1, 6), '0') + 1) ELSE l2 END AS l2
FROM mrz_clean""")


def _lines_expr() -> str:
    pairs = [("Familiyasi:", "surname"), ("Ismi:", "given"),
             ("Tug'ilgan sanasi:", "strftime(birth, '%d.%m.%Y')"), ("JSHSHIR", "pinfl"),
             ("Seriya", "true_doc_no"), ("Jinsi:", "sex")]
    parts = ["[" + q("O'ZBEKISTON RESPUBLIKASI") + "]"]
    for label, value in pairs:
        both = (f"(CASE WHEN doc_id % 3 = 0 THEN [{q(label)}, {value}] "
                f"ELSE [{q(label + ' ')} || {value}] END)")
        if label == "JSHSHIR":
            both = f"(CASE WHEN doc_id % 7 = 0 THEN CAST([] AS VARCHAR[]) ELSE {both} END)"
        parts.append(both)
    parts.append("['I<' || substr(l1, 3), l2, l3]")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


cte("doc_lines", "mrz_ocr")(f"SELECT doc_id, {_lines_expr()} AS ls FROM mrz_ocr")
cte("ocr_lines", "doc_lines")("""
SELECT doc_id, CAST(unnest(range(1, len(ls) + 1)) AS INT) AS line_no, unnest(ls) AS text FROM doc_lines""")
cte("doc_text", "doc_lines")("SELECT doc_id, array_to_string(ls, chr(10)) AS text FROM doc_lines")

cte("replies", "persons")("""
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'no json ' || surname
  WHEN doc_id % 3 = 0 THEN '```json' || chr(10) || body || chr(10) || '```'
  WHEN doc_id % 5 = 0 THEN 'Here it is: ' || body || ' done' ELSE body END AS reply, body FROM (
 SELECT doc_id, surname, '{"person.name.surname_latin": "' || surname || '", "person.pinfl": "'
  || (CASE WHEN doc_id % 4 = 0 THEN substr(pinfl, 1, 13) || CAST((doc_id + 1) % 10 AS VARCHAR) ELSE pinfl END)
  || '", "person.birth_date": "' || strftime(birth, '%Y-%m-%d') || '", "person.address": "'
  || (CASE WHEN doc_id % 6 = 0 THEN 'Toshkent' ELSE 'O''ZBEKISTON' END) || '", "person.birth_place": "'
  || (CASE doc_id % 4 WHEN 0 THEN 'OZBEKISTON RESPUBLIKSI' WHEN 1 THEN 'UZBEKISTAN RESPUBLIKASI' WHEN 2 THEN 'TOSHKENT SHAHRI' ELSE 'O''zbekiston Respublikasi' END)
  || '", "person.phone": null}' AS body
 FROM persons)""")

cte("image_replies", "persons")("""
SELECT doc_id, '{"values": {"person.phone": "+998' || substr(pinfl, 1, 9) || '", "person.address": "RASM ' || surname || '"}, "legible": {"person.address": '
  || (CASE WHEN doc_id % 3 = 0 THEN 'false' ELSE 'true' END) || '}}' AS reply,
  '+998' || substr(pinfl, 1, 9) AS phone, CASE WHEN doc_id % 3 <> 0 THEN 'RASM ' || surname END AS address FROM persons WHERE doc_id % 2 = 0""")

cte("golden", "persons")("""
SELECT doc_id, path, value FROM (
  SELECT doc_id, unnest(['person.name.surname_latin', 'person.birth_date', 'person.pinfl', 'documents.0.doc_number']) AS path,
    unnest([surname, strftime(birth, '%Y-%m-%d'), pinfl, doc_no]) AS value FROM persons)""")
cte("actual", "golden")("""
SELECT doc_id, path, CASE WHEN doc_id % 10 = 0 AND path = 'documents.0.doc_number' THEN 'X' || value ELSE value END AS value,
  CASE WHEN doc_id % 10 = 0 AND path = 'documents.0.doc_number' THEN doc_id % 50 = 0
       ELSE path = 'person.birth_date' END AS validated
FROM golden WHERE NOT (doc_id % 14 = 0 AND path = 'person.pinfl')""")
cte("results", "persons")("""
SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN 'bad_quality' WHEN doc_id % 60 = 1 THEN 'unknown_doc_type'
   ELSE 'review_needed' END AS status,
  CASE WHEN doc_id % 9 = 0 THEN ['L0_mrz', 'L3_vlm'] ELSE ['L0_mrz', 'L1_rules'] END AS stages_used,
  CAST(doc_id % 7 AS DOUBLE) AS llm_cost_usd, CAST(200 + (doc_id * 37) % 900 AS INT) AS processing_ms FROM persons""")

cte("jobs")("""
SELECT o_orderkey AS job_id, o_custkey AS user_id,
  CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'review_needed' ELSE 'failed' END AS status,
  o_orderdate AS created_at, o_orderdate + INTERVAL 30 DAY AS expires_at FROM orders""")
cte("uploads")("""
SELECT l_orderkey AS job_id, l_linenumber AS n, CAST(l_quantity * 1000 AS BIGINT) AS size,
  l_shipdate AS created_at, l_shipdate + INTERVAL 24 HOUR AS expires_at,
  'uploads/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey AS storage_key FROM lineitem""")
cte("gen_docs")("""
SELECT o_orderkey AS job_id, o_orderkey % 5 AS template_id, 'documents/' || o_orderkey AS storage_key,
  o_orderdate AS created_at, o_orderdate + INTERVAL 90 DAY AS expires_at
FROM orders""")


def _paths() -> str:
    from docweir.schema import CANONICAL_PATHS
    return sql_list(CANONICAL_PATHS)


cte("corrections")(f"""
SELECT l_orderkey AS job_id, {_paths()}[l_linenumber % 26 + 1] AS path, 'V' || l_partkey AS value,
  l_shipdate AS ts, l_partkey * 100000 + l_suppkey AS seq FROM lineitem""")

cte("calls")("""
SELECT event_id AS call_id, ts, 'key-' || (user_id % 5) AS key_id, 'provider-' || (user_id % 3) AS provider,
  'model-' || (user_id % 2) AS model, CASE WHEN event_type = 'signup' THEN 'vision' ELSE 'text_mapping' END AS task,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'ok' WHEN event_type = 'click' THEN 'rate_limited'
       WHEN event_type = 'signup' THEN 'quota' WHEN event_id % 7 < 2 THEN 'bad_request' WHEN event_id % 53 = 5 THEN 'invalid_key' ELSE 'unavailable' END AS outcome,
  CASE WHEN event_type IN ('click', 'signup') THEN CASE event_id % 4 WHEN 0 THEN 4000.0 WHEN 1 THEN 0.0 WHEN 2 THEN 12.5 END END::DOUBLE AS retry_after,
  CAST(floor(value * 1000) AS BIGINT) AS cost_micros, CAST(floor(value * 10) AS BIGINT) AS latency_ms,
  user_id * 10 AS tokens_in, user_id % 50 AS tokens_out FROM events""")

cte("logits")("""
SELECT vec_id AS image_id, CAST(label % 7 AS INT) AS label,
  list_transform(range(7), lambda k: round(10 * list_sum(list_transform(list_filter(embedding, lambda x, i: (i - 1) % 7 = k), lambda x: CAST(x AS DOUBLE))), 9)) AS logits FROM embeddings""")

cte("templates")("SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {q(text)})" for i, text in TEMPLATES.items()) + ") AS t(template_id, text)")


cte("template_texts")(
    f"SELECT p_partkey AS template_id, {sql_list(TEMPLATES.values())}[p_partkey % 6 + 1] || ' {{{{ extra.x' || (p_partkey % 9) || "
    + q("|default('') }} ") + " || p_name AS text FROM part")


def sql(body: str, *names: str, **extra: str) -> str:
    """Body with its CTEs; ``extra`` adds CTEs private to the query, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order]
    parts += [f"{n} AS ({text})" for n, text in extra.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
