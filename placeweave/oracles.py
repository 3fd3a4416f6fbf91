"""The driver queries once more, as DuckDB SQL written on its own terms."""

from __future__ import annotations

import unicodedata

from .operators.detect import WORDS
from .plans.mapping import KINDS

# White space, name parts and vowels, as the rules word them.
W = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PREFIX = r"tp\.|tx\.|tt\.|q\.|x\.|p\.|t\.|h\.|thành phố|tỉnh|tp|thủ đô|td|huyện|quận|thị xã|xã|phường|thị trấn|district of|dist of|county of|town of|ward of|commune of|township of"
SUFFIX = "province|prov|district|dist|county|town|ward|commune|township"
TONED = "àáảãạằắẳẵặầấẩẫậèéẻẽẹềếểễệìíỉĩịòóỏõọồốổỗộờớởỡợùúủũụừứửữựỳýỷỹỵ"
BARE = "aaaaaăăăăăâââââeeeeeêêêêêiiiiioooooôôôôôơơơơơuuuuuưưưưưyyyyy"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{W}+', ''), '{W}+$', '')"


def place(x: str) -> str:
    s = f"lower({_strip(x)})"
    s = _strip(f"regexp_replace({s}, '^(?:{PREFIX}){W}*', '')")
    s = _strip(f"regexp_replace({s}, '{W}*(?:{SUFFIX})$', '')")
    s = f"regexp_replace({s}, '[,()\\[\\]\\-+]+', ' ', 'g')"
    s = f"regexp_replace({s}, '(?:[.,/]|{W})+$', '')"
    return _strip(f"regexp_replace({_strip(f"regexp_replace({s}, '{W}+', ' ', 'g')")}, '^0+', '')")


def canonical(x: str) -> str:
    """x is lower case."""
    return f"""array_to_string(list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda t: (
      CASE WHEN NOT regexp_matches(t, '[{TONED}]') THEN t ELSE (
        list_transform([{{'b': translate(t, '{TONED}', '{BARE}'), 'k': regexp_extract(t, '^.*([{TONED}])', 1)}}], lambda s: list_transform([{{
          'b': s.b, 'k': (instr('{TONED}', s.k) - 1) % 5 + 1,
          'p': CASE WHEN regexp_matches(s.b, '[êơâăôư]') THEN length(regexp_extract(s.b, '^[^êơâăôư]*')) + 1
                    WHEN length(regexp_replace(s.b, '[^aăâeêioôơuưy]', '', 'g')) = 1
                      OR (length(regexp_replace(s.b, '[^aăâeêioôơuưy]', '', 'g')) = 2
                          AND regexp_extract(s.b, '[aăâeêioôơuưy]') NOT IN ('u', 'i'))
                    THEN length(regexp_extract(s.b, '^[^aăâeêioôơuưy]*')) + 1
                    ELSE length(regexp_extract(s.b, '^[^aăâeêioôơuưy]*[aăâeêioôơuưy][^aăâeêioôơuưy]*')) + 1 END}}],
          lambda r: substr(r.b, 1, r.p - 1) || substr('{TONED}', (instr('aăâeêioôơuưy', substr(r.b, r.p, 1)) - 1) * 5 + r.k, 1) || substr(r.b, r.p + 1))[1])[1]
      ) END)), '')"""


MAPPING = """mapping AS (
  SELECT CAST(n_nationkey AS BIGINT) * 100 + pos AS ord, n_regionkey, n_nationkey, pos, r_name, n_name, segment,
    lower(r_name) AS p, lower(n_name) AS d, lower(segment) AS w,
    'New ' || r_name AS new_province, segment || ' ' || n_name AS new_ward, 'P' || n_regionkey AS new_idp, 'W' || (n_nationkey * 100 + pos) AS new_idw
  FROM nation JOIN region ON n_regionkey = r_regionkey
  CROSS JOIN (SELECT c_mktsegment AS segment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS pos FROM (SELECT DISTINCT c_mktsegment FROM customer))
)"""
ADDRESSES = """addresses AS (
  SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Bad ' ELSE '' END || r_name AS province,
    CASE WHEN c_custkey % 3 = 0 THEN 'Bad ' ELSE '' END || n_name AS district, c_mktsegment AS ward
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
#: Partial matches counted key by key, as the rule is worded.
FOUND = f"""WITH {MAPPING}, {ADDRESSES}, found AS (
  SELECT a.c_custkey, a.province, a.district, a.ward,
    count(*) FILTER (WHERE m.p = lower(a.province) AND m.d = lower(a.district)) AS exact,
    count(m.w) AS near,
    coalesce(any_value(m.ord) FILTER (WHERE m.p = lower(a.province) AND m.d = lower(a.district)), any_value(m.ord)) AS any_ord
  FROM addresses a LEFT JOIN mapping m ON m.w = lower(a.ward) AND (m.p = lower(a.province) OR m.d = lower(a.district))
  GROUP BY ALL
), looked AS (
  SELECT f.*, CASE WHEN exact > 0 THEN 'exact' WHEN near = 1 THEN 'fallback' WHEN near > 1 THEN 'ambiguous' ELSE 'miss' END AS how,
    CASE WHEN exact > 0 OR near = 1 THEN any_ord END AS ord
  FROM found f
)"""
#: One ward holds half of the addresses; each other one is a customer's own.
HOT_WARD = """WITH places AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey), mapping AS (
  SELECT r_name AS p, n_name AS d, c_name AS w FROM customer JOIN places ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 1
  UNION ALL SELECT r_name, n_name, 'Big market' FROM places
), facts AS (
  SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Bad ' || c_custkey ELSE r_name END AS p,
    CASE WHEN c_custkey % 3 = 0 THEN 'Bad ' || c_custkey ELSE n_name END AS d, CASE WHEN c_custkey % 2 = 0 THEN 'Big market' ELSE c_name END AS w
  FROM customer JOIN places ON c_nationkey = n_nationkey
), found AS (
  SELECT c_custkey, count(*) FILTER (WHERE m.p = f.p AND m.d = f.d) AS exact, count(m.w) AS near,
    any_value('New ' || m.w || ' ' || m.d) FILTER (WHERE m.p = f.p AND m.d = f.d) AS sure, any_value('New ' || m.w || ' ' || m.d) AS one
  FROM facts f LEFT JOIN mapping m ON m.w = f.w AND (m.p = f.p OR m.d = f.d) GROUP BY c_custkey
)
SELECT c_custkey, CASE WHEN exact > 0 THEN 'exact' WHEN near = 1 THEN 'fallback' WHEN near > 1 THEN 'ambiguous' ELSE 'miss' END AS how,
  CASE WHEN exact > 0 THEN sure WHEN near = 1 THEN one END AS new_ward FROM found"""
CONVERTED = f"""{FOUND}, converted AS (
  SELECT c_custkey, coalesce(new_idp, '') AS province_id_group1, coalesce(new_province, province) AS province,
    coalesce(new_idw, '') AS ward_id_group1, coalesce(new_ward, ward) AS ward,
    CASE WHEN m.ord IS NULL THEN 'Lỗi _group1' ELSE 'Thành công' END AS "statusState"
  FROM looked l LEFT JOIN mapping m ON l.ord = m.ord
)"""
NATION = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"
COUNTS = """SELECT count(*) AS total, count(*) FILTER (WHERE "statusState" = 'Thành công') AS success,
  count(*) FILTER (WHERE "statusState" IS DISTINCT FROM 'Thành công') AS fail,
  round(100.0 * count(*) FILTER (WHERE "statusState" = 'Thành công') / count(*), 1) AS percent"""
UNITS = """units AS (
  SELECT DISTINCT kind, value FROM (
    SELECT 'id_provinces' AS kind, CAST(n_regionkey AS VARCHAR) AS value FROM mapping UNION ALL SELECT 'id_districts', CAST(n_nationkey AS VARCHAR) FROM mapping
    UNION ALL SELECT 'id_wards', CAST(pos AS VARCHAR) FROM mapping UNION ALL SELECT 'provinces', p FROM mapping
    UNION ALL SELECT 'districts', d FROM mapping UNION ALL SELECT 'wards', w FROM mapping) WHERE value <> ''
)"""
MEMBERS = f"""WITH {MAPPING}, {ADDRESSES}, {UNITS}, sample AS (SELECT * FROM addresses ORDER BY c_custkey LIMIT 500), long AS (
  SELECT 'province' AS "column", lower(province) AS value FROM sample UNION ALL SELECT 'district', lower(district) FROM sample UNION ALL SELECT 'ward', lower(ward) FROM sample
), members AS (SELECT "column", kind, count(*) AS n FROM long JOIN units USING (value) GROUP BY ALL)"""
EDITED = f"""{CONVERTED}, newest AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
), overlaid AS (
  SELECT c_custkey AS id, province, CASE WHEN e.user_id IS NULL THEN ward WHEN e.event_id % 10 <> 0 THEN e.event_type END AS ward,
    CASE WHEN e.user_id IS NULL THEN "statusState" ELSE 'Thành công' END AS "statusState"
  FROM converted LEFT JOIN (SELECT * FROM newest WHERE rn = 1) e ON c_custkey = e.user_id + 1
)"""

SHEET = ("home_province_id", "home_province", "home_district", "home_ward", "work_province", "work_district", "work_ward", "note", "old_province")
_SHEET_VALUES = {
    "home_province_id": "CAST(n_nationkey % 4 + 1 AS VARCHAR)", "home_province": "lower(r_name)", "home_district": "lower(n_name)", "home_ward": "'building'", "work_province": "lower(r_name)",
    "work_district": "lower(n_name)", "work_ward": "'machinery'", "note": "lower(r_name)", "old_province": "CASE WHEN s_suppkey % 4 = 0 THEN '?' ELSE lower(r_name) END",
}
_WORD_ROWS = ", ".join(f"('{kind}', '{w}')" for i, kind in enumerate(KINDS) for w in WORDS[i % 3])
CANDIDATES = f"""WITH {MAPPING}, {UNITS}, sheet AS (
  SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey ORDER BY s_suppkey LIMIT 500
), long AS ({" UNION ALL ".join(f"SELECT {i} AS pos, '{c}' AS col, {_SHEET_VALUES[c]} AS value FROM sheet" for i, c in enumerate(SHEET))}
), hits AS (SELECT pos, col, kind FROM long JOIN units USING (value) GROUP BY ALL HAVING count(*) > (SELECT count(*) FROM sheet) * 80 // 100
), words(kind, word) AS (VALUES {_WORD_ROWS}
), fits AS (SELECT h.*, EXISTS (SELECT 1 FROM words w WHERE w.kind = h.kind AND contains(lower(h.col), w.word)) AS fit FROM hits h
), told AS (SELECT *, count(*) OVER (PARTITION BY kind) AS many, bool_or(fit) OVER (PARTITION BY kind) AS any_fit FROM fits
), kept AS (SELECT * FROM told WHERE CASE WHEN starts_with(kind, 'id_') THEN fit AND col = 'home_province_id' ELSE many = 1 OR fit OR NOT any_fit END)"""
GROUP_COLUMNS = "id_province, id_district, id_ward, province, district, ward"


def _groups(*rows: tuple) -> str:
    shown = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)
    # "case" is a keyword, and columns of nulls alone need a type.
    names = ["case", "place", *GROUP_COLUMNS.split(", ")]
    return 'SELECT ' + ", ".join(f'CAST(c{i} AS {"INTEGER" if n == "place" else "VARCHAR"}) AS "{n}"' for i, n in enumerate(names)) + f" FROM (VALUES {shown}) t({', '.join(f'c{i}' for i in range(8))})"


CUSTOMERS = """SELECT CAST(c_custkey AS VARCHAR) AS zeta, CASE c_custkey % 3 WHEN 0 THEN 'O"' || c_name WHEN 1 THEN c_name END AS name, c_mktsegment AS alpha FROM customer"""
RECORDS = """row_number() OVER (ORDER BY c_custkey) AS id"""
_MARKED = ("Hà Nội", "Đắk Lắk", "Thừa Thiên Huế", "QUẢNG NGÃI", "Bà Rịa - Vũng Tàu", "plain")

ORDERS = """SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'it''s {"(' || o_orderstatus || ')} -' WHEN o_orderkey % 5 <> 1 THEN o_orderstatus END AS note,
  CAST(o_custkey AS VARCHAR) AS customer, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders"""

ORACLE_SQL = {
    **dict.fromkeys(("sql_dump_split", "sql_statement_split", "json_array_split"), ORDERS),
    "csv_breaks_split": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5('"a"' || chr(10) || chr(10) || ',' || text || chr(10)) AS text_md5, source, row_number() OVER (ORDER BY doc_id) AS place FROM documents""",
    "detect_candidates": f'{CANDIDATES} SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY pos) - 1 AS INTEGER) AS place, col AS "column" FROM kept',
    "detect_groups": _groups(("sheet", 0, "home_province_id", None, None, "home_province", "home_district", "home_ward"), ("sheet", 1, None, None, None, "work_province", "work_district", "work_ward")),
    "group_cases": _groups(
        ("single", 0, None, None, None, "tinh", None, "xa"), ("several", 0, None, None, None, "home_p", "home_d", "home_w"), ("several", 1, None, None, None, "work_p", "work_d", "work_w"),
        ("left_over", 0, None, None, None, "a_province", None, "a_ward"), ("left_over", 1, None, None, None, None, None, "zz"),
    ),
    "greedy_grouping": f"""SELECT {", ".join(f"'home_' || x{i} AS {c}" for i, c in enumerate(GROUP_COLUMNS.split(", ")))} FROM (VALUES ('province_id', 'district_id', 'ward_id', 'province', 'district', 'ward')) t(x0, x1, x2, x3, x4, x5)
      UNION ALL SELECT {", ".join(f"'work_' || x{i}" for i in range(6))} FROM (VALUES ('province_id', 'district_id', 'ward_id', 'province', 'district', 'ward')) t(x0, x1, x2, x3, x4, x5)""",
    "percent_half_even": """WITH shares AS (SELECT o_orderkey, CAST(o_orderkey % 401 AS DOUBLE) AS part, o_orderkey % 5 * 400 AS whole FROM orders),
      x AS (SELECT *, part / greatest(whole, 1) * 100 AS x FROM shares), k AS (SELECT *, floor(x * 10) AS k, (x * 16 - (2 * floor(x * 10) + 1)) + x * 4 AS over FROM x)
      SELECT o_orderkey, CASE WHEN whole = 0 THEN 100.0::DOUBLE ELSE (k + CASE WHEN over > 0 OR (over = 0 AND k % 2 = 1) THEN 1 ELSE 0 END) / 10.0::DOUBLE END AS percent FROM k""",
    "json_array_roundtrip": CUSTOMERS, "json_roundtrip": CUSTOMERS, "excel_roundtrip": f"SELECT zeta, coalesce(name, '') AS name, alpha FROM ({CUSTOMERS})",
    "json_column_order": "SELECT * FROM (VALUES (0, 'zeta'), (1, 'name'), (2, 'alpha')) t(place, name)",
    "csv_encodings": """SELECT 'windows-1252' AS encoding, CAST(n_nationkey AS VARCHAR) AS key, n_name || ' café – ü' AS name FROM nation
      UNION ALL SELECT 'UTF-8', CAST(n_nationkey AS VARCHAR), n_name || ' café – ü ' || chr(65533) FROM nation""",
    "file_infos": """SELECT kind, (SELECT count(*) FROM nation) AS n, 3 AS cols, 'n_nationkey|n_name|n_regionkey' AS names, CAST(10 AS BIGINT) AS sampled, true AS fine FROM (VALUES ('.csv'), ('.json'), ('.sql'), ('.xlsx')) t(kind)
      UNION ALL SELECT 'missing', 0, 0, '', 0, false""",
    "header_repair": "SELECT * FROM (VALUES (0, 'a'), (1, 'a.1'), (2, 'col_2'), (3, 'a.2')) t(place, name)",
    "output_names": "SELECT * FROM (VALUES (0, '_convert_success.csv'), (1, '_convert_success(1).csv'), (2, '_convert_success(2).csv')) t(place, name)",
    "sql_statement_roundtrip": f"{NATION} UNION ALL SELECT '', '--', ''",
    "task_records": f"""{CONVERTED} SELECT {RECORDS}, * REPLACE (CAST(c_custkey AS VARCHAR) AS c_custkey) FROM converted""",
    "task_state": f"""{CONVERTED}, n AS (SELECT count(*) AS total, count(*) FILTER (WHERE "statusState" = 'Thành công') AS success FROM converted)
      SELECT 'preview_ready' AS status, CAST(floor(100.0 * success / total + 0.0500001) AS INTEGER) AS progress, 2 AS step, 'c_custkey|province_id_group1|province|ward_id_group1|ward|statusState' AS columns, total, success, total - success AS fail FROM n
      UNION ALL SELECT 'pending', 0, 1, '', -1, -1, -1 UNION ALL SELECT 'failed', 0, 1, '', -1, -1, -1""",
    "task_row_edit": f"""{CONVERTED}, rows AS (SELECT {RECORDS}, province, ward, "statusState" FROM converted)
      SELECT id, CASE id WHEN 3 THEN 'P' ELSE province END AS province, CASE id WHEN 3 THEN 'second' ELSE ward END AS ward, CASE WHEN id IN (3, 5) THEN 'Thành công' ELSE "statusState" END AS "statusState" FROM rows WHERE id <= 20""",
    "task_edit_counts": f"""{CONVERTED}, n AS (SELECT count(*) AS total, count(*) FILTER (WHERE "statusState" = 'Thành công') AS was FROM converted)
      SELECT CAST(step AS INTEGER) AS step, total, was + gained AS success, total - was - gained AS fail, round(100.0 * (was + gained) / total, 1)::DOUBLE AS percent
      FROM n, (VALUES (0, 1), (1, 2), (2, 3), (3, 3), (4, 3), (5, 3)) t(step, gained)""",
    "task_row_lookup": f"{CONVERTED} SELECT c_custkey, ward FROM converted WHERE c_custkey = 7",
    "task_filtered": f"""{CONVERTED} SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, ward, "statusState" FROM converted WHERE "statusState" <> 'Thành công'""",
    "download_success": f"""{CONVERTED} SELECT * EXCLUDE ("statusState") REPLACE (CAST(c_custkey AS VARCHAR) AS c_custkey) FROM converted WHERE "statusState" = 'Thành công'""",
    "download_error": f"""{CONVERTED} SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, nullif(province_id_group1, '') AS province_id_group1, province, nullif(ward_id_group1, '') AS ward_id_group1, ward FROM converted WHERE "statusState" <> 'Thành công'""",
    "group_preview": f"WITH {ADDRESSES} SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS place, ward, province FROM addresses ORDER BY c_custkey LIMIT 5",
    "edit_fields_merged": """SELECT user_id, count(DISTINCT event_type) FILTER (WHERE event_id % 10 <> 0) AS fields,
        coalesce(string_agg(DISTINCT event_type, '|' ORDER BY event_type) FILTER (WHERE event_id % 10 <> 0), '') AS names FROM events GROUP BY user_id""",
    "child_cascade": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0) GROUP BY l_orderkey",
    "compose_marks": "SELECT c_custkey, nfc_normalize(CASE c_custkey % 6 " + " ".join(f"WHEN {i} THEN '{unicodedata.normalize('NFD', x)}'" for i, x in enumerate(_MARKED)) + " END) AS name FROM customer",
    "normalize_place": f"""SELECT c_custkey, {place("noisy")} AS place FROM (SELECT c_custkey, CASE c_custkey % 8
        WHEN 0 THEN 'Tỉnh ' || n_name WHEN 1 THEN '  TP. ' || n_name WHEN 2 THEN n_name || ' Province' WHEN 3 THEN 'Quận 0' || c_custkey
        WHEN 4 THEN 'District of ' || n_name || ' (cũ)' WHEN 5 THEN n_name || '-x, y./ ' WHEN 6 THEN 'Thị xã Hoà ' || n_name ELSE n_name END AS noisy
      FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "detect_cases": _groups(("single", 0, None, None, None, "home_province", "home_district", "home_ward"), ("left_over", 0, None, None, None, "home_province", None, "home_ward"), ("left_over", 1, None, None, None, None, None, "work_ward")),
    "greedy_wide": """WITH stems AS (SELECT n_name || '_' || lpad(CAST(i AS VARCHAR), 2, '0') AS x FROM nation CROSS JOIN range(20) t(i)) SELECT x || '_ward' AS ward, x || '_province' AS province, x || '_district' AS district FROM stems""",
    "header_repair_units": """WITH heads AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 7 <> 3 THEN r_name END AS head FROM nation JOIN region ON n_regionkey = r_regionkey)
      SELECT CAST(n_nationkey AS INTEGER) AS place, CASE WHEN head IS NULL THEN 'col_' || n_nationkey WHEN nth = 0 THEN head ELSE head || '.' || nth END AS name, n_name AS value
      FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY n_nationkey) - 1 AS nth FROM heads)""",
    "ndjson_notes": """SELECT CAST(l_orderkey AS VARCHAR) AS key, CAST(l_linenumber AS VARCHAR) AS line, printf('%.2f', CAST(l_quantity AS DOUBLE)) AS quantity, '{"n":1.50}' AS deep FROM lineitem WHERE l_linenumber <= 2""",
    "tone_dictionary_docs": f"SELECT doc_id, md5({canonical('lower(text)')}) AS canonical FROM documents",
    "tone_canonical_docs": f"SELECT doc_id, md5({canonical('lower(text)')}) AS canonical FROM documents",
    "tone_changed_count": f"SELECT lang, count(*) FILTER (WHERE low <> {canonical('low')}) AS changed, count(*) AS n FROM (SELECT lang, lower(text) AS low FROM documents) GROUP BY lang",
    "mapping_key": f"WITH {MAPPING} SELECT p, d, w, new_idw AS id_ward FROM mapping",
    "mapping_file": f"WITH {MAPPING} SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, r_name AS province, n_name AS district, segment AS ward, new_ward, new_idw AS new_id_ward FROM mapping",
    "mapping_grouped_values": f"WITH {MAPPING} SELECT p, w, count(*) AS n, string_agg(new_ward, '|' ORDER BY ord) AS wards FROM mapping GROUP BY p, w",
    "unit_sets": f"WITH {MAPPING}, {UNITS} SELECT kind, value FROM units",
    **{f"lookup_{name}": f"{FOUND} SELECT c_custkey, new_ward FROM looked l LEFT JOIN mapping m ON l.ord = m.ord WHERE how = '{kind}'" for name, kind in (("exact", "exact"), ("fallback_unique", "fallback"), ("ambiguous", "ambiguous"))},
    "lookup_hot_ward": HOT_WARD,
    "edits_settled": """WITH newest AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
      SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN user_id IS NULL THEN o_orderpriority ELSE event_type END AS priority,
        CASE WHEN user_id IS NULL THEN o_orderstatus ELSE 'Thành công' END AS "statusState"
      FROM orders LEFT JOIN (SELECT * FROM newest WHERE rn = 1) ON o_orderkey = user_id + 1""",
    "lookup_counts": f"{FOUND} SELECT how, count(*) AS n FROM looked GROUP BY how",
    "convert_single_group": f"{CONVERTED} SELECT * FROM converted",
    "convert_multi_group_status": f"""{CONVERTED}, second AS (
        SELECT c.*, CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE m.ord END AS ord2, r_name, c_mktsegment, m.new_province, m.new_ward, m.new_idp, m.new_idw
        FROM converted c JOIN (SELECT c_custkey, r_name AS rn, n_name AS nn, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) x USING (c_custkey)
        JOIN mapping m ON m.r_name = x.rn AND m.n_name = x.nn AND m.segment = x.c_mktsegment)
      SELECT c_custkey, province_id_group1, province, ward_id_group1, ward,
        CASE WHEN ord2 IS NULL THEN '' ELSE new_idp END AS province_id_group2, CASE WHEN ord2 IS NULL THEN r_name ELSE new_province END AS province2,
        CASE WHEN ord2 IS NULL THEN '' ELSE new_idw END AS ward_id_group2, CASE WHEN ord2 IS NULL THEN 'nowhere' ELSE new_ward END AS ward2,
        CASE WHEN ord2 IS NOT NULL THEN "statusState" WHEN "statusState" = 'Thành công' THEN 'Lỗi _group2' ELSE "statusState" || ';_group2' END AS "statusState" FROM second""",
    "convert_no_province": f"""WITH {MAPPING} SELECT s_suppkey, new_idp AS province_id_group1, new_province AS "provinceName_group1", new_idw AS ward_id_group1, new_ward AS ward, 'Thành công' AS "statusState"
      FROM supplier JOIN mapping ON s_nationkey = n_nationkey AND segment = 'BUILDING'""",
    "convert_options_wide": f"""WITH {MAPPING}, {ADDRESSES}, wide AS (
        SELECT p, w, list(new_province ORDER BY ord) AS provinces, list(new_ward ORDER BY ord) AS wards, list(new_idp ORDER BY ord) AS idp, list(new_idw ORDER BY ord) AS idw FROM mapping WHERE pos = 0 GROUP BY p, w),
      near AS (SELECT w, count(*) AS n, any_value(p) AS p FROM wide GROUP BY w),
      hit AS (SELECT a.*, coalesce(e.p, CASE WHEN n.n = 1 THEN n.p END) AS hp FROM addresses a LEFT JOIN wide e ON e.p = lower(a.province) AND e.w = lower(a.ward) LEFT JOIN near n ON n.w = lower(a.ward))
      SELECT c_custkey, coalesce(idp[1], '') AS province_id_group1, coalesce(provinces[1], province) AS province, coalesce(idw[1], '') AS ward_id_group1, coalesce(wards[1], ward) AS ward,
        coalesce(idw[2], '') AS ward_id_group1_option_2, coalesce(wards[2], '') AS ward_option_2, coalesce(idw[3], '') AS ward_id_group1_option_3, coalesce(wards[3], '') AS ward_option_3,
        coalesce(idw[4], '') AS ward_id_group1_option_4, coalesce(wards[4], '') AS ward_option_4, coalesce(idw[5], '') AS ward_id_group1_option_5, coalesce(wards[5], '') AS ward_option_5,
        CASE WHEN x.p IS NULL THEN 'Lỗi _group1' ELSE 'Thành công' END AS "statusState"
      FROM hit h LEFT JOIN wide x ON x.p = h.hp AND x.w = lower(h.ward)""",
    "unit_membership": f'{MEMBERS} SELECT "column", kind, n FROM members',
    "detect_threshold": f'{MEMBERS} SELECT "column", kind, n > (SELECT count(*) FROM sample) * 80 // 100 AS candidate FROM members',
    "numeric_convertible": "SELECT p_partkey, CASE WHEN p_partkey % 4 IN (2, 3) THEN CAST(p_size AS DOUBLE) END AS number FROM part",
    "status_counts": f"{CONVERTED} {COUNTS} FROM converted",
    "progress": "SELECT o_orderkey, CAST(least(100, greatest(0, trunc(o_totalprice / 1000 - 50))) AS BIGINT) AS progress FROM orders",
    "filter_success": f"""{CONVERTED} SELECT c_custkey, ward, "statusState" FROM converted WHERE "statusState" = 'Thành công'""",
    "filter_error": f"""{CONVERTED} SELECT c_custkey, ward, "statusState" FROM converted WHERE "statusState" <> 'Thành công'""",
    "filter_all": f'{CONVERTED} SELECT c_custkey, ward, "statusState" FROM converted',
    "export_success_projection": f"""{CONVERTED} SELECT * EXCLUDE ("statusState") FROM converted WHERE "statusState" = 'Thành công'""",
    "edit_overlay": f"{EDITED} SELECT * FROM overlaid",
    "edit_recount": f"{EDITED} {COUNTS} FROM overlaid",
    "edit_upsert_latest": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "row_ids": "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS id FROM orders",
    "row_ids_ranged": "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey * 7919 % 1000003 * 10000019 + o_orderkey) AS id FROM orders",
    "head_sample": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem)
      WHERE rn <= (SELECT greatest(10, least(500, count(*) // 100)) FROM lineitem)""",
    "suggested_workers": "SELECT name, n, least(8, greatest(1, n // 15000 + 1)) AS workers FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"))
    + ")",
    "jaro_winkler_pairs": """WITH names AS (SELECT DISTINCT column_name AS n FROM information_schema.columns WHERE table_name IN ('customer', 'supplier', 'part', 'orders', 'lineitem', 'nation', 'region'))
      SELECT x.n AS a, y.n AS b, round(jaro_winkler_similarity(x.n, y.n), 6) AS score FROM names x CROSS JOIN names y""",
    "sql_literal_format": """SELECT c_custkey, '(' || c_custkey || ', ' || CASE c_custkey % 3 WHEN 0 THEN '''O\\''' || c_name || '''' WHEN 1 THEN '''' || c_name || '''' ELSE 'NULL' END || ', ' || c_nationkey || ')' AS literal FROM customer""",
    **dict.fromkeys(("sql_dump_roundtrip", "csv_roundtrip", "sqlite_sample"), NATION),
    "union_chunks": "SELECT l_orderkey % 2 = 0 AS first_chunk, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1",
    "set_difference": "SELECT n_nationkey AS key FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0",
    "iso_timestamps": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at FROM orders",
}
