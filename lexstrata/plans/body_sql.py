"""SQL over the raw JSON bodies: the same facts, nodes, links and chunks by DuckDB's JSON functions."""

from __future__ import annotations

from lexstrata.operators.chunking import DEFAULT_REVISION, INDENTS, META_FIELDS, SPLIT_AT
from lexstrata.operators.variants import BRANCH, LEVEL_FIELDS, LEVELS, PLACES, ROOT_PATH, UNIT_FLAG, UNIT_TITLE

_WS = r"(?:\\[nrtf]|[\s\pZ])*"
_EDGE = r"[\s\pZ\x{1C}-\x{1F}\x{85}]+"
_KEYS = [*ROOT_PATH, "기본정보", *META_FIELDS, "content", *LEVELS, *[f for fs in LEVEL_FIELDS.values() for f in fs], BRANCH, UNIT_FLAG, UNIT_TITLE]


def _clean_keys(body: str) -> str:
    """White space inside the known labels cut, values left as they are."""
    for key in _KEYS:
        body = f"""regexp_replace({body}, '"{_WS}{_WS.join(key)}{_WS}"{_WS}:', '"{key}":', 'g')"""
    return body


def _clean(text: str) -> str:
    plain = f"replace(replace({text}, '&nbsp;', ' '), chr(160), ' ')"
    return f"nullif(regexp_replace(regexp_replace({plain}, '[ \\t]+\\n', chr(10), 'g'), '^{_EDGE}|{_EDGE}$', '', 'g'), '')"


def _text(holder: str, label: str) -> str:
    """A field's text: a scalar's, a list's lines, or an object's content."""
    v = f"json_extract({holder}, '$.\"{label}\"')"
    lines = f"list_filter(list_transform(json_extract_string({v}, '$[*]'), lambda s: {_clean('s')}), lambda s: s IS NOT NULL)"
    return f"CASE json_type({v}) WHEN 'ARRAY' THEN nullif(array_to_string({lines}, chr(10)), '') WHEN 'OBJECT' THEN {_clean(f'''json_extract_string({v}, '$.content')''')} WHEN 'NULL' THEN NULL ELSE {_clean(f'''json_extract_string({v}, '$')''')} END"


def _members(holder: str, label: str) -> str:
    v = f"json_extract({holder}, '$.\"{label}\"')"
    return f"CASE json_type({v}) WHEN 'OBJECT' THEN [{v}] WHEN 'ARRAY' THEN json_extract({v}, '$[*]') ELSE [] END"


def _levels() -> str:
    """One CTE a level, level0 .. level3: body_id, the places down to it, x (the object)."""
    out, source, places = [], "tops", ""
    for n, label in enumerate(LEVELS):
        out.append(
            f"level{n} AS (SELECT * FROM (SELECT body_id, {places}unnest(xs) AS x, generate_subscripts(xs, 1)::INT AS {PLACES[n]} FROM (SELECT *, {_members('x', label)} AS xs FROM {source})) WHERE json_type(x) = 'OBJECT')"
        )
        source, places = f"level{n}", places + f"{PLACES[n]}, "
    return ",\n".join(out)


def _has(label: str) -> str:
    v = f"json_extract(x, '$.\"{label}\"')"
    return f"CASE WHEN {v} IS NULL OR {v}::VARCHAR IN ('null', '\"\"', '[]') THEN 'bare' WHEN json_type({v}) IN ('ARRAY', 'OBJECT') THEN 'texts' ELSE 'text' END"


def _subtype(level: int) -> str:
    kind = f"CASE WHEN coalesce({_text('x', UNIT_FLAG)}, '조문') <> '조문' THEN 'head' ELSE 'item' END" if level == 0 else "'item'"
    out = f"{kind} || '_' || {_has(LEVEL_FIELDS[LEVELS[level]][0])}"
    if level + 1 == len(LEVELS):
        return out
    v = f"json_extract(x, '$.\"{LEVELS[level + 1]}\"')"
    return out + f" || CASE WHEN json_type({v}) = 'OBJECT' THEN '_one' WHEN json_type({v}) = 'ARRAY' AND len(list_filter(json_extract({v}, '$[*]'), lambda m: json_type(m) = 'OBJECT')) > 0 THEN '_many' ELSE '_leaf' END"


def _nodes() -> str:
    parts = []
    for n, label in enumerate(LEVELS):
        at = [*PLACES[: n + 1], *(f"0 AS {p}" for p in PLACES[n + 1 :])]
        text, number = LEVEL_FIELDS[label]
        own = " || '.' || ".join(PLACES[: n + 1])
        up = " || '.' || ".join(PLACES[:n])
        parts.append(
            f"SELECT body_id AS record_id, '{label}' AS node_level, {_subtype(n)} AS subtype, {', '.join(at)}, body_id || ':' || {own} AS node_id, {f'''body_id || ':' || {up}''' if n else 'NULL::VARCHAR'} AS parent_id, {_text('x', number)} AS label_no, "
            + ", ".join(f"{_text('x', f)} AS {a}" if n == 0 else f"NULL::VARCHAR AS {a}" for f, a in ((BRANCH, "branch_no"), (UNIT_FLAG, "flag"), (UNIT_TITLE, "title")))
            + f", {_text('x', text)} AS text FROM level{n}"
        )
    return "nodes AS (" + "\nUNION ALL ".join(parts) + ")"


_DAY = r"CASE WHEN regexp_full_match(regexp_replace({t}, '[\s\pZ]+', '', 'g'), '[0-9]{{8}}') THEN try_strptime(regexp_replace({t}, '[\s\pZ]+', '', 'g'), '%Y%m%d')::DATE END"
_FACTS = "json_extract(j, '$.\"법령\".\"기본정보\"')"

BODIES = f"bodies AS (SELECT body_id, ({_clean_keys('body')})::JSON AS j FROM (SELECT DISTINCT body_id, body FROM law_bodies_raw WHERE json_valid(body)))"
META = f"""{BODIES},
facts AS (SELECT body_id, {", ".join(f"{_text('f', n)} AS {a}" for n, a in zip(META_FIELDS, ("law_id", "law_name", "e", "p", "r", "ministry")))} FROM (SELECT body_id, {_FACTS} AS f FROM bodies) WHERE json_type(f) = 'OBJECT'),
meta AS (SELECT body_id, law_id, law_name, {_DAY.format(t="e")} AS enforcement_date, {_DAY.format(t="p")} AS promulgation_date, coalesce(r, '{DEFAULT_REVISION}') AS revision_type, ministry FROM facts)"""
NODES = f"""{META},
tops AS (SELECT body_id, json_extract(j, '$."{ROOT_PATH[0]}"."{ROOT_PATH[1]}"') AS x FROM bodies),
{_levels()},
{_nodes()}"""

META_SQL = f"WITH {META} SELECT * FROM meta"
LINKS_SQL = f"WITH {NODES} SELECT * FROM nodes"
TABLES_SQL = f"WITH {NODES} SELECT node_level || '/' || subtype AS table_name, count(*) AS n_rows, count(text) AS n_texts, count(DISTINCT parent_id) AS n_parents, sum(coalesce(length(text), 0))::BIGINT AS chars FROM nodes GROUP BY ALL"

_ASCII = "translate({c}, '０１２３４５６７８９', '0123456789')"
_BARE = "CASE WHEN regexp_full_match({c}, '[0-9]+') THEN regexp_replace({c}, '^0+([0-9])', '\\1') ELSE {c} END"
_INDENT = "CASE node_level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in INDENTS.items()) + " ELSE '' END"
CHUNKS_SQL = f"""WITH {NODES},
lines AS (SELECT record_id, jo_pos, hang_pos, ho_pos, mok_pos, {_INDENT} || text AS line FROM nodes WHERE text IS NOT NULL),
texts AS (SELECT record_id, jo_pos, 0 AS part, string_agg(line, chr(10) ORDER BY hang_pos, ho_pos, mok_pos) AS text FROM lines GROUP BY ALL
  UNION ALL SELECT record_id, jo_pos, hang_pos, string_agg(line, chr(10) ORDER BY ho_pos, mok_pos) FROM lines WHERE hang_pos > 0 GROUP BY ALL),
units AS (SELECT n.record_id, n.jo_pos, n.title, n.label_no, n.branch_no, m.law_id, m.law_name, m.enforcement_date FROM nodes n JOIN meta m ON m.body_id = n.record_id WHERE node_level = '{LEVELS[0]}' AND coalesce(flag, '') IN ('', '조문')),
full_texts AS (SELECT t.*, u.law_id, u.title, u.enforcement_date, {_ASCII.format(c="label_no")} AS no, coalesce(TRY_CAST({_ASCII.format(c="branch_no")} AS INT), 0) AS branch,
  '[' || law_name || ' 제' || {_BARE.format(c="label_no")} || '조' || CASE WHEN coalesce(branch_no, '') IN ('', '0', '00') THEN '' ELSE '의' || {_BARE.format(c="branch_no")} END || CASE WHEN coalesce(title, '') <> '' THEN '(' || title || ')' ELSE '' END || ']' || chr(10) || text AS content
  FROM texts t JOIN units u ON u.record_id = t.record_id AND u.jo_pos = t.jo_pos),
long_units AS (SELECT record_id, jo_pos FROM full_texts WHERE part = 0 AND length(content) > {SPLIT_AT}),
cut AS (SELECT DISTINCT record_id, jo_pos FROM full_texts JOIN long_units USING (record_id, jo_pos) WHERE part > 0)
SELECT f.record_id, law_id, (TRY_CAST(no AS INT) * 100 + branch)::INT AS article_no, nullif(part, 0)::INT AS paragraph_no, part = 0 AND c.record_id IS NOT NULL AS is_parent, title, content, sha256(content) AS content_hash, enforcement_date AS valid_from
FROM full_texts f LEFT JOIN cut c ON c.record_id = f.record_id AND c.jo_pos = f.jo_pos WHERE part = 0 OR c.record_id IS NOT NULL"""
