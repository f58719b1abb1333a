"""The registered queries written again in SQL, for DuckDB.

An independent statement of what each query must return: nothing is imported
from the package. Tables are pre-registered views. Statements that range over
every field are assembled from the field list below.
"""

from __future__ import annotations

# source ordinal, source, entity, primary key, ((column, type), ...)
TABLES = (
    (0, "crm", "customer", "c_custkey", (
        ("c_custkey", "bigint"), ("c_name", "text"), ("c_nationkey", "integer"),
        ("c_acctbal", "double precision"), ("c_mktsegment", "text"))),
    (0, "crm", "nation", "n_nationkey", (
        ("n_nationkey", "integer"), ("n_name", "text"), ("n_regionkey", "integer"))),
    (0, "crm", "region", "r_regionkey", (("r_regionkey", "integer"), ("r_name", "text"))),
    (1, "sales", "lineitem", None, (
        ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
        ("l_linenumber", "integer"), ("l_quantity", "double precision"),
        ("l_extendedprice", "double precision"), ("l_discount", "double precision"),
        ("l_tax", "double precision"), ("l_returnflag", "text"), ("l_linestatus", "text"),
        ("l_shipdate", "timestamp without time zone"))),
    (1, "sales", "orders", "o_orderkey", (
        ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "text"),
        ("o_totalprice", "double precision"), ("o_orderdate", "timestamp without time zone"),
        ("o_orderpriority", "text"))),
    (2, "supply", "part", "p_partkey", (
        ("p_partkey", "bigint"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"),
        ("p_size", "integer"), ("p_retailprice", "double precision"))),
    (2, "supply", "supplier", "s_suppkey", (
        ("s_suppkey", "bigint"), ("s_name", "text"), ("s_nationkey", "integer"),
        ("s_acctbal", "double precision"))),
    (3, "content", "documents", "doc_id", (
        ("doc_id", "bigint"), ("text", "text"), ("lang", "text"), ("source", "text"),
        ("n_chars", "bigint"))),
    (3, "content", "labels", "doc_id", (
        ("doc_id", "bigint"), ("quality", "integer"), ("toxic", "integer"))),
)
WEB = (
    (4, "web", "embeddings", None, (
        ("vec_id", "bigint"), ("embedding", "array"), ("label", "integer"))),
    (4, "web", "pages", None, (("page_id", "bigint"), ("url", "text"), ("html", "text"))),
)
# Composite primary keys, unique columns, and indexes beside those of primary keys.
COMPOSITE = {"lineitem": ("l_orderkey", "l_linenumber")}
UNIQUE = {"customer": ("c_name",), "nation": ("n_name", "n_regionkey")}
INDEXES = {
    "customer": ("customer_name_key",), "nation": ("nation_name_key", "nation_place_key"),
    "orders": ("orders_custkey_idx", "orders_date_idx"),
}
FAMILY = {
    "bigint": "number", "integer": "number", "double precision": "number",
    "text": "text", "timestamp without time zone": "date", "array": "unknown",
}


def _text(value: str) -> str:
    trimmed = (
        rf"lower(regexp_replace({value}, '^[\s\p{{Z}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{FEFF}}]+$', '', 'g'))"
    )
    return f"CASE WHEN length({trimmed}) BETWEEN 1 AND 1024 THEN {trimmed} END"


def _form(value: str, kind: str) -> str:
    if kind == "text":
        return _text(value)
    if kind == "double precision":
        return (
            f"regexp_replace(CAST(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,18)) AS VARCHAR),"
            r" '\.?0+$', '')"
        )
    if kind.startswith("timestamp"):
        return f"strftime({value}, '%Y-%m-%dT%H:%M:%S.%gZ')"
    return f"CAST({value} AS VARCHAR)"


def _ratio(value: str) -> str:
    return f"floor(({value}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"


def _fields(tables=TABLES, name: str = "fields") -> str:
    """CTE of the catalog fields: numbered, typed, with key flags and families."""
    rows, number = [], 0
    for order, source, entity, key, columns in tables:
        for ordinal, (path, kind) in enumerate(columns, start=1):
            rows.append(
                f"({number}, {order}, '{source}', '{entity}', {ordinal}, '{path}', '{kind}',"
                f" '{FAMILY[kind]}', {str(path in COMPOSITE.get(entity, (key,))).lower()},"
                f" {str(path in UNIQUE.get(entity, ())).lower()})"
            )
            number += 1
    columns = "fid, ord, source_id, entity, ordinal, path, kind, family, is_key, is_unique"
    return f"{name}({columns}) AS (VALUES {', '.join(rows)})"


def _counts(tables=TABLES) -> str:
    parts = [
        f"SELECT '{source}' AS source_id, '{entity}' AS entity, count(*) AS row_count FROM {entity}"
        for _, source, entity, _, _ in tables
    ]
    return "counts AS (" + " UNION ALL ".join(parts) + ")"


def _values(tables=TABLES) -> str:
    """CTEs: every cell in normal form, then distinct fingerprints per field."""
    parts, number = [], 0
    for _, _, entity, _, columns in tables:
        for path, kind in columns:
            parts.append(
                f'SELECT {number} AS fid, {_form(chr(34) + path + chr(34), kind)} AS form,'
                f' "{path}" IS NULL AS missing FROM {entity}'
            )
            number += 1
    return (
        "cells AS (" + " UNION ALL ".join(parts) + "), "
        "prints AS (SELECT DISTINCT fid, sha256(form) AS fp FROM cells WHERE form IS NOT NULL), "
        "sizes AS (SELECT fid, count(*) AS n FROM prints GROUP BY fid)"
    )


TOKENS = """
    tokens AS (
      SELECT *, list_distinct(list_transform(
        list_filter(
          list_transform(
            regexp_split_to_array(
              regexp_replace(entity || '.' || path, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'),
              '[^a-zA-Z0-9]+'),
            lambda w: lower(w)),
          lambda w: w <> '' AND w <> 'id' AND w <> 'key'),
        lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, -1) ELSE w END)) AS toks
      FROM fields)
"""

ENDS = ", ".join(
    f"{side}.{column} AS {name}_{column}"
    for side, name in (("l", "left"), ("r", "right"))
    for column in ("source_id", "entity", "path")
)

OVERLAP = """
    shared AS (
      SELECT a.fid AS lid, b.fid AS rid, count(*) AS shared
      FROM prints a JOIN prints b ON a.fp = b.fp AND a.fid < b.fid
      GROUP BY 1, 2),
    jaccards AS (
      SELECT lid, rid, shared, shared / (x.n + y.n - shared) AS overlap
      FROM shared JOIN sizes x ON x.fid = lid JOIN sizes y ON y.fid = rid)
"""

SKETCH = """
    ranked AS (
      SELECT fid, fp, row_number() OVER (PARTITION BY fid ORDER BY fp) AS rank FROM prints),
    sketch AS (SELECT fid, fp, rank FROM ranked WHERE rank <= 100)
"""

SKETCH_OVERLAP = """
    met AS (
      SELECT DISTINCT a.fid AS lid, b.fid AS rid
      FROM sketch a JOIN sketch b ON a.fp = b.fp AND a.fid < b.fid),
    pooled AS (
      SELECT lid, rid, fp, count(*) AS sides
      FROM met JOIN sketch s ON s.fid = lid OR s.fid = rid GROUP BY 1, 2, 3),
    lowest AS (
      SELECT *, row_number() OVER (PARTITION BY lid, rid ORDER BY fp) AS place FROM pooled),
    jaccards AS (
      SELECT lid, rid, count(*) FILTER (WHERE sides = 2) AS shared, count(*) AS sampled,
             count(*) FILTER (WHERE sides = 2) / count(*) AS overlap
      FROM lowest WHERE place <= 100 GROUP BY 1, 2
      HAVING count(*) FILTER (WHERE sides = 2) > 0)
"""

SUGGEST = """
    pairs AS (
      SELECT l.source_id AS left_source_id, 'public' AS left_namespace, l.entity AS left_entity,
             l.path AS left_path, r.source_id AS right_source_id, 'public' AS right_namespace,
             r.entity AS right_entity, r.path AS right_path,
             l.is_key OR l.is_unique AS lk, r.is_key OR r.is_unique AS rk,
             len(list_intersect(l.toks, r.toks))
               / nullif(len(list_distinct(list_concat(l.toks, r.toks))), 0) AS sim,
             coalesce(o.overlap, 0::DOUBLE) AS ov
      FROM tokens l JOIN tokens r ON l.ord < r.ord AND l.family = r.family
      LEFT JOIN jaccards o ON o.lid = l.fid AND o.rid = r.fid
      WHERE l.family <> 'unknown'),
    scored AS (
      SELECT *, coalesce(sim, 0::DOUBLE) AS name,
        0.2::DOUBLE + coalesce(sim, 0::DOUBLE) * 0.3::DOUBLE
          + CASE WHEN lk OR rk THEN 0.2::DOUBLE ELSE 0::DOUBLE END
          + ov * 0.3::DOUBLE AS raw
      FROM pairs),
    suggestions AS (
      SELECT left_source_id, left_namespace, left_entity, left_path,
        right_source_id, right_namespace, right_entity, right_path,
        'equals' AS operator,
        CASE WHEN lk AND rk THEN 'one-to-one' WHEN lk THEN 'one-to-many'
             WHEN rk THEN 'many-to-one' ELSE 'many-to-many' END AS cardinality,
        'inner' AS join_type,
        floor(raw * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS confidence,
        concat_ws(',', 'compatible_types', CASE WHEN name > 0 THEN 'name_match' END,
          CASE WHEN lk OR rk THEN 'key_match' END,
          CASE WHEN ov > 0 THEN 'value_overlap' END) AS evidence
      FROM scored
      WHERE raw >= 0.45::DOUBLE AND (name > 0 OR lk OR rk OR ov > 0)
      ORDER BY confidence DESC, left_source_id, left_namespace, left_entity, left_path,
        right_source_id, right_namespace, right_entity, right_path
      LIMIT 100)
"""

_EXACT = f"WITH {_fields()}, {_values()}, {TOKENS}, {OVERLAP}, {SUGGEST}"

_LEFT = ("left_source_id", "left_namespace", "left_entity", "left_path")
_RIGHT = tuple(c.replace("left", "right") for c in _LEFT)


def _proposed(*variants: dict[str, str]) -> str:
    """CTE of mapping rows: each key column with each field of its family elsewhere."""
    plain = (*_LEFT, *_RIGHT, "operator")
    parts = [
        f"SELECT place * {len(variants)} + {i} AS pos, "
        + ", ".join(f"{changed.get(c, c)} AS {c}" for c in plain)
        + " FROM placed"
        for i, changed in enumerate(variants)
    ]
    ends = ", ".join(
        f"{expression} AS {side}_{name}"
        for side, alias in (("left", "l"), ("right", "r"))
        for name, expression in (
            ("source_id", f"{alias}.source_id"), ("namespace", "'public'"),
            ("entity", f"{alias}.entity"), ("path", f"{alias}.path"))
    )
    return (
        f"placed AS (SELECT (l.fid::BIGINT * 268435456 + r.fid)::BIGINT AS place, {ends}, 'equals' AS operator"
        " FROM fields l JOIN fields r ON l.ord <> r.ord AND l.family = r.family"
        " WHERE (l.is_key OR l.is_unique) AND l.family <> 'unknown'), "
        f"proposals AS ({' UNION ALL '.join(parts)})"
    )


_SWAP = dict(zip((*_LEFT, *_RIGHT), (*_RIGHT, *_LEFT)))
_NAMED = ", ".join(c for c in (*_LEFT, *_RIGHT) if "namespace" not in c)
_EDGE = (
    "least((left_source_id, left_entity, left_path), (right_source_id, right_entity, right_path)),"
    " greatest((left_source_id, left_entity, left_path),"
    " (right_source_id, right_entity, right_path))"
)

VALIDATE = f"""WITH {_fields()}, {_counts()}, {_proposed(
    {"left_path": "' ' || left_path || chr(9)"},
    _SWAP,
    {"operator": "'contains'"},
    {"right_path": "right_path || '_missing'"},
    {"right_source_id": "'sales'", "right_entity": "'orders'", "right_path": "'o_orderdate'"},
)},
    trimmed AS (SELECT * REPLACE (trim(left_path, ' ' || chr(9)) AS left_path) FROM proposals),
    checked AS (
      SELECT p.*, CASE
        WHEN p.operator <> 'equals' OR p.left_source_id = p.right_source_id
          THEN 'Invalid relationship definition.'
        WHEN l.fid IS NULL OR r.fid IS NULL THEN 'Relationship endpoint does not exist.'
        WHEN l.family <> r.family OR l.family = 'unknown'
          THEN 'Relationship fields have incompatible types.' END AS failure
      FROM trimmed p
      LEFT JOIN fields l ON (l.source_id, l.entity, l.path)
        = (p.left_source_id, p.left_entity, p.left_path)
      LEFT JOIN fields r ON (r.source_id, r.entity, r.path)
        = (p.right_source_id, p.right_entity, p.right_path))
    SELECT pos, {_NAMED}, coalesce(failure, CASE WHEN row_number() OVER (
      PARTITION BY failure IS NULL, {_EDGE} ORDER BY pos) > 1
      THEN 'Duplicate relationship.' ELSE 'valid' END) AS status, row_count AS left_rows
    FROM checked JOIN counts ON (source_id, entity) = (left_source_id, left_entity)
"""

_SIZES = """
    JOIN counts x ON (x.source_id, x.entity) = (left_source_id, left_entity)
    JOIN counts y ON (y.source_id, y.entity) = (right_source_id, right_entity)
"""

DUPLICATES = f"""WITH {_fields()}, {_counts()}, {_proposed({}, _SWAP)}
    SELECT pos, {_NAMED},
      row_number() OVER (PARTITION BY {_EDGE} ORDER BY pos) > 1 AS duplicate,
      x.row_count AS left_rows, y.row_count AS right_rows
    FROM proposals {_SIZES}
"""

# -- documents: the same collections, written out as (doc, path, type, form) --

_SHOP = """
    nodes AS (
      SELECT o_orderkey AS doc, u.path, u.kind, u.form
      FROM orders, LATERAL (
        SELECT '_id' AS path, 'number' AS kind, CAST(o_orderkey AS VARCHAR) AS form
        UNION ALL SELECT 'customer', 'object', NULL
        UNION ALL SELECT 'customer.id', 'number', CAST(o_custkey AS VARCHAR)
        UNION ALL SELECT 'customer.state', 'object', NULL
        UNION ALL SELECT 'customer.state.code', 'string', lower(o_orderstatus)
        UNION ALL SELECT 'tags', 'array', NULL
        UNION ALL SELECT 'tags.name', 'string', lower(o_orderpriority) WHERE o_orderstatus <> 'P'
        UNION ALL SELECT 'tags.name', 'string', lower(o_orderstatus) WHERE o_orderstatus <> 'P'
        UNION ALL SELECT 'note', 'null', NULL WHERE o_orderstatus = 'P'
        UNION ALL SELECT 'total',
          CASE WHEN o_orderstatus = 'P' THEN 'string' ELSE 'number' END,
          CASE WHEN o_orderstatus = 'P' THEN 'pending ' || lower(o_orderpriority)
               ELSE regexp_replace(CAST(CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(38,18))
                 AS VARCHAR), '\\.?0+$', '') END
      ) u)
"""

_EVENT_NODES = """
    SELECT event_id AS doc, 'k' AS path, 'number' AS kind,
      json_extract_string(props, '$.k') AS form
    FROM events
"""

DOCUMENT_PROFILE = f"""
    WITH {_SHOP}, everything AS (
      SELECT 'shop' AS source_id, 'orders' AS entity, * FROM nodes
      UNION ALL SELECT 'stream', 'events', * FROM ({_EVENT_NODES})),
    totals AS (
      SELECT 'shop' AS source_id, count(*) AS documents FROM orders
      UNION ALL SELECT 'stream', count(*) FROM events),
    prints AS (
      SELECT DISTINCT source_id, entity, path, sha256(form) AS fp
      FROM everything WHERE form IS NOT NULL),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY source_id, entity, path ORDER BY fp) AS rank
      FROM prints),
    digests AS (
      SELECT source_id, entity, path,
        count(*) AS distinct_count,
        string_agg(fp, ',' ORDER BY fp) FILTER (WHERE rank <= 100) AS listed
      FROM ranked GROUP BY ALL),
    fields AS (
      SELECT source_id, entity, path, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types,
        string_agg(DISTINCT CASE kind WHEN 'number' THEN 'number' WHEN 'string' THEN 'text' END,
          ',' ORDER BY CASE kind WHEN 'number' THEN 'number' WHEN 'string' THEN 'text' END)
          AS families,
        count(DISTINCT doc) AS present, bool_or(kind = 'null') AS has_null,
        count(form) AS sampled, count(*) FILTER (WHERE kind = 'null') AS nulls
      FROM everything GROUP BY ALL)
    SELECT source_id, 'docs' AS namespace, entity, path, types,
      coalesce(families, 'unknown') AS type_families,
      path = '_id' AS primary_key,
      path = '_id' OR (source_id = 'shop' AND path IN ('customer.id', 'total')) AS "unique",
      has_null OR present < documents AS nullable,
      sampled AS sampled_value_count,
      least(coalesce(distinct_count, 0), 100) AS distinct_sample_count,
      coalesce(distinct_count, 0) AS distinct_count, nulls AS null_count,
      sha256(coalesce(listed, '')) AS fingerprint_digest
    FROM fields JOIN totals USING (source_id)
    LEFT JOIN digests USING (source_id, entity, path)
"""

_RELATIONAL_KEYS = ", ".join(
    f"('{source}', '{entity}', '{','.join(sorted((*((entity + '_pkey',) if key or entity in COMPOSITE else ()), *INDEXES.get(entity, ()))))}',"
    f" '{','.join(COMPOSITE.get(entity, (key,) if key else ()))}', '{','.join(sorted(UNIQUE.get(entity, ())))}')"
    for _, source, entity, key, _ in TABLES
)
_KEYS = f"keys(source_id, entity, indexes, key_fields, unique_fields) AS (VALUES {_RELATIONAL_KEYS})"

_DOCUMENT_FIELDS = f"""
    everything AS (
      SELECT 'shop' AS source_id, 'orders' AS entity, * FROM nodes
      UNION ALL SELECT 'stream', 'events', * FROM ({_EVENT_NODES})),
    totals AS (
      SELECT 'shop' AS source_id, count(*) AS documents FROM orders
      UNION ALL SELECT 'stream', count(*) FROM events),
    found AS (
      SELECT source_id, entity, path, list_sort(list(DISTINCT kind)) AS types,
        bool_or(kind = 'null') OR count(DISTINCT doc) < any_value(documents) AS nullable
      FROM everything JOIN totals USING (source_id) GROUP BY ALL)
"""

CATALOG_MIXED = f"""
    WITH {_fields(TABLES[:3])}, {_KEYS}, {_SHOP}, {_DOCUMENT_FIELDS}
    SELECT source_id, 'relational' AS kind, 'public' AS namespace, entity,
      string_agg(path || ':' || kind || CASE WHEN is_key THEN '' ELSE ':null' END, ',' ORDER BY ordinal) AS fields,
      any_value(indexes) AS indexes, any_value(key_fields) AS key_fields,
      any_value(unique_fields) AS unique_fields
    FROM fields JOIN keys USING (source_id, entity) GROUP BY source_id, entity
    UNION ALL
    SELECT source_id, 'document', 'docs', entity,
      string_agg(path || ':' || array_to_string(types, '|') || CASE WHEN nullable THEN ':null' ELSE '' END, ',' ORDER BY path),
      CASE source_id WHEN 'shop' THEN '_id_,orders_customer_total' ELSE '_id_' END, '',
      CASE source_id WHEN 'shop' THEN 'customer.id,total' ELSE '' END
    FROM found GROUP BY source_id, entity
"""

SUGGEST_MIXED = f"""
    WITH {_fields(TABLES[:3], "tabled")}, {_values(TABLES[:3]).replace("prints AS", "table_prints AS").replace("FROM prints", "FROM table_prints").replace("sizes AS", "table_sizes AS")},
    {_SHOP},
    paths AS (
      SELECT 1000 + row_number() OVER (ORDER BY path) AS fid, path, list(DISTINCT kind) AS kinds
      FROM nodes GROUP BY path),
    fields AS (
      SELECT fid, ord, source_id, 'public' AS namespace, entity, path, [family] AS families,
        is_key OR is_unique AS keyed FROM tabled
      UNION ALL
      SELECT fid, 9, 'shop', 'docs', 'orders', path,
        list_transform(list_filter(kinds, lambda k: k IN ('number', 'string')),
          lambda k: CASE k WHEN 'string' THEN 'text' ELSE k END),
        path IN ('_id', 'customer.id', 'total') FROM paths),
    prints AS (
      SELECT * FROM table_prints
      UNION ALL SELECT DISTINCT fid, sha256(form) FROM nodes JOIN paths USING (path) WHERE form IS NOT NULL),
    sizes AS (SELECT fid, count(*) AS n FROM prints GROUP BY fid),
    {TOKENS}, {OVERLAP}, {
        SUGGEST.replace("'public' AS left_namespace", "l.namespace AS left_namespace")
        .replace("'public' AS right_namespace", "r.namespace AS right_namespace")
        .replace("l.family = r.family", "list_has_any(l.families, r.families)")
        .replace("WHERE l.family <> 'unknown'", "")
        .replace("l.is_key OR l.is_unique", "l.keyed").replace("r.is_key OR r.is_unique", "r.keyed")}
    SELECT * FROM suggestions
"""

FINGERPRINT_SKETCH = f"""
    WITH {_fields()}, {_values()}, {SKETCH}
    SELECT source_id, entity, path, rank, fp AS fingerprint FROM sketch JOIN fields USING (fid)
"""

_UNIQUENESS = " UNION ALL ".join(
    f"SELECT '{source}' AS source_id, '{entity}' AS entity, '{path}' AS path,"
    f" count({path}) AS value_count, count(DISTINCT {path}) AS distinct_count,"
    f" {str(path in COMPOSITE.get(entity, (key,)) or path in UNIQUE.get(entity, ())).lower()} AS declared_unique"
    f" FROM {entity}"
    for _, source, entity, key, columns in TABLES
    for path, kind in columns
    if kind in ("bigint", "integer", "text")
)

# -- several sources ---------------------------------------------------------

_BATCH = """
    answers AS (
      SELECT 0 AS source_ord, 'source_1' AS source_id, c_custkey AS k,
        to_json({'c_custkey': c_custkey, 'c_name': c_name}) AS row
      FROM customer WHERE c_nationkey < 5
      UNION ALL
      SELECT 2, 'source_3', o_orderkey,
        to_json({'o_orderkey': o_orderkey, 'o_custkey': o_custkey,
                 'o_orderstatus': o_orderstatus})
      FROM orders
      UNION ALL
      SELECT 4, 'source_5', event_id, to_json({'event_id': event_id, 'user_id': user_id})
      FROM events WHERE event_type = 'error'),
    numbered AS (
      SELECT source_ord, source_id, row_number() OVER (PARTITION BY source_id ORDER BY k) AS row_no,
        CAST(row AS VARCHAR) AS row
      FROM answers),
    bounded AS (SELECT * FROM numbered WHERE row_no <= 1000)
"""

PACK_SHARED = f"""
    WITH RECURSIVE {_BATCH},
    foremost AS (
      SELECT *, sum(length(row)) OVER (PARTITION BY source_ord ORDER BY row_no)::BIGINT AS used,
        count(*) OVER (PARTITION BY source_ord) AS total,
        dense_rank() OVER (ORDER BY source_ord) AS g
      FROM bounded),
    spent AS (
      SELECT 0::BIGINT AS g, 4000::BIGINT AS remaining, 0::BIGINT AS kept, 0::BIGINT AS chars
      UNION ALL
      SELECT s.g + 1, s.remaining - x.chars, x.kept, x.chars
      FROM spent s, LATERAL (
        SELECT count(*) FILTER (WHERE row_no <= 40 AND used <= s.remaining) AS kept,
          coalesce(max(used) FILTER (WHERE row_no <= 40 AND used <= s.remaining), 0)::BIGINT
            AS chars
        FROM foremost WHERE g = s.g + 1) x
      WHERE s.g < (SELECT max(g) FROM foremost))
    SELECT DISTINCT l.source_ord, s.kept AS kept_rows, s.chars AS kept_chars,
      l.total > 40 OR s.kept < least(l.total, 40) AS truncated
    FROM spent s JOIN foremost l ON l.g = s.g
"""


def _cardinality(left: str, lc: str, right: str, rc: str, claimed: str) -> str:
    return f"""
    SELECT '{left}.{lc}={right}.{rc}' AS relationship, *,
      observed = '{claimed}' AS as_claimed
    FROM (SELECT *, CASE
        WHEN max_left_per_key <= 1 AND max_right_per_key <= 1 THEN 'one-to-one'
        WHEN max_left_per_key <= 1 THEN 'one-to-many'
        WHEN max_right_per_key <= 1 THEN 'many-to-one' ELSE 'many-to-many' END AS observed
      FROM (SELECT
        (SELECT count(*) FROM {left}) AS left_rows,
        (SELECT count(*) FROM {right}) AS right_rows,
        (SELECT count(DISTINCT {lc}) FROM {left} WHERE {lc} IN (SELECT {rc} FROM {right}))
          AS matched_keys,
        (SELECT count(*) FROM {left} x WHERE NOT EXISTS (
          SELECT 1 FROM {right} y WHERE y.{rc} = x.{lc})) AS left_orphans,
        (SELECT count(*) FROM {right} y WHERE NOT EXISTS (
          SELECT 1 FROM {left} x WHERE y.{rc} = x.{lc})) AS right_orphans,
        (SELECT max(n) FROM (SELECT count(*) AS n FROM {left} GROUP BY {lc})) AS max_left_per_key,
        (SELECT max(n) FROM (SELECT count(*) AS n FROM {right} GROUP BY {rc}))
          AS max_right_per_key))
    """


def _unique(table: str, *columns: str) -> str:
    listed = ", ".join(columns)
    return f"""
    SELECT '{table}({",".join(columns)})' AS rule, count(*) AS repeated_keys,
      coalesce(sum(n - 1), 0)::BIGINT AS surplus_rows
    FROM (SELECT count(*) AS n FROM {table} GROUP BY {listed} HAVING count(*) > 1)
    """


def _reference(child: str, column: str, parent: str, key: str) -> str:
    return f"""
    SELECT '{child}.{column}->{parent}.{key}' AS rule,
      count(DISTINCT {column}) AS orphan_keys, count({column}) AS orphan_rows
    FROM {child} WHERE {column} NOT IN (SELECT {key} FROM {parent})
    """


def _domain(table: str, **rules: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) FILTER (WHERE NOT ({rule})) AS violations FROM {table}"
        for name, rule in rules.items()
    )


def _forms(table: str, key: str, columns: dict[str, str], suffix: str, wrap: str) -> str:
    listed = ", ".join(
        f'{wrap.format(_form(chr(34) + c + chr(34), kind))} AS {c}_{suffix}'
        for c, kind in columns.items()
    )
    return f"SELECT {key}, {listed} FROM {table}"


ORACLE_SQL: dict[str, str] = {
    "result_envelope": """
        SELECT 'relational' AS kind,
          coalesce(string_agg(CAST(to_json({'o_orderkey': o_orderkey, 'o_custkey': o_custkey,
            'o_orderpriority': o_orderpriority}) AS VARCHAR), chr(10) ORDER BY o_orderkey), '') AS rows,
          count(*) AS returned_count
        FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 1000)
        UNION ALL SELECT 'relational', '', 0
    """,
    "catalog_fields": f"""
        WITH {_fields(TABLES + WEB)}, {_counts(TABLES + WEB)}
        SELECT source_id, 'public' AS namespace, entity, ordinal, path, kind AS types,
          NOT is_key AS nullable, row_count
        FROM fields JOIN counts USING (source_id, entity)
    """,
    "catalog_keys": f"""
        WITH {_KEYS}, {_counts()}
        SELECT source_id, 'relational' AS kind, entity, indexes,
          CASE WHEN key_fields <> '' THEN entity || '_pkey' END AS key_name,
          key_fields, unique_fields, row_count
        FROM keys JOIN counts USING (source_id, entity)
    """,
    "catalog_session": f"""
        WITH {_fields()}, {_counts()}
        SELECT entity, ordinal::BIGINT AS ordinal, path, kind AS type, true AS nullable, row_count
        FROM fields JOIN counts USING (source_id, entity)
        WHERE entity IN ('customer', 'nation', 'orders', 'region')
    """,
    "catalog_mixed": CATALOG_MIXED,
    "relationship_suggestions_mixed": SUGGEST_MIXED,
    "find_documents": """
        SELECT o_orderkey AS order_key, o_custkey AS customer FROM orders
        WHERE o_orderstatus = 'F' AND o_totalprice >= 1000
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 500
    """,
    "document_membership": """
        SELECT o_orderkey AS order_key, o_orderstatus <> 'P' AS by_name,
          o_orderstatus = 'P' AS by_element, true AS no_note, o_orderstatus = 'P' AS has_note
        FROM orders WHERE o_orderpriority = '1-URGENT'
    """,
    "document_elem_match": """
        SELECT o_orderkey AS order_key, o_custkey AS customer FROM orders WHERE o_orderstatus = 'F'
    """,
    "document_numbers": """
        WITH amounts AS (
          SELECT o_orderkey AS order_key, o_orderkey % 4 AS kind,
            CASE o_orderkey % 4 WHEN 0 THEN 9007199254740992 + o_orderkey % 3 WHEN 1 THEN 1
              WHEN 2 THEN 1000000000000000000000000000000 END::HUGEINT AS whole,
            CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey % 3 ELSE 0 END AS rest
          FROM orders)
        SELECT order_key, coalesce(whole = 1 AND rest = 0, false) AS is_one,
          coalesce(whole > 1 OR (whole = 1 AND rest > 0), false) AS above_one,
          coalesce(whole >= 5, false) AS from_five,
          coalesce(whole = 9007199254740993, false) AS is_odd,
          coalesce(whole <= 9007199254740992, false) AS to_even,
          coalesce(whole = 9007199254740994, false) OR (kind = 3 AND order_key = 7) AS listed
        FROM amounts
    """,
    "document_lookup": """
        SELECT c_custkey AS key, c_name AS name, count(o_orderkey) AS order_count,
          coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS orders
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name
    """,
    "ordered_string_repeats": """
        SELECT l_orderkey, string_agg(l_returnflag, '/' ORDER BY l_linenumber, l_returnflag) AS flags
        FROM lineitem GROUP BY l_orderkey
    """,
    "infer_fields_props": f"""
        SELECT path, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types
        FROM (SELECT key AS path, CASE type WHEN 'UBIGINT' THEN 'number' ELSE lower(type) END AS kind
              FROM events, json_each(props))
        GROUP BY path
    """,
    "infer_fields_nested": f"""
        WITH {_SHOP}
        SELECT path, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types FROM nodes GROUP BY path
    """,
    "bounded_sample": """
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders
        ORDER BY sha256(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100
    """,
    "normalize_values": _forms("events", "event_id", {
        "ts": "timestamp", "user_id": "bigint", "event_type": "text",
        "value": "double precision", "props": "text"}, "form", "{}"),
    "fingerprint_values": _forms("documents", "doc_id", {
        "text": "text", "lang": "text", "source": "text", "n_chars": "bigint"},
        "fingerprint", "sha256({})"),
    "type_families": f"""
        WITH {_fields(TABLES + WEB)}, {_counts(TABLES + WEB)}
        SELECT kind AS types, family AS type_families, count(*) AS fields,
          sum(row_count)::BIGINT AS total_values
        FROM fields JOIN counts USING (source_id, entity) GROUP BY kind, family
    """,
    "profile_eligible": f"""
        WITH {_fields(TABLES + WEB)}, {_counts(TABLES + WEB)}
        SELECT source_id, entity, path, kind <> 'array' AS eligible, row_count
        FROM fields JOIN counts USING (source_id, entity)
    """,
    "field_profile": f"""
        WITH {_fields()}, {_values()}, {SKETCH},
        tallies AS (
          SELECT fid, count(form) AS sampled, count(*) FILTER (WHERE missing) AS nulls
          FROM cells GROUP BY fid),
        digests AS (
          SELECT fid, string_agg(fp, ',' ORDER BY fp) AS listed FROM sketch GROUP BY fid)
        SELECT source_id, 'public' AS namespace, entity, path, kind AS types,
          family AS type_families, is_key AS primary_key, is_unique AS "unique",
          NOT is_key OR coalesce(nulls, 0) > 0 AS nullable,
          coalesce(sampled, 0) AS sampled_value_count,
          least(coalesce(n, 0), 100) AS distinct_sample_count,
          coalesce(n, 0) AS distinct_count, coalesce(nulls, 0) AS null_count,
          sha256(coalesce(listed, '')) AS fingerprint_digest
        FROM fields LEFT JOIN tallies USING (fid) LEFT JOIN sizes USING (fid)
        LEFT JOIN digests USING (fid)
    """,
    "document_profile": DOCUMENT_PROFILE,
    "measured_uniqueness": f"""
        SELECT *, value_count > 0 AND value_count = distinct_count AS measured_unique
        FROM ({_UNIQUENESS})
    """,
    "field_uniqueness": f"""
        SELECT source_id, entity, path, declared_unique,
               value_count > 0 AND value_count = distinct_count AS measured_unique
        FROM ({_UNIQUENESS})
    """,
    "fingerprint_sketch": FINGERPRINT_SKETCH,
    "fingerprint_sketch_bounded": FINGERPRINT_SKETCH,
    "name_tokens": f"""
        WITH {_fields()}, {_counts()}, {TOKENS}
        SELECT source_id, entity, path, array_to_string(list_sort(toks), ',') AS tokens, row_count
        FROM tokens JOIN counts USING (source_id, entity)
    """,
    "name_similarity": f"""
        WITH {_fields()}, {_counts()}, {TOKENS}, sized AS (
          SELECT tokens.*, row_count FROM tokens JOIN counts USING (source_id, entity))
        SELECT {ENDS}, {_ratio(
            "len(list_intersect(l.toks, r.toks))"
            " / len(list_distinct(list_concat(l.toks, r.toks)))")} AS similarity,
          l.row_count AS left_rows, r.row_count AS right_rows
        FROM sized l JOIN sized r ON l.ord < r.ord AND list_has_any(l.toks, r.toks)
    """,
    "value_overlap": f"""
        WITH {_fields()}, {_values()}, {OVERLAP}
        SELECT {ENDS}, shared, {_ratio("overlap")} AS overlap
        FROM jaccards JOIN fields l ON l.fid = lid JOIN fields r ON r.fid = rid
        WHERE l.ord <> r.ord
    """,
    "value_overlap_screened": f"""
        WITH {_fields()}, {_values()}, {OVERLAP}
        SELECT {ENDS}, shared, {_ratio("overlap")} AS overlap
        FROM jaccards JOIN fields l ON l.fid = lid JOIN fields r ON r.fid = rid
        WHERE l.ord <> r.ord AND l.family = r.family AND overlap >= 0.1
    """,
    "value_overlap_sketch": f"""
        WITH {_fields()}, {_values()}, {SKETCH}, {SKETCH_OVERLAP}
        SELECT {ENDS}, shared, sampled, {_ratio("overlap")} AS overlap
        FROM jaccards JOIN fields l ON l.fid = lid JOIN fields r ON r.fid = rid
        WHERE l.ord <> r.ord
    """,
    "compatible_pairs": f"""
        WITH {_fields()}, {_counts()}, {TOKENS}, sized AS (
          SELECT tokens.*, row_count FROM tokens JOIN counts USING (source_id, entity))
        SELECT {ENDS}, l.family = r.family AND l.family <> 'unknown' AS compatible,
          l.row_count AS left_rows, r.row_count AS right_rows
        FROM sized l JOIN sized r ON l.ord < r.ord AND list_has_any(l.toks, r.toks)
    """,
    "relationship_suggestions": f"{_EXACT} SELECT * FROM suggestions",
    "relationship_suggestions_sketch": f"""
        WITH {_fields()}, {_values()}, {TOKENS}, {SKETCH}, {SKETCH_OVERLAP}, {SUGGEST}
        SELECT * FROM suggestions
    """,
    "validate_relationships": VALIDATE,
    "duplicate_relationships": DUPLICATES,
    "join_inner": """
        SELECT c_custkey AS left_c_custkey, c_name AS left_c_name,
          o_orderkey AS right_o_orderkey, o_totalprice AS right_o_totalprice
        FROM customer JOIN orders ON c_custkey = o_custkey
    """,
    "join_left": """
        SELECT c_custkey AS left_c_custkey, c_name AS left_c_name,
          doc_id AS right_doc_id, quality AS right_quality
        FROM customer LEFT JOIN labels ON c_custkey = doc_id
    """,
    "observed_cardinality": " UNION ALL ".join(
        _cardinality(*row) for row in (
            ("customer", "c_custkey", "orders", "o_custkey", "one-to-many"),
            ("nation", "n_nationkey", "supplier", "s_nationkey", "one-to-many"),
            ("lineitem", "l_partkey", "part", "p_partkey", "many-to-one"),
            ("lineitem", "l_suppkey", "supplier", "s_suppkey", "one-to-one"),
            ("customer", "c_custkey", "labels", "doc_id", "one-to-one"),
        )
    ),
    "sql_bounded": """
        SELECT o_orderkey, c_name, o_totalprice
        FROM orders JOIN customer ON c_custkey = o_custkey
        WHERE o_totalprice > 1000 AND o_orderpriority <> ';'
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000
    """,
    "find_orders": """
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders
        WHERE o_orderstatus = 'F' AND o_totalprice >= 1000
        ORDER BY o_orderpriority NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST
        LIMIT 1000
    """,
    "aggregate_capped": """
        SELECT o_custkey, count(*) AS order_count, max(o_totalprice) AS top_price
        FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey
        ORDER BY order_count DESC, top_price DESC, o_custkey LIMIT 1000
    """,
    "array_membership": """
        SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')
        ORDER BY p_name, p_partkey LIMIT 1000
    """,
    "array_any_match": """
        SELECT p_partkey, p_name FROM part WHERE len(list_filter(string_split(p_name, ' '),
          lambda w: w NOT IN ('small', 'large', 'red', 'blue', 'ring', 'bolt', 'widget'))) > 0
    """,
    "filter_compound": """
        SELECT event_id, event_type, value FROM events
        WHERE value >= 20 AND event_type IN ('purchase', 'signup')
          AND json_exists(props, '$.k') AND NOT json_exists(props, '$.missing')
    """,
    "lookup_nested": """
        SELECT c_custkey, c_mktsegment, count(o_orderkey) AS order_count,
          coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey), '')
            AS orders
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment
    """,
    "lookup_orphans": """
        SELECT doc_id, lang, n_chars FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    """,
    "ordered_string_agg": """
        SELECT c_name, string_agg(DISTINCT o_orderpriority, '/' ORDER BY o_orderpriority)
          AS priorities
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name
    """,
    "row_counts": f"WITH {_counts()} SELECT * FROM counts",
    "tolerant_text_match": """
        SELECT p_partkey, p_name,
          CASE WHEN p_name ILIKE '%small ring%' OR p_name ILIKE '%blue bolt%' THEN 0 ELSE 1 END
            AS match_rank
        FROM part WHERE p_name ILIKE '%small ring%' OR p_name ILIKE '%sma%'
          OR p_name ILIKE '%blue bolt%' OR p_name ILIKE '%blu%'
    """,
    "multi_source_batch": f"""
        WITH {_BATCH}
        SELECT source_id, row_no, count(*) OVER (PARTITION BY source_id) AS returned_count, row
        FROM bounded
    """,
    "multi_source_outcomes": f"""
        WITH {_BATCH}, asked(source_id, kind, stage, status, error) AS (VALUES
          ('source_1', 'relational', 'execute', 'succeeded', NULL),
          ('source_2', 'relational', 'catalog', 'failed', 'Unable to access the relational source.'),
          ('source_3', 'relational', 'execute', 'succeeded', NULL),
          ('source_4', 'document', 'execute', 'failed', 'Unable to access the document source.'),
          ('source_5', 'document', 'execute', 'succeeded', NULL),
          ('source_6', 'relational', 'execute', 'succeeded', NULL),
          ('source_7', 'document', 'execute', 'failed', 'Unable to access the document source.'))
        SELECT asked.*, CASE WHEN status = 'succeeded' THEN coalesce(returned_count, 0) END AS returned_count
        FROM asked LEFT JOIN (
          SELECT source_id, count(*) AS returned_count FROM bounded GROUP BY source_id)
        USING (source_id)
    """,
    "pack_rows_per_group": """
        WITH rows AS (
          SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
            length(CAST(to_json({'turn': turn, 'role': role, 'text': text}) AS VARCHAR)) AS chars
          FROM conversations),
        running AS (
          SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY rn) AS used FROM rows)
        SELECT conv_id, count(*) FILTER (WHERE rn <= 6 AND used <= 3000) AS kept_rows,
          coalesce(max(used) FILTER (WHERE rn <= 6 AND used <= 3000), 0)::BIGINT AS kept_chars,
          bool_or(rn > 6 OR used > 3000) AS truncated
        FROM running GROUP BY conv_id
    """,
    "pack_rows_shared": PACK_SHARED,
    "expect_row_counts": f"""
        WITH {_counts()}
        SELECT entity, row_count, expected, row_count = expected AS as_expected
        FROM counts LEFT JOIN (VALUES ('region', 5::BIGINT), ('nation', 25), ('labels', 1))
          AS wanted(entity, expected) USING (entity)
    """,
    "expect_domains": _domain(
        "lineitem",
        linestatus_listed="l_linestatus IN ('O', 'F')",
        returnflag_constant="l_returnflag = 'N'",
        quantity_in_range="l_quantity BETWEEN 1 AND 50",
        discount_below="l_discount < 0.1::DOUBLE",
    ) + " UNION ALL " + _domain(
        "orders", status_listed="o_orderstatus IN ('O', 'F')", price_positive="o_totalprice > 0"
    ),
    "expect_unique": " UNION ALL ".join((
        _unique("customer", "c_custkey"),
        _unique("part", "p_name"),
        _unique("lineitem", "l_orderkey", "l_linenumber"),
        _unique("conversations", "conv_id", "turn"),
    )),
    "expect_references": " UNION ALL ".join((
        _reference("orders", "o_custkey", "customer", "c_custkey"),
        _reference("lineitem", "l_orderkey", "orders", "o_orderkey"),
        _reference("lineitem", "l_partkey", "part", "p_partkey"),
        _reference("documents", "doc_id", "labels", "doc_id"),
        _reference("events", "user_id", "supplier", "s_suppkey"),
    )),
}
