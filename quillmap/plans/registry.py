"""All queries of the core by name, and the same as SQL where SQL can say it."""

from __future__ import annotations

from quillmap.plans import base, evidence, maps, panels, programs, quality, tables

QUERIES, SQL = base.QUERIES, base.SQL
MODULES = (evidence, maps, panels, programs, quality, tables)

for _f in (
    evidence.p2_found, evidence.p2_runs, evidence.p2_deltas, evidence.p2_signatures, evidence.p2_runs_full, evidence.p2_panels, evidence.p2_purities, evidence.p2_corpora,
    evidence.p2_arm_means, evidence.p2_values, evidence.p2_events, panels.p3_found, panels.p3_scripts, panels.p3_table,
):
    QUERIES[_f.__name__] = _f

SQL["p2_signatures"] = """
    WITH e AS (SELECT registry_id, unnest(events) AS e FROM status_registry),
         s AS (SELECT registry_id, e.event_id AS event_id, unnest(e.source_signatures) AS s FROM e WHERE e.event_id IS NOT NULL)
    SELECT DISTINCT registry_id, event_id, s.path AS path, s.sha256 AS sha256 FROM s WHERE s.path IS NOT NULL"""

_MEMBERS = """{out} AS (SELECT record_id, {up}k AS {name}, json_extract(o, '$."' || k || '"') AS e FROM (SELECT record_id, {up}o, unnest(json_keys(o)) AS k FROM (SELECT record_id, {up}json_extract({of}, '$.{label}') AS o FROM {source} WHERE json_type({of}, '$.{label}') = 'OBJECT'))
        UNION ALL SELECT record_id, {up}json_extract_string(e, '$.{own}'), e FROM (SELECT record_id, {up}unnest(json_extract({of}, '$.{label}[*]')) AS e FROM {source} WHERE json_type({of}, '$.{label}') = 'ARRAY')),
    {out}_ AS (SELECT * FROM {out} WHERE json_type(e) = 'OBJECT' AND {name} IS NOT NULL)"""

_BODIES = f"""
    WITH s AS (SELECT DISTINCT record_id, body FROM evidence_docs WHERE json_valid(body)),
    t AS (SELECT record_id, CASE WHEN json_type(body) = 'VARCHAR' THEN json_extract_string(body, '$') ELSE body END AS j FROM s),
    b AS (SELECT record_id, CASE WHEN json_type(j, '$.payload') IS NOT NULL AND json_type(j, '$.runs') IS NULL AND json_type(j, '$.corpora') IS NULL THEN json_extract(j, '$.payload') ELSE j::JSON END AS j FROM t WHERE json_valid(j)),
    {_MEMBERS.format(out="runs", name="run", of="j", label="runs", own="label", source="b", up="")},
    {_MEMBERS.format(out="corpora", name="corpus", of="j", label="corpora", own="corpus", source="b", up="")},
    panels AS (SELECT record_id, run, json_extract(e, '$.panel_full') AS p FROM runs_ WHERE json_type(e, '$.panel_full') = 'OBJECT'),
    purities AS (SELECT record_id, run, k FROM (SELECT record_id, run, json_extract(p, '$.purity') AS o, unnest(json_keys(json_extract(p, '$.purity'))) AS k FROM panels WHERE json_type(p, '$.purity') = 'OBJECT') WHERE json_type(o, '$."' || k || '"') <> 'NULL'),
    flat AS (SELECT record_id, corpus, json_extract_string(d, '$.contrast') AS contrast, json_extract_string(d, '$.metric') AS metric, d FROM (SELECT record_id, corpus, unnest(json_extract(e, '$.paired_deltas[*]')) AS d FROM corpora_ WHERE json_type(e, '$.paired_deltas') = 'ARRAY') WHERE json_type(d) = 'OBJECT'),
    contrasts AS (SELECT record_id, corpus, k AS contrast, json_extract(o, '$."' || k || '"') AS m FROM (SELECT record_id, corpus, json_extract(e, '$.paired_deltas') AS o, unnest(json_keys(json_extract(e, '$.paired_deltas'))) AS k FROM corpora_ WHERE json_type(e, '$.paired_deltas') = 'OBJECT')),
    nested AS (SELECT record_id, corpus, contrast, k AS metric, json_extract(m, '$."' || k || '"') AS d FROM (SELECT record_id, corpus, contrast, m, unnest(json_keys(m)) AS k FROM contrasts WHERE json_type(m) = 'OBJECT')),
    deltas AS (SELECT * FROM flat UNION ALL SELECT * FROM nested WHERE json_type(d) = 'OBJECT')"""

SQL["p2_found"] = f"""{_BODIES},
    ev AS (SELECT registry_id, unnest(events) AS e FROM status_registry), sg AS (SELECT registry_id, e.event_id AS event_id, unnest(e.source_signatures) AS s FROM ev WHERE e.event_id IS NOT NULL)
    SELECT DISTINCT * FROM (
        SELECT 'evidence_docs' AS origin, record_id, 'run' AS entity, '' AS parent_key, run AS child_key FROM runs_
        UNION ALL SELECT 'evidence_docs', record_id, 'panel', run, 'panel_full' FROM panels
        UNION ALL SELECT 'evidence_docs', record_id, 'purity', run, k FROM purities
        UNION ALL SELECT 'evidence_docs', record_id, 'corpus', '', corpus FROM corpora_
        UNION ALL SELECT 'evidence_docs', record_id, 'delta', corpus, contrast || '/' || metric FROM deltas
        UNION ALL SELECT 'status_registry', registry_id, 'event', '', e.event_id FROM ev WHERE e.event_id IS NOT NULL
        UNION ALL SELECT 'status_registry', registry_id, 'signature', event_id, s.path FROM sg WHERE s.path IS NOT NULL)"""

SQL["p2_deltas"] = f"""{_BODIES}
    SELECT DISTINCT record_id, corpus, contrast, metric, try_cast(json_extract_string(d, '$.mean') AS DOUBLE) AS mean, try_cast(json_extract_string(d, '$.sd') AS DOUBLE) AS sd, try_cast(json_extract_string(d, '$.n') AS BIGINT) AS n FROM deltas"""

_FIELD = "try_cast(json_extract_string(e, '$.\"{}\"') AS {}) AS {}"
SQL["p2_runs"] = f"""{_BODIES}
    SELECT DISTINCT record_id, run, {_FIELD.format("run_dir", "VARCHAR", "run_dir")}, {_FIELD.format("wall_s", "DOUBLE", "wall_s")}, {_FIELD.format("ffr", "DOUBLE", "ffr")}, {_FIELD.format("density", "DOUBLE", "density")},
        {_FIELD.format("recall@k", "DOUBLE", "recall_at_k")}, {_FIELD.format("hiD_reference_key", "VARCHAR", "hiD_reference_key")}, {_FIELD.format("no_model_reference", "BOOLEAN", "no_model_reference")} FROM runs_"""

def _wide(of: str, fields: dict[str, str]) -> str:
    types = {"string": "VARCHAR"}
    return ", ".join(f"try_cast(json_extract_string({of}, '$." + ".".join(f'"{x}"' for x in p.split(".")) + f"') AS {types.get(k, k)}) AS {evidence.column_of(p)}" for p, k in fields.items())


SQL["p2_runs_full"] = f"{_BODIES} SELECT DISTINCT record_id, run, {_wide('e', evidence._FIELDS['run'])} FROM runs_"
SQL["p2_panels"] = f"{_BODIES} SELECT DISTINCT record_id, run, {_wide('p', evidence._FIELDS['panel'])} FROM panels"
SQL["p2_corpora"] = f"{_BODIES} SELECT DISTINCT record_id, corpus, {_wide('e', evidence._FIELDS['corpus'])} FROM corpora_"
SQL["p2_purities"] = f"""{_BODIES} SELECT DISTINCT record_id, run, u.k AS purity, try_cast(json_extract_string(p, '$.purity."' || u.k || '"') AS DOUBLE) AS value
    FROM (SELECT record_id, run, p, unnest(json_keys(json_extract(p, '$.purity'))) AS k FROM panels WHERE json_type(p, '$.purity') = 'OBJECT') u WHERE json_type(p, '$.purity."' || u.k || '"') <> 'NULL'"""
SQL["p2_arm_means"] = f"""{_BODIES},
    am AS (SELECT record_id, corpus, json_extract(e, '$.arm_means') AS a FROM corpora_ WHERE json_type(e, '$.arm_means') = 'OBJECT'),
    mt AS (SELECT record_id, corpus, k AS metric, json_extract(a, '$."' || k || '"') AS m FROM (SELECT *, unnest(json_keys(a)) AS k FROM am)),
    ar AS (SELECT record_id, corpus, metric, k AS arm, m FROM (SELECT *, unnest(json_keys(m)) AS k FROM mt WHERE json_type(m) = 'OBJECT'))
    SELECT DISTINCT record_id, corpus, metric, arm, try_cast(json_extract_string(m, '$."' || arm || '"') AS DOUBLE) AS mean FROM ar WHERE json_type(m, '$."' || arm || '"') <> 'NULL'"""
SQL["p2_events"] = """
    SELECT DISTINCT registry_id, e.event_id AS event_id, e.evidence_id AS evidence_id, e.recorded_utc AS recorded_utc, e.status AS status, e.reason AS reason, e.reviewer_source.uri AS reviewer_source_uri,
        e.reviewer_source.sha256 AS reviewer_source_sha256, e.replaces AS replaces, e.superseded_by AS superseded_by, e.diagnostic_only AS diagnostic_only
    FROM (SELECT registry_id, unnest(events) AS e FROM status_registry) WHERE e.event_id IS NOT NULL"""

SQL["p3_found"] = """
    WITH RECURSIVE w AS (SELECT DISTINCT stream, file_name, written_at, body::JSON AS j FROM panel_lines WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
    m(stream, file_name, written_at, run, path, kind, v) AS (
        SELECT stream, file_name, written_at, json_extract_string(j, '$.run_dir'), k, json_type(j, '$."' || k || '"'), json_extract(j, '$."' || k || '"') FROM (SELECT *, unnest(json_keys(j)) AS k FROM w)
        UNION ALL SELECT stream, file_name, written_at, run, path || '.' || k, json_type(v, '$."' || k || '"'), json_extract(v, '$."' || k || '"') FROM (SELECT *, unnest(json_keys(v)) AS k FROM m WHERE kind = 'OBJECT')),
    x AS (SELECT stream, file_name, written_at, run, path, CASE kind WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind,
        CASE WHEN kind IN ('VARCHAR', 'BOOLEAN', 'ARRAY', 'OBJECT', 'NULL') THEN json_extract_string(v, '$') ELSE (json_extract_string(v, '$')::DOUBLE)::VARCHAR END AS val FROM m),
    s AS MATERIALIZED (SELECT stream, file_name, written_at, path, string_agg(DISTINCT kind, '/' ORDER BY kind) AS kinds FROM x GROUP BY ALL),
    p AS (SELECT * FROM (SELECT stream, file_name AS later, lag(file_name) OVER (PARTITION BY stream ORDER BY written_at, file_name) AS before FROM (SELECT DISTINCT stream, file_name, written_at FROM s)) WHERE before IS NOT NULL),
    gone AS (SELECT p.stream, before, later, path FROM p JOIN s ON s.stream = p.stream AND s.file_name = before WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.stream = p.stream AND t.file_name = later AND t.path = s.path)),
    came AS (SELECT p.stream, before, later, path FROM p JOIN s ON s.stream = p.stream AND s.file_name = later WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.stream = p.stream AND t.file_name = before AND t.path = s.path)),
    val AS MATERIALIZED (SELECT DISTINCT stream, file_name, run, path, kind, val FROM x WHERE kind IS NOT NULL AND run IS NOT NULL),
    ren AS (SELECT g.later, g.path AS old_path, c.path AS new_path FROM gone g JOIN came c ON c.stream = g.stream AND c.later = g.later JOIN val a ON a.stream = g.stream AND a.file_name = g.before AND a.path = g.path
        JOIN val b ON b.stream = g.stream AND b.file_name = g.later AND b.path = c.path AND b.run = a.run GROUP BY ALL HAVING bool_and(a.kind = b.kind AND a.kind <> 'object' AND a.val = b.val))
    SELECT later AS file_name, 'renamed' AS change_kind, old_path, new_path FROM ren
    UNION ALL SELECT later, 'added', '', path FROM came WHERE (later, path) NOT IN (SELECT (later, new_path) FROM ren)
    UNION ALL SELECT later, 'removed', path, '' FROM gone WHERE (later, path) NOT IN (SELECT (later, old_path) FROM ren)
    UNION ALL SELECT later, 'retyped', a.path, a.path FROM p JOIN s a ON a.stream = p.stream AND a.file_name = before JOIN s b ON b.stream = p.stream AND b.file_name = later AND b.path = a.path WHERE a.kinds <> b.kinds"""
