"""The registered queries in SQL for DuckDB, written independently of the Spark plans.

Set differences are anti-joins here and one aggregate there; continuations are joined by a
window here and by one regex there; fields are split here and matched there.
"""

from __future__ import annotations

import re

_SPACE = (
    r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
_TRIM = rf"'\A{_SPACE}+|{_SPACE}+\z', '', 'g'"
_NAME = "[A-Z][A-Z0-9_]*"

# Relations in terms of earlier ones; a query includes those it mentions.
_CTES = {
    "doc_kind": """
      SELECT *, q % 10 AS kind,
        concat('VAR_', CAST((doc_id * 7) % 61 AS VARCHAR)) AS v1,
        concat('VAR_', CAST((doc_id * 11 + 3) % 59 AS VARCHAR)) AS v2
      FROM (SELECT doc_id, source AS project, text, CAST(doc_id // 20 AS BIGINT) AS q FROM documents)""",
    "all_files": """
      SELECT project,
        concat(project, CASE kind
          WHEN 0 THEN concat('/pkg/f', doc_id, '.js') WHEN 1 THEN concat('/pkg-a/f', doc_id, '.ts')
          WHEN 2 THEN concat('/cmd/f', doc_id, '.go') WHEN 3 THEN concat('/pkg.py/f', doc_id, '.py')
          WHEN 4 THEN concat('/svc', doc_id, '/Dockerfile')
          WHEN 5 THEN concat('/deploy/f', doc_id, '.dockerfile')
          WHEN 6 THEN concat('/vendor/f', doc_id, '.js') WHEN 7 THEN concat('/docs/f', doc_id, '.md')
          WHEN 8 THEN concat('/Dockerfile.f', doc_id, '.py')
          ELSE concat('/gen/f', doc_id, '.ts') END) AS path,
        concat(text, chr(10), CASE
          WHEN kind IN (0, 1, 6, 9) THEN concat(
            'const a = process.env.', v1, '; f(process.env["', v2, '"], process.env[''', v1, ''']);',
            chr(13), chr(10), 'process.env[key]; process.env.Mixed; process.env.lower', chr(10))
          WHEN kind = 2 THEN concat('a := os.Getenv("', v1, '")', chr(10),
            'b, ok := os.LookupEnv("', v2, '"); os.Getenv(name)', chr(10))
          WHEN kind = 3 THEN concat('a = os.getenv("', v1, '"); b = os.environ[''', v2, ''']', chr(10),
            'c = os.environ["', v1, '"]; os.getenv("', v2, '", "x")')
          WHEN kind IN (4, 5, 8) THEN concat(
            CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat('from node AS b', chr(10)) END,
            'ENV ', v1, '=1 ', chr(92), ' ', chr(10), '    D_', v2, '=2 lower=3', chr(10),
            'ARG B_', v1, '=x', chr(10), 'ENV ', v2, ' plain', chr(10), '# $COMMENTED', chr(10),
            'RUN echo $', v1, ' ${', v1, '} ${U_', v2, ':-d} $', v2)
          ELSE 'process.env.IGNORED_MD' END,
          CASE WHEN doc_id % 97 = 5 THEN concat(chr(10), repeat('x', 70000)) ELSE '' END) AS content
      FROM doc_kind""",
    "part_lines": """
      SELECT *, CASE WHEN n % 9 = 4 THEN concat('# VAR_', n, '=off')
                     WHEN n % 9 = 7 THEN concat('export VAR_', n, '=1')
                     WHEN n % 9 = 8 THEN concat('var_', n, '=1')
                     ELSE concat(CASE WHEN n % 2 = 0 THEN '  ' ELSE '' END, 'VAR_', n, ' =a=b') END AS line
      FROM (SELECT p_partkey, concat('src', CAST(p_partkey % 20 AS VARCHAR)) AS project,
              (p_partkey // 20) % 3 AS env_kind, (p_partkey // 60) % 50 AS n FROM part)""",
    "all_env": """
      SELECT project, env_kind::INT AS ordinal,
        CASE env_kind WHEN 0 THEN '.env' WHEN 1 THEN '.env.local' ELSE '.env.production' END AS env_path,
        CASE WHEN project = 'src7' OR (project = 'src3' AND env_kind = 2) THEN NULL
             ELSE string_agg(line, chr(10) ORDER BY first_part) END AS content
      FROM (SELECT project, env_kind, line, min(p_partkey) AS first_part FROM part_lines GROUP BY ALL)
      GROUP BY project, env_kind""",
    "named": r"""
      SELECT *, string_split(path, '/') AS comps, string_split(path, '/')[-1] AS base,
        regexp_extract(string_split(path, '/')[-1], '(\.[^.]*)$', 1) AS ext
      FROM all_files""",
    "labelled": """
      SELECT *, (base LIKE 'Dockerfile%' OR ext = '.dockerfile') AS docker,
        ext IN ('.js', '.ts', '.go', '.py') AS code,
        len(list_filter(string_split(content, chr(10)), lambda x: strlen(x) >= 65536)) > 0 AS too_long,
        LIMITED AND too_long AS oversize
      FROM named""",
    "kept": """
      SELECT * FROM labelled WHERE (docker OR code)
        AND NOT list_has_any(comps[:-2], ['.git', 'node_modules', 'vendor', 'gen'])""",
    "phys": r"""
      SELECT project, path, docker, oversize, ext, unnest(range(1, len(ls) + 1)) AS line_no,
        regexp_replace(unnest(ls), '\r\z', '') AS text
      FROM (SELECT *, CASE WHEN content = '' THEN []
              ELSE string_split(regexp_replace(content, '\n\z', ''), chr(10)) END AS ls FROM kept)""",
    "joined_pieces": r"""
      SELECT *, 1 + coalesce(sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (
          PARTITION BY project, path ORDER BY line_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS logical_no,
        CASE WHEN goes_on THEN regexp_replace(text, '\\[ \t]*\z', '') || ' ' ELSE text END AS piece
      FROM (SELECT *, regexp_matches(text, '\\[ \t]*\z') AS goes_on FROM phys WHERE docker)""",
    "logical": """
      SELECT project, path, any_value(oversize) AS oversize, logical_no::INT AS line_no,
        string_agg(piece, '' ORDER BY line_no) AS text
      FROM joined_pieces GROUP BY project, path, logical_no""",
    "trimmed": rf"""
      SELECT project, path, oversize, line_no, regexp_replace(text, {_TRIM}) AS text FROM logical""",
    "with_from": r"""
      SELECT DISTINCT project, path FROM trimmed
      WHERE NOT oversize AND text <> '' AND text NOT LIKE '#%' AND regexp_matches(text, '(?i)^FROM\s+')""",
    "significant": """
      SELECT project, path, line_no, text FROM trimmed SEMI JOIN with_from USING (project, path)
      WHERE text <> '' AND text NOT LIKE '#%'""",
    "env_rest": rf"""
      SELECT project, path, line_no, regexp_replace(regexp_extract(text, '(?i)^ENV\s+(.+)', 1), {_TRIM}) AS rest
      FROM significant WHERE regexp_matches(text, '(?i)^ENV\s+(.+)')""",
    "docker_env": rf"""
      SELECT project, path, line_no, variable FROM (
        SELECT project, path, line_no, unnest(CASE WHEN contains(rest, '=')
          THEN list_transform(list_filter(words, lambda w: instr(w, '=') > 1), lambda w: split_part(w, '=', 1))
          ELSE words[1:1] END) AS variable
        FROM (SELECT *, list_filter(string_split_regex(rest, '{_SPACE}+'), lambda w: w <> '') AS words FROM env_rest))
      WHERE regexp_matches(variable, '^{_NAME}$')""",
    "docker_arg": rf"""
      SELECT project, path, line_no, variable FROM (
        SELECT project, path, line_no, regexp_replace(
          CASE WHEN instr(rest, '=') > 1 THEN split_part(rest, '=', 1) ELSE rest END, {_TRIM}) AS variable
        FROM (SELECT *, regexp_replace(regexp_extract(text, '(?i)^ARG\s+(.+)', 1), {_TRIM}) AS rest
              FROM significant WHERE regexp_matches(text, '(?i)^ARG\s+(.+)')))
      WHERE regexp_matches(variable, '^{_NAME}$')""",
    "docker_decl": """
      SELECT project, variable FROM docker_env UNION SELECT project, variable FROM docker_arg""",
    "docker_uses": rf"""
      SELECT project, path, line_no, unnest(list_distinct(
        regexp_extract_all(text, '\$\{{?({_NAME})\}}?', 1))) AS variable FROM significant""",
    "js_uses": rf"""
      SELECT project, path, line_no::INT AS line_no, unnest(
        regexp_extract_all(text, 'process\.env\.({_NAME})', 1)
        || regexp_extract_all(text, 'process\.env\["({_NAME})"\]', 1)
        || regexp_extract_all(text, 'process\.env\[''({_NAME})''\]', 1)) AS variable
      FROM phys WHERE NOT docker AND NOT oversize AND ext IN ('.js', '.ts')""",
    "go_uses": rf"""
      SELECT project, path, line_no::INT AS line_no, unnest(
        regexp_extract_all(text, 'os\.Getenv\("({_NAME})"\)', 1)
        || regexp_extract_all(text, 'os\.LookupEnv\("({_NAME})"\)', 1)) AS variable
      FROM phys WHERE NOT docker AND NOT oversize AND ext = '.go'""",
    "py_uses": rf"""
      SELECT project, path, line_no::INT AS line_no, unnest(
        regexp_extract_all(text, 'os\.getenv\("({_NAME})"\)', 1)
        || regexp_extract_all(text, 'os\.environ\["({_NAME})"\]', 1)
        || regexp_extract_all(text, 'os\.environ\[''({_NAME})''\]', 1)) AS variable
      FROM phys WHERE NOT docker AND NOT oversize AND ext = '.py'""",
    "code_uses": """
      SELECT * FROM js_uses UNION ALL SELECT * FROM go_uses UNION ALL SELECT * FROM py_uses""",
    "env_read": """
      SELECT * FROM all_env WHERE content IS NOT NULL
        AND NOT (LIMITED AND len(list_filter(string_split(content, chr(10)), lambda x: strlen(x) >= 65536)) > 0)""",
    "env_lines": rf"""
      SELECT project, ordinal, env_path,
        regexp_replace(unnest(string_split(content, chr(10))), {_TRIM}) AS text FROM env_read""",
    "env_decl": rf"""
      SELECT DISTINCT project, ordinal, env_path, regexp_extract(text, '^({_NAME})\s*=', 1) AS variable
      FROM env_lines WHERE text NOT LIKE '#%' AND regexp_matches(text, '^({_NAME})\s*=')""",
    "env_names": "SELECT DISTINCT project, variable FROM env_decl",
    "env_last": """
      SELECT project, variable, arg_max(env_path, ordinal) AS declared_source
      FROM env_decl GROUP BY project, variable""",
    "used_names": "SELECT DISTINCT project, variable FROM code_uses",
    "first_code": """
      SELECT project, variable, path, line_no FROM (
        SELECT *, row_number() OVER (PARTITION BY project, variable
          ORDER BY string_split(path, '/'), line_no) AS rn FROM code_uses) WHERE rn = 1""",
    "first_docker": """
      SELECT project, variable, path, line_no FROM (
        SELECT *, row_number() OVER (PARTITION BY project, variable
          ORDER BY string_split(path, '/'), line_no) AS rn FROM docker_uses) WHERE rn = 1""",
    "env001": "SELECT * FROM env_names ANTI JOIN used_names USING (project, variable)",
    "env002": "SELECT * FROM first_code ANTI JOIN env_names USING (project, variable)",
    "env003": """
      SELECT * FROM first_code ANTI JOIN (SELECT * FROM env_names UNION SELECT * FROM docker_decl)
      USING (project, variable)""",
    "env004": "SELECT * FROM docker_decl ANTI JOIN used_names USING (project, variable)",
    "env005": "SELECT * FROM first_docker ANTI JOIN docker_decl USING (project, variable)",
    "audited": "SELECT DISTINCT project FROM env_read",
    "found": """
      SELECT project, rule_id, CASE WHEN rule_id IN ('ENV002', 'ENV005') THEN 'error' ELSE 'warning' END AS level,
        variable, variable || ': ' || CASE rule_id
          WHEN 'ENV001' THEN 'Variable is declared in .env but not used in code'
          WHEN 'ENV002' THEN 'Variable is used in code but not declared in .env'
          WHEN 'ENV003' THEN 'Variable is used in code but not declared in Dockerfile or .env'
          WHEN 'ENV004' THEN 'Variable is declared in Dockerfile but not used in code'
          ELSE 'Variable is used in Dockerfile but not declared' END AS message,
        path, line_no::INT AS line_no, declared_source
      FROM (
        SELECT project, 'ENV001' AS rule_id, variable, NULL AS path, NULL AS line_no, declared_source
          FROM env001 JOIN env_last USING (project, variable)
        UNION ALL SELECT project, 'ENV002', variable, path, line_no, NULL FROM env002
        UNION ALL SELECT project, 'ENV003', variable, path, line_no, NULL FROM env003
        UNION ALL SELECT project, 'ENV004', variable, NULL, NULL, NULL FROM env004
        UNION ALL SELECT project, 'ENV005', variable, path, line_no, NULL FROM env005)
      SEMI JOIN audited USING (project)""",
    "counted": """
      SELECT project,
        (SELECT count(*) FILTER (docker) + count(*) FILTER (code) FROM kept k WHERE k.project = a.project) AS files_scanned,
        (SELECT count(*) FROM env_names e WHERE e.project = a.project) AS variables_declared,
        (SELECT count(*) FROM used_names u WHERE u.project = a.project) AS variables_used,
        (SELECT count(*) FROM found f WHERE f.project = a.project) AS mismatches_found
      FROM audited a""",
    "by_rule": """
      SELECT a.project, count(*) FILTER (rule_id = 'ENV001') AS n1, count(*) FILTER (rule_id = 'ENV002') AS n2,
        count(*) FILTER (rule_id = 'ENV003') AS n3, count(*) FILTER (rule_id = 'ENV004') AS n4,
        count(*) FILTER (rule_id = 'ENV005') AS n5
      FROM audited a LEFT JOIN found USING (project) GROUP BY a.project""",
    "active_rules": """
      SELECT project, rule_id, (row_number() OVER (PARTITION BY project ORDER BY rule_id) - 1)::INT AS rule_index
      FROM (SELECT DISTINCT project, rule_id FROM found)""",
    "sarif_ordered": """
      SELECT project, row_number() OVER (PARTITION BY project ORDER BY rule_id, message) AS pos,
        rule_id, rule_index, level, variable, message, path, line_no, declared_source
      FROM found JOIN active_rules USING (project, rule_id)""",
    "placed": """
      SELECT project, variable, path, line_no, row_number() OVER (PARTITION BY project, variable
        ORDER BY string_split(path, '/'), line_no) AS pos FROM code_uses""",
    "entries": """
      SELECT project, section, variable, path, line_no,
        row_number() OVER (PARTITION BY project, section ORDER BY variable) AS item
      FROM (
        SELECT project, CASE rule_id WHEN 'ENV001' THEN 1 WHEN 'ENV002' THEN 2 WHEN 'ENV003' THEN 4
          WHEN 'ENV004' THEN 5 ELSE 6 END AS section, variable, path, line_no FROM found
        UNION ALL SELECT project, 3, variable, declared_source, NULL FROM env_last SEMI JOIN audited USING (project))""",
    "rule_text": """
      SELECT * FROM (VALUES
        ('ENV001', 'unused-variable', 'Variable is declared in .env but not used in code'),
        ('ENV002', 'missing-variable', 'Variable is used in code but not declared in .env'),
        ('ENV003', 'code-uses-not-in-docker', 'Variable is used in code but not declared in Dockerfile or .env'),
        ('ENV004', 'docker-declares-unused', 'Variable is declared in Dockerfile but not used in code'),
        ('ENV005', 'docker-uses-undeclared', 'Variable is used in Dockerfile but not declared')
      ) r(rule_id, name, description)""",
    "text_lines": """
      SELECT project, row_number() OVER (PARTITION BY project ORDER BY section, sub, variable) AS line_no, text
      FROM (
        SELECT project, 0 AS section, 0 AS sub, '' AS variable, 'No environment mismatches found.' AS text
          FROM by_rule WHERE n1 = 0 AND n2 = 0
        UNION ALL SELECT project, 1, 1, '', 'Declared but unused:' FROM by_rule WHERE n1 > 0
        UNION ALL SELECT project, 2, 0, '', '' FROM by_rule WHERE n1 > 0 AND n2 > 0
        UNION ALL SELECT project, 2, 1, '', 'Used but not declared:' FROM by_rule WHERE n2 > 0
        UNION ALL SELECT project, 3, 0, '', '' FROM by_rule WHERE n3 > 0
        UNION ALL SELECT project, 3, 1, '', 'Code uses variables not in Dockerfile or .env:' FROM by_rule WHERE n3 > 0
        UNION ALL SELECT project, 4, 0, '', '' FROM by_rule WHERE n4 > 0
        UNION ALL SELECT project, 4, 1, '', 'Dockerfile declares but code doesn''t use:' FROM by_rule WHERE n4 > 0
        UNION ALL SELECT project, 5, 0, '', '' FROM by_rule WHERE n5 > 0
        UNION ALL SELECT project, 5, 1, '', 'Dockerfile uses undeclared variables:' FROM by_rule WHERE n5 > 0
        UNION ALL SELECT project, right(rule_id, 1)::INT, 2, variable,
          CASE WHEN path IS NULL THEN '- ' || variable
               ELSE '- ' || variable || ' (' || path || ':' || line_no || ')' END FROM found)""",
}

_TOOL_URI = "https://example.org/envtally"

_QUERIES = {
    "candidate_files": "SELECT project, path FROM labelled WHERE docker OR code",
    "prune_ignored": """
      SELECT project, path FROM named
      WHERE NOT list_has_any(comps[:-2], ['.git', 'node_modules', 'vendor', 'gen'])""",
    "classify_files": """
      SELECT project, path, CASE WHEN docker THEN 'docker' ELSE 'source' END AS kind, ext AS lang,
        (docker::INT + code::INT)::INT AS multiplicity FROM kept""",
    "env_sources": "SELECT project, ordinal, env_path, content FROM env_read",
    "warnings": """
      SELECT project, env_path AS path, 'env' AS stage,
        CASE WHEN content IS NULL THEN 'unreadable' ELSE 'oversize' END AS reason
      FROM all_env ANTI JOIN env_read USING (project, ordinal)
      UNION ALL
      SELECT project, path, CASE WHEN docker THEN 'dockerfile' ELSE 'source' END, 'oversize'
      FROM kept SEMI JOIN audited USING (project) WHERE oversize
      UNION ALL
      SELECT project, path, 'dockerfile', 'oversize'
      FROM kept SEMI JOIN audited USING (project) WHERE oversize AND docker AND code""",
    "split_lines": "SELECT project, path, line_no::INT AS line_no, text FROM phys",
    "oversize_files": "SELECT project, path FROM kept WHERE too_long",
    "logical_lines": "SELECT project, path, line_no, text FROM logical",
    "significant_lines": "SELECT project, path, line_no, text FROM significant",
    "env_declarations": "SELECT project, ordinal, env_path, variable FROM env_decl",
    "js_references": "SELECT project, path, line_no, variable FROM js_uses",
    "go_references": "SELECT project, path, line_no, variable FROM go_uses",
    "python_references": "SELECT project, path, line_no, variable FROM py_uses",
    "code_references": "SELECT project, path, line_no, variable FROM code_uses",
    "valid_dockerfiles": "SELECT project, path FROM with_from",
    "docker_env_declarations": "SELECT project, path, line_no, variable FROM docker_env",
    "docker_arg_declarations": "SELECT project, path, line_no, variable FROM docker_arg",
    "docker_references": "SELECT project, path, line_no, variable FROM docker_uses",
    "valid_names": rf"""
      SELECT word, regexp_matches(word, '^{_NAME}$') AS valid, count(*) AS occurrences
      FROM (SELECT unnest(string_split_regex(text, '{_SPACE}+')) AS word FROM phys)
      WHERE word <> '' GROUP BY word""",
    "docker_declarations": "SELECT project, variable FROM docker_decl",
    "env_precedence": "SELECT project, variable, declared_source FROM env_last",
    "used_variables": "SELECT project, variable FROM used_names",
    "all_locations": "SELECT project, variable, pos, path, line_no FROM placed",
    "first_locations": "SELECT project, variable, path, line_no FROM first_code",
    "docker_first_locations": "SELECT project, variable, path, line_no FROM first_docker",
    "unused": "SELECT project, variable FROM env001",
    "missing": "SELECT project, variable, path, line_no FROM env002",
    "code_uses_not_in_docker": "SELECT project, variable, path, line_no FROM env003",
    "docker_declares_unused": "SELECT project, variable FROM env004",
    "docker_uses_undeclared": "SELECT project, variable, path, line_no FROM env005",
    "findings": "SELECT * FROM found",
    "summary": "SELECT * FROM counted",
    "gate": """
      SELECT project, CASE WHEN a.project IS NULL THEN 2
        WHEN EXISTS (SELECT 1 FROM found f WHERE f.project = p.project) THEN 1 ELSE 0 END::INT AS status
      FROM (SELECT project FROM all_files UNION SELECT project FROM all_env) p
      LEFT JOIN audited a USING (project)""",
    "text_report": "SELECT * FROM text_lines",
    "write_reports": "SELECT project, text FROM text_lines",
    "json_report": """
      SELECT project, 1 AS section, 0::BIGINT AS item, 0::BIGINT AS part,
        '{"summary":' || to_json({'files_scanned': files_scanned, 'variables_declared': variables_declared,
          'variables_used': variables_used, 'mismatches_found': mismatches_found})::VARCHAR || ',"unused":[' AS text
      FROM counted
      UNION ALL SELECT project, s.section, 0, 0,
        CASE WHEN s.section = 3 AND n2 > 0 OR s.section = 5 AND n3 > 0 THEN ']}' ELSE '' END || s.text
      FROM by_rule, (VALUES
        (2, '],"missing":['), (3, '],"declared_sources":{'),
        (4, '},"dockerfile_issues":{"code_uses_not_in_docker":['), (5, '],"docker_declares_unused":['),
        (6, '],"docker_uses_undeclared":['), (7, ']}}')) s(section, text)
      UNION ALL SELECT project, section, item, 0, CASE WHEN item = 1 THEN ''
          WHEN section IN (2, 4) THEN ']},' ELSE ',' END || CASE
          WHEN section IN (1, 5) THEN to_json(variable)::VARCHAR
          WHEN section = 3 THEN to_json(variable)::VARCHAR || ':' || to_json(path)::VARCHAR
          WHEN section = 6 THEN to_json({'variable': variable,
            'location': {'FilePath': path, 'LineNumber': line_no}})::VARCHAR
          ELSE '{"variable":' || to_json(variable)::VARCHAR || ',"locations":[' END FROM entries
      UNION ALL SELECT project, section, item, pos, CASE WHEN pos > 1 THEN ',' ELSE '' END
          || to_json({'FilePath': p.path, 'LineNumber': p.line_no})::VARCHAR
        FROM (SELECT project, section, item, variable FROM entries WHERE section IN (2, 4))
        JOIN placed p USING (project, variable)""",
    "sarif_results": "SELECT * FROM sarif_ordered",
    "sarif_rules": f"""
      SELECT project, rule_id, rule_index, name, description, '{_TOOL_URI}#' || name AS help_uri
      FROM active_rules JOIN rule_text USING (rule_id)""",
    "sarif_report": f"""
      SELECT a.project, 0::BIGINT AS pos, '{{"version":"2.1.0","$schema":"https://raw.githubusercontent.com/'
        || 'oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json","runs":[{{"tool":{{"driver":'
        || '{{"name":"envtally","informationUri":"{_TOOL_URI}","rules":' || coalesce((
          SELECT to_json(list({{'id': rule_id, 'name': name, 'shortDescription': {{'text': description}},
            'helpUri': '{_TOOL_URI}#' || name}} ORDER BY rule_id))::VARCHAR
          FROM active_rules r JOIN rule_text USING (rule_id) WHERE r.project = a.project), 'null')
        || '}}}},"results":[' AS text
      FROM audited a
      UNION ALL SELECT project, n1 + n2 + n3 + n4 + n5 + 1, ']}}]}}' FROM by_rule
      UNION ALL SELECT project, pos, CASE WHEN pos > 1 THEN ',' ELSE '' END || '{{"ruleId":"' || rule_id
        || '","ruleIndex":' || rule_index || ',"level":"' || level || '","message":{{"text":'
        || to_json(message)::VARCHAR || '}}'
        || CASE WHEN path IS NULL THEN '' ELSE ',"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":'
             || to_json(path)::VARCHAR || '}},"region":{{"startLine":' || line_no || '}}}}}}]' END
        || CASE WHEN declared_source IS NULL THEN '' ELSE ',"properties":{{"declared_source":'
             || to_json(declared_source)::VARCHAR || '}}' END || '}}'
      FROM sarif_ordered""",
}


def _mentioned(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", sql))
    return [name for name in _CTES if name in words]


def _with_relations(sql: str, limited: bool = False) -> str:
    """``sql`` and the relations that it needs; with ``limited``, long lines make a file fail."""
    needed: set[str] = set()
    todo = _mentioned(sql)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += _mentioned(_CTES[name])
    ctes = ",\n".join(f"{name} AS ({_CTES[name]})" for name in _CTES if name in needed)
    return f"WITH {ctes}\n{sql.strip()}".replace("LIMITED", str(limited).lower())


def oracle_sql() -> dict[str, str]:
    plain = {name: _with_relations(sql) for name, sql in _QUERIES.items()}
    limited = {f"{name}_line_limit": _with_relations(_QUERIES[name], True) for name in ("findings", "warnings")}
    return plain | limited
