"""DuckDB twins: the same queries written independently in plain SQL.

They read the shared tables (views ``documents``, ``pages``) and derive the same manifests as
:mod:`.sources.fixtures`, then recompute every step with SQL's own means: prefix tests with
``NOT EXISTS`` instead of ancestor joins, window ranks instead of struct maxima, hand-expanded
regexes (the default rules' too) instead of the translator. Only literals (rule texts, fixed lists,
the pinned MIME table) are shared with the Spark side.
"""

from __future__ import annotations

from .functions import constants as K
from .functions.mime import encodings, mime_rows, suffix_aliases
from .plans.snapshot import DEFAULT_TIMESTAMP
from .sources import fixtures as FX


def lit(s: str) -> str:
    """A SQL string literal; newlines and other control characters spelled with ``chr``."""
    out, buf = [], []
    for ch in s:
        if ch == "'" :
            buf.append("''")
        elif ord(ch) < 32:
            if buf:
                out.append("'" + "".join(buf) + "'")
                buf = []
            out.append(f"chr({ord(ch)})")
        else:
            buf.append(ch)
    if buf or not out:
        out.append("'" + "".join(buf) + "'")
    return "(" + " || ".join(out) + ")"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


# The default rules by hand: folder rules cover what is below them, file rules the file and below.
DEFAULT_RX = (r"^(?:.+/)?(?:\.git|node_modules|vendor|bower_components|storage|build|dist|out|target|\.svn|\.hg|\.bzr"
              r"|\.idea|\.vscode|\.project|\.settings|__pycache__|\.pytest_cache|\.mypy_cache|\.ruff_cache|coverage"
              r"|logs|tmp|temp)/.*$|^(?:.+/)?[^/]*\.(?:lockb|log|tmp|bak|swp|DS_Store)(?:/.*)?$")

# The grammar's patterns (queries.GRAMMAR) by hand.
GRAMMAR_RX = (
    r"^(?:.+/)?src/.*$", r"^(?:.+/)?[^/]*\.md(?:/.*)?$", r"^(?:.+/)?core(?:/.*)?$", r"^src(?:/.*)?$",
    r"^src/core(?:/.*)?$", r"^docs/[^/]+(?:/.*)?$", r"^src(?:/.+)?/[^/]*\.txt(?:/.*)?$", r"^tests/.*$",
    r"^(?:.+/)?core(?:/.*)?$", r"^[^/]+(?:/.*)?$", r"^(?:.+/)?f[^/]1\.py(?:/.*)?$", r"^(?:.+/)?f[12][^/]*(?:/.*)?$",
    r"^(?:.+/)?f[^12][^/]*\.js(?:/.*)?$", r"^(?:.+/)?docs(?:/.*)?$", r"^(?:.+/)?f1[^/]*(?:/.*)?$",
)

# Hand-expanded regexes of the fixture's rule lines (FIXTURES.md section 3).
FIXTURE_REGEX = {
    "*.txt": r"^(?:.+/)?[^/]*\.txt(?:/.*)?$",
    "docs/**/*.txt": r"^docs(?:/.+)?/[^/]*\.txt(?:/.*)?$",
    "docs/de": r"^docs/de(?:/.*)?$",
    "/build": r"^build(?:/.*)?$",
    "tests/*": r"^tests/[^/]+(?:/.*)?$",
}

SPLITEXT = r"^\.*[^.].*(\.[^.]*)$"


def _case_mod(col: str, mod: int, values, wrap=lambda v: lit(v)) -> str:
    arms = " ".join(f"WHEN {i} THEN {wrap(v)}" for i, v in enumerate(values))
    return f"(CASE {col} % {mod} {arms} END)"


def docs_manifest_ctes() -> list[str]:
    folder = ("(CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'src/' WHEN 2 THEN 'src/core/' "
              "WHEN 3 THEN 'docs/' || lang || '/' WHEN 4 THEN 'node_modules/pkg/' "
              "WHEN 5 THEN 'build/' ELSE 'tests/__data__/' END)")
    ext = _case_mod("doc_id", 11, FX.EXTENSIONS)
    name = (f"(CASE WHEN doc_id % 13 = 0 THEN 'm' || doc_id::VARCHAR || '/Makefile' "
            f"ELSE 'f' || doc_id::VARCHAR || {ext} END)")
    text = "(CASE WHEN doc_id % 23 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END)"
    body = f"((CASE WHEN doc_id % 19 = 0 THEN '\\x00'::BLOB ELSE ''::BLOB END) || encode({text}))"
    num = "TRY_CAST(regexp_extract(repo, '^src([0-9]+)$', 1) AS INTEGER)"
    g0, g1 = FX.GITIGNORE_REPOS
    t0, t1 = FX.TRACK_IGNORE_REPOS
    return [
        f"rf AS (SELECT source AS repo, {folder} || {name} AS path, {body} AS body, doc_id "
        f"FROM documents)",
        "repo_files AS (SELECT repo, path, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE body END "
        "AS content, octet_length(body)::BIGINT AS size FROM rf)",
        "repos AS (SELECT DISTINCT source AS repo FROM documents)",
        f"rule_rows AS (SELECT repo, '.gitignore' AS path, encode({lit(FX.GITIGNORE_TEXT)} || 'f' || "
        f"{num}::VARCHAR || '?*.py' || chr(10)) AS content "
        f"FROM repos WHERE {num} BETWEEN {g0} AND {g1} UNION ALL "
        f"SELECT repo, '.codebase/track_ignore.txt' AS path, encode({lit(FX.TRACK_IGNORE_TEXT)}) "
        f"AS content FROM repos WHERE {num} BETWEEN {t0} AND {t1})",
        "manifest AS (SELECT repo, path, content, size FROM repo_files UNION ALL "
        "SELECT repo, path, content, octet_length(content)::BIGINT AS size FROM rule_rows)",
    ]


def pages_manifest_ctes() -> list[str]:
    host = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    raw = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    path = clean_path(raw)
    return [f"manifest AS (SELECT {host} AS repo, {path} AS path, encode(html) AS content, "
            f"octet_length(encode(html))::BIGINT AS size FROM pages)"]


def clean_path(raw: str) -> str:
    """Without empty and ``.`` segments, by replacement: each one goes with the slash after it."""
    slashed = f"'/' || replace({raw}, '\\', '/') || '/'"
    return f"regexp_replace(regexp_replace({slashed}, '(/\\.)*/+(\\./+)*', '/', 'g'), '^/|/$', '', 'g')"


def messy_ctes() -> list[str]:
    full = ("(CASE doc_id % 6 WHEN 0 THEN '/data/' || source || '//x/a' || doc_id "
            "WHEN 1 THEN '/data/' || source || '/./x/a' || (doc_id - 1) || '/b.py' "
            "WHEN 2 THEN '\\data\\' || source || '\\y\\.\\c' || doc_id || '.md/' "
            "WHEN 3 THEN '/data/' || source || '/' WHEN 4 THEN '/other/' || doc_id END)")
    bad = "(CASE WHEN doc_id % 2 = 0 THEN '\\xFF'::BLOB ELSE '\\xE2\\x82'::BLOB END)"
    return [
        f"t0 AS (SELECT source AS repo, {full} AS given, doc_id, text, "
        f"encode(substr(text, 1, 40)) || {bad} || encode(substr(text, 41)) AS content, "
        f"substr(text, 1, 40) || chr(65533) || substr(text, 41) AS shown FROM documents)",
        f"t1 AS (SELECT *, {clean_path('given')} AS p FROM t0)",
        "t2 AS (SELECT *, CASE WHEN p = 'data/' || repo THEN '' WHEN starts_with(p, 'data/' || repo || '/') "
        "THEN substr(p, length(repo) + 7) END AS path, octet_length(content)::BIGINT AS size FROM t1)",
        "t3 AS (SELECT *, CASE WHEN given IS NULL THEN 'no path' WHEN path IS NULL THEN 'path outside its root' "
        "WHEN path = '' THEN 'empty path' END AS reason FROM t2)",
        "manifest AS (SELECT repo, path, content, size, shown FROM t3 WHERE reason IS NULL)",
    ]


def name_expr(p: str) -> str:
    return f"string_split({p}, '/')[-1]"


def parent_expr(p: str) -> str:
    return f"regexp_extract({p}, '^(.*)/[^/]*$', 1)"


def depth_expr(p: str) -> str:
    return f"(len(string_split({p}, '/')) - 1)"


def read_text_expr(c: str) -> str:
    return f"regexp_replace(decode({c}), '\\r\\n?', chr(10), 'g')"


def tree_key_expr(p: str, is_dir: str) -> str:
    parts = f"string_split({p}, '/')"
    anc = (f"array_to_string(list_transform(list_slice({parts}, 1, len({parts}) - 1), "
           f"lambda x: '0' || lower(x) || chr(1) || x || chr(1)), '')")
    nm = name_expr(p)
    return (f"({anc} || (CASE WHEN {is_dir} THEN '0' ELSE '1' END) || lower({nm}) || chr(1) "
            f"|| {nm} || chr(1))")


def content_key_expr(p: str) -> str:
    parts = f"string_split({p}, '/')"
    anc = (f"array_to_string(list_transform(list_slice({parts}, 1, len({parts}) - 1), "
           f"lambda x: '1' || x || chr(1)), '')")
    return f"({anc} || '0' || {name_expr(p)} || chr(1))"


def mime_ctes() -> list[str]:
    rows = ", ".join(f"({lit(e)}, {lit(m)})" for e, m in mime_rows())
    al = suffix_aliases()
    alias_case = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in al.items())
    readable = " OR ".join(f"starts_with(mime, {lit(p)})" for p in K.READABLE_MIME_PREFIXES)
    binary = " OR ".join(f"starts_with(mime, {lit(p)})" for p in K.BINARY_MIME_PREFIXES)
    ends = " OR ".join(f"ends_with(name, {lit(e)})" for e in K.TEXT_NAME_ENDINGS)
    return [
        f"mime_tab(mime_ext, mime) AS (VALUES {rows})",
        f"f0 AS (SELECT repo, path, content, size, {name_expr('path')} AS name FROM manifest)",
        f"f1 AS (SELECT *, regexp_extract(name, '{SPLITEXT}', 1) AS e1, "
        f"regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS suffix FROM f0)",
        f"f2 AS (SELECT *, lower(CASE WHEN lower(e1) IN {in_list(al)} THEN (CASE lower(e1) "
        f"{alias_case} END) WHEN e1 IN {in_list(encodings())} THEN "
        f"regexp_extract(left(name, length(name) - length(e1)), '{SPLITEXT}', 1) ELSE e1 END) "
        f"AS type_ext FROM f1)",
        "f3 AS (SELECT f2.*, m.mime FROM f2 LEFT JOIN mime_tab m ON m.mime_ext = f2.type_ext)",
        f"f4 AS (SELECT *, CASE WHEN lower(name) IN {in_list(K.KNOWN_TEXT_NAMES)} THEN 'text' "
        f"WHEN {ends} THEN 'text' "
        f"WHEN lower(substr(suffix, 2)) IN {in_list(K.DENIED_EXTENSIONS)} THEN 'binary' "
        f"WHEN {readable} THEN 'text' WHEN {binary} THEN 'binary' END AS by_name, "
        f"substr(hex(content), 1, 8192) AS hx FROM f3)",
        "facts AS (SELECT repo, path, size, content, mime, by_name, content IS NOT NULL AS readable, "
        "CASE WHEN content IS NULL THEN false WHEN octet_length(content) = 0 THEN true "
        "ELSE NOT regexp_matches(hx, '^(?:..)*?00') AND try(decode(unhex(hx))) IS NOT NULL END "
        "AS sniff_text FROM f4)",
        "facts2 AS (SELECT *, CASE WHEN by_name IS NOT NULL THEN by_name = 'text' ELSE sniff_text "
        "END AS is_text FROM facts)",
        f"facts3 AS (SELECT *, CASE WHEN is_text AND readable THEN "
        f"length({read_text_expr('content')})::BIGINT END AS text_chars FROM facts2)",
    ]


def scan_ctes() -> list[str]:
    fx = "(VALUES " + ", ".join(f"({lit(k)}, {lit(v)})" for k, v in FIXTURE_REGEX.items()) + ")"
    return mime_ctes() + [
        # entries: files and the directories their paths imply
        "fl AS (SELECT repo, path, string_split(path, '/') AS parts FROM manifest)",
        "anc0 AS (SELECT repo, parts, unnest(generate_series(1, len(parts) - 1)) AS i FROM fl)",
        "anc AS (SELECT DISTINCT repo, array_to_string(list_slice(parts, 1, i), '/') AS path FROM anc0)",
        "ent0 AS (SELECT DISTINCT repo, path, is_dir FROM (SELECT repo, path, false AS is_dir "
        "FROM fl UNION ALL SELECT repo, path, true FROM anc))",
        f"ent AS (SELECT repo, path, is_dir, {name_expr('path')} AS name, {parent_expr('path')} "
        f"AS parent, {depth_expr('path')}::INTEGER AS depth FROM ent0)",
        # rule files: lines, ordinals, hand-expanded regexes
        "rfile AS (SELECT repo, CASE path WHEN '.gitignore' THEN 'gitignore' ELSE 'track_ignore' END "
        "AS rule_set, string_split(replace(replace(decode(content), chr(13) || chr(10), chr(10)), "
        "chr(13), chr(10)), chr(10)) AS lst FROM manifest "
        "WHERE path IN ('.gitignore', '.codebase/track_ignore.txt') AND content IS NOT NULL)",
        "rl0 AS (SELECT repo, rule_set, lst, unnest(generate_series(1, len(lst))) AS lno FROM rfile)",
        "rl1 AS (SELECT repo, rule_set, lno, lst[lno] AS line, trim(lst[lno]) AS clean FROM rl0)",
        "rl2 AS (SELECT repo, rule_set, lno, CASE WHEN rule_set = 'gitignore' THEN line ELSE clean END "
        "AS pattern, clean FROM rl1 WHERE clean <> '' AND NOT starts_with(clean, '#'))",
        f"rules AS (SELECT r.repo, r.rule_set, (row_number() OVER (PARTITION BY r.repo, r.rule_set "
        f"ORDER BY r.lno))::INTEGER AS ordinal, r.pattern, NOT starts_with(r.clean, '!') AS include, "
        f"CASE WHEN ends_with(r.clean, '?*.py') THEN '^(?:.+/)?' || left(r.clean, length(r.clean) - 5) || "
        f"'[^/][^/]*\\.py(?:/.*)?$' ELSE m.rx END AS regex "
        f"FROM rl2 r LEFT JOIN {fx} AS m(pat, rx) ON m.pat = ltrim(r.clean, '!'))",
        "rfound AS (SELECT repo, rule_set, count(*) AS n FROM rules GROUP BY repo, rule_set)",
        "rhit AS (SELECT e.repo, e.path, r.rule_set, arg_max(r.include, r.ordinal) AS hit FROM ent e "
        "JOIN rules r ON r.repo = e.repo AND regexp_matches(e.path, r.regex) "
        "GROUP BY e.repo, e.path, r.rule_set)",
        f"flags0 AS (SELECT e.*, e.path = '.codebase' OR starts_with(e.path, '.codebase/') AS reserved, "
        f"CASE WHEN g.repo IS NULL THEN NULL ELSE coalesce(gh.hit, false) END AS gitignore_hit, "
        f"CASE WHEN t.repo IS NULL THEN NULL ELSE coalesce(th.hit, false) END AS track_ignore_hit, "
        f"regexp_matches(e.path, {lit(DEFAULT_RX)}) AS default_hit FROM ent e "
        f"LEFT JOIN rfound g ON g.repo = e.repo AND g.rule_set = 'gitignore' "
        f"LEFT JOIN rhit gh ON gh.repo = e.repo AND gh.path = e.path AND gh.rule_set = 'gitignore' "
        f"LEFT JOIN rfound t ON t.repo = e.repo AND t.rule_set = 'track_ignore' "
        f"LEFT JOIN rhit th ON th.repo = e.repo AND th.path = e.path AND th.rule_set = 'track_ignore')",
        "flags AS (SELECT *, reserved OR default_hit OR coalesce(gitignore_hit, false) "
        "OR coalesce(track_ignore_hit, false) AS ignored FROM flags0)",
        # pruning by prefix test
        "igd AS (SELECT repo, path FROM flags WHERE is_dir AND ignored)",
        "vis AS (SELECT f.* FROM flags f WHERE NOT EXISTS (SELECT 1 FROM igd d WHERE d.repo = f.repo "
        "AND starts_with(f.path, d.path || '/')))",
        "disp AS (SELECT v.repo, v.path, v.is_dir, v.name, v.parent, v.depth, v.ignored, f.is_text, "
        "f.readable, f.text_chars, CASE WHEN v.is_dir THEN (CASE WHEN v.ignored THEN 'directory' END) "
        "WHEN v.ignored THEN 'file' WHEN f.is_text THEN 'text' ELSE 'binary' END AS disposition "
        "FROM vis v LEFT JOIN (SELECT repo, path, bool_or(is_text) AS is_text, bool_or(readable) AS readable, "
        "max(text_chars) AS text_chars FROM facts3 GROUP BY repo, path) f "
        "ON f.repo = v.repo AND f.path = v.path AND NOT v.is_dir)",
    ]


def tree_ctes(max_depth: int | None = None) -> list[str]:
    depth_filter = "" if max_depth is None else f" WHERE depth <= {max_depth}"
    return [
        "tent AS (SELECT repo, path, name, parent, depth, is_dir FROM disp WHERE NOT "
        "starts_with(path, '.codebase') AND len(list_filter(string_split(path, '/'), "
        "lambda s: starts_with(s, '__'))) = 0)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, parent ORDER BY (NOT is_dir) DESC, "
        "lower(name) DESC, name DESC) AS rdesc, count(*) OVER (PARTITION BY repo, parent) AS n_children "
        "FROM tent)",
        "tanc0 AS (SELECT repo, path, unnest(generate_series(1, depth)) AS i FROM tent)",
        "tanc AS (SELECT repo, path, i, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') "
        "AS apath FROM tanc0)",
        f"tpref AS (SELECT a.repo, a.path, string_agg(CASE WHEN r.rdesc = 1 THEN {lit(K.TREE_SPACE)} "
        f"ELSE {lit(K.TREE_BRANCH)} END, '' ORDER BY a.i) AS prefix FROM tanc a JOIN ranked r "
        f"ON r.repo = a.repo AND r.path = a.apath GROUP BY a.repo, a.path)",
        f"tlines AS (SELECT r.repo, {tree_key_expr('r.path', 'r.is_dir')} AS key, coalesce(p.prefix, '') "
        f"|| CASE WHEN r.rdesc = 1 THEN {lit(K.TREE_LAST)} ELSE {lit(K.TREE_TEE)} END || r.name || "
        f"CASE WHEN r.is_dir THEN '/' ELSE '' END AS line FROM (SELECT * FROM ranked{depth_filter}) r "
        f"LEFT JOIN tpref p ON p.repo = r.repo AND p.path = r.path "
        f"UNION ALL SELECT DISTINCT repo, '' AS key, '.' AS line FROM disp)",
    ]


def section_ctes() -> list[str]:
    ts = DEFAULT_TIMESTAMP
    err = (f"{lit(K.ERROR_SECTION_OPEN)} || path || "
           f"{lit(' ===== */' + chr(10) + '/* ' + K.UNREADABLE_REASON + ' */' + chr(10) + chr(10))}")
    ok = (f"{lit(K.FILE_SECTION_OPEN)} || path || {lit(K.FILE_SECTION_CLOSE)} || "
          f"{read_text_expr('content')} || {lit(K.FILE_SECTION_TAIL)}")
    ok_len = (f"length(path) + {len(K.FILE_SECTION_OPEN) + len(K.FILE_SECTION_CLOSE) + len(K.FILE_SECTION_TAIL)}"
              f" + text_chars")
    item = (f"'/* ' || path || CASE WHEN disposition = 'directory' THEN '/' ELSE '' END || "
            f"{lit(' */' + chr(10))}")
    sec = ("CASE disposition WHEN 'directory' THEN 4 WHEN 'file' THEN 5 ELSE 6 END")
    heading = (f"CASE section WHEN 4 THEN {lit(K.HEADING_DIRS)} WHEN 5 THEN {lit(K.HEADING_FILES)} "
               f"ELSE {lit(K.HEADING_BINARY)} END")
    rule_head = (f"CASE rule_set WHEN 'gitignore' THEN {lit(K.REPORT_GITIGNORE)} "
                 f"ELSE {lit(K.REPORT_TRACK)} END")
    setk = "CASE rule_set WHEN 'gitignore' THEN '0' ELSE '1' END"
    head = (f"{lit('/* ' + K.HEADER_RULE + chr(10) + '   CODEBASE SNAPSHOT - ' + ts + chr(10) + '   Project: ')}"
            f" || repo || {lit(chr(10) + '   Text Files Included: ')} || t::VARCHAR || "
            f"{lit(chr(10) + '   Items Ignored: ')} || i::VARCHAR || "
            f"{lit(chr(10) + '   ' + K.HEADER_RULE + ' */' + chr(10) + chr(10))}")
    return [
        f"trows AS (SELECT repo, 1 AS section, '0' AS key, "
        f"{lit(K.TREE_TITLE + K.TREE_INDENT + K.TREE_RULE + chr(10))} AS text, true AS counted "
        f"FROM tlines WHERE key = '' UNION ALL SELECT repo, 1, '1' || key, {lit(K.TREE_INDENT)} || line "
        f"|| chr(10), true FROM tlines UNION ALL SELECT repo, 1, '2', "
        f"{lit(K.TREE_INDENT + K.TREE_RULE + ' */' + chr(10) + chr(10))}, true FROM tlines WHERE key = '')",
        "ign AS (SELECT * FROM disp WHERE disposition IN ('directory', 'file', 'binary'))",
        f"irows AS (SELECT repo, {sec} AS section, path AS key, {item} AS text, true AS counted FROM ign "
        f"UNION ALL SELECT repo, section, '' AS key, {heading} AS text, false AS counted FROM "
        f"(SELECT DISTINCT repo, {sec} AS section FROM ign))",
        "irepos AS (SELECT DISTINCT repo FROM ign)",
        "shown AS (SELECT repo, rule_set FROM rfile WHERE rule_set = 'gitignore' UNION "
        "SELECT repo, rule_set FROM rfound)",
        f"prows AS (SELECT repo, 3 AS section, '0' AS key, {lit(K.REPORT_TITLE)} AS text, true AS counted "
        f"FROM irepos UNION ALL SELECT s.repo, 3, '1' || {setk} || lpad('0', 10, '0'), {rule_head}, true "
        f"FROM shown s SEMI JOIN irepos i ON i.repo = s.repo UNION ALL SELECT r.repo, 3, '1' || {setk} || "
        f"lpad(r.ordinal::VARCHAR, 10, '0'), '/* ' || r.pattern || ' */' || chr(10), true FROM rules r "
        f"SEMI JOIN irepos i ON i.repo = r.repo UNION ALL SELECT s.repo, 3, '1' || {setk} || "
        f"lpad('{1 << 30}', 10, '0'), chr(10), true FROM shown s SEMI JOIN irepos i ON i.repo = s.repo)",
        "small AS (SELECT * FROM trows UNION ALL SELECT * FROM irows UNION ALL SELECT * FROM prows)",
        "cpick AS (SELECT d.repo, d.path, f.content FROM disp d JOIN manifest f ON f.repo = d.repo "
        "AND f.path = d.path WHERE d.disposition = 'text')",
        f"crows AS (SELECT repo, 2 AS section, {content_key_expr('path')} AS key, CASE WHEN content "
        f"IS NULL THEN {err} ELSE {ok} END AS text, true AS counted FROM cpick)",
        f"agg AS (SELECT repo, sum(t)::BIGINT AS t, sum(b)::BIGINT AS b, sum(i)::BIGINT AS i, "
        f"sum(e)::BIGINT AS e, sum(c)::BIGINT AS c FROM ("
        f"SELECT repo, (disposition = 'text')::INT AS t, (disposition = 'binary')::INT AS b, "
        f"(disposition IN ('directory', 'file', 'binary'))::INT AS i, "
        f"(disposition = 'text' AND NOT readable)::INT AS e, CASE WHEN disposition = 'text' THEN "
        f"(CASE WHEN readable THEN {ok_len} ELSE length({err}) END) END AS c FROM disp "
        f"UNION ALL SELECT repo, 0, 0, 0, 0, length(text) FROM small WHERE counted) GROUP BY repo)",
        f"hrows AS (SELECT repo, 0 AS section, '' AS key, {head} AS text, true AS counted FROM agg)",
        f"stats AS (SELECT repo, t AS text_files, b AS binary_files, i AS ignored_items, t AS total_files, "
        f"(c + length({head}))::BIGINT AS total_chars, e AS errors, {lit(ts)} AS timestamp FROM agg)",
        "sections AS (SELECT repo, section, key, text, length(text)::BIGINT AS n_chars, counted FROM "
        "(SELECT * FROM hrows UNION ALL SELECT * FROM small UNION ALL SELECT * FROM crows))",
    ]


def _with(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _docs(select: str, extra=()) -> str:
    return _with(docs_manifest_ctes() + scan_ctes() + list(extra), select)


def _pages(select: str, extra=()) -> str:
    return _with(pages_manifest_ctes() + scan_ctes() + list(extra), select)


def _size_label(col: str) -> str:
    arms = []
    for i, unit in enumerate(K.SIZE_UNITS):
        scaled = f"printf('%.2f', {col}::DOUBLE / {float(1024 ** i)!r}) || ' {unit}'"
        if i < len(K.SIZE_UNITS) - 1:
            arms.append(f"WHEN {col} < {1024 ** (i + 1)} THEN {scaled}")
        else:
            arms.append(f"ELSE {scaled}")
    return f"CASE WHEN {col} = 0 THEN '0 Bytes' " + " ".join(arms) + " END"


def oracle_sql() -> dict[str, str]:
    site = pages_manifest_ctes()
    p = "path"
    all_tree = tree_ctes() + section_ctes()
    return {
        "path_parts": _with(site, f"SELECT repo, path, {name_expr(p)} AS name, lower({name_expr(p)}) "
                                  f"AS lname, regexp_extract({name_expr(p)}, '^.+(\\.[^.]+)$', 1) AS suffix, "
                                  f"{parent_expr(p)} AS parent, {depth_expr(p)}::INTEGER AS depth, "
                                  f"CASE WHEN string_split(path, '/')[1] = '' THEN path "
                                  f"WHEN path = string_split(path, '/')[1] THEN '' "
                                  f"WHEN starts_with(path, string_split(path, '/')[1] || '/') THEN "
                                  f"substr(path, length(string_split(path, '/')[1]) + 2) END AS rel_to_top "
                                  f"FROM manifest"),
        "path_ancestors": _pages(f"SELECT repo, path, {depth_expr(p)}::INTEGER AS depth FROM anc"),
        "rule_lines": _docs("SELECT repo, rule_set, ordinal, pattern, include, regex FROM rules"),
        "rule_summary": _docs(
            "SELECT r.repo, s.rule_set, s.rule_set = 'default' OR f.repo IS NOT NULL AS found, "
            f"CASE WHEN s.rule_set = 'default' THEN {lit(chr(10).join(K.DEFAULT_IGNORE_PATTERNS))} "
            "ELSE coalesce((SELECT string_agg(u.pattern, chr(10) ORDER BY u.ordinal) FROM rules u WHERE u.repo = r.repo "
            "AND u.rule_set = s.rule_set), '') END AS patterns FROM (SELECT DISTINCT repo FROM manifest) r, "
            "(VALUES ('gitignore'), ('track_ignore'), ('default')) s(rule_set) LEFT JOIN rfile f "
            "ON f.repo = r.repo AND f.rule_set = s.rule_set"),
        "rule_match_grammar": _docs("SELECT repo, path, is_dir, " + ", ".join(
            f"regexp_matches(path, {lit(rx)}) AS hit_{i:02d}" for i, rx in enumerate(GRAMMAR_RX)) + " FROM ent"),
        "manifest_table": _with(messy_ctes(), "SELECT repo, path, size, replace(replace(shown, chr(13) || chr(10), chr(10)), "
                                              "chr(13), chr(10)) AS text FROM manifest"),
        "chunk_text": _with(
            messy_ctes(), "SELECT repo, path, text, length(text)::BIGINT AS n_chars FROM (SELECT repo, path, replace(replace(shown, "
                          "chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM manifest) WHERE text IS NOT NULL"),
        "chunk_facts": _docs(
            "SELECT t.repo, t.path, t.size, t.readable, t.by_name, CASE WHEN t.by_name IS NULL THEN t.sniff_text END AS sniff_text, "
            "t.is_text, CASE WHEN NOT f.reserved AND NOT f.default_hit THEN t.text_chars END AS text_chars "
            "FROM facts3 t JOIN flags f ON f.repo = t.repo AND f.path = t.path AND NOT f.is_dir"),
        "manifest_rejects": _with(messy_ctes(), "SELECT repo, given AS path, reason FROM t3 WHERE reason IS NOT NULL"),
        "manifest_clashes": _with(messy_ctes() + scan_ctes(), "SELECT repo, path, is_dir, disposition FROM disp"),
        "stats_sink": _docs("SELECT repo, text_files, binary_files, ignored_items, total_files, total_chars, errors, "
                            "timestamp, 'documents/repo=' || repo AS output_file FROM stats", all_tree),
        "snapshot_sink": _docs(
            "SELECT repo, count(*) AS n_lines, sum(length(line) + 1)::BIGINT AS n_chars, "
            "sum(number * (length(line) + ascii(line) + 1))::BIGINT AS order_sum FROM (SELECT repo, line, "
            "row_number() OVER (PARTITION BY repo ORDER BY section, key, pos) AS number FROM lines) GROUP BY repo",
            all_tree + ["cut AS (SELECT repo, section, key, string_split(left(text, length(text) - 1), chr(10)) AS l FROM sections)",
                        "lines AS (SELECT repo, section, key, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM cut)"]),
        "section_offsets": _docs(
            "SELECT repo, section, key, coalesce(sum(n_chars) OVER (PARTITION BY repo ORDER BY section, key "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sections", all_tree),
        "rule_match_default": _docs("SELECT repo, path, is_dir, default_hit FROM flags"),
        "rule_match_last_wins": _docs("SELECT repo, path, is_dir, gitignore_hit, track_ignore_hit, "
                                      "ignored FROM flags"),
        "reserved_filter": _docs("SELECT repo, path, is_dir, reserved FROM flags"),
        "ignored_directories": _docs(
            "SELECT d.repo, d.path, d.depth, (SELECT count(*) FROM manifest m WHERE m.repo = d.repo "
            "AND starts_with(m.path, d.path || '/'))::BIGINT AS pruned_files FROM disp d "
            "WHERE d.disposition = 'directory'"),
        "prune_files": _docs("SELECT repo, path, is_dir FROM vis"),
        "classify_by_name": _docs("SELECT repo, path, mime, by_name FROM facts3"),
        "classify_by_bytes": _docs("SELECT repo, path, sniff_text FROM facts3"),
        "disposition": _docs("SELECT repo, path, is_text, disposition FROM disp "
                             "WHERE disposition IS NOT NULL"),
        "tree_entries": _pages("SELECT repo, path, name, parent, depth, is_dir FROM tent", tree_ctes()),
        "tree_last_sibling": _pages("SELECT repo, parent, name AS last_name, is_dir AS last_is_dir, "
                                    "n_children::BIGINT AS n_children FROM ranked WHERE rdesc = 1",
                                    tree_ctes()),
        "tree_lines": _pages("SELECT repo, key, line FROM tlines", tree_ctes()),
        "tree_depth_limit": " UNION ALL ".join(
            f"(SELECT *, {k} AS max_depth FROM ({_pages('SELECT repo, key, line FROM tlines', tree_ctes(max_depth=k))}))"
            for k in range(4)),
        "tree_ignored_closed": _docs("SELECT repo, key, line FROM tlines", tree_ctes()),
        "content_text": _docs(f"SELECT repo, path, {read_text_expr('content')} AS text, "
                              f"length({read_text_expr('content')})::BIGINT AS n_chars FROM manifest"),
        "file_sections": _docs("SELECT repo, key, text, n_chars FROM sections WHERE section = 2",
                               all_tree),
        "ignored_report": _docs("SELECT repo, section, key, text, counted FROM irows", all_tree),
        "pattern_report": _docs("SELECT repo, key, text FROM prows", all_tree),
        "header_section": _docs("SELECT repo, text FROM hrows", all_tree),
        "snapshot_sections": _docs("SELECT repo, section, key, text, n_chars, counted FROM sections",
                                   all_tree),
        "snapshot_stats": _docs("SELECT repo, text_files, binary_files, ignored_items, total_files, "
                                "total_chars, errors, timestamp FROM stats", all_tree),
        "file_size_label": _with(
            [c.replace("manifest AS", "dm AS", 1) for c in docs_manifest_ctes()]
            + [pages_manifest_ctes()[0].replace("manifest AS", "pm AS", 1)],
            f"SELECT repo, path, size, {_size_label('size')} AS label FROM "
            f"(SELECT repo, path, size FROM dm UNION ALL SELECT repo, path, size FROM pm)"),
    }
