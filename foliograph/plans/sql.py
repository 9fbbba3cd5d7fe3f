"""The queries' equivalents in DuckDB's SQL: shared common table expressions and the longer statements.

Code and math fences are told apart by one pattern over a section's string of line classes, runs by splitting at framed marks, everything else by windows and joins: another way than the
DataFrame operators take.
"""

from __future__ import annotations

from foliograph.operators import content, profiles
from foliograph.plans import fixtures as X


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _linked(x: str) -> str:
    return rf"regexp_replace({x}, '\[([^\]]+)\]\([^)]*\)|\[\]\(([^)]*)\)', '\1\2', 'g')"


# The patterns of inline marks; RE2 has no lookarounds, and a word boundary says the same of a single underscore.
_MATH = r"'(?s)\$\$(.+?)\$\$|\$(.+?)\$'"
_SPAN = r"'\*\*\*(.+?)\*\*\*|___(.+?)___|\*\*(.+?)\*\*|__(.+?)__|<sup>(.+?)</sup>|<sub>(.+?)</sub>|\*(.+?)\*|\b_(.+?)_\b'"


def strip_inline(x: str) -> str:
    prose = rf"regexp_replace(p, {_SPAN}, '\1\2\3\4\5\6\7\8', 'g')"
    pieces = rf"string_split(regexp_replace({_linked(x)}, {_MATH}, chr(1) || '\1\2' || chr(1), 'g'), chr(1))"
    out = f"array_to_string(list_transform({pieces}, lambda p, i: CASE WHEN i % 2 = 0 THEN p ELSE {prose} END), '')"
    return f"coalesce(nullif({out}, ''), {_linked(x)})"


def runs(source: str, name: str = "run") -> str:
    """CTEs from a table `source` (txt) of distinct texts to `name` (txt, n, code, t): merged runs from 0; codes p, b, i, bi, sup, sub and m (math)."""
    framed = rf"regexp_replace(p, {_SPAN}, chr(2) || '\1' || chr(3) || '\2' || chr(3) || '\3' || chr(3) || '\4' || chr(3) || '\5' || chr(3) || '\6' || chr(3) || '\7' || chr(3) || '\8' || chr(2), 'g')"
    return rf"""
{name}_a AS (SELECT txt, {_linked("txt")} AS linked FROM {source}),
{name}_b AS (SELECT txt, linked, p, i FROM {name}_a, unnest(string_split(regexp_replace(linked, {_MATH}, chr(1) || '\1\2' || chr(1), 'g'), chr(1))) WITH ORDINALITY AS u(p, i)),
{name}_c AS (SELECT txt, linked, i, j, CASE WHEN i % 2 = 0 THEN [s] ELSE string_split(s, chr(3)) END AS g
   FROM (SELECT txt, linked, i, CASE WHEN i % 2 = 0 THEN p ELSE {framed} END AS f FROM {name}_b), unnest(CASE WHEN i % 2 = 0 THEN [f] ELSE string_split(f, chr(2)) END) WITH ORDINALITY AS u(s, j)),
{name}_d AS (SELECT txt, i, j, array_to_string(g, '') AS t, CASE WHEN i % 2 = 0 THEN 'm' WHEN j % 2 = 1 THEN 'p' WHEN g[1] <> '' OR g[2] <> '' THEN 'bi' WHEN g[3] <> '' OR g[4] <> '' THEN 'b'
   WHEN g[5] <> '' THEN 'sup' WHEN g[6] <> '' THEN 'sub' ELSE 'i' END AS code FROM {name}_c),
{name}_e AS (SELECT txt, i, j, t, code FROM {name}_d WHERE t <> '' UNION ALL SELECT txt, 0, 0, linked, 'p' FROM {name}_a WHERE txt NOT IN (SELECT txt FROM {name}_d WHERE t <> '')),
{name}_f AS (SELECT *, CASE WHEN code = 'm' OR lag(code) OVER w IS DISTINCT FROM code THEN 1 ELSE 0 END AS new FROM {name}_e WINDOW w AS (PARTITION BY txt ORDER BY i, j)),
{name}_g AS (SELECT *, sum(new) OVER (PARTITION BY txt ORDER BY i, j) - 1 AS n FROM {name}_f),
{name} AS (SELECT txt, n, min(code) AS code, string_agg(t, '' ORDER BY i, j) AS t FROM {name}_g GROUP BY txt, n)"""


def sections(fence: str = "heading") -> str:
    """CTEs md_corpus, md_lines, numbered, heads, tagged (with titles without inline marks) and words."""
    return rf"""{X.md_corpus_sql(fence)},
md_lines AS (SELECT doc_id, line_no, line FROM md_corpus, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) WITH ORDINALITY AS u(line, line_no)),
numbered AS (SELECT doc_id, line_no, line, regexp_matches(line, '^#{{1,3}}\s+.') AS is_heading,
   sum(CAST(regexp_matches(line, '^#{{1,3}}\s+.') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec_no FROM md_lines),
heads AS (SELECT doc_id, sec_no, line_no, length(regexp_extract(line, '^(#{{1,3}})\s', 1)) AS level, {trimmed(r"regexp_extract(line, '^#{1,3}\s+(.*)$', 1)")} AS title FROM numbered WHERE is_heading),
h1 AS (SELECT *, sum(CAST(level = 1 AS INT)) OVER (PARTITION BY doc_id ORDER BY sec_no) AS a FROM heads),
h2 AS (SELECT *, sum(CAST(level = 2 AS INT)) OVER (PARTITION BY doc_id, a ORDER BY sec_no) AS b FROM h1),
h3 AS (SELECT *, sum(CAST(level = 3 AS INT)) OVER (PARTITION BY doc_id, a, b ORDER BY sec_no) AS c FROM h2),
tagged AS (SELECT doc_id, sec_no, line_no, level, {strip_inline("title")} AS title, CASE level WHEN 1 THEN 'h1_' || CASE WHEN a = 0 THEN -1 ELSE a END WHEN 2 THEN 'h2_' || CASE WHEN a = 0 THEN -1 ELSE a END || '_' || b
   ELSE 'h3_' || CASE WHEN a = 0 THEN -1 ELSE a END || '_' || b || '_' || c END AS tag FROM h3),
words AS (SELECT doc_id, sec_no, sum(CASE WHEN is_heading THEN 0 ELSE len(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '')) END) AS word_count FROM numbered WHERE sec_no > 0 GROUP BY 1, 2)
"""


_CALLOUTS = ", ".join(_q(c) for c in content.CALLOUTS)
#: CTEs after `sections`: para (paragraphs of text), blk (all blocks) and stats (per section).
BLOCKS = rf"""
cls AS (SELECT doc_id, sec_no, line_no, line, CASE WHEN regexp_matches(line, '^\s*(```|~~~)\s*[A-Za-z0-9_+-]*\s*$') THEN 'F' WHEN regexp_matches(line, '^\s*\$\$') THEN CASE WHEN len(string_split(line, '$$')) > 2 THEN 'S' ELSE 'M' END
   WHEN contains(line, '$$') THEN 'D' ELSE 't' END AS c FROM numbered WHERE sec_no > 0 AND NOT is_heading),
seg AS (SELECT doc_id, sec_no, list(line_no ORDER BY line_no) AS ns, list(line ORDER BY line_no) AS ls, regexp_extract_all(string_agg(c, '' ORDER BY line_no), 'F[^F]*F?|M[^MSD]*[MSD]?|S|[^FMS]') AS segs FROM cls GROUP BY 1, 2),
ml AS (SELECT doc_id, sec_no, unnest(ns) AS line_no, unnest(ls) AS line, unnest(string_split(array_to_string(list_transform(segs, lambda s: CASE
   WHEN left(s, 1) = 'F' THEN 'o' || CASE WHEN length(s) > 1 AND right(s, 1) = 'F' THEN repeat('b', length(s) - 2) || 'c' ELSE repeat('b', length(s) - 1) END
   WHEN left(s, 1) = 'M' THEN 'm' || CASE WHEN length(s) > 1 AND right(s, 1) IN ('M', 'S', 'D') THEN repeat('n', length(s) - 2) || 'e' ELSE repeat('n', length(s) - 1) END
   WHEN s = 'S' THEN 's' ELSE 't' END), ''), '')) AS mode FROM seg),
kinds AS (SELECT *, CASE WHEN mode IN ('o', 'b', 'c') THEN 'code' WHEN mode <> 't' THEN 'equation' WHEN regexp_matches(line, '^\s*(-{{3,}}|\*{{3,}}|_{{3,}})\s*$') THEN 'break'
   WHEN regexp_matches(line, '^\s*[-*+]\s+') OR regexp_matches(line, '^\s*\d+[.)]\s+') THEN 'list' WHEN regexp_matches(line, '^\s*\|.*\|\s*$') THEN 'table' ELSE 'text' END AS kind FROM ml),
i1 AS (SELECT *, CAST(lag(kind) OVER w IS DISTINCT FROM kind OR mode IN ('o', 'm', 's') AS INT) AS new FROM kinds WINDOW w AS (PARTITION BY doc_id, sec_no ORDER BY line_no)),
i2 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, sec_no ORDER BY line_no) AS island, kind = 'table' AND regexp_matches(line, '^\s*\|?\s*:?-{{2,}}:?\s*(\|\s*:?-{{2,}}:?\s*)*\|?\s*$') AS sep FROM i1),
i3 AS (SELECT * FROM (SELECT *, bool_and(sep) OVER (PARTITION BY doc_id, sec_no, island) AS void FROM i2) WHERE NOT void),
i4 AS (SELECT * EXCLUDE (new), CAST(lag(kind) OVER w IS DISTINCT FROM kind OR mode IN ('o', 'm', 's') OR (kind <> 'text' AND lag(island) OVER w <> island) AS INT) AS new FROM i3 WINDOW w AS (PARTITION BY doc_id, sec_no ORDER BY line_no)),
i5 AS (SELECT * FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id, sec_no ORDER BY line_no) AS block_no FROM i4) WHERE kind <> 'break' AND NOT sep),
txt AS (SELECT doc_id, sec_no, block_no, string_agg(CASE WHEN regexp_matches(line, '^\s*>\s?') THEN regexp_extract(line, '^\s*>\s?(.*)$', 1) ELSE line END, chr(10) ORDER BY line_no) AS body FROM i5 WHERE kind = 'text' GROUP BY 1, 2, 3),
para0 AS (SELECT doc_id, sec_no, block_no, part_no - 1 AS part_no, raw FROM txt,
   unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(body, '^\n+|\n+$', '', 'g'), '\n\s*\n'), lambda x: {trimmed("x")}), lambda x: x <> '')) WITH ORDINALITY AS u(raw, part_no)),
para1 AS (SELECT *, {trimmed("replace(raw, chr(10), ' ')")} AS single, regexp_matches(raw, '^#{{4,6}}\s+(.+)$') AS hashed, {trimmed(r"regexp_extract(raw, '^#{4,6}\s+(.+)$', 1)")} AS inner_,
   {trimmed(r"regexp_extract(raw, '^(?:\*\*\*(.+?)\*\*\*|___(.+?)___)$', 1) || regexp_extract(raw, '^(?:\*\*\*(.+?)\*\*\*|___(.+?)___)$', 2)")} AS starred FROM para0),
para2 AS (SELECT *, NOT hashed AND regexp_matches(starred, '^\d+(\.\d+)*\.?\s') AS numbers FROM para1),
para3 AS (SELECT *, CASE WHEN hashed THEN inner_ WHEN numbers THEN starred ELSE single END AS txt, regexp_extract({_linked("single")}, '^(\*\*\*.+?\*\*\*|___.+?___|\*\*.+?\*\*|__.+?__)', 1) AS lead FROM para2),
para AS (SELECT * EXCLUDE (lead, txt), txt, hashed OR numbers AS heading_like, {strip_inline("txt")} AS text,
   CASE WHEN NOT (hashed OR numbers) AND lower({trimmed(r"regexp_replace(lead, '^(\*\*\*|___|\*\*|__)|(\*\*\*|___|\*\*|__)$', '', 'g')")}) IN ({_CALLOUTS}) THEN {trimmed(r"regexp_replace(lead, '^(\*\*\*|___|\*\*|__)|(\*\*\*|___|\*\*|__)$', '', 'g')")} END AS label FROM para3),
raws AS (SELECT doc_id, sec_no, block_no, kind, first(line ORDER BY line_no) AS head, string_agg(line, chr(10) ORDER BY line_no) AS body, count(*) AS n_lines, count(*) FILTER (mode = 'b') AS n_body,
   max(len(string_split(regexp_replace(regexp_replace({trimmed("line")}, '^\|', ''), '\|$', ''), '|'))) AS n_cells FROM i5 WHERE kind <> 'text' GROUP BY 1, 2, 3, 4),
blk AS (SELECT doc_id, sec_no, block_no, part_no, CASE WHEN label IS NULL THEN 'paragraph' ELSE 'callout' END AS kind, text, label, NULL AS lang, NULL AS formula, CAST(NULL AS BOOLEAN) AS ordered, NULL AS ncols, CAST(NULL AS BOOLEAN) AS header, heading_like, 1 AS n_para, raw, txt
  FROM para UNION ALL
 SELECT * FROM (SELECT doc_id, sec_no, block_no, 0, kind, NULL, NULL, CASE kind WHEN 'code' THEN regexp_extract(head, '^\s*(```|~~~)\s*([A-Za-z0-9_+-]*)\s*$', 2) END,
  CASE kind WHEN 'equation' THEN {trimmed(r"regexp_replace(replace(body, '$$', ' '), '\\tag\{[^}]*\}', '', 'g')")} END AS f, CASE kind WHEN 'list' THEN regexp_matches(head, '^\s*\d+[.)]\s+') END,
  CASE kind WHEN 'table' THEN n_cells END, CASE kind WHEN 'table' THEN n_lines > 1 END, NULL, CASE kind WHEN 'list' THEN n_lines WHEN 'code' THEN n_body ELSE 0 END, NULL, NULL FROM raws) WHERE kind <> 'equation' OR f <> ''),
stats AS (SELECT doc_id, sec_no, CAST(sum(n_para) AS BIGINT) AS paragraph_count, CAST(sum(CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) END) AS BIGINT) AS word_count,
   left(first(text ORDER BY block_no, part_no) FILTER (text IS NOT NULL), 200) AS first_paragraph, bool_or(regexp_matches(raw, '!\[([^\]]*)\]\(([^)]+)\)')) AS has_image,
   bool_or(regexp_matches(raw, '(?s)\$\$(.+?)\$\$') OR regexp_matches(raw, '(?:^|[^$])\$(?:[^$\n]|[^$\n][^\n]*[^$\n])\$(?:[^$]|$)')) AS has_math, bool_or(regexp_matches(raw, '\*\*(.+?)\*\*')) AS has_bold,
   bool_or(regexp_matches(raw, '(?:^|[^*])\*(?:[^*\n]|[^*\n][^\n]*[^*\n])\*(?:[^*]|$)')) AS has_italic FROM blk GROUP BY 1, 2),
secs AS (SELECT t.doc_id, CAST(t.sec_no AS BIGINT) AS sec_no, t.tag, t.title, t.level, coalesce(s.paragraph_count, 0) AS paragraph_count, coalesce(s.word_count, 0) AS word_count, coalesce(s.first_paragraph, '') AS first_paragraph,
   s.has_image, s.has_math, s.has_bold, s.has_italic FROM tagged t LEFT JOIN stats s USING (doc_id, sec_no))"""

#: CTEs after BLOCKS: tree (secs with parent, depth and words below).
TREE = """
up AS (SELECT s.*, (SELECT max(p.sec_no) FROM secs p WHERE p.doc_id = s.doc_id AND p.sec_no < s.sec_no AND p.level < s.level) AS parent_no,
   (SELECT min(n.sec_no) FROM secs n WHERE n.doc_id = s.doc_id AND n.sec_no > s.sec_no AND n.level <= s.level) AS until FROM secs s),
tree AS (SELECT u.*, p.tag AS parent_id, CASE WHEN u.parent_no IS NULL THEN 0 WHEN p.parent_no IS NULL THEN 1 ELSE 2 END AS depth,
   CAST(coalesce((SELECT sum(c.word_count) FROM secs c WHERE c.doc_id = u.doc_id AND c.sec_no > u.sec_no AND c.sec_no < coalesce(u.until, 1000000000)), 0) AS BIGINT) AS child_word_count
   FROM up u LEFT JOIN up p ON p.doc_id = u.doc_id AND p.sec_no = u.parent_no)"""

SLUG = """trim(regexp_replace(regexp_replace(translate(trim(lower({x})), 'àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ', 'aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyd'), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-')"""


def inline_runs() -> str:
    lines = "md_lines AS (SELECT doc_id, line_no, line FROM md_corpus, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) WITH ORDINALITY AS u(line, line_no))"
    return f"""WITH {X.md_corpus_sql()}, {lines}, texts AS (SELECT DISTINCT line AS txt FROM md_lines), {runs("texts")}
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(n AS INT) AS run_no, t AS text, code IN ('b', 'bi') AS bold, code IN ('i', 'bi') AS italic, code = 'sup' AS sup, code = 'sub' AS sub, code = 'm' AS math FROM md_lines JOIN run ON line = txt"""


def content_blocks() -> str:
    return f"""WITH {sections("plain")}, {BLOCKS}, texts AS (SELECT DISTINCT txt FROM blk WHERE txt IS NOT NULL), {runs("texts")}, n AS (SELECT txt, count(*) AS n FROM run GROUP BY 1)
SELECT b.doc_id, CAST(b.sec_no AS BIGINT) AS sec_no, CAST(b.block_no AS BIGINT) AS block_no, CAST(b.part_no AS INT) AS part_no, b.kind, b.text, b.label, b.lang, b.formula, b.ordered, CAST(b.ncols AS INT) AS ncols, b.header, b.heading_like,
  CAST(CASE WHEN b.txt IS NULL THEN NULL WHEN b.heading_like AND NOT b.raw LIKE '####%' THEN 1 ELSE n.n END AS INT) AS n_runs FROM blk b LEFT JOIN n ON n.txt = b.txt"""


def section_stats() -> str:
    return f"""WITH {sections("plain")}, {BLOCKS}, {TREE}
SELECT doc_id, sec_no, tag, title, {SLUG.format(x="title")} AS source_anchor, parent_id, CAST(depth AS INT) AS depth, paragraph_count, word_count, child_word_count, first_paragraph, has_image, has_math, has_bold, has_italic FROM tree"""


# ---- profiles, as resolved: rules, role texts, placements ---------------------------------------

_PROFILES = {"paper": [], "report": [("discussion", ["OVERVIEW"])]}


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else _q(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def _profile_tables() -> str:
    terms, docs, places = [], [], []
    vocabulary = [r for r, *_ in X.BASE_ROLES] + [r for r, base, *_ in profiles.SIGNALS if not base]
    said = {r: d for r, _, _, d in X.BASE_ROLES} | profiles.NEW_ROLE_DESCRIPTIONS
    for name, extra in _PROFILES.items():
        rules = extra + [(r, t) for r, _, t, _, _ in profiles.SIGNALS]
        terms += [(name, i, r, t) for i, (r, ts) in enumerate(rules) for t in ts]
        own = lambda r: [t for s, ts in rules if s == r for t in ts]  # noqa: B023, E731
        docs += [(name, i, r, " ".join([r.replace("_", " "), said[r], *own(r)])) for i, r in enumerate(vocabulary) if r != "generic"]
        placed = {r: (s, t) for r, s, t, _ in X.BASE_ROLES} | {r: (s, t) for r, base, _, s, t in profiles.SIGNALS if not base}
        places += [(name, r, s, t, "preserve" if (name, r) == ("report", "abstract") else "replace") for r, (s, t) in placed.items()]
    return f"""terms AS (SELECT * FROM {_values(terms)} AS v(profile_id, rule_idx, role, term)), roledocs AS (SELECT * FROM {_values(docs)} AS v(profile_id, vocab_idx, role, text)),
places AS (SELECT * FROM {_values(places)} AS v(profile_id, role, section, toc, intent))"""


def _similar(source: str, name: str) -> str:
    """CTEs to `name` (profile_id, query, role, similarity): the best role of each text of `source` (profile_id, query)."""
    grams = "unnest(list_transform(range(1, length(word) - n + 2), lambda i: substr(word, i, n))) AS gram"
    words = "' ' || unnest(regexp_extract_all(strip_accents(lower({x})), '[\\p{{L}}\\p{{N}}_]+')) || ' ' AS word"
    return f"""
{name}_q AS (SELECT profile_id, query, gram, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT profile_id, query, {grams} FROM (SELECT profile_id, query, {words.format(x="query")} FROM {source}), (VALUES (3), (4), (5)) AS s(n) WHERE length(word) >= n) GROUP BY 1, 2, 3),
{name}_r AS (SELECT profile_id, role, vocab_idx, gram, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT profile_id, role, vocab_idx, {grams} FROM (SELECT profile_id, role, vocab_idx, {words.format(x="text")} FROM roledocs), (VALUES (3), (4), (5)) AS s(n) WHERE length(word) >= n) GROUP BY 1, 2, 3, 4),
{name}_i AS (SELECT profile_id, gram, ln((any_value(r) + 1.0) / (count(DISTINCT role) + 1.0)) + 1 AS idf FROM {name}_r JOIN (SELECT profile_id, count(DISTINCT role) AS r FROM roledocs GROUP BY 1) USING (profile_id) GROUP BY 1, 2),
{name}_qw AS (SELECT q.*, coalesce(idf, 1.0) AS w FROM {name}_q q LEFT JOIN {name}_i USING (profile_id, gram)),
{name}_qn AS (SELECT profile_id, query, sqrt(sum((tf * w) ** 2)) AS n FROM {name}_qw GROUP BY 1, 2), {name}_rn AS (SELECT profile_id, role, sqrt(sum((tf * idf) ** 2)) AS n FROM {name}_r JOIN {name}_i USING (profile_id, gram) GROUP BY 1, 2),
{name}_c AS (SELECT q.profile_id, q.query, r.role, min(r.vocab_idx) AS vocab_idx, sum(q.tf * r.tf * i.idf ** 2) / (any_value(qn.n) * any_value(rn.n)) AS similarity FROM {name}_q q JOIN {name}_r r USING (profile_id, gram) JOIN {name}_i i USING (profile_id, gram)
   JOIN {name}_qn qn ON qn.profile_id = q.profile_id AND qn.query = q.query JOIN {name}_rn rn ON rn.profile_id = q.profile_id AND rn.role = r.role GROUP BY 1, 2, 3),
{name} AS (SELECT profile_id, query, role, similarity FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, query ORDER BY similarity DESC, vocab_idx) AS k FROM {name}_c) WHERE k = 1)"""


def routed(lazy: bool) -> str:
    """CTEs up to routed (doc_id, sec_no, node_id, profile_id, level, title, first_paragraph, semantic_role, confidence, evidence)."""
    first = f"""{sections()}, {BLOCKS}, {_profile_tables()},
nodes AS (SELECT doc_id, sec_no, tag AS node_id, level, title, first_paragraph, CASE WHEN doc_id % 3 = 1 THEN 'report' ELSE 'paper' END AS profile_id FROM secs),
hit AS (SELECT profile_id, title, min(rule_idx) AS rule_idx FROM (SELECT DISTINCT profile_id, title FROM nodes) JOIN terms USING (profile_id) WHERE contains(upper(title), upper(term)) GROUP BY 1, 2),
kw AS (SELECT n.*, r.role AS kw_role FROM nodes n LEFT JOIN hit USING (profile_id, title) LEFT JOIN (SELECT DISTINCT profile_id, rule_idx, role FROM terms) r ON r.profile_id = n.profile_id AND r.rule_idx = hit.rule_idx),
open_ AS (SELECT DISTINCT profile_id, title AS query FROM kw WHERE kw_role IS NULL), {_similar("open_", "near1")},
two AS (SELECT k.*, CASE WHEN kw_role IS NULL THEN near1.role END AS r2, CASE WHEN kw_role IS NULL THEN coalesce(near1.similarity, 0) END AS s2 FROM kw k LEFT JOIN near1 ON near1.profile_id = k.profile_id AND near1.query = k.title)"""
    if lazy:
        first += f""", more AS (SELECT *, CASE WHEN kw_role IS NULL AND s2 < 0.16 AND first_paragraph <> '' THEN title || ' ' || first_paragraph END AS longer FROM two),
open2 AS (SELECT DISTINCT profile_id, longer AS query FROM more WHERE longer IS NOT NULL), {_similar("open2", "near2")},
three AS (SELECT m.*, coalesce(near2.similarity > s2, false) AS better, near2.role AS r3, near2.similarity AS s3 FROM more m LEFT JOIN near2 ON near2.profile_id = m.profile_id AND near2.query = m.longer),
last_ AS (SELECT *, CASE WHEN better THEN r3 ELSE r2 END AS r, CASE WHEN better THEN s3 ELSE s2 END AS s, CASE WHEN better THEN 'ngram+summary' ELSE 'fallback' END AS label FROM three)"""
    else:
        first += ", last_ AS (SELECT *, r2 AS r, s2 AS s, 'fallback' AS label FROM two)"
    return f"""{first},
routed AS (SELECT doc_id, sec_no, node_id, profile_id, level, title, first_paragraph, CASE WHEN kw_role IS NOT NULL THEN kw_role WHEN s >= 0.16 THEN r ELSE 'generic' END AS semantic_role,
   CASE WHEN kw_role IS NOT NULL THEN 0.9::DOUBLE WHEN s >= 0.16 THEN round(least(0.85::DOUBLE, 0.5 + s), 2) ELSE 0.3::DOUBLE END AS confidence,
   CASE WHEN kw_role IS NOT NULL THEN 'heading' WHEN s >= 0.16 AND label = 'fallback' THEN 'ngram' ELSE label END AS evidence FROM last_)"""


def router_roles() -> str:
    return f"WITH {routed(True)} SELECT doc_id, node_id, semantic_role, confidence, evidence FROM routed"


#: CTEs after `routed`: logical (placement of every node).
LOGICAL = """
pl AS (SELECT r.*, p.intent AS intent0, p.intent = 'preserve' AND r.profile_id = 'report' AND r.semantic_role = 'abstract' AND r.confidence < 0.85 AS low FROM routed r JOIN places p ON p.profile_id = r.profile_id AND p.role = r.semantic_role),
pm AS (SELECT pl.*, CASE WHEN low THEN 'generic' ELSE semantic_role END AS role FROM pl),
pn AS (SELECT pm.*, p.section, p.toc, p.intent FROM pm JOIN places p ON p.profile_id = pm.profile_id AND p.role = pm.role),
po AS (SELECT *, coalesce(min(CASE WHEN intent NOT IN ('preserve', 'remove') THEN level END) OVER (PARTITION BY doc_id) - 1, 0) AS shift FROM pn),
logical AS (SELECT doc_id, sec_no, node_id, profile_id, intent, CASE WHEN level - shift <= 1 THEN 'major_section' WHEN level - shift = 2 THEN 'minor_section' ELSE 'sub_section' END AS presentation, section AS logical_section,
  CAST(greatest(1, level - shift) AS INT) AS outline_level, toc AND profile_id <> 'report' AS toc, 'role:' || role AS resolved_by, confidence, 'clone' AS strategy, CASE profile_id WHEN 'report' THEN 'replace' ELSE 'preserve' END AS front_matter_strategy,
  CAST(shift AS INT) AS outline_shift FROM po)"""


def logical_placement() -> str:
    return f"WITH {routed(False)}, {LOGICAL} SELECT * FROM logical"


def stage2_worklist() -> str:
    return f"WITH {routed(False)} SELECT doc_id, node_id, profile_id, semantic_role, confidence, title, level, first_paragraph FROM routed WHERE confidence < 0.7"


def logical_docs() -> str:
    return f"""WITH {routed(False)}, {LOGICAL},
feats AS (SELECT DISTINCT doc_id, kind AS feature FROM blk WHERE kind IN ('table', 'code', 'equation', 'list', 'callout') UNION SELECT doc_id, 'math' FROM secs WHERE has_math UNION SELECT doc_id, 'image' FROM secs WHERE has_image),
rep AS (SELECT doc_id, string_agg(feature, ',' ORDER BY feature) AS degraded FROM feats WHERE doc_id % 3 = 1 AND feature IN ('equation', 'math') GROUP BY 1)
SELECT l.doc_id, profile_id, strategy, front_matter_strategy, outline_shift, count(*) FILTER (intent NOT IN ('preserve', 'remove')) AS emitted, count(*) FILTER (intent = 'preserve') AS preserved, coalesce(any_value(degraded), '') AS degraded
FROM logical l LEFT JOIN rep USING (doc_id) GROUP BY ALL"""


def capability_report() -> str:
    return f"""WITH {sections()}, {BLOCKS}, feats AS (SELECT DISTINCT doc_id, kind AS feature FROM blk WHERE kind = 'equation' UNION SELECT doc_id, 'math' FROM secs WHERE has_math)
SELECT doc_id, feature, 'equation' AS capability, 'degraded' AS status, CASE feature WHEN 'math' THEN {_q(profiles.FEATURES["math"][1])} ELSE {_q(profiles.FEATURES["equation"][1])} END AS note FROM feats WHERE doc_id % 3 = 1"""


# ---- templates and slots ------------------------------------------------------------------------


def norm_title(x: str) -> str:
    low = rf"regexp_replace({trimmed(f'lower({x})')}, '[.…]+', '', 'g')"
    return rf"regexp_replace(regexp_replace({low}, '\s+', ' ', 'g'), '^[ :-]+|[ :-]+$', '', 'g')"


PLACEHOLDER = r"""trim({x}) <> '' AND regexp_matches({x}, '[.…]{{3,}}|_{{3,}}|\{{\{{.*?\}}\}}|^\s*\[[^\]]*\]\s*$|(?i:\bx{{3,}}\b)|(?i:lorem ipsum)|…')"""


def slots(emitted: str | None = None) -> str:
    """CTEs after _PARAS_SQL and `secs`: classed (each document's template children with role and trailing). emitted: a condition on logical nodes, if they decide."""
    titles = "secs s" if emitted is None else f"secs s JOIN logical l ON l.doc_id = s.doc_id AND l.node_id = s.tag AND {emitted}"
    return f"""
assigned AS (SELECT doc_id, doc_id % (SELECT max(template_id) + 1 FROM paras) AS template_id, CASE WHEN doc_id % 3 = 1 THEN 'replace' ELSE 'preserve' END AS strategy FROM md_corpus),
child0 AS (SELECT template_id, seq, CASE WHEN in_table THEN 'tbl' ELSE 'p' END AS kind, CASE WHEN NOT in_table THEN para_id END AS para_id, CASE WHEN in_table THEN CAST(seq // 10 + 1 AS INT) END AS tbl_index, text, is_heading FROM paras),
child AS (SELECT *, CAST(row_number() OVER (PARTITION BY template_id ORDER BY seq) - 1 AS INT) AS pos, bool_or(is_heading) OVER (PARTITION BY template_id) AS headed, {norm_title("text")} AS norm FROM child0),
wanted AS (SELECT DISTINCT s.doc_id, {norm_title("s.title")} AS title FROM {titles} WHERE trim(s.title) <> ''),
anchor AS (SELECT a.doc_id, c.pos FROM assigned a JOIN child c USING (template_id) WHERE c.kind = 'p' AND (c.is_heading OR ({PLACEHOLDER.format(x="c.text")})) UNION ALL
  SELECT a.doc_id, c.pos FROM assigned a JOIN child c USING (template_id) JOIN wanted w ON w.doc_id = a.doc_id WHERE c.kind = 'p' AND NOT c.headed AND length(c.norm) >= 3 AND w.title <> ''
    AND (c.norm = w.title OR (length(c.norm) >= 10 AND length(w.title) >= 10 AND (starts_with(c.norm, w.title) OR starts_with(w.title, c.norm))))),
span AS (SELECT doc_id, min(pos) AS lo, max(pos) AS hi FROM anchor GROUP BY 1),
classed AS (SELECT doc_id, template_id, pos, kind, para_id, tbl_index, coalesce(pos BETWEEN lo AND hi, false) AS inside, coalesce(pos > hi, false) AS after_ FROM
  (SELECT a.doc_id, a.template_id, c.pos, c.kind, c.para_id, c.tbl_index, CASE WHEN strategy = 'replace' AND lo IS NOT NULL THEN 0 ELSE lo END AS lo, CASE WHEN strategy = 'replace' AND hi IS NOT NULL THEN 100000 ELSE hi END AS hi
   FROM assigned a JOIN child c USING (template_id) LEFT JOIN span USING (doc_id)))"""


def slot_classes(paras: str) -> str:
    return f"""WITH {sections()}, {BLOCKS}, {paras}, {slots()}
SELECT doc_id, template_id, pos, kind, para_id, tbl_index, CASE WHEN inside THEN 'slot' ELSE 'furniture' END || CASE WHEN kind = 'tbl' THEN '_table' ELSE '' END AS role, after_ AS "trailing" FROM classed"""


def _counts(paras: str) -> str:
    """CTEs up to doc_ops: how many operations of each kind a document's plan has."""
    cells = f"list_transform(string_split(regexp_replace(regexp_replace({trimmed('line')}, '^\\|', ''), '\\|$', ''), '|'), lambda x: {trimmed('x')})"
    item = r"CASE WHEN regexp_matches(line, '^\s*\d+[.)]\s+') THEN regexp_extract(line, '^\s*\d+[.)]\s+(.*)$', 1) ELSE regexp_extract(line, '^\s*[-*+]\s+(.*)$', 1) END"
    return f"""{routed(False)}, {LOGICAL}, {paras}, {slots("l.intent NOT IN ('preserve', 'remove')")},
live AS (SELECT doc_id, sec_no, presentation FROM logical WHERE intent NOT IN ('preserve', 'remove')),
piece AS (SELECT doc_id, sec_no, txt, heading_like AND NOT raw LIKE '####%' AS one FROM blk WHERE txt IS NOT NULL UNION ALL SELECT doc_id, sec_no, {trimmed(item)}, false FROM i5 WHERE kind = 'list'
  UNION ALL SELECT doc_id, sec_no, unnest({cells}), false FROM i5 WHERE kind = 'table'),
texts AS (SELECT DISTINCT txt FROM piece), {runs("texts")},
per_text AS (SELECT txt, count(*) FILTER (code <> 'm' AND t <> '') AS r, count(*) FILTER (code = 'm') AS e FROM run GROUP BY 1),
in_text AS (SELECT doc_id, sum(CASE WHEN one THEN 1 ELSE r END) AS r, sum(CASE WHEN one THEN 0 ELSE e END) AS e FROM piece JOIN live USING (doc_id, sec_no) JOIN per_text USING (txt) GROUP BY 1),
in_block AS (SELECT b.doc_id, sum(n_para) AS p, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'equation') AS eq, sum(CASE kind WHEN 'code' THEN n_para ELSE 0 END) AS code FROM blk b JOIN live USING (doc_id, sec_no) GROUP BY 1),
rows_ AS (SELECT doc_id, sum(n) AS n FROM (SELECT i.doc_id, count(*) - 1 AS n FROM i5 i JOIN live USING (doc_id, sec_no) WHERE i.kind = 'table' GROUP BY i.doc_id, i.sec_no, i.block_no) GROUP BY 1),
in_head AS (SELECT l.doc_id, count(*) AS p, count(*) FILTER (s.title <> '') AS r FROM live l JOIN secs s USING (doc_id, sec_no) GROUP BY 1),
in_slot AS (SELECT doc_id, count(*) FILTER (inside) AS removes, count(*) FILTER (after_) AS moves FROM classed GROUP BY 1),
doc_ops AS (SELECT doc_id, coalesce(sl.removes, 0) AS removes, coalesce(sl.moves, 0) AS moves, coalesce(h.p, 0) + coalesce(b.p, 0) AS paragraphs, coalesce(h.r, 0) + coalesce(t.r, 0) + coalesce(b.code, 0) AS runs, coalesce(b.tables, 0) AS tables,
  coalesce(b.eq, 0) + coalesce(t.e, 0) AS equations, coalesce(w.n, 0) AS table_rows FROM md_corpus LEFT JOIN in_slot sl USING (doc_id) LEFT JOIN in_head h USING (doc_id) LEFT JOIN in_block b USING (doc_id) LEFT JOIN in_text t USING (doc_id) LEFT JOIN rows_ w USING (doc_id))"""


def plan_summary(paras: str) -> str:
    n = "paragraphs + runs + tables + equations + table_rows"
    return f"""WITH {_counts(paras)} SELECT doc_id, {", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in {"ops": f"removes + moves + {n}", "removes": "removes", "adds": n, "moves": "moves", "paragraphs": "paragraphs", "runs": "runs", "tables": "tables", "equations": "equations"}.items())}
FROM doc_ops WHERE removes + moves + {n} > 0"""


def template_tables(paras: str) -> str:
    return f"WITH {paras} SELECT DISTINCT template_id, CAST(seq // 10 + 1 AS INT) AS tbl_index, '/body/tbl[' || (seq // 10 + 1) || ']' AS path, 1 AS rows FROM paras WHERE in_table"


def template_outline_ids(paras: str) -> str:
    return f"""WITH {paras}, o AS (SELECT template_id, seq, style, para_id, {trimmed("text")} AS txt, row_number() OVER (PARTITION BY template_id ORDER BY seq) AS index FROM paras WHERE is_heading),
e AS (SELECT template_id, txt, arg_max(para_id, (style, seq)) AS pid, min((style, seq)) AS place FROM o WHERE txt <> '' GROUP BY 1, 2),
l AS (SELECT o.template_id, o.index, arg_min(e.pid, e.place) AS pid FROM o JOIN e ON e.template_id = o.template_id AND (starts_with(e.txt, o.txt) OR starts_with(o.txt, left(e.txt, least(length(o.txt), 10)))) GROUP BY 1, 2)
SELECT o.template_id, CAST(o.index AS INT) AS index, (SELECT text FROM paras p WHERE p.template_id = o.template_id AND p.seq = o.seq) AS text, o.style, coalesce(e.pid, l.pid) AS para_id FROM o LEFT JOIN e USING (template_id, txt) LEFT JOIN l ON l.template_id = o.template_id AND l.index = o.index"""


def heading_ids(paras: str) -> str:
    return f"WITH {paras} SELECT template_id, string_agg(para_id, ',' ORDER BY style, seq) AS heading_ids FROM paras WHERE is_heading GROUP BY 1"


def prototype_counts(paras: str) -> str:
    return f"WITH {paras} SELECT template_id, coalesce(style, 'Normal') AS style_name, count(*) AS n, first(para_id ORDER BY seq) AS first_para FROM paras GROUP BY 1, 2"


def tree_nodes() -> str:
    return f"WITH {sections()}, {BLOCKS}, {TREE} SELECT doc_id, sec_no, tag AS node_id, parent_id, title, level, word_count, child_word_count, first_paragraph FROM tree"


def profile_errors() -> str:
    return "SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'orphan' ELSE 'a' END AS id, CASE doc_id % 12 WHEN 0 THEN 'missing parent: nowhere' ELSE 'cycle: a -> b -> a' END AS error FROM documents WHERE doc_id % 12 < 2"


def content_json() -> str:
    return f"""WITH {sections()}, {BLOCKS}, {TREE}, k AS (SELECT doc_id, sec_no, string_agg(kind, ',' ORDER BY block_no, part_no) AS kinds FROM blk GROUP BY 1, 2),
n AS (SELECT doc_id, count(*) AS n, string_agg(tag || ':' || coalesce(kinds, ''), '|' ORDER BY sec_no) AS kinds, string_agg(concat_ws('<', tag, parent_id), '|' ORDER BY sec_no) AS tree FROM tree LEFT JOIN k USING (doc_id, sec_no) GROUP BY 1)
SELECT doc_id, 'doc-' || doc_id || '.md' AS source_file, CAST(coalesce(n.n, 0) AS INT) AS section_count, coalesce(n.kinds, '') AS kinds, coalesce(n.tree, '') AS tree FROM documents LEFT JOIN n USING (doc_id)"""


# ---- operations, built documents, checks, readback ----------------------------------------------

_LAST = "/body/p[last()]"


def _formula(x: str) -> str:
    from foliograph.functions.text import SIZING

    for old, new in SIZING:
        x = f"replace({x}, {_q(old)}, {_q(new)})"
    return x


def _pairs(**values: str) -> str:
    """A list of (key, value) structs; a double underscore in a name stands for a dot. Null values count as absent later."""
    return "[" + ", ".join(f"{{'key': '{k.replace('__', '.')}', 'value': {v}}}" for k, v in values.items()) + "]"


_NO_PAIRS = "CAST([] AS STRUCT(key VARCHAR, value VARCHAR)[])"


def _over(under: str, over: str) -> str:
    """The pairs of both lists in the order of their keys; those of `over` win."""
    return f"list_sort(list_concat(list_filter({under}, lambda u: u.value IS NOT NULL AND NOT list_contains(list_transform(list_filter({over}, lambda o: o.value IS NOT NULL), lambda o: o.key), u.key)), list_filter({over}, lambda o: o.value IS NOT NULL)))"


def _operations(paras: str) -> str:
    """CTEs up to ops (doc_id, op_seq, command, type, parent, path, before_, text, style, display, base, more): the whole plan in order.

    base names the properties that an operation starts from (body, run, head), more has those on top of them; a heading's paragraph carries the title as text.
    """
    cells = f"string_split(regexp_replace(regexp_replace({trimmed('line')}, '^\\|', ''), '\\|$', ''), '|')"
    item = r"CASE WHEN regexp_matches(line, '^\s*\d+[.)]\s+') THEN regexp_extract(line, '^\s*\d+[.)]\s+(.*)$', 1) ELSE regexp_extract(line, '^\s*[-*+]\s+(.*)$', 1) END"
    ordered = _pairs(listStyle=r"CASE WHEN regexp_matches(head, '^\s*\d+[.)]\s+') THEN 'ordered' ELSE 'bullet' END")
    inside = "{'key': 'leftIndent', 'value': CASE kind WHEN 'callout' THEN '360' END}"
    marks = _pairs(
        text="coalesce(t, p.txt)", bold="CASE WHEN look IN ('both', 'bold') OR (look = '' AND code IN ('b', 'bi')) THEN 'true' END", italic="CASE WHEN look = 'both' OR (look <> 'code' AND code IN ('i', 'bi')) THEN 'true' END",
        vertAlign="CASE WHEN look <> 'code' AND code = 'sup' THEN 'superscript' WHEN look <> 'code' AND code = 'sub' THEN 'subscript' END", font__latin="CASE look WHEN 'code' THEN 'Courier New' END",
    )
    widths = _pairs(colWidths="array_to_string(list_transform(range(greatest(1, ncols)), lambda i: CAST(greatest(1200, 9000 // greatest(1, ncols)) AS VARCHAR)), ',')")
    none = f"'' AS base, {_NO_PAIRS} AS more"
    return f"""{routed(False)}, {LOGICAL}, {paras}, {slots("l.intent NOT IN ('preserve', 'remove')")},
live AS (SELECT l.doc_id, l.sec_no, l.presentation, s.title, coalesce(b.body_style, 'Normal') AS body_style FROM logical l JOIN secs s USING (doc_id, sec_no) JOIN assigned a ON a.doc_id = l.doc_id LEFT JOIN
  (SELECT template_id, style AS body_style FROM (SELECT template_id, coalesce(style, 'Normal') AS style, row_number() OVER (PARTITION BY template_id ORDER BY count(*) DESC, min(seq)) AS r FROM cohort GROUP BY 1, 2) WHERE r = 1) b USING (template_id)
  WHERE l.intent NOT IN ('preserve', 'remove')),
placed AS (SELECT i.*, row_number() OVER w - 1 AS at_, first_value(line) OVER w AS head FROM i5 i WHERE kind IN ('list', 'table') OR (kind = 'code' AND mode = 'b') WINDOW w AS (PARTITION BY doc_id, sec_no, block_no ORDER BY line_no)),
piece AS (SELECT doc_id, sec_no, block_no, part_no, 0 AS d, 0 AS c, '{_LAST}' AS parent, txt, heading_like AND NOT raw LIKE '####%' AS one, true AS own, CASE WHEN NOT heading_like THEN '' WHEN raw LIKE '####%' THEN 'bold' ELSE 'both' END AS look, [{inside}] AS more FROM blk WHERE txt IS NOT NULL
  UNION ALL SELECT doc_id, sec_no, block_no, 0, at_, 0, '{_LAST}', {trimmed(item)}, false, true, '', {ordered} FROM placed WHERE kind = 'list' UNION ALL SELECT doc_id, sec_no, block_no, 0, at_, 0, '{_LAST}', CASE line WHEN '' THEN ' ' ELSE line END, true, true, 'code', {_NO_PAIRS} FROM placed WHERE kind = 'code'
  UNION ALL SELECT doc_id, sec_no, block_no, 0, at_, c - 1, '/body/tbl[last()]/tr[last()]/tc[' || c || ']/p[last()]', {trimmed("x")}, false, false, '', {_NO_PAIRS} FROM placed, unnest({cells}) WITH ORDINALITY AS u(x, c) WHERE kind = 'table'),
texts AS (SELECT DISTINCT txt FROM piece WHERE NOT one), {runs("texts")},
raw_ops AS (
  SELECT doc_id, 0 AS k0, pos AS k1, 0 AS k2, 0 AS k3, 0 AS k4, 0 AS k5, 'remove' AS command, NULL AS type, NULL AS parent, '/body/p[@paraId=' || para_id || ']' AS path, NULL AS before_, NULL AS text, NULL AS style, false AS display, {none} FROM classed WHERE inside AND kind = 'p'
  UNION ALL SELECT doc_id, 1, -tbl_index, 0, 0, 0, 0, 'remove', NULL, NULL, '/body/tbl[' || tbl_index || ']', NULL, NULL, NULL, false, {none} FROM classed WHERE inside AND kind = 'tbl'
  UNION ALL SELECT doc_id, 2, sec_no, -1, 0, 0, -1, 'add', 'p', '/body', NULL, NULL, title, CASE presentation WHEN 'minor_section' THEN 'Heading2' WHEN 'sub_section' THEN 'Heading3' ELSE 'Heading1' END, false, 'head', {_NO_PAIRS} FROM live
  UNION ALL SELECT doc_id, 2, sec_no, -1, 0, 0, 0, 'add', 'r', '{_LAST}', NULL, NULL, title, NULL, false, '', {_pairs(text="title")} FROM live WHERE title <> ''
  UNION ALL SELECT doc_id, 2, sec_no, block_no, part_no, d, -1, 'add', 'p', '/body', NULL, NULL, NULL, body_style, false, 'body', more FROM piece JOIN live USING (doc_id, sec_no) WHERE own
  UNION ALL SELECT doc_id, 2, sec_no, block_no, part_no, d, c * 1000000 + coalesce(n, 0), 'add', CASE code WHEN 'm' THEN 'equation' ELSE 'r' END, p.parent, NULL, NULL, CASE code WHEN 'm' THEN {_formula("t")} ELSE coalesce(t, p.txt) END, NULL, false,
    CASE code WHEN 'm' THEN '' ELSE 'run' END, CASE code WHEN 'm' THEN {_pairs(formula=_formula("t"), mode="'inline'")} ELSE {marks} END
    FROM piece p JOIN live USING (doc_id, sec_no) LEFT JOIN run ON run.txt = p.txt AND NOT p.one WHERE coalesce(t, p.txt) <> ''
  UNION ALL SELECT doc_id, 2, sec_no, block_no, 0, -1, 0, 'add', 'table', '/body', NULL, NULL, CAST(ncols AS VARCHAR), NULL, false, '', {widths} FROM blk JOIN live USING (doc_id, sec_no) WHERE kind = 'table'
  UNION ALL SELECT doc_id, 2, sec_no, block_no, 0, at_, -1, 'add', 'row', '/body/tbl[last()]', NULL, NULL, NULL, NULL, false, {none} FROM placed JOIN live USING (doc_id, sec_no) WHERE kind = 'table' AND at_ > 0
  UNION ALL SELECT doc_id, 2, sec_no, block_no, 0, 0, 0, 'add', 'equation', '/body', NULL, NULL, {_formula("formula")}, NULL, true, '', {_pairs(formula=_formula("formula"), mode="'display'")} FROM blk JOIN live USING (doc_id, sec_no) WHERE kind = 'equation'
  UNION ALL SELECT doc_id, 3, pos, 0, 0, 0, 0, 'move', NULL, NULL, CASE kind WHEN 'p' THEN '/body/p[@paraId=' || para_id || ']' ELSE '/body/tbl[' || (1 + (SELECT count(*) FROM classed f WHERE f.doc_id = c.doc_id AND f.kind = 'tbl' AND NOT f.inside AND NOT f.after_)) || ']' END, '/body/sectPr', NULL, NULL, false, {none}
    FROM classed c WHERE after_),
ops AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k0, k1, k2, k3, k4, k5) AS op_seq FROM raw_ops)"""


def _top(source: str, keys: str, value: str) -> str:
    """The most frequent value of each key, the first seen of equals."""
    return f"(SELECT {keys}, {value} FROM (SELECT {keys}, {value}, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, min(seq)) AS r FROM {source} GROUP BY {keys}, {value}) WHERE r = 1)"


def _properties() -> str:
    """CTEs after _operations: best (prototypes), fmt (each template's body and run pairs), headp (each title's) and whole (ops with props, sorted pairs)."""
    own = _pairs(style="style_name", size="eff_size", font__ascii="eff_font", font__hAnsi="eff_font", firstLineIndent="ind_first_line", align="align", lineSpacing="line_spacing", lineRule="CASE WHEN line_spacing IS NOT NULL THEN 'auto' END")
    body = _pairs(style="body_style", size="eff_size", font__ascii="eff_font", font__hAnsi="eff_font", align="align", lineSpacing="line_spacing", lineRule="CASE WHEN line_spacing IS NOT NULL THEN 'auto' END")
    styled = lambda x, style: _over(x, _pairs(style=style))
    same = "list_max(list_filter(range(1, least(length(t.n), length(c.cn)) + 1), lambda k: left(t.n, k) = left(c.cn, k)))"
    return f"""
fm AS (SELECT c.* FROM cohort c JOIN {_top("(SELECT *, row(eff_font, eff_size) AS pair FROM cohort)", "template_id", "pair")} p ON p.template_id = c.template_id AND p.pair = row(c.eff_font, c.eff_size)),
fmt AS (SELECT f.template_id, any_value(body_style) AS body_style, any_value(l.line_spacing) AS spacing, any_value({body}) AS body, any_value({_pairs(size="eff_size", font__latin="eff_font")}) AS run
  FROM (SELECT DISTINCT template_id, eff_font, eff_size FROM fm) f LEFT JOIN {_top("(SELECT * FROM fm WHERE align IS NOT NULL)", "template_id", "align")} a USING (template_id) LEFT JOIN {_top("(SELECT * FROM fm WHERE line_spacing IS NOT NULL)", "template_id", "line_spacing")} l USING (template_id)
  LEFT JOIN {_top("(SELECT template_id, seq, coalesce(style, 'Normal') AS body_style FROM cohort)", "template_id", "body_style")} s USING (template_id) GROUP BY 1),
region AS (SELECT *, coalesce(style, 'Normal') AS style_name, eff_size <> '11pt' AS sized, min(CASE WHEN is_heading THEN seq END) OVER w AS lo, max(CASE WHEN is_heading OR has_text THEN seq END) OVER w AS hi FROM paras WINDOW w AS (PARTITION BY template_id)),
proto AS (SELECT *, coalesce(seq BETWEEN lo AND hi, false) AS inside FROM region),
best AS (SELECT *, {own} AS pairs FROM proto QUALIFY row_number() OVER (PARTITION BY template_id, style_name ORDER BY inside DESC, has_text DESC, sized DESC, seq) = 1),
cand AS (SELECT *, {own} AS pairs, {norm_title("text")} AS cn FROM (SELECT *, bool_or(inside) OVER (PARTITION BY template_id, style_name) AS any_inside FROM proto) WHERE inside OR NOT any_inside),
common AS (SELECT c.template_id, c.style_name, c.pairs FROM cand c JOIN {_top("(SELECT template_id, style_name, seq, coalesce(align, '') AS modal FROM cand)", "template_id, style_name", "modal")} m ON m.template_id = c.template_id AND m.style_name = c.style_name AND m.modal = coalesce(c.align, '')
  QUALIFY row_number() OVER (PARTITION BY c.template_id, c.style_name ORDER BY c.has_text DESC, c.sized DESC, c.seq) = 1),
asked AS (SELECT DISTINCT a.template_id, o.style AS style_name, o.text AS title, {norm_title("o.text")} AS n FROM ops o JOIN assigned a USING (doc_id) WHERE o.base = 'head'),
alike AS (SELECT t.template_id, t.style_name, t.title, c.pairs, c.seq, CASE WHEN t.n = c.cn THEN 1000000 ELSE {same} END AS lcp, least(length(t.n), length(c.cn)) AS shorter FROM asked t JOIN cand c ON c.template_id = t.template_id AND c.style_name = t.style_name
  WHERE length(t.n) >= 3 AND (t.n = c.cn OR (length(t.n) >= 10 AND length(c.cn) >= 10 AND left(t.n, 10) = left(c.cn, 10)))),
closest AS (SELECT * FROM alike WHERE lcp >= 0.5 * shorter QUALIFY row_number() OVER (PARTITION BY template_id, style_name, title ORDER BY lcp DESC, seq) = 1),
headp AS (SELECT q.template_id, q.style_name, q.title, CASE WHEN coalesce(m.pairs, r.pairs) IS NOT NULL THEN {styled("coalesce(m.pairs, r.pairs)", "q.style_name")} WHEN b.pairs IS NOT NULL THEN b.pairs
   WHEN q.style_name = 'Heading3' AND b2.pairs IS NOT NULL THEN {styled("b2.pairs", "q.style_name")} ELSE {_pairs(style="q.style_name")} END AS pairs FROM asked q LEFT JOIN closest m USING (template_id, style_name, title)
   LEFT JOIN common r ON r.template_id = q.template_id AND r.style_name = q.style_name LEFT JOIN best b ON b.template_id = q.template_id AND b.style_name = q.style_name LEFT JOIN best b2 ON b2.template_id = q.template_id AND b2.style_name = 'Heading2'),
under AS (SELECT o.*, CASE o.base WHEN 'body' THEN f.body WHEN 'run' THEN f.run WHEN 'head' THEN h.pairs ELSE {_NO_PAIRS} END AS pairs FROM ops o JOIN assigned a USING (doc_id) LEFT JOIN fmt f USING (template_id) LEFT JOIN headp h ON o.base = 'head' AND h.template_id = a.template_id AND h.style_name = o.style AND h.title = o.text),
whole AS (SELECT * EXCLUDE (pairs), {_over("pairs", "more")} AS props FROM under)"""


def rebuild_plan(paras: str) -> str:
    return f"""WITH {_operations(paras)}, {_properties()}
SELECT doc_id, CAST(op_seq AS INT) AS op_seq, command, type, parent, path, before_ AS "before", CAST(to_json(props) AS VARCHAR) AS props FROM whole"""


def plan_operations(paras: str) -> str:
    return f"""WITH {_operations(paras)}
SELECT doc_id, CAST(op_seq AS INT) AS op_seq, command, type, parent, path, before_ AS "before", CASE WHEN type IN ('r', 'equation') THEN text END AS text, style FROM ops"""


def _elements(paras: str, full: bool = False) -> str:
    """CTEs after _operations: op2 (every second equation as text) and elements (doc_id, seq, kind, para_id, style, text, tbl_index, rows, cols); full: also align, size, font, ind_first_line, line_rule."""
    source = "whole" if full else f"(SELECT *, {_NO_PAIRS} AS props FROM ops)"
    value = lambda k, ps="props": f"list_filter({ps}, lambda x: x.key = '{k}')[1].value"
    first = lambda k: f"first({value(k)} ORDER BY op_seq, sub)"
    run = lambda k: f"max(CASE WHEN type = 'r' AND parent = '{_LAST}' THEN {value(k)} END)"
    return f"""{_operations(paras)}{"," + _properties() if full else ""},
bad AS (SELECT *, type = 'equation' AND op_seq % 2 = 0 AS failed, last_value(CASE WHEN type = 'p' THEN style END IGNORE NULLS) OVER w AS last_style, last_value(CASE WHEN type = 'p' THEN props END IGNORE NULLS) OVER w AS last_props FROM {source} WINDOW w AS (PARTITION BY doc_id ORDER BY op_seq)),
op2 AS (SELECT doc_id, op_seq, 0 AS sub, command, type, parent, text, style, props FROM bad WHERE NOT failed OR failed IS NULL UNION ALL SELECT doc_id, op_seq, 0, 'add', 'p', '/body', NULL, coalesce(last_style, 'Normal'), coalesce(last_props, {_pairs(style="'Normal'")}) FROM bad WHERE failed AND display
  UNION ALL SELECT doc_id, op_seq, 1, 'add', 'r', CASE WHEN display THEN '{_LAST}' ELSE parent END, '$' || text || '$', NULL, {_pairs(italic="'true'", text="'$' || text || '$'")} FROM bad WHERE failed),
begun AS (SELECT *, sum(CASE WHEN type IN ('p', 'table') OR (type = 'equation' AND parent = '/body') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY op_seq, sub) AS e FROM op2 WHERE command = 'add'),
fresh AS (SELECT doc_id, e, first(CASE type WHEN 'p' THEN 'para' ELSE type END ORDER BY op_seq, sub) AS kind, first(style ORDER BY op_seq, sub) AS style, coalesce(string_agg(CASE WHEN type = 'r' AND parent = '{_LAST}' THEN text END, '' ORDER BY op_seq, sub), '') AS text,
  1 + count(*) FILTER (type = 'row') AS n_rows, greatest(1, CAST(max(CASE WHEN type = 'table' THEN text END) AS INT)) AS n_cols, {first("align")} AS align, coalesce({first("size")}, {run("size")}) AS size, coalesce({first("font.ascii")}, {run("font.latin")}) AS font,
  {first("firstLineIndent")} AS ind_first_line, {first("lineRule")} AS line_rule FROM begun GROUP BY 1, 2),
elements AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) AS seq FROM (
  SELECT c.doc_id, CASE WHEN after_ THEN 2 ELSE 0 END AS a, c.pos AS b, CASE c.kind WHEN 'p' THEN 'para' ELSE 'table' END AS kind, c.para_id, p.style, CASE WHEN c.kind = 'p' THEN p.text END AS text, c.tbl_index, CAST(NULL AS INT) AS rows, CAST(NULL AS INT) AS cols,
    p.align, p.eff_size AS size, p.eff_font AS font, CAST(NULL AS VARCHAR) AS ind_first_line, CASE WHEN p.line_spacing IS NOT NULL THEN 'auto' END AS line_rule FROM classed c LEFT JOIN paras p ON p.template_id = c.template_id AND p.para_id = c.para_id WHERE NOT inside
  UNION ALL SELECT doc_id, 1, e, kind, NULL, style, text, NULL, CASE kind WHEN 'table' THEN n_rows END, CASE kind WHEN 'table' THEN n_cols END, align, size, font, ind_first_line, line_rule FROM fresh))"""


def applied_plan(paras: str) -> str:
    return f"""WITH {_elements(paras, full=True)} SELECT doc_id, kind, para_id, style, align, text, size, font, ind_first_line, line_rule, CAST(tbl_index AS INT) AS tbl_index, CAST(rows AS INT) AS rows, CAST(cols AS INT) AS cols, CAST(seq AS INT) AS seq FROM elements"""


def applied_elements(paras: str) -> str:
    return f"WITH {_elements(paras)} SELECT doc_id, CAST(seq AS INT) AS seq, kind, para_id, style, text, tbl_index, CAST(rows AS INT) AS rows, CAST(cols AS INT) AS cols FROM elements"


def apply_summary(paras: str) -> str:
    return f"""WITH {_operations(paras)} SELECT doc_id, count(*) AS total, count(*) FILTER (NOT coalesce(type = 'equation' AND op_seq % 2 = 0, false)) AS succeeded, count(*) FILTER (type = 'equation' AND op_seq % 2 = 0) AS failed,
 count(*) FILTER (type = 'equation' AND op_seq % 2 = 0) AS degraded FROM ops GROUP BY 1"""


def check_errors(paras: str) -> str:
    text = f"{trimmed('coalesce(text, chr(32))')} <> ''"
    return f"""WITH {_elements(paras)}, d AS (SELECT doc_id, template_id FROM assigned),
n_ops AS (SELECT doc_id, count(*) AS n, count(*) FILTER (command = 'add' AND type = 'p') AS p, count(*) FILTER (type = 'p' AND coalesce(style, '') = '') AS bare, count(*) FILTER (type = 'r' AND coalesce(text, '') = '') AS blank FROM op2 GROUP BY 1),
want AS (SELECT l.doc_id, count(*) AS h, sum(s.paragraph_count) AS b, count(*) FILTER (presentation = 'major_section') AS w1, count(*) FILTER (presentation = 'minor_section') AS w2, count(*) FILTER (presentation = 'sub_section') AS w3 FROM live l JOIN secs s USING (doc_id, sec_no) GROUP BY 1),
bs AS (SELECT template_id, style AS body_style FROM (SELECT template_id, coalesce(style, 'Normal') AS style, row_number() OVER (PARTITION BY template_id ORDER BY count(*) DESC, min(seq)) AS r FROM cohort GROUP BY 1, 2) WHERE r = 1),
got AS (SELECT e.doc_id, count(*) FILTER (kind = 'para') AS paras_, count(*) FILTER (kind = 'para' AND {text} AND style = coalesce(body_style, 'Normal')) AS body, count(*) FILTER (kind = 'para' AND {text} AND style = 'Heading1') AS g1,
  count(*) FILTER (kind = 'para' AND {text} AND style = 'Heading2') AS g2, count(*) FILTER (kind = 'para' AND {text} AND style = 'Heading3') AS g3, count(*) FILTER (kind = 'table') AS tables FROM elements e JOIN d USING (doc_id) LEFT JOIN bs USING (template_id) GROUP BY 1),
jump AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, CAST(right(style, 1) AS INT) AS level, lag(CAST(right(style, 1) AS INT)) OVER (PARTITION BY doc_id ORDER BY seq) AS prev FROM elements WHERE kind = 'para' AND regexp_matches(style, '^Heading[1-6]$')) WHERE level > prev + 1 GROUP BY 1),
lost AS (SELECT c.doc_id, count(*) FILTER (c.kind = 'tbl') AS tables, count(*) FILTER (c.kind = 'p' AND e.para_id IS NULL) AS lost FROM classed c LEFT JOIN (SELECT DISTINCT doc_id, para_id FROM elements) e ON e.doc_id = c.doc_id AND e.para_id = c.para_id WHERE NOT inside GROUP BY 1),
tally AS (SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(p, 0) AS p, coalesce(bare, 0) AS bare, coalesce(blank, 0) AS blank, coalesce(h, 0) AS h, coalesce(b, 0) AS b, coalesce(w1, 0) AS w1, coalesce(w2, 0) AS w2, coalesce(w3, 0) AS w3, coalesce(paras_, 0) AS paras_,
  coalesce(body, 0) AS body, coalesce(g1, 0) AS g1, coalesce(g2, 0) AS g2, coalesce(g3, 0) AS g3, coalesce(got.tables, 0) AS tables, (SELECT count(*) FROM jump WHERE jump.doc_id = d.doc_id) AS jumps, coalesce(lost.tables, 0) AS kept_tables, coalesce(lost.lost, 0) AS lost
  FROM d LEFT JOIN n_ops USING (doc_id) LEFT JOIN want USING (doc_id) LEFT JOIN got USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, unnest(['nonempty', 'add_p_style', 'runs_nonempty', 'para_count', 'S1', 'S5', 'S7', 'S8', 'S9']) AS name, unnest([n > 0, bare = 0, blank = 0, p = h + b, jumps = 0, paras_ > 0, b = 0 OR body >= 0.85 * b, g1 = w1 AND g2 = w2 AND g3 = w3, lost = 0 AND tables >= kept_tables]) AS passed FROM tally"""


def _rule_checks(paras: str) -> str:
    """CTEs up to verdicts (doc_id, name, passed, severity, message, details): all checks of the built documents, details joined by ' | '."""
    text = f"{trimmed('coalesce(text, chr(32))')} <> ''"
    listed = lambda value, order, most: f"array_to_string(list_transform(list_sort(list_transform(list_distinct(list({value} ORDER BY {order}) FILTER ({value} IS NOT NULL)), lambda x: {{'o': list_position(list({value} ORDER BY {order}) FILTER ({value} IS NOT NULL), x), 'x': x}}))[1:{most}], lambda y: y.x), ' | ')"

    def check(name: str, table: str, passed: str, severity: str, good: str, bad: str, details: str = "''") -> str:
        return f"SELECT d.doc_id, '{name}' AS name, {passed} AS passed, '{severity}' AS severity, CASE WHEN {passed} THEN {good} ELSE {bad} END AS message, CASE WHEN {passed} THEN '' ELSE coalesce({details}, '') END AS details FROM d LEFT JOIN {table} USING (doc_id)"

    none = "coalesce(n, 0) = 0"
    rows = [
        check("nonempty", "n_ops", "coalesce(n, 0) > 0", "error", "'the plan has ' || n || ' operations'", "'the plan has no operation'"),
        check("remove_targets", "unknown", none, "error", "'everything removed is in the template'", "n || ' removed paragraphs are unknown to the template'", "listing"),
        check("add_p_style", "bare", none, "error", "'each added paragraph has a style'", "n || ' added paragraphs have no style'", "listing"),
        check("runs_nonempty", "blank", none, "error", "'each added run has a text'", "n || ' added runs have an empty text'", "listing"),
        check("para_count", "counted", "a = h + b", "error", "a || ' paragraphs are added, as many as the content has'", "a || ' paragraphs are added, the content has ' || (h + b) || ': ' || h || ' headings and ' || b || ' in bodies'"),
        check("S1", "jump", none, "warning", "'no heading skips a level'", "n || ' headings skip a level'", "listing"),
        check("S3", "look", none, "warning", "'fonts and sizes agree in ' || coalesce(checked, 0) || ' paragraphs'", "n || ' kinds of font or size differ from the template'", "listing"),
        check("S4", "indent", none, "warning", "coalesce('bodies begin their first line at ' || expected, 'the template has no first-line indent')", "n || ' body paragraphs have another first-line indent'", "listing"),
        check("S5", "tail", "n IS NOT NULL", "error", "CASE WHEN n > 0 THEN n || ' empty paragraphs near the end' ELSE 'no empty paragraph near the end' END", "'no paragraph at all'"),
        check("S6", "exact", none, "error", "CASE WHEN checked IS NULL THEN 'the template has no line spacing' ELSE checked || ' body paragraphs have free line height' END", "n || ' body paragraphs have an exact line height'", "listing"),
        check("S7", "content", "(e = 0 OR got >= 0.85 * e)", "error", "'enough content: ' || got || ' body paragraphs of ' || e", "'content is missing: ' || got || ' body paragraphs of ' || e"),
        check("S8", "heads8", none, "error", "'as many headings as planned'", "'more or fewer headings than planned'", "listing"),
        check("S9", "kept", "(lost = 0 AND gt >= et)", "error", "'all ' || ep || ' fixed paragraphs and ' || et || ' fixed tables are there'", "'fixed parts of the template are gone'",
              "array_to_string(list_filter([CASE WHEN lost > 0 THEN lost || ' fixed paragraphs are gone: ' || ids END, CASE WHEN gt < et THEN gt || ' of ' || et || ' fixed tables are left, ' || (et - gt) || ' are gone' END], lambda x: x IS NOT NULL), ' | ')"),
    ]
    return f"""{_elements(paras, full=True)}, d AS (SELECT doc_id, template_id FROM assigned),
numbered_ops AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY op_seq, sub) - 1 AS at_ FROM op2),
n_ops AS (SELECT doc_id, count(*) AS n, count(*) FILTER (command = 'add' AND type = 'p') AS p FROM op2 GROUP BY 1),
gone AS (SELECT o.doc_id, op_seq, regexp_extract(path, '@paraId=([^\\]]+)\\]', 1) AS pid FROM ops o JOIN d USING (doc_id) WHERE command = 'remove' AND pid <> '' AND NOT EXISTS (SELECT 1 FROM paras p WHERE p.template_id = d.template_id AND p.para_id = regexp_extract(path, '@paraId=([^\\]]+)\\]', 1))),
unknown AS (SELECT doc_id, count(*) AS n, {listed("pid", "op_seq", 8)} AS listing FROM gone GROUP BY 1),
bare AS (SELECT doc_id, count(*) AS n, {listed("CAST(at_ AS VARCHAR)", "at_", 8)} AS listing FROM numbered_ops WHERE command = 'add' AND type = 'p' AND coalesce(style, '') = '' GROUP BY 1),
blank AS (SELECT doc_id, count(*) AS n, {listed("CAST(at_ AS VARCHAR)", "at_", 8)} AS listing FROM numbered_ops WHERE command = 'add' AND type = 'r' AND coalesce(text, '') = '' GROUP BY 1),
want AS (SELECT l.doc_id, count(*) AS h, CAST(sum(s.paragraph_count) AS BIGINT) AS b FROM live l JOIN secs s USING (doc_id, sec_no) GROUP BY 1),
counted AS (SELECT d.doc_id, coalesce(p, 0) AS a, coalesce(h, 0) AS h, coalesce(b, 0) AS b FROM d LEFT JOIN n_ops USING (doc_id) LEFT JOIN want USING (doc_id)),
levels AS (SELECT doc_id, seq, CAST(right(style, 1) AS INT) AS level, lag(CAST(right(style, 1) AS INT)) OVER (PARTITION BY doc_id ORDER BY seq) AS prev FROM elements WHERE kind = 'para' AND regexp_matches(style, '^Heading[1-6]$')),
jump AS (SELECT doc_id, count(*) AS n, string_agg('element ' || seq || ' goes from level ' || prev || ' to ' || level, ' | ' ORDER BY seq) AS listing FROM levels WHERE level > prev + 1 GROUP BY 1),
fixed AS (SELECT DISTINCT doc_id, para_id FROM classed WHERE NOT inside AND kind = 'p' AND coalesce(para_id, '') <> ''),
mine AS (SELECT e.*, d.template_id, f.body_style, f.spacing FROM elements e JOIN d USING (doc_id) LEFT JOIN fmt f USING (template_id) LEFT JOIN fixed x ON x.doc_id = e.doc_id AND x.para_id = e.para_id WHERE e.kind = 'para' AND {text} AND x.doc_id IS NULL),
compared AS (SELECT m.doc_id, m.style, m.seq, list_filter([CASE WHEN nullif(m.font, '') <> nullif(b.eff_font, '') THEN 'style ' || m.style || ' has font ' || m.font || ' instead of ' || b.eff_font END, CASE WHEN nullif(m.size, '') <> nullif(b.eff_size, '') THEN 'style ' || m.style || ' has size ' || m.size || ' instead of ' || b.eff_size END],
   lambda x: x IS NOT NULL) AS w FROM mine m JOIN best b ON b.template_id = m.template_id AND b.style_name = m.style WHERE m.style IN ('Heading1', 'Heading2', 'Heading3') OR m.style = m.body_style),
wrong AS (SELECT doc_id, x, min((style, seq, k)) AS place FROM compared, unnest(w) WITH ORDINALITY AS u(x, k) GROUP BY 1, 2),
look AS (SELECT c.doc_id, c.checked, w.n, w.listing FROM (SELECT doc_id, count(*) AS checked FROM compared GROUP BY 1) c LEFT JOIN (SELECT doc_id, count(*) AS n, array_to_string(list(x ORDER BY place)[1:6], ' | ') AS listing FROM wrong GROUP BY 1) w USING (doc_id)),
lines4 AS (SELECT m.doc_id, m.seq, b.ind_first_line AS exp, CASE WHEN m.ind_first_line IS DISTINCT FROM b.ind_first_line THEN left(m.text, 30) || ': first line at ' || coalesce(m.ind_first_line, 'None') || ' instead of ' || b.ind_first_line END AS said
   FROM mine m JOIN best b ON b.template_id = m.template_id AND b.style_name = m.body_style WHERE m.style = m.body_style AND coalesce(b.ind_first_line, '') NOT IN ('', '0', '0pt', '0cm')),
first4 AS (SELECT doc_id, said, min(seq) AS seq FROM lines4 WHERE said IS NOT NULL GROUP BY 1, 2),
indent AS (SELECT a.doc_id, a.n, a.expected, b.listing FROM (SELECT doc_id, count(said) AS n, max(exp) AS expected FROM lines4 GROUP BY 1) a LEFT JOIN (SELECT doc_id, array_to_string(list(said ORDER BY seq)[1:5], ' | ') AS listing FROM first4 GROUP BY 1) b USING (doc_id)),
ends AS (SELECT e.*, f.body_style, row_number() OVER (PARTITION BY e.doc_id ORDER BY seq DESC) AS back FROM elements e JOIN d USING (doc_id) LEFT JOIN fmt f USING (template_id) WHERE e.kind = 'para'),
tail AS (SELECT doc_id, count(*) FILTER (NOT ({text}) AND NOT coalesce(style IN ('Normal', 'TOC', 'No Spacing', 'Header', 'Footer') OR style = body_style, style IS NULL AND body_style IS NULL, false)) AS n FROM ends WHERE back <= 6 GROUP BY 1),
exact AS (SELECT doc_id, count(*) AS checked, count(*) FILTER (line_rule = 'exact') AS n, {listed("CASE WHEN line_rule = 'exact' THEN left(text, 30) || ': exact line height, the template has auto' END", "seq", 5)} AS listing FROM mine WHERE style = coalesce(body_style, 'Normal') AND spacing IS NOT NULL GROUP BY 1),
got7 AS (SELECT e.doc_id, count(*) AS got FROM elements e JOIN d USING (doc_id) LEFT JOIN fmt f USING (template_id) WHERE e.kind = 'para' AND {text} AND e.style = coalesce(f.body_style, 'Normal') GROUP BY 1),
content AS (SELECT d.doc_id, coalesce(got, 0) AS got, coalesce(b, 0) AS e FROM d LEFT JOIN got7 USING (doc_id) LEFT JOIN want USING (doc_id)),
planned8 AS (SELECT doc_id, CASE presentation WHEN 'major_section' THEN 'Heading1' WHEN 'minor_section' THEN 'Heading2' ELSE 'Heading3' END AS style, count(*) AS e FROM live GROUP BY 1, 2),
built8 AS (SELECT doc_id, style, count(*) AS g FROM elements WHERE kind = 'para' AND style IN ('Heading1', 'Heading2', 'Heading3') AND {text} GROUP BY 1, 2),
both8 AS (SELECT doc_id, style, coalesce(g, 0) AS g, coalesce(e, 0) AS e FROM planned8 FULL JOIN built8 USING (doc_id, style)),
heads8 AS (SELECT doc_id, count(*) AS n, array_to_string(list(style || ': ' || g || ' headings instead of ' || e ORDER BY style)[1:3], ' | ') AS listing FROM both8 WHERE g <> e GROUP BY 1),
kept AS (SELECT d.doc_id, coalesce(c.et, 0) AS et, coalesce(c.ep, 0) AS ep, coalesce(l.lost, 0) AS lost, l.ids, coalesce(g.gt, 0) AS gt FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (kind = 'tbl') AS et, count(*) FILTER (kind = 'p' AND coalesce(para_id, '') <> '') AS ep FROM classed WHERE NOT inside GROUP BY 1) c USING (doc_id)
   LEFT JOIN (SELECT x.doc_id, count(*) AS lost, array_to_string(list(x.para_id ORDER BY x.para_id)[1:5], ', ') AS ids FROM fixed x WHERE NOT EXISTS (SELECT 1 FROM elements e WHERE e.doc_id = x.doc_id AND e.para_id = x.para_id) GROUP BY 1) l USING (doc_id)
   LEFT JOIN (SELECT doc_id, count(*) FILTER (kind = 'table') AS gt FROM elements GROUP BY 1) g USING (doc_id)),
verdicts AS ({" UNION ALL ".join(rows)})"""


def rule_checks(paras: str) -> str:
    return f"WITH {_rule_checks(paras)} SELECT doc_id, name, passed, CASE WHEN passed THEN 'info' ELSE severity END AS severity, message, details FROM verdicts"


def check_verdicts(paras: str) -> str:
    return f"""WITH {_rule_checks(paras)} SELECT doc_id, count(*) FILTER (NOT passed AND severity = 'error') AS errors, count(*) FILTER (NOT passed AND severity = 'warning') AS warnings, count(*) FILTER (NOT passed AND severity = 'error') = 0 AS passed FROM verdicts GROUP BY 1"""


def readback_view(paras: str) -> str:
    heading = "coalesce(kind = 'para' AND regexp_matches(style, '^Heading[1-9]$'), false)"
    return f"""WITH {_elements(paras, full=True)}, e AS (SELECT *, coalesce(style, 'Normal') AS st, CASE WHEN cols > 0 THEN rows || '×' || cols ELSE coalesce(CAST(rows AS VARCHAR), 'None') || ' rows' END AS dim FROM elements)
SELECT doc_id, CAST(seq AS INT) AS n, CASE WHEN seq < 100 THEN lpad(CAST(seq AS VARCHAR), 3, ' ') ELSE CAST(seq AS VARCHAR) END || '  ' || CASE WHEN kind = 'table' THEN '[TABLE ' || dim || ']' WHEN coalesce(text, '') = '' THEN '[' || st || '·empty]'
  ELSE '[' || CASE WHEN {heading} THEN '#' || right(st, 1) || ' ' || st WHEN starts_with(upper(st), 'TOC') THEN 'TOC·' || st ELSE st END || CASE WHEN coalesce(align, '') <> '' THEN '·' || align ELSE '' END || '] ' || left(text, 70) || CASE WHEN length(text) > 70 THEN '…' ELSE '' END END AS line FROM e"""


def role_review() -> str:
    known = ", ".join(_q(r) for r in [r for r, *_ in X.BASE_ROLES] + [r for r, base, *_ in profiles.SIGNALS if not base])
    return f"""WITH {routed(False)}, answers AS (SELECT doc_id, 'h1_1' AS node_id, CASE WHEN quality = 1 THEN 'results' WHEN toxic = 1 THEN 'discussion' ELSE 'not_a_role' END AS said FROM labels),
merged AS (SELECT r.doc_id, r.node_id, r.profile_id, coalesce(a.said, r.semantic_role) AS role, CASE WHEN a.said IS NULL THEN r.confidence ELSE 0.9::DOUBLE END AS confidence FROM routed r LEFT JOIN answers a USING (doc_id, node_id)),
clamped AS (SELECT *, role NOT IN ({known}) AS strange FROM merged), final AS (SELECT * EXCLUDE (role, confidence), CASE WHEN strange THEN 'generic' ELSE role END AS role, CASE WHEN strange THEN 0.3::DOUBLE ELSE confidence END AS confidence FROM clamped),
gate AS (SELECT doc_id, profile_id, count(*) AS n, count(*) FILTER (role = 'generic') AS d, round(avg(confidence), 9) AS m FROM final GROUP BY 1, 2),
said AS (SELECT doc_id, node_id || ': its role ' || role || ' is none of the profile''s, so it becomes generic' AS warning FROM clamped WHERE strange
  UNION ALL SELECT doc_id, d || ' of ' || n || ' nodes have the default role generic; is ' || profile_id || ' the right profile?' FROM gate WHERE d / n > 0.6 UNION ALL SELECT doc_id, printf('the mean confidence is only %.2f', m + 0.000000001) FROM gate WHERE m < 0.5)
SELECT f.doc_id, 'router' AS model, count(*) FILTER (confidence >= 0.7) AS heading_only, count(*) FILTER (confidence < 0.7) AS needs_stage2, (SELECT string_agg(warning, ' | ' ORDER BY warning) FROM said WHERE said.doc_id = f.doc_id) AS warnings FROM final f GROUP BY f.doc_id"""


def synthesized_profiles(paras: str) -> str:
    signals = _values([(i, r, base, list_) for i, (r, base, list_, _, _) in enumerate((r, b, "|".join(t), s, c) for r, b, t, s, c in profiles.SIGNALS)])
    keys = _values([(k, c) for k, (c, _) in profiles.FEATURES.items()])
    mark = profiles.FRONT_MARK.replace("(?iu)", "(?i)")
    begins = profiles.FRONT_MARK.replace("(?iu)", "(?i)^")
    return rf"""WITH {sections()}, {BLOCKS}, {paras}, assigned AS (SELECT doc_id, doc_id % (SELECT max(template_id) + 1 FROM paras) AS template_id FROM md_corpus),
sig AS (SELECT i, role, base, string_split(terms, '|') AS terms FROM {signals} AS v(i, role, base, terms)), titles AS (SELECT doc_id, upper(title) AS t FROM tagged),
active AS (SELECT DISTINCT doc_id, i, role, base, sig.terms FROM titles, sig WHERE len(list_filter(sig.terms, lambda x: contains(t, x))) > 0),
ruled AS (SELECT doc_id, CAST(to_json(list({{'role': role, 'any': terms}} ORDER BY i)) AS VARCHAR) AS keyword_rules, string_agg(role, ',' ORDER BY i) FILTER (NOT base) AS role_vocabulary FROM active GROUP BY 1),
feats AS (SELECT doc_id, kind AS f FROM blk WHERE kind IN ('table', 'code', 'equation', 'list', 'callout') UNION SELECT doc_id, 'math' FROM secs WHERE has_math UNION SELECT doc_id, 'image' FROM secs WHERE has_image),
used AS (SELECT doc_id, string_agg(DISTINCT c, ',' ORDER BY c) AS capabilities FROM feats JOIN {keys} AS k(f, c) USING (f) GROUP BY 1),
opened AS (SELECT doc_id, sec_no FROM blk WHERE regexp_matches(coalesce(text, ''), '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]+') OR regexp_matches({trimmed("coalesce(text, '')")}, {_q(begins)}) GROUP BY 1, 2),
front AS (SELECT s.doc_id, bool_or(level = 1 AND (regexp_matches(title, {_q(mark)}) OR (s.sec_no = lo AND o.doc_id IS NOT NULL))) AS content_front FROM (SELECT *, min(sec_no) OVER (PARTITION BY doc_id) AS lo FROM secs) s LEFT JOIN opened o USING (doc_id, sec_no) GROUP BY 1),
led AS (SELECT template_id, coalesce(min(CASE WHEN has_text AND NOT is_heading THEN seq END) < min(CASE WHEN is_heading THEN seq END), min(CASE WHEN has_text AND NOT is_heading THEN seq END) IS NOT NULL AND min(CASE WHEN is_heading THEN seq END) IS NULL) AS template_front FROM paras GROUP BY 1)
SELECT a.doc_id, a.template_id, 'doc-' || a.doc_id AS id, '_base' AS extends, CASE WHEN coalesce(content_front, false) AND coalesce(template_front, false) THEN 'replace' ELSE 'preserve' END AS front_matter_strategy, coalesce(keyword_rules, '[]') AS keyword_rules, role_vocabulary, capabilities
FROM assigned a LEFT JOIN ruled USING (doc_id) LEFT JOIN used USING (doc_id) LEFT JOIN front USING (doc_id) LEFT JOIN led USING (template_id)"""


def _observed(paras: str) -> str:
    """CTEs up to observed (doc_id, signal, value, severity, note)."""
    folded = lambda x: f"{trimmed(f'regexp_replace(strip_accents(lower({x})), {_q(chr(92) + chr(115) + chr(43))}, {_q(chr(32))}, {_q(chr(103))})')}"
    shown = lambda width: f"array_to_string(list('“' || left(text, {width}) || '”' ORDER BY seq)[1:5], ' | ')"
    heading = "kind = 'para' AND coalesce(regexp_matches(style, '^Heading[1-9]$'), false)"
    return f"""{_elements(paras)}, first_ AS (SELECT doc_id, min(seq) AS h FROM elements WHERE {heading} GROUP BY 1),
src AS (SELECT doc_id, count(*) FILTER (kind = 'table') AS n FROM blk GROUP BY 1), has AS (SELECT DISTINCT doc_id FROM secs), titles AS (SELECT DISTINCT doc_id, {folded("title")} AS t FROM secs),
out_ AS (SELECT doc_id, count(*) FILTER (kind = 'table') AS n FROM elements GROUP BY 1),
source_ AS (SELECT DISTINCT doc_id, {folded("t")} AS t FROM (SELECT doc_id, title AS t FROM secs UNION ALL SELECT doc_id, coalesce(text, formula) FROM blk WHERE coalesce(text, formula) <> ''
  UNION ALL SELECT p.doc_id, run.t FROM piece p JOIN blk b USING (doc_id, sec_no, block_no) JOIN run ON run.txt = p.txt WHERE b.kind = 'table'
  UNION ALL SELECT doc_id, t FROM (SELECT p.doc_id, p.sec_no, p.block_no, p.d, string_agg(run.t, ' ' ORDER BY run.n) AS t FROM piece p JOIN blk b USING (doc_id, sec_no, block_no) JOIN run ON run.txt = p.txt WHERE b.kind = 'list' GROUP BY 1, 2, 3, 4))),
said AS (SELECT doc_id, seq, regexp_replace({folded("text")}, '^[\\s•·*▪◦‣\\-–—]+', '') AS t FROM elements JOIN has USING (doc_id) WHERE kind = 'para' AND length(text) >= 12 AND NOT starts_with(text, '[')),
phrase_ AS (SELECT doc_id, seq, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS x FROM
  (SELECT doc_id, seq, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM said WHERE t <> '')),
known AS (SELECT DISTINCT p.doc_id, p.seq FROM phrase_ p JOIN source_ s ON s.doc_id = p.doc_id AND contains(s.t, p.x)),
dims AS (SELECT doc_id, string_agg(CASE WHEN cols > 0 THEN rows || '×' || cols ELSE coalesce(CAST(rows AS VARCHAR), 'None') || ' rows' END, ', ' ORDER BY seq) AS dims FROM elements WHERE kind = 'table' GROUP BY 1),
foreign_ AS (SELECT doc_id, count(*) AS n, {shown(48)} AS ex FROM (SELECT DISTINCT p.doc_id, p.seq FROM phrase_ p ANTI JOIN known USING (doc_id, seq)) JOIN elements USING (doc_id, seq) GROUP BY 1),
extra_ AS (SELECT e.doc_id, count(*) AS n, {shown(40)} AS ex FROM elements e LEFT JOIN titles t ON t.doc_id = e.doc_id AND t.t = {folded("text")} WHERE {heading} AND coalesce(text, '') <> '' AND t.t IS NULL GROUP BY 1),
front_ AS (SELECT doc_id, count(*) FILTER (seq < h AND kind = 'para' AND coalesce(text, '') <> '') AS n FROM elements JOIN first_ USING (doc_id) GROUP BY 1),
observed AS (SELECT doc_id, 'front_matter_paragraphs' AS signal, n AS value, NULL AS severity, n || ' paragraphs with text come before any heading' AS note FROM front_
UNION ALL SELECT doc_id, 'foreign_text_paragraphs', n, 'high', n || ' paragraphs aren''t from the source, such as ' || ex FROM foreign_
UNION ALL SELECT doc_id, 'tables_in_output', n, NULL, CASE WHEN n > 0 THEN n || ' tables of ' || dims ELSE 'without tables' END FROM out_ LEFT JOIN dims USING (doc_id)
UNION ALL SELECT doc_id, 'table_count_mismatch', out_.n, 'high', out_.n || ' tables were built, the source has ' || coalesce(src.n, 0) FROM out_ JOIN has USING (doc_id) LEFT JOIN src USING (doc_id) WHERE out_.n <> coalesce(src.n, 0)
UNION ALL SELECT doc_id, 'headings_not_in_source', n, 'high', 'headings the source does not have: ' || ex FROM extra_)"""


def readback_observations(paras: str) -> str:
    return f"WITH {_observed(paras)} SELECT doc_id, signal, value, severity, note FROM observed"


def readback_counts(paras: str) -> str:
    return f"WITH {_observed(paras)} SELECT doc_id, signal, value FROM observed"
