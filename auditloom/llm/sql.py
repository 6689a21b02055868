"""DuckDB SQL for the queries that it can express; the matcher there folds case beyond ASCII, so letters are spelled out."""

from __future__ import annotations

from auditloom.llm.secrets import RULES, Rule


def _spelled(pattern: str) -> str:
    """``(?i:...)`` as classes of both cases of each ASCII letter."""
    out, i, folded = "", 0, 0
    while i < len(pattern):
        if pattern.startswith("(?i:", i):
            out, i, folded = out + "(?:", i + 4, 1
            continue
        ch = pattern[i]
        if folded:
            folded += (ch == "(") - (ch == ")")
        out += f"[{ch.upper()}{ch}]" if folded and ch.isalpha() else ch
        i += 1
    return out


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spans(rule: Rule, rank: int) -> str:
    pattern = _text(_spelled(rule.pattern))
    lengths = lambda of: f"list_transform({of}, lambda t : length(t))"
    own = f"regexp_extract_all(txt, {pattern}, {rule.group})"
    return f"""SELECT k, list_filter(list_transform(generate_series(1, len(lens)), lambda i : struct_pack(start := list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i - 1]), 0), rank := {rank}, fin := list_sum(gaps[1:i]) + list_sum(lens[1:i]), kind := '{rule.kind}', own := owns[i])), lambda s : s.own >= {rule.least}) AS sp
      FROM (SELECT k, {lengths(f"regexp_extract_all(txt, {pattern}, 0)")} AS lens, {lengths(own)} AS owns, {lengths(f"regexp_split_to_array(txt, {pattern})")} AS gaps FROM txts)"""


def secrets() -> str:
    base = sum(rule.base for rule in RULES)
    written = lambda spans: f"coalesce(array_to_string(list_transform({spans}, lambda s : s.kind || ':' || s.start || ':' || s.fin), ','), '')"
    counts = ", ".join(f"CAST(len(list_filter(sp, lambda s : s.rank = {i})) AS BIGINT) AS n_{RULES[i].kind}" for i in range(base))
    every = " UNION ALL ".join(_spans(rule, i) for i, rule in enumerate(RULES))
    return f"""WITH txts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS txt FROM documents),
      found AS ({every}),
      sorted AS (SELECT k, list_sort(flatten(list(sp))) AS sp FROM found GROUP BY k)
      SELECT doc_id, {counts}, sha256({written(f"list_filter(sp, lambda s : s.rank < {base})")}) AS base_sha256, {written("sp")} AS spans FROM txts JOIN sorted ON txts.k = sorted.k"""


def near_copies(words: int = 5, similarity: int = 75) -> str:
    """Groups by the closure of all links between documents; a shingle is its words with spaces between."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
      sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {words} THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(ws) - {words - 1}), lambda i : array_to_string(ws[i:i + {words - 1}], ' '))) END AS sh FROM w),
      items AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS s FROM sets),
      links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {similarity} * (min(a.n) + min(b.n) - count(*))),
      reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
      least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
      SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON doc_id = a"""


def repeats(length: int = 50) -> str:
    """Every window of every text, the least document of each, and the texts without what later ones repeat (bytes as hex digits)."""
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
      sized AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
      win AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * length}) AS s FROM (SELECT doc_id, h, unnest(generate_series(0, n - {length})) AS i FROM sized WHERE n >= {length})),
      first AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
      hit AS (SELECT win.doc_id, i FROM win JOIN first ON win.s = first.s WHERE f < win.doc_id),
      prior AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM hit),
      grouped AS (SELECT doc_id, i, sum(CASE WHEN i <= p + {length} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM prior),
      runs AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS z FROM grouped GROUP BY doc_id, g),
      cuts AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM runs),
      left_ AS (SELECT cuts.doc_id, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept, sum(z - a) AS removed, count(*) AS spans FROM cuts JOIN sized ON cuts.doc_id = sized.doc_id GROUP BY cuts.doc_id)
      SELECT sized.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM sized LEFT JOIN left_ ON sized.doc_id = left_.doc_id"""
