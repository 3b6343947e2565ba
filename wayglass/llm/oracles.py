"""DuckDB SQL for the corpus queries that SQL can express. Words are those between ASCII white space; A-Z only are lower-cased."""

from __future__ import annotations

from wayglass.llm.shared import LOWER, UPPER

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _fill(name: str, nodes: str, parent: str, key: str) -> str:
    """CTEs that share `have` of each parent among children (w, cap), full children in order of cap / w first."""
    by = f"PARTITION BY {parent}" if parent else ""
    order = f"{by} ORDER BY cap / w::DOUBLE, {key}"
    return f"""{name}_r AS (SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
  sum(w) OVER ({by}) - coalesce(sum(w) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_rest FROM {nodes}),
 {name}_f AS (SELECT *, cap::HUGEINT * w_rest::HUGEINT <= (have - cap_before)::HUGEINT * w::HUGEINT AS is_full FROM {name}_r),
 {name}_s AS (SELECT *, have - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}) AS remaining, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({by}) AS w_open FROM {name}_f),
 {name}_b AS (SELECT *, CASE WHEN is_full THEN cap ELSE (remaining::HUGEINT * w::HUGEINT) // w_open::HUGEINT END AS base FROM {name}_s),
 {name}_t AS (SELECT *, have - sum(base) OVER ({by}) AS spare, row_number() OVER ({by} ORDER BY CASE WHEN base < cap THEN 0 ELSE 1 END, {key}) AS taker FROM {name}_b),
 {name} AS (SELECT *, base + CASE WHEN base < cap AND taker <= spare THEN 1 ELSE 0 END AS got FROM {name}_t)"""


def mixing_sql(levels: list[str], weights: dict[str, dict[str, int]], share: float, max_epochs: int, seed: int) -> str:
    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.get(level, {}).items())
        return f"(CASE {level} {cases} ELSE 1 END)" if cases else "1"

    n = "regexp_extract(coalesce(source, ''), '^src([0-9]{1,9})$', 1)"
    sql = f"""WITH docs AS (SELECT doc_id, CASE WHEN {n} = '' THEN 'tail' WHEN CAST(nullif({n}, '') AS INT) = 0 THEN 'core' WHEN CAST(nullif({n}, '') AS INT) < 10 THEN 'web' ELSE 'tail' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens, md5(concat_ws(':', '{seed}', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS digest FROM documents),
 leaf AS (SELECT {', '.join(levels)}, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {max_epochs} AS cap0 FROM docs GROUP BY ALL)"""
    above, before = "", None
    for i, level in enumerate(levels):
        path = ", ".join(levels[: i + 1])
        have = f"(SELECT CAST(floor(sum(tokens) * {share}) AS BIGINT) FROM leaf)" if before is None else "p.got"
        join = f" JOIN {before} p USING ({above})" if before else ""
        sql += f""", n{i} AS (SELECT *, least(have0, sum(cap) OVER ({f'PARTITION BY {above}' if above else ''})) AS have FROM (SELECT c.*, {have} AS have0 FROM (SELECT {path}, sum(cap0)::BIGINT AS cap, {weight(level)} AS w FROM leaf GROUP BY ALL) c{join})), {_fill(f'a{i}', f'n{i}', above, level)}"""
        above, before = path, f"a{i}"
    keys = ", ".join(levels)
    return sql + f""", plan AS (SELECT {keys}, CASE WHEN leaf.tokens > 0 THEN got // leaf.tokens ELSE 0 END AS epochs, got - CASE WHEN leaf.tokens > 0 THEN got // leaf.tokens ELSE 0 END * leaf.tokens AS rest FROM leaf JOIN {before} USING ({keys})),
 run AS (SELECT *, sum(tokens) OVER (PARTITION BY {keys} ORDER BY digest, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM docs)
 SELECT doc_id, {keys}, tokens AS n_tokens, CAST(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM run JOIN plan USING ({keys})"""


EXACT = f"""SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
 FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents) WINDOW g AS (PARTITION BY t)"""

LINES = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
 k AS (SELECT *, CASE WHEN length(trim(line, {BLANKS})) >= 10 THEN translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') END AS key FROM l),
 o AS (SELECT key, min(doc_id) AS owner FROM k WHERE key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
 m AS (SELECT k.*, o.owner IS NOT NULL AND k.doc_id <> o.owner AS gone FROM k LEFT JOIN o ON k.key = o.key)
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1"""

#: Escapes add one character for each backslash and each control string of a text that holds a control string.
_CONTROL = r"(<s>\[|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)"
CHAT = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
 c AS (SELECT *, len(regexp_extract_all(text, '{_CONTROL}')) AS hits FROM t)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length('<s>[') + length(role) + length(']') + 1 + length(text) + length('</s>') + 1 + CASE WHEN hits > 0 THEN 1 + hits + length(text) - length(replace(text, chr(92), '')) ELSE 0 END) AS BIGINT) AS formatted_chars FROM c GROUP BY 1"""

MIDDLE = """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 d AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS k, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM h),
 c AS (SELECT *, CAST(len(k) AS BIGINT) AS n, least(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS a, greatest(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
 p AS (SELECT *, array_to_string(k[1:a], '') AS prefix, array_to_string(k[a + 1:b], '') AS middle, array_to_string(k[b + 1:], '') AS suffix FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


#: The CRC-32 of a decimal id, byte by byte over a table made from the polynomial.
_CRC_TABLE = "SELECT [list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) for i in range(256)] AS steps"
_CRC = "xor(list_reduce(list_concat([4294967295], [CAST(ascii(z) AS BIGINT) for z in string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)])), 4294967295)"


def merkle_sql(levels: int = 24, top_levels: int = 8) -> str:
    """The tree level by level, for up to 2 ** levels rows a language and 2 ** top_levels languages."""

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"

    def up(name: str, k: int) -> str:
        return f"{name}{k + 1} AS (SELECT tree, pos // 2 AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM {name}{k} WHERE tree IN (SELECT tree FROM {name}{k} GROUP BY 1 HAVING count(*) > 1) GROUP BY 1, 2)"

    def fold(name: str, k: int, level: str, tree: str, pos: str) -> str:
        """Beside the node at this level: none where the tree has ended, empty where it stands alone."""
        sibling = f"CASE WHEN NOT EXISTS (SELECT 1 FROM {level} o WHERE o.tree = f.{tree} AND o.pos > 0) THEN NULL ELSE coalesce(s.d, '') END"
        return f"""{name} AS (SELECT f.* EXCLUDE (x, proof, b), proof || coalesce(b, '') AS proof, CASE WHEN b IS NULL THEN x WHEN ({pos} >> {k}) % 2 = 1 THEN sha256(b || x) ELSE sha256(x || b) END AS x
  FROM (SELECT f.*, {sibling} AS b FROM {{}} f LEFT JOIN {level} s ON s.tree = f.{tree} AND s.pos = xor(f.{pos} >> {k}, 1)) f)"""

    parts = [
        f"w AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('n_chars')} AS leaf, {leaf('(n_chars + CASE WHEN coalesce(crc % 7 = 0, false) THEN 1 ELSE 0 END)')} AS changed FROM (SELECT *, {_CRC} AS crc FROM documents, ({_CRC_TABLE})))",
        "a AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM w)",
        "n0 AS (SELECT tree, pos, leaf AS d FROM a)", *(up("n", k) for k in range(levels)),
        "alln AS (" + " UNION ALL ".join(f"SELECT {k} AS k, tree, pos, d FROM n{k}" for k in range(levels + 1)) + ")",
        "sub AS (SELECT tree, arg_max(d, k) AS subroot FROM alln WHERE pos = 0 GROUP BY 1)", "t AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS place FROM sub)",
        "m0 AS (SELECT '' AS tree, place AS pos, subroot AS d FROM t)", *(up("m", k) for k in range(top_levels)),
        "top AS (SELECT arg_max(d, k) AS root FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, pos, d FROM m{k}" for k in range(top_levels + 1)) + ") WHERE pos = 0)",
        "f0 AS (SELECT a.doc_id, a.tree, '' AS one, a.pos, t.place, a.leaf, t.subroot, a.changed AS x, '' AS proof FROM a JOIN t USING (tree))",
    ]
    steps = [(f"n{k}", "tree", "pos", k) for k in range(levels)] + [(f"m{k}", "one", "place", k) for k in range(top_levels)]
    parts += [fold(f"f{i + 1}", k, level, tree, pos).format(f"f{i}") for i, (level, tree, pos, k) in enumerate(steps)]
    return "WITH " + ",\n ".join(parts) + f"\n SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, x AS folded_root, x = root AS verified FROM f{len(steps)} CROSS JOIN top"
