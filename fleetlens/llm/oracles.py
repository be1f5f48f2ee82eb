"""DuckDB SQL of registered queries, where SQL can say the whole result."""

from __future__ import annotations

#: CRC-32 of ASCII text: ``crc32_of(text)`` is an expression beside the one-row table ``crc_table`` (list ``t``).
CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i)))"""


def crc32_of(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    step = "lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), {step}), 4294967295)"


def _field(x: str) -> str:
    return f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


def _levels(name: str, by: str, levels: int) -> str:
    """Levels of trees: n{k} (tree, i, n, h); a tree that has one node keeps it."""
    out = []
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT {by}, i // (CASE WHEN n > 1 THEN 16 ELSE 1 END) AS i, any_value((n + 15) // 16) AS n,
         CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h
  FROM {name}{k} GROUP BY {by}, i // (CASE WHEN n > 1 THEN 16 ELSE 1 END))""")
    return ",\n".join(out)


def _merkle(levels: int = 5, top: int = 3) -> str:
    """Trees of up to 16**levels leaves and 16**top groups."""
    steps = [("g", k) for k in range(levels)] + [("r", k) for k in range(top)]
    ctes, last = [], "f0"
    for s, (name, k) in enumerate(steps):
        at, same = (f"p.i // {16**k}", "l.tree IS NOT DISTINCT FROM p.tree AND ") if name == "g" else (f"p.g // {16**k}", "")
        ctes.append(f"""f{s + 1} AS MATERIALIZED (
  SELECT any_value(p.doc_id) AS doc_id, p.tree, p.i, any_value(p.g) AS g, any_value(p.leaf) AS leaf,
    CASE WHEN any_value(l.n) > 1 THEN sha256(string_agg(CASE WHEN l.i = {at} THEN p.value ELSE l.h END, '' ORDER BY l.i)) ELSE any_value(p.value) END AS value,
    any_value(p.proof) || coalesce(string_agg(l.h, '' ORDER BY l.i) FILTER (WHERE l.n > 1 AND l.i <> {at}), '') AS proof
  FROM {last} p JOIN {name}{k} l ON {same}CASE WHEN l.n > 1 THEN l.i // 16 = ({at}) // 16 ELSE l.i = 0 END
  GROUP BY p.tree, p.i)""")
        last = f"f{s + 1}"
    return f"""
WITH {CRC_TABLE},
d AS MATERIALIZED (
  SELECT doc_id, source AS tree, {_leaf("text")} AS leaf,
    CASE WHEN {crc32_of("doc_id::VARCHAR")} % 5 = 0
         THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS value
  FROM documents CROSS JOIN crc_table),
o AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, value) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
g0 AS (SELECT tree, i, n, leaf AS h FROM o),
{_levels("g", "tree", levels)},
r0 AS MATERIALIZED (
  SELECT 0 AS one, tree, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM g{levels}),
{_levels("r", "one", top)},
f0 AS (SELECT o.doc_id, o.tree, o.i, r0.i AS g, o.leaf, o.value, '' AS proof FROM o JOIN r0 ON o.tree IS NOT DISTINCT FROM r0.tree),
{", ".join(ctes)}
SELECT f.doc_id, f.leaf, r0.h AS subroot, r{top}.h AS root, sha256(f.proof) AS proof_sha256, f.value AS folded_root, f.value = r{top}.h AS verified
FROM {last} f JOIN r0 ON f.tree IS NOT DISTINCT FROM r0.tree CROSS JOIN r{top}
"""


MERKLE = _merkle()


def _vector_codes(rounds: int = 4) -> str:
    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
  SELECT vec_id, p.part, arg_min(entry, (p.q + b.q - 2 * list_inner_product(p.x, b.x), entry)) AS entry,
         min(p.q + b.q - 2 * list_inner_product(p.x, b.x)) AS error
  FROM p JOIN b{k} b ON p.part = b.part GROUP BY vec_id, p.part)"""

    def moved(k: int) -> str:
        return f"""m{k + 1} AS (
  SELECT p.part, entry, list(c ORDER BY pos) AS x FROM (
    SELECT part, entry, pos, floor(sum(c) / count(*)) AS c FROM (
      SELECT p.part, a.entry, unnest(range(len(p.x))) AS pos, unnest(p.x) AS c FROM p JOIN a{k} a ON p.vec_id = a.vec_id AND p.part = a.part)
    GROUP BY part, entry, pos) p GROUP BY p.part, entry),
b{k + 1} AS MATERIALIZED (
  SELECT part, entry, x, list_inner_product(x, x) AS q FROM (
    SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k + 1} m ON b.part = m.part AND b.entry = m.entry))"""

    steps = ",\n".join(f"{assigned(k)},\n{moved(k)}" for k in range(rounds))
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, part, x, list_inner_product(x, x) AS q FROM (
    SELECT vec_id, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS x FROM k CROSS JOIN (SELECT unnest(range(4)) AS part))),
b0 AS MATERIALIZED (
  SELECT p.part, f.entry, p.x, p.q FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 256) f USING (vec_id)),
{steps},
{assigned(rounds)},
c AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
s AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS sha FROM (
  SELECT part, entry, unnest(range(len(x))) AS pos, unnest(x) AS c FROM b{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256
FROM c JOIN k USING (vec_id) CROSS JOIN s
"""


VECTOR_CODES = _vector_codes()
