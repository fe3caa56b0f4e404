"""Comparison SQL of the Merkle manifest and of the spelling groups."""

from __future__ import annotations

# CRC-32 of a text, by the usual table of 256 remainders (4294967295: all bits set; 3988292384: the reversed polynomial)
CRC_TABLE = """crc_bits AS (SELECT i AS byte, 0 AS k, CAST(i AS BIGINT) AS v FROM range(256) r(i)
    UNION ALL SELECT byte, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_bits WHERE k < 8),
  crc_table AS (SELECT list(v ORDER BY byte) AS t FROM crc_bits WHERE k = 8)"""


def crc(text: str) -> str:
    """CRC-32 of a text expression, in a query that joins ``crc_table``."""
    code = f"hex(encode({text}))"
    data = f"list_transform(range(CAST(length({code}) AS BIGINT) // 2), lambda j: CAST('0x' || substr({code}, 2 * j + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {data}), lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295)"


def _levels(name: str, levels: int) -> str:
    """From ``<name>0`` (key, pos, n, d): tables of each level, the steps from it, and ``<name>_top`` (key, d)."""
    out = []
    for k in range(levels):
        out += [
            f"{name}_runs{k} AS (SELECT key, pos // 16 AS run, any_value(n) AS n, list(d ORDER BY pos) AS ds FROM {name}{k} WHERE n > 1 GROUP BY 1, 2)",
            f"{name}{k + 1} AS (SELECT key, run AS pos, (n + 15) // 16 AS n, sha256(array_to_string(ds, '')) AS d FROM {name}_runs{k})",
            f"{name}_step{k} AS (SELECT c.key, c.pos, array_to_string(r.ds[1:c.pos % 16], '') AS l, array_to_string(r.ds[c.pos % 16 + 2:], '') AS r "
            f"FROM {name}{k} c JOIN {name}_runs{k} r ON c.key = r.key AND c.pos // 16 = r.run)",
        ]
    tops = " UNION ALL ".join(f"SELECT key, d FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
    return ", ".join([*out, f"{name}_top AS ({tops})"])


def _walk(name: str, levels: int) -> str:
    """Joins of the steps from ``place`` (key ``<name>_key``, position ``<name>_pos``) upwards."""
    return " ".join(f"LEFT JOIN {name}_step{k} {name}s{k} ON {name}s{k}.key = {name}_key AND {name}s{k}.pos = {name}_pos // {16**k}" for k in range(levels))


def merkle_sql(levels: int = 5, trunk: int = 3) -> str:
    """The manifest, for sources of up to 16 ** levels documents and up to 16 ** trunk sources."""

    def field(c: str) -> str:
        return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join([*[field(c) for c in ("doc_id", "source", "lang", "n_chars")], field(text)]) + ")"

    steps = [f"{name}s{k}" for name, n in (("a", levels), ("b", trunk)) for k in range(n)]
    folds, at = [], "start"
    for k, s in enumerate(steps):
        folds.append(f"f{k} AS (SELECT *, CASE WHEN {s}_l IS NULL THEN {at} ELSE sha256({s}_l || {at} || {s}_r) END AS f{k}_d FROM {f'f{k - 1}' if k else 'walked'})")
        at = f"f{k}_d"
    picked = ", ".join(f"{s}.l AS {s}_l, {s}.r AS {s}_r" for s in steps)
    siblings = " || ".join(f"coalesce({s}_l || {s}_r, '')" for s in steps)
    return f"""WITH RECURSIVE {CRC_TABLE},
  forged AS (SELECT d.*, CASE WHEN {crc('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM documents d, crc_table),
  leaves AS (SELECT doc_id, coalesce('=' || source, '') AS key, {leaf('text')} AS d, {leaf('changed')} AS start FROM forged),
  a0 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, d) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM leaves),
  {_levels('a', levels)},
  b0 AS (SELECT '' AS key, key AS name, d, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM a_top),
  {_levels('b', trunk)},
  placed AS (SELECT a0.doc_id, a0.d, a0.start, a0.key AS a_key, a0.pos AS a_pos, '' AS b_key, b0.pos AS b_pos, b0.d AS subroot FROM a0 JOIN b0 ON a0.key = b0.name),
  walked AS (SELECT placed.*, {picked} FROM placed {_walk('a', levels)} {_walk('b', trunk)}),
  {', '.join(folds)}
  SELECT doc_id, f.d AS leaf, subroot, b_top.d AS root, sha256({siblings}) AS proof_sha256, {at} AS folded_root, {at} = b_top.d AS verified FROM f{len(steps) - 1} f, b_top"""


SPELLING_SQL = f"""WITH RECURSIVE {CRC_TABLE},
  runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents)),
  seen AS (SELECT doc_id, w, count(*) AS c FROM runs GROUP BY 1, 2),
  hashed AS (SELECT w, c, {crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM seen, crc_table),
  cut AS (SELECT c, CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word FROM hashed),
  words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2),
  less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
  pairs AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
  near AS (SELECT word, count(*) AS n_near, max(n) AS best_n FROM pairs GROUP BY 1),
  best AS (SELECT p.word, min(other) AS best FROM pairs p JOIN near USING (word) WHERE p.n = best_n GROUP BY 1),
  formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
    FROM words LEFT JOIN near USING (word) LEFT JOIN best USING (word)),
  followed AS (SELECT word, coalesce(form, word) AS root, 0 AS k FROM formed UNION ALL SELECT f.word, g.form, k + 1 FROM followed f JOIN formed g ON f.root = g.word WHERE g.form IS NOT NULL),
  ends AS (SELECT word, max_by(root, k) AS root FROM followed GROUP BY 1)
  SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""
