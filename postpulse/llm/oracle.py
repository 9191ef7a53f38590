"""Results of the operators in SQL (DuckDB dialect), where SQL can state them."""

from __future__ import annotations

from postpulse.llm.merkle import FAN, HEX, UPPER
from postpulse.llm.spelling import LOSSES, MIN_COUNT, MIN_LENGTH, RATIO

LOWERED = f"'{UPPER}', '{UPPER.lower()}'"

# The table of the checksum by its rule: eight shifts of every byte.
CRC = """crc AS (SELECT list_transform(range(256), lambda b: list_reduce(
 list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384)
 ELSE c >> 1 END)) AS crc_table)"""


def crc32(text: str) -> str:
    """The checksum of a text that is not empty; the table must be joined."""
    code = f"hex(encode({text}))"
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
 range(1, length({code}), 2), lambda i: CAST('0x' || substr({code}, i, 2) AS BIGINT))),
 lambda c, b: xor(c >> 8, crc_table[1 + (xor(c, b) & 255)])))"""


def _tree(name: str, group: str, tallest: int) -> str:
    """Levels of all trees over ``{name}0`` (``group``, ``number``, ``node``); a tree that
    is done has no rows in the next level."""
    levels = [f"""{name}{k + 1} AS (SELECT {group}, number // {FAN} AS number,
 sha256(string_agg(node, '' ORDER BY number)) AS node FROM {name}{k}
 WHERE {group} IN (SELECT {group} FROM {name}{k} GROUP BY {group} HAVING count(*) > 1)
 GROUP BY {group}, number // {FAN})""" for k in range(tallest)]
    runs = [f"""{name}_runs{k} AS (SELECT {group}, number // {FAN} AS run,
 string_agg(node, '' ORDER BY number) AS nodes FROM {name}{k}
 GROUP BY {group}, number // {FAN} )""" for k in range(tallest)]
    return ",\n".join([*levels, *runs])


def _climb(name: str, group: str, tallest: int, start: str, of: str, number: str) -> list[str]:
    """Steps from ``start``, a table with ``proof`` and ``node``, up a tree."""
    steps, at = [], start
    for k in range(tallest):
        own = f"(p.{number} // {FAN ** k} % {FAN})"
        before = f"left(r.nodes, CAST({own} * {HEX} AS BIGINT))"
        after = f"substr(r.nodes, CAST(({own} + 1) * {HEX} + 1 AS BIGINT))"
        steps.append(f"""{name}_up{k} AS (SELECT p.* REPLACE (
 CASE WHEN t.{group} IS NULL THEN proof ELSE proof || {before} || {after} END AS proof,
 CASE WHEN t.{group} IS NULL THEN p.node ELSE sha256({before} || p.node || {after}) END AS node)
 FROM {at} p LEFT JOIN {name}_runs{k} r ON r.{group} = p.{of}
 AND r.run = p.{number} // {FAN ** (k + 1)}
 LEFT JOIN (SELECT DISTINCT {group} FROM {name}{k + 1}) t ON t.{group} = p.{of})""")
        at = f"{name}_up{k}"
    return steps


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')"


def _merkle(tallest: int = 9, tallest_top: int = 3) -> str:
    first = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
    lowered = f"CASE WHEN crc % 3 = 0 THEN translate(text, {LOWERED}) ELSE text END"
    return f"""WITH {CRC},
summed AS (SELECT d.*, {crc32('CAST(doc_id AS VARCHAR)')} AS crc FROM documents d, crc),
leaves AS (SELECT doc_id, lang, sha256({first} || {_field('text')}) AS leaf,
 sha256({first} || {_field(f'({lowered})')}) AS tampered FROM summed),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS of
 FROM (SELECT DISTINCT lang FROM leaves)),
placed AS (SELECT l.*, of, row_number() OVER (PARTITION BY of ORDER BY doc_id NULLS FIRST, leaf)
 - 1 AS number FROM leaves l JOIN langs ON langs.lang IS NOT DISTINCT FROM l.lang),
low0 AS (SELECT of, number, leaf AS node FROM placed),
{_tree('low', 'of', tallest)},
subroots AS (SELECT of, node FROM ({' UNION ALL '.join(
    f'SELECT {k} AS k, * FROM low{k}' for k in range(tallest + 1))})
 QUALIFY k = max(k) OVER (PARTITION BY of)),
top0 AS (SELECT true AS whole, of AS number, node FROM subroots),
{_tree('top', 'whole', tallest_top)},
root AS (SELECT node AS root FROM ({' UNION ALL '.join(
    f'SELECT {k} AS k, * FROM top{k}' for k in range(tallest_top + 1))})
 QUALIFY k = max(k) OVER ()),
started AS (SELECT doc_id, leaf, of, number, true AS whole, tampered AS node, '' AS proof
 FROM placed),
{', '.join(_climb('low', 'of', tallest, 'started', 'of', 'number'))},
{', '.join(_climb('top', 'whole', tallest_top, f'low_up{tallest - 1}', 'whole', 'of'))}
SELECT doc_id, leaf, s.node AS subroot, root, sha256(proof) AS proof_sha256,
 p.node AS folded_root, p.node = root AS verified
FROM top_up{tallest_top - 1} p JOIN subroots s USING (of), root"""


_SPELLING = f"""WITH RECURSIVE {CRC},
runs AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(
 translate(text, {LOWERED}), '[A-Za-z{chr(0xC0)}-{chr(0xFF)}]+'))
 AS run FROM documents) GROUP BY ALL),
summed AS (SELECT run, times,
 {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs, crc),
lost AS (SELECT times, CASE WHEN h % {LOSSES} = 0 THEN left(run, h % length(run)) ||
 substr(run, h % length(run) + 2) ELSE run END AS word FROM summed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM lost
 WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(times) >= {MIN_COUNT}),
shorter AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
 FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
longer AS (SELECT DISTINCT s.word AS a, s.n AS a_n, w.word AS b, w.n AS b_n
 FROM shorter s JOIN words w ON s.rest = w.word),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n
 FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION ALL SELECT a, b, b_n FROM longer UNION ALL SELECT b, a, a_n FROM longer),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other,
 max(other_n) AS other_n FROM near GROUP BY word),
found AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near,
 CASE WHEN other_n >= {RATIO} * n THEN other END AS form,
 CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n
 FROM words w LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root FROM found
 UNION ALL SELECT s.word, f.form FROM steps s JOIN found f ON f.word = s.root
 WHERE f.form IS NOT NULL),
ends AS (SELECT s.word, s.root FROM steps s JOIN found f ON f.word = s.root
 WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM found JOIN ends USING (word)"""

ORACLE = {
    "op12_merkle_manifest": _merkle(),
    "op13_spelling_variants": _SPELLING,
}
