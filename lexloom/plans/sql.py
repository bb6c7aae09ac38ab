"""SQL that gives the same rows as the queries, put together from common parts."""

from __future__ import annotations

from ..functions.chars import BYTE_CHAR

SPACE = r"[\t-\r \x{85}\p{Zs}]"
WORDS = f"list_filter(string_split_regex(text, '{SPACE}+'), lambda x: x <> '')"


def counted(table: str = "documents", text: str = "text", keys: str = "") -> str:
    """CTE wc(keys, word, freq)."""
    split = WORDS.replace("(text,", f"({text},")
    return f"wc AS (SELECT {keys}word, count(*) AS freq FROM (SELECT {keys}unnest({split}) AS word FROM {table}) GROUP BY ALL)"


def _letters(prefix: str | None, end: str | None, byte: bool) -> str:
    if byte:
        table = "[" + ", ".join("'{}'".format(c.replace("'", "''")) for c in BYTE_CHAR) + "]"
        base = f"list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: ({table})[('0x' || h)::INT + 1])"
    else:
        base = "string_split(word, '')"
    if prefix:
        base = f"list_transform({base}, lambda c, i: CASE WHEN i = 1 THEN c ELSE '{prefix}' || c END)"
    return f"list_append({base}, '{end}')" if end else base


def symbols(prefix: str | None = None, end: str | None = None, byte: bool = False) -> str:
    """CTE s0(word, s, freq): symbols between marks, so that a merge is a replacement."""
    return f"s0 AS MATERIALIZED (SELECT word, '⟨' || array_to_string({_letters(prefix, end, byte)}, '⟩⟨') || '⟩' AS s, freq FROM wc)"


def pairs(of: str) -> str:
    return f"SELECT l, r, sum(freq)::BIGINT AS n FROM (SELECT unnest(a[:-2]) AS l, unnest(a[2:]) AS r, freq FROM (SELECT string_split(s[2:-2], '⟩⟨') AS a, freq FROM {of})) GROUP BY ALL"


def scored(of: str) -> str:
    return f"""SELECT p.l, p.r, p.n, p.n::DOUBLE / (a.c::DOUBLE * b.c::DOUBLE) AS score FROM ({pairs(of)}) p
  JOIN (SELECT t, sum(freq) AS c FROM (SELECT unnest(string_split(s[2:-2], '⟩⟨')) AS t, freq FROM {of}) GROUP BY ALL) a ON a.t = p.l
  JOIN (SELECT t, sum(freq) AS c FROM (SELECT unnest(string_split(s[2:-2], '⟩⟨')) AS t, freq FROM {of}) GROUP BY ALL) b ON b.t = p.r"""


def merges(count: int, least: int, prefix: str | None = None) -> str:
    """CTEs p1..pn (l, r, n, score) and s1..sn of so many merges."""
    out = []
    for k in range(1, count + 1):
        if prefix:
            best = f"SELECT * FROM ({scored(f's{k - 1}')}) WHERE n >= {least} ORDER BY score DESC, n DESC, l, r LIMIT 1"
            joined = f"p.l || CASE WHEN starts_with(p.r, '{prefix}') THEN p.r[{len(prefix) + 1}:] ELSE p.r END"
        else:
            best = f"SELECT l, r, n, n::DOUBLE AS score FROM ({pairs(f's{k - 1}')}) WHERE n >= {least} ORDER BY n DESC, l, r LIMIT 1"
            joined = "p.l || p.r"
        out.append(f"p{k} AS MATERIALIZED ({best})")
        out.append(f"s{k} AS MATERIALIZED (SELECT word, coalesce(replace(s, '⟨' || p.l || '⟩⟨' || p.r || '⟩', '⟨' || {joined} || '⟩'), s) AS s, freq FROM s{k - 1} LEFT JOIN p{k} p ON true)")
    return ",\n".join(out)


def frequency_vocabulary(rare: int, words: int, endings: int) -> str:
    """CTE v(piece), from wc."""
    return f"""
letters AS (SELECT c FROM (SELECT unnest(string_split(word, '')) AS c, freq FROM wc) GROUP BY c HAVING sum(freq) >= {rare}),
v AS MATERIALIZED (SELECT c AS piece FROM letters UNION SELECT '##' || c FROM letters
  UNION (SELECT word FROM wc WHERE length(word) BETWEEN 2 AND 8 ORDER BY freq DESC, word LIMIT {words})
  UNION (SELECT '##' || e FROM (SELECT right(word, 3) AS e, sum(freq) AS f FROM wc WHERE length(word) >= 5 GROUP BY ALL ORDER BY f DESC, e LIMIT {endings})))"""


def greedy(of: str = "wc", unit: int = 1, prefix: str = "##", longest: int = 8) -> str:
    """Recursive CTE g(word, p, k, out), with a row where p is past the end for each word that pieces cover."""
    head = f"CASE WHEN g.p > 1 THEN '{prefix}' ELSE '' END || " if prefix else ""
    return f"""
g AS (SELECT word, 1::BIGINT AS p, 0::BIGINT AS k, '' AS out FROM (SELECT DISTINCT word FROM {of})
  UNION ALL SELECT word, p + {unit} * max(n), k + 1, any_value(out) || ' ' || arg_max(piece, n)
  FROM (SELECT g.word, g.p, g.k, g.out, n, v.piece FROM g CROSS JOIN (SELECT unnest(range(1, {longest + 1})) AS n) t
    JOIN v ON v.piece = {head}substr(g.word, g.p, {unit} * n) WHERE g.p + {unit} * n - 1 <= length(g.word)) GROUP BY word, p, k)"""
