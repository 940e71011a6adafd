"""SQL for tokenizer training and encoding: merges unrolled as common table expressions."""

from __future__ import annotations

# Fixed value: the pre-tokenizer's alternatives that SQL needs on cleaned text, where blanks at the end of a run cannot occur.
PRETOKEN_SQL = r"[ ]?\p{L}[\p{L}\p{M}]*|[ ]?\p{Nd}+|[ ]?[^\s\p{L}\p{M}\p{Nd}]+|\s+"
SPACES_SQL = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
CONTROL_SQL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"

CLEAN = f"trim(regexp_replace(regexp_replace(text, '{CONTROL_SQL}', '', 'g'), '{SPACES_SQL}', ' ', 'g'))"
DOCS = f"docs AS (SELECT doc_id, lang, source, {CLEAN} AS clean FROM documents WHERE length(text) >= 100)"
TOKENS = f"pre AS (SELECT doc_id, lang, regexp_extract_all(clean, '{PRETOKEN_SQL}') AS words FROM docs)"
WORDS = "words AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM pre) GROUP BY word)"
#: A word's bytes as ,1,,2,,3, from its hex digits.
IDS = "list_aggregate(list_transform(range(0, octet_length(encode(word))), lambda i: ',' || ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::INTEGER || ','), 'string_agg', '')"


def rounds(n: int, source: str = "words") -> str:
    """CTEs w0 to wn of words with their ids after each merge, and m1 to mn with the merges."""
    out = [f"w0 AS MATERIALIZED (SELECT word, n, {IDS} AS ids FROM {source} WHERE octet_length(encode(word)) > 0)"]
    for k in range(1, n + 1):
        split = f"SELECT n, string_split(trim(ids, ','), ',,') AS t FROM w{k - 1}"
        pairs = f"SELECT n, t[i]::INTEGER AS l, t[i + 1]::INTEGER AS r FROM (SELECT n, t, unnest(range(1, len(t))) AS i FROM ({split}))"
        out.append(f"m{k} AS MATERIALIZED (SELECT l, r, sum(n)::BIGINT AS n FROM ({pairs}) GROUP BY l, r ORDER BY n DESC, l, r LIMIT 1)")
        out.append(f"w{k} AS MATERIALIZED (SELECT word, w.n, replace(ids, ',' || m.l || ',,' || m.r || ',', ',{255 + k},') AS ids FROM w{k - 1} w, m{k} m)")
    return ",\n".join(out)
