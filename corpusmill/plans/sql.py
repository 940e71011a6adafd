"""DuckDB SQL that must give the rows of the registered queries."""

from __future__ import annotations

from corpusmill.plans.bpe_sql import CLEAN, DOCS, IDS, TOKENS, WORDS, rounds
from corpusmill.plans.queries import ATTENTION_PADS, ATTENTION_SEGMENT, ATTENTION_WINDOW, BATCH, CTX_LEN, DECOMPOSED, GENERATION_CTX, MAX_NEW, MERGE_ROUNDS, N_CHECKED, N_EVALUATED, NAMES, N_SOURCES, N_VALIDATION_CHATS, N_VALIDATION_DOCS, PAD_ID, ROPE_DIM, ROPE_LEN, SCAN_ROWS, SFT_CTX, STOP_TOKEN, TEMPERATURE, TOP_K, WINDOW_BATCH

_BASE = f"WITH {DOCS}, {TOKENS}, {WORDS}"
_PAIRS = f"SELECT word, n, t[i]::INTEGER AS l, t[i + 1]::INTEGER AS r FROM (SELECT word, n, t, unnest(range(1, len(t))) AS i FROM (SELECT word, n, string_split(trim({IDS}, ','), ',,') AS t FROM words))"

# Lengths, shuffled index, bounds and starts of windows.
_LENGTHS = f"{DOCS}, lens AS (SELECT source, doc_id, octet_length(encode(clean)) + 1 AS length FROM docs)"
_LOCAL = "locals AS (SELECT source, doc_id, coalesce(sum(length) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\", length::BIGINT AS length FROM lens)"
_KEY = "md5('42:' || doc_id::VARCHAR)"
_INDEX = f"""idx AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {_KEY}, doc_id) - 1 AS pos, doc_id, source, length, "offset" AS local_offset,
  coalesce(sum(length) OVER (ORDER BY {_KEY}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS global_offset FROM locals)"""
_SPLIT = f"parts AS (SELECT *, CASE WHEN pos >= (SELECT count(*) FROM idx) - {N_VALIDATION_DOCS} THEN 'VAL' ELSE 'TRAIN' END AS split FROM idx)"
_ENDS = "ends AS (SELECT coalesce(max(CASE WHEN split = 'TRAIN' THEN global_offset + length END), 0) AS train_end, coalesce(max(global_offset + length), 0) AS total FROM parts)"
_BOUNDS = f"""bounds AS (SELECT 'TRAIN' AS split, 0::BIGINT AS start_idx, greatest(0, train_end - {CTX_LEN} - 1)::BIGINT AS end_idx FROM ends
  UNION ALL SELECT 'VAL', train_end::BIGINT, greatest(train_end, total - {CTX_LEN} - 1)::BIGINT FROM ends)"""
_STARTS = f"""numbered AS (SELECT split, start_idx, end_idx, unnest(range(0, (end_idx - start_idx) // {CTX_LEN} + 1)) AS window_id FROM bounds WHERE end_idx > start_idx),
starts AS MATERIALIZED (SELECT window_id, split, start_idx + ('0x' || substr(md5('42::' || split || ':' || window_id::VARCHAR), 1, 15))::BIGINT % (end_idx - start_idx) AS start FROM numbered)"""
_WINDOWS = f"WITH {_LENGTHS}, {_LOCAL}, {_INDEX}, {_SPLIT}, {_ENDS}, {_BOUNDS}, {_STARTS}"
_SPANS = f"""spans AS (SELECT window_id, split, doc_id, global_offset, greatest(start, global_offset) - global_offset AS take_from,
  least(start + {CTX_LEN + 1}, global_offset + length) - greatest(start, global_offset) AS take
  FROM starts JOIN idx ON global_offset < start + {CTX_LEN + 1} AND global_offset + length > start)"""
_PACKED = f"""{_WINDOWS}, {_SPANS}, hexed AS (SELECT doc_id, hex(encode(clean)) || 'FF' AS h FROM docs),
cut AS (SELECT window_id, split, string_agg(substr(h, (2 * take_from + 1)::BIGINT, (2 * take)::BIGINT), '' ORDER BY global_offset) AS h FROM spans JOIN hexed USING (doc_id) GROUP BY window_id, split),
toks AS (SELECT window_id, split, list_transform(range(0, {CTX_LEN + 1}), lambda i: CASE WHEN substr(h, 2 * i + 1, 2) = 'FF' THEN 256 ELSE ('0x' || substr(h, 2 * i + 1, 2))::INTEGER END) AS t FROM cut),
shifted AS (SELECT window_id, split, t[1:{CTX_LEN}] AS a, t[2:{CTX_LEN + 1}] AS b FROM toks)"""

# Chats. Tags become private code points, then bytes no text has.
_TURNS = "turns AS (SELECT conv_id, turn, role, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant', false) AS eos_before, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations)"
_PIECE = "CASE WHEN eos_before THEN '<eos>' ELSE '' END || '<' || role || '>' || text"
_CHATS = f"{_TURNS}, chats AS (SELECT conv_id, string_agg({_PIECE}, '' ORDER BY turn) AS chat FROM turns GROUP BY conv_id)"
_EXCHANGES = f"{_TURNS}, exchanges AS (SELECT conv_id, turn, text AS question, next_text AS answer FROM turns WHERE role = 'user' AND next_role = 'assistant')"
_CHAT_HEX = f"""{_CHATS}, clean_chats AS (SELECT conv_id, {CLEAN.replace('text', 'chat')} AS chat FROM chats),
hexed AS (SELECT conv_id, replace(replace(replace(hex(encode(replace(replace(replace(chat, '<eos>', chr(57344)), '<user>', chr(57345)), '<assistant>', chr(57346)))), 'EE8080', 'F8'), 'EE8081', 'F9'), 'EE8082', 'FA') || 'F8' AS h FROM clean_chats),
toks AS MATERIALIZED (SELECT conv_id, list_transform(range(0, length(h) // 2), lambda i: CASE substr(h, 2 * i + 1, 2) WHEN 'F8' THEN 256 WHEN 'F9' THEN 257 WHEN 'FA' THEN 258 ELSE ('0x' || substr(h, 2 * i + 1, 2))::INTEGER END) AS t FROM hexed)"""
_CHAT_KEY = "md5('42:' || conv_id::VARCHAR)"
_SFT = f"""{_CHAT_HEX}, fit AS (SELECT conv_id, t, row_number() OVER (ORDER BY {_CHAT_KEY}, conv_id) - 1 AS pos FROM toks WHERE len(t) <= {SFT_CTX + 1}),
picked AS (SELECT *, CASE WHEN pos >= (SELECT count(*) FROM fit) - {N_VALIDATION_CHATS} THEN 'VAL' ELSE 'TRAIN' END AS split FROM fit)"""
_STATES = """each AS (SELECT conv_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS x FROM picked),
state AS (SELECT conv_id, i, x, lag(x) OVER w AS before, sum(CASE x WHEN 257 THEN -1 WHEN 258 THEN 1 ELSE 0 END) OVER w AS s,
  coalesce(max(CASE WHEN x = 257 THEN i END) OVER w, 0) AS u, coalesce(max(CASE WHEN x = 258 THEN i END) OVER w, 0) AS a FROM each WINDOW w AS (PARTITION BY conv_id ORDER BY i))"""
_MASKED = f"""{_SFT}, {_STATES}, masked AS (SELECT conv_id, list(CASE WHEN s = -1 OR x = 258 OR before = 256 THEN -100 ELSE x END ORDER BY i) AS o FROM state WHERE i > 1 GROUP BY conv_id),
samples AS (SELECT conv_id, pos, t[1:len(t) - 1] AS a, o FROM picked JOIN masked USING (conv_id))"""
_TEXT = "list_aggregate({}, 'string_agg', ' ')"

# Tokenizer.
_MERGED = f"{_BASE}, {rounds(MERGE_ROUNDS)}"
_LAST = f"w{MERGE_ROUNDS}"
_ALL_MERGES = " UNION ALL ".join(f"SELECT {k}::INTEGER AS rank, l AS \"left\", r AS \"right\", {255 + k}::INTEGER AS new_id, n FROM m{k}" for k in range(1, MERGE_ROUNDS + 1))
_DOC_IDS = f"""{_MERGED}, placed AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM pre),
encoded AS MATERIALIZED (SELECT doc_id, string_agg(w.ids, '' ORDER BY i) AS ids FROM placed JOIN {_LAST} w USING (word) GROUP BY doc_id)"""
_N_IDS = "(length(ids) - length(replace(ids, ',', ''))) // 2"

_VOCAB_STEPS = "v0 AS (SELECT range AS id, printf('%02X', range) AS b FROM range(0, 256))" + "".join(f", v{k} AS MATERIALIZED (SELECT * FROM v{k - 1} UNION ALL SELECT {255 + k}, (SELECT b FROM v{k - 1}, m{k} WHERE id = l) || (SELECT b FROM v{k - 1}, m{k} WHERE id = r))" for k in range(1, MERGE_ROUNDS + 1))
_SPECIALS = ", ".join(f"({256 + MERGE_ROUNDS + i}, '{t}')" for i, t in enumerate(("<eos>", "<bos>", "<pad>", "<unk>", "<mask>", "<user>", "<assistant>")))

# Kernels.
_LOGITS = "logits AS (SELECT vec_id, unnest(range(0, len(embedding))) AS token, unnest(embedding)::DOUBLE AS logit FROM embeddings)"
_TOP = f"""{_LOGITS}, ranked AS (SELECT vec_id, token, logit / {TEMPERATURE} AS x, rank() OVER (PARTITION BY vec_id ORDER BY logit / {TEMPERATURE} DESC) AS r FROM logits),
raised AS (SELECT vec_id, token, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM ranked WHERE r <= {TOP_K}),
top AS (SELECT vec_id, token, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM raised)"""
_SEQS = f"seqs AS (SELECT vec_id // {ATTENTION_WINDOW} AS seq, vec_id // {ATTENTION_SEGMENT} AS segment, vec_id % {ATTENTION_WINDOW} AS p, embedding::DOUBLE[] AS v FROM embeddings)"
_ALLOWED = "allowed AS (SELECT a.seq, a.p AS i, b.p AS j, a.v AS q, b.v AS k FROM seqs a JOIN seqs b ON a.seq = b.seq AND a.segment = b.segment AND b.p <= a.p)"

_DECOMPOSED = "clean"
for _letter, _parts in DECOMPOSED.items():
    _DECOMPOSED = f"replace({_DECOMPOSED}, '{_letter}', '{_parts}')"

# Marks by length, then text: NAME_<turn>, NAME_<10 turn + 1>; two marks share a name only with a number behind it.
_NAMES = f"""marked AS (SELECT conv_id, turn, role, 'NAME_' || turn || ' to NAME_' || (turn * 10 + 1) || ': ' || text AS text FROM conversations),
rendered AS ({{}}),
marks AS (SELECT conv_id, mark, row_number() OVER (PARTITION BY conv_id ORDER BY length(mark), mark) - 1 AS k FROM (SELECT DISTINCT conv_id, unnest(regexp_extract_all(chat, 'NAME_[0-9]+')) AS mark FROM rendered)),
named AS (SELECT conv_id, mark, [{', '.join(f"'{n}'" for n in NAMES)}][((('0x' || substr(md5('42:' || conv_id), 1, 8))::BIGINT + k) % {len(NAMES)} + 1)::INTEGER] || CASE WHEN k >= {len(NAMES)} THEN ' ' || (k // {len(NAMES)} + 1) ELSE '' END AS name FROM marks),
pieces AS (SELECT conv_id, unnest(range(1, len(g) + 1)) AS i, unnest(g) AS gap, unnest(list_concat(m, [''])) AS mark FROM (SELECT conv_id, regexp_split_to_array(chat, 'NAME_[0-9]+') AS g, regexp_extract_all(chat, 'NAME_[0-9]+') AS m FROM rendered))
SELECT conv_id, string_agg(gap || coalesce(name, ''), '' ORDER BY i) AS chat FROM pieces LEFT JOIN named USING (conv_id, mark) GROUP BY conv_id"""

# One token after another: the logits are the vector from the last token's place on, the running sums reach the draw or the last place counts.
_GENERATED = f"""WITH RECURSIVE grown AS (
  SELECT vec_id, 0 AS step, list_transform(range(0, vec_id % 5 + 1), lambda i: (vec_id + 7 * i) % {ROPE_DIM}) AS t, least({MAX_NEW}, {GENERATION_CTX} - (vec_id % 5 + 1)) AS room FROM embeddings
  UNION ALL
  SELECT vec_id, step + 1, list_append(t, token), room FROM (
    SELECT vec_id, step, t, room, coalesce(list_filter(range(0, {ROPE_DIM}), lambda i: list_sum(w[1:i + 1]) > list_sum(w) * draw)[1], list_filter(range(0, {ROPE_DIM}), lambda i: w[i + 1] > 0)[-1]) AS token FROM (
      SELECT vec_id, step, t, room, draw, list_transform(x, lambda v: CASE WHEN v >= list_reverse_sort(x)[{TOP_K}] THEN exp(v - list_max(x)) ELSE 0::DOUBLE END) AS w FROM (
        SELECT vec_id, step, t, room, ('0x' || substr(md5(step::VARCHAR || ':' || vec_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw,
          list_transform(list_concat(embedding[t[-1] + 1:], embedding[:t[-1]]), lambda v: v::DOUBLE / {TEMPERATURE}) AS x FROM grown JOIN embeddings USING (vec_id) WHERE step < room)))
  WHERE token <> {STOP_TOKEN})
SELECT vec_id, len(arg_max(t, step))::INTEGER AS n_tokens, list_aggregate(arg_max(t, step), 'string_agg', ' ') AS tokens FROM grown GROUP BY vec_id"""

ORACLE_SQL: dict[str, str] = {
    "window_batches": f"""{_PACKED} SELECT split, window_id // {WINDOW_BATCH} AS batch_id, min(window_id) AS first_window, count(*)::INTEGER AS n_windows,
string_agg({_TEXT.format('a')}, '|' ORDER BY window_id) AS input_tokens, string_agg({_TEXT.format('b')}, '|' ORDER BY window_id) AS output_tokens FROM shifted GROUP BY split, window_id // {WINDOW_BATCH} HAVING count(*) = {WINDOW_BATCH}""",
    "scan_batches": f"SELECT count(*) AS n_rows, (count(*) + {SCAN_ROWS - 1}) // {SCAN_ROWS} AS n_batches FROM documents",
    "source_files": "SELECT doc_id, (dense_rank() OVER (ORDER BY source) - 1)::INTEGER AS file_id, string_split(list_last(string_split(source, '/')), '.')[1] AS name FROM documents WHERE source IS NOT NULL",
    "store_metadata": f"WITH {_LENGTHS}, {_LOCAL} SELECT source, sum(length)::BIGINT AS total_tokens, string_agg(\"offset\" || ':' || length, ',' ORDER BY \"offset\", doc_id) AS documents FROM locals GROUP BY source",
    "flat_bytes": f"WITH {DOCS} SELECT doc_id, (2 * (octet_length(encode(clean)) + 1))::INTEGER AS n_bytes, md5(regexp_replace(hex(encode(clean)), '(..)', '\\100', 'g') || '0001') AS hex_md5 FROM docs",
    "evaluation_sample": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS \"index\", doc_id, {CLEAN} AS clean FROM (SELECT * FROM documents WHERE length(text) >= 100 ORDER BY doc_id LIMIT {N_EVALUATED})",
    "attention_pad_mask": f"WITH {_SEQS}, {_ALLOWED} SELECT seq, i, j FROM allowed WHERE j < {ATTENTION_WINDOW - ATTENTION_PADS}",
    "generated_tokens": _GENERATED,
    "score_filter": """WITH s AS (SELECT doc_id, lang, text, CASE WHEN n_chars % 7 <> 0 THEN n_chars % 100 / 100::DOUBLE END AS language_score FROM documents)
SELECT doc_id, lang, language_score FROM s WHERE length(text) >= 100 AND (lang <> 'en' OR language_score > 0.85)""",
    "names_replaced": "WITH " + _NAMES.format(f"WITH {_CHATS.replace('FROM conversations', 'FROM marked')} SELECT conv_id, chat FROM chats"),
    "bpe_merges_heap": f"{_MERGED} {_ALL_MERGES}",
    "bpe_merges_decomposed": f"WITH {DOCS.replace('docs AS', 'plain AS')}, docs AS (SELECT doc_id, lang, source, nfc_normalize({_DECOMPOSED}) AS clean FROM plain), {TOKENS}, {WORDS}, {rounds(MERGE_ROUNDS)} {_ALL_MERGES}",
    "clean_documents": f"SELECT doc_id, {CLEAN} AS clean_text FROM documents WHERE length(text) >= 100",
    "filter_by_language": "SELECT lang, count(*) AS n_docs, count(*) FILTER (WHERE length(text) >= 100) AS n_kept FROM documents GROUP BY lang",
    "sampled_sources_union": f"WITH {DOCS}, chosen AS (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5('42:' || source), source LIMIT {N_SOURCES}) SELECT doc_id, source, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS part, length(clean)::INTEGER AS n_clean FROM docs SEMI JOIN chosen USING (source)",
    "pretokens_per_doc": f"WITH {DOCS}, {TOKENS} SELECT doc_id, len(words)::INTEGER AS n_pretokens, coalesce(length(list_aggregate(words, 'string_agg', '')), 0)::INTEGER AS n_kept_chars FROM pre",
    "word_counts": f"{_BASE} SELECT word, n FROM words",
    "top_words": f"{_BASE} SELECT word, n FROM words ORDER BY n DESC, word LIMIT 100",
    "byte_pair_counts": f"{_BASE} SELECT l AS \"left\", r AS \"right\", sum(n)::BIGINT AS n FROM ({_PAIRS}) GROUP BY l, r",
    "best_pair": f"{_BASE} SELECT l AS \"left\", r AS \"right\", sum(n)::BIGINT AS n FROM ({_PAIRS}) GROUP BY l, r ORDER BY n DESC, l, r LIMIT 1",
    "pair_word_index": f"{_BASE} SELECT l AS \"left\", r AS \"right\", count(DISTINCT word) AS n_words, min(word) AS first_word FROM ({_PAIRS}) GROUP BY l, r",
    "words_per_doc": f"WITH {DOCS} SELECT doc_id, CASE WHEN clean = '' THEN 0 ELSE len(string_split(clean, ' ')) END::INTEGER AS n_words FROM docs",
    "chat_render": f"WITH {_CHATS} SELECT conv_id, chat FROM chats",
    "chat_turn_pieces": f"WITH {_TURNS} SELECT conv_id, turn, role, eos_before, {_PIECE} AS piece FROM turns",
    "chat_last_answer": f"WITH {_CHATS} SELECT conv_id, list_last(string_split(chat, '<assistant>')) AS answer FROM chats",
    "chat_prompts": "SELECT conv_id, turn, '<user>' || text || '<assistant>' AS prompt FROM conversations WHERE role = 'user'",
    "instruction_render": f"WITH {_EXCHANGES}, contexts AS (SELECT conv_id, min_by(text, turn) AS context FROM conversations WHERE role = 'system' GROUP BY conv_id) SELECT conv_id, turn, '<user>' || question || CASE WHEN coalesce(context, '') <> '' THEN ' Context: ' || context ELSE '' END || '<assistant>' || answer AS rendered FROM exchanges LEFT JOIN contexts USING (conv_id)",
    "pair_render": f"WITH {_EXCHANGES} SELECT conv_id, turn, '<user>' || question || '<assistant>' || answer AS rendered FROM exchanges",
    "translation_render": f"WITH {_EXCHANGES} SELECT conv_id, turn, 0 AS direction, '<user>Translate from english to hindi: ' || question || '<assistant>' || answer AS rendered FROM exchanges UNION ALL SELECT conv_id, turn, 1, '<user>Translate from hindi to english: ' || answer || '<assistant>' || question FROM exchanges",
    "doc_offsets_by_source": f"WITH {_LENGTHS}, {_LOCAL} SELECT source, doc_id, \"offset\", length FROM locals",
    "source_totals": f"WITH {_LENGTHS} SELECT source, count(*) AS n_docs, sum(length)::BIGINT AS total_tokens FROM lens GROUP BY source",
    "global_shuffle_index": f"WITH {_LENGTHS}, {_LOCAL}, {_INDEX} SELECT pos, doc_id, source, length, local_offset, global_offset FROM idx",
    "train_val_split": f"WITH {_LENGTHS}, {_LOCAL}, {_INDEX}, {_SPLIT} SELECT doc_id, pos, split FROM parts",
    "split_bounds": f"WITH {_LENGTHS}, {_LOCAL}, {_INDEX}, {_SPLIT}, {_ENDS}, {_BOUNDS} SELECT split, start_idx, end_idx FROM bounds",
    "window_starts": f"{_WINDOWS} SELECT window_id, split, start FROM starts",
    "window_asof_doc": f"{_WINDOWS} SELECT window_id, split, start, doc_id, start - global_offset AS doc_start FROM starts ASOF JOIN idx ON start >= global_offset",
    "window_doc_overlap": f"{_WINDOWS}, {_SPANS} SELECT window_id, split, doc_id, take_from, take FROM spans",
    "packed_windows": f"{_PACKED} SELECT window_id, split, {_TEXT.format('a')} AS input_tokens, {_TEXT.format('b')} AS output_tokens FROM shifted",
    "segment_position_ids": f"""{_PACKED}, each AS (SELECT window_id, split, unnest(range(0, {CTX_LEN})) AS i, unnest(a) AS x FROM shifted),
seg AS (SELECT window_id, split, i, 1 + coalesce(sum((x = 256)::INTEGER) OVER (PARTITION BY window_id, split ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM each),
pos AS (SELECT *, row_number() OVER (PARTITION BY window_id, split, s ORDER BY i) - 1 AS p FROM seg)
SELECT window_id, split, string_agg(s::VARCHAR, ' ' ORDER BY i) AS segment_ids, string_agg(p::VARCHAR, ' ' ORDER BY i) AS position_ids FROM pos GROUP BY window_id, split""",
    "chat_byte_tokens": f"WITH {_CHAT_HEX} SELECT conv_id, len(t)::INTEGER AS n_tokens, {_TEXT.format('t')} AS tokens FROM toks",
    "sft_offsets": f"WITH {_CHAT_HEX} SELECT row_number() OVER (ORDER BY conv_id) - 1 AS id, conv_id, coalesce(sum(len(t)) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\", len(t)::BIGINT AS length FROM toks",
    "sft_split": f"WITH {_SFT} SELECT conv_id, pos, split, len(t)::INTEGER AS n_tokens FROM picked",
    "sft_loss_mask": f"WITH {_MASKED} SELECT conv_id, {_TEXT.format('a')} AS input_tokens, {_TEXT.format('o')} AS output_tokens FROM samples",
    "sft_assistant_mask": f"WITH {_SFT}, {_STATES} SELECT conv_id, string_agg(CASE WHEN a <= u OR x = 258 OR before = 256 THEN '-100' ELSE x::VARCHAR END, ' ' ORDER BY i) AS output_tokens FROM state WHERE i > 1 GROUP BY conv_id",
    "padded_batches": f"""WITH {_MASKED}, batched AS (SELECT *, pos // {BATCH} AS batch_id, max(len(a)) OVER (PARTITION BY pos // {BATCH}) AS longest, count(*) OVER (PARTITION BY pos // {BATCH}) AS n FROM samples)
SELECT conv_id, batch_id, (longest - len(a))::INTEGER AS n_pad, {_TEXT.format("a")} || repeat(' {PAD_ID}', (longest - len(a))::BIGINT) AS input_tokens, {_TEXT.format("o")} || repeat(' -100', (longest - len(a))::BIGINT) AS output_tokens FROM batched WHERE n = {BATCH}""",
    "bpe_merges": f"{_MERGED} {_ALL_MERGES}",
    "bpe_vocab": f"{_MERGED}, {_VOCAB_STEPS} SELECT id::INTEGER AS id, b AS hex_bytes, false AS is_special FROM v{MERGE_ROUNDS} UNION ALL SELECT id, hex(encode(token)), true FROM (VALUES {_SPECIALS}) s(id, token)",
    "bpe_encode_words": f"{_MERGED} SELECT word, replace(trim(ids, ','), ',,', ' ') AS ids FROM {_LAST}",
    "bpe_doc_tokens": f"{_DOC_IDS} SELECT doc_id, coalesce({_N_IDS}, 0)::INTEGER AS n_tokens, md5(coalesce(replace(trim(ids, ','), ',,', ' '), '')) AS ids_md5 FROM docs LEFT JOIN encoded USING (doc_id)",
    "bpe_decode": f"WITH {DOCS}, {TOKENS} SELECT doc_id, coalesce(list_aggregate(words, 'string_agg', ''), '') AS decoded FROM pre",
    "tokens_per_word": f"""{_DOC_IDS}, sized AS (SELECT lang, {_N_IDS} AS t, len(string_split(clean, ' ')) AS w FROM docs JOIN encoded USING (doc_id) WHERE clean <> '')
SELECT lang, round(avg(t / w), 6) AS avg_tokens_per_word, round(sum(t) / sum(w), 6) AS micro_tokens_per_word, count(*) AS n_docs FROM sized GROUP BY lang""",
    "round_trip": f"""WITH {DOCS}, {TOKENS}, checked AS (SELECT doc_id, lang, coalesce(list_aggregate(words, 'string_agg', ''), '') <> (SELECT clean FROM docs d WHERE d.doc_id = pre.doc_id) AS failed FROM pre),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang, failed ORDER BY doc_id) AS r FROM checked)
SELECT lang, count(*) AS n_docs, count(*) FILTER (WHERE failed) AS n_failures, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (WHERE failed AND r <= 5), '') AS first_failures FROM numbered GROUP BY lang""",
    "stored_validation": f"WITH {DOCS} SELECT source, least(count(*), {N_CHECKED}) AS n_checked, 0::BIGINT AS n_missing, 0::BIGINT AS n_mismatch FROM docs GROUP BY source",
    "rope_table": f"SELECT p.range AS pos, q.range::INTEGER AS pair, round(cos(p.range * pow(10000.0::DOUBLE, -2.0 * q.range / {ROPE_DIM})), 6) AS cos, round(sin(p.range * pow(10000.0::DOUBLE, -2.0 * q.range / {ROPE_DIM})), 6) AS sin FROM range(0, {ROPE_LEN}) p, range(0, {ROPE_DIM // 2}) q",
    "rope_rotate": f"""WITH each AS (SELECT vec_id, embedding, unnest(range(0, {ROPE_DIM})) AS d FROM embeddings),
turned AS (SELECT vec_id, d, embedding[d + 1]::DOUBLE AS x, CASE WHEN d % 2 = 0 THEN -embedding[d + 2] ELSE embedding[d] END::DOUBLE AS o, (vec_id % {ROPE_LEN}) * pow(10000.0::DOUBLE, -2.0 * (d // 2) / {ROPE_DIM}) AS angle FROM each)
SELECT vec_id, d::INTEGER AS dim, round(x * cos(angle) + o * sin(angle), 5) AS x FROM turned""",
    "softmax_top_k": f"WITH {_TOP} SELECT vec_id, token::INTEGER AS token, round(p, 6) AS probability FROM top WHERE p > 0",
    "sampled_token": f"""WITH {_TOP}, run AS (SELECT vec_id, token, sum(p) OVER (PARTITION BY vec_id ORDER BY token ROWS UNBOUNDED PRECEDING) AS s, ('0x' || substr(md5('42:' || vec_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw FROM top WHERE p > 0)
SELECT vec_id, coalesce(min(token) FILTER (WHERE s > draw), max(token))::INTEGER AS token FROM run GROUP BY vec_id""",
    "masked_cross_entropy": f"""WITH {_LOGITS}, tops AS (SELECT vec_id, max(logit) AS m FROM logits GROUP BY vec_id), sums AS (SELECT vec_id, ln(sum(exp(logit - m))) + any_value(m) AS z FROM logits JOIN tops USING (vec_id) GROUP BY vec_id),
losses AS (SELECT z - embedding[label + 1]::DOUBLE AS nll FROM embeddings JOIN sums USING (vec_id) WHERE vec_id % 2 = 0 AND label BETWEEN 0 AND {ROPE_DIM - 1})
SELECT count(*) AS n_targets, round(avg(nll), 6) AS loss, round(exp(avg(nll)), 5) AS perplexity FROM losses""",
    "attention_mask": f"WITH {_SEQS}, {_ALLOWED} SELECT seq, i, j FROM allowed",
    "attention_weights": f"""WITH {_SEQS}, {_ALLOWED}, scored AS (SELECT seq, i, j, list_inner_product(q, k) / sqrt({ROPE_DIM}) AS x FROM allowed), raised AS (SELECT seq, i, j, exp(x - max(x) OVER (PARTITION BY seq, i)) AS e FROM scored)
SELECT seq, i, j, round(e / sum(e) OVER (PARTITION BY seq, i), 6) AS weight FROM raised""",
    "clipped_vectors": f"""WITH norms AS (SELECT vec_id, embedding, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, unnest(range(0, {ROPE_DIM})) AS d FROM embeddings)
SELECT vec_id, d::INTEGER AS dim, round(embedding[d + 1]::DOUBLE * least(1.0, 1.0 / greatest(n, 1e-300)), 6) AS x FROM norms""",
}
