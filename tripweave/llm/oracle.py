"""SQL for the registered queries that SQL can express, written from the contracts."""

CONTROL = r"(</s>|<s>|\[INST\]|\[/INST\])"

CHATS = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), measured AS (
  SELECT *,
    length('<s>[INST] ') + length(' [/INST]' || chr(10)) + length(chr(10) || '</s>')
      + length(regexp_replace(role, '{CONTROL}', '\\\1', 'g'))
      + length(regexp_replace(text, '{CONTROL}', '\\\1', 'g')) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), ''))
    AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM measured GROUP BY conv_id
"""

EXACT = """
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY text)
"""

LEAKS = r"""
WITH split AS (
  SELECT kind, id, list_filter(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w
  FROM (SELECT 'doc' AS kind, doc_id AS id, text FROM documents
        UNION ALL SELECT 'item', item_id, text FROM benchmark)
), shingles AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN []
      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM split
), sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'item' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n AS item_shingles, count(*) AS shared_shingles,
  round(count(*) / n, 6) AS containment
FROM shingles d JOIN shingles i ON d.kind = 'doc' AND i.kind = 'item' AND d.s = i.s
JOIN sizes ON sizes.id = i.id
GROUP BY d.id, i.id, n HAVING count(*) >= 0.8 * n
"""

SQL = {"op1_benchmark_decontamination": LEAKS, "op7_chat_formatting": CHATS, "op9_exact_dedup": EXACT}
