"""Registered content queries."""

from __future__ import annotations

from chatlens.catalog.base import AS_OF, HUMANS, PLACED, SIGNED, pct, ratio, register, since
from chatlens.operators import content as X

NONEMPTY = "content IS NOT NULL AND content <> ''"


def _occ(col: str, needle: str) -> str:
    return f"((length({col}) - length(replace({col}, '{needle}', ''))) // {len(needle)})"


@register("message_length_stats", f"""
SELECT {ratio('SUM(word_count)', 'COUNT(word_count)', 4)} AS avg_words,
       {ratio('SUM(char_count)', 'COUNT(char_count)', 4)} AS avg_chars,
       MIN(word_count) AS min_words, MAX(word_count) AS max_words,
       MIN(char_count) AS min_chars, MAX(char_count) AS max_chars
FROM messages WHERE {NONEMPTY}""")
def _message_length_stats(t):
    return X.message_length_stats(t.messages)


@register("attachment_stats", f"""
SELECT COUNT(*) AS total_with_attachments, CAST(SUM(attachment_count) AS BIGINT) AS total_attachments,
       {ratio('SUM(attachment_count)', 'COUNT(*)', 4)} AS avg_attachments_per_message
FROM messages WHERE attachment_count > 0""")
def _attachment_stats(t):
    return X.attachment_stats(t.messages)


@register("embed_stats", f"""
SELECT COUNT(*) AS total_with_embeds, CAST(SUM(embed_count) AS BIGINT) AS total_embeds,
       {ratio('SUM(embed_count)', 'COUNT(*)', 4)} AS avg_embeds_per_message
FROM messages WHERE embed_count > 0""")
def _embed_stats(t):
    return X.embed_stats(t.messages)


@register("longest_messages", f"""
SELECT username, channel, word_count, char_count, left(content, 50) AS content_preview
FROM {PLACED} p WHERE word_count IS NOT NULL ORDER BY word_count DESC, id LIMIT 10""")
def _longest_messages(t):
    return X.longest_messages(t.messages, t.users, t.channels)


@register("longest_messages_chars", f"""
SELECT username, CAST(length(content) AS INTEGER) AS content_length, left(content, 100) AS preview, created_at
FROM {SIGNED} s WHERE content IS NOT NULL ORDER BY content_length DESC, id LIMIT 20""")
def _longest_messages_chars(t):
    return X.longest_messages_chars(t.messages, t.users)


@register("empty_messages", """
SELECT COUNT(*) AS empty_content_count,
       COUNT(CASE WHEN attachment_count > 0 THEN 1 END) AS with_attachments,
       COUNT(CASE WHEN embed_count > 0 THEN 1 END) AS with_embeds
FROM messages WHERE content IS NULL OR content = ''""")
def _empty_messages(t):
    return X.empty_messages(t.messages)


@register("content_metrics", f"""
SELECT CAST(coalesce(SUM(word_count), 0) AS BIGINT) AS total_words,
       CAST(coalesce(SUM(char_count), 0) AS BIGINT) AS total_characters,
       coalesce({ratio('coalesce(SUM(word_count), 0)', 'COUNT(word_count)', 1)}, 0.0)
         AS avg_words_per_message,
       COUNT(CASE WHEN attachment_count > 0 THEN 1 END) AS messages_with_attachments,
       COUNT(CASE WHEN embed_count > 0 THEN 1 END) AS messages_with_embeds,
       COUNT(CASE WHEN mention_count > 0 THEN 1 END) AS messages_with_mentions,
       COUNT(CASE WHEN is_pinned THEN 1 END) AS pinned_messages
FROM messages WHERE created_at >= {since(7)}""")
def _content_metrics(t):
    return X.content_metrics(t.messages, as_of=AS_OF, days=7)


@register("messages_with_attachments", f"""
SELECT username, content, attachment_count, created_at FROM {SIGNED} s
WHERE attachment_count > 0 ORDER BY created_at DESC, id DESC LIMIT 20""")
def _messages_with_attachments(t):
    return X.messages_with_attachments(t.messages, t.users)


@register("search_messages", f"""
SELECT username, content, channel, created_at FROM {PLACED} p
WHERE regexp_matches(content, 'haha', 'i') ORDER BY created_at DESC, id DESC LIMIT 20""")
def _search_messages(t):
    return X.search_messages(t.messages, t.users, t.channels, "HaHa")


@register("pinned_messages", f"""
SELECT username, channel, content, created_at FROM {PLACED} p WHERE is_pinned""")
def _pinned_messages(t):
    return X.pinned_messages(t.messages, t.users, t.channels)


@register("recent_messages", f"""
SELECT id, username, content, created_at FROM {SIGNED} s ORDER BY created_at DESC, id DESC LIMIT 20""")
def _recent_messages(t):
    return X.recent_messages(t.messages, t.users)


@register("first_and_last_message", """
WITH k AS (SELECT m.* FROM messages m JOIN users u ON m.author_id = u.id
           JOIN channels c ON m.channel_id = c.id),
e AS (
  SELECT 'first' AS which, arg_min(id, (created_at, id)) AS id FROM k
  UNION ALL SELECT 'last', arg_max(id, (created_at, id)) FROM k)
SELECT e.which, u.username, c.name AS channel, m.created_at,
       CASE WHEN length(m.content) > 100 THEN substr(m.content, 1, 100) || '...'
            ELSE m.content END AS preview
FROM e JOIN messages m ON m.id = e.id LEFT JOIN users u ON m.author_id = u.id
LEFT JOIN channels c ON m.channel_id = c.id""")
def _first_and_last_message(t):
    return X.first_and_last_message(t.messages, t.users, t.channels)


@register("essay_writers", f"""
SELECT u.username, {ratio('SUM(m.char_count)', 'COUNT(*)', 1)} AS avg_length,
       MAX(m.char_count) AS max_length, COUNT(*) AS total_msgs
FROM messages m JOIN users u ON m.author_id = u.id
WHERE m.{NONEMPTY.replace(' AND content', ' AND m.content')}
GROUP BY u.id, u.username HAVING COUNT(*) >= 20
ORDER BY avg_length DESC, u.id LIMIT 10""")
def _essay_writers(t):
    return X.essay_writers(t.messages, t.users)


_LEN = f"""
SELECT u.id AS uid, u.username, {ratio('SUM(m.char_count)', 'COUNT(*)', 1)} AS avg_length,
       MAX(m.char_count) AS max_length
FROM messages m JOIN {HUMANS} u ON m.author_id = u.id
WHERE m.content IS NOT NULL AND m.content <> ''
GROUP BY u.id, u.username HAVING COUNT(*) >= 50"""


@register("rambler", f"""
SELECT username, avg_length, max_length FROM ({_LEN}) x ORDER BY avg_length DESC, uid LIMIT 5""")
def _rambler(t):
    return X.rambler(t.messages, t.users)


@register("succinct", f"""
SELECT username, avg_length FROM ({_LEN}) x ORDER BY avg_length ASC, uid LIMIT 5""")
def _succinct(t):
    return X.succinct(t.messages, t.users)


@register("exclamations", f"""
SELECT u.username, CAST(SUM({_occ('m.content', '!')}) AS BIGINT) AS exclamations, COUNT(*) AS msgs,
       {ratio(f"SUM({_occ('m.content', '!')})", 'COUNT(*)', 2)} AS excl_per_msg
FROM messages m JOIN users u ON m.author_id = u.id
WHERE m.content IS NOT NULL AND m.content <> ''
GROUP BY u.id, u.username HAVING COUNT(*) >= 20
ORDER BY excl_per_msg DESC, u.id LIMIT 10""")
def _exclamations(t):
    return X.exclamations(t.messages, t.users)


@register("question_askers", f"""
SELECT u.username, COUNT(CASE WHEN m.content LIKE '%?' THEN 1 END) AS questions,
       COUNT(*) AS total,
       {pct("COUNT(CASE WHEN m.content LIKE '%?' THEN 1 END)", 'COUNT(*)')} AS question_pct
FROM messages m JOIN users u ON m.author_id = u.id
GROUP BY u.id, u.username HAVING COUNT(*) >= 20
ORDER BY questions DESC, u.id LIMIT 10""")
def _question_askers(t):
    return X.question_askers(t.messages, t.users)


_LAUGH = " + ".join(_occ("lower(m.content)", w) for w in X.LAUGH_WORDS)
_LINK = " + ".join(_occ("m.content", p) for p in X.LINK_PREFIXES)


@register("laugh_count", f"""
SELECT u.username, CAST(SUM({_LAUGH}) AS BIGINT) AS laugh_count
FROM messages m JOIN {HUMANS} u ON m.author_id = u.id WHERE m.content IS NOT NULL
GROUP BY u.id, u.username ORDER BY laugh_count DESC, u.id LIMIT 5""")
def _laugh_count(t):
    return X.laugh_count(t.messages, t.users)


@register("link_count", f"""
SELECT u.username, CAST(SUM({_LINK}) AS BIGINT) AS link_count
FROM messages m JOIN {HUMANS} u ON m.author_id = u.id WHERE m.content IS NOT NULL
GROUP BY u.id, u.username ORDER BY link_count DESC, u.id LIMIT 5""")
def _link_count(t):
    return X.link_count(t.messages, t.users)
