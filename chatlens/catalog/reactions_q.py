"""Registered reaction and mention queries."""

from __future__ import annotations

from chatlens.catalog.base import (
    AS_OF, PLACED, REACTED, SIGNED, TAGGED, between, ratio, register, since, tally,
)
from chatlens.operators import reactions as X


@register("top_emojis", f"""
SELECT name AS emoji, is_custom, coalesce(n, 0) AS usage_count
FROM emojis LEFT JOIN {tally('reactions', 'emoji_id AS id')} used USING (id)
ORDER BY usage_count DESC, id LIMIT 15""")
def _top_emojis(t):
    return X.top_emojis(t.emojis, t.reactions)


@register("popular_emojis", f"""
SELECT name, n AS usage_count FROM {tally('reactions', 'emoji_id AS id')} used JOIN emojis USING (id)
ORDER BY n DESC, id LIMIT 10""")
def _popular_emojis(t):
    return X.popular_emojis(t.reactions, t.emojis)


@register("custom_vs_unicode", f"""
SELECT if(is_custom, 'Custom', 'Unicode') AS emoji_type, CAST(SUM(coalesce(n, 0)) AS BIGINT) AS usage_count,
       COUNT(*) AS unique_emojis
FROM emojis LEFT JOIN {tally('reactions', 'emoji_id AS id')} used USING (id) GROUP BY 1""")
def _custom_vs_unicode(t):
    return X.custom_vs_unicode(t.emojis, t.reactions)


@register("most_reacted_messages", f"""
SELECT username AS author, channel, n AS reaction_count, left(content, 50) AS content_preview
FROM {tally('reactions', 'message_id AS id')} got JOIN {PLACED} p USING (id)
ORDER BY n DESC, id LIMIT 10""")
def _most_reacted_messages(t):
    return X.most_reacted_messages(t.messages, t.users, t.channels, t.reactions)


@register("most_reacted_messages_all", f"""
SELECT id, left(content, 50) AS preview, username AS author, coalesce(n, 0) AS reaction_count
FROM {SIGNED} s LEFT JOIN {tally('reactions', 'message_id AS id')} got USING (id)
ORDER BY reaction_count DESC, id LIMIT 20""")
def _most_reacted_messages_all(t):
    return X.most_reacted_messages_all(t.messages, t.users, t.reactions)


@register("reaction_pairs", between(
    tally(REACTED, "a", "b", where="server_id = 1 AND a <> b"),
    "reactor", "message_author", "reaction_count", 10))
def _reaction_pairs(t):
    return X.reaction_pairs(t.reactions, t.messages, t.users, server_id=1)


@register("reaction_patterns", f"""
WITH per_emoji AS {tally(REACTED, 'a', 'b', 'emoji_id', where=f'server_id = 1 AND a <> b AND ts > {since(7)}')}
SELECT ua.username AS reactor, ub.username AS message_author, CAST(SUM(n) AS BIGINT) AS reaction_count,
       list_sort(list_distinct(list(e.name))) AS emojis_used
FROM per_emoji p JOIN emojis e ON e.id = p.emoji_id JOIN users ua ON ua.id = a JOIN users ub ON ub.id = b
GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""")
def _reaction_patterns(t):
    return X.reaction_patterns(t.reactions, t.messages, t.users, t.emojis, server_id=1, days=7,
                               as_of=AS_OF)


@register("self_reactions", f"""
SELECT COUNT(*) AS self_reaction_count FROM {REACTED} r WHERE a = b""")
def _self_reactions(t):
    return X.self_reactions(t.reactions, t.messages)


@register("most_mentioned", f"""
SELECT username, global_name, n AS times_mentioned
FROM {tally('message_mentions', 'mentioned_user_id AS id')} got JOIN users USING (id)
ORDER BY n DESC, id LIMIT 10""")
def _most_mentioned(t):
    return X.most_mentioned(t.message_mentions, t.users)


@register("mentioners", f"""
WITH partners AS {tally(TAGGED, 'a AS id', 'b')},
gave AS (SELECT id, COUNT(*) AS people, CAST(SUM(n) AS BIGINT) AS total FROM partners GROUP BY id)
SELECT username, global_name, people AS unique_users_mentioned, total AS total_mentions
FROM gave JOIN users USING (id) ORDER BY total DESC, id LIMIT 10""")
def _mentioners(t):
    return X.mentioners(t.messages, t.users, t.message_mentions)


@register("tag_happy", f"""
WITH wrote AS {tally('messages', 'author_id AS id', tags='CAST(coalesce(SUM(mention_count), 0) AS BIGINT)')}
SELECT username, tags AS mentions_given, n AS total_msgs, {ratio('tags', 'n', 2)} AS mentions_per_msg
FROM wrote JOIN users USING (id) WHERE n >= 20 ORDER BY tags DESC, id LIMIT 10""")
def _tag_happy(t):
    return X.tag_happy(t.messages, t.users)


@register("self_mentions", f"""
SELECT COUNT(*) AS self_mention_count FROM {TAGGED} t WHERE a = b""")
def _self_mentions(t):
    return X.self_mentions(t.message_mentions, t.messages)


@register("everyone_mentions", f"""
SELECT n AS everyone_mention_count, username AS author
FROM {tally('messages', 'author_id AS id', where='mentions_everyone')} called JOIN users USING (id)""")
def _everyone_mentions(t):
    return X.everyone_mentions(t.messages, t.users)


@register("mention_network", f"""
SELECT ua.username AS from_user, ub.username AS to_user, CAST(SUM(n) AS BIGINT) AS mention_count
FROM {tally(TAGGED, 'a', 'b', where='a <> b')} p JOIN users ua ON ua.id = a JOIN users ub ON ub.id = b
GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""")
def _mention_network(t):
    return X.mention_network(t.message_mentions, t.messages, t.users)


@register("mention_network_all", between(
    tally(TAGGED, "a", "b"), "mentioner", "mentioned_user", "mention_count", 20))
def _mention_network_all(t):
    return X.mention_network_all(t.message_mentions, t.messages, t.users)
