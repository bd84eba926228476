"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# ---------------------------------------------------------------------------
# Creation-time epoch of snowflake ids, in Unix milliseconds.
SNOWFLAKE_EPOCH_MS = 1420070400000
# Message links: <base>/<server id or @me>/<channel id>/<message id>.
MESSAGE_LINK_BASE = "https://discord.com/channels"
# Tenant ids: "user_" followed by 10 to 50 ASCII letters or digits.
TENANT_ID_PATTERN = r"^user_[a-zA-Z0-9]{10,50}$"
# White space as Python's str.split() sees it (word counts split on these). The
# Latin-1 ones stand one by one, so that they are one table look-up, and the
# others behind one range that most characters fail.
PY_WHITESPACE_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}\x{1D}\x{1E}\x{1F} \x{85}\x{A0}"
                       r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]+")
# Channel type codes and their names; other codes read "Other".
CHANNEL_TYPE_NAMES = {0: "Text", 2: "Voice", 4: "Category", 5: "Announcement", 15: "Forum"}
# Message type codes.
MESSAGE_TYPE_DEFAULT = 0
MESSAGE_TYPE_REPLY = 19
# ---------------------------------------------------------------------------


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_count(content: Column | str) -> Column:
    """Number of white-space separated tokens; 0 for NULL or empty text. Never
    NULL by its type, so a test for NULL does not split the text once more."""
    c = col(content)
    n = F.size(F.array_remove(F.split(c, PY_WHITESPACE_CLASS), ""))
    return F.when(c.isNull(), F.lit(0)).otherwise(F.coalesce(n, F.lit(0))).cast("int")


def char_count(content: Column | str) -> Column:
    """Number of code points; 0 for NULL."""
    return F.coalesce(F.length(col(content)), F.lit(0)).cast("int")


def snowflake_to_timestamp(id_col: Column | str) -> Column:
    """Creation time (UTC wall clock) encoded in a snowflake id."""
    millis = F.shiftright(col(id_col), 22) + F.lit(SNOWFLAKE_EPOCH_MS)
    return F.timestamp_millis(millis).cast("timestamp_ntz")


def display_name(nick: Column | str | None, global_name: Column | str,
                 username: Column | str) -> Column:
    """nick, else global name, else username; empty strings fall through."""
    parts = [] if nick is None else [F.nullif(col(nick), F.lit(""))]
    parts += [F.nullif(col(global_name), F.lit("")), col(username)]
    return F.coalesce(*parts)


def emoji_text(name: Column | str, emoji_id: Column | str, animated: Column | str) -> Column:
    """``<a:name:id>`` / ``<:name:id>`` for custom emojis, the name for unicode ones."""
    prefix = F.when(F.coalesce(col(animated), F.lit(False)), F.lit("a")).otherwise(F.lit(""))
    custom = F.concat(F.lit("<"), prefix, F.lit(":"), col(name), F.lit(":"),
                      col(emoji_id).cast("string"), F.lit(">"))
    return F.when(col(emoji_id).isNotNull() & (col(emoji_id) != 0), custom).otherwise(col(name))


def jump_url(server_id: Column | str, channel_id: Column | str, message_id: Column | str,
             base: str = MESSAGE_LINK_BASE) -> Column:
    return F.concat_ws("/", F.lit(base), F.coalesce(col(server_id).cast("string"), F.lit("@me")),
                       col(channel_id).cast("string"), col(message_id).cast("string"))


def valid_tenant_id(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(TENANT_ID_PATTERN), F.lit(False))


def idiv(a: Column, b: Column | int) -> Column:
    """Integer (floor) division of integers, like SQL ``div`` for b > 0."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a, b)


def round_ratio(num: Column, den: Column, digits: int = 1, scale: int = 1) -> Column:
    """``round(scale * num / den, digits)`` for integer num/den, exact.

    Rounds half away from zero on the exact rational value (integer
    arithmetic, no binary floating error), returns DOUBLE; NULL when den is
    0 or NULL. The same formula is used on the SQL oracle side.
    """
    m = scale * 10 ** digits
    n = num.cast("long")
    d = den.cast("long")
    q = idiv(F.abs(n) * (2 * m) + d, d * 2)
    signed = F.when(n < 0, -q).otherwise(q)
    return F.when(d.isNull() | (d == 0), F.lit(None).cast("double")) \
        .otherwise(signed.cast("double") / F.lit(float(10 ** digits)))


def count_occurrences(text: Column, needle: str, lower: bool = False) -> Column:
    """Non-overlapping occurrences of ``needle`` (length-difference method)."""
    t = F.lower(text) if lower else text
    diff = F.length(t) - F.length(F.replace(t, F.lit(needle), F.lit("")))
    return F.coalesce(idiv(diff, len(needle)), F.lit(0))


def channel_type_name(type_col: Column | str) -> Column:
    c = col(type_col)
    expr = None
    for code, name in CHANNEL_TYPE_NAMES.items():
        expr = (F.when(c == code, F.lit(name)) if expr is None
                else expr.when(c == code, F.lit(name)))
    return expr.otherwise(F.lit("Other"))


def weekday_sun0(ts: Column | str) -> Column:
    """Day of week with Sunday = 0 (Spark's dayofweek has Sunday = 1)."""
    return (F.dayofweek(col(ts)) - 1).cast("int")


def micros_between(start: Column | str, end: Column | str) -> Column:
    """Exact microseconds from start to end. Wall-clock UTC values: with the
    session time zone at UTC the cast to TIMESTAMP keeps the instant."""
    return F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))
