"""Column functions; every one is a composition of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKS = "‎‏​⁠﻿"
GENERIC_NAMES = ("cell", "group", "scroll area", "text", "text field")
LAYOUTS = {"azerty": ("qawzQAWZ;m,", "aqzwAQZWm,;")}


def ts_us(ts: Column) -> Column:
    """Microseconds of an ISO text with T; an offset is not read (the text is UTC); null for anything else."""
    whole = F.unix_micros(F.try_to_timestamp(F.substring(ts, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    fraction = F.rpad(F.substring(F.regexp_extract(ts, r"^.{19}\.(\d+)", 1), 1, 6), 6, "0").cast("long")
    return whole + fraction


def clean_name(s: Column) -> Column:
    """Without direction marks, zero-width characters and surrounding white space."""
    return F.regexp_replace(F.translate(s, _MARKS, ""), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def hostname(url: Column) -> Column:
    """Lower-cased host without user, port and brackets; empty if there is none."""
    own = F.regexp_replace(_netloc(url), r"^.*@", "")
    inner = F.when(own.startswith("["), F.regexp_extract(own, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(own, r"^[^:]*", 0))
    return F.coalesce(F.lower(inner), F.lit(""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(hostname(url), r"^www\.", "")


def site(url: Column) -> Column:
    """bare_host, null where there is none."""
    return F.nullif(bare_host(url), F.lit(""))


def path_parts(url: Column) -> Column:
    path = F.regexp_extract(F.regexp_replace(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", ""), r"^[^?#]*", 0)
    return F.filter(F.split(path, "/"), lambda p: p != "")


def query_text(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def unquote(x: Column) -> Column:
    """Percent-decoded; a plus stays, a malformed escape too."""
    return F.try_url_decode(F.replace(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


def query_pairs(url: Column) -> Column:
    """array<struct<k,v>> of the query, decoded, without blank values."""
    pairs = F.filter(F.split(query_text(url), "&"), lambda e: F.instr(e, "=") > 0)
    plus = lambda x: unquote(F.translate(x, "+", " "))
    parsed = F.transform(pairs, lambda e: F.struct(plus(F.substring_index(e, "=", 1)).alias("k"), plus(F.regexp_replace(e, "^[^=]*=", "")).alias("v")))
    return F.filter(parsed, lambda e: e["v"] != "")


def apex(domain: Column) -> Column:
    return F.substring_index(domain, ".", -2)


def slug(x: Column) -> Column:
    return F.trim(F.translate(unquote(x), "-_", "  "))


def url_template(url: Column, depth: int = 2) -> Column:
    """host/first segments/* for a page deeper than depth, else as deep as it is."""
    parts, host = path_parts(url), hostname(url)
    head = F.concat_ws("/", host, F.slice(parts, 1, depth))
    return F.when(F.size(parts) > 0, F.concat(head, F.lit("/*"))).otherwise(host)


def decode_text(text: Column, layout) -> Column:
    """Simultaneous substitution of characters by a named layout or a dict."""
    if not layout:
        return text
    src, dst = LAYOUTS[layout] if isinstance(layout, str) else ("".join(layout), "".join(layout.values()))
    return F.translate(text, src, dst)


def clipped(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def confidence(event_type: Column, resolution: Column, dt_ms: Column) -> Column:
    """How sure an event's attribution is; a distance of exactly 0 counts as unknown."""
    near = F.coalesce(F.nullif(dt_ms, F.lit(0)), F.lit(9999)) < 2000
    return (
        F.when(event_type.isin("text", "app_switch", "clipboard"), "high")
        .when(event_type == "click", F.when(resolution == "native", "high").when(resolution == "exact", F.when(near, "high").otherwise("medium")).when(resolution == "tolerance", "medium").otherwise("low"))
        .otherwise("low")
    )


def screen_zone(x: Column, y: Column) -> Column:
    return F.when(y < 0.04, "menu bar").when(y < 0.08, "browser chrome").when(x < 0.15, "left sidebar").otherwise("main content")


def tokens(s: Column) -> Column:
    """Number of tokens, estimated as a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(s) / 4).cast("int"))


def click_step(name: Column, role: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    generic = (n == "") | F.lower(n).isin(*GENERIC_NAMES)
    return F.when(generic, F.concat(F.lit("["), F.trim(F.coalesce(F.nullif(role, F.lit("")), F.lit("el"))), F.lit("]"))).otherwise(F.substring(n, 1, 40))


def type_step(name: Column) -> Column:
    return F.concat(F.lit("type:"), F.substring(F.coalesce(F.nullif(name, F.lit("")), F.lit("field")), 1, 24))


def is_specific(step: Column) -> Column:
    return ~step.startswith("[") & (step != "type:field")


#: Verbs that make a control's label a destructive one when it begins with them.
DESTRUCTIVE_VERBS = (
    "send", "post", "publish", "share", "connect", "delete", "remove", "pay", "buy", "submit", "confirm", "transfer",
    "archive", "discard", "checkout", "purchase", "withdraw", "tweet", "invite", "follow", "apply",
)
#: Names of roles that mean the same.
ROLE_NAMES = {"axbutton": "button", "axtextfield": "textbox", "axstatictext": "text"}


def is_destructive(label: Column) -> Column:
    plain = F.lower(F.regexp_replace(clean_name(label), r"\s+", " "))
    return plain.rlike(rf"^({'|'.join(DESTRUCTIVE_VERBS)})\b")


def role_matches(found: Column, wanted: Column) -> Column:
    """Whether a role is the wanted one, under any of its names; an empty wanted role fits every role."""
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    plain = lambda c: F.trim(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    same = lambda c: F.coalesce(names[plain(c)], plain(c))
    return (F.coalesce(wanted, F.lit("")) == "") | (same(found) == same(wanted))
