"""URL typing: a url becomes struct<kind, domain, entity> by a table of rules, compiled into one CASE.

A rule is (hosts, condition, kind, entity): SQL over d (the host without www.), p (the path segments), n (their
number) and q(name) (the first non-blank value of a query parameter). ``?`` after a rule's hosts means that the
host must be equal; else subdomains match by their last two labels, unless the whole host has rules of its own.
Rules of one host are tried in order; without one that fits, the general rules follow. New sites are new rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bare_host, path_parts, query_pairs

_SLUG = "trim(translate({0}, '-_', '  '))"


def _unq(x: str) -> str:
    return f"try_url_decode(replace(regexp_replace({x}, '%(?![0-9A-Fa-f]{{2}})', '%25'), '+', '%2B'))"


def _slug(x: str) -> str:
    return _SLUG.format(_unq(x))


def _is(i: int, *words: str) -> str:
    return f"get(p,{i}) IN ({', '.join(repr(w) for w in words)})"


S1, S2 = "get(p,1)", "get(p,2)"
_REPO = "concat(get(p,0), '/', get(p,1))"
_CUT = "array_position(p, '-')"
_PROJECT = f"array_join(slice(p, 1, CAST({_CUT} - 1 AS INT)), '/')"
_AFTER = f"get(p, CAST({_CUT} AS INT))"
_NUMBER = f"get(p, CAST({_CUT} + 1 AS INT))"
_TEAM = "regexp_replace(d, '[.]slack[.]com$', '')"
_PREFIX = f"CASE WHEN {_TEAM} IN ('', 'app') THEN '' ELSE concat({_TEAM}, '/') END"

#: (hosts, condition, kind as SQL or word, entity as SQL or None)
RULES: list[tuple[str, str, str, str | None]] = [
    ("127.0.0.1 localhost", "true", "local_dev", "array_join(slice(p, 1, 2), '/')"),
    ("atlassian.net", f"n >= 2 AND {_is(0, 'browse')}", "issue", S1),
    ("atlassian.net", f"n >= 5 AND {_is(0, 'wiki')} AND {_is(1, 'spaces')} AND {_is(3, 'pages')}", "doc", f"CASE WHEN n > 5 THEN {_slug('replace(get(p,5), chr(43), chr(32))')} ELSE get(p,4) END"),
    ("calendar.google.com", "true", "calendar", None),
    ("calendly.com", "n > 0", "booking", "array_join(slice(p, 1, 2), '/')"),
    ("chat.openai.com chatgpt.com claude.ai", "true", "ai_chat", None),
    ("crunchbase.com", "n = 0", "home", None),
    ("crunchbase.com", f"n > 1 AND {_is(0, 'organization')}", "company", _slug(S1)),
    ("crunchbase.com", f"n > 1 AND {_is(0, 'person')}", "profile", _slug(S1)),
    ("crunchbase.com", f"n > 1 AND {_is(0, 'funding_round')}", "funding_round", _slug(S1)),
    ("crunchbase.com", _is(0, "discover"), "search", f"coalesce({S1}, 'discover')"),
    ("dashboard.stripe.com", "true", "dashboard", "get(p,0)"),
    ("discord.com", f"n >= 2 AND {_is(0, 'channels')} AND {_is(1, '@me')}", "messages", None),
    ("discord.com", f"n >= 2 AND {_is(0, 'channels')}", "channel", S1),
    ("discord.com", "true", "app", None),
    *[("docs.google.com", _is(0, part), kind, None) for part, kind in (("forms", "form"), ("presentation", "slides"), ("spreadsheets", "sheet"), ("document", "doc"))],
    ("figma.com", f"n >= 3 AND {_is(0, 'board', 'design', 'file')}", "design", _slug(S2)),
    ("github.com", "n = 0", "home", None),
    ("github.com", "n = 1", "user", "get(p,0)"),
    ("github.com", f"n >= 4 AND {_is(2, 'issues')}", "issue", f"concat({_REPO}, '#', get(p,3))"),
    ("github.com", f"n >= 4 AND {_is(2, 'pull')}", "pull_request", f"concat({_REPO}, '#', get(p,3))"),
    ("github.com", _is(2, "tree", "blob"), "code", _REPO),
    ("github.com", _is(2, "commit", "commits"), "commits", _REPO),
    ("github.com", "true", "repo", _REPO),
    ("gitlab.com", "n = 0", "home", None),
    ("gitlab.com", f"{_is(0, 'users')} AND {_is(1, 'confirmation', 'password', 'sign_in', 'sign_up')}", "sign_in", None),
    ("gitlab.com", f"{_is(0, 'search')}", "search", f"trim({_unq('q(search)')})"),
    ("gitlab.com", _is(0, "dashboard"), "dashboard", S1),
    ("gitlab.com", _is(0, "explore"), "explore", None),
    ("gitlab.com", f"n > 1 AND {_is(0, 'groups')}", "group", f"array_join(CASE WHEN {_CUT} > 1 THEN slice(p, 2, CAST({_CUT} - 2 AS INT)) ELSE slice(p, 2, n) END, '/')"),
    ("gitlab.com", f"NOT coalesce({_is(0, 'users')}, false) AND {_CUT} > 1 AND {_AFTER} = 'issues' AND {_NUMBER} RLIKE '^[0-9]+$'", "issue", f"concat({_PROJECT}, '#', {_NUMBER})"),
    ("gitlab.com", f"NOT coalesce({_is(0, 'users')}, false) AND {_CUT} > 1 AND {_AFTER} = 'merge_requests' AND {_NUMBER} RLIKE '^[0-9]+$'", "merge_request", f"concat({_PROJECT}, '!', {_NUMBER})"),
    *[("gitlab.com", f"NOT coalesce({_is(0, 'users')}, false) AND {_CUT} > 1 AND coalesce({_AFTER}, '') IN ({what})", kind, _PROJECT) for kind, what in (("pipelines", "'pipelines'"), ("commits", "'commits', 'commit'"), ("code", "'tree', 'blob'"))],
    ("gitlab.com", f"NOT coalesce({_is(0, 'users')}, false) AND {_CUT} > 1", "repo", _PROJECT),
    ("gitlab.com", f"n >= 2 AND NOT {_is(0, 'users')} AND {_CUT} = 0", "repo", "array_join(p, '/')"),
    ("google.com", "trim(q(q)) <> ''", "search", f"trim({_unq('q(q)')})"),
    ("google.com", f"{_is(0, 'maps')} AND {_is(1, 'dir')}", "map_directions", None),
    ("google.com", f"{_is(0, 'maps')} AND {_is(1, 'place')}", "map_place", _slug(S2)),
    ("google.com", _is(0, "maps"), "map", None),
    ("instagram.com", "n = 0", "feed", None),
    ("instagram.com", f"n > 1 AND {_is(0, 'stories')}", "story", S1),
    ("instagram.com", f"n > 1 AND {_is(0, 'p', 'reel')}", "=CASE get(p,0) WHEN 'p' THEN 'post' ELSE 'reel' END", S1),
    ("instagram.com", _is(0, "reels", "explore"), "=get(p,0)", None),
    ("instagram.com", _is(0, "direct"), "messages", None),
    ("instagram.com", _is(0, "emails", "accounts"), "sign_in", None),
    ("instagram.com", "true", "profile", "get(p,0)"),
    ("linear.app", "n = 0", "home", None),
    ("linear.app", _is(0, "join", "signin"), "sign_in", None),
    ("linear.app", "n = 1", "dashboard", "get(p,0)"),
    ("linear.app", f"n >= 3 AND {_is(1, 'project')}", "project", _slug(S2)),
    ("linear.app", f"n >= 3 AND {_is(1, 'issue')}", "issue", S2),
    ("linear.app", _is(1, "roadmap", "cycles"), "=get(p,1)", "get(p,0)"),
    ("linear.app", _is(1, "inbox"), "notifications", None),
    ("linear.app", _is(1, "views"), "views", None),
    ("linear.app", _is(1, "my-issues"), "my_issues", None),
    ("linkedin.com", "n = 0", "feed", None),
    ("linkedin.com", f"n > 1 AND {_is(0, 'company')}", "company", _unq(S1)),
    ("linkedin.com", f"n > 1 AND {_is(0, 'in')}", "profile", _unq(S1)),
    ("linkedin.com", _is(0, "search"), f"=concat(coalesce({S2}, 'results'), '_search')", _unq("q(keywords)")),
    ("linkedin.com", _is(0, "notifications", "messaging", "jobs", "feed"), "=get(p,0)", None),
    ("linkedin.com", _is(0, "mynetwork"), "network", None),
    ("linkedin.com", f"n > 1 AND {_is(0, 'posts')}", "post", f"left({_slug(S1)}, 50)"),
    ("linkedin.com", _is(0, "checkpoint", "login", "uas"), "sign_in", None),
    ("lu.ma luma.com", "n = 0", "home", None),
    ("lu.ma luma.com", _is(0, "signin"), "sign_in", None),
    ("lu.ma luma.com", _is(0, "discover", "explore", "home", "settings", "user"), "=get(p,0)", None),
    ("lu.ma luma.com", "true", "event", "get(p,0)"),
    ("mail.google.com", _is(0, "mail"), "email", None),
    ("meet.google.com", "true", "meeting", "get(p,0)"),
    ("app.notion.com notion.com notion.so", "n = 0", "home", None),
    ("app.notion.com notion.com notion.so", "true", "doc", _slug("regexp_replace(element_at(p, -1), '-[^-]*$', '')")),
    ("partiful.com", "n = 0", "home", None),
    ("partiful.com", "true", "event", f"CASE WHEN n > 1 AND {_is(0, 'e')} THEN {S1} ELSE get(p,0) END"),
    ("producthunt.com", f"n >= 2 AND {_is(0, 'products', 'posts')}", "product", _slug(S1)),
    ("producthunt.com", "get(p,0) LIKE '@%'", "profile", _slug("substring(get(p,0), 2)")),
    ("reddit.com", "n = 0", "feed", None),
    ("reddit.com", f"n >= 5 AND {_is(0, 'r')} AND {_is(2, 'comments')}", "post", f"coalesce(nullif(left({_slug('get(p,4)')}, 50), ''), concat('r/', {S1}))"),
    ("reddit.com", f"n >= 2 AND {_is(0, 'r')}", "subreddit", f"concat('r/', {S1})"),
    ("reddit.com", f"n >= 2 AND {_is(0, 'u', 'user')}", "profile", f"concat('u/', {S1})"),
    ("slack.com", "n = 0 AND d = 'slack.com'", "home", None),
    ("slack.com", "n = 0 AND d = 'app.slack.com'", "app", None),
    ("slack.com", f"n = 0 AND {_TEAM} NOT IN ('', 'status', 'docs', 'app', 'api')", "messaging", _TEAM),
    ("slack.com", _is(0, "sign-in", "signin"), "sign_in", None),
    ("slack.com", _is(0, "app_redirect"), "messaging", "concat_ws('/', nullif(trim(q(team)), ''), nullif(trim(q(channel)), ''))"),
    ("slack.com", _is(0, "client"), "messaging", "array_join(slice(p, 2, 2), '/')"),
    ("slack.com", f"n >= 2 AND {_is(0, 'archives')}", "messaging", f"concat({_PREFIX}, {S1}, CASE WHEN {S2} RLIKE '^p[0-9]+$' THEN concat('/', {S2}) ELSE '' END)"),
    ("stackoverflow.com", f"n >= 2 AND {_is(0, 'questions')}", "question", f"coalesce(replace({S2}, '-', ' '), {S1})"),
    ("supabase.com", f"n >= 3 AND {_is(0, 'dashboard')} AND {_is(1, 'project')}", "project", S2),
    ("supabase.com", _is(0, "dashboard"), "dashboard", None),
    ("twitter.com x.com", f"n = 0 OR {_is(0, 'explore', 'home')}", "feed", None),
    ("twitter.com x.com", _is(0, "messages", "notifications"), "=get(p,0)", None),
    ("twitter.com x.com", _is(0, "search"), "search", _unq("q(q)")),
    ("twitter.com x.com", f"{_is(0, 'i')} AND {_is(1, 'flow')}", "sign_in", None),
    ("twitter.com x.com", f"{_is(0, 'i')} AND {_is(1, 'chat')}", "messages", None),
    ("twitter.com x.com", _is(0, "i"), "page", f"coalesce({S1}, 'i')"),
    ("twitter.com x.com", _is(0, "compose", "jobs", "logout", "settings"), "page", "get(p,0)"),
    ("twitter.com x.com", f"n >= 3 AND {_is(1, 'status')}", "post", "get(p,0)"),
    ("twitter.com x.com", "true", "profile", "get(p,0)"),
    ("vercel.com", "n >= 2", "project", _REPO),
    ("vercel.com", "true", "dashboard", "get(p,0)"),
    ("youtube.com", _is(0, "watch"), "video", "q(v)"),
    ("youtube.com", _is(0, "results"), "search", _unq("q(search_query)")),
    ("youtube.com", f"n > 1 AND {_is(0, 'shorts')}", "video", S1),
    ("youtube.com", "get(p,0) LIKE '@%'", "channel", "get(p,0)"),
]
_SIGN_IN = "array('auth', 'login', 'logout', 'oauth', 'sign-in', 'sign_in', 'signin', 'sso')"
GENERAL: list[tuple[str, str, str | None]] = [
    *[(f"trim(q({k})) <> ''", "search", f"trim({_unq(f'q({k})')})") for k in ("q", "query", "search_query")],
    (f"d RLIKE '^(accounts|auth|login|signin)[.]' OR arrays_overlap(transform(slice(p, 1, 3), s -> lower(s)), {_SIGN_IN})", "sign_in", None),
    ("d RLIKE '^(admin|app|console|dashboard|portal)[.]'", "dashboard", "get(p,0)"),
    ("lower(get(p,0)) IN ('settings', 'console', 'admin', 'dashboard')", "dashboard", "lower(get(p,0))"),
    ("d LIKE 'mail.%' OR lower(get(p,0)) IN ('inbox', 'mail')", "email", None),
    ("d LIKE 'calendar.%' OR lower(get(p,0)) = 'calendar'", "calendar", None),
    ("d RLIKE '^(meet|zoom)[.]' OR contains(d, 'zoom.us')", "meeting", None),
    ("true", "page", "get(p,0)"),
]


def _q(sql: str) -> str:
    return re.sub(r"q\((\w+)\)", r"get(transform(filter(q, e -> e.k = '\1'), e -> e.v), 0)", sql)


def _case(condition: str, kind: str, entity: str | None) -> str:
    kind = kind[1:] if kind.startswith("=") else repr(kind)
    return f"WHEN {_q(condition)} THEN named_struct('kind', {kind}, 'entity', CAST({_q(entity) if entity else 'NULL'} AS STRING))"


def compiled(rules=None) -> str:
    """SQL for struct<kind, entity> over d, p, n and q; rules come before the built-in ones of a host."""
    rules = [*(rules or []), *RULES]
    hosts = sorted({h for r in rules for h in r[0].split()})
    known = ", ".join(map(repr, hosts))
    by_host: dict[str, list[str]] = {}
    for names, *rule in rules:
        by_host.setdefault(names, []).append(_case(*rule))
    site = f"CASE WHEN d IN ({known}) THEN d WHEN substring_index(d, '.', -2) IN ({known}) THEN substring_index(d, '.', -2) END"
    groups = " ".join(f"WHEN s IN ({', '.join(map(repr, names.split()))}) THEN CASE {' '.join(cases)} END" for names, cases in by_host.items())
    general = " ".join(_case(*r) for r in GENERAL)
    return site, f"CASE WHEN d = '' THEN named_struct('kind', 'page', 'entity', CAST(NULL AS STRING)) ELSE coalesce(CASE {groups} END, CASE {general} END) END"


def with_page(df: DataFrame, url: str, to: str = "page", rules=None) -> DataFrame:
    """df with column to: struct<kind, domain, entity> of the column url; a null or hostless url is an empty page.
    White space in an entity is collapsed and an empty one is null; kind and domain are never null."""
    site, case = compiled(rules)
    keep = [F.col(f"`{c}`") for c in df.columns]
    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    parts = df.select(F.struct(*keep).alias("_row"), bare_host(u).alias("d"), path_parts(u).alias("p"), query_pairs(u).alias("q"))
    parts = parts.select("_row", "d", "p", F.size("p").alias("n"), "q", F.expr(site).alias("s"))
    typed = parts.select("_row", "d", F.expr(case).alias("t"))
    entity = F.nullif(F.trim(F.regexp_replace("t.entity", r"\s+", " ")), F.lit(""))
    return typed.select("_row.*", F.struct(F.col("t.kind").alias("kind"), F.col("d").alias("domain"), entity.alias("entity")).alias(to))


def label(page: Column) -> Column:
    return F.concat_ws(": ", page["kind"], page["entity"])
