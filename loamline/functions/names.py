"""Names of features, flows and symbols as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How words are shown.
ACRONYMS = "api sdk ui ux url uri uuid http https ssl tls tcp udp ip dns cdn cli ide sso oidc saml jwt mfa 2fa ai ml nlp llm sql nosql orm json yaml xml csv pdf png jpg svg rest grpc ci cd qa dev prod id io os".split()
BRANDS = {"oauth": "OAuth", "graphql": "GraphQL", "trpc": "tRPC", "javascript": "JavaScript", "typescript": "TypeScript", "nodejs": "Node.js", "github": "GitHub", "gitlab": "GitLab"}
SMALL_WORDS = "of the a an in on at for to by with as or vs".split()
#: Domains of flows by what their names contain, in this order.
DOMAINS = {
    "auth": (
        "auth", "authenticate", "signin", "sign-in", "signup", "sign-up", "login", "logout", "password", "oauth", "sso", "saml", "oidc", "register", "verify-email",
        "email-verification", "reset-password", "forgot-password", "two-factor", "2fa", "mfa", "magic-link", "activate-invited", "activate-account", "session",
    ),
    "billing": ("billing", "subscription", "invoice", "payment", "checkout", "pricing", "stripe", "refund", "plan-upgrade", "downgrade-plan", "manage-plan"),
    "notifications": ("notification", "alert-rule", "push-notification"),
}
#: What else the name of a domain's feature may contain.
DOMAIN_HINTS = {
    "auth": ("account", "identity", "access control", "access-control", "user management", "user-management", "session"),
    "billing": ("subscription", "payment", "plan", "checkout"),
    "notifications": ("alert", "alerting"),
}


def humanize(name: Column) -> Column:
    """Label of a slug: its last path part in title case; acronyms and brands as usual, `and` as &."""
    last = F.substring_index(name, "/", -1)

    def shown(token: Column, i: Column) -> Column:
        low = F.lower(token)
        brand = F.element_at(F.create_map(*[F.lit(x) for kv in BRANDS.items() for x in kv]), low)
        title = F.concat(F.upper(F.substring(token, 1, 1)), F.lower(F.substr(token, F.lit(2))))
        return F.when(low == "and", "&").when(brand.isNotNull(), brand).when(low.isin(*ACRONYMS), F.upper(token)).when((i > 0) & low.isin(*SMALL_WORDS), low).when(F.substr(token, F.lit(2)).rlike("[A-Z]"), token).otherwise(title)

    tokens = F.array_remove(F.split(last, r"[-_\s]+"), "")
    label = F.array_join(F.transform(tokens, shown), " ")
    plain = last.contains(" ") & ~last.contains("-") & ~last.contains("_")
    return F.when(F.length(last) == 0, name).when(plain | (F.size(tokens) == 0), last).otherwise(label)


def in_domain(name: Column, domain: str) -> Column:
    """The name or path contains a word of the domain."""
    norm = F.regexp_replace(F.lower(name), r"[\s_/]+", "-")
    return norm.rlike("|".join(DOMAINS[domain]))


def flow_domain(name: Column) -> Column:
    """The first domain that the name is in, or null."""
    return F.coalesce(*[F.when(in_domain(name, d), F.lit(d)) for d in DOMAINS])


def covered_domains(feature: Column) -> Column:
    """The domains that a feature of this name stands for."""
    low = F.lower(feature)
    return F.array_compact(F.array(*[F.when(low.rlike("|".join((d, *DOMAIN_HINTS[d]))), F.lit(d)) for d in DOMAINS]))


def name_tokens(name: Column) -> Column:
    """Words of a name, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.array_remove(F.split(F.lower(name), r"[^a-z0-9]+"), "")))


def same_name(detected: Column, expected: Column) -> Column:
    """Equal, one a path under the other, the same words, or all of at least two expected words among the detected."""
    d, e = F.lower(detected), F.lower(expected)
    dt, et = name_tokens(detected), name_tokens(expected)
    subset = (F.size(et) >= 2) & (F.size(F.array_except(et, dt)) == 0)
    return (d == e) | d.startswith(F.concat(e, F.lit("/"))) | e.startswith(F.concat(d, F.lit("/"))) | (dt == et) | subset


def deep_link(remote: Column, path: Column, first: Column, last: Column) -> Column:
    return F.concat(remote, F.lit("/blob/HEAD/"), path, F.lit("#L"), first.cast("string"), F.lit("-L"), last.cast("string"))


# Words of technical layers, and extensions that give a file name away.
TECHNICAL_WORDS = "data display view render layout page navigation routing state management error handling validation utility helper component hook service store config loading fetching caching storage styling theming animation setup init".split()
EXTENSIONS = ".ts .tsx .js .jsx .mjs .cjs .py .rb .go .rs .java .kt .css .scss .less .html .vue .svelte .json .yaml .yml .toml .md .txt".split()
MARKETING = ("book-meeting", "subscribe-to-newsletter", "apply-to-", "view-go-page", "view-pricing", "sign-up-for-", "contact-sales")
TYPE_KINDS = ("type", "enum", "reexport")
VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
# Roles of symbols by name, the first match wins.
ROLES = (
    ("loading-state", r"(?:^|[a-zA-Z_])(?:is|has)?(?:Loading|Pending|Fetching|Submitting|Saving|Refetching)(?:$|[A-Z_])"),
    ("error-state", r"(?:^|[a-zA-Z_])(?:is|has)?(?:Error|Errors|ErrorMessage|ErrorState|Failure|Failed)(?:$|[A-Z_])"),
    ("validator", r"^(?:validate|isValid|check|assert|ensure)[A-Z_]|^[a-z][A-Za-z]*Schema$|^[A-Z][A-Za-z]*Schema$|.+Validator$"),
    ("data-fetch", r"^use[A-Z][A-Za-z]*(?:Mutation|Query|InfiniteQuery|SuspenseQuery|Subscription)$|^(?:fetch|get|list|load|create|update|delete)[A-Z][A-Za-z]*(?:Async|Promise)?$"),
    ("side-effect", r"^use[A-Z][A-Za-z]*Effect$|^on[A-Z][A-Za-z]+$|^(?:before|after)[A-Z][A-Za-z]+Hook$"),
    ("state", r"^(?:set|use)[A-Z][A-Za-z]*(?:State|Store|Atom|Signal|Reducer|Context)?$|.+(?:Atom|Signal|Store|Slice|Reducer|Context)$"),
    ("handler", r"^handle[A-Z][A-Za-z]*$|^[A-Za-z]+Handler$|^[A-Za-z]+Controller$|^[A-Za-z]+Action$"),
)
# Fixed value: how a description names its entry.
ENTRY = r"\(entry:\s*([^:)]+):(\d+)\)\s*$"


def symbol_role(name: Column, kind: Column, path: Column, has_routes: Column) -> Column:
    """What a symbol does in a flow: type, entry, one of ROLES, ui-component for capitalised names in component files, else helper."""
    out = F.when(name.isNull() | (name == ""), "helper").when(kind.isin(*TYPE_KINDS), "type").when(has_routes & name.isin(*VERBS), "entry")
    for role, pattern in ROLES:
        out = out.when(name.rlike(pattern), F.lit(role))
    shown = path.rlike(r"\.(?:tsx|jsx)$") & kind.isin("function", "class", "const") & name.rlike("^[A-Z]") & (name != F.upper(name))
    return out.when(shown, "ui-component").otherwise("helper")


def is_filename_flow(flow: Column) -> Column:
    bare = F.regexp_replace(flow, "-flow$", "")
    out = F.lit(False)
    for e in EXTENSIONS:
        out = out | bare.contains(e)
    return out


def is_technical_flow(flow: Column) -> Column:
    """All words of the name name technical layers."""
    words = F.array_remove(F.split(F.replace(F.lower(F.trim(flow)), F.lit("-flow"), F.lit("")), "-"), "")
    return (F.size(words) > 0) & (F.size(F.array_except(words, F.array(*map(F.lit, TECHNICAL_WORDS)))) == 0)


def is_marketing_flow(flow: Column) -> Column:
    return F.lower(flow).rlike("|".join(MARKETING))


def entry_trail(text: Column) -> dict[str, Column]:
    """Description without its closing (entry: file:line), and the two."""
    return {
        "description": F.nullif(F.rtrim(F.regexp_replace(text, ENTRY, "")), F.lit("")),
        "entry_file": F.nullif(F.trim(F.regexp_extract(text, ENTRY, 1)), F.lit("")),
        "entry_line": F.nullif(F.regexp_extract(text, ENTRY, 2), F.lit("")).cast("int"),
    }


def is_better_name(old: Column, new: Column, generic: list[str]) -> Column:
    """The new name differs, is not all generic words, and brings a specific word that the old one lacks."""
    g = F.array(*map(F.lit, generic))
    n, o = name_tokens(new), name_tokens(old)
    differs = F.lower(F.trim(new)) != F.lower(F.trim(old))
    return F.coalesce((F.length(new) > 0) & differs & (F.size(F.array_except(F.array_except(n, o), g)) > 0), F.lit(False))


def name_match(feature: Column, flow: Column) -> Column:
    """2 if a word of the flow is a word of the feature, 1 if one is part of the other, else 0."""
    f, w = name_tokens(feature), F.filter(name_tokens(flow), lambda x: F.length(x) >= 4)
    part = F.exists(w, lambda x: F.exists(f, lambda y: (F.length(y) >= 4) & (y.contains(x) | x.contains(y))))
    return F.when(F.arrays_overlap(f, w), 2).when(part, 1).otherwise(0)
