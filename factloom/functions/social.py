"""Company profiles on social platforms: canonical form, published form and whose account it is."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import fixed, names, text, urls
from factloom.functions.let import let


def platform(host: Column) -> Column:
    bare = F.substring_index(F.lower(host), ":", 1)
    out = F.when(F.lit(False), F.lit(""))
    for p in fixed.SOCIAL_HOSTS:
        out = out.when(urls.on_site(bare, F.lit(p)), p)
    return out


def _account_paths(url: Column) -> Column:
    return F.transform(urls.segments(urls.path(url)), lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s))


def canonical(link: Column) -> Column:
    """The profile URL in one form, NULL for posts, people, share links and other features."""
    return let(text.strip(link), lambda url: let(
        F.struct(
            platform(urls.authority(url)).alias("site"), _account_paths(url).alias("parts"), urls.query(url).alias("query"),
            (~urls.malformed(url) & urls.scheme(url).isin("http", "https")).alias("usable"),
        ),
        _canonical_of,
    ))


def _canonical_of(u: Column) -> Column:
    parts, site = u["parts"], u["site"]
    first, second, third = (F.get(parts, F.lit(i)) for i in range(3))
    lead, n = F.lower(first), F.size(parts)

    def handle(c: Column) -> Column:
        return c.rlike(fixed.HANDLE)

    def reserved(name: str) -> Column:
        return lead.isin(fixed.PLATFORM_RESERVED[name])

    page_id = F.regexp_extract(u["query"], r"(?:^|&)id=(\d{5,})", 1)
    facebook = (
        F.when(lead == "profile.php", F.when(page_id != "", F.concat(F.lit("https://www.facebook.com/profile.php?id="), page_id)))
        .when((lead == "pages") & (n >= 3), F.concat(F.lit("https://www.facebook.com/pages/"), second, F.lit("/"), third))
        .when((lead == "people") & (n >= 3) & third.rlike(r"(?U)^\d+$"), F.concat(F.lit("https://www.facebook.com/people/"), second, F.lit("/"), third))
        .when((lead == "p") & (n >= 2), F.concat(F.lit("https://www.facebook.com/p/"), second))
        .when((lead == "pg") & (n >= 2) & handle(second), F.concat(F.lit("https://www.facebook.com/"), second))
        .when(reserved("facebook.com") | ~handle(first) | first.rlike(r"(?U)^[\d_]+$"), F.lit(None))
        .otherwise(F.concat(F.lit("https://www.facebook.com/"), first))
    )
    linkedin = F.when(
        lead.isin("company", "school", "showcase") & (n >= 2) & handle(second),
        F.concat(F.lit("https://www.linkedin.com/"), lead, F.lit("/"), second),
    )
    instagram = F.when(~reserved("instagram.com") & handle(first), F.concat(F.lit("https://www.instagram.com/"), first, F.lit("/")))
    at_handle = lead.startswith("@") & (F.length(lead) > 2)
    youtube = F.when(
        lead.isin("channel", "c", "user") & (n >= 2), F.concat(F.lit("https://www.youtube.com/"), lead, F.lit("/"), second)
    ).when(at_handle, F.concat(F.lit("https://www.youtube.com/"), first))
    return F.when(
        u["usable"] & (n > 0),
        F.when(site == "linkedin.com", linkedin)
        .when(site == "facebook.com", facebook)
        .when(site == "instagram.com", instagram)
        .when((site == "twitter.com") & ~reserved("twitter.com") & handle(first), F.concat(F.lit("https://twitter.com/"), first))
        .when((site == "x.com") & ~reserved("x.com") & handle(first), F.concat(F.lit("https://x.com/"), first))
        .when((site == "tiktok.com") & at_handle, F.concat(F.lit("https://www.tiktok.com/"), first))
        .when(site == "youtube.com", youtube),
    )


def _path_encoded(segment: Column) -> Column:
    """Percent-encoding that leaves the characters browsers leave in a path."""
    encoded = F.replace(F.url_encode(segment), F.lit("+"), F.lit("%20"))
    for char in "@:%!$&'()+,;=~":
        encoded = F.replace(encoded, F.lit(f"%{ord(char):02X}"), F.lit(char))
    return encoded


def published_form(canonical_url: Column) -> Column:
    """https, the platform's bare host (twitter.com as x.com), no trailing slash."""
    def write(url: Column) -> Column:
        host = urls.without_www(urls.authority(url))
        path = F.array_join(F.transform(F.split(F.regexp_replace(urls.path(url), "/+$", ""), "/"), _path_encoded), "/")
        return urls.join_rest(path, urls.query(url), F.concat(F.lit("https://"), F.when(host == "twitter.com", F.lit("x.com")).otherwise(host)))

    return let(canonical_url, write)


def profile_key(link: Column) -> Column:
    """The de-duplication key of a profile link, NULL when it is none."""
    return canonical(F.regexp_replace(text.strip(link), r"""[\]\[)>'"]+$""", ""))


def is_profile_link(link: Column) -> Column:
    """A known platform and not a share, plugin or embed URL."""
    hosts = "|".join(h.replace(".", r"\.") for h in fixed.SOCIAL_HOSTS)
    return link.rlike(rf"(?iU)^https?://(?:[\w-]+\.)*(?:{hosts})/") & ~link.rlike(fixed.SOCIAL_NOT_PROFILE)


def account_name(canonical_url: Column) -> Column:
    """The account in lower-case letters and digits."""
    def of(parts: Column) -> Column:
        first = F.get(parts, F.lit(0))
        nested = (F.size(parts) > 1) & F.lower(first).isin(fixed.NESTED_ACCOUNTS)
        raw = F.when(nested, F.get(parts, F.lit(1))).otherwise(first)
        return F.coalesce(F.regexp_replace(F.ltrim(F.lower(raw), F.lit("@")), "[^a-z0-9æøå]", ""), F.lit(""))

    return let(urls.segments(urls.path(canonical_url)), of)


def resembles(canonical_url: Column, tokens: Column) -> Column:
    return let(account_name(canonical_url), lambda account: _close(account, tokens))


def _close(account: Column, tokens: Column) -> Column:
    return (F.length(account) >= 4) & F.exists(tokens, lambda t: F.contains(account, t) | F.contains(t, account))


def is_the_group(account: Column, name: Column) -> Column:
    """The company is the group itself: its name is exactly the brand before the group word."""
    cleaned = F.regexp_replace(text.fold(name), "[^a-z0-9æøå ]", " ")
    words = F.filter(F.split(text.squeeze(cleaned), " "), lambda w: (w != "") & ~w.isin(fixed.GROUP_OWNER_FORMS))
    return (F.size(words) > 0) & (F.regexp_replace(text.fold(account), fixed.GROUP_IN_ACCOUNT, "") == F.array_join(words, ""))


def names_branch_town(account: Column, town: Column, own: Column) -> Column:
    """The account ends in a town that is no part of `own` (folded letters of name, site and address)."""
    plain_town = text.fold(town)
    folded = text.fold(account)
    return (
        folded.endswith(plain_town) & (F.length(folded) > F.length(plain_town) + 3) & ~F.contains(own, plain_town)
    )


def own_letters(name: Column, site: Column, home: Column) -> Column:
    joined = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(site, F.lit("")), F.coalesce(home, F.lit("")))
    return F.regexp_replace(text.fold(joined), "[^a-z0-9]", "")


def is_plausibly_own(canonical_url: Column, name: Column, site: Column, branch_town: Column) -> Column:
    """Publishable as the company's own: not an id, a foreign form, the group, a sister or a branch,
    and the account resembles the name or starts with the domain label."""
    def judge(u: Column) -> Column:
        account, raw = u["account"], u["raw"]
        folded_account, folded_name = u["folded_account"], u["folded_name"]
        sister = F.exists(F.array(*[F.lit(w) for w in fixed.SISTER_WORDS]), lambda w: F.contains(folded_account, w) & ~F.contains(folded_name, w))
        foreign = raw.rlike(fixed.FOREIGN_FORM) & ~name.rlike(fixed.FOREIGN_FORM)
        group = account.rlike(fixed.GROUP_IN_ACCOUNT) & ~name.rlike(fixed.GROUP_IN_ACCOUNT) & ~is_the_group(account, name)
        close = _close(account, u["tokens"]) | ((F.length(u["label"]) >= 3) & account.startswith(u["label"]))
        rejected = (account == "") | account.rlike(fixed.ID_ACCOUNT) | canonical_url.contains("profile.php")
        return ~rejected & ~foreign & ~group & ~sister & ~F.coalesce(branch_town, F.lit(False)) & close

    verdict = let(F.struct(
        account_name(canonical_url).alias("account"), F.try_element_at(urls.segments(urls.path(canonical_url)), F.lit(-1)).alias("raw"),
        text.fold(account_name(canonical_url)).alias("folded_account"), text.fold(name).alias("folded_name"),
        names.identity_tokens(name, site).alias("tokens"), F.regexp_replace(urls.label(site), "[^a-z0-9æøå]", "").alias("label"),
    ), judge)
    return F.coalesce(verdict, F.lit(False))


def is_the_company(canonical_url: Column, name: Column, site: Column) -> Column:
    """The account is the whole name or the domain label, nothing more."""
    account = F.regexp_replace(names.plain(account_name(canonical_url)), fixed.ACCOUNT_TAIL, "")
    whole = names.plain(F.array_join(names.stem_words(name), ""))
    return F.coalesce((account != "") & ((account == whole) | (account == names.plain(urls.label(site)))), F.lit(False))


def account_spellings(canonical_url: Column) -> Column:
    """The spellings under which another company's name would claim this account."""
    account = names.plain(account_name(canonical_url))
    return F.array_distinct(F.array(account, F.regexp_replace(account, fixed.ACCOUNT_TAIL, "")))


def script_links(html: Column) -> Column:
    """Profile addresses in a page's raw text, as written."""
    return F.regexp_extract_all(html, F.lit(fixed.SCRIPT_SOCIAL), 0)


def platform_label(host: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for domain, label in fixed.PLATFORM_LABELS:
        out = out.when(urls.on_site(host, F.lit(domain)), label)
    return out.otherwise(host)
