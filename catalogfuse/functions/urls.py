"""URLs and asset addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogfuse.functions.basics import alternation, as_col, contains_any, distinct_in_order, first_hit, literal_map

_URL = "^([a-zA-Z][a-zA-Z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\\?[^#]*)?(#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _URL, i)


def url_host(url: Column | str) -> Column:
    """Host (and port) in lower case; '' when the text has none."""
    return F.lower(F.regexp_replace(_part(as_col(url), 2), "^//(?:[^@/]*@)?", ""))


def url_path(url: Column | str) -> Column:
    return _part(as_col(url), 3)


def with_scheme(url: Column | str, scheme: str = "https") -> Column:
    """Add a scheme to an address that has none."""
    text = F.trim(as_col(url))
    return (
        F.when(text.contains("://"), text)
        .when(text.startswith("//"), F.concat(F.lit(f"{scheme}:"), text))
        .otherwise(F.concat(F.lit(f"{scheme}://"), text))
    )


def route_url(url: Column | str, domains: Sequence[tuple[str, str]], custom: Sequence[tuple[str, str]] = ()) -> Column:
    """Source of a URL: first known domain it contains, then the caller's own domains; NULL if none."""
    full = with_scheme(url)
    lower = F.lower(full)
    cases = [(lower.contains(d.lower()), F.lit(s)) for d, s in domains]
    cases += [(full.contains(d), F.lit(s)) for d, s in custom]
    return first_hit(cases)


def normalize_asset_url(
    url: Column | str, collapse_hosts: Sequence[str] = (), probe_params: Sequence[str] = ()
) -> Column:
    """Trim, drop probe parameters and a dangling '?' or '&'; '//' in paths collapsed for one host family.

    ``probe_params`` are whole ``key=value`` pairs; the order of the others is kept.
    """
    text = F.trim(as_col(url))
    path = _part(text, 3)
    if collapse_hosts:
        family = url_host(text).rlike(f"(?:{alternation(collapse_hosts)})$")
        path = F.when(family, F.regexp_replace(path, "/{2,}", "/")).otherwise(path)
    pairs = F.filter(F.split(F.substring(_part(text, 4), F.lit(2), F.length(text)), "&"), lambda p: p != "")
    if probe_params:
        pairs = F.filter(pairs, lambda p: ~p.isin(*probe_params))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    joined = F.concat(_part(text, 1), _part(text, 2), path, query, _part(text, 5))
    return F.rtrim(joined, F.lit("?&"))


# File extensions that make an address an image.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp", ".avif")


def is_asset_url(url: Column | str, hosts: Sequence[str] = ()) -> Column:
    """Image by extension, and on one of ``hosts`` when given."""
    text = as_col(url)
    image = F.lower(url_path(text)).rlike(f"(?:{alternation(IMAGE_EXTENSIONS)})$")
    return image & url_host(text).rlike(f"(?:{alternation(hosts)})$") if hosts else image


def is_placeholder_asset(url: Column | str, markers: Sequence[str]) -> Column:
    """Address of a placeholder or login page."""
    return contains_any(F.lower(as_col(url)), markers)


def url_category(url: Column | str, rules: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """Category of the first rule whose text the URL contains."""
    url = as_col(url)
    return first_hit([(url.contains(text), F.lit(category)) for text, category in rules], F.lit(other))


# Quality suffix of a video file and its rank; names in brackets below are aliases.
QUALITY_RANKS = {
    "sm": 1, "dm": 2, "dmb": 3, "mmb": 4, "hmb": 5, "mhb": 6, "hhb": 7, "4k": 8,
    "mmbs": 4, "hmbs": 5, "mhbs": 6, "hhbs": 7, "4ks": 8,
}


def is_playlist(url: Column | str) -> Column:
    return F.lower(as_col(url)).contains(".m3u8")


def asset_rank(url: Column | str, ranks: dict[str, int] = QUALITY_RANKS) -> Column:
    """Quality rank of a video address by its suffix, 0 when unknown."""
    url = as_col(url)
    names = alternation(list(ranks))
    strict = F.regexp_extract(url, f"(?i)_({names})_[a-z]\\.mp4$", 1)
    loose = F.regexp_extract(url, f"(?i)({names})\\.mp4$", 1)
    key = F.lower(F.when(strict != "", strict).otherwise(loose))
    return F.coalesce(literal_map(ranks)[key], F.lit(0))


def asset_variants(
    url: Column | str, preferred_host: tuple[str, str], code: Column | str | None = None,
    code_template: str | None = None, suffix_pair: tuple[str, str] = ("pl.jpg", "ps.jpg"),
) -> Column:
    """Ordered alternative addresses: preferred host, code-based, as given, small form; distinct.

    ``code_template`` holds ``{code}``.
    """
    full = with_scheme(normalize_asset_url(url))
    old, new = preferred_host
    options = [F.when(full.contains(old), F.replace(full, F.lit(old), F.lit(new)))]
    if code is not None and code_template:
        options.append(F.replace(F.lit(code_template), F.lit("{code}"), as_col(code)))
    large, small = suffix_pair
    options += [full, F.when(full.endswith(large), F.regexp_replace(full, f"\\Q{large}\\E$", small))]
    return distinct_in_order(F.array(*options))


def fill_thumb_poster(
    thumb: Column | str, poster: Column | str, suffix_pair: tuple[str, str] = ("pl.jpg", "ps.jpg")
) -> Column:
    """Both addresses from either one: by suffix pair when it applies, else copied over."""
    thumb, poster = F.trim(as_col(thumb)), F.trim(as_col(poster))
    large, small = suffix_pair
    pattern = f"(?:\\Q{large}\\E|\\Q{small}\\E)$"
    base = F.when(thumb.rlike(pattern), F.regexp_replace(thumb, pattern, "")).when(
        poster.rlike(pattern), F.regexp_replace(poster, pattern, "")
    )
    some_thumb, some_poster = F.nullif(thumb, F.lit("")), F.nullif(poster, F.lit(""))
    return F.struct(
        F.coalesce(F.concat(base, F.lit(large)), some_thumb, some_poster).alias("thumb"),
        F.coalesce(F.concat(base, F.lit(small)), some_poster, some_thumb).alias("poster"),
    )


def asset_match_key(url: Column | str, mirror: tuple[str, str] | None = None, family: Sequence[str] = ()) -> Column:
    """Key under which two addresses are the same picture: path only inside one host family."""
    text = normalize_asset_url(url, family)
    path = url_path(text)
    if mirror:
        host, prefix = mirror
        path = F.when(
            (url_host(text) == host) & path.startswith(prefix), F.regexp_replace(path, f"^\\Q{prefix}\\E", "")
        ).otherwise(path)
    return F.when(is_asset_url(text, family), path).otherwise(text) if family else text


def drop_cover_from_gallery(
    gallery: Column | str, cover: Column | str, mirror: tuple[str, str] | None = None, family: Sequence[str] = ()
) -> Column:
    """Gallery without the entries that show the cover."""
    key = asset_match_key(cover, mirror, family)
    kept = F.filter(as_col(gallery), lambda g: asset_match_key(g, mirror, family) != key)
    return F.when(F.coalesce(key, F.lit("")) == "", as_col(gallery)).otherwise(kept)
