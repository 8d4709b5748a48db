"""Url functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, squeeze_ends

#: Query keys that only track visitors.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid")
#: Hosts of cloud metadata services.
METADATA_HOSTS = ("metadata", "metadata.google.internal", "169.254.169.254")
#: IPv4 networks that are not public, as (first address, prefix length).
CLOSED_NETWORKS = (("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 29), ("192.0.0.170", 31), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4))
#: How adapters are called in source lists.
RSS_NAMES, HTML_NAMES = ("rss_feed", "rss-feed", "feed", "atom"), ("scrapy_static", "scrapy-static", "static", "html")

_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

#: Urls whose host is plainly a name with a dot, so no address and not localhost: most urls, told by one look.
_NAMED = r"(?s)^https?://(?:[a-z0-9_-]+\.)+[a-z]+(?:[/?#].*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def hostname(url: Column) -> Column:
    """Lower-case host without user, port and brackets; '' if there is none."""
    host = F.regexp_replace(netloc(url), r"^.*@", "")
    return F.lower(F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(host, r":.*$", "")))


def port(url: Column) -> Column:
    return F.regexp_extract(netloc(url), r":([^:\]@]*)$", 1)


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_string(url: Column) -> Column:
    """Query pairs without tracking keys, sorted by key and value, encoded anew."""
    raw = F.filter(F.split(F.coalesce(F.regexp_extract(url, _URL, 4), F.lit("")), "&"), lambda p: p != "")
    pairs = F.transform(raw, lambda p: F.struct(_decode(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("k"), _decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(*TRACKING_KEYS))
    ordered = F.array_sort(F.transform(kept, lambda p: F.struct(F.lower(p["k"]).alias("fold"), p["v"].alias("v"), p["k"].alias("k"))))
    return F.array_join(F.transform(ordered, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def normalize_source_url(value: Column) -> Column:
    """The one spelling of a source's url; null unless it is http or https with a host and a valid port."""
    url = squeeze_ends(value)
    s, host, p = scheme(url), hostname(url), port(url)
    bad_port = (p != "") & ~(p.rlike(r"^\d{1,5}$") & (F.coalesce(p.try_cast("int"), F.lit(99999)) <= 65535))
    default = (p == "") | ((s == "http") & (p.try_cast("int") == 80)) | ((s == "https") & (p.try_cast("int") == 443))
    path = F.regexp_extract(url, _URL, 3)
    path = F.regexp_replace(path, r";[^/]*$", "")
    path = F.when(path == "", "/").when((path != "/") & path.endswith("/"), F.regexp_replace(path, "/+$", "")).otherwise(path)
    query = query_string(url)
    made = F.concat(s, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), p.try_cast("int").cast("string"))), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(s.isin("http", "https") & (host != "") & ~bad_port, made)


def normalize_adapter(value: Column) -> Column:
    name = F.lower(squeeze_ends(value))
    return F.when(name.isin(*RSS_NAMES), "rss").when(name.isin(*HTML_NAMES), "scrapy").otherwise(name)


def adapter_route(value: Column) -> Column:
    """Which parser reads a source: 'rss', 'html', or null if there is none."""
    name = F.lower(squeeze_ends(value))
    return F.when(name.isin("rss", "rss_feed"), "rss").when(name.isin("scrapy", "scrapy_static", "static", "html"), "html")


def _v4(host: Column) -> Column:
    """An IPv4 address as a number, else null."""
    ok = host.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    number = F.aggregate(F.split(host, r"\."), F.lit(0).cast("long"), lambda total, part: total * 256 + part.try_cast("long"))
    return F.when(ok, number)


def closed_address(host: Column) -> Column:
    """Whether a host is a literal address that is private, local, reserved or multicast."""

    def inside(v4: Column) -> Column:
        found = F.lit(False)
        for first, bits in CLOSED_NETWORKS:
            low = sum(int(x) << (24 - 8 * k) for k, x in enumerate(first.split(".")))
            found = found | v4.between(low, low + (1 << (32 - bits)) - 1)
        return F.coalesce(found, F.lit(False))

    v6 = host.contains(":") & host.rlike(r"^(?:::1?$|::ffff:|f[cd]|fe[89ab]|ff|2001:db8:|100:)")
    return let(_v4(host), inside) | v6


def permitted(url: Column, allowed_hosts: tuple[str, ...] = (), also_closed: tuple[str, ...] = ()) -> Column:
    """Whether a post's url may be trusted: http(s), on the list if there is one, no local or closed address."""

    def of_host(host: Column) -> Column:
        listed = F.lit(True)
        if allowed_hosts:
            listed = F.lit(False)
            for name in allowed_hosts:
                listed = listed | (host == name) | host.endswith(f".{name}")
        shut = F.lit(False)
        if also_closed:
            shut = host.isin(*also_closed) | host.endswith(".localhost")
        return (host != "") & listed & (host != "localhost") & ~shut & ~closed_address(host)

    whole = F.coalesce(scheme(url).isin("http", "https") & let(hostname(url), of_host), F.lit(False))
    return whole if allowed_hosts or also_closed else F.when(url.rlike(_NAMED), F.lit(True)).otherwise(whole)


def fetchable(url: Column) -> Column:
    """The stricter rule for urls that are fetched: no metadata services and no *.localhost either."""
    return permitted(url, also_closed=METADATA_HOSTS)


def discovered_name(url: Column) -> Column:
    place = F.regexp_replace(F.concat(netloc(url), F.regexp_extract(url, _URL, 3)), "^/+|/+$", "")
    return F.concat(F.lit("Discovered feed - "), F.substring(place, 1, 180))


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, its `.` and `..` segments worked off; what would climb above the root stays there."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.array_join(parts, "/"), F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit("")))


def resolve(base: Column, href: Column) -> Column:
    """A link on a page as a whole url."""
    origin = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.regexp_replace(F.regexp_extract(base, _URL, 3), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    path, tail = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"^[^?#]*((?s:.*))$", 1)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    placed = F.concat(origin, without_dots(whole), tail)
    bare = F.regexp_replace(base, r"#.*$", "")
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href)).when(href == "", base).when(href.startswith("#"), F.concat(bare, href)).when(href.startswith("?"), F.concat(F.regexp_replace(bare, r"\?.*$", ""), href)).otherwise(placed)
