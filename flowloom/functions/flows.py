"""Expressions over flow columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.common import text

#: Outcomes whose connection-level records are hidden by default.
HIDDEN_OUTCOMES = ("tls_rejected", "no_request", "udp_undecoded")


def url(scheme: Column | None = None, authority: Column | None = None, path: Column | None = None, query: Column | None = None) -> Column:
    """scheme (or https) :// authority path ? query."""
    s, a, p, q = (F.col(n) if c is None else c for n, c in (("scheme", scheme), ("authority", authority), ("path", path), ("query", query)))
    return F.concat(F.when(text(s) == "", "https").otherwise(s), F.lit("://"), text(a), text(p), F.when(text(q) == "", "").otherwise(F.concat(F.lit("?"), q)))


def display_host(authority: Column) -> Column:
    """The Unicode form of a host with punycode labels, a port kept, else NULL; labels that can't be decoded stay. The JVM decodes, and
    only hosts that have such a label are looked at."""
    name = F.regexp_replace(authority, r":\d+$", "")
    shown = F.try_reflect(F.lit("java.net.IDN"), F.lit("toUnicode"), name)
    return F.when(F.lower(authority).contains("xn--") & (shown != name), F.concat(shown, F.regexp_extract(authority, r"(:\d+)$", 1)))


def status_text(status: Column) -> Column:
    """Decimal status, '' while there is no response."""
    return F.when(F.coalesce(status, F.lit(0)) == 0, "").otherwise(status.cast("string"))


def has_response(status: Column) -> Column:
    return F.coalesce(status, F.lit(0)) != 0


def hidden(protocol: Column, outcome: Column) -> Column:
    """Lookup and connection-level records that lists leave out unless asked."""
    return F.coalesce(protocol == "DNS", F.lit(False)) | F.coalesce(outcome.isin(*HIDDEN_OUTCOMES), F.lit(False))


def status_class(status: Column) -> Column:
    s = F.coalesce(status, F.lit(0))
    return F.when(s == 0, "pending").when(s.between(100, 599), F.concat(F.floor(s / 100).cast("string"), F.lit("xx"))).otherwise("other")


def format_duration(micros: Column) -> Column:
    """'' while pending, then us, ms, s or m:ss."""
    m = F.coalesce(micros, F.lit(0))
    return (
        F.when(m <= 0, "")
        .when(m < 1000, F.format_string("%dus", m))
        .when(m < 1_000_000, F.format_string("%dms", F.floor(m / 1000)))
        .when(m < 60_000_000, F.concat(F.format_string("%d.", F.floor(m / 1_000_000)), F.format_string("%ds", F.floor(m / 100_000) % 10)))
        .otherwise(F.format_string("%dm%02ds", F.floor(m / 60_000_000), F.floor(m / 1_000_000) % 60))
    )


def format_bytes(n: Column) -> Column:
    v = F.coalesce(n, F.lit(0))
    tenth = lambda unit: F.floor(v * 10 / unit)
    scaled = lambda unit, name: F.format_string(f"%d.%d {name}", F.floor(tenth(unit) / 10), tenth(unit) % 10)
    return F.when(v < 1024, F.format_string("%d B", v)).when(v < 1024**2, scaled(1024, "KiB")).when(v < 1024**3, scaled(1024**2, "MiB")).otherwise(scaled(1024**3, "GiB"))


def snippet(haystack: Column, needle: str, around: int = 60) -> Column:
    """First occurrence of needle, without regard to case, with ``around`` characters on both sides, white space
    collapsed, dots where text was left out; NULL where there is none."""
    h = text(haystack)
    at = F.locate(needle.lower(), F.lower(h))
    start = F.greatest(at - F.lit(around), F.lit(1))
    size = at - start + F.lit(len(needle) + around)
    body = F.trim(F.regexp_replace(F.substring(h, start, size), r"\s+", " "))
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + size <= F.length(h), "…").otherwise("")))


def address_host(address: Column) -> Column:
    """Host of host:port, without brackets."""
    return F.regexp_replace(F.regexp_replace(text(address), r":(\d+)$", ""), r"^\[|\]$", "")


def address_port(address: Column) -> Column:
    return F.regexp_extract(text(address), r":(\d+)$", 1)


def best_name(authority: Column, sni: Column, dns: Column, address: Column) -> tuple[Column, Column]:
    """(name, source) of a connection: the first that is present of the client's authority, the hello's name, the last lookup's answer
    for its address, the address itself."""
    cases = (("authority", authority), ("sni", sni), ("dns", dns))
    name, source = text(address), F.lit("ip")
    for label, c in reversed(cases):
        name, source = F.when(text(c) != "", c).otherwise(name), F.when(text(c) != "", label).otherwise(source)
    return name.alias("name"), source.alias("source")


def capture_filter(src: Column, dst: Column, protocol: Column) -> Column:
    """Display filter of the two ends of a connection for packet tools."""
    layer = F.when(protocol == "HTTP/3", "udp").when(protocol == "DNS", "udp").otherwise("tcp")

    def end(a: Column) -> Column:
        family = F.when(address_host(a).contains(":"), "ipv6").otherwise("ip")
        return F.concat(family, F.lit(".addr == "), address_host(a), F.when(address_port(a) == "", "").otherwise(F.concat(F.lit(" && "), layer, F.lit(".port == "), address_port(a))))

    return F.concat_ws(" && ", F.when(text(src) != "", end(src)), F.when(text(dst) != "", end(dst)))


def shell_quote(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text(c), F.lit("'"), F.lit("'\\''")), F.lit("'"))


def curl(method: Column, url_: Column, headers: Column) -> Column:
    """A command line that repeats the request; headers: array of structs name, value in wire order."""
    lines = F.transform(F.filter(headers, lambda h: ~h["name"].startswith(":") & (F.lower(h["name"]) != "content-length")), lambda h: F.concat(F.lit("-H "), shell_quote(F.concat(h["name"], F.lit(": "), text(h["value"])))))
    return F.concat_ws(" ", F.lit("curl"), F.when(text(method).isin("", "GET"), F.lit(None)).otherwise(F.concat(F.lit("-X "), method)), shell_quote(url_), F.when(F.size(lines) > 0, F.array_join(lines, " ")))


def raw_request(method: Column, path: Column, query: Column, authority: Column, headers: Column) -> Column:
    """Head of the request as text."""
    target = F.concat(F.when(text(path) == "", "/").otherwise(path), F.when(text(query) == "", "").otherwise(F.concat(F.lit("?"), query)))
    lines = F.transform(F.filter(headers, lambda h: ~h["name"].startswith(":")), lambda h: F.concat(h["name"], F.lit(": "), text(h["value"])))
    named = F.exists(headers, lambda h: F.lower(h["name"]) == "host")
    return F.concat(F.concat_ws(" ", method, target, F.lit("HTTP/1.1")), F.lit("\r\n"), F.when(named | (text(authority) == ""), "").otherwise(F.concat(F.lit("host: "), authority, F.lit("\r\n"))), F.array_join(lines, "\r\n"), F.when(F.size(lines) > 0, "\r\n").otherwise(""), F.lit("\r\n"))


def raw_response(status: Column, headers: Column) -> Column:
    """Head of the answer as text."""
    lines = F.transform(F.filter(headers, lambda h: ~h["name"].startswith(":")), lambda h: F.concat(h["name"], F.lit(": "), text(h["value"])))
    return F.concat(F.lit("HTTP/1.1 "), status.cast("string"), F.lit("\r\n"), F.array_join(lines, "\r\n"), F.when(F.size(lines) > 0, "\r\n").otherwise(""), F.lit("\r\n"))


#: HTTP/2 setting names by number.
H2_SETTINGS = {"1": "HEADER_TABLE_SIZE", "2": "ENABLE_PUSH", "3": "MAX_CONCURRENT_STREAMS", "4": "INITIAL_WINDOW_SIZE", "5": "MAX_FRAME_SIZE", "6": "MAX_HEADER_LIST_SIZE", "8": "ENABLE_CONNECT_PROTOCOL", "9": "NO_RFC7540_PRIORITIES"}
#: Pseudo-headers by letter.
H2_PSEUDO = {"m": ":method", "a": ":authority", "s": ":scheme", "p": ":path"}


def http2_fingerprint_text(fingerprint: Column) -> Column:
    """settings|window|priority|order spelled out; '' where there are not four parts."""
    parts = F.split(text(fingerprint), r"\|")
    names = F.create_map(*[x for k, v in H2_SETTINGS.items() for x in (F.lit(k), F.lit(v))])
    pseudo = F.create_map(*[x for k, v in H2_PSEUDO.items() for x in (F.lit(k), F.lit(v))])

    def setting(x: Column) -> Column:
        kv = F.split(x, ":")
        return F.concat(F.coalesce(F.try_element_at(names, kv[0]), F.concat(F.lit("SETTING_"), kv[0])), F.lit("="), F.coalesce(F.try_element_at(kv, F.lit(2)), F.lit("")))

    settings = F.array_join(F.transform(F.filter(F.split(parts[0], ";"), lambda x: x != ""), setting), ", ")
    order = F.array_join(F.transform(F.filter(F.split(F.try_element_at(parts, F.lit(4)), ","), lambda x: x != ""), lambda x: F.coalesce(F.try_element_at(pseudo, x), x)), " ")
    return F.when(F.size(parts) == 4, F.concat_ws("; ", settings, F.concat(F.lit("window +"), parts[1]), F.concat(F.lit("priority "), parts[2]), order)).otherwise("")
