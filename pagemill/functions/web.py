"""Scalar functions on request headers: agents, addresses, languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of user agents in the order in which they are tried.
BROWSERS = (("Edg/", None, "Edge"), ("OPR/", None, "Opera"), ("Opera", None, "Opera"), ("Chrome/", "Chromium", "Chrome"), ("Firefox/", None, "Firefox"), ("Safari/", "Chrome", "Safari"))
MOBILE = ("iPhone", "iPad", "Android", "Mobile")
#: Fixed value: local addresses: 127.0.0.0/8, 10.0.0.0/8, 172.16.0.0/12, 192.168.0.0/16, 169.254.0.0/16, ::1, fc00::/7, fe80::/10.
_BYTE = r"\.(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
LOCAL = rf"^(?:(?:127|0?10){_BYTE}|172\.0?(?:1[6-9]|2\d|3[01])|192\.168|169\.254){_BYTE}{_BYTE}$|^::1\z|^(?i:f[cd]|fe[89ab])"


#: The tokens of operating_system, in the order in which they are tried.
def operating_system(agent: Column) -> Column:
    ua = F.coalesce(agent, F.lit(""))
    has = ua.contains
    version = F.translate(F.regexp_extract(ua, r"Mac OS X (\d+[_.]\d+)", 1), "_", ".")
    return (
        F.when(has("Windows NT 10") | has("Windows NT 11"), "Windows 10/11")
        .when(has("Windows NT"), "Windows")
        .when(has("Mac OS X") | has("Macintosh"), F.concat(F.lit("macOS "), version))
        .when(has("iPhone") | has("iPad"), "iOS/iPadOS")
        .when(has("Android"), "Android")
        .when(has("Linux"), "Linux")
        .otherwise("unknown")
    )


def browser(agent: Column) -> Column:
    ua = F.coalesce(agent, F.lit(""))
    named = [F.when(ua.contains(token) & (~ua.contains(unless) if unless else F.lit(True)), name) for token, unless, name in BROWSERS]
    return F.coalesce(*named, F.lit("unknown"))


def device(agent: Column) -> Column:
    return F.when(F.coalesce(agent, F.lit("")).rlike("|".join(MOBILE)), "mobile").otherwise("desktop")


def real_ip(forwarded: Column, real: Column, peer: Column) -> Column:
    """First forwarded address, else the real-ip header, else the peer."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(given(F.split(forwarded, ",")[0]), given(real), peer)


def first_language(header: Column) -> Column:
    return F.split(header, ",")[0]


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    part = lambda n: F.regexp_extract(ip, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", n).try_cast("bigint")
    value = part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)
    return F.when(F.greatest(part(1), part(2), part(3), part(4)) <= 255, value)


def is_local(ip: Column) -> Column:
    """Loopback, private or link-local. One pattern, so that the address is worked out once."""
    return F.coalesce(ip.rlike(LOCAL), F.lit(False))


#: Fixed value: characters of a user agent that a record keeps.
AGENT_CHARS = 300


def client_record(*, forwarded: Column, real: Column, peer: Column, agent: Column, language: Column) -> Column:
    """What is known of a client, as a JSON text with all fields (a hardware address never is)."""
    fields = {"ip": real_ip(forwarded, real, peer), "peer_ip": peer, "x_forwarded_for": forwarded, "os": operating_system(agent), "browser": browser(agent), "lang": first_language(language), "mac": F.lit(None).cast("string"), "user_agent": F.left(agent, F.lit(AGENT_CHARS))}
    return F.to_json(F.struct(*(value.alias(key) for key, value in fields.items())), {"ignoreNullFields": "false"})
