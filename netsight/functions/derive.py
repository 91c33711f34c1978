"""Row-level derivations: plain column expressions, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Transports that carry ports, SYN-only flag, protocol of an undissected frame.
PORT_PROTOCOLS = ("TCP", "UDP")
SYN_ONLY = "0x0002"
UNKNOWN_PROTOCOL = "UNKNOWN"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_HEXTET = "[0-9A-Fa-f]{1,4}"


def _filled(col: Column) -> Column:
    """Empty text counts as missing."""
    return F.when(col != "", col)


def full_url(
    has_http: Column, host: Column, full_uri: Column, uri: Column, sni: Column, *, any_case: bool = False
) -> Column:
    """URL of a request: from HTTP fields when the packet has them, else from the TLS server name.

    `any_case` accepts HTTP:// as an absolute URI too.
    """
    host, target, sni = _filled(host), F.coalesce(_filled(full_uri), _filled(uri)), _filled(sni)
    absolute = target.rlike("(?i)^https?://" if any_case else "^https?://")
    from_http = F.when(target.isNull(), F.concat(F.lit("http://"), host)).otherwise(
        F.when(absolute, target).otherwise(F.concat(F.lit("http://"), host, target))
    )
    return F.when(
        F.coalesce(has_http, F.lit(False)), F.when(host.isNotNull(), from_http)
    ).otherwise(F.concat(F.lit("https://"), sni))


def protocol(transport: Column, highest: Column) -> Column:
    return F.coalesce(_filled(transport), _filled(highest), F.lit(UNKNOWN_PROTOCOL))


def port(proto: Column, raw: Column) -> Column:
    """Port number of a TCP or UDP packet; anything else has none."""
    return F.when(proto.isin(*PORT_PROTOCOLS), raw.try_cast("int"))


def length(raw: Column) -> Column:
    return F.coalesce(raw.try_cast("int"), F.lit(0))


def _ip_pattern() -> str:
    """IPv4, or IPv6 with at most one '::', an optional dotted quad at the end and an optional zone."""
    quad = rf"{_IPV4}(?=%|\z)"
    hextet = rf"{_HEXTET}(?=[:%]|\z)"
    plain = rf"(?:{_HEXTET}:){{6}}(?:{_HEXTET}:{_HEXTET}|{_IPV4})"
    # '::' stands for at least one hextet, so at most seven are written out; a quad counts as two.
    eight = rf"(?::{{0,2}}{hextet}){{8}}|(?::{{0,2}}{hextet}){{6,}}:{{1,2}}{quad}"
    squeezed = rf"(?!{eight})(?:(?:{_HEXTET}:)*{_HEXTET})?::(?:(?:{_HEXTET}:)*(?:{_HEXTET}|{_IPV4}))?"
    return rf"^(?:{_IPV4}|(?:{plain}|{squeezed})(?:%[^%]+)?)\z"


def is_ip(ip: Column) -> Column:
    """Whether the text is a well-formed address; one pattern, so that `ip` is computed once."""
    return F.coalesce(ip.rlike(_ip_pattern()), F.lit(False))


def valid_ip_rows(packets: DataFrame) -> DataFrame:
    """Packets whose two addresses are both present and well formed."""
    return packets.filter(is_ip(F.col("src_ip")) & is_ip(F.col("dst_ip")))


def alert_type_of(message: Column) -> Column:
    """First word of a message."""
    return _filled(F.regexp_extract(message, r"(\S+)", 1))


def packet_count_of(details: Column) -> Column:
    """The whole number in front of ' packets'; NULL when the text has none."""
    return F.regexp_extract(details, "([0-9]+) packets", 1).try_cast("int")


def syn_flood_message(src_ip: Column) -> Column:
    return F.concat(F.lit("SYN flood from "), src_ip)


def url_message(label: Column, url: Column) -> Column:
    return F.concat(label, F.lit(" URL detected: "), url)


def behaviour_message(model: Column) -> Column:
    return F.concat(F.lit("Anomalous behaviour detected (model="), model, F.lit(")"))


def at_least(col: Column, floor: float) -> Column:
    """Lower-bound clip that keeps NULL."""
    return F.when(col.isNotNull(), F.greatest(col, F.lit(floor)))


def ratio(num: Column, den: Column, *, digits: int | None = 2, null_as_zero: bool = True) -> Column:
    value = num.cast("double") / F.nullif(den, F.lit(0))
    if digits is not None:
        value = F.round(value, digits)
    return F.coalesce(value, F.lit(0.0)) if null_as_zero else value


def dissect(raw: DataFrame) -> DataFrame:
    """Dissected packet fields -> rows of the packets table.

    Input: ts, transport_layer, highest_layer, src_ip, dst_ip, src_port, dst_port, length, tcp_flags,
    has_http, http_host, http_full_uri, http_uri, tls_sni; all text but ts and has_http.
    """
    c = F.col
    shaped = raw.withColumn("protocol", protocol(c("transport_layer"), c("highest_layer")))
    return shaped.select(
        "ts",
        "src_ip",
        port(c("protocol"), c("src_port")).alias("src_port"),
        "dst_ip",
        port(c("protocol"), c("dst_port")).alias("dst_port"),
        "protocol",
        length(c("length")).alias("pkt_len"),
        _filled(c("tcp_flags")).alias("tcp_flags"),
        full_url(c("has_http"), c("http_host"), c("http_full_uri"), c("http_uri"), c("tls_sni")).alias("full_url"),
    )
